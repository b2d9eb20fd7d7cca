"""What several of the operators share: words, shared storage and size-checked broadcasts."""

from __future__ import annotations

import functools
import inspect
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Characters between words, `[\x20\x09-\x0D]`.
SPACE = " \t\n\x0b\x0c\r"
#: A side of a join goes to all executors only if it has at most so many rows and so many bytes, written as JSON.
BROADCAST_ROWS, BROADCAST_BYTES = 1_000_000, 32_000_000
#: A key is hot in a join if it has so many rows, and one in HOT_SHARE of all.
HOT_ROWS, HOT_SHARE = 50_000, 10_000
#: So many rows of a narrow table may be put in order in one task.
ONE_TASK_ROWS = 100_000

#: A table of few files is dealt to more tasks if it has so many bytes, and not more than so many.
TASK_BYTES, MOVED_BYTES = 4 << 20, 1 << 30

_own_dirs: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A Parquet table by name. One of fewer files than there are cores, too large for one task and small enough to be
    moved, is dealt to all of them: a file of one row group is one task otherwise."""
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    files, cores = df.inputFiles(), spark.sparkContext.defaultParallelism
    if len(files) >= cores:
        return df
    path = lambda f: spark._jvm.org.apache.hadoop.fs.Path(f)
    size = sum(path(f).getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path(f)).getLen() for f in files)
    return df.repartition(min(cores, 1 + 4 * size // TASK_BYTES)) if TASK_BYTES < size <= MOVED_BYTES else df


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which driver and executors share; where it is unset, as in tests, one of our own.
    Raises RuntimeError where it is unset and the master is not a local one: executors elsewhere would not see ours."""
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_dirs:
        _own_dirs[app] = "file://" + tempfile.mkdtemp(prefix="millrace-")
    return _own_dirs[app]


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, which the file system deletes when the application ends."""
    path = f"{shared_dir(spark)}/millrace-{name}-{uuid.uuid4().hex}"
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jvm_path)
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """df, written once as a table in the shared folder and read back: its lineage is cut and a lost executor costs no rows."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    back._scratch = path
    return back


def discard(df: DataFrame) -> None:
    """Deletes the table that materialize wrote for df, which nothing reads any more."""
    path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._scratch)
    path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def is_small(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> bool:
    """Whether df has at most so many rows and bytes (its rows as JSON); both are counted in place."""
    if not df.columns:
        return True
    n, total = df.agg(F.count("*"), F.sum(F.octet_length(F.to_json(F.struct(*[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(df.columns)]))))).first()
    return n <= rows and (total or 0) <= size


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> DataFrame:
    """df, marked for broadcast if it is small; else unmarked, for a shuffled join."""
    return F.broadcast(df) if is_small(df, rows, size) else df


def join_unique(left: DataFrame, right: DataFrame, key: str, rows: int = BROADCAST_ROWS, hot_rows: int = HOT_ROWS) -> DataFrame:
    """The inner join of left and right, whose rows have a key each; both are written tables, nulls join nothing.

    A small right side goes to all executors. Otherwise the hot keys do, of which there are at most HOT_SHARE, and the
    rows of the others are shuffled: no key's rows meet in one task.
    """
    if is_small(right, rows):
        return left.join(F.broadcast(right), key)
    least = max(hot_rows, left.count() // HOT_SHARE)
    hot = left.groupBy(key).agg(F.count("*").alias("_n")).where(F.col("_n") > least).select(key)
    met = F.broadcast(materialize(right.join(F.broadcast(materialize(hot, "hot")), key, "left_semi"), "hot"))
    return left.join(met, key).unionByName(left.join(met.select(key), key, "left_anti").join(right, key))


def left_join_unique(left: DataFrame, right: DataFrame, key: str, rows: int = BROADCAST_ROWS, hot_rows: int = HOT_ROWS) -> DataFrame:
    """The left join of left to right, a written table whose rows have a key each, none null. Rows of a null key match nothing.

    A small right side goes to all executors. Otherwise it does so for the hot keys of left, of which there are at most
    HOT_SHARE, matched or not, and rows of a null key stay where they are: only rows of other keys are shuffled, and no
    key's rows meet in one task. left is read once more a kind of row, and its keys twice.
    """
    if is_small(right, rows):
        return left.join(F.broadcast(right), key, "left")
    keys = left.select(key).where(F.col(key).isNotNull())
    least = max(hot_rows, keys.count() // HOT_SHARE)
    hot = materialize(keys.groupBy(key).agg(F.count("*").alias("_n")).where(F.col("_n") > least).select(key), "hot")
    met = F.broadcast(materialize(hot.join(right.join(F.broadcast(hot), key, "left_semi"), key, "left"), "hot"))
    cold = left.where(F.col(key).isNotNull()).join(F.broadcast(hot), key, "left_anti").join(right, key, "left")
    return left.join(met, key).unionByName(cold).unionByName(left.where(F.col(key).isNull()), allowMissingColumns=True)


def running_sums(df: DataFrame, order: list[Column], sums: dict[str, Column], by: tuple[str, ...] = (), one_task_rows: int = ONE_TASK_ROWS) -> DataFrame:
    """df with, for each name in sums, the sum of its expression over the rows before, within `by`; 0 for the first.

    Rows are sorted by ranges of (by, order), equal ones spread over ranges; each range is summed on its own and takes
    up what the ranges before have of the key it begins with, one row per range. No task holds a key. Rows equal in
    `order` come in any order. df is a written table, or cheap to count: one of few rows is summed by a plain window.
    Expressions must give whole numbers, none null.
    """
    names = list(sums)
    if df.count() <= one_task_rows:
        above = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
        return df.withColumns({n: F.coalesce(F.sum(e).over(above), F.lit(0)) for n, e in sums.items()})
    own = [F.col(b).asc_nulls_first() for b in by]
    spread = F.xxhash64(F.monotonically_increasing_id())
    dealt = materialize(df.withColumns({f"_add_{n}": e for n, e in sums.items()}).repartitionByRange(*own, *order, spread).withColumn("_range", F.spark_partition_id()), "ranges")
    key = F.struct(*by) if by else F.lit(0)
    totals = dealt.groupBy(key.alias("_of_key"), F.col("_range").alias("_of_range")).agg(*[F.sum(f"_add_{n}").alias(f"_add_{n}") for n in names])
    # A range takes up sums only for its first key, which is the last of the range before.
    ends = totals.groupBy("_of_range").agg(F.min("_of_key").alias("_first"), F.max("_of_key").alias("_last"))
    carried = totals.join(F.broadcast(ends), "_of_range").where("_of_key <=> _first or _of_key <=> _last")
    before = Window.partitionBy("_of_key").orderBy("_of_range").rowsBetween(Window.unboundedPreceding, -1)
    carried = carried.select("_of_key", "_of_range", *[F.sum(f"_add_{n}").over(before).alias(f"_before_{n}") for n in names]).where(F.col(f"_before_{names[0]}").isNotNull())
    within = Window.partitionBy("_range", *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    summed = dealt.withColumns({n: F.coalesce(F.sum(f"_add_{n}").over(within), F.lit(0)) for n in names}).withColumn("_key_", key)
    met = F.broadcast(materialize(carried, "carried"))
    joined = summed.join(met, (F.col("_range") == F.col("_of_range")) & F.col("_key_").eqNullSafe(F.col("_of_key")), "left")
    return joined.select(*df.columns, *[(F.col(n) + F.coalesce(F.col(f"_before_{n}"), F.lit(0))).alias(n) for n in names])


def extras_apart(*own: str) -> Callable[[Callable[..., DataFrame]], Callable[..., DataFrame]]:
    """For an operator on a table: columns that it does not read pass by it in one struct, so that none of their names
    clashes with one of its own. `own` are its parameters that name columns. Where a column has the name of a result,
    in any case, the result stays."""

    def wrap(operator: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        signature = inspect.signature(operator)

        @functools.wraps(operator)
        def run(docs: DataFrame, *args, **kwargs) -> DataFrame:
            given = signature.bind(docs, *args, **kwargs)
            given.apply_defaults()
            read = {given.arguments[name].lower() for name in own}
            extra = [c for c in docs.columns if c.lower() not in read]
            if not extra:
                return operator(docs, *args, **kwargs)
            apart = F.struct(*[F.col(f"`{c}`") for c in extra]).alias("_extra")
            out = operator(docs.select(*[c for c in docs.columns if c.lower() in read], apart), *args, **kwargs)
            results = [c for c in out.columns if c != "_extra" and c.lower() not in read]
            hidden = {c.lower() for c in results}
            back = [F.col("_extra").getField(c).alias(c) if c in extra else F.col(c) for c in docs.columns if (c.lower() not in hidden if c in extra else c in out.columns)]
            return out.select(*back, *results)

        return run

    return wrap


def words(text: Column) -> Column:
    """The words `[^\\x20\\x09-\\x0D]+` of a text in order; none for null."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACE))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, "[\\x20\\x09-\\x0D]+"))
