"""A corpus pipeline: quality classifier, near-duplicates, decontamination, mixing, sharding.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept. Stages but the last return the
columns of documents; a row that mixing repeats stands there as often as it is taken. Further columns pass through
under any name; one of a type that Spark cannot hash, a map, raises in the near-duplicate stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import compression_classifier, decontaminate, mixing, sharding, simhash
from millrace.llm.common import BROADCAST_ROWS, HOT_ROWS, join_unique, left_join_unique, materialize, table
from millrace.llm.registry import held_out

#: The stages score and match texts by compression and by hashes that DuckDB does not have.
ORACLE_SQL: str | None = None


def _wrapped(docs: DataFrame) -> DataFrame:
    """text, and all other columns in one struct, so that no name of theirs clashes with one of a stage."""
    return docs.select("text", F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("_rest"))


def _unwrapped(wrapped: DataFrame, docs: DataFrame) -> DataFrame:
    return wrapped.select(*[F.col("text") if c == "text" else F.col("_rest").getField(c).alias(c) for c in docs.columns])


def _keyed(docs: DataFrame) -> DataFrame:
    """Wrapped, with _row, of _id and a hash of the whole row: rows that agree in both are taken to be equal."""
    return _wrapped(docs).withColumn("_row", F.struct(F.col("_rest.doc_id").alias("_id"), F.xxhash64("text", "_rest").alias("_key")))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier, trained as in its query, rejects go. All stay if the labels that it
    may learn from give it no curve, as where one class has none: such a model tells no document from another."""
    model = compression_classifier.train(docs, table(spark, sf_dir, "labels").where(~held_out()))
    if model.slope == 0:
        return docs
    return _unwrapped(compression_classifier.score(_wrapped(docs), model).where("predicted = 1"), docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: the one of least doc_id, null being the least, of equal rows any.

    What goes is told by id and row hash: up to a checked size this is broadcast and no text is shuffled; beyond it, rows
    equal in both that are very many are still judged where they are. Only rows that stay and stand there several times,
    equal in all columns, are grouped to leave one, the first of each task before the shuffle."""
    keyed = _keyed(docs)
    found = simhash.near_duplicates(keyed.select("_row._id", "text", "_row"), "_id")
    rows = materialize(found.groupBy("root", "_row").agg(F.count("*").alias("_n")), "rows")
    first = materialize(rows.groupBy("root").agg(F.min("_row").alias("_first")), "first")
    judged = join_unique(rows, first, "root", simhash.NARROW_ROWS).select("_row", "_n", (F.col("_row") == F.col("_first")).alias("_stays"))
    judged = materialize(judged.where("not _stays or _n > 1"), "judged")
    met = left_join_unique(keyed, judged.select("_row", "_stays"), "_row", BROADCAST_ROWS, HOT_ROWS)
    kept = met.where("_stays is null")
    if not judged.where("_stays").isEmpty():
        kept = kept.unionByName(met.where("_stays").dropDuplicates(["_row"]))
    return _unwrapped(kept, docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a benchmark item go."""
    found = decontaminate.find_contamination(_wrapped(docs), table(spark, sf_dir, "benchmark"))
    return _unwrapped(found.where(F.size("matches") == 0), docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it. No text is shuffled, nor is a row joined but to its class's row."""
    wrapped = _wrapped(docs).withColumns({"_id": F.col("_rest.doc_id"), "_source": F.col("_rest.source")})
    taken = mixing.mix(wrapped, "_id", source_col="_source", keep_text=True).where("copies > 0")
    return _unwrapped(taken.withColumn("_n", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))), docs)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The shard and slot of every row."""
    return sharding.shard(docs.select("doc_id", "text"))


STAGES = [
    ("quality classifier", quality),
    ("SimHash near-dedup", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("mixing sources to target weights", mix),
    ("sharding", shards),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents, each one's result written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
