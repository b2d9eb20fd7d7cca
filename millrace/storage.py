"""Tables in storage that driver and executors share, and broadcasts behind a check of size."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side of a join goes to all executors only if it has at most so many rows and so many bytes, written as JSON.
BROADCAST_ROWS, BROADCAST_BYTES = 1_000_000, 32_000_000

_own_dirs: dict[str, str] = {}


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
    return df.sparkSession.read.schema(df.schema).parquet(path)


def is_small(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> bool:
    """Whether df has at most so many rows and bytes (its rows as JSON); both are counted in place."""
    if not df.columns:
        return True
    n, total = df.agg(F.count("*"), F.sum(F.octet_length(F.to_json(F.struct(*[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(df.columns)]))))).first()
    return n <= rows and (total or 0) <= size


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> DataFrame:
    """df, marked for broadcast if it is small; else unmarked, for a shuffled join."""
    return F.broadcast(df) if is_small(df, rows, size) else df
