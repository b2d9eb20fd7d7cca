"""Tables by name and by format. A table is a file or a folder of files, in whatever store Spark can read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

FORMATS = ("parquet", "orc", "json", "csv", "text")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table `name` of a data folder."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def read(spark: SparkSession, path: str, fmt: str = "parquet", schema: str | None = None, **options: str) -> DataFrame:
    """A table in one of FORMATS. CSV and JSON need a schema, so that no pass over the data goes to guessing one, and
    malformed rows fail rather than turn into nulls."""
    _known(fmt)
    if fmt in ("csv", "json"):
        if schema is None:
            raise ValueError(f"{fmt} needs a schema")
        options = {"mode": "FAILFAST", "header": "true"} | options
    reader = spark.read.format(fmt).options(**options)
    return (reader.schema(schema) if schema else reader).load(path)


def write(df: DataFrame, path: str, fmt: str = "parquet", partition_by: list[str] | None = None, mode: str = "error", rows_per_file: int = 0, **options: str) -> None:
    """Writes df in one of FORMATS, in folders by the values of partition_by, each task what it has of each value: no
    shuffle, and no value's rows go through one task."""
    _known(fmt)
    if fmt == "csv":
        options = {"header": "true"} | options
    if rows_per_file:
        options = {"maxRecordsPerFile": str(rows_per_file)} | options
    df.write.format(fmt).options(**options).mode(mode).partitionBy(*(partition_by or [])).save(path)


def write_bucketed(df: DataFrame, name: str, keys: list[str], buckets: int, mode: str = "error") -> None:
    """A table of the catalog in buckets of keys, sorted within: joins and groupings by the keys then need no shuffle."""
    df.write.bucketBy(buckets, *keys).sortBy(*keys).mode(mode).saveAsTable(name)


def _known(fmt: str) -> None:
    if fmt not in FORMATS:
        raise ValueError(f"{fmt} is none of {', '.join(FORMATS)}")
