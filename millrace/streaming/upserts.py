"""A table of the latest row of each key, kept up by batches of changes that may come twice or break off."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class UpsertTable:
    """A folder of change files and of commits, each of which names the files of a batch.

    A batch is written to files of its own and published by creating its commit, an empty file whose name tells what is
    in it; files without a commit are never read. So a batch that is replayed, or whose first attempts broke off, counts
    once. Reading takes the row of the largest version of each key among the published ones: no batch rewrites another's
    files. compact() writes that as one commit and so bounds what a reader has to go through. Batches are written by one
    query at a time, as Spark's checkpoints have it, and their ids increase.
    """

    def __init__(self, spark: SparkSession, path: str, keys: list[str], version: str, deleted: str | None = None) -> None:
        """keys: the columns of a key; version: a column that is larger in later changes of a key; deleted: one that is
        true in a change that removes the key."""
        self.spark, self.path, self.keys, self.version, self.deleted = spark, path.rstrip("/"), keys, version, deleted
        self._fs_path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._fs_path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _published(self) -> list[tuple[int, bool, str]]:
        """(batch id, whether it holds all before, folder) of every commit, oldest first."""
        folder = self._fs_path(f"{self.path}/commits")
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)] if self._fs.exists(folder) else []
        found = (re.fullmatch(r"(\d+)\.(all|own)\.([0-9a-f]{32})", n) for n in names)
        return sorted((int(m[1]), m[2] == "all", m[3]) for m in found if m)

    def _commits(self) -> list[tuple[int, bool, str]]:
        """Those of them that a reader needs: of a batch that two attempts have published, one."""
        found = self._published()
        whole = max((c for c in found if c[1]), default=(-1, True, ""))
        own = {batch_id: (batch_id, False, folder) for batch_id, of_all, folder in found if not of_all and batch_id > whole[0]}
        return [*([whole] if whole[2] else []), *own.values()]

    def _latest(self, rows: DataFrame) -> DataFrame:
        """One row of each key. Of equal versions the one of the largest values counts, whatever the order of batches."""
        rest = [c for c in rows.columns if c not in self.keys]
        last = rows.groupBy(*self.keys).agg(F.max(F.struct(F.col(self.version).alias("_v"), *[F.col(c) for c in rest])).alias("_last"))
        return last.select(*[F.col(c) if c in self.keys else F.col("_last")[c].alias(c) for c in rows.columns])

    def write(self, changes: DataFrame, batch_id: int) -> bool:
        """Applies a batch; for foreachBatch. False, and nothing done, if its batch_id has been applied before."""
        if any(c[0] == batch_id and not c[1] for c in self._published()):
            return False
        folder = uuid.uuid4().hex
        self._latest(changes).write.parquet(f"{self.path}/data/{folder}")
        # All that a commit says is in its name: it is there as a whole or not at all.
        self._commit(batch_id, "own", folder)
        return True

    def _commit(self, batch_id: int, kind: str, folder: str) -> None:
        self._fs.create(self._fs_path(f"{self.path}/commits/{batch_id}.{kind}.{folder}"), False).close()

    def read(self) -> DataFrame | None:
        """The latest row of each key that is not deleted; None before the first batch."""
        rows = self._changes()
        if rows is None:
            return None
        latest = self._latest(rows)
        return latest if self.deleted is None else latest.where(~F.coalesce(F.col(self.deleted), F.lit(False)))

    def _changes(self) -> DataFrame | None:
        folders = [f"{self.path}/data/{folder}" for _, _, folder in self._commits()]
        return self.spark.read.parquet(*folders) if folders else None

    def compact(self) -> None:
        """Puts the latest changes, deletions too, in one commit of all batches so far; a late change of an old version
        still loses. Readers that have begun keep the files they know; `clear` deletes what no commit needs."""
        commits = self._commits()
        if len(commits) < 2:
            return
        folder = uuid.uuid4().hex
        self._latest(self._changes()).write.parquet(f"{self.path}/data/{folder}")
        self._commit(commits[-1][0], "all", folder)

    def clear(self) -> None:
        """Deletes the files of attempts that broke off and of batches that compact() has taken in. Not while a batch is
        being written, nor while a reader may still go through older files."""
        needed = {folder for _, _, folder in self._commits()}
        for status in self._fs.listStatus(self._fs_path(f"{self.path}/data")):
            if status.getPath().getName() not in needed:
                self._fs.delete(status.getPath(), True)
