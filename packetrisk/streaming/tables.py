"""A table that a stream keeps: rows by key, the last one counts.

Every micro-batch adds a small folder of its changed rows; every so many batches these are put together with the table so far into
a new base of few files.  A manifest per batch names the folders that make up the table.  A batch that runs again starts
from the manifest before it and writes the same folders anew; what no manifest in use names is deleted, so the number of files
is bounded however long the stream runs.
"""

from __future__ import annotations

import json
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


class KeptTable:
    """Rows of ``schema`` by ``key`` in ``folder``, compacted every ``every`` batches; a folder has ``files`` files at most.

    Of the rows of a key the one of the largest ``order`` columns counts, then the one of the last batch.
    """

    def __init__(self, spark: SparkSession, folder: str, schema: StructType, key: str, order: tuple[str, ...] = (), every: int = 10, files: int = 4):
        self.spark, self.folder, self.schema, self.key, self.order, self.every, self.files = spark, folder, schema, key, order, every, files

    def _path(self, name: str = ""):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}" if name else self.folder)
        return path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _names(self, folder: str) -> list[str]:
        path, system = self._path(folder)
        return [x.getPath().getName() for x in system.listStatus(path)] if system.exists(path) else []

    def _manifest(self, before: int | None = None) -> tuple[int, list[str]]:
        """Number and folders of the last manifest (of a batch below ``before``)."""
        numbers = [int(n) for n in self._names("manifest") if n.isdigit() and (before is None or int(n) < before)]
        if not numbers:
            return -1, []
        text = self.spark.read.option("wholetext", True).text(f"{self.folder}/manifest/{max(numbers)}").first()[0]
        return max(numbers), json.loads(text)

    def _commit(self, number: int, folders: list[str]) -> None:
        """The manifest appears whole, by a rename."""
        draft, system = self._path(f"manifest/_draft-{number}")
        out = system.create(draft, True)
        out.write(bytearray(json.dumps(folders).encode()))
        out.close()
        final, _ = self._path(f"manifest/{number}")
        system.delete(final, True)
        if not system.rename(draft, final):
            raise OSError(f"cannot write {final}")

    def _last(self, folders: list[str]) -> DataFrame:
        rows = self.spark.read.schema(StructType(list(self.schema)).add("__batch", "long")).parquet(*(f"{self.folder}/{f}" for f in folders))
        rest = [c for c in rows.columns if c != self.key]
        return rows.groupBy(self.key).agg(F.max_by(F.struct(*rest), F.struct(*self.order, "__batch")).alias("last")).select(self.key, "last.*")

    def update(self, batch: DataFrame, number: int) -> None:
        """Take in the rows of a batch; without ``order`` at most one row of a key in it."""
        _, folders = self._manifest(number)
        folders = [*folders, f"changes/{number}"]
        batch.select(*self.schema.names).withColumn("__batch", F.lit(number).cast("long")).repartition(self.files, self.key).write.mode("overwrite").parquet(f"{self.folder}/{folders[-1]}")
        if len(folders) > self.every:
            base = f"base/{number}"
            self._last(folders).repartition(self.files, self.key).write.mode("overwrite").parquet(f"{self.folder}/{base}")
            folders = [base]
        self._commit(number, folders)
        self._clean(number)

    def _clean(self, number: int) -> None:
        """Delete what neither this manifest nor the one before it (which a second run of this batch reads) names."""
        numbers = sorted(int(n) for n in self._names("manifest") if n.isdigit() and int(n) <= number)
        used = {f for n in numbers[-2:] for f in self._manifest(n + 1)[1]}
        for kind in ("changes", "base"):
            for name in self._names(kind):
                if f"{kind}/{name}" not in used:
                    path, system = self._path(f"{kind}/{name}")
                    system.delete(path, True)
        for n in numbers[:-2]:
            path, system = self._path(f"manifest/{n}")
            system.delete(path, True)

    def read(self) -> DataFrame:
        """The table as of the last batch taken in; empty before the first."""
        _, folders = self._manifest()
        return self._last(folders).drop("__batch").select(*self.schema.names) if folders else self.spark.createDataFrame([], self.schema)
