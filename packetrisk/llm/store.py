"""Shared-folder tables and size checks for the corpus operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of 64-bit ids that may be broadcast (about 100 MB as a hash relation); beyond it joins shuffle.
BROADCAST_IDS = 1_000_000

#: Settings that hold while a table is written: Arrow batches small enough for a Python worker whatever the texts,
#: and shuffle files of the write removed with its end (the table is then the only copy that is needed).
WRITING = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
    "spark.sql.execution.arrow.maxBytesPerBatch": "8m",
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
}


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Session settings that hold inside the block only."""
    before = {k: spark.conf.get(k, None) for k in values}
    try:
        for k, v in values.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a temporary one only on a local master, an error on a cluster without one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    known = spark.sparkContext._jsc.sc().getCheckpointDir()
    if known.isDefined():
        return known.get()
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="corpus-")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def _file_system(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def stored(df: DataFrame, by: str | None = None) -> DataFrame:
    """Write ``df`` once to the shared folder (in folders by the values of ``by``) and read it back: lineage is cut, and lost executors lose nothing."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    with settings(spark, WRITING):
        df.write.option("compression", "zstd").partitionBy(*([by] if by else [])).parquet(path)
    target, system = _file_system(spark, path)
    system.deleteOnExit(target)
    out = spark.read.schema(df.schema).parquet(path)
    out._corpus_path = path
    return out


def discard(*tables: DataFrame | None) -> None:
    """Delete tables of ``stored`` that no result reads any more."""
    for table in tables:
        path = getattr(table, "_corpus_path", None) if table is not None else None
        if path:
            target, system = _file_system(table.sparkSession, path)
            system.delete(target, True)


def _plain(value):
    """An object as (class name, fields), what it holds likewise; arrays, numbers and texts stay as they are."""
    if isinstance(value, (list, tuple, dict)):
        parts = value.items() if isinstance(value, dict) else enumerate(value)
        return type(value).__name__, {k: _plain(v) for k, v in parts}
    return (type(value).__name__, {k: _plain(v) for k, v in vars(value).items()}) if hasattr(value, "__dict__") else ("", value)


def shared_object(spark: SparkSession, value):
    """Broadcast of an object of this package as plain arrays, for workers that cannot import the package; ``loaded`` reads it."""
    return spark.sparkContext.broadcast(_plain(value))


def loaded(state, *classes: type):
    """The object of a broadcast's value, its arrays not copied; ``classes`` are those of the package in it."""
    name, held = state
    if not name:
        return held
    fields = {k: loaded(v, *classes) for k, v in held.items()}
    if name in ("list", "tuple"):
        return (list if name == "list" else tuple)(fields.values())
    if name == "dict":
        return fields
    kind = next(c for c in classes if c.__name__ == name)
    made = kind.__new__(kind)
    made.__dict__.update(fields)
    return made


def small(ids: DataFrame, limit: int = BROADCAST_IDS) -> bool:
    """Whether ``ids`` has at most ``limit`` rows (counted, not estimated)."""
    return ids.count() <= limit


def matching(df: DataFrame, ids: DataFrame, key: str, keep: bool = True, limit: int = BROADCAST_IDS) -> DataFrame:
    """Rows of ``df`` whose key is (or is not) among ``ids``: a map-side filter while ids are few, else a shuffled join."""
    side = ids.select(F.col(key).alias("__key")).distinct()
    side = F.broadcast(side) if small(ids, limit) else side
    return df.join(side, F.col(key).eqNullSafe(F.col("__key")), "left_semi" if keep else "left_anti")


def pieces(df: DataFrame, text: str, each: int, least: int = 12) -> int:
    """Number of partitions that keeps each near ``each`` bytes of text at any size of input (one pass over the lengths)."""
    size = df.agg(F.sum(F.octet_length(text))).first()[0] or 0
    return max(least, -(-size // each))
