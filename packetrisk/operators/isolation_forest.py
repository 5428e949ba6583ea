"""Isolation forest (Liu, Ting, Zhou, ICDM 2008): trees grown in Spark tasks, stored as a table, applied in Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from packetrisk.functions.features import FEATURES

TREES = "tree int, node int, feature int, cut double, low int, high int, size int"


def average_path(n: np.ndarray | float) -> np.ndarray:
    """Mean depth of an unsuccessful search among n rows: 2 H(n - 1) - 2 (n - 1) / n."""
    n = np.asarray(n, dtype=float)
    harmonic = np.log(np.maximum(n - 1, 1)) + 0.5772156649015329
    return np.where(n > 2, 2 * harmonic - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))


def grow_tree(rows: np.ndarray, rng: np.random.Generator, depth: int) -> list[tuple[int, float, int, int, int]]:
    """Nodes (feature, cut, low child, high child, size); a leaf has feature -1."""
    nodes: list = []

    def grow(part: np.ndarray, left: int) -> int:
        at = len(nodes)
        nodes.append(None)
        usable = np.flatnonzero(part.max(axis=0) > part.min(axis=0)) if len(part) > 1 and left else np.empty(0, int)
        if not len(usable):
            nodes[at] = (-1, 0.0, -1, -1, len(part))
            return at
        f = int(rng.choice(usable))
        cut = float(rng.uniform(part[:, f].min(), part[:, f].max()))
        below = part[:, f] <= cut
        nodes[at] = (f, cut, grow(part[below], left - 1), grow(part[~below], left - 1), len(part))
        return at

    grow(rows, depth)
    return nodes


@dataclass
class Forest:
    """Trees as one table of flat arrays, the sample size of a tree, and the score from which a row is an outlier."""

    trees: pd.DataFrame
    sample: int
    threshold: float

    def arrays(self) -> list[tuple[np.ndarray, ...]]:
        """(feature, cut, low, high, size) of each tree's nodes, made once."""
        if not hasattr(self, "_arrays"):
            ordered = self.trees.sort_values(["tree", "node"])
            self._arrays = [tuple(tree[c].to_numpy() for c in ("feature", "cut", "low", "high", "size")) for _, tree in ordered.groupby("tree", sort=True)]
        return self._arrays

    def scores(self, rows: np.ndarray) -> np.ndarray:
        return path_scores(self.arrays(), self.sample, rows)


def path_scores(trees: list[tuple[np.ndarray, ...]], sample: int, rows: np.ndarray) -> np.ndarray:
    """2 ** (-mean depth / average path); all rows go down a tree level by level."""
    depth = np.zeros(len(rows))
    for feature, cut, low, high, size in trees:
        at = np.zeros(len(rows), dtype=int)
        while (inner := np.flatnonzero(feature[at] >= 0)).size:
            node = at[inner]
            at[inner] = np.where(rows[inner, feature[node]] <= cut[node], low[node], high[node])
            depth[inner] += 1
        depth += average_path(size[at])
    return 2.0 ** (-depth / max(1, len(trees)) / float(average_path(sample) or 1.0))


def quantile(df: DataFrame, value: str, p: float, most: int = 100_000) -> float:
    """Interpolated quantile of values in [0, 1], exact at any size: ranges of values are counted and narrowed to at most ``most`` distinct values."""
    counts = df.groupBy(F.col(value).alias("v")).agg(F.count("*").alias("c")).persist()
    n = counts.agg(F.sum("c")).first()[0]
    position = (n - 1) * p

    def ranked(rank: int) -> float:
        part, bits = counts, 0
        while part.count() > most and bits < 48:
            bits += 16
            cell = F.floor(F.col("v") * float(1 << bits))
            sizes = part.groupBy(cell.alias("cell")).agg(F.sum("c").alias("c")).toPandas().sort_values("cell")  # at most 2**16 + 1 rows
            ends = np.cumsum(sizes["c"].to_numpy())
            at = int(np.searchsorted(ends, rank, side="right"))
            rank -= int(ends[at - 1]) if at else 0
            part = part.where(cell == int(sizes["cell"].iloc[at]))
        rows = part.toPandas().sort_values("v")
        return float(rows["v"].iloc[int(np.searchsorted(np.cumsum(rows["c"].to_numpy()), rank, side="right"))])

    lower, higher = int(np.floor(position)), int(np.ceil(position))
    low = ranked(lower)
    high = low if lower == higher else ranked(higher)
    counts.unpersist()
    return low if low == high else (higher - position) * low + (position - lower) * high


#: Tasks that put together what the first tasks have chosen for a tree, before the last one.
MERGES = 64
CHOSEN = "tree int, h long, " + ", ".join(f"{c} double" for c in FEATURES)


class Smallest:
    """For every tree the rows of the smallest hashes met so far, at most twice as many as wanted."""

    def __init__(self, most: int):
        self.most, self.parts = most, {}

    def add(self, tree: int, h: np.ndarray, rows: np.ndarray) -> None:
        limit, parts = self.parts.setdefault(tree, (np.iinfo(np.int64).max, []))
        near = h <= limit
        if near.any():
            parts.append((h[near], rows[near]))
            if sum(len(p[0]) for p in parts) >= 2 * self.most:
                h, rows = self.chosen(tree)
                self.parts[tree] = (h[-1] if len(h) == self.most else limit, [(h, rows)])

    def chosen(self, tree: int) -> tuple[np.ndarray, np.ndarray]:
        """In order of hash, equal hashes (equal keys) in order of the rows."""
        h, rows = (np.concatenate(x) for x in zip(*self.parts[tree][1]))
        order = np.lexsort([*rows.T[::-1], h])[: self.most]
        return h[order], rows[order]

    def batches(self) -> Iterator[pa.RecordBatch]:
        for tree in self.parts:
            h, rows = self.chosen(tree)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(h), tree, np.int32)), pa.array(h), *(pa.array(np.ascontiguousarray(c)) for c in rows.T)], names=["tree", "h", *FEATURES])


def samples(training: DataFrame, key: str, trees: int, seed: int, sample: int) -> DataFrame:
    """(tree, h, features): for each tree at least the ``sample`` rows of the smallest hash of (key, tree), from one pass over the rows.

    Every task keeps the smallest of its rows for all trees, and these are put together in two steps: no task reads more than a
    bounded number of rows for a tree from each of those before it.
    """
    rows = training.select(F.xxhash64(F.col(key), F.lit(seed)).alias("h"), *(F.col(c).cast("double").alias(c) for c in FEATURES))
    matrix = lambda batch: np.column_stack([batch.column(c).to_numpy() for c in FEATURES])

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        smallest = Smallest(sample)
        for batch in batches:
            h, values = batch.column("h").to_numpy().view(np.uint64), matrix(batch)
            for tree in range(trees):
                x = (h ^ np.uint64((tree + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) * np.uint64(0xFF51AFD7ED558CCD)
                x ^= x >> np.uint64(32)
                x *= np.uint64(0xC4CEB9FE1A85EC53)
                smallest.add(tree, (x >> np.uint64(1)).view(np.int64), values)
        yield from smallest.batches()

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        smallest = Smallest(sample)
        for batch in batches:
            tree, h, values = batch.column("tree").to_numpy(), batch.column("h").to_numpy(), matrix(batch)
            for t in np.unique(tree).tolist():
                smallest.add(t, h[tree == t], values[tree == t])
        yield from smallest.batches()

    chosen = rows.mapInArrow(first, CHOSEN).withColumn("__part", F.spark_partition_id() % MERGES)
    return chosen.repartition("tree", "__part").drop("__part").mapInArrow(again, CHOSEN)


def train_forest(training: DataFrame, key: str, trees: int = 100, contamination: float = 0.05, seed: int = 42, sample: int = 256) -> Forest:
    """Each tree takes the ``sample`` rows of the smallest hash of (key, tree): the same rows however the table is partitioned."""
    names = FEATURES

    def build(rows: pd.DataFrame) -> pd.DataFrame:
        tree = int(rows["tree"].iloc[0])
        chosen = rows.sort_values(["h", *names])[names].to_numpy(float)[:sample]
        depth = max(1, int(np.ceil(np.log2(max(len(chosen), 2)))))
        nodes = grow_tree(chosen, np.random.default_rng([seed, tree]), depth)
        out = pd.DataFrame(nodes, columns=["feature", "cut", "low", "high", "size"])
        return out.assign(tree=tree, node=range(len(out)))[["tree", "node", "feature", "cut", "low", "high", "size"]]

    # at most MERGES * sample rows of a tree come together, and trees * 2 * sample nodes
    grown = samples(training, key, trees, seed, sample).groupBy("tree").applyInPandas(build, TREES).toPandas()
    forest = Forest(grown, int(grown["size"].max()), 0.5)
    forest.threshold = quantile(score(training, forest).select("anomaly_score"), "anomaly_score", 1 - contamination)
    return forest


def score(df: DataFrame, forest: Forest | None, features: list[Column] | None = None) -> DataFrame:
    """``df`` with anomaly_score, decision (threshold - score) and is_anomaly; without a forest (0, false).

    ``features``: the normalised features, where they are not columns of ``df``.
    """
    if forest is None:
        return df.withColumns({"anomaly_score": F.lit(0.0), "decision": F.lit(0.0), "is_anomaly": F.lit(False)})
    # a fixed number of small trees, as plain arrays: workers need no class of this package to read them
    shared = df.sparkSession.sparkContext.broadcast((forest.arrays(), forest.sample))

    @F.pandas_udf("double")
    def run(parts: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        trees, sample = shared.value
        for part in parts:
            yield pd.Series(path_scores(trees, sample, np.column_stack([p.to_numpy(float) for p in part])))

    out = df.withColumn("anomaly_score", run(*(features or FEATURES)))
    decision = F.lit(forest.threshold) - F.col("anomaly_score")
    return out.withColumn("decision", decision).withColumn("is_anomaly", F.col("decision") < 0)


def save_forest(spark: SparkSession, forest: Forest, path: str) -> None:
    spark.createDataFrame(forest.trees, TREES).write.mode("overwrite").parquet(f"{path}/trees")
    spark.createDataFrame([(forest.sample, forest.threshold)], "sample int, threshold double").write.mode("overwrite").parquet(f"{path}/about")


def load_forest(spark: SparkSession, path: str) -> Forest:
    about = spark.read.parquet(f"{path}/about").first()
    return Forest(spark.read.parquet(f"{path}/trees").toPandas(), about["sample"], about["threshold"])
