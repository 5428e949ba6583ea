"""Quality classifier: ordinal cumulative-link regression on hashed text.

P(grade > j) = sigmoid(w . x - threshold_j): one weight vector for all grades and
ordered thresholds between them give an expected grade and tail probabilities.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packetrisk.llm.textops import WordHashes, alnum_words, column, hash_words, list_array, slices, to_bytes

#: Hashed features: byte trigrams in the first half, words in the second.
DIMENSIONS = 1 << 14
#: Graded rows that fit the model: those of the smallest hash of their id.
TRAINING_ROWS = 6_000


def hashed_features(texts: list[bytes], cache: WordHashes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sparse rows (feature, value, entries per text): square roots of counts, each half at unit length."""
    half = DIMENSIONS // 2
    hashes, bounds = hash_words([alnum_words(t) for t in texts], cache)
    words = half + (hashes >> np.uint64(64 - 13)).astype(np.int64) % half
    index, value, sizes = [], [], []
    for t, a, b in zip(texts, bounds[:-1].tolist(), bounds[1:].tolist()):
        raw = np.frombuffer(t, dtype=np.uint8).astype(np.uint32)
        grams = ((raw[:-2] * 65599 + raw[1:-1]) * 65599 + raw[2:]) * np.uint32(2654435761) >> np.uint32(32 - 13) if len(raw) > 2 else raw[:0]
        total = 0
        for part, begin in ((np.bincount(grams % half, minlength=half) if len(grams) else None, 0), (np.bincount(words[a:b] - half, minlength=half) if b > a else None, half)):
            if part is not None:
                at = np.flatnonzero(part)
                v = np.sqrt(part[at])
                index.append(at + begin)
                value.append(v / np.sqrt((v * v).sum()))
                total += len(at)
        sizes.append(total)
    empty = np.empty(0)
    return (np.concatenate(index) if index else empty.astype(np.int64)), (np.concatenate(value) if value else empty), np.array(sizes, dtype=np.int64)


def _row_sums(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    total = np.append(0.0, np.cumsum(values))
    edge = np.append(0, np.cumsum(sizes))
    return total[edge[1:]] - total[edge[:-1]]


def fit_cumulative_link(index: np.ndarray, value: np.ndarray, sizes: np.ndarray, grade: np.ndarray, grades: int, steps: int = 150, rate: float = 0.5, ridge: float = 1e-5) -> tuple[np.ndarray, np.ndarray]:
    """(weights, ordered thresholds) by full-batch gradient steps with per-weight rates.

    Thresholds are the first one plus exponentials, so they stay ordered.
    """
    w = np.zeros(DIMENSIONS)
    share = np.array([(grade > j).mean() for j in range(grades - 1)]).clip(1e-3, 1 - 1e-3)
    start = np.maximum.accumulate(-np.log(share / (1 - share)) + 1e-3 * np.arange(grades - 1))
    theta = np.append(start[:1], np.log(np.maximum(np.diff(start), 1e-3)))
    seen_w, seen_t = np.full(DIMENSIONS, 1e-8), np.full(len(theta), 1e-8)
    for _ in range(steps):
        cuts = np.append(theta[:1], theta[0] + np.cumsum(np.exp(theta[1:])))
        tail = 1 / (1 + np.exp(-np.clip(_row_sums(value * w[index], sizes)[:, None] - cuts[None, :], -30, 30)))
        padded = np.column_stack([np.ones(len(grade)), tail, np.zeros(len(grade))])
        row = np.arange(len(grade))
        p = np.maximum(padded[row, grade] - padded[row, grade + 1], 1e-9)
        slope = tail * (1 - tail)
        lower = np.where(grade[:, None] == np.arange(1, grades)[None, :], slope, 0.0)  # the tail that opens the grade
        upper = np.where(grade[:, None] == np.arange(grades - 1)[None, :], slope, 0.0)
        push = (lower - upper) / p[:, None] / len(grade)
        grad_w = -np.bincount(index, value * np.repeat(push.sum(axis=1), sizes), DIMENSIONS) + ridge * w
        per_cut = push.sum(axis=0)
        rest = np.cumsum(per_cut[::-1])[::-1]
        grad_t = np.append(rest[:1], rest[1:] * np.exp(theta[1:]))
        seen_w += grad_w * grad_w
        seen_t += grad_t * grad_t
        w -= rate * grad_w / np.sqrt(seen_w)
        theta -= 0.1 * grad_t / np.sqrt(seen_t)
    return w, np.append(theta[:1], theta[0] + np.cumsum(np.exp(theta[1:])))


def _training_table(rows: DataFrame, graded: DataFrame, limit: int) -> pa.Table:
    chosen = graded.orderBy(F.xxhash64("__id"), "__id").limit(limit)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHashes()
        for whole in batches:
            for batch in slices(whole, "__text"):
                index, value, sizes = hashed_features(to_bytes(column(batch, "__text")), cache)
                yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), column(batch, "__grade"), list_array(index.astype(np.int32), sizes, pa.int32()), list_array(value.astype(np.float32), sizes, pa.float32())], names=["doc_id", "grade", "i", "v"])

    joined = rows.join(F.broadcast(chosen), F.col("doc_id") == F.col("__id")).select("doc_id", "__grade", "__text")
    return joined.mapInArrow(run, "doc_id long, grade int, i array<int>, v array<float>").toArrow().sort_by("doc_id")


def grade_quality(docs: DataFrame, ratings: DataFrame, id_col: str = "doc_id", text: str = "text", grade: str = "grade", grades: int = 3, select_above: int = 0, training_rows: int = TRAINING_ROWS) -> DataFrame:
    """One row per row of docs: doc_id, held_out, expected_grade, tail probabilities, grade and kept.

    ``ratings`` has grades 0 .. grades - 1.  Rows with crc32(id as text) mod 5 = 0 never train.
    ``kept``: P(grade > select_above) >= 0.5.  A null or empty text has no features and gets the
    thresholds' own probabilities; a null or out-of-range grade is no rating; of repeated ratings the
    largest holds; without ratings of two grades every probability is 0.5.  A null id is scored and
    takes no rating; repeated rows repeat; other columns are ignored; an empty table gives no rows.
    """
    crc = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("__text"))
    graded = ratings.where(F.col(grade).between(0, grades - 1)).groupBy(F.col(id_col).cast("long").alias("__id")).agg(F.max(F.col(grade).cast("int")).alias("__grade"))
    graded = graded.where((F.crc32(F.col("__id").cast("string")) % 5 != 0) & F.col("__id").isNotNull())
    table = _training_table(rows, graded, training_rows)
    y = table.column("grade").to_numpy()
    weights, cuts = np.zeros(DIMENSIONS), np.zeros(grades - 1)
    if len(np.unique(y)) > 1:
        i, v = (table.column(c).combine_chunks() for c in ("i", "v"))
        sizes = np.diff(i.offsets.to_numpy())
        weights, cuts = fit_cumulative_link(i.flatten().to_numpy().astype(np.int64), v.flatten().to_numpy().astype(np.float64), sizes, y.astype(np.int64), grades)
    shared = rows.sparkSession.sparkContext.broadcast((weights, cuts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, (weights, cuts) = WordHashes(), shared.value
        for whole in batches:
            for batch in slices(whole, "__text"):
                index, value, sizes = hashed_features(to_bytes(column(batch, "__text")), cache)
                tail = 1 / (1 + np.exp(-np.clip(_row_sums(value * weights[index], sizes)[:, None] - cuts[None, :], -30, 30)))
                yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), list_array(tail.ravel(), np.full(len(tail), tail.shape[1]), pa.float64())], names=["doc_id", "tails"])

    scored = rows.mapInArrow(run, "doc_id long, tails array<double>")
    expected = F.aggregate("tails", F.lit(0.0), lambda s, x: s + x)
    above = F.size(F.filter("tails", lambda x: x >= 0.5))
    return scored.select("doc_id", (crc % 5 == 0).alias("held_out"), expected.alias("expected_grade"), *(F.col("tails")[j].alias(f"p_above_{j}") for j in range(grades - 1)), above.cast("int").alias("grade"), (F.col("tails")[select_above] >= 0.5).alias("kept"))


def op1_cumulative_link(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grades: 0 low quality, 1 good but toxic, 2 good."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    grade = F.when(F.col("quality") == 0, 0).when(F.col("toxic") == 1, 1).when(F.col("quality") == 1, 2)
    return grade_quality(spark.read.parquet(f"{sf_dir}/documents.parquet"), labels.select("doc_id", grade.alias("grade")))
