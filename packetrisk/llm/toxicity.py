"""Toxicity by class-conditional Kneser-Ney models.

One symbol model of toxic and one of ordinary texts share their backoff counts, so a
rare expression says little for either; counting symbols rather than words also covers
inflected and compounded expressions.  The length-normalised difference of the two
log-likelihoods is mapped to a probability by a logistic curve.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from packetrisk.llm.kneser_ney import ClassModel, SharedOrders, SymbolModel, discounts_of
from packetrisk.llm.store import BROADCAST_IDS, loaded, shared_object, small, stored
from packetrisk.llm.symbols import BITS, symbol_grams
from packetrisk.llm.textops import column, slices, to_bytes

#: Orders counted per class go from SHARED + 1 to ORDER; lower ones are shared.
ORDER, SHARED = 5, 2
#: Distinct n-grams of the model that a task holds at once (24 MB); a larger model is applied in several pieces, to the same scores.
MODEL_GRAMS = 2_000_000
#: Labelled rows of the calibration fold that fit the logistic curve.
CALIBRATION_ROWS = 50_000


def class_counts(rows: DataFrame) -> DataFrame:
    """(code, plain, toxic): n-gram counts by class of (__text, __toxic), summed inside tasks, then by Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for whole in batches:
            for batch in slices(whole, "__text"):
                codes, bounds = symbol_grams(to_bytes(column(batch, "__text")), ORDER)
                toxic = np.repeat(np.array(column(batch, "__toxic").to_pylist(), dtype=bool), np.diff(bounds))
                key, where = np.unique(codes, return_inverse=True)
                held.append((key, np.bincount(where[~toxic], minlength=len(key)), np.bincount(where[toxic], minlength=len(key))))
                if len(held) == 8:
                    key, where = np.unique(np.concatenate([h[0] for h in held]), return_inverse=True)
                    held[:] = [(key, *(np.bincount(where, np.concatenate([h[i] for h in held]), len(key)) for i in (1, 2)))]
        for key, plain, toxic in held:
            yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in (key, plain, toxic)], names=["code", "plain", "toxic"])

    return rows.mapInArrow(run, "code long, plain long, toxic long").groupBy("code").agg(F.sum("plain").alias("plain"), F.sum("toxic").alias("toxic"))


def _mask(level: int) -> int:
    return (1 << (BITS * level)) - 1


def _piece(code, pieces: int):
    """Piece of an n-gram (a number, array or column), by its symbols without the first and the last."""
    middle = code.bitwiseAND(_mask(ORDER - 1)) if isinstance(code, Column) else code & _mask(ORDER - 1)
    middle = F.shiftright(middle, BITS) if isinstance(code, Column) else middle >> BITS
    return (middle * 40503 + 12345) % 65521 % pieces


class Models:
    """Both classes' models: all n-gram counts in a stored table, the lower orders on the driver, the rest piece by piece."""

    def __init__(self, counted: DataFrame, low: SharedOrders, pieces: int):
        self.counted, self.low, self.pieces, self.whole = counted, low, pieces, None

    def piece(self, i: int):
        """Broadcast model of the n-grams of piece ``i``."""
        if self.whole is not None:
            return self.whole
        rows = self.counted if self.pieces == 1 else self.counted.where(_piece(F.col("code"), self.pieces) == i)
        table = rows.toArrow()
        code, plain, toxic = (table.column(c).to_numpy() for c in ("code", "plain", "toxic"))
        order = np.argsort(code)
        model = ClassModel(code[order], np.column_stack([plain[order], toxic[order]]).astype(np.float64), ORDER, self.low)
        shared = shared_object(self.counted.sparkSession, model)
        if self.pieces == 1:
            self.whole = shared
        return shared


def train(rows: DataFrame) -> Models | None:
    """Fit the two models on (__text, __toxic), equal texts once (toxic if one of them is); None where one of the classes has no text.

    Every n-gram counts.  Discounts and the orders up to SHARED + 1 (2**18 n-grams by the size of the
    symbol set) are summed by Spark over all n-grams.
    """
    distinct = rows.groupBy("__text").agg(F.max("__toxic").alias("__toxic"))
    counted = stored(class_counts(distinct))
    both = [F.sum(c).alias(c) for c in ("plain", "toxic")]
    table = counted.groupBy(F.col("code").bitwiseAND(_mask(SHARED + 1)).alias("code")).agg(*both, F.count("*").alias("many")).toArrow()
    code, plain, toxic, many = (table.column(c).to_numpy() for c in ("code", "plain", "toxic", "many"))
    if not plain.sum() or not toxic.sum():
        return None
    tables = {}
    for level in range(SHARED + 2, ORDER + 1):
        grams = counted if level == ORDER else counted.groupBy(F.col("code").bitwiseAND(_mask(level)).alias("code")).agg(*both)
        seen = grams.agg(*(F.count_if(F.col(c) == i) for c in ("plain", "toxic") for i in range(1, 5))).first()
        tables[level] = discounts_of(list(seen[:4])), discounts_of(list(seen[4:]))
    order = np.argsort(code)
    low = SharedOrders(code[order], np.column_stack([plain[order], toxic[order]]).astype(np.float64), many[order], tables, BITS, SHARED)
    return Models(counted, low, max(1, -(-int(many.sum()) // MODEL_GRAMS)))


def evidence(rows: DataFrame, models: Models, keep: list[str]) -> DataFrame:
    """``keep`` columns, n (symbols of the text) and the mean log-likelihood difference over them.

    A model of several pieces passes over the texts once a piece; the pieces' sums are added by row.
    """
    if models.pieces == 1:
        return _sums(rows, models, 0, keep).withColumn("evidence", F.col("sum") / F.greatest("n", F.lit(1))).drop("sum")
    rows = stored(rows.select(*keep, "__text").withColumn("__row", F.monotonically_increasing_id()))
    parts = None
    for i in range(models.pieces):
        part = stored(_sums(rows, models, i, ["__row", *keep]))
        parts = part if parts is None else parts.union(part)
    added = parts.groupBy("__row", *keep, "n").agg(F.sum("sum").alias("sum"))
    return added.select(*keep, "n", (F.col("sum") / F.greatest("n", F.lit(1))).alias("evidence"))


def _sums(rows: DataFrame, models: Models, piece: int, keep: list[str]) -> DataFrame:
    """``keep`` columns, n and the summed log-likelihood difference of the n-grams of one piece."""
    shared, pieces = models.piece(piece), models.pieces

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = loaded(shared.value, ClassModel, SymbolModel)
        for whole in batches:
            for batch in slices(whole, "__text"):
                codes, bounds = symbol_grams(to_bytes(column(batch, "__text")), ORDER)
                n, codes = np.diff(bounds), codes.astype(np.int64)
                ratio = np.zeros(len(codes))
                here = slice(None) if pieces == 1 else np.flatnonzero(_piece(codes, pieces) == piece)
                ratio[here] = model.log_ratio(codes[here])
                sums, full = np.zeros(len(n)), np.flatnonzero(n)
                if len(full):
                    sums[full] = np.add.reduceat(ratio, bounds[full])
                yield pa.RecordBatch.from_arrays([*(column(batch, c) for c in keep), pa.array(n), pa.array(sums)], names=[*keep, "n", "sum"])

    schema = rows.select(*keep).schema.add("n", "long").add("sum", "double")
    return rows.select(*keep, "__text").mapInArrow(run, schema)


#: Bounds of the two length-normalised differences (per symbol, per root of symbols) that enter the curve.
MEAN_RANGE, ROOT_RANGE = (-0.1, 0.5), (-4.0, 12.0)


def _design(evidence: np.ndarray, n: np.ndarray) -> np.ndarray:
    return np.column_stack([np.ones(len(n)), np.clip(evidence, *MEAN_RANGE), np.clip(evidence * np.sqrt(n), *ROOT_RANGE)])


def fit_curve(x: np.ndarray, y: np.ndarray, steps: int = 100, ridge: float = 1e-2) -> np.ndarray:
    """Logistic regression by damped Newton steps; the ridge keeps separable data finite."""
    scale = np.maximum(np.abs(x).max(axis=0), 1e-9)
    z, w = x / scale, np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        move = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + ridge * np.eye(len(w)), z.T @ (p - y) + ridge * w)
        w -= move / max(1.0, np.abs(move).max() / 4)
        if np.abs(move).max() < 1e-8:
            break
    return w / scale


def score_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", label: str = "toxic") -> DataFrame:
    """One row per row of docs: doc_id, held_out, score (0 to 1), predicted (1 if score >= 0.5).

    Folds by crc32(id as text) mod 5: fold 0 is held out, fold 1 fits the curve (at most
    ``CALIBRATION_ROWS`` labelled rows, those of the smallest crc32), folds 2 to 4 train the models,
    on all their labelled texts.  A null or empty text scores like a text without evidence; a null
    label is no label; of repeated labels the largest holds; a null id counts as the text "" for
    folds and takes no label.  Where a class has no training text every score is the share of toxic
    labels (0 if none).  Other columns are ignored; an empty table gives no rows.
    """
    crc = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("__text")).withColumn("__fold", crc % 5)
    marks = labels.where(F.col(label).isNotNull()).groupBy(F.col(id_col).cast("long").alias("__id")).agg(F.max(F.col(label).cast("int")).alias("__toxic"))
    marks = marks.where(F.crc32(F.col("__id").cast("string")) % 5 != 0)
    marks = F.broadcast(marks) if small(marks, BROADCAST_IDS) else marks
    labelled = rows.where("__fold <> 0").join(marks, F.col("doc_id") == F.col("__id")).drop("__id")
    models = train(labelled.where("__fold >= 2").select("__text", "__toxic"))
    if models is None:
        share = labelled.agg(F.avg("__toxic")).first()[0] or 0.0
        out = rows.select("doc_id", (F.col("__fold") == 0).alias("held_out"), F.lit(float(share)).alias("score"))
    else:
        sample = evidence(labelled.where("__fold = 1").withColumn("__order", F.crc32(F.col("doc_id").cast("string"))), models, ["__order", "__toxic"])
        table = sample.orderBy("__order").limit(CALIBRATION_ROWS).toArrow()
        e, n, y = (table.column(c).to_numpy().astype(np.float64) for c in ("evidence", "n", "__toxic"))
        a, b, c = (fit_curve(_design(e, n), y) if 0 < y.sum() < len(y) else np.array([-2.0, 20.0, 1.0])).tolist()
        clip = lambda x, low, high: F.greatest(F.lit(low), F.least(F.lit(high), x))
        z = a + b * clip(F.col("evidence"), *MEAN_RANGE) + c * clip(F.col("evidence") * F.sqrt("n"), *ROOT_RANGE)
        out = evidence(rows, models, ["doc_id", "__fold"]).select("doc_id", (F.col("__fold") == 0).alias("held_out"), (1 / (1 + F.exp(-z))).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op3_class_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
