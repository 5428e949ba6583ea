"""The samples of the forest: one pass, the same rows for any partitioning."""

import random

import numpy as np
import pandas as pd
import pytest

from packetrisk.functions.features import FEATURES
from packetrisk.operators import isolation_forest as forest
from packetrisk.operators.isolation_forest import Smallest, samples

COLUMNS = "packet_id long, " + ", ".join(f"{c} double" for c in FEATURES)


def frame(spark, many, seed=0):
    rng = random.Random(seed)
    return spark.createDataFrame([(i % max(1, many - 5), *(rng.random() for _ in FEATURES)) for i in range(many)], COLUMNS)


def chosen(df, trees, sample):
    out = {}
    for r in samples(df, "packet_id", trees, 42, sample).collect():
        out.setdefault(r.tree, []).append(tuple(r)[1:])
    return {t: sorted(rows)[:sample] for t, rows in out.items()}


@pytest.mark.parametrize("sample", [1, 16, 256])
def test_any_partitioning(spark, sample):
    df = frame(spark, 1500)
    one, many = chosen(df.coalesce(1), 7, sample), chosen(df.repartition(13), 7, sample)
    assert one == many and set(one) == set(range(7)) and all(len(rows) == sample for rows in one.values())
    assert len({tuple(rows) for rows in one.values()}) == 7


def test_smallest_of_all_rows(spark, monkeypatch):
    """Two steps of merging keep the smallest hashes of all rows."""
    monkeypatch.setattr(forest, "MERGES", 3)
    df = frame(spark, 900)
    assert chosen(df.repartition(20), 5, 30) == {t: rows[:30] for t, rows in chosen(df, 5, 900).items()}


def test_bounded_memory():
    smallest, rng = Smallest(10), np.random.default_rng(1)
    kept = []
    for _ in range(200):
        h = rng.integers(0, 2**62, 50)
        kept.append(h)
        smallest.add(0, h, np.zeros((50, 4)))
        assert sum(len(p[0]) for p in smallest.parts[0][1]) <= 70
    assert smallest.chosen(0)[0].tolist() == sorted(np.concatenate(kept).tolist())[:10]


def test_no_explode_and_one_read(spark, tmp_path):
    frame(spark, 200).write.parquet(str(tmp_path / "rows"))
    plan = samples(spark.read.parquet(str(tmp_path / "rows")), "packet_id", 100, 42, 256)._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and plan.count("FileScan") == 1 and "Window" not in plan


def test_small_and_equal_rows(spark):
    few = forest.train_forest(frame(spark, 7), "packet_id", trees=5)
    assert few.sample == 7 and set(few.trees.tree) == set(range(5))
    same = spark.createDataFrame([(1, 0.5, 0.5, 0.5, 0.5)] * 300, COLUMNS)
    trees = forest.train_forest(same, "packet_id", trees=3)
    assert trees.sample == 256 and (trees.trees.feature == -1).all()
    again = forest.train_forest(frame(spark, 600).repartition(9), "packet_id", trees=4)
    pd.testing.assert_frame_equal(again.trees, forest.train_forest(frame(spark, 600).coalesce(1), "packet_id", trees=4).trees)
