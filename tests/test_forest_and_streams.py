"""Isolation forest, and streams against batch."""

import numpy as np
import pandas as pd
import pytest

from packetrisk.operators import isolation_forest as forest
from packetrisk.plans.queries import QUERIES
from packetrisk.plans.score import score_packets
from packetrisk.sources import mapping


def test_average_path():
    assert forest.average_path(1) == 0 and forest.average_path(2) == 1
    assert float(forest.average_path(256)) == pytest.approx(10.2448, abs=1e-3)


def test_known_path_lengths():
    tree = pd.DataFrame([(0, 0, 0, 0.5, 1, 2, 3), (0, 1, -1, 0.0, -1, -1, 1), (0, 2, 0, 1.5, 3, 4, 2), (0, 3, -1, 0.0, -1, -1, 1), (0, 4, -1, 0.0, -1, -1, 1)], columns=["tree", "node", "feature", "cut", "low", "high", "size"])
    got = forest.Forest(tree, 3, 0.5).scores(np.array([[0.0], [1.0], [2.0]]))
    assert got == pytest.approx([2 ** (-d / float(forest.average_path(3))) for d in (1, 2, 2)])


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(0)
    values = rng.normal(0.5, 0.05, (600, 4))
    values[:6] = 5.0 + rng.random((6, 4))
    return spark.createDataFrame(pd.DataFrame(values, columns=forest.FEATURES).assign(packet_id=range(600)))


def test_outliers_and_partitions(spark, rows, tmp_path):
    first = forest.train_forest(rows.repartition(8), "packet_id", trees=30)
    again = forest.train_forest(rows.coalesce(1), "packet_id", trees=30)
    pd.testing.assert_frame_equal(first.trees.sort_values(["tree", "node"], ignore_index=True), again.trees.sort_values(["tree", "node"], ignore_index=True))
    forest.save_forest(spark, first, str(tmp_path))
    scored = forest.score(rows, forest.load_forest(spark, str(tmp_path))).toPandas().sort_values("anomaly_score", ascending=False)
    assert set(scored.packet_id[:6]) == set(range(6))
    assert 0.03 <= scored.is_anomaly.mean() <= 0.06
    assert (scored.decision < 0).equals(scored.is_anomaly)


def test_no_model(rows):
    row = forest.score(rows.limit(1), None).first()
    assert row.decision == 0.0 and row.is_anomaly is False


def test_stream_is_batch(spark, small):
    got = {tuple(r) for r in QUERIES["stream_scores"](spark, small).collect()}
    assert got == {tuple(r) for r in QUERIES["score_packets"](spark, small).collect()}


def test_order_and_partitions_do_not_matter(spark, small):
    packets, names = mapping.packets(spark, small), mapping.rdns(spark, small)
    columns = ["packet_id", "packet_count", "unique_ports", "rate_30s", "density_60s", "drift", "risk_score"]
    one = sorted(map(tuple, score_packets(packets.coalesce(1), names).select(*columns).collect()))
    many = sorted(map(tuple, score_packets(packets.repartition(7).orderBy("dst_port"), names).select(*columns).collect()))
    assert one == many
    assert all(r[1] >= r[2] and r[3] <= r[4] and 0 <= r[6] <= 100 for r in one)


def test_one_exchange_for_all_windows(spark, small):
    from packetrisk.plans.score import activity

    plan = activity(mapping.packets(spark, small))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
