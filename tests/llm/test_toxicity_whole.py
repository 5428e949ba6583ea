"""The toxicity models count every n-gram, whatever a task may hold at once."""

import pytest

from packetrisk.llm import toxicity


def test_scores_do_not_depend_on_model_grams(spark, small, monkeypatch):
    docs, labels = spark.read.parquet(f"{small}/documents.parquet"), spark.read.parquet(f"{small}/labels.parquet")
    docs = docs.union(docs.limit(3))

    def scores():
        return sorted((r.doc_id, r.held_out, r.score, r.predicted) for r in toxicity.score_toxicity(docs, labels).collect())

    whole = scores()
    monkeypatch.setattr(toxicity, "MODEL_GRAMS", 8_000)  # several pieces; a cap of this size would cut most n-grams
    for a, b in zip(whole, scores(), strict=True):
        assert a[:2] == b[:2] and a[3] == b[3] and a[2] == pytest.approx(b[2], abs=1e-6)
