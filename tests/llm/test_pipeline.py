"""The pipeline against plain versions of its stages, each judged on its own input."""

import re

import corpus_pipeline
from tests.llm import brute

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality rules", "near-duplicates", "repeated bytes", "benchmark passages", "packing"]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    before = {r.doc_id: r.text for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.stored(stage(spark, docs, small))
        assert docs.columns == COLUMNS
        after = {r.doc_id: r.text for r in docs.collect()}
        assert all(r.n_chars == len(r.text) for r in docs.collect()) or name != "repeated bytes"
        rows = list(before.items())
        if name == "quality rules":
            failed = {d for d, t in rows if (c := brute.base_counts(t))[0] < 50 or 100 * c[4] > 50 * c[0]}
            assert not failed & set(after) and len(after) >= 0.9 * (len(rows) - len(failed))
        elif name == "near-duplicates":
            assert set(after) == {d for d, (_, _, kept) in brute.near_groups(rows, 5, 80, 100).items() if kept}
        elif name == "repeated bytes":
            cut = {d: r[3].decode(errors="ignore") for d, r in brute.repeats([(d, t.encode()) for d, t in rows]).items()}
            assert after == {d: t for d, t in cut.items() if re.search(r"[^\x20\x09-\x0D]", t)}
        else:
            assert set(after) == {d for d, r in brute.contamination(rows, items).items() if not r[4]}
        if name != "repeated bytes":
            assert all(after[d] == before[d] for d in after)
        before = after
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, small)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == set(before)


def test_run_is_the_stages(spark, small):
    rows = corpus_pipeline.run(spark, small).toPandas()
    assert len(rows) and (rows.groupby("sequence_id").length.sum() <= 2048).all()
