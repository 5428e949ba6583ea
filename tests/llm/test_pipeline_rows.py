"""Pipeline stages judge rows: null and repeated ids do not take other rows with them."""

import random

import corpus_pipeline
from pyspark.sql import functions as F


def texts(df):
    return sorted(r.text or "" for r in df.select("text").collect())


def test_null_and_repeated_ids(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").select(*corpus_pipeline.COLUMNS)
    ids = F.when(F.col("doc_id") % 3 == 0, F.lit(None)).otherwise(F.floor(F.col("doc_id") / 6)).cast("long")
    other = docs.withColumn("doc_id", ids)
    for stage in (corpus_pipeline.quality, corpus_pipeline.decontaminate):
        want = texts(stage(spark, docs, small))
        out = stage(spark, other, small)
        assert out.columns == corpus_pipeline.COLUMNS and 0 < len(want) < docs.count()
        assert texts(out) == want


def test_near_duplicates_by_row(spark, small):
    rng = random.Random(5)
    a, b, c, d = (" ".join(f"w{rng.randrange(400)}" for _ in range(80)) for _ in range(4))
    rows = [(None, a), (None, a + " tail"), (5, a), (5, b), (None, c), (3, d), (3, d), (9, a + " end"), (None, ""), (None, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    out = corpus_pipeline.near_dedup(spark, docs, small)
    assert sorted(((r.doc_id, r.text) for r in out.collect()), key=str) == sorted([(5, a), (5, b), (None, c), (3, d), (None, ""), (None, None)], key=str)


FILTERS = [corpus_pipeline.quality, corpus_pipeline.near_dedup, corpus_pipeline.decontaminate]
FIELDS = "doc_id long, text string, lang string, source string, n_chars long"


def written(spark, tmp_path, docs, parts=3):
    docs.repartition(parts).write.parquet(str(tmp_path / "docs"))
    return spark.read.parquet(str(tmp_path / "docs"))


def good(seed, n=70):
    rng = random.Random(seed)
    return " ".join(f"{rng.choice('bcdfglmnprst')}{rng.choice('aeiou')}{rng.choice('lmnrst')}{rng.choice('aeiou')}" for _ in range(n))


def test_rows_of_files_have_keys_of_their_own(spark, tmp_path):
    docs = written(spark, tmp_path, spark.range(5000).select(F.lit(1).alias("doc_id"), F.lit("same").alias("text")), 7)
    for rows in (docs, docs.where("text = 'same'"), docs.limit(4000), docs.union(docs)):
        keyed, key = corpus_pipeline._keyed(rows)
        assert keyed.select(key).distinct().count() == rows.count() == keyed.count()
    keyed, key = corpus_pipeline._keyed(docs)
    assert keyed.where(f"{key} is not null").agg(F.sum(F.hash(key))).first() == keyed.agg(F.sum(F.hash(key))).first()
    assert "docs" in keyed.inputFiles()[0] and "docs" in corpus_pipeline._keyed(docs.where("doc_id = 1"))[0].inputFiles()[0]


def test_nulls_do_not_share_a_verdict(spark, tmp_path):
    """A row without a text goes; one whose language is missing and whose text is that row's language stays as judged by itself."""
    long = good(1)
    rows = [(None, None, long, "s", 0), (None, long, None, "s", 0), (1, long, long, None, None), (1, None, None, None, None)]
    rows += [(10 + i, good(i + 5), "en", "s", 1) for i in range(12)]
    docs = written(spark, tmp_path, spark.createDataFrame(rows, FIELDS))
    assert sum(t == long for t in texts(corpus_pipeline.quality(spark, docs, "/root/testdata/sf0.001"))) == 2
    assert len(texts(corpus_pipeline.decontaminate(spark, docs, "/root/testdata/sf0.001"))) == len(rows)


def test_further_and_clashing_columns(spark, small, tmp_path):
    docs = spark.read.parquet(f"{small}/documents.parquet").select(*corpus_pipeline.COLUMNS)
    more = docs.withColumns({"__row": F.lit("mine"), "__row_": F.lit(2), "tags": F.create_map(F.lit("a"), F.lit(1)), "kept": F.lit(True), "component_id": F.lit(3)})
    for i, source in enumerate((more, written(spark, tmp_path, more))):
        for stage in FILTERS:
            out = stage(spark, source, small)
            assert out.columns == more.columns and texts(out) == texts(stage(spark, docs, small))
            assert {r["__row"] for r in out.select("__row").distinct().collect()} == {"mine"}
        assert corpus_pipeline.suffix_dedup(spark, source, small).columns == corpus_pipeline.COLUMNS
        assert corpus_pipeline.pack(spark, source, small).count() > 0, i


def test_empty_tables(spark, small):
    empty = spark.createDataFrame([], FIELDS)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, small).count() == 0


def test_null_and_repeated_ids_of_the_last_stages(spark, small):
    passage = "x " * 40
    rows = [(None, f"one {passage}", "en", "s", 0), (None, f"two {passage}", "en", "s", 0), (4, f"three {passage}", "en", "s", 0), (4, f"four {passage}", "en", "s", 0), (7, f"five {passage} end", "en", "s", 0), (8, None, "en", "s", 0)]
    docs = spark.createDataFrame(rows, FIELDS)
    out = sorted(r.text for r in corpus_pipeline.suffix_dedup(spark, docs, small).collect())
    assert [t for t in out if t.startswith(("one", "two", "three", "four"))] == sorted(r[1] for r in rows[:4]) and len(out) == 5
    assert next(t for t in out if t.startswith("fiv")).count("x") < 30
    pieces = corpus_pipeline.pack(spark, docs, small)
    assert pieces.count() >= len(rows) and pieces.where("doc_id = 4 and start = 0").count() == 2 and pieces.where("doc_id is null and start = 0").count() == 2


def test_very_long_texts(spark, small):
    long = good(3, 120_000)
    docs = spark.createDataFrame([(1, long, "en", "s", 0), (2, long + " more", "en", "s", 0), (3, good(4), "en", "s", 0)], FIELDS)
    assert sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, small).collect()) == [1, 3]
    assert [r.doc_id for r in corpus_pipeline.suffix_dedup(spark, docs, small).collect() if len(r.text) > 100_000] == [1]
    assert corpus_pipeline.decontaminate(spark, docs, small).count() == 3
    assert corpus_pipeline.pack(spark, docs, small).agg(F.sum("length")).first()[0] > 100_000
    assert {r.doc_id for r in corpus_pipeline.quality(spark, docs, small).collect()} <= {1, 2, 3}
