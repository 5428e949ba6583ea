"""Cells and key ranges of the packing come from all documents; the cache of token ids keeps what is asked for again."""

import random

import numpy as np
import pytest

from packetrisk.llm import packing


def test_cells_and_ranges_see_every_document(spark, monkeypatch):
    rng = random.Random(4)
    texts = [" ".join(rng.choice(("lorem", "ipsum", "dolor", "aus", "und")) for _ in range(rng.randrange(20, 300 if i % 10 else 3000))) for i in range(600)] + ["", "abc", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, __text string").repartition(7)
    monkeypatch.setattr(type(docs), "sample", lambda *_, **__: pytest.fail("a sample of the documents"))
    monkeypatch.setattr(packing, "SAMPLE", 10, raising=False)
    cuts, bounds = packing.curve_cells(docs, 50_000)
    held = [(t or "").encode() for t in texts]
    points = packing.project(held)
    for d, cut in enumerate(cuts):
        assert np.abs(np.searchsorted(np.sort(points[:, d]), cut) / len(points) - np.arange(1, 1024) / 1024).max() < 0.01
    ties = (packing.mix(np.arange(len(texts), dtype=np.uint64)) >> np.uint64(32)).astype(np.int64)
    part = np.searchsorted(bounds, packing.curve_keys(points, cuts, ties), side="right")
    filled = np.bincount(part, weights=[len(t) for t in held])
    assert len(filled) == -(-sum(map(len, held)) // 50_000) and filled.min() > 25_000 and filled.max() < 75_000
    cuts, bounds = packing.curve_cells(docs.limit(0), 50_000)
    assert len(bounds) == 0


def test_projection_is_the_mean_of_the_grams(spark):
    text = "ab cdé\n" * 9
    raw = text.encode()
    slots = [int.from_bytes(raw[i : i + 4], "little") * 2654435761 % (1 << 32) >> 22 for i in range(len(raw) - 3)]
    got = packing.project([b"", raw, b"abc", raw * 30_000, raw])
    assert np.allclose(got[1], packing._SIGNS[slots].mean(axis=0), atol=1e-6) and np.array_equal(got[1], got[4])
    assert not got[0].any() and not got[2].any() and np.allclose(got[3], got[1], atol=0.1)


def test_chunk_ids_keep_what_is_asked_for_again(monkeypatch):
    import public_tokenizers

    known = packing.ChunkIds(public_tokenizers.path(packing.TOKENIZER))
    monkeypatch.setattr(packing.ChunkIds, "LIMIT", 3)
    known.fill([["again", "again.", "gone", "x1,!"]])
    encoded = []
    plain = known._encode_words
    monkeypatch.setattr(known, "_encode_words", lambda words, *more: (encoded.extend(words), plain(words, *more)))
    known.fill([["again", "new"], ["again."]])
    assert encoded == ["new"] and "gone" not in known
    for item in ("again", "again.", "new"):
        assert known[item] == np.array(known.tokenizer.encode(item, add_special_tokens=False).ids, dtype="<u4").tobytes()
