"""Phrase mining against plain counting, and the counting scheme itself."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from packetrisk.llm import collocations as module
from packetrisk.llm.collocations import _scan, blocks_of, collocations, dynamic_counts, op11_dynamic_phrases, phrase_counts

COLUMNS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def count(rows):
    """lang -> phrase (tuple) -> occurrences."""
    f = defaultdict(Counter)
    for text, lang in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            for k in range(1, 6):
                f["und" if lang is None else lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    return f


def plain(rows, least, top):
    out = []
    for lang, f in count(rows).items():
        n = sum(c for p, c in f.items() if len(p) == 1)
        good = {p: c for p, c in f.items() if len(p) > 1 and c >= least}
        inside = defaultdict(int)
        for p, c in good.items():
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    inside[p[i : i + k]] = max(inside[p[i : i + k]], c)
        found = []
        for p, a in good.items():
            if inside[p] * 100 < 100 * a:
                score, _, l, r = min((1000 * a * n // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
                found.append((-score, -a, " ".join(p).encode(), l, r))
        for rank, (s, a, p, l, r) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, p.decode(), -a, l, r, n, -s))
    return sorted(out)


def got(df):
    return sorted(tuple(r) for r in df.select(COLUMNS).collect())


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", 2) for r in rows], "text string, lang string, k int, phrase string, n int")


def texts(seed, many=120):
    rng = random.Random(seed)
    words = ["aa", "Bb", "cc", "é", "dd#", "\x00", "ff", "漢"] + [f"w{i}" for i in range(60)]
    fixed = ["new york city hall today", "aa aa aa aa aa aa", "one two three", "é 漢 é"]
    rows = []
    for _ in range(many):
        parts = [rng.choice(fixed) if rng.random() < 0.3 else " ".join(rng.choices(words, k=rng.randrange(8), weights=[8] * 8 + [1] * 60)) for _ in range(rng.randrange(6))]
        rows.append((rng.choice([". ", ", ", "\n", " ", "\t", "\r", "  "]).join(parts), rng.choice(["en", "fr", None, ""])))
    return rows + [(None, "en"), ("", None), (None, None), ("!!!", "xx")] + [("copy of a page here", "en")] * 40


@pytest.mark.parametrize("shards", [1, 2, 3, 5])
def test_hostile_rows(spark, shards):
    rows = texts(shards)
    assert got(collocations(frame(spark, rows), least=7, top=25, shards=shards)) == plain(rows, 7, 25)


def test_crowded_tables(spark, monkeypatch):
    """With tables of two places, small blocks and small batches of hashes, more is counted and the results are the same."""
    for name, value in (("LEAST_BITS", 1), ("MOST_BITS", 1), ("BLOCK_BYTES", 500), ("HELD", 100)):
        monkeypatch.setattr(module, name, value)
    rows = texts(9)
    assert got(collocations(frame(spark, rows), least=7, top=2000)) == plain(rows, 7, 2000)


def test_equal_hashes(spark, monkeypatch):
    """Phrases whose hashes collide are counted apart."""
    monkeypatch.setattr(module, "_phrases", lambda words, piece, own, k: ((lambda n: (np.full(n, 77, np.uint64), piece[:n] == piece[len(piece) - n :]))(max(0, len(words) - k + 1))))
    rows = texts(4, 40)
    df = frame(spark, rows).select("text", "lang").fillna({"text": "", "lang": "und"})
    blocks = blocks_of(df, 3)
    known = {(r.lang, r.phrase): r.n for r in phrase_counts(blocks, dynamic_counts(blocks, 1000, 7, 3), 7).where("k > 0").collect()}
    assert known == {(lang, " ".join(p)): c for lang, f in count(rows).items() for p, c in f.items() if c >= 7}


def test_one_cycle_each(spark, monkeypatch):
    """Longer phrases start while shorter ones are still being counted; none is counted for more than a cycle."""
    seen = []
    monkeypatch.setattr(module, "_scan", lambda blocks, tables, scan, shards, lengths, buckets: seen.append((scan, tuple(lengths))) or _scan(blocks, tables, scan, shards, lengths, buckets))
    df = frame(spark, texts(2, 400)).select("text", "lang").fillna({"text": "", "lang": "und"})
    tables = dynamic_counts(blocks_of(df, 4), 1000, 7, 4)
    lengths = dict(seen)
    assert {1, 2} <= set(lengths[2]) and {1, 2, 3} <= set(lengths[3])
    assert all(1 not in found for scan, found in seen if scan > 4) and len(seen) <= 4 * 5
    assert all((tables.steps[k] > 0).any() for k in range(1, 6))


def test_empty_and_long(spark):
    assert got(collocations(frame(spark, []))) == []
    rows = [("ab cd ef. " * 200_000, "en"), ("x" * 2_000_000, "en")]
    assert got(collocations(frame(spark, rows))) == plain(rows, 100, 2000)


def test_exact_arithmetic(spark):
    """The products of a large corpus pass 64 bits."""
    a, n, l, r = 10**12, 10**14, 3 * 10**12, 7 * 10**12
    e = lambda c: f"cast({c}L as decimal(19, 0))"
    assert spark.sql(f"select (cast(1000 as decimal(4, 0)) * {e(a)} * {e(n)}) div ({e(l)} * {e(r)}) as s").first().s == 1000 * a * n // (l * r)


def test_whole_table(spark):
    sf = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("text", "lang").collect()]
    assert got(op11_dynamic_phrases(spark, sf)) == plain(rows, 100, 2000)
