"""Language identification against an interpolated Kneser-Ney model in plain dictionaries."""

import math
import re
import zlib
from collections import Counter, defaultdict

import pytest

from packetrisk.llm import language_id
from packetrisk.llm.language_id import ORDER, identify_languages, letters, op12_kneser_ney_language


def words_of(text):
    return [w for w in re.findall(r"[^\W\d_]+", (text or "").lower()) if any(map(str.isalpha, w))]


def grams(word):
    s = "^" * (ORDER - 1) + word + "$"
    return [s[i : i + ORDER] for i in range(len(word) + 1)]


class Plain:
    def __init__(self, texts, alphabet):
        self.tables = {ORDER: Counter(g for t in texts for w in words_of(t) for g in grams(w))}
        for n in range(ORDER - 1, 0, -1):
            self.tables[n] = Counter(g[1:] for g in self.tables[n + 1])
        self.cut, self.total, self.types, self.base = {}, defaultdict(int), defaultdict(int), 1 / alphabet
        for n, table in self.tables.items():
            many = Counter(table.values())
            self.cut[n] = min(max(many[1] / (many[1] + 2 * many[2]), 0.05), 0.95) if many[1] or many[2] else 0.5
            for g, c in table.items():
                self.total[n, g[:-1]] += c
                self.types[n, g[:-1]] += 1

    def p(self, g):
        if not g:
            return self.base
        n, below = len(g), self.p(g[1:])
        total = self.total.get((n, g[:-1]))
        if not total:
            return below
        return max(self.tables[n].get(g, 0) - self.cut[n], 0) / total + self.cut[n] * self.types[n, g[:-1]] / total * below


def crc(doc):
    return zlib.crc32(("" if doc is None else str(doc)).encode())


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, lang string, block long, words string")


def check(rows, out):
    train = [r for r in rows if r[2] is not None and crc(r[0]) % 4 != 2 and crc(r[0]) // 4 % 8 != 7]
    alphabet = len({c for _, t, _ in train for w in words_of(t) for c in w + "$"}) + 1
    models = {x: Plain([t for _, t, y in train if y == x], alphabet) for x in sorted({r[2] for r in train})}
    models = {x: m for x, m in models.items() if m.tables[ORDER]}
    got = defaultdict(list)
    for r in out.collect():
        got[r.doc_id].append(r)
    assert sum(map(len, got.values())) == len(rows)
    for d, t, _ in rows:
        sums = {x: -sum(math.log(m.p(g)) for w in words_of(t) for g in grams(w)) / max(1, sum(len(w) + 1 for w in words_of(t))) for x, m in models.items()}
        best = min(sums, key=lambda x: (round(sums[x], 4), x)) if words_of(t) and sums else "und"
        found = [r for r in got[d] if r.lang_pred == best and (best == "und" or abs(r.cross_entropy - sums[best]) < 2e-4)]
        assert found, (d, t, best, got[d])
        assert all(r.held_out == (crc(d) % 4 == 2) and 0 <= r.score <= 1 for r in got[d])
        assert best != "und" or all(r.score == 0 and r.rejected for r in found)


def test_against_plain(spark, small):
    rows = [tuple(r) for r in spark.read.parquet(f"{small}/documents.parquet").orderBy("doc_id").select("doc_id", "text", "lang").limit(60).collect()]
    rows += [(-1, None, "en"), (-2, "", "en"), (-3, "123 ½ _ 4!", None), (-4, "Zq\U0001f600 zq", "xx"), (-5, "漢字とかな", "ja"), (-6, "the", None), (-7, "the", ""), (-8, "the", ""), (None, "nothing", None)]
    rows += [(-9, "same same", "en"), (-9, "same same", "en")]
    check(rows, identify_languages(frame(spark, rows)))


def test_small_blocks_and_buckets(spark, small, monkeypatch):
    """Many blocks and buckets, and words split part by part, give the same."""
    for name, value in (("BLOCK_CHARS", 3000), ("PART_CHARS", 50), ("BUCKET_ENTRIES", 300)):
        monkeypatch.setattr(language_id, name, value)
    rows = [tuple(r) for r in spark.read.parquet(f"{small}/documents.parquet").orderBy("doc_id").select("doc_id", "text", "lang").limit(25).collect()]
    check(rows, identify_languages(frame(spark, rows)))


@pytest.mark.parametrize("rows", [[], [(1, "text", None)], [(k, "held out", "en") for k in range(200) if crc(k) % 4 == 2][:2]])
def test_nothing_learned(spark, rows):
    out = identify_languages(frame(spark, rows)).collect()
    assert len(out) == len(rows) and all(r.lang_pred == "und" and r.score == 0 for r in out)


def test_long_text(spark):
    rows = [(1, "ab " * 1_500_000 + "x" * 3_000_000, "en"), (3, "ab ab", "en"), (5, "я ты", "ru"), (8, "я", "ru")]
    out = {r.doc_id: r.lang_pred for r in identify_languages(frame(spark, rows)).collect()}
    assert out[1] == "en" and out[5] == "ru"
    assert sum(map(len, letters("ab " * 1_500_000))) == 1_500_000


def test_held_out_accuracy(spark, small):
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    out = [r for r in op12_kneser_ney_language(spark, small).collect() if r.held_out and truth[r.doc_id] is not None and r.lang_pred != "und"]
    assert len(out) > 20 and sum(r.lang_pred == truth[r.doc_id] for r in out) >= 0.97 * len(out)
