"""The perplexity of the quality rules against a modified Kneser-Ney model in plain dictionaries."""

import math
from collections import Counter, defaultdict

from packetrisk.llm.perplexity_rules import ORDER, OWN, quality_rules
from packetrisk.llm.symbols import SYMBOLS


def grams(text):
    s = [int(SYMBOLS[b]) for b in b" " * (ORDER - 1) + (text or "").encode()]
    return [tuple(s[i : i + ORDER]) for i in range(len(s) - ORDER + 1)]


def model(texts):
    tables = {ORDER: Counter(g for t in texts for g in grams(t))}
    for n in range(ORDER - 1, 0, -1):
        tables[n] = Counter(g[1:] for g in tables[n + 1])
    cut, total, spare = {}, defaultdict(int), defaultdict(float)
    for n, table in tables.items():
        many = Counter(table.values())
        n1, n2, n3, n4 = (max(1, many[i]) for i in (1, 2, 3, 4))
        y = n1 / (n1 + 2 * n2)
        raw = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3)
        cut[n] = [min(max(d, 0.05), i - 0.05) for i, d in enumerate(raw, 1)]
        for g, c in table.items():
            total[n, g[:-1]] += c
            spare[n, g[:-1]] += cut[n][min(c, 3) - 1]

    def p(g):
        if not g:
            return 1 / 64
        n, below = len(g), p(g[1:])
        if (n, g[:-1]) not in total:
            return below
        c = tables[n].get(g, 0)
        high = c - cut[n][min(c, 3) - 1] if c else 0
        return (high + spare[n, g[:-1]] * below) / total[n, g[:-1]]

    return p


def test_log_perplexity(spark, small):
    rows = [(r.doc_id, r.lang or "", r.text) for r in spark.read.parquet(f"{small}/documents.parquet").orderBy("doc_id").limit(30).collect()]
    rows += [(-1, "xx", "Short one"), (-2, "xx", "zq\U0001f600 zq"), (-3, "", ""), (-4, "", None), (-5, "xx", "Short one")]
    df = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    pooled = model([t for _, _, t in rows])
    own = {lang: model([t for _, x, t in rows if x == lang]) for lang in {x for _, x, _ in rows}}
    got = {r.doc_id: r.log_perplexity for r in quality_rules(df).collect()}
    assert len(got) == len(rows)
    for d, lang, t in rows:
        logs = [math.log(OWN * own[lang](g) + (1 - OWN) * pooled(g)) for g in grams(t)]
        assert got[d] is None if not logs else abs(got[d] + sum(logs) / len(logs)) < 1e-4
