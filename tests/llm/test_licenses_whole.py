"""Texts with several notices, and every alignment that counts."""

import random

import pytest

from packetrisk.llm import licenses

NOTICES = {label: text for label, _, text in licenses.TEMPLATES}


@pytest.fixture(scope="module")
def index():
    """Document frequencies of a large corpus in which the templates' ordinary words are rare too."""
    rng = random.Random(1)
    words = {w for _, _, t in licenses.TEMPLATES for w in t.encode().split()}
    common = {b"the": 9000, b"of": 7000, b"and": 8000, b"to": 8000, b"in": 6000, b"is": 5000, b"a": 6000, b"or": 3000, b"this": 4000}
    high = {b"apache", b"gnu", b"mit", b"released", b"license", b"licensed", b"version", b"under", b"general", b"public"}
    return licenses.LicenseIndex({w: common.get(w, 300 if w in high else rng.randrange(5, 60)) for w in sorted(words)}, 10_000)


def labels(index, text):
    return set(index.scan(text.encode().split())[5].split(","))


@pytest.mark.parametrize(
    ("first", "second"),
    [("mit", "licensed under the apache license version 2 0"), ("bsd-3-clause", "this work is licensed under the gnu general public license version 3"), ("isc", "released under the mit license"), ("mpl-2.0", "released under the mit license")],
)
def test_two_notices(index, first, second):
    want = next(label for label, _, t in licenses.TEMPLATES if t == second)
    for text in (f"{NOTICES[first]} and {second}", f"{second} x y z {NOTICES[first]}", f"any charge copies deal conditions above file {second} associated copy"):
        assert want in labels(index, text)
    assert first in labels(index, f"{NOTICES[first]} and {second}")


def test_every_template_beside_every_other(index):
    for label, _, t in licenses.TEMPLATES:
        for _, _, other in licenses.TEMPLATES:
            assert label in labels(index, f"{other} some words between {t}")


def test_no_alignment_that_counts_is_missed(index):
    """Half-kept notices in text of their words: the same matches as scoring every alignment."""
    rng = random.Random(7)
    vocabulary = sorted(index.idf)
    for _ in range(150):
        t = rng.randrange(len(index.templates))
        text = [w if rng.random() < 0.7 else b"zz" for w in index.templates[t][2]]
        words = [rng.choice(vocabulary) for _ in range(40)] + text + [rng.choice(vocabulary) for _ in range(40)]
        got = {(m["label"], m["word"]): m["score"] for m in index.scan(words)[7]}
        want = {}
        for u, (label, keys, template) in enumerate(index.templates):
            for shift in range(-len(template) + 1, len(words)):
                on = [index.idf[w] for at, w in enumerate(template) if 0 <= at + shift < len(words) and words[at + shift] == w]
                near = words[max(0, shift - 4) : shift + len(template) + 4]
                if (score := min(1.0, sum(on) / index.weight[u])) >= index.share and all(any(near[i : i + len(k)] == k for i in range(len(near))) for k in keys):
                    want[label, max(0, shift)] = max(score, want.get((label, max(0, shift)), 0.0))
        assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)


@pytest.mark.parametrize("copies", [1, 2, 3, 100])
def test_words_that_every_document_holds(spark, copies):
    """A table of one row, or of copies, gets its label."""
    rows = [(i, NOTICES["isc"]) for i in range(copies)]
    got = licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == copies and all(r.labels == "isc" and r.score == 1.0 and r.n_base == 0 for r in got)


def test_null_and_repeated_rows(spark):
    rows = [(None, "under the MIT license"), (1, "released under the mit license"), (1, "released under the mit license"), (2, None), (3, "")]
    got = sorted(((r.doc_id, r.n_words, r.base_labels, r.labels, r.first_word) for r in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    assert got == sorted([(None, 4, "mit", "mit", 2), (1, 5, "mit", "mit", 3), (1, 5, "mit", "mit", 3), (2, 0, "", "", None), (3, 0, "", "", None)], key=str)
