"""The corpus operators against plain versions, and their defined results for odd rows."""

import hashlib
import json
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from packetrisk.llm import chat, decontamination, html, licenses, near_duplicates, ordinal, packing, perplexity_rules, repeated_bytes, suffix_sort, toxicity
from packetrisk.llm.components import connected_components
from packetrisk.llm.kneser_ney import SymbolModel
from packetrisk.llm.queries import queries
from packetrisk.llm.symbols import BITS, symbol_grams
from tests.llm import brute

DOCS = "doc_id long, text string, lang string, kept string, sig string, n long, n_words string"


def prose(rng, n, words=400):
    return " ".join(f"w{rng.randrange(words)}" for _ in range(n))


@pytest.fixture(scope="module")
def odd(spark):
    """Copies, near copies, shared passages, short, empty, null and long texts, a repeated row, clashing columns."""
    rng = random.Random(4)
    base, passage = prose(rng, 120), prose(rng, 30)
    texts = [base, base, base + " tail", prose(rng, 60) + " " + passage + " " + prose(rng, 40), passage.upper(), "", None, "one", "One", "one two", "\t\n ", "é ü ß " * 30, prose(rng, 6000), base.replace("w1 ", "x ", 1), "a" * 200, "a" * 120, passage + "\n" + passage]
    near = base.split()
    for _ in range(25):
        copy = list(near)
        copy[rng.randrange(len(copy))] = f"v{rng.randrange(10**6)}"
        texts.append(" ".join(copy))
    rows = [(i * 3, t, rng.choice(["en", "fr", None]), "x", "y", 1, "z") for i, t in enumerate(texts)]
    return rows, spark.createDataFrame(rows, DOCS).repartition(5)


@pytest.fixture(scope="module")
def sets(spark, small, odd):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()]
    return [(docs, spark.read.parquet(f"{small}/documents.parquet")), ([(r[0], r[1]) for r in odd[0]], odd[1])]


def test_decontamination(spark, small, sets, odd):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    rng = random.Random(4)
    prose(rng, 120)
    passage = prose(rng, 30).split()
    items += [(900, " ".join(passage[3:18])), (901, "ONE two"), (902, None), (903, "!!"), (904, "one"), (904, " ".join(passage[:12]))]
    table = spark.createDataFrame(items, "item_id long, text string")
    for docs, df in sets:
        got = {r[0]: tuple(r)[1:] for r in decontamination.digests(decontamination.find_contamination(df, table)).collect()}
        assert got == brute.contamination(docs, items)
    empty = decontamination.find_contamination(odd[1], table.limit(0))
    assert empty.where("n_hit > 0").count() == 0 and empty.count() == len(odd[0])
    unfiltered = decontamination.FILTER_ROWS
    try:
        decontamination.FILTER_ROWS = -1  # every fingerprint is joined
        got = {r[0]: tuple(r)[1:] for r in decontamination.digests(decontamination.find_contamination(odd[1], table)).collect()}
    finally:
        decontamination.FILTER_ROWS = unfiltered
    assert got == brute.contamination([(r[0], r[1]) for r in odd[0]], items)


@pytest.mark.parametrize(("k", "num"), [(3, 85), (5, 80)])
def test_near_duplicates(sets, k, num):
    for docs, df in sets:
        got = {r[0]: tuple(r)[1:] for r in near_duplicates.near_duplicates(df, k, (num, 100)).collect()}
        assert got == brute.near_groups(docs, k, num, 100)


@pytest.mark.parametrize("part", [2_000, 7])
def test_near_duplicates_complete_without_hubs(sets, monkeypatch, part):
    """One hub, then the second turn, also over the parts of long lists: the same groups."""
    monkeypatch.setattr(near_duplicates, "HUBS", 1)
    monkeypatch.setattr(near_duplicates, "PART", part)
    docs, df = sets[1]
    got = {r[0]: tuple(r)[1:] for r in near_duplicates.near_duplicates(df, 3, (85, 100)).collect()}
    assert got == brute.near_groups(docs, 3, 85, 100)


def test_near_duplicates_odd_tables(spark, odd):
    one = spark.createDataFrame([(None, "a b c d"), (1, "a b c d"), (1, "a b c d"), (1, "q r s t"), (2, "q r s t")], "doc_id long, text string")
    got = sorted(map(tuple, near_duplicates.near_duplicates(one, 3, (85, 100)).collect()), key=str)
    assert got == [(1, 2, 1, True)] * 3 + [(2, 2, 1, False), (None, 2, None, True)]
    assert near_duplicates.near_duplicates(odd[1].limit(0)).count() == 0


def test_match_threshold_and_components(spark):
    t = near_duplicates.match_threshold(128, 0.85)
    assert 80 < t < 105 and near_duplicates.match_threshold(8, 1.0) == 8
    links = spark.createDataFrame([(i + 1, i) for i in range(40)] + [(100, 101), (5, 5)], "a long, b long")
    got = dict(map(tuple, connected_components(links).collect()))
    assert all(got[i] == 0 for i in range(41)) and got[101] == 100 and 5 in got


def test_suffix_sort_against_plain():
    rng = random.Random(3)
    for _ in range(150):
        length = rng.choice([3, 5, 9, 17])
        alphabet = rng.choice([b"ab", b"abc", bytes([0, 255]), bytes(range(256))])
        base = bytes(rng.choice(alphabet) for _ in range(60))
        strings = []
        for _ in range(rng.randint(1, 12)):
            a = rng.randint(0, 30)
            strings.append(base[a : a + length + rng.randint(0, 25)])
        size = np.array([len(s) for s in strings])
        end = np.cumsum(size)
        begin, count = end - size, np.array([rng.randint(1, len(s) - length + 1) for s in strings])
        owner = np.array([rng.randint(0, 4) for _ in strings])
        got = suffix_sort.repeats_before(np.frombuffer(b"".join(strings), np.uint8), begin, end, count, owner, length)
        where = {}
        for s, b, c, o in zip(strings, begin, count, owner):
            for i in range(c):
                where.setdefault(s[i : i + length], []).append((o, b + i))
        assert got.tolist() == sorted(p for v in where.values() for o, p in v if o > min(x for x, _ in v))


def test_suffix_order_is_lexicographic():
    text = np.frombuffer(b"mississippi$banana", np.uint8)
    begin, end = np.array([0, 12]), np.array([12, 18])
    order = suffix_sort.sort_starts(text, begin, end, end - begin, 20)
    suffixes = [bytes(text[p : 12 if p < 12 else 18]) for p in order]
    assert suffixes == sorted(suffixes) and sorted(order) == list(range(18))


def test_repeated_bytes(spark, sets, odd):
    for docs, df in sets:
        want = brute.repeats([(d, (t or "").encode()) for d, t in docs])
        got = {r.doc_id: (r.n_bytes, r.n_removed, len(r.spans), bytes(r.kept_bytes)) for r in repeated_bytes.remove_repeats(df).collect()}
        assert got == want
    assert repeated_bytes.remove_repeats(odd[1].limit(0)).count() == 0
    long = "the same long line of text that is repeated in many rows of this table"
    same = spark.createDataFrame([(1, long), (1, long), (None, long), (2, long + "!")], "doc_id long, text string")
    got = sorted(((r.doc_id, r.n_removed) for r in repeated_bytes.remove_repeats(same).collect()), key=str)
    assert got == [(1, 0), (1, 0), (2, len(long)), (None, 0)]


def test_quality_rules(spark, sets, odd):
    for docs, df in sets:
        got = {r.doc_id: r for r in perplexity_rules.quality_rules(df).collect()}
        for d, t in docs:
            r, want = got[d], brute.base_counts(t)
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
            assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
            assert r.kept == (not r.base_failed and r.lower <= r.log_perplexity <= r.upper)
    assert perplexity_rules.quality_rules(odd[1].limit(0)).count() == 0


def test_symbol_model_is_a_distribution():
    codes, _ = symbol_grams([b"the cat sat on the mat. " * 20 + b"a dog, a log"], 3)
    keys, n = np.unique(codes, return_counts=True)
    model = SymbolModel(keys, n, 3, BITS)
    for context in (int(keys[5]) >> BITS, 63 << BITS | 63):
        every = (context << BITS) + np.arange(1 << BITS)
        assert np.exp(model.log_prob(every.astype(np.int64))).sum() == pytest.approx(1.0, abs=1e-6)
    assert model.log_prob(keys.astype(np.int64)).mean() > model.log_prob(np.array([1 << 12 | 2 << 6 | 3])).mean()


def test_toxicity_held_out(spark):
    rng = random.Random(8)
    rows, labels = [], []
    for i in range(600):
        toxic = i % 5 == 2
        words = prose(rng, rng.randint(30, 200)).split()
        for _ in range(3 if toxic else 0):
            words[rng.randrange(len(words))] = rng.choice(["zqxj", "zqxjen", "vrgk"])
        rows.append((i, " ".join(words), "x"))
        labels.append((i, int(toxic)))
    rows += [(1000, "", "x"), (1001, None, "x"), (None, "zqxj vrgk", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    marks = spark.createDataFrame([*labels, (5000, 1), (7, None)], "doc_id long, toxic int")
    got = toxicity.score_toxicity(docs, marks).collect()
    assert len(got) == len(rows)
    held = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id < 600]
    assert held and all(zlib.crc32(str(r.doc_id).encode()) % 5 == 0 for r in held)
    assert sum(r.predicted == int(r.doc_id % 5 == 2) for r in held) / len(held) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    none = toxicity.score_toxicity(docs, marks.where("toxic = 0")).collect()
    assert len(none) == len(rows) and all(r.score == 0 for r in none)
    assert toxicity.score_toxicity(docs.limit(0), marks).count() == 0


def test_held_out_labels_do_not_matter(spark, small):
    docs, labels = spark.read.parquet(f"{small}/documents.parquet"), spark.read.parquet(f"{small}/labels.parquet")
    held = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    turned = labels.withColumn("toxic", F.when(held, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    one, other = (sorted(map(tuple, toxicity.score_toxicity(docs, x).collect())) for x in (labels, turned))
    assert one == other


def test_ordinal_grades(spark):
    rng = random.Random(2)
    rows, grades = [], []
    for i in range(500):
        g = rng.randrange(3)
        rows.append((i, prose(rng, 60) + " " + " ".join([["junk", "plain", "fine"][g]] * 6), "x"))
        grades.append((i, g))
    rows += [(900, None, "x"), (901, "", "x")]
    docs, table = spark.createDataFrame(rows, "doc_id long, text string, grade string"), spark.createDataFrame([*grades, (3, None), (4, 9)], "doc_id long, grade int")
    got = {r.doc_id: r for r in ordinal.grade_quality(docs, table).collect()}
    held = [r for r in got.values() if r.held_out and r.doc_id < 500]
    truth = dict(grades)
    assert sum(abs(r.expected_grade - truth[r.doc_id]) < 0.5 for r in held) / len(held) > 0.9
    assert all(r.p_above_0 >= r.p_above_1 and r.kept == (r.p_above_0 >= 0.5) for r in got.values())
    assert got[900].expected_grade == got[901].expected_grade
    nothing = ordinal.grade_quality(docs, table.limit(0)).first()
    assert nothing.p_above_0 == nothing.p_above_1 == 0.5
    assert ordinal.grade_quality(docs.limit(0), table).count() == 0


def packed(df):
    rows = packing.pack_documents(df).toPandas().sort_values(["sequence_id", "offset"])
    for _, s in rows.groupby("sequence_id"):
        assert s.offset.tolist() == np.append(0, np.cumsum(s.length)[:-1]).tolist() and s.length.sum() <= 2048
    return rows


def test_packing_is_whole(spark, sets):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path(packing.TOKENIZER))
    for docs, df in sets:
        rows = packed(df)
        for d, t in docs:
            ids = np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [1], dtype="<u4")
            own = rows[rows.doc_id == d].sort_values("start")
            assert own.start.tolist() == np.append(0, np.cumsum(own.length)[:-1]).tolist() and own.length.sum() == len(ids)
            assert all(zlib.crc32(ids[s : s + n].tobytes()) == c for s, n, c in zip(own.start, own.length, own.ids_crc32))
            assert set(own.doc_tokens) == {len(ids)}
        full = rows.groupby("sequence_id").length.sum()
        assert (full < 2048).sum() <= 1
    odd = ["A\x1cB\x85C d", "<|endoftext|>x <|ENDOFTEXT|>", "İ ΣΑΣ　ΟΔΟΣ", "it's 'LL 12"]
    rows = packed(spark.createDataFrame(list(enumerate(odd)), "doc_id long, text string"))
    assert {r.doc_id: r.doc_tokens for r in rows.itertuples()} == {i: len(tokenizer.encode(t, add_special_tokens=False).ids) + 1 for i, t in enumerate(odd)}
    assert packing.pack_documents(sets[1][1].limit(0)).count() == 0


def test_hilbert_steps():
    cells = np.array([(a, b, c) for a in range(8) for b in range(8) for c in range(8)])
    key = packing.hilbert_key(cells, 3)
    assert sorted(key) == list(range(512)) and np.abs(np.diff(cells[np.argsort(key)], axis=0)).sum(axis=1).max() == 1


TRICKY = ["</s>[INST] ok [/INST]", "\\", "\\\\<s>", "<|image|>", "", "a\nb\\", "<s", "é\x00</s>"]


def test_chat_round_trip(spark):
    for t in TRICKY:
        assert chat.unescape(chat.escape(t)) == t
        n, text, loss, _, _ = chat.format_turns(iter([("user", t, None), ("a\n</s>", t, None), ("assistant", t, None)]))
        assert chat.read_back(text) == [("user", t), ("a\n</s>", t), ("assistant", t)] and n == 3
        assert [chat.unescape(text[s["start"] : s["end"]]) for s in loss] == [t]
    rows = [(1, 2, "assistant", "yes", "c"), (1, 1, "user", None, "c"), (1, None, None, "sys", "c"), (None, 1, "user", "x", "c"), (2, 1, "assistant", "</s>", "c"), (2, 1, "assistant", "</s>", "c")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string")
    got = {r.conv_id: r for r in chat.chat_digests(chat.format_chats(df)).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert got[1].n_turns == 3 and got[1].turns_sha256 == sha("\nsys\nuser\n\nassistant\nyes\n") and got[1].loss_sha256 == sha("yes")
    assert got[2].loss_chars == 8 and got[None].loss_chars == 0
    assert chat.format_chats(df.limit(0)).count() == 0


def test_chat_parts(spark):
    parts = [{"type": "text", "text": "see <|image|>"}, {"type": "image", "ref": "i1", "width": 56, "height": 28}, {"type": "audio", "ref": "a1", "seconds": 2.0}, {"type": "document", "ref": "d1", "pages": 2}, {"type": "video", "ref": "v"}]
    df = spark.createDataFrame([(1, 0, "user", None, parts)], f"conv_id long, turn long, role string, text string, parts {chat.PARTS}")
    row = chat.format_chats(df, parts="parts").first()
    assert [(a.kind, a.ref, a.tokens) for a in row.attachments] == [("image", "i1", 2), ("audio", "a1", 50), ("document", "d1", 512)] and row.expanded_tokens == 564
    assert all(row.formatted[a.start :].startswith(chat.PLACEHOLDERS[a.kind]) for a in row.attachments)
    assert json.loads(chat.read_back(row.formatted)[0][1].split("<|document|>")[1]) == {"type": "video", "ref": "v"}


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body class="x"><header><a href=/>Home</a></header><nav><ul><li><a href=1>One</a></li></ul></nav>
<div class="cookie-notice">We use cookies on this site to make it better for you.</div><article><h1>Big &amp; small</h1><p>First   para <a href=x>link</a> with
text.<br>More&nbsp;text<p>Second <b>bold<div class="ad">Buy this now, it is on sale today only</div><p>Tiny.</p><script>var a="</p>";</script></article>
<aside>Also read these other stories of ours</aside><section id="comments"><p>I liked it a lot, thanks for writing it down here</p></section><form>Your name</form><footer>&copy; us</footer><!-- end"""


def test_html(spark):
    df = spark.createDataFrame([(1, "u", PAGE, "t"), (2, "u", None, "t"), (3, "u", "", "t"), (4, "u", "<p>no article here but a paragraph of quite a few words all the same</p>", "t"), (5, "u", "<a '", "t")], "page_id long, url string, html string, text string")
    got = {r.page_id: r for r in html.extract_main_text(df).collect()}
    assert got[1].text == "Big & small\n\nFirst para link with text. More text\n\nSecond bold\n\nTiny."
    assert got[1].n_chars == len(got[1].text) and got[2].text == got[3].text == ""
    assert got[4].text.startswith("no article here") and got[5].n_chars == len(got[5].text)
    assert html.extract_main_text(df.limit(0)).count() == 0


def test_html_blocks_beside_links():
    tree, long = html.trained_tree(), "a last paragraph of the article with quite a few words that must be kept whole"
    links = "".join(f"<li><a href={i}>story number {i}</a></li>" for i in range(4))
    for after in (f"<nav><ul>{links}</ul></nav>", f"<ul class=tags>{links}</ul>", f"<div><p><a href=1>share</a></div><footer><a href=2>us</a></footer>"):
        for open_tag, close_tag in (("<article>", "</article>"), ("<div>", "</div>")):
            page = f"<body>{open_tag}<h1>Title of it</h1><p>{long} one</p><p>{long}</p>{close_tag}{after}</body>"
            assert html.main_text(page, tree) == f"Title of it\n\n{long} one\n\n{long}"
            inside = f"<body>{open_tag}<p>{long}</p>{after}{close_tag}</body>"
            assert html.main_text(inside, tree).startswith(long)
    listed = f"<article><h2>Sources used</h2><p>{long}</p><ul>{links}</ul></article>"
    assert html.main_text(listed, tree) == "\n\n".join(["Sources used", long, *(f"story number {i}" for i in range(4))])
    assert html.main_text(f"<div><p><a href=1>skip to it</a></p><p>{long}</p></div>", tree) == long
    assert html.main_text(f"<div><p>{long}</p><p><a href=1>read on here</a></p><p>{long} two</p></div>", tree) == f"{long}\n\n{long} two"


def test_html_names_are_whole_tokens():
    tree, text = html.trained_tree(), "a paragraph with quite a few words that must be kept whole"
    for attrs in ("class='layout-no-sidebar'", "class='has-comments wide'", "class='overflow-hidden'", "data-note='hidden gem'", "aria-hidden=false"):
        assert html.main_text(f"<div {attrs}><p>{text}</p></div>", tree) == text
    for attrs in ("class='share'", "id=main-comments class='post with-banner'", "role=main"):
        assert html.main_text(f"<article {attrs}><p>{text}</p></article>", tree) == text
        assert html.main_text(f"<main {attrs}><p>{text}</p></main>", tree) == text
    for attrs in ("class='site-footer'", "class='wide sidebar'", "id='ad-slot-2'", "hidden", "style='display: none'", "aria-hidden='true'"):
        assert html.main_text(f"<div {attrs}><p>{text}</p></div>", tree) == ""


def test_licenses(spark, sets, odd):
    extra = [(1, "x " * 30 + "This work is licensed under the GNU General Public License, version 3."), (2, "Licensed under the Apache License, Version 2.0"), (3, "CC BY cc by"), (4, None), (5, "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction"), (6, "apache license")]
    table = spark.createDataFrame(extra, "doc_id long, text string")
    for docs, df in [*sets, (extra, table)]:
        got = {r.doc_id: r for r in licenses.scan_licenses(df).collect()}
        for d, t in docs:
            r = got[d]
            assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute.license_places(t)
            assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1
    assert got[1].labels == "gpl,gpl-3.0" and got[2].labels == "apache,apache-2.0" and got[5].labels == "mit" and got[5].base_labels == "" and got[6].labels == "apache"
    assert got[4].labels == "" and got[4].n_words == 0
    assert licenses.scan_licenses(odd[1].limit(0)).count() == 0


def test_names():
    assert [sum(q.startswith(f"op{n}_") for q in queries()) for n in range(1, 11)] == [1] * 10


def test_repeated_bytes_odd_ids_and_split_anchors(spark, monkeypatch):
    """Equal ids with different texts, an anchor dealt out string by string, a long text in several blocks; all by the sort."""
    rng = random.Random(9)
    phrase, tail = "a phrase of the house style", prose(rng, 30)
    rows = [(2, tail + " one"), (2, prose(rng, 40)), (1, tail + " two"), (2, tail + " three")]
    rows += [(10 + i, f"{prose(rng, 12)} {phrase} {prose(rng, 12)}" + (tail[:70] if i % 3 else "")) for i in range(60)]
    rows += [(80, "x".join(prose(rng, 300) for _ in range(6))), (81, "y" + prose(rng, 200) + tail)]
    rows += [(82, rows[-2][1][700:9000]), (83, rows[5][1]), (84, rows[5][1] + "!")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    first = {}
    for d, t in sorted(rows):
        for i in range(len(t) - 49):
            first.setdefault(t[i : i + 50], d)
    want = []
    for d, t in rows:
        gone = {j for i in range(len(t) - 49) if first[t[i : i + 50]] < d for j in range(i, i + 50)}
        want.append((d, len(t), "".join(c for i, c in enumerate(t) if i not in gone)))

    def got():
        return sorted((r.doc_id, r.n_bytes, bytes(r.kept_bytes).decode()) for r in repeated_bytes.remove_repeats(df).collect())

    monkeypatch.setattr(repeated_bytes, "BLOCK", 2_000)
    for many, chunk in ((8_192, 4 << 20), (2, 3_000)):
        monkeypatch.setattr(repeated_bytes, "MANY_CONTENTS", many)
        monkeypatch.setattr(repeated_bytes, "CHUNK_BYTES", chunk)
        monkeypatch.setattr(repeated_bytes, "COMPARED", 20)
        assert got() == sorted(want)


def test_repeats_are_the_verdict_of_the_sort(monkeypatch):
    """Without the sort's order no start is placed, so nothing would be removed."""
    text = b"abcdefghij" * 3
    args = (np.frombuffer(text, np.uint8), np.array([0, 10, 20]), np.array([10, 20, 30]), np.array([3, 3, 3]), np.array([5, 2, 9]), 8)
    at, least = suffix_sort.least_owners(*args)
    assert sorted(at.tolist()) == [0, 1, 2, 10, 11, 12, 20, 21, 22] and set(least.tolist()) == {2}
    monkeypatch.setattr(suffix_sort, "sort_starts", lambda *a: np.empty(0, np.int64))
    assert not len(suffix_sort.least_owners(*args)[0])
