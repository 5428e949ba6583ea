"""The conversation trie against a plain trie of dictionaries."""

import hashlib
import random
import zlib

import pytest

from packetrisk.llm.prefix_trie import op13_zfast_trie, rebuilt, trie_nodes, turns_of

FIELDS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def rebuild(rows):
    own = {}
    for c, turn, role, text in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        own.setdefault(c, []).append((role or "", text or ""))
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = own.get(c - c % 5, [])[:h] + turns[h:]
    return out


def plain(convs):
    """Rows of FIELDS from {conv: [(role, text), ...]}."""
    members, ends = {}, {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
        ends.setdefault(tuple(turns), []).append(c)
    kids = {}
    for key in members:
        if key:
            kids.setdefault(key[:-1], []).append(key)
    out = []
    for key, ids in members.items():
        below, stack = [], [key]
        while stack:
            k = stack.pop()
            below.append(k)
            stack += kids.get(k, [])
        saved = sum((len(members[k]) - 1) * len(k[-1][1].encode()) for k in below if k)
        listed = ",".join(map(str, sorted(ends.get(key, []))))
        out.append((min(ids), len(key), min(members[key[:-1]]) if key else None, len(ids), len(kids.get(key, [])), sum(k not in kids for k in below), saved, hashlib.sha256(listed.encode()).hexdigest()))
    return sorted(out, key=lambda r: (r[0], r[1], r[3], r[7], r[6]))


def got(df):
    return sorted((tuple(r[f] for f in FIELDS) for r in df.select(FIELDS).collect()), key=lambda r: (r[0], r[1], r[3], r[7], r[6]))


SCHEMA = "conv_id long, turn long, role string, text string, end string, key long, m int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, 2) for r in rows], SCHEMA)


def test_hostile_rows(spark):
    rng = random.Random(5)
    rows = [(c, t, rng.choice(["user", None, "assistant"]), rng.choice(["a", "bb", "", None, "ccc é"])) for c in range(60) for t in range(rng.randrange(1, 12))]
    rows += [(c, t, "user", "same") for c in range(100, 160) for t in range(40)]  # long copies
    rows += [(200, None, "user", "late"), (200, 3, "user", "x"), (200, 3, "user", "x"), (200, 3, "assistant", "x"), (None, 0, "user", "no conversation"), (None, None, None, None)]
    rows += [(300, t, "user", "long " * 2000) for t in range(3)]
    rng.shuffle(rows)
    assert got(trie_nodes(rebuilt(turns_of(frame(spark, rows))))) == plain(rebuild(rows))


@pytest.mark.parametrize("seed", range(3))
def test_random_strings(spark, seed):
    """Deep tries with splits inside edges, ends inside edges, and many strings that leave at one place."""
    rng = random.Random(seed)
    convs, pool = {}, [[]]
    for c in range(150):
        base = rng.choice(pool)
        turns = base[: rng.randrange(len(base) + 1)] + [("u", rng.choice("abc")) for _ in range(rng.randrange(0, 25 if seed else 4))]
        convs[c] = turns
        pool.append(turns)
    digest = lambda t: hashlib.sha256(repr(t).encode()).digest()[:16]
    df = spark.createDataFrame([(c, [digest(t) for t in ts], [len(t[1]) for t in ts]) for c, ts in convs.items()], "conv_id long, digests array<binary>, sizes array<long>")
    assert got(trie_nodes(df)) == plain(convs)


def test_empty(spark):
    assert got(trie_nodes(rebuilt(turns_of(frame(spark, []))))) == []
    only_null = frame(spark, [(None, 1, "user", "x")])
    assert got(trie_nodes(rebuilt(turns_of(only_null)))) == []


def test_turnless(spark):
    """A conversation whose turns all give way to an absent one ends at the root."""
    c = next(c for c in range(1, 50) if c % 5 and zlib.crc32(str(c).encode()) % 9 > 2)
    rows = [(c, 0, "user", "a"), (c, 1, "user", "b")]
    out = got(trie_nodes(rebuilt(turns_of(frame(spark, rows)))))
    assert out == plain(rebuild(rows)) and out[0][1] == 0 and len(out) == 1


def test_whole_table(spark, small):
    rows = [tuple(r) for r in spark.read.parquet(f"{small}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert got(op13_zfast_trie(spark, small)) == plain(rebuild(rows))
