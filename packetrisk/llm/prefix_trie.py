"""A z-fast trie of conversations: which turns they share from the start, and what sharing them saves.

A conversation is a string whose symbols are turns; the hash of its first d turns stands for that prefix.
The trie keeps compacted nodes only.  A node's edge covers the depths (p, e]; it is filed under its handle, the prefix
whose depth is the 2-fattest number of (p, e] (the one that most powers of two divide).  A conversation finds where it leaves
the trie by a fat binary search: a number of hash look-ups (joins) logarithmic in its length.  Conversations go in batches:
of those that leave at one place with one next turn, one becomes a new edge and the others search on
from there.  At last every edge is expanded into the nodes of its depths.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from packetrisk.llm.store import discard, stored
from packetrisk.llm.textops import column

#: Stands for the empty prefix.
ROOT = bytes(16)
#: First turns that a conversation can take over from another.
SHARED_TURNS = 8
#: Ids that one row of a node's member list holds.
LIST_IDS = 20_000

NODE = ["p", "e", "up", "seg", "segb", "sid"]


def turns_of(chats: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, turns): each conversation's turns as (digest of role and text, UTF-8 bytes of the text), in order.

    Ordered by turn (null first), then role, then text; a null role or text is empty; rows without a
    conversation belong to none and are left out.
    """
    rows = chats.where(F.col(conv).isNotNull()).select(
        F.col(conv).cast("long").alias("conv_id"), F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text")
    )
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", F.asc_nulls_first("turn"), "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, digests, sizes, done = None, [], [], []

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([
                pa.array([d[0] for d in done], pa.int64()), pa.array([d[1] for d in done], pa.list_(pa.binary())), pa.array([d[2] for d in done], pa.list_(pa.int64())),
            ], names=["conv_id", "digests", "sizes"])
            done.clear()
            return out

        held = 0
        for batch in batches:
            for c, r, t in zip(*(column(batch, c).to_pylist() for c in ("conv_id", "role", "text"))):
                if digests and c != now:
                    done.append((now, digests, sizes))
                    held += len(digests)
                    digests, sizes = [], []
                    if held > 50_000:
                        yield flush()
                        held = 0
                now = c
                who, what = r.encode("utf-8", "surrogatepass"), t.encode("utf-8", "surrogatepass")
                digests.append(hashlib.sha256(b"%d:" % len(who) + who + what).digest()[:16])
                sizes.append(len(what))
        if digests:
            done.append((now, digests, sizes))
        if done:
            yield flush()

    return rows.mapInArrow(run, "conv_id long, digests array<binary>, sizes array<long>")


def rebuilt(turns: DataFrame) -> DataFrame:
    """Conversation c with the first h turns of conversation c - c % 5 in place of its own first h; h = crc32(c as text) % 9.

    All turns of the other where it has fewer, none where it is absent; % is SQL's (the remainder has the sign of c).
    """
    h = (F.crc32(F.col("conv_id").cast("string")) % (SHARED_TURNS + 1)).cast("int")
    base = F.col("conv_id") - F.col("conv_id") % 5
    heads = turns.where("conv_id % 5 = 0").select(F.col("conv_id").alias("__base"), *(F.slice(c, 1, SHARED_TURNS).alias(f"__{c}") for c in ("digests", "sizes")))
    joined = turns.withColumns({"__h": h, "__b": base}).join(heads, F.col("__b") == F.col("__base"), "left")
    part = lambda c, kind: F.concat(F.coalesce(F.slice(f"__{c}", F.lit(1), F.col("__h")), F.array().cast(kind)), F.slice(c, F.col("__h") + 1, F.greatest(F.size(c), F.lit(1))))
    return joined.select("conv_id", part("digests", "array<binary>").alias("digests"), part("sizes", "array<long>").alias("sizes"))


def prefixes(conversations: DataFrame) -> DataFrame:
    """(conv_id, x, b): the hashes of a conversation's prefixes of 1, 2, ... turns, and the turns' bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            chains = []
            for digests in column(batch, "digests").to_pylist():
                now, chain = ROOT, []
                for d in digests:
                    now = hashlib.sha256(now + d).digest()[:16]
                    chain.append(now)
                chains.append(chain)
            yield pa.RecordBatch.from_arrays([column(batch, "conv_id"), pa.array(chains, pa.list_(pa.binary())), column(batch, "sizes")], names=["conv_id", "x", "b"])

    return conversations.mapInArrow(run, "conv_id long, x array<binary>, b array<long>")


def _fattest(a: str, b: str) -> str:
    """The number of (a, b] that the largest power of two divides, as SQL; for columns or numbers 0 <= a < b."""
    return f"(shiftleft(-1, length(bin(cast({a} ^ {b} as bigint))) - 1) & ({b}))"


def _at(x: str, depth: Column | str) -> Column:
    """Hash of the prefix of a depth; the root's for 0."""
    d = F.col(depth) if isinstance(depth, str) else depth
    return F.when(d > 0, F.try_element_at(F.col(x), d.cast("int"))).otherwise(F.lit(ROOT))


def _edges(nodes: DataFrame, key: Column, depth: Column) -> DataFrame:
    return nodes.where("e > 0").select(depth.alias("__d"), key.alias("__k"), F.col("p").alias("__p"), F.col("e").alias("__e"), F.col("seg").alias("__seg"))


def _locate(pending: DataFrame, nodes: DataFrame, probes: int) -> DataFrame:
    """``pending`` with m, the depth to which each string follows the trie, and cut, the end of the edge inside which it leaves (null at a node).

    ``lo``: depth of the deepest node known to be on the string's way; every probe looks up the handle that lies
    2-fattest between ``lo`` and ``hi``.  A row that has been placed looks up its own end at depth -1, which no edge has.
    """
    # hits are followed along the edge: equal prefix hashes, one for each depth
    same = F.expr("size(filter(sequence(1, least(__e, len) - __p), i -> __seg[i - 1] = x[__p + i - 1]))")
    hit, ends = F.col("__k").isNotNull(), F.element_at("__seg", -1)
    state = pending.withColumns({"lo": F.col("at"), "hi": F.col("len"), "m": F.lit(None).cast("int"), "cut": F.lit(None).cast("binary")})
    files = _edges(nodes.withColumn("__f", F.when(F.col("e") > 0, F.expr(_fattest("p", "e")))), F.try_element_at("seg", F.expr("__f - p")), F.col("__f"))
    names = _edges(nodes, F.try_element_at("seg", F.lit(1)), F.col("p") + 1)
    for _ in range(probes):
        open_ = F.expr("m is null and lo < hi")
        state = state.withColumn("__f", F.when(open_, F.expr(_fattest("lo", "hi"))).otherwise(-1))
        state = state.withColumn("__want", F.when(F.col("__f") > 0, _at("x", "__f")).otherwise(F.col("end")))
        state = state.join(files, F.expr("__f = __d and __want = __k"), "left").withColumn("__m", F.when(hit, F.col("__p") + same))
        whole = F.col("__m") == F.col("__e")
        state = state.withColumns({
            "lo": F.when(hit & whole, F.col("__e")).otherwise(F.col("lo")), "hi": F.when((F.col("__f") > 0) & ~hit, F.col("__f") - 1).otherwise(F.col("hi")),
            "m": F.when(hit & ~whole, F.col("__m")).otherwise(F.col("m")), "cut": F.when(hit & ~whole, ends).otherwise(F.col("cut")),
        }).drop("__f", "__want", "__d", "__k", "__p", "__e", "__seg", "__m")
    # what is left stands at a node; the edge of its next turn, if there is one, is left before the handle
    next_ = F.expr("m is null and lo < len")
    state = state.withColumn("__f", F.when(next_, F.col("lo") + 1).otherwise(-1)).withColumn("__want", F.when(next_, _at("x", F.col("lo") + 1)).otherwise(F.col("end")))
    state = state.join(names, F.expr("__f = __d and __want = __k"), "left")
    return state.select(*pending.columns, F.coalesce("m", F.when(hit, F.col("__p") + same), "lo").alias("m"), F.coalesce("cut", F.when(hit, ends)).alias("cut"))


def _insert(nodes: DataFrame, placed: DataFrame) -> DataFrame:
    """``nodes`` with edges cut where strings leave or end inside them, and one new edge for each next turn of each place."""
    cuts = placed.where("cut is not null").groupBy("cut").agg(F.array_sort(F.collect_set("m")).alias("ms"))
    marked = nodes.join(cuts, _at("seg", F.size("seg")) == F.col("cut"), "left")
    whole = marked.where("ms is null").select(*NODE)
    pieces = marked.where("ms is not null").select("*", F.explode(F.expr("transform(concat(ms, array(e)), (m, i) -> struct(if(i = 0, p, concat(ms, array(e))[i - 1]) as a, m as z))")).alias("c"))
    pieces = pieces.select(
        F.col("c.a").alias("p"), F.col("c.z").alias("e"), F.when(F.expr("c.a = p"), F.col("up")).otherwise(F.expr("try_element_at(seg, c.a - p)")).alias("up"),
        *(F.expr(f"slice({c}, c.a - p + 1, c.z - c.a)").alias(c) for c in ("seg", "segb")), "sid",
    )
    firsts = placed.where("m < len").groupBy(_at("x", F.col("m") + 1).alias("name")).agg(F.min_by(F.struct("x", "b", "len", "m", "sid"), "sid").alias("s")).select("s.*")
    leaves = firsts.select(F.col("m").alias("p"), F.col("len").alias("e"), _at("x", "m").alias("up"), F.expr("slice(x, m + 1, len - m)").alias("seg"), F.expr("slice(b, m + 1, len - m)").alias("segb"), "sid")
    return whole.unionByName(pieces).unionByName(leaves)


def build_trie(strings: DataFrame) -> DataFrame:
    """Compacted nodes (p, e, up, seg, segb, sid) of the distinct strings (sid, x, b, len, end).

    ``seg`` and ``segb``: prefix hashes and bytes of the edge's depths; ``up``: hash of the parent's prefix; ``sid``: the string
    that brought the edge.  The root has e = 0.  Each batch settles at least one more edge on the way of every string, so
    there are at most as many batches as edges on the longest way.
    """
    spark = strings.sparkSession
    longest = strings.agg(F.max("len")).first()[0]
    root = spark.range(1).select(F.lit(-1).alias("p"), F.lit(0).alias("e"), F.lit(None).cast("binary").alias("up"), F.array().cast("array<binary>").alias("seg"), F.array().cast("array<long>").alias("segb"), F.lit(None).cast("long").alias("sid"))
    pending, nodes, batch = strings.select("sid", "x", "b", "len", "end").withColumn("at", F.lit(0)), root, 0
    while longest:
        # the first batch meets the root alone
        placed = stored(_locate(pending, nodes, longest.bit_length()) if batch else pending.withColumns({"m": F.lit(0), "cut": F.lit(None).cast("binary")}))
        before, nodes, batch = nodes, stored(_insert(nodes, placed)), batch + 1
        discard(before if batch > 1 else None)
        rest = stored(placed.where("m < len").join(nodes.select("sid").distinct(), "sid", "left_anti").withColumn("at", F.col("m")).drop("m", "cut"))
        discard(placed, pending if batch > 1 else None)
        pending = rest
        if pending.isEmpty():
            break
    return nodes


def _ways(strings: DataFrame) -> DataFrame:
    """What each string adds to every node on its way (key): members, smallest member, leaves, and saved bytes.

    A node's saved bytes are those of its members' turns from its depth on, less those of the distinct nodes below:
    each of these came with one string (at depths beyond ``m``).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, sizes = column(batch, "x").to_pylist(), column(batch, "b").to_pylist()
            many = np.array([len(k) + 1 for k in keys], dtype=np.int64)
            gains = []
            for b, n, m in zip(sizes, column(batch, "n").to_pylist(), column(batch, "m").to_pylist()):
                own = np.array([0, *b], dtype=np.int64)
                new = np.where(np.arange(len(own)) > m, own, 0)
                gains.append(n * own[::-1].cumsum()[::-1] - new[::-1].cumsum()[::-1])
            repeat = lambda c: pa.array(np.repeat(column(batch, c).to_numpy(zero_copy_only=False), many))
            yield pa.RecordBatch.from_arrays(
                [pa.array([h for k in keys for h in (ROOT, *k)], pa.binary()), repeat("n"), repeat("sid"), repeat("leaf"), pa.array(np.concatenate(gains) if gains else [], pa.int64())], names=["key", "n", "sid", "leaf", "gain"]
            )

    rows = strings.select("x", "b", "n", "sid", "m", "leaf").mapInArrow(run, "key binary, n long, sid long, leaf long, gain long")
    return rows.groupBy("key").agg(F.sum("n").alias("n_convs"), F.min("sid").alias("conv"), F.sum("leaf").alias("n_leaves"), F.sum("gain").alias("saved"))


def _member_digests(ends: DataFrame) -> DataFrame:
    """(end, ends_sha256): digest of the ids that end at each prefix, ascending and comma-joined.

    Ids are sorted in ranges and joined in parts, so that the last task of a node with many members reads parts only.
    """
    ordered = ends.select("end", "conv_id").repartitionByRange("end", "conv_id").sortWithinPartitions("end", "conv_id")

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids = None, []
        made = lambda: pa.RecordBatch.from_arrays([pa.array([now], pa.binary()), pa.array([ids[0]], pa.int64()), pa.array([",".join(map(str, ids))])], names=["end", "first", "ids"])
        out = []
        for batch in batches:
            for end, c in zip(column(batch, "end").to_pylist(), column(batch, "conv_id").to_pylist()):
                if ids and (end != now or len(ids) >= LIST_IDS):
                    out.append(made())
                    ids.clear()
                now = end
                ids.append(c)
            if out:
                yield from pa.Table.from_batches(out).combine_chunks().to_batches()
                out = []
        if ids:
            yield made()

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, digest = None, None
        for batch in batches:
            done = []
            for end, ids in zip(column(batch, "end").to_pylist(), column(batch, "ids").to_pylist()):
                if end == now:
                    digest.update(b",")
                else:
                    if digest is not None:
                        done.append((now, digest.hexdigest()))
                    now, digest = end, hashlib.sha256()
                digest.update(ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.binary()), pa.array([d[1] for d in done], pa.string())], names=["end", "ends_sha256"])
        if digest is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now], pa.binary()), pa.array([digest.hexdigest()])], names=["end", "ends_sha256"])

    cut = ordered.mapInArrow(parts, "end binary, first long, ids string")
    return cut.repartition("end").sortWithinPartitions("end", "first").mapInArrow(joined, "end binary, ends_sha256 string")


def _expanded(nodes: DataFrame) -> DataFrame:
    """One row for each depth of each edge: inside an edge members and leaves are those of its end, and there is one child."""
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    none = hashlib.sha256(b"").hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in names]
            for p, e, b, n, conv, leaves, saved, above, kids, ends in zip(*(column(batch, c).to_pylist() for c in ("p", "e", "segb", "n_convs", "conv", "n_leaves", "saved", "above", "kids", "ends_sha256"))):
                depths = range(e, p, -1)  # the root's edge (-1, 0] has no bytes
                more = saved
                for i, d in enumerate(depths):
                    more += (n - 1) * b[d - p - 1] if i else 0
                    for values, value in zip(out, (conv, d, above if d == p + 1 else conv, n, 1 if i else kids, leaves, more, none if i else ends or none)):
                        values.append(value)
            kinds = [pa.int64()] * 7 + [pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out, kinds)], names=names)

    return nodes.mapInArrow(run, ", ".join(f"{c} long" for c in names[:-1]) + ", ends_sha256 string")


def trie_nodes(conversations: DataFrame) -> DataFrame:
    """One row per node of the prefix trie of (conv_id, digests, sizes): conv_id (smallest member), depth, parent_conv_id,
    n_convs, n_children, n_leaves, saved_tokens and ends_sha256.

    A conversation's digests (16 bytes a turn) are held in one row.  Equal conversations are one string with several
    members; a conversation without turns ends at the root; no conversations give no rows.
    """
    members = stored(prefixes(conversations).withColumn("end", _at("x", F.size("x"))))
    strings = members.groupBy("end").agg(F.min("conv_id").alias("sid"), F.count("*").alias("n"), F.min_by("x", "conv_id").alias("x"), F.min_by("b", "conv_id").alias("b"))
    strings = stored(strings.withColumn("len", F.size("x")))
    if strings.isEmpty():
        return conversations.sparkSession.createDataFrame([], "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string")
    nodes = build_trie(strings)
    kids = nodes.where("e > 0").groupBy(F.col("up").alias("__up")).agg(F.count("*").alias("kids"))
    brought = nodes.where("e > 0").groupBy(F.col("sid").alias("__sid")).agg(F.min("p").alias("__m"))
    ways = strings.join(brought, F.col("sid") == F.col("__sid"), "left").join(kids, F.col("end") == F.col("__up"), "left")
    ways = _ways(ways.withColumns({"m": F.coalesce("__m", "len").cast("long"), "leaf": F.col("__up").isNull().cast("long")}))
    known = nodes.withColumn("ext", _at("seg", F.size("seg")))
    # only compacted nodes go on; the nodes inside their edges follow from them
    known = stored(known.join(ways, F.col("ext") == F.col("key")).drop("key"))
    above = known.select(F.col("ext").alias("__ext"), F.col("conv").alias("above"))
    full = known.join(above, F.col("up") == F.col("__ext"), "left").join(kids, F.col("ext") == F.col("__up"), "left").join(_member_digests(members), F.col("ext") == F.col("end"), "left")
    return _expanded(full.withColumn("kids", F.coalesce("kids", F.lit(0))))


def op13_zfast_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    chats = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return trie_nodes(rebuilt(stored(turns_of(chats))))
