"""MinHash near-duplicates by an inverted join on signature coordinates.

Every distinct shingle set has a MinHash signature.  The (coordinate, value) pairs of
its first coordinates are ordered from rare to common over the corpus; two signatures
that agree in at least t of n coordinates share one of their first n - t + 1 pairs
(prefix filter).  Those are posted under each pair; sorted postings are merged,
collisions are counted over the whole signature, and pairs above the match threshold
are confirmed on the full shingle sets.

The merge has two turns.  First a document is paired with each list's first few members
only (its hubs, the centres of groups of copies).  Then lists that still hold documents
of different components are merged again: every pair of different components is counted
inside the merge, and only pairs above the match threshold leave it.  So no link between
components is lost, and copies that their hubs join cost a multiple of their number.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from packetrisk.llm.components import connected_components
from packetrisk.llm.store import discard, matching, stored
from packetrisk.llm.textops import WordHashes, column, hash_words, mix, signed, slices, space_words, to_bytes, window_docs, window_hashes

#: Slots of the table of posting counts (4 MB): it only sets the order from rare to common, never a result.
SLOTS = 1 << 20
#: Members of a list that its other members are paired with in the first turn.
HUBS = 4
#: Members of a list that one task holds in the second turn; a longer list is dealt out in pairs of such parts.
PART = 2_000
#: Coordinates whose collisions are counted (the first ``coordinates`` of them are posted), and values of what is
#: compared of each (its low half byte: equal values have equal ones, others one in sixteen).
COUNTED, LOW = 768, 16
#: Chance that a pair exactly at the threshold is lost by the prefix filter, and by the count.
MISS = 1e-5


def match_threshold(n: int, similarity: float, miss: float = MISS) -> int:
    """Largest t with P(Binomial(n, similarity) < t) <= miss."""
    below, t = 0.0, 0
    while t < n:
        below += math.comb(n, t) * similarity**t * (1 - similarity) ** (n - t)
        if below > miss:
            return max(1, t)
        t += 1
    return n


def coordinate_factors(n: int, seed: int = 7) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 2**31, n, dtype=np.uint32) * np.uint32(2) + np.uint32(1)


def shingle_sets(docs: list[list[bytes]], k: int, cache: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all documents, one after another, and each document's bounds.

    A document of 1 to k - 1 words has its whole sequence as one shingle.
    """
    hashes, bounds = hash_words(docs, cache)
    doc, inside = window_docs(bounds, k, len(hashes))
    grams, owner = window_hashes(hashes, k)[inside], doc[inside]
    lengths = np.diff(bounds)
    for length in range(1, k):
        short = np.flatnonzero(lengths == length)
        if len(short):
            rows = hashes[bounds[short][:, None] + np.arange(length)]
            whole = np.array([window_hashes(r, length)[0] for r in rows], dtype=np.uint64)
            grams = np.concatenate([grams, mix(whole ^ np.uint64(length * 0x9E3779B97F4A7C15 & (2**64 - 1)))])
            owner = np.concatenate([owner, short])
    order = np.lexsort((grams, owner))
    grams, owner = grams[order], owner[order]
    first = np.ones(len(grams), dtype=bool)
    first[1:] = (grams[1:] != grams[:-1]) | (owner[1:] != owner[:-1])
    grams, owner = grams[first], owner[first]
    out = np.zeros(len(docs) + 1, dtype=np.int64)
    np.cumsum(np.bincount(owner, minlength=len(docs)), out=out[1:])
    return grams, out


def signatures(sets: np.ndarray, bounds: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """MinHash signatures (documents x coordinates) of non-empty sets; blocks keep the work inside the cache."""
    out = np.empty((len(bounds) - 1, len(factors)), dtype=np.uint32)
    a = 0
    while a < len(bounds) - 1:
        b = max(a + 1, int(np.searchsorted(bounds, bounds[a] + 40_000, side="right")) - 1)
        part, starts = (sets[bounds[a] : bounds[b]] >> np.uint64(32)).astype(np.uint32), bounds[a:b] - bounds[a]
        turned = np.empty_like(part)
        for i, f in enumerate(factors):
            np.multiply(part, f, out=turned)
            out[a:b, i] = np.minimum.reduceat(turned, starts)
        a = b
    return out


def half_bytes(sig: np.ndarray) -> bytes:
    """The low half bytes of a signature, two in a byte."""
    low = (sig & np.uint32(LOW - 1)).astype(np.uint8)
    return (low[0::2] << 4 | low[1::2]).tobytes()


def collisions(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Number of equal half bytes in each row of two arrays of packed half bytes."""
    differ = x ^ y
    return np.count_nonzero(differ & 0xF0 == 0, axis=-1) + np.count_nonzero(differ & 0x0F == 0, axis=-1)


def posting_pairs(sig: np.ndarray) -> np.ndarray:
    """The (coordinate, value) pairs of signatures as 64-bit keys."""
    return mix((np.arange(sig.shape[1], dtype=np.uint64) << np.uint64(32))[None, :] | sig.astype(np.uint64))


def _signature_rows(docs: DataFrame, k: int, n: int, counted: int) -> DataFrame:
    """doc_id, set size, two set hashes, the ``n`` posted coordinates, and the low half bytes of all ``counted`` ones."""
    factors = coordinate_factors(counted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHashes()
        for whole in batches:
            for batch in slices(whole, "__text"):
                sets, bounds = shingle_sets([space_words(t.lower()) for t in to_bytes(column(batch, "__text"))], k, cache)
                sizes = np.diff(bounds)
                full = np.flatnonzero(sizes)
                sig: list[bytes | None] = [None] * batch.num_rows
                low: list[bytes | None] = [None] * batch.num_rows
                for i, s in zip(full.tolist(), signatures(sets, np.append(bounds[full], len(sets)), factors)):
                    sig[i], low[i] = s[:n].tobytes(), half_bytes(s)
                sums = [np.concatenate([[np.uint64(0)], np.cumsum(mix(sets ^ np.uint64(c)))]) for c in (0x243F6A8885A308D3, 0x13198A2E03707344)]
                keys = [signed(s[bounds[1:]] - s[bounds[:-1]]) for s in sums]
                yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), pa.array(sizes), pa.array(keys[0]), pa.array(keys[1]), pa.array(sig, pa.binary()), pa.array(low, pa.binary())], names=["doc_id", "n", "k1", "k2", "sig", "low"])

    return docs.mapInArrow(run, "doc_id long, n long, k1 long, k2 long, sig binary, low binary")


def _slot_counts(sigs: DataFrame, n: int) -> np.ndarray:
    """How often pairs of each slot occur over all signatures; at most SLOTS numbers, summed by Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(SLOTS, dtype=np.int64)
        for batch in batches:
            sig = np.frombuffer(b"".join(column(batch, "sig").to_pylist()), dtype=np.uint32).reshape(-1, n)
            counts += np.bincount((posting_pairs(sig) & np.uint64(SLOTS - 1)).ravel().astype(np.int64), minlength=SLOTS)
        slot = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(slot), pa.array(counts[slot])], names=["slot", "c"])

    total = sigs.select("sig").mapInArrow(run, "slot long, c long").groupBy("slot").agg(F.sum("c").alias("c"))
    table, counts = total.toArrow(), np.zeros(SLOTS, dtype=np.int64)
    counts[table.column("slot").to_numpy()] = table.column("c").to_numpy()
    return counts


def _postings(sigs: DataFrame, n: int, prefix: int, counts: np.ndarray) -> DataFrame:
    """(token, vid, n, common): the ``prefix`` rarest pairs of every signature; pairs that cannot occur twice are left out.

    ``common`` is higher for a signature of common values: the source of a group of copies has the group's majority values.
    """
    shared = sigs.sparkSession.sparkContext.broadcast(counts.astype(np.int32).clip(max=2**31 - 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = shared.value
        for batch in batches:
            pairs = posting_pairs(np.frombuffer(b"".join(column(batch, "sig").to_pylist()), dtype=np.uint32).reshape(-1, n))
            often = counts[(pairs & np.uint64(SLOTS - 1)).astype(np.int64)]
            for a in range(0, len(pairs), 1000):
                p, o = pairs[a : a + 1000], often[a : a + 1000]
                common = (np.log2(1.0 + o).sum(axis=1) * 16).astype(np.int32)
                order = np.lexsort((p, o), axis=1)[:, :prefix]
                p, o = np.take_along_axis(p, order, 1), np.take_along_axis(o, order, 1)
                row, col = np.nonzero(o > 1)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(signed(p[row, col])), column(batch, "vid").take(pa.array(row + a)), column(batch, "n").take(pa.array(row + a)), pa.array(common[row])], names=["token", "vid", "n", "common"]
                )

    return sigs.select("vid", "n", "sig").mapInArrow(run, "token long, vid long, n long, common int")


def _merge(postings: DataFrame, ratio: float) -> DataFrame:
    """Stream sorted posting lists: (a, b, null, null) pairs with each list's hubs, and (null, vid, n, token) of longer lists.

    Members come in one order over all lists, those of the most common values (centres of groups) first, so
    that lists of the same documents have the same hubs.  State is one list's hubs.
    """
    most = HUBS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token, hubs, size = None, [], 0
        for batch in batches:
            pairs, rest = [], []
            for t, v, n in zip(*(column(batch, x).to_pylist() for x in ("token", "vid", "n"))):
                if t != token:
                    token, hubs, size = t, [], 0
                for h, hn in hubs:
                    if min(n, hn) >= ratio * max(n, hn):
                        pairs.append((h, v) if h < v else (v, h))
                size += 1
                if size <= most:
                    hubs.append((v, n))
                else:
                    if size == most + 1:
                        rest += [(h, hn, t) for h, hn in hubs]
                    rest.append((v, n, t))
            pairs = list(dict.fromkeys(pairs))
            a, b = zip(*pairs) if pairs else ((), ())
            v, n, t = zip(*rest) if rest else ((), (), ())
            none, gap = [None] * len(v), [None] * len(a)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in ([*a, *none], [*b, *v], [*gap, *n], [*gap, *t])], names=["a", "b", "n", "token"])

    ready = postings.repartition("token").sortWithinPartitions("token", F.col("common").desc(), "vid")
    return ready.select("token", "vid", "n").mapInArrow(run, "a long, b long, n long, token long")


def _open_lists(long: DataFrame, comps: DataFrame) -> DataFrame:
    """(vid, n, comp, lists): documents with the posting lists (token, size) that hold several components."""
    of_docs = long.groupBy(F.col("b").alias("vid"), "n").agg(F.collect_list("token").alias("tokens"))
    of_docs = of_docs.join(comps.withColumnRenamed("node", "vid"), "vid", "left").withColumn("comp", F.coalesce("component", "vid"))
    rows = of_docs.select("vid", "n", "comp", F.explode("tokens").alias("token"))
    whole = Window.partitionBy("token")
    rows = rows.withColumn("several", F.min("comp").over(whole) < F.max("comp").over(whole)).withColumn("size", F.count("*").over(whole)).where("several")
    return rows.groupBy("vid", "n", "comp").agg(F.collect_list(F.struct("token", "size")).alias("lists"))


def _counted_pairs(members: DataFrame, ratio: float, least: int) -> DataFrame:
    """(a, b) of different components that agree in at least ``least`` coordinates and share one of the lists.

    A pair leaves the first of the lists that both share, so it leaves once.  A list of up to PART members is merged in one task.  A longer one is dealt out by pairs of its parts, so a
    task holds two parts at most, whatever the list.
    """
    part = PART
    members = members.withColumn("tokens", F.transform("lists", lambda x: x["token"]))
    lists = members.select("vid", "n", "comp", "low", "tokens", F.explode("lists").alias("l")).select("vid", "n", "comp", "low", "tokens", "l.*")
    parts = F.ceil(F.col("size") / part).cast("int")
    own = F.pmod(F.xxhash64("vid"), parts).cast("int")
    cells = F.transform(F.sequence(F.lit(0), parts - 1), lambda i: F.struct(F.least(own, i).alias("i"), F.greatest(own, i).alias("j")))
    rows = lists.select("token", "vid", "n", "comp", "low", "tokens", own.alias("own"), F.explode(cells).alias("cell")).select("token", "cell.i", "cell.j", "own", "vid", "n", "comp", "low", "tokens")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def close() -> pa.RecordBatch:
            own, vid, n, comp = (np.array(x, dtype=np.int64) for x in list(zip(*held))[:4])
            low = np.frombuffer(b"".join(h[4] for h in held), np.uint8).reshape(len(held), -1)
            tokens, found = [set(h[5]) for h in held], [np.empty((0, 2), np.int64)]
            if now[1] == now[2]:  # all pairs of one part: rows outside its largest component with all others
                names, where, many = np.unique(comp, return_inverse=True, return_counts=True)
                left, right = np.flatnonzero(where != np.argmax(many)), np.arange(len(vid))
            else:
                left, right = np.flatnonzero(own == now[1]), np.flatnonzero(own == now[2])
            for i in left.tolist():
                at = right[(comp[right] != comp[i]) & (np.minimum(n[right], n[i]) >= ratio * np.maximum(n[right], n[i]))]
                at = at[collisions(low[at], low[i]) >= least]
                at = np.array([x for x in at.tolist() if min(tokens[i] & tokens[x]) == now[0]], dtype=np.int64)
                if len(at):
                    pair = np.column_stack([np.full(len(at), vid[i]), vid[at]])
                    found.append(np.sort(pair, axis=1))
            held.clear()
            pairs = np.unique(np.concatenate(found), axis=0)
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

        for batch in batches:
            for t, i, j, *row in zip(*(column(batch, c).to_pylist() for c in ("token", "i", "j", "own", "vid", "n", "comp", "low", "tokens"))):
                if held and now != (t, i, j):
                    yield close()
                now = t, i, j
                held.append(row)
        if held:
            yield close()

    dealt = rows.repartition("token", "i", "j").sortWithinPartitions("token", "i", "j")
    return dealt.mapInArrow(run, "a long, b long")


def _colliding(pairs: DataFrame, classes: DataFrame, least: int) -> DataFrame:
    """Pairs (a, b) whose signatures agree in at least ``least`` coordinates.

    Half bytes of the coordinates are compared: equal values have equal ones, so no pair is lost, and an eighth travels.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(column(batch, c).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for c in ("sa", "sb"))
            yield batch.select(["a", "b"]).take(pa.array(np.flatnonzero(collisions(x, y) >= least)))

    left, right = (classes.select(F.col("vid").alias(s), F.col("low").alias(f"s{s}")) for s in "ab")
    return pairs.join(right, "b").join(left, "a").select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long")


def _confirmed(pairs: DataFrame, docs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """Table of the pairs with den * intersection >= num * union on full sets; the sets are deleted once compared."""
    ids = stored(pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct())

    def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHashes()
        for whole in batches:
            for batch in slices(whole, "__text"):
                sets, bounds = shingle_sets([space_words(t.lower()) for t in to_bytes(column(batch, "__text"))], k, cache)
                full, raw = np.flatnonzero(np.diff(bounds)), sets.tobytes()
                yield pa.RecordBatch.from_arrays([column(batch, "doc_id").take(pa.array(full)), pa.array([raw[8 * bounds[i] : 8 * bounds[i + 1]] for i in full.tolist()], pa.binary())], names=["vid", "members"])

    sides = stored(matching(docs, ids, "doc_id").mapInArrow(sets_of, "vid long, members binary"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for i, (ma, mb) in enumerate(zip(column(batch, "ma").to_pylist(), column(batch, "mb").to_pylist())):
                both = np.sort(np.concatenate([np.frombuffer(ma, np.uint64), np.frombuffer(mb, np.uint64)]))
                common = int(np.count_nonzero(both[1:] == both[:-1]))
                if den * common >= num * (len(both) - common):
                    good.append(i)
            yield batch.select(["a", "b"]).take(pa.array(good, pa.int64()))

    left, right = (sides.select(F.col("vid").alias(s), F.col("members").alias(f"m{s}")) for s in "ab")
    good = stored(pairs.join(right, "b").join(left, "a").select("a", "b", "ma", "mb").mapInArrow(compare, "a long, b long"))
    discard(ids, sides)
    return good


def near_duplicates(df: DataFrame, k: int = 5, threshold: tuple[int, int] = (80, 100), coordinates: int = 128, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id (smallest id reachable by links) and kept.

    Two documents are linked when den * |A and B| >= num * |A or B| for their sets of distinct k-word
    shingles (A-Z lower-cased, white space between words).  A text of 1 to k - 1 words has its whole
    sequence as one shingle; a null or empty text has none and is linked with nothing.  Documents with
    equal sets are one class and take part once.  Rows that share an id are one document of all their
    links; a row with a null id is kept, has no component and links with nothing.  Other columns are
    ignored; an empty table gives no rows.
    """
    num, den = threshold
    ratio = num / den
    prefix = coordinates - match_threshold(coordinates, ratio) + 1
    counted = max(COUNTED, coordinates + coordinates % 2)
    least = match_threshold(counted, ratio + (1 - ratio) / LOW)
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("__text"))
    rows = _signature_rows(docs, k, coordinates, counted)
    rows = stored(rows.select("doc_id", "n", "k1", "k2", *(F.when(F.col("doc_id").isNotNull(), F.col(c)).alias(c) for c in ("sig", "low"))))
    full = rows.where("sig is not null")
    classes = stored(full.groupBy("n", "k1", "k2").agg(F.min("doc_id").alias("vid"), F.first("sig").alias("sig"), F.first("low").alias("low")))
    merged = stored(_merge(_postings(classes, coordinates, prefix, _slot_counts(classes, coordinates)), ratio))
    pairs = stored(merged.where("token is null").select("a", "b").distinct())
    near = stored(_colliding(pairs, classes, least))
    links = _confirmed(near, docs, k, num, den)
    comps = stored(connected_components(links))
    opened = stored(_open_lists(merged.where("token is not null"), comps))
    discard(merged, pairs)
    if opened.limit(1).count():
        more = stored(_counted_pairs(opened.join(classes.select("vid", "low"), "vid"), ratio, least).join(near, ["a", "b"], "left_anti"))
        found = _confirmed(more, docs, k, num, den)
        stars = comps.where("node <> component").select(F.col("node").alias("a"), F.col("component").alias("b"))
        joined = stored(connected_components(stars.union(found)))
        discard(more, found, comps)
        comps = joined
    discard(near, opened, links)
    member = classes.select("n", "k1", "k2", "vid").join(comps.withColumnRenamed("node", "vid"), "vid", "left").select("n", "k1", "k2", F.coalesce("component", "vid").alias("class_id"))
    out = rows.select("doc_id", "n", "k1", "k2", F.col("sig").isNotNull().alias("full")).join(member, ["n", "k1", "k2"], "left")
    component = F.when(F.col("full"), F.col("class_id")).otherwise(F.col("doc_id"))
    out = stored(out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id")))
    discard(rows, classes, comps)
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def op5_coordinate_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), k=3, threshold=(85, 100))
