"""Removal of repeated byte strings by two-stage suffix sorting.

Two texts that share a 50-byte string also share its smallest k-gram hash, its anchor.
A fragment is a stretch of text whose 50-byte strings have one anchor.  The work takes
four steps:

1. Equal texts (by SHA-256) are one class; of a class only the rows of its smallest id
   take part, the others are repeats by definition.
2. Anchors are gathered, a few bytes each, to find those that occur in two texts: no
   string of another fragment can repeat.
3. The fragments of those anchors are dealt out by anchor, one copy of equal bytes.
   Their suffixes are sorted in two stages, and neighbours with a common prefix of
   50 bytes give each start the smallest id that holds its string.
4. The verdicts go back to all places of a fragment, and the texts are cut.

An anchor with very many different fragments (a phrase in ever other surroundings) is
dealt out string by string, keyed by the ends of the string, so that no task holds it whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from packetrisk.llm import suffix_sort
from packetrisk.llm.store import discard, small, stored
from packetrisk.llm.textops import column, mix, signed, slices, to_bytes

#: Text bytes that a task hashes at once, and fragments whose suffixes it sorts at once (whole anchors): bounds of task memory.
BLOCK, COMPARED = 1 << 19, 6_000
#: Text bytes of a bucket of anchors and of a chunk of texts (chunks grow beyond MOST_CHUNKS of them).
BUCKET_BYTES, CHUNK_BYTES, MOST_CHUNKS = 8 << 20, 4 << 20, 1_000_000
#: An anchor is dealt out string by string when its fragments show so many values of 16 content bits (about 8,700 different fragments).
MANY_CONTENTS = 8_192

_U = np.uint64
_TABLE = mix(np.arange(1, 257, dtype=np.uint64) * _U(0x9E3779B97F4A7C15))
_BASE = 0xD1342543DE82EF95
#: Bits of a position inside a block: blocks are below 2 MB.
_PLACE = 21
#: Bits of an anchor that travel beside its bucket, and bits of a content.
_KEY, _CONTENT = 39, 16
MEMBER = np.dtype([("row", "<i8"), ("doc", "<i8"), ("begin", "<i4")])


def gram_hashes(text: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k bytes from each position, by doubling."""
    power = lambda e: _U(pow(_BASE, e, 2**64))
    span, grams, out, done = 1, _TABLE[text], None, 0
    left = k
    while left:
        if left & 1:
            if out is None:
                out = grams
            else:
                m = min(len(out), len(grams) - done)
                out = out[: max(0, m)] * power(span) + grams[done : done + max(0, m)]
            done += span
        left >>= 1
        if left:
            grams = grams[:-span] * power(span) + grams[span:] if len(grams) > span else grams[:0]
            span *= 2
    return mix(out)


class Fragments:
    """The fragments of some texts: anchor, content (hash), text, begin (in all texts' bytes ``raw``) and count of starts of each."""

    def __init__(self, texts: list[bytes], length: int, k: int):
        self.length, self.k = length, k
        sizes = np.array([len(t) for t in texts], dtype=np.int64)
        self.bounds = np.append(0, np.cumsum(sizes))
        self.raw = np.frombuffer(b"".join(texts), dtype=np.uint8)
        if len(self.raw) < length:
            self.grams = self.anchor = self.content = np.empty(0, np.uint64)
            self.text = self.begin = self.count = np.empty(0, np.int64)
            return
        self.grams = grams = gram_hashes(self.raw, k)
        low = (grams >> _U(_PLACE) << _U(_PLACE)) | np.arange(len(grams), dtype=np.uint64)
        w, span = length - k + 1, 1
        while span * 2 <= w:
            low = np.minimum(low[:-span], low[span:])
            span *= 2
        if span < w:
            low = np.minimum(low[: len(low) - (w - span)], low[w - span :])
        place = (low & _U((1 << _PLACE) - 1)).astype(np.int64)
        text = np.repeat(np.arange(len(texts)), sizes)[: len(place)]
        start = np.flatnonzero(np.arange(len(place)) + length <= self.bounds[1:][text])
        place, text = place[start], text[start]
        new = np.ones(len(start), dtype=bool)
        new[1:] = (place[1:] != place[:-1]) | (text[1:] != text[:-1])
        first = np.flatnonzero(new)
        self.count = np.diff(np.append(first, len(start)))
        self.begin, self.text = start[first], text[first]
        self.anchor = mix(grams[place[first]] ^ _U(0x5851F42D4C957F2D))
        self.content = self.contents(self.begin, self.count)

    def contents(self, begin: np.ndarray, count: np.ndarray) -> np.ndarray:
        """Hash of the bytes of fragments, from k-grams that cover them."""
        last = begin + count - 1 + self.length - self.k
        out = count.astype(np.uint64)
        for i in range(-(-(2 * self.length - self.k) // self.k)):
            out = mix(out * _U(0x9E3779B97F4A7C15) + self.grams[np.minimum(begin + i * self.k, last)])
        return out

    def taken(self, which: np.ndarray, apart: np.ndarray) -> tuple[np.ndarray, ...]:
        """(anchor, content, text, begin, count) of chosen fragments; those marked ``apart`` string by string.

        Equal strings have equal ends, so they still meet under the key of their ends.
        """
        whole, split = which[~apart], which[apart]
        many = self.count[split]
        begin = np.repeat(self.begin[split], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        one = np.ones(len(begin), dtype=np.int64)
        ends = self.grams[begin] * _U(0xD6E8FEB86659FD93) + self.grams[begin + self.length - self.k]
        anchor = mix(np.repeat(self.anchor[split], many) + mix(ends))
        parts = (self.anchor, anchor), (self.content, self.contents(begin, one)), (self.text, np.repeat(self.text[split], many)), (self.begin, begin), (self.count, one)
        return tuple(np.concatenate([a[whole], b]) for a, b in parts)


def blocks(texts: list[bytes], length: int, limit: int) -> Iterator[tuple[np.ndarray, np.ndarray, list[bytes]]]:
    """(text, offset, bytes) of consecutive parts that hold about ``limit`` bytes; parts of a long text overlap by length - 1."""
    held, size = [], 0
    for i, t in enumerate(texts):
        for at in range(0, max(1, len(t) - length + 1), limit):
            held.append((i, at, t[at : at + limit + length - 1]))
            size += len(held[-1][2])
            if size >= limit:
                yield tuple(zip(*held))
                held, size = [], 0
    if held:
        yield tuple(zip(*held))


def _bucket(anchor: np.ndarray, buckets: int) -> np.ndarray:
    return (anchor >> _U(32)) * _U(buckets) >> _U(32)


def _groups(sorted_keys: np.ndarray) -> np.ndarray:
    """First place of each run of equal keys."""
    return np.flatnonzero(np.append(True, sorted_keys[1:] != sorted_keys[:-1])) if len(sorted_keys) else np.empty(0, np.int64)


def _lengths(first: np.ndarray, n: int) -> np.ndarray:
    return np.diff(np.append(first, n))


def _packed(values: np.ndarray, width: int) -> np.ndarray:
    """Numbers as rows of their ``width`` low bytes."""
    return np.ascontiguousarray(values.astype("<u8")).view(np.uint8).reshape(-1, 8)[:, :width]


def _unpacked(blob: bytes, width: int) -> np.ndarray:
    out = np.zeros((len(blob) // width, 8), dtype=np.uint8)
    out[:, :width] = np.frombuffer(blob, np.uint8).reshape(-1, width)
    return out.view("<u8").ravel()


def _marks(keys: np.ndarray, part: np.ndarray, two: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct sorted keys (anchor bits above the content bits), and whether the anchor occurs in two texts: in two parts, or marked before."""
    order = np.argsort(keys, kind="stable")
    keys, part, two = keys[order], part[order], two[order]
    first = _groups(keys >> _U(_CONTENT))
    several = (np.minimum.reduceat(part, first) != np.maximum.reduceat(part, first)) | np.logical_or.reduceat(two, first) if len(first) else two
    two = np.repeat(several, _lengths(first, len(keys)))
    one = _groups(keys)
    return keys[one], two[one]


def shared_anchors(texts: DataFrame, length: int, k: int, buckets: int) -> DataFrame:
    """(__chunk, bucket, reply): for each chunk of texts its anchors that also occur in another text.

    A chunk sends seven bytes for each of its anchors and contents; a reply has five for each anchor
    found.  Truncation can only name an anchor too many, never lose one.
    """
    limit, many = BLOCK, MANY_CONTENTS

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pa.set_memory_pool(pa.system_memory_pool())  # freed batches go back to the system at once
        now, held = None, []

        def flush() -> pa.RecordBatch:
            keys, two = _marks(np.concatenate([h[0] for h in held]), np.repeat(np.arange(len(held)), [len(h[0]) for h in held]), np.concatenate([h[1] for h in held]))
            held.clear()
            bucket = _bucket(keys, buckets)
            ids, cut = np.unique(bucket, return_index=True)
            rows = _packed((keys >> _U(_CONTENT) & _U((1 << _KEY) - 1)) << _U(_CONTENT + 1) | (keys & _U((1 << _CONTENT) - 1)) << _U(1) | two.astype(np.uint64), 7)
            blobs = [rows[p:q].tobytes() for p, q in zip(cut.tolist(), [*cut[1:].tolist(), len(keys)])]
            return pa.RecordBatch.from_arrays([pa.array(ids.astype(np.int64)), pa.array([now] * len(ids), pa.int64()), pa.array(blobs, pa.binary())], names=["bucket", "__chunk", "anchors"])

        for batch in batches:
            chunks, all_texts = column(batch, "__chunk").to_numpy(), to_bytes(column(batch, "__text"))
            for a, n in zip((edges := _groups(chunks)).tolist(), _lengths(edges, len(chunks)).tolist()):
                if held and now != chunks[a]:
                    yield flush()
                now = int(chunks[a])
                for which, _, parts in blocks(all_texts[a : a + n], length, limit):
                    found = Fragments(list(parts), length, k)
                    keys = found.anchor >> _U(_CONTENT) << _U(_CONTENT) | found.content & _U((1 << _CONTENT) - 1)
                    held.append(_marks(keys, np.array(which)[found.text], np.zeros(len(keys), dtype=bool)))
        if held:
            yield flush()

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pa.set_memory_pool(pa.system_memory_pool())
        now, chunks, blobs = None, [], []

        def close() -> pa.RecordBatch:
            values = [_unpacked(b, 7) for b in blobs]
            who = np.repeat(np.array(chunks, dtype=np.int64), [len(v) for v in values])
            values = np.concatenate(values)
            order = np.argsort(values, kind="stable")
            values, who = values[order], who[order]
            first = _groups(values >> _U(_CONTENT + 1))
            size = _lengths(first, len(values))
            two = (np.minimum.reduceat(who, first) != np.maximum.reduceat(who, first)) | (np.bitwise_or.reduceat(values, first) & _U(1) > 0)
            contents = np.add.reduceat(np.append(True, values[1:] >> _U(1) != values[:-1] >> _U(1)).astype(np.int64), first)
            reply = (values >> _U(_CONTENT + 1) << _U(1)) | np.repeat(contents >= many, size)
            here = np.repeat(two, size)
            reply, who = reply[here], who[here]
            order = np.argsort(who, kind="stable")
            reply, who = reply[order], who[order]
            new = np.append(True, (reply[1:] != reply[:-1]) | (who[1:] != who[:-1]))[: len(who)]
            reply, who = reply[new], who[new]
            edge = _groups(who)
            rows = _packed(reply, 5)
            out = [rows[p : p + n].tobytes() for p, n in zip(edge.tolist(), _lengths(edge, len(who)).tolist())]
            chunks.clear(), blobs.clear()
            return pa.RecordBatch.from_arrays([pa.array(who[edge]), pa.array([now] * len(edge), pa.int64()), pa.array(out, pa.binary())], names=["__chunk", "bucket", "reply"])

        for batch in batches:
            for bucket, chunk, blob in zip(column(batch, "bucket").to_pylist(), column(batch, "__chunk").to_pylist(), column(batch, "anchors").to_pylist()):
                if blobs and bucket != now:
                    yield close()
                now = bucket
                chunks.append(chunk), blobs.append(blob)
        if blobs:
            yield close()

    sent = texts.select("__chunk", "__text").mapInArrow(deal, "bucket long, __chunk long, anchors binary")
    return sent.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(meet, "__chunk long, bucket long, reply binary")


def _ragged(raw: np.ndarray, begin: np.ndarray, size: np.ndarray) -> pa.Array:
    """Binary Arrow column of raw[begin : begin + size] for each row."""
    offsets = np.append(0, np.cumsum(size)).astype(np.int32)
    at = np.repeat(begin - offsets[:-1], size) + np.arange(offsets[-1])
    return pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(raw[at]))])


def shared_fragments(texts: DataFrame, replies: DataFrame, length: int, k: int, buckets: int) -> DataFrame:
    """(anchor, content, least, bits, members): the fragments of shared anchors, equal ones of a block once.

    ``least`` is the smallest id among the members (packed rows of MEMBER).
    """
    limit, none = BLOCK, F.lit(None)
    rows = texts.select("__chunk", F.lit(1).alias("kind"), none.cast("long").alias("bucket"), "__row", "__doc", "__text")
    rows = rows.unionByName(replies.select("__chunk", F.lit(0).alias("kind"), "bucket", none.cast("long").alias("__row"), none.cast("long").alias("__doc"), F.col("reply").alias("__text")))
    names = ["anchor", "content", "least", "bits", "members"]

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pa.set_memory_pool(pa.system_memory_pool())
        now, told, known, apart = None, [], np.empty(0, np.uint64), np.empty(0, bool)

        def fragments_of(ids: np.ndarray, docs: np.ndarray, bodies: list[bytes]) -> Iterator[pa.RecordBatch]:
            for which, offset, parts in blocks(bodies, length, limit):
                which, offset, found = np.array(which), np.array(offset), Fragments(list(parts), length, k)
                code = _bucket(found.anchor, buckets) << _U(_KEY) | found.anchor >> _U(_CONTENT) & _U((1 << _KEY) - 1)
                at = np.minimum(np.searchsorted(known, code), len(known) - 1)
                here = np.flatnonzero(known[at] == code)
                if not len(here):
                    continue
                anchor, content, text, begin, count = found.taken(here, apart[at[here]])
                order = np.lexsort((begin, content, anchor))
                anchor, content, text, begin, count = (x[order] for x in (anchor, content, text, begin, count))
                first = np.flatnonzero(np.append(True, (anchor[1:] != anchor[:-1]) | (content[1:] != content[:-1])))
                member = np.empty(len(order), dtype=MEMBER)
                member["row"], member["doc"] = ids[which[text]], docs[which[text]]
                member["begin"] = begin - found.bounds[text] + offset[text]
                size = _lengths(first, len(order))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(signed(anchor[first])), pa.array(signed(content[first])), pa.array(np.minimum.reduceat(member["doc"].astype(np.int64), first)),
                        _ragged(found.raw, begin[first], count[first] - 1 + length),
                        pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer((np.append(0, np.cumsum(size)) * MEMBER.itemsize).astype(np.int32)), pa.py_buffer(member.tobytes())]),
                    ],
                    names=names,
                )

        for batch in batches:
            chunks, kinds = column(batch, "__chunk").to_numpy(), column(batch, "kind").to_numpy()
            ids, docs = (column(batch, c).fill_null(0).to_numpy() for c in ("__row", "__doc"))
            bodies, where = to_bytes(column(batch, "__text")), column(batch, "bucket").to_pylist()
            edges = _groups(chunks * 2 + kinds)
            for a, n in zip(edges.tolist(), _lengths(edges, len(chunks)).tolist()):
                if chunks[a] != now:
                    now, told, known = int(chunks[a]), [], known[:0]
                if kinds[a] == 0:
                    told += [(_U(b) << _U(_KEY + 1)) | _unpacked(x, 5) for b, x in zip(where[a : a + n], bodies[a : a + n])]
                    continue
                if told:
                    known = np.sort(np.concatenate(told))
                    apart, known, told = known & _U(1) > 0, known >> _U(1), []
                if len(known):
                    yield from fragments_of(ids[a : a + n], docs[a : a + n], bodies[a : a + n])

    dealt = rows.repartition("__chunk").sortWithinPartitions("__chunk", "kind")
    return dealt.mapInArrow(spread, "anchor long, content long, least long, bits binary, members binary")


def verdicts(units: DataFrame, length: int) -> DataFrame:
    """(anchor, content, least, placed, repeated) of each distinct fragment, from the suffix sort.

    Bit i of ``placed`` says that the sort has placed start i, bit i of ``repeated`` that the string there
    also starts in an id smaller than ``least``.
    """
    names, compared = ["anchor", "content", "least", "placed", "repeated"], COMPARED

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pa.set_memory_pool(pa.system_memory_pool())
        held: list[list] = []  # distinct fragments: anchor, content, least, bits

        def close(rows: list[list]) -> pa.RecordBatch:
            anchor, content, least, bits = zip(*rows)
            size = np.array([len(x) for x in bits])
            end = np.cumsum(size)
            begin, owner = end - size, np.array(least, dtype=np.int64)
            at, smallest = suffix_sort.least_owners(np.frombuffer(b"".join(bits), np.uint8), begin, end, size - length + 1, owner, length)
            row = np.searchsorted(end, at, side="right")
            bit = _U(1) << (at - begin[row]).astype(np.uint64)
            placed, repeated = np.zeros(len(rows), np.uint64), np.zeros(len(rows), np.uint64)
            np.bitwise_or.at(placed, row, bit)
            earlier = smallest < owner[row]
            np.bitwise_or.at(repeated, row[earlier], bit[earlier])
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (anchor, content, owner, signed(placed), signed(repeated))], names=names)

        for batch in batches:
            for row in zip(*(column(batch, x).to_pylist() for x in names[:3]), column(batch, "bits").to_pylist()):
                last = held[-1] if held else None
                if last is not None and row[0] == last[0] and row[1] == last[1] and row[3] == last[3]:
                    last[2] = min(last[2], row[2])
                    continue
                if len(held) >= compared and row[0] != last[0]:
                    yield close(held)
                    held = []
                held.append(list(row))
        if held:
            yield close(held)

    dealt = units.select("anchor", "content", "least", "bits").repartition("anchor").sortWithinPartitions("anchor", "content")
    return dealt.mapInArrow(compare, "anchor long, content long, least long, placed long, repeated long")


def _spans(owner: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans joined where they touch within an owner."""
    order = np.lexsort((begin, owner))
    owner, begin, end = owner[order], begin[order], end[order]
    if not len(owner):
        return owner, begin, end
    edge = _groups(owner)
    lift = np.repeat(np.arange(len(edge)), _lengths(edge, len(owner))) * (int(end.max()) + 1)
    far = np.maximum.accumulate(end + lift) - lift  # running end within the owner
    new = np.ones(len(owner), dtype=bool)
    new[1:] = (owner[1:] != owner[:-1]) | (begin[1:] > far[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(owner)) - 1
    return owner[first], begin[first], far[last]


def repeated_spans(units: DataFrame, judged: DataFrame, length: int) -> DataFrame:
    """(__row, __cuts): the repeated spans of each row that has some, packed as pairs of 64-bit numbers."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            least, placed, repeated = (column(batch, c).to_numpy() for c in ("least", "placed", "repeated"))
            blobs = column(batch, "members").to_pylist()
            many = np.array([len(b) // MEMBER.itemsize for b in blobs], dtype=np.int64)
            member = np.frombuffer(b"".join(blobs), dtype=MEMBER)
            least, placed, repeated = (np.repeat(x, many) for x in (least, placed, repeated))
            bits = np.where(member["doc"] > least, placed, repeated).view(np.uint64)
            row, begin = member["row"].astype(np.int64), member["begin"].astype(np.int64)
            run = (bits != 0) & (bits & (bits + _U(1)) == 0)  # starts 0 to n - 1
            n = np.bitwise_count(bits[run]).astype(np.int64)
            rest = np.flatnonzero((bits != 0) & ~run)
            at, step = np.nonzero((bits[rest, None] >> np.arange(length, dtype=np.uint64)) & _U(1))
            single = begin[rest][at] + step
            spans = _spans(np.append(row[run], row[rest][at]), np.append(begin[run], single), np.append(begin[run] + n - 1 + length, single + length))
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in spans], names=["__row", "begin", "end"])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carry = tuple(np.empty(0, np.int64) for _ in range(3))

        def close(owner: np.ndarray, begin: np.ndarray, end: np.ndarray) -> pa.RecordBatch:
            owner, begin, end = _spans(owner, begin, end)
            edge = _groups(owner)
            pairs = np.column_stack([begin, end]).astype("<i8")
            cuts = [pairs[p : p + n].tobytes() for p, n in zip(edge.tolist(), _lengths(edge, len(owner)).tolist())]
            return pa.RecordBatch.from_arrays([pa.array(owner[edge]), pa.array(cuts, pa.binary())], names=["__row", "__cuts"])

        for batch in batches:
            cols = tuple(np.append(c, column(batch, x).to_numpy()) for c, x in zip(carry, ("__row", "begin", "end")))
            if not len(cols[0]):
                continue
            last = int(np.searchsorted(cols[0], cols[0][-1]))
            carry = _spans(*(c[last:] for c in cols))
            if last:
                yield close(*(c[:last] for c in cols))
        if len(carry[0]):
            yield close(*carry)

    joined = units.select("anchor", "content", "members").join(judged, ["anchor", "content"])
    spans = joined.select("least", "placed", "repeated", "members").mapInArrow(mark, "__row long, begin long, end long")
    return spans.repartition("__row").sortWithinPartitions("__row").mapInArrow(gather, "__row long, __cuts binary")


def remove_repeats(df: DataFrame, length: int = 50, id_col: str = "doc_id", text: str = "text", k: int = 16) -> DataFrame:
    """``df`` with its text (as bytes) cut, and spans: columns of ``df``, then n_bytes, n_removed, spans, kept_bytes.

    A byte goes when a ``length``-byte string over it also starts in a row of a smaller id; strings are
    judged on the input, overlaps count, matches never cross documents.  A null text counts as empty; texts
    shorter than ``length`` are left alone; rows with a null id are left alone and nothing is compared with
    them; rows with an equal id, whatever their texts, do not remove each other's strings, and each is cut on
    its own.  Columns named like the results are replaced; an empty table gives no rows.
    """
    added = ["n_bytes", "n_removed", "spans", "kept_bytes"]
    others = [c for c in df.columns if c not in (text, *added)]
    rows = df.select(*others, F.col(id_col).cast("long").alias("__doc"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("__text"))
    rows = rows.withColumn("__sha", F.unhex(F.sha2("__text", 256)))
    size = rows.agg(F.sum(F.octet_length("__text")).alias("bytes"), F.count("*").alias("rows")).first()
    total = size["bytes"] or 0
    buckets, chunks = max(64, -(-total // BUCKET_BYTES)), min(MOST_CHUNKS, max(1, total // CHUNK_BYTES))
    copies = rows.where("__doc is not null").groupBy("__sha").agg(F.min("__doc").alias("__least"), F.count("*").alias("n")).where("n > 1").drop("n")
    copies = stored(copies)
    rows = rows.join(F.broadcast(copies) if small(copies) else copies, "__sha", "left").drop("__sha")
    rows = rows.withColumn("__row", F.monotonically_increasing_id())
    keyed = stored(rows.withColumn("__chunk", F.floor(F.col("__row") / max(1, size["rows"] // chunks))))
    first = keyed.where(F.col("__doc").isNotNull() & (F.coalesce("__least", "__doc") == F.col("__doc")))
    texts = first.where(F.octet_length("__text") >= length).select("__chunk", "__row", "__doc", "__text")
    replies = stored(shared_anchors(texts, length, k, buckets))
    units = stored(shared_fragments(texts, replies, length, k, buckets))
    discard(copies, replies)
    judged = stored(verdicts(units, length))
    cuts = stored(repeated_spans(units, judged, length))
    discard(units, judged)
    whole = keyed.withColumn("__copy", F.coalesce(F.col("__doc") > F.col("__least"), F.lit(False))).join(cuts, "__row", "left")
    results = StructType.fromDDL("n_bytes long, n_removed long, spans array<struct<start:long,end:long>>, kept_bytes binary")
    schema = StructType(df.select(*others).schema.fields + results.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for big in batches:
            for batch in slices(big, "__text"):
                sizes, gone, spans, kept = [], [], [], []
                for t, copy, found in zip(to_bytes(column(batch, "__text")), column(batch, "__copy").to_pylist(), column(batch, "__cuts").to_pylist()):
                    cut = [(0, len(t))] if copy and len(t) >= length else np.frombuffer(found or b"", "<i8").reshape(-1, 2).tolist()
                    edges = [0, *(x for pair in cut for x in pair), len(t)]
                    sizes.append(len(t))
                    gone.append(sum(y - x for x, y in cut))
                    spans.append([{"start": x, "end": y} for x, y in cut])
                    kept.append(b"".join(t[x:y] for x, y in zip(edges[::2], edges[1::2])))
                arrays = [column(batch, c) for c in others] + [pa.array(sizes, pa.int64()), pa.array(gone, pa.int64()), pa.array(spans, pair), pa.array(kept, pa.binary())]
                yield pa.RecordBatch.from_arrays(arrays, names=[*others, *added])

    return whole.select(*others, "__text", "__copy", "__cuts").mapInArrow(run, schema)


def op10_two_stage_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return cut.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept_bytes", 256).alias("kept_sha256"))
