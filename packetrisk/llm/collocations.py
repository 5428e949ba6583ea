"""Phrase collocation mining by dynamic itemset counting (Brin, Motwani, Ullman, Tsur, SIGMOD 1997), phrases for itemsets.

The corpus lies in shards that are scanned in turn, over and over.  A scan counts phrases of all lengths that are active: words
from the first scan on, a longer phrase from the scan after both its subphrases (without its last and without its first word) have
been counted often enough, while these may still be counted themselves.  Every phrase is counted for one full cycle of shards.

The scans count 64-bit hashes, in packed arrays dealt out by hash.  Which phrases have reached the threshold, and when,
stands in one table of small numbers per length, addressed by leading bits of the hash: a phrase that shares a place with
another may be counted without need, never the reverse.  A last scan counts the texts of the phrases found, so that the
results are exact whatever hashes collide.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from packetrisk.llm.store import discard, stored
from packetrisk.llm.textops import column, mix, to_bytes, window_hashes

LONGEST = 5
SHARDS = 3
#: Text bytes gathered before blocks are written, bytes of text per bucket of hashes, and per place of a table.
BLOCK_BYTES, BUCKET_BYTES, PLACE_BYTES = 16 << 20, 32 << 20, 128
#: Bits of a table's places: at most 2**26 bytes a length.
LEAST_BITS, MOST_BITS = 16, 26
#: Hashes that a scan gathers before it hands them on.
HELD = 6_000_000

#: A-Z lower-cased; the ends of pieces ``[.,;:!?\x0A-\x0D]`` all become a full stop, which no word can then contain.
_PLAIN = bytes(b + 32 if 0x41 <= b <= 0x5A else 0x2E if b in b".,;:!?\n\x0b\x0c\r" else 0x20 if b == 0x09 else b for b in range(256))
_U = np.uint64


class _Words(dict):
    """word -> number from 1 in order of appearance; the end of a piece is 0."""

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        return n


def blocks_of(docs: DataFrame, shards: int) -> DataFrame:
    """(lang, words, ids, shard): blocks of one language's texts in one shard, as distinct words and the number of every word in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, str], tuple[_Words, list[np.ndarray]]] = {}
        taken, row = 0, TaskContext.get().partitionId()

        def close() -> Iterator[pa.RecordBatch]:
            for (shard, lang), (words, ids) in held.items():
                kinds = (pa.string(), pa.binary(), pa.binary(), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip((lang, b" ".join(list(words)[1:]), np.concatenate(ids).tobytes(), shard), kinds)], names=["lang", "words", "ids", "shard"])
            held.clear()

        for batch in batches:
            for text, lang in zip(to_bytes(column(batch, "text")), column(batch, "lang").to_pylist()):
                row += 1
                key = row % shards, lang
                if key not in held:
                    held[key] = _Words({b".": 0}), []
                words, ids = held[key]
                tokens = text.translate(_PLAIN).replace(b".", b" . ").split(b" ")
                ids.append(np.fromiter((words[w] for w in tokens if w), np.int32))
                ids.append(np.zeros(1, np.int32))
                taken += len(text)
                if taken > BLOCK_BYTES:
                    yield from close()
                    taken = 0
        yield from close()

    return stored(docs.mapInArrow(run, "lang string, words binary, ids binary, shard int"), by="shard")


def _positions(lang: str, words: list[bytes], ids: bytes) -> tuple[np.ndarray, np.ndarray, np.uint64, np.ndarray]:
    """(word hashes in order, piece of each, the language's number, word numbers) of a block; the ends of pieces are left out."""
    at = np.frombuffer(ids, np.int32)
    piece, inside = np.cumsum(at == 0), at > 0
    known = np.array([0, *map(xxhash.xxh3_64_intdigest, words)], dtype=np.uint64)
    return known[at[inside]], piece[inside], mix(np.array([xxhash.xxh3_64_intdigest(lang.encode())], dtype=np.uint64))[0], at[inside]


def _phrases(words: np.ndarray, piece: np.ndarray, own: np.uint64, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the phrases of k words at every place, and whether each lies within one piece."""
    n = max(0, len(words) - k + 1)
    return window_hashes(words, k) ^ own, piece[:n] == piece[len(piece) - n :]


def _summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, n = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    order = np.argsort(keys)
    keys, n = keys[order], n[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(n, first) if len(first) else n


COUNTED = "bucket int, k int, act int, before boolean, hashes binary, counts binary, places binary"
_NAMES = [x.split()[0] for x in COUNTED.split(", ")]


def _row(bucket: int, k: int, act: int, before: bool, hashes=None, counts=None, places=None) -> dict:
    packed = lambda x: None if x is None else np.ascontiguousarray(x).tobytes()
    return dict(zip(_NAMES, (bucket, k, act, before, packed(hashes), packed(counts), packed(places))))


def _batch(rows: list[dict]) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.int32(), pa.int32(), pa.bool_(), pa.binary(), pa.binary(), pa.binary()]
    return pa.RecordBatch.from_pylist(rows, pa.schema(list(zip(_NAMES, kinds))))


class Tables:
    """For each length and place: the scan from which a longer phrase may use a phrase that lies there (0: not yet)."""

    def __init__(self, spark: SparkSession, bits: int):
        self.context, self.bits = spark.sparkContext, bits
        self.steps = {k: np.zeros(1 << bits, dtype=np.uint8) for k in range(1, LONGEST + 1)}
        self.sent = {k: None for k in self.steps}

    def reached(self, found: list[tuple[int, bytes]], scan: int) -> None:
        for k, places in found:
            at = np.frombuffer(places, np.int32)
            self.steps[k][at[self.steps[k][at] == 0]] = scan
            if self.sent[k] is not None:
                self.sent[k].unpersist()
                self.sent[k] = None

    def acts(self, k: int, scan: int, shards: int) -> bool:
        """Whether phrases of a length may be active in a scan."""
        if k == 1:
            return scan <= shards
        return bool(((self.steps[k - 1] <= scan) & (self.steps[k - 1] > max(0, scan - shards))).any())

    def shared(self, k: int):
        """The broadcast table of a length: 2**bits bytes, at most 64 MB."""
        if self.sent[k] is None:
            self.sent[k] = self.context.broadcast(self.steps[k])
        return self.sent[k]


def _scan(blocks: DataFrame, tables: Tables, scan: int, shards: int, lengths: list[int], buckets: int) -> DataFrame:
    """Counts of all phrases active in this scan, packed by bucket, length and the scan in which they became active."""
    bits, steps = tables.bits, {k - 1: tables.shared(k - 1) for k in lengths if k > 1}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], list[tuple[np.ndarray, np.ndarray]]] = {}

        def close() -> Iterator[pa.RecordBatch]:
            for (k, act), parts in held.items():
                keys, n = _summed(parts)
                bucket = (((keys >> _U(32)) * _U(buckets)) >> _U(32)).astype(np.int64)
                edges = np.flatnonzero(np.diff(bucket, prepend=-1, append=buckets))
                yield _batch([_row(int(bucket[a]), k, act, False, keys[a:b], n[a:b].astype(np.int32)) for a, b in zip(edges[:-1], edges[1:])])
            held.clear()

        for batch in batches:
            for lang, words, ids in zip(*(column(batch, c).to_pylist() for c in ("lang", "words", "ids"))):
                words, piece, own, _ = _positions(lang, words.split(b" ") if words else [], ids)
                for k in lengths:
                    keys, inside = _phrases(words, piece, own, k)
                    if k == 1:
                        act = np.ones(len(keys), np.uint8)
                    else:
                        parts, _ = _phrases(words, piece, own, k - 1)
                        step = steps[k - 1].value[parts >> _U(64 - bits)]
                        act = np.maximum(step[:-1], step[1:])
                        inside = inside & (step[:-1] > 0) & (step[1:] > 0)
                    live = inside & (act <= scan) & (act > scan - shards)
                    for a in np.unique(act[live]).tolist():
                        keep = np.unique(keys[live & (act == a)], return_counts=True)
                        parts = held.setdefault((k, a), [])
                        parts.append(keep)
                        if len(parts) == 8:
                            parts[:] = [_summed(parts)]
                if sum(len(p[0]) for parts in held.values() for p in parts) > HELD:
                    yield from close()
        yield from close()

    return blocks.mapInArrow(run, COUNTED)


def _merged(counted: DataFrame, scan: int, shards: int, least: int, bits: int) -> DataFrame:
    """Counts so far (``before``) of the phrases whose cycle goes on, and the places of those that have reached the threshold in this scan."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, old, new = None, [], []

        def close() -> Iterator[pa.RecordBatch]:
            if now is None:
                return
            keys, n = _summed(old + new)
            past = np.zeros(len(keys), np.int64)
            for some, many in old:
                past[np.searchsorted(keys, some)] = many
            over = keys[(n >= least) & (past < least)]
            rows = [_row(*now, True, places=np.unique(over >> _U(64 - bits)).astype(np.int32))] if len(over) else []
            if now[2] + shards - 1 > scan:
                rows.append(_row(*now, True, keys, n))
            if rows:
                yield _batch(rows)

        for batch in batches:
            for r in batch.to_pylist():
                key = r["bucket"], r["k"], r["act"]
                if key != now:
                    yield from close()
                    now, old, new = key, [], []
                part = np.frombuffer(r["hashes"], np.uint64), np.frombuffer(r["counts"], np.int64 if r["before"] else np.int32).astype(np.int64)
                (old if r["before"] else new).append(part)
                if len(new) == 16:
                    new = [_summed(new)]
        yield from close()

    return counted.repartition("bucket").sortWithinPartitions("bucket", "k", "act").mapInArrow(run, COUNTED)


def _buckets(size: int) -> int:
    return max(12, size // BUCKET_BYTES)


def dynamic_counts(blocks: DataFrame, size: int, least: int, shards: int) -> Tables:
    """The tables of all phrases that occur ``least`` times, by dynamic itemset counting over the shards of ``blocks``."""
    spark = blocks.sparkSession
    bits = min(MOST_BITS, max(LEAST_BITS, (size // PLACE_BYTES).bit_length()))
    tables, scan, kept, buckets = Tables(spark, bits), 1, None, _buckets(size)
    while lengths := [k for k in range(1, LONGEST + 1) if tables.acts(k, scan, shards)]:
        counted = _scan(blocks.where(F.col("shard") == (scan - 1) % shards), tables, scan, shards, lengths, buckets)
        before = kept
        kept = stored(_merged(counted if before is None else counted.unionByName(before.where("hashes is not null")), scan, shards, least, bits))
        discard(before)
        # each place of a table comes once at most: bounded by the size of the tables
        found = kept.where("places is not null").select("k", "places").toArrow()
        tables.reached(list(zip(found.column("k").to_pylist(), found.column("places").to_pylist())), scan + 1)
        scan += 1
    discard(kept)
    return tables


LISTED = "bucket int, lang string, k int, phrases binary, counts binary"


def _lists(blocks: DataFrame, tables: Tables, buckets: int) -> DataFrame:
    """Each block's phrases of 1 to 5 words that may be frequent, by bucket of their hash (joined by line feeds, which no phrase
    contains), and how often each occurs; k = 0 has the number of all words."""
    bits, steps = tables.bits, {k: tables.shared(k) for k in range(1, LONGEST + 1)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, text, ids in zip(*(column(batch, c).to_pylist() for c in ("lang", "words", "ids"))):
                names = [b"", *text.split(b" ")]
                words, piece, own, at = _positions(lang, names[1:] if text else [], ids)
                rows = [(0, lang, 0, b"", np.array([len(words)]).tobytes())]
                alive = np.arange(len(words))
                for k in range(1, LONGEST + 1):
                    keys, inside = _phrases(words, piece, own, k)
                    alive = alive[alive < len(keys)]
                    alive = alive[inside[alive] & (steps[k].value[keys[alive] >> _U(64 - bits)] > 0)]
                    if not len(alive):
                        break
                    # phrases of equal hashes but different words are told apart by their word numbers
                    place = alive[np.lexsort([*(at[alive + i] for i in range(k)), keys[alive]])]
                    change = np.zeros(len(place), dtype=bool)
                    change[0] = True
                    for i in range(k):
                        change[1:] |= at[place[1:] + i] != at[place[:-1] + i]
                    first = np.flatnonzero(change)
                    n = np.diff(np.append(first, len(place)))
                    start = place[first]
                    bucket = (((keys[start] >> _U(32)) * _U(buckets)) >> _U(32)).astype(np.int64)
                    edges = np.flatnonzero(np.diff(bucket, prepend=-1, append=buckets))
                    for a, b in zip(edges[:-1], edges[1:]):
                        phrases = b"\n".join([b" ".join([names[j] for j in at[p : p + k].tolist()]) for p in start[a:b].tolist()])
                        rows.append((int(bucket[a]), lang, k, phrases, n[a:b].tobytes()))
                kinds = (pa.int32(), pa.string(), pa.int32(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*rows), kinds)], names=["bucket", "lang", "k", "phrases", "counts"])

    return blocks.select("lang", "words", "ids").mapInArrow(run, LISTED)


def phrase_counts(blocks: DataFrame, tables: Tables, least: int, buckets: int = 12) -> DataFrame:
    """(lang, k, phrase, n) of all phrases of 1 to 5 words that occur ``least`` times or more; k = 0 has the number of all words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sums = None, {}

        def close() -> Iterator[pa.RecordBatch]:
            if now is None:
                return
            found = [(p, n) for p, n in sums.items() if n >= least or now[2] == 0]
            for i in range(0, len(found), 20_000):
                part = found[i : i + 20_000]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([now[1]] * len(part), pa.string()), pa.array([now[2]] * len(part), pa.int32()), pa.array([p for p, _ in part], pa.binary()).cast(pa.string()), pa.array([n for _, n in part], pa.int64())],
                    names=["lang", "k", "phrase", "n"],
                )

        for batch in batches:
            for bucket, lang, k, phrases, counts in zip(*(column(batch, c).to_pylist() for c in ("bucket", "lang", "k", "phrases", "counts"))):
                if (bucket, lang, k) != now:
                    yield from close()
                    now, sums = (bucket, lang, k), {}
                for p, n in zip(phrases.split(b"\n"), np.frombuffer(counts, np.int64).tolist()):
                    sums[p] = sums.get(p, 0) + n
        yield from close()

    dealt = _lists(blocks, tables, buckets).repartition("bucket").sortWithinPartitions("bucket", "lang", "k")
    return dealt.mapInArrow(run, "lang string, k int, phrase string, n long")


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = 100, top: int = 2000, shards: int = SHARDS) -> DataFrame:
    """Each language's ``top`` phrases: lang, rank (from 1), phrase, a, l, r, n, score.

    A candidate is a phrase of 2 to 5 words within a piece that occurs ``least`` times or more (a).  Of its cuts in two parts, counted l
    and r, that of the lowest floor(1000 * a * n / (l * r)) gives its score (ties: the shortest first part); n are all words of the
    language.  A candidate inside a longer one of the same count is dropped (it is then inside one that is one word longer, since
    counts fall with length).  Ranked by score and a, falling, then by phrase.  A null text is empty; a null language is ``und``;
    repeated rows each count; other columns are ignored; an empty table gives no rows.
    """
    rows = docs.select(F.coalesce(F.col(lang), F.lit("und")).alias("lang"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = blocks_of(rows, shards)
    known = stored(phrase_counts(blocks, dynamic_counts(blocks, size, least, shards), least, _buckets(size)))
    discard(blocks)
    longer = known.where("k > 2").select("lang", "n", F.explode(F.array(F.expr("substring_index(phrase, ' ', k - 1)"), F.expr("substring(phrase, instr(phrase, ' ') + 1)"))).alias("phrase"))
    longer = longer.groupBy("lang", "phrase").agg(F.max("n").alias("longer"))
    kept = known.where("k > 1").join(longer, ["lang", "phrase"], "left").where("longer is null or longer < n").select("lang", "phrase", "k", F.col("n").alias("a"))
    parts = kept.select("*", F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut")).withColumn("__left", F.expr("substring_index(phrase, ' ', cut)"))
    parts = parts.withColumn("__right", F.expr("substring(phrase, length(__left) + 2)"))
    side = lambda name, count: known.where("k > 0").select(F.col("lang").alias(f"{name}_lang"), F.col("phrase").alias(name), F.col("n").alias(count))
    parts = parts.join(side("__l", "l"), F.expr("lang = __l_lang and __left = __l")).join(side("__r", "r"), F.expr("lang = __r_lang and __right = __r"))
    parts = parts.join(known.where("k = 0").select("lang", "n"), "lang")
    exact = lambda c: f"cast({c} as decimal(19, 0))"
    parts = parts.withColumn("score", F.expr(f"(cast(1000 as decimal(4, 0)) * {exact('a')} * {exact('n')}) div ({exact('l')} * {exact('r')})"))
    worst = parts.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "cut", "l", "r")).alias("w")).select("lang", "phrase", "a", "n", "w.l", "w.r", "w.score")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = worst.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op11_dynamic_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet"))
