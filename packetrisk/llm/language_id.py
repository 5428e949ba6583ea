"""Language identification by interpolated Kneser-Ney character models, one for each language.

A text's words (runs of letters, lower-cased) are read character by character up to their end; a character is
predicted from the four before it in its word.  Texts are read once, in blocks: a block's distinct words carry all n-grams, so
counting and scoring work on words and every document is a list of word numbers.  Spark counts the n-grams of the training
texts by language; the model is a table of hashed entries dealt out in buckets of sorted hash arrays, as large as the corpus
makes it.  Every block asks each bucket for the entries of its own n-grams, so no task holds the whole model.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packetrisk.llm.store import BROADCAST_IDS, discard, small, stored
from packetrisk.llm.textops import column, mix
from packetrisk.llm.toxicity import fit_curve

ORDER = 5
#: Bits of a character; an n-gram is two numbers: ``hi`` (its first two characters) and ``lo`` (the last three).
BITS = 21
CHAR = (1 << BITS) - 1
#: Text characters of a block, and characters of a long text that are split into words at once.
BLOCK_CHARS, PART_CHARS = 16_000_000, 2_000_000
#: Documents of a block in one row.
DOCS = 500
#: Entries of the model in one bucket, about.
BUCKET_ENTRIES = 100_000
#: Labelled rows of the calibration fold that fit the curve of the score.
CALIBRATION_ROWS = 50_000
#: Share of a language's calibration texts that its cross-entropy limit lets pass.
PASSED = 0.999

_WORD, _GAP = re.compile(r"[^\W\d_]+"), re.compile(r"[\W\d_]")
_BEGIN, _END = "\x01" * (ORDER - 1), "\x02"
_U = np.uint64

PROFILE = (
    "kind int, block long, lang string, words string, hi binary, lo binary, times binary, ids binary, sizes array<int>, "
    "doc_id array<long>, held array<boolean>, label array<string>, crc array<long>"
)


def letters(text: str) -> Iterator[list[str]]:
    """Words of a text, some at a time: maximal runs of letters, lower-cased."""
    low, at = text.lower(), 0
    while at < len(low):
        cut = len(low)
        if cut - at > PART_CHARS:
            gap = _GAP.search(low, at + PART_CHARS)
            cut = gap.end() if gap else cut
        yield _WORD.findall(low, at, cut)
        at = cut


class Numbers(dict):
    """word -> number in order of appearance; a run without a letter (such as a fraction sign) is -1."""

    def __missing__(self, word: str) -> int:
        known = word.isalpha() or any(map(str.isalpha, word))
        n = self[word] = self.size if known else -1
        if known:
            self.size += 1
        return n

    size = 0


def word_grams(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hi, lo) of the n-grams of all words in order, and each word's first one; a word of k letters has k + 1."""
    sizes = np.array([len(w) + 1 for w in words], dtype=np.int64)
    codes = np.frombuffer("".join(_BEGIN + w + _END for w in words).encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
    first = np.append(0, np.cumsum(sizes))
    at = np.arange(first[-1]) + np.repeat(np.arange(len(words)) * (ORDER - 1), sizes)
    hi = (codes[at] << _U(BITS)) | codes[at + 1]
    lo = (((codes[at + 2] << _U(BITS)) | codes[at + 3]) << _U(BITS)) | codes[at + 4]
    return hi, lo, first[:-1]


def keys_of(hi: np.ndarray, lo: np.ndarray, order: np.ndarray | int, context: np.ndarray | int) -> np.ndarray:
    """64-bit hashes of n-grams (context 0) or of the contexts of n-grams (1) of an order."""
    tag = np.asarray(order, dtype=np.uint64) * _U(2) + np.asarray(context, dtype=np.uint64)
    return mix(mix(hi ^ (tag << _U(44))) + lo * _U(0x9E3779B97F4A7C15))


def _suffix(hi: np.ndarray, lo: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """The last ``order`` characters of n-grams of the top order."""
    return hi & _U((1 << (BITS * max(0, order - 3))) - 1), lo & _U((1 << (BITS * min(3, order))) - 1)


def _context(hi: np.ndarray, lo: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return hi >> _U(BITS), (lo >> _U(BITS)) | ((hi & _U(CHAR)) << _U(2 * BITS))


def packed(values: np.ndarray) -> bytes:
    """32-bit numbers (integers, or single floats by their bits) compressed byte plane by byte plane."""
    bits = values.view(np.int32) if values.dtype == np.float32 else values.astype(np.int32)
    return pa.compress(np.ascontiguousarray(bits.view(np.uint8).reshape(-1, 4).T).tobytes(), codec="zstd", asbytes=True)


def unpacked(data: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(data, decompressed_size=4 * n, codec="zstd", asbytes=True), np.uint8).reshape(4, n)
    return np.ascontiguousarray(planes.T).view(np.int32).ravel()


class Grams:
    """The distinct n-grams of a block's words and where the model's entries for them stand among its sorted ``keys``."""

    def __init__(self, words: list[str]):
        hi, lo, self.first = word_grams(words)
        _, some, self.where = np.unique(keys_of(hi, lo, ORDER, 0), return_index=True, return_inverse=True)
        self.hi, self.lo = hi[some], lo[some]
        wanted = []
        for order in range(1, ORDER + 1):
            h, low = _suffix(self.hi, self.lo, order)
            wanted += [keys_of(h, low, order, 0), keys_of(*_context(h, low), order, 1)]
        self.keys, at = np.unique(np.concatenate(wanted), return_inverse=True)
        self.places = at.reshape(ORDER, 2, -1)

    def word_logs(self, first: np.ndarray, second: np.ndarray, base: float) -> np.ndarray:
        """log P of every word, given the entries of the keys (0 where the model has none)."""
        p = np.full(len(self.hi), base)
        for grams, contexts in self.places:
            total = first[contexts]
            p = np.where(total > 0, first[grams] / np.maximum(total, 1e-30) + second[contexts] * p, p)
        return np.add.reduceat(np.log(p)[self.where], self.first) if len(self.first) else np.zeros(0)


def profiles(rows: DataFrame) -> DataFrame:
    """Blocks of (doc_id, __text, __held, __lang, __crc, __use): kind 0 the words of a block, 1 some of its documents (each one's words' numbers
    and how often each), 2 the n-gram counts of the block's training texts (``__use``) of one language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([
            ("kind", pa.int32()), ("block", pa.int64()), ("lang", pa.string()), ("words", pa.string()), *((c, pa.binary()) for c in ("hi", "lo", "times", "ids")),
            *((c, pa.list_(t)) for c, t in (("sizes", pa.int32()), ("doc_id", pa.int64()), ("held", pa.bool_()), ("label", pa.string()), ("crc", pa.int64()))),
        ])
        names = [f.name for f in schema]
        block, numbers, docs, taken, training = TaskContext.get().partitionId() << 32, Numbers(), [], 0, {}
        made = lambda rows: pa.RecordBatch.from_pylist([{c: r.get(c) for c in names} for r in rows], schema)

        def close() -> Iterator[pa.RecordBatch]:
            words = [w for w, i in numbers.items() if i >= 0]
            yield made([{"kind": 0, "block": block, "words": " ".join(words)}])
            for i in range(0, len(docs), DOCS):
                some = docs[i : i + DOCS]
                ids, times = (np.concatenate([d[k] for d in some]) for k in (4, 5))
                yield made([{"kind": 1, "block": block, **{c: [d[k] for d in some] for k, c in enumerate(("doc_id", "held", "label", "crc"))}, "ids": packed(ids), "times": packed(times), "sizes": [len(d[4]) for d in some]}])
            if not training:
                return
            hi, lo, first = word_grams(words)
            _, some, where = np.unique(keys_of(hi, lo, ORDER, 0), return_index=True, return_inverse=True)
            per_word = np.diff(np.append(first, len(hi)))
            for lang, parts in training.items():
                times = np.bincount(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]), len(words))
                n = np.bincount(where, np.repeat(times, per_word), len(some)).astype(np.int64)
                held = np.flatnonzero(n)
                for part in np.array_split(held, 1 + len(held) // 500_000):
                    yield made([{"kind": 2, "block": block, "lang": lang, "hi": hi[some[part]].tobytes(), "lo": lo[some[part]].tobytes(), "times": n[part].tobytes()}])

        for batch in batches:
            for doc, text, held, lang, crc, use in zip(*(column(batch, c).to_pylist() for c in ("doc_id", "__text", "__held", "__lang", "__crc", "__use"))):
                if docs and taken + len(text or "") > BLOCK_CHARS:
                    yield from close()
                    block, numbers, docs, taken, training = block + 1, Numbers(), [], 0, {}
                taken += len(text or "")
                ids, times = np.zeros(0, np.int32), np.zeros(0, np.int64)
                for words in letters(text or ""):
                    some, many = np.unique(np.fromiter(map(numbers.__getitem__, words), np.int32, len(words)), return_counts=True)
                    ids, times = np.append(ids, some[some >= 0]), np.append(times, many[some >= 0])
                docs.append((doc, held, lang, crc, np.diff(ids, prepend=np.int32(0)), times.astype(np.int32)))
                if use and len(ids):
                    training.setdefault(lang, []).append((ids, times))
        if docs:
            yield from close()

    return rows.mapInArrow(run, PROFILE)


def ngram_levels(blocks: DataFrame) -> DataFrame:
    """(order, lang, hi, lo, n): n-gram counts of the top order; below it the number of different characters seen before the n-gram."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, hi, lo, n in zip(*(column(batch, c).to_pylist() for c in ("lang", "hi", "lo", "times"))):
                h, low, n = (np.frombuffer(x, np.int64) for x in (hi, lo, n))
                for i in range(0, len(h), 100_000):
                    part = slice(i, i + 100_000)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(h[part]), pa.string()), pa.array(h[part]), pa.array(low[part]), pa.array(n[part])], names=["lang", "hi", "lo", "n"])

    counted = blocks.where("kind = 2").select("lang", "hi", "lo", "times").mapInArrow(run, "lang string, hi long, lo long, n long")
    level = stored(counted.groupBy("lang", "hi", "lo").agg(F.sum("n").alias("n")))
    out = level.withColumn("order", F.lit(ORDER))
    for order in range(ORDER - 1, 0, -1):
        h, low = (1 << (BITS * max(0, order - 3))) - 1, (1 << (BITS * min(3, order))) - 1
        level = stored(level.groupBy("lang", F.col("hi").bitwiseAND(F.lit(h)).alias("hi"), F.col("lo").bitwiseAND(F.lit(low)).alias("lo")).agg(F.count("*").alias("n")))
        out = out.unionByName(level.withColumn("order", F.lit(order)))
    return out


def model_entries(levels: DataFrame) -> DataFrame:
    """(order, context, hi, lo, lang, first, second): for an n-gram its count less the discount; for a context (1) the
    sum of its counts, and the share that the discounts leave to the lower order."""
    seen = levels.groupBy("order", "lang").agg(F.count_if(F.col("n") == 1).alias("n1"), F.count_if(F.col("n") == 2).alias("n2"))
    cut = F.coalesce(F.try_divide(F.col("n1"), F.col("n1") + 2 * F.col("n2")), F.lit(0.5))
    cuts = seen.select("order", "lang", F.least(F.greatest(cut, F.lit(0.05)), F.lit(0.95)).alias("cut"))
    above = [F.shiftright("hi", BITS).alias("hi"), F.expr(f"shiftright(lo, {BITS}) | shiftleft(hi & {CHAR}L, {2 * BITS})").alias("lo")]
    contexts = levels.select("order", "lang", *above, "n").groupBy("order", "lang", "hi", "lo").agg(F.sum("n").alias("n"), F.count("*").alias("types"))
    both = levels.select("order", F.lit(0).alias("context"), "hi", "lo", "lang", "n", F.lit(None).cast("long").alias("types")).unionByName(contexts.withColumn("context", F.lit(1)))
    cuts = stored(cuts)
    both = both.join(F.broadcast(cuts) if small(cuts, BROADCAST_IDS) else cuts, ["order", "lang"])
    first = F.when(F.col("context") == 0, F.col("n") - F.col("cut")).otherwise(F.col("n"))
    return both.select("order", "context", "hi", "lo", "lang", first.cast("double").alias("first"), F.coalesce(F.col("cut") * F.col("types") / F.col("n"), F.lit(0.0)).alias("second"))


ASKED = "bucket int, key long, lang string, first float, second float, block long, base int, keys binary"


def _bucketed(entries: DataFrame, bits: int) -> DataFrame:
    """The entries with their hash and bucket (its leading bits)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hi, lo, order, context = (column(batch, c).to_numpy() for c in ("hi", "lo", "order", "context"))
            key = keys_of(hi.view(np.uint64), lo.view(np.uint64), order, context)
            bucket = (key >> _U(64 - bits)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(bucket), pa.array(key.view(np.int64)), column(batch, "lang"), *(column(batch, c).cast(pa.float32()) for c in ("first", "second"))], names=["bucket", "key", "lang", "first", "second"])

    return entries.mapInArrow(run, "bucket int, key long, lang string, first float, second float")


def _questions(blocks: DataFrame, bits: int) -> DataFrame:
    """What each block asks each bucket: the sorted keys of its n-grams there, the first of them the block's ``base``-th."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, words in zip(column(batch, "block").to_pylist(), column(batch, "words").to_pylist()):
                if not words:
                    continue
                keys = Grams(words.split(" ")).keys
                buckets, base = np.unique((keys >> _U(64 - bits)).astype(np.int32), return_index=True)
                ends = np.append(base[1:], len(keys))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(buckets), pa.array([block] * len(buckets), pa.int64()), pa.array(base.astype(np.int32)), pa.array([keys[a:b].tobytes() for a, b in zip(base, ends)], pa.binary())], names=["bucket", "block", "base", "keys"]
                )

    return blocks.where("kind = 0").select("block", "words").mapInArrow(run, "bucket int, block long, base int, keys binary")


def _answers(entries: DataFrame, questions: DataFrame) -> DataFrame:
    """(block, lang, n, at, first, second): the n entries that each block asked for, by language; ``at`` (as steps) are places among its keys."""
    side = entries.select("*", *(F.lit(None).cast(t).alias(c) for c, t in (("block", "long"), ("base", "int"), ("keys", "binary"))))
    both = side.unionByName(questions, allowMissingColumns=True).select(*(x.split()[0] for x in ASKED.split(", ")))
    dealt = both.repartition("bucket").sortWithinPartitions("bucket", F.asc_nulls_first("block"), "lang", "key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts, arrays = None, [], {}
        for batch in batches:
            bucket, block = column(batch, "bucket").to_numpy(), column(batch, "block")
            asks = block.is_valid().to_numpy(zero_copy_only=False)
            edges = np.flatnonzero(np.diff(bucket)) + 1
            for a, b in zip([0, *edges], [*edges, batch.num_rows]):
                if a == b:
                    continue
                if bucket[a] != now:
                    now, parts, arrays = bucket[a], [], {}
                known = a + int(np.count_nonzero(~asks[a:b]))
                if known > a:
                    # unsigned order: sorted again by language below
                    parts.append(batch.slice(a, known - a).select(["key", "lang", "first", "second"]))
                if known == b:
                    continue
                if parts:
                    table = pa.Table.from_batches(parts)
                    langs, key = np.array(table.column("lang").to_pylist(), dtype=object), table.column("key").to_numpy().view(np.uint64)
                    values = [table.column(c).to_numpy() for c in ("first", "second")]
                    for lang in dict.fromkeys(langs.tolist()):
                        mine = np.flatnonzero(langs == lang)
                        mine = mine[np.argsort(key[mine])]
                        arrays[lang] = (key[mine], *(v[mine] for v in values))
                    parts = []
                out = []
                for who, base, keys in zip(*(column(batch, c).slice(known, b - known).to_pylist() for c in ("block", "base", "keys"))):
                    keys = np.frombuffer(keys, np.uint64)
                    for lang, (key, first, second) in arrays.items():
                        at = np.minimum(np.searchsorted(key, keys), len(key) - 1)
                        found = np.flatnonzero(key[at] == keys)
                        if len(found):
                            out.append((who, lang, len(found), packed(np.diff(found, prepend=-base)), packed(first[at[found]]), packed(second[at[found]])))
                if out:
                    kinds = (pa.int64(), pa.string(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*out), kinds)], names=["block", "lang", "n", "at", "first", "second"])

    return dealt.mapInArrow(run, "block long, lang string, n long, at binary, first binary, second binary")


JUDGED = "doc_id long, held boolean, lang string, crc long, n long, best string, h1 double, h2 double"


def _judged(blocks: DataFrame, answers: DataFrame, base: float) -> DataFrame:
    """Each document's language of the lowest cross-entropy (nats a character), that of the next one, and its characters.

    A block is its words, its documents and the answers by language, in this order; the model's values of one language are held at a time.
    """
    texts = blocks.where("kind < 2").select("block", "kind", "doc_id", "held", "label", "crc", "ids", "times", "sizes", "words")
    rows = texts.unionByName(answers.withColumn("kind", F.lit(2)), allowMissingColumns=True).repartition("block").sortWithinPartitions("block", "kind", "lang")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, block = None, None
        for batch in batches:
            for row in batch.to_pylist():
                if row["block"] != now:
                    if block is not None:
                        yield from block.result()
                    now, block = row["block"], _Block(base)
                block.take(row)
        if block is not None:
            yield from block.result()

    return rows.mapInArrow(run, JUDGED)


class _Block:
    """One block's words and documents, and the documents' log-likelihoods in each language in turn."""

    def __init__(self, base: float):
        self.base, self.grams, self.docs, self.lang, self.sums, self.ready = base, None, [], None, {}, False

    def take(self, row: dict) -> None:
        if row["kind"] == 0:
            self.grams = Grams(row["words"].split(" ")) if row["words"] else None
            self.chars = np.array([len(w) + 1 for w in row["words"].split(" ")] if row["words"] else [], dtype=np.int64)
        elif row["kind"] == 1:
            n, edges = sum(row["sizes"]), np.cumsum(row["sizes"])[:-1]
            ids, times = (np.split(unpacked(row[c], n), edges) for c in ("ids", "times"))
            self.docs += zip(row["doc_id"], row["held"], row["label"], row["crc"], map(np.cumsum, ids), times)
        else:
            if row["lang"] != self.lang or not self.ready:
                self.finish()
                self.lang, self.ready = row["lang"], True
                self.first, self.second = np.zeros(len(self.grams.keys)), np.zeros(len(self.grams.keys))
            at, first, second = (unpacked(row[c], row["n"]) for c in ("at", "first", "second"))
            at = np.cumsum(at)
            self.first[at], self.second[at] = first.view(np.float32), second.view(np.float32)

    def finish(self) -> None:
        if self.ready:
            logs = self.grams.word_logs(self.first, self.second, self.base)
            self.sums[self.lang] = np.array([float(logs[ids] @ times) for *_, ids, times in self.docs])
            self.ready = False

    def result(self) -> Iterator[pa.RecordBatch]:
        self.finish()
        n = np.array([int(self.chars[ids] @ times) if len(ids) else 0 for *_, ids, times in self.docs], dtype=np.int64)
        langs = sorted(self.sums)
        uniform = -np.log(self.base)
        h = np.stack([*(-self.sums[x] for x in langs), n * uniform]) / np.maximum(n, 1)  # the last: no language, all characters alike
        best = h[:-1].argmin(axis=0) if langs else np.zeros(len(n), dtype=int)
        h1 = np.where(n > 0, h[best, np.arange(len(n))], np.nan)
        h[best, np.arange(len(n))] = np.inf
        h2 = np.where(n > 0, h.min(axis=0), np.nan)
        for a in range(0, len(n), 5000):
            part = range(a, min(a + 5000, len(n)))
            yield pa.RecordBatch.from_arrays(
                [
                    *(pa.array([self.docs[i][k] for i in part], t) for k, t in enumerate((pa.int64(), pa.bool_(), pa.string(), pa.int64()))), pa.array(n[part]), pa.array([langs[best[i]] if langs and n[i] else None for i in part], pa.string()),
                    pa.array(h1[part], from_pandas=True), pa.array(h2[part], from_pandas=True),
                ],
                names=["doc_id", "held", "lang", "crc", "n", "best", "h1", "h2"],
            )


def identify_languages(docs: DataFrame, id_col: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """One row per row of docs: doc_id, held_out, lang_pred, score (0 to 1), rejected, cross_entropy (nats a character).

    Folds by crc32(id as text): mod 4 = 2 is held out and never learned from; of the rest, every eighth row calibrates (the score's
    curve from at most ``CALIBRATION_ROWS`` of them, those of the smallest crc32; each language's limit of cross-entropy from all) and
    the others are counted, all of them.  ``lang_pred`` is the language of the lowest length-normalised cross-entropy
    (ties: the first by name), ``und`` for a text that is null or has no letter, or where nothing could be learned.  ``score`` estimates
    the chance that it is right.  ``rejected``: no prediction, a score under one half, or a cross-entropy above the language's limit.
    A null language is not learned from, "" is a language; a null id counts as the text "" for folds; repeated rows each count;
    other columns are ignored; an empty table gives no rows.
    """
    crc = F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    held, label = crc % 4 == 2, F.when(crc % 4 != 2, F.col(lang))
    use = label.isNotNull() & (F.floor(crc / 4) % 8 != 7)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("__text"), held.alias("__held"), label.alias("__lang"), crc.alias("__crc"), use.alias("__use"))
    blocks = stored(profiles(rows))
    levels = ngram_levels(blocks)
    entries = model_entries(levels)
    many = levels.count()
    bits = max(2, int(2 * many / BUCKET_ENTRIES).bit_length())
    alphabet = levels.where("order = 1").select("lo").distinct().count() + 1
    judged = stored(_judged(blocks, _answers(_bucketed(entries, bits), _questions(blocks, bits)), 1.0 / max(2, alphabet)))
    discard(blocks)
    known = judged.where("not held and lang is not null and best is not null and floor(crc / 4) % 8 = 7")
    sample = known.select("crc", "doc_id", (F.col("n") * (F.col("h2") - F.col("h1"))).alias("margin"), (F.col("lang") == F.col("best")).cast("double").alias("right")).orderBy("crc", "doc_id", "margin").limit(CALIBRATION_ROWS).toArrow()
    margin, right = (sample.column(c).to_numpy() for c in ("margin", "right"))
    # a text without evidence is right or wrong: two rows that keep the curve finite where all predictions are right
    x = np.log1p(np.maximum(np.append(margin, [0.0, 0.0]), 0.0))
    a, b = fit_curve(np.column_stack([np.ones(len(x)), x]), np.append(right, [0.0, 1.0])).tolist()
    score = F.when(F.col("best").isNull(), 0.0).otherwise(1 / (1 + F.exp(-(a + b * F.log1p(F.greatest(F.lit(0.0), F.col("n") * (F.col("h2") - F.col("h1"))))))))
    limits = known.where("lang = best").groupBy(F.col("best").alias("__best")).agg(F.percentile_approx("h1", PASSED, 10_000).alias("limit"))
    out = judged.join(limits, F.col("best") == F.col("__best"), "left").withColumn("score", score)
    beyond = F.coalesce(F.col("h1") > F.col("limit"), F.lit(False))
    return out.select(
        "doc_id", F.col("held").alias("held_out"), F.coalesce("best", F.lit("und")).alias("lang_pred"), "score", (F.col("best").isNull() | (F.col("score") < 0.5) | beyond).alias("rejected"), F.col("h1").alias("cross_entropy")
    )


def op12_kneser_ney_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_languages(spark.read.parquet(f"{sf_dir}/documents.parquet"))
