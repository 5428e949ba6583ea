"""Packing along a space-filling curve.

Hashed document vectors are projected to three dimensions; documents are ordered by the
Hilbert key of that point, dealt out by ranges of the key, and packed one after another,
so that neighbours on the curve share sequences.
"""

from __future__ import annotations

import os
import string
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packetrisk.llm.store import discard, stored
from packetrisk.llm.textops import column, kept_in_worker, mix, slices, to_bytes

DIMENSIONS, LEVELS = 3, 10
_AXES = [f"x{d}" for d in range(DIMENSIONS)]
#: Bytes of text of one range.
RANGE_BYTES = 24 << 20
#: Parts of a range whose bytes are summed to place its bounds.
FINE = 16
TOKENIZER = "word_bpe_49k.json"
END_ID = 1

_SIGNS = np.random.default_rng(11).standard_normal((1024, DIMENSIONS))


def project(texts: list[bytes]) -> np.ndarray:
    """Mean projection of each text's hashed byte 4-grams to DIMENSIONS numbers; zero for texts under 4 bytes."""
    out = np.zeros((len(texts), DIMENSIONS), dtype=np.float32)
    full = [i for i, t in enumerate(texts) if len(t) >= 4]
    for block in _blocks(full, texts):
        raw, counts, at = b"".join([texts[i] for i in block]), np.empty((len(block), len(_SIGNS))), 0
        code = np.empty(len(raw) - 3, dtype=np.uint32)
        for o in range(4):
            code[o::4] = np.frombuffer(raw, dtype="<u4", offset=o, count=(len(raw) - o) // 4)
        code *= np.uint32(2654435761)
        code >>= np.uint32(22)
        slot = code.astype(np.intp)
        for row, i in enumerate(block):
            counts[row] = np.bincount(slot[at : at + len(texts[i]) - 3], minlength=len(_SIGNS))
            at += len(texts[i])
        out[block] = counts @ _SIGNS / counts.sum(axis=1, keepdims=True)
    return out


def _blocks(rows: list[int], texts: list[bytes], size: int = 128 << 10, many: int = 128) -> Iterator[list[int]]:
    """Runs of ``rows`` that fit a processor's cache: about ``size`` bytes of text, at most ``many`` texts."""
    block, held = [], 0
    for i in rows:
        if block and (held + len(texts[i]) > size or len(block) == many):
            yield block
            block, held = [], 0
        block.append(i)
        held += len(texts[i])
    if block:
        yield block


def hilbert_key(cells: np.ndarray, bits: int = LEVELS) -> np.ndarray:
    """Position along the Hilbert curve of integer cells (rows), by the transpose form of the curve's definition."""
    x = cells.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            high = (x[i] & q) > 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & p)
            x[0] ^= np.where(high, p, swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    flip, q = np.zeros_like(x[0]), 1 << (bits - 1)
    while q > 1:
        flip ^= np.where(x[n - 1] & q, q - 1, 0)
        q >>= 1
    x ^= flip
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = key << 1 | (x[i] >> b) & 1
    return key


def curve_keys(points: np.ndarray, cuts: list[np.ndarray], tie: np.ndarray) -> np.ndarray:
    """Hilbert key of points in the cells between each dimension's cut values, with 32 bits of tie order below it."""
    cells = np.column_stack([np.searchsorted(cuts[d], points[:, d], side="right") for d in range(DIMENSIONS)])
    return hilbert_key(cells) << 32 | tie


def _ties(batch: pa.RecordBatch) -> np.ndarray:
    """A spread-out order of equal texts, so that many copies do not fall into one range."""
    ids = column(batch, "doc_id").fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
    return (mix(ids.view(np.uint64)) >> np.uint64(32)).astype(np.int64)


def _points(docs: DataFrame) -> DataFrame:
    """The point, tie order and bytes of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "__text"):
                texts = to_bytes(column(batch, "__text"))
                points = project(texts)
                yield pa.RecordBatch.from_arrays([*(pa.array(points[:, d]) for d in range(DIMENSIONS)), pa.array(_ties(batch)), pa.array([len(t) for t in texts], pa.int64())], names=[*_AXES, "tie", "size"])

    return docs.mapInArrow(run, ", ".join(f"{x} float" for x in _AXES) + ", tie long, size long")


def _quantiles(df: DataFrame, columns: list[str], parts: int) -> list[np.ndarray]:
    """Values that cut each column into ``parts`` parts of nearly equally many rows, from all rows; none of an empty table."""
    found = df.approxQuantile(columns, (np.arange(1, parts) / parts).tolist(), 1 / (4 * parts))
    return [np.array(f, dtype=np.float64) for f in found]


def curve_cells(docs: DataFrame, range_bytes: int = RANGE_BYTES) -> tuple[list[np.ndarray], np.ndarray]:
    """Cut values of each dimension (equally filled cells) and bounds of key ranges of about ``range_bytes`` bytes of text.

    Both come from the points of all documents, a small table that is read a few times and deleted.  What reaches the driver is
    the cuts and, for each range, FINE parts and their bytes.
    """
    points = stored(_points(docs))
    cuts = _quantiles(points, _AXES, 1 << LEVELS)
    ranges = max(1, -(-(points.agg(F.sum("size")).first()[0] or 0) // range_bytes))

    def keys_of(batch: pa.RecordBatch) -> np.ndarray:
        return curve_keys(np.column_stack([column(batch, x).to_numpy() for x in _AXES]), cuts, column(batch, "tie").to_numpy())

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(keys_of(batch))], names=["key"])

    edges = np.empty(0, dtype=np.int64)
    if ranges > 1:
        edges = np.unique(_quantiles(points.mapInArrow(keyed, "key long"), ["key"], FINE * ranges)[0].astype(np.int64))

    def weighed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight = np.zeros(len(edges) + 1, dtype=np.int64)
        for batch in batches:
            np.add.at(weight, np.searchsorted(edges, keys_of(batch), side="right"), column(batch, "size").to_numpy() + 64)
        part = np.flatnonzero(weight)
        yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(weight[part])], names=["part", "weight"])

    bounds = edges
    if len(edges):
        weight = np.zeros(len(edges) + 1, dtype=np.int64)
        for part, n in points.mapInArrow(weighed, "part long, weight long").groupBy("part").agg(F.sum("weight")).collect():
            weight[part] = n
        filled = np.cumsum(weight)
        last = np.searchsorted(filled, np.arange(1, ranges) / ranges * filled[-1])
        bounds = np.unique(edges[last[last < len(edges)]])
    discard(points)
    return cuts, bounds


class ChunkIds(dict):
    """White-space-free chunk -> its token ids as little-endian 32-bit bytes; whole slices are filled at once.

    The tokenizer drops white space before it merges, so a text's ids are those of its chunks in order, and
    letters and the ASCII marks after them are merged apart.  New words of letters are encoded many at once,
    joined by spaces: each ends in the one token of it that the vocabulary marks as the end of a word.
    """

    LIMIT = 700_000
    MARKS = "".join(c for c in string.punctuation if c not in "'_")

    def __init__(self, path: str):
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True

    def _encode(self, items: list[str]) -> None:
        for item, coded in zip(items, self.tokenizer.encode_batch_fast(items, add_special_tokens=False)):
            self[item] = np.array(coded.ids, dtype="<u4").tobytes()

    def _encode_words(self, words: list[str], many: int = 500) -> None:
        groups = [words[i : i + many] for i in range(0, len(words), many)]
        for group, coded in zip(groups, self.tokenizer.encode_batch_fast([" ".join(g) for g in groups], add_special_tokens=False)):
            ids = np.array(coded.ids, dtype="<u4")
            end = np.flatnonzero(self.ends[ids]) + 1
            if len(end) != len(group) or end[-1] != len(ids):  # a word that lower-casing parts
                self._encode(group)
                continue
            raw, edges = ids.tobytes(), [0, *(4 * end).tolist()]
            self.update((w, raw[p:q]) for w, p, q in zip(group, edges, edges[1:]))

    def fill(self, texts: list[list[str]]) -> None:
        asked = set().union(*texts)
        if len(self) > self.LIMIT:  # what these texts ask for again stays
            kept = {item: self[item] for item in asked if item in self}
            self.clear()
            self.update(kept)
        words, rest, parted = set(), set(), []
        # item by item: a set less the keys would go through all keys
        for item in [item for item in asked if item not in self]:
            if item.isalpha():
                words.add(item)
            elif (word := item.rstrip(self.MARKS)).isalpha():
                marks = item[len(word) :]
                parted.append((item, word, marks))
                words.add(word)
                rest.add(marks)
            else:
                rest.add(item)
        self._encode_words([w for w in words if w not in self])
        self._encode([r for r in rest if r not in self])
        for item, word, marks in parted:
            self[item] = self[word] + self[marks]


def chunks(text: bytes) -> list[str]:
    """The text split at spaces and line ends (others are left to the tokenizer); ASCII lower case unless a special token may occur."""
    return (text if b"<|" in text else text.lower()).replace(b"\n", b" ").decode("utf-8", "replace").split(" ")


class Packer:
    """Fills sequences of ``size`` tokens with what comes, cutting documents at their edges."""

    def __init__(self, size: int, first: int):
        self.size, self.sequence, self.offset = size, first, 0
        self.rows: list[list] = []

    def add(self, doc, ids: bytes) -> None:
        n, at = len(ids) // 4, 0
        while at < n:
            take = min(n - at, self.size - self.offset)
            self.rows.append([doc, at, take, zlib.crc32(ids[4 * at : 4 * (at + take)]), n, self.sequence, self.offset])
            at += take
            self.offset += take
            if self.offset == self.size:
                self.sequence, self.offset = self.sequence + 1, 0

    def taken(self) -> list[list]:
        """Rows of full sequences."""
        done = [r for r in self.rows if r[5] != self.sequence]
        self.rows = [r for r in self.rows if r[5] == self.sequence]
        return done


def pack_documents(df: DataFrame, size: int = 2048, tokenizer: str | None = None, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Pieces of documents in sequences of at most ``size`` tokens: one row per piece.

    Columns: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.  A document is its token
    ids and END_ID; a null or empty text is END_ID alone.  Sequences are full, except the last of each key
    range.  A row with a null id is packed like any other; repeated rows are packed each; other columns are
    ignored; an empty table gives no rows.  ``tokenizer`` is the vocabulary file.

    One shuffle of the texts, by key range; a range's documents pass through its task as a stream.  Cells and ranges are placed by a
    pass over all documents before it.
    """
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path(TOKENIZER)
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("__text"))
    cuts, bounds = curve_cells(docs)

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "__text"):
                keys = curve_keys(project(to_bytes(column(batch, "__text"))), cuts, _ties(batch))
                part = np.searchsorted(bounds, keys, side="right")
                yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), column(batch, "__text"), pa.array(keys), pa.array(part.astype(np.int32))], names=["doc_id", "__text", "key", "part"])

    ordered = docs.mapInArrow(keyed, "doc_id long, __text string, key long, part int")
    ordered = ordered.repartitionById(len(bounds) + 1, F.col("part")).sortWithinPartitions("key", "doc_id")
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    end = np.array([END_ID], dtype="<u4").tobytes()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, packer = kept_in_worker(f"chunk ids of {tokenizer}", lambda: ChunkIds(tokenizer)), None
        rows_of = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names=names)
        for whole in batches:
            for batch in slices(whole, "__text"):
                if packer is None:
                    packer = Packer(size, column(batch, "part")[0].as_py() << 40)
                split = [chunks(t) for t in to_bytes(column(batch, "__text"))]
                known.fill(split)
                for doc, words in zip(column(batch, "doc_id").to_pylist(), split):
                    packer.add(doc, b"".join(map(known.__getitem__, words)) + end)
                if done := packer.taken():
                    yield rows_of(done)
        if packer is not None and packer.rows:
            yield rows_of(packer.rows)

    return ordered.select("doc_id", "__text", "part").mapInArrow(pack, ", ".join(f"{n} long" for n in names))


def op4_hilbert_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
