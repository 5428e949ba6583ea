"""Benchmark decontamination by winnowing.

Of every sliding window of k-gram hashes the smallest is kept as a fingerprint.
Document and benchmark fingerprints are joined, and each hit is extended word by
word.  With k + w - 1 = n, any shared run of n words holds a common fingerprint.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packetrisk.llm.store import matching, small, stored
from packetrisk.llm.textops import WordHashes, alnum_words, column, hash_words, list_array, mix, signed, slices, to_bytes, window_docs, window_hashes

#: Benchmark fingerprints up to this number (8 MB) are sent to the scan as a filter; beyond it every fingerprint is joined.
FILTER_ROWS = 1_000_000


def winnow(words: np.ndarray, bounds: np.ndarray, n: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Fingerprints of texts of at least n words: (hash, text, first word), each text position once.

    The window minimum is the leftmost of the smallest hashes, found by doubling.
    """
    grams = window_hashes(words, k)
    if not len(grams):
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    w = n - k + 1
    bits = np.uint64(max(1, int(len(grams)).bit_length()))
    low = (grams >> bits << bits) | np.arange(len(grams), dtype=np.uint64)
    span, least = 1, low
    while span * 2 <= w:
        least = np.minimum(least[:-span], least[span:]) if len(least) > span else least[:0]
        span *= 2
    if span < w:
        least = np.minimum(least[: len(least) - (w - span)], least[w - span :]) if len(least) > w - span else least[:0]
    text, inside = window_docs(bounds, n, len(words))
    at = np.unique((least[: len(inside)][inside] & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64))
    doc = np.searchsorted(bounds, at, side="right") - 1
    return grams[at], doc, at - bounds[doc]


def whole_hash(words: np.ndarray, length: int) -> np.ndarray:
    """Hash of each run of ``length`` words, apart from those of other lengths."""
    return mix(window_hashes(words, length) ^ np.uint64(length * 0x9E3779B97F4A7C15 & (2**64 - 1)))


def benchmark_fingerprints(items: DataFrame, id_col: str, text: str, n: int, k: int) -> DataFrame:
    """(fp, short, length, item_id, before, words): fingerprints with the item words that a match may extend over."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHashes()
        for batch in batches:
            rows = []
            ids = column(batch, id_col).to_pylist()
            docs = [alnum_words(t) for t in to_bytes(column(batch, text))]
            hashes, bounds = hash_words(docs, cache)
            for fp, d, at in zip(*(x.tolist() for x in winnow(hashes, bounds, n, k))):
                begin = max(0, at - (n - k))
                rows.append((fp, False, k, ids[d], at - begin, docs[d][begin : at + n]))
            for d, words in enumerate(docs):
                if 0 < len(words) < n:
                    fp = int(whole_hash(hashes[bounds[d] : bounds[d + 1]], len(words))[0])
                    rows.append((fp, True, len(words), ids[d], 0, words))
            cols = list(zip(*rows)) or [()] * 6
            yield pa.RecordBatch.from_arrays(
                [pa.array(signed(np.array(cols[0], dtype=np.uint64))), pa.array(cols[1], pa.bool_()), pa.array(cols[2], pa.int32()), pa.array(cols[3], pa.int64()), pa.array(cols[4], pa.int32()), pa.array([b" ".join(x) for x in cols[5]], pa.binary())],
                names=["fp", "short", "length", "item_id", "before", "words"],
            )

    ready = items.select(F.col(id_col).cast("long").alias(id_col), text)
    return ready.mapInArrow(run, "fp long, short boolean, length int, item_id long, before int, words binary")


def document_fingerprints(docs: DataFrame, text: str, n: int, k: int, lengths: list[int], wanted: np.ndarray | None) -> DataFrame:
    """(doc_id, fp, at) of the documents' fingerprints and, for items of fewer than n words, of all runs of such lengths."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHashes()
        for whole in batches:
            for batch in slices(whole, text):
                hashes, bounds = hash_words([alnum_words(t) for t in to_bytes(column(batch, text))], cache)
                found = [winnow(hashes, bounds, n, k)]
                for length in lengths:
                    doc, inside = window_docs(bounds, length, len(hashes))
                    at = np.flatnonzero(inside)
                    found.append((whole_hash(hashes, length)[at], doc[at], at - bounds[doc[at]]))
                fp, doc, at = (np.concatenate(x) for x in zip(*found))
                fp = signed(fp)
                if wanted is not None:
                    here = wanted[np.minimum(np.searchsorted(wanted, fp), len(wanted) - 1)] == fp if len(wanted) else np.zeros(len(fp), bool)
                    fp, doc, at = fp[here], doc[here], at[here]
                order = np.argsort(doc, kind="stable")
                counts = np.bincount(doc, minlength=batch.num_rows)
                keep = np.flatnonzero(counts)
                yield pa.RecordBatch.from_arrays(
                    [column(batch, "doc_id").take(pa.array(keep)), list_array(fp[order], counts[keep], pa.int64()), list_array(at[order].astype(np.int32), counts[keep], pa.int32())],
                    names=["doc_id", "fps", "ats"],
                )

    ready = docs.select("doc_id", text)
    lists = ready.mapInArrow(run, "doc_id long, fps array<long>, ats array<int>")
    return lists.select("doc_id", F.explode(F.arrays_zip("fps", "ats")).alias("z")).select("doc_id", F.col("z.fps").alias("fp"), F.col("z.ats").alias("at"))


def extend(words: list[bytes], hits: list[dict], n: int) -> tuple[list[tuple[int, int]], set[int]]:
    """Verified spans [start, end) of document words, and the items whose windows stand there."""
    spans, items = [], set()
    for h in hits:
        theirs, at, before, length = h["words"].split(b" "), h["at"], h["before"], h["length"]
        if words[at : at + length] != theirs[before : before + length]:
            continue
        left, right = 0, length
        if not h["short"]:
            while left < before and at - left > 0 and words[at - left - 1] == theirs[before - left - 1]:
                left += 1
            while before + right < len(theirs) and at + right < len(words) and words[at + right] == theirs[before + right]:
                right += 1
            if left + right < n:
                continue
        spans.append((at - left, at + right))
        items.add(h["item_id"])
    return spans, items


def find_contamination(docs: DataFrame, items: DataFrame, n: int = 10, k: int | None = None, id_col: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row per document: n_words, n_hit, item_ids, spans and contaminated.

    A window is n consecutive words of an item; an item of 1 to n - 1 words is one window.
    ``n_hit`` counts document words inside an occurrence of a window.  A null or empty text has
    no words and no hits; an item without words has no window; items with a repeated id count as
    one item; a document row with a null id is checked like any other; document rows that share an
    id are each judged on their own text.  Other columns are ignored; an empty side gives no hits.

    Cost: one pass over the texts for fingerprints, one over those with a fingerprint hit.
    While the benchmark has at most ``FILTER_ROWS`` fingerprints they also filter the first pass.
    """
    k = k or (n + 1) // 2
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("__text"))
    bench = stored(benchmark_fingerprints(items.select(F.col(item_id), F.col(item_text)), item_id, item_text, n, k).distinct())
    lengths = sorted(r["length"] for r in bench.where("short").select("length").distinct().collect())
    prints = bench.select("fp").distinct()
    wanted = np.sort(prints.toArrow().column("fp").to_numpy()) if small(prints, FILTER_ROWS) else None
    hits = stored(document_fingerprints(docs, "__text", n, k, lengths, wanted).join(bench, "fp").drop("fp"))
    gathered = hits.groupBy("doc_id").agg(F.collect_set(F.struct("at", "short", "length", "item_id", "before", "words")).alias("hits"))
    with_hits = matching(docs, hits, "doc_id").alias("d").join(gathered.alias("h"), F.col("d.doc_id").eqNullSafe(F.col("h.doc_id")), "left").select("d.*", "h.hits")
    without = matching(docs, hits, "doc_id", keep=False).withColumn("hits", F.lit(None).cast(gathered.schema["hits"].dataType))
    schema = "doc_id long, n_words long, n_hit long, item_ids array<long>, spans array<struct<start:long,end:long>>, contaminated boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "__text"):
                out = []
                hits_of = column(batch, "hits").to_pylist()
                for t, found in zip(to_bytes(column(batch, "__text")), hits_of):
                    words = alnum_words(t)
                    spans, ids = extend(words, found, n) if found else ([], set())
                    merged: list[list[int]] = []
                    for a, b in sorted(spans):
                        if merged and a <= merged[-1][1]:
                            merged[-1][1] = max(b, merged[-1][1])
                        else:
                            merged.append([a, b])
                    hit = sum(b - a for a, b in merged)
                    out.append((len(words), hit, sorted(i for i in ids if i is not None), [{"start": a, "end": b} for a, b in merged], hit > 0))
                kinds = [pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.bool_()]
                yield pa.RecordBatch.from_arrays([column(batch, "doc_id")] + [pa.array(v, type=t) for v, t in zip(zip(*out), kinds)], names=["doc_id", "n_words", "n_hit", "item_ids", "spans", "contaminated"])

    return with_hits.unionByName(without).mapInArrow(run, schema)


def digests(found: DataFrame) -> DataFrame:
    names = F.array_join(F.array_sort(F.transform("item_ids", lambda i: i.cast("string"))), ",")
    return found.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), F.sha2(names, 256).alias("items_sha256"), "contaminated")


def op2_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(find_contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")))
