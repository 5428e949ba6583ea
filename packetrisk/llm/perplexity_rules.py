"""Quality rules: base counts of a text and an n-gram perplexity band per language.

A modified Kneser-Ney model over text symbols is counted by Spark over all texts of
each language, kept in sorted arrays, and scores every text; texts outside their
language's band of log-perplexity are rejected.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packetrisk.llm.kneser_ney import SymbolModel
from packetrisk.llm.store import loaded, shared_object, stored
from packetrisk.llm.symbols import BITS, symbol_grams
from packetrisk.llm.textops import WordHashes, column, hash_words, mix, slices, space_words, to_bytes, window_docs, window_hashes

ORDER = 4
#: Weight of a language's own model against the pooled one.
OWN = 0.5
#: Width of a language's band: this many robust standard deviations of log-perplexity below and above the median.
BELOW, ABOVE = 5.5, 8.0

_SPACE = bytes([0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D])
_MARKS = b"#*$%&|<>"
_NOT_CHARS = _SPACE + bytes(range(0x80, 0xC0))  # white space and continuation bytes
def base_counts(texts: list[bytes], cache: WordHashes) -> dict[str, list[int]]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of every text."""
    words = [space_words(t) for t in texts]
    hashes, bounds = hash_words(words, cache)
    repeat = np.zeros(len(texts), dtype=np.int64)
    if len(hashes) >= 3:
        doc, inside = window_docs(bounds, 3, len(hashes))
        at = np.flatnonzero(inside)
        keys = mix(window_hashes(hashes, 3)[at] ^ mix(doc[at].astype(np.uint64) + np.uint64(1)))
        order = np.argsort(keys)
        same = keys[order][1:] == keys[order][:-1]
        twice = np.zeros(len(at), dtype=bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        cover = np.zeros(len(hashes) + 3, dtype=np.int64)
        begin = at[twice]
        np.add.at(cover, begin, 1)
        np.add.at(cover, begin + 3, -1)
        covered = np.append(0, np.cumsum(np.cumsum(cover[: len(hashes)]) > 0))
        repeat = covered[bounds[1:]] - covered[bounds[:-1]]
    dup = []
    for t in texts:
        lines = [x for x in t.split(b"\n") if x.strip(_SPACE)]
        dup.append(len(lines) - len(set(lines)))
    return {
        "n_words": [len(w) for w in words],
        "word_chars": [len(t.translate(None, _NOT_CHARS)) for t in texts],
        "n_symbols": [len(t) - len(t.translate(None, _MARKS)) for t in texts],
        "n_dup_lines": dup,
        "n_repeat_words": repeat.tolist(),
    }


class LanguageModels:
    """Sorted n-gram codes; each language's log-probabilities of them; the pooled model for n-grams never counted.

    A language's probability is mixed with that of the model of all languages, so that a passage
    in another language is not taken for noise.
    """

    def __init__(self, codes: np.ndarray, scores: dict[str, np.ndarray], pooled: SymbolModel):
        self.codes, self.scores, self.pooled = codes, scores, pooled


def language_models(rows: DataFrame) -> LanguageModels:
    """One model per language, counted over every text of ``rows`` (__lang, __text).

    Tasks count their texts' n-grams and Spark sums the counts.  A language has at most 2**24
    n-grams by the size of the symbol set, however much text is counted.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}

        def merge(parts: list[tuple[np.ndarray, np.ndarray]]) -> None:
            code, where = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
            parts[:] = [(code, np.bincount(where, np.concatenate([p[1] for p in parts]), len(code)).astype(np.int64))]

        for whole in batches:
            for batch in slices(whole, "__text"):
                texts = to_bytes(column(batch, "__text"))
                langs = np.array(column(batch, "__lang").to_pylist(), dtype=object)
                for lang in dict.fromkeys(langs.tolist()):
                    codes, _ = symbol_grams([texts[i] for i in np.flatnonzero(langs == lang)], ORDER)
                    held.setdefault(lang, []).append(np.unique(codes, return_counts=True))
                    if len(held[lang]) == 8:
                        merge(held[lang])
        for lang, parts in held.items():
            merge(parts)
            code, n = parts[0]
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(code), pa.string()), pa.array(code.astype(np.int64)), pa.array(n)], names=["lang", "code", "n"])

    counted = rows.mapInArrow(run, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n")).toArrow()
    langs = counted.column("lang").combine_chunks().dictionary_encode()
    which, code, n = langs.indices.to_numpy(), counted.column("code").to_numpy(), counted.column("n").to_numpy()
    keys, where = np.unique(code, return_inverse=True)
    pooled = SymbolModel(keys, np.bincount(where, n, len(keys)), ORDER, BITS)
    scores = {}
    for i, lang in enumerate(langs.dictionary.to_pylist()):
        own = SymbolModel(code[which == i], n[which == i], ORDER, BITS).log_prob(keys)
        scores[lang] = np.log(OWN * np.exp(own) + (1 - OWN) * np.exp(pooled.levels[-1][1])).astype(np.float32)
    return LanguageModels(keys, scores, pooled)


def text_scores(rows: DataFrame, models: LanguageModels) -> DataFrame:
    """Base counts and log-perplexity (null for an empty text) of each row of (doc_id, __lang, __text)."""
    shared = shared_object(rows.sparkSession, models)
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, models = WordHashes(), loaded(shared.value, LanguageModels, SymbolModel)
        table = np.zeros(1 << (ORDER * BITS), dtype=np.float32)
        for whole in batches:
            for batch in slices(whole, "__text"):
                texts = to_bytes(column(batch, "__text"))
                langs = np.array(column(batch, "__lang").to_pylist(), dtype=object)
                score = np.full(len(texts), np.nan)
                for lang in dict.fromkeys(langs.tolist()):
                    here = np.flatnonzero(langs == lang)
                    codes, bounds = symbol_grams([texts[i] for i in here], ORDER)
                    if not len(codes):
                        continue
                    table[models.codes] = models.scores[lang]
                    values = table[codes].astype(np.float64)
                    new = np.flatnonzero(values == 0.0)
                    if len(new):
                        values[new] = models.pooled.log_prob(codes[new].astype(np.int64))
                    full = np.flatnonzero(np.diff(bounds))
                    score[here[full]] = -np.add.reduceat(values, bounds[full]) / np.diff(bounds)[full]
                counts = base_counts(texts, cache)
                yield pa.RecordBatch.from_arrays(
                    [column(batch, "doc_id"), column(batch, "__lang"), *(pa.array(counts[c], pa.int64()) for c in names), pa.array(score, pa.float64(), from_pandas=True)],
                    names=["doc_id", "lang", *names, "log_perplexity"],
                )

    return rows.mapInArrow(run, "doc_id long, lang string, " + ", ".join(f"{c} long" for c in names) + ", log_perplexity double")


def quality_rules(df: DataFrame, id_col: str = "doc_id", text: str = "text", lang: str = "lang", below: float = BELOW, above: float = ABOVE) -> DataFrame:
    """One row per input row: base counts, base_failed, log_perplexity, the language's band, and kept.

    ``base_failed``: fewer than 50 words, or more than half of the words in repeated 3-word windows.
    ``kept``: not base_failed and log_perplexity inside the band: median minus ``below`` (plus ``above``)
    robust standard deviations (1.4826 times the median absolute deviation, at least 0.01) over the
    language's texts that did not fail.  A null text is empty and fails; a null language is a language
    of its own; repeated rows each count; other columns are ignored; an empty table gives no rows.
    """
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(lang), F.lit("")).alias("__lang"), F.col(text).alias("__text"))
    scored = stored(text_scores(rows, language_models(rows.select("__lang", "__text"))))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    scored = scored.withColumn("base_failed", failed)
    good = scored.where(~F.col("base_failed") & F.col("log_perplexity").isNotNull())
    middle = good.groupBy("lang").agg(F.percentile_approx("log_perplexity", 0.5, 10_000).alias("median"))
    spread = good.join(F.broadcast(middle), "lang").groupBy("lang", "median").agg(F.percentile_approx(F.abs(F.col("log_perplexity") - F.col("median")), 0.5, 10_000).alias("mad"))
    sd = F.greatest(F.lit(0.01), 1.4826 * F.col("mad"))
    bands = spread.select("lang", (F.col("median") - below * sd).alias("lower"), (F.col("median") + above * sd).alias("upper"))
    out = scored.join(F.broadcast(bands), "lang", "left")
    inside = F.coalesce(F.col("log_perplexity").between(F.col("lower"), F.col("upper")), F.lit(False))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & inside).alias("kept"), "log_perplexity", "lower", "upper")


def op7_perplexity_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(spark.read.parquet(f"{sf_dir}/documents.parquet"))
