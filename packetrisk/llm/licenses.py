"""License scan: a positional index of rare license words.

Each template's highest-IDF words are indexed by position: so many that the others
cannot reach the needed share of its IDF weight.  In each text the indexed words are
looked up, their postings are intersected by relative position (text position minus
template position), and an alignment counts when enough of the template's IDF weight
lies on it and its mandatory phrases stand there.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packetrisk.llm.textops import alnum_words, column, slices, to_bytes

#: Phrases whose every place is reported, with their labels.
BASE_PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

#: Label, mandatory phrases, template (notices that license texts ask for).
TEMPLATES = [
    ("gpl-3.0", ["gnu general public license", "version 3"], "this work is licensed under the gnu general public license version 3"),
    ("gpl-3.0", ["gnu general public license", "either version 3"], "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("gpl-2.0", ["gnu general public license", "version 2"], "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version"),
    ("lgpl-2.1", ["gnu lesser general public license"], "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version"),
    ("agpl-3.0", ["gnu affero general public license"], "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("apache-2.0", ["apache license", "version 2 0"], "licensed under the apache license version 2 0"),
    ("apache-2.0", ["apache license", "version 2 0"], "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("mit", ["permission is hereby granted free of charge"], "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software"),
    ("mit", ["mit license"], "released under the mit license"),
    ("mit", ["mit license"], "licensed under the mit license"),
    ("bsd-3-clause", ["redistribution and use in source and binary forms", "neither the name"], "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("bsd-2-clause", ["redistribution and use in source and binary forms"], "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("mpl-2.0", ["mozilla public license"], "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at"),
    ("isc", ["permission to use copy modify and or distribute this software"], "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("unlicense", ["free and unencumbered software"], "this is free and unencumbered software released into the public domain"),
    ("cc-by-4.0", ["cc by", "4 0"], "this text is available under cc by 4 0"),
    ("cc-by-sa-4.0", ["cc by sa"], "this text is available under cc by sa 4 0"),
    ("cc-by-4.0", ["creative commons attribution"], "this work is licensed under a creative commons attribution 4 0 international license"),
    ("epl-2.0", ["eclipse public license"], "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0"),
]

SCHEMA = (
    "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, "
    "matches array<struct<label:string,word:long,score:double>>"
)


class LicenseIndex:
    """Postings of template words by position, with the IDF measured on the scanned corpus: 1 + log((1 + documents) / (1 + those with the word)).

    No word weighs nothing, so that a notice is found where every document holds its words, too.
    """

    def __init__(self, df_counts: dict[bytes, int], n_docs: int, templates=TEMPLATES, phrases=BASE_PHRASES, rarest: int = 6, share: float = 0.5):
        self.rarest, self.share = rarest, share
        self.base = [(p.encode().split(), label) for p, label in phrases.items()]
        self.templates = [(label, [k.encode().split() for k in keys], text.encode().split()) for label, keys, text in templates]
        words = {w for _, _, t in self.templates for w in t} | {w for p, _ in self.base for w in p}
        self.idf = {w: 1.0 + float(np.log((1 + n_docs) / (1 + df_counts.get(w, 0)))) for w in words}
        self.weight = [sum(self.idf[w] for w in t) for _, _, t in self.templates]
        self.postings: dict[bytes, list[tuple[int, int]]] = defaultdict(list)
        #: IDF weight of each template's words that are not indexed: less than half of the share, so no alignment that counts is missed.
        self.rest: list[float] = []
        for t, (_, _, text) in enumerate(self.templates):
            rest, many, indexed = self.weight[t], Counter(text), set()
            for w in sorted(many, key=lambda w: (-self.idf[w], w)):
                if len(indexed) >= rarest and rest < share / 2 * self.weight[t]:
                    break
                indexed.add(w)
                rest -= many[w] * self.idf[w]
            self.rest.append(rest)
            for at, w in enumerate(text):
                if w in indexed:
                    self.postings[w].append((t, at))
        self.heads = {p[0] for p, _ in self.base}

    def scan(self, words: list[bytes]) -> tuple:
        """(n_words, n_base, first, last, base labels, labels, score, matches) of one text."""
        places: dict[bytes, list[int]] = defaultdict(list)
        for i, w in enumerate(words):
            if w in self.idf:
                places[w].append(i)
        starts, base = [], set()
        for phrase, label in self.base:
            found = [i for i in places.get(phrase[0], ()) if words[i : i + len(phrase)] == phrase]
            starts += found
            base |= {label} if found else set()
        matches, best = self.align(words, places) if len(places) > 1 else ([], 0.0)
        labels = base | {m["label"] for m in matches}
        return len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), best, matches

    def align(self, words: list[bytes], places: dict[bytes, list[int]]) -> tuple[list[dict], float]:
        votes, found = Counter(), defaultdict(float)
        for w, at_text in places.items():
            for t, at in self.postings.get(w, ()):
                for i in at_text:
                    votes[t, i - at] += 1
                    found[t, i - at] += self.idf[w]
        matches, best = {}, 0.0
        for (t, shift), n in votes.items():
            if n < 2 and found[t, shift] + self.rest[t] < self.share * self.weight[t] - 1e-9:
                continue
            label, keys, text = self.templates[t]
            there = words[max(0, shift) : shift + len(text)]
            mine = text[max(0, -shift) :]
            hit = sum(self.idf[w] for w, x in zip(mine, there) if w == x)
            score = min(1.0, hit / self.weight[t])
            best = max(best, score)
            near = words[max(0, shift - 4) : shift + len(text) + 4]
            if score >= self.share and all(any(near[i : i + len(k)] == k for i in range(len(near) - len(k) + 1)) for k in keys):
                matches[label, max(0, shift)] = max(score, matches.get((label, max(0, shift)), 0.0))
        return [{"label": k[0], "word": k[1], "score": s} for k, s in sorted(matches.items())], best


def license_word_counts(df: DataFrame, text: str, words: set[bytes]) -> tuple[dict[bytes, int], int]:
    """Documents that hold each license word, and all documents: counted over every text, summed by Spark.

    The answer has one row per license word at most, whatever the input.
    """
    order = sorted(words)
    where = {w: i for i, w in enumerate(order)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, n = np.zeros(len(order) + 1, dtype=np.int64), 0
        for whole in batches:
            for batch in slices(whole, text):
                for b in to_bytes(column(batch, text)):
                    n += 1
                    found = where.keys() & set(alnum_words(b))
                    if found:
                        seen[[where[w] for w in found]] += 1
        seen[-1] = n
        yield pa.RecordBatch.from_pydict({"word": pa.array(np.arange(len(seen))), "n": pa.array(seen)})

    rows = df.select(text).mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    counts = {r["word"]: r["n"] for r in rows}
    return {w: counts.get(i, 0) for w, i in where.items()}, counts.get(len(order), 0)


def scan_licenses(df: DataFrame, id_col: str = "doc_id", text: str = "text", templates=TEMPLATES, phrases=BASE_PHRASES) -> DataFrame:
    """One row per input row: base phrase places, labels of base phrases and of aligned templates, best score.

    A notice is found whatever share of the documents holds it, in a table of one row or of copies as well.  A null or empty text has no words, labels "" and score 0; a null id stays null; repeated rows
    give repeated results; other columns are ignored; an empty table gives no rows.  Two passes
    over the texts (document frequencies, then the scan); the only shuffle holds one count per license word and task.
    """
    vocabulary = {w for _, _, t in templates for w in t.encode().split()} | {w for p in phrases for w in p.encode().split()}
    index = LicenseIndex(*license_word_counts(df, text, vocabulary), templates, phrases)
    ready = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.list_(pa.struct([("label", pa.string()), ("word", pa.int64()), ("score", pa.float64())]))]
        names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "matches"]
        for whole in batches:
            for batch in slices(whole, "__text"):
                rows = [index.scan(alnum_words(t)) for t in to_bytes(column(batch, "__text"))]
                yield pa.RecordBatch.from_arrays([column(batch, "doc_id")] + [pa.array(v, type=k) for v, k in zip(zip(*rows), kinds)], names=names)

    return ready.mapInArrow(run, SCHEMA)


def op9_license_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("matches")
