"""HTML main-text extraction: flat text blocks judged by a decision tree.

A page is cut into text blocks at block-level tags.  Each block is described by
its own and its neighbours' word counts and link densities (neighbours in the same
container only) and by where it stands; a small decision tree, grown on the labelled
table below, keeps or drops it.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packetrisk.llm.textops import column, slices

FEATURES = ["words", "links", "words_before", "links_before", "words_after", "links_after", "in_article", "in_boilerplate", "heading", "item"]

#: Labelled blocks. Columns as in FEATURES, then 1 for main text.
TRAINING = [
    (46, 0.0, 7, 0.0, 51, 0.0, 1, 0, 0, 0, 1), (23, 0.0, 46, 0.0, 60, 0.0, 1, 0, 0, 0, 1), (1, 0.0, 40, 0.0, 33, 0.0, 1, 0, 0, 0, 1),
    (8, 0.0, 12, 0.0, 46, 0.0, 1, 0, 1, 0, 1), (6, 0.0, 2, 1.0, 30, 0.0, 1, 0, 1, 0, 1), (12, 0.0, 70, 0.0, 11, 0.0, 1, 0, 0, 0, 1),
    (3, 0.0, 25, 0.0, 12, 0.1, 1, 0, 0, 0, 1), (55, 0.1, 20, 0.0, 41, 0.0, 1, 0, 0, 0, 1), (9, 0.3, 31, 0.0, 28, 0.0, 1, 0, 0, 1, 1),
    (5, 0.0, 14, 0.0, 17, 0.0, 1, 0, 0, 1, 1), (30, 0.5, 40, 0.0, 35, 0.0, 1, 0, 0, 0, 1), (110, 0.02, 8, 0.0, 95, 0.0, 1, 0, 0, 0, 1),
    (2, 0.0, 0, 0.0, 0, 0.0, 1, 0, 0, 0, 1), (4, 1.0, 33, 0.0, 29, 0.0, 1, 0, 0, 0, 1), (17, 0.0, 6, 1.0, 9, 0.0, 1, 0, 0, 0, 1),
    (1, 1.0, 1, 1.0, 1, 1.0, 0, 1, 0, 1, 0), (2, 1.0, 1, 1.0, 3, 1.0, 0, 1, 0, 1, 0), (1, 1.0, 1, 1.0, 12, 0.0, 0, 1, 0, 1, 0),
    (14, 0.0, 1, 1.0, 8, 0.0, 0, 1, 0, 0, 0), (9, 0.0, 1, 1.0, 60, 0.0, 0, 1, 0, 0, 0), (22, 0.0, 40, 0.0, 0, 0.0, 0, 1, 0, 0, 0),
    (40, 0.0, 55, 0.0, 0, 0.0, 0, 1, 0, 0, 0), (35, 0.1, 50, 0.0, 21, 0.0, 0, 1, 0, 0, 0), (6, 0.0, 2, 1.0, 4, 1.0, 0, 1, 1, 0, 0),
    (27, 0.0, 3, 0.0, 44, 0.0, 0, 1, 0, 0, 0), (62, 0.0, 58, 0.0, 9, 0.0, 0, 1, 0, 0, 0), (12, 0.4, 45, 0.0, 10, 0.6, 0, 1, 0, 0, 0),
    (18, 0.0, 24, 0.0, 30, 0.0, 1, 1, 0, 0, 0), (5, 0.8, 41, 0.0, 36, 0.0, 1, 1, 0, 0, 0), (33, 0.0, 47, 0.0, 12, 0.0, 1, 1, 0, 0, 0),
    (48, 0.0, 9, 0.0, 52, 0.0, 0, 0, 0, 0, 1), (31, 0.05, 48, 0.0, 27, 0.0, 0, 0, 0, 0, 1), (16, 0.0, 35, 0.0, 44, 0.0, 0, 0, 0, 0, 1),
    (7, 0.0, 3, 1.0, 49, 0.0, 0, 0, 1, 0, 1), (9, 0.0, 38, 0.0, 31, 0.0, 0, 0, 0, 0, 1), (75, 0.1, 0, 0.0, 0, 0.0, 0, 0, 0, 0, 1),
    (3, 1.0, 2, 1.0, 3, 1.0, 0, 0, 0, 0, 0), (2, 1.0, 2, 1.0, 2, 1.0, 0, 0, 0, 1, 0), (5, 0.8, 4, 1.0, 6, 0.7, 0, 0, 0, 0, 0),
    (4, 0.0, 2, 1.0, 3, 1.0, 0, 0, 0, 0, 0), (3, 0.0, 2, 1.0, 2, 0.5, 0, 0, 0, 0, 0), (11, 0.9, 5, 1.0, 4, 1.0, 0, 0, 0, 0, 0),
    (6, 1.0, 33, 0.0, 5, 1.0, 0, 0, 0, 0, 0), (20, 0.7, 12, 0.6, 9, 0.8, 0, 0, 0, 0, 0), (2, 0.5, 6, 1.0, 3, 0.0, 0, 0, 0, 0, 0),
    (52, 0.0, 40, 0.0, 6, 1.0, 1, 0, 0, 0, 1), (4, 0.0, 36, 0.0, 5, 1.0, 1, 0, 1, 0, 1), (3, 0.0, 4, 1.0, 4, 1.0, 1, 0, 0, 0, 1),
    (6, 1.0, 5, 1.0, 7, 1.0, 1, 0, 0, 1, 1), (4, 1.0, 0, 0.0, 6, 1.0, 1, 0, 0, 1, 1), (9, 0.8, 6, 1.0, 8, 0.9, 1, 0, 0, 1, 1),
    (44, 0.0, 30, 0.0, 3, 1.0, 0, 0, 0, 0, 1), (28, 0.0, 3, 1.0, 5, 1.0, 0, 0, 0, 0, 1), (90, 0.05, 0, 0.0, 4, 0.8, 0, 0, 0, 0, 1),
    (14, 0.0, 41, 0.0, 6, 1.0, 0, 0, 0, 0, 1), (8, 0.0, 26, 0.0, 4, 0.9, 0, 0, 1, 0, 1), (37, 0.2, 22, 0.0, 9, 1.0, 0, 0, 0, 1, 1),
    (4, 0.0, 0, 0.0, 0, 0.0, 0, 0, 1, 0, 1), (11, 0.1, 0, 0.0, 13, 0.1, 0, 0, 0, 1, 1), (2, 0.0, 30, 0.0, 41, 0.0, 0, 0, 0, 0, 1),
    (3, 1.0, 0, 0.0, 40, 0.0, 0, 0, 0, 0, 0), (5, 1.0, 45, 0.0, 0, 0.0, 0, 0, 0, 0, 0), (7, 0.9, 33, 0.0, 52, 0.0, 0, 0, 0, 0, 0),
    (2, 1.0, 0, 0.0, 0, 0.0, 0, 0, 0, 0, 0), (1, 1.0, 0, 0.0, 0, 0.0, 0, 0, 0, 1, 0), (4, 1.0, 3, 1.0, 0, 0.0, 0, 0, 0, 1, 0),
    (16, 1.0, 20, 0.0, 24, 0.0, 0, 0, 0, 0, 0), (8, 1.0, 9, 1.0, 30, 0.0, 0, 0, 1, 0, 0), (25, 0.8, 0, 0.0, 0, 0.0, 0, 0, 0, 0, 0),
    (26, 0.0, 3, 1.0, 0, 0.0, 0, 0, 0, 0, 1), (15, 0.0, 4, 1.0, 2, 1.0, 0, 0, 0, 0, 1), (60, 0.0, 5, 1.0, 0, 0.0, 0, 0, 0, 0, 1),
    (12, 0.1, 6, 1.0, 3, 0.0, 0, 0, 0, 0, 1), (19, 0.0, 2, 1.0, 1, 0.0, 0, 0, 0, 1, 1), (33, 0.0, 7, 0.8, 3, 1.0, 0, 0, 0, 0, 1),
]

#: Tags that end a text block, whole elements without main text, and containers and names of boilerplate.
BLOCK_TAGS = set("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
VOID_ELEMENTS = "head|script|style|noscript|template|iframe|object|canvas|textarea|select|audio|video"
BOILERPLATE_TAGS = set("nav header footer aside form menu dialog fieldset".split())
BOILERPLATE_NAMES = set("ad ads adv advert advertisement advertising banner sponsor sponsored promo sidebar menu nav navbar navigation breadcrumb breadcrumbs footer header masthead cookie cookies consent notice gdpr newsletter subscribe signup login share sharing social related recommended popup modal overlay widget comment comments disqus respond replies toolbar pagination copyright disclaimer".split())
#: Words that a class token may hold beside a name of boilerplate ("site-footer", "ad-slot").
PLACING_WORDS = set("site page main top bottom left right global primary secondary inner outer bar box area slot block section group row col wrap wrapper container list item items link links button buttons icon icons text title body form".split())
CONTAINERS = set("article aside body center details dialog div dl fieldset figure footer form header li main menu nav ol section table td tr ul".split())
#: Containers that do not part a block from its neighbours (the list or table around them does).
ITEMS = set("li td tr".split())

_NAME = re.compile(r"[a-zA-Z][a-zA-Z0-9:-]*")
_SPECIAL = re.compile("[\"'>]")
_RAW_ENDS = {t: re.compile(rf"</{t}\s*>", re.I) for t in VOID_ELEMENTS.split("|")}
_NAMED = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_HIDDEN = re.compile(r"(?:^|\s)(?:hidden(?=[\s=/]|$)|aria-hidden\s*=\s*[\"']?true|style\s*=\s*(?:\"[^\"]*?display\s*:\s*none|'[^']*?display\s*:\s*none|display:none))", re.I)
_QUOTED = re.compile(r"(?<![\w:-])(?!style\b|aria-hidden\b)[\w:-]+\s*=\s*(?:\"[^\"]*\"|'[^']*')", re.I)
_SPACE = re.compile(r"\s+")


def grow(rows: np.ndarray, labels: np.ndarray, least: int = 2, depth: int = 6):
    """A binary tree by Gini impurity: a leaf is the share of main text, a node (feature, threshold, low, high)."""
    share = float(labels.mean())
    if depth == 0 or share in (0.0, 1.0) or len(labels) < 2 * least:
        return share
    best = None
    for f in range(rows.shape[1]):
        values = np.unique(rows[:, f])
        for cut in (values[:-1] + values[1:]) / 2:
            low = rows[:, f] <= cut
            if least <= low.sum() <= len(labels) - least:
                parts = (labels[low], labels[~low])
                impurity = sum(len(p) * p.mean() * (1 - p.mean()) for p in parts)
                if best is None or impurity < best[0] - 1e-12:
                    best = (impurity, f, float(cut), low)
    if best is None:
        return share
    _, f, cut, low = best
    return f, cut, grow(rows[low], labels[low], least, depth - 1), grow(rows[~low], labels[~low], least, depth - 1)


def trained_tree():
    table = np.array(TRAINING, dtype=float)
    return grow(table[:, :-1], table[:, -1])


def judge(tree, features) -> float:
    while isinstance(tree, tuple):
        tree = tree[2] if features[tree[0]] <= tree[1] else tree[3]
    return tree


def named_boilerplate(attrs: str) -> bool:
    """Whether a class, id or role token is a name of boilerplate, or only such names and placing words together."""
    for token in " ".join("".join(g) for g in _NAMED.findall(attrs)).lower().split():
        parts = [n for n in re.split(r"[\W\d_]+", token) if n]
        if not BOILERPLATE_NAMES.isdisjoint(parts) and all(n in BOILERPLATE_NAMES or n in PLACING_WORDS for n in parts):
            return True
    return False


def hidden(attrs: str) -> bool:
    return bool(_HIDDEN.search(_QUOTED.sub(" ", attrs)))


class _Tags:
    """Reads the tags of a page from left to right, in time that grows with its length whatever is in it.

    A quote in a tag hides what stands up to the next such quote.  Where that leaves the tag without an end, it ends at the next ``>``
    instead; the places that lead to no end are remembered, so that no later tag looks beyond them again.
    """

    def __init__(self, page: str):
        self.page, self.hopeless = page, set()
        self.last = {c: page.rfind(c) for c in "\"'>"}

    def end(self, at: int) -> int | None:
        """Where the tag ends whose name ends at ``at`` (after its ``>``); None if no ``>`` follows."""
        p, passed = at, []
        while p not in self.hopeless and p <= self.last[">"] and (m := _SPECIAL.search(self.page, p)):
            if m[0] == ">":
                return m.end()
            if m.start() >= self.last[m[0]]:
                break
            p = self.page.index(m[0], m.end()) + 1
            passed.append(p)
        self.hopeless.update(passed)
        return None if at > self.last[">"] else self.page.index(">", at) + 1

    def __iter__(self) -> Iterator[tuple[int, int, str, bool, str]]:
        """(start, end, tag in lower case, whether it ends an element, attributes); the tag is empty for other markup.

        A comment, and an element without main text, is one item up to its end, or to the end of the page.
        """
        page, at = self.page, 0
        while (start := page.find("<", at)) >= 0:
            at = start + 1
            if page.startswith("<!--", start):
                stop = page.find("-->", start + 4)
                at = len(page) if stop < 0 else stop + 3
                yield start, at, "", False, ""
                continue
            slash = page.startswith("/", at)
            name = _NAME.match(page, at + slash)
            if not name:
                if slash or page[at : at + 1] in ("!", "?"):
                    stop = page.find(">", at) if at <= self.last[">"] else -1
                    if stop >= 0:
                        at = stop + 1
                        yield start, at, "", False, ""
                continue
            stop = self.end(name.end())
            if stop is None:
                continue
            tag, attrs, at = name[0].lower(), page[name.end() : stop - 1], stop
            if tag in _RAW_ENDS and not slash:
                ends = _RAW_ENDS[tag].search(page, at)
                at = ends.end() if ends else len(page)
                tag = ""
            yield start, at, tag, slash, attrs


HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")


def text_blocks(page: str) -> list[tuple[str, int, int, bool, bool, bool, bool, int]]:
    """(text, words, linked words, in article, in boilerplate, heading, list item, container) of each block in page order."""
    # a container: tag, article, boilerplate, list item, the container that parts its blocks from others
    blocks, run, stack, opened = [], [], [], 0
    links, at, last = 0, 0, ""
    inside = {"article": 0, "boilerplate": 0, "item": 0}
    depth: Counter = Counter()

    def close() -> None:
        if run:
            text = _SPACE.sub(" ", entities.unescape("".join(t for t, _ in run))).strip()
            if text:
                linked, words = sum(len(t.split()) for t, link in run if link), len(text.split())
                blocks.append((text, words, min(words, linked), inside["article"] > 0, inside["boilerplate"] > 0, last in HEADINGS, inside["item"] > 0, stack[-1][4] if stack else 0))
            run.clear()

    def count(entry: tuple, by: int) -> None:
        depth[entry[0]] += by
        for what, holds in zip(inside, entry[1:4]):
            inside[what] += by if holds else 0

    for start, end, tag, ends, attrs in _Tags(page):
        if start > at:
            run.append((page[at:start], links > 0))
        at = end
        if tag == "a":
            links = max(0, links + (-1 if ends else 1))
        elif tag == "br":
            run.append((" ", False))
        if tag not in BLOCK_TAGS:
            continue
        close()
        links, last = 0, "" if ends else tag
        if tag not in CONTAINERS:
            continue
        if not ends and not attrs.endswith("/"):
            main = tag in ("article", "main")
            boiler = tag in BOILERPLATE_TAGS or bool(attrs) and (hidden(attrs) or not main and named_boilerplate(attrs))
            opened += 1
            stack.append((tag, main, boiler and tag != "body", tag == "li", (stack[-1][4] if stack else 0) if tag in ITEMS else opened))
            count(stack[-1], 1)
        elif ends and depth[tag]:
            while True:
                entry = stack.pop()
                count(entry, -1)
                if entry[0] == tag:
                    break
    if at < len(page):
        run.append((page[at:], links > 0))
    close()
    return blocks


def main_text(page: str, tree) -> str:
    blocks = text_blocks(page)
    side = [(w, k / w if w else 0.0) for _, w, k, *_ in blocks]
    edge, kept = (0, 0.0), []
    for i, (text, words, _, article, boiler, heading, item, within) in enumerate(blocks):
        before = side[i - 1] if i and blocks[i - 1][-1] == within else edge
        after = side[i + 1] if i + 1 < len(side) and blocks[i + 1][-1] == within else edge
        if judge(tree, (words, side[i][1], *before, *after, article, boiler, heading, item)) >= 0.5:
            kept.append(text)
    return "\n\n".join(kept)


def extract_main_text(df: DataFrame, html: str = "html") -> DataFrame:
    """``df`` without its html column but with ``text`` (the main text, "" if none) and ``n_chars`` (its code points).

    A null or empty page, and a page of boilerplate only, has the text "".  Unclosed elements and comments
    end at the end of the page; a tag whose quotes leave it without an end goes up to the next ``>``, and a ``<`` that no ``>``
    follows is text.  Time grows with the length of a page, whatever is in it.  Existing columns named text or n_chars are
    replaced; all others pass through; repeated rows stay.  One pass over the rows, no shuffle.
    """
    tree = trained_tree()
    others = [c for c in df.columns if c not in (html, "text", "n_chars")]
    ready = df.select(*others, F.coalesce(F.col(html), F.lit("")).alias("__html"))
    schema = ready.drop("__html").schema.add("text", "string").add("n_chars", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "__html"):
                texts = [main_text(p, tree) for p in column(batch, "__html").to_pylist()]
                arrays = [column(batch, c) for c in others] + [pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())]
                yield pa.RecordBatch.from_arrays(arrays, names=[*others, "text", "n_chars"])

    return ready.mapInArrow(run, schema)


def op8_html_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))
