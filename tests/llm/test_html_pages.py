"""Malformed and long pages: linear time, and where tags and elements end."""

import time

import pytest

from packetrisk.llm.html import extract_main_text, text_blocks

HOSTILE = {
    "open quotes": "<a '", "open tags": "<div>x ", "mixed quotes": "<a '\">", "one quote": "<a \">x", "angles": "<", "ends": "</", "marks": "<!", "open scripts": "<script>", "styles": "<style ",
    "names": "<div class='a b c' ", "menus": "<div class=\"menu", "entities": "&#", "titles": "<p title='>", "other ends": "<div></section>", "items": "<li>x<ul>",
}


@pytest.mark.parametrize("name", HOSTILE)
def test_a_megabyte_of_anything(name):
    """A page of a megabyte takes seconds at most (a fraction of one on an idle machine); a quadratic reader would take hours."""
    page = HOSTILE[name] * (1_000_000 // len(HOSTILE[name]))
    began = time.process_time()
    text_blocks(page)
    assert time.process_time() - began < 6


def blocks(page):
    return [b[0] for b in text_blocks(page)]


@pytest.mark.parametrize(
    ("page", "want"),
    [("<p title='a > b'>x</p>", ["x"]), ("<p title='a>x</p><p>y</p>", ["x", "y"]), ("a < b <p>c", ["a < b", "c"]), ("a <b c", ["a <b c"]), ("<p>x<!-- <p> -->y</p>", ["xy"]), ("<p>x<!-- y", ["x"]), ("x<script>if (a < b) '</p>'</script>y", ["xy"]),
     ("x<script>y", ["x"]), ("<P CLASS=a>x</P >y", ["x", "y"]), ("x</>y</ z>w<!doctype html>v<?xml?>u", ["xywvu"]), ("<div/>x</section>y<p/>z", ["x", "y", "z"]), ("x<math>a</math> <button>go</button>", ["xa go"]), ("", []), ("<", ["<"])],
)
def test_where_tags_end(page, want):
    assert blocks(page) == want


def test_closing_an_outer_element_closes_the_inner_ones():
    page = "<article><div><div class='ad'>advert</article><p>" + "outside words " * 20 + "</p>"
    found = text_blocks(page)
    assert found[0][3:5] == (True, True) and found[1][3:5] == (False, False)


def test_repeated_and_null_pages(spark):
    rows = [(1, "u", "<article><p>one two three four five six</p></article>"), (1, "u", "<article><p>one two three four five six</p></article>"), (None, None, None), (2, "v", "")]
    got = sorted(((r.page_id, r.url, r.text, r.n_chars) for r in extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()), key=str)
    assert got == sorted([(1, "u", "one two three four five six", 27)] * 2 + [(None, None, "", 0), (2, "v", "", 0)], key=str)
