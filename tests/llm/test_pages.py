"""Main text of pages: line blocks decide, whole tables, long and broken pages."""

import time

import pytest

from trendmill.llm import html_text

LONG = " ".join(["This is a long paragraph of the article that says something about the matter at hand."] * 3)
CLOSING = "And so it ended, quietly, on a day in the spring, with nobody there to see it."


def lines(*texts):
    return "\n".join(texts)


@pytest.mark.parametrize("page, text", [
    (f"<div>{f'<p>{LONG}</p>' * 5}<div class='ad'>Buy now</div><p>{CLOSING}</p></div>", lines(*[LONG] * 5, CLOSING)),
    (f"<article><p>{LONG}</p><p><a href='x'>See the full appendix</a></p></article>", lines(LONG, "See the full appendix")),
    (f"<article><p>{LONG}</p><ul><li><a href='a'>One</a></li><li><a href='b'>Two</a></li></ul></article>", LONG),
    (f"<div><p>It rained.</p>{f'<p>{LONG}</p>' * 4}<p>The end.</p></div>", lines("It rained.", *[LONG] * 4, "The end.")),
    (f"<article><div class='notice-board'><p>{LONG}</p></div><p class='share-price'>It rose.</p></article>",
     lines(LONG, "It rose.")),
    (f"<div class='x'><ul><li><a href='a'>Home</a></li></ul></div><div><p>{LONG}</p></div><div>Copyright 2020</div>", LONG),
    (f"<article><p>{LONG}</p></article><div class='comment-list'><p>{LONG}</p></div>", LONG),
])
def test_blocks_stay_or_go(page, text):
    assert html_text.main_text(page) == text


def test_windows_find_the_article_without_its_element(spark, data):
    pages = [r.html for r in spark.read.parquet(f"{data}/pages.parquet").select("html").collect()]
    bare = [p and p.replace("<article>", "<div>").replace("</article>", "</div>") for p in pages]
    assert [html_text.main_text(p) for p in bare] == [html_text.main_text(p) for p in pages]


@pytest.mark.parametrize("start, many", [
    ("", ["<b>", "</i>"]), ("", ["<b>", "<div></div>"]), ("", ["<a href=x>"]), ("<b>", ["<div></b>"]),
    ("<i><div>", ["<b>", "</i>"]), ("", ["<p><a href=x>y"])])
def test_broken_pages_take_time_by_their_length(start, many):
    began = time.process_time()
    html_text.main_text(start + "".join(tag * 30_000 for tag in many))
    assert time.process_time() - began < 10


def test_tables_with_nulls_repeats_and_clashing_names(spark):
    page = f"<article><p>{LONG}</p></article>"
    rows = [(1, page, "old", 5), (1, page, "old", 5), (2, None, None, None), (3, "", "x", 1), (None, page * 300, "y", 2)]
    pages = spark.createDataFrame(rows, "page_id int, html string, text string, n_chars int")
    out = html_text.extract_main_text(pages, ["page_id", "text", "n_chars"])
    assert out.columns == ["page_id", "text", "n_chars"]
    found = sorted(((r.page_id or 0), r.text, r.n_chars) for r in out.collect())
    whole = "\n".join([LONG] * 300)
    assert found == sorted([(1, LONG, len(LONG)), (1, LONG, len(LONG)), (2, "", 0), (3, "", 0), (0, whole, len(whole))])
    assert html_text.extract_main_text(pages.limit(0), ["page_id"]).count() == 0
