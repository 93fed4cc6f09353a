"""Block rows of the page stage: few, narrow, and the same facts."""

import pytest

from docatlas.operators import pages as P

HEAD = "<h1>X function (x.h)</h1>"


def facts(spark, html, *names):
    page = spark.createDataFrame([(1, "u", html)], "page_id long, url string, html string")
    row, = P.page_facts(page, *names).collect()
    return row[1] if len(names) == 1 else row[1:]


def test_frames_grow_with_the_page(spark):
    """A frame with a bound of 2^31 rows is computed anew for each row: the square of the blocks of a page."""
    page = spark.createDataFrame([(1, "<p>x</p>")], "page_id long, html string")
    plan = P.page_facts(page, "parameters")._jdf.queryExecution().analyzed().toString()
    assert "specifiedwindowframe(RowFrame" in plan and "-2147483648" not in plan


def test_end_tags_without_text_are_not_rows(spark):
    html = HEAD + "<div><p>a</p></div><h2>Parameters</h2><p>b</p>c</p><section></section>"
    page = spark.createDataFrame([(1, html)], "page_id long, html string")
    tags = [r.tag for r in P.context_blocks(page, {"param_rows"}).orderBy("pos").collect()]
    assert tags == ["h1", "div", "p", "h2", "p", "/p", "section"]


def test_page_columns_stand_on_the_first_row(spark):
    page = spark.createDataFrame([(1, "u", "</p><p>a</p><p>b</p>")], "page_id long, url string, html string")
    rows = P.context_blocks(page, {"url"}).orderBy("pos").collect()
    assert rows[0].of_page.url == "u" and all(r.of_page is None for r in rows[1:])


@pytest.mark.parametrize("tail, want", [
    ("<p>Some first remark.</p></div><div><p>Another section.</p></div>", "Some first remark."),
    ("<p>Some first remark.</p><div><p>Nested text.</p></div></div>", "Some first remark.\n\nNested text."),
    ("<div>Some first remark.<p>and more</p></div></section>", "Some first remark.and more")])
def test_end_tags_part_the_texts_of_a_section(spark, tail, want):
    assert facts(spark, HEAD + "<div><h2>Remarks</h2>" + tail, "remarks") == want


@pytest.mark.parametrize("before, want", [
    ("<div class='lang-vb'><p>x</p></div>", "cpp"), ("<div class='lang-vb'><p>x</p>", "vb"),
    ("<div class='lang-vb'><div class='lang-go'></div>", "vb"), ("<div class='lang-vb'></div><div>", "cpp"),
    ("</div></div><div class='lang-vb'></div>", "c")])
def test_closed_containers_give_no_language(spark, before, want):
    html = HEAD + "<h2>Syntax</h2>" + before + "<pre>f(HANDLE h)</pre>"
    assert facts(spark, html, "signature_language") == want


def test_focus_ends_with_its_container(spark):
    html = HEAD + "<div class='has-inner-focus'><p>f(</p><p>x)</p></div><div><p>g()</p></div>"
    assert facts(spark, html, "signature") == "f(x)"
