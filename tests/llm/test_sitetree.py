from __future__ import annotations

import html
import os
import re

import pytest

from skylattice.llm import sitetree

SCHEMA = "page_id long, url string, html string"


def texts(spark, pages):
    return {r.page_id: r.text for r in sitetree.extracted(spark.createDataFrame(pages, SCHEMA)).collect()}


@pytest.mark.parametrize(
    ("source", "expected"),
    [
        (None, ""),
        ("", ""),
        ("plain  text\n here", "plain text here"),
        ("<p>a<p>b<br>c</p>d", "a\nb c\nd"),
        ("<article><h1>T &amp; x</h1><p>a <b>b</b>c&nbsp; d &#233; &lt;i&gt;</article><p>out", "T & x\na bc d é <i>"),
        ("<nav><p>menu</nav><p>text<footer>foot</footer>", "text"),
        ("<div class='cookie-notice'>c</div><div class=content>main<form>f<p>g</form></div>", "main"),
        ("<main>m<div id=comments><p>no</div><aside>s</aside><p>n</main>", "m\nn"),
        ("<script>var t='</p><p>x';</script><style>p{}</style><!-- <p>c -->t<textarea><p>u</textarea>v", "t\nv"),
        ("<p title='a>b'>x</p><p hidden>h</p><p style='display: none'>n</p>", "x"),
        ("<ul><li>a<li>b</ul><table><tr><td>c<td>d</table>", "a\nb\nc\nd"),
        ("<p>1 < 2 and <3 &am &bogus;</p></div></i><b>z", "1 < 2 and <3 &am &bogus;\nz"),
        ("<article><p>open <b>bold<br><p>next</article>", "open bold\nnext"),
        ("<p>a<![CDATA[<x> &amp;]]>b</p><unknown-tag>q</unknown-tag><p", "a<x> &amp;b\nq"),
        ("<p>one</p><p title=it's>two</p><p>three</p>", "one\ntwo\nthree"),
        ("<p data-x=don't>Second.</p><p>Third.</p><p>It's fourth.</p>", "Second.\nThird.\nIt's fourth."),
        ("<p><a href=/o'brien>O'Brien</a> and <a title=5\"disk>more</a></p><p>x", "O'Brien and more\nx"),
        ("<p title = 'a>b' it's>x</p><p class=\"a'b>c\" x='\">'>y</p><p a==b>z</p>", "x\ny\nz"),
        ("<p class=bad's>kept</p><p class='x ad'>cut</p><p class = ad>cut</p><p id=\"x>promo\">cut</p>", "kept"),
        ("<P CLASS='Ad'>a</P><DIV ROLE=navigation>n</DIV><P>k</P>", "k"),
    ],
)
def test_blocks(source, expected):
    assert "\n".join(t for _, t in sitetree.Page(source or "").blocks) == expected


def test_depth_and_length_do_not_hurt():
    deep = "<div>" * 20_000 + "x" + "</div>" * 20_000
    assert [t for _, t in sitetree.Page(deep).blocks] == ["x"]
    assert len(sitetree.Page("<p>" + "word " * 200_000).blocks[0][1]) == 999_999
    assert sitetree.Page("<" * 5000).blocks[0][1] == "<" * 5000


def page(k, unmarked="Welcome to the site"):
    return f"<body><div class=top>{unmarked}</div><div class=story><p>Story {k} begins.<p>It ends {k}.</div><div class=low>All rights</div></body>"


@pytest.mark.parametrize("limit", [8 << 20, 0])
def test_branches_that_repeat_on_a_host_are_cut(spark, monkeypatch, limit):
    monkeypatch.setattr(sitetree, "BROADCAST_BYTES", limit)
    pages = [(k, "http://A.example/x", page(k)) for k in range(20)] + [(100 + k, f"http://h{k}.example/", page(k)) for k in range(5)]
    got = texts(spark, pages)
    assert got[3] == "Story 3 begins.\nIt ends 3."
    assert got[101] == "Welcome to the site\nStory 1 begins.\nIt ends 1.\nAll rights"
    varied = texts(spark, [(k, "http://a/", page(k, f"Own line {k}")) for k in range(20)])
    assert varied[4].startswith("Own line 4\nStory 4")


def test_copies_on_one_host_stay(spark):
    got = texts(spark, [(k, "http://a/", page(1)) for k in range(30)] + [(50, None, page(2)), (51, "no host", None), (51, "no host", None)])
    assert got[7] == "Welcome to the site\nStory 1 begins.\nIt ends 1.\nAll rights"
    assert got[51] == ""


def test_importance_is_the_entropy_of_forms(spark):
    pages = [(k, "http://a/", f"<div>{'same' if k < 4 else k}</div>") for k in range(8)]
    tree = sitetree.style_tree(sitetree.parsed(spark.createDataFrame(pages, SCHEMA)))
    (row,) = tree.filter("is_text").collect()
    assert (row.host, row.path, row.pages) == ("a", "div", 8)
    assert row.importance == pytest.approx((0.5 * 1 + 4 * 3 / 8) / 3)


def test_empty_and_clashes(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert sitetree.extracted(df).count() == 0
    with pytest.raises(ValueError, match="text"):
        sitetree.extracted(df.selectExpr("*", "'' AS text"))


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="driver tables not present")
def test_query_equals_a_plain_cut_of_the_article(spark):
    from skylattice.llm.queries import op7_html_text

    raw = {r.page_id: r.html for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()}
    rows = op7_html_text(spark, "/root/testdata/sf0.001").collect()
    assert len(rows) == len(raw)
    for row in rows:
        article = re.search(r"<article>(.*)</article>", raw[row.page_id], re.S)[1]
        blocks = [re.sub(r"\s+", " ", html.unescape(re.sub(r"</?b>|<br>", "", b))).strip() for b in re.split(r"</?(?:p|h1)>", article)]
        assert row.text == "\n".join(b for b in blocks if b)
        assert row.n_chars == len(row.text)
