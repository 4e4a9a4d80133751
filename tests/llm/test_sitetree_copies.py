from __future__ import annotations

import pytest

from skylattice.llm import sitetree

SCHEMA = "page_id long, url string, html string"


def texts(spark, pages):
    df = spark.createDataFrame([(k, "http://a/", h) for k, h in enumerate(pages)], SCHEMA)
    return [r.text for r in sitetree.extracted(df).orderBy("page_id").collect()]


def article(k, *, stamp="", quote=""):
    return f"<body><div class=top>Welcome</div>{stamp}<article><p>Story {k}.</p>{quote}</article></body>"


@pytest.mark.parametrize("limit", [8 << 20, 0])
def test_copies_of_a_page_leave_the_others_whole(spark, monkeypatch, limit):
    monkeypatch.setattr(sitetree, "BROADCAST_BYTES", limit)
    own = [article(k, quote=f"<blockquote>Quote {k}</blockquote>") for k in range(30)]
    got = texts(spark, own + [article("gone")] * 170)
    assert got[:30] == [f"Story {k}.\nQuote {k}" for k in range(30)]
    assert set(got[30:]) == {"Story gone."}


@pytest.mark.parametrize("limit", [8 << 20, 0])
def test_a_text_of_its_own_stays_where_others_repeat(spark, monkeypatch, limit):
    monkeypatch.setattr(sitetree, "BROADCAST_BYTES", limit)
    # Distinct pages by their dates, all with one text at the path where a few pages have their own.
    page = lambda k, text: f"<body><div class=date>Date {k}</div><div class=box>{text}</div></body>"
    got = texts(spark, [page(k, f"Own {k}" if k < 5 else "All rights") for k in range(200)])
    assert got == [f"Date {k}\nOwn {k}" if k < 5 else f"Date {k}" for k in range(200)]
