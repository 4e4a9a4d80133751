from __future__ import annotations

import random
import re

import numpy as np
import pytest

from skylattice.llm import urlfilter


def parts(url):
    if not url or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.split(r"[/?#]", rest, maxsplit=1)[0]
    path = re.split(r"[?#]", rest[len(host) :], maxsplit=1)[0]
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), path


def brute(urls, rules):
    for key, url in urls:
        host, path = parts(url)
        best = None
        for h, p, action in rules:
            if None not in (h, p) and action in urlfilter.ACTIONS and host and (host == h or host.endswith("." + h)) and path.startswith(p):
                rank = (len(h) + len(p), len(h), action == "block")
                if best is None or rank > best[0]:
                    best = (rank, h + p, action)
        yield (key, host, path, best and best[1], best[2] if best else "allow")


def corpus(seed):
    pick = random.Random(seed)
    host = lambda: ".".join(pick.choice(["a", "bb", "c-c", "net", "Example"]) for _ in range(pick.randrange(1, 5)))
    path = lambda: "".join("/" + pick.choice(["en", "de", "x", ""]) for _ in range(pick.randrange(0, 4)))
    urls = [(k, f"http://{host()}{path()}{pick.choice(['', '?q=/en/', '#t', '?http://a/'])}") for k in range(300)]
    urls += [(500, None), (501, ""), (502, "no scheme/x"), (503, "://"), (504, "x://NET"), (505, "http://a\nb/en/"), (3, urls[3][1])]
    rules = [(host().lower(), path(), pick.choice(["block", "allow"])) for _ in range(40)]
    rules += [("net", "/", "block"), ("net", "/", "allow"), (None, "/", "block"), ("a", None, "block"), ("bb", "/", "other"), rules[0]]
    return urls, rules


@pytest.mark.parametrize(("seed", "size"), [(1, 64 << 20), (2, 64 << 20), (1, 300)])
def test_equals_brute_force(spark, monkeypatch, seed, size):
    monkeypatch.setattr(urlfilter, "MAX_LEVEL_BYTES", size)
    urls, rules = corpus(seed)
    u = spark.createDataFrame([(*x, "n", 1) for x in urls], "page_id long, url string, html string, n int")
    r = spark.createDataFrame(rules, "host string, path string, action string")
    got = urlfilter.judged(u, r)
    assert got.columns == ["page_id", "url", "html", "n", "host", "path", "rule", "verdict"]
    rows = sorted(((x.page_id, x.host, x.path, x.rule, x.verdict) for x in got.collect()), key=str)
    assert rows == sorted(brute(urls, rules), key=str)
    assert {"block", "allow"} == {x[4] for x in rows}


@pytest.mark.parametrize("bits", [2, 12])
def test_cascade_is_exact_on_its_universe(spark, monkeypatch, bits):
    monkeypatch.setattr(urlfilter, "BITS_PER_KEY", bits)
    values = np.random.default_rng(bits).integers(-(2**62), 2**62, (900, 2))
    frame = lambda rows: spark.createDataFrame(rows.tolist(), "h1 long, h2 long")
    levels = urlfilter.cascade(frame(values[:80]), frame(values[80:]))
    assert len(levels) > 1
    assert np.array_equal(urlfilter.listed(levels, values[:, 0].copy(), values[:, 1].copy()), np.arange(900) < 80)


def test_empty_tables(spark):
    u = spark.createDataFrame([], "page_id long, url string")
    r = spark.createDataFrame([], "host string, path string, action string")
    one = spark.createDataFrame([(1, "http://a/b")], "page_id long, url string")
    rule = spark.createDataFrame([("a", "", "block")], "host string, path string, action string")
    assert urlfilter.judged(u, rule).count() == 0
    assert [(x.rule, x.verdict) for x in urlfilter.judged(one, r).collect()] == [(None, "allow")]
    assert [(x.rule, x.verdict) for x in urlfilter.judged(one, rule).collect()] == [("a", "block")]
    with pytest.raises(ValueError, match="host"):
        urlfilter.judged(one.selectExpr("*", "'x' AS host"), rule)
