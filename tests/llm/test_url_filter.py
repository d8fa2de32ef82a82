import collections
import math

import pytest
from pyspark.sql import functions as F

from sparkloom.llm import url_filter
from sparkloom.llm.queries import URL_RULES

URLS = ["http://Shop.Example.COM/en/7x?q#f", "https://a.com/en/", "x.com/en/", None, "", "ftp://com/en/z", "http://b.net/de/9", "http://my.example.net/de/88", "http://example.net/de/7", "http://xcom/en/", "http://q.org/es", "http://q.org/es/?x", "://h", "http://h?x/de/", "a://b://c/d#/en/"]


def plain(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = min([k for k, c in enumerate(rest) if c in "/?#"], default=len(rest))
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:end])
    tail = rest[end:]
    return host, tail[: min([k for k, c in enumerate(tail) if c in "?#"], default=len(tail))]


def ruled(host, path):
    fit = [r for r in URL_RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return max(fit, key=lambda r: len(r.text), default=None)


def pages(spark, urls):
    return spark.createDataFrame([(k, u, "x", "y", 1.0) for k, u in enumerate(urls)], "page_id long, url string, host string, s string, n double")


def test_parts_and_rules(spark):
    for r in url_filter.judge(pages(spark, URLS), URL_RULES).collect():
        host, path = plain(URLS[r["page_id"]])
        best = ruled(host, path)
        assert (r["host"], r["path"], r["rule"]) == (host, path, best and best.text)
        assert r["verdict"] in ("allow", "block") and (best is None or r["verdict"] == ("allow" if best.allow else "block"))
    assert url_filter.judge(pages(spark, []), URL_RULES).count() == 0


def brute_model(rows, order, rare):
    pad = lambda s: url_filter.START * order + s
    counts = {a: collections.Counter() for a in (True, False)}
    for s, allow, n in rows:
        for i in range(len(s)):
            for k in range(order + 1):
                counts[allow][pad(s)[i + order - k : i + order + 1], k] += n

    def stats(allow, ctx, k):
        own = [counts[allow][ctx + c, k] for c in url_filter.ALPHABET]
        return sum(own), sum(n > 0 for n in own)

    def prob(allow, ctx, c, k):
        n, t = stats(allow, ctx, k)
        if k == 0:
            return (counts[allow][c, 0] + 0.5) / (n + 0.5 * len(url_filter.ALPHABET))
        low = prob(allow, ctx[1:], c, k - 1)
        return (counts[allow][ctx + c, k] + t * low) / (n + t) if n else low

    total = sum(stats(a, "", 0)[0] for a in (True, False))

    def score(s):
        out = 0.0
        for i, c in enumerate(s):
            for k in range(order, -1, -1):
                ctx = pad(s)[i + order - k : i + order]
                if sum(stats(a, ctx, k)[0] for a in (True, False)) >= total * rare:
                    out += math.log(prob(True, ctx, c, k) / prob(False, ctx, c, k))
                    break
        return out / len(s)

    return score


@pytest.mark.parametrize("order,rare", [(0, 0.0), (2, 0.01), (3, 0.001)])
def test_model_matches_brute_force(spark, order, rare):
    rows = [("good.site/a", True, 2.0), ("good.news/b", True, 1.0), ("bad.casino/x", False, 1.0), ("bad.casino/0", False, 3.0)]
    asked = ["good.casino/", "a", "zzz~", "bad.site/a0"]
    tables = url_filter.train(spark.createDataFrame(rows, "s string, allow boolean, n double"), order, rare)
    got = {r["s"]: r["score"] for r in url_filter.score(spark.createDataFrame([(a,) for a in asked], "s string"), tables).collect()}
    score = brute_model(rows, order, rare)
    for a in asked:
        assert abs(got[a] - score(a)) < 1e-9


def test_kinds_of_hosts_are_told_apart(spark):
    urls = [f"http://www.library{k}.net/de/{k}" for k in range(40)] + [f"http://shop{k}.com/en/{k}" for k in range(40)] + ["http://big-casino-win.example.org/fr/1", "http://www.library9.net/fr/2"]
    got = url_filter.judge(pages(spark, urls), URL_RULES).where(F.col("page_id") >= 80).orderBy("page_id").collect()
    assert [r["verdict"] for r in got] == ["block", "allow"]


def test_tables_are_bounded(spark):
    rows = [(f"host{k}.x{k * 7919 % 997}/{k}", k % 2 == 0, 1.0) for k in range(800)]
    tables = url_filter.train(spark.createDataFrame(rows, "s string, allow boolean, n double"), 3, 0.01)
    assert all(t.count() <= (100 + 1) * len(url_filter.ALPHABET) for t in tables)
