import hashlib

import pytest
from pyspark.sql import functions as F

from millrace.functions import text, url

CASES = {
    "https://techcrunch.com/2026/04/29/openai-news/?utm_source=facebook": "https://techcrunch.com/2026/04/29/openai-news",
    "https://TechCrunch.COM/2026/04/MyArticle": "https://techcrunch.com/2026/04/MyArticle",
    "not a url": "not a url",
    "": "",
    "  https://A.example:443/x//?b=1&a=2&UTM_Medium=x&a=1#top ": "https://a.example/x?a=2&a=1&b=1",
    "http://a.example": "http://a.example/",
    "http://a.example:80/?": "http://a.example/",
    "http://a.example:8080/p/?ref=x": "http://a.example:8080/p",
    "https://a.example/q?flag": "https://a.example/q?flag=",
    "https://a.exa\tmple/new\ns/1": "https://a.example/news/1",
    "https://user:pw@a.example/%7Ex/../y?q=a b": "https://a.example/y?q=a+b",
    "https://a.example/?hsCtaTracking=1": "https://a.example/?hsCtaTracking=1",
    "https://a.example/end\n": "https://a.example/end",
    "https://a.example/a/./b/%41": "https://a.example/a/b/%41",
    "/relative/path?x=1": "/relative/path?x=1",
    "https://münchen.example/ä?ö=ü": "https://xn--mnchen-3ya.example/%C3%A4?%C3%B6=%C3%BC",
    "mailto:a@b.example": "mailto:a@b.example",
}


def test_canonical_url_and_idempotence(spark):
    df = spark.createDataFrame([(k,) for k in CASES] + [(None,)], "u string")
    got = {r.u: r.c for r in df.select("u", url.canonical_url(F.col("u")).alias("c")).collect()}
    assert got.pop(None) is None
    assert got == CASES
    again = spark.createDataFrame([(v,) for v in CASES.values()], "u string")
    assert all(r.u == r.c for r in again.select("u", url.canonical_url(F.col("u")).alias("c")).collect())


@pytest.mark.parametrize("u", list(CASES))
def test_python_form_agrees(u):
    assert url.canonicalize(u.translate({9: None, 10: None, 13: None})) == CASES[u]


def test_hosts_segments_and_resolution(spark):
    df = spark.createDataFrame([("HTTPS://News.Example:443/A/release-notes/1", "/img/x.png"), ("no", "javascript:1"), (None, None)], "u string, r string")
    got = df.select(url.domain(F.col("u")), url.path_segments(F.col("u")), url.resolve_url(F.col("r"), F.col("u"))).collect()
    assert [tuple(r)[:2] for r in got] == [("news.example", ["a", "release-notes", "1"]), ("", ["no"]), ("", [])]
    assert [r[2].lower() if r[2] else None for r in got] == ["https://news.example:443/img/x.png", None, None]


def test_headline(spark):
    titles = ["OpenAI's GPT-5 is launched in the US!", "Été à la plage", None, "", "…—!", "The of and", "ＦＵＬＬ width ﬁ"]
    df = spark.createDataFrame([(t,) for t in titles], "t string")
    got = [r[0] for r in df.select(text.normalized_headline(F.col("t"))).collect()]
    assert got == ["openai s gpt 5 launched us", "ete la plage", "", "", "", "", "full width fi"]
    assert hashlib.sha1(got[0].encode()).hexdigest() == df.select(text.headline_hash(F.lit(got[0]))).first()[0]


def test_trigrams_and_jaccard(spark):
    df = spark.createDataFrame([("abcd", "abce"), ("", ""), ("", "a"), ("aaaaaa", "aaaaaa")], "a string, b string")
    a, b = text.trigrams(F.col("a")), text.trigrams(F.col("b"))
    got = df.select(a.alias("g"), text.jaccard(a, b).alias("j"), text.jaccard(b, a).alias("k")).collect()
    assert got[0].g == [" ab", "abc", "bcd", "cd "]
    assert [round(r.j, 4) for r in got] == [round(2 / 6, 4), 1.0, 0.0, 1.0]
    assert all(r.j == r.k for r in got)
    assert got[1].g == []


def test_source_key(spark):
    df = spark.createDataFrame([(" Orbit  Ledger ",), ("ORBIT LEDGER",), (None,)], "s string")
    assert [r[0] for r in df.select(text.source_key(F.col("s"))).collect()] == ["orbit ledger", "orbit ledger", None]
