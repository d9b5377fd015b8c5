import json

import pytest
from pyspark.sql import functions as F

from millrace.functions import html, summary, times
from millrace.sources import documents, feeds
from millrace.sinks import delivery
from millrace import enrich
from tests.conftest import rows

RSS = """<?xml version="1.0"?><rss version="2.0" xmlns:media="http://search.yahoo.com/mrss/" xmlns:dc="http://purl.org/dc/elements/1.1/"><channel><title>F</title>
<item><title>A &amp;amp; B &#8212; C</title><link> https://a.example/1?utm_source=x </link><pubDate>Fri, 01 Aug 2025 04:25:03 EDT</pubDate><description>&lt;p&gt;Hello  &lt;b&gt;world&lt;/b&gt;&lt;/p&gt;</description><media:content url="https://a.example/i.jpg"/></item>
<item><title></title><link>https://a.example/2</link></item>
<item><title>No date</title><link>https://a.example/3</link><description>&lt;img class="x" src="https://a.example/p.png"&gt; text</description></item>
</channel></rss>"""
ATOM = """<feed xmlns="http://www.w3.org/2005/Atom"><title>G</title><entry><title type="html">Entry</title><link rel="self" href="https://b.example/self"/><link rel="alternate" href="https://b.example/e1"/>
<updated>2025-08-01T10:00:00Z</updated><summary>Sum</summary></entry></feed>"""


def test_feeds(spark):
    df = spark.createDataFrame([("r", "core", 1, "UTC", "dmy", RSS), ("a", "ai", 2, None, None, ATOM), ("bad", "ai", 2, None, None, "<rss><oops"), ("none", "ai", 2, None, None, None)], "name string, category string, priority int, feed_tz string, date_order string, xml string")
    got = {(r.source, r.position): r for r in feeds.parse_feeds(df).collect()}
    assert set(got) == {("r", 0), ("r", 2), ("a", 0)}
    first = got["r", 0]
    assert first.title == "A & B — C" and first.link == "https://a.example/1?utm_source=x" and first.canonical_url == "https://a.example/1"
    assert first.snippet == "Hello world" and first.image_url == "https://a.example/i.jpg" and str(first.pub_ts) == "2025-08-01 08:25:03"
    assert got["r", 2].image_url == "https://a.example/p.png" and got["r", 2].pub_ts.year == 1970
    assert got["a", 0].link == "https://b.example/e1" and got["a", 0].title == "Entry" and got["a", 0].snippet == "Sum"
    assert [r.source for r in feeds.newest_articles(feeds.parse_feeds(df), 2).collect()] == ["a", "r"]
    assert feeds.parse_feeds(df, 1).where("source = 'r'").count() == 1


def test_feed_source_is_empty_on_error(spark):
    spark.dataSource.register(feeds.FeedDataSource)
    got = spark.read.format("feed").options(names="x\ny", urls="http://127.0.0.1:9/feed\nfile:///does/not/exist", timeout="1").load()
    assert got.columns == ["name", "xml"] and got.count() == 0


def test_history_payloads_and_lists(spark, tmp_path):
    p = tmp_path / "h.json"
    p.write_text(json.dumps({"entries": [{"url": "u", "title": "t", "postedAt": "2026-01-01"}]}, indent=1))
    assert rows(documents.read_history(spark, str(p))) == [("u", None, "t", "2026-01-01")]
    assert documents.read_history(spark, str(tmp_path / "no.json")).count() == 0
    good = json.dumps({"article": {"link": "l", "title": "t"}, "summary": {"title": "s"}, "generatedAt": "g"})
    df = spark.createDataFrame([("q1", good), ("q2", "{"), ("q3", None), ("q4", "{}")], "slot string, value string")
    assert rows(documents.parse_payloads(df), "slot", "article.link") == [("q1", "l")]
    lists = spark.createDataFrame([('[{"norm":"a","raw":"A"},{"raw":"B"},5]',), ("broken",)], "value string")
    assert rows(documents.parse_capped_list(lists, "value", "struct<norm:string,raw:string>", ["norm"])) in ([("a", "A")], [])


@pytest.mark.parametrize("raw,want", [("a &amp; b", "a & b"), ("&#x27;x&#39;", "'x'"), ("&#38;lt;", "<"), ("&unknown; &amp", "&unknown; &amp"), ("&#1114112;", ""), ("plain", "plain")])
def test_entities(spark, raw, want):
    assert html.decode_text(raw) == want
    assert spark.createDataFrame([(raw,)], "t string").select(html.decoded(F.col("t"))).first()[0] == want


def test_meta_and_escape(spark):
    page = """<HTML><head><meta content='https://x.example/b.png' name="twitter:image"><META property="og:image" content="/a.png?x=1&amp;y=2"></HEAD><meta property="og:title" content="late">"""
    df = spark.createDataFrame([(page, 'a<b>&"c"')], "h string, t string")
    r = df.select(html.page_image(F.col("h")), html.meta_content(html.head_of(F.col("h")), "og:title"), html.escaped(F.col("t")), html.escaped(F.col("t"), True)).first()
    assert tuple(r) == ("/a.png?x=1&y=2", None, 'a&lt;b&gt;&amp;"c"', "a&lt;b&gt;&amp;&quot;c&quot;")


@pytest.mark.parametrize("budget", [10, 50, 99, 250, 1000, 3000])
def test_budget(spark, budget):
    df = spark.createDataFrame([("&" * 500,), ("x🐝" * 40,), ("short",)], "t string")
    for (t,) in df.select(html.cut_to_budget(F.col("t"), budget)).collect():
        assert len(t.encode("utf-16-le")) // 2 <= budget
        assert not t.replace("&amp;", "").count("&")
    assert df.select(html.trim_markup(F.lit("abc &amp; <b>x</b>"), 8)).first()[0] == "abc ..."


def test_summaries(spark):
    new = json.dumps({"title": " T ", "bullets": ["- one", "• two", 3, "", "four", "five"], "whyItMatters": "w", "hashtags": ["#AI", "ai", "Open AI", "bad-tag", "x" * 31]})
    old = "```json\n" + json.dumps({"title": "T", "body": "First. Second! Third? Fourth.", "takeaway": "k"}) + "\n```"
    bad = [json.dumps({"title": "T"}), "nonsense", None, json.dumps({"title": "", "bullets": ["a"], "whyItMatters": "w"}), json.dumps({"title": "T", "bullets": [], "whyItMatters": "w"})]
    df = spark.createDataFrame([(x,) for x in [new, old, *bad]], "raw string")
    got = [r.s for r in df.select(summary.parsed_summary(F.col("raw")).alias("s")).collect()]
    assert got[0].title == "T" and got[0].bullets == ["one", "two", "four"] and got[0].tags == ["AI", "OpenAI"]
    assert got[1].bullets == ["First.", "Second!", "Third?"] and got[1].why == "k" and got[1].tags == []
    assert got[2:] == [None] * 5
    tags = spark.createDataFrame([(["AI-Lab", "GPT.5", "GPT5"],), ([],)], "t array<string>")
    assert [r[0] for r in tags.select(summary.clean_tags(F.col("t"))).collect()] == [["GPT5"], []]
    assert [r[0] for r in tags.select(summary.tags_with_brand(summary.clean_tags(F.col("t")), "Brand")).collect()] == [["GPT5", "Brand"], []]


def test_times(spark):
    t = F.to_timestamp(F.lit("2026-04-30 06:30:00"))
    r = spark.range(1).select(times.slot_key(t), times.day_key(t), F.hour(times.hour_after(t)), F.hour(times.next_even_hour(t)), times.is_posting_hour(t), times.shifted_hour(F.lit(20), 7)).first()
    assert tuple(r) == ("queue:2026-04-30T06", "2026-04-30", 7, 8, True, 3)


def test_delivery(spark):
    waits = []
    replies = iter([(429, 3, "slow"), (500, None, "x"), (200, None, "ok")])
    assert delivery.send_with_retry(lambda r: next(replies), {}, sleep=waits.append) == (200, 3, "ok")
    assert waits[0] == 4 and 4 <= waits[1] <= 5
    assert delivery.send_with_retry(lambda r: (400, None, "no"), {}, sleep=waits.append)[:2] == (400, 1)

    def send(row):
        return (200, None, "ok") if row["id"] % 2 else (404, None, "gone")

    df = spark.createDataFrame([(i,) for i in range(4)], "id long")
    assert rows(delivery.deliver(df, "id", send), "id", "status") == [(0, 404), (1, 200), (2, 404), (3, 200)]
    done = delivery.run_writes([("a", lambda: None), ("b", lambda: 1 / 0), ("c", lambda: None)])
    assert [(n, ok) for n, ok, _ in done] == [("a", True), ("b", False), ("c", True)]
    d = spark.createDataFrame([(400, "Wrong file identifier"), (400, "other"), (500, "wrong file identifier")], "s int, d string")
    assert [r[0] for r in d.select(delivery.falls_back_to_text(F.col("s"), F.col("d"))).collect()] == [True, False, False]


def test_provider_chain(spark):
    calls = []

    def broken(text):
        calls.append(1)
        return 503, ""

    failures = {}
    for _ in range(4):
        assert enrich.ask_chain([("b", broken), ("x", enrich.extractive)], "One. Two.", failures, bool)[0] == "x"
    assert len(calls) == 2
    df = spark.createDataFrame([(1, "T", "First one. Second."), (2, None, None)], "id long, title string, snippet string")
    got = {r.id: json.loads(r.answer)["bullets"] for r in enrich.summarize(df, "id", [("x", enrich.extractive)], parallel=2).collect()}
    assert got == {1: ["First one.", "Second."], 2: []}
    assert enrich.provider_keys("p", ["a"]) == ["p"] and enrich.provider_keys("p", ["a", "b"]) == ["p#k0", "p#k1"]
    assert [ok for _, ok, _ in enrich.probe([("x", enrich.extractive), ("y", lambda t: 1 / 0)])] == [True, False]
