from datetime import datetime

from pyspark.sql import functions as F

from millrace.operators import selection
from millrace.plans import pipeline
from tests.conftest import rows


def test_run_and_refill(spark):
    at = datetime(2026, 4, 30, 5)
    names = ["article_id long", "title string", "link string", "canonical_url string", "source string", "category string", "priority int", "snippet string", "pub_ts timestamp"]
    data = [(i, f"Lab {w} releases {w} agent {w}", f"https://x.example/{i}?utm_source=a", None, f"s{i % 2}", "core" if i % 3 else "ai", 1 + i % 3, "s", at) for i, w in enumerate(["red", "green", "blue", "amber", "violet", "white"])]
    data += [(10, "Old", "https://x.example/o", None, "s", "core", 1, "", datetime(2026, 4, 1)), (11, None, "https://x.example/n", None, "s", "core", 1, "", at), (12, "NFL draft", "https://x.example/m", None, "s", "core", 1, "", at), (13, "Agents", "https://x.example/p", None, "arXiv cs.AI", "ai", 1, "", at)]
    view = spark.createDataFrame(data, ", ".join(names))
    s = pipeline.Settings(now=F.to_timestamp(F.lit("2026-04-30 06:30:00")))
    assert dict(rows(pipeline.funnel(view, s))) == {"incomplete": 1, "old": 1, "path": 0, "title": 1, "paper": 1, "kept": 6}
    posted = spark.createDataFrame([("https://X.example/0/", None), (None, "lab GREEN releases green agent green!")], "url string, title string")
    queued = spark.createDataFrame([("https://x.example/2?utm_source=a", None)], "link string, canonical_url string")
    failures = spark.createDataFrame([("https://x.example/3", 3), ("https://x.example/4", 2)], "page string, n int")
    recent = spark.createDataFrame([("lab white releases white agent white", "W", 1)], "norm string, raw string, pos int")
    found = pipeline.candidates(view, posted, queued, failures, recent, s)
    assert rows(found, "article_id") == [(4,)]
    free = pipeline.candidates(view, posted.where("false"), queued.where("false"), failures.where("false"), recent.where("false"), s)
    usage = spark.createDataFrame([("core", 8)], "category string, n long")
    assert pipeline.choice(free, usage, s).first().category == "ai"
    slots = spark.range(1).select(F.explode(selection.next_slots(s.now, 18)).alias("slot"))
    filled = pipeline.refill(free, slots, slots.limit(0), spark.createDataFrame([], "source string, n int"))
    assert filled.count() == 4  # two a source


def test_one_report_an_event_and_none_like_the_queue(spark):
    names = "article_id long, title string, link string, canonical_url string, source string, category string, priority int, snippet string, score int, pub_ts timestamp"
    titles = [("Acme ships robot arm to hospitals", 3), ("Acme ships robot arm to hospital", 1), ("Acme ships its robot arm to hospitals", 2), ("Bolt Labs opens compiler toolkit source code", 1), ("Crane releases weather model for farms", 1)]
    data = [(i, t, f"https://x.example/{i}", None, "s", "core", p, "s", 999 if p == 3 else 0, datetime(2026, 4, 30, 5)) for i, (t, p) in enumerate(titles)]
    # more rows than the cap of a batch, newer than the others and unlike each other: none may take another's place
    data += [(100 + i, " ".join(f"{chr(97 + (i * k + k) % 26)}{i * k * 7919 % 9973:05}" for k in range(1, 6)), f"https://x.example/n{i}", None, "s", "core", 3, "", 0, datetime(2026, 4, 30, 6)) for i in range(1, 231)]
    view = spark.createDataFrame(data, names)
    s = pipeline.Settings(now=F.to_timestamp(F.lit("2026-04-30 06:30:00")), candidates=1000)
    none = spark.createDataFrame([], "url string, title string"), spark.createDataFrame([], "page string, n int"), spark.createDataFrame([], "norm string, raw string, pos int")
    queue = lambda *t: spark.createDataFrame([("https://q.example/", None, x) for x in t], "link string, canonical_url string, title string")
    find = lambda q: {r.article_id for r in pipeline.candidates(view, none[0], q, none[1], none[2], s).select("article_id").collect()}
    others = {100 + i for i in range(1, 231)}
    assert find(queue(None)) == {1, 3, 4} | others
    # similar by 0.75 to 0.88; far down a queue of over 200
    assert find(queue(*[f"a queued title {i}" for i in range(250)], "Bolt Labs opens compiler toolkit source", "zz Crane unveils")) == {1, 4} | others
    # the winner of an event is known, so the event is
    posted = spark.createDataFrame([("https://x.example/1", None)], "url string, title string")
    assert {r.article_id for r in pipeline.candidates(view, posted, queue("x"), none[1], none[2], s).collect()} == {3, 4} | others
