import random
from datetime import datetime

import pandas as pd
import pytest
from pyspark.sql import functions as F

from millrace import lexicon
from millrace.operators import dedup, filters, scoring, selection, state, statistics
from tests.conftest import rows

def now():
    return F.to_timestamp(F.lit("2026-04-30 06:30:00+00:00"))


def values(spark, xs, kind="double"):
    return spark.createDataFrame([(x,) for x in xs], f"x {kind}")


@pytest.mark.parametrize("xs,p,want", [([10, 20, 30, 40, 50], 0.4, 26.0), ([10, float("nan"), 20, float("inf"), 30], 0.5, 20.0), ([], 0.5, 0.0), ([7], 0.9, 7.0), ([1, 2], 5, 2.0)])
def test_percentile(spark, xs, p, want):
    assert values(spark, [float(x) for x in xs]).agg(statistics.exact_percentile(F.col("x"), p)).first()[0] == want


@pytest.mark.parametrize("xs,want", [(list(range(9)), 195), (list(range(200, 249, 2)), 212), (list(range(50, 80)), 170), (list(range(300, 330)), 260), (list(range(240, 250)), 242)])
def test_threshold(spark, xs, want):
    random.Random(1).shuffle(xs)
    assert values(spark, xs, "int").agg(statistics.adaptive_threshold(F.col("x"))).first()[0] == want


def test_freshness(spark):
    df = spark.createDataFrame([("2026-04-29 00:30:00",), ("2026-04-29 00:29:59",), ("2026-05-02 00:00:00",), (None,)], "t string").select(F.to_timestamp("t").alias("t"))
    assert [r[0] for r in df.select(filters.is_fresh(F.col("t"), now())).collect()] == [True, False, True, False]


@pytest.mark.parametrize("title,want", [("SoccerRef-Agents: Multi-Agent Soccer Refereeing", False), ("Large language model alignment", True), ("Language model architectures", False), (None, False)])
def test_separate_hits(spark, title, want):
    df = spark.createDataFrame([(title,)], "t string")
    assert df.select(filters.separate_hits(F.col("t"), lexicon.PAPER_WORDS) >= 2).first()[0] is want


def test_word_lists(spark):
    df = spark.createDataFrame([("Inflation falls", "https://x.example/tv/1"), ("Robots", "https://x.example/tvs/1"), (None, None)], "t string, u string")
    got = df.select(filters.contains_any(F.col("t"), lexicon.TITLE_BLACKLIST), filters.contains_any(F.col("u"), lexicon.PATH_BLACKLIST)).collect()
    assert [tuple(r) for r in got] == [(True, True), (False, False), (False, False)]


def test_scores(spark):
    df = spark.createDataFrame(
        [("X launches and releases an agent model", "s" * 500, "OpenAI Blog", 1, "https://news.openai.com/a", None, "2026-04-30 06:30:00"), ("20 years of reviews", None, "Hacker News", 3, "https://vercel.com/changelog/x", None, "2026-04-28 06:30:00"), (None, None, None, None, None, None, None)],
        "title string, snippet string, source string, priority int, link string, canonical_url string, at string",
    ).withColumn("pub_ts", F.to_timestamp("at"))
    got = [r.parts.asDict() | {"total": r.total} for r in scoring.scored(df, now()).collect()]
    first, second, empty = got
    assert (first["source"], first["recency"], first["lab"], first["depth"], first["trust"], first["verbs"], first["boost"]) == (100, 100, 30, 10, 25, 40, 20)
    assert (second["recency"], second["path"], second["aggregator"], second["fluff"], second["penalty"], second["trust"]) == (0, 30, 25, 30, 15, 15)
    assert empty["total"] == 0
    assert first["total"] == 100 + 100 + 20 + 40 + 30 + 10 + 25


def test_first_row_decides(spark):
    df = spark.createDataFrame([("blogs.nvidia.com",), ("notopenai.com",), ("a.openai.com",), ("",)], "h string")
    assert [r[0] for r in df.select(scoring.suffix_match(F.col("h"), lexicon.DOMAIN_TRUST)).collect()] == [18, 0, 25, 0]


def test_clusters_keep_one_winner():
    rows_ = pd.DataFrame({"title": ["Acme ships robot arm to hospitals", "Acme ships robot arm to hospital", "Other news entirely", "", None], "priority": [3, 1, 2, 1, 1], "score": [1, 1, 1, 1, 1], "length": [5, 5, 5, 5, 5], "at": [0, 0, 0, 0, 0]})
    assert sorted(dedup.greedy_clusters(rows_, 0.8)) == [1, 2]


def test_cluster_batch(spark):
    df = spark.createDataFrame([(1, "Acme ships robot arm", 2, 5, "a", datetime(2026, 1, 1)), (2, "Acme ships robot arms", 1, 5, "a", datetime(2026, 1, 2)), (3, None, 1, 5, None, None)], "id long, title string, priority int, score int, snippet string, pub_ts timestamp")
    assert [r.id for r in dedup.cluster_batch(df, "id", [F.desc("pub_ts"), F.col("id")]).collect()] == [2]
    assert dedup.cluster_batch(df.where("false"), "id", [F.col("id")]).count() == 0


def test_fuzzy_known(spark):
    known = spark.createDataFrame([("openai launches new model", "A", 1), ("openai launches new models", "B", 2), ("", "C", 0)], "norm string, raw string, pos int")
    df = spark.createDataFrame([(1, "openai launches new models"), (2, "nothing like it"), (3, "")], "id int, norm string")
    assert rows(dedup.fuzzy_known(df, "norm", known, 0.88), "id", "similar_to") == [(1, "A"), (2, None), (3, None)]


def test_anti_joins(spark):
    df = spark.createDataFrame([(1, "a", "x"), (2, None, "y"), (3, "c", "z")], "id int, k string, l string")
    seen = spark.createDataFrame([("a", "q"), (None, "z")], "k string, m string")
    assert rows(dedup.not_seen(df, seen, "k"), "id") == [(2,), (3,)]
    assert rows(dedup.not_seen_by_any(df, seen, ["k", "l"], ["k", "m"]), "id") == [(2,)]


def test_round_robin_matches_a_plain_loop(spark):
    data = [(i, "abcde"[i * 7 % 4], i % 5) for i in range(40)]
    df = spark.createDataFrame(data, "id int, c string, s int")
    got = {r.id: r.pos for r in selection.round_robin(df, "c", [F.desc("s"), F.col("id")], ["c", "a", "b"]).collect()}
    groups = {c: sorted([d for d in data if d[1] == c], key=lambda d: (-d[2], d[0])) for c in "cabd"}
    want = [g[i] for i in range(40) for c in "cabd" if len(g := groups[c]) > i]
    assert [got[d[0]] for d in want] == list(range(1, 41))


def test_caps_slots_and_zips(spark):
    df = spark.createDataFrame([(i, "s" if i < 4 else "t", 10 - i) for i in range(6)], "id int, src string, score int")
    queued = spark.createDataFrame([("s", 1)], "src string, n int")
    assert rows(selection.running_cap(df, "src", [F.desc("score")], 2, queued), "id") == [(0,), (4,), (5,)]
    slots = spark.range(1).select(F.explode(selection.next_slots(now(), 18)).alias("slot"))
    hours = [r[0] for r in slots.select(F.date_format("slot", "dd HH")).collect()]
    assert hours[0] == "30 07" and hours[10] == "30 17" and hours[11] == "01 00" and hours[-1] == "01 06" and len(hours) == 18
    taken = slots.orderBy("slot").limit(1)
    assigned = selection.assign_slots(df, slots, taken, [F.desc("score"), F.col("id")])
    assert rows(assigned.where("rank <= 2"), "id") == [(0,), (1,)]
    spare = df.where("id >= 4")
    second = selection.refill_failed(assigned.where("rank <= 4"), spare, F.col("id") % 2 == 0, [F.col("id")])
    assert rows(second, "id") == [(4,), (5,)]


def test_buckets(spark):
    df = spark.createDataFrame([(1, "trend", 250), (2, "core", 200)], "id int, category string, score int")
    room = spark.createDataFrame([("trend", 0), ("core", 3)], "category string, remaining int")
    best = selection.best_in_open_bucket(df, room, "category", [F.desc("score")]).collect()
    assert (best[0].id, best[0].fallback) == (2, False)
    full = selection.best_in_open_bucket(df, room.withColumn("remaining", F.lit(0)), "category", [F.desc("score")]).collect()
    assert (full[0].id, full[0].fallback) == (1, True)


def test_state_tables(spark):
    log = spark.createDataFrame([("a", 1, 100, False), ("a", 2, 5, False), ("b", 1, 50, False), ("b", 2, 50, True), ("c", 1, None, False)], "k string, v int, expires_ts int, gone boolean")
    assert rows(state.live(log, ["k"], ["v"], F.lit(10), deleted="gone"), "k") == [("c",)]
    assert rows(state.latest(log, ["k"], ["v"]), "k", "v") == [("a", 2), ("b", 2), ("c", 1)]


def test_streaks_and_throttle(spark):
    ev = spark.createDataFrame([("a", 1, True), ("a", 2, False), ("a", 3, True), ("a", 4, True), ("b", 1, True), ("c", 1, False)], "k string, t int, f boolean")
    assert rows(statistics.last_streak(ev, "k", ["t"], F.col("f"))) == [("a", 2), ("b", 1), ("c", 0)]
    assert rows(statistics.longest_streak(ev, "k", ["t"], F.col("f"))) == [("a", 2), ("b", 1), ("c", 0)]
    at = spark.createDataFrame([("x", f"2026-01-01 {h:02}:00:00") for h in (0, 3, 6, 7, 12, 13)] + [("y", "2026-01-01 01:00:00")], "k string, s string").select("k", F.to_timestamp("s").alias("at"))
    passed = state.throttled(at, "k", "at", 6 * 3600)
    assert rows(passed.select("k", F.hour("at").alias("h"))) == [("x", 0), ("x", 12), ("x", 6), ("y", 1)]


def test_funnel_and_health(spark):
    df = spark.createDataFrame([(1,), (2,), (3,), (None,)], "x int")
    got = dict(rows(statistics.reason_funnel(df, [("one", F.col("x") == 1), ("small", F.col("x") < 3), ("big", F.col("x") > 9)])))
    assert got == {"one": 1, "small": 1, "big": 0, "kept": 2}
    reg = spark.createDataFrame([("a",), ("b",)], "name string")
    src = spark.createDataFrame([("a",), ("a",), ("z",)], "source string")
    assert rows(statistics.source_health(reg, src)) == [("a", 2, True), ("b", 0, False)]


def test_throttle_carries_state_from_batch_to_batch(spark):
    ev = spark.range(400).select(F.when(F.col("id") % 2 == 0, "x").alias("k"), F.timestamp_seconds(F.col("id") * 60).alias("at")).union(spark.createDataFrame([("x", None)], "k string, at timestamp"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        passed = state.throttled(ev.union(ev), "k", "at", 3600)
        got = rows(passed.select("k", (F.unix_seconds("at") / 60).cast("int").alias("m")))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == sorted([("x", m) for m in range(0, 400, 60)] + [(None, m) for m in range(1, 400, 60)], key=repr)
    plan = passed._jdf.queryExecution().toString()
    assert "collect_set" not in plan and "MapInArrow" in plan  # no kind is gathered in one row
