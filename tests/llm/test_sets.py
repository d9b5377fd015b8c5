"""Near duplicates, formatting copies, history: against brute force on small fixtures."""

import random
from fractions import Fraction
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.functions.text import normalize_headline
from millrace.llm import components, formatting_duplicates, history, near_duplicates, setjoin
from millrace.llm.tokensets import parity_sketch, mix, rows_of, trigram_sets
from millrace.session import bucketed

WORDS = "acme robot arm ships hospital cloud vendor chip model launch panel weather school market fund open source vote ends drone battery".split()


def grams(s):
    p = f" {s} "
    return {p[i : i + 3] for i in range(len(s))}


def similarity(a, b):
    x, y = grams(a), grams(b)
    return Fraction(len(x & y), len(x | y))


def headlines(n, seed):
    r = random.Random(seed)
    base = [" ".join(r.choices(WORDS, k=r.randint(1, 12))) for _ in range(n // 4)]
    out = []
    for _ in range(n):
        t = list(r.choice(base))
        for _ in range(r.randint(0, 3)):
            k = r.randrange(len(t) + 1)
            t[k : k + r.randint(0, 1)] = r.choice("abcdefgh 0123456789")
        out.append("".join(t))
    return out


def test_trigram_sets_and_sketches():
    texts = ["", "a", "ab", "aaaa", "x🐝y", "é", "long " * 20_000, "ab"]
    tokens, offsets = trigram_sets(texts)
    assert list(np.diff(offsets))[:4] == [0, 1, 2, 3] and np.diff(offsets)[4] == 4
    assert np.array_equal(tokens[offsets[2] : offsets[3]], tokens[offsets[7] : offsets[8]])
    par = parity_sketch(mix(tokens), rows_of(offsets), len(texts))
    for i, j in combinations(range(len(texts)), 2):
        a, b = (set(tokens[offsets[k] : offsets[k + 1]].tolist()) for k in (i, j))
        assert int(par[i] ^ par[j]).bit_count() <= len(a ^ b)


def listed(cols, t, hot=setjoin.HOT_LIST):
    """All pairs of a cell, those of chunk pairs included."""
    pairs, chunks = set(), []
    for b in setjoin.list_pairs(cols, t, hot):
        for a, o, blob in zip(*(b.column(k).to_pylist() for k in ("a", "b", "blob"))):
            if blob is None:
                pairs.add((a, o))
            else:
                chunks.append(blob)
    for i, x in enumerate(chunks):
        for y in chunks[i:]:
            cx, cy = setjoin.unpack([x]), setjoin.unpack([y])
            if cx["sig"][0] == cy["sig"][0]:
                for a, o in setjoin._tiles(cx, cy, x == y, t):
                    pairs |= set(zip(np.minimum(a, o).tolist(), np.maximum(a, o).tolist()))
    return pairs


@pytest.mark.parametrize("t", [Fraction(4, 5), Fraction(22, 25), Fraction(1, 2)])
def test_index_lists_lose_no_pair(t):
    texts = sorted({x.strip() for x in headlines(400, 3)} - {""})
    uids = np.arange(len(texts), dtype=np.int64) * 3 + 1
    rank = np.random.default_rng(0).permutation(setjoin.BUCKETS)
    cols = setjoin._elements(texts, uids, np.ones(setjoin.BUCKETS), rank, t)
    pairs = listed(cols, t)
    want = {(int(uids[i]), int(uids[j])) for i, j in combinations(range(len(texts)), 2) if similarity(texts[i], texts[j]) >= t}
    assert len(want) > 20 and want <= pairs
    assert want <= listed(cols, t, hot=0)  # every long list as chunks
    a, b = (np.array(x, np.int64) for x in zip(*sorted(pairs)))
    leader = np.minimum(a, uids[0] + 30 * (a // 31 // 3))
    leader = uids[np.searchsorted(uids, leader).clip(0, len(uids) - 1)]
    ok = setjoin.answers(uids, texts, leader, a, b, t)
    assert {p for p, k in zip(sorted(pairs), ok) if k} == want


def test_long_lists_go_out_as_chunks():
    n, t = 1500, Fraction(4, 5)
    c = {"sig": np.full(n, 7, np.uint64), "uid": np.arange(n), "par": np.zeros(n, np.uint64), "size": np.full(n, 40), "pos": np.zeros(n)}
    c = setjoin.unpack([setjoin.pack(c)])
    assert len(listed(c, t)) == n * (n - 1) // 2
    assert [b.column("blob").null_count for b in setjoin.list_pairs(c, t, hot=100)] == [0]  # one chunk
    assert len(listed(c, t, hot=100)) == n * (n - 1) // 2
    halves = [setjoin.pack(c, slice(0, 700)), setjoin.pack(c, slice(700, n))]
    streamed = [b for b in setjoin.salted_chunks(iter(halves), most=1)]
    assert sum(b.num_rows for b in streamed) == 2  # nothing is held beyond the bound


def test_salted_elements_lose_no_pair(spark, monkeypatch):
    """A stem that a third of all sets have, beside others, with the element salted and its list cut into small chunks."""
    for name, value in {"HOT_LIST": 30, "CHUNK": 16, "HOT_SHARE": 20, "SAMPLE": 1}.items():
        monkeypatch.setattr(setjoin, name, value)
    r = random.Random(8)
    stem = "quarterly results of the regional carrier group for the period ending"
    texts = sorted({f"{stem} {r.randrange(400)}" for _ in range(150)} | {x.strip() for x in headlines(250, 6)} - {""})
    norms = spark.createDataFrame(list(enumerate(texts)), "uid long, norm string").repartition(3)
    want = {(i, j) for i, j in combinations(range(len(texts)), 2) if similarity(texts[i], texts[j]) >= Fraction(4, 5)}
    found = []
    real = setjoin.salted_elements
    monkeypatch.setattr(setjoin, "salted_elements", lambda *a: found.append(real(*a)) or found[-1])
    got = [tuple(x) for x in setjoin.similar_sets(norms, Fraction(4, 5)).collect()]
    assert len(found[0]) > 0 and len(got) == len(set(got)) and set(got) == want and len(want) > 5000


def test_near_duplicates_equal_brute_force(spark):
    texts = headlines(240, 5)
    data = [(i, x) for i, x in enumerate(texts)] + [(3, texts[3]), (900, None), (901, ""), (902, "!!!"), (903, "y" * 3000), (904, "y" * 2999 + "z")]
    articles = spark.createDataFrame([(i, x, 1, 2, "k") for i, x in data], "article_id long, title string, uid int, a int, norm string")
    recent = spark.createDataFrame([(2000, texts[0]), (2001, None), (2002, ""), (2003, texts[1] + " x")], "title_id long, norm string")
    norm = {i: normalize_headline(x or "") for i, x in data} | {2000: texts[0], 2003: texts[1] + " x"}
    norm = {i: x for i, x in norm.items() if x}
    want = {(i, j) for i, j in combinations(sorted(norm), 2) if norm[i] != norm[j] and similarity(norm[i], norm[j]) >= Fraction(4, 5)}
    records = near_duplicates.headline_records(articles, recent)
    got = [tuple(r) for r in near_duplicates.similar_records(records).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert near_duplicates.similar_records(records.where("false")).count() == 0


def test_classes(spark):
    data = [(1, "acme ships robot arm today"), (2, "acme ships robot arms today"), (3, "acme ships robot arm today"), (4, "nothing alike here"), (5, None)]
    articles = spark.createDataFrame(data, "article_id long, title string")
    recent = spark.createDataFrame([], "title_id long, norm string")
    got = {r.id: (r.class_id, r.copies, r.links) for r in near_duplicates.similarity_classes(near_duplicates.headline_records(articles, recent)).collect()}
    assert got == {1: (1, 2, 1), 2: (1, 1, 1), 3: (1, 2, 1), 4: (4, 1, 0)}


def test_components_equal_union_find(spark):
    r = random.Random(2)
    edges = [(r.randrange(60), r.randrange(60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(30)] + [(7, 7)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    want = {x: root(x) for x in parent}
    got = components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {n.node: n.component for n in got} == want and len(got) == len(want)


def formatting_fixture(spark):
    data = [
        (1, "News", "https://A.example/1?utm_source=x", None, "AB:12"), (2, "Other", "https://a.example/1/", None, "ab12"), (3, "x", None, "https://a.example/1", "a b-1.2"),
        (4, "News", "https://a.example/1", None, None), (5, "news!", "https://a.example/1#f", None, None), (6, None, "https://a.example/1", None, None), (7, None, None, None, "ab12"),
        (8, "", "/p", None, None), (9, "the", " /p", None, None), (9, "the", " /p", None, None), (10, "n", "https://a.example/2", None, "ab12"), (11, "z" * 9000, "https://b.example/" + "y" * 9000, None, None),
    ]
    return spark.createDataFrame([(*d, 0, "c") for d in data], "article_id long, title string, link string, canonical_url string, title_hash string, k1 int, page string")


def test_formatting_copies(spark):
    df = formatting_fixture(spark).repartition(3)
    assert sorted(tuple(r) for r in formatting_duplicates.copies(df).collect()) == [(1, 2), (1, 3), (4, 5), (8, 9), (8, 9)]
    counts = {r.article_id: r.copies for r in formatting_duplicates.collapsed(df).collect()}
    assert counts == {1: 3, 4: 2, 6: 1, 7: 1, 8: 3, 10: 1, 11: 1}
    assert formatting_duplicates.copies(df.where("false")).count() == 0
    assert formatting_duplicates.collapsed(df.where("false")).count() == 0


@pytest.mark.parametrize("segment", [1 << 12, 1 << 22])
def test_filter_knows_every_repeat_and_few_else(spark, monkeypatch, segment):
    """Small segments stand for a large input: the share of unique keys that pass for repeats doesn't grow."""
    monkeypatch.setattr(formatting_duplicates, "SEGMENT", segment)
    n = 40_000
    ids = spark.range(0, n, 1, 5).select("id", F.when(F.col("id") % 50 == 0, F.lit(7)).when(F.col("id") % 3 == 0, F.col("id") % 3000 + n).otherwise(F.col("id")).alias("v"))
    keys = ids.select("id", F.when(F.col("id") % 97 != 1, F.xxhash64("v")).alias("k1"), F.xxhash64("v", "v").alias("k2")).withColumn("part", F.spark_partition_id())
    stored = bucketed(keys, "part", "test")
    got = formatting_duplicates.flagged(stored, n)
    plan = got._jdf.queryExecution().toString()
    assert plan.count("Exchange hashpartitioning(part") == 1, "only the answers are shuffled by partition"
    counts = keys.groupBy("k1").agg(F.count("*").alias("n"))
    rows = got.join(counts, "k1", "left").groupBy((F.coalesce("n", F.lit(0)) > 1).alias("twice"), "maybe").count().collect()
    table = {(r.twice, r.maybe): r["count"] for r in rows}
    assert (True, False) not in table and table[True, True] > 10_000
    assert table.get((False, True), 0) < 0.02 * table[False, False]


def test_depth_is_widened_to_the_target():
    assert history.widened_depth(1.0) == history.LEVELS
    assert 1 - (1 - 0.88 ** history.widened_depth(0.88)) ** history.TREES >= history.RECALL
    assert history.widened_depth(0.5) < history.widened_depth(0.88)


def test_history_equals_brute_force(spark, monkeypatch):
    r = random.Random(9)
    texts = headlines(160, 11)
    page = lambda: r.choice([None, f"https://a.example/{r.randrange(60)}", f"https://A.example/{r.randrange(60)}/?ref=x"])
    posted = [(1000 + i, page(), None, texts[i] if i % 9 else None) for i in range(60)]
    incoming = [(i, i % 4 if i != 5 else None, texts[60 + i] if i % 11 else "", page(), page()) for i in range(100)]
    incoming.append(incoming[7])
    p = spark.createDataFrame(posted, "entry_id long, url string, canonical_url string, title string")
    q = spark.createDataFrame(incoming, "article_id long, batch_id long, title string, link string, canonical_url string")
    from millrace.functions.url import canonicalize

    canon = lambda u: None if u is None else canonicalize(u)
    recs = [(i, -1, canon(u), normalize_headline(t or "")) for i, u, _, t in posted]
    recs += [(i, b, canon(u if u is not None else c), normalize_headline(t or "")) for i, b, t, u, c in incoming if b is not None]
    want = set()
    for x, y in combinations(set(recs), 2):
        if x[0] != y[0] and x[1] != y[1] and ((x[2] is not None and x[2] == y[2]) or (x[3] and y[3] and similarity(x[3], y[3]) >= Fraction(88, 100))):
            want.add((min(x[0], y[0]), max(x[0], y[0])))
    got = [tuple(g) for g in history.earlier_matches(p, q).collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 20
    monkeypatch.setattr(history, "MERGE_EVERY", 2)
    monkeypatch.setattr(history, "BLOCK", 7)
    each = [tuple(g) for g in history.earlier_matches(p, q, round_rows=1).collect()]  # batch by batch, with merges
    assert len(each) == len(set(each)) and set(each) == want
    assert history.earlier_matches(p.where("false"), q.where("false")).count() == 0


def test_runs_merge_to_the_same_answers(spark, tmp_path):
    texts = sorted({x.strip() for x in headlines(120, 4)} - {""})
    df = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "uid long, norm string")
    forest = history.HashForest(spark, str(tmp_path / "f"), 3)
    forest.append(df.where("uid < 40"), "one")
    forest.append(df.where("uid between 40 and 79"), "two")
    forest.append(df.where("uid >= 80"), "batch")
    before = {tuple(r) for r in forest.candidates("batch", within=False).collect()}
    forest.merge(["one", "two"], "both")
    assert {r.run for r in forest.blocks().select("run").distinct().collect()} == {"both", "batch"}
    assert {tuple(r) for r in forest.candidates("batch", within=False).collect()} == before
    close = {(i, j) for i in range(80) for j in range(80, len(texts)) if similarity(texts[i], texts[j]) >= Fraction(88, 100)}
    assert close <= before
    inside = {(i, j) for i, j in combinations(range(80, len(texts)), 2) if similarity(texts[i], texts[j]) >= Fraction(88, 100)}
    assert close | inside <= {tuple(r) for r in forest.candidates("batch").collect()}


def test_a_small_batch_reads_a_small_part_of_the_index(spark, tmp_path):
    texts = sorted({x.strip() for x in headlines(1500, 14)} - {""})
    df = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "uid long, norm string")
    forest = history.HashForest(spark, str(tmp_path / "f"), 400)
    forest.append(df, "history")
    forest.append(spark.createDataFrame([(9001, texts[3] + " s")], "uid long, norm string"), "batch")
    size = lambda rows: rows.where("run = 'history'").agg(F.sum(F.length("blob"))).first()[0]
    assert "PartitionFilters: [cell" in forest.touched("batch")._jdf.queryExecution().executedPlan().toString()
    assert size(forest.touched("batch")) < 0.1 * size(forest.blocks())


def test_a_large_batch_is_sent_in_slices_and_the_index_not_shuffled(spark, tmp_path, monkeypatch):
    texts = sorted({x.strip() for x in headlines(400, 15)} - {""})
    df = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "uid long, norm string")
    forest = history.HashForest(spark, str(tmp_path / "f"), 12)
    forest.append(df.where("uid % 3 > 0"), "history")
    batch = df.where("uid % 3 = 0")
    forest.append(batch.union(batch), "batch")  # repeated rows count once
    own = {r.cell: r.n for r in forest.blocks().where("run = 'batch'").groupBy("cell").agg(F.sum(F.length("blob")).alias("n")).collect()}
    assert sum(own.values()) == batch.count() * history.TREES * history._ROW_BYTES
    whole = {tuple(r) for r in forest.candidates("batch").collect()}
    monkeypatch.setattr(history, "SENT_BYTES", max(own.values()) + 1)
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        cut_up = forest.candidates("batch")
        assert "SortMergeJoin" not in cut_up._jdf.queryExecution().executedPlan().toString()
        assert {tuple(r) for r in cut_up.collect()} == whole and len(whole) > 20
        assert len(forest.lookups("batch")) > 2
        monkeypatch.setattr(history, "SENT_BYTES", min(own.values()))  # most cells are too large to be sent
        assert {tuple(r) for r in forest.candidates("batch").collect()} == whole
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert history.slices({1: 5, 2: 4, 3: 11, 4: 2, 5: 9}, 10) == ([[1, 2], [4], [5]], [3])


def test_rounds_are_verified_once(spark, monkeypatch):
    texts = headlines(60, 16)
    p = spark.createDataFrame([(1000 + i, None, None, x) for i, x in enumerate(texts[:20])], "entry_id long, url string, canonical_url string, title string")
    q = spark.createDataFrame([(i, i % 5, x, None, None) for i, x in enumerate(texts[20:])], "article_id long, batch_id long, title string, link string, canonical_url string")
    calls = []
    monkeypatch.setattr(history, "verified", lambda *a: calls.append(1) or setjoin.verified(*a))
    monkeypatch.setattr(history, "MERGE_EVERY", 2)
    assert history.earlier_matches(p, q, round_rows=1).count() > 0
    assert len(calls) == 1


def test_a_prefix_that_all_share_is_many_small_units(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(history, "BLOCK", 50)
    n = 600
    same = {"tree": np.zeros(n, np.uint8), "sig": np.full(n, 5, np.uint64), "uid": np.arange(n), "par": np.zeros(n, np.uint64), "size": np.full(n, 30)}
    blocks = history._blocks(0, same, history.BLOCK)
    assert len(blocks) == 12 and max(len(b[3]) for b in blocks) == 50 * history._ROW_BYTES
    met = {p for i, x in enumerate(blocks) for y in blocks[i:] for p in zip(*history.found_in_blocks(history._unpack([x[3]]), history._unpack([y[3]]), 6, Fraction(88, 100)))}
    assert len(met) == n * (n - 1) // 2
