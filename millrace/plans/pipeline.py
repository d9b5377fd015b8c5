"""Compositions of the operators: candidates with the reasons of what fell out, a run's choice, a refill of open slots."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace import enrich, lexicon
from millrace.functions.text import normalized_headline
from millrace.functions.url import canonical_url
from millrace.operators import dedup, filters, scoring, selection, statistics
from millrace.session import cut


@dataclass
class Settings:
    """Everything a run depends on besides its tables."""

    now: Column
    hours: int = lexicon.FRESH_HOURS
    paths: list[str] = field(default_factory=lambda: lexicon.PATH_BLACKLIST)
    titles: list[str] = field(default_factory=lambda: lexicon.TITLE_BLACKLIST)
    trust: list[tuple[str, int]] = field(default_factory=lambda: lexicon.DOMAIN_TRUST)
    quota: dict[str, int] = field(default_factory=lambda: lexicon.DAILY_QUOTA)
    paper_source: str = "arXiv cs.AI"
    least_score: int = 195
    candidates: int = 10


def reasons(s: Settings) -> list[tuple[str, Column]]:
    """Why a row of an article view falls out before any table is asked, in order."""
    paper = (F.col("source") == s.paper_source) & (filters.separate_hits(F.col("title"), lexicon.PAPER_WORDS) < 2)
    return [
        ("incomplete", ~filters.has_required(F.col("title"), F.col("link"))),
        ("old", ~filters.is_fresh(F.col("pub_ts"), s.now, s.hours)),
        ("path", filters.contains_any(F.col("link"), s.paths)),
        ("title", filters.contains_any(F.col("title"), s.titles)),
        ("paper", F.coalesce(paper, F.lit(False))),
    ]


def on_topic(view: DataFrame, s: Settings) -> DataFrame:
    keep = F.lit(True)
    for _, out in reasons(s):
        keep = keep & ~out
    return view.where(keep)


def funnel(view: DataFrame, s: Settings) -> DataFrame:
    """(reason, n) of the same tests, in one pass."""
    return statistics.reason_funnel(view, reasons(s))


def unknown(rows: DataFrame, posted: DataFrame, queued: DataFrame, failures: DataFrame) -> DataFrame:
    """Rows that are neither posted (by page or headline) nor queued (by page or link) nor failed too often.
    posted: (url, title); queued: (link, canonical_url); failures: (page, n)."""
    rows = rows.withColumn("page", canonical_url(F.coalesce("canonical_url", "link"))).withColumn("headline", F.nullif(normalized_headline(F.col("title")), F.lit("")))
    done = posted.select(canonical_url(F.col("url")).alias("page"), F.nullif(normalized_headline(F.col("title")), F.lit("")).alias("headline"))
    rows = dedup.not_seen(dedup.not_seen(rows, done, "page"), done, "headline")
    rows = dedup.not_seen_by_any(rows, queued, ["canonical_url", "link"], ["canonical_url", "link"])
    return filters.below_failures(rows, failures, "page")


def one_an_event(rows: DataFrame) -> DataFrame:
    """Of scored rows the winner of each event. All rows count, also beyond the 200 that a run of the feeds gives; those
    without a headline fall out. The pass is greedy, newest first, in one task."""
    batch = rows.select("article_id", "title", "priority", F.col("total").alias("score"), "snippet", "pub_ts")
    return rows.join(dedup.cluster_batch(batch, "article_id", [], cap=None).select(F.col("id").alias("article_id")), "article_id", "left_semi")


def unlike_queued(rows: DataFrame, queued: DataFrame) -> DataFrame:
    """Rows whose ``headline`` is like none of the queued titles, under the lower threshold of the queue."""
    titles = queued.where("title is not null").select(normalized_headline(F.col("title")).alias("norm"), F.col("title").alias("raw"), F.col("title").alias("pos"))
    return dedup.fuzzy_known(rows, "headline", titles, dedup.QUEUED, cap=None).where("similar_to is null").drop("similar_to")


def candidates(view: DataFrame, posted: DataFrame, queued: DataFrame, failures: DataFrame, recent: DataFrame, s: Settings) -> DataFrame:
    """The best rows that are on topic, one an event, unknown, and like none of the recent headlines (norm, raw, pos) nor
    of the titles of *queued*, where it has the column ``title``; with their score. An event whose winner is known is gone."""
    rows = unknown(one_an_event(scoring.scored(on_topic(view, s), s.now, s.trust)), posted, queued, failures)
    rows = dedup.fuzzy_known(rows, "headline", recent).where("similar_to is null").drop("similar_to")
    if "title" in queued.columns:
        rows = unlike_queued(rows, queued)
    return rows.orderBy(F.desc("total"), "article_id").limit(s.candidates).withColumn("low", F.col("total") < s.least_score)


def choice(found: DataFrame, usage: DataFrame, s: Settings) -> DataFrame:
    """The row to take next: the best of a category with quota left today, else the best of all. usage: (category, n)."""
    limits = found.sparkSession.createDataFrame(sorted(s.quota.items()), "category string, quota long")
    room = limits.join(usage, "category", "left").select("category", (F.col("quota") - F.coalesce("n", F.lit(0))).alias("remaining"))
    return selection.best_in_open_bucket(found, room, "category", [F.desc("total"), F.col("article_id")])


def refill_run(found: DataFrame, slots: DataFrame, taken: DataFrame, queued_by_source: DataFrame, chain: list[tuple[str, enrich.Provider]], per_source: int = 2, template: str = "{content}") -> tuple[DataFrame, DataFrame]:
    """(filled, metrics) of a whole refill. Open slots get the candidates in turn; each is summarised by the chain; the slots
    whose candidate failed get those that stand in, once. A slot that is taken stays as it is, so a repeated run fills only
    what is open. found: (article_id, category, source, total, title, snippet); filled: (slot, article_id, provider, answer,
    round); metrics: (open, filled, failed), one row."""
    order = [F.desc("total"), F.col("article_id")]
    turns = selection.round_robin(found.select("article_id", "category", "source", "total"), "category", order, lexicon.CATEGORIES)
    capped = cut(selection.running_cap(turns, "source", [F.col("pos")], per_source, queued_by_source).select("article_id", "pos"), "refill")
    free = cut(slots.join(taken.select("slot").distinct(), "slot", "left_anti"), "slots")
    first, spare = selection.split_pool(capped, [F.col("pos")], free.count())

    def summarised(placed: DataFrame, number: int) -> DataFrame:
        texts = placed.join(found.select("article_id", "title", "snippet"), "article_id")
        said = enrich.summarize(texts, "article_id", chain, template)
        # written at once, so that no provider is asked twice for a row
        return cut(placed.join(said, "article_id").select("slot", "article_id", "provider", "answer", F.lit(number).alias("round")), "answers")

    one = summarised(selection.zip_by_rank(first, free, [F.col("pos")], [F.col("slot")], 500).select("slot", "article_id"), 1)
    left = free.join(one.where("provider is not null").select("slot"), "slot", "left_anti").join(one.select("slot"), "slot", "left_semi")
    two = summarised(selection.zip_by_rank(left, spare, [F.col("slot")], [F.col("pos")], 500).select("slot", "article_id"), 2)
    filled = one.unionByName(two).where("provider is not null")
    counts = filled.agg(F.count("*").alias("filled")).join(free.agg(F.count("*").alias("open")))  # one row each
    return filled, counts.select("open", "filled", (F.col("open") - F.col("filled")).alias("failed"))


def refill(found: DataFrame, slots: DataFrame, taken: DataFrame, queued_by_source: DataFrame, per_source: int = 2) -> DataFrame:
    """(rank, slot, article_id): open slots filled from the candidates, interleaved by category, capped by source."""
    turns = selection.round_robin(found.select("article_id", "category", "source", "total"), "category", [F.desc("total"), F.col("article_id")], lexicon.CATEGORIES)
    capped = selection.running_cap(turns, "source", [F.col("pos")], per_source, queued_by_source)
    return selection.assign_slots(capped, slots, taken, [F.col("pos")]).select("rank", "slot", "article_id")
