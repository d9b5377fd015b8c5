"""Explainable linear score of an article: one struct of its parts, all in built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace import lexicon
from millrace.functions.bind import let
from millrace.functions.url import domain, path_segments
from millrace.operators.filters import list_hits

PARTS = ["source", "recency", "boost", "penalty", "verbs", "fluff", "lab", "engineering", "depth", "aggregator", "trust", "block", "path"]
NEGATIVE = {"penalty", "fluff", "aggregator", "block", "path"}


def capped(count: Column, points: tuple[int, int]) -> Column:
    return F.least(count * points[0], F.lit(points[1]))


WORD_LISTS = {"boost": lexicon.BOOST_WORDS, "penalty": lexicon.PENALTY_WORDS, "verbs": lexicon.NEWS_VERBS, "fluff": lexicon.FLUFF_WORDS}


def with_word_scores(rows: DataFrame, name: str = "words") -> DataFrame:
    """*rows* (title, snippet) with a struct of the points that the word lists give, from one pass over the text."""
    text = F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("snippet", F.lit("")))
    counted = rows.withColumn("_text", text).withColumn("_hits", list_hits(F.col("_text"), WORD_LISTS))
    years = F.lower("_text").rlike(lexicon.YEARS).cast("int")
    points = {
        "boost": capped(F.col("_hits.boost"), lexicon.BOOST_POINTS),
        "penalty": capped(F.col("_hits.penalty"), lexicon.PENALTY_POINTS),
        "verbs": capped(F.col("_hits.verbs"), lexicon.VERB_POINTS),
        "fluff": capped(F.col("_hits.fluff") + years, lexicon.FLUFF_POINTS),
    }
    return counted.withColumn(name, F.struct(*[c.cast("int").alias(k) for k, c in points.items()])).drop("_text", "_hits")


def recency(published: Column, now: Column, points: int = lexicon.RECENCY_POINTS, hours: int = lexicon.RECENCY_HOURS) -> Column:
    """Points that fall linearly from now to *hours* ago; milliseconds count, halves are rounded up; null has none."""
    age = F.greatest(F.unix_millis(now.cast("timestamp")) - F.unix_millis(published.cast("timestamp")), F.lit(0)) / 3_600_000.0
    return F.coalesce(F.when(published.isNull() | (age >= hours), 0).otherwise(F.floor(points * (1 - age / hours) + 0.5).cast("int")), F.lit(0))


def suffix_match(host: Column, table: list[tuple[str, int]]) -> Column:
    """Points of the first row of the table whose domain is the host or a suffix of it at a dot; 0 without one."""
    rows = F.array(*[F.struct(F.lit(d).alias("d"), F.lit(p).alias("p")) for d, p in table])
    first = lambda h: F.get(F.filter(rows, lambda r: (h == r["d"]) | h.endswith(F.concat(F.lit("."), r["d"]))), F.lit(0))["p"]
    return F.coalesce(let(host, first), F.lit(0))


def is_blocked(host: Column, blocked: list[str] = lexicon.BLOCKED_DOMAINS) -> Column:
    return suffix_match(host, [(d, 1) for d in blocked]) == 1


def path_points(url: Column, points: int = lexicon.PATH_POINTS, anywhere: list[str] = lexicon.PATH_SEGMENTS, first: dict[str, str] = lexicon.FIRST_SEGMENTS, host: Column | None = None) -> Column:
    """Points against pages with one of the path segments of *anywhere*, or with the first segment that *first* names for
    their host or a domain above it."""
    def points_of(host: Column, segments: Column) -> Column:
        hit = F.arrays_overlap(segments, F.array(*map(F.lit, anywhere)))
        for domain_, segment in first.items():
            hit = hit | ((host == domain_) | host.endswith("." + domain_)) & (F.coalesce(F.get(segments, F.lit(0)), F.lit("")) == segment)
        return F.when(hit, points).otherwise(0)

    return let(domain(url) if host is None else host, lambda h: let(path_segments(url), lambda segments: points_of(h, segments)))


def score_parts(now: Column, trust: list[tuple[str, int]] = lexicon.DOMAIN_TRUST) -> dict[str, Column]:
    """Columns of each part over an article view (title, snippet, source, priority, link, canonical_url, pub_ts) with
    ``_url``, ``_host`` and ``_words``."""
    url, host = F.col("_url"), F.col("_host")
    snippet = F.coalesce("snippet", F.lit(""))
    utf16 = F.octet_length(F.encode(snippet, "UTF-16BE")) / 2
    weight = F.lit(0)
    for p, w in lexicon.SOURCE_WEIGHT.items():
        weight = F.when(F.col("priority") == p, w).otherwise(weight)
    return {
        "source": weight,
        "recency": recency(F.col("pub_ts"), now),
        **{k: F.col(f"_words.{k}") for k in WORD_LISTS},
        "lab": F.when(F.col("source").isin(lexicon.LAB_SOURCES), lexicon.LAB_POINTS).otherwise(0),
        "engineering": F.when(F.col("source").isin(lexicon.ENGINEERING_SOURCES), lexicon.ENGINEERING_POINTS).otherwise(0),
        "depth": F.when(utf16 >= lexicon.DEPTH_CHARS, lexicon.DEPTH_POINTS).otherwise(0),
        "aggregator": F.when(F.col("source") == lexicon.AGGREGATOR, lexicon.AGGREGATOR_POINTS).otherwise(0),
        "trust": suffix_match(host, trust),
        "block": F.when(is_blocked(host), lexicon.BLOCK_POINTS).otherwise(0),
        "path": path_points(url, host=host),
    }


def scored(view: DataFrame, now: Column, trust: list[tuple[str, int]] = lexicon.DOMAIN_TRUST) -> DataFrame:
    """The view with ``parts`` (a struct of the 13 parts) and ``total``."""
    url = F.coalesce(F.when(F.col("canonical_url") != "", F.col("canonical_url")), F.col("link"))
    rows = with_word_scores(view.withColumn("_url", url).withColumn("_host", domain(F.col("_url"))), "_words")
    rows = rows.withColumn("parts", F.struct(*[c.cast("int").alias(k) for k, c in score_parts(now, trust).items()]))
    total = sum((-F.col(f"parts.{k}") if k in NEGATIVE else F.col(f"parts.{k}") for k in PARTS), F.lit(0))
    return rows.withColumn("total", total).drop("_url", "_host", "_words")


def explain_parts(parts: Column) -> Column:
    """One line of text with the parts that count."""
    items = [F.when(parts[k] != 0, F.concat(F.lit(f"{'-' if k in NEGATIVE else '+'}"), parts[k].cast("string"), F.lit(f" {k}"))) for k in PARTS]
    return F.concat_ws(", ", *items)
