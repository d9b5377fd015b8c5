"""Queries of the subpackage llm over the test tables, with production parameters, and their SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from millrace.llm import contributor_cap, formatting_duplicates, garbled, history, mixing, near_duplicates, reading_level, tokenizer, top_per_group
from millrace.sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def _headlines(spark: SparkSession, d: str) -> DataFrame:
    return near_duplicates.headline_records(table(spark, d, "articles"), table(spark, d, "recent_titles"))


@query("p1_found")
def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return near_duplicates.similar_records(_headlines(spark, d))


@query("p1_classes")
def p1_classes(spark: SparkSession, d: str) -> DataFrame:
    return near_duplicates.similarity_classes(_headlines(spark, d))


@query("p2_found")
def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return formatting_duplicates.copies(table(spark, d, "articles"))


@query("p2_records")
def p2_records(spark: SparkSession, d: str) -> DataFrame:
    return formatting_duplicates.collapsed(table(spark, d, "articles"))


@query("p3_found")
def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return garbled.garbled_fields(table(spark, d, "articles")).select("article_id", "field")


@query("p3_restored")
def p3_restored(spark: SparkSession, d: str) -> DataFrame:
    return garbled.garbled_fields(table(spark, d, "articles"))


@query("p4_found")
def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return history.earlier_matches(table(spark, d, "posted_history"), table(spark, d, "incoming_articles"))


@query(
    "p5_found",
    """
    SELECT batch_id, category, article_id FROM (
      SELECT batch_id, category, article_id, row_number() OVER (PARTITION BY batch_id, category
        ORDER BY score DESC NULLS LAST, priority ASC NULLS LAST, article_id ASC) AS rn
      FROM articles WHERE batch_id IS NOT NULL AND category IS NOT NULL) t
    WHERE rn <= 3
    """,
)
def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return top_per_group.best_of_runs(table(spark, d, "articles"))


@query(
    "p6_found",
    r"""
    WITH keyed AS (
      SELECT article_id, score, trim(regexp_replace(lower(source), '[\s\x{00A0}\x{2000}-\x{200A}\x{202F}\x{3000}]+', ' ', 'g')) AS k FROM articles),
    ranked AS (SELECT article_id, row_number() OVER (PARTITION BY k ORDER BY score DESC NULLS LAST, article_id) AS rn FROM keyed WHERE k IS NOT NULL)
    SELECT article_id FROM ranked WHERE rn > (SELECT count(*) * 4 // 100 FROM articles)
    """,
)
def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return contributor_cap.over_share(table(spark, d, "articles"))


@query("p8_ids")
def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokenizer.corpus_ids(table(spark, d, "documents"))


@query("p9_mix")
def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mixture(table(spark, d, "documents"), table(spark, d, "mix_targets"))


@query("p9_shares")
def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    targets = table(spark, d, "mix_targets")
    return mixing.shares(mixing.mixture(table(spark, d, "documents"), targets), targets)


@query("p10_found")
def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return reading_level.reading_levels(table(spark, d, "documents"), table(spark, d, "reading_labels"))
