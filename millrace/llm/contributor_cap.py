"""Capping records per dominant contributor (problem 6).

Contributors are counted first: only those over the cap lose records, and over a cap of share s there are at most 1/s.
Their records are range-sorted by contributor, descending score and id. Prefix sums of the partitions' counts give each
record its exact position; less the position at which its contributor starts, that is its rank, and ranks from the cap on
are dropped. A contributor with a third of all rows is spread over as many range partitions as it fills.

Defined results: contributor names that differ in letter case and white space are one; a null contributor is never
capped; a null score is the lowest; equal scores go by the smaller id; an empty table gives an empty result.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions.text import source_key
from millrace.operators.ranges import running_total
from millrace.session import cut

SHARE = Fraction(4, 100)


def ranked_beyond_cap(records: DataFrame, cap: int, counts: DataFrame | None = None) -> DataFrame:
    """(id, contributor, rank) of the records of rank >= cap. records: (id, contributor, score); counts: (contributor, n)."""
    counts = records.groupBy("contributor").agg(F.count("*").alias("n")) if counts is None else counts
    over = counts.where((F.col("n") > cap) & F.col("contributor").isNotNull()).select("contributor")
    rows = records.join(over, "contributor").select("contributor", "score", "id", F.lit(1).cast("long").alias("one"))
    order = [F.col("contributor"), F.col("score").desc_nulls_last(), F.col("id")]
    placed = running_total(rows, order, "one", "position")
    starts = placed.groupBy("contributor").agg(F.min("position").alias("start"))
    ranked = placed.join(starts, "contributor")
    return ranked.select("id", "contributor", (F.col("position") - F.col("start")).alias("rank")).where(F.col("rank") >= cap)


def over_share(articles: DataFrame, share: Fraction = SHARE) -> DataFrame:
    """(article_id): the records to drop so that no contributor keeps more than floor(share * all rows)."""
    records = articles.select(F.col("article_id").alias("id"), source_key(F.col("source")).alias("contributor"), "score")
    counts = cut(records.groupBy("contributor").agg(F.count("*").alias("n")), "contributors")
    cap = (counts.agg(F.sum("n")).first()[0] or 0) * share.numerator // share.denominator
    return ranked_beyond_cap(records, cap, counts).select(F.col("id").alias("article_id"))
