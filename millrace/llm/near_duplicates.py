"""Near-duplicate records with small edits (problem 1).

Headlines are compared as trigram sets. Equal headlines collapse first (a text has one row however many records carry
it), the join by set-relation skipping (setjoin) finds all pairs of distinct texts, and only then are pairs spread over
the records. Defined results: null and empty headlines have no partners; records with equal headlines are no pair here;
repeated rows of one record count once; a record is never its own partner; any other column is ignored.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions.text import normalized_headline
from millrace.llm.components import connected_components
from millrace.llm.setjoin import similar_sets
from millrace.session import cut

THRESHOLD = Fraction(80, 100)


def headline_records(articles: DataFrame, recent: DataFrame) -> DataFrame:
    """(id, uid, norm) of every record with a headline; uid is a 64-bit hash of the headline."""
    rows = articles.select(F.col("article_id").alias("id"), normalized_headline(F.col("title")).alias("norm"))
    rows = rows.unionByName(recent.select(F.col("title_id").alias("id"), F.coalesce("norm", F.lit("")).alias("norm")))
    return rows.where("norm <> ''").select("id", F.xxhash64("norm").alias("uid"), "norm")


def distinct_headlines(records: DataFrame) -> DataFrame:
    return records.groupBy("uid").agg(F.min("norm").alias("norm"))


def similar_records(records: DataFrame, t: Fraction = THRESHOLD) -> DataFrame:
    """(id_a, id_b), id_a < id_b: records whose headlines differ and have similarity >= t."""
    records = cut(records, "records")
    norms = cut(distinct_headlines(records), "norms")
    links = similar_sets(norms, t)
    members = records.select("id", "uid").distinct()
    left = links.join(members.select(F.col("uid").alias("a"), F.col("id").alias("x")), "a")
    both = left.join(members.select(F.col("uid").alias("b"), F.col("id").alias("y")), "b").where("x <> y")
    return both.select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))


def similarity_classes(records: DataFrame, t: Fraction = THRESHOLD) -> DataFrame:
    """(id, class_id, copies, links): one row a record: the smallest id of its class (headlines linked by similarity),
    records with the same headline, and how many other headlines are similar to its own."""
    records = cut(records.distinct(), "records")
    norms = cut(distinct_headlines(records), "norms")
    links = cut(similar_sets(norms, t), "links")
    degree = links.select(F.explode(F.array("a", "b")).alias("uid")).groupBy("uid").agg(F.count("*").alias("links"))
    label = connected_components(links).select(F.col("node").alias("uid"), "component")
    of = records.groupBy("uid").agg(F.min("id").alias("first"), F.count("*").alias("copies"))
    info = of.join(degree, "uid", "left").join(label, "uid", "left").withColumn("component", F.coalesce("component", "uid"))
    first = info.groupBy("component").agg(F.min("first").alias("class_id"))
    info = info.join(first, "component").select("uid", "class_id", "copies", F.coalesce("links", F.lit(0)).alias("links"))
    return records.select("id", "uid").join(info, "uid").select("id", "class_id", "copies", "links")
