"""Aggregates: exact percentiles, thresholds, usage counts, funnels, source health, streaks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.operators.ranges import running_total


def is_finite(c: Column) -> Column:
    """Neither null, NaN nor infinite."""
    d = c.cast("double")
    return F.coalesce(~F.isnan(d) & (F.abs(d) < float("inf")), F.lit(False))


def exact_percentile(c: Column, p: float) -> Column:
    """Linear-interpolation percentile of the finite values; p is clamped to [0, 1]; 0 of none."""
    return F.coalesce(F.percentile(F.when(is_finite(c), c.cast("double")), F.lit(min(1.0, max(0.0, p)))), F.lit(0.0))


def percentiles_by(rows: DataFrame, group: str, value: str, ps: dict[str, float]) -> DataFrame:
    """(group, n, one column for each of *ps*): exact percentiles, linearly interpolated, of the finite values of each group.

    Values are ranked by a range sort with prefix sums, so that no task holds a group or its distinct values; only the two
    rows beside each rank that is asked for are collected by group. A null group is a group."""
    finite = rows.where(is_finite(F.col(value))).select(F.col(group).alias("g"), F.col(value).cast("double").alias("v"), F.lit(1).cast("long").alias("one"))
    placed = running_total(finite, [F.col("g"), F.col("v")], "one", "at")
    spans = placed.groupBy("g").agg(F.min("at").alias("start"), F.count("*").alias("n"))
    asked = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(min(1.0, max(0.0, p))).alias("p")) for k, p in ps.items()])
    wanted = spans.select("g", "start", "n", F.explode(asked).alias("w")).withColumn("rank", F.col("w.p") * (F.col("n") - 1))
    ends = wanted.select("g", "n", "w.k", "rank", F.explode(F.array_distinct(F.array(F.floor("rank"), F.ceil("rank")))).alias("r"), (F.col("start") + F.col("r")).alias("at"))
    share = F.when(F.floor("rank") == F.ceil("rank"), F.lit(1.0)).otherwise(1 - F.abs(F.col("r") - F.col("rank")))
    value_at = ends.join(placed.select("at", "v"), "at")
    return value_at.groupBy("g", "n").pivot("k", list(ps)).agg(F.sum(F.col("v") * share)).withColumnRenamed("g", group)


def adaptive_thresholds(rows: DataFrame, group: str, value: str, p: float = 0.25, least: int = 10, default: int = 195, low: int = 170, high: int = 260) -> DataFrame:
    """(group, threshold): as :func:`adaptive_threshold`, for groups of any size."""
    counts = rows.groupBy(group).agg(F.count("*").alias("_rows"))
    cut_at = percentiles_by(rows, group, value, {"p": p}).select(F.col(group).alias("_g"), "p")
    both = counts.join(cut_at, counts[group].eqNullSafe(cut_at["_g"]), "left")
    held = F.greatest(F.lit(low), F.least(F.lit(high), F.floor(F.coalesce("p", F.lit(0.0)) + 0.5).cast("int")))
    return both.select(group, F.when(F.col("_rows") < least, default).otherwise(held).alias("threshold"))


def adaptive_threshold(c: Column, p: float = 0.25, least: int = 10, default: int = 195, low: int = 170, high: int = 260) -> Column:
    """The default under *least* rows, else the rounded percentile held between *low* and *high*."""
    value = F.greatest(F.lit(low), F.least(F.lit(high), F.floor(exact_percentile(c, p) + 0.5).cast("int")))
    return F.when(F.count(F.lit(1)) < least, default).otherwise(value)


def usage_by_day(rows: DataFrame, at: str, category: str) -> DataFrame:
    """(day, category, n) by UTC day."""
    return rows.groupBy(F.date_format(at, "yyyy-MM-dd").alias("day"), F.col(category).alias("category")).agg(F.count("*").alias("n"))


def remaining_quota(usage: DataFrame, quota: dict[str, int]) -> DataFrame:
    """(day, category, used, quota, remaining) of every day with usage and every category with a quota."""
    spark = usage.sparkSession
    limits = spark.createDataFrame(sorted(quota.items()), "category string, quota int")
    days = usage.select("day").distinct()
    grid = days.join(F.broadcast(limits))  # a row a category
    rows = grid.join(usage, ["day", "category"], "left").withColumn("used", F.coalesce("n", F.lit(0)))
    return rows.select("day", "category", "used", "quota", F.greatest(F.col("quota") - F.col("used"), F.lit(0)).alias("remaining"))


def reason_funnel(rows: DataFrame, reasons: list[tuple[str, Column]], rest: str = "kept") -> DataFrame:
    """(reason, n): each row counts for the first reason that holds; one pass, reasons without rows included."""
    which = F.lit(rest)
    for name, cond in reversed(reasons):
        which = F.when(F.coalesce(cond, F.lit(False)), name).otherwise(which)
    counts = rows.groupBy(which.alias("reason")).agg(F.count("*").alias("n"))
    names = rows.sparkSession.createDataFrame([(n,) for n, _ in reasons] + [(rest,)], "reason string")
    return names.join(counts, "reason", "left").select("reason", F.coalesce("n", F.lit(0)).alias("n"))


def source_health(registry: DataFrame, rows: DataFrame, name: str = "name", source: str = "source") -> DataFrame:
    """(name, n, ok) of every registered source, those without rows too."""
    counts = rows.groupBy(F.col(source).alias(name)).agg(F.count("*").alias("n"))
    return registry.select(name).join(counts, name, "left").select(name, F.coalesce("n", F.lit(0)).alias("n"), F.col("n").isNotNull().alias("ok"))


def last_streak(events: DataFrame, key: str, order: list[str], failed: Column) -> DataFrame:
    """(key, streak): failures after the last success of each key; two aggregations, no group is sorted whole."""
    at = F.struct(*order)
    rows = events.select(key, at.alias("_at"), failed.alias("_f"))
    success = rows.where("not _f").groupBy(key).agg(F.max("_at").alias("_last"))
    both = rows.join(success, key, "left")
    return both.groupBy(key).agg(F.count_if(F.col("_f") & (F.col("_last").isNull() | (F.col("_at") > F.col("_last")))).alias("streak"))


def longest_streak(events: DataFrame, key: str, order: list[str], failed: Column) -> DataFrame:
    """(key, longest): the longest run of failures of each key (gaps and islands). The runs are told by how many successes
    come before in a range sort of all keys, so that a key with much of the input spreads over many tasks."""
    rows = events.select(key, *order, failed.alias("_f")).withColumn("_s", F.when(F.col("_f"), 0).otherwise(1).cast("long"))
    placed = running_total(rows, [F.col(c) for c in (key, *order)], "_s", "_g")
    runs = placed.groupBy(key, "_g").agg(F.count_if("_f").alias("_n"))
    return runs.groupBy(key).agg(F.max("_n").alias("longest"))


def outcome_summary(rows: DataFrame, ok: str = "ok", name: str = "name") -> DataFrame:
    """(total, ok_n, failed_n, status): counts and the sorted names of what failed."""
    failed = F.sort_array(F.collect_set(F.when(~F.col(ok), F.col(name))))
    return rows.agg(F.count("*").alias("total"), F.count_if(ok).alias("ok_n"), F.count_if(~F.col(ok)).alias("failed_n"), F.array_join(failed, ", ").alias("status"))
