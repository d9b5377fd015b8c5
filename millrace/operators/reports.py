"""Reports and alerts over stored tables: sources and queue in order, usage, alerts once a day, after a run, after a streak."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.operators.ranges import running_total

STREAK, DAILY, FAILED, SHORT_QUEUE = 3, 3, 12, 6


def numbered(rows: DataFrame, order: list[Column], name: str = "pos") -> DataFrame:
    """*rows* with their position, from 1, in a global order: a range sort with prefix sums, whatever the number of rows."""
    one = rows.withColumn("_one", F.lit(1).cast("long"))
    return running_total(one, order, "_one", "_at").withColumn(name, F.col("_at") + 1).drop("_one", "_at")


def source_report(health: DataFrame) -> DataFrame:
    """(pos, name, n, ok, total, ok_n, failed_n): what failed first, then by count; a row a registered source."""
    totals = health.agg(F.count("*").alias("total"), F.count_if("ok").alias("ok_n"), F.count_if(~F.col("ok")).alias("failed_n"))
    order = [F.col("ok").asc(), F.col("n").desc(), F.col("name").asc()]
    return numbered(health, order).join(F.broadcast(totals))  # one row


def usage_lines(usage: DataFrame, quota: dict[str, int]) -> DataFrame:
    """(day, line, used, quota): one line of text a day, "core 3/8, ai 7/7(full)", categories in the order of *quota*."""
    limits = usage.sparkSession.createDataFrame([(i, c, q) for i, (c, q) in enumerate(quota.items())], "i int, category string, quota int")
    grid = usage.select("day").distinct().join(F.broadcast(limits))  # a row a category
    rows = grid.join(usage, ["day", "category"], "left").withColumn("u", F.coalesce("n", F.lit(0)))
    item = F.concat("category", F.lit(" "), F.col("u").cast("string"), F.lit("/"), F.col("quota").cast("string"), F.when(F.col("u") >= F.col("quota"), "(full)").otherwise(""))
    lines = rows.groupBy("day").agg(F.sort_array(F.collect_list(F.struct("i", item.alias("t")))).alias("l"), F.sum("u").alias("used"), F.sum("quota").alias("quota"))
    return lines.select("day", F.array_join(F.transform("l", lambda x: x["t"]), ", ").alias("line"), "used", "quota")


def as_text(rows: DataFrame, line: Column, order: list[str], most: int = 50) -> DataFrame:
    """(text): the first *most* rows in order as lines of one text, for a reply."""
    first = rows.withColumn("_line", line).orderBy(*order).limit(most)
    listed = first.agg(F.sort_array(F.collect_list(F.struct(*order, "_line"))).alias("l"))  # most rows
    return listed.select(F.array_join(F.transform("l", lambda x: x["_line"]), "\n").alias("text"))


def daily_alerts(events: DataFrame, at: str, ident: str, least: int = DAILY) -> DataFrame:
    """(day, ident): the event with which a day reaches *least* events; one alert a day at most. Spark keeps the first
    *least* rows of a day in every partition only."""
    day = F.date_format(at, "yyyy-MM-dd")
    rank = F.row_number().over(W.partitionBy("day").orderBy(at, ident))
    return events.select(day.alias("day"), at, ident).withColumn("_n", rank).where(F.col("_n") <= least).where(F.col("_n") == least).select("day", ident)


def streak_alerts(streaks: DataFrame, least: int = STREAK) -> DataFrame:
    """Keys whose last *least* or more tries failed."""
    return streaks.where(F.col("streak") >= least)


def refill_alerts(runs: DataFrame, failed: int = FAILED, short: int = SHORT_QUEUE) -> DataFrame:
    """(run, alert): what a run of the refill gives cause to tell: 'exhausted' if that many slots failed, 'low' if the queue
    is short after it. runs: (run, failed, queued)."""
    causes = F.array(F.when(F.col("failed") >= failed, F.lit("exhausted")), F.when(F.col("queued") < short, F.lit("low")))
    return runs.select("run", F.explode(F.array_compact(causes)).alias("alert"))


def state_probe(spark: SparkSession, path: str) -> list[tuple[str, bool]]:
    """(step, ok): whether a row written under *path* is read back and is gone after removal."""
    from millrace.session import remove

    spark.createDataFrame([("probe", 1)], "key string, n int").write.mode("overwrite").parquet(path)
    back = [tuple(r) for r in spark.read.parquet(path).collect()] == [("probe", 1)]
    remove(spark, path)
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    gone = not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)
    return [("put", True), ("get", back), ("delete", gone)]


def cleared(queue: DataFrame, path: str) -> None:
    """Overwrite a stored queue with an empty one of the same columns."""
    queue.where("false").write.mode("overwrite").parquet(path)
