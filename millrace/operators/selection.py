"""Selection under quotas and caps: buckets, round robin, running caps, hourly slots, positional zips, retry ranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.operators.ranges import running_total


def best_in_open_bucket(rows: DataFrame, remaining: DataFrame, category: str, order: list[Column], take: int = 1) -> DataFrame:
    """The first *take* rows in order, those of a category with quota left before all others; ``fallback`` tells whether
    a row's category had none. remaining: (category, remaining); categories absent there have none."""
    room = remaining.select(F.col("category").alias("_c"), F.col("remaining").alias("_r"))
    both = rows.join(room, rows[category] == room["_c"], "left").withColumn("fallback", F.coalesce("_r", F.lit(0)) <= 0)
    return both.drop("_c", "_r").orderBy("fallback", *order).limit(take)


def round_robin(rows: DataFrame, category: str, order: list[Column], categories: list[str]) -> DataFrame:
    """*rows* with ``turn`` (rank within the category) and ``pos`` of the interleaving (turn, then category order, then
    name). rows must have no columns of these names.

    Ranks come from a range sort with prefix sums, so a category with a third of all rows spreads over many tasks; the
    position is then counted from one small table of category sizes."""
    place = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, categories)), F.col(category)), F.lit(0)), F.lit(len(categories) + 1)).cast("int")
    one = rows.withColumn("_one", F.lit(1).cast("long")).withColumn("_o", place)
    placed = running_total(one, [F.col("_o"), F.col(category), *order], "_one", "_at").drop("_one")
    sizes = placed.groupBy("_o", category).agg(F.min("_at").alias("_start"), F.count("*").alias("_n"))
    sizes = sizes.select(F.col("_o").alias("o"), F.coalesce(category, F.lit("")).alias("c"), F.col("_start").alias("s"), F.col("_n").alias("n"))
    table = sizes.agg(F.collect_list(F.struct("o", "c", "s", "n")).alias("_all"))  # a struct a category
    me = F.coalesce(category, F.lit(""))
    both = placed.join(F.broadcast(table))
    own = F.filter("_all", lambda x: (x["o"] == F.col("_o")) & (x["c"] == me))[0]
    ranked = both.withColumn("turn", F.col("_at") - own["s"] + 1)
    earlier = lambda x: (x["o"] < F.col("_o")) | ((x["o"] == F.col("_o")) & (x["c"] < me))
    before = F.aggregate("_all", F.lit(0).cast("long"), lambda acc, x: acc + F.least(x["n"], F.when(earlier(x), F.col("turn")).otherwise(F.col("turn") - 1)))
    return ranked.withColumn("pos", before + 1).drop("_all", "_o", "_at")


def running_cap(rows: DataFrame, key: str, order: list[Column], cap: int, already: DataFrame | None = None) -> DataFrame:
    """Rows, in order, as long as their key has fewer than *cap*, those counted in already (key, n) included."""
    # cut to the cap by itself first: Spark does that before the shuffle, so a hot key sends at most *cap* rows a partition
    ranked = capped_per_source(rows, key, order, cap, keep="_rn")
    if already is not None:
        ranked = ranked.join(already.select(key, F.col("n").alias("_n")), key, "left")
    else:
        ranked = ranked.withColumn("_n", F.lit(0))
    return ranked.where(F.col("_rn") + F.coalesce("_n", F.lit(0)) <= cap).drop("_rn", "_n")


def next_slots(now: Column, n: int, first_hour: int = 0, last_hour: int = 17) -> Column:
    """The next n full hours after *now* that lie between the two UTC hours, as an array of timestamps."""
    begin = F.date_trunc("hour", now.cast("timestamp")) + F.expr("INTERVAL 1 HOUR")
    hours = F.sequence(begin, begin + F.make_dt_interval(days=F.lit(2 + n // max(1, last_hour - first_hour + 1))), F.expr("INTERVAL 1 HOUR"))
    return F.slice(F.filter(hours, lambda h: (F.hour(h) >= first_hour) & (F.hour(h) <= last_hour)), 1, n)


def zip_by_rank(left: DataFrame, right: DataFrame, left_order: list[Column], right_order: list[Column], most: int) -> DataFrame:
    """Row i of the left beside row i of the right, for i up to *most*; each side is cut to *most* rows first."""
    a = left.orderBy(*left_order).limit(most).withColumn("_i", F.row_number().over(W.orderBy(*left_order)))
    b = right.orderBy(*right_order).limit(most).withColumn("_i", F.row_number().over(W.orderBy(*right_order)))
    return a.join(b, "_i").withColumnRenamed("_i", "rank")


def assign_slots(candidates: DataFrame, slots: DataFrame, taken: DataFrame, order: list[Column], most: int = 500) -> DataFrame:
    """Candidates in order beside the open slots in order; slots: (slot), taken: (slot)."""
    free = slots.join(taken.select("slot").distinct(), "slot", "left_anti")
    return zip_by_rank(candidates, free, order, [F.col("slot")], most)


def refill_failed(assigned: DataFrame, spare: DataFrame, ok: Column, order: list[Column], most: int = 500) -> DataFrame:
    """Slots whose candidate failed beside the spare candidates in order: the second round."""
    failed = assigned.where(~ok).select("slot")
    return zip_by_rank(failed, spare, [F.col("slot")], order, most)


def retry_order(rows: DataFrame, eligible: Column, order: list[Column]) -> DataFrame:
    """Ranking in which the best remaining row is tried next, eligible ones before all others."""
    one = rows.withColumn("_one", F.lit(1).cast("long")).withColumn("_e", F.coalesce(eligible, F.lit(False)))
    return running_total(one, [F.col("_e").desc(), *order], "_one", "_at").withColumn("attempt", F.col("_at") + 1).drop("_one", "_e", "_at")


def capped_per_source(rows: DataFrame, source: str, order: list[Column], cap: int = 25, keep: str | None = None) -> DataFrame:
    """The first *cap* rows of each source; Spark cuts every partition to *cap* rows a source before the shuffle. With
    *keep* the rank stays, under that name."""
    ranked = rows.withColumn("_rn", F.row_number().over(W.partitionBy(source).orderBy(*order))).where(F.col("_rn") <= cap)
    return ranked.withColumnRenamed("_rn", keep) if keep else ranked.drop("_rn")


def split_pool(rows: DataFrame, order: list[Column], first: int) -> tuple[DataFrame, DataFrame]:
    """(the first rows in order, all others): those to be placed and the pool that stands in for what fails."""
    return rows.orderBy(*order).limit(first), rows.orderBy(*order).offset(first)


def prepended(new: Column, kept: Column, most: int) -> Column:
    """A list with *new* in front, cut to *most* items; a null list is empty."""
    return F.slice(F.array_prepend(F.coalesce(kept, F.array()), new), 1, most)


def earliest_slot(queue: DataFrame, hour: int, slot: str = "slot") -> DataFrame:
    """The earliest row of the queue whose slot lies in that UTC hour of a day."""
    return queue.where(F.hour(slot) == hour).orderBy(slot).limit(1)
