"""Mixing sources to target weights (problem 9).

The documents of each source, in a seeded shuffled order, form a line of tokens that may be passed through up to
``max_repeats`` times and is cut into blocks of equal token number. A low-discrepancy schedule of N slots decides whose
block comes next: slot k goes to the source in whose stretch of the cumulative weights the point frac((k + 1/2) * g)
falls, g the golden ratio; its rank among the slots of that source is the number of the block it takes. A document
belongs to the block in which it starts, so its number of uses is the number of passes whose block has a slot.

The total is the largest at which no source would need more than its cap: the least of max_repeats * tokens / weight over
the sources that have documents, weights taken among these, or the number of tokens wanted if that is smaller. So every
reached share differs from its target only by whole documents and blocks; the report gives both, and how many tokens each
source is short of its share of the number wanted.

Scale: token positions come from a range sort with prefix sums (a source with a third of all rows spreads over many
tasks); the schedule has a fixed number of slots, at most SLOTS, whatever the corpus; documents meet it in an equi-join
on source and block.

Defined results: sources without documents, and documents without tokens or source, take no part; a null or
non-positive weight is no target; a null max_repeats is 1; repeated rows of one document are documents of their own;
empty tables give an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.operators.ranges import running_total
from millrace.llm.tokenizer import RANKS, token_count
from millrace.session import cut

SLOTS = 20_000
GOLDEN = 0.6180339887498949
SEED = 20_240_501


def _targets(targets: DataFrame, sizes: DataFrame, wanted: int | None = None) -> DataFrame:
    """(source, weight, max_repeats, tokens, share from, share to) of the sources that can contribute; one row a target."""
    rows = targets.where("source is not null and weight > 0").select("source", "weight", F.greatest(F.coalesce("max_repeats", F.lit(1)), F.lit(1)).alias("max_repeats"))
    rows = rows.groupBy("source").agg(F.max("weight").alias("weight"), F.max("max_repeats").alias("max_repeats")).join(sizes, "source")
    every, upto = W.partitionBy(), W.orderBy("source")  # as many rows as targets
    rows = rows.withColumn("weight", F.col("weight") / F.sum("weight").over(every)).withColumn("to", F.sum("weight").over(upto))
    rows = rows.withColumn("from", F.coalesce(F.lag("to").over(upto), F.lit(0.0)))
    rows = rows.withColumn("to", F.when(F.lead("source").over(upto).isNull(), F.lit(2.0)).otherwise(F.col("to")))
    total = F.min(F.col("max_repeats") * F.col("tokens") / F.col("weight")).over(every)
    return rows.withColumn("total", F.floor(total if wanted is None else F.least(total, F.lit(float(wanted)))))


def schedule(plan: DataFrame, slots: int = SLOTS) -> DataFrame:
    """(slot, source, block): which block of which source every slot takes."""
    points = plan.sparkSession.range(slots).select(F.col("id").alias("slot"), F.expr(f"(id + 0.5D) * {GOLDEN}D").alias("x")).withColumn("x", F.col("x") - F.floor("x"))
    placed = points.join(F.broadcast(plan.select("source", "from", "to")), (F.col("x") >= F.col("from")) & (F.col("x") < F.col("to")))
    rank = F.row_number().over(W.partitionBy("source").orderBy("slot")) - 1
    return placed.select("slot", "source", rank.cast("long").alias("block"))


def _placed(documents: DataFrame, targets: DataFrame, ranks: str, slots: int, total: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(documents with their place on their source's line, plan)."""
    known = targets.where("source is not null and weight > 0").select("source").distinct()
    sized = documents.where("text is not null and text <> ''").select("doc_id", "source", "text").join(known, "source", "left_semi")
    sized = cut(sized.select("doc_id", "source", token_count(F.col("text"), ranks).alias("n")), "sized").where("n > 0")
    order: list[Column] = [F.col("source"), F.xxhash64("doc_id", F.lit(SEED)), F.col("doc_id")]
    line = running_total(sized, order, "n", "at")
    sizes = line.groupBy("source").agg(F.sum("n").alias("tokens"), F.min("at").alias("start"))
    plan = cut(_targets(targets, sizes, total).withColumn("size", F.greatest(F.col("total"), F.lit(1)) / slots), "plan")
    placed = line.join(F.broadcast(plan), "source").withColumn("at", F.col("at") - F.col("start"))  # plan: a row a target
    return placed, plan


def sequence(documents: DataFrame, targets: DataFrame, ranks: str = RANKS, slots: int = SLOTS, total: int | None = None) -> DataFrame:
    """(slot, doc_id, source, n_tokens, pass): every use of a document, in the order of the mixture (slot, pass, doc_id).
    total: how many tokens are wanted; the most that the caps allow if it isn't given or can't be reached."""
    placed, plan = _placed(documents, targets, ranks, slots, total)
    passes = placed.withColumn("pass", F.explode(F.sequence(F.lit(0), F.col("max_repeats") - 1)))
    blocks = passes.withColumn("block", F.floor((F.col("pass") * F.col("tokens") + F.col("at")) / F.col("size")))
    # no block beyond the slots a source can have at most: its weight's share and a margin
    blocks = blocks.where(F.col("block") <= F.col("weight") * slots * 1.01 + 16)
    return blocks.join(schedule(plan, slots), ["source", "block"]).select("slot", "doc_id", "source", F.col("n").alias("n_tokens"), "pass")


def mixture(documents: DataFrame, targets: DataFrame, ranks: str = RANKS, slots: int = SLOTS, total: int | None = None) -> DataFrame:
    """(doc_id, source, n_tokens, uses) of the chosen documents."""
    return sequence(documents, targets, ranks, slots, total).groupBy("doc_id", "source", "n_tokens").agg(F.count("*").alias("uses"))


def shares(mixed: DataFrame, targets: DataFrame, total: int | None = None) -> DataFrame:
    """(source, weight, documents, uses, tokens, share): what each target source reached; share of all tokens used. With
    *total* also ``short``: the tokens that a source lacks of its share of that number."""
    got = mixed.groupBy("source").agg(F.count("*").alias("documents"), F.sum("uses").alias("uses"), F.sum(F.col("uses") * F.col("n_tokens")).alias("tokens"))
    rows = targets.select("source", "weight").join(got, "source", "left").na.fill(0, ["documents", "uses", "tokens"])
    used = F.sum("tokens").over(W.partitionBy())  # as many rows as targets
    rows = rows.withColumn("share", F.when(used > 0, F.col("tokens") / used).otherwise(F.lit(0.0)))
    return rows if total is None else rows.withColumn("short", F.greatest(F.ceil(F.col("weight") * total) - F.col("tokens"), F.lit(0)))
