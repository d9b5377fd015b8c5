"""Layered removal of what is known: equi anti-joins, similarity anti-join against a bounded list, greedy clustering."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from millrace.functions.text import normalize_headline, normalized_headline

FUZZY, QUEUED, EVENT = 0.88, 0.75, 0.80
RECENT_CAP, BATCH_CAP = 200, 200


def not_seen(rows: DataFrame, seen: DataFrame, key: str) -> DataFrame:
    """Rows whose key isn't in *seen*; a null key is never seen."""
    return rows.join(seen.select(key).where(F.col(key).isNotNull()).distinct(), key, "left_anti")


def not_seen_by_any(rows: DataFrame, seen: DataFrame, row_keys: list[str], seen_keys: list[str]) -> DataFrame:
    """Rows of which no key is among any of the seen keys: a disjunctive anti-join as equi-joins on one key column."""
    keys = seen.select(F.explode(F.array(*seen_keys)).alias("_k")).where("_k is not null").distinct()
    for k in row_keys:
        rows = rows.join(keys, rows[k] == keys["_k"], "left_anti")
    return rows


def newest(rows: DataFrame, order: list[Column], cap: int) -> DataFrame:
    """The first *cap* rows in order: take-ordered on every partition, then on the result."""
    return rows.orderBy(*order).limit(cap)


class KnownHeadlines:
    """A bounded list of headlines as posting lists: overlaps with all of them come from one table lookup a trigram."""

    def __init__(self, headlines: list[tuple[str, str | None]], threshold: float):
        self.raw = [raw for _, raw in headlines]
        sets = [_gram_set(norm) for norm, _ in headlines]
        self.sizes = np.array([len(s) for s in sets], float)
        self.columns = {g: i for i, g in enumerate(sorted(set().union(*sets)))} if sets else {}
        self.table = np.zeros((len(self.columns), len(sets)), np.uint16)
        for k, s in enumerate(sets):
            self.table[[self.columns[g] for g in s], k] = 1
        self.threshold = threshold

    def first_like(self, norm: str | None) -> str | None:
        grams = _gram_set(norm or "")
        places = [self.columns[g] for g in grams if g in self.columns]
        if not places:
            return None
        common = self.table[places].sum(0)
        like = np.flatnonzero((common > 0) & (common / (self.sizes + len(grams) - common) >= self.threshold))
        return self.raw[like[0]] if len(like) else None


def _gram_set(norm: str) -> set[str]:
    padded = f" {norm} "
    return {padded[i : i + 3] for i in range(len(norm))}


def fuzzy_known(rows: DataFrame, norm: str, known: DataFrame, threshold: float = FUZZY, cap: int | None = RECENT_CAP) -> DataFrame:
    """*rows* with ``similar_to``: the ``raw`` of the first known headline of similarity >= threshold, else null.

    known: (norm, raw, pos), in order of pos; only its first *cap* rows count, so the list has a fixed bound; without a
    cap all of it counts, for lists that are short by themselves, as a queue with one row a slot is. Similarity
    with the whole list is one sum over posting rows, in Arrow batches; the alternative in built-in set functions takes an
    array intersection for every pair and was some forty times slower.
    """
    known = known.orderBy("pos") if cap is None else known.orderBy("pos").limit(cap)
    few = KnownHeadlines([(r.norm or "", r.raw) for r in known.select("norm", "raw").collect()], threshold)

    @F.arrow_udf(StringType())
    def first_like(norms: pa.Array) -> pa.Array:
        return pa.array([few.first_like(n) for n in norms.to_pylist()], pa.string())

    return rows.withColumn("similar_to", first_like(F.col(norm)))


def _better(a: dict, b: dict) -> bool:
    """Whether b takes a's place: lower priority number, then higher score, longer snippet, later date."""
    rank = lambda r: (-r["priority"], r["score"], r["length"], r["at"])
    return rank(b) > rank(a)


def greedy_clusters(rows: pd.DataFrame, threshold: float) -> list[int]:
    """Positions of the winners. A row joins the first cluster whose winner is similar, in order; else it begins one."""
    winners: list[dict] = []
    for pos, r in enumerate(rows.to_dict("records")):
        norm = normalize_headline(r["title"] or "")
        if not norm:
            continue
        padded = f" {norm} "
        me = {"priority": r["priority"], "score": r["score"], "length": r["length"], "at": r["at"], "pos": pos, "set": {padded[i : i + 3] for i in range(len(norm))}}
        for i, w in enumerate(winners):
            if min(len(me["set"]), len(w["set"])) < threshold * max(len(me["set"]), len(w["set"])):
                continue  # the sizes alone exclude it
            common = len(me["set"] & w["set"])
            if common >= threshold * (len(me["set"]) + len(w["set"]) - common):
                if _better(w, me):
                    winners[i] = me
                break
        else:
            winners.append(me)
    return [w["pos"] for w in winners]


def cluster_batch(rows: DataFrame, id_col: str, order: list[Column], threshold: float = EVENT, cap: int | None = BATCH_CAP) -> DataFrame:
    """Ids of the winners among the first *cap* rows in order, among all rows without a cap. The greedy pass depends on
    the order of rows, so the batch goes to one task; rows: (id, title, priority, score, snippet, pub_ts)."""
    few = (rows if cap is None else rows.orderBy(*order).limit(cap)).select(
        F.col(id_col).alias("id"), "title", F.coalesce("priority", F.lit(9)).alias("priority"), F.coalesce("score", F.lit(0)).alias("score"),
        F.length(F.coalesce("snippet", F.lit(""))).alias("length"), F.coalesce(F.unix_millis(F.col("pub_ts").cast("timestamp")), F.lit(0)).alias("at"),
    )
    numbered = few.withColumn("ord", F.row_number().over(W.orderBy(*[F.desc("at"), F.col("id")])))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(batches), ignore_index=True) if batches else pd.DataFrame()
        pdf = pdf.sort_values("ord", ignore_index=True)
        yield pdf.loc[greedy_clusters(pdf, threshold), ["id", "ord"]]

    return numbered.coalesce(1).mapInPandas(run, "id long, ord int")


def headline_keys(rows: DataFrame, title: str = "title") -> DataFrame:
    return rows.withColumn("norm", normalized_headline(F.col(title)))
