"""Row predicates: freshness, word lists, required fields, distinct hits without overlap, failure counts."""

from __future__ import annotations

import importlib.util
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from millrace import lexicon
from millrace.functions.bind import let


def texts(words: list[str]) -> Column:
    return F.array(*[F.lit(w) for w in words]) if words else F.array().cast("array<string>")


def is_fresh(published: Column, now: Column, hours: int = lexicon.FRESH_HOURS) -> Column:
    """At most *hours* old; dates to come pass; a null date doesn't."""
    return F.coalesce(F.unix_micros(now.cast("timestamp")) - F.unix_micros(published.cast("timestamp")) <= hours * 3_600_000_000, F.lit(False))


def contains_any(text: Column, words: list[str]) -> Column:
    """Whether the text, in lower case, has one of the words anywhere; a null text has none."""
    return F.coalesce(let(F.lower(text), lambda low: F.exists(texts(words), lambda w: F.contains(low, w))), F.lit(False))


def hits(text: Column, words: list[str]) -> Column:
    """How many of the words occur anywhere in the text in lower case."""
    return let(F.lower(text), lambda low: F.size(F.filter(texts(words), lambda w: F.contains(low, w))))


@lru_cache(maxsize=8)
def _automaton(patterns: tuple[tuple[str, tuple[int, ...]], ...]):
    """Finds (number of the pattern, lists it is in); built once in each worker."""
    import ahocorasick

    found = ahocorasick.Automaton()
    for n, (w, where) in enumerate(patterns):
        found.add_word(w, (n, where))
    found.make_automaton()
    return found


def list_hits(text: Column, lists: dict[str, list[str]]) -> Column:
    """STRUCT of counts by list: how many of its words occur anywhere in the text in lower case; null texts have none.

    With many words one pass of a multi-pattern automaton over Arrow batches is several times faster than a search for each
    word in built-in functions, which is what happens where the automaton's library is missing."""
    if importlib.util.find_spec("ahocorasick") is None:
        return F.struct(*[F.coalesce(hits(text, words), F.lit(0)).alias(k) for k, words in lists.items()])
    names, of = list(lists), {}
    for i, words in enumerate(lists.values()):
        for w in dict.fromkeys(words):
            of.setdefault(w, []).append(i)

    patterns = tuple((w, tuple(where)) for w, where in of.items())

    @F.arrow_udf(StructType([StructField(k, IntegerType()) for k in names]))
    def count(texts: pa.Array) -> pa.Array:
        search, columns = _automaton(patterns).iter, [[0] * len(texts) for _ in names]
        for row, t in enumerate(texts.to_pylist()):
            if t:
                for where in dict(v for _, v in search(t)).values():
                    for i in where:
                        columns[i][row] += 1
        return pa.StructArray.from_arrays([pa.array(c, pa.int32()) for c in columns], names=names)

    return count(F.lower(text))


def separate_hits(text: Column, words: list[str]) -> Column:
    """Words, in list order, whose first occurrence doesn't overlap that of a word counted before."""
    def places(low: Column) -> Column:
        at = F.transform(texts(words), lambda w: F.struct(F.instr(low, w).alias("s"), F.length(w).alias("n")))
        return F.filter(at, lambda r: r["s"] > 0)

    kept = F.aggregate(
        let(F.lower(text), places),
        F.array().cast("array<struct<s:int,n:int>>"),
        lambda acc, r: F.when(F.exists(acc, lambda k: (r["s"] < k["s"] + k["n"]) & (k["s"] < r["s"] + r["n"])), acc).otherwise(F.array_append(acc, r)),
    )
    return F.coalesce(F.size(kept), F.lit(0))


def has_required(title: Column, link: Column) -> Column:
    return F.coalesce((title != "") & (link != ""), F.lit(False))


def below_failures(rows: DataFrame, failures: DataFrame, key: str, most: int = 3) -> DataFrame:
    """Rows whose key failed fewer than *most* times; failures: (key, n). Null keys never failed."""
    counts = failures.groupBy(key).agg(F.sum("n").alias("_n"))
    return rows.join(counts, key, "left").where(F.coalesce("_n", F.lit(0)) < most).drop("_n")
