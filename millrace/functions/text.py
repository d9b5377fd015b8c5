"""Headline normalisation, trigrams and set similarity."""

from __future__ import annotations

import re
import unicodedata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# --- fixed values: words that a normalised headline drops --------------------------------------------
STOP_WORDS = [
    "a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "has", "have", "he", "in", "is", "it", "its",
    "of", "on", "that", "the", "to", "was", "were", "will", "with", "this", "these", "those", "but", "or", "not",
    "no", "can", "could", "should", "would", "may", "might", "must", "do", "does", "did", "i", "you", "we", "they",
    "them", "their",
]
# --- end of fixed values ----------------------------------------------------------------------------

_STOP = frozenset(STOP_WORDS)
_MARKS = re.compile("[\u0300-\u036f]+")
_OTHER = re.compile("[^a-z0-9]+")


def normalize_headline(title: str) -> str:
    """Lower case, compatibility decomposition without accents, only [a-z0-9] words, stop words dropped."""
    low = title.lower()
    if not low.isascii():
        low = _MARKS.sub("", unicodedata.normalize("NFKD", low))
    return " ".join(w for w in _OTHER.sub(" ", low).split(" ") if w and w not in _STOP)


@F.arrow_udf(StringType())
def _normalized(titles: pa.Array) -> pa.Array:
    return pa.array([None if t is None else normalize_headline(t) for t in titles.to_pylist()], pa.string())


def normalized_headline(title: Column) -> Column:
    """Normalised headline; a null title has an empty one. NFKD has no built-in, hence an Arrow-batched function."""
    return F.coalesce(_normalized(title), F.lit(""))


def headline_hash(norm: Column) -> Column:
    return F.sha1(norm)


def trigrams(text: Column) -> Column:
    """Distinct character trigrams of the text padded with one blank on either side; empty for an empty text."""
    padded = F.concat(F.lit(" "), text, F.lit(" "))
    grams = F.transform(F.sequence(F.lit(1), F.length(text)), lambda i: F.substr(padded, i, F.lit(3)))
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.array_distinct(grams))


def jaccard(a: Column, b: Column) -> Column:
    """|a ∩ b| / |a ∪ b| of two arrays without repeats; two empty sets are alike (1), one empty set is like none (0)."""
    both = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - both
    return F.when(union == 0, F.lit(1.0)).otherwise(both / union)


def source_key(name: Column) -> Column:
    """Name of a source without differences in letter case and white space (no-break spaces too)."""
    squeezed = F.trim(F.regexp_replace(name, r"(?U)[\s\x{00A0}\x{202F}\x{FEFF}]+", " "))
    return F.lower(squeezed)
