"""Reading level of each document (problem 10).

Running prose is taken from the text: code, tables, links and titles (lines that don't end like a sentence) are left
out. From its words, sentences and syllables come classic grade estimates that weigh both sentence length and word
difficulty; syllables are counted by hyphenation-style patterns (syllables). A sentence that is wrapped over several lines
is put together first. A document's grade is the median of the estimates, and two thresholds on it, fitted to editors' labels, give the level. The fit uses at most FIT_ROWS labelled
documents (by hash of their id), a documented bound; everything else covers all rows.

Python is needed for the text rules; texts cross once, in Arrow batches, and nothing is shuffled but the labels.
Word statistics are cached, so a word is analysed once a worker.

Defined results: null, empty and blank texts, and texts without any sentence, have no grade and get no level; texts of any length are read whole; repeated rows each get their level; a document rated more than once counts with
each rating; without labels the default thresholds hold.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from functools import lru_cache
from operator import mul

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType

from millrace.llm.syllables import syllables
from millrace.session import cut

FIT_ROWS = 20_000
DEFAULT_THRESHOLDS = (7.5, 14.8)

#: Least length of a line that may be wrapped.
WRAPPED = 40
_TAG = re.compile(r"<[/!A-Za-z][^<>\n]*>")
_LINK = re.compile(r"(?:https?://|www\.)\S+")
_CODE_MARK = re.compile(r"[{}|\t\\=<>;]|\w\(|::|->|\w_\w|^(?:#|//|\$ |>>> |@|\* )")
_LINE_END = re.compile(r"[.!?…][\"'”’»)\]]*$")
_END = re.compile(r"([.!?]+)[\"'”’»)\]]*$")
_MARKS = frozenset("{}|\t\\=<>;(_#/$@*")
_INITIALS = re.compile(r"(?:\w\.)+\w$")
_WORD = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*")
_ABBREVIATIONS = frozenset("e.g i.e approx etc vs cf dr mr mrs ms no st fig vol inc ltd co corp dept est prof jr sr".split())


def _joined(lines: list[str]) -> list[str]:
    """Lines with wrapped ones put together: a line that doesn't end like a sentence, neither short nor with a mark of code,
    goes on in the next one if that begins with a small letter and has none either."""
    out: list[str] = []
    for line in lines:
        bare = line.strip()
        before = out[-1] if out else ""
        if bare[:1].islower() and len(before) >= WRAPPED and not _LINE_END.search(before, max(0, len(before) - 8)) and not _like_code(bare) and not _like_code(before):
            out[-1] = f"{before} {bare}"
        else:
            out.append(bare)
    return out


def _like_code(line: str) -> bool:
    return _has_mark(line) and _CODE_MARK.search(line) is not None and not _reads_as_prose(line)


def prose(text: str) -> list[str]:
    """The lines of running prose."""
    kept = []
    fenced = False
    for line in _joined(text.split("\n")):
        bare = line.strip()
        if bare.startswith("```"):
            fenced = not fenced
            continue
        if fenced or not bare:
            continue
        if "<" in bare:
            bare = _TAG.sub(" ", bare).strip()
        if ":/" in bare or "www." in bare:
            bare = _LINK.sub(" ", bare).strip()
        if _LINE_END.search(bare, max(0, len(bare) - 8)) and not _like_code(bare):
            kept.append(bare)
    return kept


def _has_mark(line: str) -> bool:
    """Whether a line has any character that code marks are made of; most lines of prose have none."""
    return not _MARKS.isdisjoint(line) or "::" in line


def _reads_as_prose(line: str) -> bool:
    """Whether a line with a character of code in it is a sentence all the same: mostly words, few such characters."""
    words = _WORD.findall(line)
    return len(words) >= 5 and sum(map(len, words)) >= 0.7 * len(line)


@lru_cache(maxsize=200_000)
def _token(token: str) -> tuple[int, int, int, int, int, int]:
    """What a token between blanks adds: (ends a sentence, words, syllables, long words, letters, words over 6 letters)."""
    end = _END.search(token)
    if end and end[1] == ".":
        before = token[: end.start()]
        if before.lower().lstrip("(\"“'") in _ABBREVIATIONS or ("." in before and _INITIALS.search(before)):
            end = None
    words = _WORD.findall(token)
    counts, letters = [syllables(w) for w in words], [sum(map(str.isalpha, w)) for w in words]
    return int(end is not None), len(words), sum(counts), sum(c >= 3 for c in counts), sum(letters), sum(n > 6 for n in letters)


def statistics(text: str | None) -> list[float] | None:
    """[sentences, words, syllables, long words, letters, words over 6 letters] of the running prose, or None."""
    if text is None:
        return None
    counted: Counter[str] = Counter()
    open_ends = 0
    for line in prose(text):
        tokens = line.split()
        counted.update(tokens)
        open_ends += not _token(tokens[-1])[0]  # a line of prose ends a sentence
    if not counted:
        return None
    times = list(counted.values())
    sentences, *rest = (sum(map(mul, times, column)) for column in zip(*map(_token, counted)))
    return [float(sentences + open_ends), *map(float, rest)] if rest[0] else None


def grades(st: list[float]) -> list[float]:
    """Grade estimates: Flesch-Kincaid, Gunning Fog and the automated readability index."""
    s, w, syl, hard, letters, _ = st
    return [
        0.39 * w / s + 11.8 * syl / w - 15.59,
        0.4 * (w / s + 100 * hard / w),
        4.71 * letters / w + 0.5 * w / s - 21.43,
    ]


def all_grades(st: list[float]) -> dict[str, float]:
    """Every estimate, for profiles: those of :func:`grades`, and four more that follow one side of difficulty only."""
    s, w, syl, hard, letters, big = st
    kincaid, fog, ari = grades(st)
    return {
        "flesch_kincaid": kincaid,
        "fog": fog,
        "ari": ari,
        "smog": 1.043 * math.sqrt(30 * hard / s) + 3.1291,
        "coleman_liau": 5.88 * letters / w - 29.6 * s / w - 15.8,
        "flesch": (100 - (206.835 - 1.015 * w / s - 84.6 * syl / w)) / 10 + 4,
        "lix": (w / s + 100 * big / w) / 4,
    }


def median_grade(text: str | None) -> float | None:
    st = statistics(text)
    return None if st is None else float(np.median(grades(st)))


@F.arrow_udf(DoubleType())
def _grade(texts: pa.Array) -> pa.Array:
    return pa.array([median_grade(t) for t in texts.to_pylist()], pa.float64())


def reading_grade(text: Column) -> Column:
    return _grade(text)


def fit_thresholds(grade: np.ndarray, level: np.ndarray) -> tuple[float, float]:
    """The two thresholds that put most labelled rows right; among equals the middle ones."""
    if len(grade) == 0:
        return DEFAULT_THRESHOLDS
    order = np.sort(np.unique(grade))
    mids = np.r_[order[0] - 1, (order[1:] + order[:-1]) / 2, order[-1] + 1]
    mids = mids[np.unique(np.linspace(0, len(mids) - 1, 600).astype(int))]
    below = {k: np.searchsorted(np.sort(grade[level == k]), mids, "right") for k in (1, 2, 3)}
    right = below[1][:, None] + (below[2][None, :] - below[2][:, None]) + (np.sum(level == 3) - below[3])[None, :]
    right = np.where(np.arange(len(mids))[:, None] <= np.arange(len(mids))[None, :], right, -1)
    i, j = np.nonzero(right == right.max())
    k = len(i) // 2
    return float(mids[i[k]]), float(mids[j[k]])


def graded(documents: DataFrame) -> DataFrame:
    """(doc_id, grade) of the English prose documents that have a grade."""
    wanted = (F.col("lang") == "en") & ~F.col("doc_type").isin("post", "changelog") & F.col("doc_type").isNotNull() & F.col("text").isNotNull()
    return documents.where(wanted).select("doc_id", reading_grade(F.col("text")).alias("grade")).where("grade is not null")


def reading_levels(documents: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """(doc_id, level) of each English prose document."""
    rows = cut(graded(documents), "grades")
    sample = labels.where("level in (1, 2, 3)").orderBy(F.xxhash64("doc_id", "rater"), "doc_id", "rater").limit(fit_rows)
    known = sample.join(rows.dropDuplicates(["doc_id"]), "doc_id").select("grade", "level").toPandas()  # fit_rows at most
    low, high = fit_thresholds(known["grade"].to_numpy(float), known["level"].to_numpy(int))
    level = F.when(F.col("grade") <= low, 1).when(F.col("grade") <= high, 2).otherwise(3).cast(IntegerType())
    return rows.select("doc_id", level.alias("level"))
