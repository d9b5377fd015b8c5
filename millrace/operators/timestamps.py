"""Mixed timestamp formats and zones to one UTC instant.

Method: every accepted form is one alternative of a single compiled expression with named groups. A text is matched
once, its parts are read from the groups, the calendar ranges are checked, and the instant is put together by
integer day arithmetic. JVM side: texts already canonical are filtered before any of them reaches Python, and only the
three columns that matter (text, zone, day/month order) cross over, in Arrow batches. There is no shuffle.

Defined results
---------------
* null, empty or blank text, words such as "yesterday", dates that don't exist: no instant (null)
* no zone in the text: the zone given beside it; where that is null or unknown: null
* a local time that occurs twice: the earlier instant; one that never occurs: moved on by the length of the gap
* an abbreviation is its fixed offset all year; a wrong weekday is ignored; two-digit years are 20xx
* numeric day and month: by the order given ("mdy" or "dmy"); a null order: null, unless both readings agree
* parts finer than a millisecond are cut off (towards the past, also before 1970)
* texts of any length are matched whole; repeated rows and ties each get their own result
"""

from __future__ import annotations

import re
from datetime import datetime
from functools import lru_cache
from zoneinfo import ZoneInfo

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from millrace.functions.text import source_key

#: The form that needs no work.
CANONICAL = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}\.[0-9]{3}Z\z"

#: Offsets in minutes.
ABBREVIATIONS = {
    "z": 0, "ut": 0, "utc": 0, "gmt": 0, "wet": 0, "west": 60, "bst": 60, "ist": 330, "cet": 60, "cest": 120,
    "mez": 60, "mesz": 120, "eet": 120, "eest": 180, "msk": 180, "ict": 420, "hkt": 480, "sgt": 480, "awst": 480,
    "jst": 540, "kst": 540, "acst": 570, "acdt": 630, "aest": 600, "aedt": 660, "nzst": 720, "nzdt": 780,
    "brt": -180, "art": -180, "ast": -240, "adt": -180, "est": -300, "edt": -240, "cst": -360, "cdt": -300,
    "mst": -420, "mdt": -360, "pst": -480, "pdt": -420, "akst": -540, "akdt": -480, "hst": -600,
}

_MONTH_NAMES = [
    "january jan janvier janv januar jänner enero ene janeiro",
    "february feb février fevrier févr fev februar febrero fevereiro",
    "march mar mars märz maerz mär mrz marzo março marco",
    "april apr avril avr abril abr",
    "may mai mayo maio",
    "june jun juin juni junio junho",
    "july jul juillet juil juli julio julho",
    "august aug août aout agosto ago",
    "september sep sept septembre septiembre setembro set",
    "october oct octobre oktober okt octubre outubro out",
    "november nov novembre noviembre novembro",
    "december dec décembre decembre déc dezember dez diciembre dic dezembro",
]
MONTHS = {name: i for i, names in enumerate(_MONTH_NAMES, 1) for name in names.split()}


def _grammar() -> re.Pattern[str]:
    def form(tag: str, body: str) -> str:
        return f"(?P<{tag}>" + re.sub(r"<(\w+):", lambda m: f"(?P<{tag}_{m[1]}>", body) + ")"

    month = "|".join(sorted(map(re.escape, MONTHS), key=len, reverse=True))
    clock = r"<H:\d{1,2}):<M:\d{2})(?::<S:\d{2})(?:[.,]<f:\d{1,9}))?)?"
    zone = r"(?:\s*(?:(?:gmt|utc)?<off:[+-]\d{2}(?::?\d{2})?)|<abbr:[a-z]{1,5})|\[?<area:[a-z]+(?:/[a-z0-9_+-]+)+|utc)\]?))?"
    forms = [
        form("iso", r"<y:\d{4})(?P<iso_sep>[-/])<m:\d{1,2})(?P=iso_sep)<d:\d{1,2})(?:(?:t|\s+)" + clock + zone + ")?"),
        form("dense", r"<y:\d{4})<m:\d{2})<d:\d{2})(?:t<H:\d{2})<M:\d{2})(?:<S:\d{2})(?:[.,]<f:\d{1,9}))?)?" + zone + ")?"),
        form("epoch", r"<n:\d{9,10}(?:\.\d{1,9})?|\d{12,13}|\d{15,16}|\d{18,19})"),
        form("day", r"(?:[^\W\d_]+\.?,?\s+)?<d:\d{1,2})\.?\s+(?:de\s+)?<name:" + month + r")\.?,?\s+(?:de\s+)?<y:\d{4}|\d{2})(?:,?\s+(?:à\s+|at\s+|um\s+|a\s+las\s+|às\s+)?" + clock + r"(?:\s*uhr)?(?:\s*<ap:[ap]\.?m)\.?)?" + zone + ")?"),
        form("name", r"(?:[^\W\d_]+\.?,?\s+)?<name:" + month + r")\.?\s+<d:\d{1,2})(?:st|nd|rd|th)?,?\s+<y:\d{4})(?:,?\s+(?:at\s+)?" + clock + r"(?:\s*<ap:[ap]\.?m)\.?)?" + zone + ")?"),
        form("num", r"<a:\d{1,2})(?P<num_sep>[./-])<b:\d{1,2})(?P=num_sep)<y:\d{4}|\d{2})(?:,?\s+" + clock + r"(?:\s*<ap:[ap]\.?m)\.?)?(?:\s*uhr)?" + zone + ")?"),
    ]
    return re.compile("|".join(forms), re.I)


_GRAMMAR = _grammar()
_SECOND = 1000
_DAY = 86_400 * _SECOND


def days_from_civil(y: int, m: int, d: int) -> int:
    """Days from 1970-01-01 in the proleptic Gregorian calendar, in integers only."""
    y -= m <= 2
    era = y // 400
    yoe = y - era * 400
    doy = (153 * (m + (-3 if m > 2 else 9)) + 2) // 5 + d - 1
    return era * 146_097 + yoe * 365 + yoe // 4 - yoe // 100 + doy - 719_468


def _month_length(y: int, m: int) -> int:
    return 31 - (m - 1) % 7 % 2 if m != 2 else 29 if y % 4 == 0 and (y % 100 != 0 or y % 400 == 0) else 28


@lru_cache(maxsize=1024)
def _area(name: str) -> ZoneInfo | None:
    try:
        return ZoneInfo("/".join("_".join(w if w in ("of", "es") else w[:1].upper() + w[1:] for w in p.split("_")) for p in name.split("/")) if name.islower() else name)
    except Exception:  # no such zone: KeyError, ValueError or an OS error, by the platform
        return None


def _epoch_ms(text: str) -> int:
    whole, _, part = text.partition(".")
    if part:
        return int(whole) * _SECOND + int((part + "00")[:3])
    scale = 0 if len(whole) <= 10 else 3 if len(whole) <= 13 else 6 if len(whole) <= 16 else 9
    return int(whole) * _SECOND if scale == 0 else int(whole) // 10 ** (scale - 3)


def parse_instant(text: str | None, zone: str | None, order: str | None) -> int | None:
    """Milliseconds since 1970-01-01 UTC, or None where the text stands for no instant."""
    if text is None:
        return None
    found = _GRAMMAR.fullmatch(text.strip())
    if found is None:
        return None
    tag = found.lastgroup
    got = {k.partition("_")[2]: v for k, v in found.groupdict().items() if v is not None and k.startswith(tag + "_")}
    if tag == "epoch":
        return _epoch_ms(got["n"])
    if tag == "num":
        a, b = int(got["a"]), int(got["b"])
        if order not in ("mdy", "dmy") and a != b:
            return None
        month, day = (a, b) if order == "mdy" else (b, a)
    else:
        month, day = MONTHS[got["name"].lower()] if "name" in got else int(got["m"]), int(got["d"])
    year = int(got["y"]) + (2000 if len(got["y"]) == 2 else 0)
    hour, minute, second = int(got.get("H", 0)), int(got.get("M", 0)), int(got.get("S") or 0)
    if half := got.get("ap", "")[:1].lower():
        if not 1 <= hour <= 12:
            return None
        hour = hour % 12 + (12 if half == "p" else 0)
    if not (year >= 1 and 1 <= month <= 12 and 1 <= day <= _month_length(year, month) and hour < 24 and minute < 60 and second < 60):
        return None
    ms = days_from_civil(year, month, day) * _DAY + (hour * 3600 + minute * 60 + second) * _SECOND + int((got.get("f", "") + "000")[:3])
    if "off" in got:
        digits = got["off"][1:].replace(":", "").ljust(4, "0")
        if int(digits[:2]) > 18 or int(digits[2:]) > 59:
            return None
        off = (int(digits[:2]) * 60 + int(digits[2:])) * (-1 if got["off"][0] == "-" else 1)
    elif "abbr" in got:
        off = ABBREVIATIONS.get(got["abbr"].lower())
    else:
        area = _area(got["area"] if "area" in got else zone or "")
        if area is None:
            return None
        # fold=0: the earlier of two, and the offset before a gap
        off = datetime(year, month, day, hour, minute, second, tzinfo=area).utcoffset()
        return ms - round(off.total_seconds() * 1000) if off is not None else None
    return None if off is None else ms - off * 60 * _SECOND


@F.arrow_udf(LongType())
def _instants(text: pa.Array, zone: pa.Array, order: pa.Array) -> pa.Array:
    return pa.array(map(parse_instant, text.to_pylist(), zone.to_pylist(), order.to_pylist()), pa.int64())


def instant_ms(text: Column, zone: Column, order: Column) -> Column:
    """UTC milliseconds of a timestamp text, or null."""
    return _instants(text, zone, order)


def is_canonical(text: Column) -> Column:
    return text.rlike(CANONICAL)


def with_registry(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """*rows* with ``_s``, the zone and the day/month order (feed_tz, date_order) of their source, names compared by key."""
    registry = sources.groupBy(source_key(F.col("name")).alias("_key")).agg(F.min(F.struct("feed_tz", "date_order")).alias("_s"))
    return rows.withColumn("_key", source_key(F.col("source"))).join(registry.where("_key is not null"), "_key", "left").drop("_key")


def normalize_feed_times(articles: DataFrame, sources: DataFrame) -> DataFrame:
    """(record_id, utc_ms) of each article whose ``pub_date`` isn't canonical and stands for an instant."""
    rows = articles.where(~is_canonical(F.col("pub_date"))).select(F.col("article_id").alias("record_id"), "pub_date", "source")
    joined = with_registry(rows, sources)
    return joined.select("record_id", instant_ms(F.col("pub_date"), F.col("_s.feed_tz"), F.col("_s.date_order")).alias("utc_ms")).where("utc_ms is not null")


def normalize_posted_times(posted: DataFrame, order: str = "dmy") -> DataFrame:
    """(record_id, utc_ms) of each posted entry whose ``posted_at`` isn't canonical and stands for an instant."""
    rows = posted.where(~is_canonical(F.col("posted_at"))).select(F.col("entry_id").alias("record_id"), "posted_at", "tz")
    return rows.select("record_id", instant_ms(F.col("posted_at"), F.col("tz"), F.lit(order)).alias("utc_ms")).where("utc_ms is not null")
