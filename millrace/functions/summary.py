"""Tolerant reading of JSON summaries, in two layouts, and clean-up of their lists."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.lexicon import BULLET_MARKERS



def without_fences(text: Column) -> Column:
    """Text without the code fence around it."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.trim(text), r"^```[a-zA-Z]*\s*", ""), r"\s*```$", ""))


def clean_bullets(items: Column, most: int = 3, chars: int = 220) -> Column:
    """Items without leading markers; blank ones dropped, long ones cut with an ellipsis, at most *most*."""
    bare = F.transform(items, lambda x: F.trim(F.regexp_replace(x, BULLET_MARKERS, "")))
    kept = F.filter(bare, lambda x: x.isNotNull() & (x != ""))
    return F.slice(F.transform(kept, lambda x: F.when(F.length(x) > chars, F.concat(F.left(x, F.lit(chars - 1)), F.lit("…"))).otherwise(x)), 1, most)


def _distinct_ignoring_case(items: Column) -> Column:
    return F.aggregate(items, F.array().cast("array<string>"), lambda acc, x: F.when(F.exists(acc, lambda a: F.lower(a) == F.lower(x)), acc).otherwise(F.array_append(acc, x)))


def clean_tags(items: Column, most: int = 8, chars: int = 30) -> Column:
    """Tags of letters, digits and underscores only, without mark and blanks, each once whatever its case."""
    bare = F.transform(items, lambda x: F.regexp_replace(F.regexp_replace(F.regexp_replace(x, r"(?U)^\s+|\s+$", ""), "^#+", ""), r"(?U)\s+", ""))
    good = F.filter(bare, lambda x: x.isNotNull() & (F.length(x) <= chars) & x.rlike("^[A-Za-z0-9_]+$"))
    return F.slice(_distinct_ignoring_case(good), 1, most)


def tags_with_brand(items: Column, brand: str, most: int = 5) -> Column:
    """At most *most* tags, the brand last unless it is there already; no tags, no brand."""
    few = F.slice(_distinct_ignoring_case(F.filter(items, lambda x: x != "")), 1, most - 1)
    has = F.exists(few, lambda x: F.lower(x) == brand.lower())
    return F.when(F.size(few) == 0, few).when(has, few).otherwise(F.array_append(few, F.lit(brand)))


def _text(v: Column, path: str) -> Column:
    """The string at a path of a variant; null where it is missing or no string."""
    kind = F.schema_of_variant(F.try_variant_get(v, path, "variant"))
    return F.when(kind == "STRING", F.trim(F.try_variant_get(v, path, "string")))


def _strings(v: Column, path: str) -> Column:
    """The strings of the array at a path; null where there is no array."""
    items = F.try_variant_get(v, path, "array<variant>")
    return F.transform(F.filter(items, lambda x: F.schema_of_variant(x) == "STRING"), lambda x: F.try_variant_get(x, "$", "string"))


def parsed_summary(raw: Column) -> Column:
    """STRUCT<title, bullets, why, brief, tags> of a summary in either layout, or null.

    New layout: title, bullets, whyItMatters and, if present, enTldr and hashtags. Old layout: title, body, takeaway; its
    first three sentences are the bullets."""
    v = F.try_parse_json(without_fences(raw))
    title = _text(v, "$.title")
    bullets, why = clean_bullets(_strings(v, "$.bullets")), _text(v, "$.whyItMatters")
    brief = F.left(F.coalesce(_text(v, "$.enTldr"), F.lit("")), F.lit(250))
    tags = F.coalesce(clean_tags(_strings(v, "$.hashtags")), F.array().cast("array<string>"))
    sentences = F.filter(F.transform(F.split(_text(v, "$.body"), r"(?<=[.!?])\s+"), lambda x: F.trim(x)), lambda x: x != "")
    old_bullets, takeaway = clean_bullets(F.slice(sentences, 1, 3)), _text(v, "$.takeaway")

    def row(b: Column, w: Column, e: Column, t: Column) -> Column:
        return F.struct(title.alias("title"), b.alias("bullets"), w.alias("why"), e.alias("brief"), t.alias("tags"))

    new = F.try_variant_get(v, "$.bullets", "array<variant>").isNotNull() & why.isNotNull()
    whole = lambda b, w: (title != "") & (F.size(b) > 0) & (w != "")
    first = F.when(whole(bullets, why), row(bullets, why, brief, tags))
    second = F.when(whole(old_bullets, takeaway), row(old_bullets, takeaway, F.lit(""), F.array().cast("array<string>")))
    return F.when(new, first).otherwise(second)


def http_outcome(status: Column) -> Column:
    """'ok', 'fatal' (asking again can't help) or 'retry'."""
    return F.when(status.between(200, 299), "ok").when(status.isin(401, 403, 408, 429), "fatal").when(status.between(400, 499), "fatal").otherwise("retry")


def backoff_ms(attempt: Column, base: int = 2000) -> Column:
    return (F.lit(base) * F.pow(F.lit(2), attempt)).cast("long")
