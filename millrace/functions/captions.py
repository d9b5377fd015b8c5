"""Texts for an outside channel, within a budget of UTF-16 units: bullets, captions with optional sections, short labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.html import cut_to_budget, escaped, utf16_length

GAP, LEAST_BULLETS, MOST_BULLETS = 2, 30, 3
HTTP_LABELS = {401: "bad key", 403: "blocked", 408: "timeout", 429: "quota", 500: "server error", 502: "bad gateway", 503: "overloaded", 504: "gateway timeout"}


def rendered_bullets(items: Column, budget: int | Column, most: int = MOST_BULLETS, prefix: str = "• ") -> Column:
    """As many of the first *most* items as fit, a line each; the last one may be cut if more than ten units are left for it.
    Empty where not even one fits or the budget is under ten."""
    room, n = F.lit(budget) if isinstance(budget, int) else budget, F.size(F.coalesce(items, F.array()))
    lines = F.transform(items, lambda x: F.concat(F.lit(prefix), escaped(x)))

    def of(k: int) -> Column:
        """The text of exactly k bullets; null where they don't fit."""
        before = F.slice(lines, 1, k - 1)
        used = F.aggregate(before, F.lit(0), lambda acc, x: acc + utf16_length(x) + 1)
        left = room - used
        last = F.get(items, F.lit(k - 1))
        whole = F.get(lines, F.lit(k - 1))
        cut = F.concat(F.lit(prefix), cut_to_budget(last, left - len(prefix)))
        line = F.when(utf16_length(whole) <= left, whole).when(left > len(prefix) + 10, cut)
        return F.when((n >= k) & (used <= room) & line.isNotNull(), F.array_join(F.concat(before, F.array(line)), "\n"))

    found = F.lit("")
    for k in range(1, most + 1):
        found = F.coalesce(of(k), found)
    return F.when(room < 10, F.lit("")).otherwise(found)


def signature(name: str, handle: str | None = None, mark: str = "—") -> str:
    """The line with which every caption ends; *handle* without its @ becomes a link."""
    brand = f"{mark} <b>{name}</b>"
    return brand if not handle else f'{brand} · <a href="https://t.me/{handle}">@{handle}</a>'


def captioned(rows: DataFrame, limit: int, sign: str, why_label: str = "Why it matters:", brief_label: str = "In short:") -> DataFrame:
    """*rows* (title, bullets, why, brief, tags, link) with ``caption``: sections with a blank line between them. Where the
    bullets would get fewer than LEAST_BULLETS units, tags are left out, then the brief, then the link's text is cut."""
    esc = lambda c, n: escaped(F.left(F.coalesce(F.col(c), F.lit("")), F.lit(n)))
    href = escaped(F.coalesce("link", F.lit("")), attribute=True)
    rows = rows.withColumn("_title", F.concat(F.lit("<b>"), esc("title", 150), F.lit("</b>")))
    rows = rows.withColumn("_why", F.concat(F.lit(f"<b>{why_label}</b> "), esc("why", 320))).withColumn("_href", href).withColumn("_text", escaped(F.coalesce("link", F.lit(""))))
    rows = rows.withColumn("_brief", F.when(F.trim(F.coalesce("brief", F.lit(""))) != "", F.concat(F.lit(f"<i>{brief_label}</i> "), escaped(F.left(F.trim("brief"), F.lit(200))))).otherwise(""))
    rows = rows.withColumn("_tags", F.array_join(F.transform(F.coalesce("tags", F.array().cast("array<string>")), lambda t: F.concat(F.lit("#"), t)), " "))
    link = lambda text: F.concat(F.lit('<a href="'), F.col("_href"), F.lit('">'), text, F.lit("</a>"))
    size = {k: utf16_length(F.col(k)) for k in ("_title", "_why", "_href", "_text", "_brief", "_tags")}
    around = len('<a href=""></a>')
    fixed = size["_title"] + size["_why"] + size["_href"] + around + F.lit(utf16_units(sign))
    rows = rows.withColumn("_fixed", fixed)
    optional = lambda k: F.when(F.col(k) != "", size[k] + GAP).otherwise(0)
    room = limit - F.col("_fixed") - 4 * GAP - size["_text"]
    rows = rows.withColumn("_all", room - optional("_brief") - optional("_tags")).withColumn("_no_tags", room - optional("_brief")).withColumn("_bare", room)
    level = F.when(F.col("_all") >= LEAST_BULLETS, 0).when(F.col("_no_tags") >= LEAST_BULLETS, 1).otherwise(2)
    rows = rows.withColumn("_level", level).withColumn("_link_room", limit - F.col("_fixed") - 4 * GAP - 30)
    cut = (F.col("_level") == 2) & (F.col("_bare") < LEAST_BULLETS) & (F.col("_link_room") > 20) & (size["_text"] > F.col("_link_room"))
    rows = rows.withColumn("_shown", F.when(cut, F.concat(F.left("_text", F.col("_link_room") - 3), F.lit("..."))).otherwise(F.col("_text")))
    budget = F.when(F.col("_level") == 0, F.col("_all")).when(F.col("_level") == 1, F.col("_no_tags")).otherwise(F.col("_bare") + size["_text"] - utf16_length(F.col("_shown")))
    rows = rows.withColumn("_budget", budget).withColumn("_bullets", rendered_bullets(F.col("bullets"), F.col("_budget")))
    some = lambda c, when: F.when(when & (c != ""), c)
    parts = [F.col("_title"), some(F.col("_bullets"), F.lit(True)), F.col("_why"), some(F.col("_brief"), F.col("_level") <= 1), link(F.col("_shown")), F.lit(sign), some(F.col("_tags"), F.col("_level") == 0)]
    return rows.withColumn("caption", F.concat_ws("\n\n", *parts)).drop(*[c for c in rows.columns if c.startswith("_")])


def utf16_units(text: str) -> int:
    return len(text.encode("utf-16-le")) // 2


def short_error(text: Column, labels: dict[int, str] = HTTP_LABELS, most: int = 60) -> Column:
    """A status with its label, a timeout with its milliseconds, else the beginning of the text."""
    code = F.regexp_extract(text, r"HTTP (\d{3})", 1)
    label = F.lit(None).cast("string")
    for k, v in labels.items():
        label = F.when(code == str(k), F.lit(f" ({v})")).otherwise(label)
    late = F.regexp_extract(text, r"(?i)timeout (\d+)ms", 1)
    return (
        F.when(code != "", F.concat(F.lit("HTTP "), code, F.coalesce(label, F.lit(""))))
        .when(late != "", F.concat(F.lit("timeout "), late, F.lit("ms")))
        .when(text.rlike("(?i)timeout"), F.lit("timeout"))
        .otherwise(F.left(text, F.lit(most)))
    )


def run_id(seed: Column, chars: int = 8) -> Column:
    """A short id of a run, the same for the same seed."""
    return F.left(F.sha1(seed.cast("string")), F.lit(chars))
