from datetime import UTC, datetime

import pytest
from pyspark.sql import functions as F

from millrace.operators import timestamps as ts


def ms(*a):
    return round(datetime(*a, tzinfo=UTC).timestamp() * 1000)


CASES = [
    ("2025-08-22 13:52:20[Europe/London]", None, None, ms(2025, 8, 22, 12, 52, 20)),
    ("Fri, 01 Aug 2025 04:25:03 EDT", None, None, ms(2025, 8, 1, 8, 25, 3)),
    ("Mon, 01 Aug 25 04:25:03 +0530", None, None, ms(2025, 7, 31, 22, 55, 3)),  # wrong weekday, two-digit year
    ("10 août 2025 à 06:02", "Europe/Paris", None, ms(2025, 8, 10, 4, 2)),
    ("3. März 2025, 09:51 Uhr", "Europe/Berlin", "dmy", ms(2025, 3, 3, 8, 51)),
    ("August 2, 2025, 12:29:55 am", "UTC", None, ms(2025, 8, 2, 0, 29, 55)),
    ("Aug 2, 2025 12:29 PM", "UTC", None, ms(2025, 8, 2, 12, 29)),
    ("2025-08-02 15:17:33-07", None, None, ms(2025, 8, 2, 22, 17, 33)),
    ("2025-08-04 19:22:14 GMT+07:00", None, None, ms(2025, 8, 4, 12, 22, 14)),
    ("2025-12-16 21:41:39 Asia/Ho_Chi_Minh", None, None, ms(2025, 12, 16, 14, 41, 39)),
    ("20250802T095222Z", None, None, ms(2025, 8, 2, 9, 52, 22)),
    ("1754239073929507", None, None, 1754239073929),
    ("1754121677.300", None, None, 1754121677300),
    ("1754230565", None, None, 1754230565000),
    ("03/04/2025 10:00", "UTC", "mdy", ms(2025, 3, 4, 10)),
    ("03/04/2025 10:00", "UTC", "dmy", ms(2025, 4, 3, 10)),
    ("03/04/2025 10:00", "UTC", None, None),
    ("2025-08-01", "Asia/Tokyo", None, ms(2025, 7, 31, 15)),
    ("2025-08-01 10:00", None, None, None),
    ("2025-08-01 10:00", "Mars/Phobos", None, None),
    ("2025-11-02 01:30", "America/New_York", None, ms(2025, 11, 2, 5, 30)),  # twice: the earlier
    ("2025-03-09 02:30", "America/New_York", None, ms(2025, 3, 9, 7, 30)),  # never: moved on by the gap
    ("2025-07-01 10:00:00 EST", None, None, ms(2025, 7, 1, 15)),  # fixed offset all year
    (" 2025-08-03T03:07:53.012Z\n", None, None, ms(2025, 8, 3, 3, 7, 53, 12000)),
    ("2025-08-03T03:07:53.012999Z", None, None, ms(2025, 8, 3, 3, 7, 53, 12000)),
    ("2026-02-30T10:00:00Z", None, None, None),
    ("2026-13-05 08:00:00", "UTC", None, None),
    ("0000-00-00 00:00:00", "UTC", None, None),
    ("-0001-11-30T00:00:00+00:00", None, None, None),
    ("yesterday", "UTC", None, None),
    ("in 3 hours", "UTC", None, None),
    ("", "UTC", None, None),
    (None, "UTC", None, None),
    ("2024-02-29 00:00:00Z", None, None, ms(2024, 2, 29)),
    ("1" * 5000, None, None, None),
]


@pytest.mark.parametrize("text,zone,order,want", CASES)
def test_parse(text, zone, order, want):
    assert ts.parse_instant(text, zone, order) == want


def test_days_agree_with_the_calendar():
    for y, m, d in [(1, 1, 1), (1600, 2, 29), (1969, 12, 31), (1970, 1, 1), (2000, 3, 1), (9999, 12, 31)]:
        assert ts.days_from_civil(y, m, d) == datetime(y, m, d).toordinal() - datetime(1970, 1, 1).toordinal()


def test_feeds_and_history(spark):
    sources = spark.createDataFrame([("Orbit Ledger", "UTC", "mdy"), ("Plum", None, None)], "name string, feed_tz string, date_order string")
    articles = spark.createDataFrame(
        [(1, "01/02/2025 10:00", "orbit ledger", "x"), (2, "2025-01-02T10:00:00.000Z", "Orbit Ledger", None), (3, None, None, None), (4, "2025-01-02 10:00", "Plum", "y"), (5, "1754230565", None, None), (5, "1754230565", None, None)],
        "article_id long, pub_date string, source string, name string",
    )
    got = sorted(tuple(r) for r in ts.normalize_feed_times(articles, sources).collect())
    assert got == [(1, ms(2025, 1, 2, 10)), (5, 1754230565000), (5, 1754230565000)]
    posted = spark.createDataFrame([(7, "2025-01-02 10:00", "Asia/Tokyo"), (8, "x", None)], "entry_id long, posted_at string, tz string")
    assert [tuple(r) for r in ts.normalize_posted_times(posted).collect()] == [(7, ms(2025, 1, 2, 1))]
    assert ts.normalize_feed_times(articles.where("false"), sources.where("false")).count() == 0


def test_only_needed_rows_reach_python(spark):
    df = spark.createDataFrame([(1, "a", "s")], "article_id long, pub_date string, source string")
    src = spark.createDataFrame([("s", "UTC", "dmy")], "name string, feed_tz string, date_order string")
    plan = ts.normalize_feed_times(df, src)._jdf.queryExecution().toString()
    assert plan.count("ArrowEvalPython") >= 1 and "BatchEvalPython" not in plan


def test_canonical_predicate(spark):
    df = spark.createDataFrame([("2025-01-02T10:00:00.000Z",), ("2025-01-02t10:00:00.000z",)], "t string")
    assert [r[0] for r in df.select(ts.is_canonical(F.col("t"))).collect()] == [True, False]


def test_white_space_around_a_date(spark):
    text, at = "2025-08-03T03:07:53.012Z", ms(2025, 8, 3, 3, 7, 53, 12000)
    assert ts.parse_instant(" " * 60 + text + "\n" * 60, None, None) == at
    ends = ["\n", "\r\n", "\r", "\u0085", " ", " " * 200]
    df = spark.createDataFrame([(i, text + e, None) for i, e in enumerate(["", *ends])], "entry_id long, posted_at string, tz string")
    assert sorted(tuple(r) for r in ts.normalize_posted_times(df).collect()) == [(i, at) for i in range(1, len(ends) + 1)]
