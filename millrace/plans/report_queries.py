"""Named queries of reports, alerts, texts, readers and streams, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace import lexicon
from millrace.functions import captions, html, summary, text, times, url
from millrace.operators import dedup, filters, reports, selection, state, statistics
from millrace.operators.timestamps import normalize_feed_times
from millrace.plans import catalog, pipeline
from millrace.plans.registry import ORACLES, query
from millrace.plans.view import NOW_MS, VIEW, article_view, now, sql_hits, sql_instants, sql_list, sql_trigrams
from millrace.session import scratch_path
from millrace.sinks import delivery
from millrace.sources import documents, events, feeds
from millrace.sources.tables import table
from millrace.streaming import queries as streams


# ------------------------------------------------------------------------------------------------ timestamps
@query(
    "p7_incoming",
    "SELECT id AS record_id, CAST(ms AS BIGINT) AS utc_ms FROM "
    + sql_instants(
        r"SELECT article_id AS id, pub_date AS x, feed_tz AS zone, date_order AS ord FROM incoming_articles LEFT JOIN rss_sources r ON trim(regexp_replace(lower(source), '[\s\x{00A0}\x{2000}-\x{200A}\x{202F}\x{3000}\x{FEFF}]+', ' ', 'g')) = "
        r"trim(regexp_replace(lower(r.name), '[\s\x{00A0}\x{2000}-\x{200A}\x{202F}\x{3000}\x{FEFF}]+', ' ', 'g')) WHERE NOT regexp_full_match(pub_date, '[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}\.[0-9]{3}Z')"
    )
    + " WHERE ms IS NOT NULL",
)
def p7_incoming(spark: SparkSession, d: str) -> DataFrame:
    """The instants of incoming_articles, which p7_found doesn't ask for."""
    return normalize_feed_times(table(spark, d, "incoming_articles"), table(spark, d, "rss_sources"))


@query(
    "hour_math",
    """SELECT event_id, CAST((extract(hour FROM ts) + 7) % 24 AS INTEGER) AS zone_hour,
    CAST(epoch_us(date_trunc('hour', ts) + INTERVAL 1 HOUR * (CASE WHEN extract(hour FROM ts) % 2 = 0 THEN 2 ELSE 1 END)) // 1000 AS BIGINT) AS even_ms FROM events""",
)
def hour_math(spark: SparkSession, d: str) -> DataFrame:
    """Hour in a zone of fixed offset, and the next full even hour."""
    ts = F.col("ts").cast("timestamp")
    return table(spark, d, "events").select("event_id", times.shifted_hour(F.hour(ts), 7).cast("int").alias("zone_hour"), F.unix_millis(times.next_even_hour(ts)).alias("even_ms"))


# ------------------------------------------------------------------------------------------------------ feeds
_FEED_ITEMS = """items AS (SELECT source, article_id, fetched_at, row_number() OVER (PARTITION BY source ORDER BY fetched_at DESC, article_id) - 1 AS position FROM articles
  WHERE source IN (SELECT name FROM rss_sources))"""


def _feed_texts(spark: SparkSession, d: str) -> DataFrame:
    """A document for each registered source, RSS and Atom by turns, of its 30 newest deliveries: titles with an entity and a
    nested element, links with tracking parameters, dates in two forms."""
    known = table(spark, d, "rss_sources")
    rows = table(spark, d, "articles").select("source", "article_id", "fetched_at").join(known.select(F.col("name").alias("source")), "source", "left_semi")
    ranked = selection.capped_per_source(rows, "source", [F.col("fetched_at").desc(), F.col("article_id")], 30, keep="rn")
    number, atom = F.col("article_id").cast("string"), F.length("source") % 2 == 0
    title = F.concat(F.lit("<title>No. <b>"), number, F.lit("</b> &amp;amp; more</title>"))
    link = F.concat(F.lit("https://Feed.example/a/"), number, F.lit("?utm_source=x"))
    rfc = F.date_format("fetched_at", "EEE, dd MMM yyyy HH:mm:ss 'GMT'")
    item = F.concat(F.lit("<item>"), title, F.lit("<link> "), link, F.lit(" </link><pubDate>"), rfc, F.lit("</pubDate><description>&lt;p&gt;Text of "), number, F.lit("&lt;/p&gt;</description></item>"))
    entry = F.concat(F.lit("<entry>"), title, F.lit('<link rel="self" href="https://feed.example/self"/><link rel="alternate" href="'), link, F.lit('"/><updated>'), F.date_format("fetched_at", "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit("</updated><summary>Text of "), number, F.lit("</summary></entry>"))
    bodies = ranked.select("source", atom.alias("atom"), "rn", F.when(atom, entry).otherwise(item).alias("x")).groupBy("source", "atom").agg(F.sort_array(F.collect_list(F.struct("rn", "x"))).alias("l"))  # 30 a source
    inner = F.array_join(F.transform("l", lambda x: x["x"]), "")
    xml = F.when(F.col("atom"), F.concat(F.lit("<feed>"), inner, F.lit("</feed>"))).otherwise(F.concat(F.lit("<rss><channel>"), inner, F.lit("</channel></rss>")))
    return bodies.select(F.col("source").alias("name"), xml.alias("xml")).join(known.select("name", "category", "priority", "feed_tz", "date_order"), "name")


@query(
    "feed_articles",
    f"""WITH {_FEED_ITEMS} SELECT source, CAST(position AS INTEGER) AS position, 'No. ' || article_id || ' & more' AS title, 'https://feed.example/a/' || article_id AS page, 'Text of ' || article_id AS snippet,
    CAST(epoch_us(date_trunc('second', fetched_at)) // 1000 AS BIGINT) AS pub_ms FROM items WHERE position < 25""",
)
def feed_articles(spark: SparkSession, d: str) -> DataFrame:
    """Feed documents read to articles: 25 items of each."""
    return feeds.parse_feeds(_feed_texts(spark, d)).select("source", "position", "title", F.col("canonical_url").alias("page"), "snippet", F.unix_millis("pub_ts").alias("pub_ms"))


@query(
    "feed_newest",
    f"""WITH {_FEED_ITEMS} SELECT source, CAST(position AS INTEGER) AS position FROM items WHERE position < 25 ORDER BY date_trunc('second', fetched_at) DESC, source, position LIMIT 200""",
)
def feed_newest(spark: SparkSession, d: str) -> DataFrame:
    """The union of all feeds, the 200 newest of it."""
    return feeds.newest_articles(feeds.parse_feeds(_feed_texts(spark, d))).select("source", "position")


@query("page_images", "SELECT article_id, 'https://img.example/' || article_id || '.png?a=1&b=2' AS image FROM articles")
def page_images(spark: SparkSession, d: str) -> DataFrame:
    """The image that a page names for itself: meta tags in either order of attributes, of which a relative one is resolved."""
    number = F.col("article_id").cast("string")
    odd = F.concat(F.lit("<html><head><meta content='https://img.example/"), number, F.lit(".png?a=1&amp;b=2' name='twitter:image'><meta property=\"og:image\" content=\" \"></head>"))
    even = F.concat(F.lit('<HEAD><META PROPERTY="og:image" CONTENT="/'), number, F.lit(".png?a=1&amp;b=2\"></HEAD><meta property='og:image' content='late'>"))
    page = F.when(F.col("article_id") % 2 == 0, even).otherwise(odd)
    return table(spark, d, "articles").select("article_id", url.resolve_url(html.page_image(page), F.lit("https://img.example/x/y")).alias("image"))


@query(
    "payload_round_trip",
    "SELECT article_id, title, link, score, strftime(fetched_at AT TIME ZONE 'UTC', '%Y-%m-%dT%H') AS at FROM articles WHERE link IS NOT NULL AND article_id % 5 <> 0",
)
def payload_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Articles written as queue payloads and read back; every fifth payload is cut off and is passed over."""
    rows = table(spark, d, "articles")
    article = F.struct("title", "link", "score")
    at = F.date_format("fetched_at", "yyyy-MM-dd'T'HH")
    text = documents.payload_text(article, F.struct(F.lit("s").alias("title")), at, at, F.lit("none"))
    stored = rows.select("article_id", F.when(F.col("article_id") % 5 == 0, F.substr(text, F.lit(1), F.lit(20))).otherwise(text).alias("value"))
    return documents.parse_payloads(stored).select("article_id", "article.title", "article.link", "article.score", F.col("generatedAt").alias("at"))


@query("json_events", "SELECT event_type AS kind, CAST(count(*) AS BIGINT) AS n, CAST(sum(event_id) AS BIGINT) AS ids FROM events WHERE event_id % 7 <> 0 GROUP BY 1")
def json_events(spark: SparkSession, d: str) -> DataFrame:
    """Events as JSON texts, every seventh one broken, read to fields."""
    text = F.to_json(F.struct(F.col("event_id").alias("update_id"), F.col("user_id").alias("chat_id"), F.col("event_type").alias("kind")))
    stored = table(spark, d, "events").select(F.when(F.col("event_id") % 7 == 0, F.concat(F.lit("["), text)).otherwise(text).alias("value"))
    return events.parse_events(stored).groupBy("kind").agg(F.count("*").alias("n"), F.sum("update_id").alias("ids"))


# ------------------------------------------------------------------------------------------------------ texts
@query(
    "title_budget_40",
    r"""WITH t AS (SELECT article_id, title, replace(replace(replace(title, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS e FROM articles WHERE title IS NOT NULL),
    w AS (SELECT *, length(e) + length(regexp_replace(e, '[^\x{10000}-\x{10FFFF}]', '', 'g')) AS whole FROM t),
    n AS (SELECT *, list_max(list_filter(range(0, 38), lambda k: k <= length(title) AND length(replace(replace(replace(left(title, k), '&', '&amp;'), '<', '&lt;'), '>', '&gt;')) + length(regexp_replace(left(title, k), '[^\x{10000}-\x{10FFFF}]', '', 'g')) <= 37)) AS k FROM w)
    SELECT article_id, CASE WHEN whole <= 40 THEN e ELSE replace(replace(replace(left(title, k), '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || '...' END AS title FROM n""",
)
def title_budget_40(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "articles").where("title is not null").select("article_id", html.cut_to_budget(F.col("title"), 40).alias("title"))


@query(
    "markup_trimmed_60",
    r"""WITH t AS (SELECT article_id, replace(replace(replace(title, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS e FROM articles WHERE title IS NOT NULL)
    SELECT article_id, CASE WHEN length(e) <= 60 THEN e ELSE regexp_replace(regexp_replace(left(e, 57), '(?s)&[^;]*$', ''), '(?s)<[^>]*$', '') || '...' END AS title FROM t""",
)
def markup_trimmed_60(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "articles").where("title is not null")
    return rows.select("article_id", html.trim_markup(html.escaped(F.col("title")), 60).alias("title"))


def _sql_separate(text: str, words: list[str]) -> str:
    """Greedy hits without overlap: a fold over the words with the places taken so far."""
    at = f"list_filter(list_transform({sql_list(words)}, lambda w: {{'s': position(w IN {text}), 'n': length(w)}}), lambda r: r.s > 0)"
    return f"len(list_reduce(list_transform({at}, lambda r: [r]), lambda acc, r: CASE WHEN len(list_filter(acc, lambda k: r[1].s < k.s + k.n AND k.s < r[1].s + r[1].n)) > 0 THEN acc ELSE list_concat(acc, r) END, []::STRUCT(s BIGINT, n BIGINT)[]))"


@query("separate_hits", f"SELECT article_id, CAST(hits AS INTEGER) AS hits FROM (SELECT article_id, {_sql_separate('low', lexicon.PAPER_WORDS)} AS hits FROM (SELECT article_id, lower(title) AS low FROM articles WHERE title IS NOT NULL)) WHERE hits >= 2")
def separate_hits(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "articles").select("article_id", filters.separate_hits(F.col("title"), lexicon.PAPER_WORDS).alias("hits")).where("hits >= 2")


_NEW = r"list_filter(list_transform([title, snippet], lambda x: trim(regexp_replace(x, '^[\s\-•*·–—]+', ''))), lambda x: x IS NOT NULL AND x <> '')"


@query(
    "summary_new_layout",
    f"""WITH s AS (SELECT article_id, trim(title) AS t, {_NEW} AS b, trim(source) AS w FROM articles WHERE title IS NOT NULL AND source IS NOT NULL)
    SELECT article_id, t AS title, CAST(len(b) AS INTEGER) AS n, CAST(list_sum(list_transform(b, lambda x: least(length(x), 220))) AS BIGINT) AS chars, w AS why FROM s WHERE t <> '' AND len(b) > 0 AND w <> ''""",
)
def summary_new_layout(spark: SparkSession, d: str) -> DataFrame:
    """Summaries in the new layout, in a code fence, read back."""
    raw = F.concat(F.lit("```json\n"), F.to_json(F.struct("title", F.array_compact(F.array("title", "snippet")).alias("bullets"), F.col("source").alias("whyItMatters"))), F.lit("\n```"))
    s = summary.parsed_summary(raw)
    rows = table(spark, d, "articles").where("title is not null and source is not null").select("article_id", s.alias("s")).where("s is not null")
    return rows.select("article_id", "s.title", F.size("s.bullets").alias("n"), F.aggregate("s.bullets", F.lit(0).cast("long"), lambda a, x: a + F.length(x)).alias("chars"), "s.why")


@query("captions_700")
def captions_700(spark: SparkSession, d: str) -> DataFrame:
    """Captions of at most 700 units, made of titles and snippets."""
    rows = table(spark, d, "articles").where("title is not null and link is not null")
    rows = rows.select("article_id", "title", F.array_compact(F.array("title", "snippet")).alias("bullets"), F.coalesce("snippet", "title").alias("why"), F.col("source").alias("brief"), F.array("category").alias("tags"), "link")
    return captions.captioned(rows, 700, captions.signature("Daily", "daily")).select("article_id", "caption")


@query(
    "error_labels",
    """SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'HTTP ' || (400 + event_id % 110) || CASE 400 + event_id % 110 WHEN 401 THEN ' (bad key)' WHEN 403 THEN ' (blocked)' WHEN 408 THEN ' (timeout)' WHEN 429 THEN ' (quota)'
    WHEN 500 THEN ' (server error)' WHEN 502 THEN ' (bad gateway)' WHEN 503 THEN ' (overloaded)' WHEN 504 THEN ' (gateway timeout)' ELSE '' END
    WHEN 1 THEN 'timeout ' || event_id || 'ms' WHEN 2 THEN 'timeout' ELSE left('no route to ' || repeat('x', 90), 60) END AS label FROM events""",
)
def error_labels(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("event_id")
    code = F.concat(F.lit("call failed: HTTP "), (400 + n % 110).cast("string"), F.lit(": {}"))
    text = F.when(n % 4 == 0, code).when(n % 4 == 1, F.concat(F.lit("Timeout "), n.cast("string"), F.lit("ms"))).when(n % 4 == 2, F.lit("a Timeout, it seems")).otherwise(F.concat(F.lit("no route to "), F.repeat(F.lit("x"), F.lit(90))))
    return table(spark, d, "events").select("event_id", captions.short_error(text).alias("label"))


@query(
    "http_outcomes",
    """SELECT event_id, CASE WHEN s BETWEEN 200 AND 299 THEN 'ok' WHEN s BETWEEN 400 AND 499 THEN 'fatal' ELSE 'retry' END AS outcome, CAST(2000 * (1 << CAST(event_id % 5 AS INTEGER)) AS BIGINT) AS wait_ms FROM (SELECT event_id, 200 + event_id % 400 AS s FROM events)""",
)
def http_outcomes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", summary.http_outcome(200 + F.col("event_id") % 400).alias("outcome"), summary.backoff_ms(F.col("event_id") % 5).alias("wait_ms"))


@query("run_ids", "SELECT DISTINCT batch_id, left(sha1(CAST(batch_id AS VARCHAR)), 8) AS run_id FROM articles WHERE batch_id IS NOT NULL")
def run_ids(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "articles").where("batch_id is not null").select("batch_id").distinct().select("batch_id", captions.run_id(F.col("batch_id")).alias("run_id"))


# ---------------------------------------------------------------------------------------------------- reports
_HEALTH = "SELECT name, CAST(count(a.article_id) AS BIGINT) AS n, count(a.article_id) > 0 AS ok FROM rss_sources s LEFT JOIN articles a ON a.source = s.name AND a.score > 320 GROUP BY 1"


@query(
    "source_report",
    f"""WITH h AS ({_HEALTH}) SELECT CAST(row_number() OVER (ORDER BY ok, n DESC, name) AS BIGINT) AS pos, name, n, ok, CAST(count(*) OVER () AS BIGINT) AS total,
    CAST(count(*) FILTER (WHERE ok) OVER () AS BIGINT) AS ok_n, CAST(count(*) FILTER (WHERE NOT ok) OVER () AS BIGINT) AS failed_n FROM h""",
)
def source_report(spark: SparkSession, d: str) -> DataFrame:
    """Sources by their rows of a score over 320, failed ones first, with totals."""
    rows = table(spark, d, "articles").where("score > 320").select("source")
    return reports.source_report(statistics.source_health(table(spark, d, "rss_sources"), rows))


@query("queue_report", f"SELECT CAST(row_number() OVER (ORDER BY slot) AS BIGINT) AS pos, slot, article_id, age_min FROM ({ORACLES['queue_listing']})")
def queue_report(spark: SparkSession, d: str) -> DataFrame:
    """The queue in the order of its slots."""
    return reports.numbered(catalog.queue_listing(spark, d), [F.col("slot")]).select("pos", "slot", "article_id", "age_min")


@query("slot_of_hour", f"SELECT slot, article_id FROM ({ORACLES['queue_listing']}) WHERE CAST(right(slot, 2) AS INTEGER) = (16 - 7 + 24) % 24 ORDER BY slot LIMIT 1")
def slot_of_hour(spark: SparkSession, d: str) -> DataFrame:
    """The earliest slot of the queue at 16 h of a zone seven hours ahead."""
    queue = catalog.queue_listing(spark, d).withColumn("at", F.to_timestamp(F.substr("slot", F.lit(7)), "yyyy-MM-dd'T'HH"))
    return selection.earliest_slot(queue, (16 - 7 + 24) % 24, "at").select("slot", "article_id")


_USAGE_ITEMS = f"""WITH u AS ({ORACLES['usage_by_day']}), q AS (SELECT unnest({sql_list(list(lexicon.DAILY_QUOTA))}) AS category, unnest({list(lexicon.DAILY_QUOTA.values())}) AS quota, unnest(range(0, {len(lexicon.DAILY_QUOTA)})) AS i)
    SELECT d.day, string_agg(q.category || ' ' || COALESCE(u.n, 0) || '/' || q.quota || CASE WHEN COALESCE(u.n, 0) >= q.quota THEN '(full)' ELSE '' END, ', ' ORDER BY i) AS line,
    CAST(sum(COALESCE(u.n, 0)) AS BIGINT) AS used, CAST(sum(q.quota) AS BIGINT) AS quota FROM (SELECT DISTINCT day FROM u) d CROSS JOIN q LEFT JOIN u ON u.day = d.day AND u.category = q.category GROUP BY 1"""


@query("usage_lines", _USAGE_ITEMS)
def usage_lines(spark: SparkSession, d: str) -> DataFrame:
    """Usage of each day's quota as a line of text, with the sums."""
    return reports.usage_lines(catalog.usage_by_day(spark, d), lexicon.DAILY_QUOTA)


@query(
    "report_text",
    f"SELECT string_agg(x, chr(10) ORDER BY name) AS text FROM (SELECT name, name || ': ' || n AS x FROM ({_HEALTH}) ORDER BY name LIMIT 20)",
)
def report_text(spark: SparkSession, d: str) -> DataFrame:
    """The first twenty sources with their counts as one text."""
    rows = table(spark, d, "articles").where("score > 320").select("source")
    health = statistics.source_health(table(spark, d, "rss_sources"), rows)
    return reports.as_text(health, F.concat("name", F.lit(": "), F.col("n").cast("string")), ["name"], 20)


@query("low_scores", "SELECT category, CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (WHERE score < 195) AS BIGINT) AS low FROM articles GROUP BY 1")
def low_scores(spark: SparkSession, d: str) -> DataFrame:
    """Rows and how many are marked as low; none is dropped."""
    return table(spark, d, "articles").groupBy("category").agg(F.count("*").alias("n"), F.count_if(F.col("score") < 195).alias("low"))


@query(
    "skipped_slots",
    """WITH s AS (SELECT date_trunc('hour', fetched_at AT TIME ZONE 'UTC') AS slot, max(score) AS best FROM articles GROUP BY 1)
    SELECT strftime(slot, '%Y-%m-%d') AS day, CAST(count(*) FILTER (WHERE COALESCE(best, 0) < 270) AS BIGINT) AS skipped FROM s GROUP BY 1""",
)
def skipped_slots(spark: SparkSession, d: str) -> DataFrame:
    """Of each day, the slots without a row of a sufficient score."""
    slots = table(spark, d, "articles").groupBy(times.hour_floor(F.col("fetched_at")).alias("slot")).agg(F.max("score").alias("best"))
    return slots.groupBy(times.day_key(F.col("slot")).alias("day")).agg(F.count_if(F.coalesce("best", F.lit(0)) < 270).alias("skipped"))


def _odd_titles_fail(text: str) -> tuple[int, str]:
    """A provider that answers texts of an even length only."""
    return (200, "{}") if len(text) % 2 == 0 else (422, "")


def _refill(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    slots = catalog.next_slots(spark, d).select(F.col("slot_ms").alias("slot"))
    taken = slots.where("(slot div 3600000) % 5 = 0")
    found = table(spark, d, "articles").select("article_id", "category", "source", F.col("score").alias("total"), "title", "snippet").where("source is not null and title is not null and total is not null")
    nothing = spark.createDataFrame([], "source string, n int")
    return pipeline.refill_run(found, slots, taken, nothing, [("even", _odd_titles_fail)], template="{title}")


_REFILL = f"""WITH a AS (SELECT article_id, source, category, score, title FROM articles WHERE source IS NOT NULL AND title IS NOT NULL AND score IS NOT NULL),
    t AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY score DESC, article_id) AS turn, COALESCE(list_position({sql_list(lexicon.CATEGORIES)}, category), 6) AS o FROM a),
    p AS (SELECT *, row_number() OVER (ORDER BY turn, o, COALESCE(category, '')) AS pos FROM t),
    c AS (SELECT *, row_number() OVER (ORDER BY pos) AS r FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY pos) AS k FROM p) WHERE k <= 2),
    s AS (SELECT slot_ms AS slot, row_number() OVER (ORDER BY slot_ms) AS r FROM ({ORACLES['next_slots']}) WHERE (slot_ms // 3600000) % 5 <> 0),
    one AS (SELECT slot, article_id, length(title) % 2 = 0 AS ok FROM c JOIN s USING (r)),
    left_ AS (SELECT slot, row_number() OVER (ORDER BY slot) AS r FROM one WHERE NOT ok),
    two AS (SELECT l.slot, article_id, length(title) % 2 = 0 AS ok FROM left_ l JOIN c ON c.r = l.r + (SELECT count(*) FROM s)),
    done AS (SELECT slot, article_id, 1 AS round FROM one WHERE ok UNION ALL SELECT slot, article_id, 2 FROM two WHERE ok)"""


@query("refill_run", _REFILL + " SELECT CAST(slot AS BIGINT) AS slot_ms, article_id, round FROM done")
def refill_run(spark: SparkSession, d: str) -> DataFrame:
    """A refill from end to end: slots that are open, candidates in turn, summaries, a second round for what failed."""
    return _refill(spark, d)[0].select(F.col("slot").alias("slot_ms"), "article_id", "round")


@query("refill_metrics", _REFILL + " SELECT CAST((SELECT count(*) FROM s) AS BIGINT) AS open, CAST(count(*) AS BIGINT) AS filled, CAST((SELECT count(*) FROM s) - count(*) AS BIGINT) AS failed FROM done")
def refill_metrics(spark: SparkSession, d: str) -> DataFrame:
    return _refill(spark, d)[1]


# ----------------------------------------------------------------------------------------------------- alerts
@query("streak_alerts", f"SELECT * FROM ({ORACLES['failure_streaks']}) WHERE streak >= 1")
def streak_alerts(spark: SparkSession, d: str) -> DataFrame:
    """Users whose last event failed; the default asks for three."""
    return reports.streak_alerts(catalog.failure_streaks(spark, d), 1)


@query(
    "daily_alerts",
    "SELECT day, event_id FROM (SELECT strftime(ts, '%Y-%m-%d') AS day, event_id, row_number() OVER (PARTITION BY strftime(ts, '%Y-%m-%d') ORDER BY ts, event_id) AS rn FROM events WHERE event_type = 'error') WHERE rn = 3",
)
def daily_alerts(spark: SparkSession, d: str) -> DataFrame:
    """The third error of each day, with which its one alert goes out."""
    return reports.daily_alerts(table(spark, d, "events").where("event_type = 'error'"), "ts", "event_id")


@query(
    "refill_alerts",
    """WITH r AS (SELECT batch_id AS run, count(*) FILTER (WHERE COALESCE(score, 0) < 150) AS failed, count(*) FILTER (WHERE score >= 250) AS queued FROM articles WHERE batch_id IS NOT NULL GROUP BY 1)
    SELECT run, 'exhausted' AS alert FROM r WHERE failed >= 12 UNION ALL SELECT run, 'low' FROM r WHERE queued < 6""",
)
def refill_alerts(spark: SparkSession, d: str) -> DataFrame:
    """What each fetch run gives cause to tell, low scores standing for slots that failed."""
    rows = table(spark, d, "articles").where("batch_id is not null")
    runs = rows.groupBy(F.col("batch_id").alias("run")).agg(F.count_if(F.coalesce("score", F.lit(0)) < 150).alias("failed"), F.count_if(F.col("score") >= 250).alias("queued"))
    return reports.refill_alerts(runs)


@query("first_success", "SELECT user_id, arg_min(event_id, (ts, event_id)) AS event_id FROM events WHERE event_type = 'purchase' GROUP BY 1")
def first_success(spark: SparkSession, d: str) -> DataFrame:
    """The first try of each user that came to something."""
    tries = table(spark, d, "events").select("user_id", "event_id", "ts", (F.col("event_type") == "purchase").alias("ok"))
    return state.first_success(tries, "user_id", ["ts", "event_id"]).select("user_id", "event_id")


@query("state_probe", "SELECT unnest(['put', 'get', 'delete']) AS step, true AS ok")
def state_probe(spark: SparkSession, d: str) -> DataFrame:
    """Whether the store writes, reads back and removes."""
    return spark.createDataFrame(reports.state_probe(spark, scratch_path(spark, "probe")), "step string, ok boolean")


@query(
    "newest_lists",
    """SELECT user_id, CAST(list_sum(list_slice(list_sort(list(event_id), 'DESC'), 1, 5)) AS BIGINT) AS ids FROM events GROUP BY 1""",
)
def newest_lists(spark: SparkSession, d: str) -> DataFrame:
    """The five newest of each user's events as a capped list, to which the last one is prepended."""
    ranked = selection.capped_per_source(table(spark, d, "events").select("user_id", "event_id"), "user_id", [F.col("event_id").desc()], 5)
    lists = ranked.groupBy("user_id").agg(F.sort_array(F.collect_list("event_id"), asc=False).alias("l"))  # five a user
    kept = selection.prepended(F.element_at("l", 1), F.slice("l", 2, 5), 5)
    return lists.select("user_id", F.aggregate(kept, F.lit(0).cast("long"), lambda a, x: a + x).alias("ids"))


# ------------------------------------------------------------------------------------------- state and delivery
@query(
    "state_log",
    """WITH u AS (SELECT user_id, max(ts) AS ts, count(*) AS n, count(*) FILTER (WHERE event_type = 'error') AS e FROM events GROUP BY 1)
    SELECT user_id, CAST(n AS BIGINT) AS n FROM u WHERE ts > (SELECT max(ts) - INTERVAL 2 DAY FROM events) AND NOT e % 4 = 0""",
)
def state_log(spark: SparkSession, d: str) -> DataFrame:
    """Counts put into a log with two days to live and some deleted after; what a lookup at the end finds."""
    path = scratch_path(spark, "log")
    rows = table(spark, d, "events").groupBy("user_id").agg(F.max(F.col("ts").cast("timestamp")).alias("at"), F.count("*").alias("n"), F.count_if(F.col("event_type") == "error").alias("e"))
    state.put(rows.select("user_id", "n", "at"), path, F.col("at"), 2 * 86_400)
    state.delete(rows.where("e % 4 = 0").select("user_id", F.lit(0).cast("long").alias("n"), "at"), path, F.col("at") + F.expr("INTERVAL 1 SECOND"))
    log = spark.read.parquet(path)
    moment = log.where("not deleted").agg(F.max("written_ts")).first()[0]
    return state.live(log, ["user_id"], ["written_ts"], F.lit(moment), deleted="deleted").select("user_id", "n")


@query("history_1000", "SELECT entry_id, title FROM posted_history ORDER BY entry_id DESC LIMIT 1000")
def history_1000(spark: SparkSession, d: str) -> DataFrame:
    """A history rewritten with its newest thousand rows."""
    path = scratch_path(spark, "history")
    delivery.keep_newest(table(spark, d, "posted_history").select("entry_id", "title"), [F.desc("entry_id")], path)
    return spark.read.schema("entry_id long, title string").json(path)


def _by_number(row: dict) -> delivery.Reply:
    """A channel that refuses some rows for good and all images of others."""
    kind = row["entry_id"] % 3
    return (200, None, "ok") if kind == 0 else (404, None, "gone") if kind == 1 else (400, None, "wrong file identifier") if row["image"] else (200, None, "ok")


@query(
    "delivery_outcomes",
    """SELECT entry_id, CASE WHEN canonical_url IS NULL OR entry_id % 3 = 2 THEN 'text' ELSE 'image' END AS sent_as, CAST(CASE entry_id % 3 WHEN 1 THEN 404 ELSE 200 END AS INTEGER) AS status,
    CAST(CASE WHEN entry_id % 3 = 2 AND canonical_url IS NOT NULL THEN 2 ELSE 1 END AS INTEGER) AS attempts FROM posted_history""",
)
def delivery_outcomes(spark: SparkSession, d: str) -> DataFrame:
    """Posts with an image where there is one, as text where the image is refused."""
    rows = table(spark, d, "posted_history").select("entry_id", F.col("canonical_url").alias("image"))
    text = lambda row: _by_number({**row, "image": None})
    return delivery.deliver_posts(rows, "entry_id", "image", _by_number, text).select("entry_id", "sent_as", "status", "attempts")


# ------------------------------------------------------------------------------------------- queue and headlines
_QUEUE = "SELECT article_id, title FROM incoming_articles WHERE title IS NOT NULL ORDER BY score DESC NULLS LAST, article_id LIMIT 36"


def _queued(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "incoming_articles").where("title is not null").orderBy(F.col("score").desc_nulls_last(), "article_id").limit(36)


@query("unqueued_by_title", f"WITH q AS (SELECT {catalog.SQL_NORM} AS norm FROM ({_QUEUE})) SELECT article_id FROM (SELECT article_id, {catalog.SQL_NORM} AS norm FROM articles) WHERE norm = '' OR norm NOT IN (SELECT norm FROM q)")
def unqueued_by_title(spark: SparkSession, d: str) -> DataFrame:
    """Articles whose headline isn't that of a queued one."""
    key = F.nullif(text.normalized_headline(F.col("title")), F.lit("")).alias("key")
    return dedup.not_seen(table(spark, d, "articles").select("article_id", key), _queued(spark, d).select(key), "key").select("article_id")


@query(
    "unlike_queued_075",
    f"""WITH q AS (SELECT {sql_trigrams('norm')} AS b FROM (SELECT {catalog.SQL_NORM} AS norm FROM ({_QUEUE})) WHERE norm <> ''),
    g AS (SELECT article_id, {sql_trigrams('norm')} AS a FROM (SELECT article_id, {catalog.SQL_NORM} AS norm FROM articles) WHERE norm <> '')
    SELECT article_id FROM articles WHERE article_id NOT IN (SELECT article_id FROM g, q WHERE len(list_intersect(a, b)) >= 0.75 * (len(a) + len(b) - len(list_intersect(a, b))))""",
)
def unlike_queued_075(spark: SparkSession, d: str) -> DataFrame:
    """Articles whose headline is like none of the queued ones."""
    rows = table(spark, d, "articles").select("article_id", text.normalized_headline(F.col("title")).alias("headline"))
    return pipeline.unlike_queued(rows, _queued(spark, d)).select("article_id")


@query(
    "norm_similarity",
    f"""WITH n AS (SELECT title_id, {sql_trigrams('norm')} AS a, {sql_trigrams('other')} AS b FROM (SELECT title_id, norm, {catalog.SQL_NORM.replace("COALESCE(title, '')", "raw")} AS other FROM recent_titles WHERE norm IS NOT NULL AND raw IS NOT NULL))
    SELECT title_id, round(CASE WHEN len(a) + len(b) = 0 THEN 1 ELSE len(list_intersect(a, b)) / (len(a) + len(b) - len(list_intersect(a, b)))::DOUBLE END, 9) AS similarity FROM n""",
)
def norm_similarity(spark: SparkSession, d: str) -> DataFrame:
    """How alike a stored normalised headline and one made anew are."""
    rows = table(spark, d, "recent_titles").where("norm is not null and raw is not null")
    both = text.jaccard(text.trigrams(F.col("norm")), text.trigrams(F.col("other")))
    return rows.withColumn("other", text.normalized_headline(F.col("raw"))).select("title_id", F.round(both, 9).alias("similarity"))


_WHITE = r"[\s\x0B\x{0085}\x{00A0}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
_TAGS = (
    f"list_filter(list_transform(string_split(title, ' '), lambda x: regexp_replace(regexp_replace(regexp_replace(x, '^{_WHITE}+', ''), '^#+', ''), '{_WHITE}+', '', 'g')), "
    "lambda x: length(x) <= 30 AND regexp_full_match(x, '[A-Za-z0-9_]+'))"
)


@query(
    "hashtags",
    f"""WITH l AS (SELECT article_id, {_TAGS} AS l FROM articles WHERE title IS NOT NULL), u AS (SELECT article_id, list_filter(l, lambda x, i: list_position(list_transform(l, lambda y: lower(y)), lower(x)) = i)[1:8] AS u FROM l)
    SELECT article_id, array_to_string(CASE WHEN len(u) = 0 THEN [] WHEN len(list_filter(u[1:4], lambda x: lower(x) = 'daily')) > 0 THEN u[1:4] ELSE list_append(u[1:4], 'Daily') END, ' ') AS tags FROM u""",
)
def hashtags(spark: SparkSession, d: str) -> DataFrame:
    """Tags made of the words of titles, with the brand as the last one."""
    tags = summary.tags_with_brand(summary.clean_tags(F.split("title", " ")), "Daily")
    return table(spark, d, "articles").where("title is not null").select("article_id", F.array_join(tags, " ").alias("tags"))


@query(
    "stats_report",
    """SELECT CAST(count(score) AS BIGINT) AS n, CAST(greatest(170, least(260, floor(quantile_cont(score, 0.25) + 0.5))) AS INTEGER) AS threshold, round(quantile_cont(score, 0.2), 6) AS p20,
    round(quantile_cont(score, 0.4), 6) AS p40, round(quantile_cont(score, 0.6), 6) AS p60 FROM articles""",
)
def stats_report(spark: SparkSession, d: str) -> DataFrame:
    """Threshold and percentiles of all scores, in one row."""
    scores = table(spark, d, "articles").select(F.lit("all").alias("g"), "score")
    found = statistics.percentiles_by(scores, "g", "score", {"p20": 0.2, "p25": 0.25, "p40": 0.4, "p60": 0.6})
    held = F.greatest(F.lit(170), F.least(F.lit(260), F.floor(F.col("p25") + 0.5).cast("int")))
    return found.select("n", held.alias("threshold"), *[F.round(p, 6).alias(p) for p in ("p20", "p40", "p60")])


@query("newest_titles_10", "SELECT title_id, raw FROM recent_titles ORDER BY title_id DESC LIMIT 10")
def newest_titles_10(spark: SparkSession, d: str) -> DataFrame:
    return dedup.newest(table(spark, d, "recent_titles"), [F.desc("title_id")], 10).select("title_id", "raw")


@query(
    "newest_unposted",
    f"""WITH {VIEW} SELECT article_id, pub_ms FROM view WHERE {NOW_MS} - pub_ms <= 48 * 3600000 AND COALESCE({sql_hits('link', catalog.CORPUS_PATHS)}, 0) = 0 AND COALESCE({sql_hits('title', catalog.CORPUS_TITLES)}, 0) = 0
    AND article_id IN ({ORACLES['unposted_by_url']}) ORDER BY pub_ms DESC, article_id LIMIT 1""",
)
def newest_unposted(spark: SparkSession, d: str) -> DataFrame:
    """The simple variant of a run: the newest row that is fresh, on no list and not posted."""
    view = article_view(spark, d).withColumn("pub_ms", F.unix_millis("pub_ts"))
    kept = view.where(filters.is_fresh(F.timestamp_millis("pub_ms"), now(), 48) & ~filters.contains_any(F.col("link"), catalog.CORPUS_PATHS) & ~filters.contains_any(F.col("title"), catalog.CORPUS_TITLES))
    posted = table(spark, d, "posted_history").select(url.canonical_url(F.col("url")).alias("page"))
    rows = dedup.not_seen(kept.withColumn("page", url.canonical_url(F.coalesce("canonical_url", "link"))), posted, "page")
    return dedup.newest(rows, [F.desc("pub_ms"), F.col("article_id")], 1).select("article_id", "pub_ms")


# -------------------------------------------------------------------------------------------------- streaming
def _sql_throttled(key: str, gap: str) -> str:
    return f"""WITH RECURSIVE e AS (SELECT {key}, ts FROM events GROUP BY 1, 2), p AS (
      SELECT {key}, min(ts) AS ts FROM e GROUP BY 1
      UNION ALL SELECT {key}, nxt FROM (SELECT p.{key}, (SELECT min(e.ts) FROM e WHERE e.{key} = p.{key} AND e.ts >= p.ts + INTERVAL {gap}) AS nxt FROM p) q WHERE nxt IS NOT NULL)
    SELECT {key}, CAST(epoch_us(ts) // 1000 AS BIGINT) AS at_ms FROM p"""


query("stream_first_seen", _sql_throttled("user_id", "2 DAY"))(streams.stream_first_seen)
query("stream_throttled", ORACLES["throttled_alerts"])(streams.stream_throttled)
query(
    "stream_hourly_counts",
    """WITH w AS (SELECT max(ts) - INTERVAL 1 HOUR AS mark FROM events)
    SELECT CAST(epoch_us(date_trunc('hour', ts)) // 1000 AS BIGINT) AS slot_ms, event_type, CAST(count(*) AS BIGINT) AS n FROM events, w WHERE date_trunc('hour', ts) + INTERVAL 1 HOUR <= mark GROUP BY 1, 2""",
)(streams.stream_hourly_counts)
query(
    "stream_slot_queue",
    """WITH c AS (SELECT strftime(ts, '%Y-%m-%dT%H') AS slot, event_id AS seq, CASE event_type WHEN 'purchase' THEN 'put' WHEN 'error' THEN 'take' ELSE 'peek' END AS op, CAST(user_id AS VARCHAR) AS payload FROM events),
    last AS (SELECT slot, seq, op, last_value(CASE WHEN op <> 'peek' THEN {'op': op, 'p': payload} END IGNORE NULLS) OVER (PARTITION BY slot ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS w FROM c)
    SELECT slot, CAST(seq AS BIGINT) AS seq, op, CASE WHEN w.op = 'put' THEN w.p END AS payload FROM last WHERE op <> 'put'""",
)(streams.stream_slot_queue)
query("stream_failures", "SELECT user_id, CAST(count(*) AS BIGINT) AS n FROM events WHERE event_type = 'error' GROUP BY 1")(streams.stream_failures)
