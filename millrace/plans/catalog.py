"""Named queries of the engine and, where SQL can say the same, their equivalents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace import lexicon
from millrace.functions import html, summary, text, times, url
from millrace.operators import dedup, filters, scoring, selection, state, statistics
from millrace.operators.timestamps import instant_ms, is_canonical, normalize_feed_times, normalize_posted_times
from millrace.plans import pipeline
from millrace.plans.view import FEED_TIMES, NOW_MS, POSTED_TIMES, POSTED_VIEW, VIEW, article_view, now, sql_hits, sql_list, sql_norm, sql_trigrams
from millrace.plans.registry import ORACLES, query
from millrace.sources.tables import table

#: Lists that hit the invented corpus; the defaults are covered by unit tests.
CORPUS_PATHS, CORPUS_TITLES = ["/p/", "/fishing/", "/tax/"], ["merger", "outage", "payroll"]
CORPUS_TRUST = [("papertrail.example", 20), ("export.papertrail.example", 25), ("sparrowsys.example", 15), ("orbitledger.example", 10)]


@query("p7_found", f"SELECT id AS record_id, CAST(ms AS BIGINT) AS utc_ms FROM (SELECT * FROM {FEED_TIMES} UNION ALL SELECT * FROM {POSTED_TIMES}) WHERE ms IS NOT NULL")
def p7_found(spark: SparkSession, d: str) -> DataFrame:
    feeds = normalize_feed_times(table(spark, d, "articles"), table(spark, d, "rss_sources"))
    return feeds.unionByName(normalize_posted_times(table(spark, d, "posted_history")))


# ---------------------------------------------------------------------------------------------- URL and text
def sql_canonical(rows: str) -> str:
    """SQL of (id, url): the canonical form of each row of *rows*, a query of (id, u)."""
    return rf"""(
  WITH s AS (SELECT id AS article_id, regexp_replace(trim(u, E' \t\n\r'), '[\t\n\r]', '', 'g') AS s FROM ({rows}) r),
  p AS (SELECT article_id, s, lower(split_part(s, ':', 1)) AS scheme, lower(split_part(s, '/', 3)) AS host,
    split_part(split_part(s, '#', 1), '?', 1) AS main,
    CASE WHEN contains(split_part(s, '#', 1), '?') THEN substring(split_part(s, '#', 1), strpos(split_part(s, '#', 1), '?') + 1) ELSE '' END AS q FROM s),
  c AS (SELECT article_id, s, scheme,
    split_part(split_part(CASE WHEN scheme = 'https' THEN regexp_replace(host, ':443$', '') ELSE regexp_replace(host, ':80$', '') END, '?', 1), '#', 1) AS host,
    rtrim(substring(main, length(split_part(main, '/', 1)) + length(split_part(main, '/', 3)) + 3), '/') AS path,
    list_sort(list_transform(list_filter(string_split(q, '&'), lambda x: x <> '' AND NOT starts_with(lower(split_part(x, '=', 1)), 'utm_')
      AND NOT list_contains({sql_list(url.TRACKING_PARAMS)}, lower(split_part(x, '=', 1)))),
      lambda x, i: {{'k': split_part(x, '=', 1), 'i': i, 'p': CASE WHEN contains(x, '=') THEN x ELSE x || '=' END}})) AS keep FROM p)
  SELECT article_id, CASE WHEN s IS NULL OR NOT contains(s, '://') THEN s ELSE scheme || '://' || host || CASE WHEN path = '' THEN '/' ELSE path END
    || CASE WHEN len(keep) = 0 THEN '' ELSE '?' || array_to_string(list_transform(keep, lambda x: x.p), '&') END END AS url FROM c)"""


_CANONICAL = f"SELECT article_id, url FROM {sql_canonical('SELECT article_id AS id, link AS u FROM articles')}"
_POSTED_PAGE = sql_canonical("SELECT entry_id AS id, url AS u FROM posted_history")
_ARTICLE_PAGE = sql_canonical("SELECT article_id AS id, COALESCE(canonical_url, link) AS u FROM articles")


@query("url_canonical", _CANONICAL)
def url_canonical(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "articles").select("article_id", url.canonical_url(F.col("link")).alias("url"))


@query("url_groups", f"SELECT sha1(url) AS url_hash, CAST(count(*) AS BIGINT) AS n FROM ({_CANONICAL}) WHERE url IS NOT NULL GROUP BY 1")
def url_groups(spark: SparkSession, d: str) -> DataFrame:
    canonical = table(spark, d, "articles").where("link is not null").select(url.canonical_url(F.col("link")).alias("u"))
    return canonical.groupBy(url.url_hash(F.col("u")).alias("url_hash")).agg(F.count("*").alias("n"))


_BARE = r"regexp_replace(trim(canonical_url, E' \t\n\r'), '[\t\n\r]', '', 'g')"
_HOST = f"CASE WHEN contains(canonical_url, '://') THEN lower(regexp_extract({_BARE}, '^[A-Za-z]+://([^/:?#]*)', 1)) ELSE '' END"


@query("domain_counts", f"SELECT COALESCE({_HOST}, '') AS host, CAST(count(*) AS BIGINT) AS n FROM articles GROUP BY 1")
def domain_counts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "articles").groupBy(url.domain(F.col("canonical_url")).alias("host")).agg(F.count("*").alias("n"))


def _sql_trust(host: str, trust: list[tuple[str, int]]) -> str:
    whens = " ".join(f"WHEN {host} = '{t}' OR {host} LIKE '%.{t}' THEN {p}" for t, p in trust)
    return f"CASE {whens} ELSE 0 END"


@query("domain_trust", f"SELECT article_id, CAST({_sql_trust('COALESCE(' + _HOST + ', chr(32))', CORPUS_TRUST)} AS INTEGER) AS trust FROM articles")
def domain_trust(spark: SparkSession, d: str) -> DataFrame:
    host = url.domain(F.col("canonical_url"))
    return table(spark, d, "articles").select("article_id", scoring.suffix_match(host, CORPUS_TRUST).alias("trust"))


@query("blocked_domains", f"SELECT article_id FROM articles WHERE {_sql_trust(_HOST, [('frontpage.example', 1), ('cosmicledger.example', 1)])} = 1")
def blocked_domains(spark: SparkSession, d: str) -> DataFrame:
    host = url.domain(F.col("canonical_url"))
    return table(spark, d, "articles").where(scoring.is_blocked(host, ["frontpage.example", "cosmicledger.example"])).select("article_id")


@query(
    "path_sections",
    rf"""SELECT section, CAST(count(*) AS BIGINT) AS n FROM (SELECT COALESCE(list_filter(string_split(lower(regexp_extract({_BARE}, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1)), '/'), lambda x: x <> '')[1], '') AS section
    FROM articles WHERE contains(canonical_url, '://')) GROUP BY 1""",
)
def path_sections(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "articles").where(F.col("canonical_url").contains("://"))
    first = F.coalesce(F.get(url.path_segments(F.col("canonical_url")), F.lit(0)), F.lit(""))
    return rows.groupBy(first.alias("section")).agg(F.count("*").alias("n"))


_SEGMENTS = rf"list_filter(string_split(lower(regexp_extract({_BARE}, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1)), '/'), lambda x: x <> '')"


@query(
    "path_penalty",
    f"""SELECT article_id, CAST(CASE WHEN list_contains(seg, 'fishing') OR ((host = 'papertrail.example' OR host LIKE '%.papertrail.example') AND seg[1] = 'tax') THEN 30 ELSE 0 END AS INTEGER) AS points
    FROM (SELECT article_id, {_SEGMENTS} AS seg, {_HOST} AS host FROM articles WHERE canonical_url IS NOT NULL)""",
)
def path_penalty(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "articles").where("canonical_url is not null")
    return rows.select("article_id", scoring.path_points(F.col("canonical_url"), anywhere=["fishing"], first={"papertrail.example": "tax"}).alias("points"))


SQL_NORM = sql_norm("COALESCE(title, '')", text.STOP_WORDS)


@query("title_normalized", f"SELECT article_id, {SQL_NORM} AS norm FROM articles")
def title_normalized(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "articles").select("article_id", text.normalized_headline(F.col("title")).alias("norm"))


@query("title_hash_groups", f"SELECT sha1(norm) AS hash, CAST(count(*) AS BIGINT) AS n FROM (SELECT {SQL_NORM} AS norm FROM articles) WHERE norm <> '' GROUP BY 1")
def title_hash_groups(spark: SparkSession, d: str) -> DataFrame:
    norms = table(spark, d, "articles").select(text.normalized_headline(F.col("title")).alias("norm")).where("norm <> ''")
    return norms.groupBy(text.headline_hash(F.col("norm")).alias("hash")).agg(F.count("*").alias("n"))


@query("trigram_stats", f"SELECT title_id, CAST(len({sql_trigrams('norm')}) AS INTEGER) AS grams FROM recent_titles WHERE norm IS NOT NULL")
def trigram_stats(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "recent_titles").where("norm is not null").select("title_id", F.size(text.trigrams(F.col("norm"))).alias("grams"))


@query(
    "fuzzy_known_088",
    f"""
    WITH known AS (SELECT norm, raw, row_number() OVER (ORDER BY title_id DESC) AS pos FROM recent_titles WHERE norm <> '' AND raw IS NOT NULL),
    k AS (SELECT raw, pos, {sql_trigrams('norm')} AS b FROM known WHERE pos <= 200),
    a AS (SELECT article_id, {SQL_NORM} AS norm FROM incoming_articles),
    g AS (SELECT article_id, {sql_trigrams('norm')} AS a FROM a WHERE norm <> ''),
    m AS (SELECT article_id, raw, pos FROM g, k WHERE len(list_intersect(a, b)) >= 0.88 * (len(a) + len(b) - len(list_intersect(a, b))))
    SELECT article_id, min_by(raw, pos) AS similar_to FROM m GROUP BY 1
    """,
)
def fuzzy_known_088(spark: SparkSession, d: str) -> DataFrame:
    newest = table(spark, d, "recent_titles").where("norm <> '' and raw is not null").select("norm", "raw", (-F.col("title_id")).alias("pos"))
    rows = dedup.headline_keys(table(spark, d, "incoming_articles").select("article_id", "title"))
    return dedup.fuzzy_known(rows, "norm", newest).where("similar_to is not null").select("article_id", "similar_to")


@query("event_cluster_winners")
def event_cluster_winners(spark: SparkSession, d: str) -> DataFrame:
    return dedup.cluster_batch(article_view(spark, d), "article_id", [F.desc("pub_ts"), F.col("article_id")])


@query("snippet_text")
def snippet_text(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "articles").select("article_id", html.stripped(F.col("snippet")).alias("text"))


@query("html_escaped", "SELECT article_id, replace(replace(replace(replace(title, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;') AS title FROM articles")
def html_escaped(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "articles").select("article_id", html.escaped(F.col("title"), attribute=True).alias("title"))


@query("props_json", "SELECT CAST(json_extract(props, '$.k') AS BIGINT) AS k, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY 1")
def props_json(spark: SparkSession, d: str) -> DataFrame:
    k = F.try_variant_get(F.try_parse_json("props"), "$.k", "long")
    return table(spark, d, "events").groupBy(k.alias("k")).agg(F.count("*").alias("n"))


@query("summary_parse")
def summary_parse(spark: SparkSession, d: str) -> DataFrame:
    """Summaries in the old layout, made of titles and snippets, read back."""
    raw = F.to_json(F.struct("title", F.col("snippet").alias("body"), F.col("source").alias("takeaway")))
    s = summary.parsed_summary(raw)
    return table(spark, d, "articles").select("article_id", s.alias("s")).where("s is not null").select("article_id", "s.title", "s.bullets", "s.why")


# ---------------------------------------------------------------------------------------------------- filters
@query("fresh_articles", f"WITH {VIEW} SELECT article_id FROM view WHERE {NOW_MS} - pub_ms <= 30 * 3600000")
def fresh_articles(spark: SparkSession, d: str) -> DataFrame:
    view = article_view(spark, d).withColumn("pub_ts", F.timestamp_millis(F.unix_millis("pub_ts")))
    return view.where(filters.is_fresh(F.col("pub_ts"), now())).select("article_id")


@query("url_blacklist", f"SELECT article_id FROM articles WHERE COALESCE({sql_hits('link', CORPUS_PATHS)}, 0) = 0")
def url_blacklist(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "articles").where(~filters.contains_any(F.col("link"), CORPUS_PATHS)).select("article_id")


@query("title_blacklist", f"SELECT article_id FROM articles WHERE COALESCE({sql_hits('title', CORPUS_TITLES)}, 0) = 0")
def title_blacklist(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "articles").where(~filters.contains_any(F.col("title"), CORPUS_TITLES)).select("article_id")


@query("required_fields", "SELECT article_id FROM articles WHERE title <> '' AND link <> ''")
def required_fields(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "articles").where(filters.has_required(F.col("title"), F.col("link"))).select("article_id")


@query(
    "unposted_by_url",
    f"SELECT article_id FROM {_ARTICLE_PAGE} a WHERE NOT EXISTS (SELECT 1 FROM {_POSTED_PAGE} p WHERE p.url = a.url)",
)
def unposted_by_url(spark: SparkSession, d: str) -> DataFrame:
    """Articles whose page, canonical on both sides, wasn't posted."""
    posted = table(spark, d, "posted_history").select(url.canonical_url(F.col("url")).alias("page"))
    rows = table(spark, d, "articles").select("article_id", url.canonical_url(F.coalesce("canonical_url", "link")).alias("page"))
    return dedup.not_seen(rows, posted, "page").select("article_id")


@query(
    "unposted_by_title",
    f"""WITH p AS (SELECT DISTINCT {SQL_NORM} AS norm FROM posted_history), a AS (SELECT article_id, {SQL_NORM} AS norm FROM articles)
    SELECT article_id FROM a WHERE norm = '' OR norm NOT IN (SELECT norm FROM p)""",
)
def unposted_by_title(spark: SparkSession, d: str) -> DataFrame:
    key = F.nullif(F.col("norm"), F.lit("")).alias("key")
    posted = dedup.headline_keys(table(spark, d, "posted_history")).select(key)
    rows = dedup.headline_keys(table(spark, d, "articles")).select("article_id", key)
    return dedup.not_seen(rows, posted, "key").select("article_id")


@query(
    "unqueued_by_any_url",
    """WITH q AS (SELECT url AS k FROM posted_history UNION SELECT canonical_url FROM posted_history)
    SELECT article_id FROM articles a WHERE NOT EXISTS (SELECT 1 FROM q WHERE q.k = a.link) AND NOT EXISTS (SELECT 1 FROM q WHERE q.k = a.canonical_url)""",
)
def unqueued_by_any_url(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "articles").select("article_id", "link", "canonical_url")
    return dedup.not_seen_by_any(rows, table(spark, d, "posted_history"), ["link", "canonical_url"], ["url", "canonical_url"]).select("article_id")


@query(
    "below_failures",
    """WITH f AS (SELECT user_id, count(*) AS n FROM events WHERE event_type = 'error' GROUP BY 1)
    SELECT e.event_id FROM events e LEFT JOIN f USING (user_id) WHERE COALESCE(f.n, 0) < 12""",
)
def below_failures(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events")
    failed = events.where("event_type = 'error'").groupBy("user_id").agg(F.count("*").alias("n"))
    return filters.below_failures(events.select("event_id", "user_id"), failed, "user_id", 12).select("event_id")


_REASON = f"""CASE WHEN NOT COALESCE(title <> '' AND link <> '', FALSE) THEN 'incomplete'
    WHEN COALESCE({sql_hits('link', CORPUS_PATHS)}, 0) > 0 THEN 'path' WHEN COALESCE({sql_hits('title', CORPUS_TITLES)}, 0) > 0 THEN 'title'
    WHEN score < 150 THEN 'low score' ELSE 'kept' END"""


@query(
    "skip_reasons",
    f"""WITH r AS (SELECT {_REASON} AS reason FROM articles), names AS (SELECT unnest(['incomplete', 'path', 'title', 'low score', 'kept']) AS reason)
    SELECT names.reason, CAST(count(r.reason) AS BIGINT) AS n FROM names LEFT JOIN r ON r.reason = names.reason GROUP BY 1""",
)
def skip_reasons(spark: SparkSession, d: str) -> DataFrame:
    reasons = [
        ("incomplete", ~filters.has_required(F.col("title"), F.col("link"))),
        ("path", filters.contains_any(F.col("link"), CORPUS_PATHS)),
        ("title", filters.contains_any(F.col("title"), CORPUS_TITLES)),
        ("low score", F.col("score") < 150),
    ]
    return statistics.reason_funnel(table(spark, d, "articles"), reasons)


# ---------------------------------------------------------------------------------------------------- scoring
_TEXT = "COALESCE(title, '') || ' ' || COALESCE(snippet, '')"


def _sql_points(words: list[str], points: tuple[int, int], more: str = "") -> str:
    return f"CAST(least(({sql_hits(_TEXT, words)}{more}) * {points[0]}, {points[1]}) AS INTEGER)"


_WORDS = {
    "boost": _sql_points(lexicon.BOOST_WORDS, lexicon.BOOST_POINTS),
    "penalty": _sql_points(lexicon.PENALTY_WORDS, lexicon.PENALTY_POINTS),
    "verbs": _sql_points(lexicon.NEWS_VERBS, lexicon.VERB_POINTS),
    "fluff": _sql_points(lexicon.FLUFF_WORDS, lexicon.FLUFF_POINTS, rf" + CAST(regexp_matches(lower({_TEXT}), '{lexicon.YEARS}') AS INTEGER)"),
}


@query("word_scores", "SELECT article_id, " + ", ".join(f"{v} AS {k}" for k, v in _WORDS.items()) + " FROM articles")
def word_scores(spark: SparkSession, d: str) -> DataFrame:
    return scoring.with_word_scores(table(spark, d, "articles")).select("article_id", "words.*")


_AGE = f"(greatest({NOW_MS} - pub_ms, 0) / 3600000.0::DOUBLE)"
_UTF16 = "(length(COALESCE(snippet, '')) + len(list_filter(string_split(COALESCE(snippet, ''), ''), lambda c: unicode(c) > 65535)))"
_HOST2 = "COALESCE(" + _HOST.replace("canonical_url", "u") + ", ' ')"
_PARTS = {
    "source": "CAST(CASE priority WHEN 1 THEN 100 WHEN 2 THEN 70 WHEN 3 THEN 40 ELSE 0 END AS INTEGER)",
    "recency": f"CAST(CASE WHEN {_AGE} >= 48 THEN 0 ELSE floor(100 * (1 - {_AGE} / 48) + 0.5) END AS INTEGER)",
    **_WORDS,
    "depth": f"CASE WHEN {_UTF16} >= 500 THEN 10 ELSE 0 END",
    "trust": _sql_trust(_HOST2, CORPUS_TRUST),
}
_SCORED = f"""WITH {VIEW}, v AS (SELECT *, COALESCE(CASE WHEN canonical_url <> '' THEN canonical_url END, link) AS u FROM view),
    parts AS (SELECT article_id, title, pub_ms, {", ".join(f"{v} AS p_{k}" for k, v in _PARTS.items())} FROM v),
    scored AS (SELECT article_id, title, pub_ms, p_source, p_recency, p_boost, p_penalty, p_verbs, p_fluff, p_depth, p_trust,
      CAST(p_source + p_recency + p_boost - p_penalty + p_verbs - p_fluff + p_depth + p_trust AS INTEGER) AS total FROM parts)"""


@query("score_breakdown", _SCORED + " SELECT article_id, p_source, p_recency, CAST(p_depth AS INTEGER) AS p_depth, CAST(p_trust AS INTEGER) AS p_trust, total FROM scored")
def score_breakdown(spark: SparkSession, d: str) -> DataFrame:
    rows = scoring.scored(article_view(spark, d), now(), CORPUS_TRUST)
    return rows.select("article_id", *[F.col(f"parts.{k}").alias(f"p_{k}") for k in ("source", "recency", "depth", "trust")], "total")


@query(
    "top_articles",
    _SCORED + f""" SELECT article_id, title, total FROM scored JOIN articles USING (article_id, title)
    WHERE {NOW_MS} - pub_ms <= 2592000000 AND title <> '' AND link <> '' AND COALESCE({sql_hits('link', CORPUS_PATHS)}, 0) = 0
    AND COALESCE({sql_hits('title', CORPUS_TITLES)}, 0) = 0 AND article_id IN (SELECT article_id FROM {_ARTICLE_PAGE} WHERE url NOT IN (SELECT url FROM {_POSTED_PAGE} WHERE url IS NOT NULL))
    AND ({SQL_NORM} = '' OR {SQL_NORM} NOT IN (SELECT {SQL_NORM} FROM posted_history))
    ORDER BY total DESC, article_id LIMIT 10""",
)
def top_articles(spark: SparkSession, d: str) -> DataFrame:
    """The flagship: filter, take off what was posted (by page or headline), score, and list the ten best."""
    view = article_view(spark, d).withColumn("pub_ts", F.timestamp_millis(F.unix_millis("pub_ts")))
    kept = view.where(
        filters.is_fresh(F.col("pub_ts"), now(), hours=30 * 24)
        & filters.has_required(F.col("title"), F.col("link"))
        & ~filters.contains_any(F.col("link"), CORPUS_PATHS)
        & ~filters.contains_any(F.col("title"), CORPUS_TITLES)
    )
    nothing = spark.createDataFrame([], "link string, canonical_url string"), spark.createDataFrame([], "page string, n long")
    new = pipeline.unknown(kept, table(spark, d, "posted_history").select("url", "title"), *nothing)
    return scoring.scored(new, now(), CORPUS_TRUST).orderBy(F.desc("total"), "article_id").limit(10).select("article_id", "title", "total")


@query("top_today")
def top_today(spark: SparkSession, d: str) -> DataFrame:
    """The whole run without its effects: on-topic rows of the last 30 days, one an event, neither posted nor queued nor
    failed too often, like none of the 200 newest headlines nor of the queued titles; the ten best with their parts."""
    recent = table(spark, d, "recent_titles").where("norm <> '' and raw is not null").select("norm", "raw", (-F.col("title_id")).alias("pos"))
    batch = table(spark, d, "incoming_articles")
    queued = batch.orderBy(F.col("score").desc_nulls_last(), "article_id").limit(36).select("link", "canonical_url", "title")  # a queue of two days
    failures = batch.where("title is null").groupBy(url.canonical_url(F.coalesce("canonical_url", "link")).alias("page")).agg(F.count("*").alias("n"))
    s = pipeline.Settings(now=now(), hours=30 * 24, paths=CORPUS_PATHS, titles=CORPUS_TITLES, trust=CORPUS_TRUST)
    found = pipeline.candidates(article_view(spark, d), table(spark, d, "posted_history").select("url", "title"), queued, failures, recent, s)
    return found.select("article_id", "title", "source", "category", "total", "low", scoring.explain_parts(F.col("parts")).alias("why"))


# ------------------------------------------------------------------------------------------------- aggregates
@query(
    "percentiles",
    """SELECT event_type, round(quantile_cont(value, 0.25), 6) AS p25, round(quantile_cont(value, 0.4), 6) AS p40, round(quantile_cont(value, 0.6), 6) AS p60
    FROM events WHERE isfinite(value) GROUP BY 1""",
)
def percentiles(spark: SparkSession, d: str) -> DataFrame:
    found = statistics.percentiles_by(table(spark, d, "events"), "event_type", "value", {"p25": 0.25, "p40": 0.4, "p60": 0.6})
    return found.select("event_type", *[F.round(p, 6).alias(p) for p in ("p25", "p40", "p60")])


@query(
    "adaptive_threshold",
    """SELECT category, CAST(CASE WHEN count(*) < 10 THEN 195 ELSE greatest(170, least(260, floor(COALESCE(quantile_cont(score, 0.25), 0) + 0.5))) END AS INTEGER) AS threshold
    FROM articles GROUP BY 1""",
)
def adaptive_threshold(spark: SparkSession, d: str) -> DataFrame:
    return statistics.adaptive_thresholds(table(spark, d, "articles"), "category", "score").select("category", F.col("threshold").cast("int"))


_USAGE = "SELECT strftime(fetched_at AT TIME ZONE 'UTC', '%Y-%m-%d') AS day, category, CAST(count(*) AS BIGINT) AS n FROM articles GROUP BY 1, 2"


@query("usage_by_day", _USAGE)
def usage_by_day(spark: SparkSession, d: str) -> DataFrame:
    return statistics.usage_by_day(table(spark, d, "articles"), "fetched_at", "category")


@query(
    "quota_remaining",
    f"""WITH u AS ({_USAGE}), q AS (SELECT unnest({sql_list(list(lexicon.DAILY_QUOTA))}) AS category, unnest({list(lexicon.DAILY_QUOTA.values())}) AS quota)
    SELECT d.day, q.category, CAST(COALESCE(u.n, 0) AS BIGINT) AS used, CAST(q.quota AS INTEGER) AS quota, CAST(greatest(q.quota - COALESCE(u.n, 0), 0) AS BIGINT) AS remaining
    FROM (SELECT DISTINCT day FROM u) d CROSS JOIN q LEFT JOIN u ON u.day = d.day AND u.category = q.category""",
)
def quota_remaining(spark: SparkSession, d: str) -> DataFrame:
    return statistics.remaining_quota(usage_by_day(spark, d), lexicon.DAILY_QUOTA)


@query(
    "bucket_pick",
    """WITH u AS (SELECT category, count(*) AS n FROM articles GROUP BY 1), o AS (SELECT category, n % 3 AS r FROM u)
    SELECT article_id, COALESCE(r, 0) <= 0 AS fallback FROM articles LEFT JOIN o USING (category) ORDER BY 2, score DESC NULLS LAST, article_id LIMIT 5""",
)
def bucket_pick(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "articles")
    room = rows.groupBy("category").agg((F.count("*") % 3).alias("remaining"))
    order = [F.col("score").desc_nulls_last(), F.col("article_id")]
    return selection.best_in_open_bucket(rows, room, "category", order, 5).select("article_id", "fallback")


@query(
    "source_health",
    """SELECT name, CAST(count(a.article_id) AS BIGINT) AS n, count(a.article_id) > 0 AS ok FROM rss_sources s LEFT JOIN articles a ON a.source = s.name GROUP BY 1""",
)
def source_health(spark: SparkSession, d: str) -> DataFrame:
    return statistics.source_health(table(spark, d, "rss_sources"), table(spark, d, "articles").select("source"))


@query("top_sources", "SELECT source, CAST(count(*) AS BIGINT) AS n FROM articles WHERE source IS NOT NULL GROUP BY 1 ORDER BY n DESC, source LIMIT 10")
def top_sources(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "articles").where("source is not null").groupBy("source").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "source").limit(10)


@query(
    "source_cap_25",
    """SELECT article_id FROM (SELECT article_id, row_number() OVER (PARTITION BY source ORDER BY fetched_at, article_id) AS rn FROM articles) WHERE rn <= 25""",
)
def source_cap_25(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "articles").select("article_id", "source", "fetched_at")
    return selection.capped_per_source(rows, "source", [F.col("fetched_at"), F.col("article_id")]).select("article_id")


# ------------------------------------------------------------------------------------------- windows and slots
@query(
    "round_robin",
    f"""WITH r AS (SELECT article_id, category, row_number() OVER (PARTITION BY category ORDER BY score DESC NULLS LAST, article_id) AS turn,
      COALESCE(list_position({sql_list(lexicon.CATEGORIES)}, category), 6) AS o FROM articles)
    SELECT article_id, CAST(turn AS BIGINT) AS turn, CAST(row_number() OVER (ORDER BY turn, o, COALESCE(category, '')) AS BIGINT) AS pos FROM r""",
)
def round_robin(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "articles").select("article_id", "category", "score")
    return selection.round_robin(rows, "category", [F.col("score").desc_nulls_last(), F.col("article_id")], lexicon.CATEGORIES).select("article_id", "turn", "pos")


@query(
    "running_cap_2",
    """WITH a AS (SELECT source, count(*) % 2 AS n FROM posted_history p JOIN articles USING (canonical_url) GROUP BY 1),
    r AS (SELECT article_id, source, row_number() OVER (PARTITION BY source ORDER BY score DESC NULLS LAST, article_id) AS rn FROM articles WHERE source IS NOT NULL)
    SELECT article_id FROM r LEFT JOIN a USING (source) WHERE rn + COALESCE(n, 0) <= 2""",
)
def running_cap_2(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "articles").where("source is not null").select("article_id", "source", "score", "canonical_url")
    queued = table(spark, d, "posted_history").select("canonical_url").join(rows, "canonical_url").groupBy("source").agg((F.count("*") % 2).alias("n"))
    return selection.running_cap(rows, "source", [F.col("score").desc_nulls_last(), F.col("article_id")], 2, queued).select("article_id")


_SLOTS = "SELECT CAST(epoch_ms(TIMESTAMPTZ '2026-10-01 00:00:00+00:00') AS BIGINT) + h * 3600000 AS slot FROM range(1, 73) t(h) WHERE h % 24 <= 17 ORDER BY h LIMIT 18"


@query("next_slots", f"SELECT slot AS slot_ms FROM ({_SLOTS})")
def next_slots(spark: SparkSession, d: str) -> DataFrame:
    one = table(spark, d, "region").limit(1).select(F.explode(selection.next_slots(now(), 18)).alias("slot"))
    return one.select(F.unix_millis("slot").alias("slot_ms"))


@query(
    "slot_assignment",
    f"""WITH s AS ({_SLOTS}), open AS (SELECT slot, row_number() OVER (ORDER BY slot) AS rank FROM s WHERE (slot // 3600000) % 5 <> 0),
    c AS (SELECT article_id, row_number() OVER (ORDER BY score DESC NULLS LAST, article_id) AS rank FROM articles)
    SELECT CAST(rank AS INTEGER) AS rank, article_id, slot AS slot_ms FROM open JOIN c USING (rank)""",
)
def slot_assignment(spark: SparkSession, d: str) -> DataFrame:
    slots = next_slots(spark, d).select(F.col("slot_ms").alias("slot"))
    taken = slots.where("(slot div 3600000) % 5 = 0")
    rows = table(spark, d, "articles").select("article_id", "score")
    order = [F.col("score").desc_nulls_last(), F.col("article_id")]
    return selection.assign_slots(rows, slots, taken, order).select("rank", "article_id", F.col("slot").alias("slot_ms"))


@query(
    "slot_refill",
    f"""WITH s AS ({_SLOTS}), open AS (SELECT slot, row_number() OVER (ORDER BY slot) AS rank FROM s),
    c AS (SELECT article_id, row_number() OVER (ORDER BY score DESC NULLS LAST, article_id) AS rank FROM articles),
    f AS (SELECT slot, row_number() OVER (ORDER BY slot) AS r FROM open JOIN c USING (rank) WHERE article_id % 2 = 0)
    SELECT CAST(f.r AS INTEGER) AS rank, f.slot AS slot_ms, c.article_id FROM f JOIN c ON c.rank = f.r + 18""",
)
def slot_refill(spark: SparkSession, d: str) -> DataFrame:
    slots = next_slots(spark, d).select(F.col("slot_ms").alias("slot"))
    rows = table(spark, d, "articles").select("article_id", "score")
    order = [F.col("score").desc_nulls_last(), F.col("article_id")]
    first = selection.assign_slots(rows, slots, slots.where("false"), order)
    spare = rows.orderBy(*order).offset(18)
    return selection.refill_failed(first, spare, F.col("article_id") % 2 != 0, order).select("rank", F.col("slot").alias("slot_ms"), "article_id")


@query("newest_200", "SELECT event_id FROM events ORDER BY ts DESC, event_id LIMIT 200")
def newest_200(spark: SparkSession, d: str) -> DataFrame:
    return dedup.newest(table(spark, d, "events"), [F.desc("ts"), F.col("event_id")], 200).select("event_id")


@query(
    "retry_order",
    "SELECT article_id, CAST(row_number() OVER (ORDER BY COALESCE(priority <= 2, FALSE) DESC, score DESC NULLS LAST, article_id) AS BIGINT) AS attempt FROM articles",
)
def retry_order(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "articles").select("article_id", "priority", "score")
    return selection.retry_order(rows, F.col("priority") <= 2, [F.col("score").desc_nulls_last(), F.col("article_id")]).select("article_id", "attempt")


# ------------------------------------------------------------------------------------------------------- state
@query("latest_per_key", "SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id FROM events GROUP BY 1")
def latest_per_key(spark: SparkSession, d: str) -> DataFrame:
    return state.latest(table(spark, d, "events").select("user_id", "event_id", "ts"), ["user_id"], ["ts", "event_id"]).select("user_id", "event_id")


@query(
    "live_keys",
    """SELECT user_id FROM (SELECT user_id, arg_max(ts, (ts, event_id)) AS ts FROM events GROUP BY 1)
    WHERE ts + INTERVAL 2 DAY > (SELECT max(ts) FROM events)""",
)
def live_keys(spark: SparkSession, d: str) -> DataFrame:
    log = table(spark, d, "events").select("user_id", "event_id", "ts", (F.col("ts") + F.expr("INTERVAL 2 DAY")).alias("expires_ts"))
    moment = log.agg(F.max("ts").alias("_now"))
    rows = state.latest(log, ["user_id"], ["ts", "event_id"]).join(F.broadcast(moment))  # one row
    return rows.where("expires_ts > _now").select("user_id")


@query(
    "failure_streaks",
    """WITH e AS (SELECT user_id, (ts, event_id) AS w, event_type = 'error' AS f FROM events), s AS (SELECT user_id, max(w) AS last FROM e WHERE NOT f GROUP BY 1)
    SELECT user_id, CAST(count(*) FILTER (WHERE f AND (last IS NULL OR w > last)) AS BIGINT) AS streak FROM e LEFT JOIN s USING (user_id) GROUP BY 1""",
)
def failure_streaks(spark: SparkSession, d: str) -> DataFrame:
    return statistics.last_streak(table(spark, d, "events"), "user_id", ["ts", "event_id"], F.col("event_type") == "error")


@query(
    "longest_streaks",
    """WITH g AS (SELECT user_id, event_type = 'error' AS f, sum(CASE WHEN event_type = 'error' THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS g FROM events)
    SELECT user_id, CAST(max(n) AS BIGINT) AS longest FROM (SELECT user_id, g, count(*) FILTER (WHERE f) AS n FROM g GROUP BY 1, 2) GROUP BY 1""",
)
def longest_streaks(spark: SparkSession, d: str) -> DataFrame:
    return statistics.longest_streak(table(spark, d, "events"), "user_id", ["ts", "event_id"], F.col("event_type") == "error")


@query(
    "throttled_alerts",
    """WITH RECURSIVE e AS (SELECT event_type, ts FROM events GROUP BY 1, 2), p AS (
      SELECT event_type, min(ts) AS ts FROM e GROUP BY 1
      UNION ALL SELECT event_type, nxt FROM (SELECT p.event_type, (SELECT min(e.ts) FROM e WHERE e.event_type = p.event_type AND e.ts >= p.ts + INTERVAL 6 HOUR) AS nxt FROM p) q WHERE nxt IS NOT NULL)
    SELECT event_type, CAST(epoch_us(ts) // 1000 AS BIGINT) AS at_ms FROM p""",
)
def throttled_alerts(spark: SparkSession, d: str) -> DataFrame:
    passed = state.throttled(table(spark, d, "events"), "event_type", "ts", 6 * 3600)
    return passed.select("event_type", F.unix_millis("ts").alias("at_ms"))


@query("hourly_slots", "SELECT strftime(ts, 'queue:%Y-%m-%dT%H') AS slot, event_type, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY 1, 2")
def hourly_slots(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy(times.slot_key(F.col("ts")).alias("slot"), "event_type").agg(F.count("*").alias("n"))


# ------------------------------------------------------------------- relational checks (not operators of curation)
@query(
    "check_pricing_summary",
    """SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, CAST(count(*) AS BIGINT) AS n
    FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2""",
)
def check_pricing_summary(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").where("l_shipdate <= timestamp_ntz'1998-09-02'")
    money = F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount")))
    return rows.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("qty"), F.round(money, 2).alias("revenue"), F.count("*").alias("n"))


@query(
    "check_nation_orders",
    """SELECT n_name, CAST(count(*) AS BIGINT) AS orders FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey GROUP BY 1""",
)
def check_nation_orders(spark: SparkSession, d: str) -> DataFrame:
    t = lambda n: table(spark, d, n)
    joined = t("orders").join(t("customer"), F.col("c_custkey") == F.col("o_custkey")).join(t("nation"), F.col("n_nationkey") == F.col("c_nationkey"))
    return joined.groupBy("n_name").agg(F.count("*").alias("orders"))


@query(
    "check_top_orders",
    "SELECT o_custkey, o_orderkey FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders) WHERE rn <= 2",
)
def check_top_orders(spark: SparkSession, d: str) -> DataFrame:
    rank = F.row_number().over(W.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey"))
    return table(spark, d, "orders").withColumn("rn", rank).where("rn <= 2").select("o_custkey", "o_orderkey")


@query(
    "last_posted",
    f"WITH {POSTED_VIEW} SELECT tz, arg_max(entry_id, (posted_ms, entry_id)) AS entry_id, CAST(max(posted_ms) AS BIGINT) AS posted_ms FROM posted WHERE posted_ms IS NOT NULL GROUP BY 1",
)
def last_posted(spark: SparkSession, d: str) -> DataFrame:
    """The last entry of each writer's zone, by the instant that its text stands for."""
    text = F.col("posted_at")
    stated = F.when(is_canonical(text), F.unix_millis(F.try_to_timestamp(text)))
    at = F.coalesce(stated, instant_ms(F.when(~is_canonical(text), text), F.col("tz"), F.lit("dmy")))
    rows = table(spark, d, "posted_history").select("tz", "entry_id", at.alias("posted_ms")).where("posted_ms is not null")
    return state.latest(rows, ["tz"], ["posted_ms", "entry_id"]).select("tz", "entry_id", "posted_ms")


@query(
    "queue_listing",
    f"""WITH q AS (SELECT strftime(fetched_at AT TIME ZONE 'UTC', 'queue:%Y-%m-%dT%H') AS slot, arg_max(article_id, (fetched_at, article_id)) AS article_id, max(epoch_us(fetched_at)) // 1000 AS ms
    FROM articles GROUP BY 1) SELECT slot, article_id, CAST(floor(({NOW_MS} - ms) / 60000.0::DOUBLE + 0.5) AS BIGINT) AS age_min FROM q""",
)
def queue_listing(spark: SparkSession, d: str) -> DataFrame:
    """The last payload of every slot with its age in minutes."""
    log = table(spark, d, "articles").select(times.slot_key(F.col("fetched_at")).alias("slot"), "article_id", "fetched_at")
    rows = state.latest(log, ["slot"], ["fetched_at", "article_id"])
    return rows.select("slot", "article_id", state.age_minutes(F.col("fetched_at"), now()).cast("long").alias("age_min"))


@query(
    "source_status",
    "SELECT CAST(count(*) AS BIGINT) AS total, CAST(count(*) FILTER (WHERE n > 0) AS BIGINT) AS ok_n, CAST(count(*) FILTER (WHERE n = 0) AS BIGINT) AS failed_n, COALESCE(string_agg(name, ', ' ORDER BY name) FILTER (WHERE n = 0), '') AS status FROM (SELECT name, count(a.article_id) AS n FROM rss_sources s LEFT JOIN articles a ON a.source = s.name AND a.score > 320 GROUP BY 1)",
)
def source_status(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "articles").where("score > 320").select("source")
    return statistics.outcome_summary(statistics.source_health(table(spark, d, "rss_sources"), rows))
