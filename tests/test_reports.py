"""Captions, reports, alerts, events and pages: against plain Python on small fixtures."""

import html as plain
import json
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from threading import Thread

import pytest
from pyspark.sql import functions as F

from millrace.functions import captions, html
from millrace.operators import reports, selection, statistics
from millrace.sinks import delivery
from millrace.sources import events, feeds, pages
from tests.conftest import rows


def units(text):
    return len(text.encode("utf-16-le")) // 2


def esc(text):
    return plain.escape(text, quote=False)


def cut(text, budget):
    if units(esc(text)) <= budget:
        return esc(text)
    kept = ""
    for c in text:
        if units(esc(kept + c)) + 3 > budget:
            break
        kept += c
    return esc(kept) + "..."


def bullets(items, budget):
    if not items or budget < 10:
        return ""
    for n in range(len(items), 0, -1):
        left, lines = budget, []
        for i, x in enumerate(items[:n]):
            last = i == n - 1
            cost = 2 + units(esc(x)) + (not last)
            if cost <= left:
                lines.append("• " + esc(x))
                left -= cost
            elif last and left > 12:
                lines.append("• " + cut(x, left - 2))
            else:
                break
        if len(lines) == n:
            return "\n".join(lines)
    return ""


@pytest.mark.parametrize("items", [[], ["one"], ["a & b < c", "second one that is longer", "🐝" * 20], ["x" * 200, "y"], None])
def test_bullets(spark, items):
    df = spark.createDataFrame([(items, b) for b in (5, 12, 13, 20, 40, 60, 90, 400)], "items array<string>, b int")
    for b, text in df.select("b", captions.rendered_bullets(F.col("items"), F.col("b"))).collect():
        assert text == bullets(items, b), b
        assert units(text) <= max(b, 0)


def caption(t, items, why, brief, tags, link, limit, sign):
    title, reason = f"<b>{esc(t)}</b>", f"<b>Why it matters:</b> {esc(why)}"
    href, shown = plain.escape(link).replace("&#x27;", "'"), esc(link)
    short = f"<i>In short:</i> {esc(brief)}" if brief else ""
    marks = " ".join("#" + x for x in tags)
    anchor = lambda s: f'<a href="{href}">{s}</a>'
    room = lambda *more: limit - sum(map(units, (title, reason, anchor(shown), sign))) - 8 - sum(units(m) + 2 for m in more if m)
    if room(short, marks) < 30:
        marks = ""
    if not marks and room(short) < 30:
        short = ""
    if not marks and not short and room() < 30:
        spare = limit - sum(map(units, (title, reason, sign, anchor("")))) - 8 - 30
        if spare > 20 and units(shown) > spare:
            shown = shown[: spare - 3] + "..."
    parts = [title, bullets(items, room(short, marks)), reason, short, anchor(shown), sign, marks]
    return "\n\n".join(p for p in parts if p)


def test_captions(spark):
    sign = captions.signature("Daily", "daily")
    data = [("A & B", ["one bullet", "two <bullets>"], "because", "brief & short", ["AI", "Open"], "https://x.example/a?b=1&c=2"), ("T", ["only"], "w" * 200, "", [], "https://x.example/" + "p" * 150), ("T", [], "w", "b", ["x"], "l")]
    df = spark.createDataFrame(data, "title string, bullets array<string>, why string, brief string, tags array<string>, link string")
    for limit in (170, 230, 260, 290, 330, 420, 1024):
        got = [r.caption for r in captions.captioned(df, limit, sign).select("caption").collect()]
        assert got == [caption(*d, limit, sign) for d in data], limit
    nulls = spark.createDataFrame([(None, None, None, None, None, None)], df.schema)
    assert "<b></b>" in captions.captioned(nulls, 500, sign).first().caption
    assert captions.captioned(df, 300, sign).columns == [*df.columns, "caption"]
    assert captions.signature("D") == "— <b>D</b>"


def test_reports_and_alerts(spark):
    health = spark.createDataFrame([("b", 0, False), ("a", 4, True), ("c", 9, True), ("d", 0, False)], "name string, n long, ok boolean")
    assert rows(reports.source_report(health), "pos", "name", "failed_n") == [(1, "b", 2), (2, "d", 2), (3, "c", 2), (4, "a", 2)]
    assert reports.as_text(health, F.col("name"), ["name"], 3).first().text == "a\nb\nc"
    runs = spark.createDataFrame([(1, 12, 5), (2, 11, 6), (3, 12, 9)], "run int, failed int, queued int")
    assert rows(reports.refill_alerts(runs)) == [(1, "exhausted"), (1, "low"), (3, "exhausted")]
    streaks = spark.createDataFrame([("a", 2), ("b", 3)], "k string, streak int")
    assert rows(reports.streak_alerts(streaks), "k") == [("b",)]
    usage = spark.createDataFrame([("2026-01-01", "x", 3), ("2026-01-01", "z", 1)], "day string, category string, n long")
    assert rows(reports.usage_lines(usage, {"y": 2, "x": 3})) == [("2026-01-01", "y 0/2, x 3/3(full)", 3, 5)]
    queue = spark.sql("select explode(sequence(timestamp'2026-01-02 05:00:00', timestamp'2026-01-03 09:00:00', interval 1 hour)) as slot")
    assert str(selection.earliest_slot(queue, 6).first().slot) == "2026-01-02 06:00:00"
    lists = spark.createDataFrame([(["a", "b"],), (None,)], "l array<string>")
    assert [r[0] for r in lists.select(selection.prepended(F.lit("n"), F.col("l"), 2)).collect()] == [["n", "a"], ["n"]]
    first, rest = selection.split_pool(spark.range(5), [F.desc("id")], 2)
    assert rows(first) == [(3,), (4,)] and rows(rest) == [(0,), (1,), (2,)]


def test_percentiles_of_groups(spark):
    data = [("a", 1.0), ("a", 2.0), ("a", 4.0), ("b", 5.0), (None, 7.0), ("a", float("nan")), ("a", float("inf")), ("c", None)]
    df = spark.createDataFrame(data, "g string, v double")
    got = {r.g: (r.n, r.lo, r.mid, r.hi) for r in statistics.percentiles_by(df, "g", "v", {"lo": 0.0, "mid": 0.4, "hi": 2.0}).collect()}
    assert got == {"a": (3, 1.0, 1.8, 4.0), "b": (1, 5.0, 5.0, 5.0), None: (1, 7.0, 7.0, 7.0)}
    thresholds = {r.g: r.threshold for r in statistics.adaptive_thresholds(df, "g", "v", least=2).collect()}
    assert thresholds == {"a": 170, "b": 195, None: 195, "c": 195}
    assert statistics.percentiles_by(df.where("false"), "g", "v", {"p": 0.5}).count() == 0


def test_posts_fall_back_to_text_for_the_image_only(spark):
    def send_image(row):
        return {1: (200, None, "ok"), 2: (400, None, "Bad Request: WRONG file identifier"), 3: (400, None, "chat not found"), 5: (403, None, "photo url")}[row["id"]]

    df = spark.createDataFrame([(1, "i"), (2, "i"), (3, "i"), (4, None), (5, "i")], "id long, image string")
    got = rows(delivery.deliver_posts(df, "id", "image", send_image, lambda r: (200, None, "ok")), "id", "sent_as", "status", "attempts")
    assert got == [(1, "image", 200, 1), (2, "text", 200, 2), (3, "image", 400, 1), (4, "text", 200, 1), (5, "image", 403, 1)]
    sent = []
    assert delivery.alert("x", " a ", lambda r: sent.append(r) or (200, None, "ok")) and sent == [{"target": "a", "text": "x"}]
    assert not delivery.alert("x", None, lambda r: 1 / 0) and not delivery.alert("x", "a", lambda r: 1 / 0)


def test_events(spark, tmp_path):
    lines = [json.dumps({"update_id": i, "kind": "k", "text": "é"}) for i in range(3)] + ["{broken", "", json.dumps({"kind": "no id"})]
    (tmp_path / "a.jsonl").write_text("\n".join(lines))
    q = events.event_stream(spark, str(tmp_path)).writeStream.format("memory").queryName("seen").trigger(availableNow=True).start()
    q.awaitTermination()
    assert rows(spark.table("seen"), "update_id", "text") == [(0, "é"), (1, "é"), (2, "é")]


def test_pages(spark):
    def get(address, most):
        if "gone" in address:
            return 404, "text/html", b"x", address
        if "boom" in address:
            raise OSError("no route")
        kind = "image/png" if "png" in address else "Text/HTML; charset=utf-8"
        return 200, kind, (b"<head><meta property='og:image' content='/i.png'></head>" + "é".encode() * most)[:most], address + "/final/"

    data = [(1, "https://a.example/p", None), (2, "https://a.example/gone", ""), (3, "https://a.example/x.png", None), (4, "ftp://a.example", None), (5, "https://a.example/q", "have"), (6, "https://boom.example", None), (7, None, None)]
    df = spark.createDataFrame(data, "id long, link string, image string")
    found = pages.read_pages(df, "id", "link", get, most=101).collect()
    assert sorted(r.id for r in found) == [1, 5] and all(len(r.html.encode()) <= 104 for r in found)
    assert rows(pages.with_page_images(df, "id", "link", "image", get), "id", "image") == [(1, "https://a.example/i.png"), (2, None), (3, None), (4, None), (5, "have"), (6, None), (7, None)]


def test_a_scan_of_feeds_over_the_network(spark):
    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):  # noqa: N802
            good = self.path == "/rss"
            body = b"<rss><channel><item><title>One &amp; two</title><link>https://a.example/1?utm_source=x</link><pubDate>2025-08-01T10:00:00Z</pubDate></item></channel></rss>"
            self.send_response(200 if good else 500)
            self.end_headers()
            self.wfile.write(body if good else b"")

        def log_message(self, *args):
            pass

    server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_port}"
    data = [("good", f"{base}/rss", "core", 1, "UTC", "dmy"), ("bad", f"{base}/gone", "ai", 2, None, None), ("dead", "http://127.0.0.1:9/", "ai", 2, None, None), ("none", None, "ai", 2, None, None)]
    registry = spark.createDataFrame(data, "name string, url string, category string, priority int, feed_tz string, date_order string")
    found = feeds.scan_feeds(spark, registry, timeout=2)
    assert rows(found, "source", "title", "canonical_url", "category") == [("good", "One & two", "https://a.example/1", "core")]
    assert rows(statistics.source_health(registry, found), "name", "ok") == [("bad", False), ("dead", False), ("good", True), ("none", False)]
    server.shutdown()


def test_nested_text_and_attributes(spark):
    df = spark.createDataFrame([("No. <b>1</b> of <i>x<u>y</u></i>", """<IMG alt='>' data-x="1" SRC = 'a.png'><img src="b.png">"""), ("1 < 2", "<p>none</p>"), (None, None)], "t string, h string")
    assert [tuple(r) for r in df.select(feeds.node_text(F.col("t")), html.first_image(F.col("h"))).collect()] == [("No. 1 of xy", "b.png"), ("1 < 2", None), (None, None)]
