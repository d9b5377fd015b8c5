"""Feed reading: RSS 2.0, Atom and bare-channel XML texts to the article relation, in built-in XML functions.

Texts come from files (one a feed), from a table, or from the network through the ``feed`` data source (one partition a
source, any error gives an empty feed). A document that can't be parsed gives no rows.
"""

from __future__ import annotations

import urllib.request
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from millrace.functions.html import decoded, first_image, stripped
from millrace.functions.url import canonical_url, trim_white
from millrace.operators.timestamps import instant_ms

ITEMS_A_FEED, NEWEST = 25, 200
TIMEOUT_S = 18

_ITEM = (
    "struct<title:string, link:array<struct<_VALUE:string,_href:string,_rel:string>>, pubDate:string, published:string, updated:string,"
    " `dc:date`:string, description:string, `content:encoded`:string, content:string, summary:string,"
    " `media:content`:array<struct<_url:string>>, `media:thumbnail`:array<struct<_url:string>>, enclosure:array<struct<_url:string>>>"
)
_FEED = f"channel struct<item:array<{_ITEM}>>, entry array<{_ITEM}>, item array<{_ITEM}>"


def _first(items: Column, field: str) -> Column:
    """First value of a field that isn't empty."""
    return F.get(F.filter(F.transform(items, lambda x: x[field]), lambda v: v.isNotNull() & (v != "")), F.lit(0))


def picked_link(links: Column) -> Column:
    """Address or text of the first link without relation or of relation 'alternate'; else of the first link."""
    plain = F.filter(links, lambda x: x["_rel"].isNull() | (x["_rel"] == "") | (x["_rel"] == "alternate"))
    value = lambda xs: F.transform(xs, lambda x: F.coalesce(F.nullif(F.trim(x["_href"]), F.lit("")), F.nullif(trim_white(x["_VALUE"]), F.lit(""))))
    return F.coalesce(F.get(F.filter(value(plain), lambda v: v.isNotNull()), F.lit(0)), F.get(value(links), F.lit(0)), F.lit(""))


def picked_date(item: Column, zone: Column, order: Column) -> Column:
    """UTC instant of the first field that isn't blank; the epoch where it has none, so that undated items are the oldest."""
    text = F.coalesce(*[F.nullif(trim_white(item[k]), F.lit("")) for k in ("pubDate", "published", "updated", "dc:date")])
    return F.timestamp_millis(F.coalesce(instant_ms(text, zone, order), F.lit(0).cast("long")))


def node_text(value: Column) -> Column:
    """Text of an element that was read as a string: of nested elements the texts only, one after the other."""
    return F.regexp_replace(value, r"</?[A-Za-z][^<>]*>", "")


def picked_image(item: Column) -> Column:
    html = F.coalesce(*[F.when(item[k] != "", item[k]) for k in ("content:encoded", "description", "content", "summary")])
    return F.coalesce(_first(item["media:content"], "_url"), _first(item["media:thumbnail"], "_url"), _first(item["enclosure"], "_url"), first_image(decoded(html)))


def picked_snippet(item: Column) -> Column:
    """Plain text of the first body field that isn't blank."""
    fields = [item["description"], item["content:encoded"], item["content"], item["summary"]]
    return F.coalesce(stripped(F.coalesce(*[F.when(trim_white(f) != "", f) for f in fields])), F.lit(""))


def parse_feeds(feeds: DataFrame, most: int = ITEMS_A_FEED) -> DataFrame:
    """Articles of feeds (name, category, priority, feed_tz, date_order, xml): the first *most* items of each document,
    counted before items without title or link are dropped."""
    parsed = feeds.withColumn("_f", F.from_xml("xml", _FEED, {"mode": "PERMISSIVE", "rowTag": "rss"}))
    items = F.coalesce(F.col("_f.channel.item"), F.col("_f.entry"), F.col("_f.item"))
    rows = parsed.select("name", "category", "priority", "feed_tz", "date_order", F.posexplode(F.slice(items, 1, most)).alias("position", "i"))
    i = F.col("i")
    read = rows.select(
        trim_white(decoded(node_text(i["title"]))).alias("title"), picked_link(i["link"]).alias("link"), picked_date(i, F.coalesce("feed_tz", F.lit("UTC")), F.col("date_order")).alias("pub_ts"),
        F.col("name").alias("source"), "category", "priority", picked_snippet(i).alias("snippet"), picked_image(i).alias("image_url"), "position",
    )
    return read.where("title <> '' and link <> ''").withColumn("canonical_url", canonical_url(F.col("link")))


def newest_articles(articles: DataFrame, cap: int = NEWEST) -> DataFrame:
    return articles.orderBy(F.desc("pub_ts"), "source", "position").limit(cap)


def read_feed_files(spark: SparkSession, path: str, registry: DataFrame) -> DataFrame:
    """Articles of XML files named <source>.xml under *path*."""
    texts = spark.read.text(path, wholetext=True).select(F.regexp_extract(F.col("_metadata.file_name"), r"([^/]+)\.xml$", 1).alias("name"), F.col("value").alias("xml"))
    return parse_feeds(texts.join(registry, "name"))


def scan_feeds(spark: SparkSession, registry: DataFrame, timeout: float = TIMEOUT_S, most: int = ITEMS_A_FEED) -> DataFrame:
    """Articles of all feeds of a registry (name, url, category, priority, feed_tz, date_order), read over the network, one
    task a feed. A feed that can't be had or read has none. The registry's names and addresses are the scan's options."""
    spark.dataSource.register(FeedDataSource)
    known = registry.select("name", "url").where("name is not null and url is not null").collect()  # a row a feed
    options = {"names": "\n".join(r.name for r in known), "urls": "\n".join(r.url for r in known), "timeout": str(timeout)}
    texts = spark.read.format("feed").options(**options).load()
    return parse_feeds(texts.join(F.broadcast(registry.select("name", "category", "priority", "feed_tz", "date_order")), "name"), most)


class _Source(InputPartition):
    def __init__(self, name: str, url: str):
        self.name, self.url = name, url


class _FeedReader(DataSourceReader):
    def __init__(self, options: dict):
        names, urls = options.get("names", "").split("\n"), options.get("urls", "").split("\n")
        self.sources = [_Source(n, u) for n, u in zip(names, urls) if u]
        self.timeout = float(options.get("timeout", TIMEOUT_S))

    def partitions(self) -> list[InputPartition]:
        return self.sources

    def read(self, partition: _Source) -> Iterator[tuple]:
        try:
            ask = urllib.request.Request(partition.url, headers={"Accept": "text/xml, */*"})
            with urllib.request.urlopen(ask, timeout=self.timeout) as r:
                text = r.read().decode(r.headers.get_content_charset() or "utf-8", "replace")
        except Exception:  # whatever went wrong, the feed is empty
            return
        yield (partition.name, text)


class FeedDataSource(DataSource):
    """``spark.read.format("feed").options(names=..., urls=...)``, one per line: (name, xml), one partition a source."""

    @classmethod
    def name(cls) -> str:
        return "feed"

    def schema(self) -> str:
        return "name string, xml string"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _FeedReader(self.options)
