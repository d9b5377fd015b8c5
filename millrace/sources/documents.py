"""Readers of JSON histories, queued payloads, capped JSON lists and stored pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

HISTORY = "entries array<struct<url:string,canonicalUrl:string,title:string,postedAt:string>>"
PAYLOAD = (
    "article struct<title:string,link:string,canonicalUrl:string,pubDate:string,source:string,sourceCategory:string,sourcePriority:int,"
    "contentSnippet:string,imageUrl:string,score:int,titleHash:string>, summary struct<title:string,bullets:array<string>,whyItMatters:string,"
    "enTldr:string,hashtags:array<string>>, generatedAt string, scheduledFor string, aiProvider string"
)


def read_history(spark: SparkSession, path: str) -> DataFrame:
    """(url, canonical_url, title, posted_at) of a JSON history document; no file, no rows."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)
    if not there:
        return spark.createDataFrame([], "url string, canonical_url string, title string, posted_at string")
    rows = spark.read.schema(HISTORY).json(path, multiLine=True).select(F.explode("entries").alias("e"))
    return rows.select("e.url", F.col("e.canonicalUrl").alias("canonical_url"), "e.title", F.col("e.postedAt").alias("posted_at"))


def parse_payloads(rows: DataFrame, value: str = "value") -> DataFrame:
    """Queued payloads with their article and summary; corrupt ones are left out."""
    read = rows.withColumn("_p", F.from_json(value, PAYLOAD))
    return read.where("_p.article.link is not null and _p.generatedAt is not null").select(*[c for c in rows.columns if c != value], "_p.*")


def payload_text(article: Column, summary: Column, generated_at: Column, scheduled_for: Column, provider: Column) -> Column:
    return F.to_json(F.struct(article.alias("article"), summary.alias("summary"), generated_at.alias("generatedAt"), scheduled_for.alias("scheduledFor"), provider.alias("aiProvider")))


def parse_capped_list(rows: DataFrame, value: str, item: str, required: list[str]) -> DataFrame:
    """Items of JSON lists; lists that don't parse are empty, items without a required field are dropped."""
    items = F.explode(F.coalesce(F.from_json(value, f"array<{item}>"), F.array().cast(f"array<{item}>")))
    read = rows.select(items.alias("i")).select("i.*")
    for k in required:
        read = read.where(F.col(k).isNotNull())
    return read
