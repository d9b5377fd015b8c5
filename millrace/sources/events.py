"""Events that arrive as JSON texts, from files, a stream of files or a column."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENT = "update_id long, chat_id long, kind string, text string, at string"


def parse_events(rows: DataFrame, value: str = "value", schema: str = EVENT, required: tuple[str, ...] = ("update_id",)) -> DataFrame:
    """The fields of each JSON text; texts that don't parse or lack a required field are left out."""
    read = rows.select(F.from_json(value, schema).alias("e")).where("e is not null").select("e.*")
    for k in required:
        read = read.where(F.col(k).isNotNull())
    return read


def event_stream(spark: SparkSession, path: str, schema: str = EVENT) -> DataFrame:
    """A stream of the events in the JSON-lines files that arrive in a folder; each file once."""
    lines = spark.readStream.schema("value string").text(path)
    return parse_events(lines, "value", schema)
