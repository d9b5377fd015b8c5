"""Structured Streaming operators: first-seen keys, tumbling counts, failure counters and throttles with expiry, idempotent
sinks. State lives in the state store; every query takes a checkpoint location, so a restart goes on where it stopped."""

from __future__ import annotations

import sys
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from millrace.operators.state import latest
from millrace.session import remove

# The worker that sets a stateful processor up has only the JVM's path, so processors travel by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def _setting(spark, name: str, value: str):
    before = spark.conf.get(name)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def rocksdb(spark):
    """Queries started within it keep their state in RocksDB, which stateful processors need."""
    return _setting(spark, "spark.sql.streaming.stateStore.providerClass", ROCKS)


def no_idle_batches(spark):
    """For finite runs of queries whose state expires by the clock: these have a batch due at any time and would not end."""
    return _setting(spark, "spark.sql.streaming.noDataMicroBatches.enabled", "false")


def first_seen(stream: DataFrame, key: str, at: str, ttl: str = "30 days") -> DataFrame:
    """Rows whose key wasn't seen within *ttl* of event time."""
    return stream.withWatermark(at, ttl).dropDuplicatesWithinWatermark([key])


def first_seen_again(stream: DataFrame, key: str, at: str, ttl_s: int) -> DataFrame:
    """(key, at): rows whose key was let through no more than *ttl_s* of event time ago don't pass, as with a key that is
    stored when it passes and expires; unlike :func:`first_seen` it is exact within a batch too."""
    return throttled(stream, key, at, ttl_s)


def tumbling_counts(stream: DataFrame, at: str, keys: list[str], width: str = "1 hour", late: str = "30 hours") -> DataFrame:
    """(slot, keys, n) of full windows; rows later than *late* are dropped."""
    counted = stream.withWatermark(at, late).groupBy(F.window(at, width), *keys).agg(F.count("*").alias("n"))
    return counted.select(F.col("window.start").alias("slot"), *keys, "n")


class FailureCounter(StatefulProcessor):
    """(key, n): failures of each key so far; the count is forgotten *ttl_ms* after the last write."""

    def __init__(self, key: str, ttl_ms: int):
        self.key, self.ttl = key, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.count = handle.getValueState("count", "n long", self.ttl)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        n = (self.count.get()[0] if self.count.exists() else 0) + sum(len(r) for r in rows)
        self.count.update((n,))
        yield pd.DataFrame({self.key: [key[0]], "n": [n]})

    def close(self) -> None:
        pass


def failure_counts(stream: DataFrame, key: str, ttl_ms: int = 86_400_000, mode: str = "Update") -> DataFrame:
    """(key, n) whenever a count changes. In mode "Append" the counts of each batch are rows of their own."""
    kind = stream.schema[key].dataType.simpleString()
    return stream.groupBy(key).transformWithStateInPandas(FailureCounter(key, ttl_ms), f"{key} {kind}, n long", mode, "processingTime")


class Throttle(StatefulProcessor):
    """Rows that pass when a kind may pass once in *ms* of event time. Rows of a batch are taken in order of time."""

    def __init__(self, kind: str, at: str, ms: int):
        self.kind, self.at, self.ms = kind, at, ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "us long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        times = sorted(t for r in rows for t in r[self.at])
        last = self.last.get()[0] if self.last.exists() else None
        passed = []
        for t in times:
            us = pd.Timestamp(t).value // 1000
            if last is None or us - last >= self.ms * 1000:
                passed.append(t)
                last = us
        if passed:
            self.last.update((last,))
        yield pd.DataFrame({self.kind: [key[0]] * len(passed), self.at: passed})

    def close(self) -> None:
        pass


def throttled(stream: DataFrame, kind: str, at: str, seconds: int) -> DataFrame:
    schema = f"{kind} {stream.schema[kind].dataType.simpleString()}, {at} {stream.schema[at].dataType.simpleString()}"
    return stream.groupBy(kind).transformWithStateInPandas(Throttle(kind, at, seconds * 1000), schema, "Append", "None")


class SlotQueue(StatefulProcessor):
    """A slot's payload: 'put' keeps the last one, 'take' emits and removes it, 'peek' emits it. Payloads expire."""

    def __init__(self, ttl_ms: int):
        self.ttl = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.payload = handle.getValueState("payload", "payload string", self.ttl)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        out = []
        for r in pd.concat(list(rows)).sort_values("seq").itertuples():
            if r.op == "put":
                self.payload.update((r.payload,))
            else:
                out.append((key[0], r.seq, r.op, self.payload.get()[0] if self.payload.exists() else None))
                if r.op == "take":
                    self.payload.clear()
        yield pd.DataFrame(out, columns=["slot", "seq", "op", "payload"])

    def close(self) -> None:
        pass


def slot_queue(commands: DataFrame, ttl_ms: int = 36 * 3_600_000) -> DataFrame:
    """(slot, seq, op, payload) of the reading commands; commands: (slot STRING, seq LONG, op, payload)."""
    return commands.groupBy("slot").transformWithStateInPandas(SlotQueue(ttl_ms), "slot string, seq long, op string, payload string", "Append", "processingTime")


def append_once(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Every micro-batch goes to a folder of its own number, overwritten if the batch is run again: exactly once."""

    def write(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


#: Log folders that are read one by one before they are folded into the base.
FOLD_AFTER = 20


def claim_and_deliver(stream: DataFrame, key: str, path: str, checkpoint: str, send: Callable[[DataFrame], DataFrame], ttl_s: int = 900) -> StreamingQuery:
    """Claim before the side effect, confirm after it. A batch writes its claims to a log under *path*, delivers what it
    claimed, and writes the outcomes (key, ok) that *send* returns. Not claimed is what was delivered, and what has an open
    claim: a run that died while sending may have delivered it, so it isn't sent again before the claim is *ttl_s* old. What
    failed may be claimed again. The state of a key is its last log row; the log is folded into one row a key now and then, so
    a batch reads the base and at most FOLD_AFTER folders."""

    def run(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        last = claim_states(spark, path, key, batch)
        free = last.where((F.col("state") == "failed") | (F.col("state") == "claimed") & (F.col("at") < F.current_timestamp() - F.make_dt_interval(secs=F.lit(ttl_s))))
        held = last.join(free.select(key), key, "left_anti")
        name = f"{path}/log/{epoch:012}-{uuid.uuid4().hex[:8]}"
        todo = batch.dropDuplicates([key]).join(held.select(key), key, "left_anti").withColumn("state", F.lit("claimed")).withColumn("at", F.current_timestamp())
        todo.write.parquet(f"{name}-a")
        claimed = spark.read.parquet(f"{name}-a").drop("state", "at")
        outcomes = send(claimed).select(key, F.when(F.col("ok"), "done").otherwise("failed").alias("state"), F.current_timestamp().alias("at"))
        outcomes.write.parquet(f"{name}-b")
        _fold(spark, path, key, batch)

    return stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _folders(spark, path: str) -> list[str]:
    """The log's folders, the newest base first, then what came after it; unfinished ones are passed over."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/log")
    fs = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(hadoop):
        return []
    names = sorted(s.getPath().getName() for s in fs.listStatus(hadoop) if fs.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS")))
    bases = [n for n in names if n.endswith("-base")]
    # a base is named after the last folder in it
    return [*bases[-1:], *[n for n in names if not n.endswith("-base") and (not bases or n > bases[-1].removesuffix("-base") + "~")]]


def claim_states(spark, path: str, key: str, like: DataFrame) -> DataFrame:
    """(key, state, at): the last row of each key in the log; state is claimed, done or failed."""
    schema = f"{key} {like.schema[key].dataType.simpleString()}, state string, at timestamp"
    folders = _folders(spark, path)
    if not folders:
        return spark.createDataFrame([], schema)
    order = F.create_map(*[x for i, f in enumerate(folders) for x in (F.lit(f), F.lit(i))])
    log = spark.read.schema(schema).parquet(*[f"{path}/log/{f}" for f in folders]).withColumn("n", order[F.regexp_extract("_metadata.file_path", r"/log/([^/]+)/", 1)])
    return latest(log, [key], ["n", "at"]).select(key, "state", "at")


def _fold(spark, path: str, key: str, like: DataFrame) -> None:
    folders = _folders(spark, path)
    if len(folders) <= FOLD_AFTER:
        return
    base = f"{path}/log/{folders[-1]}-base"
    claim_states(spark, path, key, like).write.mode("overwrite").parquet(base)
    for f in folders:
        remove(spark, f"{path}/log/{f}")


def run_to_table(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Work off all that is available, and read the result."""
    q = stream.writeStream.outputMode(mode).format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)
