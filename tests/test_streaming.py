from datetime import datetime, timedelta

from pyspark.sql import functions as F

from millrace.operators import state as batch
from millrace.streaming import state
from tests.conftest import rows

T0 = datetime(2026, 1, 1)


def stream_of(spark, tmp_path, data, schema, name="in"):
    path = str(tmp_path / name)
    spark.createDataFrame(data, schema).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(schema).parquet(path)


def test_tumbling_counts_and_first_seen(spark, tmp_path):
    data = [("a", T0), ("a", T0 + timedelta(minutes=30)), ("b", T0 + timedelta(hours=1)), ("a", T0 + timedelta(days=40))]
    s = stream_of(spark, tmp_path, data, "k string, at timestamp")
    counts = state.run_to_table(state.tumbling_counts(s, "at", ["k"], late="1 hour"), str(tmp_path / "o1"), str(tmp_path / "c1"))
    assert rows(counts.select("k", "n")) == [("a", 2), ("b", 1)]  # the last window is still open
    seen = state.run_to_table(state.first_seen(s.select("k", "at"), "k", "at").select("k"), str(tmp_path / "o2"), str(tmp_path / "c2"))
    assert rows(seen) == [("a",), ("b",)]


def test_throttle_equals_batch(spark, tmp_path):
    data = [(k, T0 + timedelta(minutes=37 * i)) for i in range(40) for k in "xy"]
    s = stream_of(spark, tmp_path, data, "k string, at timestamp")
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    with state.rocksdb(spark):
        got = state.run_to_table(state.throttled(s, "k", "at", 6 * 3600), str(tmp_path / "o"), str(tmp_path / "c"))
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") == before
    want = batch.throttled(spark.createDataFrame(data, "k string, at timestamp"), "k", "at", 6 * 3600)
    assert rows(got.select("k", F.unix_millis("at").alias("t"))) == rows(want.select("k", F.unix_millis("at").alias("t")))


def test_claims_are_delivered_once(spark, tmp_path):
    sent = []

    def send(claimed):
        keys = [r.k for r in claimed.collect()]
        sent.extend(keys)
        return claimed.withColumn("ok", F.col("k") != "bad")

    out, check = str(tmp_path / "out"), str(tmp_path / "check")
    s = stream_of(spark, tmp_path, [("a",), ("bad",), ("a",)], "k string")
    state.claim_and_deliver(s, "k", out, check, send).awaitTermination()
    s = stream_of(spark, tmp_path, [("a",), ("bad",), ("c",)], "k string")
    state.claim_and_deliver(s, "k", out, check, send).awaitTermination()
    assert sorted(sent) == ["a", "bad", "bad", "c"]


def test_an_open_claim_isnt_sent_again_until_it_expires(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(state, "FOLD_AFTER", 2)
    out, check, sent = str(tmp_path / "out"), str(tmp_path / "check"), []

    def dies(claimed):
        sent.extend(r.k for r in claimed.collect())
        raise RuntimeError("died while sending")

    def send(claimed):
        sent.extend(r.k for r in claimed.collect())
        return claimed.withColumn("ok", F.lit(True))

    s = stream_of(spark, tmp_path, [("a",), ("b",)], "k string")
    try:
        state.claim_and_deliver(s, "k", out, check, dies).awaitTermination()
    except Exception:
        pass
    assert sorted(sent) == ["a", "b"]
    s = stream_of(spark, tmp_path, [("c",)], "k string")
    state.claim_and_deliver(s, "k", out, check, send).awaitTermination()  # the batch of a and b is run again
    assert sorted(sent) == ["a", "b", "c"]
    states = {r.k: r.state for r in state.claim_states(spark, out, "k", s).collect()}
    assert states == {"a": "claimed", "b": "claimed", "c": "done"}
    s = stream_of(spark, tmp_path, [("a",), ("c",)], "k string")
    state.claim_and_deliver(s, "k", out, check, send, ttl_s=0).awaitTermination()
    assert sorted(sent) == ["a", "a", "b", "c"]
    assert {r.k: r.state for r in state.claim_states(spark, out, "k", s).collect()} == {"a": "done", "b": "claimed", "c": "done"}
    assert len(state._folders(spark, out)) <= 3


def test_slot_queue(spark, tmp_path):
    data = [("s1", 1, "put", "p1"), ("s1", 2, "put", "p2"), ("s1", 3, "peek", None), ("s1", 4, "take", None), ("s1", 5, "take", None), ("s2", 6, "peek", None)]
    s = stream_of(spark, tmp_path, data, "slot string, seq long, op string, payload string")
    with state.rocksdb(spark), state.no_idle_batches(spark):
        got = state.run_to_table(state.slot_queue(s), str(tmp_path / "o"), str(tmp_path / "c"))
    assert rows(got, "seq", "payload") == [(3, "p2"), (4, "p2"), (5, None), (6, None)]


def test_failure_counts(spark, tmp_path):
    s = stream_of(spark, tmp_path, [("a",), ("a",), ("b",)], "k string")
    got = []
    with state.rocksdb(spark), state.no_idle_batches(spark):
        q = state.failure_counts(s, "k").writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True)
        q.foreachBatch(lambda df, i: got.extend(map(tuple, df.collect()))).start().awaitTermination()
    assert sorted(got) == [("a", 2), ("b", 1)]
