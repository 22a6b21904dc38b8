"""Streams that are replayed, repeated and late, against what each row is worth once."""

import datetime as dt
import glob
import os
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import pit
from tidemark.streaming import observations as st

ROW = "series_id string, entity string, event_date date, available_at timestamp_ntz, value double, text_value string, unit string, source string, revision int, meta string"


def observed(n, value, day=1, series="s"):
    return [(series, f"e{i}", dt.date(2024, 1, day), dt.datetime(2024, 2, 1, i), value, None, None, "x", 0, None) for i in range(n)]


def forget(checkpoint, batch):
    """As after a crash between a batch's work and the stream's own note of it."""
    for f in glob.glob(f"{checkpoint}/commits/{batch}") + glob.glob(f"{checkpoint}/commits/.{batch}.crc"):
        os.remove(f)


def test_a_replayed_batch_adds_no_revisions(spark, tmp_path):
    landing, out, state = (str(tmp_path / k) for k in ("landing", "obs", "state"))

    def run(rows=None):
        if rows:
            spark.createDataFrame(rows, ROW).coalesce(1).write.mode("append").parquet(landing)
        st.append_stream(spark.readStream.schema(ROW).parquet(landing), out, state).awaitTermination(120)

    def stored():
        return sorted((r.series_id, r.entity, r.event_date.day, r.value, r.revision) for r in st.observations(spark, out).where("series_id is not null").collect())

    assert st.observations(spark, out).count() == 0
    run(observed(2, 1.0))
    run(observed(2, 2.0) + observed(1, 9.0, day=2) + observed(1, 5.0, series=None))
    want = [("s", "e0", 1, 1.0, 0), ("s", "e0", 1, 2.0, 2), ("s", "e0", 2, 9.0, 0), ("s", "e1", 1, 1.0, 1), ("s", "e1", 1, 2.0, 3)]
    assert stored() == want and st.observations(spark, out).count() == 6
    forget(state, 1)
    run()  # the batch is in the log: nothing happens
    assert stored() == want
    forget(state, 1)
    (marker,) = glob.glob(f"{out}/_commits/*-1")
    for f in glob.glob(f"{marker}/*") + glob.glob(f"{marker}/.*"):
        os.remove(f)
    os.rmdir(marker)  # and as after a crash before the log: half a batch isn't seen, and its second run takes its place
    assert [r[3] for r in stored()] == [1.0, 1.0]
    run()
    assert stored() == want
    other = str(tmp_path / "other-state")  # a second stream into the table has batches of its own
    st.append_stream(spark.readStream.schema(ROW).parquet(landing), out, other).awaitTermination(120)
    assert st.observations(spark, out).count() == 12 and st.observations(spark, out).where("series_id = 's' and event_date = '2024-01-01'").agg(F.max("revision")).first()[0] == 7


def test_a_ledger_never_repeats_a_key(spark, tmp_path):
    landing, out, state = (str(tmp_path / k) for k in ("landing", "ledger", "state"))
    schema = "run_id string, member string, resolved_at timestamp, brier double"
    t = dt.datetime(2024, 7, 1)

    def run(rows=None):
        if rows:
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(landing)
        st.ledger_stream(spark.readStream.schema(schema).parquet(landing), out, state).awaitTermination(120)

    def stored():
        return sorted(((r.run_id, r.member, r.brier) for r in spark.read.parquet(out).collect()), key=str)

    run([("r1", "a", t, 0.1), ("r1", "a", t + dt.timedelta(hours=1), 0.7), (None, "a", t, 0.4), ("r1", None, None, 0.5)])
    run([("r2", "a", t + dt.timedelta(days=400), 0.3)])  # moves any watermark far on
    run([("r1", "a", t + dt.timedelta(days=900), 0.9), ("r3", "b", t - dt.timedelta(days=300), 0.2), (None, "a", t, 0.8), ("r1", None, t, 0.6)])
    want = sorted([("r1", "a", 0.1), (None, "a", 0.4), ("r1", None, 0.5), ("r2", "a", 0.3), ("r3", "b", 0.2)], key=str)
    assert stored() == want
    forget(state, 2)
    run()
    assert stored() == want


def test_a_second_run_of_a_day_revises(spark, tmp_path):
    path, now = str(tmp_path / "obs"), dt.datetime(2024, 7, 1, 18)
    make = lambda v: lambda: spark.createDataFrame([("gold", None, v, "USD"), ("gold", None, v + 1, "USD")], "series_id string, date date, value double, unit string")
    pit.snapshot(spark, {"a": make(1.0), "b": make(10.0)}, path, now).collect()
    pit.snapshot(spark, {"a": make(5.0)}, path, now + dt.timedelta(hours=1)).collect()
    assert sorted((r.revision, r.value) for r in spark.read.parquet(path).collect()) == [(0, 1.0), (1, 2.0), (2, 10.0), (3, 11.0), (4, 5.0), (5, 6.0)]
    assert [r.value for r in pit.as_of(spark.read.parquet(path), "2024-07-01").collect()] == [6.0]


def plain_limiter(requests, limit, span):
    """What a server with a list of times does."""
    seen, out = {}, []
    for client, i, t in sorted(requests, key=lambda r: (r[2], r[1])):
        window = [x for x in seen.get(client, []) if (t - x).total_seconds() < span]
        allowed = len(window) < limit
        if allowed:
            window.append(t)
        seen[client] = window
        out.append((client, i, allowed))
    return sorted(out)


def test_limiter_as_a_server_would(spark, tmp_path):
    landing, state = str(tmp_path / "landing"), str(tmp_path / "state")
    rng, t0 = random.Random(9), dt.datetime(2024, 7, 1)
    requests = [(c, f"{c}{i}", t0 + dt.timedelta(milliseconds=rng.randint(0, 5 * 3600_000))) for c, n in (("busy", 120), ("calm", 6), ("mid", 40)) for i in range(n)]
    requests += [("edge", "x1", t0), ("edge", "x2", t0 + dt.timedelta(hours=1)), ("edge", "x3", t0 + dt.timedelta(hours=1, milliseconds=1)), ("tie", "y2", t0), ("tie", "y1", t0), ("tie", "y3", t0)]
    ordered = sorted(requests, key=lambda r: r[2] + dt.timedelta(seconds=rng.randint(0, 500)))  # out of order by less than the delay
    schema = "client string, id string, ts timestamp"
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        for batch in (ordered[:60], ordered[60:61], ordered[61:], [("end", "z", t0 + dt.timedelta(hours=9))], [("end", "zz", t0 + dt.timedelta(hours=18))]):
            spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(landing)
            st.limited(spark.readStream.schema(schema).parquet(landing), limit=2).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination(180)
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    got = sorted((r.client, r.id, r.allowed) for r in spark.read.parquet(str(tmp_path / "out")).collect() if r.client != "end")
    assert got == plain_limiter(requests, 2, 3600)
    assert {a for c, _, a in got if c == "busy"} == {True, False}


def test_admit_keeps_a_bounded_list():
    verdicts, kept = st.admit(list(range(0, 1000, 10)), [], 3, 100)
    assert len(kept) <= 3 and sum(verdicts) == 30
    assert st.admit([5], [0, 1], 2, 5) == ([True], [1, 5]) and st.admit([], [1], 2, 5) == ([], [1])
