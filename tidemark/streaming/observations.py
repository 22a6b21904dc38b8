"""Observations and ledgers as streams. What a batch writes has its own folders and a marker in a commit log, so a batch
that runs again changes nothing."""

from __future__ import annotations

import datetime as dt
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.shared import exists
from ..operators.pit import SCHEMA, with_revisions

#: Folders of a ledger, by a hash of the key; a batch reads those that its keys fall in.
BUCKETS = 64


def _batch_name(spark: SparkSession, checkpoint: str, number: int) -> str:
    """The name of a batch of the stream behind ``checkpoint``: another stream into the same table has other names."""
    meta = spark.read.text(f"{checkpoint}/metadata").first()[0]
    return f"{spark.range(1).select(F.get_json_object(F.lit(meta), '$.id')).first()[0]}-{number}"


def _commit(spark: SparkSession, path: str, name: str) -> None:
    spark.range(1).select(F.lit(name).alias("batch")).coalesce(1).write.mode("overwrite").parquet(f"{path}/_commits/{name}")


def committed(spark: SparkSession, path: str, schema) -> DataFrame | None:
    """Rows under ``path`` of the batches in its commit log, with ``batch`` and what else it is laid out by; None without any.

    A batch that is being written, or was left half written, isn't seen. The log has a row a batch.
    """
    if not exists(spark, f"{path}/_commits"):
        return None
    log = spark.read.schema("batch string").parquet(f"{path}/_commits/*")
    return spark.read.schema(schema).option("basePath", path).parquet(path).join(log, "batch", "left_semi")


def _append(batch: DataFrame, path: str, name: str, layout: list[str]) -> None:
    """Write rows into folders that no other batch has, in place of what an earlier try left there, then commit."""
    batch.withColumn("batch", F.lit(name)).write.partitionBy(*layout, "batch").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)
    _commit(batch.sparkSession, path, name)


def append_batch(batch: DataFrame, path: str, name: str) -> None:
    """Number the observations of ``batch`` on from those committed under ``path``, and append them as ``name``, once.

    A name that is committed changes nothing; one that isn't is written as if for the first time. Equal keys are numbered by arrival,
    entity and value. Folders are months of the event date, and only those of the batch are read.
    """
    spark = batch.sparkSession
    if exists(spark, f"{path}/_commits/{name}"):
        return
    batch = batch.drop("revision").withColumn("month", F.date_format("event_date", "yyyy-MM")).persist()
    try:
        months = [r[0] for r in batch.select("month").distinct().collect()]  # calendar months, not keys
        stored = committed(spark, path, f"{SCHEMA.toDDL()}, month string, batch string")
        keys = "series_id string, event_date date, revision int"
        stored = spark.createDataFrame([], keys) if stored is None else stored.where(F.col("month").isin(months)).select("series_id", "event_date", "revision")
        _append(with_revisions(batch, stored, ["available_at", "entity", "value"]).select(*SCHEMA.fieldNames(), "month"), path, name, ["month"])
    finally:
        batch.unpersist()


def append_stream(arrivals: DataFrame, path: str, checkpoint: str):
    """Start a query that numbers arriving observations on from those under ``path`` and appends them, each batch
    exactly once: a batch that is replayed after a failure is found in the commit log or written over its own first try."""
    return arrivals.writeStream.foreachBatch(lambda batch, number: append_batch(batch, path, _batch_name(batch.sparkSession, checkpoint, number))).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def observations(spark: SparkSession, path: str) -> DataFrame:
    """The observations that ``append_stream`` committed under ``path``."""
    rows = committed(spark, path, f"{SCHEMA.toDDL()}, month string, batch string")
    return spark.createDataFrame([], SCHEMA) if rows is None else rows.select(*SCHEMA.fieldNames())


def record_batch(batch: DataFrame, path: str, name: str, keys: tuple[str, ...] = ("run_id", "member"), at: str = "resolved_at") -> None:
    """Append to the ledger under ``path`` the first row, by ``at``, of each key that it doesn't hold, as ``name``, once.

    A key that was recorded is never recorded again, however much later its repeat comes; null keys are keys.
    """
    spark = batch.sparkSession
    if exists(spark, f"{path}/_commits/{name}"):
        return
    first = W.partitionBy(*keys).orderBy(F.col(at).asc_nulls_last(), *[c for c in sorted(batch.columns) if c not in (*keys, at)])
    batch = batch.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n").withColumn("bucket", F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)).cast("int")).persist()
    try:
        new, stored = batch, committed(spark, path, f"{batch.drop('bucket').schema.toDDL()}, bucket int, batch string")
        if stored is not None:
            touched = [r[0] for r in batch.select("bucket").distinct().collect()]
            known = stored.where(F.col("bucket").isin(touched)).select("bucket", *[F.col(k).alias(f"_{k}") for k in keys])
            same = reduce(lambda a, k: a & batch[k].eqNullSafe(known[f"_{k}"]), keys, batch["bucket"] == known["bucket"])
            new = batch.join(known, same, "left_anti")
        _append(new, path, name, ["bucket"])
    finally:
        batch.unpersist()


def ledger_stream(resolutions: DataFrame, path: str, checkpoint: str, keys: tuple[str, ...] = ("run_id", "member")):
    """Start a query that appends the first resolution of each key to the ledger under ``path``, exactly once: neither a
    replayed batch nor a repeat, whenever it comes, adds a row."""
    return resolutions.writeStream.foreachBatch(lambda batch, number: record_batch(batch, path, _batch_name(batch.sparkSession, checkpoint, number), keys)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, delay: str = "10 minutes", window: str = "1 hour") -> DataFrame:
    """Events and their sum per type in tumbling windows, late ones up to the delay."""
    return events.withWatermark("ts", delay).groupBy(F.window("ts", window), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def sliding_counts(requests: DataFrame, delay: str = "10 minutes", window: str = "1 hour", slide: str = "5 minutes", limit: int | None = None) -> DataFrame:
    """Requests (ts, client) per client in sliding windows; with ``limit``, only windows over it."""
    n = requests.withWatermark("ts", delay).groupBy(F.window("ts", window, slide), "client").agg(F.count("*").alias("n"))
    return n if limit is None else n.where(F.col("n") > limit)


def resolved_once(resolutions: DataFrame, delay: str = "7 days", key: str = "run_id") -> DataFrame:
    """The first row of each run and member (resolved_at) of a stream of resolutions; repeats within the delay are dropped."""
    return resolutions.withWatermark("resolved_at", delay).dropDuplicatesWithinWatermark([key, "member"])


def admit(times: list[int], accepted: list[int], limit: int, span: int) -> tuple[list[bool], list[int]]:
    """Verdicts on requests at ``times``, in order: one is let in where fewer than ``limit`` let in before it are less than
    ``span`` old. With the times that still count."""
    verdicts, kept = [], list(accepted)
    for t in times:
        while kept and t - kept[0] >= span:
            kept.pop(0)
        verdicts.append(len(kept) < limit)
        if verdicts[-1]:
            kept.append(t)
    return verdicts, kept


class Limiter(StatefulProcessor):
    """A client's requests, judged in the order of their times once the watermark has passed them.

    State is the requests that wait, in milliseconds, and at most ``limit`` times of those let in. A timer judges what
    waits; another, a span after the last one let in, clears the client.
    """

    def __init__(self, limit: int, span_ms: int):
        self.limit, self.span = limit, span_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "at long, id string")
        self.accepted = handle.getListState("accepted", "at long")

    def handleInputRows(self, key, rows, timerValues):
        latest = None
        for frame in rows:
            at = frame["ts"].astype("datetime64[us]").astype("int64") // 1000
            self.waiting.appendList(list(zip(at.tolist(), frame["id"].tolist())))
            latest = max(at.max(), latest or at.max())
        if latest is not None:
            self.handle.registerTimer(int(latest))
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        now = expiredTimerInfo.getExpiryTimeInMs()
        pending = sorted((tuple(x) for x in self.waiting.get()), key=lambda x: (x[0], x[1] is not None, x[1] or ""))
        due, later = [x for x in pending if x[0] <= now], [x for x in pending if x[0] > now]
        verdicts, kept = admit([t for t, _ in due], [x[0] for x in self.accepted.get()], self.limit, self.span)
        kept = [t for t in kept if now - t < self.span]
        for state, values in ((self.waiting, later), (self.accepted, [(t,) for t in kept])):
            state.put(values) if values else state.clear()
        if kept:
            self.handle.registerTimer(int(kept[-1] + self.span))
        if due:
            yield pd.DataFrame({"client": key[0], "id": [i for _, i in due], "ts": pd.to_datetime([t for t, _ in due], unit="ms"), "allowed": verdicts})

    def close(self) -> None:
        pass


def limited(requests: DataFrame, limit: int = 60, span: dt.timedelta = dt.timedelta(hours=1), delay: str = "10 minutes") -> DataFrame:
    """(client, id, ts, allowed): a verdict on each request (client, id, ts) of a stream, by an exact sliding span for each client.

    A request is let in where fewer than ``limit`` were let in during the ``span`` before it; those turned away don't count.
    Requests may come in any order up to ``delay``: they are judged by their times, in whole milliseconds, equal ones by
    id, when the watermark passes them. Later ones are dropped. Needs the RocksDB state store.
    """
    rows = requests.select("client", F.col("id").cast("string").alias("id"), "ts").withWatermark("ts", delay)
    return rows.groupBy("client").transformWithStateInPandas(Limiter(limit, span // dt.timedelta(milliseconds=1)), f"client {requests.schema['client'].dataType.simpleString()}, id string, ts timestamp, allowed boolean", "Append", "EventTime")
