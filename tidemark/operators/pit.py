"""Bitemporal store: append-only observations, point-in-time reads, revisions, as-of joins."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window as W, functions as F, types as T

from ..functions.shared import exists
from .series import scan

SCHEMA = T.StructType(
    [
        T.StructField("series_id", T.StringType(), False), T.StructField("entity", T.StringType()), T.StructField("event_date", T.DateType(), False),
        T.StructField("available_at", T.TimestampNTZType(), False), T.StructField("value", T.DoubleType()), T.StructField("text_value", T.StringType()),
        T.StructField("unit", T.StringType()), T.StructField("source", T.StringType(), False), T.StructField("revision", T.IntegerType(), False), T.StructField("meta", T.StringType()),
    ]
)


def cutoff(when: str | dt.date | dt.datetime) -> dt.datetime:
    """A cut-off as a naive UTC time: a date, or text that says midnight, means the end of that day."""
    if isinstance(when, str):
        when = dt.datetime.fromisoformat(when)
        if when.tzinfo is None and when.time() == dt.time():
            when = when.date()
    if isinstance(when, dt.datetime):
        return when.astimezone(dt.timezone.utc).replace(tzinfo=None) if when.tzinfo else when
    return dt.datetime.combine(when, dt.time(23, 59, 59))


def visible(observations: DataFrame, when, series=None, entity=None, start=None, end=None) -> DataFrame:
    """Rows known at the cut-off, of some series, entities and event dates; all of it is pushed down."""
    out = observations.where(F.col("available_at") <= F.lit(cutoff(when)).cast("timestamp_ntz"))
    for name, wanted in (("series_id", series), ("entity", entity)):
        if wanted is not None:
            out = out.where(F.col(name).isin([wanted] if isinstance(wanted, str) else list(wanted)))
    if start is not None:
        out = out.where(F.col("event_date") >= F.lit(start).cast("date"))
    return out if end is None else out.where(F.col("event_date") <= F.lit(end).cast("date"))


def as_of(observations: DataFrame, when, **filters) -> DataFrame:
    """The latest version, known at the cut-off, of each (series, entity, event date)."""
    newest = W.partitionBy("series_id", "entity", "event_date").orderBy(F.desc("revision"), F.desc("available_at"))
    return visible(observations, when, **filters).withColumn("_n", F.row_number().over(newest)).where("_n = 1").drop("_n")


def wide(snapshot: DataFrame, columns: list[str]) -> DataFrame:
    """date by 'series|entity', the columns being named so that no pass over the data finds them."""
    return snapshot.withColumn("_c", F.concat_ws("|", "series_id", "entity")).groupBy("event_date").pivot("_c", columns).agg(F.last("value"))


def revision_history(observations: DataFrame, series: str, event_date) -> DataFrame:
    return observations.where((F.col("series_id") == series) & (F.col("event_date") == F.lit(event_date).cast("date"))).select("entity", "event_date", "available_at", "value", "revision").orderBy("revision")


def with_revisions(new: DataFrame, stored: DataFrame, order: list[str]) -> DataFrame:
    """New rows numbered on from what is stored for (series, event date), in the order given."""
    last = stored.groupBy("series_id", "event_date").agg(F.max("revision").alias("_last"))
    number = F.row_number().over(W.partitionBy("series_id", "event_date").orderBy(*order))
    return new.join(last, ["series_id", "event_date"], "left").withColumn("revision", (F.coalesce(F.col("_last") + 1, F.lit(0)) + number - 1).cast("int")).drop("_last")


def observations_from(frame: DataFrame, series: str, source: str, date: str = "date", value: str = "value", available_at: Column | None = None, lag_days: int | None = None, **constants) -> DataFrame:
    """Tidy (date, value) rows as observations; exactly one rule says when they became known."""
    if (available_at is None) == (lag_days is None):
        raise ValueError("give exactly one of available_at and lag_days")
    known = available_at if available_at is not None else published(F.col(date), lag_days)
    given = {"series_id": F.lit(series), "source": F.lit(source), "event_date": F.col(date).cast("date"), "available_at": known.cast("timestamp_ntz"), "value": F.col(value).cast("double"), "revision": F.lit(0)} | {k: F.lit(v) for k, v in constants.items()}
    return frame.where(F.col(value).isNotNull()).select(*[given.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in SCHEMA])


def published(event_date: Column, lag_days: int) -> Column:
    """18:00 of the event date, so many days later."""
    return event_date.cast("timestamp_ntz") + F.expr(f"INTERVAL '{lag_days} 18:00:00' DAY TO SECOND")


def coverage(observations: DataFrame) -> DataFrame:
    """Per series and source: prints, dates, range, last arrival, mean days from event to arrival."""
    return observations.groupBy("series_id", "source").agg(
        F.count("*").alias("n_obs"), F.countDistinct("event_date").alias("n_dates"), F.min("event_date").alias("first_date"), F.max("event_date").alias("last_date"),
        F.max("available_at").alias("last_available"), F.avg(F.datediff(F.col("available_at").cast("date"), F.col("event_date"))).alias("mean_lag_days"),
    )


def latest(observations: DataFrame, keys: list[str], date: str = "event_date", value: str = "value") -> DataFrame:
    return observations.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.max_by(value, date).alias("value"), F.max(date).alias("date"))


def missing(requested: DataFrame, available: DataFrame, key: str) -> DataFrame:
    return requested.join(available, key, "left_anti")


def asof_join(left: DataFrame, right: DataFrame, on: str, by: list[str], value: str, rows_per_block: int | None = None) -> DataFrame:
    """``left`` with the last ``value`` of ``right`` at or before ``on`` for the same ``by``; null before the first.

    Both sides go through one window over their union, so rows are shuffled once and nothing is paired. With
    ``rows_per_block`` a key, such as a currency, is as many tasks as it has blocks of time.
    """
    keys = [*by, on]
    names = [c for c in left.columns if c not in keys]
    a = left.select(*keys, F.struct(*names).alias("_row"), F.lit(1).alias("_side"), F.lit(None).cast(right.schema[value].dataType).alias("_value"))
    b = right.select(*keys, F.lit(None).cast(a.schema["_row"].dataType).alias("_row"), F.lit(0).alias("_side"), F.col(value).alias("_value"))
    order = W.partitionBy(*by).orderBy(on, "_side").rowsBetween(W.unboundedPreceding, 0)
    if rows_per_block:
        out = scan(a.unionByName(b), by, [on, "_side"], {"_value": ("last", F.col("_value"))}, rows_per_block=rows_per_block).where("_side = 1")
    else:
        out = a.unionByName(b).withColumn("_value", F.last("_value", ignorenulls=True).over(order)).where("_side = 1")
    return out.select(*keys, "_row.*", F.col("_value").alias(value))


def resolve(questions: DataFrame, observations: DataFrame) -> DataFrame:
    """Outcome of (question_id, series_id, start, end, level, direction): whether the series was below
    (above) the level in the window; null without an observation.

    Observations are first brought to one row a series and date, with their number, least and greatest value; windows are laid
    out by month, so that a question meets the dates of its months only, however many observations these have.
    """
    months = F.sequence(F.trunc("start", "month"), F.trunc("end", "month"), F.expr("interval 1 month"))
    q = questions.withColumn("month", F.explode_outer(F.when(F.col("start") <= F.col("end"), months)))
    o = observations.groupBy("series_id", "event_date").agg(F.count("value").alias("n"), F.min("value").alias("lowest"), F.max("value").alias("highest"))
    o = o.withColumn("month", F.trunc("event_date", "month"))
    inside = (F.col("o.series_id") == F.col("q.series_id")) & (F.col("o.month") == F.col("q.month")) & F.col("o.event_date").between(F.col("q.start"), F.col("q.end"))
    hit = F.when(F.col("q.direction") == "below", F.col("o.lowest") < F.col("q.level")).otherwise(F.col("o.highest") > F.col("q.level"))
    return q.alias("q").join(o.alias("o"), inside, "left").groupBy("q.question_id").agg(F.bool_or(hit).alias("outcome"), F.coalesce(F.sum("o.n"), F.lit(0)).cast("long").alias("n_obs"), F.min("o.lowest").alias("lowest"), F.max("o.highest").alias("highest"))


def snapshot(spark: SparkSession, sources: dict[str, Callable[[], DataFrame]], path: str, now: dt.datetime) -> DataFrame:
    """Append what each source shows at ``now`` to the observations under ``path``; (source, n, error) of each.

    A source returns (series_id, date, value, unit); a null date is today. Each is written by itself, and one that fails, in
    its plan or in its tasks, leaves the others alone. Rows without a value are left out. Revisions go on from those
    stored, so a second run of a day, or a second source of a series, revises and never repeats a number."""
    rows = []
    for name, make in sources.items():
        try:
            seen = Observation()
            frame = make().where("value is not null")
            day = F.coalesce(F.col("date").cast("date"), F.lit(now.date()))
            given = {"series_id": F.upper("series_id"), "event_date": day, "available_at": F.lit(now).cast("timestamp_ntz"), "value": F.col("value"), "unit": F.col("unit"), "source": F.lit(name)}
            out = frame.select(*[given.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in SCHEMA if f.name != "revision"])
            stored = spark.read.schema(SCHEMA).parquet(path) if exists(spark, path) else spark.createDataFrame([], SCHEMA)
            keys = ["series_id", "event_date"]
            known = stored.select(*keys, "revision").join(out.select(*keys).distinct(), keys, "left_semi")
            out = with_revisions(out, known, ["value", "unit"]).select(*SCHEMA.fieldNames())
            out.observe(seen, F.count("*").alias("n")).write.mode("append").parquet(path)
            rows.append((name, seen.get["n"], None))
        except Exception as failed:  # a feed that is down is a row of the report
            rows.append((name, 0, f"{type(failed).__name__}: {str(failed)[:90]}"))
    return spark.createDataFrame(rows, "source string, n long, error string")
