"""Questions that resolve themselves, and what was known when they were asked."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.stats import question_id
from . import pit

#: Series with name, volatility a year where none is known, decimals.
TRACKED = {
    "NIFTY50_CLOSE": ("the Nifty 50", 0.13, 0), "BANKNIFTY_CLOSE": ("the Bank Nifty", 0.16, 0), "INDIA_VIX": ("India VIX", 0.60, 1),
    "USDINR": ("the rupee (USD/INR)", 0.05, 2), "GOLD_USD": ("gold", 0.16, 0), "BRENT_USD": ("Brent crude", 0.30, 1),
}
HORIZONS, STEPS = (1, 3, 7), (0.4, 0.8, 1.3)


def realised_vol(observations: DataFrame, when, days: int = 120) -> DataFrame:
    """Per series: deviation of daily log returns, a year's, of what was known; null under 20 rows or 15 returns."""
    day = pit.cutoff(when).date()
    known = pit.as_of(observations, when, start=day - dt.timedelta(days=days))
    n = known.groupBy("series_id").agg(F.count("*").alias("n_obs"))
    last = known.groupBy("series_id", "event_date").agg(F.max_by("value", F.struct("available_at", "revision", "entity")).alias("value"))
    r = last.withColumn("r", F.log(F.col("value") / F.lag("value").over(W.partitionBy("series_id").orderBy("event_date"))))
    s = r.groupBy("series_id").agg(F.count("r").alias("n_r"), F.stddev_samp("r").alias("sd"))
    return n.join(s, "series_id").select("series_id", "n_obs", F.when((F.col("n_obs") >= 20) & (F.col("n_r") >= 15) & (F.col("sd") > 0), F.col("sd") * 252**0.5).alias("vol"))


def _level(text_decimals: Column, level: Column) -> Column:
    out = F.when(text_decimals == 0, F.bround(level / 10, 0) * 10)
    for dp in (1, 2):
        out = out.when(text_decimals == dp, F.bround(level, dp))
    return out


def _shown(decimals: Column, level: Column) -> Column:
    out = F.when(decimals == 0, F.format_number(level, 0))
    for dp in (1, 2):
        out = out.when(decimals == dp, F.format_number(level, dp))
    return out


def generate(latest: DataFrame, vols: DataFrame, today: dt.date, per_series: int = 2) -> DataFrame:
    """Threshold questions from (series_id, value) and (series_id, vol): ``per_series`` of each tracked series, drawn
    without replacement from horizons, distances in deviations and directions by a hash of the day.

    (series_id, horizon, step, direction, level, resolves, id, text). Series without a positive value are left
    out; the tracked series and the combinations are constants."""
    spark = latest.sparkSession
    tracked = spark.createDataFrame([(k, *v) for k, v in TRACKED.items()], "series_id string, label string, usual double, dp int")
    combos = spark.createDataFrame([(h, s, d) for h in HORIZONS for s in STEPS for d in ("below", "above")], "horizon int, step double, direction string")
    known = latest.where("value > 0").join(F.broadcast(tracked), "series_id").join(vols.select("series_id", "vol"), "series_id", "left")
    rows = known.join(F.broadcast(combos))
    sign = F.when(F.col("direction") == "below", -1).otherwise(1)
    move = F.col("value") * F.coalesce("vol", "usual") * F.sqrt(F.col("horizon") / 252.0) * F.col("step")
    rows = rows.withColumns({"level": _level(F.col("dp"), F.col("value") + sign * move), "resolves": F.date_add(F.lit(today), F.col("horizon"))})
    draw = F.sha2(F.concat_ws("|", F.lit(today.strftime("%Y%m%d")), "series_id", "horizon", "step", "direction"), 256)
    text = F.concat(F.lit("Will "), F.col("label"), F.lit(" trade "), F.col("direction"), F.lit(" "), _shown(F.col("dp"), F.col("level")), F.lit(" at any point on or before "), F.col("resolves").cast("string"), F.lit("?"))
    rows = rows.withColumns({"text": text, "_draw": draw})
    rows = rows.withColumn("_same", F.row_number().over(W.partitionBy("series_id", "text").orderBy("_draw"))).where("_same = 1")
    rows = rows.withColumn("_n", F.row_number().over(W.partitionBy("series_id").orderBy("_draw"))).where(F.col("_n") <= per_series)
    return rows.select("series_id", "horizon", "step", "direction", "level", "resolves", question_id(F.col("text"), F.col("resolves")).alias("id"), "text")


def thresholds(questions: DataFrame) -> DataFrame:
    """(question_id, text, resolution_source, start, resolution_date) as what :func:`pit.resolve` takes, and a ``note`` (fixed
    texts) on questions that can't be read: no source, no threshold, no date. Nothing is guessed."""
    pattern = r"(?i)\b(below|under|above|over)\b[^\d]{0,12}([\d,]+(?:\.\d+)?)"
    word, number = F.lower(F.regexp_extract("text", pattern, 1)), F.replace(F.regexp_extract("text", pattern, 2), F.lit(","), F.lit(""))
    source, stop = F.coalesce("resolution_source", F.lit("")), F.col("resolution_date").cast("string").try_cast("date")
    note = F.when(source.isin("", "manual"), "no machine-resolvable source on this question").when(F.coalesce(number, F.lit("")) == "", "could not parse a threshold from the question text").when(stop.isNull(), "unparseable resolution date")
    rows = questions.withColumns({"note": note, "series_id": source, "stop": stop})
    read = F.col("note").isNull()
    return rows.select("question_id", "series_id", "start", "stop", F.when(read, F.when(word.isin("below", "under"), "below").otherwise("above")).alias("direction"), F.when(read, number.try_cast("double")).alias("level"), "note")


def evidence(observations: DataFrame, when, lookback_days: int = 400, history: int = 6) -> DataFrame:
    """Per series known at a time: the last value, its lag in days with a note beyond three, and the values before
    it (of the last ``history`` rows, oldest first) as (event_date, value)."""
    start = pit.cutoff(when).date() - dt.timedelta(days=lookback_days)
    known = pit.as_of(observations, when, start=start)
    n = F.row_number().over(W.partitionBy("series_id").orderBy(F.desc("event_date"), F.desc("available_at"), F.desc("entity")))
    rows = known.withColumn("_n", n).where(F.col("_n") <= history)
    lag = F.datediff(F.to_date("available_at"), F.col("event_date"))
    before = F.collect_list(F.when((F.col("_n") > 1) & F.col("value").isNotNull(), F.struct((-F.col("_n")).alias("k"), "event_date", "value")))
    first = lambda c: F.max(F.when(F.col("_n") == 1, c))
    g = rows.withColumn("_lag", lag).groupBy("series_id").agg(first(F.col("value")).alias("value"), first(F.col("event_date")).alias("event_date"), first(F.col("_lag")).alias("lag_days"), F.array_sort(before).alias("h"))
    return g.select("series_id", "value", "event_date", "lag_days", F.when(F.col("lag_days") > 3, F.format_string("publication lag %dd", "lag_days")).otherwise("").alias("note"), F.transform("h", lambda e: F.struct(e["event_date"], e["value"])).alias("history"))


def unavailable(requested: list[str], packet: DataFrame) -> DataFrame:
    """Requested series without evidence, with a caveat."""
    asked = packet.sparkSession.createDataFrame([(s,) for s in requested], "series_id string")
    return asked.join(packet.select("series_id"), "series_id", "left_anti").withColumn("caveat", F.concat(F.lit("Requested but unavailable at this timestamp: "), F.col("series_id")))


def fingerprint(items: Column) -> Column:
    """Sixteen hex digits of SHA-256 over an array of (id, label, value, event_date) strings, written as JSON with
    a blank after each comma. Text beyond ASCII is hashed as UTF-8."""
    quoted = lambda s: F.regexp_replace(F.to_json(F.array(s)), r"^\[|\]$", "")
    row = lambda i: F.concat(F.lit("["), F.array_join(F.array(*[quoted(i[c]) for c in ("id", "label", "value", "event_date")]), ", "), F.lit("]"))
    return F.substring(F.sha2(F.concat(F.lit("["), F.array_join(F.transform(items, row), ", "), F.lit("]")), 256), 1, 16)


def summarise(tests: DataFrame, alpha: float = 0.05) -> DataFrame:
    """One row of screened candidates (p null where untestable, survives): numbers, and how many chance would pass."""
    tested = F.col("p").isNotNull()
    return tests.agg(
        F.count("*").alias("candidates"), F.count_if(tested).alias("tested"), F.count_if(~tested).alias("untestable"), F.count_if(F.col("p") < alpha).alias("naive_significant"),
        F.round(F.count_if(tested) * alpha, 1).alias("expected_by_chance"), F.count_if(tested & F.col("survives")).alias("survive_fdr"),
    )


def panels(track: DataFrame, least: int = 2) -> DataFrame:
    """Per question of a track record (question, member, p, y): the members' chances, without the pool's own, and the
    outcome, where ``least`` answered."""
    rows = track.where("member <> '__council__' and p is not null")
    return rows.groupBy("question").agg(F.array_sort(F.collect_list("p")).alias("probabilities"), F.max("y").alias("y")).where(F.size("probabilities") >= least)
