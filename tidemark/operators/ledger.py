"""Ledgers of runs, resolutions, candidates and settings: appended, resolved once, latest wins."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from ..functions.shared import cut, exists
from ..functions.stats import clamp

#: Fixed values, in this order.
STATES = ("proposed", "verified", "validated", "promoted", "rejected")


def latest_wins(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    """One row a key, the last in ``order``."""
    n = F.row_number().over(W.partitionBy(*keys).orderBy(*[F.desc(c) if isinstance(c, str) else c for c in order]))
    return rows.withColumn("_n", n).where("_n = 1").drop("_n")


def upsert(new: DataFrame, path: str, keys: list[str], order: list[str], buckets: int = 64) -> None:
    """Put the rows of ``new`` into the keyed table under ``path``, the last in ``order`` for each key, stored ones included.

    The table is laid out by a hash of the key. Only folders that keys of ``new`` fall in are read and written anew; the others
    keep their files. Doing it again changes nothing. Of equal rows in ``order`` the new one stays. Null keys are keys.
    The number of buckets is the table's and must not change; one writer at a time.
    """
    spark, names = new.sparkSession, new.columns
    dealt = new.withColumns({"bucket": F.pmod(F.xxhash64(*[F.col(k) for k in keys]), F.lit(buckets)).cast("int"), "_new": F.lit(1)})
    touched = [r[0] for r in dealt.select("bucket").distinct().collect()]  # at most ``buckets`` numbers
    if not touched:
        return
    if exists(spark, path):
        held = spark.read.schema(f"{new.schema.toDDL()}, bucket int").parquet(path).where(F.col("bucket").isin(touched))
        dealt = dealt.unionByName(held.withColumn("_new", F.lit(0)))
    # Written apart first: what is read isn't overwritten while it is read.
    kept = cut(latest_wins(dealt, keys, [*order, "_new"]).select(*names, "bucket"))
    kept.repartition("bucket").write.partitionBy("bucket").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)


def stored(spark: SparkSession, path: str, schema) -> DataFrame:
    """The rows of a keyed table; none where there is no table."""
    return spark.read.schema(schema).parquet(path).drop("bucket") if exists(spark, path) else spark.createDataFrame([], schema)


def log_run(runs: DataFrame, path: str) -> None:
    """Upsert runs (run_id, started_at, status, detail), a detail cut to 2,000 characters."""
    upsert(runs.withColumn("detail", F.left("detail", F.lit(2000))), path, ["run_id"], ["started_at"])


def add_absent(stored: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """``stored`` with the rows of ``new`` whose key it lacks: what was rejected once stays so."""
    first = new.dropDuplicates([key]).join(stored.select(key), key, "left_anti")
    return stored.unionByName(first, allowMissingColumns=True)


def set_state(stored: DataFrame, changes: DataFrame, key: str, states: tuple[str, ...] = STATES) -> DataFrame:
    """``stored`` with the states of ``changes`` (key, state); states that don't exist change nothing."""
    good = changes.where(F.col("state").isin(*states)).select(key, F.col("state").alias("_new"))
    return stored.join(good, key, "left").withColumn("state", F.coalesce("_new", "state")).drop("_new")


def apply_winners(settings: DataFrame, results: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Settings (setting, value) overlaid by the winners of (setting, winner, p) that are significant, and whether that
    ``changed`` them; results without a winner or a p-value change nothing."""
    good = results.where(F.col("winner").isNotNull() & ~F.isnan("p") & (F.col("p") < alpha)).select("setting", "winner", "p")
    best = latest_wins(good, ["setting"], [F.asc("p"), F.asc("winner")]).select("setting", "winner")
    both = settings.join(best, "setting", "full")
    return both.select("setting", F.coalesce("winner", "value").alias("value"), (F.col("winner").isNotNull() & ~F.col("winner").eqNullSafe(F.col("value"))).alias("changed"))


def verified(candidates: DataFrame, observations: DataFrame, key: str = "key", least: int = 5) -> DataFrame:
    """(key, state, note): candidates with at least so many values are verified, others rejected, and why."""
    n = observations.groupBy(key).agg(F.count("value").alias("_n"))
    rows = candidates.select(key).distinct().join(n, key, "left").withColumn("_n", F.coalesce("_n", F.lit(0)))
    good, count = F.col("_n") >= least, F.col("_n").cast("string")
    return rows.select(key, F.when(good, "verified").otherwise("rejected").alias("state"), F.when(good, F.concat(count, F.lit(" observations"))).otherwise(F.concat(F.lit("only "), count, F.lit(" numeric points"))).alias("note"))


def discover(registry: DataFrame, found: DataFrame, observations: DataFrame, key: str = "key", least: int = 5) -> DataFrame:
    """The registry (key, state, ...) with the found candidates it lacks, each verified by its observations; what it
    had keeps its state, so that a rejected candidate isn't tried again."""
    new = found.join(registry.select(key), key, "left_anti").dropDuplicates([key])
    judged = new.drop("state", "note").join(verified(new, observations, key, least), key)
    return registry.unionByName(judged, allowMissingColumns=True)


def state_counts(stored: DataFrame, states: tuple[str, ...] = STATES) -> DataFrame:
    """Rows in each state, 0 for states without any."""
    every = stored.sparkSession.createDataFrame([(s,) for s in states], "state string")
    return every.join(stored.groupBy("state").agg(F.count("*").alias("n")), "state", "left").select("state", F.coalesce("n", F.lit(0)).alias("n"))


def resolve_due(runs: DataFrame, outcomes: DataFrame, resolved: DataFrame, today) -> DataFrame:
    """Scored member forecasts of runs that are due, have an outcome and weren't resolved before.

    ``runs``: run_id, question_id, resolution_date, probability, forecasts (member, probability, parse_ok);
    the pooled verdict is scored as the member ``__council__``. Resolving again adds nothing.
    """
    due = runs.where(F.col("resolution_date") <= F.lit(today).cast("date")).join(resolved.select("run_id"), "run_id", "left_anti")
    known = due.join(outcomes.where("outcome is not null").select("question_id", "outcome"), "question_id")
    own = F.struct(F.lit("__council__").alias("member"), F.col("probability").alias("probability"), F.lit(True).alias("parse_ok"))
    rows = known.select("run_id", "question_id", F.col("resolution_date").alias("resolved_at"), F.col("outcome").cast("int").alias("y"), F.explode(F.concat("forecasts", F.array(own))).alias("f"))
    rows = rows.where("f.parse_ok and f.probability is not null").select("run_id", "question_id", "resolved_at", "y", "f.member", F.col("f.probability").alias("p"))
    p = clamp(F.col("p"))
    return rows.withColumns({"brier": (F.col("p") - F.col("y")) ** 2, "log_score": -(F.col("y") * F.log(p) + (1 - F.col("y")) * F.log(1 - p))})


def resolved_by(questions: DataFrame, resolver: Callable[[dict], bool | None], key: str = "question_id") -> DataFrame:
    """(key, outcome, note): what any ``resolver`` says of each question, a row of ``questions`` as a dict.

    It returns whether the question came true, or None where that can't be said yet. A call that fails leaves the outcome
    null and says why in ``note``; the others go on. Questions stay where they lie; nothing is gathered.
    """
    kind = questions.schema[key].dataType.simpleString()

    def run(frames):
        for frame in frames:
            said = []
            for row in frame.to_dict("records"):
                try:
                    got = resolver({k: None if v is pd.NaT or isinstance(v, float) and v != v else v for k, v in row.items()})
                    said.append((None if got is None else bool(got), None if got is not None else "not resolvable yet"))
                except Exception as failed:  # one question's resolver is no reason to lose the others
                    said.append((None, f"{type(failed).__name__}: {failed}"[:200]))
            yield pd.DataFrame({key: frame[key], "outcome": pd.array([o for o, _ in said], dtype="boolean"), "note": pd.Series([n for _, n in said], dtype=object, index=frame.index)})

    return questions.mapInPandas(run, f"`{key}` {kind}, outcome boolean, note string")


def against_market(rows: DataFrame, min_n: int = 20) -> DataFrame:
    """(p, m, y): Brier scores of forecast, market and base rate, skills, and a verdict from ``min_n`` rows on."""
    base = rows.agg(F.avg(F.col("y").cast("double")).alias("base"))
    s = rows.join(F.broadcast(base)).agg(F.count("*").alias("n"), *[F.avg((F.col(c) - F.col("y")) ** 2).alias(k) for c, k in (("p", "forecast"), ("m", "market"), ("base", "climate"))])
    skill = 1 - F.col("forecast") / F.nullif("market", F.lit(0.0))
    verdict = F.when(F.col("n") < min_n, "too few").when(skill > 0, "ahead of the market").otherwise("behind the market")
    return s.select("n", "forecast", "market", "climate", skill.alias("skill_market"), (1 - F.col("forecast") / F.nullif("climate", F.lit(0.0))).alias("skill_climate"), verdict.alias("verdict"))


def market_duel(rows: DataFrame, min_n: int = 20, margin: float = 0.05) -> DataFrame:
    """One row of (p, m, y): Brier and log scores of forecast and market, Brier score of the base rate, skills, means, the mean gap, and a
    verdict: inconclusive below ``min_n`` rows, indistinguishable within ``margin`` of skill. Without rows there is none."""
    base = rows.agg(F.avg(F.col("y").cast("double")).alias("base_rate"))
    y = F.col("y").cast("double")
    log = lambda c: F.avg(-(y * F.log(clamp(F.col(c))) + (1 - y) * F.log(1 - clamp(F.col(c)))))
    s = rows.join(F.broadcast(base)).groupBy("base_rate").agg(
        F.count("*").alias("n"), *[F.avg((F.col(c) - y) ** 2).alias(k) for c, k in (("p", "forecast_brier"), ("m", "market_brier"), ("base_rate", "base_rate_brier"))], log("p").alias("forecast_log"), log("m").alias("market_log"),
        F.avg("p").alias("mean_forecast"), F.avg("m").alias("mean_market"), F.avg(F.col("p") - F.col("m")).alias("mean_gap"),
    )
    skill = lambda c: 1 - F.col("forecast_brier") / F.nullif(c, F.lit(0.0))
    s = s.withColumns({"skill_market": skill("market_brier"), "skill_base_rate": skill("base_rate_brier")})
    return s.withColumn("verdict", F.when(F.col("n") < min_n, "inconclusive").when(F.col("skill_market") > margin, "ahead of the market").when(F.col("skill_market") < -margin, "behind the market").otherwise("indistinguishable from the market"))


def standing(scores: DataFrame, references: DataFrame, gates: tuple[int, int] = (30, 100)) -> DataFrame:
    """Each member beside each published reference point: difference of Brier scores, and how far the
    number of questions carries it. References are a handful of rows."""
    few, enough = gates
    weight = F.when(F.col("n") < few, "insufficient").when(F.col("n") < enough, "indicative").otherwise("comparable")
    return scores.join(F.broadcast(references)).select("member", "n", "reference", (F.col("brier") - F.col("reference_brier")).alias("gap"), weight.alias("standing"))


def validate(rows: DataFrame, by: str = "candidate", q: float = 0.10, min_obs: int = 40, min_test: int = 20) -> DataFrame:
    """(candidate, date, x, y) screened: rank correlation on the first share of each series and, after a
    purged gap, on the rest; a candidate survives if its test p-value does after the false discovery
    correction and both signs agree."""
    from ..functions.stats import t_two_sided
    from .learning import benjamini_hochberg, spearman, split_chronologically

    parts = split_chronologically(rows, by)
    both = spearman(parts, [by, "part"], "x", "y")
    side = lambda p: both.where(F.col("part") == p).select(by, F.col("rho").alias(f"rho_{p}"), F.col("n").alias(f"n_{p}"))
    t = side("train").join(side("test"), by).where((F.col("n_test") >= min_test) & (F.col("n_train") + F.col("n_test") >= min_obs))
    df = (F.col("n_test") - 2).cast("double")
    stat = F.col("rho_test") * F.sqrt(df / F.greatest(1 - F.col("rho_test") ** 2, F.lit(1e-12)))
    tested = benjamini_hochberg(t.withColumn("p", t_two_sided(stat, df)).withColumnRenamed(by, "candidate"), q)
    same = F.signum("rho_train") == F.signum("rho_test")
    return tested.withColumn("sign_consistent", same).withColumn("survives", F.col("survives") & same)


def catalogue_series(sources: DataFrame) -> DataFrame:
    """(series, source) of a catalogue with arrays of series, the first source of each."""
    rows = sources.select("position", "source", F.posexplode("series").alias("at", "name"))
    return rows.groupBy(F.col("name").alias("series")).agg(F.min_by("source", F.struct("position", "at")).alias("source"))


def catalogue_coverage(sources: DataFrame) -> DataFrame:
    """Per asset class: sources, working ones, and whether a question about it can be answered."""
    rows = sources.select("source", "status", F.explode("asset_classes").alias("asset_class"))
    return rows.groupBy("asset_class").agg(F.count("*").alias("n_sources"), F.count_if(F.col("status") == "working").alias("n_working"), F.max(F.col("status").isin("working", "fragile")).alias("can_answer"))


def catalogue_where(sources: DataFrame, domain: str | None = None, status: str | None = None, asset_class: str | None = None) -> DataFrame:
    """Sources of a domain, of a status, with an asset class; all that are given hold."""
    out = sources
    for column, wanted in (("domain", domain), ("status", status)):
        if wanted is not None:
            out = out.where(F.col(column) == wanted)
    return out if asset_class is None else out.where(F.array_contains("asset_classes", asset_class))


#: How far a source's reader has come.
STATUSES = ("working", "fragile", "blocked", "planned")


def catalogue_summary(sources: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Sources, those of each status, those that were verified or need a key, domains, and distinct series; in all, or ``by``."""
    at = sources.groupBy(*(by or []))
    own = at.agg(
        F.count("*").alias("sources"), *[F.count_if(F.col("status") == s).alias(s) for s in STATUSES], F.count_if(F.col("last_verified").isNotNull()).alias("verified"), F.countDistinct("domain").alias("domains"),
        F.count_if(F.coalesce("needs_key", F.lit(False))).alias("need_key"),
    )
    series = sources.select(*(by or []), F.explode("series").alias("_s")).groupBy(*(by or [])).agg(F.countDistinct("_s").alias("series"))
    if not by:
        return own.join(F.broadcast(series))  # one row each
    return own.join(series, by, "left").withColumn("series", F.coalesce("series", F.lit(0)))
