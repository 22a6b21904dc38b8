"""Forecast scoring, calibration, pooling and weights on (question, member, p, y) rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.stats import EPS, clamp, expit, logit


def scored(forecasts: DataFrame) -> DataFrame:
    p, y = clamp(F.col("p")), F.col("y")
    return forecasts.withColumns({"brier": (F.col("p") - y) ** 2, "log_score": -(y * F.log(p) + (1 - y) * F.log(1 - p))})


def pinball(q: Column, value: Column, actual: Column) -> Column:
    return F.greatest(q * (actual - value), (q - 1) * (actual - value))


def crps(quantiles: DataFrame, keys: list[str]) -> DataFrame:
    """Mean pinball loss times two of (keys, q, value, actual), and whether 5 to 95 % cover the outcome."""
    lo, hi = F.max(F.when(F.abs(F.col("q") - 0.05) < 1e-9, F.col("value"))), F.max(F.when(F.abs(F.col("q") - 0.95) < 1e-9, F.col("value")))
    return quantiles.groupBy(*keys).agg((2 * F.avg(pinball(F.col("q"), F.col("value"), F.col("actual")))).alias("crps"), F.max("actual").between(lo, hi).alias("covered_90"))


def calibration_curve(forecasts: DataFrame, bins: int = 10) -> DataFrame:
    """Right-closed bins of equal width, the lowest with 0; empty bins are left out."""
    k = F.greatest(F.ceil(F.col("p") * bins), F.lit(1)).cast("int")
    return forecasts.groupBy(k.alias("bin")).agg(F.count("*").alias("n"), F.avg("p").alias("mean_p"), F.avg(F.col("y").cast("double")).alias("freq")).withColumn("gap", F.col("freq") - F.col("mean_p"))


def expected_calibration_error(forecasts: DataFrame, bins: int = 10) -> DataFrame:
    return calibration_curve(forecasts, bins).agg((F.sum(F.col("n") * F.abs("gap")) / F.sum("n")).alias("ece"))


def murphy(forecasts: DataFrame, bins: int = 10) -> DataFrame:
    """Reliability, resolution and uncertainty over left-closed bins, the last closed."""
    edges = F.array(*[F.lit(i / bins) for i in range(1, bins)])
    k = F.size(F.filter(edges, lambda e: e <= F.col("p")))
    per = forecasts.groupBy(k.alias("bin")).agg(F.count("*").alias("n"), F.avg("p").alias("mp"), F.avg(F.col("y").cast("double")).alias("fy"))
    base = forecasts.agg(F.avg(F.col("y").cast("double")).alias("base"), F.avg((F.col("p") - F.col("y")) ** 2).alias("brier"), F.count("*").alias("total"))
    return per.join(F.broadcast(base)).groupBy("base", "brier", "total").agg(
        (F.sum(F.col("n") * (F.col("mp") - F.col("fy")) ** 2) / F.max("total")).alias("reliability"), (F.sum(F.col("n") * (F.col("fy") - F.col("base")) ** 2) / F.max("total")).alias("resolution")
    ).withColumn("uncertainty", F.col("base") * (1 - F.col("base")))


def member_scores(forecasts: DataFrame) -> DataFrame:
    """Per member: questions, Brier, log score, base rate, skill against it, bias in log-odds."""
    s = scored(forecasts).groupBy("member").agg(F.count("*").alias("n"), F.avg("brier").alias("brier"), F.avg("log_score").alias("log_score"), F.avg(F.col("y").cast("double")).alias("base"), F.avg(logit(F.col("p"))).alias("mean_logit"))
    unc = F.col("base") * (1 - F.col("base"))
    return s.select("member", "n", "brier", "log_score", "base", (1 - F.col("brier") / F.nullif(unc, F.lit(0.0))).alias("skill"), (F.col("mean_logit") - logit(F.col("base"))).alias("bias_logit"))


def bias_corrections(scores: DataFrame, shrink: float = 0.5) -> DataFrame:
    return scores.select("member", F.when(F.col("n") < 5, 0.0).otherwise(shrink * F.col("bias_logit") * F.col("n") / (F.col("n") + 10)).alias("correction"))


def hedge_weights(forecasts: DataFrame, eta: float = 8.0, floor: float = 0.02, half_life: float = 40.0) -> DataFrame:
    """Exponential weights on mean losses in which older questions count less, with a floor for everyone."""
    age = F.row_number().over(W.partitionBy("member").orderBy(F.desc("question"))) - 1
    loss = scored(forecasts).withColumn("w", F.pow(F.lit(0.5), age / half_life)).groupBy("member").agg((F.sum(F.col("w") * F.col("brier")) / F.sum("w")).alias("loss"))
    span = loss.agg(F.min("loss").alias("lo"), F.max("loss").alias("hi"), F.count("*").alias("k"))
    rows = loss.join(F.broadcast(span)).withColumn("raw", F.exp(-eta * (F.col("loss") - F.col("lo")) / F.when(F.col("hi") > F.col("lo"), F.col("hi") - F.col("lo")).otherwise(1.0)))
    total = rows.agg(F.sum("raw").alias("all"))
    w = F.when(floor * F.col("k") >= 1, 1 / F.col("k")).otherwise(floor + (1 - floor * F.col("k")) * F.col("raw") / F.col("all"))
    return rows.join(F.broadcast(total)).select("member", "loss", w.alias("weight"))


def pool_binary(forecasts: DataFrame, cap: float = 1.0, weights: DataFrame | None = None, method: str = "logodds", trim: float = 0.0, bias: DataFrame | None = None) -> DataFrame:
    """Per question: weighted pool ('logodds', 'linear' or 'median') of log-odds less each member's ``bias`` (member,
    correction), extremised by how far members agree and differ.

    ``trim`` leaves out that share of members, one at least, at each end where five or more answered."""
    if method not in ("logodds", "linear", "median"):
        raise ValueError(f"unknown method {method!r}; choose from logodds, linear, median")
    rows = forecasts.withColumn("w", F.lit(1.0)) if weights is None else forecasts.join(weights.select("member", F.col("weight").alias("w")), "member")
    lo = logit(F.col("p"))
    if bias is not None:
        rows = rows.join(bias.select("member", "correction"), "member", "left")
        lo = lo - F.coalesce("correction", F.lit(0.0))
    rows = rows.withColumn("_lo", lo)
    inner = F.lit(True)
    if trim > 0:
        n, at = F.count("*").over(W.partitionBy("question")), F.row_number().over(W.partitionBy("question").orderBy("_lo", "member"))
        k = F.greatest(F.lit(1), F.floor(n * trim))
        inner = (n < 5) | (n <= 2 * k) | ((at > k) & (at <= n - k))
    rows = rows.withColumn("_in", inner)
    w, x = F.when(F.col("_in"), F.col("w")), F.when(F.col("_in"), F.col("_lo"))
    pooled = {"logodds": F.sum(w * x) / F.sum(w), "linear": logit(F.sum(w * expit(x)) / F.sum(w)), "median": F.median(x)}[method]
    g = rows.groupBy("question").agg(
        F.count("*").alias("n"), pooled.alias("pooled_logit"), F.coalesce(F.stddev_samp("p"), F.lit(0.0)).alias("dispersion"),
        F.abs(2 * F.avg((F.col("p") > 0.5).cast("double")) - 1).alias("agreement"), F.median("p").alias("median_p"), F.max("y").alias("y"),
    )
    independence = F.least(F.greatest(F.col("dispersion") / 0.25, F.lit(0.0)), F.lit(1.0)) * F.col("agreement")
    g = g.withColumns({"independence": independence, "a": 1 + (cap - 1) * independence})
    return g.withColumn("pooled", expit(F.col("a") * F.col("pooled_logit")))


def fit_extremise_cap(forecasts: DataFrame, grid: list[float]) -> DataFrame:
    """Mean Brier score of the pool under each cap; the grid is a handful of constants."""
    caps = forecasts.sparkSession.createDataFrame([(c,) for c in grid], "cap double")
    p = pool_binary(forecasts).join(F.broadcast(caps)).withColumn("q", expit((1 + (F.col("cap") - 1) * F.col("independence")) * F.col("pooled_logit")))
    return p.groupBy("cap").agg(F.avg((F.col("q") - F.col("y")) ** 2).alias("brier"))


def pool_quantiles(quantiles: DataFrame) -> DataFrame:
    """Vincentised quantiles of (question, q, value), made monotone by a running maximum."""
    m = quantiles.groupBy("question", "q").agg(F.avg("value").alias("value"), F.coalesce(F.stddev_samp("value"), F.lit(0.0)).alias("spread"))
    return m.withColumn("value", F.max("value").over(W.partitionBy("question").orderBy("q").rowsBetween(W.unboundedPreceding, 0)))


def pool_categorical(distributions: DataFrame) -> DataFrame:
    """Log pool of (question, member, outcome, p), renormalised, with its entropy in bits."""
    s = distributions.groupBy("question", "outcome").agg(F.avg(F.log(clamp(F.col("p")))).alias("s"))
    every = W.partitionBy("question")
    e = s.withColumn("e", F.exp(F.col("s") - F.max("s").over(every)))
    e = e.withColumn("pooled", F.col("e") / F.sum("e").over(every))
    return e.select("question", "outcome", "pooled", (-F.sum(F.col("pooled") * F.log2("pooled")).over(every)).alias("entropy_bits"))


def multicategory(distributions: DataFrame) -> DataFrame:
    """Per (question, member) of (question, member, outcome, p, actual): sum of squared errors over the outcomes, and the log
    score of what happened, an outcome without a share counting as 0."""
    hit = (F.col("outcome") == F.col("actual")).cast("double")
    g = distributions.groupBy("question", "member").agg(F.sum((F.col("p") - hit) ** 2).alias("brier"), F.max(F.when(hit == 1, F.col("p"))).alias("p_actual"))
    return g.select("question", "member", "brier", (-F.log(clamp(F.coalesce("p_actual", F.lit(0.0))))).alias("log_score"))


#: Resolved questions from which weights, bias corrections and the cap are fitted anew.
RETUNE_GATES = {"weights": 25, "bias_corrections": 30, "extremise_cap": 50}


def retune_gates(track: DataFrame, gates: dict[str, int] = RETUNE_GATES) -> DataFrame:
    """(parameter, resolved, needed, applied, note): what so many resolved questions of (question, member) allow to refit."""
    n = track.agg(F.countDistinct("question").alias("resolved"), F.count_if(F.col("member") != "__council__").alias("_members"))
    rows = n.select("resolved", "_members", F.explode(F.create_map(*[F.lit(x) for kv in gates.items() for x in kv])).alias("parameter", "needed"))
    enough = (F.col("resolved") >= F.col("needed")) & (F.col("_members") > 0)
    note = F.when(~enough, F.concat(F.col("resolved").cast("string"), F.lit(" resolved questions; need "), F.col("needed").cast("string"), F.lit("."))).otherwise("")
    return rows.select("parameter", "resolved", "needed", enough.alias("applied"), note.alias("note"))


def retune(track: DataFrame, grid: list[float], gates: dict[str, int] = RETUNE_GATES) -> DataFrame:
    """(parameter, member, value): weights, bias corrections and the best cap of the grid fitted on (question, member, p, y),
    each only where its gate is passed; the rest keeps its old value and has no row here. The cap has no member."""
    own = track.where("member <> '__council__'")
    passed = F.broadcast(retune_gates(track, gates).where("applied").select("parameter"))
    weights = hedge_weights(own).select(F.lit("weights").alias("parameter"), "member", F.col("weight").alias("value"))
    bias = bias_corrections(member_scores(own)).select(F.lit("bias_corrections").alias("parameter"), "member", F.col("correction").alias("value"))
    answered = own.withColumn("_n", F.count("*").over(W.partitionBy("question"))).where("_n >= 2").drop("_n")
    best = fit_extremise_cap(answered, grid).agg(F.min_by("cap", F.struct("brier", "cap")).alias("value")).where("value is not null")
    cap = best.select(F.lit("extremise_cap").alias("parameter"), F.lit(None).cast("string").alias("member"), "value")
    return weights.unionByName(bias).unionByName(cap).join(passed, "parameter", "left_semi")


def council_against_members(track: DataFrame) -> DataFrame:
    """One row of (question, member, p, y): Brier scores of the pool, of its best member, of members on average, and
    whether pooling helps; none where the pool has no score."""
    each = scored(track).groupBy("member").agg(F.avg("brier").alias("b"))
    council, other = F.col("member") == "__council__", F.col("member") != "__council__"
    out = each.agg(F.max(F.when(council, F.col("b"))).alias("council"), F.min(F.when(other, F.col("b"))).alias("best_member"), F.avg(F.when(other, F.col("b"))).alias("mean_member"))
    return out.where("council is not null").withColumn("helps", F.coalesce(F.col("council") < F.col("mean_member"), F.lit(False)))


def dissent(forecasts: DataFrame, pooled: DataFrame, gap: float = 0.15) -> DataFrame:
    """Per question: members far from the pool, and the one farthest."""
    rows = forecasts.join(pooled.select("question", "pooled"), "question").withColumn("d", F.abs(F.col("p") - F.col("pooled")))
    return rows.groupBy("question").agg(F.count_if(F.col("d") >= gap).alias("n_dissent"), F.max_by("member", F.struct("d", "member")).alias("strongest"), F.max("d").alias("distance"))


def dispersion_categorical(distributions: DataFrame) -> DataFrame:
    """Per question of (question, member, outcome, p): mean of half the divergences, in bits, of each member from
    the mean and back; 0 for one member."""
    each = W.partitionBy("question", "member")
    p = distributions.withColumn("_p", F.greatest("p", F.lit(EPS)))
    p = p.withColumn("_p", F.col("_p") / F.sum("_p").over(each))
    p = p.withColumn("_m", F.avg("_p").over(W.partitionBy("question", "outcome")))
    both = F.sum(0.5 * (F.col("_p") - F.col("_m")) * F.log2(F.col("_p") / F.col("_m")))
    return p.groupBy("question", "member").agg(both.alias("d")).groupBy("question").agg(F.count("*").alias("n_members"), F.when(F.count("*") > 1, F.avg("d")).otherwise(0.0).alias("dispersion"))


def pooled_standard_error(forecasts: DataFrame) -> DataFrame:
    """Per question: deviation of the members' log-odds over the root of their number; infinite for one."""
    n = F.count("p")
    return forecasts.groupBy("question").agg(n.alias("n"), F.when(n < 2, float("inf")).otherwise(F.stddev_samp(logit(F.col("p"))) / F.sqrt(n)).alias("se"))


def track_record(rows: DataFrame, half_life: float | None = None, bins: int = 10) -> DataFrame:
    """Per member of (member, position, kind, p, y, brier, log_score, crps): rows, means of the scores, calibration
    error, reliability and resolution, skill against the base rate, bias in log-odds.

    With ``half_life``, a score counts by how many later ones there are, binary rows before categorical ones,
    by position. A member's rows are numbered in one task, so keep a member to what a task can sort."""
    order = F.when(F.col("kind") == "binary", 0).when(F.col("kind") == "categorical", 1).otherwise(2)
    rows = rows.withColumn("_k", order)

    def mean(c: str, kinds: Column) -> tuple[Column, Column]:
        counted = F.when(kinds & F.col(c).isNotNull(), F.col(c))
        if half_life is None:
            return F.lit(1.0), counted
        later = F.count(counted).over(W.partitionBy("member").orderBy(F.desc("_k"), F.desc("position")).rowsBetween(W.unboundedPreceding, 0)) - 1
        return F.pow(F.lit(0.5), later / half_life), counted

    scores = {"brier": F.col("_k") < 2, "log_score": F.col("_k") < 2, "crps": F.col("_k") == 2}
    made = {c: mean(c, kinds) for c, kinds in scores.items()}
    rows = rows.withColumns({f"_w_{c}": w for c, (w, _) in made.items()} | {f"_v_{c}": v for c, (_, v) in made.items()})
    means = rows.groupBy("member").agg(F.count("*").alias("n"), *[(F.sum(F.col(f"_w_{c}") * F.col(f"_v_{c}")) / F.sum(F.when(F.col(f"_v_{c}").isNotNull(), F.col(f"_w_{c}")))).alias(f"mean_{c}") for c in scores])

    binary, y = rows.where("kind = 'binary'"), F.col("y").cast("double")
    edges = F.array(*[F.lit(i / bins) for i in range(1, bins)])
    right, left = F.greatest(F.ceil(F.col("p") * bins), F.lit(1)).cast("int"), F.size(F.filter(edges, lambda e: e <= F.col("p")))
    cells = binary.groupBy("member", right.alias("_r"), left.alias("_l")).agg(F.count("*").alias("n"), F.sum("p").alias("sp"), F.sum(y).alias("sy"), F.sum(logit(F.col("p"))).alias("sl"))
    base = cells.groupBy("member").agg(F.sum("n").alias("n_binary"), (F.sum("sy") / F.sum("n")).alias("base"), (F.sum("sl") / F.sum("n")).alias("ml"))
    sums = lambda k: cells.groupBy("member", k).agg(*[F.sum(c).alias(c) for c in ("n", "sp", "sy")]).join(base, "member")
    ece = sums("_r").groupBy("member").agg((F.sum(F.abs(F.col("sp") - F.col("sy"))) / F.max("n_binary")).alias("ece"))
    fy = F.col("sy") / F.col("n")
    split = sums("_l").groupBy("member").agg((F.sum(F.col("n") * (fy - F.col("sp") / F.col("n")) ** 2) / F.max("n_binary")).alias("reliability"), (F.sum(F.col("n") * (fy - F.col("base")) ** 2) / F.max("n_binary")).alias("resolution"))
    unc = F.col("base") * (1 - F.col("base"))
    out = means.join(base, "member", "left").join(ece, "member", "left").join(split, "member", "left")
    return out.select("member", "n", *[f"mean_{c}" for c in scores], "ece", "reliability", "resolution", F.when(unc > 0, 1 - F.col("mean_brier") / unc).alias("skill"), (F.col("ml") - logit(F.col("base"))).alias("bias_logit"))


def coerce(frame: DataFrame) -> DataFrame:
    """Answers (probability, distribution, quantile_values, confidence) made usable: percents to shares, clipped;
    distributions add up to 1; ``problem`` says what can't be mended (fixed texts), else null."""
    p = F.when(F.col("probability") > 1, F.col("probability") / 100).otherwise(F.col("probability"))
    total = F.aggregate(F.map_values("distribution"), F.lit(0.0), lambda a, v: a + v)
    shares = F.when(total > 0, F.when(F.abs(total - 1) > 1e-6, F.transform_values("distribution", lambda _, v: v / total)).otherwise(F.col("distribution")))
    values = F.transform(F.array_sort(F.transform(F.map_entries("quantile_values"), lambda e: F.struct(e["key"].cast("double").alias("q"), e["value"].alias("v")))), lambda e: e["v"])
    falls = F.exists(F.zip_with(values, F.slice(values, 2, F.greatest(F.size(values), F.lit(1))), lambda a, b: b < a), lambda x: F.coalesce(x, F.lit(False)))
    none = F.coalesce(F.col("probability").isNull() & (F.coalesce(F.size("distribution"), F.lit(0)) <= 0) & (F.coalesce(F.size("quantile_values"), F.lit(0)) <= 0), F.lit(True))
    problem = F.when(none, "no answer").when(F.size("distribution") > 0, F.when(total <= 0, "categorical distribution sums to <= 0")).when(falls, "quantiles must be non-decreasing")
    return frame.withColumns({"probability": F.when(p.isNotNull(), F.least(F.greatest(p, F.lit(0.0)), F.lit(1.0))), "distribution": shares, "confidence": F.least(F.greatest(F.coalesce("confidence", F.lit(0.5)), F.lit(0.0)), F.lit(1.0)), "problem": problem})
