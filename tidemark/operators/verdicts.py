"""What a panel says, how settings compare, where a forecaster stands."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from ..functions.stats import EPS, expit, logit, t_two_sided
from . import forecasts as fc

#: A member this far from the pool dissents.
DISSENT = 0.15


def verdicts(questions: DataFrame, forecasts: DataFrame, weights: DataFrame | None = None, cap: float = 1.8) -> DataFrame:
    """One row a question (question, kind, outcomes, quantiles): the pool of its usable forecasts, by kind.

    ``forecasts``: question, member, parse_ok, probability, distribution (outcome to share), quantile_values (level to value),
    citations. Binary ones pool log-odds, extremised up to ``cap``, no probability counting as a half; categorical ones pool
    logs of shares over the question's outcomes; numeric ones average values at each of its levels, kept from falling.
    With them: dispersion, members that dissent and the farthest one, members that cite nothing, entropy or width. Members
    that ``weights`` (member, weight) lacks count 1, negative ones 0; where all are 0 they are equal. Without a usable
    forecast a binary question is a half, and ``note`` says so. A question's members are a panel, not a table.
    """
    usable = forecasts.where(F.col("parse_ok")).drop("weight")
    if weights is None:
        usable = usable.withColumn("_w", F.lit(1.0))
    else:
        usable = usable.join(weights.select("member", F.greatest(F.coalesce("weight", F.lit(1.0)), F.lit(0.0)).alias("_w")), "member", "left").withColumn("_w", F.coalesce("_w", F.lit(1.0)))
    usable = usable.withColumn("_w", F.when(F.sum("_w").over(W.partitionBy("question")) > 0, F.col("_w")).otherwise(1.0))
    rows = usable.join(questions.select("question", "kind", "outcomes", "quantiles"), "question")
    panel = rows.groupBy("question").agg(F.count("*").alias("n_members"), F.count_if(F.coalesce(F.size("citations"), F.lit(0)) <= 0).alias("uncited"))

    binary = rows.where("kind = 'binary'").select("question", "member", F.coalesce("probability", F.lit(0.5)).alias("p"), F.lit(None).cast("int").alias("y"), "_w")
    spread = F.coalesce(F.stddev_samp("p"), F.lit(0.0))
    agree = F.abs(2 * F.avg((F.col("p") > 0.5).cast("double")) - 1)
    pool = binary.groupBy("question").agg((F.sum(F.col("_w") * logit(F.col("p"))) / F.sum("_w")).alias("l"), spread.alias("dispersion"), (F.least(spread / 0.25, F.lit(1.0)) * agree).alias("independence"))
    pool = pool.select("question", expit((1 + (cap - 1) * F.col("independence")) * F.col("l")).alias("probability"), "dispersion")
    far = fc.dissent(binary, pool.select("question", F.col("probability").alias("pooled")), DISSENT).select("question", "n_dissent", "strongest")
    binary = pool.join(far, "question")

    shares = rows.where("kind = 'categorical'").select("question", "member", "_w", F.explode("outcomes").alias("outcome"), F.col("distribution").alias("d"))
    shares = shares.select("question", "member", "_w", "outcome", F.greatest(F.coalesce(F.try_element_at("d", F.col("outcome")), F.lit(0.0)), F.lit(EPS)).alias("p"))
    shares = shares.withColumn("p", F.col("p") / F.sum("p").over(W.partitionBy("question", "member")))
    logs = shares.groupBy("question", "outcome").agg((F.sum(F.col("_w") * F.log("p")) / F.sum("_w")).alias("l"))
    every = W.partitionBy("question")
    e = logs.withColumn("e", F.exp(F.col("l") - F.max("l").over(every)))
    e = e.withColumn("p", F.col("e") / F.sum("e").over(every))
    pooled = e.groupBy("question").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("outcome", "p")))).alias("distribution"), (-F.sum(F.col("p") * F.log2(F.greatest("p", F.lit(EPS))))).alias("entropy_bits"))
    categorical = pooled.join(fc.dispersion_categorical(shares).select("question", "dispersion"), "question")

    values = rows.where("kind = 'numeric'").select("question", "member", "_w", F.explode("quantiles").alias("q"), "quantile_values")
    values = values.withColumn("v", F.try_element_at("quantile_values", F.col("q").cast("string"))).where(F.col("v").isNotNull() & ~F.isnan("v") & (F.abs("v") < float("inf")))
    level = values.groupBy("question", "q").agg((F.sum(F.col("_w") * F.col("v")) / F.sum("_w")).alias("v"), F.coalesce(F.stddev_samp("v"), F.lit(0.0)).alias("spread"))
    level = level.withColumn("v", F.max("v").over(W.partitionBy("question").orderBy("q")))
    numeric = level.groupBy("question").agg(
        F.map_from_entries(F.transform(F.array_sort(F.collect_list(F.struct("q", "v"))), lambda x: F.struct(x["q"].cast("string").alias("q"), x["v"].alias("v")))).alias("quantile_values"),
        F.coalesce(F.max(F.when(F.col("q") == 0.5, F.col("spread"))), F.lit(0.0)).alias("dispersion"), F.avg("spread").alias("member_spread"), (F.max_by("v", "q") - F.min_by("v", "q")).alias("width"),
    )
    all_of = binary.unionByName(categorical, allowMissingColumns=True).unionByName(numeric, allowMissingColumns=True)
    out = questions.select("question", "kind").join(panel, "question", "left").join(all_of, "question", "left")
    none = F.col("n_members").isNull()
    return out.select(
        "question", "kind", F.coalesce("n_members", F.lit(0)).alias("n_members"), F.when(none & (F.col("kind") == "binary"), 0.5).otherwise(F.col("probability")).alias("probability"), "distribution", "quantile_values",
        F.coalesce("dispersion", F.lit(0.0)).alias("dispersion"), F.coalesce("n_dissent", F.lit(0)).alias("n_dissent"), "strongest", F.coalesce("uncited", F.lit(0)).alias("uncited"), "entropy_bits", "member_spread", "width",
        F.when(none, "no parseable forecasts; verdict is the uninformative prior").alias("note"),
    )


def compare_arms(scores: DataFrame, assignments: DataFrame, arms: dict[str, list[str]], least: int = 30, alpha: float = 0.05) -> DataFrame:
    """One row for each setting and arm of an experiment: n, mean and standard error of ``brier`` (question, brier) over the questions
    assigned to it (question, setting, arm), and for the setting the winner, p and decision.

    Arms of ``least`` scores count; with two of them the lowest mean meets all scores of the others in Welch's test. Arms
    without a score are rows too; assignments to others, and questions without a score, are left out. Sums are all that is shuffled.
    """
    spark = scores.sparkSession
    grid = spark.createDataFrame([(s, i, a) for s, names in arms.items() for i, a in enumerate(names)], "setting string, place int, arm string")  # a handful of rows
    rows = assignments.join(scores.where("brier is not null").select("question", "brier"), "question")
    sums = rows.groupBy("setting", F.col("arm").cast("string").alias("arm")).agg(F.count("*").alias("n"), F.avg("brier").alias("mean"), F.var_samp("brier").alias("var"))
    each = F.broadcast(grid).join(sums, ["setting", "arm"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    enough = F.col("n") >= least
    best = each.where(enough).groupBy("setting").agg(F.count("*").alias("k"), F.min_by(F.struct("arm", "n", "mean", "var"), F.struct("mean", "place")).alias("b"))
    rest = each.where(enough).join(best, "setting").where(F.col("arm") != F.col("b.arm"))
    # Of several arms together: sizes, means and variances add up to those of all their scores.
    size, total = F.sum("n"), F.sum(F.col("n") * F.col("mean"))
    squares = F.sum((F.col("n") - 1) * F.col("var") + F.col("n") * F.col("mean") ** 2)
    other = rest.groupBy("setting").agg(F.first("b").alias("b"), size.alias("n2"), (total / size).alias("m2"), ((squares - total**2 / size) / (size - 1)).alias("v2"))
    a, b = F.col("b.var") / F.col("b.n"), F.col("v2") / F.col("n2")
    t = (F.col("b.mean") - F.col("m2")) / F.nullif(F.sqrt(a + b), F.lit(0.0))
    df = (a + b) ** 2 / (a**2 / (F.col("b.n") - 1) + b**2 / (F.col("n2") - 1))
    tested = other.select("setting", F.col("b.arm").alias("winner"), t.alias("t"), df.alias("df"), t_two_sided(t, df).alias("p"))
    out = each.join(tested, "setting", "left")
    decision = F.when(F.col("winner").isNull(), "not enough evidence").when(F.col("p") < alpha, "winner scored better").otherwise("no significant difference")
    return out.select("setting", "arm", "n", "mean", F.when(F.col("n") > 1, F.sqrt(F.col("var") / F.col("n"))).alias("se"), "winner", "t", "df", "p", decision.alias("decision"))


#: Published Brier scores that forecasters are set beside.
REFERENCES = {
    "Always saying 50%": 0.25,
    "Human crowd (Halawi et al. 2024)": 0.149,
    "o3, direct prediction": 0.1352,
    "Metaculus community prediction": 0.126,
    "Karger et al. 2025 crowd": 0.121,
    "Metaculus proprietary ensemble": 0.107,
    "Superforecaster median": 0.10,
}
#: Resolved questions below which a score is noise, and below which comparing it says nothing.
ENOUGH_FOR_A_NUMBER, ENOUGH_TO_COMPARE = 30, 100


def scoreboard(track: DataFrame) -> DataFrame:
    """Each member of a track record (member, kind, position, p, y, ...) beside each published score: its Brier score, base rate and skill against
    it, calibration error, resolution, the difference, whether so few questions carry a comparison, and a verdict.

    The verdict says which: too few, worse than the base rate, no better (skill under 0.05), or better.
    """
    binary = track.where("kind = 'binary'")
    more = binary.groupBy("member").agg(F.count("*").alias("n_resolved"), F.avg((F.col("p") - F.col("y")) ** 2).alias("own_brier"), F.avg(F.col("y").cast("double")).alias("base_rate"))
    missing = [c for c in ("brier", "log_score", "crps") if c not in track.columns]
    kept = fc.track_record(binary.withColumns({c: F.lit(None).cast("double") for c in missing})).select("member", "ece", "resolution")
    unc = F.col("base_rate") * (1 - F.col("base_rate"))
    s = more.join(kept, "member").withColumn("skill", F.when(unc > 0, 1 - F.col("own_brier") / unc))
    refs = track.sparkSession.createDataFrame(list(REFERENCES.items()), "reference string, reference_brier double")  # seven rows
    verdict = F.when(F.col("n_resolved") < ENOUGH_FOR_A_NUMBER, "too few").when(F.col("skill") < 0, "worse than the base rate").when(F.col("skill") < 0.05, "no better than the base rate").otherwise("better than the base rate")
    return s.join(F.broadcast(refs)).select(
        "member", "n_resolved", F.col("own_brier").alias("brier"), "base_rate", unc.alias("base_rate_brier"), "skill", "ece", "resolution", "reference", "reference_brier",
        (F.col("own_brier") - F.col("reference_brier")).alias("difference"), (F.col("n_resolved") >= ENOUGH_TO_COMPARE).alias("carries"), verdict.alias("verdict"),
    )
