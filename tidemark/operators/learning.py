"""Variable screening and experiments: false discovery rates, rank correlation, arms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .prose import relevant


def benjamini_hochberg(tests: DataFrame, q: float = 0.10, by: list[str] | None = None, order: str = "p") -> DataFrame:
    """(…, p) with rank, adjusted p and survival. Tests are one row a candidate, ranked within ``by``, by p or
    by a column ``order`` that stands for p without the last bits of a sum."""
    by = by or []
    up = W.partitionBy(*by).orderBy(order, "candidate")
    rows = tests.withColumns({"rank": F.row_number().over(up), "m": F.count("*").over(W.partitionBy(*by))})
    back = W.partitionBy(*by).orderBy(F.desc("rank")).rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumn("adjusted", F.least(F.min(F.col("p") * F.col("m") / F.col("rank")).over(back), F.lit(1.0)))
    return rows.withColumn("survives", F.col("adjusted") <= q).drop("m")


def average_rank(value: str, by: list[str]) -> Column:
    """Rank in which ties share the mean of their places."""
    same = F.count("*").over(W.partitionBy(*by, value))
    return F.rank().over(W.partitionBy(*by).orderBy(value)) + (same - 1) / 2


def spearman(rows: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    ranked = rows.withColumns({"_rx": average_rank(x, by), "_ry": average_rank(y, by)})
    return ranked.groupBy(*by).agg(F.corr("_rx", "_ry").alias("rho"), F.count("*").alias("n"))


def lead_lag(candidate: DataFrame, target: DataFrame, by: str, lag: int) -> DataFrame:
    """(date, by, x, y): each candidate's value with that of the target ``lag`` rows later, in the sequence of
    the dates that the candidate or the target has.

    The target, a row a date, is laid beside every candidate: as many rows as a full panel has.
    """
    c, t = candidate.select("date", by, "x"), target.select("date", "y")
    panel = t.crossJoin(c.select(by).distinct())
    rows = c.join(panel, ["date", by], "full")
    return rows.withColumn("y", F.lead("y", lag).over(W.partitionBy(by).orderBy("date"))).where("x is not null and y is not null").select("date", by, "x", "y")


def split_chronologically(rows: DataFrame, by: str, train: float = 0.6, purge: int = 3) -> DataFrame:
    """Rows with ``part``: the first share is train, then ``purge`` rows are left out, the rest is test."""
    n = F.row_number().over(W.partitionBy(by).orderBy("date"))
    k = F.count("*").over(W.partitionBy(by))
    cut_at = F.floor(k * train)
    return rows.withColumn("part", F.when(n <= cut_at, "train").when(n > cut_at + purge, "test")).where("part is not null")


def experiment_arms(scores: DataFrame) -> DataFrame:
    """Per (setting, arm): observations, mean and standard error of ``score``."""
    return scores.groupBy("setting", "arm").agg(F.count("*").alias("n"), F.avg("score").alias("mean"), (F.stddev_samp("score") / F.sqrt(F.count("*"))).alias("se"))


def welch(arms: DataFrame) -> DataFrame:
    """Best (lowest) arm of each setting against each other arm: t and degrees of freedom."""
    best = arms.groupBy("setting").agg(F.min_by(F.struct("arm", "n", "mean", "se"), F.struct("mean", "arm")).alias("b"))
    j = arms.join(best, "setting").where(F.col("arm") != F.col("b.arm"))
    v1, v2 = F.col("se") ** 2, F.col("b.se") ** 2
    return j.select("setting", F.col("b.arm").alias("best"), F.col("arm").alias("other"), ((F.col("mean") - F.col("b.mean")) / F.sqrt(v1 + v2)).alias("t"), ((v1 + v2) ** 2 / (v1**2 / (F.col("n") - 1) + v2**2 / (F.col("b.n") - 1))).alias("df"))


def new_ids(today: DataFrame, before: DataFrame, key: str) -> DataFrame:
    """Rows whose key wasn't there before."""
    return today.join(before.select(key), key, "left_anti")


def registry_diff(current: DataFrame, previous: DataFrame, key: str) -> DataFrame:
    """Rows of a registry that its last snapshot lacked; none where there is no snapshot, which this run only lays down."""
    return new_ids(current, previous, key).where(previous.exists())


def indicator_candidates(indicators: DataFrame) -> DataFrame:
    """New indicators (id, name) of a registry as candidates, those whose name promises something for markets."""
    known = indicators.where(relevant(F.col("name"), F.lit("")))
    rationale = F.concat(F.lit("New World Bank indicator '"), F.col("name"), F.lit("' appeared in the registry."))
    return known.select(F.concat(F.lit("wb_"), F.replace(F.lower("id"), F.lit("."), F.lit("_"))).alias("key"), "name", F.lit("world_bank_registry_diff").alias("source"), rationale.alias("rationale"), F.array(F.lit("macro")).alias("asset_classes"), F.col("id").alias("indicator_id"))


def month_end(prices: DataFrame) -> DataFrame:
    """Last price of each month and its change."""
    m = prices.groupBy("entity", F.last_day("date").alias("month")).agg(F.max_by("price", "date").alias("price"))
    return m.withColumn("r", F.col("price") / F.lag("price").over(W.partitionBy("entity").orderBy("month")) - 1)


def trailing_growth(prices: DataFrame, years: int = 10, default: float = 0.055) -> DataFrame:
    """(entity, n_months, growth): an index's yearly growth over its last ``years`` x 12 month ends, which are one step fewer;
    ``default`` where there are no more than that."""
    steps = years * 12
    m = month_end(prices).where("price is not null").withColumn("_n", F.row_number().over(W.partitionBy("entity").orderBy(F.desc("month"))))
    at = lambda k: F.max(F.when(F.col("_n") == k, F.col("price")))
    g = m.groupBy("entity").agg(F.count("*").alias("n_months"), at(1).alias("_last"), at(steps).alias("_first"))
    return g.select("entity", "n_months", F.when(F.col("n_months") > steps, F.pow(F.col("_last") / F.col("_first"), F.lit(1 / years)) - 1).otherwise(default).alias("growth"))


def block_bootstrap(returns: DataFrame, n_sims: int, n_months: int, block: int = 12, seed: int = 7) -> DataFrame:
    """(sim, month, r): chained blocks of the ordered ``returns`` (i, r), starts drawn by a hash.

    The history is one row a month; simulations are what grows, and they are made in parallel.
    """
    n = returns.count()
    size = block if n >= 2 * block else max(1, n // 4)
    sims = returns.sparkSession.range(n_sims).select(F.col("id").alias("sim"), F.explode(F.sequence(F.lit(0), F.lit(n_months - 1))).alias("month"))
    start = F.pmod(F.xxhash64(F.lit(seed), "sim", F.floor(F.col("month") / size)), F.lit(n - size + 1))
    drawn = sims.withColumn("i", (start + F.col("month") % size).cast("long"))
    return drawn.join(F.broadcast(returns), "i").select("sim", "month", "r")


def terminal(paths: DataFrame, amount: float) -> DataFrame:
    """Terminal value of a lump sum on each path."""
    return paths.groupBy("sim").agg((amount * F.exp(F.sum(F.log1p("r")))).alias("terminal"))
