"""Savings on paths drawn from the history of many assets at once: distributions, taxes, goals, comparisons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

#: Rate of tax on long and short holdings, months from which a holding is long, exempt gain a year.
TAXES = {
    "indian_equity": (0.125, 0.20, 12, 125_000.0),
    "gold": (0.125, 0.30, 24, 0.0),
    "silver": (0.125, 0.30, 24, 0.0),
    "us_equity": (0.125, 0.30, 24, 0.0),
    "fixed_deposit": (0.30, 0.30, 0, 0.0),
    "debt_fund": (0.30, 0.30, 0, 0.0),
}
#: Inflation and a deposit's rate a year, and months of history without which an asset isn't projected.
INFLATION, DEPOSIT, LEAST_MONTHS = 0.055, 0.068, 60
PERCENTS = (5, 10, 25, 50, 75, 90, 95)
#: A prime, and a multiplier of the minimal standard generator for it.
_PRIME, _MULTIPLIER = 2147483647, 48271


def draw(seed: int, *places: Column) -> Column:
    """A number from 0 to 2 ** 31 - 2 that depends on the places and the seed only, in integers that any engine has. Shifted bits
    keep draws of neighbouring seeds apart."""
    x = F.lit(seed * 83492791 % _PRIME).cast("long")
    for place, prime in zip(places, (73856093, 19349663)):
        x = x + place.cast("long") * prime
    x = x % _PRIME
    for _ in range(3):
        x = x.bitwiseXOR(F.shiftright(x, 15)) * _MULTIPLIER % _PRIME
    return x


def fixed_paths(rates: DataFrame, n_sims: int, n_months: int, seed: int = 12345, by: str = "asset") -> DataFrame:
    """(by, sim, month, r): paths of assets with a fixed rate a year (by, rate, vol), each month's return normal around it.

    Draws depend on simulation, month and seed only, the same for each asset. A null rate or volatility makes null returns."""
    sims = rates.select(by, "rate", "vol", F.explode(F.sequence(F.lit(0), F.lit(n_sims - 1))).alias("sim")).withColumn("month", F.explode(F.sequence(F.lit(0), F.lit(n_months - 1))))
    unit = lambda k: (draw(seed + k, F.col("sim"), F.col("month")) + 0.5) / _PRIME
    z = F.sqrt(-2 * F.log(unit(0))) * F.cos(2 * F.pi() * unit(1))
    return sims.select(by, "sim", "month", (F.pow(1 + F.col("rate"), F.lit(1 / 12)) - 1 + F.col("vol") / 12**0.5 * z).alias("r"))


def history_paths(history: DataFrame, n_sims: int, n_months: int, block: int = 12, seed: int = 12345, by: str = "asset") -> DataFrame:
    """(by, sim, month, r): for each asset of ``history`` (by, month, r), ``n_sims`` paths of chained blocks of its consecutive months.

    An asset with less than two blocks of months has blocks of a quarter of them. Draws depend on simulation, block and seed only,
    so neither partitions nor other assets change a path. Null returns are no months; an asset without any has no paths.
    """
    known = history.where(F.col("r").isNotNull()).select(by, F.col("month").alias("_m"), "r")
    months = known.withColumn("i", F.row_number().over(W.partitionBy(by).orderBy("_m")) - 1).select(F.col(by).alias("_by"), "i", "r")
    n = known.groupBy(by).agg(F.count("*").alias("n"))
    size = F.when(F.col("n") >= 2 * block, F.lit(block)).otherwise(F.greatest(F.lit(1), F.floor(F.col("n") / 4))).cast("int")
    sims = n.withColumn("size", size).withColumn("sim", F.explode(F.sequence(F.lit(0), F.lit(n_sims - 1)))).withColumn("month", F.explode(F.sequence(F.lit(0), F.lit(n_months - 1))))
    start = draw(seed, F.col("sim"), F.floor(F.col("month") / F.col("size"))) % (F.col("n") - F.col("size") + 1)
    drawn = sims.withColumn("_i", start + F.col("month") % F.col("size"))
    return drawn.join(months, F.col(by).eqNullSafe(F.col("_by")) & (F.col("_i") == F.col("i"))).select(by, "sim", "month", "r")


def outcomes(paths: DataFrame, by: str = "asset") -> DataFrame:
    """(by, sim, n_months, lump, monthly, drawdown): what 1 becomes that is put in at the start, or each month, and the deepest fall
    from a level that the path has had. A month's own contribution earns from the next one on."""
    path = W.partitionBy(by, "sim").orderBy("month").rowsBetween(W.unboundedPreceding, 0)
    rows = paths.withColumn("level", F.exp(F.sum(F.log1p("r")).over(path)))
    rows = rows.withColumn("fall", F.col("level") / F.max("level").over(path) - 1)
    last = F.max_by("level", "month")
    return rows.groupBy(by, "sim").agg(F.count("*").alias("n_months"), last.alias("lump"), (last * F.sum(1 / F.col("level"))).alias("monthly"), F.min("fall").alias("drawdown"))


def _rules(rules: dict, by: Column, at: int) -> Column:
    """An entry of the asset's rule; assets without one aren't taxed."""
    out = F.lit(0.0)
    for asset, rule in rules.items():
        out = F.when(by == asset, F.lit(float(rule[at]))).otherwise(out)
    return out


def project(paths: DataFrame, amount: float, mode: str = "lump", inflation: float = INFLATION, deposit: float = DEPOSIT, taxes: dict = TAXES, by: str = "asset") -> DataFrame:
    """One row an asset of ``paths`` (by, sim, month, r): percentiles of what ``amount`` becomes, put in at once or monthly, as it is, in
    today's money, after tax and both; chances of less than was put in, of less in today's money, and of less than a deposit
    gives; the median's growth a year; median and worst deep falls. ``taxes``: (long, short, months, exempt) by asset."""
    if mode not in ("lump", "monthly"):
        raise ValueError("mode is lump or monthly")
    if amount <= 0:
        raise ValueError("the amount must be positive")
    n, key = F.col("n_months"), F.col(by)
    years = n / 12
    paid = F.lit(float(amount)) if mode == "lump" else amount * n
    q = (1 + deposit) ** (1 / 12)
    saved = amount * F.pow(F.lit(1 + deposit), years) if mode == "lump" else amount * q * (F.pow(F.lit(q), n) - 1) / (q - 1)
    rate = F.when(n >= _rules(taxes, key, 2), _rules(taxes, key, 0)).otherwise(_rules(taxes, key, 1))
    t = outcomes(paths, by).select(by, "drawdown", paid.alias("paid"), saved.alias("saved"), years.alias("years"), (amount * F.col(mode)).alias("nominal"), rate.alias("rate"), _rules(taxes, key, 3).alias("exempt"), F.pow(F.lit(1 + inflation), years).alias("prices"))
    gain = F.greatest(F.greatest(F.col("nominal") - F.col("paid"), F.lit(0.0)) - F.col("exempt"), F.lit(0.0))
    t = t.withColumns({"real": F.col("nominal") / F.col("prices"), "after_tax": F.col("nominal") - gain * F.col("rate")}).withColumn("net_real", F.col("after_tax") / F.col("prices"))
    cuts = [F.percentile(c, F.array(*[F.lit(p / 100) for p in PERCENTS])).alias(f"_{c}") for c in ("nominal", "real", "after_tax", "net_real")]
    chance = lambda c: F.avg(c.cast("double"))
    g = t.groupBy(by).agg(
        *cuts, F.max("paid").alias("paid"), F.max("years").alias("_y"), F.count("*").alias("n_sims"), chance(F.col("nominal") < F.col("paid")).alias("p_loss"), chance(F.col("real") < F.col("paid")).alias("p_below_prices"),
        chance(F.col("nominal") < F.col("saved")).alias("p_below_deposit"), F.median("drawdown").alias("median_fall"), F.percentile("drawdown", 0.05).alias("deep_fall"),
    )
    each = [F.col(f"_{c}")[i].alias(f"{c}_p{p}") for c in ("nominal", "real", "after_tax", "net_real") for i, p in enumerate(PERCENTS)]
    growth = F.pow(F.col("_nominal")[PERCENTS.index(50)] / F.col("paid"), 1 / F.col("_y")) - 1
    return g.select(by, "n_sims", "paid", *each, "p_loss", "p_below_prices", "p_below_deposit", growth.alias("median_growth"), "median_fall", "deep_fall")


def plan_goal(paths: DataFrame, target: float, inflation: float = INFLATION, by: str = "asset") -> DataFrame:
    """One row an asset: what must be put in monthly to reach ``target`` on half and on four fifths of its paths, or at once on half; the
    chance of the first, what it adds up to, and the target in today's money."""
    if target <= 0:
        raise ValueError("the target must be positive")
    o = outcomes(paths, by)
    need = o.groupBy(by).agg((target / F.median("monthly")).alias("monthly_50"), (target / F.percentile("monthly", 0.2)).alias("monthly_80"), (target / F.median("lump")).alias("lump_50"), F.max("n_months").alias("_n"))
    reached = o.alias("o").join(need.alias("n"), F.col(f"o.{by}").eqNullSafe(F.col(f"n.{by}"))).groupBy(F.col(f"n.{by}").alias(by), "monthly_50", "monthly_80", "lump_50", "_n").agg(F.avg((F.col("monthly_50") * F.col("monthly") >= target).cast("double")).alias("p_reach"))
    return reached.select(by, "monthly_50", "monthly_80", "lump_50", "p_reach", (F.col("monthly_50") * F.col("_n")).alias("contributed"), (target / F.pow(F.lit(1 + inflation), F.col("_n") / 12)).alias("target_today"))


def compare(history: DataFrame, assets: DataFrame, amount: float, n_months: int, n_sims: int = 20_000, least: int = LEAST_MONTHS, by: str = "asset", **how) -> DataFrame:
    """``project`` for each of ``assets`` (by), with ``error``: an asset with fewer than ``least`` months of history has a row that says so, and nulls."""
    months = history.where(F.col("r").isNotNull()).groupBy(by).agg(F.count("*").alias("_n"))
    wanted = assets.select(by).distinct().join(months, by, "left").withColumn("_n", F.coalesce("_n", F.lit(0)))
    enough = history.join(wanted.where(F.col("_n") >= least).select(by), by, "left_semi")
    made = project(history_paths(enough, n_sims, n_months, by=by), amount, by=by, **how)
    return wanted.join(made, by, "left").withColumn("error", F.when(F.col("_n") < least, F.format_string("%d months of history, need %d", "_n", F.lit(least)))).drop("_n")
