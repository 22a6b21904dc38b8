"""Portfolios and projections: replayed history, buckets of holdings, simulated savings and goals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .series import scan

#: Fixed values of the buckets: beta, volatility, segment, traded value a day, duration.
BUCKETS = {
    "large_cap": (0.95, 0.16, "large", 2e9, 0.0),
    "mid_small_cap": (1.35, 0.24, "mid", 8e7, 0.0),
    "index_fund": (1.0, 0.16, "large", 5e8, 0.0),
    "gold": (-0.05, 0.15, "large", 1e9, 0.0),
    "debt": (0.05, 0.04, "large", 5e8, 3.5),
    "international": (0.75, 0.18, "large", 1e9, 0.0),
    "cash": (0.0, 0.0, "large", 1e10, 0.0),
}
BUCKET_COLUMNS = "bucket string, beta double, vol double, cap_segment string, adv double, duration double"
#: Words that put a holding in a bucket, looked for in this order, and names of large companies.
BUCKET_WORDS = {
    "gold": ("gold", "sgb", "sovereign gold", "gold etf", "goldbees", "silver"),
    "debt": ("fd", "fixed deposit", "debt", "bond", "ppf", "epf", "nps", "liquid fund", "gilt", "g-sec", "gsec", "rd", "recurring"),
    "international": ("us stock", "us equity", "s&p", "sp500", "nasdaq", "international", "global fund", "foreign"),
    "index_fund": ("index fund", "nifty bees", "niftybees", "etf", "index", "nifty 50 fund", "sensex fund"),
    "cash": ("cash", "savings", "bank balance", "idle"),
    "mid_small_cap": ("midcap", "mid cap", "smallcap", "small cap", "microcap", "small-cap", "mid-cap"),
}
LARGE_CAPS = (
    "reliance", "tcs", "hdfc", "infosys", "infy", "icici", "sbi", "state bank", "bharti", "airtel", "itc", "kotak", "axis", "lt", "larsen", "bajaj",
    "asian paint", "maruti", "sun pharma", "titan", "ultratech", "wipro", "nestle", "hul", "hindustan unilever", "adani", "ntpc", "ongc", "powergrid",
    "coal india", "tata steel", "tata motors", "jsw", "grasim", "cipla", "dr reddy", "britannia", "eicher", "hero", "divis", "hcl", "tech mahindra",
    "indusind", "bpcl", "ioc", "sbi life", "hdfc life", "apollo", "shriram",
)
#: Correlation of buckets, and deviations of a one-in-twenty year on either side.
CORRELATION, RANGE = 0.6, 1.65


def replay(returns: DataFrame, weights: DataFrame, book: str = "book", rows_per_block: int | None = None) -> DataFrame:
    """Per book of ``weights`` (book, entity, weight): total return, deepest fall, worst and best day, annual
    volatility, days that move more than 2 % on the path of ``returns``. With ``rows_per_block`` a book is as many
    tasks as it has blocks of days."""
    day = returns.join(weights, "entity").groupBy(book, "date").agg(F.sum(F.col("weight") * F.col("r")).alias("r"))
    if rows_per_block:
        day = scan(day, [book], ["date"], {"level": ("product", 1 + F.col("r"))}, rows_per_block=rows_per_block)
        day = scan(day, [book], ["date"], {"_high": ("max", F.col("level"))}, rows_per_block=rows_per_block).withColumn("fall", F.col("level") / F.col("_high") - 1)
    else:
        path = W.partitionBy(book).orderBy("date").rowsBetween(W.unboundedPreceding, 0)
        day = day.withColumn("level", F.exp(F.sum(F.log1p("r")).over(path)))
        day = day.withColumn("fall", F.col("level") / F.max("level").over(path) - 1)
    return day.groupBy(book).agg((F.max_by("level", "date") - 1).alias("total_return"), F.min("fall").alias("max_drawdown"), F.min("r").alias("worst_day"), F.max("r").alias("best_day"), (F.stddev_samp("r") * 252**0.5).alias("vol"), F.count_if(F.abs("r") > 0.02).alias("days_over_2pct"))


def _holds(name: Column, words) -> Column:
    low = F.lower(F.trim(name))
    return F.exists(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(low, w))


def bucket_of(name: Column, words: dict[str, tuple[str, ...]] = BUCKET_WORDS) -> Column:
    """Bucket of a holding by the first words found in its name; large_cap if there are none."""
    return F.coalesce(*[F.when(_holds(name, terms), F.lit(bucket)) for bucket, terms in words.items()], F.lit("large_cap"))


def bucket_guessed(name: Column) -> Column:
    """Whether neither the words of a bucket nor a large company's name stand in the holding's name."""
    return ~_holds(name, [w for terms in BUCKET_WORDS.values() for w in terms] + list(LARGE_CAPS))


def analyse(holdings: DataFrame, book: str = "book") -> DataFrame:
    """Per book of (book, name, value): total, Herfindahl index, volatility under one correlation of the
    buckets, and the range of a one-in-twenty year. Buckets are a handful of rows."""
    facts = holdings.sparkSession.createDataFrame([(k, *v) for k, v in BUCKETS.items()], BUCKET_COLUMNS)
    rows = holdings.withColumn("bucket", bucket_of(F.col("name"))).join(F.broadcast(facts), "bucket")
    s = rows.groupBy(book).agg(F.sum("value").alias("total"), F.sum(F.col("value") ** 2).alias("ss"), F.sum(F.col("value") * F.col("vol")).alias("wv"))
    per = rows.groupBy(book, "bucket").agg(F.sum(F.col("value") * F.col("vol")).alias("bv")).groupBy(book).agg(F.sum(F.col("bv") ** 2).alias("own"))
    vol = F.sqrt((1 - CORRELATION) * F.col("own") + CORRELATION * F.col("wv") ** 2) / F.nullif(F.col("total"), F.lit(0.0))
    return s.join(per, book).select(book, "total", (F.col("ss") / F.nullif(F.col("total") ** 2, F.lit(0.0))).alias("hhi"), vol.alias("vol"), (-RANGE * vol * F.col("total")).alias("bad_year"), (RANGE * vol * F.col("total")).alias("good_year"))


def fx_decomposition(rows: DataFrame, by: str = "entity") -> DataFrame:
    """(entity, date, price, rate): return in local terms, of the currency, of both together, and what is left."""
    first, last = (lambda c: F.min_by(c, "date")), (lambda c: F.max_by(c, "date"))
    g = rows.where("price is not null and rate is not null").groupBy(by).agg((last("price") / first("price") - 1).alias("local"), (last("rate") / first("rate") - 1).alias("fx"))
    total = (1 + F.col("local")) * (1 + F.col("fx")) - 1
    return g.select(by, "local", "fx", total.alias("total"), (F.col("local") * F.col("fx")).alias("interaction"), (F.col("fx") / F.nullif(total, F.lit(0.0))).alias("fx_share"))


def normal_paths(spark, rate: float, vol: float, n_sims: int, n_months: int, seed: int = 12345) -> DataFrame:
    """(sim, month, r) of an asset with a fixed rate a year. The draws come from hashes of simulation and
    month, so they don't depend on the number of partitions."""
    unit = lambda k: (F.pmod(F.xxhash64(F.lit(seed + k), "sim", "month"), F.lit(1 << 30)) + 0.5) / float(1 << 30)
    z = F.sqrt(-2 * F.log(unit(0))) * F.cos(2 * F.pi() * unit(1))
    sims = spark.range(n_sims).select(F.col("id").alias("sim"), F.explode(F.sequence(F.lit(0), F.lit(n_months - 1))).alias("month"))
    return sims.select("sim", "month", ((1 + rate) ** (1 / 12) - 1 + vol / 12**0.5 * z).alias("r"))


def outcomes(paths: DataFrame) -> DataFrame:
    """Per simulation: what 1 put in at the start and 1 put in each month become, and the deepest fall.

    The first monthly contribution earns from the second month on.
    """
    keys = [c for c in ("asset", "sim") if c in paths.columns]
    path = W.partitionBy(*keys).orderBy("month").rowsBetween(W.unboundedPreceding, 0)
    rows = paths.withColumn("level", F.exp(F.sum(F.log1p("r")).over(path)))
    rows = rows.withColumn("fall", F.col("level") / F.greatest(F.max("level").over(path), F.lit(1.0)) - 1)
    return rows.groupBy(*keys).agg(F.max_by("level", "month").alias("lump"), (F.max_by("level", "month") * F.sum(1 / F.col("level"))).alias("monthly"), F.count("*").alias("n_months"), F.min("fall").alias("max_drawdown"))


def project(paths: DataFrame, amount: float, mode: str = "lump", inflation: float = 0.055, deposit: float = 0.068, tax: float = 0.125, exempt: float = 125_000.0) -> DataFrame:
    """Percentiles of what ``amount``, put in at once or every month, becomes: nominal, deflated, after tax;
    with the chances of a loss, of losing to prices and of losing to a deposit. A row an asset if the paths
    have a column ``asset``."""
    if mode not in ("lump", "monthly"):
        raise ValueError("mode is lump or monthly")
    years = F.col("n_months") / 12
    paid = F.lit(amount) if mode == "lump" else amount * F.col("n_months")
    deposit_month = (1 + deposit) ** (1 / 12) - 1
    saved = amount * F.pow(F.lit(1 + deposit), years) if mode == "lump" else amount * (F.pow(F.lit(1 + deposit_month), F.col("n_months")) - 1) / deposit_month
    keys = [c for c in ("asset",) if c in paths.columns]
    t = outcomes(paths).select(*keys, paid.alias("paid"), (amount * F.col(mode)).alias("nominal"), F.pow(F.lit(1 + inflation), years).alias("prices"), saved.alias("saved"), "max_drawdown")
    t = t.withColumns({"real": F.col("nominal") / F.col("prices"), "after_tax": F.col("nominal") - tax * F.greatest(F.col("nominal") - F.col("paid") - exempt, F.lit(0.0))})
    cuts = {"p05": 0.05, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p95": 0.95}
    each = [F.percentile(c, q).alias(f"{c}_{k}") for c in ("nominal", "real", "after_tax") for k, q in cuts.items()]
    chance = lambda c: F.avg(c.cast("double"))
    return t.groupBy(*keys).agg(*each, chance(F.col("nominal") < F.col("paid")).alias("p_loss"), chance(F.col("real") < F.col("paid")).alias("p_below_prices"), chance(F.col("nominal") < F.col("saved")).alias("p_below_deposit"), F.percentile("max_drawdown", 0.05).alias("deep_fall"))


def plan_goal(paths: DataFrame, target: float) -> DataFrame:
    """What must be put in each month, or at once, to reach ``target`` on half and on four fifths of the paths."""
    o = outcomes(paths)
    return o.agg((target / F.percentile("monthly", 0.5)).alias("monthly_50"), (target / F.percentile("monthly", 0.2)).alias("monthly_80"), (target / F.percentile("lump", 0.5)).alias("lump_50"), (target / F.percentile("lump", 0.2)).alias("lump_80"))
