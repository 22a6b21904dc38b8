"""Covariances of wide books by blocks: tiles of dates x entities, multiplied pair by pair.

A join of returns with returns on the date makes a row for each date and pair of entities. Here
Spark deals returns into dense tiles of bounded size and tiles into pairs of blocks of entities; numpy multiplies them, and
sums over dates leave one row a pair of entities, which is the result.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from . import risk

#: Entities and dates of a tile, and date blocks that a pair of tiles' group holds.
ENTITIES, DATES, TOGETHER = 256, 256, 8

_SUMS = ("n", "sw", "sw2", "si", "sj", "sij")


def moments(returns: DataFrame, by: Sequence[str] = (), weight: Column | None = None, entities: int = ENTITIES, dates: int = DATES) -> DataFrame:
    """(by, i, j, n, sw, sw2, si, sj, sij): for each pair of entities, over the dates that both have a return on, their number,
    the sums of ``weight`` (1 by default; a column of ``returns``, the same for all rows of a date) and its square, and the
    weighted sums of i's returns, j's, and their product.

    Null returns don't count; of several returns of an entity on a date the largest does. Null entities, dates and groups
    are entities, dates and groups. Entities and dates are dealt to blocks by their hashes, so a tile is about ``dates`` x ``entities``
    whatever the book holds. Products take sums of returns as they are, whose means are small against their deviations.
    """
    keys = [f"_b{k}" for k in range(len(by))]
    rows = returns.where(F.col("r").isNotNull()).select(*[F.col(f"`{c}`").alias(k) for c, k in zip(by, keys)], F.col("entity"), F.col("date").cast("timestamp").alias("date"), F.col("r").cast("double").alias("r"), (F.lit(1.0) if weight is None else weight).cast("double").alias("w"))
    rows = rows.withColumn("date", F.coalesce(F.unix_micros("date"), F.lit(-(1 << 62))))
    # Only the number of blocks depends on these counts, so estimates do.
    most = rows.groupBy(*keys).agg(F.approx_count_distinct("entity").alias("e"), F.approx_count_distinct("date").alias("d")).agg(F.max("e"), F.max("d")).first()
    blocks, spans = (max(1, math.ceil((m or 1) / size)) for m, size in zip(most, (entities, dates)))
    dealt = rows.withColumns({"_eb": F.pmod(F.xxhash64("entity"), F.lit(blocks)).cast("int"), "_db": F.pmod(F.xxhash64("date"), F.lit(spans)).cast("int")})
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    own = "".join(f"{k} {kinds[k]}, " for k in keys)

    def tile(g: pd.DataFrame) -> pd.DataFrame:
        column, names = pd.factorize(g["entity"], use_na_sentinel=False)
        days, line = np.unique(g["date"].to_numpy(), return_inverse=True)
        x, w = np.full((len(days), len(names)), np.nan), np.empty(len(days))
        np.fmax.at(x, (line, column), g["r"].to_numpy())
        w[line] = g["w"].to_numpy()
        head = {c: [g[c].iloc[0]] for c in [*keys, "_eb", "_db"]}
        return pd.DataFrame(head | {"names": [[None if pd.isna(n) else n for n in names]], "days": [days.astype("<i8").tobytes()], "x": [x.tobytes()], "w": [w.tobytes()]})

    tiles = dealt.groupBy(*keys, "_eb", "_db").applyInPandas(tile, f"{own}_eb int, _db int, names array<{kinds['entity']}>, days binary, x binary, w binary")
    other = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("_o")
    sent = tiles.select("*", other).withColumns({"_i": F.least("_eb", "_o"), "_j": F.greatest("_eb", "_o"), "_g": F.floor(F.col("_db") / TOGETHER)}).drop("_o")

    def product(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        i, j = key[-3], key[-2]
        left, right = {}, {}
        for t in g.to_dict("records"):
            days = np.frombuffer(t["days"], "<i8")
            (left if t["_eb"] == i else right)[t["_db"]] = (list(t["names"]), days, np.frombuffer(t["x"]).reshape(len(days), -1), np.frombuffer(t["w"]))
        if i == j:
            right = left
        names = [list(dict.fromkeys(n for e in side.values() for n in e[0])) for side in (left, right)]
        total = {s: np.zeros((len(names[0]), len(names[1]))) for s in _SUMS}
        at = [{n: k for k, n in enumerate(side)} for side in names]
        for span in left.keys() & right.keys():
            (a, da, xa, w), (b, db, xb, _) = left[span], right[span]
            _, ka, kb = np.intersect1d(da, db, assume_unique=True, return_indices=True)
            xa, xb, w = xa[ka], xb[kb], w[ka][:, None]
            ma, mb = (~np.isnan(xa)).astype(float), (~np.isnan(xb)).astype(float)
            xa, xb = np.nan_to_num(xa), np.nan_to_num(xb)
            where = np.ix_([at[0][n] for n in a], [at[1][n] for n in b])
            for s, (p, q) in {"n": (ma, mb), "sw": (ma * w, mb), "sw2": (ma * w * w, mb), "si": (xa * w, mb), "sj": (ma * w, xb), "sij": (xa * w, xb)}.items():
                total[s][where] += p.T @ q
        k, m = np.nonzero(total["n"])
        left_names, right_names = (pd.Series(n, dtype=object).to_numpy() for n in names)
        found = {"i": left_names[k], "j": right_names[m]} | {s: total[s][k, m] for s in _SUMS}
        out = pd.DataFrame(found)
        if i != j:
            out = pd.concat([out, out.rename(columns={"i": "j", "j": "i", "si": "sj", "sj": "si"})[list(found)]])
        for c, value in zip(reversed(keys), reversed(key[: len(keys)])):
            out.insert(0, c, value)
        return out

    kind = kinds["entity"]
    partial = sent.groupBy(*keys, "_i", "_j", "_g").applyInPandas(product, f"{own}i {kind}, j {kind}, " + ", ".join(f"{s} double" for s in _SUMS))
    sums = partial.groupBy(*keys, "i", "j").agg(*[F.sum(s).alias(s) for s in _SUMS])
    return sums.select(*[F.col(k).alias(c) for c, k in zip(by, keys)], "i", "j", F.col("n").cast("long").alias("n"), *_SUMS[1:])


def sample_cov(returns: DataFrame, by: Sequence[str] = (), **blocks: int) -> DataFrame:
    """(by, i, j, cov, n_obs): what ``risk.sample_cov`` gives, by blocks; null for a pair that shares one date."""
    n = F.col("n")
    return moments(returns, by, **blocks).select(*[f"`{c}`" for c in by], "i", "j", F.when(n > 1, (F.col("sij") - F.col("si") * F.col("sj") / n) / (n - 1)).alias("cov"), n.alias("n_obs"))


def ewma_cov(returns: DataFrame, lam: float = risk.LAMBDA, by: Sequence[str] = (), **blocks: int) -> DataFrame:
    """(by, i, j, cov, n_eff): what ``risk.ewma_cov`` gives for each group, by blocks. Dates are aged a group a task, a row a date."""
    keys = [F.col(f"`{c}`") for c in by]
    days = returns.select(*keys, "date").distinct()
    aged = days.withColumn("_w", (1 - lam) * F.pow(F.lit(lam), F.row_number().over(W.partitionBy(*keys).orderBy(F.desc("date"))) - 1))
    same = F.col("a.date").eqNullSafe(F.col("b.date"))
    for c in by:
        same &= F.col(f"a.`{c}`").eqNullSafe(F.col(f"b.`{c}`"))
    weighted = returns.alias("a").join(aged.alias("b"), same).select(*[F.col(f"a.`{c}`").alias(c) for c in by], "a.entity", "a.date", "a.r", "b._w")
    sw = F.col("sw")
    return moments(weighted, by, F.col("_w"), **blocks).select(*[f"`{c}`" for c in by], "i", "j", (F.col("sij") / sw - F.col("si") * F.col("sj") / sw**2).alias("cov"), (sw**2 / F.col("sw2")).alias("n_eff"))


def shrinkage_cov(returns: DataFrame, method: str = "ledoit_wolf", book: str = "book", **blocks: int) -> DataFrame:
    """(book, i, j, cov, shrinkage, n_filled): covariances shrunk to a scaled identity, in closed form from moments.

    Missing returns count as 0, and their number is reported. The mean, the trace, the squares of all entries and of each
    date's norm are sums, so no task holds a book. Entities without a return are left out; null books are a book.
    """
    if method not in ("ledoit_wolf", "oas"):
        raise ValueError(f"unknown method {method!r}: ledoit_wolf or oas")
    known = returns.where(F.col("r").isNotNull()).select(F.coalesce(F.col(book).cast("string"), F.lit("\0")).alias("k"), "entity", "date", "r")
    known = known.groupBy("k", "entity", "date").agg(F.max("r").alias("r"))
    size = known.groupBy("k").agg(F.countDistinct("date").alias("n"), F.countDistinct(F.struct("entity")).alias("p"), F.count("*").alias("there"))
    sums = moments(known, ["k"], **blocks)
    # On the diagonal the sums are those of all of an entity's returns; what is missing adds 0 to them.
    mean = known.groupBy("k", "entity").agg(F.sum("r").alias("s")).join(size.select("k", "n"), "k").select("k", "entity", (F.col("s") / F.col("n")).alias("m"))
    i, j = (mean.select("k", F.col("entity").alias(e), F.col("m").alias(f"m{e}")) for e in "ij")
    every = i.join(j, "k")  # the result's own rows: pairs that share no date have none in the sums
    full = every.alias("a").join(sums.alias("b"), (F.col("a.k") == F.col("b.k")) & F.col("a.i").eqNullSafe(F.col("b.i")) & F.col("a.j").eqNullSafe(F.col("b.j")), "left").select("a.k", "a.i", "a.j", "mi", "mj", "sij")
    s = full.join(size, "k").withColumn("s", F.coalesce("sij", F.lit(0.0)) / F.col("n") - F.col("mi") * F.col("mj"))
    per_book = s.groupBy("k").agg(F.sum(F.when(F.col("i").eqNullSafe(F.col("j")), F.col("s"))).alias("trace"), F.sum(F.col("s") ** 2).alias("cross"))
    apart = known.alias("a").join(mean.alias("b"), (F.col("a.k") == F.col("b.k")) & F.col("a.entity").eqNullSafe(F.col("b.entity"))).groupBy("a.k", "a.date").agg(F.sum(F.col("r") ** 2 - 2 * F.col("r") * F.col("m")).alias("z"))
    still = mean.groupBy("k").agg(F.sum(F.col("m") ** 2).alias("mm"))
    norms = apart.join(still, "k").groupBy("k").agg(F.sum((F.col("z") + F.col("mm")) ** 2).alias("norms"))
    n, p = F.col("n"), F.col("p")
    mu = F.col("trace") / p
    if method == "ledoit_wolf":
        far = (F.col("cross") - 2 * mu * F.col("trace") + p * mu**2) / p
        d = F.when(far > 0, F.least((F.col("norms") / n - F.col("cross")) / (p * n), far) / far).otherwise(0.0)
    else:
        alpha = F.col("cross") / p**2
        gap = (n + 1) * (alpha - mu**2 / p)
        d = F.when(gap == 0, 1.0).otherwise(F.least((alpha + mu**2) / gap, F.lit(1.0)))
    d = per_book.join(norms, "k").join(size, "k").select("k", mu.alias("mu"), d.alias("d"), (n * p - F.col("there")).alias("n_filled"))
    out = s.select("k", "i", "j", "s").join(d, "k")
    shrunk = (1 - F.col("d")) * F.col("s") + F.when(F.col("i").eqNullSafe(F.col("j")), F.col("d") * F.col("mu")).otherwise(0.0)
    return out.select(F.when(F.col("k") != "\0", F.col("k")).alias(book), "i", "j", shrunk.alias("cov"), F.col("d").alias("shrinkage"), "n_filled")
