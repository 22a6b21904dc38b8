"""Long series: what a window does for one entity, without a task that holds the entity.

A scan has two levels. Rows are dealt into blocks of time; each block's total is one row, and a window over
totals tells what comes before a block. That goes into the block as its first row, so that one window
over (entity, block) ends the work. Trailing windows read blocks of positions that overlap by a window.
Quantiles are found by counting. What a task holds is bounded by a block, whatever an entity holds.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from ..functions.shared import cut

#: Rows of an entity that one block is to hold; a block never has more than a few times as many, but for equal instants.
ROWS_PER_BLOCK = 100_000

#: Running aggregates: over rows, and over the totals of blocks.
_RUNNING: dict[str, Callable[[Column], Column]] = {
    "max": F.max, "min": F.min, "sum": F.sum, "product": F.product, "last": lambda c: F.last(c, ignorenulls=True),
}


def _instant(rows: DataFrame, on: str) -> Column:
    """The order column as a number."""
    kind, c = rows.schema[on].dataType, F.col(f"`{on}`")
    if isinstance(kind, T.DateType):
        return F.unix_date(c).cast("double")
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.unix_micros(c.cast("timestamp")).cast("double")
    return c.cast("double")


def time_block(rows: DataFrame, by: list[str], on: str, rows_per_block: int = ROWS_PER_BLOCK) -> Column:
    """A block number that grows with ``on`` (a date, a time or a number), such that no entity has many more than
    ``rows_per_block`` rows in a block.

    The width is one number, that of the densest entity. Counts of (entity, block) are summed before they are shuffled,
    and narrow the width until the fullest block fits; rows at one instant are never split.
    """
    at = _instant(rows, on)
    keys = [F.col(f"`{c}`") for c in by]
    spread = (F.max(at) - F.min(at)) * rows_per_block / F.count("*")
    width = rows.groupBy(*keys).agg(F.when(F.count("*") > rows_per_block, spread).alias("w")).agg(F.min(F.when(F.col("w") > 0, F.col("w")))).first()[0]
    if width is None:
        return F.when(at.isNotNull(), F.lit(0).cast("long"))
    for _ in range(20):
        block = F.floor(at / width).cast("long")
        full = rows.groupBy(*keys, block.alias("_k")).agg(F.count("*").alias("n"), (F.max(at) > F.min(at)).alias("wide")).agg(F.max(F.when(F.col("wide"), F.col("n")))).first()[0]
        if full is None or full <= 4 * rows_per_block:
            break
        width /= math.ceil(full / rows_per_block)
    return block


def scan(rows: DataFrame, by: list[str], on: list[str], columns: dict[str, tuple[str, Column]], block: Column | None = None, descending: bool = False, exclusive: bool = False, rows_per_block: int = ROWS_PER_BLOCK) -> DataFrame:
    """``rows`` with running aggregates in the order of ``on``: {name: (max, min, sum, product or last, column)}.

    As ``op(column)`` over a window by ``by`` ordered by ``on`` with all rows up to this one, or with ``exclusive`` up to the
    one before; nulls don't count, and nulls of ``on`` come first, or last when ``descending``. ``block`` must not fall as the
    first of ``on`` grows; by default it is ``time_block``. Rows with equal ``on`` are in any order, as in a window. Null keys
    are a group. A column of ``rows`` named as a new one gives way to it; no rows give no rows.
    """
    unknown = {op for op, _ in columns.values()} - set(_RUNNING)
    if unknown:
        raise ValueError(f"unknown aggregates {sorted(unknown)}; choose from {sorted(_RUNNING)}")
    block = time_block(rows, by, on[0], rows_per_block) if block is None else block
    keys, order = [f"_b{i}" for i in range(len(by))], [f"_o{i}" for i in range(len(on))]
    ops = {f"_v{i}": op for i, (op, _) in enumerate(columns.values())}
    tagged = rows.select(
        *[F.col(f"`{c}`").alias(k) for c, k in zip(by, keys)], block.alias("_block"), F.lit(1).alias("_side"), *[F.col(f"`{c}`").alias(k) for c, k in zip(on, order)],
        F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("_row"), *[c.alias(v) for v, (_, c) in zip(ops, columns.values())],
    )
    way = (lambda c: F.col(c).desc_nulls_last()) if descending else (lambda c: F.col(c).asc_nulls_first())
    pick = F.min_by if descending else F.max_by

    def total(op, v):
        return pick(v, F.when(F.col(v).isNotNull(), F.struct(*order))) if op == "last" else _RUNNING[op](F.col(v))

    totals = tagged.groupBy(*keys, "_block").agg(*[total(op, v).alias(v) for v, op in ops.items()])
    earlier = W.partitionBy(*keys).orderBy(way("_block")).rowsBetween(W.unboundedPreceding, -1)
    seeds = totals.select(*keys, "_block", F.lit(0).alias("_side"), *[_RUNNING[op](F.col(v)).over(earlier).alias(v) for v, op in ops.items()])
    inside = W.partitionBy(*keys, "_block").orderBy("_side", *map(way, order)).rowsBetween(W.unboundedPreceding, -1 if exclusive else 0)
    both = tagged.unionByName(seeds, allowMissingColumns=True)
    out = both.select("_side", "_row", *[_RUNNING[op](F.col(v)).over(inside).alias(v) for v, op in ops.items()]).where("_side = 1")
    return out.select(*[F.col(f"_row.`{c}`").alias(c) for c in rows.columns if c not in columns], *[F.col(v).alias(name) for v, name in zip(ops, columns)])


def numbered(rows: DataFrame, by: list[str], on: list[str], name: str = "position", block: Column | None = None, rows_per_block: int = ROWS_PER_BLOCK) -> DataFrame:
    """``rows`` with their place from 0 on in the order of ``on`` within ``by``, as ``row_number`` less 1."""
    out = scan(rows, by, on, {name: ("sum", F.lit(1).cast("long"))}, block, rows_per_block=rows_per_block)
    return out.withColumn(name, F.col(name) - 1)


def rolling(rows: DataFrame, estimator: Callable, window: int, step: int = 1, by: str = "entity", on: str = "date", value: str = "r", block: Column | None = None, rows_per_task: int | None = None, **arguments) -> DataFrame:
    """(by, on, value, estimate, error): what ``estimator`` says of the ``window`` values before each row, none of its own.

    ``estimator(values, **arguments)`` gets a pandas Series indexed by ``on``, and returns a number or something with an
    attribute ``var``. Rows from the ``window``-th on are estimated, every ``step``-th of them. A call that fails, or that gives
    no finite number, leaves ``estimate`` null and says why in ``error``; the others go on. Null values are left out first. An
    entity's positions are dealt to groups of ``rows_per_task`` and the ``window`` before them, so a group holds that many
    rows and every entity is spread over the cluster; an entity with no more than ``window`` values gives no rows.
    """
    if window < 1 or step < 1:
        raise ValueError("window and step are 1 at least")
    size = rows_per_task or max(4 * window, 2048)
    known = rows.where(F.col(value).isNotNull()).select(by, on, F.col(value).cast("double").alias(value))
    placed = numbered(known, [by], [on], "_at", block)
    # Group g has the positions from g * size on, and what the first of them look back on.
    groups = F.sequence(F.floor(F.col("_at") / size), F.floor((F.col("_at") + window) / size))
    dealt = placed.withColumn("_group", F.explode(groups))

    def estimate(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("_at", kind="stable")
        at, values = g["_at"].to_numpy(), pd.Series(g[value].to_numpy(), index=pd.Index(g[on]))
        wanted = np.flatnonzero((at // size == key[1]) & (at >= window) & ((at - window) % step == 0))
        found, errors = [], []
        for i in wanted:
            try:
                got = estimator(values.iloc[i - window : i], **arguments)
                got = float(got if isinstance(got, (int, float, np.number)) else got.var)
                found.append(got if math.isfinite(got) else None)
                errors.append(None if math.isfinite(got) else "no finite number")
            except Exception as failed:  # a fit that fails is an estimate that is missing
                found.append(None)
                errors.append(f"{type(failed).__name__}: {failed}"[:200])
        some = g.iloc[wanted]
        return pd.DataFrame({by: some[by].to_numpy(), on: some[on].to_numpy(), value: some[value].to_numpy(), "estimate": pd.Series(found, dtype="float64").to_numpy(), "error": pd.Series(errors, dtype=object).to_numpy()})

    kinds = {c: rows.schema[c].dataType.simpleString() for c in (by, on)}
    out = dealt.groupBy(by, "_group").applyInPandas(estimate, f"`{by}` {kinds[by]}, `{on}` {kinds[on]}, `{value}` double, estimate double, error string")
    return out.withColumn("estimate", F.when(~F.isnan("estimate"), F.col("estimate")))


#: Bins and accuracy of the sketches that bracket a rank, and values of a bracket that are sorted.
BINS, ACCURACY, SORTED = 512, 5000, 4096


def quantiles(rows: DataFrame, by: list[str], value: str, shares: list[float], few: int = SORTED) -> DataFrame:
    """(by, quantiles): for each group the linear quantiles of ``value`` at ``shares``, as ``percentile`` gives them, bit for bit.

    A sketch of bounded size puts each wanted rank between two values; what lies below and between them is counted, and only
    that goes on, about a hundredth of it each round, until a rank is among ``few`` values, which are sorted, or equal ones. So
    no task holds the values of a group. The values are written once, as rows made anew might differ in the last bit. Nulls and NaN don't count, a group without values isn't in the result; null keys are a group.
    """
    keys = [f"_b{i}" for i in range(len(by))] or ["_b0"]
    v = F.col("v")
    data = rows.select(*([F.col(f"`{c}`").alias(k) for c, k in zip(by, keys)] or [F.lit(0).alias("_b0")]), F.col(value).cast("double").alias("v")).where(v.isNotNull() & ~F.isnan(v))
    data = cut(data)
    ranks = [(share, side) for share in shares for side in (F.floor, F.ceil)]
    every = range(len(ranks))
    bins = [j / BINS for j in range(BINS + 1)]

    def sketch(c):
        return F.percentile_approx(c, bins, ACCURACY)

    def between(edges, rank, n, lo, hi):
        """The two edges around a rank, two bins apart from it; where they don't narrow anything, the value at it."""
        j = F.floor(rank / n * BINS).cast("int")
        near = F.when(j >= 1, F.get(edges, j - 1)).otherwise(lo), F.when(j + 2 <= BINS, F.get(edges, j + 2)).otherwise(hi)
        stuck = (near[0] <= lo) & (near[1] >= hi)
        return F.when(stuck, F.get(edges, j)).otherwise(near[0]), F.when(stuck, F.get(edges, j)).otherwise(near[1])

    whole = data.groupBy(*keys).agg(F.count("*").alias("n"), F.min("v").alias("least"), F.max("v").alias("most"), sketch(v).alias("edges"))
    state = {}
    for t, (share, side) in enumerate(ranks):
        k = side((F.col("n") - 1) * F.lit(share)).cast("long")
        lo, hi = between(F.col("edges"), k, F.col("n"), F.col("least"), F.col("most"))
        small = F.col("n") <= few
        state |= {f"k{t}": k, f"floor{t}": F.col("least"), f"top{t}": F.col("most"), f"below{t}": F.lit(0).cast("long"), f"lo{t}": F.when(small, F.col("least")).otherwise(lo), f"hi{t}": F.when(small, F.col("most")).otherwise(hi), f"done{t}": F.lit(False)}
    state = whole.select(*keys, "n", *[c.alias(name) for name, c in state.items()])

    def joined(data, state):
        same = F.lit(True)
        for k in keys:
            same &= F.col(f"d.{k}").eqNullSafe(F.col(f"s.{k}"))
        return data.alias("d").join(state.alias("s"), same).select("s.*", "d.v")

    for _ in range(100):
        state = cut(state)
        both = joined(data, state)
        tallies = [F.first(c).alias(c) for c in state.columns if c not in keys]
        for t in every:
            inside = v.between(F.col(f"lo{t}"), F.col(f"hi{t}"))
            tallies += [
                F.count_if((v >= F.col(f"floor{t}")) & (v < F.col(f"lo{t}"))).alias(f"b{t}"), F.count_if(inside).alias(f"c{t}"), sketch(F.when(inside & ~F.col(f"done{t}"), v)).alias(f"e{t}"),
                F.max(F.when(v < F.col(f"lo{t}"), v)).alias(f"down{t}"), F.min(F.when(v > F.col(f"hi{t}"), v)).alias(f"up{t}"),
            ]
        now = {}
        for t in every:
            col = lambda name, t=t: F.col(f"{name}{t}")
            before, k = col("below") + col("b"), col("k")
            early, late, found = k < before, k >= before + col("c"), (col("c") <= few) | (col("lo") == col("hi"))
            lo, hi = between(col("e"), k - before, col("c"), col("lo"), col("hi"))

            def pick(if_done, if_early, if_late, if_found, if_on, t=t, early=early, late=late, found=found):
                return F.when(F.col(f"done{t}"), if_done).when(early, if_early).when(late, if_late).when(found, if_found).otherwise(if_on).alias

            # Before the rank was bracketed the bounds move by a value at least; after that, inwards.
            now[f"floor{t}"] = pick(col("floor"), col("floor"), col("up"), col("lo"), col("lo"))
            now[f"below{t}"] = pick(col("below"), col("below"), before + col("c"), before, before)
            now[f"top{t}"] = pick(col("top"), col("down"), col("top"), col("hi"), col("hi"))
            now[f"lo{t}"] = pick(col("lo"), col("floor"), col("up"), col("lo"), lo)
            now[f"hi{t}"] = pick(col("hi"), col("down"), col("top"), col("hi"), hi)
            now[f"done{t}"] = pick(F.lit(True), F.lit(False), F.lit(False), F.lit(True), F.lit(False))
        counted = both.groupBy(*keys).agg(*tallies)
        state = cut(counted.select(*keys, "n", *[f"k{t}" for t in every], *[make(name) for name, make in now.items()]))
        over = state.agg(F.bool_and(F.least(*[F.col(f"done{t}") for t in every]) if len(ranks) > 1 else F.col("done0"))).first()[0]
        left = F.lit(False)
        for t in every:
            left |= v.between(F.col(f"floor{t}"), F.col(f"top{t}"))
        data = cut(joined(data, state).where(left).select(*keys, "v"))
        if over in (True, None):
            break
    else:
        raise RuntimeError("ranks not found in 100 rounds")
    last = [F.first(c).alias(c) for c in ["n", *[f"{name}{t}" for t in every for name in ("k", "below", "lo", "hi")]]]
    # Equal values aren't collected, however many; others are ``few`` at most.
    last += [F.sort_array(F.collect_list(F.when(v.between(F.col(f"lo{t}"), F.col(f"hi{t}")) & (F.col(f"lo{t}") < F.col(f"hi{t}")), v))).alias(f"x{t}") for t in every]
    out, found = joined(data, state).groupBy(*keys).agg(*last), []
    for i, share in enumerate(shares):
        low, high = (F.when(F.col(f"lo{t}") == F.col(f"hi{t}"), F.col(f"lo{t}")).otherwise(F.get(f"x{t}", (F.col(f"k{t}") - F.col(f"below{t}")).cast("int"))) for t in (2 * i, 2 * i + 1))
        at = (F.col("n") - 1) * F.lit(share)
        found.append(F.when((F.floor(at) == F.ceil(at)) | (low == high), low).otherwise((F.ceil(at) - at) * low + (at - F.floor(at)) * high))
    return out.select(*[F.col(k).alias(c) for c, k in zip(by, keys)], F.array(*found).alias("quantiles"))
