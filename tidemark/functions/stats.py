"""Scalar statistics: column expressions where Spark has what they need, Arrow UDFs where it doesn't."""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F, types as T

EPS = 1e-6


def clamp(p: Column) -> Column:
    return F.when(p.isNotNull(), F.least(F.greatest(p, F.lit(EPS)), F.lit(1 - EPS)))


def logit(p: Column) -> Column:
    return F.log(clamp(p) / (1 - clamp(p)))


def expit(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def norm_ppf(p: float) -> float:
    return NormalDist().inv_cdf(p)


def norm_pdf(z: float) -> float:
    return NormalDist().pdf(z)


@F.pandas_udf(T.DoubleType())
def chi2_sf1(x: pd.Series) -> pd.Series:
    """Upper tail of chi-squared with one degree of freedom."""
    return x.map(lambda v: math.erfc(math.sqrt(v / 2)) if v == v else np.nan)


def chi2_sf2(x: Column) -> Column:
    """Upper tail of chi-squared with two degrees of freedom."""
    return F.exp(-x / 2)


def beta_cdf(x: float, a: float, b: float) -> float:
    """Regularised incomplete beta function by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_cdf(1 - x, b, a)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    c, d = 1.0, 1 / (1 - (a + b) * x / (a + 1) or 1e-300)
    h = d
    for m in range(1, 300):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + num * d or 1e-300)
            c = 1 + num / c or 1e-300
            h *= d * c
        if abs(d * c - 1) < 1e-14:
            break
    return front * h


@F.pandas_udf(T.DoubleType())
def t_two_sided(t: pd.Series, df: pd.Series) -> pd.Series:
    """Two-sided p-value of Student's t."""
    return pd.Series([beta_cdf(v / (v + x * x), v / 2, 0.5) if v > 0 and x == x else np.nan for x, v in zip(t, df)])


def question_id(text: Column, date: Column) -> Column:
    """q_YYYYMMDD_ and twelve hex digits of SHA-256 over text|date."""
    return F.concat(F.lit("q_"), F.date_format(date, "yyyyMMdd"), F.lit("_"), F.substring(F.sha2(F.concat_ws("|", text, date.cast("string")), 256), 1, 12))


def arm(question: Column, setting: str, arms: int) -> Column:
    """Arm of an experiment: the first eight hex digits of SHA-256 over setting:question, modulo."""
    return (F.conv(F.substring(F.sha2(F.concat(F.lit(f"{setting}:"), question.cast("string")), 256), 1, 8), 16, 10).cast("long") % arms).cast("int")


def exact_sum(c: Column) -> Column:
    """Sum of doubles below 1e16 in units of 1e-12, the same in whatever order rows come; short decimals, such as amounts of
    money, add up exactly."""
    return F.sum(c.cast("decimal(28,12)")).cast("double")


def exact_avg(c: Column) -> Column:
    """Mean by :func:`exact_sum`."""
    return exact_sum(c) / F.count(c)
