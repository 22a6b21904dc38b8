"""Questions and answers in prose: amounts and horizons, asset classes, relevance, JSON inside a reply."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

#: Patterns of amounts and horizons, multiples, words of assets (the first that fits counts).
AMOUNT = r"(?:rs\.?|inr|₹)?\s*([\d,]+(?:\.\d+)?)\s*(lakhs?|lacs?|crores?|cr|k|thousand)?"
HORIZON = r"([\d.]+)\s*(year|yr|y|month|mo)s?\b"
MULTIPLES = {"lakh": 1e5, "lakhs": 1e5, "lac": 1e5, "lacs": 1e5, "crore": 1e7, "crores": 1e7, "cr": 1e7, "k": 1e3, "thousand": 1e3}
ASSET_WORDS = {
    "indian_equity": ("nifty", "sensex", "indian equity", "indian stock", "equity", "shares", "stock market", "index fund", "mutual fund", "elss"),
    "gold": ("gold", "sovereign gold", "gold etf", "bullion"),
    "silver": ("silver",),
    "us_equity": ("us stock", "us equity", "s&p", "nasdaq", "american stock"),
    "fixed_deposit": ("fixed deposit", "fd", "term deposit", "recurring deposit"),
    "debt_fund": ("debt fund", "bond fund", "debt mutual", "liquid fund"),
}
#: Beginnings of words that tell an asset class.
ASSET_HINTS = {
    "real_estate": ("hous", "property", "real estate", "realty", "flat", "apartment", "rent", "mortgage", "home loan", "residex", "land price"),
    "commodity": ("gold", "silver", "crude", "oil price", "commodity", "commodities", "copper", "aluminium", "aluminum", "wheat", "brent", "wti", "natural gas", "bullion"),
    "bond": ("bond", "g-sec", "gsec", "gilt", "debenture", "yield curve", "fixed income", "debt fund"),
    "etf": ("etf", "exchange traded", "index fund", "niftybees", "goldbees"),
    "mutual_fund": ("mutual fund", "sip", "nav", "amc"),
    "equity": ("share", "stock", "nifty", "sensex", "equity", "midcap", "smallcap"),
}
#: Terms that make a dataset worth a look, and those that rule it out.
RELEVANCE_TERMS = (
    "price", "index", "inflation", "gdp", "production", "output", "trade", "export", "import", "credit", "bank", "money", "rate", "yield", "fiscal",
    "deficit", "revenue", "tax", "gst", "employment", "wage", "consumption", "sales", "vehicle", "cement", "steel", "power", "electricity", "energy",
    "fuel", "petroleum", "rainfall", "monsoon", "crop", "agri", "harvest", "reservoir", "freight", "railway", "port", "cargo", "tourism", "housing",
    "property", "investment", "capital", "foreign", "remittance", "currency",
)
NOISE_TERMS = ("sample data", "test data", "dummy", "demo ")


def _holds(text: Column, words) -> Column:
    return F.exists(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(text, w))


def horizon_years(text: Column) -> Column:
    """Years that the first 'N years' or 'N months' names; null without one or beyond 50."""
    low = F.lower(text)
    n = F.regexp_extract(low, HORIZON, 1).try_cast("double")
    years = F.when(F.startswith(F.regexp_extract(low, HORIZON, 2), F.lit("mo")), n / 12).otherwise(n)
    return F.when((years > 0) & (years <= 50), years)


def first_amount(text: Column, least: float) -> Column:
    """The first amount of ``least`` or more, other than the bare number of the horizon; null without one."""
    low = F.lower(text)
    raws, units = (F.regexp_extract_all(low, F.lit(AMOUNT), F.lit(i)) for i in (1, 2))
    times = F.create_map(*[F.lit(x) for kv in MULTIPLES.items() for x in kv])
    years = F.regexp_extract(low, HORIZON, 1)
    value = lambda raw, unit: F.when(~((raw == years) & (unit == "")), F.replace(raw, F.lit(","), F.lit("")).try_cast("double") * F.coalesce(F.try_element_at(times, unit), F.lit(1.0)))
    return F.get(F.filter(F.zip_with(raws, units, value), lambda v: v >= least), F.lit(0))


def asset_of(text: Column) -> Column:
    low = F.lower(text)
    return F.coalesce(*[F.when(_holds(low, words), F.lit(a)) for a, words in ASSET_WORDS.items()], F.lit("indian_equity"))


def projection_of(text: Column) -> Column:
    """(amount, years, asset, mode) of a question; null without an amount of 500 or without a horizon."""
    amount, years = first_amount(text, 500.0), horizon_years(text)
    mode = F.when(F.lower(text).rlike(r"\b(sip|monthly|every month|per month)\b"), "sip").otherwise("lumpsum")
    return F.when(amount.isNotNull() & years.isNotNull(), F.struct(amount.alias("amount"), years.alias("years"), asset_of(text).alias("asset"), mode.alias("mode")))


def goal_of(text: Column) -> Column:
    """(target, years, asset) of a goal; null without an amount of 10,000 or without a horizon."""
    target, years = first_amount(text, 10_000.0), horizon_years(text)
    return F.when(target.isNotNull() & years.isNotNull(), F.struct(target.alias("target"), years.alias("years"), asset_of(text).alias("asset")))


def asset_class(text: Column) -> Column:
    """The class with the most hints in the text, each at the start of a word; of equals the first; null without."""
    hits = {a: F.regexp_count(text, F.lit(r"(?i)(?<![a-z])(" + "|".join(re.escape(w) for w in words) + ")[a-z]*")) for a, words in ASSET_HINTS.items()}
    most = F.greatest(*hits.values())
    found = F.when(most == 0, None)
    for a, n in hits.items():
        found = found.when(n == most, a)
    return found


def coverage_gap(questions: DataFrame, coverage: DataFrame, text: str = "text") -> DataFrame:
    """Questions about a class for which ``coverage`` (asset_class, can_answer; a row a class) has no working source."""
    asked = questions.withColumn("asset_class", asset_class(F.col(text))).where("asset_class is not null")
    return asked.join(coverage.where("can_answer").select("asset_class"), "asset_class", "left_anti")


def relevant(title: Column, description: Column) -> Column:
    hay = F.lower(F.concat(F.coalesce(title, F.lit("")), F.lit(" "), F.coalesce(description, F.lit(""))))
    return ~_holds(hay, NOISE_TERMS) & _holds(hay, RELEVANCE_TERMS)


_PIECES = re.compile(r'"(?:\\.|[^"\\])*"|[{}]', re.S)
_REPAIRS = ((re.compile(r",\s*([}\]])"), r"\1"), (re.compile(r"\bTrue\b"), "true"), (re.compile(r"\bFalse\b"), "false"), (re.compile(r"\b(None|NaN)\b"), "null"))


def _object_in(text: str | None) -> str | None:
    """JSON of the object in a reply: the whole, a fenced block, the first balanced braces; as it is, then mended."""
    if not text or not text.strip():
        return None
    tries, depth, start = [text.strip()], 0, text.find("{")
    tries += [m[1].strip() for m in [re.search(r"```(?:json)?\s*(.*?)```", text, re.S)] if m]
    for m in _PIECES.finditer(text, max(start, 0)) if start >= 0 else ():
        depth += {"{": 1, "}": -1}.get(m[0], 0)
        if depth == 0 and m[0] == "}":
            tries.append(text[start : m.end()])
            break
    for t in tries:
        mended = t
        for pattern, by in _REPAIRS:
            mended = pattern.sub(by, mended)
        for c in (t, mended):
            try:
                value = json.loads(c, parse_constant=lambda _: None)
            except ValueError:
                continue
            if isinstance(value, dict):
                return json.dumps(value)
    return None


@F.pandas_udf(T.StringType())
def extract_json(reply: pd.Series) -> pd.Series:
    """The JSON object in each reply, as text for ``from_json``; null without one."""
    return reply.map(_object_in, na_action="ignore")
