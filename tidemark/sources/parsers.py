"""Parsers of landed feeds: text or JSON columns in, tidy rows out."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F


def fred_csv(lines: DataFrame) -> DataFrame:
    """'date,value' lines (a column ``value``), '.' and headers left out."""
    parts = F.split("value", ",")
    out = lines.select(parts[0].try_cast("date").alias("date"), F.get(parts, F.lit(1)).try_cast("double").alias("value"))
    return out.where("date is not null and value is not null")


def world_bank(raw: DataFrame) -> DataFrame:
    """[meta, rows] documents (a column ``value``); a year stands for its last day."""
    rows = F.from_json(F.get_json_object("value", "$[1]"), "array<struct<date:string,value:double>>")
    return raw.select(F.explode(rows).alias("x")).where("x.value is not null").select(F.make_date(F.col("x.date").cast("int"), F.lit(12), F.lit(31)).alias("date"), F.col("x.value").alias("value"))


def chart_json(raw: DataFrame, zone: str = "Asia/Kolkata") -> DataFrame:
    """Parallel arrays of times and closes as (date, close), nulls left out, dates of the exchange."""
    j = F.from_json("value", "struct<timestamp:array<long>,close:array<double>>")
    x = raw.select(F.explode(F.arrays_zip(j["timestamp"].alias("t"), j["close"].alias("close"))).alias("x")).where("x.close is not null")
    return x.select(F.to_date(F.from_utc_timestamp(F.timestamp_seconds("x.t"), zone)).alias("date"), F.col("x.close").alias("close"))


def ohlcv(raw: DataFrame, zone: str = "Asia/Kolkata") -> DataFrame:
    """Chart documents (a column ``value``) as (symbol, date, open, high, low, close, volume, adj_close), rows without a close
    left out, dates of the exchange; adj_close is null where a document has none."""
    quote = "array<struct<open:array<double>,high:array<double>,low:array<double>,close:array<double>,volume:array<long>>>"
    result = f"array<struct<meta:struct<symbol:string>,timestamp:array<long>,indicators:struct<quote:{quote},adjclose:array<struct<adjclose:array<double>>>>>>"
    r = raw.select(F.get(F.from_json(F.get_json_object("value", "$.chart.result"), result), F.lit(0)).alias("r")).where("r is not null")
    q = r.select(F.col("r.meta.symbol").alias("symbol"), F.col("r.timestamp").alias("t"), F.get("r.indicators.quote", F.lit(0)).alias("q"), F.get("r.indicators.adjclose", F.lit(0))["adjclose"].alias("adj"))
    x = q.select("symbol", "q", "adj", F.posexplode("t").alias("i", "t"))
    at = lambda c: F.get(c, F.col("i"))
    day = F.to_date(F.from_utc_timestamp(F.timestamp_seconds("t"), zone))
    return x.select("symbol", day.alias("date"), *[at(F.col(f"q.{c}")).alias(c) for c in ("open", "high", "low", "close", "volume")], at(F.col("adj")).alias("adj_close")).where("close is not null")


def nav_text(lines: DataFrame, block: int = 100_000) -> DataFrame:
    """Semicolon lines (file, n, value) of fund prices: columns are found by the file's own header, lines without semicolons
    name the house or, with brackets, the category of those below. Prices that aren't numbers are left out.

    A file without the header, or whose header lacks a needed column, is an error. Names are carried down inside blocks
    of lines, and from block to block by one row a block, so that a long file isn't one task."""
    heads = lines.where(F.startswith("value", F.lit("Scheme Code;"))).groupBy("file").agg(F.min_by("value", "n").alias("_head"), F.min("n").alias("_top"))
    rows = lines.where(F.trim("value") != "").join(heads, "file", "left").withColumn("_head", F.coalesce("_head", F.raise_error(F.concat(F.lit("no header row in "), F.col("file").cast("string")))))
    rows = rows.where("_top is null or n > _top").withColumns({"_cols": F.transform(F.split("_head", ";"), lambda c: F.lower(F.trim(c))), "_parts": F.split(F.trim("value"), ";"), "_block": F.floor(F.col("n") / block)})
    mark = F.size("_parts") == 1
    kind = F.trim("value").rlike(r"Schemes\(|\)$")
    rows = rows.withColumns({"_category": F.when(mark & kind, F.trim("value")), "_house": F.when(mark & ~kind, F.trim("value"))})
    names = ("house", "category")
    ends = rows.groupBy("file", "_block").agg(*[F.max_by(f"_{c}", F.when(F.col(f"_{c}").isNotNull(), F.col("n"))).alias(f"_{c}") for c in names])
    before = W.partitionBy("file").orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    ends = ends.select("file", "_block", *[F.last(f"_{c}", ignorenulls=True).over(before).alias(f"_{c}_before") for c in names])
    inside = W.partitionBy("file", "_block").orderBy("n").rowsBetween(W.unboundedPreceding, 0)
    rows = rows.join(ends, ["file", "_block"]).withColumns({c: F.coalesce(F.last(f"_{c}", ignorenulls=True).over(inside), F.col(f"_{c}_before")) for c in names})

    def place(*words, exact=False):
        fits = (lambda c: c == words[0]) if exact else (lambda c: F.forall(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(c, w)))
        return F.array_position(F.transform("_cols", fits), True) - 1

    def cell(*words):
        i = place(*words)
        return F.trim(F.get("_parts", F.when(i >= 0, i.cast("int")).otherwise(F.raise_error(F.concat(F.lit(f"no column {' '.join(words)} in "), F.col("_head"))))))

    def optional(name):
        i = place(name, exact=True)
        return F.when(i >= 0, F.trim(F.get("_parts", i.cast("int"))))

    full = rows.where(F.size("_parts") >= F.size("_cols"))
    nav = cell("net asset value").try_cast("double")
    return full.select("house", "category", cell("scheme", "code").alias("code"), cell("isin", "growth").alias("isin"), cell("scheme", "name").alias("name"), optional("plan").alias("plan"), optional("option").alias("option"), nav.alias("nav"), F.try_to_timestamp(cell("date"), F.lit("dd-MMM-yyyy")).cast("date").alias("date")).where("nav is not null")


def feed_items(raw: DataFrame, source: str, tier: str) -> DataFrame:
    """Items of an RSS or Atom document (a column ``value``), identified by source and title."""
    item = raw.select(F.explode(F.regexp_extract_all("value", F.lit(r"(?is)<(?:item|entry)\b.*?</(?:item|entry)>"), F.lit(0))).alias("x"))

    def field(name):
        body = F.regexp_extract("x", rf"(?is)<{name}\b[^>]*>(.*?)</{name}>", 1)
        return F.trim(F.regexp_replace(F.regexp_replace(body, r"(?s)<!\[CDATA\[(.*?)\]\]>", "$1"), r"<[^>]*>", ""))

    out = item.select(F.left(field("title"), F.lit(300)).alias("title"), F.left(F.coalesce(F.nullif(field("description"), F.lit("")), field("summary")), F.lit(600)).alias("summary"), F.left(field("link"), F.lit(500)).alias("url"))
    return out.withColumns({"id": F.substring(F.sha2(F.concat(F.lit(f"{source}|"), "title"), 256), 1, 16), "source": F.lit(source), "tier": F.lit(tier)})


def option_legs(raw: DataFrame) -> DataFrame:
    """Records with CE and PE sub-structs, one row a leg."""
    leg = "struct<openInterest:long,lastPrice:double,bidprice:double,askPrice:double>"
    j = F.from_json("value", f"array<struct<strikePrice:double,expiryDate:string,CE:{leg},PE:{leg}>>")
    x = raw.select(F.explode(j).alias("x"))
    legs = x.select("x.strikePrice", "x.expiryDate", F.explode(F.array(*[F.struct(F.lit(s).alias("side"), F.col(f"x.{s}").alias("leg")) for s in ("CE", "PE")])).alias("l")).where("l.leg is not null")
    return legs.select(F.col("strikePrice").alias("strike"), F.col("expiryDate").alias("expiry"), "l.side", F.col("l.leg.openInterest").alias("oi"), F.col("l.leg.lastPrice").alias("ltp"), F.col("l.leg.bidprice").alias("bid"), F.col("l.leg.askPrice").alias("ask"))
