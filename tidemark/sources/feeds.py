"""More landed feeds as tidy rows: rates, metals, countries, catalogues, run logs; and ages and dates of documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

#: Date formats that are tried in this order; those without a zone are Indian time.
DATE_FORMATS = [
    "d MMM yyyy HH:mm:ss Z", "d MMM yyyy HH:mm:ss z", "d MMM yyyy HH:mm:ss", "d MMM, yyyy Z", "d MMM yyyy Z", "d MMM, yyyy", "d MMM yyyy", "yyyy-MM-dd'T'HH:mm:ssXXX", "yyyy-MM-dd'T'HH:mm:ssZ",
    "yyyy-MM-dd'T'HH:mm:ss'Z'", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd", "dd-MMM-yyyy",
]
UNDATED_HOURS = 1e6


def fx_history(raw: DataFrame, quote: str) -> DataFrame:
    """{rates: {date: {currency: rate}}} documents (a column ``value``) as (date, rate)."""
    j = F.from_json(F.get_json_object("value", "$.rates"), "map<string,map<string,double>>")
    return raw.select(F.explode(j).alias("d", "m")).select(F.col("d").cast("date").alias("date"), F.try_element_at("m", F.lit(quote)).alias("rate")).where("rate is not null")


def fx_spot(raw: DataFrame) -> DataFrame:
    """{rates: {currency: rate}} documents as (currency, rate)."""
    return raw.select(F.explode(F.from_json(F.get_json_object("value", "$.rates"), "map<string,double>")).alias("currency", "rate"))


def metal_prices(raw: DataFrame) -> DataFrame:
    """[{d, v: [usd, gbp, eur]}] documents; missing places of the array are null."""
    x = raw.select(F.explode(F.from_json("value", "array<struct<d:string,v:array<double>>>")).alias("x"))
    return x.select(F.col("x.d").cast("date").alias("date"), *[F.get(F.col("x.v"), F.lit(i)).alias(c) for i, c in enumerate(("usd", "gbp", "eur"))]).where("date is not null")


def tone_problem(value: Column) -> Column:
    """Why a reply holds no timeline (fixed texts), else null: the service turned it away, it isn't JSON, or it is empty."""
    timeline = F.from_json(F.get_json_object(value, "$.timeline"), "array<struct<data:array<struct<date:string,value:double>>>>")
    throttled = F.contains(F.lower(F.substring(F.coalesce(value, F.lit("")), 1, 300)), F.lit("limit requests"))
    return F.when(throttled, "rate limit hit").when(F.get_json_object(value, "$").isNull(), "not JSON").when(F.coalesce(F.size(timeline), F.lit(0)) <= 0, "empty timeline")


def tone_timeline(raw: DataFrame, strict: bool = False) -> DataFrame:
    """{timeline: [{data: [{date, value}]}]} documents as (date, tone). Replies with a ``tone_problem`` have no rows, or with
    ``strict`` are an error."""
    if strict:
        problem = tone_problem(F.col("value"))
        raw = raw.withColumn("value", F.when(problem.isNotNull(), F.raise_error(F.concat(F.lit("no timeline: "), problem)).cast("string")).otherwise(F.col("value")))
    points = F.flatten(F.transform(F.from_json(F.get_json_object("value", "$.timeline"), "array<struct<data:array<struct<date:string,value:double>>>>"), lambda t: t["data"]))
    return raw.select(F.explode(points).alias("x")).select(F.to_date(F.substring("x.date", 1, 8), "yyyyMMdd").alias("date"), F.col("x.value").alias("tone"))


def countries(raw: DataFrame) -> DataFrame:
    """[meta, rows] documents of countries, aggregates left out."""
    rows = F.from_json(F.get_json_object("value", "$[1]"), "array<struct<id:string,name:string,region:struct<value:string>,incomeLevel:struct<value:string>>>")
    return raw.select(F.explode(rows).alias("x")).select(F.col("x.id").alias("iso3"), "x.name", F.col("x.region.value").alias("region"), F.col("x.incomeLevel.value").alias("income")).where("region <> 'Aggregates'")


def compare_countries(rows: DataFrame, names: list[str]) -> DataFrame:
    """(iso3, date, value) with a column a country, named so that no pass finds them."""
    return rows.groupBy("date").pivot("iso3", names).agg(F.first("value"))


def labelled_rates(pages: DataFrame, labels: dict[str, str], key: str = "page_id", html: str = "html") -> DataFrame:
    """(page, series, value): the first number in the three tokens after each label of a stripped page."""
    tokens = F.filter(F.split(F.regexp_replace(F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1>", "\n"), r"<[^>]*>", "\n"), r"\s*\n\s*"), lambda t: t != "")
    place = W.partitionBy(key).orderBy("at")
    rows = pages.select(key, F.posexplode(tokens).alias("at", "token"))
    ahead = F.array(*[F.lead("token", i).over(place) for i in (1, 2, 3)])
    number = F.get(F.filter(F.transform(ahead, lambda t: F.regexp_extract(t, r"(\d+(?:\.\d+)?)\s*%?", 1)), lambda t: t != ""), F.lit(0))
    known = F.create_map(*[F.lit(x) for kv in labels.items() for x in kv])
    rows = rows.withColumns({"value": number.try_cast("double"), "series": F.try_element_at(known, F.lower(F.trim("token")))})
    return rows.where("series is not null and value is not null").groupBy(key, "series").agg(F.min_by("value", "at").alias("value"))


#: Documents beside the runs that aren't runs.
NOT_RUNS = ("resolutions.json", "tuning.json")


def run_logs(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One JSON document a file, but for those that aren't runs; files that can't be read are left out."""
    docs = spark.read.schema(schema).option("multiLine", True).option("mode", "DROPMALFORMED").option("pathGlobFilter", "*.json").json(path)
    return docs.where(~F.col("_metadata.file_name").isin(*NOT_RUNS))


def parsed_time(text: Column, zone: str = "Asia/Kolkata") -> Column:
    """The first format that fits, as a UTC time; null if none does. A text without a zone is of ``zone``;
    a weekday before it is left out."""
    text, found = F.regexp_replace(text, r"^\s*[A-Za-z]{3,9},\s*", ""), []
    for f in DATE_FORMATS:
        t = F.try_to_timestamp(text, F.lit(f))
        found.append(t if any(z in f for z in ("Z", "z", "X")) else F.to_utc_timestamp(t, zone))
    return F.coalesce(*found)


def age_hours(published: Column, now: Column) -> Column:
    """Hours since, never below 0; undated documents are very old."""
    return F.coalesce(F.greatest((F.unix_timestamp(now) - F.unix_timestamp(published)) / 3600, F.lit(0.0)), F.lit(UNDATED_HOURS))


def retrieve(documents: DataFrame, per_source: int, max_hours: float) -> DataFrame:
    """The first documents of each source (by ``position``) that are young enough, one an id, the youngest."""
    first = documents.withColumn("_n", F.row_number().over(W.partitionBy("source").orderBy("position"))).where(F.col("_n") <= per_source).where(F.col("age_hours") <= max_hours)
    young = W.partitionBy("id").orderBy("age_hours", "source", "position")
    return first.withColumn("_n", F.row_number().over(young)).where("_n = 1").drop("_n")


def search(catalogue: DataFrame, query: str, *columns: str) -> DataFrame:
    """Rows whose columns hold every word of the query."""
    hay = F.lower(F.concat_ws(" ", *columns))
    for w in query.lower().split():
        catalogue = catalogue.where(F.contains(hay, F.lit(w)))
    return catalogue


def matching_or_all(rows: DataFrame, label: str, query: str) -> DataFrame:
    """Rows whose label holds a word of the query; all rows if none does."""
    words = [w for w in query.lower().split() if len(w) > 2]
    hit = F.exists(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(F.lower(label), w)) if words else F.lit(False)
    marked = rows.withColumn("_hit", hit)
    some = marked.agg(F.coalesce(F.bool_or("_hit"), F.lit(False)).alias("_some"))
    return marked.join(F.broadcast(some)).where("_hit or not _some").drop("_hit", "_some")


def citations(frame: DataFrame, cited: str, known: str) -> DataFrame:
    """``frame`` with citations that don't exist, and the share of the evidence that is cited."""
    return frame.withColumns({"unknown": F.array_except(cited, known), "coverage": F.size(F.array_intersect(cited, known)) / F.nullif(F.size(F.array_distinct(known)), F.lit(0))})


def noise(title: Column, patterns: dict[str, str], least: int = 15) -> Column:
    """Label of the first noise pattern that fits, 'short' for a short title, else null."""
    return F.coalesce(*[F.when(title.rlike(p), F.lit(k)) for k, p in patterns.items()], F.when(F.length(title) < least, F.lit("short")))


#: Metals and their feeds; commodities with series, unit and frequency.
METAL_FEEDS = {"gold": "gold_pm", "gold_am": "gold_am", "silver": "silver"}
COMMODITIES = {
    "brent": ("DCOILBRENTEU", "USD/bbl", "daily"), "wti": ("DCOILWTICO", "USD/bbl", "daily"), "natural_gas": ("DHHNGSP", "USD/MMBtu", "daily"), "copper": ("PCOPPUSDM", "USD/tonne", "monthly"),
    "aluminium": ("PALUMUSDM", "USD/tonne", "monthly"), "wheat": ("PWHEAMTUSDM", "USD/tonne", "monthly"), "commodity_index": ("PALLFNFINDEXM", "index", "monthly"),
}


def commodity(name: str, metals: DataFrame, series: DataFrame) -> DataFrame:
    """(date, value, unit) of a commodity: metals (feed, date, usd, ...) by their feed, others (series_id, date, value)."""
    if name in METAL_FEEDS:
        return metals.where(F.col("feed") == METAL_FEEDS[name]).select("date", F.col("usd").alias("value"), F.lit("USD/oz").alias("unit")).where("value is not null")
    if name not in COMMODITIES:
        raise ValueError(f"unknown commodity {name!r}; choose from {sorted(COMMODITIES | METAL_FEEDS)}")
    code, unit, _ = COMMODITIES[name]
    return series.where(F.col("series_id") == code).select("date", "value", F.lit(unit).alias("unit")).where("value is not null")


def data_rows(raw: DataFrame, schema: str, path: str = "$.data") -> DataFrame:
    """Objects of the array at ``path`` of JSON documents (a column ``value``; '$' for the document), as rows."""
    body = F.col("value") if path == "$" else F.get_json_object("value", path)
    return raw.select(F.inline(F.from_json(body, f"array<struct<{schema}>>")))


def option_expiries(raw: DataFrame) -> DataFrame:
    """{expiryDates: [...]} documents as (expiry), in their order within a document."""
    return raw.select(F.explode(F.from_json(F.get_json_object("value", "$.expiryDates"), "array<string>")).alias("expiry"))


def longest_table(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """(page, n_rows, rows): cells, without tags, of the table with the most rows of a page, the first of equals; pages without
    tables are left out. Tables aren't nested."""
    every = lambda text, tag: F.regexp_extract_all(text, F.lit(rf"(?is)<{tag}\b[^>]*>(.*?)</{tag}>"), F.lit(1))
    plain = lambda c: F.trim(F.regexp_replace(F.regexp_replace(c, r"<[^>]*>", " "), r"\s+", " "))
    tables = F.filter(F.transform(every(F.col(html), "table"), lambda t: every(t, "tr")), lambda r: F.size(r) > 0)
    best = F.aggregate(tables, F.array().cast("array<string>"), lambda a, b: F.when(F.size(b) > F.size(a), b).otherwise(a))
    out = pages.select(key, best.alias("_t")).where(F.size("_t") > 0)
    return out.select(key, F.size("_t").alias("n_rows"), F.transform("_t", lambda r: F.transform(every(r, "t[dh]"), plain)).alias("rows"))


def track_record(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines of scored forecasts; lines that can't be read are left out."""
    schema = "member string, question_id string, kind string, p double, y int, brier double, log_score double, crps double, resolved_at string"
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def run_document(runs: DataFrame) -> DataFrame:
    """Rows as one JSON document each (a column ``value``), to be written as text."""
    return runs.select(F.to_json(F.struct(*[F.col(c) for c in runs.columns])).alias("value"))


def rate_observations(rates: DataFrame, now: Column) -> DataFrame:
    """(series_id, label, date, value, unit) as observations known from ``now`` on, the label as metadata."""
    return rates.select("series_id", F.col("date").alias("event_date"), now.alias("available_at"), F.col("value").cast("double").alias("value"), "unit", F.lit("RBI").alias("source"), F.to_json(F.struct("label")).alias("meta"))


def categories(schemes: DataFrame, holds: str = "", limit: int = 25) -> DataFrame:
    """The categories with the most schemes, of those whose name holds a text."""
    counts = schemes.where(F.contains(F.lower("category"), F.lit(holds.lower()))).groupBy("category").agg(F.count("*").alias("schemes"))
    return counts.orderBy(F.desc("schemes"), "category").limit(limit)
