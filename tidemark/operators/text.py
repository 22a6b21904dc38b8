"""Text filters: noise, instructions hidden in text, sanitising, lexical relevance, tiered top-k."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.shared import cut

#: Patterns of text that tries to instruct its reader, with their labels, looked for in this order.
INJECTION = (
    (r"ignore\s+(all\s+|any\s+|your\s+)?(previous|prior|above|earlier)\s+(instructions?|prompts?|rules?|directions?)", "override attempt"),
    (r"disregard\s+(the\s+|all\s+|your\s+)?(previous|above|prior|system)", "override attempt"),
    (r"(new|updated|revised)\s+(instructions?|system\s+prompt|rules?)\s*[:\-]", "instruction injection"),
    (r"you\s+(are|must|should|will)\s+now\s+", "role reassignment"),
    (r"(?:^|\n)\s*(system|assistant|user)\s*[:>\]]", "chat-format spoofing"),
    (r"<\s*/?\s*(system|instructions?|prompt)\s*>", "tag spoofing"),
    (r"\b(respond|reply|answer|output)\s+(only\s+)?with\b", "output hijack"),
    (r"the\s+(correct|true|right)\s+(answer|probability|value)\s+is", "answer injection"),
    (r"set\s+(your\s+)?(probability|confidence|forecast)\s+to", "answer injection"),
    (r"\bBEGIN\s+(SYSTEM|PROMPT|INSTRUCTIONS)", "delimiter spoofing"),
)
#: Weight of overlap, topic words, recency, tier; of tiers; hours to which recency falls.
WEIGHTS, TIERS, RECENT_HOURS = (0.45, 0.30, 0.15, 0.10), {"primary": 1.0, "press": 0.6, "aggregate": 0.3}, 168.0

#: Words of the topic, and titles that say nothing of what will happen, tried in this order.
TOPIC_TERMS = (
    "rbi", "sebi", "repo", "inflation", "cpi", "gdp", "nifty", "sensex", "rupee", "market", "equity", "bond", "yield", "fii", "dii", "flows", "earnings", "results", "policy", "rate",
    "bank", "credit", "fiscal", "budget", "tax", "gst", "crude", "oil", "gold", "monsoon", "export", "import", "deficit", "liquidity", "mpc", "index", "stock", "ipo",
)
NOISE_PATTERNS = (
    r"^\s*(top|best|worst)\s+\d+", r"\b(horoscope|astrology|cricket|bollywood|recipe)\b", r"\bstocks?\s+to\s+(buy|watch)\b", r"\bmultibagger\b", r"\bpenny\s+stock\b",
    r"\bwhat\s+should\s+investors\s+do\b",
)
MIN_TITLE = 15
#: Least relevance of a primary document; share of a model's score; weight of the tier.
PRIMARY_FLOOR, MODEL_SHARE, TIER_PULL, TIER_MID = 0.32, 0.7, 0.35, 0.6


#: Of each pattern, groups of words in lower case: where a text lacks all words of a group, the pattern can't match it.
NEEDS = dict(zip((p for p, _ in INJECTION), (
    (("ignore",), ("previous", "prior", "above", "earlier")), (("disregard",), ("previous", "above", "prior", "system")), (("new", "updated", "revised"), ("instruction", "prompt", "rule")), (("you",), ("now",)),
    (("system", "assistant", "user"),), (("<",), ("system", "instruction", "prompt")), (("respond", "reply", "answer", "output"), ("with",)), (("correct", "true", "right"), ("answer", "probability", "value")),
    (("set",), ("probability", "confidence", "forecast"), ("to",)), (("begin",), ("system", "prompt", "instructions")),
))) | dict(zip(NOISE_PATTERNS, (
    (("top", "best", "worst"),), (("horoscope", "astrology", "cricket", "bollywood", "recipe"),), (("stock",), ("buy", "watch")), (("multibagger",),), (("penny",), ("stock",)), (("what",), ("should",), ("investors",)),
)))


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)``, the value being made once however often it is used."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _may(low: Column, pattern: str) -> Column:
    """Whether a text, in lower case, has the words without which the pattern doesn't match; true of unknown patterns."""
    found = F.lit(True)
    for words in NEEDS.get(pattern, ()):
        some = F.lit(False)
        for w in words:
            some = some | F.contains(low, F.lit(w))
        found = found & some
    return found


def _removed(text: Column, patterns: tuple[tuple[str, str], ...]) -> Column:
    """Matches as [removed], pattern by pattern; that joins no words, so what a pattern needs is looked for in the text as it was."""

    def without(low, p):
        return lambda x: F.when(_may(low, p), F.regexp_replace(x, "(?im)" + p, "[removed]")).otherwise(x)

    def chain(t, low):
        for p, _ in patterns:
            t = _let(t, without(low, p))
        return t

    return _let(text, lambda t: _let(F.lower(t), lambda low: chain(t, low)))


def detect(text: Column, patterns: tuple[tuple[str, str], ...] = INJECTION) -> Column:
    """Labels of the patterns that the text matches in either case, in order, each once."""
    found = _let(text, lambda t: _let(F.lower(t), lambda low: F.array(*[F.when(_may(low, p) & t.rlike("(?im)" + p), F.lit(label)) for p, label in patterns])))
    return F.array_distinct(F.filter(found, lambda x: x.isNotNull()))


def sanitise(text: Column, patterns: tuple[tuple[str, str], ...] = INJECTION) -> Column:
    """Matches as [removed], evidence references as [ref], white space collapsed."""
    text = _let(_removed(text, patterns), lambda x: F.when(F.contains(x, F.lit("[E")), F.regexp_replace(x, r"\[E\d{1,3}\]", "[ref]")).otherwise(x))
    return F.trim(_let(text, lambda x: F.when(x.rlike(r"\s\s|[^\S ]"), F.regexp_replace(x, r"\s+", " ")).otherwise(x)))


#: Fixed value: the label of a text that names evidence as the packet numbers it.
FABRICATED = "fabricated evidence id"


def hidden(text: Column) -> Column:
    """What ``detect`` finds, and whether evidence references stand in what is left: such text would pass for cited."""
    fabricated = F.contains(text, F.lit("[E")) & _removed(text, INJECTION).rlike(r"\[E\d{1,3}\]")
    return F.concat(detect(text), F.when(fabricated, F.array(F.lit(FABRICATED))).otherwise(F.array().cast("array<string>")))


def strip_tags(html: Column) -> Column:
    """Text of a page: scripts, styles, comments and tags out, the common entities read."""
    text = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1>|<!--.*?-->", " ")
    text = F.regexp_replace(text, r"<[^>]*>", " ")
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def relevance(text: Column, terms: list[str], topic: list[str], age_hours: Column, tier: Column) -> Column:
    """Weighted share of question terms held, topic words (six are enough), recency and tier."""

    def count(hay, words):
        return sum((F.when(F.contains(hay, F.lit(t)), 1.0).otherwise(0.0) for t in words), F.lit(0.0))

    counts = _let(F.lower(text), lambda hay: F.array(count(hay, terms), count(hay, topic)))
    held, topics = F.get(counts, F.lit(0)) / max(1, len(terms)), F.get(counts, F.lit(1))
    rank = F.lit(0.3)
    for k, v in TIERS.items():
        rank = F.when(tier == k, v).otherwise(rank)
    a, b, c, d = WEIGHTS
    return a * held + b * F.least(topics / 6, F.lit(1.0)) + c * F.greatest(1 - age_hours / RECENT_HOURS, F.lit(0.0)) + d * rank


def top_k(docs: DataFrame, k: int = 5, least: float = 0.30) -> DataFrame:
    """The ``k`` most relevant documents, no tier beyond its share: a third, a half, two."""
    budget = max(3 * k, 12)
    caps = {"primary": max(3, budget // 3), "press": max(3, budget // 2), "aggregate": 2}
    most = F.lit(0)
    for t, n in caps.items():
        most = F.when(F.col("tier") == t, n).otherwise(most)
    n = F.row_number().over(W.partitionBy("tier").orderBy(F.desc("relevance"), "id"))
    return docs.withColumn("_n", n).where((F.col("_n") <= most) & (F.col("relevance") >= least)).drop("_n").orderBy(F.desc("relevance"), "id").limit(k)


def adjusted_relevance(lexical: Column, model: Column, tier: Column) -> Column:
    """Model and lexical score together where there is one of a model, a floor for primary sources, pulled by the tier."""
    both = F.when(model.isNull(), lexical).otherwise(MODEL_SHARE * model + (1 - MODEL_SHARE) * lexical)
    weight = F.lit(0.3)
    for k, v in TIERS.items():
        weight = F.when(tier == k, v).otherwise(weight)
    return F.when(tier == "primary", F.greatest(both, F.lit(PRIMARY_FLOOR))).otherwise(both) * (1 + TIER_PULL * (weight - TIER_MID))


def noise_reason(title: Column, summary: Column) -> Column:
    """Why a document says nothing (fixed texts), else null."""

    def first(both, low):
        return F.coalesce(*[F.when(_may(low, p) & both.rlike("(?i)" + p), F.lit(f"noise pattern: {p}")) for p in NOISE_PATTERNS])

    pattern = _let(F.concat(title, F.lit(" "), summary), lambda both: _let(F.lower(both), lambda low: first(both, low)))
    return F.coalesce(pattern, F.when(F.length(title) < MIN_TITLE, F.lit("title too short to carry information")))


def screened(docs: DataFrame, question: str) -> DataFrame:
    """(id, title, summary, tier, age_hours) with clean texts, ``flags`` of instructions hidden in them, lexical ``relevance`` and
    the ``reason`` to drop a document at once, else null. Null texts are empty ones."""
    t, s = F.coalesce("title", F.lit("")), F.coalesce("summary", F.lit(""))
    terms = sorted(set(re.findall(r"[a-z]{4,}", question.lower())))
    out = docs.withColumns({"flags": F.array_sort(F.array_union(hidden(t), hidden(s))), "reason": noise_reason(t, s), "title": sanitise(t), "summary": sanitise(s)})
    out = out.withColumns({"flags": F.when(F.col("reason").isNull(), F.col("flags")).otherwise(F.array().cast("array<string>")), "relevance": relevance(F.concat_ws(" ", "title", "summary"), terms, list(TOPIC_TERMS), F.col("age_hours"), F.col("tier"))})
    trapped = (F.size("flags") > 0) & (F.col("tier") == "primary")
    return out.withColumn("reason", F.coalesce("reason", F.when(trapped, F.lit("instruction-shaped text in a primary feed"))))


def filter_documents(docs: DataFrame, question: str, keep: int = 5, least: float = 0.30, model: DataFrame | None = None, texts: bool = True) -> DataFrame:
    """The documents worth showing for a question, and why others were dropped.

    Noise and primary documents with hidden instructions are dropped first; of the rest each tier sends its most relevant
    ones, those beyond its share are left out; ``model`` (id, score) joins the lexical score; then the best ``keep`` of at least
    ``least`` are kept. Columns of :func:`screened`, with ``score``, ``shortlisted`` and ``kept``. Equals are taken by id.
    The screened documents are written once; without ``texts``, title and summary are left out.
    """
    return chosen(_screened_once(docs, question, texts), keep, least, model)


def _screened_once(docs: DataFrame, question: str, texts: bool) -> DataFrame:
    rows = screened(docs, question)
    return cut(rows if texts else rows.drop("title", "summary"))


def chosen(rows: DataFrame, keep: int = 5, least: float = 0.30, model: DataFrame | None = None) -> DataFrame:
    """:func:`filter_documents` of documents that are screened already."""
    budget = max(3 * keep, 12)
    caps = {"primary": max(3, budget // 3), "press": max(3, budget // 2), "aggregate": 2}
    most = F.lit(0)
    for tier, n in caps.items():
        most = F.when(F.col("tier") == tier, n).otherwise(most)
    n = F.row_number().over(W.partitionBy("tier").orderBy(F.desc("relevance"), "id"))
    short = rows.where("reason is null").withColumn("_n", n).where(F.col("_n") <= max(caps.values())).where(F.col("_n") <= most).drop("_n")
    short = short.withColumn("score", F.lit(None).cast("double")) if model is None else short.join(model.select("id", F.col("score").cast("double").alias("score")), "id", "left")
    short = short.withColumn("relevance", adjusted_relevance(F.col("relevance"), F.col("score"), F.col("tier")))
    place = F.row_number().over(W.orderBy(F.desc("relevance"), "id"))  # a shortlist of at most the tiers' shares
    short = short.withColumn("kept", (F.col("relevance") >= least) & (place <= keep)).withColumn("shortlisted", F.lit(True))
    short = short.withColumn("reason", F.when(~F.col("kept"), F.format_string("relevance %.2f below cut", "relevance")))
    dropped = rows.where("reason is not null").withColumns({"score": F.lit(None).cast("double"), "kept": F.lit(False), "shortlisted": F.lit(False)})
    return short.unionByName(dropped)


def filter_stats(docs: DataFrame, verdict: DataFrame | None, question: str) -> DataFrame:
    """One row: documents retrieved, shortlisted, scored by a model, kept, and those with hidden instructions. Without a
    ``verdict`` it is that of :func:`filter_documents`, and the documents are screened once for both."""
    rows = _screened_once(docs, question, False) if verdict is None else screened(docs, question)
    verdict = chosen(rows) if verdict is None else verdict
    every = rows.agg(F.count("*").alias("retrieved"), F.count_if(F.size("flags") > 0).alias("injection_flags"))
    of = verdict.agg(F.count_if("shortlisted").alias("after_deterministic"), F.count("score").alias("model_scored"), F.count_if("kept").alias("kept"))
    return every.join(F.broadcast(of)).withColumn("model_used", F.col("model_scored") > 0)


#: Words of a fund's name that say nothing.
FUND_STOP = ("fund", "mutual", "scheme", "plan", "the")


def fund_search(funds: DataFrame, query: str, limit: int = 8, stop: tuple[str, ...] = FUND_STOP, prefer_direct_growth: bool = True) -> DataFrame:
    """The ``limit`` best funds (name and, where there are, amc, plan, option, category) that hold every word of the query in
    name or house; equals by name, then by the other columns.

    Three points where a word starts the name, one where it stands in it, two for a direct plan and one for growth. With a
    column ``category``, ``peers`` counts the funds of the best one's category. A query without words finds nothing.
    """
    terms = [t for t in re.findall(r"[a-z0-9]{3,}", query.lower()) if t not in stop]
    has = lambda c: F.lower(F.coalesce(c, F.lit(""))) if c in funds.columns else F.lit("")
    name, house, out = has("name"), has("amc"), funds if terms else funds.limit(0)
    for t in terms:
        out = out.where(F.contains(name, F.lit(t)) | F.contains(house, F.lit(t)))
    score = sum((F.when(F.startswith(name, F.lit(t)), 3).when(F.contains(name, F.lit(t)), 1).otherwise(0) for t in terms), F.lit(0))
    if prefer_direct_growth:
        score = score + F.when(F.contains(has("plan"), F.lit("direct")), 2).otherwise(0) + F.when(F.contains(has("option"), F.lit("growth")), 1).otherwise(0)
    order = [F.desc("score"), "name", *[c for c in funds.columns if c != "name"]]
    best = out.withColumn("score", score.cast("int")).orderBy(*order).limit(limit)
    if "category" not in funds.columns:
        return best
    first = best.orderBy(*order).limit(1).select("category")
    peers = funds.join(F.broadcast(first), "category", "left_semi").agg(F.count("*").alias("peers"))  # one row
    return best.join(F.broadcast(peers))


#: How a holding is written, its units, words left out of its name.
HOLDING = r"(?i)(?:rs\.?|inr|₹)?\s*([\d,]+(?:\.\d+)?)\s*(lakhs?|lacs?|crores?|cr|k|thousand|l)?\s*(?:rupees?\s*)?(?:worth\s*)?(?:of\s*|in\s*|into\s*)\s*([a-z0-9&.\- ]{2,40}?)(?=\s*(?:,|and\b|;|\.|$))"
HOLDING_UNITS = {"lakh": 1e5, "lakhs": 1e5, "lac": 1e5, "lacs": 1e5, "l": 1e5, "crore": 1e7, "crores": 1e7, "cr": 1e7, "k": 1e3, "thousand": 1e3}
HOLDING_FILLERS = r"(?i)\b(worth|of|in|into|the|my|some)\b"


def holdings_of(text: Column) -> Column:
    """The (name, value) of each holding that a text names, in order: an amount of 100 or more with its unit, then of, in or into
    a name of two characters or more. A null text has none."""
    amounts, units, names = (F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(HOLDING), F.lit(i)) for i in (1, 2, 3))
    times = F.create_map(*[F.lit(x) for kv in HOLDING_UNITS.items() for x in kv])
    # Each run of letters begins with a capital.
    title = lambda name: F.array_join(F.transform(F.regexp_extract_all(name, F.lit("[A-Za-z]+|[^A-Za-z]+"), F.lit(0)), F.initcap), "")

    def holding(x):
        value = F.replace(x["amount"], F.lit(","), F.lit("")).try_cast("double") * F.coalesce(F.try_element_at(times, F.lower(x["unit"])), F.lit(1.0))
        return F.struct(title(F.trim(F.regexp_replace(F.trim(x["name"]), HOLDING_FILLERS, ""))).alias("name"), value.alias("value"))

    found = F.transform(F.arrays_zip(amounts.alias("amount"), units.alias("unit"), names.alias("name")), holding)
    return F.filter(found, lambda h: (h["value"] >= 100) & (F.length(h["name"]) >= 2))


def parse_holdings(frame: DataFrame, text: str = "text") -> DataFrame:
    """Rows of ``frame`` without ``text``, one for each holding that it names: name, value, bucket, and whether that is a guess."""
    from .portfolio import bucket_guessed, bucket_of

    rows = frame.select(*[c for c in frame.columns if c != text], F.explode(holdings_of(F.col(text))).alias("_h"))
    return rows.select(*[c for c in frame.columns if c != text], "_h.name", "_h.value").withColumns({"bucket": bucket_of(F.col("name")), "guessed": bucket_guessed(F.col("name"))})


#: What tells the kinds of questions apart.
GOAL = r"(?i)\b(i (?:want|need)|goal|target|retire|save up|accumulate|reach)\b.{0,60}(?:in|within|by|over)\s*[\d.]+\s*(?:year|yr)"
PORTFOLIO = r"(?i)\b(my portfolio|i (?:have|hold|own)|holdings?|i'?m invested|invested in)\b"
FUND = r"(?i)\b(fund|nav|amc|sip in|scheme)\b"
FUND_ASKED = r"(?i)\b(nav|which fund|find.*fund|search.*fund|fund called|my fund|about .{2,40} fund)\b"
FORECAST = r"(?i)\b(will|would|probability|odds|chance|likely|forecast|expect|predict|by (?:next|the end)|before)\b"
PROJECT = r"(?i)\b(invest|investing|investment|sip|lump\s?sum|lumpsum|put in|grow to|worth in|returns? on|corpus|maturity)\b"
RISK = r"(?i)\b(var\b|value at risk|stress|scenario|drawdown|volatility|tail risk|expected shortfall)\b"
DATA = (
    r"(?i)\b(repo rate|crr\b|slr\b|bank rate|reverse repo|usdinr|usd/inr|rupee|vix|nifty|sensex|bank nifty|fii|dii|put.?call|pcr|option chain|"
    r"nav|mutual fund|gold|silver|brent|crude|wti|copper|wheat|s&p|sp500|nasdaq|dow|vix|dollar|treasury|fed funds)\b"
)


def question_kind(text: Column) -> Column:
    """What a question is about: goal, portfolio, fund, projection, risk, data or council. A goal names the sum to reach, a projection the
    sum put in; a question about an event is the council's though it has a sum and a horizon. Null is council's."""
    from .prose import goal_of, projection_of

    says = lambda p: F.coalesce(text.rlike(p), F.lit(False))
    projection, event = projection_of(text).isNotNull(), says(FORECAST)
    return (
        F.when(says(GOAL) & goal_of(text).isNotNull(), "goal").when(says(PORTFOLIO) & (F.size(holdings_of(text)) > 0), "portfolio").when(says(FUND) & ~event & says(FUND_ASKED), "fund")
        .when(projection & (~event | says(PROJECT)), "projection").when(says(RISK), "risk").when(event, "council").when(says(DATA), "data").otherwise("council")
    )
