"""Information-theoretic sanitisation of personal data, DataFrame functions only.

Base spans are patterns. Beyond them, the corpus tells which terms give a protected value away: of
each term in a document with a protected value, co-occurrence over all documents estimates
log2(P(value | term) / P(value)), the bits by which the term discloses the value. Terms with enough
support, share and bits are spans of kind ``term`` wherever they occur; above a second threshold
they are removed, else generalised.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import cut, held

KINDS = ("email", "ip", "card", "phone")
#: The contract's patterns in forms that don't backtrack: what can't end otherwise is possessive,
#: and a run is only tried from its start or from the end of the match before.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}+",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold for a kind to be looked for.
HINTS = {"email": r"@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){11}", "phone": r"\+[0-9]"}

#: A term needs so many documents with the value, this share of its documents, and these bits.
MIN_SUPPORT, MIN_SHARE, MIN_BITS, REMOVE_BITS = 3, 0.5, 6.0, 12.0
#: Shorter terms can only disclose where they begin with a capital, as names do.
MIN_TERM_CHARS = 4

NOT_TERM = r"[^\p{L}\p{N}]+"
SPAN = "array<struct<kind:string,start:int,end:int>>"


def terms_of(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.filter(F.split(F.lower(text), NOT_TERM), lambda t: t != "")


def _candidates(text: Column) -> Column:
    """Those of ``terms_of`` that can disclose a value."""
    fits = F.filter(F.split(text, NOT_TERM), lambda t: (F.length(t) >= MIN_TERM_CHARS) | t.rlike(r"^\p{Lu}"))
    return F.transform(fits, F.lower)


def _passes(kind: str, value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "ip":
        part = r"0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
        return value.rlike(rf"^{part}(?:\.{part}){{3}}$")
    if kind == "card":

        def luhn(c, i):
            d = c.cast("int") * (1 + i % 2)
            return F.when(d > 9, d - 9).otherwise(d)

        total = F.aggregate(F.transform(F.regexp_extract_all(F.reverse(digits), F.lit("[0-9]"), F.lit(0)), luhn), F.lit(0), lambda a, b: a + b)
        return F.when(F.length(digits).between(12, 19), total % 10 == 0).otherwise(False)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


#: Matches whose places are summed up together; arrays are then no longer than that while they grow.
CHUNK = 256


def _located(kind: str, matches: Column, pieces: Column) -> Column:
    """Matches of a pattern with their places, from the pieces of text around them.

    Places are sums of lengths. They are made chunk by chunk, each from its own first place on, so that
    the work grows with the number of matches, however many a text has.
    """
    empty = F.array().cast("array<struct<kind:string,start:int,end:int,value:string>>")

    def step(acc, x):
        start = acc["at"] + F.length(x["before"])
        end = start + F.length(x["value"])
        span = F.struct(F.lit(kind).alias("kind"), start.alias("start"), end.alias("end"), x["value"].alias("value"))
        return F.struct(end.alias("at"), F.concat(acc["spans"], F.array(span)).alias("spans"))

    def placed(chunk, at):
        return F.aggregate(chunk, F.struct(at.alias("at"), empty.alias("spans")), step, lambda acc: acc["spans"])

    def size(chunk):
        return F.aggregate(chunk, F.lit(0), lambda n, x: n + F.length(x["before"]) + F.length(x["value"]))

    around = F.zip_with(matches, F.slice(pieces, F.lit(1), F.size(matches)), lambda m, p: F.struct(m.alias("value"), p.alias("before")))
    # Chunks with the place at which each begins, which are few.
    chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(matches) - 1) / CHUNK).cast("int")), lambda i: F.slice(around, i * CHUNK + 1, F.lit(CHUNK)))
    begun = F.aggregate(
        chunks,
        F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts")),
        lambda acc, c: F.struct((acc["at"] + size(c)).alias("at"), F.concat(acc["starts"], F.array(acc["at"])).alias("starts")),
        lambda acc: acc["starts"],
    )
    many = F.flatten(F.zip_with(chunks, begun, placed))
    found = F.when(F.size(matches) > CHUNK, many).otherwise(placed(around, F.lit(0)))
    return F.when(F.size(matches) > 0, F.filter(found, lambda s: _passes(kind, s["value"]))).otherwise(empty)


def base_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, text_hash, found): the base spans of every row with values, in order."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    out = held(docs.select(F.col(id_col).alias("doc"), text.alias("text")), text_hash=F.xxhash64("text"))
    none = F.array().cast("array<string>")
    for kind in KINDS:
        hint = F.col("text").rlike(HINTS[kind])
        out = held(out, m=F.when(hint, F.regexp_extract_all("text", F.lit(PATTERNS[kind]), F.lit(0))).otherwise(none), p=F.when(hint, F.split("text", PATTERNS[kind])).otherwise(none))
        out = held(out, **{kind: _located(kind, F.col("m"), F.col("p"))}).drop("m", "p")
    return out.select("doc", "text_hash", F.concat(*KINDS).alias("found"))


def disclosing_terms(base: DataFrame, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(term, bits): terms that disclose a protected value, by co-occurrence over all of ``docs``.

    ``base`` is what ``base_spans`` gives for the same documents. Every term outside the protected
    values of a document that holds the value counts, wherever it stands. Before terms meet values,
    those go that can't pass: values of too few documents, and terms of too few or too many.
    """
    key = F.xxhash64("doc", "text_hash").alias("at")
    held_values = cut(base.where(F.size("found") > 0).select(key, F.explode(F.transform("found", lambda s: F.xxhash64(s["kind"], s["value"]))).alias("value")).distinct(), "pii-values")
    values = held_values.groupBy("value").agg(F.count("*").alias("with_value")).where(F.col("with_value") >= MIN_SUPPORT)
    values = cut(held_values.join(values, "value"), "pii-frequent-values")
    most = values.agg(F.max("with_value")).first()[0]
    if most is None:
        return docs.sparkSession.createDataFrame([], "term string, bits double")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    # Document counts of all terms are summed before anything is joined; few of them go on.
    counts = docs.select(F.explode(F.array_distinct(terms_of(text))).alias("term")).groupBy("term").agg(F.count("*").alias("with_term"))
    counts = cut(counts.where(F.col("with_term").between(MIN_SUPPORT, most / MIN_SHARE)), "pii-term-counts")
    holders = values.select(F.col("at").alias("a")).distinct()
    rows = docs.select(F.col(id_col).alias("doc"), text.alias("text")).withColumn("text_hash", F.xxhash64("text")).select(key, "text")
    rows = rows.join(holders, F.col("at") == F.col("a"), "left_semi").dropDuplicates(["at"])
    terms = _outside(rows).select("at", F.explode(F.array_distinct(_candidates(F.col("text")))).alias("term")).join(counts, "term")
    pairs = terms.join(values, "at").where(F.col("with_term") <= F.col("with_value") / MIN_SHARE)
    pairs = pairs.groupBy("value", "term").agg(F.count("*").alias("both"), F.first("with_value").alias("with_value"), F.first("with_term").alias("with_term")).where(F.col("both") >= MIN_SUPPORT)
    share = F.least(F.col("both") / F.col("with_term"), F.lit(1.0))
    scored = pairs.withColumn("share", share).withColumn("bits", F.log2(F.col("share") * docs.count() / F.col("with_value")))
    return scored.where((F.col("share") >= MIN_SHARE) & (F.col("bits") >= MIN_BITS)).groupBy("term").agg(F.max("bits").alias("bits"))


def _without(kind: str):
    """A piece of text and the match after it, if any, as a blank where it is a value."""
    return lambda piece, match: F.when(match.isNull(), piece).otherwise(F.concat(piece, F.when(_passes(kind, match), " ").otherwise(match)))


def _outside(rows: DataFrame) -> DataFrame:
    """``rows`` (at, text) with a blank in place of each protected value.

    Kind by kind a text is split at the matches and joined again, so the work grows with its length, however many
    values it has; a match that fails its check goes back.
    """
    none = F.array().cast("array<string>")
    for kind in KINDS:
        hint = F.col("text").rlike(HINTS[kind])
        rows = held(rows, m=F.when(hint, F.regexp_extract_all("text", F.lit(PATTERNS[kind]), F.lit(0))).otherwise(none), p=F.when(hint, F.split("text", PATTERNS[kind])).otherwise(F.array("text")))

        rows = held(rows.select("at", "p", "m"), text=F.array_join(F.zip_with("p", "m", _without(kind)), "")).select("at", "text")
    return rows


def _term_spans(docs: DataFrame, terms: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc, text_hash, disclosed): spans of ``terms``, of the documents that hold one; their kind is
    ``removed`` for terms above ``REMOVE_BITS``, else ``term``."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc"), text.alias("text")).withColumn("text_hash", F.xxhash64("text"))
    holding = rows.select("doc", "text_hash", F.explode(F.array_distinct(terms_of(F.col("text")))).alias("term")).join(terms, "term")
    patterns = holding.groupBy("doc", "text_hash").agg(F.sort_array(F.collect_set("term")).alias("terms"), F.collect_set(F.when(F.col("bits") > REMOVE_BITS, F.col("term"))).alias("removed"))
    patterns = cut(patterns.withColumn("pattern", F.concat(F.lit(r"(?iu)(?<![\p{L}\p{N}])(?:"), F.array_join("terms", "|"), F.lit(r")(?![\p{L}\p{N}])"))).select(F.col("doc").alias("d"), F.col("text_hash").alias("h"), "pattern", "removed"), "pii-patterns")
    few = rows.join(patterns, F.col("doc").eqNullSafe(F.col("d")) & (F.col("text_hash") == F.col("h"))).dropDuplicates(["doc", "text_hash"])
    few = held(few, m=F.regexp_extract_all("text", F.col("pattern"), F.lit(0)), p=F.split("text", F.col("pattern")))
    spans = F.transform(_located("term", F.col("m"), F.col("p")), lambda s: F.struct(F.when(F.array_contains("removed", F.lower(s["value"])), F.lit("removed")).otherwise(s["kind"]).alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    return few.select(F.col("doc").alias("d"), F.col("text_hash").alias("h"), spans.alias("disclosed"))


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, text_hash, spans) of every row of ``docs``; spans are (kind, start, end) in code points
    by start, then email, ip, card, phone, term.

    A null text is empty and an empty text has no spans. Null ids and repeated rows stay, one output
    row per input row. A match that fails its check is dropped without another try. A very long text is
    searched whole, in time that grows with its length. Other columns aren't read; an empty table gives an
    empty result.
    """

    def plain(s):
        return F.struct(F.when(s["kind"] == "removed", F.lit("term")).otherwise(s["kind"]).alias("kind"), s["start"].alias("start"), s["end"].alias("end"))

    return _found(docs, id_col, text_col).withColumn("spans", F.transform("spans", plain))


def _found(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """What ``find`` gives, with the kind ``removed`` for terms that are to be removed."""
    base = cut(base_spans(docs, id_col, text_col), "pii-base")
    terms = cut(disclosing_terms(base, docs, id_col, text_col), "pii-terms")
    out = base.select("doc", "text_hash", F.transform("found", lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"))).alias("spans"))
    if not terms.isEmpty():
        more = _term_spans(docs, terms, id_col, text_col)
        out = out.join(more, F.col("doc").eqNullSafe(F.col("d")) & (F.col("text_hash") == F.col("h")), "left")
        out = out.select("doc", "text_hash", F.concat("spans", F.coalesce("disclosed", F.array().cast(SPAN))).alias("spans"))
    rank = {k: i for i, k in enumerate((*KINDS, "term"))} | {"removed": len(KINDS)}

    def keyed(s):
        order = F.lit(0)
        for k, i in rank.items():
            order = F.when(s["kind"] == k, i).otherwise(order)
        return F.struct(s["start"].alias("start"), order.alias("order"), s["end"].alias("end"), s["kind"].alias("kind"))

    ordered = F.transform(F.sort_array(F.transform("spans", keyed)), lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    return out.select(F.col("doc").alias(id_col), "text_hash", ordered.alias("spans"))


def _replaced(text: str, spans: str) -> Column:
    """The pieces of a text with its spans replaced, in order; spans are in order and the first of overlapping ones counts.

    Chunk by chunk: each begins where the spans before it have ended, and takes its own part of the text once. So
    arrays that grow, and the texts that pieces are cut from, are those of a chunk.
    """
    chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(spans) - 1) / CHUNK).cast("int")), lambda i: F.slice(spans, i * CHUNK + 1, F.lit(CHUNK)))
    begun = F.aggregate(
        chunks,
        F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts")),
        lambda acc, c: F.struct(F.greatest(acc["at"], F.array_max(F.transform(c, lambda s: s["end"]))).alias("at"), F.concat(acc["starts"], F.array(acc["at"])).alias("starts")),
        lambda acc: acc["starts"],
    )

    def mark(s):
        return F.when(s["kind"] == "removed", F.lit("")).otherwise(F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")))

    def with_text(chunk, at):
        last = F.array_max(F.transform(chunk, lambda s: s["end"]))
        return F.struct(chunk.alias("spans"), at.alias("at"), F.substr(text, at + 1, F.greatest(last - at, F.lit(0))).alias("own"))

    def placed(x):  # of elements that are there: an expression would be made again for each span
        def step(acc, s):
            piece = F.concat(F.substr(x["own"], acc["at"] - x["at"] + 1, F.greatest(s["start"] - acc["at"], F.lit(0))), mark(s))
            return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(s["start"] >= acc["at"], F.concat(acc["out"], F.array(piece))).otherwise(acc["out"]).alias("out"))

        return F.aggregate(x["spans"], F.struct(x["at"].alias("at"), F.array().cast("array<string>").alias("out")), step, lambda acc: acc["out"])

    done = F.coalesce(F.array_max(F.transform(spans, lambda s: s["end"])), F.lit(0))
    many = F.flatten(F.transform(F.zip_with(chunks, begun, with_text), placed))
    return F.concat(F.when(F.coalesce(F.size(spans), F.lit(0)) > 0, many).otherwise(F.array().cast("array<string>")), F.array(F.substr(text, done + 1)))


def sanitise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with ``sanitised``: protected values as [EMAIL], [IP], [CARD] or [PHONE], disclosing terms as
    [TERM], or as nothing above ``REMOVE_BITS``. Of overlapping spans the first counts.

    Null texts stay null, empty ones empty; null ids and repeated rows are answered each; an empty table
    gives an empty result. A column of ``docs`` named ``sanitised`` gives way to the new one.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    found = _found(docs, id_col, text_col).select(F.col(id_col).alias("d"), F.col("text_hash").alias("h"), "spans").dropDuplicates(["d", "h"])
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    rows = docs.select(row, F.col(id_col).alias("i"), F.xxhash64(text).alias("t"), text.alias("text"), F.col(text_col).isNull().alias("none"))
    rows = rows.join(found, F.col("i").eqNullSafe(F.col("d")) & (F.col("t") == F.col("h")), "left")

    rows = held(rows, parts=_replaced("text", "spans"))
    new = F.array_join("parts", "")
    own = [F.col(f"row.`{c}`").alias(c) for c in docs.columns if c != "sanitised"]
    return rows.select(*own, F.when(~F.col("none"), new).alias("sanitised"))


def digests(found: DataFrame) -> DataFrame:
    """The counts and digests of the spans of each document."""

    def of_kind(kind):
        return lambda s: s["kind"] == kind

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    return found.select(
        "doc_id",
        *[F.size(F.filter("spans", of_kind(k))).cast("long").alias(f"n_{k}") for k in KINDS],
        F.sha2(joined(F.filter("spans", lambda s: s["kind"] != "term")).cast("binary"), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
    )


def op1_pii(spark, sf_dir: str) -> DataFrame:
    """Personal data in every whole text of ``documents``."""
    return digests(find(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")))
