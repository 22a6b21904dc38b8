"""Quality rules by distribution divergence, DataFrame functions only.

Each document gives a histogram of character classes and one of common words. Their references are
the pooled histograms of the documents of the same language (of all documents where the language is
null), weighted by length up to a cap per document so that a few very long texts don't set them. A
document that is long enough and lies too far from its reference in Jensen-Shannon distance, in
either histogram, is rejected; so is one that fails the base rules on length and repetition.

In common words, too far is as far as a text without any of them lies from the same reference, which
texts of another language pass too. Where the language is null or has no list here, or its pooled
texts hardly use its list, such a text proves nothing, and a fixed distance holds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import SPACE, cut, held, words_of

#: Character classes by name: a pattern of what is NOT in the class.
CHAR_CLASSES = {
    "lower": r"[^\p{Ll}]+",
    "upper": r"[^\p{Lu}]+",
    "digit": r"[^0-9]+",
    "space": r"[^\x20\x09-\x0D]+",
    "stop": r"[^.,;:!?'\x22()-]+",
    "symbol": r"[^#*$%&|<>@=+/\\^~_{}\[\]]+",
}
#: Common words of the languages that the texts are in, about the fifteen most frequent of each.
COMMON_WORDS = {
    "en": "the of and to in a is that for it as was with be on".split(),
    "fr": "de la le et les des en un du une que est pour qui dans".split(),
    "de": "der die und in den von zu das mit sich des auf ist im dem".split(),
    "es": "de la que el en y a los se del las un por con no".split(),
}
COMMON = sorted({w for words in COMMON_WORDS.values() for w in words})
#: Shorter documents aren't judged by divergence.
MIN_CHARS, MIN_WORDS = 200, 60
#: Largest Jensen-Shannon distance (base 2, 0 to 1) from the reference of the language.
MAX_CHAR_DISTANCE, MAX_WORD_DISTANCE = 0.28, 0.5
#: A reference with a smaller share of common words doesn't set the largest word distance itself.
MIN_REFERENCE_COMMON = 0.05
#: The counts that stay in the result.
COUNTS = ["q_n_words", "q_word_chars", "q_n_symbols", "q_n_dup_lines", "q_n_repeat_words", "q_n_chars"]
#: Weight of a document in its reference, in characters, at most.
REFERENCE_CHARS = 20_000


def _with_windows(df: DataFrame, width: int = 8) -> DataFrame:
    """Add ``_windows``, the 64-bit hashes of all ``width``-word windows (a power of two) of ``_words``.

    Hashes of single words are joined to those of two, four and eight by shifted pairs, so that
    the work is the number of words times four, however long the text is.
    """
    out = held(df, _windows=F.transform("_words", lambda w: F.xxhash64(w)))
    step = 1
    while step < width:
        m = F.size("_windows") - step
        first, second = F.slice("_windows", F.lit(1), m), F.slice("_windows", F.lit(step + 1), m)
        joined = F.when(m > 0, F.zip_with(first, second, lambda a, b: F.xxhash64(a, b))).otherwise(F.array().cast("array<bigint>"))
        out = held(out, _wider=joined).drop("_windows").withColumnRenamed("_wider", "_windows")
        step *= 2
    return out


def features(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with the counts that the rules need, in columns that start with ``q_``.

    ``q_n_repeat_words`` are the words inside 8-word windows that occur twice or more in the text.
    Windows are compared by 64-bit hashes; only texts that have a repeated one go on to sort (hash,
    place) pairs. Of the places of repeated windows, in order, each covers eight words or those up
    to the next one.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    out = held(docs, _words=words_of(F.col(text_col)))
    out = _with_windows(out)
    hits = F.filter("_words", lambda w: F.lower(w).isin(COMMON))
    out = held(out, _sorted=F.when(F.size(F.array_distinct("_windows")) < F.size("_windows"), F.sort_array(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))), _hits=F.transform(hits, F.lower), _lines=F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    n = F.size("_sorted")
    # places of windows equal to the one before or after in (hash, place) order
    same = F.zip_with(F.slice("_sorted", F.lit(1), n - 1), F.slice("_sorted", F.lit(2), n - 1), lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])))
    out = held(out, _places=F.when(n > 1, F.sort_array(F.array_distinct(F.flatten(F.filter(same, lambda x: x.isNotNull()))))))
    m = F.size("_places")
    gaps = F.zip_with(F.slice("_places", F.lit(1), m - 1), F.slice("_places", F.lit(2), m - 1), lambda a, b: F.least(b - a, F.lit(8)))
    covered = F.when(m > 0, F.aggregate(gaps, F.lit(8), lambda a, b: a + b)).otherwise(F.lit(0))
    keep = [F.col(f"`{c}`") for c in docs.columns]

    def count(pattern):
        return F.length(F.regexp_replace(text, pattern, "")).cast("long")

    return out.select(
        *keep,
        F.size("_words").cast("long").alias("q_n_words"),
        F.length(F.array_join("_words", "")).cast("long").alias("q_word_chars"),
        count(r"[^#*$%&|<>]+").alias("q_n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("q_n_dup_lines"),
        covered.cast("long").alias("q_n_repeat_words"),
        F.length(text).cast("long").alias("q_n_chars"),
        F.array(*[count(p) for p in CHAR_CLASSES.values()]).alias("q_char_counts"),
        F.array(*[(F.size("_hits") - F.size(F.array_remove("_hits", w))).cast("long") for w in COMMON]).alias("q_word_counts"),
    )


def _total(values) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, b: a + b)


def _shares(counts: str, total: Column) -> Column:
    """Counts as shares of ``total``, the rest as the last bin."""
    total = F.greatest(total, F.lit(1)).cast("double")
    rest = total - _total(F.transform(counts, lambda x: x.cast("double")))
    return F.transform(F.concat(F.transform(counts, lambda x: x.cast("double")), F.array(rest)), lambda x: x / total)


def _distance(p: str, q: str) -> Column:
    """Jensen-Shannon distance, base 2, of two arrays of shares."""

    def part(a: Column, b: Column) -> Column:
        return F.when(a > 0, a * F.log2(2 * a / (a + b))).otherwise(0.0)

    return F.sqrt(F.greatest(F.lit(0.0), 0.5 * _total(F.zip_with(p, q, lambda a, b: part(a, b) + part(b, a)))))


def _judged(docs: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    """``row``, a struct of the other columns of ``docs``, and ``text`` with the counts, distances and verdict
    beside them."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text_col] or [F.lit(None).alias("none")]).alias("row")
    apart = docs.select(row, F.col(text_col).cast("string").alias("text"), F.coalesce(F.col(lang_col).cast("string"), F.lit("")).alias("q_lang"))
    rows = features(apart).withColumns({"q_char_shares": _shares("q_char_counts", F.col("q_n_chars")), "q_word_shares": _shares("q_word_counts", F.col("q_n_words"))})
    counted = cut(rows, "quality-counts")
    judged = (F.col("q_n_chars") >= MIN_CHARS) & (F.col("q_n_words") >= MIN_WORDS)
    references = _references(counted.where(judged))
    far = counted.join(references, "q_lang", "left")
    failed = (F.col("q_n_words") < 20) | (100 * F.col("q_n_repeat_words") > 30 * F.col("q_n_words"))
    far = far.withColumns({"char_distance": F.when(judged, _distance("q_char_shares", "ref_char")), "word_distance": F.when(judged, _distance("q_word_shares", "ref_word")), "base_failed": failed})
    off = F.coalesce((F.col("char_distance") > MAX_CHAR_DISTANCE) | (F.col("word_distance") > F.col("ref_far")), F.lit(False))
    return far.withColumn("kept", ~F.col("base_failed") & ~off)


def _own(docs: DataFrame, text_col: str) -> list[tuple[str, Column]]:
    return [(c, F.col("text").alias(c) if c == text_col else F.col(f"row.`{c}`").alias(c)) for c in docs.columns]


VERDICT = [*COUNTS, "char_distance", "word_distance", "base_failed", "kept"]


def judge(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``docs`` with ``q_*`` counts, ``char_distance``, ``word_distance``, ``base_failed`` and ``kept``.

    Null and empty texts have no words and fail the base rule; a null language is judged against
    all documents; repeated rows are judged alike; an empty table gives an empty result; very long texts
    are counted whole. A column of ``docs`` named like one of the result gives way to it; all others stay.
    The counts are made once and written to the shared folder; references are one row a language.
    """
    own = [c for name, c in _own(docs, text_col) if name not in VERDICT]
    return _judged(docs, text_col, lang_col).select(*own, *VERDICT)


def keep(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of ``docs`` that ``judge`` keeps, every column as it is, whatever its name."""
    return _judged(docs, text_col, lang_col).where("kept").select(*[c for _, c in _own(docs, text_col)])


def _references(counted: DataFrame) -> DataFrame:
    """(q_lang, ref_char, ref_word, ref_far): pooled shares of each language, and of all texts under '',
    and the largest word distance from them."""
    weight = F.least(F.col("q_n_chars"), F.lit(REFERENCE_CHARS))
    sizes = {"q_char_shares": len(CHAR_CLASSES) + 1, "q_word_shares": len(COMMON) + 1}
    # whole numbers, so that the sums don't depend on the order of the tasks
    sums = [F.sum(F.round(F.get(c, F.lit(i)) * weight * 1000).cast("long")).alias(f"{c}_{i}") for c, n in sizes.items() for i in range(n)]
    by_lang = counted.where(F.col("q_lang") != "").groupBy("q_lang").agg(*sums)
    whole = counted.agg(*sums).withColumn("q_lang", F.lit(""))
    pooled = cut(by_lang.unionByName(whole).select("q_lang", *[F.array(*[F.coalesce(F.col(f"{c}_{i}"), F.lit(0)).cast("double") for i in range(n)]).alias(c) for c, n in sizes.items()]), "quality-references")

    def normal(c):
        return F.transform(c, lambda x: x / F.greatest(_total(c), F.lit(1.0)))

    out = pooled.select("q_lang", normal("q_char_shares").alias("ref_char"), normal("q_word_shares").alias("ref_word"))
    out = out.withColumn("ref_none", F.array(*[F.lit(0.0)] * len(COMMON), F.lit(1.0)))
    sets = F.col("q_lang").isin(*COMMON_WORDS) & (F.get("ref_word", F.lit(len(COMMON))) <= 1 - MIN_REFERENCE_COMMON)
    # Just below the distance of a text without common words, so that rounding doesn't decide.
    far = F.when(sets, F.least(_distance("ref_none", "ref_word") - 1e-9, F.lit(MAX_WORD_DISTANCE))).otherwise(MAX_WORD_DISTANCE)
    return out.select("q_lang", "ref_char", "ref_word", far.alias("ref_far"))


def op3_quality_rules(spark, sf_dir: str) -> DataFrame:
    """Counts and verdict for every whole text of ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    return judge(docs).select("doc_id", *[F.col(f"q_{c}").alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")], "base_failed", "kept", "char_distance", "word_distance")
