"""WARC archives: a writer on Spark's text sink and a reader by boundary-chain verification.

Archives are read in splits. Every place where a record could begin (the version line after an end
of block) is a candidate and names its successor: the end of the block that its Content-Length
declares. Candidates that follow each other without a gap are joined into runs inside their split;
pointer jumping over the runs, from the start of each file, keeps those that are reachable. A
version line inside a payload is a candidate that no chain reaches. A block that holds such a line
is put together again from its pieces.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from .common import cut, held, shared_dir

VERSION = "WARC/1.1\r\n"
END = "\r\n\r\n"
BOUNDARY = END + VERSION
#: Payloads from this size on are replaced by a revisit record if another record has the same.
REVISIT_BYTES = 1000
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _line(name: str, value: Column) -> Column:
    """A header line, nothing where the value is null."""
    return F.coalesce(F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit("\r\n")), F.lit(""))


def _record_id(page_id: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page_id.cast("string"), F.lit("none")), F.lit(">"))


def records(pages: DataFrame) -> DataFrame:
    """One WARC record per row of ``pages`` (page_id, url, html), as text without the closing CRLF.

    The block is an HTTP response: headers with the payload's length, then html in UTF-8 (null:
    empty). Of rows with an equal payload of ``REVISIT_BYTES`` or more, those with the largest
    page_id are responses and the others revisits, whose block is the HTTP headers alone. A null
    page_id counts as the smallest. Line ends in a url are percent-encoded; a null url has no line.
    """
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select("page_id", F.col("url").cast("string").alias("url"), html.alias("html"))
    rows = rows.withColumns({"size": F.octet_length("html").cast("long"), "digest": F.sha1(F.col("html").cast("binary"))})
    # Digests with two payloads or more, written so that Spark plans the join by their real size.
    same = rows.where(F.col("size") >= REVISIT_BYTES).groupBy("digest", "size").agg(F.max("page_id").alias("first"), F.count("*").alias("n")).where("n > 1")
    rows = rows.join(cut(same.drop("n"), "warc-same"), ["digest", "size"], "left")
    revisit = F.coalesce(F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first")), F.lit(False))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("size").cast("string"), F.lit(END))
    block = F.when(revisit, http).otherwise(F.concat(http, "html"))
    url = F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A")
    head = F.concat(
        F.lit(VERSION),
        F.when(revisit, F.lit("WARC-Type: revisit\r\n")).otherwise(F.lit("WARC-Type: response\r\n")),
        _line("WARC-Record-ID", _record_id(F.col("page_id"))),
        _line("WARC-Target-URI", url),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "digest")),
        F.when(revisit, F.concat(F.lit(f"WARC-Profile: {PROFILE}\r\n"), _line("WARC-Refers-To", _record_id(F.col("first"))))).otherwise(F.lit("")),
        F.lit("Content-Type: application/http; msgtype=response\r\n"),
        _line("Content-Length", F.octet_length(block)),
    )
    return rows.select(F.concat(head, F.lit("\r\n"), block, F.lit("\r\n")).alias("value"))


def write(pages: DataFrame, path: str, rows_per_file: int = 0) -> None:
    """Write the records of ``pages`` as WARC files under ``path``; each task commits its own files.

    A very long payload is one record; repeated rows are records each, with the same id; an empty table leaves a
    folder without records."""
    records(pages).write.option("lineSep", "\r\n").option("maxRecordsPerFile", rows_per_file).text(path)


def _header(head: Column, name: str) -> Column:
    """Value of the first header line of that name, null without one."""
    found = F.regexp_extract(head, rf"(?i)(?:^|\n){name}:[ \t]*([^\r\n]*)", 1)
    return F.when(found != "", found)


def candidates(spark: SparkSession, path: str) -> DataFrame:
    """A row per candidate: file, split, place (order in the split), at_start, octets, value.

    ``value`` is what follows the version line, up to the end of block before the next candidate, or
    to the end of the file; ``octets`` are the bytes between the two boundaries.
    """
    opening = (F.instr("value", VERSION) == 1) & (F.col("split") == 0)
    raw = spark.read.option("lineSep", BOUNDARY).text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("place"), "value")
    # Only the first piece of a file still has its own version line.
    raw = raw.withColumns({"at_start": opening, "octets": F.octet_length("value").cast("long")})
    return raw.withColumn("value", F.when(F.col("at_start"), F.substr("value", F.lit(len(VERSION) + 1))).otherwise(F.col("value")))


def _facts(found: DataFrame) -> DataFrame:
    """Headers, declared length and, where the block is whole, payload size and digest."""
    head = F.when(F.instr("value", END) > 0, F.substring_index("value", END, 1))
    declared = _header(head, "Content-Length").try_cast("long")
    out = found.withColumns({"head": head, "declared": F.when(declared >= 0, declared)})
    before = F.octet_length("head") + len(END)
    left = F.octet_length("value") - before
    # At the end of a file the closing line ends are still there.
    whole = (left == F.col("declared")) | ((left == F.col("declared") + len(END)) & F.endswith("value", F.lit(END)))
    block = F.substring(F.col("value").cast("binary"), before + 1, F.col("declared").cast("int"))
    out = held(out, block=F.when(whole, block), before=before.cast("long"))
    return _payload(out).select(*[c for c in found.columns if c != "value"], "head", "declared", (len(VERSION) + F.col("before") + F.col("declared") + len(END)).alias("length"), "payload_bytes", "payload_digest", "http_length")


def _payload(rows: DataFrame) -> DataFrame:
    """Payload size and digest of ``block``, and the length that its HTTP headers give; null without a block."""
    http = F.substring_index(F.col("block").cast("string"), END, 1)
    payload = F.substring(F.col("block"), F.octet_length(http) + len(END) + 1, F.octet_length("block"))
    out = held(rows, http=http, payload=payload)
    return out.withColumns({"payload_bytes": F.octet_length("payload").cast("long"), "payload_digest": F.sha1("payload"), "http_length": _header(F.col("http"), "Content-Length")}).drop("http", "payload", "block")


def _with_offsets(found: DataFrame) -> DataFrame:
    """``found`` with ``start``, the byte offset of each candidate's version line in its file.

    A split's bytes are summed first, so no task sees more than the rows of one split, or one row
    per split of a file.
    """
    step = F.col("octets") + len(BOUNDARY)
    sums = found.groupBy("file", "split").agg(F.sum(step).alias("bytes"))
    before = sums.withColumn("base", F.coalesce(F.sum("bytes").over(W.partitionBy("file").orderBy("split").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("bytes")
    inside = W.partitionBy("file", "split").orderBy("place")
    rows = found.withColumn("inner", F.coalesce(F.sum(step).over(inside.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    # The first piece of a file begins with the version line, others right after theirs.
    return rows.join(before, ["file", "split"]).withColumn("start", F.when(F.col("at_start"), F.lit(0)).otherwise(F.col("base") + F.col("inner") - len(VERSION))).drop("base", "inner")


def reachable(chain: DataFrame, rounds: int = 64) -> DataFrame:
    """(file, start) of the candidates that the chain from the start of each file reaches.

    ``chain`` has file, split, start, next. A candidate that another than the one before it points
    to begins a run; so does the first of a split. Runs are reached whole or not at all.
    """
    inside = W.partitionBy("file", "split").orderBy("start")
    rows = chain.withColumn("follows", F.coalesce(F.lag("next").over(inside) == F.col("start"), F.lit(False)))
    nearby = rows.withColumn("_lead", F.lead("start").over(inside))
    jumps = nearby.where(F.col("next").isNotNull() & ~F.col("next").eqNullSafe(F.col("_lead"))).select("file", F.col("next").alias("start"), F.lit(True).alias("target")).distinct()
    rows = rows.join(jumps, ["file", "start"], "left").withColumn("opens", ~F.col("follows") | F.col("target").isNotNull())
    rows = cut(rows.withColumn("run", F.max(F.when(F.col("opens"), F.col("start"))).over(inside)).select("file", "start", "next", "run"), "warc-runs")
    node = rows.groupBy("file", "run").agg(F.max_by("next", "start").alias("next"))
    node = cut(node.withColumn("reached", F.col("run") == 0), "warc-jump")
    for _ in range(rounds):
        # Runs that a reached run points to are reached; then every pointer is doubled.
        hit = node.where("reached and next is not null").select("file", F.col("next").alias("run"), F.lit(True).alias("hit"))
        ahead = node.select("file", F.col("run").alias("next"), F.col("next").alias("next2"))
        new = node.join(hit, ["file", "run"], "left").join(ahead, ["file", "next"], "left")
        new = cut(new.select("file", "run", F.col("next2").alias("next"), (F.col("reached") | F.col("hit").isNotNull()).alias("reached")), "warc-jump")
        node = new
        if node.where("reached and next is not null").isEmpty():
            break
    else:
        raise RuntimeError(f"chains not followed in {rounds} rounds")
    return rows.join(node.where("reached").select("file", "run"), ["file", "run"]).select("file", "start")


def read(spark: SparkSession, path: str) -> DataFrame:
    """The records of the archives under ``path``: file, start, record_type, record_id, target_uri,
    refers_to, declared_digest, payload_bytes and payload_digest (of the bytes read; of a revisit, as its
    headers give them). The payloads themselves aren't returned.

    Works on files that Spark splits and on gzip files, which it reads whole. An empty folder is an
    empty result. A file that doesn't begin with a record yields nothing, and a chain ends where the
    declared length leads to no record. A record may be longer than a split; repeated records are rows each.
    """
    facts = cut(_with_offsets(cut(_facts(candidates(spark, path)), "warc-candidates")), "warc-offsets")
    kept = reachable(facts.select("file", "split", "start", (F.col("start") + F.col("length")).alias("next")))
    real = cut(facts.join(kept.withColumn("real", F.lit(True)), ["file", "start"], "left").where("length is not null or real is null"), "warc-real")
    columns = ["file", "start", "head", "payload_bytes", "payload_digest", "http_length"]
    out = real.where("real and payload_digest is not null").select(columns)
    if not real.where("real and payload_digest is null").isEmpty():
        out = out.unionByName(_rejoined(candidates(spark, path), real).select(columns))
    return _parsed(out)


def _rejoined(found: DataFrame, real: DataFrame) -> DataFrame:
    """Reached records whose block holds version lines, put together from the pieces that follow.

    The archives are read once more, the files with such a record only. The pieces of one record
    meet in one row, which is the record itself.
    """
    so_far = W.partitionBy("file").orderBy("start").rowsBetween(W.unboundedPreceding, 0)
    mine = real.select("file", "start", "real", (F.col("real") & F.col("payload_digest").isNull()).alias("broken"), "declared")
    owner = F.last(F.when(F.col("real"), F.struct("start", "broken", "declared")), ignorenulls=True).over(so_far)
    pieces = mine.withColumn("own", owner).where("own.broken").select("file", "start", F.col("own.start").alias("own"), F.col("own.declared").alias("declared"))
    again = _with_offsets(found.join(pieces.select("file").distinct(), "file", "left_semi"))
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("start", "value"))), lambda x: x["value"]), BOUNDARY)
    out = again.join(pieces, ["file", "start"]).groupBy("file", "own", "declared").agg(text.alias("value"))
    out = out.withColumns({"head": F.substring_index("value", END, 1), "start": F.col("own")})
    block = F.substring(F.col("value").cast("binary"), F.octet_length("head") + len(END) + 1, F.col("declared").cast("int"))
    return _payload(held(out, block=block))


def _parsed(rows: DataFrame) -> DataFrame:
    head = F.col("head")
    kind = _header(head, "WARC-Type")
    digest = F.regexp_replace(_header(head, "WARC-Payload-Digest"), "^sha1:", "")
    revisit = kind == "revisit"
    return rows.select(
        "file", "start", kind.alias("record_type"), _header(head, "WARC-Record-ID").alias("record_id"), _header(head, "WARC-Target-URI").alias("target_uri"), _header(head, "WARC-Refers-To").alias("refers_to"),
        digest.alias("declared_digest"),
        F.when(revisit, F.col("http_length").cast("long")).otherwise(F.col("payload_bytes")).alias("payload_bytes"),
        F.when(revisit, digest).otherwise(F.col("payload_digest")).alias("payload_digest"),
    )


def pages_of(found: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to of records that ``write`` made."""

    def page(c):
        return F.regexp_extract(c, r"^<urn:page:(-?[0-9]+)>$", 1)

    return found.select(
        F.when(page("record_id") != "", page("record_id")).cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type",
        F.when(page("refers_to") != "", page("refers_to")).cast("long").alias("refers_to"),
    )


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes ``pages`` as WARC archives into the shared folder and reads them back."""
    path = f"{shared_dir(spark)}/tidemark-{uuid.uuid4().hex}/warc"
    write(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    return pages_of(read(spark, path))
