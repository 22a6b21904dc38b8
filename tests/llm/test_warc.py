import hashlib

from tidemark.llm import warc
from tidemark.llm.common import shared_dir

SCHEMA = "page_id long, url string, html string, file string"


def round_trip(spark, rows, name, split=None):
    path = f"{shared_dir(spark)}/{name}"
    warc.write(spark.createDataFrame(rows, SCHEMA), path)
    if split:
        spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        return sorted((tuple(r) for r in warc.pages_of(warc.read(spark, path)).collect()), key=str)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def expected(rows):
    out = []
    for page, _, html, _ in rows:
        data = (html or "").encode()
        same = [p for p, _, h, _ in rows if (h or "") == (html or "") and p is not None]
        first = max(same, default=None)
        revisit = len(data) >= 1000 and first is not None and page != first
        out.append((page, len(data), hashlib.sha1(data).hexdigest(), "revisit" if revisit else "response", first if revisit else None))
    return sorted(out, key=str)


def test_magic_in_payload_copies_nulls_and_splits(spark):
    fake = "WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:99>\r\nContent-Length: 5\r\n\r\nhello"
    rows = [
        (1, "http://a/1", "x" * 1500, "f"), (2, None, "x" * 1500, None), (3, "u\r\nWARC-Type: revisit", "é" * 700, "f"),
        (4, "u", None, "f"), (5, "u", "", "f"), (6, "u", "short", "f"), (7, "u", "short", "f"),
        (8, "u", f"before\r\n\r\n{fake}\r\n\r\nafter\r\n\r\n{fake}", "f"), (9, "u", "y\r\n\r\nWARC/1.1\r\nno header here" + "z" * 3000, "f"),
        (10, "u", "\r\n\r\n" + fake + "\r\n\r\n", "f"), (11, "u", "end\r\n\r\n", "f"), (12, "u", "WARC/1.1\r\n", "f"),
        (None, "u", "q" * 1200, "f"), (13, "u", "q" * 1200, "f"), (14, "u", f"a\r\n\r\nWARC/1.1\r\nContent-Length: 100000\r\n\r\nb", "f"),
        *[(100 + i, "u", f"<p>{i}</p>" * (i * 7 % 90), "f") for i in range(60)],
    ]
    assert round_trip(spark, rows, "warc-whole") == expected(rows)
    assert round_trip(spark, rows, "warc-split", "700") == expected(rows)


def test_equal_ids_and_empty_table(spark):
    rows = [(1, "u", "k" * 1000, "f"), (1, "u", "k" * 1000, "f"), (0, "u", "k" * 1000, "f")]
    assert round_trip(spark, rows, "warc-ids") == expected(rows)
    assert round_trip(spark, [], "warc-none") == []
