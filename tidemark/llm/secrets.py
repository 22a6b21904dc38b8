"""Secret scans over a trigram inverted index.

Each rule's regular expression is turned into a Boolean query of trigrams that every match must
hold. Tasks index a block of documents at a time: postings say which documents hold which of the
queried trigrams (letters A-Z folded). A rule is then verified on the documents whose postings
satisfy its query; a rule without mandatory trigrams is verified on all of them.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from re import _constants as sre, _parser as sre_parser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import chunks_by_bytes

#: Bytes of text that are indexed at a time.
BLOCK_BYTES = 4 << 20
#: Literal alternatives that are followed through a pattern, and members of a class taken as literals.
ALTERNATIVES, CLASS_SIZE = 64, 8

SPANS = "array<struct<kind:string,start:int,end:int>>"
SPANS_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))


@dataclass(frozen=True)
class Rule:
    """A kind, its pattern, and what a match needs: ``least`` characters in ``group``."""

    kind: str
    pattern: str
    ignore_case: bool = False
    group: int = 0
    least: int = 0

    def compiled(self) -> re.Pattern:
        return re.compile(self.pattern, re.A | (re.I if self.ignore_case else 0))


#: The rules of the contract, in its order.
BASE_RULES = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", True, 2, 8),
    Rule("access", r"AKIA[A-Z0-9]+", least=16),
    Rule("hex", r"[0-9a-f]+", least=32),
)
#: Formats of well-known credentials, which add spans.
MORE_RULES = (
    Rule("pem", r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("stripe", r"[rs]k_live_[A-Za-z0-9]{16,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+"),
    Rule("bearer", r"bearer\x20+[A-Za-z0-9._~+/-]{20,}=*", True),
)
RULES = BASE_RULES + MORE_RULES


# A query is True (no condition), a trigram, or ("and" | "or", queries).
def _all(parts):
    parts = [p for p in dict.fromkeys(parts) if p is not True]
    return True if not parts else parts[0] if len(parts) == 1 else ("and", tuple(parts))


def _any(parts):
    parts = list(dict.fromkeys(parts))
    return True if True in parts or not parts else parts[0] if len(parts) == 1 else ("or", tuple(parts))


def _literal_query(strings):
    return _any(_all(s[i : i + 3] for i in range(len(s) - 2)) for s in sorted(strings))


def _node(op, arg):
    """(strings that it matches, or None if many; query that holds of every match)."""
    if op is sre.LITERAL:
        return {_fold(arg)}, True
    if op is sre.IN:
        members: set[str] = set()
        for kind, x in arg:
            if kind is sre.LITERAL:
                members.add(_fold(x))
            elif kind is sre.RANGE and x[1] - x[0] < CLASS_SIZE:
                members.update(_fold(c) for c in range(x[0], x[1] + 1))
            else:
                return None, True
        return (members, True) if len(members) <= CLASS_SIZE else (None, True)
    if op is sre.SUBPATTERN:
        return _sequence(arg[-1])
    if op is sre.BRANCH:
        found = [_sequence(x) for x in arg[1]]
        if all(s is not None for s, _ in found) and sum(len(s) for s, _ in found) <= ALTERNATIVES:
            return set().union(*(s for s, _ in found)), True
        return None, _any(q if s is None else _literal_query(s) for s, q in found)
    if op in (sre.MAX_REPEAT, sre.MIN_REPEAT, sre.POSSESSIVE_REPEAT):
        least, most, inner = arg
        strings, query = _sequence(inner)
        if strings is not None and most == 1:
            return strings | ({""} if least == 0 else set()), True
        if least == 0:
            return None, True
        return None, query if strings is None else _literal_query(strings)
    if op in (sre.AT, sre.ASSERT, sre.ASSERT_NOT):
        return {""}, True
    return None, True


def _fold(code: int) -> str:
    return chr(code).lower() if code < 128 else chr(code)


def _sequence(nodes):
    parts, now, whole = [], {""}, True
    for op, arg in nodes:
        strings, query = _node(op, arg)
        if strings is not None and len(now) * len(strings) <= ALTERNATIVES:
            now = {a + b for a in now for b in strings}
            continue
        whole = False
        parts.append(_literal_query(now))
        if strings is None:
            parts.append(query)
            now = {""}
        else:
            now = strings
    return (now, True) if whole else (None, _all([*parts, _literal_query(now)]))


def trigram_query(pattern: str):
    """The Boolean trigram query of a pattern; True if it has no mandatory trigram.

    Trigrams are of folded ASCII letters, so the query holds with and without ``ignore_case``.
    A pattern with letters beyond ASCII under a case flag of its own isn't used here.
    """
    strings, query = _sequence(sre_parser.parse(pattern))
    return _literal_query(strings) if strings is not None else query


def _run_of_one_class(pattern: str) -> bool:
    """Whether a pattern is one character or class, once or more, and nothing else."""
    nodes = list(sre_parser.parse(pattern))
    if len(nodes) != 1 or nodes[0][0] is not sre.MAX_REPEAT or not pattern.endswith("+"):
        return False
    least, most, inner = nodes[0][1]
    return (least, most) == (1, sre.MAXREPEAT) and len(inner) == 1 and inner[0][0] in (sre.IN, sre.LITERAL)


def _trigrams(query) -> set[str]:
    if query is True:
        return set()
    return {query} if isinstance(query, str) else set().union(*map(_trigrams, query[1]))


class TrigramScanner:
    """Indexes blocks of texts and finds the spans of the rules."""

    def __init__(self, rules=RULES):
        self.rules = rules
        self.regexes = [r.compiled() for r in rules]
        self.queries = [trigram_query(r.pattern) for r in rules]
        wanted = sorted({t.encode() for q in self.queries for t in _trigrams(q) if t.isascii()})
        self.number = {t: i for i, t in enumerate(wanted)}
        self.table = np.zeros(1 << 24, dtype=np.uint16)
        for t, i in self.number.items():
            self.table[t[0] << 16 | t[1] << 8 | t[2]] = i + 1

    def postings(self, texts: list[bytes]) -> np.ndarray:
        """[trigram, document]: whether the document holds the trigram."""
        sizes = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts)) + 2
        data = np.frombuffer(b"\0\0".join([*(t.lower() for t in texts), b""]), dtype=np.uint8)
        held = np.zeros((len(self.number), len(texts)), dtype=bool)
        if len(data) > 2:
            code = data[:-2].astype(np.uint32)
            code <<= 8
            code |= data[1:-1]
            code <<= 8
            code |= data[2:]
            number = self.table[code]
            at = np.flatnonzero(number)
            held[number[at].astype(np.int64) - 1, np.searchsorted(np.cumsum(sizes), at, side="right")] = True
        return held

    def matching(self, query, held: np.ndarray) -> np.ndarray:
        if query is True:
            return np.ones(held.shape[1], dtype=bool)
        if isinstance(query, str):
            return held[self.number[query.encode()]] if query.isascii() else np.ones(held.shape[1], dtype=bool)
        masks = [self.matching(q, held) for q in query[1]]
        return (np.logical_and if query[0] == "and" else np.logical_or).reduce(masks)

    def scan(self, texts: list[str | None]) -> list[list[tuple[str, int, int]]]:
        """Spans of each text by start, then by the rules' order; code points, end exclusive."""
        texts = [t or "" for t in texts]
        held = self.postings([t.encode() for t in texts])
        found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        for k, (rule, regex, query) in enumerate(zip(self.rules, self.regexes, self.queries)):
            if rule.group == 0 and _run_of_one_class(rule.pattern):  # the same maximal runs; short ones needn't be made
                regex = re.compile(f"{rule.pattern[:-1]}{{{rule.least},}}", regex.flags)
            for d in np.flatnonzero(self.matching(query, held)).tolist():
                found[d] += [(m.start(), k, m.end()) for m in regex.finditer(texts[d]) if m.end(rule.group) - m.start(rule.group) >= rule.least]
        return [[(self.rules[k].kind, s, e) for s, k, e in sorted(x)] for x in found]


def scan(docs: DataFrame, rules=RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, spans) for every row of ``docs``.

    A null or empty text has an empty list of spans. Null ids and repeated rows stay, one output
    row per input row; only the two named columns are read; an empty table gives an empty result. A very
    long text is scanned whole, in a block of its own. A match that has too few characters is
    dropped and not tried again further on.
    """

    def run(batches):
        scanner = TrigramScanner(rules)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for lo, hi in chunks_by_bytes([len(t or "") for t in texts], BLOCK_BYTES):
                spans = [[{"kind": k, "start": s, "end": e} for k, s, e in x] for x in scanner.scan(texts[lo:hi])]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(spans, type=SPANS_ARROW)], names=[id_col, "spans"])

    rows = docs.select(F.col(id_col), F.col(text_col))
    return rows.mapInArrow(run, f"`{id_col}` {rows.schema[0].dataType.simpleString()}, spans {SPANS}")


def redact(docs: DataFrame, rules=RULES, text_col: str = "text", length_col: str | None = None, mark: str = "[SECRET]") -> DataFrame:
    """``docs``, every column kept, with each run of overlapping spans in the text replaced by ``mark``.

    Null texts stay null, empty ones empty; ids aren't looked at, repeated rows are answered each, an empty table
    gives an empty result, and very long texts are scanned whole. ``length_col`` gets the new length in code
    points where a text changes; no other column is touched or added, so names can't clash.
    """
    names = docs.columns

    def run(batches):
        scanner = TrigramScanner(rules)
        for batch in batches:
            texts = batch.column(names.index(text_col)).to_pylist()
            for lo, hi in chunks_by_bytes([len(t or "") for t in texts], BLOCK_BYTES):
                part = batch.slice(lo, hi - lo)
                new = [replaced(t, s, mark) if s else t for t, s in zip(texts[lo:hi], scanner.scan(texts[lo:hi]))]
                columns = [pa.array(new, type=part.column(i).type) if c == text_col else part.column(i) for i, c in enumerate(names)]
                if length_col:
                    i = names.index(length_col)
                    lengths = [n if a is b else len(b) for n, a, b in zip(part.column(i).to_pylist(), texts[lo:hi], new)]
                    columns[i] = pa.array(lengths, type=part.column(i).type)
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.mapInArrow(run, docs.schema)


def replaced(text: str, spans, mark: str) -> str:
    out, at = [], 0
    for _, start, end in spans:
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join([*out, text[at:]])


def digests(found: DataFrame) -> DataFrame:
    """The counts and the digests of the spans of each document."""
    base = [r.kind for r in BASE_RULES]

    def of_kind(kind):
        return lambda s: s["kind"] == kind

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    of = F.filter("spans", lambda s: s["kind"].isin(base))
    return found.select(
        "doc_id",
        *[F.size(F.filter("spans", of_kind(k))).cast("long").alias(f"n_{k}") for k in base],
        F.sha2(joined(of).cast("binary"), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
    )


def op7_secrets(spark, sf_dir: str) -> DataFrame:
    """Secrets in every whole text of ``documents``."""
    return digests(scan(spark.read.parquet(f"{sf_dir}/documents.parquet")))
