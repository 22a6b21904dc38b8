"""Chat formatting by a grammar round trip.

A turn is rendered, read back by a deterministic parser and compared with its source; where the two
differ, what conflicts in the text is escaped and the turn is tried again. Turns are rendered where
they lie; one shuffle brings those of a conversation together, and from there on conversations pass
through tasks as streams, so that a task holds a part of one, however long it is.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass, field
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: Breaks a control string that stands in a text: it comes after the first character.
MARK = "\\"
#: Characters of formatted text in one output row, unless a single turn has more.
PART_CHARS = 1 << 20
#: Rows and characters that leave a task together.
BATCH_ROWS, BATCH_CHARS = 5000, 1 << 22

PART_SCHEMA = "part int, text string, loss array<struct<start:int,end:int>>"


def _overlap(a: str, b: str) -> bool:
    """Whether ``a`` ends with a proper prefix of ``b``."""
    return any(a[-k:] == b[:k] for k in range(1, min(len(a) + 1, len(b))))


@dataclass(frozen=True)
class Template:
    """A chat format: what opens and closes a turn of each role.

    ``roles`` has (opening, closing) by role; one opening may be empty. Roles that it lacks, and an
    empty or null one, open with ``other[0]``, their name in percent encoding and ``other[1]``, and close
    with ``other[2]``. A closing holds one of ``controls``, a non-empty opening begins with one. Controls
    that could be read in two ways are an error, so that texts can be escaped reversibly.
    """

    begins: str
    roles: dict[str, tuple[str, str]]
    other: tuple[str, str, str]
    controls: tuple[str, ...]
    _of: dict = field(default_factory=dict, repr=False, compare=False)

    def __post_init__(self):
        closings = [c for _, c in self.roles.values()] + [self.other[2]]
        for c in self.controls:
            if len(c) < 2 or MARK in c or any(c != d and d in c for d in self.controls) or any(_overlap(c, d) for d in self.controls):
                raise ValueError(f"control {c!r} is short, marked, or overlaps another")
        for s in [self.begins, self.other[1], *closings, *(o for o, _ in self.roles.values())]:
            if MARK in s or any(_overlap(s, c) for c in self.controls):
                raise ValueError(f"{s!r} may run into a text")
        ordered = sorted(self.controls, key=len, reverse=True)
        self._of["control"] = re.compile("|".join(map(re.escape, ordered)))
        self._of["loose"] = re.compile("|".join(f"{re.escape(c[0])}{re.escape(MARK)}*{re.escape(c[1:])}" for c in ordered))
        self._of["marked"] = re.compile("|".join(f"{re.escape(c[0])}{re.escape(MARK)}+{re.escape(c[1:])}" for c in ordered))
        for s in closings:
            found = [m.start() for m in self._of["control"].finditer(s)]
            if len(found) != 1:
                raise ValueError(f"closing {s!r} doesn't hold one control")
            self._of[s] = found[0]
        self._of["openings"] = sorted(((o, r) for r, (o, _) in self.roles.items() if o), key=lambda x: -len(x[0]))
        bare = [r for r, (o, _) in self.roles.items() if not o]
        if len(bare) > 1:
            raise ValueError(f"roles {bare} can't be told apart")
        self._of["bare"] = bare[0] if bare else None

    def marks(self, role: str | None) -> tuple[str, str]:
        """What opens and closes a turn of ``role``."""
        if role in self.roles:
            return self.roles[role]
        return self.other[0] + quote(role or "", safe="") + self.other[1], self.other[2]

    def escape(self, text: str, after: str = "") -> str:
        """``text`` with one more mark in each control, marked or not, that begins in it; ``after`` is what follows."""
        found = [m.start() + 1 for m in self._of["loose"].finditer(text + after) if m.start() < len(text)]
        return MARK.join(text[a:b] for a, b in zip([0, *found], [*found, len(text)]))

    def unescape(self, body: str, after: str = "") -> str:
        """``body`` with one mark less in each marked control; undoes ``escape`` of the same surroundings."""
        if MARK not in body:
            return body
        cut = [m.start() + 1 for m in self._of["marked"].finditer(body + after) if m.start() < len(body)]
        return "".join(body[a:b] for a, b in zip([0, *(c + 1 for c in cut)], [*cut, len(body)]))

    def parse(self, text: str, at: int = 0):
        """(role, turn's start, body's start, body's end, turn's end) of each turn of ``text`` from ``at`` on.

        The grammar needs no look-ahead beyond one control: an opening names the role, and the first
        control after it must be the role's closing. Anything else is a ``ValueError``.
        """
        while at < len(text):
            start, role = at, self._of["bare"]
            for opening, r in self._of["openings"]:
                if text.startswith(opening, at):
                    role, at = r, at + len(opening)
                    break
            else:
                if text.startswith(self.other[0], at):
                    end = text.index(self.other[1], at + len(self.other[0]))
                    role, at = unquote(text[at + len(self.other[0]) : end]), end + len(self.other[1])
                elif role is None:
                    raise ValueError(f"no turn begins at {at}")
            closing, found = self.marks(role)[1], self._of["control"].search(text, at)
            end = found.start() - self._of[closing] if found else -1
            if end < at or not text.startswith(closing, end):
                raise ValueError(f"a turn from {start} on doesn't close")
            yield role, start, at, end, (at := end + len(closing))

    def _reads_as(self, piece: str, role: str, text: str) -> bool:
        try:
            return [(r, self.unescape(piece[a:b], self.marks(r)[1])) for r, _, a, b, _ in self.parse(piece)] == [(role, text)]
        except ValueError:
            return False

    def render(self, role: str | None, text: str | None) -> tuple[str, int, int]:
        """A turn as text, and where its body lies in it, by trying until it reads as its source."""
        role, text = role or "", text or ""
        opening, closing = self.marks(role)
        for tried in (lambda: text, lambda: self.escape(text), lambda: self.escape(text, closing)):
            body = tried()
            if self._reads_as(opening + body + closing, role, text):
                return opening + body + closing, len(opening), len(opening) + len(body)
        raise ValueError(f"a turn of role {role!r} doesn't read as its source")


#: Two formats in wide use; the first has further controls for other roles.
INST = Template("<s>", {"system": ("<<SYS>>\n", "\n<</SYS>>\n\n"), "user": ("[INST] ", " [/INST] "), "assistant": ("", " </s>")}, ("<<ROLE ", ">>\n", "\n<</ROLE>>\n\n"), ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<<ROLE ", "<</ROLE>>"))
IM = Template("", {}, ("<|im_start|>", "\n", "<|im_end|>\n"), ("<|im_start|>", "<|im_end|>"))


def _emitted(rows, names, types):
    """Arrow batches of an iterator of (characters, row)."""
    schema = pa.schema(list(zip(names, types)))
    held, size = [], 0
    for n, row in rows:
        held.append(row)
        size += n
        if len(held) >= BATCH_ROWS or size >= BATCH_CHARS:
            yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*held), types)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*held), types)], schema=schema)


def _rows(batches):
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns))


SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


def format_chats(turns: DataFrame, template: Template = INST, loss_roles: tuple[str, ...] = ("assistant",), conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_col, part, text, loss): every conversation of ``turns`` as formatted text.

    A conversation's turns go by ``turn_col``, nulls first, equal ones by role and rendered text; all
    rows with a null ``conv_col`` are one conversation. A null text is empty, a null role is the
    empty role, repeated rows are turns each. A conversation comes in parts, numbered from 0, that
    joined are its text; a part ends with a turn, after ``PART_CHARS`` characters, so a very long text
    is a part of its own. ``loss`` has the spans of the part, in code points, with bodies of
    ``loss_roles``. Parts of a conversation stand one after another in one partition. Other columns
    aren't read; an empty table gives an empty result.
    """
    rows = turns.select(F.col(f"`{conv_col}`").alias("conv"), F.col(f"`{turn_col}`").alias("turn"), F.col(f"`{role_col}`").cast("string").alias("role"), F.col(f"`{text_col}`").cast("string").alias("text"))
    key, order = (rows.schema[c].dataType.simpleString() for c in ("conv", "turn"))

    def render(batches):
        for batch in batches:
            done = [template.render(r, t) for r, t in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array([d[0] for d in done], pa.string()), pa.array([d[1] for d in done], pa.int32()), pa.array([d[2] for d in done], pa.int32())], names=["conv", "turn", "role", "piece", "start", "end"])

    pieces = rows.mapInArrow(render, f"conv {key}, turn {order}, role string, piece string, start int, end int")
    pieces = pieces.repartition("conv").sortWithinPartitions("conv", "turn", "role", "piece").select("conv", F.col("role").isin(*loss_roles).alias("loss"), "piece", "start", "end")

    def join(batches):
        kind = None

        def each():
            nonlocal kind
            conv, part, held, spans, size, begun = None, 0, [], [], 0, False
            for batch in batches:
                kind = batch.schema[0].type
                for c, loss, piece, start, end in zip(*(x.to_pylist() for x in batch.columns)):
                    if begun and (c != conv or size >= PART_CHARS):
                        yield size, (conv, part, "".join(held), spans)
                        held, spans, size, part = [], [], 0, part + 1
                    if not begun or c != conv:
                        conv, part, held, size, begun = c, 0, [template.begins], len(template.begins), True
                    if loss:
                        spans.append({"start": size + start, "end": size + end})
                    held.append(piece)
                    size += len(piece)
            if begun:
                yield size, (conv, part, "".join(held), spans)

        rows = each()
        first = next(rows, None)
        if first:
            yield from _emitted(_again(first, rows), [conv_col, "part", "text", "loss"], [kind, pa.int32(), pa.string(), SPANS])

    return pieces.mapInArrow(join, f"`{conv_col}` {key}, {PART_SCHEMA}")


def _again(first, rest):
    yield first
    yield from rest


def in_order(parts: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """Parts that were written and read again as ``format_chats`` gives them: in order, a conversation in one partition."""
    return parts.repartition(F.col(f"`{conv_col}`")).sortWithinPartitions(conv_col, "part")


def turns_of(parts: DataFrame, template: Template = INST, conv_col: str = "conv_id") -> DataFrame:
    """(conv_col, turn, role, text, loss, chars): the turns in ``parts`` (see ``in_order``), by the parser alone.

    Turns are numbered from 0; ``chars`` is what a turn, and before the first what begins a conversation,
    takes of the formatted text; ``loss`` tells whether the turn's body is one of the spans. No parts
    give no turns; text that isn't in the grammar is an error.
    """
    key = parts.schema[conv_col].dataType.simpleString()

    def run(batches):
        kind = None

        def each():
            nonlocal kind
            conv, turn, begun = None, 0, False
            for batch in batches:
                kind = batch.schema[0].type
                for c, part, text, loss in zip(*(x.to_pylist() for x in batch.columns)):
                    at = 0
                    if not begun or c != conv or part == 0:
                        conv, turn, begun = c, 0, True
                        if not text.startswith(template.begins):
                            raise ValueError("a conversation doesn't begin as it should")
                        at = len(template.begins)
                    under, before = {(s["start"], s["end"]) for s in loss}, 0
                    for role, _, start, end, after in template.parse(text, at):
                        yield end - start, (c, turn, role, template.unescape(text[start:end], template.marks(role)[1]), (start, end) in under, after - before)
                        turn, before = turn + 1, after

        rows = each()
        first = next(rows, None)
        if first:
            yield from _emitted(_again(first, rows), [conv_col, "turn", "role", "text", "loss", "chars"], [kind, pa.int64(), pa.string(), pa.string(), pa.bool_(), pa.int64()])

    return parts.select(f"`{conv_col}`", "part", "text", "loss").mapInArrow(run, f"`{conv_col}` {key}, turn long, role string, text string, loss boolean, chars long")


def digests(turns: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """One row a conversation of ``turns_of``: counts and running digests; no turns give no rows."""
    key = turns.schema[conv_col].dataType.simpleString()

    def run(batches):
        kind = None

        def each():
            nonlocal kind
            conv, state = None, None

            def row():
                n, all_text, chars, loss_text, formatted = state
                return 1, (conv, n, all_text.hexdigest(), chars, loss_text.hexdigest(), formatted)

            for batch in batches:
                kind = batch.schema[0].type
                for c, turn, role, text, loss, chars in zip(*(x.to_pylist() for x in batch.columns)):
                    if state is None or c != conv or turn == 0:
                        if state:
                            yield row()
                        conv, state = c, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                    state[0] += 1
                    state[1].update(f"{role}\n{text}\n".encode())
                    if loss:
                        state[2] += len(text)
                        state[3].update(text.encode())
                    state[4] += chars
            if state:
                yield row()

        rows = each()
        first = next(rows, None)
        if first:
            yield from _emitted(_again(first, rows), [conv_col, "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"], [kind, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()])

    return turns.mapInArrow(run, f"`{conv_col}` {key}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


#: Texts that look like the format's own marks, formatted with every table.
TRAP = [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")]


def op11_chat(spark, sf_dir: str) -> DataFrame:
    """All of ``conversations`` and conversation -1, formatted, read back and digested."""
    own = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    rows = own.unionByName(spark.createDataFrame(TRAP, "conv_id long, turn long, role string, text string"))
    return digests(turns_of(format_chats(rows)))


def _sql() -> str:
    """What ``op11_chat`` gives, with the marks of ``INST`` and a count of the controls to be escaped."""

    def text(s):
        return "'" + s.replace("'", "''") + "'"

    kinds = list(INST.roles.items())
    size = " ".join(f"WHEN {text(r)} THEN {len(o) + len(c)}" for r, (o, c) in kinds)
    after = " ".join(f"WHEN {text(r)} THEN {text(c)}" for r, (_, c) in kinds)
    return f"""
        WITH t AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL VALUES {", ".join(f"({c}, {t}, {text(r)}, {text(x)})" for c, t, r, x in TRAP)}
        ), s AS (
            SELECT *, length(text) + CASE role {size} ELSE length(url_encode(role)) + {len("".join(INST.other))} END
                   + len(regexp_extract_all(text || CASE role {after} ELSE {text(INST.other[2])} END, {text(INST._of["loose"].pattern)})) - 1 AS chars
            FROM t
        )
        SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
               CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
               sha256(coalesce(string_agg(text, '' ORDER BY turn, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
               CAST(sum(chars) + {len(INST.begins)} AS BIGINT) AS formatted_chars
        FROM s GROUP BY conv_id
    """


SQL = _sql()
