"""Benchmark decontamination by pigeonhole edit matching.

A test item of n characters may differ from a passage by k = floor(rate * n) edits. Cut into k + 1
pieces, at least one piece stands unchanged in every such passage. Tasks look the pieces of all
items up with one automaton, and where a piece is found, Myers' bit-parallel distance decides
whether the whole item stands there. Items and texts are compared in lower case with each run of
white space as one space.
"""

from __future__ import annotations

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import chunks_by_bytes, cut

#: Edits per character of an item.
ERROR_RATE = 0.08
#: Characters of items whose pieces are broadcast together; more items are matched in several passes.
ITEM_CHARS = 8_000_000
BLOCK_BYTES = 8 << 20

HITS = "item_id long, distance int, start int, end int"


def normal(text: str | None) -> str:
    """Lower case, white space runs as one space, none at the ends."""
    return " ".join((text or "").lower().split())


def pieces_of(item: str, rate: float) -> list[tuple[int, str]]:
    """(offset, piece): the error budget plus one pieces of nearly equal length."""
    n = len(item)
    k = min(int(rate * n), n - 1)
    cuts = [n * i // (k + 1) for i in range(k + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:])]


class Myers:
    """Best approximate occurrence of one pattern in a text, at most ``budget`` edits."""

    def __init__(self, pattern: str, budget: int):
        self.size, self.budget, self.last, self.full = len(pattern), budget, 1 << (len(pattern) - 1), (1 << len(pattern)) - 1
        self.where: dict[str, int] = {}
        for i, c in enumerate(pattern):
            self.where[c] = self.where.get(c, 0) | 1 << i

    def best(self, text: str) -> tuple[int, int] | None:
        """(distance, end) with the smallest distance, the first such end; None beyond the budget."""
        vp, vn, score, full, last, found = self.full, 0, self.size, self.full, self.last, None
        most, where = self.budget, self.where.get
        for j, c in enumerate(text):
            eq = where(c, 0)
            d0 = (((eq & vp) + vp) ^ vp) | eq | vn
            hp = vn | (full & ~(d0 | vp))
            hn = d0 & vp
            if hp & last:
                score += 1
            elif hn & last:
                score -= 1
                if score <= most:
                    found, most = (score, j + 1), score - 1
            hp <<= 1
            hn <<= 1
            vp = (hn | (full & ~(d0 | hp))) & full
            vn = d0 & hp & full
        return found


class PieceMatcher:
    """Finds the items of a block in normalised texts."""

    def __init__(self, items: list[tuple[int, str]], rate: float):
        self.items = dict(items)
        self.budget = {i: min(int(rate * len(t)), len(t) - 1) for i, t in items}
        self.forward: dict[int, Myers] = {}
        self.backward: dict[int, Myers] = {}
        owners: dict[str, list[tuple[int, int]]] = {}
        for i, t in items:
            for offset, piece in pieces_of(t, rate):
                owners.setdefault(piece, []).append((i, offset))
        self.automaton = ahocorasick.Automaton()
        for piece, who in owners.items():
            self.automaton.add_word(piece, (len(piece), who))
        self.automaton.make_automaton()

    def hits(self, text: str) -> list[tuple[int, int, int, int]]:
        """(item_id, distance, start, end) of the best place of each item that is found."""
        windows: dict[int, list[list[int]]] = {}
        for end, (size, who) in self.automaton.iter(text):
            for i, offset in who:
                k, begin = self.budget[i], end + 1 - size - offset
                lo, hi = max(0, begin - k), min(len(text), begin + len(self.items[i]) + k)
                if hi - lo < len(self.items[i]) - k:
                    continue
                mine = windows.setdefault(i, [])
                if mine and lo <= mine[-1][1] and mine[-1][0] <= lo:
                    mine[-1][1] = max(mine[-1][1], hi)
                else:
                    mine.append([lo, hi])
        return sorted(x for i, mine in windows.items() if (x := self._verified(i, mine, text)))

    def _verified(self, i: int, windows, text: str):
        item, k, best = self.items[i], self.budget[i], None
        if i not in self.forward:
            self.forward[i] = Myers(item, k)
        for lo, hi in windows:
            found = self.forward[i].best(text[lo:hi])
            if found and (best is None or found[0] < best[1]):
                d, end = found[0], lo + found[1]
                if i not in self.backward:
                    self.backward[i] = Myers(item[::-1], k)
                length = self.backward[i].best(text[max(lo, end - len(item) - k) : end][::-1])[1]
                best = (i, d, end - length, end)
        return best


def _in_blocks(items: DataFrame, item_chars: int):
    """(block, last): the broadcast texts and ids of one block of items after another. A block that isn't
    the last is dropped from the driver once the caller asks for the next."""
    total = items.select(F.sum(F.length("text"))).first()[0] or 0
    blocks = -(-total // item_chars) or 1
    for b in range(blocks):
        block = items.where(F.pmod(F.xxhash64("text"), F.lit(blocks)) == b).select("item_id", "text")
        shared = items.sparkSession.sparkContext.broadcast(block.collect())
        yield shared, b == blocks - 1
        if b < blocks - 1:
            shared.destroy()


def matches(docs: DataFrame, items: DataFrame, rate: float = ERROR_RATE, id_col: str = "doc_id", text_col: str = "text", item_chars: int = ITEM_CHARS) -> DataFrame:
    """(id_col, item_id, distance, start, end): every item that stands in a text with at most
    ``rate`` edits per character, at its best place (offsets in the normalised text).

    Items that are null, empty or white space match nothing; null and empty texts hold nothing; of
    items with the same id all are looked for. Rows of ``docs`` may repeat, each is answered on its
    own; of equally good places the first counts, and of equal items each is told; null ids stay null; very long texts are matched whole; other columns aren't read; without
    documents or items there are no rows. The pieces of items are broadcast in blocks of at most
    ``item_chars`` characters; with more items the texts are matched against one block after another,
    each result written before the next block is fetched.
    """
    rows = docs.select(F.col(id_col), F.col(text_col))
    out = None
    for shared, last in _in_blocks(items, item_chars):
        found = rows.mapInArrow(_matcher(shared, rate, id_col), f"`{id_col}` {rows.schema[0].dataType.simpleString()}, {HITS}")
        found = found if last else cut(found, "benchmark-hits")
        out = found if out is None else out.unionByName(found)
    return out


def _listed(shared, rate):
    """A matcher of the different texts of a block, and the ids of each."""
    listed: dict[str, list[int]] = {}
    for i, t in shared.value:
        if normal(t):
            listed.setdefault(normal(t), []).append(i)
    return PieceMatcher(list(enumerate(listed)), rate), list(listed.values())


def _matcher(shared, rate, id_col):
    def run(batches):
        matcher, ids = _listed(shared, rate)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for lo, hi in chunks_by_bytes([len(t or "") for t in texts], BLOCK_BYTES):
                row, found = [], []
                for r in range(lo, hi) if ids else ():
                    for k, d, s, e in matcher.hits(normal(texts[r])):
                        for i in ids[k]:
                            row.append(r)
                            found.append((i, d, s, e))
                item, distance, start, end = zip(*found) if found else ((), (), (), ())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(row, type=pa.int64())), pa.array(item, type=pa.int64()), pa.array(distance, type=pa.int32()), pa.array(start, type=pa.int32()), pa.array(end, type=pa.int32())],
                    names=[id_col, "item_id", "distance", "start", "end"],
                )

    return run


def clean(docs: DataFrame, items: DataFrame, rate: float = ERROR_RATE, text_col: str = "text", item_chars: int = ITEM_CHARS) -> DataFrame:
    """The rows of ``docs`` in which no item stands, every column kept, whatever its name.

    Each row is judged by its own text, so null ids, one id with several texts and repeated rows need no
    rule; null and empty texts stay; without items all rows stay.
    """
    out = docs
    for shared, last in _in_blocks(items, item_chars):
        out = out.mapInArrow(_cleaner(shared, rate, docs.columns.index(text_col)), docs.schema)
        out = out if last else cut(out, "benchmark-clean")
    return out


def _cleaner(shared, rate, column: int):
    def run(batches):
        matcher, ids = _listed(shared, rate)
        for batch in batches:
            texts = batch.column(column).to_pylist()
            for lo, hi in chunks_by_bytes([len(t or "") for t in texts], BLOCK_BYTES):
                keep = [not (ids and matcher.hits(normal(texts[r]))) for r in range(lo, hi)]
                yield batch.slice(lo, hi - lo).filter(pa.array(keep, type=pa.bool_()))

    return run


def op9_decontaminate(spark, sf_dir: str) -> DataFrame:
    """Every benchmark item in every whole text of ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return matches(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
