"""Byte-level BPE encoding and decoding by corpus-level merge replay.

Each task takes the distinct pieces of a block of documents that it has not met yet as one corpus:
an inverted index from the rank of a token pair to the positions that hold it is built with numpy,
ranks are replayed from the lowest, and a merge touches only its two neighbours, whose new pairs
are added to the index. Documents are then written out from the encoded pieces. Nothing is
shuffled: the pieces of a document are encoded where the document is read.
"""

from __future__ import annotations

import base64
import hashlib
from heapq import heapify, heappop, heappush
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from .common import chunks_by_bytes

#: Bytes of text whose fresh pieces make one corpus, and pieces that a Python worker remembers at most.
BLOCK_BYTES, REMEMBERED = 4 << 20, 500_000

#: What this Python worker has encoded so far (int32 ids as bytes), by the key of the ranks; later
#: tasks go on from it.
_workers: dict[str, tuple["MergeReplay", dict[str, bytes]]] = {}

SCHEMA = "ids array<int>, decoded binary"


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank, from a rank file (base64 token, space, rank per line)."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}


class MergeReplay:
    """Encodes lists of pieces; keeps the pair ranks that it has looked up."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = dict(zip(ranks.values(), ranks.keys()))
        self.first = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int64)
        self.pairs: dict[int, int] = {}

    def rank(self, pair: int) -> int:
        """Rank of the token that a pair (left << 32 | right) merges to, -1 if there is none."""
        got = self.pairs.get(pair)
        if got is None:
            got = self.pairs[pair] = self.ranks.get(self.bytes_of[pair >> 32] + self.bytes_of[pair & 0xFFFFFFFF], -1)
        return got

    def encode(self, pieces: list[bytes]) -> list[tuple[int, ...]]:
        """Ids of each piece. A piece that is a token is that token, as in tiktoken."""
        whole = [self.ranks.get(p) for p in pieces]
        todo = [p for p, r in zip(pieces, whole) if r is None]
        done = iter(self._replay([p for p in todo if p]))
        return [(r,) if r is not None else next(done) if p else () for p, r in zip(pieces, whole)]

    def _replay(self, pieces: list[bytes]) -> list[tuple[int, ...]]:
        if not pieces:
            return []
        if len(self.pairs) > REMEMBERED:
            self.pairs.clear()
        sizes = np.fromiter(map(len, pieces), dtype=np.int64, count=len(pieces))
        ends = np.cumsum(sizes)
        start = self.first[np.frombuffer(b"".join(pieces), dtype=np.uint8)]
        n = len(start)
        word = np.repeat(np.arange(len(pieces)), sizes)
        inner = np.flatnonzero(word[:-1] == word[1:])
        codes, which = np.unique(start[inner] << 32 | start[inner + 1], return_inverse=True)
        rank_of = np.fromiter((self.rank(c) for c in codes.tolist()), dtype=np.int64, count=len(codes))[which]
        inner, rank_of = inner[rank_of >= 0], rank_of[rank_of >= 0]
        order = np.argsort(rank_of, kind="stable")
        inner, rank_of = inner[order], rank_of[order]
        at = np.flatnonzero(np.r_[True, rank_of[1:] != rank_of[:-1]]) if len(rank_of) else np.array([], dtype=np.int64)
        index = dict(zip(rank_of[at].tolist(), (x.tolist() for x in np.split(inner, at[1:])))) if len(at) else {}
        heap = list(index)
        heapify(heap)

        tok, nxt, prv = start.tolist(), list(range(1, n + 1)), list(range(-1, n - 1))
        for e in ends.tolist():
            nxt[e - 1] = -1
        for s in (ends - sizes).tolist():
            prv[s] = -1
        held = np.full(n, -1, dtype=np.int64)
        held[inner] = rank_of
        held = held.tolist()  # rank of the pair that starts at a position, -1 without one
        word_of, known, rank = word.tolist(), self.pairs, self.rank
        while heap:
            r = heappop(heap)
            places = index.pop(r, None)
            if places is None:
                continue
            places.sort()
            behind: set[int] = set()  # words in which a lower rank came up meanwhile; it goes first
            for p in places:
                if held[p] != r:
                    continue
                if behind and word_of[p] in behind:
                    if r not in index:
                        index[r] = []
                        heappush(heap, r)
                    index[r].append(p)
                    continue
                q = nxt[p]
                tok[p], tok[q], held[q] = r, -1, -1
                after, before = nxt[q], prv[p]
                nxt[p] = after
                if after >= 0:
                    prv[after] = p
                    pair = r << 32 | tok[after]
                    new = known[pair] if pair in known else rank(pair)
                    held[p] = new
                    if new >= 0:
                        if new in index:
                            index[new].append(p)
                        else:
                            index[new] = [p]
                            heappush(heap, new)
                        if new < r:
                            behind.add(word_of[p])
                else:
                    held[p] = -1
                if before >= 0:
                    pair = tok[before] << 32 | r
                    new = known[pair] if pair in known else rank(pair)
                    held[before] = new
                    if new >= 0:
                        if new in index:
                            index[new].append(before)
                        else:
                            index[new] = [before]
                            heappush(heap, new)
                        if new < r:
                            behind.add(word_of[p])
        out, s = [], 0
        for e in ends.tolist():
            out.append(tuple(t for t in tok[s:e] if t >= 0))
            s = e
        return out


def _as_bytes(encoded: list[tuple[int, ...]]):
    """The ids of each piece as the bytes of int32 numbers."""
    ends = np.cumsum([0, *map(len, encoded)]) * 4
    whole = np.fromiter(chain.from_iterable(encoded), dtype=np.int32, count=int(ends[-1]) // 4).tobytes()
    return (whole[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist()))


def encode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, ids, decoded) for every row of ``docs``, texts encoded whole and decoded again.

    A null or empty text has no ids and decodes to no bytes; null ids and repeated rows are kept
    as they are, one output row per input row; an empty table gives an empty result. Only the two
    named columns are read, so further columns, whatever their names, don't matter. A very long text is
    encoded whole, in a block of its own. ``decoded`` is
    made from ``ids`` alone. The rank file is read by the driver and broadcast; its size is that of
    the vocabulary and doesn't grow with the input.
    """
    spark = docs.sparkSession
    ranks = load_ranks(ranks_path)
    key = hashlib.sha256(repr(sorted(ranks.items(), key=lambda x: x[1])).encode()).hexdigest()
    shared = spark.sparkContext.broadcast(ranks)

    def run(batches):
        if key not in _workers:
            _workers.clear()
            _workers[key] = MergeReplay(shared.value), {}
        replay, seen = _workers[key]
        split, token = regex.compile(pattern).findall, replay.bytes_of
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for lo, hi in chunks_by_bytes([len(t or "") for t in texts], BLOCK_BYTES):
                pieces = [split(t) if t else [] for t in texts[lo:hi]]
                if len(seen) > REMEMBERED:
                    seen.clear()
                fresh = list(set(chain.from_iterable(pieces)).difference(seen))
                seen.update(zip(fresh, _as_bytes(replay.encode([p.encode() for p in fresh]))))
                flat = [b"".join(map(seen.__getitem__, p)) for p in pieces]
                decoded = [b"".join(map(token.__getitem__, np.frombuffer(ids, dtype=np.int32).tolist())) for ids in flat]
                offsets = np.zeros(len(flat) + 1, dtype=np.int32)
                np.cumsum([len(x) // 4 for x in flat], out=offsets[1:])
                values = np.frombuffer(b"".join(flat), dtype=np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.ListArray.from_arrays(pa.array(offsets), pa.array(values)), pa.array(decoded, type=pa.binary())], names=[id_col, "ids", "decoded"])

    rows = docs.select(F.col(id_col), F.col(text_col))
    return rows.mapInArrow(run, f"`{id_col}` {rows.schema[0].dataType.simpleString()}, {SCHEMA}")


def decode(encoded: DataFrame, ranks_path: str, ids_col: str = "ids") -> DataFrame:
    """``encoded`` with a column ``decoded_bytes`` made from ``ids_col``; null ids give null."""
    shared = encoded.sparkSession.sparkContext.broadcast(load_ranks(ranks_path))

    @F.pandas_udf("binary")
    def joined(ids):
        import pandas as pd

        token = {r: b for b, r in shared.value.items()}
        return pd.Series([None if x is None else b"".join(map(token.__getitem__, x)) for x in ids], dtype=object)

    return encoded.withColumn("decoded_bytes", joined(F.col(ids_col)))


def op5_bpe(spark, sf_dir: str) -> DataFrame:
    """Token counts and digests of every whole text of ``documents``."""
    import public_tokenizers as tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = encode(docs, tokenizers.path("byte_bpe_50k.tiktoken"), tokenizers.PATTERN)
    return digests(out)


def digests(encoded: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of encoded documents."""
    return encoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
