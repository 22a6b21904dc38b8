"""Vector codes by product quantisation, nearest entries by kd-trees.

Vectors of integers are cut into parts. Each round broadcasts a kd-tree of every part's codebook, whose
size is fixed by the parameters; tasks find nearest entries by branch and bound and send integer
sums, from which the next codebooks are made.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .vectors import matrix, packed, usable

PARTS, ENTRIES, ROUNDS = 8, 16, 6
#: Entries of a leaf; they are compared with a point one by one.
LEAF = 2
#: Rows that are searched at a time.
ROWS = 4096


class KdTree:
    """Nearest entries of a codebook for many points at once, exactly and in integers.

    A node holds the box of its entries. A point visits the nearer child first, and a node only if its box
    is no further than the nearest entry found: nodes at an equal bound are visited, so that of equal
    distances the lowest index wins, as in a scan.
    """

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        self.root = self._built(np.arange(len(entries)))

    def _built(self, index):
        box = self.entries[index].min(axis=0), self.entries[index].max(axis=0)
        if len(index) <= LEAF:
            return box, index, None
        axis = int((box[1] - box[0]).argmax())
        order = index[np.argsort(self.entries[index, axis], kind="stable")]
        return box, None, (self._built(order[: len(order) // 2]), self._built(order[len(order) // 2 :]))

    def nearest(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index, squared distance) of each point's nearest entry."""
        index, distance = np.full(len(points), len(self.entries)), np.full(len(points), np.iinfo("int64").max)
        self._visit(self.root, points, np.arange(len(points)), index, distance)
        return index, distance

    @staticmethod
    def _bound(node, points):
        (low, high), _, _ = node
        apart = np.maximum(low - points, 0) + np.maximum(points - high, 0)
        return np.einsum("ij,ij->i", apart, apart)

    def _visit(self, node, points, at, index, distance):
        if not len(at):
            return
        _, leaf, children = node
        if children is None:
            for e in leaf:
                apart = points[at] - self.entries[e]
                d = np.einsum("ij,ij->i", apart, apart)
                better = (d < distance[at]) | ((d == distance[at]) & (e < index[at]))
                index[at[better]], distance[at[better]] = e, d[better]
            return
        bounds = [self._bound(c, points[at]) for c in children]
        first = bounds[0] <= bounds[1]
        for mine, order in ((first, (0, 1)), (~first, (1, 0))):
            for c in order:
                left = bounds[c][mine] <= distance[at[mine]]
                self._visit(children[c], points, at[mine][left], index, distance)


def _blocks(batch: pa.RecordBatch, width: int, parts: int):
    """(rows of the batch, their parts) for some rows at a time."""
    for lo in range(0, batch.num_rows, ROWS):
        some = batch.slice(lo, ROWS)
        x = matrix(some, width)
        if np.abs(x.astype(float)).max(initial=0) ** 2 * 4 * width > 9.2e18:
            raise OverflowError("squared distances don't fit a long")
        yield some, x.reshape(-1, parts, width // parts)


def _starts(data: DataFrame, parts: int, entries: int, width: int) -> np.ndarray:
    """(part, entry, position): the parts of the rows with the smallest ids; the driver gets ``entries`` rows."""
    rows = data.select("id", "vec").orderBy(F.col("id").asc_nulls_last(), "vec").limit(entries).collect()
    books = np.array([np.frombuffer(r.vec, "<i8") for r in rows], dtype="int64")
    return books.reshape(len(rows), parts, width // parts).transpose(1, 0, 2).copy()


def _moved(data: DataFrame, books: np.ndarray, width: int) -> np.ndarray:
    """The codebooks after a round: each entry the floor of the mean of the parts that are nearest to it."""
    spark, (parts, entries, size) = data.sparkSession, books.shape
    trees = spark.sparkContext.broadcast([KdTree(b) for b in books])

    def run(batches):
        sums, counts = np.zeros((parts, entries, size), dtype="int64"), np.zeros((parts, entries), dtype="int64")
        for batch in batches:
            for _, x in _blocks(batch, width, parts):
                for p, tree in enumerate(trees.value):
                    index, _ = tree.nearest(x[:, p])
                    counts[p] += np.bincount(index, minlength=entries)
                    np.add.at(sums[p], index, x[:, p])
        used = np.argwhere(counts > 0)
        if len(used):
            yield pa.RecordBatch.from_arrays([pa.array(used[:, 0], pa.int32()), pa.array(used[:, 1], pa.int32()), pa.array(counts[counts > 0]), pa.array(list(sums[counts > 0]), pa.list_(pa.int64()))], names=["part", "entry", "n", "sums"])

    told = data.select("vec").mapInArrow(run, "part int, entry int, n long, sums array<long>")
    out = books.copy()
    for r in told.groupBy("part", "entry").agg(F.sum("n").alias("n"), *[F.sum(F.get("sums", F.lit(j))).alias(f"s{j}") for j in range(size)]).collect():
        out[r[0], r[1]] = [s // r[2] for s in r[3:]]
    trees.destroy()
    return out


def codebooks(data: DataFrame, width: int, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray:
    """(part, entry, position) codebooks of packed rows (id, vec) after ``rounds``."""
    books = _starts(data, parts, entries, width)
    for _ in range(rounds):
        books = _moved(data, books, width)
    return books


def encode(data: DataFrame, books: np.ndarray, width: int) -> DataFrame:
    """``data``, whose last column is ``vec``, with ``code`` and ``error`` in that column's place."""
    parts, entries, size = books.shape
    trees = data.sparkSession.sparkContext.broadcast([KdTree(b) for b in books])
    names = data.columns[:-1]

    def run(batches):
        for batch in batches:
            for some, x in _blocks(batch, width, parts):
                found = [tree.nearest(x[:, p]) for p, tree in enumerate(trees.value)]
                codes = np.stack([i for i, _ in found], axis=1).astype("u1")
                yield pa.RecordBatch.from_arrays([*some.columns[:-1], pa.array([c.tobytes().hex() for c in codes], pa.string()), pa.array(sum(d for _, d in found))], names=[*names, "code", "error"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in data.schema.fields[:-1])
    return data.mapInArrow(run, f"{schema}, code string, error long")


def compress(rows: DataFrame, entries_of: Column, id_col: str = "vec_id", label_col: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """(id_col, code, error, label_error, codebooks_sha256): each row's codes by codebooks that start at the rows with
    the smallest ids and move for ``rounds``.

    ``entries_of`` is an array of long, without nulls, cut into ``parts`` equal parts; rows where it is null are
    dropped. Repeated rows count and come out each; null ids come out, and start a codebook only after all others; of
    equal ids the smaller bytes come first. Of fewer rows than ``entries``, at most 256, codebooks are as small. Rows
    with null labels are one label, and a label may hold any share of the rows. Other columns aren't read. An
    empty table gives an empty result; a length that varies or isn't a multiple of ``parts``, and entries whose
    squared distances don't fit a long, are errors. The driver holds codebooks, never rows beyond the first ones.
    """
    if not 0 < entries <= 256:
        raise ValueError("codes have two hex digits: 1 to 256 entries")
    kind, label = (rows.schema[c].dataType.simpleString() for c in (id_col, label_col))
    wanted = rows.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").alias("label"), entries_of.alias("entries")).where(F.col("entries").isNotNull())
    data, width = packed(wanted, "entries", "codes")
    if not width:
        return rows.sparkSession.createDataFrame([], f"`{id_col}` {kind}, code string, error long, label_error long, codebooks_sha256 string")
    if width % parts:
        raise ValueError(f"{width} entries don't make {parts} equal parts")
    books = codebooks(data, width, parts, entries, rounds)
    coded = encode(data, books, width)
    labels = coded.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "l")
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    return coded.join(labels, F.col("label").eqNullSafe(F.col("l"))).select(F.col("id").alias(id_col), "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def op13_vector_codes(spark, sf_dir: str) -> DataFrame:
    """All usable rows of ``embeddings``, 64 bits of codes a row."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    vector = F.col("embedding").cast("array<double>")
    return compress(rows, F.when(usable(vector), F.transform(vector, lambda c: F.floor(c * 4096.0))))


def _sql() -> str:
    """The rounds of ``op13_vector_codes`` one after another, each entry compared with each part."""

    def nearest(r):
        return f"""n{r} AS MATERIALIZED (
            SELECT p.row, p.part, p.v, min(struct_pack(d := list_sum(list_transform(range(1, len(p.v) + 1), lambda i: (p.v[i] - b.v[i]) * (p.v[i] - b.v[i]))), e := b.entry)) AS best
            FROM parts p JOIN b{r} b USING (part) GROUP BY p.row, p.part, p.v)"""

    rounds = [
        f"""{nearest(r)}, m{r} AS MATERIALIZED (
            SELECT part, entry, list((s - ((s % n) + n) % n) // n ORDER BY i) AS v FROM (
                SELECT part, best.e AS entry, i, CAST(sum(v[i]) AS BIGINT) AS s, count(*) AS n FROM (SELECT *, unnest(range(1, len(v) + 1)) AS i FROM n{r}) GROUP BY ALL
            ) GROUP BY part, entry
        ), b{r + 1} AS MATERIALIZED (SELECT b.part, b.entry, coalesce(m.v, b.v) AS v FROM b{r} b LEFT JOIN m{r} m ON b.part = m.part AND b.entry = m.entry)"""
        for r in range(ROUNDS)
    ]
    return f"""
        WITH kept AS MATERIALIZED (
            SELECT row_number() OVER (ORDER BY vec_id) AS row, vec_id, label, list_transform(embedding, lambda c: CAST(floor(CAST(c AS DOUBLE) * 4096) AS BIGINT)) AS v
            FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
        ), parts AS MATERIALIZED (
            SELECT row, part, v[part * len(v) // {PARTS} + 1 : (part + 1) * len(v) // {PARTS}] AS v FROM kept, range({PARTS}) x(part)
        ), b0 AS MATERIALIZED (SELECT part, row - 1 AS entry, v FROM parts WHERE row <= {ENTRIES}), {", ".join(rounds)}, {nearest(ROUNDS)}, coded AS (
            SELECT row, string_agg(format('{{:02x}}', best.e), '' ORDER BY part) AS code, CAST(sum(best.d) AS BIGINT) AS error FROM n{ROUNDS} GROUP BY row
        )
        SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
               (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY part, entry)) FROM b{ROUNDS}) AS codebooks_sha256
        FROM coded JOIN kept USING (row)
    """


SQL = _sql()
