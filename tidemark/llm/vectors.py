"""What the operators on vectors share: which rows count, and vectors packed for passes of numpy."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import cut


def usable(vector: Column) -> Column:
    """Whether a vector is there, and all its entries are there and finite."""
    return F.coalesce(vector.isNotNull() & F.forall(vector, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False))), F.lit(False))


def packed(rows: DataFrame, column: str, name: str) -> tuple[DataFrame, int]:
    """``rows`` with ``vec``, the entries of ``column`` (an array of long, the last column) as little-endian bytes, in
    its place, written to the shared folder; and the number of entries.

    Passes over bytes cost a copy; over arrays, a call for each entry. Vectors of several lengths
    are an error; without rows the number is 0.
    """
    kept = [f for f in rows.schema.fields if f.name != column]

    def run(batches):
        for batch in batches:
            lists = batch.column(len(kept))
            lengths = np.diff(lists.offsets.to_numpy())
            flat, ends = lists.flatten().to_numpy().astype("<i8"), np.concatenate([[0], np.cumsum(lengths) * 8]).astype("<i4")
            data = pa.Array.from_buffers(pa.binary(), len(lists), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(flat.tobytes())])
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(lengths, pa.int32()), data], names=[*(f.name for f in kept), "width", "vec"])

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept] + ["width int, vec binary"])
    out = cut(rows.select(*[f.name for f in kept], column).mapInArrow(run, schema), name)
    least, most = out.agg(F.min("width"), F.max("width")).first()
    if least != most:
        raise ValueError(f"vectors have from {least} to {most} entries")
    return out.drop("width"), most or 0


def matrix(batch: pa.RecordBatch, width: int, column: str = "vec") -> np.ndarray:
    """The packed vectors of a batch, one a row."""
    col = batch.column(batch.schema.get_field_index(column))
    if not len(col):
        return np.zeros((0, width), dtype="<i8")
    offsets = np.frombuffer(col.buffers()[1], dtype="<i4")[col.offset : col.offset + len(col) + 1]
    return np.frombuffer(col.buffers()[2], dtype="<i8")[offsets[0] // 8 : offsets[-1] // 8].reshape(len(col), width)
