"""Matrix sums over a DataFrame: each partition gives one small block, blocks are merged on executors, then on the driver."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Blocks that reach the driver at most.
FAN_IN = 32


def batches_of(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[np.ndarray]:
    """Rows of double columns as matrices."""
    for batch in batches:
        if batch.num_rows:
            yield np.column_stack([np.asarray(batch.column(c), float) for c in columns]) if columns else np.zeros((batch.num_rows, 0))


def reduced(df: DataFrame, columns: list[str], one: Callable[[np.ndarray], np.ndarray], merge: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray | None:
    """merge over one(rows) of all batches; one gives a matrix of a fixed width. None if there are no rows."""
    schema = "rows int, width int, block binary"

    def pack(m: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([m.shape[0]], pa.int32()), pa.array([m.shape[1]], pa.int32()), pa.array([np.ascontiguousarray(m, float).tobytes()])], ["rows", "width", "block"])

    def unpack(r, w, b) -> np.ndarray:
        return np.frombuffer(b).reshape(r, w)

    def local(batches):
        total = None
        for x in batches_of(batches, columns):
            m = one(x)
            total = m if total is None else merge(total, m)
        if total is not None:
            yield pack(total)

    def again(batches):
        total = None
        for batch in batches:
            for r, w, b in zip(*(batch.column(c).to_pylist() for c in ("rows", "width", "block")), strict=True):
                m = unpack(r, w, b)
                total = m if total is None else merge(total, m)
        if total is not None:
            yield pack(total)

    blocks = df.select(*columns).mapInArrow(local, schema)
    if df.rdd.getNumPartitions() > FAN_IN:
        blocks = blocks.repartition(FAN_IN).mapInArrow(again, schema)
    out = None
    for r in blocks.collect():
        m = unpack(r["rows"], r["width"], r["block"])
        out = m if out is None else merge(out, m)
    return out


def gram(df: DataFrame, columns: list[str]) -> np.ndarray:
    """X'X of the columns."""
    p = len(columns)
    out = reduced(df, columns, lambda x: x.T @ x, lambda a, b: a + b)
    return np.zeros((p, p)) if out is None else out


def triangular(df: DataFrame, columns: list[str]) -> np.ndarray:
    """R of a QR decomposition of the columns (TSQR): it keeps norms and projections without squaring the condition."""
    out = reduced(df, columns, lambda x: np.linalg.qr(x, mode="r"), lambda a, b: np.linalg.qr(np.vstack([a, b]), mode="r"))
    return np.zeros((0, len(columns))) if out is None else out


def aliased(r: np.ndarray, tol: float = 1e-7) -> list[int]:
    """Columns that the columns kept before them span, of a matrix or of its R."""
    kept, out = np.zeros((len(r), 0)), []
    for j in range(r.shape[1]):
        x = r[:, j]
        rest = x - kept @ (kept.T @ x)
        rest -= kept @ (kept.T @ rest)
        size = np.linalg.norm(x)
        if size == 0 or np.linalg.norm(rest) < tol * size:
            out.append(j)
        else:
            kept = np.column_stack([kept, rest / np.linalg.norm(rest)])
    return out
