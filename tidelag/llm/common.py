"""Helpers shared by the operators: Arrow text as flat numpy arrays, bounded slices, shared tables."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The bytes that separate words in ``[^\x20\x09-\x0D]+``.
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True

#: Bytes of text that one call of a kernel handles at once (a longer single text is handled alone).
SLICE_BYTES = 2 << 20
#: Rows of an Arrow batch.
BATCH_ROWS = 1000


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder below the session's ``spark.checkpoint.dir``, which all executors share.

    A path without a scheme is of the default file system. Without that setting a session of one process
    uses a temporary folder; any other is refused.
    """
    top, context = spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext
    if not top:
        if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        import tempfile

        top = f"file://{tempfile.gettempdir()}/tidelag-shared"
        spark.conf.set("spark.checkpoint.dir", top)
    path = context._jvm.org.apache.hadoop.fs.Path(top)
    fs = path.getFileSystem(context._jsc.hadoopConfiguration())
    uri = path.makeQualified(fs.getUri(), fs.getWorkingDirectory()).toUri()
    return f"{uri.getScheme()}://{uri.getAuthority() or ''}{uri.getPath().rstrip('/')}/{name}-{uuid.uuid4().hex}"


_written: list[str] = []


def drop_stored(spark: SparkSession) -> None:
    """Deletes the tables that this driver has stored so far; call it when the results that read them are consumed."""
    while _written:
        _delete(spark, _written.pop())


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def consumed(*tables: DataFrame) -> None:
    """Deletes stored tables that nothing reads any more: what was made of them is stored itself."""
    for df in tables:
        _written.remove(df.folder)
        _delete(df.sparkSession, df.folder)


def stored(df: DataFrame, name: str, codec: str = "zstd", options: dict[str, str] | None = None) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it again: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = shared_dir(spark, name)
    _written.append(path)
    df.write.options(**(options or {})).option("compression", codec).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.folder = path  # for consumed()
    return out


def text_name(text_col: str):
    """The SHA-256 that names a text, null as empty."""
    return F.unhex(F.sha2(F.coalesce(F.col(text_col).cast("string"), F.lit("")), 256))


def hash_below(name: str, share: float):
    """True for a share of all values of a 64-bit hash column, however small the share."""
    return F.col(name) <= (min(int(share * 2**64), 2**64 - 1) - 2**63)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, with underscores before those that df's columns have already (in any case of letters)."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def flat(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets (one more than rows) of a string or binary array; null is empty."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    arr = arr.cast(pa.large_binary())
    if arr.null_count:
        arr = pc.fill_null(arr, b"")
    _, off, data = arr.buffers()
    offsets = np.frombuffer(off, np.int64)[arr.offset : arr.offset + len(arr) + 1] if off else np.zeros(1, np.int64)
    if data is None:
        return np.zeros(0, np.uint8), offsets - offsets[0]
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in slices of at most `limit` bytes of `column` (or of one row)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0)).astype(np.int64)
        ends, start, n = np.cumsum(sizes), 0, batch.num_rows
        while start < n:
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + limit, "right")))
            yield batch.slice(start, min(stop, n) - start)
            start = stop


def small_batches(spark: SparkSession) -> None:
    """Keeps Arrow batches of texts near SLICE_BYTES in the JVM too: at most BATCH_ROWS rows unless the session says fewer."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key, "10000"))
    if not 0 < now <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def per_slice(df: DataFrame, column: str, kernel: Callable[[pa.RecordBatch], dict], schema: str, limit: int = SLICE_BYTES) -> DataFrame:
    """mapInArrow with a kernel that gets slices of bounded size and returns columns by name."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    small_batches(df.sparkSession)
    fields = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches, column, limit):
            cols = kernel(piece)
            yield pa.RecordBatch.from_arrays([cols[f.name].cast(f.type) if isinstance(cols[f.name], (pa.Array, pa.ChunkedArray)) else pa.array(cols[f.name], f.type) for f in fields], schema=fields)

    return df.mapInArrow(run, schema)


def word_starts(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """True where a word `[^\\x20\\x09-\\x0D]+` begins; words never cross texts."""
    solid = ~SPACE[data]
    start = solid.copy()
    if len(data):
        start[1:] &= ~solid[:-1]
        first = off[:-1][(off[:-1] < off[1:])]
        start[first] = solid[first]
    return start


def sums(flags: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Sum of flags (any number type) over each text."""
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return total[off[1:]] - total[off[:-1]]


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x
