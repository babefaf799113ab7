"""Mixing sources to target weights.

Words of each source are packed into blocks of a fixed length along a hidden order
of its documents. Every output shard draws its source counts from a multinomial
over what each source still has to give, so that the totals meet the targets.
A slot's number within its source is mapped by a pseudorandom permutation of the
source's blocks (a new one for each pass over them), and blocks are joined to slots by index.
The mix is written with the blocks' texts, a row per slot; what is counted is counted there.

Defined results: a null or empty text has size 0 and is never taken; a null source
is a source of its own, last in order; repeated rows are rows of their own; an empty
table gives an empty result; other columns of any name are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import flat, mix64, per_slice, slices, small_batches, stored, sums, word_starts

#: Of a source's documents, so many on average share a bucket; positions are summed by bucket first.
BUCKET_DOCS = 1024


def targets(sizes: list[int], weights: tuple[float, ...], share: float = 1.0, max_epochs: float = 3.0) -> np.ndarray:
    """Words of each source in the mix: shares by weight; no source above max_epochs times its size."""
    size = np.asarray(sizes, float)
    w = np.asarray([weights[i % len(weights)] for i in range(len(size))], float)
    out, cap, free = np.zeros(len(size)), max_epochs * size, np.ones(len(size), bool)
    rest = share * size.sum()
    while free.any() and rest > 0:
        part = rest * w / w[free].sum()
        over = free & (part > cap)
        if not over.any():
            out[free] = part[free]
            break
        out[over] = cap[over]
        rest -= cap[over].sum()
        free &= ~over
    return out


def shard_counts(quota: np.ndarray, shards: int, seed: int) -> np.ndarray:
    """Slots of each source (columns) in each shard (rows): multinomial draws over what is left; columns sum to quota."""
    rng, left = np.random.default_rng(seed), quota.astype(np.int64).copy()
    out = np.zeros((shards, len(quota)), np.int64)
    for k in range(shards):
        need = int(left.sum()) // (shards - k) if k < shards - 1 else int(left.sum())
        while need and left.sum():
            got = np.minimum(rng.multinomial(need, left / left.sum()), left)
            out[k] += got
            left -= got
            need -= int(got.sum())
    return out


def permuted(index: np.ndarray, n: int, key: np.ndarray) -> np.ndarray:
    """Position of each index in a pseudorandom permutation of 0..n-1: a Feistel network with cycle walking."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    mask, shift = np.uint64((1 << half) - 1), np.uint64(half)
    out = index.astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        x, k = out[todo], key[todo]
        left, right = x >> shift, x & mask
        for turn in range(4):
            left, right = right, left ^ (mix64(right + k + np.uint64(turn << 40)) & mask)
        out[todo] = x = (left << shift) | right
        todo = todo[x >= np.uint64(n)]
    return out.astype(np.int64)


def sizes_of(docs: DataFrame, id_col: str, text_col: str, source_col: str, rest: Sequence[str] = (), with_text: bool = False) -> DataFrame:
    """id, source, a hash that orders rows of one id, columns of rest as r0, r1, ..., the text if asked for, and size in words."""
    others = [F.col(f"`{c}`").alias(f"r{i}") for i, c in enumerate(rest)]
    df = docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), F.xxhash64(text_col).alias("h"), *others, F.col(text_col).alias("text"))
    names = [c for c in df.columns if with_text or c != "text"]
    small_batches(docs.sparkSession)

    def run(batches):
        for batch in slices(batches, "text"):
            data, off = flat(batch.column("text"))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], pa.array(sums(word_starts(data, off), off), pa.int64())], [*names, "size"])

    return df.mapInArrow(run, StructType([*[df.schema[c] for c in names], StructField("size", LongType())]))


def pieces_of(placed: DataFrame, block_words: int) -> DataFrame:
    """Texts (size over 0) cut where blocks begin: src, blk, start of the text in its source, id, w words and their bytes; pieces of a text make it up."""
    id_type = placed.schema["id"].dataType.simpleString()

    def kernel(batch: pa.RecordBatch) -> dict:
        data, off = flat(batch.column("text"))
        begins = np.flatnonzero(word_starts(data, off))
        size, start = np.asarray(batch.column("size")), np.asarray(batch.column("start"))
        low = start // block_words
        n = (start + size - 1) // block_words - low + 1
        row = np.repeat(np.arange(len(n)), n)
        blk = low[row] + np.arange(len(row)) - (np.cumsum(n) - n)[row]
        word = np.maximum(blk * block_words - start[row], 0)
        cuts = np.where(word == 0, off[:-1][row], begins[(np.cumsum(size) - size)[row] + word])
        text = pa.LargeStringArray.from_buffers(len(row), pa.py_buffer(np.append(cuts, off[-1]).astype(np.int64)), pa.py_buffer(data))
        w = np.minimum((start + size)[row], (blk + 1) * block_words) - np.maximum(start[row], blk * block_words)
        return {"src": batch.column("src").take(pa.array(row)), "blk": blk, "start": start[row], "id": batch.column("id").take(pa.array(row)), "w": w, "text": text}

    return per_slice(placed.select("src", "start", "size", "id", "text"), "text", kernel, f"src int, blk long, start long, id {id_type}, w long, text string")


def deal(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = (5, 2, 1), share: float = 1.0, max_epochs: int = 3, block_words: int = 256, shards: int = 64, seed: int = 17, rest: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """The written mix, and the rows of docs with their places in it.

    The mix has a row per slot: shard, slot (its number in the shard), source, src, blk, turn (pass over the source),
    words and parts, the block's pieces of texts in order (start, id, w words, text).
    Rows of docs: id, source, size, source_size, target, src, start (null if size is 0) and the columns of rest.
    weights repeat along the sources in code-point order, null last. One row per source goes to the driver.
    """
    spark = docs.sparkSession
    sizes = stored(sizes_of(docs, id_col, text_col, source_col, rest), "mix-sizes")
    per = sizes.groupBy("source").agg(F.sum("size").alias("words"), F.sum(F.when(F.col("size") > 0, 1).otherwise(0)).alias("docs")).collect()
    per = sorted(per, key=lambda r: (r.source is None, r.source or ""))
    words = np.array([r.words for r in per], np.int64)
    goal = targets(words.tolist(), weights, share, max_epochs)
    blocks = -(-words // block_words)
    quota = np.minimum(np.rint(goal / np.maximum(words, 1) * blocks), max_epochs * blocks).astype(np.int64)
    bounds = np.concatenate([[0], np.cumsum(shard_counts(quota, shards, seed).ravel())]) if len(per) else np.zeros(1, np.int64)
    firsts = np.concatenate([np.zeros((1, len(per)), np.int64), np.cumsum(np.diff(bounds).reshape(shards, -1), 0)[:-1]]).ravel() if len(per) else bounds
    salt = mix64(np.arange(1, len(per) + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))

    info = spark.createDataFrame([(r.source, i, int(w), float(t), max(1, -(-int(r.docs) // BUCKET_DOCS))) for i, (r, w, t) in enumerate(zip(per, words, goal, strict=True))], "s string, src int, source_size long, target double, buckets int")
    info = F.broadcast(info) if len(per) <= 100_000 else info
    numbered = lambda df: df.join(info, F.col("source").eqNullSafe(F.col("s")), "left").drop("s").withColumn("bucket", F.pmod(F.xxhash64("id", "h"), F.col("buckets")).cast("int"))
    rows = numbered(sizes)

    base = rows.filter("size > 0").groupBy("src", "bucket").agg(F.sum("size").alias("n"))
    w_base = Window.partitionBy("src").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    base = base.select("src", "bucket", (F.sum("n").over(w_base) - F.col("n")).alias("base"))
    w_in = Window.partitionBy("src", "bucket").orderBy("id", "size", "h").rowsBetween(Window.unboundedPreceding, 0)

    def placed(df: DataFrame) -> DataFrame:
        """Rows with words and their start in their source; rows that tie have the same id and text."""
        full = df.filter("size > 0").withColumn("upto", F.sum("size").over(w_in))
        return full.join(base, ["src", "bucket"]).withColumn("start", F.col("base") + F.col("upto") - F.col("size"))

    def slots(batches):
        for batch in batches:
            g = np.asarray(batch.column("id"))
            cell = np.searchsorted(bounds, g, "right") - 1
            src, nth = (cell % len(per)).astype(np.int64), g - bounds[cell] + firsts[cell]
            blk = np.empty(len(g), np.int64)
            for s in np.unique(src):
                at = src == s
                turn = nth[at] // blocks[s]
                blk[at] = permuted(nth[at] - turn * blocks[s], int(blocks[s]), salt[s] + turn.astype(np.uint64) * np.uint64(0xD1B54A32D192ED03))
            yield pa.RecordBatch.from_arrays([pa.array(src, pa.int32()), pa.array(blk, pa.int64()), pa.array(nth // blocks[src], pa.int32()), pa.array(cell // len(per), pa.int32()), pa.array(g - bounds[cell // len(per) * len(per)], pa.int64())], ["src", "blk", "turn", "shard", "slot"])

    total = int(quota.sum())
    drawn = spark.range(0, total, 1, max(spark.sparkContext.defaultParallelism, total >> 22)).mapInArrow(slots, "src int, blk long, turn int, shard int, slot long")
    pieces = pieces_of(placed(numbered(sizes_of(docs, id_col, text_col, source_col, with_text=True))), block_words)
    packed = pieces.repartition("src", "blk").groupBy("src", "blk").agg(F.sort_array(F.collect_list(F.struct("start", "id", "w", "text"))).alias("parts"), F.sum("w").alias("words"))
    mixed = drawn.join(packed, ["src", "blk"]).join(info.select("src", F.col("s").alias("source")), "src")
    mixed = stored(mixed.select("shard", "slot", "source", "src", "blk", "turn", "words", "parts"), "mix-blocks")
    keep = ["id", "source", "size", "source_size", "target", "src", *[f"r{i}" for i in range(len(rest))]]
    none = rows.filter("size = 0").select(*keep, F.lit(None).cast("long").alias("start"))
    return mixed, placed(rows).select(*keep, "start").unionByName(none)


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **given) -> DataFrame:
    """Writes the mix; one row per row of docs: id_col, size, source, source_size, target, and taken, its words in the mix."""
    mixed, rows = deal(docs, id_col, text_col, source_col, **given)
    taken = mixed.select("src", F.explode("parts").alias("p")).groupBy("src", F.col("p.start").alias("start")).agg(F.sum("p.w").alias("taken"))
    out = rows.join(taken, ["src", "start"], "left")
    return out.select(F.col("id").alias(id_col), "size", "source", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken"))


def query(spark, sf_dir: str) -> DataFrame:
    """op1: mixes all documents."""
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "size", "source_size", "target", "taken")


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: a row for each document and pass that the mix takes words of, with the words it takes; whole passes have whole texts."""
    rest = [c for c in docs.columns if c != "text"]
    mixed, rows = deal(docs, rest=rest)
    parts = mixed.select("src", "turn", "blk", F.explode("parts").alias("p")).select("src", "p.start", "turn", "blk", "p.text")
    texts = parts.repartition("src", "start").groupBy("src", "start", "turn").agg(F.sort_array(F.collect_list(F.struct("blk", "text"))).alias("parts"))
    out = texts.join(rows, ["src", "start"]).withColumn("text", F.array_join("parts.text", ""))
    cols = {c: F.col(f"r{i}") for i, c in enumerate(rest)} | {"text": F.col("text")}
    if "n_chars" in cols:
        cols["n_chars"] = F.char_length("text").cast(docs.schema["n_chars"].dataType)
    return out.select(*[cols[c].alias(c) for c in docs.columns])
