"""MinHash near-duplicates by a multi-index Hamming join.

A document's set is its distinct shingles of five words; equal sets form a class. A
class has a signature of 64 minima of 16 bits each. The signature is cut into chunks
so many that a pair within MOST differing symbols has, by the pigeonhole principle, a
chunk with at most one error; for each chunk one key is made for every place of that
error, which enumerates the allowed errors. Pairs that share a key and are within the
distance are confirmed on their full sets.

Within a bucket, signatures are compared until those within the distance hang together; the
buckets' spanning forests join into loose clusters, so pairs never become rows. In a cluster full
sets meet, intersections are products of 0/1 matrices, and again only a spanning forest leaves the
task. Large buckets are cut into parts of BLOCK members, every two of which meet in a task of their
own. Clusters are cut into parts of MEMBERS members and ITEMS shingles: first each part meets itself
and one part, the hub; then, in clusters that are not one component yet, all members outside the
largest component meet all others. So a group of near copies costs work in proportion to its size.

Missing a link needs more than MOST of 64 minima to differ: under 2e-7 for a pair of
similarity 0.85, far less above.

Defined results: a text without words, or null, has an empty set and is linked with
nothing; with under five words the whole sequence is the one shingle; repeated rows are
linked and give one component; rows of one id with different texts are linked by their texts; a
similarity of exactly 0.85 is a link; a very long text is one set of all its shingles; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE, consumed, flat, fresh, mix64, per_slice, stored, sums, text_name, word_starts

SYMBOLS, MOST = 64, 27
#: Chunks: each may hold one error, so CHUNKS * 2 > MOST.
CHUNKS = MOST // 2 + 1
#: Members of a part of a bucket, and members and shingles of a part of a cluster; two parts meet in a task.
BLOCK, MEMBERS, ITEMS = 1024, 128, 1 << 20

_rng = np.random.default_rng(5)
_LETTER = _rng.integers(1, 1 << 63, 256, dtype=np.uint64)
_LETTER[65:91] = _LETTER[97:123]  # A-Z as a-z
_BASE = np.uint64(0x9E3779B97F4A7C15)
_FACTOR = _rng.integers(1, 1 << 63, SYMBOLS, dtype=np.uint64) | np.uint64(1)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n of the base modulo 2**64 and their inverses."""
    if len(_powers[0]) <= n:
        inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
        for k, base in enumerate((_BASE, inverse)):
            x = np.full(n + 1, base, np.uint64)
            x[0] = 1
            _powers[k] = np.cumprod(x, dtype=np.uint64)
    return _powers[0], _powers[1]


def word_hashes(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each word, lower-cased, and the number of words of each text."""
    begin = word_starts(data, off)
    solid = ~SPACE[data]
    first = np.flatnonzero(begin)
    if not len(first):
        return np.zeros(0, np.uint64), np.zeros(len(off) - 1, np.int64)
    place = np.arange(len(data))
    inner = place - np.maximum.accumulate(np.where(begin, place, 0))
    # a random value for each letter at each place of a word, so that no pattern of letters cancels out
    value = np.where(solid, mix64(_LETTER[data] + inner.astype(np.uint64) * _BASE), np.uint64(0))
    total = np.add.reduceat(value, first)
    chars = np.add.reduceat(solid.astype(np.int64), first)
    return mix64(total + chars.astype(np.uint64)), sums(begin, off)


def shingles(data: np.ndarray, off: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text in one array, and offsets."""
    word, count = word_hashes(data, off)
    at = np.cumsum(count) - count
    number = np.where(count >= width, count - width + 1, (count > 0).astype(np.int64))
    ends = np.concatenate([[0], np.cumsum(number)])
    out = np.zeros(int(ends[-1]), np.uint64)
    m = np.uint64(0xD1342543DE82EF95)
    if len(word) >= width:
        h = np.zeros(len(word) - width + 1, np.uint64)
        for k in range(width):
            h = h * m + word[k : len(word) - width + 1 + k]
        long = count >= width
        skip = at[long] - (np.cumsum(number[long]) - number[long])
        out[np.repeat(long, number)] = h[np.arange(int(number[long].sum())) + np.repeat(skip, number[long])]
    short = np.flatnonzero((count > 0) & (count < width))
    h = mix64(count[short].astype(np.uint64))
    for k in range(width - 1):
        more = count[short] > k
        h[more] = h[more] * m + word[at[short[more]] + k]
    out[ends[short]] = h
    out = mix64(out)
    for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
        out[a:b].sort()
    new = np.ones(len(out), bool)
    new[1:] = out[1:] != out[:-1]
    new[ends[:-1][number > 0]] = True
    return out[new], np.concatenate([[0], np.cumsum(sums(new, ends))])


def signatures(h: np.ndarray, off: np.ndarray) -> np.ndarray:
    """One row of SYMBOLS 16-bit minima for each non-empty set."""
    first = off[:-1][off[:-1] < off[1:]]
    out = np.zeros((len(first), SYMBOLS), np.uint16)
    if len(first):
        for k in range(SYMBOLS):
            out[:, k] = mix64(np.minimum.reduceat(h * _FACTOR[k], first)) & np.uint64(0xFFFF)
    return out


def keys_of(sig: np.ndarray) -> np.ndarray:
    """A 64-bit key for each chunk and each place of its one error: SYMBOLS keys a row."""
    out, at = np.zeros((len(sig), SYMBOLS), np.uint64), 0
    wide = sig.astype(np.uint64) * np.uint64(0x9E3779B1) + np.uint64(1)
    for chunk in np.array_split(np.arange(SYMBOLS), CHUNKS):
        for hole in chunk:
            h = mix64(np.full(len(sig), at + 1, np.uint64))
            for k in chunk:
                if k != hole:
                    h = mix64(h ^ wide[:, k]) + np.uint64(k)
            out[:, at] = mix64(h)
            at += 1
    return out


def named(h: np.ndarray, off: np.ndarray) -> list[np.ndarray]:
    """Two 64-bit names of each set, from sums over its members."""
    n, out = np.diff(off), []
    for salt in (np.uint64(0), np.uint64(0xA0761D6478BD642F)):
        total = np.zeros(len(n), np.uint64)
        if (n > 0).any():
            total[n > 0] = np.add.reduceat(mix64(h ^ salt), off[:-1][n > 0])
        out.append(mix64(total + n.astype(np.uint64)).view(np.int64))
    return out


def signed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, sha (of the text), h1 and h2 (128 bits that name the set, null if empty), n (its size) and sig of each row."""
    kind = docs.schema[id_col].dataType.simpleString()

    def kernel(batch: pa.RecordBatch) -> dict:
        data, at = flat(batch.column("text"))
        h, off = shingles(data, at)
        n = np.diff(off)
        full = n > 0
        names = [pa.array(x, mask=~full) for x in named(h, off)]
        sig, rows = signatures(h, off), [None] * len(n)
        for i, x in zip(np.flatnonzero(full).tolist(), sig, strict=True):
            rows[i] = x.tobytes()
        raw = data.tobytes()
        sha = [hashlib.sha256(raw[a:b]).digest() for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
        return {"id": batch.column("id"), "sha": sha, "h1": names[0], "h2": names[1], "n": n, "sig": rows}

    return per_slice(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), "text", kernel, f"id {kind}, sha binary, h1 long, h2 long, n long, sig binary")


def low_bytes(column: str):
    """The low byte of each symbol of a signature."""
    return F.unhex(F.regexp_replace(F.hex(column), "(..)..", "$1"))


def keyed(classes: DataFrame) -> DataFrame:
    """key and cid: SYMBOLS rows for each class."""

    def run(batches):
        for batch in batches:
            sig = np.frombuffer(b"".join(batch.column("sig").to_pylist()), np.uint16).reshape(-1, SYMBOLS)
            cid = np.repeat(np.asarray(batch.column("cid")), SYMBOLS)
            yield pa.RecordBatch.from_arrays([pa.array(keys_of(sig).ravel().view(np.int64)), pa.array(cid)], ["key", "cid"])

    return classes.select("cid", "sig").mapInArrow(run, "key long, cid long")


def components(edges: DataFrame) -> DataFrame:
    """v and root (the smallest vertex reachable) of every vertex of the edges a, b: large-star and small-star steps.

    Minima are stored before they are joined, so that Spark can split a hub's rows in the join.
    """
    edges = stored(edges.selectExpr("greatest(a, b) AS u", "least(a, b) AS v").filter("u <> v").distinct(), "links")
    seen = None
    while True:
        old, both = edges, edges.unionByName(edges.selectExpr("v AS u", "u AS v"))
        low = stored(both.groupBy("u").agg(F.min("v").alias("m")).selectExpr("u", "least(u, m) AS m"), "links-low")
        large = both.filter("v > u").join(low, "u").selectExpr("v AS u", "m AS v").unionByName(edges.join(low, "u").select("u", F.col("m").alias("v")))
        large = stored(large.filter("u <> v").distinct(), "links-large")
        consumed(old, low)
        low = stored(large.groupBy("u").agg(F.min("v").alias("m")), "links-low")
        small = large.join(low, "u").selectExpr("v AS u", "m AS v").unionByName(low.selectExpr("u", "m AS v"))
        edges = stored(small.filter("u <> v").distinct(), "links-small")
        consumed(large, low)
        mark = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(mark) == seen:
            break
        seen = tuple(mark)
    roots = edges.groupBy("u").agg(F.min("v").alias("root"))
    return roots.selectExpr("u AS v", "root").unionByName(roots.selectExpr("root AS v", "root").distinct())


def joined(label: np.ndarray, x: np.ndarray, y: np.ndarray) -> None:
    """Unites the places x and y pairwise: label[i] becomes the smallest place that i reaches."""
    while len(x):
        low = np.minimum(label[x], label[y])
        np.minimum.at(label, label[x], low)
        np.minimum.at(label, label[y], low)
        while True:
            up = label[label]
            if (up == label).all():
                break
            label[:] = up
        rest = label[x] != label[y]
        x, y = x[rest], y[rest]


def _and_none(batches):
    """The batches, and None at the end."""
    yield from batches
    yield None


def blocks_of(members: DataFrame, by: str, block: int, size: str = "size") -> DataFrame:
    """Members with salt, bi and bj: groups of `by` above `block` rows are cut, and every pair of parts meets once."""
    cut = members.withColumn("parts", F.ceil(F.col(size) / block).cast("int")).withColumn("salt", F.pmod(F.xxhash64("cid"), F.col("parts")).cast("int"))
    cut = cut.select("*", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
    return cut.withColumn("bi", F.least("salt", "other")).withColumn("bj", F.greatest("salt", "other")).drop("parts", "other", size)


def grouped(members: DataFrame, by: str, names: tuple[str, ...], kernel, parts: int | None = None) -> DataFrame:
    """Rows a, b that kernel gives for whole groups of (by, bi, bj); the rows of a group reach it together, in bounded batches of groups."""

    def run(batches):
        rest = None
        for batch in _and_none(batches):
            table = rest
            if batch is not None:
                table = pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])])
            if table is None or not table.num_rows:
                continue
            k, i, j = (np.asarray(table.column(c)) for c in (by, "bi", "bj"))
            bounds = np.concatenate([[0], np.flatnonzero((k[1:] != k[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])) + 1, [len(k)]])
            if batch is not None:  # the last group may go on
                rest = table.slice(bounds[-2])
                bounds = bounds[:-1]
            if len(bounds) > 1:
                a, b = kernel(table.slice(0, bounds[-1]).combine_chunks(), bounds)
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    keys = [by, "bi", "bj"]
    dealt = members.select(*keys, *names)
    dealt = dealt.repartition(parts, *keys) if parts else dealt.repartition(*keys)
    return dealt.sortWithinPartitions(*keys).mapInArrow(run, "a long, b long")


def pairs_in(bounds: np.ndarray, split: np.ndarray, own: np.ndarray, most: int = 1 << 20):
    """Index pairs of each group between bounds, in chunks; of a group of two parts those between the parts."""
    xs, ys, held = [], [], 0
    for s, e in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if split[s]:
            mine = own[s:e]
            rows, others = np.flatnonzero(mine) + s, np.flatnonzero(~mine) + s
        else:
            rows, others = np.arange(s, e), None
        step = max(1, most // max(e - s, 1))
        for k in range(0, len(rows), step):
            part = rows[k : k + step]
            if others is None:
                i, j = np.repeat(part, e - part - 1), np.concatenate([np.arange(r + 1, e) for r in part.tolist()]) if len(part) else part
            else:
                i, j = np.repeat(part, len(others)), np.tile(others, len(part))
            xs.append(i)
            ys.append(j)
            held += len(i)
            if held > most:
                yield np.concatenate(xs), np.concatenate(ys)
                xs, ys, held = [], [], 0
    if xs:
        yield np.concatenate(xs), np.concatenate(ys)


def _close(table: pa.Table, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the members of each bucket that are within the distance."""
    cid, n, bi, bj, salt = (np.asarray(table.column(c)) for c in ("cid", "n", "bi", "bj", "salt"))
    sig = np.frombuffer(b"".join(table.column("sig").to_pylist()), np.uint8).reshape(-1, SYMBOLS)
    label = np.arange(len(cid))
    for x, y in pairs_in(bounds, bi != bj, salt == bi):
        for k in range(0, len(x), 1 << 16):
            i, j = x[k : k + (1 << 16)], y[k : k + (1 << 16)]
            ok = (label[i] != label[j]) & (100 * np.minimum(n[i], n[j]) >= 85 * np.maximum(n[i], n[j]))
            i, j = i[ok], j[ok]
            near = (sig[i] != sig[j]).sum(1) <= MOST
            joined(label, i[near], j[near])
    linked = np.flatnonzero(label != np.arange(len(cid)))
    return cid[linked], cid[label[linked]]


def _linked(table: pa.Table, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A forest of the links among the members of each cluster: intersections of full sets as matrix products."""
    cid, bi, bj, salt = (np.asarray(table.column(c)) for c in ("cid", "bi", "bj", "salt"))
    lists = table.column("items").combine_chunks()
    ends = np.concatenate([[0], np.cumsum(np.asarray(lists.value_lengths()).astype(np.int64))])
    items = np.asarray(lists.flatten())
    label = np.arange(len(cid))
    for s, e in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        size = np.diff(ends[s : e + 1])
        own, code, often = np.unique(items[ends[s] : ends[e]], return_inverse=True, return_counts=True)
        row = np.repeat(np.arange(e - s), size)
        every = int((often == e - s).sum())
        use = (often > 1) & (often < e - s)
        column = np.cumsum(use) - 1
        keep = use[code]
        r, c = row[keep], column[code[keep]]
        common = np.full((e - s, e - s), every, np.int64)
        width = max(256, (8 << 20) // max(e - s, 1))
        order = np.argsort(c, kind="stable")
        r, c = r[order], c[order]
        for k in range(0, int(use.sum()), width):
            a, b = np.searchsorted(c, [k, k + width])
            x = np.zeros((e - s, width), np.float32)
            x[r[a:b], c[a:b] - k] = 1
            common += (x @ x.T).astype(np.int64)  # exact: a product sums at most width ones
        both = size[:, None] + size[None, :]
        link = 100 * common >= 85 * (both - common)
        if bi[s] != bj[s]:
            mine = salt[s:e] == bi[s]
            link &= mine[:, None] != mine[None, :]
        i, j = np.nonzero(np.triu(link, 1))
        joined(label, i + s, j + s)
    linked = np.flatnonzero(label != np.arange(len(cid)))
    return cid[linked], cid[label[linked]]


def sets_of(docs: DataFrame, need: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """cid and items (the set) of the classes in need (cid, rep, h1, h2)."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    rows = rows.join(need.hint("merge"), F.col("id").eqNullSafe(F.col("rep"))).select("cid", "h1", "h2", "text")

    def kernel(batch: pa.RecordBatch) -> dict:
        h, off = shingles(*flat(batch.column("text")))
        one, two = named(h, off)
        same = (one == np.asarray(batch.column("h1"))) & (two == np.asarray(batch.column("h2")))
        return {"cid": batch.column("cid"), "same": same, "items": pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(h.view(np.int64)))}

    return per_slice(rows, "text", kernel, "cid long, same boolean, items array<long>").filter("same").drop("same").dropDuplicates(["cid"])


def round_of_hubs(sets: DataFrame) -> DataFrame:
    """Members of clusters (root, parts, salt) with the tasks they go to: those of part 0 to the task of each part, the others to their own."""
    hub = F.when(F.col("parts") == 1, F.array(F.lit(0))).when(F.col("salt") == 0, F.sequence(F.lit(1), F.col("parts") - 1)).otherwise(F.array("salt"))
    return sets.withColumn("bi", F.explode(hub)).withColumn("bj", F.col("bi"))


def round_of_rest(sets: DataFrame, comps: DataFrame) -> DataFrame:
    """Members of clusters that the hubs left in several components, with tasks in which all that are outside the largest meet all members."""
    wide = BLOCK // MEMBERS  # parts of this round are so many of the first round's
    own = sets.withColumn("salt", F.floor(F.col("salt") / wide).cast("int")).withColumn("parts", F.ceil(F.col("parts") / wide).cast("int"))
    own = own.join(comps, "cid", "left").withColumn("comp", F.coalesce("comp", "cid"))
    count = own.groupBy("root", "comp").agg(F.count("*").alias("n"))
    largest = count.groupBy("root").agg(F.max(F.struct("n", "comp")).alias("top"), F.sum("n").alias("n"), F.count("*").alias("comps")).filter("comps > 1")
    largest = largest.select("root", F.col("top.comp").alias("main"), F.greatest(F.ceil((F.col("n") - F.col("top.n")) / BLOCK), F.lit(1)).cast("int").alias("outer"))
    own = own.join(largest, "root").withColumn("a", F.pmod(F.xxhash64("cid", F.lit(7)), F.col("outer")).cast("int"))
    every = own.withColumn("bi", F.explode(F.sequence(F.lit(0), F.col("outer") - 1))).withColumn("bj", -1 - F.col("salt")).withColumn("salt", F.col("bj"))
    rest = own.filter("comp <> main").withColumn("bi", F.col("a")).withColumn("bj", F.explode(F.sequence(-F.col("parts"), F.lit(-1)))).withColumn("salt", F.col("a"))
    return every.unionByName(rest)


def classed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, sha (of the text), n (shingles), root (the group's number, null if the set is empty) and component_id of each row."""
    rows = stored(signed(docs, id_col, text_col), "minhash-rows")
    classes = rows.filter("n > 0").groupBy("h1", "h2").agg(F.min("id").alias("rep"), F.first("n").alias("n"), F.first("sig").alias("sig"))
    classes = stored(classes.withColumn("cid", F.monotonically_increasing_id()), "minhash-classes")  # numbers that stay as they are written

    keys = keyed(classes)
    buckets = keys.groupBy("key").agg(F.count("*").alias("size"), F.min("cid").alias("low"), F.max("cid").alias("high"), F.sum(F.xxhash64("cid").cast("decimal(20,0)")).alias("mark"))
    buckets = buckets.filter("size > 1").groupBy("size", "low", "high", "mark").agg(F.min("key").alias("key")).select("key", "size")  # one of those with the same members
    held = stored(keys.join(buckets, "key"), "minhash-members")
    members = blocks_of(held.join(classes.select("cid", "n", low_bytes("sig").alias("sig")), "cid"), "key", BLOCK)
    loose = stored(components(grouped(members, "key", ("cid", "n", "salt", "sig"), _close)).select(F.col("v").alias("cid"), "root"), "minhash-clusters")
    consumed(held)

    need = stored(loose.join(classes, "cid").select("cid", "root", "rep", "n", "h1", "h2"), "minhash-need")
    sizes = need.groupBy("root").agg(F.greatest(F.ceil(F.count("*") / MEMBERS), F.ceil(F.sum("n") / ITEMS)).cast("int").alias("parts"))
    places = stored(loose.join(sizes, "root").withColumn("salt", F.pmod(F.xxhash64("cid"), F.col("parts")).cast("int")), "minhash-places")
    found = sets_of(docs, need.drop("root", "n"), id_col, text_col)
    link = lambda dealt: grouped(dealt, "root", ("cid", "salt", "items"), _linked)
    edges = stored(link(round_of_hubs(found.join(places, "cid"))), "minhash-links")
    comps = stored(components(edges), "minhash-comps")
    done = comps.select(F.col("v").alias("cid"), F.col("root").alias("comp"))
    rest = stored(round_of_rest(places.filter("parts > 1"), done).drop("parts", "outer", "a", "main", "comp"), "minhash-rest")
    if not rest.isEmpty():
        some = sets_of(docs, need.join(rest.select("cid").distinct(), "cid", "left_semi").drop("root", "n"), id_col, text_col)
        more = stored(link(rest.join(some, "cid")), "minhash-links")
        comps = stored(components(more.unionByName(comps.selectExpr("v AS a", "root AS b"))), "minhash-comps")

    final = classes.select("cid", "rep", "h1", "h2").join(comps.select(F.col("v").alias("cid"), "root"), "cid", "left").withColumn("root", F.coalesce("root", "cid"))
    lowest = final.groupBy("root").agg(F.min("rep").alias("component_id"))
    final = stored(final.join(lowest, "root").select("h1", "h2", "root", "component_id"), "minhash-final")
    consumed(classes, loose, need, places, rest)
    out = rows.select("id", "sha", "n", "h1", "h2").join(final, ["h1", "h2"], "left")
    return out.select("id", "sha", "n", "root", F.when(F.col("h1").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n_shingles, component_id (the smallest id reachable over links) and kept of each row."""
    out = classed(docs, id_col, text_col)
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def query(spark, sf_dir: str) -> DataFrame:
    """op8: components of near-duplicates among all documents."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: one document of each group; of its rows with the smallest id that with the smallest digest, of repeated rows one.

    Of texts without words each different one stays.
    """
    doc, name = fresh(docs, "k_id", "k_sha")
    rows = classed(docs).filter(F.col("id").eqNullSafe(F.col("component_id")))
    one = rows.filter("root IS NOT NULL").groupBy("root").agg(F.min(F.struct("sha", "id")).alias("r")).select(F.col("r.id").alias(doc), F.col("r.sha").alias(name))
    one = one.unionByName(rows.filter("root IS NULL").select(F.col("id").alias(doc), F.col("sha").alias(name)).distinct())
    own = docs.withColumn(name, text_name("text"))
    return own.join(one.withColumnRenamed(name, name + "_"), F.col("doc_id").eqNullSafe(F.col(doc)) & (F.col(name) == F.col(name + "_")), "left_semi").dropDuplicates(["doc_id", name]).drop(name)
