"""Suffix-array dedup: bytes covered by a string of `span` bytes that starts at two places.

1. Equal texts form a class; if a class of at least `span` bytes has two members, all its bytes go.
2. Windows are the strings of `span` bytes. The key of a window is the smallest hash of the grams
   (span / 5 bytes) in it, so equal windows have equal keys and neighbours mostly share one. Runs of
   windows whose key occurs twice in the corpus go on, each as the text it spans, dealt by key.
3. A task writes every run as strings of symbols: a symbol names span / SYMBOLS bytes exactly (a hash
   brings them together, all bytes are compared, and names of pairs of shorter names stand in where
   different bytes meet), and a run has a string for each residue of its places, so a window is
   SYMBOLS symbols in a row. Equal runs are one string with a multiplicity; symbols that occur once
   end strings.
4. The strings are cut into shards, each with its Burrows-Wheeler transform, and the transforms are
   merged by iterative interleave refinement: an iteration sorts the interleave by one more leading
   symbol, by way of the preceding symbols alone, and a boundary that appears in iteration k is a
   common prefix of k - 1 symbols. No suffix is sorted again.
5. Rows whose common prefixes reach SYMBOLS are a repeated interval; a window is repeated if the
   multiplicities of its interval's rows sum to two or more. That decides, and nothing else does.

A key of any number of runs is dealt in parts of about PART runs. What a part finds twice is settled
there; of every different window in it one goes on to the next round, marked if it is settled, where
keys are of longer grams. The last round's gram is the whole window, so what is equal meets.
For several spans the shorter ones come first: a window repeats only where all shorter ones in it do.

Only names of whole texts are hashes (SHA-256). Keys are 64-bit hashes that bring windows together;
two of one key by chance cost time and change nothing.

Defined results: null or empty texts have no bytes; matches never cross documents; repeated rows are
copies of each other; rows of one id with different texts are texts of their own; ties don't arise,
as all equal windows are treated alike; a very long text is handled alone, with memory of some 60
times its size where its keys are made, its runs in pieces of PIECE windows after that; an empty
table gives an empty result; other columns, of any name, are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import flat, fresh, mix64, per_slice, small_batches, stored, sums, word_starts
from .minhash import powers

#: Bytes of the windows of op7, and of the shorter ones by which passages of PASSAGE_WORDS words are found (pipeline, column flagged).
SPAN, PASSAGE, PASSAGE_WORDS = 400, 200, 50
#: Symbols of a window, and lengths of the keys' grams round by round, in fifths of a window.
SYMBOLS, GRAMS = 4, (1, 3, 4, 5)
#: Bytes of runs in one task and in one call of its merge, symbols in a shard, runs of a key in a part, windows of a run.
TASK_BYTES, POOL_BYTES, SHARD, PART, PIECE = 2 << 20, 1 << 20, 1 << 15, 1000, 1 << 16

_LETTER = np.random.default_rng(23).integers(1, 1 << 63, 256, dtype=np.uint64)


def gram_of(span: int, level: int = 0) -> int:
    """Bytes of a key's gram in a round."""
    return span if level == len(GRAMS) - 1 else max(1, span * GRAMS[level] // GRAMS[-1])


def gram_hashes(data: np.ndarray, size: int) -> np.ndarray:
    """Hash of size bytes from every place that has so many; equal bytes have equal hashes."""
    n = len(data) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    up, down = powers(len(data))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_LETTER[data] * up[: len(data)], dtype=np.uint64)])
    return mix64((total[size:] - total[:n]) * down[:n] + np.uint64(size))


def sliding(x: np.ndarray, width: int, best=np.minimum) -> np.ndarray:
    """Minimum (or maximum) over every window of width values: prefixes and suffixes of blocks."""
    n = len(x) - width + 1
    if n <= 0:
        return x[:0]
    rest = -len(x) % width
    block = np.concatenate([x, np.full(rest, x[-1])]).reshape(-1, width)
    ahead = best.accumulate(block, 1).ravel()
    behind = best.accumulate(block[:, ::-1], 1)[:, ::-1].ravel()
    return best(behind[:n], ahead[width - 1 : width - 1 + n])


def runs(data: np.ndarray, off: np.ndarray, span: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of at most PIECE windows with one key: key, text number, first and last window (as places in data)."""
    key = sliding(gram_hashes(data, gram), span - gram + 1)
    size = np.maximum(np.diff(off) - span + 1, 0)
    doc = np.repeat(np.arange(len(size)), size)
    inner = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    place = inner + np.repeat(off[:-1], size)
    if not len(place):
        return np.zeros(0, np.uint64), doc, place, place
    key = key[place]
    turn = np.flatnonzero((key[1:] != key[:-1]) | (doc[1:] != doc[:-1]) | (inner[1:] % PIECE == 0)) + 1
    first, last = np.concatenate([[0], turn]), np.concatenate([turn, [len(key)]]) - 1
    return key[first], doc[first], place[first], place[last]


def in_order(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in stable order of non-negative numbers, and the numbers in that order."""
    n = len(x)
    bits = np.uint64(max(n, 1).bit_length())
    if n and int(x.max()).bit_length() + int(bits) <= 64:  # value and place in one number sort fastest
        both = (x.astype(np.uint64) << bits) | np.arange(n, dtype=np.uint64)
        both.sort()
        return (both & np.uint64((1 << int(bits)) - 1)).view(np.int64), both >> bits
    order = np.argsort(x, kind="stable")
    return order, x[order]


def dense(x: np.ndarray) -> np.ndarray:
    """Ranks of unsigned values, equal ones alike."""
    if not len(x):
        return np.zeros(0, np.int64)
    order, value = in_order(x)
    out = np.zeros(len(x), np.int64)
    out[order[1:]] = np.cumsum(value[1:] != value[:-1])
    return out


def names(data: np.ndarray, width: int) -> np.ndarray:
    """A number for the width bytes at each place, equal where they are (past the end, bytes count as 0): names of pairs of shorter names."""
    w = min(width, 5)
    wide = np.concatenate([data, np.zeros(w, np.uint8)]).astype(np.uint64)
    x = np.zeros(len(data), np.uint64)
    for k in range(w):
        x = (x << np.uint64(8)) | wide[k : k + len(data)]
    name = dense(x)
    while w < width:
        step = min(w, width - w)
        after = np.concatenate([name[step:] + 1, np.zeros(min(step, len(name)), np.int64)])
        name = dense(name.astype(np.uint64) * np.uint64(len(name) + 2) + after.astype(np.uint64))
        w += step
    return name


def same_bytes(data: np.ndarray, width: int, before: np.ndarray) -> bool:
    """Whether the width bytes at each place are those at before[place], where that is not -1.

    Neighbours that look back equally far share all bytes but one, so only the last of them is compared whole.
    """
    place = np.flatnonzero(before >= 0)
    back = before[place]
    if (data[place] != data[back]).any():
        return False
    last = np.append(before, -1)[place + 1] != back + 1
    place, back = place[last], back[last]
    return not any((data[place + k] != data[back + k]).any() for k in range(1, width))


def names_of(data: np.ndarray, width: int, at: np.ndarray) -> np.ndarray:
    """A number for the width bytes at each place of at (ascending, all within data), equal where they are.

    A hash brings equal bytes together in one sort, then all bytes of a name are compared; if any differ, the
    names are those of pairs.
    """
    if not len(at):
        return np.zeros(0, np.int64)
    bits = np.uint64(len(at).bit_length())
    both = gram_hashes(data, width)[at] >> bits << bits
    both |= np.arange(len(at), dtype=np.uint64)
    both.sort()
    order, value = (both & np.uint64((1 << int(bits)) - 1)).view(np.int64), both >> bits
    new = value[1:] != value[:-1]
    place, before = at[order], np.full(len(data), -1)
    before[place[1:][~new]] = place[:-1][~new]
    if not same_bytes(data, width, before):
        return names(data, width)[at]
    out = np.zeros(len(at), np.int64)
    out[order[1:]] = np.cumsum(new)
    return out


def shard_order(sym: np.ndarray, most: int) -> np.ndarray:
    """Suffixes of strings that end with 0 each, in order of their first `most` symbols or more, by doubling; 0 ends a comparison, ties in order of place."""
    n = len(sym)
    place = np.arange(n)
    ends = np.flatnonzero(sym == 0)
    end = np.repeat(ends, np.diff(ends, prepend=-1))
    longest, h = min(int((end - place).max()) + 1, most), 1
    order, value = in_order(sym)
    rank = np.zeros(n, np.int64)
    rank[order[1:]] = np.cumsum(value[1:] != value[:-1])
    while h < longest and rank[order[-1]] < n - len(ends):
        ahead = place + h
        second = np.where(ahead <= end, rank[np.minimum(ahead, n - 1)] + 1, 0)
        key = rank * (n + 2) + second
        order, value = in_order(key)
        rank = np.zeros(n, np.int64)
        rank[order[1:]] = np.cumsum(value[1:] != value[:-1])
        h *= 2
    return order


def transform(sym: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Symbol before each suffix, 0 before the first of a string."""
    return np.where(order > 0, sym[order - 1], 0)


def merged(bwts: list[np.ndarray], tops: list[int], most: int) -> tuple[np.ndarray, np.ndarray]:
    """Interleave of the transforms' rows and common prefixes.

    tops: strings of each shard, whose empty suffixes are its first rows. Returns, for each merged
    place, the row (counted over the shards one after another) and the common prefix with the place
    before, at most `most`.
    """
    size = np.array([len(b) for b in bwts])
    n = int(size.sum())
    number = np.int32 if n < 1 << 31 else np.int64
    symbols = np.concatenate(bwts).astype(number)
    kind = np.uint8 if len(bwts) < 256 else np.uint16 if len(bwts) < 65536 else np.int32
    shard = np.repeat(np.arange(len(bwts)), size).astype(kind)
    top = np.repeat(np.arange(len(bwts)), tops).astype(kind)
    row, block, lcp, known = np.arange(n), np.zeros(n, number), np.full(n, -1, np.int32), 0
    for k in range(most):
        source, c = (x[len(top) :] for x in in_order(symbols[row]))  # those before a string's first symbol are 0
        old = block[source]
        edge = np.ones(n, bool)
        edge[len(top) + 1 :] = (c[1:] != c[:-1]) | (old[1:] != old[:-1])
        shard = np.concatenate([top, shard[source]])
        row = np.empty(n, np.int64)
        row[np.argsort(shard, kind="stable")] = np.arange(n)
        lcp[edge & (lcp < 0)] = k
        block = np.cumsum(edge, dtype=number)
        if block[-1] in (n, known):
            break
        known = block[-1]
    lcp[lcp < 0] = most
    return row, lcp


def common_prefixes(strings: np.ndarray, most: int, shard: int = SHARD) -> tuple[np.ndarray, np.ndarray]:
    """Places of strings (symbols from 1, each string ended by 0) in order of their first `most` symbols, and the common prefix of each with the one before."""
    ends = np.flatnonzero(strings == 0)
    cuts, at = [0], 0
    while at < len(strings):
        at = int(ends[min(np.searchsorted(ends, at + shard), len(ends) - 1)]) + 1
        cuts.append(at)
    orders, bwts, tops = [], [], []
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        order = shard_order(strings[a:b], most)
        bwts.append(transform(strings[a:b], order))
        tops.append(int((strings[a:b] == 0).sum()))
        orders.append(order + a)
    row, lcp = merged(bwts, tops, most)
    return np.concatenate(orders)[row], lcp


def intervals(data: np.ndarray, off: np.ndarray, times: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray]:
    """Windows of the runs (texts in data, each there so many times) that lie in repeated intervals: their places, and a number for each interval, ordered by both."""
    none = np.zeros(0, np.int64)
    width = span // SYMBOLS
    size, number = np.diff(off), np.arange(len(times))
    first, n = off[:-1] + number, len(data) + len(times)  # a free place after each run ends its strings
    wide = np.zeros(n, np.uint8)
    wide[np.arange(len(data)) + np.repeat(number, size)] = data
    far = np.maximum(size - width + 1, 0)
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, first, 1)
    np.add.at(step, first + far, -1)
    inside = np.cumsum(step[:-1]) > 0
    spots, often = np.flatnonzero(inside), np.repeat(times, size + 1)
    name = names_of(wide, width, spots)
    twice = np.bincount(name, often[spots], 1) > 1
    rows = -(-n // width)
    named = np.zeros(rows * width, np.int64)
    named[spots] = np.where(twice, np.cumsum(twice), 0)[name]  # symbols that occur twice, from 1
    # a string for each residue of the places, all symbols of one a row
    table = np.zeros((width, rows + 1), np.int64)
    table[:, :-1] = named.reshape(rows, width).T
    place = np.full((width, rows + 1), -1)
    place[:, :-1] = np.arange(rows * width).reshape(rows, width).T
    sym, place = table.ravel(), place.ravel()
    stop = np.flatnonzero(sym == 0)
    long = np.diff(np.concatenate([[-1], stop])) - 1
    use = np.repeat(long >= SYMBOLS, long + 1)
    sym, place = sym[use], place[use]
    if not len(sym):
        return none, none
    there = np.zeros(int(sym.max()) + 1, np.int64)
    there[sym] = 1
    there[0] = 0
    sym = np.where(sym > 0, np.cumsum(there)[sym], 0)
    order, lcp = common_prefixes(sym, SYMBOLS)
    ends = np.flatnonzero(sym == 0)
    whole = np.repeat(ends, np.diff(ends, prepend=-1)) - np.arange(len(sym)) >= SYMBOLS
    start = whole[order]  # places with a whole window
    interval = np.cumsum(lcp < SYMBOLS)
    place, interval = place[order][start], interval[start]
    weight = np.bincount(interval, often[place], int(interval.max()) + 1 if len(interval) else 0)
    good = weight[interval] > 1
    place, interval = place[good], interval[good]
    place = np.sort(interval * n + place) - interval * n  # the intervals are in order; within each, places
    return place - np.repeat(number, size + 1)[place], interval


ROWS = pa.schema([("cls", pa.int64()), ("start", pa.int64()), ("stop", pa.int64()), ("key", pa.int64()), ("met", pa.bool_()), ("run", pa.binary())])
_DDL = "cls long, start long, stop long, key long, met boolean, run binary"


def _pooled(batch: pa.RecordBatch, span: int, level: int):
    """Rows of the repeated bytes (cls, start, stop) of whole parts, and of the windows (cls, start, key, met, run) that parts of a split key send on."""
    data, off = flat(batch.column("run"))
    raw, spot = data.tobytes(), {}
    text = np.array([spot.setdefault(raw[a:b], len(spot)) for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)])
    cls, at, met = (np.asarray(batch.column(c)) for c in ("cls", "at", "met"))
    split, key = np.asarray(batch.column("parts")) > 1, np.asarray(batch.column("key"))
    times = np.bincount(text, np.where(met, 2, 1))
    one = b"".join(spot)
    ends = np.concatenate([[0], np.cumsum([len(x) for x in spot])])
    place, interval = intervals(np.frombuffer(one, np.uint8), ends, times, span)

    # covered bytes of each different run, then of each row that has it
    found = np.sort(place)
    if len(found):
        own = np.searchsorted(ends, found, "right") - 1
        turn = np.flatnonzero((own[1:] != own[:-1]) | (found[1:] > found[:-1] + span)) + 1
        first, last = np.concatenate([[0], turn]), np.concatenate([turn, [len(found)]]) - 1
        lines = np.bincount(own[first], minlength=len(ends))
        low = np.cumsum(lines) - lines
        rows = np.flatnonzero(~met & (lines[text] > 0))
        many = lines[text[rows]]
        line = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many) + np.repeat(low[text[rows]], many)
        shift = (at - ends[text])[np.repeat(rows, many)]
        out = (cls[np.repeat(rows, many)], found[first][line] + shift, found[last][line] + span + shift)
        if len(line):
            yield pa.RecordBatch.from_arrays([*map(pa.array, out), *[pa.nulls(len(line), f.type) for f in list(ROWS)[3:]]], schema=ROWS)
    if not split.any():
        return
    # of each different window one goes on: settled ones from the first place of their interval, others from where they are
    row_of = np.zeros(len(spot), np.int64)
    row_of[text[::-1]] = np.arange(len(text))[::-1]
    size = np.maximum(np.diff(ends) - span + 1, 0)
    window = np.zeros(len(one), bool)
    window[np.arange(int(size.sum())) + np.repeat(ends[:-1] - (np.cumsum(size) - size), size)] = True
    run = np.repeat(np.arange(len(spot)), np.diff(ends))
    window &= split[row_of][run]
    settled = np.zeros(len(one), bool)
    settled[place] = True
    window[place[1:][interval[1:] == interval[:-1]]] = False
    settled |= met[row_of][run]
    spots = np.flatnonzero(window)
    turn = np.flatnonzero((spots[1:] != spots[:-1] + 1) | (run[spots[1:]] != run[spots[:-1]]) | (settled[spots[1:]] != settled[spots[:-1]])) + 1
    first, last = spots[np.concatenate([[0], turn])] if len(spots) else spots, spots[np.concatenate([turn, [len(spots)]]) - 1] if len(spots) else spots
    pieces = [one[a : b + span] for a, b in zip(first.tolist(), last.tolist(), strict=True)]
    if not pieces:
        return
    bounds = np.concatenate([[0], np.cumsum([len(x) for x in pieces])])
    whole = b"".join(pieces)
    k, piece, a, b = runs(np.frombuffer(whole, np.uint8), bounds, span, gram_of(span, level + 1))
    row = row_of[run[first[piece]]]
    new = mix64(k ^ mix64(key[row].view(np.uint64))).view(np.int64)
    begin = at[row] + (first - ends[run[first]])[piece] + a - bounds[piece]
    out = [pa.array(cls[row]), pa.array(begin), pa.nulls(len(k), pa.int64()), pa.array(new), pa.array(settled[first[piece]]), pa.array([whole[x : y + span] for x, y in zip(a.tolist(), b.tolist(), strict=True)], pa.binary())]
    yield pa.RecordBatch.from_arrays(out, schema=ROWS)


def _judged(dealt: DataFrame, span: int, level: int, parts: int) -> DataFrame:
    """Rows of _pooled over rows of key, part, parts, cls, at, met, run."""

    def run(batches):
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held)
        del held
        key, part = np.asarray(table.column("key")), np.asarray(table.column("part"))
        order = np.lexsort((part, key))
        key, part = key[order], part[order]
        size = np.cumsum(np.asarray(pc.binary_length(table.column("run"))).astype(np.int64)[order])
        ends = np.append(np.flatnonzero((key[1:] != key[:-1]) | (part[1:] != part[:-1])) + 1, len(key))
        start = 0
        while start < len(key):  # whole parts, near POOL_BYTES at once
            before = size[start - 1] if start else 0
            reach = int(np.searchsorted(size, before + POOL_BYTES))
            stop = int(ends[min(np.searchsorted(ends, max(reach, start + 1)), len(ends) - 1)])
            yield from _pooled(table.take(order[start:stop]).combine_chunks().to_batches()[0], span, level)
            start = stop

    return dealt.repartition(parts, "key", "part").mapInArrow(run, _DDL)


def keys_of(data: np.ndarray, off: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Different keys of the windows of each text, the number of places where each one's gram is (no fewer than its runs), and text numbers."""
    gram = gram_of(span)
    grams = gram_hashes(data, gram)
    width = span - gram + 1
    low = sliding(grams, width)
    whole = np.repeat(off[1:], np.diff(off))[: len(low)] >= np.arange(len(low)) + span
    pad = np.zeros(width - 1, np.uint64)
    high = sliding(np.concatenate([pad, np.where(whole, low, np.uint64(0)), pad]), width, np.maximum)
    place = np.flatnonzero(grams[: len(high)] == high) if len(low) else np.zeros(0, np.int64)
    key, doc = grams[place], np.searchsorted(off, place, "right") - 1
    order = np.lexsort((key, doc))
    key, doc = key[order], doc[order]
    first = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])])) if len(key) else place
    return key[first], np.diff(np.append(first, len(key))), doc[first]


def _lists(data: np.ndarray, off: np.ndarray, span: int) -> dict:
    """Columns keys and times, lists for each text."""
    key, times, doc = keys_of(data, off, span)
    ends = pa.array(np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=len(off) - 1))]), pa.int32())
    return {"keys": pa.ListArray.from_arrays(ends, pa.array(key.view(np.int64))), "times": pa.ListArray.from_arrays(ends, pa.array(times, pa.int32()))}


def _shared(keyed: DataFrame) -> DataFrame:
    """cls, base, found (key and the number of its runs) of the texts that have keys with two runs; keyed has cls, base, keys and times."""
    each = keyed.select("cls", "base", F.explode(F.arrays_zip("keys", "times")).alias("k")).select("cls", "base", F.col("k.keys").alias("key"), F.col("k.times").alias("c"))
    twice = stored(each.groupBy("key").agg(F.sum("c").alias("n")).filter("n > 1"), "suffix-keys")  # stored, so that Spark can split a hot key's rows in the join
    return each.drop("c").join(twice, "key").groupBy("cls", "base").agg(F.collect_list(F.struct("key", "n")).alias("found"))


def _dealt(texts: DataFrame, span: int) -> DataFrame:
    """key, part, parts, cls, at, met and run of every run whose key is in found."""

    def kernel(batch: pa.RecordBatch) -> dict:
        data, off = flat(batch.column("text"))
        key, doc, first, last = runs(data, off, span, gram_of(span))
        raw, cls, base = data.tobytes(), np.asarray(batch.column("cls")), np.asarray(batch.column("base"))
        found = batch.column("found").combine_chunks() if isinstance(batch.column("found"), pa.ChunkedArray) else batch.column("found")
        owner = np.repeat(np.arange(batch.num_rows), np.asarray(found.value_lengths()))
        listed = {(d, k): n for d, k, n in zip(owner.tolist(), found.flatten().field("key").to_pylist(), found.flatten().field("n").to_pylist(), strict=True)}
        n = np.array([listed.get(x, 0) for x in zip(doc.tolist(), key.view(np.int64).tolist(), strict=True)], np.int64)
        use = n > 0
        key, doc, first, last, n = key[use], doc[use], first[use], last[use], n[use]
        at = base[doc] + first - off[doc]
        parts = -(-n // PART)
        part = (mix64((cls[doc] * 0x9E3779B1 + at).astype(np.uint64)) % np.maximum(parts, 1).astype(np.uint64)).astype(np.int64)
        text = pa.array([raw[a : b + span] for a, b in zip(first.tolist(), last.tolist(), strict=True)], pa.binary())
        return {"key": key.view(np.int64), "part": part, "parts": parts, "cls": cls[doc], "at": at, "met": np.zeros(len(key), bool), "run": text}

    return per_slice(texts, "text", kernel, "key long, part int, parts int, cls long, at long, met boolean, run binary", 1 << 20)


def repeated_windows(texts: DataFrame, span: int) -> DataFrame:
    """cls, start and stop of bytes covered by repeated windows of texts (cls, base, text, found)."""
    least = texts.sparkSession.sparkContext.defaultParallelism
    total = texts.select(F.sum(F.size("found"))).first()[0] or 0
    dealt, hits = _dealt(texts, span), []
    for level in range(len(GRAMS)):
        out = stored(_judged(dealt, span, level, max(least, int(total * 3 * span // 2 // TASK_BYTES) + 1)), f"suffix-hits-{span}-{level}")
        hits.append(out.filter("run IS NULL").select("cls", "start", "stop"))
        if level == len(GRAMS) - 1:
            break
        on = out.filter("run IS NOT NULL").select("key", "cls", F.col("start").alias("at"), "met", "run")
        total = on.count()
        if not total:
            break
        sizes = stored(on.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1"), "suffix-keys")
        parts = F.lit(1) if level + 1 == len(GRAMS) - 1 else F.ceil(F.col("n") / PART)
        dealt = on.join(sizes, "key").withColumn("parts", parts.cast("int")).withColumn("part", F.pmod(F.xxhash64("cls", "at"), F.col("parts")).cast("int")).drop("n")
    found = hits[0]
    for more in hits[1:]:
        found = found.unionByName(more)
    return found


def joined_parts(parts: list[tuple[int, int]]) -> list[list[int]]:
    """Overlapping or touching parts as one each, in order."""
    whole: list[list[int]] = []
    for s, e in sorted(parts):
        if whole and s <= whole[-1][1]:
            whole[-1][1] = max(whole[-1][1], e)
        else:
            whole.append([s, e])
    return whole


def _covered(found: DataFrame) -> DataFrame:
    return found.groupBy("cls").agg(F.collect_list(F.struct("start", "stop")).alias("parts"))


def _segments(texts: DataFrame, found: DataFrame, span: int) -> DataFrame:
    """cls, base and text of the covered parts of at least span bytes, with their keys."""

    def kernel(batch: pa.RecordBatch) -> dict:
        data, off = flat(batch.column("text"))
        raw, out = data.tobytes(), []
        cls, base = batch.column("cls").to_pylist(), batch.column("base").to_pylist()
        for a, z, c, b, parts in zip(off[:-1].tolist(), off[1:].tolist(), cls, base, batch.column("parts").to_pylist(), strict=True):
            inner = [(p["start"], p["stop"]) for p in parts if b <= p["start"] and p["stop"] <= b + z - a]
            out += [(c, s, raw[a + s - b : a + e - b]) for s, e in joined_parts(inner) if e - s >= span]
        data, off = flat(pa.array([x[2] for x in out], pa.large_binary()))
        return {"cls": [x[0] for x in out], "base": [x[1] for x in out], "text": pa.array([x[2] for x in out], pa.binary())} | _lists(data, off, span)

    return per_slice(texts.select("cls", "base", "text").join(_covered(found), "cls"), "text", kernel, "cls long, base long, text binary, keys array<long>, times array<int>", 1 << 20)


_FOUND = "array<struct<span:int,runs:array<bigint>,words:array<bigint>,kept:string>>"


def _cut(texts: DataFrame, found: DataFrame) -> DataFrame:
    """cls and found of each class: for each span the runs (flat: start, stop, ...), their words, and the digest of what is left."""
    per = found.groupBy("cls").agg(F.collect_list(F.struct("span", "start", "stop")).alias("parts"))

    def kernel(batch: pa.RecordBatch) -> dict:
        data, off = flat(batch.column("text"))
        raw, rows = data.tobytes(), []
        begins = np.concatenate([[0], np.cumsum(word_starts(data, off))])
        for a, b, parts in zip(off[:-1].tolist(), off[1:].tolist(), batch.column("parts").to_pylist(), strict=True):
            row = []
            for span in sorted({p["span"] for p in parts}):
                whole = joined_parts([(p["start"], p["stop"]) for p in parts if p["span"] == span])
                left, at = hashlib.sha256(), a
                for s, e in whole:
                    left.update(raw[at : a + s])
                    at = a + e
                left.update(raw[at:b])
                row.append({"span": span, "runs": [x for pair in whole for x in pair], "words": [int(begins[a + e] - begins[a + s]) for s, e in whole], "kept": left.hexdigest()})
            rows.append(row)
        kind = pa.list_(pa.struct([("span", pa.int32()), ("runs", pa.list_(pa.int64())), ("words", pa.list_(pa.int64())), ("kept", pa.string())]))
        return {"cls": batch.column("cls"), "found": pa.array(rows, kind)}

    return per_slice(texts.select("cls", "text").join(per, "cls"), "text", kernel, f"cls long, found {_FOUND}")


def _summary(docs: DataFrame, id_col: str, text_col: str, span: int) -> DataFrame:
    """id, n_bytes, n_words, sha, and keys and times (of its windows) of each row."""
    kind = docs.schema[id_col].dataType.simpleString()

    def kernel(batch: pa.RecordBatch) -> dict:
        data, off = flat(batch.column("text"))
        raw = data.tobytes()
        sha = [hashlib.sha256(raw[a:b]).digest() for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]
        return {"id": batch.column("id"), "n_bytes": np.diff(off), "n_words": sums(word_starts(data, off), off), "sha": sha} | _lists(data, off, span)

    return per_slice(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), "text", kernel, f"id {kind}, n_bytes long, n_words long, sha binary, keys array<long>, times array<int>", 1 << 20)


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", spans: tuple[int, ...] = (SPAN,)) -> DataFrame:
    """id_col, sha, n_bytes and found of each row.

    found has, for each of spans (multiples of SYMBOLS) with repeats, the span, the maximal runs of
    covered bytes (flat: start, stop, ...), the words that begin in each, and the digest of the bytes left.
    """
    spans = sorted(spans)
    rows = stored(_summary(docs, id_col, text_col, spans[0]), "suffix-rows")
    classes = rows.groupBy("sha").agg(F.count("*").alias("copies"), F.min("id").alias("rep"), F.first("n_bytes").alias("n_bytes"), F.first("n_words").alias("n_words"), F.first("keys").alias("keys"), F.first("times").alias("times"))
    classes = stored(classes.filter(f"n_bytes >= {spans[0]}").withColumn("cls", F.monotonically_increasing_id()), "suffix-classes")  # numbers that stay as they are written
    found = _shared(classes.withColumn("base", F.lit(0).cast("long")))
    found = stored(found.join(classes.select("cls", "sha", "copies", "rep"), "cls"), "suffix-found")

    named = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    texts = named.join(found, F.col("id").eqNullSafe(F.col("rep"))).filter(F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)) == F.col("sha"))
    texts = stored(texts.drop("id", "rep", "sha").dropDuplicates(["cls"]), "suffix-texts")

    hits, parts = [], texts
    for k, span in enumerate(spans):
        if k:  # a repeated window lies where all shorter ones are repeated
            parts = stored(_segments(parts, hits[-1].drop("span"), span), f"suffix-segments-{span}")
            parts = stored(parts.select("cls", "base", "text").join(_shared(parts), ["cls", "base"]), f"suffix-texts-{span}")
        hits.append(repeated_windows(parts.select("cls", "base", "text", "found"), span).withColumn("span", F.lit(span)))
    every = hits[0]
    for more in hits[1:]:
        every = every.unionByName(more)
    cut = _cut(texts.filter("copies = 1"), every)
    entire = F.array(*[F.struct(F.lit(s).alias("span"), F.array(F.lit(0).cast("long"), F.col("n_bytes")).alias("runs"), F.array("n_words").alias("words"), F.sha2(F.lit(""), 256).alias("kept")) for s in spans])
    whole = classes.filter("copies > 1").select("cls", F.filter(entire, lambda x: x.span <= F.col("n_bytes")).cast(_FOUND).alias("found"))
    done = stored(cut.unionByName(whole).join(classes.select("cls", "sha"), "cls").drop("cls"), "suffix-done")
    out = rows.select("id", "sha", "n_bytes").join(done, "sha", "left")
    return out.select(F.col("id").alias(id_col), "sha", "n_bytes", F.coalesce("found", F.expr(f"cast(array() as {_FOUND})")).alias("found"))


def _of(span: int, field: str):
    """A field of found for one span, null if it has none."""
    return F.get(F.filter("found", lambda x: x.span == span), F.lit(0)).getField(field)


def query(spark, sf_dir: str) -> DataFrame:
    """op7: repeated bytes of all documents; flagged if a passage of PASSAGE_WORDS words or more repeats, be it shorter than SPAN bytes."""
    out = repeated_spans(spark.read.parquet(f"{sf_dir}/documents.parquet"), spans=(PASSAGE, SPAN))
    out = out.select("doc_id", "sha", "n_bytes", _of(SPAN, "runs").alias("runs"), _of(SPAN, "kept").alias("kept"), F.coalesce(F.exists(_of(PASSAGE, "words"), lambda w: w >= PASSAGE_WORDS), F.lit(False)).alias("flagged"))
    removed = F.expr("aggregate(runs, 0L, (a, x) -> x - a)")  # stops less starts, as they alternate
    return out.select(
        "doc_id", "n_bytes", F.coalesce(removed, F.lit(0).cast("long")).alias("n_removed"), F.coalesce((F.size("runs") / 2).cast("long"), F.lit(0).cast("long")).alias("n_spans"),
        F.coalesce("kept", F.lower(F.hex("sha"))).alias("kept_sha256"), "flagged",
    )


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: texts without the passages of PASSAGE_WORDS words or more that repeat (found by windows of PASSAGE bytes); documents of which nothing is left go."""
    doc, name, cuts, words = fresh(docs, "k_id", "k_sha", "k_spans", "k_words")
    found = repeated_spans(docs, spans=(PASSAGE,)).select(F.col("doc_id").alias(doc), F.col("sha").alias(name), _of(PASSAGE, "runs").alias(cuts), _of(PASSAGE, "words").alias(words))
    found = found.filter(F.exists(words, lambda w: w >= PASSAGE_WORDS)).dropDuplicates([doc, name])
    own = F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256))
    rows = docs.join(found, F.col("doc_id").eqNullSafe(F.col(doc)) & (own == F.col(name)), "left")
    columns, schema = docs.columns, docs.schema
    small_batches(spark)

    def run(batches):
        for batch in batches:
            data, off = flat(batch.column("text"))
            raw, new = data.tobytes(), []
            for a, b, spans, sizes in zip(off[:-1].tolist(), off[1:].tolist(), batch.column(cuts).to_pylist(), batch.column(words).to_pylist(), strict=True):
                text, left, at = raw[a:b], [], 0
                for s, e, n in zip((spans or [])[::2], (spans or [])[1::2], sizes or [], strict=True):
                    if n >= PASSAGE_WORDS:
                        left.append(text[at:s])
                        at = e
                new.append(b"".join([*left, text[at:]]).decode("utf-8", "ignore"))
            cols = {c: batch.column(c) for c in columns} | {"text": pa.array(new, pa.string())}
            if "n_chars" in cols:
                cols["n_chars"] = pa.array([len(x) for x in new], batch.column("n_chars").type)
            keep = pa.array([bool(x) for x in new])
            yield pa.RecordBatch.from_arrays([cols[c].filter(keep) for c in columns], columns)

    return rows.select(*[f"`{c}`" for c in columns], cuts, words).mapInArrow(run, schema)
