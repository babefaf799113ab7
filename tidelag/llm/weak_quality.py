"""Quality classifier from weak labels.

Overlapping heuristics vote good, bad or abstain on each text. Votes of all documents are
counted by pattern (at most 3 ** labellers of them), expectation-maximisation on the patterns
estimates the share of good texts and how often each labeller votes what on either class, and
the posteriors of a bounded sample train a linear scorer over hashed word shapes and
statistics, which then scores every document.

Defined results: a null or empty text has no words and is scored like any other; repeated rows
are scored each; a score at the cut is kept; a very long text is one row of its batch, its features its
different word shapes; an empty table gives an empty result; other columns of any name are ignored.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import flat, hash_below, per_slice, stored, sums
from .quality_rules import SYMBOLS, counts

#: Frequent short words of the corpus languages.
COMMON = frozenset("the of and to a in is that for it with as was on are be this by or an from at el la de que y en los las un una por con para del le les des et est dans pour du der die das und ist von mit den ein eine zu im nicht auf".split())
#: The labellers, in the order of their votes.
LABELLERS = ("symbols", "symbol_words", "odd", "repeats", "lines", "variety", "word_length", "capitals", "shouting", "caps_words", "common", "length")
BUCKETS = 1 << 12
#: Rows that the scorer is trained on, at most.
SAMPLE = 8192
_SHAPE = re.compile(r"[a-zß-öø-ÿ]+|[A-ZÀ-ÖØ-Þ]+|[0-9]+")


def measured(batch: pa.RecordBatch) -> dict[str, np.ndarray]:
    """Statistics of each text that labellers and scorer use."""
    data, off = flat(batch.column("text"))
    base = {k: np.asarray(v, float) for k, v in counts(batch).items()}
    upper, lower = (sums((data >= a) & (data <= b), off).astype(float) for a, b in ((65, 90), (97, 122)))
    shout, lines = sums(data == 33, off).astype(float), sums(data == 10, off) + 1.0
    odd = sums(_ODD[data], off).astype(float)
    raw, common, kinds, marked, caps = data.tobytes(), [], [], [], []
    for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True):
        words = raw[a:b].split()
        common.append(sum(w.lower().strip(b".,!?") in _COMMON for w in words))
        kinds.append(len({w.lower() for w in words}))
        marked.append(sum(len(w.translate(None, _MARKS)) < len(w) for w in words))
        caps.append(sum(w.isupper() for w in words))
    n = np.maximum(base["n_words"], 1)
    return {
        "n": base["n_words"], "symbols": base["n_symbols"] / np.maximum(base["word_chars"], 1), "repeats": base["n_repeat_words"] / n, "lines": base["n_dup_lines"] / lines,
        "word_length": base["word_chars"] / n, "capitals": upper / np.maximum(upper + lower, 1), "common": np.array(common) / n, "shouting": shout / n, "variety": np.array(kinds) / n,
        "odd": odd / np.maximum(base["word_chars"], 1), "symbol_words": np.array(marked) / n, "caps_words": np.array(caps) / n,
    }


_COMMON = frozenset(w.encode() for w in COMMON)
_MARKS = SYMBOLS.encode()
_ODD = np.zeros(256, bool)
_ODD[[c for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in ".,;:'\"?!-()"]] = True


def votes(m: dict[str, np.ndarray]) -> np.ndarray:
    """A row of votes for each text: 2 good, 1 bad, 0 abstain."""
    n = m["n"]

    def vote(bad, good=None):
        return np.where(bad, 1, 0 if good is None else np.where(good, 2, 0))

    some = n >= 50
    return np.stack([
        vote(m["symbols"] > 0.02), vote(m["symbol_words"] > 0.1), vote(m["odd"] > 0.03), vote(m["repeats"] > 0.4), vote(m["lines"] > 0.3), vote((m["variety"] < 0.25) & some),
        vote((m["word_length"] < 2.5) | (m["word_length"] > 12)), vote(m["capitals"] > 0.5), vote(m["shouting"] > 0.2), vote(m["caps_words"] > 0.5), vote((m["common"] < 0.04) & (n >= 30), m["common"] > 0.12), vote(n < 20, n >= 60),
    ], 1)


def expectation_maximisation(pattern: np.ndarray, count: np.ndarray, rounds: int = 200) -> tuple[np.ndarray, float, np.ndarray]:
    """Posterior of good for each vote pattern, share of good, and vote rates [labeller, class, vote]."""
    if not len(pattern):
        return np.zeros(0), 0.8, np.zeros((0, 2, 3))
    k = pattern.shape[1]
    rate = np.tile(np.array([[0.3, 0.5, 0.2], [0.3, 0.1, 0.6]]), (k, 1, 1))  # bad, good: labellers start better than chance
    share, post = 0.8, np.full(len(pattern), 0.8)
    for _ in range(rounds):
        like = [np.log(rate[np.arange(k), c, pattern]).sum(1) for c in (0, 1)]
        new = 1 / (1 + np.exp(np.clip(like[0] + np.log(1 - share) - like[1] - np.log(share), -500, 500)))
        done = np.abs(new - post).max() < 1e-9
        post = new
        share = float(np.clip((count * post).sum() / count.sum(), 1e-3, 1 - 1e-3))
        for v in range(3):
            for c, w in ((0, 1 - post), (1, post)):
                rate[:, c, v] = ((count * w)[:, None] * (pattern == v)).sum(0) + 0.5
        rate /= rate.sum(2, keepdims=True)
        rate[:, 1, 1] = np.minimum(rate[:, 1, 1], rate[:, 0, 1])  # no labeller votes bad more often on good texts
        rate /= rate.sum(2, keepdims=True)
        if done:
            break
    return post, share, rate


_shapes: dict[bytes, int] = {}


def shape_of(word: bytes) -> int:
    """Bucket of a word's shape: runs of lower-case, capital letters and digits, other characters as they are."""
    got = _shapes.get(word)
    if got is None:
        if len(_shapes) > 400_000:
            _shapes.clear()
        text = word.decode("utf-8", "replace")
        kind = _SHAPE.sub(lambda m: "a" if m[0][0].islower() else "A" if m[0][0].isupper() else "0", text)
        got = _shapes[word] = hashed(kind)
    return got


def hashed(text: str) -> int:
    import zlib

    return zlib.crc32(text.encode()) % BUCKETS


def stepped(name: str, level: np.ndarray) -> np.ndarray:
    """Bucket of each level of a statistic."""
    levels, back = np.unique(level, return_inverse=True)
    return np.array([hashed(f"{name}={v}") for v in levels.tolist()], np.int64)[back]


def features(batch: pa.RecordBatch, m: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, bucket and value of the hashed features: shares of word shapes, and each statistic in steps."""
    data, off = flat(batch.column("text"))
    raw, rows, shapes = data.tobytes(), [], []
    for i, (a, b) in enumerate(zip(off[:-1].tolist(), off[1:].tolist(), strict=True)):
        got = [shape_of(w) for w in raw[a:b].split()]
        shapes += got
        rows += [i] * len(got)
    cell, n = np.unique(np.array(rows, np.int64) * BUCKETS + np.array(shapes, np.int64), return_counts=True)
    row = cell // BUCKETS
    value = np.sqrt(n / np.maximum(m["n"], 1)[row])
    steps = {"symbols": 50, "repeats": 10, "lines": 10, "word_length": 1, "capitals": 10, "common": 25, "shouting": 20, "variety": 10}
    own_rows, own, one = [row], [cell % BUCKETS], [value]
    every = np.arange(len(m["n"]))
    for name, scale in steps.items():
        own_rows.append(every)
        own.append(stepped(name, np.floor(m[name] * scale).astype(int)))
        one.append(np.ones(len(every)))
    own_rows.append(every)
    own.append(stepped("n", np.log2(m["n"] + 1).astype(int)))
    one.append(np.ones(len(every)))
    return np.concatenate(own_rows), np.concatenate(own), np.concatenate(one)


def fitted(row: np.ndarray, bucket: np.ndarray, value: np.ndarray, target: np.ndarray, rounds: int = 300, ridge: float = 1e-4) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic scorer by accelerated gradient descent on soft targets."""
    n = len(target)
    w = np.zeros(BUCKETS)
    mean = float(np.clip(target.mean() if n else 0.8, 0.01, 0.99))
    bias = float(np.log(mean / (1 - mean)))
    ahead, ahead_bias, step = w.copy(), bias, 0.5
    for k in range(rounds if n else 0):
        score = np.bincount(row, ahead[bucket] * value, n) + ahead_bias
        off = 1 / (1 + np.exp(-np.clip(score, -30, 30))) - target
        new = ahead - step * (np.bincount(bucket, off[row] * value, BUCKETS) / n + ridge * ahead)
        new_bias = ahead_bias - step * off.mean()
        move = k / (k + 3)
        ahead, ahead_bias = new + move * (new - w), new_bias + move * (new_bias - bias)
        w, bias = new, new_bias
    return w, bias


def scored(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE, cut: float = 0.3) -> DataFrame:
    """id_col, label (the weak posterior of good), score (of the trained scorer) and kept of each row.

    The `sample` different texts with the smallest hashes train the scorer, each once however many copies it
    has (texts whose hashes tie count as one); no more than that many rows of features go to the driver, on any run the same.
    A document goes only if bad is clearly the likelier, hence a cut below one half.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    power = 3 ** np.arange(len(LABELLERS))

    def kernel(batch: pa.RecordBatch) -> dict:
        m = measured(batch)
        row, bucket, value = features(batch, m)
        order = np.argsort(row, kind="stable")
        ends = pa.array(np.concatenate([[0], np.cumsum(np.bincount(row, minlength=batch.num_rows))]), pa.int32())
        lists = [pa.ListArray.from_arrays(ends, x) for x in (pa.array(bucket[order], pa.int16()), pa.array(value[order], pa.float32()))]
        return {"id": batch.column("id"), "h": batch.column("h"), "pattern": votes(m) @ power, "buckets": lists[0], "weights": lists[1]}

    rows = stored(per_slice(texts.withColumn("h", F.xxhash64("text")), "text", kernel, f"id {kind}, h long, pattern int, buckets array<smallint>, weights array<float>"), "weak-rows")
    seen = rows.groupBy("pattern").count().collect()  # at most 3 ** labellers rows
    code = np.array([r.pattern for r in seen], np.int64)
    pattern = (code[:, None] // power) % 3
    post, _, _ = expectation_maximisation(pattern, np.array([r["count"] for r in seen], float))
    of = dict(zip(code.tolist(), post.tolist(), strict=True))

    different = rows.agg(F.approx_count_distinct("h", 0.02)).first()[0]
    some = rows.filter(hash_below("h", min(1.0, 1.5 * (sample + 100) / max(different, 1))))  # more than enough, so that few are sorted
    some = some.dropDuplicates(["h"]).orderBy("h")
    picked = some.limit(sample).select("pattern", "buckets", "weights").toPandas()
    size = [len(x) for x in picked["buckets"]]
    flat_of = lambda c: np.concatenate([np.asarray(x, float) for x in picked[c]]) if len(picked) else np.zeros(0)
    w, bias = fitted(np.repeat(np.arange(len(picked)), size), flat_of("buckets").astype(np.int64), flat_of("weights"), np.array([of[p] for p in picked["pattern"]]))

    def score(batches):
        for batch in batches:
            lists = batch.column("buckets")
            ends = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)
            part = w[np.asarray(lists.flatten()).astype(np.int64)] * np.asarray(batch.column("weights").flatten())
            total = np.concatenate([[0], np.cumsum(part)])
            s = 1 / (1 + np.exp(-np.clip(total[ends[1:]] - total[ends[:-1]] + bias, -30, 30)))
            label = [of[p] for p in batch.column("pattern").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(label, pa.float64()), pa.array(s)], ["id", "label", "score"])

    out = rows.select("id", "pattern", "buckets", "weights").mapInArrow(score, f"id {kind}, label double, score double")
    return out.select(F.col("id").alias(id_col), "label", "score", (F.col("score") >= cut).alias("kept"))


def query(spark, sf_dir: str) -> DataFrame:
    """op3: quality score of every document."""
    return scored(spark.read.parquet(f"{sf_dir}/documents.parquet"))
