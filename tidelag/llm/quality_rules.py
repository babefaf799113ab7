"""Quality rules: base counts of a text, then robust multivariate outliers per language and source.

For each language and source the minimum covariance determinant is sought by
concentration steps from two deterministic starts (coordinatewise median and MAD,
and the correlation of tanh-transformed coordinates). Every step is an aggregation over
all rows of the group: a quantile of the squared distances (to within 1 / 2000 of the
ranks), then mean and covariance of the rows within it, until the determinants settle. A document is rejected when the squared Mahalanobis distance of its
transformed statistics, after one reweighting step, exceeds a chi-square limit.

Defined results: a null or empty text has no words and fails the base rules; null
languages and sources are groups of their own; groups of under MIN_GROUP rows are pooled
by language, then over the corpus, and a pool still smaller rejects nothing; repeated rows
are judged each; distances that tie with the cut of a step are all within it; a distance at the limit is
kept; a very long text is counted alone and whole; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE, flat, fresh, per_slice, stored, sums, text_name, word_starts

#: The characters that count as symbols.
SYMBOLS = "#*$%&|<>"
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(SYMBOLS.encode())] = True

MIN_GROUP = 40
#: Share of a group's rows that the estimate covers, concentration steps at most, and the change of all log-determinants at which they end.
COVER, STEPS, SETTLED = 0.75, 12, 1e-3
#: Standard deviations below which differences of a statistic don't matter (keeps covariances regular).
FLOOR = (0.08, 0.04, 0.12, 0.2)
#: Chi-square quantiles with 4 degrees of freedom at 0.975 and 1 - 3e-7.
CHI = {0.975: 11.1433, "reject": 36.0}
D = 4


def counts(batch: pa.RecordBatch) -> dict:
    """Base statistics of each text in the batch."""
    data, off = flat(batch.column("text"))
    solid = ~SPACE[data]
    n_words = sums(word_starts(data, off), off)
    out = {"n_words": n_words, "word_chars": sums(solid & ((data & 0xC0) != 0x80), off), "n_symbols": sums(_SYMBOL[data], off)}
    raw = data.tobytes()
    ids: dict[bytes, int] = {}
    words, dups = [], []
    for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True):
        text = raw[a:b]
        words += [ids.setdefault(w, len(ids)) for w in text.split()]
        lines = text.split(b"\n")
        if len(lines) > 1:
            lines = [x for x in lines if x.split(None, 1)]
        dups.append(len(lines) - len(set(lines)) if len(lines) > 1 else 0)
    out["n_dup_lines"] = dups
    out["n_repeat_words"] = repeated_words(np.array(words, np.int64), n_words, len(ids))
    return out


def repeated_words(word: np.ndarray, n_words: np.ndarray, distinct: int) -> np.ndarray:
    """Words of each text that lie in a 3-word window found twice or more in that text."""
    doc = np.repeat(np.arange(len(n_words)), n_words)
    if len(word) < 3:
        return np.zeros(len(n_words), np.int64)
    pair = word[:-1] * distinct + word[1:]
    if distinct >= 1 << 20:
        pair = np.unique(pair, return_inverse=True)[1].astype(np.int64)
    window = pair[:-1] * distinct + word[2:]
    whole = np.flatnonzero(doc[2:] == doc[:-2])
    order = whole[np.argsort(window[whole], kind="stable")]
    same = (window[order][1:] == window[order][:-1]) & (doc[order][1:] == doc[order][:-1])
    again = order[np.concatenate([same, [False]]) | np.concatenate([[False], same])] if len(order) else order
    cover = np.zeros(len(word), bool)
    for k in range(3):
        cover[again + k] = True
    return np.bincount(doc, cover, len(n_words)).astype(np.int64)


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """id, sha (of the text), lang, source and the base counts of every row."""
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), text_name(text_col).alias("sha"), F.col(lang_col).cast("string").alias("lang"), F.col(source_col).cast("string").alias("source"), F.col(text_col).alias("text"))
    kernel = lambda b: {c: b.column(c) for c in ("id", "sha", "lang", "source")} | counts(b)
    return per_slice(rows, "text", kernel, f"id {kind}, sha binary, lang string, source string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long")


def vector() -> list:
    """The transformed statistics of a row that passed the base rules: word length, symbols, repeated lines, repeated words.

    Each can pass the limit alone: half the words repeated is 50 in a group without any.
    """
    n = F.greatest("n_words", F.lit(1)).cast("double")
    return [F.log(F.greatest("word_chars", F.lit(1)) / n), F.sqrt(F.col("n_symbols") / F.greatest("word_chars", F.lit(1))), F.sqrt(10.0 * F.col("n_dup_lines") / n), F.sqrt(4.0 * F.col("n_repeat_words") / n)]


def _distance(x: list[str], mean: str, inv: str):
    """Squared Mahalanobis distance as an expression over array columns mean (D) and inv (D*D)."""
    diff = [F.col(x[i]) - F.col(mean)[i] for i in range(D)]
    return sum(diff[i] * diff[j] * F.col(inv)[i * D + j] * (1 if i == j else 2) for i in range(D) for j in range(i, D))


def _moments(x: list[str]) -> list:
    return [F.count("*").alias("n"), *[F.avg(c).alias(f"m{i}") for i, c in enumerate(x)], *[F.avg(F.col(x[i]) * F.col(x[j])).alias(f"s{i}{j}") for i in range(D) for j in range(i, D)]]


def _cov(r) -> tuple[np.ndarray, np.ndarray]:
    mean = np.array([r[f"m{i}"] for i in range(D)])
    cov = np.array([[r[f"s{min(i, j)}{max(i, j)}"] for j in range(D)] for i in range(D)]) - np.outer(mean, mean)
    return mean, (cov + cov.T) / 2


def estimates(rows: DataFrame, x: list[str], key: str, steps: int = STEPS) -> dict:
    """Mean and inverse covariance of each group, by key; one row per group and start goes to the driver."""
    spark, floor = rows.sparkSession, np.diag(np.square(FLOOR))
    first = rows.groupBy(key).agg(F.count("*").alias("n"), *[F.percentile_approx(c, 0.5, 2000).alias(f"m{i}") for i, c in enumerate(x)]).collect()

    def joined(params: dict) -> DataFrame:
        """Rows with mean and inv of each start; params: (key, start) to (mean, inv)."""
        table = spark.createDataFrame([(k, s, [float(v) for v in m], [float(v) for v in i.ravel()]) for (k, s), (m, i) in params.items()], f"`{key}` string, start int, mean array<double>, inv array<double>")
        return rows.join(F.broadcast(table) if len(params) <= 50_000 else table, key)

    centre = {(r[key], 0): (np.array([r[f"m{i}"] for i in range(D)]), np.eye(D)) for r in first}
    if not centre:
        return {}
    spread = joined(centre).groupBy(key).agg(*[F.percentile_approx(F.abs(F.col(c) - F.col("mean")[i]), 0.5, 2000).alias(f"d{i}") for i, c in enumerate(x)]).collect()
    scale = {r[key]: np.sqrt(np.square([1.4826 * r[f"d{i}"] for i in range(D)]) + np.square(FLOOR)) for r in spread}
    params = {(k, 0): (m, np.diag(1 / scale[k] ** 2)) for (k, _), (m, _) in centre.items()}
    bent = joined({(k, 0): (m, np.diag(1 / scale[k])) for (k, _), (m, _) in centre.items()})
    bent = bent.select(key, *[F.tanh((F.col(c) - F.col("mean")[i]) * F.col("inv")[i * D + i]).alias(c) for i, c in enumerate(x)])
    for r in bent.groupBy(key).agg(*_moments(x)).collect():
        cov = _cov(r)[1] + 1e-3 * np.eye(D)
        s = scale[r[key]] / np.sqrt(np.diag(cov))
        params[r[key], 1] = (centre[r[key], 0][0], np.linalg.inv(cov * np.outer(s, s) + floor))
    det: dict = {}
    for _ in range(steps):
        last = dict(det)
        near = joined(params).withColumn("d2", _distance(x, "mean", "inv"))
        cut = near.groupBy(key, "start").agg(F.percentile_approx("d2", COVER, 2000).alias("cut"))
        near = near.join(F.broadcast(cut) if len(params) <= 50_000 else cut, [key, "start"]).filter("d2 <= cut")
        for r in near.groupBy(key, "start").agg(*_moments(x)).collect():
            mean, cov = _cov(r)
            cov = cov * COVER / 0.5467 + floor  # consistent at the normal distribution for cover 0.75, 4 dimensions
            params[r[key], r["start"]] = (mean, np.linalg.inv(cov))
            det[r[key], r["start"]] = np.linalg.slogdet(cov)[1]
        if all(abs(v - last.get(k, np.inf)) < SETTLED for k, v in det.items()):
            break
    best = {}
    for k in {k for k, _ in params}:
        start = min((s for s in (0, 1) if (k, s) in params), key=lambda s: det.get((k, s), np.inf))
        best[k, 0] = params[k, start]
    final = {}
    for r in joined(best).withColumn("d2", _distance(x, "mean", "inv")).filter(F.col("d2") <= CHI[0.975]).groupBy(key).agg(*_moments(x)).collect():
        mean, cov = _cov(r)
        final[r[key]] = (mean, np.linalg.inv(cov / 0.9 + floor))
    return final | {k: best[k, 0] for k, _ in best if k not in final}


def judged(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", limit: float = CHI["reject"]) -> DataFrame:
    """id_col, the base counts, base_failed, the squared distance (null where nothing is estimated) and kept."""
    return _judged(docs, id_col, text_col, lang_col, source_col, limit).drop("sha", "lang", "source")


def _judged(docs: DataFrame, id_col: str, text_col: str, lang_col: str, source_col: str, limit: float) -> DataFrame:
    """The rows of judged with sha, lang and source, which with the id name a row of docs."""
    spark = docs.sparkSession
    rows = stored(statistics(docs, id_col, text_col, lang_col, source_col), "quality-stats")
    rows = rows.withColumn("base_failed", F.expr("n_words < 50 OR 100 * n_repeat_words > 50 * n_words"))
    sizes = rows.filter("NOT base_failed").groupBy("lang", "source").agg(F.count("*").alias("n")).collect()
    by_lang: dict = {}
    for r in sizes:
        if r.n < MIN_GROUP:
            by_lang[r.lang] = by_lang.get(r.lang, 0) + r.n
    name = lambda v: "-" if v is None else "=" + v
    keys = [(r.lang, r.source, f"{name(r.lang)}\x1f{name(r.source)}" if r.n >= MIN_GROUP else f"{name(r.lang)}\x1f*" if by_lang[r.lang] >= MIN_GROUP else "*") for r in sizes]
    enough = sum(r.n for r, k in zip(sizes, keys, strict=True) if k[2] == "*") >= MIN_GROUP
    table = spark.createDataFrame(keys, "k_lang string, k_source string, k_group string")
    table = F.broadcast(table) if len(keys) <= 50_000 else table
    rows = rows.join(table, F.col("lang").eqNullSafe(F.col("k_lang")) & F.col("source").eqNullSafe(F.col("k_source")), "left").drop("k_lang", "k_source")
    x = [f"x{i}" for i in range(D)]
    rows = rows.select("*", *[v.alias(c) for v, c in zip(vector(), x, strict=True)])
    fit = rows.filter("NOT base_failed").select("k_group", *x)
    found = estimates(fit if enough else fit.filter("k_group <> '*'"), x, "k_group")
    table = spark.createDataFrame([(k, [float(v) for v in m], [float(v) for v in i.ravel()]) for k, (m, i) in found.items()], "k_group string, mean array<double>, inv array<double>")
    rows = rows.join(F.broadcast(table) if len(found) <= 50_000 else table, "k_group", "left")
    rows = rows.withColumn("distance2", F.when(~F.col("base_failed"), _distance(x, "mean", "inv")))
    kept = ~F.col("base_failed") & (F.coalesce("distance2", F.lit(0.0)) <= limit)
    return rows.select(F.col("id").alias(id_col), "sha", "lang", "source", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "distance2", kept.alias("kept"))


def query(spark, sf_dir: str) -> DataFrame:
    """op6: base counts and verdict of every document."""
    return judged(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that are kept; rows of one id are judged each."""
    names = fresh(docs, "k_id", "k_sha", "k_lang", "k_source")
    kept = _judged(docs, "doc_id", "text", "lang", "source", CHI["reject"]).filter("kept").select(*[F.col(c).alias(k) for c, k in zip(("doc_id", "sha", "lang", "source"), names, strict=True)]).distinct()
    own = (F.col("doc_id"), text_name("text"), F.col("lang").cast("string"), F.col("source").cast("string"))
    same = [a.eqNullSafe(F.col(k)) for a, k in zip(own, names, strict=True)]
    return docs.join(kept, same[0] & same[1] & same[2] & same[3], "left_semi")
