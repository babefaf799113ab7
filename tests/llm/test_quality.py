import numpy as np
from brute import counts

from tidelag.llm import quality_rules, weak_quality


def test_counts_against_brute_force(docs, rows, empty):
    got = sorted((str(r.doc_id), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in quality_rules.judged(docs).collect())
    want = []
    for r in rows:
        c = counts(r[1])
        want.append((str(r[0]), *c, c[0] < 50 or 100 * c[4] > 50 * c[0]))
    assert got == sorted(want)
    assert quality_rules.judged(empty).count() == 0
    assert all(not r.kept for r in quality_rules.judged(docs).collect() if r.base_failed)


def test_many_distinct_words():
    rng = np.random.default_rng(1)
    word = rng.integers(0, 40, 3000)
    a = quality_rules.repeated_words(word, np.array([1000, 2000]), 40)
    b = quality_rules.repeated_words(word, np.array([1000, 2000]), 1 << 20)
    np.testing.assert_array_equal(a, b)
    assert quality_rules.repeated_words(np.zeros(2, np.int64), np.array([2]), 1).tolist() == [0]


def test_estimates_withstand_outliers(spark):
    rng = np.random.default_rng(2)
    good, bad = rng.normal(size=(400, 4)) * [1, 2, 0.5, 1], rng.normal(size=(90, 4)) + [12, 9, -8, 10]
    df = spark.createDataFrame([("g", *map(float, r)) for r in np.vstack([good, bad])], "k string, x0 double, x1 double, x2 double, x3 double")
    mean, inv = quality_rules.estimates(df, [f"x{i}" for i in range(4)], "k")["g"]
    np.testing.assert_allclose(mean, 0, atol=0.4)
    spread = np.sqrt(np.diag(np.linalg.inv(inv)))
    np.testing.assert_allclose(spread, [1, 2, 0.5, 1], rtol=0.35)
    far = np.array([(r - mean) @ inv @ (r - mean) for r in bad])
    assert (far > 36).all()


def test_verdicts_keep_clean_and_drop_junk(spark):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").toPandas()
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = quality_rules.judged(docs).toPandas().merge(labels, on="doc_id")
    judged = got[~got.base_failed]
    assert judged[judged.quality == 1].kept.mean() > 0.995
    assert judged[judged.quality == 0].kept.mean() < 0.2


def test_repetition_alone_rejects(spark):
    r = np.random.default_rng(5)
    fresh = lambda n: ["".join(r.choice(list("etaoinshr"), 6)) for _ in range(n)]
    texts = [" ".join(fresh(100)) for _ in range(80)]
    passage = fresh(22)
    texts += [" ".join([*fresh(28), *passage, *fresh(28), *passage]), " ".join([*fresh(48), *passage[:2], *fresh(48), *passage[:2]])]
    rows = spark.createDataFrame([(i, t, "en", "s") for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string")
    got = {g.doc_id: g for g in quality_rules.judged(rows).collect()}
    assert got[80].n_repeat_words == 44
    assert not got[80].base_failed
    assert not got[80].kept
    assert all(got[i].kept for i in got if i != 80)


def test_expectation_maximisation_finds_the_labellers():
    rng = np.random.default_rng(3)
    truth = rng.random(20000) < 0.7
    accuracy, fires = np.array([0.9, 0.8, 0.7, 0.85]), np.array([0.9, 0.6, 0.8, 0.5])
    right = rng.random((20000, 4)) < accuracy
    vote = np.where(rng.random((20000, 4)) < fires, np.where(right == truth[:, None], 2, 1), 0)
    pattern, index, count = np.unique(vote, axis=0, return_inverse=True, return_counts=True)
    post, share, rate = weak_quality.expectation_maximisation(pattern, count.astype(float))
    assert abs(share - 0.7) < 0.05
    np.testing.assert_allclose(rate[:, 1, 2] / rate[:, 1, 1:].sum(1), accuracy, atol=0.06)
    assert ((post[index.ravel()] > 0.5) == truth).mean() > 0.9


def test_scores_against_gold(spark):
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet").toPandas()
    got = weak_quality.scored(spark.read.parquet("/root/testdata/sf0.1/documents.parquet")).toPandas().merge(labels, on="doc_id")
    ranks = got.score.rank()
    good = got.quality == 1
    auc = (ranks[good].sum() - good.sum() * (good.sum() + 1) / 2) / (good.sum() * (~good).sum())
    assert auc > 0.97
    assert got[good].kept.mean() > 0.99


def test_weak_edges(docs, rows, empty):
    got = weak_quality.scored(docs).collect()
    assert len(got) == len(rows)
    assert all(0 <= r.score <= 1 and 0 <= r.label <= 1 for r in got)
    assert weak_quality.scored(empty).count() == 0
