from collections import Counter

import numpy as np
from brute import WORD

from tidelag.llm import mixing


def test_targets_fill_up_to_the_caps():
    t = mixing.targets([100, 10, 1000, 0], (5, 2, 1))
    np.testing.assert_allclose(t.sum(), 1110)
    assert t[1] == 30
    assert (t <= 3 * np.array([100, 10, 1000, 0]) + 1e-9).all()
    np.testing.assert_allclose(mixing.targets([100, 100, 100], (5, 2, 1)), [187.5, 75, 37.5])
    assert len(mixing.targets([], (1,))) == 0


def test_shard_counts_meet_the_quota():
    q = np.array([50, 0, 7, 200])
    c = mixing.shard_counts(q, 16, 3)
    np.testing.assert_array_equal(c.sum(0), q)
    assert c.sum(1).max() - c.sum(1).min() <= 16
    np.testing.assert_array_equal(c, mixing.shard_counts(q, 16, 3))


def test_permutations():
    for n in (1, 2, 3, 64, 1000):
        got = mixing.permuted(np.arange(n), n, np.full(n, 12345, np.uint64))
        assert sorted(got.tolist()) == list(range(n))


def test_mix(docs, rows):
    got = mixing.mix(docs, block_words=4).collect()
    assert len(got) == len(rows)
    want = sorted((str(r[0]), len(WORD.findall(r[1] or ""))) for r in rows)
    assert sorted((str(r.doc_id), r["size"]) for r in got) == want
    per: dict = {}
    for r in got:
        assert 0 <= r.taken <= 3 * r["size"]
        per.setdefault(r.source, [r.source_size, r.target, 0, 0])
        per[r.source][2] += r.taken
        per[r.source][3] += r["size"]
    assert list(sorted(per, key=lambda s: (s is None, s or ""))) == ["s0", "s1", "s2", None]
    for size, target, taken, own in per.values():
        assert size == own
        assert abs(taken - target) <= 0.05 * target + 16
    again = mixing.mix(docs, block_words=4).collect()
    key = lambda r: (str(r.doc_id), r["size"], r.taken)
    assert sorted(map(key, again)) == sorted(map(key, got))


def test_empty(empty, spark):
    assert mixing.mix(empty).count() == 0
    none = spark.createDataFrame([(1, None, None), (2, "", "a")], "doc_id long, text string, source string")
    assert [(r["size"], r.taken, r.target) for r in mixing.mix(none).collect()] == [(0, 0, 0.0)] * 2


def test_stage_repeats_documents(docs, spark, empty):
    out = mixing.stage(spark, docs, "")
    assert out.columns == docs.columns
    took = {r.doc_id: r.taken / max(r["size"], 1) for r in mixing.mix(docs).collect()}
    for r in out.groupBy("doc_id").count().collect():
        assert took[r.doc_id] > 0
    assert mixing.stage(spark, empty, "").count() == 0


def test_written_mix(docs, rows):
    mixed, placed = (df.collect() for df in mixing.deal(docs, block_words=4, shards=8))
    assert len({(m.shard, m.slot) for m in mixed}) == len(mixed)
    for k in range(8):
        assert sorted(m.slot for m in mixed if m.shard == k) == list(range(sum(m.shard == k for m in mixed)))
    last = {s: max(m.blk for m in mixed if m.src == s) for s in {m.src for m in mixed}}
    whole: dict = {}
    for m in mixed:
        found = [len(WORD.findall(p.text)) for p in m.parts]
        assert found == [p.w for p in m.parts]
        assert sum(found) == m.words
        assert m.words == 4 or (m.blk == last[m.src] and 0 < m.words < 4)
        for p in m.parts:
            whole.setdefault((m.source, m.src, p.start, p.id, m.turn), {})[m.blk] = p.text
    full = Counter((s, i, "".join(t for _, t in sorted(parts.items()))) for (s, _, _, i, turn), parts in whole.items() if turn == 0)
    given = Counter((r[3], r[0], r[1]) for r in rows)
    sources = {s for s in {r[3] for r in rows} if all(full[k] == n for k, n in given.items() if k[0] == s and WORD.findall(k[2] or ""))}
    passes = {m.source for m in mixed if m.turn > 0}
    assert passes
    assert passes <= sources
    got = Counter()
    for m in mixed:
        for p in m.parts:
            got[str(p.id)] += p.w
    want = Counter()
    for r in mixing.mix(docs, block_words=4, shards=8).collect():
        want[str(r.doc_id)] += r.taken
    assert +want == +got
    assert len(placed) == len(rows)


def test_stage_takes_the_words_of_the_mix(docs, rows, spark):
    got = mixing.stage(spark, docs, "").collect()
    want = Counter()
    for r in mixing.mix(docs).collect():
        want[str(r.doc_id)] += r.taken
    words = Counter()
    for r in got:
        words[str(r.doc_id)] += len(WORD.findall(r.text))
        assert r.n_chars == len(r.text)
    assert words == +want
    assert any(r.text == t for r in got for _, t, *_ in rows)
