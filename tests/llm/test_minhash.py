import random

import numpy as np
import pytest
from brute import components, shingles
from conftest import prose

from tidelag.llm import minhash as m


def found(df):
    return sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in m.near_duplicates(df).collect())


def test_rows(docs, rows, empty):
    got = found(docs)
    want = components([(r[0], r[1]) for r in rows])
    assert got == sorted((str(a), n, str(c)) for a, n, c in want)
    assert m.near_duplicates(empty).count() == 0


@pytest.mark.parametrize("block", [1024, 8])
def test_chains_and_groups(spark, monkeypatch, block):
    monkeypatch.setattr(m, "BLOCK", block)
    r, texts = random.Random(6), []
    for g in range(4):
        words = prose(50 + g, 120).split(" ")
        for _ in range(25):
            own = list(words)
            for k in r.sample(range(120), r.randint(0, 4)):
                own[k] = "w" + str(r.randint(0, 99999))
            texts.append(" ".join(own))
            if r.random() < 0.4:
                words = own  # drifts: a chain of links
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    assert found(df) == sorted((str(a), n, str(c)) for a, n, c in components(list(enumerate(texts))))


def test_pigeonhole_keys_meet_within_the_distance():
    rng = np.random.default_rng(7)
    a = rng.integers(0, 1 << 16, (300, m.SYMBOLS)).astype(np.uint16)
    b = a.copy()
    for i in range(300):
        at = rng.choice(m.SYMBOLS, m.MOST, replace=False)
        b[i, at] ^= 1
    assert ((m.keys_of(a) == m.keys_of(b)).any(1)).all()


def test_sets_are_exact():
    texts = [prose(1, 40), "a b", "A B", "", "a b c d e f", "a b c d e a b c d e a"]
    raw = [t.encode() for t in texts]
    off = np.concatenate([[0], np.cumsum([len(x) for x in raw])])
    h, ends = m.shingles(np.frombuffer(b"".join(raw), np.uint8), off)
    assert np.diff(ends).tolist() == [len(shingles(t)) for t in texts]
    assert h[ends[1]] == h[ends[2]]


def test_signature_estimates_similarity():
    words = prose(3, 400).split(" ")
    other = list(words)
    other[::40] = ["new"] * len(other[::40])
    raw = [" ".join(w).encode() for w in (words, other)]
    h, off = m.shingles(np.frombuffer(b"".join(raw), np.uint8), np.array([0, len(raw[0]), len(raw[0]) + len(raw[1])]))
    a, b = set(h[: off[1]].tolist()), set(h[off[1] :].tolist())
    sig = m.signatures(h, off)
    assert abs((sig[0] == sig[1]).mean() - len(a & b) / len(a | b)) < 0.2


def test_stage_keeps_one_of_each_group(spark, docs, rows, empty):
    out = m.stage(spark, docs, "").collect()
    comps = {(r[0], r[1]): c for r, (_, _, c) in zip(rows, components([(r[0], r[1]) for r in rows]), strict=True)}
    kept = [(r.doc_id, r.text) for r in out]
    assert len(kept) == len(set(kept))
    assert {comps[k] for k in kept} == set(comps.values())
    assert m.stage(spark, empty, "").count() == 0


def test_patterned_words_have_hashes_of_their_own():
    bits = [bin(i).count("1") & 1 for i in range(1024)]
    one, two = "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)
    raw = f"{one} {two}".encode()
    h, _ = m.word_hashes(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
    assert len(set(h.tolist())) == 2
    h, off = m.shingles(np.frombuffer(raw, np.uint8), np.array([0, 1024, 1024, len(raw)]))
    assert off.tolist() == [0, 1, 1, 2]
    assert h[0] != h[1]


@pytest.mark.parametrize("members", [128, 6])
def test_clusters_in_parts(spark, monkeypatch, members):
    """Chains that drift, so that a hub part doesn't reach all of a cluster, in clusters of several parts."""
    monkeypatch.setattr(m, "MEMBERS", members)
    r, texts = random.Random(9), []
    for g in range(3):
        words = prose(80 + g, 100).split(" ")
        for _ in range(30):
            words = list(words)
            for k in r.sample(range(100), 2):
                words[k] = "v" + str(r.randint(0, 99999))
            texts.append(" ".join(words))
    texts += texts[:3]
    r.shuffle(texts)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    assert found(df) == sorted((str(a), n, str(c)) for a, n, c in components(list(enumerate(texts))))


def test_stage_tells_namesakes_apart(spark):
    a, b = prose(21, 120), prose(22, 60)
    near = a.replace(a.split(" ")[30], "new", 1)
    rows = [(1, a), (1, b), (2, a), (3, near), (1, near), (4, b), (5, ""), (5, None), (6, " ")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = [(r.doc_id, r.text) for r in m.stage(spark, df, "").collect()]
    kept = [x for x in out if x[1] and x[1].strip()]
    assert len(kept) == 2 and (1, b) in kept and {x[0] for x in kept} == {1}
    assert sum(k == 5 for k, _ in out) == 1 and (6, " ") in out
