import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from brute import repeated
from conftest import prose

from tidelag.llm import suffix_dedup as s


def flat(texts):
    raw = [t if isinstance(t, bytes) else t.encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in raw])])


def test_refined_interleave_against_sorted_suffixes():
    rng = np.random.default_rng(1)
    for shard in (7, 20, 1000):
        strings = np.concatenate([np.append(rng.integers(1, 4, rng.integers(0, 12)), 0) for _ in range(25)])
        ends = np.flatnonzero(strings == 0)
        tails = [tuple(strings[i : ends[np.searchsorted(ends, i)]]) for i in range(len(strings))]

        def common(a, b):
            k = 0
            while k < min(len(a), len(b)) and a[k] == b[k]:
                k += 1
            return k

        for most in (1, 3, 4, 20):
            order, lcp = s.common_prefixes(strings, most, shard)
            assert sorted(order.tolist()) == list(range(len(strings)))
            cut = [tails[i][:most] for i in order.tolist()]
            assert cut == sorted(cut)
            assert lcp[1:].tolist() == [min(common(tails[a], tails[b]), most) for a, b in zip(order[:-1].tolist(), order[1:].tolist(), strict=True)]


def test_names_are_of_bytes():
    rng = np.random.default_rng(2)
    data = rng.integers(97, 99, 500).astype(np.uint8)
    for width in (1, 3, 5, 7, 20, 50):
        name = s.names(data, width)[: 500 - width + 1]
        words = [data[i : i + width].tobytes() for i in range(len(name))]
        assert len(set(zip(name.tolist(), words, strict=True))) == len(set(words)) == len(set(name.tolist()))


@pytest.mark.parametrize("width", [1, 2, 50, 100])
def test_names_need_no_pairs_unless_hashes_meet(monkeypatch, width):
    rng = np.random.default_rng(6)
    piece = rng.integers(97, 100, 300).astype(np.uint8)
    data = np.concatenate([piece, rng.integers(97, 100, 200).astype(np.uint8), piece[20:], np.full(250, 97, np.uint8), piece[:150]])
    at = np.flatnonzero(rng.random(len(data) - width + 1) < 0.9)
    text, calls, pairs = data.tobytes(), [], s.names
    monkeypatch.setattr(s, "names", lambda *a: calls.append(1) or pairs(*a))

    def check(hashes):
        monkeypatch.setattr(s, "gram_hashes", hashes)
        name, seen = s.names_of(data, width, at), {}
        assert all(seen.setdefault(text[p : p + width], k) == k for p, k in zip(at.tolist(), name.tolist(), strict=True))
        assert len(set(seen.values())) == len(seen)

    true = s.gram_hashes
    check(true)
    off = np.array([0, 600, len(data)])
    s.intervals(data, off, np.ones(2, int), 400)
    assert not calls
    check(lambda x, w: true(x, w) & np.uint64(3 << 62))  # few hashes, so different bytes meet
    assert calls


@pytest.mark.parametrize("span", [8, 20, 40])
def test_intervals_against_counted_windows(span):
    r = random.Random(span)
    for _ in range(20):
        texts = ["".join(r.choices("ab", k=r.randint(span, 3 * span))) for _ in range(6)]
        texts = [t[: len(t) // 2] + texts[0][: span + 3] for t in texts] + ["ab" * span]
        texts = list(dict.fromkeys(t for t in texts if len(t) >= span))
        times = np.array([r.choice([1, 1, 2]) for _ in texts])
        data, off = flat(texts)
        often = Counter()
        for t, k in zip(texts, times.tolist(), strict=True):
            often.update({w: k * v for w, v in Counter(t[p : p + span] for p in range(len(t) - span + 1)).items()})
        want = {int(a) + p for t, a in zip(texts, off[:-1], strict=True) for p in range(len(t) - span + 1) if often[t[p : p + span]] > 1}
        place, interval = s.intervals(data, off, times, span)
        assert set(place.tolist()) == want and len(place) == len(want)
        whole = "".join(texts)
        assert len({(i, whole[p : p + span]) for i, p in zip(interval.tolist(), place.tolist(), strict=True)}) == len(set(interval.tolist()))


def test_sliding():
    x = np.random.default_rng(2).integers(0, 99, 50).astype(np.uint64)
    for w in (1, 7, 50):
        assert s.sliding(x, w).tolist() == [x[i : i + w].min() for i in range(51 - w)]
    assert len(s.sliding(x, 51)) == 0


def check(df, texts, spans=(400,)):
    got = s.repeated_spans(df, spans=spans).collect()
    for span in spans:
        mine = []
        for r in got:
            f = {x.span: x for x in r.found}.get(span)
            runs = f.runs if f else []
            mine.append((r.n_bytes, sum(runs[1::2]) - sum(runs[::2]), len(runs) // 2, f.kept if f else r.sha.hex()))
        assert sorted(mine) == sorted((n, k, m, hashlib.sha256(left).hexdigest()) for n, k, m, left in repeated(texts, span))


def test_rows(docs, rows, empty):
    check(docs, [r[1] for r in rows], (200, 400))
    assert s.repeated_spans(empty).count() == 0


def passages(seed):
    r = random.Random(seed)
    word = lambda: "".join(r.choices("abcdefgh", k=r.randint(2, 7)))
    passage = " ".join(word() for _ in range(120))
    texts = []
    for _ in range(40):
        a = r.randint(0, 200)
        b = r.randint(a, len(passage))
        texts.append(" ".join(word() for _ in range(r.randint(0, 60))) + passage[a:b] + " ".join(word() for _ in range(r.randint(0, 60))))
    return texts + ["xy" * 300, "z" * 800, "xy" * 150 + "q" + "xy" * 210, "z" * 500 + "xy" * 200]


@pytest.mark.parametrize("part", [1000, 3, 1])
def test_shared_passages_in_many_documents(spark, monkeypatch, part):
    monkeypatch.setattr(s, "PART", part)
    texts = passages(4)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(6)
    check(df, texts, (100, 400))


def test_merged_transforms_decide(spark, monkeypatch):
    broken = lambda strings, most: (np.arange(len(strings)), np.zeros(len(strings), int))
    texts = passages(5)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    assert any(r.found for r in s.repeated_spans(df).collect())
    # in the test's own process: nothing is found any more
    data, off = flat(texts)
    assert len(s.intervals(data, off, np.ones(len(texts), int), 400)[0])
    monkeypatch.setattr(s, "common_prefixes", broken)
    assert not len(s.intervals(data, off, np.ones(len(texts), int), 400)[0])


def test_pieces_of_long_runs_and_very_long_texts(spark, monkeypatch):
    monkeypatch.setattr(s, "PIECE", 50)
    long = "".join(random.Random(3).choices("abcdefghij ", k=1_300_000))
    _, _, first, last = s.runs(*flat(["ab" * 900, "a" * 1500]), 400, 80)
    assert (last - first).max() == 49
    texts = ["ab" * 900, "a" * 1500, long, "x" * 30 + long[700_000:700_450] + "y" * 30]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    got = {r.doc_id: [x.runs for x in r.found] for r in s.repeated_spans(df).collect()}
    assert got == {0: [[0, 1800]], 1: [[0, 1500]], 2: [[700_000, 700_450]], 3: [[30, 480]]}


def test_stage(spark, docs, empty):
    out = s.stage(spark, docs, "")
    assert out.columns == docs.columns
    assert all(r.text for r in out.collect())
    assert s.stage(spark, empty, "").count() == 0


def test_stage_cuts_passages_and_keeps_namesakes_apart(spark):
    passage, clean = prose(61, 60), prose(62, 150)
    short = prose(63, 40)  # under 50 words: stays
    one, two = f"{prose(64, 80)} {passage} {prose(65, 20)}", f"{passage} {prose(66, 90)}"
    rows = [(1, clean, None), (1, one, 5), (2, two, 6), (3, f"{short} {prose(67, 30)}", 7), (4, f"{prose(68, 30)} {short}", 8), (5, None, 9), (6, passage, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_chars int").repartition(3)
    out = sorted((r.doc_id, r.text) for r in s.stage(spark, df, "").collect())
    assert (1, clean) in out and (3, rows[3][1]) in out and (4, rows[4][1]) in out
    assert {k for k, _ in out} == {1, 2, 3, 4}
    assert not any(passage[5:-5] in t for _, t in out)
    assert [t for k, t in out if k == 1 and t != clean][0].startswith(prose(64, 80)[:-1])


def test_query_flags_short_passages(spark, tmp_path):
    passage = prose(71, 55)
    passage = passage[:390]
    texts = [f"{prose(72, 70)} {passage}", f"{passage} {prose(73, 70)}", prose(74, 200), prose(75, 300), prose(75, 300), None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.n_removed > 0, r.flagged) for r in s.query(spark, str(tmp_path)).collect()}
    assert got == {0: (False, True), 1: (False, True), 2: (False, False), 3: (True, True), 4: (True, True), 5: (False, False)}
