import hashlib
import random

import numpy as np
import pytest

P = pytest.importorskip("public_tokenizers")
tokenizers = pytest.importorskip("tokenizers")

from tidelag.llm import bpe  # noqa: E402

PATH = P.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(PATH)


def test_against_the_library_on_random_texts(library):
    r = random.Random(1)
    pool = [*"ab  \t\n\r\x0b\x0c\x1c\x85\xa0 　'sstm1²½Ⅷ٣ñßéaaa€漢字🙂‍́́-_.,!<|>#", "<|endoftext|>", "'ll", "'re", " the", " and", "﻿"]
    cases = ["".join(r.choices(pool, k=r.randint(0, 60))) for _ in range(3000)] + ["a" * 5000, " " * 500 + "x", "", "<|endoftext|>"]
    b = bpe.Bpe(open(PATH, encoding="utf-8").read())
    ids, off = b.encode(cases)
    raw, ends = b.decode(ids, off)
    for i, s in enumerate(cases):
        want = library.encode(s, add_special_tokens=False).ids
        assert ids[off[i] : off[i + 1]].tolist() == want, repr(s)
        assert raw[ends[i] : ends[i + 1]].tobytes().decode("utf-8", "replace") == library.decode(want, skip_special_tokens=False)


def test_forgets_and_learns_again(monkeypatch, library):
    monkeypatch.setattr(bpe, "REMEMBERED", 5)
    b = bpe.Bpe(open(PATH, encoding="utf-8").read())
    for s in ("some words and more of them", "other words here now again", "some words and more of them"):
        assert b.encode([s])[0].tolist() == library.encode(s, add_special_tokens=False).ids


def test_rows(docs, rows, library):
    got = sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in (lambda d: d.select("doc_id", *bpe.digests(d)))(bpe.encode(docs, PATH, decoded=True)).collect())
    want = []
    for r in rows:
        ids = library.encode(r[1] or "", add_special_tokens=False).ids
        want.append((str(r[0]), len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r[1] or "").encode()).hexdigest()))
    assert got == sorted(want)


def test_decode_frame(spark, empty, docs):
    enc = bpe.encode(docs, PATH)
    assert sorted(r.decoded for r in bpe.decode(enc, PATH).collect()) == sorted(r.text or "" for r in docs.select("text").collect())
    df = spark.createDataFrame([(1, None), (2, [])], "doc_id long, ids array<int>")
    assert [r.decoded for r in bpe.decode(df, PATH).collect()] == ["", ""]
    assert bpe.encode(empty, PATH).count() == 0
    half = bpe.Bpe(open(PATH, encoding="utf-8").read())
    ids, _ = half.encode(["é"])
    assert isinstance(ids, np.ndarray)
