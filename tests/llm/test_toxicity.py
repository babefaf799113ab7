import random

import numpy as np

from tidelag.llm import toxicity as t


def edits(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_automaton_against_edit_distance():
    lexicon = ["loser", "moron", "scum", "pathetic", "lowe", "größe", "md"]
    a = t.Automaton(lexicon)
    r, words = random.Random(1), ["loser", "lose", "losers", "xloser", "lser", "lowe", "lowen", "lows", "scum", "scums", "pathetic", "patetic", "pathetical", "moronic", "größe", "grösse", "größen", "l", "lo", "m", "verylongwordindeed"]
    for _ in range(3000):
        w = list(r.choice(["loser", "moron", "scum", "pathetic", "lowe", "größe", "md"]))
        for _ in range(r.randint(0, 3)):
            k = r.randint(0, len(w))
            w[k : k + r.randint(0, 1)] = r.choice(["", "a", "o", "ß", "r"])
        words.append("".join(w) or "q")
    for w, g in zip(words, a.run(words).tolist(), strict=True):
        near = any(edits(w, x) <= 1 for x in lexicon if len(x) >= t.FUZZY)
        assert g == (2 if w in lexicon else 1 if near else 0), w
    assert t.Automaton([]).run(["a", "b"]).tolist() == [0, 0]


def test_lexicon_holds_precise_words_at_any_size():
    table = [("idiot", 60, 0), ("moron", 4, 0), ("often", 60, 4), ("the", 90, 880), ("rare", 2, 0), ("some", 30, 20)]
    assert set(t.lexicon_of(table, 100, 900)) == {"idiot", "moron", "often"}
    many = [(w, 1000 * p, 1000 * n) for w, p, n in table] + [("scum", 4, 0)]
    assert {"idiot", "moron", "often", "scum"} <= set(t.lexicon_of(many, 100_000, 900_000))
    assert len(t.lexicon_of([(f"beispiel{i}", 30, 0) for i in range(300)], 100, 900)) == 300


def test_misspelled_words_of_the_lexicon():
    words = ["idiot", "moron", "clown", "stupid", "pathetic", "worthless", "scum"]
    a = t.Automaton(words)
    wrong = ["1diot", "m0ron", "c1own", "st0pid", "pthetic", "wrthless", "skum"]
    assert a.run(wrong).tolist() == [1] * len(wrong)
    assert a.run(words).tolist() == [2] * len(words)
    assert a.run(["house", "md", "pthtic", "wrthlss"]).tolist() == [0] * 4


def test_places_are_of_the_lower_cased_text():
    quoted = "İ" * 40 + ' the word "idiot" was used'
    assert t.features(quoted, {"idiot": 2})[6] == 1.0


def test_time_in_proportion_to_the_hits():
    import time

    start = time.time()
    t.features("idiot " * 100_000, {"idiot": 2})
    assert time.time() - start < 5


def test_windows_tell_quotation_from_abuse():
    level = {"idiot": 2}
    abuse = t.features("you are an idiot and nothing else", level)
    quote = t.features('the word "idiot" was used then', level)
    told = t.features("someone said idiot to them once", level)
    assert abuse[4] > told[4] > quote[4]
    assert quote[6] == 1
    assert t.features("you idiot you idiot", level)[4] > abuse[4]


def frames(spark):
    r = random.Random(3)
    plain = ["".join(r.choices("etaoinshr", k=r.randint(2, 8))) for _ in range(200)]
    docs, labels = [], []
    for i in range(900):
        words = r.choices(plain, k=40)
        bad = i % 6 == 0
        if bad:
            for k in r.sample(range(40), 3):
                words[k] = r.choice(["idiotto", "scummer", "wortlos"])
            if i % 12 == 0:
                words[5] = "idioto"
        docs.append((i, " ".join(words), "en", "s"))
        labels.append((i, 1, int(bad)))
    docs += [(None, "a b", None, None), (1000, None, "en", "s"), (1001, "", "en", "s"), (0, docs[0][1], "en", "s")]
    labels += [(5000, 1, 1), (None, 1, 1), (7, 1, None)]
    return spark.createDataFrame(docs, "doc_id long, text string, lang string, source string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_held_out_accuracy_and_edges(spark):
    import zlib

    docs, labels = frames(spark)
    got = t.scored(docs, labels).collect()
    assert len(got) == 904
    for r in got:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
        assert 0 <= r.score <= 1
        assert r.predicted == int(r.score >= 0.7)
    held = [r for r in got if r.held_out and r.doc_id < 900]
    assert np.mean([r.predicted == (r.doc_id % 6 == 0) for r in held]) > 0.98
    assert t.scored(docs.limit(0), labels).count() == 0
    assert {r.score for r in t.scored(docs, labels.limit(0)).collect()} == {0.0}


def test_held_out_on_the_tables(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{n}.parquet") for n in ("documents", "labels"))
    got = t.scored(docs, labels).join(labels, "doc_id").where("held_out").toPandas()
    bad = got.toxic == 1
    ranks = got.score.rank()
    assert (ranks[bad].sum() - bad.sum() * (bad.sum() + 1) / 2) / (bad.sum() * (~bad).sum()) > 0.93
    assert got[~bad].predicted.mean() < 0.01
