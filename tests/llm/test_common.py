import os

import numpy as np
import pyarrow as pa

from tidelag.llm import common


def test_flat_handles_slices_and_nulls():
    a = pa.array(["ab", None, "é", "", "xyz"]).slice(1)
    data, off = common.flat(a)
    assert data.tobytes() == "éxyz".encode()
    assert off.tolist() == [0, 0, 2, 2, 5]
    data, off = common.flat(pa.array([], pa.string()))
    assert len(data) == 0
    assert off.tolist() == [0]


def test_slices_hold_to_the_limit():
    batch = pa.RecordBatch.from_pydict({"text": ["a" * n for n in (5, 1, 9, 30, 2, 0, 0, 3)]})
    got = list(common.slices(iter([batch]), "text", 10))
    assert [b.num_rows for b in got] == [2, 1, 1, 4]
    assert sum((b.column("text").to_pylist() for b in got), []) == batch.column("text").to_pylist()


def test_words_never_cross_texts():
    data, off = common.flat(pa.array(["a b", "c", " d", "", "\x1ce\x0bf"]))
    assert common.sums(common.word_starts(data, off), off).tolist() == [2, 1, 1, 0, 2]


def test_stored_tables_are_dropped(spark):
    common.drop_stored(spark)
    df = common.stored(spark.range(3), "drop-test")
    assert df.count() == 3
    path = common._written[-1].removeprefix("file://")
    assert os.path.isdir(path)
    common.drop_stored(spark)
    assert not os.path.exists(path)


def test_fresh_names(spark):
    assert common.fresh(spark.createDataFrame([(1, 2)], "k_id int, _K_ID int"), "k_id", "n", "n") == ["__k_id", "n", "_n"]


def test_mixing_bits():
    assert len(np.unique(common.mix64(np.arange(1000)))) == 1000
