import pytest
from brute import components, without_passages

pytest.importorskip("public_tokenizers")
corpus_pipeline = pytest.importorskip("corpus_pipeline")

FOLDER = "/root/testdata/sf0.001"


def test_stages_against_plain_versions(spark, tmp_path):
    from tidelag.llm import mixing, quality_rules

    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    names = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        stage(spark, docs, FOLDER).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        was, now = before.collect(), docs.collect()
        if k < 4:
            assert docs.columns == names
        if name == "quality_rules":
            kept = {r.doc_id for r in quality_rules.judged(before).where("kept").collect()}
            assert sorted(r.doc_id for r in now) == sorted(r.doc_id for r in was if r.doc_id in kept)
        elif name == "minhash":
            want = {c for _, _, c in components([(r.doc_id, r.text) for r in was])}
            assert sorted(r.doc_id for r in now) == sorted(want)
        elif name == "suffix_dedup":
            left = {r.doc_id: t for r, t in zip(was, without_passages([r.text for r in was], 200, 50), strict=True)}
            assert {r.doc_id: r.text for r in now} == {k: v for k, v in left.items() if v}
            assert all(r.n_chars == len(r.text) for r in now)
        elif name == "mixing":
            took = {r.doc_id: r.taken / r["size"] for r in mixing.mix(before).collect() if r.taken}
            copies: dict = {}
            for r in now:
                copies[r.doc_id] = copies.get(r.doc_id, 0) + 1
            assert set(copies) <= set(took)
            assert all(abs(copies.get(i, 0) - p) < 1 for i, p in took.items())
        else:
            assert len(now) == len(was)
            assert all(r.ids is not None for r in now)


def test_names_and_run(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "minhash", "suffix_dedup", "mixing", "bpe"]
    assert corpus_pipeline.run(spark, FOLDER).count() > 50


def test_run_on_odd_tables(spark, tmp_path, docs, empty):
    from conftest import prose

    more = [(100 + i, prose(200 + i, 120), "en", "s1", None, *["x", 1, 2, 3, "y", 4, "z", 5]) for i in range(60)]
    more += [(100, prose(300, 120), "en", "s1", None, *["x", 1, 2, 3, "y", 4, "z", 5]), more[1], (None, prose(301, 100), None, None, None, *["x", 1, 2, 3, "y", 4, "z", 5])]
    spark.createDataFrame(more, docs.schema).unionByName(docs).write.parquet(f"{tmp_path}/odd/documents.parquet")
    out = corpus_pipeline.run(spark, f"{tmp_path}/odd")
    assert out.columns == ["doc_id", "ids"]
    ids = [r.doc_id for r in out.collect()]
    assert ids.count(100) >= 2 and 101 in ids and not {12, 13, 14} & set(ids)
    empty.write.parquet(f"{tmp_path}/none/documents.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0
