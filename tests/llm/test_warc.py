import pytest

from tidelag.llm import warc
from tidelag.llm.common import shared_dir

HTML = ["<p>a</p>" * 30, "<p>b</p>" * 50, "", "<p>é 漢</p>"]


@pytest.fixture(scope="module")
def pages(spark):
    rows = [(i, f"http://x.example/{i}?q=ä b\r\nc", HTML[i % 4], "z", "k") for i in range(60)]
    rows += [(61, None, None, "z", "k"), (None, "u", HTML[1], "z", "k"), (0, "again", HTML[0], "z", "k"), (70, "only", "<i>once</i>", "z", "k")]
    return spark.createDataFrame(rows, "page_id long, url string, html string, sha string, first string").repartition(3)


def test_round_trip(spark, pages):
    folder = shared_dir(spark, "warc-test")
    got = warc.read_archives(warc.write_archives(pages, folder), folder).collect()
    want = pages.collect()
    assert len(got) == len(want)
    first: dict = {}
    for r in want:
        h = r.html or ""
        if r.page_id is not None:
            first[h] = min(first.get(h, r.page_id), r.page_id)
    expect = sorted((str(r.page_id), len((r.html or "").encode()), warc.digest((r.html or "").encode()), "response" if r.page_id == first[r.html or ""] else "revisit", "None" if r.page_id == first[r.html or ""] else str(first[r.html or ""])) for r in want)
    assert sorted((str(r.key), r.payload_bytes, r.payload_digest, r.record_type, str(r.refers_to)) for r in got) == expect
    for r in got:
        assert (r.payload is None) == (r.record_type == "revisit")
        if r.payload is not None:
            assert warc.digest(bytes(r.payload)) == r.payload_digest


def test_small_payloads_below_the_limit_are_responses(spark, pages):
    folder = shared_dir(spark, "warc-test")
    got = warc.read_archives(warc.write_archives(pages, folder, min_bytes=50), folder).collect()
    assert all(r.record_type == "response" for r in got if r.payload_bytes < 50)
    assert any(r.record_type == "revisit" for r in got)


def test_dictionary_is_the_leading_skippable_frame(monkeypatch):
    records = [warc.record(str(i), f"http://e/{i}", (f"<html><body><p>page {i} " + "word " * (i % 90) + "</p></body></html>").encode(), None) for i in range(300)]
    raw = warc.archive(records)
    assert raw[:4] == (0x184D2A5D).to_bytes(4, "little")
    assert list(warc.frames(raw)) == records
    few = warc.archive(records[:3])
    assert few[:4] == (0xFD2FB528).to_bytes(4, "little")
    assert list(warc.frames(few)) == records[:3]
    assert list(warc.frames(warc.archive([]))) == []
    for bad in (raw[:-1], raw[:-4] + b"\1\2\3\4", raw[: len(raw) // 2], raw + b"x"):
        with pytest.raises(Exception):  # noqa: B017, PT011 - zstandard's own error or ours
            list(warc.frames(bad))


def test_damaged_records_are_refused():
    good = warc.record("5", "http://e", b"<p>x</p>", None)
    assert warc.parsed(good)["payload"] == b"<p>x</p>"
    assert warc.parsed(warc.record("6", None, b"<p>x</p>", "5"))["refers_to"] == "5"
    for bad in (good.replace(b"WARC/1.1", b"WARC/9"), good[:-1], good.replace(b"<p>x", b"<p>y"), good.replace(b"WARC-Date", b"WARC-Data"), good.replace(b"Content-Length: 8", b"Content-Length: 9"), good.replace(b": response", b": metadata"), good.replace(b"WARC-Type: ", b"WARC-Type ")):
        with pytest.raises(ValueError):
            warc.parsed(bad)


def test_several_archives_and_empty_table(spark, pages, monkeypatch):
    folder = shared_dir(spark, "warc-test")
    none = warc.write_archives(pages.limit(0), folder)
    assert warc.read_archives(none, folder).count() == 0
    for key in (None, "a b/c:d", "ü", ""):
        assert warc.key_of(warc.urn(key)) == key
