import hashlib
import shutil
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidelag.llm import media


def scalar_adpcm(block: bytes) -> list[int]:
    value = int.from_bytes(block[:2], "little", signed=True)
    index, out = min(block[2], 88), [value]
    for byte in block[4:]:
        for code in (byte & 15, byte >> 4):
            step = int(media.STEPS[index])
            change = step >> 3
            change += step if code & 4 else 0
            change += step >> 1 if code & 2 else 0
            change += step >> 2 if code & 1 else 0
            value = max(-32768, min(32767, value - change if code & 8 else value + change))
            index = max(0, min(88, index + int(media.MOVES[code & 7])))
            out.append(value)
    return out


def test_adpcm_against_a_scalar_decoder():
    blocks = np.random.default_rng(2).integers(0, 256, (9, 64), dtype=np.uint8)
    np.testing.assert_array_equal(media.decode_adpcm(blocks), [scalar_adpcm(b.tobytes()) for b in blocks])


def test_companding_tables():
    assert media.TABLES[7][[0, 127, 128, 255]].tolist() == [-32124, 0, 32124, 0]
    assert media.TABLES[6][[0x55, 0xD5, 0x2A, 0xAA]].tolist() == [-8, 8, -32256, 32256]
    for t in media.TABLES.values():
        assert len(set(t.tolist())) >= 255


def test_resampling_keeps_samples_and_ends():
    off = np.array([0, 3, 4])
    out = media.resampled(np.array([0, 100, 200, 7], np.int16), off)
    assert out[::2].tolist() == [0, 100, 200, 7]
    assert out[1::2].tolist() == [44, 156, 206, 7]  # by hand: (9 * 400 - 100 - 200 + 8) // 16


@pytest.mark.parametrize("codec", media.CODECS)
def test_files(codec):
    raw = bytes(range(128))
    f = media.wav(raw, codec)
    assert media.read_wav(f) == (media.TAGS[codec], 64 if codec == "ima_adpcm" else 1, raw)
    for bad in (f[:-1], b"RIFX" + f[4:], f[:4] + b"\0\0\0\0" + f[8:]):
        with pytest.raises(ValueError):
            media.read_wav(bad)


def test_packing_is_lossless():
    rng = np.random.default_rng(5)
    off, stepped = np.array([0, 2, 8, 200]), np.array([True, False, True])
    for pcm in (rng.integers(-32768, 32768, 200).astype(np.int16), media.resampled(rng.integers(-32768, 32768, 100).astype(np.int16), off // 2)):
        for how in (stepped, ~stepped):
            even, rest = media.packed(pcm, off, how)
            out, ends = media.unpacked(even, rest, how)
            np.testing.assert_array_equal(out, pcm)
            assert ends.tolist() == off.tolist()
    assert set(b"".join(rest)) == {0}  # nothing is left of what the interpolator made


def test_rows(docs, rows, empty):
    got = {}
    for r in media.with_feature(media.read_media(media.write_media(docs)).withColumn("signal", F.struct("pcm", "rest"))).collect():
        got.setdefault(r.n_bytes, []).append((bytes(r.payload), bytes(r.media), r.feature, tuple(map(bytes, r.signal))))
    texts = [(r[1] or "").encode() for r in rows]
    assert sum(map(len, got.values())) == len(rows)
    for b in texts:
        n = max(64, -(-len(b) // 64) * 64)
        same = [x for x in got[len(b)] if x[0] == b + b"\0" * (n - len(b))]
        assert same
        assert len({x[1:] for x in same}) == 1
        tag, _, data = media.read_wav(same[0][1])
        assert data == same[0][0]
        samples = n // 64 * 121 if tag == 17 else n
        pcm, _ = media.unpacked([same[0][3][0]], [same[0][3][1]], np.array([tag == 17]))
        assert len(pcm) == 2 * samples
        if tag != 17:
            np.testing.assert_array_equal(pcm[::2], media.TABLES[tag][np.frombuffer(data, np.uint8)])
        assert f"n={len(pcm)} peak={np.abs(pcm.astype(int)).max()} " in same[0][2]
    assert media.read_media(media.write_media(empty)).count() == 0


def test_query(spark, tmp_path, docs):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    for r, t in zip(media.query(spark, str(tmp_path)).where("doc_id = 15").collect(), ["one two"], strict=True):
        p = t.encode() + b"\0" * 57
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (7, 64, hashlib.sha256(p).hexdigest(), zlib.crc32(p))


def test_features_come_from_the_stored_signal(spark, tmp_path, docs):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    out = media.query(spark, str(tmp_path))
    (folder,) = {f.rsplit("/", 1)[0] for f in out.inputFiles()}
    assert "media-pcm" in folder
    shutil.rmtree(folder.removeprefix("file://"))
    with pytest.raises(Exception, match=r"(?i)exist|not found"):
        out.collect()
