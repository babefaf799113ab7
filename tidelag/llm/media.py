"""Media columns: telephony audio.

Payload bytes are kept as the samples of a WAV file, 8 kHz mono: mu-law, A-law or IMA ADPCM
(blocks of 64 bytes). Stored files are read back by their chunks, companded samples are expanded
by lookup tables, ADPCM is decoded with numpy across all blocks of a batch at once, and the
result is resampled to 16 kHz PCM by a half-band interpolator. That PCM is stored, without loss: even
samples (those of ADPCM as differences), and in a column of their own odd ones as differences from what
the interpolator makes of the even ones. Features are computed from the stored PCM.

Defined results: a null or empty text is a payload of 64 zero bytes; equal texts give equal
values; repeated rows are stored each; ties don't arise; a very long text is one file, handled alone, with
memory of some 60 times its size; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import ranges
from .common import flat, per_slice, stored

UNIT, RATE = 64, 8000
#: WAV format tags of the codecs, in the order in which payloads choose them.
TAGS = {"mulaw": 7, "alaw": 6, "ima_adpcm": 17}
CODECS = tuple(TAGS)

#: The step sizes of IMA ADPCM.
STEPS = np.array([
    7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118,
    130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066,
    2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767,
])
#: How a nibble's low three bits move the step index.
MOVES = np.array([-1, -1, -1, -1, 2, 4, 6, 8])


def mulaw_table() -> np.ndarray:
    """Linear value of each mu-law byte."""
    u = ~np.arange(256) & 0xFF
    size = ((((u & 15) << 3) + 132) << (u >> 4 & 7)) - 132
    return np.where(u & 128, -size, size).astype(np.int16)


def alaw_table() -> np.ndarray:
    """Linear value of each A-law byte."""
    a = np.arange(256) ^ 0x55
    low, part = (a & 15) << 4, a >> 4 & 7
    size = np.where(part == 0, low + 8, (low + 264) << np.maximum(part - 1, 0))
    return np.where(a & 128, size, -size).astype(np.int16)


TABLES = {7: mulaw_table(), 6: alaw_table()}


def payloads(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts with zero bytes up to a positive multiple of UNIT, and offsets."""
    size = np.diff(off)
    full = np.maximum(-(-size // UNIT), 1) * UNIT
    ends = np.concatenate([[0], np.cumsum(full)])
    out = np.zeros(int(ends[-1]), np.uint8)
    out[ranges(ends[:-1], size)] = data
    return out, ends


def wav(payload: bytes, codec: str) -> bytes:
    """A WAV file of the payload: fmt, fact and data chunks."""
    tag = TAGS[codec]
    if tag == 17:
        per_block = (UNIT - 4) * 2 + 1
        samples = len(payload) // UNIT * per_block
        fmt = struct.pack("<HHIIHHHH", tag, 1, RATE, RATE * UNIT // per_block, UNIT, 4, 2, per_block)
    else:
        samples, fmt = len(payload), struct.pack("<HHIIHHH", tag, 1, RATE, RATE, 1, 8, 0)
    chunks = [(b"fmt ", fmt), (b"fact", struct.pack("<I", samples)), (b"data", payload)]
    body = b"".join(name + struct.pack("<I", len(x)) + x + b"\0" * (len(x) & 1) for name, x in chunks)
    return b"RIFF" + struct.pack("<I", len(body) + 4) + b"WAVE" + body


def read_wav(raw: bytes) -> tuple[int, int, bytes]:
    """Format tag, block size and data of a WAV file; raises ValueError if it is damaged."""
    if raw[:4] != b"RIFF" or raw[8:12] != b"WAVE" or struct.unpack_from("<I", raw, 4)[0] != len(raw) - 8:
        raise ValueError("not a whole WAV file")
    at, tag, block, data = 12, None, 1, None
    while at + 8 <= len(raw):
        name, size = raw[at : at + 4], struct.unpack_from("<I", raw, at + 4)[0]
        if at + 8 + size > len(raw):
            raise ValueError("a chunk goes beyond the file")
        if name == b"fmt ":
            tag, block = struct.unpack_from("<H", raw, at + 8)[0], struct.unpack_from("<H", raw, at + 20)[0]
        elif name == b"data":
            data = raw[at + 8 : at + 8 + size]
        at += 8 + size + (size & 1)
    if tag is None or data is None:
        raise ValueError("no fmt or data chunk")
    return tag, block, data


def decode_adpcm(blocks: np.ndarray) -> np.ndarray:
    """Samples of IMA ADPCM blocks (rows of bytes): a row for each block; one step of the loop serves all blocks."""
    head = blocks[:, :4].astype(np.int64)
    value = ((head[:, 0] | head[:, 1] << 8) ^ 0x8000) - 0x8000
    index = np.minimum(head[:, 2], len(STEPS) - 1)
    out = np.empty((blocks.shape[1] * 2 - 7, len(blocks)), np.int16)
    out[0] = value
    body = np.ascontiguousarray(blocks[:, 4:].T)
    for k in range(len(out) - 1):
        code = (body[k >> 1] >> (4 * (k & 1)) & 15).astype(np.int64)
        step = STEPS[index]
        change = (step >> 3) + (code & 1) * (step >> 2) + (code >> 1 & 1) * (step >> 1) + (code >> 2 & 1) * step
        value = np.clip(np.where(code & 8, value - change, value + change), -32768, 32767)
        index = np.clip(index + MOVES[code & 7], 0, len(STEPS) - 1)
        out[k + 1] = value
    return out.T


def resampled(pcm: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Twice the rate: each sample, then the half-band value (-1, 9, 9, -1) / 16 between it and the next; ends are held."""
    out = np.empty(2 * len(pcm), np.int16)
    out[::2], out[1::2] = pcm, between(pcm, off)
    return out


def between(pcm: np.ndarray, off: np.ndarray) -> np.ndarray:
    """The half-band value after each sample."""
    size = np.diff(off)
    low, high = np.repeat(off[:-1], size), np.repeat(off[1:] - 1, size)
    at, x = np.arange(len(pcm)), pcm.astype(np.int32)
    one, two = np.minimum(at + 1, high), np.minimum(at + 2, high)
    mid = (9 * (x + x[one]) - x[np.maximum(at - 1, low)] - x[two] + 8) >> 4
    return np.clip(mid, -32768, 32767).astype(np.int16)


def packed(pcm: np.ndarray, off: np.ndarray, stepped: np.ndarray) -> tuple[list[bytes], list[bytes]]:
    """Of each signal (an even number of samples) its even samples, or where stepped their differences from one to the next,
    and the odd samples less the half-band values; all modulo 2 ** 16."""
    half, even = off // 2, pcm[::2].astype(np.int64)
    before = np.concatenate([[0], even])[: len(even)]
    before[half[:-1]] = 0
    rest = (pcm[1::2].astype(np.int64) - between(pcm[::2], half)).astype("<i2").tobytes()
    even = (even - np.where(np.repeat(stepped, np.diff(half)), before, 0)).astype("<i2").tobytes()
    cuts = list(zip(off[:-1].tolist(), off[1:].tolist(), strict=True))  # two bytes for each of half as many samples
    return [even[a:b] for a, b in cuts], [rest[a:b] for a, b in cuts]


def unpacked(even: list[bytes], rest: list[bytes], stepped: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Samples of packed signals, and offsets."""
    half = np.concatenate([[0], np.cumsum([len(b) // 2 for b in even])]).astype(np.int64)
    code = np.frombuffer(b"".join(even), "<i2").astype(np.int64)
    total = np.cumsum(code)
    base = np.repeat(total[half[:-1]] - code[half[:-1]], np.diff(half))
    x = np.where(np.repeat(stepped, np.diff(half)), total - base, code).astype(np.int16)
    out = np.empty(2 * len(x), np.int16)
    out[::2], out[1::2] = x, (between(x, half).astype(np.int64) + np.frombuffer(b"".join(rest), "<i2")).astype(np.int16)
    return out, 2 * half


def write_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", codec: str | None = None) -> DataFrame:
    """id_col, n_bytes and media (a WAV file) of each row; without a codec the payload's CRC-32 chooses it."""
    kind = docs.schema[id_col].dataType.simpleString()

    def kernel(batch: pa.RecordBatch) -> dict:
        data, off = flat(batch.column("text"))
        full, ends = payloads(data, off)
        raw, media = full.tobytes(), []
        for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
            payload = raw[a:b]
            media.append(wav(payload, codec or CODECS[zlib.crc32(payload) % len(CODECS)]))
        return {id_col: batch.column("id"), "n_bytes": np.diff(off), "media": media}

    return per_slice(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), "text", kernel, f"`{id_col}` {kind}, n_bytes long, media binary", 1 << 20)


def decoded(files: list[bytes]) -> tuple[list[int], list[bytes], np.ndarray, np.ndarray]:
    """Format tags, payloads, samples at 16 kHz and offsets of WAV files."""
    read = [read_wav(x) for x in files]
    raw = np.frombuffer(b"".join(x for *_, x in read), np.uint8)
    ends = np.concatenate([[0], np.cumsum([len(x) for *_, x in read])]).astype(np.int64)
    tags = np.array([t for t, *_ in read])
    count = np.where(tags == 17, np.diff(ends) // UNIT * ((UNIT - 4) * 2 + 1), np.diff(ends))
    off = np.concatenate([[0], np.cumsum(count)]).astype(np.int64)
    pcm = np.zeros(int(off[-1]), np.int16)
    for tag in np.unique(tags).tolist():
        pick = tags == tag
        own = raw[ranges(ends[:-1][pick], np.diff(ends)[pick])]
        samples = decode_adpcm(own.reshape(-1, UNIT)).ravel() if tag == 17 else TABLES[tag][own]
        pcm[ranges(off[:-1][pick], count[pick])] = samples
    return tags.tolist(), [x for *_, x in read], resampled(pcm, off), off * 2


def read_media(media: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """Every column of media, and payload, codec, pcm and rest (16 kHz, packed; stepped for ADPCM) of each row."""
    rows = media.withColumnsRenamed({id_col: "id", media_col: "media"}).select("id", "n_bytes", "media")
    kind = rows.schema["id"].dataType.simpleString()
    names = {v: k for k, v in TAGS.items()}

    def kernel(batch: pa.RecordBatch) -> dict:
        tags, payload, pcm, off = decoded(batch.column("media").to_pylist())
        even, rest = packed(pcm, off, np.array(tags) == 17)
        return {"id": batch.column("id"), "n_bytes": batch.column("n_bytes"), "media": batch.column("media"), "payload": payload, "codec": [names[t] for t in tags], "pcm": even, "rest": rest}

    out = per_slice(rows, "media", kernel, f"id {kind}, n_bytes long, media binary, payload binary, codec string, pcm binary, rest binary", 1 << 20)
    return out.withColumnsRenamed({"id": id_col, "media": media_col})


def with_feature(rows: DataFrame) -> DataFrame:
    """Columns of rows but pcm and rest, and feature, from the stored signal and the codec's name."""
    others = [c for c in rows.columns if c not in ("pcm", "rest")]
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*others).schema)

    def kernel(batch: pa.RecordBatch) -> dict:
        codecs = batch.column("codec").to_pylist()
        pcm, off = unpacked(batch.column("pcm").to_pylist(), batch.column("rest").to_pylist(), np.array(codecs) == "ima_adpcm")
        wide, first = pcm.astype(np.int64), off[:-1]
        energy, peak = np.add.reduceat(wide * wide, first), np.maximum.reduceat(np.abs(wide), first)
        turns = np.zeros(len(pcm), np.int64)
        turns[1:] = (wide[1:] < 0) != (wide[:-1] < 0)
        turns[first] = 0
        turns = np.add.reduceat(turns, first)
        each = zip(codecs, np.diff(off).tolist(), peak.tolist(), energy.tolist(), turns.tolist(), strict=True)
        return {c: batch.column(c) for c in others} | {"feature": [f"{k} n={c} peak={p} power={e // c} turns={z}" for k, c, p, e, z in each]}

    return per_slice(rows, "pcm", kernel, f"{ddl}, feature string")


#: Options of the stored tables: signals repeat each other over long distances.
_TABLES = {"parquet.compression.codec.zstd.level": "12", "parquet.page.size": str(8 << 20)}


def query(spark, sf_dir: str) -> DataFrame:
    """op4: every document stored as audio and read back, its PCM stored and read back for the features."""
    media = stored(write_media(spark.read.parquet(f"{sf_dir}/documents.parquet")), "media", options=_TABLES)
    signals = read_media(media).select(
        "doc_id", "n_bytes", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring(F.col("payload"), -UNIT, UNIT)).alias("tail_crc32"), F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"), "codec", "pcm", "rest",
    )
    return with_feature(stored(signals, "media-pcm", options=_TABLES)).drop("codec")
