"""WARC archives with a Zstandard dictionary: writer with revisit records, and a validating reader.

An archive starts with a skippable frame that holds the (compressed) dictionary; each record is
one frame after it. The reader finds every frame's end by its block headers, decodes the frame
with the dictionary, and checks version, fields, lengths and digests.

Defined results: null html is an empty payload; of rows with equal payloads those with the smallest
id are responses (all of them if that id is repeated, or if no row has an id), the others revisit it;
a null url is written as an empty target; repeated rows are records of their own; a very long page
is a record, and an archive, of its own; an empty table gives an empty result; other columns of any
name are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shared_dir, stored

#: Raw bytes of records in one archive, of its dictionary, and of the records it is trained on.
ARCHIVE_BYTES, DICTIONARY_BYTES, SAMPLE_BYTES = 16 << 20, 16 << 10, 1 << 20
#: Bytes up to which the list of revisits is broadcast; beyond, payloads are joined to it by id.
LIGHT_BYTES = 16 << 20
#: Formats of the archive.
SKIPPABLE, FRAME = 0x184D2A5D, 0xFD2FB528
VERSION, DATE = b"WARC/1.1", "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def digest(payload: bytes) -> str:
    """Base32 SHA-1, upper case."""
    return base64.b32encode(hashlib.sha1(payload, usedforsecurity=False).digest()).decode()


def urn(key: str | None) -> str:
    return "<urn:row-null>" if key is None else f"<urn:row:{quote(key, safe='')}>"


def key_of(name: str) -> str | None:
    if name == "<urn:row-null>":
        return None
    if not (name.startswith("<urn:row:") and name.endswith(">")):
        raise ValueError(f"a record id of another kind: {name}")
    return unquote(name[9:-1])


def record(key: str | None, url: str | None, payload: bytes, first: str | None) -> bytes:
    """A response record, or with first (the id of the response) a revisit record of the payload."""
    own = digest(payload)
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block += b"" if first is not None else payload
    head = {
        "WARC-Type": "response" if first is None else "revisit", "WARC-Record-ID": urn(key), "WARC-Date": DATE,
        "WARC-Target-URI": quote(url or "", safe="!#$%&'()*+,/:;=?@[]~-._"), "Content-Type": "application/http; msgtype=response",
        "WARC-Payload-Digest": f"sha1:{own}", "WARC-Block-Digest": f"sha1:{digest(block)}",
    }
    if first is not None:
        head |= {"WARC-Profile": PROFILE, "WARC-Refers-To": urn(first)}
    lines = [VERSION, *(f"{k}: {v}".encode() for k, v in head.items()), b"Content-Length: %d" % len(block)]
    return b"\r\n".join(lines) + b"\r\n\r\n" + block + b"\r\n\r\n"


def archive(records: list[bytes]) -> bytes:
    """A whole archive: the dictionary in a skippable frame if one can be trained, and a frame for each record."""
    sample, size = [], 0
    for x in records:
        if size < SAMPLE_BYTES:
            sample.append(x[:8192])
            size += len(sample[-1])
    words = None
    if len(sample) >= 16:
        try:
            words = zstandard.train_dictionary(DICTIONARY_BYTES, sample)
        except zstandard.ZstdError:  # records too alike or too short
            words = None
    out = []
    if words is not None:
        packed = zstandard.ZstdCompressor(level=3).compress(words.as_bytes())
        out.append(struct.pack("<II", SKIPPABLE, len(packed)) + packed)
    pack = zstandard.ZstdCompressor(level=3, dict_data=words, write_checksum=True)
    out += [pack.compress(x) for x in records]
    return b"".join(out)


def frame_end(raw: bytes, at: int) -> int:
    """End of the Zstandard frame that begins at a place; raises ValueError if it is cut off."""
    if len(raw) < at + 6 or struct.unpack_from("<I", raw, at)[0] != FRAME:
        raise ValueError(f"no frame at byte {at}")
    flags = raw[at + 4]
    single = flags >> 5 & 1
    p = at + 5 + (0 if single else 1) + (0, 1, 2, 4)[flags & 3] + ((1 if single else 0), 2, 4, 8)[flags >> 6]
    while True:
        if p + 3 > len(raw):
            raise ValueError("a frame is cut off")
        block = int.from_bytes(raw[p : p + 3], "little")
        kind, size = block >> 1 & 3, block >> 3
        if kind == 3:
            raise ValueError("a block of a reserved kind")
        p += 3 + (1 if kind == 1 else size)
        if block & 1:
            break
    p += 4 * (flags >> 2 & 1)
    if p > len(raw):
        raise ValueError("a frame is cut off")
    return p


def frames(raw: bytes) -> Iterator[bytes]:
    """The decoded frames of an archive, one record each."""
    at, words = 0, None
    if len(raw) >= 8 and struct.unpack_from("<I", raw, 0)[0] == SKIPPABLE:
        at = 8 + struct.unpack_from("<I", raw, 4)[0]
        if at > len(raw):
            raise ValueError("the dictionary is cut off")
        held = raw[8:at]
        if held[:4] == struct.pack("<I", FRAME):
            held = zstandard.ZstdDecompressor().decompress(held)
        words = zstandard.ZstdCompressionDict(held)
    unpack = zstandard.ZstdDecompressor(dict_data=words)
    while at < len(raw):
        end = frame_end(raw, at)
        yield unpack.decompress(raw[at:end])
        at = end


def parsed(raw: bytes) -> dict:
    """Fields and payload of one record; raises ValueError if headers, lengths or digests are wrong."""
    head, gap, rest = raw.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not gap or lines[0] != VERSION:
        raise ValueError("not a WARC/1.1 record")
    fields = {}
    for line in lines[1:]:
        name, colon, value = line.partition(b":")
        if not colon or not name or name.strip() != name:
            raise ValueError(f"a header that isn't one: {line!r}")
        fields[name.decode("ascii").lower()] = value.strip().decode()
    missing = [k for k in ("warc-type", "warc-record-id", "warc-date", "content-length") if k not in fields]
    if missing or not fields["content-length"].isdigit():
        raise ValueError(f"missing or wrong: {missing or ['content-length']}")
    size = int(fields["content-length"])
    if len(rest) != size + 4 or rest[size:] != b"\r\n\r\n":
        raise ValueError(f"the block has {len(rest) - 4} bytes, its header says {size}")
    block = rest[:size]
    if "warc-block-digest" in fields and fields["warc-block-digest"] != f"sha1:{digest(block)}":
        raise ValueError("the block doesn't match its digest")
    http, gap, payload = block.partition(b"\r\n\r\n")
    length = [int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")]
    if not gap or len(length) != 1:
        raise ValueError("no HTTP head with one Content-Length")
    own = fields.get("warc-payload-digest", "").removeprefix("sha1:")
    if fields["warc-type"] == "response":
        if len(payload) != length[0] or digest(payload) != own:
            raise ValueError("the payload doesn't match its length or digest")
    elif fields["warc-type"] != "revisit" or payload or "warc-refers-to" not in fields:
        raise ValueError("neither a response nor a revisit")
    return {"key": key_of(fields["warc-record-id"]), "url": fields.get("warc-target-uri", ""), "record_type": fields["warc-type"], "payload_bytes": length[0], "payload_digest": own, "refers_to": key_of(fields["warc-refers-to"]) if "warc-refers-to" in fields else None, "payload": payload if fields["warc-type"] == "response" else None}


def _place(folder: str):
    """File system and path of a folder's URI."""
    from pyarrow.fs import FileSystem

    return FileSystem.from_uri(folder)


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_bytes: int = 0) -> DataFrame:
    """Writes all rows as archives into the shared folder; returns archive (its name), records and bytes.

    An archive is written under another name and then moved, so a task that runs twice leaves one.
    """
    rows = pages.select(F.col(id_col).cast("string").alias("key"), F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), F.encode(F.coalesce(F.col(html_col), F.lit("")), "UTF-8").alias("html"))
    rows = rows.withColumn("sha", F.unhex(F.sha1("html")))
    brief = rows.filter(F.octet_length("html") >= min_bytes).select("id", "sha")
    first = brief.groupBy("sha").agg(F.min("id").alias("first"), F.count("*").alias("n")).filter("n > 1 AND first IS NOT NULL").select("sha", "first")
    again = brief.join(first, "sha").filter(~F.col("id").eqNullSafe(F.col("first"))).select(F.col("id").alias("r_id"), F.col("sha").alias("r_sha"), F.col("first").cast("string").alias("refers"))
    again = stored(again.distinct(), "warc-revisits")  # of small rows, so that payloads needn't be shuffled to find it
    few = again.agg(F.count("*"), F.sum(F.length(F.coalesce(F.col("r_id").cast("string"), F.lit("")))), F.sum(F.length("refers"))).first()
    light = few[0] * 100 + (few[1] or 0) + (few[2] or 0) <= LIGHT_BYTES
    rows = rows.join(F.broadcast(again) if light else again, F.col("id").eqNullSafe(F.col("r_id")) & (F.col("sha") == F.col("r_sha")), "left")

    def run(batches):
        from pyspark import TaskContext

        part, made, held, size = TaskContext.get().partitionId(), [], [], 0
        fs, path = _place(folder)

        def flush() -> None:
            nonlocal held, size
            raw = archive(held)
            name, hidden = f"part-{part:06d}-{len(made):04d}.warc.zst", f"{path}/.{uuid.uuid4().hex}"
            fs.create_dir(path, recursive=True)
            with fs.open_output_stream(hidden, compression=None) as f:
                f.write(raw)
            fs.move(hidden, f"{path}/{name}")
            made.append((name, len(held), len(raw)))
            held, size = [], 0

        for batch in batches:
            for key, url, html, refers in zip(*(batch.column(c).to_pylist() for c in ("key", "url", "html", "refers")), strict=True):
                held.append(record(key, url, html, refers))
                size += len(html) + 600
                if size >= ARCHIVE_BYTES:
                    flush()
        if held:
            flush()
        yield pa.RecordBatch.from_arrays([pa.array([m[0] for m in made], pa.string()), pa.array([m[1] for m in made], pa.int64()), pa.array([m[2] for m in made], pa.int64())], ["archive", "records", "bytes"])

    return stored(rows.select("key", "url", "html", "refers").mapInArrow(run, "archive string, records long, bytes long"), "warc-list")


def read_archives(archives: DataFrame, folder: str, with_payload: bool = True) -> DataFrame:
    """key, url, record_type, payload_bytes, payload_digest, refers_to and payload of every record, checked; archives has their names."""
    names = ("key", "url", "record_type", "payload_bytes", "payload_digest", "refers_to", "payload")
    kinds = (pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.binary())
    spark = archives.sparkSession
    n = archives.count()

    def run(batches):
        fs, path = _place(folder)
        for batch in batches:
            for name, records in zip(batch.column("archive").to_pylist(), batch.column("records").to_pylist(), strict=True):
                with fs.open_input_stream(f"{path}/{name}", compression=None) as f:
                    raw = f.read()
                held, size, seen = [], 0, 0

                def out(rows: list[dict]) -> pa.RecordBatch:
                    return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], k) for c, k in zip(names, kinds, strict=True)], list(names))

                for frame in frames(raw):
                    row = parsed(frame)
                    if not with_payload:
                        row["payload"] = None
                    held.append(row)
                    size, seen = size + len(frame), seen + 1
                    if size >= 1 << 22:
                        yield out(held)
                        held, size = [], 0
                if held:
                    yield out(held)
                if seen != records:
                    raise ValueError(f"{name} has {seen} records, {records} were written")

    dealt = archives.repartition(max(1, min(n, 4 * spark.sparkContext.defaultParallelism)))
    return dealt.mapInArrow(run, "key string, url string, record_type string, payload_bytes long, payload_digest string, refers_to string, payload binary")


def query(spark, sf_dir: str) -> DataFrame:
    """op5: every page written to archives and read back."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    folder, kind = shared_dir(spark, "warc"), pages.schema["page_id"].dataType
    rows = read_archives(write_archives(pages, folder), folder, with_payload=False)
    return rows.select(F.col("key").cast(kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to"))
