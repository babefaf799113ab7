"""BPE encoding and decoding with batched numpy merge rounds.

The symbols of many words lie in one flat array. In each round the rank of every
adjacent pair is found by binary search over the sorted pair keys, each word merges
all its pairs of lowest rank, and words without a known pair leave the array.

Defined results: a null or empty text has no ids and decodes to an empty text;
repeated rows are encoded each; an empty table gives an empty result; other columns
of any name are ignored. Special strings in a text become their ids, as in the library.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import flat, per_slice

#: Fixed value: the pattern that cuts a text into words before byte-level merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Distinct words whose ids a worker remembers at most.
REMEMBERED = 300_000


def byte_letters() -> list[str]:
    """The letter that stands for each byte: itself if printable Latin-1, else the next free one from U+0100."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b if b in plain else next(spare)) for b in range(256)]


def ranges(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """start[0], start[0]+1, ... length[0] of them, then those of start[1], and so on."""
    begin = np.cumsum(length) - length
    return np.repeat(start - begin, length) + np.arange(int(length.sum()))


class Bpe:
    """A byte-level BPE vocabulary in the `tokenizers` JSON format."""

    def __init__(self, source: str) -> None:
        spec = json.loads(source)
        vocab, letters = spec["model"]["vocab"], byte_letters()
        self.v = max([*vocab.values(), *(t["id"] for t in spec["added_tokens"])]) + 1
        self.first = np.array([vocab[c] for c in letters], np.int64)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        key = np.array([vocab[a] * self.v + vocab[b] for a, b in pairs], np.int64)
        into = np.array([vocab[a + b] for a, b in pairs], np.int64)
        order = np.argsort(key, kind="stable")
        self.keys, self.ranks, self.into = key[order], order.astype(np.int64), into[order]
        byte_of = {c: b for b, c in enumerate(letters)}
        raw = [b""] * self.v
        for text, i in vocab.items():
            raw[i] = bytes(byte_of[c] for c in text)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        for text, i in self.special.items():
            raw[i] = text.encode()
        self.bytes, size = np.frombuffer(b"".join(raw), np.uint8), np.array([len(x) for x in raw], np.int64)
        self.size, self.at = size, np.cumsum(size) - size
        self.cut = regex.compile("(" + "|".join(regex.escape(t) for t in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self.words = regex.compile(PATTERN)
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.ids, self.ends = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def merged(self, sym: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merges the symbols of each word (numbers that rise along the array) until no known pair is left."""
        done_sym, done_word, top = [], [], len(self.keys)
        while len(sym):
            n = len(sym)
            begin = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            at = np.searchsorted(self.keys, key := sym[:-1] * self.v + sym[1:])
            at[at == top] = 0
            rank = np.full(n, top, np.int64)
            rank[:-1][hit] = self.ranks[at[hit]] if (hit := (word[1:] == word[:-1]) & (self.keys[at] == key)).any() else 0
            best = np.minimum.reduceat(rank, begin)
            length = np.diff(np.append(begin, n))
            live = np.repeat(best < top, length)
            pick = live & (rank == np.repeat(best, length))
            if not live.all():
                done_sym.append(sym[~live])
                done_word.append(word[~live])
            if not pick.any():
                break
            where = np.arange(n)
            fresh = pick.copy()
            fresh[1:] &= ~pick[:-1]
            pick &= (where - np.maximum.accumulate(np.where(fresh, where, 0))) % 2 == 0  # aaa: the left pair
            left = np.flatnonzero(pick)
            sym = sym.copy()
            sym[left] = self.into[at[left]]
            live[left + 1] = False
            sym, word = sym[live], word[live]
        if not done_sym:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        sym, word = np.concatenate(done_sym), np.concatenate(done_word)
        order = np.argsort(word, kind="stable")
        return sym[order], word[order]

    def learn(self, words: list[str]) -> None:
        """Adds new words, with their ids, to the known ones."""
        raw = [w.encode() for w in words]
        size = np.array([len(x) for x in raw], np.int64)
        sym, word = self.merged(self.first[np.frombuffer(b"".join(raw), np.uint8)], np.repeat(np.arange(len(raw)), size))
        self.ids = np.concatenate([self.ids, sym.astype(np.int32)])
        self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(np.bincount(word, minlength=len(raw)))])

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in one array, and offsets, one more than texts."""
        if len(self.known) > REMEMBERED:
            self.forget()
        known, had, index, count = self.known, len(self.known), [], []
        specials: list[tuple[int, int]] = []
        for text in texts:
            before = len(index)
            if self.cut and any(t in text for t in self.special):
                for k, part in enumerate(self.cut.split(text)):
                    if k % 2:
                        specials.append((len(index), self.special[part]))
                        index.append(-1)
                    else:
                        index += [known.setdefault(w, len(known)) for w in self.words.findall(part)]
            else:
                index += [known.setdefault(w, len(known)) for w in self.words.findall(text)]
            count.append(len(index) - before)
        if len(known) > had:
            self.learn(list(known)[had:])
        at = np.array(index, np.int64)
        size = (self.ends[at + 1] - self.ends[at]) if len(at) else at
        for k, _ in specials:
            size[k] = 1
        first = self.ends[at]
        for k, _ in specials:
            first[k] = 0
        ids = self.ids[ranges(first, size)] if len(self.ids) else np.zeros(int(size.sum()), np.int32)
        ends = np.concatenate([[0], np.cumsum(size)])
        for k, i in specials:
            ids[ends[k]] = i
        return ids, ends[np.concatenate([[0], np.cumsum(np.array(count, np.int64))])]

    def decode(self, ids: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of all texts in one array, and offsets."""
        size = self.size[ids]
        ends = np.concatenate([[0], np.cumsum(size)])
        return self.bytes[ranges(self.at[ids], size)], ends[off]


_made: dict[int, Bpe] = {}


def _bpe(source: str) -> Bpe:
    """One vocabulary for each worker process."""
    if hash(source) not in _made:
        _made.clear()
        _made[hash(source)] = Bpe(source)
    return _made[hash(source)]


def _texts(data: np.ndarray, off: np.ndarray) -> pa.Array:
    """Strings; bytes that aren't UTF-8 become U+FFFD."""
    raw = pa.Array.from_buffers(pa.large_binary(), len(off) - 1, [None, pa.py_buffer(off.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))])
    try:
        return raw.cast(pa.large_string())
    except pa.ArrowInvalid:
        return pa.array([x.decode("utf-8", "replace") for x in raw.to_pylist()], pa.large_string())


def _source(path: str) -> str:
    with open(path, encoding="utf-8") as f:  # the driver's file; its text goes with the tasks
        return f.read()


def encode(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", decoded: bool = False) -> DataFrame:
    """id_col and ids of each row; with decoded, also the text that the ids give again."""
    source, kind = _source(path), df.schema[id_col].dataType.simpleString()

    def kernel(batch: pa.RecordBatch) -> dict:
        bpe = _bpe(source)
        ids, off = bpe.encode([x or "" for x in batch.column("text").to_pylist()])
        out = {id_col: batch.column("id"), "ids": pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(ids, pa.int32()))}
        return out | ({"decoded": _texts(*bpe.decode(ids, off))} if decoded else {})

    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return per_slice(rows, "text", kernel, f"`{id_col}` {kind}, ids array<int>" + ", decoded string" * decoded)


def decode(df: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """id_col and the text of each row's ids; null ids give an empty text."""
    source, kind = _source(path), df.schema[id_col].dataType.simpleString()

    def run(batches):
        for batch in batches:
            bpe, lists = _bpe(source), batch.column("ids")
            size = np.array([len(x) if x is not None else 0 for x in lists.to_pylist()], np.int64)
            ids = np.asarray(lists.flatten()).astype(np.int64)
            text = _texts(*bpe.decode(ids, np.concatenate([[0], np.cumsum(size)])))
            yield pa.RecordBatch.from_arrays([batch.column("id"), text.cast(pa.string())], [id_col, "decoded"])

    rows = df.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids"))
    return rows.mapInArrow(run, f"`{id_col}` {kind}, decoded string")


def digests(rows: DataFrame) -> list:
    """Columns of op2 from ids and decoded."""
    return [F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"), F.sha2(F.col("decoded"), 256).alias("decoded_sha256")]


def _path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def query(spark, sf_dir: str) -> DataFrame:
    """op2: every whole text, encoded and decoded."""
    rows = encode(spark.read.parquet(f"{sf_dir}/documents.parquet"), _path(), decoded=True)
    return rows.select("doc_id", *digests(rows))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage, the last: ids of every document that is left."""
    return encode(docs, _path())
