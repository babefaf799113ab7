"""Plain versions of the operators' results, for small tables."""

from __future__ import annotations

import re
from collections import Counter

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def counts(text: str | None) -> tuple[int, int, int, int, int]:
    text = text or ""
    w = WORD.findall(text)
    windows = list(zip(w, w[1:], w[2:], strict=False))
    often, cover = Counter(windows), set()
    for k, t in enumerate(windows):
        if often[t] > 1:
            cover |= {k, k + 1, k + 2}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), dup, len(cover)


def shingles(text: str | None) -> set:
    w = WORD.findall((text or "").translate(LOW))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def components(rows: list[tuple]) -> list[tuple]:
    """(id, n_shingles, component) of rows (id, text)."""
    sets, n = [shingles(t) for _, t in rows], len(rows)
    up = list(range(n))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(n):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if sets[i] and 100 * common >= 85 * (len(sets[i]) + len(sets[j]) - common):
                up[root(i)] = root(j)
    best: dict = {}
    for i, (key, _) in enumerate(rows):
        r = root(i)
        best[r] = key if best.get(r) is None else best[r] if key is None else min(best[r], key)
    return [(key, len(sets[i]), best[root(i)] if sets[i] else key) for i, (key, _) in enumerate(rows)]


def repeated(texts: list[str | None], span: int = 400) -> list[tuple[int, int, int, bytes]]:
    """(bytes, removed, spans, what is left) of each text."""
    raw = [(t or "").encode() for t in texts]
    often = Counter(b[p : p + span] for b in raw for p in range(len(b) - span + 1))
    out = []
    for b in raw:
        cover = bytearray(len(b))
        for p in range(len(b) - span + 1):
            if often[b[p : p + span]] > 1:
                cover[p : p + span] = b"\1" * span
        out.append((len(b), sum(cover), len(re.findall(b"\1+", bytes(cover))), bytes(c for c, v in zip(b, cover, strict=True) if not v)))
    return out


def without_passages(texts: list[str | None], span: int, words: int) -> list[str]:
    """Texts without the maximal covered runs in which so many words begin."""
    raw = [(t or "").encode() for t in texts]
    often = Counter(b[p : p + span] for b in raw for p in range(len(b) - span + 1))
    space, out = b" \t\n\x0b\x0c\r", []
    for b in raw:
        cover = bytearray(len(b))
        for p in range(len(b) - span + 1):
            if often[b[p : p + span]] > 1:
                cover[p : p + span] = b"\1" * span
        left, at = b"", 0
        for m in re.finditer(b"\1+", bytes(cover)):
            begins = sum(b[i] not in space and (i == 0 or b[i - 1] in space) for i in range(m.start(), m.end()))
            if begins >= words:
                left, at = left + b[at : m.start()], m.end()
        out.append((left + b[at:]).decode("utf-8", "ignore"))
    return out
