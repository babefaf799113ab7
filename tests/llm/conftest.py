import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).parent))
import random

import pytest

WORDS = ["".join(random.Random(i).choices("etaoinshrdlu", k=2 + i % 7)) for i in range(300)]


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choices(WORDS, k=n))


@pytest.fixture(scope="session")
def texts():
    """Copies, near copies, shared passages, periodic and odd texts, empty ones and null."""
    base, passage = prose(1, 160), prose(2, 90)
    near = base.split(" ")
    near[40] = "other"
    far = base.split(" ")
    far[::9] = ["x"] * len(far[::9])
    return [
        base, base, base.upper(), " ".join(near), " ".join(far), prose(3, 60) + "\n" + passage + "\n" + prose(4, 50), passage + " " + prose(5, 120), prose(6, 40) + " " + passage, "ab" * 700, "a" * 401, "a" * 400, "a" * 399,
        "", None, " \t\n ", "one two", "One  two", "one two three four five", prose(7, 30) + "\n" + prose(8, 8) + "\n" + prose(8, 8), "é" * 300 + "漢字🙂 ñandú", prose(9, 5000), prose(9, 5000)[:-7] + " end of it", "### $$ %%\n### $$ %%\n### $$ %%\n| a | b |", "\x00\x1c nul x", prose(10, 70),
    ]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, cls long, key long, k_id long, spans string, size int, label string, k_spans int"


@pytest.fixture(scope="session")
def rows(texts):
    out = [(i, t, ["en", "de", None][i % 3], ["s1", "s0", None, "s2"][i % 4] if i != 7 else None, len(t or ""), "x", 1, 2, 3, "y", 4, "z", 5) for i, t in enumerate(texts)]
    return out + [out[0], out[5], (None, prose(11, 80), None, None, None, *out[0][5:]), (3, prose(12, 70), "en", "s1", 3, *out[0][5:])]


@pytest.fixture(scope="session")
def docs(spark, rows):
    """Rows with repeats, a null and a doubled id, and columns whose names operators use inside."""
    return spark.createDataFrame(rows, SCHEMA).repartition(5).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
