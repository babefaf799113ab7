"""Toxicity: a learned lexicon, Levenshtein automata over its trie, and scores of context windows.

The lexicon holds the words that mark toxic documents among the training rows. Its trie, intersected with the Levenshtein automaton of one edit, is made one deterministic
automaton, which all distinct words of a batch run through at once; a misspelling must not be a
word of clean training texts. Hits are weighed in a window of words around them (other hits,
quotation marks, reporting verbs), and a logistic model of the window features gives the score.

Training rows are those whose CRC-32 of the id as text leaves another remainder than HELD by 3.
Labels, language, source and id are never features.

Defined results: a null or empty text has no hits and gets the score of such texts; repeated rows
are scored each; an empty table gives an empty result; without training rows every score is 0;
null labels are not used; of rows of one id in labels the largest counts; hashes of ids that tie are in the
sample or out of it together; a very long text is scored whole, in time in proportion to its words;
other columns of any name are ignored.
"""

from __future__ import annotations

import re
from collections import Counter, deque
from collections.abc import Collection

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hash_below, per_slice, stored

HELD, WINDOW = 1, 8
#: Training rows at most.
TRAIN_ROWS = 60_000
#: Toxic training texts that a word of the lexicon is in at least, and its least code points to be misspelled.
LEAST, FUZZY = 3, 4
#: Quotation marks, and verbs of reporting and calling.
QUOTES = "\"“”„«»‘’"
REPORTING = frozenset("said says wrote called quoted reported quote word term dit sagte dijo".split())
_WORD = re.compile(r"\w+")
FEATURES = 9


def lexicon_of(table: list[tuple[str, int, int]], positives: int, negatives: int) -> dict[str, float]:
    """Log-odds of the words that mark toxic texts: table has each word's toxic texts and others.

    A word counts if the odds of it are surely higher in toxic texts: by a factor of e or more, two standard errors
    down, and in toxic texts nine times as often as in others. The rule is the same at any number of texts.
    """
    out = {}
    for word, pos, neg in table:
        odds = float(np.log((pos + 0.5) / (positives + 1)) - np.log((neg + 0.5) / (negatives + 1)))
        if pos >= LEAST and pos >= 9 * neg and odds - 2 * (1 / (pos + 0.5) + 1 / (neg + 0.5)) ** 0.5 >= 1:
            out[word] = odds
    return out


class Automaton:
    """Accepts the lexicon's words exactly (2), and those of FUZZY letters or more with one edit (1); inside, words end with an end mark."""

    def __init__(self, lexicon: Collection[str]) -> None:
        nodes: list[dict[str, int]] = [{}]
        exact, fuzzy = set(), set()
        terms = sorted(w + "$" for w in lexicon)
        for term in terms:
            at = 0
            for c in term:
                if c not in nodes[at]:
                    nodes[at][c] = len(nodes)
                    nodes.append({})
                at = nodes[at][c]
            exact.add(at)
            if len(term) > FUZZY:
                fuzzy.add(at)
        self.letters = {c: i for i, c in enumerate(sorted({c for n in nodes for c in n} | {"$"}))}
        other = len(self.letters)
        self.longest = max((len(t) for t in terms), default=0) + 1
        # children of a node from which a fuzzy end can be reached: only there is an edit worth its branch
        alive = [False] * len(nodes)
        for i in range(len(nodes) - 1, -1, -1):
            alive[i] = i in fuzzy or any(alive[k] for k in nodes[i].values())

        def close(states: set[tuple[int, int]]) -> frozenset:
            more = set(states)
            for node, edit in states:
                if edit == 0:
                    more |= {(k, 1) for c, k in nodes[node].items() if c != "$" and alive[k]}  # a letter left out
            return frozenset(s for s in more if not (s[1] == 1 and (s[0], 0) in more))

        def step(states: frozenset, c: str | None) -> frozenset:
            out = set()
            for node, edit in states:
                if c in nodes[node]:
                    out.add((nodes[node][c], edit))
                if edit == 0 and c != "$" and alive[node]:
                    out.add((node, 1))  # one letter too many
                    out |= {(k, 1) for x, k in nodes[node].items() if x != "$" and alive[k]}  # another letter
            return close(out)

        start = close({(0, 0)})
        number, todo, table = {start: 0}, deque([start]), []
        while todo:
            states = todo.popleft()
            row = []
            for c in [*self.letters, None]:
                after = step(states, c)
                if after not in number:
                    number[after] = len(number)
                    todo.append(after)
                row.append(number[after])
            table.append(row)
        self.table = np.array(table, np.int32).reshape(-1, other + 1)
        self.accepts = np.zeros(len(number), np.int8)
        for states, i in number.items():
            self.accepts[i] = 2 if any(n in exact and e == 0 for n, e in states) else 1 if any(n in fuzzy and e == 1 for n, e in states) else 0
        self.dead = number.get(frozenset(), -1)
        self.classes = np.full(0x110000, other, np.int32)
        for c, i in self.letters.items():
            self.classes[ord(c)] = i

    def run(self, words: list[str]) -> np.ndarray:
        """2 (a word of the lexicon), 1 (one misspelled) or 0 for each word."""
        if not words or not self.longest:
            return np.zeros(len(words), np.int8)
        text = np.array([(w + "$")[: self.longest] for w in words])
        code = text.view(np.uint32).reshape(len(words), -1)
        state, best = np.zeros(len(words), np.int32), np.zeros(len(words), np.int8)
        at = np.arange(len(words))
        for k in range(code.shape[1]):
            at = at[code[at, k] != 0]
            state[at] = self.table[state[at], self.classes[code[at, k]]]
            best[at] = np.maximum(best[at], self.accepts[state[at]])
            at = at[state[at] != self.dead]
        return best


def features(text: str, level: dict[str, int]) -> list[float]:
    """Of a text with hits: the features of its windows; level: 2 or 1 of its words that are hits."""
    text = text.lower()  # places are of the lower-cased text, which may be longer
    words = [(m.group(), m.start(), m.end()) for m in _WORD.finditer(text)]
    at = [(i, level[w]) for i, (w, _, _) in enumerate(words) if w in level]
    full = [i for i, v in at if v == 2]
    windows, quoted, reported, close = [], 0, 0, 0
    lone = np.array([i for i, _ in at])
    around = np.searchsorted(lone, lone + WINDOW, "right") - np.searchsorted(lone, lone - WINDOW) - 1
    for (i, v), near in zip(at, around.tolist(), strict=True):
        a, b = words[max(0, i - WINDOW)][1], words[min(len(words) - 1, i + WINDOW)][2]
        before, after = text[a : words[i][1]], text[words[i][2] : b]
        in_quotes = sum(before.count(q) for q in QUOTES) % 2 == 1 and any(q in after for q in QUOTES)
        told = any(w in REPORTING for w, _, _ in words[max(0, i - 3) : i])
        quoted, reported, close = quoted + in_quotes, reported + told, close + (near > 0)
        windows.append((1.0 if v == 2 else 0.5) * (0.3 if in_quotes else 1) * (0.6 if told else 1) * (1 + 0.5 * min(near, 3)))
    n = max(len(at), 1)
    kinds = len({words[i][0] for i in full})
    return [float(bool(full)), float(np.log1p(len(full))), float(np.log1p(kinds)), float(np.log1p(len(at) - len(full))), float(max(windows, default=0)), float(np.log1p(sum(windows))), quoted / n, reported / n, min(1.0, 20.0 * len(at) / max(len(words), 1))]


def measured(texts: list[str], automaton: Automaton, clean: frozenset[str]) -> np.ndarray:
    """A row of features for each text; misspellings that clean training texts have too don't count."""
    known: dict[str, int] = {}
    each = [sorted({known.setdefault(w, len(known)) for w in _WORD.findall(t.lower())}) for t in texts]
    words = list(known)
    found = automaton.run(words)
    for i in np.flatnonzero(found == 1).tolist():
        if words[i] in clean:
            found[i] = 0
    hit = set(np.flatnonzero(found).tolist())
    out = np.zeros((len(texts), FEATURES))
    for r, (text, own) in enumerate(zip(texts, each, strict=True)):
        mine = [i for i in own if i in hit] if hit else []
        if mine:
            out[r] = features(text, {words[i]: int(found[i]) for i in mine})
    return out


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 60) -> np.ndarray:
    """Weights, bias last, by Newton steps with a ridge."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-3
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty), x.T @ (y - p) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def model_of(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, rows: int = TRAIN_ROWS):
    """Automaton, misspellings that clean texts have, and weights.

    At most about `rows` labelled rows train it, chosen by a hash of the id; words are counted on the
    executors, and those of LEAST toxic texts that are rare in others come to the driver: no more than that sample has.
    """
    given = labels.filter(F.col(label_col).isNotNull()).select(F.col(id_col).alias("l_id"), F.col(label_col).cast("int").alias("y"))
    given = given.filter(F.pmod(F.crc32(F.col("l_id").cast("string")), F.lit(3)) != HELD).groupBy("l_id").agg(F.max("y").alias("y"))
    given = stored(given, "toxic-labels")
    total = given.count()
    share = min(1.0, rows / max(total, 1))
    given = given.withColumn("l_hash", F.xxhash64("l_id")).filter(hash_below("l_hash", share)).drop("l_hash")
    train = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(given, F.col("id") == F.col("l_id")).select("text", "y")
    train = stored(train, "toxic-train")

    def counted(batch: pa.RecordBatch) -> dict:
        pos: Counter = Counter()
        neg: Counter = Counter()
        for text, y in zip(batch.column("text").to_pylist(), batch.column("y").to_pylist(), strict=True):
            (pos if y == 1 else neg).update(set(_WORD.findall((text or "").lower())))
        words = list(pos | neg)
        return {"word": words, "pos": [pos[w] for w in words], "neg": [neg[w] for w in words]}

    sides = {r.y: r.n for r in train.groupBy("y").agg(F.count("*").alias("n")).collect()}
    positives, negatives = sides.get(1, 0), sum(n for y, n in sides.items() if y != 1)
    if not positives or not negatives:
        return None
    sums = per_slice(train, "text", counted, "word string, pos long, neg long").groupBy("word").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    table = sums.filter((F.col("pos") >= LEAST) & (F.col("pos") >= 9 * F.col("neg"))).collect()
    automaton = Automaton(lexicon_of([(r.word, r.pos, r.neg) for r in table], positives, negatives))

    def misspelled(batch: pa.RecordBatch) -> dict:
        words = sorted({w for text, y in zip(batch.column("text").to_pylist(), batch.column("y").to_pylist(), strict=True) if y != 1 for w in _WORD.findall((text or "").lower())})
        return {"word": [w for w, v in zip(words, automaton.run(words).tolist(), strict=True) if v == 1]}

    clean = frozenset(r.word for r in per_slice(train, "text", misspelled, "word string").distinct().collect())

    def rows_of(batch: pa.RecordBatch) -> dict:
        x = measured([t or "" for t in batch.column("text").to_pylist()], automaton, clean)
        return {"x": x.tolist(), "y": batch.column("y")}

    known = per_slice(train, "text", rows_of, "x array<double>, y int").groupBy("x", "y").agg(F.count("*").alias("n")).toPandas()
    x, y, n = np.array(known["x"].tolist()), (known["y"] == 1).to_numpy(float), known["n"].to_numpy()
    return automaton, clean, logistic(np.repeat(x, n, 0), np.repeat(y, n))


def scored(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", cut: float = 0.7) -> DataFrame:
    """id_col, held_out, score and predicted of each row of docs."""
    kind = docs.schema[id_col].dataType.simpleString()
    model = model_of(docs, labels, id_col, text_col, label_col)

    def kernel(batch: pa.RecordBatch) -> dict:
        texts = [t or "" for t in batch.column("text").to_pylist()]
        if model is None:
            return {"id": batch.column("id"), "score": np.zeros(len(texts))}
        automaton, clean, w = model
        x = measured(texts, automaton, clean)
        return {"id": batch.column("id"), "score": 1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -30, 30)))}

    rows = per_slice(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), "text", kernel, f"id {kind}, score double")
    held = F.coalesce(F.pmod(F.crc32(F.col("id").cast("string")), F.lit(3)) == HELD, F.lit(False))
    return rows.select(F.col("id").alias(id_col), held.alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"))


def query(spark, sf_dir: str) -> DataFrame:
    """op10: toxicity of every document."""
    return scored(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
