"""Operator 8: toxicity by a weighted lexicon that an Aho-Corasick automaton matches in folded text.

Folding lower-cases, maps look-alike letters of other scripts to Latin ones, drops invisible characters, reads digits
and signs inside words as the letters that they stand for, and leaves words with single spaces between. The lexicon
(whole words and beginnings of words) and its weights are log odds learned from labelled documents, as are exception
phrases: two words, one of them matched, that stand in clean documents. A match inside an exception phrase counts
nothing. The sum of weights, as it is and by length of text, gives the score through a logistic curve.

Learning takes TRAIN labelled documents of each class at most (the first by a hash of their id), which bounds the lexicon:
an entry is in 2 percent of the toxic ones, a phrase in four clean ones. Everything else covers all rows. Defined results: null or empty text has no matches and gets the score of such a text; without labelled
documents of both classes every score is 0. Labels that contradict each other count as toxic. Repeated rows are scored
each. The score depends on the text alone.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, discard, materialize, steps

#: Documents of each class that learning takes at most.
TRAIN = 4000
PREFIXES = range(4, 8)
LEAST_ODDS = 2.5

# Letters of other scripts that look like Latin ones, and signs that stand for letters.
LOOKALIKE = {
    "а": "a", "в": "b", "е": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "ӏ": "l", "ɡ": "g",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ω": "w", "ı": "i", "ℓ": "l",
}
SIGNS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i"}

_TABLE = {c: " " for c in range(128) if not chr(c).isalpha()}
_TABLE |= {ord(k): v for k, v in LOOKALIKE.items()} | {0xFF41 + i: chr(97 + i) for i in range(26)} | {c: None for c in (0xAD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF)}
_TABLE |= {c: " " for c in (0x2013, 0x2014, 0x2018, 0x2019, 0x201C, 0x201D, 0x2026, 0xAB, 0xBB, 0xA1, 0xBF)}
_MIXED = re.compile(r"(?<![^\W\d_])[013-578@$]*[^\W\d_](?:[^\W\d_]|[013-578@$!](?=[^\W\d_0-9@$])|[013-578@$](?![\w@$]))*")
_SIGNED = re.compile(r"[^\W\d_][013-578@$!]+[^\W\d_]|(?<!\w)[013-578@$]+[^\W\d_]{2}|[^\W\d_]{2}[013-578@$](?![\w@$])")
_SIGN_TABLE = str.maketrans(SIGNS)


def fold(text: str | None) -> str:
    """Words with a space before, between and after."""
    text = (text or "").lower()
    if _SIGNED.search(text):
        text = _MIXED.sub(lambda m: m[0].translate(_SIGN_TABLE), text)
    return " " + " ".join(text.translate(_TABLE).split()) + " "


@dataclass
class Model:
    weights: dict[str, float] = field(default_factory=dict)  # " word " or " beginning"
    exceptions: tuple[str, ...] = ()  # " word word "
    curve: tuple[float, ...] = ()

    def automaton(self):
        import ahocorasick

        a = ahocorasick.Automaton()
        for w, x in self.weights.items():
            a.add_word(w, (len(w), x))
        for w, x in self.weights.items():  # a 1 may have stood for l
            if "l" in w and (other := w.replace("l", "i")) not in self.weights:
                a.add_word(other, (len(w), x))
        for w in self.exceptions:
            a.add_word(w, (len(w), None))
        if len(a):
            a.make_automaton()
        return a


def matches(automaton, folded: str) -> list[tuple[int, int, float]]:
    """(begin, end, weight) of lexicon matches, the heaviest of those that begin with one word, without those that an
    exception phrase covers."""
    if not len(automaton):
        return []
    best: dict[int, tuple[int, float]] = {}
    free = []
    for end, (n, weight) in automaton.iter(folded):
        begin = end - n + 1
        if weight is None:
            free.append((begin, end))
        elif begin not in best or weight > best[begin][1]:
            best[begin] = (end, weight)
    return [(b, e, w) for b, (e, w) in best.items() if not any(x <= b and e <= y for x, y in free)]


def features(total: float, words: int) -> list[float]:
    return [1.0, math.log1p(total), math.log1p(100 * total / (words + 20))]


def score(model: Model, automaton, text: str | None) -> float:
    if not model.curve:
        return 0.0
    folded = fold(text)
    x = features(sum(w for _, _, w in matches(automaton, folded)), folded.count(" ") - 1)
    z = sum(a * b for a, b in zip(x, model.curve, strict=True))
    return 1 / (1 + math.exp(-max(-40.0, min(40.0, z))))


def _counts(rows: DataFrame, kernel) -> DataFrame:
    """Documents of each class that hold a feature: counted in each task, then summed: (f, n0, n1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = (Counter(), Counter())

        def out() -> pa.RecordBatch:
            keys = list(seen[0].keys() | seen[1].keys())
            got = pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), *(pa.array([c[k] for k in keys], pa.int64()) for c in seen)], ["f", "n0", "n1"])
            seen[0].clear()
            seen[1].clear()
            return got

        for b in steps(batches):
            for t, toxic in zip(column(b, "text").to_pylist(), column(b, "toxic").to_pylist(), strict=True):
                seen[toxic].update(kernel(fold(t)))
                if len(seen[0]) + len(seen[1]) > 100_000:
                    yield out()
        if seen[0] or seen[1]:
            yield out()

    return rows.mapInArrow(run, "f string, n0 long, n1 long").groupBy("f").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))


def fit(docs: DataFrame, labels: DataFrame, train: int = TRAIN) -> Model:
    usable = labels.select(F.col("doc_id"), F.col("toxic").cast("int").alias("toxic")).filter("doc_id IS NOT NULL AND toxic IN (0, 1) AND crc32(CAST(doc_id AS string)) % 5 <> 0")
    sizes = {r["toxic"]: r["n"] for r in usable.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if len(sizes) < 2:
        return Model()
    picks = None
    for c in (0, 1):
        some = usable.filter(F.col("toxic") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(train)
        picks = some if picks is None else picks.union(some)
    picks = picks.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))  # 2 * train rows at most
    rows = docs.select("doc_id", "text").join(F.broadcast(picks), "doc_id").filter("text IS NOT NULL").select("toxic", "text")
    rows = materialize(rows.groupBy(F.xxhash64("text"), F.xxhash64(F.lit(1), "text")).agg(F.max("toxic").alias("toxic"), F.first("text").alias("text")).select("toxic", "text"))
    n = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if len(n) < 2:
        discard(rows)
        return Model()

    def beginnings(folded: str) -> set[str]:
        out = set()
        for w in set(folded.split()):
            out.add(f" {w} ")
            out.update(f" {w[:k]}" for k in PREFIXES if len(w) > k)
        return out

    least = max(4, 0.02 * n[1])
    odds = lambda a, b: math.log((a + 0.5) / (n[1] + 1)) - math.log((b + 0.5) / (n[0] + 1))
    got = _counts(rows, beginnings).filter(F.col("n1") >= least).filter(F.col("n1") * n[0] > 8 * F.col("n0") * n[1]).collect()  # each in 2 percent of the toxic ones learned from
    support = {r["f"]: (r["n1"], odds(r["n1"], r["n0"])) for r in got}
    widest: dict[str, int] = {}  # of a beginning: the most support of what goes on from it
    for f, (n1, _) in support.items():
        for k in range(1 + PREFIXES[0], len(f)):
            widest[f[:k]] = max(n1, widest.get(f[:k], 0))
    weights: dict[str, float] = {}
    for f in sorted(support, key=lambda f: (len(f), f)):  # a beginning counts where no single continuation accounts for it
        n1, w = support[f]
        if w >= LEAST_ODDS and (f.endswith(" ") or n1 > 1.25 * widest.get(f, 0)) and not any(f[:k] in weights for k in range(3, len(f))):
            weights[f] = w
    model = lexicon = Model(weights)
    held: list = []

    def phrases(folded: str) -> set[str]:
        if not held:
            held.append(lexicon.automaton())
        out = set()
        for begin, _, _ in matches(held[0], folded):
            stop = folded.index(" ", begin + 1)
            if begin:
                out.add(folded[folded.rindex(" ", 0, begin) : stop + 1])
            if stop + 1 < len(folded):
                out.add(folded[begin : folded.index(" ", stop + 1) + 1])
        return out

    if weights:
        got = _counts(rows, phrases).filter((F.col("n0") >= 4) & (F.col("n0") * n[1] > 8 * F.col("n1") * n[0])).collect()
        model = Model(weights, tuple(sorted(r["f"] for r in got)))
    made = model

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = made.automaton()
        for b in steps(batches):
            folded = [fold(t) for t in column(b, "text").to_pylist()]
            yield pa.RecordBatch.from_arrays([column(b, "toxic"), pa.array([sum(w for _, _, w in matches(a, f)) for f in folded], pa.float64()), pa.array([f.count(" ") - 1 for f in folded], pa.int64())], ["toxic", "total", "words"])

    seen = rows.mapInArrow(sums, "toxic int, total double, words long").orderBy("toxic", "total", "words").toPandas()  # 2 * train rows at most
    x = np.array([features(t, w) for t, w in zip(seen["total"], seen["words"], strict=True)])
    y = seen["toxic"].to_numpy(float)
    share = np.where(y == 1, sizes[1] / n[1], sizes[0] / n[0])
    curve = np.zeros(x.shape[1])
    for _ in range(60):  # Newton's method with a small penalty
        p = 1 / (1 + np.exp(-np.clip(x @ curve, -40, 40)))
        grad = x.T @ (share * (y - p)) - 0.1 * curve
        step = np.linalg.solve((x * (share * p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(len(curve)), grad)
        curve = curve + step
        if np.abs(step).max() < 1e-9:
            break
    discard(rows)
    return Model(model.weights, model.exceptions, tuple(float(c) for c in curve))


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted for each row: a map over rows."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = model.automaton()
        for b in steps(batches):
            got = [score(model, a, t) for t in column(b, "text").to_pylist()]
            held = [i is not None and zlib.crc32(str(i).encode()) % 5 == 0 for i in column(b, "doc_id").to_pylist()]
            yield pa.RecordBatch.from_arrays([column(b, "doc_id"), pa.array(held), pa.array(got, pa.float64()), pa.array([int(s >= 0.5) for s in got], pa.int32())], ["doc_id", "held_out", "score", "predicted"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int")


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs, all columns as they are, without rows that the model rejects."""
    model = fit(docs, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = model.automaton()
        for b in steps(batches):
            yield b.filter(pa.array([score(model, a, t) < 0.5 for t in column(b, "text").to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
