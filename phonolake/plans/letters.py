"""Training of the letter-to-sound model from words and their phonemes.

Letters are aligned to phoneme units by rounds of counting and aligning; then each window of letters gets its most
frequent chunk, wide windows that narrower ones predict go, and stress patterns are counted by keys from special to
general. Only the alignment is a kernel; the probabilities it needs number letters times chunks and are checked."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import lookup as L
from ..operators import mining as M
from ..operators.kernels import Aligner
from . import slices
from .espeak import ACCENTED, LetterToSound

MOST_PROBABILITIES = 500_000
SHAPES = [(2, 2), (1, 2), (2, 1), (1, 1), (0, 1), (1, 0), (0, 0)]


def bare_units(phonemes: Column) -> Column:
    return F.transform(T.phoneme_units(phonemes), lambda u: F.regexp_replace(u, "^[ˈˌ]+", ""))


def pattern(phonemes: Column) -> Column:
    """The mark of each nucleus, a full stop for none."""
    nuclei = F.filter(T.phoneme_units(phonemes), lambda u: u.rlike(f"^[ˈˌ]*[{T.REPLAY_VOWELS}]"))
    return F.array_join(F.transform(nuclei, lambda u: F.when(u.rlike("^[ˈˌ]"), F.left(u, F.lit(1))).otherwise(".")), "")


def aligned(words: DataFrame, rounds: int = 5, most: int = 3) -> DataFrame:
    """words: (word, phonemes). Adds emission, a chunk for each letter; words that can't be aligned go. The words are made
    once; rounds add up what letters and chunks meet inside the kernel, so only counts leave it."""
    pairs = words.select("word", "phonemes").persist().select("word", "phonemes", F.split("word", "").alias("_l"), bare_units(F.col("phonemes")).alias("_u"))
    table: dict | None = None

    def emissions(batches: Iterator[pa.RecordBatch], table: dict | None) -> Iterator[tuple[pa.RecordBatch, list, list]]:
        """Letters and chunks; without a table only of words with a unit for each letter."""
        best = None if table is None else Aligner(table, most)
        for b in slices(batches):
            letters, units = b["_l"].to_pylist(), b["_u"].to_pylist()
            made = [None if x is None or u is None else best(x, u) if best else u if len(x) == len(u) else None for x, u in zip(letters, units, strict=True)]
            yield b, letters, made

    for _ in range(rounds):

        def count(batches: Iterator[pa.RecordBatch], table=table) -> Iterator[pa.RecordBatch]:
            n = Counter(z for _, letters, made in emissions(batches, table) for x, e in zip(letters, made, strict=True) if e is not None for z in zip(x, e, strict=True))
            yield pa.record_batch([pa.array([k[0] for k in n], pa.string()), pa.array([k[1] for k in n], pa.string()), pa.array(n.values(), pa.int64())], ["letter", "chunk", "n"])

        per = pairs.mapInArrow(count, "letter string, chunk string, n long").groupBy("letter", "chunk").agg(F.sum("n").alias("n"))
        rows = per.withColumn("lp", F.ln(F.col("n") / F.sum("n").over(Window.partitionBy("letter")))).limit(MOST_PROBABILITIES + 1).collect()
        if len(rows) > MOST_PROBABILITIES:
            raise ValueError("too many different chunks for one table of probabilities")
        table = {(r["letter"], r["chunk"]): r["lp"] for r in rows}

    def run(batches: Iterator[pa.RecordBatch], table=table) -> Iterator[pa.RecordBatch]:
        for b, _, made in emissions(batches, table):
            yield pa.record_batch([b["word"], b["phonemes"], pa.array(made, pa.list_(pa.string()))], ["word", "phonemes", "emission"])

    return pairs.mapInArrow(run, "word string, phonemes string, emission array<string>").filter("emission IS NOT NULL")


def stress_features(word: Column, emission: Column) -> tuple[Column, Column]:
    """Nuclei, and how many of them follow the last accented letter's (-1 without one)."""
    nuclei = lambda chunk: F.size(F.filter(bare_units(chunk), lambda u: u.rlike(f"^[{T.REPLAY_VOWELS}]")))
    per = F.transform(emission, nuclei)
    state = F.struct(F.lit(0).alias("n"), F.lit(-1).alias("accent"))
    each = F.zip_with(F.split(word, ""), per, lambda c, n: F.struct(c.alias("c"), n.alias("n")))
    end = F.aggregate(each, state, lambda a, x: F.struct((a["n"] + x["n"]).alias("n"), F.when(F.contains(F.lit(ACCENTED), x["c"]) & (x["n"] > 0), a["n"] + x["n"]).otherwise(a["accent"]).alias("accent")))
    return end["n"], F.when(end["accent"] < 0, -1).otherwise(end["n"] - end["accent"])


def train(words: DataFrame, shapes: list[tuple[int, int]] | None = None, rounds: int = 5) -> tuple[DataFrame, DataFrame]:
    """(segments, stress): (shape, key, chunk) and (key, pattern)."""
    shapes = shapes or SHAPES
    made = aligned(words, rounds).withColumn("seq", F.xxhash64("word")).persist()
    segments = M.prune_windows(M.mode_windows(M.windows_of(made, shapes)), shapes)
    nuclei, accent = stress_features(F.col("word"), F.col("emission"))
    keyed = made.select(F.explode_outer(F.array_distinct(L.stress_keys(nuclei, accent, F.col("word")))).alias("key"), pattern(F.col("phonemes")).alias("pattern"), "seq")
    return segments, M.mode_per_key(keyed, ["key"], "pattern", "seq").select("key", "pattern")


def model(segments: DataFrame, stress: DataFrame, shapes: list[tuple[int, int]] | None = None, most: int = 2_000_000) -> LetterToSound:
    """The kernel form of the tables, whose size is checked."""
    rows = segments.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"over {most} windows; use lookup.backoff_windows, which joins them")
    return LetterToSound(shapes or SHAPES, {(r["shape"], r["key"]): r["chunk"] for r in rows}, {r["key"]: r["pattern"] for r in stress.collect()})
