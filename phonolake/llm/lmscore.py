"""Operator 6: language-model scoring by cross-entropy difference.

Two n-gram models of the same order, smoothing and vocabulary: the target model from documents labelled good, the
background model from all documents. The vocabulary is every character of all documents (lower case), numbered by how
often it occurs, and one symbol for the ends of a text; none is left out, so at most as many as Unicode has. Counts of
ORDER symbols cover all documents, are made in each task and summed by shuffle; they stay a distributed table, from which
plain joins make the losses: lower orders are sums of higher ones, and the models are interpolated by the number of
different continuations (Witten-Bell). As the background saw every document, each n-gram that is scored has its entry.
The table of losses is counted: up to MOST_BYTES it is sent to the documents, beyond that each document's n-grams, added
up per document, meet it in a join. A document's score is its loss per symbol under the target model less that under the
background model: the lower, the more like the target. A document is part of its own background, which lowers its
background loss a little, the more so the rarer its n-grams are.

Only labels of rows whose crc32(doc_id as text) mod 5 is not 0 are learned from. Defined results: null text counts as
empty, which has its end as its one symbol. Without target documents the target model is uniform. Repeated rows count
and are scored each. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, materialize, steps

ORDER, BITS = 3, 21
MASK = (1 << BITS) - 1
END, CODES = 0, 0x110000
#: Bits of the symbols, the frequent ones, whose n-grams have a plain array; all others are looked up by search.
LOW = 7
#: Target ids that are sent to the tasks as one array of eight bytes each; more of them meet the documents in a join.
MOST_IDS = 5_000_000
#: Bytes of losses that are sent to the tasks, at 16 for each n-gram.
MOST_BYTES = 64 << 20
MODELS = ("target", "background")


def vocabulary(docs: DataFrame) -> np.ndarray:
    """The symbol of each code point, by counts over all documents: 1 for the most frequent one, and so on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CODES, np.int64)
        for b in steps(batches):
            for t in column(b, "text").to_pylist():
                if t:
                    seen = np.bincount(np.frombuffer(t.lower().encode("utf-32-le", "replace"), "<u4"))
                    total[: len(seen)] += seen
        some = np.flatnonzero(total)
        if len(some):
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["code", "n"])

    got = docs.select("text").mapInArrow(run, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "code").collect()  # code points at most
    table = np.zeros(CODES, np.int64)
    for i, r in enumerate(got):
        table[r["code"]] = i + 1
    return table


def symbols_of(texts: list[str | None], table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of all texts, each after ORDER - 1 ends and before one, and the number of each text's."""
    parts = ["\0" * (ORDER - 1) + (t or "").lower() + "\0" for t in texts]
    codes = np.frombuffer("".join(parts).encode("utf-32-le", "replace"), "<u4")
    sizes = np.array([len(p) for p in parts], np.int64)
    last = np.cumsum(sizes) - 1
    out = table[codes]
    out[last] = END
    for k in range(ORDER - 1):
        out[last - sizes + 1 + k] = END
    return out, sizes


def keys_of(texts: list[str | None], table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The n-grams of all texts end to end, their places in the plain array (-1 for those without one), and the number of
    each text's."""
    symbols, sizes = symbols_of(texts, table)
    n = max(0, len(symbols) - ORDER + 1)
    keys, low, top = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
    for k in range(ORDER):
        part = symbols[k : k + n]
        keys = keys << BITS | part
        low = low << LOW | part
        top = np.maximum(top, part)
    low[top >> LOW > 0] = -1
    inside = np.ones(n, bool)  # n-grams that end in the ends before a later text belong to no text
    first = np.cumsum(sizes)[:-1] if len(sizes) else np.empty(0, np.int64)
    for k in range(ORDER - 1):
        inside[first + k - ORDER + 1] = False
    return keys[inside], low[inside], sizes - (ORDER - 1)


def _low_keys() -> np.ndarray:
    """The n-gram of each place of the plain array."""
    at = np.arange(1 << (LOW * ORDER), dtype=np.int64)
    out = np.zeros(len(at), np.int64)
    for k in range(ORDER - 1, -1, -1):
        out = out << BITS | (at >> (LOW * k) & ((1 << LOW) - 1))
    return out


def counts(docs: DataFrame, table: np.ndarray, ids: np.ndarray | None = None) -> DataFrame:
    """docs: (text, target), or (text, doc_id) with the sorted ids of the target. (key, target, background), summed over
    all documents."""
    own = "target" if ids is None else "doc_id"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plain = np.zeros((2, 1 << (LOW * ORDER)), np.int64)
        held: list = []

        def batch(keys: np.ndarray, *n: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(keys), *map(pa.array, n)], ["key", *MODELS])

        def merged() -> tuple[np.ndarray, ...]:
            keys, where = np.unique(np.concatenate([h[0] for h in held]), return_inverse=True)
            return keys, *(np.bincount(where, np.concatenate([h[i] for h in held]), len(keys)).astype(np.int64) for i in (1, 2))

        for b in steps(batches):
            keys, low, n = keys_of(column(b, "text").to_pylist(), table)
            if ids is None:
                good = np.array(column(b, "target").to_pylist(), bool)
            else:
                who = column(b, "doc_id")
                at = np.array(who.fill_null(0), np.int64)
                near = np.minimum(np.searchsorted(ids, at), max(0, len(ids) - 1))
                good = (ids[near] == at if len(ids) else np.zeros(len(at), bool)) & ~np.array(who.is_null())
            good = np.repeat(good, n)
            plain[0] += np.bincount(low[good & (low >= 0)], minlength=plain.shape[1])
            plain[1] += np.bincount(low[low >= 0], minlength=plain.shape[1])
            rest = low < 0
            if rest.any():
                found, where = np.unique(keys[rest], return_inverse=True)
                held.append((found, np.bincount(where, good[rest], len(found)).astype(np.int64), np.bincount(where, minlength=len(found))))
                if len(held) >= 8:
                    held[:] = [merged()]
                    if len(held[0][0]) > 1 << 20:
                        yield batch(*held.pop())
        if held:
            yield batch(*merged())
        some = np.flatnonzero(plain[1])
        if len(some):
            yield batch(_low_keys()[some], plain[0, some], plain[1, some])

    made = docs.select("text", own).mapInArrow(run, "key long, target long, background long")
    return made.groupBy("key").agg(*(F.sum(m).alias(m) for m in MODELS))


def losses(counted: DataFrame, n_symbols: int) -> DataFrame:
    """counted: (key, target, background). (key, target, background): -ln p of the last symbol of each n-gram, given its
    others."""
    total = counted.agg(*(F.coalesce(F.sum(m), F.lit(0)).alias(m) for m in MODELS)).first()
    levels = [counted.select("key", *MODELS)]
    for order in range(ORDER - 1, 0, -1):  # n-grams without their first symbol, which is the highest
        short = F.col("key").bitwiseAND(F.lit((1 << (BITS * order)) - 1))
        levels.append(levels[-1].groupBy(short.alias("key")).agg(*(F.sum(m).alias(m) for m in MODELS)))
    lower = levels[-1].select("key", *(((F.col(m) + 1.0) / F.lit(float(total[m] + n_symbols))).alias(m) for m in MODELS))
    for order in range(2, ORDER + 1):
        now = levels[ORDER - order].withColumns({"history": F.shiftright("key", BITS), "short": F.col("key").bitwiseAND(F.lit((1 << (BITS * (order - 1))) - 1))})
        sums = now.groupBy("history").agg(*(F.sum(m).alias(f"all_{m}") for m in MODELS), *(F.count_if(F.col(m) > 0).alias(f"kinds_{m}") for m in MODELS))
        both = now.join(sums, "history").join(lower.toDF("short", *(f"lower_{m}" for m in MODELS)), "short")
        p = lambda m: F.when(F.col(f"all_{m}") > 0, (F.col(m) + F.col(f"kinds_{m}") * F.col(f"lower_{m}")) / (F.col(f"all_{m}") + F.col(f"kinds_{m}"))).otherwise(F.col(f"lower_{m}"))
        lower = both.select("key", *(p(m).alias(m) for m in MODELS))
    return lower.select("key", *((-F.log(m)).cast("float").alias(m) for m in MODELS))


def _by_table(docs: DataFrame, table: np.ndarray, lost: DataFrame, kind: str) -> DataFrame:
    """Scores by a table of losses that every task has."""
    got = lost.toPandas().sort_values("key")
    held = docs.sparkSession.sparkContext.broadcast((got["key"].to_numpy(np.int64), got[list(MODELS)].to_numpy(np.float32)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, loss = held.value
        plain = np.zeros((1 << (LOW * ORDER), 2), np.float32)
        at = np.searchsorted(keys, _low_keys())
        has = np.flatnonzero(keys[np.minimum(at, max(0, len(keys) - 1))] == _low_keys()) if len(keys) else []
        plain[has] = loss[at[has]]
        for b in steps(batches):
            found, low, n = keys_of(column(b, "text").to_pylist(), table)
            own = plain[np.maximum(low, 0)]
            rest = low < 0
            own[rest] = loss[np.searchsorted(keys, found[rest])]
            h = np.add.reduceat(own, np.cumsum(n) - n, axis=0, dtype=np.float64)
            yield pa.RecordBatch.from_arrays([column(b, "doc_id"), pa.array(n), pa.array(h[:, 0]), pa.array(h[:, 1])], ["doc_id", "n_symbols", *MODELS])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_symbols long, target double, background double")


def _by_join(docs: DataFrame, table: np.ndarray, lost: DataFrame, kind: str) -> DataFrame:
    """Scores by a join of each document's n-grams, added up, with the losses."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in steps(batches):
            found, _, n = keys_of(column(b, "text").to_pylist(), table)
            cut = np.cumsum(n)
            for i in range(b.num_rows):
                keys, times = np.unique(found[cut[i] - n[i] : cut[i]], return_counts=True)
                one = np.zeros(len(keys), np.int64)
                yield pa.RecordBatch.from_arrays([column(b, "row").take(pa.array(one + i)), column(b, "doc_id").take(pa.array(one + i)), pa.array(keys), pa.array(times)], ["row", "doc_id", "key", "times"])

    each = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text").mapInArrow(run, f"row long, doc_id {kind}, key long, times long")
    sums = materialize(each).join(lost, "key").groupBy("row", "doc_id").agg(F.sum("times").alias("n_symbols"), *(F.sum(F.col("times") * F.col(m).cast("double")).alias(m) for m in MODELS))
    return sums.drop("row")


def cross_entropy_difference(docs: DataFrame, target_ids: DataFrame) -> DataFrame:
    """docs: doc_id, text; target_ids: doc_id. (doc_id, n_symbols, h_target, h_background, score) for each row."""
    table = vocabulary(docs)
    good = target_ids.select(F.col("doc_id").alias("_phonolake_good")).filter("_phonolake_good IS NOT NULL").distinct()
    whole = docs.schema["doc_id"].dataType.typeName() in ("long", "integer") and good.schema[0].dataType.typeName() in ("long", "integer")
    if whole and good.limit(MOST_IDS + 1).count() <= MOST_IDS:
        ids = np.sort(good.toPandas()["_phonolake_good"].to_numpy(np.int64))
        made = counts(docs.select("text", F.col("doc_id").cast("long").alias("doc_id")), table, ids)
    else:
        marked = docs.join(good.hint("merge"), F.col("doc_id") == F.col("_phonolake_good"), "left").select("text", F.col("_phonolake_good").isNotNull().alias("target"))
        made = counts(marked, table)
    lost = materialize(losses(materialize(made), int(table.max()) + 1))
    scored = (_by_table if 16 * lost.count() <= MOST_BYTES else _by_join)(docs, table, lost, docs.schema["doc_id"].dataType.simpleString())
    mean = {m: F.col(m) / F.col("n_symbols") for m in MODELS}
    return scored.select("doc_id", "n_symbols", mean["target"].alias("h_target"), mean["background"].alias("h_background"), (mean["target"] - mean["background"]).alias("score"))


def good_ids(labels: DataFrame) -> DataFrame:
    return labels.filter("quality = 1 AND doc_id IS NOT NULL AND crc32(CAST(doc_id AS string)) % 5 <> 0").select("doc_id")
