"""Operator 1: token ids written as canonical, length-limited Huffman codes and read back.

Texts become ids once; the ids of each document are kept with the counts of their task, and the sum of all counts gives
one code for the whole corpus (package-merge, at most MAX_BITS bits, canonical order, so the code is its list of
lengths). Each document is then coded on its own, with a bit offset noted every INTERVAL ids, and moves, coded, to the
part of its range of doc_ids. There blocks of about BLOCK_IDS ids are written. A block holds all that reading it takes
besides the code: document ids, numbers of ids, bit offsets and coded bytes, so blocks decode independently, and the
stretches between two offsets decode side by side through one table of 2**MAX_BITS entries.

File format: Parquet rows (part, block, start, n_docs, n_tokens, doc_ids, sizes, bytes, offsets, payload) and one row
of code lengths. doc_ids are little-endian int64, sizes uint32 (ids of each document), bytes uint32 (its coded bytes),
offsets uint32 (bit offset of each stretch in its document), payload the coded documents, each from a full byte on.

Defined results: null text counts as empty, so such a document holds the end id only. Null doc_ids come first. Rows with
the same doc_id keep separate entries, ordered by their coded bytes. An empty table gives no blocks and no rows.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import PATTERN, byte_letters
from .common import column, discard, materialize, scratch, steps
from .pieces import PieceTable

MAX_BITS = 18
INTERVAL = 512
BLOCK_IDS = 1 << 20
END_ID = 2
#: Parts of words with marks or digits that are kept with their ids.
PARTS = 100_000
#: Bytes of ids that are coded at once, few enough for the CPU's caches.
CODE_BYTES = 1 << 18


def code_lengths(counts: np.ndarray, limit: int = MAX_BITS) -> np.ndarray:
    """Lengths of an optimal prefix code of at most `limit` bits (package-merge), 0 for ids that don't occur."""
    used = np.flatnonzero(counts)
    out = np.zeros(len(counts), np.uint8)
    if len(used) < 2:
        out[used] = 1
        return out
    if len(used) > 1 << limit:
        raise ValueError(f"{len(used)} ids need more than {limit} bits")
    used = used[np.argsort(counts[used], kind="stable")]
    own = counts[used].astype(np.float64)
    levels, cost = [], np.empty(0)
    for _ in range(limit):
        both = np.concatenate([own, cost])
        order = np.argsort(both, kind="stable")
        levels.append(order)
        both = both[order]
        both = both[: len(both) // 2 * 2]
        cost = both[::2] + both[1::2]
    take = 2 * len(used) - 2
    for order in reversed(levels):
        chosen = order[:take]
        leaves = chosen[chosen < len(used)]
        out[used[leaves]] += 1
        take = 2 * (len(chosen) - len(leaves))
    return out


def canonical(lengths: np.ndarray) -> np.ndarray:
    """The code words: shorter before longer, then by id."""
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    size = lengths[order].astype(np.int64)
    top = int(size.max()) if len(size) else 0
    first = np.concatenate([[0], np.cumsum(1 << (top - size))[:-1]]) if len(size) else size
    words = np.zeros(len(lengths), np.uint32)
    words[order] = (first >> (top - size)).astype(np.uint32)
    return words


def decode_table(lengths: np.ndarray, limit: int = MAX_BITS) -> np.ndarray:
    """For the next `limit` bits: id << 5 | length."""
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    spread = 1 << (limit - lengths[order].astype(np.int64))
    out = np.zeros(1 << limit, np.uint32)
    filled = np.repeat((order.astype(np.uint32) << 5) | lengths[order], spread)
    out[: len(filled)] = filled
    return out


def pack(ids: np.ndarray, sizes: np.ndarray, words: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Documents coded: all bytes, bytes of each, bit offsets of all stretches, stretches of each."""
    bits = lengths[ids].astype(np.int64)
    total = np.concatenate([[0], np.cumsum(bits)])
    begin = np.concatenate([[0], np.cumsum(sizes)])
    doc_bits = total[begin[1:]] - total[begin[:-1]]
    doc_bytes = (doc_bits + 7) // 8
    base = np.concatenate([[0], np.cumsum(doc_bytes)])
    at = total[:-1] + np.repeat(8 * base[:-1] - total[begin[:-1]], sizes)
    # each code word reaches into two 32-bit cells at most; within a cell the words are disjoint, so sums are unions
    cell, room = at >> 5, 64 - (at & 31) - bits
    moved = words[ids].astype(np.uint64) << room.astype(np.uint64)
    out = np.zeros(int(base[-1] + 3) // 4 + 2, np.uint64)
    if len(ids):
        edge = np.flatnonzero(np.diff(cell, prepend=-1))
        out[cell[edge]] += np.add.reduceat(moved >> np.uint64(32), edge)
        out[cell[edge] + 1] += np.add.reduceat(moved & np.uint64(0xFFFFFFFF), edge)
    data = out.astype(">u4").view(np.uint8)[: int(base[-1])]
    stretches = (sizes + INTERVAL - 1) // INTERVAL
    starts = np.repeat(begin[:-1], stretches) + INTERVAL * (np.arange(int(stretches.sum())) - np.repeat(np.cumsum(stretches) - stretches, stretches))
    offsets = at[starts] - 8 * np.repeat(base[:-1], stretches) if len(starts) else np.empty(0, np.int64)
    return data, doc_bytes, offsets.astype(np.uint32), stretches


def unpack(payload: bytes, sizes: np.ndarray, doc_bytes: np.ndarray, offsets: np.ndarray, table: np.ndarray, limit: int = MAX_BITS) -> np.ndarray:
    """Ids of a block. Every stretch is a lane; a step decodes one id in each lane that is not at its end."""
    sizes, doc_bytes = sizes.astype(np.int64), doc_bytes.astype(np.int64)
    stretches = (sizes + INTERVAL - 1) // INTERVAL
    lanes = int(stretches.sum())
    nth = np.arange(lanes) - np.repeat(np.cumsum(stretches) - stretches, stretches)
    left = np.minimum(INTERVAL, np.repeat(sizes, stretches) - INTERVAL * nth)
    at = 8 * np.repeat(np.cumsum(doc_bytes) - doc_bytes, stretches) + offsets
    raw = np.frombuffer(payload + bytes(4), np.uint8).astype(np.uint32)
    window = raw[:-3] << 24 | raw[1:-2] << 16 | raw[2:-1] << 8 | raw[3:]
    order = np.argsort(-left, kind="stable")
    at, alive = at[order], np.searchsorted(-left[order], -np.arange(1, INTERVAL + 1), side="right")
    out = np.empty((INTERVAL, lanes), np.uint32)
    shift = np.uint32(32 - limit)
    for step in range(int(left.max()) if lanes else 0):
        n = alive[step]
        p = at[:n]
        hit = table[window[p >> 3] << (p & 7).astype(np.uint32) >> shift]
        out[step, :n] = hit >> 5
        p += hit & 31
    back = np.empty(lanes, np.int64)
    back[order] = np.arange(lanes)
    ids = np.empty(int(sizes.sum()), np.uint32)
    ends = np.cumsum(left)
    for begin in range(0, lanes, 4096):  # lanes to their places, some at a time
        some = slice(begin, min(lanes, begin + 4096))
        rows = out[:, back[some]].T
        ids[ends[begin] - left[begin] : ends[some.stop - 1]] = rows[np.arange(INTERVAL) < left[some, None]]
    return ids


class Library:
    """The tokenizers library behind the table of pieces."""

    def __init__(self, path: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.of = Tokenizer.from_file(path)
        self.newline = self.of.encode("\n", add_special_tokens=False).ids[0]
        self.split = regex.compile(PATTERN)
        self.letters = {b: c for c, b in byte_letters().items()}
        self.parts: dict[str, tuple[int, ...]] = {}
        specials = [t.content for t in self.of.get_added_tokens_decoder().values()]
        self.table = PieceTable(self.words, lambda t: np.array(self.of.encode(t, add_special_tokens=False).ids, np.uint32), self.newline, specials)

    def words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Pre-split as the vocabulary's pattern has it, each part by the library's model. Words of several parts mostly
        share them, as a word before a comma or a full stop does, so theirs are kept."""
        model, found, letters, parts = self.of.model.tokenize, self.split.findall, self.letters, self.parts
        if len(parts) > PARTS:
            parts.clear()
        ids, ends = [], []
        for w in words:
            if w[w[0] == " " :].isalpha():
                ids += [t.id for t in model(w.replace(" ", "\u0120") if w.isascii() else w.encode().decode("latin-1").translate(letters))]
            else:
                for part in found(w):
                    own = parts.get(part)
                    if own is None:
                        own = parts[part] = tuple([t.id for t in model(part.replace(" ", "\u0120") if part.isascii() and part.isprintable() else part.encode().decode("latin-1").translate(letters))])
                    ids += own
            ends.append(len(ids))
        return np.array(ids, np.uint32), np.diff(np.array(ends, np.int64), prepend=0)


_loaded: dict[str, Library] = {}


def library(path: str) -> Library:
    if path not in _loaded:
        _loaded[path] = Library(path)
    return _loaded[path]


def tokenized(docs: DataFrame, vocabulary: str, bounds: list, width: int, end_id: int) -> DataFrame:
    """(doc_id, part, n, ids, counts): a row for each document, and one row of counts for each task."""
    kind = np.dtype("<u2") if width <= 1 << 16 else np.dtype("<u4")
    schema = "doc_id long, part int, n long, ids binary, counts binary"
    names = ["doc_id", "part", "n", "ids", "counts"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lib, counts, any_row = library(vocabulary), np.zeros(width, np.int64), False
        edges = np.array(bounds, np.int64)
        for b in steps(batches, "_text"):
            any_row = True
            ids, n = lib.table.encode([t or "" for t in column(b, "_text").to_pylist()])
            put = np.zeros(len(ids) + len(n), np.uint32)
            last = np.cumsum(n + 1) - 1
            hole = np.zeros(len(put), bool)
            hole[last] = True
            put[hole], put[~hole] = end_id, ids
            counts += np.bincount(put, minlength=width)
            data = put.astype(kind).tobytes()
            at = np.concatenate([[0], last + 1]) * kind.itemsize
            who = column(b, "doc_id")
            part = np.searchsorted(edges, np.array(who.fill_null(-(2**63))), side="right")
            yield pa.RecordBatch.from_arrays([who, pa.array(part, pa.int32()), pa.array(n + 1, pa.int64()), pa.array([data[at[i] : at[i + 1]] for i in range(len(n))], pa.binary()), pa.nulls(len(n), pa.binary())], names)
        if any_row:
            yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.array([-1], pa.int32()), pa.array([0], pa.int64()), pa.nulls(1, pa.binary()), pa.array([counts.astype("<i8").tobytes()], pa.binary())], names)

    return docs.selectExpr("CAST(doc_id AS long) doc_id", "text AS _text").mapInArrow(run, schema)


def global_counts(rows: DataFrame, width: int) -> np.ndarray:
    """The tasks' counts, summed on the executors; what reaches the driver is bounded by the vocabulary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width, np.int64)
        for b in batches:
            for x in column(b, "counts").to_pylist():
                total += np.frombuffer(x, "<i8")
        some = np.flatnonzero(total)
        if len(some):
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some], pa.int64())], ["id", "n"])

    got = rows.filter("counts IS NOT NULL").select("counts").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(width, np.int64)
    out[got["id"].to_numpy(np.int64)] = got["n"].to_numpy(np.int64)
    return out


def _dealt(coded: DataFrame, parts: int) -> DataFrame:
    """Each part in a partition of its own: by a number that the planner's hash sends there."""
    k = F.col("id").cast("int")
    found = coded.sparkSession.range(32 * parts).groupBy(F.pmod(F.hash(k), F.lit(parts)).alias("p")).agg(F.min(k).alias("k")).collect()
    of = {r["p"]: r["k"] for r in found}
    keys = F.array(*(F.lit(of.get(p, p)) for p in range(parts)))
    return coded.withColumn("key", F.get(keys, F.col("part"))).repartition(parts, "key").drop("key")


def write_ids(docs: DataFrame, vocabulary: str, path: str, parts: int | None = None, end_id: int = END_ID) -> None:
    """Encodes documents (doc_id, text) and writes blocks below path/blocks and the code lengths below path/code."""
    spark = docs.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    edges = docs.select(F.col("doc_id").cast("long").alias("d")).filter("d IS NOT NULL").approxQuantile("d", [i / parts for i in range(1, parts)], 0.1 / parts) if parts > 1 else []
    edges = sorted({int(x) for x in edges})
    width = max(library(vocabulary).of.get_vocab_size(), end_id + 1)
    kind = np.dtype("<u2") if width <= 1 << 16 else np.dtype("<u4")
    rows = materialize(tokenized(docs, vocabulary, edges, width, end_id))
    lengths = code_lengths(global_counts(rows, width))
    base, total = {}, 0
    for r in sorted(rows.filter("part >= 0").groupBy("part").agg(F.sum("n").alias("n")).collect()):
        base[r["part"]], total = total, total + r["n"]
    words = canonical(lengths)
    names = ["part", "doc_id", "n", "coded", "offsets"]

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in steps(batches, "ids", CODE_BYTES):
            n = np.array(column(b, "n"))
            ids = np.frombuffer(b"".join(column(b, "ids").to_pylist()), kind).astype(np.int64)
            data, size, offsets, stretches = pack(ids, n, words, lengths)
            data, offsets = data.tobytes(), offsets.astype("<u4").tobytes()
            at, to = np.concatenate([[0], np.cumsum(size)]), 4 * np.concatenate([[0], np.cumsum(stretches)])
            yield pa.RecordBatch.from_arrays([column(b, "part"), column(b, "doc_id"), column(b, "n"), pa.array([data[at[i] : at[i + 1]] for i in range(len(n))], pa.binary()), pa.array([offsets[to[i] : to[i + 1]] for i in range(len(n))], pa.binary())], names)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, start, held = None, 0, 0, []

        def out():
            nonlocal number, start
            n = sum(x[1] for x in held)
            as_bytes = lambda k, t: np.array([x[k] for x in held], t).tobytes()
            row = [[part], [number], [start], [len(held)], [n], [np.array([x[0] is None for x in held]).tobytes()], [np.array([x[0] or 0 for x in held], "<i8").tobytes()], [as_bytes(1, "<u4")], [np.array([len(x[2]) for x in held], "<u4").tobytes()], [b"".join(x[2] for x in held)], [b"".join(x[3] for x in held)]]
            number, start = number + 1, start + n
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, [pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), *[pa.binary()] * 6], strict=True)], block_names)

        have = 0
        for b in batches:
            for p, *x in zip(*(column(b, k).to_pylist() for k in names), strict=True):
                if held and (p != part or have + x[1] > BLOCK_IDS):
                    yield out()
                    have = 0
                if p != part:
                    part, number, start = p, 0, base[p]
                held.append(x)
                have += x[1]
        if held:
            yield out()

    block_names = ["part", "block", "start", "n_docs", "n_tokens", "null_ids", "doc_ids", "sizes", "bytes", "payload", "offsets"]
    block_schema = "part int, block int, start long, n_docs int, n_tokens long, null_ids binary, doc_ids binary, sizes binary, bytes binary, payload binary, offsets binary"
    coded = rows.filter("part >= 0").select("part", "doc_id", "n", "ids").mapInArrow(code, "part int, doc_id long, n long, coded binary, offsets binary")
    coded = _dealt(coded, parts).sortWithinPartitions("part", "doc_id", "coded")
    coded.mapInArrow(blocks, block_schema).write.option("compression", "none").parquet(f"{path}/blocks")
    spark.createDataFrame([(bytearray(lengths.tobytes()),)], "lengths binary").coalesce(1).write.parquet(f"{path}/code")
    discard(rows)


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """The blocks, decoded: (doc_id, start, n_tokens, ids_crc32, ids), ids as little-endian uint32."""
    return _read(spark, path, True)


def _read(spark: SparkSession, path: str, with_ids: bool) -> DataFrame:
    lengths = np.frombuffer(spark.read.parquet(f"{path}/code").first()["lengths"], np.uint8)
    names = ["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: 5 if with_ids else 4]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = decode_table(lengths)
        for b in batches:
            for row in range(b.num_rows):
                r = {k: column(b, k)[row].as_py() for k in ("start", "null_ids", "doc_ids", "sizes", "bytes", "payload", "offsets")}
                sizes = np.frombuffer(r["sizes"], "<u4")
                ids = unpack(r["payload"], sizes, np.frombuffer(r["bytes"], "<u4"), np.frombuffer(r["offsets"], "<u4"), table).astype("<u4").tobytes()
                at = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
                parts = [memoryview(ids)[4 * at[i] : 4 * at[i + 1]] for i in range(len(sizes))]
                cols = [pa.array(np.frombuffer(r["doc_ids"], "<i8"), pa.int64(), mask=np.frombuffer(r["null_ids"], bool)), pa.array(r["start"] + at[:-1], pa.int64()), pa.array(sizes, pa.int64()), pa.array([zlib.crc32(p) for p in parts], pa.int64())]
                yield pa.RecordBatch.from_arrays([*cols, *([pa.array([bytes(p) for p in parts], pa.binary())] if with_ids else [])], names)

    blocks = spark.read.parquet(f"{path}/blocks").select("start", "null_ids", "doc_ids", "sizes", "bytes", "payload", "offsets")
    return blocks.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids)


def round_trip(docs: DataFrame, vocabulary: str) -> DataFrame:
    """Writes the ids of docs to files in the shared folder and reads them back: doc_id, start, n_tokens, ids_crc32."""
    path = f"{scratch(docs.sparkSession)}/phonolake-ids-{uuid.uuid4().hex}"
    write_ids(docs.select("doc_id", "text"), vocabulary, path)
    return _read(docs.sparkSession, path, False)
