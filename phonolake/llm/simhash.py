"""Operator 3: SimHash near-duplicates by vantage-point trees over Hamming distance.

Fingerprints of all documents become distinct ones with their smallest document first, so exact copies cost one row. A
vantage-point tree, grown on the driver from a bounded sample, cuts the space: at each node fingerprints within the
radius go inside, the others outside, and by the triangle bound only those outside but within radius + 2 can link to
one inside, so they are copied there too. Hence both ends of every link meet in one leaf at least. A task takes a leaf,
cuts it on by the same rule and compares what is left pair by pair. A leaf that distance can't cut (very many
fingerprints in a small ball) is linked through midpoints instead: two fingerprints differ in at most two bits if and
only if some value is within one bit of both, which takes 65 values for each and no pairs. A leaf returns its
components as stars, at most one row for each fingerprint, and the stars of all leaves are joined by components().

One fingerprint with two bits of room finds copies that differ little. More of them (`tables`: the same shingles under
other hash functions) find more: documents link if they do in any table, each table has its own tree, and no wider
radius is needed, which the triangle bound couldn't prune.

One word changed in a long text is within reach of that; a similarity of 0.8 is not: some ten of 64 bits differ then. So
`similar_rows` adds candidates from min-hash bands over the sets of shingles and tests every candidate, of either kind,
by the similarity of the sets themselves.

Defined results: null or empty text and text without words has fingerprint zero and links like any other. Fewer words
than a shingle: the whole sequence is the shingle. Rows that repeat a doc_id are rows of their own. A null doc_id counts
after all others. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, discard, materialize, steps
from .components import components

SHINGLE = 3
SEED = 42
NEAR = 2
#: Fingerprints that a leaf of the shared tree is meant for, sampled ones for each leaf, and leaves at most.
LEAF, PER_LEAF, MOST_LEAVES = 8192, 64, 16384
#: Fingerprints that are compared pair by pair.
PAIRS = 512
#: Links by similarity: words of a shingle, and the least similarity of two sets of them (4 of 5). A pair at exactly 0.8
#: shares none of 20 bands of 5 minima with a probability of 0.0004.
SIMILAR_SHINGLE, LEAST_SHARE, BANDS, BAND = 5, (4, 5), 20, 5

_K1, _K2 = "_phonolake_k1", "_phonolake_k2"


def shingles(text: str | None, size: int = SHINGLE) -> list[bytes]:
    words = (text or "").encode().lower().split()  # bytes: only A-Z and the six ASCII spaces count
    if len(words) < size:
        return [b" ".join(words)] if words else []
    return [b" ".join(g) for g in zip(*(words[i:] for i in range(size)), strict=False)]


def majority(digests: list[bytes], width: int) -> np.ndarray:
    """For each bit of digests of `width` bytes whether over half have it, as 64-bit words."""
    ones = np.zeros(8 * width, np.int64)
    for i in range(0, len(digests), 1 << 14):
        part = np.frombuffer(b"".join(digests[i : i + (1 << 14)]), np.uint8).reshape(-1, width)
        ones += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(2 * ones > len(digests)).view(">u8").astype(np.uint64)


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    return int(fingerprint_tables(text, 1, shingle)[0])


def fingerprint_tables(text: str | None, tables: int, shingle: int = SHINGLE) -> np.ndarray:
    """The first is by XXH64 with the seed, further ones come in pairs from 128-bit hashes with other seeds."""
    grams = shingles(text, shingle)
    one, two = xxhash.xxh64_digest, xxhash.xxh3_128_digest
    parts = [majority([one(g, SEED) for g in grams], 8)]
    parts += [majority([two(g, SEED + k) for g in grams], 16) for k in range(1, 1 + tables // 2)]
    return np.concatenate(parts)[:tables]


def fingerprints(docs: DataFrame, keep: list[str], text_col: str = "text", tables: int = 1) -> DataFrame:
    """The columns `keep` and fps (array<long>: the 64 bits of each table as a signed number) of each row."""
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep) + ", fps array<long>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in steps(batches, "_phonolake_text"):
            fps = [fingerprint_tables(t, tables) for t in column(b, "_phonolake_text").to_pylist()]
            flat = np.concatenate(fps).view(np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(fps) + 1) * tables, pa.int32()), pa.array(flat))
            yield pa.RecordBatch.from_arrays([*(column(b, c) for c in keep), lists], [*keep, "fps"])

    return docs.select(*keep, F.col(text_col).alias("_phonolake_text")).mapInArrow(run, schema)


# -- the tree


def _distance(fps: np.ndarray, point: np.uint64) -> np.ndarray:
    return np.bitwise_count(fps ^ point).astype(np.int16)


def _cut(fps: np.ndarray, rng: np.random.Generator, tries: int = 4) -> tuple[np.uint64, int, float] | None:
    """The vantage point and radius, of a few tried, that leave the least in the larger side; None if none helps."""
    best = None
    for point in rng.choice(fps, tries):
        d = np.bincount(_distance(fps[:: max(1, len(fps) // 4096)], point), minlength=67).cumsum()
        for radius in range(64):
            inside, outside = d[radius + NEAR], d[-1] - d[radius]
            if d[radius] and outside:
                cost = max(inside, outside) / d[-1] + 0.5 * (inside + outside - d[-1]) / d[-1]
                if best is None or cost < best[2]:
                    best = (point, radius, cost)
    return best if best and best[2] < 0.95 else None


class Tree:
    """Nodes as flat arrays; a child below zero is leaf -child - 1."""

    def __init__(self, sample: np.ndarray, leaves: int):
        self.point: list[int] = []
        self.radius: list[int] = []
        self.child: list[list[int]] = []
        self.leaves = 0
        rng = np.random.default_rng(SEED)

        def grow(fps: np.ndarray) -> int:
            cut = _cut(fps, rng) if leaves > 1 and len(fps) > max(8, PER_LEAF) else None
            if cut is None:
                self.leaves += 1
                return -self.leaves
            at = len(self.point)
            self.point.append(int(cut[0]))
            self.radius.append(cut[1])
            self.child.append([0, 0])
            d = _distance(fps, cut[0])
            self.child[at] = [grow(fps[d <= cut[1] + NEAR]), grow(fps[d > cut[1]])]
            return at

        self.root = grow(sample)

    def route(self, fps: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """Leaves with the fingerprints that belong there."""
        todo = [(self.root, fps)]
        while todo:
            node, own = todo.pop()
            if not len(own):
                continue
            if node < 0:
                yield -node - 1, own
                continue
            d = _distance(own, np.uint64(self.point[node]))
            todo += [(self.child[node][0], own[d <= self.radius[node] + NEAR]), (self.child[node][1], own[d > self.radius[node]])]


def _join(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """labels[i]: the smallest index known to be linked to i; takes in links a-b until nothing changes."""
    while len(a):
        x, y = labels[a], labels[b]
        differ = x != y
        if not differ.any():
            return
        a, b, low, high = a[differ], b[differ], np.minimum(x, y)[differ], np.maximum(x, y)[differ]
        np.minimum.at(labels, high, low)
        while True:
            jumped = labels[labels]
            if (jumped == labels).all():
                break
            labels[:] = jumped


def _join_midpoints(labels: np.ndarray, own: np.ndarray, fps: np.ndarray) -> None:
    """Links fingerprints that share a value within one bit of each; of very many, a hash class of values at a time."""
    bits = np.concatenate([np.zeros(1, np.uint64), np.uint64(1) << np.arange(64, dtype=np.uint64)])
    classes = max(1, len(fps) >> 16)
    for part in range(classes):
        values, who = [], []
        for bit in bits:
            v = fps ^ bit
            pick = np.flatnonzero((v * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)) % np.uint64(classes) == np.uint64(part))
            values.append(v[pick])
            who.append(own[pick])
        value, holder = np.concatenate(values), np.concatenate(who)
        order = np.argsort(value, kind="stable")
        value, holder = value[order], holder[order]
        same = value[1:] == value[:-1]
        _join(labels, holder[1:][same], holder[:-1][same])


def leaf_stars(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of distinct fingerprints of one leaf: those linked to a smaller one, and the smallest of their component."""
    fps = np.unique(fps)
    labels = np.arange(len(fps))
    rng = np.random.default_rng(len(fps))
    todo = [np.arange(len(fps))]
    while todo:
        own = todo.pop()
        n = len(own)
        if n < 2:
            continue
        some = fps[own]
        if n <= PAIRS:
            a, b = np.nonzero(np.triu(np.bitwise_count(some[:, None] ^ some[None, :]) <= NEAR, 1))
            _join(labels, own[a], own[b])
            continue
        cut = _cut(some, rng)
        if cut is not None:
            d = _distance(some, cut[0])
            todo += [own[d <= cut[1] + NEAR], own[d > cut[1]]]
            continue
        _join_midpoints(labels, own, some)
    linked = np.flatnonzero(labels != np.arange(len(fps)))
    return fps[linked], fps[labels[linked]]


def links(distinct: DataFrame) -> DataFrame:
    """distinct: (t, fp). Stars (t, a, b) whose components are those of all pairs of a table that differ in at most NEAR
    bits."""
    trees: dict[int, tuple[Tree, int]] = {}
    total = 0
    for r in sorted(distinct.groupBy("t").agg(F.count("*").alias("n")).collect()):
        leaves = min(MOST_LEAVES, -(-r["n"] // LEAF))
        sample = np.empty(0, np.uint64)
        if leaves > 1:
            share = int(min(1.0, PER_LEAF * 2 * leaves / r["n"]) * (1 << 20)) + 1
            got = distinct.filter(F.col("t") == r["t"]).filter(F.pmod(F.xxhash64(F.col("fp"), F.lit(7)), F.lit(1 << 20)) < share).select("fp")
            sample = np.sort(got.toPandas()["fp"].to_numpy(np.int64).view(np.uint64))
        trees[r["t"]] = (Tree(sample, leaves), total)
        total += trees[r["t"]][0].leaves

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            of, fps = np.array(column(b, "t")), np.array(column(b, "fp"), np.int64).view(np.uint64)
            for t in np.unique(of):
                tree, first = trees[int(t)]
                for leaf, own in tree.route(fps[of == t]):
                    n = len(own)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(n, t, np.int32)), pa.array(np.full(n, first + leaf, np.int32)), pa.array(own.view(np.int64))], ["t", "leaf", "fp"])

    def stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by leaf; one leaf is held at a time, as a plain array."""
        now, held = None, []

        def out():
            a, b = leaf_stars(np.concatenate(held))
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), now[0], np.int32)), pa.array(b.view(np.int64)), pa.array(a.view(np.int64))], ["t", "a", "b"])

        for b in batches:
            ts, of, fps = np.array(column(b, "t")), np.array(column(b, "leaf")), np.array(column(b, "fp"), np.int64).view(np.uint64)
            begins = np.flatnonzero(np.diff(of, prepend=-1))
            for begin, end in zip(begins, [*begins[1:], len(of)], strict=True):
                key = (int(ts[begin]), int(of[begin]))
                if held and key != now:
                    yield out()
                    held = []
                now = key
                held.append(fps[begin:end])
        if held:
            yield out()

    routed = distinct.select("t", "fp").mapInArrow(route, "t int, leaf int, fp long").repartition(min(max(1, total), 4096), "leaf").sortWithinPartitions("leaf")
    return routed.mapInArrow(stars, "t int, a long, b long")


def _table_links(distinct: DataFrame) -> DataFrame:
    """distinct: (v, fps). Edges (a, b) between values of v that link in any table, as stars."""
    each = distinct.select("v", F.posexplode("fps").alias("t", "fp"))
    holders = materialize(each.groupBy("t", "fp").agg(F.min("v").alias("holder")))
    same = each.join(holders, ["t", "fp"]).select(F.col("holder").alias("a"), F.col("v").alias("b"))
    end = lambda c: holders.select("t", F.col("fp").alias(c), F.col("holder").alias(f"holder_{c}"))
    near = links(holders.select("t", "fp")).join(end("a"), ["t", "a"]).join(end("b"), ["t", "b"]).select(F.col("holder_a").alias("a"), F.col("holder_b").alias("b"))
    return same.filter("a <> b").union(near)


def near_duplicates(docs: DataFrame, keep: list[str] | None = None, id_col: str = "doc_id", text_col: str = "text", tables: int = 1) -> DataFrame:
    """One row for each row of docs: the columns `keep` (the id by default), fp, component_id (the smallest id reachable)
    and root, which names the component. With one table, documents are told apart by their fingerprint, with more by a
    hash of all of them."""
    keep = keep or [id_col]
    own = F.col("fps")[0] if tables == 1 else F.xxhash64("fps")
    rows = materialize(fingerprints(docs, keep, text_col, tables).select(*keep, own.alias("v"), "fps"))
    distinct = materialize(rows.groupBy("v").agg(F.min(id_col).alias("first_id"), F.min("fps").alias("fps")))
    edges = links(distinct.select(F.lit(0).alias("t"), F.col("fps")[0].alias("fp"))).select("a", "b") if tables == 1 else _table_links(distinct)
    linked = materialize(components(edges).selectExpr("vertex AS v", "root"))
    whole = distinct.join(linked, "v", "left").select("v", "first_id", F.coalesce("root", "v").alias("root"), F.col("root").isNotNull().alias("linked"))
    ids = whole.filter("linked").groupBy("root").agg(F.min("first_id").alias("least_id"))
    of = whole.join(ids, "root", "left").select("v", "root", F.coalesce("least_id", "first_id").alias("component_id"))
    return rows.select(*keep, "v", F.col("fps")[0].alias("fp")).join(of, "v", "left").select(*keep, "fp", "component_id", "root")


def _keyed(docs: DataFrame) -> DataFrame:
    """docs with two hashes of all columns, which tell rows apart."""
    hashed = [F.col(f"`{f.name}`") for f in docs.schema.fields if f.dataType.typeName() not in ("map", "variant")]
    return docs.withColumns({_K1: F.xxhash64(*hashed), _K2: F.xxhash64(F.lit(1), *hashed)})


def _least_of_each(keyed: DataFrame, rows: DataFrame, id_col: str, names: list[str]) -> DataFrame:
    stay = rows.groupBy("root").agg(F.min(F.struct(F.col(id_col).isNull(), F.col(id_col), F.col(_K1), F.col(_K2))).alias("r")).select(f"r.{_K1}", f"r.{_K2}")
    return keyed.join(stay.distinct(), [_K1, _K2], "left_semi").dropDuplicates([_K1, _K2]).select(*[f"`{c}`" for c in names])


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tables: int = 1) -> DataFrame:
    """docs without near-duplicates: of each component the row with the smallest id stays (of rows that tie, one with the
    smallest hash of its columns); all columns stay as they are."""
    keyed = _keyed(docs)
    return _least_of_each(keyed, near_duplicates(keyed, [id_col, _K1, _K2], id_col, text_col, tables), id_col, docs.columns)


# -- links by similarity


def _bands(flat: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """For each set (flat from begins[i] on) a key for each band, of BAND minima under hash functions of their own."""
    rng = np.random.default_rng(SEED)
    out = np.empty((len(begins), BANDS), np.uint64)
    for t in range(BANDS):
        key = np.zeros(len(begins), np.uint64)
        for x, m in rng.integers(0, 2**64, (BAND, 2), dtype=np.uint64):
            key = (key ^ np.minimum.reduceat((flat ^ x) * (m | np.uint64(1)), begins)) * np.uint64(0x9E3779B97F4A7C15)
            key ^= key >> np.uint64(29)
        out[:, t] = key
    return out


def _sketches(docs: DataFrame, keep: list[str], text_col: str, tables: int, shingle: int) -> DataFrame:
    """keep, v (a hash of the set of shingles), n (its size), fps and bands of each row."""
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep) + ", v long, n long, fps array<long>, bands array<long>"

    def lists(values: np.ndarray) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(np.arange(len(values) + 1) * values.shape[1], pa.int32()), pa.array(values.ravel().view(np.int64)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in steps(batches, "_phonolake_text"):
            fps, sets = [], []
            for t in column(b, "_phonolake_text").to_pylist():
                fps.append(fingerprint_tables(t, tables, shingle))
                grams = set(shingles(t, shingle))
                sets.append(np.sort(np.frombuffer(b"".join(xxhash.xxh64_digest(g, SEED) for g in grams), np.uint64)) if grams else np.zeros(1, np.uint64))
            sizes = np.array([len(s) for s in sets])
            v = np.array([xxhash.xxh64_intdigest(s.tobytes(), SEED) for s in sets], np.uint64).view(np.int64)
            bands = _bands(np.concatenate(sets), np.cumsum(sizes) - sizes)
            yield pa.RecordBatch.from_arrays([*(column(b, c) for c in keep), pa.array(v), pa.array(sizes, pa.int64()), lists(np.stack(fps)), lists(bands)], [*keep, "v", "n", "fps", "bands"])

    return docs.select(*keep, F.col(text_col).alias("_phonolake_text")).mapInArrow(run, schema)


def _alike(pairs: DataFrame, texts: DataFrame, shingle: int) -> DataFrame:
    """pairs: (a, b); texts: (v, text). Those pairs whose sets of shingles have a similarity of LEAST_SHARE or more."""
    part, whole = LEAST_SHARE

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, tuple[int | None, set[bytes]]] = {"a": (None, set()), "b": (None, set())}
        for batch in batches:
            good = []
            ends = [column(batch, c) for c in ("a", "b", "text_a", "text_b")]
            for i in range(batch.num_rows):
                for c, end, text in (("a", ends[0], ends[2]), ("b", ends[1], ends[3])):
                    if held[c][0] != end[i].as_py():
                        held[c] = (end[i].as_py(), set(shingles(text[i].as_py(), shingle)))
                x, y = held["a"][1], held["b"][1]
                both = len(x & y)
                good.append(whole * both >= part * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays(ends[:2], ["a", "b"]).filter(pa.array(good, pa.bool_()))

    end = lambda c: texts.select(F.col("v").alias(c), F.col("text").alias(f"text_{c}")).hint("merge")
    return pairs.join(end("a"), "a").join(end("b"), "b").select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long")


def _prefixes(sets: DataFrame, texts: DataFrame, shingle: int) -> DataFrame:
    """sets: (v). (v, size, at, h): of each set's shingles, the rarest among these sets first, those that a set as alike
    as LEAST_SHARE must share one of, without those that no other set has."""
    part, whole = LEAST_SHARE

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in steps(batches):
            own = [np.unique(np.frombuffer(b"".join(xxhash.xxh64_digest(g, SEED) for g in shingles(t, shingle)), np.int64)) for t in column(b, "text").to_pylist()]
            ends = np.cumsum([0, *map(len, own)])
            yield pa.RecordBatch.from_arrays([column(b, "v"), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(own)))], ["v", "hs"])

    each = materialize(sets.select("v").join(texts, "v").select("v", "text").mapInArrow(run, "v long, hs array<long>")).select("v", F.explode_outer("hs").alias("h"))
    held = each.groupBy("h").agg(F.count("*").alias("n"))
    ranked = each.join(held, "h").groupBy("v").agg(F.sort_array(F.collect_list(F.struct("n", "h"))).alias("hs")).withColumn("size", F.size("hs"))
    few = F.col("size") - F.ceil(F.col("size") * part / whole).cast("int") + 1
    some = ranked.select("v", "size", F.posexplode_outer(F.slice("hs", F.lit(1), few)).alias("at", "x")).filter("x.n > 1").select("v", "size", "at", "x.h")
    return materialize(some)


def _meeting(one: DataFrame, other: DataFrame) -> DataFrame:
    """Pairs (a, b) of prefixes that meet in a shingle, if what follows it in either is enough for the overlap wanted. At
    the first shingle that two sets share this holds for all that are alike enough. A set that differs from all others in
    too much begins with shingles that no other has, and meets none."""
    part, whole = LEAST_SHARE
    both = one.join(other.toDF(*(f"{c}_b" if c != "h" else c for c in other.columns)), "h").filter("v <> v_b AND root <> root_b")
    rest = F.least(F.col("size") - F.col("at"), F.col("size_b") - F.col("at_b"))
    fine = both.filter((whole + part) * rest >= part * (F.col("size") + F.col("size_b")))
    return fine.select(F.least("v", "v_b").alias("a"), F.greatest("v", "v_b").alias("b")).distinct()


def similar_rows(docs: DataFrame, keep: list[str], id_col: str = "doc_id", text_col: str = "text", tables: int = 1, shingle: int = SIMILAR_SHINGLE) -> DataFrame:
    """docs with the columns of _keyed. The columns `keep` and root, which names the component, of each row. Rows link if
    their sets of shingles have a similarity of LEAST_SHARE or more. Candidates are the links of the fingerprints and the
    sets that share a band; each is tested on the texts. Sets are tested against the least and the greatest of their
    band first, so copies of one text cost two tests each. Sets of bands that this doesn't link into one go through a
    prefix-filtered join: with the set that has the fewest rarer shingles before the shared one, which of near copies is
    the one nearest to what they are copies of, then with all that don't reach them yet. That loses no link and makes few
    of the pairs that aren't one."""
    rows = materialize(_sketches(docs, list(dict.fromkeys([*keep, _K1, _K2])), text_col, tables, shingle))
    distinct = materialize(rows.groupBy("v").agg(F.min("n").alias("n"), F.min("fps").alias("fps"), F.min("bands").alias("bands"), F.min(F.struct(_K1, _K2)).alias("k")))
    each = distinct.select("v", "n", F.posexplode("bands").alias("t", "band"))
    groups = each.groupBy("t", "band").agg(F.count("*").alias("holders"), F.min("v").alias("least"), F.max("v").alias("most")).filter("holders > 1").drop("holders")
    members = materialize(each.join(groups, ["t", "band"]))
    sizes = distinct.select("v", "n")

    def fitting(pairs: DataFrame) -> DataFrame:  # sets of too different a size can't be alike
        part, whole = LEAST_SHARE
        got = pairs.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        got = got.join(sizes.toDF("a", "n_a"), "a").join(sizes.toDF("b", "n_b"), "b")
        return got.filter(whole * F.least("n_a", "n_b") >= part * F.greatest("n_a", "n_b")).select("a", "b")

    stars = members.selectExpr("least AS a", "v AS b").union(members.selectExpr("most AS a", "v AS b"))
    first = materialize(fitting(_table_links(distinct.select("v", "fps")).union(stars)))
    of = members.select("v").union(first.select("a")).union(first.select("b")).distinct()
    wanted = distinct.join(of, "v", "left_semi").select("v", F.col(f"k.{_K1}").alias(_K1), F.col(f"k.{_K2}").alias(_K2))
    texts = materialize(docs.select(_K1, _K2, F.col(text_col).alias("text")).join(wanted, [_K1, _K2]).dropDuplicates(["v"]).select("v", "text"))
    edges = materialize(_alike(first, texts, shingle))
    roots = materialize(components(edges).selectExpr("vertex AS v", "root"))
    rooted = members.join(roots, "v", "left").select("t", "band", "v", F.coalesce("root", "v").alias("root"))
    apart = rooted.groupBy("t", "band").agg(F.min("root").alias("x"), F.max("root").alias("y")).filter("x <> y").select("t", "band")
    open_ = materialize(rooted.join(apart, ["t", "band"], "left_semi").select("v", "root").distinct())
    prefixes = _prefixes(open_.select("v"), texts, shingle)
    own = prefixes.join(open_, "v").select("v", "root", "size", "at", "h")
    plainest = own.groupBy("h").agg(F.min(F.struct("at", "v", "root", "size")).alias("p")).select("p.v", "p.root", "p.size", "p.at", "h")
    second = materialize(_meeting(own, plainest).join(first, ["a", "b"], "left_anti"))
    edges = materialize(edges.union(_alike(second, texts, shingle)))
    now = materialize(components(edges).selectExpr("vertex AS v", "root"))
    own = materialize(prefixes.join(now, "v", "left").select("v", F.coalesce("root", "v").alias("root"), "size", "at", "h"))
    third = _meeting(own, own).join(first.union(second), ["a", "b"], "left_anti")
    more = materialize(_alike(third, texts, shingle))
    linked = materialize(components(edges.union(more)).selectExpr("vertex AS v", "root"))
    return rows.select(*keep, "v").join(linked, "v", "left").select(*keep, F.coalesce("root", "v").alias("root"))


def one_of_similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tables: int = 1, shingle: int = SIMILAR_SHINGLE) -> DataFrame:
    """As one_of_each, with links by similarity."""
    keyed = _keyed(docs)
    return _least_of_each(keyed, similar_rows(keyed, [id_col, _K1, _K2], id_col, text_col, tables, shingle), id_col, docs.columns)
