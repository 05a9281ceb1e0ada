"""Operator 2: approximate nearest neighbours by a hierarchical navigable small-world graph for each shard.

Vectors go to shards by a hash of their id, so equal vectors spread evenly. Every query meets every shard, so their number
mustn't grow with the table: up to SHARDS shards have about SHARD rows each, from there on shards grow instead, until
their vectors have SHARD_BYTES bytes, as a task must hold its graph. A task builds its shard's graph and stores it as flat arrays (vectors, ids, one neighbour array for each level) in the shared folder. There
shards stay: the search sends them the queries, in blocks, some MOST_BYTES of them at a time, and merges the nearest that
each shard finds for each query. Inner product is no distance, so each vector gets
one more component that makes all of a shard equally long; then the largest inner product is the least distance.
Equal vectors of a shard are one node with its ids in order. Points enter the graph in batches that double with it: a
batch searches the graph as it is, sees its own members too, and then all its links are made at once. Search goes down
the levels and then keeps the EF_SEARCH nearest, many queries side by side. The scores that are returned are summed anew
in double precision on the original vectors, component after component, so equal vectors get equal scores everywhere.

Defined results: vectors that are null, empty or zero, or hold null, NaN or infinite components, and rows with null ids
take no part, neither as queries nor as candidates. Vectors meet those of their own dimension only. A query with fewer
candidates than asked for gets all that were found. Ties go to the smaller id. Rows that repeat an id and its vector count
once, as queries and as candidates. Rows that repeat an id with other vectors are candidates each, but not for a query of
the same id, and queries each, ranked apart. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import column, discard, materialize

TOP = 20
#: Rows of a shard at least, shards that aren't exceeded before theirs are full, and bytes of the vectors of a full one.
SHARD, SHARDS, SHARD_BYTES = 8192, 8, 16 << 20
#: Bytes of a block of queries, which one search step takes, and of all queries that are sent to the shards at once.
BLOCK_BYTES, MOST_BYTES = 1 << 20, 16 << 20
LINKS, EF_BUILD, EF_SEARCH = 16, 64, 192
#: Candidates that one step of a search opens for each query at once.
OPEN = 16
LANES = 128


class Graph:
    """data: augmented float32 rows. level k has neighbour array near[k] (rows of the level's nodes, -1 for none); nodes
    are ordered so that those of level k are the first size[k]."""

    def __init__(self, data: np.ndarray, near: list[np.ndarray]):
        self.data, self.near = data, near
        self.square = np.einsum("nd,nd->n", data, data)

    @classmethod
    def build(cls, data: np.ndarray, links: int = LINKS, ef: int = EF_BUILD, seed: int = 42) -> tuple[Graph, np.ndarray]:
        """The graph, and the order in which it holds the rows."""
        n = len(data)
        rng = np.random.default_rng(seed)
        height = np.minimum((rng.exponential(size=n) / np.log(links)).astype(int), 8)
        order = np.argsort(-height, kind="stable")
        data, height = np.ascontiguousarray(data[order]), height[order]
        tops = [int((height >= k).sum()) for k in range(int(height.max(initial=0)) + 1)]
        near: list[np.ndarray] = [np.full((m, 2 * links if k == 0 else links), -1, np.int32) for k, m in enumerate(tops)]
        graph = cls(data, near)
        for k in range(len(tops) - 1, -1, -1):
            graph._fill(k, tops[k], tops[k + 1] if k + 1 < len(tops) else 0, ef)
        return graph, order

    def _fill(self, k: int, n: int, above: int, ef: int) -> None:
        """Links the nodes of level k, those of the levels above first, in doubling batches."""
        near, width = self.near[k], self.near[k].shape[1]
        done = 0
        while done < n:
            batch = np.arange(done, min(n, max(done * 2, 64), done + 1024))
            own = self.data[batch]
            if done:
                enter = self._descend(own, k)
                found, dist = self._search(own, k, enter, min(ef, done), done)
            else:
                found, dist = np.empty((len(batch), 0), np.int64), np.empty((len(batch), 0), np.float32)
            among = _distances(own, own)
            np.fill_diagonal(among, np.inf)
            m = min(width, len(batch) - 1)
            if m > 0:
                pick = np.argpartition(among, m - 1, axis=1)[:, :m]
                found = np.concatenate([found, batch[pick]], axis=1)
                dist = np.concatenate([dist, np.take_along_axis(among, pick, 1)], axis=1)
            chosen = self._prune(found, dist, width // 2 if k == 0 else width)
            near[batch, : chosen.shape[1]] = chosen
            self._back(near, batch, chosen, width)
            done = int(batch[-1]) + 1

    def _prune(self, found: np.ndarray, dist: np.ndarray, most: int) -> np.ndarray:
        """Of each row's candidates, nearest first, those nearer to the row than to any kept one; then the nearest rest."""
        order = np.argsort(dist, axis=1, kind="stable")
        found, dist = np.take_along_axis(found, order, 1)[:, : 3 * most], np.take_along_axis(dist, order, 1)[:, : 3 * most]
        rows, width = found.shape
        out = np.full((rows, most), -1, np.int32)
        for at in range(0, rows, 128):
            f, d = found[at : at + 128], dist[at : at + 128]
            x = self.data[np.maximum(f, 0)]
            sq = np.einsum("rcd,rcd->rc", x, x)
            between = sq[:, :, None] + sq[:, None, :] - 2 * np.matmul(x, x.transpose(0, 2, 1))
            real = np.isfinite(d) & (f >= 0)
            kept = np.zeros(f.shape, bool)
            for j in range(width):
                kept[:, j] = real[:, j] & ~((between[:, j, :j] < d[:, j, None]) & kept[:, :j]).any(axis=1)
            rank = np.where(kept, 0, np.where(real, 1, 2))
            take = np.argsort(rank, axis=1, kind="stable")[:, :most]
            got = np.where(np.take_along_axis(real, take, 1), np.take_along_axis(f, take, 1), -1)
            out[at : at + 128, : got.shape[1]] = got
        return out

    def _back(self, near: np.ndarray, batch: np.ndarray, chosen: np.ndarray, width: int) -> None:
        """The links of a batch, from the other end: where a node gets too many, they are pruned."""
        src = np.repeat(batch, chosen.shape[1])
        dst = chosen.ravel()
        ok = dst >= 0
        src, dst = src[ok], dst[ok]
        order = np.argsort(dst, kind="stable")
        src, dst = src[order], dst[order]
        nodes, begin, count = np.unique(dst, return_index=True, return_counts=True)
        most = int(count.max(initial=0))
        if not most:
            return
        for at in range(0, len(nodes), 512):
            some, b, c = nodes[at : at + 512], begin[at : at + 512], count[at : at + 512]
            wide = int(c.max())
            extra = np.full((len(some), wide), -1, np.int64)
            slot = np.arange(wide) < c[:, None]
            extra[slot] = src[np.repeat(b, c) + np.arange(int(c.sum())) - np.repeat(np.cumsum(c) - c, c)]
            both = np.concatenate([near[some].astype(np.int64), extra], axis=1)
            both = np.sort(both, axis=1)[:, ::-1]
            both[:, 1:][both[:, 1:] == both[:, :-1]] = -1
            both[both == some[:, None]] = -1
            dist = np.where(both >= 0, _row_distances(self.data[some], self.data, both), np.inf)
            few = (both >= 0).sum(axis=1) <= width
            rows = np.flatnonzero(few)
            if len(rows):
                tidy = np.sort(both[rows], axis=1)[:, ::-1][:, :width]
                near[some[rows], : tidy.shape[1]] = tidy
                near[some[rows], tidy.shape[1] :] = -1
            rows = np.flatnonzero(~few)
            if len(rows):
                near[some[rows]] = self._prune(both[rows], dist[rows], width)

    def _descend(self, queries: np.ndarray, to: int) -> np.ndarray:
        """For each query, the node that greedy steps reach on the levels above `to`."""
        at = np.zeros(len(queries), np.int64)
        best = _row_distances(queries, self.data, at[:, None])[:, 0]
        for k in range(len(self.near) - 1, to, -1):
            live = np.arange(len(queries))
            while len(live):
                n = self.near[k][at[live]].astype(np.int64)
                d = np.where(n >= 0, _row_distances(queries[live], self.data, n), np.inf)
                j = d.argmin(axis=1)
                nearer = d[np.arange(len(live)), j] < best[live]
                live, j, d, n = live[nearer], j[nearer], d[nearer], n[nearer]
                at[live], best[live] = n[np.arange(len(live)), j], d[np.arange(len(live)), j]
        return at

    def _search(self, queries: np.ndarray, k: int, enter: np.ndarray, ef: int, n: int) -> tuple[np.ndarray, np.ndarray]:
        """The ef nearest nodes found on level k among its first n, and their distances; -1 and inf where fewer."""
        ids, dists = np.full((len(queries), ef), -1, np.int64), np.full((len(queries), ef), np.inf, np.float32)
        for begin in range(0, len(queries), LANES):
            q = queries[begin : begin + LANES]
            lanes = np.arange(len(q))
            seen, last = np.zeros(len(q) * n, bool), np.empty(len(q) * n, np.int32)
            pool = np.full((len(q), ef), -1, np.int32)
            cost = np.full((len(q), ef), np.inf, np.float32)
            opened = np.ones((len(q), ef), bool)
            first = np.minimum(enter[begin : begin + LANES], n - 1)
            pool[:, 0], cost[:, 0], opened[:, 0] = first, _row_distances(q, self.data, first[:, None])[:, 0], False
            seen[lanes * n + first] = True
            live = lanes
            while len(live):
                todo = np.where(opened[live], np.inf, cost[live])
                j = np.argpartition(todo, OPEN - 1, axis=1)[:, :OPEN] if ef > OPEN else np.argsort(todo, axis=1)
                fresh = np.isfinite(np.take_along_axis(todo, j, 1))
                some = fresh.any(axis=1)
                live, j, fresh = live[some], j[some], fresh[some]
                if not len(live):
                    break
                opened[live[:, None], j] = True
                near = self.near[k][np.maximum(pool[live[:, None], j], 0)].astype(np.int64)
                at = (live[:, None, None] * n + near)[fresh[:, :, None] & (near >= 0) & (near < n)]
                at = at[~seen[at]]
                # a node that several opened ones name counts once, where it is named last
                last[at] = nth = np.arange(len(at), dtype=np.int32)
                at = at[last[at] == nth]
                seen[at] = True
                row, node = np.divmod(at, n)
                count = np.bincount(row, minlength=len(q))[live]
                x, dot, to = self.data[node], np.empty(len(node), np.float32), np.cumsum(count)
                for i, lo, hi in zip(live.tolist(), (to - count).tolist(), to.tolist(), strict=True):
                    np.dot(x[lo:hi], q[i], out=dot[lo:hi])
                slot = np.arange(int(count.max())) < count[:, None]
                d, named = np.full(slot.shape, np.inf, np.float32), np.full(slot.shape, -1, np.int32)
                d[slot], named[slot] = self.square[node] - 2 * dot, node
                all_d = np.concatenate([cost[live], d], axis=1)
                keep = np.argpartition(all_d, ef - 1, axis=1)[:, :ef]
                cost[live] = np.take_along_axis(all_d, keep, 1)
                pool[live] = np.take_along_axis(np.concatenate([pool[live], named], axis=1), keep, 1)
                opened[live] = np.take_along_axis(np.concatenate([opened[live], np.zeros(slot.shape, bool)], axis=1), keep, 1)
            order = np.argsort(cost, axis=1, kind="stable")
            ids[begin : begin + LANES], dists[begin : begin + LANES] = np.take_along_axis(pool, order, 1), np.take_along_axis(cost, order, 1)
        # distances carry the query's own length from here on
        return ids, dists + np.einsum("nd,nd->n", queries, queries)[:, None]

    def search(self, queries: np.ndarray, ef: int = EF_SEARCH) -> np.ndarray:
        n = len(self.data)
        return self._search(queries, 0, self._descend(queries, 0), min(ef, n), n)[0]

    def pack(self) -> dict[str, bytes | list]:
        return {"levels": [len(a) for a in self.near], "widths": [a.shape[1] for a in self.near], "near": b"".join(a.astype("<i4").tobytes() for a in self.near)}

    @classmethod
    def unpack(cls, data: np.ndarray, levels: list[int], widths: list[int], near: bytes) -> Graph:
        flat, out, at = np.frombuffer(near, "<i4"), [], 0
        for m, w in zip(levels, widths, strict=True):
            out.append(flat[at : at + m * w].reshape(m, w))
            at += m * w
        return cls(data, out)


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.einsum("nd,nd->n", a, a)[:, None] + np.einsum("nd,nd->n", b, b)[None, :] - 2 * a @ b.T


def _row_distances(q: np.ndarray, data: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Of row i of q to the data rows ids[i], up to the square length of q[i]."""
    x = data[np.maximum(ids, 0)]
    return np.einsum("rcd,rcd->rc", x, x) - 2 * np.einsum("rcd,rd->rc", x, q)


def _exact(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of rows, in double precision, component after component."""
    out = np.zeros(len(q))
    for j in range(q.shape[1]):
        out += q[:, j] * x[:, j]
    return out


def usable(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    v = F.col(vector_col)
    fine = F.col(id_col).isNotNull() & v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return vectors.filter(F.coalesce(fine, F.lit(False))).select(F.col(id_col).cast("long").alias("vec_id"), F.transform(v, lambda x: x.cast("double")).alias("v"))


def _runs(batches: Iterator[pa.RecordBatch], keys: tuple[str, str]) -> Iterator[tuple[tuple[int, int], list[pa.RecordBatch]]]:
    """Of rows sorted by two whole numbers: those of each pair, as slices."""
    held, key = [], None
    for b in batches:
        one, two = (np.array(column(b, k)) for k in keys)
        cuts = np.flatnonzero((np.diff(one, prepend=-1) != 0) | (np.diff(two, prepend=-1) != 0))
        for lo, hi in zip(cuts, [*cuts[1:], b.num_rows], strict=True):
            now = (int(one[lo]), int(two[lo]))
            if held and now != key:
                yield key, held
                held = []
            key = now
            held.append(b.slice(lo, hi - lo))
    if held:
        yield key, held


def _stacked(parts: list[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray]:
    return np.concatenate([np.array(column(p, "vec_id")) for p in parts]), np.concatenate([np.array(column(p, "v").flatten()).reshape(p.num_rows, -1) for p in parts])


def _dealt(rows: DataFrame, sizes: dict[int, int], salt: int, name: str) -> DataFrame:
    """rows with a number below sizes[dim], sorted by dim and it."""
    of = F.lit(0)
    for dim, n in sizes.items():
        of = F.when(F.col("dim") == dim, F.pmod(F.xxhash64("vec_id", F.lit(salt)), F.lit(n)).cast("int")).otherwise(of)
    dealt = rows.withColumn(name, of).repartition(max(1, sum(sizes.values())), "dim", name)
    return dealt.sortWithinPartitions("dim", name, "vec_id").select("dim", name, "vec_id", "v")


def _sizes(rows: DataFrame, each: Callable[[int, int], int]) -> dict[int, int]:
    return {r["dim"]: -(-r["n"] // each(r["dim"], r["n"])) for r in rows.groupBy("dim").agg(F.count("*").alias("n")).collect()}


def rows_of_shard(dim: int, n: int, least: int = SHARD) -> int:
    """Of a shard, where a table has n vectors of dim components."""
    return max(least, min(-(-n // SHARDS), SHARD_BYTES // (8 * dim)))


def build_index(vectors: DataFrame, shard_rows: int = SHARD) -> DataFrame:
    """vectors: (vec_id, v). One row for each shard: dim, shard and the flat arrays."""
    rows = vectors.select("vec_id", "v", F.size("v").alias("dim"))
    schema = "dim int, shard int, ids binary, counts binary, original binary, levels array<int>, widths array<int>, near binary"
    kinds = [pa.int32(), pa.int32(), *[pa.binary()] * 3, pa.list_(pa.int32()), pa.list_(pa.int32()), pa.binary()]

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, parts in _runs(batches, ("dim", "shard")):
            ids, x = _stacked(parts)
            data, inverse = np.unique(x, axis=0, return_inverse=True)
            inverse = inverse.ravel()
            order = np.lexsort((ids, inverse))
            ids, inverse = ids[order], inverse[order]
            first = np.ones(len(ids), bool)
            first[1:] = (ids[1:] != ids[:-1]) | (inverse[1:] != inverse[:-1])
            ids, inverse = ids[first], inverse[first]
            counts = np.bincount(inverse, minlength=len(data))
            graph, put = Graph.build(augmented(data))
            lists = np.split(ids, np.cumsum(counts)[:-1])
            packed = graph.pack()
            row = [*key, np.concatenate([lists[i] for i in put]).astype("<i8").tobytes(), counts[put].astype("<i4").tobytes(), data[put].astype("<f8").tobytes(), packed["levels"], packed["widths"], packed["near"]]
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, kinds, strict=True)], [f.split()[0] for f in schema.split(", ")])

    return materialize(_dealt(rows, _sizes(rows, lambda dim, n: rows_of_shard(dim, n, shard_rows)), 0, "shard").mapInArrow(build, schema))


def augmented(data: np.ndarray) -> np.ndarray:
    """With the component that makes all rows equally long."""
    length = np.einsum("nd,nd->n", data, data)
    return np.concatenate([data, np.sqrt(np.maximum(0, length.max() - length))[:, None]], axis=1).astype(np.float32)


def search(index: DataFrame, queries: DataFrame, top: int = TOP) -> DataFrame:
    """queries: (vec_id, v). (query_id, rank, vec_id, score), nearest first; a query's own id is no answer."""
    rows = queries.select("vec_id", "v", F.size("v").alias("dim")).distinct()

    def block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, parts in _runs(batches, ("dim", "block")):
            ids, x = _stacked(parts)
            yield pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int32()), pa.array([key[1]], pa.int32()), pa.array([ids.astype("<i8").tobytes()], pa.binary()), pa.array([x.astype("<f8").tobytes()], pa.binary())], ["dim", "block", "q_ids", "q"])

    packed = materialize(_dealt(rows, _sizes(rows, lambda dim, n: max(1, BLOCK_BYTES // (8 * dim))), 1, "block").mapInArrow(block, "dim int, block int, q_ids binary, q binary"))
    size = packed.agg(F.sum(F.octet_length("q") + F.octet_length("q_ids"))).first()[0] or 0
    rounds = max(1, -(-size // MOST_BYTES))

    found = []
    for k in range(rounds):
        blocks = [tuple(r) for r in packed.filter(F.pmod("block", F.lit(rounds)) == k).collect()]  # about MOST_BYTES
        held = index.sparkSession.sparkContext.broadcast(blocks)

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for i in range(b.num_rows):
                    r = {c: column(b, c)[i].as_py() for c in ("dim", "ids", "counts", "original", "levels", "widths", "near")}
                    ids, counts = np.frombuffer(r["ids"], "<i8"), np.frombuffer(r["counts"], "<i4").astype(np.int64)
                    original = np.frombuffer(r["original"], "<f8").reshape(len(counts), -1)
                    graph = Graph.unpack(augmented(original), r["levels"], r["widths"], r["near"])
                    for dim, block, q_ids, q in held.value:
                        if dim == r["dim"]:
                            who, vec, score = answers(graph, original, ids, counts, np.frombuffer(q_ids, "<i8"), np.frombuffer(q, "<f8").reshape(-1, dim), top)
                            nth = np.int64(block) << 32 | who
                            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(nth), dim, np.int32)), pa.array(nth), pa.array(np.frombuffer(q_ids, "<i8")[who]), pa.array(vec), pa.array(score)], ["dim", "nth", "query_id", "vec_id", "score"])

        near = index.mapInArrow(run, "dim int, nth long, query_id long, vec_id long, score double")
        best = near.withColumn("rank", F.row_number().over(Window.partitionBy("dim", "nth").orderBy(F.desc("score"), "vec_id")).cast("int")).filter(F.col("rank") <= top)
        found.append(materialize(best.select("query_id", "rank", "vec_id", "score")))
        held.unpersist()
    discard(packed)
    out = found[0]
    for f in found[1:]:
        out = out.union(f)
    return out


def answers(graph: Graph, original: np.ndarray, ids: np.ndarray, counts: np.ndarray, q_ids: np.ndarray, q: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The nearest of a shard for each query: rows of q, ids and scores, in order. counts: the ids of each node."""
    begin = np.cumsum(counts) - counts
    found = graph.search(np.concatenate([q, np.zeros((len(q), 1))], axis=1).astype(np.float32))
    who, node = np.nonzero(found >= 0)[0], found[found >= 0]
    score = _exact(q[who], original[node])
    # equal vectors come with their ids, least first; of one vector top + 1 can be answers, one being the query's own
    n = np.minimum(counts[node], top + 1)
    who, score = np.repeat(who, n), np.repeat(score, n)
    vec = ids[np.repeat(begin[node] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]
    other = vec != q_ids[who]
    who, score, vec = who[other], score[other], vec[other]
    order = np.lexsort((vec, -score, who))
    who, score, vec = who[order], score[order], vec[order]
    keep = np.arange(len(who)) - np.searchsorted(who, np.arange(len(q)))[who] < top
    return who[keep], vec[keep], score[keep]


def nearest(vectors: DataFrame, every: int = 20) -> DataFrame:
    """The nearest of every row whose id is divisible by `every`, among all rows."""
    rows = usable(vectors)
    return search(build_index(rows), rows.filter(F.pmod("vec_id", F.lit(every)) == 0))
