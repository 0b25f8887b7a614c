"""Approximate nearest neighbours by a robust-pruned directed graph for each shard.

Vectors are dealt to shards by their length, and in a shard to bands of nearly
one length, since among such vectors the largest inner product is the nearest
direction. A band's graph starts from random edges; batches of vectors are then searched for greedily, and the
vectors met on the way become neighbours after robust pruning with a relaxed
distance, which keeps edges short and diverse. Edges are added backwards too
and pruned again. A query runs a beam search in every band of every shard; what
it finds is scored in double precision on the original vectors and merged.

Inner products are searched as distances after the usual lift: vectors get a
further component that brings all of a band to one length.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kestrel.llm.tables import read
from kestrel.session import written


@dataclass(frozen=True)
class Graph:
    """Parameters: rows of a shard, greatest ratio of lengths in a band, edges of a node, beam of build and search, pruning factor."""

    shard_rows: int = 8192
    band: float = 1.1
    degree: int = 28
    build_beam: int = 40
    search_beam: int = 192
    alpha: float = 1.2
    batch: int = 256
    block: int = 512  # queries of a block
    seed: int = 7


def _near(x: np.ndarray, q: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Squared distances of each query to its row of node ids; inf where the id is -1."""
    got = x[np.maximum(ids, 0)]
    d = np.einsum("bkd,bkd->bk", got, got) - 2 * np.einsum("bkd,bd->bk", got, q) + np.einsum("bd,bd->b", q, q)[:, None]
    d[ids < 0] = np.inf
    return d


def beam_search(x: np.ndarray, edges: np.ndarray, starts: np.ndarray, q: np.ndarray, beam: int, expand: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """Nearest nodes found for each query and their distances, nearest first.

    Every step expands the nearest few unexpanded nodes of every query's beam at once.
    """
    n = len(q)
    ids = np.full((n, beam), -1, np.int64)
    ids[:, :len(starts)] = starts
    dist = np.full((n, beam), np.inf, np.float32)
    dist[:, :len(starts)] = _near(x, q, ids[:, :len(starts)])
    done = np.zeros((n, beam), bool)
    live = np.arange(n)
    while len(live):
        open_d = np.where(done[live] | (ids[live] < 0), np.inf, dist[live])
        pick = np.argpartition(open_d, min(expand, beam - 1), axis=1)[:, :expand]
        good = np.isfinite(np.take_along_axis(open_d, pick, 1))
        keep = good.any(1)
        live, pick, good = live[keep], pick[keep], good[keep]
        if not len(live):
            break
        rows = np.arange(len(live))[:, None]
        own_ids, own_d, own_done = ids[live], dist[live], done[live]
        own_done[rows, pick] |= good
        chosen = np.where(good, own_ids[rows, pick], -1)
        more = np.where(chosen[:, :, None] >= 0, edges[np.maximum(chosen, 0)], -1).reshape(len(live), -1)
        order = np.argsort(more, axis=1)
        more = np.take_along_axis(more, order, 1)
        more[:, 1:][more[:, 1:] == more[:, :-1]] = -1
        d = _near(x, q[live], more)
        all_ids = np.concatenate([own_ids, more], 1)
        all_d = np.concatenate([own_d, d.astype(np.float32)], 1)
        all_done = np.concatenate([own_done, np.zeros(more.shape, bool)], 1)
        # a node already in the beam sorts before its repetition, which then goes
        key = np.lexsort((~all_done, all_ids), axis=1)
        s_ids = np.take_along_axis(all_ids, key, 1)
        again = np.zeros(s_ids.shape, bool)
        again[:, 1:] = (s_ids[:, 1:] == s_ids[:, :-1])
        s_d = np.where(again | (s_ids < 0), np.inf, np.take_along_axis(all_d, key, 1))
        s_done = np.take_along_axis(all_done, key, 1)
        top = np.argpartition(s_d, beam - 1, axis=1)[:, :beam]
        ids[live] = np.where(np.isfinite(np.take_along_axis(s_d, top, 1)), np.take_along_axis(s_ids, top, 1), -1)
        dist[live], done[live] = np.take_along_axis(s_d, top, 1), np.take_along_axis(s_done, top, 1)
    order = np.argsort(dist, axis=1, kind="stable")
    return np.take_along_axis(ids, order, 1), np.take_along_axis(dist, order, 1)


def robust_prune(x: np.ndarray, nodes: np.ndarray, pool: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """Edges for each node out of its row of candidates: the nearest one stays, and drops
    every candidate that lies nearer to it, by the factor alpha, than to the node."""
    pool = np.sort(np.where(pool == nodes[:, None], -1, pool), axis=1)
    pool[:, 1:][pool[:, 1:] == pool[:, :-1]] = -1
    d = _near(x, x[nodes], pool)
    order = np.argsort(d, axis=1, kind="stable")
    width = min(4 * degree, int(np.isfinite(d).sum(1).max(initial=0)))
    order = order[:, :width]
    pool, d = np.take_along_axis(pool, order, 1), np.take_along_axis(d, order, 1)
    got = x[np.maximum(pool, 0)]
    length = np.einsum("bkd,bkd->bk", got, got)
    between = alpha * (length[:, :, None] + length[:, None, :] - 2 * (got @ got.transpose(0, 2, 1)))
    out = np.full((len(nodes), degree), -1, np.int64)
    filled = np.zeros(len(nodes), np.int64)
    alive = np.isfinite(d)
    rows = np.arange(len(nodes))
    for _ in range(degree):
        first = alive.argmax(1)
        has = alive[rows, first]
        if not has.any():
            break
        out[rows[has], filled[has]] = pool[rows[has], first[has]]
        filled[has] += 1
        alive &= between[rows, first] > d
        alive[rows, first] = False
    return out


def build(x: np.ndarray, g: Graph) -> tuple[np.ndarray, np.ndarray]:
    """Edges and start nodes of a graph over the rows of ``x``."""
    n, rng = len(x), np.random.default_rng(g.seed)
    degree = min(g.degree, max(1, n - 1))
    starts = np.unique(np.append(np.square(x - x.mean(0)).sum(1).argmin(), rng.integers(0, n, 7)))
    if n <= degree + 1:
        edges = np.array([[j for j in range(n) if j != i] for i in range(n)], np.int64).reshape(n, n - 1)
        return (edges if n > 1 else np.full((1, 1), -1, np.int64)), starts
    edges = rng.integers(0, n, (n, degree))
    for alpha in (1.0, g.alpha):
        order = rng.permutation(n)
        for at in range(0, n, g.batch):
            nodes = order[at:at + g.batch]
            met, _ = beam_search(x, edges, starts, x[nodes], g.build_beam)
            own = robust_prune(x, nodes, np.concatenate([met, edges[nodes]], 1), degree, alpha ** 2)
            edges[nodes] = own
            to, back = own[own >= 0], np.repeat(nodes, (own >= 0).sum(1))
            sort = np.argsort(to, kind="stable")
            to, back = to[sort], back[sort]
            heads, begin, count = np.unique(to, return_index=True, return_counts=True)
            extra = np.full((len(heads), min(int(count.max()), 2 * degree)), -1, np.int64)
            for col in range(extra.shape[1]):
                has = count > col
                extra[has, col] = back[begin[has] + col]
            edges[heads] = robust_prune(x, heads, np.concatenate([edges[heads], extra], 1), degree, alpha ** 2)
    return edges, starts


def lifted(v: np.ndarray, longest: float) -> np.ndarray:
    """Vectors with one more component that brings their length to ``longest``."""
    gap = np.sqrt(np.maximum(0.0, longest ** 2 - np.square(v).sum(1, dtype=np.float64)))
    return np.hstack([v, gap[:, None]]).astype(np.float32)


class Shard:
    """The graphs of a shard's bands, over its distinct vectors; each knows the ids that share it.

    Copies share a node, so that they don't fill each other's edges.
    """

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, g: Graph):
        order = np.lexsort((ids, *vectors.T[::-1]))
        ids, vectors = ids[order], vectors[order]
        new = np.append(True, (vectors[1:] != vectors[:-1]).any(1))
        self.ids, self.begin, nodes = ids, np.append(np.flatnonzero(new), len(ids)), vectors[new]
        single = nodes.astype(np.float32)
        self.nodes = single if (single == nodes).all() else nodes  # as given: scores are made from these
        unit = nodes / np.abs(nodes).max()
        length = np.sqrt(np.square(unit).sum(1))
        by_length, at = np.argsort(length, kind="stable"), 0
        self.bands = []
        while at < len(nodes):
            end = np.searchsorted(length[by_length], length[by_length[at]] * g.band, side="right")
            own, at = by_length[at:end], end
            x = lifted(unit[own] / length[own].max(), 1.0)
            edges, starts = build(x, g)
            self.bands.append((own, x, edges.astype(np.int32), starts))

    def search(self, q_ids: np.ndarray, q: np.ndarray, k: int, g: Graph) -> list[tuple[int, int, float]]:
        """(query id, id, score) of the ``k`` best found for each query."""
        unit = q / np.abs(q).max(1, keepdims=True)
        unit = np.hstack([unit / np.sqrt(np.square(unit).sum(1, keepdims=True)), np.zeros((len(q), 1))]).astype(np.float32)
        beam, met = max(g.search_beam, 2 * k), []
        for own, x, edges, starts in self.bands:
            found, _ = beam_search(x, edges.astype(np.int64), starts[:beam], unit, beam)
            met.append(np.where(found >= 0, own[np.maximum(found, 0)], -1))
        out = []
        for i, nodes in enumerate(np.concatenate(met, 1)):
            nodes = nodes[nodes >= 0]
            scores = (self.nodes[nodes] * q[i]).sum(1)  # row by row alike, so that copies in two shards tie
            best = np.argsort(-scores, kind="stable")[:k + 1]
            # nodes of one score are taken whole, so that ties go by id
            best = np.flatnonzero(scores >= scores[best[-1]])
            rest = [(-s, int(v)) for s, node in zip(scores[best], nodes[best], strict=True) for v in self.ids[self.begin[node]:min(self.begin[node + 1], self.begin[node] + k + 1)] if v != q_ids[i]]
            out += [(int(q_ids[i]), v, -s) for s, v in sorted(rest)[:k]]
        return out


def usable(column: str) -> Column:
    """A vector of finite components that are not all zero."""
    v = F.col(column)
    return v.isNotNull() & F.forall(v, lambda a: a.isNotNull() & ~F.isnan(a) & (F.abs(a) < float("inf"))) & F.exists(v, lambda a: a != 0)


def matrix(column: pa.Array) -> np.ndarray:
    """Lists of one length as rows of doubles."""
    values = column.flatten().to_numpy(zero_copy_only=False)
    return values.reshape(len(column), -1)


def dealt(vectors: DataFrame, shards: int) -> DataFrame:
    """``vectors`` with ``shard``: shares of the order by length; a length that fills several shares is spread over them by hash."""
    length = F.aggregate("embedding", F.lit(0.0), lambda a, x: F.hypot(a, x))
    rows = vectors.select("vec_id", "embedding", length.alias("length"))
    if shards == 1:
        return rows.withColumn("shard", F.lit(0))
    cuts = rows.agg(F.percentile_approx("length", [i / shards for i in range(1, shards)], 100 * shards)).first()[0]
    values, steps = np.unique(np.array(cuts), return_counts=True)
    shared = vectors.sparkSession.sparkContext.broadcast((np.append(values, np.inf), np.append(steps, 0), np.append(0, np.cumsum(steps))))

    @F.pandas_udf("int")
    def share(lengths: pd.Series, hashes: pd.Series) -> pd.Series:
        values, steps, before = shared.value
        at = np.searchsorted(values, lengths.to_numpy())
        spread = np.where(values[at] == lengths, hashes.to_numpy() % (steps[at] + 1), 0)
        return pd.Series(before[at] + spread)

    return rows.withColumn("shard", share("length", F.xxhash64("vec_id")))


def build_index(vectors: DataFrame, g: Graph = Graph()) -> DataFrame:
    """One row for each shard: its number and its graphs, pickled."""
    shards = max(1, -(-vectors.count() // g.shard_rows))

    def made(key: tuple, rows: pa.Table) -> pa.Table:
        shard = Shard(rows.column("vec_id").to_numpy(), matrix(rows.column("embedding").combine_chunks()), g)
        return pa.table({"shard": pa.array([key[0].as_py()], pa.int32()), "graph": pa.array([pickle.dumps(shard, protocol=5)], pa.binary())})

    return dealt(vectors, shards).select("shard", "vec_id", "embedding").groupBy("shard").applyInArrow(made, "shard int, graph binary")


RESULT = "query_id long, vec_id long, score double"


def search(index: DataFrame, queries: DataFrame, k: int, g: Graph = Graph()) -> DataFrame:
    """The ``k`` best of all shards for each query: query_id, rank, vec_id, score.

    Queries travel in blocks to every shard. A task reads a shard's graphs once,
    before the blocks that it is to answer.
    """
    blocks = max(1, -(-queries.count() // g.block))
    packed = queries.groupBy(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).alias("block")).agg(F.collect_list("vec_id").alias("ids"), F.flatten(F.collect_list("embedding")).alias("parts"))
    shards = 1 + (index.agg(F.max("shard")).first()[0] or 0)
    jobs = packed.select("ids", "parts", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"))
    rows = index.select("shard", F.lit(0).alias("kind"), "graph", F.lit(None).cast("array<bigint>").alias("ids"), F.lit(None).cast("array<double>").alias("parts"))
    rows = rows.unionByName(jobs.select("shard", F.lit(1).alias("kind"), F.lit(None).cast("binary").alias("graph"), "ids", "parts"))

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, shard = -1, None
        for batch in batches:
            for own, kind, graph, ids, parts in zip(*batch.columns, strict=True):
                if not kind.as_py():
                    number, shard = own.as_py(), pickle.loads(graph.as_py())
                    continue
                if own.as_py() != number:  # a shard that no vector fell to
                    continue
                q_ids = ids.values.to_numpy()
                out = shard.search(q_ids, parts.values.to_numpy().reshape(len(q_ids), -1), k, g)
                yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], t) for c, t in ((0, pa.int64()), (1, pa.int64()), (2, pa.float64()))], ["query_id", "vec_id", "score"])

    best = rows.repartition(shards, "shard").sortWithinPartitions("shard", "kind").mapInArrow(found, RESULT)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest(vectors: DataFrame, k: int = 20, every: int = 20, g: Graph = Graph()) -> DataFrame:
    """The ``k`` nearest by inner product of every row whose vec_id is divisible by ``every``.

    ``vectors`` needs ``vec_id`` and ``embedding``; other columns are not read.
    Candidates are all rows but the query's own; equal scores go to the smaller
    vec_id. Vectors that are null, zero or hold a null or non-finite component,
    and rows without vec_id, take no part; nor do vectors of another dimension than
    most have (of equally many, the greater counts). Where a vec_id repeats, its
    least vector, component by component, is kept.
    Scores are inner products of the vectors as given, in double precision. A
    table without usable rows gives no rows.
    """
    usable_rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).where(F.col("vec_id").isNotNull() & usable("embedding"))
    usual = usable_rows.groupBy(F.size("embedding").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    if usual is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    usable_rows = usable_rows.where(F.size("embedding") == usual.size).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    index = written(build_index(usable_rows, g), "graph")
    return search(index, usable_rows.where(F.col("vec_id") % every == 0), k, g)


def op2_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(read(spark, sf_dir, "embeddings"))
