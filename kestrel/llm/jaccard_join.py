"""Similarity join of documents by Jaccard over word shingles: a chosen-path join.

Sets are embedded as 64 sampled tokens each. A run starts with all sets in one
bucket; a bucket is split on a few of its token positions, drawn from the
bucket's path, so that sets that share the token stay together. Small buckets
are compared by brute force, large ones are split again, and what is still
large at the last level is compared in blocks. The number of runs follows from
the target recall. What the buckets suggest is grouped, and within each group
the exact Jaccard of all pairs is computed from the whole texts, in blocks too,
so that no pair is ever a row of its own.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kestrel.llm.components import components
from kestrel.llm.tables import afterwards, own_columns, read, small
from kestrel.llm.terms import ODD_2, ODD_3, forget, mix, shingle_hashes, word_hashes
from kestrel.session import written

WORDS = re.compile(r"\w+")


@dataclass(frozen=True)
class Join:
    """Parameters: shingle size, threshold, embedding, splitting and target recall."""

    shingle: int = 5
    threshold: float = 0.8
    tokens: int = 64
    positions: int = 2  # split positions drawn in a bucket
    leaf: int = 256  # sets that are compared by brute force
    levels: int = 3
    block: int = 512  # sets of a block where a bucket or group is larger
    recall: float = 0.999
    slack: float = 3.5  # standard deviations that an estimate may fall short

    @property
    def runs(self) -> int:
        """Runs that bring a pair at the threshold together with the target recall."""
        met = 1.0
        for _ in range(self.levels):
            met = 1 - (1 - self.threshold * met) ** self.positions
        return max(1, math.ceil(math.log(1 - self.recall) / math.log(1 - met)))

    @property
    def agreeing(self) -> int:
        """Tokens that a candidate pair shares at least."""
        t = self.threshold
        return max(1, math.floor(self.tokens * (t - self.slack * math.sqrt(t * (1 - t) / self.tokens))))


def shingle_set(text: str | None, size: int) -> np.ndarray:
    """Sorted distinct hashes of the text's shingles; texts of fewer words have one for all of them."""
    return np.unique(shingle_hashes(word_hashes(WORDS.findall((text or "").lower())), size))


def named(shingles: np.ndarray) -> tuple[int, int]:
    """The set's 128-bit name."""
    return tuple(np.frombuffer(xxhash.xxh3_128_digest(shingles.tobytes()), np.int64).tolist())


def embedding(shingles: np.ndarray, tokens: int) -> np.ndarray:
    """The low halves of the least of ``tokens`` independent hashes of the shingles.

    Each is shared with a chance of the Jaccard and regardless of the others, in
    sets of any size.
    """
    odd = mix(np.arange(tokens, dtype=np.uint64)) | np.uint64(1)
    least = np.full(tokens, ~np.uint64(0))
    for at in range(0, len(shingles), 512):
        x = shingles[at:at + 512, None] * odd
        x ^= x >> np.uint64(32)
        x *= ODD_2
        x ^= x >> np.uint64(29)
        x *= ODD_3
        np.minimum(least, x.min(0), out=least)
    return least.astype(np.uint32)


def embedded(docs: DataFrame, j: Join) -> DataFrame:
    """doc_id, the set's 128-bit name (two longs) and its tokens; null for texts without words."""
    schema = "doc_id long, h1 long, h2 long, sig binary"

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            h1, h2, sig = [], [], []
            for text in batch.column(1).to_pylist():
                s = shingle_set(text, j.shingle)
                if len(s):
                    a, b = named(s)
                    h1.append(a), h2.append(b), sig.append(embedding(s, j.tokens).tobytes())
                else:
                    h1.append(None), h2.append(None), sig.append(None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), pa.array(sig, pa.binary())], ["doc_id", "h1", "h2", "sig"])

    return docs.select("doc_id", "text").mapInArrow(lambda batches: afterwards(made(batches), forget), schema)


def split(rows: DataFrame, j: Join, level: int) -> DataFrame:
    """Children (node, rep, sig) of buckets: one for each position that a bucket's path draws."""
    start = [F.pmod(F.xxhash64("node", F.lit(level), F.lit(p)), F.lit(j.tokens // j.positions)).cast("int") + F.lit(p * (j.tokens // j.positions)) for p in range(j.positions)]
    picked = rows.withColumn("at", F.explode(F.array(*start)))
    token = F.substring("sig", F.col("at") * 4 + 1, F.lit(4))
    return picked.select(F.xxhash64("node", F.lit(level), "at", token).alias("node"), "rep", "sig")


def leaves(reps: DataFrame, j: Join) -> DataFrame:
    """node, size, rep, sig of every bucket that is not split further and has two sets at least."""
    rows = reps.select("rep", "sig", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(j.runs).cast("long"))).alias("node"))
    done = None
    for level in range(1, j.levels + 1):
        rows = split(rows, j, level)
        sizes = rows.groupBy("node").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
        known = rows.join(sizes, "node").select("node", "size", "rep", "sig")
        if level < j.levels:
            known = written(known, "buckets")
            rows = known.where(F.col("size") > j.leaf).select("node", "rep", "sig")
            known = known.where(F.col("size") <= j.leaf)
        done = known if done is None else done.union(known)
        if level < j.levels and rows.isEmpty():
            break
    return done


def in_blocks(rows: DataFrame, key: str, j: Join) -> DataFrame:
    """Rows of a large group, copied to every pair of its blocks; ``a`` and ``b`` name the pair, ``own`` the row's block."""
    blocks = F.ceil(F.col("size") / F.lit(j.block)).cast("int")
    rows = rows.withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.withColumn("a", F.least("own", "other")).withColumn("b", F.greatest("own", "other")).drop("blocks", "other", "size")
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(parts, key, "a", "b").sortWithinPartitions(key, "a", "b", "rep")


def groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[list[tuple]]:
    """Runs of rows that agree in their first ``keys`` columns."""
    held: list[tuple] = []
    for batch in small(batches):
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if held and held[-1][:keys] != row[:keys]:
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def forest(n: int, linked: Callable[[int], np.ndarray]) -> Iterator[tuple[int, int]]:
    """Edges that connect what ``linked`` (later partners of i) connects, n - 1 at most."""
    label = np.arange(n)
    for i in range(n):
        js = linked(i)
        for other in np.unique(label[js]):
            if other != label[i]:
                yield i, int(js[label[js] == other][0])
                label[label == other] = label[i]


def candidate_edges(found: DataFrame, j: Join) -> DataFrame:
    """x, y: edges that connect the sets of a leaf whose tokens agree enough."""

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in groups(batches, 3):
            sig = np.frombuffer(b"".join(r[5] for r in rows), np.uint32).reshape(len(rows), -1)
            ids = [r[4] for r in rows]
            hits = lambda i: i + 1 + np.flatnonzero((sig[i + 1:] == sig[i]).sum(1) >= j.agreeing)  # noqa: B023, E731
            pairs = [(ids[x], ids[y]) for x, y in forest(len(ids), hits)]
            if pairs:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*pairs, strict=True)], ["x", "y"])

    return in_blocks(found, "node", j).select("node", "a", "b", "own", "rep", "sig").mapInArrow(compared, "x long, y long")


def shared_counts(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections, from an incidence matrix in slices of columns."""
    n = len(sets)
    kinds, which, df = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    often = df[which] > 1
    column = np.cumsum(df > 1) - 1
    owner, at = owner[often], column[which[often]]
    out, width = np.zeros((n, n), np.float32), max(256, (1 << 22) // n)
    order = np.argsort(at, kind="stable")
    owner, at = owner[order], at[order]
    for begin in range(0, int((df > 1).sum()), width):
        lo, hi = np.searchsorted(at, [begin, begin + width])
        x = np.zeros((n, width), np.float32)
        x[owner[lo:hi], at[lo:hi] - begin] = 1
        out += x @ x.T
    return out


def verified(members: DataFrame, j: Join) -> DataFrame:
    """Exact links inside groups: (x, y) edges that connect them, and (x, links) sums over partners' copies."""
    schema = "x long, y long, links long"

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in groups(batches, 3):
            if len(rows) < 2:
                continue
            _, a, b = rows[0][:3]
            # of an id's several texts the one that the set is of, and of repeated rows one
            made = {r[4]: (r, s) for r in rows for s in [shingle_set(r[6], j.shingle)] if named(s) == r[7:9]}
            if len(made) < 2:
                continue
            rows, sets = [r for r, _ in made.values()], [s for _, s in made.values()]
            own, ids = np.array([r[3] for r in rows]), [r[4] for r in rows]
            copies = np.array([r[5] for r in rows], np.int64)
            sizes = np.array([len(s) for s in sets], np.float64)
            shared = shared_counts(sets)
            near = shared >= j.threshold * (sizes[:, None] + sizes[None, :] - shared) - 1e-9
            np.fill_diagonal(near, False)
            if a != b:
                near &= own[:, None] != own[None, :]
            edges = [(ids[x], ids[y], None) for x, y in forest(len(ids), lambda i: i + 1 + np.flatnonzero(near[i, i + 1:]))]  # noqa: B023
            sums = near @ copies
            out = edges + [(ids[i], None, int(sums[i])) for i in np.flatnonzero(sums)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], ["x", "y", "links"])

    return in_blocks(members, "component", j).select("component", "a", "b", "own", "rep", "copies", "text", "h1", "h2").mapInArrow(lambda batches: afterwards(compared(batches), forget), schema)


def near_duplicates(docs: DataFrame, j: Join = Join()) -> DataFrame:
    """doc_id, class_id, n_links for every row of ``docs``.

    ``docs`` needs ``doc_id`` and ``text``; other columns are not read. n_links
    counts the other documents whose shingle sets have a Jaccard of at least the
    threshold; a class is what such links connect, named by its least doc_id.
    Equal sets are joined once and counted as often as they occur, in repeated
    rows too. Null and empty texts, texts without any word, and rows without
    doc_id are like nothing: class of their own, no links. A doc_id's several
    texts are documents each, under one name.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sets = written(embedded(docs, j), "sets")
    reps = written(
        sets.where("h1 IS NOT NULL AND doc_id IS NOT NULL").groupBy("h1", "h2")
        .agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("copies"), F.first("sig").alias("sig")).withColumn("rep", F.monotonically_increasing_id()), "reps")
    grouped = components(candidate_edges(leaves(reps, j), j))
    grouped = grouped.withColumnRenamed("node", "rep")
    sizes = grouped.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    members = grouped.join(sizes, "component").join(reps.select("rep", "first", "copies", "h1", "h2"), "rep")
    members = members.join(docs.select(F.col("doc_id").alias("first"), "text"), "first")
    links = written(verified(members, j), "links")
    classes = components(links.where("y IS NOT NULL").select("x", "y")).select(F.col("node").alias("rep"), "component")
    counts = links.where("links IS NOT NULL").groupBy(F.col("x").alias("rep")).agg(F.sum("links").alias("links"))
    names = classes.join(reps.select("rep", "first"), "rep").groupBy("component").agg(F.min("first").alias("name"))
    classes = classes.join(names, "component").select("rep", "name")
    known = reps.select("h1", "h2", "rep", "first", "copies").join(classes, "rep", "left").join(counts, "rep", "left").select(
        "h1", "h2", F.coalesce("name", "first").alias("class_id"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    found = F.when(F.col("doc_id").isNotNull(), F.col("h1")).alias("h1")
    return sets.select("doc_id", found, "h2").join(known, ["h1", "h2"], "left").select(
        "doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def one_of_each(docs: DataFrame, j: Join = Join()) -> DataFrame:
    """``docs`` with the document of least doc_id of each class.

    Of rows that share a doc_id one stays, if any does; rows without one all stay.
    """
    gone = near_duplicates(docs, j).where("class_id <> doc_id").select("doc_id").distinct()
    left = docs.where("doc_id IS NOT NULL").join(gone, "doc_id", "left_anti")
    left = left.select(*own_columns(docs))
    return left.dropDuplicates(["doc_id"]).unionByName(docs.where("doc_id IS NULL"))


def op7_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"))
