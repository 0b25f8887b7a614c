"""SimHash fingerprints and the exact search for those within a Hamming radius.

Terms are a text's words and its five-word shingles. Each term's 128-bit hash
votes, with the term's weight, on every bit of the fingerprint. Fingerprints
within radius r are found by permuted block tables: the bits are cut into more
than r blocks, and any two such fingerprints agree on all the blocks of at
least one table.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kestrel.llm.tables import afterwards, read, small
from kestrel.llm.terms import forget, mix, shingle_hashes, word_hashes
from kestrel.session import written

BITS = 128

#: Words of a shingle; votes of a shingle against one of a word.
SHINGLE, SHINGLE_WEIGHT = 5, 2

#: Stands for a missing doc_id in the order.
NAMELESS = -(1 << 63)

#: Production radius, and the blocks that the bits are cut into.
RADIUS, BLOCKS = 4, 5


def votes(terms: np.ndarray) -> tuple[np.ndarray, int]:
    """Set bits' votes and all votes; a term that occurs n times weighs 1 + floor(log2 n)."""
    kinds, counts = np.unique(terms, return_counts=True)
    total, ones = 0, np.zeros(BITS, np.int64)
    while len(kinds):
        total += len(kinds)
        for at in range(0, len(kinds), 1 << 16):
            part = kinds[at:at + (1 << 16)]
            bits = np.unpackbits(np.stack([mix(part), mix(~part)], 1).view(np.uint8).reshape(len(part), -1), axis=1)
            ones += bits.sum(0, dtype=np.int32)
        counts >>= 1
        kinds, counts = kinds[counts > 0], counts[counts > 0]
    return ones, total


def fingerprint(text: str) -> bytes:
    """16 bytes; zeros for a text without words. Equal texts have equal fingerprints."""
    words = word_hashes(text.lower().split())
    if not len(words):
        return bytes(BITS // 8)
    word_ones, word_total = votes(words)
    ones, total = votes(shingle_hashes(words, SHINGLE))
    score = 2 * (word_ones + SHINGLE_WEIGHT * ones) - (word_total + SHINGLE_WEIGHT * total)
    return np.packbits(score > 0).tobytes()


def likeness(a: bytes, b: bytes) -> float:
    """The cosine that the share of differing bits stands for, 0 at least."""
    apart = (int.from_bytes(a) ^ int.from_bytes(b)).bit_count() / BITS
    return max(0.0, math.cos(math.pi * apart))


def in_order(docs: DataFrame, parts: int) -> DataFrame:
    """``docs`` (doc_id, text) in ``parts`` ranges of doc_id, each followed by its successor.

    Adds ``range`` and ``guest``. The first document of a range goes to the range
    before it too, as its guest, and the very first to the last range, so that in
    every range the document after each one is at hand. Only the ranges' bounds,
    a few numbers for each, pass through the driver.
    """
    spark, shares = docs.sparkSession, [i / parts for i in range(1, parts)] or [0.5]
    found = docs.select(F.percentile_approx("doc_id", shares, 100 * max(100, parts))).first()[0]
    bounds = np.unique(np.array(found or [], np.int64))
    ranges = spark.sparkContext.broadcast(bounds)

    @F.pandas_udf("int")
    def range_of(ids: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(ranges.value, ids.to_numpy(), side="left"), dtype="int32")

    firsts = docs.groupBy(range_of("doc_id").alias("range")).agg(F.min("doc_id").alias("first")).sort("range").collect()
    guests = {}
    for before, row in zip([firsts[-1].range] + [r.range for r in firsts], firsts, strict=False):
        guests[row.first] = before
    known = spark.sparkContext.broadcast(guests)

    @F.pandas_udf("array<struct<range:int,guest:boolean>>")
    def places(ids: pd.Series) -> pd.Series:
        own = np.searchsorted(ranges.value, ids.to_numpy(), side="left")
        return pd.Series([[(int(r), False), (known.value[i], True)] if i in known.value else [(int(r), False)] for i, r in zip(ids, own, strict=True)])

    placed = docs.withColumn("place", F.explode(places("doc_id"))).select("doc_id", "text", "place.range", "place.guest")
    return placed.repartition(parts, "range").sortWithinPartitions("range", "guest", "doc_id", "text")


SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, high long, low long"


def _fingerprinted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    held = None  # range, doc_id, text, fingerprint of the document that waits for its successor
    for batch in small(batches):
        rows = []
        for doc_id, text, part, guest in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            if guest and (held is None or held[0] != part):
                continue  # a further row of the first document, or a range's guest that nothing waits for
            mark = fingerprint(text)
            if held is not None and held[0] == part:
                _, own_id, own, own_mark = held
                n = len(own)
                edited = own[:n - n // 4] + text[:n // 4]
                changed = fingerprint(edited)
                high, low = np.frombuffer(own_mark, ">i8").tolist()
                rows.append((own_id, n, hashlib.sha256(edited.encode("utf-8")).hexdigest(), own_mark.hex(), changed.hex(), likeness(own_mark, changed), likeness(own_mark, mark), high, low))
            held = None if guest else (part, doc_id, text, mark)
        columns = list(zip(*rows, strict=True)) or [()] * len(names)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, TYPES, strict=True)], names)


TYPES = [{"long": pa.int64(), "string": pa.string(), "double": pa.float64()}[c.split()[1]] for c in SCHEMA.split(", ")]


def fingerprint_documents(docs: DataFrame, parts: int | None = None) -> DataFrame:
    """Fingerprints of every text of ``docs``, of its edited text, and their likeness.

    ``docs`` needs ``doc_id`` and ``text``; other columns are not read. A null
    text counts as empty; an empty text has the fingerprint of zeros. The edited
    text has the last floor(n_chars / 4) code points replaced by the first as
    many of the next document by doc_id; the first follows the last. Rows with
    one doc_id are taken in the order of their texts; rows without doc_id come
    before all others.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("doc_id", F.coalesce("doc_id", F.lit(NAMELESS)))
    parts = parts or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if docs.isEmpty():
        return docs.sparkSession.createDataFrame([], SCHEMA)
    return in_order(docs, parts).mapInArrow(lambda batches: afterwards(_fingerprinted(batches), forget), SCHEMA).withColumn("doc_id", F.nullif("doc_id", F.lit(NAMELESS)))


def _masks(blocks: int, agree: int) -> list[tuple[int, int, list[int]]]:
    """(mask of the high bits, of the low bits, the blocks) of every table."""
    edges = [BITS * i // blocks for i in range(blocks + 1)]
    whole = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:], strict=False)]
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    out = []
    for chosen in combinations(range(blocks), agree):
        mask = sum(whole[i] for i in chosen)
        out.append((signed(mask >> 64), signed(mask & (1 << 64) - 1), list(chosen)))
    return out


def near_fingerprints(marks: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """All pairs of different fingerprints (high, low) at most ``radius`` bits apart.

    ``marks`` has one row for each fingerprint, so copies never meet here. A pair
    that several tables hold is taken from the first of them.
    """
    tables = _masks(blocks, blocks - radius)
    keyed = marks.select("high", "low", F.explode(F.array(*[
        F.struct(F.lit(t).alias("t"), F.col("high").bitwiseAND(F.lit(h)).alias("kh"), F.col("low").bitwiseAND(F.lit(w)).alias("kl"))
        for t, (h, w, _) in enumerate(tables)])).alias("k")).select("high", "low", "k.*")
    a, b = keyed.alias("a"), keyed.alias("b")
    apart_h, apart_l = F.col("a.high").bitwiseXOR(F.col("b.high")), F.col("a.low").bitwiseXOR(F.col("b.low"))
    first: Column = F.lit(None).cast("int")
    for t, (h, w, _) in reversed(list(enumerate(tables))):
        first = F.when((apart_h.bitwiseAND(F.lit(h)) == 0) & (apart_l.bitwiseAND(F.lit(w)) == 0), F.lit(t)).otherwise(first)
    meet = [F.col("a.t") == F.col("b.t"), F.col("a.kh") == F.col("b.kh"), F.col("a.kl") == F.col("b.kl"),
            (F.col("a.high") < F.col("b.high")) | ((F.col("a.high") == F.col("b.high")) & (F.col("a.low") < F.col("b.low"))),
            F.bit_count(apart_h) + F.bit_count(apart_l) <= radius, first == F.col("a.t")]
    return a.join(b, meet).select(
        F.col("a.high").alias("high"), F.col("a.low").alias("low"), F.col("b.high").alias("other_high"), F.col("b.low").alias("other_low"))


def op1_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents; ``near_fingerprints`` counts the other fingerprints within the radius."""
    made = written(fingerprint_documents(read(spark, sf_dir, "documents")), "fingerprints")
    links = near_fingerprints(made.select("high", "low").distinct())
    ends = links.select(F.explode(F.array(F.struct("high", "low"), F.struct(F.col("other_high").alias("high"), F.col("other_low").alias("low")))).alias("m")).select("m.*")
    counts = ends.groupBy("high", "low").agg(F.count(F.lit(1)).alias("near_fingerprints"))
    return made.join(counts, ["high", "low"], "left").select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next",
        F.coalesce("near_fingerprints", F.lit(0)).alias("near_fingerprints"))
