"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

A text's features are its words, its pairs of adjacent words, and its pairs with
one or two words between them, each a 32-bit hash; every feature counts once a
text. The model is fitted online: each coordinate has its own learning rate, and
an L1 penalty keeps coordinates at zero until enough evidence has come, so what
is broadcast to score all texts is a short table of weights.

The labelled rows are a bounded sample, drawn by a hash of doc_id; their features
are made in parallel and written, features of too few of these texts are left
out there, and each pass of the fit reads the rows as a stream in one task, with memory
for the coordinates alone.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kestrel.llm.tables import afterwards, read, small
from kestrel.llm.terms import mix
from kestrel.session import written


@dataclass(frozen=True)
class Ftrl:
    """Parameters: bound of the labelled sample, times that the fit goes over it, texts that must have a
    feature, bound of the features; rates alpha and beta, and penalties l1 and l2."""

    labelled: int = 20_000
    epochs: int = 4
    least_texts: int = 3
    features: int = 1 << 18
    alpha: float = 5.0
    beta: float = 1.0
    l1: float = 8.0
    l2: float = 0.0


#: What stands between words: anything but letters, marks and digits.
BETWEEN_WORDS = r"[^\pL\pM\pN]+"

#: Features whose texts a task counts together, about.
TOGETHER = 1 << 21

#: Bytes of text that a worker takes at once; the keys of their words and pairs take many times as much.
AT_ONCE = 1 << 20

#: The kinds of features: single words, and the distances of two words that are paired.
GAPS = (1, 2, 3)


def word_rows(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all lower-cased words of the texts in a row, and the texts' bounds in them."""
    plain = pc.replace_substring_regex(pc.utf8_lower(pc.fill_null(texts.cast(pa.large_string()), "")), BETWEEN_WORDS, " ")
    split = pc.utf8_split_whitespace(pc.utf8_trim_whitespace(plain))
    coded = pc.dictionary_encode(split.flatten())
    names = np.array([xxhash.xxh3_64_intdigest(w) for w in coded.dictionary.to_pylist()], np.uint64)
    hashes = names[coded.indices.to_numpy()] if len(names) else np.zeros(0, np.uint64)
    empty = np.array([xxhash.xxh3_64_intdigest("")], np.uint64)  # an empty text splits into one empty word
    real = hashes != empty[0]
    return hashes[real], np.concatenate([[0], np.cumsum(real)])[split.offsets.to_numpy()]


def feature_rows(hashes: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each kind of feature: the features' 32-bit hashes, and the number of the text of each."""
    text = np.repeat(np.arange(len(bounds) - 1, dtype=np.int32), np.diff(bounds))
    yield (mix(hashes) >> np.uint64(32)).astype(np.uint32), text
    for gap in GAPS:
        whole = text[:-gap] == text[gap:] if len(text) > gap else np.zeros(0, bool)
        pair = mix(mix(hashes[:-gap][whole] + np.uint64(gap)) ^ hashes[gap:][whole]) if len(whole) else np.zeros(0, np.uint64)
        yield (pair >> np.uint64(32)).astype(np.uint32), text[:-gap][whole] if len(whole) else text[:0]


def released(make: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable:
    """``make``, after which the worker gives back what Arrow keeps; it idles beside others then."""
    return lambda batches: afterwards(make(batches), pa.default_memory_pool().release_unused)


def features_of(texts: pa.Array) -> list[np.ndarray]:
    """The distinct features of each text, in order."""
    rows = list(feature_rows(*word_rows(texts)))
    keys = np.unique(np.concatenate([t.astype(np.uint64) << np.uint64(32) | f for f, t in rows]))
    ends = np.searchsorted(keys, np.arange(len(texts) + 1, dtype=np.uint64) << np.uint64(32))
    own = (keys & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    return [own[s:e] for s, e in zip(ends, ends[1:], strict=False)]


def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in small(batches, AT_ONCE):
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([f.tobytes() for f in features_of(batch.column(2))], pa.binary())], ["doc_id", "toxic", "features"])


def own_slots(features: np.ndarray, slots: np.ndarray) -> np.ndarray:
    """The places in ``slots`` of those of the features that are there; both are in order."""
    at = np.searchsorted(slots, features)
    at = at[at < len(slots)]
    return at[slots[at] == features[:len(at)]]


class Learner:
    """FTRL-proximal: for each coordinate the sum of adjusted gradients and of their squares. The last is the bias, which has no penalty."""

    def __init__(self, size: int, p: Ftrl):
        self.p, self.z, self.n = p, np.zeros(size + 1), np.zeros(size + 1)

    def weights(self, at: np.ndarray) -> np.ndarray:
        p, z = self.p, self.z[at]
        l1 = np.where(at == len(self.z) - 1, 0.0, p.l1)
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((p.beta + np.sqrt(self.n[at])) / p.alpha + p.l2))

    def learn(self, at: np.ndarray, label: float) -> None:
        """One text with the coordinates ``at``."""
        at = np.append(at, len(self.z) - 1)
        w = self.weights(at)
        g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - label
        self.z[at] += g - (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / self.p.alpha * w
        self.n[at] += g * g


def sample(docs: DataFrame, labels: DataFrame, p: Ftrl) -> DataFrame:
    """doc_id, toxic, text of at most ``p.labelled`` labelled documents that aren't held out."""
    chosen = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("double").alias("toxic")).dropna()
    chosen = chosen.where(~is_held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(p.labelled)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")
    return rows.groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.min_by("text", F.xxhash64("text")).alias("text"))


def is_held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, p: Ftrl = Ftrl()) -> dict | None:
    """The features with a weight (``slots``, in order), their ``weights`` and the ``bias``; None without labels of both classes."""

    def texts_with(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def total() -> pa.RecordBatch:
            slots, n = np.unique(np.concatenate([np.zeros(0, np.uint32), *held]), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(slots.astype(np.int64)), pa.array(n)], ["slot", "n"])

        size = 0
        for batch in batches:
            for raw in batch.column(0):
                held.append(np.frombuffer(raw.as_buffer(), np.uint32))
                size += len(held[-1])
                if size > TOGETHER:
                    yield total()
                    held, size = [], 0
        yield total()

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches, 4 * AT_ONCE):
            own = [own_slots(np.frombuffer(raw.as_buffer(), np.uint32), shared.value).astype(np.uint32).tobytes() for raw in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(own, pa.binary())], ["doc_id", "toxic", "at"])

    rows = written(sample(docs, labels, p).mapInArrow(released(made), "doc_id long, toxic double, features binary"), "labelled")
    if rows.select((F.col("toxic") > 0.5).alias("t")).distinct().count() < 2:
        return None
    counts = rows.select("features").mapInArrow(released(texts_with), "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n"))
    known = counts.where(F.col("n") >= p.least_texts).orderBy(F.desc("n"), "slot").limit(p.features).toArrow().column("slot").to_numpy()
    shared = docs.sparkSession.sparkContext.broadcast(np.sort(known).astype(np.uint32))
    rows = written(rows.mapInArrow(released(kept), "doc_id long, toxic double, at binary"), "coordinates", instead_of=rows)

    learner = Learner(len(known), p)
    for epoch in range(p.epochs):
        state = docs.sparkSession.sparkContext.broadcast((learner.z, learner.n))

        def learnt(batches: Iterator[pa.RecordBatch], state=state) -> Iterator[pa.RecordBatch]:
            own = Learner(len(shared.value), p)
            own.z, own.n = (x.copy() for x in state.value)
            for batch in batches:
                for label, raw in zip(batch.column(1).to_pylist(), batch.column(2), strict=True):
                    own.learn(np.frombuffer(raw.as_buffer(), np.uint32).astype(np.int64), float(label > 0.5))
            yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in (own.z, own.n)], ["z", "n"])

        # one task reads the written rows in an order of its own each time; nothing is shuffled
        stream = rows.coalesce(1).sortWithinPartitions(F.xxhash64(F.lit(epoch), "doc_id"), "doc_id").select("doc_id", "toxic", "at")
        z, n = stream.mapInArrow(learnt, "z binary, n binary").first()
        learner.z, learner.n = (np.frombuffer(x, np.float64) for x in (z, n))
        state.unpersist()
    w = learner.weights(np.arange(len(known) + 1))
    used = np.flatnonzero(w[:-1])
    return {"slots": shared.value[used], "weights": w[used], "bias": float(w[-1])}


def scores(texts: pa.Array, model: dict) -> np.ndarray:
    """The probability of each text."""
    slots, weights = model["slots"], model["weights"]
    hits = []
    if len(slots):
        for own, text in feature_rows(*word_rows(texts)):
            at = np.minimum(np.searchsorted(slots, own), len(slots) - 1)
            hit = slots[at] == own
            hits.append(text[hit].astype(np.int64) * len(slots) + at[hit])
    own = np.unique(np.concatenate([np.zeros(0, np.int64), *hits]))
    text, at = np.divmod(own, max(1, len(slots)))
    total = np.bincount(text, weights[at] if len(own) else None, minlength=len(texts)) + model["bias"]
    return 1 / (1 + np.exp(-np.clip(total, -35, 35)))


def toxicity(docs: DataFrame, labels: DataFrame, p: Ftrl = Ftrl()) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``, by a model fitted to ``labels``.

    ``docs`` needs ``doc_id`` and ``text``, ``labels`` ``doc_id`` and ``toxic``;
    other columns are not read. Rows are held out from fitting where crc32 of
    doc_id's digits is a multiple of five; a null doc_id is not held out, and has
    no label. A null or empty text has no words, and scores what the bias says.
    Equal texts score alike. Of repeated labels the greater counts; where a
    labelled doc_id has several texts, one is learnt from, by a hash. Without
    labels of both classes every score is 0.
    """
    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    out = out.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "text")
    model = fit(docs, labels, p)
    if model is None:
        return out.select("doc_id", "held_out", F.lit(0.0).alias("score"), F.lit(0).alias("predicted"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches, AT_ONCE):
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(scores(batch.column(2), shared.value))], ["doc_id", "held_out", "score"])

    return out.mapInArrow(released(scored), "doc_id long, held_out boolean, score double").withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
