"""Quality scores by co-training two views of a document.

One view is the text's content: hashed word shapes, hashed words, repetition.
The other is what is known of the page: language, source, sizes and layout.
Each view has a logistic model. Over some rounds each labels those of all
unlabelled documents that it is surest of, for the other to learn from. Both are
then calibrated on held-out labels and combined to score every document.

Features are computed once and written; every round scores all documents from
them, and only the few that it picks go to the models. The labelled rows are a
bounded sample, drawn by a hash of doc_id.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kestrel.llm.tables import afterwards, own_columns, read, small
from kestrel.session import written


@dataclass(frozen=True)
class CoTraining:
    """Parameters: bound of the labelled sample, rounds, pseudo-labels of a view in a round, their least
    certainty, the models' penalty, and the least score that is kept."""

    labelled: int = 6_000
    rounds: int = 4
    per_round: int = 200
    sure: float = 0.97
    ridge: float = 1.0
    keep: float = 0.5


#: Hashed dimensions of shapes, of words, and of language and source.
SHAPES, WORDS, PLACES = 256, 256, 64

CONTENT = SHAPES + WORDS + 6
PAGE = PLACES + 8

_SHAPES = ((re.compile(r"[^\W\d_]*[a-zß-öø-ÿ][^\W\d_]*"), "a"), (re.compile(r"[^\W\d_a]+"), "A"), (re.compile(r"\d+"), "0"))


class _Slots(dict):
    """Shape and word slots of a word, remembered up to a bound."""

    def __missing__(self, word: str) -> tuple[int, int]:
        shape = word
        for pattern, letter in _SHAPES:
            shape = pattern.sub(letter, shape)
        made = (xxhash.xxh32_intdigest(shape) % SHAPES, SHAPES + xxhash.xxh32_intdigest(word.lower()) % WORDS)
        if len(self) > 300_000:
            self.clear()
        self[word] = made
        return made


_slots = _Slots()


def content_view(text: str) -> np.ndarray:
    """Content features: shares of shapes and words, repetition, letters' case, symbols."""
    words = text.split()
    out = np.zeros(CONTENT)
    n = len(words)
    if not n:
        return out
    slots = np.array([_slots[w] for w in words])
    counts = np.bincount(slots.ravel(), minlength=SHAPES + WORDS)
    out[:SHAPES + WORDS] = np.sqrt(counts / n)
    letters, upper = sum(map(text.count, "aeinrst")), sum(map(text.count, "AEINRST"))
    symbols = sum(map(text.count, "#$%&*|!"))
    out[SHAPES + WORDS:] = [
        len(set(words)) / n, sum(a == b for a, b in zip(words, words[1:], strict=False)) / n, upper / (1 + upper + letters),
        min(1.0, symbols / n), min(1.0, sum(map(text.count, "0123456789")) / len(text)), min(1.0, text.count(".") / n)]
    return out


def page_view(text: str, lang: str, source: str) -> np.ndarray:
    """Page features: language and source, sizes, layout of lines."""
    out = np.zeros(PAGE)
    out[xxhash.xxh32_intdigest("l" + lang) % PLACES] = 1
    out[xxhash.xxh32_intdigest("s" + source) % PLACES] += 1
    n, words = len(text), text.count(" ") + 1
    lengths = [len(x) for x in text.split("\n")]
    out[PLACES:] = [
        np.log1p(n) / 10, np.log1p(len(lengths)) / 5, np.log1p(max(lengths)) / 10, np.log1p(n / len(lengths)) / 10, n / words / 10,
        sum(x < 40 for x in lengths) / len(lengths), (n - len(text.encode("ascii", "ignore"))) / (1 + n), len(set(lengths)) / len(lengths)]
    return out


def with_views(docs: DataFrame) -> DataFrame:
    """doc_id, text, lang, source, with nulls as empty strings."""
    text = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) if c in docs.columns else F.lit("").alias(c) for c in ("text", "lang", "source")]
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), *text)


VIEWS = "doc_id long, t1 long, t2 long, content binary, page binary"


def _views(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return afterwards(_made(batches), _slots.clear)


def _made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in small(batches):
        doc_id, text, lang, source, t1, t2 = batch.columns
        text, lang, source = text.to_pylist(), lang.to_pylist(), source.to_pylist()
        content = [content_view(t).astype(np.float32).tobytes() for t in text]
        page = [page_view(*x).astype(np.float32).tobytes() for x in zip(text, lang, source, strict=True)]
        yield pa.RecordBatch.from_arrays([doc_id, t1, t2, pa.array(content, pa.binary()), pa.array(page, pa.binary())], [c.split()[0] for c in VIEWS.split(", ")])


def featured(docs: DataFrame) -> DataFrame:
    """doc_id, both views, and a 128-bit name (t1, t2) of what they are made of, for every row of ``docs``; written."""
    rows = with_views(docs)
    own = ("text", "lang", "source")
    rows = rows.select("doc_id", *own, F.xxhash64(*own).alias("t1"), F.xxhash64(F.lit(1), *own).alias("t2"))
    return written(rows.mapInArrow(_views, VIEWS), "views")


def unpacked(column: pa.Array) -> np.ndarray:
    """Rows of packed floats."""
    return np.array([np.frombuffer(x.as_buffer(), np.float32) for x in column], np.float64)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float) -> np.ndarray:
    """Weights, the last one the bias, by Newton's method."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w, penalty = np.zeros(x.shape[1]), np.full(x.shape[1], ridge)
    penalty[-1] = 1e-6
    for _ in range(25):
        p = sigmoid(x @ w)
        step = np.linalg.solve((x * (p * (1 - p) + 1e-6)[:, None]).T @ x + np.diag(penalty), x.T @ (p - y) + penalty * w)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def logit(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return x @ w[:-1] + w[-1]


def surest(features: DataFrame, weights: list[np.ndarray], used: set[tuple[int, int]], p: CoTraining, shares: tuple[float, float]) -> list[list[tuple]]:
    """Of all rows of ``features``: for each view and label, the (t1, t2, content, page) that the view is surest of.

    Equal documents count once. Each partition hands on as many as a round may
    take, so the driver sees a bounded number.
    """
    shared = features.sparkSession.sparkContext.broadcast((weights, used))
    most = [[max(1, round(p.per_round * share)) for share in shares] for _ in weights]

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models, taken = shared.value
        heaps: list[list[list[tuple]]] = [[[], []] for _ in models]
        held: dict[tuple, None] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            t1, t2 = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for view, (w, column) in enumerate(zip(models, (2, 3), strict=True)):
                sure = sigmoid(logit(unpacked(batch.column(column)), w))
                for label, certain in ((1, sure), (0, 1 - sure)):
                    heap, room = heaps[view][label], most[view][label]
                    for i in np.lexsort((t2, t1, -certain)):
                        entry = (float(certain[i]), int(t1[i]), int(t2[i]))
                        if certain[i] < p.sure or (len(heap) >= room and entry[0] < heap[-1][0]):
                            break
                        if entry[1:] not in taken and not any(e[1:3] == entry[1:] for e in heap):
                            heap.append((*entry, batch.column(2)[i].as_py(), batch.column(3)[i].as_py()))
                    heap.sort(key=lambda e: (-e[0], e[1:3]))
                    del heap[room:]
        out = [(view, label, *e) for view, labels in enumerate(heaps) for label, heap in enumerate(labels) for e in heap]
        yield pa.RecordBatch.from_pylist([dict(zip(("view", "label", "certain", "t1", "t2", "content", "page"), e, strict=True)) for e in out], SUREST)

    rows = features.select("t1", "t2", "content", "page").mapInArrow(best, "view int, label int, certain double, t1 long, t2 long, content binary, page binary").dropDuplicates(["view", "label", "t1", "t2"])
    # one scoring pass: what the partitions hand on is ranked apart for each view and label, in shares first
    for share in ([F.pmod(F.xxhash64("t1", "t2"), F.lit(64))], []):
        rank = F.row_number().over(Window.partitionBy("view", "label", *share).orderBy(F.desc("certain"), "t1", "t2"))
        rows = rows.withColumn("rank", rank).where(F.col("rank") <= max(map(max, most))).drop("rank")
    out: list[list[tuple]] = [[] for _ in range(4)]
    for r in sorted(rows.collect(), key=lambda r: (-r.certain, r.t1, r.t2)):
        if len(out[2 * r.view + r.label]) == most[r.view][r.label]:
            continue
        out[2 * r.view + r.label].append(((r.t1, r.t2), r.content, r.page))
    return out


SUREST = pa.schema([("view", pa.int32()), ("label", pa.int32()), ("certain", pa.float64()), ("t1", pa.int64()), ("t2", pa.int64()), ("content", pa.binary()), ("page", pa.binary())])


def co_train(views: list[np.ndarray], y: np.ndarray, pool: Callable[[list[np.ndarray], set, tuple[float, float]], list[list[tuple]]], p: CoTraining, names: set[tuple[int, int]] = frozenset()) -> dict:
    """Weights of both views, and those that combine their calibrated logits.

    Every fifth labelled row is held out for calibration. ``pool`` gives the
    unlabelled documents that views with some weights are surest of; ``names`` are
    those that have labels.
    """
    held = np.arange(len(y)) % 5 == 0
    if min(y[held].sum(), (1 - y[held]).sum()) < 2:
        held[:] = False
    fit = ~held
    own = [[v[fit]] for v in views]
    target = [[y[fit]], [y[fit]]]
    used = set(names)
    weights = [logistic(v[fit], y[fit], p.ridge) for v in views]
    for _ in range(p.rounds):
        found = pool(weights, used, (1 - y.mean(), y.mean()))
        for view, other in ((0, 1), (1, 0)):
            for label in (0, 1):
                new = [x for x in found[2 * view + label] if x[0] not in used]
                used.update(x[0] for x in new)
                if new:
                    own[other].append(np.array([np.frombuffer(x[1 + other], np.float32) for x in new], np.float64))
                    target[other].append(np.full(len(new), float(label)))
        weights = [logistic(np.concatenate(own[i]), np.concatenate(target[i]), p.ridge) for i in (0, 1)]
    rows = held if held.any() else fit
    calibrated = [logistic(logit(v[rows], w)[:, None], y[rows], 0.01) for v, w in zip(views, weights, strict=True)]
    both = np.stack([logit(logit(v[rows], w)[:, None], c) for v, w, c in zip(views, weights, calibrated, strict=True)], 1)
    return {"weights": weights, "calibrated": calibrated, "combined": logistic(both, y[rows], 0.01)}


def combine(model: dict, views: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Combined and single probabilities."""
    both = np.stack([logit(logit(v, w)[:, None], c) for v, w, c in zip(views, model["weights"], model["calibrated"], strict=True)], 1)
    return sigmoid(logit(both, model["combined"])), sigmoid(both[:, 0]), sigmoid(both[:, 1])


def fit(features: DataFrame, labels: DataFrame, p: CoTraining = CoTraining()) -> dict | None:
    """The model fitted to ``features`` (of ``featured``) and ``labels``, or None where the labels lack a class."""
    chosen = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("double").alias("quality")).dropna()
    chosen = chosen.groupBy("doc_id").agg(F.max("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(p.labelled)
    rows = features.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min_by(F.struct("quality", "t1", "t2", "content", "page"), F.struct("t1", "t2")).alias("r"))
    found = rows.select("doc_id", "r.*").toPandas().sort_values("doc_id", kind="stable")
    y = (found["quality"].to_numpy() > 0.5).astype(np.float64)
    if len(set(y)) < 2:
        return None
    views = [np.stack([np.frombuffer(b, np.float32) for b in found[c]]).astype(np.float64) for c in ("content", "page")]
    names = set(zip(found["t1"].tolist(), found["t2"].tolist(), strict=True))
    return co_train(views, y, lambda weights, used, shares: surest(features, weights, used, p, shares), p, names)


def score(features: DataFrame, model: dict | None, p: CoTraining = CoTraining()) -> DataFrame:
    """doc_id, t1, t2, score, content_score, page_score, keep for every row of ``features``."""
    schema = "doc_id long, t1 long, t2 long, score double, content_score double, page_score double"
    if model is None:
        ones = [F.lit(1.0).alias(c) for c in ("score", "content_score", "page_score")]
        return features.select("doc_id", "t1", "t2", *ones, F.lit(True).alias("keep"))
    shared = features.sparkSession.sparkContext.broadcast(model)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            views = [unpacked(batch.column(3)).reshape(batch.num_rows, CONTENT), unpacked(batch.column(4)).reshape(batch.num_rows, PAGE)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *map(pa.array, combine(shared.value, views))], [c.split()[0] for c in schema.split(", ")])

    return features.mapInArrow(scored, schema).withColumn("keep", F.col("score") >= p.keep)


def accepted(docs: DataFrame, labels: DataFrame, p: CoTraining = CoTraining()) -> DataFrame:
    """The rows of ``docs``, all columns, that a model fitted to ``labels`` scores ``p.keep`` at least.

    Rows are known by what they are scored from, not by doc_id, which may be null or repeated.
    """
    features = featured(docs)
    rejected = score(features, fit(features, labels, p), p).where("NOT keep").select("t1", "t2").distinct()
    own = [F.coalesce(F.col(c).cast("string"), F.lit("")) if c in docs.columns else F.lit("") for c in ("text", "lang", "source")]
    rows = docs.select(F.struct(*own_columns(docs)).alias("row"), F.xxhash64(*own).alias("t1"), F.xxhash64(F.lit(1), *own).alias("t2"))
    left = rows.join(rejected, ["t1", "t2"], "left_anti")
    return left.select(*[F.col("row")[c].alias(c) for c in docs.columns])


def classify(docs: DataFrame, labels: DataFrame, p: CoTraining = CoTraining()) -> DataFrame:
    """doc_id, score, content_score, page_score, keep for all rows of ``docs``, by a model fitted to ``labels``.

    ``docs`` needs ``doc_id`` and ``text``, and uses ``lang`` and ``source``
    where it has them; other columns are not read. ``labels`` needs ``doc_id`` and
    ``quality`` (1 good, 0 bad). Nulls count as empty texts; texts of any length
    are read whole. Of repeated labels the greater counts; where a labelled doc_id
    has several texts, one of them is learnt from, by a hash. Ties between equally
    sure documents go by a hash of their content. Equal rows score alike. Without
    labels of both classes every document scores 1.
    """
    features = featured(docs)
    return score(features, fit(features, labels, p), p).drop("t1", "t2")


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
