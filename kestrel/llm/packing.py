"""Order-preserving packing of token streams by dynamic programming.

Every input partition is one stream of documents in ascending order. A window
may be cut at a document's end, at a sentence's end inside one, or, where a
text offers neither, at a bare token. The cost of a window is its padding, plus
a penalty for the kind of its last cut, plus a charge per window; the least
total over a stream is found with a monotone queue over the window's possible
starts. Streams are handled in chunks, so memory is bounded by a chunk or by
the longest document. Nothing is shuffled.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kestrel.llm.tables import afterwards, read, small
from kestrel.llm.word_ids import WordIds


@dataclass(frozen=True)
class Packing:
    """Parameters: window size, id after each document, cut penalties in tokens of padding."""

    window: int = 4096
    end_id: int = 2
    sentence_penalty: float = 12.0
    bare_penalty: float = 48.0
    window_charge: float = 24.0
    step: int = 16  # least tokens between two sentence cuts
    smallest_power: int = 64  # least window that is left unpadded for being a power of two
    chunk: int = 1 << 19  # tokens


SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, padded_length long"


def boundaries(ids: np.ndarray, ends: np.ndarray, p: Packing) -> tuple[np.ndarray, np.ndarray]:
    """Possible cuts of one document, as counts of ids before them, and their penalties."""
    n = len(ids)
    cuts = np.flatnonzero(ends[ids[:-1]]) + 1
    if len(cuts):
        cuts = cuts[np.diff(cuts // p.step, prepend=-1) > 0]  # the first of each step
    pens = np.full(len(cuts), p.sentence_penalty)
    marks = np.concatenate([[0], cuts, [n]])
    wide = np.flatnonzero(np.diff(marks) > p.window // 4)
    if len(wide):
        bare = np.concatenate([np.arange(marks[i] + p.window // 8, marks[i + 1], p.window // 8) for i in wide])
        cuts, pens = np.concatenate([cuts, bare]), np.concatenate([pens, np.full(len(bare), p.bare_penalty)])
        order = np.argsort(cuts, kind="stable")
        cuts, pens = cuts[order], pens[order]
    return np.append(cuts, n), np.append(pens, 0.0)


def padded(length: int, p: Packing) -> int:
    """A window's length after padding: a power of two stays as it is."""
    return length if length & (length - 1) == 0 else p.window


def best_cuts(at: list[int], pen: list[float], p: Packing) -> list[int]:
    """Indexes of the cheapest cuts that cover ``at[0] .. at[-1]``; ``at[0]`` is the start.

    best[j] = pen[j] + charge + min over starts i of best[i] + padding(at[j] - at[i]).
    With full padding the inner term is window - at[j] + (best[i] + at[i]), a sliding
    minimum; windows that are powers of two are tried besides.
    """
    window, charge = p.window, p.window_charge
    powers = [1 << k for k in range(p.smallest_power.bit_length() - 1, window.bit_length() - 1)]
    best, came, where = [0.0] * len(at), [0] * len(at), {at[0]: 0}
    queue: deque[tuple[float, int]] = deque([(float(at[0]), 0)])
    for j in range(1, len(at)):
        x = at[j]
        while at[queue[0][1]] < x - window:
            queue.popleft()
        key, i = queue[0]
        cost = key + window - x
        for power in powers:
            k = where.get(x - power)
            if k is not None and best[k] < cost:
                cost, i = best[k], k
        cost += pen[j] + charge
        best[j], came[j] = cost, i
        where[x] = j
        key = cost + x
        while queue and queue[-1][0] >= key:
            queue.pop()
        queue.append((key, j))
    out, j = [], len(at) - 1
    while j:
        out.append(j)
        j = came[j]
    return out[::-1]


class Stream:
    """One partition's documents on their way into windows."""

    def __init__(self, part: int, p: Packing):
        self.part, self.p, self.made = part, p, 0
        self.docs: list[list] = []  # doc_id, ids, first unpacked id, cuts, penalties
        self.held = 0

    def add(self, doc_id, ids: np.ndarray, ends: np.ndarray) -> None:
        cuts, pens = boundaries(ids, ends, self.p)
        self.docs.append([doc_id, ids, 0, cuts, pens])
        self.held += len(ids)

    def flush(self, last: bool) -> Iterator[tuple]:
        """Rows of the windows that are settled; the last two stay open until the stream ends."""
        if not self.docs:
            return
        starts = np.cumsum([0] + [len(d[1]) - d[2] for d in self.docs])
        at, pen = [0], [0.0]
        for (_, _, done, cuts, pens), start in zip(self.docs, starts, strict=False):
            keep = cuts > done
            at += (cuts[keep] - done + start).tolist()
            pen += pens[keep].tolist()
        chosen = [at[j] for j in best_cuts(at, pen, self.p)]
        if not last:
            chosen = chosen[:-2]
        d, begin = 0, 0
        for end in chosen:
            offset, sequence = 0, (self.part << 32) + self.made
            self.made += 1
            size = padded(end - begin, self.p)
            while begin < end:
                doc_id, ids, done, _, _ = doc = self.docs[d]
                take = min(end - begin, len(ids) - done)
                piece = ids[done:done + take]
                yield doc_id, done, take, zlib.crc32(piece.astype("<u4").tobytes()), len(ids), sequence, offset, size
                offset, begin, doc[2] = offset + take, begin + take, done + take
                d += doc[2] == len(ids)
        self.docs, self.held = self.docs[d:], self.held - begin


def pack(docs: DataFrame, path: str, p: Packing = Packing()) -> DataFrame:
    """Pieces of the documents of ``docs`` and their places in windows.

    ``docs`` needs ``doc_id`` and ``text``; other columns are not read. A null
    text counts as empty, and an empty one is the end id alone. Documents with
    one doc_id are packed each; ties in the order go by text. Ids come from the
    tokenizer file ``path`` without added specials, then ``p.end_id``. A
    sequence's id names its partition and its number there.
    """

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordIds.of(path)
        return afterwards(pieces(batches, words), words.clear)

    def pieces(batches: Iterator[pa.RecordBatch], words: WordIds) -> Iterator[pa.RecordBatch]:
        stream = Stream(TaskContext.get().partitionId(), p)
        names = [c.split()[0] for c in SCHEMA.split(", ")]

        def rows(last: bool) -> pa.RecordBatch:
            columns = list(zip(*stream.flush(last), strict=True)) or [()] * len(names)
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names)

        for batch in small(batches):
            for doc_id, ids in zip(batch.column(0).to_pylist(), words.encode(batch.column(1).to_pylist()), strict=True):
                stream.add(doc_id, np.append(ids, np.uint32(p.end_id)), words.ends)
                if stream.held >= p.chunk:
                    yield rows(False)
        yield rows(True)

    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return ordered.sortWithinPartitions("doc_id", "text").mapInArrow(packed, SCHEMA)


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    return pack(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
