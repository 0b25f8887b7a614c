"""Token counts by a map-side two-tier lookup.

Tier one is a broadcast table of the lengths, in tokens, of the corpus's most
frequent pre-tokens. Tier two is a bounded cache in each Python worker, filled
by encoding what tier one misses. No pre-token is ever shuffled: the frequent
ones are found from one bounded summary per partition.

A pre-token here is what stands between two single spaces, with the space that
leads it. A byte-level BPE with the usual pattern never merges across such a
place, so the counts add up to the library's. Texts with two white-space
characters side by side go to the library whole.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kestrel.llm.tables import read, small

#: Bounds: entries of the broadcast table, of a partition's summary, of a worker's cache; longest cached pre-token.
FREQUENT, SUMMARY, CACHE, LONGEST = 65_536, 8_192, 400_000, 64

PAIR = re.compile(r"[\s\u180e]{2}")

_tokenizers: dict = {}
_caches: dict = {}


def tokenizer(path: str):
    """The library's tokenizer, one per worker process and file."""
    if path not in _tokenizers:
        import os
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        made = Tokenizer.from_file(path)
        made.no_padding()
        made.no_truncation()
        _tokenizers[path] = made
    return _tokenizers[path]


def lengths(tok, texts: list[str]) -> list[int]:
    """Tokens of each text as the library gives them."""
    return [len(e.ids) for e in tok.encode_batch(texts, add_special_tokens=False)] if texts else []


def summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The partition's most frequent pre-tokens with lossy counts."""
    counts: Counter = Counter()
    for batch in small(batches):
        for text in batch.column(0).to_pylist():
            if text and not PAIR.search(text):
                counts.update(text.split(" ")[1:])
                if len(counts) > 24 * SUMMARY:
                    counts = Counter(dict(counts.most_common(8 * SUMMARY)))
    kept = [(k, n) for k, n in counts.most_common(SUMMARY) if n > 1 and len(k) <= LONGEST]
    yield pa.RecordBatch.from_pydict({"piece": pa.array([k for k, _ in kept], pa.string()), "n": pa.array([n for _, n in kept], pa.int64())})


def frequent_lengths(texts: DataFrame, path: str, size: int = FREQUENT) -> dict[str, int]:
    """Token lengths of at most ``size`` frequent pre-tokens of the whole table.

    The result only speeds the lookup; it never changes a count.
    """
    found = texts.mapInArrow(summaries, "piece string, n long").groupBy("piece").agg(F.sum("n").alias("n"))
    pieces = [r.piece for r in found.orderBy(F.desc("n"), "piece").limit(size).collect()]
    return dict(zip(pieces, lengths(tokenizer(path), [" " + p for p in pieces]), strict=True))


def count_batch(texts: list[str], tok, frequent: dict[str, int], cache: dict[str, int]) -> list[int]:
    """Tokens of each text: sums over both tiers; misses of the batch are encoded together."""
    totals, open_texts, heads, misses = [0] * len(texts), [], [], {}
    for i, text in enumerate(texts):
        if not text:
            continue
        if PAIR.search(text):
            heads.append((i, text))
            continue
        head, *rest = text.split(" ")
        heads.append((i, head))
        try:
            totals[i] = sum(map(frequent.__getitem__, rest))
        except KeyError:
            left = [p for p in rest if p not in frequent]
            totals[i] = sum([frequent[p] for p in rest if p in frequent])
            open_texts.append((i, left))
            misses.update((p, None) for p in left if p not in cache)
    own = {p: n for p, n in zip(misses, lengths(tok, [" " + p for p in misses]), strict=True)}
    for i, left in open_texts:
        totals[i] += sum([own[p] if p in own else cache[p] for p in left])
    for (i, _), n in zip(heads, lengths(tok, [h for _, h in heads]), strict=True):
        totals[i] += n
    if len(cache) + len(own) > CACHE:
        cache.clear()
    cache.update((p, n) for p, n in own.items() if len(p) <= LONGEST)
    return totals


def count_tokens(docs: DataFrame, path: str, limit: int = 1024, frequent: int = FREQUENT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row of ``docs``.

    ``docs`` needs ``doc_id`` and ``text``; other columns are not read. A null or
    empty text has 0 bytes and 0 tokens. Repeated rows are counted each. ``path``
    names a byte-level BPE file that every worker can read.
    """
    texts = docs.select("text")
    table = docs.sparkSession.sparkContext.broadcast(frequent_lengths(texts, path, frequent))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, cache = tokenizer(path), _caches.setdefault(path, {})
        for batch in small(batches):
            n = count_batch(batch.column(1).to_pylist(), tok, table.value, cache)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(n, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    sized = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce(F.octet_length("text").cast("long"), F.lit(0).cast("long")).alias("n_bytes"))
    out = sized.mapInArrow(counted, "doc_id long, n_bytes long, n_tokens long")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
