"""Collocations: frequent phrases that stick together, mined exactly.

Pass one finds every phrase that may be frequent. Each task counts the hashes of
its batches' phrases and deals them to hash partitions; a partition merges what
it gets into one Misra-Gries summary. A summary of weighted keys with error e
holds every key whose weight is over e, and its counters are at most e too low.
Its capacity exceeds the partition's mass divided by the threshold, and it grows
before the error would reach the threshold, so every frequent phrase survives.
Two phrases with one hash only add up, which keeps more, never less.

Pass two counts the survivors exactly: a broadcast bitmap of their hashes, of a
bounded size, lets a task skip nearly all other phrases; those left are grouped
by their words, not by hashes, and summed over the corpus. If the survivors would
crowd the bitmap, they are counted in several rounds, each with its own.

Scores are products of counts, compared as decimals of 38 digits.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kestrel.llm.tables import read, small
from kestrel.llm.terms import mix
from kestrel.session import written


@dataclass(frozen=True)
class Collocations:
    """Parameters: least count of a phrase, most words, the score's scale, the share (per cent) of a phrase's
    count at which a longer one absorbs it, phrases of a language that are reported; then bounds: mass aimed
    at in a hash partition, bytes of text at once, capacity as a multiple of mass by threshold, bits of a bitmap, and bits for each
    survivor."""

    threshold: int = 100
    longest: int = 5
    scale: int = 1000
    absorbed: int = 100
    top: int = 2000
    part_mass: int = 1 << 24
    batch_bytes: int = 3 << 20
    spare: int = 4
    bitmap_bits: int = 1 << 28
    sparse: int = 64


#: What a byte is: 0 of a word, 1 blank between words, 2 end of a piece.
KIND = np.zeros(256, np.uint8)
KIND[[0x20, 0x09]] = 1
KIND[[ord(c) for c in ".,;:!?\n\v\f\r"]] = 2

LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32

#: Bits of a phrase's hash inside its partition.
KEY = 32


class Words:
    """The words of a batch: numbers into ``known``, the piece of each, and the language of each."""

    def __init__(self, texts: pa.Array, langs: pa.Array):
        coded = langs.dictionary_encode()
        self.langs, order = coded.dictionary.to_pylist(), np.argsort(coded.indices.to_numpy(), kind="stable")
        raw = texts.take(pa.array(order)).cast(pa.large_binary()).to_pylist()
        data = np.frombuffer(b"\n".join(raw), np.uint8)
        kind = KIND[data]
        inside = kind == 0
        edges = np.diff(inside.view(np.int8), prepend=np.int8(0), append=np.int8(0))
        starts = np.flatnonzero(edges == 1)
        self.piece = np.cumsum(kind == 2, dtype=np.int32)[starts] if len(starts) else np.zeros(0, np.int32)
        # texts of a language lie in a row
        sizes = np.array([len(x) + 1 for x in raw], np.int64)
        text_lang = coded.indices.to_numpy()[order]
        ends = np.cumsum(sizes)[np.flatnonzero(np.diff(text_lang, append=-1))]
        self.lang_ends = np.searchsorted(starts, ends)
        offsets = np.concatenate([[0], np.cumsum(np.flatnonzero(edges == -1) - starts)]).astype(np.int64)
        packed = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(LOWER[data[inside]])])
        numbered = packed.dictionary_encode()
        self.ids, self.known = numbered.indices.to_numpy().astype(np.int64), numbered.dictionary.to_pylist()

    def lang_numbers(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.langs)), np.diff(self.lang_ends, prepend=0))

    def hashes(self, longest: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For 1, 2, ... words: the places where a phrase of so many begins, and the phrases' hashes."""
        word = np.array([xxhash.xxh3_64_intdigest(w) for w in self.known], np.uint64)[self.ids] if self.known else np.zeros(0, np.uint64)
        seeds = np.array([xxhash.xxh3_64_intdigest(x.encode(), 1) for x in self.langs], np.uint64)
        out = mix(word ^ np.repeat(seeds, np.diff(self.lang_ends, prepend=0)))
        at = np.arange(len(word), dtype=np.int32)
        yield at, out
        for size in range(2, longest + 1):
            fits = at + size - 1 < len(word)
            at, out = at[fits], out[fits]
            same = self.piece[at] == self.piece[at + size - 1]
            at = at[same]
            out = mix(out[same] ^ word[at + size - 1])
            yield at, out


def planes(x: np.ndarray) -> bytes:
    """32-bit numbers by byte planes, which compress."""
    return np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def from_planes(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(4, -1).T).view("<u4").ravel()


def counted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values in order, and how often each occurs; ``keys`` is sorted in place."""
    keys.sort()
    at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[at], np.diff(at, append=len(keys))


class Summary:
    """A Misra-Gries summary of weighted 32-bit keys.

    ``error`` is what has been taken off every counter: a key's weight is at most
    its counter (0 if it has none) plus the error. Summaries merge by adding up
    counters and errors. Counters saturate far over any threshold.
    """

    CHUNK, MOST = 1 << 21, (1 << 31) - 1

    def __init__(self, capacity: int, threshold: int):
        self.capacity, self.threshold, self.error = max(1, capacity), threshold, 0
        self.keys, self.counts = np.zeros(0, np.uint32), np.zeros(0, np.int64)
        self.waiting: list[np.ndarray] = []
        self.held = 0

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        """Weights of distinct or repeated keys, as another summary without error."""
        self.waiting.append(keys.astype(np.uint64) << np.uint64(32) | np.minimum(counts, self.MOST).astype(np.uint64))
        self.held += len(keys)
        if self.held >= max(self.CHUNK, self.capacity):
            self.merge()

    def merge(self) -> None:
        if not self.held:
            return
        both = np.concatenate([self.keys.astype(np.uint64) << np.uint64(32) | np.minimum(self.counts, self.MOST).astype(np.uint64), *self.waiting])
        self.waiting, self.held = [], 0
        both.sort()
        keys = (both >> np.uint64(32)).astype(np.uint32)
        at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        counts = np.add.reduceat((both & np.uint64(0xFFFFFFFF)).astype(np.int64), at)
        self.keys, self.counts = keys[at], counts
        while len(self.keys) > self.capacity:
            place = len(self.counts) - self.capacity - 1
            off = int(np.partition(self.counts, place)[place])
            if self.error + off >= self.threshold:
                self.capacity *= 2  # more mass came than was expected; a frequent key must not go
                continue
            left = self.counts > off
            self.keys, self.counts = self.keys[left], self.counts[left] - off
            self.error += off

    def frequent(self) -> np.ndarray:
        """The keys that may weigh as much as the threshold, in order."""
        self.merge()
        return self.keys[self.counts + self.error >= self.threshold]


def _dealt(parts: int, p: Collocations):
    """Batches of (lang, text) to the phrases' hashes and counts, a row for each hash partition."""
    drop = np.uint64(64 - KEY - int(math.log2(parts)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches, p.batch_bytes):
            words = Words(batch.column(1), batch.column(0))
            keys, counts = counted(np.concatenate([h >> drop for _, h in words.hashes(p.longest)]))
            ends = np.searchsorted(keys, np.arange(1, parts + 1, dtype=np.uint64) << np.uint64(KEY))
            own = (keys & np.uint64((1 << KEY) - 1)).astype(np.int64)
            out: list[tuple[int, bytes, bytes]] = []
            for i, (a, b) in enumerate(zip([0, *ends[:-1]], ends, strict=True)):
                if b > a:
                    out.append((i, planes(np.diff(own[a:b], prepend=0)), planes(np.minimum(counts[a:b], Summary.MOST))))
            yield pa.RecordBatch.from_arrays([pa.array([x[j] for x in out], t) for j, t in enumerate((pa.int32(), pa.binary(), pa.binary()))], ["part", "keys", "counts"])
    return run


def _merged(capacity: int, p: Collocations):
    """Rows of a few hash partitions to the keys that each one's summary keeps."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        summaries: dict[int, Summary] = {}
        for batch in batches:
            for part, keys, counts in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                summary = summaries.setdefault(part, Summary(capacity, p.threshold))
                summary.add(np.cumsum(from_planes(keys.as_buffer()), dtype=np.int64), from_planes(counts.as_buffer()).astype(np.int64))
        for part, summary in summaries.items():
            kept = summary.frequent()
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([len(kept)], pa.int64()), pa.array([kept.astype("<u4").tobytes()], pa.binary())], ["part", "n", "keys"])
    return run


def _marked(bits: int, parts: int):
    """A partition's kept keys to its stretch of a bitmap of 2**bits for ``parts`` partitions."""
    own = bits - int(math.log2(parts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            maps = []
            for keys in batch.column(1):
                marks = np.zeros(1 << own, np.uint8)
                marks[np.frombuffer(keys.as_buffer(), "<u4") >> np.uint32(KEY - own)] = 1
                maps.append(np.packbits(marks, bitorder="little").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(maps, pa.binary())], ["part", "map"])
    return run


def exact_groups(columns: list[np.ndarray], base: int) -> tuple[np.ndarray, np.ndarray]:
    """Of rows of word numbers below ``base``: the first row of each distinct one, and how many there are."""
    group = columns[0]
    for column in columns[1:]:
        # group numbers stay below the number of rows, so the pairs fit 64 bits
        _, group = np.unique(group * base + column, return_inverse=True)
    _, first, n = np.unique(group, return_index=True, return_counts=True)
    return first, n


def _recounted(shared, parts: int, begin: int, bits: int, totals: bool, p: Collocations):
    """Batches of (lang, text) to exact counts of the phrases whose hashes the bitmap knows."""
    drop = np.uint64(64 - KEY - int(math.log2(parts)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks, stretch = shared.value
        slot_shift = np.uint64(KEY + int(math.log2(stretch)) - bits)
        low, high = np.uint64(begin << KEY), np.uint64(min(begin + stretch, parts)) << np.uint64(KEY)
        for batch in small(batches, p.batch_bytes):
            words = Words(batch.column(1), batch.column(0))
            langs, base = words.lang_numbers(), len(words.known) + 1
            out: list[tuple[str, bytes | None, int]] = []
            if totals:
                out += [(lang, None, int(n)) for lang, n in zip(words.langs, np.diff(words.lang_ends, prepend=0), strict=True)]
            for size, (at, h) in enumerate(words.hashes(p.longest), 1):
                v = h >> drop
                if begin or high < np.uint64(parts) << np.uint64(KEY):
                    near = (v >= low) & (v < high)
                    at, v = at[near], v[near]
                slot = ((v - low) >> slot_shift).astype(np.int64)
                hit = (marks[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 == 1
                at = at[hit]
                if not len(at):
                    continue
                first, n = exact_groups([langs[at], *[words.ids[at + j] for j in range(size)]], base)
                rows = np.stack([words.ids[at[first] + j] for j in range(size)], 1).tolist()
                known = words.known
                out += [(words.langs[g], b" ".join([known[w] for w in row]), c) for g, row, c in zip(langs[at[first]].tolist(), rows, n.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.binary()).cast(pa.string()), pa.array([x[2] for x in out], pa.int64())], ["lang", "phrase", "f"])
    return run


def _two_power(x: float, least: int, most: int) -> int:
    return max(least, min(most, math.ceil(math.log2(max(1.0, x)))))


def frequent_phrases(docs: DataFrame, p: Collocations = Collocations()) -> DataFrame:
    """lang, phrase, f of every phrase of one to ``p.longest`` words that occurs ``p.threshold`` times in its
    language at least, with exact counts; and a row for each language with a null phrase and all its words."""
    lang = F.coalesce(F.col("lang").cast("string"), F.lit("und")) if "lang" in docs.columns else F.lit("und")
    texts = docs.select(lang.alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    size = texts.agg(F.sum(F.octet_length("text").cast("long") + 1)).first()[0] or 0
    mass = p.longest * size // 2  # a word and what parts it are two bytes at least
    parts = 1 << _two_power(mass / p.part_mass, 0, 30)
    dealt = texts.mapInArrow(_dealt(parts, p), "part int, keys binary, counts binary")
    capacity = p.spare * mass // (parts * p.threshold) + 1
    kept = written(dealt.repartition(parts, "part").mapInArrow(_merged(capacity, p), "part int, n long, keys binary"), "frequent")
    total = kept.agg(F.sum("n")).first()[0] or 0
    rounds = 1 << _two_power(total * p.sparse / p.bitmap_bits, 0, int(math.log2(parts)))
    stretch = parts // rounds
    bits = _two_power(total * p.sparse / rounds, int(math.log2(stretch)) + 3, int(math.log2(stretch)) + KEY)
    found = None
    for begin in range(0, parts, stretch):
        maps = kept.where(F.col("part").between(begin, begin + stretch - 1)).select("part", "keys").mapInArrow(_marked(bits, stretch), "part int, map binary").collect()
        own = (1 << bits) // stretch // 8
        marks = np.zeros((1 << bits) // 8, np.uint8)
        for r in maps:  # bounded: all maps of a round have 2**bits bits
            marks[(r.part - begin) * own:(r.part - begin + 1) * own] = np.frombuffer(r.map, np.uint8)
        shared = docs.sparkSession.sparkContext.broadcast((marks, stretch))
        rows = texts.mapInArrow(_recounted(shared, parts, begin, bits, begin == 0, p), "lang string, phrase string, f long")
        found = rows if found is None else found.unionByName(rows)
    counts = found.groupBy("lang", "phrase").agg(F.sum("f").alias("f"))
    return written(counts.where((F.col("f") >= p.threshold) | F.col("phrase").isNull()), "phrases")


def scored(phrases: DataFrame, p: Collocations = Collocations()) -> DataFrame:
    """lang, phrase, a, l, r, n, score of every phrase of two words and more: the counts of the cut that scores least."""
    totals = phrases.where("phrase IS NULL").select("lang", F.col("f").alias("n"))
    known = phrases.where("phrase IS NOT NULL")
    words = known.select("lang", "phrase", F.col("f").alias("a"), F.split("phrase", " ").alias("w")).where(F.size("w") > 1)
    cuts = words.select("lang", "phrase", "a", "w", F.explode(F.sequence(F.lit(1), F.size("w") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", F.array_join(F.slice("w", 1, F.col("k")), " ").alias("head"), F.array_join(F.slice("w", F.col("k") + 1, F.size("w")), " ").alias("tail"))
    cuts = cuts.join(known.select("lang", F.col("phrase").alias("head"), F.col("f").alias("l")), ["lang", "head"])
    cuts = cuts.join(known.select("lang", F.col("phrase").alias("tail"), F.col("f").alias("r")), ["lang", "tail"]).join(totals, "lang")
    wide = {c: F.col(c).cast("decimal(19,0)") for c in ("a", "l", "r", "n")}
    cuts = cuts.withColumns({"above": F.lit(p.scale).cast("decimal(4,0)") * wide["a"] * wide["n"], "below": wide["l"] * wide["r"]})
    cuts = cuts.withColumn("score", F.expr("above div below"))
    least = cuts.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    return least.select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score")


def absorbed(phrases: DataFrame, p: Collocations = Collocations()) -> DataFrame:
    """lang, phrase, longer: the greatest count of a longer phrase that holds the phrase, where there is one."""
    long = phrases.select("lang", "f", F.split("phrase", " ").alias("w")).where(F.size("w") > 2)
    spans = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(k).alias("k")) for k in range(2, p.longest) for i in range(1, p.longest - k + 2)])
    inside = long.select("lang", "f", "w", F.explode(spans).alias("s")).where("s.i + s.k - 1 <= size(w) AND s.k < size(w)")
    return inside.select("lang", F.array_join(F.slice("w", F.col("s.i"), F.col("s.k")), " ").alias("phrase"), "f").groupBy("lang", "phrase").agg(F.max("f").alias("longer"))


def first_of_each(rows: DataFrame, group: str, order: list, most: int) -> DataFrame:
    """The first ``most`` rows of each group, with ``rank`` from 1; a group of any size is ranked in shares first."""
    for shares in (4096, 64):
        own = Window.partitionBy(group, F.pmod(F.xxhash64("phrase"), F.lit(shares))).orderBy(*order)
        rows = rows.withColumn("rank", F.row_number().over(own)).where(F.col("rank") <= most)
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(*order)).cast("long")).where(F.col("rank") <= most)


def collocations(docs: DataFrame, p: Collocations = Collocations()) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the phrases of each language that score highest.

    ``docs`` needs ``text`` and uses ``lang`` where it has it; other columns are
    not read. A-Z are lower-cased, ``.,;:!?`` and line ends part pieces, blanks
    and tabs part words; phrases never leave a piece. A null text is empty, and
    an empty one has no words; a null language is ``und``. Repeated rows count
    each. Of phrases that tie in score and count the one first in byte order
    comes first. No phrase that is frequent enough, no rows.
    """
    phrases = frequent_phrases(docs, p)
    longer = absorbed(phrases.where("phrase IS NOT NULL"), p)
    rows = scored(phrases, p).join(longer, ["lang", "phrase"], "left")
    rows = rows.where(F.col("longer").isNull() | (100 * F.col("longer") < p.absorbed * F.col("a")))
    ranked = first_of_each(rows, "lang", [F.desc("score"), F.desc("a"), F.asc("phrase")], p.top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op11_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(read(spark, sf_dir, "documents"))


OP11_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
    unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents
), lists AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces
), places AS (
  SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM lists
), totals AS (
  SELECT lang, count(*) AS n FROM places GROUP BY lang
), phrases AS (
  SELECT lang, array_to_string(w[i:i + k - 1], ' ') AS phrase, k AS size, count(*) AS f
  FROM places, (SELECT unnest([1, 2, 3, 4, 5]) AS k) WHERE i + k - 1 <= len(w) GROUP BY ALL HAVING count(*) >= 100
), split AS (
  SELECT lang, phrase, f AS a, size, string_split(phrase, ' ') AS w FROM phrases WHERE size > 1
), halves AS (
  SELECT lang, phrase, a, k, array_to_string(w[1:k], ' ') AS head, array_to_string(w[k + 1:], ' ') AS tail
  FROM split, (SELECT unnest([1, 2, 3, 4]) AS k) WHERE k < size
), cuts AS (
  SELECT s.lang, s.phrase, a, k, h.f AS l, t.f AS r, n, (1000::HUGEINT * a * n) // (h.f::HUGEINT * t.f) AS score
  FROM halves s JOIN phrases h ON h.lang = s.lang AND h.phrase = head JOIN phrases t ON t.lang = s.lang AND t.phrase = tail JOIN totals n ON n.lang = s.lang
), best AS (
  SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), inner_phrases AS (
  SELECT lang, array_to_string(w[i:i + k - 1], ' ') AS phrase, max(a) AS longer
  FROM split, (SELECT unnest([1, 2, 3, 4]) AS i), (SELECT unnest([2, 3, 4]) AS k) WHERE i + k - 1 <= size AND k < size GROUP BY ALL
), ranked AS (
  SELECT b.lang, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.phrase) AS rank, b.phrase, a, l, r, n, score
  FROM best b LEFT JOIN inner_phrases i ON i.lang = b.lang AND i.phrase = b.phrase WHERE longer IS NULL OR 100 * longer < 100 * a
)
SELECT lang, rank, phrase, a, l, r, n, CAST(score AS BIGINT) AS score FROM ranked WHERE rank <= 2000
"""
