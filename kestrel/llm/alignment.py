"""Alignment of two tokenizers' tokens over the same bytes, merged in lockstep.

Each batch encodes its texts with both tokenizers and lays the tokens' byte ends
in two flat arrays. One state vector holds, for every document that is not done,
a pointer into either array. A step links the tokens that all pointers stand at,
moves each document's pointer whose token ends first (both where they end
together, which is a cut), and drops the documents that are done. So a batch takes
as many steps as its longest document has links, whatever the number of documents.

How many documents hold a pair of ids linked is counted over the corpus from each
document's distinct pairs. The most frequent pairs, of a bounded number, go back
to the documents by broadcast; what a document has of all others is joined.

Texts are encoded by stretches between single spaces, which neither tokenizer
merges across; each Python worker remembers the stretches it has seen, up to a bound.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kestrel.llm.collocations import counted, from_planes, planes
from kestrel.llm.tables import afterwards, read, small
from kestrel.session import written


@dataclass(frozen=True)
class Alignment:
    """Parameters: pairs that are broadcast at most, pairs that a task counts together, about, and bytes of
    text in a batch, which bound a worker's memory."""

    common: int = 1 << 18
    together: int = 1 << 21
    batch_bytes: int = 3 << 20


#: Stretches in a worker's cache at most, and their characters.
CACHE, CHARACTERS = 300_000, 1 << 23

#: Stretches that are encoded as one text.
JOINED = 4096

#: White space of either tokenizer, as a class (fixed, must cover theirs).
WHITE = "\t-\r\x1c- \x85\xa0 ᠎ -     　"

#: A space that parts two stretches, and texts in which some space doesn't.
BETWEEN = re.compile(f"(?<=[^{WHITE}]) (?=[^{WHITE}])")
ODD = f"(^|[{WHITE}]) | ([{WHITE}]|$)"

#: What a stretch must lack to be encoded in a row with others.
AWKWARD = re.compile(f"[\x00-\x20\x7f{WHITE}▁]")


class Ragged:
    """Rows of numbers in one flat array."""

    def __init__(self, kind: type = np.int32) -> None:
        self.flat, self.begins, self.sizes, self.used, self.rows = np.zeros(1 << 12, kind), np.zeros(1 << 10, np.int64), np.zeros(1 << 10, np.int64), 0, 0

    def append(self, values: np.ndarray, sizes: np.ndarray) -> None:
        if self.used + len(values) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros(max(len(self.flat), len(values)), self.flat.dtype)])
        if self.rows + len(sizes) > len(self.begins):
            self.begins, self.sizes = (np.concatenate([x, np.zeros(max(len(x), len(sizes)), np.int64)]) for x in (self.begins, self.sizes))
        self.flat[self.used:self.used + len(values)] = values
        self.sizes[self.rows:self.rows + len(sizes)] = sizes
        self.begins[self.rows:self.rows + len(sizes)] = self.used + np.cumsum(sizes) - sizes
        self.used, self.rows = self.used + len(values), self.rows + len(sizes)

    def gather(self, at: np.ndarray) -> np.ndarray:
        """The rows numbered ``at``, in a row."""
        sizes = self.sizes[at]
        ends = np.cumsum(sizes)
        if not len(ends) or not ends[-1]:
            return self.flat[:0]
        return self.flat[np.repeat(self.begins[at] - ends + sizes, sizes) + np.arange(ends[-1])]


def _table(tokens: list[bytes]) -> Ragged:
    out = Ragged(np.uint8)
    out.append(np.frombuffer(b"".join(tokens), np.uint8), np.array([len(t) for t in tokens], np.int64))
    return out


def byte_letters() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


class ByteBpe:
    """A byte-level BPE of the tokenizers library; special strings in texts are plain text."""

    def __init__(self, path: str):
        import os
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tok = Tokenizer.from_file(path)
        self.tok.no_padding()
        self.tok.no_truncation()
        self.tok.encode_special_tokens = True
        letters, names = byte_letters(), [""] * self.tok.get_vocab_size()
        for token, i in self.tok.get_vocab().items():
            names[i] = token
        self.bytes = _table([bytes(letters[c] for c in t) if all(c in letters for c in t) else t.encode() for t in names])

    def encode(self, stretches: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tok.encode_batch_fast([" " + s for s in stretches], add_special_tokens=False)]

    def encode_row(self, stretches: list[str]) -> list[int]:
        return self.tok.encode_batch_fast([" " + " ".join(stretches)], add_special_tokens=False)[0].ids


class Pieces:
    """A SentencePiece model, which puts a space before a text itself."""

    def __init__(self, path: str):
        import sentencepiece
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)

        def spelt(i: int) -> bytes:
            name = self.model.id_to_piece(i)
            return bytes([int(name[3:5], 16)]) if self.model.is_byte(i) else name.replace("▁", " ").encode()

        self.bytes = _table([spelt(i) for i in range(self.model.vocab_size())])

    def encode(self, stretches: list[str]) -> list[list[int]]:
        return self.model.encode(stretches, num_threads=1)

    def encode_row(self, stretches: list[str]) -> list[int]:
        return self.model.encode(" ".join(stretches))


class Stretches:
    """Both tokenizers' ids of stretches, numbered; one of a worker process and pair of files."""

    made: dict[tuple[str, str], Stretches] = {}

    @classmethod
    def of(cls, path_a: str, path_b: str) -> Stretches:
        if (path_a, path_b) not in cls.made:
            cls.made[path_a, path_b] = cls(ByteBpe(path_a), Pieces(path_b))
        return cls.made[path_a, path_b]

    def __init__(self, a: ByteBpe, b: Pieces):
        self.coders = (a, b)
        if a.bytes.rows * b.bytes.rows >= 1 << 32:
            raise ValueError("the product of both vocabularies' sizes must stay below 2**32")
        self.clear()

    def clear(self) -> None:
        self.index: dict[str, int] = {}
        self.ids = (Ragged(), Ragged())
        self.good, self.characters = np.zeros(0, bool), 0

    def _one_by_one(self, coder, stretches: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        found = coder.encode(stretches)
        good = [b"".join(coder.bytes.flat[coder.bytes.begins[i]:coder.bytes.begins[i] + coder.bytes.sizes[i]].tobytes() for i in ids) == (" " + s).encode() for ids, s in zip(found, stretches, strict=True)]
        return np.array([i for ids in found for i in ids], np.int32), np.array([len(x) for x in found], np.int64), np.array(good, bool)

    def _in_a_row(self, coder, stretches: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, sizes, and whether the tokens spell the stretch: all in one text, where that comes out right."""
        ids = np.array(coder.encode_row(stretches), np.int32)
        begins = np.flatnonzero(coder.bytes.flat[coder.bytes.begins[ids]] == 0x20)
        spelt = coder.bytes.gather(ids)
        if len(begins) != len(stretches) or spelt.tobytes() != (" " + " ".join(stretches)).encode():
            return self._one_by_one(coder, stretches)
        return ids, np.diff(begins, append=len(ids)), np.ones(len(stretches), bool)

    def learn(self, new: list[str]) -> None:
        for rows, encode in (([s for s in new if s and not AWKWARD.search(s)], self._in_a_row), ([s for s in new if not s or AWKWARD.search(s)], self._one_by_one)):
            for k in range(0, len(rows), JOINED):
                part = rows[k:k + JOINED]
                good = np.ones(len(part), bool)
                for coder, table in zip(self.coders, self.ids, strict=True):
                    ids, sizes, right = encode(coder, part)
                    table.append(ids, sizes)
                    good &= right
                self.index.update(zip(part, range(len(self.index), len(self.index) + len(part)), strict=True))
                self.good = np.concatenate([self.good, good])
                self.characters += sum(map(len, part))

    def numbered(self, texts: pa.Array) -> list[np.ndarray]:
        """The stretches of each text, by number; none where the text is null or empty, or isn't spelt by both tokenizers."""
        if len(self.index) > CACHE or self.characters > CHARACTERS:
            self.clear()
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        odd = pc.match_substring_regex(texts, ODD).to_numpy(zero_copy_only=False)
        split = pc.split_pattern(pc.if_else(pa.array(odd), "", texts), " ")
        coded = pc.dictionary_encode(split.flatten())
        names = coded.dictionary.to_pylist()
        whole = {i: BETWEEN.split(texts[i].as_py()) for i in np.flatnonzero(odd).tolist()}
        new = dict.fromkeys(s for s in names if s not in self.index)
        new.update((s, None) for parts in whole.values() for s in parts if s not in self.index)
        self.learn(list(new))
        at = np.fromiter(map(self.index.__getitem__, names), np.int64, len(names))[coded.indices.to_numpy()]
        ends, empty, out = split.offsets.to_numpy(), pc.equal(texts, "").to_numpy(zero_copy_only=False), []
        for i in range(len(texts)):
            own = np.array([self.index[s] for s in whole[i]], np.int64) if odd[i] else at[ends[i]:ends[i + 1]]
            out.append(own[:0] if empty[i] or not self.good[own].all() else own)
        return out


def lockstep(ends_a: np.ndarray, ends_b: np.ndarray, bounds_a: np.ndarray, bounds_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Links and cuts of many documents, whose tokens end at ``ends_a`` and ``ends_b`` (rising in each document).

    A document's tokens lie between its bounds and the next, and its last tokens
    end together. Results: for each link the document and the tokens' places, in
    the order of the documents and of the bytes; and the places of the last
    tokens of each group.
    """
    doc = np.flatnonzero(np.diff(bounds_a)).astype(np.int32)
    a, b, stop = bounds_a[doc].astype(np.int32), bounds_b[doc].astype(np.int32), bounds_a[doc + 1].astype(np.int32)
    steps: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    cuts: list[tuple[np.ndarray, np.ndarray]] = []
    while len(a):
        x, y = ends_a[a], ends_b[b]
        steps.append((doc, a, b))
        met = x == y
        if met.any():
            cuts.append((a[met], b[met]))
        a, b = a + (x <= y), b + (y <= x)
        live = a < stop
        if not live.all():
            doc, a, b, stop = doc[live], a[live], b[live], stop[live]
    docs, at_a, at_b = (np.concatenate([s[i] for s in steps] or [np.zeros(0, np.int32)]) for i in range(3))
    # a document's n-th link comes from step n
    n_links = np.bincount(docs, minlength=len(bounds_a) - 1)
    place = (np.cumsum(n_links) - n_links)[docs] + np.repeat(np.arange(len(steps)), [len(s[0]) for s in steps])
    links = []
    for values in (docs, at_a, at_b):
        ordered = np.empty_like(values)
        ordered[place] = values
        links.append(ordered)
    cut_a, cut_b = (np.sort(np.concatenate([c[i] for c in cuts] or [np.zeros(0, np.int32)])) for i in range(2))
    return links[0], links[1], links[2], cut_a, cut_b


def _decimals(most: int) -> tuple[np.ndarray, np.ndarray]:
    """The decimal digits of numbers up to ``most``, packed into 64 bits, first digit lowest, and how many."""
    texts = [str(i).encode() for i in range(most)]
    return np.array([int.from_bytes(t, "little") for t in texts], np.uint64), np.array([len(t) for t in texts], np.uint64)


DIGITS, LENGTHS = _decimals(1 << 17)


def group_digests(ids_a: np.ndarray, ids_b: np.ndarray, cut_a: np.ndarray, cut_b: np.ndarray, groups: np.ndarray) -> list[str]:
    """The SHA-256 of each document's groups as text, ``groups`` of them a document; '' where it has none."""
    sizes_a, sizes_b = np.diff(cut_a, prepend=-1), np.diff(cut_b, prepend=-1)
    at_a = np.arange(len(ids_a)) + np.repeat(cut_b - sizes_b + 1, sizes_a)
    at_b = np.arange(len(ids_b)) + np.repeat(cut_a + 1, sizes_b)
    ids, after = np.empty(len(ids_a) + len(ids_b), np.int64), np.full(len(ids_a) + len(ids_b), ord(","), np.uint64)
    ids[at_a], ids[at_b] = ids_a, ids_b
    after[at_a[cut_a]], after[at_b[cut_b]] = ord("|"), ord(";")
    last = np.cumsum(groups)[groups > 0] - 1
    after[at_b[cut_b[last]]] = 0
    long = LENGTHS[ids]
    text = (DIGITS[ids] | after << (long * np.uint64(8))).view(np.uint8)
    flat = text[text != 0]
    ends = np.cumsum(long.astype(np.int64) + (after > 0))[at_b[cut_b[last]]]
    found = iter([hashlib.sha256(flat[s:e]).hexdigest() for s, e in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)] if len(ends) else [])
    return [next(found) if n else "" for n in groups]


ROWS = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs binary, times binary"


def align_batch(texts: pa.Array, known: Stretches) -> dict[str, list | np.ndarray]:
    """The columns of ``ROWS`` but for row and doc_id; ``pairs`` are differences of ascending a * |B| + b."""
    at = known.numbered(texts)
    flat = np.concatenate([np.zeros(0, np.int64), *at])
    text_ends = np.cumsum([0, *map(len, at)])
    ids, ends, bounds = [], [], []
    for coder, table in zip(known.coders, known.ids, strict=True):
        own = table.gather(flat)
        ids.append(own)
        ends.append(np.cumsum(coder.bytes.sizes[own]))
        bounds.append(np.concatenate([[0], np.cumsum(table.sizes[flat])])[text_ends])
    doc, link_a, link_b, cut_a, cut_b = lockstep(*ends, *bounds)
    n = len(at)
    groups = np.bincount(np.searchsorted(bounds[0], cut_a, "right") - 1, minlength=n)
    links = np.bincount(doc, minlength=n)
    code = ids[0][link_a].astype(np.uint64) * np.uint64(known.coders[1].bytes.rows) + ids[1][link_b].astype(np.uint64)
    pairs, times = counted(doc.astype(np.uint64) << np.uint64(32) | code)
    at_doc = np.searchsorted(pairs, np.arange(n + 1, dtype=np.uint64) << np.uint64(32))
    own = (pairs & np.uint64(0xFFFFFFFF)).astype(np.int64)
    return {
        "n_a": np.diff(bounds[0]), "n_b": np.diff(bounds[1]), "n_groups": groups, "n_links": links, "groups_sha256": group_digests(*ids, cut_a, cut_b, groups),
        "pairs": [planes(np.diff(own[s:e], prepend=0)) for s, e in zip(at_doc, at_doc[1:], strict=False)],
        "times": [planes(times[s:e]) for s, e in zip(at_doc, at_doc[1:], strict=False)]}


def aligned(docs: DataFrame, path_a: str, path_b: str, p: Alignment = Alignment()) -> DataFrame:
    """``ROWS`` for every row of ``docs``, written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Stretches.of(path_a, path_b)

        def rows() -> Iterator[pa.RecordBatch]:
            for batch in small(batches, p.batch_bytes):
                found = align_batch(batch.column(2), known)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *[pa.array(v, t) for v, t in zip(found.values(), (*[pa.int64()] * 4, pa.string(), pa.binary(), pa.binary()), strict=True)]], [c.split()[0] for c in ROWS.split(", ")])

        return afterwards(rows(), known.clear)

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    return written(rows.mapInArrow(run, ROWS), "aligned")


def pair_counts(rows: DataFrame, size_b: int, p: Alignment = Alignment()) -> DataFrame:
    """pair, n, best: documents that hold a pair linked, and whether that is the most for its first id; written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def total() -> pa.RecordBatch:
            pairs, n = counted(np.concatenate([np.zeros(0, np.int64), *held]))
            return pa.RecordBatch.from_arrays([pa.array(pairs), pa.array(n)], ["pair", "n"])

        for batch in batches:
            for raw in batch.column(0):
                held.append(np.cumsum(from_planes(raw.as_buffer()), dtype=np.int64))
                size += len(held[-1])
                if size > p.together:
                    yield total()
                    held, size = [], 0
        yield total()

    counts = rows.select("pairs").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    counts = written(counts, "pairs")
    first = F.expr(f"pair div {size_b}")
    most = counts.groupBy(first.alias("a")).agg(F.max("n").alias("most"))
    return written(counts.join(most, first == F.col("a")).select("pair", "n", (F.col("n") == F.col("most")).alias("best")), "best-pairs")


def with_counts(rows: DataFrame, counts: DataFrame, p: Alignment = Alignment()) -> DataFrame:
    """``rows`` with n_best and count_sum: frequent pairs looked up in a broadcast table, the others joined."""
    table = counts.orderBy(F.desc("n"), "pair").limit(p.common).toArrow().sort_by("pair")
    shared = rows.sparkSession.sparkContext.broadcast(tuple(table.column(c).to_numpy() for c in ("pair", "n", "best")))
    kept = [c for c in rows.columns if c not in ("pairs", "times")]
    schema = "row long, best long, total long, others array<long>, often array<long>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, n, best = shared.value
        for batch in batches:
            best_of, total_of, others, often = [], [], [], []
            for raw, raw_times in zip(batch.column(1), batch.column(2), strict=True):
                own, times = np.cumsum(from_planes(raw.as_buffer()), dtype=np.int64), from_planes(raw_times.as_buffer()).astype(np.int64)
                at = np.minimum(np.searchsorted(pairs, own), max(0, len(pairs) - 1))
                hit = pairs[at] == own if len(pairs) else np.zeros(len(own), bool)
                at, there = at[hit], times[hit]
                best_of.append(int(there[best[at]].sum()))
                total_of.append(int((there * n[at]).sum()))
                others.append(own[~hit])
                often.append(times[~hit])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(best_of, pa.int64()), pa.array(total_of, pa.int64()), pa.array(others, pa.list_(pa.int64())), pa.array(often, pa.list_(pa.int64()))], ["row", "best", "total", "others", "often"])

    found = written(rows.select("row", "pairs", "times").mapInArrow(run, schema), "common")
    rare = found.where(F.size("others") > 0).select("row", F.explode(F.arrays_zip("others", "often")).alias("o")).select("row", F.col("o.others").alias("pair"), F.col("o.often").alias("times"))
    rare = rare.join(counts, "pair").groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("best_2"), F.sum(F.col("times") * F.col("n")).alias("total_2"))
    sums = found.select("row", "best", "total").join(rare, "row", "left")
    sums = sums.select("row", (F.col("best") + F.coalesce("best_2", F.lit(0))).alias("n_best"), (F.col("total") + F.coalesce("total_2", F.lit(0))).alias("count_sum"))
    return rows.select(*kept).join(sums, "row").drop("row")


def align(docs: DataFrame, path_a: str, path_b: str, p: Alignment = Alignment()) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, groups_sha256, n_best, count_sum for every row of ``docs``.

    ``docs`` needs ``doc_id`` and ``text``; other columns are not read. ``path_a``
    names a byte-level BPE file of the tokenizers library, ``path_b`` a
    SentencePiece model; A encodes a space and the text, B the text. A text that
    is null or empty, or that either tokenizer's tokens don't spell, has no
    tokens: zeros, and '' for the digest. Repeated rows, and rows without doc_id,
    are documents of their own. Texts of any length are aligned whole.
    """
    rows = aligned(docs, path_a, path_b, p)
    size_b = Stretches.of(path_a, path_b).coders[1].bytes.rows
    return with_counts(rows, pair_counts(rows, size_b, p), p)


def op12_cross_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return align(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
