"""Phrase collocations, tokenizer alignment and toxicity against plain versions."""

import hashlib
import random
import re
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from kestrel.llm import alignment, collocations, toxicity

# collocations


def plain_collocations(docs, p):
    counts, totals = {}, Counter()
    for lang, text in docs:
        lang, text = lang if lang is not None else "und", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", text):
            w = re.findall("[^ \t]+", piece)
            totals[lang] += len(w)
            for k in range(1, p.longest + 1):
                for i in range(len(w) - k + 1):
                    counts[lang, tuple(w[i:i + k])] = counts.get((lang, tuple(w[i:i + k])), 0) + 1
    kept = {k: a for k, a in counts.items() if len(k[1]) > 1 and a >= p.threshold}
    out = {}
    for (lang, w), a in kept.items():
        covered = any(m == lang and len(v) > len(w) and 100 * b >= p.absorbed * a and any(v[i:i + len(w)] == w for i in range(len(v))) for (m, v), b in kept.items())
        if not covered:
            score, _, left, right = min((p.scale * a * totals[lang] // (counts[lang, w[:k]] * counts[lang, w[k:]]), k, counts[lang, w[:k]], counts[lang, w[k:]]) for k in range(1, len(w)))
            out.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), left, right))
    rows = []
    for lang, found in out.items():
        for rank, (score, a, phrase, left, right) in enumerate(sorted(found)[:p.top], 1):
            rows.append((lang, rank, phrase.decode(), -a, left, right, totals[lang], -score))
    return sorted(rows)


def made_texts(n, seed=3):
    draw = random.Random(seed)
    words = ["Alpha", "beta", "ünï", "gam\x00ma", "x", "the", "of"]
    return [(draw.choice(["en", "de", None]), draw.choice(["", " ", "\t"]) + "".join(draw.choice(words) + draw.choice([" ", " ", " ", "  ", "\t", ", ", ".\n", "!", "\r", "\x0b"]) for _ in range(draw.randint(0, 60)))) for _ in range(n)]


@pytest.mark.parametrize("p", [
    collocations.Collocations(threshold=4), collocations.Collocations(threshold=3, absorbed=60, top=7, longest=4),
    collocations.Collocations(threshold=4, part_mass=64, bitmap_bits=1 << 10, spare=1)])
def test_collocations_equal_the_plain_count(spark, p):
    docs = made_texts(60) + [("en", None), ("en", ""), (None, "one"), ("und", "alpha beta " * 40)] + [("de", "same words in a copy here")] * 9
    frame = spark.createDataFrame(docs, "lang string, text string").repartition(3).withColumn("phrase", F.lit(1)).withColumn("f", F.lit("clash"))
    got = sorted(tuple(r) for r in collocations.collocations(frame, p).collect())
    assert got == plain_collocations(docs, p) and len(got) > 10


def test_collocations_of_nothing(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert collocations.collocations(empty).count() == 0
    assert collocations.collocations(spark.createDataFrame([("a b c",)], "text string")).count() == 0


def test_summary_keeps_every_frequent_key_however_it_is_merged():
    draw = np.random.default_rng(5)
    for capacity in (1, 20, 400):
        keys = np.concatenate([draw.integers(0, 1 << 32, 30_000), np.repeat(draw.integers(0, 1 << 32, 40), 50), np.full(9_000, 77)])
        draw.shuffle(keys)
        true = Counter(keys.tolist())
        summary = collocations.Summary(capacity, 50)
        summary.CHUNK = 3_000
        for part in np.array_split(keys, 37):
            summary.add(*np.unique(part, return_counts=True))
        kept = set(summary.frequent().tolist())
        assert {k for k, n in true.items() if n >= 50} <= kept and summary.error < 50 and len(kept) <= max(summary.capacity, 41)
        assert all(n <= true[k] <= n + summary.error for k, n in zip(summary.keys.tolist(), summary.counts.tolist(), strict=True))


def test_scores_beyond_64_bits(spark):
    rows = [("x", None, 4 * 10**15), ("x", "a b", 3 * 10**13), ("x", "a", 7 * 10**13 + 1), ("x", "b", 3 * 10**13 + 7), ("x", "b c", 200), ("x", "c", 200)]
    got = {r.phrase: r.score for r in collocations.scored(spark.createDataFrame(rows, "lang string, phrase string, f long")).collect()}
    assert got == {"a b": 1000 * 3 * 10**13 * 4 * 10**15 // ((7 * 10**13 + 1) * (3 * 10**13 + 7)), "b c": 1000 * 200 * 4 * 10**15 // ((3 * 10**13 + 7) * 200)}


def test_ranking_of_one_large_language(spark):
    rows = spark.range(30_000).select(F.lit("l").alias("lang"), F.concat(F.lit("p"), "id").alias("phrase"), (F.col("id") % 97).alias("score"))
    got = collocations.first_of_each(rows, "lang", [F.desc("score"), F.asc("phrase")], 500).orderBy("rank").collect()
    want = sorted(((-(i % 97), f"p{i}") for i in range(30_000)))[:500]
    assert [(-r.score, r.phrase) for r in got] == want and [r["rank"] for r in got] == list(range(1, 501))


# alignment

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def coders():
    tok, letters = Tokenizer.from_file(A), alignment.byte_letters()
    tok.encode_special_tokens = True
    model = sentencepiece.SentencePieceProcessor(model_file=B)

    def tokens(text):
        a, b = tok.encode(" " + text, add_special_tokens=False).ids, model.encode(text)
        as_a = [bytes(letters[c] for c in tok.id_to_token(i)) for i in a]
        as_b = [bytes([int(model.id_to_piece(i)[3:5], 16)]) if model.is_byte(i) else model.id_to_piece(i).replace("▁", " ").encode() for i in b]
        return a, b, as_a, as_b
    return tokens


def plain_alignment(text, tokens):
    """n_a, n_b, n_groups, digest, and all links."""
    nothing = (0, 0, 0, "", [])
    if not text:
        return nothing
    a, b, as_a, as_b = tokens(text)
    whole = (" " + text).encode()
    if b"".join(as_a) != whole or b"".join(as_b) != whole:
        return nothing
    spans = []
    for parts in (as_a, as_b):
        ends = np.cumsum([len(x) for x in parts]).tolist()
        spans.append(list(zip([0, *ends[:-1]], ends, strict=True)))
    links = [(a[i], b[j]) for i, (s, e) in enumerate(spans[0]) for j, (u, v) in enumerate(spans[1]) if s < v and u < e]
    cuts, groups = sorted({e for _, e in spans[0]} & {e for _, e in spans[1]}), []
    for s, e in zip([0, *cuts[:-1]], cuts, strict=True):
        groups.append("|".join(",".join(str(i) for i, (u, v) in zip(ids, own, strict=True) if s <= u and v <= e) for ids, own in ((a, spans[0]), (b, spans[1]))))
    return len(a), len(b), len(cuts), hashlib.sha256(";".join(groups).encode()).hexdigest(), links


ODD_TEXTS = [
    None, "", " ", "a", " a", "a ", "a  b", "a\n b", "a \n b", "\n", "<|endoftext|> x <s> </s>", "é ü", "日本語 テキスト", "▁ a", "a▁b", "x　y", "x  y", "a\t b", "ok 👩‍👩‍👧 ok",
    "a" * 700, "\x00 b", "﻿x y", "á ́b", "ﬁ ﬂ", "don't 123 45", "\x1c a", "a \x85 b", "word " * 90, "a   b    c", "a᠎ b"]


@pytest.mark.parametrize("common", [1 << 18, 3, 0])
def test_alignment_equals_the_plain_one(spark, coders, common):
    draw = random.Random(1)
    texts = [*ODD_TEXTS, *["".join(draw.choice(["the ", "cat", "ting ", "über", " ", "\n", "12", "."]) for _ in range(draw.randint(1, 40))) for _ in range(40)], "the cat", "the cat"]
    docs = [(i if i % 7 else None, t) for i, t in enumerate(texts)]
    got = alignment.align(spark.createDataFrame(docs, "doc_id long, text string").withColumn("n_a", F.lit("x")).withColumn("pairs", F.lit(1)).repartition(3), A, B, alignment.Alignment(common=common, together=100)).collect()
    plain = [plain_alignment(t, coders) for t in texts]
    counts, most = Counter(pair for p in plain for pair in set(p[4])), {}
    for (a, _), n in counts.items():
        most[a] = max(n, most.get(a, 0))
    want = [(d[0], *p[:3], len(p[4]), p[3], sum(counts[x] == most[x[0]] for x in p[4]), sum(counts[x] for x in p[4])) for d, p in zip(docs, plain, strict=True)]
    order = lambda rows: sorted(rows, key=repr)
    assert order((r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.groups_sha256, r.n_best, r.count_sum) for r in got) == order(want)


def test_alignment_of_documents(spark, coders):
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect() if len(r.text) < 1500]
    found = alignment.align_batch(pa.array(texts), alignment.Stretches.of(A, B))
    for i, text in enumerate(texts):
        a, b, groups, digest, links = plain_alignment(text, coders)
        assert (found["n_a"][i], found["n_b"][i], found["n_groups"][i], found["groups_sha256"][i], found["n_links"][i]) == (a, b, groups, digest, len(links))
        assert sum(collocations.from_planes(found["times"][i]).tolist()) == len(links)


def test_lockstep_drops_documents_that_are_done():
    ends_a, ends_b = np.array([2, 3, 5, 6, 9]), np.array([1, 3, 4, 6, 7, 9])
    doc, a, b, cut_a, cut_b = alignment.lockstep(ends_a, ends_b, np.array([0, 2, 2, 4, 5]), np.array([0, 2, 2, 4, 6]))
    assert list(zip(doc.tolist(), a.tolist(), b.tolist(), strict=True)) == [(0, 0, 0), (0, 0, 1), (0, 1, 1), (2, 2, 2), (2, 2, 3), (2, 3, 3), (3, 4, 4), (3, 4, 5)]
    assert (cut_a.tolist(), cut_b.tolist()) == ([1, 3, 4], [1, 3, 5])


def test_alignment_of_nothing(spark):
    assert alignment.align(spark.createDataFrame([], "doc_id long, text string"), A, B).count() == 0


# toxicity


def test_features_are_words_pairs_and_skips():
    texts = ["You,  ARE bad!\nbad", None, "", "…", "you are bad bad"]
    got = toxicity.features_of(pa.array(texts))
    # three distinct words; adjacent pairs, pairs over one and over two words
    assert [len(x) for x in got] == [3 + 3 + 2 + 1, 0, 0, 0, 9] and got[0].tolist() == got[4].tolist()


def test_learner_follows_the_plain_rule():
    p, draw = toxicity.Ftrl(alpha=0.7, beta=1.0, l1=0.4, l2=0.2), random.Random(2)
    learner, z, n = toxicity.Learner(6, p), [0.0] * 7, [0.0] * 7

    def weight(i):
        l1 = 0.0 if i == 6 else p.l1
        return 0.0 if abs(z[i]) <= l1 else -(z[i] - (l1 if z[i] > 0 else -l1)) / ((p.beta + n[i] ** 0.5) / p.alpha + p.l2)

    for _ in range(200):
        at, y = sorted(draw.sample(range(6), draw.randint(0, 4))), float(draw.random() < 0.4)
        w = {i: weight(i) for i in [*at, 6]}
        g = 1 / (1 + np.exp(-sum(w.values()))) - y
        for i in w:
            s = ((n[i] + g * g) ** 0.5 - n[i] ** 0.5) / p.alpha
            z[i], n[i] = z[i] + g - s * w[i], n[i] + g * g
        learner.learn(np.array(at, int), y)
    assert np.allclose(learner.z, z) and np.allclose(learner.n, n) and np.allclose(learner.weights(np.arange(7)), [weight(i) for i in range(7)])


def marked(n, seed):
    """Texts of common words, some with one of twelve marks or a pair that is harmless apart."""
    draw, words = random.Random(seed), [f"w{i}" for i in range(400)]
    rows = []
    for i in range(n):
        own, toxic = draw.choices(words, k=draw.randint(5, 300)), int(draw.random() < 0.2)
        if toxic:
            for _ in range(draw.randint(1, 3)):
                own.insert(draw.randint(0, len(own)), f"mark{draw.randint(1, 12)}" if draw.random() < 0.7 else "go home")
        own += draw.choices(["go", "home"], k=1)
        rows.append((i, " ".join(own), toxic))
    return rows


def test_toxicity_held_out_accuracy(spark):
    rows = marked(1500, 4)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(None, None), (-1, "")], "doc_id long, text string").withColumn("score", F.lit("x")).withColumn("a.b", F.lit(1))
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(None, 1), (5, None)], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.toxicity(docs, labels).collect()}
    assert len(got) == len(rows) + 2 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got.values())
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, _, _ in rows) and got[None].held_out is False
    held = [(got[i].predicted, y) for i, _, y in rows if got[i].held_out]
    assert held.count((1, 1)) >= 0.9 * sum(y for _, y in held) and held.count((1, 0)) <= 3
    # labels of held-out rows have no part in it
    turned = labels.withColumn("toxic", F.when(toxicity.is_held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert {r.doc_id: r.score for r in toxicity.toxicity(docs.repartition(5), turned).collect()} == pytest.approx({i: r.score for i, r in got.items()})


def test_toxicity_without_both_labels(spark):
    docs = spark.createDataFrame([(1, "a b"), (1, "c"), (2, None)], "doc_id long, text string")
    for labels in ([], [(1, 1), (1, 1)]):
        got = toxicity.toxicity(docs, spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
        assert [(r.score, r.predicted) for r in got] == [(0.0, 0)] * 3
    assert toxicity.toxicity(docs.limit(0), spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, toxic int")).count() == 0


def test_toxicity_takes_texts_in_small_batches():
    draw = random.Random(6)
    texts = [" ".join(f"w{draw.randint(1, 9999)}" for _ in range(2000)) for _ in range(600)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(600)), pa.array([0.0] * 600), pa.array(texts)], ["doc_id", "toxic", "text"])
    tracemalloc.start()
    n = sum(out.num_rows for out in toxicity.made(iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == 600 and peak < 64 << 20, peak


def test_toxicity_coordinates():
    slots = np.array([3, 5, 9], np.uint32)
    for own in ([], [1], [3], [3, 4, 5, 10], [9, 11], [10, 12]):
        assert toxicity.own_slots(np.array(own, np.uint32), slots).tolist() == [i for i, x in enumerate([3, 5, 9]) if x in own]
