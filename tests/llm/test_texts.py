"""Packing, token counts, URL filters, secrets, quality, pieces and the pipeline."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from kestrel.llm import packing, quality, secret_scan, sentence_pieces, token_counts, url_filters, word_ids

DOCS = "doc_id bigint, text string, n_tokens string, start string"

TEXTS = [
    None, "", "Hello WORLD's end.", "two  spaces\n\n and \t tabs \n", "special <|endoftext|> inside", " lead and trail ", "漢字かな交じり。テキスト", "Σας İstanbul é́",
    "a\x1cb \x00 c", "x" * 5000, "Sentence one. Sentence two! Three? " * 700, "no stop here " * 2000, "same text", "same text", "\u00a0nbsp\u2003em\u3000wide", "it's we'll I'M"]


def frame(spark, texts=TEXTS):
    return spark.createDataFrame([(i, t, "clash", "clash") for i, t in enumerate(texts)], DOCS)


def test_token_counts(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    got = {r.doc_id: r for r in token_counts.count_tokens(frame(spark), path).collect()}
    tok = Tokenizer.from_file(path)
    for i, t in enumerate(TEXTS):
        n = len(tok.encode(t or "", add_special_tokens=False).ids)
        assert (got[i].n_bytes, got[i].n_tokens, got[i].over_limit) == (len((t or "").encode()), n, n > 1024), i
    assert token_counts.count_tokens(frame(spark, []), path).count() == 0


def test_token_counts_of_odd_spacing():
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    r = random.Random(4)
    texts = ["".join(r.choice([" ", "\n", "a", "Bc", "1", ".", "é", "\u00a0", "'s", "\t"]) for _ in range(r.randrange(12))) for _ in range(3000)]
    assert token_counts.count_batch(texts, tok, {"a": 1}, {}) == token_counts.lengths(tok, texts)


def test_word_ids():
    path = public_tokenizers.path("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    texts = [t or "" for t in TEXTS]
    assert [x.tolist() for x in word_ids.WordIds(path).encode(texts)] == [e.ids for e in tok.encode_batch(texts, add_special_tokens=False)]


def test_packing(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    p = packing.Packing(chunk=6000)
    got = packing.pack(frame(spark).repartition(2), path, p).toPandas()
    tok = Tokenizer.from_file(path)
    ids = {i: np.array(tok.encode(t or "", add_special_tokens=False).ids + [2], np.uint32) for i, t in enumerate(TEXTS)}
    for d, pieces in got.groupby("doc_id"):
        pieces = pieces.sort_values("start")
        assert pieces.start.tolist() == np.concatenate([[0], pieces.length.cumsum()[:-1]]).tolist()
        assert pieces.length.sum() == len(ids[d]) == pieces.doc_tokens.iloc[0] and (pieces.length > 0).all()
        assert [zlib.crc32(ids[d][s:s + n].tobytes()) for s, n in zip(pieces.start, pieces.length, strict=True)] == pieces.ids_crc32.tolist()
    assert set(got.doc_id) == set(ids)
    for _, s in got.sort_values("offset").groupby("sequence_id"):
        assert s.offset.tolist() == np.concatenate([[0], s.length.cumsum()[:-1]]).tolist() and s.length.sum() <= 4096
    assert packing.pack(frame(spark, []), path).count() == 0


def test_best_cuts_are_the_cheapest():
    p = packing.Packing(window=16, smallest_power=4, window_charge=1.0)
    r = random.Random(8)
    for _ in range(50):
        at = [0, *sorted(r.sample(range(1, 60), 14))]
        at = [x for i, x in enumerate(at) if i == 0 or x - at[i - 1] <= 16]
        if max(np.diff(at), default=99) > 16:
            continue
        pen = [float(r.randrange(5)) for _ in at]

        def cost(i, j):
            return pen[j] + 1.0 + packing.padded(at[j] - at[i], p) - (at[j] - at[i]) if at[j] - at[i] >= 4 or at[j] - at[i] & (at[j] - at[i] - 1) else pen[j] + 1.0 + 16 - (at[j] - at[i])

        best = [0.0]
        for j in range(1, len(at)):
            best.append(min(best[i] + cost(i, j) for i in range(j) if at[j] - at[i] <= 16))
        cuts = [0, *packing.best_cuts(at, pen, p)]
        assert math.isclose(sum(cost(i, j) for i, j in zip(cuts, cuts[1:], strict=False)), best[-1])


URLS = ["http://A.Example.org/es/1?x#y", "https://example.org/en/12", "https://m.example.org/en/2", "http://x.com/fr/#a", "http://x.com/de/", "http://x.com", "x.com/de/", None, "", "http://org/", "ftp://notexample.org/es/", "http://É.org/a://b", "http://x.com/fr/", "http://x.com/fr/", "http://" + "a." * 4000 + "example.org/es/" + "b" * 50000, "http://./fr/", "http://..com/fr/"]


def by_hand(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([i for i in (rest.find(c) for c in "/?#") if i >= 0], default=len(rest))
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
        rest = rest[cut:]
        path = rest[:min([i for i in (rest.find(c) for c in "?#") if i >= 0], default=len(rest))]
    fits = [r for r in url_filters.RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, key=lambda r: len(r.host + r.path), default=None)
    return host, path, best and best.host + best.path, best.verdict if best else "allow"


@pytest.mark.parametrize("most", [20_000, 0])
def test_url_filters(spark, monkeypatch, most):
    monkeypatch.setattr(url_filters, "BROADCAST_RULES", most)
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate(URLS)], "page_id bigint, url string, prefix string")
    got = {r.page_id: tuple(r)[1:] for r in url_filters.filter_urls(pages).collect()}
    assert got == {i: by_hand(u) for i, u in enumerate(URLS)}
    assert url_filters.filter_urls(pages.limit(0)).count() == 0
    assert {r.verdict for r in url_filters.filter_urls(pages, []).collect()} == {"allow"}


HEX = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"


@pytest.fixture(scope="module")
def corpus(spark):
    """Documents whose words the scanner learns from; their ids begin at a million."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    return docs.select((F.col("doc_id") + 1_000_000).alias("doc_id"), "text", "source", F.lit(1.0).alias("score"), F.lit("x").alias("cut")).persist()


PLANTED = "doc_id bigint, text string, source string, score double, cut string"


def test_secrets(spark, corpus):
    texts = [None, "", f'the token = "{HEX}" and more', "averyveryverylongordinarywordhere and text", f"commit {HEX} by someone", "number 4785380592391139 here", f'api_key: "{HEX}"\nsecret: "{HEX[::-1]}"', 'password = "hunter2!Xy9"', "password: Tr0ub4dor&3zQ", "y" * 300_000]
    docs = spark.createDataFrame([(i, t, "src", 1.0, "x") for i, t in enumerate(texts)] + [(None, texts[2], "src", 1.0, "x"), (2, texts[4], "src", 1.0, "x"), (2, texts[2], "src", 1.0, "x")], PLANTED).union(corpus)
    found = [(r.doc_id, r.nth, r.is_secret, r.candidate) for r in secret_scan.scan(docs).where("doc_id IS NULL OR doc_id < 1000000").collect()]
    secrets = {(i, c) for i, _, yes, c in found if yes}
    assert secrets == {(2, HEX), (None, HEX), (6, HEX), (6, HEX[::-1]), (7, "hunter2!Xy9"), (8, "Tr0ub4dor&3zQ")}
    assert {(4, HEX), (2, HEX)} <= {(i, c) for i, _, yes, c in found if not yes} | secrets
    got = secret_scan.masked(docs).where("doc_id IS NULL OR doc_id < 1000000")
    masked = Counter((r.doc_id, r.text) for r in got.collect())
    mask = 'the token = "<SECRET>" and more'
    assert masked[2, mask] == 2 and masked[None, mask] == 1 and masked[2, texts[4]] == 1
    assert masked[6, 'api_key: "<SECRET>"\nsecret: "<SECRET>"'] == 1
    assert all(masked[i, texts[i]] == 1 for i in (0, 1, 3, 4, 5, 9))
    assert got.columns == docs.columns
    assert secret_scan.scan(docs.limit(0)).count() == 0 and secret_scan.masked(docs.limit(0)).count() == 0


def test_secrets_of_forms_not_in_training(spark, corpus):
    r = random.Random(12)
    from string import ascii_letters, ascii_lowercase, ascii_uppercase, digits
    some = lambda n, of=ascii_letters + digits: "".join(r.choice(of) for _ in range(n))
    secrets = [f() for _ in range(20) for f in (
        lambda: f"the slack token is xoxb-{some(12, digits)}-{some(24)} for now", lambda: f"export GITLAB_TOKEN=glpat-{some(20)}", lambda: f'the secret = "{some(32, ascii_uppercase + "234567")}" was shared',
        lambda: f"mail key: SG.{some(22)}.{some(43)}\n", lambda: f"my password is {some(5, ascii_lowercase)}{some(3, digits)}${some(3)}, keep it", lambda: f'passwd = "{some(14)}"')]
    others = [f() for _ in range(20) for f in (
        lambda: f"saved as IMG_{some(8, digits)}_{some(6, digits)}.jpg today", lambda: f"see /usr/share/doc/lib{some(3, digits)}/readme.html for it", lambda: f"upgraded to v2.{some(1, digits)}.{some(2, digits)}-rc1+build{some(3, digits)} yesterday",
        lambda: f"the file had the checksum {some(64, '0123456789abcdef')} before", lambda: f"order ORD-{some(9, digits)} was sent", lambda: f"meet at 2024-0{some(1, '123456789')}-1{some(1, digits)}T10:1{some(1, digits)} there", lambda: f"write to {some(6, ascii_lowercase)}{some(2, digits)}@mail.example.org about it")]
    docs = spark.createDataFrame([(i, t, "src", 1.0, "x") for i, t in enumerate(secrets + others)], PLANTED).union(corpus)
    hit = {r.doc_id for r in secret_scan.scan(docs).where("is_secret AND doc_id < 1000000").collect()}
    true = {i for i in hit if i < len(secrets)}
    assert len(true) >= 0.8 * len(secrets) and len(true) >= 0.9 * len(hit), (len(true), len(secrets), len(hit))


def test_secrets_of_documents(spark):
    """Words with signs behind them and addresses of the documents stay; their planted tokens, which are hexadecimal, go."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = [r.candidate for r in secret_scan.scan(docs).where("is_secret").collect()]
    planted = docs.select(F.explode(F.regexp_extract_all("text", F.lit(r"(?<![0-9a-f])[0-9a-f]{32,64}(?![0-9a-f])"), F.lit(0))).alias("c")).count()
    hexadecimal = [c for c in found if set(c) <= set("0123456789abcdef")]
    assert len(hexadecimal) == planted > 10 and len(hexadecimal) >= 0.9 * len(found)


def test_secret_forest_on_held_out_findings(spark, corpus):
    p = secret_scan.Forest()
    words = secret_scan.corpus_words(corpus, p).persist()
    rows = secret_scan.generated_findings(words, p).withColumn("held", F.crc32("candidate") % 4 == 0).persist()
    scanner = secret_scan.train(rows.where("NOT held").drop("held"), words)
    judged = secret_scan.judge(rows.where("held"), scanner)
    assert judged.agg(F.avg((F.col("is_secret") == (F.col("label") == 1)).cast("double"))).first()[0] > 0.93


def test_quality_on_held_out_labels(spark):
    r = random.Random(6)
    word = lambda: "".join(r.choice("aeinrst") for _ in range(r.randrange(2, 8)))
    good = [" ".join(word() for _ in range(80)) + "." for _ in range(150)]
    bad = [" ".join(word() + r.choice(["###", "$$$"]) for _ in range(80)) for _ in range(75)] + [" ".join([word()] * 80) for _ in range(75)]
    texts = [t for pair in zip(good, bad, strict=True) for t in pair] + [None, ""]
    docs = spark.createDataFrame([(i, t, "en", f"s{i % 3}", 0.5) for i, t in enumerate(texts)], "doc_id bigint, text string, lang string, source string, score double")
    labels = spark.createDataFrame([(i, 1 - i % 2, 0) for i in range(0, 200)], "doc_id bigint, quality int, toxic int")
    got = {r.doc_id: r.keep for r in quality.classify(docs, labels).collect()}
    assert sum(got[i] == (i % 2 == 0) for i in range(200, 300)) >= 97 and len(got) == 302
    kept = quality.accepted(docs, labels)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, k in got.items() if k}
    assert {r.keep for r in quality.classify(docs, labels.limit(0)).collect()} == {True}
    again = docs.union(spark.createDataFrame([(None, texts[0], "en", "s0", 0.5), (None, None, None, None, None), (7, texts[1], "en", "s1", 0.5), (900, texts[1] * 3000, "en", "s0", 0.5)], docs.schema))
    assert quality.classify(again, labels.union(labels)).count() == 306 == quality.classify(again, labels).where("score BETWEEN 0 AND 1").count()
    left = quality.accepted(again, labels)
    assert left.where("doc_id IS NULL AND text IS NOT NULL").count() == 1 and left.where("doc_id = 900").count() == 0
    assert quality.classify(docs.limit(0), labels).count() == 0


MODEL = public_tokenizers.path("piece_bpe_32k.model")


def test_pieces(spark):
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    got = {r.doc_id: r for r in sentence_pieces.sample_segmentations(frame(spark), MODEL).collect()}
    again = {r.doc_id: r for r in sentence_pieces.sample_segmentations(frame(spark).repartition(5), MODEL).collect()}
    assert got == again
    for i, t in enumerate(TEXTS):
        ids = sp.encode(t or "")
        assert (got[i].n_tokens, got[i].ids_crc32) == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())), i
        assert got[i].round_trip == (sp.decode(ids) == (t or ""))
        assert len({s.ids_crc32 for s in got[i].samples}) == len(got[i].samples) <= 3
        assert all(s.log_inclusion <= 1e-12 for s in got[i].samples)
    assert got[0].samples == [] and got[2].round_trip
    pieces = sentence_pieces.Pieces(MODEL, 1.0)
    for t in [t or "" for t in TEXTS]:
        assert pieces.decoded(np.array(sp.encode(t), np.int64)).decode() == sp.decode(sp.encode(t))
    rows = sentence_pieces.encode(frame(spark), MODEL)
    back = {r.doc_id: r.text for r in sentence_pieces.decode(rows, MODEL).collect()}
    assert back == {i: None if t is None else sp.decode(sp.encode(t)) for i, t in enumerate(TEXTS)}


def test_signs_that_stand_for_bytes_are_spelt_as_themselves(spark):
    pieces = sentence_pieces.Pieces(MODEL, 1.0)
    for text in ("x\U0010ff41y", "\U0010ff00", "\U0010ffff\U0010fffeb"):
        word = pieces._spelt(text)
        assert [c for c in word if c >= "\U0010ff00"] == [chr(sentence_pieces.BYTES + b) for c in text if c >= "\U0010ff00" for b in c.encode()]


def test_sampled_pieces_spell_the_text_and_follow_the_lattice():
    pieces = sentence_pieces.Pieces(MODEL, 0.3)
    sp = pieces.model
    firsts, pairs, prob = Counter(), Counter(), {}
    n = 4000
    for key in range(n):
        got = sentence_pieces.segmentations("hen", key, pieces, sentence_pieces.Sampling(k=2))
        assert all(sp.decode(ids) == "hen" for ids, _ in got)
        prob |= {tuple(ids): math.exp(p) for ids, p in got}
        firsts[tuple(got[0][0])] += 1
        pairs[tuple(got[0][0]), tuple(got[1][0])] += 1
    assert len(prob) > 3 and math.isclose(sum(prob.values()), 1, abs_tol=0.02)
    for x, c in firsts.items():
        assert abs(c / n - prob[x]) < 0.03
    for (x, y), c in pairs.items():  # a second draw from what the first one left
        assert abs(c / n - prob[x] * prob[y] / (1 - prob[x])) < 0.03


def test_co_training_takes_the_surest_of_all_and_scores_by_its_weights(spark):
    r, p = np.random.default_rng(3), quality.CoTraining(rounds=2, per_round=10)
    docs = spark.createDataFrame([(i, " ".join(f"{'abcdefgh'[k % 8] * 3}{k if i % 2 else ''}" for k in r.integers(0, 40, 30)), "en", f"s{i % 2}") for i in range(120)], "doc_id bigint, text string, lang string, source string")
    features = quality.featured(docs)
    model = quality.fit(features, spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id bigint, quality int"), p)
    rows = features.toPandas()
    views = [np.stack([np.frombuffer(b, np.float32) for b in rows[c]]).astype(float) for c in ("content", "page")]
    certain = quality.sigmoid(quality.logit(views[0], model["weights"][0]))
    found = quality.surest(features, model["weights"], {(rows.t1[0], rows.t2[0])}, quality.CoTraining(per_round=10, sure=0.5), (0.5, 0.5))
    order = sorted((i for i in range(1, 120) if certain[i] >= 0.5), key=lambda i: (-certain[i], rows.t1[i], rows.t2[i]))[:5]
    assert [x[0] for x in found[1]] == [(rows.t1[i], rows.t2[i]) for i in order]
    logits = [views[i] @ model["weights"][i][:-1] + model["weights"][i][-1] for i in (0, 1)]
    steps = [x * c[0] + c[1] for x, c in zip(logits, model["calibrated"], strict=True)]
    want = 1 / (1 + np.exp(-(steps[0] * model["combined"][0] + steps[1] * model["combined"][1] + model["combined"][2])))
    got = {x.doc_id: x.score for x in quality.score(features, model, p).collect()}
    assert all(math.isclose(got[d], w, abs_tol=1e-9) for d, w in zip(rows.doc_id, want, strict=True))
    assert sum((got[i] > 0.5) == (i % 2 == 1) for i in range(40, 120)) >= 76


DOCUMENTS = "doc_id bigint, text string, lang string, source string, n_chars bigint, dropped string, row string, t1 string, `a.b``c` string"


def odd_documents(spark):
    """Documents of the pipeline with nulls, empties, repeats, ties, a very long text, and columns of clashing names."""
    real = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("*", *[F.lit("x").alias(c) for c in ("dropped", "row", "t1", "a.b`c")])
    text = real.where("length(text) > 300").orderBy("doc_id").first().text
    odd = [(None, None, None, None, None, None, None, None, None), (None, text, "en", "src0", 1, "x", None, "x", "y"), (900_001, "", "en", "src0", 0, "x", "x", "x", None), (900_002, text, "en", "src0", 1, "x", "x", "x", None),
           (900_002, text, "en", "src0", 1, "x", "x", "x", None), (900_003, f"{text}\nthe token = \"{HEX}\" was here", "en", "src0", 1, None, "x", "x", None), (900_004, " ".join(text.split()[::-1]) * 200, "en", "src0", 1, "x", "x", "x", None)]
    return real.unionByName(spark.createDataFrame(odd, DOCUMENTS))


def test_every_stage_on_odd_documents(spark):
    source = "/root/testdata/sf0.001"
    docs = odd_documents(spark)
    before, columns = docs.count(), docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        left = stage(spark, docs, source).persist()
        assert left.columns == columns and left.schema["text"].dataType.simpleString() == "string", name
        assert 0 < left.count() <= before, name
        empty = stage(spark, docs.limit(0), source)
        assert empty.columns == columns and empty.count() == 0, name
    pack = corpus_pipeline.STAGES[-1][1]
    assert pack(spark, docs, source).select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()
    assert pack(spark, docs.limit(0), source).count() == 0


def test_stages_take_effect(spark):
    source, docs = "/root/testdata/sf0.001", odd_documents(spark)
    stages = dict(corpus_pipeline.STAGES)
    near = stages["n-gram Jaccard join"](spark, docs, source)
    assert near.where("doc_id = 900002").count() == 0 and near.where("doc_id IS NULL").count() == 2
    masked = {r.doc_id: r for r in stages["secret scans"](spark, docs, source).where("doc_id >= 900000").collect()}
    assert "<SECRET>" in masked[900_003].text and HEX not in masked[900_003].text and masked[900_003].n_chars == len(masked[900_003].text)
    lines = stages["line dedup"](spark, docs, source)
    assert lines.where("doc_id = 900002").count() == 0
    assert lines.where("doc_id = 900003").first().text.startswith("the token")
    kept = {r.doc_id: r.text for r in stages["quality classifier"](spark, docs, source).collect()}
    given = {r.doc_id: r.text for r in docs.collect()}
    assert all(given[i] == t for i, t in kept.items() if i is not None)


def test_pipeline(spark):
    source = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{source}/documents.parquet")
    packed = corpus_pipeline.run(spark, source).toPandas()
    assert set(packed.doc_id) <= {r.doc_id for r in docs.select("doc_id").collect()} and len(set(packed.doc_id)) > 0.5 * docs.count()
    assert (packed.groupby("doc_id").length.sum() == packed.groupby("doc_id").doc_tokens.first()).all()
    assert [s for s, _ in corpus_pipeline.STAGES] == ["quality classifier", "line dedup", "n-gram Jaccard join", "secret scans", "packing"]


def test_words_that_are_forgotten_are_learnt_again(monkeypatch):
    monkeypatch.setattr(sentence_pieces, "TRANSITIONS", 300)
    monkeypatch.setattr(sentence_pieces, "CACHE", 8)
    pieces, fresh = sentence_pieces.Pieces(MODEL, 1.0), sentence_pieces.Pieces(MODEL, 1.0)
    texts = [f"some words stay while others{i} come and go{i * 7}, é{i}\nand so on" for i in range(30)]
    for t in texts:
        fresh.clear()
        assert sentence_pieces.segmentations(t, 5, pieces) == sentence_pieces.segmentations(t, 5, fresh)
        assert pieces.encoded(pieces.know([t])[0]).tolist() == pieces.model.encode(t)
    assert len(pieces.index) < 60


def test_third_samples_follow_what_the_first_two_leave():
    pieces = sentence_pieces.Pieces(MODEL, 0.3)
    prob, thirds, expected = {}, Counter(), Counter()
    for key in range(3000):
        got = [(tuple(ids), math.exp(p)) for ids, p in sentence_pieces.segmentations("he", key, pieces, sentence_pieces.Sampling(k=3))]
        prob |= dict(got)
        thirds[got[2][0] if len(got) > 2 else None] += 1
        if len(got) > 2:
            left = 1 - got[0][1] - got[1][1]
            for x, p in prob.items():
                if x not in (got[0][0], got[1][0]):
                    expected[x] += p / left
    for x, n in expected.items():
        assert abs(thirds[x] - n) < 120, (x, thirds[x], n)


def test_long_words_have_one_lattice():
    pieces = sentence_pieces.Pieces(MODEL, 1.0)
    sp = pieces.model
    weight = {sp.id_to_piece(i): pieces.weight[i] for i in range(sp.get_piece_size()) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))}
    longest = max(map(len, weight))
    for word in ("international" * 3, "international" * 400):
        text = sentence_pieces.SPACE + word
        log_mass = [0.0] * (len(text) + 1)
        for i in range(len(text) - 1, -1, -1):
            log_mass[i] = np.logaddexp.reduce([np.log(weight[text[i:k]]) + log_mass[k] for k in range(i + 1, min(i + longest, len(text)) + 1) if text[i:k] in weight])
        for ids, log_prob in sentence_pieces.segmentations(word, 1, pieces):
            spelt = [sp.id_to_piece(i) for i in ids]
            assert "".join(spelt) == text
            assert abs(sum(np.log(weight[x]) for x in spelt) - log_mass[0] - log_prob) < 1e-3 * max(1, len(word) / 50)


def test_plain_texts_are_told_to_round_trip_by_their_words(monkeypatch):
    pieces = sentence_pieces.Pieces(MODEL, 1.0)
    texts = ["a plain text, of words", "the \ufb01rst of 2\u00b2", "two  spaces", " ends ", "", "emoji \U0001f9ff and \u0638", "\u2581own sign", "a\u00a0b c\td"]
    for t in texts:
        [words] = pieces.know([t])
        ids = pieces.encoded(words)
        assert pieces.returns(t, words, ids) == (pieces.model.decode(ids.tolist()) == t), t
    assert {bool(x) for x in pieces.same.a[:pieces.same.size]} == {True, False}
    monkeypatch.setattr(pieces, "decoded", lambda ids: 1 / 0)
    [words] = pieces.know([texts[0]])
    assert pieces.returns(texts[0], words, pieces.encoded(words))
