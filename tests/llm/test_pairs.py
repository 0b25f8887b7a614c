"""Fingerprints, neighbours, Jaccard join, line dedup and components against brute force."""

import hashlib
import itertools
import math
import random
from collections import Counter

import numpy as np
import pytest

from kestrel.llm import components, fingerprints, jaccard_join, line_dedup, neighbours

DOCS = "doc_id bigint, text string, n_chars bigint, class_id string"


def words(n, seed, size=400):
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(size)}" for _ in range(n))


def corpus():
    """Texts with copies, near copies, nulls, empty and very long ones; the last columns clash with results."""
    base = [words(60, i) for i in range(8)]
    near = [" ".join(w if i != k else "changed" for i, w in enumerate(base[0].split())) for k in range(0, 60, 4)]
    texts = [*base, base[0], base[1], base[1], *near, None, "", "one two", "one two", words(30000, 99), "   ", "héllo wörld 漢字"]
    return [(i * 3, t, 5, "x") for i, t in enumerate(texts)]


def test_components(spark):
    r = random.Random(1)
    edges = [(r.randrange(200), r.randrange(200)) for _ in range(120)] + [(7, 7)] + [(500, i) for i in range(501, 540)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = sorted((find(a), find(b)))
            parent[b] = a
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "x bigint, y bigint")).collect()}
    assert got == {x: find(x) for x in parent}
    assert components.components(spark.createDataFrame([], "x bigint, y bigint")).count() == 0


def test_jaccard_join(spark):
    docs = corpus()
    j = jaccard_join.Join(leaf=4, block=6)
    got = {r.doc_id: (r.class_id, r.n_links) for r in jaccard_join.near_duplicates(spark.createDataFrame(docs, DOCS), j).collect()}
    sets = {d: frozenset(jaccard_join.shingle_set(t, 5).tolist()) for d, t, *_ in docs}
    links = {d: [e for e in sets if e != d and sets[d] and sets[e] and len(sets[d] & sets[e]) >= 0.8 * len(sets[d] | sets[e])] for d in sets}
    names = {d: d for d in sets}
    for _ in sets:
        for d in sets:
            names[d] = min([names[d], *(names[e] for e in links[d])])
    assert got == {d: (names[d], len(links[d])) for d in sets}


def test_jaccard_join_of_repeated_rows(spark):
    a, b, near = words(60, 1), words(60, 2), " ".join([*words(60, 1).split()[:-1], "changed"])
    rows = [(5, a), (5, a), (5, b), (7, near), (None, a), (None, None), (9, b), (9, b)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = sorted((str(r.doc_id), str(r.class_id), r.n_links) for r in jaccard_join.near_duplicates(frame).collect())
    assert got == sorted([("5", "5", 2), ("5", "5", 2), ("5", "5", 2), ("7", "5", 2), ("None", "None", 0), ("None", "None", 0), ("9", "5", 2), ("9", "5", 2)])
    kept = [(r.doc_id, r.text) for r in jaccard_join.one_of_each(frame).collect()]
    assert sorted(str(d) for d, _ in kept) == ["5", "None", "None"] and kept.count((None, a)) == 1


def test_jaccard_join_of_nothing(spark):
    assert jaccard_join.near_duplicates(spark.createDataFrame([], DOCS)).count() == 0
    kept = jaccard_join.one_of_each(spark.createDataFrame(corpus(), DOCS))
    assert kept.columns == ["doc_id", "text", "n_chars", "class_id"]


@pytest.mark.parametrize("union", [10, 15, 20, 30, 40])
def test_short_texts_at_the_threshold_pass_the_sieve(union):
    j, r, lost = jaccard_join.Join(), random.Random(union), 0
    for _ in range(2000):
        text = [f"w{r.getrandbits(40)}" for _ in range(union * 9 // 10 + 4)]
        other = text.copy()
        other[-(union // 10)] = "changed"
        a, b = (jaccard_join.shingle_set(" ".join(t), 5) for t in (text, other))
        assert len(np.intersect1d(a, b)) >= 0.8 * len(np.union1d(a, b))
        lost += int((jaccard_join.embedding(a, j.tokens) == jaccard_join.embedding(b, j.tokens)).sum()) < j.agreeing
    assert lost <= 6  # a binomial's share of 0.0006, and what chance adds


def test_runs_follow_the_recall():
    assert jaccard_join.Join(recall=0.999).runs > jaccard_join.Join(recall=0.9).runs >= 1


def test_fingerprints(spark):
    docs = [d for d in corpus() if d[0] % 2 == 0 or d[0] < 40]
    got = {r.doc_id: r for r in fingerprints.fingerprint_documents(spark.createDataFrame(docs, DOCS), 3).collect()}
    assert len(got) == len(docs)
    texts = [t or "" for _, t, *_ in docs]
    marks = {}
    for i, (d, *_) in enumerate(docs):
        t, after, r = texts[i], texts[(i + 1) % len(docs)], got[d]
        edited = t[:len(t) - len(t) // 4] + after[:len(t) // 4]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert marks.setdefault(t, r.fingerprint) == r.fingerprint
        assert 0 <= r.near_next <= 1 and 0 <= r.near_edited <= 1
        assert r.edited_fingerprint == fingerprints.fingerprint(edited).hex()
    empty = fingerprints.fingerprint_documents(spark.createDataFrame([], DOCS), 3)
    assert empty.count() == 0 and "fingerprint" in empty.columns


def test_repeated_ids_and_one_document(spark):
    one = fingerprints.fingerprint_documents(spark.createDataFrame([(1, "abcd efgh", 0, "")], DOCS), 2).collect()
    assert len(one) == 1 and one[0].near_next == 1.0
    twice = fingerprints.fingerprint_documents(spark.createDataFrame([(1, "abcd", 0, ""), (1, "abcd", 0, ""), (None, "x", 0, "")], DOCS), 2).collect()
    assert sorted(str(x.doc_id) for x in twice) == ["1", "1", "None"]


def test_block_tables_find_all_pairs(spark):
    r = random.Random(5)
    marks = {r.getrandbits(128) for _ in range(40)}
    for m in list(marks):
        marks.add(m ^ sum(1 << b for b in r.sample(range(128), r.randrange(1, 7))))
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    rows = [(signed(m >> 64), signed(m & (1 << 64) - 1)) for m in marks]
    got = fingerprints.near_fingerprints(spark.createDataFrame(rows, "high bigint, low bigint")).count()
    assert got == sum((a ^ b).bit_count() <= fingerprints.RADIUS for a, b in itertools.combinations(marks, 2)) > 0


def test_neighbours(spark):
    r = np.random.default_rng(3)
    v = r.normal(size=(900, 16)).astype(np.float32)
    v[100:180] = v[100]  # copies
    rows = [(i, x.tolist(), 1) for i, x in enumerate(v)]
    rows += [(1000, None, 1), (1020, [0.0] * 16, 1), (1040, [float("nan")] * 16, 1), (1060, [None] + [1.0] * 15, 1), (1080, [float("inf")] * 16, 1)]
    g = neighbours.Graph(shard_rows=300, block=16)
    got = neighbours.nearest(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, rank int"), g=g).collect()
    scores = v.astype(np.float64) @ v.astype(np.float64).T
    found = 0
    for q in range(0, 900, 20):
        mine = sorted((x.rank, x.vec_id, x.score) for x in got if x.query_id == q)
        assert [x[0] for x in mine] == list(range(1, 21))
        assert mine == sorted(mine, key=lambda x: (-x[2], x[1]))
        assert all(abs(scores[q, i] - s) < 1e-9 and i != q for _, i, s in mine)
        true = sorted((-scores[q, i], i) for i in range(900) if i != q)[:20]
        found += len({i for _, i in true} & {x[1] for x in mine})
    assert found / (45 * 20) >= 0.9 and len(got) == 45 * 20
    few = neighbours.nearest(spark.createDataFrame([(0, [1.0, 0.0], 1), (1, [0.5, 1.0], 1), (2, [-1.0, 0.0], 1)], "vec_id bigint, embedding array<float>, rank int")).collect()
    assert [(x.query_id, x.rank, x.vec_id) for x in few] == [(0, 1, 1), (0, 2, 2)]
    assert neighbours.nearest(spark.createDataFrame([], "vec_id bigint, embedding array<float>")).count() == 0


@pytest.mark.parametrize("spread", [0.0, 0.3])
def test_neighbours_of_uneven_vectors_in_full_shards(spread):
    r, g = np.random.default_rng(11), neighbours.Graph()
    v = r.normal(size=(g.shard_rows, 64)) * np.exp(r.normal(size=(g.shard_rows, 1)) * spread)
    shard = neighbours.Shard(np.arange(len(v)), v, g)
    queries = np.arange(0, len(v), 80)
    met = {}
    for q, i, s in shard.search(queries, v[queries], 20, g):
        met.setdefault(q, set()).add(i)
        assert math.isclose(s, v[i] @ v[q], rel_tol=1e-9, abs_tol=1e-9)
    scores = v[queries] @ v.T
    scores[np.arange(len(queries)), queries] = -np.inf
    true = np.argsort(-scores, 1)[:, :20]
    assert np.mean([len(met[q] & set(t.tolist())) / 20 for q, t in zip(queries, true, strict=True)]) >= 0.9


def test_scores_of_doubles_are_exact(spark):
    v = np.random.default_rng(2).normal(size=(40, 6)) * 1e150
    got = neighbours.nearest(spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id bigint, embedding array<double>")).collect()
    assert len(got) == 40 and all(math.isclose(r.score, v[r.query_id] @ v[r.vec_id], rel_tol=1e-12) for r in got)


def test_repeated_vectors_take_one_rank(spark):
    v = np.random.default_rng(8).normal(size=(60, 8)).astype(np.float32)
    rows = [(i, x.tolist()) for i, x in enumerate(v)]
    make = lambda x: sorted(tuple(y) for y in neighbours.nearest(spark.createDataFrame(x, "vec_id bigint, embedding array<float>"), g=neighbours.Graph(shard_rows=20)).collect())
    once = make(rows)
    assert len(once) == 60 and len({(q, i) for q, _, i, _ in once}) == 60
    twice = make([*rows, *rows, *rows[:20]])
    assert len(twice) == 60 and len({(q, i) for q, _, i, _ in twice}) == 60


def test_vectors_of_several_dimensions_and_clashing_ids(spark):
    v = np.random.default_rng(9).normal(size=(60, 8)).round(3)
    rows = [(i, x.tolist()) for i, x in enumerate(v)]
    make = lambda x: sorted(tuple(y) for y in neighbours.nearest(spark.createDataFrame(x, "vec_id bigint, embedding array<double>").repartition(3), g=neighbours.Graph(shard_rows=200)).collect())
    plain = make(rows)
    assert make([*rows, (60, [1.0, 2.0]), (61, [1.0] * 9), (0, [5.0])]) == plain
    assert make([*rows, (7, [9.0] * 8), (7, sorted(rows[7][1]))]) == make([*rows[:7], (7, min(rows[7][1], sorted(rows[7][1]))), *rows[8:]])


def shingles_of(line):
    low = line.lower().encode("utf-16-be")
    return frozenset(low[i:i + 18] for i in range(0, max(len(low) - 17, 1), 2))


def alike(a, b):
    s, z = shingles_of(a), shingles_of(b)
    return a == b or (min(len(a), len(b)) >= 20 and len(s & z) >= 0.8 * len(s | z) - 1e-9)


def deduplicated(docs):
    """(doc_id, text) pairs without repeated lines, by brute force; doc_ids are distinct."""
    places = {}
    for i, t in docs:
        for p, line in enumerate((t or "").split("\n")):
            if line.strip(" "):
                places.setdefault(line, []).append((i, p))
    group = {x: x for x in places}
    near = [(a, b) for a, b in itertools.combinations(places, 2) if alike(a, b)]
    changed = True
    while changed:
        changed = False
        for a, b in near:
            least = min(group[a], group[b])
            changed |= group[a] != group[b]
            group[a] = group[b] = least
    first = {}
    for x, found in places.items():
        first[group[x]] = min(first.get(group[x], (1 << 60, 0)), *found)
    return {i: None if t is None else "\n".join(x for p, x in enumerate(t.split("\n")) if not x.strip(" ") or first[group[x]] == (i, p)) for i, t in docs}


def test_line_dedup(spark):
    base = [words(12, i) for i in range(6)]
    near = [" ".join(w if i != k else "other" for i, w in enumerate(base[0].split())) for k in range(12)]
    far = [" ".join(w if i > k else f"z{k}{i}" for i, w in enumerate(base[1].split())) for k in range(10)]
    r = random.Random(3)
    long = ["".join(r.choice("abcdefghij") for _ in range(n)) for n in (118, 121, 400)]
    long += [x + " end" for x in long] + [" ".join([x, "with", "words"]) for x in long]
    texts = ["\n".join([base[0], "short", base[2]]), "\n".join([near[1], base[2], base[2]]), None, "", "\n".join(near), "\n".join(far), "short\nshort\n\n \n", base[3] + "\n", "漢字" * 30 + "\n" + "漢字" * 29 + "仮", base[3], "\n".join(long), words(4000, 5) + "\n" + words(4000, 5) + " more", "\n\n", "🙂" * 12 + "\n" + "🙂" * 13]
    docs = list(enumerate(texts))
    frame = spark.createDataFrame([(i, t, 3, "x", "y", 1) for i, t in docs], "doc_id bigint, text string, n_dropped int, first string, dropped string, version int")
    got = {r.doc_id: r for r in line_dedup.dedup_lines(frame).collect()}
    want = deduplicated(docs)
    assert {i: x.text for i, x in got.items()} == want
    assert all(got[i].n_lines == (0 if t is None else len(t.split("\n"))) for i, t in docs)
    assert got[0].n_dropped == 0 and got[6].n_dropped == 2
    assert line_dedup.dedup_lines(frame).columns == ["doc_id", "text", "first", "dropped", "version", "n_lines", "n_dropped"]
    assert line_dedup.dedup_lines(frame.limit(0)).count() == 0


def test_line_dedup_of_repeated_and_nameless_rows(spark):
    rows = [(1, "one line of some length here\nand another that is not like it\none line of some length here"), (0, "x"), (1, "a text of its own for the same id\nand another that is not like it"), (None, "one line of some length here"), (None, None)]
    got = line_dedup.dedup_lines(spark.createDataFrame([*rows, *rows], "doc_id bigint, text string")).collect()
    assert len(got) == 10
    kept = Counter((x.doc_id, x.text) for x in got)
    assert kept[None, rows[0][1][:28]] == 2 and kept[None, None] == 2 and kept[0, "x"] == 2
    assert kept[1, "one line of some length here\nand another that is not like it"] + kept[1, "one line of some length here"] == 2
    assert sum("and another" in (x.text or "") for x in got) == 2


def test_line_dedup_recall_on_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    lines = sorted({x for _, t in rows for x in (t or "").split("\n") if len(x) >= 20})
    sets = [shingles_of(x) for x in lines]
    holders = {}
    for i, s in enumerate(sets):
        for x in s:
            holders.setdefault(x, []).append(i)
    met = Counter(pair for found in holders.values() if len(found) <= 60 for pair in itertools.combinations(found, 2))
    near = {(a, b) for (a, b), _ in met.items() if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}
    p = line_dedup.Lines()
    places, links = line_dedup.line_groups(docs, p)
    named = {r.node: r.component for r in components.components(links).collect()}
    text = dict(rows)
    of = {text[r.doc_id].split("\n")[r.pos]: r.id for r in places.collect()}
    name = lambda i: named.get(of.get(lines[i]), of.get(lines[i], -1 - i))
    assert len(near) > 20 and sum(name(a) == name(b) for a, b in near) >= 0.95 * len(near)
    linked = {}
    for i in range(len(lines)):
        linked.setdefault(name(i), []).append(i)
    assert all(any(alike(lines[i], lines[j]) for j in own if j != i) for own in linked.values() if len(own) > 1 for i in own)


@pytest.mark.parametrize(("template", "own", "stretch"), [(40, 24, 10_000), (24, 30, 50)])
def test_near_pairs_in_a_crowd_of_one_template(spark, template, own, stretch):
    """Hundreds of lines that share a template and meet in the same buckets, each with one near copy."""
    r = random.Random(template)
    word = lambda: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6))
    frame, lines = [word() for _ in range(template)], []
    for _ in range(300):
        tail = [word() for _ in range(own)]
        other = tail.copy()
        other[-1] = word()
        lines += [" ".join([*frame, *tail]), " ".join([*frame, *other])]
    near = [(i, j) for i, j in itertools.combinations(range(len(lines)), 2) if i // 2 == j // 2 and alike(lines[i], lines[j])]
    assert len(near) > 250 and not any(alike(lines[2 * i], lines[2 * i + 2]) for i in range(299))
    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id bigint, text string")
    left = {x.doc_id for x in line_dedup.dedup_lines(docs, line_dedup.Lines(stretch=stretch)).collect() if x.n_dropped == 0}
    assert sum(i in left and j in left for i, j in near) <= 0.05 * len(near)
    assert all(2 * i in left for i in range(300))


def test_lines_that_differ_inside_long_words_stay(spark):
    r = random.Random(4)
    digest = lambda: f"{r.getrandbits(128):032x}"
    same = digest()[:12]
    lines = ["download the file from https://cdn.example.com/archive/a1 now", "download the file from https://cdn.example.com/mirrors/zz9 now",
             *[f"the object of this build was stored in the cache as {same}{digest()}" for _ in range(5)],
             *[f"see /usr/share/doc/{r.choice('abc') * 9}/{digest()} for what the package holds" for _ in range(5)],
             "Donaudampfschifffahrtsgesellschaft und was dazu gesagt ist", "Donaudampfmaschinenverordnungsblatt und was dazu gesagt ist",
             " \t" * 12, "\t\t  " * 6]
    kept = line_dedup.dedup_lines(spark.createDataFrame([*enumerate(lines), (99, lines[0])], "doc_id bigint, text string")).collect()
    assert {x.doc_id: x.n_dropped for x in kept} == {**dict.fromkeys(range(len(lines)), 0), 99: 1}


@pytest.mark.parametrize("sizes", [[3, 2], [1, 5, 9]])
def test_shared_counts(sizes):
    r = random.Random(2)
    sets = [np.unique(np.array([r.randrange(8) for _ in range(n)], np.uint64)) for n in sizes]
    assert jaccard_join.shared_counts(sets).tolist() == [[len(set(a.tolist()) & set(b.tolist())) if i != k else int(sum(x in set(np.concatenate([s for m, s in enumerate(sets) if m != i]).tolist()) for x in a.tolist())) for k, b in enumerate(sets)] for i, a in enumerate(sets)]


def test_line_dedup_keeps_no_table_of_tokens(spark, monkeypatch):
    draw, p = random.Random(8), line_dedup.Lines()
    lines = ["".join(draw.choice("abcd") for _ in range(60)) for _ in range(4)]
    lines += [x[:i] + "#" + x[i + 1:] for x in lines for i in (0, 2, 30, 57)]
    texts = spark.createDataFrame(list(enumerate(lines)), "id long, line string")
    inside = spark.createDataFrame([(i, i, i % 3 > 0) for i in range(len(lines))], "id long, component long, out boolean")
    names, kept = [], line_dedup.written
    monkeypatch.setattr(line_dedup, "written", lambda frame, name, **more: (names.append(name), kept(frame, name, **more))[1])
    got = {(r.x, r.y) for r in line_dedup.similar(line_dedup.rest_of_pairs(inside, texts, p), texts, p).collect()}
    sets = [{x[i:i + p.shingle] for i in range(len(x) - p.shingle + 1)} for x in lines]
    near = {(i, j) for i, j in itertools.combinations(range(len(lines)), 2) if len(sets[i] & sets[j]) >= p.threshold * len(sets[i] | sets[j]) and (i % 3 or j % 3)}
    assert near and got == near and "tokens" not in names


def test_line_dedup_leaves_only_what_is_read_again(spark, monkeypatch):
    """Tables that nothing reads any more go, and so does what a write has shuffled."""
    import glob

    from kestrel import session

    base = [words(40, i) for i in range(30)]
    docs = spark.createDataFrame([(i, "\n".join([x, x + " more"])) for i, x in enumerate(base)], "doc_id bigint, text string")
    made, write = [], session.written
    monkeypatch.setattr(line_dedup, "written", lambda *a, **more: (made.append((a[1], write(*a, **more))), made[-1][1])[1])
    local = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    shuffles = lambda: {f for d in local for f in glob.glob(f"{d}/**/shuffle_*.data", recursive=True)}
    before = shuffles()
    places, links = line_dedup.line_groups(docs, line_dedup.Lines())
    assert places.count() == 60 and components.components(links).select("component").distinct().count() == 30
    there = {name for name, table in made if glob.glob(table.shared_path.removeprefix("file:") + "/*.parquet")}
    assert there == {"members", "occurrences", "wide", "rest", "links"}
    assert len(shuffles() - before) < 30
