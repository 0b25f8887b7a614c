"""Secret scanning with a random forest that removes false positives.

Candidates are runs of the characters that keys and passwords are made of, with
letters and digits mixed, or long. What tells a secret from a look-alike is
learnt: a dictionary and the transitions of characters from the corpus's own
words, and what neighbouring words and paths speak for from labelled findings.
A random forest over these, trained on the labelled findings, judges every
candidate. Everything here is DataFrame functions and Spark's own learner.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kestrel.llm.tables import own_columns, read
from kestrel.session import written


@dataclass(frozen=True)
class Forest:
    """Parameters: trees, depth, least score of a secret, labelled findings that are generated,
    words and parts of words in the dictionary, characters of context on either side."""

    trees: int = 40
    depth: int = 9
    least_score: float = 0.5
    generated: int = 12_000
    words: int = 20_000
    grams: int = 50_000
    seed: int = 17
    context: int = 64


SIGNS = r"A-Za-z0-9+/_=\-.!@#$%^&*~"

#: A candidate: at least eight signs, not ending in a stop; letters and digits, or letters of
#: both cases and a symbol, or twenty signs with a letter. The bounds are part of the operator's contract.
RUN = (rf"(?<![{SIGNS}])(?=[{SIGNS}]{{8}})(?=[{SIGNS}]*[A-Za-z])"
       rf"(?:(?=[{SIGNS}]*[0-9])|(?=[{SIGNS}]{{20}})|(?=[{SIGNS}]*[a-z])(?=[{SIGNS}]*[A-Z])(?=[{SIGNS}]*[+/_=@#$%^&*~]))"
       rf"[{SIGNS}]*[A-Za-z0-9+/_=\-@#$%^&*~]")

MASK = "<SECRET>"

#: Features of the candidate alone, and those that what was learnt gives.
SHAPE = ("length", "digits", "upper", "symbols", "changes", "distinct", "hexadecimal", "stops", "longest_letters")
LEARNT = ("transitions", "coverage", "words_before", "words_after", "path_words", "joined")

OWN = ("path", "candidate", "before", "after")


def candidates(docs: DataFrame, p: Forest) -> DataFrame:
    """doc_id, t1, t2, path, nth, candidate, before, after: a row for each candidate of each text.

    t1 and t2 are hashes of the text, by which results find their rows.
    """
    path = F.coalesce(F.col("source").cast("string"), F.lit("")) if "source" in docs.columns else F.lit("")
    hit = docs.where(F.col("text").rlike(RUN)).select(
        F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("t1"), F.xxhash64(F.lit(1), "text").alias("t2"), path.alias("path"),
        F.explode(F.array(F.struct(F.regexp_extract_all("text", F.lit(RUN), F.lit(0)).alias("runs"), F.split("text", RUN, -1).alias("rest")))).alias("cut"))
    found = F.transform(F.col("cut.runs"), lambda run, i: F.struct(
        i.alias("nth"), run.alias("candidate"),
        F.right(F.get("cut.rest", i), F.lit(p.context)).alias("before"), F.left(F.get("cut.rest", i + 1), F.lit(p.context)).alias("after")))
    return hit.select("doc_id", "t1", "t2", "path", F.explode(found).alias("f")).select("doc_id", "t1", "t2", "path", "f.*")


# what is learnt: rows (kind, key, value) that candidates' parts meet in one broadcast join of bounded size


def corpus_words(docs: DataFrame, p: Forest) -> DataFrame:
    """word, n: the most frequent words of letters alone, over the whole table."""
    words = docs.select(F.explode(F.split(F.lower("text"), r"[^\p{L}]+")).alias("word")).where(F.length("word").between(2, 24))
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "word").limit(p.words)


def runs_of(text: Column, size: int) -> Column:
    """All runs of ``size`` characters, found in one pass over the text."""
    return F.regexp_extract_all(text, F.lit(rf"(?s)(?=(.{{{size}}}))"), F.lit(1))


def classed(text: Column) -> Column:
    """Letters in lower case, digits as ``0``, all else as ``#``; the ends are ``#`` too."""
    plain = F.regexp_replace(F.regexp_replace(F.lower(text), "[0-9]", "0"), r"[^\p{L}0]", "#")
    return F.concat(F.lit("#"), plain, F.lit("#"))


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}]+"), lambda w: w != "")


def parts(kind: str, keys: Column) -> Column:
    return F.transform(F.array_distinct(keys) if kind in ("before", "after", "path") else keys, lambda k: F.struct(F.lit(kind).alias("kind"), k.alias("key")))


def all_parts() -> Column:
    """The parts of a candidate and its surroundings that are looked up."""
    c = F.col("candidate")
    return F.concat(
        parts("pair", runs_of(classed(c), 2)), parts("gram", runs_of(F.lower(c), 4)),
        parts("before", F.slice(F.reverse(words_of(F.col("before"))), 1, 4)), parts("after", F.slice(words_of(F.col("after")), 1, 3)), parts("path", words_of(F.col("path"))),
        parts("joined", F.array(F.concat(F.regexp_extract("before", r"([^\p{L}\p{N}]{0,3})$", 1), F.lit("|"), F.regexp_extract("after", r"^([^\p{L}\p{N}]?)", 1)))))


def dictionary(words: DataFrame, p: Forest) -> DataFrame:
    """kind, key, value: log chances of pairs of characters, and the parts of four letters that words have."""
    pairs = words.select("n", F.explode(runs_of(classed(F.col("word")), 2)).alias("key")).groupBy("key").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "key").limit(4096)
    firsts = pairs.groupBy(F.left("key", F.lit(1)).alias("first")).agg(F.sum("n").alias("total"))
    pairs = pairs.withColumn("first", F.left("key", F.lit(1))).join(firsts, "first").select(F.lit("pair").alias("kind"), "key", F.log((F.col("n") + 1) / (F.col("total") + 64)).alias("value"))
    grams = words.where("length(word) > 3").select("n", F.explode(runs_of(F.col("word"), 4)).alias("key")).groupBy("key").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "key").limit(p.grams)
    return pairs.union(grams.select(F.lit("gram").alias("kind"), "key", F.lit(1.0).alias("value")))


def evidence(findings: DataFrame) -> DataFrame:
    """kind, key, value: log odds that the words around findings, and what joins them, speak for a secret."""
    rows = findings.select("label", F.explode(all_parts()).alias("p")).select("label", "p.*").where("kind IN ('before', 'after', 'path', 'joined')")
    counts = rows.groupBy("kind", "key").agg(F.sum("label").alias("yes"), F.count(F.lit(1)).alias("n")).where("n >= 5")
    return counts.select("kind", "key", F.log((F.col("yes") + 1) / (F.col("n") - F.col("yes") + 1)).alias("value"))


def with_features(found: DataFrame, learnt: DataFrame) -> DataFrame:
    """``found`` with the forest's features, all doubles; equal findings are looked up once."""
    c, n = F.col("candidate"), F.length("candidate")
    name = [F.xxhash64(*OWN).alias("k1"), F.xxhash64(F.lit(1), *OWN).alias("k2")]
    rows = found.select(*name, *OWN).dropDuplicates(["k1", "k2"]).select("k1", "k2", F.explode(all_parts()).alias("p")).select("k1", "k2", "p.*").join(F.broadcast(learnt), ["kind", "key"], "left")
    # a pair that no word has is as rare as the rarest
    value = lambda kind, none: F.when(F.col("kind") == kind, F.coalesce("value", F.lit(none)))
    looked_up = rows.groupBy("k1", "k2").agg(
        F.avg(value("pair", -9.0)).alias("transitions"), F.avg(value("gram", 0.0)).alias("coverage"), F.sum(value("before", 0.0)).alias("words_before"),
        F.sum(value("after", 0.0)).alias("words_after"), F.sum(value("path", 0.0)).alias("path_words"), F.sum(value("joined", 0.0)).alias("joined"))

    def share(pattern: str) -> Column:
        return F.regexp_count(c, F.lit(pattern)) / n

    shape = {
        "length": F.log(n.cast("double")), "digits": share("[0-9]"), "upper": share("[A-Z]"), "symbols": share("[^A-Za-z0-9]"),
        "changes": share("(?<=[a-z])(?=[^a-z])|(?<=[A-Z])(?=[^A-Z])|(?<=[0-9])(?=[^0-9])"), "distinct": F.size(F.array_distinct(F.split(c, ""))) / F.least(n, F.lit(64)),
        "hexadecimal": share("[0-9a-fA-F]"), "stops": share("[./_-]"),
        "longest_letters": F.array_max(F.transform(F.split(c, "[^A-Za-z]+"), lambda w: F.length(w))) / n}
    joined = found.select("*", *name).join(looked_up, ["k1", "k2"], "left")
    return joined.select(*found.columns, *[shape[x].cast("double").alias(x) for x in SHAPE], *[F.coalesce(F.col(x), F.lit(0.0)).alias(x) for x in LEARNT])


# labelled findings

#: Kinds of generated findings; those below 12 are secrets.
KINDS = 32


def generated_findings(words: DataFrame, p: Forest) -> DataFrame:
    """path, candidate, before, after, label, kind: findings of many kinds, of digests and the corpus's words.

    Kinds below 12 are secrets. They differ from the others in what they are made
    of or in what stands around them, never in one place alone: digests come as
    keys and as checksums, words as parts of passwords and of identifiers.
    """
    spark = words.sparkSession
    numbered = words.select(F.row_number().over(_least_order()).alias("i"), "word").where("length(word) > 2")
    size = max(1, numbered.agg(F.max("i")).first()[0] or 1)
    i = F.col("id")
    rows = spark.range(p.generated).select(
        i, (i % KINDS).cast("int").alias("kind"), F.md5(i.cast("string")).alias("m"), F.sha1(i.cast("string")).alias("s"), F.sha2(i.cast("string"), 256).alias("x"),
        F.translate(F.base64(F.unhex(F.sha2(i.cast("string"), 512))), "\r\n", "").alias("b"))
    for k in range(4):
        word = F.broadcast(numbered.select(F.col("i").alias(f"i{k}"), F.col("word").alias(f"w{k}")))
        rows = rows.withColumn(f"i{k}", (F.pmod(F.xxhash64("id", F.lit(k)), F.lit(size)) + 1).cast("int")).join(word, f"i{k}", "left").withColumn(f"w{k}", F.coalesce(f"w{k}", F.lit("word")))
    pick = lambda values, salt: F.get(F.array(*[F.lit(v) for v in values]), F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(len(values))).cast("int"))
    w = [F.col(f"w{k}") for k in range(4)]
    m, s, x, b, plain = F.col("m"), F.col("s"), F.col("x"), F.col("b"), F.translate("b", "+/=", "xyz")
    number = F.substring(F.translate("s", "abcdef", "012345"), 1, 12)
    cut = lambda text, least, most: F.left(text, F.lit(least) + F.pmod(F.xxhash64("id", F.lit(9)), F.lit(most - least + 1)).cast("int"))
    cased = F.when(F.pmod(F.xxhash64("id", F.lit(5)), F.lit(4)) == 0, F.upper(s)).otherwise(s)
    secret = [
        cased, cut(b, 24, 60), F.concat(F.lit("AKIA"), F.upper(F.left(plain, F.lit(16)))), F.concat(F.lit("ghp_"), F.left(plain, F.lit(36))),
        F.concat(pick(["sk_live_", "sk-", "rk_", "pk_live_"], 11), cut(plain, 20, 40)), F.concat(F.lit("eyJ"), F.left(plain, F.lit(30)), F.lit("."), F.substring(plain, 31, F.lit(40)), F.lit("."), F.left(m, F.lit(20))),
        m, F.concat(F.initcap(w[0]), F.left(number, F.lit(3)), pick(["!", "#", "$", "%", "&"], 12), F.left(plain, F.lit(2))), cut(plain, 10, 20),
        F.concat(F.left(w[0], F.lit(5)), pick(["@", "!", "_", "-"], 13), F.left(number, F.lit(4)), F.substring(plain, 3, F.lit(3))), x,
        F.concat(F.left(m, F.lit(8)), F.lit("-"), F.substring(m, 9, F.lit(4)), F.lit("-"), F.substring(m, 13, F.lit(4)), F.lit("-"), F.substring(m, 17, F.lit(12)))]
    other = [
        s, m, x, F.concat(F.left(m, F.lit(8)), F.lit("-"), F.substring(m, 9, F.lit(4)), F.lit("-"), F.substring(m, 13, F.lit(4)), F.lit("-"), F.substring(m, 17, F.lit(12))),
        F.concat(w[0], F.initcap(w[1]), F.initcap(w[2]), F.left(number, F.lit(2))), F.concat_ws("_", w[0], w[1], w[2], F.left(number, F.lit(1))),
        F.concat_ws("/", F.lit(""), w[0], w[1], F.concat(w[2], F.left(number, F.lit(1)), pick([".py", ".html", ".js", ".txt"], 14))),
        F.concat(w[0], F.lit("."), F.left(number, F.lit(2)), F.lit("@"), w[1], F.left(number, F.lit(1)), F.lit("."), w[2], F.lit("."), pick(["com", "org", "de", "fr"], 15)),
        F.concat(F.lit("20"), F.left(number, F.lit(2)), F.lit("-0"), F.substring(number, 3, F.lit(1)), F.lit("-1"), F.substring(number, 4, F.lit(1)), F.lit("T1"), F.substring(number, 5, F.lit(1))),
        F.concat(w[0], F.lit("-"), F.left(number, F.lit(1)), F.lit("."), F.substring(number, 2, F.lit(1)), F.lit("."), F.substring(number, 3, F.lit(2)), pick(["-beta1", ".tar", "rc2", ""], 16)),
        F.concat(w[0], w[1], w[2], w[3]), F.concat(F.upper(F.left(w[0], F.lit(3))), F.lit("-"), F.left(number, F.lit(6))),
        F.concat(F.left(w[1], F.lit(1)), F.expr("repeat(left(w0, 1 + pmod(xxhash64(id, 3), 2)), 20 + pmod(xxhash64(id, 4), 200))")), F.expr("repeat(b, 4 + pmod(xxhash64(id, 4), 12))"),
        F.concat(F.upper(w[0]), F.lit("-20"), F.left(number, F.lit(6)), pick([".", "-"], 17), pick(["csv", "pdf", "png", "log", "zip"], 18)), F.concat(F.upper(F.left(w[0], F.lit(2))), F.left(number, F.lit(8)), pick(["", "B", "/2", ".3"], 19)),
        # ordinary words with signs behind them, at a sentence's begin or end, and addresses
        F.concat(F.initcap(F.concat(w[0], w[1])), pick(["", ".", ",", "!"], 30), F.repeat(pick(["#", "$", "%", "&", "*", "!", "?", "="], 31), F.lit(3))),
        F.concat(w[0], pick(["", ".", ",", ".)", "?"], 32), F.repeat(pick(["#", "$", "%", "&", "*", "-", "+", "~"], 33), F.lit(2) + F.pmod(F.xxhash64("id", F.lit(7)), F.lit(5)).cast("int"))),
        F.concat(F.initcap(F.concat(w[0], w[1], w[2])), F.repeat(pick(["#", "$", "%", "&", "*"], 34), F.lit(3))),
        F.concat(pick(["", "Mr", "Info"], 35), w[0], pick([".", "_", "-", ""], 36), F.left(number, F.lit(2)), F.lit("@"), pick(["mail", "web", "mx", "post"], 37), F.substring(number, 3, F.lit(1)), F.lit("."), w[1], pick([".com", ".org", ".net", ".co"], 38))]
    made = F.get(F.array(*secret, *other), F.col("kind"))
    named = F.concat(pick(["token", "secret", "password", "api_key", "API key", "passwd", "auth_token", "client secret", "access key", "credentials", "private key", "bearer", "pwd", "connection password"], 21),
                     pick([" = \"", ": ", "=", " is ", ": '", " = '", " -> "], 22))
    told = F.concat(pick(["commit ", "sha1 ", "md5: ", "checksum = \"", "digest ", "etag: \"", "request id ", "revision ", "build ", "hash = ", "uuid: ", "blob "], 23), F.lit(""))
    loose = pick([" ", " see ", " (", "in ", ": ", " \"", ", ", "from ", "is ", "is.\n", "is%%% ", "was ", "are. ", "of ", "is. "], 24)
    chance = F.pmod(F.xxhash64("id", F.lit(6)), F.lit(100))
    lead = F.concat(w[2], F.lit(" "), w[3], F.lit(" "))
    digest = F.col("kind").between(12, 15)
    formed = F.col("kind").between(2, 5)  # kinds whose form alone gives them away
    before = F.concat(lead, F.when(F.col("kind") < 12, F.when(formed & (chance < 50), loose).otherwise(named)).when(digest, told).when(chance < 30, told).otherwise(loose))
    after = F.when(before.rlike("\"$"), F.concat(F.lit("\" "), w[1])).when(before.rlike("'$"), F.concat(F.lit("' "), w[1])).otherwise(F.concat(pick([" ", "\n", ", ", "; ", ". "], 25), w[0], F.lit(" "), w[3]))
    path = F.concat(pick(["src", "web", "config", "notes", "mail", "docs", "tests"], 26), F.lit("/"), w[1])
    label = (F.col("kind") < 12).cast("double")
    return rows.select(path.alias("path"), made.alias("candidate"), F.right(before, F.lit(p.context)).alias("before"), after.alias("after"), label.alias("label"), "kind")


def _least_order():
    from pyspark.sql import Window
    return Window.orderBy("word")  # over the bounded dictionary


@dataclass
class Scanner:
    """The forest, and the table that it looks parts of candidates up in."""

    forest: RandomForestClassificationModel
    learnt: DataFrame


def train(findings: DataFrame, words: DataFrame, p: Forest = Forest()) -> Scanner:
    """The scanner from findings with ``path, candidate, before, after, label``, and the corpus's words."""
    # of the findings that give words their odds, none trains the forest
    half = F.pmod(F.xxhash64("candidate"), F.lit(2)) == 0
    learnt = written(dictionary(words, p).union(evidence(findings.where(half))), "learnt")
    rows = with_features(findings.where(~half).select(*OWN, "label"), learnt)
    rows = VectorAssembler(inputCols=[*SHAPE, *LEARNT], outputCol="features").transform(rows).select("features", "label").coalesce(1).sortWithinPartitions("label", F.hash(vector_to_array("features")))
    forest = RandomForestClassifier(numTrees=p.trees, maxDepth=p.depth, seed=p.seed, subsamplingRate=0.8, featureSubsetStrategy="onethird").fit(rows)
    return Scanner(forest, learnt)


def judge(found: DataFrame, scanner: Scanner, p: Forest = Forest()) -> DataFrame:
    """``found`` with ``score`` and ``is_secret``."""
    rows = VectorAssembler(inputCols=[*SHAPE, *LEARNT], outputCol="features").transform(with_features(found, scanner.learnt))
    return scanner.forest.transform(rows).select(*found.columns, vector_to_array("probability")[1].alias("score")).withColumn("is_secret", F.col("score") >= p.least_score)


def scan(docs: DataFrame, p: Forest = Forest(), labelled: DataFrame | None = None) -> DataFrame:
    """Every candidate of ``docs``: doc_id, t1, t2, path, nth, candidate, before, after, score, is_secret.

    ``docs`` needs ``doc_id`` and ``text`` and uses ``source`` as the path where
    there is one; other columns are not read. ``nth`` counts the text's candidates
    from 0, t1 and t2 are hashes of the text. Null and empty texts have no
    candidates; repeated rows give theirs each, rows without doc_id theirs too.
    Texts of any length are read whole. ``labelled`` findings (``path, candidate,
    before, after, label``) replace those that are generated.
    """
    found = written(candidates(docs, p), "findings")
    words = written(corpus_words(docs, p), "words")
    if labelled is None:
        labelled = written(generated_findings(words, p), "labelled")
    return judge(found, train(labelled, words, p), p)


def masked(docs: DataFrame, p: Forest = Forest()) -> DataFrame:
    """``docs`` with every secret in ``text`` replaced by a mask; other columns as they are.

    A row is known by its text and path, not by its doc_id, which may be null or
    repeated: rows of one text and path come out alike. Columns may have any names.
    """
    path = F.coalesce(F.col("source").cast("string"), F.lit("")) if "source" in docs.columns else F.lit("")
    secrets = scan(docs, p).where("is_secret").groupBy("t1", "t2", "path").agg(F.collect_set("nth").alias("places"))
    rows = docs.select(F.struct(*own_columns(docs)).alias("row"), F.xxhash64("text").alias("t1"), F.xxhash64(F.lit(1), "text").alias("t2"), path.alias("path"))
    cut = F.when(F.col("places").isNotNull(), F.struct(F.regexp_extract_all("row.text", F.lit(RUN), F.lit(0)).alias("runs"), F.split("row.text", RUN, -1).alias("rest")))
    joined = rows.join(secrets, ["t1", "t2", "path"], "left").select("row", "places", F.explode(F.array(cut)).alias("cut"))
    pieces = F.transform(F.col("cut.runs"), lambda run, i: F.concat(F.get("cut.rest", i), F.when(F.array_contains("places", i), MASK).otherwise(run)))
    text = F.when(F.col("places").isNull(), F.col("row.text")).otherwise(F.concat(F.array_join(pieces, ""), F.element_at("cut.rest", -1)))
    return joined.select(*[text.alias("text") if c == "text" else F.col("row")[c].alias(c) for c in docs.columns])


def op5_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All findings; the candidate itself is given as its digest."""
    return scan(read(spark, sf_dir, "documents")).select(
        "doc_id", "nth", F.sha2("candidate", 256).alias("candidate_sha256"), F.length("candidate").alias("length"), "score", "is_secret")
