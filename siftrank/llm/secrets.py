"""Secret scan: candidate strings, sorted by a random forest into secrets and others.

A candidate is a run of key characters that holds a digit or mixes cases, and is 16 or more
long or, at any length, what a name is set to. A word gives all of its runs. A candidate's
features are its length, how often the kind of character changes from one to the next and
how usual its pairs of characters are in the corpus's words, the share of it that dictionary
words cover (words that the corpus uses often), what stands before it in its own word, and
how often findings labelled as secrets had the same neighbouring words and the same path
(``source``). The forest is trained from labelled findings, so it learns which
candidates are false positives; rates are smoothed, and taken without the row's own label.

Column expressions and Spark's own forest only. Words are looked at once, right where they
are exploded; what goes on is the few candidates. Dictionary and pair counts come from all
documents, with map-side sums. Training uses at most ``TRAINING`` labelled findings, the
first by hash.

Null and empty texts have no candidates. Repeated rows give repeated findings. Without labels
of both kinds nothing can be learnt: scores are null and no finding is called a secret. Empty
tables give empty results.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

from siftrank.llm.common import stored, table, text_of

TRAINING = 20_000
TREES, DEPTH, SEED = 24, 8, 42
DICTIONARY_USES = 50
SMOOTHING = 4.0

_KEY = "[A-Za-z0-9_+/-]"
#: ``=`` is padding only where no key character follows.
_PADDING = r"(?:={1,2}(?![A-Za-z0-9_+/=-]))?"
#: A name and an assignment sign, right before a run of any length.
_SET = r"(?<=[A-Za-z_][0-9]{0,3}[\"'`)\]]?[:=][:=>]?[\"'`]?)"
#: The start of a word, for words that follow an assignment sign.
_FIRST = r"(?<=^[\"'`]?)"
_ASSIGNMENT = r"[:=]>?$"


def _runs(set_by: str) -> Column:
    """All runs of ``word`` in order, each with the ``gap`` since the one before."""
    run = rf"{_KEY}{{16,}}+{_PADDING}|{set_by}(?!//){_KEY}++{_PADDING}"
    pattern = F.lit(rf"(?s)\G(.*?)({run})")  # \G: what follows the last run is looked at once
    return F.arrays_zip(
        F.regexp_extract_all("word", pattern, F.lit(1)).alias("gap"),
        F.regexp_extract_all("word", pattern, F.lit(2)).alias("run"),
    )


FEATURES = [
    "length", "digits", "uppers", "hexes", "switches", "pair_rate", "coverage", "assigned", "quoted", "before_rate", "after_rate", "path_rate",
]


def _words(docs: DataFrame) -> DataFrame:
    """Every word with its place and its two neighbours."""
    parts = F.split(F.trim(text_of()), r"\s+")
    rows = docs.select("doc_id", F.coalesce(F.col("source").cast("string"), F.lit("")).alias("path"), parts.alias("words"))
    placed = rows.select("doc_id", "path", "words", F.posexplode("words").alias("pos", "word"))
    around = {"two_before": -2, "before": -1, "after": 1}
    return placed.select(
        "doc_id", "path", "pos", "word",
        *[F.when(F.col("pos") + k >= 0, F.get("words", F.col("pos") + k)).alias(name) for name, k in around.items()],
    )


def candidates(docs: DataFrame) -> DataFrame:
    """Candidates with their place, what leads up to them and the words around."""
    follows = F.coalesce(F.col("before").rlike(_ASSIGNMENT), F.lit(False))
    short = follows | F.col("word").rlike("[:=]")
    held = _words(docs).where((F.length("word") >= 16) | short)
    runs = F.when(follows, _runs(f"(?:{_SET}|{_FIRST})")).otherwise(_runs(_SET))
    found = held.withColumn("runs", runs).select("*", F.posexplode("runs").alias("place", "r"))
    last = F.when(F.col("place") > 0, F.get("runs", F.col("place") - 1)["run"]).otherwise("")
    found = found.withColumn("finding", F.col("r.run")).withColumn("lead", F.lower(F.concat(last, F.col("r.gap"))))
    mixed = F.col("finding").rlike("[0-9]") | F.col("finding").rlike("[a-z].*[A-Z]")
    return found.where(mixed).drop("runs", "r")


def dictionary(docs: DataFrame, uses: int = DICTIONARY_USES) -> DataFrame:
    """Words of 4 to 12 letters that occur ``uses`` times or more, with their count."""
    word = F.lower(F.regexp_extract("word", r"^\W*([A-Za-z]{4,12})\W*$", 1)).alias("entry")
    return _words(docs).select(word).where("entry <> ''").groupBy("entry").agg(F.count("*").alias("n")).where(F.col("n") >= uses)


def _pieces(text: Column, size: Column) -> Column:
    starts = F.sequence(F.lit(1), F.greatest(F.length(text) - size + 1, F.lit(1)))
    return F.transform(starts, lambda at: F.struct(at.alias("at"), F.substr(text, at, size).alias("piece")))


def with_features(found: DataFrame, words: DataFrame) -> DataFrame:
    """What a candidate says of itself; the rates of neighbours and paths come later."""
    text = F.col("finding")
    length = F.length(text)
    pairs = words.select("n", F.explode(_pieces(F.col("entry"), F.lit(2))).alias("p")).groupBy(F.col("p.piece").alias("piece")).agg(F.sum("n").alias("n"))
    most = pairs.agg(F.sum("n")).first()[0] or 1  # one number
    pairs = pairs.select("piece", F.log(F.col("n") / F.lit(float(most))).alias("rate"))
    own = found.select("finding").distinct()
    lower = F.lower(text)
    each = own.select("finding", F.explode(_pieces(lower, F.lit(2))).alias("p")).select("finding", "p.piece")
    usual = each.join(pairs, "piece", "left").groupBy("finding").agg(F.avg(F.coalesce("rate", F.lit(-20.0))).alias("pair_rate"))
    sized = own.select("finding", F.explode(F.sequence(F.lit(4), F.lit(12))).alias("size"))
    every = sized.where(F.col("size") <= length).select("finding", "size", F.explode(_pieces(lower, F.col("size"))).alias("p"))
    held = every.select("finding", "size", "p.at", F.col("p.piece").alias("entry")).join(words.select("entry"), "entry", "left_semi")
    covered = (
        held.select("finding", F.explode(F.sequence("at", F.col("at") + F.col("size") - 1)).alias("place"))
        .distinct().groupBy("finding").agg(F.count("*").alias("covered"))
    )
    kinds = F.regexp_replace(F.regexp_replace(F.regexp_replace(text, "[a-z]", "l"), "[A-Z]", "U"), "[0-9]", "9")
    kinds = F.regexp_replace(kinds, "[^lU9]", "s")
    measured = own.select(
        "finding",
        length.cast("double").alias("length"),
        (F.regexp_count(text, F.lit("[0-9]")) / length).alias("digits"),
        (F.regexp_count(text, F.lit("[A-Z]")) / length).alias("uppers"),
        (F.regexp_count(text, F.lit("[0-9a-f]")) / length).alias("hexes"),
        (F.regexp_count(kinds, F.lit("(?=l[^l]|U[^U]|9[^9]|s[^s])")) / length).alias("switches"),
    )
    measured = measured.join(usual, "finding").join(covered, "finding", "left").withColumn(
        "coverage", F.coalesce(F.col("covered") / F.col("length"), F.lit(0.0))
    ).drop("covered")
    return found.join(measured, "finding").withColumns({
        "assigned": (F.col("lead").rlike("[=:]") | F.coalesce("before", F.lit("")).isin("=", ":", "==", ":=")).cast("double"),
        "quoted": F.col("lead").rlike("[\"'`]$").cast("double"),
        "cue": F.when(F.col("lead").rlike("[a-z]"), F.regexp_extract("lead", r"([a-z_]+)[^a-z_]*$", 1))
        .when(F.coalesce("before", F.lit("")).isin("=", ":", "==", ":="), F.lower("two_before"))
        .otherwise(F.lower("before")),
        "after": F.lower("after"),
    })


def _with_rate(rows: DataFrame, labelled: DataFrame, by: str, name: str, base: float) -> DataFrame:
    """The smoothed share of secrets among labelled findings alike in ``by``.

    A labelled row does not count itself.
    """
    seen = labelled.groupBy(F.coalesce(by, F.lit("")).alias("_by")).agg(F.count("*").alias("_n"), F.sum("label").alias("_k"))
    own = F.coalesce("label", F.lit(0.0))
    n = F.greatest(F.coalesce("_n", F.lit(0)) - F.col("label").isNotNull().cast("int"), F.lit(0))
    k = F.greatest(F.coalesce("_k", F.lit(0.0)) - own, F.lit(0.0))
    return (
        rows.withColumn("_by", F.coalesce(by, F.lit(""))).join(seen, "_by", "left")
        .withColumn(name, (k + SMOOTHING * base) / (n + SMOOTHING)).drop("_by", "_n", "_k")
    )


def scan(docs: DataFrame, label: Column) -> DataFrame:
    """Every candidate with the forest's ``score`` and verdict ``is_secret``.

    ``label`` is 1.0 or 0.0 where a finding is labelled, else null; it may use the columns
    ``finding``, ``lead``, ``before``, ``two_before``, ``after`` and ``path``.
    """
    words = stored(dictionary(docs), "dictionary")
    rows = stored(with_features(stored(candidates(docs), "candidates"), words).withColumn("label", label.cast("double")), "findings")
    order = F.xxhash64("finding", "doc_id", "pos")
    labelled = stored(rows.where(F.col("label").isNotNull()).orderBy(order, "finding", "doc_id", "pos", "place").limit(TRAINING), "labelled")
    known = labelled.agg(F.avg("label"), F.countDistinct("label")).first()
    base = known[0] or 0.0
    for by, name in (("cue", "before_rate"), ("after", "after_rate"), ("path", "path_rate")):
        rows = _with_rate(rows, labelled, by, name, base)
        labelled = _with_rate(labelled, labelled.select(by, "label"), by, name, base)
    out = ["doc_id", "pos", F.sha2(F.col("finding").cast("binary"), 256).alias("finding_sha256"), F.length("finding").cast("long").alias("length"), "label"]
    if known[1] < 2:
        return rows.select(*out, F.lit(None).cast("double").alias("score"), F.lit(False).alias("is_secret"))
    vector = VectorAssembler(inputCols=FEATURES, outputCol="features")
    forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=SEED, labelCol="label", featuresCol="features")
    trained = stored(labelled.select("label", *FEATURES).orderBy("label", *FEATURES).coalesce(1), "training")
    model = forest.fit(vector.transform(trained))
    scored = model.transform(vector.transform(rows)).withColumn("score", vector_to_array("probability")[1])
    return scored.select(*out, "score", (F.col("score") >= 0.5).alias("is_secret"))


def format_label() -> Column:
    """Labels from strict formats, for tables without labelled findings.

    Secrets: keys with a fixed beginning and length, and hexadecimal or mixed values that a
    word for a secret is set to. Not secrets: numbers, and letters only.
    """
    value, lead = F.col("finding"), F.col("lead")
    said = F.concat_ws(" ", F.coalesce("two_before", F.lit("")), F.coalesce("before", F.lit("")), lead)
    named = F.lower(said).rlike(r"(password|passwd|secret|token|api_?key|access_?key)\W*$")
    keyed = value.rlike("^(AKIA|ASIA)[A-Z0-9]{16}$") | value.rlike("^gh[pousr]_[A-Za-z0-9]{36}$") | value.rlike("^sk-[A-Za-z0-9]{20,}$")
    return F.when(keyed | (named & value.rlike("[0-9]") & value.rlike("[A-Za-z]")), 1.0).when(
        value.rlike("^[0-9_-]+$") | value.rlike("^[A-Za-z_/-]+$"), 0.0
    )


def query(spark, folder: str) -> DataFrame:
    """``op9``: every candidate of the documents, scored."""
    return scan(table(spark, folder, "documents"), format_label())
