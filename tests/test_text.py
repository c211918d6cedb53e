import random

import pytest
from porter_words import stem_word
from pyspark.sql import functions as F

from siftrank.functions import text as T
from siftrank.functions.lengths import quantised_length
from siftrank.functions.stems import with_stems
from siftrank.operators import analyze as A
from siftrank.sources.tables import load_by


def column(spark, expr, value, type="string"):
    return spark.createDataFrame([(value,)], f"v {type}").select(expr(F.col("v")).alias("o")).first().o


@pytest.mark.parametrize(
    "text, tokens",
    [
        ("U.S.-based co-op's 3rd", ["u", "s", "based", "co", "op", "s", "rd"]),
        ("", []),
        ("éÀ\nß", ["éà", "ß"]),
        ("a" * 300, ["a" * 255, "a" * 45]),
    ],
)
def test_letter_tokens(spark, text, tokens):
    assert column(spark, T.letter_tokens, text) == tokens


def test_whitespace_tokens(spark):
    assert column(spark, T.whitespace_tokens, "  U.S. co-op \n x") == ["U.S.", "co-op", "x"]


def test_stop_words_come_out_before_positions(spark):
    df = spark.createDataFrame([(1, "The information in the hill")], "doc_id long, text string")
    chain = A.Analyzer(stop_words=["the", "information", "in"])
    assert [tuple(r) for r in A.analyze(df, analyzer=chain).collect()] == [(1, 0, "hill")]


def test_cap_counts_tokens_after_stop_words(spark):
    df = spark.createDataFrame([(1, "the a the b the c")], "doc_id long, text string")
    chain = A.Analyzer(stop_words=["the"], max_tokens=2)
    assert [r.term for r in A.analyze(df, analyzer=chain).orderBy("pos").collect()] == ["a", "b"]


def test_offsets_point_into_the_text(spark):
    text = "  Red, fox's\nden"
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    rows = A.token_offsets(df).orderBy("pos").collect()
    assert [r.term for r in rows] == ["red", "fox", "s", "den"]
    assert [text[r.start : r.end].lower() for r in rows] == [r.term for r in rows]


# Published pairs of the algorithm's paper.
PORTER = {
    "caresses": "caress", "ponies": "poni", "ties": "ti", "cats": "cat", "feed": "feed",
    "agreed": "agre", "plastered": "plaster", "bled": "bled", "motoring": "motor", "sing": "sing",
    "conflated": "conflat", "troubled": "troubl", "sized": "size", "hopping": "hop", "tanned": "tan",
    "falling": "fall", "hissing": "hiss", "fizzed": "fizz", "failing": "fail", "filing": "file",
    "happy": "happi", "sky": "sky", "relational": "relat", "conditional": "condit",
    "rational": "ration", "valenci": "valenc", "digitizer": "digit", "radicalli": "radic",
    "differentli": "differ", "vileli": "vile", "analogousli": "analog", "vietnamization": "vietnam",
    "predication": "predic", "operator": "oper", "feudalism": "feudal", "decisiveness": "decis",
    "hopefulness": "hope", "callousness": "callous", "formaliti": "formal", "sensitiviti": "sensit",
    "sensibiliti": "sensibl", "triplicate": "triplic", "formative": "form", "formalize": "formal",
    "electriciti": "electr", "electrical": "electr", "hopeful": "hope", "goodness": "good",
    "revival": "reviv", "allowance": "allow", "inference": "infer", "airliner": "airlin",
    "adjustable": "adjust", "defensible": "defens", "irritant": "irrit", "replacement": "replac",
    "adjustment": "adjust", "dependent": "depend", "adoption": "adopt", "communism": "commun",
    "activate": "activ", "homologous": "homolog", "effective": "effect", "bowdlerize": "bowdler",
    "probate": "probat", "rate": "rate", "cease": "ceas", "controll": "control", "roll": "roll",
    "is": "is", "possibly": "possibl", "apology": "apolog",
}


def test_porter_pairs():
    assert {w: stem_word(w) for w in PORTER} == PORTER


def test_stemming_a_column(spark):
    rng = random.Random(1)
    ends = ["ational", "ed", "ing", "eed", "iviti", "ousness", "ement", "ion", "ll", "y", "ies", "sses", "yy", "e", ""]
    words = ["".join(rng.choice("aeioyylstbdngr") for _ in range(rng.randint(1, 6))) + rng.choice(ends) for _ in range(3000)]
    words += [*PORTER, "yyy", "é", "sky", None]
    df = spark.createDataFrame([(w,) for w in words], "t string")
    got = with_stems(df, "t", "s").collect()
    assert len(got) == len(words) and all(r.s == (stem_word(r.t) if r.t else r.t) for r in got)


def test_stemmed_postings_keep_no_array_beside_tokens(spark):
    from siftrank.operators.index import build_index

    docs = spark.createDataFrame([(1, "ponies pony cats"), (2, ""), (3, "cat")], "doc_id long, text string")
    index = build_index(docs, analyzer=A.Analyzer(stem=True))
    assert {(r.term, r.doc_id): (r.tf, r.dl) for r in index.postings.collect()} == {
        ("poni", 1): (2, 3), ("cat", 1): (1, 3), ("cat", 3): (1, 1)
    }
    plan = index.postings._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan
    generates = [line for line in plan.splitlines() if "Generate posexplode" in line]
    assert generates and all("[doc_id" in line and "tokens#" not in line.split("), [", 1)[-1] for line in generates)


def test_long_stop_lists_number_the_tokens_kept(spark):
    docs = spark.createDataFrame([(1, "a b c d e")], "doc_id long, text string")
    stop = [f"x{k}" for k in range(10_000)] + ["b", "d"]
    short = A.analyze(docs, analyzer=A.Analyzer(stop_words=stop)).collect()
    table = spark.createDataFrame([(w,) for w in stop], "term string")
    long = A.remove_stop_words(A.analyze(docs), table).select("doc_id", "pos", "term").orderBy("pos").collect()
    assert [tuple(r) for r in short] == [tuple(r) for r in long] == [(1, 0, "a"), (1, 1, "c"), (1, 2, "e")]


def test_quantised_lengths(spark):
    want = {0: 0, 1: 1, 5: 5, 9: 8, 11: 10, 100: 96, 127: 112, 10000: 8192}
    df = spark.createDataFrame([(n,) for n in want], "n long")
    got = {r.n: r.q for r in df.select("n", quantised_length(F.col("n")).alias("q")).collect()}
    assert got == want


def test_partitions_follow_the_text(spark, tmp_path):
    """They used to be merged by their size as text, however many rows a task then made of them."""
    rows = [(i, "word " * 20) for i in range(1000)] + [(None, "x"), (7, None), (7, "again")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    dealt = load_by(spark, str(tmp_path), "documents", "doc_id", part=5_000)
    assert dealt.rdd.getNumPartitions() == 21  # 100,006 bytes
    assert sorted(map(str, dealt.collect())) == sorted(map(str, spark.createDataFrame(rows, dealt.schema).collect()))
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/none.parquet")
    assert load_by(spark, str(tmp_path), "none", "doc_id").count() == 0


def test_tokens_are_not_shuffled_for_a_stop_list(spark):
    """A list of unknown size used to plan a shuffle of all tokens by term, and another back by document."""
    tokens = spark.createDataFrame([(d, p, t) for d in (1, 2) for p, t in enumerate("a the b the c".split())], "doc_id long, pos int, term string")
    kept = A.remove_stop_words(tokens, spark.createDataFrame([("the",), ("the",), (None,)], "term string"))
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    assert sorted((r.doc_id, r.pos, r.term) for r in kept.collect()) == [(d, p, t) for d in (1, 2) for p, t in enumerate("abc")]
