import gzip

import pytest

from siftrank.sources import files, sinks


def test_trec_documents_in_folders(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    docs = [f"<DOC>\n<DOCNO> FB-{i} </DOCNO>\n<TEXT>\nbody {i}\n</TEXT>\n</DOC>\n" for i in range(1, 50)]
    (tmp_path / "a.txt").write_text("".join(docs[:30]))
    with gzip.open(tmp_path / "sub" / "b.gz", "wt") as out:
        out.write("".join(docs[30:]))
    rows = {r.doc_id: r.raw for r in files.read_documents(spark, str(tmp_path)).collect()}
    assert len(rows) == 49
    assert rows["FB-49"] == "<TEXT>\nbody 49\n</TEXT>\n"


def test_topics(spark, tmp_path):
    top = "<top>\n\n<num> Number: {n}\n<title> {t}\n\n<desc> Description:\nWhat is\nasked?\n\n<narr> Narrative:\nMore.\n\n</top>\n"
    (tmp_path / "t").write_text(top.format(n=450, t="King Hussein, peace") + top.format(n="401a", t="Hubble") + top.format(n=1000, t="x"))
    rows = files.read_topics(spark, str(tmp_path / "t")).collect()
    assert [(r.topic_id, r.title, r.description) for r in rows] == [
        ("450", "King Hussein, peace", "What is\nasked?"), ("1000", "x", "What is\nasked?"), ("401a", "Hubble", "What is\nasked?"),
    ]


def test_judgements_last_line_wins(spark, tmp_path):
    (tmp_path / "q").write_text("# c\n1 0 d1 1\n\n1 0 d2 0\n1\t0\tD1  0\n1 0 d3 2\n")
    rows = {(r.topic_id, r.doc_id): r.relevant for r in files.read_judgements(spark, str(tmp_path / "q")).collect()}
    assert rows == {("1", "D1"): False, ("1", "D2"): False, ("1", "D3"): True}


def test_runs(spark, tmp_path):
    run = spark.createDataFrame([(1, "d1", 1, 0.5), (1, "d2", 2, 0.25)], "topic_id long, doc_id string, rank int, score double")
    sinks.write_run(run, str(tmp_path / "r"), compression="gzip")
    assert [r.value for r in spark.read.text(str(tmp_path / "r")).collect()] == ["1\tQ0\td1\t0\t0.5\ttest", "1\tQ0\td2\t1\t0.25\ttest"]
    back = files.read_run(spark, str(tmp_path / "r"), depth=1).collect()
    assert [(r.topic_id, r.doc_id, r["rank"], r.score) for r in back] == [("1", "d1", 1, 0.5)]
    assert files.read_run(spark, str(tmp_path / "r")).count() == 2
    line = sinks.report_lines(run, "name").first().value
    assert line == "1 \t Q0 \t d1" + " " * 18 + " \t 0" + " " * 6 + " \t 0.5000 \t name"


def test_ratings(spark, tmp_path):
    from siftrank.operators.recommend import latest_ratings

    (tmp_path / "u.data").write_text("1\t2\t3\t881250949\n1\t2\t5\t881250950\n2\t2\t4\n")
    rows = {(r.user_id, r.item_id): r.rating for r in latest_ratings(files.read_ratings(spark, str(tmp_path / "u.data"))).collect()}
    assert rows == {(1, 2): 5.0, (2, 2): 4.0}


def test_stop_list_file(spark, tmp_path):
    (tmp_path / "s").write_text("The\n\nof\n")
    assert {r.term for r in files.read_stop_words(spark, str(tmp_path / "s")).collect()} == {"the", "of"}
