"""What a task leaves behind in its worker, and texts that are long in one way or another."""

import os
import random

import psutil

from siftrank.llm import decontaminate, pieces, quality, sanitise, simhash
from siftrank.llm.common import by_batch


def held(spark):
    """The largest resident memory of the workers of two tasks, in bytes."""
    def measured(batch):
        import pyarrow as pa

        return pa.RecordBatch.from_arrays([pa.array([os.getpid()]), pa.array([psutil.Process().memory_info().rss])], names=["pid", "rss"])

    return max(r["rss"] for r in by_batch(spark.range(2).repartition(2), measured, "pid long, rss long").collect())


def test_encoding_leaves_little_in_a_worker(spark):
    rng = random.Random(1)
    words = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(3, 11))) for _ in range(200_000)]
    rows = [(i, " ".join(words[i::200])) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    pieces.decode(pieces.encode(docs.limit(2), pieces.read_model()), pieces.read_model()).count()
    before = held(spark)
    encoded = pieces.encode(docs, pieces.read_model()).selectExpr("sum(n_ids)", "min(exact)").first()
    assert encoded[0] > 400_000 and encoded[1]
    assert held(spark) - before < 30 << 20


def test_what_is_remembered_is_bounded(monkeypatch):
    machine = pieces.compiled(pieces.read_model())
    words = [f"w{i}x" for i in range(3000)]
    want = machine.encode(" ".join(words + words)).tolist()
    monkeypatch.setattr(pieces, "REMEMBERED", 50)
    monkeypatch.setattr(pieces, "REMEMBERED_BYTES", 1000)
    machine = pieces.compiled(pieces.read_model())
    assert machine.encode(" ".join(words + words)).tolist() == want
    assert len(machine.known) <= 50 and len(machine.older) <= 50


def test_addresses_with_very_many_digits():
    zeros, nines = "0" * 5000 + ".1.1.1", "9" * 5000 + ".1.1.1"
    assert sanitise.base_spans(zeros) == [("ip", 0, 5006)] and sanitise.base_spans(nines) == []
    assert sanitise.base_spans("1.2.3." + "0" * 6000) == [("ip", 0, 6006)]
    assert sanitise.base_spans("256.1.1.1 0255.000.1.01") == [("ip", 10, 23)]


def test_very_long_texts_through_the_stages(spark):
    rng = random.Random(2)
    long = " ".join(f"Word{rng.randint(0, 40_000)}." for _ in range(120_000))
    rows = [
        (1, long, "en", "a", 0), (2, "x" * 2_000_000, "en", "a", 0), (3, "0" * 6000 + ".1.1.1 " + "1-" * 400_000, "en", "a", 0),
        (4, long, "en", "b", 0), (5, "\n" * 1_000_000, None, None, 0),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    items = spark.createDataFrame([("i", long[5000:5200]), ("j", "x" * 300_000)], "item_id string, text string")
    stats = {r["row"]["doc_id"]: r["n_words"] for r in quality.judge(docs).collect()}
    assert stats == {1: 120_000, 2: 1, 3: 2, 4: 120_000, 5: 0}
    prints = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(docs).collect()}
    assert prints[4] == 1 and prints[5] == 5
    hit = {r["doc_id"]: r["n_hit"] for r in decontaminate.report(docs, items).collect()}
    assert hit[1] == hit[4] >= 10 and hit[2] == hit[5] == 0
    assert {r["doc_id"]: r["n_ip"] for r in sanitise.report(docs).collect()} == {1: 0, 2: 0, 3: 1, 4: 0, 5: 0}
    encoded = {r["doc_id"]: r for r in pieces.encode(docs, pieces.read_model()).collect()}
    assert all(r["exact"] for r in encoded.values()) and encoded[1]["ids"] == encoded[4]["ids"]


def test_parts_join_to_the_text_and_their_pieces_to_the_library_s():
    import sentencepiece

    rng = random.Random(7)
    machine, library = pieces.compiled(pieces.read_model()), sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    for size in [*range(60)] * 20 + [5000]:
        text = "".join(rng.choice("abcdeXY12²½.,_-()é漢字हिßЖ  \n\t\r😀") for _ in range(size))
        assert "".join(machine.parts.findall(text)) == text
        assert machine.encode(text).tolist() == library.encode(text)
