"""The training-data operators against brute-force versions on the smallest tables."""

import hashlib
import html
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from compare import difference

import corpus_pipeline
from siftrank.llm import decontaminate, pages, pieces, quality, repeats, sanitise, secrets, sharding, simhash, toxicity
from siftrank.llm.components import components
from siftrank.llm.suffixes import repeated_starts, suffix_array

FOLDER = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def documents():
    rows = duckdb.sql(f"SELECT doc_id, text, lang, source FROM '{FOLDER}/documents.parquet' ORDER BY doc_id").fetchall()
    return rows


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


# op1


def brute_repeats(texts, length):
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[k : k + length] for d in data for k in range(len(d) - length + 1))
    made = []
    for d in data:
        covered = [False] * len(d)
        for k in range(len(d) - length + 1):
            if seen[d[k : k + length]] > 1:
                covered[k : k + length] = [True] * length
        spans = sum(c and not (k and covered[k - 1]) for k, c in enumerate(covered))
        left = bytes(b for b, c in zip(d, covered) if not c)
        made.append((len(d), sum(covered), spans, hashlib.sha256(left).hexdigest()))
    return made


@pytest.mark.parametrize("crowded", [repeats.CROWDED, 2])
def test_repeats_of_documents(spark, documents, monkeypatch, crowded):
    monkeypatch.setattr(repeats, "CROWDED", crowded)
    got = {r[0]: tuple(r[1:]) for r in repeats.query(spark, FOLDER).collect()}
    want = brute_repeats([r[1] for r in documents], 200)
    assert got == {r[0]: w for r, w in zip(documents, want)}


def test_repeats_of_odd_texts(spark):
    texts = ["ab" * 60, "xyab" * 20, None, "", "é" * 90, "é" * 25, "q" * 40, "same text of forty bytes and a few more!", "same text of forty bytes and a few more!"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r[0]: tuple(r[1:]) for r in repeats.report(df, 40).collect()}
    assert got == dict(enumerate(brute_repeats(texts, 40)))


def test_suffix_array_and_repeats_against_sorting():
    rng = np.random.default_rng(1)
    for _ in range(200):
        text = rng.integers(0, rng.integers(2, 5), rng.integers(1, 70)).astype(np.int16)
        as_list, length = text.tolist(), int(rng.integers(1, 6))
        assert suffix_array(text).tolist() == sorted(range(len(text)), key=lambda i: as_list[i:])
        runs = Counter(tuple(as_list[i : i + length]) for i in range(len(text) - length + 1))
        want = [
            i + length <= len(text) and 0 not in as_list[i : i + length] and runs[tuple(as_list[i : i + length])] > 1
            for i in range(len(text))
        ]
        assert repeated_starts(text, length).tolist() == want


def test_every_string_has_one_anchor_given_by_its_bytes():
    rng = random.Random(3)
    data = bytes(rng.choice(b"ab") for _ in range(900))
    hashes, first, last = repeats.anchors(data, 60)
    by_string = {}
    for h, a, b in zip(hashes, first, last):
        for k in range(a, b + 1):
            assert by_string.setdefault(data[k : k + 60], h) == h
    assert (first[1:] == last[:-1] + 1).all() and first[0] == 0 and last[-1] == len(data) - 60


# op2


def brute_components(prints, ids):
    parent = list(range(len(ids)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(ids)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return [ids[find(i)] for i in range(len(ids))]


def test_fingerprints_and_components(spark, documents):
    import xxhash

    def naive(text):
        words = ["".join(c.lower() if c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ" else c for c in w) for w in words_of(text)]
        runs = [" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))] if words else []
        hashes = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))

    prints = [naive(r[1]) for r in documents]
    roots = brute_components(prints, [r[0] for r in documents])
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.query(spark, FOLDER).collect()}
    assert got == {r[0]: (format(p, "016x"), c) for r, p, c in zip(documents, prints, roots)}


def test_some_mask_leaves_out_any_three_positions():
    rng = random.Random(5)
    for _ in range(2000):
        apart = sum(1 << b for b in rng.sample(range(64), 3))
        assert any(not mask & apart for mask in simhash.MASKS)


def test_crowded_buckets_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(simhash, "CROWDED", 4)
    rng = random.Random(7)
    values = {rng.getrandbits(62)}
    for _ in range(120):
        values.add(rng.choice(sorted(values)) ^ sum(1 << b for b in rng.sample(range(62), rng.randint(1, 6))))
    values = sorted(values)
    links = simhash.links(spark.createDataFrame([(v,) for v in values], "fp long"))
    roots = {r["node"]: r["root"] for r in components(links).collect()}
    assert [roots.get(v, v) for v in values] == brute_components(values, values)


@pytest.mark.parametrize("crowded", [4, simhash.CROWDED])
def test_buckets_lose_no_link_in_any_bit(spark, monkeypatch, crowded):
    monkeypatch.setattr(simhash, "CROWDED", crowded)
    rng = random.Random(11)
    values = {rng.getrandbits(64)}
    for _ in range(120):
        flipped = rng.sample(range(63), rng.randint(0, 4)) + [63] * rng.randint(0, 1)
        values.add(rng.choice(sorted(values)) ^ sum(1 << b for b in flipped))
    values = sorted(v - (v >> 63 << 64) for v in values)
    links = simhash.links(spark.createDataFrame([(v,) for v in values], "fp long"))
    roots = {r["node"]: r["root"] for r in components(links).collect()}
    assert [roots.get(v, v) for v in values] == brute_components([v % (1 << 64) for v in values], values)


def test_spanning_forest_counts_bit_63():
    near = np.array([0, -(1 << 63) | 1, -(1 << 63) | 1 << 10], dtype=np.int64)
    assert len(simhash.spanning_forest(near)) == 2
    assert len(simhash.spanning_forest(np.array([0, -(1 << 63) | 0b1111], dtype=np.int64))) == 0


def test_components_of_a_chain_and_loops(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, 100), (200, 201), (201, 200)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{k: 0 for k in range(41)}, 200: 200, 201: 200}


# op3


def test_pieces_are_those_of_the_library_and_decode(spark, documents):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    got = {r["doc_id"]: r for r in pieces.query(spark, FOLDER).collect()}
    for doc_id, text, *_ in documents:
        assert got[doc_id]["ids"] == library.encode(text or "")
    assert all(r["exact"] for r in got.values())
    back = pieces.decode(pieces.query(spark, FOLDER), pieces.read_model()).select("doc_id", "text").collect()
    assert dict(map(tuple, back)) == {r[0]: r[1] or "" for r in documents}


def test_pieces_of_odd_texts():
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    machine, rng = pieces.compiled(pieces.read_model()), random.Random(1)
    texts = ["", " ", "   ", "a▁b", "\n\t\0", "日本語😀😀 ñandú", "a" * 300, "    def f():\n        return  1\n"]
    texts += ["".join(rng.choice("abcdefgh  ▁\nAé.,=019日ß") for _ in range(rng.randint(1, 40))) for _ in range(500)]
    for text in texts:
        assert machine.encode(text).tolist() == library.encode(text)
        assert machine.decode(library.encode(text)) == text.replace("▁", " ")


# op5


def test_base_statistics(documents):
    for _, text, *_ in documents:
        words, seen, lines = words_of(text), Counter(), 0
        runs = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
        counts = Counter(runs)
        repeated = {k + j for k, r in enumerate(runs) if counts[r] > 1 for j in range(3)}
        for line in text.split("\n"):
            lines += bool(words_of(line)) and seen[line] > 0
            seen[line] += 1
        want = (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), lines, len(repeated))
        assert quality.text_statistics(text)[:5] == want


def test_estimates_against_whole_arrays(spark):
    """Concentration steps over all rows of a group in memory give the same verdicts."""
    got = {r["doc_id"]: r for r in quality.query(spark, "/root/testdata/sf0.01").collect()}
    rows = duckdb.sql("SELECT doc_id, text, lang, source FROM '/root/testdata/sf0.01/documents.parquet'").fetchall()
    p, floor = len(quality.FEATURES), np.diag(np.square(list(quality.FEATURES.values())))
    scale = 0.5 / quality.chi2_cdf(quality.chi2_quantile(0.5, p), p + 2)

    def vector(text):
        n, chars, symbols, dup, repeat, distinct, lines = quality.text_statistics(text)
        share = lambda a, b: np.arcsin(np.sqrt(min(1.0, a / max(b, 1))))
        return [np.log1p(n), np.log((chars + 1) / (n + 1)), share(symbols, chars), share(dup, lines), share(repeat, n), np.log((distinct + 1) / (n + 1) ** 0.85)]

    sound = [(i, vector(t), (lang, source)) for i, t, lang, source in rows if not got[i]["base_failed"]]
    x, groups = np.array([v for _, v, _ in sound]), [g for *_, g in sound]
    members = {g: np.array([k for k, other in enumerate(groups) if other == g]) for g in set(groups)}

    def bin_of(d):
        return np.minimum(np.floor(np.log(np.maximum(d, 1e-4) / 1e-4) / (np.log(1e8) / 8192)), 8192)

    def pooled(rows, prior):
        n = len(rows)
        if prior is None:
            return rows.mean(0), np.cov(rows.T, bias=True)
        mean = (rows.sum(0) + 100 * prior[0]) / (n + 100)
        gap = prior[0] - mean
        return mean, ((rows - mean).T @ (rows - mean) + 100 * (prior[1] + np.outer(gap, gap))) / (n + 100)

    distance = np.zeros(len(x))
    for g, m in members.items():
        middle = [(np.sort(np.floor(x[m, j] * 256))[int(np.ceil(len(m) / 2)) - 1] + 0.5) / 256 for j in range(p)]
        distance[m] = np.sqrt((((x[m] - middle) / np.sqrt(np.diag(floor))) ** 2).sum(1))
    for _ in range(quality.STEPS):
        core = {}
        for g, m in members.items():
            bins = bin_of(distance[m])
            core[g] = m[bins <= np.sort(bins)[int(np.ceil(len(m) / 2)) - 1]]
        whole = pooled(x[np.concatenate(list(core.values()))], None)
        for g, m in members.items():
            language = pooled(x[np.concatenate([c for (lang, _), c in core.items() if lang == g[0]])], whole)
            mean, cov = pooled(x[core[g]], language)
            y = x[m] - mean
            distance[m] = np.sqrt(np.einsum("ij,jk,ik->i", y, np.linalg.inv(scale * cov + floor), y))
    for (i, *_), d in zip(sound, distance):
        assert got[i]["distance"] == pytest.approx(d, rel=1e-6)
        assert got[i]["kept"] == (d <= quality.cutoff())


def test_clean_documents_stay_and_junk_goes(spark):
    told = dict(duckdb.sql("SELECT doc_id, quality FROM '/root/testdata/sf0.01/labels.parquet'").fetchall())
    verdicts = [(told[r["doc_id"]], r["kept"]) for r in quality.query(spark, "/root/testdata/sf0.01").collect() if r["doc_id"] in told and not r["base_failed"]]
    assert all(kept == bool(good) for good, kept in verdicts)


# op6


@pytest.mark.parametrize("limit", [sharding.LIMIT, 50_000])
def test_shards_against_sql(spark, limit):
    from compare import duck

    got = sharding.assign(spark.read.parquet(f"{FOLDER}/documents.parquet"), limit).drop("hash").toPandas()
    assert difference(got, duck(FOLDER).execute(sharding.sql(limit)).df()) is None


def test_alike_rows_are_counted_off_and_written_whole(spark, tmp_path):
    docs = spark.createDataFrame([(1, "x" * 100)] * 100 + [(2, "y" * 50), (3, "z" * 5000), (None, None)], "doc_id long, text string")
    got = sharding.assign(docs, 1000).toPandas()
    assert len(got) == 103
    sums = got.groupby("shard").agg({"n_bytes": "sum", "shard_bytes": "max", "doc_id": "nunique"})
    assert (sums.n_bytes == sums.shard_bytes).all()
    assert sorted(sums.n_bytes)[-2:] == [1000, 5000]
    sharding.write_shards(docs, str(tmp_path / "shards"), 1000)
    back = spark.read.parquet(str(tmp_path / "shards")).groupBy("doc_id").count().collect()
    assert {r[0]: r[1] for r in back} == {1: 100, 2: 1, 3: 1, None: 1}


def test_alike_rows_keep_their_other_columns(spark, tmp_path):
    rows = [(None, "x" * 100, f"source {k}") for k in range(95)] + [(2, "y" * 50, "other")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    sharding.write_shards(docs, str(tmp_path / "shards"), 1000)
    # by folder: a reader takes bits with a point for a number
    back = spark.read.parquet(str(tmp_path / "shards")).withColumn("shard", sharding.F.regexp_extract(sharding.F.input_file_name(), "shard=([0-9.]*)", 1)).collect()
    assert sorted(r["source"] for r in back) == sorted(r[2] for r in rows)
    assert sorted(Counter(r["shard"] for r in back if r["doc_id"] is None).values()) == [5] + [10] * 9


# op7


def test_articles_of_pages(spark):
    rows = {r[0]: r[1] for r in duckdb.sql(f"SELECT page_id, html FROM '{FOLDER}/pages.parquet'").fetchall()}
    for r in pages.query(spark, FOLDER).collect():
        article = re.search(r"<article>(.*?)</article>", rows[r["page_id"]], re.S)[1]
        assert r["text"] == " ".join(html.unescape(re.sub("<[^>]*>", " ", article)).split())
        assert r["n_chars"] == len(r["text"])


def test_shared_lines_go_where_markup_says_nothing(spark):
    def page(k):
        return f"<div>Top of site</div><div>Story {k} &amp; more</div><div>Bottom of site</div>"

    rows = [(k, f"http://a.example/news/{k}", page(k)) for k in range(6)]
    rows += [(10, "http://b.example/x", page(10)), (11, None, page(11)), (12, "http://a.example/z", None), (13, "http://c.example/1", page(1)), (14, "http://c.example/2", page(1))]
    got = {r["page_id"]: r["text"] for r in pages.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert [got[k] for k in range(6)] == [f"Story {k} & more" for k in range(6)]
    whole = "Top of site Story {} & more Bottom of site"
    assert got[10] == whole.format(10) and got[11] == whole.format(11) and got[12] == ""
    assert got[13] == got[14] == whole.format(1)  # a copy keeps its lines


def test_pages_with_an_article_are_differenced_too(spark):
    def page(k):
        return f"<nav>Menu</nav><div>Site of news</div><article><p>Story {k}</p><p>Same words</p></article><div>More on {k}</div><div>Imprint</div>"

    rows = [(k, f"http://a.example/news/{k}", page(k)) for k in range(4)]
    got = {r["page_id"]: r["text"] for r in pages.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {k: f"Story {k} Same words More on {k}" for k in range(4)}


def test_pages_meet_across_blocks(spark):
    rows = [(k, f"http://{'ab'[k % 2]}.example/{k:02d}", f"<div>Top {k % 2}</div><div>Story {k}</div><div>{'' if k % 7 else 'Odd'}</div>") for k in range(30)]
    rows += [*rows[4:6], (40, None, "<p>x"), (41, "http://a.example/05", None)]
    web = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    whole = sorted(map(tuple, pages.extract(web).collect()))
    assert len(whole) == len(rows) and [r[2] for r in whole][:2] == ["Story 0 Odd", "Story 1"]
    for size in (1, 2, 5):
        assert sorted(map(tuple, pages.extract(web, size=size).collect())) == whole


def test_markup_that_is_not_the_article():
    page = """<body><header>Site</header><nav>Menu</nav><main><article><h1>Title</h1><p title='a>b'>One <b>two</b><br>three
    <aside>Side</aside><div class="share-buttons">Share</div><p>Four<script>var a="</p>";</script></article>
    <section id=comments><article>First!</article></section></main><div class="cookie-notice">Cookies</div>
    <form>Mail<input></form><footer>&copy;</footer><!-- <p>no</p>"""
    assert [text for text, inside in pages.lines_of(page) if inside] == ["Title", "One two", "three", "Four"]


def test_shared_lines_are_a_longest_common_subsequence():
    rng = random.Random(2)
    for _ in range(200):
        a, b = ([rng.randint(0, 4) for _ in range(rng.randint(0, 9))] for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(len(a)):
            for j in range(len(b)):
                table[i + 1][j + 1] = table[i][j] + 1 if a[i] == b[j] else max(table[i][j + 1], table[i + 1][j])
        found = [a[k] for k in sorted(pages.shared_lines(a, b))]
        rest = iter(b)
        assert len(found) == table[-1][-1] and all(x in rest for x in found)


# op8


def test_folding():
    assert toxicity.folded_words("You 1d10t are pаthetic, $tup1d tra5h in 2024!") == "you idiot are pathetic stupid trash in".split()


def test_toxicity_held_out(spark):
    told = dict(duckdb.sql("SELECT doc_id, toxic FROM '/root/testdata/sf0.1/labels.parquet'").fetchall())
    rows = toxicity.query(spark, "/root/testdata/sf0.1").collect()
    assert len(rows) == 10_000
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5)
    held = [(told[r["doc_id"]], r["predicted"]) for r in rows if r["held_out"] and r["doc_id"] in told]
    hit = sum(a and b for a, b in held)
    assert hit / sum(a for a, _ in held) > 0.9 and hit / sum(b for _, b in held) > 0.9


def test_exceptions_and_disguise(spark):
    rng = random.Random(8)
    some = lambda: " ".join("".join(rng.choice("bcdfglmnr") + rng.choice("aeiou") for _ in range(3)) for _ in range(4))
    clean = [f"{some()} trash can {some()}" for _ in range(10)] + [f"{some()} {some()}" for _ in range(250)]
    toxic = [f"{some()} trash {some()}" for _ in range(60)]
    rows = [(k, t) for k, t in enumerate(clean + toxic)] + [(900, f"{some()} tr4sh {some()}"), (901, f"{some()} trash can {some()}")]
    labels = [(k, int(k >= 260)) for k in range(320)]
    docs, told = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    got = {r["doc_id"]: r["predicted"] for r in toxicity.score(docs, *toxicity.fit(docs, told)).collect()}
    assert got[900] == 1 and got[901] == 0


# op9


def test_forest_tells_findings(spark):
    rng = random.Random(4)
    key = lambda: "".join(rng.choice("0123456789abcdef") for _ in range(32))
    rows = [(k, f"some words token = {key()} more words") for k in range(60)]
    rows += [(100 + k, f"picture number {rng.randrange(10**19, 10**20)} taken") for k in range(60)]
    docs = spark.createDataFrame([(i, t, "src") for i, t in rows], "doc_id long, text string, source string")
    got = secrets.scan(docs, secrets.F.when(secrets.F.col("doc_id") % 2 == 0, (secrets.F.col("doc_id") < 100).cast("double"))).collect()
    assert len(got) == 120 and all(r["is_secret"] == (r["doc_id"] < 100) for r in got)


def test_all_runs_of_a_word_are_candidates(spark):
    aws, token = "wJalrXUtnFEMI/K7MDENG/bPxRfiCYEXAMPLEKEY", "ghp_" + "a1B2" * 9
    ids = [f"{k:016x}" for k in range(300)]
    texts = {
        1: (f"export AWS_SECRET_ACCESS_KEY={aws} now", [aws]),
        2: (f"see https://example.com/reference/manual?token={token} there", [token]),
        3: (f'{{"id":"{ids[7]}","secret":"{token}"}}', [ids[7], token]),
        4: (";".join(ids), ids),
        5: ("password=hunter2 x", ["hunter2"]),
        6: ("password: hunter2 or 'pin' = \"a1\" x", ["hunter2", "a1"]),
        7: ("at 12:30 and 4x4, short1 is no value, https://a1.example/b2", []),
        8: ("padded QUJDREVGR0hJSktMTU5PUA== end", ["QUJDREVGR0hJSktMTU5PUA=="]),
    }
    docs = spark.createDataFrame([(k, t, "s") for k, (t, _) in texts.items()], "doc_id long, text string, source string")
    rows = secrets.candidates(docs).orderBy("doc_id", "pos", "place").collect()
    assert {k: [r["finding"] for r in rows if r["doc_id"] == k] for k in texts} == {k: want for k, (_, want) in texts.items()}
    lead = {(r["doc_id"], r["finding"]): r["lead"] for r in rows}
    assert lead[1, aws] == "aws_secret_access_key=" and lead[3, token] == ids[7] + '","secret":"' and lead[5, "hunter2"] == "password="


def test_no_findings_without_labels(spark):
    docs = spark.createDataFrame([(1, "password=ef5f08a44296d48198 x", "s")], "doc_id long, text string, source string")
    (row,) = secrets.scan(docs, secrets.F.lit(None)).collect()
    assert row["score"] is None and row["is_secret"] is False


# op10

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def brute_spans(text):
    found = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text):
            digits = [int(c) for c in m[0] if c.isdigit()]
            luhn = sum(d if k % 2 == 0 else sum(divmod(2 * d, 10)) for k, d in enumerate(digits[::-1])) % 10 == 0
            if {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else 0, "card": 13 <= len(digits) <= 19 and luhn, "phone": 9 <= len(digits) <= 15}[kind]:
                found.append((kind, m.start(), m.end()))
    return found


def test_base_spans(documents):
    rng = random.Random(6)
    odd = ["a@b@c.d.e", "1.2.3.4.5.6.7.8", "x@y.z@w.v", "1.2.3.999 0001.2.3.4", "4111 1111-1111 1111", "+1 (283) 555-6500 +49", "a..b@c-d.e.f."]
    odd += ["".join(rng.choice("ab1 2.3@-+()4") for _ in range(60)) for _ in range(500)]
    for text in [r[1] for r in documents] + odd:
        assert sanitise.base_spans(text) == brute_spans(text)


def test_disclosing_terms(spark):
    rows = [(k, f"filler{k} words Zanzibar met bob@x.org near {k + 500} today") for k in range(8)]
    rows += [(100 + k, f"plain words today near number {k}") for k in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    spans = {r["doc_id"]: r["spans"] for r in sanitise.report(docs).collect()}
    assert spans[0] == "email:27:36,term:14:22,term:23:26" and spans[100] == ""
    texts = {r["doc_id"]: r["text"] for r in sanitise.sanitise(docs).collect()}
    assert texts[0] == "filler0 words [NAME] [TERM] [EMAIL] near 500 today" and texts[100] == rows[8][1]


def test_disclosing_terms_of_the_whole_text(spark):
    far = " ".join(["plain"] * 20)
    rows = [(k, f"Zanzibar {far} other{k} met bob@x.org near {k + 500} {far} Quagga") for k in range(8)]
    rows += [(100 + k, f"plain met near number {k}") for k in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    texts = {r["doc_id"]: r["text"] for r in sanitise.sanitise(docs).collect()}
    assert texts[0] == f"[NAME] {far} other0 met [EMAIL] near 500 {far} [NAME]" and texts[100] == rows[8][1]


# the pipeline


def test_pipeline_against_its_stages_by_hand(spark):
    import sentencepiece

    folder = "/root/testdata/sf0.01"
    rows = duckdb.sql(f"SELECT doc_id, text FROM '{folder}/documents.parquet' ORDER BY doc_id").fetchall()
    good = {r["doc_id"] for r in quality.query(spark, folder).collect() if r["kept"]}
    rows = [r for r in rows if r[0] in good]
    prints = [simhash.fingerprint(t) for _, t in rows]
    roots = brute_components(prints, [i for i, _ in rows])
    rows = [r for r, root in zip(rows, roots) if r[0] == root]
    pattern = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    split = lambda t: pattern.findall((t or "").translate(lower))
    items = [split(t) for (t,) in duckdb.sql(f"SELECT text FROM '{folder}/benchmark.parquet'").fetchall()]
    windows = {tuple(w[k : k + 10]) for w in items if w for k in range(max(1, len(w) - 9))}
    sizes = {len(w) for w in windows}
    rows = [(i, t) for i, t in rows if not any(tuple(w[k : k + n]) in windows for w in [split(t)] for n in sizes for k in range(len(w) - n + 1))]
    library = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    terms = {}
    kept = spark.createDataFrame(rows, "doc_id long, text string")
    for r in sanitise.report(kept).collect():
        terms[r["doc_id"]] = [tuple(map(int, s.split(":")[1:])) for s in r["spans"].split(",") if s.startswith("term")]
    want = {i: library.encode(sanitise.sanitised(t, brute_spans(t), terms[i])) for i, t in rows}
    got = {r["doc_id"]: r["ids"] for r in corpus_pipeline.run(spark, folder).collect()}
    assert got == want


# what all of them have to bear


def odd_documents(spark, empty=False):
    long = "word%d " * 3000 % tuple(range(3000))
    rows = [] if empty else [
        (None, None, None, None, None, None, None), (1, "", "en", "a", 0, "x", 1), (2, None, None, "a", 0, "x", 2),
        (3, long, "en", "a", 5, "x", 3), (3, long, "en", "a", 5, "x", 3), (4, long + "!", "en", "b", 5, "x", 4),
        (None, "short text with mail a@b.cd", "de", None, 5, "x", 5),
    ]
    # names that the operators use themselves
    return spark.createDataFrame(rows, DOCS + ", key string, row int").withColumns({
        n: quality.F.lit(1) for n in ("fp", "n", "words", "distance", "kept", "data", "spans", "terms", "n_words", "ids", "hash", "shard", "label", "mean")
    })


@pytest.mark.parametrize("empty", [False, True])
def test_odd_tables(spark, empty):
    docs = odd_documents(spark, empty)
    size = docs.count()
    items = spark.createDataFrame([] if empty else [(None, None), (1, ""), (2, "word7 word8"), (2, "word7 word8")], "item_id long, text string")
    told = spark.createDataFrame([] if empty else [(1, 1, 1), (3, 1, 0), (3, 1, 1), (None, None, None)], "doc_id long, quality int, toxic int")
    assert len(repeats.report(docs).collect()) == size
    assert len(simhash.near_duplicates(docs).collect()) == size
    assert len(pieces.encode(docs, pieces.read_model()).collect()) == size
    hits = decontaminate.report(docs, items).collect()
    assert len(hits) == size and sum(r["contaminated"] for r in hits) == (0 if empty else 3)
    assert len(quality.judge(docs).collect()) == size
    assert len(sharding.assign(docs, 1000).collect()) == size
    assert len(toxicity.score(docs, *toxicity.fit(docs, told)).collect()) == size
    secrets.scan(docs, secrets.format_label()).collect()
    assert sum(r["n_email"] for r in sanitise.report(docs).collect()) == (0 if empty else 1)
    web = spark.createDataFrame([] if empty else [(1, None, None, 1), (None, "x", "<p>a", 2), (None, "x", "<p>a", 2)], "page_id long, url string, html string, n int")
    assert len(pages.extract(web).collect()) == web.count()


def test_odd_documents_through_the_stages(spark):
    docs = odd_documents(spark)
    assert quality.keep_good(docs).columns == docs.columns
    one = simhash.keep_one(docs)
    # empty texts are one group, the two long rows and their near copy another, the mail a third
    assert one.columns == docs.columns and one.count() == 3
    items = spark.createDataFrame([(2, "word7 word8")], "item_id long, text string")
    assert decontaminate.keep_clean(docs, items).count() == 4
    clean = sanitise.sanitise(docs)
    assert clean.columns == docs.columns and clean.count() == docs.count()
    assert clean.where("text = 'short text with mail [EMAIL]'").count() == 1 and clean.where("text IS NULL").count() == 2
    assert repeats.remove(docs).count() == docs.count()


def test_texts_are_cut_into_words_once(spark):
    """Filters on the exploded words used to cut the text again, three times in all, and counting words once more."""
    docs = odd_documents(spark)
    words = decontaminate.words_of(decontaminate.text_of()).alias("words")
    tokens = spark.createDataFrame([("word7 word8",)], "token string")
    found = decontaminate._occurrences(docs.select(decontaminate.row_key().alias("key"), words), tokens, 2)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all") == 1
    report = decontaminate.report(docs, spark.createDataFrame([(2, "word7 word8")], "item_id long, text string"))
    assert "regexp_extract_all" not in report._jdf.queryExecution().optimizedPlan().toString()
