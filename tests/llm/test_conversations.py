"""Conversation repair against a search over costs and audits."""

import hashlib
import heapq
import random
import zlib

import duckdb
import pytest

from siftrank.llm import conversations

FOLDER = "/root/testdata/sf0.001"
SPACE = " \t\n\x0b\x0c\r"
#: Which role initial may follow what has been written ("" for nothing yet).
FOLLOWS = {"": "su", "s": "u", "u": "a", "a": "u"}


def cheapest(rows):
    """(cost, audit, repaired rows) by taking partial audits in order of cost, then letters."""
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, at, last, made = heapq.heappop(heap)
        if (at, last) in done:
            continue
        done.add((at, last))
        if at == len(rows) and last in ("", "a"):
            return cost, audit, list(made)
        if at < len(rows):
            role, text, fault = rows[at]
            heapq.heappush(heap, (cost + 3, audit + "D", at + 1, last, made))
            if fault not in ("blank", "duplicate"):
                more = fault == "truncated"
                if role[:1] and role[:1] in FOLLOWS[last]:
                    heapq.heappush(heap, (cost + more, audit + "K", at + 1, role[:1], (*made, (role, text))))
                for name in ("user", "assistant"):
                    if name[0] in FOLLOWS[last]:
                        heapq.heappush(heap, (cost + 2 + more, audit + "R", at + 1, name[0], (*made, (name, text))))
        for name in ("user", "assistant"):
            if name[0] in FOLLOWS[last]:
                heapq.heappush(heap, (cost + 2, audit + "I", at, name[0], (*made, (name, ""))))
    raise AssertionError


def brute(rows, damage):
    """Reports by conv_id, and repaired rows."""
    groups = {}
    for conv, turn, role, text in rows:
        own = groups.setdefault(conv, [])
        name = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        fate = zlib.crc32(name.encode()) % 20 if damage else 9
        role, text = " " if role is None else role, " " if text is None else text
        if fate == 1:
            text = ""
        if fate == 2:
            text = "".join(c for c in text if c not in ".!?")
        if fate == 4:
            role = "user"
        own += [(turn, role, text)] * (0 if fate == 0 else 2 if fate == 3 else 1)
    reports, repaired = {}, {}
    for conv, own in groups.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        seen, marked = set(), []
        for _, role, text in own:
            stripped = text.strip(SPACE)
            fault = (
                "blank" if not stripped else "duplicate" if (role, text) in seen
                else "truncated" if stripped[-1] not in ".!?" else ""
            )
            seen.add((role, text))
            marked.append((role, text, fault))
        turns = {t for t, _, _ in own if t is not None}
        pairs = [a[0][:1] + b[0][:1] for a, b in zip(marked, marked[1:])]
        cost, audit, made = cheapest(marked)
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in made).encode()).hexdigest()
        counts = [sum(f == name for *_, f in marked) for name in ("blank", "duplicate", "truncated")]
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        reports[conv] = (gaps, *counts, sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, digest)
        repaired[conv] = made
    return reports, repaired


def made_up(seed, n):
    rng = random.Random(seed)
    texts = ["Yes.", "No!", "cut", " \t", "", None, "Why? ", "é.", "same.", "x.\ny"]
    roles = ["user", "assistant", "system", "user", "assistant", "tool", None, "", "Sys", "anna", "user"]
    rows = []
    for _ in range(n):
        conv = rng.choice([None, *range(25)])
        rows.append((conv, rng.choice([None, *range(12)]), rng.choice(roles), rng.choice(texts)))
    return rows


def frame(spark, rows):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    return df.selectExpr("*", "'q' as code", "1 as copy", "false as there", "role as key", "turn as part")


def reports(df):
    return {r[0]: tuple(r)[1:] for r in df.collect()}


@pytest.mark.parametrize("long", [conversations.LONG, 9])
@pytest.mark.parametrize("damage", [False, True])
def test_report_against_search(spark, long, damage):
    rows = made_up(1, 350)
    df = frame(spark, rows)
    rows_in = conversations.damaged(df) if damage else conversations._clean(df)
    assert reports(conversations._report(rows_in, long)) == brute(rows, damage)[0]


@pytest.mark.parametrize("long", [conversations.LONG, 9])
def test_repaired_rows(spark, long):
    rows = made_up(2, 250)
    found = {}
    for r in sorted(conversations.repair(frame(spark, rows), long).collect(), key=lambda r: r["place"]):
        found.setdefault(r["conv_id"], []).append((r["role"], r["text"]))
    assert found == {c: made for c, made in brute(rows, False)[1].items() if made}


def test_query(spark):
    rows = duckdb.sql(f"SELECT conv_id, turn, role, text FROM '{FOLDER}/conversations.parquet'").fetchall()
    assert reports(conversations.query(spark, FOLDER)) == brute(rows, True)[0]


def test_one_conversation_over_many_tasks(spark):
    rng = random.Random(3)
    rows = [(7, t % 700, rng.choice(["user", "assistant"]), rng.choice(["Good.", "cut", f"Row {t}."])) for t in range(1500)]
    rows += [(7, None, "user", "All alike.")] * 400 + [(8, 0, "user", "Hello.")]
    got = reports(conversations.report(frame(spark, rows), 100))
    assert got == brute(rows, False)[0]


def test_least_audit_of_random_rows():
    rng = random.Random(4)
    faults = {0: "", 1: "blank", 2: "duplicate", 3: "truncated"}
    names = {0: "tool", 1: "system", 2: "user", 3: "assistant"}
    for _ in range(400):
        codes = [rng.randrange(16) for _ in range(rng.randint(0, 14))]
        rows = [(names[c & 3], "t", faults[c >> 2]) for c in codes]
        paths = conversations.Paths(codes, conversations.END)
        audit, nodes, last = paths.path()
        cost, want, made = cheapest(rows)
        assert (paths.costs[0][0], audit) == (cost, want) and last in (0, 3)
        assert [r[1:] for r in conversations.edited(audit, nodes, [r[:2] for r in rows])] == made


def test_ranks_order_all_audits():
    rng = random.Random(5)
    codes = [rng.randrange(16) for _ in range(60)]
    paths = conversations.Paths(codes, conversations.END)
    reached = [n for n in range(4 * 61) if paths.costs[n >> 2][n & 3] < conversations._NO]
    audits = {n: paths.path(n)[0] for n in reached}
    assert sorted(reached, key=lambda n: (audits[n], n)) == sorted(reached, key=lambda n: (paths.rank[n], n))


def test_empty_and_long_texts(spark):
    df = frame(spark, made_up(6, 3))
    assert conversations.report(df.limit(0)).count() == 0 and conversations.repair(df.limit(0)).count() == 0
    rows = [(1, 0, "user", "word " * 300_000 + "end."), (1, 1, "assistant", ". " * 500_000)]
    assert reports(conversations.report(frame(spark, rows))) == brute(rows, False)[0]
