"""Conversation structure repair: the cheapest edits that make the roles alternate.

The rows of a conversation, by turn, are edited so that their role initials read
``(s?(ua)+)?``. A row is kept, given another role or deleted, and empty rows may be inserted
anywhere. The edits are a path through nodes (rows read, last initial written): ``START``,
``SYSTEM``, ``USER`` or ``ASSISTANT``. A first pass from the end gives each node its cost to the goal; an
arc is optimal if it loses nothing of that. The audit of a path is the initials of its edits,
``D``, ``I``, ``K``, ``R``; of all cheapest paths that with the least audit is taken. To find it, nodes
are ranked by the first letter of their least audit, then by the first 2, 4, 8, ... letters: a
node's rank at twice the length is that of the pair of its rank and the rank of the node that
many letters on, to which a pointer leads that is doubled with it. An arc is then chosen by its letter and the
rank of its target, and the path is read off through the doubled pointers.

Conversations of up to ``LONG`` rows are each solved where they lie after one exchange. A longer
one is spread over tasks in order of its rows and solved in segments: each segment gives the cost from each
node at its start to each at its end, these few numbers give the cost to the goal at every border, the
segments give their audits for each node they may be entered at, and the borders that the path
crosses follow from these. Duplicates are found by an aggregate over digests. Only the digest of
the repaired text, which is one sequence by nature, is made by one task, row by row and without
holding them.

A null role or text is one blank (so a null text is a blank row), as null is in the query's hash.
A null ``conv_id`` is one conversation. Rows of the same turn go by role, then text; null turns come
first. Repeated rows are duplicates of the first. An empty table gives an empty
result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from siftrank.llm.common import WORD_SPACE, sha256_hex, stored, table

#: Conversations of more rows than this are solved in segments.
LONG = 20_000

START, SYSTEM, USER, ASSISTANT = range(4)
INITIALS = {"s": SYSTEM, "u": USER, "a": ASSISTANT}
#: What may be written after a node's last initial, by keeping, renaming or inserting.
NEXT = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
BLANK, DUPLICATE, TRUNCATED = 1, 2, 3
RENAME, DELETE, INSERT, CUT_OFF = 2, 3, 2, 1
END = (0, None, None, 0)  # costs at the end of a conversation; None: not allowed
_NO = 1 << 60
_ORDER = ("turn", "role", "text", "copy")


def _arcs(code: int, state: int) -> list[tuple[str, int, int]]:
    """Edits of a row at a node: letter, new last initial and cost. ``code`` is the row's
    initial and four times its fault."""
    initial, fault = code & 3, code >> 2
    arcs = [("D", state, DELETE)]
    if fault not in (BLANK, DUPLICATE):
        more = CUT_OFF if fault == TRUNCATED else 0
        if initial and (initial == NEXT[state] or initial == SYSTEM and state == START):
            arcs.append(("K", initial, more))
        arcs.append(("R", NEXT[state], RENAME + more))
    return arcs


_ARCS = {(code, state): _arcs(code, state) for code in range(16) for state in range(4)}


def _inserted(costs: list[int]) -> list[int]:
    """Costs of the nodes of one place when rows may be inserted at it."""
    user = min(costs[USER], INSERT + costs[ASSISTANT])
    return [
        min(costs[START], INSERT + user),
        min(costs[SYSTEM], INSERT + user),
        user,
        min(costs[ASSISTANT], INSERT + costs[USER]),
    ]


def costs_to_goal(codes: Sequence[int], goal: Sequence[int | None], last: bool = True) -> list[list[int]]:
    """For each place and last initial the least cost to the end of the rows and of ``goal``
    beyond it. Rows are inserted at the end only of the last segment; what stands at the
    end of another belongs to the next."""
    now = [_NO if g is None else g for g in goal]
    costs = [_inserted(now) if last else now]
    for code in reversed(codes):
        now = costs[-1]
        costs.append(_inserted([min(c + now[to] for _, to, c in _ARCS[code, state]) for state in range(4)]))
    return costs[::-1]


class Paths:
    """The cheapest path of least audit from every node of a segment."""

    def __init__(self, codes: Sequence[int], goal: Sequence[int | None], last: bool = True) -> None:
        self.costs = costs_to_goal(codes, goal, last)
        node, letter, target = [], [], []
        for i, code in enumerate([*codes, None]):
            for state in range(4):
                left = self.costs[i][state]
                if left >= _NO or (code is None and (not last or (goal[state] is not None and left == goal[state]))):
                    continue
                arcs = _ARCS[code, state] if code is not None else []
                found = [(c, 4 * (i + 1) + to) for c, to, cost in arcs if cost + self.costs[i + 1][to] == left]
                if INSERT + self.costs[i][NEXT[state]] == left:
                    found.append(("I", 4 * i + NEXT[state]))
                for c, to in found:
                    node.append(4 * i + state)
                    letter.append("DIKR".index(c) + 1)
                    target.append(to)
        self.size = 4 * (len(codes) + 1)
        self.node, self.arc, self.target = (np.array(x, np.int64) for x in (node, letter, target))
        self._rank()

    def _chosen(self, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Letter and target of each node's least arc, by letter and rank of the target."""
        order = np.lexsort((rank[self.target], self.arc, self.node))
        nodes, first = np.unique(self.node[order], return_index=True)
        letter, to = np.zeros(self.size, np.int64), np.arange(self.size)  # a last node leads to itself
        letter[nodes], to[nodes] = self.arc[order][first], self.target[order][first]
        return letter, to

    def _rank(self) -> None:
        """Ranks by 1, 2, 4, ... letters until no pointer leads on."""
        rank, jump = self._chosen(np.zeros(self.size, np.int64))
        while (jump[jump] != jump).any():
            pairs = rank * (self.size + 5) + rank[jump]
            rank, jump = np.unique(pairs, return_inverse=True)[1], jump[jump]
        self.rank = rank
        self.letter, self.next = self._chosen(rank)

    def path(self, state: int = START) -> tuple[str, list[int], int]:
        """Audit, the nodes it goes through, and the last initial at the end."""
        nodes, jump = np.array([state]), self.next
        while self.letter[nodes[-1]]:  # as many nodes more as there are, through the doubled pointer
            nodes, jump = np.concatenate([nodes, jump[nodes]]), jump[jump]
        letters = self.letter[nodes]
        steps = int(np.argmin(letters)) if len(letters) else 0
        audit = np.array([0, *b"DIKR"], np.uint8)[letters[:steps]].tobytes().decode()
        return audit, nodes[: steps + 1].tolist(), int(nodes[steps]) & 3


_NAMES = {USER: "user", ASSISTANT: "assistant"}


def edited(audit: str, nodes: Sequence[int], rows: Sequence[tuple[str, str]]) -> Iterator[tuple[int, str, str]]:
    """The repaired rows: the place of the row each stems from or stands before, role and text."""
    for letter, before, after in zip(audit, nodes[:-1], nodes[1:], strict=True):
        at, state = before >> 2, after & 3
        if letter == "K":
            yield at, *rows[at]
        elif letter == "R":
            yield at, _NAMES[state], rows[at][1]
        elif letter == "I":
            yield at, _NAMES[state], ""


def illegal_pairs(initials: Sequence[int]) -> int:
    legal = {(SYSTEM, USER), (USER, ASSISTANT), (ASSISTANT, USER)}
    return sum(pair not in legal for pair in zip(initials[:-1], initials[1:], strict=True))


# --- columns ---------------------------------------------------------------


def _blank(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(" "))


def _clean(conversations: DataFrame) -> DataFrame:
    """Rows with no null role or text. ``there`` is false for rows that only name a conversation;
    ``copy`` tells repeated rows apart."""
    return conversations.select(
        "conv_id", "turn", _blank("role").alias("role"), _blank("text").alias("text"),
        F.lit(0).alias("copy"), F.lit(True).alias("there"),
    )


def _code() -> Column:
    """Initial and first fault of a row, duplicates apart."""
    trimmed = F.rtrim(F.translate("text", WORD_SPACE, " " * len(WORD_SPACE)))
    fault = (
        F.when(trimmed == "", BLANK)
        .when(~F.substring(trimmed, -1, 1).isin(".", "!", "?"), TRUNCATED)
        .otherwise(0)
    )
    initial = F.substring("role", 1, 1)
    kind = F.lit(0)
    for letter, number in INITIALS.items():
        kind = F.when(initial == letter, number).otherwise(kind)
    return (kind + 4 * fault).cast("int")


_COUNTS = ("blank", "duplicate", "truncated", "illegal", "cost")
_REPORT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
_ROWS = "place long, role string, text string"


def _faults(codes: Sequence[int]) -> tuple[int, int, int]:
    return tuple(sum(c >> 2 == fault for c in codes) for fault in (BLANK, DUPLICATE, TRUNCATED))


def _solved(rows: list[tuple]) -> tuple[tuple, list[tuple[int, str, str]]]:
    """Report and repaired rows of a whole conversation of (turn, role, text, code)."""
    seen, codes = set(), []
    for _, role, text, code in rows:
        if code >> 2 != BLANK and (role, text) in seen:
            code = code & 3 | DUPLICATE << 2
        seen.add((role, text))
        codes.append(code)
    turns = {turn for turn, *_ in rows if turn is not None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    paths = Paths(codes, END)
    audit, nodes, _ = paths.path()
    made = list(edited(audit, nodes, [(role, text) for _, role, text, _ in rows]))
    digest = sha256_hex("\n".join(f"{role}:{text}" for _, role, text in made).encode())
    return (gaps, *_faults(codes), illegal_pairs([c & 3 for c in codes]), paths.costs[0][START], audit, digest), made


def _short(batches: Iterator[pa.RecordBatch], whole: bool) -> Iterator[pa.RecordBatch]:
    """Conversations that follow each other, each with its rows in order."""
    out: list[tuple] = []
    held: list[tuple] = []
    current: list = []
    kind = None

    def ended() -> None:
        report, made = _solved(held)
        out.extend([(current[0], *report)] if whole else [(current[0], k, *row[1:]) for k, row in enumerate(made)])

    def batch() -> pa.RecordBatch:
        names = [x.split()[0] for x in (_REPORT if whole else _ROWS).split(", ")]
        columns = list(zip(*out, strict=True))
        types = [kind, *[pa.string() if x.endswith("string") else pa.int64() for x in (_REPORT if whole else _ROWS).split(", ")]]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["conv_id", *names])

    for part in batches:
        kind = part.schema.field("conv_id").type
        for conv, there, *row in zip(*(part.column(n).to_pylist() for n in ("conv_id", "there", "turn", "role", "text", "code")), strict=True):
            if current != [conv]:
                if current:
                    ended()
                held, current = [], [conv]
            if there:
                held.append(tuple(row))
        if out:
            yield batch()
            out = []
    if current:
        ended()
    if out:
        yield batch()


# --- long conversations ----------------------------------------------------


def _placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order, with the task's number and their place in it."""
    part, at = TaskContext.get().partitionId(), 0
    for batch in batches:
        places = pa.array(range(at, at + batch.num_rows), pa.int64())
        at += batch.num_rows
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([part] * batch.num_rows, pa.int32()), places], names=[*batch.schema.names, "part", "at"])


def _batch(rows: list[tuple], kinds: Sequence[tuple[str, pa.DataType]]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(columns, kinds, strict=True)], names=[n for n, _ in kinds])


_LONGS = pa.list_(pa.int64())


def _crossed(batch: pa.RecordBatch) -> pa.RecordBatch:
    """For each segment its cost from every node at its start to every node at its end, for a
    segment that another follows and for the last; its faults; illegal pairs; first and last initial."""
    rows = []
    for group, part, codes in zip(*(batch.column(n).to_pylist() for n in ("group", "part", "codes")), strict=True):
        ways = [costs_to_goal(codes, [0 if s == end else None for s in range(4)], False)[0] for end in range(4)]
        whole = costs_to_goal(codes, END)[0]
        initials = [c & 3 for c in codes]
        facts = [*_faults(codes), illegal_pairs(initials), initials[0], initials[-1]]
        rows.append((group, part, [c for way in ways for c in way], whole, facts))
    return _batch(rows, [("group", pa.int64()), ("part", pa.int32()), ("ways", _LONGS), ("whole", _LONGS), ("facts", _LONGS)])


def _goals(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Costs to the goal at the end of each segment, and the conversation's counts."""
    rows = []
    for group, segments in zip(batch.column("group").to_pylist(), batch.column("segments").to_pylist(), strict=True):
        goal, goals = None, []
        for segment in reversed(segments):
            goals.append((segment["part"], goal))
            goal = segment["whole"] if goal is None else [
                min(_NO, *(segment["ways"][4 * end + s] + goal[end] for end in range(4))) for s in range(4)
            ]
        facts = [s["facts"] for s in segments]
        counts = [sum(f[k] for f in facts) for k in range(4)]
        counts[3] += sum(illegal_pairs([a[5], b[4]]) for a, b in zip(facts[:-1], facts[1:], strict=True))
        rows += [(group, part, g, [*counts, goal[START]]) for part, g in goals]
    return _batch(rows, [("group", pa.int64()), ("part", pa.int32()), ("goal", _LONGS), ("counts", _LONGS)])


def _audits(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Each segment's least audit and last node, for every node it may be entered at."""
    rows = []
    for group, part, codes, goal in zip(*(batch.column(n).to_pylist() for n in ("group", "part", "codes", "goal")), strict=True):
        last = goal is None
        paths = Paths(codes, END if last else [None if g >= _NO else g for g in goal], last)
        found = [paths.path(s) for s in range(4)]
        rows.append((group, part, [f[0] for f in found], [f[2] for f in found]))
    return _batch(rows, [("group", pa.int64()), ("part", pa.int32()), ("audits", pa.list_(pa.string())), ("exits", _LONGS)])


def _entries(batch: pa.RecordBatch) -> pa.RecordBatch:
    rows = []
    for group, segments in zip(batch.column("group").to_pylist(), batch.column("segments").to_pylist(), strict=True):
        state = START
        for segment in segments:
            rows.append((group, segment["part"], state))
            state = segment["exits"][state]
    return _batch(rows, [("group", pa.int64()), ("part", pa.int32()), ("entry", pa.int64())])


def _edited_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of segments in order beside their segment's audit: the repaired rows."""
    kinds = [("group", pa.int64()), ("part", pa.int32()), ("at", pa.int64()), ("nth", pa.int64()), ("role", pa.string()), ("text", pa.string())]
    now, audit, read, state = None, "", 0, START
    for batch in batches:
        out = []
        for group, part, at, role, text, whole, entry, last in zip(
            *(batch.column(n).to_pylist() for n in ("group", "part", "at", "role", "text", "audit", "entry", "last")), strict=True
        ):
            if now != (group, part):
                now, audit, read, state = (group, part), whole, 0, entry
            nth = 0
            while read < len(audit):
                letter, read = audit[read], read + 1
                if letter == "K":
                    state = INITIALS[role[0]]
                    out.append((group, part, at, nth, role, text))
                elif letter != "D":
                    state = NEXT[state]
                    out.append((group, part, at, nth, _NAMES[state], text if letter == "R" else ""))
                nth += 1
                if letter != "I" and not last:  # after the last row come only insertions
                    break
        if out:
            yield _batch(out, kinds)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    now, digest, done = None, None, []
    for batch in batches:
        for group, role, text in zip(*(batch.column(n).to_pylist() for n in ("group", "role", "text")), strict=True):
            if group != now:
                if digest:
                    done.append((now, digest.hexdigest()))
                now, digest = group, hashlib.sha256()
            else:
                digest.update(b"\n")
            digest.update(f"{role}:{text}".encode())
    if digest:
        done.append((now, digest.hexdigest()))
    if done:
        yield _batch(done, [("group", pa.int64()), ("repaired_sha256", pa.string())])


def _each(function):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield function(batch)

    return run


def _solve_long(rows: DataFrame, groups: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(reports without ``conv_id``, repaired rows), both by the number ``group`` of a conversation."""
    named = rows.join(groups, F.col("conv_id").eqNullSafe(F.col("key"))).where("there")
    columns = ["group", *_ORDER, "code"]
    ranged = named.select(*columns).repartitionByRange("group", *_ORDER).sortWithinPartitions("group", *_ORDER)
    ordered = stored(ranged.mapInArrow(_placed, ranged.schema.simpleString()[7:-1] + ", part int, at long"), "ordered")
    place = F.struct("part", "at")
    narrow = ordered.select("group", "part", "at", "code", F.md5(F.concat("role", F.lit("\x00"), "text")).alias("digest"))
    first = narrow.groupBy("group", "digest").agg(F.count("*").alias("n"), F.min(place).alias("first")).where("n > 1")
    again = F.coalesce(F.col("first") != place, F.lit(False)) & (F.shiftright("code", 2) != BLANK)
    marked = narrow.join(first.drop("n"), ["group", "digest"], "left").select(
        "group", "part", "at", F.when(again, F.col("code") % 4 + 4 * DUPLICATE).otherwise(F.col("code")).alias("code")
    )
    codes = F.transform(F.array_sort(F.collect_list(F.struct("at", "code"))), lambda x: x["code"])
    segments = stored(marked.groupBy("group", "part").agg(codes.alias("codes")), "segments")
    listed = lambda df, *names: df.groupBy("group").agg(F.array_sort(F.collect_list(F.struct("part", *names))).alias("segments"))
    crossed = segments.mapInArrow(_each(_crossed), "group long, part int, ways array<long>, whole array<long>, facts array<long>")
    goals = stored(
        listed(crossed, "ways", "whole", "facts").mapInArrow(_each(_goals), "group long, part int, goal array<long>, counts array<long>"), "goals"
    )
    audits = stored(
        segments.join(goals, ["group", "part"])
        .select("group", "part", "codes", "goal")
        .mapInArrow(_each(_audits), "group long, part int, audits array<string>, exits array<long>"),
        "audits",
    )
    entries = listed(audits, "exits").mapInArrow(_each(_entries), "group long, part int, entry long")
    chosen = stored(
        audits.join(entries, ["group", "part"]).select(
            "group", "part", "entry", F.element_at("audits", (F.col("entry") + 1).cast("int")).alias("audit")
        ),
        "chosen",
    )
    ends = ordered.groupBy("group").agg(F.max(place).alias("end"))
    beside = ordered.join(chosen, ["group", "part"]).join(ends, "group").select(
        "group", "part", "at", "role", "text", "audit", "entry", (F.col("end") == place).alias("last")
    )
    sorted_parts = beside.repartition("group", "part").sortWithinPartitions("group", "part", "at")
    repaired = stored(
        sorted_parts.mapInArrow(_edited_parts, "group long, part int, at long, nth long, role string, text string"), "repaired"
    )
    lines = repaired.repartition("group").sortWithinPartitions("group", "part", "at", "nth")
    digests = lines.select("group", "role", "text").mapInArrow(_digests, "group long, repaired_sha256 string")
    pieces = F.transform(F.array_sort(F.collect_list(F.struct("part", "audit"))), lambda x: x["audit"])
    audit = chosen.groupBy("group").agg(F.array_join(pieces, "").alias("audit"))
    counts = goals.groupBy("group").agg(F.max("counts").alias("counts"))
    turns = ordered.groupBy("group").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).alias("gaps")
    )
    known = groups.join(turns, "group", "left").join(counts, "group", "left").join(audit, "group", "left").join(digests, "group", "left")
    report = known.select(
        F.col("key").alias("conv_id"),
        F.coalesce("gaps", F.lit(0)).alias("gaps"),
        *[F.coalesce(F.col("counts")[k], F.lit(0)).alias(name) for k, name in enumerate(_COUNTS)],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(sha256_hex(b""))).alias("repaired_sha256"),
    )
    return report, repaired.join(groups, "group")


def _split(rows: DataFrame, long: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows of usual conversations, all rows, the long conversations with a number each)."""
    sizes = rows.groupBy("conv_id").agg(F.count("*").alias("n"))
    # at most one in ``long`` rows is named here
    groups = stored(
        sizes.where(F.col("n") > long).select(F.col("conv_id").alias("key"), F.monotonically_increasing_id().alias("group")), "long"
    )
    rows = rows.withColumn("code", _code())
    usual = rows.join(groups, F.col("conv_id").eqNullSafe(F.col("key")), "left_anti")
    return usual.repartition("conv_id").sortWithinPartitions("conv_id", *_ORDER), rows, groups


def _report(rows: DataFrame, long: int) -> DataFrame:
    usual, rows, groups = _split(rows, long)
    kind = rows.schema["conv_id"].dataType.simpleString()
    short = usual.mapInArrow(lambda batches: _short(batches, True), f"conv_id {kind}, {_REPORT}")
    return short if groups.isEmpty() else short.unionByName(_solve_long(rows, groups)[0])


def report(conversations: DataFrame, long: int = LONG) -> DataFrame:
    """Faults, cost, audit and digest of the repaired rows of every conversation."""
    return _report(_clean(conversations), long)


def repair(conversations: DataFrame, long: int = LONG) -> DataFrame:
    """The repaired rows: ``conv_id``, ``place`` (0, 1, ... in a usual conversation, rising in a
    long one), ``role`` and ``text``."""
    usual, rows, groups = _split(_clean(conversations), long)
    kind = rows.schema["conv_id"].dataType.simpleString()
    short = usual.mapInArrow(lambda batches: _short(batches, False), f"conv_id {kind}, {_ROWS}")
    if groups.isEmpty():
        return short
    made = _solve_long(rows, groups)[1]
    place = F.col("part").cast("long") * (1 << 40) + F.col("at") * (1 << 8) + F.col("nth")
    return short.unionByName(made.select(F.col("key").alias("conv_id"), place.alias("place"), "role", "text"))


def damaged(conversations: DataFrame) -> DataFrame:
    """The query's rows: some dropped, emptied, cut off, repeated or given to the user, by hash."""
    fate = F.crc32(F.concat(_blank("conv_id"), F.lit(":"), _blank("turn"))) % 20
    rows = conversations.select("conv_id", "turn", _blank("role").alias("role"), _blank("text").alias("text"), fate.alias("fate"))
    text = F.when(F.col("fate") < 2, "").when(F.col("fate") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    copies = F.when(F.col("fate") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select(
        "conv_id",
        "turn",
        F.when(F.col("fate") == 4, "user").otherwise(F.col("role")).alias("role"),
        text.alias("text"),
        F.explode(copies).alias("copy"),
        (F.col("fate") != 0).alias("there"),
    )


def query(spark, folder: str) -> DataFrame:
    """``op13``: repair of every damaged conversation."""
    return _report(damaged(table(spark, folder, "conversations")), LONG)
