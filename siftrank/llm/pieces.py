"""SentencePiece encoding and decoding as a weighted finite-state transducer.

A model file is compiled into a chain of transducers over characters: the normaliser
(white space becomes the space sign, one is put in front), the pieces (a path from the
start through a piece's characters back to the start gives its id) and byte fallback (a
character that is no piece gives the ids of its bytes). Composed with a text they make
a lattice of places and last pieces; the encoding is its shortest path in the tropical
semiring, where costs add along a path and the least path counts.

The costs are those of the model's kind. In a unigram model a piece costs its negative
score. A merge (BPE) model has no additive score: there two pieces cost nothing
side by side if merging their characters gives just these two, and infinitely much
otherwise. A sequence all of whose neighbours stand that test is what merging the whole
text gives, and there is one such sequence, so the shortest path is the model's encoding.

Where no piece has a character before the space sign, every path is cut there, at
characters that occur in no longer piece, and after letters that every piece goes on from with
letters only; parts between such cuts are composed on their own and remembered for the rest of the task. What is remembered is kept in two generations of ``REMEMBERED``
parts or ``REMEMBERED_BYTES`` at most: when the newer is full the older goes, and a part met again moves to
the newer. Transducer and memory go when the task ends.

Normalisers with a character map are refused: the file's rule is then not the identity.
Null and empty texts have no ids. Repeated rows and missing doc_ids change nothing; an empty
table gives an empty result. Whatever the text holds is encoded whole, and decoding gives
it back; only the space sign itself comes back as a blank.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, IntegerType

from siftrank.llm.common import by_batch, table

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
REMEMBERED = 300_000
REMEMBERED_BYTES = 36 << 20
NEIGHBOURS = 400_000

#: Kinds of models and of pieces, as numbered in model files (fixed values).
UNIGRAM, BPE = 1, 2
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6

#: What stands for a piece where there is none: the bytes of one character, and no arc left.
FALLBACK, NOTHING = -2, -1


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Number and value of each field of a protocol-buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
            continue
        size = {1: 8, 5: 4}[kind] if kind != 2 else varint()
        yield tag >> 3, data[at : at + size]
        at += size


class Transducer:
    """A compiled model: ``encode`` and ``decode`` of one text."""

    def __init__(self, model: bytes):
        self.ids: dict[str, int] = {}
        self.spelled: list[bytes] = []
        self.cost: list[float] = []
        self.bytes: dict[int, int] = {}
        self.kind, self.prefix = UNIGRAM, True
        for field, value in _fields(model):
            if field == 1:
                self._add_piece(dict(_fields(value)))
            elif field == 2:
                self.kind = dict(_fields(value)).get(3, UNIGRAM)
            elif field == 3:
                rule = dict(_fields(value))
                if rule.get(2) or rule.get(4, 1) or not rule.get(5, 1):
                    raise ValueError("only models that leave characters and blanks as they are can be compiled")
                self.prefix = bool(rule.get(3, 1))
        if self.kind not in (UNIGRAM, BPE) or len(self.bytes) < 256:
            raise ValueError("only unigram and BPE models with byte fallback can be compiled")
        self.name = {number: piece for piece, number in self.ids.items()}
        spelled = [self.name.get(number, "") for number in range(len(self.spelled))]
        self.arcs: dict = {}  # states as dicts from characters to states; "" gives the id of a piece
        for piece, number in self.ids.items():
            state = self.arcs
            for character in piece:
                state = state.setdefault(character, {})
            state[""] = number
        self.length = [len(piece) for piece in spelled] + [1, 0]  # the last two: byte fallback, nothing
        self.shorter = [self._beginning(piece) for piece in spelled] + [NOTHING, NOTHING]
        self.parts = re.compile(self._cuts())
        self.known: dict[str, bytes] = {}  # a part's ids, as 32-bit numbers
        self.older: dict[str, bytes] = {}
        self.held = 0
        self.beside: dict[int, bool] = {}

    def _add_piece(self, fields: dict) -> None:
        text, kind = fields[1].decode(), fields.get(3, NORMAL)
        number = len(self.spelled)
        self.cost.append(-float(np.frombuffer(fields[2], "<f4")[0]) if 2 in fields else 0.0)
        if kind == BYTE:
            self.bytes[int(text[3:5], 16)] = number
            self.spelled.append(bytes([int(text[3:5], 16)]))
        elif kind in (NORMAL, USER):
            self.ids[text] = number
            self.spelled.append(text.replace(SPACE, " ").encode())
        else:
            self.spelled.append(b"")

    def _cuts(self) -> str:
        """The parts of a text that no piece reaches across, as a pattern."""
        beside = {pair for piece in self.ids for pair in zip(piece, piece[1:])}
        joined = {c for pair in beside for c in pair}
        stop = "".join(c for c in "\n\r\t" if c not in joined and c not in self.ids)
        end, sign = re.escape(stop), rf"[{re.escape(stop)}]|" if stop else ""
        if any(SPACE in piece.lstrip(SPACE) for piece in self.ids):
            return rf"{sign}[^{end}]+" if stop else r"(?s:.)+"
        # Letters after which no piece goes on with anything else: a part ends after a run of them.
        letters, mixed = re.compile(r"[^\W\d_]"), set()
        while more := {a for a, b in beside if letters.match(a) and a not in mixed and (not letters.match(b) or b in mixed)}:
            mixed |= more
        others = re.escape("".join(sorted(mixed)))
        lead = rf"(?:[^\w{SPACE}{end}]|[\d_{others}])"
        return rf"{sign}{SPACE}*{lead}*[^\W\d_{others}]+|{SPACE}*{lead}+|{SPACE}+"

    def _beginning(self, piece: str) -> int:
        """The longest other piece that begins ``piece``; without any, byte fallback follows a longer one."""
        ends = range(len(piece) - 1, 0, -1)
        return next((self.ids[piece[:end]] for end in ends if piece[:end] in self.ids), FALLBACK if len(piece) > 1 else NOTHING)

    def merged(self, text: str) -> list[str]:
        """Pieces of a short text by merging the best neighbours, the first at a tie."""
        parts, ids, cost = list(text), self.ids, self.cost
        while True:
            best, at = float("inf"), -1
            for k in range(len(parts) - 1):
                number = ids.get(parts[k] + parts[k + 1])
                if number is not None and cost[number] < best:
                    best, at = cost[number], k
            if at < 0:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def _stands(self, last: int, number: int, piece: str) -> bool:
        """Whether a merge model leaves ``piece`` beside ``last`` (-1: at a cut or after bytes)."""
        if len(self.beside) >= NEIGHBOURS:
            self.beside.clear()
        before = [self.name[last]] if last >= 0 else []
        stands = self.beside[last << 32 | number] = self.merged("".join(before) + piece) == [*before, piece]
        return stands

    def _longest(self, part: str, start: int) -> int:
        """The longest piece along the arcs from ``start``, or the arc of byte fallback."""
        state, number, size = self.arcs.get(part[start]), FALLBACK, len(part)
        while state is not None:
            number = state.get("", number)
            start += 1
            state = state.get(part[start]) if start < size else None
        return number

    def _shortest_merged(self, part: str) -> bytes:
        """Shortest path of a merge model: its finite costs are all zero, so a path found is shortest.

        From each place the longest piece is tried first, then its beginnings, byte fallback
        last. A place has one last piece at most to which a path of finite cost leads, so a
        place without a way on is not entered again.
        """
        size, beside, shorter, length = len(part), self.beside, self.shorter, self.length
        path, dead, at, last, number = [], set(), 0, -1, self._longest(part, 0)
        while True:
            while number != NOTHING:
                end = at + length[number]
                if end not in dead:
                    stands = number == FALLBACK or beside.get(last << 32 | number)
                    if stands or stands is None and self._stands(last, number, part[at:end]):
                        break
                number = shorter[number]
            if number != NOTHING:
                path.append(number)
                if end == size:
                    break
                at, last = end, max(number, -1)
                number = self._longest(part, at)
            else:  # back to the place before, and on with the next piece there
                dead.add(at)
                number = path.pop()
                at, last = at - length[number], max(path[-1], -1) if path else -1
                number = shorter[number]
        if FALLBACK not in path:
            return array("i", path).tobytes()
        ids, at = array("i"), 0
        for number in path:
            ids.extend([number] if number >= 0 else [self.bytes[b] for b in part[at].encode()])
            at += length[number]
        return ids.tobytes()

    def _shortest_summed(self, part: str) -> bytes:
        """Shortest path where each piece has a cost; a character's bytes cost most of all."""
        size, root = len(part), self.arcs
        cost, back = [0.0] + [float("inf")] * size, [(0, -1)] * (size + 1)
        fallback = max(self.cost) + 10.0
        for start in range(size):
            if cost[start] + fallback < cost[start + 1]:
                cost[start + 1], back[start + 1] = cost[start] + fallback, (start, -1)
            state, end = root.get(part[start]), start
            while state is not None:
                end += 1
                number = state.get("")
                if number is not None and cost[start] + self.cost[number] < cost[end]:
                    cost[end], back[end] = cost[start] + self.cost[number], (start, number)
                state = state.get(part[end]) if end < size else None
        path, end = [], size
        while end:
            start, number = back[end]
            path.append((number,) if number >= 0 else [self.bytes[b] for b in part[start].encode()])
            end = start
        return array("i", [number for ids in reversed(path) for number in ids]).tobytes()

    def _composed(self, part: str) -> bytes:
        ids = self.older.get(part)
        if ids is None:
            ids = self._shortest_merged(part) if self.kind == BPE else self._shortest_summed(part)
        if len(part) <= 64:
            if len(self.known) >= REMEMBERED or self.held >= REMEMBERED_BYTES:
                self.known, self.older, self.held = {}, self.known, 0
            self.known[part] = ids
            self.held += 4 * len(part) + len(ids)
        return ids

    def encode(self, text: str) -> np.ndarray:
        if not text:
            return np.array([], np.int32)
        known = self.known.get
        parts = self.parts.findall((SPACE if self.prefix else "") + text.replace(" ", SPACE))
        return np.frombuffer(b"".join([known(part) or self._composed(part) for part in parts]), np.int32)

    def decode(self, ids) -> str:
        data = b"".join(map(self.spelled.__getitem__, ids))
        return (data[1:] if self.prefix and data[:1] == b" " else data).decode("utf-8", "replace")


def compiled(model: bytes) -> Transducer:
    return Transducer(model)


def read_model(path: str = MODEL) -> bytes:
    """The model file, read where the job is planned and sent along with its tasks."""
    with open(path, "rb") as file:
        return file.read()


def encode(docs: DataFrame, model: bytes, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``doc_id``, ``ids``, ``n_ids`` and whether decoding gives the text back."""

    def run(batch: pa.RecordBatch, machine: Transducer) -> pa.RecordBatch:
        encoded, exact = [], []
        for value in batch.column("text").to_pylist():
            ids = machine.encode(value or "")
            exact.append(machine.decode(ids.tolist()) == (value or "").replace(SPACE, " "))
            encoded.append(ids)
        ends = np.cumsum([0, *map(len, encoded)])
        lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(encoded)))
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), lists, pa.array(np.diff(ends), pa.int64()), pa.array(exact, pa.bool_())],
            names=["doc_id", "ids", "n_ids", "exact"],
        )

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    schema = rows.select("doc_id").schema.add("ids", ArrayType(IntegerType())).add("n_ids", "long").add("exact", "boolean")
    return by_batch(rows, run, schema, lambda: compiled(model))


def decode(encoded: DataFrame, model: bytes, ids: str = "ids") -> DataFrame:
    """``encoded`` with the column ``text`` that its ids stand for; null ids are none."""

    def run(batch: pa.RecordBatch, machine: Transducer) -> pa.RecordBatch:
        texts = [machine.decode(x or []) for x in batch.column("_ids").to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column("row"), pa.array(texts, pa.string())], names=["row", "text"])

    rows = encoded.select(F.struct(*[F.col(f"`{c}`") for c in encoded.columns if c != "text"]).alias("row"), F.col(ids).alias("_ids"))
    made = by_batch(rows, run, rows.select("row").schema.add("text", "string"), lambda: compiled(model))
    return made.select("row.*", "text")


def query(spark, folder: str) -> DataFrame:
    """``op3``: the ids of every document."""
    return encode(table(spark, folder, "documents"), read_model())
