"""SentencePiece encoding and decoding as shortest paths of a weighted transducer.

The model is compiled on the driver: the normaliser (blanks become U+2581, a leading one is added), a transducer that reads the
characters of a piece and writes its number, and byte arcs for characters without a piece. Composed with a text this is a lattice
of positions, and the encoding is its path of least weight in the tropical semiring (min, +).

* ``unigram`` models weigh an arc by the piece's negative log probability.
* Scores of ``bpe`` models are ranks and do not add up to anything, so their arcs weigh 0, and the lattice is further composed with an
  acceptor over neighbours: two pieces may follow each other (weight 0) exactly if merging their joined characters gives these
  two pieces back, else the weight is infinite. Merging inside a final piece never looks beyond its neighbour, so each prefix has
  exactly one path of finite weight, and that path is the merge encoding.

Texts are cut where no piece can reach across, and the paths of the parts are remembered in a dictionary of bounded size. Of the beginnings
of a part only the last piece is remembered, which leads back along its path.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from rastrel.llm.common import Remembered

#: The blank of the piece alphabet, and the numbers of model and piece kinds in the model format.
BLANK = "▁"
UNIGRAM, BPE = 1, 2
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6

#: Parts up to this many characters are searched from the end, with the paths of their beginnings remembered.
SHORT = 40
#: Characters that are cut into parts at once.
STRETCH = 1 << 20
#: Texts whose numbers are held at once.
ROWS = 2048
#: Beginnings of parts whose last piece is remembered, before the older ones go; distinct parts a worker numbers before it starts again.
BEGINNINGS, PARTS = 100_000, 150_000
INF = float("inf")


@dataclass(frozen=True)
class Model:
    """What encoding needs of a model; small, and sent to the workers as it is."""

    kind: int
    pieces: list[tuple[str, float, int]]
    dummy_prefix: bool = True
    squeeze_blanks: bool = False


def load_model(spark: SparkSession, path: str) -> Model:
    """Read a model by Spark, so the path may lie in any store; models with rewriting rules or user-defined pieces are refused."""
    from sentencepiece import sentencepiece_model_pb2 as proto

    data = bytes(spark.read.format("binaryFile").load(path).select("content").first()[0])
    return parse_model(proto.ModelProto.FromString(data))


def parse_model(m) -> Model:
    if m.normalizer_spec.precompiled_charsmap or not m.normalizer_spec.escape_whitespaces or m.trainer_spec.treat_whitespace_as_suffix:
        raise ValueError("only models with the identity normaliser and blanks as prefixes are supported")
    if m.trainer_spec.model_type not in (UNIGRAM, BPE) or {p.type for p in m.pieces} - {NORMAL, UNKNOWN, CONTROL, BYTE}:
        raise ValueError("only unigram and bpe models of normal, unknown, control and byte pieces are supported")
    return Model(m.trainer_spec.model_type, [(p.piece, p.score, p.type) for p in m.pieces], m.normalizer_spec.add_dummy_prefix, m.normalizer_spec.remove_extra_whitespaces)


@dataclass
class Transducer:
    model: Model
    number: dict[str, int] = field(init=False)

    def __post_init__(self) -> None:
        pieces = self.model.pieces
        self.number = {p: i for i, (p, _, kind) in enumerate(pieces) if kind == NORMAL}
        self.weight = {p: -pieces[i][1] for p, i in self.number.items()}
        self.longest = max(map(len, self.number), default=1)
        self.prefixes = {p[:k] for p in self.number for k in range(1, len(p))}
        self.byte = {int(p[3:5], 16): i for i, (p, _, kind) in enumerate(pieces) if kind == BYTE}
        self.unknown = next((i for i, p in enumerate(pieces) if p[2] == UNKNOWN), 0)
        self.unknown_weight = max(self.weight.values(), default=0.0) + 10.0
        self.out = [bytes([int(p[3:5], 16)]) if kind == BYTE else b"" if kind == CONTROL else " ⁇ ".encode() if kind == UNKNOWN else p.replace(BLANK, " ").encode() for p, _, kind in pieces]
        self.merging = Remembered(self._merging, BEGINNINGS)
        self.may_follow = Remembered(self._may_follow, BEGINNINGS)
        self.path = Remembered(self._last_piece if self.model.kind == BPE else self._path, BEGINNINGS)
        self.part = Remembered(self._encode_part, BEGINNINGS)
        self.cut = re.compile(self._cuts(), re.S)

    def _cuts(self) -> str:
        """Parts that no piece can cross: around characters of no longer piece, and before blanks if none stands inside one."""
        if any(BLANK in p.lstrip(BLANK) for p in self.number):
            return ".+"
        joined = [p.lstrip(BLANK) for p in self.number if len(p) > 1]
        kind = {c: c for p in joined for c in p}  # characters that stand side by side in a piece lead to one of their kind

        def of(c: str) -> str:
            while kind[c] != c:
                kind[c] = c = kind[kind[c]]
            return c

        for a, b in ((a, b) for p in joined for a, b in pairwise(p)):
            kind[of(b)] = of(a)
        kinds: dict[str, list[str]] = {}
        for c in sorted(kind):  # unknown characters in a row are one piece, whatever their kind
            kinds.setdefault(of(c) if self.byte or self.model.kind == BPE else "", []).append(re.escape(c))
        inside, runs = "".join(chain.from_iterable(kinds.values())), "|".join(f"[{''.join(x)}]+" for x in kinds.values())
        return f"[^{inside}{BLANK}]|{BLANK}*(?:{runs})|{BLANK}+" if inside else "."

    def _merging(self, text: str) -> tuple[list[float], list[str], list[str], bool]:
        """Merging alone: the weight of each step, the first and the last part before each step and at the end, and whether
        one part is left. A step joins the neighbours that make the piece of least weight, leftmost first."""
        parts, steps, first, last = list(text), [], [text[:1]], [text[-1:]]
        while True:
            least, at = INF, -1
            for k in range(len(parts) - 1):
                w = self.weight.get(parts[k] + parts[k + 1], INF)
                if w < least:
                    least, at = w, k
            if at < 0:
                return steps, first, last, len(parts) == 1
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            steps.append(least)
            first.append(parts[0])
            last.append(parts[-1])

    def _may_follow(self, pair: tuple[str, str]) -> bool:
        """Whether merging the joined characters ends in this pair: no step across the boundary ever comes first."""
        before, piece = pair
        right, first, _, whole = self.merging[piece]
        if not whole or before + piece in self.weight and before:
            return False
        if not before:
            return True
        left, _, last, _ = self.merging[before]
        i = j = 0
        while True:
            across = self.weight.get(last[i] + first[j], INF)
            a = left[i] if i < len(left) else INF
            b = right[j] if j < len(right) else INF
            if across < a and across <= b:
                return False
            if a == b == INF:
                return True
            if a <= b:
                i += 1
            else:
                j += 1

    def shortest_path(self, text: str) -> list[str]:
        """Pieces along the path of least weight; of equal ones, the path whose last piece is longest."""
        n, prefixes, number, ranks = len(text), self.prefixes, self.number, self.model.kind == BPE
        best, last, start = [0.0] + [INF] * n, [""] * (n + 1), [0] * (n + 1)
        for i in range(n):
            so_far, before = best[i], last[i]
            for k in range(i + 1, n + 1):
                p = text[i:k]
                if so_far < best[k] and (p in number or k == i + 1):
                    if ranks:
                        w = 0.0 if self.may_follow[before, p] else INF
                    else:
                        w = so_far + self.weight.get(p, self.unknown_weight)
                    if w < best[k]:
                        best[k], last[k], start[k] = w, p, i
                if p not in prefixes:
                    break
        out, i = [], n
        while i:
            out.append(last[i])
            i = start[i]
        return out[::-1]

    def _ids(self, piece: str) -> tuple[int, ...]:
        if piece in self.number:
            return (self.number[piece],)
        return tuple(self.byte[b] for b in piece.encode()) if self.byte else (self.unknown,)

    def _last_piece(self, text: str) -> str:
        """The same search from the end, for merges: the last piece of the one path of finite weight, from those of the beginnings
        of the text. Words share beginnings, so most of them are known."""
        number, may_follow, known = self.number, self.may_follow, self.path
        for size in range(min(len(text), self.longest), 0, -1):
            p = text[-size:]
            if p in number or size == 1:
                before = text[:-size]
                if may_follow[known[before] if before else "", p]:
                    return p
        raise AssertionError("every text has a path")

    def _path(self, text: str) -> tuple[float, str]:
        """The same for weights that add up: weight and last piece of the best path."""
        best = (INF, "")
        for size in range(min(len(text), self.longest), 0, -1):
            p = text[-size:]
            if p in self.number or size == 1:
                w = (self.path[text[:-size]][0] if size < len(text) else 0.0) + self.weight.get(p, self.unknown_weight)
                if w < best[0]:
                    best = (w, p)
        return best

    def _pieces(self, text: str) -> list[str]:
        """Back along the path of least weight of a short text."""
        out, ranks = [], self.model.kind == BPE
        while text:
            p = self.path[text] if ranks else self.path[text][1]
            out.append(p)
            text = text[: -len(p)]
        return out[::-1]

    def _encode_part(self, text: str) -> tuple[int, ...]:
        number, found = self.number, self._pieces(text) if len(text) <= SHORT else self.shortest_path(text)
        try:
            ids = tuple([number[p] for p in found])
        except KeyError:
            ids = tuple(chain.from_iterable(map(self._ids, found)))
        if not self.byte and self.model.kind == UNIGRAM:  # unknown characters in a row are one unknown piece
            ids = tuple(i for k, i in enumerate(ids) if i != self.unknown or not k or ids[k - 1] != i)
        return ids

    def normalise(self, text: str) -> str:
        if self.model.squeeze_blanks:
            text = re.sub(" +", " ", text).strip(" ")
        return (BLANK if self.model.dummy_prefix and text else "") + text.replace(" ", BLANK)

    def parts(self, text: str) -> Iterator[list[str]]:
        """The parts of a text, some at a time."""
        plain, at = self.normalise(text), 0
        while at < len(plain):
            parts = self.cut.findall(plain, at, at + STRETCH)
            if at + STRETCH < len(plain) and len(parts) > 1:
                parts.pop()  # it may go on
            elif at + STRETCH < len(plain):
                parts = [self.cut.match(plain, at)[0]]
            at += sum(map(len, parts)) if at + STRETCH < len(plain) else STRETCH
            yield parts

    def encode(self, text: str) -> array:
        return array("i", chain.from_iterable(map(self.part.__getitem__, chain.from_iterable(self.parts(text)))))

    def decode(self, ids) -> str:
        data = b"".join(map(self.out.__getitem__, ids))
        if self.model.dummy_prefix and data[:1] == b" ":
            data = data[1:]
        return data.decode("utf-8", "replace")


class Parts(dict):
    """Numbers of distinct parts, with their piece numbers one after the other, so that many texts are put together at once."""

    def __init__(self, machine: Transducer):
        super().__init__()
        self.machine = machine
        self.forget()

    def forget(self) -> None:
        self.clear()
        self.ids, self.size, self.exact = array("i"), array("i"), bytearray()

    def __missing__(self, part: str) -> int:
        machine = self.machine
        ids = machine._encode_part(part)
        self[part] = number = len(self.size)
        self.ids.extend(ids)
        self.size.append(len(ids))
        self.exact.append(b"".join([machine.out[i] for i in ids]) == part.replace(BLANK, " ").encode())
        return number

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, list[bool]]:
        """The piece numbers of all texts, how many each has, and whether decoding gives it back."""
        machine = self.machine
        found = [[np.fromiter(map(self.__getitem__, p), np.int32, len(p)) for p in machine.parts(t)] for t in texts]
        size = np.array(self.size, np.int64)
        start, ids, exact = np.cumsum(size) - size, np.array(self.ids, np.int32), np.array(self.exact, bool)
        out, lengths, same = [np.zeros(0, np.int32)], np.zeros(len(texts), np.int64), []
        for k, (text, some) in enumerate(zip(texts, found, strict=True)):
            own, whole = len(out), True
            for numbers in some:
                each = size[numbers]
                ends = np.cumsum(each)
                out.append(ids[np.repeat(start[numbers] - ends + each, each) + np.arange(ends[-1])])
                lengths[k] += ends[-1]
                whole = whole and bool(exact[numbers].all())
            # parts that come back as they were make up the text, but for blanks that the normaliser changes
            if whole and BLANK not in text and not machine.model.squeeze_blanks:
                same.append(True)
            else:
                same.append(machine.decode(np.concatenate(out[own:]).tolist() if len(out) > own else []) == text)
        if len(self) > PARTS:
            self.forget()
        return np.concatenate(out), lengths, same


def encode(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep``, ``ids`` (array of int), ``n_ids`` and ``round_trip`` (decoding the ids gives the text) for every row.

    Null and empty texts have no ids, and count as equal to the empty decoding. Characters without a piece become their UTF-8
    bytes, so any text comes back as it was; only a literal U+2581 is read back as a blank, as with the library. Repeated rows
    are encoded each; other columns are not read, and ``keep`` may not name the new ones.
    """
    if {"ids", "n_ids", "round_trip"} & set(keep):
        raise ValueError("the columns to keep clash with the new ones")
    rows = docs.select(*keep, "text")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Parts(Transducer(shared.value))
        for batch in (whole.slice(low, ROWS) for whole in batches for low in range(0, whole.num_rows, ROWS)):
            found, lengths, same = known.encode([t.as_py() or "" for t in batch.column(len(keep))])
            offsets = pa.array(np.cumsum(np.r_[0, lengths]), pa.int64()).cast(pa.int32())
            ids = pa.ListArray.from_arrays(offsets, pa.array(found, pa.int32()))
            yield pa.record_batch([*batch.columns[:-1], ids, pa.array(lengths), pa.array(same, pa.bool_())], names=[*keep, "ids", "n_ids", "round_trip"])

    kinds = dict(rows.dtypes)
    return rows.mapInArrow(run, ", ".join(f"`{c}` {kinds[c]}" for c in keep) + ", ids array<int>, n_ids long, round_trip boolean")


def decode(rows: DataFrame, model: Model, ids: str = "ids") -> DataFrame:
    """All columns as ``row`` and the ``text`` their ids stand for; null ids give a null text, numbers of no piece an error."""
    from pyspark.sql import functions as F

    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = Transducer(shared.value)
        for batch in batches:
            texts = [None if x is None else machine.decode(x) for x in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array(texts, pa.string())], names=["row", "text"])

    packed = rows.select(F.struct("*").alias("row"), F.col(ids).alias("ids"))
    return packed.mapInArrow(run, f"row {dict(packed.dtypes)['row']}, text string")
