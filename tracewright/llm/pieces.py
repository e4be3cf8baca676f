"""SentencePiece encoding and decoding.

An Aho-Corasick automaton over the pieces reads a text once. At each position
it follows the output links, so it meets every piece that ends there, longest
first, and relaxes the best way to reach the position. For unigram models the
best way is the highest sum of scores. In BPE models scores rank merges, and
a way is as the library has it only if no merge would cross the boundary
between two neighbouring pieces; of the pieces that end at a position exactly
one passes that test against the best way so far, and that one is taken.
"""

from __future__ import annotations

import re
import struct
import zlib
from array import array
from collections.abc import Iterator
from itertools import islice

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from tracewright.llm.batches import held, map_batches, texts_of

SPACE = "▁"
UNIGRAM, BPE = 1, 2
NORMAL, USER_DEFINED, BYTE = 1, 4, 6
_UNIT = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Field numbers and values of a protocol-buffer message."""

    def number(i: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            value |= (data[i] & 0x7F) << shift
            i, shift = i + 1, shift + 7
            if data[i - 1] < 0x80:
                return value, i

    i = 0
    while i < len(data):
        tag, i = number(i)
        if tag & 7 == 0:
            value, i = number(i)
        else:
            size, i = (8, i) if tag & 7 == 1 else (4, i) if tag & 7 == 5 else number(i)
            value, i = data[i : i + size], i + size
        yield tag >> 3, value


class PieceModel:
    """A .model file: pieces, scores, kinds; identity normalization only."""

    def __init__(self, data: bytes, remembered: int = 400_000):
        self.pieces, self.scores, kinds = [], [], []
        self.kind, self.prefix, unknown = UNIGRAM, True, 0
        for k, v in fields(data):
            if k == 1:
                piece = dict(fields(v))
                self.pieces.append(piece[1].decode())
                self.scores.append(struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0)
                kinds.append(piece.get(3, NORMAL))
            elif k == 2:
                self.kind = dict(fields(v)).get(3, UNIGRAM)
            elif k == 3:
                spec = dict(fields(v))
                self.prefix = bool(spec.get(3, 1))
                if spec.get(2) or spec.get(4, 1):
                    raise ValueError("only models without a normalization table that keep white space are read")
        if self.kind not in (UNIGRAM, BPE) or USER_DEFINED in kinds:
            raise ValueError("only unigram and BPE models without user-defined pieces are read")
        self.unknown = kinds.index(2) if 2 in kinds else unknown
        self.of_byte = {int(self.pieces[i][1:-1], 16): i for i, k in enumerate(kinds) if k == BYTE}
        self.id_of = {p: i for i, (p, k) in enumerate(zip(self.pieces, kinds, strict=True)) if k == NORMAL}
        self.automaton = ahocorasick.Automaton()
        for p, i in self.id_of.items():
            self.automaton.add_word(p, (i, len(p)))
        self.automaton.make_automaton()
        single = "".join(re.escape(p) for p in self.id_of if len(p) == 1)
        self.known_run = re.compile(f"[{single}]+|[^{single}]+")
        self.written = [p.replace(SPACE, " ").encode() if k == NORMAL else b"" for p, k in zip(self.pieces, kinds, strict=True)]
        for b, i in self.of_byte.items():
            self.written[i] = bytes([b])
        self.pairs: dict[tuple[int, int], bool] = {}
        self.remembered: dict[str, tuple[int, ...]] = {}
        self.limit = remembered

    def merged(self, text: str) -> list[str]:
        """The text's pieces by repeated merges, best score first, the left of equals."""
        parts = list(text)
        while len(parts) > 1:
            best = max(((self.scores[self.id_of[a + b]], -i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in self.id_of), default=None)
            if best is None:
                break
            parts[-best[1] : 2 - best[1]] = [parts[-best[1]] + parts[1 - best[1]]]
        return parts

    def stays(self, left: int, right: int) -> bool:
        """Whether merges leave the boundary between the two pieces alone."""
        if (known := self.pairs.get((left, right))) is None:
            a, b = self.pieces[left], self.pieces[right]
            if len(self.pairs) > self.limit:
                self.pairs.clear()
            known = self.pairs[left, right] = self.merged(a + b) == [a, b]
        return known

    def path(self, run: str) -> list[int]:
        """Ids of a run of known characters, in one pass of the automaton."""
        if len(run) == 1:
            return [self.id_of[run]]
        last, best = [(-1, 0)] * (len(run) + 1), [None] * (len(run) + 1)
        best[0] = 0.0
        for end, (piece, size) in self.automaton.iter(run):
            start, end = end + 1 - size, end + 1
            if best[start] is None:
                continue
            if self.kind == UNIGRAM:
                total = best[start] + self.scores[piece]
                if best[end] is None or total > best[end]:
                    best[end], last[end] = total, (piece, size)
            elif best[end] is None and (not start or self.stays(last[start][0], piece)):
                best[end], last[end] = 0.0, (piece, size)
        at, found = len(run), []
        while at:
            piece, size = last[at]
            found.append(piece)
            at -= size
        return found[::-1]

    def unit(self, unit: str) -> tuple[int, ...]:
        if (ids := self.remembered.get(unit)) is None:
            own = []
            for run in self.known_run.findall(unit):
                if run[0] in self.id_of:
                    own += self.path(run)
                elif self.of_byte:
                    own += [self.of_byte[b] for b in run.encode()]
                else:
                    own += [self.unknown] * len(run)
            if len(self.remembered) >= self.limit:  # what was met first is met most often: the first half stays
                self.remembered = dict(islice(self.remembered.items(), self.limit // 2))
            ids = self.remembered[unit] = tuple(own)
        return ids

    def encode(self, text: str) -> list[int]:
        """Ids of the text, without begin and end."""
        if not text:
            return []
        text = (SPACE if self.prefix else "") + text.replace(" ", SPACE)
        return [i for u in _UNIT.findall(text) for i in self.unit(u)]

    def decode(self, ids: list[int]) -> str:
        """The text of the ids. Exact for texts that don't hold U+2581, which stands for a space."""
        text = b"".join(map(self.written.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if self.prefix and text.startswith(" ") else text


def model_of(data: bytes) -> PieceModel:
    return held(("pieces", hash(data)), lambda: PieceModel(data))


def encode(docs: DataFrame, model: bytes) -> DataFrame:
    """doc_id and the ids of every whole text; null and empty texts have none; repeated rows are encoded each."""
    told = docs.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch) -> dict:
        own = model_of(told.value)
        return {"doc_id": batch.column("doc_id"), "ids": [own.encode(t) for t in texts_of(batch)]}

    return map_batches(docs.select("doc_id", "text"), run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, model: bytes) -> DataFrame:
    """doc_id and the text of the ids; null and empty arrays give empty texts."""
    told = encoded.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch) -> dict:
        own = model_of(told.value)
        return {"doc_id": batch.column("doc_id"), "text": [own.decode(i or []) for i in batch.column("ids").to_pylist()]}

    return map_batches(encoded.select("doc_id", "ids"), run, "doc_id long, text string")


def round_trip(docs: DataFrame, model: bytes) -> DataFrame:
    """Per document: ids, their number and CRC-32 (little-endian unsigned 32-bit), and whether they decode to the text.

    Null and empty texts have no ids and return; repeated rows are kept; extra columns are ignored.
    """
    told = docs.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch) -> dict:
        own, texts = model_of(told.value), texts_of(batch)
        ids = [own.encode(t) for t in texts]
        return {
            "doc_id": batch.column("doc_id"),
            "n_tokens": [len(i) for i in ids],
            "ids_crc32": [zlib.crc32(array("I", i)) for i in ids],
            "returns": [own.decode(i) == t for i, t in zip(ids, texts, strict=True)],
        }

    return map_batches(docs.select("doc_id", "text"), run, "doc_id long, n_tokens long, ids_crc32 long, returns boolean")
