"""Token counts by rank-synchronous array merging.

Pre-tokens are held as one flat array of symbol ids with sequence
boundaries (a ragged batch). In each round every sequence finds its pair of
lowest rank, and all sequences replace all occurrences of their pair at
once. Symbols that survive are the tokens.
"""

from __future__ import annotations

import json
import re

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.llm.batches import held, map_batches, texts_of

#: Fixed value: the public pre-token pattern of byte-level BPE vocabularies.
PRETOKENS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: White space outside ASCII (and the ASCII separators that only some classes hold).
_ODD_SPACE = re.compile(r"[^\S \t-\r]|[\x1c-\x1f]")
#: White space, then what follows up to the next: no pre-token crosses such a unit's ends.
_UNIT = re.compile(r"[ \t-\r]*[^ \t-\r]+|[ \t-\r]+")
NO_RANK = np.iinfo(np.int64).max


def byte_symbols() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies: printable Latin-1 as it is, the rest from U+0100 on."""
    plain = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class RankMerger:
    """The merge table of a byte-level BPE vocabulary as sorted arrays."""

    def __init__(self, tokenizer_json: str | bytes):
        spec = json.loads(tokenizer_json)
        model, vocab = spec["model"], spec["model"]["vocab"]
        self.specials = [t["content"] for t in spec.get("added_tokens", []) if t["special"]]
        self.of_byte = np.array([vocab[s] for s in byte_symbols()], dtype=np.int64)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.base = max(vocab.values()) + 1
        left = np.array([vocab[a] for a, _ in pairs], dtype=np.int64)
        right = np.array([vocab[b] for _, b in pairs], dtype=np.int64)
        key = left * self.base + right
        order = np.argsort(key, kind="stable")
        self.keys, self.ranks = key[order], order.astype(np.int64)
        self.made = np.array([vocab[a + b] for a, b in pairs], dtype=np.int64)

    def pair_ranks(self, symbols: np.ndarray) -> np.ndarray:
        """Rank of each symbol with its right neighbour; NO_RANK where no merge exists."""
        key = symbols[:-1] * self.base + symbols[1:]
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NO_RANK)

    def counts(self, pretokens: list[bytes]) -> np.ndarray:
        """Tokens of each pre-token."""
        lengths = np.fromiter(map(len, pretokens), dtype=np.int64, count=len(pretokens))
        found, active = lengths.copy(), np.flatnonzero(lengths > 1)
        if not len(active):
            return found
        symbols = self.of_byte[np.frombuffer(b"".join(pretokens[i] for i in active), dtype=np.uint8)]
        owner = np.repeat(active, lengths[active])
        while len(symbols) > 1:
            rank = np.append(self.pair_ranks(symbols), NO_RANK)
            rank[:-1][owner[1:] != owner[:-1]] = NO_RANK
            first = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            lowest = np.minimum.reduceat(rank, first)
            size = np.diff(np.append(first, len(owner)))
            done = lowest == NO_RANK
            found[owner[first[done]]] = size[done]
            chosen = (rank == np.repeat(lowest, size)) & (rank != NO_RANK)
            # x x x: of overlapping occurrences the left ones merge, so every second of a run of neighbours
            at = np.flatnonzero(chosen)
            if len(at) > 1:
                starts = np.flatnonzero(np.append(True, np.diff(at) != 1))
                run = np.arange(len(at)) - np.repeat(starts, np.diff(np.append(starts, len(at))))
                equal = np.append(symbols[:-1] == symbols[1:], False)[at]
                at = at[~(equal & (run % 2 == 1))]
            symbols[at] = self.made[rank[at]]
            keep = ~np.repeat(done, size)
            keep[at + 1] = False
            symbols, owner = symbols[keep], owner[keep]
        if len(symbols):
            found[owner[0]] = len(symbols)
        return found


class TokenCounter:
    """Counts tokens of texts; remembers up to ``remembered`` units."""

    def __init__(self, tokenizer_json: str | bytes, remembered: int = 400_000):
        self.merger, self.remembered = RankMerger(tokenizer_json), remembered
        self.pretokens = regex.compile(PRETOKENS)
        self.cut = re.compile("|".join(map(re.escape, self.merger.specials))) if self.merger.specials else None
        self.known: dict[str, int] = {}

    def learn(self, units: set[str]) -> None:
        """Make every unit known; the new ones are merged in one ragged batch."""
        new = units.difference(self.known)
        if len(self.known) + len(new) > self.remembered:
            self.known.clear()
            new = units
        new = list(new)
        parts = [self.pretokens.findall(u) for u in new]
        flat = list({p for ps in parts for p in ps})
        of = dict(zip(flat, self.merger.counts([p.encode() for p in flat]).tolist(), strict=True))
        for u, ps in zip(new, parts, strict=True):
            self.known[u] = sum(of[p] for p in ps)

    def units(self, text: str) -> tuple[list[str], int]:
        """The text in units that are tokenized apart, and the number of special tokens in it."""
        parts = self.cut.split(text) if self.cut is not None and self.cut.search(text) else [text]
        found = [u for p in parts for u in ([p] if _ODD_SPACE.search(p) else _UNIT.findall(p))]
        return found, len(parts) - 1

    def count(self, texts: list[str]) -> list[int]:
        pieces = [self.units(t) for t in texts]
        self.learn({u for us, _ in pieces for u in us})
        return [sum(map(self.known.__getitem__, us)) + specials for us, specials in pieces]


def token_counts(docs: DataFrame, tokenizer_json: str | bytes, limit: int = 1024) -> DataFrame:
    """Byte and token counts of every whole text.

    Null and empty texts count 0; strings of special tokens count as that
    token, as the tokenizer's library does by default; repeated rows are
    counted each; columns other than doc_id and text are ignored; an empty
    table gives an empty result.
    """
    told = docs.sparkSession.sparkContext.broadcast(tokenizer_json)

    def run(batch: pa.RecordBatch) -> dict:
        counter = held(("counter", hash(told.value)), lambda: TokenCounter(told.value))
        return {"doc_id": batch.column("doc_id"), "n_tokens": counter.count(texts_of(batch))} | {"n_bytes": [len(t.encode()) for t in texts_of(batch)]}

    counted = map_batches(docs.select("doc_id", "text"), run, "doc_id long, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
