"""Word-shingle hashes of texts, in numpy over whole batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

U = np.uint64
BASE, SECOND = U(0x9E3779B97F4A7C15 | 1), U(0xD6E8FEB86659FD93)
_TABLE = np.random.default_rng(20_231).integers(1, 1 << 63, 256, dtype=np.uint64)
_POWERS: dict[str, np.ndarray] = {}
#: Bytes of text hashed at a time; a longer text alone is taken whole.
CHUNK = 1 << 18


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE and its inverse modulo 2**64, to the powers 0 to n - 1."""
    if len(_POWERS.get("up", ())) < n:
        size = max(n, 1 << 16)
        inverse = U(pow(int(BASE), -1, 1 << 64))
        for name, base in (("up", BASE), ("down", inverse)):
            factors = np.full(size, base, dtype=U)
            factors[0] = 1
            _POWERS[name] = np.multiply.accumulate(factors)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads every bit."""
    x = x ^ (x >> U(32))
    x = x * SECOND
    x ^= x >> U(29)
    x *= BASE
    return x ^ (x >> U(32))


def chunks(texts: list[str]) -> Iterator[list[bytes]]:
    """The texts in groups of about CHUNK bytes."""
    group, size = [], 0
    for t in texts:
        data = t.encode()
        if group and size + len(data) > CHUNK:
            yield group
            group, size = [], 0
        group.append(data)
        size += len(data)
    if group:
        yield group


def word_hashes(group: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words (A-Z lower-cased, ASCII white space between) of all texts, and each one's text."""
    data = np.frombuffer(b"\n".join(group) + b"\n", dtype=np.uint8)
    lowered = np.where((data >= 65) & (data <= 90), data | 32, data)
    gap = (data == 32) | ((data >= 9) & (data <= 13))
    edge = np.flatnonzero(np.diff(np.concatenate(([True], gap)).astype(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    up, down = powers(len(data))
    total = np.concatenate((np.zeros(1, U), np.cumsum(_TABLE[lowered] * up, dtype=U)))
    hashes = mixed((total[ends] - total[starts]) * down[starts])
    first = np.cumsum([0] + [len(g) + 1 for g in group[:-1]])
    return hashes, np.searchsorted(first, starts, side="right") - 1


def shingle_sets(texts: list[str], size: int) -> Iterator[np.ndarray]:
    """Per text, the sorted distinct hashes of its shingles of ``size`` words; fewer words are one shingle, none none."""
    for group in chunks(texts):
        words, text = word_hashes(group)
        made = np.zeros(max(0, len(words) - size + 1), dtype=U)
        for k in range(size):
            made = mixed(made + words[k : k + len(made)] + U(k + 1))
        owner = text[: len(made)]
        whole = owner == text[size - 1 :] if len(made) else np.zeros(0, bool)
        made, owner = made[whole], owner[whole]
        cuts = np.searchsorted(owner, np.arange(len(group) + 1))
        counts = np.searchsorted(text, np.arange(len(group) + 1))
        for i in range(len(group)):
            if cuts[i + 1] > cuts[i]:
                yield np.unique(made[cuts[i] : cuts[i + 1]])
            elif counts[i + 1] > counts[i]:
                own = np.zeros(1, dtype=U)
                for k in range(counts[i], counts[i + 1]):
                    own = mixed(own + words[k : k + 1] + U(k - counts[i] + 101))
                yield own
            else:
                yield np.zeros(0, dtype=U)
