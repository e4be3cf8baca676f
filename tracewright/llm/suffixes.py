"""Suffix arrays by two-stage sorting, and anchors that bring equal strings together."""

from __future__ import annotations

import numpy as np

from tracewright.llm.shingles import _TABLE, U, mixed, powers

GRAM = 64
#: Bytes of a text looked at in one piece; pieces overlap, so no string is cut.
PIECE = 8 << 20
_PLACE = U((1 << 26) - 1)


def suffix_array(text: bytes, depth: int) -> np.ndarray:
    """Starts of all suffixes in the order of their first ``depth`` bytes.

    Only suffixes smaller than their successors are sorted directly. The
    others are induced by a scan of the buckets of first bytes: whoever comes
    before a suffix already placed, and is larger than it, goes to the next
    free place of its own bucket.
    """
    n = len(text)
    if n < 2:
        return np.arange(n)
    data = np.frombuffer(text, dtype=np.uint8)
    rises = np.append(data[:-1] < data[1:], False)  # the last is larger than the empty suffix
    differs = np.append(data[:-1] != data[1:], True)
    decider = np.flatnonzero(differs)
    smaller = rises[decider[np.searchsorted(decider, np.arange(n))]]
    # by first byte, so that the keys of one bucket alone are held at a time
    direct = np.flatnonzero(smaller)
    direct = direct[np.argsort(data[direct], kind="stable")]
    edges = np.searchsorted(data[direct], np.arange(257)).tolist()
    for a, b in zip(edges, edges[1:]):
        if b - a > 1:
            direct[a:b] = sorted(direct[a:b].tolist(), key=lambda i: text[i : i + depth])
    cuts = np.searchsorted(data[direct], np.arange(257)) if len(direct) else np.zeros(257, int)
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
    waiting[data[-1]].append(np.array([n - 1]))
    order = []

    def induce(placed: np.ndarray, own: int) -> np.ndarray:
        """Sends those before ``placed`` to their buckets; returns the ones of this bucket."""
        before = placed[placed > 0] - 1
        before = before[~smaller[before]]
        if not len(before):
            return before
        first = data[before]
        by = np.argsort(first, kind="stable")
        before, first = before[by], first[by]
        edges = np.flatnonzero(np.append(True, first[1:] != first[:-1]))
        inside = before[:0]
        for a, b in zip(edges, np.append(edges[1:], len(before)), strict=True):
            if first[a] == own:
                inside = before[a:b]
            else:
                waiting[first[a]].append(before[a:b])
        return inside

    for c in range(256):
        larger, k = waiting[c], 0
        while k < len(larger):  # a run of one byte grows by a place in each turn
            if len(inside := induce(larger[k], c)):
                larger.append(inside)
            k += 1
        order += larger
        if cuts[c + 1] > cuts[c]:
            own = direct[cuts[c] : cuts[c + 1]]
            induce(own, c)
            order.append(own)
    return np.concatenate(order)


def common_prefixes(text: bytes, one: np.ndarray, other: np.ndarray, limit: int) -> np.ndarray:
    """Bytes that the suffixes at ``one`` and ``other`` share from their start, pair by pair, at most ``limit``.

    All pairs are compared eight bytes at a time; pairs that differ drop out.
    """
    padded = np.frombuffer(text + bytes(limit + 8), dtype=np.uint8)
    eights = np.ndarray((len(text) + limit,), dtype="<u8", buffer=padded.data, strides=(1,))
    shared = np.full(len(one), limit, dtype=np.int64)
    alike = np.arange(len(one))
    for k in range(0, limit, 8):
        differ = eights[one[alike] + k] ^ eights[other[alike] + k]
        apart = np.flatnonzero(differ)
        if len(apart):
            lowest = differ[apart] & (~differ[apart] + U(1))
            shared[alike[apart]] = np.minimum(limit, k + (np.log2(lowest.astype(np.float64)).astype(np.int64) >> 3))
            alike = alike[differ == 0]
        if not len(alike):
            break
    return np.minimum(shared, len(text) - np.maximum(one, other))


def repeated_starts(segments: list[bytes], starts: list[int], weights: list[int], length: int) -> list[np.ndarray]:
    """Per segment, which of its first ``starts`` places begin a string of ``length`` that begins at another place too.

    ``weights``: how many copies of the segment the corpus holds; two or more repeat all its strings.
    A string repeats if its suffix shares ``length`` bytes with the suffix before or after it in order.
    """
    text = b"".join(segments)
    offsets = np.cumsum([0] + [len(s) for s in segments])
    valid = np.zeros(len(text) + 1, dtype=bool)
    for a, k in zip(offsets.tolist(), starts, strict=False):
        valid[a : a + k] = True
    places = suffix_array(text, length)
    places = places[valid[places]]
    same = common_prefixes(text, places[:-1], places[1:], length) >= length
    repeated = np.zeros(len(text), dtype=bool)
    repeated[places[:-1][same]] = True
    repeated[places[1:][same]] = True
    return [repeated[a : a + k] | (w > 1) for a, k, w in zip(offsets.tolist(), starts, weights, strict=False)]


def runs(marks: np.ndarray) -> np.ndarray:
    """(first, last) of each run of true marks."""
    edge = np.flatnonzero(np.diff(np.concatenate(([False], marks, [False])).astype(np.int8)))
    return np.stack([edge[::2], edge[1::2] - 1], axis=1)


def pieces(texts: list[bytes], length: int) -> list[tuple[int, int, bytes]]:
    """(text, offset, bytes): long texts in pieces that overlap by a string less one."""
    return [(k, a, t[a : a + PIECE + length - 1]) for k, t in enumerate(texts) for a in range(0, max(1, len(t) - length + 1), PIECE) if len(t) - a >= length]


def anchors(texts: list[bytes], length: int) -> list[np.ndarray]:
    """Per text, rows (first start, width, place of the anchor, anchor, content).

    Every string of ``length`` has one anchor: of its GRAM-grams the one of
    least hash, the left of equals. Neighbouring starts of one anchor are one
    row; equal strings have equal anchors at equal places, so only rows of one
    anchor need comparing. ``content`` is a hash of all the row's bytes.
    """
    found: list[list[np.ndarray]] = [[] for _ in texts]
    group, size = [], 0
    for piece in pieces(texts, length):
        if group and size + len(piece[2]) > PIECE:
            _anchors_of(group, length, found)
            group, size = [], 0
        group.append(piece)
        size += len(piece[2])
    if group:
        _anchors_of(group, length, found)
    return [np.concatenate(f) if f else np.zeros((0, 5), dtype=np.int64) for f in found]


def least_places(grams: np.ndarray, span: int, count: int) -> np.ndarray:
    """The place of the least of each ``span`` grams in a row, the left of equals."""
    least = (grams & ~_PLACE) | np.arange(len(grams), dtype=U)
    size = 1
    while 2 * size <= span:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    return (np.minimum(least[:count], least[span - size : span - size + count]) & _PLACE).astype(np.int64)


def split(data: bytes, anchor: int, place: int, length: int, turn: int) -> np.ndarray:
    """A stretch's bytes as rows (offset, width, place, anchor, content), by a further anchor of each string.

    The further anchor is the gram of least hash in another order for each
    ``turn``. A part's anchor stands for the old one, the further one and how
    far apart they are: equal strings of one old anchor keep an anchor in common.
    """
    n, span = len(data), length - GRAM + 1
    up, down = powers(n)
    total = np.concatenate((np.zeros(1, U), np.cumsum(_TABLE[np.frombuffer(data, np.uint8)] * up, dtype=U)))
    grams = mixed(mixed((total[GRAM:] - total[:-GRAM]) * down[: n - GRAM + 1]) + U(turn + 1))
    at = least_places(grams, span, n - length + 1)
    first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
    last = np.append(first[1:], len(at)) - 1
    a = at[first]
    apart = (a - place).astype(np.int64).view(U)
    both = mixed(mixed(grams[a] + apart) + np.int64(anchor).view(U))
    content = mixed((total[last + length] - total[first]) * down[first])
    return np.stack([first, last - first, a - first, both.view(np.int64), content.view(np.int64)], axis=1)


def _anchors_of(group: list[tuple[int, int, bytes]], length: int, found: list[list[np.ndarray]]) -> None:
    data = np.frombuffer(b"".join(p for *_, p in group), dtype=np.uint8)
    n, span = len(data), length - GRAM + 1
    up, down = powers(n)
    total = np.concatenate((np.zeros(1, U), np.cumsum(_TABLE[data] * up, dtype=U)))
    grams = mixed((total[GRAM:] - total[:-GRAM]) * down[: n - GRAM + 1])
    count = n - length + 1
    anchor = least_places(grams, span, count)
    begins = np.cumsum([0] + [len(p) for *_, p in group])
    change = np.zeros(n + 1, dtype=np.int8)
    change[begins[:-1]] += 1
    change[begins[1:] - length + 1] -= 1
    starts = np.flatnonzero(np.cumsum(change[:count]) > 0)
    own = anchor[starts]
    first = np.flatnonzero(np.concatenate(([True], (own[1:] != own[:-1]) | (starts[1:] != starts[:-1] + 1))))
    last = np.append(first[1:], len(starts)) - 1
    s0, s1, a = starts[first], starts[last], own[first]
    content = mixed((total[s1 + length] - total[s0]) * down[s0])
    piece = np.searchsorted(begins, s0, side="right") - 1
    rows = np.stack([s0, s1 - s0, a - s0, grams[a].view(np.int64), content.view(np.int64)], axis=1)
    cuts = np.searchsorted(piece, np.arange(len(group) + 1))
    for k, (text, offset, _) in enumerate(group):
        if cuts[k + 1] > cuts[k]:
            part = rows[cuts[k] : cuts[k + 1]].copy()
            part[:, 0] += offset - begins[k]
            found[text].append(part)
