"""Removal of repeated strings against counting all of them."""

import hashlib
import os
import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm.conftest import rows_of
from tracewright.llm import suffix_dedup, suffixes


@settings(max_examples=300, deadline=None)
@given(st.text("ab\0c", max_size=60).map(str.encode), st.integers(1, 80))
def test_suffix_array(text, depth):
    order = suffixes.suffix_array(text, depth).tolist()
    assert sorted(order) == list(range(len(text)))
    keys = [text[i : i + depth] for i in order]
    assert keys == sorted(keys)


@settings(max_examples=200, deadline=None)
@given(st.text("ab", min_size=1, max_size=90).map(str.encode), st.integers(1, 40), st.data())
def test_common_prefixes(text, limit, data):
    pairs = data.draw(st.lists(st.tuples(st.integers(0, len(text) - 1), st.integers(0, len(text) - 1)), min_size=1))
    one, other = np.array(pairs).T
    want = [min(limit, len(os.path.commonprefix([text[a:], text[b:]]))) for a, b in pairs]
    assert suffixes.common_prefixes(text, one, other, limit).tolist() == want


def brute(rows, length):
    count = Counter(data[i : i + length] for _, t in rows for data in [(t or "").encode()] for i in range(len(data) - length + 1))
    out = {}
    for d, t in rows:
        data = (t or "").encode()
        hit = np.zeros(len(data) + 1, dtype=bool)
        for i in range(len(data) - length + 1):
            if count[data[i : i + length]] > 1:
                hit[i : i + length] = True
        kept = bytes(b for b, h in zip(data, hit) if not h)
        out[d] = (len(data), int(hit.sum()), len(suffixes.runs(hit[:-1])) if len(data) else 0, hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize(("length", "most"), [(100, 400), (100, 2), (130, 5)])
def test_against_counting(spark, length, most):
    rng = random.Random(length + most)
    word = lambda: "".join(rng.choice("abcé") for _ in range(rng.randrange(1, 7)))
    prose = lambda n: " ".join(word() for _ in range(n))
    shared = [prose(rng.randrange(15, 60)) for _ in range(6)]
    texts = []
    for _ in range(60):
        parts = [prose(rng.randrange(40)) for _ in range(3)]
        for _ in range(rng.randrange(3)):
            s = rng.choice(shared)
            parts.insert(rng.randrange(3), s[rng.randrange(20) : len(s) - rng.randrange(20)])
        texts.append(" ".join(parts))
    texts += texts[:4] + ["x" * 500, "xy" * 200, "x" * 99, "x" * 100, "", None, "q" * 100 + "z" + "q" * 100] + [shared[0] + str(i) * 80 for i in range(12)]
    rows = list(enumerate(texts))
    df = spark.createDataFrame([(d, t, 0) for d, t in rows], "doc_id long, text string, n_bytes int").repartition(4)
    assert rows_of(suffix_dedup.removed_repeats(df, length, most), "n_bytes", "n_removed", "n_spans", "kept_sha256") == brute(rows, length)


def test_documents(spark, documents, empty):
    rows = [(r["doc_id"], r["text"]) for r in documents.select("doc_id", "text").collect() if len(r["text"] or "") < 60_000]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = rows_of(suffix_dedup.removed_repeats(df), "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert got == brute(rows, 400) and sum(x[1] for x in got.values()) > 1000
    assert suffix_dedup.removed_repeats(empty).count() == 0


def test_repeated_rows_and_long_texts(spark, monkeypatch):
    monkeypatch.setattr(suffixes, "PIECE", 700)
    rng = np.random.default_rng(5)
    long = bytes(rng.integers(97, 123, 5000, dtype=np.uint8)).decode()
    texts = [long.encode(), (long[1000:3000] + "tail").encode()]
    a, b = suffixes.anchors(texts, 400)
    assert sum(int(w) + 1 for w in a[:, 1]) == 4601 and len(set(a[:, 3]) & set(b[:, 3])) > 5
    df = spark.createDataFrame([(1, long), (1, long), (None, long), (2, "y")], "doc_id long, text string")
    got = sorted((r["doc_id"] or 0, r["n_removed"]) for r in suffix_dedup.removed_repeats(df).collect())
    assert got == [(0, 0), (1, 5000), (1, 5000), (2, 0)]
