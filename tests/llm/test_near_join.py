"""The near-duplicate join against all pairs, components against union-find."""

import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm.conftest import rows_of
from tracewright.llm import near_join
from tracewright.llm.shingles import shingle_sets


def shingles(text, size=4):
    words = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", words)
    return {tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))} if words else set()


def brute(rows, percent=85):
    sets = [(d, shingles(t)) for d, t in rows if d is not None]
    parent = {d: d for d, _ in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (d, a) in enumerate(sets):
        for e, b in sets[i + 1 :]:
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = sorted((root(d), root(e)))
                parent[y] = x
    return {d: (len(s), root(d)) for d, s in sets}


def family(rng, base, n, edits):
    for _ in range(n):
        words = list(base)
        for _ in range(rng.randrange(edits + 1)):
            words[rng.randrange(len(words))] = f"e{rng.randrange(10**6)}"
        yield " ".join(words)


@pytest.mark.parametrize("seed", [1, 2])
def test_families(spark, seed):
    rng = random.Random(seed)
    texts, vocabulary = [], [f"w{i}" for i in range(400)]
    passage = [rng.choice(vocabulary) for _ in range(30)]
    for _ in range(25):
        base = [rng.choice(vocabulary) for _ in range(rng.choice((3, 5, 12, 40, 150)))]
        texts += family(rng, base + passage * rng.randrange(2), rng.randrange(1, 9), 1 + len(base) // 30)
    # chains of sets that grow by one shingle: neighbours link, ends don't
    chain = [f"c{i}" for i in range(90)]
    texts += [" ".join(chain[i : 60 + i]) for i in range(0, 30, 2)] + texts[:5] + ["", None, " \n", "solo", "SOLO", "solo "]
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    df = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, n string").repartition(5)
    assert rows_of(near_join.near_duplicates(df), "n_shingles", "component_id") == brute(rows)


def test_documents(spark, documents, empty):
    rows = [(r["doc_id"], r["text"]) for r in documents.collect()]
    got = rows_of(near_join.near_duplicates(documents), "n_shingles", "component_id")
    assert got == brute(rows)
    kept = near_join.keep_one(documents).collect()
    assert sorted(r["doc_id"] for r in kept) == sorted({c for _, c in got.values()})
    assert near_join.near_duplicates(empty).count() == 0


def test_null_ids_and_repeated_rows(spark):
    rows = [(None, "a b c d e"), (7, "a b c d e"), (7, "a b c d e"), (9, "A B C D E"), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r["doc_id"] or -1, r["n_shingles"], r["component_id"]) for r in near_join.near_duplicates(df).collect()), key=str)
    assert got == sorted([(-1, 2, None), (7, 2, 7), (7, 2, 7), (9, 2, 7), (-1, 0, None)], key=str)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(st.sampled_from("aB \n\té　"), max_size=30), max_size=6), st.integers(2, 5))
def test_hashes_are_equal_where_shingles_are(texts, size):
    got = list(shingle_sets(texts, size))
    want = [shingles(t, size) for t in texts]
    assert [len(g) for g in got] == [len(w) for w in want]
    for i, a in enumerate(want):
        for j, b in enumerate(want):
            assert len(np.intersect1d(got[i], got[j])) == len(a & b)
