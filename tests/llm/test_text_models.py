"""Tokenizers against their libraries, classifiers on held-out documents."""

import math
import re
import struct
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tests.llm.conftest import TEXTS, rows_of
from tracewright.llm import language, pieces, quality_model, token_counts, token_files
from tracewright.llm.queries import vocabulary

LETTERS = st.text(st.sampled_from(" \n\t\x0b\x1c\x85\xa0　'aabeshtT.,12é😀ΑΣ<|>▁"), max_size=40)


@pytest.fixture(scope="module")
def byte_bpe():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), token_counts.TokenCounter(vocabulary("byte_bpe_50k.json"))


@pytest.fixture(scope="module")
def word_bpe():
    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), token_files.Encoder(vocabulary("word_bpe_49k.json"))


@pytest.fixture(scope="module")
def piece_bpe():
    return sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model")), pieces.PieceModel(vocabulary("piece_bpe_32k.model"))


@settings(max_examples=300, deadline=None)
@given(st.lists(LETTERS, max_size=4))
def test_any_text(byte_bpe, word_bpe, piece_bpe, texts):
    library, own = byte_bpe
    assert own.count(texts) == [len(library.encode(t, add_special_tokens=False).ids) for t in texts]
    library, own = word_bpe
    assert own.ids(texts) == [struct.pack(f"<{len(i)}I", *i) for t in texts for i in [library.encode(t, add_special_tokens=False).ids]]
    library, own = piece_bpe
    for t in texts:
        assert own.encode(t) == library.encode(t)
        assert "▁" in t or own.decode(own.encode(t)) == t


def test_merges_in_any_batch(byte_bpe):
    library, own = byte_bpe
    words = [b"a" * n for n in range(1, 40)] + [b"haha" * 9, "ß😀".encode(), b"x", b" " * 17]
    assert own.merger.counts(words).tolist() == [len(library.encode(w.decode(), add_special_tokens=False).ids) for w in words]


def test_memory_is_bounded(byte_bpe):
    own = token_counts.TokenCounter(vocabulary("byte_bpe_50k.json"), remembered=10)
    texts = [" ".join(f"w{i}{j}" for j in range(7)) for i in range(9)]
    assert [own.count([t])[0] for t in texts] == byte_bpe[1].count(texts)
    assert len(own.known) <= 10


def test_token_counts(documents, empty, byte_bpe):
    library, _ = byte_bpe
    data = vocabulary("byte_bpe_50k.json")
    got = rows_of(token_counts.token_counts(documents, data), "n_bytes", "n_tokens", "over_limit")
    for doc_id, text in documents.select("doc_id", "text").collect():
        n = len(library.encode(text or "", add_special_tokens=False).ids)
        assert got[doc_id] == (len((text or "").encode()), n, n > 1024)
    assert token_counts.token_counts(empty, data).count() == 0


def test_token_files(spark, documents, empty, word_bpe, tmp_path):
    library, _ = word_bpe
    data, start = vocabulary("word_bpe_49k.json"), 0
    got = rows_of(token_files.token_files(documents, data))
    for doc_id, text in documents.select("doc_id", "text").orderBy("doc_id").collect():
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 2]
        assert got[doc_id] == (start, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids)))
        start += len(ids)
    assert token_files.token_files(empty, data).count() == 0
    shards = token_files.write_token_files(documents, data, str(tmp_path))
    dictionary = token_files.get(f"file://{tmp_path}/dictionary.zstd")
    shard = token_files.Shard(token_files.get(shards[0][0]), dictionary)
    k = len(shard.index) // 2
    assert zlib.crc32(shard.document(k)) == got[int(shard.index["doc_id"][k])][2]  # one document alone
    with pytest.raises(ValueError, match="another dictionary"):
        token_files.Shard(token_files.get(shards[0][0]), dictionary + b"x")


def test_token_files_of_odd_ids(spark, word_bpe, tmp_path):
    library, data, start = word_bpe[0], vocabulary("word_bpe_49k.json"), 0
    rows = [(-5, "minus five"), (None, "none"), (-1, "minus one words"), (3, None), (0, "zero"), (None, "none at all"), (3, "repeated"), (-(2**63), "least"), (2**63 - 1, "most")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    shards = token_files.write_token_files(docs, data, str(tmp_path), shard_bytes=60)
    assert len(shards) > 4 and sum(n for _, n, _ in shards) == len(rows)
    got = sorted(map(tuple, token_files.read_token_files(spark, str(tmp_path), shards).collect()), key=lambda r: r[1])
    assert [r[0] for r in got] == [None, None, -(2**63), -5, -1, 0, 3, 3, 2**63 - 1]
    of = {}
    for i, t in rows:
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 2]
        of.setdefault(i, set()).add((len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))))
    for i, at, n, crc in got:
        assert at == start and (n, crc) in of[i]
        of[i].remove((n, crc))
        start += n


def test_dictionary_sample_is_bounded(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.concat(F.lit("some words of text "), "id").alias("text")).withColumn("salt", F.xxhash64("text"))
    long = docs.limit(1).select("doc_id", F.repeat("text", 9000).alias("text"), "salt")
    total, chosen = token_files.size_and_sample(docs.union(long), 4001, 400, 16_384)
    assert total > 9000 * 20 and 250 < len(chosen) < 600 and max(map(len, chosen)) < 100
    assert token_files.size_and_sample(docs.where("false"), 1, 400, 16_384) == (0, [])


def test_units_met_twice_before_they_are_learned(word_bpe):
    library, own = word_bpe[0], token_files.Encoder(vocabulary("word_bpe_49k.json"), remembered=4)
    for texts in (["ab cd", "cd ef ab", "<|endoftext|> cd", "x1 cd, don't", "cd ef"], ["gh", "ab gh"], [], ["ab cd"]):
        assert own.ids(texts) == [struct.pack(f"<{len(i)}I", *i) for t in texts for i in [library.encode(t, add_special_tokens=False).ids]]
        assert len(own.known) <= 12


def test_pieces(documents, empty, piece_bpe):
    library, _ = piece_bpe
    data = vocabulary("piece_bpe_32k.model")
    encoded = pieces.encode(documents, data)
    want = {d: library.encode(t or "") for d, t in documents.select("doc_id", "text").collect()}
    assert {r["doc_id"]: r["ids"] for r in encoded.collect()} == want
    assert rows_of(pieces.decode(encoded, data)) == {d: (t or "",) for d, t in documents.select("doc_id", "text").collect()}
    assert all(r["returns"] for r in pieces.round_trip(documents, data).collect())
    assert pieces.round_trip(empty, data).count() == 0


def test_viterbi_of_unigram_scores():
    def message(number, kind, value):
        body = value if kind == 2 else b""
        return bytes([number << 3 | kind]) + (bytes([len(body)]) + body if kind == 2 else value)

    def piece(text, score, kind=1):
        return message(1, 2, message(1, 2, text.encode()) + message(2, 5, struct.pack("<f", score)) + message(3, 0, bytes([kind])))

    vocab = {"▁": -3.0, "a": -2.0, "b": -2.0, "ab": -2.5, "ba": -1.0, "▁ab": -4.0, "aba": -3.2}
    data = piece("<unk>", 0, 2) + b"".join(piece(p, s) for p, s in vocab.items()) + message(2, 2, message(3, 0, b"\x01")) + message(3, 2, message(3, 0, b"\x01") + message(4, 0, b"\x00"))
    model = pieces.PieceModel(data)

    def best(text):
        if not text:
            return 0.0
        return max(vocab[text[:k]] + best(text[k:]) for k in range(1, len(text) + 1) if text[:k] in vocab)

    for text in ("ab", "abab", "bababa", "aabbab", "abaabaab"):
        assert sum(model.scores[i] for i in model.encode(text)) == pytest.approx(best("▁" + text), abs=1e-5)
        assert model.decode(model.encode(text)) == text


def test_language(spark, documents, odd, empty):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language.train(docs)
    got = rows_of(language.identify(docs, model), "lang_pred", "score")
    held = docs.where(language.held_out()).where(F.length("text") > 60).select("doc_id", "lang").collect()
    assert len(held) > 150 and sum(got[d][0] == lang for d, lang in held) / len(held) > 0.97
    found = rows_of(language.identify(odd, model), "lang_pred", "score")
    for d, t in enumerate(TEXTS):
        assert (found[d][0] == "und") == (not re.search(r"[^\W\d_]", t or "")) and 0 <= found[d][1] <= 1
    assert language.identify(empty, model).count() == 0
    nothing = language.train(odd.withColumn("lang", F.lit(None).cast("string")))
    assert {r["lang_pred"] for r in language.identify(odd, nothing).collect()} == {"und"}


def test_backoff_takes_the_longest_known_order():
    model = language.LanguageModel({"x": {"foo": 5}, "y": {"bar": 5}}, {2: {"x": {"qu": 9}, "y": {"zz": 9}}, 1: {"x": {"z": 1}, "y": {"q": 1}}})
    assert language.Identifier(model).predict(["quux", "zz", "z", "foo bar bar"])[0] == ["x", "y", "x", "y"]


@pytest.mark.parametrize(("words", "grams", "least"), [(30_000, 10_000, 2), (40, 25, 1)])
def test_trained_counts_and_predictions_against_plain_python(spark, words, grams, least):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = docs.withColumn("held", language.held_out()).select("doc_id", "text", "lang", "held").collect()
    counts = {}
    for r in rows:
        if r["lang"] and not r["held"]:
            for w in language.words_of(r["text"] or ""):
                for k in range(language.LONGEST + 1):
                    for g in [w] if k == 0 else language.grams_of(w, k):
                        own = counts.setdefault(r["lang"], {}).setdefault(k, Counter())
                        own[g] += 1
    kept = {lang: {k: dict(sorted(((g, n) for g, n in c.items() if n >= least), key=lambda x: (-x[1], x[0]))[: grams if k else words]) for k, c in of.items()} for lang, of in counts.items()}

    def log_frequencies(k):
        every = {g for of in kept.values() for g in of.get(k, {})}
        total = {lang: sum(of.get(k, {}).values()) + 0.5 * (len(every) + 1) for lang, of in kept.items()}
        return {g: {lang: math.log((of.get(k, {}).get(g, 0) + 0.5) / total[lang]) for lang, of in kept.items()} for g in every}

    tables = [log_frequencies(k) for k in range(language.LONGEST + 1)]

    def of_word(w, lang):
        if w in tables[0]:
            return tables[0][w][lang]
        for k in range(language.LONGEST, 0, -1):
            if known := [tables[k][g][lang] for g in language.grams_of(w, k) if g in tables[k]]:
                return sum(known) / len(known)
        return 0.0

    model = language.train(docs, sample=1 << 30, words=words, grams=grams, least=least)
    got = rows_of(language.identify(docs, model), "lang_pred", "score")
    for r in rows:
        own = language.words_of(r["text"] or "")
        if own and len(own) < 2000:
            z = {lang: sum(of_word(w, lang) for w in own) for lang in sorted(kept)}
            best = max(z.values())
            score = 1 / sum(math.exp(v - best) for v in z.values())
            assert got[r["doc_id"]][1] == pytest.approx(score, abs=1e-3)
            assert z[got[r["doc_id"]][0]] == pytest.approx(best, abs=1e-3)


def test_language_never_learns_from_held_out(spark):
    rows = [(i, "aaa bbb" if i % 2 else "ccc ddd", "l1" if i % 2 else "l2") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    wrong = docs.withColumn("lang", F.when(language.held_out(), F.lit("other")).otherwise(F.col("lang")))
    model = language.train(wrong)
    assert model.languages == ["l1", "l2"] and model.words == language.train(docs).words


def test_cumulative_link_slopes():
    rng = np.random.default_rng(3)
    z, grades, weight, free = rng.normal(size=40), rng.integers(0, 4, 40), rng.random(40), np.array([-0.4, 0.2, -0.7])
    value, by_z, by_free = quality_model.log_likelihood(z, free, grades, weight)
    t = quality_model.thresholds(free)
    assert (np.diff(t) > 0).all()
    tails = np.hstack([np.ones((40, 1)), 1 / (1 + np.exp(t - z[:, None])), np.zeros((40, 1))])
    assert value == pytest.approx((weight * np.log(-np.diff(tails)[np.arange(40), grades])).sum())
    for at, slopes in ((z, by_z), (free, by_free)):
        for i in range(len(at)):
            step = np.zeros(len(at))
            step[i] = 1e-6
            ends = [quality_model.log_likelihood(*((at + d, free) if at is z else (z, at + d)), grades, weight)[0] for d in (step, -step)]
            assert slopes[i] == pytest.approx((ends[0] - ends[1]) / 2e-6, abs=1e-6)
    assert quality_model.log_likelihood(np.array([0.3]), np.array([-0.5, 0.0]), np.array([0]), np.ones(1))[1][0] == pytest.approx(-0.690, abs=1e-3)


def test_fit_on_a_small_table():
    words, grades = [np.array([k]) for k in (1, 2, 3) for _ in range(60)], np.repeat([0, 1, 2], 60)
    noise = [[2, 0, 1][g] if i % 10 == 0 else g for i, g in enumerate(grades)]
    shapes = np.zeros((180, quality_model.SHAPES))
    shapes[:, 0] = 1
    model = quality_model.fit(words, shapes, np.array(noise), deviations=0, balance=0, shrink=0, rounds=2000)
    z = np.array([model.weights[k] + model.shapes[0] for k in (1, 2, 3)], dtype=float)
    best = quality_model.log_likelihood(np.repeat(z, 60), np.array([model.thresholds[0], np.log(np.diff(model.thresholds)[0])]), np.array(noise), np.ones(180))[0]
    grid = np.arange(-6, 6.1, 0.5)
    # brute force over weights of the three words and both thresholds, the middle word's weight as origin
    others = max(quality_model.log_likelihood(np.repeat([a, 0.0, b], 60), np.array([t, np.log(d)]), np.array(noise), np.ones(180))[0] for a in grid for b in grid for t in np.arange(-4, 1, 0.5) for d in (1.0, 2, 3, 4, 5))
    assert best >= others - 1e-3


def test_quality_model(spark, odd, empty):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    held = F.pmod(F.xxhash64(F.col("doc_id"), F.lit("held")), F.lit(4)) == 0
    model = quality_model.train(docs, labels.where(~held))
    graded = quality_model.score(docs, model).join(labels.where(held), "doc_id").select("expected_grade", "p_ge1", "p_ge2", "selected", "quality", "toxic").toPandas()
    bad = (graded.toxic == 1) | (graded.quality == 0)
    assert ((graded.p_ge1 + 1e-12 >= graded.p_ge2) & (abs(graded.p_ge1 + graded.p_ge2 - graded.expected_grade) < 1e-9)).all()
    print("good kept", graded.selected[~bad].mean(), "bad kept", graded.selected[bad].mean(), "toxic kept", graded.selected[graded.toxic == 1].mean())
    assert graded.selected[~bad].mean() > 0.95 and graded.selected[bad].mean() < 0.2
    assert quality_model.score(odd, model).count() == len(TEXTS) and quality_model.score(empty, model).count() == 0
    assert not np.isnan(quality_model.train(docs, labels.where("false")).tails("some text")).any()
