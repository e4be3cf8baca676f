"""Language identification by words first, character n-grams after.

A known word is scored by its log frequency in each language. A word that the
model lacks falls back to its character n-grams, from the longest order down
to the first order of which the model knows any.
"""

from __future__ import annotations

import math
import re
import uuid
from array import array
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewright.llm.batches import held, map_batches, texts_of

UNKNOWN = "und"
_WORD = re.compile(r"[^\W\d_]+")
LONGEST, SHORTEST = 5, 1


def words_of(text: str) -> list[str]:
    """Lower-case runs of letters."""
    found = _WORD.findall(text.lower())
    if text.isascii():
        return found
    return [w if w.isalpha() else "".join(filter(str.isalpha, w)) for w in found if any(map(str.isalpha, w))]


def grams_of(word: str, n: int) -> list[str]:
    """The n-grams of the word between marks of its ends."""
    padded = f"^{word}$" if n > 1 else word
    return [padded[i : i + n] for i in range(max(0, len(padded) - n + 1))]


class LanguageModel:
    """Log frequencies of words and n-grams per language."""

    def __init__(self, counts: dict[str, dict[str, int]], gram_counts: dict[int, dict[str, dict[str, int]]]):
        self.languages = sorted(counts)
        self.words = self.logs([counts[x] for x in self.languages])
        self.grams = {n: self.logs([g.get(x, {}) for x in self.languages]) for n, g in gram_counts.items()}

    def logs(self, counts: list[dict[str, int]]) -> dict[str, array]:
        size = len({k for c in counts for k in c}) + 1
        total = [math.log(sum(c.values()) + 0.5 * size) for c in counts]
        return {k: array("f", (math.log(c.get(k, 0) + 0.5) - t for c, t in zip(counts, total, strict=True))) for k in {k for c in counts for k in c}}

    def of_word(self, word: str) -> tuple[float, ...]:
        if (known := self.words.get(word)) is not None:
            return known
        for n in range(LONGEST, SHORTEST - 1, -1):
            if found := [v for g in grams_of(word, n) if (v := self.grams.get(n, {}).get(g)) is not None]:
                return tuple(sum(c) / len(found) for c in zip(*found, strict=True))
        return (0.0,) * len(self.languages)


class Identifier:
    """Scores texts; remembers the scores of up to ``remembered`` words."""

    def __init__(self, model: LanguageModel, remembered: int = 200_000):
        self.model, self.remembered = model, remembered
        self.index: dict[str, int] = {}
        self.scores = np.zeros((1024, len(model.languages)))

    def learn(self, words: set[str]) -> None:
        new = words.difference(self.index)
        if len(self.index) + len(new) > self.remembered:
            self.index.clear()
            new = words
        if not new:
            return
        first = len(self.index)
        if first + len(new) > len(self.scores):
            self.scores = np.resize(self.scores, (2 * (first + len(new)), self.scores.shape[1]))
        self.scores[first : first + len(new)] = [self.model.of_word(w) for w in new]
        self.index.update(zip(new, range(first, first + len(new)), strict=True))

    def predict(self, texts: list[str]) -> tuple[list[str], list[float]]:
        """The likeliest language of each text, and its probability among those learned."""
        lists = [words_of(t) for t in texts]
        if not self.model.languages:
            return [UNKNOWN] * len(texts), [0.0] * len(texts)
        self.learn({w for ws in lists for w in ws})
        names, scores = [], []
        for ws in lists:
            if not ws:
                names.append(UNKNOWN)
                scores.append(0.0)
                continue
            total = self.scores[np.fromiter(map(self.index.__getitem__, ws), dtype=np.int64, count=len(ws))].sum(axis=0)
            best = int(total.argmax())  # of ties, the first name
            names.append(self.model.languages[best])
            scores.append(float(1 / np.exp(total - total[best]).sum()))
        return names, scores


def held_out(doc_id: str = "doc_id") -> F.Column:
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def train(docs: DataFrame, sample: int = 16_000, words: int = 30_000, grams: int = 10_000, least: int = 2) -> LanguageModel:
    """Learn from rows that have lang and aren't held out.

    The model is fitted on ``sample`` labelled documents or so, chosen by a
    hash of doc_id, whole texts; it keeps the ``words`` most frequent words and
    the ``grams`` most frequent n-grams of each order for each language, so
    that its size is bounded, of those met ``least`` times or more in the
    sample: what is met once says more about its document than its language.
    Ties in frequency go to the first in the alphabet.
    """
    labelled = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).select("doc_id", "text", "lang")
    n = labelled.select("doc_id").count()
    if not n:
        return LanguageModel({}, {})
    chosen = labelled.where(F.pmod(F.xxhash64("doc_id"), F.lit(n)) < sample)

    def count(batch: pa.RecordBatch) -> dict:
        own: dict[str, Counter] = defaultdict(Counter)
        for lang, text in zip(batch.column("lang").to_pylist(), texts_of(batch), strict=True):
            own[lang].update(words_of(text))
        rows = []
        for lang, found in own.items():
            of = [Counter() for _ in range(LONGEST + 1)]
            for w, c in found.items():
                for k in range(SHORTEST, LONGEST + 1):
                    for g in grams_of(w, k):
                        of[k][g] += c
            rows += [(lang, k, g, c) for k, every in enumerate([found, *of[1:]]) for g, c in every.items()]
        return dict(zip(("lang", "n", "gram", "c"), map(list, zip(*rows, strict=True)), strict=True)) if rows else None

    counted = map_batches(chosen, count, "lang string, n int, gram string, c long").groupBy("lang", "n", "gram").agg(F.sum("c").alias("c")).where(F.col("c") >= least)
    most = F.row_number().over(Window.partitionBy("lang", "n").orderBy(F.desc("c"), "gram"))
    kept = counted.withColumn("rank", most).where(F.col("rank") <= F.when(F.col("n") == 0, words).otherwise(grams))
    of: dict[int, dict[str, dict[str, int]]] = defaultdict(lambda: defaultdict(dict))
    for lang, k, gram, c in kept.select("lang", "n", "gram", "c").toLocalIterator():
        of[k][lang][gram] = c
    return LanguageModel(of.pop(0, {}), {k: dict(v) for k, v in of.items()})


def identify(docs: DataFrame, model: LanguageModel, keep: tuple[str, ...] = ()) -> DataFrame:
    """lang_pred and score of every whole text, from the text alone.

    ``und`` and 0 if the text is null, empty or has no letter, or nothing was
    learned; equal scores go to the first name; repeated rows are scored each;
    other columns are ignored but for ``keep``, which are carried through.
    """
    told, key = docs.sparkSession.sparkContext.broadcast(model), uuid.uuid4().hex
    columns = list(dict.fromkeys(["doc_id", "text", *keep]))
    rows = docs.select(*columns)

    def run(batch: pa.RecordBatch) -> dict:
        own = held(("identifier", key), lambda: Identifier(told.value))
        names, scores = own.predict(texts_of(batch))
        return {c: batch.column(c) for c in out} | {"lang_pred": names, "score": scores}

    out = [c for c in columns if c != "text" or "text" in keep]
    schema = rows.select(*out).schema.add("lang_pred", "string").add("score", "double")
    return map_batches(rows, run, schema)
