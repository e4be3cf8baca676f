"""Expected grades by ordinal regression on hashed text.

A cumulative-link model: P(grade >= k) = sigmoid(w.x - t_k), with one weight
vector w for all grades and ordered thresholds t_1 < t_2; a grade's probability
is the difference of its two tails, and its logarithm is what is fitted. x is
the set of a text's words, hashed into buckets, and a few shape features.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.llm.batches import map_batches, texts_of

BUCKETS, SHAPES = 1 << 18, 9
_WORD = re.compile(r"\w+")
_REMEMBERED: dict[str, int] = {}


def bucket_of(word: str) -> int:
    if (k := _REMEMBERED.get(word)) is None:
        if len(_REMEMBERED) > 400_000:
            _REMEMBERED.clear()
        k = _REMEMBERED[word] = zlib.crc32(word.encode()) % BUCKETS
    return k


def features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the words, each once in ascending order; and shape features, each about 0 to 2."""
    words = _WORD.findall(text.lower())
    buckets = np.unique(np.fromiter(map(bucket_of, set(words)), dtype=np.int32))
    lines = [x for x in text.split("\n") if x.strip()]
    n = max(1, len(words))
    shapes = [
        1.0,
        np.log1p(len(words)) / 6,
        len(set(words)) / n,
        min(2.0, 4 * sum(map(text.count, "#*$%&|<>")) / n),
        min(2.0, 2 * sum(map(str.isupper, text.replace("!", "X"))) / max(1, len(text))),
        (len(lines) - len(set(lines))) / max(1, len(lines)),
        sum(map(len, words)) / n / 6,
        min(2.0, 4 * sum(map(str.isdigit, words)) / n),
        float(len(words) < 50),
    ]
    return buckets, np.array(shapes)


class OrdinalModel:
    """Weights, shape weights and ordered thresholds."""

    def __init__(self, weights: dict[int, float], shapes: np.ndarray, thresholds: np.ndarray):
        self.shapes, self.thresholds = shapes, thresholds
        self.weights = np.zeros(BUCKETS, dtype=np.float32)
        self.weights[list(weights)] = list(weights.values())

    def tails(self, text: str) -> np.ndarray:
        """P(grade >= 1), P(grade >= 2), ..."""
        buckets, shapes = features(text)
        return sigmoid(self.weights[buckets].sum(dtype=np.float64) + shapes @ self.shapes - self.thresholds)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def thresholds(free: np.ndarray) -> np.ndarray:
    """Ordered by construction: the first, then the logarithms of the steps to the next ones."""
    return np.cumsum(np.concatenate((free[:1], np.exp(free[1:]))))


def log_likelihood(z: np.ndarray, free: np.ndarray, grades: np.ndarray, weight: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Sum of weight * log P(grade | z), its slopes by z, and by ``free``.

    With tails s_k = sigmoid(z - t_k), s_0 = 1 and s_levels = 0, P(k) = s_k - s_(k+1) and
    dlog P(k)/dz = 1 - s_k - s_(k+1), as the tails' slopes are s(1 - s).
    """
    t = thresholds(free)
    every = np.concatenate(([-np.inf], t, [np.inf]))
    low, high = every[grades], every[grades + 1]
    upper, lower = (np.where(np.isinf(x), np.where(x < 0, 1.0, 0.0), sigmoid(z - np.where(np.isinf(x), 0.0, x))) for x in (low, high))
    p = np.maximum(upper - lower, 1e-12)
    by_z = weight * (1 - upper - lower)
    by_low, by_high = -weight * upper * (1 - upper) / p, weight * lower * (1 - lower) / p
    by_t = np.bincount(grades, by_low, len(every)) + np.bincount(grades + 1, by_high, len(every))
    steps = np.concatenate((np.ones(1), np.exp(free[1:])))
    return float(weight @ np.log(p)), by_z, steps * np.cumsum(by_t[1:-1][::-1])[::-1]


def fit(buckets: list[np.ndarray], shapes: np.ndarray, grades: np.ndarray, levels: int = 3, least: int = 10, deviations: float = 4.0, balance: float = 0.25, rounds: int = 300, rate: float = 0.6, shrink: float = 2e-4) -> OrdinalModel:
    """Batch gradient steps (Adagrad) on the likelihood, with an L1 shrinkage of the word weights.

    Buckets of fewer than ``least`` documents, or whose mean grade differs by less than ``deviations`` standard
    errors, get no weight. ``balance``: 0 weighs documents alike, 1 the grades alike.
    """
    if not len(grades):
        return OrdinalModel({}, np.zeros(SHAPES), np.arange(levels - 1.0))
    sizes = np.array([len(b) for b in buckets])
    flat = np.concatenate(buckets) if sizes.sum() else np.zeros(0, np.int32)
    names, column, seen = np.unique(flat, return_inverse=True, return_counts=True)
    # only buckets whose documents' mean grade stands apart from the rest's: the others would fit noise
    centred = grades - grades.mean()
    apart = np.abs(np.bincount(column, np.repeat(centred, sizes), len(names))) / np.sqrt(np.maximum(seen, 1) * max(centred.var(), 1e-9))
    use = (seen >= least) & (apart >= deviations)
    new = np.cumsum(use) - 1
    row, column = np.repeat(np.arange(len(sizes)), sizes)[use[column]], new[column[use[column]]]
    names = names[use]
    share = np.bincount(grades, minlength=levels).astype(float)
    weight = (1 / np.maximum(share, 1) ** balance)[grades]
    weight /= weight.sum()
    w, s, free = np.zeros(len(names)), np.zeros(SHAPES), np.concatenate(([-0.5], np.full(levels - 2, -np.log(max(1, levels - 2)))))
    gw, gs, gt = np.full(len(names), 1e-8), np.full(SHAPES, 1e-8), np.full(levels - 1, 1e-8)
    for _ in range(rounds):
        z = np.bincount(row, w[column], len(sizes)) + shapes @ s
        _, by_z, by_free = log_likelihood(z, free, grades, weight)
        dw, ds, dt = -np.bincount(column, by_z[row], len(names)), -(shapes.T @ by_z), -by_free
        gw, gs, gt = gw + dw**2, gs + ds**2, gt + dt**2
        w -= rate * dw / np.sqrt(gw)
        w = np.sign(w) * np.maximum(np.abs(w) - shrink * rate / np.sqrt(gw), 0)
        s -= rate * ds / np.sqrt(gs)
        free = free - rate * dt / np.sqrt(gt)
    return OrdinalModel({int(k): float(v) for k, v in zip(names, w, strict=True) if v}, s, thresholds(free))


def grade(quality: str = "quality", toxic: str = "toxic") -> F.Column:
    """0: toxic; 1: neither toxic nor good; 2: good. Null if quality is null and toxic isn't 1."""
    return F.when(F.col(toxic) == 1, 0).when(F.col(quality) == 1, 2).when(F.col(quality).isNotNull(), 1)


def train(docs: DataFrame, labels: DataFrame, sample: int = 6000) -> OrdinalModel:
    """Fit on ``sample`` rated documents or so, chosen by a hash of doc_id, whole texts."""
    rated = labels.select("doc_id", grade().alias("grade")).where("doc_id is not null and grade is not null").groupBy("doc_id").agg(F.min("grade").alias("grade"))
    n = rated.count()
    if not n:
        return fit([], np.zeros((0, SHAPES)), np.zeros(0, int))
    chosen = rated.where(F.pmod(F.xxhash64("doc_id"), F.lit(n)) < sample)

    def run(batch: pa.RecordBatch) -> dict:
        found = [features(t) for t in texts_of(batch)]
        return {"doc_id": batch.column("doc_id"), "grade": batch.column("grade"), "buckets": [b.tolist() for b, _ in found], "shapes": [x.tolist() for _, x in found]}

    # at most ``sample`` ids or so: the bound that makes the broadcast safe
    rows = map_batches(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id"), run, "doc_id long, grade int, buckets array<int>, shapes array<double>").toArrow()
    order = np.argsort(rows["doc_id"].to_numpy(), kind="stable")
    lists = rows["buckets"].to_pylist()
    return fit([np.array(lists[i], dtype=np.int32) for i in order], np.array(rows["shapes"].to_pylist()).reshape(-1, SHAPES)[order], rows["grade"].to_numpy()[order])


def score(docs: DataFrame, model: OrdinalModel, least: float = 0.5) -> DataFrame:
    """Expected grade (0 to 2) and tail probabilities of every whole text; selected if P(grade >= 2) reaches ``least``.

    Null and empty texts are scored as texts without words; repeated rows each;
    extra columns are ignored; an empty table gives an empty result.
    """
    told = docs.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch) -> dict:
        tails = np.array([told.value.tails(t) for t in texts_of(batch)])
        return {"doc_id": batch.column("doc_id"), "expected_grade": tails.sum(axis=1), "p_ge1": tails[:, 0], "p_ge2": tails[:, 1], "selected": tails[:, 1] >= least}

    return map_batches(docs.select("doc_id", "text"), run, "doc_id long, expected_grade double, p_ge1 double, p_ge2 double, selected boolean")
