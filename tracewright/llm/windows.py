"""Hashes of word windows with DataFrame functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def packed(docs: DataFrame) -> Column:
    """All columns of ``docs`` as one, so that theirs and an operator's names can't clash; ``own.*`` unpacks them."""
    return F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("own")


def shifted(name: str, by: int):
    return F.slice(name, by + 1, F.greatest(F.size(name) - by, F.lit(0)))


def with_window_hashes(rows: DataFrame, words: str, sizes: list[int], prefix: str = "_w") -> DataFrame:
    """Adds a column ``{prefix}{size}`` for each size: the 64-bit hashes of the windows of so many words, in order.

    Windows of 2, 4, 8 ... words are made of two halves each and put together
    to the size asked for, so a window costs a few hashes of two numbers and no
    slice of strings. Every step is a column of its own: referenced twice, it
    is computed once.
    """
    if not sizes:
        return rows
    rows = rows.withColumn(f"{prefix}_p1", F.transform(words, lambda w: F.xxhash64(w)))
    powers, k = {1: f"{prefix}_p1"}, 1
    while 2 * k <= max(sizes):
        rows = rows.withColumn(f"{prefix}_p{2 * k}", F.zip_with(powers[k], shifted(powers[k], k), lambda a, b: F.xxhash64(a, b)))
        k *= 2
        powers[k] = f"{prefix}_p{k}"
    for size in sizes:
        parts = [p for p in sorted(powers, reverse=True) if p & size]
        made, covered = F.col(powers[parts[0]]), parts[0]
        for p in parts[1:]:
            made = F.zip_with(made, shifted(powers[p], covered), lambda a, b: F.xxhash64(a, b))
            covered += p
        # what hangs over the end is cut off
        rows = rows.withColumn(f"{prefix}{size}", F.slice(made, 1, F.greatest(F.size(words) - (size - 1), F.lit(0))))
    return rows.drop(*powers.values())
