"""Passes over long arrays and texts with DataFrame functions, in time that follows their length."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Elements that one fold appends to an array. Every step of a fold copies what it has made so far, so folds are short.
FOLD = 64
#: Code points of a block of text.
BLOCK = 512


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of ``value``, computed once however often ``then`` names it."""
    return F.element_at(F.transform(F.array(value), then), 1)


def _last(items: Column) -> Column:
    return F.element_at(items, -1)


def running(numbers: Column, op: Callable[[Column, Column], Column]) -> Column:
    """For each number, ``op`` (associative, with 0 as its neutral element) of all numbers up to it; empty for none.

    Folds of FOLD numbers, folds of their results and a fold of those: n
    numbers cost about n * FOLD / 2 copies instead of n * n / 2.
    """

    def fold(part: Column) -> Column:
        return F.aggregate(part, F.array(F.lit(0)), lambda out, x: F.concat(out, F.array(op(_last(out), x))))

    def folds(items: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(items) - 1) / FOLD).cast("int")), lambda k: fold(F.slice(items, k * FOLD + 1, F.lit(FOLD))))

    def joined(parts: Column, of_parts: Column, of_all: Column) -> Column:
        def moved(part: Column, k: Column) -> Column:
            j = F.floor(k / FOLD).cast("int")
            return let(op(F.get(F.get(of_parts, j), k - j * FOLD), F.get(of_all, j)), lambda before: F.transform(F.slice(part, F.lit(2), F.lit(FOLD)), lambda x: op(before, x)))

        return F.flatten(F.transform(parts, moved))

    def whole(items: Column) -> Column:
        made = let(folds(items), lambda parts: let(folds(F.transform(parts, _last)), lambda of_parts: let(fold(F.transform(of_parts, _last)), lambda of_all: joined(parts, of_parts, of_all))))
        return F.when(F.size(items) > 0, made).otherwise(F.array().cast("array<int>"))

    return let(numbers, whole)


def blocks(text: Column) -> Column:
    """The text in parts of BLOCK code points."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))


def between(parts: Column, start: Column, end: Column) -> Column:
    """Code points ``start`` to ``end`` (exclusive) of the text with these blocks, without a walk from its first one."""
    first = F.floor(start / BLOCK).cast("int")
    near = F.array_join(F.slice(parts, first + 1, F.floor(end / BLOCK).cast("int") - first + 1), "")
    return F.substring(near, start - first * BLOCK + 1, end - start)
