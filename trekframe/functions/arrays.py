"""Folds over arrays as column expressions whose cost does not grow with the square of their length."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, f) -> Column:
    """f(value), with value evaluated once however often f uses it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def running(values: Column, zero: Column, op) -> Column:
    """The states before each of the values: zero, then op(state, value) one after another.

    Appending to an array copies it, so one fold over n values costs n * n.  Here
    blocks of about sqrt(n) values are folded, first without keeping states to
    find where each block begins, then each block alone from there.
    """

    def fold(items, start, step):
        return F.aggregate(items, F.array(start), lambda acc, x: F.concat(acc, F.array(step(F.element_at(acc, -1), x))))

    def cut(v):
        n = F.size(v)
        size = F.greatest(F.lit(1), F.ceil(F.sqrt(n.cast("double"))).cast("int"))
        return F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(n / size).cast("int") - 1)), lambda k: F.slice(v, k * size + 1, size))

    def run(blocks):
        starts = fold(blocks, zero, lambda state, block: F.aggregate(block, state, op))
        return F.flatten(F.zip_with(blocks, F.slice(starts, 1, F.size(blocks)), lambda x, start: F.slice(fold(x, start, op), 1, F.size(x))))

    return let(values, lambda v: let(cut(v), run))
