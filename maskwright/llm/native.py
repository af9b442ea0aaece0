"""Folds over arrays in DataFrame functions, whose time grows with the array's length."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Appending to an array copies it, so outputs are appended to arrays of at most so many, and those to one of arrays.
BLOCK = 128


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value computed once however often it is used, also within lambdas."""
    return F.element_at(F.transform(F.array(value), use), 1)


def running(items: Column, zero: Column, out: str, step: Callable[[Column, Column], tuple[Column, Column]]) -> Column:
    """The outputs, of type `out`, of a fold over an array: step(state, item) gives the next state and the item's output. Null
    for a null array."""
    none = F.array().cast(f"array<{out}>")

    def within(state: Column, block: Column) -> Column:
        def one(acc: Column, x: Column) -> Column:
            after, got = step(acc["state"], x)
            return F.struct(after.alias("state"), F.concat(acc["out"], F.array(got)).alias("out"))

        return F.aggregate(block, F.struct(state.alias("state"), none.alias("out")), one)

    def append(acc: Column, block: Column) -> Column:
        return bind(within(acc["state"], block), lambda r: F.struct(r["state"].alias("state"), F.concat(acc["out"], F.array(r["out"])).alias("out")))

    def fold(xs: Column) -> Column:
        firsts = F.sequence(F.lit(1), F.size(xs), F.lit(BLOCK))
        blocks = F.transform(firsts, lambda at: F.slice(xs, at, BLOCK))
        start = F.struct(zero.alias("state"), F.array().cast(f"array<array<{out}>>").alias("out"))
        return F.when(F.size(xs) > 0, F.aggregate(blocks, start, append, lambda acc: F.flatten(acc["out"]))).otherwise(F.when(xs.isNotNull(), none))

    return bind(items, fold)
