"""Array expressions that stay near linear: values computed once, and running totals in blocks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once, however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def running(values: Column, combine: Callable[[Column, Column], Column], kind: str = "int") -> Column:
    """combine over all values up to each one (integers of this kind, at least 0), block by block.

    An array grows by copying, so blocks have about as many values as there are blocks.
    """
    none = F.array().cast(f"array<{kind}>")
    last = lambda a: F.when(F.size(a) > 0, F.element_at(a, -1)).otherwise(F.lit(0).cast(kind))
    grown = lambda a, x: F.concat(a, F.array(combine(last(a), x)))

    def blocks(v: Column) -> Column:
        size = F.greatest(F.ceil(F.sqrt(F.size(v))).cast("int"), F.lit(1))
        return F.transform(F.sequence(F.lit(0), F.greatest(F.size(v) - 1, F.lit(0)), size), lambda at: F.aggregate(F.slice(v, at + 1, size), none, grown))

    def joined(b: Column) -> Column:
        before = F.aggregate(b, F.array(F.lit(0).cast(kind)), lambda a, block: F.concat(a, F.array(combine(F.element_at(a, -1), last(block)))))
        return F.flatten(F.zip_with(b, before, lambda block, x: F.transform(F.coalesce(block, none), lambda y: combine(x, y))))

    return let(let(values, blocks), joined)
