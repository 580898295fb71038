"""Column functions on arrays."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Items whose sizes are added up one by one; a place needs the sums of whole blocks and part of one.
BLOCK = 64


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often, and in whatever loop, the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def starts(sizes: Column) -> Column:
    """Where each of some items begins, from 0: the sums of the sizes before, without a window or a shuffle."""

    def total(part: Column) -> Column:
        return F.aggregate(part, F.lit(0).cast("long"), lambda a, x: a + x)

    def from_blocks(sizes: Column, blocks: Column) -> Column:
        block = lambda i: F.floor(i / BLOCK).cast("int")
        return F.transform(sizes, lambda _, i: F.get(blocks, block(i)) + total(F.slice(sizes, block(i) * BLOCK + 1, i % BLOCK)))

    def blocks(sizes: Column) -> Column:
        sums = F.transform(F.sequence(F.lit(0), F.floor(F.size(sizes) / BLOCK).cast("int")), lambda b: total(F.slice(sizes, b * BLOCK + 1, BLOCK)))
        return F.aggregate(sums, F.array(F.lit(0).cast("long")), lambda kept, x: F.concat(kept, F.array(F.element_at(kept, -1) + x)))

    return let(sizes, lambda s: let(blocks(s), lambda b: from_blocks(s, b)))
