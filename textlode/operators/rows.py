"""Array expressions within the row of a file: running sums, counts and selections of its lines, without any shuffle.

Running sums are taken in blocks, so that the k-th costs about `BLOCK` additions and not k.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

BLOCK = 128


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once; without it an expression inside of a lambda is computed at every call."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0).cast("long"), lambda a, b: a + b)


def sums(values: Column) -> Column:
    """The sum of each block of an array of longs."""
    blocks = F.ceil(F.size(values) / F.lit(BLOCK)).cast("int")
    each = F.transform(F.sequence(F.lit(0), F.greatest(blocks - 1, F.lit(0))), lambda b: total(F.slice(values, b * BLOCK + 1, F.lit(BLOCK))))
    return F.when(blocks > 0, each).otherwise(F.array().cast("array<bigint>"))


def before(values: Column, blocks: Column, at: Column) -> Column:
    """The sum of the first `at` values, given the sums of the blocks."""
    block = F.floor(at / F.lit(BLOCK)).cast("int")
    return total(F.slice(blocks, F.lit(1), block)) + total(F.slice(values, block * BLOCK + 1, (at % BLOCK).cast("int")))


def running(values: Column, body: Callable[[Callable[[Column], Column]], Column]) -> Column:
    """`body` of a function from a position to the sum of all values before it."""
    return let(values, lambda v: let(sums(v), lambda s: body(lambda at: before(v, s, at))))


def any_of(conditions: list[Column]) -> Column:
    """A balanced `or`: its depth is the logarithm of their number."""
    while len(conditions) > 1:
        conditions = [conditions[k] | conditions[k + 1] if k + 1 < len(conditions) else conditions[k] for k in range(0, len(conditions), 2)]
    return conditions[0]
