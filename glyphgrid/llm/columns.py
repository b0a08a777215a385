"""Column helpers shared by the operators that stay in DataFrame functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: White space and words as the queries' contracts define them.
BLANKS = r"[\x20\x09-\x0D]+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value`` evaluated once a row, however often ``body`` names it.

    Inside a lambda a plain column expression would be evaluated again for each element.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def unused(df: DataFrame, *names: str) -> list[str]:
    """Column names like ``names`` that ``df`` does not have, so that the caller's columns stay whatever they are called."""
    taken = {c.lower() for c in df.columns}
    found = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        found.append(name)
    return found


def words(text: Column) -> Column:
    """The words of a text, in order; none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), BLANKS), "")


def total(numbers: Column) -> Column:
    return F.aggregate(numbers, F.lit(0).cast("long"), lambda a, x: a + x)


def each_index(size: Column) -> Column:
    """0 .. size-1, empty for 0 and less."""
    return F.when(size > 0, F.sequence(F.lit(0), (size - 1).cast("int"))).otherwise(F.array().cast("array<int>"))


def running_totals(numbers: Column, block: int = 256) -> Column:
    """For each number the sum of those before it; by blocks, so that long arrays cost little more than short ones."""

    def by_block(xs: Column) -> Column:
        blocks = F.transform(each_index(F.ceil(F.size(xs) / block)), lambda b: F.slice(xs, b * block + 1, F.lit(block)))
        return let(blocks, lambda bs: let(F.transform(bs, total), lambda sums: F.flatten(F.transform(bs, lambda xs_, b: let(total(F.slice(sums, F.lit(1), b)), lambda base: F.transform(xs_, lambda _, i: base + total(F.slice(xs_, F.lit(1), i))))))))

    return let(numbers, by_block)
