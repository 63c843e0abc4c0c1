"""Column helpers shared by the native operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words are maximal runs of anything but space and the controls 9 to 13.
SPACE = r"[\x20\x09-\x0D]"
NOT_SPACE = r"[^\x20\x09-\x0D]"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    """The words of text, in order."""
    one_line = F.regexp_replace(F.regexp_replace(text, SPACE + "+", " "), "^ | $", "")
    return F.filter(F.split(one_line, " "), lambda w: w != "")


def starts(lengths: Column, block: int = 256) -> Column:
    """Exclusive running totals of an array<int>. Appending copies the array, so it is done by blocks."""

    def totals(values: Column) -> Column:
        return F.aggregate(values, F.array(F.lit(0)), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + x)))

    blocks = F.transform(
        F.sequence(F.lit(0), F.floor(F.greatest(F.size(lengths) - 1, F.lit(0)) / block).cast("int")),
        lambda b: totals(F.slice(lengths, b * block + 1, block)),
    )
    return let(
        blocks,
        lambda bs: let(
            totals(F.transform(bs, lambda b: F.element_at(b, -1))),
            lambda offsets: F.flatten(
                F.transform(bs, lambda b, i: F.transform(F.slice(b, 1, F.size(b) - 1), lambda x: x + offsets[i]))
            ),
        ),
    )
