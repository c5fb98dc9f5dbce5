"""Small helpers shared by the operators of this package."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of a table of ids and short values that a join may broadcast (some tens of MB); a larger one is shuffled.
BROADCAST_ROWS = 1_000_000


def checked(ids: DataFrame) -> DataFrame:
    """``ids`` (a written table of keys and short values) marked for broadcast if its counted rows allow it."""
    return F.broadcast(ids) if ids.count() <= BROADCAST_ROWS else ids


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def running(steps: Column, block: int = 256) -> Column:
    """Running sums of an array of integers, taken in blocks so that long arrays do not cost the square of their length."""
    zero = F.array(F.lit(0))
    blocks = F.when(F.size(steps) > 0, F.transform(F.sequence(F.lit(0), F.floor((F.size(steps) - 1) / block).cast("int")),
                                                   lambda b: F.slice(steps, b * block + 1, block))).otherwise(F.array().cast("array<array<int>>"))
    inner = F.transform(blocks, lambda x: F.aggregate(x, zero, lambda acc, s: F.concat(acc, F.array(F.element_at(acc, -1) + s))))
    return let(inner, lambda parts: let(F.aggregate(parts, zero, lambda acc, p: F.concat(acc, F.array(F.element_at(acc, -1) + F.element_at(p, -1)))),
                                        lambda before: F.flatten(F.transform(parts, lambda p, i: F.transform(F.slice(p, 2, block), lambda v: v + F.get(before, i))))))


def located(text: Column, pattern: str, value_group: int = 0) -> Column:
    """Array of (start, end, match, value length) of the leftmost non-overlapping matches, in code points, end exclusive.

    Starts follow from the lengths of matches and of the text between them. The pattern matches no empty text.
    """
    found = F.struct(F.transform(F.split(text, pattern, -1), F.length).alias("gaps"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hits"),
                     F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(value_group)), F.length).alias("values"))

    def place(f: Column) -> Column:
        steps = F.transform(f["hits"], lambda h, i: F.get(f["gaps"], i) + F.when(i > 0, F.length(F.get(f["hits"], i - 1))).otherwise(0))
        return let(running(steps), lambda starts: F.transform(f["hits"], lambda h, i: F.struct(
            F.get(starts, i).alias("start"), (F.get(starts, i) + F.length(h)).alias("end"), h.alias("match"), F.get(f["values"], i).alias("value"))))

    empty = F.array().cast("array<struct<start:int,end:int,match:string,value:int>>")
    return F.when(text.rlike(pattern), let(found, place)).otherwise(empty)
