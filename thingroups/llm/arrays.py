"""Array expressions that stay linear on long arrays."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Elements of a block of a running fold: a fold over n elements copies about n * BLOCK / 2 + (n / BLOCK)**2 / 2.
BLOCK = 256


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def running(x: Column, fold: Callable[[Column, Column], Column], kind: str = "int") -> Column:
    """The fold of each element with all before it. ``fold(before, element)`` gets NULL before the first."""
    none = F.array().cast(f"array<{kind}>")

    def through(part: Column) -> Column:
        more = lambda done, v: F.concat(done, F.array(fold(F.try_element_at(done, F.lit(-1)), v).cast(kind)))
        return F.aggregate(part, none, more)

    def joined(blocks: Column) -> Column:
        lasts = through(F.transform(blocks, lambda b: F.element_at(b, -1)))
        before = F.concat(F.array(F.lit(None).cast(kind)), F.slice(lasts, F.lit(1), F.size(blocks) - 1))
        return F.flatten(F.zip_with(blocks, before, lambda b, c: F.transform(b, lambda v: fold(c, v).cast(kind))))

    def blocked(values: Column) -> Column:
        starts = F.sequence(F.lit(0), F.floor((F.size(values) - 1) / BLOCK).cast("int"))
        return joined_of(F.transform(starts, lambda b: through(F.slice(values, b * BLOCK + 1, F.lit(BLOCK)))))

    joined_of = lambda blocks: let(blocks, joined)
    return let(x, lambda values: F.when(F.size(values) > 0, blocked(values)).otherwise(none))


def add(before: Column, v: Column) -> Column:
    return F.coalesce(before, F.lit(0)) + v


def reversed_running(x: Column, fold: Callable[[Column, Column], Column], kind: str = "int") -> Column:
    """The fold of each element with all after it."""
    return F.reverse(running(F.reverse(x), fold, kind))


def zipped(first: Column, second: Column, name: str) -> Column:
    """Structs of the first array with one field more."""
    return F.zip_with(first, second, lambda a, b: F.struct(a.alias("item"), b.alias(name)))


def cut_out(text: Column, begins: Column, ends: Column, part: int = 4_096) -> Column:
    """The pieces of a text from begins to ends (code points, end exclusive), for many of them: the text
    is taken apart once, so that a piece far inside is not counted out from the start."""

    def one(chunks: Column, a: Column, b: Column) -> Column:
        def of(c: Column) -> Column:
            begin = F.greatest(a - c * part, F.lit(0))
            return F.substring(F.element_at(chunks, c + 1), begin + 1, F.least(b - c * part, F.lit(part)) - begin)

        places = F.sequence(F.floor(a / part).cast("int"), F.floor((b - 1) / part).cast("int"))
        return F.when(b > a, F.concat_ws("", F.transform(places, of))).otherwise(F.lit(""))

    whole = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{part}}}"), F.lit(0))
    return let(whole, lambda chunks: F.zip_with(begins, ends, lambda a, b: one(chunks, a, b)))
