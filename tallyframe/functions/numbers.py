"""Tolerant numbers and exact ratios."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyframe.functions.text import strip

MONEY = "decimal(28,10)"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def coerce_decimal(col: Column, kind: str = MONEY) -> Column:
    """Typed or printed amount to a decimal; null when it is none.

    Parentheses negate an amount without sign. Everything but digits, both separators and the
    minus is dropped. With both separators the last one is the decimal mark; commas alone
    are decimal only when there is exactly one with one or two digits behind it. The kept
    characters are one common subexpression, so generated code computes them once.
    """
    kept = F.regexp_replace(col, r"[^0-9.,\-]", "")
    both = F.contains(kept, F.lit(",")) & F.contains(kept, F.lit("."))
    comma_last = F.substring_index(kept, ",", -1).contains(".") == F.lit(False)
    plain = (
        F.when(both & comma_last, F.translate(kept, ",.", "."))
        .when(~both & kept.rlike(r"^-?\d*,\d{1,2}\z"), F.translate(kept, ",", "."))
        .otherwise(F.translate(kept, ",", ""))
    )
    negated = col.rlike(r"(?U)^\s*\(.*\)\s*\z") & ~kept.startswith("-")
    return F.when(negated, F.concat(F.lit("-"), plain)).otherwise(plain).try_cast(kind)


def ratio(num: Column, den: Column, places: int = 4) -> Column:
    """Half-even rounded quotient as double; null on a zero denominator."""
    return F.bround(F.try_divide(num.cast("decimal(20,0)"), den.cast("decimal(20,0)")), places).cast("double")


def f1(precision: Column, recall: Column) -> Column:
    p, r = precision.cast("decimal(12,4)"), recall.cast("decimal(12,4)")
    return F.bround(F.try_divide(2 * p * r, p + r), 4).cast("double")
