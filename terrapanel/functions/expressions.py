"""Column expressions used across the library; all stay inside code generation."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(a: Column, b: Column, scale: float = 1.0) -> Column:
    """scale*a/b as double, NULL when the denominator is zero or missing."""
    return F.lit(scale) * a.cast("double") / F.nullif(b.cast("double"), F.lit(0.0))


def safe_ln(c: Column) -> Column:
    return F.when(c > 0, F.ln(c))


def normalised_code(c: Column) -> Column:
    return F.upper(F.trim(c))


def clip(c: Column, lo: float, hi: float) -> Column:
    return F.greatest(F.lit(lo), F.least(F.lit(hi), c))


def snap(c: Column, cell: float) -> Column:
    """Lower corner of the square grid cell that contains the coordinate."""
    return F.floor(c / F.lit(cell)) * F.lit(cell)


def band(c: Column, cuts: list[tuple[float, str]], last: str) -> Column:
    """Label by upper bounds, inclusive: the first cut with c <= bound wins."""
    if not cuts:
        return F.when(c.isNotNull(), F.lit(last))
    expr = F.when(c.isNull(), F.lit(None).cast("string"))
    for bound, label in cuts:
        expr = expr.when(c <= bound, F.lit(label))
    return expr.otherwise(F.lit(last))


def category_of(c: Column, groups: dict[str, list[str]], default: str = "UNKNOWN") -> Column:
    """Map raw categories to group labels; anything unlisted or missing is ``default``."""
    raw = F.lower(F.trim(c))
    pairs = [(value.strip().lower(), label) for label, values in groups.items() for value in values]
    table = F.create_map(*[F.lit(x) for pair in pairs for x in pair])
    return F.coalesce(F.try_element_at(table, F.coalesce(raw, F.lit(""))), F.lit(default))


def number_from_text(c: Column) -> Column:
    """Strict parse of '1,680' style numbers; text that is not a number stops the run (ANSI cast)."""
    return F.regexp_replace(F.trim(c), ",", "").cast("double")


def row_mean(columns: list[str]) -> Column:
    total = sum((F.col(c) for c in columns[1:]), F.col(columns[0]))
    return total / F.lit(float(len(columns)))


def row_sum(columns: list[str]) -> Column:
    return sum((F.coalesce(F.col(c), F.lit(0)) for c in columns[1:]), F.coalesce(F.col(columns[0]), F.lit(0)))


def rate_per(count: Column, base: Column, per: float = 1000.0) -> Column:
    return ratio(count, base, per)


def scaled_rank(rank: Column, n: Column) -> Column:
    """Rank 1 of n becomes 1, rank n becomes 1/n."""
    return (n.cast("double") - rank.cast("double") + 1.0) / n.cast("double")


def exponential_score(share: Column, constant: float = 23.0, top: float = 100.0) -> Column:
    """Published exponential transform of a scaled rank to (0, top]."""
    spread = 1.0 - math.exp(-top / constant)
    return F.lit(-constant) * F.ln(F.lit(1.0) - share * F.lit(spread))


def weighted_blend(columns: dict[str, float], rescale: bool) -> Column:
    """Linear combination; ``rescale`` makes the weights of the given columns sum to one."""
    total = sum(columns.values()) if rescale else 1.0
    terms = [F.col(c) * F.lit(w / total) for c, w in columns.items()]
    return sum(terms[1:], terms[0])


def percent_effect(b: Column, step: Column | float = 1.0) -> Column:
    """Log-point coefficient as a percentage change per ``step`` of the regressor."""
    step = step if isinstance(step, Column) else F.lit(float(step))
    return F.lit(100.0) * (F.exp(b * step) - 1.0)


def rounded_half_up(c: Column, digits: int) -> Column:
    """``F.round`` of a double to the bit, several times as fast: decimals are only made of numbers too large, or next to the middle of two results."""
    scaled = F.abs(c) * F.lit(10.0 ** digits)
    up = F.floor(scaled + F.lit(0.5))
    sure = (scaled < F.lit(2.0 ** 40)) & (F.abs(scaled - up) < F.lit(0.499))
    return F.when(sure, F.when(c < 0, -up).otherwise(up).cast("double") / F.lit(10.0 ** digits)).otherwise(F.round(c, digits))


def decay_weight(distance: Column, scale: float) -> Column:
    return F.exp(-distance / F.lit(float(scale)))


PRIME = 2147483647


def mixed(number, rep, seed: int):
    """A key of an entity's number in a replication: whole numbers under 2^31 - 1, by squaring, so that any engine draws the same. Columns, arrays or numbers."""
    x = (number * 48271 + rep * 69621 + seed * 16807) % PRIME
    for added in (number, rep, number * 31):
        x = (x * x + added) % PRIME
    return x
