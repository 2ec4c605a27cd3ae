"""Column-level numeric helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col_


def half_even(c) -> Column:
    """Python ``round(x)`` on a float: round half to even (``rint``)."""
    return F.rint(col_(c))


def half_star(c) -> Column:
    """``round(x * 2) / 2`` with Python's half-to-even rounding: 2.25 -> 2.0, 2.75 -> 3.0."""
    return F.rint(col_(c) * 2) / 2


def py_round(c, digits: int) -> Column:
    """Python ``round(x, n)`` for presentation (half to even)."""
    return F.bround(col_(c), digits)


def close_to_100(pos, neg, neu) -> tuple[Column, Column, Column]:
    """Re-normalise three shares so they sum to 100: pos, neg rounded half-even on their
    share of the total, neutral takes the remainder.  Total <= 0 leaves the inputs."""
    pos, neg, neu = col_(pos), col_(neg), col_(neu)
    total = pos + neg + neu
    p = F.when(total > 0, F.rint(pos / total * 100)).otherwise(pos)
    n = F.when(total > 0, F.rint(neg / total * 100)).otherwise(neg)
    u = F.when(total > 0, 100 - p - n).otherwise(neu)
    return p, n, u


def equal_width_bin(x, lo, hi, nbins: int) -> Column:
    """numpy/matplotlib histogram bin: ``nbins`` equal bins over [lo, hi], last bin closed.

    ``lo``/``hi`` are columns (e.g. from a one-row aggregate joined on) or literals.
    """
    x, lo, hi = col_(x), col_(lo), col_(hi)
    width = (hi - lo) / nbins
    b = F.floor((x - lo) / width).cast("int")
    return F.when(hi == lo, F.lit(0)).otherwise(F.least(F.greatest(b, F.lit(0)), F.lit(nbins - 1)))
