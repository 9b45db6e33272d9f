"""Complex numbers as two DOUBLE columns."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TINY = 1e-30


def dot_re(ar, ai, br, bi) -> Column:
    """Real part of conj(a) * b."""
    return ar * br + ai * bi


def dot_im(ar, ai, br, bi) -> Column:
    """Imaginary part of conj(a) * b."""
    return ar * bi - ai * br


def abs2(re, im) -> Column:
    return re * re + im * im


def finite(*cols) -> Column:
    """True when every column is neither NULL, NaN nor infinite."""
    out = None
    for c in cols:
        ok = c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))
        out = ok if out is None else out & ok
    return out


def clip(value: Column, low: float = 0.0, high: float = 1.0) -> Column:
    """Clip that keeps NULL (``least`` / ``greatest`` skip NULL arguments)."""
    return F.when(value.isNotNull(), F.least(F.greatest(value, F.lit(low)), F.lit(high)))


def mac_value(xr, xi, na, nb) -> Column:
    """Squared correlation of two shapes from their four sums; NULL without energy, clipped to [0, 1]."""
    value = abs2(xr, xi) / F.when((na > TINY) & (nb > TINY), na * nb)
    return clip(value)
