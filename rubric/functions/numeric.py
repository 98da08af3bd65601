"""Numeric helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_half_up(c: Column, digits: int = 6) -> Column:
    """floor(x * 10^d + 0.5) / 10^d in IEEE double arithmetic.

    Unlike ``round`` (which rounds the shortest decimal form), this is
    computed the same way by any engine with IEEE doubles, so results
    compare exactly across engines.  Values too large for a long are
    returned unrounded.
    """
    scale = float(10 ** digits)
    x = c.cast("double")
    return F.when(F.abs(x) < F.lit(1e12), F.floor(x * F.lit(scale) + F.lit(0.5)) / F.lit(scale)).otherwise(x)
