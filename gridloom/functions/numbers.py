"""Number helpers shared by metrics and text builders."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def safe_div(num: Column, den: Column) -> Column:
    """``num / den``, and 0 where the denominator is not positive."""
    return F.when(den > 0, num.cast("double") / den.cast("double")).otherwise(F.lit(0.0))


def half_even(c: Column, places: int = 4) -> Column:
    return F.bround(c, places)


def fixed(c: Column, places: int) -> Column:
    """Fixed-point text, half-even on the binary value (``format_string`` would round ties up)."""
    return F.replace(F.format_number(c, places), F.lit(","), F.lit(""))


def clamp01(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))


def clamp_cloud_cover(c: Column) -> Column:
    """Cloud cover as a fraction in [0, 1]; null stays null (``least`` alone would hide it)."""
    return F.when(c.isNotNull(), clamp01(c))
