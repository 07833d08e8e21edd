"""Keyed pseudo-randomness: the same key gives the same draw on any partitioning."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def key_hash(seed: int | str, *cols: Column | str) -> Column:
    """md5 of ``seed|col|col…`` in lower-case hex."""
    parts = [F.col(c) if isinstance(c, str) else c for c in cols]
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[p.cast("string") for p in parts]))


def hex_number(h: Column, digits: int = 8, start: int = 1) -> Column:
    return F.conv(F.substring(h, start, digits), 16, 10).cast("long")


def pick(h: Column, n: int | Column, start: int = 1) -> Column:
    """An integer in ``0..n-1``."""
    return (hex_number(h, 8, start) % n).cast("int")


def uniform(h: Column, start: int = 1) -> Column:
    """A double in ``[0, 1)``."""
    return hex_number(h, 8, start).cast("double") / F.lit(4294967296.0)


def gauss(h: Column, start_a: int = 1, start_b: int = 9) -> Column:
    """A standard normal draw from two uniforms of the same hash (Box-Muller)."""
    u1 = (hex_number(h, 8, start_a).cast("double") + F.lit(0.5)) / F.lit(4294967296.0)
    return F.sqrt(F.lit(-2.0) * F.log(u1)) * F.cos(F.lit(2.0) * F.pi() * uniform(h, start_b))


def hash_block(h: Column, digits: int = 3) -> Column:
    """Leading hex digits: an order-preserving, evenly filled block for ``block_rank``."""
    return F.substring(h, 1, digits)
