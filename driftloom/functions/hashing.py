"""Deterministic randomness: every draw is a function of a seed and a row's id, whatever the partitioning."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def rank_key(seed: str, row_id: Column | str) -> Column:
    """The md5 by which rows are put in a random order."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(row_id).cast("string") if isinstance(row_id, str) else row_id.cast("string")))


def hash_int(value: Column) -> Column:
    """The first 32 bits of the md5 of a string."""
    return F.conv(F.substring(F.md5(value), 1, 8), 16, 10).cast("long")


def uniform(seed: str, row_id: Column | str) -> Column:
    """Uniform in (0, 1)."""
    return (F.conv(F.substring(rank_key(seed, row_id), 1, 8), 16, 10).cast("double") + 0.5) / 4294967296.0


def normal(seed: str, row_id: Column | str) -> Column:
    """Standard normal, by the Box-Muller transform of two uniforms."""
    return F.sqrt(-2.0 * F.log(uniform(f"{seed}a", row_id))) * F.cos(2.0 * math.pi * uniform(f"{seed}b", row_id))


def hash_bin(column: Column | str, bins: int = 16) -> Column:
    """A category's bin; null is a category of its own, and the type's name tells '1' from 1."""
    c = F.col(column) if isinstance(column, str) else column
    return F.pmod(hash_int(F.coalesce(c.cast("string"), F.lit("__MISSING__"))), F.lit(bins)).cast("int")
