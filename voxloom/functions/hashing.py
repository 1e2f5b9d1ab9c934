"""Seeded hashing that does not depend on partitioning, retries or engine."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def md5_key(seed: int, *cols: Column | str) -> Column:
    """Hex digest of ``seed:col1:col2...``; ordering by it is a reproducible random order."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[_col(c).cast("string") for c in cols]))


def uniform(digest: Column | str) -> Column:
    """A number in [0, 1) from the first 32 bits of a hex digest."""
    return F.conv(F.substring(_col(digest), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def md5_uniform(seed: int, *cols: Column | str) -> Column:
    return uniform(md5_key(seed, *cols))
