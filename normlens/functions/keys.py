"""Deterministic draw keys and hash choice.

Every random draw in the package is ordered by ``md5('<seed>:<id>')`` with
the id itself as tie key, so results do not depend on partitioning, call
order or a global RNG, and the same rows are chosen by any SQL engine
that has ``md5``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def draw_key(id_col, seed: int | str, salt: str = "") -> Column:
    """Hex md5 of ``'<seed>:<salt><id>'``; sort on it for a seeded shuffle."""
    return F.md5(F.concat(F.lit(f"{seed}:{salt}"), _c(id_col).cast("string")))


def hash_bucket(key_hex: Column, n: Column) -> Column:
    """``int(key_hex[:8], 16) mod n``; NULL when ``n`` is 0 or NULL.

    The guard comes first: under ANSI mode a modulo by zero raises.
    """
    as_int = F.conv(F.substring(key_hex, 1, 8), 16, 10).cast("bigint")
    return F.when(n > 0, F.pmod(as_int, n))
