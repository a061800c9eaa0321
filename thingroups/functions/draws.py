"""Random draws taken from a hash of the row key.

A draw depends only on its salt and on the key, never on partitioning, task
order or a retry after a lost executor: the same row is drawn again wherever it
is recomputed. Each operator uses its own salt, so draws do not correlate.

``md5`` is the default because any SQL engine can repeat it; ``xxhash64`` is the
cheaper choice for very large scans.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = 2**32


def salted(name: str, seed: int) -> str:
    return f"{name}|{seed}"


def digest(salt: str, *parts: Column | str, algo: str = "md5") -> Column:
    """Hex digest that orders rows at random; compare or sort it as text."""
    columns = [F.col(p) if isinstance(p, str) else p for p in parts]
    text = F.concat_ws("|", F.lit(salt), *[c.cast("string") for c in columns])
    if algo == "md5":
        return F.md5(text)
    if algo == "xxhash64":
        return F.lpad(F.lower(F.hex(F.xxhash64(text))), 16, "0")
    raise ValueError(f"unknown hash '{algo}'")


def unit_of(hexdigest: Column) -> Column:
    """Uniform number in [0, 1) from the first 32 bits of a digest."""
    return F.conv(F.substring(hexdigest, 1, 8), 16, 10).cast("bigint") / F.lit(float(SPAN))


def unit(salt: str, *parts: Column | str, algo: str = "md5") -> Column:
    return unit_of(digest(salt, *parts, algo=algo))


def fine_unit(salt: str, *parts: Column | str, algo: str = "md5") -> Column:
    """Uniform number in [0, 1) from 52 bits: every position of a large pool can be drawn."""
    bits = F.conv(F.substring(digest(salt, *parts, algo=algo), 1, 13), 16, 10).cast("bigint")
    return bits / F.lit(float(2**52))


def keep(rate: float, salt: str, *parts: Column | str, algo: str = "md5") -> Column:
    """Bernoulli membership with probability ``rate``: a filter, no shuffle."""
    if rate >= 1:
        return F.lit(True)
    if rate <= 0:
        return F.lit(False)
    return F.substring(digest(salt, *parts, algo=algo), 1, 8) < F.lit(f"{int(rate * SPAN):08x}")


def unit_open(salt: str, *parts: Column | str, algo: str = "md5") -> Column:
    """Uniform number strictly inside (0, 1), safe under a logarithm."""
    bits = F.conv(F.substring(digest(salt, *parts, algo=algo), 1, 8), 16, 10).cast("bigint")
    return (bits + F.lit(0.5)) / F.lit(float(SPAN))
