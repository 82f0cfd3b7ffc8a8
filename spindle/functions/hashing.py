"""Identifiers, seeds and hash-ranked draws as column expressions; any SQL engine with SHA-256 can repeat them.

Draws replace a sequential random generator: each row's draw is a function of its seed, a tag and its index, so results
don't depend on partitioning or order. Their distribution is that of the generator; the single draws differ.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def text(x) -> Column:
    """A value as it is written in identifiers: None, True and False for null and booleans."""
    return F.coalesce(x if isinstance(x, Column) else F.lit(x), F.lit("None")) if x is not None else F.lit("None")


def flag(x: Column) -> Column:
    return F.when(x, F.lit("True")).otherwise(F.lit("False"))


def digest(*parts) -> Column:
    return F.sha2(F.concat_ws("|", *[p if isinstance(p, Column) else F.lit(str(p)) for p in parts]), 256)


def sample_id(*parts) -> Column:
    return F.substring(digest(*parts), 1, 24)


def stable_seed(*parts) -> Column:
    """First 8 bytes of the digest, read from the least significant byte, without the sign bit."""
    h = digest(*parts)
    turned = F.concat(*[F.substring(h, 2 * i + 1, 2) for i in range(7, -1, -1)])
    return (F.conv(turned, 16, 10).cast("decimal(20,0)") % F.lit("9223372036854775808").cast("decimal(20,0)")).cast("long")


def stable_int(json_text: Column) -> Column:
    """First 8 bytes of the digest of a compact JSON text, most significant first, modulo 2^63 - 1."""
    return (F.conv(F.substring(F.sha2(json_text, 256), 1, 16), 16, 10).cast("decimal(20,0)") % F.lit("9223372036854775807").cast("decimal(20,0)")).cast("long")


def draw(*parts) -> Column:
    """52 random bits as a long."""
    return F.conv(F.substring(digest(*parts), 1, 13), 16, 10).cast("long")


def uniform(*parts) -> Column:
    """A double in [0, 1)."""
    return draw(*parts) / F.lit(float(2**52))
