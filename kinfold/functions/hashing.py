"""Seeded, engine-independent randomness.

Every order and every draw comes from md5 over readable text, so a result depends on the seed
and the data only: not on partitioning, task retries or the engine that evaluates it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _text(part) -> Column:
    return part.cast("string") if isinstance(part, Column) else F.lit(str(part))


def digest(*parts) -> Column:
    """md5 hex digest of the parts joined by ``:``."""
    return F.md5(F.concat_ws(":", *[_text(p) for p in parts]))


def hex_prefix(digest_col: Column, digits: int) -> Column:
    """The leading hex digits as a number. It keeps the digest's own order."""
    return F.conv(F.substring(digest_col, 1, digits), 16, 10).cast("bigint")


def draw_below(bound: Column, *parts) -> Column:
    """A uniform draw from 0 .. bound-1. 60 bits, so the modulo bias is negligible for any table."""
    return F.pmod(hex_prefix(digest(*parts), 15), bound)
