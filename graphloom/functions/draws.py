"""Seeded draws as pure functions of a key, the same in every engine and on every retry."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = 4294967296


def _text(part: Column | str | int) -> Column:
    return part.cast("string") if isinstance(part, Column) else F.lit(str(part))


def draw(*key: Column | str | int) -> Column:
    """An integer in [0, 2**32) that depends on the parts of ``key`` alone."""
    return F.conv(F.substring(F.md5(F.concat(*map(_text, key)).cast("binary")), 1, 8), 16, 10).cast("bigint")


def uniform(*key: Column | str | int) -> Column:
    """A double in [0, 1)."""
    return draw(*key) / F.lit(float(SPAN))


def under(chance: float) -> str:
    """What the hexadecimal digest of a key must sort before, for ``uniform`` of the key to be under ``chance``."""
    limit = math.ceil(chance * SPAN)
    return "g" if limit >= SPAN else f"{max(limit, 0):08x}"


def hit(below: Column | str, *key: Column | str | int) -> Column:
    """Whether ``uniform`` of the key is under a chance, by comparing its digest with ``under(chance)``: no number is made."""
    return F.md5(F.concat(*map(_text, key)).cast("binary")) < below


def draw_sql(key: str) -> str:
    """DuckDB's form of ``draw`` for an SQL string expression."""
    return f"('0x' || substr(md5({key}), 1, 8))::BIGINT"
