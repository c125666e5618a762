"""Seeded uniform numbers that depend on the identifier alone, equal in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: 13 hexadecimal digits fit a double exactly
SPAN = 16**13


def permanent_int(ident: Column, seed: str) -> Column:
    """Uniform integer in [0, 16**13) from md5(id|seed); null for a null id."""
    return F.conv(F.substring(F.md5(F.concat(ident.cast("string"), F.lit("|" + seed))), 1, 13), 16, 10).cast("long")


def permanent_uniform(ident: Column, seed: str) -> Column:
    """The same as a double in [0, 1)."""
    return permanent_int(ident, seed) / F.lit(float(SPAN))


def permanent_int_sql(expr: str, seed: str) -> str:
    """The integer in DuckDB SQL."""
    return f"('0x' || substr(md5({expr} || '|{seed}'), 1, 13))::BIGINT"
