"""Reproducible per-row uniforms.

``uniform(seed, k1, k2, ...)`` hashes the seed and the keys with md5 and
maps the first 32 bits to [0, 1). The same value comes out of any engine
that has md5 (the DuckDB oracles use
``('0x'||substr(md5(...),1,8))::BIGINT / 4294967296.0``), it does not
depend on partitioning or task retries, and it is salted by purpose so
that two operators never share a stream.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TWO_32 = 4294967296.0


def _lit_or_col(x) -> Column:
    if isinstance(x, Column):
        return x
    if isinstance(x, str):
        return F.col(x)
    return F.lit(x)


def uniform(seed, *keys) -> Column:
    """Deterministic uniform in [0, 1) from ``md5(seed|k1|k2|...)``.

    ``seed`` may be an int/str literal or a Column; ``keys`` are column
    names or Columns (use ``F.lit`` for constant salts).
    """
    parts = [F.lit(str(seed)) if not isinstance(seed, Column) else seed]
    parts += [_lit_or_col(k).cast("string") for k in keys]
    h = F.md5(F.concat_ws("|", *parts))
    return F.conv(F.substring(h, 1, 8), 16, 10).cast("double") / F.lit(TWO_32)


def uniform_sql(seed, *keys: str) -> str:
    """The same uniform as a DuckDB SQL expression (for oracles/tests)."""
    inner = " || '|' || ".join([f"'{seed}'"] + [f"CAST({k} AS VARCHAR)" for k in keys])
    return f"(('0x' || substr(md5({inner}), 1, 8))::BIGINT / 4294967296.0)"
