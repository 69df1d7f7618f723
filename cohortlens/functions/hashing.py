"""Seeded hashes used for every repeatable random choice.

``portable_hash`` is the first 60 bits of md5('<seed>|<key>') as a non-negative
bigint.  The same number is produced by DuckDB with
``('0x' || substr(md5('<seed>|' || key), 1, 15))::BIGINT``, so split, fold,
bootstrap and SMOTE choices can be repeated by an independent SQL oracle.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Draws reach every row of a table of any size: 60 bits are far more than rows.
HASH_BITS = 60
HASH_RANGE = 1 << HASH_BITS


def _key_string(*keys) -> Column:
    cols = [F.col(k) if isinstance(k, str) else k for k in keys]
    parts = []
    for i, c in enumerate(cols):
        if i:
            parts.append(F.lit("|"))
        parts.append(c.cast("string"))
    return F.concat(*parts) if len(parts) > 1 else parts[0]


def portable_hash(seed: int | str, *keys) -> Column:
    """md5-based 60-bit hash of (seed, keys...) as bigint in [0, HASH_RANGE)."""
    s = F.concat(F.lit(f"{seed}|"), _key_string(*keys))
    return F.conv(F.substring(F.md5(s), 1, HASH_BITS // 4), 16, 10).cast("bigint")


def portable_hash_sql(seed: int | str, *key_sql: str) -> str:
    """DuckDB text of :func:`portable_hash` for the oracle."""
    inner = " || '|' || ".join(f"CAST({k} AS VARCHAR)" for k in key_sql)
    return f"CAST(('0x' || substr(md5('{seed}|' || {inner}), 1, {HASH_BITS // 4})) AS BIGINT)"

