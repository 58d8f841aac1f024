"""Row caps, seeded samples and seeded shuffles (all deterministic)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def row_cap(df: DataFrame, n: int, order: Sequence[str]) -> DataFrame:
    """First ``n`` rows in ``order`` (``nrows`` of a line file). Planned as a
    per-partition top-n plus one merge of at most n rows per partition."""
    return df.orderBy(*order).limit(n)


def seeded_key(key: str, seed: int = 42, method: str = "xxhash64") -> Column:
    """Per-row sort key for a seeded order.

    ``xxhash64`` is the fastest; ``md5`` of ``'<seed>:<key>'`` gives the same
    order in any engine that has MD5 (used where results are checked against SQL).
    """
    if method == "xxhash64":
        return F.xxhash64(F.col(key), F.lit(seed))
    if method == "md5":
        return F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))
    raise ValueError(f"unknown method {method!r}")


def hash_shuffle(df: DataFrame, key: str, seed: int = 42, method: str = "xxhash64") -> DataFrame:
    """Seeded, reproducible row order (a range-partitioned sort on a hash)."""
    return df.orderBy(seeded_key(key, seed, method), F.col(key))


def hash_sample(df: DataFrame, n: int, key: str, seed: int = 42, method: str = "xxhash64") -> DataFrame:
    """``n`` rows without replacement, chosen by a seeded hash of ``key`` (same rows every run)."""
    return df.withColumn("_h", seeded_key(key, seed, method)).orderBy("_h", key).limit(n).drop("_h")
