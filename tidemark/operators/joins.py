"""Joins whose physical form follows a measured size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BROADCAST_ROWS = 100_000  # most rows of a small side that is sent to every executor
SALTS = 16


def lookup_join(big: DataFrame, small: DataFrame, on: list[str], how: str = "inner", limit: int = BROADCAST_ROWS) -> DataFrame:
    """Joins a large side that may have hot keys with a lookup table.

    The lookup is counted (to limit + 1 rows): within the limit it is broadcast
    and nothing of the large side moves; beyond it the large side is salted and
    the lookup repeated once per salt, so that a hot key spreads over SALTS tasks.
    The copies are never broadcast: Spark's estimate counts the lookup once and
    would gather all SALTS of them in the driver.
    how is inner, left, left_semi or left_anti.
    """
    if small.limit(limit + 1).count() <= limit:
        return big.join(F.broadcast(small), on, how)
    salted = big.withColumn("_salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int"))
    copies = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).hint("merge")
    return salted.join(copies, [*on, "_salt"], how).drop("_salt")
