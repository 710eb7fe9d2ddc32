"""Global order by an integer key without a single-task sort: quantile cuts and a native bucket lookup."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The most buckets; their bounds and totals are all that the driver ever holds of a table.
MAX_BUCKETS = 65_536


def quantile_cuts(df: DataFrame, key: str, rows_per_bucket: int) -> list[int]:
    """Distinct ascending values of key that cut df into buckets of about rows_per_bucket rows.

    The first cut is the least key. Empty tables and all-null keys have no cuts.
    """
    n = df.count()
    buckets = min(MAX_BUCKETS, max(1, -(-n // rows_per_bucket)))
    shares = [i / buckets for i in range(1, buckets)]
    k = F.col(key).cast("bigint")
    row = df.agg(F.min(k).alias("lo"), F.percentile_approx(k, shares or [0.5], max(10_000, 10 * buckets)).alias("q")).first()
    if row is None or row["lo"] is None:
        return []
    return sorted({row["lo"], *(row["q"] if shares else [])})


def cuts_array(cuts: list[int]) -> Column:
    """The cuts as one folded literal."""
    return F.split(F.lit(",".join(map(str, cuts))), ",").cast("array<bigint>")


def bucket_of(key: Column, cuts: list[int]) -> Column:
    """The number of cuts at or below key, found by binary search inside the row; null keys go to 0."""
    if not cuts:
        return F.lit(0)
    bounds = cuts_array(cuts)
    step, steps = 1, []
    while step <= len(cuts):
        steps.insert(0, step)
        step *= 2
    return F.aggregate(
        F.array(*map(F.lit, steps)),
        F.lit(0),
        lambda at, s: F.when((at + s <= len(cuts)) & (F.get(bounds, at + s - 1) <= key.cast("bigint")), at + s).otherwise(at),
    )
