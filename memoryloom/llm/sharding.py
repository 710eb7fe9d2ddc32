"""Sharding: contiguous shards of nearly equal bytes, cut from global prefix sums."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .order import bucket_of, quantile_cuts
from .scratch import drop, stage


def shard_by_bytes(df: DataFrame, shards: int, key: str = "doc_id", text: str = "text", rows_per_bucket: int = 20_000) -> DataFrame:
    """Deal every row into contiguous shards (ascending key) of nearly equal bytes.

    Returns doc_id, size (UTF-8 bytes plus 1), text_crc32, shard, slot (gapless position in the shard). A row goes to
    the shard in whose byte range its middle lies, so a shard's size differs from the target by at most one row. Null
    texts have size 1 and crc 0; null keys come first; ties are ordered by crc, then size; an empty table gives an
    empty result; other columns are not read.

    Only (key, size, crc) rows are shuffled. Per-bucket totals, at most 65,536 rows, go to the driver and come back
    as offsets; running sums are taken inside the buckets.
    """
    spark = df.sparkSession
    body = F.coalesce(F.col(text), F.lit(""))
    cuts = quantile_cuts(df.select(F.col(key)), key, rows_per_bucket)
    thin = stage(
        df.select(
            F.col(key).alias("doc_id"),
            (F.octet_length(body).cast("long") + 1).alias("size"),
            F.crc32(body.cast("binary")).alias("text_crc32"),
            bucket_of(F.col(key), cuts).alias("_bucket"),
        ),
        "shard-sizes",
    )
    totals = sorted(map(tuple, thin.groupBy("_bucket").agg(F.sum("size"), F.count("*")).collect()))
    total = sum(t[1] for t in totals)
    offsets = spark.createDataFrame(
        [(t[0], b - t[1], r - t[2]) for t, b, r in zip(totals, accumulate(t[1] for t in totals), accumulate(t[2] for t in totals), strict=True)],
        "_bucket int, _bytes_before long, _rows_before long",
    )
    w = Window.partitionBy("_bucket").orderBy("doc_id", "text_crc32", "size")
    start = F.col("_bytes_before") + F.sum("size").over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
    placed = stage(
        thin.join(F.broadcast(offsets), "_bucket").select(
            "doc_id",
            "size",
            "text_crc32",
            F.least(F.lit(shards - 1), F.floor((2 * start + F.col("size")) * shards / F.lit(2 * max(total, 1)))).cast("int").alias("shard"),
            (F.col("_rows_before") + F.row_number().over(w) - 1).alias("_at"),
        ),
        "shard-places",
    )
    drop(thin)
    firsts = placed.groupBy("shard").agg(F.min("_at").alias("_first"))  # one row a shard
    return placed.join(F.broadcast(firsts), "shard").select("doc_id", "size", "text_crc32", "shard", (F.col("_at") - F.col("_first")).alias("slot"))
