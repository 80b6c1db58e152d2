"""Exact ranks in a total order without a task that sorts a whole group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

ROWS_PER_BUCKET = 20_000


def buckets_for(rows: int) -> int:
    """As many buckets as keep about ``ROWS_PER_BUCKET`` rows in each, 16 at least."""
    return max(16, -(-rows // ROWS_PER_BUCKET))


def bucket_rank(df: DataFrame, *, bucket: Column, order: Sequence[str | Column], by: Sequence[str] = (), rank: str, count: str | None = None) -> DataFrame:
    """0-based rank inside each ``by`` group, in (bucket, order) order.

    ``bucket`` must be a non-decreasing function of the wanted order, or any
    hash where the order is free.  Rows are ranked inside (group, bucket) and
    shifted by the sizes of the lower buckets, of which there is one row each.
    """
    keyed = df.withColumn("_bucket", bucket)
    sizes = keyed.groupBy(*by, "_bucket").agg(F.count(F.lit(1)).alias("_size"))
    group = W.partitionBy(*by) if by else W.partitionBy(F.lit(0))
    below = group.orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select(
        *[F.col(c).alias(f"_at_{c}") for c in by], F.col("_bucket").alias("_at_bucket"),
        F.coalesce(F.sum("_size").over(below), F.lit(0)).alias("_offset"), F.sum("_size").over(group).alias("_count"),
    )
    local = F.row_number().over(W.partitionBy(*by, "_bucket").orderBy(*order))
    same = [F.col(c).eqNullSafe(F.col(f"_at_{c}")) for c in by] + [F.col("_bucket") == F.col("_at_bucket")]
    joined = keyed.withColumn("_local", local).join(offsets, same)
    extra = [F.col("_count").alias(count)] if count else []
    return joined.select(*[F.col(f"`{c}`") for c in df.columns], (F.col("_local") - 1 + F.col("_offset")).alias(rank), *extra)
