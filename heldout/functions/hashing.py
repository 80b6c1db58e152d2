"""Seeded SHA-256 ordering and ranks that need no single-task sort.

Random choices in the whole package come from one place: the order of
``sha256("seed:part:part...")``.  It does not depend on partitioning, so a lost
executor or another cluster size gives the same assignment.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from heldout.functions.materialize import materialize

HEX_BUCKETS = 3  # hash prefix length: 16**3 buckets per rank group


def _col(part) -> Column:
    if isinstance(part, Column):
        return part.cast("string")
    return F.lit(str(part))


def seeded_hash(seed, *parts) -> Column:
    """SHA-256 hex of the parts joined by ``:``; strings and ints are literals."""
    return F.sha2(F.concat_ws(":", _col(seed), *[_col(p) for p in parts]), 256)


def hash_bigint(hash_column: str | Column, start: int = 1, digits: int = 15) -> Column:
    h = F.col(hash_column) if isinstance(hash_column, str) else hash_column
    return F.conv(F.substring(h, start, digits), 16, 10).cast("bigint")


def hash_rank(
    df: DataFrame,
    *,
    hash_column: str,
    tie: str,
    by: Sequence[str] = (),
    rank: str = "rank",
    count: str | None = None,
    digits: int = HEX_BUCKETS,
) -> DataFrame:
    """Exact 1-based rank in (hash, tie) order inside each ``by`` group.

    Rows are bucketed by the leading hash digits, which are uniform whatever
    the data looks like, ranked inside (group, bucket), and shifted by the row
    count of the lower buckets.  No task ever sorts a whole group, so one group
    holding most of the table is still spread over 16**digits buckets.
    """
    groups = ", ".join([*by, "_bucket"])
    within = f"partition by {', '.join([*by, '0'])}"  # at most 16**digits rows per group
    bucketed = df.withColumn("_bucket", F.substring(hash_column, 1, digits))
    offsets = (
        bucketed.groupBy(*by, "_bucket")
        .agg(F.count(F.lit(1)).alias("_size"))
        .selectExpr(
            *by,
            "_bucket",
            f"coalesce(sum(_size) over ({within} order by _bucket rows between unbounded preceding and 1 preceding), 0L)"
            " AS _offset",
            f"sum(_size) over ({within}) AS _count",
        )
    )
    ranked = bucketed.selectExpr(
        "*", f"row_number() over (partition by {groups} order by {hash_column}, {tie}) AS _local"
    ).join(offsets, [*by, "_bucket"])
    return ranked.selectExpr(
        *df.columns, f"_local + _offset AS {rank}", *([f"_count AS {count}"] if count else [])
    )


def ordered_index(values: DataFrame, column: str, index: str) -> DataFrame:
    """Distinct values with their 0-based place in order, without a task that sees them all.

    Values are cut into ranges that are numbered each on its own and shifted by
    the sizes of the ranges before; the cut is written once, so it can't change
    between its two readers.
    """
    ranges = values.select(column).distinct().repartitionByRange(column).withColumn("_range", F.spark_partition_id())
    ranges = materialize(ranges)
    sizes = ranges.groupBy("_range").agg(F.count(F.lit(1)).alias("_size"))
    earlier = W.partitionBy(F.lit(0)).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)  # one row per range
    below = sizes.select("_range", F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_below"))
    local = ranges.withColumn("_local", F.row_number().over(W.partitionBy("_range").orderBy(column)) - 1)
    return local.join(F.broadcast(below), "_range").select(column, (F.col("_local") + F.col("_below")).alias(index))


def first_per_group(
    df: DataFrame,
    *,
    by: Sequence[str],
    order: Sequence,
    limit: int,
    rank: str = "rank",
    spread: str,
    salts: int = 64,
) -> DataFrame:
    """The first ``limit`` rows of each group, exact, in two bounded steps.

    Each group is cut into ``salts`` pieces by the hash of ``spread``; a piece
    keeps only its own first rows, so the final ranking of a group sees at most
    ``salts * limit`` rows however large the group is.
    """
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(salts)))
    piece = W.partitionBy(*by, "_salt").orderBy(*order)
    kept = salted.withColumn("_piece", F.row_number().over(piece)).filter(F.col("_piece") <= limit)
    whole = W.partitionBy(*by).orderBy(*order)
    return (
        kept.withColumn(rank, F.row_number().over(whole))
        .filter(F.col(rank) <= limit)
        .drop("_salt", "_piece")
    )


def support_digest(uid: str = "trial_uid") -> Column:
    """Order-free digest of a set of identifiers, as one aggregate.

    Four 60-bit pieces of each identifier's SHA-256 are summed exactly and the
    sums are hashed again with the row count, so the digest is computed with
    partial aggregation and never gathers the identifiers in one place.
    """
    h = F.sha2(F.col(uid), 256)
    sums = [
        F.sum(hash_bigint(h, start).cast("decimal(38,0)")).cast("string") for start in (1, 16, 31, 46)
    ]
    return F.sha2(F.concat_ws(":", F.count(F.lit(1)).cast("string"), *sums), 256)
