"""Joins and ordered scans that survive a hot key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def attach_groups(
    facts: DataFrame,
    groups: DataFrame,
    keys: Sequence[str],
    *,
    how: str = "left",
    spread: str | None = "trial_uid",
    salts: int = 8,
) -> DataFrame:
    """Equi-join a fact table to one row per group.

    The fact side is salted by a row hash and the group side is repeated per
    salt, so a key holding a third of the facts is spread over ``salts`` tasks.
    Spark still turns the join into a broadcast when the measured size of the
    group side is under ``spark.sql.autoBroadcastJoinThreshold``.
    """
    keys = list(keys)
    others = [c for c in facts.columns if c not in keys]
    source = [spread] if spread in facts.columns else (others or keys)
    left = facts.withColumn("_salt", F.pmod(F.xxhash64(*source), F.lit(salts)).cast("int"))
    right = groups.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right, [*keys, "_salt"], how).drop("_salt")


def ordered_scan(
    df: DataFrame,
    *,
    by: Sequence[str],
    chunk: str,
    order: Sequence[str],
    running: dict[str, Column] | None = None,
    previous: dict[str, Column] | None = None,
    following: dict[str, Column] | None = None,
    inclusive: bool = True,
) -> DataFrame:
    """Running sums, last-seen and next-seen values in one long ordered log.

    ``chunk`` is a non-decreasing function of the order (a time bucket), so a
    log is processed chunk by chunk in parallel: windows run inside (log,
    chunk), one summary row per chunk carries the state across chunks, and the
    carried value is joined back.  A single huge log is never sorted by one
    task.

    ``running`` adds sums up to and including the row, ``previous`` the last
    non-null value before the row (including it if ``inclusive``), ``following``
    the first non-null value after the row (including it if ``inclusive``).
    """
    by = list(by)
    running, previous, following = running or {}, previous or {}, following or {}
    work = df
    for name, expr in {**running, **previous, **following}.items():
        work = work.withColumn(f"_in_{name}", expr)
    forward = W.partitionBy(*by, chunk).orderBy(*order)
    backward = W.partitionBy(*by, chunk).orderBy(*[F.desc(o) for o in order])
    upto = forward.rowsBetween(W.unboundedPreceding, 0 if inclusive else -1)
    onward = backward.rowsBetween(W.unboundedPreceding, 0 if inclusive else -1)
    for name in running:
        work = work.withColumn(name, F.sum(f"_in_{name}").over(forward.rowsBetween(W.unboundedPreceding, 0)))
    for name in previous:
        work = work.withColumn(name, F.last(f"_in_{name}", ignorenulls=True).over(upto))
    for name in following:
        work = work.withColumn(name, F.last(f"_in_{name}", ignorenulls=True).over(onward))
    position = F.struct(*order)
    aggs = [F.sum(f"_in_{n}").alias(f"_out_{n}") for n in running]
    aggs += [
        F.max_by(f"_in_{n}", F.when(F.col(f"_in_{n}").isNotNull(), position)).alias(f"_out_{n}") for n in previous
    ]
    aggs += [
        F.min_by(f"_in_{n}", F.when(F.col(f"_in_{n}").isNotNull(), position)).alias(f"_out_{n}") for n in following
    ]
    inputs = [f"_in_{n}" for n in (*running, *previous, *following)]
    source = df
    for name, expr in {**running, **previous, **following}.items():
        source = source.withColumn(f"_in_{name}", expr)
    chunks = source.select(*by, chunk, *[o for o in order if o not in by and o != chunk], *inputs).groupBy(*by, chunk).agg(*aggs)
    before = W.partitionBy(*by).orderBy(chunk).rowsBetween(W.unboundedPreceding, -1)
    after = W.partitionBy(*by).orderBy(F.desc(chunk)).rowsBetween(W.unboundedPreceding, -1)
    carried = chunks.select(
        *by,
        chunk,
        *[F.sum(f"_out_{n}").over(before).alias(f"_carry_{n}") for n in running],
        *[F.last(f"_out_{n}", ignorenulls=True).over(before).alias(f"_carry_{n}") for n in previous],
        *[F.last(f"_out_{n}", ignorenulls=True).over(after).alias(f"_carry_{n}") for n in following],
    )
    out = work.join(carried, [*by, chunk], "left")
    for name in running:
        out = out.withColumn(name, F.coalesce(name, F.lit(0)) + F.coalesce(f"_carry_{name}", F.lit(0)))
    for name in (*previous, *following):
        out = out.withColumn(name, F.coalesce(name, f"_carry_{name}"))
    return out.drop(*inputs, *[f"_carry_{n}" for n in (*running, *previous, *following)])
