"""Sharding by proportional stratified interleaving, with built-in functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heldout.functions.materialize import materialize
from heldout.llm.ranks import bucket_rank, buckets_for
from heldout.llm.text import plain

SHARDS = 24


def _hash(*parts) -> Column:
    """The first 60 bits of the MD5 of the parts that aren't null, joined by colons: the same in any SQL engine."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *[F.col(p).cast("string") if isinstance(p, str) else p.cast("string") for p in parts])), 1, 15), 16, 10).cast("bigint")


def interleave(docs: DataFrame, shards: int = SHARDS, seed: int = 1) -> DataFrame:
    """Put every row of ``docs`` into one of ``shards`` shards of equal row counts and equal source mixture.

    Rows are shuffled by a seeded MD5 and ranked within their source; the rank
    over the source's size is the row's place in [0, 1), shifted by a hash of
    the source so that small sources don't meet at one place.  The table in the
    order of places is cut into runs whose lengths differ by one at most, so
    each shard gets its share of every source, to within two rows of a source.
    The law is ``rows``; slots are the positions in a run.

    Null text counts as no bytes; null is a source of its own; rows with a null
    or repeated doc_id are placed one by one, and rows equal in all of doc_id,
    source and text are interchangeable.  An empty table gives no row.
    """
    light = materialize(plain(docs, "doc_id", "text", "source").select(
        "doc_id", "source", (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("bigint").alias("size"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
        F.when(F.col("doc_id").isNull(), F.monotonically_increasing_id()).alias("_row"),  # tells rows without an id apart
    ))
    total = light.count()
    many = buckets_for(total)
    shuffled = light.withColumn("_hash", _hash(F.lit(seed), "doc_id", "size", "text_crc32", "_row"))
    in_source = bucket_rank(
        shuffled, by=["source"], bucket=F.expr(f"shiftright(shiftright(_hash, 30) * {many}, 30)"), order=["_hash", "doc_id", "text_crc32"], rank="_rank", count="_of",
    )
    shift = F.pmod(_hash(F.lit(seed), "source"), F.lit(1 << 20)) / float(1 << 20)
    placed = in_source.withColumn("_place", (F.col("_rank") + shift) / F.col("_of"))
    ranked = bucket_rank(
        placed, bucket=F.floor(F.col("_place") * many).cast("bigint"), order=["_place", F.md5("source"), "source"], rank="_at",
    )
    shard = F.expr(f"cast(_at * {shards} div {max(total, 1)} AS int)")
    return ranked.withColumn("shard", shard).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard",
        F.expr(f"_at - (shard * {max(total, 1)}L + {shards - 1}) div {shards}").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
