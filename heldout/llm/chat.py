"""Chat formatting: logged snapshots of a conversation collapse into its longest form, which is rendered."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heldout.llm.text import plain

#: A turn as one value that tells null from empty and role from text.
_TURN = "md5(concat(coalesce(concat(length(role), ':', role), '-'), '|', coalesce(text, '')))"


def prefixes(turns: DataFrame) -> DataFrame:
    """conv_id, n_turns, hashes: the rolling hash after each turn.

    Only hashes of turns are gathered per conversation, never texts.
    """
    ordered = turns.groupBy("conv_id").agg(F.array_sort(F.collect_set(F.struct("turn", "role", F.expr(_TURN).alias("code")))).alias("turns"))
    rolling = "aggregate(turns, cast(array() AS array<string>), (a, x) -> array_append(a, md5(concat(coalesce(try_element_at(a, -1), ''), x.code))))"
    return ordered.selectExpr("conv_id", "size(turns) AS n_turns", f"{rolling} AS hashes")


def maximal(turns: DataFrame) -> DataFrame:
    """conv_id, n_turns, n_copies of the conversations that are no proper prefix of another.

    Equal conversations are one, under the smallest conv_id.  Both sides of the
    anti-join are aggregated to one row per hash first, so a conversation or a
    first turn that was logged very often is one row.
    """
    hashed = prefixes(turns)
    finals = (
        hashed.select("conv_id", "n_turns", F.element_at("hashes", -1).alias("hash"))
        .groupBy("hash").agg(F.min("conv_id").alias("conv_id"), F.max("n_turns").alias("n_turns"), F.count(F.lit(1)).alias("n_copies"))
    )
    proper = hashed.select(F.explode(F.expr("slice(hashes, 1, n_turns - 1)")).alias("hash")).distinct()
    return finals.join(proper, "hash", "left_anti").drop("hash")


def render(conversations: DataFrame) -> DataFrame:
    """conv_id, n_turns, n_copies, rendered for every maximal conversation.

    Turns go by (turn, role, content); a row that is repeated in full is one
    turn; a null turn number comes first; null role and text render as empty.
    Rows without a conv_id belong to no conversation and are left out.  A
    conversation is one value, so its turns meet in one task; no other group does.  Extra
    columns are ignored; an empty table gives no row.
    """
    turns = plain(conversations, "conv_id", "turn", "role", "text").filter("conv_id IS NOT NULL")
    kept = maximal(turns)
    line = F.concat(F.lit("<|im_start|>"), F.coalesce("role", F.lit("")), F.lit("\n"), F.coalesce("text", F.lit("")), F.lit("<|im_end|>\n"))
    texts = (
        turns.join(kept, "conv_id").groupBy("conv_id", "n_turns", "n_copies")
        .agg(F.array_sort(F.collect_set(F.struct("turn", "role", F.expr(_TURN).alias("code"), line.alias("line")))).alias("turns"))
    )
    return texts.select("conv_id", F.col("n_turns").cast("bigint").alias("n_turns"), "n_copies", F.expr("array_join(transform(turns, x -> x.line), '')").alias("rendered"))
