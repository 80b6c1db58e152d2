"""Packing by the histogram of lengths: longest lengths first, into the emptiest pattern."""

from __future__ import annotations

import heapq
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import arrow_udf

from heldout.functions.materialize import materialize
from heldout.llm.pieces import Pieces
from heldout.llm.ranks import bucket_rank, buckets_for
from heldout.llm.text import bound_batches, plain, row_udf

CONTEXT = 4096
END = 2
_PIECE = "array<struct<start:bigint,length:bigint,ids_crc32:bigint,doc_tokens:bigint,ids:binary>>"


def cut(ids: bytes, context: int, with_ids: bool) -> list[tuple]:
    """Pieces of at most ``context`` ids: all but the last are full."""
    total, step = len(ids) // 4, context * 4
    return [
        (k // 4, len(part) // 4, zlib.crc32(part), total, part if with_ids else None)
        for k in range(0, len(ids), step)
        for part in (ids[k : k + step],)
    ]


def pieces_of(docs: DataFrame, path: str, context: int = CONTEXT, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens and, if asked for, the ids."""

    def make():
        pieces, end = Pieces(path), END.to_bytes(4, "little")
        return lambda texts: [cut(pieces.ids(t.decode("utf-8", "replace")) + end, context, with_ids) for t in texts]

    bound_batches(docs.sparkSession)
    found = plain(docs, "doc_id", "text").select("doc_id", F.explode(row_udf(make, _PIECE)("text")).alias("p")).select("doc_id", "p.*")
    return found if with_ids else found.drop("ids")


def patterns(histogram: dict[int, int], context: int = CONTEXT) -> list[tuple[int, tuple[tuple[int, int], ...]]]:
    """(number of sequences, ((length, times), ...)) for a histogram of lengths.

    Lengths go from the longest to the shortest.  A length joins the sequences
    with the most room left, one piece each, as long as one has room; the rest
    open new sequences that are filled with this length.  Whole groups of equal
    sequences move at once, so the work follows the number of distinct lengths.
    """
    room: dict[int, dict[tuple, int]] = defaultdict(lambda: defaultdict(int))
    heap: list[int] = []

    def put(left: int, pattern: tuple, n: int) -> None:
        if left not in room or not room[left]:
            heapq.heappush(heap, -left)
        room[left][pattern] += n

    for length in sorted(histogram, reverse=True):
        n = histogram[length]
        while n and heap and -heap[0] >= length:
            left = -heap[0]
            if not room[left]:
                heapq.heappop(heap)
                continue
            pattern, many = next(iter(room[left].items()))
            taken = min(n, many)
            if taken == many:
                del room[left][pattern]
            else:
                room[left][pattern] = many - taken
            last = pattern[-1]
            grown = (*pattern[:-1], (length, last[1] + 1)) if last[0] == length else (*pattern, (length, 1))
            put(left - length, grown, taken)
            n -= taken
        each = context // length
        if n // each:
            put(context - each * length, ((length, each),), n // each)
        if n % each:
            put(context - n % each * length, ((length, n % each),), 1)
    return sorted(((n, p) for group in room.values() for p, n in group.items()), key=lambda x: x[1], reverse=True)


def intervals(packed: list[tuple[int, tuple[tuple[int, int], ...]]]) -> np.ndarray:
    """Rows (length, first rank, sequences, first sequence, first offset), sorted by length and rank."""
    rows, used, base = [], defaultdict(int), 0
    for n, pattern in packed:
        offset = 0
        for length, times in pattern:
            rows.append((length, used[length], n, base, offset))
            used[length] += n * times
            offset += length * times
        base += n
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def assign(length: np.ndarray, rank: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sequence and offset of the pieces with these ranks among their length."""
    wide = np.int64(1) << np.int64(44)
    at = np.searchsorted(table[:, 0] * wide + table[:, 1], length * wide + rank, side="right") - 1
    size, first, n, base, offset = table[at].T
    turn = rank - first
    return base + turn % n, offset + turn // n * size


def pack(docs: DataFrame, path: str, context: int = CONTEXT, with_ids: bool = False) -> DataFrame:
    """Pack every document into sequences of at most ``context`` tokens.

    A document is its ids and the end id, so one with null or empty text is one
    piece of one token.  Every input row is packed: rows with a null or repeated
    doc_id stay apart and carry the id they have.  Columns other than doc_id and
    text are ignored; an empty table gives no row.

    The histogram has at most ``context`` rows; only it meets on the driver.
    Pieces of one length are ranked in hash buckets, so no length is a hot group.
    """
    pieces = pieces_of(docs, path, context, with_ids)
    rows = materialize(pieces.withColumn("_row", F.when(F.col("doc_id").isNull(), F.monotonically_increasing_id())))
    histogram = {int(r["length"]): int(r["n"]) for r in rows.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    table = intervals(patterns(histogram, context))
    ranked = bucket_rank(
        rows, by=["length"], rank="_rank", bucket=F.pmod(F.xxhash64("doc_id", "start", "_row"), F.lit(buckets_for(sum(histogram.values())))),
        order=["doc_id", "start", "ids_crc32"],
    )

    @arrow_udf("struct<sequence_id:bigint,offset:bigint>")
    def placed(length: pa.Array, rank: pa.Array) -> pa.Array:
        found = assign(length.to_numpy(zero_copy_only=False), rank.to_numpy(zero_copy_only=False), table)
        return pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in found], names=["sequence_id", "offset"])

    done = ranked.withColumn("_at", placed.asNondeterministic()("length", "_rank"))
    return done.select(*pieces.columns, F.col("_at.sequence_id").alias("sequence_id"), F.col("_at.offset").alias("offset"))


__all__ = ["CONTEXT", "END", "assign", "cut", "intervals", "pack", "patterns", "pieces_of"]
