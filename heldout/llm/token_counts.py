"""Token counts: pieces once per distinct pre-token, joined to the pre-tokens of each document."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heldout.functions.materialize import materialize
from heldout.llm.pieces import BEYOND, LATIN, SPECIAL, Pieces
from heldout.llm.text import as_bytes, bound_batches, plain, row_udf

FREQUENT = 200_000  # pre-tokens whose counts every task holds; all others are joined


def pretoken_totals(docs: DataFrame, path: str) -> DataFrame:
    """(token, n): how often each pre-token occurs in all texts, summed inside tasks first."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, chunks, tokens = Pieces(path), Counter(), Counter()

        def flush() -> pa.RecordBatch:
            for chunk, n in chunks.items():
                for token in LATIN.findall(chunk):
                    tokens[token] += n
            out = pa.record_batch({"token": pa.array(list(tokens), pa.string()), "n": pa.array(list(tokens.values()), pa.int64())})
            chunks.clear()
            tokens.clear()
            return out

        for batch in batches:
            for raw in as_bytes(batch.column(0)):
                text = raw.decode("utf-8", "replace")
                if ("<|" in text and SPECIAL.search(text)) or BEYOND.search(text):
                    tokens.update(pieces.pretokens(text))
                else:
                    chunks.update(text.lower().split())
            if len(chunks) + len(tokens) > 200_000:
                yield flush()
        yield flush()

    return plain(docs, "text").mapInArrow(count, "token string, n bigint").groupBy("token").agg(F.sum("n").alias("n"))


def piece_counts(totals: DataFrame, path: str) -> DataFrame:
    """(token, n, pieces): the library's pieces of each distinct pre-token."""

    def make():
        pieces = Pieces(path, most=1)
        return lambda tokens: [len(pieces.encode(t.decode())) // 4 for t in tokens]

    return totals.select("token", "n", row_udf(make, "int")("token").alias("pieces"))


def commonest(vocabulary: DataFrame, most: int) -> DataFrame:
    """At most ``most`` rows with the highest n, cut where a sixteenth of an octave of n ends, so that nothing is sorted."""
    level = F.floor(F.log2("n") * 16)
    sizes = {r["level"]: r["rows"] for r in vocabulary.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("rows")).collect()}
    total, lowest = 0, None
    for at in sorted(sizes, reverse=True):
        total += sizes[at]
        if total > most:
            break
        lowest = at
    return vocabulary.filter(F.lit(False) if lowest is None else level >= lowest)


def count_tokens(docs: DataFrame, path: str, limit: int = 2048, frequent: int = FREQUENT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row of ``docs``.

    The ``frequent`` commonest pre-tokens (a bounded table) are known to every
    task; the rarer ones of a document are joined to their piece counts and
    summed, so a word that stands in most documents is never a join key and no
    ids are built.  Null text counts as empty: no bytes, no tokens.  Rows with a
    null or repeated doc_id are counted one by one; other columns are ignored.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    vocabulary = materialize(piece_counts(pretoken_totals(docs, path), path))
    top = commonest(vocabulary, frequent).select("token", "pieces").toArrow()
    known = spark.sparkContext.broadcast(dict(zip(top["token"].to_pylist(), top["pieces"].to_pylist())))

    def make():
        pieces, get = Pieces(path, most=1), known.value.get

        def one(raw: bytes) -> tuple:
            total, rest = 0, []
            for token, times in Counter(pieces.pretokens(raw.decode("utf-8", "replace"))).items():
                n = get(token)
                if n is None:
                    rest.append((token, times))
                else:
                    total += n * times
            return len(raw), total, rest

        return lambda texts: [one(t) for t in texts]

    kind = "struct<n_bytes:bigint,known:bigint,rest:array<struct<token:string,times:int>>>"
    parsed = plain(docs, "doc_id", "text").select("doc_id", row_udf(make, kind)("text").alias("p"))
    rows = materialize(parsed.select(F.monotonically_increasing_id().alias("row"), "doc_id", "p.*"))
    rest = rows.select("row", F.explode("rest").alias("r")).select("row", "r.*")
    sums = rest.join(vocabulary.select("token", "pieces"), "token").groupBy("row").agg(F.sum(F.col("times") * F.col("pieces")).alias("more"))
    n_tokens = F.col("known") + F.coalesce("more", F.lit(0))
    return rows.drop("rest").join(sums, "row", "left").select("doc_id", "n_bytes", n_tokens.alias("n_tokens"), (n_tokens > limit).alias("over_limit"))
