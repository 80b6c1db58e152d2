"""Words, shingles and Arrow helpers shared by the text operators.

A word is a run of bytes other than space and the ASCII controls 9-13, so
``bytes.split()`` on the UTF-8 text finds exactly the words.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import arrow_udf

SHINGLE = 5
BATCH_ROWS = 512  # rows of whole texts that meet in one Arrow batch
_MIX = np.uint64(0x9E3779B97F4A7C15)


def bound_batches(spark: SparkSession) -> None:
    """Keep Arrow batches of whole texts small where the session has the default of 10,000 rows."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def row_udf(make: Callable[[], Callable], returns: str):
    """An Arrow function of one text column.

    ``make`` runs once per task and gives a function from a list of texts
    (``bytes``; null is ``b""``) to a list of results.  The function counts as
    non-deterministic so that the optimizer evaluates it once per row.
    """

    kind = _arrow_type(returns)

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        apply = make()
        for texts in batches:
            yield pa.array(apply(as_bytes(texts)), kind)

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return arrow_udf(run, returns).asNondeterministic()


def _arrow_type(ddl: str) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import _parse_datatype_string

    return to_arrow_type(_parse_datatype_string(ddl))


def as_bytes(texts: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text, null as empty."""
    kind = pa.large_binary() if pa.types.is_large_string(texts.type) else pa.binary()
    return [x or b"" for x in texts.cast(kind).to_pylist()]


def words_of(text: bytes) -> list[bytes]:
    """Words of the text with A-Z in lower case."""
    return text.lower().split()


class WordHash(dict):
    """64-bit hashes of words, remembered up to a bounded number of distinct words."""

    def __init__(self, most: int = 300_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mix(values: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    v = values ^ (values >> np.uint64(30))
    v = v * np.uint64(0xBF58476D1CE4E5B9)
    v ^= v >> np.uint64(27)
    v *= np.uint64(0x94D049BB133111EB)
    v ^= v >> np.uint64(31)
    return v


def shingle_hashes(hashes: np.ndarray, size: int = SHINGLE) -> np.ndarray:
    """One hash per window of ``size`` word hashes, in order; the whole sequence where it is shorter."""
    n = len(hashes)
    if n == 0:
        return hashes
    width = min(size, n)
    total = np.zeros(n - width + 1, np.uint64)
    for k in range(width):
        total *= _MIX
        total += hashes[k : n - width + 1 + k]
    return mix(total + np.uint64(width))


def shingle_set(cache: WordHash, text: bytes) -> np.ndarray:
    """Sorted distinct shingle hashes of a text."""
    return np.unique(shingle_hashes(cache.of(words_of(text))))


def shared_count(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return 0
    at = np.searchsorted(b, a)
    at[at == len(b)] = len(b) - 1
    return int(np.count_nonzero(b[at] == a))


def plain(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, missing ones as null strings, so that extra columns can't clash."""
    return df.select(*[F.col(f"`{n}`") if n in df.columns else F.lit(None).cast("string").alias(n) for n in names])


def held_out(doc_id: str | Column = "doc_id") -> Column:
    """Whether a document belongs to the fold that no model learns from; null ids do."""
    key = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(key.cast("string")) % 5 == 0, F.lit(True))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int) -> DataFrame:
    """(text, y) of at most ``rows`` labelled documents outside the held-out fold.

    The rows are those with the smallest hash of the id, so the sample does not
    depend on partitioning.  Ids with two different labels teach nothing.
    """
    ids = (
        plain(labels, "doc_id", label)
        .filter(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~held_out())
        .groupBy("doc_id").agg(F.min(label).alias("y"), F.max(label).alias("most"))
        .filter("y = most").select("doc_id", "y", F.xxhash64(F.lit(label), "doc_id").alias("order"))
        .orderBy("order", "doc_id").limit(rows)
    )
    return plain(docs, "doc_id", "text").join(F.broadcast(ids), "doc_id").select("order", "doc_id", "y", "text")
