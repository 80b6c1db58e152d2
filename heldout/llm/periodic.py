"""Runs: maximal stretches of words that repeat with a period, found from Lyndon roots with suffix-tree extensions.

Every run holds a Lyndon word of its period's length that is the longest one at
its start, in the order of words or in the reverse order.  So the longest Lyndon
words of both orders, extended to both sides as far as words one period apart
agree, give all runs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heldout.llm.suffix_tree import SuffixTree
from heldout.llm.text import WordHash, as_bytes, bound_batches, plain, row_udf, shingle_hashes

LEAST = 12  # words of the shortest run reported


def _next_smaller(rank: list[int]) -> list[int]:
    """For each place the next one with a smaller rank, or the end."""
    out, waiting = [len(rank)] * len(rank), []
    for j, r in enumerate(rank):
        while waiting and rank[waiting[-1]] > r:
            out[waiting.pop()] = j
        waiting.append(j)
    return out


def all_runs(symbols: list[int]) -> np.ndarray:
    """(start, length, period) of every run of at least two periods, by start and period."""
    n = len(symbols)
    if n < 2:
        return np.zeros((0, 3), np.int64)
    forward, backward = SuffixTree(symbols), SuffixTree(symbols[::-1])
    i = np.concatenate((np.arange(n), np.arange(n)))
    j = np.array(_next_smaller(forward.rank) + _next_smaller(forward.mirror()), np.int64)
    right, left = np.zeros(2 * n, np.int64), np.zeros(2 * n, np.int64)
    inside = np.flatnonzero(j < n)
    right[inside] = forward.common(i[inside], j[inside])
    later = np.flatnonzero(i > 0)
    left[later] = backward.common(n - i[later], n - j[later])
    period, start = j - i, i - left
    length = j + right - start
    return np.unique(np.stack((start, length, period), 1)[length >= 2 * period], axis=0)[:, [0, 1, 2]]


def repeating_parts(hashes: np.ndarray, least: int) -> list[tuple[int, int]]:
    """Stretches [a, b) outside of which no run of ``least`` words can lie.

    Words of a run of length L and period q <= L / 2 agree with those q further
    on L - q >= L / 2 times in a row.  So each of its words lies in a window of
    ``least / 2`` words that stands in the text twice, and a run lies inside one
    stretch that such windows cover.
    """
    width = (least + 1) // 2
    if len(hashes) < least:
        return []
    grams = shingle_hashes(hashes, width)
    order = np.argsort(grams)
    same = grams[order[1:]] == grams[order[:-1]]
    if not same.any():
        return []
    at = np.unique(np.concatenate((order[1:][same], order[:-1][same])))
    first = np.flatnonzero(np.concatenate(([True], at[1:] > at[:-1] + width)))
    last = np.concatenate((first[1:] - 1, [len(at) - 1]))
    return [(a, b + width) for a, b in zip(at[first].tolist(), at[last].tolist()) if b + width - a >= least]


def runs_of_words(words: list[bytes], hashes: np.ndarray, least: int = LEAST) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs of at least ``least`` words and two periods, by start and period."""
    out = []
    for a, b in repeating_parts(hashes, least):
        numbers: dict[bytes, int] = {}
        found = all_runs([numbers.setdefault(w, len(numbers)) for w in words[a:b]])
        out += [(a + s, n, p) for s, n, p in found[found[:, 1] >= least].tolist()]
    return out


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words that no run repeats after its first period, joined by one space."""
    if not runs:
        return b" ".join(words)
    change = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    kept = np.cumsum(change)[:-1] == 0
    return b" ".join([words[k] for k in np.flatnonzero(kept).tolist()])


def periodic_runs(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """doc_id, n_words, runs (start, length, period) and collapsed text of every row of ``docs``.

    Words are runs of bytes other than white space, compared as they stand.  A
    run is a stretch of at least ``least`` words and two periods with that
    smallest period which no neighbouring word continues.  ``collapsed`` keeps,
    of each run, only the words of its first period.  Null and empty texts have
    no words, no runs and an empty collapsed text.  Rows with null or repeated
    doc_ids are read one by one; extra columns are ignored; an empty table gives
    no row.  A text is worked on whole in one task; trees are built only over
    the parts that can hold a run.
    """
    bound_batches(docs.sparkSession)

    def make():
        cache = WordHash()

        def one(text: bytes) -> dict:
            words = text.split()
            runs = runs_of_words(words, cache.of(words), least)
            return {"n_words": len(words), "runs": [dict(zip(("start", "length", "period"), r)) for r in runs], "collapsed": collapsed(words, runs)}

        return lambda texts: [one(t) for t in texts]

    kind = "struct<n_words:bigint,runs:array<struct<start:bigint,length:bigint,period:bigint>>,collapsed:binary>"
    found = plain(docs, "doc_id", "text").select("doc_id", row_udf(make, kind)("text").alias("r")).select("doc_id", "r.*")
    return found.withColumn("collapsed", F.col("collapsed").cast("string"))


def planted(doc_id: str, text: str) -> Column:
    """The text with a repeating tail for one id in ten: with h the CRC-32 of the id, g = h // 10 and n words, where h % 10 is 0,
    word i >= a = g % n becomes word a + (i - a) % p, p = 1 + (n - a) // (3 + g % 8); other texts and null ids stay as they are."""

    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for hashes, texts in batches:
            out = []
            for h, raw, text in zip(hashes.to_pylist(), as_bytes(texts), texts):
                words = raw.split() if h is not None and h % 10 == 0 else []
                if words:
                    g, n = h // 10, len(words)
                    a = g % n
                    p = 1 + (n - a) // (3 + g % 8)
                    raw = b" ".join(words[:a] + [words[a + (i - a) % p] for i in range(a, n)])
                out.append(raw if text.is_valid else None)
            yield pa.array(out, pa.binary()).cast(pa.string())

    run.__annotations__ = {"batches": Iterator[tuple[pa.Array, pa.Array]], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, "string").asNondeterministic()(F.crc32(F.col(doc_id).cast("string")), F.col(text))
