"""Benchmark decontamination: size-partitioned MinHash containment search, then exact containment.

Items are partitioned by size.  For a partition of items with at most g
shingles, the texts are read in windows of two blocks of g shingles: wherever an
item stands, one window holds it whole and is at most four times as large, so a
few dozen MinHash values find it however long the document is.  Items of a few
shingles are small beside the smallest window; their shingles are looked up one
by one instead.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heldout.llm.text import WordHash, bound_batches, plain, row_udf, shared_count, shingle_hashes, shingle_set, words_of

CONTAINED = 0.75
HASHES = 48  # an item of which 3/4 stands in one place is missed once in 10,000 times at most
LEAST_BLOCK = 8
LOOKED_UP = LEAST_BLOCK // 2  # items of at most so many shingles are found by any one of them, without MinHash
BLOCK_SHINGLES = 2_000_000  # item shingles that one pass over the documents holds, about
_TOP = np.uint64(2**64 - 1)
_rng = np.random.default_rng(20240607)
_FLIP = _rng.integers(0, 2**63, HASHES, np.uint64)
_TIMES = _rng.integers(0, 2**63, HASHES, np.uint64) * np.uint64(2) + np.uint64(1)


def size_class(n: int) -> int:
    """The smallest block size, a power of two, that is no smaller than ``n``."""
    return max(LEAST_BLOCK, 1 << (n - 1).bit_length())


class ItemIndex:
    """Items by size class and hash function, sorted by MinHash value."""

    def __init__(self, items: list[np.ndarray], threshold: float):
        self.items, self.threshold = items, threshold
        by_class: dict[int, list[int]] = {}
        few = [k for k, s in enumerate(items) if 0 < len(s) <= LOOKED_UP]
        short = np.array([x for k in few for x in items[k]], np.uint64)
        order = np.argsort(short, kind="stable")
        self.short, self.short_items = short[order], np.array([k for k in few for _ in items[k]], np.int64)[order]
        for k, s in enumerate(items):
            if len(s) > LOOKED_UP:
                by_class.setdefault(size_class(len(s)), []).append(k)
        self.classes = {}
        for g, members in sorted(by_class.items()):
            low = np.array([[((items[k] ^ f) * t).min() for k in members] for f, t in zip(_FLIP, _TIMES)], np.uint64)
            order = np.argsort(low, axis=1, kind="stable")
            self.classes[g] = (np.take_along_axis(low, order, axis=1), np.array(members)[order])

    def candidates(self, shingles: np.ndarray) -> Iterable[tuple[int, int, int]]:
        """(first position, last position + 1, item) of windows that share a MinHash value with an item."""
        found = set()
        for i in range(HASHES):
            low = (shingles ^ _FLIP[i]) * _TIMES[i]
            size = 1
            for g, (values, members) in self.classes.items():
                while size < g:
                    if len(low) % 2:
                        low = np.append(low, _TOP)
                    low = np.minimum(low[0::2], low[1::2])
                    size *= 2
                window = np.minimum(low, np.append(low[1:], _TOP))
                left = np.searchsorted(values[i], window, side="left")
                hit = np.flatnonzero(values[i][np.minimum(left, len(values[i]) - 1)] == window)
                for w in hit:
                    k = left[w]
                    while k < len(values[i]) and values[i][k] == window[w]:
                        found.add((int(w) * g, (int(w) + 2) * g, int(members[i][k])))
                        k += 1
        return found

    def looked_up(self, shingles: np.ndarray, ends: np.ndarray) -> Iterable[tuple[int, int]]:
        """(part, item) of parts, ending at ``ends``, that have a shingle of an item of few shingles."""
        found = set()
        if not len(self.short):
            return found
        left = np.searchsorted(self.short, shingles)
        hit = np.flatnonzero(self.short[np.minimum(left, len(self.short) - 1)] == shingles)
        part = np.searchsorted(ends, hit, side="right")
        for d, left in np.unique(np.stack([part, left[hit]], axis=1), axis=0).tolist():
            k = left
            while k < len(self.short) and self.short[k] == self.short[left]:
                found.add((d, int(self.short_items[k])))
                k += 1
        return found

    def search(self, texts: list[bytes], cache: WordHash) -> list[list[tuple[int, int]]]:
        """(item, shared shingles) for each text, of items contained to the threshold."""
        out: list[list[tuple[int, int]]] = [[] for _ in texts]
        group: list[int] = []
        parts: list[np.ndarray] = []
        size = 0
        for k, text in enumerate(texts):
            s = shingle_hashes(cache.of(words_of(text)))
            if len(s):
                group.append(k)
                parts.append(s)
                size += len(s)
            if size > 200_000:
                self._group(group, parts, out)
                group, parts, size = [], [], 0
        if parts:
            self._group(group, parts, out)
        return out

    def _group(self, group: list[int], parts: list[np.ndarray], out: list[list[tuple[int, int]]]) -> None:
        ends = np.cumsum([len(p) for p in parts])
        pairs = set()
        pairs.update(self.looked_up(np.concatenate(parts), ends))
        for a, b, item in self.candidates(np.concatenate(parts)):
            first, last = np.searchsorted(ends, [a, b - 1], side="right")
            pairs.update((d, item) for d in range(first, min(last, len(parts) - 1) + 1))
        sets: dict[int, np.ndarray] = {}
        for d, item in sorted(pairs):
            if d not in sets:
                sets[d] = np.unique(parts[d])
            shared = shared_count(self.items[item], sets[d])
            if shared >= self.threshold * len(self.items[item]):
                out[group[d]].append((item, shared))


def item_blocks(benchmark: DataFrame, per_block: int = BLOCK_SHINGLES) -> Iterable[list[tuple[int | None, np.ndarray]]]:
    """Blocks of (item_id, shingle set), each of a bounded number of shingles."""
    bound_batches(benchmark.sparkSession)
    rows = plain(benchmark, "item_id", "text").distinct()
    n = rows.agg(F.sum(F.size(F.split(F.coalesce("text", F.lit("")), "[\\x20\\x09-\\x0D]+")).cast("long")).alias("n")).head()["n"] or 0
    blocks = max(1, -(-n // per_block))
    shingles = row_udf(lambda: lambda texts, h=WordHash(): [shingle_set(h, t).tobytes() for t in texts], "binary")
    for b in range(blocks):
        part = rows.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).select("item_id", shingles("text").alias("s"))
        yield sorted(((r["item_id"], np.frombuffer(r["s"], np.uint64)) for r in part.collect()), key=lambda x: (x[0] is None, x[0], len(x[1]), x[1].tobytes()))


def _hits(block: list[tuple[int | None, np.ndarray]], threshold: float):
    def make():
        index, cache = ItemIndex([s for _, s in block], threshold), WordHash()
        return lambda texts: [[(block[i][0], len(block[i][1]), n) for i, n in one] for one in index.search(texts, cache)]

    return row_udf(make, "array<struct<item_id:bigint,n_item_shingles:bigint,n_shared:bigint>>")


def contained_items(docs: DataFrame, benchmark: DataFrame, threshold: float = CONTAINED) -> DataFrame:
    """doc_id, item_id, n_item_shingles, n_shared for every item whose shingles stand in a document to the threshold.

    All items are searched for in all whole texts, in blocks of items that one
    task can hold; the blocks are independent passes.  Containment is exact on
    full shingle sets.  Items and texts without words match nothing; one with
    fewer than five words is a single shingle; repeated items count once and
    repeated documents one by one; null ids stay null; extra columns are ignored.
    """
    bound_batches(docs.sparkSession)
    light = plain(docs, "doc_id", "text")
    out = None
    for block in item_blocks(benchmark):
        found = light.select("doc_id", F.explode(_hits(block, threshold)("text")).alias("h")).select("doc_id", "h.*")
        out = found if out is None else out.unionAll(found)
    return out


def clean(docs: DataFrame, benchmark: DataFrame, threshold: float = CONTAINED) -> DataFrame:
    """The rows of ``docs``, all columns, that contain no item to the threshold."""
    bound_batches(docs.sparkSession)
    for block in item_blocks(benchmark):
        docs = docs.withColumn("_llm_hits", _hits(block, threshold)("text")).filter(F.size("_llm_hits") == 0).drop("_llm_hits")
    return docs
