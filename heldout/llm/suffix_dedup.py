"""Repeated byte strings across documents, by a distributed merge sort of suffixes that knows common prefixes.

Tasks sort the suffixes of their documents (one per anchor, see ``suffix_runs``)
and exchange them as front-coded runs.  Each bucket merges its runs with a loser
tree and sees equal strings side by side, with the smallest doc_id of each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heldout.functions.materialize import materialize
from heldout.llm import suffix_runs as S
from heldout.llm.text import as_bytes, bound_batches, plain

RUN_BYTES = 16 << 20  # text whose suffixes one sorted run holds, about
BUCKET_BYTES = 8 << 20  # text whose suffixes one bucket merges, about
_RUN = "bucket int, part array<binary>"
_SPAN = "doc_id bigint, tag bigint, span bigint"
_BITS = 7  # a span is (first start << 7) + number of starts - 1


def covered_starts(keys: np.ndarray, lcp: np.ndarray, ids: np.ndarray, shape: S.Shape) -> np.ndarray:
    """One bit per start of every sorted key: whether its string also starts in a document with a smaller id."""
    n = len(keys)
    right, left = keys[:, -2].astype(np.int64), keys[:, -1].astype(np.int64)
    every = (np.uint64(2) << (right + left - shape.length).astype(np.uint64)) - np.uint64(1)
    fresh = lcp < shape.width
    fresh[:1] = True
    first = np.flatnonzero(fresh)
    group = np.cumsum(fresh) - 1
    least = np.minimum.reduceat(ids, first)
    shared = np.minimum(lcp, right)
    shared[1:] = np.minimum(shared[1:], right[:-1])
    shared[:1] = 0
    masks = np.zeros(len(first), np.uint64)
    rows = first[_promising(keys[first], shared[first], shape)]
    if len(rows):
        # the smallest prefix since the row kept before
        common = np.minimum.reduceat(shared[: rows[-1] + 1], np.concatenate(([0], rows[:-1] + 1)))
        masks[group[rows]] = _masks(keys[rows], common, least[group[rows]], shape)
    return np.where(ids > least[group], every, masks[group])


def _neighbours(shared: np.ndarray) -> np.ndarray:
    """The longer of the prefixes that a row shares with the row before and the row after."""
    return np.maximum(shared, np.concatenate((shared[1:], [0])))


def _promising(keys: np.ndarray, shared: np.ndarray, shape: S.Shape) -> np.ndarray:
    """Distinct sorted keys whose longest common parts right and left of the anchor could make a whole string."""
    group = np.cumsum(shared < S.GRAM)
    best = _neighbours(shared)
    rows = np.flatnonzero(best >= S.GRAM)
    if not len(rows):
        return rows
    back = np.ascontiguousarray(keys[rows, shape.length : -1])
    back[:, -1] = keys[rows, -1]
    order, _ = S.sort_order(back, group[rows])
    back, where = back[order], group[rows][order]
    same = np.minimum(S.common_prefixes(back), back[:, -1]).astype(np.int64)
    same[1:] = np.where(where[1:] == where[:-1], np.minimum(same[1:], back[:-1, -1]), 0)
    longest = np.empty(len(rows), np.int64)
    longest[order] = _neighbours(same)
    return rows[best[rows] + longest >= shape.length]


def _masks(keys: np.ndarray, shared: np.ndarray, ids: np.ndarray, shape: S.Shape) -> np.ndarray:
    """Bits of the starts of distinct sorted keys whose string stands below a smaller id; one pass per distance from start to anchor."""
    n = len(keys)
    right, left = keys[:, -2].astype(np.int64), keys[:, -1].astype(np.int64)
    before = np.zeros(n, np.int64)
    masks = np.zeros(n, np.uint64)
    for distance in range(shape.left + 1):
        if distance:
            before = np.unique(before * 256 + keys[:, shape.length + distance - 1], return_inverse=True)[1]
        need = shape.length - distance
        at = np.flatnonzero((left >= distance) & (right >= need))
        if len(at) < 2:
            continue
        after = np.cumsum(shared < need)
        string = np.unique(after[at] * (n + 1) + before[at], return_inverse=True)[1]
        least = np.full(int(string.max()) + 1, np.iinfo(np.int64).max)
        np.minimum.at(least, string, ids[at])
        later = at[ids[at] > least[string]]
        masks[later] |= np.uint64(1) << (left[later] - distance).astype(np.uint64)
    return masks


def _spans(ids: np.ndarray, tags: np.ndarray, starts: np.ndarray, masks: np.ndarray) -> pa.RecordBatch:
    """Rows of ``_SPAN``: the runs of set bits of each mask."""
    out: list[list[np.ndarray]] = [[], [], []]
    held = masks != 0
    ids, tags, starts, masks = ids[held], tags[held], starts[held], masks[held]
    while len(masks):
        zeros = np.bitwise_count((masks & (~masks + np.uint64(1))) - np.uint64(1))
        moved = masks >> zeros
        ones = np.bitwise_count((~moved & (moved + np.uint64(1))) - np.uint64(1))
        for column, values in zip(out, (ids, tags, ((starts + zeros) << _BITS) + ones.astype(np.int64) - 1)):
            column.append(values)
        masks = (moved >> ones) << (zeros + ones)
        held = masks != 0
        ids, tags, starts, masks = ids[held], tags[held], starts[held], masks[held]
    columns = [np.concatenate(c) if c else np.zeros(0, np.int64) for c in out]
    return pa.record_batch(dict(zip(("doc_id", "tag", "span"), columns)))


def _make_runs(shape: S.Shape, buckets: int, run_bytes: int):
    def flush(texts: list[bytes], ids: list[int], tags: list[int]) -> Iterator[pa.RecordBatch]:
        keys, text, start, starts = S.anchors(texts, shape)
        if not len(keys):
            return
        bucket = S.places(keys, buckets)
        order, group = S.sort_order(keys, bucket)
        keys, bucket, text, start, starts = keys[order], bucket[order], text[order], start[order], starts[order]
        doc, tag = np.array(ids, np.int64)[text], np.array(tags, np.int64)[text]
        first = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
        later = doc > np.minimum.reduceat(doc, first)[np.cumsum(np.concatenate(([0], group[1:] != group[:-1])))]
        # an equal suffix of a smaller document of the same run decides all starts of these; they need not be sorted on
        full = (np.uint64(2) << (starts[later] - 1).astype(np.uint64)) - np.uint64(1)
        known = _spans(doc[later], tag[later], start[later], full)
        rows = [[S.zstandard.ZstdCompressor().compress(S._planes(c.to_numpy())) for c in known.columns]]
        places = [int(bucket[0])]
        left = ~later
        keys, bucket, numbers = keys[left], bucket[left], [doc[left], tag[left], start[left]]
        edges = np.searchsorted(bucket, np.arange(buckets + 1))
        for b in np.flatnonzero(edges[1:] > edges[:-1]):
            at = slice(edges[b], edges[b + 1])
            rows.append(S.pack_run(keys[at], [x[at] for x in numbers], shape))
            places.append(int(b))
        yield pa.record_batch({"bucket": pa.array(places, pa.int32()), "part": pa.array(rows, pa.list_(pa.binary()))})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, ids, tags, size = [], [], [], 0
        for batch in batches:
            for doc, tag, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), as_bytes(batch.column(2))):
                if len(text) < shape.length:
                    continue
                if size and size + len(text) > run_bytes:
                    yield from flush(texts, ids, tags)
                    texts, ids, tags, size = [], [], [], 0
                texts.append(text)
                ids.append(doc)
                tags.append(tag)
                size += len(text)
        yield from flush(texts, ids, tags)

    return run


def _merge(shape: S.Shape):
    def run(table: pa.Table) -> pa.Table:
        spans, runs, packed = [], [], []
        for parts in table.column("part").to_pylist():
            if len(parts) == 3:  # spans known before the exchange
                spans.append([S._unplanes(S.zstandard.decompress(x)) for x in parts])
            else:
                keys, lcp, numbers = S.unpack_run(parts, shape)
                raw, width = keys.tobytes(), shape.width
                packed.append((keys, numbers))
                runs.append(([raw[i : i + width] for i in range(0, len(raw), width)], lcp.tolist()))
        out = [pa.record_batch(dict(zip(("doc_id", "tag", "span"), s))) for s in spans]
        if runs:
            offsets = np.concatenate(([0], np.cumsum([len(k) for k, _ in packed])))
            flat = np.fromiter((x for entry in S.merge_runs(runs) for x in entry), np.int64, 3 * int(offsets[-1])).reshape(-1, 3)
            runs.clear()
            order = offsets[flat[:, 0]] + flat[:, 1]
            keys = np.concatenate([k for k, _ in packed])[order]
            ids, tags, starts = (np.concatenate([x[k] for _, x in packed])[order] for k in range(3))
            out.append(_spans(ids, tags, starts, covered_starts(keys, flat[:, 2].copy(), ids, shape)))
        return pa.Table.from_batches(out)

    return run


def repeated_starts(docs: DataFrame, length: int = 50, run_bytes: int = RUN_BYTES, bucket_bytes: int = BUCKET_BYTES) -> tuple[DataFrame, DataFrame]:
    """((doc_id, tag, spans), texts with their tag): where strings of ``length`` bytes start that also start in a smaller document.

    A tag tells rows apart that repeat a doc_id; it is 0 for all others.
    """
    shape = S.Shape(length)
    bound_batches(docs.sparkSession)
    texts = plain(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("bigint"))
    again = materialize(texts.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("doc_id"))
    if again.isEmpty():
        texts = texts.select("doc_id", F.lit(0).cast("bigint").alias("tag"), "text")
    else:
        marked = texts.join(again.withColumn("_again", F.lit(True)), "doc_id", "left")
        texts = marked.select("doc_id", F.when(F.col("_again"), F.xxhash64("text")).otherwise(0).alias("tag"), "text")
    total = texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]
    buckets = max(8, -(-total // bucket_bytes))
    runs = texts.filter(f"doc_id IS NOT NULL AND octet_length(text) >= {length}").mapInArrow(_make_runs(shape, buckets, run_bytes), _RUN)
    found = runs.groupBy("bucket").applyInArrow(_merge(shape), _SPAN)
    return found.groupBy("doc_id", "tag").agg(F.collect_list("span").alias("spans")), texts


def _cut(length: int):
    kind = pa.struct([("kept", pa.binary()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())])))])

    def one(text: bytes, spans: np.ndarray) -> dict:
        if not len(spans):
            return {"kept": text, "spans": []}
        spans = np.sort(spans)
        start = spans >> _BITS
        end = np.maximum.accumulate(start + (spans & ((1 << _BITS) - 1)) + length)
        first = np.flatnonzero(np.concatenate(([True], start[1:] > end[:-1])))
        start, end = start[first], end[np.concatenate((first[1:] - 1, [len(end) - 1]))]
        edges = [0, *np.stack((start, end), 1).ravel().tolist(), len(text)]
        kept = b"".join([text[a:b] for a, b in zip(edges[::2], edges[1::2])])
        return {"kept": kept, "spans": [{"start": a, "length": b - a} for a, b in zip(start.tolist(), end.tolist())]}

    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, spans in batches:
            flat, edges = spans.flatten().to_numpy(zero_copy_only=False), np.concatenate(([0], np.cumsum([len(x) if x.is_valid else 0 for x in spans])))
            yield pa.array([one(t, flat[edges[k] : edges[k + 1]]) for k, t in enumerate(as_bytes(texts))], kind)

    run.__annotations__ = {"batches": Iterator[tuple[pa.Array, pa.Array]], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, "struct<kept:binary,spans:array<struct<start:bigint,length:bigint>>>").asNondeterministic()


def cut_repeats(docs: DataFrame, length: int = 50, run_bytes: int = RUN_BYTES, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """doc_id, n_bytes, kept (binary), spans (start, length) for every row of ``docs``.

    A byte is cut if a string of ``length`` bytes covers it that also starts in a
    document with a smaller doc_id; spans are the maximal cut runs of the whole
    UTF-8 text, kept is the rest.  All is judged on the input texts.

    Null and empty texts, and texts shorter than ``length``, keep all.  Equal
    doc_ids are not smaller than each other, so rows that repeat an id keep what
    only they share; a null doc_id is neither smaller nor larger than any and
    keeps all.  Extra columns are ignored; an empty table gives no row.

    Of suffixes that are equal inside a run only those of the smallest document
    are exchanged, so a passage that a third of all rows share sends one key per
    run to its bucket.  ``doc_id`` must be an integer.
    """
    spans, texts = repeated_starts(docs, length, run_bytes, bucket_bytes)
    joined = texts.join(spans, ["doc_id", "tag"], "left").select("doc_id", "text", _cut(length)("text", "spans").alias("c"))
    n_bytes = F.coalesce(F.octet_length("text").cast("bigint"), F.lit(0))
    return joined.select("doc_id", n_bytes.alias("n_bytes"), "c.kept", "c.spans")
