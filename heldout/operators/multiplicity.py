"""Bootstrap multiplicities, from hashes alone.

A draw picks as many identities as there are, with replacement: pick j of n is
``sha256(seed:draw:axis:j) mod n``, a place in the hash order of the identities,
however many there are.  The picks of the first axis are made once, in pieces of
bounded size, and sent to the bucket of identities they fall into, where the
rows of that bucket meet them; those of a second axis are made in each task.

With ``leaf`` no picks are listed: how many picks of a draw fall into a bucket
follows from binomial splits down a tree of buckets, each seeded by its place,
and the picks inside a bucket are seeded by the bucket.  The totals stay
multinomial, but they are other draws.
"""

from __future__ import annotations

import hashlib
from collections import OrderedDict
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEAF = 1024  # identities of a bucket
BLOCK = 128  # draws whose splits share a random stream, and that are weighted together
HELD = 128 << 20  # bytes of multiplicities that a task remembers
PICKS = 1 << 18  # picks that one unit of work makes
PIECE = 1 << 14  # rows of a bucket that are weighted together
READY = 512  # row vectors of one matrix product


def picks(seed: int, draw: int, axis: str, low: int, high: int) -> np.ndarray:
    """Picks ``low`` to ``high - 1`` of a draw before the remainder: the first 15 hex digits of their hashes."""
    head, sha = f"{seed}:{draw}:{axis}:".encode(), hashlib.sha256
    return np.frombuffer(b"".join([sha(head + b"%d" % j).digest()[:8] for j in range(low, high)]), ">u8").astype(np.uint64) >> np.uint64(4)


class Picker:
    """Multiplicities of the identities of a bucket, one column per draw."""

    def __init__(self, seed: int, leaf: int | None = None):
        self.seed, self.leaf = seed, leaf
        self.known: OrderedDict[tuple, np.ndarray] = OrderedDict()
        self.held = 0

    def _stream(self, *place) -> np.random.Generator:
        digest = hashlib.sha256(":".join(map(str, (self.seed, *place))).encode()).digest()
        return np.random.Generator(np.random.Philox(key=np.frombuffer(digest[:16], "<u8")))

    def _picks_of_all(self, axis: str, n: int, draws: np.ndarray) -> np.ndarray:
        out = np.empty((n, len(draws)), np.int32)
        for k, draw in enumerate(draws.tolist()):
            out[:, k] = np.bincount((picks(self.seed, draw, axis, 0, n) % np.uint64(n)).astype(np.int64), minlength=n)
        return out

    def _block(self, axis: str, n: int, bucket: int, block: int) -> np.ndarray:
        """Multiplicities in one of several buckets, for the draws of a block."""
        low, high = 0, -(-n // self.leaf)
        count = np.full(BLOCK, n, np.int64)
        while high - low > 1:
            middle = (low + high) // 2
            share = (middle - low) * self.leaf / (min(n, high * self.leaf) - low * self.leaf)
            left = self._stream(axis, n, low, high, block).binomial(count, share)
            if bucket < middle:
                count, high = left, middle
            else:
                count, low = count - left, middle
        size = min(n, (bucket + 1) * self.leaf) - bucket * self.leaf
        stream = self._stream(axis, n, bucket, block)
        return np.stack([np.bincount(stream.integers(0, size, c), minlength=size) for c in count.tolist()], 1).astype(np.int32)

    def counts(self, axis: str, n: int, bucket: int, draws: np.ndarray) -> np.ndarray:
        """[identity of the bucket, draw] for the given ascending draws."""
        key = (axis, n, bucket, draws.tobytes())
        found = self.known.get(key)
        if found is None:
            if self.leaf is None or n <= self.leaf:
                found = self._picks_of_all(axis, n, draws)
            else:
                blocks = np.unique(draws // BLOCK)
                found = np.concatenate([self._block(axis, n, bucket, b)[:, draws[draws // BLOCK == b] - b * BLOCK] for b in blocks.tolist()], 1)
            self.known[key] = found
            self.held += found.nbytes
            while self.held > HELD and len(self.known) > 1:
                self.held -= self.known.popitem(last=False)[1].nbytes
        else:
            self.known.move_to_end(key)
        return found

    def weights(self, axis: str, rank: np.ndarray, n: np.ndarray, draws: np.ndarray) -> np.ndarray:
        """[row, draw]: multiplicity of the identity of each row, given its rank from 0 and the number of identities."""
        out = np.empty((len(rank), len(draws)))
        step = self.leaf or 1
        bucket = np.where(n > self.leaf, rank // self.leaf, 0) if self.leaf else np.zeros_like(rank)
        place = np.stack((n, bucket), 1)
        for size, b in np.unique(place, axis=0).tolist():
            at = np.flatnonzero((n == size) & (bucket == b))
            out[at] = self.counts(axis, size, b, draws)[rank[at] - b * step]
        return out


def pick_table(spark, sizes: Sequence[tuple[int, int]], *, axis: str, seed: int, draws: dict[int, np.ndarray]) -> DataFrame:
    """``(_group, _bucket, codes)`` of all picks: each is its draw's place in ``draws`` times ``LEAF`` plus its place in the bucket.

    ``sizes`` lists groups and their numbers of identities.  Groups with the
    same draws share the hashes.  A unit of work makes ``PICKS`` picks, so a
    draw over many identities is the work of several tasks.
    """
    families: dict[bytes, tuple[np.ndarray, list]] = {}
    for group, n in sizes:
        wanted = draws[group]
        families.setdefault(wanted.tobytes(), (wanted, []))[1].append((group, n))
    held, units = list(families.values()), []
    for f, (wanted, members) in enumerate(held):
        most = max(n for _, n in members)
        some = max(1, PICKS // most)
        units += [(f, lo, min(lo + some, len(wanted)), j, min(j + PICKS, most)) for lo in range(0, len(wanted), some) for j in range(0, most, PICKS)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for f, lo, hi, low, high in zip(*[c.to_pylist() for c in batch.columns]):
                wanted, members = held[f]
                values = [picks(seed, draw, axis, low, high) for draw in wanted[lo:hi].tolist()]
                for group, n in members:
                    if n <= low:
                        continue
                    r = (np.concatenate([v[: n - low] for v in values]) % np.uint64(n)).astype(np.int64)
                    code = (np.repeat(np.arange(lo, hi), min(high, n) - low) * LEAF + r % LEAF).astype(np.int32)
                    bucket = (r // LEAF).astype(np.int32)
                    order = np.argsort(bucket, kind="stable")
                    names, starts = np.unique(bucket[order], return_index=True)
                    data = code[order].tobytes()
                    edges = pa.array(np.append(starts, len(code)) * 4, pa.int32())
                    codes = pa.Array.from_buffers(pa.binary(), len(names), [None, edges.buffers()[1], pa.py_buffer(data)])
                    yield pa.record_batch({"_group": pa.array(np.full(len(names), group), pa.int64()), "_bucket": pa.array(names, pa.int64()), "codes": codes})

    table = spark.createDataFrame(units, "f int, lo int, hi int, low bigint, high bigint").repartition(min(len(units), 400))
    return table.mapInArrow(run, "_group bigint, _bucket bigint, codes binary")


def weighted_sums(
    rows: DataFrame, *, axes: Sequence[str], width: int, seed: int, draws: np.ndarray | dict[int, np.ndarray], leaf: int | None = None,
    spread: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """``(_group, draw, sums)``: per task and group the sum of row vectors, weighted by each draw; draw 0 weighs all by 1.

    ``rows`` holds ``_group``, for axis i the rank ``_r{i}`` from 0 and the
    number ``_n{i}`` of identities, and a sparse vector of ``width`` values as
    ``_pos`` and ``_values``.  ``draws`` may differ by group.  Parts of several
    tasks are left to add.

    Rows and picks meet by bucket of the first axis; a bucket of more than
    ``PIECE`` rows is cut, and its picks go to each piece.  A task holds the
    multiplicities of one bucket, draws x width sums of one group, and those of
    a second axis: list the axis with more identities first.

    ``spread`` makes, after that meeting, several rows ``(_cell, y, yhat)`` of
    one, arrays of truths and predictions whose statistics are the vector, so
    that only narrow rows are shuffled.  Rows of picks (``_kind`` 0) stay one.

    With ``leaf`` no table of picks is made (see the head of the module).
    """
    if leaf is not None:
        return _tree_sums(rows, axes=axes, width=width, seed=seed, draws=draws, leaf=leaf)
    spark = rows.sparkSession
    counted = rows.groupBy("_group", "_n0", F.expr(f"_r0 div {LEAF}").alias("_bucket")).count().collect()  # a row per 1,024 identities
    sizes = sorted({(r["_group"], r["_n0"]) for r in counted})
    by_group = draws if isinstance(draws, dict) else {g: draws for g, _ in sizes}
    none = np.zeros(0, np.int64)
    by_group = {g: by_group.get(g, none) for g, _ in sizes}
    cut = [(r["_group"], r["_bucket"], -(-r["count"] // PIECE)) for r in counted if r["count"] > PIECE]
    cut = F.broadcast(spark.createDataFrame(cut, "_group bigint, _bucket bigint, _cut bigint"))
    known = [c for c in rows.columns if c not in ("_group", "_n0")]
    data = rows.withColumn("_bucket", F.expr(f"_r0 div {LEAF}")).join(cut, ["_group", "_bucket"], "left")
    data = data.withColumn("_piece", F.expr(f"if(_cut is null, 0L, pmod(xxhash64({', '.join(known)}), _cut))")).withColumn("_kind", F.lit(1)).drop("_cut", "_n0")
    table = pick_table(spark, sizes, axis=axes[0], seed=seed, draws=by_group).join(cut, ["_group", "_bucket"], "left").selectExpr(
        "_group", "_bucket", "codes", "explode(sequence(0L, coalesce(_cut, 1L) - 1)) AS _piece", "0 AS _kind"
    )
    key = ["_group", "_bucket", "_piece"]
    met = data.unionByName(table, allowMissingColumns=True).repartition(*key).sortWithinPartitions(*key, "_kind")
    if spread is not None:
        met = spread(met)
    second = axes[1] if len(axes) > 1 else None
    long = spread is not None

    def vectors(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        """First row of each vector, and the vectors, of rows of one piece."""
        number = lambda name: batch.column(name).to_numpy(zero_copy_only=False)
        if not long:
            dense = np.zeros((batch.num_rows, width))
            position = batch.column("_pos")
            row = np.repeat(np.arange(batch.num_rows), position.value_lengths().to_numpy(zero_copy_only=False))
            np.add.at(dense, (row, position.flatten().to_numpy(zero_copy_only=False)), batch.column("_values").flatten().to_numpy(zero_copy_only=False))
            return np.arange(batch.num_rows), dense
        r0 = number("_r0")
        new = np.ones(batch.num_rows, bool)
        new[1:] = r0[1:] != r0[:-1]
        if second:
            r1 = number("_r1")
            new[1:] |= r1[1:] != r1[:-1]
        first, run = np.flatnonzero(new), np.cumsum(new) - 1
        lists = [batch.column(c).flatten() for c in ("y", "yhat")]
        y, x = (v.to_numpy(zero_copy_only=False) for v in lists)
        stats = [np.ones(len(y)), y, x, y * y, x * x, x * y, np.abs(x - y)]  # in the order of SUMS
        gaps = [v.is_null().to_numpy(zero_copy_only=False) for v in lists]
        if gaps[0].any() or gaps[1].any():  # a sum passes over nulls
            both = gaps[0] | gaps[1]
            stats = [np.where(g, 0.0, v) for g, v in zip((np.zeros_like(both), gaps[0], gaps[1], gaps[0], gaps[1], both, both), stats)]
        cells, forms = width // len(stats), len(y) // batch.num_rows
        at = ((run * cells + number("_cell") * forms)[:, None] + np.arange(forms)).ravel()
        return first, np.stack([np.bincount(at, s, len(first) * cells) for s in stats], -1).reshape(len(first), width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        picker, place, group = Picker(seed), None, None
        times = sums = None
        waiting: list[tuple] = []

        def weigh():
            if not waiting:
                return
            rank, r1, n1 = (np.concatenate([w[i] for w in waiting]) if waiting[0][i] is not None else None for i in range(3))
            dense = np.concatenate([w[3] for w in waiting])
            waiting.clear()
            wanted = by_group[group]
            sums[0] += dense.sum(0)
            for low in range(0, len(wanted), READY):
                w = times[rank % LEAF, low : low + READY].astype(float)
                if second:
                    w *= picker.weights(second, r1, n1, wanted[low : low + READY])
                sums[1 + low : 1 + low + w.shape[1]] += w.T @ dense

        def done():
            wanted = np.concatenate(([0], by_group[group]))
            for low in range(0, len(wanted), 256):
                block = sums[low : low + 256]
                values = pa.ListArray.from_arrays(pa.array(np.arange(len(block) + 1) * width, pa.int32()), pa.array(block.ravel()))
                yield pa.record_batch({"_group": pa.array(np.full(len(block), group), pa.int64()), "draw": pa.array(wanted[low : low + 256], pa.int64()), "sums": values})

        for batch in batches:
            if not batch.num_rows:
                continue
            marks = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in (*key, "_kind")], 1)
            edges = np.append(np.flatnonzero(np.append(True, (marks[1:] != marks[:-1]).any(1))), batch.num_rows)
            for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist()):
                here = tuple(marks[lo, :3].tolist())
                if here != place:
                    weigh()
                    if here[0] != group:
                        if sums is not None:
                            yield from done()
                        group = here[0]
                        sums = np.zeros((1 + len(by_group[group]), width))
                    place, times = here, np.zeros((LEAF, len(by_group[group])), np.int32)
                part = batch.slice(lo, hi - lo)
                if marks[lo, 3] == 0:
                    for codes in part.column("codes"):
                        code = np.frombuffer(codes.as_buffer(), np.int32)
                        np.add.at(times, (code % LEAF, code // LEAF), 1)
                    continue
                for low in range(0, part.num_rows, 1 << 14):
                    some = part.slice(low, 1 << 14)
                    first, dense = vectors(some)
                    number = lambda name: some.column(name).to_numpy(zero_copy_only=False)[first]  # noqa: E731, B023
                    waiting.append((number("_r0"), *((number("_r1"), number("_n1")) if second else (None, None)), dense))
                    if sum(len(w[0]) for w in waiting) >= READY:
                        weigh()
        weigh()
        if sums is not None:
            yield from done()

    shape = ["_cell", "y", "yhat"] if long else ["_pos", "_values"]
    met = met.select(*key, "_kind", "codes", "_r0", *(["_r1", "_n1"] if second else []), *shape)
    return met.mapInArrow(run, "_group bigint, draw bigint, sums array<double>")


def _tree_sums(rows: DataFrame, *, axes: Sequence[str], width: int, seed: int, draws: np.ndarray | dict[int, np.ndarray], leaf: int) -> DataFrame:
    """:func:`weighted_sums` without a table of picks: any task makes the multiplicities of any bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        picker, total = Picker(seed, leaf), {}
        none = np.zeros(0, np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            column = {name: batch.column(name) for name in batch.schema.names}
            number = lambda name: column[name].to_numpy(zero_copy_only=False)  # noqa: E731, B023
            group = number("_group")
            for g in np.unique(group).tolist():
                at = np.flatnonzero(group == g)
                wanted = draws.get(g, none) if isinstance(draws, dict) else draws
                position = column["_pos"].take(pa.array(at))
                dense = np.zeros((len(at), width))
                row = np.repeat(np.arange(len(at)), position.value_lengths().to_numpy(zero_copy_only=False))
                dense[row, position.flatten().to_numpy(zero_copy_only=False)] = column["_values"].take(pa.array(at)).flatten().to_numpy(zero_copy_only=False)
                sums = total.setdefault(g, np.zeros((1 + len(wanted), width)))
                sums[0] += dense.sum(0)
                for first in range(0, len(wanted), BLOCK):
                    some = wanted[first : first + BLOCK]
                    w = np.ones((len(at), len(some)))
                    for i, axis in enumerate(axes):
                        w *= picker.weights(axis, number(f"_r{i}")[at], number(f"_n{i}")[at], some)
                    sums[1 + first : 1 + first + len(some)] += w.T @ dense
        for g, sums in total.items():
            wanted = np.concatenate(([0], draws.get(g, none) if isinstance(draws, dict) else draws))
            for first in range(0, len(wanted), 256):
                block = sums[first : first + 256]
                values = pa.ListArray.from_arrays(pa.array(np.arange(len(block) + 1) * width, pa.int32()), pa.array(block.ravel()))
                yield pa.record_batch({"_group": pa.array(np.full(len(block), g), pa.int64()), "draw": pa.array(wanted[first : first + 256], pa.int64()), "sums": values})

    return rows.mapInArrow(run, "_group bigint, draw bigint, sums array<double>")
