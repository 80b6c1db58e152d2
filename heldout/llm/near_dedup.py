"""Near duplicates by an LSH forest over MinHash signatures, confirmed on full shingle sets.

A signature is read in several orders, each a rotation that starts at another
hash.  In each sorted order a region is the run of texts that share a prefix.
A region of few texts gives all its pairs; a larger one links each text to its
first text and is split by a longer prefix, so the depth follows the density.
What that leaves apart in a larger region is compared in full, block by block.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import arrow_udf

from heldout.functions.joins import attach_groups
from heldout.functions.materialize import materialize
from heldout.llm.components import components
from heldout.llm.text import WordHash, as_bytes, bound_batches, plain, row_udf, shared_count, shingle_set

ORDERS, FIRST = 24, 4  # two texts at similarity 0.75 share no prefix of 4 in 24 orders once in 9,000 times
HASHES = ORDERS * FIRST
DEPTHS = (4, 6, 8, 12, 16, 24, 32, 48, 96)
REGION = 16  # texts of a region that are paired with each other
ROUNDS = ((0, 1), (2, 3, 4, 5), tuple(range(6, ORDERS)))  # orders whose larger regions are finished together
BLOCK_SETS, BLOCK_SHINGLES = 512, 200_000  # sets and shingles of a block of a larger region, about
COLUMNS = 4096  # shingles of one matrix product
BROADCAST_IDS = 1_000_000  # ids that every task may hold when texts are picked; more are joined
_rng = np.random.default_rng(20240501)
_FLIP = _rng.integers(0, 2**63, HASHES, np.uint64)
_TIMES = _rng.integers(0, 2**63, HASHES, np.uint64) * np.uint64(2) + np.uint64(1)


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """16 bits of each MinHash value, one row per (non-empty) set."""
    starts = np.concatenate(([0], np.cumsum([len(s) for s in sets])[:-1])).astype(np.int64)
    flat = np.concatenate(sets)
    out = np.empty((len(sets), HASHES), np.uint16)
    for i in range(HASHES):
        low = np.minimum.reduceat((flat ^ _FLIP[i]) * _TIMES[i], starts)
        out[:, i] = (low >> np.uint64(16)).astype(np.uint16)
    return out


def _sketcher():
    cache = WordHash()

    def apply(texts: list[bytes]) -> list[tuple]:
        out: list[tuple] = [(0, None, None)] * len(texts)
        group: list[int] = []
        sets: list[np.ndarray] = []

        def flush() -> None:
            if not sets:
                return
            for k, s, row in zip(group, sets, signatures(sets)):
                out[k] = (len(s), xxhash.xxh3_128_digest(s.tobytes()), row.tobytes())
            group.clear()
            sets.clear()

        size = 0
        for k, text in enumerate(texts):
            s = shingle_set(cache, text)
            if len(s):
                group.append(k)
                sets.append(s)
                size += len(s)
            if size > 100_000:
                flush()
                size = 0
        flush()
        return out

    return apply


def candidates(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(a, b, times), a < b: pairs of nodes that are neighbours in some order, and in how many; (key, order, node) of the larger regions."""
    double = nodes.select("node", F.concat("sig", "sig").alias("_twice"))
    active = double.withColumn("orders", F.sequence(F.lit(0), F.lit(ORDERS - 1)))
    found = []
    for level, depth in enumerate(DEPTHS):
        key = f"transform(orders, o -> struct(o AS order, xxhash64(o, substring(_twice, {2 * FIRST} * o + 1, {2 * depth})) AS key))"
        keyed = active.select("node", F.expr(f"inline({key})"))
        regions = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("first")).filter("n > 1")
        members = materialize(attach_groups(keyed, regions, ["key"], how="inner", spread="node"))
        few = members.filter(F.col("n") <= REGION).groupBy("key").agg(F.array_sort(F.collect_list("node")).alias("all"))
        found.append(few.selectExpr("inline(flatten(transform(all, (x, i) -> transform(slice(all, i + 2, size(all)), y -> struct(x AS a, y AS b)))))"))
        many = members.filter(F.col("n") > REGION).select("node", "order", "first")
        if level == 0:
            large = members.filter(F.col("n") > REGION).select("key", "order", "node")
        if many.isEmpty():
            break
        found.append(many.selectExpr("first AS a", "node AS b"))
        active = many.groupBy("node").agg(F.collect_list("order").alias("orders")).join(double, "node")  # one row per node
    pairs = found[0]
    for other in found[1:]:
        pairs = pairs.unionAll(other)
    return pairs.filter("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("times")), large


def shared_counts(one: list[np.ndarray], two: list[np.ndarray]) -> np.ndarray:
    """Size of the intersection of every set of ``one`` with every set of ``two``."""
    flats = [np.concatenate(x) for x in (one, two)]
    common = np.intersect1d(*map(np.unique, flats))
    out = np.zeros((len(one), len(two)))
    if not len(common):
        return out.astype(np.int64)
    sides = []
    for sets, flat in zip((one, two), flats):
        at = np.minimum(np.searchsorted(common, flat), len(common) - 1)
        held = common[at] == flat
        at, row = at[held], np.repeat(np.arange(len(sets)), [len(s) for s in sets])[held]
        order = np.argsort(at, kind="stable")
        sides.append((at[order], row[order], len(sets)))
    for first in range(0, len(common), COLUMNS):
        width = min(COLUMNS, len(common) - first)
        parts = []
        for at, row, n in sides:
            lo, hi = np.searchsorted(at, [first, first + width])
            dense = np.zeros((n, width), np.float32)
            dense[row[lo:hi], at[lo:hi] - first] = 1
            parts.append(dense)
        out += parts[0] @ parts[1].T
    return out.astype(np.int64)


def block_links(one: list[tuple], two: list[tuple] | None, threshold: float) -> list[tuple]:
    """Links (a, b) between sets (node, label, shingles) of two blocks, or inside one, that join different labels; no more than do so."""
    other = one if two is None else two
    a, b = ([np.frombuffer(x[2], np.uint64) for x in side] for side in (one, other))
    la, lb = (np.array([x[1] for x in side]) for side in (one, other))
    apart = la[:, None] != lb[None, :]
    if not apart.any():
        return []
    shared = shared_counts(a, b)
    sizes = np.array([len(s) for s in a])[:, None] + np.array([len(s) for s in b])[None, :]
    near = apart & (shared > 0) & (100 * shared >= threshold * 100 * (sizes - shared))
    up: dict = {}

    def top(x):
        while x in up:
            x = up[x]
        return x

    out = []
    for i, j in np.argwhere(near):
        p, q = top(one[i][1]), top(other[j][1])
        if p != q:
            up[max(p, q)] = min(p, q)
            out.append((one[i][0], other[j][0]))
    return out


def _block_links(threshold: float):
    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        kind = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))
        for one, two in batches:
            answers = []
            for x, y in zip(one, two):
                x, y = ([(r["node"], r["label"], r["s"]) for r in side.as_py()] if side.is_valid else None for side in (x, y))
                answers.append([{"a": a, "b": b} for a, b in block_links(x, y, threshold)])
            yield pa.array(answers, kind)

    run.__annotations__ = {"batches": Iterator[tuple[pa.Array, pa.Array]], "return": Iterator[pa.Array]}
    return arrow_udf(run, "array<struct<a:bigint,b:bigint>>").asNondeterministic()


def region_links(members: DataFrame, labels: DataFrame, texts: DataFrame, threshold: float) -> DataFrame | None:
    """Links (a, b) that join different labels inside the regions of ``members`` (key, node); None if no region has two labels.

    Every two sets of a region that have different labels and nearly equal sizes
    are compared in full.  Sets meet in blocks of bounded size, two blocks per
    row, and only links come out, so no region is one task and no row is a pair.
    Sets of a region's largest label meet only sets of the other labels.
    """
    regions_of = members.groupBy("node").agg(F.collect_list("key").alias("keys")).join(labels, "node", "left")
    placed = regions_of.select(F.explode("keys").alias("key"), "node", F.coalesce("label", "node").alias("label"))
    sizes = placed.groupBy("key", "label").agg(F.count(F.lit(1)).alias("n"))
    mixed = sizes.groupBy("key").agg(F.count(F.lit(1)).alias("labels"), F.max_by("label", F.struct("n", "label")).alias("largest")).filter("labels > 1")
    placed = materialize(attach_groups(placed, mixed.select("key", "largest"), ["key"], how="inner", spread="node").withColumn("other", F.expr("label <> largest")).drop("largest"))
    if placed.isEmpty():
        return None
    ids = materialize(placed.select("node").distinct())
    few = ids.count() <= BROADCAST_IDS
    make = row_udf(lambda: lambda rows, h=WordHash(): [shingle_set(h, t).tobytes() for t in rows], "binary")
    sets = texts.join(F.broadcast(ids) if few else ids, "node").select("node", make("text").alias("s")).filter("length(s) > 0")
    step = -float(np.log(0.999 * threshold))  # sets as similar as the threshold are in one size class or in neighbouring ones
    sets = sets.selectExpr("node", "s", "length(s) div 8 AS n", f"cast(floor(ln(length(s) / 8D) / {step!r}D) AS int) AS size_class", "xxhash64(node, s) AS h")
    sets = materialize(sets.dropDuplicates(["node", "h"]))
    regions_of = placed.groupBy("node").agg(F.collect_list(F.struct("key", "label", "other")).alias("regions"))
    light = regions_of.join(sets.select("node", "n", "size_class", "h"), "node").select("node", "n", "size_class", "h", F.expr("inline(regions)"))
    parts = light.groupBy("key", "size_class", "other").agg(F.expr(f"cast(greatest(ceil(sum(n) / {BLOCK_SHINGLES}), ceil(count(1) / {BLOCK_SETS})) AS int)").alias("blocks"))
    parts = materialize(parts)
    block = F.expr("cast(pmod(h, blocks) AS int)").alias("block")
    rows = light.join(parts, ["key", "size_class", "other"]).select("key", "size_class", "other", block, "node", "label", "h")
    rows = rows.groupBy("node", "h").agg(F.collect_list(F.struct("key", "size_class", "other", "block", "label")).alias("regions"))
    rows = rows.join(sets.select("node", "h", "s"), ["node", "h"]).select("node", "s", F.expr("inline(regions)"))
    blocks = rows.groupBy("key", "size_class", "other", "block").agg(F.collect_list(F.struct("node", "label", "s")).alias("sets"))
    # a block's number tells sets of the region's largest label (even) from the others (odd); two even ones have nothing to link
    blocks = materialize(blocks.select("key", "size_class", F.expr("2 * block + int(other)").alias("block"), "sets"))
    here = blocks.select("key", F.col("size_class").alias("c1"), F.col("block").alias("i"))
    there = blocks.select("key", F.col("size_class").alias("c2"), F.col("block").alias("j"))
    meet = here.join(there, "key").filter("((c1 = c2 AND i <= j) OR c2 = c1 + 1) AND (i % 2 = 1 OR j % 2 = 1)")
    same = F.expr("c1 = c2 AND i = j")
    meet = meet.select("key", "c1", "i", F.when(~same, F.col("c2")).alias("c2"), F.when(~same, F.col("j")).alias("j"))
    left = blocks.select("key", F.col("size_class").alias("c1"), F.col("block").alias("i"), F.col("sets").alias("one"))
    right = blocks.select("key", F.col("size_class").alias("c2"), F.col("block").alias("j"), F.col("sets").alias("two"))
    both = meet.join(left, ["key", "c1", "i"]).join(right, ["key", "c2", "j"], "left")
    return materialize(both.select(F.explode(_block_links(threshold)("one", "two")).alias("l")).select("l.a", "l.b").distinct())


def _confirm(threshold: float):
    def same(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        cache, kept = WordHash(), OrderedDict()

        def shingles(text: bytes) -> np.ndarray:
            name = xxhash.xxh3_128_digest(text)
            if name in kept:
                kept.move_to_end(name)
                return kept[name]
            kept[name] = shingle_set(cache, text)
            while len(kept) > 64:
                kept.popitem(last=False)
            return kept[name]

        for one, two in batches:
            answers = []
            for x, y in zip(as_bytes(one), as_bytes(two)):
                a, b = shingles(x), shingles(y)
                shared = shared_count(a, b)
                answers.append(100 * shared >= threshold * 100 * (len(a) + len(b) - shared) and shared > 0)
            yield pa.array(answers, pa.bool_())

    same.__annotations__ = {"batches": Iterator[tuple[pa.Array, pa.Array]], "return": Iterator[pa.Array]}
    return arrow_udf(same, "boolean").asNondeterministic()


def confirmed(pairs: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) whose full shingle sets are similar to the threshold.

    ``texts`` (node, text) is first reduced to the nodes asked for; their ids go
    to every task only if they are few.
    """
    ids = materialize(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct())
    few = ids.count() <= BROADCAST_IDS
    wanted = texts.join(F.broadcast(ids) if few else ids, "node")
    # a text with many partners is dealt to 16 joins
    salted = materialize(pairs.select("a", "b", F.pmod(F.xxhash64("b"), F.lit(16)).alias("_salt")))
    firsts = salted.select("a", "_salt").distinct().join(wanted.select(F.col("node").alias("a"), F.col("text").alias("_a")), "a")
    two = salted.join(wanted.select(F.col("node").alias("b"), F.col("text").alias("_b")), "b")
    both = two.join(firsts, ["a", "_salt"])
    return materialize(both.withColumn("ok", _confirm(threshold)("_a", "_b")).filter("ok").select("a", "b").distinct())


def link_groups(docs: DataFrame, threshold: float = 0.75) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of ``docs``.

    Texts with equal shingle sets are one node under their smallest doc_id.  Of
    the candidate pairs, first the best earlier neighbour of each node is
    confirmed; then every pair that still joins different components.  So each
    candidate link is confirmed on full sets or lies inside a component that
    confirmed links make anyway, and a group of copies costs links in proportion
    to its size.  Then the regions of more than ``REGION`` texts are finished:
    all their pairs that are still in different components are compared.

    Texts without words have no shingles and no links.  Rows that repeat a
    doc_id are one document as to links and come out one by one.  A row with a
    null doc_id is linked with nothing, has a null component_id and is kept.
    Extra columns are ignored; an empty table gives no row.
    """
    bound_batches(docs.sparkSession)
    kind = "struct<n_shingles:bigint,digest:binary,sig:binary>"
    light = materialize(plain(docs, "doc_id", "text").select("doc_id", row_udf(_sketcher, kind)("text").alias("s")).select("doc_id", "s.*"))
    linked = light.filter("digest IS NOT NULL AND doc_id IS NOT NULL")
    nodes = materialize(linked.groupBy("digest").agg(F.min("doc_id").alias("node"), F.first("sig").alias("sig")))
    placed = materialize(linked.select("doc_id", "digest").join(nodes.select("digest", "node"), "digest").select("doc_id", "node").distinct())
    again = placed.groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("b"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    same_id = placed.join(again.select("doc_id", "a"), "doc_id").select("a", F.col("node").alias("b"))

    pairs, large = candidates(nodes)
    pairs = materialize(pairs)
    texts = plain(docs, "doc_id", "text").withColumnRenamed("doc_id", "node")
    best = pairs.groupBy("b").agg(F.max_by("a", F.struct("times", -F.col("a"))).alias("a"))
    links = confirmed(best, texts, threshold)
    groups = materialize(components(links))
    at = lambda side: groups.select(F.col("node").alias(side), F.col("label").alias(f"_{side}"))
    rest = pairs.join(best.select("a", "b"), ["a", "b"], "left_anti").join(at("a"), "a", "left").join(at("b"), "b", "left")
    rest = materialize(rest.filter(F.coalesce("_a", "a") != F.coalesce("_b", "b")).select("a", "b"))
    more = confirmed(rest, texts, threshold)
    labels = components(links.unionByName(more).unionByName(same_id.select("a", "b")))
    for orders in ROUNDS:
        labels = materialize(labels)
        more = region_links(large.filter(F.col("order").isin(*orders)), labels, texts, threshold)
        if more is not None:
            labels = components(more.unionByName(labels.select(F.col("node").alias("a"), F.col("label").alias("b"))))
    found = placed.join(labels, "node", "left").select("doc_id", F.coalesce("label", "node").alias("component_id"))
    found = found.groupBy("doc_id").agg(F.min("component_id").alias("component_id"))
    out = light.select("doc_id", "n_shingles").join(found, "doc_id", "left").withColumn("component_id", F.coalesce("component_id", "doc_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def one_of_each(docs: DataFrame, threshold: float = 0.75) -> DataFrame:
    """The rows of ``docs``, all columns, of one document of each group.

    Rows that repeat a kept doc_id stay once per shingle set, the one with the
    smallest hash of its columns; so texts that differ stay, whatever their id.
    The ids that go are sent to every task if they are few, so the texts needn't
    be shuffled; more are joined.
    """
    judged = materialize(link_groups(docs, threshold))
    gone = materialize(judged.filter("NOT kept").select("doc_id").distinct())
    few = gone.count() <= BROADCAST_IDS
    out = docs.join(F.broadcast(gone) if few else gone, docs["doc_id"] == gone["doc_id"], "left_anti")
    repeated = materialize(judged.filter("kept AND doc_id IS NOT NULL").groupBy("doc_id").count().filter("count > 1").select("doc_id"))
    if repeated.isEmpty():
        return out
    once = out.join(repeated, out["doc_id"] == repeated["doc_id"], "left_anti")
    again = out.join(repeated, out["doc_id"] == repeated["doc_id"], "left_semi")
    digest = row_udf(lambda: lambda rows, h=WordHash(): [xxhash.xxh3_128_digest(shingle_set(h, t).tobytes()) for t in rows], "binary")
    row = F.struct(*[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(docs.columns)])
    text = "text" if "text" in docs.columns else None
    packed = again.select(row.alias("row"), F.col("doc_id").alias("id"), digest(F.col("text") if text else F.lit(None).cast("string")).alias("set"))
    first = packed.groupBy("id", "set").agg(F.min_by("row", F.xxhash64("row")).alias("row"))
    return once.unionByName(first.select(*[F.col(f"row.c{k}").alias(c) for k, c in enumerate(docs.columns)]))
