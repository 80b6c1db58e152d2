"""Alignment of two tokenizers on the same text, and how often their token pairs are linked corpus-wide.

One state vector holds the A and B pointers of all lanes of a batch.  A step
moves the pointer whose token ends first, or both where they end together; that
is a cut, which closes a group.  A lane is a document or, where it is long, a
stretch of it between two common ends, so that few lanes outlive the others.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heldout.functions.materialize import checkpoint_root, materialize
from heldout.llm.text import as_bytes, bound_batches, plain

BATCH_BYTES = 2 << 20  # text that is aligned in lockstep, about
LANE = 256  # A tokens of a lane, about
WIDE = 4096  # links of a group from which equal ids are counted before they are paired
FREQUENT = 300_000  # commonest pairs whose counts every task holds; all others are joined
_ALIGNED = "doc_id bigint, a_ids array<int>, b_ids array<int>, group_a array<int>, group_b array<int>, link_a array<int>, link_b array<int>, link_n array<int>"

Encode = Callable[[list[str]], list[list[int]]]
#: Cuts of byte-level vocabularies, a fixed value of their library.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: What lies outside of blocks whose letters, numbers and white space all libraries tell apart alike.
RARE = re.compile("[^\x00-\u024f\u0391-\u03c9\u0400-\u04ff\u2010-\u2027\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fa5\uac00-\ud7a3]")


def _ranked(path: str, letters: dict[str, int]):
    """The same vocabulary as ranks of merges, which is several times faster; None where its file says more than that."""
    import tiktoken

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, cut = spec["model"], spec.get("pre_tokenizer") or {}
    plain = model.get("type") == "BPE" and cut.get("type") == "ByteLevel" and not cut.get("add_prefix_space") and cut.get("use_regex", True)
    if not plain or spec.get("normalizer") or model.get("unk_token") or model.get("ignore_merges") or model.get("continuing_subword_prefix") or model.get("end_of_word_suffix"):
        return None
    special = {x["id"] for x in spec["added_tokens"]}
    ranks = {bytes(letters[c] for c in t): i for t, i in model["vocab"].items() if i not in special}
    pairs = (m.split(" ") if isinstance(m, str) else m for m in model["merges"])
    made = [ranks.get(bytes(letters[c] for c in a + b)) for a, b in pairs]
    if made != sorted(set(made), key=lambda i: -1 if i is None else i) or len(made) + 256 != len(ranks):
        return None
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_tables(path_a: str, path_b: str) -> tuple[Encode, Encode, list[bytes], list[bytes]]:
    """Encoders of both sides and the bytes of each id; A reads space and text, B adds the space itself."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one core per task
    import sentencepiece
    from tokenizers import Tokenizer

    from heldout.llm.pieces import _byte_letters

    a = Tokenizer.from_file(path_a)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=path_b)
    letters = {letter: byte for byte, letter in _byte_letters().items()}
    vocabulary = a.get_vocab(with_added_tokens=True)
    bytes_a = [b""] * (max(vocabulary.values()) + 1)
    for token, i in vocabulary.items():
        bytes_a[i] = bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()
    bytes_b = []
    for i in range(b.vocab_size()):
        piece = b.id_to_piece(i)
        bytes_b.append(bytes([int(piece[3:5], 16)]) if b.is_byte(i) else piece.replace("▁", " ").encode())
    ranked = _ranked(path_a, letters)

    def encode_a(texts: list[str]) -> list[list[int]]:
        if ranked is None:
            return [e.ids for e in a.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)]
        return [a.encode(" " + t, add_special_tokens=False).ids if RARE.search(t) else ranked.encode_ordinary(" " + t) for t in texts]

    return encode_a, lambda texts: b.encode(texts, num_threads=1), bytes_a, bytes_b


def lane_starts(ends_a: np.ndarray, ends_b: np.ndarray, first_a: np.ndarray, first_b: np.ndarray, lane: int) -> tuple[np.ndarray, np.ndarray]:
    """First A and B token of every lane: of each document, and after a common end near every ``lane``-th A token."""
    near = np.minimum(np.arange(lane, len(ends_a), lane)[:, None] + np.arange(16), len(ends_a) - 1)
    at = np.minimum(np.searchsorted(ends_b, ends_a[near]), len(ends_b) - 1)
    hit = ends_b[at] == ends_a[near]
    column = hit.argmax(1)
    row = np.arange(len(near))
    held = hit[row, column] if len(near) else np.zeros(0, bool)
    more_a, more_b = near[row, column][held] + 1, at[row, column][held] + 1
    inside = more_a < len(ends_a)
    starts_a, which = np.unique(np.concatenate((first_a, more_a[inside])), return_index=True)
    return starts_a, np.concatenate((first_b, more_b[inside]))[which]


def lockstep(ends_a: np.ndarray, ends_b: np.ndarray, start_a: np.ndarray, start_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(groups, links, wide) of token ends that rise over the whole batch.

    A group is (first A, end A, first B, end B) in token numbers, in order; a
    link is (A token, B token).  ``wide`` are the groups of more than ``WIDE``
    links, whose links are not listed.
    """
    a, b, stop = start_a.copy(), start_b.copy(), np.concatenate((start_a[1:], [len(ends_a)]))
    from_a, from_b = a.copy(), b.copy()
    groups, links = [], []
    while len(a):
        x, y = ends_a[a], ends_b[b]
        a += x <= y
        b += y <= x
        at = np.flatnonzero(x == y)
        if not len(at):
            continue
        group = np.stack((from_a[at], a[at], from_b[at], b[at]), 1)
        groups.append(group)
        wide_b = group[:, 3] - group[:, 2]
        n = (group[:, 1] - group[:, 0]) * wide_b
        n[n > WIDE] = 0
        owner = np.repeat(np.arange(len(at)), n)
        k = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
        links.append(np.stack((group[owner, 0] + k // wide_b[owner], group[owner, 2] + k % wide_b[owner])))
        from_a[at], from_b[at] = a[at], b[at]
        going = a < stop
        if not going.all():
            a, b, stop, from_a, from_b = a[going], b[going], stop[going], from_a[going], from_b[going]
    if not groups:
        return np.zeros((0, 4), np.int64), np.zeros((2, 0), np.int64), np.zeros((0, 4), np.int64)
    found = np.concatenate(groups)
    found = found[np.argsort(found[:, 0], kind="stable")]
    wide = (found[:, 1] - found[:, 0]) * (found[:, 3] - found[:, 2]) > WIDE
    return found, np.concatenate(links, 1), found[wide]


def align_batch(texts: Sequence[bytes], tables: tuple, lane: int = LANE) -> list[np.ndarray]:
    """Flat arrays with their rows' edges: [(values, edges) of _ALIGNED after doc_id]."""
    encode_a, encode_b, bytes_a, bytes_b = tables
    decoded = [t.decode("utf-8", "replace") for t in texts]
    some = [k for k, t in enumerate(decoded) if t]
    ids: list[tuple] = [([], [])] * len(texts)
    for k, x, y in zip(some, encode_a([decoded[k] for k in some]), encode_b([decoded[k] for k in some])):
        want = b" " + texts[k]
        if b"".join(map(bytes_a.__getitem__, x)) == want and b"".join(map(bytes_b.__getitem__, y)) == want:
            ids[k] = (x, y)
    flat, edges, ends = [], [], []
    for side, table in ((0, bytes_a), (1, bytes_b)):
        flat.append(np.array([i for pair in ids for i in pair[side]], np.int64))
        edges.append(np.concatenate(([0], np.cumsum([len(pair[side]) for pair in ids]))))
        lengths = np.array([len(t) for t in table], np.int64)
        ends.append(np.cumsum(lengths[flat[-1]]))
    held = edges[0][1:] > edges[0][:-1]
    starts = lane_starts(*ends, edges[0][:-1][held], edges[1][:-1][held], lane) if held.any() else (np.zeros(0, np.int64),) * 2
    groups, links, wide = lockstep(*ends, *starts)
    owner = np.searchsorted(edges[0], groups[:, 0], "right") - 1
    group_edges = np.searchsorted(owner, np.arange(len(texts) + 1))
    row, a, b, n = np.searchsorted(edges[0], links[0], "right") - 1, flat[0][links[0]], flat[1][links[1]], np.ones(links.shape[1], np.int64)
    if len(wide):
        parts = [(row, a, b, n)]
        for a0, a1, b0, b1 in wide.tolist():
            (ua, na), (ub, nb) = np.unique(flat[0][a0:a1], return_counts=True), np.unique(flat[1][b0:b1], return_counts=True)
            k = int(np.searchsorted(edges[0], a0, "right")) - 1
            parts.append((np.full(len(ua) * len(ub), k), np.repeat(ua, len(ub)), np.tile(ub, len(ua)), np.outer(na, nb).ravel()))
        row, a, b, n = (np.concatenate(x) for x in zip(*parts))
    order = np.argsort((row * len(bytes_a) + a) * len(bytes_b) + b, kind="stable")
    row, a, b, n = row[order], a[order], b[order], n[order]
    fresh = np.flatnonzero(np.concatenate((np.ones(min(1, len(row)), bool), (row[1:] != row[:-1]) | (a[1:] != a[:-1]) | (b[1:] != b[:-1]))))
    n = np.add.reduceat(n, fresh) if len(fresh) else n
    link_edges = np.searchsorted(row[fresh], np.arange(len(texts) + 1))
    out = [(flat[0], edges[0]), (flat[1], edges[1]), (groups[:, 1] - groups[:, 0], group_edges), (groups[:, 3] - groups[:, 2], group_edges)]
    return out + [(x, link_edges) for x in (a[fresh], b[fresh], n)]


def _lists(values: np.ndarray, edges: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(values, pa.int32()))


def align(docs: DataFrame, path_a: str, path_b: str, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """doc_id, both token sequences, the sizes of their groups, and the linked id pairs of every row of ``docs``.

    ``a_ids`` are the tokens of a space and the text, ``b_ids`` of the text;
    ``group_a`` and ``group_b`` say how many of them each group holds, in order;
    (``link_a``, ``link_b``) are the distinct id pairs that share a group, and
    ``link_n`` how many token pairs that is.  Texts that are null, empty, or not
    given back whole by both sides have empty arrays.  Rows with null or
    repeated doc_ids are aligned one by one; extra columns are ignored; an empty
    table gives no row.
    """
    bound_batches(docs.sparkSession)
    names = ("a_ids", "b_ids", "group_a", "group_b", "link_a", "link_b", "link_n")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = token_tables(path_a, path_b)

        def flush() -> pa.RecordBatch:
            columns = {n: _lists(*c) for n, c in zip(names, align_batch(texts, tables))}
            return pa.record_batch({"doc_id": pa.array(ids, pa.int64()), **columns})

        texts, ids, size = [], [], 0
        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1))):
                if size and size + len(text) > batch_bytes:
                    yield flush()
                    texts, ids, size = [], [], 0
                texts.append(text)
                ids.append(i)
                size += len(text)
        if ids:
            yield flush()

    return plain(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("bigint")).mapInArrow(run, _ALIGNED)


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values and row edges of a list column without nulls."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    offsets = column.offsets.to_numpy()
    return column.values.to_numpy()[offsets[0] : offsets[-1]].astype(np.int64), offsets - offsets[0]


def group_digests(aligned: DataFrame, size_a: int, size_b: int) -> DataFrame:
    """``aligned`` without its tokens and groups: their numbers, and SHA-256 of the groups as ``a1,a2|b1;a3|b2,b3`` ('' without tokens)."""
    import hashlib

    kind = pa.struct([(n, pa.int64()) for n in ("n_a", "n_b", "n_groups", "n_links")] + [("groups_sha256", pa.string())])

    def run(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        said = [f"{i}{end}" for i in range(size_a) for end in ",|"] + [f"{i}{end}" for i in range(size_b) for end in ",;"]
        for batch in batches:
            (a, edges_a), (b, edges_b), (in_a, edges_g), (in_b, _), (n, edges_n) = map(_flat, batch)
            last_a, last_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
            last_a[np.cumsum(in_a) - 1] = 1
            last_b[np.cumsum(in_b) - 1] = 1
            code = np.empty(len(a) + len(b), np.int64)
            code[np.arange(len(a)) + np.repeat(np.cumsum(in_b) - in_b, in_a)] = 2 * a + last_a
            code[np.arange(len(b)) + np.repeat(np.cumsum(in_a), in_b)] = 2 * (size_a + b) + last_b
            strings = list(map(said.__getitem__, code.tolist()))
            edges = (edges_a + edges_b).tolist()
            links = np.diff(np.concatenate(([0], np.cumsum(n)))[edges_n])
            rows = []
            for k, counts in enumerate(zip(np.diff(edges_a).tolist(), np.diff(edges_b).tolist(), np.diff(edges_g).tolist(), links.tolist())):
                text = "".join(strings[edges[k] : edges[k + 1]])[:-1]
                rows.append((*counts, hashlib.sha256(text.encode()).hexdigest() if text else ""))
            yield pa.array([dict(zip(("n_a", "n_b", "n_groups", "n_links", "groups_sha256"), r)) for r in rows], kind)

    run.__annotations__ = {"batches": Iterator[tuple[pa.Array, ...]], "return": Iterator[pa.Array]}
    digest = F.arrow_udf(run, "struct<n_a:bigint,n_b:bigint,n_groups:bigint,n_links:bigint,groups_sha256:string>").asNondeterministic()
    return aligned.select("doc_id", digest("a_ids", "b_ids", "group_a", "group_b", "link_n").alias("d"), "link_a", "link_b", "link_n").select(
        "doc_id", "d.*", "link_a", "link_b", "link_n"
    )


def pair_counts(links: DataFrame) -> DataFrame:
    """(pair, a, n, best): in how many rows each id pair is linked, and whether that is the most of its A id; ``pair`` is (a << 32) + b."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush() -> pa.RecordBatch:
            pairs, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.record_batch({"pair": pa.array(pairs, pa.int64()), "n": pa.array(n, pa.int64())})

        for batch in batches:
            a, b = (_flat(batch.column(k))[0] for k in range(2))
            held.append((a << 32) + b)
            size += len(a)
            if size > 4_000_000:
                yield flush()
                held, size = [], 0
        if held:
            yield flush()

    pairs = links.select("link_a", "link_b").mapInArrow(count, "pair bigint, n bigint").groupBy("pair").agg(F.sum("n").alias("n"))
    pairs = materialize(pairs.withColumn("a", F.shiftright("pair", 32)))
    most = pairs.groupBy("a").agg(F.max("n").alias("most"))
    return materialize(pairs.join(most, "a").select("pair", "a", "n", (F.col("n") == F.col("most")).alias("best")))


def link_statistics(links: DataFrame, frequent: int = FREQUENT) -> DataFrame:
    """``links`` without its link columns, plus n_best and count_sum over its token pairs.

    The count of a pair is the number of rows that hold it.  The ``frequent``
    commonest pairs, a bounded table, are known to every task; rarer ones of a
    row are joined, so no pair of many rows is a join key.
    """
    from heldout.llm.token_counts import commonest

    spark = links.sparkSession
    path = f"{checkpoint_root(spark)}/tables/links-{os.urandom(8).hex()}"
    links.select(F.monotonically_increasing_id().alias("row"), "*").write.option("compression", "zstd").parquet(path)
    rows = spark.read.parquet(path)
    counts = pair_counts(rows)
    top = commonest(counts, frequent).select("pair", "n", "best").toArrow().sort_by("pair")
    known = spark.sparkContext.broadcast(tuple(top[c].to_numpy().astype(np.int64) for c in ("pair", "n", "best")))
    kind = pa.struct([("n_best", pa.int64()), ("count_sum", pa.int64()), ("rest", pa.list_(pa.struct([("pair", pa.int64()), ("times", pa.int64())])))])

    def run(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        pairs, n, best = known.value
        for batch in batches:
            (a, edges), (b, _), (times, _) = map(_flat, batch)
            pair = (a << 32) + b
            at = np.minimum(np.searchsorted(pairs, pair), max(0, len(pairs) - 1))
            hit = pairs[at] == pair if len(pairs) else np.zeros(len(pair), bool)
            count, top = np.zeros(len(pair), np.int64), np.zeros(len(pair), np.int64)
            count[hit], top[hit] = n[at[hit]] * times[hit], best[at[hit]] * times[hit]
            sums = [np.diff(np.concatenate(([0], np.cumsum(x)))[edges]) for x in (top, count)]
            left = np.flatnonzero(~hit)
            rest = pa.StructArray.from_arrays([pa.array(pair[left]), pa.array(times[left])], fields=list(kind.field("rest").type.value_type))
            lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(left, edges), pa.int32()), rest, type=kind.field("rest").type)
            yield pa.StructArray.from_arrays([pa.array(sums[0]), pa.array(sums[1]), lists], fields=list(kind))

    run.__annotations__ = {"batches": Iterator[tuple[pa.Array, ...]], "return": Iterator[pa.Array]}
    look = F.arrow_udf(run, "struct<n_best:bigint,count_sum:bigint,rest:array<struct<pair:bigint,times:bigint>>>").asNondeterministic()
    scored = materialize(rows.withColumn("_s", look("link_a", "link_b", "link_n")).drop("link_a", "link_b", "link_n").select("*", "_s.*").drop("_s"))
    rest = scored.select("row", F.explode("rest").alias("r")).select("row", "r.*").join(counts.select("pair", "n", "best"), "pair")
    sums = rest.groupBy("row").agg(F.sum(F.col("times") * F.col("n")).alias("_sum"), F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("_best"))
    both = scored.drop("rest").join(sums, "row", "left")
    for name, more in (("n_best", "_best"), ("count_sum", "_sum")):
        both = both.withColumn(name, F.col(name) + F.coalesce(more, F.lit(0)))
    return both.drop("row", "_sum", "_best")


def alignment_statistics(docs: DataFrame, path_a: str, path_b: str, frequent: int = FREQUENT) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, groups_sha256, n_best, count_sum of every row of ``docs``; see ``align`` for awkward rows."""
    _, _, bytes_a, bytes_b = token_tables(path_a, path_b)
    return link_statistics(group_digests(align(docs, path_a, path_b), len(bytes_a), len(bytes_b)), frequent)
