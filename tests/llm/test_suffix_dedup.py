import hashlib
import random

import numpy as np
import pytest

from heldout.llm import suffix_dedup, suffix_runs
from tests.llm.fixtures import documents, empty, words

DDL = "doc_id bigint, text string"


def brute(rows, length):
    """(doc_id, n_bytes, kept, spans) of each row, from the first document of every string."""
    first = {}
    for i, t in rows:
        raw = (t or "").encode()
        if i is not None:
            for k in range(len(raw) - length + 1):
                s = raw[k : k + length]
                first[s] = min(i, first.get(s, i))
    out = []
    for i, t in rows:
        raw = (t or "").encode()
        gone = bytearray(len(raw))
        if i is not None:
            for k in range(len(raw) - length + 1):
                if first[raw[k : k + length]] < i:
                    gone[k : k + length] = b"\1" * length
        spans, k = [], 0
        while k < len(raw):
            e = k
            while e < len(raw) and gone[e]:
                e += 1
            if e > k:
                spans.append((k, e - k))
            k = max(e, k + 1)
        out.append((i, len(raw), bytes(b for b, g in zip(raw, gone) if not g), tuple(spans)))
    return sorted(out, key=repr)


def found(docs, length, **sizes):
    rows = suffix_dedup.cut_repeats(docs, length, **sizes).collect()
    return sorted(((r["doc_id"], r["n_bytes"], bytes(r["kept"]), tuple(map(tuple, r["spans"]))) for r in rows), key=repr)


def check(docs, length=50, **sizes):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert found(docs, length, **sizes) == brute(rows, length)


def tangled(seed: int, n: int):
    """Texts of shared pieces that are cut anywhere, long runs of one byte, repeats inside one text, and copies."""
    rng = random.Random(seed)
    pieces = [words(rng, rng.randint(3, 25)) for _ in range(12)] + ["-" * 130, "ab" * 70, "日本語の長い文字列です。" * 6, "\0" * 90 + "x\0" * 30]
    rows = []
    for i in range(n):
        parts = []
        for _ in range(rng.randint(0, 5)):
            p = rng.choice(pieces)
            a = rng.randint(0, len(p) // 2)
            parts.append(p[a : rng.randint(a, len(p))] if rng.random() < 0.6 else p)
            parts.append(words(rng, rng.randint(0, 4)))
        rows.append((rng.choice((i, i, i, n - i)), " ".join(parts)))
    return rows + [(i + 1000, t) for i, t in rows[:5]]


def test_awkward_rows(spark):
    check(documents(spark))
    assert found(empty(spark), 50) == []
    check(spark.createDataFrame([(None, "x" * 80), (2, None), (2, "y" * 49), (2, "z" * 200), (2, "z" * 200), (1, "z" * 50)], DDL))


@pytest.mark.parametrize("length, run_bytes, bucket_bytes", [(50, 1 << 24, 1 << 23), (50, 1500, 3000), (20, 4000, 1000), (9, 2000, 2000), (70, 3000, 1 << 20)])
def test_shared_pieces(spark, length, run_bytes, bucket_bytes):
    """Many small runs, many buckets and other lengths give what brute force gives."""
    check(spark.createDataFrame(tangled(length + run_bytes, 70), DDL).repartition(5), length, run_bytes=run_bytes, bucket_bytes=bucket_bytes)


def test_passage_of_a_third_of_all_rows_and_a_long_text(spark):
    rng = random.Random(4)
    passage = words(rng, 60)
    rows = [(i, words(rng, 20) + (f" {passage} " if i % 3 == 0 else " ") + words(rng, 20)) for i in range(150)]
    check(spark.createDataFrame(rows + [(500, words(rng, 30_000) + passage)], DDL).repartition(6), run_bytes=20_000, bucket_bytes=20_000)


def test_runs_keep_their_keys():
    rng = random.Random(2)
    shape = suffix_runs.Shape(50)
    texts = [words(rng, 80).encode() + b"\0" * rng.randint(0, 70) for _ in range(60)]
    keys, text, start, starts = suffix_runs.anchors(texts + texts[:20], shape)
    assert int(starts.sum()) == sum(len(t) - 49 for t in texts + texts[:20])  # every string has one anchor
    bucket = suffix_runs.places(keys, 3)
    order, group = suffix_runs.sort_order(keys, bucket)
    want = sorted(range(len(keys)), key=lambda k: (bucket[k], keys[k].tobytes()))
    assert [(bucket[k], keys[k].tobytes()) for k in order] == [(bucket[k], keys[k].tobytes()) for k in want]
    assert (np.diff(group) == [int(keys[a].tobytes() != keys[b].tobytes() or bucket[a] != bucket[b]) for a, b in zip(order, order[1:])]).all()
    rows = keys[order]
    packed = suffix_runs.pack_run(rows, [text[order], start[order] - 5], shape)
    again, lcp, numbers = suffix_runs.unpack_run(packed, shape)
    assert (again == rows).all() and (lcp == suffix_runs.common_prefixes(rows)).all() and (numbers[0] == text[order]).all() and (numbers[1] == start[order] - 5).all()
    assert sum(map(len, packed)) < rows.nbytes / 3


@pytest.mark.parametrize("count", [1, 2, 3, 8, 13])
def test_loser_tree_gives_order_and_prefixes(count):
    rng = random.Random(count)
    runs = [sorted(bytes(rng.choices(b"ab", k=9)) for _ in range(rng.randint(0, 40))) for _ in range(count)]
    lcps = [suffix_runs.common_prefixes(np.frombuffer(b"".join(r), np.uint8).reshape(-1, 9)).tolist() for r in runs]
    merged = list(suffix_runs.merge_runs(list(zip(runs, lcps))))
    keys = [runs[r][k] for r, k, _ in merged]
    assert keys == sorted(k for r in runs for k in r)
    prefix = lambda a, b: next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    assert [p for _, _, p in merged][1:] == [prefix(a, b) for a, b in zip(keys, keys[1:])]


def test_query_digests(spark, tmp_path):
    from heldout.llm.queries import QUERIES

    documents(spark).write.parquet(f"{tmp_path}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in documents(spark).collect()]
    want = [(i, n, n - len(k), len(s), hashlib.sha256(k).hexdigest()) for i, n, k, s in brute(rows, 50)]
    got = [tuple(r) for r in QUERIES["op12_suffix_dedup"](spark, str(tmp_path)).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
