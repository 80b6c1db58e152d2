import hashlib
import random
import zlib

import numpy as np
import pytest

from heldout.llm import periodic
from heldout.llm.suffix_tree import RangeMinimum, SuffixTree
from heldout.llm.text import WordHash
from tests.llm.fixtures import documents, empty, words


def brute_runs(w, least):
    """(start, length, period) by trying every period and every stretch."""
    found = set()
    n = len(w)
    for q in range(1, n // 2 + 1):
        s = 0
        while s + q < n:
            if w[s] != w[s + q]:
                s += 1
                continue
            e = s
            while e + q < n and w[e] == w[e + q]:
                e += 1
            length = e + q - s
            part = w[s : s + length]
            if length >= 2 * q and not any(part[p:] == part[:-p] for p in range(1, q)):
                found.add((s, length, q))
            s = e + 1
    return sorted(r for r in found if r[1] >= least)


def test_range_minimum():
    rng = np.random.default_rng(1)
    for n in (1, 15, 16, 17, 100, 700):
        values = rng.integers(0, 50, n)
        a, b = np.sort(rng.integers(0, n, (2, 400)), 0)
        assert (RangeMinimum(values).query(a, b) == [values[x : y + 1].min() for x, y in zip(a, b)]).all()


def test_tree_gives_order_and_common_prefixes():
    rng = random.Random(2)
    for n in (1, 2, 7, 40, 90):
        for letters in (1, 2, 5):
            s = [rng.randrange(letters) for _ in range(n)]
            tree = SuffixTree(s)
            assert np.argsort(tree.rank).tolist() == sorted(range(n), key=lambda i: s[i:])
            assert np.argsort(tree.mirror()).tolist() == sorted(range(n), key=lambda i: [-x for x in s[i:]])
            i, j = map(np.array, zip(*[(a, b) for a in range(n) for b in range(n) if a != b])) if n > 1 else (np.zeros(0, int),) * 2
            want = [next((k for k in range(n) if max(a, b) + k >= n or s[a + k] != s[b + k]), n) for a, b in zip(i.tolist(), j.tolist())]
            assert tree.common(i, j).tolist() == want


def test_all_runs_of_small_alphabets():
    rng = random.Random(3)
    for _ in range(300):
        s = [rng.randrange(rng.choice((1, 2, 3))) for _ in range(rng.randint(0, 60))]
        assert [tuple(r) for r in periodic.all_runs(s).tolist()] == brute_runs(s, 0)


@pytest.mark.parametrize("least", [2, 5, 12])
def test_parts_lose_no_run(least):
    """Texts with planted repeats, overlapping runs and repeats that touch at the ends."""
    rng = random.Random(least)
    for _ in range(150):
        w = []
        while len(w) < rng.randint(1, 150):
            root = [rng.choice("abcde") * rng.randint(1, 2) for _ in range(rng.randint(1, 9))]
            times = rng.choice((1, 1, 2, 3, 6))
            w += (root * times)[: rng.randint(1, len(root) * times)] if rng.random() < 0.7 else [str(rng.random())]
        raw = [x.encode() for x in w]
        runs = periodic.runs_of_words(raw, WordHash().of(raw), least)
        assert runs == brute_runs(w, least)
        kept = [x for k, x in enumerate(raw) if not any(s + q <= k < s + n for s, n, q in runs)]
        assert periodic.collapsed(raw, runs) == b" ".join(kept)


def test_awkward_rows(spark):
    rows = {}
    for r in documents(spark).collect():
        w = (r["text"] or "").encode().split()
        runs = brute_runs(w, 12) if len(w) < 1000 else []
        kept = [x for k, x in enumerate(w) if not any(s + q <= k < s + n for s, n, q in runs)]
        rows.setdefault(r["doc_id"], []).append((len(w), runs, b" ".join(kept).decode()))
    got = periodic.periodic_runs(documents(spark)).collect()
    assert len(got) == sum(map(len, rows.values()))
    assert all((r["n_words"], [tuple(x) for x in r["runs"]], r["collapsed"]) in rows[r["doc_id"]] for r in got)
    assert periodic.periodic_runs(empty(spark)).count() == 0


def test_query_digests(spark, tmp_path):
    from heldout.llm.queries import QUERIES

    rng = random.Random(9)
    texts = [(i, words(rng, rng.randint(0, 90))) for i in range(80)] + [(None, "a " * 30), (81, None), (82, "x y " * 20), (7, "same id")]
    texts.append((83, " ".join(words(rng, 7).split() * 3000)))
    spark.createDataFrame(texts, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want, tails = [], 0
    for i, t in texts:
        w = (t or "").split()
        h = 1 if i is None else zlib.crc32(str(i).encode())
        if h % 10 == 0 and w:
            g, n = h // 10, len(w)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = w[:a] + [w[a + (k - a) % p] for k in range(a, n)]
            tails += 1
        runs = [(0, 21000, 7)] if i == 83 else brute_runs(w, 12)
        kept = [x for k, x in enumerate(w) if not any(s + q <= k < s + n for s, n, q in runs)]
        best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
        four = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
        digests = [hashlib.sha256(x.encode()).hexdigest() for x in ("".join(f"{s},{n},{q}\n" for s, n, q in runs), " ".join(kept))]
        want.append((i, len(runs), *four, *digests))
    assert tails > 4
    got = [tuple(r) for r in QUERIES["op13_periodic_runs"](spark, str(tmp_path)).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
