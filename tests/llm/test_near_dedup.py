import random

import numpy as np

from heldout.llm import components, near_dedup
from heldout.llm.text import WordHash, shared_count, shingle_set
from tests.llm.fixtures import documents, empty, shingles, words


def brute(rows):
    """Component of each doc_id by comparing all pairs."""
    ids = sorted({i for i, _ in rows if i is not None})
    parent = {i: i for i in ids}

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    sets = [(i, shingles(t)) for i, t in rows if i is not None]
    for x, (i, a) in enumerate(sets):
        for j, b in sets[:x]:
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                p, q = sorted((top(i), top(j)))
                parent[q] = p
    return {i: top(i) for i in ids}


def check(docs):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    want = brute(rows)
    got = near_dedup.link_groups(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r["component_id"] == (None if r["doc_id"] is None else want[r["doc_id"]])
        assert r["kept"] is (r["doc_id"] is None or r["doc_id"] == r["component_id"])
    sizes = {(i, len(shingles(t))) for i, t in rows}
    assert {(r["doc_id"], r["n_shingles"]) for r in got} == sizes


def test_awkward_rows(spark):
    check(documents(spark))
    assert near_dedup.link_groups(empty(spark)).count() == 0
    left = near_dedup.one_of_each(documents(spark))
    assert left.columns == documents(spark).columns
    ids = [r["doc_id"] for r in left.collect()]
    assert len(ids) == len(set(ids)) and 1 in ids and 2 not in ids and 3 not in ids and None in ids


def test_large_group_of_copies_and_shared_passage(spark):
    rng = random.Random(5)
    base, passage = words(rng, 200).split(), words(rng, 60)
    rows = []
    for i in range(90):  # more near copies than one region pairs
        w = list(base)
        for _ in range(rng.randint(0, 5)):
            w[rng.randrange(len(w))] = words(rng, 1)
        rows.append((i, " ".join(w)))
    rows += [(100 + i, words(rng, 150) + " " + passage) for i in range(60)]
    rows += [(200 + i, words(rng, 30)) for i in range(20)]
    check(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4))


def test_many_edited_variants_of_one_text(spark):
    """Variants are near their original and far from each other; the original's id is in the middle."""
    rng = random.Random(8)
    base = words(rng, 400).split()
    rows = [(500, " ".join(base))]
    for i in range(1001):
        if i != 500:
            w = list(base)
            for k in rng.sample(range(6, 394, 6), rng.choice((9, 10, 11))):
                w[k] = words(rng, 1) + "q"
            rows.append((i, " ".join(w)))
            a, b = shingles(rows[0][1]), shingles(rows[-1][1])
            assert 0.75 < len(a & b) / len(a | b) < 0.8
    got = near_dedup.link_groups(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)).collect()
    assert [r["component_id"] for r in got] == [0] * 1001


def test_blocks_compare_all_sets():
    rng = np.random.default_rng(4)
    pool = rng.integers(0, 2**63, 9000, np.uint64)
    one, two = ([np.unique(rng.choice(pool, n)) for n in rng.integers(1, 4000, 7)] for _ in range(2))
    assert (near_dedup.shared_counts(one, two) == [[shared_count(a, b) for b in two] for a in one]).all()
    rows = [(k, k, s.tobytes()) for k, s in enumerate((pool[:400], pool[100:500], pool[50:450], pool[600:700]))]
    rows = [(k, k, np.sort(np.frombuffer(s, np.uint64)).tobytes()) for k, _, s in rows]
    assert near_dedup.block_links(rows, None, 0.75) == [(0, 2), (1, 2)]
    assert near_dedup.block_links(rows[:2], rows[2:], 0.75) == [(0, 2), (1, 2)] and near_dedup.block_links(rows[:1], rows[1:2], 0.75) == []


def test_sets_match_words():
    cache = WordHash()
    rng = random.Random(1)
    for n in (0, 1, 4, 5, 6, 200):
        a = words(rng, n)
        b = " ".join(a.split()[: n // 2]) + " " + words(rng, 10)
        x, y = shingle_set(cache, a.encode()), shingle_set(cache, b.encode())
        assert len(x) == len(shingles(a)) and shared_count(x, y) == len(shingles(a) & shingles(b))


def test_recall_of_orders_at_the_threshold():
    """Pairs at similarity 0.75 share a prefix of four in some order nearly always."""
    rng = np.random.default_rng(2)
    found = 0
    for _ in range(300):
        common = rng.integers(0, 2**63, 300, np.uint64)
        a, b = (np.unique(np.concatenate((common, rng.integers(0, 2**63, 50, np.uint64)))) for _ in range(2))
        x, y = near_dedup.signatures([a, b])
        found += any((x[k : k + 4] == y[k : k + 4]).all() for k in range(0, near_dedup.HASHES, 4))
    assert found >= 298


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(60)] + [(100, k) for k in range(101, 140)] + [(7, 7), (300, 299), (299, 298)]
    got = {r["node"]: r["label"] for r in components.components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert all(got[i] == 0 for i in range(1, 61)) and all(got[k] == 100 for k in range(101, 140)) and got[300] == got[299] == 298
    assert components.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0
