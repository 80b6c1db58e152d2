"""Sequential selections against brute force on small fixtures."""

import hashlib
import random

import numpy as np
import pytest

from heldout.operators import exposure as X


def rank(*parts):
    return hashlib.sha256(":".join(str(p) for p in parts).encode()).hexdigest()


def greedy_donors(train, additions, seed, tie):
    available, out = dict(train), {}
    for uid, (ctx, v, a) in sorted(additions.items(), key=lambda x: rank(seed, "addition", x[0])):
        same = {k: r for k, r in available.items() if r[0] == ctx} or available
        best = min(same, key=lambda k: (np.hypot(same[k][1] - v, same[k][2] - a), tie(uid, k)))
        out[uid] = best
        del available[best]
    return out


def fixture(rng, n_train, n_add, contexts, levels):
    def row():
        return (rng.choice(contexts), rng.randrange(levels) / levels, rng.randrange(levels) / levels)

    return {f"t{i}": row() for i in range(n_train)}, {f"a{i}": row() for i in range(n_add)}


# many equal targets, a context with fewer donors than additions, and short lists
CASES = [(40, 15, "ab", 4, 64), (60, 30, "aab", 1, 4), (25, 20, "abc", 3, 2), (50, 45, "ab", 30, 8)]


@pytest.mark.parametrize("ties", ["pair", "donor"])
@pytest.mark.parametrize("case", [0, 1, 2, 3])
def test_donors_equal_sequential_greedy(spark, case, ties, monkeypatch):
    monkeypatch.setattr(X, "PIECE", 3)
    n_train, n_add, contexts, levels, length = CASES[case]
    train, adds = fixture(random.Random(case), n_train, n_add, contexts, levels)
    schema = "seed bigint, trial_uid string, context string, target_valence double, target_arousal double"
    t = spark.createDataFrame([(7, k, *r) for k, r in train.items()], schema)
    a = spark.createDataFrame([(7, k, *r) for k, r in adds.items()], schema).selectExpr("*", "3 AS stimulus_dose")
    got = X.match_donors(t, a, list_length=length, ties=ties)
    got = {r.trial_uid: r.donor_uid for r in got.collect()}
    seed = 7 + 1009 * 3
    tie = (lambda uid, k: rank(seed, "donor", uid, k)) if ties == "pair" else (lambda uid, k: rank(7, "donor", k))
    assert got == greedy_donors(train, adds, seed, tie)


def test_pairs_of_a_crowded_point_stay_few(spark):
    """4,000 donors and 60 additions on four points: with ties by donor, pairs are additions x list length at most."""
    schema = "seed bigint, trial_uid string, context string, target_valence double, target_arousal double"
    t = spark.createDataFrame([(7, f"t{i}", "a", i % 2 / 1.0, i // 2 % 2 / 1.0) for i in range(4000)], schema)
    a = spark.createDataFrame([(7, f"a{i}", "a", 0.0, 0.0) for i in range(60)], schema).selectExpr("*", "3 AS stimulus_dose", "3034 AS dose_seed", "16 AS want")
    points = X._donor_points(t, ["seed", "context"], X.TARGETS, 16, "donor")
    assert points.agg({"n": "sum"}).first()[0] == 64
    got = X._candidates(a, points, ["seed", "context"], X.TARGETS, 16, "donor")
    want = sorted((f"t{i}" for i in range(0, 4000, 4)), key=lambda k: rank(7, "donor", k))[:16]
    rows = {(r["trial_uid"], r["choice"]): r["donor_uid"] for r in got.collect()}
    assert rows == {(f"a{i}", k + 1): w for i in range(60) for k, w in enumerate(want)}


def test_more_than_two_targets_are_refused(spark):
    t = spark.createDataFrame([], "seed bigint, trial_uid string, context string, a double, b double, c double")
    with pytest.raises(X.EvaluationError):
        X.match_donors(t, t.selectExpr("*", "3 AS stimulus_dose"), targets=["a", "b", "c"])


def greedy_cover(rows, seed):
    test = {u for u, (_, _, s) in rows.items() if s == "test"}
    need = {("p", rows[u][0]) for u in test} | {("s", rows[u][1]) for u in test}
    covers = {u: {("p", r[0]), ("s", r[1])} & need for u, r in rows.items() if u not in test}
    chosen, free = [], set(covers)
    while need:
        best = min(free, key=lambda u: (-len(covers[u] & need), rank(seed, u), u))
        chosen.append(best)
        free.discard(best)
        need -= covers[best]
    n = {s: sum(r[2] == s for r in rows.values()) for s in ("train", "validation")}
    rest = sorted(free, key=lambda u: (rank(seed, u), u))
    k = n["train"] - len(chosen)
    return {**{u: "test" for u in test}, **{u: "train" for u in chosen + rest[:k]}, **{u: "validation" for u in rest[k:k + n["validation"]]}}


@pytest.mark.parametrize("seed", [1, 2])
def test_cover_equals_sequential_greedy(spark, seed):
    rng = random.Random(seed)
    rows = {f"r{i}": (f"u{rng.randrange(9)}", f"k{rng.randrange(7)}", rng.choice(["train"] * 6 + ["validation", "test", "excluded"])) for i in range(120)}
    t = spark.createDataFrame([(u, r[0], r[1]) for u, r in rows.items()], "trial_uid string, subject_uid string, stimulus_uid string")
    ref = spark.createDataFrame([(u, r[2], seed) for u, r in rows.items()], "trial_uid string, split string, seed bigint")
    got = {r.trial_uid: r.split for r in X.support_matched_overlap(t, ref).collect()}
    assert got == greedy_cover(rows, seed)
