"""Moment-based models against direct NumPy fits on small fixtures."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from heldout.operators import decomposition as D
from heldout.operators import exposure as X
from heldout.operators import gram as G
from heldout.operators import metrics as M
from heldout.operators import probes as B
from heldout.operators import readout as R
from heldout.operators import semantics as S
from heldout.operators import splits as SP

K = 5


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(7)
    n = 300
    g = rng.integers(0, 12, n)
    u = rng.integers(0, 9, n)
    x = rng.normal(size=(n, K)) + 100 + 0.8 * np.eye(12, K)[g] + 0.5 * np.eye(9, K)[u]
    y = np.stack([x[:, 0] * 0.3 + g / 12, x[:, 1] - x[:, 2] * 0.2], 1) + rng.normal(size=(n, 2)) * 0.3
    split = np.array(["train"] * 200 + ["validation"] * 40 + ["test"] * 60)
    rows = [(f"t{i:03d}", f"k{g[i]}", f"u{u[i]}", split[i], x[i].tolist(), y[i].tolist(), *map(float, y[i])) for i in range(n)]
    df = spark.createDataFrame(rows, "trial_uid string, stimulus_uid string, subject_uid string, split string, features array<double>, y array<double>, target_valence double, target_arousal double")
    return df.cache(), x, y, g, u, split


def standard(x):
    mu, sd = x.mean(0), x.std(0)
    return mu, np.where(sd < 1e-12, 1.0, sd)


def direct_ridge(x, y, r, alpha):
    mu, sd = standard(x)
    z, zr, ym = (x - mu) / sd, (r - mu) / sd, y.mean(0)
    return ym + zr @ np.linalg.solve(z.T @ z + alpha * np.eye(z.shape[1]), z.T @ (y - ym))


def one(df, y="y"):
    df = df.selectExpr("*", "'all' AS one")
    shift = G.feature_shift(df)
    return G.moments(df, "one", y, shift=shift)["all"], df, shift


@pytest.mark.parametrize("partitions", [1, 7])
def test_ridge_and_algebra(data, partitions):
    df, x, y, *_ , split = data
    tr, te = split == "train", split == "test"
    m, keyed, shift = one(df.filter("split = 'train'").repartition(partitions))
    w, b = G.ridge(m, 3.0)
    assert np.allclose(x[te] @ w + b, direct_ridge(x[tr], y[tr], x[te], 3.0), atol=1e-9)
    half = G.moments(df.filter("split = 'train' and stimulus_uid < 'k2'").selectExpr("*", "'all' AS one"), "one", "y", shift=shift)["all"]
    rest = m - half
    keep = np.array([f"k{v}" >= "k2" for v in data[3]]) & tr
    w, b = G.ridge(rest, 1.0)
    assert np.allclose(x[te] @ w + b, direct_ridge(x[keep], y[keep], x[te], 1.0), atol=1e-9)


def test_conditional_and_projectors(data):
    df, x, y, g, u, split = data
    tr, te = split == "train", split == "test"
    m, keyed, shift = one(df.filter("split = 'train'"))
    groups = G.group_sums(keyed, "one", "stimulus_uid", "y", shift=shift)
    mu, sd = standard(x[tr])
    z, zt, yc = (x[tr] - mu) / sd, (x[te] - mu) / sd, y[tr] - y[tr].mean(0)
    ind = np.stack([g[tr] == v for v in np.unique(g[tr])], 1).astype(float)
    ind = (ind - ind.mean(0)) / ind.std(0)
    ng = z.T @ ind @ ind.T @ z / len(z)
    w, b = G.conditional_ridge(m, 2.0, 0.5, G.nuisance_gram(groups, {"all": m}, K, 2)["all"])
    want = y[tr].mean(0) + zt @ np.linalg.solve(z.T @ z + 2 * np.eye(K) + 0.5 * ng, z.T @ yc)
    assert np.allclose(x[te] @ w + b, want, atol=1e-9)
    cent = np.stack([np.sqrt((g[tr] == v).sum()) * z[g[tr] == v].mean(0) for v in np.unique(g[tr])])
    cg = G.centroid_gram(groups, {"all": m}, K, 2)["all"]
    right = np.linalg.svd(cent, full_matrices=False)[2]
    d = G.identity_directions(cg)[:, :2]
    assert np.allclose(d @ d.T, right[:2].T @ right[:2], atol=1e-7)
    q = np.linalg.svd((z.T @ yc).T, full_matrices=False)[2].T
    right = np.linalg.svd(cent - (cent @ q) @ q.T, full_matrices=False)[2]
    d = G.response_preserving_directions(m, cg)
    assert d.shape[1] == K - 2
    assert np.allclose(d[:, :2] @ d[:, :2].T, right[:2].T @ right[:2], atol=1e-6)
    p = np.eye(K) - d[:, :2] @ d[:, :2].T
    w, b = G.projected_ridge(m, d[:, :2], 1.5)
    assert np.allclose(x[te] @ w + b, direct_ridge(z @ p, y[tr], zt @ p, 1.5), atol=1e-8)
    rows = G.project_features(df.filter("split = 'test'").select("trial_uid", "features"), m, d[:, :2]).orderBy("trial_uid").collect()
    assert np.allclose(np.array([r.features for r in rows]), zt @ p, atol=1e-8)
    pca = G.pca_directions(m)[:, :1]
    first = np.linalg.svd(z, full_matrices=False)[2][:1]
    assert np.allclose(pca @ pca.T, first.T @ first, atol=1e-8)


def balanced(x, label, r, alpha):
    classes = sorted(set(label))
    mu, sd = standard(x)
    z, zr = np.c_[(x - mu) / sd, np.ones(len(x))], np.c_[(r - mu) / sd, np.ones(len(r))]
    count = {c: (label == c).sum() for c in classes}
    w = np.array([len(label) / (len(classes) * count[c]) for c in label])
    t = np.where(label[:, None] == np.array(classes)[None], 1.0, -1.0)
    pen = np.diag([alpha] * x.shape[1] + [0.0])
    coef = np.linalg.solve(z.T @ (z * w[:, None]) + pen, z.T @ (t * w[:, None]))
    return np.array(classes)[np.argmax(zr @ coef, 1)]


@pytest.mark.parametrize("values", [None, 20])
def test_probes(data, values, monkeypatch):
    """In one block of classes and in many."""
    if values:
        monkeypatch.setattr(B, "BLOCK_VALUES", values)
        monkeypatch.setattr(B, "PASSES", 2)
    df, x, y, g, u, split = data
    label = np.array([f"u{v}" for v in u])
    fit, te = split != "test", split == "test"
    guess = balanced(x[fit], label[fit], x[te], 1.0)
    truth = label[te]
    want = np.mean([(guess[truth == c] == c).mean() for c in sorted(set(truth))])
    got = {r.labels: r for r in B.ridge_probe(df, "subject_uid").collect()}
    assert got["observed"].balanced_accuracy == pytest.approx(want, abs=1e-12)
    assert got["permuted"].covered_trials == te.sum()
    alphas = (0.1, 10.0, 1000.0)
    tr, va = split == "train", split == "validation"

    def acc(a):
        p = balanced(x[tr], label[tr], x[va], a)
        return np.mean([(p[label[va] == c] == c).mean() for c in sorted(set(label[va]))])

    best = max(alphas, key=lambda a: (acc(a), -a))
    assert B.tuned_probe(df, "subject_uid", alphas=alphas).first().selected_alpha == best
    mu, sd = standard(x[tr])
    z, zt = (x[tr] - mu) / sd, (x[te] - mu) / sd
    ids = sorted(set(label[tr]) & set(truth))
    c = np.stack([z[label[tr] == i].mean(0) for i in ids])
    near = np.array(ids)[((zt[:, None] - c[None]) ** 2).mean(2).argmin(1)]
    want = np.mean([(near[truth == i] == i).mean() for i in ids])
    got = {r.labels: r for r in B.nearest_centroid_probe(df.filter("split = 'train'"), df.filter("split = 'test'"), "subject_uid").collect()}
    assert got["observed"].balanced_accuracy == pytest.approx(want, abs=1e-12)


def loo(y, g):
    out = np.empty_like(y)
    for i in range(len(y)):
        same = (g == g[i]) & (np.arange(len(y)) != i)
        out[i] = y[same].mean(0) if same.any() else np.delete(y, i, 0).mean(0)
    return out


def test_condition_models(data):
    df, x, y, g, u, split = data
    tr, va, te = (split == s for s in ("train", "validation", "test"))
    pri = lambda a, b: np.stack([y[a & (g == v)].mean(0) if (a & (g == v)).any() else y[a].mean(0) for v in g[b]])
    alphas = (0.1, 10.0)
    res = min(alphas, key=lambda a: np.abs(pri(tr, va) + direct_ridge(x[tr], y[tr] - pri(tr, tr), x[va], a) - y[va]).mean())
    fit = tr | va
    want = pri(fit, te) + direct_ridge(x[fit], y[fit] - pri(fit, fit), x[te], res)
    out, _ = R.condition_models(df, group="stimulus_uid", alphas=alphas)
    got = out.orderBy("trial_uid").collect()
    assert np.allclose([[r.prior_plus_eeg_residual_valence, r.prior_plus_eeg_residual_arousal] for r in got], want, atol=1e-8)


def test_additive_r2(data):
    df, x, y, g, u, split = data
    design = lambda *f: np.concatenate([np.ones((len(g), 1)), *[np.eye(v.max() + 1)[v][:, 1:] for v in f]], 1)
    r2 = lambda d: 1 - np.sum((y[:, 0] - d @ np.linalg.lstsq(d, y[:, 0], rcond=None)[0]) ** 2) / np.sum((y[:, 0] - y[:, 0].mean()) ** 2)
    got = M.additive_r2(df, "target_valence").first()
    assert got.first_only == pytest.approx(r2(design(u)), abs=1e-9)
    assert got.second_only == pytest.approx(r2(design(g)), abs=1e-9)
    assert got.both == pytest.approx(r2(design(u, g)), abs=1e-7)


def test_additive_effects_of_sparse_cells(spark):
    """A thin bipartite chain, where alternating means crawl: the normal equations hold to many digits."""
    rng = np.random.default_rng(5)
    rows = [(f"u{i}", f"k{(i + j) % 60}", float(rng.normal() + i / 10)) for i in range(60) for j in (0, 1)] + [("lone", "own", 3.0)]
    df = spark.createDataFrame(rows, "subject_uid string, stimulus_uid string, y double")
    cells = df.selectExpr("subject_uid", "stimulus_uid", "1D AS n", "y AS s")
    mean = float(np.mean([r[2] for r in rows]))
    a, b = M.additive_effects(cells, mean, "subject_uid", "stimulus_uid")
    a, b = ({r[0]: r[1] for r in t.collect()} for t in (a, b))
    for side in (0, 1):
        sums = {}
        for r in rows:
            sums[r[side]] = sums.get(r[side], 0.0) + r[2] - mean - a[r[0]] - b[r[1]]
        assert max(map(abs, sums.values())) < 1e-9


def test_nuisance_removal(data):
    df, x, y, g, u, split = data
    tr, te = split == "train", split == "test"
    test = df.filter("split = 'test'").selectExpr("trial_uid", "stimulus_uid", "features", "array_repeat(0D, 5) AS fb")
    a, b = D.remove_group_nuisance(df.filter("split = 'train'").select("trial_uid", "stimulus_uid", "features"), test, "stimulus_uid", fallback="fb", strengths=[0.5])
    got = np.array([r.features for r in a.orderBy("trial_uid").collect()])
    assert np.allclose(got, x[tr] - 0.5 * loo(x[tr], g[tr]), atol=1e-9)
    want = x[te] - 0.5 * np.stack([x[tr & (g == v)].mean(0) if (tr & (g == v)).any() else np.zeros(K) for v in g[te]])
    assert np.allclose([r.features for r in b.orderBy("trial_uid").collect()], want, atol=1e-9)


def test_semantic_vectors(spark):
    docs = [("s1", "The cat sat", "x"), ("s2", "the CAT and the dog", "y"), ("s3", "a bird", "x")]
    df = spark.createDataFrame(docs, "stimulus_uid string, text string, cat string")
    got = {r.stimulus_uid: r.features for r in S.semantic_vectors(df, df.filter("stimulus_uid <> 's3'"), categories=["cat"], size=4).collect()}
    terms = {"s1": ["the", "cat", "sat", "the cat", "cat sat"], "s2": ["the", "cat", "and", "the", "dog", "the cat", "cat and", "and the", "the dog"]}
    tf = {t: sum(d.count(t) for d in terms.values()) for d in terms.values() for t in d}
    vocab = sorted(sorted(tf, key=lambda t: (-tf[t], t))[:4])
    idf = {t: np.log(3 / (1 + sum(t in d for d in terms.values()))) + 1 for t in vocab}
    for s, onehot in (("s1", [1, 0]), ("s2", [0, 1])):
        v = np.array([(1 + np.log(terms[s].count(t))) * idf[t] if t in terms[s] else 0.0 for t in vocab])
        assert np.allclose(got[s], [*onehot, *(v / np.linalg.norm(v))])
    assert got["s3"] == [1, 0, 0, 0, 0, 0]


def test_sparse_prior_against_dense_ridge(spark):
    """Many categories, a null one, one unseen in train, terms: the sparse solve equals the direct one on dense one-hot rows."""
    rng = np.random.default_rng(11)
    words = [f"w{chr(97 + i)}{chr(97 + j)}" for i in range(5) for j in range(6)]
    rows = []
    for i in range(160):
        split = ("train", "train", "train", "validation", "test")[i % 5]
        group = None if i % 31 == 0 else "only_test" if i == 4 else f"g{int(rng.integers(40))}"
        text = None if i % 37 == 1 else " ".join(rng.choice(words, int(rng.integers(0, 9))))
        for k in range(1 + i % 2):
            rows.append((f"t{i}_{k}", f"s{i}", split, group, f"c{i % 3}", text, [float(v) for v in rng.normal(size=2)]))
    df = spark.createDataFrame(rows, "trial_uid string, stimulus_uid string, split string, g string, c string, text string, y array<double>")
    alphas = (0.1, 1.0, 10.0)
    out, tuned, scores = S.semantic_prior(df, categories=["c", "g"], alphas=alphas, size=50)
    out, tuned = ({r.trial_uid: r.prediction for r in x.collect()} for x in (out, tuned))

    def dense(fit_splits, alpha):
        stim = {r[1]: r for r in rows}
        fit = [s for s in stim if stim[s][2] in fit_splits]
        frame = spark.createDataFrame([(s, r[3], r[4], r[5]) for s, r in stim.items()], "stimulus_uid string, g string, c string, text string")
        x = {r.stimulus_uid: np.array(r.features) for r in S.semantic_vectors(frame, frame.filter(F.col("stimulus_uid").isin(fit)), categories=["g", "c"], size=50).collect()}
        a = np.array([x[s] for s in fit])
        b = np.array([np.mean([r[6] for r in rows if r[1] == s], 0) for s in fit])
        ac = a - a.mean(0)
        w = np.linalg.solve(ac.T @ ac + alpha * np.eye(a.shape[1]), ac.T @ (b - b.mean(0)))
        return lambda s: b.mean(0) + (x[s] - a.mean(0)) @ w

    held = [r for r in rows if r[2] == "validation"]
    for (alpha, error) in scores:
        model = dense(("train",), alpha)
        assert error == pytest.approx(np.mean([np.abs(model(r[1]) - r[6]).mean() for r in held]), abs=1e-9)
    best = min(scores, key=lambda x: x[1])[0]
    model = dense(("train",), best)
    assert set(tuned) == {r[0] for r in held} and all(np.allclose(tuned[r[0]], model(r[1]), atol=1e-9) for r in held)
    model = dense(("train", "validation"), best)
    wanted = [r for r in rows if r[2] == "test"]
    assert set(out) == {r[0] for r in wanted} and all(np.allclose(out[r[0]], model(r[1]), atol=1e-9) for r in wanted)


def test_sparse_products_in_blocks(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(50, 11)) * (rng.random((50, 11)) < 0.4)
    y = rng.normal(size=(50, 3))
    df = spark.createDataFrame([([int(i) for i in np.flatnonzero(r)], [float(v) for v in r[r != 0]], [float(v) for v in t]) for r, t in zip(x, y)], "at array<int>, w array<double>, y array<double>")
    for (xx, xy), f in zip(S.sparse_products(df.repartition(3), 11, 3, lambda at, w: np.array([1.0, len(at)]), 2, block=4), (np.ones(50), (x != 0).sum(1))):
        assert np.allclose(xx, x.T @ (x * f[:, None])) and np.allclose(xy, x.T @ (y * f[:, None]))


@pytest.mark.parametrize("name", ["semantic_nuisance", "decomposition_benchmark", "subspace_curve"])
def test_semantic_queries_read_the_text(spark, tmp_path, name):
    """Documents that differ only in their text: the answers follow it."""
    from heldout.plans.catalog import QUERIES

    rng = np.random.default_rng(7)
    vectors = [(i, [float(v) for v in rng.normal(size=64)]) for i in range(30)]
    answers = []
    for word in ("short", "i"):
        d = str(tmp_path / word)
        rows = [(i, f"text {'long words here' if i % 3 else word} topic{i % 7}", "en", "web", 100 + 70 * (i % 7)) for i in range(150)]
        spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{d}/documents.parquet")
        spark.createDataFrame(vectors, "vec_id bigint, embedding array<float>").write.parquet(f"{d}/embeddings.parquet")
        answers.append(sorted(map(repr, QUERIES[name](spark, d).collect())))
    assert answers[0] and answers[0] != answers[1]


def test_cells_against_direct_fits(spark, data):
    """One exposure cell end to end against row-level NumPy, and the grid's invariants."""
    from heldout.sources import views as V

    d = "/root/testdata/sf0.001"
    t = V.trials(spark, d)
    f = V.features(spark, d).cache()
    strict = SP.double_holdout(t).cache()
    doses = (0, 2)
    marks = X.cell_marks(t, strict, p_doses=doses, s_doses=doses).cache()
    cells = X.expand_cells(marks, p_doses=doses, s_doses=doses)
    audit = X.cell_audit(cells).collect()
    assert len({(r.train_rows, r.test_rows) for r in audit}) == 1 and all(r.train_size_preserved for r in audit)
    alphas = (1.0, 100.0)
    pred, _ = R.evaluate_cells(t, strict, f, p_doses=doses, s_doses=doses, alphas=alphas, marks=marks)
    pred = pred.toPandas()
    zero = pred[pred.participant_dose == 0]
    assert np.array_equal(zero.prior_valence, zero.prior_personalized_valence)
    a = cells.filter("participant_dose = 2 and stimulus_dose = 2").join(t, "trial_uid").join(f, "trial_uid").toPandas()
    part = {s: a[a.split == s] for s in ("train", "validation", "calibration", "test")}
    xs = {s: np.stack(p.features) for s, p in part.items()}
    ys = {s: p[["target_valence", "target_arousal"]].to_numpy() for s, p in part.items()}
    gs = {s: p.stimulus_uid.to_numpy() for s, p in part.items()}

    def singles_global(y, g):
        out = np.repeat(y.mean(0)[None], len(y), 0)
        for v in set(g):
            k = g == v
            if k.sum() > 1:
                out[k] = (y[k].sum(0) - y[k]) / (k.sum() - 1)
        return out

    def prior(y, g, r):
        return np.stack([y[g == v].mean(0) if (g == v).any() else y.mean(0) for v in r])

    fx, fy, fg = (np.concatenate([q["train"], q["validation"]]) for q in (xs, ys, gs))
    alpha = min(alphas, key=lambda al: np.abs(
        ys["validation"] - prior(ys["train"], gs["train"], gs["validation"]) - direct_ridge(xs["train"], ys["train"] - singles_global(ys["train"], gs["train"]), xs["validation"], al)
    ).mean())
    both = np.concatenate([xs["test"], xs["calibration"]])
    c = prior(fy, fg, np.concatenate([gs["test"], gs["calibration"]])) + direct_ridge(fx, fy - singles_global(fy, fg), both, alpha)
    n = len(xs["test"])
    resid = ys["calibration"] - c[n:]
    sub = part["calibration"].subject_uid.to_numpy()
    want = c[:n] + np.stack([resid[sub == v].mean(0) for v in part["test"].subject_uid])
    got = pred[(pred.participant_dose == 2) & (pred.stimulus_dose == 2)].set_index("trial_uid").loc[part["test"].trial_uid]
    assert np.allclose(got[["combined_personalized_valence", "combined_personalized_arousal"]].to_numpy(), want, atol=1e-8)


@pytest.mark.parametrize("k, block, rows", [(37, 8, 90), (4096, 512, 60)])
def test_wide_models_meet_in_blocks(spark, k, block, rows):
    """No row holds more than a block's products, and the sums and the fit equal NumPy's."""
    rng = np.random.default_rng(k)
    x, y = rng.normal(size=(rows, k)) + 3, rng.normal(size=(rows, 2))
    df = spark.createDataFrame([(str(i % 2), a.tolist(), b.tolist()) for i, (a, b) in enumerate(zip(x, y))], "key string, features array<double>, y array<double>").repartition(3)
    shift = np.full(k, 2.5)
    sums = G.moment_sums(df, "key", "y", shift=shift, block=block).selectExpr("key", "part", "size(stats) AS n").collect()
    assert max(r.n for r in sums) <= max(block * block, 3 + 3 * k) and len(sums) == 2 * (1 + -(-k // block) * (-(-k // block) + 1) // 2)
    m = G.moments(df, "key", "y", shift=shift, block=block)
    for name in ("0", "1"):
        a, b = x[int(name)::2] - shift, y[int(name)::2]
        assert np.allclose(m[name].xx, a.T @ a) and np.allclose(m[name].xy, a.T @ b) and np.allclose(m[name].sx, a.sum(0)) and m[name].n == len(a)
    if k < 100:
        w, c = G.ridge(m["0"], 2.0)
        a, b = x[::2], y[::2]
        z = (a - a.mean(0)) / a.std(0)
        want = z @ np.linalg.solve(z.T @ z + 2.0 * np.eye(k), z.T @ (b - b.mean(0))) + b.mean(0)
        assert np.allclose(a @ w + c, want)
