import numpy as np
import pytest
from pyspark.sql import functions as F

from heldout.operators import inference as I
from heldout.operators import multiplicity as M
from heldout.operators import resample as R


@pytest.fixture(scope="module")
def long(spark):
    rng = np.random.default_rng(1)
    rows = []
    for seed in range(2):
        for i in range(60):
            u, k, y = int(rng.integers(6)), int(rng.integers(5)), float(rng.normal())
            for p in ("a", "b"):
                for target in ("v", "w"):
                    rows.append((seed, f"t{seed}_{i}", f"u{seed}_{u}", f"k{k}", p, target, y, y + float(rng.normal())))
    return spark.createDataFrame(rows, "seed bigint, trial_uid string, subject_uid string, stimulus_uid string, predictor string, target string, y double, yhat double").cache()


def row_level(pdf, w):
    out = []
    for target in ("v", "w"):
        q = pdf[pdf.target == target]
        ww = q["w"].to_numpy()
        if ww.sum() == 0:
            return None
        y, x = q.y.to_numpy(), q.yhat.to_numpy()
        my, mx = np.average(y, weights=ww), np.average(x, weights=ww)
        den = np.average((y - my) ** 2, weights=ww) + np.average((x - mx) ** 2, weights=ww) + (mx - my) ** 2
        out.append(2 * np.average((y - my) * (x - mx), weights=ww) / den)
    return float(np.mean(out))


@pytest.mark.parametrize("partitions", [1, 5])
def test_draws_equal_row_level_weights(spark, long, partitions):
    sums = R.pair_table(long.repartition(partitions), ["predictor"], ["subject_uid", "stimulus_uid"])
    got = {(r.seed, r.draw, r.predictor): r.macro_ccc for r in R.crossed_bootstrap(sums, ["predictor"], draws=12, seed=3).collect()}
    ms = {c: {(r.draw, r[c]): r.m for r in R.shared_multiplicities(long, c, axis=c, draws=12, seed=3).collect()} for c in ("subject_uid", "stimulus_uid")}
    pdf = long.toPandas()
    for (seed, draw, p), value in got.items():
        q = pdf[(pdf.seed == seed) & (pdf.predictor == p)].copy()
        if draw:
            q["w"] = [ms["subject_uid"].get((draw, u), 0) * ms["stimulus_uid"].get((draw, k), 0) for u, k in zip(q.subject_uid, q.stimulus_uid)]
        else:
            q["w"] = 1
        want = row_level(q, q["w"])
        assert (value is None and want is None) or value == pytest.approx(want, abs=1e-12)
    assert len(got) == 2 * 13 * 2


def test_multiplicities(spark, long):
    m = R.shared_multiplicities(long, "subject_uid", axis="subject_uid", draws=50, seed=9)
    n = long.select("subject_uid").distinct().count()
    assert {r.s for r in m.groupBy("draw").agg(F.sum("m").alias("s")).collect()} == {n}
    p = R.shared_multiplicities(long, "subject_uid", axis="subject_uid", draws=2000, seed=9, method="poisson")
    mean = p.agg(F.sum("m")).first()[0] / (2000 * n)
    assert abs(mean - 1) < 0.03


def test_undefined_split_voids_the_draw(spark):
    rows = spark.createDataFrame([(1, 0, "a", 0.5, 0.1), (1, 1, "a", None, None)], "draw int, seed bigint, predictor string, macro_ccc double, macro_mae double")
    assert R.mean_over_splits(rows, ["predictor"], 2).first().macro_ccc is None


def test_band_and_interval_rules(spark):
    draws = spark.createDataFrame([(d, c, float(d * (c + 1)) if not (d == 3 and c == 1) else None) for d in range(5) for c in range(2)], "draw int, cell int, v double").withColumn("f", F.lit(1))
    assert I.simultaneous_band(draws, ["cell", "f"], ["f"], "v", 1.0).first().radius == 8.0
    ci = {r.cell: r for r in I.intervals(draws, ["cell"], "v").collect()}
    assert ci[0].valid_bootstrap == 4 and ci[1].valid_bootstrap == 3 and ci[0].estimate == 0.0
    wide = {m: {r.cell: r.ci_high - r.ci_low for r in I.intervals(draws, ["cell"], "v", method=m, df=d).collect()} for m, d in (("normal_t", 20), ("block_t", 4))}
    assert all(wide["block_t"][c] > wide["normal_t"][c] for c in (0, 1))


def test_sign_flip_limit(spark):
    ok = spark.createDataFrame([(1, 0.5), (1, 0.25), (1, 1.0)], "k int, v double")
    assert I.sign_flip_pvalue(ok, ["k"], "v").first().p_value == 0.25
    with pytest.raises(Exception, match="sign-flip"):
        I.sign_flip_pvalue(spark.range(21).selectExpr("1 AS k", "cast(id as double) AS v"), ["k"], "v").collect()


def test_complete_grid_is_required(long):
    table = long.selectExpr("'m' AS representation", "0 AS participant_dose", "0 AS stimulus_dose", "*")
    I.check_grid(table)
    with pytest.raises(ValueError, match="share"):
        I.check_grid(table.filter("not (predictor = 'b' and trial_uid = 't0_1')"))


def test_tree_splits_are_multinomial_and_the_same_everywhere():
    """Buckets of 8 among 45 identities: totals are exact in each draw, and no bucket needs another's work."""
    draws = np.array([1, 2, 5, 127, 128, 129, 300])
    parts = [M.Picker(3, leaf=8).counts("a", 45, b, draws) for b in range(6)]
    assert [len(p) for p in parts] == [8, 8, 8, 8, 8, 5]
    whole = np.concatenate(parts)
    assert (whole.sum(0) == 45).all() and len({tuple(c) for c in whole.T}) == len(draws)
    one = M.Picker(3, leaf=8)
    assert all((one.counts("a", 45, b, draws[4:5]) == parts[b][:, 4:5]).all() for b in (5, 0, 3))
    many = np.concatenate([one.counts("a", 45, b, np.arange(1, 4001)) for b in range(6)])
    assert abs(many.var(1).mean() - (1 - 1 / 45)) < 0.02 and np.abs(many.mean(1) - 1).max() < 0.1
    pairs = np.cov(many)
    assert abs(pairs[~np.eye(45, dtype=bool)].mean() + 1 / 45) < 0.003


def test_one_bucket_is_the_table_of_picks(spark, long):
    rows = {(r.draw, r.subject_uid): r.m for r in R.shared_multiplicities(long, "subject_uid", axis="subject_uid", draws=9, seed=4).collect()}
    index = R.ranked(long.select("subject_uid").distinct(), {"subject_uid": "subject_uid"}).collect()
    counts = M.Picker(4).counts("subject_uid", index[0]["_n0"], 0, np.arange(1, 10))
    assert {(d, r.subject_uid): int(counts[r["_r0"], d - 1]) for r in index for d in range(1, 10) if counts[r["_r0"], d - 1]} == rows


def test_draws_over_many_buckets(spark, long):
    """Weighted scores with buckets of two identities equal row-level weights from the same pickers."""
    sums = R.pair_table(long, ["predictor"], ["subject_uid", "stimulus_uid"])
    axes = {"subject_uid": "subject_uid", "stimulus_uid": "stimulus_uid"}
    index = R.ranked(sums.select(*axes).distinct(), axes).collect()
    picker, draws = M.Picker(3, leaf=2), np.arange(1, 7)
    weight = {}
    for r in index:
        m = [picker.weights(c, np.array([r[f"_r{i}"]]), np.array([r[f"_n{i}"]]), draws)[0] for i, c in enumerate(axes)]
        weight[r.subject_uid, r.stimulus_uid] = m[0] * m[1]
    rows = R.ranked(sums.filter("predictor = 'a' and target = 'v'"), axes).selectExpr(
        "seed AS _group", "_r0", "_n0", "_r1", "_n1", "array(0) AS _pos", "array(cast(sx as double)) AS _values")
    got = {}
    for r in M.weighted_sums(rows, axes=list(axes), width=1, seed=3, draws=draws, leaf=2).collect():
        got[r["_group"], r.draw] = got.get((r["_group"], r.draw), 0.0) + r.sums[0]
    want = {}
    for r in sums.filter("predictor = 'a' and target = 'v'").collect():
        for d in range(7):
            w = 1.0 if d == 0 else weight[r.subject_uid, r.stimulus_uid][d - 1]
            want[r.seed, d] = want.get((r.seed, d), 0.0) + w * r.sx
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)


def test_picks_beyond_one_bucket_are_the_table_of_picks(spark):
    """Over more than 1,024 identities the weighted sums still follow the picks that SQL repeats."""
    n, draws = 2500, 3
    ids = spark.range(n).selectExpr("concat('u', id) AS subject_uid", "cast(id % 7 as double) AS x")
    times = R.shared_multiplicities(ids, "subject_uid", axis="subject_uid", draws=draws, seed=5).join(ids, "subject_uid")
    want = {r.draw: r.s for r in times.groupBy("draw").agg(F.expr("sum(m * x)").alias("s")).collect()}
    rows = R.ranked(ids, {"subject_uid": "subject_uid"}).selectExpr("0L AS _group", "_r0", "_n0", "array(0) AS _pos", "array(x) AS _values")
    got = {}
    for r in M.weighted_sums(rows, axes=["subject_uid"], width=1, seed=5, draws=np.arange(1, draws + 1)).collect():
        got[r.draw] = got.get(r.draw, 0.0) + r.sums[0]
    assert got.pop(0) == sum(i % 7 for i in range(n)) and got == want


def test_spread_forms_equal_their_rows(spark, long, monkeypatch):
    """Forms over a grid give the draws of the rows they stand for, also where buckets are cut into pieces and values are null."""
    monkeypatch.setattr(M, "PIECE", 7)
    rows = long.filter("predictor = 'a' and target = 'v'").selectExpr("seed", "trial_uid", "subject_uid", "stimulus_uid", "if(trial_uid = 't0_3', null, y) AS y0", "yhat AS x0")
    forms = [("b", "w", "y0 * y0", "y0 - x0"), ("a", "v", "y0", "x0 * dose"), ("a", "w", "y0 * y0", "x0 + dose"), ("b", "v", "y0", "x0")]
    s = R.Spread(rows, {"kind": ["p", "q"], "dose": [1, 4]}, forms)
    cells = ["kind", "dose", "predictor"]
    whole = R.Spread(rows.fillna({"y0": 0.0}), s.grid, forms)
    table = R.pair_table(whole.long(["seed", "subject_uid", "stimulus_uid"]), cells, ["subject_uid", "stimulus_uid"])
    one, two = ({tuple(r[c] for c in ("seed", "draw", *cells)): (r.macro_ccc, r.macro_mae) for r in R.crossed_bootstrap(t, cells, draws=9, seed=3).collect()} for t in (table, whole))
    assert len(one) == 2 * 10 * 8 and one.keys() == two.keys()
    assert all(a == b or a == pytest.approx(b, abs=1e-9) for a, b in ((one[k], two[k]) for k in one))
    gaps = R.crossed_bootstrap(s, cells, draws=2, seed=3).filter("draw = 0 and seed = 0").first()
    assert gaps.weight == 60


def test_the_draw_table_checks_its_grid(spark, monkeypatch):
    """Added value stops on a repeated trial, on a truth that differs between cells and on numbers that aren't finite."""
    from dataclasses import replace

    from heldout.functions.checks import EvaluationError
    from heldout.plans import inference_queries as Q
    from heldout.plans.catalog import QUERIES

    rows = [(i % 2, f"t{i}", f"u{i % 5}", f"k{i % 3}", i / 10, i / 9) for i in range(30)]
    df = spark.createDataFrame([*rows, (0, "t99", None, "k1", None, None)], "seed bigint, trial_uid string, subject_uid string, stimulus_uid string, y double, x double")
    grid = {"representation": ("a",), "participant_dose": (0, 4), "stimulus_dose": (0, 4)}
    whole = R.Spread(df, grid, [("prior", "valence", "y", "x"), ("combined", "valence", "y", "x + participant_dose")])
    I.check_grid(whole)
    cases = {
        "duplicate trial": replace(whole, rows=df.unionByName(df.filter("trial_uid = 't3'"))),
        "share truth": replace(whole, forms=[("prior", "valence", "y", "x"), ("combined", "valence", "y + stimulus_dose", "x")]),
        "not finite": replace(whole, forms=[("prior", "valence", "y", "x"), ("combined", "valence", "y", "ln(x - 1)")]),
    }
    for message, case in cases.items():
        monkeypatch.setattr(Q, "spread", lambda *_, case=case: case)
        with pytest.raises(EvaluationError, match=message):
            QUERIES["added_value_analysis"](spark, None)
