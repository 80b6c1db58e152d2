"""Readouts tuned on validation rows and evaluated over whole grids."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heldout.functions.checks import EvaluationError
from heldout.functions.joins import attach_groups
from heldout.functions.materialize import materialize
from heldout.operators import exposure as X
from heldout.operators import gram as G
from heldout.operators import metrics as M
from heldout.operators import priors as P

ALPHAS = (0.01, 0.1, 1.0, 10.0, 100.0, 1000.0)
TARGETS = ("target_valence", "target_arousal")
PREDICTORS = ("prior", "prior_personalized", "eeg_population", "eeg_personalized", "combined_population", "combined_personalized")


def best(scores: Sequence[float], order: Sequence) -> int:
    """Index of the lowest score; ties go to the smaller value of ``order``."""
    return min(range(len(scores)), key=lambda i: (scores[i], order[i]))


def _array(columns: Sequence[str]) -> str:
    return f"array({', '.join(columns)})"


def tuned_ridge(rows: DataFrame, *, key: str, alphas: Sequence[float] = ALPHAS, targets: Sequence[str] = TARGETS, fit=G.ridge) -> tuple[DataFrame, DataFrame]:
    """Direct ridge per key: alpha by validation MAE, refit on train and validation, test predictions.

    ``rows`` holds ``key, split, trial_uid, features`` and the targets.  Returns
    test rows with ``prediction`` and the table of validation scores.
    """
    rows = materialize(rows.selectExpr("*", f"{_array(targets)} AS _y", f"concat({key}, '|', split) AS _part"))
    m = G.moments(rows.filter("split in ('train', 'validation')"), "_part", "_y")
    keys = sorted({k.rsplit("|", 1)[0] for k in m})
    train = {k: m[f"{k}|train"] for k in keys}
    models = {k: G.stack([fit(train[k], a) for a in alphas]) for k in keys}
    held = rows.filter("split = 'validation'").withColumn("_none", F.expr("cast(array() as array<double>)"))
    errors = G.validation_errors(held, models, key, y="_y", offset="_none", targets=len(targets))
    chosen = {k: alphas[best(errors[k], alphas)] for k in keys}
    final = {k: fit(train[k] + m[f"{k}|validation"], chosen[k]) for k in keys}
    out = G.append_predictions(rows.filter("split = 'test'").drop("_y", "_part"), final, key)
    table = [(k, float(a), float(e), a == chosen[k]) for k in keys for a, e in zip(alphas, errors[k])]
    return out, rows.sparkSession.createDataFrame(table, f"{key} string, alpha double, validation_mae double, selected boolean")


def seed_regression(rows: DataFrame, *, key: str = "seed", alphas: Sequence[float] = ALPHAS) -> tuple[DataFrame, DataFrame]:
    """Tuned ridge per (protocol, seed) with test metrics."""
    predicted, scores = tuned_ridge(rows, key=key, alphas=alphas)
    long = predicted.selectExpr(key, *[f"{t} AS {t}" for t in TARGETS], "prediction[0] AS p_valence", "prediction[1] AS p_arousal")
    return M.regression_metrics(M.long_predictions(long, ["p"], keep=[key]), [key]), scores


def condition_models(rows: DataFrame, *, group: str, alphas: Sequence[float] = ALPHAS, targets: Sequence[str] = TARGETS) -> tuple[DataFrame, DataFrame]:
    """Global mean, condition prior, direct ridge and prior plus residual ridge on one assignment."""
    names = [P.short(t) for t in targets]
    inside = {"sel": "split = 'train'", "fit": "split in ('train', 'validation')"}
    for phase, cond in inside.items():
        fit = rows.filter(cond)
        rows = P.group_mean_prior(fit, rows, group, targets).withColumnsRenamed({f"prior_{n}": f"{phase}_{n}" for n in names})
    rows = materialize(rows.selectExpr(
        "*", f"{_array(targets)} AS _y", f"{_array([f'sel_{n}' for n in names])} AS prior_sel", f"{_array([f'fit_{n}' for n in names])} AS prior_fit",
        "'all' AS one",
    ).selectExpr("*", "zip_with(_y, prior_sel, (a, b) -> a - b) AS r_sel", "zip_with(_y, prior_fit, (a, b) -> a - b) AS r_fit"))
    t = len(targets)
    both = rows.selectExpr("*", "concat(_y, r_sel, r_fit) AS _all")
    shift = G.feature_shift(both)
    m = G.moments(both.filter(inside["fit"]), "split", "_all", shift=shift)

    def part(mm, lo):
        return G.Moments(mm.n, mm.sx, mm.sy[lo:lo + t], mm.xx, mm.xy[:, lo:lo + t], mm.shift)

    fit = m["train"] + m["validation"]
    held = rows.filter("split = 'validation'").withColumn("_none", F.expr("cast(array() as array<double>)"))
    chosen, scores = {}, []
    for name, lo, offset in (("eeg_only", 0, "_none"), ("prior_plus_eeg_residual", t, "prior_sel")):
        models = {"all": G.stack([G.ridge(part(m["train"], lo), a) for a in alphas])}
        e = G.validation_errors(held, models, "one", y="_y", offset=offset, targets=t)["all"]
        chosen[name] = alphas[best(e, range(len(e)))]
        scores += [(name, float(a), float(v)) for a, v in zip(alphas, e)]
    final = {"all": G.stack([G.ridge(part(fit, 0), chosen["eeg_only"]), G.ridge(part(fit, 2 * t), chosen["prior_plus_eeg_residual"])])}
    out = G.append_predictions(rows.filter("split = 'test'"), final, "one")
    mean = fit.sy[:t] / fit.n
    columns = [f"{float(mean[i])!r}D AS global_mean_{n}" for i, n in enumerate(names)]
    columns += [f"fit_{n} AS condition_prior_{n}" for n in names]
    columns += [f"prediction[{i}] AS eeg_only_{n}" for i, n in enumerate(names)]
    columns += [f"fit_{n} + prediction[{t + i}] AS prior_plus_eeg_residual_{n}" for i, n in enumerate(names)]
    table = rows.sparkSession.createDataFrame(scores, "model string, alpha double, validation_mae double")
    return out.selectExpr("trial_uid", *targets, *columns), table


def evaluate_cells(
    trials: DataFrame, strict: DataFrame, features: DataFrame, *, p_doses: Sequence[int], s_doses: Sequence[int], alphas: Sequence[float] = ALPHAS,
    targets: Sequence[str] = TARGETS, validate: bool = True, marks: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Six predictors on the fixed test support of every (seed, p, s) cell.

    Fits depend on (seed, s) only: train moments are base minus donors plus
    exposures.  The residual target's products with the features come from
    per-stimulus sums, so leave-one-out priors need no further scan.  The
    participant dose only changes the calibration offsets.  Returns predictions
    and the table of validation scores.
    """
    names = [P.short(t) for t in targets]
    t = len(targets)
    doses = sorted(int(s) for s in s_doses)
    if marks is None:
        marks = X.cell_marks(trials, strict, p_doses=p_doses, s_doses=s_doses, targets=targets, validate=validate)
    labels = (
        "concat(if(split = 'train', array('b'), array()), transform(donor_doses, d -> concat('d', d)), if(split = 'validation', array('v'), array()), "
        f"transform(filter(array({', '.join(str(s) for s in doses)}), s -> exp_rank <= s), s -> concat('e', s)))"
    )
    published = [f"stimulus_prior_{n}" for n in names]
    has_prior = set(published) <= set(trials.columns)
    used = marks.filter("in_test or cal_rank is not null or exp_rank is not null or split in ('train', 'validation')")
    if has_prior:
        used = used.join(trials.select("trial_uid", *published), "trial_uid")
        ok = " and ".join(f"{c} is not null and not isnan({c})" for c in published)
        extra = f"if({ok}, array({', '.join(published)}, 1D), array_repeat(0D, {t + 1}))"
    else:
        extra = f"array_repeat(0D, {t + 1})"
    rows = materialize(
        used.join(features.select("trial_uid", "features"), "trial_uid").selectExpr(
            "cast(seed as string) AS seed", "trial_uid", "subject_uid", "stimulus_uid", *targets, "split", "in_test", "cal_rank", "features",
            f"{labels} AS labels", f"{_array(targets)} AS y", f"{extra} AS published",
        )
    )
    fit_rows = rows.selectExpr("seed", "stimulus_uid", "features", "concat(y, published) AS y", "explode(labels) AS label").selectExpr(
        "concat(seed, '|', label) AS part", "*"
    )
    shift = G.feature_shift(rows)
    k = len(shift)
    wide = G.moments(fit_rows, "part", "y", shift=shift)
    zero = G.Moments(0.0, np.zeros(k), np.zeros(2 * t + 1), np.zeros((k, k)), np.zeros((k, 2 * t + 1)), shift)
    seeds = sorted({key.split("|")[0] for key in wide})

    def get(seed, label):
        return wide.get(f"{seed}|{label}", zero)

    sets = {}
    for seed in seeds:
        for s in doses:
            m = get(seed, "b") - get(seed, f"d{s}") + get(seed, f"e{s}")
            full = m + get(seed, "v")
            for phase, mm in (("sel", m), ("fit", full)):
                if mm.n < 2:
                    raise EvaluationError("train and validation need at least two rows")
                sets[(seed, s, phase)] = G.Moments(mm.n, mm.sx, mm.sy[:t], mm.xx, mm.xy[:, :t], shift)
    sums = materialize(G.group_sums(fit_rows, "part", "stimulus_uid", "y", shift=shift))
    per_label = sums.selectExpr("split_part(key, '|', 1) AS seed", "split_part(key, '|', 2) AS label", "grp AS stimulus_uid", "stats")
    signs = [("b", 1.0, s, ph) for s in doses for ph in ("sel", "fit")] + [("v", 1.0, s, "fit") for s in doses]
    signs += [(f"d{s}", -1.0, s, ph) for s in doses for ph in ("sel", "fit")] + [(f"e{s}", 1.0, s, ph) for s in doses for ph in ("sel", "fit")]
    sign = rows.sparkSession.createDataFrame(signs, "label string, sign double, s int, phase string")
    signed = per_label.join(F.broadcast(sign), "label").selectExpr(
        "concat_ws('|', seed, s, phase) AS key", "stimulus_uid AS grp", "transform(stats, x -> sign * x) AS stats"
    )
    by_set = materialize(G.sum_arrays(signed, ["key", "grp"]))
    fallback = {f"{seed}|{s}|{ph}": m.sy / m.n for (seed, s, ph), m in sets.items()}

    def fold(key, stats):
        """Sums of the leave-one-out priors and of their products with the features."""
        n, sy, sx, sxy = G.unpack_group(stats, k, 2 * t + 1)
        many, single = n > 1.5, (n > 0.5) & (n < 1.5)
        y, xy = sy[:, :t], sxy[:, :, :t]
        total, cross = y[many].sum(0), np.zeros((k, t))
        if many.any():
            cross += ((sx[many][:, :, None] * y[many][:, None, :] - xy[many]) / (n[many] - 1)[:, None, None]).sum(0)
        if single.any():
            f = np.where(sy[single][:, 2 * t:] > 0.5, sy[single][:, t:2 * t], fallback[key])
            total, cross = total + f.sum(0), cross + sx[single].T @ f
        return np.concatenate([total, cross.ravel()])

    prior_sums = G.fold_groups(by_set, fold)
    residual = {}
    for (seed, s, ph), m in sets.items():
        v = prior_sums[f"{seed}|{s}|{ph}"]
        residual[(seed, s, ph)] = G.Moments(m.n, m.sx, m.sy - v[:t], m.xx, m.xy - v[t:].reshape(k, t), shift)
    # prior of every stimulus in every fit set, one row per (seed, stimulus)
    means = by_set.filter("stats[0] > 0.5").selectExpr(
        "split_part(key, '|', 1) AS seed", "concat(split_part(key, '|', 2), split_part(key, '|', 3)) AS slot", "grp AS stimulus_uid",
        f"transform(slice(stats, 2, {t}), x -> x / stats[0]) AS mean",
    ).groupBy("seed", "stimulus_uid").agg(F.map_from_entries(F.collect_list(F.struct("slot", "mean"))).alias("priors"))
    rows = attach_groups(rows, means, ["seed", "stimulus_uid"])
    fb = "map(" + ", ".join(
        f"'{seed}|{s}{ph}', array({', '.join(f'{float(x)!r}D' for x in fallback[f'{seed}|{s}|{ph}'])})" for (seed, s, ph) in sets
    ) + ")"

    def prior(s, ph):
        missing = f"element_at({fb}, concat(seed, '|{s}{ph}'))"
        if has_prior:
            missing = f"if(published[{t}] > 0.5, slice(published, 1, {t}), {missing})"
        return f"coalesce(priors['{s}{ph}'], {missing})"

    held = rows.filter("split = 'validation'").selectExpr(
        "seed", "features", "y",
        "concat(" + ", ".join(
            ", ".join([f"array_repeat(0D, {t * len(alphas)})"] + [prior(s, "sel")] * len(alphas)) for s in doses
        ) + ") AS offsets",
    )
    models = {
        seed: G.stack([G.ridge(table[(seed, s, "sel")], a) for s in doses for table in (sets, residual) for a in alphas]) for seed in seeds
    }
    errors = G.validation_errors(held, models, "seed", y="y", offset="offsets", targets=t)
    chosen, scores = {}, []
    for seed in seeds:
        e = errors[seed].reshape(len(doses), 2, len(alphas))
        for i, s in enumerate(doses):
            for j, name in enumerate(("direct", "residual")):
                chosen[(seed, s, name)] = alphas[best(e[i, j], alphas)]
                scores += [(int(seed), s, name, float(a), float(v), a == chosen[(seed, s, name)]) for a, v in zip(alphas, e[i, j])]
    final = {
        seed: G.stack([
            G.ridge(table[(seed, s, "fit")], chosen[(seed, s, name)]) for s in doses for name, table in (("direct", sets), ("residual", residual))
        ])
        for seed in seeds
    }
    wanted = rows.filter("in_test or cal_rank is not null").selectExpr(
        "seed", "trial_uid", "subject_uid", "stimulus_uid", *targets, "in_test", "cal_rank", "features", "y",
        "array(" + ", ".join(prior(s, "fit") for s in doses) + ") AS prior_by_dose",
        "array(" + ", ".join(f"priors['{s}fit'] is not null" for s in doses) + ") AS seen_by_dose",
    )
    predicted = materialize(G.append_predictions(wanted, final, "seed"))
    dose = f"element_at(array({', '.join(str(s) for s in doses)}), i + 1)"
    per_s = predicted.selectExpr("*", f"explode(sequence(0, {len(doses) - 1})) AS i").selectExpr(
        "cast(seed as bigint) AS seed", f"{dose} AS stimulus_dose", "trial_uid", "subject_uid", "stimulus_uid", *targets, "in_test", "cal_rank",
        "seen_by_dose[i] AS stimulus_seen",
        *[f"prior_by_dose[i][{j}] AS prior_{n}" for j, n in enumerate(names)],
        *[f"prediction[i * {2 * t} + {j}] AS eeg_population_{n}" for j, n in enumerate(names)],
        *[f"prior_by_dose[i][{j}] + prediction[i * {2 * t} + {t + j}] AS combined_population_{n}" for j, n in enumerate(names)],
    )
    base = ("prior", "eeg_population", "combined_population")
    pd_list = f"array({', '.join(str(int(p)) for p in sorted(p_doses))})"
    calibration = per_s.filter("cal_rank is not null").selectExpr("*", f"explode({pd_list}) AS participant_dose").filter("cal_rank <= participant_dose")
    test = per_s.filter("in_test").drop("in_test", "cal_rank").selectExpr("*", f"explode({pd_list}) AS participant_dose")
    out = P.participant_offsets(calibration, test, base, targets=targets, by=["seed", "participant_dose", "stimulus_dose"])
    renamed = {"prior": "prior_personalized", "eeg_population": "eeg_personalized", "combined_population": "combined_personalized"}
    out = out.selectExpr(
        "seed", "participant_dose", "stimulus_dose", "trial_uid", "subject_uid", "stimulus_uid", *targets, "stimulus_seen",
        *[f"{b}_{n}" for b in base for n in names], *[f"{b}_{n} + offset_{b}_{n} AS {renamed[b]}_{n}" for b in base for n in names],
    )
    table = rows.sparkSession.createDataFrame(
        scores, "seed bigint, stimulus_dose int, model string, alpha double, validation_mae double, selected boolean"
    )
    return out, table


def cell_metrics(predictions: DataFrame, targets: Sequence[str] = TARGETS) -> DataFrame:
    """Metrics per (seed, p, s, predictor, target) including the macro mean."""
    keys = ["seed", "participant_dose", "stimulus_dose"]
    long = M.long_predictions(predictions, PREDICTORS, names=[P.short(t) for t in targets], keep=keys)
    return M.regression_metrics(long, [*keys, "predictor"])


def increments(metrics: DataFrame) -> DataFrame:
    """Macro-CCC increments of interest per cell."""
    keys = ["seed", "participant_dose", "stimulus_dose"]
    wide = metrics.filter("target = 'macro'").groupBy(*keys).pivot("predictor", list(PREDICTORS)).agg(F.first("ccc"))
    return wide.selectExpr(
        *keys, "combined_population - prior AS eeg_added_value_ccc", "combined_personalized - prior_personalized AS eeg_added_value_personalized_ccc",
        "prior_personalized - prior AS prior_personalization_gain_ccc", "combined_personalized - combined_population AS personalization_gain_ccc",
    )


def grid_select(rows: DataFrame, candidates: Sequence[tuple[tuple, Callable[[G.Moments], G.Model]]], train: G.Moments, *, y="y", prior="prior_sel", targets: int = 2) -> tuple[tuple, list]:
    """One validation scan scores every candidate; ties go to the first in the given order."""
    models = {"all": G.stack([fn(train) for _, fn in candidates])}
    held = rows.withColumn("_one", F.lit("all"))
    e = G.validation_errors(held, models, "_one", y=y, offset=prior, targets=targets)["all"]
    return candidates[best(e, range(len(e)))][0], [(c[0], float(v)) for c, v in zip(candidates, e)]
