"""Group priors, calibration offsets and shrinkage.

A prior is a per-group aggregate joined back with ``attach_groups``; nothing
here windows over a group, so a popular stimulus or subject does not pile up in
one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heldout.functions.checks import EvaluationError, guard_none, guard_unique, require_columns
from heldout.functions.joins import attach_groups

TARGETS = ("target_valence", "target_arousal")


def short(target: str) -> str:
    return target.removeprefix("target_")


def global_mean(fit: DataFrame, targets: Sequence[str] = TARGETS, by: Sequence[str] = ()) -> DataFrame:
    """Mean of each target, one row (per ``by``)."""
    return fit.groupBy(*by).agg(*[F.avg(t).alias(f"global_{short(t)}") for t in targets])


def _with_global(df: DataFrame, means: DataFrame, by: Sequence[str]) -> DataFrame:
    return df.join(means, list(by)) if by else df.crossJoin(means)


def group_means(fit: DataFrame, group: str, targets: Sequence[str] = TARGETS, by: Sequence[str] = ()) -> DataFrame:
    return fit.groupBy(*by, group).agg(*[F.avg(t).alias(f"_mean_{short(t)}") for t in targets])


def group_mean_prior(fit: DataFrame, requested: DataFrame, group: str, targets=TARGETS, by: Sequence[str] = ()) -> DataFrame:
    """Fit mean of the row's group, the global mean where the group is unseen."""
    out = attach_groups(requested, group_means(fit, group, targets, by), [*by, group])
    out = _with_global(out, global_mean(fit, targets, by), by)
    for t in targets:
        n = short(t)
        out = out.withColumn(f"prior_{n}", F.coalesce(f"_mean_{n}", f"global_{n}"))
    return out.drop(*[c for t in targets for c in (f"_mean_{short(t)}", f"global_{short(t)}")])


def condition_residuals(df: DataFrame, group: str, targets=TARGETS) -> DataFrame:
    out = attach_groups(df, group_means(df, group, targets), [group])
    names = [short(t) for t in targets]
    return out.selectExpr("*", *[f"{t} - _mean_{n} AS residual_{n}" for t, n in zip(targets, names)]).drop(
        *[f"_mean_{n}" for n in names]
    )


def _loo(df: DataFrame, group: str, targets, by: Sequence[str]) -> DataFrame:
    sums = df.groupBy(*by, group).agg(
        F.count(F.lit(1)).alias("_n"), *[F.sum(t).alias(f"_sum_{short(t)}") for t in targets]
    )
    return attach_groups(df, sums, [*by, group])


def loo_group_prior(df: DataFrame, group: str, targets=TARGETS, by: Sequence[str] = ()) -> DataFrame:
    """Group mean without the row itself; a singleton gets the global mean without itself."""
    totals = df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("_total_n"), *[F.sum(t).alias(f"_total_{short(t)}") for t in targets]
    )
    out = _with_global(_loo(df, group, targets, by), totals, by)
    exprs = [
        f"if(_n > 1, (_sum_{n} - {t}) / (_n - 1), (_total_{n} - {t}) / nullif(_total_n - 1, 0)) AS prior_{n}"
        for t, n in ((t, short(t)) for t in targets)
    ]
    return out.selectExpr(*df.columns, *exprs)


def loo_prior_with_fallback(df: DataFrame, group: str, targets=TARGETS, by: Sequence[str] = ()) -> DataFrame:
    """Group mean without the row itself; a singleton keeps its ``fallback_*`` columns."""
    require_columns(df, [f"fallback_{short(t)}" for t in targets])
    out = _loo(df, group, targets, by)
    exprs = [
        f"if(_n > 1, (_sum_{n} - {t}) / (_n - 1), fallback_{n}) AS prior_{n}" for t, n in ((t, short(t)) for t in targets)
    ]
    return out.selectExpr(*df.columns, *exprs)


def published_prior_fallback(df: DataFrame, means: DataFrame, targets=TARGETS, by: Sequence[str] = ()) -> DataFrame:
    """``fallback_*``: the published prior if it is finite for all targets, else the global mean."""
    names = [short(t) for t in targets]
    published = [f"stimulus_prior_{n}" for n in names]
    out = _with_global(df, means, by)
    if set(published) <= set(df.columns):
        ok = " and ".join(f"{p} is not null and not isnan({p}) and abs({p}) < double('inf')" for p in published)
        exprs = [f"if({ok}, {p}, global_{n}) AS fallback_{n}" for p, n in zip(published, names)]
    else:
        exprs = [f"global_{n} AS fallback_{n}" for n in names]
    return out.selectExpr(*df.columns, *exprs)


def seen_group_prior(fit: DataFrame, requested: DataFrame, group: str, targets=TARGETS, by: Sequence[str] = ()) -> DataFrame:
    """``prior_*`` and ``seen``: fit means where the group was seen, ``fallback_*`` elsewhere."""
    names = [short(t) for t in targets]
    require_columns(requested, [f"fallback_{n}" for n in names])
    means = group_means(fit, group, targets, by).withColumn("_seen", F.lit(True))
    out = attach_groups(requested, means, [*by, group])
    return out.selectExpr(
        *requested.columns,
        *[f"if(_seen is not null, _mean_{n}, fallback_{n}) AS prior_{n}" for n in names],
        "_seen is not null AS seen",
    )


def participant_offsets(calibration: DataFrame, test: DataFrame, predictors: Sequence[str], *, subject="subject_uid", targets=TARGETS, by=()) -> DataFrame:
    """``offset_{predictor}_{target}``: mean calibration residual of the same predictor, 0 without any."""
    pairs = [(p, t, short(t)) for p in predictors for t in targets]
    per = calibration.groupBy(*by, subject).agg(*[F.avg(F.col(t) - F.col(f"{p}_{n}")).alias(f"_o_{p}_{n}") for p, t, n in pairs])
    out = attach_groups(test, per, [*by, subject])
    return out.selectExpr(*test.columns, *[f"coalesce(_o_{p}_{n}, 0D) AS offset_{p}_{n}" for p, _, n in pairs])


def shrinkage_estimate(residuals: DataFrame, *, participant="subject_uid", names=("valence", "arousal"), prefix="residual_") -> DataFrame:
    """Method-of-moments variances per target: pooled within, and between corrected for sampling noise."""
    long = residuals.unpivot([participant], [f"{prefix}{n}" for n in names], "target", "r").selectExpr(
        participant, f"replace(target, '{prefix}', '') AS target", "r"
    )
    groups = long.groupBy("target", participant).agg(
        F.count(F.lit(1)).alias("n"), F.avg("r").alias("m"), F.var_pop("r").alias("v")
    )
    return groups.groupBy("target").agg(
        F.count(F.lit(1)).alias("participants"),
        F.sum("n").alias("trials"),
        F.expr("sum(n * v) / (sum(n) - count(*))").alias("within_variance"),
        F.expr("greatest(var_samp(m) - sum(n * v) / (sum(n) - count(*)) * avg(1 / n), 0D)").alias("between_variance"),
    ).select(
        "target", "within_variance", "between_variance", "participants",
        F.expr("if(participants < 2 or trials <= participants, "
               "raise_error('shrinkage needs several participants with replication'), cast(trials as bigint))").cast("bigint").alias("trials"),
    )


def shrinkage_weights(estimate: DataFrame, counts: DataFrame) -> DataFrame:
    """``n*b / (n*b + w)`` per (count row, target), 0 without calibration trials."""
    return counts.crossJoin(F.broadcast(estimate.select("target", "within_variance", "between_variance"))).selectExpr(
        *counts.columns, "target",
        "case when n = 0 or n * between_variance + within_variance <= 0 then 0D "
        "else n * between_variance / (n * between_variance + within_variance) end AS weight",
    )


SHRUNK = (("prior", "prior_personalized"), ("combined_population", "combined_personalized"), ("eeg_population", "eeg_personalized"))


def shrink_predictions(df: DataFrame, names=("valence", "arousal"), pairs=SHRUNK) -> DataFrame:
    """``base + weight * (calibrated - base)`` with ``weight_{target}`` columns; other columns stay."""
    new = {
        f"{c}_{n}": F.expr(f"{b}_{n} + weight_{n} * ({c}_{n} - {b}_{n})")
        for b, c in pairs
        for n in names
        if f"{c}_{n}" in df.columns
    }
    return df.withColumns(new)


def covered_partitions(df: DataFrame, label: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Fit rows, test rows of classes present in fit, and the seen fraction of the test rows."""
    fit = df.filter("split in ('train', 'validation')")
    test = df.filter("split = 'test'")
    classes = fit.select(label).distinct().withColumn("_seen", F.lit(1))
    marked = attach_groups(test, classes, [label])
    fraction = marked.agg((F.count("_seen") / F.count(F.lit(1))).alias("seen_fraction"))
    return fit, marked.filter("_seen = 1").drop("_seen"), fraction


def aggregate_stimuli(df: DataFrame, *, stimulus="stimulus_uid", first: Sequence[str] = (), targets=TARGETS) -> DataFrame:
    """Mean targets per stimulus and the descriptive columns of its first trial by uid."""
    return df.groupBy(stimulus).agg(
        *[F.min_by(c, "trial_uid").alias(c) for c in first],
        *[F.avg(t).alias(t) for t in targets],
        F.count(F.lit(1)).alias("trials"),
    )


def population_targets(trials: DataFrame, assignment: DataFrame, *, stimulus="stimulus_uid", targets=TARGETS) -> DataFrame:
    """Residual training targets and priors for an external predictor.

    Train and validation rows get leave-one-out priors, test and calibration
    rows the fit means; ``residual_*`` is NULL outside the fit rows.
    """
    names = [short(t) for t in targets]
    rows = trials.join(assignment.select("trial_uid", "split"), "trial_uid").filter("split <> 'excluded'")
    fit = rows.filter("split in ('train', 'validation')")
    sums = fit.groupBy(stimulus).agg(F.count(F.lit(1)).alias("_n"), *[F.sum(t).alias(f"_s_{n}") for t, n in zip(targets, names)])
    # published priors if the table has them, else the global fit mean
    out = attach_groups(published_prior_fallback(rows, global_mean(fit, targets), targets), sums, [stimulus])
    inside = "split in ('train', 'validation')"
    out = out.selectExpr(
        *trials.columns, "split", f"{inside} or _n is not null AS seen",
        *[
            f"case when {inside} then if(_n > 1, (_s_{n} - {t}) / (_n - 1), fallback_{n}) "
            f"else coalesce(_s_{n} / _n, fallback_{n}) end AS prior_{n}"
            for t, n in zip(targets, names)
        ],
    )
    return out.selectExpr("*", *[f"case when {inside} then {t} - prior_{n} end AS residual_{n}" for t, n in zip(targets, names)])


def prediction_table(priors: DataFrame, external: DataFrame, *, subject="subject_uid", targets=TARGETS) -> DataFrame:
    """Prior and combined predictions of the test rows, plain and personalised.

    ``external`` holds ``residual_prediction_{target}`` for test and calibration rows.
    """
    names = [short(t) for t in targets]
    rows = priors.filter("split in ('test', 'calibration')").join(
        external.select("trial_uid", *[f"residual_prediction_{n}" for n in names]), "trial_uid"
    ).selectExpr("*", *[f"prior_{n} + residual_prediction_{n} AS combined_population_{n}" for n in names])
    test, calibration = rows.filter("split = 'test'"), rows.filter("split = 'calibration'")
    out = participant_offsets(calibration, test, ["prior", "combined_population"], subject=subject, targets=targets)
    return out.selectExpr(
        "trial_uid", subject, "stimulus_uid", *targets,
        *[f"prior_{n}" for n in names],
        *[f"prior_{n} + offset_prior_{n} AS prior_personalized_{n}" for n in names],
        *[f"combined_population_{n}" for n in names],
        *[f"combined_population_{n} + offset_combined_population_{n} AS combined_personalized_{n}" for n in names],
    )


def candidate_predictions(candidates: dict[str, DataFrame], prior: DataFrame, *, targets=TARGETS, validate: bool = True) -> DataFrame:
    """Union of candidate residual predictions on one shared prior and one shared support.

    ``prior`` has truth and ``prior_*``; each candidate has ``residual_prediction_*``.
    """
    if not candidates:
        raise EvaluationError("at least one candidate is required")
    names = [short(t) for t in targets]
    support = prior.select("trial_uid")
    parts = None
    for label, df in candidates.items():
        if validate:
            guard_unique(df, ["trial_uid"])
            ids = df.select("trial_uid")
            guard_none(ids.exceptAll(support).unionByName(support.exceptAll(ids)), f"candidate {label} has another support")
        part = df.selectExpr("trial_uid", *[f"residual_prediction_{n}" for n in names], f"'{label}' AS candidate")
        parts = part if parts is None else parts.unionByName(part)
    return prior.join(parts, "trial_uid").selectExpr(
        *prior.columns, "candidate", *[f"prior_{n} + residual_prediction_{n} AS prediction_{n}" for n in names]
    )
