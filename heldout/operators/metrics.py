"""Agreement, classification and descriptive statistics as grouped aggregates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heldout.functions.checks import EvaluationError, guard_none
from heldout.functions.formulas import ccc_from_sums, ccc_of, mae_of, rmse_of
from heldout.functions.joins import attach_groups
from heldout.functions.materialize import materialize


def long_predictions(df: DataFrame, predictors: Sequence[str], names=("valence", "arousal"), keep: Sequence[str] = ()) -> DataFrame:
    """Wide ``{predictor}_{target}`` columns to rows ``(keep, predictor, target, y, yhat)``."""
    cells = ", ".join(
        f"struct('{p}' AS predictor, '{n}' AS target, target_{n} AS y, {p}_{n} AS yhat)" for p in predictors for n in names
    )
    return df.selectExpr(*keep, f"inline(array({cells}))")


def ccc(df: DataFrame, keys: Sequence[str], y: str = "y", yhat: str = "yhat") -> DataFrame:
    return df.groupBy(*keys).agg(ccc_of(y, yhat).alias("ccc"), F.count(F.lit(1)).alias("n"))


def regression_metrics(long: DataFrame, keys: Sequence[str]) -> DataFrame:
    """CCC, MAE and RMSE per target, and their mean over defined targets as target ``macro``."""
    per = long.groupBy(*keys, "target").agg(
        ccc_of("y", "yhat").alias("ccc"), mae_of("y", "yhat").alias("mae"), rmse_of("y", "yhat").alias("rmse")
    )
    macro = per.groupBy(*keys).agg(*[F.avg(m).alias(m) for m in ("ccc", "mae", "rmse")])
    return per.unionByName(macro.withColumn("target", F.lit("macro")))


def metrics_by_context(long: DataFrame, keys: Sequence[str], context: str = "context", least: int = 2) -> DataFrame:
    """Regression metrics for all rows (context ``all``) and each context with enough rows."""
    cols = [F.col(k) for k in keys]
    c, target = F.col(context), F.col("target")
    per = (
        long.groupingSets([[*cols, target, c], [*cols, target]], *cols, target, c)
        .agg(
            ccc_of("y", "yhat").alias("ccc"), mae_of("y", "yhat").alias("mae"), rmse_of("y", "yhat").alias("rmse"),
            F.count(F.lit(1)).alias("n"), F.grouping(context).alias("_all"),
        )
        .withColumn(context, F.when(F.col("_all") == 1, "all").otherwise(F.col(context)))
        .filter((F.col("_all") == 1) | (F.col("n") >= least))
        .drop("_all")
    )
    macro = per.groupBy(*keys, context).agg(*[F.avg(m).alias(m) for m in ("ccc", "mae", "rmse")], F.max("n").alias("n"))
    return per.unionByName(macro.withColumn("target", F.lit("macro")))


SUMS = ("n", "sy", "sx", "syy", "sxx", "sxy", "sae")


def pair_sums(long: DataFrame, keys: Sequence[str], weight: str | None = None) -> DataFrame:
    """The additive statistics every weighted score is built from."""
    w = f"{weight} * " if weight else ""
    exprs = {
        "n": f"sum({w}1D)", "sy": f"sum({w}y)", "sx": f"sum({w}yhat)", "syy": f"sum({w}y * y)", "sxx": f"sum({w}yhat * yhat)",
        "sxy": f"sum({w}y * yhat)", "sae": f"sum({w}abs(yhat - y))",
    }
    return long.groupBy(*keys).agg(*[F.expr(e).alias(k) for k, e in exprs.items()])


def scores_from_sums(sums: DataFrame, keys: Sequence[str], guard: float = 1e-15) -> DataFrame:
    """Macro CCC (over defined targets) and MAE per ``keys`` from per-target sums."""
    per = sums.withColumn("ccc", ccc_from_sums("n", "sy", "sx", "syy", "sxx", "sxy", guard)).withColumn(
        "mae", F.expr("case when n > 0 then sae / n end")
    )
    return per.groupBy(*keys).agg(F.avg("ccc").alias("macro_ccc"), F.avg("mae").alias("macro_mae"))


def weighted_scores(long: DataFrame, keys: Sequence[str], weight: str) -> DataFrame:
    return scores_from_sums(pair_sums(long, [*keys, "target"], weight), keys)


def classification_metrics(df: DataFrame, keys: Sequence[str] = (), truth="label", predicted="prediction", count: str | None = None) -> DataFrame:
    """Accuracy, balanced accuracy over observed labels, macro F1 and Cohen's kappa; a row stands for ``count`` equal ones."""
    cells = df.groupBy(*keys, truth, predicted).agg((F.sum(count) if count else F.count(F.lit(1))).alias("c"))
    sides = cells.selectExpr(
        *keys, f"inline(array(struct({truth} AS label, c AS t, 0L AS p, if({truth} = {predicted}, c, 0L) AS hit), "
        f"struct({predicted} AS label, 0L AS t, c AS p, 0L AS hit)))"
    )
    per = sides.groupBy(*keys, "label").agg(*[F.sum(x).alias(x) for x in ("t", "p", "hit")])
    agg = per.groupBy(*keys).agg(
        F.expr("sum(hit) / sum(t)").alias("accuracy"),
        F.expr("avg(case when t > 0 then hit / t end)").alias("balanced_accuracy"),
        F.expr("avg(2 * hit / (t + p))").alias("macro_f1"),
        F.expr("sum(t * p) / (cast(sum(t) as double) * sum(t))").alias("_chance"),
    )
    return agg.withColumn("kappa", F.expr("case when _chance < 1 then (accuracy - _chance) / (1 - _chance) end")).drop("_chance")


def eta_squared(df: DataFrame, group: str, vector: str = "features", keys: Sequence[str] = ()) -> DataFrame:
    """Share of the multivariate sum of squares between group means, clipped to [0, 1]."""
    long = df.select(*keys, group, F.posexplode(vector).alias("pos", "x"))
    cells = long.groupBy(*keys, group, "pos").agg(
        F.count(F.lit(1)).alias("n"), F.sum("x").alias("s"), F.expr("sum(x * x)").alias("q")
    )
    per_pos = cells.groupBy(*keys, "pos").agg(
        F.expr("sum(s * s / n) - sum(s) * sum(s) / sum(n)").alias("between"),
        F.expr("sum(q) - sum(s) * sum(s) / sum(n)").alias("total"),
    )
    return per_pos.groupBy(*keys).agg(
        F.expr("if(sum(total) < 1e-15, 0D, greatest(0D, least(1D, sum(between) / sum(total))))").alias("eta_squared")
    )


def loo_consensus(df: DataFrame, target: str, stimulus: str = "stimulus_uid") -> DataFrame:
    """Mean of the other ratings of the stimulus; NULL for a single or missing rating."""
    value = f"case when isnan({target}) then null else {target} end"
    rows = df.selectExpr("trial_uid", stimulus, f"{value} AS y")
    sums = rows.filter("y is not null").groupBy(stimulus).agg(F.count("y").alias("_n"), F.sum("y").alias("_s"))
    return attach_groups(rows, sums, [stimulus]).selectExpr(
        "trial_uid", stimulus, "y", "if(y is null, 0L, coalesce(_n, 0L)) AS rating_count",
        "case when y is not null and _n > 1 then (_s - y) / (_n - 1) end AS prediction",
    )


def consensus_summary(df: DataFrame, target: str, stimulus: str = "stimulus_uid") -> DataFrame:
    used = loo_consensus(df, target, stimulus).filter("prediction is not null")
    return used.agg(
        F.count(F.lit(1)).alias("supported_rating_count"), F.count_distinct(stimulus).alias("supported_stimulus_count"),
        ccc_of("y", "prediction").alias("ccc"), mae_of("y", "prediction").alias("mae"),
    )


def additive_effects(cells: DataFrame, mean: float, first: str, second: str, *, tolerance: float = 1e-12, steps: int = 500) -> tuple[DataFrame, DataFrame]:
    """(first, a) and (second, b): least-squares effects of both factors around ``mean`` over (first, second) cells with n and s.

    The effects of ``first`` are eliminated: given b they are means of what is
    left.  The remaining equations in b are solved by conjugate gradients,
    scaled by the row counts; a step is two aggregations over the cells and two
    over the effects of ``second``.  It stops when the residual of the normal
    equations has fallen to ``tolerance`` of what it was.
    """
    centred = f"s - n * {mean!r}D"
    onto = lambda table, column, other: attach_groups(cells, table, [column], spread=other)
    left = cells.groupBy(first).agg(F.expr(f"sum({centred}) / sum(n)").alias("m"))
    start = onto(left, first, second).groupBy(second).agg(F.sum("n").alias("d"), F.expr(f"sum({centred} - n * m)").alias("r"))
    state = materialize(start.selectExpr(second, "d", "0D AS b", "r", "r / d AS p"))
    size = state.agg(F.expr("sum(r * r / d)")).first()[0] or 0.0
    goal = size * tolerance * tolerance
    for _ in range(steps):
        if size <= goal or size == 0.0:
            break
        u = onto(state.select(second, "p"), second, first).groupBy(first).agg(F.expr("sum(n * p) / sum(n)").alias("u"))
        q = onto(u, first, second).groupBy(second).agg(F.expr("sum(n * u)").alias("nu"))
        moved = materialize(state.join(q, second).selectExpr(second, "d", "b", "r", "p", "d * p - nu AS q"))
        pq, pp = moved.agg(F.expr("sum(p * q)"), F.expr("sum(d * p * p)")).first()
        if not pq > 1e-13 * pp:  # only a shift of all effects is left, which the means don't see
            break
        alpha = size / pq
        after = moved.agg(F.expr(f"sum((r - {alpha!r}D * q) * (r - {alpha!r}D * q) / d)")).first()[0]
        beta = after / size
        state = moved.selectExpr(second, "d", f"b + {alpha!r}D * p AS b", f"r - {alpha!r}D * q AS r", f"(r - {alpha!r}D * q) / d + {beta!r}D * p AS p")
        size = after
    else:
        raise EvaluationError(f"the additive fit still moves after {steps} steps; allow more steps or a larger tolerance")
    b = materialize(state.select(second, "b"))
    a = onto(b, second, first).groupBy(first).agg(F.expr(f"sum({centred} - n * b) / sum(n)").alias("a"))
    return materialize(a), b


def additive_r2(df: DataFrame, target: str, first="subject_uid", second="stimulus_uid", *, tolerance=1e-12, steps=500) -> DataFrame:
    """In-sample R2 of each factor alone and of both (additive least squares).

    Rows are first reduced to (first, second) cells.  One-factor fits are group
    means; the two-factor fit is that of ``additive_effects``.
    """
    rows = df.filter(f"{target} is not null and not isnan({target})")
    cells = rows.groupBy(first, second).agg(
        F.count(F.lit(1)).cast("double").alias("n"), F.sum(target).alias("s"), F.expr(f"sum({target} * {target})").alias("q")
    )
    cells = materialize(cells)
    base = cells.agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q")).first()
    if not base.n or base.n < 2:
        raise EvaluationError("the additive summary needs at least two ratings")
    mean, total = base.s / base.n, base.q - base.s * base.s / base.n

    def explained(column: str) -> float:
        g = cells.groupBy(column).agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
        return g.agg(F.expr("sum(s * s / n)")).first()[0] - base.s * base.s / base.n

    ss_first, ss_second = explained(first), explained(second)
    a, b = additive_effects(cells, mean, first, second, tolerance=tolerance, steps=steps)
    fitted = attach_groups(attach_groups(cells, a, [first], spread=second), b, [second], spread=first)
    f = f"({mean!r}D + a + b)"
    ss_both = total - fitted.agg(F.expr(f"sum(q - 2 * {f} * s + n * {f} * {f})")).first()[0]
    r1, r2, both = (x / total if total > 0 else None for x in (ss_first, ss_second, ss_both))
    data = [(int(base.n), total / (base.n - 1), r1, r2, both, None if both is None else both - r1, None if both is None else both - r2)]
    return df.sparkSession.createDataFrame(
        data,
        "observation_count long, target_sample_variance double, first_only double, second_only double, both double, "
        "second_given_first double, first_given_second double",
    )


def trial_mae_delta(df: DataFrame, candidate: str, baseline: str, names=("valence", "arousal")) -> DataFrame:
    """Mean over targets of the absolute-error difference, candidate minus baseline."""
    k = len(names)
    cand = " + ".join(f"abs({candidate}_{n} - target_{n})" for n in names)
    base = " + ".join(f"abs({baseline}_{n} - target_{n})" for n in names)
    return df.selectExpr("*", f"({cand}) / {k} - ({base}) / {k} AS mae_delta")


def seed_summary(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Mean, sample sd (0 for one seed) and seed count."""
    return df.groupBy(*keys).agg(
        F.avg(value).alias("mean"), F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("sample_sd"), F.count(F.lit(1)).alias("seed_count")
    )


def paired_seed_summary(left: DataFrame, right: DataFrame, keys: Sequence[str], value: str, *, validate: bool = True) -> DataFrame:
    """Seed summary of left minus right; both sides must hold the same seeds."""
    k = [*keys, "seed"]
    both = left.select(*k, F.col(value).alias("_l"), F.lit(1).alias("_a")).join(
        right.select(*k, F.col(value).alias("_r"), F.lit(1).alias("_b")), k, "full_outer"
    )
    if validate:
        guard_none(both.filter("_a is null or _b is null"), "paired summaries need identical seeds")
    return seed_summary(both.withColumn("delta", F.col("_l") - F.col("_r")), keys, "delta")


def component_spread(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*keys).agg(*[F.stddev_pop(c).alias(f"{c}_sd") for c in columns])


def probe_summary(probes: DataFrame, keys=("representation", "probe", "dataset_id")) -> DataFrame:
    """Per-seed probe rows to means, sd and identity lift over the permuted control."""
    return probes.groupBy(*keys).agg(
        F.count_distinct("seed").alias("seed_count"),
        F.avg("balanced_accuracy").alias("balanced_accuracy_mean"),
        F.stddev_samp("balanced_accuracy").alias("balanced_accuracy_sample_sd"),
        F.avg("permuted_balanced_accuracy").alias("permuted_balanced_accuracy_mean"),
        F.avg(F.col("balanced_accuracy") - F.col("permuted_balanced_accuracy")).alias("identity_lift_mean"),
        F.avg("chance_accuracy").alias("chance_accuracy"),
    )


def missingness_profile(df: DataFrame, targets: Sequence[str], *, available="available", subject="subject_uid", dataset="dataset_id") -> DataFrame:
    """Missing counts, per-subject extremes and standardised mean differences of the targets."""
    smd = [
        F.expr(
            f"(avg({t}) filter (where not {available}) - avg({t}) filter (where {available})) / "
            f"sqrt((var_samp({t}) filter (where not {available}) + var_samp({t}) filter (where {available})) / 2)"
        ).alias(f"{t}_smd")
        for t in targets
    ]
    base = df.groupBy(dataset).agg(
        F.count(F.lit(1)).alias("eligible_trial_count"), F.expr(f"count_if({available})").alias("feature_available_count"),
        F.expr(f"count_if(not {available})").alias("missing_count"), F.expr(f"avg(cast(not {available} as double))").alias("missing_fraction"), *smd,
    )
    subjects = df.groupBy(dataset, subject).agg(F.expr(f"avg(cast(not {available} as double))").alias("f"))
    extremes = subjects.groupBy(dataset).agg(
        F.expr("count_if(f = 1)").alias("subjects_all_missing"), F.expr("count_if(f = 0)").alias("subjects_no_missing")
    )
    return base.join(extremes, dataset)


def protocol_means(df: DataFrame, grid: DataFrame, *, validate: bool = True) -> DataFrame:
    """Means per (protocol, model); every cell of ``grid`` must be present."""
    out = grid.join(df, ["protocol", "model"], "left").groupBy("protocol", "model").agg(
        F.avg("accuracy").alias("mean_trial_accuracy"), F.avg("macro_f1").alias("trial_macro_f1"),
        F.count("accuracy").alias("result_rows"), F.count_distinct("held_out_subject").alias("participant_count"),
        F.count_distinct("seed").alias("seed_count"),
    )
    if validate:
        guard_none(out.filter("result_rows = 0"), "missing protocol/model cell")
    return out
