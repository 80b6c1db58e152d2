"""Intervals, contrasts and selectors on top of the draw tables."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heldout.functions.checks import EvaluationError, finite, guard_none
from heldout.functions.formulas import t_quantile
from heldout.functions.hashing import support_digest
from heldout.functions.materialize import materialize
from heldout.operators import resample as R
from heldout.operators.metrics import pair_sums, scores_from_sums
from heldout.operators.multiplicity import weighted_sums

CONTRASTS = {
    "eeg_added_population": ("combined_population", "prior"),
    "eeg_added_matched_calibration": ("combined_personalized", "prior_personalized"),
    "prior_calibration_gain": ("prior_personalized", "prior"),
    "combined_calibration_gain": ("combined_personalized", "combined_population"),
    "total_minus_uncalibrated_prior": ("combined_personalized", "prior"),
}
LEAST_DRAWS = 100
CELL = ("representation", "participant_dose", "stimulus_dose")


def sign_flip_pvalue(differences: DataFrame, keys: Sequence[str], value: str, *, limit: int = 20) -> DataFrame:
    """Exact two-sided sign-flip p-value over all 2**n sign vectors, n at most 20."""
    sizes = differences.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.expr(f"count_if({value} is null or isnan({value}))").alias("bad")
    )
    guard_none(sizes.filter(f"n > {limit} or bad > 0"), f"sign-flip needs 1 to {limit} finite differences")
    # at most ``limit`` values per comparison from here on
    packed = differences.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_list(value)).alias("v"))
    flips = packed.selectExpr(
        *keys, "n", "v", "abs(aggregate(v, 0D, (a, x) -> a + x)) / n AS observed",
        "explode(sequence(0, cast(shiftleft(1, cast(n as int)) as int) - 1)) AS signs",
    ).selectExpr(
        *keys, "observed",
        "abs(aggregate(transform(v, (x, i) -> if((shiftright(signs, i) & 1) = 1, -x, x)), 0D, (a, x) -> a + x)) / n AS statistic",
    )
    return flips.groupBy(*keys).agg(F.expr("count_if(statistic >= observed - 1e-12) / count(*)").alias("p_value"))


def percentile_interval(df: DataFrame, keys: Sequence[str], value: str, confidence: float = 0.95) -> DataFrame:
    """Linear-interpolated quantile interval of finite samples."""
    tail = (1 - confidence) / 2
    q = f"percentile({value}, array({tail!r}D, {1 - tail!r}D))"
    return df.filter(f"{value} is not null and not isnan({value})").groupBy(*keys).agg(
        F.expr(f"{q}[0]").alias("ci_low"), F.expr(f"{q}[1]").alias("ci_high"), F.count(F.lit(1)).alias("n")
    )


def intervals(draws: DataFrame, keys: Sequence[str], value: str, *, method: str = "percentile", df: int | None = None) -> DataFrame:
    """Observed value (draw 0) and its interval from the finite draws.

    Methods: percentile, basic, normal_t and block_t; the t forms need their
    degrees of freedom and are NULL below one.
    """
    if method not in ("percentile", "basic", "normal_t", "block_t"):
        raise EvaluationError("no interval of that name")
    v = f"case when draw > 0 and {value} is not null and not isnan({value}) then {value} end"
    out = draws.groupBy(*keys).agg(
        F.expr(f"max(case when draw = 0 then {value} end)").alias("estimate"),
        F.expr(f"percentile({v}, array(0.025D, 0.975D))").alias("_q"),
        F.expr(f"stddev_samp({v})").alias("_sd"), F.expr(f"count({v})").alias("valid_bootstrap"),
    )
    if method == "percentile":
        low, high = "_q[0]", "_q[1]"
    elif method == "basic":
        low, high = "2 * estimate - _q[1]", "2 * estimate - _q[0]"
    else:
        t = t_quantile(float(df)) if df is not None and df >= 1 else None
        radius = f"{t!r}D * _sd" if t else "cast(null as double)"
        low, high = f"estimate - {radius}", f"estimate + {radius}"
    return out.selectExpr(*keys, "estimate", f"{low} AS ci_low", f"{high} AS ci_high", "valid_bootstrap")


def topology(long: DataFrame, split: str = "seed") -> DataFrame:
    return long.groupBy(split).agg(
        F.count_distinct("trial_uid").alias("n_trials"), F.count_distinct("subject_uid").alias("n_participants"),
        F.count_distinct("stimulus_uid").alias("n_stimuli"),
    )


def degrees_of_freedom(long: DataFrame, split: str = "seed") -> tuple[int, int, int]:
    """(splits, cluster df, block df): the smallest identity count minus one, and splits minus one."""
    t = topology(long, split).agg(F.count(F.lit(1)).alias("s"), F.min(F.least("n_participants", "n_stimuli")).alias("c")).first()
    return t.s, t.c - 1, t.s - 1


def _support(long: DataFrame | R.Spread, axes: Sequence[str], split: str) -> DataFrame:
    """One small row per cell and target: rows, exact sums of row hashes that stand for its trials and for its identities and truths, and rows that aren't finite."""
    total = "sum(cast(xxhash64({}) as decimal(38,0)))"
    known, counted = ["subject_uid", "stimulus_uid"], [F.count(F.lit(1)).alias("n"), F.expr(total.format("trial_uid")).alias("d")]

    def sums(y, x, i=""):
        return F.expr(total.format(f"trial_uid, {', '.join(known)}, {y}")).alias(f"y{i}"), F.count_if(~(finite(F.expr(y)) & finite(F.expr(x)))).alias(f"bad{i}")

    if not isinstance(long, R.Spread):
        return long.dropna(subset=known).groupBy(*axes, "target").agg(*counted, *sums("y", "yhat"))
    # a row is not repeated for each label and target
    per = long.cells(long.rows.dropna(subset=known)).groupBy(split, *long.grid).agg(*counted, *[c for i, (_, _, y, x) in enumerate(long.forms) for c in sums(y, x, i)])
    each = ", ".join(f"struct('{p}' AS {long.label}, '{t}' AS target, y{i} AS y, bad{i} AS bad)" for i, (p, t, _, _) in enumerate(long.forms))
    return per.selectExpr(split, *long.grid, "n", "d", f"inline(array({each}))")


def check_grid(long: DataFrame | R.Spread, split: str = "seed") -> None:
    """Every cell must hold the same trials, identities and truth as every other, each trial once, and finite numbers only.

    Rows that lack an identity are in no draw and aren't checked.
    """
    axes = [split, *CELL, "predictor"]
    per = materialize(_support(long, axes, split))
    guard_none(per.filter("bad > 0"), "truth or predictions are not finite")
    same = per.groupBy(split, "target").agg(*[f(c).alias(f"{n}_{c}") for c in ("n", "d", "y") for n, f in (("lo", F.min), ("hi", F.max))])
    guard_none(same.filter("lo_n <> hi_n or lo_d <> hi_d or lo_y <> hi_y"), "models or cells do not share truth and test support")
    cells = per.select(*axes).distinct()
    sizes = cells.agg(F.count(F.lit(1)).alias("n"), *[F.count_distinct(c).alias(c) for c in axes]).first()
    expected = 1
    for c in axes:
        expected *= sizes[c]
    if sizes.n != expected:
        raise EvaluationError(f"grid holds {sizes.n} of {expected} cells")
    if isinstance(long, R.Spread):
        only = long.rows
    else:  # all cells hold the same rows, so one of them shows a repeated trial
        only = long
        for c, v in per.select(*CELL, "predictor", "target").first().asDict().items():
            only = only.filter(F.col(c) == v)
    guard_none(only.dropna(subset=["subject_uid", "stimulus_uid"]).groupBy(split, "trial_uid").count().filter("count > 1"), "duplicate trial in a grid cell")


def score_draws(long: DataFrame | R.Spread, *, draws: int, seed: int, validate: bool = True) -> DataFrame:
    """Draw table ``(draw, representation, p, s, predictor, macro_ccc, macro_mae)`` averaged over splits."""
    if draws < LEAST_DRAWS:
        raise EvaluationError(f"at least {LEAST_DRAWS} bootstrap draws are required")
    keys, spread = [*CELL, "predictor"], isinstance(long, R.Spread)
    if validate:
        check_grid(long)
    sums = long if spread else R.pair_table(long, keys, ["subject_uid", "stimulus_uid"])
    n = (sums.rows if spread else sums).select("seed").distinct().count()
    return materialize(R.mean_over_splits(R.crossed_bootstrap(sums, keys, draws=draws, seed=seed), keys, n))


def added_value_analysis(draws: DataFrame, *, method: str = "percentile", df: int | None = None) -> DataFrame:
    """Observed CCC with its interval, and observed MAE, per (model, p, s, predictor)."""
    keys = [*CELL, "predictor"]
    mae = draws.filter("draw = 0").selectExpr(*keys, "macro_mae")
    return intervals(draws, keys, "macro_ccc", method=method, df=df).withColumnRenamed("estimate", "macro_ccc").join(mae, keys)


def contrast_draws(draws: DataFrame, contrasts: dict = CONTRASTS) -> DataFrame:
    """Draws of each named difference ``(draw, cell, contrast, ccc_delta, mae_delta)``."""
    names = sorted({p for pair in contrasts.values() for p in pair})
    wide = draws.groupBy("draw", *CELL).pivot("predictor", names).agg(F.first("macro_ccc").alias("c"), F.first("macro_mae").alias("m"))
    rows = ", ".join(
        f"struct('{n}' AS contrast, {a}_c - {b}_c AS ccc_delta, {a}_m - {b}_m AS mae_delta)" for n, (a, b) in contrasts.items()
    )
    return wide.selectExpr("draw", *CELL, f"inline(array({rows}))")


def simultaneous_band(deltas: DataFrame, keys: Sequence[str], family: Sequence[str], value: str, level: float = 0.95) -> DataFrame:
    """Half-width per family: quantile of the largest deviation over its cells.

    Only draws that are finite in every cell of the family count.
    """
    observed = deltas.filter("draw = 0").selectExpr(*keys, f"{value} AS _obs")
    per_draw = deltas.filter("draw > 0").join(observed, list(keys)).groupBy(*family, "draw").agg(
        F.expr(f"if(count({value}) = count(*), max(abs({value} - _obs)), null)").alias("_e")
    )
    return per_draw.groupBy(*family).agg(F.expr(f"percentile(_e, {level}D)").alias("radius"))


def paired_contrasts(draws: DataFrame, *, method: str = "percentile", df: int | None = None, contrasts: dict = CONTRASTS) -> DataFrame:
    """Five named contrasts per cell with pointwise intervals and simultaneous bands."""
    deltas = materialize(contrast_draws(draws, contrasts))
    keys = [*CELL, "contrast"]
    c = intervals(deltas, keys, "ccc_delta", method=method, df=df).selectExpr(
        *keys, "estimate AS ccc_delta", "ci_low AS ccc_ci_low", "ci_high AS ccc_ci_high", "valid_bootstrap"
    )
    m = intervals(deltas, keys, "mae_delta", method=method, df=df).selectExpr(
        *keys, "estimate AS mae_delta", "ci_low AS mae_ci_low", "ci_high AS mae_ci_high"
    )
    band = simultaneous_band(deltas, keys, ["representation", "contrast"], "ccc_delta")
    return c.join(m, keys).join(band, ["representation", "contrast"]).selectExpr(
        *c.columns, "mae_delta", "mae_ci_low", "mae_ci_high",
        "ccc_delta - radius AS ccc_simultaneous_low", "ccc_delta + radius AS ccc_simultaneous_high",
    )


def _trapezoid(values: Sequence[float]) -> dict:
    v = sorted(values)
    if len(v) < 2:
        return {v[0]: 1.0}
    w = dict.fromkeys(v, 0.0)
    for a, b in zip(v, v[1:]):
        w[a] += (b - a) / 2
        w[b] += (b - a) / 2
    return {k: x / (v[-1] - v[0]) for k, x in w.items()}


def _weights(p: Sequence[float], s: Sequence[float]) -> str:
    if len(p) < 2 or len(s) < 2:
        return f"{1 / (len(p) * len(s))!r}D"
    wp, ws = _trapezoid(p), _trapezoid(s)

    def case(column, w):
        return f"case {column}" + "".join(f" when {k} then {x!r}D" for k, x in w.items()) + " end"

    return f"({case('participant_dose', wp)}) * ({case('stimulus_dose', ws)})"


def doses(draws: DataFrame) -> tuple[list, list]:
    """The two dose axes; both are short lists by construction."""
    return tuple(sorted(r[0] for r in draws.select(c).distinct().collect()) for c in ("participant_dose", "stimulus_dose"))


def _whole(value: str, weight: str, alias: str) -> Column:
    return F.expr(f"if(count({value}) = count(*), sum({weight} * {value}), null)").alias(alias)


def surface_auc(draws: DataFrame, keys: Sequence[str], value: str, p: Sequence[float], s: Sequence[float]) -> DataFrame:
    """Normalised two-dimensional trapezoid over the dose grid per (keys, draw)."""
    return draws.groupBy(*keys, "draw").agg(_whole(value, _weights(p, s), "auc"))


def corners(draws: DataFrame, keys: Sequence[str], value: str, p: Sequence[float], s: Sequence[float]) -> DataFrame:
    """The four corner values ``c00 c10 c01 c11`` (participant end, stimulus end) per (keys, draw)."""
    def at(a, b):
        return F.expr(f"max(case when participant_dose = {a} and stimulus_dose = {b} then {value} end)")

    return draws.groupBy(*keys, "draw").agg(
        at(p[0], s[0]).alias("c00"), at(p[-1], s[0]).alias("c10"), at(p[0], s[-1]).alias("c01"), at(p[-1], s[-1]).alias("c11")
    )


def surface_changes(draws: DataFrame, keys: Sequence[str], value: str, p, s) -> DataFrame:
    """Endpoint changes along each axis, jointly, and their interaction, as ``(keys, draw, change, value)``."""
    return corners(draws, keys, value, p, s).selectExpr(
        *keys, "draw",
        "inline(array(struct('participant_change' AS change, c10 - c00 AS value), struct('stimulus_change' AS change, c01 - c00 AS value), "
        "struct('joint_change' AS change, c11 - c00 AS value), struct('endpoint_interaction' AS change, c11 - c10 - c01 + c00 AS value)))",
    )


def uniform_mean_increment(draws: DataFrame) -> DataFrame:
    """Equal-cell mean of the matched increment per (representation, draw)."""
    d = contrast_draws(draws, {"m": ("combined_personalized", "prior_personalized")})
    n = "count(*)"
    return d.groupBy("representation", "draw").agg(
        *[F.expr(f"if(count({m}_delta) = {n}, avg({m}_delta), null)").alias(f"matched_{m}") for m in ("ccc", "mae")]
    )


def paired_models(draws: DataFrame, pairs: Sequence[tuple[str, str, str]]) -> DataFrame:
    """Model A minus B, raw and adjusted for the prior, averaged over cells, as draws."""
    wide = draws.filter("predictor in ('combined_personalized', 'prior_personalized')").groupBy("draw", *CELL).agg(*[
        F.expr(f"max(case when predictor = '{p}' then macro_{m} end)").alias(f"{k}_{m}")
        for k, p in (("c", "combined_personalized"), ("b", "prior_personalized")) for m in ("ccc", "mae")
    ])
    out = None
    for name, a, b in pairs:
        key = ["draw", "participant_dose", "stimulus_dose"]
        left, right = (wide.filter(F.col("representation") == x).drop("representation") for x in (a, b))
        right = right.selectExpr(*key, *[f"{c} AS o_{c}" for c in right.columns if c not in key])
        both = left.join(right, key)
        rows = ", ".join(
            f"struct('combined_uniform_mean_{m}' AS contrast, c_{m} - o_c_{m} AS v), "
            f"struct('matched_added_uniform_mean_{m}' AS contrast, c_{m} - o_c_{m} - (b_{m} - o_b_{m}) AS v)" for m in ("ccc", "mae")
        )
        long = both.selectExpr(*key, f"inline(array({rows}))").groupBy("contrast", "draw").agg(
            F.expr("if(count(v) = count(*), avg(v), null)").alias("value")
        ).withColumn("pair", F.lit(name))
        out = long if out is None else out.unionByName(long)
    return out


def pretrained_minus_random(draws: DataFrame) -> DataFrame:
    """``*_pretrained`` minus ``*_random``: AUC, zero and maximum cell, and the reversal indicator, as draws."""
    p, s = doses(draws)
    v = draws.filter("predictor = 'combined_personalized'")
    a = v.filter("representation like '%\\_pretrained'").selectExpr("draw", "participant_dose", "stimulus_dose", "regexp_replace(representation, '_pretrained$', '') AS model", "macro_ccc AS x")
    b = v.filter("representation like '%\\_random'").selectExpr("draw", "participant_dose", "stimulus_dose", "regexp_replace(representation, '_random$', '') AS model", "macro_ccc AS y")
    diff = a.join(b, ["draw", "model", "participant_dose", "stimulus_dose"]).withColumn("d", F.expr("x - y"))
    auc = surface_auc(diff, ["model"], "d", p, s)
    ends = corners(diff, ["model"], "d", p, s)
    return auc.join(ends, ["model", "draw"]).selectExpr("model", "draw", "auc", "c00 AS zero", "c11 AS maximum", "c00 * c11 < 0 AS reversed")


def order_reversal(differences: DataFrame) -> DataFrame:
    """Observed reversal and its frequency over draws with both ends defined."""
    return differences.groupBy("model").agg(
        F.expr("max(case when draw = 0 then cast(reversed as int) end)").alias("observed_reversal"),
        F.expr("count(case when draw > 0 then reversed end)").alias("valid_bootstrap"),
        F.expr("avg(case when draw > 0 then cast(reversed as int) end)").alias("bootstrap_frequency"),
    )


def summary_rows(draws: DataFrame, *, method: str = "percentile", df: int | None = None) -> DataFrame:
    """Surface summaries ``(representation, contrast, estimate, ci_low, ci_high, valid_bootstrap)``."""
    p, s = doses(draws)
    key = ["representation", "contrast"]
    two = draws.filter("predictor in ('prior_personalized', 'combined_personalized')")
    auc = surface_auc(two, ["representation", "predictor"], "macro_ccc", p, s).selectExpr(
        "representation", "concat(predictor, '_surface_auc') AS contrast", "draw", "auc AS value"
    )
    change = surface_changes(two, ["representation", "predictor"], "macro_ccc", p, s).selectExpr(
        "representation", "concat(predictor, '_', change) AS contrast", "draw", "value"
    )
    added = contrast_draws(draws, {"m": ("combined_personalized", "prior_personalized")})
    added_auc = surface_auc(added, ["representation"], "ccc_delta", p, s).selectExpr(
        "representation", "'matched_eeg_added_surface_auc' AS contrast", "draw", "auc AS value"
    )
    mean = uniform_mean_increment(draws).selectExpr(
        "representation", "draw", "inline(array(struct('matched_eeg_added_uniform_mean_ccc' AS contrast, matched_ccc AS value), "
        "struct('matched_eeg_added_uniform_mean_mae' AS contrast, matched_mae AS value)))",
    ).select("representation", "contrast", "draw", "value")
    rows = auc.unionByName(change).unionByName(added_auc).unionByName(mean)
    return intervals(rows, key, "value", method=method, df=df)


def block_primary_draws(long: DataFrame | R.Spread, *, draws: int, seed: int) -> DataFrame:
    """Matched-increment draws per cell; ``valid`` only if every cell of the draw is defined."""
    two = ("prior_personalized", "combined_personalized")
    if isinstance(long, R.Spread):
        long = replace(long, forms=[f for f in long.forms if f[0] in two])
    else:
        long = long.filter(F.col("predictor").isin(*two))
    d = contrast_draws(score_draws(long, draws=draws, seed=seed, validate=False), {"m": ("combined_personalized", "prior_personalized")})
    valid = d.groupBy("representation", "draw").agg(F.expr("count(ccc_delta) = count(*)").alias("valid"))
    return d.join(valid, ["representation", "draw"]).select("draw", *CELL, "ccc_delta", "valid")


def _paired(nested: DataFrame, label: str, first: str, second: str, *, strict: bool, by: Sequence[str] = ()):
    """Differences per (by, draw, slot) averaged over slots; ``strict`` lets one undefined slot undo the draw."""
    key = [*by, "draw", "slot", "seed"]
    a = nested.filter(F.col(label) == first).selectExpr(*key, "macro_ccc AS ca", "macro_mae AS ma")
    b = nested.filter(F.col(label) == second).selectExpr(*key, "macro_ccc AS cb", "macro_mae AS mb")
    d = a.join(b, key).selectExpr(*key, "ca - cb AS ccc", "ma - mb AS mae")
    whole = "if(count({0}) = count(*), avg({0}), null)" if strict else "avg({0})"
    return d.groupBy(*by, "draw").agg(*[F.expr(whole.format(m)).alias(f"{m}_delta") for m in ("ccc", "mae")]), d


def paired_protocol_analysis(long: DataFrame | R.Spread, pairs: Sequence[tuple[str, str]], clusters: Sequence[str], *, label: str = "model", draws: int, seed: int, retries: int = 0, strict: bool = True, by: Sequence[str] = ()) -> DataFrame:
    """Paired comparisons: splits resampled, then clusters; deltas, intervals and exact sign flips.

    ``by`` names the columns of a grid of cells: all cells share the draws, and
    each comparison is made in each cell.
    """
    by = list(by)
    nested = materialize(R.nested_draws(long, [*by, label], clusters, draws=draws, seed=seed, retries=retries))
    out = None
    for first, second in pairs:
        per_draw, per_slot = (t.withColumn("_k", F.lit(1)) for t in _paired(nested, label, first, second, strict=strict, by=by))
        key, part = [*by, "_k"], None
        for m in ("ccc", "mae"):
            ci = intervals(per_draw, key, f"{m}_delta")
            p = sign_flip_pvalue(per_slot.filter("draw = 0"), key, m)
            row = ci.join(p, key).selectExpr(*key, f"estimate AS {m}_delta", f"ci_low AS {m}_ci_low", f"ci_high AS {m}_ci_high", f"p_value AS {m}_p_value")
            part = row if part is None else part.join(row, key)
        part = part.drop("_k").withColumn("comparison", F.lit(f"{first}_vs_{second}"))
        out = part if out is None else out.unionByName(part)
    return out


def ablation_analysis(long: DataFrame | R.Spread, clusters: Sequence[str], *, label: str = "view_id", draws: int, seed: int, by: Sequence[str] = ()) -> DataFrame:
    """Every feature view against ``full``; empty crossed draws are redrawn up to 100 times."""
    if isinstance(long, R.Spread):
        views = sorted({f[0] for f in long.forms})
    else:
        views = sorted(r[0] for r in long.select(label).distinct().collect())  # feature views are few
    if "full" not in views:
        raise EvaluationError("the view that others are compared with is absent")
    pairs = [(v, "full") for v in views if v != "full"]
    return paired_protocol_analysis(long, pairs, clusters, label=label, draws=draws, seed=seed, retries=100, strict=False, by=by)


def _cluster_mean_draws(sums: DataFrame, groups: Sequence[str], values: Sequence[str], *, cluster: str, draws: int, seed: int) -> DataFrame:
    """Splits then clusters resampled; weighted means ``values / n`` averaged over slots.

    ``sums`` has one row per (groups, seed, cluster) with the sums ``values``
    and the matching counts ``n_{value}``.
    """
    groups, width = list(groups), 2 * len(values)
    choices = R.seed_choices(sums, draws=draws, seed=seed)
    # conditions and splits are few; those with the same clusters share ranks and draws, and are places of one vector
    found = sums.groupBy(*groups, "seed").agg(support_digest(cluster).alias("_ids")).collect()
    classes, named = {}, []
    for r in sorted(found):
        members = classes.setdefault((r["seed"], r["_ids"]), [len(classes)])
        named.append((members[0], len(members) - 1, *[r[c] for c in (*groups, "seed")]))
        members.append(r)
    names = sums.sparkSession.createDataFrame(
        named, "_group bigint, _at int, " + ", ".join(f"{c} {dict(sums.dtypes)[c]}" for c in (*groups, "seed")),
    )
    pairs = ", ".join(f"cast({v} as double), cast(n_{v} as double)" for v in values)
    packed = sums.join(F.broadcast(names), [*groups, "seed"]).groupBy("_group", cluster).agg(
        F.collect_list(F.expr(f"sequence({width} * _at, {width} * _at + {width - 1})")).alias("_p"), F.collect_list(F.expr(f"array({pairs})")).alias("_v"),
    )
    rows = R.ranked(packed, {cluster: cluster}, ["_group"]).selectExpr("_group", "_r0", "_n0", "flatten(_p) AS _pos", "flatten(_v) AS _values")
    spec = names.select("_group", "seed").distinct().join(choices, "seed").selectExpr("_group", "cast(draw as bigint) * 1000000 + slot AS draw")
    most = max(at for _, at, *_ in named) + 1
    parts = weighted_sums(materialize(rows), axes=[cluster], width=width * most, seed=seed, draws=R.chosen_draws(spec, "_group"))
    each = parts.filter("draw > 0").selectExpr("_group", "draw", f"posexplode(transform(sequence(0, {most - 1}), i -> slice(sums, {width} * i + 1, {width}))) AS (_at, s)")
    totals = each.groupBy("_group", "_at", "draw").agg(*[F.sum(F.col("s")[k]).alias(f"_{k}") for k in range(width)])
    drawn = totals.join(F.broadcast(names), ["_group", "_at"]).selectExpr(
        *groups, "cast(draw div 1000000 as int) AS draw", "seed", *[f"_{2 * i} / nullif(_{2 * i + 1}, 0) AS {v}" for i, v in enumerate(values)]
    )
    observed = sums.groupBy(*groups, "seed").agg(*[F.expr(f"sum({v}) / nullif(sum(n_{v}), 0)").alias(v) for v in values]).selectExpr(
        *groups, "0 AS draw", "seed", *values
    )
    return drawn.unionByName(observed)


def condition_effects(df: DataFrame, *, baseline: str, candidates: Sequence[str], draws: int, seed: int, names=("valence", "arousal"), contrasts: Sequence[tuple[str, str, str]] = (), by: Sequence[str] = ()) -> DataFrame:
    """MAE deltas against the baseline per condition, and named contrasts of two conditions.

    Output ``(by, kind, name, candidate, estimate, ci_low, ci_high, p_value)``;
    ``by`` names the columns of a grid of cells that share the draws.
    """
    by = list(by)
    k = len(names)
    delta = {c: " + ".join(f"abs({c}_{n} - target_{n}) - abs({baseline}_{n} - target_{n})" for n in names) for c in candidates}
    rows = df.selectExpr(*by, "seed", "subject_uid", "context", *[f"({e}) / {k} AS d_{c}" for c, e in delta.items()])
    parts = []
    for c in candidates:
        per = materialize(rows.groupBy(*by, "seed", "subject_uid", F.col("context").alias("name")).agg(F.sum(f"d_{c}").alias("v"), F.count(F.lit(1)).alias("n_v")))
        d = _cluster_mean_draws(per, [*by, "name"], ["v"], cluster="subject_uid", draws=draws, seed=seed)
        parts.append(d.selectExpr(*by, "'condition' AS kind", "name", f"'{c}' AS candidate", "draw", "seed", "v AS value"))
        for name, a, b in contrasts:
            both = rows.filter(F.col("context").isin(a, b)).groupBy(*by, "seed", "subject_uid").agg(
                F.expr(f"coalesce(sum(d_{c}) filter (where context = '{a}'), 0)").alias("va"), F.expr(f"count_if(context = '{a}')").alias("n_va"),
                F.expr(f"coalesce(sum(d_{c}) filter (where context = '{b}'), 0)").alias("vb"), F.expr(f"count_if(context = '{b}')").alias("n_vb"),
            ).withColumn("name", F.lit(name))
            both = materialize(both)
            d = _cluster_mean_draws(both, [*by, "name"], ["va", "vb"], cluster="subject_uid", draws=draws, seed=seed)
            parts.append(d.selectExpr(*by, "'contrast' AS kind", "name", f"'{c}' AS candidate", "draw", "seed", "va - vb AS value"))
    long = parts[0]
    for p in parts[1:]:
        long = long.unionByName(p)
    long = materialize(long)
    keys = [*by, "kind", "name", "candidate"]
    per_draw = long.groupBy(*keys, "draw").agg(F.expr("if(count(value) = count(*), avg(value), null)").alias("value"))
    return intervals(per_draw, keys, "value").join(sign_flip_pvalue(long.filter("draw = 0"), keys, "value"), keys)


def fit_selector(long: DataFrame) -> DataFrame:
    """Validation scores per (cell, candidate) with the global and the per-cell choice.

    Both rules use the same macro CCC averaged over splits; exact ties go to the
    first candidate in name order.
    """
    cell = ["participant_dose", "stimulus_dose"]
    per = scores_from_sums(pair_sums(long, ["seed", *cell, "candidate", "target"]), ["seed", *cell, "candidate"])
    n = long.select("seed").distinct().count()
    mean = materialize(per.groupBy(*cell, "candidate").agg(F.expr(f"if(count(macro_ccc) = {n}, avg(macro_ccc), null)").alias("score")))
    guard_none(mean.filter("score is null"), "a candidate has no validation score to rank by")
    best = "max_by(candidate, struct(score, -rank))"
    names = mean.select("candidate").distinct().selectExpr("candidate", "dense_rank() over (order by candidate) AS rank")  # few candidates
    ranked = mean.join(F.broadcast(names), "candidate")
    overall = ranked.groupBy("candidate").agg(F.avg("score").alias("score"), F.first("rank").alias("rank")).agg(F.expr(best).alias("global_choice"))
    choice = ranked.groupBy(*cell).agg(F.expr(best).alias("cell_choice"))
    return mean.join(choice, cell).crossJoin(overall)


def selector_digest(choices: DataFrame) -> DataFrame:
    """One digest of the frozen decision, bound to every score and choice."""
    line = F.concat_ws("|", "participant_dose", "stimulus_dose", "candidate", F.format_number("score", 9), "cell_choice", "global_choice")
    return choices.select(line.alias("trial_uid")).agg(support_digest().alias("decision_digest"))


def evaluate_selector(choices: DataFrame, validation: DataFrame, test: DataFrame, *, draws: int, seed: int) -> DataFrame:
    """Per-cell choice minus global choice on an identity-disjoint test table."""
    for c in ("trial_uid", "subject_uid", "stimulus_uid"):
        guard_none(test.select(c).distinct().join(validation.select(c), c, "left_semi"), f"selector test overlaps validation in {c}")
    cell = ["participant_dose", "stimulus_dose"]
    picks = choices.select(*cell, "cell_choice", "global_choice").distinct()  # one row per cell
    rows = test.join(F.broadcast(picks), cell)
    long = rows.filter("candidate = cell_choice").withColumn("predictor", F.lit("conditional")).unionByName(
        rows.filter("candidate = global_choice").withColumn("predictor", F.lit("global"))
    ).withColumn("representation", F.lit("selector"))
    d = materialize(contrast_draws(score_draws(long, draws=draws, seed=seed, validate=False), {"d": ("conditional", "global")}))
    out = None
    for m in ("ccc", "mae"):
        per_cell = intervals(d, cell, f"{m}_delta").crossJoin(
            simultaneous_band(d, [*cell, "contrast"], ["contrast"], f"{m}_delta").select("radius")
        )
        surface = d.groupBy("draw").agg(F.expr(f"if(count({m}_delta) = count(*), avg({m}_delta), null)").alias("v")).withColumn("_k", F.lit(1))
        whole = intervals(surface, ["_k"], "v").selectExpr(
            "cast(null as int) AS participant_dose", "cast(null as int) AS stimulus_dose", "estimate", "ci_low", "ci_high", "valid_bootstrap", "cast(null as double) AS radius"
        )
        part = per_cell.unionByName(whole).withColumn("metric", F.lit(m))
        out = part if out is None else out.unionByName(part)
    return out


def dose_response_summary(scores: DataFrame, keys: Sequence[str], value: str = "macro_ccc") -> DataFrame:
    """Endpoint scores, normalised AUC, first-trial gain and half-gain dose along the participant axis."""
    p, s = doses(scores)
    w = _weights(p, s)
    at = "max(case when participant_dose = {0} and stimulus_dose = {1} then " + value + " end)"
    base = scores.groupBy(*keys).agg(
        F.expr(at.format(p[0], s[0])).alias("zero_exposure"), F.expr(at.format(p[-1], s[-1])).alias("maximum_exposure"),
        F.expr(f"sum({w} * {value})").alias("normalized_surface_auc"),
        F.expr(f"{at.format(p[1], s[0])} - {at.format(p[0], s[0])}").alias("first_participant_trial_gain"),
        F.expr(at.format(p[-1], s[0])).alias("_end"),
    )
    half = scores.filter(F.col("stimulus_dose") == s[0]).join(base, list(keys)).filter(
        f"_end > zero_exposure + 1e-12 and {value} - zero_exposure >= (_end - zero_exposure) / 2"
    ).groupBy(*keys).agg(F.min("participant_dose").alias("participant_half_gain_dose"))
    return base.drop("_end").join(half, list(keys), "left")
