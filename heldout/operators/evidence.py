"""Replicate summaries, evidence tables and document checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heldout.functions.checks import guard_none, require_columns
from heldout.functions.formulas import t_quantile_975, wilson

SLACK = 1e-12


def wilson_interval(df: DataFrame, successes: str, total: str) -> DataFrame:
    low, high = wilson(F.col(successes), F.col(total))
    return df.withColumns({"wilson_low": low, "wilson_high": high})


def coverage_summary(replicates: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Coverage, detection, bias and width per setting, with Wilson intervals over replicates."""
    require_columns(replicates, [*keys, "truth", "estimate", "ci_low", "ci_high"])
    usable = "ci_low is not null and ci_high is not null and not isnan(ci_low) and not isnan(ci_high)"
    rows = replicates.selectExpr(
        "*", f"{usable} AS _u", f"ci_low <= truth + {SLACK} and truth <= ci_high + {SLACK} AS _c", f"ci_low > {SLACK} AS _d"
    )
    agg = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("replicates"), F.expr("count_if(_u)").alias("valid_replicates"),
        F.expr("count_if(_u and _c)").alias("covered"), F.expr("count_if(_u and _d)").alias("detected"),
        F.avg("truth").alias("truth"), F.expr("avg(case when _u then estimate - truth end)").alias("bias"),
        F.expr("avg(case when _u then ci_high - ci_low end)").alias("mean_width"),
    )
    for name in ("covered", "detected"):
        low, high = wilson(F.col(name), F.col("valid_replicates"))
        agg = agg.withColumns({f"{name}_low": low, f"{name}_high": high})
    return agg.selectExpr(
        *keys, "replicates", "valid_replicates", "covered / valid_replicates AS coverage", "covered_low AS coverage_mc_low",
        "covered_high AS coverage_mc_high", "detected / valid_replicates AS detection", "detected_low AS detection_mc_low",
        "detected_high AS detection_mc_high", f"if(truth <= {SLACK}, 'false_positive', 'power') AS detection_means", "bias", "mean_width",
    )


def simultaneous_coverage(replicates: DataFrame, keys: Sequence[str], replicate: str = "replicate") -> DataFrame:
    """Share of replicates whose cells are all covered."""
    per = replicates.groupBy(*keys, replicate).agg(
        F.expr(f"bool_and(ci_low <= truth + {SLACK} and truth <= ci_high + {SLACK})").alias("all_covered")
    )
    return per.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("replicates"), F.avg(F.col("all_covered").cast("double")).alias("simultaneous_coverage")
    )


def rescale_intervals(replicates: DataFrame) -> DataFrame:
    """normal_t intervals to block_t by the ratio of t quantiles, with coverage recomputed."""
    require_columns(replicates, ["method", "n_blocks", "cluster_df", "estimate", "truth", "ci_low", "ci_high"])
    rows = replicates.filter("method = 'normal_t'").withColumn(
        "_r", (F.col("ci_high") - F.col("ci_low")) / 2 * t_quantile_975(F.col("n_blocks") - 1) / t_quantile_975(F.col("cluster_df"))
    )
    keep = [c for c in replicates.columns if c not in ("method", "ci_low", "ci_high", "covered", "positive")]
    return rows.selectExpr(
        *keep, "'block_t' AS method", "estimate - _r AS ci_low", "estimate + _r AS ci_high",
        f"estimate - _r - {SLACK} <= truth and truth <= estimate + _r + {SLACK} AS covered", f"estimate - _r > {SLACK} AS positive",
    )


def verify_summary(stored: DataFrame, recomputed: DataFrame, keys: Sequence[str], values: Sequence[str], tolerance: float = SLACK) -> DataFrame:
    """Rows of a stored summary that are missing, extra, repeated or off by more than the tolerance."""
    s = stored.groupBy(*keys).agg(F.count(F.lit(1)).alias("_ns"), *[F.max(v).alias(f"_s_{v}") for v in values])
    r = recomputed.select(*keys, *[F.col(v).alias(f"_r_{v}") for v in values], F.lit(1).alias("_nr"))
    off = " or ".join(f"not (abs(_s_{v} - _r_{v}) <= {tolerance!r}D or (_s_{v} is null and _r_{v} is null))" for v in values)
    return s.join(r, list(keys), "full_outer").selectExpr(
        *keys, f"case when _ns is null then 'missing' when _nr is null then 'extra' when _ns > 1 then 'repeated' when {off} then 'different' end AS fault",
    ).filter("fault is not null")


def score_decomposition(scores: DataFrame, keys: Sequence[str], *, setting: str = "representation") -> DataFrame:
    """total = calibration + matched per cell, with the identity error and prior parity across settings."""
    wide = scores.groupBy(*keys, setting).pivot("predictor", ["prior", "prior_personalized", "combined_personalized"]).agg(F.first("macro_ccc"))
    cells = wide.selectExpr(
        *keys, setting, "prior", "prior_personalized", "combined_personalized",
        "combined_personalized - prior AS total", "prior_personalized - prior AS calibration", "combined_personalized - prior_personalized AS matched",
    ).withColumn("arithmetic_error", F.expr("total - calibration - matched"))
    parity = cells.groupBy(*keys).agg(
        F.expr(f"max(prior) - min(prior) <= {SLACK} and max(prior_personalized) - min(prior_personalized) <= {SLACK}").alias("prior_parity"),
    )
    return cells.join(parity, list(keys))


def missing_cells(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Cells of the full product of the key values that are absent."""
    grid = None
    for k in keys:
        axis = df.select(k).distinct()
        grid = axis if grid is None else grid.crossJoin(axis)
    return grid.join(df.select(*keys).distinct(), list(keys), "left_anti")


def interval_method_join(left: DataFrame, right: DataFrame, keys: Sequence[str], *, suffixes=("p", "t"), validate: bool = True) -> DataFrame:
    """The same estimate under two interval methods side by side."""
    a, b = suffixes
    x = left.selectExpr(*keys, "estimate", f"ci_low AS ci_low_{a}", f"ci_high AS ci_high_{a}")
    y = right.selectExpr(*keys, "estimate AS _e", f"ci_low AS ci_low_{b}", f"ci_high AS ci_high_{b}")
    both = x.join(y, list(keys), "full_outer")
    if validate:
        guard_none(both.filter(f"not coalesce(abs(estimate - _e) <= {SLACK}, false)"), "interval methods changed the estimate")
    return both.drop("_e")


def sensitivity_summary(runs: DataFrame, keys: Sequence[str], *, reference: str) -> DataFrame:
    """Largest shift from the reference run, intervals covering zero, and the range of estimates."""
    base = runs.filter(F.col("run") == reference).selectExpr(*keys, "estimate AS _base")
    return runs.join(base, list(keys)).groupBy(*keys).agg(
        F.expr("max(abs(estimate - _base))").alias("largest_absolute_shift"), F.expr("count_if(ci_low <= 0 and ci_high >= 0)").alias("intervals_covering_zero"),
        F.min("estimate").alias("estimate_min"), F.max("estimate").alias("estimate_max"), F.expr("max(estimate) - min(estimate)").alias("span"),
        F.count(F.lit(1)).alias("runs"),
    )


def heterogeneity_summary(contrasts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Range and counts of intervals above and below zero, pointwise and simultaneous."""
    return contrasts.groupBy(*keys).agg(
        F.min("ccc_delta").alias("minimum"), F.max("ccc_delta").alias("maximum"),
        F.expr("count_if(ccc_ci_low > 0)").alias("positive_pointwise"), F.expr("count_if(ccc_ci_high < 0)").alias("negative_pointwise"),
        F.expr("count_if(ccc_simultaneous_low > 0)").alias("positive_dose_family"), F.expr("count_if(ccc_simultaneous_high < 0)").alias("negative_dose_family"),
    )


def dose_corners(contrasts: DataFrame) -> DataFrame:
    ends = contrasts.agg(*[f(c).alias(f"_{n}_{c[0]}") for c in ("participant_dose", "stimulus_dose") for n, f in (("lo", F.min), ("hi", F.max))])
    return contrasts.crossJoin(ends).filter(
        "participant_dose in (_lo_p, _hi_p) and stimulus_dose in (_lo_s, _hi_s)"
    ).select(*contrasts.columns)


def learning_summary(fits: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Median, range and first-epoch counts of the selected epochs per branch."""
    return fits.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("fit_records"), F.expr("count_if(selected_epochs = 1)").alias("selected_epoch_one"),
        F.expr("percentile(selected_epochs, 0.5D)").alias("selected_epoch_median"), F.min("selected_epochs").alias("selected_epoch_min"),
        F.max("selected_epochs").alias("selected_epoch_max"),
        F.expr("percentile(initial_objective - final_objective, 0.5D)").alias("median_objective_reduction"),
    )


def audit_confusion(cases: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Detected violations, false allows and blocks, and retained unknowns per group."""
    return cases.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("cases"), F.expr("count_if(expected = 'block')").alias("violations"),
        F.expr("count_if(expected = 'block' and observed = 'block')").alias("detected_violations"),
        F.expr("count_if(expected <> 'allow' and observed = 'allow')").alias("false_allows"),
        F.expr("count_if(expected = 'allow')").alias("clean_cases"),
        F.expr("count_if(expected = 'allow' and observed = 'block')").alias("false_blocks"),
        F.expr("count_if(expected = 'unverifiable')").alias("unknown_cases"),
        F.expr("count_if(expected = 'unverifiable' and observed = 'unverifiable')").alias("retained_unknown"),
        F.expr("percentile(runtime_ms, 0.5D)").alias("median_runtime_ms"),
    )


def validate_predictions(df: DataFrame, *, key: Sequence[str], numeric: Sequence[str], protocols: Sequence[str], seeds: Sequence[int]) -> DataFrame:
    """Constraint table ``(check, item, violations)`` of a prediction archive."""
    require_columns(df, ["protocol", "seed", "trial_uid", *key, *numeric])
    bad = {c: F.expr(f"count_if({c} is null or isnan({c}) or abs({c}) = double('inf'))").alias(c) for c in numeric}
    finite = df.agg(*bad.values()).unpivot([], list(numeric), "item", "violations").selectExpr("'non_finite' AS check", "item", "violations")
    repeated = df.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("violations"))
    out = finite.unionByName(repeated.selectExpr("'duplicate_key' AS check", "'all' AS item", "violations"))
    known = ", ".join(f"'{p}'" for p in protocols)
    want = ", ".join(str(int(s)) for s in seeds)
    per = df.groupBy("protocol").agg(F.collect_set("seed").alias("_s"), F.count(F.lit(1)).alias("n"))  # seeds are few
    rows = per.selectExpr(
        "protocol AS item", f"inline(array(struct('unknown_protocol' AS check, cast(protocol not in ({known}) as bigint) AS violations), "
        f"struct('missing_seed' AS check, cast(size(array_except(array({want}), transform(_s, x -> cast(x as int)))) as bigint) AS violations), "
        f"struct('unexpected_seed' AS check, cast(size(array_except(transform(_s, x -> cast(x as int)), array({want}))) as bigint) AS violations), "
        "struct('row_count' AS check, n AS violations)))",
    )
    return out.unionByName(rows.select("check", "item", "violations"))


def resolve_claims(claims: DataFrame, table: DataFrame) -> DataFrame:
    """Claims ``(claim_id, table, where map, value_column, reduction, expected, tolerance, decimals)`` against a long table.

    ``table`` is ``(table, row_id, column, text, number)``.  A row is selected
    if it meets every condition of the selector.
    """
    # selectors use few distinct column sets; all columns of a set are matched in one equi-join
    sets = [r[0] for r in claims.select(F.sort_array(F.map_keys("where")).alias("k")).distinct().collect()]
    hits = None
    for columns in sets:
        names = [f"_c{i}" for i in range(len(columns))]
        quoted = ", ".join("'" + c.replace("'", "\\'") + "'" for c in columns)
        mine = claims.filter(f"sort_array(map_keys(where)) = cast(array({quoted}) as array<string>)").select(
            "claim_id", "table", *[F.col("where")[c].alias(n) for c, n in zip(columns, names)]
        )
        rows = table.groupBy("table", "row_id").agg(
            *[F.max(F.when(F.col("column") == c, F.col("text"))).alias(n) for c, n in zip(columns, names)], F.lit(1).alias("_one")
        )
        part = mine.join(rows, ["table", *names]).select("claim_id", "table", "row_id")
        hits = part if hits is None else hits.unionByName(part)
    values = hits.join(claims.select("claim_id", F.col("value_column").alias("column")), "claim_id").join(
        table.select("table", "row_id", "column", "number"), ["table", "row_id", "column"]
    )
    reduced = values.groupBy("claim_id").agg(F.count(F.lit(1)).alias("rows"), F.avg("number").alias("value"))
    out = claims.join(reduced, "claim_id", "left")
    return out.selectExpr(
        "claim_id", "table", "coalesce(rows, 0L) AS rows", "value",
        "case when rows is null then 'no_rows' when reduction = 'first' and rows <> 1 then 'several_rows' when reduction not in ('first', 'mean') then 'unknown_reduction' "
        "when value is null or isnan(value) then 'not_finite' when abs(value - expected) > tolerance then 'numeric_drift' else 'ok' end AS status",
        "replace(format_number(value, decimals), ',', '') AS display_value",
    )


def ordered_ranks(df: DataFrame, column: str, order: Sequence[str]) -> DataFrame:
    """Rank column of a fixed display order; unknown values sort last."""
    cases = " ".join(f"when '{v}' then {i}" for i, v in enumerate(order))
    return df.withColumn(f"{column}_rank", F.expr(f"case {column} {cases} else 999 end"))


def comparison_tables(rows: DataFrame, *, protocols: Sequence[str], models: Sequence[str]) -> DataFrame:
    """Protocol x model means and sample sd over seeds from flattened benchmark rows, with display ranks."""
    table = rows.groupBy("asset", "protocol", "model", "context", "target", "metric").agg(
        F.avg("value").alias("mean"), F.coalesce(F.stddev_samp("value"), F.lit(0.0)).alias("sample_sd"), F.count_distinct("seed").alias("seed_count")
    )
    return ordered_ranks(ordered_ranks(table, "protocol", protocols), "model", models)


# Fixed patterns: home and opt paths, a user profile path, an e-mail address.
SENSITIVE = (
    r"/home/[^/\s]+",
    r"/opt/(?:[^/\s]+/)*[^/\s]+",
    r"(?i)[A-Z]:\\Users\\[^\\\s]+",
    r"(?i)\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b",
)


def scan_sensitive_text(docs: DataFrame, text: str = "text", *, forbidden: Sequence[str] = (), path: str | None = None, suffixes: Sequence[str] = ()) -> DataFrame:
    """Rows whose whole text matches a pattern or literal, or whose path has a forbidden suffix."""
    found = F.lit(False)
    for p in SENSITIVE:
        found = found | F.col(text).rlike(p)
    for literal in forbidden:
        found = found | F.col(text).contains(literal)
    named = F.lit(False)
    if path:
        for s in suffixes:
            named = named | F.lower(path).endswith(s.lower())
    return docs.withColumns({"sensitive_text": F.coalesce(found, F.lit(False)), "forbidden_suffix": F.coalesce(named, F.lit(False))}).filter(
        "sensitive_text or forbidden_suffix"
    )


def protocol_matrix(contract: DataFrame, required: DataFrame) -> DataFrame:
    """``contract(dataset_id, protocols map)`` to rows; missing and extra cells against ``required(protocol)``."""
    rows = contract.selectExpr("dataset_id", "explode(protocols) AS (protocol, status)")
    grid = contract.select("dataset_id").distinct().crossJoin(required.select("protocol").distinct())
    return grid.withColumn("_w", F.lit(1)).join(rows, ["dataset_id", "protocol"], "full_outer").selectExpr(
        "dataset_id", "protocol", "status", "case when status is null then 'missing' when _w is null then 'extra' else 'present' end AS cell"
    )


def cross_model_prior_parity(wide: DataFrame, *, names=("valence", "arousal"), tolerance: float = 1e-10) -> DataFrame:
    """Trials per cell whose priors differ between models, or whose personalised prediction moves at dose 0."""
    priors = [f"{p}_{n}" for p in ("prior", "prior_personalized") for n in names]
    spread = " or ".join(f"max({c}) - min({c}) > {tolerance!r}D" for c in priors)
    zero = " or ".join(
        f"abs({a}_{n} - {b}_{n}) > {tolerance!r}D" for a, b in (("prior", "prior_personalized"), ("combined_population", "combined_personalized")) for n in names
    )
    per = wide.groupBy("seed", "participant_dose", "stimulus_dose", "trial_uid").agg(
        F.expr(spread).alias("differs"), F.expr(f"bool_or(participant_dose = 0 and ({zero}))").alias("moved")
    )
    return per.groupBy("seed", "participant_dose", "stimulus_dose").agg(
        F.count(F.lit(1)).alias("trials"), F.expr("count_if(differs)").alias("prior_mismatches"), F.expr("count_if(moved)").alias("zero_dose_mismatches")
    )


def verify_learning_curves(history: DataFrame, fits: DataFrame, *, least_gain: float = 1e-6) -> DataFrame:
    """Replays early stopping per fit and checks it against the recorded selection.

    ``history(fit_id, epoch, objective, gradient_norm, validation_mae)``; a fit's
    epochs are few, so they are folded in order inside one array per fit.
    """
    curve = history.groupBy("fit_id").agg(
        F.array_sort(F.collect_list(F.struct("epoch", "validation_mae"))).alias("c"),
        F.expr("count_if(isnan(objective) or isnan(gradient_norm) or isnan(validation_mae) or objective is null or gradient_norm is null or validation_mae is null)").alias("bad"),
        F.max("gradient_norm").alias("g"),
    )
    fold = (
        f"aggregate(c, struct(0L AS epoch, double('inf') AS best), (a, x) -> if(x.validation_mae < a.best - {least_gain!r}D, "
        "struct(x.epoch AS epoch, x.validation_mae AS best), a))"
    )
    return fits.join(curve.selectExpr("fit_id", "bad", "g", f"{fold} AS r"), "fit_id", "left").selectExpr(
        "fit_id", "r.epoch AS replayed_epoch", "r.best AS replayed_mae",
        "case when bad is null then 'no_history' when bad > 0 then 'non_finite' when r.epoch <> selected_epochs or refit_epochs <> selected_epochs then 'selection_mismatch' "
        f"when abs(r.best - validation_mae) > {SLACK} then 'score_mismatch' when not (g > 0) then 'no_gradient' else 'ok' end AS status",
    )
