"""Three-state audits of executed identifier sets: allow, block, unverifiable."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heldout.functions.hashing import support_digest
from heldout.sources import documents as D

ROLES = ("train", "validation", "calibration", "test", "preprocessing_fit", "model_selection")
RESOURCES = ("calibration", "population", "evaluation")
PREDICTORS = ("no_eeg", "eeg")
CONTRACT = ("subject_holdout", "stimulus_holdout", "validation_trial_holdout", "require_matched_predictors")
LISTS = (*ROLES, *[f"{p}_{r}" for p in PREDICTORS for r in RESOURCES])
_SCHEMA_NAME = {
    **{r: f"{r}_uid_schema" for r in ROLES[:4]}, "preprocessing_fit": "preprocessing_evidence", "model_selection": "selection_evidence",
    **{f"{p}_{r}": f"{p}_{'population_label' if r == 'population' else r}_trial_uids" for p in PREDICTORS for r in RESOURCES},
}
#: How a declared support digest was made: the order-free sums, or SHA-256 of the sorted identifiers one per line.
SUPPORT_KINDS = ("order_free", "sorted_lines")


def _line_digest(lists: DataFrame) -> DataFrame:
    """SHA-256 of the sorted test identifiers, one per line; it has to gather the test list of an execution."""
    ids = lists.filter("role = 'test'").groupBy("execution_id").agg(F.array_sort(F.collect_set("trial_uid")).alias("_ids"))
    return ids.select("execution_id", F.sha2(F.array_join("_ids", "\n"), 256).alias("actual_lines"))


def workflow_checks(trials: DataFrame, lists: DataFrame, executions: DataFrame, *, extended: bool = True, gather_support: bool = False) -> DataFrame:
    """All checks of all executions as ``(execution_id, check, status)``.

    ``lists(execution_id, role, trial_uid)`` holds every supplied list member.
    ``executions`` has one row per execution: ``declared`` (names of the lists
    that were supplied, possibly empty), the contract booleans, the count of
    ``unsupported_fields``, ``expected_support`` and the two
    ``additional_{predictor}`` name lists.  Everything is counted in two
    aggregations: per (execution, trial) and per (execution, identity).

    A trial table with an absent, blank or repeated ``trial_uid`` blocks every
    execution by the single check ``trial_schema``.  ``support_kind``, if the
    column is there, says how ``expected_support`` was made (``SUPPORT_KINDS``;
    null means order-free).  Digests of sorted lines need all test identifiers
    of an execution in one place: they are checked if ``gather_support`` says
    so and are unverifiable otherwise, as are unknown kinds.
    """
    known = trials.select("trial_uid", "subject_uid", "stimulus_uid").withColumn("_known", F.lit(True))
    member = lists.groupBy("execution_id", "trial_uid").agg(*[F.expr(f"count_if(role = '{r}')").alias(r) for r in LISTS])
    member = member.join(known, "trial_uid", "left")
    agg = []
    for r in LISTS:
        agg.append(F.expr(f"coalesce(sum({r}), 0)").alias(f"n_{r}"))
        agg.append(F.expr(f"count_if({r} > 0 and (_known is null or {r} > 1 or trim(coalesce(trial_uid, '')) = ''))").alias(f"bad_{r}"))

    def both(a, b, name):
        agg.append(F.expr(f"count_if({a} > 0 and {b} > 0)").alias(name))

    for r in ("train", "validation", "calibration", "preprocessing_fit", "model_selection"):
        both(r, "test", f"x_{r}_test")
    both("train", "validation", "x_train_validation")
    roles = {"calibration": "calibration > 0", "evaluation": "test > 0", "population": "train > 0 or validation > 0"}
    for res in RESOURCES:
        a, b = (f"{p}_{res}" for p in PREDICTORS)
        agg.append(F.expr(f"count_if(({a} > 0) <> ({b} > 0))").alias(f"d_{res}"))
        agg.append(F.expr(f"count_if(({a} > 0) <> ({roles[res]}))").alias(f"r_{res}"))
        agg.append(F.expr(f"count_if(({a} > 0 or {b} > 0) and test > 0)").alias(f"t_{res}"))
    facts = member.groupBy("execution_id").agg(*agg)
    for axis in ("subject", "stimulus"):
        c = f"{axis}_uid"
        per = member.filter("_known").groupBy("execution_id", c).agg(
            F.expr("bool_or(test > 0)").alias("te"), F.expr("bool_or(train > 0 or validation > 0 or calibration > 0)").alias("dev"),
            F.expr("bool_or(preprocessing_fit > 0 or model_selection > 0)").alias("pre"),
        )
        overlap = per.groupBy("execution_id").agg(
            F.expr("count_if(te and dev)").alias(f"i_{axis}"), F.expr("count_if(te and pre)").alias(f"p_{axis}")
        )
        facts = facts.join(overlap, "execution_id", "left")
    support = lists.filter("role = 'test'").select("execution_id", "trial_uid").distinct().groupBy("execution_id").agg(support_digest().alias("actual_support"))
    rows = executions.join(facts, "execution_id", "left").join(support, "execution_id", "left")
    uids = trials.groupBy("trial_uid").agg(F.count(F.lit(1)).alias("_n"))
    sound = uids.agg(F.expr("coalesce(bool_and(_n = 1 and trim(coalesce(trial_uid, '')) <> ''), true)").alias("trials_sound"))
    blank = trials.agg(*[F.expr(f"count_if(trim(coalesce({a}_uid, '')) = '')").alias(f"blank_{a}") for a in ("subject", "stimulus")])
    rows = rows.crossJoin(blank).crossJoin(sound)
    rows = rows.join(_line_digest(lists), "execution_id", "left") if gather_support else rows.withColumn("actual_lines", F.lit(None).cast("string"))
    if "support_kind" not in executions.columns:
        rows = rows.withColumn("support_kind", F.lit(None).cast("string"))
    ok = {r: f"(array_contains(declared, '{r}') and coalesce(bad_{r}, 0) = 0)" for r in LISTS}
    checks: list[tuple[str, str]] = []

    def add(name, condition, passed):
        checks.append((name, f"case when {condition} then if({passed}, 'allow', 'block') end"))

    def schema(r, condition="true"):
        checks.append((
            _SCHEMA_NAME[r],
            f"case when not ({condition}) then null when not array_contains(declared, '{r}') then 'unverifiable' when bad_{r} > 0 then 'block' end",
        ))

    for r in ROLES[:4]:
        schema(r)
    checks.append(("nonempty_test", f"case when {ok['test']} and coalesce(n_test, 0) = 0 then 'block' end"))
    for r in ("train", "validation", "calibration"):
        add(f"{r}_test_trial_isolation", f"{ok[r]} and {ok['test']}", f"coalesce(x_{r}_test, 0) = 0")
    add("training_validation_trial_isolation", f"validation_trial_holdout and {ok['train']} and {ok['validation']}", "coalesce(x_train_validation, 0) = 0")
    for axis in ("subject", "stimulus"):
        checks.append((
            f"{axis}_holdout",
            f"case when not coalesce({axis}_holdout, false) then null when blank_{axis} > 0 or not {ok['train']} or not {ok['test']} then 'unverifiable' "
            f"when coalesce(i_{axis}, 0) > 0 then 'block' else 'allow' end",
        ))
    if extended:
        schema("preprocessing_fit")
        add("preprocessing_test_exclusion", f"{ok['preprocessing_fit']} and {ok['test']}", "coalesce(x_preprocessing_fit_test, 0) = 0")
        schema("model_selection")
        add("model_selection_test_exclusion", f"{ok['model_selection']} and {ok['test']}", "coalesce(x_model_selection_test, 0) = 0")
        for axis in ("subject", "stimulus"):
            checks.append((
                f"{axis}_preprocessing_selection_holdout",
                f"case when not coalesce({axis}_holdout, false) or not {ok['test']} then null when not ({ok['preprocessing_fit']} and {ok['model_selection']}) then 'unverifiable' "
                f"when coalesce(p_{axis}, 0) > 0 then 'block' else 'allow' end",
            ))
        wanted = "coalesce(require_matched_predictors, false)"
        supplied = f"({wanted} and coalesce(predictors_declared, false))"
        checks.append(("matched_predictor_evidence", f"case when {wanted} and not coalesce(predictors_declared, false) then 'unverifiable' end"))
        for res in RESOURCES:
            a, b = (f"{p}_{res}" for p in PREDICTORS)
            schema(a, supplied)
            schema(b, supplied)
            # a population list is compared with train and validation only if both are usable
            usable = "true" if res != "population" else f"not ({ok['train']} and {ok['validation']})"
            role_ok = {"calibration": ok["calibration"], "evaluation": ok["test"], "population": "true"}[res]
            same_role = f"({usable} or coalesce(r_{res}, 0) = 0)" if res == "population" else f"({role_ok} and coalesce(r_{res}, 0) = 0)"
            clear = "true" if res == "evaluation" else f"(not {ok['test']} or coalesce(t_{res}, 0) = 0)"
            name = "population_label" if res == "population" else res
            add(f"matched_{name}_trial_uids", f"{supplied} and {ok[a]} and {ok[b]}", f"coalesce(d_{res}, 0) = 0 and {same_role} and {clear}")
        checks.append((
            "matched_additional_label_resources",
            f"case when not {supplied} then null when additional_no_eeg is null or additional_eeg is null then 'unverifiable' "
            "when exists(concat(additional_no_eeg, additional_eeg), x -> x is null or x = '') then 'block' "
            "when array_sort(array_distinct(additional_no_eeg)) = array_sort(array_distinct(additional_eeg)) then 'allow' else 'block' end",
        ))
        checks.append((
            "fixed_evaluation_support",
            "case when expected_support is null then 'unverifiable' "
            f"when coalesce(support_kind, 'order_free') = 'order_free' then if({ok['test']}, if(actual_support = expected_support, 'allow', 'block'), null) "
            f"when support_kind = 'sorted_lines' and {str(gather_support).lower()} then if({ok['test']}, if(actual_lines = expected_support, 'allow', 'block'), null) "
            "else 'unverifiable' end",
        ))
    structs = ", ".join(f"struct('{n}' AS check, {e} AS status)" for n, e in checks)
    valid = rows.filter("coalesce(unsupported_fields, 0) = 0 and trials_sound").selectExpr("execution_id", f"inline(array({structs}))").filter("status is not null")
    broken = rows.filter("coalesce(unsupported_fields, 0) > 0").selectExpr("execution_id", "'contract_schema' AS check", "'block' AS status")
    untold = rows.filter("coalesce(unsupported_fields, 0) = 0 and not trials_sound").selectExpr("execution_id", "'trial_schema' AS check", "'block' AS status")
    return valid.unionByName(broken).unionByName(untold)


def overall_status(checks: DataFrame, keys: Sequence[str] = ("execution_id",)) -> DataFrame:
    """block over unverifiable over allow."""
    rank = "case status when 'block' then 2 when 'unverifiable' then 1 else 0 end"
    return checks.groupBy(*keys).agg(F.expr(f"max({rank})").alias("_r"), F.count(F.lit(1)).alias("checks")).selectExpr(
        *keys, "case _r when 2 then 'block' when 1 then 'unverifiable' else 'allow' end AS status", "checks"
    )


def workflow_audit(trials: DataFrame, lists: DataFrame, executions: DataFrame, *, extended: bool = True, gather_support: bool = False) -> DataFrame:
    return overall_status(workflow_checks(trials, lists, executions, extended=extended, gather_support=gather_support))


def execution_records(assignment: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Role lists and the execution row derived from an assignment ``(keys, trial_uid, split)``."""
    ident = F.concat_ws(":", *keys).alias("execution_id")
    rows = assignment.filter("split in ('train', 'validation', 'calibration', 'test')").select(ident, "trial_uid", "split")
    roles = (
        "case split when 'train' then array('train', 'preprocessing_fit', 'no_eeg_population', 'eeg_population') "
        "when 'validation' then array('validation', 'model_selection', 'no_eeg_population', 'eeg_population') "
        "when 'calibration' then array('calibration', 'no_eeg_calibration', 'eeg_calibration') "
        "else array('test', 'no_eeg_evaluation', 'eeg_evaluation') end"
    )
    lists = rows.selectExpr("execution_id", f"explode({roles}) AS role", "trial_uid")
    digest = rows.filter("split = 'test'").groupBy("execution_id").agg(support_digest().alias("expected_support"))
    declared = ", ".join(f"'{r}'" for r in LISTS)
    executions = rows.select("execution_id").distinct().join(digest, "execution_id", "left").selectExpr(
        "execution_id", f"array({declared}) AS declared", "true AS subject_holdout", "true AS stimulus_holdout", "true AS validation_trial_holdout",
        "true AS require_matched_predictors", "0 AS unsupported_fields", "true AS predictors_declared", "expected_support",
        "cast(array() as array<string>) AS additional_no_eeg", "cast(array() as array<string>) AS additional_eeg",
    )
    return lists, executions


PRIOR_RESOURCES = ("population_training_labels", "released_normative_prior", "participant_calibration_labels")


def evidence_review(
    assignment: DataFrame, *, fit: DataFrame | None = None, calibration: dict[str, DataFrame] | None = None, prior_resources: Sequence[str] | None = None,
    declared_sha: str | None = None, actual_sha: str | None = None, actual_prior_resources: Sequence[str] | None = None,
) -> DataFrame:
    """Checks of declared evidence against one assignment as ``(check, status)``.

    Identifier evidence comes as tables of ``trial_uid``.  The review can block
    or stay unverifiable; it never allows overall.
    """
    spark = assignment.sparkSession
    known = "'train', 'validation', 'calibration', 'test', 'excluded'"
    base = assignment.agg(
        F.expr(f"count_if(trim(coalesce(trial_uid, '')) = '' or split is null or split not in ({known}))").alias("bad"),
    ).crossJoin(assignment.groupBy("trial_uid").count().filter("count > 1").agg(F.count(F.lit(1)).alias("repeated")))
    out = base.selectExpr(
        "inline(array(struct('assignment_schema' AS check, if(bad = 0, 'allow', 'block') AS status), "
        "struct('unique_trial_assignment' AS check, if(repeated = 0, 'allow', 'block') AS status)))"
    )
    fixed = [("upstream_authenticity_and_pretraining_exposure", "unverifiable")]
    if not declared_sha or not actual_sha:
        fixed.append(("feature_file_binding", "unverifiable"))
    else:
        fixed.append(("feature_file_binding", "allow" if declared_sha == actual_sha else "block"))
    if fit is None:
        fixed.append(("declared_preprocessing_test_exclusion", "unverifiable"))
    else:
        hit = fit.join(assignment.filter("split = 'test'").select("trial_uid"), "trial_uid", "left_semi").agg(F.count(F.lit(1)).alias("n"))
        malformed = fit.agg(F.expr("count_if(coalesce(trial_uid, '') = '')").alias("m"))
        out = out.unionByName(hit.crossJoin(malformed).selectExpr(
            "'declared_preprocessing_test_exclusion' AS check", "if(n = 0 and m = 0, 'allow', 'block') AS status"))
    pair = ("prior_personalized", "combined_personalized")
    if calibration is None or not set(pair) <= set(calibration):
        fixed.append(("matched_predictor_calibration", "unverifiable"))
    else:
        rows = assignment.filter("split = 'calibration'").selectExpr("trial_uid", "1 AS w", "0 AS a", "0 AS b")
        rows = rows.unionByName(calibration[pair[0]].selectExpr("trial_uid", "0 AS w", "1 AS a", "0 AS b"))
        rows = rows.unionByName(calibration[pair[1]].selectExpr("trial_uid", "0 AS w", "0 AS a", "1 AS b"))
        per = rows.groupBy("trial_uid").agg(*[F.sum(c).alias(c) for c in "wab"])
        bad = per.agg(F.expr("count_if(not (w = 1 and a = 1 and b = 1) or coalesce(trial_uid, '') = '')").alias("n"))
        out = out.unionByName(bad.selectExpr("'matched_predictor_calibration' AS check", "if(n = 0, 'allow', 'block') AS status"))
    if prior_resources is None:
        fixed.append(("prior_resource_declaration", "unverifiable"))
    elif any(not x for x in prior_resources):
        fixed.append(("prior_resource_declaration", "block"))
    else:
        fixed.append(("prior_resource_declaration", "block" if set(prior_resources) - set(PRIOR_RESOURCES) else "allow"))
        if actual_prior_resources is not None:
            fixed.append(("prior_resources_match_evaluator", "allow" if set(prior_resources) == set(actual_prior_resources) else "block"))
    return out.unionByName(spark.createDataFrame(fixed, "check string, status string"))


def compile_registry(registry: DataFrame, files: DataFrame, documents: DataFrame) -> dict[str, DataFrame]:
    """Registered assets to long tables, an index and faults.

    ``registry(asset, path, kind, sha256, bytes, expected_seeds, protocols)``;
    ``documents(asset, json)`` are the summaries.
    """
    index = registry.select("asset", "kind", "path").join(
        D.verify_file_manifest(registry.select("path", "sha256", "bytes"), files), "path", "left"
    )
    numeric = D.flatten_json_numeric(documents)
    benchmark = D.flatten_benchmark_rows(documents)
    seeds = benchmark.groupBy("asset", "protocol").agg(F.collect_set("seed").alias("_s"))  # seeds are few
    faults = seeds.join(registry.select("asset", "expected_seeds", "protocols"), "asset").selectExpr(
        "asset", "protocol", "not array_contains(protocols, protocol) AS unknown_protocol",
        "size(array_except(expected_seeds, _s)) AS missing_seeds", "size(array_except(_s, expected_seeds)) AS unexpected_seeds",
    )
    return {"index": index, "numeric": numeric, "benchmark": benchmark, "paired": D.flatten_paired_rows(documents), "faults": faults}
