"""Evidence, replicate and audit queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from heldout.functions.materialize import materialize
from heldout.operators import audits as A
from heldout.operators import evidence as E
from heldout.operators import inference as I
from heldout.operators import splits as S
from heldout.operators.metrics import pair_sums, scores_from_sums
from heldout.plans import inference_queries as Q
from heldout.plans.prior_queries import rounded
from heldout.plans.registry import query, view
from heldout.sources import documents as D
from heldout.sources import views as V


def replicates(spark, d):
    return V.table(spark, d, "orders").selectExpr(
        "o_orderkey AS replicate", "o_orderstatus AS scenario", "o_orderpriority AS estimand", "'normal_t' AS method",
        "if(o_orderstatus = 'F', 0D, 0.25D) AS truth", "(o_totalprice % 1000) / 1000 - 0.2 AS estimate",
        "if(o_orderkey % 50 = 0, null, (o_totalprice % 1000) / 1000 - 0.2 - 0.1 - (o_custkey % 7) / 10D) AS ci_low",
        "(o_totalprice % 1000) / 1000 - 0.2 + 0.1 + (o_custkey % 7) / 10D AS ci_high", "5L AS n_blocks", "10 + o_orderkey % 20 AS cluster_df",
    )


view("replicates", """SELECT o_orderkey AS replicate, o_orderstatus AS scenario, o_orderpriority AS estimand, CASE WHEN o_orderstatus='F' THEN 0 ELSE 0.25 END::DOUBLE AS truth,
 (o_totalprice%1000)/1000-0.2::DOUBLE AS estimate, CASE WHEN o_orderkey%50=0 THEN NULL ELSE (o_totalprice%1000)/1000-0.2::DOUBLE-0.1::DOUBLE-(o_custkey%7)/10.0::DOUBLE END AS ci_low,
 (o_totalprice%1000)/1000-0.2::DOUBLE+0.1::DOUBLE+(o_custkey%7)/10.0::DOUBLE AS ci_high, 10+o_orderkey%20 AS cluster_df FROM orders""")


def wilson_sql(k, n, sign):
    z = "1.959963984540054::DOUBLE"
    return f"CASE WHEN {n}>0 THEN ({k}/{n}::DOUBLE+{z}*{z}/(2*{n}) {sign} {z}*sqrt(({k}/{n}::DOUBLE)*(1-{k}/{n}::DOUBLE)/{n}+{z}*{z}/(4.0::DOUBLE*{n}*{n})))/(1+{z}*{z}/{n}) END"


@query("wilson_interval", f"""WITH c AS (SELECT context, count_if(label_available) AS hits, count(*) AS n FROM trials GROUP BY 1)
SELECT context, hits, n, round({wilson_sql('hits', 'n', '-')},6) AS wilson_low, round({wilson_sql('hits', 'n', '+')},6) AS wilson_high FROM c""")
def _(spark, d):
    c = V.trials(spark, d).groupBy("context").agg(F.expr("count_if(label_available)").alias("hits"), F.count(F.lit(1)).alias("n"))
    return rounded(E.wilson_interval(c, "hits", "n"))


view("coverage", f"""
WITH u AS (SELECT *, ci_low IS NOT NULL AS u, ci_low<=truth+1e-12 AND truth<=ci_high+1e-12 AS c, ci_low>1e-12 AS dt FROM replicates),
g AS (SELECT scenario, estimand, count(*) AS replicates, count_if(u) AS v, count_if(u AND c) AS k, count_if(u AND dt) AS h, avg(truth) AS t, avg(CASE WHEN u THEN estimate-truth END) AS bias, avg(CASE WHEN u THEN ci_high-ci_low END) AS w FROM u GROUP BY 1,2)
SELECT scenario, estimand, replicates, v AS valid_replicates, k/v AS coverage, {wilson_sql('k', 'v', '-')} AS coverage_mc_low, {wilson_sql('k', 'v', '+')} AS coverage_mc_high, h/v AS detection,
 {wilson_sql('h', 'v', '-')} AS detection_mc_low, {wilson_sql('h', 'v', '+')} AS detection_mc_high, CASE WHEN t<=1e-12 THEN 'false_positive' ELSE 'power' END AS detection_means, bias, w AS mean_width FROM g""")
COV = "scenario, estimand, replicates, valid_replicates, detection_means, " + ", ".join(
    f"round({c},6) AS {c}" for c in ("coverage", "coverage_mc_low", "coverage_mc_high", "detection", "detection_mc_low", "detection_mc_high", "bias", "mean_width")
)


@query("coverage_summary", f"SELECT {COV} FROM coverage")
def _(spark, d):
    return rounded(E.coverage_summary(replicates(spark, d), ["scenario", "estimand"]))


@query("simultaneous_coverage", """
WITH p AS (SELECT scenario, replicate//4 AS r, bool_and(ci_low<=truth+1e-12 AND truth<=ci_high+1e-12) AS a FROM replicates GROUP BY 1,2)
SELECT scenario, count(*) AS replicates, round(avg(a::INT),6) AS simultaneous_coverage FROM p GROUP BY 1""")
def _(spark, d):
    r = replicates(spark, d).withColumn("replicate", F.expr("replicate div 4"))
    return rounded(E.simultaneous_coverage(r, ["scenario"]))


def _t_case():
    from heldout.functions.formulas import t_quantile
    return "CASE cluster_df " + " ".join(f"WHEN {k} THEN {t_quantile(k)!r}" for k in range(10, 30)) + " END::DOUBLE"


@query("rescale_intervals", f"""
WITH r AS (SELECT *, (ci_high-ci_low)/2*2.7764451051977934::DOUBLE/({_t_case()}) AS rad FROM replicates)
SELECT replicate, round(estimate-rad,6) AS ci_low, round(estimate+rad,6) AS ci_high, estimate-rad-1e-12<=truth AND truth<=estimate+rad+1e-12 AS covered, estimate-rad>1e-12 AS positive FROM r""")
def _(spark, d):
    return rounded(E.rescale_intervals(replicates(spark, d)).select("replicate", "ci_low", "ci_high", "covered", "positive"))


@query("verify_summary", """SELECT scenario, estimand, CASE WHEN scenario='F' AND estimand LIKE '1%' THEN 'extra' WHEN scenario='O' AND estimand LIKE '2%' THEN 'different' WHEN scenario='P' AND estimand LIKE '3%' THEN 'missing' END AS fault
FROM coverage WHERE (scenario='F' AND estimand LIKE '1%') OR (scenario='O' AND estimand LIKE '2%') OR (scenario='P' AND estimand LIKE '3%')""")
def _(spark, d):
    full = materialize(E.coverage_summary(replicates(spark, d), ["scenario", "estimand"]))
    stored = full.filter("not (scenario = 'P' and estimand like '3%')").withColumn(
        "bias", F.expr("if(scenario = 'O' and estimand like '2%', bias + 0.001, bias)")
    )
    recomputed = full.filter("not (scenario = 'F' and estimand like '1%')")
    return E.verify_summary(stored, recomputed, ["scenario", "estimand"], ["coverage", "bias", "mean_width"])


def cell_scores(spark, d):
    p = Q.predictions(spark, d)
    keys = [*I.CELL, "predictor"]
    per = scores_from_sums(pair_sums(p, ["seed", *keys, "target"]), ["seed", *keys])
    return materialize(per.groupBy(*keys).agg(F.avg("macro_ccc").alias("macro_ccc")))


@query("score_decomposition", """
WITH w AS (SELECT participant_dose, stimulus_dose, representation, max(CASE WHEN predictor='prior' THEN macro_ccc END) AS prior, max(CASE WHEN predictor='prior_personalized' THEN macro_ccc END) AS pp, max(CASE WHEN predictor='combined_personalized' THEN macro_ccc END) AS cp
 FROM draws WHERE draw=0 GROUP BY ALL)
SELECT participant_dose, stimulus_dose, representation, round(cp-prior,6) AS total, round(pp-prior,6) AS calibration, round(cp-pp,6) AS matched, true AS prior_parity FROM w""")
def _(spark, d):
    out = E.score_decomposition(cell_scores(spark, d), ["participant_dose", "stimulus_dose"])
    return rounded(out.select("participant_dose", "stimulus_dose", "representation", "total", "calibration", "matched", "prior_parity"))


@query("missing_cells", """WITH p AS (SELECT DISTINCT context, user_id%4 AS seed FROM trials WHERE NOT (context='view' AND user_id%4=1))
SELECT context, seed FROM (SELECT DISTINCT context FROM p) CROSS JOIN (SELECT DISTINCT seed FROM p) EXCEPT SELECT context, seed FROM p""")
def _(spark, d):
    t = V.trials(spark, d).selectExpr("context", "user_id % 4 AS seed").filter("not (context = 'view' and seed = 1)")
    return E.missing_cells(t, ["context", "seed"])


@query("interval_method_join", f"""
WITH b AS ({Q.interval_sql('draws', Q.KEYS, 'macro_ccc')})
SELECT {Q.KEYS}, round(estimate,6) AS estimate, round(q[1],6) AS ci_low_p, round(q[2],6) AS ci_high_p, round(estimate-2.7764451051977934*sd,6) AS ci_low_t, round(estimate+2.7764451051977934*sd,6) AS ci_high_t FROM b""")
def _(spark, d):
    t = Q.draw_table(spark, d)
    keys = [*I.CELL, "predictor"]
    a = I.intervals(t, keys, "macro_ccc")
    b = I.intervals(t, keys, "macro_ccc", method="block_t", df=4)
    return rounded(E.interval_method_join(a, b, keys))


@query("sensitivity_summary", """
WITH r AS (SELECT scenario, 'run'||replicate%3 AS run, avg(estimate) AS estimate, avg(estimate)-0.3 AS ci_low, avg(estimate)-0.29+replicate%3*0.0::DOUBLE+0.0 AS ci_high FROM replicates GROUP BY scenario, replicate%3)
SELECT scenario, round(max(abs(estimate-b)),6) AS largest_absolute_shift, count_if(ci_low<=0 AND ci_high>=0) AS intervals_covering_zero, round(min(estimate),6) AS estimate_min, round(max(estimate),6) AS estimate_max,
 round(max(estimate)-min(estimate),6) AS span, count(*) AS runs FROM r JOIN (SELECT scenario, estimate AS b FROM r WHERE run='run0') USING (scenario) GROUP BY 1""")
def _(spark, d):
    r = replicates(spark, d).groupBy("scenario", F.expr("concat('run', replicate % 3)").alias("run")).agg(F.avg("estimate").alias("estimate"))
    return rounded(E.sensitivity_summary(r.selectExpr("*", "estimate - 0.3 AS ci_low", "estimate - 0.29 AS ci_high"), ["scenario"], reference="run0"))


view("contrast_table", f"""
WITH c AS ({Q.interval_sql('deltas', Q.CK + ', contrast', 'ccc_delta')})
SELECT {Q.CK}, contrast, c.estimate AS ccc_delta, c.q[1] AS lo, c.q[2] AS hi, c.estimate-radius AS slo, c.estimate+radius AS shi FROM c JOIN bands USING (representation, contrast)""")


@query("heterogeneity_summary", """SELECT representation, contrast, round(min(ccc_delta),6) AS minimum, round(max(ccc_delta),6) AS maximum, count_if(lo>0) AS positive_pointwise, count_if(hi<0) AS negative_pointwise,
 count_if(slo>0) AS positive_dose_family, count_if(shi<0) AS negative_dose_family FROM contrast_table WHERE contrast<>'prior_calibration_gain' GROUP BY 1,2""")
def _(spark, d):
    c = materialize(I.paired_contrasts(Q.draw_table(spark, d)))
    return rounded(E.heterogeneity_summary(c.filter("contrast <> 'prior_calibration_gain'"), ["representation", "contrast"]))


@query("dose_corners", "SELECT representation, participant_dose, stimulus_dose, contrast, round(ccc_delta,6) AS ccc_delta FROM contrast_table")
def _(spark, d):
    c = I.contrast_draws(Q.draw_table(spark, d)).filter("draw = 0")
    return rounded(E.dose_corners(c).select(*I.CELL, "contrast", "ccc_delta"))


@query("learning_summary", """SELECT o_orderpriority AS branch, count(*) AS fit_records, count_if(o_custkey%20+1=1) AS selected_epoch_one, median(o_custkey%20+1) AS selected_epoch_median, min(o_custkey%20+1) AS selected_epoch_min,
 max(o_custkey%20+1) AS selected_epoch_max, round(median(o_totalprice/1000),6) AS median_objective_reduction FROM orders GROUP BY 1""")
def _(spark, d):
    f = V.table(spark, d, "orders").selectExpr("o_orderpriority AS branch", "o_custkey % 20 + 1 AS selected_epochs", "o_totalprice / 500 AS initial_objective", "o_totalprice / 1000 AS final_objective")
    return rounded(E.learning_summary(f, ["branch"]))


@query("audit_confusion", """WITH c AS (SELECT o_orderpriority AS checker, (['allow','block','unverifiable'])[o_custkey%3+1] AS e, (['allow','block','unverifiable'])[o_orderkey%3+1] AS o, o_totalprice AS r FROM orders)
SELECT checker, count(*) AS cases, count_if(e='block') AS violations, count_if(e='block' AND o='block') AS detected_violations, count_if(e<>'allow' AND o='allow') AS false_allows, count_if(e='allow') AS clean_cases,
 count_if(e='allow' AND o='block') AS false_blocks, count_if(e='unverifiable') AS unknown_cases, count_if(e='unverifiable' AND o='unverifiable') AS retained_unknown, round(median(r),6) AS median_runtime_ms FROM c GROUP BY 1""")
def _(spark, d):
    states = "element_at(array('allow', 'block', 'unverifiable'), cast({} % 3 + 1 as int))"
    c = V.table(spark, d, "orders").selectExpr("o_orderpriority AS checker", states.format("o_custkey") + " AS expected", states.format("o_orderkey") + " AS observed", "o_totalprice AS runtime_ms")
    return rounded(E.audit_confusion(c, ["checker"]))


@query("validate_predictions", """
WITH p AS (SELECT context AS protocol, user_id%5 AS seed, trial_uid, CASE WHEN k=13 THEN NULL ELSE target_valence END AS v FROM trials UNION ALL SELECT context, user_id%5, trial_uid, target_valence FROM trials WHERE event_id%1000=0)
SELECT 'non_finite' AS check, 'm_valence' AS item, count_if(v IS NULL) AS violations FROM p
UNION ALL SELECT 'duplicate_key', 'all', count(*)-count(DISTINCT trial_uid) FROM p
UNION ALL SELECT unnest(['unknown_protocol','missing_seed','unexpected_seed','row_count']), protocol, unnest([(protocol='error')::BIGINT, 1, 1, count(*)]) FROM p GROUP BY protocol""")
def _(spark, d):
    t = V.trials(spark, d)
    p = t.selectExpr("context AS protocol", "user_id % 5 AS seed", "trial_uid", "if(k = 13, double('nan'), target_valence) AS m_valence")
    p = p.unionByName(t.filter("event_id % 1000 = 0").selectExpr("context AS protocol", "user_id % 5 AS seed", "trial_uid", "target_valence AS m_valence"))
    return E.validate_predictions(p, key=["trial_uid"], numeric=["m_valence"], protocols=["view", "click", "purchase", "signup"], seeds=[1, 2, 3, 4, 5])


@query("resolve_claims", """
WITH m AS (SELECT 'user_'||user_id||'_'||context AS claim_id, avg(value) AS v, count(*) AS n FROM trials GROUP BY user_id, context)
SELECT claim_id, 'events' AS table, n AS rows, round(v,6) AS value, 'ok' AS status FROM m""")
def _(spark, d):
    t = V.trials(spark, d)
    long = t.selectExpr(
        "'events' AS table", "trial_uid AS row_id", "inline(array(struct('subject' AS column, subject_uid AS text, cast(null as double) AS number), "
        "struct('context' AS column, context AS text, cast(null as double) AS number), struct('value' AS column, cast(null as string) AS text, value AS number)))",
    )
    claims = t.groupBy("user_id", "context").agg(F.avg("value").alias("expected")).selectExpr(
        "concat('user_', user_id, '_', context) AS claim_id", "'events' AS table", "map('subject', concat('u', user_id), 'context', context) AS where",
        "'value' AS value_column", "'mean' AS reduction", "expected", "1e-9D AS tolerance", "3 AS decimals",
    )
    return rounded(E.resolve_claims(claims, long).drop("display_value"))


@query("comparison_tables", """
SELECT 'a' AS asset, context AS protocol, 'ridge' AS model, 'all' AS context, 'valence' AS target, 'ccc' AS metric, round(avg(target_valence),6) AS mean, round(coalesce(stddev_samp(target_valence),0),6) AS sample_sd,
 count(DISTINCT k) AS seed_count, CASE context WHEN 'view' THEN 0 WHEN 'click' THEN 1 ELSE 999 END AS protocol_rank, 0 AS model_rank FROM trials GROUP BY context""")
def _(spark, d):
    rows = V.trials(spark, d).selectExpr(
        "'a' AS asset", "context AS protocol", "k AS seed", "'ridge' AS model", "'all' AS context", "'valence' AS target", "'ccc' AS metric", "target_valence AS value"
    )
    return rounded(E.comparison_tables(rows, protocols=["view", "click"], models=["ridge"]))


@query("scan_sensitive_text", r"""SELECT doc_id, true AS sensitive_text FROM documents WHERE regexp_matches(text, '/home/[^/\s]+') OR regexp_matches(text, '/opt/(?:[^/\s]+/)*[^/\s]+')
 OR regexp_matches(text, '(?i)[A-Z]:\\Users\\[^\\\s]+') OR regexp_matches(text, '(?i)\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b')""")
def _(spark, d):
    return E.scan_sensitive_text(V.table(spark, d, "documents")).select("doc_id", "sensitive_text")


@query("protocol_matrix", """
WITH c AS (SELECT dataset_id, context AS protocol, CASE WHEN count(*)>600 THEN 'valid' ELSE 'limited' END AS status FROM trials_multi WHERE NOT (dataset_id='d1' AND context='view') GROUP BY 1,2),
q AS (SELECT DISTINCT dataset_id, unnest(['view','click','error','purchase']) AS protocol FROM c)
SELECT dataset_id, protocol, status, CASE WHEN status IS NULL THEN 'missing' WHEN q.dataset_id IS NULL THEN 'extra' ELSE 'present' END AS cell FROM c FULL JOIN q USING (dataset_id, protocol)""")
def _(spark, d):
    c = V.trials_multi(spark, d).filter("not (dataset_id = 'd1' and context = 'view')").groupBy("dataset_id", "context").agg(F.count(F.lit(1)).alias("n"))
    contract = c.groupBy("dataset_id").agg(F.map_from_entries(F.collect_list(F.expr("struct(context, if(n > 600, 'valid', 'limited'))"))).alias("protocols"))
    required = V.trials(spark, d).select(F.col("context").alias("protocol")).filter("protocol <> 'signup'").distinct()
    return E.protocol_matrix(contract, required)


@query("cross_model_prior_parity", """SELECT seed, participant_dose, stimulus_dose, count(DISTINCT trial_uid) AS trials, CAST(0 AS BIGINT) AS prior_mismatches, CAST(0 AS BIGINT) AS zero_dose_mismatches FROM preds GROUP BY 1,2,3""")
def _(spark, d):
    p = Q.predictions(spark, d)
    wide = p.groupBy("representation", "seed", "participant_dose", "stimulus_dose", "trial_uid").agg(*[
        F.expr(f"max(case when predictor = '{a}' and target = '{n}' then yhat end)").alias(f"{a}_{n}")
        for a in ("prior", "prior_personalized", "combined_population", "combined_personalized") for n in ("valence", "arousal")
    ])
    return E.cross_model_prior_parity(wide)


@query("verify_learning_curves", """
WITH h AS (SELECT o_custkey AS fit_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS epoch, o_totalprice/1000 AS mae FROM orders),
b AS (SELECT fit_id, min(mae) AS best FROM h GROUP BY 1)
SELECT b.fit_id, (SELECT min(epoch) FROM h WHERE h.fit_id=b.fit_id AND h.mae=b.best) AS replayed_epoch, round(best,6) AS replayed_mae,
 CASE WHEN (SELECT min(epoch) FROM h WHERE h.fit_id=b.fit_id AND h.mae=b.best)=1 THEN 'ok' ELSE 'selection_mismatch' END AS status FROM b""")
def _(spark, d):
    h = V.table(spark, d, "orders").selectExpr(
        "o_custkey AS fit_id", "row_number() over (partition by o_custkey order by o_orderkey) AS epoch", "1D AS objective", "1D AS gradient_norm", "o_totalprice / 1000 AS validation_mae"
    ).withColumn("epoch", F.col("epoch").cast("bigint"))
    fits = h.groupBy("fit_id").agg(F.min("validation_mae").alias("validation_mae")).selectExpr("*", "1L AS selected_epochs", "1L AS refit_epochs")
    return rounded(E.verify_learning_curves(h, fits))


FAULTS = ("clean", "test_in_train", "unknown_trial", "no_preprocessing", "selection_on_test", "unmatched_calibration", "no_support", "bad_contract")


def audited_executions(spark, d):
    """One execution per fault, each over the whole strict joint split."""
    t = V.trials(spark, d)
    strict = materialize(S.double_holdout(t, validate=False))
    names = ", ".join(f"'{f}'" for f in FAULTS)
    base = strict.selectExpr("trial_uid", "split", f"explode(array({names})) AS fault")
    lists, executions = A.execution_records(base, ["fault"])
    lists = lists.filter("not (execution_id = 'no_preprocessing' and role = 'preprocessing_fit')")
    test = strict.filter("split = 'test'")
    excluded = strict.filter("split = 'excluded'")
    extra = test.selectExpr("'test_in_train' AS execution_id", "'train' AS role", "trial_uid").unionByName(
        test.selectExpr("'unknown_trial' AS execution_id", "'validation' AS role", "concat('x:', trial_uid) AS trial_uid")
    ).unionByName(test.selectExpr("'selection_on_test' AS execution_id", "'model_selection' AS role", "trial_uid")).unionByName(
        excluded.selectExpr("'unmatched_calibration' AS execution_id", "'eeg_calibration' AS role", "trial_uid")
    )
    executions = executions.selectExpr(
        "execution_id", "if(execution_id = 'no_preprocessing', array_except(declared, array('preprocessing_fit')), declared) AS declared", *A.CONTRACT,
        "if(execution_id = 'bad_contract', 1, 0) AS unsupported_fields", "predictors_declared", "if(execution_id = 'no_support', null, expected_support) AS expected_support",
        "additional_no_eeg", "additional_eeg",
    )
    return t, lists.unionByName(extra), executions


EXPECT = """CASE f WHEN 'clean' THEN 'allow' WHEN 'no_preprocessing' THEN 'unverifiable' WHEN 'no_support' THEN 'unverifiable' ELSE 'block' END"""


@query("workflow_audit", f"""
SELECT f AS execution_id, {EXPECT} AS status FROM (SELECT unnest([{', '.join(f"'{f}'" for f in FAULTS)}]) AS f) WHERE (SELECT count(*) FROM strict WHERE split='test')>0""")
def _(spark, d):
    return A.workflow_audit(*audited_executions(spark, d)).drop("checks")


@query("workflow_checks", """
SELECT f AS execution_id, c AS check, CASE WHEN f='test_in_train' AND c IN ('train_test_trial_isolation','subject_holdout','stimulus_holdout') THEN 'block' ELSE 'allow' END AS status
FROM (SELECT unnest(['clean','test_in_train']) AS f) CROSS JOIN (SELECT unnest(['train_test_trial_isolation','validation_test_trial_isolation','calibration_test_trial_isolation','training_validation_trial_isolation','subject_holdout','stimulus_holdout']) AS c)""")
def _(spark, d):
    t, lists, executions = audited_executions(spark, d)
    names = ("clean", "test_in_train")
    out = A.workflow_checks(t, lists.filter(F.col("execution_id").isin(*names)), executions.filter(F.col("execution_id").isin(*names)), extended=False)
    return out


@query("execution_records", """
SELECT r AS role, count(*) AS n FROM (SELECT unnest(CASE split WHEN 'train' THEN ['train','preprocessing_fit','no_eeg_population','eeg_population'] WHEN 'validation' THEN ['validation','model_selection','no_eeg_population','eeg_population']
 WHEN 'test' THEN ['test','no_eeg_evaluation','eeg_evaluation'] END) AS r FROM strict WHERE split<>'excluded') GROUP BY 1""")
def _(spark, d):
    lists, _ = A.execution_records(S.double_holdout(V.trials(spark, d), validate=False), ["seed"])
    return lists.groupBy("role").agg(F.count(F.lit(1)).alias("n"))


@query("execution_record_rows", """
SELECT trial_uid, unnest(CASE split WHEN 'train' THEN ['train','preprocessing_fit','no_eeg_population','eeg_population'] WHEN 'validation' THEN ['validation','model_selection','no_eeg_population','eeg_population']
 WHEN 'test' THEN ['test','no_eeg_evaluation','eeg_evaluation'] END) AS role FROM strict WHERE split<>'excluded'""")
def _(spark, d):
    lists, _ = A.execution_records(S.double_holdout(V.trials(spark, d), validate=False), ["seed"])
    return lists.select("trial_uid", "role")


@query("workflow_audit_repeated_trial", f"""
SELECT f AS execution_id, 'block' AS status, count(DISTINCT t.trial_uid) > 0 AS repeated FROM (SELECT unnest([{', '.join(f"'{f}'" for f in FAULTS)}]) AS f)
 JOIN trials t ON t.event_id = (SELECT max(event_id) FROM trials) GROUP BY f""")
def _(spark, d):
    """One trial is in the table twice, with other identities the second time: nothing may be allowed."""
    t, lists, executions = audited_executions(spark, d)
    last = V.trials(spark, d).agg(F.max(F.struct("event_id", "trial_uid")).alias("m")).select("m.trial_uid")
    twice = t.join(last, "trial_uid", "left_semi").withColumn("subject_uid", F.lit("someone else"))
    checks = A.workflow_checks(t.unionByName(twice), lists, executions)
    told = checks.groupBy("execution_id").agg(F.expr("bool_or(check in ('trial_schema', 'contract_schema'))").alias("repeated"))
    return A.overall_status(checks).drop("checks").join(told, "execution_id")


@query("evidence_review", """
SELECT unnest(['assignment_schema','unique_trial_assignment','feature_file_binding','declared_preprocessing_test_exclusion','matched_predictor_calibration','prior_resource_declaration','prior_resources_match_evaluator','upstream_authenticity_and_pretraining_exposure']) AS check,
 unnest(['allow','allow','allow',(SELECT CASE WHEN count(*)>0 THEN 'block' ELSE 'allow' END FROM strict WHERE split='test'),'allow','allow','block','unverifiable']) AS status""")
def _(spark, d):
    t = V.trials(spark, d)
    a = S.double_holdout(t, validate=False).selectExpr("trial_uid", "if(split = 'excluded', 'calibration', split) AS split")
    a = materialize(a)
    cal = a.filter("split = 'calibration'").select("trial_uid")
    return A.evidence_review(
        a, fit=a.filter("split in ('train', 'test')").select("trial_uid"), calibration={"prior_personalized": cal, "combined_personalized": cal},
        prior_resources=["population_training_labels"], declared_sha="x", actual_sha="x", actual_prior_resources=["population_training_labels", "participant_calibration_labels"],
    )


@query("compile_registry", """
WITH r AS (SELECT 'asset'||k%10 AS asset, context AS protocol, k FROM trials)
SELECT asset, protocol, protocol='error' AS unknown_protocol, 10-count(DISTINCT k%100) FILTER (k<50) - 0 AS missing_seeds, CAST(count(DISTINCT k) FILTER (k>=50) AS INT) AS unexpected_seeds FROM r GROUP BY 1,2""".replace("10-count(DISTINCT k%100) FILTER (k<50) - 0", "CAST(5-count(DISTINCT k) FILTER (k<50) AS INT)"))
def _(spark, d):
    t = V.trials(spark, d)
    docs = t.selectExpr(
        "concat('asset', k % 10) AS asset",
        "to_json(named_struct('results', array(named_struct('protocol', context, 'seed', k, 'models', map('ridge', map('all', map('valence', map('ccc', target_valence)))))))) AS json",
    )
    registry = t.selectExpr("k % 10 AS a").distinct().selectExpr(
        "concat('asset', a) AS asset", "'summary' AS kind", "concat('asset', a, '.json') AS path", "'' AS sha256", "0L AS bytes",
        "transform(sequence(0, 4), i -> cast(i * 10 + a as string)) AS expected_seeds", "array('view', 'click', 'purchase', 'signup') AS protocols",
    )
    return A.compile_registry(registry, registry.select("path", "sha256", "bytes"), docs)["faults"]


@query("registry_index", "SELECT 'asset'||a AS asset, CASE WHEN a=3 THEN 'missing' WHEN a=4 THEN 'hash_mismatch' ELSE 'ok' END AS status FROM (SELECT DISTINCT CAST(json_extract(props,'$.k') AS BIGINT)%10 AS a FROM events)")
def _(spark, d):
    r = V.trials(spark, d).selectExpr("k % 10 AS a").distinct().selectExpr("concat('asset', a) AS asset", "'summary' AS kind", "concat('asset', a, '.json') AS path", "sha2(cast(a as string), 256) AS sha256", "a AS bytes", "a")
    files = r.filter("a <> 3").selectExpr("path", "if(a = 4, 'other', sha256) AS sha256", "bytes")
    return D.verify_file_manifest(r.select("path", "sha256", "bytes"), files).join(r.select("path", "asset"), "path").select("asset", "status")
