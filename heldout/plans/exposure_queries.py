"""Exposure-cell queries on the strict joint split of the trial view."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from heldout.functions.materialize import materialize
from heldout.operators import exposure as X
from heldout.operators import splits as S
from heldout.plans.prior_queries import rounded
from heldout.plans.registry import VIEWS, query, view
from heldout.plans.split_queries import roles_sql
from heldout.sources import views as V

DOSES = (0, 2, 4)


def strict(spark, d):
    t = V.trials(spark, d)
    return t, S.double_holdout(t, validate=False)


def marks(spark, d):
    t, s = strict(spark, d)
    return t, X.cell_marks(t, s, p_doses=DOSES, s_doses=DOSES, validate=False)


def cells(spark, d):
    t, m = marks(spark, d)
    return t, X.expand_cells(materialize(m), p_doses=DOSES, s_doses=DOSES)


view("strict_rows", "SELECT trials.*, split FROM trials JOIN strict USING (trial_uid)")
view("pools", """
SELECT trial_uid, subject_uid, stimulus_uid, CASE WHEN hs AND NOT hk THEN 'participant' WHEN hk AND NOT hs THEN 'stimulus' END AS pool FROM (
 SELECT *, subject_uid IN (SELECT subject_uid FROM strict_rows WHERE split='test') AS hs, stimulus_uid IN (SELECT stimulus_uid FROM strict_rows WHERE split='test') AS hk
 FROM strict_rows WHERE split='excluded') WHERE hs<>hk""")
view("fixed_test", """SELECT * FROM strict_rows WHERE split='test'
 AND subject_uid IN (SELECT subject_uid FROM pools WHERE pool='participant' GROUP BY 1 HAVING count(*)>=4)
 AND stimulus_uid IN (SELECT stimulus_uid FROM pools WHERE pool='stimulus' GROUP BY 1 HAVING count(*)>=4)""")
view("usable_pools", """SELECT * FROM pools WHERE (pool='participant' AND subject_uid IN (SELECT subject_uid FROM fixed_test))
 OR (pool='stimulus' AND stimulus_uid IN (SELECT stimulus_uid FROM fixed_test))""")
view("sample_ranks", """
SELECT trial_uid, pool, row_number() OVER (PARTITION BY pool, id ORDER BY sha256('11:'||pool||':'||id||':'||trial_uid), trial_uid) AS dose_rank FROM (
 SELECT *, CASE WHEN pool='participant' THEN subject_uid ELSE stimulus_uid END AS id FROM usable_pools)""")


@query("fixed_support", """SELECT CAST(11 AS BIGINT) AS seed, trial_uid, split, trial_uid IN (SELECT trial_uid FROM fixed_test) AS in_test, p.pool FROM strict_rows LEFT JOIN usable_pools p USING (trial_uid)""")
def _(spark, d):
    t, s = strict(spark, d)
    return X.fixed_support(t, s, pmax=4, smax=4).select("seed", "trial_uid", "split", "in_test", "pool")


@query("nested_dose_sample", "SELECT trial_uid, pool, CAST(dose_rank AS INT) AS dose_rank FROM sample_ranks WHERE dose_rank<=4")
def _(spark, d):
    t, s = strict(spark, d)
    f = materialize(X.fixed_support(t, s, pmax=4, smax=4, validate=False))
    a = X.nested_dose_sample(f.filter("pool = 'participant'"), "subject_uid", axis="participant", dose=4)
    b = X.nested_dose_sample(f.filter("pool = 'stimulus'"), "stimulus_uid", axis="stimulus", dose=4)
    return a.unionByName(b).select("trial_uid", "pool", "dose_rank")


def donors_sql(dose: int, rounded_targets: bool = False) -> str:
    """The sequential rule; with ``rounded_targets`` both targets lie on 9 points and ties go by a hash of the donor."""
    seed = 11 + 1009 * dose
    v, w = (f"round_even({c} * 8, 0) / 8" if rounded_targets else c for c in ("target_valence", "target_arousal"))
    tie = "sha256('11:donor:'||b.trial_uid)" if rounded_targets else f"sha256('{seed}:donor:'||a.trial_uid||':'||b.trial_uid)"
    return f"""
 WITH RECURSIVE a AS MATERIALIZED (SELECT trial_uid, context, {v} AS v, {w} AS w, row_number() OVER (ORDER BY sha256('{seed}:addition:'||trial_uid), trial_uid) AS r
   FROM sample_ranks JOIN trials USING (trial_uid) WHERE pool='stimulus' AND dose_rank<={dose}),
 b AS MATERIALIZED (SELECT trial_uid, context, {v} AS v, {w} AS w FROM strict_rows WHERE split='train'),
 m AS (SELECT 0::BIGINT AS r, ''::VARCHAR AS added, []::VARCHAR[] AS taken UNION ALL
  SELECT a.r, any_value(a.trial_uid), list_append(m.taken, arg_min(b.trial_uid, struct_pack(c := (a.context<>b.context)::INT, d := sqrt((a.v-b.v)*(a.v-b.v)+(a.w-b.w)*(a.w-b.w)), h := {tie})))
  FROM m JOIN a ON a.r=m.r+1 JOIN b ON NOT list_contains(m.taken, b.trial_uid) GROUP BY a.r, m.taken)
 SELECT added AS trial_uid, taken[-1] AS donor_uid, {dose} AS stimulus_dose FROM m WHERE r>0"""


view("donors_2", donors_sql(2))
view("donors_4", donors_sql(4))


def additions(spark, d):
    """Train rows and the rows added at doses 2 and 4."""
    t, s = strict(spark, d)
    f = materialize(X.fixed_support(t, s, pmax=4, smax=4, validate=False))
    e = materialize(X.nested_dose_sample(f.filter("pool = 'stimulus'"), "stimulus_uid", axis="stimulus", dose=4))
    return f.filter("split = 'train'"), e.selectExpr("*", "explode(array(2, 4)) AS stimulus_dose").filter("dose_rank <= stimulus_dose")


@query("match_donors", "SELECT CAST(11 AS BIGINT) AS seed, CAST(stimulus_dose AS INT) AS stimulus_dose, trial_uid, donor_uid FROM (SELECT * FROM donors_2 UNION ALL SELECT * FROM donors_4)")
def _(spark, d):
    return X.match_donors(*additions(spark, d))


@query("match_donors_rounded", f"""SELECT CAST(11 AS BIGINT) AS seed, CAST(stimulus_dose AS INT) AS stimulus_dose, trial_uid, donor_uid
FROM (SELECT * FROM ({donors_sql(2, True)}) UNION ALL SELECT * FROM ({donors_sql(4, True)}))""")
def _(spark, d):
    """Targets on a 9-point scale, so that nearly every donor is tied with many."""
    nine = lambda df: df.withColumns({c: F.expr(f"bround({c} * 8, 0) / 8") for c in X.TARGETS})
    train, adds = additions(spark, d)
    return X.match_donors(nine(train), nine(adds), ties="donor")


view("cells", """
SELECT trial_uid, CAST(p AS INT) AS participant_dose, CAST(s AS INT) AS stimulus_dose, CASE WHEN trial_uid IN (SELECT trial_uid FROM fixed_test) THEN 'fixed_joint_test'
  WHEN c.dose_rank<=p THEN 'labelled_participant_calibration' WHEN split='validation' THEN 'strict_validation' WHEN e.dose_rank<=s THEN 'repeated_stimulus_exposure'
  WHEN d.donor_uid IS NOT NULL THEN 'train_size_matched_donor' WHEN split='train' THEN 'population_train' ELSE 'unsupported_or_unused' END AS role
FROM strict_rows t CROSS JOIN (SELECT unnest([0,2,4]) AS p) CROSS JOIN (SELECT unnest([0,2,4]) AS s)
LEFT JOIN (SELECT * FROM sample_ranks WHERE pool='participant') c USING (trial_uid) LEFT JOIN (SELECT * FROM sample_ranks WHERE pool='stimulus') e USING (trial_uid)
LEFT JOIN (SELECT * FROM donors_2 UNION ALL SELECT * FROM donors_4) d ON d.donor_uid=t.trial_uid AND d.stimulus_dose=s""")
view("cell_rows", """SELECT *, CAST(11 AS BIGINT) AS seed, CASE role WHEN 'fixed_joint_test' THEN 'test' WHEN 'labelled_participant_calibration' THEN 'calibration'
 WHEN 'strict_validation' THEN 'validation' WHEN 'repeated_stimulus_exposure' THEN 'train' WHEN 'population_train' THEN 'train' ELSE 'excluded' END AS split FROM cells""")


@query("compile_cells", "SELECT seed, participant_dose, stimulus_dose, trial_uid, split, role FROM cell_rows")
def _(spark, d):
    return cells(spark, d)[1]


SUMS = " ||':'|| ".join(f"CAST(sum(('0x'||substr(sha256(trial_uid),{i},15))::BIGINT::HUGEINT) AS VARCHAR)" for i in (1, 16, 31, 46))
DIGEST = f"sha256(count(*) ||':'|| {SUMS})"


@query("support_digest", f"""SELECT CAST(11 AS BIGINT) AS seed, CAST(p AS INT) AS participant_dose, CAST(s AS INT) AS stimulus_dose, count(*) AS n, {DIGEST} AS support_digest,
 sha256(string_agg(trial_uid, chr(10) ORDER BY trial_uid)) AS listed_sha256 FROM fixed_test CROSS JOIN (SELECT unnest([0,2,4]) AS p) CROSS JOIN (SELECT unnest([0,2,4]) AS s) GROUP BY p, s""")
def _(spark, d):
    return X.support_digests(cells(spark, d)[1], listed=True)


@query("axis_isolation", """
WITH r AS (SELECT participant_dose, stimulus_dose, split, unnest(['context','stimulus_uid']) AS axis, unnest([context, stimulus_uid]) AS id FROM cell_rows JOIN trials USING (trial_uid) WHERE split<>'excluded'),
g AS (SELECT participant_dose, stimulus_dose, axis, id, bool_or(split<>'test') dev, bool_or(split='test') t FROM r GROUP BY ALL)
SELECT CAST(11 AS BIGINT) AS seed, participant_dose, stimulus_dose, axis, true AS complete, count_if(dev AND t) AS overlap, count_if(dev AND t)=0 AS verified FROM g GROUP BY ALL
UNION ALL SELECT DISTINCT CAST(11 AS BIGINT), participant_dose, stimulus_dose, 'device_id', false, NULL, false FROM cell_rows""")
def _(spark, d):
    t, c = cells(spark, d)
    return X.axis_isolation(t, c, ["context", "stimulus_uid", "device_id"])


@query("claim_card", """SELECT DISTINCT CAST(11 AS BIGINT) AS seed, participant_dose, stimulus_dose, 'participant-0'||participant_dose||'_stimulus-0'||stimulus_dose AS cell,
 'Prediction for '||CASE WHEN participant_dose=0 THEN 'zero labelled target-participant calibration' ELSE 'a known participant with '||participant_dose||' labelled calibration trials' END||' and '||
 CASE WHEN stimulus_dose=0 THEN 'a stimulus absent from population training' ELSE 'a stimulus represented by '||stimulus_dose||' other-participant ratings' END||'.' AS supported_deployment,
 participant_dose>0 AS participant_identity_id_required, 6 AS blocked FROM cells""")
def _(spark, d):
    t, c = cells(spark, d)
    card = X.claim_card(c.groupBy(*X.CELL).count().drop("count"), verified=["session"])
    return card.selectExpr(*X.CELL, "cell", "supported_deployment", "participant_identity_id_required", "size(blocked_claims) AS blocked")


@query("claim_card_isolated", """
WITH r AS (SELECT participant_dose AS p, stimulus_dose AS s, split, unnest(['session','dataset','device']) AS axis, unnest([subject_uid, dataset_id, 'v'||event_id%5]) AS id FROM cell_rows JOIN trials USING (trial_uid) WHERE split<>'excluded'),
g AS (SELECT p, s, axis, id, bool_or(split<>'test') AS dev, bool_or(split='test') AS te FROM r GROUP BY ALL),
o AS (SELECT p, s, axis, count_if(dev AND te)=0 AS ok FROM g GROUP BY ALL),
w AS (SELECT p, s, bool_or(ok) FILTER (axis='session') AS a, bool_or(ok) FILTER (axis='dataset') AS b, bool_or(ok) FILTER (axis='device') AS c FROM o GROUP BY 1, 2)
SELECT CAST(11 AS BIGINT) AS seed, p AS participant_dose, s AS stimulus_dose, 'participant-0'||p||'_stimulus-0'||s AS cell, p AS participant_labels_required, s AS same_stimulus_training_labels_required,
 concat_ws(',', CASE WHEN a THEN 'session' END, CASE WHEN b THEN 'dataset' END, CASE WHEN c THEN 'device' END) AS verified_holdouts, 'session,device' AS requested_holdouts, 'clinic' AS deployment_context,
 concat_ws('|', 'latent or true emotion disentanglement', 'causal removal of participant or stimulus identity', 'fully subject-independent prediction when participant calibration is non-zero',
  'unseen-stimulus prediction when stimulus exposure is non-zero', CASE WHEN NOT a THEN 'session-independent generalization' END, CASE WHEN NOT b THEN 'cross-dataset generalization' END, CASE WHEN NOT c THEN 'cross-device generalization' END) AS blocked_claims FROM w""")
def _(spark, d):
    """Cards whose claims follow from the isolation that each cell really has: a session is a user here."""
    t, c = cells(spark, d)
    c = materialize(c)
    t = t.selectExpr("*", "subject_uid AS session_uid", "concat('v', event_id % 5) AS device_id")
    isolation = X.axis_isolation(t, c, ["session_uid", "dataset_id", "device_id"])
    card = X.claim_card(c.select(*X.CELL).distinct(), isolation=isolation, requested=["session", "device"], context="clinic")
    return card.selectExpr(
        *X.CELL, "cell", "participant_labels_required", "same_stimulus_training_labels_required", "array_join(verified_holdouts, ',') AS verified_holdouts",
        "array_join(requested_holdouts, ',') AS requested_holdouts", "deployment_context", "array_join(blocked_claims, '|') AS blocked_claims",
    )


@query("cell_audit", """SELECT seed, participant_dose, stimulus_dose, """ + ", ".join(f"count_if(split='{s}') AS {s}_rows" for s in ("train", "validation", "calibration", "test", "excluded")) + """,
 count_if(role='train_size_matched_donor') AS donors, count_if(role='repeated_stimulus_exposure') AS exposures, count_if(split='train')=(SELECT count(*) FROM strict WHERE split='train') AS train_size_preserved
FROM cell_rows GROUP BY 1,2,3""")
def _(spark, d):
    return X.cell_audit(cells(spark, d)[1])


@query("coverage_report", """
WITH t AS (SELECT trial_uid, count(DISTINCT fold) AS f FROM blocks WHERE split='test' GROUP BY 1)
SELECT count(DISTINCT subject_uid) AS subjects, count(DISTINCT stimulus_uid) AS stimuli, count(*) AS trials, count(DISTINCT subject_uid) FILTER (f IS NOT NULL) AS tested_subjects,
 count(DISTINCT stimulus_uid) FILTER (f IS NOT NULL) AS tested_stimuli, count(f) AS tested_trials, count_if(f>1) AS trials_tested_twice FROM trials LEFT JOIN t USING (trial_uid)""")
def _(spark, d):
    t = V.trials(spark, d)
    return X.coverage_report(t, S.coverage_blocks(t, folds=5, seed=7))


@query("verify_doses", """
WITH r AS (SELECT c.*, subject_uid, stimulus_uid FROM cell_rows c JOIN trials USING (trial_uid) WHERE split<>'excluded'),
a AS (SELECT seed, participant_dose, stimulus_dose, subject_uid, count_if(role='labelled_participant_calibration') n, count_if(split IN ('train','validation')) f FROM r GROUP BY ALL HAVING bool_or(split='test')),
b AS (SELECT seed, participant_dose, stimulus_dose, stimulus_uid, count_if(role='repeated_stimulus_exposure') n, count_if(split='calibration') c FROM r GROUP BY ALL HAVING bool_or(split='test')),
x AS (SELECT seed, participant_dose, stimulus_dose, count(*) AS test_participants, count_if(n<>participant_dose) AS wrong_participant_doses, CAST(sum(f) AS BIGINT) AS fit_rows_of_test_participants FROM a GROUP BY 1,2,3),
y AS (SELECT seed, participant_dose, stimulus_dose, count(*) AS test_stimuluss, count_if(n<>stimulus_dose) AS wrong_stimulus_doses, CAST(sum(c) AS BIGINT) AS calibration_rows_on_test_stimuli FROM b GROUP BY 1,2,3)
SELECT * FROM x JOIN y USING (seed, participant_dose, stimulus_dose)""")
def _(spark, d):
    t, c = cells(spark, d)
    return X.verify_doses(t, c)


@query("grid_completeness", """
WITH p AS (SELECT 'm'||user_id%2 AS representation, user_id%3 AS seed, k%2 AS participant_dose, 0 AS stimulus_dose, trial_uid FROM trials WHERE NOT (user_id%6=1 AND k%2=1)),
f AS (SELECT representation, seed, participant_dose, stimulus_dose, count(*) AS rows, string_agg(trial_uid, ',' ORDER BY trial_uid) AS s FROM p GROUP BY 1,2,3,4),
g AS (SELECT * FROM (SELECT DISTINCT representation FROM p) CROSS JOIN (SELECT DISTINCT seed FROM p) CROSS JOIN (SELECT DISTINCT participant_dose FROM p) CROSS JOIN (SELECT DISTINCT stimulus_dose FROM p))
SELECT representation, seed, participant_dose, stimulus_dose, coalesce(rows,0) AS rows, rows IS NOT NULL AS present, coalesce(lo=hi,false) AS same_support FROM g LEFT JOIN f USING (representation, seed, participant_dose, stimulus_dose) LEFT JOIN (SELECT seed, min(s) lo, max(s) hi FROM f GROUP BY 1) USING (seed)""")
def _(spark, d):
    p = V.trials(spark, d).filter("not (user_id % 6 = 1 and k % 2 = 1)").selectExpr(
        "concat('m', user_id % 2) AS representation", "user_id % 3 AS seed", "k % 2 AS participant_dose", "0 AS stimulus_dose", "trial_uid"
    )
    return X.grid_completeness(p)


view("phase_rows", f"""
SELECT t.*, CASE WHEN a.role<>b.role THEN 'excluded' WHEN a.role='fit' THEN 'train' WHEN a.role='tuning' THEN 'validation' WHEN a.role='validation' THEN 'test' ELSE 'excluded' END AS split
FROM trials t JOIN ({roles_sql('subject_uid', 5)}) a USING (subject_uid) JOIN ({roles_sql('stimulus_uid', 6)}) b USING (stimulus_uid) WHERE a.role<>'test' AND b.role<>'test'""")


@query("phase_assignment", """
WITH h AS (SELECT *, subject_uid IN (SELECT subject_uid FROM phase_rows WHERE split='test') hs, stimulus_uid IN (SELECT stimulus_uid FROM phase_rows WHERE split='test') hk FROM phase_rows),
es AS (SELECT subject_uid FROM h WHERE split='excluded' AND hs AND NOT hk GROUP BY 1 HAVING count(*)>=4), ek AS (SELECT stimulus_uid FROM h WHERE split='excluded' AND hk AND NOT hs GROUP BY 1 HAVING count(*)>=2),
ft AS (SELECT * FROM h WHERE split='test' AND subject_uid IN (FROM es) AND stimulus_uid IN (FROM ek)),
n AS (SELECT count(DISTINCT subject_uid) su, count(DISTINCT stimulus_uid) st, count(*) t FROM ft)
SELECT 'validation' AS phase, split, n FROM (
 SELECT 'test' AS split, t AS n FROM n UNION ALL SELECT 'calibration', 4*su FROM n UNION ALL SELECT 'train', (SELECT count(*) FROM h WHERE split='train') UNION ALL SELECT 'validation', (SELECT count(*) FROM h WHERE split='validation')
 UNION ALL SELECT 'excluded', (SELECT count(*) FROM h)-t-4*su-(SELECT count(*) FROM h WHERE split IN ('train','validation')) FROM n)""")
def _(spark, d):
    t = V.trials(spark, d)
    out = X.phase_assignment(
        t, S.identity_roles(t, "subject_uid", seed=5), S.identity_roles(t, "stimulus_uid", seed=6), phase="validation", p=4, s=2, pmax=4, smax=2, seed=11
    )
    return out.groupBy("phase", "split").agg(F.count(F.lit(1)).alias("n"))


def phase_sql(sql: str) -> str:
    """A view of the strict split, read over the rows of the selector's validation phase instead."""
    sql = re.sub(r"\b(pools|fixed_test|usable_pools|sample_ranks)\b", r"phase_\1", sql)
    return re.sub(r"\bstrict_rows\b", "phase_rows", sql)


for _name in ("pools", "fixed_test", "usable_pools", "sample_ranks"):
    # the stimulus dose of this phase is 2
    view(f"phase_{_name}", phase_sql(VIEWS[_name]).replace("pool='stimulus' GROUP BY 1 HAVING count(*)>=4", "pool='stimulus' GROUP BY 1 HAVING count(*)>=2"))
view("phase_donors", phase_sql(donors_sql(2)))


@query("phase_assignment_rows", """
WITH r AS (SELECT t.trial_uid, CASE WHEN t.trial_uid IN (SELECT trial_uid FROM phase_fixed_test) THEN 'fixed_joint_test' WHEN c.dose_rank<=4 THEN 'labelled_participant_calibration'
  WHEN split='validation' THEN 'strict_validation' WHEN e.dose_rank<=2 THEN 'repeated_stimulus_exposure' WHEN d.donor_uid IS NOT NULL THEN 'train_size_matched_donor'
  WHEN split='train' THEN 'population_train' ELSE 'unsupported_or_unused' END AS role
 FROM phase_rows t LEFT JOIN (SELECT * FROM phase_sample_ranks WHERE pool='participant') c USING (trial_uid) LEFT JOIN (SELECT * FROM phase_sample_ranks WHERE pool='stimulus') e USING (trial_uid)
 LEFT JOIN phase_donors d ON d.donor_uid=t.trial_uid)
SELECT 'validation' AS phase, trial_uid, role, CASE role WHEN 'fixed_joint_test' THEN 'test' WHEN 'labelled_participant_calibration' THEN 'calibration' WHEN 'strict_validation' THEN 'validation'
 WHEN 'repeated_stimulus_exposure' THEN 'train' WHEN 'population_train' THEN 'train' ELSE 'excluded' END AS split FROM r""")
def _(spark, d):
    t = V.trials(spark, d)
    roles = (S.identity_roles(t, c, seed=s) for c, s in (("subject_uid", 5), ("stimulus_uid", 6)))
    return X.phase_assignment(t, *roles, phase="validation", p=4, s=2, pmax=4, smax=2, seed=11).select("phase", "trial_uid", "role", "split")


@query("support_matched_rows", """
WITH RECURSIVE t AS MATERIALIZED (SELECT trial_uid, subject_uid, stimulus_uid, sha256('11:'||trial_uid) AS h, CASE WHEN event_id%40=0 THEN 'test' WHEN event_id%40=1 THEN 'validation' ELSE 'train' END AS split FROM trials),
f AS MATERIALIZED (SELECT trial_uid, h, CASE WHEN subject_uid IN (SELECT subject_uid FROM t WHERE split='test') THEN subject_uid END AS p,
  CASE WHEN stimulus_uid IN (SELECT stimulus_uid FROM t WHERE split='test') THEN stimulus_uid END AS k FROM t WHERE split<>'test'),
g AS (SELECT 0 AS step, []::VARCHAR[] AS ps, []::VARCHAR[] AS ks, []::VARCHAR[] AS chosen UNION ALL
 SELECT step+1, CASE WHEN b.p IS NULL OR list_contains(ps, b.p) THEN ps ELSE list_append(ps, b.p) END, CASE WHEN b.k IS NULL OR list_contains(ks, b.k) THEN ks ELSE list_append(ks, b.k) END, list_append(chosen, b.u)
 FROM (SELECT step, ps, ks, chosen, arg_min(struct_pack(u := f.trial_uid, p := f.p, k := f.k), struct_pack(gain := -((f.p IS NOT NULL AND NOT list_contains(ps, f.p))::INT + (f.k IS NOT NULL AND NOT list_contains(ks, f.k))::INT),
   h := f.h, u := f.trial_uid)) AS b FROM g JOIN f ON (f.p IS NOT NULL AND NOT list_contains(ps, f.p)) OR (f.k IS NOT NULL AND NOT list_contains(ks, f.k)) GROUP BY step, ps, ks, chosen)),
c AS MATERIALIZED (SELECT unnest(chosen) AS trial_uid FROM (SELECT chosen FROM g ORDER BY step DESC LIMIT 1)),
n AS (SELECT count_if(split='train')-(SELECT count(*) FROM c) AS a, count_if(split='validation') AS b FROM t),
r AS (SELECT trial_uid, row_number() OVER (ORDER BY h, trial_uid) AS o FROM t WHERE split<>'test' AND trial_uid NOT IN (FROM c))
SELECT trial_uid, 'test' AS split FROM t WHERE split='test' UNION ALL SELECT trial_uid, 'train' FROM c
UNION ALL SELECT trial_uid, CASE WHEN o<=a THEN 'train' ELSE 'validation' END FROM r CROSS JOIN n WHERE o<=a+b""")
def _(spark, d):
    t = V.trials(spark, d)
    ref = t.selectExpr("trial_uid", "case event_id % 40 when 0 then 'test' when 1 then 'validation' else 'train' end AS split", "cast(11 as bigint) AS seed")
    return X.support_matched_overlap(t, ref, validate=False).select("trial_uid", "split")


# the reference split holds out subjects, so pool rows can cover a test stimulus only;
# the joint matching phase is exercised by a split that ignores identity
@query("support_matched_overlap", """
WITH t AS (SELECT trial_uid, subject_uid, stimulus_uid, CASE WHEN event_id%40=0 THEN 'test' WHEN event_id%40=1 THEN 'validation' ELSE 'train' END AS split FROM trials)
SELECT split, count(*) AS n, round(1.0,6) AS subject_overlap, round(1.0,6) AS stimulus_overlap FROM t GROUP BY split""")
def _(spark, d):
    t = V.trials(spark, d)
    ref = t.selectExpr("trial_uid", "case event_id % 40 when 0 then 'test' when 1 then 'validation' else 'train' end AS split", "cast(11 as bigint) AS seed")
    out = materialize(X.support_matched_overlap(t, ref, validate=False)).join(t.select("trial_uid", "subject_uid", "stimulus_uid"), "trial_uid")
    overlap = []
    for c in ("subject_uid", "stimulus_uid"):
        per = out.groupBy(c).agg(F.expr("bool_or(split = 'test')").alias("te"), F.expr("bool_or(split = 'train')").alias("tr")).filter("te")
        overlap.append(per.agg(F.avg(F.col("tr").cast("double")).alias(c.replace("_uid", "_overlap"))))
    return rounded(out.groupBy("split").agg(F.count(F.lit(1)).alias("n")).crossJoin(overlap[0]).crossJoin(overlap[1]))
