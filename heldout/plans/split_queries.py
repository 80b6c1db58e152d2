"""Split assignment queries over the trial views."""

from __future__ import annotations

from pyspark.sql import functions as F

from heldout.operators import splits as S
from heldout.plans.registry import query, view
from heldout.sources import views as V

TRIALS_SQL = """
SELECT 'ev:' || event_id AS trial_uid, 'ev' AS dataset_id, 'u' || user_id AS subject_uid, 'k' || k AS stimulus_uid,
  event_type AS context,
  0.5::DOUBLE*k/99.0 + 0.3::DOUBLE*(least(value,500.0::DOUBLE)/500) + 0.2::DOUBLE*(user_id%7)/6 AS target_valence,
  0.5::DOUBLE*((k*37)%100)/99.0 + 0.3::DOUBLE*((user_id*13)%11)/10 + 0.2::DOUBLE*(least(value,500.0::DOUBLE)/500) AS target_arousal,
  event_id % 17 <> 0 AS label_available, event_id, user_id, k, value
FROM (SELECT *, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events)
"""
view("trials", TRIALS_SQL)
view("trials_multi", """
SELECT trial_uid, 'd' || user_id % 3 AS dataset_id, 'd' || user_id % 3 || ':' || subject_uid AS subject_uid,
  'd' || user_id % 3 || ':' || stimulus_uid AS stimulus_uid, context, target_valence, target_arousal, label_available,
  event_id, user_id, k, value FROM trials""")


def three_way_sql(v: float, t: float) -> str:
    tc = f"greatest(1, CAST(round_even(n*{t}::DOUBLE,0) AS BIGINT))"
    vc = f"greatest(1, CAST(round_even(n*{v}::DOUBLE,0) AS BIGINT))"
    t2 = f"(CASE WHEN {tc}+{vc}>=n THEN greatest(1,n-{vc}-1) ELSE {tc} END)"
    t3 = f"(CASE WHEN {t2}+{vc}>=n THEN n-2 ELSE {t2} END)"
    v3 = f"(CASE WHEN {t2}+{vc}>=n THEN 1 ELSE {vc} END)"
    return f"CASE WHEN r<={t3} THEN 'test' WHEN r<={t3}+{v3} THEN 'validation' ELSE 'train' END"


def partition_sql(source: str, group: str, seed: int, v=0.1, t=0.2, stratum: str | None = None) -> str:
    if stratum is None:
        return f"""SELECT {group}, {three_way_sql(v, t)} AS split FROM (
  SELECT {group}, row_number() OVER (ORDER BY sha256('{seed}:{group}:' || {group}), {group}) AS r, count(*) OVER () AS n
  FROM (SELECT DISTINCT {group} FROM {source}))"""
    return f"""SELECT {group}, {stratum}, {three_way_sql(v, t)} AS split FROM (
  SELECT {group}, {stratum}, row_number() OVER (PARTITION BY {stratum}
    ORDER BY sha256(({seed} + 1009*(ix-1)) || ':{group}:' || {group}), {group}) AS r, count(*) OVER (PARTITION BY {stratum}) AS n
  FROM (SELECT {group}, {stratum}, dense_rank() OVER (ORDER BY {stratum}) AS ix
        FROM (SELECT DISTINCT {group}, {stratum} FROM {source})))"""


def strict_sql(source="trials", seed=11, v=0.1, t=0.2) -> str:
    a = partition_sql(source, "subject_uid", seed, v, t)
    b = partition_sql(source, "stimulus_uid", seed + 100003, v, t)
    return f"""SELECT t.trial_uid, CASE WHEN a.split = b.split THEN a.split ELSE 'excluded' END AS split,
  'subject_uid_and_stimulus_uid_held_out' AS protocol, CAST({seed} AS BIGINT) AS seed
FROM {source} t JOIN ({a}) a USING (subject_uid) JOIN ({b}) b USING (stimulus_uid)"""


view("strict", strict_sql())
view("subject_split", f"""SELECT t.trial_uid, p.split, 'subject_uid_held_out' AS protocol, CAST(11 AS BIGINT) AS seed
FROM trials t JOIN ({partition_sql('trials', 'subject_uid', 11)}) p USING (subject_uid)""")


@query("group_holdout", "SELECT * FROM subject_split")
def _(spark, d):
    return S.group_holdout(V.trials(spark, d), "subject_uid")


STRAT = partition_sql("trials_multi", "subject_uid", 11, stratum="dataset_id")
view("stratified_split", f"""SELECT t.trial_uid, p.split, 'subject_uid_held_out' AS protocol, CAST(11 AS BIGINT) AS seed
FROM trials_multi t JOIN ({STRAT}) p USING (subject_uid, dataset_id)""")


@query("stratified_group_holdout", "SELECT * FROM stratified_split")
def _(spark, d):
    return S.stratified_group_holdout(V.trials_multi(spark, d), "subject_uid", "dataset_id")


@query("double_holdout", "SELECT * FROM strict")
def _(spark, d):
    return S.double_holdout(V.trials(spark, d))


@query("context_transfer", f"""SELECT trial_uid, CASE WHEN context='view' AND split IN ('train','validation') THEN split
  WHEN context='click' AND split='test' THEN 'test' ELSE 'excluded' END AS split,
  'view_to_click_subject_held_out' AS protocol, CAST(11 AS BIGINT) AS seed
FROM trials JOIN ({partition_sql('trials', 'subject_uid', 11, 0.15, 0.2)}) USING (subject_uid)""")
def _(spark, d):
    return S.context_transfer(V.trials(spark, d), source="view", target="click")


@query("context_only_transfer", """
WITH s AS (SELECT trial_uid, row_number() OVER w AS r, count(*) OVER (PARTITION BY subject_uid, condition_family) AS n
  FROM (SELECT *, 'f' || user_id % 2 AS condition_family FROM trials WHERE context='view')
  WINDOW w AS (PARTITION BY subject_uid, condition_family ORDER BY sha256('11:context_only:' || trial_uid), trial_uid))
SELECT trial_uid, split, 'view_to_click_context_only' AS protocol, CAST(11 AS BIGINT) AS seed FROM (
 SELECT trial_uid, CASE WHEN r <= least(greatest(1, CAST(round_even(n*0.15::DOUBLE,0) AS BIGINT)), n-1) THEN 'validation' ELSE 'train' END AS split FROM s
 UNION ALL SELECT trial_uid, CASE WHEN context='click' THEN 'test' ELSE 'excluded' END FROM trials WHERE context<>'view')""")
def _(spark, d):
    t = V.trials(spark, d).withColumn("condition_family", F.expr("concat('f', user_id % 2)"))
    return S.context_only_transfer(t, source="view", target="click", strict=False)


RANDOM = partition_sql("trials_multi", "trial_uid", 11, stratum="dataset_id")


@query("trial_random_holdout", f"SELECT trial_uid, split, 'trial_random' AS protocol, CAST(11 AS BIGINT) AS seed FROM ({RANDOM})")
def _(spark, d):
    return S.trial_random_holdout(V.trials_multi(spark, d))


@query("context_or_dataset_holdout", f"""
SELECT trial_uid, split, 'context_held_out' AS protocol, CAST(11 AS BIGINT) AS seed FROM trials_multi JOIN ({partition_sql('trials_multi', 'context', 11)}) USING (context)
UNION ALL SELECT trial_uid, split, 'dataset_id_held_out', CAST(11 AS BIGINT) FROM trials_multi JOIN ({partition_sql('trials_multi', 'dataset_id', 11)}) USING (dataset_id)""")
def _(spark, d):
    return S.context_or_dataset_holdout(V.trials_multi(spark, d))


def _batch_sql(seed: int) -> str:
    def one(group):
        p = partition_sql("trials_multi", group, seed, stratum="dataset_id")
        return f"SELECT t.trial_uid, split, '{group}_held_out' AS protocol, {seed} AS seed FROM trials_multi t JOIN ({p}) USING ({group}, dataset_id)"

    a = partition_sql("trials_multi", "subject_uid", seed, 0.2, 0.2, "dataset_id")
    b = partition_sql("trials_multi", "stimulus_uid", seed + 100003, 0.2, 0.2, "dataset_id")
    r = partition_sql("trials_multi", "trial_uid", seed, stratum="dataset_id")
    return " UNION ALL ".join([
        one("subject_uid"), one("stimulus_uid"),
        f"""SELECT t.trial_uid, CASE WHEN a.split=b.split THEN a.split ELSE 'excluded' END, 'subject_uid_and_stimulus_uid_held_out', {seed}
        FROM trials_multi t JOIN ({a}) a USING (subject_uid, dataset_id) JOIN ({b}) b USING (stimulus_uid, dataset_id)""",
        f"SELECT trial_uid, split, 'trial_random', {seed} FROM ({r})",
    ])


@query("split_batch", f"""
WITH b AS ({_batch_sql(11)} UNION ALL {_batch_sql(12)})
SELECT protocol, CAST(seed AS BIGINT) AS seed, split, count(*) AS trials, CAST(sum(label_available::INT) AS BIGINT) AS labelled
FROM b JOIN trials_multi USING (trial_uid) GROUP BY ALL""")
def _(spark, d):
    t = V.trials_multi(spark, d)
    return S.split_batch_audit(t, S.split_batch(t, seeds=(11, 12), validate=False))


@query("split_batch_rows", f"""
WITH b AS ({_batch_sql(11)} UNION ALL {_batch_sql(12)})
SELECT protocol, CAST(seed AS BIGINT) AS seed, trial_uid, split FROM b""")
def _(spark, d):
    return S.split_batch(V.trials_multi(spark, d), seeds=(11, 12), validate=False).select("protocol", "seed", "trial_uid", "split")


def _block_sql(col, seed):
    return f"""SELECT {col}, (row_number() OVER (ORDER BY sha256('{seed}:{col}:' || {col}), {col}) - 1) % 5 AS b
      FROM (SELECT DISTINCT {col} FROM trials)"""


view("blocks", f"""
SELECT trial_uid, CAST(f AS INT) AS fold, CASE WHEN a.b=f AND c.b=f THEN 'test' WHEN a.b=(f+1)%5 AND c.b=(f+1)%5 THEN 'validation'
  WHEN a.b NOT IN (f,(f+1)%5) AND c.b NOT IN (f,(f+1)%5) THEN 'train' ELSE 'excluded' END AS split, CAST(7 AS BIGINT) AS seed
FROM trials JOIN ({_block_sql('subject_uid', 7)}) a USING (subject_uid) JOIN ({_block_sql('stimulus_uid', 100010)}) c USING (stimulus_uid)
CROSS JOIN (SELECT unnest(range(5)) AS f)""")


@query("coverage_blocks", "SELECT * FROM blocks")
def _(spark, d):
    return S.coverage_blocks(V.trials(spark, d), folds=5, seed=7)


def roles_sql(col: str, seed: int) -> str:
    v, t, u = (f"greatest(2, CAST(floor(n*{x}::DOUBLE) AS BIGINT))" for x in (0.15, 0.2, 0.2))
    return f"""SELECT {col}, CASE WHEN r<={v} THEN 'validation' WHEN r<={v}+{t} THEN 'test' WHEN r<={v}+{t}+{u} THEN 'tuning' ELSE 'fit' END AS role
 FROM (SELECT {col}, row_number() OVER (ORDER BY sha256('{seed}:{col}:' || {col}), {col}) AS r, count(*) OVER () AS n
   FROM (SELECT DISTINCT {col} FROM trials))"""


@query("identity_roles", roles_sql("subject_uid", 5))
def _(spark, d):
    return S.identity_roles(V.trials(spark, d), "subject_uid", seed=5)


def overlap_sql(assign: str, col: str) -> str:
    flags = f"SELECT {col}, bool_or(split='train') a, bool_or(split='validation') b, bool_or(split='test') c FROM trials JOIN {assign} USING (trial_uid) GROUP BY 1"
    return f"""SELECT 'overlap:{col}' AS metric, unnest(['train_validation','train_test','validation_test']) AS part,
      unnest([count_if(a AND b), count_if(a AND c), count_if(b AND c)])::BIGINT AS value FROM ({flags})"""


view("strict_audit", f"""
SELECT 'coverage' AS metric, 'trials' AS part, count(*) AS value FROM trials
UNION ALL SELECT 'coverage', unnest(['unassigned','unknown','repeated']), 0
UNION ALL SELECT 'split_count', split, count(*) FROM strict GROUP BY split
UNION ALL {overlap_sql('strict', 'subject_uid')} UNION ALL {overlap_sql('strict', 'stimulus_uid')}
UNION ALL {overlap_sql('strict', 'context')}""")


@query("split_audit", "SELECT * FROM strict_audit")
def _(spark, d):
    t = V.trials(spark, d)
    return S.split_audit(t, S.double_holdout(t, validate=False), ["subject_uid", "stimulus_uid", "context"])


@query("strict_partitions", """
SELECT 'several_seeds' AS check, CAST(0 AS BIGINT) AS violations
UNION ALL SELECT 'unknown_split', 0 UNION ALL SELECT 'trial_unassigned', 0 UNION ALL SELECT 'trial_unknown', 0 UNION ALL SELECT 'trial_repeated', 0
UNION ALL SELECT 'missing_' || p || '_rows', greatest(0, 2 - (SELECT count(*) FROM strict WHERE split=p)) FROM (SELECT unnest(['train','validation','test']) AS p)
UNION ALL SELECT split_part(metric, ':', 2) || '_repeats_in_test', CAST(sum(value) AS BIGINT) FROM strict_audit
  WHERE metric LIKE 'overlap:%' AND part LIKE '%test' GROUP BY 1""")
def _(spark, d):
    t = V.trials(spark, d)
    return S.strict_partitions(t, S.double_holdout(t, validate=False), ["subject_uid", "stimulus_uid", "context"])
