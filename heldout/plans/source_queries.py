"""Source, alignment and document queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from heldout.plans.registry import query, view
from heldout.sources import documents as D
from heldout.sources import trials as T
from heldout.sources import views as V


def _manifests(spark, d):
    t = V.trials(spark, d)
    a = t.filter("event_id % 2 = 0").selectExpr(
        "trial_uid", "dataset_id", "concat('u', user_id) AS subject_id", "stimulus_uid", "context", "label_available"
    )
    b = t.filter("event_id % 2 = 1").selectExpr(
        "trial_uid", "dataset_id", "concat('u', user_id) AS subject_id", "stimulus_uid", "context", "value AS extra"
    )
    return a, b


@query("load_trials", """
SELECT trial_uid, dataset_id, 'u'||user_id AS subject_id, stimulus_uid, context, event_id % 2 = 1 OR label_available AS label_available,
 'ev:u'||user_id AS subject_uid, CASE WHEN event_id % 2 = 1 THEN value END AS extra FROM trials""")
def _(spark, d):
    return T.union_manifests(_manifests(spark, d))


@query("load_features", """
SELECT count(*) AS trials, CAST(0 AS BIGINT) AS repeated_trials, CAST(16 AS BIGINT) AS min_width, CAST(16 AS BIGINT) AS max_width,
  CAST(0 AS BIGINT) AS nonfinite_rows FROM events""")
def _(spark, d):
    return T.feature_faults(T.feature_view(V.features(spark, d), "global", channels=8, bands=8))


view("features", """
SELECT trial_uid, embedding, label FROM trials JOIN embeddings ON vec_id = event_id % (SELECT count(*) FROM embeddings)""")


@query("feature_view_global", """
SELECT trial_uid, round(list_sum(list_transform(range(8), lambda c: embedding[c*8+3]::DOUBLE))/8, 6) AS mean_band_2,
  round(list_aggregate(list_transform(range(8), lambda c: embedding[c*8+3]::DOUBLE), 'stddev_pop'), 6) AS sd_band_2 FROM features""")
def _(spark, d):
    f = T.feature_view(V.features(spark, d), "global", channels=8, bands=8)
    return f.selectExpr("trial_uid", "round(features[2], 6) AS mean_band_2", "round(features[10], 6) AS sd_band_2")


def _predictions(spark, d, scale, name):
    t = V.trials(spark, d)
    return t.selectExpr(
        "'p' AS protocol", "cast(11 as bigint) AS seed", "trial_uid", "dataset_id", "subject_uid AS subject_id", "stimulus_uid",
        "context", "target_valence", "target_arousal", f"target_valence * {scale}D AS {name}_valence", f"target_arousal * {scale}D AS {name}_arousal",
    )


@query("align_predictions", """
SELECT 'p' AS protocol, CAST(11 AS BIGINT) AS seed, trial_uid, dataset_id, subject_uid AS subject_id, stimulus_uid, context,
 round(target_valence,6) AS target_valence, round(target_arousal,6) AS target_arousal, round(target_valence*0.513::DOUBLE,6) AS a_valence,
 round(target_arousal*0.513::DOUBLE,6) AS a_arousal, round(target_valence*0.257::DOUBLE,6) AS b_valence, round(target_arousal*0.257::DOUBLE,6) AS b_arousal FROM trials""")
def _(spark, d):
    out = T.align_predictions({
        "a": (_predictions(spark, d, 0.513, "m"), "m"), "b": (_predictions(spark, d, 0.257, "w"), "w"),
    })
    return out.selectExpr(*[f"round({c}, 6) AS {c}" if t == "double" else c for c, t in out.dtypes])


@query("align_feature_support", """
SELECT count(*) AS archive_trial_count, count_if(label_available) AS used_labelled_trial_count,
  count_if(NOT label_available) AS ignored_unlabelled_trial_count, CAST(0 AS BIGINT) AS missing_trial_count FROM trials""")
def _(spark, d):
    t = V.trials(spark, d)
    return T.feature_support(t.select("trial_uid"), t.filter("label_available"))


@query("align_feature_rows", """
SELECT trial_uid, round(embedding[1]::DOUBLE, 6) AS first_feature FROM features JOIN trials USING (trial_uid) WHERE label_available""")
def _(spark, d):
    kept = T.align_feature_support(V.features(spark, d), V.trials(spark, d).filter("label_available"))
    return kept.selectExpr("trial_uid", "round(features[0], 6) AS first_feature")


@query("merge_feature_shards", "SELECT trial_uid, event_id AS position, user_id % 3 AS shard FROM trials")
def _(spark, d):
    t = V.trials(spark, d)
    shards = [t.filter(f"user_id % 3 = {i}").selectExpr("trial_uid", f"cast({i} as bigint) AS shard") for i in range(3)]
    return T.merge_feature_shards(shards, t.selectExpr("trial_uid", "event_id AS position"))


@query("write_ordered", "SELECT trial_uid, subject_uid, stimulus_uid FROM trials")
def _(spark, d):
    return T.ordered_layout(V.trials(spark, d).select("trial_uid", "subject_uid", "stimulus_uid"), ["subject_uid", "trial_uid"])


NESTED = """to_json(named_struct('k', k, 'inner', named_struct('value', value, 'flag', label_available, 'list', array(k, user_id)), 'name', context))"""


@query("flatten_json_numeric", """
SELECT 'ev:'||event_id AS asset, unnest(['$.k','$.inner.value','$.inner.list[0]','$.inner.list[1]']) AS json_path,
  unnest([k::DOUBLE, value, k::DOUBLE, user_id::DOUBLE]) AS value FROM trials""")
def _(spark, d):
    docs = V.trials(spark, d).selectExpr("trial_uid AS asset", f"{NESTED} AS json")
    return D.flatten_json_numeric(docs)


BENCH = """to_json(named_struct('results', array(named_struct('protocol', context, 'seed', k, 'models',
  map('ridge', map('all', map('valence', map('ccc', target_valence, 'mae', value)))), 'comparisons',
  map('a_minus_b', map('delta', value))))))"""


@query("flatten_benchmark_rows", """
SELECT trial_uid AS asset, context AS protocol, CAST(k AS VARCHAR) AS seed, 'ridge' AS model, 'all' AS context, 'valence' AS target,
 unnest(['ccc','mae']) AS metric, round(unnest([target_valence, value]), 6) AS value FROM trials""")
def _(spark, d):
    docs = V.trials(spark, d).selectExpr("trial_uid AS asset", f"{BENCH} AS json")
    out = D.flatten_benchmark_rows(docs)
    return out.withColumn("value", F.round("value", 6))


PAIRED = """concat('{"results":[{"protocol":"', context, '","comparisons":{"a_minus_b":{"delta":', value, ',"flag":true,"ci95":[', k, ',', user_id, ']}}}]}')"""


@query("flatten_paired_rows", """
SELECT trial_uid AS asset, context AS protocol, 'a_minus_b' AS comparison, 'delta' AS statistic, value, CAST(NULL AS DOUBLE) AS ci_low, CAST(NULL AS DOUBLE) AS ci_high FROM trials
UNION ALL SELECT trial_uid, context, 'a_minus_b', 'ci95', NULL, k::DOUBLE, user_id::DOUBLE FROM trials""")
def _(spark, d):
    return D.flatten_paired_rows(V.trials(spark, d).selectExpr("trial_uid AS asset", f"{PAIRED} AS json"))


@query("verify_file_manifest", """
SELECT 'doc/'||doc_id AS path, CASE WHEN doc_id % 10 = 0 THEN 'unlisted' WHEN doc_id % 10 = 1 THEN 'missing' WHEN doc_id % 10 = 2 THEN 'hash_mismatch'
 WHEN doc_id % 10 = 3 THEN 'size_mismatch' ELSE 'ok' END AS status FROM documents""")
def _(spark, d):
    files = V.table(spark, d, "documents").selectExpr(
        "doc_id", "concat('doc/', doc_id) AS path", "sha2(text, 256) AS sha256", "octet_length(text) AS bytes"
    )
    manifest = files.filter("doc_id % 10 <> 0").selectExpr(
        "path", "if(doc_id % 10 = 2, reverse(sha256), sha256) AS sha256", "if(doc_id % 10 = 3, bytes + 1, bytes) AS bytes"
    )
    return D.verify_file_manifest(manifest, files.filter("doc_id % 10 <> 1"))


@query("eligible_trials", "SELECT trial_uid FROM trials WHERE label_available AND context<>'error' AND value>20")
def _(spark, d):
    t = V.trials(spark, d).selectExpr(
        "*", "if(context = 'error', 'excluded', 'verified') AS alignment_status", "value - 20 AS duration_s"
    )
    return T.eligible_trials(t).select("trial_uid")


@query("ensure_entity_uids", """
SELECT trial_uid, CASE WHEN user_id%3=0 THEN 'ev:'||user_id ELSE subject_uid END AS subject_uid,
 CASE WHEN k%3=0 THEN 'ev:unavailable' WHEN k%3=1 THEN 'ev:'||k ELSE stimulus_uid END AS stimulus_uid FROM trials""")
def _(spark, d):
    t = V.trials(spark, d).selectExpr(
        "trial_uid", "dataset_id", "cast(user_id as string) AS subject_id", "if(user_id % 3 = 0, ' ', subject_uid) AS subject_uid",
        "if(k % 3 = 0, '', cast(k as string)) AS stimulus_id", "if(k % 3 in (0, 1), null, stimulus_uid) AS stimulus_uid",
    )
    return T.ensure_entity_uids(t).select("trial_uid", "subject_uid", "stimulus_uid")


@query("exclude_subjects", """
SELECT subject_uid, count(*) AS n, user_id % 10 = 3 AS dropped FROM trials GROUP BY subject_uid, user_id % 10 = 3""")
def _(spark, d):
    t = V.trials(spark, d)
    kept, dropped = T.exclude_subjects(t, t.filter("user_id % 10 = 3").select("subject_uid"))
    both = kept.withColumn("dropped", F.lit(False)).unionByName(dropped.withColumn("dropped", F.lit(True)))
    return both.groupBy("subject_uid", "dropped").agg(F.count(F.lit(1)).alias("n"))


@query("file_availability", """
SELECT trial_uid, k%4<>0 AND event_id % 1500 IN (SELECT doc_id FROM documents) AS available FROM trials""")
def _(spark, d):
    t = V.trials(spark, d).selectExpr(
        "trial_uid", "concat(if(k % 4 = 0, '../', ''), 'doc/', event_id % 1500) AS path"
    )
    listing = V.table(spark, d, "documents").selectExpr("concat('doc/', doc_id) AS path")
    return T.file_availability(t, listing).select("trial_uid", "available")
