"""Prior, offset and metric queries on the subject-held-out split of the trial view."""

from __future__ import annotations

from pyspark.sql import functions as F

from heldout.operators import metrics as M
from heldout.operators import priors as P
from heldout.operators import splits as S
from heldout.plans.registry import VIEWS, query, view
from heldout.sources import views as V

view("assigned", "SELECT trials.*, split FROM trials JOIN subject_split USING (trial_uid)")
view("fitrows", "SELECT * FROM assigned WHERE split='train'")
view("testrows", "SELECT * FROM assigned WHERE split='test'")


def assigned(spark, d):
    t = V.trials(spark, d)
    return t.join(S.group_holdout(t, "subject_uid", validate=False).select("trial_uid", "split"), "trial_uid")


def rounded(df, digits=6):
    return df.selectExpr(*[f"round({c}, {digits}) AS {c}" if t == "double" else c for c, t in df.dtypes])


def rooted(df):
    return df.withColumns({t: F.sqrt(t) for t in ("target_valence", "target_arousal")})


@query("global_mean", "SELECT round(avg(target_valence),6) AS global_valence, round(avg(target_arousal),6) AS global_arousal FROM fitrows")
def _(spark, d):
    return rounded(P.global_mean(assigned(spark, d).filter("split = 'train'")))


GROUPED = """SELECT r.trial_uid, round(coalesce(v, gv),6) AS prior_valence, round(coalesce(a, ga),6) AS prior_arousal {extra} FROM testrows r
LEFT JOIN (SELECT {g}, avg(target_valence) v, avg(target_arousal) a FROM fitrows {where} GROUP BY 1) USING ({g})
CROSS JOIN (SELECT avg(target_valence) gv, avg(target_arousal) ga FROM fitrows {where})"""


@query("group_mean_prior", GROUPED.format(g="stimulus_uid", extra="", where="WHERE k%5<>0"))
def _(spark, d):
    a = assigned(spark, d)
    out = P.group_mean_prior(a.filter("split = 'train' and k % 5 <> 0"), a.filter("split = 'test'"), "stimulus_uid")
    return rounded(out.select("trial_uid", "prior_valence", "prior_arousal"))


@query("condition_residuals", """SELECT trial_uid, round(target_valence-avg(target_valence) OVER (PARTITION BY context),6) AS residual_valence,
 round(target_arousal-avg(target_arousal) OVER (PARTITION BY context),6) AS residual_arousal FROM trials""")
def _(spark, d):
    return rounded(P.condition_residuals(V.trials(spark, d), "context").select("trial_uid", "residual_valence", "residual_arousal"))


# square roots keep limited-precision inputs away from rounding ties
view("pairgroup", "SELECT * REPLACE (sqrt(target_valence) AS target_valence, sqrt(target_arousal) AS target_arousal), CASE WHEN event_id%50=0 THEN trial_uid ELSE stimulus_uid END AS g FROM trials")
LOO = """SELECT trial_uid, round(CASE WHEN n>1 THEN (sv-target_valence)/(n-1) ELSE {fv} END,6) AS prior_valence,
 round(CASE WHEN n>1 THEN (sa-target_arousal)/(n-1) ELSE {fa} END,6) AS prior_arousal FROM (
 SELECT *, count(*) OVER w AS n, sum(target_valence) OVER w AS sv, sum(target_arousal) OVER w AS sa, count(*) OVER () AS nn,
  sum(target_valence) OVER () AS tv, sum(target_arousal) OVER () AS ta FROM pairgroup WINDOW w AS (PARTITION BY g))"""


def _pairgroup(spark, d):
    return rooted(V.trials(spark, d)).selectExpr("*", "if(event_id % 50 = 0, trial_uid, stimulus_uid) AS g")


@query("loo_group_prior", LOO.format(fv="(tv-target_valence)/(nn-1)", fa="(ta-target_arousal)/(nn-1)"))
def _(spark, d):
    return rounded(P.loo_group_prior(_pairgroup(spark, d), "g").select("trial_uid", "prior_valence", "prior_arousal"))


@query("loo_prior_with_fallback", LOO.format(fv="0.25", fa="0.75"))
def _(spark, d):
    t = _pairgroup(spark, d).selectExpr("*", "0.25D AS fallback_valence", "0.75D AS fallback_arousal")
    return rounded(P.loo_prior_with_fallback(t, "g").select("trial_uid", "prior_valence", "prior_arousal"))


@query("published_prior_fallback", """SELECT trial_uid, round(CASE WHEN k%4<>0 THEN k/99.0::DOUBLE ELSE v END,6) AS fallback_valence,
  round(CASE WHEN k%4<>0 THEN k/198.0::DOUBLE ELSE a END,6) AS fallback_arousal FROM trials CROSS JOIN (SELECT avg(target_valence) v, avg(target_arousal) a FROM trials)""")
def _(spark, d):
    t = V.trials(spark, d)
    p = t.selectExpr("*", "if(k % 4 = 0, double('nan'), k / 99D) AS stimulus_prior_valence", "k / 198D AS stimulus_prior_arousal")
    return rounded(P.published_prior_fallback(p, P.global_mean(t)).select("trial_uid", "fallback_valence", "fallback_arousal"))


@query("seen_group_prior", """SELECT r.trial_uid, round(coalesce(v, 0.5),6) AS prior_valence, round(coalesce(a, 0.5),6) AS prior_arousal, v IS NOT NULL AS seen FROM testrows r
 LEFT JOIN (SELECT stimulus_uid, avg(target_valence) v, avg(target_arousal) a FROM fitrows WHERE k%5<>0 GROUP BY 1) USING (stimulus_uid)""")
def _(spark, d):
    a = assigned(spark, d)
    test = a.filter("split = 'test'").selectExpr("*", "0.5D AS fallback_valence", "0.5D AS fallback_arousal")
    out = P.seen_group_prior(a.filter("split = 'train' and k % 5 <> 0"), test, "stimulus_uid")
    return rounded(out.select("trial_uid", "prior_valence", "prior_arousal", "seen"))


@query("participant_offsets", """SELECT trial_uid, round(coalesce(v,0),6) AS offset_m_valence, round(coalesce(a,0),6) AS offset_m_arousal FROM trials t
 LEFT JOIN (SELECT subject_uid, avg(target_valence-0.5) v, avg(target_arousal-0.4) a FROM trials WHERE event_id%20=1 AND user_id%3<>0 GROUP BY 1) USING (subject_uid) WHERE event_id%20<>1""")
def _(spark, d):
    t = V.trials(spark, d).selectExpr("*", "0.5D AS m_valence", "0.4D AS m_arousal")
    out = P.participant_offsets(t.filter("event_id % 20 = 1 and user_id % 3 <> 0"), t.filter("event_id % 20 <> 1"), ["m"])
    return rounded(out.select("trial_uid", "offset_m_valence", "offset_m_arousal"))


view("shrink", """WITH r AS (SELECT subject_uid, unnest(['valence','arousal']) AS target, unnest([target_valence-0.5, target_arousal-0.5]) AS r FROM fitrows),
 g AS (SELECT target, subject_uid, count(*) n, avg(r) m, var_pop(r) v FROM r GROUP BY 1,2)
 SELECT target, sum(n*v)/(sum(n)-count(*)) AS within_variance, greatest(var_samp(m)-sum(n*v)/(sum(n)-count(*))*avg(1/n),0) AS between_variance,
  count(*) AS participants, CAST(sum(n) AS BIGINT) AS trials FROM g GROUP BY 1""")


def _shrinkage(spark, d):
    r = assigned(spark, d).filter("split = 'train'").selectExpr("subject_uid", "target_valence - 0.5 AS residual_valence", "target_arousal - 0.5 AS residual_arousal")
    return P.shrinkage_estimate(r)


@query("shrinkage_estimate", "SELECT target, round(within_variance,8) AS within_variance, round(between_variance,8) AS between_variance, participants, trials FROM shrink")
def _(spark, d):
    return rounded(_shrinkage(spark, d), 8)


@query("shrinkage_weights", """SELECT subject_uid, n, target, round(CASE WHEN n=0 THEN 0 ELSE n*between_variance/(n*between_variance+within_variance) END,6) AS weight
 FROM (SELECT subject_uid, count_if(event_id%30=0) AS n FROM testrows GROUP BY 1) CROSS JOIN shrink""")
def _(spark, d):
    counts = assigned(spark, d).filter("split = 'test'").groupBy("subject_uid").agg(F.expr("count_if(event_id % 30 = 0)").alias("n"))
    return rounded(P.shrinkage_weights(_shrinkage(spark, d), counts))


@query("shrink_predictions", """SELECT trial_uid, round(0.5+k/99.0::DOUBLE*(target_valence-0.5),6) AS prior_personalized_valence,
 round(0.5+0.5::DOUBLE*(target_arousal-0.5),6) AS prior_personalized_arousal FROM trials""")
def _(spark, d):
    t = V.trials(spark, d).selectExpr(
        "trial_uid", "0.5D AS prior_valence", "0.5D AS prior_arousal", "target_valence AS prior_personalized_valence",
        "target_arousal AS prior_personalized_arousal", "k / 99D AS weight_valence", "0.5D AS weight_arousal",
    )
    return rounded(P.shrink_predictions(t).select("trial_uid", "prior_personalized_valence", "prior_personalized_arousal"))


@query("covered_partitions", """WITH f AS (SELECT DISTINCT stimulus_uid FROM assigned WHERE split IN ('train','validation') AND k%5<>0)
 SELECT split, CAST(count(*) AS BIGINT) AS n FROM assigned WHERE split IN ('train','validation') AND k%5<>0 GROUP BY 1
 UNION ALL SELECT 'test', count(*) FROM testrows WHERE stimulus_uid IN (SELECT * FROM f)""")
def _(spark, d):
    a = assigned(spark, d).filter("k % 5 <> 0 or split = 'test'")
    fit, test, _ = P.covered_partitions(a, "stimulus_uid")
    return fit.unionByName(test).groupBy("split").agg(F.count(F.lit(1)).alias("n"))


@query("seen_fraction", """SELECT round(avg((stimulus_uid IN (SELECT stimulus_uid FROM assigned WHERE split IN ('train','validation') AND k%5<>0))::INT),6) AS seen_fraction FROM testrows""")
def _(spark, d):
    return rounded(P.covered_partitions(assigned(spark, d).filter("k % 5 <> 0 or split = 'test'"), "stimulus_uid")[2])


@query("aggregate_stimuli", """SELECT stimulus_uid, arg_min(context, trial_uid) AS context, round(avg(target_valence),6) AS target_valence,
 round(avg(target_arousal),6) AS target_arousal, count(*) AS trials FROM fitrows GROUP BY 1""")
def _(spark, d):
    return rounded(P.aggregate_stimuli(assigned(spark, d).filter("split = 'train'"), first=["context"]))


view("poptargets", """
WITH f AS (SELECT * FROM assigned WHERE split IN ('train','validation')), g AS (SELECT avg(target_valence) gv, avg(target_arousal) ga FROM f),
s AS (SELECT stimulus_uid, count(*) n, sum(target_valence) sv, sum(target_arousal) sa FROM f GROUP BY 1)
SELECT a.trial_uid, a.subject_uid, a.stimulus_uid, a.split, a.target_valence, a.target_arousal, a.value, a.event_id,
 CASE WHEN split IN ('train','validation') THEN CASE WHEN n>1 THEN (sv-target_valence)/(n-1) ELSE gv END ELSE coalesce(sv/n, gv) END AS prior_valence,
 CASE WHEN split IN ('train','validation') THEN CASE WHEN n>1 THEN (sa-target_arousal)/(n-1) ELSE ga END ELSE coalesce(sa/n, ga) END AS prior_arousal
FROM assigned a LEFT JOIN s USING (stimulus_uid) CROSS JOIN g""")


view("assigned_root", "SELECT * REPLACE (sqrt(target_valence) AS target_valence, sqrt(target_arousal) AS target_arousal) FROM assigned")
view("poptargets_root", VIEWS["poptargets"].replace("assigned", "assigned_root"))


@query("population_targets", """SELECT trial_uid, split, round(prior_valence,6) AS prior_valence, round(prior_arousal,6) AS prior_arousal,
 CASE WHEN split<>'test' THEN round(target_valence-prior_valence,6) END AS residual_valence FROM poptargets_root""")
def _(spark, d):
    t = rooted(V.trials(spark, d))
    out = P.population_targets(t, S.group_holdout(t, "subject_uid", validate=False))
    return rounded(out.select("trial_uid", "split", "prior_valence", "prior_arousal", "residual_valence"))


@query("prediction_table", """
WITH t AS (SELECT *, CASE WHEN split='test' AND event_id%10=0 THEN 'calibration' ELSE split END AS role FROM poptargets),
o AS (SELECT subject_uid, avg(target_valence-prior_valence) ov, avg(target_valence-prior_valence-value/5000) oc FROM t WHERE role='calibration' GROUP BY 1)
SELECT trial_uid, round(prior_valence,6) AS prior_valence, round(prior_valence+coalesce(ov,0),6) AS prior_personalized_valence,
 round(prior_valence+value/5000,6) AS combined_population_valence, round(prior_valence+value/5000+coalesce(oc,0),6) AS combined_personalized_valence
FROM t LEFT JOIN o USING (subject_uid) WHERE role='test'""")
def _(spark, d):
    t = V.trials(spark, d)
    a = S.group_holdout(t, "subject_uid", validate=False).join(t.select("trial_uid", "event_id"), "trial_uid").selectExpr(
        "trial_uid", "if(split = 'test' and event_id % 10 = 0, 'calibration', split) AS split"
    )
    external = t.selectExpr("trial_uid", "value / 5000 AS residual_prediction_valence", "value / 5000 AS residual_prediction_arousal")
    out = P.prediction_table(P.population_targets(t, a), external)
    return rounded(out.select("trial_uid", *[f"{p}_valence" for p in ("prior", "prior_personalized", "combined_population", "combined_personalized")]))


@query("candidate_predictions", """SELECT trial_uid, unnest(['a','b']) AS candidate, round(prior_valence+unnest([value/5000, value/2500]),6) AS prediction_valence FROM poptargets WHERE split='test'""")
def _(spark, d):
    t = V.trials(spark, d)
    pri = P.population_targets(t, S.group_holdout(t, "subject_uid", validate=False)).filter("split = 'test'")
    make = lambda k: pri.selectExpr("trial_uid", f"value / {k}D AS residual_prediction_valence", f"value / {k}D AS residual_prediction_arousal")
    out = P.candidate_predictions({"a": make(5000), "b": make(2500)}, pri, validate=False)
    return rounded(out.select("trial_uid", "candidate", "prediction_valence"))


# ---- metrics -------------------------------------------------------------------------------

view("scored", """SELECT trial_uid, subject_uid, stimulus_uid, context, p.predictor, p.target, p.y, p.yhat FROM (
 SELECT *, unnest([{'predictor':'prior','target':'valence','y':target_valence,'yhat':prior_valence},{'predictor':'prior','target':'arousal','y':target_arousal,'yhat':prior_arousal},
  {'predictor':'shifted','target':'valence','y':target_valence,'yhat':prior_valence+value/5000},{'predictor':'shifted','target':'arousal','y':target_arousal,'yhat':prior_arousal+value/5000}]) AS p
 FROM poptargets JOIN (SELECT trial_uid, context FROM trials) USING (trial_uid) WHERE split='test')""")
CCC = "2*covar_pop(y,yhat)/nullif(var_pop(y)+var_pop(yhat)+(avg(y)-avg(yhat))*(avg(y)-avg(yhat)),0)"


def scored(spark, d):
    a = assigned(spark, d)
    fit = a.filter("split in ('train', 'validation')")
    p = P.group_mean_prior(fit, a.filter("split = 'test'"), "stimulus_uid")
    p = p.selectExpr("*", "prior_valence + value / 5000 AS shifted_valence", "prior_arousal + value / 5000 AS shifted_arousal")
    return M.long_predictions(p, ["prior", "shifted"], keep=["trial_uid", "subject_uid", "stimulus_uid", "context"])


@query("ccc", f"SELECT predictor, target, round({CCC},6) AS ccc, count(*) AS n FROM scored GROUP BY 1,2")
def _(spark, d):
    return rounded(M.ccc(scored(spark, d), ["predictor", "target"]))


view("regmetrics", f"""WITH p AS (SELECT predictor, target, {CCC} AS ccc, avg(abs(yhat-y)) AS mae, sqrt(avg((yhat-y)*(yhat-y))) AS rmse FROM scored GROUP BY 1,2)
SELECT * FROM p UNION ALL SELECT predictor, 'macro', avg(ccc), avg(mae), avg(rmse) FROM p GROUP BY 1""")


@query("regression_metrics", "SELECT predictor, target, round(ccc,6) AS ccc, round(mae,6) AS mae, round(rmse,6) AS rmse FROM regmetrics")
def _(spark, d):
    return rounded(M.regression_metrics(scored(spark, d), ["predictor"]))


@query("metrics_by_context", f"""WITH p AS (SELECT predictor, target, CASE WHEN GROUPING(context)=1 THEN 'all' ELSE context END AS ctx, {CCC} AS ccc, avg(abs(yhat-y)) AS mae, sqrt(avg((yhat-y)*(yhat-y))) AS rmse, count(*) AS n
 FROM scored GROUP BY GROUPING SETS ((predictor,target,context),(predictor,target)) HAVING GROUPING(context)=1 OR count(*)>=2)
SELECT predictor, ctx AS context, target, round(ccc,6) AS ccc, round(mae,6) AS mae, round(rmse,6) AS rmse, n FROM p
UNION ALL SELECT predictor, ctx, 'macro', round(avg(ccc),6), round(avg(mae),6), round(avg(rmse),6), max(n) FROM p GROUP BY 1,2""")
def _(spark, d):
    return rounded(M.metrics_by_context(scored(spark, d), ["predictor"]))


@query("multi_view_metrics", f"""WITH p AS (SELECT v, target, {CCC.replace('yhat', '(yhat*v)')} AS ccc, avg(abs(yhat*v-y)) AS mae, sqrt(avg((yhat*v-y)*(yhat*v-y))) AS rmse
 FROM scored CROSS JOIN (SELECT unnest([0.5,0.75,1.0])::DOUBLE AS v) WHERE predictor='prior' GROUP BY 1,2)
SELECT v AS view, 'macro' AS target, round(avg(ccc),6) AS ccc, round(avg(mae),6) AS mae, round(avg(rmse),6) AS rmse FROM p GROUP BY 1""")
def _(spark, d):
    s = scored(spark, d).filter("predictor = 'prior'").selectExpr("target", "y", "yhat", "explode(array(0.5D, 0.75D, 1.0D)) AS view")
    return rounded(M.regression_metrics(s.withColumn("yhat", F.expr("yhat * view")), ["view"]).filter("target = 'macro'"))


@query("weighted_scores", """WITH s AS (SELECT *, (trial_uid[-1:])::INT % 4 AS w FROM scored),
m AS (SELECT predictor, target, sum(w)::DOUBLE n, sum(w*y)/sum(w) my, sum(w*yhat)/sum(w) mx, sum(w*y*y)/sum(w) yy, sum(w*yhat*yhat)/sum(w) xx, sum(w*y*yhat)/sum(w) xy, sum(w*abs(yhat-y))/sum(w) mae FROM s GROUP BY 1,2)
SELECT predictor, round(avg(2*(xy-mx*my)/(greatest(xx-mx*mx,0)+greatest(yy-my*my,0)+(mx-my)*(mx-my))),6) AS macro_ccc, round(avg(mae),6) AS macro_mae FROM m GROUP BY 1""")
def _(spark, d):
    s = scored(spark, d).withColumn("w", F.expr("cast(right(trial_uid, 1) as int) % 4"))
    return rounded(M.weighted_scores(s, ["predictor"], "w"))


@query("classification_metrics", """
WITH c AS (SELECT label, vec_id%10 AS p, count(*) AS c FROM embeddings GROUP BY 1,2),
l AS (SELECT l, sum(t) t, sum(p) p, sum(h) h FROM (SELECT label AS l, c AS t, 0 AS p, CASE WHEN label=p THEN c ELSE 0 END AS h FROM c UNION ALL SELECT p, 0, c, 0 FROM c) GROUP BY 1),
a AS (SELECT sum(h)/sum(t) AS acc, avg(CASE WHEN t>0 THEN h/t END) AS bal, avg(2*h/(t+p)) AS f1, sum(t*p)/(sum(t)::DOUBLE*sum(t)) AS e FROM l)
SELECT round(acc,6) AS accuracy, round(bal,6) AS balanced_accuracy, round(f1,6) AS macro_f1, round((acc-e)/(1-e),6) AS kappa FROM a""")
def _(spark, d):
    e = V.table(spark, d, "embeddings").selectExpr("cast(label as bigint) AS label", "vec_id % 10 AS prediction")
    return rounded(M.classification_metrics(e))


@query("eta_squared", """WITH x AS (SELECT label, generate_subscripts(embedding,1) AS pos, unnest(embedding)::DOUBLE AS x FROM embeddings),
c AS (SELECT label, pos, count(*) n, sum(x) s, sum(x*x) q FROM x GROUP BY 1,2), p AS (SELECT pos, sum(s*s/n)-sum(s)*sum(s)/sum(n) AS b, sum(q)-sum(s)*sum(s)/sum(n) AS t FROM c GROUP BY 1)
SELECT round(sum(b)/sum(t),6) AS eta_squared FROM p""")
def _(spark, d):
    e = V.table(spark, d, "embeddings").selectExpr("label", "cast(embedding as array<double>) AS features")
    return rounded(M.eta_squared(e, "label"))


view("consensus", """SELECT trial_uid, stimulus_uid, y, CASE WHEN y IS NULL THEN 0 ELSE count(y) OVER w END AS rating_count,
 CASE WHEN y IS NOT NULL AND count(y) OVER w>1 THEN (sum(y) OVER w-y)/(count(y) OVER w-1) END AS prediction
 FROM (SELECT *, CASE WHEN label_available THEN target_valence END AS y FROM trials) WINDOW w AS (PARTITION BY stimulus_uid)""")


def _consensus(spark, d):
    return V.trials(spark, d).selectExpr("trial_uid", "stimulus_uid", "if(label_available, target_valence, null) AS rating")


@query("loo_consensus", "SELECT trial_uid, stimulus_uid, round(y,6) AS y, rating_count, round(prediction,6) AS prediction FROM consensus")
def _(spark, d):
    return rounded(M.loo_consensus(_consensus(spark, d), "rating"))


@query("consensus_summary", f"""SELECT count(*) AS supported_rating_count, count(DISTINCT stimulus_uid) AS supported_stimulus_count,
 round({CCC},6) AS ccc, round(avg(abs(yhat-y)),6) AS mae FROM (SELECT *, prediction AS yhat FROM consensus WHERE prediction IS NOT NULL)""")
def _(spark, d):
    return rounded(M.consensus_summary(_consensus(spark, d), "rating"))


# two-factor least squares in SQL: subject effects eliminated, one stimulus as the origin, the rest solved by elimination
view("rating_cells", """SELECT subject_uid AS u, stimulus_uid AS k, count(*)::DOUBLE AS n, sum(target_arousal)-count(*)*(SELECT avg(target_arousal) FROM trials) AS s,
 sum(pow(target_arousal-(SELECT avg(target_arousal) FROM trials),2)) AS q FROM trials GROUP BY 1, 2""")
view("rating_effects", """
WITH RECURSIVE su AS MATERIALIZED (SELECT u, sum(n) AS n, sum(s) AS s FROM rating_cells GROUP BY 1),
i AS MATERIALIZED (SELECT k, row_number() OVER (ORDER BY k)-1 AS i FROM (SELECT DISTINCT k FROM rating_cells)),
c AS MATERIALIZED (SELECT rating_cells.*, i FROM rating_cells JOIN i USING (k)),
pairs AS (SELECT a.i, b.i AS j, sum(a.n*b.n/su.n) AS v FROM c a JOIN c b USING (u) JOIN su USING (u) GROUP BY 1, 2),
d AS (SELECT c.i, sum(c.n) AS n, sum(c.s-c.n*su.s/su.n) AS r FROM c JOIN su USING (u) GROUP BY 1),
rows AS (SELECT x.i, list((CASE WHEN x.i=y.i THEN d.n ELSE 0 END)-coalesce(p.v,0) ORDER BY y.i) AS row, any_value(d.r) AS r
  FROM i x JOIN i y ON x.i>0 AND y.i>0 JOIN d ON d.i=x.i LEFT JOIN pairs p ON p.i=x.i AND p.j=y.i GROUP BY x.i),
gj AS (SELECT 0 AS step, list(list_append(row, r) ORDER BY i) AS m FROM rows UNION ALL
 SELECT step+1, list_transform(m, lambda r, i: CASE WHEN i=step+1 THEN list_transform(r, lambda v: v/r[step+1]) ELSE list_transform(r, lambda v, j: v-r[step+1]*m[step+1][j]/m[step+1][step+1]) END) FROM gj WHERE step<len(m)),
b AS (SELECT generate_subscripts(m,1) AS i, unnest(list_transform(m, lambda r: r[-1])) AS b FROM gj WHERE step=len(m) UNION ALL SELECT 0, 0)
SELECT k, b FROM b JOIN i USING (i)""")


@query("additive_r2", """
WITH g AS (SELECT sum(n) AS n, sum(q) AS t FROM rating_cells), f AS (SELECT sum(s*s/n) AS v FROM (SELECT sum(n) n, sum(s) s FROM rating_cells GROUP BY u)), h AS (SELECT sum(s*s/n) AS v FROM (SELECT sum(n) n, sum(s) s FROM rating_cells GROUP BY k)),
a AS (SELECT u, sum(s-n*b)/sum(n) AS a FROM rating_cells JOIN rating_effects USING (k) GROUP BY 1),
e AS (SELECT sum(q-2*(a+b)*s+n*(a+b)*(a+b)) AS v FROM rating_cells JOIN rating_effects USING (k) JOIN a USING (u))
SELECT g.n::BIGINT AS observation_count, round(t/(g.n-1),6) AS target_sample_variance, round(f.v/t,6) AS first_only, round(h.v/t,6) AS second_only, round(1-e.v/t,6) AS both,
 round(1-e.v/t-f.v/t,6) AS second_given_first, round(1-e.v/t-h.v/t,6) AS first_given_second FROM g, f, h, e""")
def _(spark, d):
    return rounded(M.additive_r2(V.trials(spark, d), "target_arousal"))


@query("trial_mae_delta", """SELECT trial_uid, round((abs(prior_valence+value/5000-target_valence)+abs(prior_arousal+value/5000-target_arousal))/2
 -(abs(prior_valence-target_valence)+abs(prior_arousal-target_arousal))/2,6) AS mae_delta FROM poptargets WHERE split='test'""")
def _(spark, d):
    a = assigned(spark, d)
    p = P.group_mean_prior(a.filter("split in ('train', 'validation')"), a.filter("split = 'test'"), "stimulus_uid")
    p = p.selectExpr("*", "prior_valence + value / 5000 AS shifted_valence", "prior_arousal + value / 5000 AS shifted_arousal")
    return rounded(M.trial_mae_delta(p, "shifted", "prior").select("trial_uid", "mae_delta"))


def _seed_rows(spark, d):
    return V.trials(spark, d).groupBy("context", F.expr("user_id % 5 AS seed")).agg(F.avg("target_valence").alias("v"), F.avg("target_arousal").alias("w"))


view("seedrows", "SELECT context, user_id%5 AS seed, avg(target_valence) AS v, avg(target_arousal) AS w FROM trials GROUP BY 1,2")


@query("seed_summary", "SELECT context, round(avg(v),6) AS mean, round(coalesce(stddev_samp(v),0),6) AS sample_sd, count(*) AS seed_count FROM seedrows GROUP BY 1")
def _(spark, d):
    return rounded(M.seed_summary(_seed_rows(spark, d), ["context"], "v"))


@query("paired_seed_summary", "SELECT context, round(avg(v-w),6) AS mean, round(coalesce(stddev_samp(v-w),0),6) AS sample_sd, count(*) AS seed_count FROM seedrows GROUP BY 1")
def _(spark, d):
    s = _seed_rows(spark, d)
    return rounded(M.paired_seed_summary(s.selectExpr("context", "seed", "v AS x"), s.selectExpr("context", "seed", "w AS x"), ["context"], "x"))


@query("component_spread", "SELECT context, round(stddev_pop(target_valence),6) AS target_valence_sd, round(stddev_pop(target_arousal),6) AS target_arousal_sd FROM trials GROUP BY 1")
def _(spark, d):
    return rounded(M.component_spread(V.trials(spark, d), ["target_valence", "target_arousal"], ["context"]))


@query("probe_summary", """WITH p AS (SELECT context, dataset_id, user_id%5 AS seed, avg(target_valence) AS b, avg(target_arousal) AS p FROM trials_multi GROUP BY ALL)
SELECT context AS representation, 'subject' AS probe, dataset_id, count(DISTINCT seed) AS seed_count, round(avg(b),6) AS balanced_accuracy_mean, round(stddev_samp(b),6) AS balanced_accuracy_sample_sd,
 round(avg(p),6) AS permuted_balanced_accuracy_mean, round(avg(b-p),6) AS identity_lift_mean, 0.1::DOUBLE AS chance_accuracy FROM p GROUP BY 1,3""")
def _(spark, d):
    p = V.trials_multi(spark, d).groupBy(F.col("context").alias("representation"), "dataset_id", F.expr("user_id % 5 AS seed")).agg(
        F.avg("target_valence").alias("balanced_accuracy"), F.avg("target_arousal").alias("permuted_balanced_accuracy")
    ).selectExpr("*", "'subject' AS probe", "0.1D AS chance_accuracy")
    return rounded(M.probe_summary(p))


@query("missingness_profile", """
WITH t AS (SELECT *, NOT (user_id%10=0 OR (user_id%10<5 AND event_id%3=0)) AS av FROM trials_multi), s AS (SELECT dataset_id, subject_uid, avg((NOT av)::INT) f FROM t GROUP BY 1,2)
SELECT dataset_id, count(*) AS eligible_trial_count, count_if(av) AS feature_available_count, count_if(NOT av) AS missing_count, round(avg((NOT av)::INT),6) AS missing_fraction,
 round((avg(target_valence) FILTER (NOT av)-avg(target_valence) FILTER (av))/sqrt((var_samp(target_valence) FILTER (NOT av)+var_samp(target_valence) FILTER (av))/2),6) AS target_valence_smd,
 any_value(am) AS subjects_all_missing, any_value(nm) AS subjects_no_missing
FROM t JOIN (SELECT dataset_id, count_if(f=1) am, count_if(f=0) nm FROM s GROUP BY 1) USING (dataset_id) GROUP BY 1""")
def _(spark, d):
    t = V.trials_multi(spark, d).selectExpr("*", "not (user_id % 10 = 0 or (user_id % 10 < 5 and event_id % 3 = 0)) AS available")
    return rounded(M.missingness_profile(t, ["target_valence"]))


@query("protocol_means", """SELECT context AS protocol, 'm'||user_id%3 AS model, round(avg(target_valence),6) AS mean_trial_accuracy, round(avg(target_arousal),6) AS trial_macro_f1,
 count(*) AS result_rows, count(DISTINCT subject_uid) AS participant_count, count(DISTINCT k%5) AS seed_count FROM trials GROUP BY 1,2""")
def _(spark, d):
    t = V.trials(spark, d).selectExpr("context AS protocol", "concat('m', user_id % 3) AS model", "target_valence AS accuracy", "target_arousal AS macro_f1", "subject_uid AS held_out_subject", "k % 5 AS seed")
    grid = t.select("protocol").distinct().crossJoin(t.select("model").distinct())
    return rounded(M.protocol_means(t, grid))
