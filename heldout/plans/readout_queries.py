"""Readout, probe, projection and semantic queries (checked against NumPy in the tests)."""

from __future__ import annotations

from pyspark.sql import functions as F

from heldout.functions.materialize import materialize
from heldout.operators import decomposition as D
from heldout.operators import exposure as X
from heldout.operators import gram as G
from heldout.operators import priors as P
from heldout.operators import probes as B
from heldout.operators import readout as R
from heldout.operators import semantics as S
from heldout.operators import splits as SP
from heldout.plans.exposure_queries import DOSES
from heldout.plans.prior_queries import rounded
from heldout.plans.registry import query, view
from heldout.sources import views as V

ALPHAS = R.ALPHAS


def labelled(spark, d, group="subject_uid"):
    """Trials with their split and features under one group holdout."""
    t = V.trials(spark, d)
    a = SP.group_holdout(t, group, validate=False)
    return t.join(a.select("trial_uid", "split"), "trial_uid").join(V.features(spark, d), "trial_uid")


def labelled_keys(spark, d, group="subject_uid"):
    """Trials with their split, label and the key of their vector, and the vectors, as in ``labelled``; no vector is copied to its trials."""
    t = V.trials(spark, d)
    e = V.table(spark, d, "embeddings").selectExpr("vec_id AS key", "cast(embedding as array<double>) AS features", "label")
    keys = t.select("trial_uid", "event_id").crossJoin(e.agg(F.count(F.lit(1)).alias("n"))).selectExpr("trial_uid", "event_id % n AS key").join(e.select("key", "label"), "key")
    split = SP.group_holdout(t, group, validate=False).select("trial_uid", "split")
    return split.join(keys, "trial_uid"), e.select("key", "features")


@query("standardize", """
WITH x AS (SELECT generate_subscripts(embedding,1)-1 AS pos, unnest(embedding)::DOUBLE AS x FROM features)
SELECT CAST(pos AS INT) AS pos, round(avg(x),6) AS mean, round(stddev_pop(x),6) AS scale FROM x GROUP BY 1""")
def _(spark, d):
    rows = V.features(spark, d).selectExpr("'all' AS one", "features", "array(0D) AS y")
    m = G.moments(rows, "one", "y")["all"]
    data = [(i, float(a), float(b)) for i, (a, b) in enumerate(zip(m.mean + m.shift, m.scale))]
    return rounded(spark.createDataFrame(data, "pos int, mean double, scale double"))


# Ridge in SQL: rows with one feature vector meet as counts and sums, the normal equations stand as rows of one list,
# and a recursive Gauss-Jordan elimination solves them for every penalty.
view("fit_vectors", """SELECT split, vec_id, count(*) AS c, sum(target_valence) AS sv, sum(target_arousal) AS sa
FROM (SELECT *, event_id % (SELECT count(*) FROM embeddings) AS vec_id FROM assigned) GROUP BY 1, 2""")
view("vector_parts", "SELECT vec_id, generate_subscripts(embedding,1) AS p, unnest(embedding)::DOUBLE AS x FROM embeddings")
view("fit_scales", """SELECT p, sum(c*x)/sum(c) AS m, CASE WHEN sqrt(greatest(sum(c*x*x)/sum(c)-pow(sum(c*x)/sum(c),2),0))>=1e-12 THEN sqrt(sum(c*x*x)/sum(c)-pow(sum(c*x)/sum(c),2)) ELSE 1 END AS s
FROM fit_vectors JOIN vector_parts USING (vec_id) WHERE split='train' GROUP BY 1""")
view("fit_standard", "SELECT vec_id, p, (x-m)/s AS z FROM vector_parts JOIN fit_scales USING (p)")
view("fit_equations", """
WITH g AS (SELECT a.p AS i, b.p AS j, sum(c*a.z*b.z) AS v FROM fit_vectors JOIN fit_standard a USING (vec_id) JOIN fit_standard b USING (vec_id) WHERE split='train' GROUP BY 1, 2),
y AS (SELECT p AS i, sum(z*sv) AS v, sum(z*sa) AS a FROM fit_vectors JOIN fit_standard USING (vec_id) WHERE split='train' GROUP BY 1)
SELECT i, list(g.v ORDER BY j) AS row, any_value(y.v) AS yv, any_value(y.a) AS ya FROM g JOIN y USING (i) GROUP BY 1""")
view("ridge_solved", """
WITH RECURSIVE start AS (SELECT alpha, list(list_concat(list_transform(row, lambda v, j: CASE WHEN j=i THEN v+alpha ELSE v END), [yv, ya]) ORDER BY i) AS m
  FROM fit_equations CROSS JOIN (SELECT unnest([0.01,0.1,1.0,10.0,100.0,1000.0]) AS alpha) GROUP BY alpha),
gj AS (SELECT alpha, 0 AS k, m FROM start UNION ALL
 SELECT alpha, k+1, list_transform(m, lambda r, i: CASE WHEN i=k+1 THEN list_transform(r, lambda v: v/r[k+1]) ELSE list_transform(r, lambda v, j: v-r[k+1]*m[k+1][j]/m[k+1][k+1]) END) FROM gj WHERE k<len(m))
SELECT alpha, generate_subscripts(m,1) AS p, unnest(list_transform(m, lambda r: r[-2])) AS wv, unnest(list_transform(m, lambda r: r[-1])) AS wa FROM gj WHERE k=len(m)""")
view("ridge_by_vector", """
WITH mean AS (SELECT sum(sv)/sum(c) AS mv, sum(sa)/sum(c) AS ma FROM fit_vectors WHERE split='train')
SELECT alpha, vec_id, mv+sum(z*wv) AS pv, ma+sum(z*wa) AS pa FROM fit_standard JOIN ridge_solved USING (p) CROSS JOIN mean GROUP BY alpha, vec_id, mv, ma""")


@query("ridge_predict", """SELECT trial_uid, round(pv,6) AS valence, round(pa,6) AS arousal FROM (SELECT *, event_id % (SELECT count(*) FROM embeddings) AS vec_id FROM assigned WHERE split='test')
JOIN ridge_by_vector USING (vec_id) WHERE alpha=10""")
def _(spark, d):
    rows = materialize(labelled(spark, d).selectExpr("trial_uid", "split", "features", "array(target_valence, target_arousal) AS y", "'all' AS one"))
    m = G.moments(rows.filter("split = 'train'"), "one", "y")["all"]
    return rounded(G.append_predictions(rows.filter("split = 'test'").drop("y"), {"all": G.ridge(m, 10.0)}, "one").selectExpr(
        "trial_uid", "prediction[0] AS valence", "prediction[1] AS arousal"))


@query("ridge_coefficients", "SELECT alpha::DOUBLE AS alpha, CAST(p-1 AS INT) AS pos, round(wv,6) AS valence, round(wa,6) AS arousal FROM ridge_solved")
def _(spark, d):
    """Standardised coefficients at every penalty."""
    rows = labelled(spark, d).filter("split = 'train'").selectExpr("features", "array(target_valence, target_arousal) AS y", "'all' AS one")
    m = G.moments(rows, "one", "y")["all"]
    out = [(a, i, float(v), float(w)) for a in R.ALPHAS for i, (v, w) in enumerate(G.ridge(m, a)[0] * m.scale[:, None])]
    return rounded(spark.createDataFrame(out, "alpha double, pos int, valence double, arousal double"))


@query("select_alpha", """
WITH e AS (SELECT alpha, avg((abs(pv-target_valence)+abs(pa-target_arousal))/2) AS e FROM (SELECT *, event_id % (SELECT count(*) FROM embeddings) AS vec_id FROM assigned WHERE split='validation')
  JOIN ridge_by_vector USING (vec_id) GROUP BY 1)
SELECT 'all' AS one, alpha::DOUBLE AS alpha, round(e,6) AS validation_mae, alpha=(SELECT arg_min(alpha, struct_pack(a := e, b := alpha)) FROM e) AS selected FROM e""")
def _(spark, d):
    rows = labelled(spark, d).withColumn("one", F.lit("all"))
    return rounded(R.tuned_ridge(rows, key="one", alphas=R.ALPHAS)[1])


def _evaluated(spark, d, doses=DOSES):
    t = V.trials(spark, d)
    strict = SP.double_holdout(t, validate=False)
    return R.evaluate_cells(t, strict, V.features(spark, d), p_doses=doses, s_doses=doses, validate=False)


@query("evaluate_cells")
def _(spark, d):
    return rounded(R.increments(R.cell_metrics(materialize(_evaluated(spark, d)[0]))))


@query("cell_predictions")
def _(spark, d):
    return rounded(_evaluated(spark, d)[0])


view("cell_fit", "SELECT participant_dose AS p, stimulus_dose AS s, t.* FROM cell_rows JOIN trials t USING (trial_uid) WHERE split IN ('train','validation')")


@query("cell_priors", """
WITH m AS (SELECT p, s, stimulus_uid, avg(target_valence) v, avg(target_arousal) a FROM cell_fit GROUP BY ALL), g AS (SELECT p, s, avg(target_valence) gv, avg(target_arousal) ga FROM cell_fit GROUP BY ALL),
r AS (SELECT c.participant_dose AS p, c.stimulus_dose AS s, c.split, t.trial_uid, t.subject_uid, t.target_valence, t.target_arousal, coalesce(v,gv) AS pv, coalesce(a,ga) AS pa
  FROM cell_rows c JOIN trials t USING (trial_uid) JOIN g ON g.p=c.participant_dose AND g.s=c.stimulus_dose LEFT JOIN m ON m.p=c.participant_dose AND m.s=c.stimulus_dose AND m.stimulus_uid=t.stimulus_uid WHERE c.split IN ('test','calibration')),
o AS (SELECT p, s, subject_uid, avg(target_valence-pv) ov, avg(target_arousal-pa) oa FROM r WHERE split='calibration' GROUP BY ALL)
SELECT r.p AS participant_dose, r.s AS stimulus_dose, trial_uid, round(pv,6) AS prior_valence, round(pa,6) AS prior_arousal, round(pv+coalesce(ov,0),6) AS prior_personalized_valence, round(pa+coalesce(oa,0),6) AS prior_personalized_arousal
FROM r LEFT JOIN o ON o.p=r.p AND o.s=r.s AND o.subject_uid=r.subject_uid WHERE r.split='test'""")
def _(spark, d):
    out = _evaluated(spark, d)[0]
    return rounded(out.select("participant_dose", "stimulus_dose", "trial_uid", *[f"{p}_{n}" for p in ("prior", "prior_personalized") for n in ("valence", "arousal")]))


@query("condition_models")
def _(spark, d):
    return rounded(R.condition_models(labelled(spark, d), group="context", alphas=ALPHAS)[0])


@query("seed_regression")
def _(spark, d):
    t = V.trials(spark, d)
    a = SP.group_holdout(t, "subject_uid", seeds=(11, 12), validate=False)
    rows = t.join(a, "trial_uid").join(V.features(spark, d), "trial_uid").withColumn("seed", F.col("seed").cast("string"))
    return rounded(R.seed_regression(rows, alphas=ALPHAS)[0])


@query("ridge_probe")
def _(spark, d):
    return rounded(B.ridge_probe(labelled(spark, d), "label"))


@query("tuned_probe")
def _(spark, d):
    rows, vectors = labelled_keys(spark, d)
    return rounded(B.tuned_probe(rows, "label", alphas=ALPHAS, vectors=vectors))


def _nearest(spark, d):
    rows, vectors = labelled_keys(spark, d)
    rows = materialize(rows)
    return B.nearest_centroid_probe(rows.filter("split = 'train'"), rows.filter("split = 'test'"), "label", vectors=vectors)


@query("nearest_centroid_probe")
def _(spark, d):
    return rounded(_nearest(spark, d))


@query("nearest_centroid_accuracy", """
WITH e AS MATERIALIZED (SELECT vec_id, label, generate_subscripts(embedding,1) AS p, unnest(embedding)::DOUBLE AS x FROM embeddings),
a AS MATERIALIZED (SELECT split, vec_id, count(*) AS c FROM (SELECT split, event_id % (SELECT count(*) FROM embeddings) AS vec_id FROM assigned WHERE split<>'validation') GROUP BY 1,2),
st AS MATERIALIZED (SELECT p, sum(c*x)/sum(c) AS m, sqrt(sum(c*x*x)/sum(c)-pow(sum(c*x)/sum(c),2)) AS s FROM a JOIN e USING (vec_id) WHERE split='train' GROUP BY 1),
ce AS MATERIALIZED (SELECT label, p, sum(c*(x-m)/s)/sum(c) AS z FROM a JOIN e USING (vec_id) JOIN st USING (p) WHERE split='train' GROUP BY 1,2),
ds AS (SELECT vec_id, c, e.label, ce.label AS guess, avg(pow((x-m)/s-z,2)) AS d FROM a JOIN e USING (vec_id) JOIN st USING (p) JOIN ce USING (p) WHERE split='test' GROUP BY ALL),
g AS (SELECT vec_id, c, label, arg_min(guess, d) AS guess FROM ds GROUP BY ALL),
r AS (SELECT label, sum(CASE WHEN guess=label THEN c ELSE 0 END)/sum(c) AS recall, sum(c) AS n, sum(CASE WHEN guess=label THEN c ELSE 0 END) AS h FROM g GROUP BY 1)
SELECT round(sum(h)/sum(n),6) AS accuracy, round(avg(recall),6) AS balanced_accuracy FROM r""")
def _(spark, d):
    return rounded(_nearest(spark, d).filter("labels = 'observed'").select("accuracy", "balanced_accuracy"))


@query("nearest_centroid_permuted", """
WITH e AS MATERIALIZED (SELECT vec_id, generate_subscripts(embedding,1) AS p, unnest(embedding)::DOUBLE AS x FROM embeddings),
v AS MATERIALIZED (SELECT split, trial_uid, vec_id, embeddings.label FROM (SELECT *, event_id % (SELECT count(*) FROM embeddings) AS vec_id FROM assigned) JOIN embeddings USING (vec_id)),
ra AS (SELECT vec_id, row_number() OVER (ORDER BY sha256('17:permute_rows:'||trial_uid), trial_uid) AS r FROM v WHERE split='train'),
rb AS (SELECT label, row_number() OVER (ORDER BY sha256('17:permute_labels:'||trial_uid), trial_uid) AS r FROM v WHERE split='train'),
a AS MATERIALIZED (SELECT vec_id, label, count(*) AS c FROM ra JOIN rb USING (r) GROUP BY 1, 2),
st AS MATERIALIZED (SELECT p, sum(c*x)/sum(c) AS m, sqrt(sum(c*x*x)/sum(c)-pow(sum(c*x)/sum(c),2)) AS s FROM a JOIN e USING (vec_id) GROUP BY 1),
ce AS MATERIALIZED (SELECT label, p, sum(c*(x-m)/s)/sum(c) AS z FROM a JOIN e USING (vec_id) JOIN st USING (p) GROUP BY 1, 2),
t AS MATERIALIZED (SELECT vec_id, label, count(*) AS c FROM v WHERE split='test' GROUP BY 1, 2),
ds AS (SELECT vec_id, ce.label AS guess, sum(pow((x-m)/s-z,2)) AS d FROM (SELECT DISTINCT vec_id FROM t) JOIN e USING (vec_id) JOIN st USING (p) JOIN ce USING (p) GROUP BY 1, 2),
g AS (SELECT vec_id, arg_min(guess, d) AS guess FROM ds GROUP BY 1),
r AS (SELECT label, sum(c) AS n, sum(CASE WHEN guess=label THEN c ELSE 0 END) AS h FROM t JOIN g USING (vec_id) GROUP BY 1)
SELECT round(sum(h)/sum(n),6) AS accuracy, round(avg(h/n),6) AS balanced_accuracy, (SELECT count(DISTINCT label) FROM a)::INT AS identity_count FROM r""")
def _(spark, d):
    """The permuted-label control."""
    return rounded(_nearest(spark, d).filter("labels = 'permuted'").select("accuracy", "balanced_accuracy", "identity_count"))


def _grams(spark, d):
    rows = materialize(labelled(spark, d).filter("split = 'train'").selectExpr("trial_uid", "stimulus_uid", "features", "'all' AS one", "array(target_valence, target_arousal) AS y"))
    shift = G.feature_shift(rows)
    m = G.moments(rows, "one", "y", shift=shift)
    g = materialize(G.group_sums(rows, "one", "stimulus_uid", "y", shift=shift))
    return rows, m, g, len(shift)


def _linear(spark, model):
    w, b = model
    return rounded(spark.createDataFrame([(i, float(r[0]), float(r[1])) for i, r in enumerate([b, *w])], "position int, valence double, arousal double"))


@query("conditional_nuisance_ridge")
def _(spark, d):
    _, m, g, k = _grams(spark, d)
    return _linear(spark, G.conditional_ridge(m["all"], 10.0, 1.0, G.nuisance_gram(g, m, k, 2)["all"]))


def _projected(spark, d, make):
    rows, m, g, k = _grams(spark, d)
    out = G.project_features(rows.select("trial_uid", "features"), m["all"], make(m["all"], g, m, k))
    # directions have no sign: report the removed and the kept energy of each row
    return rounded(out.selectExpr("trial_uid", "aggregate(features, 0D, (a, v) -> a + v * v) AS kept_energy"), 5)


@query("response_preserving_projector")
def _(spark, d):
    return _projected(spark, d, lambda mm, g, m, k: G.response_preserving_directions(mm, G.centroid_gram(g, m, k, 2)["all"])[:, :4])


@query("group_identity_projector")
def _(spark, d):
    return _projected(spark, d, lambda mm, g, m, k: G.identity_directions(G.centroid_gram(g, m, k, 2)["all"])[:, :4])


@query("subspace_projector")
def _(spark, d):
    return _projected(spark, d, lambda mm, g, m, k: G.pca_directions(mm)[:, :4])


NUISANCE_SQL = """
WITH e AS MATERIALIZED (SELECT vec_id, generate_subscripts(embedding,1) AS p, unnest(embedding)::DOUBLE AS x FROM embeddings),
a AS MATERIALIZED (SELECT trial_uid, stimulus_uid, split, event_id % (SELECT count(*) FROM embeddings) AS vec_id FROM assigned WHERE split<>'validation'),
g AS MATERIALIZED (SELECT stimulus_uid, p, count(*) n, sum(x) s FROM a JOIN e USING (vec_id) WHERE split='train' GROUP BY 1,2)
SELECT a.trial_uid, a.split, round(sum((e.x-0.5::DOUBLE*CASE WHEN a.split='train' THEN (g.s-e.x)/(g.n-1) ELSE g.s/g.n END)*sqrt(e.p::DOUBLE)),5) AS signature
FROM a JOIN e ON a.vec_id=e.vec_id JOIN g ON g.stimulus_uid=a.stimulus_uid AND g.p=e.p GROUP BY 1,2"""


@query("remove_group_nuisance", NUISANCE_SQL)
def _(spark, d):
    rows = materialize(labelled(spark, d).select("trial_uid", "stimulus_uid", "split", "features"))
    test = rows.filter("split = 'test'").withColumn("fallback", F.col("features"))
    a, b = D.remove_group_nuisance(rows.filter("split = 'train'"), test, "stimulus_uid", fallback="fallback", strengths=[0.5])
    both = a.unionByName(b.drop("nuisance_seen"))
    return rounded(both.selectExpr("trial_uid", "split", "aggregate(transform(features, (v, i) -> v * sqrt(cast(i + 1 as double))), 0D, (a, v) -> a + v) AS signature"), 5)


def described(spark, d):
    """Documents as described stimuli, each rated by the trials of its key."""
    docs = V.table(spark, d, "documents").selectExpr("concat('d', doc_id) AS stimulus_uid", "text", "lang", "source", "doc_id", "n_chars")
    split = SP.group_partition(docs, "stimulus_uid", seeds=(3,), validation=0.15, test=0.2).select("stimulus_uid", "split")
    return docs.join(split, "stimulus_uid").selectExpr(
        "concat('t', doc_id) AS trial_uid", "stimulus_uid", "split", "text", "lang", "source", "lang AS context", "concat('u', doc_id % 40) AS subject_uid",
        "least(n_chars, 5000) / 5000D AS target_valence", "(doc_id * 37 % 100) / 100D AS target_arousal", "doc_id",
    )


@query("semantic_vocabulary", r"""
WITH t AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}\p{M}_]{2,}') AS w FROM documents),
x AS (SELECT doc_id, unnest(list_concat(w, CASE WHEN len(w)>1 THEN list_transform(range(1, len(w)), lambda i: w[i]||' '||w[i+1]) ELSE [] END)) AS term FROM t),
c AS (SELECT doc_id, term, count(*) AS tf FROM x GROUP BY 1,2),
v AS (SELECT term, sum(tf) AS total, count(*) AS df FROM c GROUP BY 1 ORDER BY total DESC, term LIMIT 1024)
SELECT term, CAST(row_number() OVER (ORDER BY term)-1 AS INT) AS column, round(ln((1+(SELECT count(DISTINCT doc_id) FROM c))/(1+df))+1,6) AS idf FROM v""")
def _(spark, d):
    docs = V.table(spark, d, "documents").selectExpr("concat('d', doc_id) AS stimulus_uid", "text")
    return rounded(S.vocabulary(docs))


@query("semantic_prior")
def _(spark, d):
    rows = described(spark, d).selectExpr("*", "array(target_valence, target_arousal) AS y")
    out, _, _ = S.semantic_prior(rows, categories=["lang", "source"], alphas=ALPHAS)
    return rounded(out.selectExpr("trial_uid", "prediction[0] AS valence", "prediction[1] AS arousal"))


CATEGORY_PRIOR_SQL = """
WITH t AS MATERIALIZED (SELECT o_orderkey AS k, o_custkey AS g, o_totalprice/100000::DOUBLE AS y1, day(o_orderdate)/31::DOUBLE AS y2,
  CASE WHEN o_orderkey%10<6 THEN 'train' WHEN o_orderkey%10<8 THEN 'validation' ELSE 'test' END AS split FROM orders),
a AS (SELECT unnest([0.01,0.1,1,10,100,1000]::DOUBLE[]) AS alpha),
p AS (SELECT 'train' AS phase, g, y1, y2 FROM t WHERE split='train' UNION ALL SELECT 'both', g, y1, y2 FROM t WHERE split<>'test'),
s AS MATERIALIZED (SELECT phase, g, count(*) AS n, sum(y1) AS s1, sum(y2) AS s2 FROM p GROUP BY 1,2),
f AS (SELECT s.*, alpha, CASE WHEN g IS NULL THEN 1 ELSE alpha/(n+alpha) END AS w FROM s, a),
b AS MATERIALIZED (SELECT phase, alpha, sum(s1*w)/sum(n*w) AS b1, sum(s2*w)/sum(n*w) AS b2 FROM f GROUP BY 1,2),
u AS MATERIALIZED (SELECT phase, alpha, g, (s1-n*b1)/(n+alpha) AS u1, (s2-n*b2)/(n+alpha) AS u2 FROM s JOIN b USING (phase) WHERE g IS NOT NULL),
e AS (SELECT alpha, avg((abs(b1+coalesce(u1,0)-y1)+abs(b2+coalesce(u2,0)-y2))/2) AS mae FROM t JOIN b ON b.phase='train' LEFT JOIN u USING (phase, alpha, g)
  WHERE split='validation' GROUP BY 1),
c AS (SELECT alpha FROM e ORDER BY mae, alpha LIMIT 1)
SELECT 't'||k AS trial_uid, split, round(b1+coalesce(u1,0),6) AS price, round(b2+coalesce(u2,0),6) AS day
FROM t JOIN b ON b.phase=CASE WHEN split='validation' THEN 'train' ELSE 'both' END JOIN c USING (alpha) LEFT JOIN u USING (phase, alpha, g) WHERE split<>'train'"""


@query("category_prior", CATEGORY_PRIOR_SQL)
def _(spark, d):
    """Orders described by their customer alone, of whom there are as many as the table has; the ridge has a closed form."""
    rows = V.table(spark, d, "orders").selectExpr(
        "concat('t', o_orderkey) AS trial_uid", "concat('s', o_orderkey) AS stimulus_uid", "o_custkey AS customer",
        "case when o_orderkey % 10 < 6 then 'train' when o_orderkey % 10 < 8 then 'validation' else 'test' end AS split",
        "array(o_totalprice / 100000D, day(o_orderdate) / 31D) AS y",
    )
    out, tuned, _ = S.semantic_prior(rows, categories=["customer"], text=None, alphas=ALPHAS)
    both = out.selectExpr("*", "'test' AS split").unionByName(tuned.selectExpr("*", "'validation' AS split"))
    return rounded(both.selectExpr("trial_uid", "split", "prediction[0] AS price", "prediction[1] AS day"))


def described_features(spark, d):
    e = V.table(spark, d, "embeddings").selectExpr("vec_id", "cast(embedding as array<double>) AS features")
    n = e.agg(F.count(F.lit(1)).alias("n"))
    return described(spark, d).crossJoin(n).withColumn("vec_id", F.expr("doc_id % n")).join(e, "vec_id").drop("vec_id", "n", "doc_id")


@query("semantic_nuisance")
def _(spark, d):
    out, _, _ = S.semantic_prior(described_features(spark, d).withColumnRenamed("features", "y"), categories=["lang", "source"], alphas=ALPHAS, scale=True)
    return rounded(out.selectExpr("trial_uid", "prediction[0] AS first", "prediction[63] AS last"))


@query("grid_select")
def _(spark, d):
    rows, m, g, k = _grams(spark, d)
    nuisance = G.nuisance_gram(g, m, k, 2)["all"]
    held = labelled(spark, d).filter("split = 'validation'").selectExpr("features", "array(target_valence, target_arousal) AS y", "cast(array() as array<double>) AS none")
    cands = [((p, a), lambda mm, p=p, a=a: G.conditional_ridge(mm, a, p, nuisance)) for p in D.PENALTIES for a in ALPHAS]
    chosen, scores = R.grid_select(held, cands, m["all"], prior="none")
    return rounded(spark.createDataFrame([(float(key[0]), float(key[1]), e, key == chosen) for key, e in scores], "penalty double, alpha double, validation_mae double, selected boolean"))


@query("decomposition_benchmark")
def _(spark, d):
    rows = described_features(spark, d)
    out, _ = D.decomposition_benchmark(rows, categories=["lang", "source"])
    return rounded(D.decomposition_metrics(materialize(out)))


@query("subspace_curve")
def _(spark, d):
    rows = described_features(spark, d).drop("stimulus_uid").withColumn("stimulus_uid", F.expr("concat('k', cast(substring(trial_uid, 2) as bigint) % 100)"))
    return rounded(D.subspace_curve(rows, categories=["lang", "source"]))


@query("audit_bundle")
def _(spark, d):
    """Every section of the end-to-end audit with its row count and the coverage facts."""
    from heldout.operators.bundle import audit_bundle

    tables = audit_bundle(V.trials(spark, d), V.features(spark, d), p_doses=(0, 4), s_doses=(0, 4), seed=11, draws=100, validate=False)
    out = None
    for name, df in tables.items():
        part = df.agg(F.count(F.lit(1)).alias("value")).selectExpr(f"'{name}' AS section", "'rows' AS item", "value")
        out = part if out is None else out.unionByName(part)
    report = tables["coverage_report"]
    return out.unionByName(report.unpivot([], report.columns, "item", "value").selectExpr("'coverage_report' AS section", "item", "value"))
