import gzip
import hashlib
import json

import pytest

from heldout.functions.checks import EvaluationError
from heldout.operators import splits as S
from heldout.sources import documents as D
from heldout.sources import trials as T

HEAD = "trial_uid\tdataset_id\tsubject_id\tstimulus_uid\tcontext"


def test_manifests_plain_and_gzipped(spark, tmp_path):
    a, b = tmp_path / "a.tsv", tmp_path / "b.tsv.gz"
    a.write_text(f"{HEAD}\tlabel_available\nt1\td\ts1\tk1\tc\tTrue\nt2\td\ts1\tk2\tc\tno\n")
    with gzip.open(b, "wt") as f:
        f.write(f"{HEAD}\nt3\td\ts2\tk1\tc\n")
    out = {r.trial_uid: (r.subject_uid, r.label_available) for r in T.load_trials(spark, [str(a), str(b)]).collect()}
    assert out == {"t1": ("d:s1", True), "t2": ("d:s1", False), "t3": ("d:s2", True)}
    with pytest.raises(EvaluationError, match="duplicate"):
        T.load_trials(spark, [str(a), str(a)])
    c = tmp_path / "c.tsv"
    c.write_text("trial_uid\tcontext\nx\ty\n")
    with pytest.raises(EvaluationError, match="missing columns"):
        T.load_trials(spark, [str(c)])


def test_features_are_checked(spark, tmp_path):
    good = spark.createDataFrame([("t1", [1.0, 2.0, 3.0, 4.0]), ("t2", [5.0, 6.0, 7.0, 8.0])], "trial_uid string, features array<double>")
    good.write.parquet(str(tmp_path / "good"))
    rows = {r.trial_uid: r.features for r in T.load_features(spark, str(tmp_path / "good"), "global", channels=2, bands=2).collect()}
    assert rows["t1"] == [2.0, 3.0, 1.0, 1.0]
    bad = good.union(spark.createDataFrame([("t3", [1.0, float("nan"), 0.0, 0.0])], good.schema))
    bad.write.parquet(str(tmp_path / "bad"))
    with pytest.raises(EvaluationError, match="invalid feature table"):
        T.load_features(spark, str(tmp_path / "bad"))


def test_ordered_files(spark, tmp_path):
    df = spark.range(50).selectExpr("49 - id AS id", "id * 2 AS v")
    T.write_ordered(df, str(tmp_path / "out"), ["id"], fmt="csv.gz")
    back = T.read_delimited(spark, str(tmp_path / "out"), sep=",")
    assert back.count() == 50
    T.write_ordered(df, str(tmp_path / "pq"), ["id"], partition_by=["v"])
    assert spark.read.parquet(str(tmp_path / "pq")).count() == 50


def test_file_manifest(spark, tmp_path):
    for name, text in (("a.txt", b"one"), ("b.txt", b"two"), ("c.txt", b"three")):
        (tmp_path / name).write_bytes(text)
    files = D.read_files(spark, str(tmp_path))
    sha = lambda x: hashlib.sha256(x).hexdigest()
    manifest = spark.createDataFrame([("a.txt", sha(b"one"), 3), ("b.txt", sha(b"xxx"), 3), ("d.txt", sha(b""), 0)], "path string, sha256 string, bytes bigint")
    got = {r.path: r.status for r in D.verify_file_manifest(manifest, files).collect()}
    assert got == {"a.txt": "ok", "b.txt": "hash_mismatch", "c.txt": "unlisted", "d.txt": "missing"}


def test_json_leaves(spark):
    docs = spark.createDataFrame([("x", '{"b":[1,{"c":2.5}],"a":true,"s":"7","e":{}}'), ("y", "3")], "asset string, json string")
    got = {(r.asset, r.json_path, r.value) for r in D.flatten_json_numeric(docs).collect()}
    assert got == {("x", "$.b[0]", 1.0), ("x", "$.b[1].c", 2.5), ("y", "$", 3.0)}


def test_json_leaves_of_any_depth_in_one_scan(spark, monkeypatch):
    deep = '{"a":[' * 200 + "7, null" + "]}" * 200
    wide = json.dumps({"v": list(range(2500)), "w": {"": -1.5, "é.x": 12345678901234567890}})
    docs = spark.createDataFrame([(1, deep), (2, wide), (3, None), (4, "[]"), (1, "2")], "asset bigint, json string")
    monkeypatch.setattr(D, "LEAVES", 1000)
    leaves = D.flatten_json_numeric(docs)
    assert leaves._jdf.queryExecution().toString().count("ExchangeExec") == 0
    got = sorted(tuple(r) for r in leaves.collect())
    want = [(1, "$" + ".a[0]" * 200, 7.0), (1, "$", 2.0), (2, "$.w.", -1.5), (2, "$.w.é.x", float(12345678901234567890))]
    assert got == sorted(want + [(2, f"$.v[{i}]", float(i)) for i in range(2500)])
    shallow = {tuple(r) for r in D.flatten_json_numeric(docs, depth=2).collect()}
    assert shallow == {(1, "$", 2.0)}
    for bad in ('{"a":1,"a":2}', "{", "NaN", "[1e999]", "1" + "0" * 400):
        with pytest.raises(Exception, match="repeats|malformed|not JSON|beyond"):
            D.flatten_json_numeric(spark.createDataFrame([("x", bad)], "asset string, json string")).collect()


def test_unsupported_alignment_is_an_error(spark):
    f = spark.createDataFrame([("a",), ("b",)], "trial_uid string")
    want = spark.createDataFrame([("a",), ("c",)], "trial_uid string")
    with pytest.raises(EvaluationError, match="misses 1"):
        T.align_feature_support(f, want)


def test_split_guards(spark):
    t = spark.createDataFrame([("t1", "a"), ("t2", "b"), ("t3", "c"), ("t4", None)], "trial_uid string, g string")
    with pytest.raises(EvaluationError, match="blank"):
        S.group_holdout(t, "g")
    with pytest.raises(EvaluationError, match="less than one"):
        S.group_holdout(t.filter("g is not null"), "g", validation=0.5, test=0.5)
    with pytest.raises(Exception, match="three groups"):
        S.group_holdout(t.filter("g in ('a', 'b')"), "g").collect()


@pytest.mark.parametrize("n,want", [(3, (1, 1, 1)), (5, (1, 1, 3)), (10, (2, 1, 7)), (25, (5, 2, 18))])
def test_group_counts(spark, n, want):
    t = spark.range(n).selectExpr("concat('t', id) AS trial_uid", "concat('g', id) AS g")
    got = {r.split: r["count"] for r in S.group_holdout(t, "g").groupBy("split").count().collect()}
    assert (got["test"], got["validation"], got["train"]) == want
