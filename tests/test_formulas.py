import hashlib

import pytest
from pyspark.sql import functions as F

from heldout.functions.formulas import t_quantile, t_quantile_975
from heldout.functions.hashing import first_per_group, hash_rank, seeded_hash
from heldout.functions.joins import attach_groups, ordered_scan


@pytest.mark.parametrize("df,value", [(1, 12.7062047), (4, 2.7764451), (29, 2.0452296), (200, 1.9718962)])
def test_t_quantile(spark, df, value):
    assert t_quantile(df) == pytest.approx(value, abs=1e-6)
    assert spark.range(1).select(t_quantile_975(F.lit(df).cast("double"))).first()[0] == pytest.approx(value, abs=1e-6)


@pytest.mark.parametrize("partitions", [1, 4, 16])
def test_hash_rank_is_the_sorted_rank(spark, partitions):
    df = spark.range(3000).selectExpr("cast(id as string) AS uid", "if(id % 3 = 0, 'hot', concat('g', id % 50)) AS g").repartition(partitions)
    hashed = df.withColumn("h", seeded_hash(5, "x", F.col("uid")))
    got = {(r.g, r.uid): r.r for r in hash_rank(hashed, hash_column="h", tie="uid", by=["g"], rank="r").collect()}
    groups: dict = {}
    for g, uid in got:
        groups.setdefault(g, []).append(uid)
    for g, uids in groups.items():
        order = sorted(uids, key=lambda u: hashlib.sha256(f"5:x:{u}".encode()).hexdigest())
        assert [got[(g, u)] for u in order] == list(range(1, len(order) + 1))


def test_first_per_group_keeps_whole_result(spark):
    df = spark.range(2000).selectExpr("id", "if(id % 3 = 0, 'hot', concat('g', id % 7)) AS g", "(id * 7919) % 2003 AS v")
    got = {(r.g, r.id): r.rank for r in first_per_group(df, by=["g"], order=["v", "id"], limit=5, spread="id", salts=4).collect()}
    want = {}
    for g in {r.g for r in df.select("g").distinct().collect()}:
        rows = sorted((r.v, r.id) for r in df.filter(F.col("g") == g).collect())[:5]
        want.update({(g, i): k + 1 for k, (_, i) in enumerate(rows)})
    assert got == want


def test_ordered_scan_crosses_chunks(spark):
    rows = [("r", i, i // 3, "m" if i in (1, 10) else None) for i in range(12)]
    df = spark.createDataFrame(rows, "log string, pos int, chunk int, mark string")
    out = ordered_scan(
        df, by=["log"], chunk="chunk", order=["pos"], running={"n": F.lit(1).cast("bigint")},
        previous={"before": F.expr("if(mark is not null, pos, null)")}, following={"after": F.expr("if(mark is not null, pos, null)")}, inclusive=False,
    ).orderBy("pos").collect()
    assert [r.n for r in out] == list(range(1, 13))
    assert [r.before for r in out] == [None, None] + [1] * 9 + [10]
    assert [r.after for r in out] == [1] + [10] * 9 + [None, None]


def test_attach_groups_keeps_every_row_of_a_hot_key(spark):
    facts = spark.range(1000).selectExpr("id", "if(id % 3 = 0, 'hot', concat('g', id)) AS g")
    dim = facts.groupBy("g").count()
    out = attach_groups(facts, dim, ["g"])
    assert out.count() == 1000 and out.filter("g = 'hot' and count = 334").count() == 334
