"""Coverage blocks carry columns along instead of joining them back."""

from heldout.operators import splits as S


def test_kept_columns_equal_a_join(spark):
    t = spark.range(400).selectExpr("concat('t', id) AS trial_uid", "concat('u', id % 23) AS subject_uid", "concat('k', id div 23) AS stimulus_uid", "if(id % 9 = 0, null, id * 0.5D) AS y")
    blocks = S.coverage_blocks(t, folds=5, seed=7)
    want = sorted(map(tuple, blocks.join(t, "trial_uid").select("trial_uid", "fold", "split", "seed", "y", "subject_uid").collect()), key=repr)
    kept = S.coverage_blocks(t, folds=5, seed=7, keep=["y", "subject_uid"])
    assert kept.columns == [*blocks.columns, "y", "subject_uid"]
    assert sorted(map(tuple, kept.collect()), key=repr) == want and len(want) == 2000
