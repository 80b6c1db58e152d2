import pytest

from heldout.operators import splits as S


def test_lone_source_trial_trains_or_is_an_error(spark):
    rows = [("t0", "u0", "view"), ("t1", "u0", "click"), ("t2", "u1", "view"), ("t3", "u1", "view"), ("t4", "u1", "error")]
    t = spark.createDataFrame([(*r, "f") for r in rows], "trial_uid string, subject_uid string, context string, condition_family string")
    got = {r.trial_uid: r.split for r in S.context_only_transfer(t, source="view", target="click", strict=False).collect()}
    assert sorted([got.pop("t2"), got.pop("t3")]) == ["train", "validation"]
    assert got == {"t0": "train", "t1": "test", "t4": "excluded"}
    with pytest.raises(Exception, match="two source trials"):
        S.context_only_transfer(t, source="view", target="click").collect()
