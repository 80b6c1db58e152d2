"""Injected faults must block, missing evidence must stay unverifiable."""

import pytest

from heldout.operators import audits as A

ROWS = [("a", "u1", "k1"), ("b", "u1", "k2"), ("c", "u2", "k1"), ("d", "u3", "k3"), ("e", "u3", "k4"), ("f", "u4", "k3")]


@pytest.fixture(scope="module")
def base(spark):
    trials = spark.createDataFrame(ROWS, "trial_uid string, subject_uid string, stimulus_uid string")
    assignment = spark.createDataFrame([("x", "a", "train"), ("x", "b", "train"), ("x", "c", "validation"), ("x", "d", "test"), ("x", "e", "test")], "run string, trial_uid string, split string")
    lists, executions = A.execution_records(assignment, ["run"])
    return trials, lists.cache(), executions.cache()


def status(base, lists=None, executions=None):
    t, l, e = base
    return A.workflow_audit(t, l if lists is None else lists, e if executions is None else executions).first().status


def test_clean_execution_is_allowed(base):
    assert status(base) == "allow"


@pytest.mark.parametrize("role,uid", [("train", "d"), ("validation", "f"), ("preprocessing_fit", "d"), ("model_selection", "e"), ("eeg_calibration", "a"), ("eeg_population", "d"), ("train", "zz"), ("train", " ")])
def test_leaks_block(spark, base, role, uid):
    extra = spark.createDataFrame([("x", role, uid)], "execution_id string, role string, trial_uid string")
    assert status(base, lists=base[1].unionByName(extra)) == "block"


def test_repeated_uid_blocks(base):
    assert status(base, lists=base[1].unionByName(base[1].filter("role = 'train' and trial_uid = 'a'"))) == "block"


@pytest.mark.parametrize("role,want", [("preprocessing_fit", "unverifiable"), ("eeg_population", "unverifiable"), ("test", "block"), ("calibration", "block")])
def test_missing_lists(base, role, want):
    """An undeclared list is unverifiable; without calibration or test evidence the declared resources cannot match it."""
    e = base[2].selectExpr("* except (declared)", f"array_except(declared, array('{role}')) AS declared")
    assert status(base, lists=base[1].filter(f"role <> '{role}'"), executions=e) == want


def test_support_digest_and_contract(base):
    e = base[2]
    assert status(base, executions=e.selectExpr("* except (expected_support)", "'other' AS expected_support")) == "block"
    assert status(base, executions=e.selectExpr("* except (unsupported_fields)", "1 AS unsupported_fields")) == "block"
    assert status(base, executions=e.selectExpr("* except (predictors_declared)", "false AS predictors_declared")) == "unverifiable"
    assert status(base, executions=e.selectExpr("* except (additional_eeg)", "array('extra') AS additional_eeg")) == "block"


def test_unsound_trial_tables_block(spark, base):
    t, l, e = base
    more = spark.createDataFrame([("a", "s9", "k9")], t.schema)
    blank = spark.createDataFrame([(" ", "s9", "k9")], t.schema)
    null = spark.createDataFrame([(None, "s9", "k9")], t.schema)
    for extra in (more, blank, null):
        checks = A.workflow_checks(t.unionByName(extra), l, e).collect()
        assert [(r.check, r.status) for r in checks] == [("trial_schema", "block")]


def test_kinds_of_support_digest(base):
    import hashlib

    t, l, e = base
    right = hashlib.sha256(b"d\ne").hexdigest()
    declared = lambda digest, kind: e.selectExpr("* except (expected_support)", f"'{digest}' AS expected_support", f"'{kind}' AS support_kind")
    run = lambda digest, kind, gather: A.workflow_audit(t, l, declared(digest, kind), gather_support=gather).first().status
    assert run(right, "sorted_lines", True) == "allow" and run("0" * 64, "sorted_lines", True) == "block"
    assert run(right, "sorted_lines", False) == "unverifiable" and run(right, "other_kind", True) == "unverifiable"


def test_absent_axis_is_not_verified(spark):
    from heldout.operators import exposure as X

    cell = "seed bigint, participant_dose int, stimulus_dose int, trial_uid string, split string"
    rows = spark.createDataFrame([(1, 0, 0, "a", "train"), (1, 0, 0, "b", "test")], cell)
    trials = spark.createDataFrame([("a", "s1", "d1"), ("b", "s2", "d1")], "trial_uid string, session_uid string, dataset_id string")
    found = X.axis_isolation(trials, rows, ["session_uid", "dataset_id", "device_id"])
    assert {r.axis: (r.complete, r.overlap, r.verified) for r in found.collect()} == {
        "session_uid": (True, 0, True), "dataset_id": (True, 1, False), "device_id": (False, None, False),
    }
    card = X.claim_card(rows.select(*X.CELL).distinct(), isolation=found, requested=["device"], context="clinic's use").first()
    assert card.verified_holdouts == ["session"] and card.requested_holdouts == ["device"] and card.deployment_context == "clinic's use"
    assert "session-independent generalization" not in card.blocked_claims and "cross-device generalization" in card.blocked_claims


def review(spark, **k):
    a = spark.createDataFrame([("a", "train"), ("b", "calibration"), ("c", "test"), ("d", "excluded")], "trial_uid string, split string")
    out = A.evidence_review(a, **k)
    return {r.check: r.status for r in out.collect()}


def test_evidence_review(spark):
    ids = lambda *u: spark.createDataFrame([(x,) for x in u], "trial_uid string")
    empty = review(spark)
    assert set(empty.values()) == {"allow", "unverifiable"} and empty["assignment_schema"] == "allow"
    assert review(spark, fit=ids("a", "c"))["declared_preprocessing_test_exclusion"] == "block"
    assert review(spark, fit=ids("a"))["declared_preprocessing_test_exclusion"] == "allow"
    pair = lambda x, y: {"prior_personalized": x, "combined_personalized": y}
    assert review(spark, calibration=pair(ids("b"), ids("b")))["matched_predictor_calibration"] == "allow"
    assert review(spark, calibration=pair(ids("b"), ids("a")))["matched_predictor_calibration"] == "block"
    assert review(spark, calibration=pair(ids("b", "b"), ids("b")))["matched_predictor_calibration"] == "block"
    assert review(spark, declared_sha="x", actual_sha="y")["feature_file_binding"] == "block"
    assert review(spark, prior_resources=["secret_labels"])["prior_resource_declaration"] == "block"
