"""The end-to-end audit: from trials and features to every evidence table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heldout.functions.checks import EvaluationError, finite, require_columns
from heldout.functions.materialize import materialize
from heldout.operators import audits as A
from heldout.operators import exposure as X
from heldout.operators import inference as I
from heldout.operators import metrics as M
from heldout.operators import probes as B
from heldout.operators import readout as R
from heldout.operators import splits as S
from heldout.sources.trials import write_ordered

TARGETS = ("target_valence", "target_arousal")


def coverage_counts(trials: DataFrame, features: DataFrame) -> DataFrame:
    """Input, labelled, eligible and unmatched counts."""
    both = trials.select("trial_uid", F.lit(1).alias("t"), (finite(TARGETS[0]) & finite(TARGETS[1])).alias("labelled")).join(
        features.select("trial_uid", F.lit(1).alias("f")), "trial_uid", "full_outer"
    )
    return both.agg(
        F.count("t").alias("input_trial_count"), F.count("f").alias("input_feature_count"),
        F.expr("count_if(t = 1 and not labelled)").alias("missing_target_count"), F.expr("count_if(labelled and f = 1)").alias("eligible_trial_count"),
        F.expr("count_if(labelled and f is null)").alias("labelled_trials_without_features"),
        F.expr("count_if(f = 1 and not coalesce(labelled, false))").alias("feature_rows_outside_labelled_support"),
    )


def audit_bundle(
    trials: DataFrame, features: DataFrame, *, p_doses: Sequence[int], s_doses: Sequence[int], seed: int, strict: DataFrame | None = None,
    alphas: Sequence[float] = (0.1, 1.0, 10.0), draws: int = 2000, validation: float = 0.1, test: float = 0.2, validate: bool = True,
    declared_sha: str | None = None, actual_sha: str | None = None, fit_uids: DataFrame | None = None, probes: bool = True,
) -> dict[str, DataFrame]:
    """All tables of one audit; a contradicted declaration is an error before any score is computed."""
    require_columns(trials, ["trial_uid", "subject_uid", "stimulus_uid", *TARGETS])
    if not p_doses or not s_doses or len(set(p_doses)) != len(p_doses) or len(set(s_doses)) != len(s_doses):
        raise EvaluationError("list each dose once, and at least one per axis")
    out = {"coverage_report": coverage_counts(trials, features)}
    usable = trials.filter(finite(TARGETS[0]) & finite(TARGETS[1])).join(features.select("trial_uid"), "trial_uid", "left_semi")
    usable = materialize(usable)
    if strict is None:
        strict = S.double_holdout(usable, seeds=(seed,), validation=validation, test=test, validate=validate)
    out["strict_assignment"] = strict = materialize(strict)
    marks = materialize(X.cell_marks(usable, strict, p_doses=p_doses, s_doses=s_doses, validate=validate))
    out["assignment"] = assignment = X.expand_cells(marks, p_doses=p_doses, s_doses=s_doses)
    out["cell_audit"] = X.cell_audit(assignment)
    out["support"] = X.support_digests(assignment)
    isolation = X.axis_isolation(trials, assignment, list(X.AXIS_COLUMNS.values()))
    out["claim_cards"] = X.claim_card(assignment.groupBy(*X.CELL).count().drop("count"), isolation=isolation)
    # declared calibration sets come from the compiled assignment itself
    largest = X.expand_cells(marks, p_doses=[max(p_doses)], s_doses=[max(s_doses)]).select("trial_uid", "split")
    calibration = largest.filter("split = 'calibration'").select("trial_uid")
    resources = ["population_training_labels"] + (["participant_calibration_labels"] if max(p_doses) > 0 else [])
    if {"stimulus_prior_valence", "stimulus_prior_arousal"} <= set(trials.columns):
        resources.append("released_normative_prior")
    review = materialize(A.evidence_review(
        largest, fit=fit_uids, calibration={"prior_personalized": calibration, "combined_personalized": calibration}, prior_resources=resources,
        actual_prior_resources=resources, declared_sha=declared_sha, actual_sha=actual_sha,
    ))
    blocked = [r.check for r in review.filter("status = 'block'").collect()]
    if blocked:
        raise EvaluationError(f"supplied evidence contradicts the allowed resources: {blocked}")
    out["evidence_review"] = review
    predictions, selection = R.evaluate_cells(usable, strict, features, p_doses=p_doses, s_doses=s_doses, alphas=alphas, validate=False, marks=marks)
    out["predictions"], out["selected_alpha"] = predictions, selection = materialize(predictions), selection
    out["scores"] = R.cell_metrics(predictions).filter("target = 'macro'")
    long = M.long_predictions(
        predictions.withColumn("representation", F.lit("supplied_features_ridge")), R.PREDICTORS,
        keep=["representation", "seed", "participant_dose", "stimulus_dose", "trial_uid", "subject_uid", "stimulus_uid"],
    )
    table = I.score_draws(long, draws=draws, seed=seed, validate=validate)
    out["added_value_scores"] = I.added_value_analysis(table)
    out["added_value_contrasts"] = I.paired_contrasts(table)
    out["added_value_summary"] = I.summary_rows(table)
    if probes:
        vectors = marks.join(features.select("trial_uid", "features"), "trial_uid")
        held = vectors.filter("in_test")
        parts = None
        for axis, rank, column, grid, salt in (("participant", "cal_rank", "subject_uid", p_doses, 17), ("stimulus", "exp_rank", "stimulus_uid", s_doses, 31)):
            for dose in (x for x in grid if x > 0):
                part = B.nearest_centroid_probe(vectors.filter(f"{rank} <= {dose}"), held, column, seed=seed + salt).withColumns(
                    {"identity_axis": F.lit(axis), "dose": F.lit(int(dose))}
                )
                parts = part if parts is None else parts.unionByName(part)
        if parts is not None:
            out["identity_probes"] = parts
    return out


def write_bundle(bundle: dict[str, DataFrame], root: str) -> None:
    """Each table as sorted, committed parquet below ``root``."""
    for name, df in bundle.items():
        keys = [c for c, t in df.dtypes if t in ("string", "bigint", "int")] or df.columns[:1]
        write_ordered(df, f"{root.rstrip('/')}/{name}", keys)
