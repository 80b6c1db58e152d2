"""Event logs to trials.

Every log is ordered per recording and processed through ``ordered_scan``: the
recording is cut into time chunks, so one long recording is still parallel.
Violations come out as rows with a status, not as a failed job.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heldout.functions.checks import guard_none, guard_unique, require_columns
from heldout.functions.joins import attach_groups, ordered_scan
from heldout.functions.materialize import materialize

# Fixed trigger codes: conditions by stimulus code; the cue code is the stimulus code minus 6.
CONDITIONS = {
    18: ("nonsocial", "negative", "reappraise"),
    19: ("nonsocial", "negative", "watch"),
    20: ("nonsocial", "neutral", "watch"),
    21: ("social", "negative", "reappraise"),
    22: ("social", "negative", "watch"),
    23: ("social", "neutral", "watch"),
}
CUE_SHIFT = 6
AROUSAL_MARKER, VALENCE_MARKER, NOISE_CODE = 49, 48, 2048

# Fixed music log codes.
START_CODE, FIXATION_CODE, TRIAL_SECONDS = 788, 786, 12.0
STIMULUS_CODES, QUESTION_CODES, ANSWER_CODES, ANSWER_BASE = (301, 660), (800, 807), (833, 841), 832

# Fixed material tables: category offset plus exemplar offset gives the material number.
CATEGORY_OFFSETS = {"joy": 0, "ins": 3, "ten": 6, "sad": 9, "fear": 12, "dis": 15, "neu": 18}
EXEMPLAR_OFFSETS = {4: 1, 5: 2, 8: 3}
SECOND_CONTEXT_SHIFT = 21


def reconstruct_cued_trials(events: DataFrame, *, chunk: str = "chunk") -> DataFrame:
    """Trials from a trigger log ``(recording, onset, sample, code, chunk)``.

    Each stimulus takes the last cue since the previous stimulus, which decides
    its condition; the body of the trial ends at the next cue or stimulus.
    """
    require_columns(events, ["recording", "onset", "sample", "code", chunk])
    stim_codes = ", ".join(str(c) for c in CONDITIONS)
    cue_codes = ", ".join(str(c - CUE_SHIFT) for c in CONDITIONS)
    rows = events.selectExpr(
        "recording", "onset", "sample", "code", f"{chunk} AS _chunk",
        f"code in ({stim_codes}) AS is_stim", f"code in ({cue_codes}) AS is_cue",
        "struct(onset, sample, code) AS here",
    )

    def only(cond):
        return F.expr(f"case when {cond} then here end")

    scanned = ordered_scan(
        rows, by=["recording"], chunk="_chunk", order=["onset", "sample"],
        running={"trial_index": F.expr("cast(is_stim as bigint)")},
        previous={"last_cue": only("is_cue"), "last_stim": only("is_stim")},
        following={
            "next_rating": only("code between 1 and 9"),
            "next_valence": only(f"code = {VALENCE_MARKER}"),
            "next_boundary": only("is_cue or is_stim"),
        },
        inclusive=False,
    )
    # a row is in the body of the trial whose stimulus precedes it, unless a cue came since
    body = "not is_stim and not is_cue and last_stim is not null and (last_cue is null or last_cue < last_stim)"
    marked = scanned.selectExpr("*", f"({body}) AS in_body")
    after = (
        "case when next_rating is not null and (next_boundary is null or next_rating < next_boundary){stop} "
        "then next_rating.code end"
    )
    arousal = after.format(stop=" and (next_valence is null or next_rating < next_valence)")
    trial = marked.filter("is_stim or in_body").groupBy("recording", "trial_index").agg(
        F.max(F.expr("case when is_stim then struct(onset, sample, code, last_cue, last_stim) end")).alias("s"),
        F.expr(f"min_by({arousal}, here) filter (where in_body and code = {AROUSAL_MARKER})").cast("double").alias("arousal"),
        F.expr(f"min_by({after.format(stop='')}, here) filter (where in_body and code = {VALENCE_MARKER})").cast("double").alias("valence"),
        F.expr(f"count_if(in_body and code = {NOISE_CODE})").alias("extra_trigger_count"),
    )
    cue = "case when s.last_cue is not null and (s.last_stim is null or s.last_cue > s.last_stim) then s.last_cue.code end"
    table = ", ".join(f"{c}, '{'_'.join(v)}'" for c, v in CONDITIONS.items())
    out = trial.selectExpr(
        "recording", "trial_index", "s.onset AS onset", "s.sample AS sample", f"{cue} AS cue_code",
        "s.code AS source_stimulus_code", "arousal", "valence", "extra_trigger_count",
    )
    return out.selectExpr(
        "*",
        f"cue_code + {CUE_SHIFT} AS stimulus_code",
        f"element_at(map({table}), cue_code + {CUE_SHIFT}) AS condition_id",
        f"case when cue_code is null then 'no_cue' when source_stimulus_code = cue_code + {CUE_SHIFT} then 'verified' "
        "else 'corrected_from_cue' end AS condition_alignment_status",
        "case when arousal is not null and valence is not null then 'complete' else concat('missing_', "
        "array_join(array_compact(array(if(arousal is null, 'arousal', null), if(valence is null, 'valence', null))), '_and_')) "
        "end AS rating_alignment_status",
    )


def rating_after_marker(
    events: DataFrame, *, marker: int, stop: int | None = None, by: Sequence[str], position: str = "position", code: str = "code",
) -> DataFrame:
    """First code 1-9 after the first ``marker`` of a group and before the first later ``stop``."""
    by = list(by)
    first = events.filter(F.col(code) == marker).groupBy(*by).agg(F.min(position).alias("_from"))
    later = attach_groups(events, first, by, how="inner", spread=position).filter(F.col(position) > F.col("_from"))
    stop_at = f"min({position}) filter (where {code} = {stop})" if stop is not None else "cast(null as bigint)"
    found = later.groupBy(*by).agg(
        F.expr(f"min(struct({position} AS p, {code} AS c)) filter (where {code} between 1 and 9)").alias("r"),
        F.expr(stop_at).alias("s"),
    )
    rated = found.selectExpr(*by, "case when r is not null and (s is null or r.p < s) then cast(r.c as double) end AS rating")
    return events.select(*by).distinct().join(rated, by, "left")


def parse_onset_trials(events: DataFrame, *, chunk: str = "chunk") -> DataFrame:
    """Start events with their fixation, their single stimulus code and the questionnaire end.

    The nearest fixation at or before the start is an as-of match; a stimulus
    code belongs to the next start if it lies after the previous trial's end.
    """
    require_columns(events, ["recording", "onset", "sample", "code", chunk])
    lo, hi = STIMULUS_CODES
    rows = events.selectExpr(
        "recording", "onset", "sample", "code", f"{chunk} AS _chunk",
        f"code = {START_CODE} AS is_start", f"code between {lo} and {hi} AS is_code",
        # at equal onsets fixations and codes count for the start
        f"case when code = {FIXATION_CODE} then 0 when code between {lo} and {hi} then 1 when code = {START_CODE} then 2 else 3 end AS prio",
    )
    scanned = ordered_scan(
        rows, by=["recording"], chunk="_chunk", order=["onset", "prio", "sample"],
        running={"trial_index": F.expr("cast(is_start as bigint)")},
        previous={
            "last_start": F.expr("case when is_start then onset end"),
            "fixation_onset": F.expr(f"case when code = {FIXATION_CODE} then onset end"),
        },
        following={
            "next_start": F.expr("case when is_start then struct(onset, sample) end"),
            "next_fixation": F.expr(f"case when code = {FIXATION_CODE} then onset end"),
        },
        inclusive=False,
    )
    starts = scanned.filter("is_start").selectExpr(
        "recording", "trial_index", "onset", "sample", "fixation_onset", "next_fixation",
        "next_start is not null and (next_fixation is null or next_start.onset < next_fixation) AS overlapped",
    )
    codes = (
        scanned.filter(f"is_code and next_start is not null and onset >= coalesce(last_start + {TRIAL_SECONDS}D, 0D)")
        .groupBy("recording", F.col("next_start.sample").alias("sample"))
        .agg(F.count(F.lit(1)).alias("code_count"), F.min("code").alias("stimulus_code"))
    )
    return starts.join(codes, ["recording", "sample"], "left").selectExpr(
        "recording", "trial_index", "onset", "fixation_onset", "next_fixation",
        "coalesce(code_count, 0L) AS code_count",
        "case when code_count = 1 then stimulus_code end AS stimulus_code",
        "case when fixation_onset is null then 'no_fixation' when coalesce(code_count, 0) <> 1 then 'stimulus_code_count' "
        "when overlapped then 'overlapping_window' else 'ok' end AS status",
    )


def pair_question_response(events: DataFrame, *, by: Sequence[str], chunk: str = "chunk") -> DataFrame:
    """Pair questions with answers in a log ``(by, position, code, chunk)``.

    A question is active from its first trigger to the next answer and later
    triggers of an answered question are ignored, so the partner of a question
    is the first answer after its first trigger.  Two questions reaching the
    same answer, or an answer no question reaches, are violations.
    """
    by = list(by)
    q0, q1 = QUESTION_CODES
    a0, a1 = ANSWER_CODES
    rows = events.selectExpr(
        *by, "position", "code", f"{chunk} AS _chunk",
        f"code between {q0} and {q1} AS is_q", f"code between {a0} and {a1} AS is_a",
        f"cast(code between {q0} and {q1} as int) AS prio",  # at one position answers come first
    ).filter("is_q or is_a")
    scanned = ordered_scan(
        rows, by=by, chunk="_chunk", order=["position", "prio", "code"],
        following={"answer": F.expr("case when is_a then struct(position, code) end")},
        inclusive=False,
    )
    questions = scanned.filter("is_q").groupBy(*by, F.col("code").alias("question")).agg(
        F.min_by("answer", "position").alias("answer"), F.min("position").alias("asked_at")
    )
    claims = questions.filter("answer is not null").groupBy(*by, "answer").agg(F.count(F.lit(1)).alias("claims"))
    paired = questions.join(claims, [*by, "answer"], "left").selectExpr(
        *by, "question", "asked_at", "answer.position AS answered_at", f"answer.code - {ANSWER_BASE} AS rating",
        "case when answer is null then 'unanswered' when claims > 1 then 'replaced_unanswered_question' else 'paired' end AS status",
    )
    orphans = (
        rows.filter("is_a").selectExpr(*by, "struct(position, code) AS answer").join(claims, [*by, "answer"], "left_anti")
    ).selectExpr(
        *by, "cast(null as bigint) AS question", "cast(null as bigint) AS asked_at", "answer.position AS answered_at",
        f"answer.code - {ANSWER_BASE} AS rating", "'answer_without_question' AS status",
    )
    return paired.unionByName(orphans)


def questionnaire_status(pairs: DataFrame, *, by: Sequence[str], expected: int = 8) -> DataFrame:
    """One row per group: complete only if all questions are paired and nothing is left over."""
    return pairs.groupBy(*by).agg(
        F.expr("count_if(status = 'paired')").alias("ratings"),
        F.expr("count_if(status in ('replaced_unanswered_question', 'answer_without_question'))").alias("violations"),
    ).selectExpr(*by, "ratings", "violations", f"ratings = {expected} and violations = 0 AS complete")


def parse_stimulation_events(events: DataFrame, *, sampling_frequency: float, kind: str, chunk: str = "chunk") -> DataFrame:
    """Stimulation rows numbered in time order, samples to seconds, label suffix removed."""
    if sampling_frequency <= 0:
        raise ValueError("a sampling rate of zero or less has no samples")
    rows = events.filter(F.col("kind") == kind).selectExpr("recording", "onset", "sample", "label", f"{chunk} AS _chunk")
    numbered = ordered_scan(
        rows, by=["recording"], chunk="_chunk", order=["onset", "sample"], running={"trial_index": F.lit(1).cast("bigint")}
    )
    return numbered.selectExpr(
        "recording", "trial_index", "label AS event_label",
        r"regexp_replace(trim(label), r'_\d+$', '') AS stimulus_id",
        "onset AS onset_samples", f"onset / {float(sampling_frequency)!r}D AS onset_s",
    )


def attach_behavior(trials: DataFrame, behavior: DataFrame, key: str, *, validate: bool = True) -> DataFrame:
    """Left join ratings many to one; ``label_available`` tells whether a row matched."""
    if validate:
        guard_unique(behavior, [key])
    matched = attach_groups(trials, behavior.withColumn("_hit", F.lit(True)), [key])
    return matched.withColumn("label_available", F.col("_hit").isNotNull()).drop("_hit")


def dedupe_dimension(df: DataFrame, key: str) -> DataFrame:
    """Distinct rows per key with ``conflict`` set where they disagree."""
    rest = [c for c in df.columns if c != key]
    return df.distinct().groupBy(key).agg(
        *[F.min_by(c, F.struct(*rest)).alias(c) for c in rest], (F.count(F.lit(1)) > 1).alias("conflict")
    )


def align_behavior_codes(behavior: DataFrame, sequence: DataFrame, *, code_max: int = 42) -> DataFrame:
    """Ratings joined to each subject's expected codes, or blank rows if the codes are unusable.

    ``behavior(subject, code_text, score)``; ``sequence(subject, context, code, position)``.
    A subject is usable if its codes are valid, unique and exactly the expected set.
    """
    coded = behavior.selectExpr("subject", "score", "try_cast(regexp_extract(code_text, '[0-9]+', 0) as bigint) AS code").selectExpr(
        "subject", "score", f"case when code between 1 and {code_max} then code end AS code"
    )
    per_code = coded.groupBy("subject", "code").agg(F.count(F.lit(1)).alias("n"), F.first("score").alias("score"))
    expected = sequence.select("subject", "code").withColumn("want", F.lit(1))
    usable = (
        per_code.withColumn("have", F.lit(1)).join(expected, ["subject", "code"], "full_outer")
        .groupBy("subject")
        .agg(F.every(F.expr("coalesce(have = 1 and want = 1 and n = 1, false)")).alias("usable"))
    )
    rows = sequence.join(usable, "subject", "left").join(per_code.drop("n"), ["subject", "code"], "left")
    rows = rows.selectExpr(
        "subject", "context", "code", "position", "case when usable then score end AS score",
        "coalesce(usable, false) AS label_available",
        "if(usable, 'verified_global_stimulus_code', 'source_stimulus_code_unusable') AS label_alignment_status",
    )
    # a subject's sequence holds at most ``code_max`` rows
    return rows.selectExpr(
        "*", "row_number() over (partition by subject, context order by position, code) AS trial_index"
    )


def parse_key_value_events(df: DataFrame, column: str = "value") -> DataFrame:
    """``key:value;key:value`` text as a map, with ``valid`` false for malformed rows."""
    # only text with quotes needs the look-ahead, which reads the rest of the text at each semicolon
    quoted = f"""split({column}, ';(?=(?:[^"]*"[^"]*")*[^"]*$)', -1)"""
    parts = f"""if(instr({column}, '"') = 0, split({column}, ';', -1), {quoted})"""
    plain = """if(p like '"%"' and length(p) > 1, replace(substring(p, 2, length(p) - 2), '""', '"'), p)"""
    pairs = f"transform(transform({parts}, p -> {plain}), p -> struct(trim(split_part(p, ':', 1)) AS k, p like '%:%' AS ok, trim(substring(p, instr(p, ':') + 1)) AS v))"
    rows = df.selectExpr("*", f"{pairs} AS _p")
    valid = "forall(_p, x -> x.ok and x.k <> '') and size(array_distinct(transform(_p, x -> x.k))) = size(_p) and exists(_p, x -> x.k = 'event')"
    rows = rows.selectExpr("*", f"coalesce({valid}, false) AS valid")
    return rows.selectExpr(
        "*", "case when valid then map_from_entries(transform(_p, x -> struct(x.k, x.v))) end AS fields"
    ).drop("_p")


SHORTEST, LONGEST, NOMINAL = 2.9, 3.15, 3.0


def prompted_chain(events: DataFrame, *, chunk: str = "chunk") -> DataFrame:
    """Log rows ``(recording, line, onset, value, chunk)`` with a ``fault`` per offending row.

    A valid recording repeats prompt, stimulus, scale and confirmation.  Scale
    and confirmation rows before the first prompt are leading orphans.
    """
    # the text is parsed once; the scan below reads the parsed columns several times
    rows = parse_key_value_events(events).selectExpr(
        "recording", "line", "onset", f"{chunk} AS _chunk", "valid",
        "case fields['event'] when 'anchorsPresented' then 'prompt' when 'presentedStimulus' then 'stimulus' "
        "when 'scalePresented' then 'scale' when 'optionConfirmed' then 'confirm' end AS kind",
        "fields['stimulus'] AS stimulus", "fields['scale'] AS scale", "try_cast(fields['response'] as double) AS response",
    )
    rows = materialize(rows)
    here = "struct(line, onset, stimulus, scale)"
    scanned = ordered_scan(
        rows, by=["recording"], chunk="_chunk", order=["line"],
        running={"prompts": F.expr("cast(coalesce(kind = 'prompt', false) as bigint)")},
        previous={
            "last_kind": F.expr("kind"),
            "last_onset": F.expr("onset"),
            **{f"p_{k}": F.expr(f"case when kind = '{k}' then {here} end") for k in ("prompt", "stimulus", "scale")},
        },
        inclusive=False,
    )
    orphan = "prompts = 0 and coalesce(kind in ('scale', 'confirm'), false) and coalesce(last_kind, '') <> 'stimulus'"
    fault = f"""case
        when not valid then 'malformed_fields'
        when onset is null or isnan(onset) or abs(onset) = double('inf') then 'bad_onset'
        when onset < last_onset then 'not_chronological'
        when kind is null or ({orphan}) then null
        when kind = 'prompt' and last_kind in ('stimulus', 'scale') and prompts > 1 then 'prompt_before_response'
        when kind = 'stimulus' and coalesce(last_kind, '') <> 'prompt' then 'stimulus_without_prompt'
        when kind in ('scale', 'confirm') and coalesce(last_kind, '') not in ('stimulus', 'scale') then 'no_pending_stimulus'
        when kind in ('scale', 'confirm') and not (stimulus <=> p_stimulus.stimulus and scale <=> p_prompt.scale) then 'mismatched_rating'
        when kind = 'scale' and (last_kind = 'scale' or onset <= p_stimulus.onset) then 'repeated_scale'
        when kind = 'confirm' and (last_kind <> 'scale' or onset < p_scale.onset) then 'response_before_scale'
        when kind = 'confirm' and response is null then 'bad_response'
        when kind = 'confirm' and not (p_scale.onset - p_stimulus.onset between {SHORTEST}D and {LONGEST}D) then 'bad_duration'
        when kind = 'confirm' and scale in ('SAM-valence', 'SAM-arousal')
             and not (response between 1 and 9 and response = floor(response)) then 'bad_rating'
        end"""
    return scanned.selectExpr("*", f"({orphan}) AS orphan", f"{fault} AS fault")


def rejected_recordings(chain: DataFrame) -> DataFrame:
    """Recordings with a fault or an unanswered last stimulus: ``(recording, faults, first_fault)``."""
    per = chain.groupBy("recording").agg(
        F.count("fault").alias("faults"),
        F.expr("min_by(fault, line) filter (where fault is not null)").alias("first_fault"),
        F.expr("max_by(kind, line) filter (where kind is not null and not orphan)").alias("last_kind"),
    )
    return per.selectExpr(
        "recording", "faults",
        "coalesce(first_fault, if(last_kind in ('stimulus', 'scale'), 'unfinished_recording', null)) AS first_fault",
    ).filter("first_fault is not null")


def parse_prompted_responses(events: DataFrame, *, chunk: str = "chunk") -> DataFrame:
    """Rated trials of the recordings whose whole log is valid."""
    chain = prompted_chain(events, chunk=chunk)
    chain = materialize(chain)
    good = chain.filter("kind = 'confirm' and not orphan and scale in ('SAM-valence', 'SAM-arousal')").join(
        rejected_recordings(chain).select("recording"), "recording", "left_anti"
    )
    return good.selectExpr(
        "concat_ws(':', recording, p_stimulus.line) AS trial_uid", "recording", "stimulus AS stimulus_uid", "scale AS context",
        "replace(scale, 'SAM-', '') AS target_name", "response AS rating_raw", "(9 - response) / 8 AS rating_normalized",
        "p_stimulus.onset AS onset_s", f"least({NOMINAL}D, p_scale.onset - p_stimulus.onset) AS duration_s", "onset AS response_onset_s",
    )


def join_dimensions(trials: DataFrame, dimensions: dict[str, DataFrame], *, validate: bool = True) -> DataFrame:
    """Many-to-one joins on each named key; a trial without its dimension row is an error."""
    out = trials
    for key, dim in dimensions.items():
        if validate:
            guard_unique(dim, [key])
        out = attach_groups(out, dim.withColumn(f"_has_{key}", F.lit(True)), [key])
    if validate:
        for key in dimensions:
            guard_none(out.filter(f"_has_{key} is null").select(key), f"no dimension row for {key}")
    return out.drop(*[f"_has_{k}" for k in dimensions])


def rating_residuals(df: DataFrame, names: Sequence[str]) -> DataFrame:
    return df.selectExpr("*", *[f"self_{n} - normative_{n} AS residual_{n}" for n in names])


# Fixed scale bounds and source columns per dataset.
SCALES = {
    "ds002721": (1.0, 9.0, "1-9", "self_pleasant", "self_energetic", "normative_pleasant", "normative_energetic"),
    "ds003751": (1.0, 9.0, "1-9", "self_valence", "self_arousal", None, None),
    "ds005540": (0.0, 7.0, "0-7", "self_valence", "self_arousal", None, None),
    "ds006866": (1.0, 9.0, "1-9", "valence", "arousal", None, None),
}


def harmonize_targets(df: DataFrame, scales: dict = SCALES) -> DataFrame:
    """Targets and published priors mapped to [0, 1] by the scale of each dataset."""
    require_columns(df, ["dataset_id"])

    def pick(slot: int) -> str:
        cases = "".join(
            f" when '{d}' then try_cast({s[slot]} as double)" for d, s in scales.items() if s[slot] and s[slot] in df.columns
        )
        return f"case dataset_id{cases} end" if cases else "cast(null as double)"

    low = "case dataset_id" + "".join(f" when '{d}' then {s[0]!r}D" for d, s in scales.items()) + " end"
    width = "case dataset_id" + "".join(f" when '{d}' then {s[1] - s[0]!r}D" for d, s in scales.items()) + " end"
    label = "case dataset_id" + "".join(f" when '{d}' then '{s[2]}'" for d, s in scales.items()) + " end"
    names = ("target_valence", "target_arousal", "stimulus_prior_valence", "stimulus_prior_arousal")
    columns = [f"(({pick(3 + i)}) - ({low})) / ({width}) AS {n}" for i, n in enumerate(names)]
    keep = [c for c in df.columns if c not in names]
    out = df.selectExpr(*keep, f"{label} AS target_scale", *columns)
    reported = "coalesce(label_available, false)" if "label_available" in df.columns else "true"
    return out.selectExpr(
        "*",
        f"{reported} and coalesce(target_valence between 0 and 1, false) and coalesce(target_arousal between 0 and 1, false) AS target_available",
    )


def condition_family(df: DataFrame, columns: Sequence[str] = ("nominal_valence", "regulation")) -> DataFrame:
    return df.withColumn("condition_family", F.concat_ws("_", *columns))


def event_participant_coverage(events: DataFrame, participants: DataFrame, column: str = "recording") -> DataFrame:
    """Participants without events and events without a participant."""
    a = participants.select(column).distinct().withColumn("p", F.lit(1))
    b = events.select(column).distinct().withColumn("e", F.lit(1))
    return a.join(b, column, "full_outer").filter("p is null or e is null").selectExpr(
        column, "if(e is null, 'missing', 'unexpected') AS status"
    )


def trial_audit(df: DataFrame, *, nominal_trials: int) -> DataFrame:
    """Long ``(dataset_id, metric, item, value)`` audit of a labelled trial table."""
    pairs = df.groupBy("dataset_id", "subject_uid", "stimulus_uid").agg(F.count(F.lit(1)).alias("n"))
    repeated = pairs.groupBy("dataset_id").agg(F.expr("coalesce(sum(n) filter (where n > 1), 0)").alias("value"))
    base = df.groupBy("dataset_id").agg(
        F.count(F.lit(1)).alias("trial_count"),
        F.count_distinct("subject_uid").alias("subject_count"),
        F.count_distinct("stimulus_uid").alias("stimulus_count"),
        F.expr("count_if(label_available)").alias("labelled_count"),
        F.expr("count_if(not label_available)").alias("unlabelled_count"),
        F.min("rating").alias("rating_min"),
        F.max("rating").alias("rating_max"),
        F.expr("count_if(alignment_status = 'corrected_from_cue')").alias("corrected_count"),
    )
    names = [c for c in base.columns if c != "dataset_id"]
    out = base.select("dataset_id", *[F.col(n).cast("double") for n in names]).unpivot(
        ["dataset_id"], names, "metric", "value"
    ).selectExpr("dataset_id", "metric", "cast(null as string) AS item", "value")
    out = out.unionByName(repeated.selectExpr("dataset_id", "'repeated_pair_rows' AS metric", "cast(null as string) AS item", "cast(value as double) AS value"))
    conditions = df.groupBy("dataset_id", "context").agg(F.count(F.lit(1)).alias("n"))
    out = out.unionByName(conditions.selectExpr("dataset_id", "'condition_count' AS metric", "context AS item", "cast(n as double) AS value"))
    off = df.groupBy("dataset_id", "subject_uid").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") != nominal_trials)
    return out.unionByName(off.selectExpr("dataset_id", "'off_nominal_subject' AS metric", "subject_uid AS item", "cast(n as double) AS value"))


def duplicate_lineage(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """All rows of any key that occurs more than once."""
    repeated = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies")).filter("copies > 1")
    return attach_groups(df, repeated, list(keys), how="inner")


def dataset_scope(df: DataFrame) -> DataFrame:
    """Participants, trials, stimuli and labelled trials per dataset, per tier and overall.

    A roll-up's stimulus count is NULL if any member dataset has no stimulus identity.
    """
    per = df.groupBy("tier", "dataset_id").agg(
        F.count_distinct("subject_uid").alias("participant_count"),
        F.count(F.lit(1)).alias("trial_count"),
        F.expr("case when count(stimulus_uid) > 0 then count(distinct stimulus_uid) end").alias("stimulus_count"),
        F.count_if(F.lower(F.col("label_available").cast("string")).isin("true", "1", "yes")).alias("labelled_count"),
    )
    tier, dataset = F.col("tier"), F.col("dataset_id")
    return per.groupingSets([[tier, dataset], [tier], []], tier, dataset).agg(
        F.count(F.lit(1)).alias("dataset_count"),
        F.sum("participant_count").alias("participant_count"),
        F.sum("trial_count").alias("trial_count"),
        F.expr("case when count(stimulus_count) = count(*) then sum(stimulus_count) end").alias("stimulus_count"),
        F.sum("labelled_count").alias("labelled_count"),
    )


def sample_bounds(df: DataFrame, *, nominal_rate: float, available: str = "available_samples", tolerance_ppm: float = 50.0) -> DataFrame:
    """One-based sample to ``[start, stop)``, with clock drift and out-of-range flags."""
    rate = f"{float(nominal_rate)!r}D"
    out = df.selectExpr(
        "*", "sample_1based - 1 AS start", f"sample_1based - 1 + cast(bround(duration_s * {rate}, 0) as bigint) AS stop",
        f"abs(measured_rate - {rate}) / {rate} * 1000000D AS drift_ppm",
        f"abs(sample_1based - 1 - cast(bround(onset_s * {rate}, 0) as bigint)) AS onset_discrepancy",
    )
    return out.selectExpr(
        "*", f"drift_ppm > {float(tolerance_ppm)!r}D AS drift_exceeded",
        f"start < 0 or stop <= start or stop > {available} AS out_of_range",
    )


def map_stimulus_codes(df: DataFrame) -> DataFrame:
    """``token`` to material number and global code; digits of ``code_text`` range-checked."""
    cats = ", ".join(f"'{k}', {v}" for k, v in CATEGORY_OFFSETS.items())
    exem = ", ".join(f"'{k}', {v}" for k, v in EXEMPLAR_OFFSETS.items())
    pattern = f"^({'|'.join(CATEGORY_OFFSETS)})({'|'.join(str(e) for e in EXEMPLAR_OFFSETS)})$"
    out = df.selectExpr(
        "*",
        f"element_at(map({cats}), nullif(regexp_extract(token, '{pattern}', 1), '')) + "
        f"element_at(map({exem}), nullif(regexp_extract(token, '{pattern}', 2), '')) AS material_number",
        "try_cast(nullif(regexp_extract(code_text, '[0-9]+', 0), '') as bigint) AS parsed_code",
    )
    top = 2 * SECOND_CONTEXT_SHIFT
    return out.selectExpr(
        "*", f"material_number + if(second_context, {SECOND_CONTEXT_SHIFT}, 0) AS global_code",
        f"coalesce(parsed_code between 1 and {top}, false) AS code_valid",
    )


def complete_frames(files: DataFrame, *, sample_bytes: int = 4) -> DataFrame:
    """Whole frames and left-over bytes per file: a left-over marks a truncated recording."""
    return files.selectExpr(
        "*", f"bytes div (channels * {sample_bytes}) AS frames", f"bytes % (channels * {sample_bytes}) AS leftover_bytes"
    )


def build_trial_table(events: DataFrame, behavior: DataFrame, participants: DataFrame, *, dataset_id: str, sampling_frequency: float, kind: str, chunk: str = "chunk") -> DataFrame:
    """All recordings of one dataset at once: parse, attach ratings, key, join participants."""
    parsed = parse_stimulation_events(events, sampling_frequency=sampling_frequency, kind=kind, chunk=chunk)
    rated = attach_behavior(parsed, behavior, "stimulus_id", validate=False)
    keyed = rated.selectExpr(
        "*", f"concat_ws(':', '{dataset_id}', recording, concat('trial-', lpad(trial_index, greatest(2, length(trial_index)), '0'))) AS trial_uid",
        f"'{dataset_id}' AS dataset_id", f"concat_ws(':', '{dataset_id}', recording) AS subject_uid",
        "concat('stim-', stimulus_id) AS stimulus_uid",
    )
    people = dedupe_dimension(participants, "recording").filter("not conflict").drop("conflict")
    return attach_groups(keyed, people, ["recording"])
