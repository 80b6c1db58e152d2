"""Event reconstruction queries over per-user logs derived from ``events`` and ``conversations``."""

from __future__ import annotations

from pyspark.sql import functions as F

from heldout.operators import events as E
from heldout.plans.registry import query, view
from heldout.sources import views as V

CODE = """case kind when 'view' then 12 + k % 6 when 'click' then 18 + k % 6 when 'signup' then 48 + k % 2
  when 'purchase' then 1 + k % 9 else 2048 end"""


def code_log(spark, d):
    return V.event_log(spark, d).selectExpr("recording", "onset", "sample", f"cast({CODE} as bigint) AS code", "day AS chunk")


view("event_log", """
SELECT 'u'||user_id AS recording, epoch_us(ts)/1e6::DOUBLE AS onset, event_id AS sample, event_type AS kind,
  CAST(json_extract(props,'$.k') AS BIGINT) AS k, value FROM events""")
view("code_log", f"SELECT recording, onset, sample, CAST({CODE} AS BIGINT) AS code, row_number() OVER (PARTITION BY recording ORDER BY onset, sample) AS pos FROM event_log")
view("cued", """
SELECT *, sum((code BETWEEN 18 AND 23)::INT) OVER w AS ti,
  max(CASE WHEN code BETWEEN 12 AND 17 THEN pos END) OVER p AS cue_pos, max(CASE WHEN code BETWEEN 18 AND 23 THEN pos END) OVER p AS stim_pos
FROM code_log WINDOW w AS (PARTITION BY recording ORDER BY pos), p AS (PARTITION BY recording ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
view("cued_body", """
SELECT recording, ti, pos, code FROM cued WHERE code NOT BETWEEN 12 AND 23 AND stim_pos IS NOT NULL AND (cue_pos IS NULL OR cue_pos < stim_pos)""")
view("cued_ratings", """
WITH m AS (SELECT recording, ti, min(pos) FILTER (code=49) m49, min(pos) FILTER (code=48) m48 FROM cued_body GROUP BY 1,2),
s AS (SELECT recording, ti, m49, m48, min(pos) FILTER (code=48 AND pos>m49) stop, min(pos) FILTER (code BETWEEN 1 AND 9 AND pos>m49) ra,
   min(pos) FILTER (code BETWEEN 1 AND 9 AND pos>m48) rv, count_if(code=2048) noise FROM cued_body JOIN m USING (recording, ti) GROUP BY ALL)
SELECT s.recording, ti, noise, a.code AS arousal, v.code AS valence FROM s
 LEFT JOIN code_log a ON a.recording=s.recording AND a.pos=s.ra AND (s.stop IS NULL OR s.ra < s.stop)
 LEFT JOIN code_log v ON v.recording=s.recording AND v.pos=s.rv""")
view("cued_trials", """
SELECT c.recording, CAST(c.ti AS BIGINT) AS trial_index, c.onset, c.sample, q.code AS cue_code, c.code AS source_stimulus_code,
 r.arousal::DOUBLE AS arousal, r.valence::DOUBLE AS valence, coalesce(noise,0) AS extra_trigger_count, q.code+6 AS stimulus_code,
 CASE q.code WHEN 12 THEN 'nonsocial_negative_reappraise' WHEN 13 THEN 'nonsocial_negative_watch' WHEN 14 THEN 'nonsocial_neutral_watch'
  WHEN 15 THEN 'social_negative_reappraise' WHEN 16 THEN 'social_negative_watch' WHEN 17 THEN 'social_neutral_watch' END AS condition_id,
 CASE WHEN q.code IS NULL THEN 'no_cue' WHEN c.code=q.code+6 THEN 'verified' ELSE 'corrected_from_cue' END AS condition_alignment_status,
 CASE WHEN arousal IS NOT NULL AND valence IS NOT NULL THEN 'complete' WHEN arousal IS NULL AND valence IS NULL THEN 'missing_arousal_and_valence'
  WHEN arousal IS NULL THEN 'missing_arousal' ELSE 'missing_valence' END AS rating_alignment_status
FROM cued c LEFT JOIN code_log q ON q.recording=c.recording AND q.pos=c.cue_pos AND (c.stim_pos IS NULL OR c.cue_pos>c.stim_pos)
LEFT JOIN cued_ratings r ON r.recording=c.recording AND r.ti=c.ti WHERE c.code BETWEEN 18 AND 23""")


@query("reconstruct_cued_trials", "SELECT * FROM cued_trials")
def _(spark, d):
    return E.reconstruct_cued_trials(code_log(spark, d))


@query("rating_after_marker", """
WITH t AS (SELECT recording, sample // 5000 AS block, sample AS p, code FROM code_log),
m AS (SELECT recording, block, min(p) FILTER (code=49) AS m FROM t GROUP BY 1,2),
s AS (SELECT recording, block, min(p) FILTER (code BETWEEN 1 AND 9 AND p>m) AS r, min(p) FILTER (code=48 AND p>m) AS s FROM t JOIN m USING (recording, block) GROUP BY 1,2)
SELECT s.recording, s.block, t.code::DOUBLE AS rating FROM s LEFT JOIN t ON t.recording=s.recording AND t.p=s.r AND (s.s IS NULL OR s.r<s.s)""")
def _(spark, d):
    log = code_log(spark, d).selectExpr("recording", "sample div 5000 AS block", "sample AS position", "code")
    return E.rating_after_marker(log, marker=49, stop=48, by=["recording", "block"])


MUSIC = """case kind when 'view' then 786 when 'click' then 788 when 'signup' then 301 + k else 800 + k % 8 end"""


def music_log(spark, d):
    return V.event_log(spark, d).selectExpr("recording", "onset", "sample", f"cast({MUSIC} as bigint) AS code", "day AS chunk")


view("music_log", f"SELECT recording, onset, sample, CAST({MUSIC} AS BIGINT) AS code FROM event_log")


@query("parse_onset_trials", """
WITH st AS (SELECT recording, onset, row_number() OVER w AS trial_index, lag(onset) OVER w AS prev, lead(onset) OVER w AS nxt FROM music_log WHERE code=788 WINDOW w AS (PARTITION BY recording ORDER BY onset, sample)),
fx AS (SELECT st.recording, trial_index, max(m.onset) FILTER (m.onset<=st.onset) AS fixation_onset, min(m.onset) FILTER (m.onset>st.onset) AS next_fixation
  FROM st LEFT JOIN music_log m ON m.recording=st.recording AND m.code=786 GROUP BY ALL),
cd AS (SELECT st.recording, trial_index, count(m.code) AS code_count, min(m.code) AS c FROM st LEFT JOIN music_log m ON m.recording=st.recording AND m.code BETWEEN 301 AND 660
  AND m.onset BETWEEN coalesce(prev+12, 0) AND st.onset GROUP BY ALL)
SELECT recording, trial_index, onset, fixation_onset, next_fixation, code_count, CASE WHEN code_count=1 THEN c END AS stimulus_code,
 CASE WHEN fixation_onset IS NULL THEN 'no_fixation' WHEN code_count<>1 THEN 'stimulus_code_count' WHEN nxt IS NOT NULL AND (next_fixation IS NULL OR nxt<next_fixation) THEN 'overlapping_window' ELSE 'ok' END AS status
FROM st JOIN fx USING (recording, trial_index) JOIN cd USING (recording, trial_index)""")
def _(spark, d):
    return E.parse_onset_trials(music_log(spark, d))


def qa_log(spark, d):
    return V.table(spark, d, "conversations").selectExpr(
        "conv_id", "turn AS position",
        "case role when 'user' then 800 + length(text) % 8 when 'assistant' then 833 + length(text) % 9 else 0L end AS code",
        "turn div 100 AS chunk",
    )


view("qa_log", """SELECT conv_id, turn AS position, CASE role WHEN 'user' THEN 800+length(text)%8 WHEN 'assistant' THEN 833+length(text)%9 ELSE 0 END AS code FROM conversations""")
view("qa_pairs", """
WITH q AS (SELECT conv_id, code AS question, min(position) AS asked_at FROM qa_log WHERE code BETWEEN 800 AND 807 GROUP BY 1,2),
p AS (SELECT q.conv_id, question, asked_at, min(a.position) AS answered_at FROM q LEFT JOIN qa_log a ON a.conv_id=q.conv_id AND a.code BETWEEN 833 AND 841 AND a.position>asked_at GROUP BY 1,2,3),
c AS (SELECT *, count(*) OVER (PARTITION BY conv_id, answered_at) AS claims FROM p)
SELECT c.conv_id, question, asked_at, answered_at, a.code-832 AS rating,
  CASE WHEN answered_at IS NULL THEN 'unanswered' WHEN claims>1 THEN 'replaced_unanswered_question' ELSE 'paired' END AS status
FROM c LEFT JOIN qa_log a ON a.conv_id=c.conv_id AND a.position=c.answered_at
UNION ALL SELECT conv_id, NULL, NULL, position, code-832, 'answer_without_question' FROM qa_log a WHERE code BETWEEN 833 AND 841
  AND NOT EXISTS (SELECT 1 FROM c WHERE c.conv_id=a.conv_id AND c.answered_at=a.position)""")


@query("pair_question_response", "SELECT * FROM qa_pairs")
def _(spark, d):
    return E.pair_question_response(qa_log(spark, d), by=["conv_id"])


@query("questionnaire_status", """
SELECT conv_id, count_if(status='paired') AS ratings, count_if(status IN ('replaced_unanswered_question','answer_without_question')) AS violations,
  count_if(status='paired')=2 AND count_if(status IN ('replaced_unanswered_question','answer_without_question'))=0 AS complete FROM qa_pairs GROUP BY conv_id""")
def _(spark, d):
    return E.questionnaire_status(E.pair_question_response(qa_log(spark, d), by=["conv_id"]), by=["conv_id"], expected=2)


def labelled_log(spark, d):
    return V.event_log(spark, d).selectExpr(
        "recording", "onset", "sample", "kind", "concat('clip', k, '_', k % 4) AS label", "k", "day AS chunk"
    )


view("stim_trials", """
SELECT recording, row_number() OVER (PARTITION BY recording ORDER BY onset, sample) AS trial_index, 'clip'||k||'_'||k%4 AS event_label,
  'clip'||k AS stimulus_id, onset AS onset_samples, onset/250.0::DOUBLE AS onset_s FROM event_log WHERE kind='click'""")


@query("parse_stimulation_events", "SELECT recording, trial_index, event_label, stimulus_id, onset_samples, round(onset_s, 4) AS onset_s FROM stim_trials")
def _(spark, d):
    return E.parse_stimulation_events(labelled_log(spark, d), sampling_frequency=250.0, kind="click").withColumn("onset_s", F.round("onset_s", 4))


def behavior(spark, d):
    return V.trials(spark, d).filter("k % 4 <> 0").groupBy(F.expr("concat('clip', k)").alias("stimulus_id")).agg(F.max("user_id").alias("liking"))


view("behavior", "SELECT 'clip'||k AS stimulus_id, max(user_id) AS liking FROM trials WHERE k%4<>0 GROUP BY 1")


@query("attach_behavior", "SELECT recording, trial_index, stimulus_id, liking, liking IS NOT NULL AS label_available FROM stim_trials LEFT JOIN behavior USING (stimulus_id)")
def _(spark, d):
    s = E.parse_stimulation_events(labelled_log(spark, d), sampling_frequency=250.0, kind="click")
    return E.attach_behavior(s, behavior(spark, d), "stimulus_id").select("recording", "trial_index", "stimulus_id", "liking", "label_available")


@query("dedupe_dimension", "SELECT o_custkey, min(o_orderstatus) AS o_orderstatus, count(DISTINCT o_orderstatus)>1 AS conflict FROM orders GROUP BY 1")
def _(spark, d):
    return E.dedupe_dimension(V.table(spark, d, "orders").select("o_custkey", "o_orderstatus"), "o_custkey")


@query("align_behavior_codes", """
WITH s AS (SELECT conv_id AS subject, 'c'||turn%2 AS context, turn+1 AS code, turn AS position FROM conversations),
b AS (SELECT subject, code, position % 9 AS score FROM s WHERE NOT (subject%3=0 AND code=1) UNION ALL SELECT subject, 1, 0 FROM s WHERE subject%3=1 AND code=2),
u AS (SELECT subject, count(*)=count(DISTINCT code) AND count(*)=(SELECT count(*) FROM s x WHERE x.subject=b.subject) AS usable FROM b GROUP BY subject)
SELECT s.subject, context, s.code, s.position, CASE WHEN usable THEN score END AS score, coalesce(usable,false) AS label_available,
 CASE WHEN usable THEN 'verified_global_stimulus_code' ELSE 'source_stimulus_code_unusable' END AS label_alignment_status,
 CAST(row_number() OVER (PARTITION BY s.subject, context ORDER BY s.position, s.code) AS INT) AS trial_index
FROM s LEFT JOIN u USING (subject) LEFT JOIN (SELECT subject, code, any_value(score) AS score FROM b GROUP BY 1,2) USING (subject, code)""")
def _(spark, d):
    s = V.table(spark, d, "conversations").selectExpr("conv_id AS subject", "concat('c', turn % 2) AS context", "turn + 1 AS code", "turn AS position")
    b = s.filter("not (subject % 3 = 0 and code = 1)").selectExpr("subject", "concat('clip ', code, '.mp4 ') AS code_text", "position % 9 AS score")
    extra = s.filter("subject % 3 = 1 and code = 2").selectExpr("subject", "'clip 1' AS code_text", "0L AS score")
    return E.align_behavior_codes(b.unionByName(extra), s)


def prompted_log(spark, d):
    """Four log rows per event; some users' rows are damaged so that their recording is rejected."""
    e = V.trials(spark, d)
    rows = e.selectExpr("*", "explode(array(0, 1, 2, 3)) AS j", "if(k % 2 = 0, 'SAM-valence', 'SAM-arousal') AS s")
    rows = rows.filter("not (user_id % 5 = 1 and event_id % 97 = 0 and j = 2)")
    return rows.selectExpr(
        "subject_uid AS recording", "event_id * 4 + j AS line", "event_id * 10D + element_at(array(0D, 1D, if(user_id % 5 = 2 and event_id % 89 = 0, 5D, 4D), 6D), j + 1) AS onset",
        """case j when 0 then concat('event:anchorsPresented;scale:', s) when 1 then concat('event:presentedStimulus;stimulus:', stimulus_uid)
             when 2 then concat('event:scalePresented;stimulus:', stimulus_uid, ';scale:', s)
             else concat('event:optionConfirmed;stimulus:', stimulus_uid, ';scale:', s, ';response:', if(user_id % 5 = 3 and k = 7, 9.5D, 1 + k % 9)) end AS value""",
        "event_id div 1000 AS chunk", "event_id", "user_id", "k", "s",
    )


view("prompted_bad", """
SELECT subject_uid AS recording FROM trials WHERE (user_id%5=1 AND event_id%97=0) OR (user_id%5=2 AND event_id%89=0) OR (user_id%5=3 AND k=7) GROUP BY 1""")


@query("parse_prompted_responses", """
SELECT subject_uid||':'||(event_id*4+1) AS trial_uid, subject_uid AS recording, stimulus_uid, CASE WHEN k%2=0 THEN 'SAM-valence' ELSE 'SAM-arousal' END AS context,
 CASE WHEN k%2=0 THEN 'valence' ELSE 'arousal' END AS target_name, (1+k%9)::DOUBLE AS rating_raw, (9-(1+k%9))::DOUBLE/8 AS rating_normalized,
 event_id*10.0::DOUBLE+1 AS onset_s, 3.0::DOUBLE AS duration_s, event_id*10.0::DOUBLE+6 AS response_onset_s
FROM trials WHERE subject_uid NOT IN (SELECT recording FROM prompted_bad)""")
def _(spark, d):
    return E.parse_prompted_responses(prompted_log(spark, d))


@query("rejected_recordings", """
SELECT recording, CASE user_id%5 WHEN 1 THEN 'response_before_scale' WHEN 2 THEN 'bad_duration' ELSE 'bad_rating' END AS first_fault
FROM prompted_bad JOIN (SELECT DISTINCT subject_uid AS recording, user_id FROM trials) USING (recording)""")
def _(spark, d):
    return E.rejected_recordings(E.prompted_chain(prompted_log(spark, d))).select("recording", "first_fault")


@query("parse_key_value_events", """
SELECT event_id, event_id%11<>0 AND event_id%13<>0 AS valid, CASE WHEN event_id%11<>0 AND event_id%13<>0 THEN event_type END AS event,
  CASE WHEN event_id%11<>0 AND event_id%13<>0 THEN CAST(json_extract(props,'$.k') AS VARCHAR) END AS scale FROM events""")
def _(spark, d):
    t = V.trials(spark, d).selectExpr(
        "event_id", "concat('event: ', context, ';scale:', k, if(event_id % 11 = 0, ';event:again', ''), if(event_id % 13 = 0, ';loose', '')) AS value"
    )
    return E.parse_key_value_events(t).selectExpr("event_id", "valid", "fields['event'] AS event", "fields['scale'] AS scale")


@query("join_dimensions", """
SELECT trial_uid, mean_value, round(mean_value,6)*0 + n AS n FROM (SELECT trial_uid, stimulus_uid, subject_uid FROM trials)
JOIN (SELECT stimulus_uid, round(avg(value),6) AS mean_value FROM trials GROUP BY 1) USING (stimulus_uid) JOIN (SELECT subject_uid, count(*)::DOUBLE AS n FROM trials GROUP BY 1) USING (subject_uid)""")
def _(spark, d):
    t = V.trials(spark, d)
    normative = t.groupBy("stimulus_uid").agg(F.round(F.avg("value"), 6).alias("mean_value"))
    people = t.groupBy("subject_uid").agg(F.count(F.lit(1)).cast("double").alias("n"))
    out = E.join_dimensions(t.select("trial_uid", "stimulus_uid", "subject_uid"), {"stimulus_uid": normative, "subject_uid": people})
    return out.select("trial_uid", "mean_value", "n")


@query("rating_residuals", "SELECT trial_uid, round(target_valence-k/99.0::DOUBLE,6) AS residual_valence, round(target_arousal-0.5::DOUBLE,6) AS residual_arousal FROM trials")
def _(spark, d):
    t = V.trials(spark, d).selectExpr(
        "trial_uid", "target_valence AS self_valence", "target_arousal AS self_arousal", "k / 99D AS normative_valence", "0.5D AS normative_arousal"
    )
    out = E.rating_residuals(t, ["valence", "arousal"])
    return out.selectExpr("trial_uid", "round(residual_valence, 6) AS residual_valence", "round(residual_arousal, 6) AS residual_arousal")


@query("harmonize_targets", """
WITH t AS (SELECT trial_uid, user_id%4 AS g, (1+k%9)::DOUBLE AS v, (k%12)::DOUBLE AS a, label_available FROM trials),
h AS (SELECT *, CASE WHEN g=2 THEN v/7 ELSE (v-1)/8 END AS hv, CASE WHEN g=2 THEN a/7 ELSE (a-1)/8 END AS ha FROM t)
SELECT trial_uid, CASE WHEN g=2 THEN '0-7' ELSE '1-9' END AS target_scale, round(hv,6) AS target_valence, round(ha,6) AS target_arousal,
  CASE WHEN g=0 THEN round((a-1)/8,6) END AS stimulus_prior_valence, label_available AND hv BETWEEN 0 AND 1 AND ha BETWEEN 0 AND 1 AS target_available FROM h""")
def _(spark, d):
    t = V.trials(spark, d).selectExpr(
        "trial_uid", "element_at(array('ds002721','ds003751','ds005540','ds006866'), cast(user_id % 4 + 1 as int)) AS dataset_id",
        "cast(1 + k % 9 as string) AS self_pleasant", "cast(k % 12 as string) AS self_energetic", "k % 12 AS normative_pleasant",
        "1 + k % 9 AS self_valence", "k % 12 AS self_arousal", "1 + k % 9 AS valence", "k % 12 AS arousal", "label_available",
    )
    out = E.harmonize_targets(t)
    return out.selectExpr("trial_uid", "target_scale", *[f"round({c}, 6) AS {c}" for c in ("target_valence", "target_arousal", "stimulus_prior_valence")], "target_available")


@query("condition_family", "SELECT trial_uid, context||'_m'||k%2 AS condition_family FROM trials")
def _(spark, d):
    t = V.trials(spark, d).selectExpr("trial_uid", "context AS nominal_valence", "concat('m', k % 2) AS regulation")
    return E.condition_family(t).select("trial_uid", "condition_family")


@query("event_participant_coverage", """
SELECT 'u'||u AS recording, CASE WHEN u IN (SELECT user_id FROM events) THEN 'unexpected' ELSE 'missing' END AS status FROM (
 (SELECT DISTINCT user_id AS u FROM events WHERE user_id % 10 = 0) UNION (SELECT DISTINCT c_custkey FROM customer WHERE c_custkey % 10 <> 0 AND c_custkey NOT IN (SELECT user_id FROM events))
 UNION (SELECT DISTINCT user_id FROM events WHERE user_id NOT IN (SELECT c_custkey FROM customer)))""")
def _(spark, d):
    people = V.table(spark, d, "customer").filter("c_custkey % 10 <> 0").selectExpr("concat('u', c_custkey) AS recording")
    return E.event_participant_coverage(V.event_log(spark, d), people)


@query("trial_audit", """
WITH t AS (SELECT *, CASE WHEN k%7=0 THEN 1 ELSE 0 END AS fix FROM trials_multi),
b AS (SELECT dataset_id, count(*) a1, count(DISTINCT subject_uid) a2, count(DISTINCT stimulus_uid) a3, count_if(label_available) a4, count_if(NOT label_available) a5,
  min(value) a6, max(value) a7, count_if(fix=1) a8 FROM t GROUP BY 1)
SELECT dataset_id, unnest(['trial_count','subject_count','stimulus_count','labelled_count','unlabelled_count','rating_min','rating_max','corrected_count']) AS metric,
  CAST(NULL AS VARCHAR) AS item, unnest([a1::DOUBLE,a2,a3,a4,a5,a6,a7,a8]) AS value FROM b
UNION ALL SELECT dataset_id, 'repeated_pair_rows', NULL, sum(n)::DOUBLE FROM (SELECT dataset_id, count(*) AS n FROM t GROUP BY dataset_id, subject_uid, stimulus_uid HAVING count(*)>1) GROUP BY 1
UNION ALL SELECT dataset_id, 'condition_count', context, count(*)::DOUBLE FROM t GROUP BY 1,3
UNION ALL SELECT dataset_id, 'off_nominal_subject', subject_uid, count(*)::DOUBLE FROM t GROUP BY 1,3 HAVING count(*)<>66""")
def _(spark, d):
    t = V.trials_multi(spark, d).selectExpr("*", "value AS rating", "if(k % 7 = 0, 'corrected_from_cue', 'verified') AS alignment_status")
    return E.trial_audit(t, nominal_trials=66)


@query("duplicate_lineage", """
SELECT trial_uid, subject_uid, stimulus_uid, context, copies FROM (SELECT *, count(*) OVER (PARTITION BY subject_uid, stimulus_uid, context) AS copies FROM trials) WHERE copies>1""")
def _(spark, d):
    out = E.duplicate_lineage(V.trials(spark, d), ["subject_uid", "stimulus_uid", "context"])
    return out.select("trial_uid", "subject_uid", "stimulus_uid", "context", "copies")


@query("dataset_scope", """
WITH x AS (SELECT *, CASE WHEN dataset_id='d2' THEN 'extended' ELSE 'core' END AS tier FROM trials_multi),
p AS (SELECT tier, dataset_id, count(DISTINCT subject_uid) AS participant_count, count(*) AS trial_count,
  CASE WHEN dataset_id<>'d2' THEN count(DISTINCT stimulus_uid) END AS stimulus_count, count_if(label_available) AS labelled_count FROM x GROUP BY tier, dataset_id)
SELECT tier, dataset_id, count(*) AS dataset_count, CAST(sum(participant_count) AS BIGINT) AS participant_count, CAST(sum(trial_count) AS BIGINT) AS trial_count,
 CASE WHEN count(stimulus_count)=count(*) THEN CAST(sum(stimulus_count) AS BIGINT) END AS stimulus_count, CAST(sum(labelled_count) AS BIGINT) AS labelled_count
FROM p GROUP BY GROUPING SETS ((tier, dataset_id),(tier),())""")
def _(spark, d):
    t = V.trials_multi(spark, d).withColumn("tier", F.expr("if(dataset_id = 'd2', 'extended', 'core')"))
    return E.dataset_scope(t.withColumn("stimulus_uid", F.expr("if(dataset_id = 'd2', null, stimulus_uid)")))


@query("sample_bounds", """
WITH t AS (SELECT trial_uid, event_id+1 AS s1, value/100 AS dur, event_id/500.0::DOUBLE AS ons, 500+(k-50)/1000.0::DOUBLE AS mr FROM trials)
SELECT trial_uid, s1-1 AS start, s1-1+CAST(round_even(dur*500.0::DOUBLE,0) AS BIGINT) AS stop, round(abs(mr-500)/500*1000000,3) AS drift_ppm,
 abs(s1-1-CAST(round_even(ons*500.0::DOUBLE,0) AS BIGINT)) AS onset_discrepancy, abs(mr-500)/500*1000000>50 AS drift_exceeded,
 s1-1<0 OR round_even(dur*500.0::DOUBLE,0)<=0 OR s1-1+round_even(dur*500.0::DOUBLE,0)>(SELECT count(*) FROM events) AS out_of_range FROM t""")
def _(spark, d):
    t = V.trials(spark, d)
    n = t.agg(F.count(F.lit(1)).alias("available_samples"))
    t = t.selectExpr("trial_uid", "event_id + 1 AS sample_1based", "value / 100 AS duration_s", "event_id / 500D AS onset_s", "500 + (k - 50) / 1000D AS measured_rate")
    out = E.sample_bounds(t.crossJoin(n), nominal_rate=500.0)
    return out.selectExpr("trial_uid", "start", "stop", "round(drift_ppm, 3) AS drift_ppm", "onset_discrepancy", "drift_exceeded", "out_of_range")


TOKENS = "['joy4','ins5','ten8','sad4','fear5','dis8','neu4','bad9']"


@query("map_stimulus_codes", f"""
WITH t AS (SELECT trial_uid, ({TOKENS})[k%8+1] AS token, k, user_id%2=1 AS sc FROM trials),
m AS (SELECT *, CASE token WHEN 'joy4' THEN 1 WHEN 'ins5' THEN 5 WHEN 'ten8' THEN 9 WHEN 'sad4' THEN 10 WHEN 'fear5' THEN 14 WHEN 'dis8' THEN 18 WHEN 'neu4' THEN 19 END AS mn FROM t)
SELECT trial_uid, mn AS material_number, mn + CASE WHEN sc THEN 21 ELSE 0 END AS global_code, k AS parsed_code, k BETWEEN 1 AND 42 AS code_valid FROM m""")
def _(spark, d):
    t = V.trials(spark, d).selectExpr(
        "trial_uid", f"element_at(array({TOKENS[1:-1]}), cast(k % 8 + 1 as int)) AS token", "user_id % 2 = 1 AS second_context", "concat('video ', k, '.avi') AS code_text"
    )
    return E.map_stimulus_codes(t).select("trial_uid", "material_number", "global_code", "parsed_code", "code_valid")


@query("complete_frames", "SELECT doc_id, n_chars//(16*4) AS frames, n_chars%(16*4) AS leftover_bytes FROM documents")
def _(spark, d):
    files = V.table(spark, d, "documents").selectExpr("doc_id", "n_chars AS bytes", "16L AS channels")
    return E.complete_frames(files).select("doc_id", "frames", "leftover_bytes")


@query("build_trial_table", """
SELECT 'dx:'||recording||':trial-'||CASE WHEN trial_index<10 THEN '0'||trial_index ELSE ''||trial_index END AS trial_uid, 'dx:'||recording AS subject_uid, 'stim-'||stimulus_id AS stimulus_uid,
  liking, liking IS NOT NULL AS label_available, grp FROM stim_trials LEFT JOIN behavior USING (stimulus_id)
  JOIN (SELECT DISTINCT 'u'||user_id AS recording, user_id%7 AS grp FROM events) USING (recording)""")
def _(spark, d):
    people = V.trials(spark, d).selectExpr("subject_uid AS recording", "user_id % 7 AS grp")
    out = E.build_trial_table(labelled_log(spark, d), behavior(spark, d), people, dataset_id="dx", sampling_frequency=250.0, kind="click")
    return out.select("trial_uid", "subject_uid", "stimulus_uid", "liking", "label_available", "grp")
