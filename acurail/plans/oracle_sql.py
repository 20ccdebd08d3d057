"""Independent DuckDB SQL statements of each query (the correctness oracle).

These are written directly in SQL from the reference semantics rather than
generated from the Spark rule tables, so a mistake in one side shows up as a
mismatch. ``fmtN(x)`` produce Python-compatible fixed-point text
(``format('{:.Nf}')`` rounds the exact binary value like Python does).
"""

from __future__ import annotations

import re

from acurail import constants as const  # the fixed texts of the review prompt only

# FIXED VALUES: FIXTURES.md section 1, the encounter view, verbatim.
ENCOUNTERS_SQL = """
SELECT e.event_id, concat('P', lpad(CAST(e.event_id AS VARCHAR(12)), 8, '0')) AS patient_id,
  concat('R', CAST(e.user_id % 10 AS VARCHAR(12))) AS run_id, e.ts AS arrival_ts,
  CAST(1 + (e.event_id*11 + CASE WHEN e.event_id % 4 = 0 THEN 1 ELSE 0 END) % 5 AS INT) AS triage_acuity,
  CASE WHEN e.event_id % 23 = 5 THEN NULL ELSE CAST(1 + (e.event_id*31) % 97 AS INT) END AS age,
  CASE WHEN e.event_id % 2 = 0 THEN 'M' ELSE 'F' END AS sex,
  CASE WHEN (e.event_id*3+1) % 7 = 0 THEN 'verbal' WHEN e.event_id % 29 = 0 THEN '' ELSE 'alert' END AS mental_status_triage,
  CASE WHEN e.event_id % 53 = 7 THEN CAST(148 AS DOUBLE) WHEN e.event_id % 61 = 4 THEN CAST(118 AS DOUBLE) WHEN e.event_id % 19 = 1 THEN NULL WHEN (e.event_id*13+3) % 7 = 0 THEN CAST(25 + (e.event_id*37) % 170 AS DOUBLE) ELSE CAST(65 + (e.event_id*37) % 50 AS DOUBLE) END AS heart_rate,
  CASE WHEN e.event_id % 53 = 7 THEN CAST(96 AS DOUBLE) WHEN e.event_id % 59 = 3 THEN CAST(82 AS DOUBLE) WHEN e.event_id % 19 = 2 THEN NULL WHEN (e.event_id*17+1) % 11 = 0 THEN CAST(50 + (e.event_id*53) % 151 AS DOUBLE) ELSE CAST(95 + (e.event_id*53) % 60 AS DOUBLE) END AS systolic_bp,
  CAST(50 + (e.event_id*43) % 45 AS DOUBLE) AS diastolic_bp,
  CASE WHEN e.event_id % 61 = 4 THEN CAST(24 AS DOUBLE) WHEN e.event_id % 19 = 3 THEN NULL WHEN (e.event_id*5+2) % 13 = 0 THEN CAST(6 + (e.event_id*41) % 37 AS DOUBLE) ELSE CAST(11 + (e.event_id*41) % 14 AS DOUBLE) END AS respiratory_rate,
  CASE WHEN e.event_id % 61 = 4 THEN CAST(389 AS DOUBLE)/10 WHEN e.event_id % 19 = 4 THEN NULL WHEN (e.event_id*19+4) % 17 = 0 THEN CAST(310 + (e.event_id*29) % 103 AS DOUBLE)/10 ELSE CAST(362 + (e.event_id*29) % 28 AS DOUBLE)/10 END AS temperature_c,
  CASE WHEN e.event_id % 59 = 3 THEN CAST(90 AS DOUBLE) WHEN e.event_id % 19 = 5 THEN NULL WHEN (e.event_id*23+6) % 9 = 0 THEN CAST(82 + (e.event_id*47) % 14 AS DOUBLE) ELSE CAST(94 + (e.event_id*47) % 7 AS DOUBLE) END AS spo2,
  CASE WHEN e.event_id % 19 = 6 THEN NULL WHEN (e.event_id*7+5) % 16 = 0 THEN CAST(3 + (e.event_id*59) % 12 AS INT) ELSE 15 END AS gcs_total,
  CAST((e.event_id*61) % 11 AS INT) AS pain_score,
  CASE WHEN e.event_id % 19 = 7 THEN NULL WHEN (e.event_id*67+8) % 8 = 0 THEN CAST((e.event_id*71) % 17 AS INT) ELSE CAST((e.event_id*71) % 4 AS INT) END AS news2_score,
  CAST(CASE WHEN (e.event_id*73) % 12 = 0 THEN 1 ELSE 0 END AS INT) AS hx_heart_failure,
  CAST(CASE WHEN (e.event_id*79) % 14 = 3 THEN 1 ELSE 0 END AS INT) AS hx_copd,
  CASE WHEN e.event_id % 31 = 0 THEN NULL ELSE CAST(CASE WHEN (e.event_id*83) % 15 = 4 THEN 1 ELSE 0 END AS INT) END AS hx_dementia,
  CAST(CASE WHEN (e.event_id*89) % 4 = 1 THEN 1 ELSE 0 END AS INT) AS hx_hypertension,
  c.txt AS chief_complaint_raw,
  w.w1/w.t AS p1, w.w2/w.t AS p2, w.w3/w.t AS p3, w.w4/w.t AS p4, w.w5/w.t AS p5
FROM events e
JOIN (SELECT event_id, CAST(w1 AS DOUBLE) w1, CAST(w2 AS DOUBLE) w2, CAST(w3 AS DOUBLE) w3, CAST(w4 AS DOUBLE) w4, CAST(w5 AS DOUBLE) w5, CAST(w1+w2+w3+w4+w5 AS DOUBLE) t FROM (
  SELECT event_id,
   CASE WHEN event_id%13=0 THEN 1 ELSE 1+(event_id*3)%9 END + CASE WHEN (event_id*11)%5=0 THEN 28+(event_id*17)%60 ELSE 0 END + CASE WHEN event_id%13=0 AND (event_id*11+1)%5=0 THEN 22+(event_id*17)%60 ELSE 0 END w1,
   CASE WHEN event_id%13=0 THEN 1 ELSE 1+(event_id*5)%9 END + CASE WHEN (event_id*11)%5=1 THEN 28+(event_id*17)%60 ELSE 0 END + CASE WHEN event_id%13=0 AND (event_id*11+1)%5=1 THEN 22+(event_id*17)%60 ELSE 0 END w2,
   CASE WHEN event_id%13=0 THEN 1 ELSE 1+(event_id*7)%11 END + CASE WHEN (event_id*11)%5=2 THEN 28+(event_id*17)%60 ELSE 0 END + CASE WHEN event_id%13=0 AND (event_id*11+1)%5=2 THEN 22+(event_id*17)%60 ELSE 0 END w3,
   CASE WHEN event_id%13=0 THEN 1 ELSE 1+(event_id*2)%11 END + CASE WHEN (event_id*11)%5=3 THEN 28+(event_id*17)%60 ELSE 0 END + CASE WHEN event_id%13=0 AND (event_id*11+1)%5=3 THEN 22+(event_id*17)%60 ELSE 0 END w4,
   CASE WHEN event_id%13=0 THEN 1 ELSE 1+(event_id*4)%13 END + CASE WHEN (event_id*11)%5=4 THEN 28+(event_id*17)%60 ELSE 0 END + CASE WHEN event_id%13=0 AND (event_id*11+1)%5=4 THEN 22+(event_id*17)%60 ELSE 0 END w5
  FROM events) q) w ON w.event_id = e.event_id
JOIN (VALUES (0,'Cardiac arrest witnessed by family'),(1,'chest pain with diaphoresis'),(2,'acute stroke symptoms'),(3,'abdominal pain'),(4,'fracture with deformity'),(5,'laceration'),(6,'mild headache'),(7,'sprained ankle'),(8,'prescription refill request'),(9,'mild sore throat'),(10,'cold symptoms'),(11,' Follow-up after discharge '),(12,'syncope'),(13,'feeling unwell'),(14,'suspected drug overdose'),(15,'ear pain'),(16,'acute back pain with radiation'),(17,''),(18,'moderate pain'),(19,'insect bite'),(20,'lower back pain'),(21,'itchy skin'),(22,'knee swelling')) AS c(i, txt) ON c.i = (e.event_id*97+5) % 23
"""

# FIXED VALUES: FIXTURES.md section 2, the message timestamps view.
MESSAGES_SQL = """
SELECT patient_id, run_id, event_id, CAST(t0 AS DOUBLE)/1000 AS produced_at, CAST(t1 AS DOUBLE)/1000 AS consumer_received_at,
  CAST(t2 AS DOUBLE)/1000 AS ml_done_at, CAST(t3 AS DOUBLE)/1000 AS safety_done_at,
  CASE WHEN event_id % 3 = 0 AND event_id % 6 <> 0 THEN CAST(t3 + 2 AS DOUBLE)/1000 END AS enrichment_requested_at,
  CASE WHEN event_id % 3 = 0 THEN CAST(t3 + 502 + (event_id*37) % 1500 AS DOUBLE)/1000 END AS explained_at
FROM (SELECT *, t2 + (event_id*31) % 3 AS t3 FROM (SELECT *, t1 + 20 + (event_id*29) % 45 AS t2 FROM (
  SELECT *, t0 + 50 + (event_id*13) % 260 AS t1 FROM (SELECT patient_id, run_id, event_id, event_id*1500 + (event_id*7) % 400 AS t0 FROM encounters) a) b) c) d
"""

COMPLAINTS_SQL = """
SELECT patient_id, chief_complaint_raw, CAST(0 AS INT) AS ord FROM encounters WHERE event_id % 17 <> 0
UNION ALL
SELECT patient_id, concat(chief_complaint_raw, ' (repeat)'), CAST(1 AS INT) FROM encounters WHERE event_id % 10 = 0
"""

RAW_TARGET_SQL = """
SELECT patient_id, CASE WHEN event_id % 37 = 0 THEN 'x' WHEN event_id % 41 = 0 THEN '7' WHEN event_id % 43 = 0 THEN '2.5'
  WHEN event_id % 47 = 0 THEN NULL ELSE CAST(triage_acuity AS VARCHAR(4)) END AS triage_acuity_raw FROM encounters
"""

ACTIONS_SQL = """
SELECT patient_id, CASE WHEN event_id % 5 = 0 THEN 'override' ELSE 'accept' END AS action,
  CASE WHEN event_id % 5 = 0 THEN CAST(1 + (event_id*7) % 5 AS INT) END AS override_acuity,
  CASE WHEN event_id % 25 = 0 THEN '  ' WHEN event_id % 5 = 0 THEN 'clinical judgement' END AS override_reason
FROM encounters WHERE event_id % 5 <> 4
"""


def fmt(x: str, n: int) -> str:
    return f"format('{{:.{n}f}}', CAST({x} AS DOUBLE))"


def rnd(x: str, n: int) -> str:
    return f"CAST({fmt(x, n)} AS DOUBLE)"


def pct(x: str) -> str:
    return f"({fmt(f'({x})*100', 1)} || '%')"


def _first_kw(col: str, kws: list[str]) -> str:
    return "CASE " + " ".join(f"WHEN contains({col}, '{k}') THEN '{k}'" for k in kws) + " END"


# FIXED VALUES: keyword lists (declared order), repeated here so the oracle
# does not import the Spark rule tables.
_CRIT = ["cardiac arrest", "not breathing", "unresponsive", "pulseless", "anaphylactic shock",
         "anaphylaxis", "status epilepticus", "massive haemorrhage", "massive hemorrhage", "choking",
         "respiratory arrest", "hanging", "drowning"]
_HIGH = ["chest pain", "stroke", "acute stroke", "altered mental status", "severe dyspnoea",
         "severe dyspnea", "difficulty breathing", "severe allergic reaction", "overdose",
         "drug overdose", "septic shock", "sepsis", "meningitis", "aortic dissection",
         "pulmonary embolism", "active seizure", "eclampsia"]
_BENIGN = ["sore throat", "prescription refill", "cold symptoms", "minor rash", "routine wound check",
           "follow-up", "ear pain", "mild headache", "sprained ankle", "insect bite", "cold", "flu"]


def _label(x: str) -> str:
    return (f"CASE {x} WHEN 1 THEN 'KTAS 1 – Resuscitation' WHEN 2 THEN 'KTAS 2 – Emergent' "
            f"WHEN 3 THEN 'KTAS 3 – Urgent' WHEN 4 THEN 'KTAS 4 – Less Urgent' "
            f"WHEN 5 THEN 'KTAS 5 – Non-Urgent' END")


def _color(x: str) -> str:
    return (f"CASE {x} WHEN 1 THEN '#E24B4A' WHEN 2 THEN '#EF9F27' WHEN 3 THEN '#378ADD' "
            f"WHEN 4 THEN '#639922' WHEN 5 THEN '#888780' END")


def _nn_list(*items: str) -> str:
    return f"list_filter([{', '.join(items)}], lambda x: x IS NOT NULL)"


# Decision pipeline as chained CTEs over `encounters`; the final CTE is `dec`.
DECISION_CTES = f"""
v AS (
  SELECT e.*, lower(coalesce(chief_complaint_raw, '')) AS cc, lower(coalesce(mental_status_triage, 'none')) AS ms,
    heart_rate AS hr, systolic_bp AS sbp, spo2 AS sp, respiratory_rate AS rr, temperature_c AS tc,
    CAST(gcs_total AS DOUBLE) AS gcs, CAST(pain_score AS DOUBLE) AS pain, CAST(news2_score AS DOUBLE) AS nw,
    CAST(age AS DOUBLE) AS agey
  FROM encounters e),
ranked AS (
  SELECT patient_id, cls, p, row_number() OVER (PARTITION BY patient_id ORDER BY p DESC, cls) AS rk
  FROM (SELECT patient_id, unnest([1, 2, 3, 4, 5]) AS cls, unnest([p1, p2, p3, p4, p5]) AS p FROM encounters) u),
top2 AS (
  SELECT patient_id, max(CASE WHEN rk = 1 THEN cls END) AS c1, max(CASE WHEN rk = 1 THEN p END) AS s1,
         max(CASE WHEN rk = 2 THEN cls END) AS c2, max(CASE WHEN rk = 2 THEN p END) AS s2
  FROM ranked WHERE rk <= 2 GROUP BY patient_id),
k AS (
  SELECT v.*, t.c1, t.s1, t.c2, t.s2, CAST(t.c1 AS INT) AS orig,
    {_first_kw('cc', _CRIT)} AS kw1, {_first_kw('cc', _HIGH)} AS kw2, {_first_kw('cc', _BENIGN)} AS kwb
  FROM v JOIN top2 t USING (patient_id)),
ra AS (
  SELECT k.*,
    CASE WHEN gcs <= 8 THEN 'GCS ' || {fmt('gcs', 0)} || ' ≤ 8 → KTAS-1 floor' END AS a1,
    CASE WHEN sp < 88 THEN 'SpO2 ' || {fmt('sp', 1)} || '% < 88% → KTAS-1 floor' END AS a2,
    CASE WHEN sbp < 70 THEN 'SBP ' || {fmt('sbp', 0)} || ' mmHg < 70 → KTAS-1 floor' END AS a3,
    CASE WHEN hr > 180 THEN 'HR ' || {fmt('hr', 0)} || ' bpm > 180 → KTAS-1 floor' END AS a4,
    CASE WHEN hr < 30 THEN 'HR ' || {fmt('hr', 0)} || ' bpm < 30 → KTAS-1 floor' END AS a5,
    CASE WHEN rr > 36 THEN 'RR ' || {fmt('rr', 0)} || '/min > 36 → KTAS-1 floor' END AS a6,
    CASE WHEN tc < 32 THEN 'Temp ' || {fmt('tc', 1)} || '°C < 32 → KTAS-1 floor (severe hypothermia)' END AS a7,
    CASE WHEN kw1 IS NOT NULL THEN 'Complaint keyword ''' || kw1 || ''' → KTAS-1 floor' END AS a8,
    CASE
      WHEN sp >= 88 AND sp < 92 THEN 'SpO2 ' || {fmt('sp', 1)} || '% (88–92%) → KTAS-2 floor'
      WHEN sbp >= 70 AND sbp < 90 THEN 'SBP ' || {fmt('sbp', 0)} || ' mmHg (70–90) → KTAS-2 floor'
      WHEN hr > 150 AND hr <= 180 THEN 'HR ' || {fmt('hr', 0)} || ' bpm (150–180) → KTAS-2 floor'
      WHEN hr >= 30 AND hr < 40 THEN 'HR ' || {fmt('hr', 0)} || ' bpm (30–40, severe bradycardia) → KTAS-2 floor'
      WHEN gcs >= 9 AND gcs <= 12 THEN 'GCS ' || {fmt('gcs', 0)} || ' (9–12) → KTAS-2 floor'
      WHEN tc > 40 THEN 'Temp ' || {fmt('tc', 1)} || '°C > 40 → KTAS-2 floor (hyperpyrexia)'
      WHEN nw >= 7 THEN 'NEWS2 ' || {fmt('nw', 0)} || ' ≥ 7 → KTAS-2 floor (high risk)'
      WHEN kw2 IS NOT NULL THEN 'Complaint keyword ''' || kw2 || ''' → KTAS-2 floor'
      WHEN tc > 38.3 AND hr > 100 AND rr > 20 THEN 'Sepsis triad (temp ' || {fmt('tc', 1)} || '°C, HR ' || {fmt('hr', 0)} || ', RR ' || {fmt('rr', 0)} || ') → KTAS-2 floor'
      WHEN sbp > 0 AND hr / sbp > 1.5 THEN 'Shock index ' || {fmt('hr / sbp', 2)} || ' > 1.5 (HR/SBP) → KTAS-2 floor'
      WHEN agey >= 75 AND ms NOT IN ('', 'alert') AND tc > 38.0 THEN 'Elderly (' || {fmt('agey', 0)} || 'y) + altered mental status + fever → KTAS-2 floor'
    END AS b_any,
    CASE WHEN sp < 94 AND sbp < 90 THEN 'Combined hypoxia (SpO2 ' || {fmt('sp', 1)} || '%) + hypotension (SBP ' || {fmt('sbp', 0)} || ') → KTAS-1 floor' END AS combo_any
  FROM k),
rb AS (
  SELECT ra.*, coalesce(a1, a2, a3, a4, a5, a6, a7, a8) IS NOT NULL AS any_a FROM ra),
rc AS (
  SELECT rb.*,
    CASE WHEN NOT any_a AND orig > 2 THEN b_any END AS bsel,
    CASE WHEN NOT any_a AND orig > 1 THEN combo_any END AS csel
  FROM rb),
rails AS (
  SELECT rc.*,
    {_nn_list('a1', 'a2', 'a3', 'a4', 'a5', 'a6', 'a7', 'a8', 'bsel', 'csel')} AS rail_list,
    CAST(CASE WHEN any_a OR csel IS NOT NULL THEN 1 WHEN bsel IS NOT NULL THEN 2 ELSE orig END AS INT) AS rail_acuity
  FROM rc),
rails2 AS (
  SELECT rails.*, len(rail_list) > 0 AS trig,
    CASE WHEN len(rail_list) = 0 THEN NULL
         WHEN rail_acuity <> orig THEN 'Safety rails escalated KTAS-' || orig || ' → KTAS-' || rail_acuity || ': ' || array_to_string(rail_list, '; ')
         ELSE 'Safety rails confirmed KTAS-' || rail_acuity || ' (no escalation needed): ' || array_to_string(rail_list, '; ') END AS rail_note
  FROM rails),
conf AS (
  SELECT rails2.*, s1 - s2 AS gap,
    CASE WHEN s1 >= 0.65 AND s1 - s2 >= 0.15 THEN 'HIGH'
         WHEN s1 >= 0.50 AND s1 - s2 >= 0.10 THEN 'MODERATE'
         WHEN s1 >= 0.50 THEN 'AMBIGUOUS' ELSE 'LOW' END AS cstate
  FROM rails2),
conf2 AS (
  SELECT conf.*,
    CAST(CASE WHEN cstate = 'AMBIGUOUS' AND least(c1, c2) < rail_acuity THEN least(c1, c2)
              WHEN cstate = 'LOW' THEN greatest(1, rail_acuity - 1) ELSE rail_acuity END AS INT) AS conf_acuity,
    CASE WHEN cstate = 'AMBIGUOUS' AND least(c1, c2) < rail_acuity
           THEN 'AMBIGUOUS: KTAS-' || c1 || ' (' || {fmt('s1*100', 1)} || '%) vs KTAS-' || c2 || ' (' || {fmt('s2*100', 1)} || '%), gap=' || {fmt('gap', 3)} || ' — escalated to KTAS-' || least(c1, c2)
         WHEN cstate = 'AMBIGUOUS'
           THEN 'AMBIGUOUS: gap=' || {fmt('gap', 3)} || ' between KTAS-' || c1 || ' and KTAS-' || c2 || ' — conservative choice already active'
         WHEN cstate = 'LOW'
           THEN 'LOW confidence (' || {fmt('s1*100', 1)} || '%) — escalated KTAS-' || rail_acuity || ' → KTAS-' || greatest(1, rail_acuity - 1) || ', flagged for review'
         ELSE cstate || ' confidence (' || {fmt('s1*100', 1)} || '%, gap=' || {fmt('gap', 3)} || ') — prediction stands' END AS conf_note
  FROM conf),
cf AS (
  SELECT conf2.*,
    CASE WHEN sp < 92 AND orig >= 3 THEN '[V] SpO2=' || {fmt('sp', 1)} || '% indicates ≤KTAS-2 but model → KTAS-' || orig END AS v1,
    CASE WHEN gcs < 13 AND orig >= 3 THEN '[V] GCS=' || {fmt('gcs', 0)} || ' indicates ≤KTAS-2 but model → KTAS-' || orig END AS v2,
    CASE WHEN sbp < 90 AND orig >= 3 THEN '[V] SBP=' || {fmt('sbp', 0)} || 'mmHg indicates ≤KTAS-2 but model → KTAS-' || orig END AS v3,
    CASE WHEN (hr > 140 OR hr < 45) AND orig >= 4 THEN '[V] HR=' || {fmt('hr', 0)} || 'bpm is extreme but model → KTAS-' || orig END AS v4,
    CASE WHEN (rr > 28 OR rr < 10) AND orig >= 4 THEN '[V] RR=' || {fmt('rr', 0)} || '/min is extreme but model → KTAS-' || orig END AS v5,
    CASE WHEN (tc > 39.5 OR tc < 35.5) AND orig >= 4 THEN '[V] Temp=' || {fmt('tc', 1)} || '°C is abnormal but model → KTAS-' || orig END AS v6,
    CASE WHEN pain >= 8 AND orig >= 4 THEN '[V] Pain=' || {fmt('pain', 0)} || '/10 (severe) but model → KTAS-' || orig END AS v7,
    CASE WHEN nw >= 5 AND orig >= 4 THEN '[N] NEWS2=' || {fmt('nw', 0)} || ' (medium-high risk) but model → KTAS-' || orig END AS n1,
    CASE WHEN nw >= 7 AND orig >= 3 THEN '[N] NEWS2=' || {fmt('nw', 0)} || ' (high risk) but model → KTAS-' || orig END AS n2,
    CASE WHEN kwb IS NOT NULL AND coalesce(sp < 92 OR gcs < 14 OR sbp < 90 OR hr > 150 OR hr < 40, false)
         THEN '[C] Complaint ''' || kwb || ''' appears benign but vitals indicate critical state — possible masking' END AS cc1,
    CASE WHEN kwb IS NOT NULL AND orig >= 4 AND (coalesce(hx_heart_failure, 0) <> 0 OR coalesce(hx_copd, 0) <> 0 OR coalesce(hx_dementia, 0) <> 0)
         THEN '[H] High-risk comorbidities (' || concat_ws(', ',
              CASE WHEN coalesce(hx_heart_failure, 0) <> 0 THEN 'heart failure' END,
              CASE WHEN coalesce(hx_copd, 0) <> 0 THEN 'copd' END,
              CASE WHEN coalesce(hx_dementia, 0) <> 0 THEN 'dementia' END)
              || ') + benign complaint — raised baseline risk, model → KTAS-' || orig END AS h1
  FROM conf2),
cf2 AS (
  SELECT cf.*, {_nn_list('v1', 'v2', 'v3', 'v4', 'v5', 'v6', 'v7', 'n1', 'n2', 'cc1', 'h1')} AS conflict_list,
    least(
      CASE WHEN v1 IS NOT NULL OR v2 IS NOT NULL OR v3 IS NOT NULL OR n2 IS NOT NULL OR cc1 IS NOT NULL THEN 2 END,
      CASE WHEN v4 IS NOT NULL OR v5 IS NOT NULL OR v6 IS NOT NULL OR v7 IS NOT NULL OR n1 IS NOT NULL OR h1 IS NOT NULL THEN 3 END
    ) AS cfloor
  FROM cf),
dec AS (
  SELECT cf2.*,
    CAST(CASE WHEN cfloor IS NOT NULL AND cfloor < conf_acuity THEN cfloor ELSE conf_acuity END AS INT) AS final_acuity,
    len(conflict_list) > 0 AS has_conflict,
    CASE WHEN len(conflict_list) = 0 THEN NULL
         WHEN least(conf_acuity, coalesce(cfloor, 9)) < orig THEN 'CONFLICT escalated KTAS-' || orig || ' → KTAS-' || least(conf_acuity, coalesce(cfloor, 9)) || ': ' || array_to_string(conflict_list, ' | ')
         ELSE 'CONFLICT detected but acuity already at correct level: ' || array_to_string(conflict_list, ' | ') END AS conflict_note,
    (cstate IN ('AMBIGUOUS', 'LOW')) OR (len(conflict_list) > 0 AND least(conf_acuity, coalesce(cfloor, 9)) < orig) AS review
  FROM cf2)
"""

DECISIONS_SELECT = f"""
SELECT patient_id, run_id, orig AS original_acuity, final_acuity AS predicted_acuity,
  CAST(triage_acuity AS INT) AS true_acuity, {_label('final_acuity')} AS label, {_color('final_acuity')} AS color,
  {rnd('s1', 4)} AS confidence, {pct('s1')} AS confidence_pct, cstate AS confidence_state,
  {rnd('gap', 4)} AS confidence_gap, CAST(c2 AS INT) AS confidence_top2_acuity, {pct('s2')} AS confidence_top2_pct,
  final_acuity <= 2 AS is_emergency, trig AS safety_rail_triggered, to_json(rail_list) AS safety_rail_reasons,
  has_conflict AS has_feature_conflict, to_json(conflict_list) AS conflict_reasons, review AS requires_review,
  to_json({_nn_list('rail_note', 'conf_note', 'conflict_note')}) AS safety_notes,
  to_json({_nn_list("CASE WHEN trig THEN 'RAIL' END", "CASE WHEN cstate IN ('AMBIGUOUS', 'LOW') THEN cstate END", "CASE WHEN has_conflict THEN 'CONFLICT' END")}) AS intervention_flags
FROM dec
"""


def with_encounters(body: str, *extra_ctes: str) -> str:
    ctes = [f"encounters AS ({ENCOUNTERS_SQL})"] + list(extra_ctes)
    return "WITH " + ",\n".join(ctes) + "\n" + body


def with_decisions(body: str, *extra_ctes: str) -> str:
    return with_encounters(body, DECISION_CTES.strip(), *extra_ctes)


ORACLE: dict[str, str] = {}


def _json_as_text(sql: str) -> str:
    """Wrap every ``to_json(...)`` in ``CAST(... AS VARCHAR)``: DuckDB returns a JSON type,
    Spark a string; the text is the same."""
    out, i, key = [], 0, "to_json("
    while True:
        j = sql.find(key, i)
        if j < 0:
            out.append(sql[i:])
            return "".join(out)
        depth, k = 0, j + len(key) - 1
        while True:
            if sql[k] == "(":
                depth += 1
            elif sql[k] == ")":
                depth -= 1
                if depth == 0:
                    break
            k += 1
        out.append(sql[i:j] + "CAST(" + sql[j:k + 1] + " AS VARCHAR)")
        i = k + 1


def register(name: str, sql: str) -> None:
    ORACLE[name] = _json_as_text(sql)


register("decisions", with_decisions(DECISIONS_SELECT))

register("base_prediction", with_decisions(f"""
SELECT patient_id, orig AS original_acuity, {_label('orig')} AS label, {_color('orig')} AS color,
  {rnd('s1', 4)} AS confidence, {pct('s1')} AS confidence_pct, orig <= 2 AS is_emergency,
  {rnd('p1', 4)} AS p1, {rnd('p2', 4)} AS p2, {rnd('p3', 4)} AS p3, {rnd('p4', 4)} AS p4, {rnd('p5', 4)} AS p5
FROM dec"""))

register("safety_rails", with_decisions("""
SELECT patient_id, orig AS original_acuity, rail_acuity, trig AS safety_rail_triggered,
  to_json(rail_list) AS safety_rail_reasons, rail_note
FROM dec"""))

register("confidence_states", with_decisions(f"""
SELECT patient_id, cstate AS confidence_state, {rnd('gap', 4)} AS confidence_gap,
  CAST(c1 AS INT) AS confidence_top1_acuity, CAST(c2 AS INT) AS confidence_top2_acuity,
  {pct('s2')} AS confidence_top2_pct
FROM dec"""))

register("confidence_resolved", with_decisions("""
SELECT patient_id, rail_acuity, cstate AS confidence_state, conf_acuity, conf_note,
  cstate IN ('AMBIGUOUS', 'LOW') AS conf_review
FROM dec"""))

register("feature_conflicts", with_decisions("""
SELECT patient_id, original_acuity, conf_acuity, final_acuity, has_feature_conflict,
  to_json(conflict_list) AS conflict_reasons, conflict_note
FROM (SELECT *, orig AS original_acuity, has_conflict AS has_feature_conflict FROM dec) d"""))

register("class_distribution", with_decisions("""
SELECT kind, acuity, CAST(n AS BIGINT) AS n, CAST(format('{:.6f}', 100.0 * n / sum(n) OVER (PARTITION BY kind)) AS DOUBLE) AS pct
FROM (
  SELECT 'true' AS kind, CAST(triage_acuity AS INT) AS acuity, count(*) AS n FROM encounters GROUP BY 1, 2
  UNION ALL
  SELECT 'predicted', final_acuity, count(*) FROM dec GROUP BY 1, 2) t"""))


# ---------------------------------------------------------------- features
def _flag_sql(v: dict) -> str:
    specs = [("flag_hypotension", f"{v['sbp']} < 90"), ("flag_hypertension", f"{v['sbp']} > 180"),
             ("flag_tachycardia", f"{v['hr']} > 100"), ("flag_bradycardia", f"{v['hr']} < 60"),
             ("flag_tachypnea", f"{v['rr']} > 20"), ("flag_bradypnea", f"{v['rr']} < 12"),
             ("flag_fever", f"{v['tc']} > 38.3"), ("flag_hypothermia", f"{v['tc']} < 35.0"),
             ("flag_hypoxia", f"{v['sp']} < 94"), ("flag_severe_pain", f"{v['pain']} >= 7"),
             ("flag_low_gcs", f"{v['gcs']} < 14"), ("flag_critical_gcs", f"{v['gcs']} <= 8")]
    return ", ".join(f"CAST(coalesce({p}, false) AS INT) AS {n}" for n, p in specs)


_RAW = dict(sbp="systolic_bp", hr="heart_rate", rr="respiratory_rate", tc="temperature_c", sp="spo2",
            pain="pain_score", gcs="gcs_total")
_HX_SUM = "coalesce(hx_heart_failure, 0) + coalesce(hx_copd, 0) + coalesce(hx_dementia, 0) + coalesce(hx_hypertension, 0)"
_HX_HIGH = "coalesce(hx_heart_failure, 0) + coalesce(hx_copd, 0) + coalesce(hx_dementia, 0)"

register("clinical_flags", with_encounters(f"SELECT patient_id, {_flag_sql(_RAW)} FROM encounters"))

register("history_burden", with_encounters(f"""
SELECT patient_id, CAST({_HX_SUM} AS INT) AS hx_total_burden, CAST(({_HX_HIGH}) > 0 AS INT) AS hx_high_risk_flag
FROM encounters"""))

register("shock_index", with_encounters(f"""
SELECT patient_id, CASE WHEN coalesce(systolic_bp, 0) > 0
  THEN {rnd('coalesce(heart_rate, 0) / systolic_bp', 3)} END AS shock_index FROM encounters"""))

register("clean_target", with_encounters("""
SELECT patient_id, CAST(trunc(TRY_CAST(triage_acuity_raw AS DOUBLE)) AS INT) AS triage_acuity
FROM raw_target WHERE TRY_CAST(triage_acuity_raw AS DOUBLE) BETWEEN 1 AND 5""", f"raw_target AS ({RAW_TARGET_SQL})"))

register("dedup_first", with_encounters("""
SELECT patient_id, chief_complaint_raw, ord FROM (
  SELECT *, row_number() OVER (PARTITION BY patient_id ORDER BY ord, chief_complaint_raw) AS rn FROM complaints) t
WHERE rn = 1""", f"complaints AS ({COMPLAINTS_SQL})"))

register("training_set", with_encounters(f"""
SELECT patient_id, CAST(trunc(TRY_CAST(triage_acuity_raw AS DOUBLE)) AS INT) AS triage_acuity, age, sex,
  mental_status_triage, heart_rate, systolic_bp, diastolic_bp, respiratory_rate, temperature_c, spo2, gcs_total,
  pain_score, news2_score, chief_complaint_raw, hx_heart_failure, hx_copd, hx_dementia, hx_hypertension,
  {_flag_sql(_RAW)}, CAST({_HX_SUM} AS INT) AS hx_total_burden, CAST(({_HX_HIGH}) > 0 AS INT) AS hx_high_risk_flag
FROM (
  SELECT m.*, rt.triage_acuity_raw, cc.chief_complaint_raw, hx.hx_heart_failure, hx.hx_copd, hx.hx_dementia, hx.hx_hypertension
  FROM (SELECT patient_id, age, sex, mental_status_triage, heart_rate, systolic_bp, diastolic_bp, respiratory_rate,
               temperature_c, spo2, gcs_total, pain_score, news2_score FROM encounters) m
  JOIN raw_target rt USING (patient_id)
  LEFT JOIN (SELECT patient_id, chief_complaint_raw FROM (
      SELECT *, row_number() OVER (PARTITION BY patient_id ORDER BY ord, chief_complaint_raw) AS rn FROM complaints) t
    WHERE rn = 1) cc USING (patient_id)
  LEFT JOIN (SELECT patient_id, hx_heart_failure, hx_copd, hx_dementia, hx_hypertension FROM encounters) hx USING (patient_id)
) j
WHERE TRY_CAST(triage_acuity_raw AS DOUBLE) BETWEEN 1 AND 5""",
    f"raw_target AS ({RAW_TARGET_SQL})", f"complaints AS ({COMPLAINTS_SQL})"))


# ---------------------------------------------------------------- profiles
_PV = ["heart_rate", "systolic_bp", "diastolic_bp", "spo2", "respiratory_rate", "temperature_c",
       "gcs_total", "pain_score", "news2_score"]


def _long(cols: list[str], sel: str) -> str:
    return " UNION ALL ".join(sel.replace("{c}", c) for c in cols)


register("acuity_stats", with_encounters(_long(_PV, f"""
SELECT CAST(triage_acuity AS INT) AS acuity, '{{c}}' AS "column", {rnd('avg(CAST({c} AS DOUBLE))', 6)} AS mean,
  {rnd('stddev_samp(CAST({c} AS DOUBLE))', 6)} AS std FROM encounters GROUP BY 1""")))

register("acuity_stats_json", with_encounters(f"""
SELECT CAST(acuity AS VARCHAR) AS acuity,
  '{{' || string_agg('"' || "column" || '":{{"mean":' || CAST(mean AS VARCHAR) || ',"std":' || CAST(std AS VARCHAR) || '}}',
                     ',' ORDER BY "column") || '}}' AS stats_json
FROM ({_long(_PV, f"""
SELECT CAST(triage_acuity AS INT) AS acuity, '{{c}}' AS "column", {rnd('avg(CAST({c} AS DOUBLE))', 6)} AS mean,
  {rnd('stddev_samp(CAST({c} AS DOUBLE))', 6)} AS std FROM encounters GROUP BY 1""")}) GROUP BY acuity"""))

register("numeric_profile", with_encounters(_long(_PV + ["age"], f"""
SELECT s.acuity, 'stratum' AS source, '{{c}}' AS "column", CAST(count({{c}}) AS BIGINT) AS n,
  {rnd('avg(CAST({c} AS DOUBLE))', 6)} AS mean,
  CASE WHEN stddev_samp(CAST({{c}} AS DOUBLE)) > 0 THEN {rnd('stddev_samp(CAST({c} AS DOUBLE))', 6)} ELSE 0.01 END AS std,
  {rnd('min(CAST({c} AS DOUBLE))', 6)} AS min, {rnd('max(CAST({c} AS DOUBLE))', 6)} AS max
FROM (SELECT *, CAST(triage_acuity AS INT) AS acuity FROM encounters) s GROUP BY s.acuity""")))

register("categorical_profile", with_encounters(f"""
SELECT acuity, "column", value, CAST(n AS BIGINT) AS n, {rnd('n / sum(n) OVER (PARTITION BY acuity, "column")', 6)} AS freq
FROM (
  SELECT acuity, "column", value, count(*) AS n FROM (
    SELECT CAST(triage_acuity AS INT) AS acuity, 'sex' AS "column", sex AS value FROM encounters
    UNION ALL SELECT CAST(triage_acuity AS INT), 'mental_status_triage', mental_status_triage FROM encounters
    UNION ALL SELECT CAST(triage_acuity AS INT), 'chief_complaint_raw', chief_complaint_raw FROM encounters) u
  WHERE value IS NOT NULL GROUP BY 1, 2, 3) c"""))

register("binary_profile", with_encounters(_long(["hx_heart_failure", "hx_copd", "hx_dementia", "hx_hypertension"], f"""
SELECT CAST(triage_acuity AS INT) AS acuity, '{{c}}' AS "column", {rnd('avg(CAST({c} AS DOUBLE))', 6)} AS rate
FROM encounters GROUP BY 1""")))

register("column_profile", with_encounters("""
SELECT "column", value, CAST(count(*) AS BIGINT) AS n FROM (
  SELECT 'sex' AS "column", sex AS value FROM encounters
  UNION ALL SELECT 'mental_status_triage', mental_status_triage FROM encounters) u GROUP BY 1, 2"""))


# FIXED VALUES: columns of the encounter view and their types.
_ENCOUNTER_TYPES = {
    "event_id": "bigint", "patient_id": "string", "run_id": "string", "arrival_ts": "timestamp_ntz", "triage_acuity": "int",
    "age": "int", "sex": "string", "mental_status_triage": "string", "heart_rate": "double", "systolic_bp": "double",
    "diastolic_bp": "double", "respiratory_rate": "double", "temperature_c": "double", "spo2": "double", "gcs_total": "int",
    "pain_score": "int", "news2_score": "int", "hx_heart_failure": "int", "hx_copd": "int", "hx_dementia": "int",
    "hx_hypertension": "int", "chief_complaint_raw": "string",
}
register("column_list", with_encounters(" UNION ALL ".join(
    f"""SELECT '{c}' AS "column", {i} AS position, '{t}' AS type, CAST(count(*) - count({c}) AS BIGINT) AS nulls,
  (SELECT CAST(to_json(list(coalesce(CAST({c} AS VARCHAR), 'null') ORDER BY patient_id)) AS VARCHAR)
   FROM (SELECT patient_id, {c} FROM encounters ORDER BY patient_id LIMIT 5) h) AS head
FROM encounters""" for i, (c, t) in enumerate(_ENCOUNTER_TYPES.items()))))


# ---------------------------------------------------------------- metrics
MSG_CTES = (
    f"messages AS ({MESSAGES_SQL})",
    """msgs AS (
  SELECT m.run_id, m.patient_id, m.produced_at, m.consumer_received_at, m.ml_done_at, m.safety_done_at,
    (m.consumer_received_at - m.produced_at) * 1000 AS kafka_transit_ms,
    (m.ml_done_at - m.consumer_received_at) * 1000 AS ml_inference_ms,
    (m.safety_done_at - m.ml_done_at) * 1000 AS safety_pipeline_ms,
    (m.safety_done_at - m.produced_at) * 1000 AS e2e_ms,
    CAST(d.trig AS INT) AS safety_rail_triggered, CAST(d.triage_acuity AS INT) AS true_acuity,
    d.final_acuity AS predicted_acuity, x.explained_at,
    CASE WHEN x.explained_at IS NOT NULL THEN (x.explained_at - coalesce(x.enrichment_requested_at, m.safety_done_at)) * 1000 END AS llm_ms
  FROM messages m JOIN dec d USING (patient_id)
  LEFT JOIN (SELECT patient_id, arg_min(explained_at, explained_at) AS explained_at,
                    arg_min(enrichment_requested_at, explained_at) AS enrichment_requested_at
             FROM messages WHERE explained_at IS NOT NULL GROUP BY patient_id) x USING (patient_id))""",
)


def _q(x: str, q: float) -> str:
    return rnd(f"quantile_cont({x}, {q})", 6)


RUN_SUMMARY_SQL = f"""
SELECT run_id, CAST(count(*) AS BIGINT) AS message_count,
  {rnd("max(CASE WHEN safety_done_at <> 0 THEN safety_done_at END) - min(CASE WHEN produced_at <> 0 THEN produced_at END)", 6)} AS duration_secs,
  {rnd("count(*) / nullif(max(CASE WHEN safety_done_at <> 0 THEN safety_done_at END) - min(CASE WHEN produced_at <> 0 THEN produced_at END), 0)", 6)} AS throughput_msg_sec,
  {rnd("avg(CAST(safety_rail_triggered AS DOUBLE))", 6)} AS rail_hit_rate,
  {_q('e2e_ms', 0.5)} AS p50_e2e_ms, {_q('e2e_ms', 0.95)} AS p95_e2e_ms,
  {_q('kafka_transit_ms', 0.5)} AS p50_kafka_ms, {_q('kafka_transit_ms', 0.95)} AS p95_kafka_ms,
  {_q('ml_inference_ms', 0.5)} AS p50_ml_ms, {_q('ml_inference_ms', 0.95)} AS p95_ml_ms,
  {_q('safety_pipeline_ms', 0.5)} AS p50_safety_ms, {_q('safety_pipeline_ms', 0.95)} AS p95_safety_ms,
  {_q('llm_ms', 0.5)} AS p50_llm_ms, {_q('llm_ms', 0.95)} AS p95_llm_ms,
  min(CASE WHEN produced_at <> 0 THEN produced_at END) AS t0, avg(CAST(safety_rail_triggered AS DOUBLE)) AS rail_raw
FROM msgs GROUP BY run_id"""

register("latency_segments", with_decisions(f"""
SELECT run_id, patient_id, {rnd('kafka_transit_ms', 6)} AS kafka_transit_ms, {rnd('ml_inference_ms', 6)} AS ml_inference_ms,
  {rnd('safety_pipeline_ms', 6)} AS safety_pipeline_ms, {rnd('e2e_ms', 6)} AS e2e_ms, {rnd('llm_ms', 6)} AS llm_ms,
  safety_rail_triggered, true_acuity, predicted_acuity FROM msgs""", *MSG_CTES))

register("llm_segments", with_decisions(f"""
SELECT patient_id, run_id, {rnd('explained_at', 6)} AS explained_at, {rnd('llm_ms', 6)} AS llm_ms
FROM msgs WHERE explained_at IS NOT NULL""", *MSG_CTES))

register("run_summary", with_decisions(
    "SELECT * EXCLUDE (t0, rail_raw) FROM rs", *MSG_CTES, f"rs AS ({RUN_SUMMARY_SQL})"))

register("run_comparison", with_decisions("""
SELECT run_id, strftime(make_timestamp(CAST(round(t0 * 1000000) AS BIGINT)), '%Y-%m-%d %H:%M') AS started,
  message_count AS messages, duration_secs AS duration_s, throughput_msg_sec AS throughput,
  p50_e2e_ms, p95_e2e_ms, p50_kafka_ms, p50_ml_ms, p50_safety_ms,
  CAST(format('{:.6f}', rail_raw * 100) AS DOUBLE) AS rail_hit_pct
FROM rs""", *MSG_CTES, f"rs AS ({RUN_SUMMARY_SQL})"))

register("latest_run", with_decisions(
    "SELECT arg_max(run_id, t0) AS run_id FROM rs", *MSG_CTES, f"rs AS ({RUN_SUMMARY_SQL})"))

register("message_sequence", with_decisions("""
SELECT run_id, patient_id, row_number() OVER (PARTITION BY run_id ORDER BY produced_at, patient_id) AS seq
FROM msgs""", *MSG_CTES))

register("running_accuracy", with_decisions(f"""
SELECT run_id, patient_id, seq, hit, {rnd('running_hit / seq', 6)} AS running_accuracy FROM (
  SELECT run_id, patient_id, hit,
    row_number() OVER w AS seq, sum(hit) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS running_hit
  FROM (SELECT *, CAST(coalesce(true_acuity = predicted_acuity, false) AS INT) AS hit FROM msgs) h
  WINDOW w AS (PARTITION BY run_id ORDER BY produced_at, patient_id)) t""", *MSG_CTES))

register("latency_points", with_decisions(f"""
SELECT run_id, row_number() OVER (PARTITION BY run_id ORDER BY produced_at, patient_id) AS seq, patient_id,
  {rnd('e2e_ms', 6)} AS e2e_ms,
  CASE WHEN safety_rail_triggered <> 0 THEN 'Rail fired' ELSE 'No rail' END AS rail,
  CASE WHEN coalesce(predicted_acuity, 0) <> 0 THEN 'KTAS-' || predicted_acuity ELSE 'Unknown' END AS ktas,
  CASE WHEN coalesce(predicted_acuity, 0) <> 0 THEN coalesce({_color('predicted_acuity')}, '#888') ELSE '#888' END AS color
FROM msgs""", *MSG_CTES))

register("recent_records", with_decisions(f"""
SELECT patient_id, run_id, {rnd('produced_at', 6)} AS produced_at, predicted_acuity, safety_rail_triggered
FROM msgs ORDER BY produced_at DESC, patient_id LIMIT 100""", *MSG_CTES))

register("pipeline_counters", with_decisions(f"""
SELECT processed, correct, rail_hits, conf_hits, conflict_hits,
  {rnd('correct * 100.0 / processed', 6)} AS correct_pct, {rnd('rail_hits * 100.0 / processed', 6)} AS rail_hits_pct,
  {rnd('conf_hits * 100.0 / processed', 6)} AS conf_hits_pct, {rnd('conflict_hits * 100.0 / processed', 6)} AS conflict_hits_pct
FROM (SELECT CAST(count(*) AS BIGINT) AS processed,
  CAST(count(*) FILTER (WHERE triage_acuity = final_acuity) AS BIGINT) AS correct,
  CAST(count(*) FILTER (WHERE trig) AS BIGINT) AS rail_hits,
  CAST(count(*) FILTER (WHERE cstate IN ('AMBIGUOUS', 'LOW')) AS BIGINT) AS conf_hits,
  CAST(count(*) FILTER (WHERE has_conflict) AS BIGINT) AS conflict_hits FROM dec) a"""))

register("stream_run_counters", with_decisions("""
SELECT run_id, CAST(count(*) AS BIGINT) AS processed,
  CAST(count(*) FILTER (WHERE triage_acuity = final_acuity) AS BIGINT) AS correct,
  CAST(count(*) FILTER (WHERE trig) AS BIGINT) AS rail_hits,
  CAST(count(*) FILTER (WHERE cstate IN ('AMBIGUOUS', 'LOW')) AS BIGINT) AS conf_hits,
  CAST(count(*) FILTER (WHERE has_conflict) AS BIGINT) AS conflict_hits FROM dec GROUP BY run_id"""))

register("stream_llm_segments", with_decisions(f"""
SELECT patient_id, run_id, {rnd('explained_at', 6)} AS explained_at, {rnd('llm_ms', 6)} AS llm_ms
FROM msgs WHERE explained_at IS NOT NULL""", *MSG_CTES))

register("stream_run_summary", with_decisions(
    "SELECT * EXCLUDE (t0, rail_raw) FROM rs", *MSG_CTES, f"rs AS ({RUN_SUMMARY_SQL})"))

register("stream_merged_records", with_decisions(f"""
SELECT d.patient_id, d.final_acuity AS predicted_acuity, {_label('d.final_acuity')} AS label,
  d.review AS requires_review, {rnd('m.explained_at', 6)} AS explained_at
FROM dec d LEFT JOIN msgs m USING (patient_id)""", *MSG_CTES))

register("stream_recent_records", with_decisions(f"""
SELECT patient_id, {rnd('produced_at', 6)} AS produced_at
FROM msgs ORDER BY produced_at DESC, patient_id LIMIT 100""", *MSG_CTES))

register("layer_impact", with_decisions(f"""
SELECT total, correct_raw, correct_final, rail_hits, conf_hits, conflict_hits, escalations, requires_review,
  {rnd('correct_raw * 100.0 / total', 6)} AS raw_accuracy_pct, {rnd('correct_final * 100.0 / total', 6)} AS final_accuracy_pct,
  {rnd('(correct_final - correct_raw) * 100.0 / total', 6)} AS accuracy_delta_pct
FROM (SELECT CAST(count(*) AS BIGINT) AS total,
  CAST(count(*) FILTER (WHERE triage_acuity = orig) AS BIGINT) AS correct_raw,
  CAST(count(*) FILTER (WHERE triage_acuity = final_acuity) AS BIGINT) AS correct_final,
  CAST(count(*) FILTER (WHERE trig) AS BIGINT) AS rail_hits,
  CAST(count(*) FILTER (WHERE cstate IN ('AMBIGUOUS', 'LOW')) AS BIGINT) AS conf_hits,
  CAST(count(*) FILTER (WHERE has_conflict) AS BIGINT) AS conflict_hits,
  CAST(count(*) FILTER (WHERE orig <> final_acuity) AS BIGINT) AS escalations,
  CAST(count(*) FILTER (WHERE review) AS BIGINT) AS requires_review FROM dec) a"""))

register("layer_breakdowns", with_decisions("""
SELECT 'confidence_state' AS breakdown, cstate AS key, CAST(count(*) AS BIGINT) AS n FROM dec GROUP BY cstate
UNION ALL
(SELECT 'acuity_transition', 'KTAS-' || orig || '→KTAS-' || final_acuity AS key, CAST(count(*) AS BIGINT) AS n
 FROM dec WHERE orig <> final_acuity GROUP BY 2 ORDER BY n DESC, key LIMIT 10)
UNION ALL
(SELECT 'rail_reason', array_to_string(regexp_split_to_array(trim(r), '\\s+')[1:3], ' ') AS key, CAST(count(*) AS BIGINT) AS n
 FROM (SELECT unnest(rail_list) AS r FROM dec WHERE trig) u GROUP BY 2 ORDER BY n DESC, key LIMIT 8)
UNION ALL
SELECT 'conflict_type', substr(c, 1, 3), CAST(count(*) AS BIGINT) FROM (SELECT unnest(conflict_list) AS c FROM dec WHERE has_conflict) u GROUP BY 2"""))


# ---------------------------------------------------------------- review and feedback
WS = r"[\t\n\x0b\x0c\r\x1c-\x1f \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
LINES = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


ACT_CTES = (
    f"actions AS ({ACTIONS_SQL})",
    f"accepted AS (SELECT DISTINCT patient_id FROM actions WHERE action = 'accept')",
    f"overridden AS (SELECT DISTINCT patient_id FROM actions WHERE action = 'override' AND {strip('coalesce(override_reason, chr(32))')} <> '')",
)

# (column, label, low, high) of the gate, restated.
_GATE = [("hr", "Heart Rate", "60", "130"), ("sbp", "Systolic BP", "80", "200"), ("sp", "SpO2", "90", None),
         ("rr", "Respiratory Rate", "8", "30"), ("tc", "Temperature", "35.0", "40.0"), ("gcs", "GCS", "12", None),
         ("nw", "NEWS2", None, "6")]


def _gate_cols() -> str:
    code = ["WHEN o.patient_id IS NOT NULL THEN 'OVERRIDE'",
            "WHEN d.triage_acuity IS NOT NULL AND d.final_acuity IS NOT NULL AND d.triage_acuity <> d.final_acuity THEN 'CONFLICT'"]
    label = ["WHEN o.patient_id IS NOT NULL THEN '⚠️ Clinician Override'",
             "WHEN d.triage_acuity IS NOT NULL AND d.final_acuity IS NOT NULL AND d.triage_acuity <> d.final_acuity THEN '🔀 Acuity Conflict'"]
    detail = ["WHEN o.patient_id IS NOT NULL THEN 'Clinician has overridden the ML prediction — LLM review triggered.'",
              "WHEN d.triage_acuity IS NOT NULL AND d.final_acuity IS NOT NULL AND d.triage_acuity <> d.final_acuity THEN "
              "'Model predicted KTAS ' || d.final_acuity || ' but ground-truth is KTAS ' || d.triage_acuity || ' — disagreement requires LLM review.'"]
    for c, lab, lo, hi in _GATE:
        conds = ([f"d.{c} < {lo}"] if lo else []) + ([f"d.{c} > {hi}"] if hi else [])
        cond = " OR ".join(conds)
        code.append(f"WHEN {cond} THEN 'VITAL_RAIL'")
        label.append(f"WHEN {cond} THEN '📉 Critical Vital: {lab}'")
        low_txt = f"'{lab} = ' || CAST(CAST(d.{c} AS DOUBLE) AS VARCHAR) || ' is critically LOW (threshold: ≥{lo}) — LLM review triggered.'"
        high_txt = f"'{lab} = ' || CAST(CAST(d.{c} AS DOUBLE) AS VARCHAR) || ' is critically HIGH (threshold: ≤{hi}) — LLM review triggered.'"
        if lo and hi:
            detail.append(f"WHEN d.{c} < {lo} THEN {low_txt} WHEN d.{c} > {hi} THEN {high_txt}")
        elif lo:
            detail.append(f"WHEN d.{c} < {lo} THEN {low_txt}")
        else:
            detail.append(f"WHEN d.{c} > {hi} THEN {high_txt}")
    return (f"CASE {' '.join(code)} ELSE 'NONE' END AS reason_code, "
            f"CASE {' '.join(label)} ELSE '✅ Routine — No LLM Review' END AS reason_label, "
            f"CASE {' '.join(detail)} ELSE 'KTAS 3-5, no vital derangements, no acuity conflict — Groq API skipped.' END AS reason_detail")


GATE_CTE = f"""gate AS (
  SELECT d.patient_id, {_gate_cols()} FROM dec d LEFT JOIN overridden o USING (patient_id))"""

register("escalation_gate", with_decisions("""
SELECT patient_id, reason_code <> 'NONE' AS should_call_llm, reason_code, reason_label, reason_detail FROM gate""",
                                           *ACT_CTES, GATE_CTE))

_ABN = [("heart_rate", "Heart Rate", "bpm", "60", "100"), ("systolic_bp", "Systolic BP", "mmHg", "90", "180"),
        ("spo2", "SpO2", "%", "94", None), ("respiratory_rate", "Respiratory Rate", "breaths/min", "12", "20"),
        ("temperature_c", "Temperature", "°C", "36.0", "38.3"), ("gcs_total", "GCS", "/15", "14", None),
        ("pain_score", "Pain Score", "/10", None, "6")]


def _abn_items() -> str:
    out = []
    for c, lab, unit, lo, hi in _ABN:
        v = f"CAST(CAST({c} AS DOUBLE) AS VARCHAR)"
        whens = []
        if lo:
            whens.append(f"WHEN {c} < {lo} THEN '{lab} ' || {v} || '{unit} [LOW — normal ≥{lo}]'")
        if hi:
            whens.append(f"WHEN {c} > {hi} THEN '{lab} ' || {v} || '{unit} [HIGH — normal ≤{hi}]'")
        out.append("CASE " + " ".join(whens) + " END")
    return ", ".join(out)


register("abnormal_vitals", with_encounters(f"""
SELECT patient_id, to_json(list_filter([{_abn_items()}], lambda x: x IS NOT NULL)) AS abnormal_vitals FROM encounters"""))

_HIST = """coalesce(nullif(concat_ws(chr(10),
    CASE WHEN coalesce(hx_heart_failure, 0) <> 0 OR coalesce(hx_copd, 0) <> 0 OR coalesce(hx_dementia, 0) <> 0 OR coalesce(hx_hypertension, 0) <> 0
      THEN '  Comorbidities   : ' || concat_ws(', ', CASE WHEN coalesce(hx_heart_failure, 0) <> 0 THEN 'Heart Failure' END,
        CASE WHEN coalesce(hx_copd, 0) <> 0 THEN 'Copd' END, CASE WHEN coalesce(hx_dementia, 0) <> 0 THEN 'Dementia' END,
        CASE WHEN coalesce(hx_hypertension, 0) <> 0 THEN 'Hypertension' END) END,
    CASE WHEN coalesce(mental_status_triage, '') <> '' THEN '  Mental Status   : ' || mental_status_triage END), ''),
  '  (no history data available)')"""

register("history_text", with_encounters(f"SELECT patient_id, {_HIST} AS history_text FROM encounters"))


def _filled(template: str, **slots: str) -> str:
    """SQL text of a prompt template: its literal parts and the SQL of its slots."""
    parts = re.split(r"\{(\w+)\}", template)
    sql = [f"coalesce(CAST({slots[x]} AS VARCHAR), 'None')" if i % 2 else "'" + x.replace("'", "''") + "'"
           for i, x in enumerate(parts) if i % 2 or x]
    return "(" + " || ".join(sql) + ")"


def _short(x: str) -> str:
    return f"CASE {x} " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in const.ACUITY_SHORT_LABEL.items()) + " END"


_PROMPT_SLOTS = {c: f"d.{c}" for c in (
    "age", "heart_rate", "systolic_bp", "diastolic_bp", "spo2", "respiratory_rate", "temperature_c", "gcs_total",
    "pain_score", "news2_score")}
_DIFFERS = "d.triage_acuity <> d.final_acuity"
_LEVEL = {"level": "d.final_acuity", "label": _short("d.final_acuity")}

register("review_prompts", with_decisions(
    f"""SELECT d.patient_id, g.reason_code, {_filled(
        const.PROMPT, **_PROMPT_SLOTS, **_LEVEL, sex="coalesce(d.sex, 'None')", model="'unknown'",
        conflict=f"CASE WHEN {_DIFFERS} THEN " + _filled(
            const.PROMPT_CONFLICT, **_LEVEL, true="d.triage_acuity", true_label=_short("d.triage_acuity")) + " ELSE '' END",
        trigger=_filled(const.PROMPT_TRIGGER, reason_label="g.reason_label", reason_detail="g.reason_detail"),
        clinical="CASE d.final_acuity " + " ".join(
            f"WHEN {k} THEN '{v}'" for k, v in const.ACUITY_CLINICAL.items()) + " END",
        confidence=pct("d.s1"), complaint="coalesce(nullif(d.chief_complaint_raw, ''), 'Not recorded')",
        abnormal=f"CASE WHEN len(a.items) = 0 THEN '{const.PROMPT_NO_ABNORMAL}' "
                 "ELSE '  ⚠ ' || array_to_string(a.items, chr(10) || '  ⚠ ') END",
        probabilities="pr.lines", history="a.history",
        conflict_task=f"CASE WHEN {_DIFFERS} THEN '{const.PROMPT_CONFLICT_TASK}' ELSE '' END",
        conflict_sentence=f"CASE WHEN {_DIFFERS} THEN '{const.PROMPT_CONFLICT_SENTENCE}' ELSE '' END")} AS prompt
FROM dec d JOIN gate g USING (patient_id) JOIN shown a USING (patient_id) JOIN probs pr USING (patient_id)
WHERE g.reason_code <> 'NONE'""",
    # No clinician has acted yet when a prompt is written.
    "overridden AS (SELECT patient_id FROM encounters WHERE false)", GATE_CTE,
    f"""shown AS (SELECT patient_id, list_filter([{_abn_items()}], lambda x: x IS NOT NULL) AS items,
  {_HIST} AS history FROM encounters)""",
    f"""probs AS (SELECT patient_id, string_agg('  ' || rpad({_label('cls')}, 38, ' ') || ' '
    || lpad({fmt('p * 100', 1)}, 5, ' ') || '%  ' || repeat('█', CAST(floor(p * 25) AS INT)) || chr(10), ''
    ORDER BY p DESC, cls) AS lines
  FROM (SELECT patient_id, cls, {rnd('p', 4)} AS p FROM ranked) x GROUP BY patient_id)"""))

_SECTIONS = ["ESCALATION_REASON", "PATIENT_SUMMARY", "RISK_FLAGS", "CONFIDENCE_NOTE"]
NL = "chr(10)"


def _responses_from_dec() -> str:
    complaint = "coalesce(CASE WHEN trim(chief_complaint_raw) <> '' THEN chief_complaint_raw END, 'an unrecorded complaint')"
    reason = f"('Model chose KTAS ' || final_acuity || ' for ' || {complaint} || '.')"
    summary = f"(coalesce(CAST(age AS VARCHAR), '?') || 'y ' || coalesce(sex, '?') || ' presenting with ' || {complaint} || '.')"
    f1 = "coalesce(rail_list[1], 'no rail fired')"
    f2 = "coalesce(conflict_list[1], 'no conflict detected')"
    note = f"('Confidence ' || {pct('s1')} || ' supports clinician review.')"
    return f"""responses AS (
  SELECT patient_id AS response_id, CASE
    WHEN event_id % 5 = 0 THEN 'ESCALATION_REASON:' || {NL} || {reason} || {NL} || {NL} || 'PATIENT_SUMMARY:' || {NL} || {summary}
      || {NL} || {NL} || 'RISK_FLAGS:' || {NL} || '- ' || {f1} || {NL} || '- ' || {f2} || {NL} || {NL} || 'CONFIDENCE_NOTE:' || {NL} || {note}
    WHEN event_id % 5 = 1 THEN 'ESCALATION_REASON: ' || {reason} || {NL} || 'PATIENT_SUMMARY: ' || {summary} || chr(13) || {NL}
      || 'RISK_FLAGS:' || {NL} || '  • ' || {f1} || {NL} || chr(9) || '* ' || {f2} || {NL} || 'CONFIDENCE_NOTE: ' || {note} || {NL}
    WHEN event_id % 5 = 2 THEN 'Here is my review.' || {NL} || 'ESCALATION_REASON' || {NL} || {reason} || {NL} || '  RISK_FLAGS:' || {NL}
      || '  - ' || {f1} || {NL} || ' -- ' || {NL}
    WHEN event_id % 5 = 3 THEN '  ' || {reason} || ' ' || {summary} || '  '
    ELSE 'GROQ_RATE_LIMIT: service busy, no explanation was written.' END AS response_text
  FROM dec WHERE event_id % 3 = 0)"""


def _parse_ctes(src: str) -> tuple:
    header = "CASE " + " ".join(
        f"WHEN starts_with(s, '{k}:') OR s = '{k}' THEN '{k}'" for k in _SECTIONS) + " END"
    return (
        f"""plines AS (
  SELECT response_id, line, idx, {strip('line')} AS s FROM (
    SELECT response_id, unnest(string_split_regex(coalesce(response_text, ''), '{LINES}')) AS line,
           generate_subscripts(string_split_regex(coalesce(response_text, ''), '{LINES}'), 1) AS idx
    FROM {src}) u)""",
        f"""pheads AS (SELECT *, {header} AS header FROM plines)""",
        """pcur AS (
  SELECT *, last_value(header IGNORE NULLS) OVER (PARTITION BY response_id ORDER BY idx
            ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cur FROM pheads)""",
        f"""pcontent AS (
  SELECT *, CASE WHEN header IS NOT NULL THEN
      CASE WHEN {strip("regexp_replace(substr(s, length(header) + 1), '^:+', '')")} <> ''
           THEN {strip("regexp_replace(substr(s, length(header) + 1), '^:+', '')")} || chr(10) END
    WHEN cur IS NOT NULL THEN line || chr(10) END AS content FROM pcur)""",
        "psec AS (SELECT response_id, " + ", ".join(
            f"coalesce(string_agg(content, '' ORDER BY idx) FILTER (WHERE cur = '{k}'), '') AS {k.lower()}"
            for k in _SECTIONS) + " FROM pcontent GROUP BY response_id)",
        f"""parsed AS (
  SELECT r.response_id,
    CASE WHEN {strip('p.escalation_reason')} = '' AND {strip("coalesce(r.response_text, '')")} <> ''
         THEN {strip("coalesce(r.response_text, '')")} ELSE {strip('p.escalation_reason')} END AS escalation_reason,
    {strip('p.patient_summary')} AS patient_summary,
    to_json(list_filter(list_transform(string_split_regex(p.risk_flags, '{LINES}'),
        lambda l: {strip(f"regexp_replace({strip('l')}, '^[-•*·]+', '')")}), lambda x: x <> '')) AS risk_flags,
    {strip('p.confidence_note')} AS confidence_note, true AS is_ready,
    CASE WHEN starts_with(coalesce(r.response_text, ''), 'GROQ_') THEN regexp_extract(r.response_text, '^(GROQ_[A-Z_]+)', 1) END AS error_code
  FROM {src} r JOIN psec p USING (response_id))""",
    )


register("parsed_responses", with_decisions(
    "SELECT * FROM parsed", _responses_from_dec(),
    """all_responses AS (SELECT * FROM responses UNION ALL
  SELECT 'C' || CAST(conv_id AS VARCHAR) || '-' || CAST(turn AS VARCHAR), text FROM conversations WHERE role = 'assistant')""",
    *_parse_ctes("all_responses")))

register("feedback_events", with_decisions("""
SELECT a.patient_id, 'clinician_feedback' AS event_type,
  CASE WHEN a.action = 'override' THEN 'override'
       WHEN d.orig <> d.final_acuity OR d.trig OR d.cstate IN ('AMBIGUOUS', 'LOW') OR d.has_conflict THEN 'guardrail_accepted'
       ELSE 'accepted' END AS feedback_type,
  CAST(CASE WHEN a.action = 'override' THEN coalesce(a.override_acuity, d.final_acuity) ELSE d.final_acuity END AS INT) AS final_label,
  CASE WHEN a.action = 'override' THEN trim(a.override_reason) END AS override_reason,
  CAST(CASE WHEN a.action = 'override' THEN coalesce(a.override_acuity, d.final_acuity) END AS INT) AS override_ktas,
  d.final_acuity AS shown_acuity
FROM actions a JOIN dec d USING (patient_id)
WHERE a.action = 'accept' OR a.patient_id IN (SELECT patient_id FROM overridden)""", *ACT_CTES))

# FIXED VALUES: columns of the flat feedback table and the expressions behind them.
_FB_COLUMNS = (
    ["patient_id", "timestamp", "processed_at", "feedback_type"]
    + ["final_label", "override_reason", "model_predicted_acuity", "guardrail_acuity", "original_acuity", "true_acuity"]
    + ["heart_rate", "systolic_bp", "diastolic_bp", "mean_arterial_pressure", "pulse_pressure", "respiratory_rate",
       "temperature_c", "spo2", "gcs_total", "pain_score", "news2_score", "shock_index"]
    + ["age", "sex", "weight_kg", "height_cm", "bmi", "age_group", "language", "insurance_type", "transport_origin"]
    + ["arrival_mode", "arrival_hour", "arrival_day", "arrival_month", "arrival_season", "shift"]
    + ["chief_complaint", "chief_complaint_raw", "chief_complaint_system", "pain_location", "mental_status_triage",
       "num_prior_ed_visits_12m", "num_prior_admissions_12m", "num_active_medications", "num_comorbidities"]
    + ["hx_hypertension", "hx_diabetes_type2", "hx_diabetes_type1", "hx_asthma", "hx_copd", "hx_heart_failure",
       "hx_atrial_fibrillation", "hx_ckd", "hx_liver_disease", "hx_malignancy", "hx_obesity", "hx_depression",
       "hx_anxiety", "hx_dementia", "hx_epilepsy", "hx_hypothyroidism", "hx_hyperthyroidism", "hx_hiv",
       "hx_coagulopathy", "hx_immunosuppressed", "hx_pregnant", "hx_substance_use_disorder",
       "hx_coronary_artery_disease", "hx_stroke_prior", "hx_peripheral_vascular_disease"]
    + ["flag_hypotension", "flag_hypertension", "flag_tachycardia", "flag_bradycardia", "flag_tachypnea",
       "flag_bradypnea", "flag_fever", "flag_hypothermia", "flag_hypoxia", "flag_severe_pain", "flag_low_gcs",
       "flag_critical_gcs", "hx_total_burden", "hx_high_risk_flag"]
    + ["confidence", "confidence_pct", "confidence_state", "confidence_gap", "confidence_top2_acuity",
       "confidence_top2_pct", "safety_rail_triggered", "safety_rail_reasons", "has_feature_conflict",
       "conflict_reasons", "intervention_flags", "safety_notes", "requires_review", "model"]
)
_FB_INT = {"final_label", "model_predicted_acuity", "guardrail_acuity", "original_acuity", "true_acuity", "arrival_hour",
           "arrival_month", "num_prior_ed_visits_12m", "num_prior_admissions_12m", "num_active_medications",
           "num_comorbidities", "gcs_total", "pain_score", "confidence_top2_acuity", "safety_rail_triggered",
           "has_feature_conflict", "requires_review"}
_FB_REAL = {"confidence", "confidence_gap", "heart_rate", "systolic_bp", "diastolic_bp", "mean_arterial_pressure",
            "pulse_pressure", "respiratory_rate", "temperature_c", "spo2", "news2_score", "shock_index", "age",
            "weight_kg", "height_cm", "bmi"}
_TS = "'%Y-%m-%dT%H:%M:%S.%f'"
_FB_SOURCE = {
    "patient_id": "e.patient_id", "timestamp": f"strftime(d.arrival_ts, {_TS})",
    "processed_at": f"strftime(make_timestamp(CAST(round(m.safety_done_at * 1000000) AS BIGINT)), {_TS})",
    "feedback_type": "e.feedback_type", "final_label": "e.final_label", "override_reason": "e.override_reason",
    "model_predicted_acuity": "d.orig", "guardrail_acuity": "d.final_acuity", "original_acuity": "d.orig",
    "true_acuity": "d.triage_acuity", "heart_rate": "d.heart_rate", "systolic_bp": "d.systolic_bp",
    "diastolic_bp": "d.diastolic_bp", "respiratory_rate": "d.respiratory_rate", "temperature_c": "d.temperature_c",
    "spo2": "d.spo2", "gcs_total": "d.gcs_total", "pain_score": "d.pain_score", "news2_score": "d.news2_score",
    "age": "d.age", "sex": "d.sex", "chief_complaint": "d.chief_complaint_raw",
    "chief_complaint_raw": "d.chief_complaint_raw", "mental_status_triage": "d.mental_status_triage",
    "hx_hypertension": "d.hx_hypertension", "hx_copd": "d.hx_copd", "hx_heart_failure": "d.hx_heart_failure",
    "hx_dementia": "d.hx_dementia",
    "hx_total_burden": f"({_HX_SUM.replace('hx_', 'd.hx_')})",
    "hx_high_risk_flag": f"CAST(({_HX_HIGH.replace('hx_', 'd.hx_')}) > 0 AS INT)",
    "confidence": rnd("d.s1", 4), "confidence_pct": pct("d.s1"), "confidence_state": "d.cstate",
    "confidence_gap": rnd("d.gap", 4), "confidence_top2_acuity": "d.c2", "confidence_top2_pct": pct("d.s2"),
    "safety_rail_triggered": "CAST(d.trig AS INT)", "safety_rail_reasons": "to_json(d.rail_list)",
    "has_feature_conflict": "CAST(d.has_conflict AS INT)", "conflict_reasons": "to_json(d.conflict_list)",
    "intervention_flags": "to_json(" + _nn_list("CASE WHEN d.trig THEN 'RAIL' END",
                                                 "CASE WHEN d.cstate IN ('AMBIGUOUS', 'LOW') THEN d.cstate END",
                                                 "CASE WHEN d.has_conflict THEN 'CONFLICT' END") + ")",
    "safety_notes": "to_json(" + _nn_list("d.rail_note", "d.conf_note", "d.conflict_note") + ")",
    "requires_review": "CAST(d.review AS INT)", "model": "'unknown'",
}
for _n, _c in [("flag_hypotension", "d.systolic_bp < 90"), ("flag_hypertension", "d.systolic_bp > 180"),
               ("flag_tachycardia", "d.heart_rate > 100"), ("flag_bradycardia", "d.heart_rate < 60"),
               ("flag_tachypnea", "d.respiratory_rate > 20"), ("flag_bradypnea", "d.respiratory_rate < 12"),
               ("flag_fever", "d.temperature_c > 38.3"), ("flag_hypothermia", "d.temperature_c < 35.0"),
               ("flag_hypoxia", "d.spo2 < 94"), ("flag_severe_pain", "d.pain_score >= 7"),
               ("flag_low_gcs", "d.gcs_total < 14"), ("flag_critical_gcs", "d.gcs_total <= 8")]:
    _FB_SOURCE[_n] = f"coalesce({_c}, false)"


def _fb_type(c: str) -> str:
    if c in _FB_INT or c.startswith("hx_") or c.startswith("flag_"):
        return "INTEGER"
    if c in _FB_REAL:
        return "DOUBLE"
    return "VARCHAR"


def _fb_select() -> str:
    cols = []
    for c in _FB_COLUMNS:
        src = _FB_SOURCE.get(c, "NULL")
        if c in ("confidence", "confidence_gap"):
            cols.append(f"{src} AS {c}")
        elif _fb_type(c) == "DOUBLE":
            cols.append(f"{rnd(src, 6)} AS {c}" if src != "NULL" else f"CAST(NULL AS DOUBLE) AS {c}")
        else:
            cols.append(f"CAST({src} AS {_fb_type(c)}) AS {c}")
    return ", ".join(cols)


FB_EVENTS_CTE = """fb_events AS (
  SELECT a.patient_id,
    CASE WHEN a.action = 'override' THEN 'override'
         WHEN d.orig <> d.final_acuity OR d.trig OR d.cstate IN ('AMBIGUOUS', 'LOW') OR d.has_conflict THEN 'guardrail_accepted'
         ELSE 'accepted' END AS feedback_type,
    CAST(CASE WHEN a.action = 'override' THEN coalesce(a.override_acuity, d.final_acuity) ELSE d.final_acuity END AS INT) AS final_label,
    CASE WHEN a.action = 'override' THEN trim(a.override_reason) END AS override_reason
  FROM actions a JOIN dec d USING (patient_id)
  WHERE a.action = 'accept' OR a.patient_id IN (SELECT patient_id FROM overridden))"""
FB_FLAT_CTE = f"""fb_flat AS (
  SELECT {_fb_select()}
  FROM fb_events e JOIN dec d USING (patient_id) JOIN messages m USING (patient_id)
  WHERE e.final_label IS NOT NULL)"""
FB_CTES = (*ACT_CTES, f"messages AS ({MESSAGES_SQL})", FB_EVENTS_CTE, FB_FLAT_CTE,
           """ovr AS (SELECT patient_id, feedback_type, model_predicted_acuity, guardrail_acuity, final_label,
  safety_rail_triggered, safety_rail_reasons FROM fb_flat WHERE feedback_type <> 'llm_explained')""")

register("feedback_flat", with_decisions("SELECT * FROM fb_flat", *FB_CTES))
register("override_rows", with_decisions("SELECT * FROM ovr", *FB_CTES))
register("override_matrix", with_decisions("""
SELECT model_predicted_acuity, final_label, CAST(count(*) AS BIGINT) AS cnt FROM ovr
WHERE model_predicted_acuity IS NOT NULL AND final_label IS NOT NULL GROUP BY 1, 2""", *FB_CTES))
register("override_matrix_dense", with_decisions("""
SELECT s.k AS model_predicted_acuity, """ + ", ".join(
    f"CAST(count(o.final_label) FILTER (WHERE o.final_label = {k}) AS BIGINT) AS label_{k}" for k in range(1, 6)) + """
FROM (SELECT unnest([1, 2, 3, 4, 5]) AS k) s LEFT JOIN ovr o ON o.model_predicted_acuity = s.k GROUP BY s.k""", *FB_CTES))
register("override_summary", with_decisions(f"""
SELECT total, diagonal, total - diagonal AS off_diagonal,
  CASE WHEN total > 0 THEN {rnd('diagonal * 100.0 / total', 6)} END AS diagonal_pct,
  CASE WHEN total > 0 THEN {rnd('(total - diagonal) * 100.0 / total', 6)} END AS off_diagonal_pct
FROM (SELECT CAST(count(*) AS BIGINT) AS total,
  CAST(count(*) FILTER (WHERE model_predicted_acuity = final_label) AS BIGINT) AS diagonal
  FROM ovr WHERE model_predicted_acuity BETWEEN 1 AND 5 AND final_label BETWEEN 1 AND 5) t""", *FB_CTES))
register("rail_reasons", with_decisions(f"""
SELECT reason, CAST(count(*) AS BIGINT) AS n FROM (
  SELECT CASE WHEN contains(r, '→') THEN {strip("split_part(r, '→', 1)")} ELSE r END AS reason FROM (
    SELECT unnest(CAST(json(safety_rail_reasons) AS VARCHAR[])) AS r FROM (
      SELECT DISTINCT patient_id, safety_rail_reasons FROM ovr
      WHERE safety_rail_triggered = 1 AND safety_rail_reasons IS NOT NULL AND safety_rail_reasons NOT IN ('[]', '')) p) u) x
WHERE reason <> '' GROUP BY reason""", *FB_CTES))
register("feedback_stats", with_decisions(f"""
SELECT feedback_type, CAST(count(*) AS BIGINT) AS n, {rnd('avg(final_label)', 2)} AS avg_label,
  CAST(count(*) FILTER (WHERE safety_rail_triggered = 1) AS BIGINT) AS rail_hits,
  CAST(count(*) FILTER (WHERE has_feature_conflict = 1) AS BIGINT) AS conflicts,
  CAST(count(*) FILTER (WHERE model_predicted_acuity <> final_label AND model_predicted_acuity IS NOT NULL) AS BIGINT) AS model_wrong
FROM fb_flat GROUP BY feedback_type""", *FB_CTES))

register("dashboard_kpis", with_decisions(f"""
SELECT seen AS patients_seen, emerg AS emergencies, seen - acc - ovr AS pending_review, acc AS accepted, ovr AS overridden,
  {rnd("CASE WHEN ev > 0 THEN hit * 100.0 / ev ELSE 0.0 END", 6)} AS model_accuracy_pct, enr AS llm_enriched,
  {rnd('avgc', 6)} AS avg_confidence
FROM (SELECT CAST(count(*) AS BIGINT) AS seen, CAST(count(*) FILTER (WHERE final_acuity <= 2) AS BIGINT) AS emerg,
  CAST((SELECT count(*) FROM actions WHERE action = 'accept') AS BIGINT) AS acc,
  CAST((SELECT count(*) FROM overridden) AS BIGINT) AS ovr,
  count(*) FILTER (WHERE triage_acuity IS NOT NULL) AS ev, count(*) FILTER (WHERE triage_acuity = final_acuity) AS hit,
  CAST(count(*) FILTER (WHERE patient_id IN (SELECT patient_id FROM messages WHERE explained_at IS NOT NULL)) AS BIGINT) AS enr,
  avg({rnd('s1', 4)}) AS avgc FROM dec) k""", *ACT_CTES, f"messages AS ({MESSAGES_SQL})"))

register("pending_queue", with_decisions(f"""
SELECT patient_id, final_acuity AS predicted_acuity, {_label('final_acuity')} AS label, {pct('s1')} AS confidence_pct,
  trig AS safety_rail_triggered
FROM dec WHERE final_acuity <= 2 AND patient_id NOT IN (SELECT patient_id FROM accepted)
  AND patient_id NOT IN (SELECT patient_id FROM overridden)""", *ACT_CTES))

register("review_backlog", with_decisions("""
SELECT patient_id, final_acuity AS predicted_acuity, CAST(triage_acuity AS INT) AS true_acuity, trig AS safety_rail_triggered,
  has_conflict AS has_feature_conflict
FROM dec WHERE (final_acuity IN (1, 2) OR trig OR has_conflict OR coalesce(triage_acuity <> final_acuity, false))
  AND patient_id NOT IN (SELECT patient_id FROM messages WHERE explained_at IS NOT NULL)
  AND patient_id NOT IN (SELECT patient_id FROM accepted)""", *ACT_CTES, f"messages AS ({MESSAGES_SQL})"))

register("enriched_records", with_decisions("""
SELECT patient_id, final_acuity AS predicted_acuity, hx_heart_failure, hx_copd, hx_dementia, hx_hypertension FROM dec"""))

register("records_with_review", with_decisions(f"""
SELECT d.patient_id, d.final_acuity AS predicted_acuity, {rnd('x.explained_at', 6)} AS explained_at,
  x.escalation_reason, x.error_code
FROM dec d LEFT JOIN (
  SELECT m.patient_id, m.explained_at, p.escalation_reason, p.error_code
  FROM messages m JOIN parsed p ON p.response_id = m.patient_id WHERE m.explained_at IS NOT NULL) x USING (patient_id)""",
    f"messages AS ({MESSAGES_SQL})", _responses_from_dec(), *_parse_ctes("responses")))

# ---------------------------------------------------------------- evaluation and preprocessing
SCORED_CTE = "scored AS (SELECT patient_id, CAST(triage_acuity AS INT) AS true_acuity, orig AS predicted_acuity, p1, p2, p3, p4, p5 FROM dec)"

register("confusion_matrix", with_decisions("""
SELECT true_acuity AS actual, predicted_acuity AS predicted, CAST(count(*) AS BIGINT) AS n FROM scored GROUP BY 1, 2""",
                                            SCORED_CTE))

_TRAIN_LABEL = ("CASE cls WHEN 1 THEN 'KTAS 1 - Resuscitation' WHEN 2 THEN 'KTAS 2 - Emergent' WHEN 3 THEN 'KTAS 3 - Urgent' "
                "WHEN 4 THEN 'KTAS 4 - Less Urgent' WHEN 5 THEN 'KTAS 5 - Non-Urgent' END")
register("classification_report", with_decisions(f"""
SELECT {_TRAIN_LABEL} AS label, {rnd('prec', 6)} AS precision, {rnd('rec', 6)} AS recall, {rnd('f1', 6)} AS f1_score,
  CAST(support AS BIGINT) AS support FROM per
UNION ALL SELECT 'accuracy', NULL, NULL, {rnd('sum(tp) / sum(support)', 6)}, CAST(sum(support) AS BIGINT) FROM per
UNION ALL SELECT 'macro avg', {rnd('avg(prec)', 6)}, {rnd('avg(rec)', 6)}, {rnd('avg(f1)', 6)}, CAST(sum(support) AS BIGINT) FROM per
UNION ALL SELECT 'weighted avg', {rnd('sum(prec * support) / sum(support)', 6)}, {rnd('sum(rec * support) / sum(support)', 6)},
  {rnd('sum(f1 * support) / sum(support)', 6)}, CAST(sum(support) AS BIGINT) FROM per""", SCORED_CTE, """per AS (
  SELECT cls, tp, support, prec, rec, CASE WHEN prec + rec > 0 THEN 2 * prec * rec / (prec + rec) ELSE 0.0 END AS f1 FROM (
    SELECT cls, tp, support, CASE WHEN npred > 0 THEN tp / npred ELSE 0.0 END AS prec,
      CASE WHEN support > 0 THEN tp / support ELSE 0.0 END AS rec FROM (
      SELECT c.cls,
        (SELECT count(*) FROM scored s WHERE s.true_acuity = c.cls AND s.predicted_acuity = c.cls) AS tp,
        (SELECT count(*) FROM scored s WHERE s.true_acuity = c.cls) AS support,
        (SELECT count(*) FROM scored s WHERE s.predicted_acuity = c.cls) AS npred
      FROM (SELECT true_acuity AS cls FROM scored UNION SELECT predicted_acuity FROM scored) c) a) b)"""))

register("macro_auc", with_decisions(f"""
SELECT cls, {rnd('auc', 6)} AS auc FROM aucs UNION ALL SELECT 0, {rnd('avg(auc)', 6)} FROM aucs""", SCORED_CTE, """ranks AS (
  SELECT cls, pos, rank() OVER (PARTITION BY cls ORDER BY score) + (count(*) OVER (PARTITION BY cls, score) - 1) / 2.0 AS r
  FROM (SELECT cls, score, CAST(true_acuity = cls AS INT) AS pos FROM (
    SELECT true_acuity, unnest([1, 2, 3, 4, 5]) AS cls, unnest([p1, p2, p3, p4, p5]) AS score FROM scored) u) v)""", """aucs AS (
  SELECT cls, CASE WHEN sum(pos) > 0 AND sum(1 - pos) > 0
    THEN (sum(r * pos) - sum(pos) * (sum(pos) + 1) / 2.0) / (sum(pos) * sum(1 - pos)) END AS auc
  FROM ranks GROUP BY cls)"""))

register("emergency_accuracy", with_decisions(f"""
SELECT {rnd('avg(CAST((true_acuity <= 3) = (predicted_acuity <= 3) AS DOUBLE))', 6)} AS emergency_accuracy, 3 AS cutoff
FROM scored""", SCORED_CTE))

register("distribution_compare", with_decisions("""
SELECT coalesce(a.cls, p.cls) AS cls, CAST(coalesce(a.n, 0) AS BIGINT) AS actual, CAST(coalesce(p.n, 0) AS BIGINT) AS predicted
FROM (SELECT true_acuity AS cls, count(*) AS n FROM scored GROUP BY 1) a
FULL JOIN (SELECT predicted_acuity AS cls, count(*) AS n FROM scored GROUP BY 1) p ON a.cls = p.cls""", SCORED_CTE))

_TRAINING_BODY = ORACLE["training_set"][ORACLE["training_set"].index("\nSELECT patient_id, CAST(trunc("):]
TRAIN_CTES = (f"raw_target AS ({RAW_TARGET_SQL})", f"complaints AS ({COMPLAINTS_SQL})",
              f"training AS ({_TRAINING_BODY})",
              """split AS (
  SELECT t.*, CASE WHEN row_number() OVER (PARTITION BY triage_acuity ORDER BY md5(patient_id || '|42'), patient_id)
                      <= ceil(count(*) OVER (PARTITION BY triage_acuity) * 0.2) THEN 'test' ELSE 'train' END AS split
  FROM training t)""")

register("stratified_split", with_encounters("SELECT patient_id, triage_acuity, split FROM split", *TRAIN_CTES))

register("stratified_sample", with_encounters("""
SELECT patient_id, triage_acuity FROM (
  SELECT patient_id, triage_acuity, row_number() OVER (PARTITION BY triage_acuity ORDER BY md5(patient_id || '|42'), patient_id) AS rk
  FROM training) r WHERE rk <= 40 ORDER BY triage_acuity, rk LIMIT 200""", *TRAIN_CTES))

register("class_weights", with_encounters(f"""
SELECT triage_acuity, CAST(n_c AS BIGINT) AS n_c, {rnd('sum(n_c) OVER () / (count(*) OVER () * n_c)', 6)} AS class_weight
FROM (SELECT triage_acuity, count(*) AS n_c FROM split WHERE split = 'train' GROUP BY 1) c""", *TRAIN_CTES))

_MN = ["age", "heart_rate", "systolic_bp", "diastolic_bp", "respiratory_rate", "temperature_c", "spo2", "gcs_total",
       "pain_score", "news2_score"]
register("impute_scale", with_encounters(
    "SELECT patient_id, split, " + ", ".join(
        f"{rnd(f'(coalesce(CAST({c} AS DOUBLE), f.{c}_med) - f.{c}_mean) / f.{c}_scale', 6)} AS {c}" for c in _MN)
    + " FROM split CROSS JOIN fit f", *TRAIN_CTES,
    "med AS (SELECT " + ", ".join(f"quantile_cont(CAST({c} AS DOUBLE), 0.5) AS {c}_med" for c in _MN)
    + " FROM split WHERE split = 'train')",
    "fit AS (SELECT med.*, " + ", ".join(
        f"avg(coalesce(CAST(s.{c} AS DOUBLE), med.{c}_med)) AS {c}_mean, "
        f"CASE WHEN stddev_pop(coalesce(CAST(s.{c} AS DOUBLE), med.{c}_med)) > 0 "
        f"THEN stddev_pop(coalesce(CAST(s.{c} AS DOUBLE), med.{c}_med)) ELSE 1.0 END AS {c}_scale" for c in _MN)
    + " FROM split s CROSS JOIN med WHERE s.split = 'train' GROUP BY ALL)"))

register("one_hot", with_encounters("""
SELECT patient_id,
  CAST(coalesce(sex, m.sex_mode) = 'F' AS INT) AS sex_F, CAST(coalesce(sex, m.sex_mode) = 'M' AS INT) AS sex_M,
  CAST(coalesce(mental_status_triage, m.ms_mode) = '' AS INT) AS mental_status_triage_,
  CAST(coalesce(mental_status_triage, m.ms_mode) = 'alert' AS INT) AS mental_status_triage_alert,
  CAST(coalesce(mental_status_triage, m.ms_mode) = 'verbal' AS INT) AS mental_status_triage_verbal
FROM split CROSS JOIN (
  SELECT (SELECT sex FROM split WHERE split = 'train' AND sex IS NOT NULL GROUP BY sex ORDER BY count(*) DESC, sex LIMIT 1) AS sex_mode,
         (SELECT mental_status_triage FROM split WHERE split = 'train' AND mental_status_triage IS NOT NULL
          GROUP BY mental_status_triage ORDER BY count(*) DESC, mental_status_triage LIMIT 1) AS ms_mode) m""", *TRAIN_CTES))

TFIDF_CTES = (
    "docs AS (SELECT doc_id, regexp_extract_all(strip_accents(lower(coalesce(text, ''))), '[a-zA-Z]{2,}') AS tok FROM documents)",
    "grams AS (SELECT doc_id, unnest(tok || [tok[i] || ' ' || tok[i + 1] for i in range(1, len(tok))]) AS term FROM docs)",
    "tfs AS (SELECT doc_id, term, count(*) AS tf FROM grams GROUP BY 1, 2)",
    """vocab AS (
  SELECT term, ln((1 + (SELECT count(*) FROM docs)) / (1 + df)) + 1 AS idf FROM (
    SELECT term, count(*) AS df, sum(tf) AS cf FROM tfs GROUP BY term HAVING count(*) >= 2
    ORDER BY cf DESC, term LIMIT 300) v)""",
)
_FIT = (
    "med AS (SELECT " + ", ".join(f"quantile_cont(CAST({c} AS DOUBLE), 0.5) AS {c}_med" for c in _MN)
    + " FROM split WHERE split = 'train')",
    "fit AS (SELECT med.*, " + ", ".join(
        f"avg(coalesce(CAST(s.{c} AS DOUBLE), med.{c}_med)) AS {c}_mean, "
        f"CASE WHEN stddev_pop(coalesce(CAST(s.{c} AS DOUBLE), med.{c}_med)) > 0 "
        f"THEN stddev_pop(coalesce(CAST(s.{c} AS DOUBLE), med.{c}_med)) ELSE 1.0 END AS {c}_scale" for c in _MN)
    + " FROM split s CROSS JOIN med WHERE s.split = 'train' GROUP BY ALL)")


def _mode(c: str) -> str:
    return (f"(SELECT {c} FROM split WHERE split = 'train' AND {c} IS NOT NULL GROUP BY {c} "
            f"ORDER BY count(*) DESC, {c} LIMIT 1)")


register("training_features", with_encounters(
    " UNION ALL ".join(
        f"SELECT patient_id, '{c}' AS feature, "
        f"{rnd(f'(coalesce(CAST({c} AS DOUBLE), f.{c}_med) - f.{c}_mean) / f.{c}_scale', 6)} AS value "
        "FROM split CROSS JOIN fit f" for c in _MN)
    + "".join(f" UNION ALL SELECT s.patient_id, '{c}_' || k.v, 1.0 FROM split s JOIN (SELECT DISTINCT {c} AS v FROM split "
              f"WHERE split = 'train' AND {c} IS NOT NULL) k ON coalesce(s.{c}, {_mode(c)}) = k.v"
              for c in ("sex", "mental_status_triage"))
    + f""" UNION ALL SELECT patient_id, 'tfidf::' || term, {rnd('w / sqrt(sum(w * w) OVER (PARTITION BY patient_id))', 6)}
FROM (SELECT t.patient_id, t.term, (1 + ln(t.tf)) * v.idf AS w FROM ctfs t JOIN cvocab v USING (term)) x""",
    *TRAIN_CTES, *_FIT,
    "cdocs AS (SELECT patient_id, split, regexp_extract_all(strip_accents(lower(coalesce(chief_complaint_raw, ''))), "
    "'[a-zA-Z]{2,}') AS tok FROM split)",
    "cgrams AS (SELECT patient_id, split, unnest(tok || [tok[i] || ' ' || tok[i + 1] for i in range(1, len(tok))]) AS term "
    "FROM cdocs)",
    "ctfs AS (SELECT patient_id, split, term, count(*) AS tf FROM cgrams GROUP BY ALL)",
    "cvocab AS (SELECT term, ln((1 + (SELECT count(*) FROM split WHERE split = 'train')) / (1 + df)) + 1 AS idf FROM ("
    "SELECT term, count(*) AS df, sum(tf) AS cf FROM ctfs WHERE split = 'train' GROUP BY term HAVING count(*) >= 2 "
    "ORDER BY cf DESC, term LIMIT 300) v)"))

register("tfidf_vocabulary", with_encounters(f"SELECT term, {rnd('idf', 6)} AS idf FROM vocab", *TFIDF_CTES))
register("tfidf_weights", with_encounters(f"""
SELECT doc_id, term, {rnd('w / sqrt(sum(w * w) OVER (PARTITION BY doc_id))', 6)} AS weight FROM (
  SELECT t.doc_id, t.term, (1 + ln(t.tf)) * v.idf AS w FROM tfs t JOIN vocab v USING (term)) x""", *TFIDF_CTES))


# ---------------------------------------------------------------- streaming (same results as batch)
register("stream_decisions", ORACLE["decisions"])
register("stream_messages", with_decisions(f"""
SELECT run_id, patient_id, {rnd('kafka_transit_ms', 6)} AS kafka_transit_ms, {rnd('ml_inference_ms', 6)} AS ml_inference_ms,
  {rnd('safety_pipeline_ms', 6)} AS safety_pipeline_ms, {rnd('e2e_ms', 6)} AS e2e_ms,
  safety_rail_triggered, true_acuity, predicted_acuity FROM msgs""", *MSG_CTES))
