"""The decision layers: base prediction, safety rails, confidence, conflicts.

All layers are row-local ``DataFrame -> DataFrame`` transforms (narrow
dependencies only): they add columns with built-in expressions, never
shuffle, and run unchanged on a streaming DataFrame.

Column contract
---------------
input   : patient_id, vitals (heart_rate ... news2_score), age,
          mental_status_triage, chief_complaint_raw, hx_*, and class
          probabilities p1..p5.
output  : the decision columns listed in ``DECISION_COLUMNS``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from acurail.constants import (
    ACUITY_LABELS, CONF_AMB_GAP, CONF_HIGH_GAP, CONF_HIGH_MIN, CONF_LOW_MAX,
    EMERGENCY_MAX_DECISION,
)
from acurail.functions.columns import color_of, compact_strings, fmt_fixed, label_of, py_round
from acurail.operators.rules import (
    conflict_rules, rail_rule_combo, rail_rules_a, rail_rules_b, vitals_of,
)
from acurail.session import compile_long_rows

PROB_COLS = ["p1", "p2", "p3", "p4", "p5"]
CLASSES = [1, 2, 3, 4, 5]


def _pct(c: Column) -> Column:
    return F.concat(fmt_fixed(c * 100, 1), F.lit("%"))


def _argmax(vals: list[Column]) -> tuple[Column, Column]:
    """(class, value) of the largest value; the first class wins ties."""
    top = F.greatest(*vals)
    cls = F.coalesce(*[F.when(v == top, F.lit(k)) for k, v in zip(CLASSES, vals)])
    return cls, top


def base_prediction(df: DataFrame, model_name: str = "unknown",
                    emergency_max: int = EMERGENCY_MAX_DECISION) -> DataFrame:
    """Argmax class, confidence, label, colour, emergency flag, probability map."""
    p = [F.col(c) for c in PROB_COLS]
    cls, top = _argmax(p)
    out = df.withColumns({"original_acuity": cls.cast("int"), "_top1_p": top})
    o = F.col("original_acuity")
    return out.withColumns({
        "predicted_acuity": o,
        "true_acuity": F.col("triage_acuity").cast("int") if "triage_acuity" in df.columns
        else (F.col("true_acuity").cast("int") if "true_acuity" in df.columns else F.lit(None).cast("int")),
        "label": label_of(o),
        "color": color_of(o),
        "confidence": py_round(F.col("_top1_p"), 4),
        "confidence_pct": _pct(F.col("_top1_p")),
        "is_emergency": o <= emergency_max,
        "probabilities": F.create_map(*[x for k in CLASSES
                                        for x in (F.lit(ACUITY_LABELS[k]), py_round(F.col(f"p{k}"), 4))]),
        "model": F.lit(model_name),
    })


def safety_rails(df: DataFrame) -> DataFrame:
    """Deterministic floors on the original class, with reasons and note.

    Closed form of the sequential rules: all A rules that fire are listed;
    at most one B/C rule fires (the first, only when no A fired and the class
    is above 2); the hypoxia+hypotension combo fires when no A fired and the
    class is above 1.
    """
    v = vitals_of(df)
    orig = F.col("original_acuity")
    a_rules = rail_rules_a(v)
    a_reasons = compact_strings(*[F.when(F.coalesce(pred, F.lit(False)), txt) for _, pred, txt in a_rules])
    any_a = F.lit(False)
    for _, pred, _ in a_rules:
        any_a = any_a | F.coalesce(pred, F.lit(False))
    b_reason = F.when(~any_a & (orig > 2),
                      F.coalesce(*[F.when(F.coalesce(pred, F.lit(False)), txt)
                                   for _, pred, txt in rail_rules_b(v)]))
    _, combo_pred, combo_txt = rail_rule_combo(v)
    combo = F.when(~any_a & (orig > 1) & F.coalesce(combo_pred, F.lit(False)), combo_txt)

    out = df.withColumns({"_any_a": any_a, "_a_reasons": a_reasons, "_b_reason": b_reason, "_combo": combo})
    rail = (F.when(F.col("_any_a") | F.col("_combo").isNotNull(), F.lit(1))
            .when(F.col("_b_reason").isNotNull(), F.lit(2)).otherwise(orig))
    reasons = F.concat(F.col("_a_reasons"), compact_strings(F.col("_b_reason"), F.col("_combo")))
    out = out.withColumns({"rail_acuity": rail.cast("int"), "safety_rail_reasons": reasons})
    trig = F.size("safety_rail_reasons") > 0
    joined = F.array_join("safety_rail_reasons", "; ")
    note = F.when(trig, F.when(
        F.col("rail_acuity") != orig,
        F.concat(F.lit("Safety rails escalated KTAS-"), orig.cast("string"), F.lit(" → KTAS-"),
                 F.col("rail_acuity").cast("string"), F.lit(": "), joined),
    ).otherwise(F.concat(F.lit("Safety rails confirmed KTAS-"), F.col("rail_acuity").cast("string"),
                         F.lit(" (no escalation needed): "), joined)))
    return out.withColumns({"safety_rail_triggered": trig, "rail_note": note}) \
              .drop("_any_a", "_a_reasons", "_b_reason", "_combo")


def confidence_states(df: DataFrame) -> DataFrame:
    """Top-2 ranking of the raw probabilities and the confidence state."""
    p = [F.col(c) for c in PROB_COLS]
    c1, s1 = _argmax(p)
    out = df.withColumns({"_c1": c1, "_s1": s1})
    rest = [F.when(F.col("_c1") == k, F.lit(None).cast("double")).otherwise(F.col(f"p{k}")) for k in CLASSES]
    c2, s2 = _argmax(rest)
    out = out.withColumns({"_c2": c2, "_s2": s2})
    s1c, s2c = F.col("_s1"), F.col("_s2")
    gap = s1c - s2c
    known = s1c.isNotNull()
    state = (F.when(~known, F.lit("UNKNOWN"))
             .when((s1c >= CONF_HIGH_MIN) & (gap >= CONF_HIGH_GAP), F.lit("HIGH"))
             .when((s1c >= CONF_LOW_MAX) & (gap >= CONF_AMB_GAP), F.lit("MODERATE"))
             .when((s1c >= CONF_LOW_MAX) & (gap < CONF_AMB_GAP), F.lit("AMBIGUOUS"))
             .otherwise(F.lit("LOW")))
    return out.withColumns({
        "confidence_state": state,
        "_gap": F.when(known, gap),
        "confidence_gap": F.when(known, py_round(gap, 4)),
        "confidence_top1_acuity": F.col("_c1").cast("int"),
        "confidence_top2_acuity": F.when(known, F.col("_c2")).cast("int"),
        "confidence_top2_pct": F.when(known, _pct(s2c)),
    })


def resolve_confidence(df: DataFrame, current: str = "rail_acuity") -> DataFrame:
    """Conservative resolution of AMBIGUOUS / LOW states on the current class."""
    cur = F.col(current)
    st = F.col("confidence_state")
    c1, c2 = F.col("_c1"), F.col("_c2")
    conservative = F.least(c1, c2)
    low_esc = F.greatest(F.lit(1), cur - 1)
    # One reference to the current class: LOW steps down by one (not below 1),
    # AMBIGUOUS takes the more severe of the top two when that is lower.
    acuity = F.greatest(F.lit(1), F.least(
        cur - F.when(st == "LOW", 1).otherwise(0),
        F.when(st == "AMBIGUOUS", conservative).otherwise(F.lit(99))))
    g3 = fmt_fixed(F.col("_gap"), 3)
    s1p, s2p = fmt_fixed(F.col("_s1") * 100, 1), fmt_fixed(F.col("_s2") * 100, 1)
    note = (
        F.when((st == "AMBIGUOUS") & (conservative < cur), F.concat(
            F.lit("AMBIGUOUS: KTAS-"), c1.cast("string"), F.lit(" ("), s1p, F.lit("%) vs KTAS-"),
            c2.cast("string"), F.lit(" ("), s2p, F.lit("%), gap="), g3, F.lit(" — escalated to KTAS-"),
            conservative.cast("string")))
        .when(st == "AMBIGUOUS", F.concat(
            F.lit("AMBIGUOUS: gap="), g3, F.lit(" between KTAS-"), c1.cast("string"), F.lit(" and KTAS-"),
            c2.cast("string"), F.lit(" — conservative choice already active")))
        .when(st == "LOW", F.concat(
            F.lit("LOW confidence ("), s1p, F.lit("%) — escalated KTAS-"), cur.cast("string"),
            F.lit(" → KTAS-"), low_esc.cast("string"), F.lit(", flagged for review")))
        .when(st.isin("HIGH", "MODERATE"), F.concat(
            st, F.lit(" confidence ("), s1p, F.lit("%, gap="), g3, F.lit(") — prediction stands")))
    )
    return df.withColumns({
        "conf_acuity": acuity.cast("int"),
        "conf_note": note,
        "conf_review": st.isin("AMBIGUOUS", "LOW"),
    })


def feature_conflicts(df: DataFrame, current: str = "conf_acuity") -> DataFrame:
    """Conflicts against the original class; final = least(current, floors)."""
    v = vitals_of(df)
    orig = F.col("original_acuity")
    rules = conflict_rules(v, orig)
    fired = [(code, F.coalesce(pred, F.lit(False)), floor, txt) for code, pred, floor, txt in rules]
    out = df.withColumns({
        "conflict_reasons": compact_strings(*[F.when(p, txt) for _, p, _, txt in fired]),
        "conflict_codes": compact_strings(*[F.when(p, F.lit(code)) for code, p, _, _ in fired]),
        "_floor": F.least(*[F.when(p, F.lit(floor)) for _, p, floor, _ in fired]),
    })
    cur = F.col(current)
    has = F.size("conflict_reasons") > 0
    escalate_to = F.least(cur, F.coalesce(F.col("_floor"), F.lit(99)))
    joined = F.array_join("conflict_reasons", " | ")
    escalated = has & (escalate_to < orig)
    out = out.withColumns({
        "has_feature_conflict": has,
        "final_acuity": escalate_to.cast("int"),
        "conflict_review": escalated,
        "conflict_note": F.when(escalated, F.concat(
            F.lit("CONFLICT escalated KTAS-"), orig.cast("string"), F.lit(" → KTAS-"),
            escalate_to.cast("string"), F.lit(": "), joined))
        .when(has, F.concat(F.lit("CONFLICT detected but acuity already at correct level: "), joined)),
    })
    return out.drop("_floor")


DECISION_COLUMNS = [
    "patient_id", "original_acuity", "predicted_acuity", "true_acuity", "label", "color",
    "confidence", "confidence_pct", "confidence_state", "confidence_gap",
    "confidence_top2_acuity", "confidence_top2_pct", "is_emergency",
    "safety_rail_triggered", "safety_rail_reasons", "has_feature_conflict", "conflict_reasons",
    "requires_review", "safety_notes", "intervention_flags", "model",
]


def decisions(df: DataFrame, model_name: str = "unknown", keep_input: bool = True,
              emergency_max: int = EMERGENCY_MAX_DECISION) -> DataFrame:
    """Prediction -> rails -> confidence -> conflicts, then label/colour sync.

    ``keep_input`` keeps the input columns (vitals, history, demographics)
    next to the decision, which is what the enrichment merge (D3) needs.
    """
    compile_long_rows(df.sparkSession)
    out = base_prediction(df, model_name=model_name, emergency_max=emergency_max)
    out = safety_rails(out)
    out = confidence_states(out)
    out = resolve_confidence(out)
    out = feature_conflicts(out)
    final = F.col("final_acuity")
    st = F.col("confidence_state")
    out = out.withColumns({
        "predicted_acuity": final,
        "label": label_of(final),
        "color": color_of(final),
        "is_emergency": final <= emergency_max,
        "requires_review": F.col("conf_review") | F.col("conflict_review"),
        "safety_notes": compact_strings(F.col("rail_note"), F.col("conf_note"), F.col("conflict_note")),
        "intervention_flags": compact_strings(
            F.when(F.col("safety_rail_triggered"), F.lit("RAIL")),
            F.when(st.isin("AMBIGUOUS", "LOW"), st),
            F.when(F.col("has_feature_conflict"), F.lit("CONFLICT"))),
    })
    internal = [c for c in out.columns if c.startswith("_")] + [
        "final_acuity", "conf_review", "conflict_review"]
    out = out.drop(*internal)
    if not keep_input:
        extra = [c for c in ("run_id", "rail_acuity", "conf_acuity", "confidence_top1_acuity")
                 if c in out.columns]
        out = out.select(*DECISION_COLUMNS, *extra)
    return out


def materialize(df: DataFrame) -> DataFrame:
    """Store decisions as Parquet in the shared checkpoint folder (lineage cut, readers prune columns).

    Filter or aggregate decision columns *after* this (or on the stored
    decision sink): pushing a predicate on e.g. ``predicted_acuity`` down
    through the rule layers makes Catalyst inline every layer into the
    predicate, which grows the plan multiplicatively.
    """
    from acurail.session import stored
    return stored(df, "decisions")


def decision_record(df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Nested decision record (struct ``vitals``, map ``probabilities``) for publishing; ``keep`` names further columns."""
    from acurail.constants import VITAL_FIELDS
    cols = set(df.columns)
    vit = F.struct(*[(F.col(c) if c in cols else F.lit(None)).cast("double").alias(c) for c in VITAL_FIELDS])
    base = [c for c in DECISION_COLUMNS if c in cols]
    extra = [c for c in ("timestamp", "run_id", "age", "sex", "chief_complaint_raw") if c in cols]
    return df.select(*keep, *base, *extra, vit.alias("vitals"),
                     F.col("chief_complaint_raw").alias("chief_complaint") if "chief_complaint_raw" in cols
                     else F.lit("").alias("chief_complaint"),
                     F.current_timestamp().alias("processed_at"))
