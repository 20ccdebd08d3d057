"""Review side of a decision.

Escalation gate, abnormal-vital list, history text, review prompt, and the
parser for sectioned explanation text. All are column expressions over the
decision table; the parser is an ``aggregate`` fold over the lines of a text
(a per-row state machine, no UDF). No external service is called: prompts
are built as a column for rows that pass the gate, and response texts are
parsed as data.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from acurail.constants import (
    ABNORMAL_VITAL_CHECKS, ACUITY_CLINICAL, ACUITY_LABELS, ACUITY_SHORT_LABEL, GATE_CONFLICT_LABEL,
    GATE_KTAS_RAIL_CODE, GATE_NONE, GATE_OVERRIDE, GATE_VITAL_RAILS, PROMPT, PROMPT_CONFLICT, PROMPT_CONFLICT_SENTENCE,
    PROMPT_CONFLICT_TASK, PROMPT_NO_ABNORMAL, PROMPT_TRIGGER, RESPONSE_SECTIONS,
)
from acurail.functions.columns import acuity_lookup, fmt_fixed, safe_double

# Python's str.strip() whitespace set, as a regex class usable by Java and RE2.
PY_WS = r"[\t\n\x0b\x0c\r\x1c-\x1f \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
# Python's str.splitlines() boundaries.
PY_LINES = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"


def py_strip(c: Column) -> Column:
    return F.regexp_replace(c, f"^{PY_WS}+|{PY_WS}+$", "")


def _num_text(c: Column) -> Column:
    """``str(float(x))`` for the vital values the gate and checks print."""
    return c.cast("double").cast("string")


def _const_text(x) -> str:
    return str(x)


def _falsy_null(c: Column) -> Column:
    """Python ``x or ...``: NULL and '' are both missing."""
    return F.when(c.cast("string") != "", c.cast("string"))


def _col_or_null(df: DataFrame, name: str) -> Column:
    return F.col(name) if name in df.columns else F.lit(None)


def _vital(df: DataFrame, name: str) -> Column:
    return safe_double(F.col(name)) if name in df.columns else F.lit(None).cast("double")


def _g(code, label, detail) -> Column:
    as_col = [F.lit(x) if isinstance(x, str) else x for x in (code, label, detail)]
    return F.struct(as_col[0].alias("code"), as_col[1].alias("label"), as_col[2].alias("detail"))


def escalation_gate(df: DataFrame, decision_col: str | None = None, ktas_rail: bool = False) -> DataFrame:
    """First matching trigger wins: OVERRIDE, CONFLICT, (KTAS_RAIL), VITAL_RAIL, else NONE."""
    pred, true = F.col("predicted_acuity"), F.col("true_acuity")
    branches: list[tuple[Column, Column]] = []
    if decision_col is not None:
        branches.append((F.col(decision_col) == "overridden",
                         _g(*GATE_OVERRIDE)))
    branches.append((true.isNotNull() & pred.isNotNull() & (true.cast("int") != pred.cast("int")), _g(
        "CONFLICT", GATE_CONFLICT_LABEL,
        F.concat(F.lit("Model predicted KTAS "), pred.cast("string"), F.lit(" but ground-truth is KTAS "),
                 true.cast("string"), F.lit(" — disagreement requires LLM review.")))))
    if ktas_rail:
        branches.append((pred.isin(1, 2), _g(
            GATE_KTAS_RAIL_CODE,
            F.concat(F.lit("🚨 KTAS "), pred.cast("string"), F.lit(" — Mandatory Review")),
            F.concat(F.lit("KTAS "), pred.cast("string"),
                     F.lit(" prediction is life-threatening/emergent — automatic LLM clinical review required.")))))
    for key, label, low, high in GATE_VITAL_RAILS:
        v = _vital(df, key)
        is_low = (v < low) if low is not None else F.lit(False)
        is_high = (v > high) if high is not None else F.lit(False)
        detail_low = F.concat(F.lit(f"{label} = "), _num_text(v),
                              F.lit(f" is critically LOW (threshold: ≥{_const_text(low)}) — LLM review triggered."))
        detail_high = F.concat(F.lit(f"{label} = "), _num_text(v),
                               F.lit(f" is critically HIGH (threshold: ≤{_const_text(high)}) — LLM review triggered."))
        branches.append((F.coalesce(is_low | is_high, F.lit(False)), _g(
            "VITAL_RAIL", f"📉 Critical Vital: {label}",
            F.when(F.coalesce(is_low, F.lit(False)), detail_low).otherwise(detail_high))))
    out = None
    for cond, val in branches:
        out = F.when(cond, val) if out is None else out.when(cond, val)
    out = out.otherwise(_g(*GATE_NONE))
    g = df.withColumn("_gate", out)
    return g.withColumns({
        "reason_code": F.col("_gate.code"),
        "reason_label": F.col("_gate.label"),
        "reason_detail": F.col("_gate.detail"),
    }).withColumn("should_call_llm", F.col("reason_code") != "NONE").drop("_gate")


def abnormal_vitals(df: DataFrame) -> DataFrame:
    """C17: ordered list of abnormal vital texts (LOW checked before HIGH)."""
    items = []
    for key, label, unit, low, high in ABNORMAL_VITAL_CHECKS:
        v = _vital(df, key)
        txt_low = F.concat(F.lit(f"{label} "), _num_text(v), F.lit(f"{unit} [LOW — normal ≥{_const_text(low)}]"))
        txt_high = F.concat(F.lit(f"{label} "), _num_text(v), F.lit(f"{unit} [HIGH — normal ≤{_const_text(high)}]"))
        e = None
        if low is not None:
            e = F.when(v < low, txt_low)
        if high is not None:
            e = F.when(v > high, txt_high) if e is None else e.when(v > high, txt_high)
        items.append(e)
    return df.withColumn("abnormal_vitals", F.filter(F.array(*items), lambda x: x.isNotNull()))


def history_text(df: DataFrame) -> DataFrame:
    """History block text (free text, comorbidities, arrival, mental status, injury)."""
    def first_of(*names: str) -> Column:
        return F.coalesce(*[_falsy_null(_col_or_null(df, n)) for n in names], F.lit(None).cast("string"))

    # Record order, as the reference walks the record's keys.
    hx_present = [c for c in df.columns if c.startswith("hx_") and c not in ("hx_total_burden", "hx_high_risk_flag")]
    conds = F.filter(F.array(*[
        F.when(F.coalesce(F.col(c).cast("double"), F.lit(0.0)) != 0, F.lit(c[3:].replace("_", " ").title()))
        for c in hx_present]), lambda x: x.isNotNull()) if hx_present else F.array().cast("array<string>")
    med = first_of("medical_history", "past_medical_history")
    arrival = first_of("arrival_mode", "arrival_transport")
    mental = first_of("mental_status", "mentation", "mental_status_triage")
    injury = first_of("injury_type", "mechanism_of_injury")
    lines = F.filter(F.array(
        F.when(med.isNotNull(), F.concat(F.lit("  Medical History : "), med)),
        F.when(F.size(conds) > 0, F.concat(F.lit("  Comorbidities   : "), F.array_join(conds, ", "))),
        F.when(arrival.isNotNull(), F.concat(F.lit("  Arrival Mode    : "), arrival)),
        F.when(mental.isNotNull(), F.concat(F.lit("  Mental Status   : "), mental)),
        F.when(injury.isNotNull(), F.concat(F.lit("  Injury / Mech   : "), injury)),
    ), lambda x: x.isNotNull())
    return df.withColumn("history_text", F.when(F.size(lines) > 0, F.array_join(lines, "\n"))
                         .otherwise(F.lit("  (no history data available)")))


def _prob_lines(df: DataFrame) -> Column:
    """Probability table sorted by probability (desc, stable on class order)."""
    from acurail.functions.columns import py_round
    entries = F.array(*[F.struct((-py_round(F.col(f"p{k}"), 4)).alias("neg"), F.lit(k).alias("k"),
                                 F.lit(ACUITY_LABELS[k]).alias("lbl"), py_round(F.col(f"p{k}"), 4).alias("p"))
                        for k in range(1, 6)])
    ordered = F.array_sort(entries)
    return F.array_join(F.transform(ordered, lambda e: F.concat(
        F.lit("  "), F.rpad(e["lbl"], 38, " "), F.lit(" "), F.lpad(fmt_fixed(e["p"] * 100, 1), 5, " "),
        F.lit("%  "), F.repeat(F.lit("█"), F.floor(e["p"] * 25).cast("int")), F.lit("\n"))), "")


def _filled(template: str, slots: dict[str, Column]) -> Column:
    """``template`` with its slots filled; one ``%s`` template keeps the generated code small (a long
    concat of literals and expressions exceeds what Janino compiles in one method)."""
    names = re.findall(r"\{(\w+)\}", template)
    text = re.sub(r"\{\w+\}", "%s", template.replace("%", "%%"))
    return F.format_string(text, *[F.coalesce(slots[n].cast("string"), F.lit("null")) for n in names])


def _none_text(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit("None"))


def review_prompts(df: DataFrame, only_escalated: bool = True) -> DataFrame:
    """The review prompt text for rows that pass the gate (late materialisation:
    the filter runs before the text is built)."""
    g = df if "reason_code" in df.columns else escalation_gate(df)
    if only_escalated:
        g = g.filter(F.col("should_call_llm"))
    g = history_text(abnormal_vitals(g))
    level = F.coalesce(F.col("predicted_acuity"), F.lit(5))
    lvl = level.cast("string")
    label = acuity_lookup(level, ACUITY_SHORT_LABEL, F.lit("Unknown"))
    clinical = acuity_lookup(level, ACUITY_CLINICAL, F.lit(""))
    true = F.col("true_acuity")
    conflict = true.isNotNull() & (true.cast("int") != level.cast("int"))
    true_label = acuity_lookup(true.cast("int"), ACUITY_SHORT_LABEL, true.cast("string"))
    conflict_block = F.when(conflict, _filled(PROMPT_CONFLICT, {
        "level": lvl, "label": label, "true": true, "true_label": true_label})).otherwise(F.lit(""))
    trigger = F.when(F.col("reason_code") != "NONE", _filled(PROMPT_TRIGGER, {
        c: F.col(c) for c in ("reason_label", "reason_detail")})).otherwise(F.lit(""))
    ab = F.col("abnormal_vitals")
    abnormal_str = F.when(F.size(ab) > 0, F.array_join(F.transform(ab, lambda x: F.concat(F.lit("  ⚠ "), x)), "\n")) \
        .otherwise(F.lit(PROMPT_NO_ABNORMAL))
    complaint = F.coalesce(_falsy_null(_col_or_null(df, "chief_complaint")),
                           _falsy_null(_col_or_null(df, "chief_complaint_raw")), F.lit("Not recorded"))

    def vit(name: str) -> Column:
        # Vitals always exist in the record (NULL prints as None); a missing
        # age/sex key prints '?'.
        if name in df.columns:
            return _none_text(F.col(name))
        return F.lit("?") if name in ("age", "sex") else F.lit("None")

    confidence = F.coalesce(F.col("confidence_pct"), F.lit("?")) if "confidence_pct" in df.columns else F.lit("?")
    model = F.coalesce(F.col("model"), F.lit("None")) if "model" in df.columns else F.lit("ML model")
    vitals = ("age", "sex", "heart_rate", "systolic_bp", "diastolic_bp", "spo2", "respiratory_rate", "temperature_c",
              "gcs_total", "pain_score", "news2_score")
    prompt = _filled(PROMPT, {
        "conflict": conflict_block, "trigger": trigger, "model": model, "level": lvl, "label": label, "clinical": clinical,
        "confidence": confidence, "complaint": complaint, **{name: vit(name) for name in vitals},
        "abnormal": abnormal_str, "probabilities": _prob_lines(df), "history": F.col("history_text"),
        "conflict_task": F.when(conflict, F.lit(PROMPT_CONFLICT_TASK)).otherwise(F.lit("")),
        "conflict_sentence": F.when(conflict, F.lit(PROMPT_CONFLICT_SENTENCE)).otherwise(F.lit(""))})
    return g.withColumn("prompt", prompt)


def parse_responses(df: DataFrame, text_col: str = "response_text") -> DataFrame:
    """Split a sectioned explanation into reason, summary, flags and note.

    Every line is read once (its text, the section that it heads, the inline
    text of a header), so no pattern is matched again for each use. A fold over
    these lines keeps (current section, four buffers): a header line switches
    section and may carry inline text; other lines append to the current
    section. Without a parsable reason the whole text becomes the reason.
    ``error_code`` classifies error strings by their ``GROQ_*`` prefix.
    """
    raw = F.coalesce(F.col(text_col), F.lit(""))

    named = "|".join(RESPONSE_SECTIONS)

    def read(text):
        # Only a line that names a section is looked at closely; ``stripped`` of the others is null.
        return F.struct(text.alias("text"), F.when(text.rlike(named), py_strip(text)).alias("stripped"))

    def headed(line):
        header = None
        for k in RESPONSE_SECTIONS:
            m = line["stripped"].startswith(k + ":") | (line["stripped"] == k)
            header = F.when(m, F.lit(k)) if header is None else header.when(m, F.lit(k))
        return F.struct(line["text"].alias("text"), line["stripped"].alias("stripped"), header.alias("header"))

    def with_inline(line):
        inline = py_strip(F.regexp_replace(line["stripped"].substr(F.length(line["header"]) + 1, F.lit(1 << 30)), "^:+", ""))
        return F.struct(line["header"].alias("header"), F.when(line["header"].isNull(), F.concat(line["text"], F.lit("\n")))
                        .otherwise(F.when(inline != "", F.concat(inline, F.lit("\n"))).otherwise(F.lit(""))).alias("add"))

    lines = F.transform(F.transform(F.transform(F.split(raw, PY_LINES), read), headed), with_inline)
    init = F.struct(F.lit(None).cast("string").alias("cur"),
                    *[F.lit("").alias(k) for k in RESPONSE_SECTIONS])

    def step(acc, line):
        cur = F.coalesce(line["header"], acc["cur"])
        return F.struct(cur.alias("cur"), *[F.when(cur == k, F.concat(acc[k], line["add"])).otherwise(acc[k]).alias(k)
                                            for k in RESPONSE_SECTIONS])

    parsed = F.aggregate(lines, init, step)
    out = df.withColumn("_p", parsed)
    reason = py_strip(F.col("_p.ESCALATION_REASON"))
    flags = F.filter(F.transform(F.split(F.col("_p.RISK_FLAGS"), PY_LINES),
                                 lambda ln: py_strip(F.regexp_replace(py_strip(ln), "^[-•*·]+", ""))),
                     lambda x: x != "")
    whole = py_strip(raw)
    return out.withColumns({
        "escalation_reason": F.when((reason == "") & (whole != ""), whole).otherwise(reason),
        "patient_summary": py_strip(F.col("_p.PATIENT_SUMMARY")),
        "risk_flags": flags,
        "confidence_note": py_strip(F.col("_p.CONFIDENCE_NOTE")),
        "is_ready": F.lit(True),
        "error_code": F.when(raw.startswith("GROQ_"), F.regexp_extract(raw, "^(GROQ_[A-Z_]+)", 1)),
    }).drop("_p")


def accepted_ids(actions: DataFrame) -> DataFrame:
    return actions.filter(F.col("action") == "accept").select("patient_id").distinct()


def pending_queue(decided: DataFrame, actions: DataFrame, emergencies_only: bool = True,
                  pending_only: bool = True) -> DataFrame:
    """The review board list: not accepted; optionally emergencies and undecided only."""
    out = decided.join(accepted_ids(actions), "patient_id", "left_anti")
    if emergencies_only:
        out = out.filter(F.col("is_emergency"))
    if pending_only:
        overridden = valid_overrides(actions).select("patient_id").distinct()
        out = out.join(overridden, "patient_id", "left_anti")
    return out


def valid_overrides(actions: DataFrame) -> DataFrame:
    """Override actions with a non-blank reason (others are rejected)."""
    return actions.filter((F.col("action") == "override") & (py_strip(F.coalesce(F.col("override_reason"),
                                                                                  F.lit(""))) != ""))


def review_backlog(decided: DataFrame, explanations: DataFrame, actions: DataFrame) -> DataFrame:
    """Escalation-worthy rows whose explanation is not ready and that are not accepted."""
    ready = explanations.select("patient_id").distinct()
    t, p = F.col("true_acuity"), F.col("predicted_acuity")
    esc = (p.isin(1, 2) | F.col("safety_rail_triggered") | F.col("has_feature_conflict")
           | F.coalesce(t.isNotNull() & (t != p), F.lit(False)))
    return decided.filter(esc).join(ready, "patient_id", "left_anti") \
                  .join(accepted_ids(actions), "patient_id", "left_anti")


def records_with_review(decided: DataFrame, enrichment: DataFrame) -> DataFrame:
    """Attach the first enrichment to its record by key; records without one keep NULLs.

    Of enrichments of one time the smallest counts (column by column, so they must be of orderable
    types); those without a time do not count.
    """
    cols = ["explained_at", *[c for c in enrichment.columns if c not in ("patient_id", "explained_at")]]
    first = enrichment.filter(F.col("explained_at").isNotNull()).groupBy("patient_id").agg(
        F.min(F.struct(*cols)).alias("llm_explanation"))
    return decided.join(first, "patient_id", "left")
