"""Clinician feedback and audit reports.

Feedback events wrap the whole decision record; the flat table is a typed
projection of it (arrays stored as JSON text). Audit reports are plain
aggregates over those tables: ``groupBy`` with map-side partial aggregation,
and the 5x5 matrix is a pivot over a fixed class list.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from acurail.constants import (
    FEEDBACK_ARRIVAL, FEEDBACK_CLINICAL, FEEDBACK_DECISION, FEEDBACK_DEMOGRAPHIC, FEEDBACK_FLAGS,
    FEEDBACK_GUARDRAIL, FEEDBACK_IDENTITY, FEEDBACK_INT_COLS, FEEDBACK_JSON_COLS, FEEDBACK_REAL_COLS,
    FEEDBACK_VITALS, HISTORY_COLS,
)
from acurail.operators import layers
from acurail.operators.review import py_strip

FEEDBACK_COLUMNS = (FEEDBACK_IDENTITY + FEEDBACK_DECISION + FEEDBACK_VITALS + FEEDBACK_DEMOGRAPHIC
                    + FEEDBACK_ARRIVAL + FEEDBACK_CLINICAL + HISTORY_COLS + FEEDBACK_FLAGS + FEEDBACK_GUARDRAIL)
CLASSES = [1, 2, 3, 4, 5]


def feedback_sql_type(col: str) -> str:
    """Column type chosen by name, as in the reference table definition."""
    if col in FEEDBACK_INT_COLS or col.startswith("hx_") or col.startswith("flag_"):
        return "int"
    if col in FEEDBACK_REAL_COLS:
        return "double"
    return "string"


def merge_history(decisions: DataFrame) -> DataFrame:
    """D3: history-type fields of the input next to the decision; existing keys win.

    Decisions made with ``keep_input`` carry the input's columns, so this is a projection, not a join.
    """
    extra = [c for c in decisions.columns if c.startswith("hx_") or c in (
        "medical_history", "past_medical_history", "arrival_mode", "arrival_transport",
        "mental_status", "mentation", "injury_type", "mechanism_of_injury")]
    kept = [c for c in layers.DECISION_COLUMNS if c in decisions.columns]
    return decisions.select(*dict.fromkeys([*kept, *extra]))


def feedback_events(decided: DataFrame, actions: DataFrame) -> DataFrame:
    """A8 + C22 + C23: one event per clinician action; blank override reasons are rejected.

    ``patient`` carries the whole decision record as a struct.
    """
    acts = actions.filter(
        (F.col("action") == "accept")
        | ((F.col("action") == "override") & (py_strip(F.coalesce(F.col("override_reason"), F.lit(""))) != "")))
    rec_cols = [c for c in decided.columns if c != "patient_id"]
    joined = acts.join(decided.select("patient_id", F.struct(
        F.col("patient_id"), *[F.col(c) for c in rec_cols]).alias("patient")), "patient_id", "inner")
    is_override = F.col("action") == "override"
    chosen = F.coalesce(F.col("override_acuity"), F.col("patient.predicted_acuity"))
    ftype = F.when(is_override, F.lit("override")).otherwise(_accept_type_nested())
    return joined.select(
        "patient_id",
        F.lit("clinician_feedback").alias("event_type"),
        ftype.alias("feedback_type"),
        F.when(is_override, chosen).otherwise(F.col("patient.predicted_acuity")).cast("int").alias("final_label"),
        F.when(is_override, py_strip(F.col("override_reason"))).alias("override_reason"),
        F.when(is_override, chosen).cast("int").alias("override_ktas"),
        "patient",
        F.current_timestamp().alias("submitted_at"),
    )


def _accept_type_nested() -> Column:
    p = lambda c: F.col(f"patient.{c}")
    changed = p("original_acuity") != p("predicted_acuity")
    return F.when(changed | p("safety_rail_triggered") | p("confidence_state").isin("AMBIGUOUS", "LOW")
                  | p("has_feature_conflict"), F.lit("guardrail_accepted")).otherwise(F.lit("accepted"))


def feedback_flat(events: DataFrame) -> DataFrame:
    """The 99-column typed feedback row; events without a label are skipped."""
    rec = {f.name for f in events.schema["patient"].dataType.fields}

    def from_record(c: str) -> Column:
        if c in rec:
            v = F.col(f"patient.{c}")
            if c in FEEDBACK_JSON_COLS:
                return F.to_json(v)
            if c in ("safety_rail_triggered", "has_feature_conflict", "requires_review"):
                return F.coalesce(v, F.lit(False)).cast("int")
            return v.cast(feedback_sql_type(c))
        if c in FEEDBACK_JSON_COLS:
            return F.lit("[]")
        return F.lit(None).cast(feedback_sql_type(c))

    special = {
        "feedback_type": F.col("feedback_type"),
        "final_label": F.col("final_label").cast("int"),
        "override_reason": F.col("override_reason"),
        "model_predicted_acuity": F.col("patient.original_acuity").cast("int"),
        "guardrail_acuity": F.col("patient.predicted_acuity").cast("int"),
        "chief_complaint": from_record("chief_complaint") if "chief_complaint" in rec
        else from_record("chief_complaint_raw"),
    }
    cols = [(special[c] if c in special else from_record(c)).alias(c) for c in FEEDBACK_COLUMNS]
    return events.filter(F.col("final_label").isNotNull()).select(*cols)


def override_rows(flat: DataFrame) -> DataFrame:
    """Audit rows for the override matrix (everything except explanation events)."""
    return flat.filter(F.col("feedback_type") != "llm_explained").select(
        "patient_id", "feedback_type", "model_predicted_acuity", "guardrail_acuity", "final_label",
        "safety_rail_triggered", "safety_rail_reasons")


def override_matrix(overrides: DataFrame) -> DataFrame:
    """Counts by (model class, clinician label), nulls excluded."""
    return overrides.filter(F.col("model_predicted_acuity").isNotNull() & F.col("final_label").isNotNull()) \
        .groupBy("model_predicted_acuity", "final_label").agg(F.count(F.lit(1)).alias("cnt"))


def override_matrix_dense(overrides: DataFrame) -> DataFrame:
    """Dense 5x5 matrix with zeros (fixed class spine, pivot on known values)."""
    spark = overrides.sparkSession
    spine = spark.createDataFrame([(k,) for k in CLASSES], "model_predicted_acuity int")
    m = override_matrix(overrides).groupBy("model_predicted_acuity").pivot("final_label", CLASSES).agg(
        F.sum("cnt"))
    out = spine.join(m, "model_predicted_acuity", "left")
    return out.select("model_predicted_acuity", *[F.coalesce(F.col(str(k)), F.lit(0)).cast("long").alias(f"label_{k}")
                                                  for k in CLASSES])


def override_summary(overrides: DataFrame) -> DataFrame:
    """Total, diagonal (accepted), off-diagonal (corrected) and their percents."""
    m = override_matrix(overrides).filter(F.col("model_predicted_acuity").isin(*CLASSES)
                                          & F.col("final_label").isin(*CLASSES))
    agg = m.agg(F.coalesce(F.sum("cnt"), F.lit(0)).alias("total"),
                F.coalesce(F.sum(F.when(F.col("model_predicted_acuity") == F.col("final_label"), F.col("cnt"))),
                           F.lit(0)).alias("diagonal"))
    t = F.col("total")
    return agg.withColumns({
        "off_diagonal": t - F.col("diagonal"),
        "diagonal_pct": F.when(t > 0, F.col("diagonal") * 100.0 / t),
        "off_diagonal_pct": F.when(t > 0, (t - F.col("diagonal")) * 100.0 / t),
    })


def rail_reasons(overrides: DataFrame, strict: bool = False) -> DataFrame:
    """Rank fired rail reasons by the text left of the arrow.

    Default counts distinct (patient, reason list) pairs, as the reference
    does; ``strict`` counts distinct (patient, reason) pairs instead.
    """
    base = overrides.filter((F.col("safety_rail_triggered") == 1) & F.col("safety_rail_reasons").isNotNull()
                            & ~F.col("safety_rail_reasons").isin("[]", ""))
    pairs = base.select("patient_id", "safety_rail_reasons").distinct()
    items = pairs.select("patient_id", F.explode(F.from_json("safety_rail_reasons", "array<string>")).alias("r"))
    label = F.when(F.col("r").contains("→"), py_strip(F.split(F.col("r"), "→")[0])).otherwise(F.col("r"))
    items = items.select("patient_id", label.alias("reason")).filter(F.col("reason") != "")
    if strict:
        items = items.distinct()
    return items.groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def combine_partials(partials: DataFrame) -> DataFrame:
    """E13 from any number of ``feedback_partials`` tables."""
    from acurail.functions.columns import py_round
    return partials.groupBy("feedback_type").agg(
        F.sum("n").alias("n"),
        py_round(F.sum("label_sum") / F.sum("labelled"), 2).alias("avg_label"),
        *[F.sum(c).alias(c) for c in ("rail_hits", "conflicts", "model_wrong")])


def feedback_stats(flat: DataFrame) -> DataFrame:
    """Per feedback type: n, average label (2 places), rail hits, conflicts, model wrong."""
    return combine_partials(feedback_partials(flat))


def feedback_partials(flat: DataFrame) -> DataFrame:
    """E13 as sums that add up over parts of the table."""
    return flat.groupBy("feedback_type").agg(
        F.count(F.lit(1)).alias("n"), F.sum("final_label").alias("label_sum"), F.count("final_label").alias("labelled"),
        F.count_if(F.col("safety_rail_triggered") == 1).alias("rail_hits"),
        F.count_if(F.col("has_feature_conflict") == 1).alias("conflicts"),
        F.count_if((F.col("model_predicted_acuity") != F.col("final_label"))
                   & F.col("model_predicted_acuity").isNotNull()).alias("model_wrong"),
    )


def dashboard_kpis(records: DataFrame, actions: DataFrame, explanations: DataFrame) -> DataFrame:
    """Patients seen, emergencies, pending, accepted, overridden, accuracy, enriched, avg confidence.

    ``records`` is the board's record set (all decisions, or ``recent_records``
    for the live window). Action and explanation sides are reduced to one row
    per patient before the join.
    """
    from acurail.operators.review import valid_overrides
    acc = actions.filter(F.col("action") == "accept").groupBy("patient_id").agg(
        F.count(F.lit(1)).alias("_acc"))
    ovr = valid_overrides(actions).select("patient_id").distinct().withColumn("_ovr", F.lit(1))
    exp = explanations.select("patient_id").distinct().withColumn("_exp", F.lit(1))
    r = records.select("patient_id", "is_emergency", "true_acuity", "predicted_acuity", "confidence") \
        .join(acc, "patient_id", "left").join(ovr, "patient_id", "left").join(exp, "patient_id", "left")
    t, p = F.col("true_acuity"), F.col("predicted_acuity")
    agg = r.agg(
        F.count(F.lit(1)).alias("patients_seen"),
        F.count_if(F.col("is_emergency")).alias("emergencies"),
        F.coalesce(F.sum("_acc"), F.lit(0)).alias("accepted"),
        F.count_if(F.col("_ovr") == 1).alias("overridden"),
        F.count_if(t.isNotNull()).alias("_eval"),
        F.count_if(t.isNotNull() & (t == p)).alias("_hit"),
        F.count_if(F.col("_exp") == 1).alias("llm_enriched"),
        F.avg("confidence").alias("avg_confidence"),
    )
    return agg.select(
        "patients_seen", "emergencies",
        (F.col("patients_seen") - F.col("accepted") - F.col("overridden")).alias("pending_review"),
        "accepted", "overridden",
        F.when(F.col("_eval") > 0, F.col("_hit") * 100.0 / F.col("_eval")).otherwise(F.lit(0.0))
        .alias("model_accuracy_pct"),
        "llm_enriched", "avg_confidence",
    )
