"""Readers for the driver parquet tables and the deterministic encounter view.

The encounter view (FIXTURES.md section 1) turns each ``events`` row into a
patient record with vitals, history and class probabilities. It is written as
pure column expressions over a single ``events`` scan: the class weights and
the complaint lookup are row-local, so the view needs no self-join and no
shuffle, and Catalyst prunes the scan to ``event_id, ts, user_id``.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from acurail.session import compile_long_rows

# FIXED VALUES: complaint texts of the fixture, indexed 0..22.
FIXTURE_COMPLAINTS = [
    "Cardiac arrest witnessed by family", "chest pain with diaphoresis",
    "acute stroke symptoms", "abdominal pain", "fracture with deformity",
    "laceration", "mild headache", "sprained ankle", "prescription refill request",
    "mild sore throat", "cold symptoms", " Follow-up after discharge ", "syncope",
    "feeling unwell", "suspected drug overdose", "ear pain",
    "acute back pain with radiation", "", "moderate pain", "insect bite",
    "lower back pain", "itchy skin", "knee swelling",
]


def table_path(sf_dir: str, name: str) -> str:
    return os.path.join(sf_dir, f"{name}.parquet")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Parquet scan of one driver table; column pruning and filter pushdown
    are left to Catalyst (select only what you need downstream)."""
    return ensure_parallelism(spark.read.parquet(table_path(sf_dir, name)))


def ensure_parallelism(df: DataFrame) -> DataFrame:
    """Spread an under-split scan over the available cores.

    A small table stored as one parquet row group scans as one task, and the
    CPU-heavy rule layers then run on one core. Only when the scan has fewer
    partitions than ``defaultParallelism`` is it round-robin repartitioned;
    large inputs (many files / row groups) already split and are untouched,
    so no shuffle is added at scale.
    """
    try:
        target = df.sparkSession.sparkContext.defaultParallelism
        current = df.rdd.getNumPartitions()
    except Exception:  # noqa: BLE001 - e.g. Spark Connect sessions expose no RDD API
        return df
    return df.repartition(target) if current < target else df


def _class_weight(mult: int, mod: int, cls: int) -> str:
    return (
        f"CASE WHEN event_id % 13 = 0 THEN 1 ELSE 1 + (event_id*{mult}) % {mod} END"
        f" + CASE WHEN (event_id*11) % 5 = {cls} THEN 28 + (event_id*17) % 60 ELSE 0 END"
        f" + CASE WHEN event_id % 13 = 0 AND (event_id*11+1) % 5 = {cls}"
        f" THEN 22 + (event_id*17) % 60 ELSE 0 END"
    )


_ENCOUNTER_EXPRS = [
    "event_id",
    "concat('P', lpad(CAST(event_id AS STRING), 8, '0')) AS patient_id",
    "concat('R', CAST(user_id % 10 AS STRING)) AS run_id",
    "ts AS arrival_ts",
    "CAST(1 + (event_id*11 + CASE WHEN event_id % 4 = 0 THEN 1 ELSE 0 END) % 5 AS INT) AS triage_acuity",
    "CASE WHEN event_id % 23 = 5 THEN NULL ELSE CAST(1 + (event_id*31) % 97 AS INT) END AS age",
    "CASE WHEN event_id % 2 = 0 THEN 'M' ELSE 'F' END AS sex",
    "CASE WHEN (event_id*3+1) % 7 = 0 THEN 'verbal' WHEN event_id % 29 = 0 THEN '' ELSE 'alert' END"
    " AS mental_status_triage",
    "CASE WHEN event_id % 53 = 7 THEN CAST(148 AS DOUBLE) WHEN event_id % 61 = 4 THEN CAST(118 AS DOUBLE)"
    " WHEN event_id % 19 = 1 THEN NULL WHEN (event_id*13+3) % 7 = 0 THEN CAST(25 + (event_id*37) % 170 AS DOUBLE)"
    " ELSE CAST(65 + (event_id*37) % 50 AS DOUBLE) END AS heart_rate",
    "CASE WHEN event_id % 53 = 7 THEN CAST(96 AS DOUBLE) WHEN event_id % 59 = 3 THEN CAST(82 AS DOUBLE)"
    " WHEN event_id % 19 = 2 THEN NULL WHEN (event_id*17+1) % 11 = 0 THEN CAST(50 + (event_id*53) % 151 AS DOUBLE)"
    " ELSE CAST(95 + (event_id*53) % 60 AS DOUBLE) END AS systolic_bp",
    "CAST(50 + (event_id*43) % 45 AS DOUBLE) AS diastolic_bp",
    "CASE WHEN event_id % 61 = 4 THEN CAST(24 AS DOUBLE) WHEN event_id % 19 = 3 THEN NULL"
    " WHEN (event_id*5+2) % 13 = 0 THEN CAST(6 + (event_id*41) % 37 AS DOUBLE)"
    " ELSE CAST(11 + (event_id*41) % 14 AS DOUBLE) END AS respiratory_rate",
    "CASE WHEN event_id % 61 = 4 THEN CAST(389 AS DOUBLE)/10 WHEN event_id % 19 = 4 THEN NULL"
    " WHEN (event_id*19+4) % 17 = 0 THEN CAST(310 + (event_id*29) % 103 AS DOUBLE)/10"
    " ELSE CAST(362 + (event_id*29) % 28 AS DOUBLE)/10 END AS temperature_c",
    "CASE WHEN event_id % 59 = 3 THEN CAST(90 AS DOUBLE) WHEN event_id % 19 = 5 THEN NULL"
    " WHEN (event_id*23+6) % 9 = 0 THEN CAST(82 + (event_id*47) % 14 AS DOUBLE)"
    " ELSE CAST(94 + (event_id*47) % 7 AS DOUBLE) END AS spo2",
    "CASE WHEN event_id % 19 = 6 THEN NULL WHEN (event_id*7+5) % 16 = 0 THEN CAST(3 + (event_id*59) % 12 AS INT)"
    " ELSE 15 END AS gcs_total",
    "CAST((event_id*61) % 11 AS INT) AS pain_score",
    "CASE WHEN event_id % 19 = 7 THEN NULL WHEN (event_id*67+8) % 8 = 0 THEN CAST((event_id*71) % 17 AS INT)"
    " ELSE CAST((event_id*71) % 4 AS INT) END AS news2_score",
    "CAST(CASE WHEN (event_id*73) % 12 = 0 THEN 1 ELSE 0 END AS INT) AS hx_heart_failure",
    "CAST(CASE WHEN (event_id*79) % 14 = 3 THEN 1 ELSE 0 END AS INT) AS hx_copd",
    "CASE WHEN event_id % 31 = 0 THEN NULL ELSE CAST(CASE WHEN (event_id*83) % 15 = 4 THEN 1 ELSE 0 END AS INT) END"
    " AS hx_dementia",
    "CAST(CASE WHEN (event_id*89) % 4 = 1 THEN 1 ELSE 0 END AS INT) AS hx_hypertension",
]


def encounters(spark: SparkSession, sf_dir: str, events: DataFrame | None = None) -> DataFrame:
    """One patient record per event: input fields plus class probabilities p1..p5."""
    compile_long_rows(spark)
    ev = events if events is not None else read_table(spark, sf_dir, "events")
    complaints_arr = F.array(*[F.lit(t) for t in FIXTURE_COMPLAINTS])
    weights = {
        "w1": _class_weight(3, 9, 0), "w2": _class_weight(5, 9, 1), "w3": _class_weight(7, 11, 2),
        "w4": _class_weight(2, 11, 3), "w5": _class_weight(4, 13, 4),
    }
    df = ev.select("event_id", "ts", "user_id")
    df = df.select(
        *[F.expr(e) for e in _ENCOUNTER_EXPRS],
        F.element_at(complaints_arr, ((F.col("event_id") * 97 + 5) % 23 + 1).cast("int")).alias("chief_complaint_raw"),
        *[F.expr(f"CAST({w} AS DOUBLE)").alias(k) for k, w in weights.items()],
    )
    total = F.col("w1") + F.col("w2") + F.col("w3") + F.col("w4") + F.col("w5")
    return df.select(
        *[c for c in df.columns if not c.startswith("w")],
        *[(F.col(f"w{i}") / total).alias(f"p{i}") for i in range(1, 6)],
    )


def _stage_ms() -> tuple:
    eid = F.col("event_id")
    t0 = eid * 1500 + (eid * 7) % 400
    t1 = t0 + 50 + (eid * 13) % 260
    t2 = t1 + 20 + (eid * 29) % 45
    t3 = t2 + (eid * 31) % 3
    return t0, t1, t2, t3


def message_times(df: DataFrame) -> DataFrame:
    """Add the per-message stage timestamps (epoch seconds), FIXTURES.md section 2.

    Row-local: applied to any frame that carries ``event_id`` (for example
    the decisions), so the message table needs no join back to encounters.
    """
    t0, t1, t2, t3 = _stage_ms()
    return df.withColumns({
        "produced_at": t0.cast("double") / 1000,
        "consumer_received_at": t1.cast("double") / 1000,
        "ml_done_at": t2.cast("double") / 1000,
        "safety_done_at": t3.cast("double") / 1000,
    })


def explanation_events(enc: DataFrame) -> DataFrame:
    """Enrichment arrivals: one explanation for 1 in 3 patients, half without a request time."""
    eid = F.col("event_id")
    t3ms = _stage_ms()[3]
    return enc.filter(eid % 3 == 0).select(
        "patient_id",
        F.when(eid % 6 != 0, (t3ms + 2).cast("double") / 1000).alias("enrichment_requested_at"),
        ((t3ms + 502 + (eid * 37) % 1500).cast("double") / 1000).alias("explained_at"),
    )


def complaints(enc: DataFrame) -> DataFrame:
    """Complaint side table with duplicate and missing keys."""
    first = enc.filter(F.col("event_id") % 17 != 0).select(
        "patient_id", "chief_complaint_raw", F.lit(0).cast("int").alias("ord"))
    repeat = enc.filter(F.col("event_id") % 10 == 0).select(
        "patient_id", F.concat("chief_complaint_raw", F.lit(" (repeat)")).alias("chief_complaint_raw"),
        F.lit(1).cast("int").alias("ord"))
    return first.unionByName(repeat)


def raw_target(enc: DataFrame) -> DataFrame:
    """Text target with unparsable, out-of-range, fractional and null values."""
    eid = F.col("event_id")
    return enc.select(
        "patient_id",
        F.when(eid % 37 == 0, "x").when(eid % 41 == 0, "7").when(eid % 43 == 0, "2.5")
        .when(eid % 47 == 0, F.lit(None).cast("string"))
        .otherwise(F.col("triage_acuity").cast("string")).alias("triage_acuity_raw"),
    )


def clinician_actions(enc: DataFrame) -> DataFrame:
    """Accept / override actions (1 in 5 rows has none); some override reasons are blank."""
    eid = F.col("event_id")
    return enc.filter(eid % 5 != 4).select(
        "patient_id",
        F.when(eid % 5 == 0, "override").otherwise("accept").alias("action"),
        F.when(eid % 5 == 0, (1 + (eid * 7) % 5).cast("int")).alias("override_acuity"),
        F.when(eid % 25 == 0, "  ").when(eid % 5 == 0, "clinical judgement").alias("override_reason"),
    )


def training_main(enc: DataFrame) -> DataFrame:
    """Main encounter table of the training job: raw text target plus vitals and
    demographics (history and complaint live in their own tables)."""
    eid = F.col("event_id")
    raw = (F.when(eid % 37 == 0, "x").when(eid % 41 == 0, "7").when(eid % 43 == 0, "2.5")
           .when(eid % 47 == 0, F.lit(None).cast("string"))
           .otherwise(F.col("triage_acuity").cast("string")))
    return enc.select(
        "patient_id", raw.alias("triage_acuity"), "age", "sex", "mental_status_triage",
        "heart_rate", "systolic_bp", "diastolic_bp", "respiratory_rate", "temperature_c", "spo2",
        "gcs_total", "pain_score", "news2_score",
    )


def history(enc: DataFrame) -> DataFrame:
    """History side table: ``patient_id`` plus the ``hx_*`` flags."""
    return enc.select("patient_id", *[c for c in enc.columns if c.startswith("hx_")])


def explanation_texts(decided: DataFrame) -> DataFrame:
    """Explanation response texts for the explained patients (1 in 3), derived from
    their decisions in five layouts: sectioned, inline headers with other bullet
    marks, headers without colons after a preamble, unstructured prose, and an
    error string."""
    eid = F.col("event_id")
    pa = F.col("predicted_acuity").cast("string")
    complaint = F.coalesce(F.when(F.trim(F.col("chief_complaint_raw")) != "", F.col("chief_complaint_raw")),
                           F.lit("an unrecorded complaint"))
    reason = F.concat(F.lit("Model chose KTAS "), pa, F.lit(" for "), complaint, F.lit("."))
    summary = F.concat(F.coalesce(F.col("age").cast("string"), F.lit("?")), F.lit("y "),
                       F.coalesce(F.col("sex"), F.lit("?")), F.lit(" presenting with "), complaint, F.lit("."))
    flag1 = F.coalesce(F.try_element_at(F.col("safety_rail_reasons"), F.lit(1)), F.lit("no rail fired"))
    flag2 = F.coalesce(F.try_element_at(F.col("conflict_reasons"), F.lit(1)), F.lit("no conflict detected"))
    note = F.concat(F.lit("Confidence "), F.col("confidence_pct"), F.lit(" supports clinician review."))
    nl = F.lit("\n")
    text = (
        F.when(eid % 5 == 0, F.concat(F.lit("ESCALATION_REASON:\n"), reason, F.lit("\n\nPATIENT_SUMMARY:\n"), summary,
                                      F.lit("\n\nRISK_FLAGS:\n- "), flag1, F.lit("\n- "), flag2,
                                      F.lit("\n\nCONFIDENCE_NOTE:\n"), note))
        .when(eid % 5 == 1, F.concat(F.lit("ESCALATION_REASON: "), reason, nl, F.lit("PATIENT_SUMMARY: "), summary,
                                     F.lit("\r\nRISK_FLAGS:\n  • "), flag1, F.lit("\n\t* "), flag2, nl,
                                     F.lit("CONFIDENCE_NOTE: "), note, F.lit("\n")))
        .when(eid % 5 == 2, F.concat(F.lit("Here is my review.\nESCALATION_REASON\n"), reason,
                                     F.lit("\n  RISK_FLAGS:\n  - "), flag1, F.lit("\n -- \n")))
        .when(eid % 5 == 3, F.concat(F.lit("  "), reason, F.lit(" "), summary, F.lit("  ")))
        .otherwise(F.lit("GROQ_RATE_LIMIT: service busy, no explanation was written."))
    )
    return decided.filter(eid % 3 == 0).select(F.col("patient_id").alias("response_id"), text.alias("response_text"))


def conversation_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assistant turns of ``conversations`` as free-form response texts."""
    conv = read_table(spark, sf_dir, "conversations")
    return conv.filter(F.col("role") == "assistant").select(
        F.concat(F.lit("C"), F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string"))
        .alias("response_id"), F.col("text").alias("response_text"))
