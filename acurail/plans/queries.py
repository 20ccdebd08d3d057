"""Named queries over the driver tables (``queries()`` in ``__spark_entry__``).

Each entry takes ``(spark, sf_dir)`` and returns a DataFrame. Outputs are
flat: list-valued columns are emitted as JSON text (``to_json``) so they
compare by value against the SQL oracle.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from acurail.functions.columns import py_round
from acurail.operators import layers
from acurail.sources import tables
from acurail.stages import stage

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(name: str):
    def deco(fn):
        QUERIES[name] = fn
        return fn
    return deco


def _enc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.encounters(spark, sf_dir)


def decided(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """Decisions over the whole encounter view (row-local, no shuffle), stored with the columns that a report names.

    Reports read decisions as a stored stage (in production: the decision
    sink). It computes the rule layers once for reports that branch several
    times, and keeps filters on decision columns from being pushed (and
    inlined) through the whole rule tree by the optimizer. Only the named
    columns are computed and written, and a report that needs no others than
    an earlier one writes nothing. Without names all columns are stored.
    """
    d = layers.decisions(_enc(spark, sf_dir))
    return stage(spark, [tables.table_path(sf_dir, "events")], "decisions", columns or d.columns, lambda: d)


def materialized(df: DataFrame) -> DataFrame:
    return layers.materialize(df)


def _json(*cols: str) -> dict:
    return {c: F.to_json(F.col(c)) for c in cols}


@query("decisions")
def q_decisions(spark, sf_dir):
    d = layers.decisions(_enc(spark, sf_dir))
    return d.select(
        "patient_id", "run_id", "original_acuity", "predicted_acuity", "true_acuity", "label", "color",
        "confidence", "confidence_pct", "confidence_state", "confidence_gap", "confidence_top2_acuity",
        "confidence_top2_pct", "is_emergency", "safety_rail_triggered", "safety_rail_reasons",
        "has_feature_conflict", "conflict_reasons", "requires_review", "safety_notes", "intervention_flags",
    ).withColumns(_json("safety_rail_reasons", "conflict_reasons", "safety_notes", "intervention_flags"))


@query("base_prediction")
def q_base_prediction(spark, sf_dir):
    d = layers.base_prediction(_enc(spark, sf_dir))
    return d.select("patient_id", "original_acuity", "label", "color", "confidence", "confidence_pct",
                    "is_emergency", *[py_round(F.col(f"p{k}"), 4).alias(f"p{k}") for k in range(1, 6)])


@query("safety_rails")
def q_safety_rails(spark, sf_dir):
    d = layers.safety_rails(layers.base_prediction(_enc(spark, sf_dir)))
    return d.select("patient_id", "original_acuity", "rail_acuity", "safety_rail_triggered",
                    F.to_json("safety_rail_reasons").alias("safety_rail_reasons"), "rail_note")


@query("confidence_states")
def q_confidence_states(spark, sf_dir):
    d = layers.confidence_states(_enc(spark, sf_dir))
    return d.select("patient_id", "confidence_state", "confidence_gap", "confidence_top1_acuity",
                    "confidence_top2_acuity", "confidence_top2_pct")


@query("confidence_resolved")
def q_confidence_resolved(spark, sf_dir):
    d = layers.base_prediction(_enc(spark, sf_dir))
    d = layers.resolve_confidence(layers.confidence_states(layers.safety_rails(d)))
    return d.select("patient_id", "rail_acuity", "confidence_state", "conf_acuity", "conf_note", "conf_review")


@query("feature_conflicts")
def q_feature_conflicts(spark, sf_dir):
    d = layers.base_prediction(_enc(spark, sf_dir))
    d = layers.feature_conflicts(layers.resolve_confidence(layers.confidence_states(layers.safety_rails(d))))
    return d.select("patient_id", "original_acuity", "conf_acuity", "final_acuity", "has_feature_conflict",
                    F.to_json("conflict_reasons").alias("conflict_reasons"), "conflict_note")


# ---------------------------------------------------------------- features
from acurail.operators import features, profile  # noqa: E402
from acurail.operators.features import FLAG_NAMES  # noqa: E402

R6 = 6


def _r6(*cols: str) -> dict:
    return {c: py_round(F.col(c), R6) for c in cols}


@query("clinical_flags")
def q_clinical_flags(spark, sf_dir):
    d = features.clinical_flags(_enc(spark, sf_dir), only_present=False)
    return d.select("patient_id", *FLAG_NAMES)


@query("history_burden")
def q_history_burden(spark, sf_dir):
    d = features.history_burden(_enc(spark, sf_dir), only_present=False)
    return d.select("patient_id", "hx_total_burden", "hx_high_risk_flag")


@query("shock_index")
def q_shock_index(spark, sf_dir):
    return features.shock_index(_enc(spark, sf_dir)).select("patient_id", "shock_index")


@query("clean_target")
def q_clean_target(spark, sf_dir):
    rt = tables.raw_target(_enc(spark, sf_dir))
    return features.clean_target(rt, source="triage_acuity_raw").select("patient_id", "triage_acuity")


@query("dedup_first")
def q_dedup_first(spark, sf_dir):
    cc = tables.complaints(_enc(spark, sf_dir))
    return features.dedup_first(cc, "patient_id", ["ord", "chief_complaint_raw"]).select(
        "patient_id", "chief_complaint_raw", "ord")


def training_frame(spark, sf_dir) -> DataFrame:
    enc = _enc(spark, sf_dir)
    return features.training_set(tables.training_main(enc), tables.complaints(enc), tables.history(enc))


TRAINING_COLUMNS = [
    "patient_id", "triage_acuity", "age", "sex", "mental_status_triage", "heart_rate", "systolic_bp",
    "diastolic_bp", "respiratory_rate", "temperature_c", "spo2", "gcs_total", "pain_score", "news2_score",
    "chief_complaint_raw", "hx_heart_failure", "hx_copd", "hx_dementia", "hx_hypertension",
    *FLAG_NAMES, "hx_total_burden", "hx_high_risk_flag",
]


@query("training_set")
def q_training_set(spark, sf_dir):
    return training_frame(spark, sf_dir).select(*TRAINING_COLUMNS)


# ---------------------------------------------------------------- profiles
PROFILE_NUMERIC = ["heart_rate", "systolic_bp", "diastolic_bp", "spo2", "respiratory_rate",
                   "temperature_c", "gcs_total", "pain_score", "news2_score"]


@query("class_distribution")
def q_class_distribution(spark, sf_dir):
    enc = _enc(spark, sf_dir)
    true = profile.class_distribution(enc, "triage_acuity", kind="true")
    pred = profile.class_distribution(decided(spark, sf_dir, "predicted_acuity"), "predicted_acuity", kind="predicted")
    return true.unionByName(pred).select("kind", "acuity", "n", py_round(F.col("pct"), R6).alias("pct"))


@query("acuity_stats")
def q_acuity_stats(spark, sf_dir):
    return profile.stratum_stats(_enc(spark, sf_dir), PROFILE_NUMERIC).withColumns(_r6("mean", "std"))


@query("acuity_stats_json")
def q_acuity_stats_json(spark, sf_dir):
    return profile.stratum_stats_json(_enc(spark, sf_dir), PROFILE_NUMERIC, decimals=R6)


@query("numeric_profile")
def q_numeric_profile(spark, sf_dir):
    return profile.numeric_profile(spark, _enc(spark, sf_dir), PROFILE_NUMERIC + ["age"]) \
        .withColumns(_r6("mean", "std", "min", "max"))


@query("categorical_profile")
def q_categorical_profile(spark, sf_dir):
    return profile.categorical_profile(_enc(spark, sf_dir), ["sex", "mental_status_triage", "chief_complaint_raw"]) \
        .withColumns(_r6("freq"))


@query("binary_profile")
def q_binary_profile(spark, sf_dir):
    enc = _enc(spark, sf_dir)
    return profile.binary_profile(enc, [c for c in enc.columns if c.startswith("hx_")]).withColumns(_r6("rate"))


@query("column_profile")
def q_column_profile(spark, sf_dir):
    return profile.column_profile(_enc(spark, sf_dir), ["sex", "mental_status_triage"])


@query("column_list")
def q_column_list(spark, sf_dir):
    return profile.column_list(_enc(spark, sf_dir).drop("p1", "p2", "p3", "p4", "p5"), "patient_id")


# ---------------------------------------------------------------- metrics
from acurail.operators import metrics  # noqa: E402


def message_table(spark, sf_dir) -> DataFrame:
    """Messages: decisions + stage timestamps, with the LLM segment closed (A9 + A12)."""
    enc = _enc(spark, sf_dir)
    d = tables.message_times(decided(spark, sf_dir, "event_id", "patient_id", "run_id", "predicted_acuity", "true_acuity",
                                     "safety_rail_triggered"))
    return metrics.close_llm_segment(metrics.message_rows(d), tables.explanation_events(enc))


def _round_doubles(df: DataFrame) -> DataFrame:
    return df.withColumns({f.name: py_round(F.col(f.name), R6) for f in df.schema.fields
                           if f.dataType.typeName() == "double"})


@query("latency_segments")
def q_latency_segments(spark, sf_dir):
    m = message_table(spark, sf_dir)
    return _round_doubles(m.select("run_id", "patient_id", "kafka_transit_ms", "ml_inference_ms",
                                   "safety_pipeline_ms", "e2e_ms", "llm_ms", "safety_rail_triggered",
                                   "true_acuity", "predicted_acuity"))


@query("llm_segments")
def q_llm_segments(spark, sf_dir):
    m = message_table(spark, sf_dir).filter(F.col("explained_at").isNotNull())
    return _round_doubles(m.select("patient_id", "run_id", "explained_at", "llm_ms"))


@query("run_summary")
def q_run_summary(spark, sf_dir):
    s = metrics.run_summary(message_table(spark, sf_dir))
    return _round_doubles(s.drop("started_at"))


@query("run_comparison")
def q_run_comparison(spark, sf_dir):
    return _round_doubles(metrics.run_comparison(metrics.run_summary(message_table(spark, sf_dir))))


@query("latest_run")
def q_latest_run(spark, sf_dir):
    return metrics.latest_run(metrics.run_summary(message_table(spark, sf_dir), exact=False))


@query("message_sequence")
def q_message_sequence(spark, sf_dir):
    return metrics.message_sequence(message_table(spark, sf_dir)).select("run_id", "patient_id", "seq")


@query("running_accuracy")
def q_running_accuracy(spark, sf_dir):
    r = metrics.running_accuracy(message_table(spark, sf_dir))
    return _round_doubles(r.select("run_id", "patient_id", "seq", "hit", "running_accuracy"))


@query("latency_points")
def q_latency_points(spark, sf_dir):
    return _round_doubles(metrics.latency_points(message_table(spark, sf_dir)))


@query("recent_records")
def q_recent_records(spark, sf_dir):
    m = message_table(spark, sf_dir).select("patient_id", "run_id", "produced_at", "predicted_acuity",
                                            "safety_rail_triggered")
    return _round_doubles(metrics.recent_records(m, 100))


@query("pipeline_counters")
def q_pipeline_counters(spark, sf_dir):
    return _round_doubles(metrics.pipeline_counters(decided(spark, sf_dir, "confidence_state", "has_feature_conflict", "predicted_acuity", "safety_rail_triggered", "true_acuity")))


@query("layer_impact")
def q_layer_impact(spark, sf_dir):
    return _round_doubles(metrics.layer_impact(decided(spark, sf_dir, "confidence_state", "has_feature_conflict", "original_acuity", "predicted_acuity", "requires_review", "safety_rail_triggered", "true_acuity")))


@query("layer_breakdowns")
def q_layer_breakdowns(spark, sf_dir):
    return metrics.layer_breakdowns(decided(spark, sf_dir, "confidence_state", "conflict_reasons", "has_feature_conflict", "original_acuity", "predicted_acuity", "safety_rail_reasons", "safety_rail_triggered"))


# ---------------------------------------------------------------- review and feedback
from acurail.operators import feedback, review  # noqa: E402


def actions_table(spark, sf_dir) -> DataFrame:
    return tables.clinician_actions(_enc(spark, sf_dir))


@query("escalation_gate")
def q_escalation_gate(spark, sf_dir):
    d = decided(spark, sf_dir, "patient_id", "predicted_acuity", "true_acuity", "safety_rail_triggered", "has_feature_conflict", "gcs_total", "heart_rate", "news2_score", "respiratory_rate", "spo2", "systolic_bp", "temperature_c")
    ovr = review.valid_overrides(actions_table(spark, sf_dir)).select(
        "patient_id", F.lit("overridden").alias("decision")).distinct()
    g = review.escalation_gate(d.join(ovr, "patient_id", "left"), decision_col="decision")
    return g.select("patient_id", "should_call_llm", "reason_code", "reason_label", "reason_detail")


@query("abnormal_vitals")
def q_abnormal_vitals(spark, sf_dir):
    a = review.abnormal_vitals(_enc(spark, sf_dir))
    return a.select("patient_id", F.to_json("abnormal_vitals").alias("abnormal_vitals"))


@query("history_text")
def q_history_text(spark, sf_dir):
    return review.history_text(_enc(spark, sf_dir)).select("patient_id", "history_text")


#: Decision columns that a review prompt shows or is gated by.
PROMPT_COLUMNS = ["patient_id", "predicted_acuity", "true_acuity", "safety_rail_triggered", "has_feature_conflict", "age", "sex",
                  "chief_complaint_raw", "mental_status_triage", "confidence_pct", "model", "heart_rate", "systolic_bp",
                  "diastolic_bp", "respiratory_rate", "temperature_c", "spo2", "gcs_total", "pain_score", "news2_score",
                  "hx_heart_failure", "hx_copd", "hx_dementia", "hx_hypertension", "p1", "p2", "p3", "p4", "p5"]


@query("review_prompts")
def q_review_prompts(spark, sf_dir):
    p = review.review_prompts(decided(spark, sf_dir, *PROMPT_COLUMNS))
    return p.select("patient_id", "reason_code", "prompt")


#: Decision columns that the explanation texts are made of.
RESPONSE_COLUMNS = ["event_id", "patient_id", "predicted_acuity", "age", "sex", "chief_complaint_raw", "confidence_pct",
                    "conflict_reasons", "safety_rail_reasons"]


def response_table(spark, sf_dir) -> DataFrame:
    return tables.explanation_texts(decided(spark, sf_dir, *RESPONSE_COLUMNS)).unionByName(tables.conversation_texts(spark, sf_dir))


@query("parsed_responses")
def q_parsed_responses(spark, sf_dir):
    p = review.parse_responses(response_table(spark, sf_dir))
    return p.select("response_id", "escalation_reason", "patient_summary",
                    F.to_json("risk_flags").alias("risk_flags"), "confidence_note", "is_ready", "error_code")


def events_table(spark, sf_dir, *columns: str) -> DataFrame:
    """Feedback events; the record in them has the named decision columns (all without names)."""
    d = features.history_burden(features.clinical_flags(decided(spark, sf_dir, *columns), only_present=False),
                                only_present=False)
    d = tables.message_times(d).withColumns({
        "timestamp": F.date_format("arrival_ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"),
        "processed_at": F.date_format(F.timestamp_micros(F.round(F.col("safety_done_at") * 1_000_000).cast("long")),
                                      "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"),
        "chief_complaint": F.col("chief_complaint_raw"),
    })
    return feedback.feedback_events(d, actions_table(spark, sf_dir))


@query("feedback_events")
def q_feedback_events(spark, sf_dir):
    e = feedback.feedback_events(decided(spark, sf_dir, *FEEDBACK_COLUMNS), actions_table(spark, sf_dir))
    return e.select("patient_id", "event_type", "feedback_type", "final_label", "override_reason", "override_ktas",
                    F.col("patient.predicted_acuity").alias("shown_acuity"))


def flat_table(spark, sf_dir) -> DataFrame:
    """The 99-column table: a join over the stored decisions, which hold only what a flat row or its times are made of."""
    known = layers.decisions(_enc(spark, sf_dir)).columns
    shown = [c for c in known if c in feedback.FEEDBACK_COLUMNS or c in ("event_id", "arrival_ts", "predicted_acuity")]
    return feedback.feedback_flat(events_table(spark, sf_dir, *shown))


#: What the feedback reports read of a decision, and of the flat table.
FEEDBACK_COLUMNS = ["patient_id", "original_acuity", "predicted_acuity", "confidence_state", "has_feature_conflict",
                    "safety_rail_triggered", "safety_rail_reasons"]
FLAT_COLUMNS = ["patient_id", "feedback_type", "final_label", "override_reason", "guardrail_acuity",
                "model_predicted_acuity", "safety_rail_reasons", "safety_rail_triggered", "has_feature_conflict"]


def flat_core(spark, sf_dir) -> DataFrame:
    """The few columns of the flat table that the reports use, stored once for all of them."""
    inputs = [tables.table_path(sf_dir, "events")]

    def make() -> DataFrame:
        shown = decided(spark, sf_dir, *FEEDBACK_COLUMNS)
        return feedback.feedback_flat(feedback.feedback_events(shown, actions_table(spark, sf_dir)))
    return stage(spark, inputs, "feedback", FLAT_COLUMNS, make)


@query("feedback_flat")
def q_feedback_flat(spark, sf_dir):
    return _round_doubles(flat_table(spark, sf_dir))


@query("override_rows")
def q_override_rows(spark, sf_dir):
    return feedback.override_rows(flat_core(spark, sf_dir))


@query("override_matrix")
def q_override_matrix(spark, sf_dir):
    return feedback.override_matrix(feedback.override_rows(flat_core(spark, sf_dir)))


@query("override_matrix_dense")
def q_override_matrix_dense(spark, sf_dir):
    return feedback.override_matrix_dense(feedback.override_rows(flat_core(spark, sf_dir)))


@query("override_summary")
def q_override_summary(spark, sf_dir):
    return _round_doubles(feedback.override_summary(feedback.override_rows(flat_core(spark, sf_dir))))


@query("rail_reasons")
def q_rail_reasons(spark, sf_dir):
    return feedback.rail_reasons(feedback.override_rows(flat_core(spark, sf_dir)))


@query("feedback_stats")
def q_feedback_stats(spark, sf_dir):
    return feedback.feedback_stats(flat_core(spark, sf_dir))


@query("dashboard_kpis")
def q_dashboard_kpis(spark, sf_dir):
    enc = _enc(spark, sf_dir)
    return _round_doubles(feedback.dashboard_kpis(decided(spark, sf_dir, "patient_id", "confidence", "is_emergency", "predicted_acuity", "true_acuity"), actions_table(spark, sf_dir),
                                                  tables.explanation_events(enc)))


@query("pending_queue")
def q_pending_queue(spark, sf_dir):
    q = review.pending_queue(decided(spark, sf_dir, "patient_id", "predicted_acuity", "label", "confidence_pct", "is_emergency", "safety_rail_triggered"), actions_table(spark, sf_dir))
    return q.select("patient_id", "predicted_acuity", "label", "confidence_pct", "safety_rail_triggered")


@query("review_backlog")
def q_review_backlog(spark, sf_dir):
    enc = _enc(spark, sf_dir)
    b = review.review_backlog(decided(spark, sf_dir, "patient_id", "predicted_acuity", "true_acuity", "safety_rail_triggered", "has_feature_conflict"), tables.explanation_events(enc), actions_table(spark, sf_dir))
    return b.select("patient_id", "predicted_acuity", "true_acuity", "safety_rail_triggered", "has_feature_conflict")


@query("enriched_records")
def q_enriched_records(spark, sf_dir):
    m = feedback.merge_history(decided(spark, sf_dir, "patient_id", "predicted_acuity", "hx_copd", "hx_dementia", "hx_heart_failure", "hx_hypertension"))
    return m.select("patient_id", "predicted_acuity", *[c for c in m.columns if c.startswith("hx_")])


@query("records_with_review")
def q_records_with_review(spark, sf_dir):
    d = decided(spark, sf_dir, *RESPONSE_COLUMNS)
    parsed = review.parse_responses(tables.explanation_texts(d)).withColumnRenamed("response_id", "patient_id")
    enc = _enc(spark, sf_dir)
    expl = tables.explanation_events(enc).join(parsed, "patient_id", "inner")
    r = review.records_with_review(d, expl)
    return _round_doubles(r.select("patient_id", "predicted_acuity",
                                   F.col("llm_explanation.explained_at").alias("explained_at"),
                                   F.col("llm_explanation.escalation_reason").alias("escalation_reason"),
                                   F.col("llm_explanation.error_code").alias("error_code")))


# ---------------------------------------------------------------- evaluation and preprocessing
from acurail.operators import evaluate, preprocess  # noqa: E402

MODEL_NUMERIC = ["age", "heart_rate", "systolic_bp", "diastolic_bp", "respiratory_rate", "temperature_c", "spo2",
                 "gcs_total", "pain_score", "news2_score"]
MODEL_CATEGORICAL = ["sex", "mental_status_triage"]


def scored(spark, sf_dir, *scores: str) -> DataFrame:
    """Model output of the fixture: raw argmax class and the named class scores, with the truth."""
    return decided(spark, sf_dir, "true_acuity", "original_acuity", *scores).withColumnRenamed(
        "original_acuity", "predicted_acuity")


@query("confusion_matrix")
def q_confusion_matrix(spark, sf_dir):
    return evaluate.confusion_matrix(scored(spark, sf_dir))


@query("classification_report")
def q_classification_report(spark, sf_dir):
    return _round_doubles(evaluate.classification_report(scored(spark, sf_dir)))


@query("macro_auc")
def q_macro_auc(spark, sf_dir):
    return _round_doubles(evaluate.macro_auc(scored(spark, sf_dir, "p1", "p2", "p3", "p4", "p5")))


@query("emergency_accuracy")
def q_emergency_accuracy(spark, sf_dir):
    return _round_doubles(evaluate.emergency_accuracy(scored(spark, sf_dir)))


@query("distribution_compare")
def q_distribution_compare(spark, sf_dir):
    return evaluate.distribution_compare(scored(spark, sf_dir))


def split_training(spark, sf_dir, *columns: str) -> DataFrame:
    """The training rows' named columns (all without names) and their ``split``, stored once for their readers."""
    return stage(spark, [tables.table_path(sf_dir, "events")], "training", [*(columns or TRAINING_COLUMNS), "split"],
                 lambda: preprocess.stratified_split(training_frame(spark, sf_dir), "triage_acuity", "patient_id"))


@query("stratified_split")
def q_stratified_split(spark, sf_dir):
    return split_training(spark, sf_dir, "patient_id", "triage_acuity")


@query("stratified_sample")
def q_stratified_sample(spark, sf_dir):
    return preprocess.stratified_sample(training_frame(spark, sf_dir), "triage_acuity", "patient_id", n=200) \
        .select("patient_id", "triage_acuity")


@query("class_weights")
def q_class_weights(spark, sf_dir):
    return _round_doubles(evaluate.class_weights(split_training(spark, sf_dir, "triage_acuity").filter(F.col("split") == "train")))


@query("impute_scale")
def q_impute_scale(spark, sf_dir):
    df = split_training(spark, sf_dir, "patient_id", *MODEL_NUMERIC)
    fitted = preprocess.fit_impute_scale(df.filter(F.col("split") == "train"), MODEL_NUMERIC)
    out = preprocess.apply_impute_scale(df, fitted, MODEL_NUMERIC)
    return _round_doubles(out.select("patient_id", "split", *MODEL_NUMERIC))


@query("one_hot")
def q_one_hot(spark, sf_dir):
    df = split_training(spark, sf_dir, "patient_id", *MODEL_CATEGORICAL)
    cats = preprocess.fit_categories(df.filter(F.col("split") == "train"), MODEL_CATEGORICAL)
    out = preprocess.one_hot(df, cats, MODEL_CATEGORICAL)
    return out.select("patient_id", *[c for c in out.columns if any(c.startswith(f"{m}_") for m in MODEL_CATEGORICAL)])


def text_documents(spark, sf_dir) -> DataFrame:
    return tables.read_table(spark, sf_dir, "documents").select("doc_id", "text")


@query("tfidf_weights")
def q_tfidf_weights(spark, sf_dir):
    _, weights = preprocess.tfidf_corpus(text_documents(spark, sf_dir))
    return _round_doubles(weights)


@query("tfidf_vocabulary")
def q_tfidf_vocabulary(spark, sf_dir):
    return _round_doubles(preprocess.fit_tfidf(text_documents(spark, sf_dir)))


# ---------------------------------------------------------------- training and scoring
from acurail.operators import training  # noqa: E402

@query("training_features")
def q_training_features(spark, sf_dir):
    """K4: the model's feature vectors of all training rows, fitted on the train part."""
    df = split_training(spark, sf_dir, "patient_id", *MODEL_NUMERIC, *MODEL_CATEGORICAL, "chief_complaint_raw")
    state = training.fit_features(df.filter(F.col("split") == "train"), MODEL_NUMERIC, MODEL_CATEGORICAL)
    return _round_doubles(training.feature_rows(df, state))


_MODELS: dict = {}
ALL_MODELS = ("Logistic Regression", "Random Forest", "Boosted Trees")


def trained(spark, sf_dir, names: tuple[str, ...]):
    """(best model, results) of a candidate set. A fit is reused within an application for training rows of the
    same content (a hash over all rows and columns), so changed data is always fitted anew."""
    split = split_training(spark, sf_dir)
    content = split.agg(F.count("*"), F.sum(F.xxhash64(*split.columns).cast("decimal(38,0)"))).first()
    key = (spark.sparkContext.applicationId, tuple(content))
    known = _MODELS.setdefault(key, {})
    missing = [n for n in names if n not in known]
    if missing:
        models, n_train = training.fit_candidates(split, MODEL_NUMERIC, MODEL_CATEGORICAL, missing)
        known.update({m.name: (m, n_train) for m in models})
    models = [known[n][0] for n in names]
    return training.select_best(models), training.candidate_table(spark, models, known[names[0]][1])


@query("train_lr")
def q_train_lr(spark, sf_dir):
    return trained(spark, sf_dir, ("Logistic Regression",))[1]


@query("train_rf")
def q_train_rf(spark, sf_dir):
    return trained(spark, sf_dir, ("Random Forest",))[1]


@query("train_gbt")
def q_train_gbt(spark, sf_dir):
    return trained(spark, sf_dir, ("Boosted Trees",))[1]


#: Rounds and rate of the registered softmax fit: the same total step (20) as 500 rounds of 0.04.
SOFTMAX_ROUNDS, SOFTMAX_RATE = 60, 1 / 3


@query("train_softmax")
def q_train_softmax(spark, sf_dir):
    """K7 on all training rows: class, its test rows, and how many of them the model gets right."""
    from acurail.operators.boosting import SoftmaxBoosting
    split = split_training(spark, sf_dir)
    train = split.filter(F.col("split") == "train")
    state = training.fit_features(train, training.numeric_features(split, MODEL_NUMERIC), MODEL_CATEGORICAL)
    rows = training.transform_features(split, state).select(
        "split", "features", (F.col("triage_acuity") - 1).cast("double").alias("label_idx"))
    model = SoftmaxBoosting(rounds=SOFTMAX_ROUNDS, rate=SOFTMAX_RATE).fit(rows.filter(F.col("split") == "train"))
    told = model.transform(rows.filter(F.col("split") == "test"))
    right = (F.col("prediction") == F.col("label_idx")).cast("long")
    return told.groupBy((F.col("label_idx") + 1).cast("int").alias("triage_acuity")).agg(
        F.count(F.lit(1)).alias("n_test"), F.sum(right).alias("n_right"))


@query("model_selection")
def q_model_selection(spark, sf_dir):
    return trained(spark, sf_dir, ALL_MODELS)[1]


@query("feature_importance")
def q_feature_importance(spark, sf_dir):
    return training.feature_importance(trained(spark, sf_dir, ("Random Forest",))[0], 30)


@query("score_batch")
def q_score_batch(spark, sf_dir):
    """C1 + C15: score every encounter with the selected model, then run the decision layers."""
    best = trained(spark, sf_dir, ALL_MODELS)[0]
    probs = materialized(best.transform(_enc(spark, sf_dir).drop("p1", "p2", "p3", "p4", "p5")))
    d = layers.decisions(probs, model_name=best.name)
    return d.select("patient_id", "original_acuity", "predicted_acuity", "true_acuity", "confidence",
                    "confidence_state", "safety_rail_triggered", "has_feature_conflict", "requires_review", "model")


@query("train_pipeline")
def q_train_pipeline(spark, sf_dir):
    """K11 + A15: select, save the bundle to the checkpoint folder, reload it and evaluate the reloaded model."""
    import os
    import uuid
    from acurail.session import ensure_checkpoint_dir
    best = trained(spark, sf_dir, ALL_MODELS)[0]
    path = os.path.join(ensure_checkpoint_dir(spark), "models", f"triage-{uuid.uuid4().hex}")
    best.save(path)
    loaded = training.TriageModel.load(spark, path)
    test = split_training(spark, sf_dir).filter(F.col("split") == "test")
    scored_test = loaded.transform(test)
    pred = layers.base_prediction(scored_test)
    return pred.agg(F.count(F.lit(1)).alias("n_test"),
                    F.avg((F.col("original_acuity") == F.col("triage_acuity")).cast("double")).alias("accuracy")) \
        .select(F.lit(loaded.name).alias("model"), F.lit(path).alias("bundle_path"), "n_test", "accuracy")


# ---------------------------------------------------------------- streaming
def stream_records(spark, sf_dir) -> DataFrame:
    """Input messages as the producer sends them: encounter fields plus stage timestamps."""
    enc = tables.message_times(_enc(spark, sf_dir))
    return enc.select(
        "patient_id", F.date_format("arrival_ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("timestamp"),
        "produced_at", "consumer_received_at", "ml_done_at", "safety_done_at", "run_id", "event_id",
        F.col("triage_acuity").alias("true_acuity"), "age", "sex", "mental_status_triage", "chief_complaint_raw",
        "heart_rate", "systolic_bp", "diastolic_bp", "respiratory_rate", "temperature_c", "spo2", "gcs_total",
        "pain_score", "news2_score", "hx_heart_failure", "hx_copd", "hx_dementia", "hx_hypertension",
        "p1", "p2", "p3", "p4", "p5")


def stream_schema():
    """Schema of ``stream_records``: the input fields and the stage timestamps."""
    from pyspark.sql import types as T

    from acurail.streaming import jobs
    return T.StructType(list(jobs.INPUT_SCHEMA.fields) + [
        T.StructField(c, T.DoubleType()) for c in ("consumer_received_at", "ml_done_at", "safety_done_at")])


def run_decision_stream(spark, sf_dir, num_files: int | None = None) -> str:
    """J1 end to end on the file source (availableNow); returns the output folder."""
    import os
    from acurail.sources.files import write_stream_input
    from acurail.streaming import jobs
    par = spark.sparkContext.defaultParallelism
    root = write_stream_input(stream_records(spark, sf_dir), num_files=num_files or 2 * par)
    schema = stream_schema()
    raw = jobs.read_json_lines(spark, os.path.join(root, "in"), max_files_per_trigger=par)
    for q in jobs.start_decision_job(spark, raw, os.path.join(root, "out"), os.path.join(root, "chk"), schema=schema):
        q.awaitTermination()
    return root


@query("stream_decisions")
def q_stream_decisions(spark, sf_dir):
    import os
    root = run_decision_stream(spark, sf_dir)
    d = spark.read.parquet(os.path.join(root, "out", "decision_table"))
    return d.select(*q_decisions(spark, sf_dir).columns).withColumns(
        _json("safety_rail_reasons", "conflict_reasons", "safety_notes", "intervention_flags")) \
        .withColumn("true_acuity", F.col("true_acuity").cast("int"))


@query("stream_messages")
def q_stream_messages(spark, sf_dir):
    import os
    root = run_decision_stream(spark, sf_dir)
    m = spark.read.parquet(os.path.join(root, "out", "messages"))
    return _round_doubles(m.select("run_id", "patient_id", "kafka_transit_ms", "ml_inference_ms",
                                   "safety_pipeline_ms", "e2e_ms", "safety_rail_triggered", "true_acuity",
                                   "predicted_acuity"))


def run_live_stream(spark, sf_dir, start, files: int = 6, notes: bool = True) -> str:
    """Records and explanations of all encounters, mixed over ``files`` files, through a live job; its output folder."""
    import os
    from acurail.sources.files import write_lines
    from acurail.streaming import jobs
    records = stream_records(spark, sf_dir).select(F.to_json(F.struct("*")).alias("value"))
    told = tables.explanation_events(_enc(spark, sf_dir)).select(F.to_json(F.struct(
        "patient_id", F.lit(True).alias("enrichment"), "enrichment_requested_at", "explained_at",
        F.struct(F.lit("why").alias("escalation_reason"), F.lit(True).alias("is_ready")).alias("llm_explanation"))).alias("value"))
    mixed = records.unionByName(told) if notes else records
    root = write_lines(mixed, num_files=files)
    raw = jobs.read_json_lines(spark, os.path.join(root, "in"), max_files_per_trigger=2)
    out = start(spark, raw, os.path.join(root, "out"), os.path.join(root, "chk"), stream_schema())
    for q in out if isinstance(out, tuple) else (out,):
        q.awaitTermination()
    return os.path.join(root, "out")


@query("stream_run_counters")
def q_stream_run_counters(spark, sf_dir):
    from acurail.streaming import live
    out = run_live_stream(spark, sf_dir, live.start_counter_job)
    return live.counter_table(spark, out).current().drop("first_produced_at", "last_produced_at")


@query("stream_llm_segments")
def q_stream_llm_segments(spark, sf_dir):
    from acurail.streaming import live
    m = live.live_messages(spark, run_live_stream(spark, sf_dir, live.start_message_job))
    return _round_doubles(m.filter(F.col("explained_at").isNotNull()).select("patient_id", "run_id", "explained_at", "llm_ms"))


@query("stream_run_summary")
def q_stream_run_summary(spark, sf_dir):
    from acurail.streaming import live
    out = run_live_stream(spark, sf_dir, live.start_message_job)
    return _round_doubles(live.live_run_summary(spark, out).drop("started_at"))


@query("stream_merged_records")
def q_stream_merged_records(spark, sf_dir):
    """Published value of every patient: the decision and the time of the explanation joined to it."""
    from acurail.streaming import live
    out = run_live_stream(spark, sf_dir, live.start_merged_job)
    value = live.published(live.merged_table(spark, out).current())
    return _round_doubles(value.select(
        F.col("key").alias("patient_id"), *[F.get_json_object("value", f"$.{c}").cast(t).alias(c) for c, t in (
            ("predicted_acuity", "int"), ("label", "string"), ("requires_review", "boolean"), ("explained_at", "double"))]))


@query("stream_recent_records")
def q_stream_recent_records(spark, sf_dir):
    """The stored newest 100 after a stream whose records come in any order."""
    from acurail.streaming import live
    out = run_live_stream(spark, sf_dir, lambda s, raw, o, c, schema: live.start_recent_job(s, raw, o, c, schema=schema))
    return _round_doubles(live.recent_records(spark, out).select("patient_id", "produced_at"))
