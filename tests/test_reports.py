"""Report cross-checks: classification report vs Spark ML's evaluator, JSON profile shape, feature lists."""

import json

import pytest
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.sql import functions as F

from acurail.operators import evaluate, features, profile
from acurail.plans import queries as Q
from tests.conftest import SF001


def test_classification_report_matches_spark_ml(spark):
    s = Q.scored(spark, SF001).select(F.col("true_acuity").cast("double").alias("label"),
                                      F.col("predicted_acuity").cast("double").alias("prediction"))
    rep = {r["label"]: r for r in evaluate.classification_report(
        s.select(F.col("label").alias("true_acuity"), F.col("prediction").alias("predicted_acuity"))).collect()}
    ev = MulticlassClassificationEvaluator(labelCol="label", predictionCol="prediction")
    assert rep["accuracy"]["f1_score"] == pytest.approx(ev.evaluate(s, {ev.metricName: "accuracy"}))
    assert rep["weighted avg"]["precision"] == pytest.approx(ev.evaluate(s, {ev.metricName: "weightedPrecision"}))
    assert rep["weighted avg"]["recall"] == pytest.approx(ev.evaluate(s, {ev.metricName: "weightedRecall"}))
    assert rep["weighted avg"]["f1_score"] == pytest.approx(ev.evaluate(s, {ev.metricName: "f1"}))
    cm = evaluate.confusion_matrix(Q.scored(spark, SF001)).agg(F.sum("n")).first()[0]
    assert cm == 1000                         # matrix total = row count


def test_stratum_json_shape(spark):
    doc = {r["acuity"]: json.loads(r["stats_json"])
           for r in Q.QUERIES["acuity_stats_json"](spark, SF001).collect()}
    assert sorted(doc) == ["1", "2", "3", "4", "5"]
    for stats in doc.values():
        assert sorted(stats) == sorted(Q.PROFILE_NUMERIC)
        assert all(set(v) == {"mean", "std"} for v in stats.values())


def test_feature_lists_order_and_dedupe():
    cols = ["patient_id", "age", "heart_rate", "flag_fever", "hx_copd", "hx_total_burden", "hx_high_risk_flag",
            "sex", "mental_status_triage", "age"]
    numeric, categorical = features.feature_lists(cols)
    assert numeric == ["age", "heart_rate", "flag_fever", "hx_total_burden", "hx_high_risk_flag", "hx_copd"]
    assert categorical == ["sex", "mental_status_triage"]


def test_categorical_profile_sums_to_one(spark):
    p = profile.categorical_profile(Q._enc(spark, SF001), ["sex", "mental_status_triage"])
    sums = p.groupBy("acuity", "column").agg(F.sum("freq").alias("s")).collect()
    assert all(abs(r["s"] - 1) < 1e-12 for r in sums)


def test_dashboard_kpis_over_live_window(spark):
    from acurail.operators import feedback, metrics
    from acurail.sources import tables
    d = Q.decided(spark, SF001)
    recent = metrics.recent_records(tables.message_times(d).select(
        "patient_id", "produced_at", "is_emergency", "true_acuity", "predicted_acuity", "confidence"), 100)
    k = feedback.dashboard_kpis(recent, Q.actions_table(spark, SF001),
                                tables.explanation_events(Q._enc(spark, SF001))).first()
    assert k["patients_seen"] == 100
    assert k["pending_review"] == k["patients_seen"] - k["accepted"] - k["overridden"]
    assert 0 <= k["model_accuracy_pct"] <= 100 and 0 < k["avg_confidence"] <= 1
