"""Training, scoring and model bundle persistence (small forests keep the test fast)."""

import os
import tempfile

from pyspark.sql import functions as F

from acurail.operators import layers, training
from acurail.plans import queries as Q
from tests.conftest import SF001


def test_train_select_save_load_score(spark):
    split = Q.split_training(spark, SF001)
    best, res = training.train_candidates(split, Q.MODEL_NUMERIC, Q.MODEL_CATEGORICAL,
                                          names=["Logistic Regression", "Random Forest"], rf_trees=10)
    rows = res.collect()
    assert {r["model"] for r in rows} == {"Logistic Regression", "Random Forest"}
    assert sum(r["selected"] for r in rows) == 1
    top = max(rows, key=lambda r: r["accuracy"])
    assert best.name == top["model"]

    enc = Q._enc(spark, SF001).drop("p1", "p2", "p3", "p4", "p5")
    before = best.transform(enc).select("patient_id", "p1", "p2", "p3", "p4", "p5")
    path = os.path.join(tempfile.mkdtemp(prefix="acurail-model-"), "bundle")
    best.save(path)
    loaded = training.TriageModel.load(spark, path)
    after = loaded.transform(enc).select("patient_id", "p1", "p2", "p3", "p4", "p5")
    diff = before.join(after.withColumnsRenamed({f"p{k}": f"q{k}" for k in range(1, 6)}), "patient_id")
    assert diff.count() == 1000
    assert diff.filter(" OR ".join(f"abs(p{k} - q{k}) > 1e-12" for k in range(1, 6))).count() == 0
    sums = after.select((F.col("p1") + F.col("p2") + F.col("p3") + F.col("p4") + F.col("p5")).alias("s"))
    assert sums.filter("abs(s - 1) > 1e-9").count() == 0
    d = layers.materialize(layers.decisions(after.join(Q._enc(spark, SF001).drop("p1", "p2", "p3", "p4", "p5"),
                                                       "patient_id")))
    assert d.filter("predicted_acuity > original_acuity").count() == 0


def test_feature_importance_names(spark):
    split = Q.split_training(spark, SF001)
    best, _ = training.train_candidates(split, Q.MODEL_NUMERIC, Q.MODEL_CATEGORICAL, names=["Random Forest"],
                                        rf_trees=5)
    fi = training.feature_importance(best, 30).collect()
    assert 0 < len(fi) <= 30
    names = set(best.features.names)
    assert all(r["feature"] in names for r in fi)
    assert any(n.startswith("tfidf::") for n in names) and "sex_F" in names


def _separable(spark, n=400):
    """Patients whose class follows one vital and one word; ids repeat in the last rows."""
    rows = []
    for i in range(n):
        k = i % 5 + 1
        rows.append((f"P{i}", k, 40.0 + 30 * k + i % 7, "F" if i % 2 else "M", f"word{'abcde'[k - 1]} pain case"))
    df = spark.createDataFrame(rows, "patient_id string, triage_acuity int, heart_rate double, sex string, "
                                     "chief_complaint_raw string")
    return df.withColumn("split", F.when(F.crc32("patient_id") % 5 == 0, "test").otherwise("train"))


def test_candidates_agree_between_fits_and_beat_the_majority(spark):
    split = _separable(spark)
    names = ["Logistic Regression", "Random Forest", "Boosted Trees"]
    fits = [training.fit_candidates(split, ["heart_rate"], ["sex"], names, rf_trees=8, gbt_rounds=3,
                                    max_boosted_rows=200)[0] for _ in range(2)]
    for a, b in zip(*fits):
        assert a.name == b.name and a.accuracy == b.accuracy and a.accuracy > 0.5
    best = training.select_best(fits[0])
    assert best.accuracy == max(m.accuracy for m in fits[0])
    boosted = fits[0][2]
    path = os.path.join(tempfile.mkdtemp(prefix="acurail-model-"), "bundle")
    boosted.save(path)
    enc = split.drop("split")
    again = training.TriageModel.load(spark, path).transform(enc).select("patient_id", "p1", "p5").collect()
    assert sorted(again) == sorted(boosted.transform(enc).select("patient_id", "p1", "p5").collect())


def test_results_tell_the_rows_each_model_was_fitted_on(spark):
    split = _separable(spark, 200)
    _, res = training.train_candidates(split, ["heart_rate"], ["sex"], ["Logistic Regression", "Boosted Trees"],
                                       gbt_rounds=2, max_boosted_rows=50)
    assert {r["model"]: r["n_train"] for r in res.collect()} == {
        "Logistic Regression": split.filter("split = 'train'").count(), "Boosted Trees": 50}


def test_boosted_trees_follow_the_reference_settings():
    gbt = training.estimators(100)["Boosted Trees"]
    inner = gbt.getClassifier()
    assert (inner.getMaxIter(), inner.getMinInfoGain(), inner.getStepSize()) == (500, 0.1, 0.04)
    assert not gbt.isSet("weightCol") and not inner.isSet("weightCol")


def test_repeated_ids_keep_their_own_text_features(spark):
    split = _separable(spark, 60)
    train = split.filter("split = 'train'")
    st = training.fit_features(train, ["heart_rate"], ["sex"])
    twice = split.limit(20).withColumn("patient_id", F.lit("same"))
    rows = training.transform_features(twice, st).select("chief_complaint_raw", "features").collect()
    alone = {r["chief_complaint_raw"]: r["features"].toArray()[-len(st.vocab_rows):].tolist()
             for r in training.transform_features(split, st).collect()}
    assert len(rows) == 20
    for r in rows:
        assert r["features"].toArray()[-len(st.vocab_rows):].tolist() == alone[r["chief_complaint_raw"]]


def test_accent_folding(spark):
    from acurail.operators.preprocess import tokens
    df = spark.createDataFrame([("cafe\u0301s Caf\u00e9s \ufb01n \u0133s \u00dcber",)], "text string")
    assert df.select(tokens().alias("t")).first()["t"] == ["cafes", "cafes", "fin", "ijs", "uber"]


def test_folding_of_all_scripts(spark):
    import unicodedata
    from acurail.operators.preprocess import tokens
    texts = ["\uff26\uff35\uff2c\uff2c width", "N\u00ba 1\u00aa x\u00aab", "a\u20d7b o\u0483k", "\U0001d400\U0001d41b bold",
             "caf\u00e9 \u1e69 \u212bngstr\u00f6m", "\u0627\u0301 ab\u4e2dcd"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    import re
    want = [re.findall("[a-zA-Z]{2,}", "".join(c for c in unicodedata.normalize("NFKD", t.lower())
                                               if not unicodedata.combining(c))) for t in texts]
    assert [r["t"] for r in df.select(tokens().alias("t")).collect()] == want


def test_registered_candidates_are_fitted_on_all_training_rows(spark, tmp_path, monkeypatch):
    """More training rows than the bound of 2,000 that boosted trees once had; few rounds keep the test fast."""
    spark.range(3_000).select(
        F.col("id").alias("event_id"), F.timestamp_seconds(F.col("id") * 60).alias("ts"), (F.col("id") % 97).alias("user_id"),
        F.lit("view").alias("event_type"), F.lit(1.0).alias("value"), F.lit("{}").alias("props")).coalesce(1).write.parquet(
        str(tmp_path / "events.parquet"))
    usual = training.estimators
    monkeypatch.setattr(training, "estimators", lambda n, *_: usual(n, rf_trees=3, gbt_rounds=2))
    rows = Q.split_training(spark, str(tmp_path)).filter("split = 'train'").count()
    assert rows > 2_000
    table = Q.trained(spark, str(tmp_path), ("Random Forest", "Boosted Trees"))[1].collect()
    assert {r["model"]: r["n_train"] for r in table} == {"Random Forest": rows, "Boosted Trees": rows}
