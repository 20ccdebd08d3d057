"""Readers (A1-A3), the target cleaning (B3/B4) and profile fallback."""

import os
import tempfile

import pytest

from acurail.operators import features, profile
from acurail.sources.files import read_csv, read_optional


def test_csv_roundtrip_and_required(spark):
    d = tempfile.mkdtemp(prefix="acurail-test-")
    df = spark.createDataFrame([("P1", "3", 80.0), ("P2", "x", None)], "patient_id string, triage_acuity string, hr double")
    df.coalesce(1).write.option("header", True).mode("overwrite").csv(os.path.join(d, "main"))
    back = read_csv(spark, os.path.join(d, "main"), "patient_id string, triage_acuity string, hr double",
                    required=("triage_acuity",))
    assert sorted(back.collect()) == sorted(df.collect())
    with pytest.raises(ValueError):
        read_csv(spark, os.path.join(d, "main"), "patient_id string, triage_acuity string, hr double",
                 required=("missing_target",))
    assert read_optional(spark, os.path.join(d, "nope")) is None


def test_clean_target_truncates_and_filters(spark):
    df = spark.createDataFrame([("a", "2.7"), ("b", "x"), ("c", "7"), ("d", None), ("e", "5")],
                               "patient_id string, triage_acuity string")
    out = {r["patient_id"]: r["triage_acuity"] for r in features.clean_target(df).collect()}
    assert out == {"a": 2, "e": 5}


def test_training_set_optional_sources(spark):
    main = spark.createDataFrame([("a", "3", 95.0)], "patient_id string, triage_acuity string, heart_rate double")
    out = features.training_set(main).first()
    assert out["triage_acuity"] == 3 and out["flag_tachycardia"] == 0


def test_numeric_profile_falls_back_for_empty_stratum(spark):
    df = spark.createDataFrame([(1, 10.0), (1, 20.0), (3, 30.0)], "triage_acuity int, hr double")
    p = {(r["acuity"], r["column"]): r for r in profile.numeric_profile(spark, df, ["hr"]).collect()}
    assert p[(2, "hr")]["source"] == "all" and p[(2, "hr")]["mean"] == 20.0
    assert p[(3, "hr")]["std"] == 0.01          # single value: undefined std -> 0.01
    assert p[(1, "hr")]["n"] == 2


def test_optional_source_by_uri(spark):
    d = tempfile.mkdtemp(prefix="acurail-test-")
    spark.createDataFrame([("P1", 1)], "patient_id string, x int").write.mode("overwrite").option("header", True).csv(f"{d}/t")
    assert read_optional(spark, f"file://{d}/t").count() == 1
    assert read_optional(spark, f"file://{d}/missing") is None and read_optional(spark, None) is None


def test_checkpoint_folder_must_be_shared_on_a_cluster():
    from types import SimpleNamespace

    from acurail.session import ensure_checkpoint_dir

    seen = []

    def session(master, folder):
        return SimpleNamespace(conf=SimpleNamespace(get=lambda k, d=None: folder, set=lambda k, v: seen.append(v)),
                               sparkContext=SimpleNamespace(master=master, setCheckpointDir=seen.append))

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        ensure_checkpoint_dir(session("spark://host:7077", None))
    with pytest.raises(ValueError):
        ensure_checkpoint_dir(session("local-cluster[2,1,1024]", ""))
    assert ensure_checkpoint_dir(session("yarn", "hdfs:///shared")) == "hdfs:///shared" and seen == ["hdfs:///shared"]
    assert ensure_checkpoint_dir(session("local[4]", None)) == seen[-1]
