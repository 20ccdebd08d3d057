"""Stored stages: only the needed columns, reused, deleted."""

import os

from acurail import stages
from acurail.plans import queries as Q
from acurail.session import child_names, ensure_checkpoint_dir
from tests.conftest import SF001


def _stored(spark):
    return {n for n in child_names(spark, ensure_checkpoint_dir(spark)) if n.startswith("acurail-stage-")}


def test_reports_store_what_they_read_and_share_it(spark):
    stages.release(spark)
    before = _stored(spark)
    first = Q.QUERIES["emergency_accuracy"](spark, SF001).collect()
    new = _stored(spark) - before
    assert len(new) == 1
    path = os.path.join(ensure_checkpoint_dir(spark), new.pop())
    assert set(spark.read.parquet(path).columns) == {"true_acuity", "original_acuity"}
    held = _stored(spark)
    for name in ("confusion_matrix", "classification_report", "distribution_compare", "emergency_accuracy"):
        assert Q.QUERIES[name](spark, SF001).count() > 0
    assert _stored(spark) == held and Q.QUERIES["emergency_accuracy"](spark, SF001).collect() == first
    assert stages.release(spark) == 1 and _stored(spark) == before
    assert Q.QUERIES["emergency_accuracy"](spark, SF001).collect() == first


def test_changed_inputs_never_meet_an_old_stage(spark, tmp_path):
    path = str(tmp_path / "in.parquet")
    spark.range(5).write.parquet(path)
    count = lambda: stages.stage(spark, [path], "t", ["id"], lambda: spark.read.parquet(path)).count()
    assert count() == 5 and count() == 5
    spark.range(9).write.mode("overwrite").parquet(path)
    assert count() == 9
    stages.release(spark)


def test_split_moves_only_keys(spark):
    """The split is the ranked one, row by row; nothing but label, hash and key is sorted."""
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    from acurail.operators.preprocess import stratified_split
    rows = spark.createDataFrame([(f"p{i}", None if i % 50 == 0 else i % 3, "x" * 10) for i in range(900)],
                                 "patient_id string, c int, wide string")
    out = stratified_split(rows, "c", "patient_id")
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    w = Window.partitionBy("c").orderBy(F.md5(F.concat("patient_id", F.lit("|42"))), "patient_id")
    n = Window.partitionBy("c")
    plain = rows.filter("c IS NOT NULL").withColumn("split", F.when(
        F.row_number().over(w) <= F.ceil(F.count("*").over(n) * 0.2), "test").otherwise("train"))
    assert out.exceptAll(plain).count() == 0 and out.count() == plain.count()


def test_flat_feedback_stores_only_the_decisions_it_shows(spark, monkeypatch):
    stored = []
    monkeypatch.setattr(Q, "stage", lambda spark, inputs, label, columns, make: (
        stored.append((label, list(columns))), make().select(*columns))[1])
    flat = Q.flat_table(spark, SF001)
    assert len(flat.columns) == 99 and [label for label, _ in stored] == ["decisions"]
    assert not {"probabilities", "rail_note", "conf_note", "p1"} & set(stored[0][1])


def test_rule_layers_run_as_methods_that_the_jvm_compiles(spark):
    spark.conf.unset("spark.sql.codegen.hugeMethodLimit")
    Q.QUERIES["decisions"](spark, SF001)
    assert int(spark.conf.get("spark.sql.codegen.hugeMethodLimit")) <= 8000
