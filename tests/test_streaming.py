"""Structured Streaming: stream == batch, restart without duplicates, quarantine, dedupe, enrichment join."""

import json
import os
import tempfile
from collections import Counter

from pyspark.sql import functions as F

from acurail.operators import layers, metrics
from acurail.plans import queries as Q
from acurail.session import child_names
from acurail.streaming import jobs, live
from acurail.streaming.keyed import KeyedTable, add_up
from tests.conftest import SF001

DECISION_COLS = ["patient_id", "original_acuity", "predicted_acuity", "confidence_state",
                 "safety_rail_triggered", "has_feature_conflict", "requires_review"]


def test_stream_equals_batch_and_restart_is_idempotent(spark):
    root = tempfile.mkdtemp(prefix="acurail-stream-")
    recs = Q.stream_records(spark, SF001)
    first, second = recs.filter("event_id < 600"), recs.filter("event_id >= 600")
    first.select(F.to_json(F.struct("*"))).repartition(3).write.text(os.path.join(root, "in", "a"))
    with open(os.path.join(root, "in", "bad.txt"), "w") as fh:
        fh.write("{not json\n" + json.dumps({"patient_id": "", "age": 3}) + "\n")

    def run():
        for q in jobs.start_decision_job(spark, os.path.join(root, "in", "*"), os.path.join(root, "out"),
                                         os.path.join(root, "chk")):
            q.awaitTermination()

    run()
    # Restart from the checkpoint with one more input folder: only new files are processed.
    second.select(F.to_json(F.struct("*"))).repartition(2).write.text(os.path.join(root, "in", "b"))
    run()
    run()  # nothing new: a no-op
    out = spark.read.parquet(os.path.join(root, "out", "decision_table"))
    assert out.count() == 1000 and out.select("patient_id").distinct().count() == 1000
    batch = layers.decisions(Q._enc(spark, SF001)).select(*DECISION_COLS)
    assert out.select(*DECISION_COLS).exceptAll(batch).count() == 0
    assert batch.exceptAll(out.select(*DECISION_COLS)).count() == 0
    assert spark.read.parquet(os.path.join(root, "out", "quarantine")).count() == 2
    msgs = spark.read.parquet(os.path.join(root, "out", "messages"))
    assert msgs.count() == 1000 and msgs.filter("e2e_ms <= 0 OR kafka_transit_ms <= 0").count() == 0
    published = spark.read.json(os.path.join(root, "out", "decisions"))
    assert published.count() == 1000 and "value" in published.columns


def test_dedupe_within_watermark(spark):
    root = tempfile.mkdtemp(prefix="acurail-dedupe-")
    rows = [{"patient_id": "A", "produced_at": 100.0, "age": 1}, {"patient_id": "A", "produced_at": 101.0, "age": 2},
            {"patient_id": "B", "produced_at": 102.0, "age": 3}]
    os.makedirs(os.path.join(root, "in"))
    with open(os.path.join(root, "in", "x.json"), "w") as fh:
        fh.write("\n".join(json.dumps(r) for r in rows))
    good, _ = jobs.parse_records(jobs.read_json_lines(spark, os.path.join(root, "in")))
    q = (jobs.dedupe_patients(good).writeStream.format("memory").queryName("dedupe_out")
         .option("checkpointLocation", os.path.join(root, "chk")).trigger(availableNow=True).start())
    q.awaitTermination()
    got = {(r["patient_id"], r["age"]) for r in spark.sql("SELECT * FROM dedupe_out").collect()}
    assert got == {("A", 1.0), ("B", 3.0)}


def _lines(spark, rows):
    return spark.createDataFrame([(r if isinstance(r, str) else json.dumps(r),) for r in rows], "value string")


def test_damaged_fields_are_set_aside(spark):
    rows = [{"patient_id": "A", "hx_copd": 1.0, "true_acuity": 3.0, "heart_rate": 25},
            {"patient_id": "B", "heart_rate": "25"}, {"patient_id": "C", "true_acuity": 2.5},
            {"patient_id": "D", "heart_rate": None, "age": 4.5}, {"patient_id": ""}, {"heart_rate": 3}, "not json"]
    good, bad = jobs.parse_records(_lines(spark, rows))
    kept = {r["patient_id"]: r for r in good.collect()}
    assert set(kept) == {"A", "D"}
    assert (kept["A"]["hx_copd"], kept["A"]["true_acuity"], kept["A"]["heart_rate"]) == (1, 3, 25.0)
    reasons = [r["reason"] for r in bad.collect()]
    assert len(reasons) == 5 and {"damaged field: heart_rate", "damaged field: true_acuity"} <= set(reasons)


def test_feedback_without_label_is_quarantined_and_stats_follow_saved_rows(spark):
    root = tempfile.mkdtemp(prefix="acurail-feedback-")
    schema = "patient_id string, feedback_type string, final_label int, override_reason string, patient struct<original_acuity:int,predicted_acuity:int>"
    from pyspark.sql import types as T
    sink = jobs.feedback_sink(os.path.join(root, "out"), stats_every=20)
    event = lambda i, label: (f"P{i}", "accepted", label, None, (2, 2))
    for batch in range(5):
        sink(spark.createDataFrame([event(10 * batch + i, 3) for i in range(10)], schema), batch)
        stats = os.path.join(root, "out", "feedback_stats")
        shown = spark.read.parquet(stats).agg(F.sum("n")).first()[0] if os.path.exists(stats) else 0
        assert shown == [0, 20, 20, 40, 40][batch]
    sink(spark.createDataFrame([event(40 + i, 3) for i in range(10)], schema), 4)  # a replayed batch adds nothing
    assert spark.read.parquet(os.path.join(root, "out", "feedback")).count() == 50
    events = spark.createDataFrame([event(i, None if i == 4 else 3) for i in range(6)], schema)
    events.select(F.to_json(F.struct("*")).alias("value")).write.text(os.path.join(root, "in"))
    for q in jobs.start_feedback_job(spark, os.path.join(root, "in"), os.path.join(root, "o2"),
                                     os.path.join(root, "c2"), T.StructType(events.schema.fields)):
        q.awaitTermination()
    assert spark.read.parquet(os.path.join(root, "o2", "feedback")).count() == 5
    assert spark.read.parquet(os.path.join(root, "o2", "quarantine")).count() == 1


def test_kafka_options():
    assert jobs.kafka_sink_options("b:9092", "decisions", "/chk") == {
        "kafka.bootstrap.servers": "b:9092", "topic": "decisions", "checkpointLocation": "/chk",
        "kafka.acks": "all", "kafka.retries": "3"}
    assert "checkpointLocation" not in jobs.kafka_sink_options("b:9092", "decisions")
    assert jobs.kafka_source_options("b:9092", "a,b") == {
        "kafka.bootstrap.servers": "b:9092", "subscribe": "a,b", "startingOffsets": "earliest"}
    assert jobs.kafka_source_options("b:9092", "a", "latest")["startingOffsets"] == "latest"


def _note(patient, at, why="why", **more):
    return {"patient_id": patient, "enrichment": True, "explained_at": at,
            "llm_explanation": {"escalation_reason": why, "is_ready": True}, **more}


def _put(root, name, rows):
    os.makedirs(os.path.join(root, "in"), exist_ok=True)
    with open(os.path.join(root, "in", name), "w") as fh:
        fh.write("\n".join(r if isinstance(r, str) else json.dumps(r) for r in rows))


def _run(start, spark, root, **more):
    out = start(spark, os.path.join(root, "in"), os.path.join(root, "out"), os.path.join(root, "chk"), **more)
    for q in out if isinstance(out, tuple) else (out,):
        q.awaitTermination()
    return os.path.join(root, "out")


def _known(spark, n=40):
    records = Q.stream_records(spark, SF001).limit(n).drop("consumer_received_at", "ml_done_at", "safety_done_at")
    return [r.asDict() for r in records.collect()]


def test_merged_job_loses_nothing(spark):
    """Notes before, after and without their record, repeats, old and time-less records, over three batches and a replay."""
    root = tempfile.mkdtemp(prefix="acurail-merged-")
    known = _known(spark)
    first, at = known[0], known[0]["produced_at"]
    _put(root, "a.json", [_note(first["patient_id"], at + 5.0), *known[:20], known[1],
                          {**known[3], "patient_id": "T", "produced_at": None}, {"patient_id": "Q1", "heart_rate": "x"}])
    out = _run(live.start_merged_job, spark, root)
    old = {**known[5], "produced_at": known[5]["produced_at"] - 10 * 86400, "age": 101.0}
    _put(root, "b.json", [*known[20:], old, _note(known[2]["patient_id"], at + 3600.0), _note("nobody", 1.0),
                          _note(first["patient_id"], at + 9.0, "later"), _note(None, at), _note("A", "soon"),
                          _note("B", None), {"patient_id": "C", "enrichment": True, "explained_at": at}, "not json"])
    _run(live.start_merged_job, spark, root)
    _put(root, "c.json", [_note(known[30]["patient_id"], at + 1.0, "earlier"), _note(known[30]["patient_id"], at + 2.0)])
    _run(live.start_merged_job, spark, root)
    rows = {r["key"]: json.loads(r["value"]) for r in live.published(live.merged_table(spark, out).current()).collect()}
    assert set(rows) == {r["patient_id"] for r in known}
    why = {k: r["llm_explanation"]["escalation_reason"] for k, r in rows.items() if "llm_explanation" in r}
    assert why == {first["patient_id"]: "why", known[2]["patient_id"]: "why", known[30]["patient_id"]: "earlier"}
    assert rows[first["patient_id"]]["explained_at"] == at + 5.0 and rows[known[5]["patient_id"]]["age"] == 101.0
    whole = layers.decision_record(layers.decisions(Q._enc(spark, SF001)), keep=("run_id",)).columns
    assert set(whole) - {"processed_at", "confidence_top2_acuity", "confidence_top2_pct"} <= {
        c for r in rows.values() for c in r} | {"confidence_top2_acuity", "confidence_top2_pct"}
    assert [r["patient_id"] for r in live.unmatched_notes(spark, out).collect()] == ["nobody"]
    reasons = Counter(r["reason"] for r in live.quarantined(spark, out, within_secs=1000.0).collect())
    assert reasons == {"no produced_at": 1, "damaged field: heart_rate": 1, "no explained_at": 2, "no explanation": 1,
                       "unparsable or missing patient_id": 2, "explanation without a record": 1}
    # What was published last for every patient is what the table holds.
    sent = spark.read.json(os.path.join(out, "published")).collect()
    newest = {}
    for r in sorted(sent, key=lambda r: r["batch_id"]):
        newest[r["key"]] = json.loads(r["value"])
    assert newest == rows


def test_counter_job_has_one_exact_row_a_run(spark):
    root = tempfile.mkdtemp(prefix="acurail-counters-")
    known = _known(spark, 60)
    for i, name in enumerate("abc"):
        _put(root, f"{name}.json", known[20 * i:20 * i + 20] + [_note(known[i]["patient_id"], 5.0), "{bad"])
        out = _run(live.start_counter_job, spark, root)  # a restart each time
    got = live.counter_table(spark, out).current().drop("first_produced_at", "last_produced_at").collect()
    ids = [r["patient_id"] for r in known]
    decided = layers.materialize(layers.decisions(Q._enc(spark, SF001).filter(F.col("patient_id").isin(ids))))
    batch = jobs.run_counters(decided.withColumn("produced_at", F.lit(0.0))).drop("first_produced_at", "last_produced_at")
    assert sorted(got) == sorted(batch.collect()) and len({r["run_id"] for r in got}) == len(got) > 1
    assert spark.read.parquet(os.path.join(out, "quarantine")).count() == 3
    table = live.counter_table(spark, out)
    assert len(child_names(spark, f"{table.path}/versions")) == 2


def test_keyed_table_replays_and_compacts(spark):
    root = tempfile.mkdtemp(prefix="acurail-keyed-")
    table = KeyedTable(spark, root, ["k"], "k string, n long", buckets=4)
    add = add_up(["k"], ["n"])

    def change(*rows):
        return spark.createDataFrame(list(rows), "k string, n long")

    assert table.current().count() == 0
    table.merge(0, change(("a", 1), ("b", 2), (None, 5)), add)
    table.merge(1, change(("a", 10)), add)
    table.merge(1, change(("a", 100), ("c", 1)), add)  # the batch is replayed
    assert {tuple(r) for r in table.current().collect()} == {("a", 101), ("b", 2), ("c", 1), (None, 5)}
    assert {tuple(r) for r in table.current(before=1).collect()} == {("a", 1), ("b", 2), (None, 5)}
    for batch in range(2, 8):
        before, after = table.merge(batch, change(("a", 1)), add)
        assert before.filter("k = 'a'").first()["n"] + 1 == after.filter("k = 'a'").first()["n"] == 100 + batch
    assert len(child_names(spark, f"{root}/versions")) == 2 and len(child_names(spark, f"{root}/data")) <= 4
    table.merge(8, change(), add)
    assert {tuple(r) for r in table.current().collect()} == {("a", 107), ("b", 2), ("c", 1), (None, 5)}


def test_messages_and_summary_do_not_depend_on_order(spark):
    """Explanations before and after their message, a later one and an earlier one: as the batch operators say."""
    root = tempfile.mkdtemp(prefix="acurail-messages-")
    records = Q.stream_records(spark, SF001).limit(50)
    known = [r.asDict() for r in records.collect()]
    notes = [_note(r["patient_id"], r["safety_done_at"] + 2.0 + i, enrichment_requested_at=None if i % 2 else
                   r["safety_done_at"] + 1.0) for i, r in enumerate(known[::3])]
    more = [_note(r["patient_id"], r["safety_done_at"] + (1.5 if i % 2 else 99.0)) for i, r in enumerate(known[::6])]
    schema = Q.stream_schema()
    _put(root, "a.json", notes[:8] + known[10:30])
    _run(live.start_message_job, spark, root, schema=schema)
    _put(root, "b.json", known[:10] + more + [_note("waits", 3.0)])
    _run(live.start_message_job, spark, root, schema=schema)
    _put(root, "c.json", known[30:] + notes[8:])
    out = _run(live.start_message_job, spark, root, schema=schema)
    told = spark.createDataFrame([(n["patient_id"], n["explained_at"], n.get("enrichment_requested_at"))
                                  for n in notes + more], "patient_id string, explained_at double, enrichment_requested_at double")
    made = layers.materialize(layers.decisions(records.withColumn("triage_acuity", F.col("true_acuity"))))
    batch = metrics.close_llm_segment(metrics.message_rows(made), told)
    got = live.live_messages(spark, out)
    assert got.count() == 50 and got.filter("llm_ms IS NOT NULL").count() == len(known[::3])
    cols = ["patient_id", "run_id", "e2e_ms", "explained_at", "llm_ms", "predicted_acuity"]
    assert got.select(cols).exceptAll(batch.select(cols)).count() == 0
    summary = metrics.run_summary(batch)
    assert sorted(live.live_run_summary(spark, out).select(summary.columns).collect(), key=str) == sorted(
        summary.collect(), key=str)


def test_recent_store_is_bounded_and_keeps_what_is_late(spark):
    root = tempfile.mkdtemp(prefix="acurail-recent-")
    rows = [{"patient_id": f"P{i}", "produced_at": 100.0 + i, "age": 1.0} for i in range(60)]
    _put(root, "a.json", rows[:40] + [{**rows[3], "age": 2.0}, {"patient_id": "T", "age": 1.0}])
    out = _run(live.start_recent_job, spark, root, n=5)
    held = live.recent_table(spark, out).current()
    assert held.count() <= 40 and held.groupBy("patient_id").count().filter("count > 1").count() == 0
    _put(root, "b.json", rows[40:] + [{"patient_id": "old", "produced_at": 1.0}])
    _put(root, "c.json", [{**rows[3], "produced_at": 500.0, "age": 7.0}])  # was pushed out: may come back
    out = _run(live.start_recent_job, spark, root, n=5)
    got = live.recent_records(spark, out, 5).collect()
    assert [r["patient_id"] for r in got] == ["P3", "P59", "P58", "P57", "P56"]
    assert json.loads(got[0]["value"])["age"] == 7.0
    assert [r["reason"] for r in spark.read.parquet(os.path.join(out, "quarantine")).collect()] == ["no produced_at"]
    late = {json.loads(r["raw_value"])["patient_id"] for r in spark.read.parquet(os.path.join(out, "quarantine_late")).collect()}
    assert "old" in late


def test_recent_job_decodes_a_line_once(spark):
    root = tempfile.mkdtemp(prefix="acurail-recent-")
    _put(root, "a.json", [{"patient_id": "P1", "produced_at": 1.0}, {"patient_id": "P2", "age": 2.0}])
    for q in live.start_recent_job(spark, os.path.join(root, "in"), os.path.join(root, "out"), os.path.join(root, "chk")):
        q.awaitTermination()
        plan = q._jsq.explainInternal(False)
        assert 1 <= plan.count("from_json(") <= 3, plan.count("from_json(")  # the record, and the text map of a broken line


def test_newest_pushes_out_the_oldest_as_a_full_search_does():
    import random

    import pandas as pd

    from acurail.streaming.recent import _Newest

    class Held(dict):
        def iterator(self):
            return iter([((k,), (v,)) for k, v in self.items()])

        def updateValue(self, k, v):
            self[k[0]] = v[0]

        def containsKey(self, k):
            return k[0] in self

        def removeKey(self, k):
            del self[k[0]]

    rnd, n = random.Random(7), 5
    job, known = _Newest(n), {}
    job.held = Held()
    for _ in range(40):
        rows = sorted((rnd.randrange(60) / 2, f"P{rnd.randrange(25)}") for _ in range(rnd.randrange(1, 12)))
        got = pd.concat(job.handleInputRows(("0",), iter([pd.DataFrame(
            [(p, t, "v") for t, p in rows], columns=["patient_id", "produced_at", "value"])]), None))
        want = []
        for t, p in rows:
            out = (None, None)
            if p in known:
                kind = "repeat"
            elif len(known) >= n and (t, p) < min((at, q) for q, at in known.items()):
                kind = "late"
            else:
                kind = "kept"
                if len(known) >= n:
                    q = min(known, key=lambda q: (known[q], q))
                    out = (q, known.pop(q))
                known[p] = t
            want.append((kind, p, t, *out))
        have = got.astype(object).where(got.notna(), None)
        assert list(have[["outcome", "patient_id", "produced_at", "pushed_out", "pushed_at"]].itertuples(index=False, name=None)) == want
        assert dict(job.held) == known


def test_decision_sink_keeps_no_column_that_it_does_not_write(spark, monkeypatch):
    kept = []
    real = type(spark.range(1)).persist
    monkeypatch.setattr(type(spark.range(1)), "persist", lambda self, *a: (kept.append(self.columns), real(self, *a))[1])
    d = jobs.decide_stream(Q.stream_records(spark, SF001).limit(20))
    jobs.decision_sink(tempfile.mkdtemp(prefix="acurail-sink-"))(d, 0)
    assert kept and all("probabilities" not in columns for columns in kept)


def test_jobs_take_streams_with_topics(spark):
    root = tempfile.mkdtemp(prefix="acurail-topics-")
    known = _known(spark, 5)
    note = _note(known[0]["patient_id"], known[0]["produced_at"] + 1.0)
    del note["enrichment"]  # told by its topic alone
    spark.createDataFrame([("triage", None, json.dumps(r)) for r in known] + [("notes", "k", json.dumps(note))],
                          "topic string, key string, value string").write.parquet(os.path.join(root, "in"))
    stream = spark.readStream.schema("topic string, key string, value string").parquet(os.path.join(root, "in"))
    for q in jobs.start_decision_job(spark, stream, os.path.join(root, "o1"), os.path.join(root, "c1"), note_topic="notes"):
        q.awaitTermination()
    assert spark.read.parquet(os.path.join(root, "o1", "decision_table")).count() == 5
    assert spark.read.parquet(os.path.join(root, "o1", "notes")).count() == 1
    assert spark.read.parquet(os.path.join(root, "o1", "quarantine")).count() == 0
    for q in live.start_merged_job(spark, stream, os.path.join(root, "o2"), os.path.join(root, "c2"), note_topic="notes"):
        q.awaitTermination()
    merged = live.merged_table(spark, os.path.join(root, "o2")).current()
    assert merged.count() == 5 and merged.filter("note IS NOT NULL").count() == 1


def test_enrichment_job_publishes_messages_of_the_gate(spark):
    root = tempfile.mkdtemp(prefix="acurail-explained-")
    known = _known(spark, 60)
    _put(root, "a.json", [*known, "{bad"])

    def explain(called):
        return called.filter("patient_id <> 'none'").select(F.col("patient_id").alias("response_id"), F.concat(
            F.lit("ESCALATION_REASON:\nbecause\n\nRISK_FLAGS:\n- a\n\nCONFIDENCE_NOTE:\nlow")).alias("response_text"))

    q = jobs.start_enrichment_job(spark, os.path.join(root, "in"), os.path.join(root, "out"), os.path.join(root, "chk"),
                                  explain)
    q.awaitTermination()
    from acurail.operators import review
    decided = layers.materialize(layers.decisions(Q._enc(spark, SF001).filter(
        F.col("patient_id").isin([r["patient_id"] for r in known]))))
    called = layers.materialize(review.escalation_gate(decided)).filter("should_call_llm")
    sent = {r["key"]: json.loads(r["value"]) for r in spark.read.json(os.path.join(root, "out", "enrichment")).collect()}
    assert set(sent) == {r["patient_id"] for r in called.collect()} and sent
    one = next(iter(sent.values()))
    assert one["enrichment"] is True and one["enrichment_requested_at"] > 0
    assert one["llm_explanation"]["escalation_reason"] == "because" and one["llm_explanation"]["escalation_code"] != "NONE"
    assert spark.read.parquet(os.path.join(root, "out", "quarantine")).count() == 1


def test_enrichment_join_attaches_explanation(spark):
    root = tempfile.mkdtemp(prefix="acurail-enrich-")
    for d in ("dec", "enr"):
        os.makedirs(os.path.join(root, d))
    with open(os.path.join(root, "dec", "d.json"), "w") as fh:
        fh.write("\n".join(json.dumps({"patient_id": p, "produced_at": t}) for p, t in (("A", 100.0), ("B", 100.0))))
    with open(os.path.join(root, "enr", "e.json"), "w") as fh:
        fh.write(json.dumps({"patient_id": "A", "enrichment": True, "explained_at": 101.5,
                             "llm_explanation": {"escalation_reason": "why", "is_ready": True}}))
    dec = spark.readStream.schema("patient_id string, produced_at double").json(os.path.join(root, "dec"))
    enr = spark.readStream.schema(jobs.ENRICHMENT_SCHEMA).json(os.path.join(root, "enr"))
    q = (jobs.attach_enrichment(dec, enr).writeStream.format("memory").queryName("enriched_out")
         .option("checkpointLocation", os.path.join(root, "chk")).trigger(availableNow=True).start())
    q.awaitTermination()
    got = {r["patient_id"]: r["llm_explanation"] for r in spark.sql("SELECT * FROM enriched_out").collect()}
    assert got["A"]["escalation_reason"] == "why"


def test_run_counters_update_mode(spark):
    root = tempfile.mkdtemp(prefix="acurail-counters-")
    path = Q.run_decision_stream(spark, SF001)
    d = spark.read.parquet(os.path.join(path, "out", "decision_table"))
    os.makedirs(os.path.join(root, "in"))
    d.write.parquet(os.path.join(root, "in", "p"))
    stream = spark.readStream.schema(d.schema).parquet(os.path.join(root, "in", "p"))
    q = (jobs.run_counters(stream).writeStream.outputMode("update").format("memory").queryName("counters_out")
         .option("checkpointLocation", os.path.join(root, "chk")).trigger(availableNow=True).start())
    q.awaitTermination()
    got = spark.sql("SELECT run_id, max(processed) AS n FROM counters_out GROUP BY run_id")
    assert got.agg(F.sum("n")).first()[0] == 1000


def test_feedback_stream_matches_batch_flat(spark):
    root = tempfile.mkdtemp(prefix="acurail-feedback-")
    events = Q.events_table(spark, SF001).drop("submitted_at")
    events.select(F.to_json(F.struct("*"))).repartition(3).write.text(os.path.join(root, "in", "a"))
    qs = jobs.start_feedback_job(spark, os.path.join(root, "in", "*"), os.path.join(root, "out"),
                                 os.path.join(root, "chk"), events.schema, stats_every=20)
    for q in qs:
        q.awaitTermination()
    flat = spark.read.parquet(os.path.join(root, "out", "feedback"))
    batch = Q.flat_table(spark, SF001)
    assert flat.count() == batch.count() == events.count()
    cols = ["patient_id", "feedback_type", "final_label", "guardrail_acuity", "safety_rail_reasons", "hx_copd"]
    assert flat.select(*cols).exceptAll(batch.select(*cols)).count() == 0
    assert spark.read.parquet(os.path.join(root, "out", "overrides")).count() == flat.count()
    stats = spark.read.parquet(os.path.join(root, "out", "feedback_stats"))
    assert stats.agg(F.sum("n")).first()[0] == flat.count()


def test_enrichment_messages(spark):
    from acurail.operators import review
    from acurail.sources import tables
    d = Q.decided(spark, SF001)
    gated = review.escalation_gate(tables.message_times(d)).withColumn(
        "enrichment_requested_at", F.col("safety_done_at"))
    parsed = review.parse_responses(tables.explanation_texts(d))
    msgs = jobs.enrichment_messages(gated, parsed)
    r = msgs.first()
    assert r["enrichment"] is True and r["llm_explanation"]["is_ready"] is True
    assert msgs.filter(F.col("llm_explanation.escalation_code") == "NONE").count() == 0


def test_route_by_sentinel_splits_two_topics(spark):
    values = spark.createDataFrame([('{"patient_id": "A", "predicted_acuity": 2}',),
                                    ('{"patient_id": "A", "enrichment": true}',),
                                    ('{"patient_id": "B", "enrichment": false}',)], "value string")
    decisions, enrichment = jobs.route_by_sentinel(values)
    assert decisions.count() == 2 and enrichment.count() == 1
    parsed = enrichment.select(F.from_json("value", jobs.ENRICHMENT_SCHEMA).alias("e")).first()["e"]
    assert parsed["patient_id"] == "A" and parsed["enrichment"] is True


def test_stream_scoring_with_trained_model_matches_batch(spark):
    from acurail.operators import training
    split = Q.split_training(spark, SF001)
    model, _ = training.train_candidates(split, Q.MODEL_NUMERIC, Q.MODEL_CATEGORICAL,
                                         names=["Logistic Regression"])
    root = tempfile.mkdtemp(prefix="acurail-scored-")
    recs = Q.stream_records(spark, SF001).drop("p1", "p2", "p3", "p4", "p5")
    recs.select(F.to_json(F.struct("*"))).repartition(2).write.text(os.path.join(root, "in", "a"))
    for q in jobs.start_decision_job(spark, os.path.join(root, "in", "*"), os.path.join(root, "out"),
                                     os.path.join(root, "chk"), model=model):
        q.awaitTermination()
    out = spark.read.parquet(os.path.join(root, "out", "decision_table"))
    assert out.count() == 1000 and set(out.select("model").distinct().toPandas()["model"]) == {model.name}
    # A model that was saved and loaded again scores a batch like the stream did.
    model.save(os.path.join(root, "bundle"))
    loaded = training.TriageModel.load(spark, os.path.join(root, "bundle"))
    batch = loaded.transform(Q._enc(spark, SF001).drop("p1", "p2", "p3", "p4", "p5"))
    j = out.select("patient_id", "p1", "p3").join(
        batch.select("patient_id", F.col("p1").alias("b1"), F.col("p3").alias("b3")), "patient_id")
    assert j.count() == 1000
    assert j.filter("abs(p1 - b1) > 1e-9 OR abs(p3 - b3) > 1e-9").count() == 0


def test_a_merge_moves_the_table_once_and_publishing_reads_no_other_key(spark):
    """Published JSON is compressed, and only the fold shuffles: before, the rows were dealt to buckets and joined again."""
    import glob

    from acurail.streaming.keyed import KeyedTable, add_up
    root = tempfile.mkdtemp(prefix="acurail-once-")
    known = _known(spark, 20)
    _put(root, "a.json", known[:10])
    out = _run(live.start_merged_job, spark, root)
    _put(root, "b.json", [*known[10:], _note(known[0]["patient_id"], known[0]["produced_at"] + 1.0)])
    _run(live.start_merged_job, spark, root)
    files = glob.glob(os.path.join(out, "published", "*", "part-*"))
    assert files and all(f.endswith(".json.gz") for f in files)
    sent = spark.read.json(os.path.join(out, "published")).filter("batch_id = 1").collect()
    assert {r["key"] for r in sent} == {known[0]["patient_id"], *(r["patient_id"] for r in known[10:])}

    seen, plans = KeyedTable(spark, os.path.join(root, "t"), ["k"], "k string, n long"), []
    fold = add_up(["k"], ["n"])

    def watched(before, changes):
        rows = fold(before, changes)
        plans.append(rows)
        return rows
    hints = []
    real = type(spark.range(1)).hint
    try:
        type(spark.range(1)).hint = lambda self, name, *a: hints.append(name) or real(self, name, *a)
        for i in range(2):
            seen.merge(i, spark.createDataFrame([("a", 1), (None, 2)], "k string, n long"), watched)
    finally:
        type(spark.range(1)).hint = real
    assert "rebalance" not in hints and len(plans) == 2
    assert sorted(seen.current().collect(), key=str) == sorted([("a", 2), (None, 4)], key=str)


def test_batches_are_stored_not_held_in_memory(spark, tmp_path, monkeypatch):
    """Decision and merged job cache no wide rows, set bad lines aside with their text and leave no folder behind."""
    from pyspark.sql.classic.dataframe import DataFrame as Frame
    held = []
    monkeypatch.setattr(Frame, "persist", lambda self, *a: held.append(self) or self)
    monkeypatch.setattr(Frame, "cache", lambda self: held.append(self) or self)
    src = tmp_path / "in"
    src.mkdir()
    good = [json.dumps({"patient_id": f"P{i}", "produced_at": 10.0 + i, "run_id": "r", "true_acuity": 3, "heart_rate": 80.0 + i,
                        "p1": 0.1, "p2": 0.2, "p3": 0.4, "p4": 0.2, "p5": 0.1}) for i in range(9)]
    note = json.dumps({"patient_id": "P4", "enrichment": True, "explained_at": 50.0, "llm_explanation": {"is_ready": True}})
    bad = '{"patient_id": "PX", "produced_at": 1.0, "heart_rate": "fast"}'
    (src / "a.txt").write_text("\n".join([*good, note, bad]))
    for name, start in (("decided", jobs.start_decision_job), ("merged", live.start_merged_job)):
        out = str(tmp_path / name)
        for q in start(spark, str(src), out, str(tmp_path / f"{name}-chk")):
            q.awaitTermination()
        aside = spark.read.parquet(os.path.join(out, "quarantine")).collect()
        assert [(r["raw_value"], r["reason"]) for r in aside] == [(bad, "damaged field: heart_rate")]
    table = spark.read.parquet(str(tmp_path / "decided" / "decision_table")).collect()
    assert sorted(r["patient_id"] for r in table) == [f"P{i}" for i in range(9)]
    sent = spark.read.json(str(tmp_path / "decided" / "decisions")).collect()
    assert sorted(r["key"] for r in sent) == [f"P{i}" for i in range(9)]
    merged = {r["patient_id"]: r["note"] for r in live.merged_table(spark, str(tmp_path / "merged")).current().collect()}
    assert len(merged) == 9 and [k for k, v in merged.items() if v] == ["P4"]
    assert not [f.columns for f in held if {"value", "r", "record", "safety_notes"} & set(f.columns)]  # nothing wide
    assert not [n for n in os.listdir(spark.conf.get("spark.checkpoint.dir")) if n.startswith("acurail-batch")]
