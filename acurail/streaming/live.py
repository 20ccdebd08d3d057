"""Tables that streams keep current: merged records, run counters, messages with latency, the newest records.

All but the last are ``KeyedTable``s that every micro-batch merges into. Their
state lives in the tables, so nothing is late: a record or an explanation may
come in any order and at any time, and the rows that cannot be used are set
aside with a reason. The result depends on the messages only, not on their order.
"""

from __future__ import annotations

import os
import time
from contextlib import ExitStack

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from acurail.functions.ordered import exact_percentiles
from acurail.operators import layers, metrics
from acurail.streaming import jobs, recent
from acurail.streaming.keyed import KeyedTable, add_up


def _decoded(raw: DataFrame, schema: T.StructType, note_topic: str | None) -> tuple[DataFrame, DataFrame]:
    """(records, explanation messages) of a batch, decoded and kept for its several uses."""
    records, notes = jobs.route_by_sentinel(raw, note_topic)
    return jobs.decode(records, schema, need_time=True).persist(), jobs.decode_notes(notes).persist()


def _quarantine(out_dir: str, batch_id: int, *decoded: DataFrame) -> None:
    bad = jobs.set_aside(decoded[0])
    for d in decoded[1:]:
        bad = bad.unionByName(jobs.set_aside(d))
    jobs._write_batch(bad, os.path.join(out_dir, "quarantine"), batch_id)


# ---------------------------------------------------------------- merged records
MERGED = ("patient_id string, produced_at double, record string, explained_at double, "
          "enrichment_requested_at double, note string, batch long")


def merged_table(spark: SparkSession, out_dir: str) -> KeyedTable:
    """A patient's record and explanation, and the last ``batch`` that told something of the patient."""
    return KeyedTable(spark, f"{out_dir}/merged", ["patient_id"], MERGED)


def _fold_merged(before: DataFrame, changes: DataFrame) -> DataFrame:
    record = F.when(F.col("record").isNotNull(), F.struct("produced_at", "record"))
    note = F.when(F.col("note").isNotNull(), F.struct("explained_at", "enrichment_requested_at", "note"))
    return before.unionByName(changes, allowMissingColumns=True).groupBy("patient_id").agg(
        F.min(record).alias("r"), F.min(note).alias("n"), F.max("batch").alias("batch")).select(
        "patient_id", "r.*", "n.*", "batch")


def published(merged: DataFrame) -> DataFrame:
    """(key, value) JSON of merged rows that have a record: the whole decision record and its explanation."""
    times = F.to_json(F.struct("explained_at", "enrichment_requested_at"))
    whole = F.when(F.col("note").isNull(), F.col("record")).otherwise(F.concat(
        F.expr("left(record, length(record) - 1)"), F.lit(","), F.regexp_replace(times, r"^\{|\}$", ""),
        F.lit(',"llm_explanation":'), F.col("note"), F.lit("}")))
    return merged.filter(F.col("record").isNotNull()).select(F.col("patient_id").alias("key"), whole.alias("value"))


def start_merged_job(spark: SparkSession, source: str | DataFrame, out_dir: str, checkpoint: str,
                     record_schema: T.StructType = jobs.INPUT_SCHEMA, note_topic: str | None = None,
                     kafka: dict[str, str] | None = None, available_now: bool = True):
    """One stream of records and explanations -> routed, decided, one row per patient, published.

    The patient's earliest record wins, and the earliest explanation is joined
    to it, whichever comes first; both sides are kept while the other is
    missing (``unmatched_notes``). A batch publishes the patients that it
    touched, with their whole decision record. Returns the started query in a tuple.
    """
    publish = jobs.publisher(out_dir, "published", kafka)

    def sink(raw: DataFrame, batch_id: int) -> None:
        lines, told_lines = jobs.route_by_sentinel(raw, note_topic)
        decoded = jobs.decode(lines, record_schema, need_time=True), jobs.decode_notes(told_lines)
        with ExitStack() as stack:
            records, notes = (stack.enter_context(jobs.kept(jobs.without_sound_text(d))) for d in decoded)
            _quarantine(out_dir, batch_id, records, notes)
            changes = stack.enter_context(jobs.kept(merged_changes(records, notes, batch_id)))
            _, after = merged_table(spark, out_dir).merge(batch_id, changes, _fold_merged)
            publish(published(after.filter(F.col("batch") == batch_id)), batch_id)

    return (jobs.started(jobs.messages_of(spark, source), sink, checkpoint, "merged", available_now),)


def merged_changes(records: DataFrame, notes: DataFrame, batch_id: int) -> DataFrame:
    """What a batch's decoded records and explanations tell of their patients, in the columns of the merged table."""
    made = layers.decision_record(jobs.decide_stream(jobs.sound(records)), keep=("produced_at",)).select(
        "patient_id", "produced_at", F.to_json(F.struct("*")).alias("record"))
    told = jobs.sound(notes).select("patient_id", "explained_at", "enrichment_requested_at",
                                    F.to_json("llm_explanation").alias("note"))
    return made.unionByName(told, allowMissingColumns=True).withColumn("batch", F.lit(batch_id).cast("long"))


def unmatched_notes(spark: SparkSession, out_dir: str) -> DataFrame:
    """Explanations that wait for their record."""
    return merged_table(spark, out_dir).current().filter(F.col("record").isNull()).select(
        "patient_id", "explained_at", "note")


def quarantined(spark: SparkSession, out_dir: str, within_secs: float = 86_400.0) -> DataFrame:
    """(raw_value, reason) of all that the merged job set aside, and of explanations whose record is overdue.

    An explanation is overdue ``within_secs`` before the newest time in the table.
    """
    rows = merged_table(spark, out_dir).current()
    newest = rows.agg(F.greatest(F.max("produced_at"), F.max("explained_at")).alias("newest"))
    overdue = unmatched_notes(spark, out_dir).crossJoin(F.broadcast(newest)).filter(  # one row
        F.col("explained_at") < F.col("newest") - within_secs).select(
        F.to_json(F.struct("patient_id", "explained_at", "note")).alias("raw_value"),
        F.lit("explanation without a record").alias("reason"))
    return spark.read.parquet(os.path.join(out_dir, "quarantine")).select("raw_value", "reason").unionByName(overdue)


# ---------------------------------------------------------------- run counters
_COUNTS = ["processed", "correct", "rail_hits", "conf_hits", "conflict_hits"]
COUNTERS = ("run_id string, " + ", ".join(f"{c} long" for c in _COUNTS)
            + ", first_produced_at double, last_produced_at double")


def counter_table(spark: SparkSession, out_dir: str) -> KeyedTable:
    return KeyedTable(spark, f"{out_dir}/run_counters", ["run_id"], COUNTERS)


def start_counter_job(spark: SparkSession, source: str | DataFrame, out_dir: str, checkpoint: str,
                      schema: T.StructType = jobs.INPUT_SCHEMA, note_topic: str | None = None,
                      available_now: bool = True):
    """Live counters: one current row per run, to which every micro-batch adds its counts.

    Explanation messages are not counted; bad records are quarantined.
    """
    def sink(raw: DataFrame, batch_id: int) -> None:
        decoded = jobs.decode(jobs.route_by_sentinel(raw, note_topic)[0], schema).persist()
        jobs._write_batch(jobs.set_aside(decoded), os.path.join(out_dir, "quarantine"), batch_id)
        counts = jobs.run_counters(jobs.decide_stream(jobs.sound(decoded))).persist()
        counter_table(spark, out_dir).merge(batch_id, counts, add_up(
            ["run_id"], _COUNTS, least=["first_produced_at"], most=["last_produced_at"]))
        counts.unpersist()
        decoded.unpersist()

    return jobs.started(jobs.messages_of(spark, source), sink, checkpoint, "counters", available_now)


# ---------------------------------------------------------------- messages and their latency
_MESSAGE = ["run_id", "patient_id", "produced_at", "consumer_received_at", "ml_done_at", "safety_done_at",
            *metrics.SEGMENTS, "safety_rail_triggered", "true_acuity", "predicted_acuity"]
_WHOLE = ("safety_rail_triggered", "true_acuity", "predicted_acuity")
MESSAGES = ", ".join(f"{c} {'string' if c in ('run_id', 'patient_id') else 'int' if c in _WHOLE else 'double'}"
                     for c in _MESSAGE) + ", explained_at double, enrichment_requested_at double, is_message boolean"
VALUES = "run_id string, segment string, value double, n long"
TOTALS = "run_id string, message_count long, rated long, rail_hits long, t0 double, t1 double"


def message_table(spark: SparkSession, out_dir: str) -> KeyedTable:
    """Messages and the explanations that close them, by patient; explanations that wait have ``is_message`` false."""
    return KeyedTable(spark, f"{out_dir}/message_table", ["patient_id"], MESSAGES)


def value_table(spark: SparkSession, out_dir: str) -> KeyedTable:
    """How often each duration occurs in a run's segment."""
    return KeyedTable(spark, f"{out_dir}/segment_values", ["run_id", "segment", "value"], VALUES)


def total_table(spark: SparkSession, out_dir: str) -> KeyedTable:
    return KeyedTable(spark, f"{out_dir}/run_totals", ["run_id"], TOTALS)


def _fold_messages(before: DataFrame, changes: DataFrame) -> DataFrame:
    rows = before.unionByName(changes, allowMissingColumns=True)
    first = metrics.first_explanations(rows).withColumnRenamed("patient_id", "_p")
    messages = rows.filter("is_message").drop("explained_at", "enrichment_requested_at")
    return messages.join(first, F.col("patient_id") == F.col("_p"), "full_outer").withColumns({
        "patient_id": F.coalesce("patient_id", "_p"), "is_message": F.coalesce("is_message", F.lit(False))}).drop("_p")


def _counted(messages: DataFrame, sign: int) -> DataFrame:
    entries = F.array(*[F.struct(F.lit(k).alias("segment"), F.col(v).cast("double").alias("value"))
                        for k, v in metrics.SUMMARY_SEGMENTS.items()])
    return (messages.filter("is_message").withColumn("llm_ms", metrics.llm_ms()).select("run_id", F.inline(entries))
            .filter(F.col("value").isNotNull()).withColumn("n", F.lit(sign).cast("long")))


def _fold_values(before: DataFrame, changes: DataFrame) -> DataFrame:
    return add_up(["run_id", "segment", "value"], ["n"])(before, changes).filter("n <> 0")


def message_sink(spark: SparkSession, out_dir: str, schema: T.StructType, note_topic: str | None = None):
    """Merges a batch into the messages, and what that changed into the durations and totals of the runs.

    Only the buckets of the batch's patients are read and written; a duration
    that an earlier explanation replaces is taken out of the counts again.
    """
    def sink(raw: DataFrame, batch_id: int) -> None:
        received = time.time()
        records, notes = _decoded(raw, schema, note_topic)
        _quarantine(out_dir, batch_id, records, notes)
        made = jobs.decide_stream(jobs.sound(records))
        made = metrics.message_rows(jobs.stamped(made, received, time.time())).withColumn("is_message", F.lit(True))
        told = jobs.sound(notes).select("patient_id", "explained_at", "enrichment_requested_at",
                                        F.lit(False).alias("is_message"))
        changes = made.unionByName(told, allowMissingColumns=True).persist()
        before, after = message_table(spark, out_dir).merge(batch_id, changes, _fold_messages)
        touched = changes.select("patient_id").distinct().persist()
        delta = _counted(after.join(touched, "patient_id", "left_semi"), 1).unionByName(
            _counted(before.join(touched, "patient_id", "left_semi"), -1)).groupBy("run_id", "segment", "value").agg(
            F.sum("n").alias("n")).filter("n <> 0").persist()
        value_table(spark, out_dir).merge(batch_id, delta, _fold_values)
        totals = changes.filter("is_message").groupBy("run_id").agg(
            F.count(F.lit(1)).alias("message_count"), F.count("safety_rail_triggered").alias("rated"),
            F.sum("safety_rail_triggered").cast("long").alias("rail_hits"),
            F.min(F.when(F.col("produced_at") != 0, F.col("produced_at"))).alias("t0"),
            F.max(F.when(F.col("safety_done_at") != 0, F.col("safety_done_at"))).alias("t1")).persist()
        total_table(spark, out_dir).merge(batch_id, totals, add_up(
            ["run_id"], ["message_count", "rated", "rail_hits"], least=["t0"], most=["t1"]))
        for d in (totals, delta, touched, changes, records, notes):
            d.unpersist()
    return sink


def start_message_job(spark: SparkSession, source: str | DataFrame, out_dir: str, checkpoint: str,
                      schema: T.StructType = jobs.INPUT_SCHEMA, note_topic: str | None = None,
                      available_now: bool = True):
    """A12 + D5 + E7 as a stream; see ``message_sink``."""
    return jobs.started(jobs.messages_of(spark, source), message_sink(spark, out_dir, schema, note_topic),
                        checkpoint, "messages", available_now)


def live_messages(spark: SparkSession, out_dir: str) -> DataFrame:
    """The message rows with their explanation segment, as ``metrics.close_llm_segment`` gives them."""
    return message_table(spark, out_dir).current().filter("is_message").withColumn("llm_ms", metrics.llm_ms()).drop(
        "is_message", "enrichment_requested_at")


def live_run_summary(spark: SparkSession, out_dir: str) -> DataFrame:
    """``metrics.run_summary`` from the counted durations and totals; no message is read."""
    t = total_table(spark, out_dir).current()
    duration = F.col("t1") - F.col("t0")
    base = t.select("run_id", "message_count", (F.col("rail_hits") / F.col("rated")).alias("rail_hit_rate"),
                    F.timestamp_seconds("t0").alias("started_at"), duration.alias("duration_secs"),
                    F.when(duration != 0, F.col("message_count") / duration).alias("throughput_msg_sec"))
    pct = exact_percentiles(value_table(spark, out_dir).current(), ["run_id", "segment"], "value", [0.5, 0.95],
                            count="n")
    segments = list(metrics.SUMMARY_SEGMENTS)
    wide = pct.groupBy("run_id").pivot("segment", segments).agg(F.first("q50").alias("p50"), F.first("q95").alias("p95"))
    wide = wide.select("run_id", *[F.col(f"{k}_{p}").alias(f"{p}_{k}_ms") for k in segments for p in ("p50", "p95")])
    return base.join(wide, "run_id", "left")


# ---------------------------------------------------------------- the newest records
RECENT = "patient_id string, produced_at double, value string, n long"


def recent_table(spark: SparkSession, out_dir: str) -> KeyedTable:
    return KeyedTable(spark, f"{out_dir}/recent", ["patient_id"], RECENT)


def start_recent_job(spark: SparkSession, source: str | DataFrame, out_dir: str, checkpoint: str, n: int = 100,
                     schema: T.StructType = jobs.INPUT_SCHEMA, note_topic: str | None = None,
                     available_now: bool = True):
    """J2 + F4: the newest ``n`` patients' first records; late and bad records are quarantined.

    Returns the started queries (store, quarantine of bad records).
    """
    raw = jobs.route_by_sentinel(jobs.messages_of(spark, source), note_topic)[0]
    decoded = jobs.settled(jobs.decode(raw, schema, need_time=True))
    good = decoded.filter(F.col("reason").isNull()).select("r.patient_id", "r.produced_at", "value")

    def store(events: DataFrame, batch_id: int) -> None:
        events = events.persist()
        jobs._write_batch(events.filter("outcome = 'late'").select(F.col("value").alias("raw_value"),
                                                                   F.lit("late").alias("reason")),
                          os.path.join(out_dir, "quarantine_late"), batch_id)
        kept = events.filter("outcome = 'kept'").select("patient_id", "produced_at", "value", F.lit(1).alias("n"))
        gone = events.filter("pushed_out IS NOT NULL").select(
            F.col("pushed_out").alias("patient_id"), F.col("pushed_at").alias("produced_at"),
            F.lit(None).cast("string").alias("value"), F.lit(-1).alias("n"))
        recent_table(spark, out_dir).merge(batch_id, kept.unionByName(gone), _fold_recent)
        events.unpersist()

    def bad(rows: DataFrame, batch_id: int) -> None:
        jobs._write_batch(rows, os.path.join(out_dir, "quarantine"), batch_id)

    return (jobs.started(recent.newest(good, n), store, checkpoint, "recent", available_now),
            jobs.started(jobs.set_aside(decoded), bad, checkpoint, "recent_quarantine", available_now))


def _fold_recent(before: DataFrame, changes: DataFrame) -> DataFrame:
    return before.unionByName(changes.withColumn("n", F.col("n").cast("long"))).groupBy("patient_id", "produced_at").agg(
        F.max("value").alias("value"), F.sum("n").alias("n")).filter("n > 0").select("patient_id", "produced_at",
                                                                                      "value", "n")


def recent_records(spark: SparkSession, out_dir: str, n: int = 100) -> DataFrame:
    """(patient_id, produced_at, value) of the newest ``n`` first records."""
    return recent_table(spark, out_dir).current().orderBy(F.desc("produced_at"), "patient_id").limit(n).select(
        "patient_id", "produced_at", "value")
