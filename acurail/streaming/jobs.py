"""Structured Streaming jobs.

Every job reuses the batch transforms: a micro-batch is just a DataFrame.
Sources are a JSON-lines text source (local and tests) or Kafka (same
function, ``value`` cast to string); sinks are ``foreachBatch`` writers that
are idempotent per batch id, so a restart from the checkpoint replays a batch
without duplicating rows (J9).
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from acurail.constants import HISTORY_COLS
from acurail.operators import feedback, layers, metrics
from acurail.session import delete_folder, ensure_checkpoint_dir

INPUT_SCHEMA = T.StructType(
    [T.StructField("patient_id", T.StringType()), T.StructField("timestamp", T.StringType()),
     T.StructField("produced_at", T.DoubleType()), T.StructField("run_id", T.StringType()),
     T.StructField("true_acuity", T.IntegerType()), T.StructField("event_id", T.LongType()),
     T.StructField("age", T.DoubleType()), T.StructField("sex", T.StringType()),
     T.StructField("mental_status_triage", T.StringType()), T.StructField("chief_complaint_raw", T.StringType())]
    + [T.StructField(c, T.DoubleType()) for c in (
        "heart_rate", "systolic_bp", "diastolic_bp", "respiratory_rate", "temperature_c", "spo2",
        "gcs_total", "pain_score", "news2_score")]
    + [T.StructField(c, T.IntegerType()) for c in HISTORY_COLS]
    + [T.StructField(f"p{k}", T.DoubleType()) for k in range(1, 6)]
)

ENRICHMENT_SCHEMA = T.StructType([
    T.StructField("patient_id", T.StringType()), T.StructField("enrichment", T.BooleanType()),
    T.StructField("enrichment_requested_at", T.DoubleType()), T.StructField("explained_at", T.DoubleType()),
    T.StructField("llm_explanation", T.StructType([
        T.StructField("escalation_reason", T.StringType()), T.StructField("patient_summary", T.StringType()),
        T.StructField("risk_flags", T.ArrayType(T.StringType())), T.StructField("confidence_note", T.StringType()),
        T.StructField("full_text", T.StringType()), T.StructField("escalation_code", T.StringType()),
        T.StructField("escalation_label", T.StringType()), T.StructField("escalation_detail", T.StringType()),
        T.StructField("is_ready", T.BooleanType()), T.StructField("error", T.StringType())])),
])


# ---------------------------------------------------------------- sources
def read_json_lines(spark: SparkSession, path: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """A4 (local form): a directory of JSON-lines files as a stream of ``value`` strings."""
    r = spark.readStream.format("text")
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return r.load(path)


def kafka_source_options(servers: str, topics: str, starting: str = "earliest") -> dict[str, str]:
    """A4/A5: options of a Kafka source. The scorer starts at the earliest offsets, the merged reader at the latest."""
    return {"kafka.bootstrap.servers": servers, "subscribe": topics, "startingOffsets": starting}


def read_kafka(spark: SparkSession, servers: str, topics: str, starting: str = "earliest") -> DataFrame:
    """A4/A5: Kafka topics (comma-separated) as a stream of (topic, key, value); needs the Kafka connector."""
    return (spark.readStream.format("kafka").options(**kafka_source_options(servers, topics, starting)).load()
            .select(F.col("topic"), F.col("key").cast("string").alias("key"), F.col("value").cast("string")))


def messages_of(spark: SparkSession, source: str | DataFrame) -> DataFrame:
    """A job's input: a folder of JSON lines, or any stream with ``value`` (and ``topic``, ``key``)."""
    return read_json_lines(spark, source) if isinstance(source, str) else source


def decode(raw: DataFrame, schema: T.StructType = INPUT_SCHEMA, need_time: bool = False) -> DataFrame:
    """A17 + B12: (value, r, reason) of JSON lines; ``reason`` is null for sound records.

    A record that fails to parse, lacks a key or holds a damaged field has a
    reason. Whole-number floats (``1.0``) are accepted in integer fields. A
    field that is present but is not of its type (a text vital, ``2.5`` in an
    integer field) is damaged: the record is set aside with the field's name,
    never scored as if the value were missing. With ``need_time`` a record
    without ``produced_at`` is set aside too. A line is decoded once; only
    those in which the decoder met a damaged value are looked at field by field.
    """
    whole = [f.name for f in schema.fields if isinstance(f.dataType, (T.IntegerType, T.LongType))]
    wide = T.StructType([T.StructField(f.name, T.DoubleType() if f.name in whole else f.dataType)
                         for f in schema.fields] + [T.StructField("_broken", T.StringType())])
    parsed = raw.select("value", F.from_json("value", wide, {
        "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken"}).alias("r"))
    broken = F.col("r._broken").isNotNull()
    parsed = parsed.select("value", "r", F.when(broken, F.from_json("value", "map<string,string>")).alias("m"))
    lost = F.when(broken, F.array_compact(F.array(*[
        F.when(F.col("m")[f.name].isNotNull() & F.col(f"r.{f.name}").isNull(), F.lit(f.name)) for f in schema.fields])))
    uneven = F.array_compact(F.array(*[F.when(F.col(f"r.{c}") != F.floor(f"r.{c}"), F.lit(c)) for c in whole])) \
        if whole else F.array().cast("array<string>")
    damaged = F.concat(F.coalesce(lost, F.array().cast("array<string>")), uneven)
    keyed = F.coalesce(F.col("r.patient_id") != "", F.lit(False))
    reason = F.when(~keyed | (broken & F.col("m").isNull()), F.lit("unparsable or missing patient_id")).when(
        F.size(damaged) > 0, F.concat(F.lit("damaged field: "), F.array_join(damaged, ", ")))
    if need_time:
        reason = reason.when(F.col("r.produced_at").isNull() | F.isnan("r.produced_at"), F.lit("no produced_at"))
    return parsed.select("value", F.struct(*[F.col(f"r.{f.name}").cast(f.dataType).alias(f.name)
                                             for f in schema.fields]).alias("r"), reason.alias("reason"))


def settled(df: DataFrame) -> DataFrame:
    """``df`` behind a generator: a filter on its columns stays above it.

    A filter on ``reason`` of a decoded stream is else pushed below the projections and takes the decoder with it,
    once for every reference to a field of the record. Stored or persisted frames need no such thing.
    """
    return df.select(F.inline(F.array(F.struct(*df.columns))))


def decode_notes(raw: DataFrame) -> DataFrame:
    """(value, r, reason) of explanation messages; those without patient, time or explanation have a reason."""
    parsed = raw.select("value", F.from_json("value", ENRICHMENT_SCHEMA).alias("r"))
    reason = F.when(~F.coalesce(F.col("r.patient_id") != "", F.lit(False)), F.lit("unparsable or missing patient_id")) \
        .when(F.col("r.explained_at").isNull() | F.isnan("r.explained_at"), F.lit("no explained_at")) \
        .when(F.col("r.llm_explanation").isNull(), F.lit("no explanation"))
    return parsed.select("value", "r", reason.alias("reason"))


def sound(decoded: DataFrame) -> DataFrame:
    return decoded.filter(F.col("reason").isNull()).select("r.*")


def set_aside(decoded: DataFrame) -> DataFrame:
    return decoded.filter(F.col("reason").isNotNull()).select(F.col("value").alias("raw_value"), "reason")


def parse_records(raw: DataFrame, schema: T.StructType = INPUT_SCHEMA) -> tuple[DataFrame, DataFrame]:
    """(sound records, records set aside with their reason); see ``decode``."""
    decoded = decode(raw, schema)
    return sound(decoded), set_aside(decoded)


def is_note(values: DataFrame, note_topic: str | None = None) -> Column:
    """A5/H2: whether a message is an explanation: by its topic, or by the ``enrichment`` sentinel."""
    flag = F.col("value").contains('"enrichment"') & (F.get_json_object("value", "$.enrichment") == "true")
    if note_topic is not None and "topic" in values.columns:
        flag = (F.col("topic") == note_topic) | flag
    return F.coalesce(flag, F.lit(False))


def route_by_sentinel(values: DataFrame, note_topic: str | None = None) -> tuple[DataFrame, DataFrame]:
    """A5/H2: (decisions, explanation messages) of a stream that carries both."""
    flag = is_note(values, note_topic)
    return values.filter(~flag), values.filter(flag)


# ---------------------------------------------------------------- transforms
def decide_stream(records: DataFrame, model=None, model_name: str = "unknown") -> DataFrame:
    """The batch decision transform on a stream (optionally scoring with a trained model first)."""
    df = records
    if model is not None:
        df = model.transform(df.drop("p1", "p2", "p3", "p4", "p5"))
        model_name = model.name
    if "true_acuity" in df.columns and "triage_acuity" not in df.columns:
        df = df.withColumn("triage_acuity", F.col("true_acuity"))
    return layers.decisions(df, model_name=model_name)


def dedupe_patients(records: DataFrame, watermark: str = "10 minutes") -> DataFrame:
    """First record per patient wins, state bounded by an event-time watermark."""
    return records.withColumn("event_time", F.timestamp_seconds("produced_at")) \
        .withWatermark("event_time", watermark).dropDuplicatesWithinWatermark(["patient_id"])


def attach_enrichment(decisions: DataFrame, enrichment: DataFrame, watermark: str = "10 minutes",
                      within: str = "24 hours") -> DataFrame:
    """Stream-stream left join of enrichment onto decisions; both sides watermarked,
    so an enrichment that arrives first is not lost and state stays bounded.

    ``within`` is how long after its decision an explanation is still attached; it bounds the join state.
    Decisions that carry a watermarked ``event_time`` (from ``dedupe_patients``) keep that watermark.
    """
    if "event_time" in decisions.columns:
        d = decisions.withColumnRenamed("event_time", "d_time")
    else:
        d = decisions.withColumn("d_time", F.timestamp_seconds("produced_at")).withWatermark("d_time", watermark)
    e = enrichment.select(F.col("patient_id").alias("e_patient_id"), "llm_explanation", "explained_at",
                          F.timestamp_seconds("explained_at").alias("e_time")).withWatermark("e_time", watermark)
    cond = (F.col("patient_id") == F.col("e_patient_id")) & (F.col("e_time") >= F.col("d_time")) & \
        (F.col("e_time") <= F.col("d_time") + F.expr(f"INTERVAL {within}"))
    return d.join(e, cond, "leftOuter").drop("e_patient_id")


def run_counters(decisions: DataFrame) -> DataFrame:
    """Running per-run counters (update mode)."""
    return decisions.groupBy(F.coalesce(F.col("run_id"), F.lit("unknown")).alias("run_id")).agg(
        F.count(F.lit(1)).alias("processed"),
        F.count_if(F.col("true_acuity") == F.col("predicted_acuity")).alias("correct"),
        F.count_if(F.col("safety_rail_triggered")).alias("rail_hits"),
        F.count_if(F.col("confidence_state").isin("AMBIGUOUS", "LOW")).alias("conf_hits"),
        F.count_if(F.col("has_feature_conflict")).alias("conflict_hits"),
        F.min("produced_at").alias("first_produced_at"),
        F.max("produced_at").alias("last_produced_at"),
    )


# ---------------------------------------------------------------- sinks
@contextmanager
def kept(df: DataFrame) -> Iterator[DataFrame]:
    """``df`` stored as Parquet while a micro-batch uses it several times.

    A cached frame builds columns of thousands of wide records at a time in an executor's memory; stored rows pass
    through one by one, whatever the batch's size.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/acurail-batch-{uuid.uuid4().hex}"
    try:
        df.write.parquet(path)
        yield spark.read.schema(df.schema).parquet(path)
    finally:
        delete_folder(spark, path)


def without_sound_text(decoded: DataFrame) -> DataFrame:
    """``decoded`` with the texts of the records that are set aside only."""
    return decoded.withColumn("value", F.when(F.col("reason").isNotNull(), F.col("value")))


def _write_batch(df: DataFrame, path: str, batch_id: int, fmt: str = "parquet") -> None:
    """Idempotent per batch: each batch id owns one directory and is overwritten on replay. JSON is compressed."""
    writer = df.write.mode("overwrite").format(fmt)
    if fmt == "json":
        writer = writer.option("compression", "gzip")
    writer.save(os.path.join(path, f"batch_id={batch_id}"))


def publisher(out_dir: str, name: str, kafka: dict[str, str] | None = None):
    """Where keyed JSON goes: a Kafka topic with ``kafka_sink_options``, else a folder a batch.

    Kafka delivery is at least once; consumers keep the newest message of a key.
    """
    def publish(batch: DataFrame, batch_id: int) -> None:
        if kafka:
            batch.select(F.col("key").cast("string"), F.col("value").cast("string")).write.format("kafka") \
                .options(**{k: v for k, v in kafka.items() if k != "checkpointLocation"}).save()
        else:
            _write_batch(batch, os.path.join(out_dir, name), batch_id, "json")
    return publish


def decision_sink(out_dir: str, with_messages: bool = True, kafka: dict[str, str] | None = None):
    """Publish decisions (JSON records) and append per-message latency rows.

    Stage timestamps that the records do not carry are stamped per micro-batch:
    received when the batch starts, done once the decision outputs are written
    (scoring and the three layers run as one fused plan, so they share the
    completion time). Timestamps already present in the input win. The decision
    table is written first; the other outputs are read off it.
    """
    import time

    publish = publisher(out_dir, "decisions", kafka)

    def sink(batch: DataFrame, batch_id: int) -> None:
        received = time.time()
        batch, table = batch.drop("probabilities"), os.path.join(out_dir, "decision_table")  # no output has the map
        _write_batch(batch, table, batch_id)
        batch = batch.sparkSession.read.schema(batch.schema).parquet(os.path.join(table, f"batch_id={batch_id}"))
        rec = layers.decision_record(batch)
        publish(rec.select(F.col("patient_id").alias("key"), F.to_json(F.struct("*")).alias("value")), batch_id)
        if with_messages and "produced_at" in batch.columns:
            # Narrow rows of times and numbers, kept on disk; the wide decisions are not cached.
            rows = metrics.message_rows(stamped(batch, received, time.time())).persist(StorageLevel.DISK_ONLY)
            _write_batch(rows, os.path.join(out_dir, "messages"), batch_id)
            rows.unpersist()
    return sink


def stamped(batch: DataFrame, received: float, done: float) -> DataFrame:
    """``batch`` with the stage times that it does not carry."""
    return batch.withColumns({c: F.lit(v) for c, v in (
        ("consumer_received_at", received), ("ml_done_at", done), ("safety_done_at", done)) if c not in batch.columns})


def feedback_sink(out_dir: str, stats_every: int = 20):
    """One micro-batch writes the flat feedback table, the audit rows and its partial statistics;
    the published statistics are refreshed when the number of saved rows crosses a multiple of ``stats_every``.

    The partial statistics of all batches are one row per feedback type, to which a batch adds (``KeyedTable``, so a
    replayed batch counts once); neither the history of feedback rows nor that of partials is read again.
    """
    from acurail.streaming.keyed import KeyedTable, add_up

    def sink(events: DataFrame, batch_id: int) -> None:
        spark = events.sparkSession
        flat = feedback.feedback_flat(events).persist()
        _write_batch(flat, os.path.join(out_dir, "feedback"), batch_id)
        _write_batch(feedback.override_rows(flat), os.path.join(out_dir, "overrides"), batch_id)
        part = feedback.feedback_partials(flat).persist()
        totals = KeyedTable(spark, f"{out_dir}/feedback_partials", ["feedback_type"], part.schema, buckets=1)
        sums = [c for c in part.columns if c != "feedback_type"]
        totals.merge(batch_id, part, add_up(["feedback_type"], sums))
        saved = totals.current()
        n, new = (d.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] for d in (saved, part))
        if n // stats_every > (n - new) // stats_every:
            _write_batch(feedback.combine_partials(saved), os.path.join(out_dir, "feedback_stats"), 0)
        part.unpersist()
        flat.unpersist()
    return sink


# ---------------------------------------------------------------- jobs
def started(stream: DataFrame, sink, checkpoint: str, name: str, available_now: bool = True,
            processing_time: str | None = None):
    """Start ``foreachBatch(sink)`` with a checkpoint of its own."""
    w = stream.writeStream.foreachBatch(sink).option("checkpointLocation", os.path.join(checkpoint, name))
    return (w.trigger(availableNow=True) if available_now
            else w.trigger(processingTime=processing_time or "1 second")).start()


def start_decision_job(spark: SparkSession, source: str | DataFrame, out_dir: str, checkpoint: str,
                       model=None, available_now: bool = True, processing_time: str | None = None,
                       schema: T.StructType = INPUT_SCHEMA, note_topic: str | None = None,
                       kafka: dict[str, str] | None = None):
    """J1 + J4 + A17 + J9: messages -> decisions -> idempotent sinks; bad records quarantined.

    ``source`` is a folder of JSON lines or any stream with ``value`` (Kafka
    too). Explanation messages are not scored; they are kept under ``notes``.
    A batch is decoded once. Returns the started query in a tuple.
    """
    decide = decision_sink(out_dir, kafka=kafka)

    def sink(raw: DataFrame, batch_id: int) -> None:
        records, notes = route_by_sentinel(raw, note_topic)
        with kept(without_sound_text(decode(records, schema))) as decoded:
            _write_batch(set_aside(decoded), os.path.join(out_dir, "quarantine"), batch_id)
            _write_batch(notes.select("value"), os.path.join(out_dir, "notes"), batch_id)
            decide(decide_stream(sound(decoded), model=model), batch_id)

    return (started(messages_of(spark, source), sink, checkpoint, "decisions", available_now, processing_time),)


def enrichment_messages(gated: DataFrame, parsed: DataFrame) -> DataFrame:
    """Enrichment message per escalated record: the parsed explanation plus the gate's code,
    label and detail, flagged with the ``enrichment`` sentinel. ``gated`` carries the gate columns
    and ``enrichment_requested_at``; ``parsed`` is keyed by ``response_id`` = patient id."""
    p = parsed.withColumnRenamed("response_id", "patient_id")
    j = gated.filter(F.col("should_call_llm")).join(p, "patient_id", "inner")
    return j.select(
        "patient_id", F.lit(True).alias("enrichment"), "enrichment_requested_at",
        F.struct("escalation_reason", "patient_summary", "risk_flags", "confidence_note",
                 F.col("response_text").alias("full_text"), F.col("reason_code").alias("escalation_code"),
                 F.col("reason_label").alias("escalation_label"), F.col("reason_detail").alias("escalation_detail"),
                 "is_ready", F.col("error_code").alias("error")).alias("llm_explanation"))


def start_enrichment_job(spark: SparkSession, source: str | DataFrame, out_dir: str, checkpoint: str, explain,
                         schema: T.StructType = INPUT_SCHEMA, note_topic: str | None = None,
                         kafka: dict[str, str] | None = None, available_now: bool = True):
    """A7 + C16: decide, gate, have the escalated records explained, publish explanation messages.

    ``explain`` turns the escalated records into (response_id, response_text),
    ``response_id`` being the patient's id; it stands for the language model
    service. A record without a response publishes nothing. Bad records are quarantined.
    """
    import time

    from acurail.operators import review

    publish = publisher(out_dir, "enrichment", kafka)

    def sink(raw: DataFrame, batch_id: int) -> None:
        asked = time.time()
        decoded = decode(route_by_sentinel(raw, note_topic)[0], schema).persist()
        _write_batch(set_aside(decoded), os.path.join(out_dir, "quarantine"), batch_id)
        gated = review.escalation_gate(decide_stream(sound(decoded))).persist()
        called = gated.filter("should_call_llm")
        answers = review.parse_responses(explain(called))
        notes = enrichment_messages(called.withColumn("enrichment_requested_at", F.lit(asked)), answers)
        publish(notes.select(F.col("patient_id").alias("key"), F.to_json(F.struct("*")).alias("value")), batch_id)
        gated.unpersist()
        decoded.unpersist()

    return started(messages_of(spark, source), sink, checkpoint, "enrichment", available_now)


def kafka_sink_options(servers: str, topic: str, checkpoint: str | None = None) -> dict[str, str]:
    """Options of a keyed JSON Kafka sink: all replicas acknowledge, three retries."""
    out = {"kafka.bootstrap.servers": servers, "topic": topic, "kafka.acks": "all", "kafka.retries": "3"}
    return {**out, "checkpointLocation": checkpoint} if checkpoint else out


def write_kafka(records: DataFrame, servers: str, topic: str, checkpoint: str):
    """Publish (key, value) records to a Kafka topic; needs the Kafka connector. Returns the unstarted writer."""
    return (records.select(F.col("key").cast("string"), F.col("value").cast("string")).writeStream.format("kafka")
            .options(**kafka_sink_options(servers, topic, checkpoint)).outputMode("append"))


def start_feedback_job(spark: SparkSession, source: str | DataFrame, out_dir: str, checkpoint: str,
                       event_schema: T.StructType, stats_every: int = 20):
    """Feedback events (JSON lines) -> flat feedback table + audit rows in one micro-batch;
    events without a label or patient are quarantined. Returns the started query in a tuple."""
    save = feedback_sink(out_dir, stats_every)

    def sink(raw: DataFrame, batch_id: int) -> None:
        parsed = raw.select(F.col("value"), F.from_json("value", event_schema).alias("e")).persist()
        ok = F.coalesce(F.col("e.patient_id").isNotNull() & F.col("e.final_label").isNotNull(), F.lit(False))
        _write_batch(parsed.filter(~ok).select(F.col("value").alias("raw_value"),
                                               F.lit("bad feedback event").alias("reason")),
                     os.path.join(out_dir, "quarantine"), batch_id)
        save(parsed.filter(ok).select("e.*"), batch_id)
        parsed.unpersist()

    return (started(messages_of(spark, source), sink, checkpoint, "feedback"),)
