"""Latency, throughput and run metrics.

The message table is one row per processed record with four stage
timestamps. Segments are row-local arithmetic; run aggregates are a
``groupBy(run_id)`` with map-side partial aggregation. Order-dependent
outputs (sequence numbers, running accuracy, exact percentiles) use the
range-partitioned prefix operators in ``acurail.functions.ordered`` so that a
single huge run never lands in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from acurail.constants import ACUITY_COLORS
from acurail.functions.columns import acuity_lookup
from acurail.functions.ordered import exact_percentiles, prefix_within

SEGMENTS = {
    "kafka_transit_ms": ("consumer_received_at", "produced_at"),
    "ml_inference_ms": ("ml_done_at", "consumer_received_at"),
    "safety_pipeline_ms": ("safety_done_at", "ml_done_at"),
    "e2e_ms": ("safety_done_at", "produced_at"),
}
SUMMARY_SEGMENTS = {"e2e": "e2e_ms", "kafka": "kafka_transit_ms", "ml": "ml_inference_ms",
                    "safety": "safety_pipeline_ms", "llm": "llm_ms"}


def message_rows(df: DataFrame) -> DataFrame:
    """One message row with derived segment durations in ms."""
    run = F.coalesce(F.col("run_id"), F.lit("unknown")) if "run_id" in df.columns else F.lit("unknown")
    return df.select(
        run.alias("run_id"), "patient_id", "produced_at", "consumer_received_at", "ml_done_at", "safety_done_at",
        *[((F.col(a) - F.col(b)) * 1000).alias(name) for name, (a, b) in SEGMENTS.items()],
        F.col("safety_rail_triggered").cast("int").alias("safety_rail_triggered"),
        F.col("true_acuity").cast("int").alias("true_acuity"),
        F.col("predicted_acuity").cast("int").alias("predicted_acuity"),
    )


def close_llm_segment(messages: DataFrame, explanations: DataFrame) -> DataFrame:
    """Attach the earliest explanation per patient and the LLM segment.

    llm_ms = (explained_at - enrichment_requested_at) * 1000, falling back to
    safety_done_at when the request time is unknown. The explanation side is
    aggregated per patient first (partial aggregation), then left-joined. Of
    explanations of one time the one without, else with the earliest, request
    time counts; explanations without a time do not count.
    """
    joined = messages.join(first_explanations(explanations), "patient_id", "left")
    return joined.withColumn("llm_ms", llm_ms()).drop("enrichment_requested_at")


def first_explanations(explanations: DataFrame) -> DataFrame:
    """(patient_id, explained_at, enrichment_requested_at) of each patient's earliest explanation."""
    return explanations.filter(F.col("explained_at").isNotNull()).groupBy("patient_id").agg(
        F.min(F.struct("explained_at", "enrichment_requested_at")).alias("_e")).select("patient_id", "_e.*")


def llm_ms():
    """The explanation segment of a message that carries its explanation's times."""
    return F.when(F.col("explained_at").isNotNull(), (F.col("explained_at") - F.coalesce(
        F.col("enrichment_requested_at"), F.col("safety_done_at"))) * 1000)


def _truthy(c: str):
    return F.when(F.col(c) != 0, F.col(c))


def run_summary(messages: DataFrame, exact: bool = True, accuracy: int = 100000) -> DataFrame:
    """One row per run, always current (no finalise step).

    ``exact=True`` computes linear-interpolated P50/P95 exactly with the
    distributed order-statistics operator; ``exact=False`` uses
    ``percentile_approx`` (bounded sketch, relative rank error 1/accuracy).
    """
    base = messages.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("message_count"),
        F.min(_truthy("produced_at")).alias("_t0"),
        F.max(_truthy("safety_done_at")).alias("_t1"),
        F.avg(F.col("safety_rail_triggered").cast("double")).alias("rail_hit_rate"),
    )
    dur = F.col("_t1") - F.col("_t0")
    base = base.withColumns({
        "started_at": F.timestamp_seconds(F.col("_t0")),
        "duration_secs": dur,
        "throughput_msg_sec": F.when(dur != 0, F.col("message_count") / dur),
    }).drop("_t0", "_t1")
    cols = [c for c in SUMMARY_SEGMENTS.values() if c in messages.columns]
    if exact:
        entries = F.array(*[F.struct(F.lit(k).alias("segment"), F.col(v).cast("double").alias("value"))
                            for k, v in SUMMARY_SEGMENTS.items() if v in cols])
        long = messages.select("run_id", F.inline(entries))
        pct = exact_percentiles(long, ["run_id", "segment"], "value", [0.5, 0.95])
        wide = pct.groupBy("run_id").pivot("segment", [k for k, v in SUMMARY_SEGMENTS.items() if v in cols]) \
                  .agg(F.first("q50").alias("p50"), F.first("q95").alias("p95"))
        wide = wide.select("run_id", *[F.col(f"{k}_{p}").alias(f"{p}_{k}_ms")
                                      for k, v in SUMMARY_SEGMENTS.items() if v in cols for p in ("p50", "p95")])
    else:
        wide = messages.groupBy("run_id").agg(*[
            F.percentile_approx(F.col(v), F.array(F.lit(0.5), F.lit(0.95)), accuracy).alias(f"_{k}")
            for k, v in SUMMARY_SEGMENTS.items() if v in cols])
        wide = wide.select("run_id", *[F.col(f"_{k}")[i].alias(f"{p}_{k}_ms")
                                      for k, v in SUMMARY_SEGMENTS.items() if v in cols
                                      for i, p in enumerate(("p50", "p95"))])
    return base.join(wide, "run_id", "left")


def run_comparison(summary: DataFrame) -> DataFrame:
    """Run comparison table; rail hit rate as a percent, start time as minute text."""
    return summary.select(
        "run_id",
        F.date_format("started_at", "yyyy-MM-dd HH:mm").alias("started"),
        F.col("message_count").alias("messages"),
        F.col("duration_secs").alias("duration_s"),
        F.col("throughput_msg_sec").alias("throughput"),
        "p50_e2e_ms", "p95_e2e_ms", "p50_kafka_ms", "p50_ml_ms", "p50_safety_ms",
        (F.col("rail_hit_rate") * 100).alias("rail_hit_pct"),
    )


def latest_run(summary: DataFrame) -> DataFrame:
    """G1: the run with the newest start (one row, via ``max_by`` — no global sort)."""
    return summary.agg(F.max_by("run_id", F.struct("started_at", "run_id")).alias("run_id"))


def message_sequence(messages: DataFrame) -> DataFrame:
    """Per-run message order by ``produced_at`` (patient id breaks ties)."""
    return prefix_within(messages, ["run_id"], ["produced_at", "patient_id"])


def running_accuracy(messages: DataFrame) -> DataFrame:
    """correct / processed after each message of a run."""
    hit = (F.col("true_acuity") == F.col("predicted_acuity")).cast("int")
    df = messages.withColumn("hit", F.coalesce(hit, F.lit(0)))
    seq = prefix_within(df, ["run_id"], ["produced_at", "patient_id"], sums=["hit"])
    return seq.withColumn("running_accuracy", F.col("running_hit") / F.col("seq"))


def latency_points(messages: DataFrame) -> DataFrame:
    """F8: scatter data: sequence, class tag, rail tag, colour."""
    seq = message_sequence(messages)
    pa = F.col("predicted_acuity")
    truthy = pa.isNotNull() & (pa != 0)
    return seq.select(
        "run_id", "seq", "patient_id", "e2e_ms",
        F.when(F.col("safety_rail_triggered") != 0, "Rail fired").otherwise("No rail").alias("rail"),
        F.when(truthy, F.concat(F.lit("KTAS-"), pa.cast("string"))).otherwise("Unknown").alias("ktas"),
        F.when(truthy, acuity_lookup(pa, ACUITY_COLORS, F.lit("#888"))).otherwise("#888").alias("color"),
    )


def recent_records(records: DataFrame, n: int = 100, order_col: str = "produced_at") -> DataFrame:
    """first record per patient, then the newest ``n`` by arrival (TakeOrdered, bounded).

    Of records of one time the smallest counts (column by column); records without a time take no part.
    """
    cols = [order_col, *[c for c in records.columns if c not in ("patient_id", order_col)]]
    first = records.filter(F.col(order_col).isNotNull()).groupBy("patient_id").agg(
        F.min(F.struct(*cols)).alias("_r")).select("patient_id", "_r.*")
    return first.orderBy(F.col(order_col).desc(), F.col("patient_id")).limit(n).select(*records.columns)


def pipeline_counters(decided: DataFrame) -> DataFrame:
    """Processed, correct, rail / confidence / conflict hits and percents."""
    agg = decided.agg(
        F.count(F.lit(1)).alias("processed"),
        F.count_if(F.col("true_acuity") == F.col("predicted_acuity")).alias("correct"),
        F.count_if(F.col("safety_rail_triggered")).alias("rail_hits"),
        F.count_if(F.col("confidence_state").isin("AMBIGUOUS", "LOW")).alias("conf_hits"),
        F.count_if(F.col("has_feature_conflict")).alias("conflict_hits"),
    )
    p = F.col("processed")
    return agg.withColumns({f"{k}_pct": F.when(p > 0, F.col(k) * 100.0 / p)
                            for k in ("correct", "rail_hits", "conf_hits", "conflict_hits")})


def layer_impact(decided: DataFrame) -> DataFrame:
    """Raw vs final accuracy, delta, escalations and review count."""
    t, o, f = F.col("true_acuity"), F.col("original_acuity"), F.col("predicted_acuity")
    agg = decided.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(t == o).alias("correct_raw"),
        F.count_if(t == f).alias("correct_final"),
        F.count_if(F.col("safety_rail_triggered")).alias("rail_hits"),
        F.count_if(F.col("confidence_state").isin("AMBIGUOUS", "LOW")).alias("conf_hits"),
        F.count_if(F.col("has_feature_conflict")).alias("conflict_hits"),
        F.count_if(o != f).alias("escalations"),
        F.count_if(F.col("requires_review")).alias("requires_review"),
    )
    n = F.col("total")
    return agg.withColumns({
        "raw_accuracy_pct": F.col("correct_raw") * 100.0 / n,
        "final_accuracy_pct": F.col("correct_final") * 100.0 / n,
        "accuracy_delta_pct": (F.col("correct_final") - F.col("correct_raw")) * 100.0 / n,
    })


def layer_breakdowns(decided: DataFrame, top_transitions: int = 10, top_reasons: int = 8) -> DataFrame:
    """Confidence states, acuity transitions (top 10), rail reasons by
    first three words (top 8) and conflict types by their 3-character tag."""
    states = decided.groupBy(F.col("confidence_state").alias("key")).agg(F.count(F.lit(1)).alias("n")) \
        .withColumn("breakdown", F.lit("confidence_state"))
    o, f = F.col("original_acuity"), F.col("predicted_acuity")
    trans = decided.filter(o != f).groupBy(
        F.concat(F.lit("KTAS-"), o.cast("string"), F.lit("→KTAS-"), f.cast("string")).alias("key")) \
        .agg(F.count(F.lit(1)).alias("n")).withColumn("breakdown", F.lit("acuity_transition"))
    reasons = decided.filter(F.col("safety_rail_triggered")).select(
        F.explode("safety_rail_reasons").alias("r")).groupBy(
        F.array_join(F.slice(F.split(F.trim(F.col("r")), r"\s+"), 1, 3), " ").alias("key")) \
        .agg(F.count(F.lit(1)).alias("n")).withColumn("breakdown", F.lit("rail_reason"))
    conflicts = decided.filter(F.col("has_feature_conflict")).select(
        F.explode("conflict_reasons").alias("r")).groupBy(F.substring("r", 1, 3).alias("key")) \
        .agg(F.count(F.lit(1)).alias("n")).withColumn("breakdown", F.lit("conflict_type"))

    def top(df: DataFrame, k: int) -> DataFrame:
        return df.orderBy(F.col("n").desc(), F.col("key")).limit(k)

    return states.unionByName(top(trans, top_transitions)).unionByName(top(reasons, top_reasons)) \
                 .unionByName(conflicts).select("breakdown", "key", "n")
