"""Row features, target cleaning and the training-set joins.

Everything here is either row-local (no shuffle) or a keyed dedupe/join on
``patient_id``. Dedupe-keep-first is a ``groupBy(key).agg(min_by(...))`` so
that map-side partial aggregation collapses hot keys before the shuffle
(a window would sort a hot key's whole group inside one task).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from acurail.constants import (
    CATEGORICAL_COLS, DROP_COLS, HIGH_RISK_HISTORY_FLAG, HISTORY_COLS, NUMERIC_COLS, TARGET,
)
from acurail.functions.columns import flag_if, py_round, safe_double

# (flag name, source column, predicate builder) in the reference's order.
_FLAG_SPECS = [
    ("flag_hypotension", "systolic_bp", lambda x: x < 90),
    ("flag_hypertension", "systolic_bp", lambda x: x > 180),
    ("flag_tachycardia", "heart_rate", lambda x: x > 100),
    ("flag_bradycardia", "heart_rate", lambda x: x < 60),
    ("flag_tachypnea", "respiratory_rate", lambda x: x > 20),
    ("flag_bradypnea", "respiratory_rate", lambda x: x < 12),
    ("flag_fever", "temperature_c", lambda x: x > 38.3),
    ("flag_hypothermia", "temperature_c", lambda x: x < 35.0),
    ("flag_hypoxia", "spo2", lambda x: x < 94),
    ("flag_severe_pain", "pain_score", lambda x: x >= 7),
    ("flag_low_gcs", "gcs_total", lambda x: x < 14),
    ("flag_critical_gcs", "gcs_total", lambda x: x <= 8),
]
FLAG_NAMES = [f for f, _, _ in _FLAG_SPECS]


def require_columns(df: DataFrame, *cols: str) -> DataFrame:
    """A2: fail fast when a required column (e.g. the target) is missing."""
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise ValueError(f"Required column(s) {missing} not found. Available: {df.columns}")
    return df


def fill_missing(df: DataFrame, cols: list[str], dtype: str = "double") -> DataFrame:
    """Add absent feature columns as typed NULLs."""
    absent = [c for c in cols if c not in df.columns]
    return df.withColumns({c: F.lit(None).cast(dtype) for c in absent}) if absent else df


def clinical_flags(df: DataFrame, only_present: bool = True) -> DataFrame:
    """Threshold flags; a missing value never fires.

    ``only_present=True`` is the batch behaviour (a flag exists only when its
    source column exists); ``False`` is the serving behaviour (all flags,
    absent columns read as missing).
    """
    cols = set(df.columns)
    new = {}
    for name, src, pred in _FLAG_SPECS:
        if src in cols:
            new[name] = flag_if(pred(safe_double(F.col(src))))
        elif not only_present:
            new[name] = F.lit(0)
    return df.withColumns(new)


def history_burden(df: DataFrame, only_present: bool = True) -> DataFrame:
    """Null-as-0 sum of history columns and the high-risk flag."""
    cols = set(df.columns)
    hx = [c for c in HISTORY_COLS if c in cols]
    if not hx and only_present:
        return df
    total: Column = F.lit(0)
    for c in hx:
        total = total + F.coalesce(F.col(c).cast("int"), F.lit(0))
    hr = [c for c in HIGH_RISK_HISTORY_FLAG if c in cols]
    out = {"hx_total_burden": total.cast("int")}
    if hr or not only_present:
        hr_sum: Column = F.lit(0)
        for c in hr:
            hr_sum = hr_sum + F.coalesce(F.col(c).cast("int"), F.lit(0))
        out["hx_high_risk_flag"] = (hr_sum > 0).cast("int")
    return df.withColumns(out)


def shock_index(df: DataFrame) -> DataFrame:
    """HR/SBP rounded to 3 places; NULL unless SBP > 0; missing HR reads 0."""
    hr = F.coalesce(safe_double(F.col("heart_rate")), F.lit(0.0))
    sbp = F.coalesce(safe_double(F.col("systolic_bp")), F.lit(0.0))
    computed = F.when(sbp > 0, py_round(hr / sbp, 3))
    existing = safe_double(F.col("shock_index")) if "shock_index" in df.columns else F.lit(None).cast("double")
    return df.withColumn("shock_index", F.coalesce(existing, computed))


def clean_target(df: DataFrame, target: str = TARGET, source: str | None = None) -> DataFrame:
    """Numeric coercion (unparsable -> NULL), keep 1..5, truncate to int."""
    src = source or target
    require_columns(df, src)
    num = F.col(src).cast("string").try_cast("double")
    return df.withColumn(target, num).filter(F.col(target).between(1, 5)) \
             .withColumn(target, F.col(target).cast("int"))


def dedup_first(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """one row per key, the smallest by ``order`` (explicit order replaces file order).

    Implemented as an aggregate (``min`` of a struct) so partial aggregation
    runs map-side; a hot key never lands whole in one task.
    """
    value_cols = [c for c in df.columns if c != key]
    ordered = F.struct(*[F.col(c) for c in order], *[F.col(c).alias(f"__v_{c}") for c in value_cols])
    agg = df.groupBy(key).agg(F.min(ordered).alias("__first"))
    return agg.select(key, *[F.col(f"__first.__v_{c}").alias(c) for c in value_cols])


def feature_lists(columns: list[str]) -> tuple[list[str], list[str]]:
    """Ordered numeric (present numerics + derived + history) and categorical lists."""
    cols = set(columns)
    derived = [c for c in FLAG_NAMES if c in cols]
    hx = [c for c in HISTORY_COLS if c in cols]
    if hx:
        derived += ["hx_total_burden"] + (["hx_high_risk_flag"] if "hx_high_risk_flag" in cols else [])
    numeric = list(dict.fromkeys([c for c in NUMERIC_COLS if c in cols] + derived + hx))
    categorical = list(dict.fromkeys([c for c in CATEGORICAL_COLS if c in cols]))
    return numeric, categorical


def engineer_features(df: DataFrame, keep_text: bool = True) -> DataFrame:
    """B2 + B5 + B7/B8: drop leakage/id columns, add flags and burden.

    ``keep_text`` keeps ``chief_complaint_raw`` for the TF-IDF block (the
    documented intent); it is never fed to the structured block.
    """
    drop = [c for c in DROP_COLS if c in df.columns and not (keep_text and c == "chief_complaint_raw")]
    out = df.drop(*drop)
    out = clinical_flags(out)
    return history_burden(out)


def training_set(main: DataFrame, complaints: DataFrame | None = None,
                 history: DataFrame | None = None) -> DataFrame:
    """D1/D2 + B1 + B3/B4: main LEFT JOIN deduped complaints LEFT JOIN deduped history.

    Optional sources (A3): a missing table skips its join. The dedupes
    hash-partition on ``patient_id``; the joins reuse that partitioning, and
    AQE may turn a small side into a broadcast at runtime.
    """
    require_columns(main, TARGET)
    df = main
    if complaints is not None:
        keep = ["patient_id"] + [c for c in ("chief_complaint_raw", "chief_complaint_system")
                                 if c in complaints.columns]
        order = [c for c in ("ord",) if c in complaints.columns] + keep[1:]
        cc = dedup_first(complaints.select(*keep, *[c for c in ("ord",) if c in complaints.columns]),
                         "patient_id", order)
        cc = cc.drop("ord") if "ord" in cc.columns else cc
        df = df.join(cc, "patient_id", "left")
    if history is not None:
        hx_cols = [c for c in history.columns if c != "patient_id"]
        hx = dedup_first(history, "patient_id", hx_cols)
        df = df.join(hx, "patient_id", "left")
    df = clean_target(df)
    return engineer_features(df)
