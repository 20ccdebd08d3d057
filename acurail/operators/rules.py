"""Declarative rule tables for the three decision layers.

Each rule is ``(code, predicate, reason_text)`` over a ``Vitals`` bundle of
normalised columns. Layers compile a table into ``when`` / ``coalesce`` /
``concat_ws`` expressions, so the rules stay inside whole-stage codegen and
no rule adds a shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from acurail.constants import (
    BENIGN_KEYWORDS, CRITICAL_KEYWORDS, HIGH_RISK_HISTORY_CONFLICT, HIGH_RISK_KEYWORDS,
)
from acurail.functions.columns import any_keyword, first_keyword, fmt_fixed, safe_double

@dataclass(frozen=True)
class Vitals:
    """Normalised inputs shared by all rule tables (NULL = missing)."""
    hr: Column
    sbp: Column
    dbp: Column
    spo2: Column
    rr: Column
    temp: Column
    gcs: Column
    pain: Column
    news2: Column
    age: Column
    complaint: Column      # lower-cased complaint text, '' when missing
    mental: Column         # lower-cased mental status
    hx: dict               # history column -> int column (0 when missing)


def vitals_of(df: DataFrame) -> Vitals:
    cols = set(df.columns)

    def num(name: str) -> Column:
        return safe_double(F.col(name)) if name in cols else F.lit(None).cast("double")

    complaint = (F.lower(F.coalesce(F.col("chief_complaint_raw").cast("string"), F.lit("")))
                 if "chief_complaint_raw" in cols else F.lit(""))
    # A present-but-null mental status reads as the text 'none' (i.e. altered),
    # as in the reference; an absent column reads as ''.
    mental = (F.lower(F.coalesce(F.col("mental_status_triage").cast("string"), F.lit("none")))
              if "mental_status_triage" in cols else F.lit(""))
    hx = {c: (F.coalesce(F.col(c).cast("int"), F.lit(0)) if c in cols else F.lit(0))
          for c in HIGH_RISK_HISTORY_CONFLICT}
    return Vitals(
        hr=num("heart_rate"), sbp=num("systolic_bp"), dbp=num("diastolic_bp"), spo2=num("spo2"),
        rr=num("respiratory_rate"), temp=num("temperature_c"), gcs=num("gcs_total"),
        pain=num("pain_score"), news2=num("news2_score"), age=num("age"),
        complaint=complaint, mental=mental, hx=hx,
    )


def _t(*parts) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def f0(c: Column) -> Column:
    return fmt_fixed(c, 0)


def f1(c: Column) -> Column:
    return fmt_fixed(c, 1)


def f2(c: Column) -> Column:
    return fmt_fixed(c, 2)


def rail_rules_a(v: Vitals) -> list[tuple[str, Column, Column]]:
    """Unconditional floors to acuity 1, in evaluation order."""
    kw = first_keyword(v.complaint, CRITICAL_KEYWORDS)
    return [
        ("A_GCS", v.gcs <= 8, _t("GCS ", f0(v.gcs), " ≤ 8 → KTAS-1 floor")),
        ("A_SPO2", v.spo2 < 88, _t("SpO2 ", f1(v.spo2), "% < 88% → KTAS-1 floor")),
        ("A_SBP", v.sbp < 70, _t("SBP ", f0(v.sbp), " mmHg < 70 → KTAS-1 floor")),
        ("A_HR_HIGH", v.hr > 180, _t("HR ", f0(v.hr), " bpm > 180 → KTAS-1 floor")),
        ("A_HR_LOW", v.hr < 30, _t("HR ", f0(v.hr), " bpm < 30 → KTAS-1 floor")),
        ("A_RR", v.rr > 36, _t("RR ", f0(v.rr), "/min > 36 → KTAS-1 floor")),
        ("A_TEMP", v.temp < 32.0, _t("Temp ", f1(v.temp), "°C < 32 → KTAS-1 floor (severe hypothermia)")),
        ("A_KEYWORD", kw.isNotNull(), _t("Complaint keyword '", kw, "' → KTAS-1 floor")),
    ]


def rail_rules_b(v: Vitals) -> list[tuple[str, Column, Column]]:
    """Floors to acuity 2 (B1-B8 then C1-C3); only the first that fires is emitted."""
    kw = first_keyword(v.complaint, HIGH_RISK_KEYWORDS)
    shock = F.when(v.sbp > 0, v.hr / v.sbp)
    return [
        ("B_SPO2", (v.spo2 >= 88) & (v.spo2 < 92), _t("SpO2 ", f1(v.spo2), "% (88–92%) → KTAS-2 floor")),
        ("B_SBP", (v.sbp >= 70) & (v.sbp < 90), _t("SBP ", f0(v.sbp), " mmHg (70–90) → KTAS-2 floor")),
        ("B_HR_HIGH", (v.hr > 150) & (v.hr <= 180), _t("HR ", f0(v.hr), " bpm (150–180) → KTAS-2 floor")),
        ("B_HR_LOW", (v.hr >= 30) & (v.hr < 40),
         _t("HR ", f0(v.hr), " bpm (30–40, severe bradycardia) → KTAS-2 floor")),
        ("B_GCS", (v.gcs >= 9) & (v.gcs <= 12), _t("GCS ", f0(v.gcs), " (9–12) → KTAS-2 floor")),
        ("B_TEMP", v.temp > 40.0, _t("Temp ", f1(v.temp), "°C > 40 → KTAS-2 floor (hyperpyrexia)")),
        ("B_NEWS2", v.news2 >= 7, _t("NEWS2 ", f0(v.news2), " ≥ 7 → KTAS-2 floor (high risk)")),
        ("B_KEYWORD", kw.isNotNull(), _t("Complaint keyword '", kw, "' → KTAS-2 floor")),
        ("C_SEPSIS", (v.temp > 38.3) & (v.hr > 100) & (v.rr > 20),
         _t("Sepsis triad (temp ", f1(v.temp), "°C, HR ", f0(v.hr), ", RR ", f0(v.rr), ") → KTAS-2 floor")),
        ("C_SHOCK", shock > 1.5, _t("Shock index ", f2(shock), " > 1.5 (HR/SBP) → KTAS-2 floor")),
        ("C_ELDERLY", (v.age >= 75) & ~v.mental.isin("", "alert") & (v.temp > 38.0),
         _t("Elderly (", f0(v.age), "y) + altered mental status + fever → KTAS-2 floor")),
    ]


def rail_rule_combo(v: Vitals) -> tuple[str, Column, Column]:
    """Hypoxia plus hypotension: floor to acuity 1 while acuity > 1."""
    return ("C_HYPOXIA_HYPOTENSION", (v.spo2 < 94) & (v.sbp < 90),
            _t("Combined hypoxia (SpO2 ", f1(v.spo2), "%) + hypotension (SBP ", f0(v.sbp),
               ") → KTAS-1 floor"))


def conflict_rules(v: Vitals, pred: Column) -> list[tuple[str, Column, int, Column]]:
    """Conflict rules ``(code, predicate, floor, reason)`` against the original class."""
    p = pred.cast("string")
    benign = any_keyword(v.complaint, BENIGN_KEYWORDS)
    benign_kw = F.coalesce(first_keyword(v.complaint, BENIGN_KEYWORDS), F.lit(""))
    critical = ((v.spo2 < 92) | (v.gcs < 14) | (v.sbp < 90) | (v.hr > 150) | (v.hr < 40))
    names = F.concat_ws(", ", *[F.when(v.hx[c] != 0, F.lit(c.replace("hx_", "").replace("_", " ")))
                                for c in HIGH_RISK_HISTORY_CONFLICT])
    any_hx = F.greatest(*[F.abs(v.hx[c]) for c in HIGH_RISK_HISTORY_CONFLICT]) > 0
    return [
        ("V_SPO2", (v.spo2 < 92) & (pred >= 3), 2,
         _t("[V] SpO2=", f1(v.spo2), "% indicates ≤KTAS-2 but model → KTAS-", p)),
        ("V_GCS", (v.gcs < 13) & (pred >= 3), 2,
         _t("[V] GCS=", f0(v.gcs), " indicates ≤KTAS-2 but model → KTAS-", p)),
        ("V_SBP", (v.sbp < 90) & (pred >= 3), 2,
         _t("[V] SBP=", f0(v.sbp), "mmHg indicates ≤KTAS-2 but model → KTAS-", p)),
        ("V_HR", ((v.hr > 140) | (v.hr < 45)) & (pred >= 4), 3,
         _t("[V] HR=", f0(v.hr), "bpm is extreme but model → KTAS-", p)),
        ("V_RR", ((v.rr > 28) | (v.rr < 10)) & (pred >= 4), 3,
         _t("[V] RR=", f0(v.rr), "/min is extreme but model → KTAS-", p)),
        ("V_TEMP", ((v.temp > 39.5) | (v.temp < 35.5)) & (pred >= 4), 3,
         _t("[V] Temp=", f1(v.temp), "°C is abnormal but model → KTAS-", p)),
        ("V_PAIN", (v.pain >= 8) & (pred >= 4), 3,
         _t("[V] Pain=", f0(v.pain), "/10 (severe) but model → KTAS-", p)),
        ("N_NEWS2_5", (v.news2 >= 5) & (pred >= 4), 3,
         _t("[N] NEWS2=", f0(v.news2), " (medium-high risk) but model → KTAS-", p)),
        ("N_NEWS2_7", (v.news2 >= 7) & (pred >= 3), 2,
         _t("[N] NEWS2=", f0(v.news2), " (high risk) but model → KTAS-", p)),
        ("C_BENIGN_CRITICAL", benign & F.coalesce(critical, F.lit(False)), 2,
         _t("[C] Complaint '", benign_kw, "' appears benign but vitals indicate critical state — possible masking")),
        ("H_HISTORY", any_hx & benign & (pred >= 4), 3,
         _t("[H] High-risk comorbidities (", names,
            ") + benign complaint — raised baseline risk, model → KTAS-", p)),
    ]
