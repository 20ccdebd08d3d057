"""Scalar column helpers shared by every operator.

Number formatting: the reference formats with Python's ``format(x, '.Nf')``
and ``round(x, N)``, which round the exact binary value half-to-even. Java's
``String.format`` rounds the shortest decimal string half-up and disagrees
on near-ties, so fixed-point text goes through ``format_number`` with a
``DecimalFormat`` pattern such as ``'0.00'`` (HALF_EVEN on the exact value,
no grouping separators).
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F


def safe_double(c: Column | str) -> Column:
    """Null-safe numeric: unparsable, null and NaN all become NULL."""
    col = F.col(c) if isinstance(c, str) else c
    d = col.try_cast("double")
    return F.when(F.isnan(d), F.lit(None).cast("double")).otherwise(d)


def fmt_fixed(c: Column, decimals: int) -> Column:
    """Python-compatible ``f"{x:.Nf}"`` text (DecimalFormat pattern without grouping)."""
    return F.call_function("format_number", c, F.lit("0." + "0" * decimals if decimals > 0 else "0"))


def py_round(c: Column, decimals: int) -> Column:
    """Python-compatible ``round(x, N)`` for doubles."""
    return fmt_fixed(c, decimals).cast("double")


def flag_if(pred: Column) -> Column:
    """0/1 flag; a comparison against a missing value never fires."""
    return F.coalesce(pred, F.lit(False)).cast("int")


def first_keyword(text: Column, keywords: Iterable[str]) -> Column:
    """First keyword (declared order) contained in ``text``; NULL if none."""
    return F.coalesce(*[F.when(text.contains(k), F.lit(k)) for k in keywords])


def any_keyword(text: Column, keywords: Iterable[str]) -> Column:
    """TRUE when any keyword is contained in ``text``."""
    preds = [text.contains(k) for k in keywords]
    out = preds[0]
    for p in preds[1:]:
        out = out | p
    return F.coalesce(out, F.lit(False))


def acuity_lookup(c: Column, mapping: Mapping[int, str], default: Column | None = None) -> Column:
    """Literal map lookup (constant-folded ``CASE``); no join needed."""
    expr = None
    for k, v in mapping.items():
        expr = (F.when(c == k, F.lit(v)) if expr is None else expr.when(c == k, F.lit(v)))
    return expr.otherwise(default if default is not None else c.cast("string"))


def _indexed(c: Column, mapping: Mapping[int, str], default: Column) -> Column:
    """Lookup for keys 1..5 with a single reference to ``c`` (keeps plans small
    when ``c`` is a deep expression that Catalyst may inline)."""
    arr = F.array(*[F.lit(mapping[k]) for k in sorted(mapping)])
    return F.coalesce(F.try_element_at(arr, c.cast("int")), default)


def label_of(c: Column) -> Column:
    from acurail.constants import ACUITY_LABELS
    return _indexed(c, ACUITY_LABELS, c.cast("string"))


def color_of(c: Column) -> Column:
    from acurail.constants import ACUITY_COLORS
    return _indexed(c, ACUITY_COLORS, F.lit("#888888"))


_UNIT_SEP = "\u001f"


def compact_strings(*items: Column) -> Column:
    """``array(items)`` without the NULL entries, built without a lambda.

    ``filter(array(...), x -> x IS NOT NULL)`` is a higher-order function and
    drags its whole argument subtree out of whole-stage codegen; ``concat_ws``
    (which skips NULLs) plus ``split`` on a unit-separator character stay in
    generated code. Items must be non-empty strings without U+001F.
    """
    joined = F.concat_ws(_UNIT_SEP, *items)
    return F.when(joined == "", F.array().cast("array<string>")).otherwise(F.split(joined, _UNIT_SEP))
