"""Column-expression helpers (all JVM-side, codegen friendly)."""

from acurail.functions.columns import (  # noqa: F401
    safe_double, fmt_fixed, py_round, flag_if, first_keyword, any_keyword,
    label_of, color_of, acuity_lookup, compact_strings,
)
