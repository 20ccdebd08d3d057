"""Sources: driver tables, the encounter fixture view, file/stream readers."""

from acurail.sources.tables import (  # noqa: F401
    read_table, encounters, complaints, raw_target, clinician_actions,
)
