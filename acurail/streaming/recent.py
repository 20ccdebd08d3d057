"""The newest records, first one per patient, as a keyed store with a state bounded by count.

Patients are dealt to shards. A shard's state holds its newest ``n`` patients
and no more, whatever passes through: a record of a patient that is held is a
repeat, a record older than all that a full shard holds is late, any other is
kept and the oldest one makes room. A patient that was pushed out may come
back. The newest ``n`` of all are among the shards' newest ``n`` each.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
EVENT = "outcome string, patient_id string, produced_at double, pushed_out string, pushed_at double, value string"


class _Newest(StatefulProcessor):
    def __init__(self, n: int):
        self.n = n

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getMapState("held", "patient_id string", "produced_at double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = {k[0]: v[0] for k, v in self.held.iterator()}  # at most n
        oldest = [(t, p) for p, t in held.items()]  # only the oldest ever leaves, so the heap is exact
        heapq.heapify(oldest)
        changed: set[str] = set()
        for batch in rows:
            out = []
            ordered = batch.sort_values(["produced_at", "patient_id", "value"], kind="stable")
            for patient, at, value in zip(ordered["patient_id"], ordered["produced_at"], ordered["value"]):
                pushed = pushed_at = None
                if patient in held:
                    outcome = "repeat"
                elif len(held) >= self.n and (at, patient) < oldest[0]:
                    outcome = "late"
                else:
                    outcome = "kept"
                    if len(held) >= self.n:
                        pushed_at, pushed = heapq.heappop(oldest)
                        del held[pushed]
                        changed.add(pushed)
                    held[patient] = at
                    heapq.heappush(oldest, (at, patient))
                    changed.add(patient)
                out.append((outcome, patient, at, pushed, pushed_at, value))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in EVENT.split(", ")])
        for patient in changed:
            if patient in held:
                self.held.updateValue((patient,), (held[patient],))
            elif self.held.containsKey((patient,)):
                self.held.removeKey((patient,))

    def close(self) -> None:
        pass


def newest(records: DataFrame, n: int = 100, shards: int = 8) -> DataFrame:
    """One row per input row (``EVENT``): whether it was kept, repeats a held patient or is late, and whom it pushed out.

    ``records`` is a stream with ``patient_id``, ``produced_at`` and ``value``,
    none of them null. Needs the RocksDB state store, which this sets for the session.
    """
    records.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    keyed = records.select(F.pmod(F.xxhash64("patient_id"), F.lit(shards)).alias("shard"),
                           "patient_id", "produced_at", "value")
    return keyed.groupBy("shard").transformWithStateInPandas(_Newest(n), EVENT, "append", "none")
