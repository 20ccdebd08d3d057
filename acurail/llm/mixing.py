"""Mixing sources to target weights by entropy balancing.

Each source has one token constraint. Among all rates between 0 and
``max_copies`` copies a document that meet it, the entropy-balanced ones are
an exponential tilt of the corpus as it is (one copy each):
``rate = max_copies * sigmoid(tilt * size / scale)``, where the convex dual in
``tilt`` is solved by Newton steps. Rates depend on source and size only, so
Newton runs on the distributed histogram (source, size) and the rates are
rounded to copies cell by cell, each cell making up for what the larger sizes
before it missed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from acurail.functions.ordered import prefix_within
from acurail.llm.common import staged

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MAX_COPIES = 2
#: Documents of one (source, size) cell that one window partition may rank.
CELL_ROWS = 4_096
#: Newton steps after which an unsolved source is an error; a bracket halves at least every other one.
MAX_STEPS = 200


def words_in(text: Column) -> Column:
    """Number of runs without ASCII white space in the whole text; 0 if it is null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE,
            cap: float = MAX_COPIES) -> DataFrame:
    """(source, source_size, target) from (source, size): shares by weight, none above ``cap`` times the source.

    Sources are ranked by code point, null last, and take ``weights`` in turn.
    Capping and resharing until none is above its cap equals one water level:
    ``target = min(cap * source_size, level * weight)``. Sources sorted by
    ``cap * source_size / weight`` are capped up to some point, so the level
    follows from running sums over the sources.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    # Sources are numbered over range partitions: they may be web hosts, whose number grows with the corpus.
    ranked = prefix_within(totals.withColumn("last", F.col("source").isNull()), [], ["last", "source"], seq_col="k")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]),
                          ((F.col("k") - 1) % len(weights) + 1).cast("int"))
    ranked = staged(ranked.select("source", "last", "source_size", weight.alias("w"),
                                  (cap * F.col("source_size")).cast("double").alias("most"))
                    .withColumn("full_at", F.col("most") / F.col("w")), "mix-sources")
    total = ranked.agg(F.sum("source_size").alias("s"), F.sum("w").alias("sw")).first()
    budget, all_weights = share * (total["s"] or 0), total["sw"] or 1.0
    running = prefix_within(ranked, [], ["full_at", "last", "source"], sums=["most", "w"], seq_col="k")
    levels = running.select(
        "source", "most", "w",
        ((F.lit(budget) - (F.col("running_most") - F.col("most")))
         / (F.lit(all_weights) - (F.col("running_w") - F.col("w")))).alias("level"))
    # The first source that its share does not fill sets the level; if all are filled every source gets its cap.
    place = F.struct(F.col("most") / F.col("w"), F.col("source").isNull(), F.col("source"))
    level = levels.filter(F.col("level") * F.col("w") <= F.col("most")).agg(F.min_by("level", place)).first()[0]
    target = F.col("most") if level is None else F.least(F.col("most"), F.lit(float(level)) * F.col("w"))
    return ranked.select("source", "source_size", target.alias("target"))


def tilts(cells: DataFrame, goals: DataFrame, max_copies: int = MAX_COPIES) -> DataFrame:
    """(source, tilt, scale): Newton's solution of each source's dual over the histogram (source, size, n).

    Every step is one aggregation of the histogram by source. Newton steps
    that leave the bracket of the root are replaced by halving it, so the
    iteration cannot diverge. Sources at their cap get the tilt +inf, and those
    with target 0 the tilt -inf.
    """
    moments = cells.groupBy("source").agg(F.sum("n").alias("docs"), F.sum(F.col("n") * F.col("size")).alias("total"))
    state = goals.join(moments, goals["source"].eqNullSafe(moments["source"])).select(
        goals["source"], "target", (F.col("total") / F.greatest("docs", F.lit(1))).alias("scale"),
        (max_copies * F.col("total")).cast("double").alias("most"), F.lit(0.0).alias("tilt"),
        F.lit(-1e6).alias("low"), F.lit(1e6).alias("high"), F.lit(False).alias("done"))
    at_most = F.col("target") >= F.col("most") * (1 - 1e-12)
    state = staged(state.withColumns({
        "scale": F.greatest("scale", F.lit(1e-9)),
        "tilt": F.when(F.col("target") <= 0, F.lit(float("-inf"))).when(at_most, F.lit(float("inf")))
        .otherwise(F.col("tilt")),
        "done": (F.col("target") <= 0) | at_most}), "mix-tilt")
    for _ in range(MAX_STEPS):
        if not state.filter(~F.col("done")).limit(1).count():
            break
        open_ = state.filter(~F.col("done"))
        z = F.col("size") / F.col("scale")
        p = 1 / (1 + F.exp(-F.col("tilt") * z))
        sums = (cells.join(open_.select(F.col("source").alias("s"), "tilt", "scale"),
                           cells["source"].eqNullSafe(F.col("s")))
                .groupBy("source").agg(
                    F.sum(F.col("n") * F.col("size") * max_copies * p).alias("got"),
                    F.sum(F.col("n") * F.col("size") * max_copies * p * (1 - p) * z).alias("slope")))
        sums = sums.select(F.col("source").alias("s"), "got", "slope")
        j = state.join(sums, state["source"].eqNullSafe(sums["s"]), "left")
        miss = F.col("got") - F.col("target")
        low = F.when(miss < 0, F.col("tilt")).otherwise(F.col("low"))
        high = F.when(miss > 0, F.col("tilt")).otherwise(F.col("high"))
        step = F.col("tilt") - miss / F.col("slope")
        inside = (F.col("slope") > 0) & (step > low) & (step < high)
        # Without a usable step: halve the bracket on a scale that reaches its ends quickly.
        middle = F.signum(low + high) * F.sqrt(F.abs(low + high)) * F.when(F.abs(low + high) > 4, 1.0).otherwise(
            F.sqrt(F.abs(low + high)) / 2)
        middle = F.when((middle > low) & (middle < high), middle).otherwise((low + high) / 2)
        close = F.abs(miss) <= 1e-9 * F.greatest("target", F.lit(1.0))
        state = staged(j.select(
            "source", "target", "scale", "most",
            F.when(F.col("done") | close, F.col("tilt")).when(inside, step).otherwise(middle).alias("tilt"),
            F.when(F.col("done"), F.col("low")).otherwise(low).alias("low"),
            F.when(F.col("done"), F.col("high")).otherwise(high).alias("high"),
            (F.col("done") | close | (high - low < 1e-12 * F.greatest(F.abs(low), F.lit(1.0)))).alias("done")), "mix-tilt")
    else:
        raise RuntimeError(f"targets of some sources were not met in {MAX_STEPS} steps")
    return state.select("source", "target", "tilt", "scale")


def rounded(cells: DataFrame, solved: DataFrame, max_copies: int = MAX_COPIES) -> DataFrame:
    """(source, size, n, copies): integer copies for each histogram cell.

    A source's cells are walked from the largest size down; each takes the
    whole number of copies that brings the words taken so far closest to the
    words that the rates give so far. What remains at the end is at most about
    half of the smallest size. One group holds a row for each distinct size of
    a source, however many documents it has.
    """
    def walk(frames: Iterator[pd.DataFrame] | pd.DataFrame) -> pd.DataFrame:
        pdf = frames.sort_values("size", ascending=False, kind="stable")
        size, n = pdf["size"].to_numpy(float), pdf["n"].to_numpy(np.int64)
        with np.errstate(over="ignore", invalid="ignore"):
            z = np.nan_to_num(pdf["tilt"].to_numpy(float) * size / pdf["scale"].to_numpy(float), nan=0.0)
            due = np.cumsum(n * size * max_copies / (1 + np.exp(-z)))
        copies = np.zeros(len(n), dtype=np.int64)
        taken = 0.0
        for i in range(len(n)):
            if size[i] > 0:
                copies[i] = min(max(round((due[i] - taken) / size[i]), 0), max_copies * int(n[i]))
                taken += copies[i] * size[i]
            else:
                copies[i] = n[i]  # documents without a word cost nothing and stay once
        return pd.DataFrame({"source": pdf["source"], "size": pdf["size"], "n": pdf["n"], "copies": copies})

    rows = cells.join(solved.select(F.col("source").alias("s"), "tilt", "scale"),
                      cells["source"].eqNullSafe(F.col("s"))).select("source", "size", "n", "tilt", "scale")
    return rows.groupBy("source").applyInPandas(walk, "source string, size bigint, n bigint, copies bigint")


def copies(docs: DataFrame, max_copies: int = MAX_COPIES) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies) of every row of ``docs``.

    Null and empty texts have size 0; texts of any length are counted whole; a
    null source is a source of its own; documents without a word are taken
    once. An empty table gives an empty table; other columns are not read. Repeated rows are documents of their own.
    Within a cell of equal source and size, the documents of the smallest
    hashed ids take the odd copies, so reruns agree. Cells of many documents
    are split by that hash first, so no task ranks more than about
    ``CELL_ROWS`` rows.
    """
    d = staged(docs.select("doc_id", F.col("source").cast("string").alias("source"),
                           words_in(F.col("text")).alias("size")), "mix-sizes")
    cells = staged(d.groupBy("source", "size").agg(F.count("*").alias("n")), "mix-cells")
    goals = staged(targets(cells.select("source", (F.col("size") * F.col("n")).alias("size")), cap=max_copies),
                   "mix-targets")
    plan = staged(rounded(cells, tilts(cells, goals, max_copies), max_copies), "mix-copies")
    # Crowded cells are split by the hash of the id, and their copies shared out over the parts.
    crowded = plan.filter(F.col("n") > CELL_ROWS).select(
        F.col("source").alias("cs"), F.col("size").alias("cz"), F.ceil(F.col("n") / CELL_ROWS).alias("parts"))
    keyed = d.join(crowded, F.col("source").eqNullSafe(F.col("cs")) & (F.col("size") == F.col("cz")), "left").select(
        "doc_id", "source", "size", F.coalesce(F.pmod(F.xxhash64("doc_id"), F.col("parts")), F.lit(0)).alias("part"))
    parts = keyed.groupBy("source", "size", "part").agg(F.count("*").alias("m"))
    whole = plan.select(F.col("source").alias("ps"), F.col("size").alias("pz"), "n", F.col("copies").alias("all"))
    parts = parts.join(whole, F.col("source").eqNullSafe(F.col("ps")) & (F.col("size") == F.col("pz")))
    upto = F.sum("m").over(Window.partitionBy("source", "size").orderBy("part"))
    due = F.floor(F.col("all") * F.col("upto") / F.col("n"))
    due_before = F.floor(F.col("all") * (F.col("upto") - F.col("m")) / F.col("n"))
    parts = parts.withColumn("upto", upto).select(
        F.col("source").alias("qs"), F.col("size").alias("qz"), F.col("part").alias("qp"), "m",
        (due - due_before).alias("share"))
    rank = F.row_number().over(Window.partitionBy("source", "size", "part").orderBy(F.xxhash64("doc_id"), "doc_id"))
    placed = keyed.withColumn("rank", rank).join(
        parts, F.col("source").eqNullSafe(F.col("qs")) & (F.col("size") == F.col("qz"))
        & (F.col("part") == F.col("qp")))
    each = F.floor(F.col("share") / F.col("m"))
    extra = (F.col("rank") <= F.col("share") - each * F.col("m")).cast("bigint")
    counted = placed.select("doc_id", "source", "size", (each + extra).cast("bigint").alias("copies"))
    goals = goals.select(F.col("source").alias("gs"), "source_size", "target")
    return counted.join(goals, F.col("source").eqNullSafe(F.col("gs"))).drop("gs")


def mix(docs: DataFrame, max_copies: int = MAX_COPIES) -> DataFrame:
    """``docs`` repeated: each row as often as its copies say; the columns stay.

    Copies are decided per row; rows that repeat one ``doc_id`` share its total
    as evenly as whole copies allow. Null ids are one id here; null, empty and
    very long texts are repeated like any other; an empty table stays empty; no
    column can clash, as none is added.
    """
    decided = copies(docs, max_copies).groupBy("doc_id").agg(
        F.sum("copies").alias("__copies"), F.count("*").alias("__rows"))
    columns = [F.col(f"`{c}`") for c in docs.columns]
    decided = decided.select(F.col("doc_id").alias("__id"), "__copies", "__rows")
    rows = docs.join(decided, docs["doc_id"].eqNullSafe(F.col("__id")))
    single = rows.filter("__rows = 1").select(*columns, "__copies")
    w = Window.partitionBy("__id").orderBy(F.xxhash64(F.col("text")))
    repeated = rows.filter("__rows > 1").withColumn("__k", F.row_number().over(w)).select(*columns, (
        F.floor(F.col("__copies") / F.col("__rows"))
        + (F.col("__k") <= F.col("__copies") % F.col("__rows")).cast("bigint")).alias("__copies"))
    both = single.unionByName(repeated).filter("__copies > 0")
    return both.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies").cast("int")))).select(*columns)
