"""URL filters by a Bloom filter cascade, in DataFrame expressions only.

Listed keys are rule keys (host plus path prefix). The key universe of a
corpus is every key that one of its URLs could fit: each host suffix with as
many labels as some rule has, followed by each path prefix as long as some
rule's path. Level 1 of the cascade encodes the listed keys, level 2 the
unlisted universe keys that level 1 wrongly passes, level 3 the listed keys
that level 2 wrongly passes, and so on until a level passes nothing wrongly.
Looking up a universe key is then exact: the first level that rejects it
decides by its parity. Levels are literals of ``array<bigint>`` words, so a
lookup needs no join. A list too long for one literal is dealt to shards by
key hash, each with a cascade of its own; the pages pass the shards in turn.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from acurail.llm.common import staged, url_host, url_path, without

#: Bytes of filters that one pass over the pages carries; longer lists take as many passes as they need.
PASS_BYTES = 4 << 20
_LOG2E2 = 1 / math.log(2)


@dataclass(frozen=True)
class Level:
    """One Bloom filter: ``bits`` positions of which each key sets ``hashes``."""

    number: int
    bits: int
    hashes: int
    words: tuple[int, ...] = ()


def _positions(key: Column, level: Level) -> Column:
    """array<bigint> of the key's bit positions (two hashes combined, odd step)."""
    first = F.pmod(F.xxhash64(key, F.lit(level.number)), F.lit(level.bits))
    step = F.pmod(F.xxhash64(F.lit(level.number), key), F.lit(level.bits))
    return F.array(*[F.pmod(first + F.lit(i) * step, F.lit(level.bits)).cast("bigint")
                     for i in range(level.hashes)])


def _passes(key: Column, level: Level) -> Column:
    words = F.lit(list(level.words)).cast("array<bigint>")
    hit = F.lit(True)
    for i in range(level.hashes):
        p = _positions(key, level)[i]
        word = F.get(words, F.shiftright(p, 6).cast("int"))
        hit = hit & (F.getbit(word, F.pmod(p, F.lit(64)).cast("int")) == 1)
    return hit


def _encode(keys: DataFrame, level: Level) -> Level:
    """OR the keys' bits together; the result has at most ``bits / 64`` words."""
    p = keys.select(F.explode(_positions(F.col("key"), level)).alias("p"))
    words = (p.groupBy(F.shiftright("p", 6).alias("w"))
             .agg(F.bit_or(F.expr("shiftleft(1L, cast(pmod(p, 64) as int))")).alias("v")).collect())
    filled = [0] * ((level.bits + 63) // 64)
    for r in words:
        filled[r["w"]] = r["v"]
    return Level(level.number, level.bits, level.hashes, tuple(filled))


def _shape(number: int, count: int, rate: float) -> Level:
    bits = max(64, math.ceil(count * -math.log2(rate) * _LOG2E2))
    return Level(number, bits, max(1, min(24, round(-math.log2(rate)))))


def error_rate(listed: int, universe: int) -> float:
    """Rate of level 1 at which each later level encodes a number of keys of the order of the list."""
    return min(0.5, max(1e-7, math.sqrt(0.5) * listed / max(universe, 1)))


def build(listed: DataFrame, universe: DataFrame) -> list[Level]:
    """Cascade over column ``key`` of both inputs.

    The first level's error rate is about listed / universe, so each later
    level encodes a number of keys of the order of the list, however large the
    corpus is. Only the filters' words reach the driver. An empty list gives
    an empty cascade.
    """
    listed = staged(listed.select("key").filter(F.col("key").isNotNull()).distinct(), "listed")
    n = listed.count()
    if not n:
        return []
    rate = error_rate(n, universe.agg(F.approx_count_distinct("key", 0.02)).first()[0])
    levels: list[Level] = []
    inside, outside = listed, universe.select("key")
    while True:
        count = n if not levels else inside.count()
        if not count:
            return levels
        level = _shape(len(levels) + 1, count, rate if not levels else 0.5)
        levels.append(_encode(inside, level))
        wrong = outside.filter(_passes(F.col("key"), levels[-1]))
        if len(levels) == 1:  # the only pass over the universe; what it leaves is of the list's order
            wrong = wrong.distinct().join(listed, "key", "left_anti")
        inside, outside = staged(wrong, "false-positives"), inside


def _shards(listed: int, universe: int, pass_bytes: int) -> int:
    """Shards so that the two cascades of one (listed and blocked keys) take about ``pass_bytes``."""
    bits = listed * (-math.log2(error_rate(listed, universe)) + 2) * _LOG2E2
    return max(1, math.ceil(2 * bits / (8 * pass_bytes)))


def _shard(key: Column, shards: int) -> Column:
    return F.pmod(F.xxhash64(F.lit("shard"), key), F.lit(shards))


def contains(key: Column, levels: list[Level]) -> Column:
    """Whether a universe key is listed: exact, and free of joins."""
    answer = F.lit(len(levels) % 2 == 1)
    for i, level in reversed(list(enumerate(levels))):
        answer = F.when(~_passes(key, level), F.lit(i % 2 == 1)).otherwise(answer)
    return answer


def _host_suffix(host: Column, labels: int) -> Column:
    """The last ``labels`` labels of the host; null if it has fewer."""
    parts = F.split(host, r"\.")
    return F.when(F.size(parts) >= labels, F.array_join(F.slice(parts, -labels, labels), "."))


def candidates(host: Column, path: Column, shapes: list[tuple[int, int]]) -> Column:
    """Keys the URL could fit, longest first (ties: more labels first); nulls left out."""
    keys = []
    for labels, length in shapes:
        keys.append(F.when(F.length(path) >= length,
                           F.concat(_host_suffix(host, labels), F.substring(path, 1, length))))
    return F.array_compact(F.array(*keys))


def judge(pages: DataFrame, rules: DataFrame, pass_bytes: int = PASS_BYTES) -> DataFrame:
    """``pages`` with ``host``, ``path``, the longest fitting ``rule`` and its ``verdict``.

    ``rules`` has columns host, path, verdict (``allow`` or ``block``); a key
    given with both verdicts blocks. A rule fits its host and all subdomains if
    the URL's path starts with the rule's path. URLs that no rule fits are not
    listed, and an unlisted URL is allowed. Null URLs and URLs without ``://``
    have empty host and path and fit no rule; URLs of any length are read
    whole. Repeated pages are judged alike; an empty table gives an empty
    table; input columns named like a result column are replaced.
    """
    keys = (rules.filter(F.col("host") != "")
            .select(F.col("host"), F.coalesce("path", F.lit("")).alias("path"), F.col("verdict"))
            .select(F.concat("host", "path").alias("key"), F.size(F.split("host", r"\.")).alias("labels"),
                    F.length("path").alias("length"), F.col("verdict")))
    shapes = [tuple(r) for r in keys.select("labels", "length").distinct().collect()]  # a few shapes, not rules
    row = F.struct(*[F.col(f"`{c}`") for c in without(pages, "host", "path", "rule", "verdict").columns])
    d = pages.select(row.alias("row"), url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"))
    listed, blocked = keys.select("key"), keys.filter("verdict = 'block'").select("key")
    none = F.lit(None).cast("string")
    if not shapes:
        return d.select("row.*", "host", "path", none.alias("rule"), F.lit("allow").alias("verdict"))
    universe = (d.select("host", "path").distinct()
                .select(F.explode(candidates(F.col("host"), F.col("path"), shapes)).alias("key")))
    shards = _shards(listed.distinct().count(), universe.agg(F.approx_count_distinct("key", 0.02)).first()[0], pass_bytes)
    if shards > 1:
        universe = staged(universe.distinct(), "universe")
    d = d.withColumn("best", F.lit(None).cast("struct<length:int,rule:string,blocked:boolean>"))
    for s in range(shards):
        one, two = (build(part.filter(_shard(F.col("key"), shards) == s), universe.filter(_shard(F.col("key"), shards) == s))
                    for part in (listed, blocked))
        if not one:
            continue
        fits = F.filter(candidates(F.col("host"), F.col("path"), shapes),
                        lambda k: (_shard(k, shards) == s) & contains(k, one))
        # The longest of the shard's fitting keys; of the pages' keys all lie in the universe, so this is exact.
        rule = F.array_max(F.transform(fits, lambda k: F.struct(F.length(k).alias("length"), k.alias("rule"))))
        d = d.withColumn("rule", rule).withColumn("best", F.greatest("best", F.when(
            F.col("rule").isNotNull(), F.struct(F.col("rule.length").alias("length"), F.col("rule.rule").alias("rule"),
                                                contains(F.col("rule.rule"), two).alias("blocked"))))).drop("rule")
        if s + 1 < shards:
            d = staged(d, "judged")
    return d.select("row.*", "host", "path", F.col("best.rule").alias("rule"),
                    F.when(F.col("best.blocked"), "block").otherwise("allow").alias("verdict"))
