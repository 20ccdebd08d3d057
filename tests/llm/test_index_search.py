"""URL filter cascade, WARC archives, exact top-k search."""

import gzip
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from acurail.llm import maxscore, url_filter, warc
from acurail.llm.queries import URL_RULES

PAGES = "page_id bigint, url string, html string, host string, rule string, key string, size int"


def pages(spark, rows):
    return spark.createDataFrame([(*r, "h", "r", "k", 1) for r in rows], PAGES)


def judged_by_hand(url, rules):
    if url is None or "://" not in url:
        return "", "", None, "allow"
    rest = url.split("://", 1)[1]
    end = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:end])
    path = rest[end:].split("?")[0].split("#")[0]
    fits = [(len(h + p), h + p, v) for h, p, v in rules
            if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=(0, None, "allow"))
    return host, path, best[1], best[2]


@pytest.mark.parametrize("limit", [url_filter.PASS_BYTES, 60])  # 60 bytes: several shards, a pass each
def test_url_filter_against_brute_force(spark, limit):
    rng = random.Random(2)
    hosts = ["example.com", "WWW.Example.com", "a.b.example.com", "notexample.com", "x.net", "net", "com", "", ".com",
             "e.org", "ÉX.com", "com:80", "u@x.net"]
    paths = ["", "/", "/en/", "/en", "/en/a/b", "/es/1", "/fr/", "/EN/", "//en/"]
    tails = ["", "?q=/en/", "#f", "?a://b"]
    urls = [f"{s}://{h}{p}{t}" for s in ("http", "") for h in hosts for p in paths for t in tails]
    urls += [None, "", "no url", "a\nb://x.net/es/\n1", "http:/x.net/es/"]
    rows = [(i, u, "") for i, u in enumerate(urls)] + [(0, urls[0], ""), (None, "http://x.net/es/", "")]
    rules = URL_RULES + [(f"h{rng.randrange(500)}.org", f"/{rng.randrange(9)}", "block") for _ in range(60)]
    frame = spark.createDataFrame(rules + [("net", "/es/", "allow")], "host string, path string, verdict string")
    assert (url_filter._shards(len(rules), 500, limit) > 2) == (limit == 60)
    out = url_filter.judge(pages(spark, rows), frame, limit).collect()
    assert len(out) == len(rows)
    for r in out:
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == judged_by_hand(r["url"], rules), r["url"]
    assert url_filter.judge(pages(spark, []), frame).count() == 0
    empty = url_filter.judge(pages(spark, rows[:3]), frame.limit(0)).collect()
    assert {(r["rule"], r["verdict"]) for r in empty} == {(None, "allow")}


def test_cascade_is_exact_on_its_universe(spark):
    universe = spark.range(20_000).select(F.concat(F.lit("k"), "id").alias("key"))
    listed = universe.filter(F.xxhash64("key") % 37 == 0)
    levels = url_filter.build(listed, universe)
    assert len(levels) >= 2
    wrong = universe.withColumn("in", url_filter.contains(F.col("key"), levels)).join(
        listed.withColumn("listed", F.lit(True)), "key", "left").filter(
        F.col("in") != F.coalesce("listed", F.lit(False)))
    assert wrong.count() == 0
    assert url_filter.build(listed.limit(0), universe) == []


def test_warc_round_trip(spark):
    rows = [(5, "http://b.org/x?q=1", "same"), (2, "http://a.org/", "same"), (9, None, None), (8, "plain", ""),
            (3, "http://a.org/\r\nX: y", "é\r\n\r\nWARC/1.1"), (4, "http://big.org/", "x" * 3_000_000),
            (7, "http://a.org/", "other"), (7, "http://a.org/", "other"), (None, "http://n.org/", "same"),
            (None, "http://n.org/", "alone")]
    directory = warc.write_archive(pages(spark, rows))
    out = warc.read_archive(directory).collect()
    assert len(out) == len(rows)
    for r in out:
        payload = {x[2] or "" for x in rows if x[0] == r["page_id"] and len((x[2] or "").encode()) == r["payload_bytes"]}
        assert any(warc.payload_digest(p.encode()) == r["payload_digest"] for p in payload)
    kinds = {(r["page_id"], r["payload_bytes"]): (r["record_type"], r["refers_to"]) for r in out}
    assert kinds[2, 4] == ("response", None) and kinds[5, 4] == ("revisit", 2) and kinds[None, 4] == ("revisit", 2)
    assert kinds[8, 0] == ("response", None) and kinds[9, 0] == ("revisit", 8)
    assert kinds[7, 5] == ("response", None) and kinds[None, 5] == ("response", None)
    assert {r["html"] for r in out if r["page_id"] == 3} == {"é\r\n\r\nWARC/1.1"}
    urls = spark.createDataFrame([("http://a.org/",), ("http://missing.org/",), (None,), ("http://a.org/\r\nX: y",)],
                                 "url string")
    found = warc.lookup(directory, urls).collect()
    assert sorted((r["wanted"], r["page_id"]) for r in found) == [
        ("http://a.org/", 2), ("http://a.org/", 7), ("http://a.org/", 7), ("http://a.org/\r\nX: y", 3)]
    assert warc.read_archive(warc.write_archive(pages(spark, []))).count() == 0


def test_lookup_finds_every_capture_of_its_urls(spark, monkeypatch):
    """A URL that fills several blocks, and one common payload on a third of all pages."""
    monkeypatch.setattr(warc, "BLOCK_CAPTURES", 7)
    rows = [(i, f"http://h{i % 5}.org/{'hot' if i % 3 == 0 else i}", "common" if i % 3 else f"own {i}") for i in range(200)]
    rows += [(300, None, "x"), (320, "http://h0.org/\nb", "common")]
    directory = warc.write_archive(pages(spark, rows))
    asked = {u for i, u, _ in rows if u is not None and i % 20 == 0}
    found = warc.lookup(directory, spark.createDataFrame([(u,) for u in asked], "url string")).collect()
    assert sorted((r["wanted"], r["page_id"]) for r in found) == sorted((u, i) for i, u, _ in rows if u in asked)
    whole = {r["page_id"]: r for r in warc.read_archive(directory).collect()}
    for r in found:
        assert all(r[c] == whole[r["page_id"]][c] for c in ("payload_digest", "record_type", "refers_to", "html"))
    assert sum(r["record_type"] == "revisit" for r in whole.values()) == sum(h == "common" for _, _, h in rows) - 1
    assert warc.qualified(spark, "/some/folder").startswith("file:")


def test_warc_small_payloads_never_revisit(spark):
    rows = [(1, "http://a.org/1", "ab"), (2, "http://a.org/2", "ab"), (3, "http://a.org/3", "abc"),
            (4, "http://a.org/4", "abc")]
    out = warc.read_archive(warc.write_archive(pages(spark, rows), min_payload_bytes=3)).collect()
    assert {(r["page_id"], r["record_type"]) for r in out} == {
        (1, "response"), (2, "response"), (3, "response"), (4, "revisit")}


def test_record_is_a_gzip_member_with_full_lengths():
    member = warc.record(1, "http://x/", None, "D" * 32, 77, 9)
    parsed = warc.parse(gzip.decompress(member))
    assert parsed["size"] == 77 and parsed["payload"] == b"" and parsed["headers"]["warc-refers-to"] == "<urn:page:9>"


def brute_top(rows, k):
    vectors = [(i, [math.floor(64 * x) for x in v]) for i, v in rows
               if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q in sorted({i for i, _ in vectors if i % 20 == 0}):
        w = next(v for i, v in vectors if i == q)
        scores = sorted(((-sum(a * b for a, b in zip(w, v)), i) for i, v in vectors if i != q))[:k]
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scores)]
    return out


@pytest.mark.parametrize("kind", ["dense", "sparse", "ragged"])
def test_maxscore_against_brute_force(spark, kind, monkeypatch):
    rng = np.random.default_rng(4)
    rows = []
    for i in range(600):
        v = rng.normal(size=24) / 4
        if kind != "dense":
            v = v * (rng.uniform(size=24) < 0.2)
        rows.append((i, v[:rng.integers(1, 25)].tolist() if kind == "ragged" else v.tolist()))
    rows += [(700 + i, rows[3][1]) for i in range(40)]  # ties
    rows += [(801, None), (802, [None] * 24), (820, [float("nan")] * 24), (840, [float("inf")] * 24), (None, [0.5] * 24)]
    if kind == "ragged":
        rows += [(860, [])]
    monkeypatch.setattr(maxscore, "LEAST_ROWS", 100)
    frame = spark.createDataFrame([(i, v, 1, 2.0, "x") for i, v in rows],
                                  "vec_id bigint, embedding array<double>, rank int, score double, w string")
    got = sorted(tuple(r) for r in maxscore.top_k(frame, k=7).select("query_id", "rank", "vec_id", "score").collect())
    assert got == sorted(brute_top(rows, 7))


def test_maxscore_empty_and_few(spark):
    empty = spark.createDataFrame([], "vec_id bigint, embedding array<float>")
    assert maxscore.top_k(empty).count() == 0
    few = spark.createDataFrame([(0, [1.0]), (1, [0.5]), (20, [-1.0])], "vec_id bigint, embedding array<float>")
    got = {tuple(r) for r in maxscore.top_k(few).collect()}
    assert got == {(0, 1, 1, 2048), (0, 2, 20, -4096), (20, 1, 1, -2048), (20, 2, 0, -4096)}
