"""WARC archives with a two-level capture index.

Captures are sorted by reversed-host URL key and written, one gzip member a
record, into one archive per partition. Consecutive captures share a
compressed index block, and a sparse directory holds one row per block: its
first and last key, where its lines are, and the span of the archive that its
records fill. A lookup binary-searches the parts and the directory, reads
one block by range, and then the key's records by range.
"""

from __future__ import annotations

import base64
import bisect
import gzip
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from acurail.llm.common import shared_path, staged, url_host

#: Captures per index block, and bytes of payload after which a block ends early.
BLOCK_CAPTURES, BLOCK_BYTES = 500, 16 << 20
#: Tasks among which the pages of one payload are dealt when revisits are marked.
SALTS = 16
DATE = "2024-01-01T00:00:00Z"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def open_store(path: str) -> tuple[fs.FileSystem, str]:
    """File system and inner path of a shared folder (local path, file://, hdfs://, s3://, gs://)."""
    if "://" not in path and not path.startswith("file:"):
        return fs.LocalFileSystem(), path
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1))


def qualified(spark: SparkSession, path: str) -> str:
    """``path`` with the scheme of the file system that Spark would use for it."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(p).toString()


def url_key(url: Column) -> Column:
    """Sort key of a capture: host labels reversed, then ``)`` and what follows the host; the bare text without ``://``."""
    host = url_host(url)
    rest = F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://[^/?#]*(.*)", 1), F.lit(""))
    parts = F.array_join(F.reverse(F.split(host, r"\.")), ",")
    return F.when(F.coalesce(url, F.lit("")).contains("://"), F.concat(parts, F.lit(")"), rest)).otherwise(
        F.coalesce(url, F.lit("")))


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _uri(url: str) -> str:
    """The URL without line breaks, so that it fits one header line."""
    return url.replace("\r", "%0D").replace("\n", "%0A")


def record(page_id: int | None, url: str | None, payload: bytes | None, digest: str, size: int,
           refers_to: int | None) -> bytes:
    """One WARC record as a gzip member: a response, or a revisit if ``payload`` is None.

    Both carry the HTTP headers of the full payload, so a revisit tells its length too.
    """
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    kind = "response" if payload is not None else "revisit"
    block = http + (payload or b"")
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{page_id}>", f"WARC-Date: {DATE}",
            f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response",
            f"Content-Length: {len(block)}"]
    if url is not None:
        head.insert(3, f"WARC-Target-URI: {_uri(url)}")
    if payload is None:
        head += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    data = "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"
    return gzip.compress(data, compresslevel=4, mtime=0)


def parse(member: bytes) -> dict:
    """Headers (lower-cased names), HTTP headers and payload of one record."""
    head, rest = member.split(b"\r\n\r\n", 1)
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    out = {k.strip().lower(): v.strip() for k, v in (x.split(":", 1) for x in lines[1:])}
    block = rest[:int(out["content-length"])]
    http, payload = block.split(b"\r\n\r\n", 1)
    sizes = [x.split(b":")[1] for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")]
    return {"headers": out, "size": int(sizes[0]), "payload": payload}


def _page_of(urn: str | None) -> int | None:
    if urn is None:
        return None
    inner = urn.removeprefix("<urn:page:").removesuffix(">")
    return None if inner == "None" else int(inner)


CAPTURES = ("page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, "
            "url string, html string")


def _capture(member: bytes) -> tuple:
    """A row of ``CAPTURES`` from a record; a response's digest and length are taken from its payload."""
    r = parse(member)
    h = r["headers"]
    response = h["warc-type"] == "response"
    digest = payload_digest(r["payload"]) if response else h["warc-payload-digest"].removeprefix("sha1:")
    if digest != h["warc-payload-digest"].removeprefix("sha1:") or response and len(r["payload"]) != r["size"]:
        raise ValueError(f"damaged record {h['warc-record-id']}")
    return (_page_of(h["warc-record-id"]), r["size"], digest, h["warc-type"],
            _page_of(h.get("warc-refers-to")), h.get("warc-target-uri"),
            r["payload"].decode("utf-8", "surrogatepass") if response else None)


DIRECTORY = ("part string, first_key string, last_key string, captures bigint, index_start bigint, index_bytes bigint, "
             "warc_start bigint, warc_bytes bigint")


def decided(pages: DataFrame, min_payload_bytes: int = 0) -> tuple[DataFrame, DataFrame]:
    """(page rows, revisit marks), both with columns key, page_id, sha.

    Pages of equal payloads (SHA-256) of at least ``min_payload_bytes`` have
    one response, that of the smallest ``page_id``; a mark names each page that
    revisits it in ``refers_to``. Marks come from ids and digests alone: no html
    moves to decide.
    """
    d = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    d = d.select(url_key(F.col("url")).alias("key"), "page_id", F.unhex(F.sha2("html", 256)).alias("sha"), "url", "html")
    thin = d.select("key", "page_id", "sha", F.octet_length("html").alias("size")).filter(
        F.col("size") >= min_payload_bytes)
    repeated = (thin.groupBy("sha").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n"))
                .filter("n > 1 AND refers_to IS NOT NULL"))
    # A payload that a third of all pages share is met by SALTS tasks: its pages are dealt by id.
    thin = thin.withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int"))
    repeated = repeated.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    marks = (thin.join(repeated, ["sha", "salt"]).filter(~F.col("page_id").eqNullSafe(F.col("refers_to")))
             .select("key", "page_id", "sha", "refers_to"))
    return d, marks


def write_archive(pages: DataFrame, folder: str | None = None, min_payload_bytes: int = 0) -> DataFrame:
    """Write archives and index blocks into ``folder``; returns the stored sparse directory (``DIRECTORY``).

    Null html is the empty payload; null URLs have an empty key; repeated rows
    of one page are records of their own; html of any length is one record; an
    empty table gives an empty directory; other columns are not read. A folder
    without a scheme is resolved by Spark's default file system. Files
    carry the task's attempt in their names, so a task that is run again never
    overwrites what another wrote, and the directory names only files of
    committed tasks.
    """
    folder = qualified(pages.sparkSession, folder or shared_path(pages.sparkSession, "warc"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        capture, revisits = None, {}
        task = TaskContext.get()
        store, root = open_store(folder)
        part = f"part-{task.partitionId():06d}-{task.taskAttemptId()}-{uuid.uuid4().hex[:8]}"
        rows: list[tuple] = []
        lines: list[str] = []
        warc, index, at, index_at, block_at, payload = None, None, 0, 0, 0, 0

        def close_block() -> None:
            nonlocal index_at, block_at, payload, lines
            data = zlib.compress("\n".join(lines).encode("utf-8", "surrogatepass"), 6)
            index.write(data)
            rows.append((part, json.loads(lines[0])[0], json.loads(lines[-1])[0], len(lines), index_at, len(data),
                         block_at, at - block_at))
            index_at, block_at, payload, lines = index_at + len(data), at, 0, []

        for batch in batches:
            for row in batch.to_pylist():
                if (row["key"], row["page_id"]) != capture:
                    capture, revisits = (row["key"], row["page_id"]), {}
                if row["html"] is None:  # a mark; it sorts before the page that it speaks of
                    revisits[row["sha"]] = row["refers_to"]
                    continue
                if warc is None:
                    store.create_dir(root, recursive=True)
                    warc = store.open_output_stream(f"{root}/{part}.warc.gz", compression=None)
                    index = store.open_output_stream(f"{root}/{part}.cdx", compression=None)
                html = row["html"].encode("utf-8", "surrogatepass")
                again = row["sha"] in revisits
                data = record(row["page_id"], row["url"], None if again else html, payload_digest(html), len(html),
                              revisits.get(row["sha"]))
                warc.write(data)
                lines.append(json.dumps([row["key"], at, len(data)], ensure_ascii=True))
                at, payload = at + len(data), payload + (0 if again else len(html))
                if len(lines) >= BLOCK_CAPTURES or payload >= BLOCK_BYTES:
                    close_block()
        if warc is not None:
            if lines:
                close_block()
            warc.close()
            index.close()
        names = [f.split()[0] for f in DIRECTORY.split(", ")]
        for i in range(0, len(rows), 1000):
            yield pa.record_batch([pa.array(c) for c in zip(*rows[i:i + 1000])], names=names)

    # Pages and marks are sorted together, so html is shuffled once and never joined. Page ids split hot keys:
    # one very common host or URL spreads over many archives.
    d, marks = decided(pages, min_payload_bytes)
    both = marks.unionByName(d, allowMissingColumns=True).select("key", "page_id", "sha", "refers_to", "url", "html")
    ordered = both.repartitionByRange("key", "page_id").sortWithinPartitions(
        "key", "page_id", F.col("html").isNotNull(), "sha")
    return staged(ordered.mapInArrow(write, DIRECTORY), "warc-directory").withColumn("folder", F.lit(folder))


def _read(store: fs.FileSystem, path: str, start: int, size: int) -> bytes:
    with store.open_input_file(path) as f:
        return f.read_at(size, start)


def _index_lines(store: fs.FileSystem, root: str, part: str, start: int, size: int) -> list[list]:
    data = zlib.decompress(_read(store, f"{root}/{part}.cdx", start, size))
    return [json.loads(x) for x in data.decode("ascii").split("\n")]


def read_archive(directory: DataFrame) -> DataFrame:
    """Every capture (``CAPTURES``), read back block by block.

    A block's records lie next to each other, so one range read of the archive
    gets them all; each is cut out by its index line.
    """
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in CAPTURES.split(", ")]
        types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string()]
        for batch in batches:
            for b in batch.to_pylist():
                store, root = open_store(b["folder"])
                lines = _index_lines(store, root, b["part"], b["index_start"], b["index_bytes"])
                span = _read(store, f"{root}/{b['part']}.warc.gz", b["warc_start"], b["warc_bytes"])
                cuts = [(at - b["warc_start"], size) for _, at, size in lines]
                found = [_capture(gzip.decompress(span[at:at + size])) for at, size in cuts]
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*found), types)], names=names)

    # A few blocks a task: their rows are tiny, so adaptive execution would put far too many into one.
    blocks = directory.count()
    tasks = max(1, -(-blocks // max(4, blocks // 10_000)))
    return directory.repartition(tasks, "part", "warc_start").mapInArrow(read, CAPTURES)


def lookup(directory: DataFrame, urls: DataFrame) -> DataFrame:
    """Captures of each URL of column ``url``: ``wanted`` and ``CAPTURES``; none for URLs that were not captured.

    The parts' key ranges (one row per archive) are binary-searched in the
    tasks; the directory is joined by part, and only the blocks that a key can
    be in are read, and of the archive the range of the key's records.
    """
    ranges = directory.groupBy("part").agg(F.min("first_key").alias("lo"), F.max("last_key").alias("hi"))
    known = sorted((r["lo"].encode(), r["hi"].encode(), r["part"]) for r in ranges.collect())
    starts = [k[0] for k in known]

    @F.pandas_udf("array<string>")
    def parts_of(keys: pd.Series) -> pd.Series:
        def search(key: str) -> list[str]:
            k = key.encode()
            i = bisect.bisect_right(starts, k) - 1
            found = []
            while i >= 0 and known[i][1] >= k:  # a key may run over the end of a part
                found.append(known[i][2])
                i -= 1
            return found
        return keys.map(search)

    wanted = urls.select(F.col("url").alias("wanted"), url_key(F.col("url")).alias("key")).filter(
        F.col("wanted").isNotNull()).distinct()
    hits = (wanted.select("wanted", "key", F.explode(parts_of.asNondeterministic()("key")).alias("part"))
            .join(directory, "part").filter("first_key <= key AND key <= last_key"))

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["wanted", *[f.split()[0] for f in CAPTURES.split(", ")]]
        block, lines = None, []
        for pdf in frames:
            for b in pdf.itertuples():
                store, root = open_store(b.folder)
                if (b.part, b.index_start) != block:
                    block, lines = (b.part, b.index_start), _index_lines(store, root, b.part, b.index_start, b.index_bytes)
                keys = [x[0].encode() for x in lines]
                k = b.key.encode()
                own = lines[bisect.bisect_left(keys, k):bisect.bisect_right(keys, k)]
                if not own:
                    continue
                # A key's records lie next to each other, so one range holds them all.
                start, end = own[0][1], own[-1][1] + own[-1][2]
                span = _read(store, f"{root}/{b.part}.warc.gz", start, end - start)
                rows = [_capture(gzip.decompress(span[at - start:at - start + size])) for _, at, size in own]
                out = [(b.wanted, *row) for row in rows if row[5] == _uri(b.wanted)]
                yield pd.DataFrame(out, columns=names).astype({"page_id": "Int64", "refers_to": "Int64"})

    near = hits.repartition("part", "index_start").sortWithinPartitions("part", "index_start", "key")
    return near.mapInPandas(read, "wanted string, " + CAPTURES)
