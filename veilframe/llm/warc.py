"""Deterministic sharded WARC writer, and reader.

1. Digests: of rows with equal payloads of at least min_revisit bytes, the one with the least page_id is a response, the
   others revisit it. Only (page_id, digest) rows are shuffled for this; groups of copies are summed up before it. The
   links found join the records at their shard, so payloads are shuffled once, by 2.
2. Range sort: shards are ranges of page_id with near equal payload bytes. Their bounds come from exact histograms, narrowed
   where a range has too much (one job a round for all of them), so they depend on the rows alone. Inside a shard, records are
   sorted by (page_id, digest, url).
3. Files: every task writes its shards record by record as gzip members, and begins a new file when the compressed size
   is reached. Headers, record ids and digests are made anew from the row, so equal input gives equal files.
4. Commit: a file is written under a temporary name of the attempt and renamed when it is whole; the files' names,
   sizes, digests and record counts go to a manifest table that Spark commits as a whole. Readers read only files that
   the manifest names, and check their digests; a lost or repeated task leaves nothing that is read.

Rows: null html is an empty payload, a null url is urn:page:ID. A null page_id sorts first, comes back null and is
never revisited: its record is always a response. Rows that share a page_id and payload are responses if that id is the
least. An empty table writes an empty manifest. Other columns are ignored. The output folder must be reachable by all
executors (any filesystem that pyarrow.fs knows).
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import json
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, read, slices

_MANIFEST = "shard int, file string, records long, bytes long, sha256 string, first_id long, last_id long"
_RECORDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
_DATE = "2024-01-01T00:00:00Z"
_NO_ID = -(2**63)


def payloads(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id (null as the least long), url, payload and digest."""
    payload = F.coalesce(F.col(html_col).cast("string").cast("binary"), F.lit(b""))
    rows = pages.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_NO_ID)).alias("page_id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"))
    return rows.withColumn("digest", F.sha2("payload", 256))


def _place(page_id: Column, url: Column, html: Column) -> Column:
    """Where a record is sorted: its id; without one, a place in front by a hash, so that such rows are no hot key."""
    spread = F.shiftrightunsigned(F.xxhash64(url.cast("string"), F.coalesce(html.cast("string").cast("binary"), F.lit(b""))), 2)
    return F.coalesce(page_id, F.lit(_NO_ID) + spread)


def revisits(rows: DataFrame, min_revisit: int = 100) -> DataFrame:
    """page_id, digest and refers_to of the payloads that are revisits, each once."""
    can = rows.where((F.octet_length("payload") >= min_revisit) & (F.col("page_id") != _NO_ID)).select("page_id", "digest")
    # One row for each digest that several ids have; all others are responses without a look at them.
    least = can.groupBy("digest").agg(F.min("page_id").alias("first"), F.max("page_id").alias("last")).where("first != last").select("digest", F.col("first"))
    return can.join(least, "digest").where("page_id != first").select("page_id", "digest", F.col("first").alias("refers_to")).distinct()


def range_shards(rows: DataFrame, weight: Column, target: int, key: str = "page_id", bins: int = 4096, max_shards: int = 65536) -> list[int]:
    """Lower bounds of the shards after the first: keys, ascending. One key never spans shards.

    Every round counts all ranges that are still too heavy in one job. The target is raised where it would make more
    than about max_shards shards, so what the driver holds has a bound at any size.
    """
    narrow = rows.select(F.col(key).cast("long").alias("key"), weight.cast("long").alias("w"))
    ends = narrow.agg(F.min("key").alias("lo"), F.max("key").alias("hi"), F.sum("w").alias("w")).first()
    if ends.lo is None:
        return []
    target = max(target, -(-ends.w // max_shards))
    todo, found = [(ends.lo, ends.hi, -(-(ends.hi - ends.lo + 1) // bins))], []
    while todo:
        counted = _histogram(narrow, todo).collect()
        lows, again = [r[0] for r in todo], []
        for r in sorted(counted):
            _, last, step = todo[bisect.bisect_right(lows, r.begin) - 1]
            if r.w > target and step > 1:
                end = min(r.begin + step - 1, last)
                again.append((r.begin, end, -(-(end - r.begin + 1) // max(16, -(-4 * r.w // target)))))
            else:
                found.append((r.begin, r.w))
        todo = again
    bounds, run = [], 0
    for begin, w in sorted(found):
        if run and run + w > target:
            bounds.append(begin)
            run = 0
        run += w
    return bounds


def _histogram(narrow: DataFrame, ranges: list[tuple[int, int, int]]) -> DataFrame:
    """begin and w: the weight of each step of the ranges (first key, last key, step; ascending) that has rows."""
    lows, lasts = (np.array([r[i] for r in ranges], np.int64).view(np.uint64) for i in (0, 1))
    given = narrow.sparkSession.sparkContext.broadcast((lows, lasts - lows, np.array([r[2] for r in ranges], np.uint64)))

    def count(batches):
        # Unsigned differences wrap, so keys may span all longs.
        lows, spans, steps = given.value
        for batch in batches:
            keys, w = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            at = np.searchsorted(lows.view(np.int64), keys, "right") - 1
            off = keys.view(np.uint64) - lows[at]
            inside = (at >= 0) & (off <= spans[at])
            at, off, w = at[inside], off[inside], w[inside]
            begins, place = np.unique((lows[at] + off // steps[at] * steps[at]).view(np.int64), return_inverse=True)
            sums = np.zeros(len(begins), np.int64)
            np.add.at(sums, place, w)
            yield pa.RecordBatch.from_arrays([pa.array(begins), pa.array(sums)], ["begin", "w"])

    return narrow.mapInArrow(count, "begin long, w long").groupBy("begin").agg(F.sum("w").alias("w"))


def record(page_id: int, url: str | None, payload: bytes, digest: str, refers_to: int | None, nth: int = 0) -> bytes:
    """One WARC record, not compressed. nth: how many records of the page's id and payload (without an id: and of its
    address) come before it; so every record has an id of its own, and a revisit names the first of its response's."""
    uri = url or f"urn:page:{page_id}"
    name = lambda i, n: f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{i}:{digest}:{uri if i == _NO_ID else ''}:{n}')}>"
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    sha1 = base64.b32encode(hashlib.sha1(block).digest()).decode()
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {name(page_id, nth)}", f"WARC-Date: {_DATE}"]
    head += [f"WARC-Target-URI: {uri.encode('unicode_escape').decode()}", f"X-Page-Id: {page_id}", f"WARC-Payload-Digest: sha256:{digest}", f"X-Payload-Length: {len(payload)}", f"WARC-Block-Digest: sha1:{sha1}"]
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {name(refers_to, 0)}", f"X-Refers-To-Page: {refers_to}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _member(raw: bytes, level: int) -> bytes:
    """A gzip member without time or name."""
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress(raw) + packer.flush()


def _filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or not uri.startswith("/") else f"file://{uri}")


def write(pages: DataFrame, folder: str, shard_bytes: int = 64 << 20, file_bytes: int = 16 << 20, level: int = 4, min_revisit: int = 100, **columns) -> DataFrame:
    """Write pages under folder, a URI that all executors reach; gives the manifest, which is written beside the files."""
    spark = pages.sparkSession
    rows = payloads(pages, **columns)
    # The bounds need ids and lengths only, from the table itself.
    id_col, html_col = columns.get("id_col", "page_id"), columns.get("html_col", "html")
    url_col = columns.get("url_col", "url")
    sizes = pages.select(_place(F.col(id_col).cast("long"), F.col(url_col), F.col(html_col)).alias("page_id"), (F.coalesce(F.octet_length(F.col(html_col).cast("string")), F.lit(0)) + 512).alias("w"))
    bounds = range_shards(sizes, F.col("w"), shard_bytes)
    given = spark.sparkContext.broadcast(bounds)

    def place(batches):
        for part in batches:
            shard = [bisect.bisect_right(given.value, i) for i in part.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(shard, pa.int32()), *part.columns], ["shard", *part.schema.names])

    # A revisit's link travels to the shard as a row of its own and sorts before the records that it is about, so the
    # payloads are shuffled once.
    kinds = "place long, page_id long, digest string, refers_to long, url string, payload binary"
    links = revisits(rows, min_revisit).select(F.col("page_id").alias("place"), "page_id", "digest", "refers_to", F.lit(None).cast("string").alias("url"), F.lit(None).cast("binary").alias("payload"))
    own = F.when(F.col("page_id") != _NO_ID, F.col("page_id"))
    records = rows.select(_place(own, F.col("url"), F.col("payload")).alias("place"), "page_id", "digest", F.lit(None).cast("long").alias("refers_to"), "url", "payload")
    placed = records.unionByName(links).mapInArrow(place, "shard int, " + kinds)
    # One partition per shard: hashes of few shard numbers would leave some tasks with several.
    ordered = placed.repartitionById(len(bounds) + 1, F.col("shard")).sortWithinPartitions("shard", "place", "page_id", "digest", F.col("refers_to").asc_nulls_last(), "url")

    def store(batches):
        from pyspark import TaskContext

        files, root = _filesystem(folder)
        files.create_dir(root, recursive=True)
        attempt = TaskContext.get().taskAttemptId()
        now, done = None, []

        def close():
            nonlocal now
            if now:
                now["out"].close()
                files.move(now["temporary"], f"{root}/{now['file']}")
                done.append({"shard": now["shard"], "file": now["file"], "records": now["records"], "bytes": now["size"], "sha256": now["sha"].hexdigest(), "first_id": now["first"], "last_id": now["last"]})
            now = None

        def begin(shard, number):
            name = f"part-{shard:06d}-{number:05d}.warc.gz"
            temporary = f"{root}/.{name}.{attempt}.{uuid.uuid4().hex}.tmp"
            out = {"shard": shard, "number": number, "file": name, "temporary": temporary, "out": files.open_output_stream(temporary, compression=None), "records": 0, "size": 0, "sha": hashlib.sha256(), "first": None, "last": None}
            put(out, _member(b"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:%s>\r\nWARC-Date: %s\r\nWARC-Filename: %s\r\nContent-Type: application/warc-fields\r\nContent-Length: 20\r\n\r\nformat: WARC/1.1 1\r\n\r\n\r\n" % (str(uuid.uuid5(uuid.NAMESPACE_URL, name)).encode(), _DATE.encode(), name.encode()), level))
            return out

        def put(file, raw):
            file["out"].write(raw)
            file["sha"].update(raw)
            file["size"] += len(raw)

        about, refers, nth = None, None, 0
        for part in slices(batches, rows=256):
            for shard, _, page, digest, link, url, payload in zip(*(c.to_pylist() for c in part.columns), strict=True):
                what = (page, digest, url) if page == _NO_ID else (page, digest)
                if what != about:
                    about, refers, nth = what, link, 0
                if payload is None:
                    continue
                if now is None or now["shard"] != shard or now["size"] >= file_bytes:
                    number = now["number"] + 1 if now and now["shard"] == shard else 0
                    close()
                    now = begin(shard, number)
                put(now, _member(record(page, url, payload, digest, refers, nth), level))
                nth += 1
                now["records"] += 1
                now["first"], now["last"] = page if now["first"] is None else now["first"], page
        close()
        if done:
            yield pa.RecordBatch.from_pylist(done, schema=pa.schema([(n, {"int": pa.int32(), "string": pa.string(), "long": pa.int64()}[k]) for n, k in (x.split() for x in _MANIFEST.split(", "))]))

    manifest = f"{folder}/manifest"
    ordered.mapInArrow(store, _MANIFEST).write.mode("overwrite").parquet(manifest)
    return spark.read.schema(_MANIFEST).parquet(manifest)


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (lower-case names) and block of one record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    fields = {k.lower(): v for k, v in fields.items()}
    return fields, rest[: int(fields["content-length"])]


def members(stream, chunk: int = 1 << 16):
    """The gzip members of a stream, each whole."""
    left = b""
    unpack, parts = zlib.decompressobj(31), []
    while True:
        if not left:
            left = stream.read(chunk)
            if not left:
                break
        parts.append(unpack.decompress(left))
        left = b""
        if unpack.eof:
            left = unpack.unused_data
            yield b"".join(parts)
            unpack, parts = zlib.decompressobj(31), []
    if any(parts):
        raise ValueError("a member is cut off")


def read_back(manifest: DataFrame, folder: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of the records in the manifest's files.

    A response's payload is digested again and must agree with its header; files must have their manifest's digest.
    """

    def run(batches):
        files, root = _filesystem(folder)

        class Hashed:
            def __init__(self, raw):
                self.raw, self.sha = raw, hashlib.sha256()

            def read(self, n):
                data = self.raw.read(n)
                self.sha.update(data)
                return data

        schema = pa.schema([(n, {"string": pa.string(), "long": pa.int64()}[k]) for n, k in (x.split() for x in _RECORDS.split(", "))])
        for batch in batches:
            for name, sha in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows = []
                with files.open_input_stream(f"{root}/{name}", compression=None) as raw:
                    stream = Hashed(raw)
                    for member in members(stream):
                        fields, block = parse(member)
                        if fields["warc-type"] == "warcinfo":
                            continue
                        digest, size = fields["warc-payload-digest"].removeprefix("sha256:"), int(fields["x-payload-length"])
                        if fields["warc-type"] == "response":
                            payload = block.partition(b"\r\n\r\n")[2]
                            if hashlib.sha256(payload).hexdigest() != digest or len(payload) != size:
                                raise ValueError(f"{name}: a payload's digest is wrong")
                        page = int(fields["x-page-id"])
                        refers = fields.get("x-refers-to-page")
                        rows.append({"page_id": None if page == _NO_ID else page, "payload_bytes": size, "payload_digest": digest, "record_type": fields["warc-type"], "refers_to": refers and int(refers)})
                        if len(rows) == 4096:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows = []
                if stream.sha.hexdigest() != sha:
                    raise ValueError(f"{name}: not the file of the manifest")
                yield pa.RecordBatch.from_pylist(rows, schema)

    # A stated number: the manifest is so small that adaptive execution would join all files into one task.
    files = manifest.select("file", "sha256")
    return files.repartition(min(max(files.count(), 1), 65536), "file").mapInArrow(run, _RECORDS)


def summary(manifest: DataFrame) -> str:
    """Files, records and bytes of a manifest, as JSON."""
    r = manifest.agg(F.count("*").alias("files"), F.sum("records").alias("records"), F.sum("bytes").alias("bytes")).first()
    return json.dumps(r.asDict())


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = Scratch(spark, "warc").root
    return read_back(write(read(spark, sf_dir, "pages"), folder, shard_bytes=16 << 20, file_bytes=4 << 20), folder)


#: The contract of op3 in DuckDB SQL, over the pages themselves.
OP3_SQL = """
WITH payloads AS (
  SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages
), ranked AS (
  SELECT page_id, CAST(octet_length(payload) AS BIGINT) AS payload_bytes, sha256(payload) AS payload_digest,
    min(page_id) OVER (PARTITION BY payload) AS first_page
  FROM payloads
)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 100 AND page_id > first_page THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND page_id > first_page THEN first_page END AS refers_to
FROM ranked
"""
