"""Writing pages as WARC archives and reading them back (operator 5).

Pages are range-sorted by id into shards. The shards' bounds come from histograms of payload bytes
over the id range, exact aggregates, so that they, and with them every file, depend on the pages
alone. A bin that holds more than a quarter of a shard is split again, until none does or it holds a
single id, whose rows are then dealt out by digest; so neither outlying ids nor a hot one leave much
to one task. Each shard is one task of its own number. It streams its records, each a gzip member
of its own, and starts another file when the compressed size passes a limit. Headers and digests
are made anew from the payload: record ids are derived from page id and digest, the date is a
parameter. Files are written under temporary names and renamed once whole; a task that runs again
writes the same bytes to the same names. Last, the manifest of all files (name, bytes, records,
SHA-256) is written under a temporary name and renamed; an archive without it isn't complete.

Of records with equal payloads of at least ``least`` bytes, the one of the largest page id is the
response and the others revisit it; groups are found on digests, aggregated before the shuffle,
and the payload is shuffled once. Ids, digests and sizes are written to the shared folder first, so
that the payload is read twice in all.

Cases: a null html is the empty payload; a null page id counts as smaller than any, and with no
other in its group each such row is a response; rows that share the largest id are all responses;
a null url becomes urn:page:<id>, and control characters in a url are percent-encoded; an empty
table gives an empty archive with a manifest; other columns aren't read.
"""

from __future__ import annotations

import base64
import hashlib
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, checkpoint, shared_dir, small_batches, table

#: Compressed size from which a file is closed, and plain size of a shard: several files.
FILE_BYTES = 16 << 20
SHARD_BYTES = 128 << 20
#: Shards at most; beyond that they grow, so that their table stays small.
MOST_SHARDS = 50_000
#: Parts of the id range.
BINS = 4096
#: Bits by which a bin that holds too much is split.
SPLIT = 6
BROADCAST_ROWS = 200_000
SALT = 16
DATE = "2024-01-01T00:00:00Z"
SPACE = uuid.UUID("5f1b7d54-0c58-4d0e-9a37-0b6e4a3e6a11")
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST = "file string, bytes long, records long, sha256 string"
RECORD = "page_id long, url string, record_type string, payload binary, payload_bytes long, payload_digest string, refers_to long"


def base32_sha1(payload: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None, digest: str) -> str:
    """The record's id: of page id and payload digest alone."""
    return f"<urn:uuid:{uuid.uuid5(SPACE, f'{page_id}:{digest}')}>"


def _target(url: str | None, page_id: int | None) -> str:
    return "".join(c if " " < c != "\x7f" else f"%{ord(c):02X}" for c in url) if url else f"urn:page:{page_id}"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str = DATE) -> bytes:
    """One WARC record, response or revisit, uncompressed."""
    digest = base32_sha1(payload)
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if refers_to is not None else head + payload
    fields = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", record_id(page_id, digest)),
        ("WARC-Date", date),
        ("WARC-Target-URI", _target(url, page_id)),
        ("Content-Type", "application/http; msgtype=response"),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("WARC-Block-Digest", f"sha1:{base32_sha1(block)}"),
        ("X-Page-Id", "" if page_id is None else str(page_id)),
        ("X-Payload-Length", str(len(payload))),
    ]
    if refers_to is not None:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(refers_to, digest)), ("X-Refers-To-Page-Id", str(refers_to))]
    fields.append(("Content-Length", str(len(block))))
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Fields and block of one record; checks the block's digest and length."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("not a WARC record")
    fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    if f"sha1:{base32_sha1(block)}" != fields["WARC-Block-Digest"] or rest[len(block) :] != b"\r\n\r\n":
        raise ValueError(f"damaged record {fields.get('WARC-Record-ID')}")
    return fields, block


def _roles(pages: DataFrame, least: int) -> DataFrame:
    """(sha, size, largest): groups of two and more equal payloads, and their largest page id."""
    groups = pages.filter(F.col("size") >= least).groupBy("sha", "size").agg(F.max("page_id").alias("largest"), F.count("*").alias("n"))
    return groups.filter("n > 1 and largest is not null").select("sha", "size", "largest")


def shard_bounds(pages: DataFrame, shard_bytes: int) -> tuple[int, list[tuple[int, int, int]]]:
    """Ways of null ids, which come first, and ranges of ids in order as (first id, first shard, ways).
    Rows of a range of several ways are dealt out over as many shards, each other range is of one."""
    weight = F.sum(F.col("size") + 512)
    total, low, high = pages.agg(weight, F.min("page_id"), F.max("page_id")).first()
    shard_bytes = max(shard_bytes, (total or 0) // MOST_SHARDS)
    nulls = pages.filter("page_id is null").agg(weight).first()[0] or 0
    sizes: list[tuple[int, int, bool]] = []  # first id, bytes, whether a single id
    if low is not None:
        shift = next(k for k in range(64) if (high >> k) - (low >> k) < BINS)
        rows = pages.filter("page_id is not null")
        while True:
            bin_of = F.shiftright("page_id", shift)
            found = rows.groupBy(bin_of.alias("bin")).agg(weight.alias("n")).collect()  # BINS, then SPLIT for each quarter of a shard
            heavy = [r["bin"] for r in found if shift and r["n"] > shard_bytes // 4]
            sizes += [(r["bin"] << shift, r["n"], not shift) for r in found if r["bin"] not in set(heavy)]
            if not heavy:
                break
            wanted = pages.sparkSession.createDataFrame([(x,) for x in heavy], "__bin long")
            rows = rows.join(F.broadcast(wanted), bin_of == F.col("__bin"), "left_semi")
            shift = max(0, shift - SPLIT)
    ways = max(1, -(-nulls // shard_bytes))
    out, shard, held = [], ways if nulls else 0, 0
    for first, n, single in sorted(sizes):
        if held and held + n > shard_bytes:
            shard, held = shard + 1, 0
        k = -(-n // shard_bytes) if single else 1
        if k > 1 or not out or out[-1][1] != shard or out[-1][2] > 1:
            out.append((first, shard, k))
        held += n
        if k > 1:
            shard, held = shard + k, 0
    return ways, out


def _shard_of(ways: int, bounds: list[tuple[int, int, int]]):
    """Column: the shard of a page, from page_id and a hash of its digest and url."""
    firsts, shards, many = (np.array([b[k] for b in bounds] or [0], np.int64) for k in range(3))

    @F.arrow_udf("int")
    def shard(ids: pa.Array, mixed: pa.Array) -> pa.Array:
        empty, h = np.asarray(ids.is_null()), mixed.to_numpy(zero_copy_only=False)
        at = np.maximum(np.searchsorted(firsts, ids.fill_null(0).to_numpy(zero_copy_only=False), side="right") - 1, 0)
        return pa.array(np.where(empty, h % ways, shards[at] + h % np.maximum(many[at], 1)).astype(np.int32))

    return shard(F.col("page_id"), F.xxhash64("sha", "url"))


def write(pages: DataFrame, folder: str, least: int = 0, file_bytes: int = FILE_BYTES, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Write pages (page_id, url, html) as an archive in ``folder``; returns the manifest."""
    spark = pages.sparkSession
    small_batches(spark)
    scratch = Scratch(spark, "warc-digests")
    payload = F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("sha", F.sha1("payload")).withColumn("size", F.octet_length("payload"))
    narrow = scratch.keep(rows.select("page_id", "sha", "size"))
    roles = scratch.keep(_roles(narrow, least))
    if roles.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        known = rows.join(F.broadcast(roles), ["sha", "size"], "left")
    else:  # a hot payload is spread over SALT tasks
        spread = roles.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
        known = rows.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALT)).cast("int")).join(spread, ["sha", "size", "salt"], "left")
    known = known.withColumn("refers", F.when(~F.col("page_id").eqNullSafe(F.col("largest")), F.col("largest")))
    ways, bounds = shard_bounds(narrow, shard_bytes)
    count = max([ways, *(first + k for _, first, k in bounds)])
    shard = _shard_of(ways, bounds)
    sorted_rows = known.select(shard.alias("shard"), "page_id", "url", "sha", "payload", "refers").repartitionById(count, F.col("shard")).sortWithinPartitions("shard", "page_id", "url", "sha")

    def run(batches):
        import gzip

        from pyarrow import fs as pafs
        from pyspark import TaskContext

        fs, root = pafs.FileSystem.from_uri(folder)
        attempt = TaskContext.get().taskAttemptId()
        fs.create_dir(f"{root}/_temporary", recursive=True)
        state = {"shard": None, "serial": 0, "out": None}

        def close():
            if state["out"] is None:
                return []
            state["out"].close()
            state["out"] = None
            fs.move(f"{root}/_temporary/{attempt}-{state['name']}", f"{root}/{state['name']}")
            return [(state["name"], state["size"], state["records"], state["sha"].hexdigest())]

        def as_batch(done):
            names, sizes, records, shas = zip(*done)
            return pa.RecordBatch.from_arrays([pa.array(names), pa.array(sizes, pa.int64()), pa.array(records, pa.int64()), pa.array(shas)], names=["file", "bytes", "records", "sha256"])

        for batch in batches:
            for row in zip(*(batch.column(n) for n in range(6))):
                at = row[0].as_py()
                if at != state["shard"] or (state["out"] is not None and state["size"] >= file_bytes):
                    if done := close():
                        yield as_batch(done)
                    state["serial"] = state["serial"] + 1 if at == state["shard"] else 0
                    state["shard"] = at
                if state["out"] is None:
                    state |= {"name": f"pages-{at:06d}-{state['serial']:05d}.warc.gz", "size": 0, "records": 0, "sha": hashlib.sha256()}
                    state["out"] = fs.open_output_stream(f"{root}/_temporary/{attempt}-{state['name']}", compression=None)
                member = gzip.compress(record(row[1].as_py(), row[2].as_py(), row[4].as_py(), row[5].as_py()), 6, mtime=0)
                state["out"].write(member)
                state["sha"].update(member)
                state["size"] += len(member)
                state["records"] += 1
        if done := close():
            yield as_batch(done)

    manifest = checkpoint(sorted_rows.mapInArrow(run, MANIFEST))
    from pyarrow import fs as pafs

    manifest.coalesce(1).orderBy("file").write.mode("overwrite").json(f"{folder}/_temporary/manifest")
    fs, root = pafs.FileSystem.from_uri(folder)
    fs.move(f"{root}/_temporary/manifest", f"{root}/manifest")
    fs.delete_dir(f"{root}/_temporary")
    scratch.close()
    return manifest


def read(spark: SparkSession, folder: str, payloads: bool = True) -> DataFrame:
    """Records of an archive's files, as its manifest lists them, with checked digests; revisits
    have no payload. payloads: whether to return the payloads."""
    files = spark.read.schema(MANIFEST).json(f"{folder}/manifest")
    spread = files.repartition(spark.sparkContext.defaultParallelism, "file")

    def run(batches):
        import gzip

        from pyarrow import fs as pafs

        fs, root = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            for name, want, sha in zip(*(batch.column(n).to_pylist() for n in (0, 2, 3))):
                rows, seen, held, check = [], 0, 0, hashlib.sha256()
                with fs.open_input_stream(f"{root}/{name}", compression=None) as raw:
                    while part := raw.read(1 << 20):
                        check.update(part)
                if check.hexdigest() != sha:
                    raise ValueError(f"{name} isn't the file that its manifest names")
                with fs.open_input_stream(f"{root}/{name}", compression=None) as raw, gzip.open(raw) as f:
                    while line := f.readline():
                        head = [line]
                        while line != b"\r\n":
                            line = f.readline()
                            head.append(line)
                        size = next(int(x[16:]) for x in head if x.startswith(b"Content-Length: "))
                        fields, block = parse(b"".join(head) + f.read(size + 4))
                        seen += 1
                        page = int(fields["X-Page-Id"]) if fields["X-Page-Id"] else None
                        digest, length = fields["WARC-Payload-Digest"][5:], int(fields["X-Payload-Length"])
                        body = None
                        if fields["WARC-Type"] == "response":
                            body = block.partition(b"\r\n\r\n")[2]
                            if base32_sha1(body) != digest or len(body) != length:
                                raise ValueError(f"damaged payload of page {page}")
                        refers = fields.get("X-Refers-To-Page-Id")
                        rows.append((page, fields["WARC-Target-URI"], fields["WARC-Type"], body if payloads else None, length, digest, int(refers) if refers else None))
                        held += len(body or b"") if payloads else 64
                        if held > 8 << 20:
                            yield _batch(rows)
                            rows, held = [], 0
                if rows:
                    yield _batch(rows)
                if seen != want:
                    raise ValueError(f"{name} holds {seen} records, not {want}")

    return spread.select("file", "bytes", "records", "sha256").mapInArrow(run, RECORD)


def _batch(rows):
    kinds = [("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64())]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(zip(*rows), kinds)], names=[n for n, _ in kinds])


def op5_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 5 over the whole of pages: written to a new archive in the shared folder, and read back."""
    base = shared_dir(spark)
    folder = f"{base if '://' in base else 'file://' + base}/warc-{uuid.uuid4().hex}"
    write(table(spark, sf_dir, "pages"), folder)
    return read(spark, folder, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP5_SQL = """
WITH p AS (SELECT page_id::BIGINT AS page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, strlen(html)::BIGINT AS payload_bytes, sha1(html) AS sha,
             max(page_id) OVER (PARTITION BY html) AS largest FROM p)
SELECT page_id, payload_bytes,
  array_to_string(list_transform(range(32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    (((('0x' || substr(sha, (k // 4 * 5 + 1)::INT, 5))::BIGINT >> (15 - k % 4 * 5)::INT) & 31) + 1)::INT, 1)), '') AS payload_digest,
  CASE WHEN page_id IS DISTINCT FROM largest AND largest IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM largest THEN largest END AS refers_to
FROM d
"""
