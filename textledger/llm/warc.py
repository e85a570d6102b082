"""Deterministic sharded WARC writing and reading.

Records are put in the order of their ids. Shards are ranges of that order with about equal bytes:
bytes are summed in at most 65,536 equal ranges of ids, running sums give each range its shard, so
shards depend on the data alone, not on partitions or samples (a range with more bytes than a shard
is dealt over several by digest). A task sorts a shard and streams it into gzip members, one for each record, and starts a new
file when the compressed size is reached. Record ids, dates, lengths and digests are regenerated;
repeated payloads become revisit records of one response.

Files are written under temporary names, unique to the attempt, so retried and speculative tasks
can't collide. The attempts' rows that Spark commits are the manifest. Files are then renamed to
their final names (again safely, if a rename is retried), and MANIFEST.json is written last; readers
take only the manifest's files, and check lengths and digests while they stream them.

The target folder is any that pyarrow.fs can open (file, hdfs, s3, gs) and all executors share.

Defined results: a null payload is empty; a null id is ordered before all others and stands in no
revisit's reference unless all of its payload's rows lack one; of rows with one payload, all that
bear the largest id are responses; a null url is written as urn:none; repeated rows give repeated
records; an empty table gives an archive without files; other columns are ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import delete, shared_path, table, written

RANGES = 1 << 16
LEAST_SHARD = 1 << 20
MOST_SHARD = 1 << 30
SHARDS = 4096
FILE_BYTES = 128 << 20
DATE = "2024-01-01T00:00:00Z"
SPACE = uuid.UUID("6f1b8a52-6f0e-4f53-9d58-3a52a1c0d7a4")
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST = "shard long, part int, temp string, name string, records long, bytes long, sha256 string"
READ = "id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, payload binary"


def sha1_32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def record(row: dict, payload: bytes) -> bytes:
    """One WARC record. A revisit has the HTTP header only, with the payload's length."""
    revisit = row["refers_to"] is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {row['size']}\r\n\r\n".encode()
    block = http if revisit else http + payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(SPACE, str(row['id']))}>",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {(row['url'] or 'urn:none').replace(chr(13), '').replace(chr(10), '')}",
        f"WARC-Payload-Digest: sha1:{row['digest']}",
        f"WARC-Block-Digest: sha1:{sha1_32(block)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if row["id"] is not None:
        lines.append(f"X-Source-Id: {row['id']}")
    if revisit:
        lines.append(f"WARC-Profile: {PROFILE}")
        lines.append(f"WARC-Refers-To: <urn:uuid:{uuid.uuid5(SPACE, str(row['refers_to']))}>")
        lines.append(f"X-Refers-To-Source-Id: {row['refers_to']}")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


class ShardFiles:
    """The files of one shard, each closed when it reaches the size."""

    def __init__(self, folder: str, shard: int, file_bytes: int) -> None:
        self.fs, self.root = filesystem(folder)
        self.shard, self.file_bytes, self.part, self.out = shard, file_bytes, 0, None

    def add(self, raw: bytes) -> dict | None:
        if self.out is None:
            self.temp = f"_temporary/{self.shard:08d}-{self.part:05d}-{uuid.uuid4().hex}"
            self.out, self.records, self.bytes, self.sha = self.fs.open_output_stream(f"{self.root}/{self.temp}"), 0, 0, hashlib.sha256()
        member = gzip.compress(raw, 6, mtime=0)
        self.out.write(member)
        self.sha.update(member)
        self.records, self.bytes = self.records + 1, self.bytes + len(member)
        return self.close() if self.bytes >= self.file_bytes else None

    def close(self) -> dict | None:
        if self.out is None:
            return None
        self.out.close()
        row = {
            "shard": self.shard, "part": self.part, "temp": self.temp, "name": f"part-{self.shard:08d}-{self.part:05d}.warc.gz",
            "records": self.records, "bytes": self.bytes, "sha256": self.sha.hexdigest(),
        }
        self.out, self.part = None, self.part + 1
        return row


def shard_of(keys: DataFrame) -> tuple[DataFrame, Column, int]:
    """Of each range of ids: its first shard and how many it has; a row's range; the number of shards."""
    low, high, total = keys.agg(F.min("id"), F.max("id"), F.sum("size")).first()
    low, high, total = low or 0, high or 0, total or 0
    each = min(MOST_SHARD, max(LEAST_SHARD, -(-total // SHARDS)))
    width = max(1, -(-(high - low + 1) // RANGES))
    part = F.coalesce(F.floor((F.col("id") - F.lit(low)) / F.lit(width)).cast("long"), F.lit(-1).cast("long"))
    sums = keys.groupBy(part.alias("range")).agg(F.sum(F.col("size") + 512).alias("n"))  # at most RANGES + 1 rows
    before = F.coalesce(F.sum("n").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    first = F.floor(before / F.lit(each)).cast("long")
    spread = F.ceil(F.col("n") / F.lit(each)).cast("long")
    return sums.select("range", first.alias("first"), spread.alias("spread")), part, int(total // each) + 1


def roles(keys: DataFrame) -> DataFrame:
    """keys (id, digest, size, range) with refers_to, null for responses."""
    best = keys.groupBy("digest").agg(F.max("id").alias("best"))
    refers = F.when(~F.col("id").eqNullSafe(F.col("best")), F.col("best"))
    return keys.join(best, "digest").select("id", "digest", refers.alias("refers_to"), "shard")


def write_warc(
    records: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", file_bytes: int = FILE_BYTES
) -> DataFrame:
    """Writes one record for each row below folder and returns the manifest (see MANIFEST)."""
    session = records.sparkSession
    payload = F.encode(F.coalesce(F.col(payload_col), F.lit("")), "UTF-8")
    rows = records.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), payload.alias("payload"))
    # Ids are made of hex digits here; the written digest is base 32 and made with the record.
    hashed = rows.withColumn("digest", F.sha1("payload")).withColumn("size", F.octet_length("payload").cast("long"))
    keys = written(hashed.select("id", "digest", "size"), "warc-keys")
    ranges, part, n = shard_of(keys)
    ranges = F.broadcast(written(ranges, "warc-ranges"))  # RANGES + 1 rows at most
    spot = F.col("first") + F.pmod(F.xxhash64("digest"), F.col("spread"))
    placed = lambda df: df.withColumn("range", part).join(ranges, "range").withColumn("shard", spot).drop("range", "first", "spread")
    # A row's role comes before it in its shard, so payloads are shuffled once.
    told = roles(placed(keys)).distinct().select(
        "shard", "id", "digest", F.lit(0).alias("told"), "refers_to", F.lit(None).cast("string").alias("url"),
        F.lit(None).cast("binary").alias("payload"), F.lit(0).cast("long").alias("size"),
    )
    full = placed(hashed).select(
        "shard", "id", "digest", F.lit(1).alias("told"), F.lit(None).cast("long").alias("refers_to"), "url", "payload", "size"
    )
    tasks = max(1, min(n, int(session.conf.get("spark.sql.shuffle.partitions")) * 4))
    work = told.unionByName(full).repartition(tasks, "shard").sortWithinPartitions("shard", F.col("id").asc_nulls_first(), "digest", "told", "url")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, told = None, None
        done: list[dict] = []
        names = [c.split(" ")[0] for c in MANIFEST.split(", ")]
        for b in batches:
            for cells in zip(*b.columns, strict=True):  # a payload at a time
                r = {n: c.as_py() for n, c in zip(b.schema.names, cells, strict=True)}
                if files is None or files.shard != r["shard"]:
                    done.append(files.close() if files else None)
                    files = ShardFiles(folder, r["shard"], file_bytes)
                if not r["told"]:
                    told = r
                    continue
                r["refers_to"] = told["refers_to"]
                r["digest"] = sha1_32(r["payload"])
                done.append(files.add(record(r, r["payload"])))
        done.append(files.close() if files else None)
        rows = [x for x in done if x]
        kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string()}
        schema = pa.schema([(n, kinds[c.split(" ")[1]]) for n, c in zip(names, MANIFEST.split(", "), strict=True)])
        yield pa.RecordBatch.from_pylist(rows, schema=schema)

    fs, root = filesystem(folder)
    fs.create_dir(f"{root}/_temporary", recursive=True)
    manifest = written(work.mapInArrow(run, MANIFEST), "warc-manifest")
    commit(manifest, folder)
    delete(keys)
    return manifest


def commit(manifest: DataFrame, folder: str) -> None:
    """Renames the manifest's files, then writes MANIFEST.json and removes what no attempt committed."""

    def rename(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = filesystem(folder)
        for b in batches:
            for r in b.to_pylist():
                there = fs.get_file_info(f"{root}/{r['name']}")
                if there.type == pafs.FileType.NotFound or there.size != r["bytes"]:
                    fs.move(f"{root}/{r['temp']}", f"{root}/{r['name']}")
            yield b.select(["name"])

    manifest.mapInArrow(rename, "name string").write.format("noop").mode("overwrite").save()
    fs, root = filesystem(folder)
    totals = manifest.agg(F.count("*"), F.sum("records"), F.sum("bytes")).first()
    with fs.open_output_stream(f"{root}/MANIFEST.json.tmp") as out:
        out.write(b'{"files": [')
        for k, r in enumerate(manifest.orderBy("name").toLocalIterator()):  # a file's row at a time
            row = {x: r[x] for x in ("name", "records", "bytes", "sha256")}
            out.write((",\n" if k else "\n").encode() + json.dumps(row).encode())
        out.write(f'\n], "records": {totals[1] or 0}, "bytes": {totals[2] or 0}}}\n'.encode())
    fs.move(f"{root}/MANIFEST.json.tmp", f"{root}/MANIFEST.json")
    fs.delete_dir(f"{root}/_temporary")


def members(stream, chunk: int = 1 << 20) -> Iterator[bytes]:
    """The gzip members of a stream, one at a time."""
    d, out = zlib.decompressobj(31), []
    while data := stream.read(chunk):
        while data:
            out.append(d.decompress(data))
            data = b""
            if d.eof:
                yield b"".join(out)
                data, d, out = d.unused_data, zlib.decompressobj(31), []
    if any(out):
        raise ValueError("the archive ends within a record")


def parse(raw: bytes) -> dict:
    """A record's fields; raises ValueError if its length or a digest is wrong."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("not a WARC/1.1 record")
    h = dict(x.split(": ", 1) for x in lines[1:])
    block = rest[: int(h["Content-Length"])]
    if len(rest) != len(block) + 4 or h["WARC-Block-Digest"] != f"sha1:{sha1_32(block)}":
        raise ValueError(f"wrong length or digest: {h['WARC-Record-ID']}")
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:])["Content-Length"])
    digest = h["WARC-Payload-Digest"].removeprefix("sha1:")
    if h["WARC-Type"] == "response" and (digest != sha1_32(payload) or size != len(payload)):
        raise ValueError(f"wrong payload: {h['WARC-Record-ID']}")
    number = lambda k: int(h[k]) if k in h else None
    return {
        "id": number("X-Source-Id"), "payload_bytes": size, "payload_digest": digest, "record_type": h["WARC-Type"],
        "refers_to": number("X-Refers-To-Source-Id"), "url": None if h["WARC-Target-URI"] == "urn:none" else h["WARC-Target-URI"],
        "payload": payload if h["WARC-Type"] == "response" else None,
    }


def read_warc(manifest: DataFrame, folder: str, columns: tuple[str, ...] = tuple(c.split(" ")[0] for c in READ.split(", "))) -> DataFrame:
    """The records of the manifest's files, checked; a revisit's payload is null."""
    kinds = dict(c.split(" ") for c in READ.split(", "))
    arrow = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    schema = pa.schema([(c, arrow[kinds[c]]) for c in columns])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = filesystem(folder)
        for b in batches:
            for f in b.to_pylist():
                held, size, n = [], 0, 0
                with fs.open_input_stream(f"{root}/{f['name']}", compression=None) as stream:
                    for raw in members(stream):
                        held.append({c: v for c, v in parse(raw).items() if c in columns})
                        size, n = size + len(raw), n + 1
                        if size >= 16 << 20:
                            yield pa.RecordBatch.from_pylist(held, schema=schema)
                            held, size = [], 0
                if n != f["records"]:
                    raise ValueError(f"{f['name']} has {n} records, its manifest {f['records']}")
                yield pa.RecordBatch.from_pylist(held, schema=schema)

    tasks = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions")) * 4
    return manifest.select("name", "records").repartition(tasks).mapInArrow(run, ", ".join(f"{c} {kinds[c]}" for c in columns))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_path(spark, "warc")
    manifest = write_warc(table(spark, sf_dir, "pages"), folder)
    read = read_warc(manifest, folder, ("id", "payload_bytes", "payload_digest", "record_type", "refers_to"))
    return read.withColumnRenamed("id", "page_id")


OP2_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS x FROM pages),
b AS (SELECT x, max(page_id) AS best FROM p GROUP BY x),
f AS (SELECT page_id, strlen(h)::BIGINT AS payload_bytes, x, best FROM p JOIN b USING (x)),
bits AS (SELECT *, list_transform(range(0, 160, 5), lambda i: (
    ((('0x' || substr(x || '0000', (i // 8) * 2 + 1, 4))::BIGINT) >> (11 - i % 8)) & 31)) AS v FROM f)
SELECT page_id, payload_bytes, array_to_string(list_transform(v, lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', k::INT + 1, 1)), '') AS payload_digest,
  CASE WHEN page_id IS NOT DISTINCT FROM best THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM best THEN best END AS refers_to
FROM bits"""
