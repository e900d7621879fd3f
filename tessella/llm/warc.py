"""Writing pages as WARC archives in sorted shards, and reading them back.

Rows are dealt by ranges of page_id with bounds that depend on the rows alone, sorted within a
range, and written as gzip members, one a record. A file is closed when its compressed size
reaches roll_bytes. Headers, record ids and digests are made anew from the payload. Each run
writes into a folder of its own under temporary names that Spark's committer puts in place; a
file's name, number of records and digest come from the task that wrote it and are the folders
above it. The manifest lists them; renaming it is the commit, and only the run that it names is
read. What a stopped run has left is removed by the next one.

Of records with equal payloads of at least least_bytes, that with the largest page_id is a
response and the others are revisits that refer to it. Edge cases: a null html is an empty
payload; rows that repeat the largest page_id and payload are all responses; rows with a null
page_id are spread over the shards, sort first there and are never referred to by a page with an
id; many rows of one page_id are split by their payloads' digests; a null url has no target header;
a payload above roll_bytes is a file of its own, whole; columns other than page_id, url and html
are left out.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.ranges import bounds, place
from tessella.llm.runtime import Tables, ship, shuffle_width, work_folder

ROLL_BYTES = 4 << 20
PART_BYTES = 16 << 20  # of payload in a shard
LEAST_BYTES = 1000
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORDS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.sha1(f'{page_id}:{digest}'.encode()).digest()[:16], version=5)}>"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str) -> bytes:
    """One WARC record, uncompressed."""
    digest = hashlib.sha1(payload).hexdigest()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {record_id(page_id, digest)}", f"WARC-Date: {date}"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {quote(url, safe=chr(37) + '/:?#[]@!$&()*+,;=~-._' + chr(39))}")
    if page_id is not None:
        lines.append(f"Page-Id: {page_id}")
    if refers_to is not None:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to, digest)}", f"Page-Refers-To: {refers_to}"]
    lines += [f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Block-Digest: sha1:{hashlib.sha1(block).hexdigest()}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def packed(data: bytes, level: int) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def members(data: bytes, at_once: int = 1 << 16) -> Iterator[bytes]:
    """The gzip members of a file; zero bytes between or behind them are padding."""
    view, at = memoryview(data), 0
    while at < len(data):
        if view[at] == 0:
            at += 1
            continue
        z, out = zlib.decompressobj(31), []
        while not z.eof:
            if at >= len(data):
                raise ValueError("a file ends within a member")
            part = view[at : at + at_once]
            out.append(z.decompress(part))
            at += len(part) - len(z.unused_data)
        yield b"".join(out)


def parse(data: bytes) -> dict:
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    if fields["WARC-Block-Digest"] != f"sha1:{hashlib.sha1(block).hexdigest()}":
        raise ValueError(f"damaged record {fields['WARC-Record-ID']}")
    http, _, payload = block.partition(b"\r\n\r\n")
    response = fields["WARC-Type"] == "response"
    told = dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:])
    number = lambda k: int(fields[k]) if k in fields else None
    return {
        "page_id": number("Page-Id"),
        "url": fields.get("WARC-Target-URI"),
        "payload_bytes": len(payload) if response else int(told["Content-Length"]),
        "payload_digest": hashlib.sha1(payload).hexdigest() if response else fields["WARC-Payload-Digest"].removeprefix("sha1:"),
        "record_type": fields["WARC-Type"],
        "refers_to": number("Page-Refers-To"),
        "payload": payload if response else None,
    }


def write_archives(pages: DataFrame, folder: str, roll_bytes: int = ROLL_BYTES, least_bytes: int = LEAST_BYTES, level: int = 4, date: str = DATE, part_bytes: int = PART_BYTES) -> str:
    """Write page_id, url and html of pages into folder; returns the folder."""
    spark = pages.sparkSession
    ship(spark)
    fs, path = file_system(spark, folder)
    if fs.exists(path(f"{folder}/manifest")):
        raise FileExistsError(f"{folder} has a manifest already")
    for left in fs.globStatus(path(f"{folder}/*-run-*")) or []:
        fs.delete(left.getPath(), True)
    run_id = f"run-{uuid.uuid4().hex}"
    body = F.coalesce(F.col("html"), F.lit(""))
    pages = pages.select(F.col("page_id").cast("long"), "url", body.alias("html"), F.sha1(F.encode(body, "UTF-8")).alias("digest"))
    total = pages.agg(F.coalesce(F.sum(F.octet_length("html")), F.lit(0)).alias("n")).first()["n"]
    parts = max(shuffle_width(spark), -(-total // part_bytes))
    large = pages.where(F.octet_length("html") >= least_bytes).select("page_id", "digest")
    answer = large.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1").drop("n")
    tables = Tables(spark)
    answer = tables.keep(answer, "answers")  # a table, so that a payload with very many pages can be split in the join
    visits = large.join(answer, "digest").where("page_id IS NULL OR page_id < refers_to").where("refers_to IS NOT NULL").distinct()
    at = bounds(pages.select("page_id"), "page_id", parts)
    rows = pages.withColumn("kind", F.lit(1)).unionByName(visits.withColumn("kind", F.lit(0)), allowMissingColumns=True)
    low, high = place(F.col("page_id"), at, inclusive=False), place(F.col("page_id"), at)
    spread = F.xxhash64("digest")
    part = F.when(F.col("page_id").isNull(), F.pmod(spread, F.lit(len(at) + 1))).otherwise(low + F.pmod(spread, high - low + 1))
    rows = rows.withColumn("part", part.cast("int")).repartitionById(parts, F.col("part"))
    rows = rows.sortWithinPartitions("part", "page_id", "digest", "kind", "url")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tessella.llm.warc import packed, record

        out, size, shard, number, sees = [], 0, None, 0, (None, None, None)

        def closed() -> pa.RecordBatch:
            name, content = f"{shard:06d}-{number:06d}.warc.gz", b"".join(out)
            cells = {"name": name, "records": len(out), "sha256": hashlib.sha256(content).hexdigest(), "content": content}
            return pa.RecordBatch.from_arrays([pa.array([x]) for x in cells.values()], names=[*cells])

        for b in batches:
            for i in range(b.num_rows):
                part, page, digest = (b.column(c)[i].as_py() for c in ("part", "page_id", "digest"))
                if b.column("kind")[i].as_py() == 0:
                    sees = (page, digest, b.column("refers_to")[i].as_py())
                    continue
                if out and (size >= roll_bytes or part != shard):
                    yield closed()
                    number = number + 1 if part == shard else 0
                    out, size = [], 0
                elif part != shard:
                    number = 0
                shard = part
                refers = sees[2] if sees[:2] == (page, digest) else None
                out.append(packed(record(page, b.column("url")[i].as_py(), b.column("html")[i].as_py().encode(), refers, date), level))
                size += len(out[-1])
        if out:
            yield closed()

    files = rows.mapInArrow(run, "name string, records long, sha256 string, content binary")
    # A text row is written as its bytes are; the separator is a zero byte, which gzip takes as padding.
    data = f"{folder}/data-{run_id}"
    files.select(F.col("content").cast("string").alias("value"), "name", "records", "sha256").write.partitionBy("name", "records", "sha256").option("lineSep", "\0").text(data)
    tables.drop("answers")
    # Only names and lengths are looked at here.
    told = lambda k: F.regexp_extract("path", f"/{k}=([^/]*)/", 1)
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "part-*").load(data).select("path", "length")
    inside = F.substring_index("path", f"/data-{run_id}/", -1)
    rows = listed.select(told("name").alias("name"), F.concat(F.lit(f"data-{run_id}/"), inside).alias("file"), F.col("length").alias("bytes"), told("records").cast("long").alias("records"), told("sha256").alias("sha256"))
    rows.repartitionByRange("name").sortWithinPartitions("name").write.json(f"{folder}/manifest-{run_id}")
    if not fs.rename(path(f"{folder}/manifest-{run_id}"), path(f"{folder}/manifest")):
        raise OSError(f"{folder}/manifest can't be put in place")
    return folder


def file_system(spark: SparkSession, folder: str):
    """Hadoop's file system of a folder, and its class of paths."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    return path(folder).getFileSystem(spark._jsc.hadoopConfiguration()), path


def read_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """name, file, bytes (with one of padding), records and sha256 (of the bytes without padding) of each archive."""
    fs, path = file_system(spark, folder)
    if not fs.exists(path(f"{folder}/manifest")):
        raise FileNotFoundError(f"{folder} has no manifest")
    return spark.read.schema("name string, file string, bytes long, records long, sha256 string").json(f"{folder}/manifest")


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """The records of a folder that write_archives has committed.

    The files that are there are held against the manifest first (a job over names and lengths): a
    missing, foreign or shortened file raises, and so does, while reading, one whose digest or number
    of records isn't what its folder says.
    """
    ship(spark)
    manifest = read_manifest(spark, folder)
    first = manifest.select("file").first()
    run_id = first.file.split("/")[0] if first else None
    schema = spark.createDataFrame([], RECORDS).schema
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tessella.llm.warc import members, parse

        for b in batches:
            for file, content in zip(b.column("path"), b.column("content"), strict=True):
                rows, size, content = [], 0, content.as_py()
                if f"/sha256={hashlib.sha256(content[:-1]).hexdigest()}/" not in file.as_py():  # behind it lies one byte of padding
                    raise ValueError(f"damaged archive {file.as_py()}")
                told, n = int(file.as_py().split("/records=")[1].split("/")[0]), 0
                for m in members(content):
                    rows.append(parse(m))
                    size, n = size + len(m), n + 1
                    if size > 8 << 20:
                        yield batch(rows)
                        rows, size = [], 0
                if n != told:
                    raise ValueError(f"{file.as_py()} has {n} records, not {told}")
                yield batch(rows)

    kinds = {"page_id": pa.int64(), "url": pa.string(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "record_type": pa.string(), "refers_to": pa.int64(), "payload": pa.binary()}

    def batch(rows: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], kinds[n]) for n in names], names=names)

    if run_id is None:
        return spark.createDataFrame([], schema)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "part-*").load(f"{folder}/{run_id}")
    inside = F.concat(F.lit(f"{run_id}/"), F.substring_index("path", f"/{run_id}/", -1))
    there = files.select(inside.alias("file"), F.col("length").alias("here"))
    odd = manifest.select("file", "bytes").join(there, "file", "full_outer").where("bytes IS NULL OR here IS NULL OR bytes <> here").orderBy("file").first()
    if odd is not None:
        raise ValueError(f"{odd.file}: the manifest has {odd.bytes} bytes of it, the folder {odd.here}")
    return files.select("path", "content").mapInArrow(run, schema)


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written as archives and read back: what each record says of its payload."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return read_archives(spark, write_archives(pages, work_folder(spark, "warc"))).drop("payload", "url")


OP4_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
d AS (SELECT page_id, strlen(body)::BIGINT AS payload_bytes, sha1(body) AS payload_digest FROM p),
m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS top FROM d)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id < top THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id < top THEN top END AS refers_to
FROM m
"""
