"""Deterministic sharded WARC files.

Records are range-sorted by page_id; each range writes its files in order and rolls to the next file once the
compressed size reaches the limit. Headers and digests are made anew from the payload. Files appear under temporary
names and get their own names when complete; the manifest, a table of the committed files with sizes and digests, is
written last and is what readers go by. The same pages give the same files, byte for byte, for the same ranges.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import work_path
from .files import Pending, chunks

ROLL_BYTES = 256 << 20
LEAST_REVISIT = 100
LEVEL = 5
DATE = "2000-01-01T00:00:00Z"
#: Fixed value: the profile that the format's standard gives for revisits of an equal payload.
PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
MANIFEST = "file string, part int, roll int, records long, bytes long, sha256 string, first_page long, last_page long"
RECORDS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, file string"
CONTROLS = re.compile(r"[\x00-\x20\x7f]")


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{digest}')}>"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str = DATE) -> bytes:
    """One uncompressed record; with refers_to a revisit, which has no payload of its own."""
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    if refers_to is None:
        block += payload
    target = CONTROLS.sub(lambda m: f"%{ord(m[0]):02X}", url) if url else f"urn:page:{page_id}"
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {record_id(page_id, digest)}",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {target}",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}",
    ]
    if refers_to is not None:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to, digest)}", f"X-Refers-To-Page: {refers_to}"]
    lines += [f"X-Page-Id: {'' if page_id is None else page_id}", f"X-Payload-Length: {len(payload)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block + b"\r\n\r\n"


def member(data: bytes, level: int = LEVEL) -> bytes:
    """A gzip member without time or name."""
    press = zlib.compressobj(level, zlib.DEFLATED, 31)
    return press.compress(data) + press.flush()


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (lower-case names) and block of a record; checks the block's length and digest."""
    head, _, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    headers = {k.lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}
    block = rest[: int(headers["content-length"])]
    if version != "WARC/1.1" or rest[len(block) :] != b"\r\n\r\n" or headers["warc-block-digest"] != f"sha256:{hashlib.sha256(block).hexdigest()}":
        raise ValueError(f"damaged record {headers.get('warc-record-id')}")
    return headers, block


def members(data: Iterator[bytes]) -> Iterator[bytes]:
    """Decompressed gzip members of a stream, one at a time."""
    press, parts = zlib.decompressobj(31), []
    for chunk in data:
        while chunk:
            parts.append(press.decompress(chunk))
            chunk = press.unused_data
            if press.eof:
                yield b"".join(parts)
                press, parts = zlib.decompressobj(31), []
    if any(parts):
        raise ValueError("the file ends inside a record")


def write_warc(pages: DataFrame, folder: str, roll_bytes: int = ROLL_BYTES, least_revisit: int = LEAST_REVISIT) -> DataFrame:
    """Writes pages (page_id, url, html) to folder and returns the manifest.

    Of records with equal payloads of least_revisit bytes or more, that with the smallest page_id is a response and
    the others are revisits of it. Null html is an empty payload. Rows with equal page_id and html that are the
    smallest are each a response. A null page_id comes first and is referred to by none. No rows give no files and an
    empty manifest; other columns are ignored.
    """
    spark = pages.sparkSession
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload"))
    keys = rows.where(F.octet_length("payload") >= least_revisit).select("page_id", F.sha2("payload", 256).alias("digest"))
    least = keys.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("copies")).where("copies > 1 and first is not null")
    marks = keys.join(least.select("digest", "first"), "digest").where(~F.col("page_id").eqNullSafe(F.col("first"))).select("page_id", "digest", "first").distinct()
    marks.write.parquet(f"{folder}/revisits")
    marks = spark.read.schema(marks.schema).parquet(f"{folder}/revisits")
    both = rows.select("page_id", "url", "payload", F.lit(None).cast("string").alias("digest"), F.lit(None).cast("long").alias("first")).unionAll(
        marks.select("page_id", F.lit(None).cast("string"), F.lit(None).cast("binary"), "digest", "first")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, roll, done = TaskContext.get().partitionId(), 0, []
        file: Pending | None = None
        page: object = object()
        refers: dict[str, int] = {}
        count, first, last, sha = 0, None, None, hashlib.sha256()

        def close() -> None:
            nonlocal file, roll, count, sha
            file.commit()
            done.append((file.name, part, roll, count, file.size, sha.hexdigest(), first, last))
            file, roll, count, sha = None, roll + 1, 0, hashlib.sha256()

        try:
            for batch in batches:
                for k in range(batch.num_rows):
                    page_id, digest = batch["page_id"][k].as_py(), batch["digest"][k].as_py()
                    if page_id != page:
                        page, refers = page_id, {}
                    if digest is not None:
                        refers[digest] = batch["first"][k].as_py()
                        continue
                    payload = batch["payload"][k].as_py()
                    digest = hashlib.sha256(payload).hexdigest()
                    data = member(record(page_id, batch["url"][k].as_py(), payload, digest, refers.get(digest)))
                    if file is None:
                        file, first = Pending(folder, f"part-{part:05d}-{roll:04d}.warc.gz"), page_id
                    file.write(data)
                    sha.update(data)
                    count, last = count + 1, page_id
                    if file.size >= roll_bytes:
                        close()
            if file is not None:
                close()
        except BaseException:
            if file is not None:
                file.drop()
            raise
        if done:
            kinds = (pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in done], t) for k, t in enumerate(kinds)], names=[x.split(" ")[0] for x in MANIFEST.split(", ")])

    dealt = both.repartitionByRange("page_id").sortWithinPartitions("page_id", F.col("first").isNull(), "url", "payload")
    dealt.mapInArrow(run, MANIFEST).write.parquet(f"{folder}/manifest")
    return read_manifest(spark, folder)


def read_manifest(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")


def read_warc(spark: SparkSession, folder: str, payloads: bool = False) -> DataFrame:
    """Records of the files in the manifest; a response's payload is checked against its digest. With payloads also the payload (null for a revisit)."""
    schema = RECORDS + ", payload binary" * payloads

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary())[: 7 + payloads]
        names = [x.split(" ")[0] for x in schema.split(", ")]

        def out(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in rows], t) for k, t in enumerate(kinds)], names=names)

        for batch in batches:
            for name in batch["file"].to_pylist():
                rows, held = [], 0
                for data in members(chunks(folder, name)):
                    headers, block = parse(data)
                    digest, length = headers["warc-payload-digest"].removeprefix("sha256:"), int(headers["x-payload-length"])
                    payload = block.partition(b"\r\n\r\n")[2] if headers["warc-type"] == "response" else None
                    if payload is not None and (len(payload) != length or hashlib.sha256(payload).hexdigest() != digest):
                        raise ValueError(f"damaged payload in {name}")
                    page, refers = headers["x-page-id"], headers.get("x-refers-to-page")
                    rows.append((int(page) if page else None, headers["warc-target-uri"], length, digest, headers["warc-type"], int(refers) if refers else None, name, payload)[: 7 + payloads])
                    held += length * payloads + 300
                    if held > 4 << 20:
                        yield out(rows)
                        rows, held = [], 0
                if rows:
                    yield out(rows)

    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))  # a number keeps the few small rows of names in as many tasks
    return read_manifest(spark, folder).select("file").repartition(tasks, "file").mapInArrow(run, schema)


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = work_path(spark, "warc")
    write_warc(spark.read.parquet(f"{sf_dir}/pages.parquet"), folder)
    return read_warc(spark, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP3_SQL = """
WITH t AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS n, sha256(coalesce(html, '')) AS h FROM pages),
f AS (SELECT h, min(page_id) AS first FROM t WHERE n >= 100 GROUP BY h)
SELECT page_id, n AS payload_bytes, t.h AS payload_digest,
  CASE WHEN first IS NULL OR page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to
FROM t LEFT JOIN f ON t.h = f.h AND t.n >= 100
"""
