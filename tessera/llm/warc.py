"""WARC archives: a writer that records repeated payloads as revisits, and a splittable reader.

Each record is a gzip member of its own. A reading task owns a byte range of a file: it scans the
range for the gzip magic, decodes each candidate and accepts it only if a whole, consistent record
comes out, then goes on behind it. A record belongs to the task in whose range its first byte lies,
so that files of any size split into ranges of a fixed size without an index.

Archives are read and written through pyarrow.fs, which reaches local folders, HDFS and the object
stores. Each attempt of a writing task has file names of its own, and the writer returns a table of
the files of those attempts that Spark committed; only these are read back, so that what a lost or
second attempt left in the folder never counts.

Edge cases: a null payload is an empty one; a null url leaves out the target, a null id the record
id; rows that repeat an id and a payload are all the response, as they share the largest id; a very
long payload is one member, read beyond the end of its range; an empty table gives no archives and
no rows; line breaks in a url are percent-encoded; other columns of the input are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator
from functools import partial
from itertools import chain

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import OWN, keyed, look_up, sliced
from tessera.shared import materialize, shared_path

#: Payloads shorter than this are always stored.
LEAST_REVISIT = 1000
#: A writing task starts another file beyond this many bytes.
FILE_BYTES = 256 << 20
#: Bytes that one reading task scans.
RANGE_BYTES = 16 << 20
MAGIC = b"\x1f\x8b\x08"
#: Bytes that are decoded at once: enough to tell a record from other data.
CHUNK = 16 << 10
#: Further bytes to fetch for a record that crosses the end of its range.
TAIL_BYTES = 1 << 20
ID, DATE = "<urn:page:%d>", "1970-01-01T00:00:00Z"
WRITTEN = "path string, records long, bytes long"
READ = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, digest_ok boolean, offset long, path string"


def with_revisits(pages: DataFrame, least: int = LEAST_REVISIT) -> DataFrame:
    """page_id, url, payload, digest and refers_to (null: a response) of each page.

    Only ids and digests of the long payloads are shuffled; the pages stay where they stand.
    """
    key = f"{OWN}row"
    payload = F.coalesce(F.col("html").cast("binary"), F.lit(b""))
    rows = keyed(pages).select(key, F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    long = materialize(rows.where(F.octet_length("payload") >= least).select(key, "page_id", F.sha1("payload").alias("digest")), "long")
    # Written apart, so that both sides of the join below are plain exchanges and a hot digest can be split.
    repeated = materialize(long.groupBy("digest").agg(F.max("page_id").alias("response"), F.count(F.lit(1)).alias("n")).where("n > 1").select("digest", "response"), "repeated")
    revisits = long.join(repeated, "digest").where(~F.col("response").eqNullSafe(F.col("page_id"))).select(key, F.col("response").alias("value"))
    return look_up(rows, revisits, "refers_to").select("page_id", "url", "payload", F.sha1("payload").alias("digest"), "refers_to")


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One record, uncompressed. A revisit keeps the HTTP head, and so the payload's length, without the payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}"]
    if page_id is not None:
        head.append(f"WARC-Record-ID: {ID % page_id}")
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    head += [f"WARC-Date: {DATE}", "WARC-Payload-Digest: sha1:" + base64.b32encode(bytes.fromhex(digest)).decode()]
    if refers_to is not None:
        head += [f"WARC-Refers-To: {ID % refers_to}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def gzip_member(data: bytes, level: int = 4) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def _write(batches: Iterator[pa.RecordBatch], folder: str, file_bytes: int) -> Iterator[pa.RecordBatch]:
    task = TaskContext.get()
    fs, root = pafs.FileSystem.from_uri(folder)
    fs.create_dir(root, recursive=True)
    done: list[tuple[str, int, int]] = []
    out, name, records, size = None, "", 0, 0

    def finish() -> None:
        nonlocal out
        if out is not None:
            out.close()
            done.append((f"{folder}/{name}", records, size))
            out = None

    for batch in sliced(batches):
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if out is None:
                # An attempt's number is its own in the whole application.
                name, records, size = f"part-{task.partitionId():06d}-{len(done):04d}-{task.taskAttemptId()}.warc.gz", 0, 0
                out = fs.open_output_stream(f"{root}/{name}", compression=None)  # members are compressed each
            member = gzip_member(record(*row))
            out.write(member)
            records, size = records + 1, size + len(member)
            if size >= file_bytes:
                finish()
    finish()
    yield pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int64()))], names=["path", "records", "bytes"])


def write(rows: DataFrame, folder: str, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write with_revisits() rows as archives below folder; returns the files that count, with records and bytes."""
    ordered = rows.select("page_id", "url", "payload", "digest", "refers_to")
    return materialize(ordered.mapInArrow(partial(_write, folder=folder, file_bytes=file_bytes), WRITTEN), "warc-files")


def archives(spark: SparkSession, folder: str) -> DataFrame:
    """path and bytes of the archives below a folder that something else wrote."""
    try:
        found = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").option("recursiveFileLookup", "true").load(folder)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], "path string, bytes long")
    return found.select("path", F.col("length").alias("bytes"))


def parse(data: bytes) -> tuple[dict[str, str], bytes] | None:
    """Header fields (lower-case names) and block of one whole record; None if it isn't one."""
    end = data.find(b"\r\n\r\n")
    if not data.startswith(b"WARC/1.") or end < 0:
        return None
    lines = data[:end].decode("utf-8", "replace").split("\r\n")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    length = fields.get("content-length", "")
    if not length.isdigit() or "warc-type" not in fields or len(data) != end + 8 + int(length) or not data.endswith(b"\r\n\r\n"):
        return None
    return fields, data[end + 4 : -4]


def decode_at(data: bytes, at: int, more: Iterator[bytes]) -> tuple[dict[str, str], bytes, int] | None:
    """The record whose gzip member starts at data[at], and how many bytes the member takes.

    more yields what follows data; only a little is decoded before the candidate must look like a record.
    """
    z, parts, size, used = zlib.decompressobj(31), [], 0, 0
    try:
        view = memoryview(data)
        for chunk in chain((view[k : k + CHUNK] for k in range(at, len(data), CHUNK)), more):
            used += len(chunk)
            parts.append(z.decompress(chunk))
            size += len(parts[-1])
            if size >= 7 and not b"".join(parts[:8])[:7] == b"WARC/1.":
                return None
            if z.eof:
                break
        else:
            return None
    except zlib.error:
        return None
    found = parse(b"".join(parts))
    return found and (*found, used - len(z.unused_data))


def scan(path: str, start: int, end: int, size: int) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """Offset, header fields and block of each record that starts in [start, end) of the file."""
    fs, name = pafs.FileSystem.from_uri(path)
    with fs.open_input_file(name) as file:
        data = file.read_at(min(end + len(MAGIC) - 1, size) - start, start)

        def following() -> Iterator[bytes]:
            at = start + len(data)
            while at < size:
                chunk = file.read_at(min(TAIL_BYTES, size - at), at)
                at += len(chunk)
                yield chunk

        at = data.find(MAGIC)
        while 0 <= at < end - start:
            if found := decode_at(data, at, following()):
                yield start + at, found[0], found[1]
                at = data.find(MAGIC, at + found[2])
            else:
                at = data.find(MAGIC, at + 1)


def _number(urn: str | None) -> int | None:
    return int(urn.rpartition(":")[2].rstrip(">")) if urn and urn.startswith("<urn:page:") else None


def _read(batches: Iterator[pa.RecordBatch], types: pa.Schema) -> Iterator[pa.RecordBatch]:
    def rows() -> Iterator[tuple]:
        for batch in sliced(batches):
            for path, start, end, size in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for offset, fields, block in scan(path, start, end, size):
                    http, _, payload = block.partition(b"\r\n\r\n")
                    kind = fields["warc-type"]
                    told = fields.get("warc-payload-digest", "").removeprefix("sha1:")
                    digest = base64.b32decode(told).hex() if told else None
                    length = next((int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")), 0)
                    ok = True
                    if kind == "response":
                        own = hashlib.sha1(payload).hexdigest()
                        ok, digest, length = own == digest and length == len(payload), own, len(payload)
                    yield _number(fields.get("warc-record-id")), fields.get("warc-target-uri"), kind, _number(fields.get("warc-refers-to")), length, digest, ok, offset, path

    def batch(held: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in held], f.type) for i, f in enumerate(types)], schema=types)

    held: list[tuple] = []
    for row in rows():
        held.append(row)
        if len(held) == 4096:
            yield batch(held)
            held = []
    yield batch(held)


def ranges(files: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """path, start, end and size of each byte range of files (path, bytes)."""
    starts = F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("size") - 1, F.lit(0)), F.lit(range_bytes).cast("long")))
    sized = files.select("path", F.col("bytes").alias("size")).where("size > 0").select("path", "size", starts.alias("start"))
    return sized.select("path", "start", F.least(F.col("start") + range_bytes, "size").alias("end"), "size")


def read(files: DataFrame, range_bytes: int = RANGE_BYTES, tasks: int | None = None) -> DataFrame:
    """A row for each record of files (path, bytes): those that write() returned, or archives().

    payload_bytes and payload_digest are those of the full payload, for revisits as the record tells
    them; digest_ok says whether a response's payload has the digest and length told.
    """
    types = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("digest_ok", pa.bool_()), ("offset", pa.int64()), ("path", pa.string())])
    spread = ranges(files, range_bytes).repartition(tasks or 4 * files.sparkSession.sparkContext.defaultParallelism, "path", "start")
    return spread.mapInArrow(partial(_read, types=types), READ)


def round_trip(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Write pages as archives and read them back."""
    return read(write(with_revisits(pages), folder or shared_path(pages.sparkSession, "warc")))
