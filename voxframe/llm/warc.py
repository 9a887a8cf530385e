"""WARC archives: a writer with revisit records and a splittable reader.

``write`` makes one gzip member per record. Of records with equal payloads of at
least ``min_bytes`` the one with the smallest id is a response, the others
revisit it. Tasks write under a hidden name and rename at the end; names hold the attempt, and
only archives of attempts that counted are listed, so a lost executor or a
second attempt leaves nothing half written to be read.

``read`` cuts the archives into byte ranges. A task looks for the gzip magic in
its range, takes a place as a member only if the header there inflates to a WARC
version line, and owns every record that starts inside its range; the last one
may end beyond it. No index is needed and no file is read twice.

Files are reached by pyarrow's file systems under the folder the cluster names
in ``spark.checkpoint.dir``.

Defined results: a null html is an empty payload; empty tables make no archive
and read as no rows; rows without id are written with an empty id and read back
as null, and never stand for others; repeated rows are records each (rows that
repeat the response's id are responses, too). Other columns are ignored.
"""

import sys
import uuid
import zlib

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext, cloudpickle
from pyspark.sql import functions as F

from voxframe.session import bound_batches, scratch_dir

cloudpickle.register_pickle_by_value(sys.modules[__name__])

MIN_BYTES = 100
ARCHIVE_BYTES = 64 << 20
SPLIT_BYTES = 4 << 20
READ_BYTES = 1 << 20
# Fixed values of the formats: gzip magic with the deflate method, version line.
MAGIC = b"\x1f\x8b\x08"
VERSION = b"WARC/1.1\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def filesystem(path):
    return pafs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def with_roles(pages, min_bytes=MIN_BYTES):
    """Add payload_bytes, digest, refers_to (null for responses).

    The html does not take part in finding the roles; only ids and digests of
    payloads that occur more than once are joined, so one payload that a third
    of all pages share is a row of counts, then a join Spark can split.
    """
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select(
        F.col("page_id").cast("long"),
        "url",
        payload.alias("payload"),
        F.octet_length(payload).cast("long").alias("payload_bytes"),
        F.sha2(payload, 256).alias("digest"),
    )
    keys = rows.filter((F.col("payload_bytes") >= min_bytes) & F.col("page_id").isNotNull()).select("page_id", "digest")
    groups = (
        keys.groupBy("digest").agg(F.min("page_id").alias("response"), F.max("page_id").alias("last"))
        .filter("response < last")
        .select("digest", "response")
        .checkpoint()
    )
    revisits = (
        keys.join(groups, "digest").filter("page_id > response").distinct()
        .select(F.col("page_id").alias("r_id"), F.col("digest").alias("r_digest"), F.col("response").alias("refers_to"))
    )
    joined = rows.join(revisits, (F.col("page_id") == F.col("r_id")) & (F.col("digest") == F.col("r_digest")), "left")
    return joined.select("page_id", "url", "payload", "payload_bytes", "digest", "refers_to")


def record(row, stamp):
    """Bytes of one record, a gzip member of its own."""
    revisit = row["refers_to"] is not None
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    block = http if revisit else http + row["payload"]
    page = "" if row["page_id"] is None else row["page_id"]
    head = [
        "WARC-Type: " + ("revisit" if revisit else "response"),
        f"WARC-Record-ID: <urn:page:{page}>",
        f"WARC-Date: {stamp}",
        "WARC-Target-URI: " + "".join(c for c in (row["url"] or "") if c not in "\r\n"),
        f"WARC-Payload-Digest: sha256:{row['digest']}",
        f"X-Payload-Length: {row['payload_bytes']}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{row['refers_to']}>"]
    content = VERSION + "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(content) + packer.flush()


def write(spark, pages, folder, min_bytes=MIN_BYTES, stamp="2000-01-01T00:00:00Z"):
    """Write archives below ``folder``; returns (file, size) of each."""

    def run(batches):
        task = TaskContext.get()
        fs, root = filesystem(folder)
        fs.create_dir(root, recursive=True)
        made, number, out, size, temporary = [], 0, None, 0, None

        def close():
            out.close()
            final = f"{root}/part-{task.partitionId():06d}-{task.taskAttemptId()}-{number:04d}.warc.gz"
            fs.move(temporary, final)
            made.append((final, size))

        for batch in batches:
            for i in range(batch.num_rows):
                if out is None:
                    temporary, size = f"{root}/.{uuid.uuid4().hex}-{task.taskAttemptId()}", 0
                    out = fs.open_output_stream(temporary)
                member = record(batch.slice(i, 1).to_pylist()[0], stamp)
                out.write(member)
                size += len(member)
                if size >= ARCHIVE_BYTES:
                    close()
                    out, number = None, number + 1
        if out is not None:
            close()
        yield pa.RecordBatch.from_arrays(
            [pa.array([f for f, _ in made], pa.string()), pa.array([s for _, s in made], pa.int64())], names=["file", "size"]
        )

    # Written once: the table of files is kept, and with it the files.
    return with_roles(pages, min_bytes).mapInArrow(run, "file string, size long").checkpoint()


class _Window:
    """Bytes of a file from ``start`` on, read forwards in steps."""

    def __init__(self, stream, start, size):
        self.stream, self.base, self.size, self.data = stream, start, size, b""

    def get(self, at, n):
        """Up to ``n`` bytes from the absolute place ``at``."""
        while self.base + len(self.data) < min(at + n, self.size):
            self.data += self.stream.read_at(min(READ_BYTES, self.size - self.base - len(self.data)), self.base + len(self.data))
        return self.data[at - self.base : at - self.base + n]

    def forget(self, at):
        if at - self.base > 4 * READ_BYTES:
            self.data, self.base = self.data[at - self.base :], at


def _starts_record(window, at):
    """Whether a gzip member whose content starts like a WARC record lies at ``at``."""
    unpack = zlib.decompressobj(31)
    try:
        head = unpack.decompress(window.get(at, 512), len(VERSION))
    except zlib.error:
        return False
    return head == VERSION


def members(stream, size, start, end):
    """Contents of the records that start in [start, end)."""
    window, at = _Window(stream, start, size), start
    while at < min(end, size):
        # Search for a member that starts inside the range.
        while True:
            chunk = window.get(at, READ_BYTES)
            hit = chunk.find(MAGIC)
            if hit >= 0 and at + hit < end:
                if _starts_record(window, at + hit):
                    at += hit
                    break
                at += hit + 1
            elif hit >= 0 or at + len(chunk) >= min(end, size) or len(chunk) < len(MAGIC):
                return
            else:
                at += len(chunk) - len(MAGIC) + 1
            window.forget(at)
        # Inflate this member and those that follow it directly.
        while at < min(end, size) and _starts_record(window, at):
            unpack, content, place = zlib.decompressobj(31), [], at
            while not unpack.eof:
                chunk = window.get(place, READ_BYTES)
                if not chunk:
                    raise ValueError("an archive ends inside a record")
                content.append(unpack.decompress(chunk))
                place += len(chunk) - len(unpack.unused_data)
                window.forget(place)
            at = place
            yield b"".join(content)


def parse(content):
    """Header fields (lower case) and block of a record."""
    head, block = content.split(b"\r\n\r\n", 1)
    lines = head.decode("utf-8").split("\r\n")
    fields = {}
    for line in lines[1:]:
        name, _, value = line.partition(":")
        fields[name.strip().lower()] = value.strip()
    return fields, block[: int(fields["content-length"])]


def _page(urn):
    value = urn[len("<urn:page:") : -1] if urn else ""
    return int(value) if value else None


RECORD = "page_id long, url string, record_type string, refers_to long, stored_bytes long, stored_digest string, payload binary"


def read(archives, split_bytes=SPLIT_BYTES):
    """Records of the archives (file, size), read by byte ranges."""
    starts = F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(split_bytes).cast("long"))).alias("start")
    ranges = archives.filter("size > 0").select("file", "size", starts)
    n = max(1, int(archives.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def run(batches):
        for batch in batches:
            for task in batch.to_pylist():
                rows, held = [], 0
                fs, path = filesystem(task["file"])
                with fs.open_input_file(path) as stream:
                    for content in members(stream, task["size"], task["start"], task["start"] + split_bytes):
                        fields, block = parse(content)
                        revisit = fields["warc-type"] == "revisit"
                        payload = None if revisit else block.split(b"\r\n\r\n", 1)[1]
                        rows.append(
                            {
                                "page_id": _page(fields["warc-record-id"]),
                                "url": fields["warc-target-uri"],
                                "record_type": fields["warc-type"],
                                "refers_to": _page(fields.get("warc-refers-to")),
                                "stored_bytes": int(fields["x-payload-length"]),
                                "stored_digest": fields["warc-payload-digest"].removeprefix("sha256:"),
                                "payload": payload,
                            }
                        )
                        held += len(content)
                        if held > 4 * READ_BYTES:
                            yield _batch(rows)
                            rows, held = [], 0
                yield _batch(rows)

    return ranges.repartition(n, "file", "start").mapInArrow(run, RECORD)


def _batch(rows):
    kinds = dict(page_id=pa.int64(), url=pa.string(), record_type=pa.string(), refers_to=pa.int64(), stored_bytes=pa.int64(), stored_digest=pa.string(), payload=pa.binary())
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in kinds.items()], names=list(kinds))


def round_trip(spark, pages):
    """Write, read back, and describe each record by its full payload.

    Responses are measured on the payload that was read; revisits hold none, so
    their size and digest come from their headers.
    """
    bound_batches(spark)
    folder = scratch_dir(spark, "warc")
    records = read(write(spark, pages, folder))
    stored = F.col("record_type") == "revisit"
    return records.select(
        "page_id",
        F.when(stored, F.col("stored_bytes")).otherwise(F.octet_length("payload").cast("long")).alias("payload_bytes"),
        F.when(stored, F.col("stored_digest")).otherwise(F.sha2("payload", 256)).alias("payload_digest"),
        "record_type",
        "refers_to",
    )
