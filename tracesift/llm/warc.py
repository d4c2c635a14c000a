"""WARC archives: a writer, and a reader that splits compressed archives.

Writing: every record is a gzip member of its own. Tasks build members in Python and Spark's text sink
writes them with its commit protocol, so retried tasks leave no doubles and any store that Spark writes to
will do: a row is a run of members, and the line separator is an empty member, which readers pass over.

Reading: an archive is cut into byte ranges, one row each, dealt anew. A task scans its range for the gzip
magic. At each hit it tries to decode a header: a member that starts with a WARC version line owns the
record; anything else is chance, or an empty member. A task owns the records that start inside its range, and
reads on past the end of it for the last one. Members are decoded as streams in small steps. The writer keeps the magic out of its
members; in other writers' archives, an uncompressed archive inside of a record could be taken for records.

Repeated payloads: of records with equal payloads of at least ``least`` bytes, the one with the smallest id
is a response and the others revisit it.

Defined cases: a null payload is empty; a null url is an empty one. Rows that repeat the id and the payload of a
response are responses too. Rows with a null id are responses and never referred to unless all
rows of a payload have null ids.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..shared import stored
from .common import text_batches

MAGIC = b"\x1f\x8b\x08"
#: A whole gzip member that decodes to nothing.
EMPTY_MEMBER = b"\x1f\x8b\x08\x00\x00\x00\x00\x00\x00\x03\x03\x00" + b"\x00" * 8
#: Bytes of an archive that one task scans, and bytes that it reads at a time.
SPLIT_BYTES, STEP_BYTES = 8 << 20, 1 << 18
#: Ranges that one task scans in a large archive.
RANGES_EACH = 16
#: Bytes of members in one row of the text sink.
ROW_BYTES = 4 << 20
_LEVEL = 4

RECORD = T.StructType([
    T.StructField("record_id", T.StringType()), T.StructField("record_type", T.StringType()), T.StructField("target_uri", T.StringType()),
    T.StructField("refers_to", T.StringType()), T.StructField("payload_digest", T.StringType()), T.StructField("payload_bytes", T.LongType()), T.StructField("block", T.BinaryType()),
    T.StructField("block_digest", T.StringType()), T.StructField("whole", T.BooleanType()),
])


def member(data: bytes) -> bytes:
    """A gzip member in which the magic occurs at its start only. Payloads that don't get shorter are stored as they are, archives
    among them; a block's end then parts each magic in them."""
    made = zlib.compressobj(_LEVEL, zlib.DEFLATED, 31)
    out = made.compress(data) + made.flush()
    if out.find(MAGIC, 1) < 0:
        return out
    made, parts, start = zlib.compressobj(_LEVEL, zlib.DEFLATED, 31), [], 0
    while (at := data.find(MAGIC, start)) >= 0:
        parts += [made.compress(data[start : at + 1]), made.flush(zlib.Z_FULL_FLUSH)]
        start = at + 1
    return b"".join([*parts, made.compress(data[start:]), made.flush()])


def record_bytes(kind: str, record_id: str, uri: str, refers_to: str | None, digest: str, payload_bytes: int, block: bytes) -> bytes:
    """A record's header, block and end marks."""
    lines = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{record_id}>", "WARC-Date: 2024-01-01T00:00:00Z", f"WARC-Target-URI: {_one_line(uri)}",
        f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {payload_bytes}",
        *([f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"] if kind == "revisit" else []),
        "Content-Type: text/html; charset=utf-8", f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _one_line(text: str) -> str:
    """Line feeds would end the header line."""
    return text.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A")


def _as_was(text: str) -> str:
    return text.replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%")


def with_revisits(df: DataFrame, id_col: str, payload_col: str, least: int = 0) -> DataFrame:
    """df with payload (binary), first_id and is_first: which row of equal payloads is the response."""
    payload = F.coalesce(F.col(payload_col), F.lit("")).cast("binary")
    rows = df.withColumn("payload", payload).withColumn("digest", F.sha1("payload"))
    # Payloads may repeat in a third of all rows: aggregate first, then join; Spark splits skewed keys of this join.
    first = rows.groupBy("digest").agg(F.min(id_col).alias("first_id"), F.count("*").alias("copies")).where("copies > 1")
    return rows.join(first, "digest", "left").withColumn("revisits", F.coalesce((F.col("copies") > 1) & (F.octet_length("payload") >= least) & ~F.col(id_col).eqNullSafe(F.col("first_id")), F.lit(False)))


def write_warc(df: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least: int = 0) -> None:
    """Writes a record per row into part files under path, a folder of any store that Spark writes to."""
    text_batches(df.sparkSession)
    rows = with_revisits(df.select(id_col, url_col, payload_col), id_col, payload_col, least)
    # A revisit carries no payload.
    rows = rows.select(
        F.col(id_col).cast("string").alias("id"), F.coalesce(F.col(url_col), F.lit("")).alias("url"), "revisits", F.col("first_id").cast("string").alias("first_id"),
        F.unhex("digest").alias("digest"), F.octet_length("payload").cast("long").alias("size"), F.when(~F.col("revisits"), F.col("payload")).alias("block"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made: list[bytes] = []
            size = 0
            for row in zip(*(c for c in batch.columns), strict=True):
                ident, url, revisits, first, digest, length, block = (v.as_py() for v in row)
                made.append(member(record_bytes("revisit" if revisits else "response", ident if ident is not None else "", url, first, base64.b32encode(digest).decode(), length, block or b"")))
                size += len(made[-1])
                if size >= ROW_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array([b"".join(made)], pa.binary())], names=["members"])
                    made, size = [], 0
            if made:
                yield pa.RecordBatch.from_arrays([pa.array([b"".join(made)], pa.binary())], names=["members"])

    members = rows.mapInArrow(run, T.StructType([T.StructField("members", T.BinaryType())]))
    members.select(F.col("members").cast("string").alias("value")).write.option("encoding", "ISO-8859-1").option("lineSep", EMPTY_MEMBER.decode("latin-1")).text(path)


class Stream:
    """Bytes of a file from a place on, read in steps; what lies behind is forgotten."""

    def __init__(self, file, start: int):
        self.file, self.base, self.data, self.ended = file, start, b"", False
        file.seek(start)

    def more(self) -> bool:
        got = self.file.read(STEP_BYTES)
        self.ended = not got
        self.data += got
        return bool(got)

    def forget(self, before: int) -> None:
        if before - self.base > STEP_BYTES:
            self.data, self.base = self.data[before - self.base :], before

    def find(self, start: int, end: int) -> int:
        """The next magic at start or later, and before end; or -1."""
        while True:
            at = self.data.find(MAGIC, max(start - self.base, 0))
            if at >= 0:
                return at + self.base if at + self.base < end else -1
            if self.base + len(self.data) - len(MAGIC) + 1 >= end or not self.more():
                return -1
            self.forget(self.base + max(0, len(self.data) - STEP_BYTES - len(MAGIC)))

    def member(self, start: int) -> tuple[bytes, int] | None:
        """What the member at start decodes to and where it ends, if it is one and begins like a record."""
        decoder, out, at = zlib.decompressobj(31), bytearray(), start
        while not decoder.eof:
            if at - self.base >= len(self.data) and not self.more():
                return None
            part = self.data[at - self.base : at - self.base + STEP_BYTES]
            try:
                out += decoder.decompress(part)
            except zlib.error:
                return None
            at += len(part)
            if len(out) >= 5 and not out.startswith(b"WARC/"):
                return None
        return bytes(out), at - len(decoder.unused_data)


def parse_record(data: bytes) -> dict | None:
    """A record's fields, or None for what isn't one."""
    head, mark, rest = data.partition(b"\r\n\r\n")
    if not mark or not head.startswith(b"WARC/"):
        return None
    fields = {}
    for line in head.split(b"\r\n")[1:]:
        name, _, value = line.partition(b":")
        fields[name.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
    try:
        size = int(fields.get("content-length", ""))
    except ValueError:
        return None
    ident = lambda s: s.removeprefix("<urn:page:").removesuffix(">") if s else None
    return {
        "record_id": ident(fields.get("warc-record-id")) or None, "record_type": fields.get("warc-type"), "target_uri": _as_was(fields.get("warc-target-uri", "")), "refers_to": ident(fields.get("warc-refers-to")),
        "payload_digest": fields.get("warc-payload-digest", "").removeprefix("sha1:") or None, "payload_bytes": int(fields["x-payload-length"]) if fields.get("x-payload-length", "").isdigit() else size, "block": rest[:size],
        "block_digest": base64.b32encode(hashlib.sha1(rest[:size]).digest()).decode(), "whole": len(rest) >= size,
    }


def scan_range(file, start: int, end: int) -> Iterator[dict]:
    """The records whose members start in the range."""
    stream, at = Stream(file, start), start
    while (at := stream.find(at, end)) >= 0:
        made = stream.member(at)
        record = made and parse_record(made[0])
        if record:
            yield record
            at = made[1]
        else:
            at += 1
        stream.forget(at)


def read_warc(spark, path: str, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """The records of all archives in a folder, in the columns of RECORD. Tasks open the files by the path's own
    file system, as pyarrow knows it (local folders, HDFS, S3, GCS)."""
    files = spark.read.format("binaryFile").load(path).select("path", "length")
    parts = files.select("path", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("length") - 1, F.lit(0)), F.lit(split_bytes).cast("long"))).alias("start"))
    # Rows of a few bytes stand for ranges of megabytes: a number of tasks is given, or they would be put together again.
    count = parts.count()
    tasks = max(1, min(count, max(4 * spark.sparkContext.defaultParallelism, count // RANGES_EACH)))
    parts = parts.withColumn("end", F.col("start") + split_bytes).repartition(tasks, "path", "start")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        kind = pa.schema([("record_id", pa.string()), ("record_type", pa.string()), ("target_uri", pa.string()), ("refers_to", pa.string()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("block", pa.binary()), ("block_digest", pa.string()), ("whole", pa.bool_())])
        for batch in batches:
            for uri, start, end in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                store, name = fs.FileSystem.from_uri(_full_uri(uri))
                with store.open_input_file(name) as file:
                    some, size = [], 0
                    for record in scan_range(file, start, end):
                        some.append(record)
                        size += len(record["block"])
                        if size >= ROW_BYTES:
                            yield pa.RecordBatch.from_pylist(some, kind)
                            some, size = [], 0
                    if some:
                        yield pa.RecordBatch.from_pylist(some, kind)

    return parts.mapInArrow(run, RECORD)


def checked_payloads(records: DataFrame) -> DataFrame:
    """record_id, record_type, refers_to, payload_bytes, payload_digest and sound, of what read_warc() gives.

    Length and digest are those of the block that was read: a response's own, a revisit's those of the response that it refers to. sound: the
    block is as long as its header says, length and digest are those that the record's header names, and a revisit's response is there.
    Revisits have null ones where no response of that id has a block of the digest that they name.
    """
    rows = stored(records.select("record_id", "record_type", "refers_to", "payload_bytes", "payload_digest", F.octet_length("block").cast("long").alias("own_bytes"), "block_digest", "whole"), "warc-records")
    fits = F.coalesce(F.col("whole") & (F.col("own_bytes") == F.col("payload_bytes")) & (F.col("block_digest") == F.col("payload_digest")), F.lit(False))
    own = rows.where("record_type is distinct from 'revisit'").withColumn("sound", fits)
    # A response may have very many revisits: they aren't grouped, and Spark splits skewed keys of this join.
    response = own.where("record_id is not null").groupBy(F.col("record_id").alias("refers_to"), F.col("block_digest").alias("payload_digest")).agg(F.max("own_bytes").alias("of_bytes"), F.bool_or("sound").alias("of_sound"), F.lit(True).alias("found"))
    named = rows.where("record_type = 'revisit'").drop("block_digest").join(response, ["refers_to", "payload_digest"], "left")
    revisits = named.withColumn("of_digest", F.when(F.col("found"), F.col("payload_digest"))).withColumn("sound", F.coalesce(F.col("of_sound") & F.col("whole") & (F.col("own_bytes") == 0) & (F.col("of_bytes") == F.col("payload_bytes")), F.lit(False)))
    columns = lambda size, digest: ("record_id", "record_type", "refers_to", F.col(size).alias("payload_bytes"), F.col(digest).alias("payload_digest"), "sound")
    return own.select(*columns("own_bytes", "block_digest")).unionByName(revisits.select(*columns("of_bytes", "of_digest")))


def _full_uri(uri: str) -> str:
    """Hadoop writes file:/x for file:///x, and has names of its own for S3."""
    if uri.startswith("file:/") and not uri.startswith("file://"):
        return "file://" + uri[5:]
    scheme, mark, rest = uri.partition("://")
    return f"s3://{rest}" if mark and scheme in ("s3a", "s3n") else uri
