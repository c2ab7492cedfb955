"""WARC archives: written by Spark's own file writer, read record by record.

*Writing.*  A record is one gzip member.  Payloads are known by their SHA-1
digests: of equal payloads the record with the smallest id is a ``response``,
every other one a ``revisit`` that refers to it and holds the HTTP header
only.  Digests are formed where the rows lie; which id comes first is a
grouped minimum of (digest, id), and only digests that repeat are joined back.
The members go through Spark's text sink, so archives are committed like any
other output, on whatever file system the folder is, and a task that runs
twice leaves one archive.  That sink ends every row with a separator; a
member's last byte is the high byte of its length, zero below 16 MB, and
serves as one.  (From 16 MB on a member without content follows, which ends
with a zero as well; readers see no record in it.)  Each archive starts with
a ``warcinfo`` record and holds about ``archive_bytes`` of payload, so that a
reading task's memory is bounded.  Record ids and dates are functions of the
row: writing twice gives the same records.

*Reading.*  An archive is read from its first byte to its last: chunks go
through an incremental zlib object until a member ends, which is one record;
its header lines are parsed, ``Content-Length`` frames the block, and block
and payload digests are computed again and compared.  A record that is
damaged becomes a row with an ``error`` and no payload, and reading resumes
at the next member.

Defined results: a null payload is an empty one; a null id is written without
an id field and read back as null (and refers to, or is referred to, like any
other, being larger than all ids); rows that repeat an id and a payload are
records each, the smallest by id is one of them and only that one is a
response; a null url becomes ``urn:record:<digest>``; control characters and
blanks in urls are percent-encoded; an empty table gives no records.  Other
columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import cut_lineage, ensure_checkpoint_dir
from .documents import NO_ID

VERSION = b"WARC/1.1"
#: Fixed values of the format.
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"
#: Payload bytes of an archive, on average.
ARCHIVE_BYTES = 32 << 20
#: Bytes fed to the decompressor at a time.
CHUNK = 1 << 16
_SEPARATOR = "\0"
_NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")

RECORD = ("record_key long, record_type string, refers_to long, uri string, payload binary, payload_bytes long, "
          "payload_digest string, error string")


def digest(data: bytes) -> str:
    """Bare upper-case base32 of a SHA-1."""
    return base64.b32encode(hashlib.sha1(data).digest()).decode("ascii")


# -- one record --------------------------------------------------------------

def record_id(key: int | None, payload_digest: str, turn: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(_NAMESPACE, f'{key}/{payload_digest}/{turn}')}>"


def clean_uri(url: str | None, payload_digest: str) -> str:
    if not url:
        return f"urn:record:{payload_digest}"
    return re.sub(r"[\x00-\x20\x7f-\x9f  ]", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), url)


def frame(fields: list[tuple[str, str]], block: bytes) -> bytes:
    """A record: version, fields, block."""
    fields = [*fields, ("WARC-Block-Digest", "sha1:" + digest(block)), ("Content-Length", str(len(block)))]
    head = b"".join(f"{k}: {v}\r\n".encode() for k, v in fields)
    return VERSION + b"\r\n" + head + b"\r\n" + block + b"\r\n\r\n"


def member(record: bytes, level: int = 6) -> bytes:
    """One gzip member, without time or name; its last byte is zero."""
    out = _gzip(record, level)
    return out if out[-1] == 0 else out + _gzip(b"", level)


def _gzip(data: bytes, level: int) -> bytes:
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def content_record(key: int, uri: str, payload: bytes, payload_digest: str, first: int | None,
                   is_revisit: bool, turn: int, content_type: str) -> bytes:
    """Record of a row; ``first`` is the key of the row that a revisit refers
    to (keys from ``NO_ID`` on stand for rows without an id)."""
    fields = [("WARC-Type", "revisit" if is_revisit else "response"),
              ("WARC-Record-ID", record_id(key, payload_digest, turn)), ("WARC-Date", DATE),
              ("WARC-Target-URI", uri), ("WARC-Payload-Digest", "sha1:" + payload_digest)]
    if key < NO_ID:
        fields.append(("X-Record-Key", str(key)))
    if is_revisit:
        fields += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", record_id(first, payload_digest, 0))]
        if first < NO_ID:
            fields.append(("X-Refers-To-Key", str(first)))
    fields.append(("Content-Type", "application/http;msgtype=response"))
    http = f"HTTP/1.1 200 OK\r\nContent-Type: {content_type}\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    return frame(fields, http if is_revisit else http + payload)


def info_record() -> bytes:
    block = b"software: archive writer\r\nformat: WARC File Format 1.1\r\n"
    return frame([("WARC-Type", "warcinfo"), ("WARC-Record-ID", record_id(None, "info", 0)), ("WARC-Date", DATE),
                  ("Content-Type", "application/warc-fields")], block)


# -- sequential reader -------------------------------------------------------

def members(archive: bytes | memoryview, most: int | None = None) -> Iterator[tuple[bytes, str | None]]:
    """Contents of the gzip members of an archive, in order, each with an
    error or None.  Input goes through the decompressor ``CHUNK`` bytes at a
    time; after damage reading goes on at the next member's magic number."""
    view, at = memoryview(archive), 0
    while at < len(view):
        if view[at] == 0:  # padding between members
            at += 1
            continue
        unpack, parts, size, start = zlib.decompressobj(31), [], 0, at
        error = None
        while not unpack.eof and at < len(view):
            piece = view[at:at + CHUNK]
            try:
                parts.append(unpack.decompress(piece))
            except zlib.error as damage:
                error = f"gzip: {damage}"
                break
            size += len(parts[-1])
            at += len(piece) - len(unpack.unused_data)
        if error is None and not unpack.eof:
            error = "gzip: truncated"
        if error is None:
            yield b"".join(parts), None
            continue
        yield b"", error
        at = _next_magic(view, start + 1)


def _next_magic(view: memoryview, at: int) -> int:
    """Position of the next gzip header, or the end."""
    while at < len(view):
        block = bytes(view[at:at + CHUNK + 2])
        found = block.find(b"\x1f\x8b\x08")
        if found >= 0:
            return at + found
        at += CHUNK
    return len(view)


_FIELD = re.compile(rb"([^\s:()<>@,;\\\"/\[\]?={}]+):[ \t]*(.*)", re.DOTALL)


def fields_of(head: bytes) -> dict[str, str] | None:
    """Header fields by lower-case name (a line that starts with a blank goes
    on with the one before), or None."""
    lines: list[bytes] = []
    for line in head.split(b"\r\n"):
        if line[:1] in (b" ", b"\t") and lines:
            lines[-1] += b" " + line.strip()
        else:
            lines.append(line)
    out = {}
    for line in lines:
        m = _FIELD.fullmatch(line)
        if m is None:
            return None
        out[m[1].decode("ascii", "replace").lower()] = m[2].strip().decode("utf-8", "replace")
    return out


def _number(text: str | None) -> int | None:
    return int(text) if text is not None and re.fullmatch(r"-?[0-9]+", text) else None


def parse(record: bytes) -> dict:
    """Fields of one record as a row of ``RECORD``, with an ``error`` where
    framing or a digest fails."""
    row: dict = dict.fromkeys(("record_key", "record_type", "refers_to", "uri", "payload", "payload_bytes",
                               "payload_digest", "error"))

    def bad(why: str) -> dict:
        row.update(error=why, payload=None)
        return row

    line, _, rest = record.partition(b"\r\n")
    if not re.fullmatch(rb"WARC/[0-9]+\.[0-9]+", line):
        return bad("no version line")
    head, blank, body = rest.partition(b"\r\n\r\n")
    fields = fields_of(head) if blank else None
    if fields is None:
        return bad("broken header")
    row.update(record_type=fields.get("warc-type"), uri=fields.get("warc-target-uri"),
               record_key=_number(fields.get("x-record-key")), refers_to=_number(fields.get("x-refers-to-key")))
    length = _number(fields.get("content-length"))
    if length is None or length < 0:
        return bad("no content length")
    if body[length:] != b"\r\n\r\n":
        return bad("content length does not frame the block")
    block = body[:length]
    claimed = fields.get("warc-block-digest")
    if claimed is not None and claimed != "sha1:" + digest(block):
        return bad("block digest")
    if row["record_type"] not in ("response", "revisit"):
        return row
    http, blank, payload = block.partition(b"\r\n\r\n")
    inner = fields_of(http.partition(b"\r\n")[2]) if blank else None
    if inner is None:
        return bad("broken HTTP header")
    claimed = fields.get("warc-payload-digest", "")
    size = _number(inner.get("content-length"))
    if row["record_type"] == "response":
        found = digest(payload)
        if claimed and claimed != "sha1:" + found:
            return bad("payload digest")
        if size is not None and size != len(payload):
            return bad("payload length")
        row.update(payload=payload, payload_bytes=len(payload), payload_digest=found)
    else:
        if not claimed.startswith("sha1:"):
            return bad("revisit without a payload digest")
        row.update(payload_bytes=size, payload_digest=claimed[5:])
    return row


# -- tables ------------------------------------------------------------------

def write_archives(df: DataFrame, id_col: str, url_col: str, payload_col: str, folder: str | None = None,
                   content_type: str = "text/html; charset=utf-8", min_revisit_bytes: int = 0,
                   archive_bytes: int = ARCHIVE_BYTES) -> str:
    """Write one record per row below ``folder`` (by default one of its own in
    the shared checkpoint folder) and return the folder.  Payloads of fewer
    than ``min_revisit_bytes`` are responses all.  Texts are written as
    UTF-8."""
    spark = df.sparkSession
    folder = folder or f"{ensure_checkpoint_dir(spark).rstrip('/')}/tables/{uuid.uuid4().hex}"
    payload = F.coalesce(F.col(payload_col).cast("binary"), F.lit(b""))
    rows = df.select(F.col(id_col).cast("long").alias("_id"), F.col(url_col).cast("string").alias("_url"),
                     payload.alias("_payload"))
    sha = F.unhex(F.sha1("_payload"))
    # Rows without an id have numbers by their url, so that they spread.
    spread = F.xxhash64("_url").bitwiseAND(F.lit(NO_ID - 1)) + F.lit(NO_ID)
    rows = rows.select(F.coalesce("_id", spread).alias("_key"), "_url", "_payload", sha.alias("_sha"),
                       F.octet_length("_payload").cast("long").alias("_size"))
    known = cut_lineage(rows.groupBy("_key", "_sha", "_size").agg(F.count("*").alias("_copies")))
    repeated = (known.where(F.col("_size") >= min_revisit_bytes).groupBy("_sha", "_size")
                .agg(F.min("_key").alias("_first"), F.sum("_copies").alias("_all")).where("_all > 1")
                .drop("_all"))
    total = known.agg(F.sum(F.col("_size") * F.col("_copies"))).first()[0] or 0
    # A hot digest is one row per id here; Spark splits it or broadcasts the other side.
    judged = known.join(repeated, ["_sha", "_size"], "left").select("_key", "_sha", "_first")
    several = not known.where("_copies > 1").isEmpty()
    archives = max(1, -(-int(total) // archive_bytes))
    # One shuffle of the payloads: the join keeps the archives' partitioning
    # (as an outer join it never broadcasts the payloads).
    placed = rows.repartition(archives, "_key", "_sha").join(judged, ["_key", "_sha"], "left")
    turn = F.lit(0)
    if several:  # rows that repeat id and payload are told apart by their turn
        turn = F.row_number().over(Window.partitionBy("_key", "_sha").orderBy("_url")) - 1
    revisit = F.col("_first").isNotNull() & ((F.col("_key") != F.col("_first")) | (F.col("_turn") > 0))
    records = (placed.withColumn("_turn", turn).withColumn("_revisit", revisit)
               .select("_key", "_url", "_payload", "_sha", "_first", "_revisit", "_turn"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        started = False
        for batch in batches:
            for lo in range(0, batch.num_rows, 64):
                out = [] if started else [member(info_record())]
                started = True
                for key, url, payload, sha, first, is_revisit, turn_ in zip(
                        *(c.to_pylist() for c in batch.slice(lo, 64).columns), strict=True):
                    name = base64.b32encode(sha).decode("ascii")
                    out.append(member(content_record(key, clean_uri(url, name), payload, name, first, is_revisit,
                                                     turn_, content_type)))
                # without the last byte, which the sink writes
                yield pa.RecordBatch.from_arrays([pa.array([x[:-1] for x in out], pa.binary())], names=["value"])

    packed = records.mapInArrow(pack, "value binary").select(F.col("value").cast("string").alias("value"))
    packed.write.mode("errorifexists").option("lineSep", _SEPARATOR).text(folder)
    return folder


def read_archives(spark: SparkSession, folder: str, kinds: tuple[str, ...] = ("response", "revisit"),
                  with_payload: bool = True) -> DataFrame:
    """One row (``RECORD``) per record of the wanted kinds, and one per
    damaged record."""
    files = spark.read.format("binaryFile").load(folder).select("content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive in batch.column(0):
                rows, held = [], 0
                for record, error in members(archive.as_buffer()):
                    if error is None and not record:
                        continue
                    row = parse(record) if error is None else {"error": error}
                    if row["error"] is None and row["record_type"] not in kinds:
                        continue
                    if not with_payload:
                        row["payload"] = None
                    rows.append(row)
                    held += len(row.get("payload") or b"") + 200
                    if held > 1 << 22:
                        yield _records(rows)
                        rows, held = [], 0
                yield _records(rows)

    return files.mapInArrow(run, RECORD)


_ARROW = pa.schema([("record_key", pa.int64()), ("record_type", pa.string()), ("refers_to", pa.int64()),
                    ("uri", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()),
                    ("payload_digest", pa.string()), ("error", pa.string())])


def _records(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema=_ARROW)
