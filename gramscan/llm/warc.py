"""WARC archives: written by tasks, read back with boundary-chain verification.

Writing: equal payloads (SHA-256 and length) of at least ``least`` bytes are stored once, by
the row with the smallest page_id; the others become revisit records that name it.  A task
packs records into archives of about ``archive_bytes`` and cuts them every ``chunk_bytes``, wherever
that falls; a chunk owns its byte range and carries the rest of the last record that begins in it
as well, as a reader of a split reads on beyond it.

Reading: a task looks for the magic anywhere in the chunks it has, also within payloads,
parses what follows as a header, and emits a candidate with the offset of its successor
(header, Content-Length and the closing blank lines).  Within each archive, whose size is
bounded, pointer jumping from offset 0 keeps the candidates that a chain of successors reaches.
Magic inside a payload is never a successor and goes.  A chain that doesn't end where its archive ends, a
missing chunk, or a reached record whose block hasn't the digest of its header fails the job.

A record's id is a UUID of its page_id and of the row's number, so records of repeated rows have ids of
their own, and a revisit names the response's.  The page_id itself travels in a header of its own.

The archives live in a table in the shared folder (archive, offset, bytes), so any store
that Spark reaches will do.  Null html is an empty payload; rows that repeat a page_id each
get a record of their own, and equal ones of the smallest page_id are all responses.
"""

from __future__ import annotations

import base64
import hashlib
import re
import time
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Scratch, fresh, small

MAGIC = b"WARC/1.1\r\n"


#: The date of records that are given none.
EPOCH = "1970-01-01T00:00:00Z"


def record_id(page_id: int | None, row: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{row}')}>"


def record(page_id: int, url: str, payload: bytes, refers_to: int | None, row: int | None = None, refers_row: int | None = None, date: str = EPOCH) -> bytes:
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    body = b"" if refers_to is not None else payload
    uri = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)
    lines = [f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {record_id(page_id, row)}", f"WARC-Date: {date}", f"WARC-Target-URI: {uri}", f"WARC-Payload-Digest: sha1:{digest}"]
    lines += [f"X-Page-ID: {page_id}"] if page_id is not None else []
    if refers_to is not None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(refers_to, refers_row)}", f"X-Refers-To-Page: {refers_to}", f"X-Payload-Length: {len(payload)}"]
    head = "\r\n".join([*lines, "Content-Type: application/octet-stream", f"Content-Length: {len(body)}"])
    return MAGIC + head.encode("utf-8", "surrogatepass") + b"\r\n\r\n" + body + b"\r\n\r\n"


def write(rows: DataFrame, archive_bytes: int = 16 << 20, chunk_bytes: int = 1 << 20, date: str = EPOCH) -> DataFrame:
    """Chunks (archive, offset, own, data) of the records of (page_id, url, payload, refers_to) and, for their ids, row and refers_row if there."""
    numbered = [c for c in ("row", "refers_row") if c in rows.columns]

    def run(batches):
        part, number = TaskContext.get().partitionId(), 0
        held = bytearray()  # from the chunk's first byte on
        at = start = 0  # in the archive: the next byte, the chunk's first byte
        names = ["archive", "offset", "own", "data"]

        def chunk(data: bytearray, own: int) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([f"{part:06d}-{number:06d}"]), pa.array([start], pa.int64()), pa.array([own], pa.int64()), pa.array([bytes(data)], pa.binary())], names=names)

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "payload", "refers_to", *numbered)), strict=True):
                begin = at
                held += record(row[0], row[1] or "", row[2] or b"", *row[3:], date=date)
                at = start + len(held)
                while at - start >= chunk_bytes:  # a chunk within the record has none that begins in it
                    yield chunk(held if begin < start + chunk_bytes and begin >= start else held[:chunk_bytes], chunk_bytes)
                    del held[:chunk_bytes]
                    start += chunk_bytes
                if at >= archive_bytes:
                    if held:
                        yield chunk(held, len(held))
                    held.clear()
                    number, at, start = number + 1, 0, 0
        if held:
            yield chunk(held, len(held))

    return rows.mapInArrow(run, "archive string, offset long, own long, data binary")


_FIELDS = "archive string, offset long, successor long, page_id long, kind string, digest string, n long, refers_to long, sound boolean"
_FIELD = re.compile(rb"^([A-Za-z-]+):[ \t]*(.*?)[ \t]*$", re.M)


def candidates(chunks: DataFrame) -> DataFrame:
    """A row for each place that may be a record, and one of kind null for each chunk (its place and end).

    sound: blank lines follow the block, and it has the digest that its header names."""

    def number(value: bytes | None) -> int | None:
        m = re.fullmatch(rb"-?\d+", value or b"")
        return int(m[0]) if m else None

    def run(batches):
        names = [f.split()[0] for f in _FIELDS.split(", ")]
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.bool_()]
        for batch in batches:
            out: list[tuple] = []
            for archive, offset, own, data in zip(*(batch.column(c) for c in ("archive", "offset", "own", "data")), strict=True):
                archive, offset, own, data = archive.as_py(), offset.as_py(), own.as_py(), data.as_buffer().to_pybytes()
                out.append((archive, offset, offset + own, None, None, None, None, None, None))
                at = data.find(MAGIC)
                while 0 <= at < own:
                    end = data.find(b"\r\n\r\n", at)
                    if end >= 0:
                        head = dict(_FIELD.findall(data[at + len(MAGIC) : end].replace(b"\r\n", b"\n")))
                        size = number(head.get(b"Content-Length"))
                        if size is not None and size >= 0:
                            stop = end + 4 + size
                            kind, digest = head.get(b"WARC-Type", b"").decode(), head.get(b"WARC-Payload-Digest", b"").decode().removeprefix("sha1:")
                            sound = data[stop : stop + 4] == b"\r\n\r\n" and (kind == "revisit" or base64.b32encode(hashlib.sha1(data[end + 4 : stop]).digest()).decode() == digest)
                            length = number(head.get(b"X-Payload-Length")) if kind == "revisit" else size
                            out.append((archive, offset + at, offset + stop + 4, number(head.get(b"X-Page-ID")), kind, digest, length, number(head.get(b"X-Refers-To-Page")), sound))
                    at = data.find(MAGIC, at + 1)
            columns = list(zip(*out, strict=True)) if out else [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names)

    return chunks.mapInArrow(run, _FIELDS)


def reachable(offset: np.ndarray, successor: np.ndarray) -> np.ndarray:
    """Which candidates a chain of successors from offset 0 reaches; offsets ascend."""
    n = len(offset)
    at = np.searchsorted(offset, successor)
    hop = np.where((at < n) & (offset[np.minimum(at, n - 1)] == successor), at, n)
    hop = np.append(hop, n)
    seen = np.zeros(n + 1, bool)
    seen[0] = n > 0 and offset[0] == 0
    while True:  # each turn doubles the length of the jumps
        ahead = hop[np.flatnonzero(seen)]
        if seen[ahead].all() and seen[n]:
            break
        seen[ahead] = True
        jumped = hop[hop]
        if (jumped == hop).all():
            break
        hop = jumped
    return seen[:n]


def _chain(table: pa.Table) -> pa.Table:
    name = table.column("archive")[0].as_py()
    cut = table.filter(pa.compute.is_null(table.column("kind"))).sort_by("offset")
    offset, end = cut.column("offset").to_numpy(), cut.column("successor").to_numpy()
    if len(offset) == 0 or offset[0] != 0 or (offset[1:] != end[:-1]).any():
        raise RuntimeError(f"archive {name}: a chunk is missing")
    table = table.filter(pa.compute.is_valid(table.column("kind"))).sort_by("offset")
    table = table.filter(pa.array(reachable(table.column("offset").to_numpy(), table.column("successor").to_numpy()), pa.bool_()))
    reached = table.column("successor")[-1].as_py() if len(table) else 0
    if reached != end[-1]:
        raise RuntimeError(f"archive {name}: the chain of records breaks at {reached} of {end[-1]}")
    if not pa.compute.all(table.column("sound")).as_py():
        raise RuntimeError(f"archive {name}: a record's block hasn't the digest of its header")
    return table


def read(chunks: DataFrame) -> DataFrame:
    """The records that the archives' chains reach, with the fields of ``candidates``."""
    return candidates(chunks).groupBy("archive").applyInArrow(_chain, _FIELDS)


def round_trip(pages: DataFrame, least: int = 0) -> DataFrame:
    """Writes every page and reads it back: page_id, payload_bytes, payload_digest, record_type, refers_to, sound."""
    html = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    rows = fresh(pages, "page_id", "url", "html").select(F.col("page_id").cast("long").alias("page_id"), "url", html.alias("payload"))
    rows = rows.withColumns({"key": F.unhex(F.sha2("payload", 256)), "size": F.octet_length("payload"), "row": F.monotonically_increasing_id()})
    scratch = Scratch(pages.sparkSession, "warc")
    first = rows.where(F.col("size") >= least).groupBy("key", "size").agg(F.min(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "row"))).alias("first"), F.count("*").alias("c")).where("c > 1").select("key", "size", F.col("first.page_id").alias("first"), F.col("first.row").alias("first_row"))
    first = scratch.write(first)
    again = ~F.col("page_id").eqNullSafe(F.col("first"))
    refers = [F.when(again, F.col(c)).alias(name) for c, name in (("first", "refers_to"), ("first_row", "refers_row"))]
    joined = rows.join(small(first, first.count(), 64), ["key", "size"], "left").select("page_id", "url", "payload", "row", *refers)
    chunks = scratch.write(write(joined, date=time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime())))
    return read(chunks).select("page_id", F.col("n").alias("payload_bytes"), F.col("digest").alias("payload_digest"), F.col("kind").alias("record_type"), "refers_to", "sound")
