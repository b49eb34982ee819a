"""WARC archives: write pages with revisits and segments, read them back and put segments together.

Each task writes two files of gzip members, a record each: one with whole records, one with records
that are longer than a segment. A long record's first segment is followed by ``continuation`` records
that name it as their origin; the last one states the total length. Blocks are HTTP responses whose
body is framed in chunks. Reading back groups segments by origin wherever they lie, orders them by
number, checks that none is missing and that the lengths add up, takes the chunk framing off and
checks the payload's digest.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxloom.llm.files import opened, written
from voxloom.session import materialize, new_scratch

SEGMENT_BYTES = 16 << 10
CHUNK_BYTES = 8 << 10
LEAST_REVISIT = 100
LEVEL = 3
#: Fixed: values of the archive format.
VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
DATE = "2024-01-01T00:00:00Z"


# records


def chunked(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    """The payload in HTTP chunk framing."""
    parts = []
    for at in range(0, len(payload), size):
        part = payload[at : at + size]
        parts += [b"%x\r\n" % len(part), part, b"\r\n"]
    return b"".join([*parts, b"0\r\n\r\n"])


def dechunked(body: bytes) -> bytes:
    """The payload without chunk framing; raises where the framing is broken."""
    parts, at = [], 0
    while True:
        line = body.find(b"\r\n", at)
        if line < 0:
            raise ValueError("a chunk has no size")
        size = int(body[at:line].split(b";")[0], 16)
        if size == 0:
            return b"".join(parts)
        if body[line + 2 + size : line + 4 + size] != b"\r\n":
            raise ValueError("a chunk is shorter than its size says")
        parts.append(body[line + 2 : line + 2 + size])
        at = line + 4 + size


def record(fields: list[tuple[str, object]], block: bytes) -> bytes:
    lines = [VERSION, *(f"{k}: {v}" for k, v in fields), f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parsed(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Fields and block of a record; raises where the length is wrong."""
    head, found, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not found or not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(line.split(": ", 1) for line in lines[1:])
    size = int(fields["Content-Length"])
    if rest[size:] != b"\r\n\r\n":
        raise ValueError("a record is shorter or longer than its length says")
    return fields, rest[:size]


def members(stream, size: int = 1 << 16) -> Iterator[bytes]:
    """The gzip members of a file, one after the other."""
    chunk = stream.read(size)
    while chunk:
        unpack, parts = zlib.decompressobj(31), []
        while not unpack.eof:
            if not chunk:
                raise ValueError("an archive ends within a record")
            parts.append(unpack.decompress(chunk))
            chunk = unpack.unused_data or (stream.read(size) if not unpack.eof else b"")
        chunk = chunk or stream.read(size)
        yield b"".join(parts)


def _packed(raw: bytes, level: int) -> bytes:
    pack = zlib.compressobj(level, zlib.DEFLATED, 31)
    return pack.compress(raw) + pack.flush()


def _name(page, digest: str) -> str:
    return f"<urn:page:{'-' if page is None else page}:{digest[:16]}>"


def _page(name: str | None) -> int | None:
    found = re.match(r"<urn:page:(-?\d+):", name or "")
    return int(found[1]) if found else None


def page_records(page, url, payload: bytes, digest: str, refers_to, segment: int) -> list[bytes]:
    """The records of a page: a revisit, a response, or the segments of one."""
    name = _name(page, digest)
    common = [("WARC-Record-ID", name), ("WARC-Date", DATE), ("WARC-Payload-Digest", f"sha256:{digest}")]
    if url:
        common.insert(2, ("WARC-Target-URI", re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)))
    kind = ("Content-Type", "application/http; msgtype=response")
    if refers_to is not None:
        about = [("WARC-Profile", PROFILE), ("WARC-Refers-To", _name(refers_to, digest))]
        return [record([("WARC-Type", "revisit"), *common, *about, kind], HTTP_HEAD)]
    block = HTTP_HEAD + chunked(payload)
    if len(block) <= segment:
        return [record([("WARC-Type", "response"), *common, kind], block)]
    out = []
    for n, at in enumerate(range(0, len(block), segment), 1):
        if n == 1:
            fields = [("WARC-Type", "response"), *common, kind, ("WARC-Segment-Number", 1)]
        else:
            fields = [("WARC-Type", "continuation"), ("WARC-Record-ID", f"{name[:-1]}:{n}>"), ("WARC-Date", DATE), ("WARC-Segment-Origin-ID", name), ("WARC-Segment-Number", n)]
        if at + segment >= len(block):
            fields.append(("WARC-Segment-Total-Length", len(block)))
        out.append(record(fields, block[at : at + segment]))
    return out


def assembled(segments: list[dict]) -> tuple[dict[str, str], bytes, int]:
    """Fields of the first segment, the whole block, and how many equal records these segments hold."""
    by_number = {s["number"]: s for s in segments}
    if sorted(by_number) != list(range(1, len(by_number) + 1)):
        raise ValueError(f"segments are missing: there are {sorted(by_number)}")
    block = b"".join(by_number[n]["block"] for n in sorted(by_number))
    if by_number[len(by_number)]["total"] != len(block):
        raise ValueError(f"segments make {len(block)} bytes; {by_number[len(by_number)]['total']} are stated")
    return dict(by_number[1]["fields"]), block, sum(s["number"] == 1 for s in segments)


# writing


def write_pages(pages: DataFrame, folder: str, segment: int = SEGMENT_BYTES, least: int = LEAST_REVISIT) -> DataFrame:
    """Write a record for each row of ``page_id, url, html``; returns a row per task that wrote: ``part``.

    Of rows with equal payloads of at least ``least`` bytes, those with the smallest page are responses
    and the others revisit it; rows without a page number are responses. Null html is an empty payload.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    narrow = rows.where(F.length("payload") >= least).select("page_id", "digest")
    firsts = narrow.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.max("page_id").alias("last")).where("last > refers_to")
    again = narrow.join(firsts.drop("last"), "digest").where("page_id > refers_to").distinct()
    rows = rows.join(again, ["page_id", "digest"], "left")

    def run(batches):
        part, n = TaskContext.get().partitionId(), 0
        first = next(batches, None)
        if first is None:
            return
        with written(f"{folder}/part-{part:06d}.warc.gz") as whole, written(f"{folder}/part-{part:06d}.segments.warc.gz") as long:
            while first is not None:
                for row in zip(*(first.column(i).to_pylist() for i in range(5)), strict=True):
                    page, url, payload, digest, refers_to = row
                    records = page_records(page, url, payload, digest, refers_to, segment)
                    out = whole if len(records) == 1 else long
                    out.write(b"".join(_packed(r, LEVEL) for r in records))
                    n += 1
                first = next(batches, None)
        yield pa.RecordBatch.from_pydict({"part": [part], "n": [n]}, schema=pa.schema([("part", pa.int32()), ("n", pa.int64())]))

    written_rows = rows.select("page_id", "url", "payload", "digest", "refers_to").mapInArrow(run, "part int, n long")
    return materialize(written_rows, "warc-manifest")


# reading

_READ = "name string, page_id long, record_type string, refers_to string, payload_bytes long, payload_digest string"
_READ_FIELDS = ["name", "page_id", "record_type", "refers_to", "payload_bytes", "payload_digest"]
_READ_SCHEMA = pa.schema([("name", pa.string()), ("page_id", pa.int64()), ("record_type", pa.string()), ("refers_to", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string())])


def _told(fields: dict[str, str], block: bytes) -> tuple:
    """A row of what a whole record holds; a revisit holds no payload."""
    name, kind = fields["WARC-Record-ID"], fields["WARC-Type"]
    if kind == "revisit":
        return name, _page(name), kind, fields["WARC-Refers-To"], None, None
    head, _, body = block.partition(b"\r\n\r\n")
    payload = dechunked(body) if b"transfer-encoding: chunked" in head.lower() else body
    digest = hashlib.sha256(payload).hexdigest()
    if fields.get("WARC-Payload-Digest", f"sha256:{digest}") != f"sha256:{digest}":
        raise ValueError(f"the payload of {name} has another digest")
    return name, _page(name), kind, None, len(payload), digest


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict(dict(zip(_READ_FIELDS, map(list, zip(*rows, strict=True)), strict=True)), schema=_READ_SCHEMA)


def read_whole(parts: DataFrame, folder: str) -> DataFrame:
    """What the records that are not segmented hold."""

    def run(batches):
        for b in batches:
            for part in b.column(0).to_pylist():
                rows = []
                with opened(f"{folder}/part-{part:06d}.warc.gz") as f:
                    for raw in members(f):
                        rows.append(_told(*parsed(raw)))
                        if len(rows) == 1000:
                            yield _batch(rows)
                            rows = []
                if rows:
                    yield _batch(rows)

    return parts.mapInArrow(run, _READ)


def read_segments(parts: DataFrame, folder: str) -> DataFrame:
    """``origin, number, total, fields, block`` of each segment."""
    schema = pa.schema([("origin", pa.string()), ("number", pa.int32()), ("total", pa.int64()), ("fields", pa.map_(pa.string(), pa.string())), ("block", pa.binary())])

    def run(batches):
        for b in batches:
            for part in b.column(0).to_pylist():
                rows, held = [], 0
                with opened(f"{folder}/part-{part:06d}.segments.warc.gz") as f:
                    for raw in members(f):
                        fields, block = parsed(raw)
                        origin = fields.get("WARC-Segment-Origin-ID", fields["WARC-Record-ID"])
                        total = fields.get("WARC-Segment-Total-Length")
                        rows.append({"origin": origin, "number": int(fields["WARC-Segment-Number"]), "total": int(total) if total else None, "fields": list(fields.items()), "block": block})
                        held += len(block)
                        if held > 4 << 20:
                            yield pa.RecordBatch.from_pylist(rows, schema=schema)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return parts.mapInArrow(run, "origin string, number int, total long, fields map<string,string>, block binary")


def reassembled(segments: DataFrame) -> DataFrame:
    """What the segmented records hold. A group is one record: its size is that of a page, not of the corpus."""
    grouped = segments.groupBy("origin").agg(F.collect_list(F.struct("number", "total", "fields", "block")).alias("segments"))

    def run(batches):
        for b in batches:
            rows = []
            for segments in b.column(0):
                fields, block, copies = assembled(segments.as_py())
                rows += [_told(fields, block)] * copies
            if rows:
                yield _batch(rows)

    return grouped.select("segments").mapInArrow(run, _READ)


def read_pages(manifest: DataFrame, folder: str) -> DataFrame:
    """Per record ``page_id, payload_bytes, payload_digest, record_type, refers_to``; a revisit's payload is its response's."""
    parts = manifest.select("part").repartitionByRange(max(1, manifest.count()), "part")  # a task for each file
    rows = materialize(read_whole(parts, folder).unionByName(reassembled(read_segments(parts, folder))), "warc-read")
    responses = rows.where("record_type = 'response'")
    targets = responses.select(F.col("name").alias("refers_to"), F.col("page_id").alias("target"), F.col("payload_bytes").alias("b"), F.col("payload_digest").alias("d")).distinct()
    revisits = rows.where("record_type = 'revisit'").join(targets, "refers_to", "left")
    first = responses.select("page_id", "payload_bytes", "payload_digest", "record_type", F.lit(None).cast("long").alias("refers_to"))
    return first.unionByName(revisits.select("page_id", F.col("b").alias("payload_bytes"), F.col("d").alias("payload_digest"), "record_type", F.col("target").alias("refers_to")))


def op6_warc(spark, sf_dir: str) -> DataFrame:
    folder = new_scratch(spark, "warc")
    return read_pages(write_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"), folder), folder)


QUERIES = {"op6_warc": op6_warc}
ORACLE = {
    "op6_warc": """
with p as (select page_id, encode(coalesce(html, '')) as b from pages),
q as (select page_id, octet_length(b)::bigint as payload_bytes, sha256(b) as payload_digest from p),
f as (select payload_digest, min(page_id) as first from q where payload_bytes >= 100 group by payload_digest)
select page_id, payload_bytes, payload_digest,
  case when page_id > first then 'revisit' else 'response' end as record_type,
  case when page_id > first then first end as refers_to
from q left join f using (payload_digest)
"""
}
