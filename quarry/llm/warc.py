"""WARC archives: writing pages, and reading archives in splits by boundary-chain verification.

A reader that starts in the middle of a file can't tell a record from a payload
that holds the same bytes. So tasks report every candidate in their split (any
place with the magic and a header that parses) with the offset behind it, where
its successor would start. Within a split the chains are followed at once to the
offset where they leave it; across splits pointer jumping from offset 0 of each
file doubles the distance covered in every round. Only candidates on a chain
from the start of their file are records.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm import files
from quarry.llm.common import NULL_ID, keep, map_batches, null_id

MAGIC = b"WARC/1.1\r\n"
#: Bytes read behind a split for a header that goes on there; doubled until the header's end is found.
AHEAD = 65_536
#: Lengths of more digits than a file can have aren't lengths.
LENGTH = re.compile(r"[0-9]{1,17}")
CONTROL = re.compile(r"[\x00-\x20\x7f]")


def payload_digest(payload: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(kind: str, headers: dict[str, str], block: bytes) -> bytes:
    lines = "".join(f"{k}: {v}\r\n" for k, v in {"WARC-Type": kind, **headers, "Content-Length": str(len(block))}.items())
    return MAGIC + lines.encode() + b"\r\n" + block + b"\r\n\r\n"


def page_record(page_id: int, url: str | None, html: bytes, digest: str, refers_to: int | None) -> bytes:
    """A response with its payload, or a revisit that names the response's page; its HTTP header tells the payload's length."""
    headers = {"WARC-Record-ID": f"<urn:page:{page_id}>", "WARC-Date": "1970-01-01T00:00:00Z",
               "WARC-Target-URI": CONTROL.sub(lambda m: f"%{ord(m[0]):02X}", url or ""), "WARC-Payload-Digest": f"sha1:{digest}"}
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(html)}\r\n\r\n".encode()
    if refers_to is None:
        return record("response", headers | {"Content-Type": "application/http; msgtype=response"}, http + html)
    profile = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
    return record("revisit", headers | {"WARC-Refers-To": f"<urn:page:{refers_to}>", "WARC-Profile": profile,
                                        "Content-Type": "application/http; msgtype=response"}, http)


def parse_header(data: bytes, at: int) -> tuple[dict[str, str], int] | None:
    """Header fields (lower-case names) of a record at ``at`` and the offset of its block; None if there is no whole header."""
    if not data.startswith(MAGIC, at):
        return None
    fields, at = {}, at + len(MAGIC)
    while (end := data.find(b"\r\n", at)) != at:
        name, colon, value = data[at:end].partition(b":")
        if end < 0 or not colon:
            return None
        fields[name.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
        at = end + 2
    return (fields, end + 2) if LENGTH.fullmatch(fields.get("content-length", "")) else None


def unfinished(data: bytes, at: int) -> bool:
    """Whether the header at ``at`` goes on behind the data: no blank line, and nothing before it that isn't a field."""
    lines = data.find(b"\r\n", at)
    while (end := data.find(b"\r\n", lines + 2)) >= 0:
        if end == lines + 2 or data.find(b":", lines + 2, end) < 0:
            return False
        lines = end
    return True


def read_split(path: str, start: int, split_bytes: int) -> bytes:
    """The split's bytes and as many more as the last candidate's header needs."""
    length = split_bytes + AHEAD
    while True:
        data = files.read(path, start, length)
        last = data.rfind(MAGIC, 0, split_bytes + len(MAGIC) - 1)
        if last < 0 or len(data) < length or not unfinished(data, last):
            return data
        length *= 2


def candidates(data: bytes, start: int, size: int) -> list[tuple[int, int, int]]:
    """(offset, successor, exit) of the candidates in the first ``size`` bytes of ``data``, which starts at ``start`` of its file.

    The exit is the offset at which the chain from a candidate leaves the split, or breaks off.
    """
    found, at = [], data.find(MAGIC)
    while 0 <= at < size:
        if (parsed := parse_header(data, at)) is not None:
            found.append((start + at, start + parsed[1] + int(parsed[0]["content-length"]) + 4))
        at = data.find(MAGIC, at + 1)
    leaves: dict[int, int] = {}
    for offset, after in reversed(found):
        leaves[offset] = leaves.get(after, after)
    return [(offset, after, leaves[offset]) for offset, after in found]


def write(pages: DataFrame, folder: str, min_bytes: int = 0, file_bytes: int = 64_000_000, id_col: str = "page_id",
          url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write a record for each row to files under ``folder``; returns (path, size).

    Of equal payloads of at least ``min_bytes`` bytes, the smallest id's is the
    response and the others are revisits; shorter ones are all responses. Null
    html is empty. Rows that repeat an id and a payload are of the same type.
    """
    rows = pages.select(F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(NULL_ID)).alias("page_id"), F.col(f"`{url_col}`").cast("string").alias("url"),
                        F.coalesce(F.col(f"`{html_col}`").cast("string"), F.lit("")).alias("html")).withColumn("sha1", F.sha1(F.col("html").cast("binary")))

    def pack(b: pa.RecordBatch) -> pa.RecordBatch:
        """Payloads as zstandard frames: the shuffle to their records moves a fraction of the bytes."""
        squeeze = zstandard.ZstdCompressor(level=6)
        packed = [squeeze.compress(html.as_buffer().to_pybytes()) for html in b.column(2)]
        return pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(3), pa.array(packed, pa.binary())], ["page_id", "url", "sha1", "packed"])

    marked = keep(rows.select("page_id", F.octet_length("html").cast("long").alias("size"), "sha1").distinct(), "warc-digests")
    firsts = keep(marked.where(F.col("size") >= min_bytes).groupBy("sha1", "size").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
                  .where("n > 1").drop("n"), "warc-firsts")
    # Both sides are shuffled tables, so that AQE splits a digest that many pages share.
    refers = marked.join(firsts.hint("merge"), ["sha1", "size"]).where("page_id <> first").select("page_id", "sha1", "first")
    known = map_batches(rows, pack, "page_id long, url string, sha1 string, packed binary").join(keep(refers, "warc-revisits").hint("merge"), ["page_id", "sha1"], "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, out, size, unpack = TaskContext.get().partitionId(), 0, [], 0, zstandard.ZstdDecompressor()

        def flush() -> pa.RecordBatch:
            path = f"{folder}/part-{part:05d}-{number:05d}.warc"
            files.write(path, out)
            return pa.RecordBatch.from_arrays([pa.array([path]), pa.array([size], pa.int64())], ["path", "size"])

        for b in batches:
            for page_id, url, html, first in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), b.column(3).to_pylist(), strict=True):
                html = unpack.decompress(html.as_buffer().to_pybytes())
                if not out:
                    out.append(record("warcinfo", {"Content-Type": "application/warc-fields"}, b"format: WARC file version 1.1\r\n"))
                    size = len(out[0])
                out.append(page_record(page_id, url, html, payload_digest(html), first))
                size += len(out[-1])
                if size >= file_bytes:
                    yield flush()
                    out, size, number = [], 0, number + 1
        if out:
            yield flush()

    columns = known.select("page_id", "url", "packed", "first")
    return keep(columns.mapInArrow(run, "path string, size long"), "warc-files")


def chains(found: DataFrame) -> DataFrame:
    """(path, offset) of the split entries that a chain from offset 0 of the file reaches, by pointer jumping over exits."""
    jump = keep(found.select("path", "offset", F.col("exit").alias("to")), "warc-jumps")
    reached = keep(jump.where("offset = 0").select("path", "offset"), "warc-reached")
    count = reached.count()
    while True:
        ahead = reached.join(jump.hint("merge"), ["path", "offset"]).select("path", F.col("to").alias("offset"))
        reached = keep(reached.union(ahead).distinct(), "warc-reached")
        now = reached.count()
        if now == count:
            return reached
        count = now
        step = jump.select("path", F.col("offset").alias("to"), F.col("to").alias("next"))
        jump = keep(jump.join(step.hint("merge"), ["path", "to"]).select("path", "offset", F.col("next").alias("to")), "warc-jumps")


def read(archives: DataFrame, split_bytes: int = 4_000_000) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of the page records in the files (path, size).

    Fails if the records of a file don't follow each other up to its size.
    """
    ranges = F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(split_bytes).cast("long"))
    splits = keep(archives.where("size > 0").select("path", "size", F.explode(ranges).alias("start")), "warc-splits").repartition("path", "start")

    def scan(b: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for path, start in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True):
            data = read_split(path, start, split_bytes)
            rows += [(path, start, *c) for c in candidates(data, start, split_bytes)]
        cols = list(zip(*rows, strict=True)) or [()] * 5
        return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), *[pa.array(c, pa.int64()) for c in cols[1:]]], ["path", "start", "offset", "after", "exit"])

    found = keep(map_batches(splits, scan, "path string, start long, offset long, after long, exit long"), "warc-candidates")
    reached = chains(found)
    ends = reached.select("path", F.col("offset").alias("size"))
    for broken in archives.where("size > 0").join(ends.hint("merge"), ["path", "size"], "left_anti").limit(1).collect():
        raise ValueError(f"{broken['path']}: the chain of records doesn't end at the file's size of {broken['size']} bytes")
    entries = reached.withColumn("start", F.col("offset") - F.col("offset") % split_bytes)
    entered = entries.join(found.select("path", "offset", "exit").hint("merge"), ["path", "offset"])

    def payloads(b: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for path, at, end in zip(*[c.to_pylist() for c in b.columns], strict=True):
            data, base = files.read(path, at, end - at), at
            while at < end:
                fields, block = parse_header(data, at - base)
                after = block + int(fields["content-length"]) + 4
                if fields["warc-type"] in ("response", "revisit"):
                    http, _, payload = data[block:after - 4].partition(b"\r\n\r\n")
                    size = int(re.search(rb"(?i)\r\ncontent-length: *(\d+)", http)[1])
                    digest = fields["warc-payload-digest"].removeprefix("sha1:")
                    if fields["warc-type"] == "response" and (len(payload), payload_digest(payload)) != (size, digest):
                        raise ValueError(f"{path} at {at}: the payload isn't the one of its header")
                    page = lambda name: int(fields[name].removeprefix("<urn:page:").removesuffix(">"))  # noqa: B023, E731
                    rows.append((page("warc-record-id"), size, digest, fields["warc-type"], page("warc-refers-to") if "warc-refers-to" in fields else None))
                at = base + after
        cols = list(zip(*rows, strict=True)) or [()] * 5
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    walks = entered.select("path", "offset", "exit").repartition("path", "offset")
    out = map_batches(walks, payloads, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")
    return out.withColumn("page_id", null_id("page_id")).withColumn("refers_to", null_id("refers_to"))
