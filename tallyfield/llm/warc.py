"""WARC writer and sequential reader.

Archives hold one gzip member for each record.  The reader goes through an archive member by member with incremental
decompression, frames each block by its Content-Length and checks block and payload digests.

Records with equal payloads are written once: that with the smallest page id is ``response``, the others are
``revisit`` records that refer to it and carry headers only.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyfield.llm.common import hot_join, save, scratch_path, text_of

CRLF = b"\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CHUNK = 1 << 20
LEVEL = 3


class WarcError(ValueError):
    pass


def digest32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(kind: str, headers: dict[str, str], block: bytes) -> bytes:
    """One record as one gzip member."""
    lines = {"WARC-Type": kind, **headers, "WARC-Block-Digest": f"sha1:{digest32(block)}", "Content-Length": str(len(block))}
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in lines.items()) + "\r\n"
    z = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return z.compress(head.encode() + block + CRLF + CRLF) + z.flush()


def page_record(page_id: int | None, url: str | None, html: str | None, refers_to: int | None) -> bytes:
    """A page as a response record, or as a revisit record if it refers to another page."""
    payload = (html or "").encode("utf-8", "surrogatepass")
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    h = {
        "WARC-Record-ID": f"<urn:page:{'' if page_id is None else page_id}>",
        "WARC-Date": "1970-01-01T00:00:00Z",
        "WARC-Target-URI": "".join((url or "").split()),
        "WARC-Payload-Digest": f"sha1:{digest32(payload)}",
        "Content-Type": "application/http;msgtype=response",
    }
    if refers_to is None:
        return record("response", h, http + payload)
    return record("revisit", h | {"WARC-Refers-To": f"<urn:page:{refers_to}>", "WARC-Profile": PROFILE}, http)


def members(source):
    """The decompressed gzip members of a binary stream, one after the other.  A cut member raises WarcError."""
    z, out, left = zlib.decompressobj(31), [], b""
    started = False
    while True:
        data = left or source.read(CHUNK)
        left = b""
        if not data:
            if started:
                raise WarcError("the archive ends within a member")
            return
        started = True
        out.append(z.decompress(data))
        if z.eof:
            yield b"".join(out)
            left, z, out, started = z.unused_data, zlib.decompressobj(31), [], False


def parse(member: bytes) -> tuple[dict[str, str], bytes]:
    """(headers by lower-case name, block) of a record, framed by Content-Length; digests are checked."""
    head, gap, rest = member.partition(CRLF + CRLF)
    first, *lines = head.decode("utf-8").split("\r\n")
    if not gap or not first.startswith("WARC/"):
        raise WarcError("not a WARC record")
    headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
    n = int(headers["content-length"])
    block = rest[:n]
    if len(block) != n or rest[n:] != CRLF + CRLF:
        raise WarcError("content-length does not frame the block")
    for name, data in (("warc-block-digest", block), ("warc-payload-digest", payload(headers, block))):
        want = headers.get(name)
        if want and data is not None and want != f"sha1:{digest32(data)}":
            raise WarcError(f"{name} differs")
    return headers, block


def payload(headers: dict[str, str], block: bytes) -> bytes | None:
    """A response's payload: what follows the HTTP headers.  None for revisit records, which carry none."""
    return block.partition(CRLF + CRLF)[2] if headers["warc-type"] == "response" else None


def _page_of(urn: str | None) -> int | None:
    x = (urn or "").removeprefix("<urn:page:").removesuffix(">")
    return int(x) if x else None


def write_archives(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Write ``pages(page_id, url, html)`` to .warc.gz files, one for each task; a written table (path, n_records).

    Files of attempts that failed are not in the table, so they are never read.  ``folder`` is any place that pyarrow's
    file systems open (file, hdfs, s3, gs); default: the scratch folder.
    """
    spark = pages.sparkSession
    folder = folder or scratch_path(spark, "warc")
    rows = pages.select(
        pages["page_id"].cast("bigint").alias("page_id"), pages["url"].cast("string").alias("url"), text_of(pages, "html").alias("html")
    )
    rows = rows.withColumn("sum", F.sha1(F.encode("html", "utf-8")))
    sums = save(rows.select("page_id", "sum"), "warc-sums")
    # a payload's response is its smallest id; null ids come last
    groups = sums.groupBy("sum").agg(F.count("*").alias("n"), F.min("page_id").alias("first"), F.count("page_id").alias("ids"))
    groups = save(groups.filter("n > 1"), "warc-groups")
    size = groups.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    again = hot_join(sums, groups, "sum", "n", size, "inner").filter("page_id <> first or page_id is null")
    again = save(again.select("page_id", "sum", F.col("first").alias("refers_to")).distinct(), "warc-revisits")
    # by payload too: an id that is null or repeated stands for pages of several payloads
    same = rows["page_id"].eqNullSafe(again["page_id"]) & (rows["sum"] == again["sum"])
    rows = rows.join(again, same, "left").select(rows["page_id"], rows["url"], rows["html"], "refers_to")

    def run(batches):
        fs, base = pafs.FileSystem.from_uri(folder)
        fs.create_dir(base, recursive=True)
        path, n, out = f"{base}/{uuid.uuid4().hex}.warc.gz", 0, None
        for b in batches:
            out = out or fs.open_output_stream(path, compression=None)
            for r in zip(*(c.to_pylist() for c in b.columns)):
                out.write(page_record(*r))
                n += 1
        if out:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([n], pa.int64())], ["path", "n_records"])

    return save(rows.mapInArrow(run, "path string, n_records bigint"), "warc-files")


def read_archives(files: DataFrame, folder: str) -> DataFrame:
    """Every record of the archives in ``files(path)``: page_id, payload_bytes, payload_digest, record_type, refers_to,
    url.  A broken record, or an archive with another number of records than written, raises WarcError."""

    def run(batches):
        fs, _ = pafs.FileSystem.from_uri(folder)
        for b in batches:
            for path, want in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                out, seen = [], 0
                with fs.open_input_stream(path, compression=None) as f:
                    for m in members(f):
                        h, block = parse(m)
                        http = dict(x.split(b": ", 1) for x in block.partition(CRLF + CRLF)[0].split(CRLF)[1:])
                        out.append((
                            _page_of(h["warc-record-id"]), int(http[b"Content-Length"]), h["warc-payload-digest"].removeprefix("sha1:"),
                            h["warc-type"], _page_of(h.get("warc-refers-to")), h["warc-target-uri"],
                        ))
                        seen += 1
                        if len(out) == 10_000:
                            yield batch(out)
                            out = []
                if seen != want:
                    raise WarcError(f"{path} has {seen} records; {want} were written")
                yield batch(out)

    types = [("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string())]

    def batch(out):
        cols = list(zip(*out)) or [[]] * len(types)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(cols, types)], [n for n, _ in types])

    n = files.count()
    spread = files.select("path", "n_records").repartition(max(1, n), "path")
    return spread.mapInArrow(run, "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, url string")


def round_trip(pages: DataFrame) -> DataFrame:
    """Write ``pages`` to archives and read them back.

    A null html is an empty payload; equal payloads, empty ones too, share one response.  A repeated page_id with the
    response's own payload is a response again; a null page_id comes after all others, and of payloads that only null
    ids have, each is a response.  Empty table: no rows.
    """
    folder = scratch_path(pages.sparkSession, "warc")
    return read_archives(write_archives(pages, folder), folder)
