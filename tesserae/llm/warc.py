"""WARC archives: written with an index, read by coalesced byte ranges.

Each task writes one archive of records, a gzip member each, and returns an
index row for each record: archive, offset, length, URL, payload digest. Those
rows are the only sign that an archive counts; what a lost or repeated task
leaves is never read. A payload that was there before is written as a revisit
record, which names the record that has it.

Reading starts from any selection of index rows. They are sorted by archive
and offset, and ranges that touch or nearly do are read in one go.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import TASK_BYTES, dealt, filesystem, made, new_folder, release_since, stored

INDEX = (
    "page_id long, archive string, offset long, length long, url string, payload_digest string, "
    "payload_bytes long, record_type string, refers_to long")
DATE = "1970-01-01T00:00:00Z"
LEVEL = 5


def _line(text: str) -> str:
    """A header value on one line."""
    return re.sub(r"[\r\n]+", " ", text)


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str = DATE) -> bytes:
    """One record, uncompressed. With ``refers_to`` it is a revisit without the payload."""
    name = "" if page_id is None else page_id
    revisit = refers_to is not None
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block += b"" if revisit else payload
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{name}>", f"WARC-Date: {date}",
        *([] if url is None else [f"WARC-Target-URI: {_line(url)}"]),
        f"WARC-Payload-Digest: sha1:{digest}",
        *([f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"] if revisit else []),
        "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(head).encode("utf-8") + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> dict:
    """Headers and payload of one record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode("utf-8").split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    fields["payload"] = payload
    fields["payload_bytes"] = int(re.search(rb"\r\nContent-Length: (\d+)", http)[1])
    return fields


def _number(urn: str | None) -> int | None:
    digits = (urn or "").removeprefix("<urn:page:").removesuffix(">")
    return int(digits) if digits else None


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def first_of_payload(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """``pages`` with ``refers_to`` (a column of that name is replaced): the smallest page_id with an equal payload, null where
    that is the page itself, the payload is shorter than ``min_bytes`` or the page has no id.

    Counts are made before anything is dealt by payload; the copies' heads are
    a stored table, so that a payload with very many copies can be split.
    """
    html = F.coalesce("html", F.lit(""))
    rows = pages.select(F.struct(*pages.columns).alias("row"), "page_id", F.sha1(html.cast("binary")).alias("sha"), (F.octet_length(html) >= min_bytes).alias("long"))
    heads = stored(
        rows.where("long").groupBy("sha").agg(F.min("page_id").alias("first"), F.count("page_id").alias("n"))
        .where("n > 1").select("sha", "first"), "heads")
    refers = F.when(F.col("long") & (F.col("page_id") != F.col("first")), F.col("first"))
    own = [F.col(f"row.`{c}`") for c in pages.columns if c != "refers_to"]
    return rows.join(heads, "sha", "left").select(*own, refers.alias("refers_to"))


def write(pages: DataFrame, folder: str | None = None, min_bytes: int = 0, date: str = DATE) -> DataFrame:
    """Write a record for each row of ``pages`` (page_id, url, html) and return the index.

    A null html is an empty payload; a null url has no target header; rows
    with a null page_id are responses without a number. Repeats of a page_id
    with equal payloads are responses all. A page of any length is one record,
    which its task holds whole. Other columns are not looked at. An
    empty table gives an empty index.
    """
    spark = pages.sparkSession
    folder = folder or new_folder(spark, "warc")

    def archive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uri, out, at = f"{folder}/{uuid.uuid4().hex}.warc.gz", None, 0
        store, path = filesystem(uri)
        schema = pa.schema([
            ("page_id", pa.int64()), ("archive", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("url", pa.string()),
            ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("record_type", pa.string()), ("refers_to", pa.int64())])
        for batch in batches:
            if out is None and batch.num_rows:
                store.create_dir(path.rpartition("/")[0], recursive=True)
                out = store.open_output_stream(path, compression=None)
            rows = []
            for page, url, html, refers in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html", "refers_to")), strict=True):
                payload = (html or "").encode("utf-8")
                digest = digest_of(payload)
                pack = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
                member = pack.compress(record(page, url, payload, digest, refers, date)) + pack.flush()
                out.write(member)
                rows.append((page, uri, at, len(member), url, digest, len(payload), "response" if refers is None else "revisit", refers))
                at += len(member)
            columns = zip(*rows, strict=True) if rows else [[]] * len(schema)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)
        if out is not None:
            out.close()

    begun = made()
    rows = first_of_payload(pages.select("page_id", "url", "html"), min_bytes)
    index = stored(rows.select("page_id", "url", "html", "refers_to").mapInArrow(archive, INDEX), "warc-index")
    release_since(begun, made()[-1])
    return index


_READ = "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long"


def read(index: DataFrame, gap: int = 1 << 16, most: int = 1 << 23, payloads: bool = True, each: int = TASK_BYTES) -> DataFrame:
    """The records that the index rows (archive, offset, length) name.

    The rows are dealt to tasks by the bytes they stand for (about ``each`` a
    task), not by their number. Byte ranges of an archive up to ``gap`` bytes
    apart are read together, up to ``most`` bytes at a time or a whole record.
    payload_bytes and digest are of the full payload, for revisits from their
    headers; a response whose payload doesn't have its digest raises. A record
    without a number or target has nulls there; a row that is selected twice is
    read twice; an empty selection gives no rows. Other columns of the index
    are not looked at.
    """

    def fetch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        have = data = None
        for pdf in batches:
            for uri, rows in pdf.groupby("archive", sort=False):
                if uri != have:
                    if data is not None:
                        data.close()
                    store, path = filesystem(uri)
                    data, have = store.open_input_file(path), uri
                begin = rows["offset"].tolist()
                end = (rows["offset"] + rows["length"]).tolist()
                at = 0
                while at < len(begin):
                    upto = at + 1
                    while upto < len(begin) and begin[upto] - end[upto - 1] <= gap and end[upto] - begin[at] <= most:
                        upto += 1
                    raw, out = data.read_at(end[upto - 1] - begin[at], begin[at]), []
                    for a, b in zip(begin[at:upto], end[at:upto], strict=True):
                        f = parse(zlib.decompress(raw[a - begin[at] : b - begin[at]], 31))
                        digest, kind = f["WARC-Payload-Digest"].removeprefix("sha1:"), f["WARC-Type"]
                        if kind == "response" and digest_of(f["payload"]) != digest:
                            raise ValueError(f"{uri} at {a}: the payload doesn't have its digest")
                        out.append((
                            _number(f["WARC-Record-ID"]), f.get("WARC-Target-URI"), f["payload"] if payloads else None, f["payload_bytes"],
                            digest, kind, _number(f.get("WARC-Refers-To"))))
                    pdf_out = pd.DataFrame(out, columns=[c.split()[0] for c in _READ.split(", ")])
                    yield pdf_out.astype({"page_id": "Int64", "refers_to": "Int64"})
                    at = upto
        if data is not None:
            data.close()

    return dealt(index.select("archive", "offset", "length"), "archive", "offset", F.col("length"), each).mapInPandas(fetch, _READ)
