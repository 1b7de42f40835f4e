"""WARC archives: written with an index first, read back by coalesced byte ranges of it.

Each task writes archives of its own under the shared folder, a gzip member for each
record, and gives an index row (path, offset, length, url, digest) for each. The index is
materialised once, so a lost task leaves at most an archive that no index row names. Reading
takes rows of an index, deals them out by path and offset, joins neighbouring ranges and
reads each run at once. Paths may be in any store that Arrow's file systems reach.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import zlib
from collections.abc import Iterator
from uuid import uuid4

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared

INDEX = "page_id long, url string, path string, offset long, length long, payload_digest string, record_type string"
RECORDS = (
    "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, html string"
)


def _store(path: str):
    from pyarrow import fs

    path = re.sub(r"^file:/+", "/", path)
    return (fs.LocalFileSystem(), path) if path.startswith("/") else fs.FileSystem.from_uri(path)


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload, usedforsecurity=False).digest()).decode()


def _urn(page_id) -> str:
    return f"<urn:page:{'null' if pd.isna(page_id) else int(page_id)}>"


def _record(page_id, url: str | None, html: str | None, refers_to, date: str) -> tuple[bytes, str, str]:
    payload = (html or "").encode("utf-8", "surrogatepass")
    mark, kind = digest(payload), "response" if pd.isna(refers_to) else "revisit"
    head = [
        "WARC/1.0", f"WARC-Type: {kind}", f"WARC-Record-ID: {_urn(page_id)}", f"WARC-Date: {date}",
        f"WARC-Payload-Digest: sha1:{mark}", "Content-Type: application/http; msgtype=response",
    ]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A"))
    if kind == "revisit":
        head += [f"WARC-Refers-To: {_urn(refers_to)}", "WARC-Profile: http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"]
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if kind == "response" else b"")
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n", mark, kind


def _writer(folder: str, date: str, roll: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, at = _store(folder)
        store.create_dir(at, recursive=True)
        out, path, offset = None, None, 0
        for b in batches:
            rows = []
            for page_id, url, html, refers_to in zip(b["page_id"], b["url"], b["html"], b["refers_to"], strict=True):
                if out is None or offset >= roll:
                    if out:
                        out.close()
                    name = f"{uuid4().hex}.warc.gz"
                    out, path, offset = store.open_output_stream(f"{at}/{name}", compression=None), f"{folder}/{name}", 0
                raw, mark, kind = _record(page_id, url, html, refers_to, date)
                raw = gzip.compress(raw, 6, mtime=0)
                out.write(raw)
                rows.append((page_id, url, path, offset, len(raw), mark, kind))
                offset += len(raw)
            yield _frame(rows, INDEX)
        if out:
            out.close()

    return run


def _frame(rows: list[tuple], schema: str) -> pd.DataFrame:
    names = [c.split() for c in schema.split(", ")]
    got = pd.DataFrame(rows, columns=[n for n, _ in names], dtype=object)
    return got.astype({n: "Int64" for n, kind in names if kind == "long"})


def revisits(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """pages (page_id, url, html) with refers_to: the smallest page_id of equal payloads of at least min_bytes, null for itself."""
    html = F.coalesce("html", F.lit(""))
    rows = pages.select("page_id", "url", "html", F.sha1(html.cast("binary")).alias("sha"), F.octet_length(html).alias("n"))
    first = rows.where(F.col("n") >= min_bytes).groupBy(F.col("sha").alias("sha0")).agg(F.min("page_id").alias("first"), F.count("*").alias("c"))
    first = shared.cut(first.where("c > 1").drop("c"))
    other = (F.col("n") >= min_bytes) & ~F.col("page_id").eqNullSafe(F.col("first"))
    return rows.join(shared.small(first), F.col("sha") == F.col("sha0"), "left").select(
        "page_id", "url", "html", F.when(other, F.col("first")).alias("refers_to")
    )


def write(pages: DataFrame, folder: str | None = None, min_bytes: int = 0, date: str = "1970-01-01T00:00:00Z", roll: int = 256 << 20) -> DataFrame:
    """Write a record for each row of pages (page_id, url, html) and return the index, already materialised.

    Of equal payloads the record with the smallest page_id is a response and the others revisit it; null html
    is an empty payload. Rows that repeat the smallest id are responses too. A null page_id revisits the smallest
    id of its payload, or is a response if there is none. Extra columns are ignored. An empty table gives an empty index.
    """
    folder = folder or f"{shared.shared_dir(pages.sparkSession)}/warc-{uuid4().hex}"
    return shared.cut(revisits(pages, min_bytes).mapInPandas(_writer(folder, date, roll), INDEX))


def _parsed(raw: bytes) -> tuple:
    raw = zlib.decompress(raw, wbits=31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode("utf-8", "surrogatepass").split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    stated = int(re.search(rb"Content-Length: (\d+)", http)[1])
    mark = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    kind = fields["WARC-Type"]
    if kind == "response" and (len(payload) != stated or digest(payload) != mark):
        raise ValueError(f"record {fields['WARC-Record-ID']} does not match its digest")

    def page(urn: str | None):
        got = urn and urn.removeprefix("<urn:page:").rstrip(">")
        return None if got in (None, "null") else int(got)

    url = fields.get("WARC-Target-URI")
    url = url and url.replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%")
    html = payload.decode("utf-8", "surrogatepass") if kind == "response" else None
    return page(fields["WARC-Record-ID"]), url, kind, page(fields.get("WARC-Refers-To")), stated, mark, html


def _reader(gap: int, most: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, last, file = None, None, None
        for b in batches:
            spans: list[list] = []  # path, start, end, records
            for path, offset, length in zip(b["path"], b["offset"], b["length"], strict=True):
                top = spans[-1] if spans else None
                if top and top[0] == path and 0 <= offset - top[2] <= gap and offset + length - top[1] <= most:
                    top[2] = offset + length
                    top[3].append((offset, length))
                else:
                    spans.append([path, offset, offset + length, [(offset, length)]])
            for path, start, end, records in spans:
                if path != last:
                    store, at = _store(path)
                    file, last = store.open_input_file(at), path
                raw = file.read_at(end - start, start)
                yield _frame([_parsed(raw[o - start : o - start + n]) for o, n in records], RECORDS)

    return run


def read(index: DataFrame, gap: int = 1 << 16, most: int = 8 << 20) -> DataFrame:
    """The records that the rows of an index name: page_id, url, record_type, refers_to, payload_bytes, payload_digest, html.

    Ranges at most ``gap`` bytes apart are read at once, up to ``most`` bytes. A response's digest is verified;
    a revisit states the bytes and digest of the full payload and has no html.
    """
    parts = int(index.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    at = index.select("path", "offset", "length").repartitionByRange(parts, "path", "offset").sortWithinPartitions("path", "offset")
    return at.mapInPandas(_reader(gap, most), RECORDS)


def round_trip(pages: DataFrame) -> DataFrame:
    """What the archives say of each page, without html; the archives are deleted once they have been read."""
    spark = pages.sparkSession
    folder = f"{shared.shared_dir(spark)}/warc-{uuid4().hex}"
    try:
        return shared.cut(read(write(pages, folder)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"))
    finally:
        shared.remove(spark, folder)
