"""WARC archives, index first.

Each task writes its records to an archive of its own and returns an index row per record: path, offset,
length, URL and digest. Readers sort the index rows they want by place and coalesce neighbouring byte
ranges, so an archive is read in few large pieces, whatever was selected.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator

import pandas as pd
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm.common import bounded_batches, hinted, materialize, new_path

#: Payloads of fewer bytes are stored again instead of being revisited.
LEAST_REVISIT = 1000
#: Ranges closer than GAP are read as one, up to MOST bytes; an archive is closed at ARCHIVE bytes.
GAP, MOST, ARCHIVE = 64 << 10, 8 << 20, 256 << 20
#: Bytes of archives that one reading task takes. Index rows are small, so their own size says nothing of the work.
READ_TASK = 64 << 20
_DATE = "1970-01-01T00:00:00Z"
_INDEX = "page_id long, url string, path string, offset long, length long, digest string"


def _open(uri: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a folder or file in the shared store: local, HDFS, S3 or another that Arrow knows."""
    return pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def record(page: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC/1.1 record, response or (with refers_to) revisit; a revisit has no payload but tells its size and digest."""
    revisit = refers_to is not None
    body = b"" if revisit else payload
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{'' if page is None else page}>", f"WARC-Date: {_DATE}",
        f"WARC-Target-URI: {re.sub(r'[\r\n]', ' ', url or '')}", f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {len(payload)}",
        *([f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"] if revisit else []),
        "Content-Type: text/html; charset=utf-8", f"Content-Length: {len(body)}", "", "",
    ]
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + body + b"\r\n\r\n"


def parse(raw: bytes) -> dict:
    """A record's fields and payload; its framing and, for responses, its payload's digest are verified."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    first, *lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines)
    size = int(fields["Content-Length"])
    if first != "WARC/1.1" or rest[size:] != b"\r\n\r\n":
        raise ValueError("a WARC record is cut off or not where its index row says")
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if fields["WARC-Type"] == "response" and hashlib.sha1(rest[:size]).hexdigest() != digest:
        raise ValueError(f"the payload of {fields['WARC-Record-ID']} doesn't match its digest")
    number = lambda x: int(m[1]) if x and (m := re.search(r"urn:page:(-?\d+)", x)) else None
    return {
        "page_id": number(fields["WARC-Record-ID"]), "url": fields["WARC-Target-URI"], "payload_bytes": int(fields["X-Payload-Length"]), "payload_digest": digest,
        "record_type": fields["WARC-Type"], "refers_to": number(fields.get("WARC-Refers-To")), "payload": rest[:size],
    }


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Write a record per page (page_id, url, html) to archives in `folder`; the written index, a row per record.

    Of equal payloads of LEAST_REVISIT bytes or more, the one with the largest page_id is the response and
    the others revisit it; only digests and ids are shuffled to find that, summed up per task first. Pages
    with an equal payload and the same id (repeated rows) are all responses; so are pages of which none has
    an id. A null payload is empty. Archives are compressed record by record, so each can be read alone. A
    task that runs again writes new archives; the index names those of the attempt that counted.
    """
    spark = pages.sparkSession
    bounded_batches(spark)
    ready = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "utf-8").alias("payload"))
    ready = ready.withColumn("digest", F.sha1("payload"))
    equal = ready.where(F.octet_length("payload") >= LEAST_REVISIT).groupBy("digest").agg(F.max("page_id").alias("largest"), F.count("*").alias("n"))
    equal = materialize(equal.where("n > 1 and largest is not null").select("digest", "largest"), "equal-payloads")
    marked = ready.join(hinted(equal), "digest", "left").withColumn("refers_to", F.when(~F.col("page_id").eqNullSafe(F.col("largest")), F.col("largest")))

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, root = _open(folder)
        fs.create_dir(root, recursive=True)
        packer, out, path, at = zstandard.ZstdCompressor(level=3), None, "", 0
        for pdf in batches:
            rows = []
            for page, url, payload, digest, refers in zip(pdf["page_id"], pdf["url"], pdf["payload"], pdf["digest"], pdf["refers_to"], strict=True):
                if out is None or at > ARCHIVE:
                    if out is not None:
                        out.close()
                    path, at = f"{folder}/{uuid.uuid4().hex}.warc.zst", 0
                    out = fs.open_output_stream(f"{root}/{path.rpartition('/')[2]}", compression=None)
                page = None if pd.isna(page) else int(page)
                packed = packer.compress(record(page, url, bytes(payload), digest, None if pd.isna(refers) else int(refers)))
                out.write(packed)
                rows.append((page, url, path, at, len(packed), digest))
                at += len(packed)
            yield pd.DataFrame({"page_id": pd.array([r[0] for r in rows], "Int64")} | {c: [r[k] for r in rows] for k, c in ((1, "url"), (2, "path"), (3, "offset"), (4, "length"), (5, "digest"))})
        if out is not None:
            out.close()

    # Ids stay exact although pandas has no null integers: they come as nullable strings.
    as_text = marked.select(F.col("page_id").cast("string").alias("page_id"), "url", "payload", "digest", F.col("refers_to").cast("string").alias("refers_to"))
    return materialize(as_text.mapInPandas(write, _INDEX), "warc-index")


def read_records(index: DataFrame, columns: str = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary") -> DataFrame:
    """Read the records that index rows name, `columns` of them. Rows are dealt and sorted by archive and offset; near ranges are read as one."""
    names = [c.split()[0] for c in columns.split(", ")]

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        unpack = zstandard.ZstdDecompressor()
        file, open_path = None, None
        for pdf in batches:
            places = list(zip(pdf["path"], pdf["offset"].astype(int), pdf["length"].astype(int), strict=True))
            rows, k = [], 0
            while k < len(places):
                path, begin, length = places[k]
                end, to = begin + length, k + 1
                while to < len(places) and places[to][0] == path and end <= places[to][1] <= end + GAP and places[to][1] + places[to][2] - begin <= MOST:
                    end, to = places[to][1] + places[to][2], to + 1
                if path != open_path:
                    fs, inside = _open(path)
                    file, open_path = fs.open_input_file(inside), path
                block = memoryview(file.read_at(end - begin, begin))
                for _, offset, size in places[k:to]:
                    rows.append(parse(unpack.decompress(block[offset - begin : offset - begin + size])))
                k = to
            out = {c: [r[c] for r in rows] for c in names}
            yield pd.DataFrame({c: pd.array(v, "Int64") if c in ("page_id", "refers_to", "payload_bytes") else v for c, v in out.items()})

    total = index.agg(F.sum("length")).first()[0] or 0
    tasks = max(index.sparkSession.sparkContext.defaultParallelism, -(-total // READ_TASK))
    placed = index.select("path", "offset", "length").repartitionByRange(tasks, "path", "offset").sortWithinPartitions("path", "offset")
    return placed.mapInPandas(read, columns)


def archive_and_read(pages: DataFrame) -> DataFrame:
    """Write every page to archives in the shared folder and read all of them back: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    index = write_archives(pages, new_path(pages.sparkSession, "warc"))
    return read_records(index, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


ORACLE = f"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
d AS (SELECT page_id, octet_length(body) AS n, sha1(body) AS digest FROM p),
m AS (SELECT *, max(page_id) OVER (PARTITION BY digest) AS largest FROM d)
SELECT page_id, n AS payload_bytes, digest AS payload_digest, CASE WHEN n >= {LEAST_REVISIT} AND page_id IS DISTINCT FROM largest AND largest IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= {LEAST_REVISIT} AND page_id IS DISTINCT FROM largest AND largest IS NOT NULL THEN largest END AS refers_to FROM m
"""
