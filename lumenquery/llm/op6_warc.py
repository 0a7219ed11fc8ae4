"""WARC: archives written record by record, and a splittable reader.

Writing: the payload's SHA-1 finds equal payloads; of those of MIN_REVISIT
bytes or more the record of the largest page_id holds the payload, the others
become revisit records that refer to it.  Each record is a gzip member of its
own.  A task writes its rows into files of its own; only files of finished
attempts are listed in the manifest.

Reading: each file is cut into ranges of SPLIT bytes.  A task scans its range
for the gzip magic, takes a candidate as a member only if what it holds begins
with a WARC version line and a whole header of well-formed fields, and owns the
records whose member starts inside its range, however far they reach beyond it.
Behind a member that was read the scan goes on at its end.

Defined results: null html is an empty payload; records with no equal or of
fewer bytes are responses; rows that share the largest page_id and the payload
are all responses; null page_ids count as smallest; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator
from datetime import UTC, datetime

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, new_folder
from .files import read_range, write_bytes

MIN_REVISIT, SPLIT, MEMBER_MAGIC = 1000, 4 << 20, b"\x1f\x8b\x08"
#: How much of a candidate is read at first; the reads of a long member double.
PIECE = 1 << 16
#: A version line and fields, which may go on in lines that begin with white space.
HEADER = re.compile(rb"WARC/1\.[01]\r\n((?:[!-9;-~]+:[^\r\n]*\r\n(?:[ \t][^\r\n]*\r\n)*)+)\r\n")
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"


def roles(pages: DataFrame) -> DataFrame:
    """pages with payload, payload_digest, payload_bytes, record_type, refers_to."""
    p = pages.withColumn("payload", F.coalesce(F.col("html"), F.lit("")).cast("binary"))
    p = p.withColumn("payload_digest", F.sha1("payload")).withColumn("payload_bytes", F.octet_length("payload").cast("long"))
    groups = p.where(F.col("payload_bytes") >= MIN_REVISIT).groupBy(F.col("payload_digest").alias("g")).agg(F.max("page_id").alias("first"), F.count("*").alias("n")).where("n > 1")
    groups = materialize(groups.select("g", "first"), "warc-groups")
    p = p.join(groups, F.col("payload_digest") == F.col("g"), "left")
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return p.select(
        "page_id", "url", "payload_digest", "payload_bytes",
        F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("first")).alias("refers_to"),
        F.when(~revisit, F.col("payload")).alias("payload"),
    )


def record(page_id, url, digest, size, kind, refers_to, payload, date: str) -> bytes:
    """One WARC record as a gzip member: an HTTP response, of a revisit its head only; the digest is of the payload."""
    fields = {
        "WARC-Type": kind, "WARC-Record-ID": f"<urn:page:{page_id}>", "WARC-Date": date, "WARC-Target-URI": re.sub(r"[\r\n]+", " ", url or ""),
        "WARC-Payload-Digest": f"sha1:{digest}", "WARC-Payload-Length": size, "Content-Type": "application/http; msgtype=response",
    }
    if kind == "revisit":
        fields |= {"WARC-Refers-To": f"<urn:page:{refers_to}>", "WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"}
    block = HTTP + f"Content-Length: {size}\r\n\r\n".encode() + (payload or b"")
    fields["Content-Length"] = len(block)
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields.items()) + "\r\n"
    gz = zlib.compressobj(1, zlib.DEFLATED, 31)
    return gz.compress(head.encode() + block + b"\r\n\r\n") + gz.flush()


def write(pages: DataFrame) -> DataFrame:
    """Write archives; their manifest (uri, size)."""
    folder = new_folder(pages.sparkSession, "warc")
    date = datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = 0

        def members():
            nonlocal size
            for batch in batches:
                for i in range(0, batch.num_rows, 256):
                    some = batch.slice(i, 256)
                    for row in zip(*(some.column(c).to_pylist() for c in ("page_id", "url", "payload_digest", "payload_bytes", "record_type", "refers_to", "payload")), strict=True):
                        size += len(out := record(*row, date))
                        yield out

        uri = write_bytes(folder, "part", members())
        if size:
            yield pa.RecordBatch.from_arrays([pa.array([uri]), pa.array([size])], ["uri", "size"])

    return materialize(roles(pages).mapInArrow(work, "uri string, size long"), "warc-manifest")


def opened(data: bytes, more) -> tuple[dict[str, str], bytes, int] | None:
    """Header (names in lower case), block and length of the gzip member that data begins with; None if it holds no WARC record.

    more(n) gives n bytes behind data.
    """
    gz, out, used, step = zlib.decompressobj(31), bytearray(), 0, PIECE
    fields = None
    while True:
        try:
            out += gz.decompress(data)
        except zlib.error:
            return None
        used += len(data) - len(gz.unused_data)
        if fields is None and (found := HEADER.match(out)):
            lines = re.sub(r"\r\n[ \t]+", " ", found[1].decode("utf-8", "replace")).split("\r\n")[:-1]
            fields = {k.lower(): v.strip() for k, v in (x.split(":", 1) for x in lines)}
        if fields is None and (len(out) > 1 << 20 or (len(out) >= 7 and not out.startswith(b"WARC/1."))):
            return None
        if gz.eof:
            break
        if not (data := more(used, step)):
            return None
        step = min(step * 2, 8 << 20)
    if fields is None or not fields.get("content-length", "").isdigit():
        return None
    size = int(fields["content-length"])
    body = out[found.end() :] if (found := HEADER.match(out)) else b""
    return (fields, bytes(body[:size]), used) if len(body) == size + 4 and body.endswith(b"\r\n\r\n") else None


def records(uri: str, start: int, end: int) -> Iterator[tuple[dict[str, str], bytes]]:
    """The records whose members start in [start, end)."""
    data = read_range(uri, start, end - start + len(MEMBER_MAGIC) - 1)
    view, at = memoryview(data), 0
    while (at := data.find(MEMBER_MAGIC, at)) >= 0 and start + at < end:
        tail = view[at:]
        got = opened(tail[:PIECE], lambda used, n, at=at, tail=tail: tail[used : used + n] if used + n <= len(tail) else read_range(uri, start + at + used, n))
        if got is None:
            at += 1
            continue
        yield got[0], got[1]
        at += got[2]


RESULT = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, intact boolean"


def read(manifest: DataFrame, split: int = SPLIT) -> DataFrame:
    """All records of the archives, in RESULT.

    The payload of an HTTP record is what follows its head; length and digest are the payload's own, of a revisit those
    that its header gives (length null where it gives none).  page_id and refers_to are null for ids that write() didn't
    make.  intact: the payload has the digest and length that its header gives, in hex or base 32, as far as it gives them.
    """
    at = F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(split).cast("long")))
    ranges = manifest.select("uri", "size", at.alias("start")).withColumn("end", F.least(F.col("start") + split, F.col("size"))).drop("size")
    tasks = max(2, int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def number(x: str | None) -> int | None:
        found = re.fullmatch(r"<urn:page:(-?\d+)>", x or "")
        return int(found[1]) if found else None

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in RESULT.split(", ")]
        types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.bool_()]
        for batch in batches:
            for uri, start, end in zip(*(batch.column(c).to_pylist() for c in ("uri", "start", "end")), strict=True):
                rows = []
                for f, payload in records(uri, start, end):
                    if f.get("content-type", "").lower().startswith("application/http"):
                        payload = payload.partition(b"\r\n\r\n")[2]
                    kind, said = f.get("warc-type"), f.get("warc-payload-digest")
                    said = None if said is None else said.lower().removeprefix("sha1:")
                    length = int(n) if (n := f.get("warc-payload-length", "")).isdigit() else None
                    if kind == "revisit":
                        size, digest, intact = length, said, not payload
                    else:
                        own = hashlib.sha1(payload)
                        size, digest = len(payload), own.hexdigest()
                        intact = length in (None, size) and said in (None, digest, base64.b32encode(own.digest()).decode().lower())
                    rows.append((number(f.get("warc-record-id")), size, digest, kind, number(f.get("warc-refers-to")), f.get("warc-target-uri"), intact))
                columns = list(zip(*rows, strict=True)) or [()] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    return ranges.repartition(tasks, "uri", "start").mapInArrow(work, RESULT)


def query(spark, sf_dir: str) -> DataFrame:
    return read(write(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")))


#: The contract's rows from the pages alone; url as the header holds it, intact as a right reader finds it.
ORACLE = r"""
WITH p AS (SELECT page_id, url, coalesce(html, '') AS h FROM pages), d AS (SELECT page_id, url, strlen(h) AS n, sha1(h) AS d FROM p),
g AS (SELECT d, max(page_id) AS f FROM d WHERE n >= 1000 GROUP BY d HAVING count(*) > 1)
SELECT page_id, n AS payload_bytes, d.d AS payload_digest, CASE WHEN f IS NOT NULL AND f <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
CASE WHEN f <> page_id THEN f END AS refers_to, regexp_replace(url, '[\r\n]+', ' ', 'g') AS url, true AS intact FROM d LEFT JOIN g ON g.d = d.d
"""
