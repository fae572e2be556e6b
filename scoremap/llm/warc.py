"""WARC archives: one gzip member per record, written by tasks and read back by
tasks that each own a byte range.

A reading task scans its range for the gzip magic, accepts a candidate only if it
inflates to a WARC header, and owns the records whose first byte lies inside; the
last record may run past the end of the range. No index and no record count is
needed, so one archive of any size is read by as many tasks as it has ranges.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scoremap.llm.common import materialize, row_id, shared_dir, small_side

RANGE_BYTES = 8 << 20
READ_BYTES = 1 << 20
MAGIC = b"\x1f\x8b\x08"
#: Payloads below this many bytes are never revisits.
MIN_REVISIT_BYTES = 0
RECORD = "record_id string, uri string, record_type string, refers_to string, payload_digest string, digest_ok boolean, payload_bytes long, payload binary, http_status int, origin string, start long"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _header(value: str | None) -> str:
    """A header value on one line."""
    return " ".join((value or "").split())


def record(record_id: str, uri: str | None, payload: bytes, refers_to: str | None) -> bytes:
    """One gzip member: a response with its payload, or a revisit without."""
    body = b"" if refers_to is not None else payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:row:{record_id}>",
        f"WARC-Target-URI: {_header(uri)}",
        "WARC-Date: 2000-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha1:{digest(payload)}",
        f"X-Payload-Length: {len(payload)}",
        "Content-Type: text/html",
        f"Content-Length: {len(body)}",
    ]
    if refers_to is not None:
        lines.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        lines.append(f"WARC-Refers-To: <urn:row:{refers_to}>")
    raw = "\r\n".join(lines).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"
    packer = zlib.compressobj(3, zlib.DEFLATED, 31)
    return packer.compress(raw) + packer.flush()


def write_archives(rows: DataFrame, folder: str) -> DataFrame:
    """Write ``record_id string, uri string, payload binary, refers_to string`` rows
    as archives, one per task, and return the manifest ``path, bytes``.

    Each attempt of a task writes a file of its own; the manifest names only those
    of the attempts that Spark counted, so a lost executor leaves no half records.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pafs.FileSystem.from_uri(folder)
        fs.create_dir(base, recursive=True)
        path, size, out = f"{base}/{uuid.uuid4().hex}.warc.gz", 0, None
        for batch in batches:
            for r, u, p, f in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                out = out or fs.open_output_stream(path, compression=None)
                member = record(r, u, p or b"", f)
                out.write(member)
                size += len(member)
        if out:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([path.rpartition("/")[2]]), pa.array([size])], names=["name", "bytes"])

    made = rows.select("record_id", "uri", "payload", "refers_to").mapInArrow(write, "name string, bytes long")
    return materialize(made.select(F.concat(F.lit(folder + "/"), F.col("name")).alias("path"), "bytes"), "manifest")


class _Window:
    """Bytes of a file from ``start`` on, read in blocks and forgotten on the way.
    ``data[at - base]`` is the byte at ``at`` of the file."""

    def __init__(self, file, start: int):
        self.file, self.base, self.data = file, start, bytearray()
        file.seek(start)

    def more(self) -> bool:
        block = self.file.read(READ_BYTES)
        self.data += block
        return bool(block)

    def drop(self, upto: int) -> None:
        """Forget what lies before ``upto``, some blocks at a time."""
        if upto - self.base >= 4 * READ_BYTES:
            del self.data[: upto - self.base]
            self.base = upto


def _inflate(w: _Window, at: int) -> tuple[bytes, int] | None:
    """The member at ``at`` and where it ends; None if it is no WARC record."""
    unpack, parts, size, pos, known = zlib.decompressobj(31), [], 0, at, False
    while not unpack.eof:
        if pos - w.base >= len(w.data) and not w.more():
            return None
        block = bytes(w.data[pos - w.base : pos - w.base + (1 << 16)])
        try:
            got = unpack.decompress(block)
        except zlib.error:
            return None
        pos += len(block) - len(unpack.unused_data)
        parts.append(got)
        size += len(got)
        if not known and size >= 7:
            if not b"".join(parts)[:7].startswith(b"WARC/1."):
                return None
            known = True
    return (b"".join(parts), pos) if known else None


def _fields(head: bytes) -> dict[str, str]:
    """The named fields behind the first line, continued lines joined."""
    text = head.decode("utf-8", "replace").replace("\r\n", "\n")
    lines = re.sub(r"\n[ \t]+", " ", text).split("\n")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}


def _unchunked(body: bytes) -> bytes:
    """A body sent in chunks, put together; as it is where it breaks off."""
    out, at = [], 0
    while (end := body.find(b"\r\n", at)) >= 0:
        size = body[at:end].partition(b";")[0].strip()
        if not re.fullmatch(rb"[0-9a-fA-F]+", size):
            return body
        n = int(size, 16)
        if n == 0:
            return b"".join(out)
        out.append(body[end + 2 : end + 2 + n])
        at = end + 4 + n
    return b"".join(out) if out else body


def _sha1(value: str | None) -> str | None:
    """The base32 SHA-1 that a digest header names, be it in base32 or hex."""
    kind, _, text = (value or "").rpartition(":")
    if kind.lower() not in ("", "sha1") or not text:
        return None
    return base64.b32encode(bytes.fromhex(text)).decode() if re.fullmatch(r"[0-9a-fA-F]{40}", text) else text.upper()


def parse(raw: bytes) -> dict | None:
    """The fields of RECORD that an inflated member holds; None if it is no record.

    The payload of an HTTP response is its body; other records have their block as
    payload. The digest is that of the payload read, a revisit's the one that its header
    names; ``digest_ok`` says
    whether header and payload agree, as sent or with chunks put together (null if
    the header has none, or for a revisit, which has no payload)."""
    head, found, body = raw.partition(b"\r\n\r\n")
    h = _fields(head)
    if not found or not h.get("content-length", "").isdigit():
        return None
    n = int(h["content-length"])
    payload, status = body[:n], None
    if len(payload) < n:
        return None
    kind, said = h.get("warc-type"), _sha1(h.get("warc-payload-digest"))
    sent = payload
    if h.get("content-type", "").lower().startswith("application/http") and kind in ("response", "revisit"):
        first, _, sent = payload.partition(b"\r\n\r\n")
        got = re.match(rb"HTTP/[\d.]+ (\d{3})", first)
        status = int(got[1]) if got else None
        payload = _unchunked(sent) if "chunked" in _fields(first).get("transfer-encoding", "").lower() else sent
    own = digest(payload)
    ok = None if said is None or kind == "revisit" else said in (own, digest(sent))
    urn = lambda x: x.removeprefix("<").removesuffix(">").removeprefix("urn:row:") if x is not None else None
    full = h.get("x-payload-length", "")
    return {
        "record_id": urn(h.get("warc-record-id")), "uri": h.get("warc-target-uri"), "record_type": kind, "refers_to": urn(h.get("warc-refers-to")), "payload_digest": said or own if kind == "revisit" else own, "digest_ok": ok,
        "payload": payload, "payload_bytes": int(full) if full.isdigit() else len(payload), "http_status": status,
    }


def records_in(file, start: int, end: int) -> Iterator[tuple[int, dict]]:
    """The records whose first byte lies in [start, end)."""
    w, at = _Window(file, start), start
    while True:
        while (i := w.data.find(MAGIC, at - w.base)) < 0:
            at = max(at, w.base + len(w.data) - len(MAGIC) + 1)
            w.drop(at)
            if at >= end or not w.more():
                return
        at = w.base + i
        if at >= end:
            return
        if (got := _inflate(w, at)) and (fields := parse(got[0])):
            yield at, fields
            at = got[1]
        else:
            at += 1
        w.drop(at)


def read_archives(manifest: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """RECORD rows of the archives of a ``path, bytes`` manifest, in any order.

    An empty manifest gives no rows, archives that stand there twice give their
    records twice, and bytes that are no WARC record are skipped. Any record type is
    returned, whatever its digest says (``digest_ok``). Records are held whole, one at
    a time, so a payload has to fit in a task. ``payload_bytes`` is the full payload's
    length for revisits that this module wrote too."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in RECORD.split(", ")]
        kinds = [pa.string()] * 5 + [pa.bool_(), pa.int64(), pa.binary(), pa.int32(), pa.string(), pa.int64()]
        give = lambda rows: pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], k) for n, k in zip(names, kinds, strict=True)], names=names)
        for batch in batches:
            for path, start, end in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                fs, name = pafs.FileSystem.from_uri(path)
                rows, size = [], 0
                with fs.open_input_file(name) as file:
                    for at, fields in records_in(file, start, end):
                        rows.append(fields | {"origin": path, "start": at})
                        size += len(fields["payload"])
                        if size > 4 << 20 or len(rows) >= 4000:
                            yield give(rows)
                            rows, size = [], 0
                if rows:
                    yield give(rows)

    step = F.lit(range_bytes)
    ranges = manifest.where("bytes > 0").select("path", F.explode(F.sequence(F.lit(0).cast("long"), F.col("bytes") - 1, step.cast("long"))).alias("start"), "bytes")
    ranges = ranges.select("path", "start", F.least(F.col("start") + step, F.col("bytes")).alias("end"))
    spark: SparkSession = manifest.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return ranges.repartition(tasks, "path", "start").mapInArrow(read, RECORD)


def plan_revisits(pages: DataFrame, id_col: str, payload_col: str, min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """``_rid, refers_to`` of the rows that revisit another: equal payloads (SHA-256
    and length), at least ``min_bytes`` long; the smallest id is the response, null
    ids come last, and of rows that share an id only one is the response."""
    slim = row_id(pages.select(F.col(id_col).alias("_id"), F.coalesce(F.encode(F.col(payload_col), "UTF-8"), F.lit(b"")).alias("_p")))
    sized = slim.select("_rid", "_id", F.sha2("_p", 256).alias("h"), F.octet_length("_p").alias("n")).where(F.col("n") >= min_bytes)
    first = F.min(F.struct(F.col("_id").isNull().alias("no"), F.col("_id").alias("id"), F.col("_rid").alias("rid")))
    sized = materialize(sized, "digests")
    groups = sized.groupBy("h", "n").agg(F.count("*").alias("k"), first.alias("f")).where("k > 1").select("h", "n", F.col("f.id").alias("first"), F.col("f.rid").alias("first_rid"))
    # written first, so that Spark can split the rows of a large group in the join
    groups = materialize(groups, "groups")
    return sized.join(small_side(groups), ["h", "n"]).where(F.col("_rid") != F.col("first_rid")).select("_rid", F.col("first").cast("string").alias("refers_to"), F.lit(True).alias("_again"))


def archive_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """Write every row as a record and return the manifest.

    Null html is an empty payload, a null url an empty header, a null id an empty
    record id; other columns are left out whatever their names. Equal payloads, empty
    ones included, are written once; rows that are equal in all columns are a response
    and its revisits. Payloads of any length are written whole. An empty table gives
    an empty manifest."""
    again = materialize(plan_revisits(pages, id_col, html_col, min_bytes), "revisits")
    slim = row_id(pages.select(F.col(id_col).alias("_id"), F.col(url_col).alias("_url"), F.col(html_col).alias("_p")))
    rows = slim.join(small_side(again), "_rid", "left").select(
        F.coalesce(F.col("_id").cast("string"), F.lit("")).alias("record_id"),
        F.col("_url").alias("uri"),
        F.coalesce(F.encode(F.col("_p"), "UTF-8"), F.lit(b"")).alias("payload"),
        F.when(F.col("_again"), F.coalesce("refers_to", F.lit(""))).alias("refers_to"),
    )
    return write_archives(rows, f"{shared_dir(pages.sparkSession)}/warc")
