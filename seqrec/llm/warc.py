"""WARC archives: written from pages, read back and assembled into one row per capture.

Every page gives three records: the request, the capture (``response``, or
``revisit`` where an equal payload is archived already) and metadata. Request
and metadata name the capture in ``WARC-Concurrent-To``; reading joins the
three through that identifier and emits one nested row.

Archives are text files compressed with gzip, whose rows end with the two line
breaks that end a record, so Spark's own writer and reader move them, in any
store. A compressed file is read by one task from start to end; records are
cut by their ``Content-Length``, so a payload may hold anything, and memory is
bounded by one record and one batch.

Defined cases: null html is an empty payload; payloads below ``MIN_REVISIT``
bytes are always responses; of equal payloads the smallest page id is the
response (all rows of that id are), and rows with a null id are revisits of
it, or responses if no row has an id; null urls have no target; line breaks in
urls are percent-encoded; rows equal in id, url and payload are one capture;
an archive that is cut off or damaged fails the job.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seqrec.llm.common import column
from seqrec.operators.skew import HOT_ROWS, spread_join

MIN_REVISIT = 100
# Fixed values of the format.
CRLF = "\r\n"
VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"


def _record_id(kind: str, *parts: Column) -> Column:
    """A name-based identifier: the same row always gets the same one."""
    digest = F.md5(F.to_json(F.struct(F.lit(kind).alias("k"), *[p.alias(f"p{i}") for i, p in enumerate(parts)])))
    cut = [F.substring(digest, at, n) for at, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cut), F.lit(">"))


def _record(headers: list[tuple[str, Column | str]], block: Column) -> Column:
    """One record without its final line breaks; headers with a null value are left out."""
    lines = [F.concat(F.lit(f"{name}: "), value if isinstance(value, Column) else F.lit(value))
             for name, value in headers]
    length = F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string"))
    return F.concat(F.concat_ws(CRLF, F.lit(VERSION), *lines, length), F.lit(CRLF * 2), block)


def first_holders(pages: DataFrame, min_bytes: int = MIN_REVISIT) -> DataFrame:
    """For each payload digest of several pages, the smallest page and the number of its rows."""
    held = pages.filter(F.col("payload_bytes") >= min_bytes).groupBy("payload_digest").agg(
        F.min(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "url"))).alias("first"),
        F.count(F.lit(1)).alias("n_rows"))
    return held.filter((F.col("n_rows") > 1) & F.col("first").isNotNull())


def records(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", *,
            min_revisit: int = MIN_REVISIT, hot_rows: int = HOT_ROWS) -> DataFrame:
    """One ``value`` per page: its three records, the last one without the final line breaks."""
    payload = F.coalesce(column(html), F.lit(""))
    target = F.replace(F.replace(column(url), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    plain = pages.select(column(page_id).cast("long").alias("page_id"), target.alias("url"),
                         payload.alias("payload"), F.octet_length(payload).cast("long").alias("payload_bytes"),
                         F.sha2(payload, 256).alias("payload_digest"))
    holders = first_holders(plain.drop("payload"), min_revisit)
    placed = spread_join(plain, holders.select("payload_digest", "first"), ["payload_digest"], "left",
                         counts=holders.select("payload_digest", "n_rows"), hot_rows=hot_rows)
    is_revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first.page_id"))
    own = _record_id("capture", F.col("page_id"), F.col("url"), F.col("payload_digest"))
    first = _record_id("capture", F.col("first.page_id"), F.col("first.url"), F.col("payload_digest"))
    common = [("WARC-Date", DATE), ("WARC-Target-URI", F.col("url"))]
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "),
                    F.col("payload_bytes").cast("string"), F.lit(CRLF * 2))
    request = _record(
        [("WARC-Type", "request"), ("WARC-Record-ID", _record_id("request", own)), ("WARC-Concurrent-To", own),
         *common, ("Content-Type", "application/http; msgtype=request")],
        F.concat(F.lit("GET "), F.coalesce("url", F.lit("*")), F.lit(f" HTTP/1.1{CRLF}Accept: */*{CRLF * 2}")))
    capture = _record(
        [("WARC-Type", F.when(is_revisit, "revisit").otherwise("response")), ("WARC-Record-ID", own), *common,
         ("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("payload_digest"))),
         ("WARC-Profile", F.when(is_revisit, PROFILE)), ("WARC-Refers-To", F.when(is_revisit, first)),
         ("Content-Type", "application/http; msgtype=response")],
        F.concat(http, F.when(is_revisit, F.lit("")).otherwise(F.col("payload"))))
    fields = F.coalesce(F.concat(F.lit("pageId: "), F.col("page_id").cast("string")), F.lit(""))
    metadata = _record(
        [("WARC-Type", "metadata"), ("WARC-Record-ID", _record_id("metadata", own)), ("WARC-Concurrent-To", own),
         *common, ("Content-Type", "application/warc-fields")], F.concat(fields, F.lit(CRLF)))
    return placed.select(F.concat_ws(CRLF * 2, request, capture, metadata).alias("value"))


def write_archives(pages: DataFrame, path: str, page_id: str = "page_id", url: str = "url", html: str = "html", *,
                   min_revisit: int = MIN_REVISIT, hot_rows: int = HOT_ROWS) -> None:
    """Archives in the folder ``path``, one or more per task."""
    records(pages, page_id, url, html, min_revisit=min_revisit, hot_rows=hot_rows).write.option(
        "lineSep", CRLF * 2).option("compression", "gzip").text(path)


_FIELDS = pa.map_(pa.string(), pa.string())
_PARSED = pa.schema([("record_id", pa.string()), ("type", pa.string()), ("concurrent_to", pa.string()),
                     ("refers_to", pa.string()), ("target_uri", pa.string()), ("payload_bytes", pa.int64()),
                     ("payload_digest", pa.string()), ("fields", _FIELDS), ("payload", pa.binary())])
PARSED = ("record_id string, type string, concurrent_to string, refers_to string, target_uri string, "
          "payload_bytes long, payload_digest string, fields map<string,string>, payload binary")


def _named(lines: list[bytes]) -> dict[str, str]:
    pairs = (line.decode("utf-8", "replace").partition(":") for line in lines if b":" in line)
    return {name.strip().lower(): value.strip() for name, _, value in pairs}


class _Parser:
    """Cuts a stream of lines (without their line breaks) into records by their length."""

    def __init__(self, keep_payload: bool) -> None:
        self.keep_payload, self.header, self.block, self.left, self.closing = keep_payload, [], None, 0, 0

    def feed(self, line: bytes) -> dict | None:
        if self.block is not None:
            self.block.append(line)
            self.left -= len(line)
            if self.left > 0:
                self.left -= 2
                if self.left < 0:
                    raise ValueError("damaged archive: a record is longer than it says")
                return None
            if self.left < 0:
                raise ValueError("damaged archive: a record is longer than it says")
            done = self._finished(_named(self.header[1:]), self.block)
            self.header, self.block, self.closing = [], None, 1
            return done
        if self.closing:
            if line:
                raise ValueError("damaged archive: no line break after a record")
            self.closing = 0
        elif line or not self.header:
            if not self.header and not line.startswith(b"WARC/"):
                raise ValueError("damaged archive: no record where one should start")
            self.header.append(line)
        else:
            self.left, self.block = int(_named(self.header[1:])["content-length"]), []
        return None

    def at_rest(self) -> bool:
        return self.block is None and not self.header

    def _finished(self, names: dict[str, str], lines: list[bytes]) -> dict:
        block, kind = b"\r\n".join(lines), names.get("warc-type", "")
        row = {"record_id": names.get("warc-record-id"), "type": kind, "concurrent_to": names.get("warc-concurrent-to"),
               "refers_to": names.get("warc-refers-to"), "target_uri": names.get("warc-target-uri"),
               "payload_bytes": None, "payload_digest": None, "fields": None, "payload": None}
        if kind in {"response", "revisit"}:
            payload = block.partition(b"\r\n\r\n")[2]
            stated = names.get("warc-payload-digest", "").partition(":")[2] or None
            if kind == "response":
                row["payload_bytes"], row["payload_digest"] = len(payload), hashlib.sha256(payload).hexdigest()
                if stated is not None and stated != row["payload_digest"]:
                    raise ValueError(f"damaged archive: the digest of {row['record_id']} does not agree")
                row["payload"] = payload if self.keep_payload else None
            else:
                row["payload_digest"] = stated
        elif kind == "metadata":
            row["fields"] = list(_named(lines).items())
        return row


def read_records(spark: SparkSession, path: str, keep_payload: bool = True) -> DataFrame:
    """One row per record of all archives in a folder."""
    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser = _Parser(keep_payload)
        for batch in batches:
            rows = [row for line in batch.column(0) if (row := parser.feed(line.as_py())) is not None]
            yield pa.RecordBatch.from_pylist(rows, _PARSED)
        if not parser.at_rest():
            raise ValueError("damaged archive: it ends within a record")

    lines = spark.read.option("lineSep", CRLF).text(path)
    return lines.select(F.col("value").cast("binary")).mapInArrow(parse, PARSED)


def captures(parsed: DataFrame) -> DataFrame:
    """One nested row per capture: ``capture_id``, ``capture``, ``request``, ``metadata``.

    A record meets its capture under the identifier it is concurrent to, a
    capture under its own, in one shuffle. Of several requests or metadata
    records of a capture the smallest identifier counts; records without a
    capture give no row.
    """
    key = F.coalesce("concurrent_to", "record_id")
    is_capture = F.col("type").isin("response", "revisit")

    def one(when: Column, *names: str) -> Column:
        return F.min_by(F.when(when, F.struct(*names)), F.when(when, F.col("record_id")))

    rows = parsed.groupBy(key.alias("capture_id")).agg(
        one(is_capture, "record_id", "type", "refers_to", "target_uri", "payload_bytes", "payload_digest",
            "payload").alias("capture"),
        one(F.col("type") == "request", "record_id", "target_uri").alias("request"),
        one(F.col("type") == "metadata", "record_id", "fields").alias("metadata"))
    return rows.filter(F.col("capture").isNotNull())


def resolved(found: DataFrame) -> DataFrame:
    """``captures`` and ``original``: the capture a revisit refers to, with its metadata; null for responses.

    Revisits meet the response by its record identifier. Only identifiers and
    sizes move, no payload; Spark's skew join splits the revisits of one
    response. A revisit of a record that the archives lack has no original.
    """
    originals = found.filter(F.col("capture.type") == "response").select(
        F.col("capture_id").alias("original_id"),
        F.struct("capture_id", F.col("capture.payload_bytes").alias("payload_bytes"), "metadata").alias("original"))
    return found.join(originals, F.col("capture.refers_to") == F.col("original_id"), "left").drop("original_id")
