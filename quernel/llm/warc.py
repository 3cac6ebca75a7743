"""Derivative records of a WARC: from each response a metadata and a plain-text conversion record.

Records are rows with the header fields as columns and the block as bytes, so building derivatives
is a projection with no shuffle. Both derivatives refer to the response, carry its target URI and
date, its payload digest and its content type, and name each other. Ids are made from digests, so
that a rerun gives the same ids. `parse` reads WARC bytes to such rows and `serialize` writes them.
"""

from __future__ import annotations

import gzip
import hashlib
import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernel.llm.quality import let

CRLF = "\r\n"
DATE = "2024-01-01T00:00:00Z"
#: Elements whose ends are line ends in plain text.
BLOCKS = "p|div|br|hr|li|ul|ol|dl|dt|dd|h[1-6]|tr|table|article|section|nav|header|footer|aside|main|blockquote|pre|title|form|figure"
HIDDEN = ("script", "style", "noscript", "template")
ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&amp;", "&"))


def urn(seed: Column) -> Column:
    """A record id from the SHA-256 of a seed, in the form of a UUID."""
    parts = [(1, 8), (9, 4), (13, 4), (17, 4), (21, 12)]
    return let(F.sha2(seed, 256), lambda h: F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *[F.substring(h, a, n) for a, n in parts]), F.lit(">")))


def digest(block: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(block, 256))


def responses(pages: DataFrame) -> DataFrame:
    """Response records of (page_id, url, html); null html is an empty payload, a null url an empty target."""
    html, url = F.coalesce("html", F.lit("")), F.coalesce("url", F.lit(""))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=UTF-8{CRLF}Content-Length: "), F.octet_length(html).cast("string"), F.lit(CRLF * 2))
    return pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.lit("response").alias("warc_type"),
        urn(F.concat_ws("|", F.lit("response"), F.coalesce(F.col("page_id").cast("string"), F.lit("")), url)).alias("record_id"),
        url.alias("target_uri"),
        F.lit(DATE).alias("warc_date"),
        F.lit("text/html; charset=UTF-8").alias("payload_type"),
        digest(html).alias("payload_digest"),
        F.concat(http, html).cast("binary").alias("block"),
    )


def payload(block: Column) -> Column:
    """An HTTP response's body, as text."""
    text = block.cast("string")
    end = F.locate(CRLF * 2, text)
    bare = F.when(text.startswith("HTTP/"), F.locate("\n\n", text)).otherwise(0)  # a header whose lines end with LF alone
    body = F.when((bare > 0) & ((end == 0) | (bare < end)), F.substring(text, bare + 2, F.char_length(text)))
    return body.when(end > 0, F.substring(text, end + 4, F.char_length(text))).otherwise(text)


def plain(html: Column) -> Column:
    """Text of HTML: no comments or hidden elements, a line for each block, no other tags, spaces collapsed."""
    x = F.regexp_replace(html, r"(?s)<!--.*?-->", " ")
    for name in HIDDEN:
        x = F.regexp_replace(x, rf"(?is)<{name}\b.*?</{name}[^<>]*>", " ")
    x = F.regexp_replace(x, rf"(?i)</?(?:{BLOCKS})\b[^<>]*>", "\n")
    x = F.regexp_replace(x, r"<[^<>]*>", "")
    for name, is_ in ENTITIES:
        x = F.replace(x, F.lit(name), F.lit(is_))
    x = F.regexp_replace(x, r"[ \t\r\f\x{00a0}]+", " ")
    return F.regexp_replace(F.regexp_replace(x, r" ?\n[ \n]*", "\n"), r"^[ \n]+|[ \n]+$", "")


def derivatives(records: DataFrame) -> DataFrame:
    """Two rows per response: metadata (application/warc-fields) and conversion (text/plain).

    Titles are whole. Records of other types have none. An empty payload gives an empty conversion and metadata with
    empty fields. Records of `parse` carry the source's WARC and HTTP header fields into the metadata;
    those of `responses` have no others than the content type. Repeated responses give repeated derivatives with the same ids.
    """
    body = records.filter(F.col("warc_type") == "response").withColumn("_html", payload(F.col("block")))
    body = body.withColumn("_text", plain(F.col("_html")))
    title = F.regexp_replace(F.regexp_extract("_html", r"(?is)<title[^<>]*>(.*?)</title", 1), r"[\r\n]+", " ")
    lang = F.regexp_extract("_html", r"""(?i)<html[^<>]*\slang=["']?([A-Za-z-]+)""", 1)
    meta, conv = (urn(F.concat_ws("|", F.lit(kind), "record_id", "payload_digest")) for kind in ("metadata", "conversion"))
    fields = F.concat_ws(
        CRLF,
        F.concat(F.lit("title: "), title),
        F.concat(F.lit("language: "), lang),
        F.concat(F.lit("source-content-type: "), F.col("payload_type")),
        F.concat(F.lit("source-payload-digest: "), F.col("payload_digest")),
        F.concat(F.lit("conversion-digest: "), digest(F.col("_text"))),
        F.concat(F.lit("conversion-length: "), F.octet_length("_text").cast("string")),
        *(["source_headers"] if "source_headers" in records.columns else []),
        F.lit(""),
    )

    def record(kind: str, own: Column, other: Column, content_type: str, content: Column) -> Column:
        return F.struct(F.lit(kind).alias("warc_type"), own.alias("record_id"), other.alias("concurrent_to"), F.lit(content_type).alias("content_type"), content.alias("content"))

    both = F.array(record("metadata", meta, conv, "application/warc-fields", fields), record("conversion", conv, meta, "text/plain; charset=UTF-8", F.col("_text")))
    rows = body.select("page_id", "target_uri", "warc_date", "payload_type", "payload_digest", F.col("record_id").alias("refers_to"), F.explode(both).alias("r"))
    return rows.select(
        "page_id", "r.warc_type", "r.record_id", "refers_to", "r.concurrent_to", "target_uri", "warc_date", "r.content_type",
        F.col("payload_type").alias("source_content_type"), F.col("payload_digest").alias("source_payload_digest"),
        digest(F.col("r.content")).alias("block_digest"), F.octet_length("r.content").cast("long").alias("content_length"), "r.content",
    )


def serialize(records: DataFrame) -> DataFrame:
    """Adds `warc`, each derivative record's bytes; concatenated in any order they are a WARC file."""
    names = (("WARC-Type", "warc_type"), ("WARC-Record-ID", "record_id"), ("WARC-Refers-To", "refers_to"), ("WARC-Concurrent-To", "concurrent_to"), ("WARC-Target-URI", "target_uri"), ("WARC-Date", "warc_date"), ("WARC-Block-Digest", "block_digest"), ("WARC-Source-Payload-Digest", "source_payload_digest"), ("WARC-Source-Content-Type", "source_content_type"), ("Content-Type", "content_type"))
    head = [F.concat(F.lit(f"{name}: "), F.col(column)) for name, column in names]
    lines = F.concat_ws(CRLF, F.lit("WARC/1.0"), *head, F.concat(F.lit("Content-Length: "), F.col("content_length").cast("string")))
    return records.withColumn("warc", F.concat(lines, F.lit(CRLF * 2), F.col("content"), F.lit(CRLF * 2)).cast("binary"))


def read_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields by lower-case name, block) of each record; gzip members are undone. A cut end is an error."""
    stream = io.BytesIO(gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data)
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError("a record does not begin with its version")
        fields: dict[str, str] = {}
        while (line := stream.readline()).strip():
            name, _, value = line.decode("utf-8", "replace").partition(":")
            fields[name.strip().lower()] = value.strip()
        size = int(fields["content-length"])
        block = stream.read(size)
        if len(block) != size:
            raise ValueError("a record ends early")
        yield fields, block


def http_parts(block: bytes) -> tuple[str | None, list[tuple[str, str]], bytes]:
    """(status line, header fields by lower-case name, body) of an HTTP response; other blocks are all body.

    Folded lines are joined; repeated fields stay repeated. Lines end with CRLF or LF.
    """
    if not block.startswith(b"HTTP/"):
        return None, [], block
    ends = [(at, size) for at, size in ((block.find(b"\r\n\r\n"), 4), (block.find(b"\n\n"), 2)) if at >= 0]
    at, size = min(ends, default=(len(block), 0))
    status, *lines = block[:at].decode("utf-8", "replace").replace("\r\n", "\n").split("\n")
    fields: list[tuple[str, str]] = []
    for line in lines:
        if line[:1] in (" ", "\t") and fields:
            fields[-1] = (fields[-1][0], f"{fields[-1][1]} {line.strip()}")
        elif line.strip():
            name, _, value = line.partition(":")
            fields.append((name.strip().lower(), value.strip()))
    return status.strip(), fields, block[at + size :]


def _row(fields: dict[str, str], block: bytes) -> tuple:
    status, http, body = http_parts(block)
    own = {name: value for name, value in reversed(http)}  # of repeated fields the first
    payload_type = own.get("content-type") or fields.get("warc-identified-payload-type") or (fields.get("content-type") if status is None else None)
    payload_digest = fields.get("warc-payload-digest") or "sha256:" + hashlib.sha256(body).hexdigest()
    source = [f"source-warc-{name}: {value}" for name, value in fields.items()]
    source += [f"source-http-status: {status}"] if status else []
    source += [f"source-http-{name}: {value}" for name, value in http]
    own_fields = [fields.get(f"warc-{x}") for x in ("type", "record-id", "refers-to", "target-uri", "date")]
    return None, *own_fields, payload_type, payload_digest, source, list(fields.items()), block


RECORDS = "page_id long, warc_type string, record_id string, refers_to string, target_uri string, warc_date string, payload_type string, payload_digest string, source_headers array<string>, fields map<string,string>, block binary"


def parse(files: DataFrame) -> DataFrame:
    """Records of the bytes in a column `content`, as spark.read.format("binaryFile") gives them.

    They are what derivatives() takes. payload_type is the HTTP header's content type, or what the
    WARC says of the payload; payload_digest is the WARC's own, or that of the payload's bytes.
    source_headers are lines of the WARC and HTTP header fields. There are no page ids.
    """

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        text = pa.string()
        kinds = [("page_id", pa.int64()), *[(x, text) for x in ("warc_type", "record_id", "refers_to", "target_uri", "warc_date", "payload_type", "payload_digest")]]
        kinds += [("source_headers", pa.list_(text)), ("fields", pa.map_(text, text)), ("block", pa.binary())]
        for batch in batches:
            for content in batch.column(0):
                rows = [_row(f, b) for f, b in read_records(content.as_py() or b"")]
                columns = list(zip(*rows, strict=True)) if rows else [[]] * len(kinds)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(columns, kinds, strict=True)], names=[n for n, _ in kinds])

    return files.select("content").mapInArrow(of, RECORDS)
