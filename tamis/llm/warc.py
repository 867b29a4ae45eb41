"""WARC derivatives: responses become linked metadata and plain-text conversion records.

Every derived record names its response in WARC-Refers-To, keeps the response's HTTP headers (null where none came) and
digests, and carries digests of its own. Identifiers follow from the content, so a retried task makes the same records.

A tag ends at its ``>`` and holds no ``<``; so every search over a page is linear, whatever the page holds.
"""

from __future__ import annotations

import base64
import hashlib
import html as entities
import re
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tamis.llm.common import only

#: Between two records of a WARC file.
RECORD_END = "\r\n\r\n"
#: Date of responses that come without one.
NO_DATE = "1970-01-01T00:00:00Z"
SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the name space for urls

#: Comments, script and style run to the end of the page where they are not closed; a title needs its end tag.
HIDDEN = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style)(?=[\s/>])[^<>]*>.*?(?:</\1\s*>|\Z)|<title(?=[\s/>])[^<>]*>(?:(?!<title[\s/>]).)*?</title\s*>", re.I | re.S)
#: Tags of elements that are hidden only as far as they are closed.
PARTS = re.compile(r"</?(noscript|template|svg)(?=[\s/>])[^<>]*>", re.I)
#: A head up to its end tag, if no body element begins before that; else its text belongs to the body.
HEAD = re.compile(r"<head(?=[\s/>])[^<>]*>(?:(?!<(?!(?:base|basefont|bgsound|link|meta|noframes|noscript|template)[\s/>])[a-z]).)*?</head\s*>", re.I | re.S)
#: Elements that end a line.
LINES_END = frozenset("address article aside blockquote br dd div dl dt fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table td th tr ul".split())
TAG = re.compile(r"</?([a-zA-Z!?][a-zA-Z0-9]*)[^>]*(?:>|\Z)")
BLANKS = re.compile(r"[^\S\n]+")
LINES = re.compile(r" ?\n[ \n]*")
TITLE = re.compile(r"<title\b[^<>]*>((?:(?!<title\b).)*?)(?:</title\s*>|\Z)", re.I | re.S)
LINK = re.compile(r"<a\b[^<>]*?\shref\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.I)

DERIVED = T.StructType(
    [
        T.StructField("page_id", T.LongType()),
        *(T.StructField(n, T.StringType()) for n in ("record_id", "warc_type", "refers_to", "target_uri", "date", "content_type")),
        T.StructField("content_length", T.LongType()),
        *(T.StructField(n, T.StringType()) for n in ("block_digest", "source_payload_digest", "source_block_digest", "source_headers", "block")),
    ]
)


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def plain_text(page: str) -> str:
    """The visible text: hidden elements go, block elements end lines, entities are resolved, blanks collapse."""
    ends = lambda m: "\n" if m[1].lower() in LINES_END and m[0][-1] == ">" else ""
    text = TAG.sub(ends, HEAD.sub(" ", without_parts(HIDDEN.sub(" ", page))))
    return LINES.sub("\n", BLANKS.sub(" ", entities.unescape(text).replace("\r", "\n"))).strip()


def without_parts(page: str) -> str:
    """The page without closed noscript, template and svg elements; tags that close themselves or are never closed hide nothing."""
    open_: list[tuple[str, int]] = []
    spans: list[tuple[int, int]] = []
    depth = dict.fromkeys(("noscript", "template", "svg"), 0)
    for m in PARTS.finditer(page):
        name = m[1].lower()
        if m[0][1] != "/":
            if not m[0].endswith("/>"):
                open_.append((name, m.start()))
                depth[name] += 1
        elif depth[name]:
            while (last := open_.pop())[0] != name:
                depth[last[0]] -= 1
            depth[name] -= 1
            start = last[1]
            while spans and spans[-1][0] >= start:
                spans.pop()
            spans.append((start, m.end()))
    out, at = [], 0
    for start, end in spans:
        out += [page[at:start], " "]
        at = end
    return "".join(out) + page[at:]


def one_line(text: str) -> str:
    return " ".join(entities.unescape(text).split())


def record_id(kind: str, *parts: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(SPACE, chr(0).join((kind, *parts)))}>"


def derive_one(page_id, url, page, date, headers) -> list[tuple]:
    url, page, date = url or "", page or "", date or NO_DATE
    data = page.encode()
    payload, block = digest(data), digest(headers.encode() + data) if headers is not None else None
    source = record_id("response", str(page_id), url, block or payload)
    text_id, about_id = record_id("conversion", source), record_id("metadata", source)
    text = plain_text(page)
    title = TITLE.search(page)
    links = [one_line(next((g for g in m.groups() if g is not None), "")) for m in LINK.finditer(page)]
    fields = [("title", one_line(TAG.sub("", title[1])) if title else ""), ("conversion", text_id), ("source-payload-digest", payload), *([("source-block-digest", block)] if block else []), ("text-length", str(len(text))), *(("outlink", x) for x in links)]
    about = "".join(f"{k}: {v}\r\n" for k, v in fields)
    out = []
    for kind, own, content_type, body in (("metadata", about_id, "application/warc-fields", about), ("conversion", text_id, "text/plain; charset=utf-8", text)):
        raw = body.encode()
        out.append((page_id, own, kind, source, url, date, content_type, len(raw), digest(raw), payload, block, headers, body))
    return out


def derive(responses: DataFrame) -> DataFrame:
    """Two records for every row of (page_id, url, html, optional date and http_headers): metadata and conversion.

    Null urls and pages count as empty, and an empty page still gets both records. Without headers there is no block
    of the response, so source_headers and source_block_digest are null and nothing is made up; the payload's
    digest is always there. Repeated rows give repeated records with the same identifiers. The whole page is
    converted, however long; other columns take no part. Narrow, with no shuffle.
    """

    def derived(batches):
        for batch in batches:
            rows = [r for row in zip(*(c.to_pylist() for c in batch.columns), strict=True) for r in derive_one(*row)]
            columns = list(zip(*rows, strict=True)) or [()] * len(DERIVED)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if f.dataType == T.LongType() else pa.string()) for c, f in zip(columns, DERIVED, strict=True)], names=DERIVED.names)

    return only(responses, ("page_id", "bigint"), ("url", "string"), ("html", "string"), ("date", "string"), ("http_headers", "string")).mapInArrow(derived, DERIVED)


def serialised(records: DataFrame) -> DataFrame:
    """One string column: each record with its WARC header, without the closing blank lines."""
    line = lambda name, column: F.concat(F.lit(f"{name}: "), column, F.lit("\r\n"))
    head = F.concat(
        F.lit("WARC/1.1\r\n"), line("WARC-Type", F.col("warc_type")), line("WARC-Record-ID", F.col("record_id")), line("WARC-Refers-To", F.col("refers_to")),
        line("WARC-Target-URI", F.regexp_replace("target_uri", "[\r\n]", " ")), line("WARC-Date", F.col("date")), line("WARC-Block-Digest", F.col("block_digest")), line("WARC-Source-Payload-Digest", F.col("source_payload_digest")),
        F.coalesce(line("WARC-Source-Headers", F.replace(F.base64(F.col("source_headers").cast("binary")), F.lit("\r\n"), F.lit(""))), F.lit("")), line("Content-Type", F.col("content_type")), line("Content-Length", F.col("content_length").cast("string")), F.lit("\r\n"),
    )
    return records.select(F.concat(head, "block").alias("value"))


def write(records: DataFrame, path: str) -> None:
    """WARC files, one for each partition; any store that Spark writes."""
    serialised(records).write.option("lineSep", RECORD_END).text(path)


def plain(data: bytes) -> bytes:
    """The bytes of a WARC file, unpacked if it is gzip (one member for each record or for all); a cut-off last member gives what it holds."""
    if data[:2] != b"\x1f\x8b":
        return data
    out = []
    while data[:2] == b"\x1f\x8b":
        member = zlib.decompressobj(31)
        try:
            out.append(member.decompress(data))
        except zlib.error:
            break
        data = member.unused_data.lstrip(b"\0")
    return b"".join(out)


def parse(data: bytes) -> list[tuple[dict[str, str], bytes]]:
    """(header fields, block) of each record of a WARC file, gzip or not.

    Names of fields are kept as they come and compared without case; a line without a colon is no field, one that
    begins with a blank continues the field before. A record that is cut off, or has no sound length, ends at the
    next record or the end of the file; what lies between records is skipped.
    """
    data, found, at = plain(data), [], 0
    while (start := data.find(b"WARC/", at)) >= 0:
        if start and data[start - 1 : start] != b"\n":
            at = start + 5
            continue
        head = re.compile(rb"\r?\n\r?\n").search(data, start)
        begin = head.end() if head else len(data)
        fields: dict[str, str] = {}
        last = None
        for raw in data[start : head.start() if head else len(data)].decode("utf-8", "replace").splitlines()[1:]:
            name, colon, value = raw.partition(":")
            if raw[:1] in (" ", "\t") and last is not None:
                fields[last] += " " + raw.strip()
            elif colon:
                last = name.strip()
                fields[last] = value.strip()
        size = next((v for n, v in fields.items() if n.lower() == "content-length"), "")
        if size.isdecimal():
            end = min(len(data), begin + int(size))
        else:
            end = data.find(b"\nWARC/", begin)
            end = len(data) if end < 0 else end
        found.append((fields, data[begin:end]))
        at = end
    return found


def read(spark: SparkSession, path: str) -> DataFrame:
    """The records of WARC files, plain or gzip, as (fields map, block binary), one task for each file; files are held whole, so they are of 2 GB at most (the usual one has 1 GB)."""
    schema = "fields map<string,string>, block binary"

    def records(batches):
        for batch in batches:
            for content in batch.column(0):
                rows = parse(content.as_py())
                yield pa.RecordBatch.from_arrays([pa.array([list(f.items()) for f, _ in rows], pa.map_(pa.string(), pa.string())), pa.array([b for _, b in rows], pa.binary())], names=["fields", "block"])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(records, schema)
