"""WARC derivatives: metadata and plain-text conversion records of response records.

Each response gives two records that refer to it: a metadata record (JSON with status, source headers, title, links,
lengths and digests) and a conversion record with the page's plain text. Block digests are SHA-1 in base 32 of the
block, payload digests those of the payload's bytes, and every record carries the headers, digest and date of its source.

responses() puts rows of pages into response records, derivatives() parses WARC bytes (plain or gzip members, any number
of records) and derives, records() derives from rows that are parsed already. All are maps over rows: nothing is
shuffled or gathered. serialised() gives a record's WARC/1.1 bytes as its own gzip member, so that members can be joined
to files in any order; written() writes such files, one a partition, under names that a repeated task writes again.

Record ids are UUIDs derived from the refers-to id, the type and the block, so a task that runs again writes the same
records. A response without an id gets one from its uri, its payload and its row's number in the scan.

Defined results: null and empty payloads give a metadata record and an empty conversion record; a null url is left out
of the headers; a null date is DATE, as a record must have one; source headers that are no JSON object are kept under
"malformed", as are HTTP header lines without a colon; bytes that no charset explains are read as U+FFFD, digests are
those of the bytes; WARC bytes that are no record are passed over; repeated rows give repeated records, with ids of
their own where ids are derived; an empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import html
import json
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import col, table

#: Fixed value: the date of records whose source states none.
DATE = "1970-01-01T00:00:00Z"
SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the URL name space of RFC 4122
_FIELDS = ["record_id", "record_type", "refers_to", "target_uri", "date", "content_type", "payload_digest", "block_digest", "source_headers", "block"]
RECORD = ", ".join(f"{c} string" for c in _FIELDS) + ", content_length long"
_ATTRS = r"""(?:"[^"]*"|'[^']*'|[^'">])*"""
_BODY = r"<!--.*?(?:-->|\Z)|<(script|style)\b[^>]*>.*?(?:</\1\s*>|\Z)"
_GONE = re.compile(_BODY + rf"|<(noscript|template|iframe|svg)\b({_ATTRS})>", re.S | re.I)
_ANY = re.compile(_BODY + rf"|<(/?)([a-zA-Z][^\s/>]*)({_ATTRS})>", re.S | re.I)
_QUIET = re.compile(r"<!--.*?(?:-->|\Z)|(<script\b[^>]*>).*?(?:</script\s*>|\Z)", re.S | re.I)
_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
_BREAK = re.compile(r"</?(?:address|article|aside|blockquote|body|br|dd|div|dl|dt|fieldset|figcaption|figure|footer|form|h[1-6]|head|header|hr|html|li|main|nav|ol|option|p|pre|section|table|td|th|title|tr|ul)\b[^>]*>", re.I)
_TAG = re.compile(r"<[/!?a-zA-Z][^>]*>")
_TITLE = re.compile(r"<title[^>]*>(.*?)</title", re.S | re.I)
_LINK = re.compile(r"""<(a|link|img|script|iframe)\b[^>]*?\b(?:href|src)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)


def sha1(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def named(refers_to: str, kind: str, block: bytes) -> str:
    return f"<urn:uuid:{uuid.uuid5(SPACE, f'{refers_to} {kind} {hashlib.sha256(block).hexdigest()}')}>"


def ended(page: str, at: int, name: str) -> int:
    """Where the element `name` opened before `at` ends: past its end tag, or else before that of its parent."""
    inner = [name]
    for m in _ANY.finditer(page, at):
        if m[3] is None:
            continue
        tag = m[3].lower()
        if not m[2]:
            if tag not in _VOID and not m[4].endswith("/"):
                inner.append(tag)
        elif tag not in inner:
            return m.start()
        else:
            while inner.pop() != tag:
                pass
            if not inner:
                return m.end()
    return len(page)


def shown(page: str) -> str:
    """The page without comments, scripts, styles and elements that show no text."""
    out, at = [], 0
    while m := _GONE.search(page, at):
        out.append(page[at : m.start()])
        at = m.end() if m[2] is None or m[3].endswith("/") else ended(page, m.end(), m[2].lower())
    return "".join([*out, page[at:]])


def plain_text(page: str) -> str:
    """All text outside markup, a line a block, in page order."""
    kept = _TAG.sub("", _BREAK.sub("\n", shown(page)))
    return "\n".join(x for x in (" ".join(line.split()) for line in html.unescape(kept).split("\n")) if x)


def described(page: str, headers: dict, uri: str | None, payload_digest: str, n_bytes: int) -> bytes:
    title = _TITLE.search(page)
    links = [{"path": m[1].lower(), "url": html.unescape(m[2] or m[3] or m[4] or "")} for m in _LINK.finditer(_QUIET.sub(r"\1", page))]
    out = {"target-uri": uri, "headers": headers, "payload-digest": payload_digest, "payload-length": n_bytes, "title": html.unescape(" ".join(title[1].split())) if title else None, "links": links}
    return json.dumps(out, ensure_ascii=False, separators=(",", ":")).encode()


def source_headers(text: str | None) -> dict:
    """The JSON object as it is; anything else under "malformed"."""
    try:
        out = json.loads(text) if text else {}
    except ValueError:
        out = None
    return out if isinstance(out, dict) else {"malformed": text}


def derived(record_id: str | None, uri: str | None, date: str | None, source: dict, raw: bytes, serial: int = 0) -> list[dict]:
    """The metadata and the conversion record of one response."""
    page = decoded(raw, source)
    digest = sha1(raw)
    refers = record_id or named(f"{uri or ''} {serial}", "response", raw)
    out = []
    for kind, of, block in (
        ("metadata", "application/json", described(page, source, uri, digest, len(raw))),
        ("conversion", "text/plain", plain_text(page).encode()),
    ):
        out.append({
            "record_id": named(refers, kind, block), "record_type": kind, "refers_to": refers, "target_uri": uri, "date": date or DATE, "content_type": of, "payload_digest": digest,
            "block_digest": sha1(block), "source_headers": json.dumps(source, ensure_ascii=False, separators=(",", ":"), sort_keys=True), "block": block.decode(), "content_length": len(block),
        })
    return out


def decoded(raw: bytes, source: dict) -> str:
    """The payload by the charset that its source headers state, or as UTF-8."""
    stated = re.search(r"charset=[\"']?([\w.:-]+)", str(source.get("content-type", "")), re.I)
    try:
        return raw.decode(stated[1] if stated else "utf-8", "replace").encode("utf-8", "replace").decode()
    except LookupError:
        return raw.decode("utf-8", "replace")


_KINDS = {c: pa.string() for c in _FIELDS} | {"content_length": pa.int64()}


def _batch(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in _KINDS.items()], names=list(_KINDS))


def _text(raw: bytes | None) -> str | None:
    return None if raw is None else raw.decode("utf-8", "replace")


def _rows(b: pa.RecordBatch) -> Iterator[tuple]:
    """The rows as bytes and ints, whatever bytes the texts hold."""
    return zip(*[(x.as_py() for x in (c.cast(pa.binary()) if pa.types.is_string(c.type) else c)) for c in b.columns], strict=True)


def records(responses: DataFrame, record_id: str | None = None, uri: str = "url", date: str | None = None, headers: str | None = None, payload: str = "html") -> DataFrame:
    """Two rows per response: the fields of RECORD. headers: a column of JSON objects."""
    pick = lambda c: (col(c) if c else F.lit(None)).cast("string")
    own = responses.select(pick(record_id).alias("i"), pick(uri).alias("u"), pick(date).alias("d"), pick(headers).alias("h"), pick(payload).alias("p"), F.monotonically_increasing_id().alias("n"))

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for at in range(0, b.num_rows, 500):
                yield _batch([r for i, u, d, h, p, n in _rows(b.slice(at, 500)) for r in derived(_text(i), _text(u), _text(d), source_headers(_text(h)), p or b"", n)])

    return own.mapInArrow(batches, RECORD)


def response(record_id: str, uri: str | None, date: str | None, headers: list[tuple[str, str]], payload: bytes) -> bytes:
    """A response record in plain WARC/1.1 bytes."""
    http = "".join(f"{k}: {v}\r\n" for k, v in [*headers, ("content-length", str(len(payload)))])
    block = f"HTTP/1.1 200 OK\r\n{http}\r\n".encode() + payload
    head = [("WARC-Type", "response"), ("WARC-Record-ID", record_id), ("WARC-Target-URI", uri), ("WARC-Date", date or DATE), ("WARC-Payload-Digest", sha1(payload)), ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    lines = ["WARC/1.1", *[f"{k}: {' '.join(v.split())}" for k, v in head if v is not None]]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def responses(pages: DataFrame, uri: str = "url", payload: str = "html", headers: tuple[tuple[str, str], ...] = (("content-type", "text/html; charset=utf-8"),)) -> DataFrame:
    """Rows of pages as response records: warc (binary)."""
    own = pages.select(col(uri).cast("string").alias("u"), col(payload).cast("string").alias("p"), F.monotonically_increasing_id().alias("n"))

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for at in range(0, b.num_rows, 500):
                made = [response(named(f"{_text(u) or ''} {n}", "response", p or b""), _text(u), None, list(headers), p or b"") for u, p, n in _rows(b.slice(at, 500))]
                yield pa.RecordBatch.from_arrays([pa.array(made, pa.binary())], names=["warc"])

    return own.mapInArrow(batches, "warc binary")


def exchanged(block: bytes) -> tuple[dict, bytes]:
    """(headers by lower-case name, with the status; payload) of an HTTP response."""
    head, _, payload = block.partition(b"\r\n\r\n")
    first, *lines = head.decode("utf-8", "replace").split("\r\n")
    out = {"status": (first.split(" ") + ["", ""])[1]}
    for line in lines:
        name, colon, value = line.partition(":")
        key = name.strip().lower() if colon else "malformed"
        value = value.strip() if colon else line
        out[key] = f"{out[key]}, {value}" if key in out else value
    return out, payload


def derivatives(warcs: DataFrame, warc: str = "warc") -> DataFrame:
    """The fields of RECORD, two rows per response record in the WARC bytes of every row."""
    own = warcs.select(col(warc).cast("binary").alias("w"), F.monotonically_increasing_id().alias("n"))

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            rows: list[dict] = []
            for raw, n in _rows(b):
                for head, block in parsed(raw or b""):
                    own = {k.lower(): v for k, v in head.items()}
                    if own.get("warc-type") == "response":
                        source, payload = exchanged(block)
                        rows += derived(own.get("warc-record-id"), own.get("warc-target-uri"), own.get("warc-date"), source, payload, n)
                if len(rows) >= 1000:
                    yield _batch(rows)
                    rows = []
            yield _batch(rows)

    return own.mapInArrow(batches, RECORD)


def serialised(r: dict) -> bytes:
    """A record as a gzip member (with no time stamp, so that it is the same each time)."""
    block = (r["block"] or "").encode()
    head = {
        "WARC-Type": r["record_type"], "WARC-Record-ID": r["record_id"], "WARC-Refers-To": r["refers_to"], "WARC-Target-URI": r["target_uri"], "WARC-Date": r["date"],
        "WARC-Payload-Digest": r["payload_digest"], "WARC-Block-Digest": r["block_digest"], "X-Source-Headers": r["source_headers"], "Content-Type": r["content_type"], "Content-Length": str(len(block)),
    }
    lines = ["WARC/1.1", *[f"{k}: {' '.join(v.split())}" for k, v in head.items() if v is not None]]
    return gzip.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n", mtime=0)


def parsed(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of every record in (gzipped, joined) WARC bytes; what is no record is passed over."""
    raw, at = gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data, 0
    while (at := raw.find(b"WARC/1.", at)) >= 0 and (end := raw.find(b"\r\n\r\n", at)) >= 0:
        head = {}
        for line in raw[at:end].decode("utf-8", "replace").split("\r\n")[1:]:
            name, _, value = line.partition(":")
            head[name.strip()] = value.strip()
        size = next((v for k, v in head.items() if k.lower() == "content-length"), "")
        at = end + 4
        if size.isdecimal():
            yield head, raw[at : at + int(size)]
            at += int(size)


def members(recs: DataFrame) -> DataFrame:
    """record_id and warc (binary): each record's gzip member, for a writer that joins them."""
    fields = [*_FIELDS]

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            rows = b.to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array([r["record_id"] for r in rows], pa.string()), pa.array([serialised(r) for r in rows], pa.binary())], names=["record_id", "warc"])

    return recs.select(*fields).mapInArrow(batches, "record_id string, warc binary")


def written(recs: DataFrame, uri: str) -> list[str]:
    """Writes records as .warc.gz files under a folder that all executors reach, one a partition; gives their names.

    A file is written under a name of the attempt and moved into place, so a task that runs again replaces it."""
    fields = [*_FIELDS]

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        name = f"part-{context.partitionId():05d}.warc.gz"
        store, folder = fs.FileSystem.from_uri(uri)
        store.create_dir(folder, recursive=True)
        tried = f"{folder}/.{name}.{context.taskAttemptId()}"
        n = 0
        with store.open_output_stream(tried, compression=None) as out:
            for b in it:
                for r in b.to_pylist():
                    out.write(serialised(r))
                    n += 1
        if n:
            store.move(tried, f"{folder}/{name}")
        else:
            store.delete_file(tried)
        yield pa.RecordBatch.from_arrays([pa.array([name] if n else [], pa.string())], names=["name"])

    return sorted(r["name"] for r in recs.select(*fields).mapInArrow(batches, "name string").collect())


def op10_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derivatives(responses(table(spark, sf_dir, "pages")))
