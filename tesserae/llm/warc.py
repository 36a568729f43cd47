"""Operator 9: WARC derivative builder.

Response records become linked derivatives: a ``metadata`` record (title, outlinks, the source's digests) and a
``conversion`` record with the plain text. Both name their source in WARC-Refers-To, keep its target URI and date, and
repeat its HTTP headers and payload digest; record ids follow from contents, so that a repeated task makes the same ones.
Each page is worked on by itself: one pass, no shuffle. ``write_warc`` and ``read_warc`` are the files; both stream, so a file
of any size is read in splits, and memory holds a record, not a file.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import html
import re
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VERSION = "WARC/1.1"
_SKIP = re.compile(r"<!--.*?(?:-->|$)|<(script|style|template|noscript)\b.*?(?:</\1\s*>|$)|<(/?)([a-zA-Z][a-zA-Z0-9]*)\b[^>]*>|<[!?/][^>]*>", re.S | re.I)
_LINK = re.compile(r"""<(?:a|area)\b[^>]*?\bhref\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", re.I)
_TITLE = re.compile(r"<title\b[^>]*>(.*?)</title\s*>", re.S | re.I)
_INLINE = frozenset("a abbr b bdi bdo cite code data dfn em font i img kbd mark q s samp small span strong sub sup time tt u var wbr".split())
_SPACE, _LINES = re.compile(r"[ \t\r\f\v\xa0]+"), re.compile(r" ?\n[ \n]*")
RECORD = "page_id long, warc_type string, record_id string, refers_to string, target_uri string, warc_date string, http_headers string, content_type string, content_length long, block_digest string, payload_digest string, source_payload_digest string, block string"
_NAMES = [c.split()[0] for c in RECORD.split(", ")]


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def _record_id(*parts: str) -> str:
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.sha256(chr(0).join(parts).encode()).digest()[:16], version=4)}>"


def plain_text(source: str) -> str:
    """The text of an HTML page: scripts, styles, comments and the title left out, a line break for each block element."""

    def other(m: re.Match) -> str:
        name = (m[3] or "").lower()
        return "" if name in _INLINE or not name else "\n"

    body = _TITLE.sub("", source)
    return _LINES.sub("\n", _SPACE.sub(" ", html.unescape(_SKIP.sub(other, body)))).strip()


def fields(source: str) -> str:
    """The title and outlinks as warc-fields. A link stands as the page writes it, relative ones too (the target URI is
    beside it); white space in it is collapsed, and an empty href is an empty outlink."""
    title = _TITLE.search(source)
    lines = [f"title: {' '.join(html.unescape(title[1]).split())}"] if title else []
    lines += [f"outlink: {' '.join(html.unescape(m[1] or m[2] or m[3] or '').split())} L a/@href" for m in _LINK.finditer(source)]
    return "".join(line + "\r\n" for line in lines)


def _made(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64() if c.split()[1] == "long" else pa.string() for c in RECORD.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [[]] * len(kinds), kinds, strict=True)], _NAMES)


def responses(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """A response record for each row of ``pages``, as it would have been captured at ``date``: columns of RECORD, the block
    being the HTTP headers and the page. A null page is an empty payload; a null URL stays null."""

    def run(batches):
        for batch in batches:
            rows = []
            for page, url, body in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                payload = (body or "").encode()
                head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n"
                block = head.encode() + payload
                own = digest(payload)
                rows.append((page, "response", _record_id("response", str(page), url or "", date, own), None, url, date, head, "application/http; msgtype=response", len(block), digest(block), own, None, head + (body or "")))
            yield _made(rows)

    return pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html")).mapInArrow(run, RECORD)


def derivatives(records: DataFrame) -> DataFrame:
    """For each response record its metadata and its conversion record, in columns of RECORD.

    Records of other types have none. An empty payload has an empty text and no fields of its own. Repeated records give
    equal derivatives each; a null target URI stays null; a very long page is converted whole; an empty table gives no rows.
    """

    def run(batches):
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                if r["warc_type"] != "response" or r["block"] is None:
                    continue
                head, _, body = r["block"].partition("\r\n\r\n")
                text, told = plain_text(body), fields(body)
                told += f"source-record: {r['record_id']}\r\nsource-payload-digest: {r['payload_digest']}\r\nsource-block-digest: {r['block_digest']}\r\n"
                told += "".join(f"source-http: {line}\r\n" for line in head.split("\r\n") if line)
                for kind, content_type, block in (("metadata", "application/warc-fields", told), ("conversion", "text/plain; charset=utf-8", text)):
                    data = block.encode()
                    own = digest(data)
                    rows.append((r["page_id"], kind, _record_id(kind, r["record_id"], own), r["record_id"], r["target_uri"], r["warc_date"], r["http_headers"], content_type, len(data), own, own, r["payload_digest"], block))
            yield _made(rows)

    return records.select(*_NAMES).mapInArrow(run, RECORD)


#: Header fields of a file and their columns; HTTP headers of derivatives, which stand in no block, are kept in base64.
_HEADERS = (("WARC-Type", "warc_type"), ("WARC-Record-ID", "record_id"), ("WARC-Refers-To", "refers_to"), ("WARC-Target-URI", "target_uri"), ("WARC-Date", "warc_date"), ("Content-Type", "content_type"), ("WARC-Block-Digest", "block_digest"), ("WARC-Payload-Digest", "payload_digest"), ("WARC-Source-Payload-Digest", "source_payload_digest"), ("X-Source-HTTP-Headers", "kept_headers"), ("X-Page-Id", "page_id"), ("Content-Length", "content_length"))
#: Between two records: the end of one and the beginning of the next one's version.
_BETWEEN = "\r\n\r\nWARC/1."


def write_warc(records: DataFrame, path: str) -> None:
    """Records as WARC files below ``path``, one for each partition, by Spark's own writer (any file system)."""
    kept = records.withColumn("kept_headers", F.when(F.col("warc_type") != "response", F.regexp_replace(F.base64(F.col("http_headers").cast("binary")), r"\s", "")))
    lines = [F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{h}: "), F.col(c).cast("string"), F.lit("\r\n"))).otherwise("") for h, c in _HEADERS]
    value = F.concat(F.lit(f"{VERSION}\r\n"), *lines, F.lit("\r\n"), F.coalesce("block", F.lit("")))
    kept.select(value.alias("value")).write.option("lineSep", "\r\n\r\n").text(path)


def _parsed(data: bytes) -> tuple[dict, int] | None:
    """The named header fields of a record and the place of its block; None if it has no readable header."""
    end = data.find(b"\r\n\r\n")
    if end < 0 or not data.startswith(b"WARC/"):
        return None
    back, got = dict(_HEADERS), {}
    for line in data[:end].split(b"\r\n")[1:]:
        name, _, value = line.decode("utf-8", "replace").partition(": ")
        if name in back:
            got[back[name]] = value
    try:
        got["content_length"] = int(got["content_length"])
        got["page_id"] = int(got["page_id"]) if "page_id" in got else None
        got["http_headers"] = base64.b64decode(got.pop("kept_headers"), validate=True).decode() if "kept_headers" in got else None
    except (KeyError, ValueError, binascii.Error):
        return None
    return (got, end + 4) if got["content_length"] >= 0 and "warc_type" in got else None


def _row(got: dict, block: bytes) -> tuple:
    got = got | {"block": block.decode("utf-8", "replace")}
    if got["warc_type"] == "response":
        got["http_headers"] = got["block"].partition("\r\n\r\n")[0] + "\r\n\r\n"
    return tuple(got.get(n) for n in _NAMES)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """The records of WARC files (also compressed ones), in columns of RECORD (http_headers from the blocks of responses).

    Files are split where a record's end and a version line meet. A block may hold just that; a record that is shorter than
    its Content-Length therefore takes in the pieces that follow in its split of the file. What has no readable header, or
    still lacks bytes then, is a row of type ``malformed`` with its bytes as block and nothing else. Bytes that are not UTF-8 are replaced.
    """

    def run(batches):
        rows, open_piece, at = [], None, None

        def settle(data: bytes) -> bool:
            """Whether the piece was taken as a record."""
            parsed = _parsed(data)
            if parsed is None:
                return False
            got, begin = parsed
            lacks = begin + got["content_length"] - len(data)
            if lacks > 0:
                return False
            rows.append(_row(got, data[begin : begin + got["content_length"]]))
            return True

        def malformed(data: bytes):
            if data.strip():
                rows.append(tuple({"warc_type": "malformed", "content_length": len(data), "block": data.decode("utf-8", "replace")}.get(n) for n in _NAMES))

        for batch in batches:
            for file, split, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if open_piece is not None and at == (file, split):
                    data = open_piece + _BETWEEN.encode() + data
                else:
                    if open_piece is not None:
                        malformed(open_piece)
                    data = data if data.startswith(b"WARC/") else b"WARC/1." + data
                open_piece, at = None, (file, split)
                if not settle(data):
                    # a header whose end was taken for the end of a record has its length, and a block that follows
                    if _parsed(data) is None and ((head := _parsed(data + b"\r\n\r\n")) is None or not head[0]["content_length"]):
                        malformed(data)
                    else:
                        open_piece = data
                if len(rows) >= 1000:
                    yield _made(rows)
                    rows = []
        if open_piece is not None:
            malformed(open_piece)
        yield _made(rows)

    # within a split of a file, pieces come in order
    pieces = spark.read.option("lineSep", _BETWEEN).text(path).select("_metadata.file_path", "_metadata.file_block_start", F.col("value").cast("binary"))
    return pieces.mapInArrow(run, RECORD)
