"""WARC derivatives: response records become linked metadata and plain-text conversion records.

A response has its target URI, date, HTTP headers and payload. The conversion record holds the plain text of the
payload, the metadata record its title, links, language, lengths and the source's HTTP headers; both refer to the
response by its record id and carry its date, URI and payload digest. Record ids are name-based, so the same input
gives the same records in any order and on any number of executors.

Defined cases: a null url or html counts as empty; an empty page gives both records with an empty text; pages with the
same id and content give the same records once for each row. An empty table gives no records; a very long page is read in one
linear pass; other columns are not read, so their names can't clash.
"""

from __future__ import annotations

import base64
import hashlib
import html
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DATE = "1970-01-01T00:00:00Z"
_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the name space of URLs in RFC 4122
_BLOCK = frozenset("p div br li ul ol tr table h1 h2 h3 h4 h5 h6 section article header footer nav main aside blockquote pre td th hr form title body html".split())
#: Elements whose content is no text of the page; all but the head are skipped to their end tag.
_HIDDEN = {name: re.compile(rf"</{name}\s*>", re.I) for name in ("script", "style", "template", "noscript", "svg", "head")}
_NAME = re.compile(r"[a-zA-Z][a-zA-Z0-9]*")
_TITLE_END = re.compile(r"</title\s*>", re.I)
_HREF = re.compile(r"(?<![\w-])href\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_LANG = re.compile(r"(?<![\w-])lang\s*=\s*[\"']?([\w-]+)", re.I)


class Page:
    """Text, title, language and links of a page, from one pass over it: every step begins where the last one ended."""

    def __init__(self, page: str) -> None:
        self.title, self.language, self.links = None, "", []
        parts, at, head = [], 0, False
        while (low := page.find("<", at)) >= 0:
            if not head:
                parts.append(page[at:low])
            if page.startswith("<!--", low):
                end = page.find("-->", low + 4)
                at = len(page) if end < 0 else end + 3
                parts.append(" ")
                continue
            close = page.startswith("/", low + 1)
            name = _NAME.match(page, low + 1 + close)
            if not name and not (page[low + 1 + close : low + 2 + close] in ("!", "?")):
                at = low + 1
                if not head:
                    parts.append("<")
                continue
            end = page.find(">", low)
            if end < 0:  # no tag ends any more; what is left is text
                at = low
                break
            at = end + 1
            if not name:
                continue
            tag = name[0].lower()
            if close:
                head = head and tag != "head"
            elif tag == "head":
                head = True
                parts.append(" ")
            elif tag in _HIDDEN:
                ended = _HIDDEN[tag].search(page, at)
                at = ended.end() if ended else len(page)
                parts.append(" ")
                continue
            elif tag == "title" and self.title is None:
                ended = _TITLE_END.search(page, at)
                self.title = page[at : ended.start()] if ended else ""
            elif tag == "a" and (href := _HREF.search(page, low, end)):
                self.links.append(html.unescape(href[1] or href[2] or href[3] or ""))
            elif tag == "html" and not self.language and (lang := _LANG.search(page, low, end)):
                self.language = lang[1]
            if tag in _BLOCK and not head:
                parts.append("\n")
        if not head:
            parts.append(page[at:])
        self.text = _lines("".join(parts))
        self.title = Page(self.title).text if self.title else ""


def _lines(text: str) -> str:
    """A line per block, blanks collapsed."""
    return "\n".join(line for x in html.unescape(text).split("\n") if (line := " ".join(x.split())))


def digest(block: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode()


def record_id(*names: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, chr(0).join(names))}>"


def record(kind: str, headers: list[tuple[str, str]], block: bytes) -> bytes:
    """A whole WARC/1.1 record. Line ends inside header values become blanks."""
    lines = [("WARC-Type", kind), *headers, ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {' '.join(v.split())}\r\n" for k, v in lines).encode() + b"\r\n" + block + b"\r\n\r\n"


_RESPONSE = "page_id long, record_id string, target_uri string, date string, http_headers string, payload_digest string, payload string"


def responses(pages: DataFrame, date: str = DATE) -> DataFrame:
    """Response records for pages (page_id, url, html)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for page, url, body in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
                url, body = url or "", body or ""
                payload = body.encode()
                sha = digest(payload)
                http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n"
                out.append((page, record_id("response", str(page), url, sha), url, date, http, sha, body))
            types = [pa.int64(), *[pa.string()] * 6]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 7, types, strict=True)], names=[x.split()[0] for x in _RESPONSE.split(", ")])

    return pages.select("page_id", "url", "html").mapInArrow(run, _RESPONSE)


_DERIVED = "page_id long, kind string, record_id string, refers_to string, target_uri string, date string, content_type string, source_headers string, source_digest string, block_digest string, content_length long, block string, record binary"


def derivatives(responses: DataFrame) -> DataFrame:
    """Two records per response: metadata and conversion, each with its fields and as WARC bytes."""

    def both(page: int, source: str, uri: str, date: str, http: str, sha: str, body: str) -> Iterator[tuple]:
        page_text = Page(body)
        text, links = page_text.text, page_text.links
        headers = [x for x in http.split("\r\n")[1:] if x]
        conversion = record_id("conversion", source)
        fields = [("title", page_text.title), ("language", page_text.language), ("conversion", conversion), ("characters", str(len(text))), ("links", str(len(links)))]
        fields += [("source-header", x) for x in headers] + [("outlink", x) for x in links]
        about = "".join(f"{k}: {' '.join(v.split())}\r\n" for k, v in fields)
        for kind, name, mime, block in (("metadata", record_id("metadata", source), "application/warc-fields", about), ("conversion", conversion, "text/plain", text)):
            raw = block.encode()
            own = digest(raw)
            head = [("WARC-Record-ID", name), ("WARC-Refers-To", source), ("WARC-Target-URI", uri), ("WARC-Date", date), ("WARC-Block-Digest", own), ("X-Source-Payload-Digest", sha), ("Content-Type", mime)]
            yield page, kind, name, source, uri, date, mime, "\n".join(headers), sha, own, len(raw), block, record(kind, head, raw)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int64(), *[pa.string()] * 9, pa.int64(), pa.string(), pa.binary()]
        names = [x.split()[0] for x in _DERIVED.split(", ")]
        for batch in batches:
            rows = list(zip(*(batch.column(c).to_pylist() for c in range(7)), strict=True))
            for at in range(0, len(rows), 500):
                out = [x for r in rows[at : at + 500] for x in both(*r)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)

    return responses.mapInArrow(run, _DERIVED)


def digests(derived: DataFrame) -> DataFrame:
    """The fields without the texts; the whole record as its SHA-256."""
    return derived.select("page_id", "kind", "record_id", "refers_to", "target_uri", "date", "content_type", "source_headers", "source_digest", "block_digest", "content_length", F.sha2("record", 256).alias("record_sha256"))
