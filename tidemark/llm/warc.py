"""Operator 5, WARC derivatives: linked metadata and plain-text conversion records for response records.

For every HTTP response record two records are made, both with ``WARC-Refers-To`` the response's id and its target URI
and date: a ``conversion`` record with the plain text of the page, and a ``metadata`` record of WARC fields that keeps
the response's own id, digests and other WARC headers, HTTP status line and header fields in order, and names the conversion record. Ids are
derived from the source's id, so a retried task makes the same records.

Text conversion drops comments, scripts, styles and the head, breaks lines at block elements, removes other tags,
resolves character references and collapses white space, in time linear in the page's length. Records that are cut short
or lack a length are read as far as they reach.

A null record gives no derivatives; a null page is an empty payload; a null URL leaves the target URI out. Payloads are
never cut. Rows that are equal in page_id, URL and page are the same record with the same id. An empty table gives an
empty one.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import html
import io
import re
import uuid
import zlib
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from .arrow import fresh, prepare, table

Headers = list[tuple[str, str]]
#: Fixed value: the date of the records that stand for the pages table, which has none.
DATE = "2024-01-01T00:00:00Z"
SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
#: Elements whose content is no readable text; of the first two, one without an end tag reaches to the end of the page.
SKIPPED = ("script", "style", "noscript", "template", "head")
#: What a head may hold beside skipped elements and a title; anything else, even text, is of the body.
IN_HEAD = frozenset("meta link base basefont bgsound html /html /meta /link /base /script /style /noscript /template /title".split())
ENDS = {"!--": re.compile("-->")} | {n: re.compile(rf"</{n}\s*>", re.I) for n in (*SKIPPED, "title")}
OPENING = re.compile(r"<(!--|/?[a-zA-Z][a-zA-Z0-9]*|[/!?])")
#: The rest of a tag, up to a ``>`` outside quotes; possessive, so one attempt reads no character twice.
TO_END = re.compile(r"""(?:[^>"']|"[^"]*"|'[^']*')*+>""")
HREF = re.compile(r"""\bhref\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", re.I)
OPEN_TITLE = re.compile(r"<title\b", re.I)
SPACE_RUN = re.compile(r"\s*")
CHUNK = re.compile(rb"([0-9A-Fa-f]{1,8})[ \t]*(?:;[^\r\n]*)?\r\n")
#: Source headers that the derived records' own fields hold, or that only describe the source's block.
CARRIED = frozenset("warc-type warc-record-id warc-date warc-target-uri warc-block-digest warc-payload-digest content-type content-length".split())
#: Elements that begin and end lines.
BLOCKS = frozenset("address article aside blockquote body br caption dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol option p pre section table tbody td tfoot th thead title tr ul".split())


def digest(block: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode()


def format_record(headers: Headers, block: bytes) -> bytes:
    """A WARC/1.1 record; Content-Length is set from the block."""
    lines = [f"{k}: {v}" for k, v in headers if k.lower() != "content-length"] + [f"Content-Length: {len(block)}"]
    return ("WARC/1.1\r\n" + "\r\n".join(lines) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


def _gunzipped(data: bytes) -> bytes:
    """All members one after the other, as far as they can be read."""
    out = []
    while data[:2] == b"\x1f\x8b":
        z = zlib.decompressobj(31)
        try:
            out += [z.decompress(data), z.flush()]
        except zlib.error:
            break
        data = z.unused_data
    return b"".join(out)


def parse_records(data: bytes) -> Iterator[tuple[Headers, bytes]]:
    """The records of a WARC file, plain or with a gzip member for each record.

    What is broken costs no more than itself: a truncated file gives what is there, a record whose header does not end
    is left out, and one without a readable length reaches up to the next record.
    """
    if data[:2] == b"\x1f\x8b":
        data = _gunzipped(data)
    at = 0
    while (at := data.find(b"WARC/", at)) >= 0:
        end = data.find(b"\r\n\r\n", at)
        if end < 0:
            return
        first = data.find(b"\r\n", at, end)
        headers = parse_fields(data[first + 2 : end]) if first >= 0 else []
        said = (header(headers, "Content-Length") or "").strip()
        if said.isascii() and said.isdigit():
            to = min(end + 4 + int(said), len(data))
        else:
            to = data.find(b"\r\n\r\nWARC/", end + 2)
            to = max(to, end + 4) if to >= 0 else len(data)
        yield headers, data[end + 4 : to]
        at = to


def parse_fields(raw: bytes) -> Headers:
    """``Name: value`` lines in order; a line that begins with white space goes on the one before."""
    out: Headers = []
    for line in raw.decode("utf-8", "replace").split("\r\n"):
        if line[:1] in (" ", "\t") and out:
            out[-1] = (out[-1][0], f"{out[-1][1]} {line.strip()}")
        elif line:
            name, _, value = line.partition(":")
            out.append((name.strip(), value.strip()))
    return out


def write_warc(records: Iterable[bytes]) -> bytes:
    """A WARC file with a gzip member for each record."""
    out = io.BytesIO()
    for r in records:
        out.write(gzip.compress(r, mtime=0))
    return out.getvalue()


def header(headers: Headers, name: str) -> str | None:
    return next((v for k, v in headers if k.lower() == name.lower()), None)


class _Reader:
    """One pass over a page. What cannot be found any more is remembered, so the time is linear in any page's length.

    Comments, scripts and styles without an end reach to the end of the page, as in browsers; other skipped elements are
    no more than tags then. A head's end tag may be left out: it ends before the first thing that cannot be in a head. A
    ``<`` that no ``>`` follows is text. Once a tag's quotes do not close, quotes mean nothing in later tags.
    """

    def __init__(self, page: str):
        self.page, self.never, self.quotes, self.tags = page, set(), True, True

    def tag_end(self, at: int) -> int | None:
        """Where the tag ends whose name ends at ``at``."""
        if self.quotes:
            if m := TO_END.match(self.page, at):
                return m.end()
            self.quotes = False
        end = self.page.find(">", at) + 1 if self.tags else 0
        self.tags = end > 0
        return end or None

    def element_end(self, name: str, at: int) -> int | None:
        """Where the element ends whose opening tag ends at ``at``; None if its tags are only tags."""
        if name in self.never:
            return None
        if m := ENDS[name].search(self.page, at):
            return m.end()
        if name in ("!--", "script", "style"):
            return len(self.page)
        self.never.add(name)
        return None

    def head_end(self, at: int) -> int:
        while True:
            at = SPACE_RUN.match(self.page, at).end()
            m = OPENING.match(self.page, at)
            name = m[1].lower() if m else ""
            if name == "/head":
                return self.tag_end(m.end()) or at
            if name == "!--":
                at = self.element_end(name, m.end())
                continue
            if not (name in IN_HEAD or name == "title" or (name in SKIPPED and name != "head")):
                return at
            end = self.tag_end(m.end())
            if end is not None and name not in IN_HEAD:
                end = self.element_end(name, end)
            if end is None:
                return at
            at = end

    def read(self) -> tuple[str, list[str]]:
        """The text with a line for each block, and the targets of links outside skipped elements."""
        page, out, links, at, last = self.page, [], [], 0, 0
        while self.tags and (m := OPENING.search(page, at)):
            name = m[1].lower()
            if name == "!--":
                end, mark = self.element_end(name, m.end()), " "
            elif (end := self.tag_end(m.end())) is None:
                break
            elif name in SKIPPED:
                inner = self.head_end(end) if name == "head" else self.element_end(name, end)
                end, mark = (end, "") if inner is None else (inner, " ")
            else:
                mark = "\n" if name.lstrip("/") in BLOCKS else ""
                if name == "a" and (href := HREF.search(page, m.end(), end)):
                    links.append(next(filter(None, href.groups()), ""))
            out += [page[last : m.start()], mark]
            at = last = end
        return "".join([*out, page[last:]]), links


def title_of(page: str) -> str | None:
    """The content of the first title that is closed."""
    if (m := OPEN_TITLE.search(page)) and (end := page.find(">", m.end()) + 1) and (close := ENDS["title"].search(page, end)):
        return page[end : close.start()]
    return None


def read_page(page: str) -> tuple[str, list[str]]:
    """The readable text of an HTML page, a line for each block, and its links as they are written."""
    raw, links = _Reader(page.replace("\n", " ")).read()
    text = html.unescape(raw)
    return "\n".join(x for line in text.split("\n") if (x := " ".join(line.split()))), links


def plain_text(page: str) -> str:
    return read_page(page)[0]


def response_record(page_id: object, url: str | None, page: str | None) -> bytes:
    """The response record that stands for a row of ``pages``."""
    payload = (page or "").encode("utf-8", "surrogatepass")
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode() + payload
    name = uuid.uuid5(SPACE, f"{page_id}\n{url}\n{digest(payload)}")
    headers = [("WARC-Type", "response"), ("WARC-Record-ID", f"<urn:uuid:{name}>"), ("WARC-Date", DATE)]
    headers += [("WARC-Target-URI", url)] if url else []
    headers += [("Content-Type", "application/http;msgtype=response"), ("WARC-Block-Digest", digest(http)), ("WARC-Payload-Digest", digest(payload))]
    return format_record(headers, http)


def _unchunked(body: bytes) -> bytes:
    """A chunked body put together; as it is if it is not chunked (any more)."""
    out, at = [], 0
    while m := CHUNK.match(body, at):
        size = int(m[1], 16)
        if not size:
            return b"".join(out)
        out.append(body[m.end() : m.end() + size])
        at = m.end() + size
        if body[at : at + 2] not in (b"\r\n", b""):
            return body
        at += 2
    return b"".join(out) if out and at >= len(body) else body


def _inflated(body: bytes) -> bytes:
    """A gzip, zlib or raw deflate body unpacked, as far as it reaches; as it is if it is none."""
    for window in (47, -15):
        out, rest = [], body
        try:
            while rest:
                z = zlib.decompressobj(window)
                out += [z.decompress(rest), z.flush()]
                rest = z.unused_data if window > 0 and z.eof else b""
        except zlib.error:
            pass
        if any(out):
            return b"".join(out)
    return body


def decoded(http: Headers, payload: bytes) -> bytes:
    """A payload without its transfer and content encodings, the last applied first; those not known here stay."""
    for name in ("Transfer-Encoding", "Content-Encoding"):
        codings = ",".join(v for k, v in http if k.lower() == name.lower())
        for coding in reversed([c.strip().lower() for c in codings.split(",") if c.strip()]):
            if coding == "chunked":
                payload = _unchunked(payload)
            elif coding in ("gzip", "x-gzip", "deflate"):
                payload = _inflated(payload)
            elif coding != "identity":
                return payload
    return payload


def derive(headers: Headers, block: bytes) -> list[tuple[Headers, bytes]]:
    """The conversion and metadata records of a response; none for records of other types."""
    source = header(headers, "WARC-Record-ID")
    if (header(headers, "WARC-Type") or "").lower() != "response" or not source:
        return []
    head, _, payload = block.partition(b"\r\n\r\n")
    status, _, fields = head.partition(b"\r\n")
    http = parse_fields(fields)
    body = decoded(http, payload)
    charset = re.search(r"charset=[\"']?([\w.:-]+)", header(http, "Content-Type") or "", re.I)
    try:
        page = body.decode(charset[1] if charset else "utf-8", "replace")
    except LookupError:
        page = body.decode("utf-8", "replace")
    text, links = read_page(page)
    text = text.encode("utf-8", "surrogatepass")
    payload_digest = header(headers, "WARC-Payload-Digest") or digest(payload)
    shared = [(k, v) for k in ("WARC-Target-URI", "WARC-Date") if (v := header(headers, k)) is not None]
    conversion = f"<urn:uuid:{uuid.uuid5(SPACE, source + ' conversion')}>"
    title = title_of(page)
    lines = [("source-record-id", source), ("source-block-digest", header(headers, "WARC-Block-Digest") or digest(block)), ("source-payload-digest", payload_digest), ("conversion-record-id", conversion)]
    lines += [(f"source-header-{k}", v) for k, v in headers if k.lower() not in CARRIED]
    lines += [("http-status", status.decode("utf-8", "replace"))] + [(f"http-header-{k}", v) for k, v in http]
    lines += [("title", " ".join(html.unescape(title).split()))] if title is not None else []
    lines += [("outlink", html.unescape(x).strip()) for x in links]
    meta = "".join(f"{k}: {' '.join(v.split())}\r\n" for k, v in lines).encode("utf-8", "surrogatepass")

    def record(kind: str, name: str, content: str, body: bytes) -> tuple[Headers, bytes]:
        return [("WARC-Type", kind), ("WARC-Record-ID", name), ("WARC-Refers-To", source), *shared, ("Content-Type", content), ("WARC-Block-Digest", digest(body)), ("WARC-Source-Payload-Digest", payload_digest)], body

    return [record("conversion", conversion, "text/plain; charset=utf-8", text), record("metadata", f"<urn:uuid:{uuid.uuid5(SPACE, source + ' metadata')}>", "application/warc-fields", meta)]


_FIELDS = ("record_type", "record_id", "refers_to", "target_uri", "warc_date", "content_type", "block_digest", "source_payload_digest", "block")
_NAMES = ("WARC-Type", "WARC-Record-ID", "WARC-Refers-To", "WARC-Target-URI", "WARC-Date", "Content-Type", "WARC-Block-Digest", "WARC-Source-Payload-Digest")
_DERIVED = T.ArrayType(T.StructType([T.StructField(f, T.StringType()) for f in _FIELDS]))


def _rows(record: bytes | None) -> list[dict]:
    made = [d for r in parse_records(record or b"") for d in derive(*r)]
    return [dict(zip(_FIELDS, [*(header(h, n) for n in _NAMES), b.decode("utf-8", "replace")])) for h, b in made]


@F.pandas_udf(_DERIVED)
def _derived(records: pd.Series) -> pd.Series:
    return records.map(lambda r: _rows(None if r is None else bytes(r)))


@F.pandas_udf(T.BinaryType())
def _response(ids: pd.Series, urls: pd.Series, pages: pd.Series) -> pd.Series:
    return pd.Series([response_record(*row) for row in zip(ids, urls, pages)], dtype=object)


def page_responses(id_: Column, url: Column, page: Column) -> Column:
    return _response(id_.cast("string"), url, page)


def derivatives(responses: DataFrame, record_col: str = "record") -> DataFrame:
    """A row for each derived record, beside the other columns: its header fields and its block as text.

    The other columns keep their names; a field of the same name gets an underscore more.
    """
    prepare(responses.sparkSession)
    rest, made = responses.drop(record_col), fresh(responses, "_d")
    kept = [f"`{c}`" for c in rest.columns]
    exploded = responses.select(*kept, F.explode(_derived(F.col(record_col))).alias(made))
    return exploded.select(*kept, *[F.col(f"{made}.{f}").alias(fresh(rest, f)) for f in _FIELDS])


def op5_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    pages = table(spark, sf_dir, "pages")
    return derivatives(pages.select("page_id", page_responses(F.col("page_id"), F.col("url"), F.col("html")).alias("record")))


QUERIES = {"op5_warc_derivatives": op5_warc_derivatives}
ORACLE: dict[str, str] = {}
