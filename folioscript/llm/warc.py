"""Legacy archive converter: ARC (versions 1 and 2) to WARC, and a WARC reader.

An ARC file starts with a version block that names the header layout of its
records; each record is one header line with a declared length and that many
bytes. The converter reads headers by the layout of their version, cuts blocks by
the declared length, and synthesises what WARC wants: a record id (made from the
record, so a repeated task writes the same one), an ISO time, the record type, block
and payload digests. Among records of equal payload the one with the smallest page id
keeps its payload; the others become revisits that refer to it by its record id.
Records without page id, as in archives from elsewhere, go by file and offset instead.
The id of a page's record holds the page id, so it needs no field of its own.

Files are written by Spark's text sink into the shared folder, gzip-packed, and
cut into volumes of bounded size; readers hold one volume at a time. They take files
of any name, packed or plain.

Defined cases: a null payload is empty; a null or blank URL becomes about:blank,
white space in a URL is percent-encoded; a record without page id never revisits one
with a page id; rows that repeat a response's page id and payload are responses too;
an empty table gives an archive without records and an empty result; a date of few
digits, or one that is not in the calendar, keeps its sound leading parts. A header
line that does not fit its version, a declared length that does not fit the file and
the rest of a torn file are put aside (:func:`damaged`); reading goes on at the next
header line.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
import uuid
import zlib
from collections.abc import Iterator
from datetime import datetime

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscript.llm.common import table, travels
from folioscript.session import shared_dir

travels(__name__)
VOLUME_BYTES = 32 << 20  # of unpacked archive per file
FLUSH_BYTES = 4 << 20
ARCHIVED, ADDRESS = "20200101000000", "0.0.0.0"
MIN_REVISIT = 0

# Header layouts of the two ARC versions, and the revisit profile of WARC 1.1.
LAYOUTS = {
    "1": "URL IP-address Archive-date Content-type Archive-length",
    "2": "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
# What a header's fields look like; any other field is a word. URLs and content types may hold spaces.
FIELDS = {"URL": r"\S.*?", "IP-address": r"[0-9A-Fa-f.:]+|-", "Archive-date": r"\d{4,17}", "Content-type": r".*", "Archive-length": r"\d{1,18}"}
SCHEME = re.compile(rb"[A-Za-z][A-Za-z0-9+.-]*:")
TORN = (EOFError, OSError, zlib.error)
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def clean_url(url: str | None) -> str:
    return re.sub(r"\s", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), (url or "").strip()) or "about:blank"


def http_block(page_id: int | None, payload: bytes) -> bytes:
    own = b"" if page_id is None else b"X-Page-Id: %d\r\n" % page_id
    return b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n%b\r\n%b" % (len(payload), own, payload)


def split_http(block: bytes) -> tuple[bytes, bytes, dict[str, str]]:
    """HTTP head, payload, head fields. A block that is no HTTP message is all payload."""
    head, sep, payload = block.partition(b"\r\n\r\n")
    if not block.startswith(b"HTTP/") or not sep:
        return b"", block, {}
    lines = head.decode("utf-8", "replace").split("\r\n")[1:]
    return head + sep, payload, {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}


def arc_head(version: str, url: str, mime: str, block: bytes, digest: str = "-", status: str = "200") -> bytes:
    fields = [url, ADDRESS, ARCHIVED, mime]
    fields += [status, digest, "-", "-", "-"] if version == "2" else []
    return " ".join([*fields, str(len(block))]).encode() + b"\n"


def arc_version_block(version: str, name: str) -> bytes:
    body = f"{version} 0 folioscript\n{LAYOUTS[version]}\n".encode()
    return f"filedesc://{name} {ADDRESS} {ARCHIVED} text/plain {len(body)}\n".encode() + body


class Volumes:
    """Collects written records into Arrow batches; starts a new volume after so many bytes."""

    def __init__(self, opener, limit: int = VOLUME_BYTES):
        self.opener, self.limit, self.volume, self.used, self.seq = opener, limit, -1, limit, 0
        self.rows: list[tuple[int, int, bytes]] = []
        self.held = 0

    def add(self, make) -> None:
        """``make(volume)`` gives a record's bytes; it is asked after the volume is settled."""
        if self.used >= self.limit:
            self.volume, self.used = self.volume + 1, 0
            self._put(self.opener(self.volume))
        self._put(make(self.volume))

    def _put(self, data: bytes) -> None:
        self.rows.append((self.volume, self.seq, data))
        self.seq, self.used, self.held = self.seq + 1, self.used + len(data), self.held + len(data)

    def flush(self, least: int = 0) -> Iterator[pa.RecordBatch]:
        if self.rows and self.held >= least:
            v, s, d = zip(*self.rows, strict=True)
            self.rows, self.held = [], 0
            yield pa.RecordBatch.from_arrays([pa.array(v, pa.int32()), pa.array(s, pa.int64()), pa.array(d, pa.binary())], ["volume", "seq", "data"])


def _write(rows: DataFrame, path: str, separator: str) -> None:
    """The order within a volume is the order in which its task made the records."""
    (rows.sortWithinPartitions("volume", "seq").select("volume", F.col("data").cast("string").alias("value"))
     .write.partitionBy("volume").option("lineSep", separator).option("compression", "gzip").text(path))


def _task() -> int:
    from pyspark import TaskContext

    return TaskContext.get().partitionId()


def write_arc(pages: DataFrame, path: str, volume_bytes: int = VOLUME_BYTES) -> None:
    """Archive ``pages(page_id, url, html)``; volumes alternate between the two versions."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = _task()
        version = lambda volume: "12"[(task + volume) % 2]
        out = Volumes(lambda v: arc_version_block(version(v), f"{task}-{v}.arc"), volume_bytes)
        for b in batches:
            for page, url, html in zip(*(c.to_pylist() for c in b.columns), strict=True):
                block = http_block(page, (html or "").encode("utf-8", "surrogatepass"))
                out.add(lambda v, u=url, x=block: arc_head(version(v), clean_url(u), "text/html", x) + x)
                yield from out.flush(FLUSH_BYTES)
        yield from out.flush()

    rows = pages.select(F.col("page_id").cast("long"), "url", "html").mapInArrow(run, "volume int, seq bigint, data binary")
    _write(rows, path, "\n")


def header_pattern(layout: str) -> re.Pattern:
    return re.compile(" ".join("(" + FIELDS.get(n, r"\S+") + ")" for n in layout.split()))


def parse_header(line: bytes, layout: str | None) -> dict[str, str] | None:
    """The fields of a header line; None if it does not fit. Without a layout both versions are tried."""
    text = line.decode("utf-8", "replace").rstrip("\r\n")
    for names in [layout] if layout else [LAYOUTS["2"], LAYOUTS["1"]]:
        if m := header_pattern(names).fullmatch(text):
            return dict(zip(names.split(), m.groups(), strict=True))
    return None


class Source:
    """A stream that counts its bytes and takes some of them back."""

    def __init__(self, stream):
        self.stream, self.back, self.used, self.at = stream, b"", 0, 0

    def read(self, n: int) -> bytes:
        parts = [self.back[self.used : self.used + n]]
        got = len(parts[0])
        self.used += got
        while got < n and (more := self.stream.read(min(n - got, FLUSH_BYTES))):
            parts.append(more)
            got += len(more)
        self.at += got
        return b"".join(parts)

    def readline(self) -> bytes:
        end = self.back.find(b"\n", self.used) + 1
        line = self.back[self.used : end] if end else self.back[self.used :] + self.stream.readline()
        self.used = end or len(self.back)
        self.at += len(line)
        return line

    def push(self, data: bytes) -> None:
        self.back, self.used, self.at = data + self.back[self.used :], 0, self.at - len(data)


def _ends_here(source: Source, layout: str | None) -> bool:
    """Whether a record may end at this place: at a line end, the file's end, or before a header line."""
    after = source.read(1)
    if after in (b"", b"\n", b"\r"):
        return True
    line = after + source.readline()
    source.push(line)
    return bool(SCHEME.match(line)) and parse_header(line, layout) is not None


def parse_arc(stream, name: str = "", strict: bool = True) -> Iterator[dict]:
    """Records of an unpacked ARC file: the header's fields, its place ``at``, and the bytes of its ``block``.

    What cannot be read raises an error, or, unless ``strict``, is given as a row of ``damage`` and ``at``.
    """
    source, layout, first, lost = Source(stream), None, True, False

    def damage(at: int, why: str) -> dict:
        if strict:
            raise ValueError(f"{name}, byte {at}: {why}")
        return {"damage": why, "at": at}

    while True:
        at = source.at
        try:
            line = source.readline()
            if not line:
                return
            if not line.strip() or (lost and not SCHEME.match(line)):
                continue  # records are set apart by a line end
            record = parse_header(line, layout)
            if record is None:
                if not lost:
                    yield damage(at, f"header line does not fit its version: {line[:200]!r}")
                lost = True
                continue
            block = source.read(int(record["Archive-length"]))
            whole = len(block) == int(record["Archive-length"])
            said = block.decode("utf-8", "replace").split("\n") if first and record["URL"].startswith("filedesc:") else []
            names = None
            if said and said[0].split(" ")[0] in LAYOUTS:
                names = (said[1].strip() if len(said) > 1 else "") or LAYOUTS[said[0].split(" ")[0]]
            fits = whole and _ends_here(source, names if first else layout)
        except TORN as e:
            yield damage(at, f"the file cannot be read from here on: {e}")
            return
        lost = not fits
        if not fits:
            yield damage(at, f"declared length of {record['URL']} does not fit" if whole else f"block of {record['URL']} is shorter than declared")
            source.push(block)
            continue
        opened, first = first, False
        if opened:
            layout = names
            if names is None:
                yield damage(at, "no version block of a known version")
            if said:
                continue
        yield record | {"at": at, "block": block}


def _tag(page: int, digest: str) -> int:
    return int.from_bytes(hashlib.sha1(f"{page}|{digest}".encode()).digest()[:8]) >> 6


def record_id(page: int | None, place: str, digest: str) -> str:
    """A UUID: of a page's record it holds the page id and 58 bits of a hash, of another it is named by the record's place."""
    if page is None:
        return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{place}|{digest}')}>"
    word = page & (1 << 64) - 1
    high, low = word >> 4, (word & 15) << 58 | _tag(page, digest)
    return f"<urn:uuid:{uuid.UUID(int=high >> 12 << 80 | 8 << 76 | (high & 0xFFF) << 64 | 2 << 62 | low)}>"


def page_of(record: str | None, digest: str) -> int | None:
    """The page id in a record id, if it holds one that goes with the payload's digest."""
    m = re.fullmatch(r"<urn:uuid:([0-9a-f-]{36})>", record or "")
    if not m:
        return None
    v = int(m[1].replace("-", ""), 16)
    word = (v >> 80) << 16 | (v >> 64 & 0xFFF) << 4 | (v >> 58 & 15)
    page = word - (1 << 64) if word >> 63 else word
    return page if (v >> 76 & 15, v >> 62 & 3) == (8, 2) and v & (1 << 58) - 1 == _tag(page, digest) else None


def page_field(fields: dict[str, str]) -> int | None:
    """The page id that :func:`http_block` put into a head."""
    said = fields.get("x-page-id", "")
    return int(said) if re.fullmatch(r"-?\d{1,19}", said, re.ASCII) and -(1 << 63) <= int(said) < 1 << 63 else None


def iso_time(digits: str) -> str:
    """The date of an ARC header as WARC wants it, by as many leading parts as make a date."""
    for n in (14, 12, 10, 8, 6, 4):
        part = digits[:n]
        if len(part) == n:
            try:
                return datetime.strptime(part + "00000101000000"[n:], "%Y%m%d%H%M%S").strftime("%Y-%m-%dT%H:%M:%SZ").rjust(20, "0")
            except ValueError:
                continue
    return iso_time(ARCHIVED)


def _volumes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")


def _unpacked(content: bytes):
    return gzip.GzipFile(fileobj=io.BytesIO(content)) if content[:2] == b"\x1f\x8b" else io.BytesIO(content)


ARC_COLUMNS = {"page_id": pa.int64(), "url": pa.string(), "date": pa.string(), "mime": pa.string(), "head": pa.binary(),
               "payload": pa.binary(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "path": pa.string(), "at": pa.int64(), "damage": pa.string()}
ARC_SCHEMA = ("page_id bigint, url string, date string, mime string, head binary, payload binary, payload_bytes bigint, payload_digest string, "
              "path string, at bigint, damage string")


def _batched(rows: Iterator[tuple[tuple, int]], columns: dict) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for row, n in rows:
        held.append(row)
        size += n + 200
        if size >= FLUSH_BYTES:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), columns.values(), strict=True)], list(columns))
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), columns.values(), strict=True)], list(columns))


def _arc_rows(spark: SparkSession, path: str, payloads: bool) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for b in batches:
                for i in range(b.num_rows):
                    name = b.column(0)[i].as_py()
                    for r in parse_arc(_unpacked(b.column(1)[i].as_buffer().to_pybytes()), name, strict=False):
                        if "damage" in r:
                            yield (*[None] * 8, name, r["at"], r["damage"]), 0
                            continue
                        head, body, fields = split_http(r["block"])
                        kept = (head, body) if payloads else (None, None)
                        yield (page_field(fields), clean_url(r["URL"]), r["Archive-date"], r["Content-type"], *kept, len(body),
                               base32_sha1(body), name, r["at"], None), len(r["block"]) if payloads else 0
        yield from _batched(rows(), ARC_COLUMNS)

    return _volumes(spark, path).mapInArrow(run, ARC_SCHEMA)


def read_arc(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """Sound records of the ARC files below ``path``; without ``payloads`` those columns are null."""
    return _arc_rows(spark, path, payloads).filter("damage IS NULL").drop("damage")


def damaged(spark: SparkSession, path: str) -> DataFrame:
    """(path, at, damage) of whatever below ``path`` could not be read; ``at`` counts unpacked bytes."""
    return _arc_rows(spark, path, False).filter("damage IS NOT NULL").select("path", "at", "damage")


def warc_record(kind: str, headers: list[tuple[str, str]], block: bytes) -> bytes:
    """One record without the blank lines behind it, which the sink adds."""
    lines = ["WARC/1.1", f"WARC-Type: {kind}", *(f"{k}: {v}" for k, v in headers), f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode("utf-8", "surrogatepass") + block


def convert(spark: SparkSession, arc_path: str, warc_path: str, min_revisit: int = MIN_REVISIT, volume_bytes: int = VOLUME_BYTES) -> None:
    """Write the ARC records below ``arc_path`` as WARC files below ``warc_path``."""
    known = read_arc(spark, arc_path, payloads=False).filter(F.col("payload_bytes") >= min_revisit)
    firsts = known.groupBy("payload_digest", F.isnull("page_id").alias("apart")).agg(
        F.min(F.struct("page_id", "path", "at")).alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        info = b"software: folioscript\r\nformat: WARC file version 1.1\r\n"

        def opened(volume: int) -> bytes:
            return warc_record("warcinfo", [("WARC-Record-ID", record_id(None, f"{_task()}-{volume}", "info")), ("WARC-Date", iso_time(ARCHIVED)),
                                            ("Content-Type", "application/warc-fields")], info)

        out = Volumes(opened, volume_bytes)
        for b in batches:
            for page, url, date, mime, head, payload, digest, path, at, found, first, first_path, first_at in zip(*(c.to_pylist() for c in b.columns), strict=True):
                revisit = found and (page != first if page is not None else (path, at) != (first_path, first_at))
                block = head if revisit else head + payload
                headers = [("WARC-Record-ID", record_id(page, f"{path}|{at}", digest)), ("WARC-Date", iso_time(date)), ("WARC-Target-URI", url),
                           ("WARC-Payload-Digest", f"sha1:{digest}"), ("WARC-Block-Digest", f"sha1:{base32_sha1(block)}"),
                           ("Content-Type", "application/http; msgtype=response" if head else mime or "application/octet-stream")]
                if revisit:
                    headers += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", record_id(first, f"{first_path}|{first_at}", digest))]
                kind = "revisit" if revisit else "response" if head else "resource"
                out.add(lambda v, k=kind, h=headers, x=block: warc_record(k, h, x))
                yield from out.flush(FLUSH_BYTES)
        yield from out.flush()

    rows = read_arc(spark, arc_path).withColumn("apart", F.isnull("page_id")).join(firsts, ["payload_digest", "apart"], "left").select(
        "page_id", "url", "date", "mime", "head", "payload", "payload_digest", "path", "at",
        F.isnotnull("first"), F.col("first.page_id").alias("first_page"), F.col("first.path").alias("first_path"), F.col("first.at").alias("first_at"))
    _write(rows.mapInArrow(run, "volume int, seq bigint, data binary"), warc_path, "\r\n\r\n")


def parse_warc(stream, name: str = "") -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers by lower-case name, block) of every record of an unpacked WARC file."""
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"{name}: no WARC record at {line[:80]!r}")
        headers: dict[str, str] = {}
        while (line := stream.readline()) and line.strip():
            k, _, v = line.decode("utf-8", "replace").partition(":")
            headers[k.strip().lower()] = v.strip()
        size = int(headers["content-length"])
        block = stream.read(size)
        if len(block) != size:
            raise ValueError(f"{name}: short block")
        yield headers, block


WARC_COLUMNS = {"page_id": pa.int64(), "url": pa.string(), "record_id": pa.string(), "record_type": pa.string(), "payload_bytes": pa.int64(),
                "payload_digest": pa.string(), "refers_to": pa.int64(), "refers_to_record": pa.string(), "payload": pa.binary()}
WARC_SCHEMA = ("page_id bigint, url string, record_id string, record_type string, payload_bytes bigint, payload_digest string, "
               "refers_to bigint, refers_to_record string, payload binary")


def read_warc(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """Records below ``path`` except warcinfo. Payload digests of stored payloads are computed anew and must agree."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for b in batches:
                for i in range(b.num_rows):
                    name = b.column(0)[i].as_py()
                    for h, block in parse_warc(_unpacked(b.column(1)[i].as_buffer().to_pybytes()), name):
                        kind = h["warc-type"]
                        if kind == "warcinfo":
                            continue
                        _, body, fields = split_http(block)
                        revisit, said = kind == "revisit", h.get("warc-payload-digest", "")
                        digest = said[5:].upper() if said.lower().startswith("sha1:") else None
                        if not revisit:
                            if digest is not None and base32_sha1(body) != digest:
                                raise ValueError(f"{name}: payload of {h['warc-record-id']} differs from its digest")
                            digest = base32_sha1(body)
                        size = fields.get("content-length", "")
                        page, refers = page_of(h["warc-record-id"], digest or ""), h.get("warc-refers-to")
                        yield (page, h.get("warc-target-uri"), h["warc-record-id"], kind,
                               (int(size) if size.isdecimal() else None) if revisit else len(body), digest, page_of(refers, digest or ""), refers,
                               body if payloads and not revisit else None), len(body) if payloads else 0
        yield from _batched(rows(), WARC_COLUMNS)

    return _volumes(spark, path).mapInArrow(run, WARC_SCHEMA)


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    arc, warc = shared_dir(spark, "arc"), shared_dir(spark, "warc")
    write_arc(table(spark, sf_dir, "pages"), arc)
    convert(spark, arc, warc)
    return read_warc(spark, warc, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, octet_length(b) AS payload_bytes, unhex(sha1(b))::BIT::VARCHAR AS bits FROM p),
e AS (SELECT page_id, payload_bytes, list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1
    + 16 * CAST(substr(bits, 5 * i + 1, 1) AS INT) + 8 * CAST(substr(bits, 5 * i + 2, 1) AS INT) + 4 * CAST(substr(bits, 5 * i + 3, 1) AS INT)
    + 2 * CAST(substr(bits, 5 * i + 4, 1) AS INT) + CAST(substr(bits, 5 * i + 5, 1) AS INT) AS INT), 1)), 'string_agg', '') AS payload_digest FROM d),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM e)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
    CASE WHEN page_id <> first THEN first END AS refers_to FROM f
"""
