"""WARC archives: segmented records with chunked HTTP bodies are written, read back, reassembled and decoded."""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contagraph.llm.common import col, scratch, stash, table

#: A record's block is cut into segments of so many bytes, so a file holds at most RECORDS times a little more.
SEGMENT, CHUNK, RECORDS = 16_384, 4_096, 2_000
_DATE = "2020-01-01T00:00:00Z"
_END, _GZIP = "\r\n\r\n", b"\x1f\x8b\x08"


def chunked(payload: bytes, size: int = CHUNK) -> bytes:
    parts = [payload[i : i + size] for i in range(0, len(payload), size)]
    return b"".join(b"%x\r\n%s\r\n" % (len(p), p) for p in parts) + b"0\r\n\r\n"


def dechunked(body: bytes) -> bytes:
    """The payload of a chunked body; extensions and trailers are skipped. Raises ValueError if the framing is broken."""
    out, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        if end < 0:
            raise ValueError("a chunk has no size line")
        size = int(body[at:end].split(b";")[0], 16)
        if size < 0:
            raise ValueError("a chunk's size is below 0")
        at = end + 2
        if size == 0:
            return b"".join(out)
        if body[at + size : at + size + 2] != b"\r\n":
            raise ValueError("a chunk is shorter than its size")
        out.append(body[at : at + size])
        at += size + 2


def payload_of(block: bytes) -> bytes:
    """The payload of an HTTP response: chunks are put together where `chunked` is the last transfer coding of the header."""
    head, _, body = block.partition(b"\r\n\r\n")
    codings: list[bytes] = []
    unfolded = re.sub(rb"\r?\n[ \t]+", b" ", head)
    for line in unfolded.splitlines()[1:]:
        name, _, value = line.partition(b":")
        if name.strip().lower() == b"transfer-encoding":
            codings += [x.strip().lower() for x in value.split(b",") if x.strip()]
    return dechunked(body) if codings[-1:] == [b"chunked"] else body


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _record(kind: str, headers: dict[str, str], block: bytes) -> bytes:
    lines = {"WARC-Type": kind, "WARC-Date": _DATE, **headers, "Content-Length": str(len(block))}
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in lines.items()) + "\r\n").encode() + block


def response(headers: dict[str, str], block: bytes, segment: int = SEGMENT) -> list[bytes]:
    """A response record, or, if its block is longer than a segment, its first segment and continuations."""
    if len(block) <= segment:
        return [_record("response", headers, block)]
    parts = [block[i : i + segment] for i in range(0, len(block), segment)]
    out = [_record("response", {**headers, "WARC-Segment-Number": "1"}, parts[0])]
    origin = headers["WARC-Record-ID"]
    for i, part in enumerate(parts[1:], 2):
        more = {"WARC-Record-ID": f"{origin[:-1]}/{i}>", "WARC-Segment-Origin-ID": origin, "WARC-Segment-Number": str(i)}
        out.append(_record("continuation", {**more, "WARC-Segment-Total-Length": str(len(block))} if i == len(parts) else more, part))
    return out


def write_warc(pages: DataFrame, path: str, min_bytes: int = 0, segment: int = SEGMENT) -> None:
    """Write a record for each row of pages (page_id, url, html) to gzipped files under path.

    The payload is html in UTF-8, null as empty. Of equal payloads of at least min_bytes, the row with the largest
    page_id (nulls are smallest) is a response; the others are revisits of it. Smaller ones are all responses, and so
    are all rows that repeat the largest page_id. Null urls become about:blank.
    """
    rows = pages.select(col("page_id").cast("long").alias("page_id"), col("url").alias("url"), F.coalesce(col("html"), F.lit("")).alias("html"))
    rows = rows.withColumn("sha", F.sha1(F.col("html").cast("binary")))
    small = rows.select("sha", "page_id", F.octet_length("html").alias("n")).where(F.col("n") >= min_bytes)
    equal = small.groupBy("sha", "page_id").agg(F.count("*").alias("m")).groupBy("sha").agg(F.max(F.struct("page_id", "m")).alias("x"), F.sum("m").alias("all"))
    # written first, so that adaptive execution can split a payload that many pages share
    equal = stash(equal.where(F.col("all") > 1).select("sha", F.col("x.page_id").alias("last"), F.col("x.m").alias("m")), "warc-equal")
    joined = rows.join(equal, "sha", "left")
    joined = joined.withColumn("again", F.col("m").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("last")))
    alone = F.coalesce(F.col("m"), F.lit(2)) == 1  # the only row of its id and payload that others can refer to
    stem = F.concat(F.lit("<urn:page:"), F.coalesce(F.when(F.col("again"), F.col("last")).otherwise(F.col("page_id")).cast("string"), F.lit("none")), F.lit(":"), F.col("sha"))
    nth = F.monotonically_increasing_id().cast("string")
    own = F.when(F.col("again") | ~alone, F.concat(F.lit("<urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("none")), F.lit(":"), F.col("sha"), F.lit(":"), nth, F.lit(">"))).otherwise(F.concat(stem, F.lit(">")))
    ready = joined.select("page_id", "url", F.when(F.col("again"), F.lit("")).otherwise(F.col("html")).alias("html"), "again", own.alias("own"), F.concat(stem, F.lit(">")).alias("to"), "sha")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                url = (r["url"] or "about:blank").replace("\r", "%0D").replace("\n", "%0A")
                headers = {"WARC-Record-ID": r["own"], "WARC-Target-URI": url, "Content-Type": "application/http; msgtype=response"}
                if r["page_id"] is not None:
                    headers["X-Page-ID"] = str(r["page_id"])
                headers["WARC-Payload-Digest"] = "sha1:" + base64.b32encode(bytes.fromhex(r["sha"])).decode()
                if r["again"]:
                    more = {"WARC-Refers-To": r["to"], "WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"}
                    out.append(_record("revisit", {**headers, **more}, b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n"))
                else:
                    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
                    out += response(headers, head + chunked(r["html"].encode()), segment)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])

    # the writer ends each row with lineSep, which here is what ends a WARC record
    ready.mapInArrow(run, "value binary").select(F.col("value").cast("string")).write.option("lineSep", _END).option("compression", "gzip").option("maxRecordsPerFile", RECORDS).text(path)


class Fault(Exception):
    """Bytes that can't be read; the reader stands where it may go on."""

    def __init__(self, member: int) -> None:
        self.member = member


class Archive:
    """The bytes of an archive, plain or gzipped in any number of members, unzipped a piece at a time."""

    def __init__(self, content: bytes) -> None:
        self.content, self.at, self.held = memoryview(content), 0, b""
        self.zipped, self.z, self.start, self.member = content[:2] == _GZIP[:2], None, 0, 0

    def more(self) -> bool:
        """Hold some more bytes; false at the end. After a damaged member the next one comes."""
        while self.at < len(self.content):
            piece = self.content[self.at : self.at + 65_536]
            if not self.zipped:
                self.at += len(piece)
                self.held += piece
                return True
            if self.z is None:
                self.z, self.start, self.member = zlib.decompressobj(31), self.at, self.member + 1
            try:
                found = self.z.decompress(piece)
            except zlib.error:
                raise self._damaged() from None
            self.at += len(piece) - len(self.z.unused_data)
            if self.z.eof:
                self.z = None
            if found:
                self.held += found
                return True
        if self.z is not None:
            raise self._damaged()
        return False

    def _damaged(self) -> Fault:
        self.at, self.z, self.held = self._member_after(self.start), None, b""
        return Fault(self.member)

    def _member_after(self, start: int) -> int:
        """Where the next member may begin, or the end."""
        for i in range(start + 1, len(self.content), 1 << 20):
            found = bytes(self.content[i : i + (1 << 20) + len(_GZIP) - 1]).find(_GZIP)
            if found >= 0:
                return i + found
        return len(self.content)

    def line(self) -> bytes:
        """The next line, with its end; what is left where there is none."""
        while (end := self.held.find(b"\n")) < 0 and self.more():
            pass
        end = len(self.held) if end < 0 else end + 1
        out, self.held = self.held[:end], self.held[end:]
        return out

    def read(self, n: int) -> bytes:
        """n bytes, or fewer at the end."""
        parts, size = [self.held], len(self.held)
        while size < n:
            self.held = b""
            if not self.more():
                break
            parts.append(self.held)
            size += len(self.held)
        whole = b"".join(parts)
        self.held = whole[n:]
        return whole[:n]

    def seek_record(self, behind: bytes = b"") -> Fault:
        """Go on at the next line that begins a record, in bytes read already or after them."""
        self.held = behind + self.held
        while (found := re.search(rb"\n(?=WARC/)", self.held)) is None:
            self.held = self.held[-8:]
            try:
                if not self.more():
                    self.held = b""
                    break
            except Fault:
                break
        else:
            self.held = self.held[found.end() :]
        return Fault(self.member)


def records(archive: Archive) -> Iterator[tuple[dict[str, str], bytes] | None]:
    """Headers (names in lower case) and block of each record, one at a time; None for each run of bytes that hold no whole one.

    A record is passed on when what follows it is known: the last one of a member whose checksum fails isn't.
    """
    waiting, member, gap = None, 0, False
    while True:
        try:
            found = _record_of(archive)
        except Fault as fault:
            if waiting and not (archive.zipped and member == fault.member):
                yield waiting
                gap = False
            waiting = None
            if not gap:
                yield None
            gap = True
            continue
        if waiting:
            yield waiting
        if found is None:
            return
        waiting, member, gap = found, archive.member, False


def _record_of(archive: Archive) -> tuple[dict[str, str], bytes] | None:
    """The next record; None at the end."""
    while (line := archive.line()) in (b"\r\n", b"\n"):
        pass
    if not line:
        return None
    if not line.startswith(b"WARC/"):
        raise archive.seek_record(b"\n")
    headers = {}
    while (line := archive.line()) not in (b"\r\n", b"\n"):
        if not line or line.startswith(b"WARC/"):
            raise archive.seek_record(b"\n" + line)
        k, _, v = line.decode("utf-8", "replace").partition(":")
        headers[k.strip().lower()] = v.strip()
    if not re.fullmatch(r"[0-9]{1,18}", headers.get("content-length", "")):
        raise archive.seek_record(b"\n")
    n = int(headers["content-length"])
    block = archive.read(n)
    behind = archive.read(4)
    if len(block) < n or not re.match(rb"\r?\n|\Z", behind):
        raise archive.seek_record(b"\n" + block + behind)
    archive.held = behind + archive.held
    return headers, block


def _number(text: str | None) -> int | None:
    return int(text) if text and re.fullmatch(r"-?[0-9]{1,18}", text) else None


def _decoded(block: bytes, said: str | None) -> dict:
    """payload, its length and digest, and whether that is the one said; only intact: false if the framing is broken."""
    try:
        payload = payload_of(block)
    except ValueError:
        return {"payload": None, "payload_bytes": None, "payload_digest": said, "intact": False}
    own = digest(payload)
    return {"payload": payload, "payload_bytes": len(payload), "payload_digest": own, "intact": said in (None, own)}


_ROW = {"record_id": "string", "record_type": "string", "page_id": "long", "refers_to": "string", "payload_digest": "string", "payload_bytes": "long", "intact": "boolean", "payload": "binary"}
_PIECE = {"origin": "string", "segment": "int", "total": "long", "page_id": "long", "said": "string", "block": "binary"}
_ARROW = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "binary": pa.binary()}


def _schemas(fields: dict[str, str]) -> tuple[pa.Schema, str]:
    return pa.schema([(k, _ARROW[v]) for k, v in fields.items()]), ", ".join(f"{k} {v}" for k, v in fields.items())


def _rows(content: bytes, segments: bool) -> Iterator[dict]:
    """Of an archive, plain or gzipped in any number of members: its segments, or all else."""
    for record in records(Archive(content)):
        if record is None:
            if not segments:
                yield {"record_type": "unreadable", "intact": False}
            continue
        h, block = record
        kind, said = h.get("warc-type"), h.get("warc-payload-digest", "").removeprefix("sha1:") or None
        number, page = _number(h.get("warc-segment-number")) or 0, _number(h.get("x-page-id"))
        if kind not in ("response", "revisit", "continuation") or (number > 0) != segments:
            continue
        if segments:
            origin = h.get("warc-segment-origin-id", h.get("warc-record-id"))
            yield {"origin": origin, "segment": min(number, 2**31 - 1), "total": _number(h.get("warc-segment-total-length")), "page_id": page, "said": said, "block": block}
        else:
            row = {"record_id": h.get("warc-record-id"), "record_type": kind, "page_id": page, "refers_to": h.get("warc-refers-to"), "payload_digest": said, "payload_bytes": None, "intact": kind == "revisit", "payload": None}
            yield row | _decoded(block, said) if kind == "response" else row


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """One row a record: record_id, record_type, page_id, refers_to, payload_digest, payload_bytes, intact, payload.

    Segments are grouped by the first one's id, put in order, and their length is held against the total the last one
    states; a missing segment, two different ones of a number, another length or digest, or broken chunks make intact
    false and leave the payload null where there is none. An archive that breaks off, or isn't one, gives its records up
    to there and a row of type `unreadable`. Repeated records stay, segmented ones as often as their rarest segment.
    An empty archive gives no row. A revisit's payload is null. Records are read one by one from the archive's bytes,
    which the reader takes whole (at most 2 GB each); it parses twice, for segments and for all else.
    """
    row_schema, row_ddl = _schemas(_ROW)
    piece_schema, piece_ddl = _schemas(_PIECE)

    def parse(segments: bool):
        schema = piece_schema if segments else row_schema

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for content in batch.column(0):
                    rows = _rows(content.as_py(), segments)
                    while out := list(islice(rows, 256)):
                        yield pa.RecordBatch.from_pylist(out, schema=schema)

        return run

    archives = spark.read.format("binaryFile").load(path).select("content")
    whole = archives.mapInArrow(parse(False), row_ddl)
    pieces = (
        archives.mapInArrow(parse(True), piece_ddl)
        .groupBy("origin", F.when(F.col("origin").isNull(), F.monotonically_increasing_id()).alias("lone"))
        .agg(F.sort_array(F.collect_list(F.struct("segment", "block"))).alias("parts"), F.max("total").alias("total"), F.max("page_id").alias("page_id"), F.max("said").alias("said")).drop("lone")
    )

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 64):
                out = []
                for r in batch.slice(i, 64).to_pylist():
                    times = Counter(p["segment"] for p in r["parts"])
                    parts = dict(sorted((p["segment"], p["block"]) for p in r["parts"]))
                    block = b"".join(parts.values())
                    row = {"record_id": r["origin"], "record_type": "response", "page_id": r["page_id"], "refers_to": None, "payload_digest": r["said"], "payload_bytes": None, "intact": False, "payload": None}
                    same = all(p["block"] == parts[p["segment"]] for p in r["parts"])
                    if same and list(parts) == list(range(1, len(parts) + 1)) and len(block) == r["total"]:
                        row |= _decoded(block, r["said"])
                    out += [row] * min(times.values())
                yield pa.RecordBatch.from_pylist(out, schema=row_schema)

    return whole.unionByName(pieces.mapInArrow(join, row_ddl))


def revisits_resolved(read: DataFrame) -> DataFrame:
    """read without payloads; refers_to is the response's page_id, and revisits have its payload_bytes.

    Rows that are neither response nor revisit go; a revisit whose response is missing isn't intact.
    """
    slim = stash(read.drop("payload"), "warc-rows")
    stem = F.regexp_replace("record_id", "^(<urn:page:[^:]*:[^:]*)(:.*)?>$", "$1>")
    again = slim.where(F.col("record_type") == "revisit")
    needed = slim.where(F.col("record_type") == "response").groupBy(stem.alias("to")).agg(F.max("page_id").alias("to_page"), F.max("payload_bytes").alias("to_bytes"))
    needed = stash(needed, "warc-responses")  # so that a response with many revisits can be split
    found = again.join(needed, again["refers_to"] == needed["to"], "left").select("record_id", "record_type", "page_id", F.col("to_page").alias("refers_to"), "payload_digest", F.col("to_bytes").alias("payload_bytes"), (F.col("intact") & F.col("to").isNotNull()).alias("intact"))
    return slim.where(F.col("record_type") == "response").withColumn("refers_to", F.lit(None).cast("long")).unionByName(found)


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "warc")
    write_warc(table(spark, sf_dir, "pages").select("page_id", "url", "html"), path)
    return revisits_resolved(read_warc(spark, path)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "intact")


OP6_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, octet_length(b) AS n, sha1(b) AS h FROM p),
g AS (SELECT h, max(page_id) AS last FROM d GROUP BY h),
-- base 32 of the 160 bits: 32 groups of five, from pairs of hexadecimal digits
s AS (SELECT d.*, g.last,
        (SELECT string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (
            (((('0x' || substr(d.h || '000', 1 + (i * 5) // 4, 2))::INTEGER) >> (3 - (i * 5) % 4)) & 31)), 1), '' ORDER BY i)
         FROM range(32) t(i)) AS b32
      FROM d JOIN g ON d.h = g.h)
SELECT page_id, n::BIGINT AS payload_bytes, b32 AS payload_digest,
       CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> last THEN last END AS refers_to, true AS intact
FROM s
"""
