"""Archives with faults: each has a defined result, and none ends the read."""

import gzip
import re

from contagraph.llm import warc

BODY = b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n"


def record(page, payload=b"text", block=None, segment=10_000, kind=None):
    headers = {"WARC-Record-ID": f"<urn:page:{page}:x>", "X-Page-ID": str(page), "WARC-Payload-Digest": "sha1:" + warc.digest(payload)}
    return warc.response(headers, BODY + warc.chunked(payload) if block is None else block, segment)


def archive(records, member=True):
    parts = [r + b"\r\n\r\n" for r in records]
    return b"".join(map(gzip.compress, parts)) if member else b"".join(parts)


def read(spark, tmp_path, **files):
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    return sorted(((r["page_id"], r["record_type"], r["intact"], r["payload_bytes"], r["payload"] and bytes(r["payload"])) for r in warc.read_warc(spark, f"file://{tmp_path}").collect()), key=repr)


def test_broken_chunks(spark, tmp_path):
    """A chunk size that is no number, one below 0, a body that ends early; the records after them come all the same."""
    bad = [b"zz\r\ntext\r\n0\r\n\r\n", b"-4\r\ntext\r\n0\r\n\r\n", b"9\r\ntext", b""]
    rows = [r for i, b in enumerate(bad) for r in record(i, block=BODY + b)] + record(9)
    got = read(spark, tmp_path, a=archive(rows))
    assert got == [(i, "response", False, None, None) for i in range(4)] + [(9, "response", True, 4, b"text")]


def test_segments(spark, tmp_path):
    """Broken chunks, a missing segment, two different ones of a number, a wrong total; an archive that is read twice."""
    long = bytes(range(256)) * 40
    whole = record(1, long, segment=3000)
    lacking = record(2, long, segment=3000)
    del lacking[1]
    double = record(3, long, segment=3000)
    double.insert(2, double[1].replace(long[3000:3010], b"0" * 10))
    broken = record(4, block=BODY + b"ffff\r\n" + long, segment=3000)
    shuffled = record(5, long, segment=3000)[::-1]
    total = [r.replace(b"Total-Length: ", b"Total-Length: 9") for r in record(6, long, segment=3000)]
    got = read(spark, tmp_path, a=archive([*whole, *lacking, *double, *broken, *shuffled, *total]))
    none = lambda i: (i, "response", False, None, None)
    assert got == [(1, "response", True, len(long), long), none(2), none(3), none(4), (5, "response", True, len(long), long), none(6)]
    (tmp_path / "twice").mkdir()
    again = archive([*whole, *record(7)])
    got = read(spark, tmp_path / "twice", a=again, b=again)
    assert got == [(1, "response", True, len(long), long)] * 2 + [(7, "response", True, 4, b"text")] * 2


def test_archives_that_break_off(spark, tmp_path):
    """Records up to the fault come, and one row says that the rest doesn't."""
    plain = archive([*record(1), *record(2)], member=False)
    packed = archive([*record(3), *record(4)])
    got = read(spark, tmp_path, plain=plain[:-30], packed=packed[:-60], nothing=b"", other=b"no archive at all", length=plain.replace(b"Content-Length: ", b"Content-Length: x"))
    assert [g for g in got if g[1] == "response"] == [(1, "response", True, 4, b"text"), (3, "response", True, 4, b"text")]
    assert [g for g in got if g[1] != "response"] == [(None, "unreadable", False, None, None)] * 4


def test_records_after_damage_come(spark, tmp_path):
    """Ten members of which one is broken give nine records, wherever the flipped byte lies; other members and lines go on."""
    members = [gzip.compress(b"".join(r + b"\r\n\r\n" for r in record(i, f"text {i} ".encode() * 50))) for i in range(10)]
    starts = [sum(map(len, members[:i])) for i in range(10)]
    for n, at in enumerate((0, 1, 12, 60, len(members[1]) - 9, len(members[1]) - 6, len(members[1]) - 2)):
        data = bytearray(b"".join(members))
        data[starts[1] + at] ^= 0x55
        folder = tmp_path / f"zipped{n}"
        folder.mkdir()
        got = read(spark, folder, a=bytes(data))
        assert [g[0] for g in got if g[1] == "response" and g[2]] == [i for i in range(10) if i != 1]
        assert [g[1] for g in got if g[1] != "response"] == ["unreadable"]
    rows = [b"".join(record(i, f"plain {i}".encode())) + b"\r\n\r\n" for i in range(6)]
    rows[1] = rows[1].replace(b"Content-Length: ", b"Content-Length: 9")  # swallows what follows
    rows[3] = b"noise\r\n" + rows[3][9:]
    rows[4] = re.sub(rb"Content-Length: \d+", b"Content-Length: 20", rows[4])
    (tmp_path / "plain").mkdir()
    got = read(spark, tmp_path / "plain", a=b"".join(rows))
    assert [g[0] for g in got if g[1] == "response"] == [0, 2, 5] and sum(g[1] == "unreadable" for g in got) == 2


def test_transfer_coding_is_a_header_field(spark, tmp_path):
    head = lambda *lines: b"".join(x + b"\r\n" for x in (b"HTTP/1.1 200 OK", *lines)) + b"\r\n"
    framed = warc.chunked(b"text")
    forms = [b"Transfer-Encoding:chunked", b"transfer-encoding:\tChunked ", b"Transfer-Encoding: gzip, chunked", b"Transfer-Encoding: gzip\r\nTransfer-Encoding: chunked", b"Transfer-Encoding: gzip,\r\n chunked"]
    for form in forms:
        assert warc.payload_of(head(form) + framed) == b"text"
    for form in (b"X-Note: transfer-encoding: chunked", b"Transfer-Encoding: chunked, gzip", b"Transfer-Encoding: identity"):
        assert warc.payload_of(head(form) + framed) == framed


def test_segments_without_an_id_stand_alone(spark, tmp_path):
    parts = [r.replace(b"WARC-Record-ID", b"X-ID").replace(b"WARC-Segment-Origin-ID", b"X-Origin") for r in (*record(1, b"a" * 50, segment=80), *record(2, b"b" * 50, segment=80))]
    got = read(spark, tmp_path, a=archive(parts))
    assert [g[1:] for g in got] == [("response", False, None, None)] * len(parts) and len(parts) >= 4


def skewed(spark, run):
    """What run(spark) gives, with hot keys split from a few KB on and nothing broadcast."""
    held = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "10k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20k", "spark.sql.shuffle.partitions": "12", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k, None) for k in held}
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        return run(spark)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_a_payload_that_half_of_the_pages_share_is_split(spark, tmp_path):
    plans = []
    pages = spark.range(20_000).selectExpr("id as page_id", "'u' as url", "if(id % 2 = 0, 'the same', concat('page ', id)) as html").repartition(8)
    path = f"file://{tmp_path}/w"

    def run(spark):
        warc.write_warc(pages, path)
        found = warc.revisits_resolved(warc.read_warc(spark, path))
        rows = found.collect()
        plans.append(found._jdf.queryExecution().executedPlan().toString())
        return rows

    rows = skewed(spark, run)
    assert sum(r["record_type"] == "revisit" and r["refers_to"] == 19_998 for r in rows) == 9_999 and len(rows) == 20_000
    assert "skew=true" in plans[0]


def test_pages_without_rows(spark, tmp_path):
    """An empty table gives an archive without records; extra columns and repeated rows are fine."""
    schema = "page_id long, url string, html string, sha string, `own` int"
    path = f"file://{tmp_path}/w"
    warc.write_warc(spark.createDataFrame([], schema), path)
    assert warc.revisits_resolved(warc.read_warc(spark, path)).count() == 0
    rows = [(1, "u", "x", "a", 1), (1, "u", "x", "a", 1), (None, None, None, None, None), (None, "v", "x", "b", 2)]
    path = f"file://{tmp_path}/v"
    warc.write_warc(spark.createDataFrame(rows, schema), path, min_bytes=1)
    got = sorted(((r["page_id"] or 0, r["record_type"], r["refers_to"], r["payload_bytes"]) for r in warc.revisits_resolved(warc.read_warc(spark, path)).collect()), key=repr)
    assert got == [(0, "response", None, 0), (0, "revisit", 1, 1), (1, "response", None, 1), (1, "response", None, 1)]
