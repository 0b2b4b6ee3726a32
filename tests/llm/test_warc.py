import gzip
import hashlib

from ripplegraph.llm import warc

SCHEMA = "page_id long, url string, html string, digest string, payload int"


def pages(spark, rows):
    return spark.createDataFrame([(i, f"http://a/{i}", h, "d", 1) for i, h in rows], SCHEMA)


def read(spark, path, split):
    cols = ["record_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload", "digest_ok"]
    return sorted((tuple(r) for r in warc.read_archives(spark, path, split).select(*cols).collect()), key=str)


def test_round_trip_at_every_split_size(spark, tmp_path):
    big = "é<p>" * 60_000
    rows = [(1, big), (2, big), (9, big), (3, None), (4, ""), (5, "x" * 99), (6, "x" * 99), (None, big), (7, "y" * 100), (7, "y" * 100), (8, "WARC/1.1\r\n\r\n" * 20)]
    path = f"file://{tmp_path}/a"
    warc.write_archives(pages(spark, rows), path)
    want = []
    for i, h in rows:
        raw = (h or "").encode()
        first = {big: 1, "y" * 100: 7}.get(h)
        revisit = first is not None and i is not None and i != first
        want.append((None if i is None else str(i), len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if revisit else "response", str(first) if revisit else None, b"" if revisit else raw, True))
    whole = read(spark, path, 1 << 30)
    assert [tuple(bytes(x) if isinstance(x, bytearray) else x for x in r) for r in whole] == sorted(want, key=lambda r: str(tuple(bytearray(x) if isinstance(x, bytes) else x for x in r)))
    for split in (64, 1000, 4096):
        assert read(spark, path, split) == whole


def test_files_are_gzip_members(spark, tmp_path):
    warc.write_archives(pages(spark, [(1, "a"), (2, "b")]), f"file://{tmp_path}/a")
    text = b"".join(gzip.decompress(f.read_bytes()) for f in sorted((tmp_path / "a").glob("part-*")))
    assert text.count(b"WARC/1.1\r\n") == 2


def test_false_magic_is_not_a_record(tmp_path):
    member = warc._member("1", "u", b"body", hashlib.sha256(b"body").hexdigest(), None, "2020-01-01T00:00:00Z")
    data = b"\x1f\x8b\x08junk" + member + gzip.compress(b"not a record") + member + member[:30]
    scanner = warc.RangeScanner(lambda at, n: data[at : at + n], len(data), chunk=7)
    assert [at for at, _ in scanner.records(0, len(data))] == [7, 7 + len(member) + len(gzip.compress(b"not a record"))]


def test_empty(spark, tmp_path):
    warc.write_archives(pages(spark, [(1, "a")]).limit(0), f"file://{tmp_path}/a")
    assert read(spark, f"file://{tmp_path}/a", 100) == []


def test_lengths_that_are_no_numbers():
    for bad in (b"x", b"-3", b"", "１".encode()):
        record = warc.parse_record(b"WARC/1.0\r\nWARC-Type: response\r\nContent-Length: " + bad + b"\r\nX-Payload-Length: " + bad + b"\r\n\r\nbody")
        assert record["payload"] == b"body" and record["payload_bytes"] == 4
    assert warc.parse_record(b"WARC/1.0\r\nContent-Length: 2\r\n\r\nbody")["payload"] == b"bo"
