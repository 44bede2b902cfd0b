"""WARC archives: commits that add up, archives of others, and the bytes that a reader takes."""

import gzip
import io

import pytest

from braidline.llm import skew, warc

PAGES = "page_id long, url string, html string"


def record(kind, block, *lines):
    head = ["WARC/1.0", f"WARC-Type: {kind}", "WARC-Record-ID: <urn:x>", *lines, f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


HTTP = "Content-Type: application/http; msgtype=response"
RECORDS = [
    record("warcinfo", b"software: x\r\n\r\nmore", "Content-Type: application/warc-fields"),
    record("response", b"HTTP/1.1 200 OK\r\nServer:x\r\n\r\n" + b"page" * 3000, HTTP, "WARC-Target-URI:http://a/"),
    record("revisit", b"HTTP/1.1 200 OK\r\nContent-Length:12000\r\n\r\n", HTTP),
    record("revisit", b"HTTP/1.1 200 OK\r\nServer: x\r\n\r\n", HTTP),
    record("resource", b"text\r\n\r\nbody", "Content-Type: text/plain", "WARC-Target-URI: http://b/\r\n c"),
    record("metadata", b""),
]
WANT = [("warcinfo", None, 19), ("response", "http://a/", 12000), ("revisit", None, 12000), ("revisit", None, None), ("resource", "http://b/ c", 12), ("metadata", None, 0)]


def write(spark, rows, path, mode):
    warc.register(spark)
    warc.as_records(spark.createDataFrame(rows, PAGES)).write.format("warc").mode(mode).save(path)


def ids(spark, path):
    return sorted(r.page_id for r in spark.read.format("warc").load(path).select(warc.page_id("record_id").alias("page_id")).collect())


def test_appends_add_up_and_overwrites_replace(spark, tmp_path):
    path = f"file://{tmp_path}/w"
    write(spark, [(1, "a", "x"), (2, "b", "y")], path, "append")
    write(spark, [(3, "c", "z")], path, "append")
    (tmp_path / "w" / "part-left-by-a-lost-task.warc.gz").write_bytes(b"junk")
    assert ids(spark, path) == [1, 2, 3]
    write(spark, [(4, "d", "x")], path, "overwrite")
    assert ids(spark, path) == [4]
    assert len([*(tmp_path / "w").iterdir()]) == 2
    (tmp_path / "w" / "other.warc").write_bytes(RECORDS[1])
    assert spark.read.format("warc").load(path).count() == 2


@pytest.mark.parametrize("kind", ["plain", "members", "one member"])
def test_archives_of_others(spark, tmp_path, kind):
    warc.register(spark)
    data = b"".join(RECORDS) if kind == "plain" else b"".join(map(gzip.compress, RECORDS)) if kind == "members" else gzip.compress(b"".join(RECORDS))
    name = tmp_path / ("x.warc" if kind == "plain" else "x.warc.gz")
    name.write_bytes(data)
    read = spark.read.format("warc").load(f"file://{name}")
    rows = read.select("record_type", "target_uri", "payload_bytes").collect()
    assert [tuple(r) for r in rows] == WANT
    payloads = [bytes(r.payload) for r in read.collect()]
    assert payloads == [b"software: x\r\n\r\nmore", b"page" * 3000, b"", b"", b"text\r\n\r\nbody", b""]
    assert [r.payload_bytes for r in read.where("record_type = 'resource'").collect()] == [12]


class Counted(io.BytesIO):
    taken = 0

    def size(self):
        return len(self.getvalue())

    def read(self, n=-1):
        data = super().read(n)
        self.taken += len(data)
        return data


@pytest.mark.parametrize("html", ["small", "large"])
def test_bytes_are_read_once_and_large_payloads_passed_over(html):
    import random

    rng = random.Random(1)
    size, n = (500, 4000) if html == "small" else (8 << 20, 3)
    rows = [{"payload": rng.randbytes(size), "record_type": "response", "record_id": f"<urn:{i}>", "target_uri": "u", "refers_to": None} for i in range(n)]
    f = Counted(b"".join(warc.member(warc.record(r)) for r in rows))
    headers = warc.T.StructType([x for x in warc.SCHEMA.fields if x.name != "payload"])
    found = [*warc.WarcReader("/", headers).rows(f)]
    assert [r[1] for r in found] == [r["record_id"] for r in rows] and {r[5] for r in found} == {size}
    assert f.taken <= (1.2 * f.size() if html == "small" else 0.3 * f.size())
    whole = [*warc.WarcReader("/", warc.SCHEMA).rows(Counted(f.getvalue()))]
    assert [r[6] for r in whole] == [r["payload"] for r in rows]


def test_a_hot_payload_and_odd_columns(spark, monkeypatch):
    monkeypatch.setattr(skew, "HOT_SHARE", 0.1)
    rows = [(i, "u", "same" if i % 2 else f"page {i // 4}") for i in range(40)] + [(None, None, "same"), (40, "v", None), (41, "v", "")]
    df = spark.createDataFrame(rows, PAGES).selectExpr("*", "1 as sha1", "2 as last", "3 as key", "4 as payload", "5 as hot_last")
    got = {r.page_id: r for r in warc.write_and_read(df).collect()}
    groups = {}
    for i, _, html in rows:
        groups.setdefault(html or "", []).append(i)
    for ids in groups.values():
        last = max(i for i in ids if i is not None)
        for i in ids:
            assert (got[i].record_type, got[i].refers_to) == (("response", None) if i == last else ("revisit", last))


def test_a_cut_archive_is_told(tmp_path):
    f = Counted(gzip.compress(RECORDS[1])[:-30])
    with pytest.raises(ValueError):
        [*warc.WarcReader("/", warc.SCHEMA).rows(f)]
