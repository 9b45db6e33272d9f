"""ZIP packages against the standard library's reader, ZIP64 fields, and an exact round trip through Spark."""
import base64
import hashlib
import io
import zipfile

import pytest

from modalframe.llm import zipwarc as z


class Bytes:
    def __init__(self, data):
        self.data = data

    def read_at(self, n, at):
        return self.data[at : at + n]


def _package(limit32=z.MAX32, limit16=z.MAX16, members=3):
    out = io.BytesIO()
    w = z.PackageWriter(out, limit32, limit16)
    for k in range(members):
        w.start(f"archive/data-{k}.warc.gz")
        w.write(b"x" * (100 + k))
        w.write(b"y")
    w.close()
    return out.getvalue()


@pytest.mark.parametrize("limits", [{}, {"limit16": 2}, {"limit32": 150}, {"limit32": 50, "limit16": 1}])
def test_directory(limits):
    data = _package(**limits)
    members = z.directory(Bytes(data), len(data))
    assert [m.name for m in members] == [f"archive/data-{k}.warc.gz" for k in range(3)]
    for k, m in enumerate(members):
        at = z.data_start(Bytes(data), m)
        assert m.size == 101 + k and data[at : at + m.size] == b"x" * (100 + k) + b"y"
    with zipfile.ZipFile(io.BytesIO(data)) as f:
        assert f.testzip() is None and f.namelist() == [m.name for m in members]


def test_foreign_packages():
    for n in (0, 5, 70_000):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as f:
            for k in range(n):
                f.writestr(f"m{k}", b"%d" % k)
            f.comment = b"note"
        data = out.getvalue()
        assert len(z.directory(Bytes(data), len(data))) == n
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as f:
        f.writestr("m", b"a" * 1000)
    with pytest.raises(ValueError):
        z.directory(Bytes(out.getvalue()), len(out.getvalue()))
    with pytest.raises(ValueError):
        z.directory(Bytes(b"nothing"), 7)


def test_record_round_trip():
    headers, block = z.parse_record(z.warc_record("response", "http://é/", "<urn:page:1>", "D", "a\r\n\r\nb é".encode(), 10, None))
    assert block == "a\r\n\r\nb é".encode() and headers["warc-target-uri"] == "http://é/"


def test_round_trip_on_spark(spark, tmp_path):
    rows = [(1, "u", "<p>é🙂</p>"), (2, "u\r\nX: y", "same"), (3, None, "same"), (4, "u", None), (5, "u", ""), (6, "u", "long " * 60_000), (0, "u", "same"), (0, "u", "same"), (None, "u", "same"), (7, "u", "A")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, sha string")
    got = sorted(map(repr, map(tuple, z.archive_pages(df).collect())))

    def row(i, html, first):
        raw = (html or "").encode()
        return (i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "response" if first == i else "revisit", None if first == i else first)

    first = {"same": 0, "": 4}
    assert got == sorted(repr(row(i, h, first.get(h or "", i))) for i, _, h in rows)
    assert z.archive_pages(df.limit(0)).collect() == []
    folder = f"file://{tmp_path}/a"
    packages = z.write_packages(df, folder)
    texts = {r.page: r.payload for r in z.read_records(z.index_records(packages, folder), folder, z.reading_tasks(packages)).collect() if r.record_type == "response" and r.page not in (0, None)}
    assert {k: bytes(v).decode() for k, v in texts.items()} == {1: "<p>é🙂</p>", 4: "", 6: "long " * 60_000, 7: "A"}
    big = z.archive_pages(df, least_bytes=5).collect()
    assert sum(r.record_type == "response" for r in big) == len(rows)
