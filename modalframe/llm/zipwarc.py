"""WARC records in ZIP packages: written as stored members with an index, read back by byte ranges without extraction.

Each write task makes one package: archive members ``archive/data-N.warc.gz`` (one gzip member per record) and an index
``indexes/index.jsonl``, all stored without further compression, then the central directory. The reader parses the end
records, ZIP64 ones included, and the central directory, finds members and index, and reads single records by range.
"""
from __future__ import annotations

import base64
import hashlib
import json
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from modalframe.operators.graph import exchanged
from modalframe.session import scratch_path

# Signatures and field limits of the ZIP format.
LOCAL, CENTRAL, END, END64, LOCATOR64 = 0x04034B50, 0x02014B50, 0x06054B50, 0x06064B50, 0x07064B50
MAX16, MAX32 = 0xFFFF, 0xFFFFFFFF
#: Bytes after which a writer starts the next archive member.
MEMBER_BYTES = 64 << 20
#: Bytes of packages that one reading task covers.
READ_BYTES = 16 << 20


class Member(NamedTuple):
    name: str
    header: int  # offset of the local header
    size: int


def open_store(uri: str):
    """A file system that executors can reach, and the path in it."""
    from pyarrow.fs import FileSystem

    return FileSystem.from_uri("file://" + uri[5:] if re.match("file:/(?!/)", uri) else uri)


# ------------------------------------------------------------------------------------------------ writing
class PackageWriter:
    """Writes stored members one after the other. Sizes are known only at a member's end, so they follow its data and the
    directory has them; sizes and offsets of 4 GB and more, and more than 65 535 members, use the ZIP64 fields."""

    def __init__(self, out, limit32: int = MAX32, limit16: int = MAX16):
        self.out, self.at, self.members = out, 0, []
        self.limit32, self.limit16 = limit32, limit16
        self.name: bytes | None = None

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def start(self, name: str) -> None:
        self.finish()
        self.name, self.header, self.crc, self.size = name.encode(), self.at, 0, 0
        self._put(struct.pack("<IHHHHHIIIHH", LOCAL, 45, 0x0808, 0, 0, 0x21, 0, 0, 0, len(self.name), 0) + self.name)

    def write(self, data: bytes) -> int:
        """Append to the open member; returns where in the member the data begins."""
        at, self.crc = self.size, zlib.crc32(data, self.crc)
        self.size += len(data)
        self._put(data)
        return at

    def finish(self) -> None:
        if self.name is None:
            return
        wide = "<IIQQ" if self.size >= self.limit32 else "<IIII"
        self._put(struct.pack(wide, 0x08074B50, self.crc, self.size, self.size))
        self.members.append((self.name, self.header, self.crc, self.size))
        self.name = None

    def close(self) -> None:
        self.finish()
        start = self.at
        for name, header, crc, size in self.members:
            big_size, big_at = size >= self.limit32, header >= self.limit32
            extra = (struct.pack("<QQ", size, size) if big_size else b"") + (struct.pack("<Q", header) if big_at else b"")
            extra = struct.pack("<HH", 1, len(extra)) + extra if extra else b""
            s, h = MAX32 if big_size else size, MAX32 if big_at else header
            self._put(struct.pack("<IHHHHHHIIIHHHHHII", CENTRAL, 45, 45, 0x0808, 0, 0, 0x21, crc, s, s, len(name), len(extra), 0, 0, 0, 0, h) + name + extra)
        length, n = self.at - start, len(self.members)
        if n >= self.limit16 or start >= self.limit32 or length >= self.limit32:
            end64 = self.at
            self._put(struct.pack("<IQHHIIQQQQ", END64, 44, 45, 45, 0, 0, n, n, length, start) + struct.pack("<IIQI", LOCATOR64, 0, end64, 1))
            self._put(struct.pack("<IHHHHIIH", END, 0, 0, MAX16, MAX16, MAX32, MAX32, 0))
        else:
            self._put(struct.pack("<IHHHHIIH", END, 0, 0, n, n, length, start, 0))


def warc_record(kind: str, url: str, record_id: str, digest: str, payload: bytes, size: int, refers_to: int | None) -> bytes:
    """One record as a gzip member of its own. A revisit has no block; its headers tell digest and length of the payload."""
    headers = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id}", "WARC-Date: 2024-01-01T00:00:00Z", f"WARC-Target-URI: {url}",
               "Content-Type: text/html; charset=utf-8", f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {size}", f"Content-Length: {len(payload)}"]
    if refers_to is not None:
        headers += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    data = ("\r\n".join(headers) + "\r\n\r\n").encode() + payload + b"\r\n\r\n"
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (names in lower case) and block of one gzip member."""
    raw = zlib.decompressobj(31).decompress(data)
    head, _, rest = raw.partition(b"\r\n\r\n")
    headers = {k.strip().lower(): v.strip() for k, v in (x.split(":", 1) for x in head.decode().split("\r\n")[1:])}
    return headers, rest[: int(headers["content-length"])]


def _one_line(text: str | None) -> str:
    """A header value: no line breaks."""
    return (text or "").replace("\r", "%0D").replace("\n", "%0A")


# ------------------------------------------------------------------------------------------------ reading
def directory(f, size: int, step: int = 1 << 16) -> list[Member]:
    """Members of a package from its end records and central directory; ``f.read_at(nbytes, offset)``. Raises if a member is
    not stored."""
    tail_at = max(0, size - step - 22)
    tail = f.read_at(size - tail_at, tail_at)
    end = tail.rfind(struct.pack("<I", END))
    if end < 0:
        raise ValueError("no end record")
    n, length, start = struct.unpack_from("<HII", tail, end + 10)
    if (n == MAX16 or length == MAX32 or start == MAX32) and end >= 20 and struct.unpack_from("<I", tail, end - 20)[0] == LOCATOR64:
        at = struct.unpack_from("<Q", tail, end - 20 + 8)[0]
        record = f.read_at(56, at)
        if struct.unpack_from("<I", record)[0] != END64:
            raise ValueError("no ZIP64 end record")
        n, length, start = struct.unpack_from("<QQQ", record, 32)
    data, at, out = f.read_at(length, start), 0, []
    for _ in range(n):
        sig, method = struct.unpack_from("<I6xH", data, at)
        if sig != CENTRAL:
            raise ValueError("broken central directory")
        packed, whole, n_name, n_extra, n_note = struct.unpack_from("<IIHHH", data, at + 20)
        header = struct.unpack_from("<I", data, at + 42)[0]
        name = data[at + 46 : at + 46 + n_name].decode()
        x, stop = at + 46 + n_name, at + 46 + n_name + n_extra
        while x + 4 <= stop:
            tag, n_field = struct.unpack_from("<HH", data, x)
            if tag == 1:
                wide = list(struct.unpack_from(f"<{n_field // 8}Q", data, x + 4))
                if whole == MAX32:
                    whole = wide.pop(0)
                if packed == MAX32:
                    packed = wide.pop(0)
                if header == MAX32:
                    header = wide.pop(0)
            x += 4 + n_field
        if method != 0 or packed != whole:
            raise ValueError(f"{name} is not stored")
        out.append(Member(name, header, whole))
        at = stop + n_note
    return out


def data_start(f, m: Member) -> int:
    """Where the bytes of a stored member begin."""
    sig, n_name, n_extra = struct.unpack("<I22xHH", f.read_at(30, m.header))
    if sig != LOCAL:
        raise ValueError(f"no local header of {m.name}")
    return m.header + 30 + n_name + n_extra


def read_index(f, size: int) -> Iterator[dict]:
    """Lines of the package's index, with absolute offsets of the records. Read line by line, in bounded blocks."""
    members = {m.name: m for m in directory(f, size)}
    starts = {name: data_start(f, m) for name, m in members.items()}
    index, rest = members["indexes/index.jsonl"], b""
    for at in range(0, index.size, 1 << 20):
        block = rest + f.read_at(min(1 << 20, index.size - at), starts[index.name] + at)
        *lines, rest = block.split(b"\n")
        for line in filter(None, lines):
            entry = json.loads(line)
            yield entry | {"at": starts[entry["member"]] + entry["offset"]}


# ------------------------------------------------------------------------------------------------ on Spark
def write_packages(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least_bytes: int = 0) -> DataFrame:
    """Write every row of ``pages`` as a WARC record; returns the packages as ``path, records, bytes`` (a stored table).

    Of rows with equal payloads (by SHA-1 and length) of at least ``least_bytes``, the one with the least id is a response
    and the others revisit it. Only digests are compared across rows; payloads move once, to meet their verdict. A package
    gets a new name in every attempt of its task, and only those that Spark committed to the returned table count.
    """
    spark = pages.sparkSession
    rows = pages.select(F.col(id_col).cast("bigint").alias("page"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(payload_col).cast("string"), F.lit("")).cast("binary").alias("raw"))
    keyed = rows.select("page", F.sha1("raw").alias("sha"), F.length("raw").cast("bigint").alias("size")).filter(F.col("size") >= least_bytes)
    first = keyed.groupBy("sha", "size").agg(F.min("page").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    typed = rows.withColumn("sha", F.sha1("raw")).withColumn("size", F.length("raw").cast("bigint")).join(exchanged(first, "sha", "size"), ["sha", "size"], "left")
    typed = typed.select("page", "url", "raw", "sha", "size", F.when(~F.col("first").eqNullSafe(F.col("page")), F.col("first")).alias("refers_to"))

    def run(batches):
        store, root = open_store(folder)
        store.create_dir(root, recursive=True)
        path, out, pack, spill, records, part = None, None, None, [], 0, 0
        for batch in batches:
            for r in batch.to_pylist():
                if pack is None:
                    path = f"{root}/{uuid.uuid4().hex}.wacz"
                    out = store.open_output_stream(path)
                    pack = PackageWriter(out)
                if pack.name is None or pack.size >= MEMBER_BYTES:
                    part += 1
                    member = f"archive/data-{part}.warc.gz"
                    pack.start(member)
                kind = "response" if r["refers_to"] is None else "revisit"
                digest = base64.b32encode(bytes.fromhex(r["sha"])).decode()
                data = warc_record(kind, _one_line(r["url"]), f"<urn:page:{r['page']}>" if r["page"] is not None else f"<urn:uuid:{uuid.uuid4()}>", digest,
                                   r["raw"] if kind == "response" else b"", r["size"], r["refers_to"])
                spill.append({"page": r["page"], "member": member, "offset": pack.write(data), "length": len(data)})
                records += 1
        if pack is None:
            return
        pack.start("indexes/index.jsonl")
        for entry in spill:
            pack.write(json.dumps(entry).encode() + b"\n")
        pack.close()
        out.close()
        yield pa.RecordBatch.from_pylist([{"path": path, "records": records, "bytes": pack.at}], schema=pa.schema([("path", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())]))

    at = scratch_path(spark, "packages")
    typed.mapInArrow(run, "path string, records bigint, bytes bigint").write.parquet(at)
    return spark.read.parquet(at)


def reading_tasks(packages: DataFrame) -> int:
    """How many tasks read the packages: in proportion to their bytes."""
    return max(8, -(-(packages.agg(F.sum("bytes")).first()[0] or 0) // READ_BYTES))


def index_records(packages: DataFrame, folder: str) -> DataFrame:
    """``path, page, at, length`` of every record, from the packages' directories and indexes."""

    def run(batches):
        store, _ = open_store(folder)
        for batch in batches:
            for path, size in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with store.open_input_file(path) as f:
                    rows = []
                    for e in read_index(f, size):
                        rows.append({"path": path, "page": e["page"], "at": e["at"], "length": e["length"]})
                        if len(rows) == 10_000:
                            yield pa.RecordBatch.from_pylist(rows, schema=kind)
                            rows = []
                    if rows:
                        yield pa.RecordBatch.from_pylist(rows, schema=kind)

    kind = pa.schema([("path", pa.string()), ("page", pa.int64()), ("at", pa.int64()), ("length", pa.int64())])
    return packages.select("path", "bytes").repartition(max(1, packages.count()), "path").mapInArrow(run, "path string, page bigint, at bigint, length bigint")


def read_records(index: DataFrame, folder: str, tasks: int) -> DataFrame:
    """Records of an index by range reads, dealt by place in the packages to a number of tasks: ``page, record_type, refers_to, payload_bytes, payload_digest, payload``.

    Digest and length of a response are taken from the bytes read; those of a revisit from its headers."""

    def run(batches):
        store, _ = open_store(folder)
        path, f = None, None
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                if r["path"] != path:
                    if f is not None:
                        f.close()
                    path, f = r["path"], store.open_input_file(r["path"])
                headers, block = parse_record(f.read_at(r["length"], r["at"]))
                known, revisit = headers["warc-payload-digest"].removeprefix("sha1:"), headers["warc-type"] == "revisit"
                digest = known if revisit else base64.b32encode(hashlib.sha1(block).digest()).decode()
                if digest != known:
                    raise ValueError(f"payload of page {r['page']} does not have its digest")
                target = headers.get("warc-refers-to", "<urn:page:>")[10:-1]
                rows.append({"page": r["page"], "record_type": headers["warc-type"], "refers_to": int(target) if target else None, "payload_bytes": int(headers["x-payload-length"]) if revisit else len(block),
                             "payload_digest": digest, "payload": None if revisit else block})
                if len(rows) == 256:
                    yield pa.RecordBatch.from_pylist(rows, schema=kind)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=kind)
        if f is not None:
            f.close()

    kind = pa.schema([("page", pa.int64()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary())])
    spread = index.repartition(tasks, "path", F.floor(F.col("at") / (1 << 20))).sortWithinPartitions("path", "at")
    return spread.mapInArrow(run, "page bigint, record_type string, refers_to bigint, payload_bytes bigint, payload_digest string, payload binary")


def archive_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least_bytes: int = 0) -> DataFrame:
    """Write all rows as packages in the shared scratch folder and read them back:
    ``id_col, payload_bytes, payload_digest, record_type, refers_to``.

    A null payload counts as empty, a null url as an empty one. Rows repeated under one id are written once each; those
    that have the least id of their payload are all responses. A row with a null id revisits the least id of its payload,
    or is a response if it has none. An empty table writes nothing and gives an empty one; other columns are not read.
    """
    folder = scratch_path(pages.sparkSession, "archives")
    packages = write_packages(pages, folder, id_col, url_col, payload_col, least_bytes)
    got = read_records(index_records(packages, folder), folder, reading_tasks(packages))
    return got.select(F.col("page").alias(id_col), "payload_bytes", "payload_digest", "record_type", "refers_to")
