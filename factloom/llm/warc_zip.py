"""Web archives in ZIP packages: written by tasks, and read back by byte ranges without extraction.

A package is a ZIP file whose members are stored, not deflated: `archive/data.warc.gz`, one gzip member a
record, and `indexes/index.cdxj`, one line a record with its offset and length. Reading parses the end of the
package, its ZIP64 records if it has them, and the central directory; finds where the members' bytes lie;
range-reads the index; and deals stretches of records to tasks, each of which range-reads its stretch and
inflates its records one by one. Nothing is unpacked to disk and no package is read whole.

Equal payloads are written once: the record with the largest page_id of those with equal payloads (told by SHA-256) is the
response, others are revisits that refer to it and hold only HTTP headers, which state the payload's length.
Only digests and ids are grouped, with partial sums in the tasks; pages learn of their group by a
broadcast if the groups with copies are counted to be few, else by a join on the digest.

Packages are written with a name of the attempt's own. The list of packages is a stored table, which holds
those of attempts that succeeded only, so a lost executor leaves at most a file that nobody reads.

Results in special cases: a null html is an empty payload, and equal empty payloads are revisits like others unless
`least_bytes` says otherwise. A row without page_id is a response of its own and is never referred to; rows that repeat the largest page_id
of their payload are all responses. Line ends and other control characters in urls become `%XX`; a null url is `urn:none`. A
record larger than a package's limit is a package of its own. A deflated member or a damaged directory is an error that names the package.
An empty table writes no package and gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import io
import json
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm.common import partitions, shared_dir, sized, store

#: A package is closed when its records reach this size; a stretch is what one range-read takes.
PACKAGE_BYTES, STRETCH_BYTES = 16 << 20, 4 << 20
ARCHIVE, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
DATE = "2024-01-01T00:00:00Z"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_ID = "urn:page:"


# --- records ------------------------------------------------------------------------------------

def digest(payload: bytes) -> str:
    """Base32 SHA-1 of a payload."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_bytes(page_id: str | None, url: str | None, payload: bytes, refers_to: str | None) -> bytes:
    """One WARC record as a gzip member; with `refers_to` a revisit, whose block ends after the HTTP headers."""
    at = "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in url) if url else "urn:none"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if refers_to is None else b"")
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <{f'{_ID}{page_id}' if page_id is not None else uuid.uuid5(uuid.NAMESPACE_URL, at + digest(payload)).urn}>"]
    head += [f"WARC-Date: {DATE}", f"WARC-Target-URI: {at}", f"WARC-Payload-Digest: sha1:{digest(payload)}"]
    if refers_to is not None:
        head += [f"WARC-Profile: {REVISIT}", f"WARC-Refers-To: <{_ID}{refers_to}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    squeeze = zlib.compressobj(6, zlib.DEFLATED, 31)
    return squeeze.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + squeeze.flush()


def _headers(lines: bytes) -> dict[str, str]:
    out = {}
    for line in lines.decode("utf-8", "replace").split("\r\n")[1:]:
        name, _, value = line.partition(":")
        out[name.strip().lower()] = value.strip()
    return out


def parse_record(data: bytes) -> dict:
    """Fields of an inflated record: page_id, url, record_type, payload (None in revisits), length, digest, refers_to."""
    head, found, rest = data.partition(b"\r\n\r\n")
    if not found or not head.startswith(b"WARC/1."):
        raise ValueError("not a WARC record")
    h = _headers(head)
    block = rest[: int(h["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    page = lambda v: v.strip("<>").removeprefix(_ID) if v and v.strip("<>").startswith(_ID) else None
    out = {"page_id": page(h["warc-record-id"]), "url": h.get("warc-target-uri"), "record_type": h["warc-type"], "refers_to": page(h.get("warc-refers-to"))}
    stated = h.get("warc-payload-digest", "").removeprefix("sha1:")
    if out["record_type"] == "revisit":
        return out | {"payload": None, "length": int(_headers(http)["content-length"]), "digest": stated}
    if digest(payload) != stated:
        raise ValueError(f"the payload of {h['warc-record-id']} is not the one that was written")
    return out | {"payload": payload, "length": len(payload), "digest": stated}


# --- packages -----------------------------------------------------------------------------------

class Ranges:
    """Byte ranges of a file in any store that Arrow reaches."""

    def __init__(self, uri: str) -> None:
        from pyarrow import fs

        store_, path = fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri.removeprefix("file:"))
        self.uri, self._file = uri, store_.open_input_file(path)
        self.size = self._file.size()

    def read(self, start: int, length: int) -> bytes:
        got = self._file.read_at(length, start)
        if len(got) != length:
            raise ValueError(f"{self.uri} ends before byte {start + length}")
        return got

    def close(self) -> None:
        self._file.close()


def _write(uri: str, data: bytes) -> None:
    from pyarrow import fs

    store_, path = fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri.removeprefix("file:"))
    store_.create_dir(path.rpartition("/")[0], recursive=True)
    with store_.open_output_stream(path) as out:
        out.write(data)


# Signatures and sizes of the ZIP format's records.
END, END64, LOCATOR64, ENTRY, LOCAL = b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07", b"PK\x01\x02", b"PK\x03\x04"
END_BYTES, LOCATOR_BYTES, ENTRY_BYTES, LOCAL_BYTES, COMMENT_BYTES = 22, 20, 46, 30, 65535
FULL16, FULL32 = 0xFFFF, 0xFFFFFFFF


def directory(ranges) -> list[tuple[str, int, int, int, int]]:
    """Members of a package (name, method, bytes stored, bytes, offset of the local header) from its central directory.

    The end record is searched from the back; where one of its fields is full, the ZIP64 end record has the
    value, and where a member's field is full, its ZIP64 extra field.
    """
    tail_bytes = min(ranges.size, END_BYTES + COMMENT_BYTES)
    tail_at = ranges.size - tail_bytes
    tail = ranges.read(tail_at, tail_bytes)
    at = tail.rfind(END)
    while at >= 0 and not (at + END_BYTES <= len(tail) and at + END_BYTES + struct.unpack_from("<H", tail, at + 20)[0] == len(tail)):
        at = tail.rfind(END, 0, at)
    if at < 0:
        raise ValueError(f"{ranges.uri} has no ZIP directory")
    count, size, offset = struct.unpack_from("<HII", tail, at + 10)
    locator_at = tail_at + at - LOCATOR_BYTES
    if locator_at >= 0 and (locator := ranges.read(locator_at, LOCATOR_BYTES))[:4] == LOCATOR64:
        end64_at = struct.unpack_from("<Q", locator, 8)[0]
        end64 = ranges.read(end64_at, 56)
        if end64[:4] != END64:
            raise ValueError(f"{ranges.uri} has a damaged ZIP64 directory")
        count, size, offset = struct.unpack_from("<QQQ", end64, 32)
    elif count == FULL16 and offset == FULL32:
        raise ValueError(f"{ranges.uri} has no ZIP64 directory although its fields call for one")
    entries, out, pos = ranges.read(offset, size), [], 0
    for _ in range(count):
        if entries[pos : pos + 4] != ENTRY:
            raise ValueError(f"{ranges.uri} has a damaged ZIP directory")
        flags, method, stored, plain, n_name, n_extra, n_comment = struct.unpack_from("<HH8xIIHHH", entries, pos + 8)
        local = struct.unpack_from("<I", entries, pos + 42)[0]
        name = entries[pos + ENTRY_BYTES : pos + ENTRY_BYTES + n_name].decode("utf-8" if flags & 0x800 else "cp437")
        extra = entries[pos + ENTRY_BYTES + n_name : pos + ENTRY_BYTES + n_name + n_extra]
        e = 0
        while e + 4 <= len(extra):
            kind, n = struct.unpack_from("<HH", extra, e)
            if kind == 1:  # ZIP64: the full fields only, in this order
                wide = iter(struct.unpack_from(f"<{n // 8}Q", extra, e + 4))
                plain = next(wide) if plain == FULL32 else plain
                stored = next(wide) if stored == FULL32 else stored
                local = next(wide) if local == FULL32 else local
            e += 4 + n
        out.append((name, method, stored, plain, local))
        pos += ENTRY_BYTES + n_name + n_extra + n_comment
    return out


def member_start(ranges, member: tuple[str, int, int, int, int]) -> int:
    """Where the bytes of a stored member begin."""
    name, method, _, _, local = member
    if method != zipfile.ZIP_STORED:
        raise ValueError(f"{name} of {ranges.uri} is deflated and cannot be read by range")
    head = ranges.read(local, LOCAL_BYTES)
    if head[:4] != LOCAL:
        raise ValueError(f"{name} of {ranges.uri} has no local header")
    n_name, n_extra = struct.unpack_from("<HH", head, 26)
    return local + LOCAL_BYTES + n_name + n_extra


def package_bytes(records: list[tuple[str | None, str, bytes]]) -> bytes:
    """A package of (page_id, record_type, gzip member)."""
    lines, at = [], 0
    for page_id, kind, data in records:
        lines.append(json.dumps({"id": page_id, "type": kind, "offset": at, "length": len(data)}))
        at += len(data)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
        z.writestr(zipfile.ZipInfo(ARCHIVE), b"".join(data for *_, data in records))
        z.writestr(zipfile.ZipInfo(INDEX), "".join(x + "\n" for x in lines))
    return out.getvalue()


def stretches(uri: str, most: int = STRETCH_BYTES) -> Iterator[tuple[int, list[int]]]:
    """Start and record lengths of the stretches of a package's archives, from their indexes."""
    ranges = Ranges(uri)
    try:
        members = {m[0]: m for m in directory(ranges)}
        if ARCHIVE not in members or INDEX not in members:
            raise ValueError(f"{uri} has no {ARCHIVE} with an {INDEX}")
        begin = member_start(ranges, members[ARCHIVE])
        index = ranges.read(member_start(ranges, members[INDEX]), members[INDEX][2])
    finally:
        ranges.close()
    start, lengths, size = begin, [], 0
    for line in index.splitlines():
        entry = json.loads(line)
        offset, length = entry["offset"], entry["length"]
        if lengths and (size + length > most or begin + offset != start + size):
            yield start, lengths
            start, lengths, size = begin + offset, [], 0
        if not lengths:
            start = begin + offset
        lengths.append(length)
        size += length
    if lengths:
        yield start, lengths


# --- tables -------------------------------------------------------------------------------------

def with_copies(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """pages (page_id, url, html) with `refers_to`: the largest page_id of an equal payload of at least so many bytes, null for that page itself."""
    html = F.coalesce("html", F.lit(""))
    keyed = pages.select("page_id", "url", html.alias("html"), F.when(F.col("page_id").isNotNull() & (F.octet_length(html) >= least_bytes), F.sha2(html, 256)).alias("payload_key"))
    groups = keyed.where("payload_key is not null").groupBy(F.col("payload_key").alias("group_key")).agg(F.max("page_id").alias("kept_id"), F.count("*").alias("n")).where("n > 1").drop("n")
    groups = store(groups, "warc-copies")
    j = keyed.join(sized(groups), F.col("payload_key") == F.col("group_key"), "left")
    return j.select("page_id", "url", "html", F.when(F.col("kept_id") != F.col("page_id"), F.col("kept_id")).alias("refers_to"))


def write_packages(pages: DataFrame, folder: str | None = None, least_bytes: int = 0, package_limit: int = PACKAGE_BYTES) -> DataFrame:
    """Writes a record for each page and gives the packages (path, records, bytes) as a stored table."""
    folder = folder or f"{shared_dir(pages.sparkSession)}/warc-{uuid.uuid4().hex}"

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        def close() -> object:
            path = f"{folder}/{uuid.uuid4().hex}.wacz"
            data = package_bytes(held)
            _write(path, data)
            return pa.RecordBatch.from_pydict({"path": [path], "records": [len(held)], "bytes": [len(data)]})

        held: list[tuple] = []
        size = 0
        for b in batches:
            for page_id, url, html, refers_to in zip(*(b.column(c) for c in ("page_id", "url", "html", "refers_to")), strict=True):
                refers_to = refers_to.as_py()
                data = record_bytes(page_id.as_py(), url.as_py(), html.as_py().encode(), refers_to)
                if held and size + len(data) > package_limit:
                    yield close()
                    held, size = [], 0
                held.append((page_id.as_py(), "response" if refers_to is None else "revisit", data))
                size += len(data)
        if held:
            yield close()

    rows = with_copies(pages, least_bytes).select(F.col("page_id").cast("string"), "url", "html", F.col("refers_to").cast("string"))
    return store(rows.mapInArrow(run, "path string, records bigint, bytes bigint"), "warc-packages")


def read_packages(packages: DataFrame, payloads: bool = False, stretch: int = STRETCH_BYTES) -> DataFrame:
    """packages (path) to their records (page_id string, url, record_type, payload_bytes, payload_digest, refers_to string[, payload])."""
    spark = packages.sparkSession

    def find(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            for path in b.column("path").to_pylist():
                found = list(stretches(path, stretch))
                yield pa.RecordBatch.from_pydict({"path": [path] * len(found), "start": [s for s, _ in found], "lengths": [n for _, n in found]}, schema=pa.schema([("path", pa.string()), ("start", pa.int64()), ("lengths", pa.list_(pa.int64()))]))

    fields = ["page_id", "url", "record_type", "payload_bytes", "payload_digest", "refers_to"] + ["payload"] * payloads

    def read(batches: Iterator) -> Iterator:
        import pyarrow as pa

        kinds = [pa.string()] * 3 + [pa.int64()] + [pa.string()] * 2 + [pa.binary()] * payloads
        for b in batches:
            for path, start, lengths in zip(*(b.column(c).to_pylist() for c in ("path", "start", "lengths")), strict=True):
                ranges = Ranges(path)
                try:
                    data = memoryview(ranges.read(start, sum(lengths)))
                finally:
                    ranges.close()
                rows, at = [], 0
                for n in lengths:
                    r = parse_record(zlib.decompress(data[at : at + n], 31))
                    at += n
                    rows.append((r["page_id"], r["url"], r["record_type"], r["length"], r["digest"], r["refers_to"], *[r["payload"]] * payloads))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], fields)

    found = packages.select("path").mapInArrow(find, "path string, start bigint, lengths array<bigint>")
    dealt = found.repartition(partitions(spark), "path", "start")
    types = ["string"] * 3 + ["bigint"] + ["string"] * 2 + ["binary"] * payloads
    return dealt.mapInArrow(read, ", ".join(f"{f} {t}" for f, t in zip(fields, types, strict=True)))


def archive_roundtrip(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Pages written as packages and read back: (page_id, payload_bytes, payload_digest, record_type, refers_to)."""
    kind: Column | str = pages.schema["page_id"].dataType
    back = read_packages(write_packages(pages, least_bytes=least_bytes))
    return back.select(F.col("page_id").cast(kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to"))


def package_list(spark: SparkSession, folder: str) -> DataFrame:
    """The packages of a folder (path), as Spark lists it; their bytes are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.wacz").load(folder)
    return files.select("path")


_CHAR = "substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((v >> {}) & 31)::BIGINT + 1, 1)"

ORACLE = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
s AS (SELECT *, sha1(html) AS h, max(page_id) OVER (PARTITION BY html) AS kept FROM p)
SELECT page_id, strlen(html)::BIGINT AS payload_bytes,
  array_to_string(list_transform(list_transform(range(0, 8), lambda i: ('0x' || substr(h, 5 * i + 1, 5))::BIGINT), lambda v: {" || ".join(_CHAR.format(b) for b in (15, 10, 5, 0))}), '') AS payload_digest,
  CASE WHEN page_id = kept THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> kept THEN kept END AS refers_to
FROM s
"""
