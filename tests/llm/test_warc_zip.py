"""WARC records in ZIP packages: round trips, directories with and without ZIP64, and ranges instead of whole files."""

from __future__ import annotations

import base64
import hashlib
import io
import struct
import zipfile
import zlib

import pytest

from factloom.llm import warc_zip

SF = "/root/testdata/sf0.001"
SCHEMA = "page_id long, url string, html string, refers_to string, payload_key string, kept_id string, path string"


class Held(warc_zip.Ranges):
    """Bytes in memory that note which ranges were read."""

    def __init__(self, data: bytes) -> None:
        self.uri, self.data, self.size, self.asked = "held", data, len(data), []

    def read(self, start: int, length: int) -> bytes:
        self.asked.append((start, length))
        assert 0 <= start and start + length <= self.size
        return self.data[start : start + length]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "clash", "clash", "clash", "clash") for r in rows], SCHEMA).repartition(3)


def plain(rows, least=0):
    out = []
    for i, _, html in rows:
        data = (html or "").encode()
        same = [j for j, _, h in rows if j is not None and (h or "") == (html or "")]
        revisit = i is not None and len(data) >= least and i != max(same)
        out.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if revisit else "response", max(same) if revisit else None))
    return sorted(out, key=repr)


def got(df, **options):
    return sorted((tuple(r[c] for c in ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")) for r in warc_zip.archive_roundtrip(df, **options).collect()), key=repr)


AWKWARD = [(i, f"http://h/{i}", h) for i, h in enumerate([None, "", "a", "a", "é\r\n\r\nWARC/1.1\r\n", "é\r\n\r\nWARC/1.1\r\n", "x" * 3_000_000, "\x00\x1f\x8b", "tail\r\n\r\n"])]
AWKWARD += [(100 + i, "http://hot/", "<p>the same page</p>") for i in range(400)] + [(7, "again", "a"), (3, "again", "a"), (None, "no id", "a"), (None, None, "only without id"), (900, "bad\r\nurl: x\ty", "q"), (901, None, "r")]


def test_round_trip(spark):
    assert got(frame(spark, AWKWARD)) == plain(AWKWARD)
    assert got(frame(spark, AWKWARD), least_bytes=5) == plain(AWKWARD, 5)
    assert got(frame(spark, [])) == []


def test_round_trip_of_real_pages_in_small_packages(spark):
    real = spark.read.parquet(f"{SF}/pages.parquet")
    packages = warc_zip.write_packages(real, package_limit=20_000)
    assert packages.count() > 3
    back = {int(r["page_id"]): r for r in warc_zip.read_packages(packages, payloads=True, stretch=9_000).collect()}
    rows = real.collect()
    assert len(back) == len(rows)
    for r in rows:
        assert bytes(back[r["page_id"]]["payload"]).decode() == r["html"] and back[r["page_id"]]["url"] == r["url"]
    folder = packages.first()["path"].rpartition("/")[0]
    bare = lambda rows: sorted("/" + r["path"].removeprefix("file:").lstrip("/") for r in rows)
    assert bare(packages.collect()) == bare(warc_zip.package_list(spark, folder).collect())


def test_round_trip_in_folders_without_a_scheme(spark, tmp_path):
    for folder in (f"{tmp_path}/not/yet/there", f"file:{tmp_path}/one_slash", f"file://{tmp_path}/two"):
        packages = warc_zip.write_packages(frame(spark, AWKWARD[:4]), folder)
        assert sorted(r["payload_bytes"] for r in warc_zip.read_packages(packages).collect()) == [0, 0, 1, 1]


def test_only_ranges_are_read(monkeypatch, tmp_path):
    data = warc_zip.package_bytes([(str(k), "response", warc_zip.record_bytes(str(k), "u", bytes(str(k) * 50_000, "ascii"), None)) for k in range(400)])
    held = Held(data)
    members = {m[0]: m for m in warc_zip.directory(held)}
    begin = warc_zip.member_start(held, members[warc_zip.ARCHIVE])
    assert data[begin : begin + 2] == b"\x1f\x8b" and members[warc_zip.ARCHIVE][1] == zipfile.ZIP_STORED
    assert sum(n for _, n in held.asked) < 70_000 < len(data) / 2
    path = tmp_path / "p.wacz"
    path.write_bytes(data)
    found = list(warc_zip.stretches(str(path), 4_000))
    assert len(found) > 10 and sum(len(n) for _, n in found) == 400 and all(sum(n) <= 4_000 or len(n) == 1 for _, n in found)
    start, lengths = found[3]
    assert warc_zip.parse_record(zlib.decompress(data[start : start + lengths[0]], 31))["record_type"] == "response"


def with_zip64(data: bytes) -> bytes:
    """The same package with every field of its directory full and the values in ZIP64 records."""
    members = warc_zip.directory(Held(data))
    end = data.rfind(warc_zip.END)
    size, offset = struct.unpack_from("<II", data, end + 12)
    out, pos, entries = data[:offset], offset, b""
    for name, _, stored, plain_, local in members:
        n_name, n_extra, n_comment = struct.unpack_from("<HHH", data, pos + 28)
        head = bytearray(data[pos : pos + 46])
        struct.pack_into("<II", head, 20, 0xFFFFFFFF, 0xFFFFFFFF)
        struct.pack_into("<I", head, 42, 0xFFFFFFFF)
        extra = struct.pack("<HHI", 0x9999, 4, 7) + struct.pack("<HHQQQ", 1, 24, plain_, stored, local)
        struct.pack_into("<H", head, 30, len(extra))
        entries += bytes(head) + name.encode() + extra
        pos += 46 + n_name + n_extra + n_comment
    end64 = warc_zip.END64 + struct.pack("<QHHIIQQQQ", 44, 45, 45, 0, 0, len(members), len(members), len(entries), offset)
    locator = warc_zip.LOCATOR64 + struct.pack("<IQI", 0, offset + len(entries), 1)
    return out + entries + end64 + locator + warc_zip.END + struct.pack("<HHHHIIH", 0, 0, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, 9) + b"a comment"


def test_zip64_directories():
    data = warc_zip.package_bytes([("1", "response", warc_zip.record_bytes("1", "u", b"p", None))])
    wide = with_zip64(data)
    assert warc_zip.directory(Held(wide)) == warc_zip.directory(Held(data))
    many = io.BytesIO()
    with zipfile.ZipFile(many, "w") as z:
        for k in range(66_000):  # more than a plain directory can count
            z.writestr(f"m{k}", "")
    assert len(warc_zip.directory(Held(many.getvalue()))) == 66_000


def test_damage_is_an_error():
    data = warc_zip.package_bytes([("1", "response", warc_zip.record_bytes("1", "u", b"p" * 900, None))])
    deflated = io.BytesIO()
    with zipfile.ZipFile(deflated, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr(warc_zip.ARCHIVE, "a" * 999)
    held = Held(deflated.getvalue())
    with pytest.raises(ValueError, match="deflated"):
        warc_zip.member_start(held, warc_zip.directory(held)[0])
    with pytest.raises(ValueError, match="no ZIP directory"):
        warc_zip.directory(Held(data[:-5]))
    with pytest.raises(ValueError, match="not a WARC record"):
        warc_zip.parse_record(b"HTTP/1.1 200 OK\r\n\r\n")
    inflated = zlib.decompress(warc_zip.record_bytes("1", "u", b"payload", None), 31)
    with pytest.raises(ValueError, match="not the one"):
        warc_zip.parse_record(inflated.replace(b"payload", b"paYload"))
