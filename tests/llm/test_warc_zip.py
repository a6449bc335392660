import base64
import gzip
import hashlib
import struct
import zipfile

import pytest

from quillgrid.llm import warc_zip
from quillgrid.llm.warc_zip import Member, data_start, members, read_packages, record_places, write_packages
from quillgrid.sources.ranges import RangedFile


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def brute(rows):
    """Type and referred id by a loop over all rows."""
    out = []
    for i, (page, url, html) in enumerate(rows):
        body = (html or "").encode()
        same = [
            (p is None, p, u is not None, u or "", k)
            for k, (p, u, h) in enumerate(rows)
            if (h or "").encode() == body
        ]
        least = min(same, key=lambda s: (s[0], s[1] or 0, *s[2:]))
        again = least[4] != i
        out.append((page, url, len(body), digest(body), "revisit" if again else "response", least[1] if again else None))
    return sorted(out, key=repr)


def through(spark, rows, folder, **options):
    frame = spark.createDataFrame(rows, "page_id long, url string, html string")
    packages = write_packages(frame.repartition(3), "page_id", "url", "html", str(folder), **options)
    found = read_packages(packages).collect()
    number = lambda text: None if text is None else int(text)
    got = [
        (number(r["id"]), r["url"], r["payload_bytes"], r["payload_digest"], r["record_type"], number(r["refers_to"]))
        for r in found
    ]
    return sorted(got, key=repr), found, packages


def test_awkward_rows_against_a_loop(spark, tmp_path):
    long = "wörd " * 200_000
    rows = [
        (5, "http://a/ b\r\nX: 1", "same"), (3, None, "same"), (3, "u", "same"), (None, "u", "same"), (None, None, "lone"),
        (7, "%41?x=1&y#z", None), (8, "é", ""), (9, "u", long), (2, "u", long), (4, "u", "HTTP/1.1\r\n\r\nWARC/1.1\r\n\r\n"),
        (6, "u", "tied"), (6, "u", "tied"), (6, "u", "tied"), (6, "v", "tied"), (11, "u", "tied"), (-1, "u", "\x00\x01"),
        *[(100 + i, "u", "crowd") for i in range(300)],
    ]
    got, found, packages = through(spark, rows, tmp_path / "a", package_bytes=2_000)
    assert got == brute(rows)
    assert packages.count() > 3
    bodies = {r["id"]: r["payload"] for r in found if r["record_type"] == "response"}
    assert bytes(bodies["2"]).decode() == long
    assert all(r["payload"] is None for r in found if r["record_type"] == "revisit")
    assert len({r["record_id"] for r in found}) == len(rows)


def test_short_payloads_are_never_revisits(spark, tmp_path):
    rows = [(1, "u", "abc"), (2, "u", "abc"), (3, "u", "abcd"), (4, "u", "abcd")]
    got, _, _ = through(spark, rows, tmp_path / "a", least_bytes=4)
    assert [(r[0], r[4], r[5]) for r in got] == [
        (1, "response", None), (2, "response", None), (3, "response", None), (4, "revisit", 3),
    ]


def test_an_empty_table_and_clashing_columns(spark, tmp_path):
    frame = spark.createDataFrame([], "page_id long, url string, html string, id int, payload date, digest int")
    assert read_packages(write_packages(frame, "page_id", "url", "html", str(tmp_path / "a"))).count() == 0
    frame = spark.createDataFrame([("k:%/é", "u", "x", 1, None, 2)], "page string, url string, html string, id int, first int, n int")
    row = read_packages(write_packages(frame, "page", "url", "html", str(tmp_path / "b"))).first()
    assert (row["id"], row["payload"]) == ("k:%/é", b"x")


def package(path, records, zip64=False, before=b"", comment=b"", method=zipfile.ZIP_STORED, index_gz=False):
    """A package as the standard library writes it."""
    with open(path, "wb") as out:
        out.write(before)
        with zipfile.ZipFile(out, "w", method) as z:
            z.writestr("datapackage.json", "{}", zipfile.ZIP_DEFLATED)
            lines, data = [], b""
            for record in records:
                lines.append(b'k 0 {"offset": "%d", "length": "%d", "filename": "data.warc.gz"}' % (len(data), len(record)))
                data += record
            z.writestr("archive/data.warc.gz", data)
            text = b"\n".join(lines)
            z.writestr("indexes/index.cdxj" + ".gz" * index_gz, gzip.compress(text) if index_gz else text)
            z.comment = comment
    return str(path)


def some_records(n):
    row = {"id": "1", "url": "u", "digest": hashlib.sha1(b"body").digest(), "first": None, "again": False, "size": 4, "payload": b"body"}
    return [gzip.compress(warc_zip.record_bytes(row, str(i), "2020-01-01T00:00:00Z")) for i in range(n)]


@pytest.mark.parametrize("zip64", [False, True])
@pytest.mark.parametrize("before", [b"", b"#!stub\n" * 9])
@pytest.mark.parametrize("comment", [b"", b"PK\x05\x06" + b"x" * 300])
@pytest.mark.parametrize("index_gz", [False, True])
def test_directories_of_all_kinds(spark, tmp_path, monkeypatch, zip64, before, comment, index_gz):
    if zip64:
        monkeypatch.setattr(zipfile, "ZIP64_LIMIT", 20)
        monkeypatch.setattr(zipfile, "ZIP_FILECOUNT_LIMIT", 1)
    records = some_records(5)
    path = package(tmp_path / "p.zip", records, before=before, comment=comment, index_gz=index_gz)
    raw = open(path, "rb").read()
    assert (b"PK\x06\x06" in raw) == zip64
    with RangedFile(path) as file:
        assert [m.name for m in members(file)][:2] == ["datapackage.json", "archive/data.warc.gz"]
        assert [raw[o : o + n] for o, n in record_places(file)] == records
    frame = spark.createDataFrame([(path,)], "path string")
    assert [bytes(r["payload"]) for r in read_packages(frame).collect()] == [b"body"] * 5


def test_sizes_beyond_four_gigabytes():
    extra = struct.pack("<HHQQQ", 1, 24, 5 << 32, 6 << 32, 7 << 32)
    mark = 0xFFFFFFFF
    assert warc_zip.wide_fields(extra, [mark, mark, mark]) == [5 << 32, 6 << 32, 7 << 32]
    assert warc_zip.wide_fields(struct.pack("<HHH", 9, 2, 0) + struct.pack("<HHQ", 1, 8, 1 << 40), [3, 4, mark]) == [3, 4, 1 << 40]


def test_broken_packages_are_refused(tmp_path):
    def places(path):
        with RangedFile(str(path)) as file:
            return list(record_places(file))

    whole = open(package(tmp_path / "a.zip", some_records(2)), "rb").read()
    (tmp_path / "cut.zip").write_bytes(whole[:-30])
    with pytest.raises(ValueError, match="end record"):
        places(tmp_path / "cut.zip")
    (tmp_path / "empty").write_bytes(b"")
    with pytest.raises(ValueError, match="Not a ZIP"):
        places(tmp_path / "empty")
    with pytest.raises(ValueError, match="not stored"):
        places(package(tmp_path / "d.zip", some_records(2), method=zipfile.ZIP_DEFLATED))
    (tmp_path / "range.zip").write_bytes(whole.replace(b'"offset": "0"', b'"offset": "9"', 1).replace(b'"length": "', b'"length": "9', 1)[: len(whole) + 1])
    with pytest.raises(ValueError):
        places(tmp_path / "range.zip")
    with RangedFile(str(tmp_path / "a.zip")) as file, pytest.raises(ValueError, match="local header"):
        data_start(file, Member("archive/x", 0, False, 3, 5))


def test_a_payload_that_changed_is_found():
    record = gzip.decompress(some_records(1)[0]).replace(b"body", b"bodi")
    with pytest.raises(ValueError, match="digest"):
        warc_zip.parsed_record(record)
