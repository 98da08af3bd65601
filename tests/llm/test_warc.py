import hashlib
import io
import os
import zipfile
import zlib

import pyarrow as pa
import pytest

from rubric.llm import warc, zipped

PAGE = "<html>" + "word " * 40 + "é \U0001F600</html>"
ROWS = [(5, "http://a.example/x?q=1", PAGE), (3, "http://b.example/ü\r\nX-Evil: 1", PAGE), (9, None, PAGE), (None, "http://c.example/", PAGE),
        (4, "http://d.example/", None), (6, "u", ""), (7, "u", "short"), (8, "u", "short"), (3, "http://again.example/", PAGE),
        (10, "http://long.example/", "<p>" + "long text of a page " * 60_000), (11, "x", "a" * 99), (12, "x", "a" * 99),
        (13, "x", "b" * 100), (14, "x", "b" * 100), (None, "x", "c" * 200), (None, "y", "c" * 200), (-2, "x", "WARC/1.1\r\n\r\n" * 20)]


def pages(spark, rows):
    extra = "digest string, payload string, archive string, first string, n string, offset string"
    return spark.createDataFrame([(*r, *"abcdef") for r in rows], f"page_id long, url string, html string, {extra}")


def brute(rows):
    groups = {}
    for i, _, h in rows:
        if i is not None:
            groups[h or ""] = min(i, groups.get(h or "", i))
    out = []
    for i, _, h in rows:
        data = (h or "").encode()
        first = groups.get(h or "")
        again = len(data) >= 100 and first is not None and first != i
        out.append((i, len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response", first if again else None))
    return sorted(out, key=str)


def test_edge_rows_against_brute_force(spark):
    got = [tuple(r)[:5] for r in warc.round_trip(pages(spark, ROWS).repartition(3)).collect()]
    assert sorted(got, key=str) == brute(ROWS)
    assert warc.round_trip(pages(spark, [])).collect() == []


def test_payloads_are_written_once_and_come_back(spark, tmp_path):
    manifest = warc.write_archives(warc.with_references(pages(spark, ROWS).repartition(2)), str(tmp_path / "packages"))
    entries = warc.index_entries(manifest)
    found = warc.read_records(entries).collect()
    want = {i: (h or "").encode() for i, _, h in ROWS if i is not None}
    for r in found:
        if r.record_type == "response" and r.page_id is not None:
            assert r.payload == want[r.page_id]
        assert (r.payload is None) == (r.record_type == "revisit")
        assert "X-Evil" not in (r.uri or "") or "%0D%0A" in r.uri
    assert sum(r.payload == PAGE.encode() for r in found) == 2  # the two rows with the smallest id
    # Only the records asked for are read.
    some = warc.read_records(entries.where("uri LIKE 'http://a%'")).collect()
    assert sorted(r.page_id for r in some) == [3, 5]
    # Other ZIP readers agree about the members, and the members are WARC files of gzip records.
    for r in manifest.collect():
        assert os.path.getsize(r.archive) == r.n_bytes
        with zipfile.ZipFile(r.archive) as z, open(r.archive, "rb") as f:
            listed = zipped.directory(pa.PythonFile(f))
            assert [(m.name, m.size) for m in listed] == [(i.filename, i.file_size) for i in z.infolist()] and all(m.stored for m in listed)
            assert z.testzip() is None
            data = b"".join(z.read(n) for n in z.namelist() if n.endswith(".warc.gz"))
        n = 0
        while data:
            one = zlib.decompressobj(31)
            assert one.decompress(data).startswith(b"WARC/1.1\r\n")
            data, n = one.unused_data, n + 1
        assert n == r.n_records


def test_members_roll_over_and_a_package_without_index_is_scanned(spark, tmp_path):
    run = warc.packer(str(tmp_path), member=300)
    rows = warc.with_references(pages(spark, ROWS)).coalesce(1)
    manifest = rows.mapInArrow(run, warc.MANIFEST).collect()
    assert len(manifest) == 1
    path = manifest[0].archive
    bare = str(tmp_path / "bare.zip")
    with zipfile.ZipFile(path) as z, zipfile.ZipFile(bare, "w") as out:
        assert sum(n.startswith("archive/") for n in z.namelist()) > 3
        for n in z.namelist():
            if not n.startswith("indexes/"):
                out.writestr(zipfile.ZipInfo(n), z.read(n))
        out.writestr(zipfile.ZipInfo("notes.txt"), b"x" * 500, zipfile.ZIP_DEFLATED)

    def read(name):
        entries = warc.index_entries(spark.createDataFrame([(name,), (None,)], "archive string"))
        return sorted(((r.record_type, r.page_id, r.payload_digest, r.uri) for r in warc.read_records(entries, span=200).collect()), key=str)

    assert read(bare) == read(path) and len(read(path)) == len(ROWS)


def zip_bytes(monkeypatch, wide, names=("archive/a.warc", "b", "c"), comment=b""):
    if wide:
        monkeypatch.setattr(zipfile, "ZIP64_LIMIT", 10)
        monkeypatch.setattr(zipfile, "ZIP_FILECOUNT_LIMIT", 2)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for n in names:
            z.writestr(n, n.encode() * 20)
        z.comment = comment
    return out.getvalue()


@pytest.mark.parametrize("wide", [False, True])
@pytest.mark.parametrize("front", [b"", b"#!/bin/sh\n" * 30])
@pytest.mark.parametrize("comment", [b"", b"PK\5\6 is the signature " + bytes(30)])
def test_directories(monkeypatch, wide, front, comment):
    data = zip_bytes(monkeypatch, wide, comment=comment)
    assert (b"PK\6\6" in data) == wide
    file = pa.BufferReader(front + data)
    found = zipped.directory(file)
    assert [(m.name, m.size, m.stored) for m in found] == [(n, 20 * len(n), True) for n in ("archive/a.warc", "b", "c")]
    for m in found:
        assert zipped.read_at(file, zipped.data_offset(file, m), m.size) == m.name.encode() * 20


def test_damage_is_found(monkeypatch):
    data = zip_bytes(monkeypatch, False)
    for bad in (b"", b"PK", data[:-30], data[:60], b"no archive at all" * 20):
        with pytest.raises(ValueError):
            zipped.directory(pa.BufferReader(bad))
    raw, _ = warc.record(1, "u", b"x" * 200, hashlib.sha256(b"y").hexdigest(), None, "n")
    with pytest.raises(ValueError, match="payload"):
        warc.parsed(raw, True)


def test_neighbours_are_read_together():
    entries = [("a", 0, 5), ("a", 5, 5), ("a", 12, 3), ("b", 15, 1), ("b", 16, 9), ("b", 25, 4)]
    assert list(warc.ranges(iter(entries), 12)) == [
        ("a", 0, 10, [(0, 5), (5, 5)]), ("a", 12, 3, [(12, 3)]), ("b", 15, 10, [(15, 1), (16, 9)]), ("b", 25, 4, [(25, 4)])]
