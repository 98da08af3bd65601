"""WARC records in ZIP-packaged web archives, written and read by ranges.

A package is a ZIP file whose members are stored as they are:
``archive/data-*.warc.gz`` (each record a gzip member of its own) and
``indexes/index.cdxj`` (a line for each record: where it begins and how long
it is).  Reading parses the directories (``zipped``), locates the stored
members, reads the index and then only the byte ranges of the records asked
for; nothing is extracted.  A package without an index is scanned once.

Records with equal payloads are written once: the others are revisit records
that name it.

Each writing task writes a package of its own, with a name that no other
attempt has, and returns a row of the manifest.  The manifest is a table that
Spark commits, so it names one package for each task, whatever was run again;
packages of lost attempts are never read and go with the scratch folder.
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.skew import salted_join
from ..session import scratch_path
from .rows import python_ready, written
from .zipped import data_offset, directory, located, open_file, read_at

#: Payloads of fewer bytes are always written.
LEAST = 100
#: Bytes of a WARC member after which the next one begins.
MEMBER = 1 << 30
#: Bytes read at a time, and of one task's share of a member.
READ = 8 << 20
SPAN = 64 << 20
#: Rows, or bytes of payload, of an Arrow batch that reading yields.
ROWS, BYTES = 2000, 16 << 20
LEVEL = 4
#: Time written into records (a parameter, so that a task that is run again writes the same bytes).
DATE = "2000-01-01T00:00:00Z"

INDEX = "indexes/index.cdxj"
IS_INDEX = re.compile(r"indexes/.*\.cdxj?").fullmatch
IS_DATA = re.compile(r"archive/.*\.warc(\.gz)?").fullmatch
#: Header lines of records, and the profile of revisits.
VERSION, END_OF_LINE = "WARC/1.1", "\r\n"
HTTP = "application/http; msgtype=response"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

MANIFEST = "archive string, n_bytes long, n_records long"
ENTRIES = "archive string, offset long, length long, uri string, digest string"
RECORDS = ("archive string, offset long, record_type string, record_id string, uri string, page_id long, payload_bytes long, "
           "payload_digest string, refers_to string, payload binary")


def urn(page_id: int) -> str:
    return f"<urn:page:{page_id}>"


def lines(*fields: tuple[str, object]) -> str:
    return "".join(f"{name}: {value}{END_OF_LINE}" for name, value in fields if value is not None)


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, unnamed: str,
           date: str = DATE) -> tuple[bytes, str]:
    """A record's bytes and its URI.  A revisit has the payload's headers but not the payload."""
    page = urn(page_id) if page_id is not None else f"<{unnamed}>"
    uri = quote(url, safe="!#$%&'()*+,/:;=?@[]~") if url else page[1:-1]
    http = "HTTP/1.1 200 OK" + END_OF_LINE + lines(("Content-Type", "text/html; charset=utf-8"), ("Content-Length", len(payload))) + END_OF_LINE
    body = http.encode() + (payload if refers_to is None else b"")
    revisit = refers_to is not None
    head = VERSION + END_OF_LINE + lines(
        ("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", page), ("WARC-Date", date), ("WARC-Target-URI", uri),
        ("WARC-Payload-Digest", f"sha256:{digest}"), ("WARC-Refers-To", urn(refers_to) if revisit else None),
        ("WARC-Profile", PROFILE if revisit else None), ("X-Page-ID", page_id), ("Content-Type", HTTP), ("Content-Length", len(body)))
    return (head + END_OF_LINE).encode() + body + 2 * END_OF_LINE.encode(), uri


def packer(folder: str, level: int = LEVEL, member: int = MEMBER):
    """A function of Arrow batches (page_id, url, payload, digest, refers_to) that writes a package and yields its manifest row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        name = f"part-{context.partitionId():06d}-{context.taskAttemptId()}-{uuid.uuid4().hex[:8]}.zip"
        system, path = located(f"{folder}/{name}")
        index, data, n, at, members = [], None, 0, 0, 0
        rows = (row for batch in batches for i in range(0, batch.num_rows, 64) for row in zip(*(c.to_pylist() for c in batch.slice(i, 64).columns)))
        first = next(rows, None)
        if first is None:
            return
        system.create_dir(path.rsplit("/", 1)[0], recursive=True)
        with system.open_output_stream(path) as out:
            with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED, allowZip64=True) as package:
                for page_id, url, payload, digest, refers_to in (r for some in ([first], rows) for r in some):
                    if data is None or at >= member:
                        if data is not None:
                            data.close()
                        warc = f"data-{members:05d}.warc.gz"
                        data, at, members = package.open(f"archive/{warc}", "w", force_zip64=True), 0, members + 1
                    unnamed = f"urn:part:{context.partitionId()}:{n}"
                    raw, uri = record(page_id, url, payload, digest, refers_to, unnamed)
                    packed = zlib.compressobj(level, zlib.DEFLATED, 31)
                    raw = packed.compress(raw) + packed.flush()
                    data.write(raw)
                    entry = {"filename": warc, "offset": at, "length": len(raw), "digest": f"sha256:{digest}"}
                    index.append(f"{uri} {re.sub('[^0-9]', '', DATE)} {json.dumps(entry)}\n")
                    at, n = at + len(raw), n + 1
                data.close()
                package.writestr(INDEX, "".join(index).encode())
        size = system.get_file_info(path).size
        yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"]), pa.array([size], pa.int64()), pa.array([n], pa.int64())],
                                         ["archive", "n_bytes", "n_records"])

    return run


def with_references(pages: DataFrame, least: int = LEAST, id_col: str = "page_id", url_col: str = "url",
                    html_col: str = "html") -> DataFrame:
    """(page_id, url, payload, digest, refers_to): ``refers_to`` is the
    smallest id of the rows with the same payload of ``least`` bytes or more,
    null for that row itself, for shorter payloads, and where no such row has an id.

    Payloads move once, to the tasks that write them; those of one text that
    many rows have are dealt to many tasks.
    """
    rows = pages.select(pages[id_col].cast("long").alias("page_id"), pages[url_col].alias("url"),
                        F.coalesce(pages[html_col], F.lit("")).cast("binary").alias("payload")).withColumn("digest", F.sha2("payload", 256))
    firsts = rows.groupBy("digest").agg(F.min(F.when(F.octet_length("payload") >= least, F.col("page_id"))).alias("first"),
                                        F.count(F.lit(1)).alias("n"))
    found = salted_join(rows, firsts.select("digest", "first"), "digest", counts=firsts, how="left")
    refers = F.when(~F.col("first").eqNullSafe(F.col("page_id")), F.col("first"))
    return found.select("page_id", "url", "payload", "digest", refers.alias("refers_to"))


def write_archives(records: DataFrame, folder: str | None = None) -> DataFrame:
    """The manifest (archive, n_bytes, n_records; a written table) of the
    packages of ``records`` (``with_references``), below ``folder``, by
    default a scratch folder.  A partition without rows writes none."""
    spark = records.sparkSession
    python_ready(spark)
    return written(records.mapInArrow(packer(folder or scratch_path(spark, "warc")), MANIFEST), "warc-manifest")


def indexed(file, name: str) -> Iterator[tuple[int, int, str, str | None]]:
    """(offset in the package, length, URI, digest) of the records of a package: from its index, or found by a scan."""
    members = [m for m in directory(file) if m.stored]
    data = {m.name.rsplit("/", 1)[1]: (data_offset(file, m), m.size) for m in members if IS_DATA(m.name)}
    indexes = [m for m in members if IS_INDEX(m.name)]
    for m in indexes:
        for line in read_at(file, data_offset(file, m), m.size).decode().split("\n"):
            if not line.strip():
                continue
            entry = json.loads(line[line.index("{"):])
            at, size = data.get(entry["filename"], (0, 0))
            if int(entry["offset"]) + int(entry["length"]) > size:
                raise ValueError(f"{name}: the index names bytes that {entry['filename']} doesn't have")
            yield at + int(entry["offset"]), int(entry["length"]), line.split(" ", 1)[0], (entry.get("digest") or "").removeprefix("sha256:") or None
    if not indexes:
        for at, size in data.values():
            yield from scanned(file, at, size)


def scanned(file, at: int, size: int) -> Iterator[tuple[int, int, str, str | None]]:
    """The gzip members between two places, read piece by piece; of each only the header block is kept."""
    end, begin = at + size, at
    more, head, left = None, b"", b""
    while True:
        if not left:
            if at >= end:
                break
            left = read_at(file, at, min(READ, end - at))
            at += len(left)
        if more is None:
            begin, more, head = at - len(left), zlib.decompressobj(31), b""
        while left and not more.eof:
            some = more.decompress(left, READ)
            left = more.unconsumed_tail or more.unused_data
            if b"\r\n\r\n" not in head:
                head += some
        if more.eof:
            fields = fields_of(head.split(b"\r\n\r\n", 1)[0])
            yield begin, at - len(left) - begin, fields.get("warc-target-uri", ""), fields.get("warc-payload-digest", "").removeprefix("sha256:") or None
            more = None
    if more is not None:
        raise ValueError("the last record is cut off")


def index_entries(archives: DataFrame) -> DataFrame:
    """One row per record of the packages named in ``archives`` (archive):
    archive, offset, length, uri, digest.  A user picks the records to read
    by filtering these rows."""
    python_ready(archives.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column(0).to_pylist():
                with open_file(name) as file:
                    held = []
                    for entry in indexed(file, name):
                        held.append((name, *entry))
                        if len(held) == ROWS:
                            yield batch_of(held, ENTRIES)
                            held = []
                    yield batch_of(held, ENTRIES)

    return archives.select("archive").where(F.col("archive").isNotNull()).mapInArrow(run, ENTRIES)


ARROW = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}


def batch_of(rows: list[tuple], schema: str) -> pa.RecordBatch:
    names, kinds = zip(*(f.split() for f in schema.split(", ")))
    columns = zip(*rows) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(list(c), ARROW[k]) for c, k in zip(columns, kinds)], list(names))


def fields_of(head: bytes) -> dict[str, str]:
    """Header lines after the first, by lower-case name."""
    pairs = (line.split(":", 1) for line in head.decode("utf-8", "replace").split("\r\n")[1:] if ":" in line)
    return {name.strip().lower(): value.strip() for name, value in pairs}


def parsed(raw: bytes, payloads: bool) -> tuple:
    """(record_type, record_id, uri, page_id, payload_bytes, payload_digest, refers_to, payload) of one record.

    A response's payload is hashed and held against its header; a revisit's size and digest are those its headers tell.
    """
    data = zlib.decompress(raw, 31) if raw[:2] == b"\x1f\x8b" else raw
    head, body = data.split(b"\r\n\r\n", 1)
    fields = fields_of(head)
    http, payload = body[:int(fields["content-length"])].split(b"\r\n\r\n", 1)
    kind, told = fields["warc-type"], fields.get("warc-payload-digest", "").removeprefix("sha256:")
    if kind == "response":
        n_bytes, digest = len(payload), hashlib.sha256(payload).hexdigest()
        if told and told != digest:
            raise ValueError(f"{fields['warc-record-id']}: the payload isn't the one that was written")
    else:
        n_bytes, digest = int(fields_of(http)["content-length"]), told
    page_id = fields.get("x-page-id")
    return (kind, fields["warc-record-id"], fields.get("warc-target-uri"), None if page_id is None else int(page_id), n_bytes, digest,
            fields.get("warc-refers-to"), payload if payloads and kind == "response" else None)


def ranges(entries: Iterator[tuple[str, int, int]], most: int = READ) -> Iterator[tuple[str, int, int, list[tuple[int, int]]]]:
    """(archive, offset, length, its records) of ranges to read: neighbours together, up to ``most`` bytes."""
    name, begin, end, held = None, 0, 0, []
    for archive, offset, length in entries:
        if held and (archive != name or offset != end or end + length - begin > most):
            yield name, begin, end - begin, held
            held = []
        if not held:
            name, begin = archive, offset
        held.append((offset, length))
        end = offset + length
    if held:
        yield name, begin, end - begin, held


def read_records(entries: DataFrame, payloads: bool = True, span: int = SPAN) -> DataFrame:
    """The records that ``entries`` (``index_entries``, or some of them)
    name, as ``RECORDS``; ``payload`` is null for revisits, or if not asked for.

    Entries are dealt out by package and ``span`` bytes of it, so a task reads
    neighbours by one range; a row repeated in ``entries`` is read again.
    """
    spark = entries.sparkSession
    python_ready(spark)
    # A given number: entries are small beside the records they name, so their bytes say nothing about the work.
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = entries.select("archive", "offset", "length").where("offset IS NOT NULL").repartition(
        parts, "archive", F.expr(f"offset div {span}")).sortWithinPartitions("archive", "offset")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns)))
        opened, file, held, size = None, None, [], 0
        try:
            for archive, begin, length, records in ranges(rows):
                if archive != opened:
                    if file is not None:
                        file.close()
                    opened, file = archive, open_file(archive)
                data = read_at(file, begin, length)
                for offset, n in records:
                    kind, *rest = parsed(data[offset - begin:offset - begin + n], payloads)
                    held.append((archive, offset, kind, *rest))
                    size += len(rest[-1] or b"")
                    if len(held) == ROWS or size >= BYTES:
                        yield batch_of(held, RECORDS)
                        held, size = [], 0
            yield batch_of(held, RECORDS)
        finally:
            if file is not None:
                file.close()

    return placed.mapInArrow(run, RECORDS)


def round_trip(pages: DataFrame, least: int = LEAST, folder: str | None = None, id_col: str = "page_id", url_col: str = "url",
               html_col: str = "html") -> DataFrame:
    """Writes ``pages`` (read from files) as packages and reads their records back, without payloads.

    One row per input row: page_id, payload_bytes, payload_digest,
    record_type, refers_to (a page_id) and the columns that locate the record.
    A null html is an empty payload.  Of equal payloads the rows with the
    smallest id are responses (several if rows repeat that id), rows without
    an id refer to it; if none has an id, all are responses.  A null url is
    replaced by a name made of the id; urls are percent-encoded.  An empty
    table gives no rows.
    """
    manifest = write_archives(with_references(pages, least, id_col, url_col, html_col), folder)
    found = read_records(index_entries(manifest), payloads=False)
    refers = F.regexp_extract("refers_to", r"^<urn:page:(-?\d+)>$", 1)
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type",
                        F.when(refers != "", refers.cast("long")).alias("refers_to"), "archive", "offset")
