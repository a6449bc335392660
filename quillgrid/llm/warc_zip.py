"""Web archives packaged in ZIP files: written by tasks, read back record by record.

A package is a ZIP file whose members are stored, not compressed: `archive/data.warc.gz`, in
which every WARC record is a gzip member of its own, and `indexes/index.cdxj`, one line per record
with its offset and length. Because members are stored, a record is a range of the package, and
reading it needs neither the other records nor an extracted copy:

1. one task per package reads the end of the file, the central directory (ZIP64 too), the local
   headers of the members it needs, and streams the index;
2. the ranges of all records are dealt by stretches of a package, so that a package larger than
   the others is read by many tasks;
3. a task joins neighbouring ranges to reads of some megabytes and parses the records inside.

Rows with equal payloads share one `response` record; the others are `revisit` records that
refer to it, in the identical-payload-digest profile of WARC 1.1.

Awkward rows. A missing payload is an empty one. A missing id is later than any other; a missing
url leaves its header out. Among rows with one payload and one id the least url (a missing one
before all others) is the response; of rows equal in all three one is. Ids and urls may hold any characters. A payload may be as long
as a Spark binary value. An empty table gives no package and no record. Columns other than the
three named ones are not read, so their names cannot clash.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgrid.llm.common import checkpointed, shuffle_partitions
from quillgrid.sources.ranges import RangedFile, open_for_writing

# Fixed values of the ZIP format: signatures, sizes of the fixed parts, marks for "see ZIP64".
END, END64, LOCATOR64 = b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07"
ENTRY, LOCAL = b"PK\x01\x02", b"PK\x03\x04"
END_SIZE, LOCATOR64_SIZE, END64_SIZE, ENTRY_SIZE, LOCAL_SIZE = 22, 20, 56, 46, 30
LONGEST_COMMENT = 65_535
MARK16, MARK32 = 0xFFFF, 0xFFFFFFFF
ZIP64_EXTRA = 1

ARCHIVE, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
#: Bytes of records after which a task begins another package.
PACKAGE_BYTES = 256 << 20
#: Bytes of one read of neighbouring records, and of a stretch that is dealt to one task.
READ_BYTES, STRETCH_BYTES = 4 << 20, 16 << 20
#: Payload bytes of one batch that is handed on.
BATCH_BYTES = 8 << 20
#: A payload with more than one in HOT_SHARE of all rows is looked up in a broadcast list, which
#: therefore has fewer than HOT_SHARE rows.
HOT_SHARE = 1_000

RECORD_URI = "urn:x-record:"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORDS = (
    "record_id string, id string, url string, record_type string, refers_to string,"
    " payload_bytes long, payload_digest string, payload binary"
)


# --- writing


def with_first(rows: DataFrame, id_col: str, url_col: str, payload_col: str, least_bytes: int) -> DataFrame:
    """`id, url, payload, digest, first, again`: the row, the id of the response that it revisits
    (`again`) or is.

    The payload moves through one shuffle, by digest. Payloads that a large share of the rows
    hold are looked up in a short broadcast list instead and stay where they are.
    """
    payload = F.coalesce(F.col(f"`{payload_col}`").cast("string"), F.lit("")).cast("binary")
    base = rows.select(
        F.col(f"`{id_col}`").alias("id"), F.col(f"`{url_col}`").cast("string").alias("url"), payload.alias("payload")
    ).withColumn("digest", F.unhex(F.sha1("payload")))
    order = F.struct(F.col("id").isNull().alias("no_id"), "id", F.col("url").isNotNull().alias("has_url"), "url")
    firsts = checkpointed(
        base.where(F.octet_length("payload") >= least_bytes)
        .groupBy("digest", "id", "url").agg(F.count("*").alias("n"))
        .groupBy("digest").agg(F.min(order).alias("least"), F.min_by("n", order).alias("n"), F.sum("n").alias("rows"))
        .where(F.col("rows") > 1)
    )
    total = firsts.agg(F.sum("rows")).first()[0] or 0
    is_hot = F.col("rows") * HOT_SHARE > total
    hot = firsts.where(is_hot).drop("rows").withColumn("hot", F.lit(True))
    marked = base.join(F.broadcast(hot), "digest", "left")
    rest = marked.where(F.col("hot").isNull()).drop("least", "n", "hot")
    rest = rest.join(firsts.where(~is_hot).drop("rows"), "digest", "left")
    found = marked.where("hot").drop("hot").unionByName(rest)
    is_least = F.col("id").eqNullSafe(F.col("least.id")) & F.col("url").eqNullSafe(F.col("least.url"))
    alone = F.col("least").isNull()
    # Rows equal in everything: one of them is the response, taken out of their group.
    tied = is_least & (F.col("n") > 1)
    found = found.select(
        "id", "url", "payload", "digest", "n", F.coalesce(F.col("least.id"), "id").alias("first"),
        (~F.coalesce(alone | is_least, F.lit(False))).alias("again"), F.coalesce(tied, F.lit(False)).alias("tied"),
    )
    columns = ["id", "url", "payload", "digest", "first", "again"]
    sized = F.octet_length("payload").alias("size")
    single = found.where(~F.col("tied")).select(*columns, sized)
    if firsts.where("n > 1").isEmpty():
        return single
    groups = found.where("tied").groupBy("digest", "id", "url", "first").agg(
        F.first("payload").alias("payload"), F.first("n").alias("n")
    )
    responses = groups.select(*columns[:-1], F.lit(False).alias("again"), sized)
    copies = groups.withColumn("size", sized).withColumn("at", F.explode(F.expr("sequence(1, n - 1, 4096)")))
    copies = copies.drop("payload").repartition("digest", "id", "url", "at")
    copies = copies.withColumn("at", F.explode(F.expr("sequence(at, least(n - 1, at + 4095))")))
    nothing = F.lit(None).cast("binary").alias("payload")
    return single.unionByName(responses).unionByName(
        copies.select("id", "url", nothing, "digest", "first", F.lit(True).alias("again"), "size")
    )


def write_packages(
    rows: DataFrame,
    id_col: str,
    url_col: str,
    payload_col: str,
    root: str,
    least_bytes: int = 0,
    date: str = "1970-01-01T00:00:00Z",
    package_bytes: int = PACKAGE_BYTES,
) -> DataFrame:
    """Write one record per row below `root`, a folder that all executors share.

    Returns `path, n_records, n_bytes`, one row per package that counts. A task that is run again
    writes files of new names, and only the names in the result are read, so a lost executor
    leaves no record twice. Payloads shorter than `least_bytes` are never revisits.
    """
    marked = with_first(rows, id_col, url_col, payload_col, least_bytes)
    text = marked.select(
        F.col("id").cast("string").alias("id"), "url", "digest", F.col("first").cast("string").alias("first"),
        "again", "size", F.when(~F.col("again"), F.col("payload")).alias("payload"),
    )

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        package = None
        for batch in batches:
            for row in batch.to_pylist():
                if package is not None and package.size >= package_bytes:
                    yield package.closed()
                    package = None
                if package is None:
                    package = PackageWriter(f"{root}/{uuid.uuid4().hex}.zip")
                package.add(row, date)
        if package is not None:
            yield package.closed()

    return checkpointed(text.mapInArrow(write, "path string, n_records long, n_bytes long"))


class PackageWriter:
    """One package, written as a stream: records first, their index after them."""

    def __init__(self, path: str):
        self.path = path
        self.token = uuid.uuid4().hex
        self.lines: list[str] = []
        self.size = 0
        self._stream = open_for_writing(path)
        self._zip = zipfile.ZipFile(self._stream, "w", zipfile.ZIP_STORED)
        self._member = self._zip.open(zipfile.ZipInfo(ARCHIVE), "w", force_zip64=True)

    def add(self, row: dict, date: str) -> None:
        data = gzip.compress(record_bytes(row, f"{self.token}-{len(self.lines)}", date), 1, mtime=0)
        self._member.write(data)
        place = {"url": row["url"], "offset": str(self.size), "length": str(len(data)), "filename": ARCHIVE}
        stamp = "".join(c for c in date if c.isdigit())
        self.lines.append(f"{quoted(row['url'] or '-')} {stamp} {json.dumps(place)}\n")
        self.size += len(data)

    def closed(self) -> pa.RecordBatch:
        self._member.close()
        self.lines.sort()
        with self._zip.open(zipfile.ZipInfo(INDEX), "w", force_zip64=True) as member:
            for line in self.lines:
                member.write(line.encode())
        self._zip.close()
        self._stream.close()
        columns = [[self.path], [len(self.lines)], [self.size]]
        return pa.record_batch([pa.array(columns[0]), *[pa.array(c, pa.int64()) for c in columns[1:]]],
                               ["path", "n_records", "n_bytes"])


def quoted(url: str) -> str:
    """A url without blanks or control characters; `unquote` gives it back."""
    return quote(url, safe=":/?&=#+;,@!~*'()$[]")


def uri_of(value: str | None, token: str) -> str:
    """A record's URI, which names the row's id; an id that is missing is left out."""
    return f"<{RECORD_URI}{token}{'' if value is None else ':' + quote(value, safe='')}>"


def id_in(uri: str) -> str | None:
    _, colon, value = uri.strip("<>").removeprefix(RECORD_URI).partition(":")
    return unquote(value) if colon else None


def record_bytes(row: dict, token: str, date: str) -> bytes:
    """A response with its payload, or a revisit with the HTTP header alone."""
    digest = "sha1:" + base64.b32encode(row["digest"]).decode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {row['size']}\r\n\r\n"
    block = http.encode() + (b"" if row["again"] else row["payload"])
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if row['again'] else 'response'}",
        f"WARC-Record-ID: {uri_of(row['id'], token)}",
        f"WARC-Date: {date}",
    ]
    if row["url"] is not None:
        lines.append(f"WARC-Target-URI: {quoted(row['url'])}")
    if row["again"]:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {uri_of(row['first'], 'first')}"]
    lines += [
        f"WARC-Payload-Digest: {digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


# --- reading


@dataclass(frozen=True)
class Member:
    """An entry of the central directory."""

    name: str
    method: int
    encrypted: bool
    size: int
    header: int


def members(file: RangedFile) -> Iterator[Member]:
    """The entries of the central directory, read block by block."""
    start, size, count, shift = directory(file)
    held = b""
    blocks = file.stream(start, size)
    for _ in range(count):
        while len(held) < ENTRY_SIZE or len(held) < ENTRY_SIZE + sum(struct.unpack_from("<3H", held, 28)):
            more = next(blocks, None)
            if more is None:
                raise ValueError("The central directory ends inside an entry.")
            held += more
        (sign, flags, method, packed, full, name, extra, comment, header) = struct.unpack_from(
            "<4s4xHH8xIIHHH8xI", held
        )
        if sign != ENTRY:
            raise ValueError("The central directory holds something else than entries.")
        tail = held[ENTRY_SIZE : ENTRY_SIZE + name + extra]
        full, packed, header = wide_fields(tail[name:], [full, packed, header])
        encoding = "utf-8" if flags & 0x800 else "cp437"
        if method == 0 and full != packed:
            raise ValueError("A stored member has two sizes.")
        yield Member(tail[:name].decode(encoding), method, bool(flags & 1), full, header + shift)
        held = held[ENTRY_SIZE + name + extra + comment :]


def directory(file: RangedFile) -> tuple[int, int, int, int]:
    """Start, size and number of entries of the central directory, and the number of bytes that
    stand before the ZIP file's own first byte."""
    most = min(file.size, END_SIZE + LONGEST_COMMENT)
    tail = file.read(file.size - most, most)
    at = tail.rfind(END)
    while at >= 0 and not (at + END_SIZE <= most and at + END_SIZE + struct.unpack_from("<H", tail, at + 20)[0] == most):
        at = tail.rfind(END, 0, at)
    if at < 0:
        raise ValueError("Not a ZIP file: no end record.")
    end = file.size - most + at
    disk, first, here, count, size, start = struct.unpack_from("<HHHHII", tail, at + 4)
    locator = file.read(max(0, end - LOCATOR64_SIZE), LOCATOR64_SIZE)
    if locator[:4] == LOCATOR64:
        place = struct.unpack_from("<Q", locator, 8)[0]
        record = file.read(place, END64_SIZE)
        if record[:4] != END64:  # bytes before the package move everything
            place = end - LOCATOR64_SIZE - END64_SIZE
            record = file.read(max(0, place), END64_SIZE)
        if record[:4] != END64:
            raise ValueError("The ZIP64 end record is missing.")
        disk, first, here, count, size, start = struct.unpack_from("<IIQQQQ", record, 16)
        end = place
    elif MARK16 in (here, count) or MARK32 in (size, start):
        raise ValueError("The ZIP64 end record is missing.")
    if disk or first or here != count:
        raise ValueError("A ZIP file in several parts cannot be read.")
    shift = end - size - start
    if shift < 0:
        raise ValueError("The central directory does not fit into the file.")
    return start + shift, size, count, shift


def wide_fields(extra: bytes, fields: list[int]) -> list[int]:
    """Sizes and offset; those that are marked come from the ZIP64 part, in this order."""
    at = 0
    while MARK32 in fields and at + 4 <= len(extra):
        kind, length = struct.unpack_from("<HH", extra, at)
        if kind == ZIP64_EXTRA:
            wide = iter(struct.unpack_from(f"<{length // 8}Q", extra, at + 4))
            fields = [next(wide, MARK32) if f == MARK32 else f for f in fields]
            break
        at += 4 + length
    return fields


def data_start(file: RangedFile, member: Member) -> int:
    """Where the bytes of a stored member begin: its local header is as long as it says itself."""
    if member.method or member.encrypted:
        raise ValueError(f"{member.name} is not stored, so its records have no ranges.")
    header = file.read(member.header, LOCAL_SIZE)
    if header[:4] != LOCAL or len(header) < LOCAL_SIZE:
        raise ValueError(f"{member.name} has no local header.")
    return member.header + LOCAL_SIZE + sum(struct.unpack_from("<HH", header, 26))


def record_places(file: RangedFile) -> Iterator[tuple[int, int]]:
    """Offset in the package and length of every indexed record."""
    archives, indexes = {}, []
    for member in members(file):
        folder = member.name.partition("/")[0]
        if folder == "archive" and not member.name.endswith("/"):
            archives[member.name] = member
        elif folder == "indexes" and member.name.endswith((".cdxj", ".cdxj.gz")):
            indexes.append(member)
    if archives and not indexes:
        raise ValueError("The package has no index.")
    starts: dict[str, int] = {}
    for index in indexes:
        blocks = file.stream(data_start(file, index), index.size)
        for line in lines_of(unzipped(blocks) if index.name.endswith(".gz") else blocks):
            place = json.loads(line[line.index(b"{") :])
            name = place["filename"]
            member = archives.get(name) or archives.get(f"archive/{name}")
            if member is None:
                raise ValueError(f"The index names {name}, which the package does not hold.")
            if member.name not in starts:
                starts[member.name] = data_start(file, member)
            offset, length = int(place["offset"]), int(place["length"])
            if offset < 0 or length <= 0 or offset + length > member.size:
                raise ValueError("The index names a range outside its archive.")
            yield starts[member.name] + offset, length


def unzipped(blocks: Iterator[bytes]) -> Iterator[bytes]:
    unpack = zlib.decompressobj(31)
    for block in blocks:
        while block:
            yield unpack.decompress(block)
            block = unpack.unused_data
            if unpack.eof:
                unpack = zlib.decompressobj(31)


def lines_of(blocks: Iterator[bytes]) -> Iterator[bytes]:
    held = b""
    for block in blocks:
        *whole, held = (held + block).split(b"\n")
        yield from (line for line in whole if line.strip())
    if held.strip():
        yield held


def read_packages(packages: DataFrame) -> DataFrame:
    """The records of all packages in column `path`, as `RECORDS`.

    `payload` of a revisit is null; its length is that of its response, from the HTTP header it
    keeps. A payload whose digest is not the recorded one raises an error.
    """

    def locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                with RangedFile(path) as file:
                    places: list[tuple[int, int]] = []
                    for place in record_places(file):
                        places.append(place)
                        if len(places) == 10_000:
                            yield places_batch(path, places)
                            places = []
                    yield places_batch(path, places)

    stretch = F.floor(F.col("offset") / STRETCH_BYTES)
    # A fixed number of partitions: places are small, what they point at is not, so adaptive
    # execution must not join partitions by the size of their rows.
    parts = shuffle_partitions(packages.sparkSession)
    places = (
        packages.select("path").repartition(parts, "path")
        .mapInArrow(locate, "path string, offset long, length long")
        .repartition(parts, "path", stretch).sortWithinPartitions("path", "offset")
    )
    return places.mapInArrow(read_places, RECORDS)


def places_batch(path: str, places: list[tuple[int, int]]) -> pa.RecordBatch:
    offsets, lengths = ([p[i] for p in places] for i in (0, 1))
    return pa.record_batch(
        [pa.array([path] * len(places), pa.string()), pa.array(offsets, pa.int64()), pa.array(lengths, pa.int64())],
        ["path", "offset", "length"],
    )


def read_places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The records at sorted places; neighbours are read at once."""
    opened: RangedFile | None = None
    opened_path = None
    rows: list[dict] = []
    held = 0
    for batch in batches:
        for path, spans in joined_ranges(batch):
            if path != opened_path:
                if opened is not None:
                    opened.close()
                opened, opened_path = RangedFile(path), path
            start = spans[0][0]
            data = opened.read(start, spans[-1][0] + spans[-1][1] - start)
            for offset, length in spans:
                row = parsed_record(data[offset - start : offset - start + length])
                held += len(row["payload"] or b"")
                rows.append(row)
                if held >= BATCH_BYTES or len(rows) == 10_000:
                    yield records_batch(rows)
                    rows, held = [], 0
    if opened is not None:
        opened.close()
    if rows:
        yield records_batch(rows)


def joined_ranges(batch: pa.RecordBatch) -> Iterator[tuple[str, list[tuple[int, int]]]]:
    """Runs of places that lie side by side, of at most READ_BYTES unless one place is longer."""
    spans: list[tuple[int, int]] = []
    at, size = None, 0
    for path, offset, length in zip(*[batch.column(i).to_pylist() for i in range(3)]):
        beside = spans and path == at and spans[-1][0] + spans[-1][1] == offset
        if spans and not (beside and size + length <= READ_BYTES):
            yield at, spans
            spans, size = [], 0
        at = path
        spans.append((offset, length))
        size += length
    if spans:
        yield at, spans


def records_batch(rows: list[dict]) -> pa.RecordBatch:
    text, number = pa.string(), pa.int64()
    kinds = {"payload_bytes": number, "payload": pa.binary()}
    names = [part.split()[0] for part in RECORDS.split(", ")]
    return pa.record_batch([pa.array([r[n] for r in rows], kinds.get(n, text)) for n in names], names)


def parsed_record(data: bytes) -> dict:
    """The fields of one record, compressed or not."""
    if data[:2] == b"\x1f\x8b":
        data = gzip.decompress(data)
    head, mark, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if not mark or not version.startswith("WARC/"):
        raise ValueError("A range of the index does not hold a record.")
    fields = dict(headers(lines))
    block = rest[: int(fields["content-length"])]
    http, mark, payload = block.partition(b"\r\n\r\n")
    if not mark or not http.startswith(b"HTTP/"):
        raise ValueError("The record's block is no HTTP response.")
    kind = fields["warc-type"]
    digest = fields["warc-payload-digest"].removeprefix("sha1:")
    if kind == "revisit":
        payload, size = None, int(dict(headers(http.decode("latin-1").split("\r\n")[1:]))["content-length"])
    else:
        size = len(payload)
        if base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
            raise ValueError(f"The payload of {fields['warc-record-id']} is not what its digest says.")
    refers = fields.get("warc-refers-to")
    url = fields.get("warc-target-uri")
    return {
        "record_id": fields["warc-record-id"].strip("<>"),
        "id": id_in(fields["warc-record-id"]),
        "url": None if url is None else unquote(url),
        "record_type": kind,
        "refers_to": None if refers is None else id_in(refers),
        "payload_bytes": size,
        "payload_digest": digest,
        "payload": payload,
    }


def headers(lines: list[str]) -> Iterator[tuple[str, str]]:
    for line in lines:
        name, _, value = line.partition(":")
        yield name.strip().lower(), value.strip()

