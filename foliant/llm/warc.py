"""WARC archives as a Spark data source.

Writing gives every record a gzip member of its own, with the member's length
in the gzip header's extra field `SL`. The source plans a partition for each
byte range of an archive, inflates a member no further than its WARC headers, and leaves
those whose record type or headers the pushed-down predicates exclude, or whose
payload no column asks for, without inflating or decoding the rest: the `SL` field leads
straight to the next member. Archives of other writers have no such field; their members
are inflated to find their ends. An archive without compression is one partition.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import datasource
from pyspark.sql.datasource import DataSource, EqualTo, Filter, In, InputPartition, IsNotNull

from .common import delete, filesystem, materialise, scratch, small_batches

SCHEMA = "archive string, offset long, record_type string, record_id string, target_uri string, refers_to string, payload_digest string, content_length long, payload_length long, payload binary"
#: Columns and the WARC header each comes from.
HEADERS = {"record_type": "warc-type", "record_id": "warc-record-id", "target_uri": "warc-target-uri", "refers_to": "warc-refers-to", "payload_digest": "warc-payload-digest"}
MAGIC = b"\x1f\x8b\x08\x04"
RANGE = 32 << 20


def member(data: bytes, level: int = 6) -> bytes:
    """A gzip member that states its own length and the length of its content."""
    z = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = z.compress(data) + z.flush()
    extra = struct.pack("<2sHQQ", b"SL", 16, 10 + 2 + 20 + len(body) + 8, len(data))
    return MAGIC + b"\0\0\0\0\0\xff" + struct.pack("<H", len(extra)) + extra + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


def record(kind: str, record_id: str, uri: str, payload: bytes, digest: str, refers_to: str | None = None, date: str = "2020-01-01T00:00:00Z") -> bytes:
    """A WARC record with an HTTP block; a revisit keeps the HTTP headers and leaves out the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if kind == "revisit" else http + payload
    head = [f"WARC-Type: {kind}", f"WARC-Record-ID: <{record_id}>", f"WARC-Date: {date}", f"WARC-Target-URI: {clean(uri)}", f"WARC-Payload-Digest: sha1:{digest}"]
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <{refers_to}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return ("WARC/1.1\r\n" + "\r\n".join(head) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


def clean(uri: str) -> str:
    """A header value has no line ends."""
    return uri.replace("\r", "%0D").replace("\n", "%0A")


def parse_head(data: bytes) -> tuple[dict[str, str], int] | None:
    """The WARC headers (names lower-cased) and where the block begins; None if they don't end within data."""
    end = data.find(b"\r\n\r\n")
    if end < 0:
        return None
    lines = data[:end].decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
    pairs = (x.partition(":") for x in lines[1:])
    return {k.strip().lower(): v.strip() for k, _, v in pairs}, end + 4


class Cursor:
    """The bytes of an archive from some offset on, read ahead in blocks."""

    def __init__(self, source, size: int, block: int = 1 << 20):
        self.source, self.size, self.block, self.at, self.data = source, size, block, 0, b""

    def get(self, offset: int, n: int) -> bytes:
        if not (self.at <= offset and offset + n <= self.at + len(self.data)):
            self.source.seek(offset)
            self.data, self.at = self.source.read(min(max(n, self.block), max(0, self.size - offset))), offset
        return self.data[offset - self.at : offset - self.at + n]


class Member:
    """A gzip member at an offset, inflated as far as asked."""

    def __init__(self, cursor: Cursor, offset: int):
        self.c, self.offset, self.out, self.next = cursor, offset, bytearray(), offset
        head = cursor.get(offset, 32)
        self.length = struct.unpack("<Q", head[16:24])[0] if head[:4] == MAGIC and head[12:14] == b"SL" else None
        self.z = zlib.decompressobj(31)

    def inflate(self, least: int | None) -> bytearray:
        """At least so many bytes of the content, all for None."""
        step = 1024 if least else 1 << 18
        while not self.z.eof and (least is None or len(self.out) < least):
            more = self.c.get(self.next, min(step, self.c.size - self.next))
            if not more:
                raise ValueError(f"the archive ends within the member at {self.offset}")
            self.out += self.z.decompress(more)
            self.next += len(more)
            step = 1 << 18
        return self.out

    def end(self) -> int:
        if self.length is not None:
            return self.offset + self.length
        self.inflate(None)
        return self.next - len(self.z.unused_data)


class Plain:
    """A record of an archive without compression, as a Member."""

    def __init__(self, cursor: Cursor, offset: int):
        self.c, self.offset, self.out, self.eof = cursor, offset, b"", False
        self.z = self

    def inflate(self, least: int) -> bytes:
        left = self.c.size - self.offset
        self.out, self.eof = self.c.get(self.offset, min(max(least, len(self.out)), left)), least >= left
        return self.out

    def end(self) -> int:
        head, begin = parse_head(self.out)
        at = self.offset + begin + int(head["content-length"])
        if at > self.c.size:
            raise ValueError(f"the archive ends within the record at {self.offset}")
        while self.c.get(at, min(2, self.c.size - at)) == b"\r\n":
            at += 2
        return at


def starts(cursor: Cursor, lo: int, hi: int) -> Iterator[int]:
    """Where the first member of a range can begin: offsets of the magic bytes."""
    at = lo
    while at < hi:
        data = cursor.get(at, min(1 << 16, cursor.size - at))
        x = data.find(b"\x1f\x8b\x08")
        while x >= 0:
            yield at + x
            x = data.find(b"\x1f\x8b\x08", x + 1)
        at += max(1, len(data) - 2)


def read_range(fs: pafs.FileSystem, path: str, size: int, lo: int, hi: int, wanted: list[tuple[str, frozenset]], payload: bool) -> Iterator[tuple]:
    """The records whose members begin in [lo, hi). wanted: header column and the values let through."""
    with fs.open_input_file(path) as source:
        cursor = Cursor(source, size)
        plain = cursor.get(0, min(5, size)) == b"WARC/"
        # only lengths lead from one plain record to the next: a payload may look like a record
        at = 0 if lo == 0 or plain else None
        for x in starts(cursor, lo, hi) if at is None else ():
            try:  # the magic bytes may stand inside compressed data
                if Member(cursor, x).inflate(5).startswith(b"WARC/"):
                    at = x
                    break
            except (ValueError, zlib.error):
                continue
        while at is not None and at < hi:
            m = (Plain if plain else Member)(cursor, at)
            least, found = 512, None
            while not (found := parse_head(m.inflate(least))):
                if m.z.eof:
                    raise ValueError(f"no end of headers in the record at {at} of {path}")
                least = len(m.out) + 1024
            head, begin = found
            value = {c: strip(head.get(h)) for c, h in HEADERS.items()}
            if at >= lo and all(value[c] in allowed for c, allowed in wanted):
                length = int(head.get("content-length", 0))
                http_end, http_length, body = -1, None, None
                if head.get("content-type", "").startswith("application/http"):
                    least = begin + 256
                    while (http_end := m.inflate(min(least, begin + length)).find(b"\r\n\r\n", begin)) < 0 and least < begin + length:
                        least += 4096
                    names = (x.partition(b":") for x in bytes(m.out[begin : max(begin, http_end)]).split(b"\r\n")[1:])
                    http_length = next((int(v) for k, _, v in names if k.strip().lower() == b"content-length"), None)
                first = http_end + 4 if http_end >= 0 else begin
                if payload:
                    body = bytes(memoryview(m.inflate(begin + length))[first : begin + length])
                    if len(body) < begin + length - first:
                        raise ValueError(f"the record at {at} of {path} ends within its block")
                yield (path, at, *value.values(), length, http_length if http_length is not None else begin + length - first, body)
            at = m.end()
            if at >= size:
                break


def strip(value: str | None) -> str | None:
    if value is None:
        return None
    value = value[1:-1] if value.startswith("<") and value.endswith(">") else value
    return value.removeprefix("sha1:")


class Span(InputPartition):
    def __init__(self, uri: str, size: int, lo: int, hi: int):
        self.uri, self.size, self.lo, self.hi = uri, size, lo, hi


class WarcScan(datasource.DataSourceReader):
    def __init__(self, options: dict, schema):
        self.options, self.names = options, schema.names
        self.wanted: list[tuple[str, frozenset]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802
        """Equality and IN on header columns are taken over; the rest stays with Spark."""
        for f in filters:
            name = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if name in HEADERS and isinstance(f, EqualTo):
                self.wanted.append((name, frozenset([f.value])))
            elif name in HEADERS and isinstance(f, In):
                self.wanted.append((name, frozenset(f.value)))
            elif not (isinstance(f, IsNotNull) and name == "record_type"):
                yield f

    def partitions(self) -> list[Span]:
        step, spans = int(self.options.get("range", RANGE)), []
        fs, root = filesystem(self.options["path"])
        prefix = self.options["path"][: -len(root)] if self.options["path"].endswith(root) else ""
        for x in sorted(fs.get_file_info(pafs.FileSelector(root, recursive=True)) if fs.get_file_info(root).type == pafs.FileType.Directory else [fs.get_file_info(root)], key=lambda x: x.path):
            if x.type == pafs.FileType.File and x.path.endswith((".warc.gz", ".warc")) and x.size:
                cut = x.size if x.path.endswith(".warc") else step  # a plain archive is read from its start
                spans += [Span(prefix + x.path, x.size, lo, min(lo + cut, x.size)) for lo in range(0, x.size, cut)]
        return spans or [Span("", 0, 0, 0)]

    def read(self, span: Span) -> Iterator[pa.RecordBatch]:
        kinds = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
        arrow = pa.schema([(n, kinds[k]) for n, k in (x.split() for x in SCHEMA.split(", "))])
        keep = pa.schema([arrow.field(n) for n in self.names])
        at = [arrow.get_field_index(n) for n in self.names]
        if not span.uri:
            return
        fs, path = filesystem(span.uri)
        rows, held = [], 0
        for r in read_range(fs, path, span.size, span.lo, span.hi, self.wanted, self.options.get("payload", "true") == "true" and "payload" in self.names):
            rows.append(r)
            held += 300 + len(r[-1] or b"")
            if held >= 8 << 20:
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in rows], f.type) for i, f in zip(at, keep, strict=True)], schema=keep)
                rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in rows], f.type) for i, f in zip(at, keep, strict=True)], schema=keep)


class WarcSource(DataSource):
    """format("warc"). Options: path (archive or folder), range (bytes a partition), payload (false: headers only).

    A schema with some of SCHEMA's columns may be given; without `payload` in it no payload is inflated.
    """

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcScan:
        return WarcScan(self.options, schema)


def read_warc(spark: SparkSession, path: str, columns: list[str] | None = None, record_types: list[str] | None = None) -> DataFrame:
    """The records of an archive or a folder of archives; record_types are pushed down to the source.

    Spark pushes predicates to Python sources only where `spark.sql.python.filterPushdown.enabled` is true, so the session gets that setting.
    """
    from pyspark.sql.types import StructType

    spark.dataSource.register(WarcSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    full = StructType.fromDDL(SCHEMA)
    scan = spark.read.format("warc")
    if columns:
        scan = scan.schema(StructType([full[c] for c in columns]))
    df = scan.load(path)
    return df.where(F.col("record_type").isin(record_types)) if record_types else df


def page_records(pages: DataFrame, least: int = 1000, salts: int = 16) -> DataFrame:
    """What to write for each page: (page_id, url, payload, payload_digest, record_type, refers_to).

    Of the pages with equal payloads of at least `least` bytes, the one with the largest page_id is
    the response and the others revisit it; rows with that same id are responses too, and a null id is less than any. Digests are made by Spark; the largest
    ids are found by an aggregation that combines before it shuffles, and only digests that occur more than once take part
    in the join, salted, so that a payload that a third of all pages share lands in many tasks. Smaller payloads have salts that nothing is joined to, one of very many each.
    """
    rows = pages.select("page_id", F.col("url").cast("string").alias("url"), F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8").alias("payload")).withColumn("payload_digest", F.sha1("payload"))
    big = F.octet_length("payload") >= least
    first = rows.where(big).groupBy("payload_digest").agg(F.max("page_id").alias("top"), F.count("*").alias("n")).where("n > 1 and top is not null")
    first = first.select("payload_digest", "top", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    own = F.xxhash64("page_id", "url")
    salt = F.when(big, F.pmod(own, F.lit(salts))).otherwise(-1 - F.pmod(own, F.lit(1 << 20))).cast("int")
    joined = rows.withColumn("salt", salt).join(first, ["payload_digest", "salt"], "left")
    again = F.col("top").isNotNull() & ~F.col("top").eqNullSafe(F.col("page_id"))
    return joined.select("page_id", "url", "payload", "payload_digest", F.when(again, "revisit").otherwise("response").alias("record_type"), F.when(again, F.col("top")).alias("refers_to"))


def write_warc(records: DataFrame, path: str, level: int = 6) -> DataFrame:
    """Write one archive a task below path, and return (archive, records). Not lazy.

    An archive gets its name only when it is complete, so that a lost or repeated task leaves no
    part of one; of a task that ran twice, the list that is returned has the archive that counts. An empty id is
    written as none.
    """
    fs, root = filesystem(path)
    fs.create_dir(root, recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = filesystem(path)
        name, out, n = f"{base}/{uuid.uuid4().hex}", None, 0
        for batch in batches:
            for r in batch.to_pylist():
                out = out or store.open_output_stream(name + ".part")
                ids = [f"urn:page:{'' if x is None else x}" for x in (r["page_id"], r["refers_to"])]
                out.write(member(record(r["record_type"], ids[0], r["url"] or "", r["payload"], r["payload_digest"], ids[1]), level))
                n += 1
        if out:
            out.close()
            store.move(name + ".part", name + ".warc.gz")
            yield pa.RecordBatch.from_pydict({"archive": [name + ".warc.gz"], "records": [n]})

    small_batches(records.sparkSession)
    return materialise(records.mapInArrow(run, "archive string, records long"), "warc-list")


def archive_pages(pages: DataFrame, path: str | None = None) -> DataFrame:
    """Write pages (page_id, url, html) as WARC archives and read them back: one row a record.

    Columns: page_id, payload_bytes, payload_digest, record_type, refers_to, target_uri. Two scans of the archives, each with its record type pushed down:
    length and digest of responses come from their payloads as read; revisits are read from their headers alone. A null html is an empty payload, a
    null url an empty header; pages with equal ids stay apart as records; an empty string as id comes back as null; no pages, no rows.
    Other columns of pages are not read. The archives go to a new folder below `path`, where other files stay as they are; without a path
    they are scratch, and go once the rows are written.
    """
    spark = pages.sparkSession
    folder = f"{path.rstrip('/')}/archives-{uuid.uuid4().hex}" if path else scratch(spark, "warc")
    drop_unlisted(folder, write_warc(page_records(pages), folder))
    found = records_back(spark, folder, pages.schema["page_id"].dataType)
    if path:
        return found
    found = materialise(found, "warc-rows")
    delete(spark, folder)
    return found


def drop_unlisted(folder: str, written: DataFrame) -> None:
    """Delete what tasks that don't count wrote to a folder of our own: driver and listing hold a name for each task."""
    fs, root = filesystem(folder)
    listed = {r.archive for r in written.select("archive").toLocalIterator()}
    for x in fs.get_file_info(pafs.FileSelector(root)):
        if x.path not in listed:
            fs.delete_file(x.path)


def records_back(spark: SparkSession, folder: str, kind) -> DataFrame:
    """The rows of archive_pages from the archives in a folder."""
    page = lambda c: F.nullif(F.regexp_replace(c, "^urn:page:", ""), F.lit("")).cast(kind)
    whole = read_warc(spark, folder, ["record_type", "record_id", "target_uri", "payload"], ["response"])
    heads = read_warc(spark, folder, ["record_type", "record_id", "target_uri", "refers_to", "payload_digest", "payload_length"], ["revisit"])
    responses = whole.select(page("record_id").alias("page_id"), F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha1("payload").alias("payload_digest"), "record_type", F.lit(None).cast(kind).alias("refers_to"), "target_uri")
    return responses.union(heads.select(page("record_id").alias("page_id"), F.col("payload_length").alias("payload_bytes"), "payload_digest", "record_type", page("refers_to").alias("refers_to"), "target_uri"))
