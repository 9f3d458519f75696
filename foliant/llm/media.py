"""Media columns: images in archives, read by byte range.

Payloads are kept as PNG images of 8-bit RGB samples, 64 wide (192 bytes a row), lossless, in ZIP
archives without further compression. The data source plans partitions from the archives' sizes alone: each is a
byte range of one archive, and its task reads that archive's directory, takes the members that
begin in the range, and streams them in Arrow batches of bounded size. A member that cannot be read, or whose checksum is wrong, is tried
again by its offset; the others are not read again.
"""

from __future__ import annotations

import hashlib
import struct
import time
import uuid
import zipfile
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import datasource
from pyspark.sql.datasource import DataSource, InputPartition

from .common import delete, filesystem, map_batches, materialise, scratch, small_batches

ROW = 192  # bytes of 64 RGB samples
SCHEMA = "archive string, member string, offset long, media binary"
PNG = b"\x89PNG\r\n\x1a\n"
RANGE = 32 << 20
BATCH = 8 << 20


def pad(data: bytes) -> bytes:
    """Spaces up to a positive multiple of 192."""
    return data + b" " * (-len(data) % ROW if data else ROW)


def chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def encode_png(data: bytes, level: int = 3) -> bytes:
    """A PNG of the padded data; its length without padding goes in a text chunk."""
    payload = pad(data)
    rows = np.zeros((len(payload) // ROW, ROW + 1), np.uint8)  # a filter byte 0 before each row
    rows[:, 1:] = np.frombuffer(payload, np.uint8).reshape(-1, ROW)
    head = struct.pack(">IIBBBBB", ROW // 3, len(rows), 8, 2, 0, 0, 0)
    return PNG + chunk(b"IHDR", head) + chunk(b"tEXt", b"bytes\0" + str(len(data)).encode()) + chunk(b"IDAT", zlib.compress(rows.tobytes(), level)) + chunk(b"IEND", b"")


def decode_png(media: bytes) -> tuple[bytes, int]:
    """The samples of an 8-bit RGB PNG with unfiltered rows, and the length that its text chunk states."""
    if media[:8] != PNG:
        raise ValueError("not a PNG")
    at, idat, length, head = 8, [], None, None
    while at < len(media):
        n, kind = struct.unpack(">I4s", media[at : at + 8])
        data = media[at + 8 : at + 8 + n]
        if zlib.crc32(kind + data) != struct.unpack(">I", media[at + 8 + n : at + 12 + n])[0]:
            raise ValueError(f"wrong checksum in the {kind.decode()} chunk")
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", data)
        elif kind == b"IDAT":
            idat.append(data)
        elif kind == b"tEXt" and data.startswith(b"bytes\0"):
            length = int(data[6:])
        at += 12 + n
    if head is None or head[2:] != (8, 2, 0, 0, 0):
        raise ValueError("only 8-bit RGB without interlace is stored here")
    rows = np.frombuffer(zlib.decompress(b"".join(idat)), np.uint8).reshape(head[1], 3 * head[0] + 1)
    if rows[:, 0].any():
        raise ValueError("filtered rows")
    samples = rows[:, 1:].tobytes()
    return samples, len(samples) if length is None else length


def feature(payload: bytes, step: int = 4096) -> str:
    """Mean and deviation of each channel, and a 64-bit average hash of an 8 x 8 reduction, from integers alone, `step` rows at a time."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, 64, 3)
    total, square, grey = np.zeros(3, np.int64), np.zeros(3, np.int64), np.empty((len(rows), 8), np.int32)
    for a in range(0, len(rows), step):
        x = rows[a : a + step].astype(np.int32)
        total += x.sum(axis=(0, 1), dtype=np.int64)
        square += (x * x).sum(axis=(0, 1), dtype=np.int64)
        grey[a : a + step] = x.sum(axis=2).reshape(-1, 8, 8).sum(axis=2)  # 8 columns
    n = len(rows) * 64
    stats = [f"{int(t) * 100 // n}.{int(q * n - t * t) * 100 // (n * n)}" for t, q in zip(total.tolist(), square.tolist(), strict=True)]
    bands = [grey[len(grey) * i // 8 : max(len(grey) * (i + 1) // 8, len(grey) * i // 8 + 1)] for i in range(8)]
    cells = np.array([b.sum(axis=0, dtype=np.int64) * 1000 // len(b) for b in bands]).ravel()
    bits = cells * 64 > cells.sum()
    return ":".join(stats) + ":" + np.packbits(bits).tobytes().hex()


class Outlet:
    """A stream that counts, for zipfile."""

    def __init__(self, out):
        self.out, self.at = out, 0

    def write(self, data) -> int:
        data = bytes(data)
        self.out.write(data)
        self.at += len(data)
        return len(data)

    def flush(self) -> None:
        self.out.flush()


def write_media(docs: DataFrame, path: str, level: int = 3) -> DataFrame:
    """Store each row's text (doc_id, text) as an image, one archive a task, and return (archive, bytes, members). Not lazy.

    An archive takes its name when it is complete. Members are called <doc_id>.<row>.png.
    """
    fs, root = filesystem(path)
    fs.create_dir(root, recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = filesystem(path)
        name, zipped, stream, n = f"{base}/{uuid.uuid4().hex}", None, None, 0
        for batch in batches:
            for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
                if zipped is None:
                    stream = store.open_output_stream(name + ".part")
                    outlet = Outlet(stream)
                    zipped = zipfile.ZipFile(outlet, "w", zipfile.ZIP_STORED)
                key = doc_id.as_py()
                zipped.writestr(zipfile.ZipInfo(f"{'' if key is None else key}.{n}.png"), encode_png((text.as_py() or "").encode("utf-8", "surrogatepass"), level))
                n += 1
        if zipped is not None:
            zipped.close()
            stream.close()
            store.move(name + ".part", name + ".zip")
            yield pa.RecordBatch.from_pydict({"archive": [name + ".zip"], "bytes": [outlet.at], "members": [n]})

    small_batches(docs.sparkSession)
    return materialise(docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, "archive string, bytes long, members long"), "media-list")


def directory(source, size: int) -> list[tuple[str, int, int, int]]:
    """(member, offset, stored bytes, crc32) from a ZIP archive's directory, ZIP64 included."""
    tail = min(size, 65_557)
    source.seek(size - tail)
    data = source.read(tail)
    at = data.rfind(b"PK\x05\x06")
    if at < 0:
        raise ValueError("no end of directory")
    count, length, start = struct.unpack("<HII", data[at + 10 : at + 20])
    if 0xFFFF == count or 0xFFFFFFFF in (length, start):
        locator = data.rfind(b"PK\x06\x07", 0, at)
        (end64,) = struct.unpack("<Q", data[locator + 8 : locator + 16])
        source.seek(end64)
        count, length, start = struct.unpack("<QQQ", source.read(56)[32:56])
    source.seek(start)
    data, at, out = source.read(length), 0, []
    while at < length:
        crc, packed, full, n, extra, comment = struct.unpack("<IIIHHH", data[at + 16 : at + 34])
        (offset,) = struct.unpack("<I", data[at + 42 : at + 46])
        name, more = data[at + 46 : at + 46 + n], data[at + 46 + n : at + 46 + n + extra]
        while len(more) >= 4:
            kind, width = struct.unpack("<HH", more[:4])
            if kind == 1:
                wide = iter(struct.unpack(f"<{width // 8}Q", more[4 : 4 + width // 8 * 8]))
                full = next(wide) if full == 0xFFFFFFFF else full
                packed = next(wide) if packed == 0xFFFFFFFF else packed
                offset = next(wide) if offset == 0xFFFFFFFF else offset
            more = more[4 + width :]
        out.append((name.decode("utf-8", "replace"), offset, packed, crc))
        at += 46 + n + extra + comment
    return out


def read_member(source, offset: int, length: int, crc: int, tries: int = 3, wait: float = 0.2) -> bytes:
    """A stored member's bytes; read again by its offset if that fails or the checksum is wrong."""
    for left in range(tries - 1, -1, -1):
        try:
            source.seek(offset)
            head = source.read(30)
            if head[:4] != b"PK\x03\x04":
                raise OSError(f"no member at {offset}")
            source.seek(offset + 30 + sum(struct.unpack("<HH", head[26:30])))
            data = source.read(length)
            if zlib.crc32(data) != crc:
                raise OSError(f"wrong checksum of the member at {offset}")
            return data
        except OSError:
            if not left:
                raise
            time.sleep(wait)
    raise AssertionError


class Span(InputPartition):
    def __init__(self, uri: str, size: int, lo: int, hi: int):
        self.uri, self.size, self.lo, self.hi = uri, size, lo, hi


class MediaScan(datasource.DataSourceReader):
    def __init__(self, options: dict, schema):
        self.options, self.names = options, schema.names

    def partitions(self) -> list[Span]:
        step, spans = int(self.options.get("range", RANGE)), []
        fs, root = filesystem(self.options["path"])
        prefix = self.options["path"][: -len(root)] if self.options["path"].endswith(root) else ""
        one = fs.get_file_info(root)
        for x in sorted(fs.get_file_info(pafs.FileSelector(root, recursive=True)) if one.type == pafs.FileType.Directory else [one], key=lambda x: x.path):
            if x.type == pafs.FileType.File and x.path.endswith(".zip") and x.size:
                spans += [Span(prefix + x.path, x.size, lo, min(lo + step, x.size)) for lo in range(0, x.size, step)]
        return spans or [Span("", 0, 0, 0)]

    def read(self, span: Span) -> Iterator[pa.RecordBatch]:
        full = pa.schema([("archive", pa.string()), ("member", pa.string()), ("offset", pa.int64()), ("media", pa.binary())])
        keep = pa.schema([full.field(n) for n in self.names])
        at = [full.get_field_index(n) for n in self.names]
        batch = lambda rows: pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in zip(at, keep, strict=True)], schema=keep)
        if not span.uri:
            return
        fs, path = filesystem(span.uri)
        rows, held, media = [], 0, "media" in self.names
        with fs.open_input_file(path) as source:
            for name, offset, length, crc in sorted(directory(source, span.size), key=lambda m: m[1]):
                if span.lo <= offset < span.hi:
                    rows.append((path, name, offset, read_member(source, offset, length, crc) if media else None))
                    held += 100 + length * media
                    if held >= BATCH:
                        yield batch(rows)
                        rows, held = [], 0
        if rows:
            yield batch(rows)


class MediaSource(DataSource):
    """format("media_zip"). Options: path (archive or folder), range (bytes a partition)."""

    @classmethod
    def name(cls) -> str:
        return "media_zip"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> MediaScan:
        return MediaScan(self.options, schema)


def read_media(spark: SparkSession, path: str) -> DataFrame:
    spark.dataSource.register(MediaSource)
    return spark.read.format("media_zip").load(path)


def media_features(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Store every text, read it back, and return doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature.

    A null or empty text is stored as one row of spaces; equal texts have equal values; rows with equal
    or null ids stay apart; an empty string as id comes back as null; no rows give none. Only doc_id and text are read. A member that cannot be read three times fails the job: a
    result without it would not be whole. The archives go to a new folder below `path`, where other files stay as they are; without a path they
    are scratch, and go once the rows are written.
    """
    spark = docs.sparkSession
    folder = f"{path.rstrip('/')}/archives-{uuid.uuid4().hex}" if path else scratch(spark, "media")
    listed = {r.archive for r in write_media(docs, folder).select("archive").toLocalIterator()}
    fs, root = filesystem(folder)
    for x in fs.get_file_info(pafs.FileSelector(root)):
        if x.path not in listed:  # of tasks that ran twice
            fs.delete_file(x.path)
    found = features_back(spark, folder, docs.schema["doc_id"].dataType)
    if path:
        return found
    found = materialise(found, "media-rows")
    delete(spark, folder)
    return found


def features_back(spark: SparkSession, folder: str, kind) -> DataFrame:
    """The rows of media_features from the archives in a folder."""

    def setup():
        def step(batch: pa.RecordBatch) -> dict:
            names = ("n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")
            out: dict = {"member": batch["member"]} | {n: [] for n in names}
            for m in batch["media"]:
                media = m.as_py()
                payload, n = decode_png(media)
                row = (n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(media), hashlib.sha256(media).hexdigest(), feature(payload))
                for k, v in zip(names, row, strict=True):
                    out[k].append(v)
            return out

        return step

    found = map_batches(read_media(spark, folder), "member string, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string", setup)
    doc_id = F.nullif(F.regexp_extract("member", r"(?s)^(.*)\.\d+\.png$", 1), F.lit("")).cast(kind).alias("doc_id")
    return found.select(doc_id, *[c for c in found.columns if c != "member"])
