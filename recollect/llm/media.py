"""Media columns kept in ZIP archives, read by byte range.

A payload is stored losslessly as an 8-bit grey PNG, 576 samples a row, as one stored
(uncompressed) member of a ZIP archive. Two data source halves serve it:

* the writer streams Arrow batches into archives of bounded size, a task attempt into files of
  its own, and lists them in a manifest on commit (appends add up, overwrites replace);
* the reader plans byte ranges over the archives: a partition is (archive, from, to) and owns the
  members whose local header begins there. It finds them in the archive's own central directory,
  so that the driver never holds member lists. An archive that the writer made is one partition,
  so its directory is read once; a larger foreign one is cut into SPANS partitions at most, which
  bounds how often its directory is read. Each member is fetched by offset, checked against its
  CRC and, if that fails or is cut short, fetched again by itself, without disturbing its
  neighbours; the directory likewise.

Defined results: a null or empty text is a payload of 576 bytes of 255; equal texts give equal
media; repeated ids give repeated members; ids of any type that casts to text and back are kept,
a null id as null.
"""

from __future__ import annotations

import hashlib
import io
import struct
import warnings
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition

from recollect.llm.common import blocks, scratch
from recollect.llm.files import ROLL_BYTES, Ranged, Rolled, Written, abort, batched, commit, listed, located

#: Samples a row; payloads are padded to a multiple of it (fixed values).
ROW, PAD = 576, 255
#: Most partitions of one archive.
SPANS = 32
PNG = b"\x89PNG\r\n\x1a\n"


def padded(text: bytes) -> bytes:
    return text + bytes([PAD]) * ((-len(text)) % ROW or (0 if text else ROW))


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def to_png(payload: bytes, level: int = 1) -> bytes:
    rows = np.frombuffer(payload, np.uint8).reshape(-1, ROW)
    lines = np.zeros((len(rows), ROW + 1), np.uint8)  # filter type 0 before each line
    lines[:, 1:] = rows
    head = struct.pack(">IIBBBBB", ROW, len(rows), 8, 0, 0, 0, 0)
    return PNG + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), level)) + _chunk(b"IEND", b"")


def from_png(media: bytes) -> bytes:
    """The samples of a grey 8-bit PNG whose lines are unfiltered; anything else is an error."""
    if media[:8] != PNG:
        raise ValueError("not a PNG")
    at, data = 8, []
    while at < len(media):
        n, kind = struct.unpack_from(">I4s", media, at)
        body = media[at + 8 : at + 8 + n]
        if zlib.crc32(kind + body) != struct.unpack_from(">I", media, at + 8 + n)[0]:
            raise ValueError("a PNG chunk is damaged")
        if kind == b"IHDR":
            width, height, depth, colour = struct.unpack_from(">IIBB", body)
        elif kind == b"IDAT":
            data.append(body)
        at += 12 + n
    lines = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(height, width + 1)
    if (depth, colour) != (8, 0) or lines[:, 0].any():
        raise ValueError("not a plain grey PNG")
    return lines[:, 1:].tobytes()


def feature(payload: bytes) -> str:
    """Size, mean and spread of the samples, and which of 64 equal stretches are brighter than all."""
    x = np.frombuffer(payload, np.uint8)
    counts = np.bincount(x, minlength=256)
    levels = np.arange(256)
    total, squares = int(counts @ levels), int(counts @ (levels * levels))
    stretch = x.reshape(64, -1).sum(axis=1, dtype=np.int64)
    bits = np.packbits(stretch * 64 > total).tobytes().hex()
    mean = total / len(x)
    return f"{ROW}x{len(x) // ROW} mean={mean:.4f} sd={max(0.0, squares / len(x) - mean * mean) ** 0.5:.4f} hash={bits}"


class ArchiveWriter(DataSourceArrowWriter):
    def __init__(self, options: dict, overwrite: bool = False):
        self.uri, self.roll, self.overwrite = options["path"], int(options.get("roll_bytes", ROLL_BYTES)), overwrite

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        out, archive = Rolled(self.uri, ".zip", self.roll), None
        warnings.simplefilter("ignore", UserWarning)  # repeated ids
        for batch in iterator:
            for name, media in zip(batch.column("member"), batch.column("media"), strict=True):
                if archive is None:
                    archive = zipfile.ZipFile(_Stream(out.stream()), "w", zipfile.ZIP_STORED)
                archive.writestr(zipfile.ZipInfo(name.as_py()), media.as_py())
                if out.full():
                    archive.close()
                    out.close()
                    archive = None
        if archive is not None:
            archive.close()
        out.close()
        return Written(out.files)

    def commit(self, messages: list) -> None:
        commit(self.uri, messages, self.overwrite)

    def abort(self, messages: list) -> None:
        abort(self.uri, messages)


class _Stream(io.RawIOBase):
    """What zipfile needs of an output that can't seek."""

    def __init__(self, out: pa.NativeFile):
        self.out = out

    def writable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return False

    def write(self, data) -> int:
        self.out.write(data)
        return len(data)


class _Source(io.RawIOBase):
    """A seekable view of a ranged file, for zipfile's reading of the central directory."""

    def __init__(self, f: Ranged):
        self.f, self.at = f, 0

    def readable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return True

    def tell(self) -> int:
        return self.at

    def seek(self, at: int, whence: int = 0) -> int:
        self.at = at + (0, self.at, self.f.size)[whence]
        return self.at

    def read(self, n: int = -1) -> bytes:
        n = min(self.f.size - self.at, n if n >= 0 else self.f.size)
        data = self.f.get(self.at, n) if n > 0 else b""
        self.at += len(data)
        return data


@dataclass
class Span(InputPartition):
    """Members of an archive whose local header lies in [start, end)."""

    name: str
    start: int
    end: int


class ArchiveReader(DataSourceReader):
    SCHEMA = pa.schema([("archive", pa.string()), ("member", pa.string()), ("header_offset", pa.int64()), ("media", pa.binary())])

    def __init__(self, options: dict):
        self.uri, self.span = options["path"], int(options.get("partition_bytes", 2 * ROLL_BYTES))
        self.tries = int(options.get("tries", 4))

    def partitions(self) -> list[Span]:
        spans = []
        for name, size, *_ in listed(self.uri, ".zip"):
            step = max(self.span, -(-size // SPANS))
            spans += [Span(name, at, at + step) for at in range(0, size, step)]
        return spans or [Span("", 0, 0)]

    def read(self, partition: Span) -> Iterator[pa.RecordBatch]:
        return batched(self.members(partition), self.SCHEMA)

    def members(self, span: Span) -> Iterator[tuple[int, tuple]]:
        if not span.name:
            return
        store, path = located(self.uri)
        f = Ranged(store, f"{path}/{span.name}", tries=self.tries)
        for info in f.again(lambda: self.directory(f, span)):
            media = f.again(lambda info=info: self.member(f, info))
            yield len(media), (span.name, info.filename, info.header_offset, media)

    @staticmethod
    def directory(f: Ranged, span: Span) -> list[zipfile.ZipInfo]:
        """The span's members by offset, from the central directory."""
        with zipfile.ZipFile(_Source(f)) as z:
            return sorted((x for x in z.infolist() if span.start <= x.header_offset < span.end), key=lambda x: x.header_offset)

    @staticmethod
    def member(f: Ranged, info: zipfile.ZipInfo) -> bytes:
        """One stored member, from its local header on; raises ValueError if it is damaged."""
        head = f.get(info.header_offset, 30)
        if head[:4] != b"PK\x03\x04" or info.compress_type != zipfile.ZIP_STORED:
            raise ValueError(f"{f.path}: no stored member at {info.header_offset}")
        names, extra = struct.unpack_from("<HH", head, 26)
        media = f.get(info.header_offset + 30 + names + extra, info.file_size)
        if zlib.crc32(media) != info.CRC:
            raise ValueError(f"{f.path}: the member at {info.header_offset} is damaged")
        return media


class MediaArchive(DataSource):
    @classmethod
    def name(cls) -> str:
        return "media_archive"

    def schema(self) -> str:
        return "archive string, member string, header_offset long, media binary"

    def reader(self, schema: T.StructType) -> ArchiveReader:
        return ArchiveReader(dict(self.options))

    def writer(self, schema: T.StructType, overwrite: bool) -> ArchiveWriter:
        return ArchiveWriter(dict(self.options), overwrite)


def write_media(docs: DataFrame, path: str, ident: str = "doc_id", text: str = "text", mode: str = "append") -> None:
    """Store each text as a PNG named by its id in archives under path: beside what is there, or instead of it."""
    docs.sparkSession.dataSource.register(MediaArchive)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches, "t"):
            media = [to_png(padded((t or "").encode())) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(media, pa.binary())], names=["member", "media"])

    source = docs.select(_member(docs[ident]).alias("member"), docs[text].alias("t"))
    source.mapInArrow(encode, "member string, media binary").write.format("media_archive").mode(mode).save(path)


def _member(ident: Column) -> Column:
    """A member's name; ids are percent-encoded, and a null id has a name that no id has."""
    return F.coalesce(F.concat(F.lit("id-"), F.url_encode(ident.cast("string")), F.lit(".png")), F.lit("null.png"))


def _ident(member: Column) -> Column:
    return F.when(member != "null.png", F.url_decode(F.regexp_extract(member, r"^id-(.*)\.png$", 1)))


def read_media(spark: SparkSession, path: str) -> DataFrame:
    spark.dataSource.register(MediaArchive)
    return spark.read.format("media_archive").load(path)


RESULT = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def described(media: DataFrame) -> DataFrame:
    """member and what RESULT lists for each media value: all from the stored bytes."""

    kinds = {"long": pa.int64(), "string": pa.string()}
    schema = pa.schema([("member", pa.string()), *((n, kinds[k]) for n, k in (x.split() for x in RESULT.split(", ")))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for name, m in zip(b.column(0), b.column(1), strict=True):
                m = m.as_py()
                p = from_png(m)
                rows.append((name.as_py(), len(p.rstrip(bytes([PAD]))), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]), len(m), hashlib.sha256(m).hexdigest(), feature(p)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

    return media.select("member", "media").mapInArrow(run, f"member string, {RESULT}")


def media_features(docs: DataFrame, ident: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """Write all texts as media under path, read the archives back, and describe each.

    The result reads the archives lazily; a caller who names the path removes them by files.delete.
    """
    path = path or scratch(docs.sparkSession, "media")
    write_media(docs, path, ident, text)
    back = described(read_media(docs.sparkSession, path))
    return back.select(_ident(F.col("member")).try_cast(docs.schema[ident].dataType).alias(ident), *T._parse_datatype_string(RESULT).names)
