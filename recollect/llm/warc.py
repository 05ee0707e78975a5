"""WARC archives as a Spark data source.

Format: one gzip member per record, each with an extra field `sl` that holds the member's
compressed and plain length. A reader inflates a member only as far as the record's headers end,
tests them against the pushed predicates, and seeks past a payload that nobody wants. Members
without that field (foreign archives) are inflated to their end, which is where the next begins;
they may hold any number of records, but a record lies in one member.

A partition is a byte range of a file and owns the members that begin there. Within a file they
are found by their magic number and by what they inflate to, so that large files are split without
an index. What is read is checked: a member inflated to its end against its CRC and length, and a
record against its Content-Length. Members with `sl` are read again by themselves if a check
fails; of others each ranged read is, and the member up to its first record.

Writing is a Python data source too: each task attempt writes files of its own, and the commit
lists those of successful attempts in a manifest, so lost executors leave no half-read files;
appends add up, overwrites replace.

Rows: record_id, record_type, target_uri, warc_date, payload_digest, refers_to, payload_bytes
(all from headers), headers (all of them, as they are written; repeated ones joined by a comma),
payload (binary; null when read with payload=false or for records without one). Header names are
matched whatever their case.
Defined results: null texts become empty payloads; a null id is written as `null` and read back
as null; rows that share the smallest id of a payload are all responses; control characters in
header values are percent-encoded, so no value can end a header early.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, EqualNullSafe, EqualTo, Filter, In, InputPartition, IsNotNull, IsNull, StringContains, StringEndsWith, StringStartsWith,
)

from recollect.llm.common import scratch, stored
from recollect.llm.files import ROLL_BYTES, Ranged, Rolled, Written, abort, batched, commit, listed, located

SCHEMA = "record_id string, record_type string, target_uri string, warc_date string, payload_digest string, refers_to string, payload_bytes long, headers map<string,string>, payload binary"
_ARROW = pa.schema([*((n, pa.string()) for n in ("record_id", "record_type", "target_uri", "warc_date", "payload_digest", "refers_to")), ("payload_bytes", pa.int64()), ("headers", pa.map_(pa.string(), pa.string())), ("payload", pa.binary())])
#: Column -> header it stands for (fixed values of the format).
HEADER = {"record_id": "WARC-Record-ID", "record_type": "WARC-Type", "target_uri": "WARC-Target-URI", "warc_date": "WARC-Date", "payload_digest": "WARC-Payload-Digest", "refers_to": "WARC-Refers-To"}
LENGTH_HEADER = "X-Payload-Length"
PUSHDOWN = "spark.sql.python.filterPushdown.enabled"
#: Types of records whose payload is the whole block (fixed values).
WHOLE = {"resource", "conversion"}
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"
_SL = struct.Struct("<2sHII")


def member(record: bytes, level: int) -> bytes:
    """One gzip member with skip lengths; those over 4 GiB are left out."""
    packer = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = packer.compress(record) + packer.flush()
    size = 10 + 2 + _SL.size + len(body) + 8
    extra = _SL.pack(b"sl", 8, size, len(record)) if max(size, len(record)) < 1 << 32 else b""
    return b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H", len(extra)) + extra + body + struct.pack("<II", zlib.crc32(record), len(record) & 0xFFFFFFFF)


def _safe(value: str) -> str:
    return "".join(f"%{ord(c):02X}" if ord(c) < 32 or ord(c) == 127 else c for c in value) if not value.isprintable() else value


def record(row: dict) -> bytes:
    block = b"" if row["payload"] is None else HTTP_HEAD % len(row["payload"]) + row["payload"]
    lines = ["WARC/1.1"]
    lines += [f"{h}: {_safe(row[c])}" for c, h in HEADER.items() if row.get(c) is not None]
    if row.get("payload_bytes") is not None:
        lines.append(f"{LENGTH_HEADER}: {row['payload_bytes']}")
    lines.append(f"WARC-Profile: {REVISIT_PROFILE}" if row["record_type"] == "revisit" else "Content-Type: application/http; msgtype=response")
    lines.append(f"Content-Length: {len(block)}")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, options: dict, overwrite: bool = False):
        self.uri, self.level, self.overwrite = options["path"], int(options.get("level", 4)), overwrite
        self.roll = int(options.get("roll_bytes", ROLL_BYTES))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        out = Rolled(self.uri, ".warc.gz", self.roll)
        for batch in iterator:
            for values in zip(*batch.columns, strict=True):
                row = {name: v.as_py() for name, v in zip(batch.schema.names, values, strict=True)}
                out.stream().write(member(record(row), self.level))
                if out.full():
                    out.close()
        out.close()
        return Written(out.files)

    def commit(self, messages: list) -> None:
        commit(self.uri, messages, self.overwrite)

    def abort(self, messages: list) -> None:
        abort(self.uri, messages)


@dataclass
class Spans(InputPartition):
    """Ranges (file, from, to); each owns the members that begin in it."""

    ranges: list[tuple[str, int, int]]


def _test(f: Filter):
    """A test of a record's columns for a pushed filter, or None if it can't be pushed."""
    path = getattr(f, "attribute", None)
    if path is None or len(path) != 1 or path[0] not in HEADER:
        return None
    name = path[0]
    if isinstance(f, EqualTo | EqualNullSafe):
        return lambda r: r.get(name) == f.value
    if isinstance(f, In):
        return lambda r: r.get(name) in f.value
    if isinstance(f, IsNull):
        return lambda r: r.get(name) is None
    if isinstance(f, IsNotNull):
        return lambda r: r.get(name) is not None
    for kind, test in ((StringStartsWith, str.startswith), (StringEndsWith, str.endswith), (StringContains, str.__contains__)):
        if isinstance(f, kind):
            return lambda r, test=test: r.get(name) is not None and test(r[name], f.value)
    return None


class WarcReader(DataSourceReader):
    def __init__(self, options: dict):
        self.uri = options["path"]
        self.payload = options.get("payload", "true").lower() == "true"
        self.pack = int(options.get("partition_bytes", ROLL_BYTES))
        self.filters: list[Filter] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if _test(f) is None:
                yield f
            else:
                self.filters.append(f)

    def partitions(self) -> list[Spans]:
        """Ranges of at most partition_bytes; those of small files are packed together up to that."""
        parts, size = [], self.pack
        for name, n, *_ in listed(self.uri, ".warc.gz"):
            for at in range(0, n, self.pack):
                span = (name, at, min(at + self.pack, n))
                if size + span[2] - at > self.pack:
                    parts.append(Spans([]))
                    size = 0
                parts[-1].ranges.append(span)
                size += span[2] - at
        return parts or [Spans([])]

    def read(self, partition: Spans) -> Iterator[pa.RecordBatch]:
        store, path = located(self.uri)
        tests = [_test(f) for f in self.filters]
        return batched((row for name, start, end in partition.ranges for row in self.records(Ranged(store, f"{path}/{name}"), tests, start, end)), _ARROW)

    def records(self, f: Ranged, tests: list, start: int = 0, end: int | None = None) -> Iterator[tuple[int, tuple]]:
        """(bytes, row) of the records whose member begins in [start, end) and that pass all tests."""
        end = f.size if end is None else end
        at = begins(f, start, end) if start else start
        while at is not None and at < end:
            m, rows, rest = f.again(lambda at=at: self.begun(f, at, tests))
            yield from rows
            yield from rest
            at = m.finished() if m.head.size is None else at + m.head.size

    def begun(self, f: Ranged, at: int, tests: list) -> tuple[Member, list, Iterator]:
        """The member at `at`, its rows (of one without `sl`, which may be long, the first), and what is left of them."""
        head = gzip_head(f, at)
        m = Member(f, head, f.size if head.size is None else at + head.size)
        rows = self.of(m, tests)
        return m, list(rows if head.size is not None else islice(rows, 1)), rows

    def of(self, m: Member, tests: list) -> Iterator[tuple[int, tuple]]:
        """The wanted records of one member."""
        while (lines := m.headers()) is not None:
            headers: dict[str, str] = {}
            for line in lines[1:]:
                name, _, value = line.partition(":")
                name, value = name.strip(), value.strip(" \t")
                headers[name] = f"{headers[name]}, {value}" if name in headers else value
            folded = {k.lower(): v for k, v in headers.items()}
            if not lines[0].startswith("WARC/") or not folded.get("content-length", "").isdigit():
                raise ValueError(f"{m.f.path}: no WARC record in the member at {m.head.at}")
            row, length = {c: folded.get(h.lower()) for c, h in HEADER.items()}, int(folded["content-length"])
            wanted, http = all(t(row) for t in tests), folded.get("content-type", "").lower().startswith("application/http")
            block = None
            if wanted and self.payload and (http or row["record_type"] in WHOLE):
                block = m.read(length)
            elif m.head.plain is not None and m.at + length + 4 >= m.head.plain:
                m.skipped = True  # the member's last record; nobody wants the rest
            else:
                m.skip(length)
            if wanted:
                payload = block if block is None or not http else block.partition(b"\r\n\r\n")[2]
                n = folded.get(LENGTH_HEADER.lower())
                yield len(payload or b"") + 500, (*row.values(), int(n) if n is not None else None, list(headers.items()), payload)
            if m.skipped:
                return
        m.finished()


@dataclass
class Head:
    """A gzip member: where it and its deflated data begin; its packed and plain length if it tells."""

    at: int
    body: int
    size: int | None = None
    plain: int | None = None


def gzip_head(f: Ranged, at: int) -> Head:
    magic, flags = f.get(at, 3), f.get(at + 3, 1)[0]
    if magic != b"\x1f\x8b\x08" or flags & 0xE0:
        raise ValueError(f"{f.path}: no gzip member at {at}")
    head = Head(at, at + 10)
    if flags & 4:
        n = struct.unpack("<H", f.get(at + 10, 2))[0]
        extra, k = f.get(at + 12, n), 0
        while k + 4 <= n:  # subfields: name, length, data
            if extra[k : k + 2] == b"sl" and k + _SL.size <= n:
                head.size, head.plain = _SL.unpack_from(extra, k)[2:]
            k += 4 + struct.unpack_from("<H", extra, k + 2)[0]
        head.body += 2 + n
    for flag in (8, 16):  # a name, a comment
        if flags & flag:
            while f.get(head.body, 1) != b"\0":
                head.body += 1
            head.body += 1
    head.body += 2 * bool(flags & 2)
    return head


def begins(f: Ranged, start: int, end: int) -> int | None:
    """Where the first member at or behind start begins, or None if none does before end."""
    at, step = start, 1 << 20
    while at < end:
        window = f.get(at, min(step + 2, f.size - at))
        k = window.find(b"\x1f\x8b\x08")
        while 0 <= k < step and at + k < end:
            try:
                head = gzip_head(f, at + k)
                if zlib.decompressobj(-15).decompress(f.get(head.body, min(4096, f.size - head.body)), 16).lstrip().startswith(b"WARC/"):
                    return at + k
            except (ValueError, EOFError, zlib.error):
                pass  # these three bytes just happen to stand there
            k = window.find(b"\x1f\x8b\x08", k + 1)
        at += step
    return None


class Member:
    """The plain bytes of one gzip member, in order."""

    STEP = 64 << 10

    def __init__(self, f: Ranged, head: Head, limit: int):
        self.f, self.head, self.limit, self.pos = f, head, limit, head.body
        self.inflate, self.held, self.packed = zlib.decompressobj(-15), bytearray(), b""
        self.at, self.length, self.crc, self.skipped = 0, 0, 0, False

    def more(self, most: int) -> bool:
        """Hold more plain bytes; False at the end of the member."""
        while not self.inflate.eof:
            if not self.packed:
                n = min(self.STEP, self.limit - self.pos)
                if n <= 0:
                    raise EOFError(f"{self.f.path}: the member at {self.head.at} is cut off")
                self.packed = self.f.get(self.pos, n)
                self.pos += n
            plain = self.inflate.decompress(self.packed, most)
            self.packed = self.inflate.unconsumed_tail
            if plain:
                self.crc, self.length = zlib.crc32(plain, self.crc), self.length + len(plain)
                self.held += plain
                return True
        return False

    def read(self, n: int) -> bytes:
        while len(self.held) < n:
            if not self.more(max(4096, n - len(self.held))):
                raise EOFError(f"{self.f.path}: a record of the member at {self.head.at} is cut off")
        out = bytes(self.held[:n])
        del self.held[:n]
        self.at += n
        return out

    def skip(self, n: int) -> None:
        while n > 0:
            n -= len(self.read(min(n, self.STEP)))

    def headers(self) -> list[str] | None:
        """Lines of the next record up to the empty one; None if there is no more record."""
        while True:
            blank = len(self.held) - len(self.held.lstrip(b"\r\n"))
            if blank:
                self.read(blank)
            if self.held:
                break
            if not self.more(4096):
                return None
        while (end := self.held.find(b"\r\n\r\n")) < 0:
            if not self.more(4096):
                raise EOFError(f"{self.f.path}: headers in the member at {self.head.at} are cut off")
        lines = self.read(end + 4)[:-4].decode("utf-8", "replace")
        return lines.replace("\r\n ", " ").replace("\r\n\t", " ").split("\r\n")

    def finished(self) -> int:
        """Check the member against its CRC and length; where the next one begins."""
        while self.more(self.STEP):
            self.held.clear()
        end = self.pos - len(self.inflate.unused_data)
        if struct.unpack("<II", self.f.get(end, 8)) != (self.crc, self.length & 0xFFFFFFFF):
            raise ValueError(f"{self.f.path}: the member at {self.head.at} is damaged")
        return end + 8


class WarcDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: T.StructType) -> WarcReader:
        return WarcReader(dict(self.options))

    def writer(self, schema: T.StructType, overwrite: bool) -> WarcWriter:
        return WarcWriter(dict(self.options), overwrite)


def base32_sha1(payload: Column) -> Column:
    """Bare upper-case base32 SHA-1: each 5 hex digits are 4 base-32 digits, in another alphabet."""
    digest = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(digest, 1 + 5 * k, 5), 16, 32), 4, "0") for k in range(8)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def with_revisits(pages: DataFrame, min_revisit_bytes: int = 0) -> DataFrame:
    """Columns id, url, payload -> plus payload_bytes, payload_digest and refers_to (null: a response).

    Only digests that occur twice reach the join. Their table is written first, so that its true
    size decides between a broadcast and a sort-merge join, whose skewed partitions AQE splits.
    """
    sized = pages.withColumns({"payload_bytes": F.octet_length("payload").cast("long"), "payload_digest": base32_sha1(F.col("payload"))})
    shared = sized.filter(F.col("payload_bytes") >= min_revisit_bytes).groupBy("payload_digest", "payload_bytes").agg(F.min("id").alias("first_id"), F.count("*").alias("n")).filter("n > 1").drop("n")
    joined = sized.join(stored(shared, "warc-shared"), ["payload_digest", "payload_bytes"], "left")
    return joined.withColumn("refers_to", F.when(~F.col("id").eqNullSafe(F.col("first_id")), F.col("first_id"))).drop("first_id")


def write_warc(pages: DataFrame, path: str, date: str = "2024-01-01T00:00:00Z", min_revisit_bytes: int = 0, mode: str = "append") -> None:
    """Write pages (id, url, payload) as WARC records, repeated payloads as revisits."""
    pages.sparkSession.dataSource.register(WarcDataSource)
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("null")), F.lit(">"))
    df = with_revisits(pages, min_revisit_bytes)
    revisit = F.col("refers_to").isNotNull()
    df.select(
        urn(F.col("id")).alias("record_id"), F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.col("url").alias("target_uri"), F.lit(date).alias("warc_date"),
        F.concat(F.lit("sha1:"), "payload_digest").alias("payload_digest"), F.when(revisit, urn(F.col("refers_to"))).alias("refers_to"), "payload_bytes",
        F.lit(None).cast("map<string,string>").alias("headers"), F.when(~revisit, F.col("payload")).alias("payload"),
    ).write.format("warc").mode(mode).save(path)


def read_warc(spark, path: str, payload: bool = True) -> DataFrame:
    """Records of the archives in a folder; filters on header columns are pushed into the reader.

    Spark looks at its switch for that when a query is planned, which is later, so it stays on.
    """
    if spark.conf.get(PUSHDOWN, "false").lower() != "true":
        spark.conf.set(PUSHDOWN, "true")
    spark.dataSource.register(WarcDataSource)
    return spark.read.format("warc").option("payload", str(payload).lower()).load(path)


def archived_pages(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", min_revisit_bytes: int = 0, path: str | None = None) -> DataFrame:
    """Write the pages as WARC under path, read the archives back, and report each record.

    The result reads the archives lazily; a caller who names the path removes them by files.delete.
    The digest of a response is computed from the payload read back; one that differs from its
    header fails the job.
    """
    spark = pages.sparkSession
    path = path or scratch(spark, "warc")
    source = pages.select(pages[page_id].alias("id"), pages[url].alias("url"), F.coalesce(pages[html], F.lit("")).cast("binary").alias("payload"))
    write_warc(source, path, min_revisit_bytes=min_revisit_bytes)
    kind = dict(source.dtypes)["id"]
    ident = lambda c: F.regexp_extract(c, "^<urn:page:(.*)>$", 1).try_cast(kind)
    back = read_warc(spark, path)
    held = F.concat(F.lit("sha1:"), base32_sha1(F.col("payload")))
    bad = (F.col("record_type") == "response") & ~(held.eqNullSafe(F.col("payload_digest")) & F.octet_length("payload").cast("long").eqNullSafe(F.col("payload_bytes")))
    return back.select(
        ident(F.col("record_id")).alias("page_id"), "payload_bytes",
        F.when(bad, F.raise_error(F.concat(F.lit("payload differs from its digest: "), "record_id"))).otherwise(F.substring("payload_digest", 6, 32)).alias("payload_digest"),
        "record_type", F.when(F.col("refers_to").isNotNull(), ident(F.col("refers_to"))).alias("refers_to"),
    )
