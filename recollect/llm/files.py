"""Files of Python data sources on any store: rolled outputs, manifests written on commit, ranged reads.

Each committed write adds one manifest, which lists its files; a folder holds what its manifests
list together. An overwrite's manifest names the manifests it replaces, so it takes effect by the
one file it writes; the old files are deleted afterwards.
"""

from __future__ import annotations

import json
import struct
import time
import uuid
import zipfile
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import TypeVar

import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import WriterCommitMessage

MANIFEST = "_manifest-"
#: A writer task begins a new file once the current one has so many bytes.
ROLL_BYTES = 64 << 20
#: What a damaged or short read shows up as; such reads are repeated.
DAMAGE = (OSError, ValueError, EOFError, struct.error, zlib.error, zipfile.BadZipFile)
X = TypeVar("X")


def located(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if "://" in uri else uri.replace("file:", "file://", 1) if uri.startswith("file:") else f"file://{uri}")


@dataclass
class Written(WriterCommitMessage):
    """Files of one task attempt: name, bytes, and whatever its format adds."""

    files: list[list]


def _manifests(store: fs.FileSystem, path: str) -> dict[str, dict]:
    """Manifests in force by name: those that no other one replaces."""
    found = store.get_file_info(fs.FileSelector(path, allow_not_found=True))
    all_of = {}
    for x in found:
        if x.is_file and x.base_name.startswith(MANIFEST):
            with store.open_input_file(x.path) as f:
                all_of[x.base_name] = json.loads(f.read())
    gone = {name for m in all_of.values() for name in m["replaces"]}
    return {name: m for name, m in all_of.items() if name not in gone}


def commit(uri: str, messages: list[Written | None], overwrite: bool = False) -> None:
    """List the files of the attempts that succeeded, beside those of earlier writes or in their place."""
    store, path = located(uri)
    store.create_dir(path, recursive=True)
    old = _manifests(store, path) if overwrite else {}
    files = sorted(f for m in messages if m for f in m.files)
    with store.open_output_stream(f"{path}/{MANIFEST}{uuid.uuid4().hex}.json") as out:
        out.write(json.dumps({"files": files, "replaces": sorted(old)}).encode())
    for name, *_ in (f for m in old.values() for f in m["files"]):
        store.delete_file(f"{path}/{name}")


def abort(uri: str, messages: list[Written | None]) -> None:
    store, path = located(uri)
    for m in messages:
        for name, *_ in m.files if m else []:
            store.delete_file(f"{path}/{name}")


def listed(uri: str, suffix: str) -> list[list]:
    """(name, bytes) of each committed file; without a manifest, of each file with the suffix."""
    store, path = located(uri)
    manifests = _manifests(store, path)
    if manifests:
        return sorted(f for m in manifests.values() for f in m["files"])
    found = store.get_file_info(fs.FileSelector(path, allow_not_found=True))
    return sorted([x.base_name, x.size] for x in found if x.is_file and x.base_name.endswith(suffix))


def delete(spark, uri: str) -> None:
    """Remove a folder of archives or tables that no plan reads any more, on whatever store it is."""
    path = spark._jvm.org.apache.hadoop.fs.Path(uri)
    path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


class Rolled:
    """Output files of one task attempt. Names are unique, so attempts never meet."""

    def __init__(self, uri: str, suffix: str, limit: int = ROLL_BYTES):
        self.store, self.path = located(uri)
        self.store.create_dir(self.path, recursive=True)
        self.suffix, self.limit, self.files, self.out = suffix, limit, [], None

    def stream(self) -> pa.NativeFile:
        if self.out is None:
            self.name = f"part-{uuid.uuid4().hex}{self.suffix}"
            self.out = self.store.open_output_stream(f"{self.path}/{self.name}", compression=None)
        return self.out

    def full(self) -> bool:
        return self.out is not None and self.out.tell() >= self.limit

    def close(self) -> None:
        if self.out is not None:
            self.files.append([self.name, self.out.tell()])
            self.out.close()
            self.out = None


class Ranged:
    """Reads by offset with a readahead window; each read is repeated by itself if it fails or is short."""

    def __init__(self, store: fs.FileSystem, path: str, ahead: int = 4 << 20, tries: int = 4, wait: float = 0.1):
        self.store, self.path, self.ahead, self.tries, self.wait = store, path, ahead, tries, wait
        self.file, self.at, self.held = None, 0, b""
        self.size = self.again(lambda: store.get_file_info(path).size)

    def _fetch(self, at: int, n: int) -> bytes:
        if self.file is None:
            self.file = self.store.open_input_file(self.path)
        data = self.file.read_at(min(max(n, self.ahead), self.size - at), at)
        if len(data) < n:
            raise EOFError(f"{self.path}: {len(data)} of {n} bytes at {at}")
        return data

    def again(self, read: Callable[[], X]) -> X:
        """read(), repeated after a failure with the file opened anew."""
        for k in range(self.tries):
            try:
                return read()
            except DAMAGE:
                self.file, self.held = None, b""
                if k + 1 == self.tries:
                    raise
                time.sleep(self.wait * 2**k)
        raise AssertionError("unreachable")

    def get(self, at: int, n: int) -> bytes:
        """Exactly n bytes from `at` on; EOFError if the file has not so many."""
        if not self.at <= at <= at + n <= self.at + len(self.held):
            self.held = self.again(lambda: self._fetch(at, n))
            self.at = at
        return self.held[at - self.at : at - self.at + n]


def batched(rows: Iterator[tuple[int, tuple]], schema: pa.Schema, limit: int = 8 << 20, most: int = 2000) -> Iterator[pa.RecordBatch]:
    """Record batches of (bytes, row) pairs, bounded in bytes and rows."""
    held, size = [], 0
    for n, row in rows:
        held.append(row)
        size += n
        if size >= limit or len(held) >= most:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)
