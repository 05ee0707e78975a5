import hashlib
import zlib

import pytest

from recollect.llm import media
from recollect.llm.files import Ranged, located
from tests.llm.helpers import clashing, table


def png(payload):
    """The stored form, by the PNG standard: grey, 8 bits, lines of 576 without filter."""
    lines = b"".join(b"\0" + payload[k : k + 576] for k in range(0, len(payload), 576))
    chunk = lambda kind, data: len(data).to_bytes(4, "big") + kind + data + zlib.crc32(kind + data).to_bytes(4, "big")
    head = (576).to_bytes(4, "big") + (len(payload) // 576).to_bytes(4, "big") + bytes([8, 0, 0, 0, 0])
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(lines, 1)) + chunk(b"IEND", b"")


def described(payload):
    n = len(payload)
    mean = sum(payload) / n
    sd = max(0.0, sum(x * x for x in payload) / n - mean * mean) ** 0.5
    bits = [int(64 * sum(payload[k * n // 64 : (k + 1) * n // 64]) > sum(payload)) for k in range(64)]
    return f"576x{n // 576} mean={mean:.4f} sd={sd:.4f} hash={int(''.join(map(str, bits)), 2):016x}"


def test_round_trip(spark):
    docs = clashing(spark)
    got = media.media_features(docs).collect()
    want = sorted((r.doc_id if r.doc_id is not None else -1, (r.text or "").encode()) for r in docs.collect())
    assert len(got) == len(want)
    for r, (i, t) in zip(sorted(got, key=lambda r: (r.doc_id if r.doc_id is not None else -1)), want, strict=True):
        p = t + b"\xff" * (-len(t) % 576) or b"\xff" * 576
        assert (-1 if r.doc_id is None else r.doc_id) == i
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(t), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]))
        m = png(p)
        assert (r.media_bytes, r.media_sha256, r.feature) == (len(m), hashlib.sha256(m).hexdigest(), described(p))


def test_png_is_a_png():
    m = media.to_png(media.padded(b"abc"))
    assert m[:8] == media.PNG and media.from_png(m) == b"abc" + b"\xff" * 573
    with pytest.raises(ValueError):
        media.from_png(m[:60] + b"\0" + m[61:])


def test_empty_table(spark):
    assert media.media_features(table(spark, [])).count() == 0


def test_ranges_own_each_member_once(spark, tmp_path):
    path = f"file://{tmp_path}/a"
    docs = spark.range(200).selectExpr("id as doc_id", "repeat(cast(id as string), 300) as text").repartition(2)
    media.write_media(docs, path)
    r = media.ArchiveReader({"path": path, "partition_bytes": "3000"})
    parts = r.partitions()
    names = [row[1] for p in parts for _, row in r.members(p)]
    assert len(parts) > 10 and sorted(names) == sorted(f"id-{i}.png" for i in range(200))
    archives = media.ArchiveReader({"path": path}).partitions()
    assert len(archives) == len({p.name for p in archives})  # one each, so a directory is read once


def test_a_member_is_fetched_again_alone(spark, tmp_path):
    path = f"file://{tmp_path}/a"
    media.write_media(spark.range(3).selectExpr("id as doc_id", "'x' as text").coalesce(1), path)
    r = media.ArchiveReader({"path": path})
    fetch, failed = Ranged._fetch, []

    def flaky(self, at, n):
        data = fetch(self, at, n)
        if len(failed) < 2:
            failed.append(at)
            return b"\0" * len(data) if failed else data
        return data

    store, base = located(path)
    f = Ranged(store, f"{base}/{r.partitions()[0].name}")
    import zipfile

    with zipfile.ZipFile(media._Source(f)) as z:
        info = z.infolist()[1]
    Ranged._fetch = flaky
    try:
        f.held = b""
        assert media.from_png(f.again(lambda: r.member(f, info)))[:1] == b"x" and len(failed) == 2
    finally:
        Ranged._fetch = fetch


def test_short_reads_and_a_damaged_directory_are_read_again(spark, tmp_path, monkeypatch):
    path = f"file://{tmp_path}/a"
    media.write_media(spark.range(3).selectExpr("id as doc_id", "'x' as text").coalesce(1), path)
    r = media.ArchiveReader({"path": path, "tries": "5"})
    fetch, calls = Ranged._fetch, []

    def flaky(self, at, n):
        calls.append(at)
        data = fetch(self, at, n)
        return {1: b"\0" * len(data), 2: data[: n - 1]}.get(len(calls), data)

    def checked(self, at, n):
        data = flaky(self, at, n)
        if len(data) < n:
            raise EOFError("short")
        return data

    monkeypatch.setattr(Ranged, "_fetch", checked)
    assert [row[1] for p in r.partitions() for _, row in r.members(p)] == [f"id-{k}.png" for k in range(3)] and len(calls) > 2


def test_appends_add_up_and_overwrites_replace(spark, tmp_path):
    path = f"file://{tmp_path}/a"
    docs = lambda a, z: spark.range(a, z).selectExpr("id as doc_id", "'x' as text")
    media.write_media(docs(0, 2), path)
    media.write_media(docs(2, 3), path)
    assert sorted(r.member for r in media.read_media(spark, path).collect()) == [f"id-{k}.png" for k in range(3)]
    media.write_media(docs(5, 6), path, mode="overwrite")
    assert [r.member for r in media.read_media(spark, path).collect()] == ["id-5.png"]


def test_text_ids(spark):
    ids = [None, "null", "", "a/b c.png", "é\x00+%"]
    docs = spark.createDataFrame([(i, "t") for i in ids], "doc_id string, text string")
    assert sorted((r.doc_id for r in media.media_features(docs).collect()), key=str) == sorted(ids, key=str)
