import base64
import gzip
import hashlib
import os

import pytest
from pyspark.sql import functions as F

from recollect.llm import warc as X

ROWS = [(1, "http://a/x", "<p>é</p>"), (2, None, "<p>é</p>"), (3, "http://b\r\n/y", None), (4, "u", ""), (None, "u", "only"), (6, "http://a/z", "z" * 300_000), (7, "u", "\r\n\r\nWARC/1.1\r\n")]


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame(ROWS, "page_id long, url string, html string").withColumn("id", F.lit(5))


def sha(t):
    return base64.b32encode(hashlib.sha1((t or "").encode()).digest()).decode()


def test_contract(pages):
    got = {r.page_id: r for r in X.archived_pages(pages).collect()}
    first = {}
    for i, _, t in sorted((r for r in ROWS if r[0] is not None), key=lambda r: r[0]):
        first.setdefault(t or "", i)
    assert len(got) == len(ROWS)
    for i, _, t in ROWS:
        r, home = got[i], first.get(t or "", i)
        assert (r.payload_bytes, r.payload_digest) == (len((t or "").encode()), sha(t))
        assert (r.record_type, r.refers_to) == (("response", None) if home == i else ("revisit", home))


def test_whole_table(spark, sf):
    p = spark.read.parquet(f"{sf}/pages.parquet")
    twice = p.unionByName(p.withColumn("page_id", F.col("page_id") + 10_000))
    got = {r.page_id: r for r in X.archived_pages(twice).collect()}
    assert len(got) == 2 * p.count() and all(r.refers_to == i - 10_000 for i, r in got.items() if i >= 10_000)


@pytest.fixture(scope="module")
def archive(spark, pages, tmp_path_factory):
    path = f"file://{tmp_path_factory.mktemp('warc')}"
    X.write_warc(pages.select(F.col("page_id").alias("id"), "url", F.coalesce("html", F.lit("")).cast("binary").alias("payload")), path)
    return path


def test_files_are_gzip_of_warc_records(archive):
    names = [n for n in os.listdir(archive[7:]) if n.endswith(".gz")]
    text = b"".join(gzip.open(f"{archive[7:]}/{n}").read() for n in names)
    assert text.count(b"WARC-Type: response") == 5 and text.count(b"WARC-Type: revisit") == 2 and text.startswith(b"WARC/1.1\r\nWARC-Record-ID: ")


def test_filters_reach_the_reader(spark, archive):
    df = X.read_warc(spark, archive).filter("record_type = 'revisit'")
    assert df.count() == 2 and "Filter" not in df._jdf.queryExecution().executedPlan().toString().split("BatchScan")[0]
    assert X.read_warc(spark, archive).filter("target_uri like 'http://a/%' and record_type in ('response', 'x')").count() == 2
    assert X.read_warc(spark, archive, payload=False).filter("payload is not null").count() == 0


def _at(uri, name):
    store, path = X.located(uri)
    return store, f"{path}/{name}"


def _all(uri, tests=(), **options):
    r = X.WarcReader({"path": uri, **options})
    return [row for p in r.partitions() for name, a, z in p.ranges for _, row in r.records(X.Ranged(*_at(uri, name), wait=0), list(tests), a, z)]


def test_unwanted_payloads_are_not_decoded(archive, monkeypatch):
    seen = []
    more = X.Member.more
    monkeypatch.setattr(X.Member, "more", lambda self, most: seen.append(most) or more(self, most))
    assert not _all(archive, [lambda row: False]) and seen == [4096] * len(ROWS)


def _record(k, kind="response"):
    return X.record({"record_id": f"<urn:page:{k}>", "record_type": kind, "payload": b"x" * k, "payload_bytes": k})


def test_foreign_members_without_lengths(tmp_path):
    (tmp_path / "f.warc.gz").write_bytes(b"".join(gzip.compress(_record(k), mtime=0) for k in (5, 70_000, 0)))
    assert [len(x[-1]) for x in _all(f"file://{tmp_path}")] == [5, 70_000, 0]


def test_foreign_members_of_many_records(tmp_path):
    import io

    named = io.BytesIO()
    with gzip.GzipFile("name.warc", "wb", fileobj=named) as g:
        g.write(_record(3) + _record(4))
    lower = _record(9).replace(b"WARC-Type: ", b"warc-type:").replace(b"Content-Length: ", b"CONTENT-LENGTH:  ", 1)
    plain = b"WARC/1.0\r\nWARC-Type: resource\r\nContent-Type: text/plain\r\nX-A: 1\r\nX-A: 2\r\n folded\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    two = X.member(_record(6) + _record(7), 4)
    (tmp_path / "f.warc.gz").write_bytes(named.getvalue() + two + gzip.compress(lower + plain + _record(100_000)) + X.member(_record(2), 4))
    rows = _all(f"file://{tmp_path}")
    assert [(r[1], len(r[-1])) for r in rows] == [("response", n) for n in (3, 4, 6, 7, 9)] + [("resource", 3), ("response", 100_000), ("response", 2)]
    assert dict(rows[5][-2])["X-A"] == "1, 2 folded"
    kept = _all(f"file://{tmp_path}", [lambda row: row["record_id"] in ("<urn:page:7>", "<urn:page:2>")], payload="false")
    assert [r[0] for r in kept] == ["<urn:page:7>", "<urn:page:2>"]


def test_ranges_own_each_member_once(tmp_path):
    import random

    r = random.Random(1)
    sizes = [r.randrange(4000) for _ in range(60)]
    blob = lambda n: bytes(r.getrandbits(8) for _ in range(n)) + b"\x1f\x8b\x08\0" * 3
    rec = [X.record({"record_id": f"{k}", "record_type": "response", "payload": blob(n), "payload_bytes": n}) for k, n in enumerate(sizes)]
    (tmp_path / "f.warc.gz").write_bytes(b"".join(gzip.compress(x) if k % 2 else X.member(x, 4) for k, x in enumerate(rec)))
    assert [row[0] for row in _all(f"file://{tmp_path}", partition_bytes="1000")] == [str(k) for k in range(60)]


def test_damage_is_noticed_and_read_again(tmp_path, monkeypatch):
    for k, raw in enumerate((X.member(_record(50), 4), gzip.compress(_record(50)))):
        bad = bytearray(raw)
        bad[-6] ^= 1
        (tmp_path / f"{k}").mkdir()
        (tmp_path / f"{k}" / "f.warc.gz").write_bytes(bytes(bad))
        with pytest.raises(ValueError, match="damaged"):
            _all(f"file://{tmp_path}/{k}")
        (tmp_path / f"{k}" / "f.warc.gz").write_bytes(raw[:-20])
        with pytest.raises((EOFError, ValueError)):
            _all(f"file://{tmp_path}/{k}")
    (tmp_path / "ok").mkdir()
    (tmp_path / "ok" / "f.warc.gz").write_bytes(X.member(_record(50), 4) + X.member(_record(60), 4))
    fetch, failed = X.Ranged._fetch, []

    def flaky(self, at, n):
        data = fetch(self, at, n)
        failed.append(at)
        return data if len(failed) > 2 else data[:5] + b"\0" * (len(data) - 5) if len(failed) > 1 else bytes(len(data))

    monkeypatch.setattr(X.Ranged, "_fetch", flaky)
    assert [len(r[-1]) for r in _all(f"file://{tmp_path}/ok")] == [50, 60] and len(failed) > 2


def test_appends_add_up_and_overwrites_replace(spark, tmp_path):
    path = f"file://{tmp_path}/w"
    rows = lambda a, z: spark.range(a, z).selectExpr("id", "'u' as url", "cast(cast(id as string) as binary) as payload")
    X.write_warc(rows(0, 2), path)
    X.write_warc(rows(2, 3), path)
    assert sorted(r.record_id for r in X.read_warc(spark, path).collect()) == [f"<urn:page:{k}>" for k in range(3)]
    X.write_warc(rows(7, 9), path, mode="overwrite")
    assert sorted(r.record_id for r in X.read_warc(spark, path).collect()) == ["<urn:page:7>", "<urn:page:8>"]
    assert len([n for n in os.listdir(tmp_path / "w") if n.endswith(".gz")]) <= 2


def test_empty_and_threshold(spark, pages):
    assert X.archived_pages(pages.limit(0)).count() == 0
    assert {r.record_type for r in X.archived_pages(pages, min_revisit_bytes=5).filter("page_id in (3, 4)").collect()} == {"response"}
