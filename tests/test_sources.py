"""Versioned tables, the cache, JDBC, sessions, streams that carry messages and timers."""

from __future__ import annotations

import time

import pytest
from pyspark.sql import functions as F

from recollect.sources import tables as S
from recollect.streaming import capture as C


def test_tables_keep_versions(spark, tmp_path):
    t = S.Tables(spark, f"file://{tmp_path}/db", {"a": "id long, t string"})
    t.set_up()
    t.set_up()
    assert t.read("a").count() == 0
    t.append("a", spark.range(3))
    t.append("a", spark.range(3, 5).withColumn("t", F.lit("x")))
    assert sorted((r.id, r.t) for r in t.read("a").collect()) == [(0, None), (1, None), (2, None), (3, "x"), (4, "x")]
    at = t.version("a")
    t.replace("a", t.read("a").filter("id > 2"), at)
    assert t.read("a").count() == 2 and t.read("a", at).count() == 5
    with pytest.raises(S.Conflict):
        t.replace("a", t.read("a"), at)


def test_transactions_are_whole(spark, tmp_path):
    t = S.Tables(spark, f"file://{tmp_path}/db", {"a": "id long, t string", "b": "id long"}, {"a": "id"})
    t.set_up()
    one = t.begin()
    one.append("a", spark.range(3))
    one.append("b", spark.range(5))
    assert t.read("a").count() == t.read("b").count() == 0  # files without an entry, as after a crash
    one.commit()
    assert t.read("a").count() == 3 and t.read("b").count() == 5
    left, right = t.begin(), t.begin()
    assert left.read("a").count() == right.read("a").count() == 3
    left.append("b", spark.range(1))
    right.append("a", spark.range(3, 4))
    right.commit()
    with pytest.raises(S.Conflict):
        left.commit()
    assert t.read("b").count() == 5
    blind = t.begin()  # it has read nothing, so others don't matter
    blind.append("a", spark.range(9, 10))
    t.append("a", spark.range(8, 9))
    blind.commit()
    assert sorted(r.id for r in t.read("a").collect()) == [0, 1, 2, 3, 8, 9]


def test_half_written_entries_hurt_nobody(spark, tmp_path):
    t = S.Tables(spark, f"file://{tmp_path}/db", {"a": "id long"}, {})
    t.set_up()
    t.append("a", spark.range(2))
    (tmp_path / "db/_log/.0123").write_text("")  # of a writer that died
    (tmp_path / "db/a/part-dead").mkdir()
    assert t.read("a").count() == 2 and t.append("a", spark.range(1)) == 2 and t.read("a").count() == 3
    with pytest.raises(OSError):
        S.Tables(spark, f"file://{tmp_path}/db", {"a": "id long"}, {}, claim=lambda a, b: (_ for _ in ()).throw(OSError("disk full"))).append("a", spark.range(1))
    lost = S.Tables(spark, f"file://{tmp_path}/db", {"a": "id long"}, {})
    tries = []

    def late(temporary, name):  # another writer takes the number twice
        tries.append(name)
        if len(tries) < 3:
            t.append("a", spark.range(1))
        return lost._claim(temporary, name)

    lost.claim = late
    assert lost.append("a", spark.range(10, 11)) == 5 and len(tries) == 3 and t.read("a").count() == 6


def test_updates_touch_the_files_that_hold_the_keys(spark, tmp_path):
    t = S.Tables(spark, f"file://{tmp_path}/db", {"a": "id long, t string"}, {"a": "id"})
    t.set_up()
    t.append("a", spark.range(1_000_000).repartitionByRange(20, "id").withColumn("t", F.lit("old")))
    before = t.state(t.version())["a"]
    one, two = t.begin(), t.begin()
    for x, k in ((one, 777_777), (two, 3)):
        assert x.update("a", [k], lambda rows, k=k: rows.withColumn("t", F.when(F.col("id") == k, "new").otherwise(F.col("t")))) == 1
    one.commit()
    two.commit()  # other keys, other files: no conflict
    after = t.state(t.version())["a"]
    assert len(before) == 20 and len(set(before) & set(after)) == 18 and t.read("a").count() == 1_000_000
    assert sorted(r.id for r in t.read("a").filter("t = 'new'").collect()) == [3, 777_777]
    same, other = t.begin(), t.begin()
    for x in (same, other):
        x.update("a", [5], lambda rows: rows)
    same.commit()
    with pytest.raises(S.Conflict):
        other.commit()


def test_many_appends_stay_few_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(S, "STATE_EVERY", 4)
    monkeypatch.setattr(S, "SMALL_FILES", 6)
    t = S.Tables(spark, f"file://{tmp_path}/db", {"a": "id long"}, {"a": "id"})
    t.set_up()
    for k in range(20):
        t.append("a", spark.range(k, k + 1, 1, 1))
        t.tidy("a")
        assert len(t.state(t.version())["a"]) <= 7
    old = t.version()
    t.compact("a")
    assert sorted(r.id for r in t.read("a").collect()) == list(range(20)) and len(t.state(t.version())["a"]) == 1
    assert t.read("a", old).count() == 20
    assert t.vacuum(keep=0, seconds=3600) == 0  # too young
    assert t.vacuum(keep=0, seconds=-1) >= 20
    fresh = S.Tables(spark, f"file://{tmp_path}/db", {"a": "id long"}, {"a": "id"})
    assert fresh.read("a").count() == 20 and len(list((tmp_path / "db/a").glob("*/*.parquet"))) == 1
    assert fresh.append("a", spark.range(1)) and fresh.read("a").count() == 21


def test_cache_forgets(spark):
    now = [0.0]
    c = S.Cache(10, lambda: now[0])
    made = []
    make = lambda: made.append(1) or spark.range(len(made))
    assert c.get("x") is None and c.get("x", make).count() == 1 and c.get("x", make).count() == 1
    now[0] = 11
    assert c.get("x", make).count() == 2


def test_a_failure_to_open_is_remembered():
    calls = []

    def fail():
        calls.append(1)
        raise OSError("no")

    s = S.Session(fail)
    for _ in range(2):
        with pytest.raises(OSError):
            s.get()
    assert len(calls) == 1 and S.Session(lambda: 5).get() == 5


def test_jdbc_reads_in_parts(spark, monkeypatch):
    import pyspark.sql.readwriter as R

    seen = {}
    monkeypatch.setattr(R.DataFrameReader, "load", lambda self: self)
    option = R.DataFrameReader.option
    monkeypatch.setattr(R.DataFrameReader, "option", lambda self, k, v: seen.__setitem__(k, v) or option(self, k, v))
    S.read_jdbc(spark, "jdbc:postgresql://h/d", "memories", "id", 8, (0, 1000))
    assert seen == {"url": "jdbc:postgresql://h/d", "dbtable": "memories", "partitionColumn": "id", "numPartitions": 8, "lowerBound": 0, "upperBound": 1000}


def test_messages_reach_subscribers(spark, tmp_path):
    topic = f"file://{tmp_path}/topic"
    C.publish(spark.range(3), topic)
    C.publish(spark.range(3, 4), topic)
    assert sorted(r.id for r in C.drained(C.subscribe(spark, topic, "id long"), "sub").collect()) == [0, 1, 2, 3]


def test_timers_go_on_after_failures(spark):
    runs = []

    def job():
        runs.append(1)
        if len(runs) == 1:
            raise ValueError("once")

    q = C.timer(spark, "1 second", job, "test")
    until = time.time() + 60
    while len(runs) < 2 and time.time() < until:
        time.sleep(0.2)
    q.stop()
    assert len(runs) >= 2


def test_order_holds_across_arrow_batches(spark, sf):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        events = C.event_stream(spark, sf)
        got = {(r.source, r.target) for r in C.drained(C.coactivation_stream(events, 2), "pairs").collect()}
        assert C.drained(C.coactivation_stream(events, 1), "none").count() == 0
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want, last = set(), {}
    for r in sorted(spark.read.parquet(f"{sf}/events.parquet").collect(), key=lambda r: (r.ts, r.event_id)):
        if r.user_id in last:
            want |= {(r.event_id, last[r.user_id]), (last[r.user_id], r.event_id)}
        last[r.user_id] = r.event_id
    assert got == want


def test_stretches_wait_for_the_watermark(spark, tmp_path):
    """Late rows join, batches don't matter, and state goes once the watermark has passed."""
    import datetime as dt

    schema, base = "project_id long, created_at timestamp_ntz", dt.datetime(2024, 1, 1)
    at = lambda *minutes: [(1, base + dt.timedelta(minutes=m)) for m in minutes]
    source = f"{tmp_path}/in"
    q = None
    for k, rows in enumerate([at(0, 5, 30), at(20), [*at(12), (2, base + dt.timedelta(minutes=31))], at(100), at(400), at(0), at(900)]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        stream = C.quiet_stream(spark.readStream.schema(schema).parquet(source), 600.0, "1 hour")
        q = stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
        q.awaitTermination()
        if k == 2:
            assert q.recentProgress[-1]["stateOperators"][0]["numRowsTotal"] == 2
    got = sorted((r.project_id, r.start[11:16], r.end[11:16], r.n) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    assert got == [(1, "00:00", "00:30", 5), (1, "01:40", "01:40", 1), (1, "06:40", "06:40", 1), (2, "00:31", "00:31", 1)]
    assert q.recentProgress[-1]["stateOperators"][0]["numRowsTotal"] == 1  # that of minute 900


def test_a_batch_written_again_adds_nothing(spark, tmp_path):
    t = S.Tables(spark, f"file://{tmp_path}/db", {"a": "id long, t string", "b": "id long"}, {"a": "id"})
    t.set_up()
    C.publish(spark.range(3), f"{tmp_path}/topic")
    for state in ("one", "two"):
        t.sink(C.subscribe(spark, f"{tmp_path}/topic", "id long"), "a", "reader", f"{tmp_path}/{state}", availableNow=True).awaitTermination()
    assert sorted(r.id for r in t.read("a").collect()) == [0, 1, 2]
    seen = []
    note = lambda tx, rows: seen.extend((r.id, r.t) for r in rows.collect())
    t.consume("a", "me", note)
    t.consume("a", "me", note)
    assert sorted(seen) == [(0, None), (1, None), (2, None)]
    t.transact(lambda tx: tx.update("a", [1], lambda rows: rows.withColumn("t", F.when(F.col("id") == 1, "new"))))
    t.append("a", spark.range(7, 8))
    t.compact("a")
    seen.clear()
    t.consume("a", "me", note)
    assert sorted(seen) == [(1, "new"), (7, None)]
