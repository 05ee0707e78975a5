"""The tools on a small store."""

from __future__ import annotations

import datetime as dt

import pytest

from recollect.api import Engine

NOW = dt.datetime(2024, 5, 1, 12)


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    e = Engine(spark, f"file://{tmp_path_factory.mktemp('store')}", now=lambda: NOW)
    e.ids = [e.remember(t, type="fact", tags=["x"], project="/work/app", user=1)["id"] for t in ("The user prefers dark mode in the editor. It is easier to read.", "The user prefers dark mode in the editor. It is easier to read!", "Deployments run at night.")]
    return e


def test_remember_recall_search(engine):
    got = engine.recall(engine.ids[0])
    assert got["ok"] and got["found"] and got["data"]["relevance"] == 50 and got["data"]["tags"] == ["x"]
    assert not engine.recall(5)["found"] and engine.remember("")["message"] == "content is required"
    assert {r["id"] for r in engine.search("dark mode", project="/work/app")["data"]} == set(engine.ids[:2])
    assert engine.search("dark", project="/none")["data"] == [] and engine.search("dark", type="decision")["data"] == []
    assert not engine.search(scope="odd")["ok"] and engine.search(scope="recent")["data"] == []
    assert not engine.remember("x", type="odd")["ok"]


def test_observe_context_health(engine):
    assert engine.observe("tool_use", "grep", "looked for x", project="/work/app")["ok"] and not engine.observe("tool_use", "", "")["ok"]
    got = engine.context("/work/app")["data"]
    assert len(got["memories"]) == 3 and got["observations"][0]["action"] == "grep" and not engine.context("/work/app", ["odd"])["ok"]
    assert engine.health()["status"] == "ok"


def test_merge_life(engine):
    project = engine.recall(engine.ids[0])["data"]["project_id"]
    found = engine.merge("detect", project)
    assert found["duplicates"] == 1 and len(found["proposals"]) == 1 and engine.merge("detect", project)["proposals"] == []
    p = found["proposals"][0]
    listed = engine.merge("list", project, status="pending")
    assert [r["id"] for r in listed["data"]] == [p] and listed["by_status"]["pending"] == 1
    shown = engine.merge("preview", proposal_id=p)["data"]
    assert shown["type"] == "fact" and shown["content"].startswith("It is easier to read") and not engine.merge("preview", proposal_id=1)["ok"]
    done = engine.merge_decide("approve", p, notes="fine")
    assert done.get("status") == "approved", done
    assert not engine.merge_decide("approve", p)["ok"]
    made = engine.recall(done["id"])["data"]
    assert made["is_canonical"] and made["source"] == "merge" and made["confidence"] == 85
    assert not engine.recall(engine.ids[0])["data"]["is_active"] and engine.recall(engine.ids[2])["data"]["is_active"]
    assert engine.merge("stats", project)["data"]["proposals_approved"] == 1
    assert engine.merge_decide("reverse", merge_id=p)["ok"] and not engine.merge_decide("reverse", merge_id=p)["ok"]
    assert engine.recall(engine.ids[0])["data"]["is_active"] and not engine.recall(done["id"])["data"]["is_active"]
    assert engine.merge("stats", project)["data"]["reversed"] == 1 and not engine.merge("odd", project)["ok"]
    assert not engine.merge_decide("reject", 77)["ok"] and engine.merge_decide("reject", p)["status"] == "rejected"


def test_lifecycle_and_flags(engine):
    assert engine.protect_memory(engine.ids[2], "keep")["ok"] and engine.pin_memory(engine.ids[2])["ok"] and not engine.pin_memory(3)["ok"]
    m = engine.recall(engine.ids[2])["data"]
    assert m["is_protected"] and m["is_pinned"] and "pinned_reason" in m["metadata"]
    assert engine.lifecycle()["stats"]["decayed"] == 0


def test_summaries_and_relations(engine, spark):
    engine.tables.append("messages", spark.sql("select 1L conv_id, id turn, if(id % 2 = 0, 'user', 'assistant') role, concat('text ', id) content, timestamp_ntz'2024-01-01' created_at from range(5)").selectExpr("conv_id", "cast(turn as int) turn", "role", "content", "created_at"))
    assert engine.summarize_session(1, "final")["data"]["compressed_from"] == 5 and not engine.summarize_session(9)["ok"] and not engine.summarize_session(1, "odd")["ok"]
    assert [r["conv_id"] for r in engine.search("text 3", "conversations")["data"]] == [1]
    engine.associate(engine.ids[1:])
    engine.associate(engine.ids[1:])
    assert [(r["id"], r["weight"]) for r in engine.get_related(engine.ids[1])["data"]] == [(engine.ids[2], 2)]


def test_readers_see_what_they_may(engine, spark):
    other = Engine(spark, engine.tables.base, now=lambda: NOW, principals=["agent:a"])
    mine = engine.remember("for the agent only", agent="a")["id"]
    late = engine.remember("gone by now", agent="a", expires_at=NOW - dt.timedelta(days=1))["id"]
    assert other.recall(mine)["found"] and not other.recall(engine.ids[2])["found"] and not engine.recall(late)["found"]


def test_memories_keep_their_vectors(engine):
    rows = {r.id: r for r in engine.tables.read("memories").filter("buckets is not null").collect()}
    assert set(engine.ids) <= set(rows) and abs(sum(w * w for w in rows[engine.ids[0]].weights) - 1) < 1e-9
    near = engine.search(meaning="deployments at night", project="/work/app")["data"]
    assert near[0]["id"] == engine.ids[2] and near[0]["similarity"] > 0.4 and "weights" not in near[0]
    both = engine.search("dark mode", meaning="deployments at night", project="/work/app")["data"]
    assert both and engine.ids[2] not in {r["id"] for r in both} and not engine.search()["ok"]
    assert engine.search("night", meaning="", project="/work/app")["data"][0]["similarity"] == 0


def test_racing_approvals_have_one_winner(spark, tmp_path, monkeypatch):
    e = Engine(spark, f"file://{tmp_path}/race", now=lambda: NOW)
    a, b, c = (e.remember(f"Night deployments are fine, they say {x}.", type="fact", user=1)["id"] for x in "abc")
    for k, pair in ((1, (a, b)), (2, (b, c))):
        e.tables.append("proposals", spark.sql(f"select {k}L id, array({pair[0]}L, {pair[1]}L) sources, 'fact' type, 'pending' status, timestamp_ntz'2024-01-01' created_at"))
    inner = Engine._decided

    def meanwhile(self, t, proposal_id, status, note):  # the other approval goes through while this one is at work
        inner(self, t, proposal_id, status, note)
        if proposal_id == 1:
            monkeypatch.setattr(Engine, "_decided", inner)
            assert Engine(spark, e.tables.base, now=lambda: NOW).merge_decide("approve", 2)["ok"]

    monkeypatch.setattr(Engine, "_decided", meanwhile)
    lost = e.merge_decide("approve", 1)
    assert not lost["ok"] and "merged already" in lost["message"]
    rows = {r.id: r for r in e.tables.read("memories").collect()}
    assert set(rows) == {a, b, c, -3} and rows[b].merged_into == rows[c].merged_into == -3 and rows[a].is_active
    assert [r.merge_id for r in e.tables.read("merge_history").collect()] == [2]
    assert {r.id: r.status for r in e.tables.read("proposals").collect()} == {1: "pending", 2: "approved"}
    assert e.pin_memory(a)["files"] == 1


def test_jobs_by_the_clock(engine):
    import time

    engine.associate(engine.ids[:2])
    assert engine.prune(0)["pruned"] == 0 and engine.tables.read("associations").count()
    jobs = engine.worker("1 second", "1 second", "1 second")
    until = time.time() + 90
    while time.time() < until and any(not q.lastProgress for q in jobs):
        time.sleep(0.5)
    for q in jobs:
        q.stop()
    assert engine.recall(engine.ids[0])["found"] and all(q.lastProgress for q in jobs)
    assert engine.tidy()["ok"] and engine.recall(engine.ids[0])["found"] and engine.prune()["pruned"] == 0 == engine.tables.read("associations").count()
