"""The tools as methods: one object over a folder of tables.

Every method gives an envelope: {"ok": True, ...} with its data, or {"ok": False, "message", "error"}.
Data are rows (dictionaries) where a limit bounds them, and frames otherwise. A method writes in
one transaction (see sources.tables), so it takes effect as a whole or not at all, over all tables
it changes. If another writer was first with what the method has read, all of it runs anew: of two
approvals that want the same memory one wins, and the other is told so. Changes of a few rows
rewrite the files that hold them.
"""

from __future__ import annotations

import functools
import uuid
from collections.abc import Callable, Sequence
from datetime import UTC, datetime
from typing import Any

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from recollect.functions.embedding import embedded, packed
from recollect.functions.scoring import read_scope
from recollect.functions.text import has_secret
from recollect.operators import detect, filters, graph, lifecycle, merging, search, sessions, stats, store
from recollect.sources.model import STATUSES
from recollect.sources.tables import Conflict, Tables, Transaction
from recollect.streaming.capture import timer

#: Limits of callers: default, least, most (fixed values).
MEMORIES, CONVERSATIONS, RECENT = (10, 1, 100), (5, 1, 50), (3, 1, 50)


class Invalid(ValueError):
    """A call without what it needs."""


def tool(f: Callable) -> Callable:
    """Put what a method gives into an envelope; errors of the caller, of the tables and of Spark become its message."""

    @functools.wraps(f)
    def run(self, *args: Any, **kwargs: Any) -> dict:
        try:
            return {"ok": True} | f(self, *args, **kwargs)
        except Invalid as e:
            return {"ok": False, "message": str(e), "error": "invalid"}
        except (PySparkException, Conflict, OSError) as e:
            return {"ok": False, "message": f"{f.__name__} failed", "error": f"{type(e).__name__}: {e}"}

    return run


def _need(**given: Any) -> None:
    for name, value in given.items():
        if value is None or value == "":
            raise Invalid(f"{name} is required")


def _rows(df: DataFrame) -> list[dict]:
    return [r.asDict(recursive=True) for r in df.collect()]


class Engine:
    def __init__(self, spark: SparkSession, base: str, now: Callable[[], datetime] | None = None, principals: Sequence[str] | None = None, provider: str = "tf"):
        """principals: who reads (agent:x, project:y); None reads everything. provider: what gives memories their vectors."""
        self.spark, self.tables, self.principals, self.provider = spark, Tables(spark, base), principals, provider
        self.clock = now or (lambda: datetime.now(UTC).replace(tzinfo=None))
        self.tables.set_up()

    def now(self) -> Column:
        return F.lit(self.clock().isoformat(sep=" ")).cast("timestamp_ntz")

    def _row(self, **values: Any) -> DataFrame:
        """One row without Python workers: literals, null where nothing is given."""
        literal = lambda v: F.array(*map(F.lit, v)).cast("array<string>") if isinstance(v, list | tuple) else v if isinstance(v, Column) else F.lit(v)
        return self.spark.range(1).select(*[literal(v).alias(k) for k, v in values.items()])

    def _project(self, t: Transaction, path: str | None) -> str | None:
        """The id of the project of that path, which is added if it is new."""
        if path is None:
            return None
        known = filters.project_by_path(t.read("projects"), path).first()
        if known is not None:
            return known["project_id"]
        ident = uuid.uuid5(uuid.NAMESPACE_URL, path).hex
        t.append("projects", self._row(project_id=ident, path=path, name=path.rstrip("/").rsplit("/", 1)[-1], created_at=self.now()))
        return ident

    def _vectors(self, texts: DataFrame) -> DataFrame:
        """(id, buckets, weights) of texts (id, content)."""
        return packed(embedded(texts, self.provider))

    def _known(self, path: str | None) -> str | None:
        if path is None:
            return None
        found = filters.project_by_path(self.tables.read("projects"), path).first()
        return found["project_id"] if found else ""  # of an unknown project nothing is found

    def _memories(self) -> DataFrame:
        m = lifecycle.unexpired(self.tables.read("memories"), self.now())
        if self.principals is None:
            return m
        scoped = m.withColumn("read_scope", read_scope(F.col("visibility"), F.col("agent_id"), F.col("project_id")))
        return filters.readable(scoped, self.principals).drop("read_scope")

    @tool
    def remember(self, content: str, type: str = "observation", tags: Sequence[str] = (), project: str | None = None, agent: str | None = None, visibility: str = "private", sector: str = "episodic", user: int | None = None, expires_at: datetime | None = None, metadata: dict[str, str] | None = None) -> dict:
        _need(content=content)
        ident = uuid.uuid4().int >> 65
        meta = F.create_map(*[F.lit(x) for pair in metadata.items() for x in pair]) if metadata else F.lit(None).cast("map<string,string>")
        row = self._row(id=ident, content=content, type=type, tags=list(tags), agent_id=agent, visibility=visibility, sector=sector, user_id=user, expires_at=F.lit(expires_at.isoformat(sep=" ") if expires_at else None).cast("timestamp_ntz"), metadata=meta)
        full = store.normalised(row, self.now()).withColumns({
            "last_decay_at": F.col("created_at"), "coactivation": F.lit(0), "is_private": F.lit(visibility == "private"), "has_secrets": has_secret(F.col("content")), "is_mergeable": F.lit(True),
            **{c: F.lit(False) for c in ("is_protected", "is_pinned", "is_merged", "is_canonical")}, "is_active": F.lit(True),
        })
        full = detect.stored(full.join(self._vectors(full.select("id", "content")), "id", "left"), "remembered")

        def work(t: Transaction) -> None:
            t.append("memories", full.withColumn("project_id", F.lit(self._project(t, project)).cast("string")))

        self.tables.transact(work)
        self.tables.tidy("memories")
        return {"id": ident}

    @tool
    def recall(self, id: int) -> dict:
        _need(id=id)
        found = _rows(store.by_id(self._memories(), id))
        return {"found": bool(found), "data": found[0] if found else None}

    @tool
    def search(self, query: str | None = None, scope: str = "memories", type: str | None = None, tags: Sequence[str] = (), project: str | None = None, role: str | None = None, limit: int | None = None, after: datetime | None = None, before: datetime | None = None, meaning: str | None = None) -> dict:
        """scope memories: those that hold the query; with `meaning`, a text, the nearest to it first (a query is then not needed), else the newest."""
        newest = F.desc("created_at"), F.desc("id")
        own = self._known(project)
        if scope == "memories":
            if meaning is None:
                _need(query=query)
            m = search.keyword(self._memories().filter("is_active"), query, tags)
            m = filters.matching(m, filters.Criteria(type=type, project_id=own), self.now())
            if meaning is not None:
                asked = self._vectors(self._row(id=0, content=meaning)).first()
                m = search.by_meaning(m, asked["buckets"] if asked else [], asked["weights"] if asked else [])
                newest = F.desc("similarity"), *newest
            return {"scope": scope, "data": _rows(search.clamped_top(m.drop("buckets", "weights"), limit, *MEMORIES, *newest))}
        messages = self.tables.read("messages") if own is None else self.tables.read("messages").filter(F.col("project_id") == own)
        talks = messages.groupBy("conv_id").agg(F.min("created_at").alias("created_at"), F.count("*").alias("n_messages"))
        order = F.desc("created_at"), F.desc("conv_id")
        if scope == "conversations":
            _need(query=query)
            return {"scope": scope, "data": _rows(search.clamped_top(search.conversations_with(talks, messages, query, role), limit, *CONVERSATIONS, *order))}
        if scope == "recent":
            for at, ok in ((after, lambda t: F.col("created_at") >= t), (before, lambda t: F.col("created_at") <= t)):
                if at is not None:
                    talks = talks.filter(ok(F.lit(at.isoformat(sep=" ")).cast("timestamp_ntz")))
            return {"scope": scope, "data": _rows(search.clamped_top(talks, limit, *RECENT, *order))}
        raise Invalid(f"unknown scope: {scope}")

    @tool
    def observe(self, type: str, action: str, summary: str, target: str | None = None, details: str | None = None, session: str | None = None, project: str | None = None) -> dict:
        _need(type=type, action=action, summary=summary)
        ident = uuid.uuid4().int >> 65
        self.tables.transact(lambda t: t.append("observations", self._row(id=ident, type=type, action=action, target=target, summary=summary, details=details, session=session, project_id=self._project(t, project), created_at=self.now())))
        self.tables.tidy("observations")
        return {"id": ident}

    @tool
    def context(self, project: str, include: Sequence[str] = ("memories", "observations"), limit: int | None = None) -> dict:
        _need(project=project)
        own, newest = self._known(project), (F.desc("created_at"), F.desc("id"))
        blocks = {"memories": lambda: self._memories().filter("is_active"), "observations": lambda: self.tables.read("observations"), "messages": lambda: self.tables.read("messages").withColumn("id", F.col("conv_id"))}
        unknown = [b for b in include if b not in blocks]
        if unknown:
            raise Invalid(f"unknown block: {unknown[0]}")
        return {"data": {b: _rows(search.clamped_top(blocks[b]().filter(F.col("project_id") == own), limit, *MEMORIES, *newest)) for b in include}}

    @tool
    def health(self) -> dict:
        """ok if all tables can be read, degraded if some can, else error."""
        fine = {name: store.healthy(self.tables.read(name)) for name in self.tables.schemas}
        status = "ok" if all(fine.values()) else "degraded" if any(fine.values()) else "error"
        return {"status": status, "tables": fine}

    @tool
    def merge(self, mode: str, project_id: str | None = None, proposal_id: int | None = None, threshold: float = 0.85, type: str | None = None, status: str | None = None, limit: int | None = None, create: bool = True, provider: str | None = None) -> dict:
        if mode not in ("detect", "list", "preview", "stats"):
            raise Invalid(f"unknown merge mode: {mode}")
        proposals = self.tables.read("proposals")
        if mode == "preview":
            _need(proposal_id=proposal_id)
            found = _rows(merging.previewed(proposals.filter(F.col("id") == proposal_id), self._memories()).drop("rows"))
            if not found:
                raise Invalid(f"proposal {proposal_id}, or all of its sources, not found")
            return {"data": found[0]}
        _need(project_id=project_id)
        own = proposals.filter(F.col("project_id") == project_id)
        if mode == "list":
            counts = {r["status"]: r["n"] for r in stats.count_by(own, "status", STATUSES).collect()}
            return {"data": _rows(merging.listed(own, status=status, limit=limit or 20)), "by_status": counts}
        memories = self._memories().filter(F.col("project_id") == project_id)
        if mode == "stats":
            history = self.tables.read("merge_history").join(own.select(F.col("id").alias("merge_id")), "merge_id", "left_semi")
            return {"data": _rows(stats.merge_stats(memories, own, STATUSES, history))[0]}
        m = detect.stored(detect.mergeable(memories, kind=type), "mergeable")
        pairs = detect.stored(detect.detected(m, embedded(m.select("id", "content"), provider or self.provider), threshold, limit=limit or 50), "detected")
        found = pairs.count()
        if not create:
            return {"duplicates": found, "proposals": [], "data": _rows(pairs)}
        every = detect.stored(merging.proposed(pairs, m, self.now()), "proposed")

        def work(t: Transaction) -> DataFrame:
            new = detect.stored(every.join(t.read("proposals").select("id"), "id", "left_anti"), "proposed")
            t.append("proposals", new)
            return new

        made = self.tables.transact(work)
        ids = made.select("id", "tokens_saved").collect()  # `limit` at most
        return {"duplicates": found, "proposals": [r["id"] for r in ids], "tokens_saved": sum(r["tokens_saved"] for r in ids)}

    @tool
    def merge_decide(self, action: str, proposal_id: int | None = None, merge_id: int | None = None, notes: str | None = None) -> dict:
        if action == "reverse":
            _need(merge_id=merge_id)
            return self.tables.transact(lambda t: self._reverse(t, merge_id, notes))
        if action not in ("approve", "reject"):
            raise Invalid(f"unknown action: {action}")
        _need(proposal_id=proposal_id)
        return self.tables.transact(lambda t: (self._approve if action == "approve" else self._reject)(t, proposal_id, notes))

    def _proposal(self, t: Transaction, proposal_id: int) -> DataFrame:
        one = t.read("proposals", [proposal_id]).filter(F.col("id") == proposal_id)
        if not one.limit(1).count():
            raise Invalid(f"proposal {proposal_id} not found")
        return one

    def _decided(self, t: Transaction, proposal_id: int, status: str, note: str | None) -> None:
        hit = F.col("id") == proposal_id
        t.update("proposals", [proposal_id], lambda p: p.withColumns({"status": F.when(hit, status).otherwise(F.col("status")), "note": F.when(hit, F.lit(note)).otherwise(F.col("note"))}))

    def _reject(self, t: Transaction, proposal_id: int, notes: str | None) -> dict:
        self._proposal(t, proposal_id)
        self._decided(t, proposal_id, "rejected", notes or "Rejected by reviewer")
        return {"proposal_id": proposal_id, "status": "rejected"}

    def _approve(self, t: Transaction, proposal_id: int, notes: str | None) -> dict:
        """Merge the sources of a pending proposal: they, the new memory, the proposal and the history change together."""
        one = self._proposal(t, proposal_id)
        chosen = one.select("status", "sources").first()
        if chosen["status"] != "pending":
            raise Invalid(f"proposal {proposal_id} is {chosen['status']}")
        wanted = set(chosen["sources"])
        rows = t.read("memories", wanted)
        free = one.select(F.col("id").alias("merge_id"), F.explode("sources").alias("id")).join(rows.filter("is_active and not is_merged"), "id")
        merges = detect.stored(merging.merged(merging.grouped(free)).select("merge_id", "content", "type", "tags", "n"), "merges").filter(F.col("n") == len(wanted)).drop("n")
        if not merges.limit(1).count():
            raise Invalid(f"sources of proposal {proposal_id} are missing or merged already")
        made, now = -1 - proposal_id, self.now()
        vector = self._vectors(merges.select(F.lit(made).cast("long").alias("id"), "content")).first()
        own = {c: F.when(F.col("id") == made, F.lit(vector[c] if vector else None)).otherwise(F.col(c)) for c in ("buckets", "weights")}
        own["source"] = F.when(F.col("id") == made, "merge").otherwise(F.col("source"))
        t.update("memories", wanted, lambda m: merging.approved(m, one, merges, now)[0].withColumns(own))
        self._decided(t, proposal_id, "approved", notes)
        t.append("merge_history", merging.approved(rows, one, merges, now)[2])
        return {"proposal_id": proposal_id, "status": "approved", "id": made}

    def _reverse(self, t: Transaction, merge_id: int, notes: str | None) -> dict:
        undo = t.read("merge_history", [merge_id]).filter((F.col("merge_id") == merge_id) & ~F.col("is_reversed"))
        found = undo.select("canonical_id", "sources").first()
        if found is None:
            raise Invalid(f"merge {merge_id} not found, or reversed already")
        undo, hit = detect.stored(undo, "undo"), F.col("merge_id") == merge_id
        t.update("memories", {*found["sources"], found["canonical_id"]}, lambda m: merging.reversed_merges(m, undo)[0])
        t.update("merge_history", [merge_id], lambda h: h.withColumns({"is_reversed": hit | F.col("is_reversed"), "note": F.when(hit, F.lit(notes)).otherwise(F.col("note"))}))
        return {"merge_id": merge_id}

    @tool
    def lifecycle(self, project: str | None = None, days: int = 180) -> dict:
        """Decay, tiers and eviction; evicted memories become inactive."""
        own, now = self._known(project), self.now()
        mine = F.lit(True) if own is None else F.col("project_id") == own

        def work(t: Transaction) -> DataFrame:
            memories = t.read("memories")
            done = detect.stored(lifecycle.maintained(memories.filter(mine), now, days).select("id", "decayed", "relevance", "last_decay_at", "tier", "evicted"), "maintained")
            new = done.select("id", F.col("relevance").alias("new_relevance"), F.col("last_decay_at").alias("new_decay"), "evicted")
            changed = memories.join(new, "id", "left").withColumns({"relevance": F.coalesce("new_relevance", "relevance"), "last_decay_at": F.coalesce("new_decay", "last_decay_at"), "is_active": F.col("is_active") & ~F.coalesce("evicted", F.lit(False))})
            if done.filter("decayed or evicted").limit(1).count():
                t.replace("memories", changed.select(*memories.columns))
            return done

        done = self.tables.transact(work)
        counts = done.agg(F.count_if("decayed").alias("decayed"), *[F.count_if(F.col("tier") == x).alias(x) for x in ("hot", "warm", "cold")], F.count_if("evicted").alias("evicted")).first()
        return {"stats": counts.asDict()}

    @tool
    def summarize_session(self, conversation: int, type: str = "incremental", size: int = 10) -> dict:
        _need(conversation=conversation)
        kinds = {"incremental": lambda m: sessions.incremental(m, size), "rolling": lambda m: sessions.rolling(m, size), "final": sessions.final}
        if type not in kinds:
            raise Invalid(f"unknown type of summary: {type}")
        m = self.tables.read("messages").filter(F.col("conv_id") == conversation)
        made = sessions.with_savings(kinds[type](m), m)
        row = detect.stored(made.select(F.lit(uuid.uuid4().int >> 65).alias("id"), "conv_id", F.lit(type).alias("summary_type"), "summary", "compressed_from", "tokens_saved", self.now().alias("created_at")), "summary")
        found = _rows(row)
        if not found:
            raise Invalid(f"conversation {conversation} not found")
        self.tables.append("summaries", row)
        return {"data": found[0]}

    def _flag(self, id: int, flag: str, value: bool, reason: str | None) -> dict:
        if not store.by_id(self._memories(), id).count():
            raise Invalid(f"memory {id} not found")
        ids = self.spark.range(1).select(F.lit(id).alias("id"))
        files = self.tables.transact(lambda t: t.update("memories", [id], lambda m: lifecycle.flagged(m, ids, flag, value, reason, self.now())))
        return {"id": id, flag: value, "files": files}

    @tool
    def protect_memory(self, id: int, reason: str) -> dict:
        _need(id=id, reason=reason)
        return self._flag(id, "is_protected", True, reason)

    @tool
    def pin_memory(self, id: int, pinned: bool = True) -> dict:
        _need(id=id)
        return self._flag(id, "is_pinned", pinned, "pinned by the user" if pinned else None)

    @tool
    def get_related(self, id: int, limit: int | None = None) -> dict:
        _need(id=id)
        near = graph.related(self.tables.read("associations"), id, filters.clamped(limit, 10, 1, 100))
        found = near.join(self._memories().select("id", "content", "type"), "id").orderBy(F.desc("weight"), "id")
        return {"data": _rows(found)}

    @tool
    def associate(self, ids: Sequence[int], kind: str = "co_occurred") -> dict:
        """Memories that were active together: their edges gain weight."""
        basket = self.spark.range(1).select(F.lit(0).alias("basket"), F.explode(F.array(*[F.lit(i).cast("long") for i in ids])).alias("id"))
        new = detect.stored(graph.coactivated(basket, "basket", "id").withColumn("kind", F.lit(kind)), "edges")
        self.tables.transact(lambda t: t.update("associations", [int(i) for i in ids], lambda e: graph.associated(e, new)))
        return {"edges": new.count()}

    @tool
    def prune(self, least: int = 5) -> dict:
        """Drop associations of a weight up to `least`."""

        def work(t: Transaction) -> int:
            edges = t.read("associations")
            strong = graph.pruned(edges, least)
            weak = edges.count() - strong.count()
            if weak:
                t.replace("associations", strong)
            return weak

        return {"pruned": self.tables.transact(work)}

    @tool
    def tidy(self) -> dict:
        """Put small files of all tables together and delete what recent versions don't need."""
        return {"compacted": {n: self.tables.compact(n) for n in self.tables.schemas}, "deleted": self.tables.vacuum()}

    def worker(self, lifecycle: str = "1 hour", prune: str = "1 day", tidy: str = "6 hours") -> list[StreamingQuery]:
        """The jobs of a store that run by the clock, each a timer that outlives a failed run: decay and eviction, weak associations, files. Stop them as any streaming query."""
        jobs = {"lifecycle": (lifecycle, self.lifecycle), "prune": (prune, self.prune), "tidy": (tidy, self.tidy)}

        def checked(job: Callable[[], dict]) -> Callable[[], None]:
            def run() -> None:
                done = job()
                if not done["ok"]:
                    raise RuntimeError(done["message"])

            return run

        return [timer(self.spark, every, checked(job), f"worker-{name}-{uuid.uuid4().hex[:6]}") for name, (every, job) in jobs.items()]
