"""Merging memories: text by type, safety checks, token accounting, proposals and their decisions."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recollect.functions.text import or_default, tokens_by_length
from recollect.operators.components import components
from recollect.sources.storage import kept

LATEST = ("created_at", "id")


def _rows(*fields: str | Column) -> Column:
    """Sources in order of time (ties by id)."""
    return F.sort_array(F.collect_list(F.struct(*LATEST, *fields)))


def grouped(sources: DataFrame, key: str = "merge_id") -> DataFrame:
    """One row per merge: its sources in order, their type and their tags in order of first use.

    A summary and metadata (a map or struct, as its JSON), where sources have them, are kept for token accounting.
    """
    empty = F.lit(None).cast("string")
    summary = (F.col("summary") if "summary" in sources.columns else empty).alias("summary")
    metadata = (F.to_json("metadata") if "metadata" in sources.columns else empty).alias("metadata")
    rows = sources.groupBy(key).agg(_rows("content", "tags", "type", "confidence", summary, metadata).alias("rows"), F.min("type").alias("type"), F.max("type").alias("other_type"), F.count("*").alias("n"))
    return rows.withColumn("all_tags", F.array_distinct(F.flatten(F.transform("rows", lambda r: r["tags"]))))


def sentences(x: Column) -> Column:
    return F.filter(F.transform(F.split(x, "[.!?]\\s+"), lambda s: F.trim(s)), lambda s: s != "")


def _contents() -> Column:
    return F.transform("rows", lambda r: r["content"])


def _newest() -> Column:
    return F.element_at("rows", -1)


def _bulleted(items: Column) -> Column:
    return F.array_join(F.transform(items, lambda c: F.concat(F.lit("- "), c)), "\n")


def by_columns(columns: Callable[[], dict[str, Column]]) -> Callable[[DataFrame], DataFrame]:
    """A merge that is given by its columns over grouped() rows: merged() takes all of these in one pass."""

    def merge(rows: DataFrame) -> DataFrame:
        return rows.withColumns(columns())

    merge.columns, merge.__name__, merge.__doc__ = columns, columns.__name__, columns.__doc__
    return merge


@by_columns
def merge_facts() -> dict[str, Column]:
    """Distinct sentences of all sources, sorted; tags of all."""
    parts = F.array_sort(F.array_distinct(F.flatten(F.transform("rows", lambda r: sentences(r["content"])))))
    return {"content": F.concat(F.array_join(parts, ". "), F.lit(".")), "summary": F.concat(F.lit("Merged "), "n", F.lit(" facts")), "tags": F.col("all_tags"), "warnings": F.array().cast("array<string>")}


@by_columns
def merge_preferences() -> dict[str, Column]:
    """The newest preference, with its tags; a warning if they differed."""
    distinct = F.array_distinct(_contents())
    warnings = F.when(F.size(distinct) > 1, F.array(F.concat(F.lit("Preference changed "), F.size(distinct) - 1, F.lit(" times")), F.lit("Older preferences are kept in the history"))).otherwise(F.array().cast("array<string>"))
    return {"content": _newest()["content"], "summary": F.concat(F.lit("Prefers: "), _newest()["content"], F.lit(" (evolved from "), "n", F.lit(" preferences)")), "tags": _newest()["tags"], "warnings": warnings}


@by_columns
def merge_decisions() -> dict[str, Column]:
    """The newest decision; a warning that names the oldest and the newest if they differ."""
    old, new = F.element_at("rows", 1)["content"], _newest()["content"]
    warnings = F.when(old != new, F.array(F.concat(F.lit("Decision changed: was "), old, F.lit(", now "), new))).otherwise(F.array().cast("array<string>"))
    return {"content": new, "summary": F.concat(F.lit("Decided: "), new, F.lit(" ("), "n", F.lit(" decisions)")), "tags": _newest()["tags"], "warnings": warnings}


@by_columns
def merge_observations() -> dict[str, Column]:
    """All sources in order of time as a list."""
    return {"content": F.concat(F.lit("Observations ("), "n", F.lit(" total):\n"), _bulleted(_contents())), "summary": F.concat("n", F.lit(" observations over time period")), "tags": F.col("all_tags"), "warnings": F.array().cast("array<string>")}


@by_columns
def merge_contexts() -> dict[str, Column]:
    """Distinct sources, sorted, as a list."""
    distinct = F.array_sort(F.array_distinct(_contents()))
    return {"content": _bulleted(distinct), "summary": F.concat(F.size(distinct), F.lit(" context items ("), "n", F.lit(" total)")), "tags": F.col("all_tags"), "warnings": F.array().cast("array<string>")}


STRATEGIES = {"fact": merge_facts, "preference": merge_preferences, "decision": merge_decisions, "observation": merge_observations, "context": merge_contexts}


def strategy(kind: str, merge: Callable[[DataFrame], DataFrame]) -> None:
    """Merge memories of a type by a function of one's own, from grouped() rows to content, summary, tags and warnings.

    The groups are read again for each such function, unless it is made with by_columns.
    """
    STRATEGIES[kind] = merge


def merged(rows: DataFrame, least: int = 2) -> DataFrame:
    """Each group by its type's strategy; groups of mixed types or of fewer sources than `least` are left out."""
    able = rows.filter((F.col("type") == F.col("other_type")) & (F.col("n") >= least))
    plain = {kind: merge.columns() for kind, merge in STRATEGIES.items() if hasattr(merge, "columns")}
    of_type = lambda name: F.coalesce(*[F.when(F.col("type") == kind, columns[name]) for kind, columns in plain.items()])
    parts = [able.filter(F.col("type").isin(*plain)).withColumns({name: of_type(name) for name in ("content", "summary", "tags", "warnings")})] if plain else []
    parts += [merge(able.filter(F.col("type") == kind)) for kind, merge in STRATEGIES.items() if kind not in plain]
    return reduce(DataFrame.unionByName, parts)


def previewed(proposals: DataFrame, memories: DataFrame) -> DataFrame:
    """Proposals (id, sources, similarity) merged anew from the sources that still exist, with what that saves."""
    found = proposals.select(F.col("id").alias("merge_id"), F.explode("sources").alias("id")).join(memories, "id")
    rows = saved_tokens(merged(grouped(found), least=1))
    percent = F.when(F.col("source_tokens") > 0, F.round(100 * F.col("tokens_saved") / F.col("source_tokens"))).otherwise(0).cast("long")
    return rows.join(proposals.select(F.col("id").alias("merge_id"), "similarity", "status"), "merge_id").withColumn("saved_percent", percent)


def proposed(pairs: DataFrame, memories: DataFrame, now: Column) -> DataFrame:
    """Pending proposals for detected pairs that pass the safety checks: merged text, tokens saved, warnings.

    pairs: id_a, id_b, similarity, level, reason. A proposal's id is a hash of its sources' ids, so
    that the same pair is proposed under the same id again.
    """
    ident = F.conv(F.substring(F.md5(F.concat_ws(",", F.col("id_a").cast("string"), F.col("id_b").cast("string"))), 1, 15), 16, 10).cast("long")
    numbered = pairs.withColumn("merge_id", ident)
    sources = numbered.select("merge_id", "similarity", F.explode(F.array("id_a", "id_b")).alias("id")).join(memories, "id")
    checked = safety(sources, similarity=F.col("similarity")).filter("passed").select("merge_id", F.col("warnings").alias("notes"))
    rows = saved_tokens(merged(grouped(sources))).join(checked, "merge_id")
    owner = sources.groupBy("merge_id").agg(F.min_by("project_id", "id").alias("project_id"), F.min_by("user_id", "id").alias("user_id"))
    return rows.join(numbered.select("merge_id", F.array("id_a", "id_b").alias("sources"), "similarity", "level", "reason"), "merge_id").join(owner, "merge_id").select(
        F.col("merge_id").alias("id"), "project_id", "user_id", "sources", "type", "content", "summary", "tags", "similarity", "level", "reason", F.concat("warnings", "notes").alias("warnings"),
        "tokens_saved", F.lit("pending").alias("status"), now.alias("created_at"),
    )


def listed(proposals: DataFrame, project: str | None = None, status: str | None = None, limit: int = 20) -> DataFrame:
    """Proposals by the given filters (all hold), newest first."""
    p = proposals if project is None else proposals.filter(F.col("project_id") == project)
    p = p if status is None else p.filter(F.col("status") == status)
    return p.orderBy(F.desc("created_at"), F.desc("id")).limit(limit)


def _text(*parts: Column | str) -> Column:
    return F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])


#: Figures of a group of sources that checks go by.
MEASURES: dict[str, Callable[[], Column]] = {
    "fixed": lambda: F.count_if(~F.col("is_mergeable")), "kinds": lambda: F.array_sort(F.collect_set("type")), "done": lambda: F.count_if("is_merged"), "users": lambda: F.count_distinct("user_id"),
    "private": lambda: F.count_if("is_private"), "n": lambda: F.count("*"), "secret": lambda: F.count_if("has_secrets"), "inactive": lambda: F.count_if(~F.col("is_active")),
}
#: Checks in order: name, what it says in words, whether it blocks, and its message (null: nothing to say), from MEASURES, similarity and least.
CHECKS: list[tuple[str, str, bool, Callable[[], Column]]] = [
    ("immutable", "No source may be immutable", True, lambda: F.when(F.col("fixed") > 0, _text(F.col("fixed"), " memories are immutable"))),
    ("type", "All sources have one type", True, lambda: F.when(F.size("kinds") > 1, _text("Cannot merge different types: ", F.array_join("kinds", ", ")))),
    ("merged", "No source may be merged already", True, lambda: F.when(F.col("done") > 0, _text(F.col("done"), " memories are already merged"))),
    ("similarity", "Sources must be similar enough", True, lambda: F.when(F.col("similarity") < F.col("least"), _text("Similarity is below ", F.col("least").cast("string")))),
    ("active", "All sources are active", True, lambda: F.when(F.col("inactive") > 0, _text(F.col("inactive"), " memories are inactive"))),
    ("user", "Sources of several users are worth a look", False, lambda: F.when(F.col("users") > 1, _text("Merging memories from ", F.col("users"), " different users"))),
    ("privacy", "Private and public sources are worth a look", False, lambda: F.when((F.col("private") > 0) & (F.col("private") < F.col("n")), F.lit("Mixing private and public memories"))),
    ("secrets", "Secrets are worth a look", False, lambda: F.when(F.col("secret") > 0, _text(F.col("secret"), " memories hold secrets"))),
]


def safety(sources: DataFrame, key: str = "merge_id", similarity: Column | None = None, least: float = 0.7) -> DataFrame:
    """(key, passed, blockers, warnings): CHECKS in their order, from one aggregation."""
    measures = sources.groupBy(key).agg(*[m().alias(name) for name, m in MEASURES.items()], F.min(F.lit(1.0) if similarity is None else similarity).alias("similarity"))
    measures = measures.withColumn("least", F.lit(least))
    some = lambda blocks: F.filter(F.array(*[m() for _, _, b, m in CHECKS if b == blocks]), lambda e: e.isNotNull())
    out = measures.select(key, some(True).alias("blockers"), some(False).alias("warnings"))
    return out.select(key, (F.size("blockers") == 0).alias("passed"), "blockers", "warnings")


def safety_text(checked: DataFrame) -> DataFrame:
    """safety() rows with a text for people: what blocks, what warns, or that all is well."""
    part = lambda label, x: F.when(F.size(x) > 0, F.concat(F.lit(label), F.array_join(F.transform(x, lambda e: F.concat(F.lit("- "), e)), "\n")))
    return checked.withColumn("text", F.coalesce(F.nullif(F.concat_ws("\n", part("Blocked:\n", "blockers"), part("Warnings:\n", "warnings")), F.lit("")), F.lit("All checks passed")))


def described_checks() -> list[tuple[str, str, bool]]:
    """(name, what it asks for, whether it blocks) of each check, in order."""
    return [(name, words, blocks) for name, words, blocks, _ in CHECKS]


def memory_tokens(content: Column, summary: Column, tags: Column, metadata: Column | None = None, overhead: int = 25) -> Column:
    """Tokens of content, summary, tags and the JSON of metadata (a struct or map; none for null), and an overhead."""
    empty = F.lit("")
    parts = tokens_by_length(F.coalesce(content, empty)) + tokens_by_length(F.coalesce(summary, empty)) + tokens_by_length(F.array_join(tags, " ")) + overhead
    return parts if metadata is None else parts + tokens_by_length(F.coalesce(F.to_json(metadata), empty))


def saved_tokens(rows: DataFrame) -> DataFrame:
    """Tokens of the sources and of the merge, and the difference, at least 0."""
    source = F.aggregate("rows", F.lit(0).cast("long"), lambda s, r: s + memory_tokens(r["content"], r["summary"], r["tags"]) + tokens_by_length(F.coalesce(r["metadata"], F.lit(""))))
    target = memory_tokens(F.col("content"), F.col("summary"), F.col("tags"))
    return rows.withColumns({"source_tokens": source, "merged_tokens": target}).withColumn("tokens_saved", F.greatest(F.lit(0).cast("long"), F.col("source_tokens") - F.col("merged_tokens")))


#: Rounds before conflicts are settled by components; proposals of a component that one task takes.
ROUNDS, SETTLED = 2, 200_000


def _in_turn(rows: DataFrame) -> DataFrame:
    """Of proposals (component, merge_id, sources) those that win in order of id, a task a component."""

    def run(table: pa.Table) -> pa.Table:
        used: set = set()
        won = []
        for i, sources in sorted(zip(table.column("merge_id").to_pylist(), table.column("sources").to_pylist(), strict=True)):
            if used.isdisjoint(sources):
                used.update(sources)
                won.append(i)
        return pa.table({"merge_id": pa.array(won, table.schema.field("merge_id").type)})

    return rows.groupBy("component").applyInArrow(run, rows.select("merge_id").schema)


def claimed(ready: DataFrame) -> DataFrame:
    """Of proposals (merge_id, sources) those that are approved if they are taken in order of id: no source is used twice.

    A round approves all that are the first for each of their sources, and drops what shares a
    source with one of them. What a few rounds leave are chains of proposals that overlap: their
    components are settled at once, each in a task that goes through its ids in order; only
    components of more than SETTLED proposals go on in rounds. merge_id is a long, unique.
    """
    left, done, rounds = kept(ready, "proposals"), [], 0
    while left.limit(1).count():
        if rounds >= ROUNDS:
            wanted = left.select("merge_id", F.explode("sources").alias("id"))
            first = wanted.groupBy("id").agg(F.min("merge_id").alias("first"))
            group = components(wanted.join(first, "id").select(F.col("merge_id").alias("a"), F.col("first").alias("b")))
            placed = kept(left.join(group.withColumnRenamed("id", "merge_id"), "merge_id", "left").withColumn("component", F.coalesce("component", "merge_id")), "placed")
            small = placed.groupBy("component").agg(F.count("*").alias("n")).filter(F.col("n") <= SETTLED).select("component")
            own = placed.join(small, "component", "left_semi")
            done.append(kept(left.join(_in_turn(own), "merge_id", "left_semi"), "approved"))
            left = kept(placed.join(small, "component", "left_anti").drop("component"), "proposals")
        wanted = left.select("merge_id", F.explode("sources").alias("id"))
        first = wanted.groupBy("id").agg(F.min("merge_id").alias("first"))
        lost = wanted.join(first, "id").filter(F.col("merge_id") != F.col("first")).select("merge_id").distinct()
        won = kept(left.join(lost, "merge_id", "left_anti"), "approved")
        done.append(won)
        used = won.select(F.explode("sources").alias("id")).distinct()
        gone = wanted.join(used, "id", "left_semi").select("merge_id").distinct()
        left, rounds = kept(left.join(gone, "merge_id", "left_anti"), "proposals"), rounds + 1
    out = left
    for won in done:
        out = out.unionByName(won)
    return out


def approved(memories: DataFrame, proposals: DataFrame, merges: DataFrame, now: Column, ids: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(memories, proposals, history) after approving pending proposals (or those of `ids`) whose sources all exist.

    Pure: new frames, the old ones stay. Sources become inactive and merged; each merge adds a
    canonical memory with a negative id. Of proposals that share a source the one of the smallest
    id is approved; the others stay pending.
    """
    pending = proposals.filter("status = 'pending'")
    pending = pending if ids is None else pending.join(ids.select("id"), "id", "left_semi")
    wanted = pending.select(F.col("id").alias("merge_id"), F.explode("sources").alias("id"))
    found = wanted.join(memories, "id").groupBy("merge_id").agg(F.count("*").alias("n"))
    ready = pending.join(found, pending["id"] == found["merge_id"]).filter(F.col("n") == F.size("sources")).select("merge_id", "sources")
    ready = claimed(ready.join(merges, "merge_id", "left_semi"))
    target = ready.select(F.explode("sources").alias("id"), (-1 - F.col("merge_id")).alias("into"))
    marked = memories.join(target, "id", "left")
    hit = F.col("into").isNotNull()
    into = F.coalesce("into", "merged_into") if "merged_into" in memories.columns else F.col("into")
    flags = {"is_merged": F.when(hit, True).otherwise(F.col("is_merged")), "is_active": F.when(hit, False).otherwise(F.col("is_active")), "merged_into": into}
    old = marked.withColumns(flags).select(*memories.columns, *([] if "merged_into" in memories.columns else ["merged_into"]))
    facts = memories.join(target, "id").groupBy("into").agg(F.min("project_id").alias("project_id"), F.round(F.avg(or_default(F.col("relevance"), 50))).cast("int").alias("relevance"), F.bool_or("has_secrets").alias("has_secrets"), F.bool_or("is_private").alias("is_private"), F.min("user_id").alias("user_id"))
    new = merges.join(ready.select("merge_id", (-1 - F.col("merge_id")).alias("into")), "merge_id").join(facts, "into").select(
        F.col("into").alias("id"), "content", "type", "tags", "project_id", "user_id", now.alias("created_at"), "relevance", F.lit(85).alias("confidence"), "is_private", "has_secrets",
        F.lit(True).alias("is_mergeable"), F.lit(False).alias("is_merged"), F.lit(True).alias("is_active"), F.lit(True).alias("is_canonical"),
    )
    done = ready.select(F.col("merge_id").alias("id"), F.lit("approved").alias("new"))
    status = proposals.join(done, "id", "left").withColumn("status", F.coalesce("new", "status")).drop("new")
    history = ready.select("merge_id", (-1 - F.col("merge_id")).alias("canonical_id"), "sources", now.alias("merged_at"), F.lit(False).alias("is_reversed"))
    return old.unionByName(new, allowMissingColumns=True), status, history


def rejected(proposals: DataFrame, ids: DataFrame, note: str = "Rejected by reviewer") -> DataFrame:
    """proposals with the given ids rejected, and a note."""
    hit = ids.select("id", F.lit(note).alias("note"))
    return proposals.join(hit, "id", "left").withColumn("status", F.when(F.col("note").isNotNull(), "rejected").otherwise(F.col("status")))


def reversed_merges(memories: DataFrame, history: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(memories, history) after undoing all merges not undone yet: flags only, contents stay."""
    undo = history.filter(~F.col("is_reversed"))
    sources = undo.select(F.explode("sources").alias("id"), F.lit(True).alias("was_source")).distinct()
    heads = undo.select(F.col("canonical_id").alias("id"), F.lit(True).alias("was_head"))
    m = memories.join(sources, "id", "left").join(heads, "id", "left")
    source, head = F.col("was_source").isNotNull(), F.col("was_head").isNotNull()
    back = {"is_merged": F.when(source, False).otherwise(F.col("is_merged")), "is_active": F.when(source, True).when(head, False).otherwise(F.col("is_active")), "is_canonical": F.when(head, False).otherwise(F.col("is_canonical")), "merged_into": F.when(~source, F.col("merged_into"))}
    return m.withColumns(back).select(*memories.columns), history.withColumn("is_reversed", F.lit(True))


def refreshed(cache: DataFrame, memories: DataFrame) -> DataFrame:
    """A cache (id, content_hash) brought up to date with memories (id, content): orphans go, missing and stale entries are made anew."""
    now = memories.select("id", F.md5(F.coalesce("content", F.lit(""))).alias("now"))
    joined = now.join(cache, "id", "left")
    return joined.select("id", F.col("now").alias("content_hash"), F.col("now").eqNullSafe(F.col("content_hash")).alias("was_fresh"))
