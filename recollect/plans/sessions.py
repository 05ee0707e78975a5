"""Queries on summaries, snapshots, privacy and injected context."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from recollect.functions import secrets as Y
from recollect.functions import text as X
from recollect.operators import sessions as S
from recollect.plans.registry import query
from recollect.sources import model as M

TYPES = ["incremental", "rolling", "final"]
_WORDS = "array_to_string(list_slice(regexp_split_to_array({0}, '[\\s\\x{{00a0}}\\x{{feff}}\\p{{Z}}]+'), 1, 10), ' ')"


def _summary_sql(keys: str, source: str) -> str:
    first, last = (_WORDS.format(c) for c in ("coalesce(first_text, '')", "coalesce(last_text, '')"))
    return f"""ext AS (SELECT {keys}, count(*) FILTER (WHERE role = 'user') AS n_user, count(*) FILTER (WHERE role = 'assistant') AS n_assistant,
 arg_min(content, turn) FILTER (WHERE role = 'user') AS first_text, arg_max(content, turn) FILTER (WHERE role = 'user') AS last_text, arg_max(created_at, turn) AS last_at FROM {source} GROUP BY {keys}),
 tool1 AS (SELECT {keys}, tool, min(turn) AS t FROM {source} WHERE tool IS NOT NULL GROUP BY {keys}, tool), tools AS (SELECT {keys}, string_agg(tool, ', ' ORDER BY t) AS tools FROM tool1 GROUP BY {keys}),
 tops AS (SELECT *, CASE WHEN {first} = {last} THEN [{first}] ELSE [{first}, {last}] END AS topics FROM ext),
 summ AS (SELECT {', '.join('s.' + k.strip() for k in keys.split(','))}, concat_ws('. ', CASE WHEN n_user > 0 THEN 'User prompts: ' || n_user END, CASE WHEN n_assistant > 0 THEN 'Assistant responses: ' || n_assistant END, 'Tools used: ' || tools,
 CASE WHEN len(list_filter(topics, lambda x: x <> '')) > 0 THEN 'Topics: ' || array_to_string(list_filter(topics, lambda x: x <> ''), '; ') END, 'Last activity: ' || strftime(last_at, '%Y-%m-%d %H:%M:%S')) AS summary FROM tops s LEFT JOIN tools USING ({keys}))"""


_INCREMENTAL = f"{M.MESSAGES_SQL}, c AS (SELECT *, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) // 3 AS chunk FROM msg), {_summary_sql('conv_id, chunk', 'c')}"
_ROLLING = f"{M.MESSAGES_SQL}, r AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS k FROM msg) WHERE k <= 4), {_summary_sql('conv_id', 'r')}"
_FINAL = f"{M.MESSAGES_SQL}, {_summary_sql('conv_id', 'msg')}"


@query("summary_incremental", rf"WITH {_INCREMENTAL} SELECT conv_id, string_agg(summary, chr(10) || '---' || chr(10) ORDER BY chunk) AS summary FROM summ GROUP BY conv_id")
def summary_incremental(spark, d):
    return S.incremental(M.messages(spark, d), 3)


@query("summary_rolling", f"WITH {_ROLLING} SELECT conv_id, summary FROM summ")
def summary_rolling(spark, d):
    return S.rolling(M.messages(spark, d), 4)


@query("summary_final", f"WITH {_FINAL} SELECT conv_id, summary FROM summ")
def summary_final(spark, d):
    return S.final(M.messages(spark, d))


_SAVED = f"WITH {_FINAL}, src AS (SELECT conv_id, count(*) AS compressed_from, CAST(sum(ceil(length(content) / 4.0)) AS BIGINT) AS source_tokens FROM msg GROUP BY 1), saved AS (SELECT conv_id, compressed_from, greatest(0, source_tokens - CAST(ceil(length(summary) / 4.0) AS BIGINT)) AS tokens_saved FROM summ JOIN src USING (conv_id))"


@query("summary_savings", f"{_SAVED} SELECT * FROM saved")
def summary_savings(spark, d):
    m = M.messages(spark, d)
    return S.with_savings(S.final(m), m).select("conv_id", "compressed_from", "tokens_saved")


@query("summary_stats", f"""{_SAVED}, t AS (SELECT *, (['incremental','rolling','final'])[CAST(conv_id % 3 AS INT) + 1] AS summary_type FROM saved)
 SELECT count(*) AS total, {', '.join(f"count(*) FILTER (WHERE summary_type = '{t}') AS n_{t}" for t in TYPES)}, CAST(sum(tokens_saved) AS BIGINT) AS tokens_saved, round(sum(tokens_saved / (compressed_from * 100.0)) / count(*), 6) AS mean_ratio FROM t""")
def summary_stats(spark, d):
    from recollect.operators.stats import summary_stats as stats

    m = M.messages(spark, d)
    return stats(S.with_savings(S.final(m), m).withColumn("summary_type", M.pick(TYPES, F.col("conv_id"))), TYPES)


_SNAP = "snap AS (SELECT d.doc_id AS id, d.text AS content, ['before','after','periodic'][CAST(d.doc_id % 3 AS INT) + 1] AS snapshot_type, TIMESTAMP '2024-01-01' + to_hours(d.doc_id) AS created_at, n.text AS next FROM documents d LEFT JOIN documents n ON n.doc_id = d.doc_id + 1)"


def _snapshots(spark, d):
    """Snapshots, each with the one that follows it."""
    docs = M.table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content"))
    after = docs.select((F.col("id") - 1).alias("id"), F.col("content").alias("next"))
    kinds = M.pick(["before", "after", "periodic"], F.col("id"))
    return docs.join(after, "id", "left").select("id", "content", kinds.alias("snapshot_type"), M.shifted(M.EPOCH, "HOUR", "id").alias("created_at"), "next")


@query("snapshot_diff", f"""WITH {_SNAP}, s AS (SELECT id, string_split(content, chr(10)) AS o, string_split(next, chr(10)) AS n FROM snap WHERE next IS NOT NULL)
 SELECT id, CAST(len(list_filter(n, lambda x: NOT list_contains(o, x))) AS INT) AS n_added, CAST(len(list_filter(o, lambda x: NOT list_contains(n, x))) AS INT) AS n_removed, md5(array_to_string(list_filter(n, lambda x: NOT list_contains(o, x)), chr(10))) AS added FROM s""")
def snapshot_diff(spark, d):
    diff = _snapshots(spark, d).filter("next is not null").select("id", S.line_diff(F.col("content"), F.col("next")).alias("d"))
    size = lambda c: F.coalesce(F.size(c), F.lit(0))
    return diff.select("id", size("d.added").alias("n_added"), size("d.removed").alias("n_removed"), F.md5(F.array_join(F.coalesce("d.added", F.array().cast("array<string>")), "\n")).alias("added"))


@query("snapshot_compare", f"WITH {_SNAP} SELECT id, substr(content, 1, 200) AS before, substr(next, 1, 200) AS after FROM snap WHERE next IS NOT NULL AND snapshot_type = 'after'")
def snapshot_compare(spark, d):
    return _snapshots(spark, d).filter("next is not null and snapshot_type = 'after'").select("id", F.substring("content", 1, 200).alias("before"), F.substring("next", 1, 200).alias("after"))


@query("snapshot_stats", f"""WITH {_SNAP} SELECT count(*) AS total, {', '.join(f"count(*) FILTER (WHERE snapshot_type = '{t}') AS n_{t}" for t in ("before", "after", "periodic"))}, strftime(min(created_at), '%Y-%m-%d %H:%M:%S') AS oldest, strftime(max(created_at), '%Y-%m-%d %H:%M:%S') AS newest FROM snap""")
def snapshot_stats(spark, d):
    return S.snapshot_stats(_snapshots(spark, d), ["before", "after", "periodic"])


@query("snapshots_newest", f"WITH {_SNAP} SELECT id, snapshot_type FROM snap ORDER BY created_at DESC, id DESC LIMIT 50")
def snapshots_newest(spark, d):
    return S.newest(_snapshots(spark, d), 50, "id").select("id", "snapshot_type")


@query("summaries_newest", f"WITH {M.MESSAGES_SQL} SELECT conv_id FROM msg GROUP BY conv_id ORDER BY max(created_at) DESC, conv_id DESC LIMIT 10")
def summaries_newest(spark, d):
    m = M.messages(spark, d)
    made = S.final(m).join(m.groupBy("conv_id").agg(F.max("created_at").alias("created_at")), "conv_id")
    return S.newest(made, 10, "conv_id").select("conv_id")


@query("snapshot_create", f"""WITH {M.MEMORIES_SQL}, s AS (SELECT id, string_split(content, chr(10)) AS o, string_split(replace(content, 'a', 'b') || chr(10) || 'end', chr(10)) AS n, type, sector FROM mem)
 SELECT id AS memory_id, type, sector, md5(array_to_string(list_filter(n, lambda x: NOT list_contains(o, x)), chr(10))) AS added, CAST(len(list_filter(o, lambda x: NOT list_contains(n, x))) AS INT) AS n_removed FROM s""")
def snapshot_create(spark, d):
    """Snapshots before and after a change of every memory; the later ones hold the difference."""
    m = M.memories(spark, d)
    before = S.snapshot(m, "before", M.at(M.EPOCH))
    changed = m.withColumn("content", F.concat(F.replace("content", F.lit("a"), F.lit("b")), F.lit("\nend")))
    after = S.snapshot(changed, "after", M.at(M.NOW), before)
    part = lambda name: F.get_json_object("metadata", f"$.{name}").alias(name)
    return after.select("memory_id", part("type"), part("sector"), F.md5(F.array_join(F.coalesce("diff.added", F.array().cast("array<string>")), "\n")).alias("added"), F.coalesce(F.size("diff.removed"), F.lit(0)).alias("n_removed"))


@query("every_tenth", "SELECT id, project_id FROM (SELECT event_id AS id, user_id AS project_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events) WHERE k % 10 = 0")
def every_tenth(spark, d):
    return S.every_nth(M.observations(spark, d), 10).select("id", "project_id")


_ANY = "|".join(f"(?:{p})" for p, _ in X.SECRETS.values())
_PATHS = ["*.env", "secrets/*", "src1/id9"]
_DENIED = "(ends_with(p, '.env') OR starts_with(p, 'secrets/') OR contains(p, '/secrets/') OR contains(p, 'src1/id9'))"
_PATH_SQL = "CASE WHEN doc_id % 10 = 3 THEN 'Secrets\\' || doc_id ELSE source || '/id' || doc_id || CASE WHEN doc_id % 10 = 5 THEN '.ENV' ELSE '.txt' END END"


def _paths(spark, d):
    i = F.col("doc_id")
    path = F.when(i % 10 == 3, F.concat(F.lit("Secrets\\"), i)).otherwise(F.concat("source", F.lit("/id"), i, F.when(i % 10 == 5, ".ENV").otherwise(".txt")))
    body = F.when(i % 6 == 0, F.concat(F.lit("<private>x"), i, F.lit("</private> "), "text")).when(i % 9 == 0, F.concat(F.lit("<SECRET>k</SECRET>"), "text")).otherwise(F.col("text"))
    return M.table(spark, d, "documents").select(i.alias("id"), body.alias("content"), path.alias("path"))


_BODY = "CASE WHEN doc_id % 6 = 0 THEN '<private>x' || doc_id || '</private> ' || text WHEN doc_id % 9 = 0 THEN '<SECRET>k</SECRET>' || text ELSE text END"
_DOCS = f"p AS (SELECT doc_id AS id, {_BODY} AS content, lower(replace({_PATH_SQL}, '\\', '/')) AS p FROM documents)"
_PRIVATE = "regexp_matches(content, '(?is)<private>.*?</private>|<secret>.*?</secret>')"


@query("privacy_report", f"""WITH {_DOCS}, c AS (SELECT *, {_PRIVATE} AS is_private, regexp_matches(content, '{_ANY}') AS has_secrets FROM p)
 SELECT id, is_private, has_secrets, CAST({' + '.join(f"len(regexp_extract_all(content, '{p}'))" for p, _ in X.SECRETS.values())} AS INT) AS n_secrets,
 concat_ws(',', {', '.join(f"CASE WHEN regexp_matches(content, '{p}') THEN '{k}' END" for k, (p, _) in X.SECRETS.items())}) AS kinds, NOT (is_private OR has_secrets OR {_DENIED}) AS should_store FROM c""")
def privacy_report(spark, d):
    """Each pattern is searched once; what follows from the counts is taken from them."""
    c = F.col("content")
    found = _paths(spark, d).select("id", X.has_private_tags(c).alias("is_private"), X.secret_counts(c).alias("counts"), X.denied(F.col("path"), _PATHS).alias("denied"))
    total = F.aggregate("counts", F.lit(0), lambda s, n: s + n)
    some = found.select("id", "is_private", "denied", "counts", total.cast("int").alias("n_secrets"))
    has = F.col("n_secrets") > 0
    return some.select("id", "is_private", has.alias("has_secrets"), "n_secrets", F.array_join(X.counted_kinds(F.col("counts")), ",").alias("kinds"), (~(F.col("is_private") | has | F.col("denied"))).alias("should_store"))


def _sanitize_sql() -> str:
    out = "regexp_replace(regexp_replace(content, '(?is)<private>.*?</private>', '[PRIVATE]', 'g'), '(?is)<secret>.*?</secret>', '[SECRET]', 'g')"
    for p, new in X.SECRETS.values():
        out = f"regexp_replace({out}, '{p}', '{new}', 'g')"
    return out


@query("sanitize", f"WITH {_DOCS} SELECT id, md5({_sanitize_sql()}) AS digest FROM p")
def sanitize(spark, d):
    return _paths(spark, d).select("id", F.md5(X.sanitized(F.col("content"))).alias("digest"))


def _spans_sql() -> str:
    """Spans of each pattern from the parts between its matches; overlaps go by who begins first, then by length and table."""
    every = " UNION ALL ".join(
        f"""SELECT id, '{k}' AS type, {i} AS place, unnest(list_transform(range(1, len(m) + 1), lambda j: {{'s': CAST(list_sum(list_transform(parts[1:j], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:j - 1], lambda x: length(x))), 0) AS BIGINT), 'n': CAST(length(m[j]) AS BIGINT)}})) AS v
 FROM (SELECT id, regexp_extract_all(content, '{p}') AS m, regexp_split_to_array(content, '{p}') AS parts FROM p)"""
        for i, (k, (p, _)) in enumerate(X.SECRETS.items())
    )
    return f"""every AS ({every}), ranked AS (SELECT id, type, v.s AS s, v.s + v.n AS e, row_number() OVER (PARTITION BY id ORDER BY v.s, v.n DESC, place) AS k FROM every),
 walk AS (SELECT id, CAST(0 AS BIGINT) AS k, CAST(0 AS BIGINT) AS last, CAST(NULL AS VARCHAR) AS type, CAST(NULL AS BIGINT) AS s, CAST(NULL AS BIGINT) AS e FROM (SELECT DISTINCT id FROM ranked)
 UNION ALL SELECT r.id, r.k, CASE WHEN r.s >= w.last THEN r.e ELSE w.last END, CASE WHEN r.s >= w.last THEN r.type END, r.s, r.e FROM walk w JOIN ranked r ON r.id = w.id AND r.k = w.k + 1),
 span AS (SELECT id, type, s, e FROM walk WHERE type IS NOT NULL)"""


@query("secret_spans", f'WITH RECURSIVE {_DOCS}, {_spans_sql()} SELECT id, type, s AS start, e AS "end" FROM span')
def secret_spans(spark, d):
    return Y.secret_spans(_paths(spark, d).select("id", "content"))


_STRIPPED = "regexp_replace(regexp_replace(content, '(?is)<private>.*?</private>', '[PRIVATE]', 'g'), '(?is)<secret>.*?</secret>', '[SECRET]', 'g')"
_SECOND = [(re.sub(r"\\u([0-9a-f]{4})", r"\\x{\1}", p), new) for p, new in Y.SECOND_PASS]


@query("redact", f"""WITH RECURSIVE raw AS (SELECT doc_id AS id, {_BODY} AS content FROM documents), p AS (SELECT id, {_STRIPPED} || ' api_key=K1 Bearer abc.def token: xyz,' AS content FROM raw), {_spans_sql()},
 cut AS (SELECT id, list(s ORDER BY s) AS ss, list(e ORDER BY s) AS es FROM span GROUP BY 1),
 done AS (SELECT p.id, CASE WHEN ss IS NULL THEN content ELSE array_to_string(list_transform(range(1, len(ss) + 2), lambda j: CASE WHEN j > len(ss) THEN substr(content, es[j - 1] + 1) ELSE substr(content, CAST(CASE WHEN j = 1 THEN 1 ELSE es[j - 1] + 1 END AS BIGINT), ss[j] - CASE WHEN j = 1 THEN 0 ELSE es[j - 1] END) END), '{Y.REDACTED}') END AS t FROM p LEFT JOIN cut ON cut.id = p.id)
 SELECT id, md5(regexp_replace(regexp_replace(t, '{_SECOND[0][0]}', '{_SECOND[0][1]}', 'g'), '{_SECOND[1][0]}', '{_SECOND[1][1]}', 'g')) AS digest FROM done""")
def redact(spark, d):
    """What is stored of each text: private parts, secrets by their places, names of keys and assignments of tokens replaced."""
    texts = _paths(spark, d).select("id", F.concat("content", F.lit(" api_key=K1 Bearer abc.def token: xyz,")).alias("content"))
    return texts.select("id", F.md5(Y.redacted(F.col("content"))).alias("digest"))


@query("deny_list", f"WITH {_DOCS} SELECT id FROM p WHERE {_DENIED}")
def deny_list(spark, d):
    return _paths(spark, d).filter(X.denied(F.col("path"), _PATHS)).select("id")


@query("storable_only", f"WITH {_DOCS} SELECT id FROM p WHERE NOT ({_PRIVATE} OR regexp_matches(content, '{_ANY}') OR {_DENIED})")
def storable_only(spark, d):
    return _paths(spark, d).filter(X.storable(F.col("content"), F.col("path"), _PATHS)).select("id")


@query("storable_nulls", f"WITH {_DOCS} SELECT id FROM p WHERE id % 4 = 0 OR NOT ({_PRIVATE} OR regexp_matches(content, '{_ANY}') OR {_DENIED})")
def storable_nulls(spark, d):
    """A null text holds nothing that forbids storing it, nor does a null path."""
    gone = lambda c: F.when(F.col("id") % 4 != 0, F.col(c))
    return _paths(spark, d).filter(X.storable(gone("content"), gone("path"), _PATHS)).select("id")


@query("tag_round_trip", "SELECT doc_id AS id, lang || '|' || source AS tags FROM documents")
def tag_round_trip(spark, d):
    return M.memories(spark, d).select("id", F.array_join(X.tags_from_text(X.tags_text(F.col("tags"))), "|").alias("tags"))


@query("tag_parsing", """SELECT doc_id AS id, lang || '|' || source AS tags FROM documents""")
def tag_parsing(spark, d):
    raw = F.when(F.col("doc_id") % 2 == 0, F.to_json(F.array("lang", F.lit(" "), "source"))).otherwise(F.concat("lang", F.lit(" ,, "), "source"))
    return M.table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.array_join(X.tags_from_text(raw), "|").alias("tags"))


@query("captured_observations", """SELECT event_id AS id, 'used ' || event_type || ' on ' || user_id AS summary, substr(props, 1, 200) AS details FROM events WHERE event_type <> 'error'""")
def captured_observations(spark, d):
    from recollect.streaming.capture import captured

    return captured(M.observations(spark, d)).select("id", "summary", "details")


@query("injection_lines", f"""WITH {M.MEMORIES_SQL} SELECT id, '- [' || type || '] ' || replace(substr(content, 1, 100), chr(10), ' ') || '...' AS line, CAST(ceil(len(regexp_split_to_array(content, '[\\s\\x{{00a0}}\\x{{feff}}\\p{{Z}}]+')) * 1.3) AS BIGINT) AS tokens FROM mem""")
def injection_lines(spark, d):
    c = F.col("content")
    line = F.concat(F.lit("- ["), "type", F.lit("] "), F.replace(F.substring("content", 1, 100), F.lit("\n"), F.lit(" ")), F.lit("..."))
    return M.memories(spark, d).select("id", line.alias("line"), X.tokens_by_words(c).cast("long").alias("tokens"))
