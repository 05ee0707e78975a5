"""Queries on near-duplicate detection, merging and proposals."""

from __future__ import annotations

from pyspark.sql import functions as F

from recollect.functions import embedding as E
from recollect.functions import hashing as H
from recollect.functions import scoring as C
from recollect.functions.text import text_length, tokens_by_length, word_set
from recollect.operators import clusters as K
from recollect.operators import detect as D
from recollect.operators import merging as G
from recollect.operators import tiles as T
from recollect.operators.incremental import Duplicates
from recollect.operators.search import top
from recollect.plans.registry import query
from recollect.sources import model as M
from recollect.sources.storage import fresh

_TERMS = "term AS (SELECT doc_id AS id, t, count(*) AS tf FROM (SELECT doc_id, unnest(regexp_split_to_array(lower(text), '[^a-z0-9_]+')) AS t FROM documents) WHERE t <> '' GROUP BY 1, 2)"
_HASHED = _TERMS + ", hashed AS (SELECT id, tf, CAST('0x' || substr(md5(t), 1, 8) AS BIGINT) AS h0, CAST('0x' || substr(md5(t), 9, 8) AS BIGINT) AS h1 FROM term)"
_BITS = ", ".join(f"sum(CASE WHEN (h{b // 32} & {1 << b % 32}) <> 0 THEN tf ELSE -tf END) AS b{b}" for b in range(64))
_VALUE = " | ".join(f"CASE WHEN b{b} > 0 THEN {'CAST(-9223372036854775808 AS BIGINT)' if b == 63 else f'CAST({1 << b} AS BIGINT)'} ELSE CAST(0 AS BIGINT) END" for b in range(64))
_SIMHASH = f"{_HASHED}, summed AS (SELECT id, {_BITS} FROM hashed GROUP BY id), sim AS (SELECT d.doc_id AS id, coalesce({_VALUE}, 0) AS simhash FROM documents d LEFT JOIN summed s ON s.id = d.doc_id)"


def _content(spark, d):
    return M.table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content"))


@query("simhash", f"WITH {_SIMHASH} SELECT id, simhash FROM sim")
def simhash(spark, d):
    return H.simhash(_content(spark, d))


@query("simhash_literal")
def simhash_literal(spark, d):
    return H.literal_simhash(_content(spark, d))


@query("simhash_pairs", f"""WITH {_SIMHASH}, v AS (SELECT simhash, min(id) AS id FROM sim WHERE simhash <> 0 GROUP BY 1)
 SELECT a.id AS id_a, b.id AS id_b, CAST(bit_count(xor(a.simhash, b.simhash)) AS INT) AS distance FROM v a JOIN v b ON a.id < b.id WHERE bit_count(xor(a.simhash, b.simhash)) <= 4""")
def simhash_pairs(spark, d):
    return D.hamming_pairs(H.simhash(_content(spark, d)))


@query("simhash_groups", f"WITH {_SIMHASH} SELECT id, min(id) OVER (PARTITION BY simhash) AS first_id FROM sim")
def simhash_groups(spark, d):
    return D.print_groups(H.simhash(_content(spark, d)), "simhash")


@query("minhash_compat_groups", """WITH g AS (SELECT doc_id AS id, CASE WHEN trim(text) = '' THEN '' ELSE list_min(list_transform(range(1, length(text) + 3), lambda i: substr('  ' || lower(text) || '  ', CAST(i AS INT), 3))) END AS gram FROM documents)
 SELECT id, min(id) OVER (PARTITION BY gram) AS first_id FROM g""")
def minhash_compat_groups(spark, d):
    return D.print_groups(_content(spark, d).select("id", H.leading_gram(F.col("content")).alias("gram")), "gram")


_SIG = H.minhash_sql()
_NEED = -(-7 * H.HASHES // 10)
_EQUAL = "len(list_filter(list_zip(a.minhash, b.minhash), lambda x: x[1] = x[2]))"


@query("minhash_lsh_pairs", f"""WITH {_SIG}, v AS (SELECT minhash, min(id) AS id FROM sig GROUP BY 1)
 SELECT a.id AS id_a, b.id AS id_b, {_EQUAL} / {H.HASHES}.0 AS similarity FROM v a JOIN v b ON a.id < b.id WHERE {_EQUAL} >= {_NEED}""")
def minhash_lsh_pairs(spark, d):
    return D.minhash_pairs(_content(spark, d).select("id", H.minhash(F.col("content")).alias("minhash")))


@query("minhash_groups", f"WITH {_SIG} SELECT id, min(id) OVER (PARTITION BY minhash) AS first_id FROM sig")
def minhash_groups(spark, d):
    return D.print_groups(_content(spark, d).select("id", H.minhash(F.col("content")).alias("minhash")), "minhash")


@query("simhash_candidates", f"WITH {_SIMHASH} SELECT b.id, CAST(bit_count(xor(a.simhash, b.simhash)) AS INT) AS distance FROM sim a JOIN sim b ON b.id <> a.id WHERE a.id = 7 AND bit_count(xor(a.simhash, b.simhash)) <= 8")
def simhash_candidates(spark, d):
    return D.simhash_candidates(H.simhash(_content(spark, d)), 7, 8)


@query("minhash_candidates", f"WITH {_SIG} SELECT b.id, {_EQUAL} / {H.HASHES}.0 AS similarity FROM sig a JOIN sig b ON b.id <> a.id WHERE a.id = 7 AND {_EQUAL} / {H.HASHES}.0 >= 0.4")
def minhash_candidates(spark, d):
    return D.minhash_candidates(_content(spark, d).select("id", H.minhash(F.col("content")).alias("minhash")), 7, 0.4)


@query("hash_cache", "SELECT doc_id AS id, md5(text) AS content_hash, length(text) AS n FROM documents")
def hash_cache(spark, d):
    return _content(spark, d).select("id", F.md5("content").alias("content_hash"), text_length(F.col("content")).alias("n"))


@query("hash_cache_stale", "SELECT doc_id AS id FROM documents WHERE md5(text) <> md5(CASE WHEN doc_id % 9 = 0 THEN text || 'x' ELSE text END) OR doc_id % 10 = 7")
def hash_cache_stale(spark, d):
    memories = _content(spark, d)
    cache = memories.filter("id % 10 <> 7").select("id", F.md5(F.when(F.col("id") % 9 == 0, F.concat("content", F.lit("x"))).otherwise(F.col("content"))).alias("content_hash"))
    return memories.join(cache, "id", "left").filter(~F.md5("content").eqNullSafe(F.col("content_hash"))).select("id")


@query("orphan_cache", "SELECT l.doc_id AS id FROM labels l WHERE l.doc_id NOT IN (SELECT doc_id FROM documents WHERE lang = 'en')")
def orphan_cache(spark, d):
    cache = M.table(spark, d, "labels").select(F.col("doc_id").alias("id"))
    return cache.join(M.table(spark, d, "documents").filter("lang = 'en'").select(F.col("doc_id").alias("id")), "id", "left_anti")


_TF = """tw AS (SELECT doc_id AS id, list_slice(list_filter(regexp_split_to_array(lower(text), '[\\s\\x{00a0}\\x{feff}\\p{Z}]+'), lambda x: length(x) > 2), 1, 100) AS words FROM documents),
 tb AS (SELECT id, CAST('0x' || substr(md5(t), 1, 8) AS BIGINT) % 1536 AS bucket, count(*) AS tf FROM (SELECT id, unnest(words) AS t FROM tw) GROUP BY 1, 2), tn AS (SELECT id, sqrt(sum(tf * tf)) AS norm FROM tb GROUP BY 1),
 tfw AS (SELECT tb.id, tb.bucket, tf / norm AS weight FROM tb JOIN tn ON tn.id = tb.id)"""


@query("tf_embedding", f"WITH {_TF} SELECT id, bucket, round(weight, 6) AS weight FROM tfw")
def tf_embedding(spark, d):
    return E.embedded(_content(spark, d)).withColumn("weight", F.round("weight", 6))


@query("tf_dense", f"WITH {_TF} SELECT id, CAST(1536 AS INT) AS size, round(sum(weight), 6) AS total, round(sum(weight * bucket), 4) AS moment FROM tfw GROUP BY id")
def tf_dense(spark, d):
    v = E.dense(E.embedded(_content(spark, d)))
    total = F.aggregate("v", F.lit(0.0), lambda s, x: s + x)
    moment = F.aggregate(F.transform("v", lambda x, k: x * k), F.lit(0.0), lambda s, x: s + x)
    return v.select("id", F.size("v").alias("size"), F.round(total, 6).alias("total"), F.round(moment, 4).alias("moment"))


@query("stub_embedding", "SELECT doc_id AS id, CAST(0 AS BIGINT) AS bucket, 0.0 AS weight FROM documents WHERE false")
def stub_embedding(spark, d):
    return E.embedded(_content(spark, d), "stub")


_VECS = "e AS (SELECT vec_id AS id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)"
_PAIRS = f"{M.MEMORIES_SQL}, {_VECS}, info AS (SELECT m.id, type, tags, length(content) AS len, v FROM mem m JOIN e ON e.id = m.id), pr AS (SELECT sources[1] AS id_a, sources[2] AS id_b FROM ({M.PROPOSALS_SQL[len('prop AS ('):-1]})), sc AS (SELECT id_a, id_b, a.type AS type_a, b.type AS type_b, list_cosine_similarity(a.v, b.v) AS similarity, a.tags AS ta, b.tags AS tb, a.len AS la, b.len AS lb FROM pr JOIN info a ON a.id = id_a JOIN info b ON b.id = id_b), f AS (SELECT *, len(list_intersect(ta, tb)) / CAST(len(list_distinct(list_concat(ta, tb))) AS DOUBLE) AS overlap, CASE WHEN greatest(la, lb) = 0 THEN 1.0 ELSE least(la, lb) / CAST(greatest(la, lb) AS DOUBLE) END AS ratio FROM sc), lv AS (SELECT *, CASE WHEN similarity >= 0.9 THEN CASE WHEN type_a = type_b OR overlap > 0.3 THEN 'high' ELSE 'medium' END WHEN similarity >= 0.8 THEN 'medium' ELSE 'low' END AS level FROM f)"


def _described(spark, d):
    pairs = M.proposals(spark, d).select(F.col("sources")[0].alias("id_a"), F.col("sources")[1].alias("id_b"))
    return D.described(pairs, M.memories(spark, d), M.embeddings(spark, d))


@query("cosine_pairs", f"WITH {_PAIRS} SELECT id_a, id_b, round(similarity, 6) AS similarity FROM lv")
def cosine_pairs(spark, d):
    return _described(spark, d).select("id_a", "id_b", F.round("similarity", 6).alias("similarity"))


@query("confidence_level", f"WITH {_PAIRS} SELECT id_a, id_b, level, round(overlap, 6) AS overlap, round(ratio, 6) AS ratio FROM lv")
def confidence_level(spark, d):
    return _described(spark, d).select("id_a", "id_b", "level", F.round("overlap", 6).alias("overlap"), F.round("ratio", 6).alias("ratio"))


@query("merge_reason", f"""WITH {_PAIRS} SELECT id_a, id_b, concat_ws(' • ', printf('Semantic similarity: %.1f%%', similarity * 100), CASE WHEN type_a = type_b THEN 'Same type (' || type_a || ')' ELSE 'Different types (' || type_a || ' vs ' || type_b || ')' END,
 CASE WHEN overlap > 0 THEN printf('%d%% tag overlap', CAST(round(overlap * 100) AS BIGINT)) END, printf('Content length difference: %d%%', CAST(round((1 - ratio) * 100) AS BIGINT)), 'Confidence: ' || level) AS reason FROM lv""")
def merge_reason(spark, d):
    return _described(spark, d).select("id_a", "id_b", "reason")


#: Word sets, the pairs of a project that are alike, and the pass in order of id: each row is a seed unless an earlier seed is like it.
_SEEDS = f"""{M.MEMORIES_SQL}, ws AS (SELECT project_id, id, row_number() OVER (PARTITION BY project_id ORDER BY id) AS k, list_distinct(list_filter(regexp_split_to_array(lower(content), '[\\s\\x{{00a0}}\\x{{feff}}\\p{{Z}}]+'), lambda w: length(w) > 2)) AS w FROM mem),
 tok AS (SELECT project_id, k, len(w) AS n, unnest(w) AS t FROM ws), alike AS (SELECT project_id, j, k FROM (SELECT a.project_id, a.k AS j, b.k AS k, count(*) AS c, any_value(a.n) AS na, any_value(b.n) AS nb FROM tok a JOIN tok b ON a.project_id = b.project_id AND a.t = b.t AND a.k < b.k GROUP BY 1, 2, 3) WHERE c > 0.8 * (na + nb - c)),
 near AS (SELECT ws.project_id, ws.k, ws.id, list(j) FILTER (WHERE j IS NOT NULL) AS js FROM ws LEFT JOIN alike ON alike.project_id = ws.project_id AND alike.k = ws.k GROUP BY 1, 2, 3),
 pass AS (SELECT DISTINCT project_id, 0 AS k, CAST([] AS BIGINT[]) AS seeds FROM near UNION ALL SELECT pass.project_id, near.k, CASE WHEN coalesce(list_has_any(seeds, js), false) THEN seeds ELSE list_append(seeds, near.k) END FROM pass JOIN near ON near.project_id = pass.project_id AND near.k = pass.k + 1),
 last AS (SELECT project_id, arg_max(seeds, k) AS seeds FROM pass GROUP BY 1),
 home AS (SELECT near.project_id, near.id, coalesce(list_min(list_intersect(js, seeds)), near.k) AS s FROM near JOIN last USING (project_id)),
 cluster AS (SELECT home.project_id, near.id AS seed, home.id FROM home JOIN near ON near.project_id = home.project_id AND near.k = home.s)"""


@query("jaccard_clusters", f"WITH RECURSIVE {_SEEDS} SELECT * FROM cluster")
def jaccard_clusters(spark, d):
    return K.seed_clusters(M.texts(spark, d).select("project_id", "id", "content"))


@query("token_recovery", f"""WITH RECURSIVE {_SEEDS}, cost AS (SELECT cluster.*, (length(content) + length(regexp_replace(content, '[^\\x{{10000}}-\\x{{10FFFF}}]', '', 'g')) + 3) // 4 AS t FROM cluster JOIN mem ON mem.id = cluster.id),
 c AS (SELECT project_id, seed, sum(t) AS total, max(t) FILTER (WHERE id = seed) AS kept, count(*) AS n FROM cost GROUP BY 1, 2)
 SELECT project_id, CAST(sum(total - kept) AS BIGINT) AS recovered, count(*) FILTER (WHERE n > 1) AS clusters FROM c GROUP BY 1""")
def token_recovery(spark, d):
    m = M.texts(spark, d).select("project_id", "id", "content")
    tokens = m.select("id", tokens_by_length(F.col("content")).alias("t"))
    clusters = K.seed_clusters(m).join(tokens, "id").groupBy("project_id", "seed").agg(F.sum("t").alias("total"), F.max(F.when(F.col("id") == F.col("seed"), F.col("t"))).alias("kept"), F.count("*").alias("n"))
    return clusters.groupBy("project_id").agg(F.sum(F.col("total") - F.col("kept")).alias("recovered"), F.count_if(F.col("n") > 1).alias("clusters"))


@query("jaccard_clusters_whole", f"WITH RECURSIVE {_SEEDS.replace('d.source AS project_id', 'd.lang AS project_id')} SELECT * FROM cluster")
def jaccard_clusters_whole(spark, d):
    """All memories of a language as one project: large groups, of very different sizes."""
    m = M.texts(spark, d)
    return K.seed_clusters(m.select(F.element_at("tags", 1).alias("project_id"), "id", "content"))


_SRC = f"{M.MEMORIES_SQL}, src AS (SELECT id // 15 * 5 + id % 5 AS merge_id, * FROM mem)"


def _sources(spark, d):
    """Groups of three memories of one type."""
    return M.memories(spark, d).withColumn("merge_id", F.floor(F.col("id") / 15) * 5 + F.pmod("id", F.lit(5)))


_MD5 = "md5(content) AS digest, len(content) AS n_chars, summary"


def _merge_sql(kind: str, content: str, summary: str, warnings: str = "0", tags: str | None = None) -> str:
    tags = tags or "(SELECT string_agg(t, '|' ORDER BY f) FROM (SELECT t, min(pos) AS f FROM (SELECT unnest(flat) AS t, generate_subscripts(flat, 1) AS pos) GROUP BY t))"
    return f"""WITH {_SRC}, g AS (SELECT merge_id, list(content ORDER BY created_at, id) AS cs, flatten(list(tags ORDER BY created_at, id)) AS flat, arg_max(tags, id) AS last_tags, count(*) AS n FROM src WHERE type = '{kind}' GROUP BY merge_id HAVING count(*) >= 2),
 r AS (SELECT merge_id, {content} AS content, {summary} AS summary, CAST({warnings} AS INT) AS n_warnings, {tags} AS tags FROM g)
 SELECT merge_id, md5(content) AS digest, md5(summary) AS summary, n_warnings, tags FROM r"""


def _merge(spark, d, kind):
    rows = G.STRATEGIES[kind](G.grouped(_sources(spark, d).filter(F.col("type") == kind)).filter("n >= 2"))
    return rows.select("merge_id", F.md5("content").alias("digest"), F.md5("summary").alias("summary"), F.size("warnings").alias("n_warnings"), F.array_join("tags", "|").alias("tags"))


_SENTENCES = "list_filter(list_transform(flatten(list_transform(cs, lambda c: regexp_split_to_array(c, '[.!?]\\s+'))), lambda s: trim(s)), lambda s: s <> '')"


@query("merge_fact", _merge_sql("fact", f"array_to_string(list_sort(list_distinct({_SENTENCES})), '. ') || '.'", "'Merged ' || n || ' facts'"))
def merge_fact(spark, d):
    return _merge(spark, d, "fact")


@query("merge_preference", _merge_sql("preference", "cs[-1]", "'Prefers: ' || cs[-1] || ' (evolved from ' || n || ' preferences)'", "CASE WHEN len(list_distinct(cs)) > 1 THEN 2 ELSE 0 END", "array_to_string(last_tags, '|')"))
def merge_preference(spark, d):
    return _merge(spark, d, "preference")


@query("merge_decision", _merge_sql("decision", "cs[-1]", "'Decided: ' || cs[-1] || ' (' || n || ' decisions)'", "CASE WHEN cs[1] <> cs[-1] THEN 1 ELSE 0 END", "array_to_string(last_tags, '|')"))
def merge_decision(spark, d):
    return _merge(spark, d, "decision")


@query("merge_observation", _merge_sql("observation", "'Observations (' || n || ' total):' || chr(10) || array_to_string(list_transform(cs, lambda c: '- ' || c), chr(10))", "n || ' observations over time period'"))
def merge_observation(spark, d):
    return _merge(spark, d, "observation")


@query("merge_context", _merge_sql("context", "array_to_string(list_transform(list_sort(list_distinct(cs)), lambda c: '- ' || c), chr(10))", "len(list_distinct(cs)) || ' context items (' || n || ' total)'"))
def merge_context(spark, d):
    return _merge(spark, d, "context")


@query("tokens_saved", f"""WITH {_SRC}, t AS (SELECT merge_id, sum(CAST(ceil(length(content) / 4.0) AS BIGINT) + CAST(ceil(length(array_to_string(tags, ' ')) / 4.0) AS BIGINT) + 25) AS source_tokens, arg_max(content, id) AS c, arg_max(tags, id) AS t, count(*) AS n FROM src WHERE type = 'decision' GROUP BY 1 HAVING count(*) >= 2),
 m AS (SELECT merge_id, source_tokens, CAST(ceil(length(c) / 4.0) + ceil(length('Decided: ' || c || ' (' || n || ' decisions)') / 4.0) + ceil(length(array_to_string(t, ' ')) / 4.0) AS BIGINT) + 25 AS merged_tokens FROM t)
 SELECT merge_id, CAST(source_tokens AS BIGINT) AS source_tokens, merged_tokens, CAST(greatest(0, source_tokens - merged_tokens) AS BIGINT) AS tokens_saved FROM m""")
def tokens_saved(spark, d):
    rows = G.merged(G.grouped(_sources(spark, d).filter("type = 'decision'")))
    return G.saved_tokens(rows).select("merge_id", "source_tokens", "merged_tokens", "tokens_saved")


@query("tokens_saved_whole", f"""WITH {_SRC}, x AS (SELECT *, CASE WHEN id % 2 = 0 THEN 'about ' || project_id END AS note, CASE WHEN id % 3 <> 0 THEN '{{"lang":"' || tags[1] || '","user":"' || user_id || '"}}' END AS meta FROM src),
 t AS (SELECT merge_id, sum(CAST(ceil(length(content) / 4.0) + ceil(coalesce(length(note), 0) / 4.0) + ceil(length(array_to_string(tags, ' ')) / 4.0) + ceil(coalesce(length(meta), 0) / 4.0) AS BIGINT) + 25) AS source_tokens, arg_max(content, id) AS c, arg_max(tags, id) AS t, count(*) AS n FROM x WHERE type = 'decision' GROUP BY 1 HAVING count(*) >= 2),
 m AS (SELECT merge_id, source_tokens, CAST(ceil(length(c) / 4.0) + ceil(length('Decided: ' || c || ' (' || n || ' decisions)') / 4.0) + ceil(length(array_to_string(t, ' ')) / 4.0) AS BIGINT) + 25 AS merged_tokens FROM t)
 SELECT merge_id, CAST(source_tokens AS BIGINT) AS source_tokens, merged_tokens, CAST(greatest(0, source_tokens - merged_tokens) AS BIGINT) AS tokens_saved FROM m""")
def tokens_saved_whole(spark, d):
    """Savings where sources have summaries and metadata."""
    note = F.when(F.col("id") % 2 == 0, F.concat(F.lit("about "), "project_id"))
    meta = F.when(F.col("id") % 3 != 0, F.create_map(F.lit("lang"), F.col("tags")[0], F.lit("user"), F.col("user_id").cast("string")))
    rows = G.merged(G.grouped(_sources(spark, d).filter("type = 'decision'").withColumns({"summary": note, "metadata": meta})))
    return G.saved_tokens(rows).select("merge_id", "source_tokens", "merged_tokens", "tokens_saved")


@query("token_report", f"""WITH {M.MEMORIES_SQL}, t AS (SELECT project_id, CAST(sum(ceil(length(content) / 4.0)) AS BIGINT) AS n FROM mem GROUP BY 1)
 SELECT project_id, CASE WHEN n < 1000 THEN n || ' tokens (' || (q // 1000) || '.' || lpad(CAST(q % 1000 AS VARCHAR), 3, '0') || '% of context)' ELSE (k // 10) || '.' || (k % 10) || 'k tokens (' || (r // 10) || '.' || (r % 10) || '% of typical recall window)' END AS report FROM (SELECT *, (n * 1000 * 2 + 1280) // 2560 AS q, (n + 50) // 100 AS k, (n * 20 + 320) // 640 AS r FROM t)""")
def token_report(spark, d):
    t = M.memories(spark, d).groupBy("project_id").agg(F.sum(tokens_by_length(F.col("content"))).alias("n"))
    return t.select("project_id", C.tokens_text(F.col("n")).alias("report"))


_CHECKS = f"""WITH {M.MEMORIES_SQL}, {M.PROPOSALS_SQL}, s AS (SELECT p.id AS merge_id, p.similarity, m.* FROM (SELECT id, similarity, unnest(sources) AS source FROM prop) p JOIN mem m ON m.id = p.source),
 c AS (SELECT merge_id, count(*) FILTER (WHERE NOT is_mergeable) AS fixed, list_sort(list(DISTINCT type)) AS kinds, count(*) FILTER (WHERE is_merged) AS done, min(similarity) AS similarity, count(DISTINCT user_id) AS users,
 count(*) FILTER (WHERE is_private) AS private, count(*) AS n, count(*) FILTER (WHERE has_secrets) AS secret, count(*) FILTER (WHERE NOT is_active) AS inactive FROM s GROUP BY 1),
 b AS (SELECT merge_id, list_filter([CASE WHEN fixed > 0 THEN fixed || ' memories are immutable' END, CASE WHEN len(kinds) > 1 THEN 'Cannot merge different types: ' || array_to_string(kinds, ', ') END, CASE WHEN done > 0 THEN done || ' memories are already merged' END,
 CASE WHEN similarity < 0.7 THEN 'Similarity is below 0.7' END, CASE WHEN inactive > 0 THEN inactive || ' memories are inactive' END], lambda x: x IS NOT NULL) AS blockers,
 list_filter([CASE WHEN users > 1 THEN 'Merging memories from ' || users || ' different users' END, CASE WHEN private > 0 AND private < n THEN 'Mixing private and public memories' END, CASE WHEN secret > 0 THEN secret || ' memories hold secrets' END], lambda x: x IS NOT NULL) AS warnings FROM c)"""


@query("safety_checks", f"{_CHECKS} SELECT merge_id, len(blockers) = 0 AS passed, array_to_string(blockers, '; ') AS blockers, array_to_string(warnings, '; ') AS warnings FROM b")
def safety_checks(spark, d):
    p = M.proposals(spark, d).select(F.col("id").alias("merge_id"), "similarity", F.explode("sources").alias("id"))
    checked = G.safety(p.join(M.memories(spark, d), "id"), similarity=F.col("similarity"))
    return checked.select("merge_id", "passed", F.array_join("blockers", "; ").alias("blockers"), F.array_join("warnings", "; ").alias("warnings"))


@query("list_proposals", f"WITH {M.PROPOSALS_SQL} SELECT id, similarity, strftime(created_at, '%Y-%m-%d %H:%M:%S') AS created FROM prop WHERE status = 'pending' ORDER BY created_at DESC, id DESC LIMIT 20")
def list_proposals(spark, d):
    return G.listed(M.proposals(spark, d), status="pending").select("id", "similarity", M.shown("created_at").alias("created"))


def _owned(spark, d):
    """Proposals with the project of their first source."""
    owner = M.memories(spark, d).select(F.col("id").alias("first"), "project_id")
    return M.proposals(spark, d).withColumn("first", F.col("sources")[0]).join(owner, "first").drop("first")


@query("list_project_proposals", f"""WITH {M.MEMORIES_SQL}, {M.PROPOSALS_SQL} SELECT p.id, strftime(p.created_at, '%Y-%m-%d %H:%M:%S') AS created FROM prop p JOIN mem m ON m.id = p.sources[1]
 WHERE m.project_id = 'src8' AND status = 'pending' ORDER BY p.created_at DESC, p.id DESC LIMIT 7""")
def list_project_proposals(spark, d):
    return G.listed(_owned(spark, d), "src8", "pending", 7).select("id", M.shown("created_at").alias("created"))


@query("expired_proposals", f"WITH {M.PROPOSALS_SQL} SELECT id FROM prop WHERE status = 'pending' AND date_diff('second', created_at, TIMESTAMP '{M.NOW}') / 86400.0 > 7")
def expired_proposals(spark, d):
    return M.proposals(spark, d).filter((F.col("status") == "pending") & (C.age_days(F.col("created_at"), M.at(M.NOW)) > 7)).select("id")


@query("reject_merge", f"WITH {M.PROPOSALS_SQL} SELECT id, CASE WHEN similarity < 0.6 THEN 'rejected' ELSE status END AS status, CASE WHEN similarity < 0.6 THEN 'too far' END AS note FROM prop")
def reject_merge(spark, d):
    p = M.proposals(spark, d)
    return G.rejected(p, p.filter("similarity < 0.6"), "too far").select("id", "status", "note")


def _approval(spark, d):
    """Pending proposals over pairs of one type: documents 10k and 10k + 5."""
    m = M.memories(spark, d)
    key = F.floor(F.col("id") / 10) * 5 + F.pmod("id", F.lit(5))
    sources = m.withColumn("merge_id", key)
    p = sources.groupBy(F.col("merge_id").alias("id")).agg(F.sort_array(F.collect_list("id")).alias("sources")).withColumn("status", M.pick(M.STATUSES, F.col("id")))
    p = p.filter(F.size("sources") == 2)
    return m, p, G.merged(G.grouped(sources)).select("merge_id", "content", "type", "tags")


_APPROVAL = f"{M.MEMORIES_SQL}, pa AS (SELECT id // 10 * 5 + id % 5 AS pid, list(id ORDER BY id) AS sources FROM mem GROUP BY 1 HAVING count(*) = 2), ps AS (SELECT pid, sources FROM pa WHERE pid % 4 = 0), hit AS (SELECT unnest(sources) AS id, -1 - pid AS into_id FROM ps)"


@query("approve_merge", f"""WITH {_APPROVAL} SELECT m.id, m.is_merged OR h.id IS NOT NULL AS is_merged, m.is_active AND h.id IS NULL AS is_active, is_canonical, h.into_id AS merged_into, relevance FROM mem m LEFT JOIN hit h ON h.id = m.id
 UNION ALL SELECT h.into_id, false, true, true, NULL, CAST(round(avg(CASE WHEN m.relevance = 0 THEN 50 ELSE m.relevance END)) AS INT) FROM hit h JOIN mem m ON m.id = h.id GROUP BY h.into_id""")
def approve_merge(spark, d):
    return G.approved(*_approval(spark, d), M.at(M.NOW))[0].select("id", "is_merged", "is_active", "is_canonical", "merged_into", "relevance")


@query("approve_status", f"WITH {_APPROVAL} SELECT pid AS id, CASE WHEN pid % 4 = 0 THEN 'approved' ELSE (['pending','approved','rejected','expired'])[CAST(pid % 4 AS INT) + 1] END AS status FROM pa")
def approve_status(spark, d):
    return G.approved(*_approval(spark, d), M.at(M.NOW))[1].select("id", "status")


@query("reverse_merge", f"""WITH {_APPROVAL} SELECT m.id, m.is_merged AND h.id IS NULL AS is_merged, m.is_active OR h.id IS NOT NULL AS is_active, is_canonical FROM mem m LEFT JOIN hit h ON h.id = m.id
 UNION ALL SELECT DISTINCT into_id, false, false, false FROM hit""")
def reverse_merge(spark, d):
    memories, _, history = G.approved(*_approval(spark, d), M.at(M.NOW))
    return G.reversed_merges(memories, history)[0].select("id", "is_merged", "is_active", "is_canonical")


_TAGS_OF = "(SELECT list(t ORDER BY f) FROM (SELECT t, min(pos) AS f FROM (SELECT unnest(flat) AS t, generate_subscripts(flat, 1) AS pos) GROUP BY t))"
#: Merges of groups g (merge_id, cs, flat, last_tags, n, kind, source_tokens) in SQL.
_MERGED = f"""mc AS (SELECT *, CASE kind WHEN 'fact' THEN array_to_string(list_sort(list_distinct({_SENTENCES})), '. ') || '.' WHEN 'observation' THEN 'Observations (' || n || ' total):' || chr(10) || array_to_string(list_transform(cs, lambda c: '- ' || c), chr(10))
 WHEN 'context' THEN array_to_string(list_transform(list_sort(list_distinct(cs)), lambda c: '- ' || c), chr(10)) ELSE cs[-1] END AS content,
 CASE kind WHEN 'fact' THEN 'Merged ' || n || ' facts' WHEN 'observation' THEN n || ' observations over time period' WHEN 'context' THEN len(list_distinct(cs)) || ' context items (' || n || ' total)' WHEN 'preference' THEN 'Prefers: ' || cs[-1] || ' (evolved from ' || n || ' preferences)'
 ELSE 'Decided: ' || cs[-1] || ' (' || n || ' decisions)' END AS summary, CASE WHEN kind IN ('preference', 'decision') THEN last_tags ELSE {_TAGS_OF} END AS merged_tags FROM g),
 mt AS (SELECT *, CAST(ceil(length(content) / 4.0) + ceil(length(summary) / 4.0) + ceil(length(array_to_string(merged_tags, ' ')) / 4.0) AS BIGINT) + 25 AS merged_tokens FROM mc),
 ms AS (SELECT *, CAST(greatest(0, source_tokens - merged_tokens) AS BIGINT) AS tokens_saved FROM mt)"""
_GROUP = "list(m.content ORDER BY m.created_at, m.id) AS cs, flatten(list(m.tags ORDER BY m.created_at, m.id)) AS flat, arg_max(m.tags, m.id) AS last_tags, count(*) AS n, min(m.type) AS kind, CAST(sum(CAST(ceil(length(m.content) / 4.0) AS BIGINT) + CAST(ceil(length(array_to_string(m.tags, ' ')) / 4.0) AS BIGINT) + 25) AS BIGINT) AS source_tokens"


@query("preview_merge", f"""WITH {M.MEMORIES_SQL}, pa AS (SELECT id // 10 * 5 + id % 5 AS pid, list(id ORDER BY id) AS sources FROM mem GROUP BY 1 HAVING count(*) = 2), k AS (SELECT pid, unnest(sources) AS source FROM pa),
 g AS (SELECT pid AS merge_id, {_GROUP} FROM k JOIN mem m ON m.id = k.source WHERE m.id % 20 <> 15 GROUP BY pid), {_MERGED}
 SELECT merge_id, kind AS type, (['pending','approved','rejected','expired'])[CAST(merge_id % 4 AS INT) + 1] AS status, md5(content) AS digest, tokens_saved, CAST(CASE WHEN source_tokens > 0 THEN round(100.0 * tokens_saved / source_tokens) ELSE 0 END AS BIGINT) AS saved_percent FROM ms""")
def preview_merge(spark, d):
    """Some sources are missing: their proposals are merged from what is left."""
    m, p, _ = _approval(spark, d)
    rows = G.previewed(p.withColumn("similarity", F.lit(0.9)), m.filter("id % 20 <> 15"))
    return rows.select("merge_id", "type", "status", F.md5("content").alias("digest"), "tokens_saved", "saved_percent")


def _overlapping(spark, d):
    """Pending proposals that share sources: documents i and i + 5, in chains of seven."""
    m = M.memories(spark, d)
    twin = m.select((F.col("id") - 5).alias("id"), F.col("id").alias("other"))
    p = m.select("id").join(twin, "id").filter("id div 5 % 8 <> 0").select("id", F.array("id", "other").alias("sources"), F.lit("pending").alias("status"))
    sources = p.select(F.col("id").alias("merge_id"), F.explode("sources").alias("id")).join(m, "id")
    return m, p, G.merged(G.grouped(sources)).select("merge_id", "content", "type", "tags")


@query("approve_overlapping", f"""WITH RECURSIVE {M.MEMORIES_SQL}, pr AS (SELECT a.id, a.id AS x, b.id AS y FROM mem a JOIN mem b ON b.id = a.id + 5 WHERE a.id // 5 % 8 <> 0), rk AS (SELECT *, id % 5 AS lane, row_number() OVER (PARTITION BY id % 5 ORDER BY id) AS k FROM pr),
 st AS (SELECT lane, CAST(0 AS BIGINT) AS k, CAST(-1 AS BIGINT) AS used, CAST(NULL AS BIGINT) AS won FROM (SELECT DISTINCT lane FROM rk) UNION ALL
 SELECT r.lane, r.k, CASE WHEN s.used >= r.x THEN s.used ELSE r.y END, CASE WHEN s.used >= r.x THEN NULL ELSE r.id END FROM st s JOIN rk r ON r.lane = s.lane AND r.k = s.k + 1),
 w AS (SELECT r.id, r.x, r.y FROM st JOIN rk r ON r.id = st.won), h AS (SELECT x AS id, -1 - id AS into_id FROM w UNION ALL SELECT y, -1 - id FROM w)
 SELECT m.id, h.into_id AS merged_into FROM mem m LEFT JOIN h ON h.id = m.id UNION ALL SELECT -1 - id, NULL FROM w""")
def approve_overlapping(spark, d):
    """A source goes into one merge only: that of the smallest proposal which still can have it."""
    return G.approved(*_overlapping(spark, d), M.at(M.NOW))[0].select("id", "merged_into")


@query("merges_by_type", f"WITH {_APPROVAL} SELECT m.type, count(*) AS n FROM hit h JOIN mem m ON m.id = h.id GROUP BY 1")
def merges_by_type(spark, d):
    m, p, _ = _approval(spark, d)
    return p.filter("status = 'pending'").select(F.explode("sources").alias("id")).join(m.select("id", "type"), "id").groupBy("type").agg(F.count("*").alias("n"))


def _mergeable(spark, d):
    return D.stored(D.mergeable(M.memories(spark, d)), "mergeable")


_HEADS = f"""{M.MEMORIES_SQL}, mm AS (SELECT * FROM mem WHERE is_mergeable AND NOT is_merged AND is_active), cls AS (SELECT id, min(id) OVER (PARTITION BY content) AS class_id FROM mm),
 {_SIMHASH}, {_SIG}, fp AS (SELECT s.id, s.simhash, g.minhash FROM sim s JOIN sig g ON g.id = s.id JOIN cls c ON c.id = s.id AND c.class_id = c.id),
 pp AS (SELECT a.id AS id_a, b.id AS id_b, CASE WHEN a.simhash = 0 OR b.simhash = 0 THEN 64 ELSE bit_count(xor(a.simhash, b.simhash)) END AS distance, bit_count(xor(a.simhash, b.simhash)) AS plain, {_EQUAL} AS equal FROM fp a JOIN fp b ON a.id < b.id),
 cand AS (SELECT id_a, id_b, CASE WHEN distance <= 4 AND equal >= {_NEED} THEN 'both' WHEN distance <= 4 THEN 'simhash' ELSE 'minhash' END AS matched, greatest(1 - plain / 64.0, equal / {H.HASHES}.0) AS score FROM pp WHERE distance <= 4 OR equal >= {_NEED}),
 stage1 AS (SELECT * FROM cand UNION ALL SELECT class_id, id, 'both', 1.0 FROM cls WHERE id <> class_id)"""
_RANKED = f"""{_HEADS}, {_TF}, dots AS (SELECT s.id_a, s.id_b, sum(x.weight * y.weight) AS dot FROM stage1 s JOIN tfw x ON x.id = s.id_a JOIN tfw y ON y.id = s.id_b AND y.bucket = x.bucket GROUP BY 1, 2),
 close AS (SELECT id_a, id_b, round(dot, 9) AS similarity FROM dots WHERE round(dot, 9) >= 0.85), ranked AS (SELECT *, row_number() OVER (ORDER BY similarity DESC, id_a, id_b) AS k FROM close),
 pick AS (SELECT CAST(0 AS BIGINT) AS k, CAST([] AS STRUCT(a BIGINT, b BIGINT, s DOUBLE)[]) AS chosen UNION ALL SELECT r.k, CASE WHEN len(list_filter(chosen, lambda x: x.a = r.id_a OR x.b = r.id_a)) < 10 AND len(list_filter(chosen, lambda x: x.a = r.id_b OR x.b = r.id_b)) < 10
 THEN list_append(chosen, {{'a': r.id_a, 'b': r.id_b, 's': r.similarity}}) ELSE chosen END FROM pick p JOIN ranked r ON r.k = p.k + 1 WHERE len(chosen) < 50),
 got AS (SELECT x.a AS id_a, x.b AS id_b, x.s AS similarity FROM (SELECT unnest(chosen) AS x FROM (SELECT chosen FROM pick ORDER BY k DESC LIMIT 1))),
 gi AS (SELECT id_a, id_b, similarity, a.type AS type_a, b.type AS type_b, a.tags AS ta, b.tags AS tb, length(a.content) AS la, length(b.content) AS lb FROM got JOIN mem a ON a.id = id_a JOIN mem b ON b.id = id_b),
 gf AS (SELECT *, len(list_intersect(ta, tb)) / CAST(len(list_distinct(list_concat(ta, tb))) AS DOUBLE) AS overlap, CASE WHEN greatest(la, lb) = 0 THEN 1.0 ELSE least(la, lb) / CAST(greatest(la, lb) AS DOUBLE) END AS ratio FROM gi),
 lv AS (SELECT *, CASE WHEN similarity >= 0.9 THEN CASE WHEN type_a = type_b OR overlap > 0.3 THEN 'high' ELSE 'medium' END WHEN similarity >= 0.8 THEN 'medium' ELSE 'low' END AS level FROM gf)"""
_REASON = """concat_ws(' • ', printf('Semantic similarity: %.1f%%', similarity * 100), CASE WHEN type_a = type_b THEN 'Same type (' || type_a || ')' ELSE 'Different types (' || type_a || ' vs ' || type_b || ')' END,
 CASE WHEN overlap > 0 THEN printf('%d%% tag overlap', CAST(round(overlap * 100) AS BIGINT)) END, printf('Content length difference: %d%%', CAST(round((1 - ratio) * 100) AS BIGINT)), 'Confidence: ' || level)"""


@query("duplicate_candidates", f"WITH {_HEADS} SELECT id_a, id_b, matched, round(score, 6) AS score FROM cand")
def duplicate_candidates(spark, d):
    return D.candidates(_mergeable(spark, d)).withColumn("score", F.round("score", 6))


@query("duplicate_classes", f"WITH {M.MEMORIES_SQL} SELECT id, min(id) OVER (PARTITION BY content) AS class_id FROM mem WHERE is_mergeable AND NOT is_merged AND is_active")
def duplicate_classes(spark, d):
    return D.text_classes(D.mergeable(M.memories(spark, d)))


_LINKS = f"""WITH RECURSIVE {_HEADS}, ln AS (SELECT id_a AS x, id_b AS y FROM cand UNION ALL SELECT id_b, id_a FROM cand), deg AS (SELECT x, count(*) AS n FROM ln GROUP BY 1), go AS (SELECT x AS i, x AS j FROM ln UNION SELECT go.i, ln.y FROM go JOIN ln ON ln.x = go.j), far AS (SELECT i, min(j) AS m FROM go GROUP BY 1)
 SELECT c.id, coalesce(m, c.class_id) AS component_id, coalesce(n, 0) AS n_links, count(*) OVER (PARTITION BY c.class_id) - 1 AS n_copies FROM cls c LEFT JOIN deg ON deg.x = c.class_id LEFT JOIN far ON far.i = c.class_id"""


@query("duplicate_links", _LINKS)
def duplicate_links(spark, d):
    """Stage 1 as one row a memory: its group and the number of its links, however many pairs these are."""
    return T.links(_mergeable(spark, d))


@query("duplicate_links_batches", _LINKS)
def duplicate_links_batches(spark, d):
    """The same from three batches, each of which meets what is stored."""
    store = Duplicates(spark, fresh(spark, "duplicates"))
    m = _mergeable(spark, d).select("id", "content")
    for k in range(3):
        store.add(m.filter(F.col("id") % 3 == k))
    return store.groups()


@query("detect_stage1", f"WITH {_HEADS} SELECT id_a, id_b, CASE matched WHEN 'both' THEN 'simhash' ELSE matched END AS method, round(score, 6) AS similarity FROM stage1")
def detect_stage1(spark, d):
    """All pairs of the first stage: class heads with one another, and each class's head with its copies."""
    m = _mergeable(spark, d)
    return D.detected(m, E.embedded(m), stage1_only=True).select("id_a", "id_b", "method", F.round("similarity", 6).alias("similarity"))


def _detected(spark, d):
    m = _mergeable(spark, d)
    return m, D.detected(m, E.embedded(m.select("id", "content")))


@query("detect_duplicates", f"WITH RECURSIVE {_RANKED} SELECT id_a, id_b, round(similarity, 6) AS similarity, level, {_REASON} AS reason FROM lv")
def detect_duplicates(spark, d):
    """The flagship: likely duplicates among mergeable memories, by both stages, greedily chosen."""
    return _detected(spark, d)[1].select("id_a", "id_b", F.round("similarity", 6).alias("similarity"), "level", "reason")


@query("greedy_topk", f"WITH RECURSIVE {_RANKED} SELECT id_a, id_b, round(similarity, 6) AS similarity FROM got")
def greedy_topk(spark, d):
    """The ranking alone, on the pairs of a cosine of 0.85 or more."""
    m = _mergeable(spark, d)
    pairs = T.top_pairs(m, E.embedded(m.select("id", "content")), 0.85, 10, 50)
    return D.greedy_pairs(D.stored(pairs, "ranked"), 10, 50).withColumn("similarity", F.round("similarity", 6))


@query("detect_proposals", f"""WITH RECURSIVE {_RANKED}, pk AS (SELECT *, CAST('0x' || substr(md5(id_a || ',' || id_b), 1, 15) AS BIGINT) AS pid FROM lv WHERE type_a = type_b), k AS (SELECT pid, unnest([id_a, id_b]) AS source FROM pk),
 g AS (SELECT pid AS merge_id, {_GROUP} FROM k JOIN mem m ON m.id = k.source GROUP BY pid), {_MERGED},
 wn AS (SELECT pid, count(DISTINCT user_id) AS users, count(*) FILTER (WHERE is_private) AS private, count(*) FILTER (WHERE has_secrets) AS secret, min_by(project_id, m.id) AS project_id FROM k JOIN mem m ON m.id = k.source GROUP BY pid)
 SELECT p.pid AS id, project_id, id_a, id_b, kind AS type, round(similarity, 6) AS similarity, level, tokens_saved, md5(content) AS digest, 'pending' AS status,
 concat_ws('; ', CASE WHEN users > 1 THEN 'Merging memories from ' || users || ' different users' END, CASE WHEN private = 1 THEN 'Mixing private and public memories' END, CASE WHEN secret > 0 THEN secret || ' memories hold secrets' END) AS notes
 FROM pk p JOIN ms ON ms.merge_id = p.pid JOIN wn ON wn.pid = p.pid""")
def detect_proposals(spark, d):
    """Detection as the tool runs it: pairs that pass the safety checks, merged, as pending proposals."""
    m, pairs = _detected(spark, d)
    p = G.proposed(D.stored(pairs, "detected"), m, M.at(M.NOW))
    notes = F.array_join(F.filter("warnings", lambda w: w.rlike("users$|^Mixing|secrets$")), "; ")
    return p.select("id", "project_id", F.col("sources")[0].alias("id_a"), F.col("sources")[1].alias("id_b"), "type", F.round("similarity", 6).alias("similarity"), "level", "tokens_saved", F.md5("content").alias("digest"), "status", notes.alias("notes"))


@query("analyse_pair", f"""WITH {M.MEMORIES_SQL}, {_TF}, gi AS (SELECT a.id AS id_a, b.id AS id_b, coalesce((SELECT round(sum(x.weight * y.weight), 9) FROM tfw x JOIN tfw y ON y.bucket = x.bucket AND y.id = b.id WHERE x.id = a.id), 0.0) AS similarity, a.type AS type_a, b.type AS type_b, a.tags AS ta, b.tags AS tb,
 length(a.content) AS la, length(b.content) AS lb FROM mem a JOIN mem b ON a.id = 3 AND b.id = 8), gf AS (SELECT *, len(list_intersect(ta, tb)) / CAST(len(list_distinct(list_concat(ta, tb))) AS DOUBLE) AS overlap, CASE WHEN greatest(la, lb) = 0 THEN 1.0 ELSE least(la, lb) / CAST(greatest(la, lb) AS DOUBLE) END AS ratio FROM gi),
 lv AS (SELECT *, CASE WHEN similarity >= 0.9 THEN CASE WHEN type_a = type_b OR overlap > 0.3 THEN 'high' ELSE 'medium' END WHEN similarity >= 0.8 THEN 'medium' ELSE 'low' END AS level FROM gf) SELECT id_a, id_b, round(similarity, 6) AS similarity, round(overlap, 6) AS overlap, round(ratio, 6) AS ratio, level, {_REASON} AS reason FROM lv""")
def analyse_pair(spark, d):
    m = M.memories(spark, d)
    rows = D.analysed(m, E.embedded(m.filter("id in (3, 8)").select("id", "content")), 3, 8)
    return rows.select("id_a", "id_b", F.round("similarity", 6).alias("similarity"), F.round("overlap", 6).alias("overlap"), F.round("ratio", 6).alias("ratio"), "level", "reason")


@query("safety_text", f"""{_CHECKS} SELECT merge_id, CASE WHEN len(blockers) + len(warnings) = 0 THEN 'All checks passed' ELSE concat_ws(chr(10), CASE WHEN len(blockers) > 0 THEN 'Blocked:' || chr(10) || array_to_string(list_transform(blockers, lambda x: '- ' || x), chr(10)) END,
 CASE WHEN len(warnings) > 0 THEN 'Warnings:' || chr(10) || array_to_string(list_transform(warnings, lambda x: '- ' || x), chr(10)) END) END AS text FROM b""")
def safety_text(spark, d):
    p = M.proposals(spark, d).select(F.col("id").alias("merge_id"), "similarity", F.explode("sources").alias("id"))
    return G.safety_text(G.safety(p.join(M.memories(spark, d), "id"), similarity=F.col("similarity"))).select("merge_id", "text")


@query("hash_cache_upsert", """SELECT doc_id AS id, md5(text) AS content_hash, NOT (doc_id % 10 = 7 OR doc_id % 9 = 0) AS was_fresh FROM documents""")
def hash_cache_upsert(spark, d):
    """The cache brought up to date: entries that are missing or stale are made anew, the others stay."""
    memories = _content(spark, d)
    old = memories.filter("id % 10 <> 7").select("id", F.md5(F.when(F.col("id") % 9 == 0, F.concat("content", F.lit("x"))).otherwise(F.col("content"))).alias("content_hash"))
    return G.refreshed(old, memories)


@query("word_sets", "SELECT doc_id AS id, CAST(len(list_distinct(list_filter(regexp_split_to_array(lower(text), '[\\s\\x{00a0}\\x{feff}\\p{Z}]+'), lambda x: length(x) > 2))) AS INT) AS n FROM documents")
def word_sets(spark, d):
    return _content(spark, d).select("id", F.size(word_set(F.col("content"))).alias("n"))
