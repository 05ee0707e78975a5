"""Search queries."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from recollect.functions.scoring import age_days, age_decayed, read_scope
from recollect.functions.text import tokens_by_words
from recollect.operators import positions as P
from recollect.operators import search as S
from recollect.operators import vectors as V
from recollect.operators.filters import Criteria, assertion, confident, ensured, matching, of_path, project_by_path, readable, recent
from recollect.plans.registry import query
from recollect.sources import model as M
from recollect.sources.storage import fresh


def newest() -> tuple[Column, Column]:
    return F.desc("created_at"), F.desc("id")


@query("search_ilike_tags", f"""WITH {M.MEMORIES_SQL} SELECT id, type, relevance, strftime(created_at, '%Y-%m-%d %H:%M:%S') AS created FROM mem
 WHERE content ILIKE '%tion%' AND list_has_any(tags, ['en','src3']) AND is_active ORDER BY created_at DESC, id DESC LIMIT 10""")
def search_ilike_tags(spark, d):
    found = S.keyword(M.memories(spark, d).filter("is_active"), "tion", ["en", "src3"])
    return S.top(found, 10, *newest()).select("id", "type", "relevance", M.shown("created_at").alias("created"))


@query("search_tokens_and", f"""WITH {M.MEMORIES_SQL}, t AS (SELECT *, list_filter(regexp_split_to_array(lower(content), '[^a-z0-9]+'), lambda x: x <> '') AS terms FROM mem)
 SELECT id, project_id FROM t WHERE list_contains(terms, 'the') AND list_contains(terms, 'and') AND len(list_filter(terms, lambda x: starts_with(x, 'thin'))) > 0""")
def search_tokens_and(spark, d):
    return S.keyword(M.memories(spark, d), words=["the", "and"], prefixes=["thin"]).select("id", "project_id")


def _vector_sql(expression: str, order: str) -> str:
    return f"""WITH e AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), q AS (SELECT v AS q FROM e WHERE id = 0)
 SELECT id, round({expression}, 6) AS score FROM (SELECT id, v, q FROM e, q) ORDER BY {expression} {order}, id LIMIT 10"""


def _nearest(spark, d, metric):
    vectors = M.embeddings(spark, d)
    q = vectors.filter("id = 0").select("v").first()
    return S.nearest(vectors, q[0] if q else [0.0], 10, metric).select("id", F.round("score", 6).alias("score"))


@query("vector_topk_l2", _vector_sql("list_distance(v, q)", "ASC"))
def vector_topk_l2(spark, d):
    return _nearest(spark, d, "l2")


@query("vector_topk_cosine", _vector_sql("list_cosine_similarity(v, q)", "DESC"))
def vector_topk_cosine(spark, d):
    return _nearest(spark, d, "cosine")


def _each_sql(expression: str, order: str) -> str:
    return f"""WITH e AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), q AS (SELECT id AS query_id, v AS q FROM e WHERE id % 50 = 0)
 SELECT query_id, id, round(score, 6) AS score FROM (SELECT query_id, id, {expression} AS score, row_number() OVER (PARTITION BY query_id ORDER BY {expression} {order}, id) AS rank FROM e, q) WHERE rank <= 10"""


def _nearest_each(spark, d, k, metric="l2"):
    vectors = M.embeddings(spark, d)
    return S.nearest_each(vectors, vectors.filter("id % 50 = 0"), k, metric)


@query("vector_each_l2", _each_sql("list_distance(v, q)", "ASC"))
def vector_each_l2(spark, d):
    return _nearest_each(spark, d, 10).select("query_id", "id", F.round("score", 6).alias("score"))


@query("vector_each_cosine", _each_sql("list_cosine_similarity(v, q)", "DESC"))
def vector_each_cosine(spark, d):
    return _nearest_each(spark, d, 10, "cosine").select("query_id", "id", F.round("score", 6).alias("score"))


def _planted(spark, d):
    """The vectors under text ids, some with a NaN, a null, an infinite entry, or of half the length."""
    v = F.when(F.col("id") % 7 == 3, F.transform("v", lambda x, i: F.when(i == 1, float("nan")).otherwise(x))).when(F.col("id") % 7 == 4, F.transform("v", lambda x, i: F.when(i != 2, x))).when(F.col("id") % 11 == 5, F.transform("v", lambda x, i: F.when(i == 0, float("inf")).otherwise(x))).when(F.col("id") % 5 == 0, F.slice("v", 1, 32)).otherwise(F.col("v"))
    return M.embeddings(spark, d).select(F.concat(F.lit("v"), F.col("id")).alias("id"), v.alias("v"), (F.col("id") % 50 == 0).alias("asks"))


@query("vector_each_nan", """WITH e AS (SELECT vec_id AS n, 'v' || vec_id AS id, CASE WHEN vec_id % 5 = 0 THEN CAST(embedding AS DOUBLE[])[1:32] ELSE CAST(embedding AS DOUBLE[]) END AS v FROM embeddings WHERE vec_id % 7 NOT IN (3, 4) AND vec_id % 11 <> 5),
 q AS (SELECT id AS query_id, v AS q FROM e WHERE n % 50 = 0), p AS (SELECT query_id, id, list_distance(v, q) AS s FROM q JOIN e ON len(v) = len(q))
 SELECT query_id, id, round(s, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s, id) AS r FROM p) WHERE r <= 10""")
def vector_each_nan(spark, d):
    v = _planted(spark, d)
    return S.nearest_each(v, v.filter("asks"), 10).select("query_id", "id", F.round("score", 6).alias("score"))


_TERMS = "t AS (SELECT doc_id AS id, list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda x: x <> '') AS w FROM documents)"


def _index(spark, d):
    """An index of all memories, written in two batches and put together."""
    m = M.texts(spark, d).select("id", "content")
    index = P.Index(spark, fresh(spark, "index"))
    for part in (0, 1):
        index.add(m.filter(F.col("id") % 2 == part))
    index.compact()
    return index, m


@query("search_phrase", f"""WITH {_TERMS}, q AS (SELECT id AS query_id, array_to_string(w[3:5], ' ') AS phrase FROM t WHERE id % 50 = 0 AND len(w) >= 5), s AS (SELECT id, ' ' || array_to_string(w, '  ') || ' ' AS s FROM t)
 SELECT query_id, id FROM q JOIN s ON contains(s, ' ' || replace(phrase, ' ', '  ') || ' ')""")
def search_phrase(spark, d):
    """Three words of every 50th memory as a phrase, searched in all memories through the kept index."""
    index, m = _index(spark, d)
    queries = m.filter("id % 50 = 0").select(F.col("id").alias("query_id"), P.phrase_words(F.col("content"), 3, 3).alias("words")).filter("size(words) = 3")
    return P.phrases_each(index.whole(), queries).select("query_id", "id")


@query("search_near", f"""WITH {_TERMS}, q AS (SELECT id AS query_id, w[3] AS a, w[8] AS b FROM t WHERE id % 50 = 0 AND len(w) >= 8), p AS (SELECT id, unnest(w) AS term, generate_subscripts(w, 1) AS k FROM t)
 SELECT DISTINCT query_id, x.id FROM q JOIN p x ON x.term = a JOIN p y ON y.term = b AND y.id = x.id AND abs(x.k - y.k) <= 5 AND (a <> b OR x.k <> y.k)""")
def search_near(spark, d):
    """The third and the eighth word of every 50th memory, with at most four terms between them, searched in all memories."""
    index, m = _index(spark, d)
    word = lambda k: P.phrase_words(F.col("content"), k, 1)
    queries = m.filter("id % 50 = 0").select(F.col("id").alias("query_id"), word(3).alias("a"), word(8).alias("b")).filter("size(b) = 1").selectExpr("query_id", "a[0] as a", "b[0] as b")
    return P.near_each(index.whole(), queries, 4)


@query("vector_index_each")
def vector_index_each(spark, d):
    """Ten neighbours of every 50th vector through the index, which files all vectors: approximate, so tests hold its recall against the exact search."""
    v = M.embeddings(spark, d).select("id", "v")
    index = V.VectorIndex(spark, fresh(spark, "vectors"))
    index.make(v)
    return index.search(v.filter("id % 50 = 0"), 10).select("query_id", "id", F.round("score", 6).alias("score"))


@query("filtered_vector_each", f"""WITH {M.MEMORIES_SQL}, e AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), ok AS (SELECT id, v FROM e JOIN mem USING (id) WHERE content ILIKE '%tion%' AND list_has_any(tags, ['en', 'src0'])),
 q AS (SELECT id AS query_id, v AS q FROM e WHERE id % 50 = 0), p AS (SELECT query_id, id, list_cosine_similarity(v, q) AS s FROM q, ok) SELECT query_id, id, round(s, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 9) DESC, id) AS r FROM p) WHERE r <= 10""")
def filtered_vector_each(spark, d):
    """Recall as a user asks for it: a filter on text and tags, then the order by vector, for every 50th vector as the query."""
    hits = S.keyword(M.memories(spark, d), "tion", tags=("en", "src0")).select("id")
    vectors = M.embeddings(spark, d).select("id", "v")
    found = S.nearest_each(vectors.join(hits, "id", "left_semi"), vectors.filter("id % 50 = 0"), 10, "cosine")
    return found.select("query_id", "id", F.round("score", 6).alias("score"))


@query("recent_by_project", f"""WITH {M.MEMORIES_SQL} SELECT project_id, id, rank FROM (SELECT project_id, id, row_number() OVER (PARTITION BY project_id ORDER BY created_at DESC, id DESC) AS rank FROM mem) WHERE rank <= 3""")
def recent_by_project(spark, d):
    return S.top_per(M.memories(spark, d).select("project_id", "id", "created_at"), "project_id", 3, *newest()).select("project_id", "id", F.col("rank").cast("long").alias("rank"))


@query("recent_observations", """SELECT event_id AS id, user_id AS project_id, event_type AS type FROM events ORDER BY ts DESC, event_id DESC LIMIT 20""")
def recent_observations(spark, d):
    return S.top(M.observations(spark, d), 20, *newest()).select("id", "project_id", "type")


@query("recent_entities", """SELECT p_partkey AS id, p_name AS name, p_type AS kind FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 10""")
def recent_entities(spark, d):
    return S.top(M.table(spark, d, "part"), 10, F.desc("p_retailprice"), F.asc("p_partkey")).select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_type").alias("kind"))


@query("recent_conversations", f"""WITH {M.MESSAGES_SQL} SELECT conv_id, count(*) AS n_messages, strftime(min(created_at), '%Y-%m-%d %H:%M:%S') AS started FROM msg GROUP BY conv_id ORDER BY min(created_at) DESC, conv_id DESC LIMIT 10""")
def recent_conversations(spark, d):
    grouped = M.messages(spark, d).groupBy("conv_id").agg(F.count("*").alias("n_messages"), F.min("created_at").alias("started_at"))
    return S.top(grouped, 10, F.desc("started_at"), F.desc("conv_id")).select("conv_id", "n_messages", M.shown("started_at").alias("started"))


@query("conversation_search", f"""WITH {M.MESSAGES_SQL}, conv AS (SELECT conv_id, min(created_at) AS s FROM msg GROUP BY 1)
 SELECT conv_id FROM conv WHERE conv_id IN (SELECT conv_id FROM msg WHERE content ILIKE '%the%' AND role = 'user') ORDER BY s DESC, conv_id DESC LIMIT 20""")
def conversation_search(spark, d):
    m = M.messages(spark, d)
    conv = m.groupBy("conv_id").agg(F.min("created_at").alias("started_at"))
    return S.top(S.conversations_with(conv, m, "the", "user"), 20, F.desc("started_at"), F.desc("conv_id")).select("conv_id")


@query("time_range", f"""WITH {M.MEMORIES_SQL} SELECT id FROM mem WHERE created_at >= TIMESTAMP '2024-01-10' AND created_at <= TIMESTAMP '2024-01-20'""")
def time_range(spark, d):
    return M.memories(spark, d).filter((F.col("created_at") >= M.at("2024-01-10 00:00:00")) & (F.col("created_at") <= M.at("2024-01-20 00:00:00"))).select("id")


@query("context_bundle", f"""WITH {M.MEMORIES_SQL}, a AS (SELECT 'memories' AS block, id, row_number() OVER (ORDER BY created_at DESC, id DESC) AS rank FROM mem WHERE project_id = 'src1'),
 b AS (SELECT 'observations' AS block, event_id AS id, row_number() OVER (ORDER BY ts DESC, event_id DESC) AS rank FROM events WHERE user_id = 1),
 c AS (SELECT 'entities' AS block, p_partkey AS id, row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) AS rank FROM part)
 SELECT block, rank, id FROM (SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM c) WHERE rank <= 10""")
def context_bundle(spark, d):
    ranked = lambda df, *order: S.top_per(df.withColumn("all", F.lit(1)), "all", 10, *order).select("id", F.col("rank").cast("long").alias("rank"))
    return S.bundle({
        "memories": ranked(M.memories(spark, d).filter("project_id = 'src1'").select("id", "created_at"), *newest()),
        "observations": ranked(M.observations(spark, d).filter("project_id = 1").select("id", "created_at"), *newest()),
        "entities": ranked(M.table(spark, d, "part").select(F.col("p_partkey").alias("id"), "p_retailprice"), F.desc("p_retailprice"), F.asc("id")),
    })


@query("criteria_filter", f"""WITH {M.MEMORIES_SQL} SELECT id, type, sector FROM mem WHERE type IN ('fact','decision') AND confidence >= 70 AND relevance >= 50 AND list_contains(tags, 'en')
 AND date_diff('second', created_at, TIMESTAMP '{M.NOW}') / 86400.0 <= 40 AND visibility = 'project'""")
def criteria_filter(spark, d):
    c = Criteria(types=["fact", "decision"], min_confidence=70, min_relevance=50, tag="en", max_age=40, visibility="project")
    return matching(M.memories(spark, d), c, M.at(M.NOW)).select("id", "type", "sector")


@query("assert_counts", f"""WITH {M.MEMORIES_SQL}, r AS (SELECT 'confident facts' AS name, 5 AS expected, count(*) AS found FROM mem WHERE type = 'fact' AND confidence >= 80
 UNION ALL SELECT 'no unknown sector', 0, count(*) FROM mem WHERE sector = 'none' UNION ALL SELECT 'recent', 1000000, count(*) FROM mem WHERE date_diff('second', created_at, TIMESTAMP '{M.NOW}') / 86400.0 <= 7)
 SELECT name, CAST(expected AS BIGINT) AS expected, found, CASE WHEN expected = 0 THEN found = 0 ELSE found >= expected END AS passed FROM r""")
def assert_counts(spark, d):
    m, now = M.memories(spark, d), M.at(M.NOW)
    tests = [("confident facts", Criteria(type="fact", min_confidence=80), 5), ("no unknown sector", Criteria(sector="none"), 0), ("recent", Criteria(max_age=7), 1000000)]
    out = [assertion(m, name, c, n, now) for name, c, n in tests]
    return out[0].unionByName(out[1]).unionByName(out[2])


@query("age_decay_rank", f"""WITH {M.MEMORIES_SQL}, s AS (SELECT id, relevance * pow(0.5, (date_diff('second', created_at, TIMESTAMP '{M.NOW}') / 86400.0) / 30) AS score FROM mem WHERE created_at <= TIMESTAMP '{M.NOW}')
 SELECT id, round(score, 6) AS score FROM s ORDER BY score DESC, id LIMIT 20""")
def age_decay_rank(spark, d):
    m = M.memories(spark, d).filter(F.col("created_at") <= M.at(M.NOW))
    scored = m.select("id", age_decayed(F.col("relevance"), age_days(F.col("created_at"), M.at(M.NOW))).alias("score"))
    return S.top(scored, 20, F.desc("score"), F.asc("id")).select("id", F.round("score", 6).alias("score"))


@query("hybrid_fusion", f"""WITH {M.MEMORIES_SQL}, e AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), q AS (SELECT v AS q FROM e WHERE id = 0),
 a AS (SELECT id, rank FROM (SELECT id, row_number() OVER (ORDER BY created_at DESC, id DESC) AS rank FROM mem WHERE content ILIKE '%tion%') WHERE rank <= 50),
 b AS (SELECT id, rank FROM (SELECT id, row_number() OVER (ORDER BY list_distance(v, q), id) AS rank FROM e, q) WHERE rank <= 50)
 SELECT id, round(sum(1.0 / (rank + 60)), 6) AS score FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY id ORDER BY round(sum(1.0 / (rank + 60)), 9) DESC, id LIMIT 10""")
def hybrid_fusion(spark, d):
    vectors = M.embeddings(spark, d)
    q = vectors.filter("id = 0").select("v").first()
    near = S.nearest(vectors, q[0], 50).withColumn("all", F.lit(1))
    words = S.top(S.keyword(M.memories(spark, d), "tion").select("id", "created_at"), 50, *newest()).withColumn("all", F.lit(1))
    return S.fused([S.top_per(words, "all", 50, *newest()), S.top_per(near, "all", 50, F.asc("score"), F.asc("id"))], 10).select("id", F.round("score", 6).alias("score"))


@query("hybrid_each", f"""WITH {M.MEMORIES_SQL}, e AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), q AS (SELECT id AS query_id, v AS q FROM e WHERE id % 50 = 0),
 a AS (SELECT query_id, id, rank FROM (SELECT id, row_number() OVER (ORDER BY created_at DESC, id DESC) AS rank FROM mem WHERE content ILIKE '%tion%'), q WHERE rank <= 50),
 b AS (SELECT query_id, id, rank FROM (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY list_distance(v, q), id) AS rank FROM e, q) WHERE rank <= 50),
 f AS (SELECT query_id, id, sum(1.0 / (rank + 60)) AS score FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY 1, 2)
 SELECT query_id, id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS r FROM f) WHERE r <= 10""")
def hybrid_each(spark, d):
    near = _nearest_each(spark, d, 50).select("query_id", "id", "rank")
    words = S.top(S.keyword(M.memories(spark, d), "tion").select("id", "created_at"), 50, *newest()).withColumn("all", F.lit(1))
    words = S.top_per(words, "all", 50, *newest()).select("id", "rank")
    queries = M.embeddings(spark, d).filter("id % 50 = 0").select(F.col("id").alias("query_id"))
    parts = near.unionByName(queries.crossJoin(F.broadcast(words)).select("query_id", "id", "rank"))
    total = parts.groupBy("query_id", "id").agg(F.sum(F.lit(1.0) / (F.col("rank") + 60)).alias("score"))
    return S.top_per(total, "query_id", 10, F.desc(F.round("score", 9)), F.asc("id")).select("query_id", "id", F.round("score", 6).alias("score"))


@query("read_scope", f"""WITH {M.MEMORIES_SQL} SELECT id, CASE visibility WHEN 'private' THEN 'agent:' || agent_id WHEN 'project' THEN 'agent:' || agent_id || ',project:' || project_id
 WHEN 'team' THEN 'agent:' || agent_id || ',project:' || project_id || ',team:*' ELSE '*' END AS scope FROM mem""")
def read_scope_query(spark, d):
    return M.memories(spark, d).select("id", F.array_join(read_scope(F.col("visibility"), F.col("agent_id"), F.col("project_id")), ",").alias("scope"))


@query("scope_filter", f"""WITH {M.MEMORIES_SQL} SELECT id FROM mem WHERE visibility = 'global' OR agent_id = 'agent1' OR (visibility IN ('project','team') AND project_id = 'src2')""")
def scope_filter(spark, d):
    scoped = M.memories(spark, d).withColumn("read_scope", read_scope(F.col("visibility"), F.col("agent_id"), F.col("project_id")))
    return readable(scoped, ["agent:agent1", "project:src2"]).select("id")


@query("ensure_projects", """SELECT path, string_split(path, '/')[-1] AS name FROM (SELECT DISTINCT '/work/' || source AS path FROM documents) WHERE path NOT IN (SELECT '/work/src' || r_regionkey FROM region)""")
def ensure_projects(spark, d):
    known = M.table(spark, d, "region").select(F.concat(F.lit("/work/src"), "r_regionkey").alias("path"))
    return ensured(known, M.table(spark, d, "documents").select(F.concat(F.lit("/work/"), "source").alias("path")))


_TOKENS = "CAST(ceil(len(regexp_split_to_array({0}, '[\\s\\x{{00a0}}\\x{{feff}}\\p{{Z}}]+')) * 1.3) AS BIGINT)"


def _budget_sql(ranked: str, items: int, tokens: int, most: int) -> str:
    """The greedy choice as recursion along the ranks r of `ranked` (project_id, kind, id, rank, tokens)."""
    return f"""{ranked}, st AS (SELECT project_id, 0 AS r, CAST(0 AS BIGINT) AS used, 0 AS n, CAST([] AS BIGINT[]) AS ranks FROM (SELECT DISTINCT project_id FROM rk) UNION ALL
 SELECT s.project_id, s.r + 1, CASE WHEN k.rank IS NOT NULL AND s.n < {items} AND s.used + k.tokens <= {tokens} THEN s.used + k.tokens ELSE s.used END, CASE WHEN k.rank IS NOT NULL AND s.n < {items} AND s.used + k.tokens <= {tokens} THEN s.n + 1 ELSE s.n END,
 CASE WHEN k.rank IS NOT NULL AND s.n < {items} AND s.used + k.tokens <= {tokens} THEN list_append(s.ranks, k.rank) ELSE s.ranks END FROM st s LEFT JOIN rk k ON k.project_id = s.project_id AND k.rank = s.r + 1 WHERE s.r < {most}),
 ch AS (SELECT project_id, used, unnest(ranks) AS rank, generate_subscripts(ranks, 1) - 1 AS position FROM st WHERE r = {most})"""


_BUDGET = f"""WITH RECURSIVE {M.MEMORIES_SQL}, rk AS (SELECT project_id, id, {_TOKENS.format('content')} AS tokens, row_number() OVER (PARTITION BY project_id ORDER BY created_at DESC, id DESC) AS rank FROM mem WHERE is_active QUALIFY rank <= 10)"""


@query("context_budget", f"{_budget_sql(_BUDGET, 5, 3000, 10)} SELECT ch.project_id, used AS used_tokens, CAST(position AS INT) AS position, rk.id FROM ch JOIN rk ON rk.project_id = ch.project_id AND rk.rank = ch.rank")
def context_budget(spark, d):
    m = M.memories(spark, d).filter("is_active").select("project_id", "id", tokens_by_words(F.col("content")).cast("long").alias("tokens"), "created_at")
    return S.budgeted(S.top_per(m, "project_id", 10, *newest()), 5, 3000)


_SELECTION = f"""WITH RECURSIVE {M.MEMORIES_SQL}, {M.MESSAGES_SQL}, a AS (SELECT project_id, 'memory' AS kind, id, {_TOKENS.format('content')} AS tokens, row_number() OVER (PARTITION BY project_id ORDER BY created_at DESC, id DESC) AS rank FROM mem WHERE is_active QUALIFY rank <= 10),
 cv AS (SELECT 'src' || (conv_id % 8) AS project_id, conv_id AS id, min(created_at) AS began, CAST(sum({_TOKENS.format('content')}) AS BIGINT) AS tokens FROM msg GROUP BY conv_id),
 c AS (SELECT project_id, 'conversation' AS kind, id, tokens, 10 + row_number() OVER (PARTITION BY project_id ORDER BY began DESC, id DESC) AS rank FROM cv QUALIFY rank <= 15), rk AS (SELECT * FROM a UNION ALL SELECT * FROM c)"""


@query("context_selection", f"{_budget_sql(_SELECTION, 15, 3000, 15)} SELECT ch.project_id, CAST(position AS INT) AS position, kind, id, used AS used_tokens FROM ch JOIN rk ON rk.project_id = ch.project_id AND rk.rank = ch.rank")
def context_selection(spark, d):
    m = M.memories(spark, d).filter("is_active").select("project_id", "id", tokens_by_words(F.col("content")).cast("long").alias("tokens"), "created_at")
    c = M.messages(spark, d).groupBy(F.col("conv_id").alias("id")).agg(F.min("created_at").alias("created_at"), F.sum(tokens_by_words(F.col("content"))).cast("long").alias("tokens"))
    c = c.withColumn("project_id", F.concat(F.lit("src"), F.pmod("id", F.lit(8))))
    return S.selected(S.top_per(m, "project_id", 10, *newest()), S.top_per(c, "project_id", 5, *newest()))


@query("search_terms_or", f"""WITH {M.MEMORIES_SQL}, t AS (SELECT *, list_filter(regexp_split_to_array(lower(content), '[^a-z0-9]+'), lambda x: x <> '') AS terms FROM mem) SELECT id FROM t WHERE list_has_any(terms, ['license', 'thing', 'worthless'])""")
def search_terms_or(spark, d):
    return S.keyword(M.memories(spark, d), any_of=["license", "thing", "worthless"]).select("id")


@query("search_index", f"""WITH {M.MEMORIES_SQL}, t AS (SELECT *, list_filter(regexp_split_to_array(lower(content), '[^a-z0-9]+'), lambda x: x <> '') AS terms FROM mem) SELECT id FROM t WHERE list_contains(terms, 'the') AND list_contains(terms, 'of') AND list_has_any(terms, ['and', 'in'])""")
def search_index(spark, d):
    return S.indexed(S.term_index(M.memories(spark, d)), ["the", "of"], ["and", "in"])


@query("search_tags_like", f"""WITH {M.MEMORIES_SQL} SELECT id FROM mem WHERE len(list_filter(tags, lambda t: t ILIKE '%rc1%' OR t ILIKE '%D%')) > 0""")
def search_tags_like(spark, d):
    return S.keyword(M.memories(spark, d), tags_like=["RC1", "d"]).select("id")


@query("search_literal", f"""WITH {M.MEMORIES_SQL} SELECT id FROM mem WHERE contains(lower(content), '100%') OR contains(lower(content), '%%%') OR contains(content, '_')""")
def search_literal(spark, d):
    """% and _ of a pattern stand for themselves."""
    m = M.memories(spark, d)
    return S.keyword(m, "100%").select("id").union(S.keyword(m, "%%%").select("id")).union(S.keyword(m, "_").select("id")).distinct()


@query("search_clamped", f"""WITH {M.MEMORIES_SQL} SELECT id FROM mem WHERE is_active ORDER BY created_at DESC, id DESC LIMIT 100""")
def search_clamped(spark, d):
    """A limit of 5000 is cut to the most that a search gives."""
    return S.clamped_top(M.memories(spark, d).filter("is_active"), 5000, 10, 1, 100, *newest()).select("id")


def _projects(spark, d):
    return M.table(spark, d, "documents").select(F.col("source").alias("project_id")).distinct().withColumn("path", F.concat(F.lit("/work/"), "project_id"))


@query("project_of_path", f"""WITH {M.MEMORIES_SQL} SELECT id, project_id FROM mem WHERE project_id = 'src2'""")
def project_of_path(spark, d):
    return of_path(M.memories(spark, d), _projects(spark, d), "/work/src2").select("id", "project_id")


@query("project_unknown", "SELECT doc_id AS id FROM documents WHERE false")
def project_unknown(spark, d):
    """A path without a project filters everything out."""
    return of_path(M.memories(spark, d), _projects(spark, d), "/work/none").select("id")


@query("project_by_path", "SELECT DISTINCT source AS project_id, '/work/' || source AS path FROM documents WHERE source = 'src1'")
def project_lookup(spark, d):
    return project_by_path(_projects(spark, d), "/work/src1")


@query("confident_recent", f"""WITH {M.MEMORIES_SQL} SELECT id, 'confident' AS what FROM mem WHERE type = 'fact' AND confidence >= 80 UNION ALL SELECT id, 'recent' FROM mem WHERE date_diff('second', created_at, TIMESTAMP '{M.NOW}') / 86400.0 <= 7""")
def confident_recent(spark, d):
    m, now = M.memories(spark, d), M.at(M.NOW)
    return confident(m, Criteria(type="fact"), now).select("id", F.lit("confident").alias("what")).unionByName(recent(m, Criteria(), now).select("id", F.lit("recent").alias("what")))
