"""Keyword, vector and combined search; top-k per group; context bundles."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recollect.functions.scoring import cosine, l2
from recollect.functions.text import contains_terms, holds, terms
from recollect.operators.filters import clamped

#: Vectors, and queries, that one group of a scan with many queries compares (about).
VECTORS, QUERIES = 8192, 4096
#: Products that a scan holds at a time.
PRODUCTS = 1 << 19
#: Entries of a vector from this size on count as not finite.
MOST = 1e140


def keyword(df: DataFrame, pattern: str | None = None, tags: Sequence[str] = (), words: Sequence[str] = (), prefixes: Sequence[str] = (), any_of: Sequence[str] = (), tags_like: Sequence[str] = ()) -> DataFrame:
    """Rows whose content has the pattern (case aside), any of the tags, all words and prefixes, one of any_of,
    and a tag that contains one of tags_like."""
    if pattern is not None:
        df = df.filter(holds(F.col("content"), pattern))
    if tags:
        df = df.filter(F.arrays_overlap("tags", F.array(*map(F.lit, tags))))
    if words or prefixes or any_of:
        df = df.filter(contains_terms(F.col("content"), list(words), tuple(prefixes), tuple(any_of)))
    if tags_like:
        df = df.filter(F.exists("tags", lambda t: reduce(or_, [holds(t, x) for x in tags_like])))
    return df


def term_index(memories: DataFrame) -> DataFrame:
    """(term, id): each term of each memory once; kept as a table clustered by term, searches read a few files of it."""
    return memories.select(F.explode(F.array_distinct(terms(F.col("content")))).alias("term"), "id")


def indexed(index: DataFrame, words: Sequence[str] = (), any_of: Sequence[str] = ()) -> DataFrame:
    """Ids of memories that hold all words and one of any_of: the terms' rows only, pushed down to the index."""
    wanted = sorted({*words, *any_of})
    found = index.filter(F.col("term").isin(wanted)).groupBy("id").agg(F.count_if(F.col("term").isin(list(words))).alias("all_of"), F.count_if(F.col("term").isin(list(any_of))).alias("some_of"))
    enough = F.col("all_of") == len(set(words))
    return found.filter(enough & (F.col("some_of") > 0) if any_of else enough).select("id")


def clamped_top(df: DataFrame, k: int | None, default: int, low: int, high: int, *order: Column) -> DataFrame:
    """top() with the limit of a caller, or the default, cut to [low, high]."""
    return top(df, clamped(k, default, low, high), *order)


def top(df: DataFrame, k: int, *order: Column) -> DataFrame:
    """The first k rows in the order: each task keeps k, one merges them."""
    return df.orderBy(*order).limit(k)


def top_per(df: DataFrame, group: str, k: int, *order: Column, rank: str = "rank") -> DataFrame:
    """The first k rows of each group; tasks cut to k per group before the shuffle."""
    return df.withColumn(rank, F.row_number().over(W.partitionBy(group).orderBy(*order))).filter(F.col(rank) <= k)


def nearest(vectors: DataFrame, query: Sequence[float], k: int, metric: str = "l2") -> DataFrame:
    """The k rows nearest to a query vector, by L2 distance or cosine; an exact scan."""
    q = F.array(*[F.lit(float(x)) for x in query])
    score = l2(F.col("v"), q) if metric == "l2" else cosine(F.col("v"), q)
    return top(vectors.withColumn("score", score), k, F.asc("score") if metric == "l2" else F.desc("score"), F.asc("id"))


def usable(vectors: DataFrame, column: str = "v") -> DataFrame:
    """Rows whose vector has entries, and none that is null, not finite or of a size whose square overflows."""
    fine = F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < MOST))
    return vectors.filter(F.col(column).isNotNull() & (F.size(column) > 0) & fine)


def nearest_each(vectors: DataFrame, queries: DataFrame, k: int, metric: str = "l2") -> DataFrame:
    """(query_id, id, score, rank): the k rows of vectors (id, v) nearest to each of queries (id, v); exact.

    Blocks of queries meet blocks of vectors; each pair of blocks keeps k rows a query. Products
    choose the candidates with a margin, then their scores are taken one by one, so equal vectors
    score alike and go by id. Ids may be of any type that has an order. A vector that is null, empty
    or holds an entry that is null or not finite is left out, on either side, and vectors meet those
    of their own length only. A query without any gets no row.
    """
    vectors, queries = (usable(df.select(F.col("id").alias("id"), F.col("v").cast("array<double>").alias("v"))) for df in (vectors, queries))
    n, m = -(-vectors.count() // VECTORS) or 1, -(-queries.count() // QUERIES) or 1
    own = lambda parts: F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int")
    every = lambda parts: F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    length = F.size("v").alias("length")
    left = vectors.select("id", "v", length, own(n).alias("block"), every(m).alias("deal")).groupBy("block", "deal", "length")
    right = queries.select("id", "v", length, own(m).alias("deal"), every(n).alias("block")).groupBy("block", "deal", "length")
    sign = 1 if metric == "l2" else -1

    def scan(one: pa.Table, two: pa.Table) -> pa.Table:
        ids, names = one.column("id").combine_chunks(), two.column("id").combine_chunks()
        out = []
        if one.num_rows and two.num_rows:
            v, q = (pc.list_flatten(t.column("v")).to_numpy().reshape(t.num_rows, -1) for t in (one, two))
            place = pc.rank(ids, tiebreaker="dense").to_numpy()
            size, length = (np.einsum("ij,ij->i", x, x) for x in (v, q))
            step = max(1, PRODUCTS // len(v))
            for i in range(0, len(q), step):
                product = q[i : i + step] @ v.T
                if metric == "l2":  # the error of a product grows with its own two vectors
                    rough = size - 2 * product
                    margin = 1e-9 * (1 + size + length[i : i + step, None])
                else:
                    rough, margin = -product / np.maximum(np.sqrt(size) * np.sqrt(length[i : i + step])[:, None], 1e-300), np.broadcast_to(1e-9, product.shape)
                kth = min(k, len(v)) - 1
                least = np.partition(rough + margin, kth, axis=1)[:, kth]
                for r, limit in enumerate(least.tolist()):
                    at = np.flatnonzero(rough[r] - margin[r] <= limit)
                    w, x = v[at], q[i + r]
                    if metric == "l2":
                        score = np.sqrt(((w - x) ** 2).sum(axis=1))
                    else:
                        norms = np.sqrt((w * w).sum(axis=1)) * np.sqrt((x * x).sum())
                        score = np.divide((w * x).sum(axis=1), norms, out=np.zeros(len(at)), where=norms > 0)
                    best = np.lexsort((place[at], sign * score))[:k]
                    out.append((np.full(len(best), i + r), at[best], score[best]))
        a, b, c = (np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        return pa.table({"query_id": names.take(pa.array(a)), "id": ids.take(pa.array(b)), "score": c})

    kind, asked = (df.schema["id"].dataType for df in (vectors, queries))
    found = left.cogroup(right).applyInArrow(scan, T.StructType([T.StructField("query_id", asked), T.StructField("id", kind), T.StructField("score", T.DoubleType())]))
    return top_per(found, "query_id", k, F.asc("score") if metric == "l2" else F.desc("score"), F.asc("id"))


def by_meaning(memories: DataFrame, buckets: Sequence[int], weights: Sequence[float]) -> DataFrame:
    """memories (with sparse unit vectors: buckets, weights) and `similarity`, their cosine with the vector of a query; 0 without a vector.

    The query is a literal, so a filter on the text stays below it, and only rows that pass are compared.
    """
    asked = F.map_from_arrays(F.array(*[F.lit(int(b)) for b in buckets]).cast("array<int>"), F.array(*[F.lit(float(w)) for w in weights]).cast("array<double>"))
    parts = F.zip_with("buckets", "weights", lambda b, w: w * F.coalesce(F.try_element_at(asked, b), F.lit(0.0)))
    return memories.withColumn("similarity", F.round(F.coalesce(F.aggregate(parts, F.lit(0.0), lambda s, x: s + x), F.lit(0.0)), 9))


def conversations_with(conversations: DataFrame, messages: DataFrame, pattern: str, role: str | None = None) -> DataFrame:
    """Conversations that hold a matching message: a semi-join, never a row twice."""
    found = messages.filter(holds(F.col("content"), pattern))
    if role is not None:
        found = found.filter(F.col("role") == role)
    return conversations.join(found.select("conv_id"), "conv_id", "left_semi")


def fused(rankings: list[DataFrame], k: int, offset: int = 60) -> DataFrame:
    """Reciprocal-rank fusion of rankings (id, rank)."""
    parts = [r.select("id", (F.lit(1.0) / (F.col("rank") + offset)).alias("part")) for r in rankings]
    total = parts[0]
    for p in parts[1:]:
        total = total.unionByName(p)
    return top(total.groupBy("id").agg(F.sum("part").alias("score")), k, F.desc(F.round("score", 9)), F.asc("id"))


def bundle(blocks: dict[str, DataFrame]) -> DataFrame:
    """The named blocks (id, rank) under one another."""
    out = None
    for name, df in blocks.items():
        rows = df.select(F.lit(name).alias("block"), "rank", "id")
        out = rows if out is None else out.unionByName(rows)
    return out


def budgeted(ranked: DataFrame, items: int, tokens: int, group: str = "project_id", cost: str = "tokens", candidates: int = 10, ident: str = "id") -> DataFrame:
    """Greedy choice in order of rank under limits of items and tokens; what does not fit is passed over.

    Each group's first `candidates` rows (a parameter of the feature) are folded in one expression.
    """
    cut = ranked.filter(F.col("rank") <= candidates)
    listed = cut.groupBy(group).agg(F.sort_array(F.collect_list(F.struct("rank", F.col(ident).cast("long").alias("id"), F.col(cost).alias("cost")))).alias("rows"))
    state = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<bigint>").alias("ids"))
    fold = F.aggregate("rows", state, lambda s, r: F.when((F.size(s["ids"]) < items) & (s["used"] + r["cost"] <= tokens), F.struct((s["used"] + r["cost"]).alias("used"), F.concat(s["ids"], F.array(r["id"])).alias("ids"))).otherwise(s))
    return listed.select(group, fold.alias("s")).select(group, F.col("s.used").alias("used_tokens"), F.posexplode_outer("s.ids").alias("position", "id")).filter("id is not null")


def selected(memories: DataFrame, conversations: DataFrame, items: int = 15, tokens: int = 3000, most_memories: int = 10, most_conversations: int = 5) -> DataFrame:
    """What is put into a session's context, by project: the best memories, then conversations, as far as the budget goes.

    Both: project_id, id, rank, tokens. What does not fit is passed over.
    """
    both = memories.filter(F.col("rank") <= most_memories).select("project_id", "id", "rank", "tokens", F.lit("memory").alias("kind"))
    talks = conversations.filter(F.col("rank") <= most_conversations).select("project_id", "id", (F.col("rank") + most_memories).alias("rank"), "tokens", F.lit("conversation").alias("kind"))
    every = both.unionByName(talks)
    chosen = budgeted(every, items, tokens, candidates=most_memories + most_conversations, ident="rank").withColumnRenamed("id", "rank")
    return chosen.join(every, ["project_id", "rank"]).select("project_id", "position", "kind", "id", "used_tokens")
