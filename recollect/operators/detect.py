"""Near-duplicate memories: fingerprints, blocking joins, ranking and clusters."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from recollect.functions import hashing
from recollect.functions import scoring as X
from recollect.functions.embedding import packed
from recollect.functions.hashing import hamming, signature_similarity
from recollect.sources.storage import kept as stored

#: What a pair of stage 1 says of itself (fixed values).
CANDIDATE_LEVEL, CANDIDATE_REASON = "low", "Stage 1 candidate (embedding analysis skipped)"
#: Most rows of a key on one side of a comparison (about).
PART = 8192


def _distinct_values(prints: DataFrame, column: str) -> DataFrame:
    """Each fingerprint once, with its smallest id: copies are expanded after the join, not in it."""
    return prints.groupBy(column).agg(F.min("id").alias("id"))


def hamming_pairs(prints: DataFrame, most: int = 4, column: str = "simhash") -> DataFrame:
    """(id_a, id_b, distance) of distinct fingerprints within so many bits, each by its smallest id.

    Exact: all fingerprints are compared, in blocks (see tiles). Blank texts (0) are left out, and
    equal fingerprints are one row (see print_groups for their members).
    """
    from recollect.operators import tiles

    values = _distinct_values(prints.filter(F.col(column) != 0), column)
    return tiles.close_pairs(values.select("id", F.col(column).alias("simhash")), most)


def dealt(keyed: DataFrame) -> DataFrame:
    """keyed (id, band, key, ...) by the runs to compare them in: all that share a key, in parts of PART rows, each pair of parts a run."""
    shared = keyed.groupBy("key").agg(F.ceil(F.count("*") / PART).cast("int").alias("parts"), F.count("*").alias("n")).filter("n > 1").drop("n")
    placed = keyed.join(shared, "key").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    run = F.xxhash64("key", F.least("part", "other"), F.greatest("part", "other"))
    placed = placed.withColumn("run", run).withColumn("alone", F.col("part").eqNullSafe(F.col("other")))
    return placed.drop("other", "parts", "key").repartition("run").sortWithinPartitions("run", "part")


def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Whole runs of two rows or more."""
    held, last = [], None
    for b in batches:
        key = b.column(b.schema.get_field_index("run")).to_numpy()
        edge = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]])) if len(key) else np.zeros(0, np.int64)
        for a, z in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
            if held and key[a] != last:
                if sum(map(len, held)) > 1:
                    yield pa.concat_tables(held).combine_chunks()
                held = []
            last = key[a]
            held.append(pa.Table.from_batches([b.slice(a, z - a)]))
    if sum(map(len, held)) > 1:
        yield pa.concat_tables(held).combine_chunks()


def minhash_pairs(signatures: DataFrame, least: float = 0.7) -> DataFrame:
    """(id_a, id_b, similarity) of distinct signatures that agree on that share of places; exact.

    Equal signatures are one row, by their smallest id (see print_groups for their members); values
    have 32 bits, as minhash gives them. All signatures are compared, in blocks (see tiles).
    """
    from recollect.operators import tiles

    return tiles.pairs(signatures.groupBy("minhash").agg(F.min("id").alias("id")), None, least).select("id_a", "id_b", "similarity")


def print_groups(prints: DataFrame, column: str) -> DataFrame:
    """(id, first_id): each id with the smallest one that has an equal fingerprint; null equals null.

    Fingerprints are made once, and kept. First ids are few where a fingerprint has many rows, and AQE sends them to these.
    """
    found = stored(prints.select("id", F.col(column).alias("value")), "groups")
    first = found.groupBy("value").agg(F.min("id").alias("first_id")).withColumnRenamed("value", "same")
    return found.join(first, F.col("value").eqNullSafe(F.col("same"))).select("id", "first_id")


def text_classes(memories: DataFrame) -> DataFrame:
    """(id, class_id): each memory with the smallest id that has its text, letter for letter (by SHA-256 and length); null is the empty text."""
    text = F.coalesce("content", F.lit(""))
    hashed = memories.select("id", F.sha2(text, 256).alias("digest"), F.length(text).alias("n"))
    first = hashed.groupBy("digest", "n").agg(F.min("id").alias("class_id"))
    return hashed.join(first, ["digest", "n"]).select("id", "class_id")


def mergeable(memories: DataFrame, project: str | None = None, kind: str | None = None) -> DataFrame:
    """Memories that detection looks at, of one project or type if given."""
    m = memories.filter("is_mergeable and not is_merged and is_active")
    if project is not None:
        m = m.filter(F.col("project_id") == project)
    return m if kind is None else m.filter(F.col("type") == kind)


def fingerprints(memories: DataFrame) -> DataFrame:
    """(id, simhash, minhash) of each memory."""
    return hashing.prints(memories.select("id", "content"))


def simhash_candidates(prints: DataFrame, target: int, most: int = 4) -> DataFrame:
    """(id, distance): others within so many bits of one target; a scan, as its fingerprint is a literal."""
    own = prints.filter(F.col("id") == target).select("simhash").first()
    if own is None:
        return prints.select("id", F.lit(0).alias("distance")).filter(F.lit(False))
    distance = hamming(F.col("simhash"), F.lit(own[0]))
    return prints.filter(F.col("id") != target).select("id", distance.alias("distance")).filter(F.col("distance") <= most)


def minhash_candidates(prints: DataFrame, target: int, least: float = 0.7) -> DataFrame:
    """(id, similarity): others whose signature agrees with one target's in that share of places."""
    own = prints.filter(F.col("id") == target).select("minhash").first()
    if own is None:
        return prints.select("id", F.lit(0.0).alias("similarity")).filter(F.lit(False))
    alike = signature_similarity(F.col("minhash"), F.array(*[F.lit(int(x)).cast("long") for x in own[0]]))
    return prints.filter(F.col("id") != target).select("id", alike.alias("similarity")).filter(F.col("similarity") >= least)


def heads(memories: DataFrame) -> DataFrame:
    """Of each class of copies the memory of the smallest id."""
    return memories.join(text_classes(memories).filter("id = class_id").select("id"), "id", "left_semi")


def candidates(memories: DataFrame, most: int = 4, least: float = 0.7) -> DataFrame:
    """(id_a, id_b, matched, score) of distinct texts within so many bits or of so much MinHash similarity.

    matched is both, simhash or minhash; score is the larger of the two similarities. Texts that
    differ pair even if their fingerprints are equal; copies of a text are one class (see
    text_classes), here by its smallest id.
    """
    from recollect.operators import tiles

    return tiles.pairs(fingerprints(heads(memories)), most, least).select("id_a", "id_b", "matched", "score")


def stage_one(memories: DataFrame, most: int = 4, least: float = 0.7) -> DataFrame:
    """candidates(), and each class of copies as pairs of its smallest id with its other members (both, 1)."""
    copies = text_classes(memories).filter("id <> class_id").select(F.col("class_id").alias("id_a"), F.col("id").alias("id_b"), F.lit("both").alias("matched"), F.lit(1.0).alias("score"))
    return candidates(memories, most, least).unionByName(copies)


def cosines(pairs: DataFrame, weights: DataFrame) -> DataFrame:
    """pairs with `similarity`, the cosine of sparse unit vectors (id, bucket, weight), to nine places; 0 without common buckets.

    Vectors travel as one row an id; a pair's product is taken where both have arrived.
    """
    vectors = packed(weights)
    a, b = (vectors.select(F.col("id").alias(f"id_{k}"), F.map_from_arrays("buckets", "weights").alias(f"v_{k}")) for k in "ab")
    product = F.aggregate(F.map_entries("v_a"), F.lit(0.0), lambda s, e: s + e["value"] * F.coalesce(F.try_element_at("v_b", e["key"]), F.lit(0.0)))
    both = pairs.join(a, "id_a", "left").join(b, "id_b", "left")
    return both.withColumn("similarity", F.round(F.coalesce(product, F.lit(0.0)), 9)).select(*pairs.columns, "similarity")


def detected(memories: DataFrame, weights: DataFrame, threshold: float = 0.85, per_node: int = 10, limit: int = 50, stage1_only: bool = False) -> DataFrame:
    """(id_a, id_b, similarity, method, level, reason): likely duplicates among mergeable memories, best first chosen.

    Stage 1 finds pairs by fingerprints; stage 2 keeps those of a cosine of `threshold` or more and
    chooses greedily, each memory in at most per_node pairs, `limit` in all. Both are done where
    fingerprints are compared, and only pairs that the choice can take go further (see
    tiles.top_pairs), so the tables in between grow with the memories, not with their pairs.
    stage1_only gives all pairs of the first stage with its score.
    """
    from recollect.operators import tiles

    if stage1_only:
        pairs = stage_one(memories)
        method = F.when(F.col("matched") == "both", "simhash").otherwise(F.col("matched"))
        return pairs.select("id_a", "id_b", F.col("score").alias("similarity"), method.alias("method"), F.lit(CANDIDATE_LEVEL).alias("level"), F.lit(CANDIDATE_REASON).alias("reason"))
    ranked = stored(tiles.top_pairs(memories, weights, threshold, per_node, limit), "ranked")
    return explained(greedy_pairs(ranked, per_node, limit), memories).select("id_a", "id_b", "similarity", F.lit("embedding").alias("method"), "level", "reason")


def explained(pairs: DataFrame, memories: DataFrame) -> DataFrame:
    """Pairs (id_a, id_b, similarity) with what confidence and reason go by: types, tag overlap, length ratio."""
    info = memories.select("id", "type", "tags", F.length("content").alias("len"))
    a, b = (info.select(*[F.col(c).alias(f"{c}_{k}") for c in info.columns]) for k in "ab")
    both = pairs.select("id_a", "id_b", "similarity").join(a, "id_a").join(b, "id_b")
    scored = both.withColumns({"overlap": X.tag_overlap(F.col("tags_a"), F.col("tags_b")), "ratio": X.length_ratio(F.col("len_a"), F.col("len_b"))})
    level = X.confidence_level(F.col("similarity"), F.col("type_a") == F.col("type_b"), F.col("overlap"))
    return scored.withColumn("level", level).withColumn("reason", X.merge_reason(F.col("similarity"), F.col("type_a"), F.col("type_b"), F.col("overlap"), F.col("ratio"), F.col("level")))


def analysed(memories: DataFrame, weights: DataFrame, a: int, b: int) -> DataFrame:
    """One pair with its cosine, factors, level and reason; no row if a memory or its vector is missing."""
    both = memories.filter(F.col("id").isin(a, b))
    known = weights.filter(F.col("id").isin(a, b))
    pair = both.select("id").join(known.select("id").distinct(), "id").agg(F.min("id").alias("id_a"), F.max("id").alias("id_b")).filter("id_a < id_b")
    return explained(cosines(pair, known), both)


def described(pairs: DataFrame, memories: DataFrame, vectors: DataFrame) -> DataFrame:
    """Pairs with the cosine of stored vectors (id, v), confidence level and reason; those without both vectors drop out."""
    a, b = (vectors.select(F.col("id").alias(f"id_{k}"), F.col("v").alias(f"v_{k}")) for k in "ab")
    both = pairs.select("id_a", "id_b").join(a, "id_a").join(b, "id_b")
    return explained(both.withColumn("similarity", X.cosine(F.col("v_a"), F.col("v_b"))), memories)


def greedy_pairs(pairs: DataFrame, per_node: int = 10, most: int = 50) -> DataFrame:
    """Best pairs first (similarity, ids), each node in at most per_node of them, at most `most` in all.

    pairs has each pair once. The choice is sequential, but of a node only its first
    per_node + 2 * most / per_node pairs can be chosen: one is passed over only because the node
    itself is full, or the other end, and no more than 2 * most / per_node nodes ever fill up. Each
    pair passed over has a full end, which bounds how many of the best of these pairs matter.
    """
    full = 2 * most // per_node
    nodes = W.partitionBy("node").orderBy(F.desc("similarity"), "id_a", "id_b")
    ends = pairs.select("id_a", "id_b", "similarity", F.explode(F.array("id_a", "id_b")).alias("node"))
    first = ends.withColumn("rank", F.row_number().over(nodes)).filter(F.col("rank") <= per_node + full)
    both = first.groupBy("id_a", "id_b").agg(F.first("similarity").alias("similarity"), F.count("*").alias("ends")).filter("ends = 2")
    best = both.orderBy(F.desc("similarity"), "id_a", "id_b").limit(most + full * (per_node + full))

    def choose(frame: pd.DataFrame) -> pd.DataFrame:
        used: dict[int, int] = {}
        keep = []
        for i, (a, b) in enumerate(zip(frame["id_a"], frame["id_b"], strict=True)):
            if len(keep) < most and used.get(a, 0) < per_node and used.get(b, 0) < per_node:
                used[a], used[b] = used.get(a, 0) + 1, used.get(b, 0) + 1
                keep.append(i)
        return frame.iloc[keep]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        whole = pd.concat(list(frames) or [pd.DataFrame(columns=["id_a", "id_b", "similarity"])])
        yield choose(whole.sort_values(["similarity", "id_a", "id_b"], ascending=[False, True, True]))

    return best.select("id_a", "id_b", "similarity").coalesce(1).mapInPandas(run, "id_a long, id_b long, similarity double")
