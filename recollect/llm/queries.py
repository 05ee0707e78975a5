"""The registered queries of the training-data operators and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op2_additive_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from recollect.llm.gam import quality_scores

    scores = quality_scores(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return scores.select("doc_id", "held_out", "score", "predicted")


def op3_repetition_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from recollect.llm.repetition import quality_rules

    return quality_rules(_documents(spark, sf_dir))


def op1_media_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    from recollect.llm.media import media_features

    return media_features(_documents(spark, sf_dir))


def op10_warc_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    from recollect.llm.warc import archived_pages

    return archived_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op4_streaming_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    from recollect.llm.pieces import round_trips

    return round_trips(_documents(spark, sf_dir))


def op5_parity_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from recollect.llm.jaccard import linked

    return linked(_documents(spark, sf_dir))


def op6_chunk_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from recollect.llm.substring import without_repeats

    return without_repeats(_documents(spark, sf_dir).select("doc_id", "text"))


def op7_edit_aware_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three edits a document: a word put in at a third, ten characters cut at the half, the end changed."""
    from recollect.llm.tokentree import edited_counts

    n = F.length(F.coalesce("text", F.lit("")))
    edit = lambda start, end, new: F.struct(start.cast("long").alias("start"), end.cast("long").alias("end"), F.lit(new).alias("replacement"))
    edits = F.array(edit(F.floor(n / 3), F.floor(n / 3), " revised"), edit(F.floor(n / 2), F.floor(n / 2) + 10, ""), edit(n - 5, n, "the end."))
    return edited_counts(_documents(spark, sf_dir).select("doc_id", "text", edits.alias("edits")))


def op8_lattice_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    from recollect.llm.lattice import likelihoods

    return likelihoods(_documents(spark, sf_dir))


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from recollect.llm.packing import packed

    return packed(_documents(spark, sf_dir))


def op11_capped_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    from recollect.llm.mixing import taken_words

    return taken_words(_documents(spark, sf_dir))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    from recollect.llm.divergence import audit

    return audit(_documents(spark, sf_dir))


def op13_welford_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whitening's rows, one per component, beside how far its own covariance is from the identity."""
    from recollect.llm.whitening import components_long

    return components_long(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "pipeline": pipeline,
    "op1_media_archive": op1_media_archive,
    "op10_warc_roundtrip": op10_warc_roundtrip,
    "op2_additive_quality": op2_additive_quality,
    "op3_repetition_rules": op3_repetition_rules,
    "op4_streaming_pieces": op4_streaming_pieces,
    "op5_parity_jaccard": op5_parity_jaccard,
    "op6_chunk_dedup": op6_chunk_dedup,
    "op7_edit_aware_counts": op7_edit_aware_counts,
    "op8_lattice_likelihood": op8_lattice_likelihood,
    "op9_best_fit_packing": op9_best_fit_packing,
    "op11_capped_mixture": op11_capped_mixture,
    "op12_source_divergence": op12_source_divergence,
    "op13_welford_whitening": op13_welford_whitening,
}

_DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_FOUR = " || ".join(f"substr('{_DIGITS}', CAST((v >> {shift}) & 31 AS INT) + 1, 1)" for shift in (15, 10, 5, 0))


def _repetition_sql() -> str:
    from recollect.llm import repetition as R

    word, steps, joins, shares = "[^\\x20\\x09-\\x0D]+", [], [], []
    for n in R.NGRAM_LIMITS:
        steps.append(f"""g{n} AS (SELECT doc_id, i, array_to_string(list_slice(w, i, i + {n - 1}), ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - {n - 2})) AS i FROM w WHERE len(w) >= {n})),
 d{n} AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM g{n}) WHERE c > 1), c{n} AS (SELECT DISTINCT doc_id, i + unnest(range(0, {n})) AS i FROM d{n}),
 s{n} AS (SELECT doc_id, count(*) AS words{n}, sum(length(x)) AS chars{n} FROM c{n} JOIN p USING (doc_id, i) GROUP BY 1)""")
        joins.append(f"LEFT JOIN s{n} USING (doc_id)")
        shares.append(f"coalesce(chars{n}, 0) / CAST(greatest(word_chars, 1) AS DOUBLE) AS dup_{n}gram_chars")
    mark = f"[!-/:-@\\[-`{{-~]{{{R.MARK_NGRAM}}}"
    limits = " AND ".join(f"dup_{n}gram_chars <= {v}" for n, v in R.NGRAM_LIMITS.items())
    return f"""WITH w AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{word}') AS w FROM documents), p AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS i FROM w), {', '.join(steps)},
 mg AS (SELECT doc_id, i, substr(t, i, {R.MARK_NGRAM}) AS g FROM (SELECT doc_id, t, unnest(range(1, length(t) - {R.MARK_NGRAM - 2})) AS i FROM w WHERE regexp_matches(t, '{mark}')) WHERE regexp_full_match(substr(t, i, {R.MARK_NGRAM}), '{mark}')),
 mc AS (SELECT doc_id, count(DISTINCT j) AS marks FROM (SELECT doc_id, i + unnest(range(0, {R.MARK_NGRAM})) AS j FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS c FROM mg) WHERE c > 1) GROUP BY 1),
 n AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols FROM w),
 l AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS line, unnest(range(0, len(string_split(t, chr(10))))) AS k FROM w), f AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id, line ORDER BY k) AS r, length(array_to_string(regexp_extract_all(line, '{word}'), '')) AS chars FROM l WHERE regexp_matches(line, '{word}')),
 q AS (SELECT doc_id, count(*) FILTER (WHERE r > 1) AS n_dup_lines, coalesce(sum(chars) FILTER (WHERE r > 1), 0) AS line_chars, count(*) AS lines FROM f GROUP BY 1),
 m AS (SELECT doc_id, n_words, word_chars, n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines, CAST(coalesce(words5, 0) AS BIGINT) AS n_repeat_words, n_words < {R.MIN_WORDS} OR 100 * coalesce(words5, 0) > 20 * n_words AS base_failed, {', '.join(shares)}, coalesce(marks, 0) / CAST(greatest(word_chars, 1) AS DOUBLE) AS dup_mark_chars,
 coalesce(line_chars, 0) / CAST(greatest(word_chars, 1) AS DOUBLE) AS dup_line_chars, coalesce(n_dup_lines, 0) / CAST(greatest(coalesce(lines, 0), 1) AS DOUBLE) AS dup_lines FROM n {' '.join(joins)} LEFT JOIN mc USING (doc_id) LEFT JOIN q USING (doc_id))
 SELECT * EXCLUDE (dup_lines), NOT base_failed AND {limits} AND dup_mark_chars <= {R.MARK_LIMIT} AND dup_line_chars <= {R.LINE_CHAR_LIMIT} AND dup_lines <= {R.LINE_LIMIT} AS kept FROM m"""


SQL: dict[str, str] = {
    "op3_repetition_rules": _repetition_sql(),
    "op10_warc_roundtrip": f"""WITH d AS (SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS x FROM pages),
 f AS (SELECT page_id, payload_bytes, min(page_id) OVER (PARTITION BY x) AS first_id, array_to_string(list_transform(list_transform(range(0, 8), lambda k: CAST('0x' || substr(x, CAST(1 + 5 * k AS INT), 5) AS BIGINT)), lambda v: {_FOUR}), '') AS payload_digest FROM d)
 SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first_id THEN first_id END AS refers_to FROM f""",
    "op5_parity_jaccard": """WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
 s AS (SELECT DISTINCT doc_id, g FROM (SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(list_slice(w, i, i + 4), ' ')) END) AS g FROM w)),
 n AS (SELECT d.doc_id, count(s.g) AS n FROM documents d LEFT JOIN s ON s.doc_id = d.doc_id GROUP BY 1),
 c AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
 l AS (SELECT x, y FROM c JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * c >= 75 * (p.n + q.n - c)), e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
 r AS (SELECT doc_id AS i, doc_id AS j FROM documents UNION SELECT r.i, e.y FROM r JOIN e ON e.x = r.j)
 SELECT n.doc_id, n.n AS n_shingles, min(r.j) AS component_id FROM n JOIN r ON r.i = n.doc_id GROUP BY 1, 2""",
    "op11_capped_mixture": """WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size,
  CAST('0x' || substr(md5(concat_ws('|', '11', coalesce(CAST(doc_id AS VARCHAR), ''), coalesce(source, ''), coalesce(text, ''))), 1, 15) AS BIGINT) AS key FROM documents),
 s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS place FROM d GROUP BY source),
 w AS (SELECT source, source_size, CAST([5, 2, 1][CAST((place - 1) % 3 + 1 AS INT)] AS DOUBLE) AS weight, source_size * CAST(2 AS DOUBLE) AS cap FROM s),
 v AS (SELECT *, (sum(source_size) OVER () * CAST(1.5 AS DOUBLE) - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
 t AS (SELECT source, source_size, least(cap, max(level) OVER () * weight) AS target FROM v),
 p AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole FROM t),
 r AS (SELECT d.*, source_size, target, whole, CAST(floor(target + 0.5) AS BIGINT) - whole * source_size AS goal, sum(size) OVER (PARTITION BY d.source ORDER BY key) AS upto, sum(size) OVER (PARTITION BY d.source, key) AS together FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source),
 c AS (SELECT source, max(goal) AS goal, max(goal) - coalesce(max(upto) FILTER (WHERE upto <= goal), 0) AS rest FROM r WHERE goal > 0 GROUP BY source),
 e AS (SELECT source, key FROM (SELECT r.source, r.key, together, rest, row_number() OVER (PARTITION BY r.source ORDER BY abs(size - rest), r.key) AS k FROM r JOIN c ON r.source IS NOT DISTINCT FROM c.source WHERE upto > c.goal AND size > 0 AND size < 2 * rest) WHERE k = 1 AND abs(together - rest) < rest GROUP BY source, key)
 SELECT doc_id, size, source_size, target, CAST(size * (whole + CASE WHEN goal > 0 AND upto <= goal OR e.key IS NOT NULL THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM r LEFT JOIN e ON r.source IS NOT DISTINCT FROM e.source AND r.key = e.key""",
    "op12_source_divergence": """WITH d AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS w FROM documents),
 t AS (SELECT lang, source, r, unnest(w) AS term FROM d), k AS (SELECT lang, term, count(*) AS c FROM t GROUP BY 1, 2 HAVING count(DISTINCT r) >= 30), g AS (SELECT DISTINCT lang, source FROM d),
 c AS (SELECT lang, source, term, count(*) AS c FROM t GROUP BY ALL), v AS (SELECT lang, count(*) AS v FROM k GROUP BY 1),
 m AS (SELECT g.lang, g.source, k.term, coalesce(c.c, 0) AS c, k.c AS lc, v FROM g JOIN k ON k.lang = g.lang JOIN v ON v.lang = g.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
 p AS (SELECT lang, source, term, c, 1 + CAST(1000000000 AS HUGEINT) * (c + 5) // (sum(c) OVER w + 5 * v) AS p, 1 + CAST(1000000000 AS HUGEINT) * (lc + 5) // (sum(lc) OVER w + 5 * v) AS q FROM m WINDOW w AS (PARTITION BY lang, source)),
 s AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
 u AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(value, 0) AS BIGINT) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
  UNION ALL SELECT lang, source, 'term', term, CAST(p - q AS BIGINT) FROM p WHERE c > 0 AND p > q)
 SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INT) AS rank FROM u) WHERE part = 'pair' OR rank <= 50""",
}
