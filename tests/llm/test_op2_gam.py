import math

import numpy as np
import pyarrow as pa

from recollect.llm import gam
from recollect.llm.queries import QUERIES
from tests.llm.helpers import clashing, table, words
from tests.llm.test_op3_repetition import covered


def area(score, y):
    rank = np.argsort(np.argsort(score)) + 1
    n1, n0 = (y == 1).sum(), (y == 0).sum()
    return (rank[y == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * n0)


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    got = QUERIES["op2_additive_quality"](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").filter("held_out").toPandas()
    assert area(got.score.to_numpy(), got.quality.to_numpy()) > 0.95
    assert ((got.predicted == 1) == (got.score >= 0.3)).all() and got.score.between(0, 1).all()


def test_interactions_are_learnt():
    rng = np.random.default_rng(0)
    x = rng.random((3000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)  # no single feature tells
    m = gam.fit(x[:2000], y[:2000])
    assert (0, 1) in m.pairs and area(m.score(x[2000:]), y[2000:]) > 0.95


def test_scores_are_sums_of_table_entries():
    rng = np.random.default_rng(1)
    x, y = rng.random((500, 4)), rng.integers(0, 2, 500).astype(float)
    m = gam.fit(x, y, rounds=5, pair_rounds=5)
    for row, score in zip(x[:20], m.score(x[:20]), strict=True):
        total = m.intercept + sum(t[np.searchsorted(e, v)] for e, t, v in zip(m.edges, m.tables, row, strict=True))
        total += sum(t[np.searchsorted(m.coarse[f], row[f]), np.searchsorted(m.coarse[g], row[g])] for (f, g), t in zip(m.pairs, m.pair_tables, strict=True))
        assert abs(score - 1 / (1 + np.exp(-total))) < 1e-12


def test_edges(spark):
    labels = spark.createDataFrame([(1, 1), (5, 0), (1, 0), (3, None), (None, 1), (99, 1)], "doc_id long, quality int")
    got = gam.quality_scores(clashing(spark), labels).collect()
    assert len(got) == 13 and all(0 <= r.score <= 1 for r in got)
    assert gam.quality_scores(table(spark, []), labels).count() == 0
    none = gam.quality_scores(table(spark), labels.limit(0)).collect()
    assert {r.score for r in none} == {0.5}


def test_labels_of_held_out_rows_change_nothing(spark):
    docs = table(spark, [(i, f"text {i} " * (i % 7 + 1), "en", "s") for i in range(60)])
    labels = docs.selectExpr("doc_id", "cast(doc_id % 2 as int) quality")
    other = labels.selectExpr("doc_id", "case when crc32(cast(cast(doc_id as string) as binary)) % 5 = 0 then 1 - quality else quality end quality")
    score = lambda x: {r.doc_id: r.score for r in gam.quality_scores(docs, x).collect()}
    assert score(labels) == score(other)


def by_hand(text):
    """The features, one character at a time."""
    raw, w = (text or "").encode(), [x.encode() for x in words(text)]
    n, size, sizes = max(1, len(w)), max(1, len(raw)), [len(x) for x in w]
    mean = sum(sizes) / n
    letter = set(b"0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ") | set(range(128, 256))
    shares = {k: sum(b in v for b in raw) for k, v in gam.CLASSES.items()}
    return [
        math.log(1 + len(raw)), math.log(1 + len(w)), mean, math.sqrt(max(0, sum(x * x for x in sizes) / n - mean * mean)), len(set(w)) / n, sum(covered(w, 5)) / n,
        math.log(1 + len(w) / (shares["newline"] + 1)), sum(x[-1] not in letter for x in w) / n, *(v / size for v in shares.values()),
    ]


def test_features_by_hand(spark, sf):
    rows = [r.text for r in table(spark).collect()] + [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = gam.features(pa.array(rows, pa.string()))
    assert got.shape == (len(rows), len(gam.FEATURES)) and np.allclose(got, [by_hand(t) for t in rows], atol=1e-7)


def test_repeated_ids_train_alike_whatever_the_layout(spark):
    docs = table(spark, [(i % 40, f"text {i} " * (i % 7 + 1), "en", "s") for i in range(120)])
    labels = spark.range(40).selectExpr("id as doc_id", "cast(id % 2 as int) quality")
    one, two = (gam.training_rows(d, labels) for d in (docs.repartition(1), docs.orderBy("text").repartition(7)))
    assert len(one[1]) > 20 and all((a == b).all() for a, b in zip(one, two, strict=True))


def test_double_clashes(spark):
    docs = table(spark).selectExpr("doc_id", "text", "1 as score", "2 as score_in", "3 as predicted")
    out = gam.quality_scores(docs, spark.createDataFrame([(1, 1)], "doc_id long, quality int"), keep=docs.columns)
    assert len(set(out.columns)) == len(out.columns) and out.select("score").dtypes == [("score", "double")] and out.count() == 13
