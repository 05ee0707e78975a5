import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from recollect.llm import jaccard as J
from recollect.llm.components import components
from tests.llm.helpers import clashing, table, words


def brute(docs):
    sets = {}
    for i, t in docs:
        w = words(t, True)
        sets[i] = frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])
    home = {i: i for i in sets}

    def find(x):
        while home[x] != x:
            x = home[x]
        return x

    at = defaultdict(list)
    for i, s in sets.items():
        for g in s:
            at[g].append(i)
    for i, s in sets.items():
        for j in {j for g in s for j in at[g] if j < i}:
            both = len(s & sets[j])
            if 100 * both >= 75 * (len(s) + len(sets[j]) - both):
                x, y = find(i), find(j)
                home[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def result(df):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in df.collect()}


def test_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert result(J.linked(docs)) == brute([(r.doc_id, r.text) for r in docs.collect()])


def variants(seed, n, length, most):
    r = random.Random(seed)
    base = [f"w{r.randrange(5000)}" for _ in range(length)]
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(r.randint(0, most)):
            k = r.randrange(len(w))
            w[k : k + r.randint(0, 2)] = [f"v{r.randrange(5000)}"] * r.randint(0, 2)
        out.append(" ".join(w))
    return out


def test_groups_near_the_threshold(spark):
    docs = [t for k, (n, length, most) in enumerate([(60, 60, 5), (40, 200, 12), (30, 9, 1), (30, 7, 1), (40, 400, 25), (20, 1000, 40)]) for t in variants(k, n, length, most)]
    docs += [" ".join(random.Random(9).choices("abcdefgh", k=12)) for _ in range(20)]
    random.Random(1).shuffle(docs)
    rows = [(i, t, "en", "s") for i, t in enumerate(docs)]
    assert result(J.linked(table(spark, rows).repartition(3))) == brute(enumerate(docs))


@pytest.mark.parametrize(("long", "part"), [(4, 8), (64, 1024)])
def test_long_runs(spark, monkeypatch, long, part):
    """A large group in several tasks, texts near it and texts that share passages with it."""
    monkeypatch.setattr(J, "LONG", long)
    monkeypatch.setattr(J, "PART", part)
    docs = variants(1, 150, 80, 6) + variants(2, 40, 80, 14) + [t + " " + " ".join(f"z{k}{j}" for j in range(30)) for k, t in enumerate(variants(1, 20, 80, 3))]
    rows = [(i, t, "en", "s") for i, t in enumerate(docs)]
    random.Random(2).shuffle(rows)
    assert result(J.linked(table(spark, rows).repartition(4))) == brute([(i, t) for i, t, *_ in rows])


def test_a_large_group_of_near_copies(spark):
    """50,000 texts that differ in one word, 40 that differ in more, and a few alone."""
    base = [f"w{k}" for k in range(12)]
    near = spark.range(50_000).selectExpr("id as doc_id", f"concat('{' '.join(base)} x', id, ' {' '.join(f'u{k}' for k in range(60))}') as text")
    apart = spark.range(50_000, 50_040).selectExpr("id as doc_id", f"concat('{' '.join(base[:7])} y', id, ' {' '.join(f'u{k}' for k in range(40))}') as text")
    other = spark.range(60_000, 60_010).selectExpr("id as doc_id", "concat('a text with few words number ', id) as text")
    got = J.linked(near.unionAll(apart).unionAll(other).repartition(8)).groupBy("component_id").count().collect()
    assert {r.component_id: r["count"] for r in got if r["count"] > 1} == {0: 50_000, 50_000: 40} and len(got) == 12


def test_large_groups_are_named_without_their_key(spark, monkeypatch):
    monkeypatch.setattr(J, "LARGE", 3)
    rows = [(i, k, 0, 5, label) for i, (k, label) in enumerate([(9, 9), (1, 9), (2, 9), (3, 3), (4, 3), (5, 5), (6, 6)])] + [(None, 7, 0, 5, 7), (8, 8, 0, 0, 8)]
    placed = spark.createDataFrame(rows, "id long, key long, check long, n int, label long")
    groups = placed.filter("n > 0").groupBy("label").agg(F.min("id").alias("smallest"), F.count("*").alias("size")).filter("size > 1")
    got = {r.doc_id: r.component_id for r in J.named(placed, groups, 8, "doc_id").collect()}
    assert got == {0: 0, 1: 0, 2: 0, 3: 3, 4: 3, 5: 5, 6: 6, None: None, 8: 8}


def test_edges(spark):
    got = J.linked(clashing(spark)).collect()
    by = defaultdict(set)
    for r in got:
        by[r.doc_id].add((r.n_shingles, r.component_id))
    assert len(got) == 13 and by[2] == {(0, 2)} and by[3] == {(0, 3)} and by[4] == {(0, 4)} and by[5] == by[6] == {(1, 5)} and by[9] == {(1, 9)}
    assert {c for _, c in by[7] | by[8]} == {7}
    assert J.linked(table(spark, [])).count() == 0
    assert result(J.linked(table(spark, [(1, None, None, None), (2, "", None, None)]))) == {1: (0, 1), 2: (0, 2)}


def test_sketch_distance_is_a_lower_bound():
    rng = np.random.default_rng(2)
    for _ in range(300):
        pool = rng.integers(0, 1 << 63, 400, dtype=np.uint64)
        a, b = (np.unique(rng.choice(pool, rng.integers(1, 400))) for _ in range(2))
        assert J.hamming(J.parity(a), J.parity(b)) <= len(np.setxor1d(a, b))


def test_components_of_a_chain(spark):
    edges = spark.range(60).selectExpr("id + 1 as a", "id as b")
    assert {(r.node, r.label) for r in components(edges).collect()} == {(k, 0) for k in range(61)}


@pytest.mark.parametrize("frequent", [2, 1 << 30])
def test_any_order_of_blocks_is_right(spark, sf, frequent, monkeypatch):
    monkeypatch.setattr(J, "FREQUENT", frequent)
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(80)
    assert result(J.linked(docs)) == brute([(r.doc_id, r.text) for r in docs.collect()])
