"""Every query against its SQL on the smallest tables."""

from __future__ import annotations

import re

import duckdb
import pytest

from recollect import queries as own

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from read_parquet('{sf}/{t}.parquet')")
    return c


def plain(v):
    if isinstance(v, list | tuple):
        return tuple(map(plain, v))
    return round(float(v), 5) if isinstance(v, float) or hasattr(v, "as_tuple") else v


@pytest.mark.parametrize("name", list(own.SQL))
def test_same_as_sql(spark, sf, duck, name):
    df = own.QUERIES[name](spark, sf)
    got = sorted(repr(tuple(plain(r[c]) for c in sorted(df.columns))) for r in df.collect())
    cursor = duck.execute(own.SQL[name])
    names = [x[0] for x in cursor.description]
    want = sorted(repr(tuple(plain(dict(zip(names, r, strict=True))[c]) for c in sorted(names))) for r in cursor.fetchall())
    assert sorted(df.columns) == sorted(names)
    assert got == want


def word_sets(spark, sf):
    """project -> [(id, words, text)] in order of id, by plain Python."""
    out = {}
    for r in sorted(spark.read.parquet(f"{sf}/documents.parquet").collect(), key=lambda r: r.doc_id):
        out.setdefault(r.source, []).append((r.doc_id, {w for w in re.split(r"[\s\u00a0\ufeff]+", r.text.lower()) if len(w) > 2}, r.text))
    return out


def clusters(rows):
    """id -> seed: the first earlier seed that is like it by more than 0.8, else itself."""
    seeds, home = [], {}
    for i, own_words, _ in rows:
        home[i] = next((s for s, w in seeds if len(own_words & w) > 0.8 * len(own_words | w)), None) if own_words else next((s for s, w in seeds if not w and False), None)
        if home[i] is None:
            home[i] = i
            seeds.append((i, own_words))
    return home


def test_clusters_by_brute_force(spark, sf):
    got = {(r.project_id, r.id): r.seed for r in own.QUERIES["jaccard_clusters"](spark, sf).collect()}
    want = {(p, i): seed for p, rows in word_sets(spark, sf).items() for i, seed in clusters(rows).items()}
    some = {k for k in want if want[k] != k[1]}
    assert got.keys() == want.keys() and {k: got[k] for k in some} == {k: want[k] for k in some} and some


def test_recovery_by_brute_force(spark, sf):
    got = {r.project_id: (r.recovered, r.clusters) for r in own.QUERIES["token_recovery"](spark, sf).collect()}
    for project, rows in word_sets(spark, sf).items():
        home = clusters(rows)
        tokens = {i: -(-len(t.encode("utf-16-be")) // 8) for i, _, t in rows}
        members = {s: [i for i in home if home[i] == s] for s in set(home.values())}
        assert got[project] == (sum(tokens[i] for i in home if home[i] != i), sum(len(m) > 1 for m in members.values()))


def test_every_query_is_held_against_something():
    assert {n for n in own.QUERIES if n not in own.SQL} == {"simhash_literal", "vector_index_each"}


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns == ["id_a", "id_b", "similarity", "level", "reason"]
