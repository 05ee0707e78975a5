from collections import Counter

import pytest

from recollect.llm import mixing as M
from recollect.llm.queries import QUERIES, SQL
from tests.llm.helpers import clashing, table, words
from tests.llm.oracle import rows_of_frame, rows_of_sql


def rounds(sizes, weights, budget, most):
    """Clamp, share anew, repeat: the definition, one round at a time."""
    cap = {s: most * n for s, n in sizes.items()}
    clamped = {s for s in sizes if not weights[s] > 0}
    target = dict.fromkeys(clamped, 0.0)
    while True:
        rest = [s for s in sizes if s not in target]
        total = sum(weights[s] for s in rest)
        share = {s: (budget - sum(target.values())) * weights[s] / total for s in rest}
        over = [s for s in rest if share[s] > cap[s]]
        if not over:
            return target | share
        target |= {s: cap[s] for s in over}


def documents(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")


@pytest.mark.parametrize("case", range(6))
def test_water_filling(spark, case):
    sizes = [{"a": 100, "b": 900, "c": 50}, {"a": 1, "b": 1000, "c": 2, "d": 3}, {"a": 0, "b": 10}, {"a": 7}, {"a": 5, "b": 5, None: 5}, {"a": 10, "b": 20, "c": 1000}][case]
    weights = [{"a": 5.0, "b": 2.0, "c": 1.0}, {"a": 9.0, "b": 1.0, "c": 9.0, "d": 1.0}, {"a": 5.0, "b": 2.0}, {"a": 3.0}, {"a": 1.0, "b": 1.0, None: 1.0}, {"a": 3.0, "b": 1.0, "c": 0.0}][case]
    sources = spark.createDataFrame([(s, n, weights[s]) for s, n in sizes.items()], "source string, source_size long, weight double")
    share = 0.02 if case == 5 else 1.5
    want = rounds(sizes, weights, share * sum(sizes.values()), 2.0)
    got = {r.source: r.target for r in M.filled(sources, share, 2.0).collect()}
    assert got == pytest.approx(want)


def test_infeasible_budget_and_odd_weights(spark):
    sources = spark.createDataFrame([("a", 10, 1.0), ("b", 10, None), ("c", 10, float("nan")), ("d", 10, -1.0), ("e", 10, float("inf"))], "source string, source_size long, weight double")
    assert {r.source: r.target for r in M.filled(sources, 9.0, 2.0).collect()} == {"a": 20.0, "b": 0.0, "c": 0.0, "d": 0.0, "e": 0.0}


def test_equals_sql(spark, sf):
    got = QUERIES["op11_capped_mixture"](spark, sf)
    assert rows_of_frame(got) == rows_of_sql(SQL["op11_capped_mixture"], sf)
    assert rows_of_frame(QUERIES["op11_capped_mixture"](spark, sf)) == rows_of_frame(got)  # reruns agree


@pytest.mark.parametrize("hot", [False, True])
def test_targets_are_met(spark, hot):
    rows = [(i, " ".join(["w"] * (i % 37 + 1)), "en", "hot" if hot and i % 3 else f"s{i % 5}" if i % 11 else None) for i in range(3000)]
    docs = documents(spark, rows)
    source = {r[0]: r[3] for r in rows}
    taken, target = Counter(), {}
    for r in M.taken_words(docs).collect():
        assert 0 <= r.taken <= 2 * r.size and r.size == len(words(rows[r.doc_id][1]))
        taken[source[r.doc_id]] += r.taken
        target[source[r.doc_id]] = r.target
    assert all(abs(taken[s] - t) <= 1 for s, t in target.items())
    assert sum(target.values()) == pytest.approx(1.5 * sum(len(words(r[1])) for r in rows))


def test_odd_rows_layout_and_sql(spark, sf):
    docs = table(spark)
    got = M.taken_words(docs)
    assert rows_of_frame(got) == rows_of_frame(M.taken_words(docs.repartition(7)))
    assert rows_of_frame(got) == rows_of_sql(SQL["op11_capped_mixture"], sf, documents=docs.toArrow())
    assert M.taken_words(table(spark, [])).count() == 0
    assert {(r.size, r.taken) for r in M.taken_words(table(spark, [(1, None, None, None), (2, "", "en", "s")])).collect()} == {(0, 0)}


def test_repeated_rows_share_their_fate(spark):
    docs = documents(spark, [(1, "a b c", "en", "s")] * 50 + [(2, "d e", "en", "t"), (3, "x", "en", "s")])
    taken = {}
    for r in M.taken_words(docs).collect():
        taken.setdefault(r.doc_id, set()).add(r.taken)
    assert all(len(v) == 1 for v in taken.values())


def test_mix_holds_the_texts(spark):
    docs = clashing(spark).filter("doc_id is not null").withColumn("repetition", M.F.lit("mine"))
    docs = docs.selectExpr("*", "1 as key2", "2 as size", "3 as cut", "4 as target")
    out = M.mixed(docs, M.cyclic_weights(docs))
    assert out.columns == [c if c != "repetition" else "repetition_in" for c in docs.columns] + ["repetition"]
    counts = Counter((r.doc_id, r.text) for r in out.collect())
    size = {(r.doc_id, r.text): len(words(r.text)) for r in docs.collect()}
    rows = Counter((r.doc_id, r.text) for r in docs.collect())
    want = {(r.doc_id): r.taken for r in M.taken_words(docs).collect()}
    assert all(counts[k] * n == want[k[0]] * rows[k] for k, n in size.items() if n)
    assert not out.filter("repetition > 1").count()
    assert M.mixed(docs.limit(0), M.cyclic_weights(docs)).count() == 0
