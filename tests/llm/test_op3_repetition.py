import string
from collections import Counter

import pytest

from recollect.llm import repetition as R
from tests.llm.helpers import clashing, table, texts, words


def covered(w, n):
    grams = Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1))
    cover = [False] * len(w)
    for i in range(len(w) - n + 1):
        if grams[tuple(w[i : i + n])] > 1:
            cover[i : i + n] = [True] * n
    return cover


def marks(text):
    """Characters inside three marks in a row that occur twice or more."""
    at = {}
    for i in range(len(text) - 2):
        if all(c in string.punctuation for c in text[i : i + 3]):
            at.setdefault(text[i : i + 3], []).append(i)
    return len({i + k for found in at.values() if len(found) > 1 for i in found for k in range(3)})


def brute(text):
    w = words(text)
    lines = [x for x in (text or "").split("\n") if words(x)]
    seen, dup, dup_chars = set(), 0, 0
    for x in lines:
        if x in seen:
            dup += 1
            dup_chars += sum(map(len, words(x)))
        seen.add(x)
    chars = sum(map(len, w))
    repeat = sum(covered(w, 5))
    failed = len(w) < 10 or 100 * repeat > 20 * len(w)
    shares = {n: sum(len(x) for x, c in zip(w, covered(w, n), strict=True) if c) / max(1, chars) for n in R.NGRAM_LIMITS}
    symbols = sum(c in "#*$%&|<>" for c in text or "")
    shares["mark"] = marks(text or "") / max(1, chars)
    good = shares["mark"] <= R.MARK_LIMIT and all(shares[n] <= v for n, v in R.NGRAM_LIMITS.items()) and dup_chars / max(1, chars) <= R.LINE_CHAR_LIMIT and dup / max(1, len(lines)) <= R.LINE_LIMIT
    return (len(w), chars, symbols, dup, repeat, failed, good and not failed), shares


@pytest.mark.parametrize("which", ["rows", "data"])
def test_brute_force(spark, sf, which):
    docs = clashing(spark).select("doc_id", "text") if which == "rows" else spark.read.parquet(f"{sf}/documents.parquet")
    want = {r.doc_id: brute(r.text) for r in docs.collect()}
    got = R.quality_rules(docs).collect()
    assert len(got) == docs.count()
    for r in got:
        base, shares = want[r.doc_id]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.kept) == base
        assert all(abs(r["dup_mark_chars" if n == "mark" else f"dup_{n}gram_chars"] - v) < 1e-9 for n, v in shares.items())


def test_rows_do_not_meet_in_a_block(spark):
    text = "a b c d e f g h i j k l"
    got = R.quality_rules(table(spark, [(i, text, "en", "s") for i in range(5)])).collect()
    assert {r.n_repeat_words for r in got} == {0}


def test_clashes_and_empty(spark):
    docs = clashing(spark)
    out = R.quality_rules(docs, keep=docs.columns)
    assert "kept_in" in out.columns and out.count() == docs.count()
    assert R.quality_rules(table(spark, [])).count() == 0


def test_glued_marks(spark):
    rows = [(1, " ".join(f"w{i}***" for i in range(40)), "en", "s"), (2, " ".join(f"w{i}**" for i in range(40)), "en", "s"), (3, "****", "en", "s"), (4, "a*** b***\n" + "c " * 9, "en", "s")]
    got = {r.doc_id: (r.kept, round(r.dup_mark_chars, 3)) for r in R.quality_rules(table(spark, rows)).collect()}
    assert got[1] == (False, round(120 / (40 * 4 + 30 + 40), 3)) and got[2] == (True, 0.0) and got[3][1] == 1.0 and got[4][1] == round(6 / 17, 3)


def test_double_clashes(spark):
    docs = table(spark).selectExpr("doc_id", "text", "1 as kept", "2 as kept_in", "3 as kept_in_in")
    out = R.quality_rules(docs, keep=docs.columns)
    assert len(set(out.columns)) == len(out.columns) and {(r["kept_in_in_in"], r["kept_in"]) for r in out.collect()} == {(1, 2)}


def test_queries_see_texts(spark, sf):
    assert len(texts(spark, sf)) == R.quality_rules(spark.read.parquet(f"{sf}/documents.parquet")).count()
