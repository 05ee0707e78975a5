import random

import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from recollect.llm import tokentree as K
from recollect.llm.bytebpe import default_tokenizer
from recollect.llm.queries import QUERIES
from tests.llm.helpers import clashing, table, texts

PARTS = [" ", "  ", "\n", "a", "b", "é", "1", ".", "\t", "'", "ll", "'ll", " the", "字", "   ", "s", "12", "!!", "\n\n", "<|endoftext|>", "<|endof", "text|>", "<", "|>"]


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(default_tokenizer())
    return lambda x: len(t.encode(x, add_special_tokens=False).ids)


def test_fuzz(library):
    c, r = K.counter(default_tokenizer()), random.Random(3)
    for _ in range(1500):
        x = "".join(r.choices(PARTS, k=r.choice([0, 1, 5, 40, 300])))
        tree = K.TokenTree(x, c)
        for _ in range(r.randint(1, 4)):
            a = r.randint(0, len(x) + 2)
            b, new = a + r.choice([0, 0, 1, 3, 20, 100, 700]), "".join(r.choices(PARTS, k=r.choice([0, 1, 2, 10, 200])))
            tree.edit(a, b, new)
            a = min(a, len(x))
            x = x[:a] + new + x[min(max(b, a), len(x)) :]
            if r.random() < 0.5:  # kept and loaded again
                assert tree.text() == x
                tree = K.TokenTree(x, c, tree.packed())
            assert [p for k in range(len(tree.leaf)) for p in tree.pieces(k)[0]] == c.split(x) and tree.total == library(x)
            assert all(len(tree.pieces(k)[0]) <= 2 * K.LEAF for k in range(len(tree.leaf))) and tree.chars[1] == len(x)
            assert len(tree.leaf) == 1 or all(tree.pieces(k)[0] for k in range(len(tree.leaf)))


def test_only_touched_regions_are_encoded(library):
    c = K.counter(default_tokenizer())
    data = K.TokenTree("some words of a long text " * 10_000, c).packed()
    c.known.clear()
    tree = K.TokenTree("some words of a long text " * 10_000, c, data)
    tree.edit(100_000, 100_005, "new")
    assert tree.encoded < 300 and tree.total == library(tree.text())
    assert sum(sizes is None for _, sizes, _ in tree.leaf) <= 3 and len(c.known) < 20  # nothing else was looked at
    leaves = len(tree.leaf)
    for k in range(2000):
        tree.edit(60_000 + 3 * k, 60_000 + 3 * k, f" {k % 10}x")
    assert len(tree.leaf) > leaves and tree.encoded < 200_000 and tree.total == library(tree.text())
    tree.edit(10, 200_000, "")
    assert len(tree.leaf) < leaves and tree.total == library(tree.text())


def test_long_pieces_are_kept():
    x = "a" * 70_000 + " " + "é" * 300
    c = K.counter(default_tokenizer())
    tree = K.TokenTree(x, c)
    assert K.TokenTree(x, c, tree.packed()).total == tree.total == K.TokenTree(x, c, K.TokenTree(x, c, tree.packed()).packed()).total


def test_trees_are_edited_again_and_again(spark, library):
    docs = clashing(spark).filter("doc_id <> 9")
    edit = lambda n: F.array(F.struct(F.lit(n).alias("start"), F.lit(n + 2).cast("long").alias("end"), F.lit(" <|endoftext|> x").alias("replacement")))
    trees, want = K.token_trees(docs), {r.doc_id: r.text or "" for r in docs.collect()}
    for n in (3, 0, 40):
        trees = K.edited(trees.withColumn("edits", edit(n)))
        want = {i: t[: min(n, len(t))] + " <|endoftext|> x" + t[n + 2 :] for i, t in want.items()}
    assert {r.doc_id: (r.text, r.n_tokens) for r in trees.collect()} == {i: (t, library(t)) for i, t in want.items()}


def test_query_against_recounting(spark, sf, library):
    old = texts(spark, sf)
    for r in QUERIES["op7_edit_aware_counts"](spark, sf).collect():
        t = old[r.doc_id]
        n = len(t)
        assert r.n_tokens == library(t)
        for a, b, new in ((n // 3, n // 3, " revised"), (n // 2, n // 2 + 10, ""), (n - 5, n, "the end.")):
            a = min(max(a, 0), len(t))
            t = t[:a] + new + t[min(max(b, a), len(t)) :]
        assert (r.n_tokens_after, r.n_chars_after) == (library(t), len(t))


def test_frames(spark):
    edits = spark.createDataFrame([(1, 2, 0, 3, "A"), (1, 1, 4, 9, None), (7, 1, None, 5, "x"), (3, 1, 0, 0, "new"), (50, 1, 0, 1, "y")], "doc_id long, seq int, start long, end long, replacement string")
    got = K.edited_counts(K.with_edits(clashing(spark), edits), with_text=True).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == 13 and by[3].text_after == "new" and by[2].n_tokens == 0 and by[1].text_after.startswith("A  brown fox")
    assert by[7].n_tokens == by[7].n_tokens_after and K.edited_counts(K.with_edits(table(spark, []), edits)).count() == 0
