import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from recollect.llm import packing as P
from recollect.llm.bytebpe import default_tokenizer, encoder
from tests.llm.helpers import ROWS, clashing, table


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(default_tokenizer())


def test_same_ids_as_tokenizers(spark, sf, library):
    texts = ["a <|endoftext|> b", "<|endoftext|>", "  <|endoftext|><|endoftext|>\n\n<|endoftext", "x  <|endoftext|>  y"] + [t or "" for _, t, *_ in ROWS] + [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    for t, got in zip(texts, encoder(default_tokenizer()).encode(texts), strict=True):
        assert np.frombuffer(got, "<u4").tolist() == library.encode(t, add_special_tokens=False).ids


@pytest.mark.parametrize("which", ["rows", "data"])
def test_every_id_once(spark, sf, library, which):
    docs = clashing(spark).filter("doc_id <> 9") if which == "rows" else spark.read.parquet(f"{sf}/documents.parquet")
    got = P.packed(docs, with_ids=True).collect()
    want = {r.doc_id: library.encode(r.text or "", add_special_tokens=False).ids + [1] for r in docs.collect()}
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in got:
        assert r.length == len(r.ids) // 4 <= 2048 and r.ids_crc32 == zlib.crc32(r.ids)
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append((r.offset, r.length))
    assert set(pieces) == set(want)
    for i, rows in pieces.items():
        rows.sort(key=lambda r: r.start)
        assert [x for r in rows for x in np.frombuffer(r.ids, "<u4").tolist()] == want[i] and {r.doc_tokens for r in rows} == {len(want[i])}
        assert [r.start for r in rows] == list(np.cumsum([0, *(r.length for r in rows)])[:-1])
    for s in sequences.values():
        s.sort()
        assert [o for o, _ in s] == list(np.cumsum([0, *(n for _, n in s)])[:-1]) and sum(n for _, n in s) <= 2048
    if which == "data":
        assert len(sequences) * 2048 < 1.05 * sum(r.length for r in got) + 8 * 2048


def test_added_tokens_have_their_own_id(spark):
    got = P.packed(table(spark, [(1, "a <|endoftext|> b", "en", "s")]), with_ids=True).collect()
    ids = np.frombuffer(got[0].ids, "<u4").tolist()
    assert (got[0].doc_tokens, ids[2], ids[-1]) == (5, 50256, 1)


def test_other_vocabularies_go_to_the_library(spark):
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    want = {i: t.encode(x or "", add_special_tokens=False).ids + [1] for i, x, *_ in ROWS if i not in (7, 8)}
    got = P.packed(table(spark).filter("doc_id not in (7, 8) or doc_id is null"), tokenizer=path, with_ids=True).collect()
    assert all(np.frombuffer(r.ids, "<u4").tolist() == want[r.doc_id] for r in got)


def brute(lengths, window):
    open_, where = [], []
    for n in lengths:
        fit = [k for k, c in enumerate(open_) if c >= n]
        k = min(fit, key=lambda k: open_[k], default=None)
        if k is None:
            open_.append(window)
            k = len(open_) - 1
        where.append(open_[k])
        open_[k] -= n
    return where, len(open_)


def test_best_fit_decreasing():
    rng = np.random.default_rng(3)
    for window, n in ((8, 300), (50, 300), (2048, 300), (2048, 4000), (7, 1)):
        lengths = np.sort(rng.integers(1, window + 1, n))[::-1]
        kinds, counts = np.unique(lengths, return_counts=True)
        slots, windows = P.best_fit_decreasing(dict(zip(kinds.tolist(), counts.tolist(), strict=True)), window)
        where, want = brute(lengths.tolist(), window)
        number = np.concatenate([np.arange(c) for c in counts[::-1]])
        at, offset = P.places(slots, lengths, number)
        assert windows == want and sorted(zip(lengths, window - offset, strict=True)) == sorted(zip(lengths, where, strict=True))
        for w in range(windows):  # gapless from 0
            mine = sorted(zip(offset[at == w].tolist(), lengths[at == w].tolist(), strict=True))
            assert [o for o, _ in mine] == np.cumsum([0, *(x for _, x in mine)])[:-1].tolist() and sum(x for _, x in mine) <= window


def test_large_counts_cost_no_more():
    slots, windows = P.best_fit_decreasing({n: 10**9 for n in range(1, 2048)}, 2048)
    assert len(slots) < 20_000 and windows * 2048 < 1.0001 * 10**9 * sum(range(1, 2048))


@pytest.mark.parametrize("parts", [1, 64])
def test_partitions_do_not_change_the_padding(spark, parts):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").repartition(parts)
    got = P.packed(docs).selectExpr("sum(length) as tokens", "count(distinct sequence_id) as n", "max(sequence_id) as last").first()
    assert got.tokens >= 0.99 * 2048 * got.n and got.last == got.n - 1


def test_repeated_rows_and_empty(spark):
    got = P.packed(table(spark)).filter("doc_id = 9").collect()
    assert len(got) == 2 and P.packed(table(spark, [])).count() == 0
