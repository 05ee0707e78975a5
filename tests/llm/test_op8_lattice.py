import math
import zlib
from collections import Counter

import numpy as np
import pytest

from recollect.llm import lattice as L
from tests.llm.helpers import clashing, table, words


def brute(rows):
    tokens = [(i, [*words(t, True), None]) for i, t in rows]
    train = Counter(w for i, ws in tokens if i is None or zlib.crc32(str(i).encode()) % 7 != 2 for w in ws)
    n, v = sum(train.values()), len(train)
    return [(i, len(ws), sum(train[w] > 0 for w in ws), n, sum(math.log10((train[w] + 1) / (n + v + 1)) for w in ws)) for i, ws in tokens]


@pytest.mark.parametrize("which", ["rows", "data"])
def test_base(spark, sf, which):
    docs = clashing(spark) if which == "rows" else spark.read.parquet(f"{sf}/documents.parquet")
    got = L.likelihoods(docs).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    want = sorted(brute([(r.doc_id, r.text) for r in docs.collect()]), key=key)
    assert len(got) == len(want)
    for r, (i, n, known, total, base) in zip(sorted(got, key=lambda r: key((r.doc_id, r.n_tokens))), want, strict=True):
        assert (r.doc_id, r.n_tokens, r.n_known, r.train_tokens) == (i, n, known, total) and abs(r.base_score - base) < 1e-6 * max(1, abs(base))
        assert r.held_out == (i is not None and zlib.crc32(str(i).encode()) % 7 == 2) and r.score < 0 and r.vocabulary_score < 0 and r.mixed_score < 0


def test_forward_sums_over_all_segmentations():
    v = L.vocabulary(L.default_vocabulary())
    rng = np.random.default_rng(0)
    weights = rng.random(v.size) / v.size
    logs = np.log(weights)
    known = {}
    for text in (" the", " things", " zq", " éa"):
        raw = text.encode()

        def total(at, raw=raw, known=known):
            if at == len(raw):
                return 1.0
            out = 0.0
            for end in range(at + 1, len(raw) + 1):
                found = [p for i, j, _, p in v.edges(np.frombuffer(raw[at:end], np.uint8)[None, :]) if (i, j) == (0, end - at)]
                if found:
                    out += weights[found[0][0]] * total(end)
            return out

        got = L.forward(v, np.frombuffer(raw, np.uint8)[None, :], logs)[-1][0]
        assert abs(got - math.log(total(0))) < 1e-9


class Enumerated:
    """The model by listing every segmentation of every word, from the vocabulary file on."""

    def __init__(self):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=L.default_vocabulary())
        ordinary = [i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) or sp.is_byte(i))]
        order = sorted(ordinary, key=lambda i: (-sp.get_score(i), i))
        self.pieces = {sp.id_to_piece(i).replace("▁", " ").encode(): k for k, i in enumerate(order)}
        for i in range(sp.get_piece_size()):
            if sp.is_byte(i):
                self.pieces.setdefault(bytes([int(sp.id_to_piece(i)[3:5], 16)]), len(self.pieces))
        first = {p: 1 / (k + 10) for p, k in self.pieces.items()}
        first[None] = sum(first.values()) / 1000
        whole = sum(first.values())
        self.first = {p: w / whole for p, w in first.items()}

    def ways(self, raw):
        """All lists of pieces that make up these bytes."""
        if not raw:
            return [[]]
        return [[raw[:k], *rest] for k in range(1, len(raw) + 1) if raw[:k] in self.pieces for rest in self.ways(raw[k:])]

    def probability(self, word, weight):
        return weight[None] if word is None else sum(math.prod(weight[p] for p in way) for way in self.ways(f" {word}".encode()))

    def adapted(self, train, weight):
        total = {p: L.PRIOR * w for p, w in self.first.items()}
        for word, n in train.items():
            if word is None:
                total[None] += n
                continue
            whole = self.probability(word, weight)
            for way in self.ways(f" {word}".encode()):
                for p in way:
                    total[p] += n * math.prod(weight[q] for q in way) / whole
        size = sum(total.values())
        return {p: n / size for p, n in total.items()}


@pytest.mark.parametrize("rounds", [0, 1, 2])
def test_scores_by_listing_all_segmentations(spark, rounds):
    rows = [(1, "The things of the sea"), (2, "the thing é 字"), (3, "Thing sea sea"), (4, None), (9, "a zq the"), (14, "the new"), (21, "things, the")]
    m = Enumerated()
    tokens = {i: [*words(t, True), None] for i, t in rows}
    train = Counter(w for i, ws in tokens.items() if zlib.crc32(str(i).encode()) % 7 != 2 for w in ws)
    weight = m.first
    for _ in range(rounds):
        weight = m.adapted(train, weight)
    n, kinds = sum(train.values()), len(train)
    for r in L.likelihoods(spark.createDataFrame(rows, "doc_id long, text string"), rounds=rounds).collect():
        ws = tokens[r.doc_id]
        assert abs(r.score - sum(math.log10(m.probability(w, weight)) for w in ws)) < 1e-9
        assert abs(r.vocabulary_score - sum(math.log10(m.probability(w, m.first)) for w in ws)) < 1e-9
        assert abs(r.mixed_score - sum(math.log10((train[w] + kinds * m.probability(w, weight)) / (n + kinds)) for w in ws)) < 1e-9


def test_words_that_share_a_hash_stay_apart():
    raw = np.frombuffer(b"the thethy the thy", np.uint8)
    start, length = np.array([0, 4, 7, 11, 15]), np.array([3, 3, 3, 3, 3])
    spot, local = L.distinct(raw, start, length, np.zeros(5, np.uint64))
    assert [raw[a : a + 3].tobytes() for a in start[spot[local]]] == [b"the", b"the", b"thy", b"the", b"thy"] and len(spot) == 2


def test_scores_that_are_logarithms_are_taken_as_they_are():
    p = np.array([0.5, 0.25, 0.25])
    assert np.allclose(L.weights(np.log(p)), p) and np.allclose(L.weights(-np.arange(3.0) * 5), [1 / 10, 1 / 11, 1 / 12])


def test_clashing_names(spark):
    docs = table(spark).selectExpr("doc_id", "text", "1 as score", "'x' as id", "2 as train", "3 as block")
    got = L.likelihoods(docs)
    assert len(set(got.columns)) == len(got.columns) and got.count() == 13


def test_expected_counts_cover_every_byte():
    v = L.vocabulary(L.default_vocabulary())
    logs = np.log(np.maximum(v.first, 1e-300))
    word = np.frombuffer(b" things thing".replace(b" thing", b" thing")[:7], np.uint8)[None, :]
    n = L.expected(v, word, np.array([3.0]), logs)
    size = {}
    for i, j, _, p in v.edges(word):
        size[int(p[0])] = j - i
    assert abs(sum(n[p] * k for p, k in size.items()) - 3 * word.shape[1]) < 1e-9


def test_training_helps_and_equal_texts_score_alike(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    held = lambda rounds: sum(r.score for r in L.likelihoods(docs, rounds=rounds).collect() if r.held_out)
    assert held(2) > held(0)
    by = {}
    text = {r.doc_id: r.text for r in docs.collect()}
    for r in L.likelihoods(docs).collect():
        by.setdefault(text[r.doc_id], set()).add(round(r.score, 6))
    assert all(len(s) == 1 for s in by.values())


def test_empty(spark):
    assert L.likelihoods(table(spark, [])).count() == 0
    only = L.likelihoods(table(spark, [(1, None, None, None)])).first()
    assert only.n_tokens == 1
