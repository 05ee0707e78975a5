import random

import numpy as np
import pytest
import sentencepiece

from recollect.llm import pieces as P
from tests.llm.helpers import ROWS, clashing, table, texts


@pytest.fixture(scope="module")
def codec():
    return P.codec(P.default_model())


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=P.default_model())


def ids(raw):
    return np.frombuffer(raw, "<i4").tolist()


def test_same_as_library(spark, sf, codec, library):
    for t in [t for _, t, *_ in ROWS if t] + list(texts(spark, sf).values()):
        assert ids(codec.encode(t)) == library.encode(t)
        assert codec.decode(codec.encode(t)) == library.decode(library.encode(t)) == t.replace("▁", " ")


def test_fuzz(codec, library):
    r = random.Random(4)
    for _ in range(800):
        t = "".join(r.choices([" ", "  ", "\n", "a", "aa", "é", "1", ".", "th", "ing", " the", "字", "😀", "ll", "▁", "\x00"], k=r.randint(0, 60)))
        assert ids(codec.encode(t)) == library.encode(t), t


def test_stream_equals_whole_and_keeps_a_window(codec, library):
    t = "qwertyuiopasdfghjklzxcvbnm" * 400
    assert ids(codec.encode(t)) == library.encode(t)
    most = 0
    path = type(codec)._path

    def watched(self, text, last, begin, end):
        nonlocal most
        most = max(most, end - begin)
        return path(self, text, last, begin, end)

    type(codec)._path = watched
    try:
        codec.words.clear(), codec.parts.clear()
        list(codec.stream(t))
    finally:
        type(codec)._path = path
    assert most < 3 * P.STRIDE


def test_frames(spark):
    docs = clashing(spark)
    got = P.decoded(P.encoded(docs)).collect()
    assert len(got) == docs.count() and all((r.ids is None) == (r.text is None) for r in got)
    assert all(r.decoded == (r.text and r.text.replace("▁", " ")) for r in got)
    assert all(r.round_trip for r in P.round_trips(docs).collect()) and P.round_trips(table(spark, [])).count() == 0
