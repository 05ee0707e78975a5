import zlib

import corpus_pipeline as C
import numpy as np
from tests.llm.helpers import clashing, table
from tests.llm.test_op2_gam import by_hand
from tests.llm.test_op3_repetition import brute as rules
from tests.llm.test_op5_jaccard import brute as links
from tests.llm.test_op6_substring import brute as passages
from tokenizers import Tokenizer

from recollect.llm import gam
from recollect.llm.bytebpe import default_tokenizer
from recollect.llm.common import stored


def test_stages_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    one = stored(C.quality_rules(spark, docs, sf), "one")
    assert {r.doc_id for r in one.collect()} == {r.doc_id for r in docs.collect() if rules(r.text)[0][-1]} and one.columns == docs.columns
    two = stored(C.quality_classifier(spark, one, sf), "two")
    text = {r.doc_id: r.text for r in one.collect()}
    x = {i: by_hand(t) for i, t in text.items()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    learnt = sorted(i for i in text if labels.get(i) is not None and zlib.crc32(str(i).encode()) % 5)
    model = gam.fit(np.array([x[i] for i in learnt]).round(9), np.array([labels[i] for i in learnt], float))
    score = dict(zip(text, model.score(np.array([x[i] for i in text]).round(9)), strict=True))
    kept = {r.doc_id for r in two.collect()}
    differ = {i for i in text if (i in kept) != (score[i] >= 0.3)}
    assert len(differ) <= 0.01 * len(text) and two.columns == docs.columns  # features a rounding apart may cross a bin's edge
    three = stored(C.near_duplicates(spark, two, sf), "three")
    assert {r.doc_id for r in three.collect()} == {i for i, (_, c) in links([(r.doc_id, r.text) for r in two.collect()]).items() if i == c}
    four = stored(C.substring_dedup(spark, three, sf), "four")
    want = {i: w for i, (w, *_) in passages([(r.doc_id, r.text) for r in three.collect()]).items()}
    assert {r.doc_id: [w.encode() for w in r.text.split()] for r in four.collect()} == want
    assert all(r.n_chars == len(r.text) for r in four.collect()) and four.columns == docs.columns
    library, ids = Tokenizer.from_file(default_tokenizer()), {}
    five = C.pack(spark, four, sf).collect()
    for r in sorted(five, key=lambda r: r.start):
        ids.setdefault(r.doc_id, []).extend(np.frombuffer(r.ids, "<u4").tolist())
    assert ids == {r.doc_id: library.encode(r.text, add_special_tokens=False).ids + [1] for r in four.collect()}
    key = lambda rows: sorted((r.doc_id, r.start, r.length, r.ids_crc32) for r in rows)
    assert key(C.run(spark, sf).collect()) == key(five)


def test_rows_of_one_id_are_told_apart(spark):
    text, other = (" ".join(f"{k}{i}" for i in range(40)) for k in ("word", "term"))
    rows = [(1, text, "en", "s", 1), (1, text, "en", "s", 1), (2, text, "en", "s", 1), (2, other, "en", "s", 1), (3, None, None, None, None), (None, other + " more", "en", "s", 1), (7, "alone", "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted((r.doc_id or 0, r.text) for r in C.near_duplicates(spark, docs, "").select("doc_id", "text").collect() if r.text)
    assert got == [(0, other + " more"), (1, text), (7, "alone")]


def test_empty_tables_and_clashing_names(spark, sf):
    for docs in (table(spark, []), clashing(spark)):
        for k, (_, stage) in enumerate(C.STAGES):
            after = stored(stage(spark, docs, sf), f"stage{k}")
            assert k == 4 or after.columns == docs.columns
            docs = after
        assert docs.count() == 0 or "sequence_id" in docs.columns
