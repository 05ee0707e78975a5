import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from recollect.llm import substring as S
from recollect.llm.common import utf8
from recollect.llm.words import words_of
from tests.llm.helpers import clashing, table


def prose(seed, n):
    r = random.Random(seed)
    return " ".join("".join(r.choices("abcdefghijklmnop", k=r.randint(2, 9))) for _ in range(n))


def chunks(text):
    data, offsets = utf8(pa.array([text]))
    w = words_of(data, offsets)
    at = S.chunk_starts(data, offsets, w)
    ends = np.append(at, len(w.start))
    return [text.split()[a:z] for a, z in zip(ends[:-1], ends[1:], strict=True)]


def test_gear_is_the_rolling_recurrence():
    data = np.frombuffer(prose(1, 50).encode(), np.uint8)
    h, want = 0, []
    for i, b in enumerate(data):
        h = sum(int(S._GEAR[data[i - k]]) << k for k in range(min(16, i + 1))) & 0xFFFFFFFF
        want.append(h)
    assert S.gear(data).tolist() == want


def test_insertions_move_chunks_only():
    a, b = prose(1, 400), prose(2, 30)
    words = a.split()
    changed = " ".join([*words[:200], *b.split(), *words[200:]])
    old, new = ({tuple(c) for c in chunks(t)} for t in (a, changed))
    assert len(old & new) > 0.9 * len(old) and all(len(c) <= S.MAX_WORDS for c in new)


def test_shared_passages_go_and_the_rest_stays(spark):
    passage = prose(3, 60)
    rows = [(i, f"{prose(10 + i, 80)} {passage} {prose(50 + i, 80)}", "en", "s") for i in range(12)] + [(99, prose(99, 200), "en", "s")]
    got = {r.doc_id: r for r in S.without_repeats(table(spark, rows).repartition(3)).collect()}
    assert got[0].text == rows[0][1] and got[99].text == rows[-1][1] and not got[99].spans
    for i in range(1, 12):
        r = got[i]
        assert 30 <= r.removed_words <= 60 and len(r.spans) == 1 and r.spans[0].owner < i
        assert r.text.startswith(prose(10 + i, 80)) and r.text.endswith(prose(50 + i, 80))
        s = r.spans[0]
        assert rows[i][1].encode()[s.start : s.end].decode().strip() in passage


def plain_chunks(text):
    """Chunks by the rule, a word at a time: tuples of words."""
    raw, found = text.encode(), [(m.start(), m.end()) for m in re.finditer(rb"[^\x20\x09-\x0d]+", text.encode())]
    gear = lambda at: sum(int(S._GEAR[raw[at - k]]) << k for k in range(16)) & 0xFFFFFFFF if at >= 16 else None
    value = [gear(end - 1) for _, end in found]
    out, now = [], []
    for i, (a, z) in enumerate(found):
        now.append(raw[a:z])
        before, after = value[max(0, i - 2) : i], value[i + 1 : i + 3]
        if value[i] is not None and all(x is None or value[i] < x for x in before) and all(x is None or value[i] <= x for x in after):
            out.append(now)
            now = []
    return [tuple(c[k : k + 16]) for c in [*out, now] if c for k in range(0, len(c), 16)]


def plain_windows(own):
    """(number, from, to) of the fewest chunks from each chunk on, and up to each, that hold 25 words."""
    size = [len(c) for c in own]
    out = {}
    for i in range(len(own)):
        to = next((j for j in range(i + 1, len(own) + 1) if sum(size[i:j]) >= 25), None)
        if to is not None:
            out[i, to] = 2 * i
    for j in range(1, len(own) + 1):
        start = next((i for i in range(j - 1, -1, -1) if sum(size[i:j]) >= 25), None)
        if start is not None:
            out.setdefault((start, j), 2 * (j - 1) + 1)
    return [(n, i, j) for (i, j), n in out.items()]


def brute(rows):
    """id -> (words left, words removed, [earlier holders of each span's first windows])."""
    own = {i: plain_chunks(t or "") for i, t in rows}
    holders = {}
    for i, parts in own.items():
        for n, a, z in plain_windows(parts):
            holders.setdefault(tuple(parts[a:z]), []).append((i, n, a, z))
    hit = {i: [set() for _ in parts] for i, parts in own.items()}
    inside = {i: [False] * len(parts) for i, parts in own.items()}
    for found in holders.values():
        found.sort()
        for k, (i, _, a, z) in enumerate(found[1:], 1):
            inside[i][a:z] = [True] * (z - a)
            hit[i][a] |= {x[0] for x in found[:k]}
    out = {}
    for i, parts in own.items():
        edges = [k for k in range(len(parts)) if inside[i][k] and (k == 0 or not inside[i][k - 1])]
        out[i] = ([w for k, c in enumerate(parts) if not inside[i][k] for w in c], sum(len(c) for k, c in enumerate(parts) if inside[i][k]), [hit[i][k] for k in edges])
    return out


@pytest.mark.parametrize("parts", [1, 7])
def test_brute_force(spark, sf, monkeypatch, parts):
    monkeypatch.setattr(S, "SEND_ROWS", 1 << 20 if parts == 1 else 5000)
    docs = spark.read.parquet(f"{sf}/documents.parquet").repartition(parts)
    want = brute([(r.doc_id, r.text) for r in docs.collect()])
    got = S.without_repeats(docs).collect()
    assert len(got) == len(want)
    for r in got:
        words, removed, holders = want[r.doc_id]
        assert re.findall(rb"[^\x20\x09-\x0d]+", r.text.encode()) == words and (r.n_words, r.removed_words) == (len(words) + removed, removed)
        assert len(r.spans) == len(holders) and all(s.owner in h for s, h in zip(r.spans, holders, strict=True))
    assert sum(len(h) for *_, h in want.values()) > 10


@pytest.mark.parametrize("room", [64 << 20, 0])
def test_text_ids(spark, monkeypatch, room):
    monkeypatch.setattr(S, "FILTER_BYTES", room)  # with the filter, and where it would be too large
    passage = prose(3, 60)
    rows = [(f"doc {i}" if i else None, f"{prose(10 + i, 80)} {passage} {prose(50 + i, 80)}") for i in range(9)] + [("doc 50", prose(99, 200)), ("", None)]
    docs = spark.createDataFrame(rows, "doc_id string, text string")
    got = {r.doc_id: r for r in S.without_repeats(docs.repartition(3)).collect()}
    hashes = {r.h for r in docs.selectExpr("xxhash64(doc_id) h").collect()}
    assert len(got) == 11 and sum(r.removed_words == 0 for r in got.values()) == 3 and got[None].removed_words >= 30
    assert all(30 <= r.removed_words <= 60 and r.spans[0].owner in hashes for r in got.values() if r.removed_words)


def test_a_passage_of_all_texts_is_marked_in_all_but_one(spark):
    passage = prose(3, 60)
    rows = [(i, f"{prose(10 + i, 40)} {passage} {prose(900 + i, 40)}", "en", "s") for i in range(300)]
    docs = table(spark, rows).select(F.xxhash64("doc_id").alias("key"), F.col("doc_id").alias("ident"), "text").repartition(4)
    found = S.marks(docs, 16).collect()
    assert len({r.key for r in found}) == 299 and len(found) == len({(r.key, r.chunk) for r in found}) > 1500


def test_chunks_from_many_texts_are_no_passage(spark):
    source = [prose(200 + i, 80) for i in range(40)]
    inner = [chunks(t)[5:7] for t in source]  # two whole chunks of each, in a row nowhere
    mixed = " ".join(" ".join(w) for c in inner for w in c)
    passage = " ".join(source[3].split()[10:70])
    rows = [(i, t, "en", "s") for i, t in enumerate(source)] + [(90, mixed, "en", "s"), (91, f"{prose(300, 40)} {passage} {prose(301, 40)}", "en", "s")]
    known = {tuple(c) for t in source for c in chunks(t)}
    assert sum(len(c) for c in chunks(mixed) if tuple(c) in known) > 3 * S.MIN_WORDS
    got = {r.doc_id: r for r in S.without_repeats(table(spark, rows)).collect()}
    assert got[90].text == mixed and not got[90].spans
    assert got[91].removed_words >= 30 and [s.owner for s in got[91].spans] == [3]


def test_chunks_by_the_rule():
    for text in (prose(5, 300), "x " * 100, "one", "é " * 40 + prose(6, 20) + "\n\t" + "y" * 500):
        assert [tuple(x.encode() for x in c) for c in chunks(text)] == plain_chunks(text)


def test_windows_cover_runs():
    r = random.Random(3)
    sizes = np.array([r.randint(1, 16) for _ in range(300)])
    row = np.sort(np.array([r.randint(0, 20) for _ in range(300)]))
    begin, end, number = S.windows(row, sizes, 25)
    total = np.concatenate([[0], np.cumsum(sizes)])
    want = set()
    for i in range(300):
        want |= {(i, j) for j in range(i + 1, 301) if row[i] == row[j - 1] and total[j] - total[i] >= 25 and (total[j - 1] - total[i] < 25 or total[j] - total[i + 1] < 25)}
    assert set(zip(begin.tolist(), end.tolist(), strict=True)) == want and len(begin) == len(want)
    assert len(set(zip(row[begin].tolist(), number.tolist(), strict=True))) == len(want)
    digest = np.arange(300, dtype=np.uint64) % 7
    got = S.window_digests(digest, sizes, begin, end)
    seen = {}
    for h, i, j in zip(got.tolist(), begin.tolist(), end.tolist(), strict=True):
        assert seen.setdefault(h, tuple(digest[i:j])) == tuple(digest[i:j])
    assert len(seen) == len({tuple(digest[i:j]) for i, j in zip(begin.tolist(), end.tolist(), strict=True)})


def test_edges(spark):
    docs = clashing(spark)
    got = S.without_repeats(docs).collect()
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    assert len(got) == 13 and by[2][0].text is None and by[3][0].text == "" and [r.text for r in by[9]] == ["repeated row"] * 2
    assert by[8][0].removed_words_dedup if "removed_words_dedup" in docs.columns else by[8][0].removed_words > 1000
    assert "n_words_dedup" in got[0].__fields__ and "spans_dedup" in got[0].__fields__
    assert S.without_repeats(table(spark, [])).count() == 0
