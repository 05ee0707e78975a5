import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from recollect.llm import divergence as D
from recollect.llm.queries import QUERIES, SQL
from tests.llm.helpers import ROWS, clashing, table
from tests.llm.oracle import rows_of_frame, rows_of_sql

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def brute(rows, least):
    """The contract in plain Python, integers of any size."""
    count, within, langs = defaultdict(Counter), defaultdict(lambda: defaultdict(set)), defaultdict(set)
    for i, (_, text, lang, source) in enumerate(rows):
        lang, source = lang or "", source or ""
        langs[lang].add(source)
        for t in TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            count[lang, source][t] += 1
            within[lang][t].add(i)
    out = []
    for lang, sources in langs.items():
        kept = [t for t, d in within[lang].items() if len(d) >= least]

        def share(c, kept=kept):
            n = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 5) // (n + 5 * len(kept)) for t in kept}

        p = {s: share(count[lang, s]) for s in sources}
        q = share(sum((count[lang, s] for s in sources), Counter()))
        for s in sources:
            pairs = [(o, sum(abs(p[s][t] - p[o][t]) for t in kept)) for o in sources if o != s]
            terms = [(t, p[s][t] - q[t]) for t in kept if count[lang, s][t] and p[s][t] > q[t]]
            for part, found in (("pair", pairs), ("term", terms)):
                found = sorted(found, key=lambda x: (-x[1], x[0].encode()))
                out += [(item, lang, part, k + 1, s, v) for k, (item, v) in enumerate(found) if part == "pair" or k < 50]
    return sorted(out, key=repr)


def test_equals_sql(spark, sf):
    assert rows_of_frame(QUERIES["op12_source_divergence"](spark, sf)) == rows_of_sql(SQL["op12_source_divergence"], sf)


@pytest.mark.parametrize("least,slices", [(1, 1 << 13), (1, 4), (3, 16)])
def test_brute_force(spark, least, slices, monkeypatch):
    rng = random.Random(least)
    words = ["Alpha", "beta", "GAMMA", "é", "ß字", "x9y", "It's", "foo_bar", "ÀB", "\x00nul", "zz"]
    rows = [(i, " ".join(rng.choices(words, range(1, 12), k=rng.randrange(12))), rng.choice(["en", "de", None, "x"]), rng.choice(["a", "b", None, "ü"])) for i in range(120)]
    rows += ROWS + [(900, "einmal", "solo", "only"), (901, "123 ...", "blank", "a"), (902, None, "blank", "b")]
    monkeypatch.setattr(D, "SLICE", slices)
    assert rows_of_frame(D.audit(table(spark, rows), least)) == brute(rows, least)


def test_more_than_fifty_terms_in_slices(spark, monkeypatch):
    words = [a + b for a in "abcdefghij" for b in "klmnopqrst"]
    rows = [(i, " ".join(words[: 60 + i]) if i % 2 else "other words", "en", f"s{i % 2}") for i in range(40)]
    monkeypatch.setattr(D, "SLICE", 7)
    assert rows_of_frame(D.audit(table(spark, rows), 1)) == brute(rows, 1)


def test_collisions_are_split():
    text = b"one two three two one four"
    data, offsets = np.frombuffer(text, np.uint8), np.array([0, len(text)])
    start, end, _ = D.boundaries(data, offsets)
    term, head = D.grouped_slices(data, start, end, digest=lambda w: len(w) % 2)
    assert [text[start[head[t]] : end[head[t]]] for t in term] == text.split()


def test_rows_do_not_meet():
    data, offsets = np.frombuffer(b"abcdef", np.uint8), np.array([0, 3, 3, 6])
    start, end, row = D.boundaries(data, offsets)
    assert (start.tolist(), end.tolist(), row.tolist()) == ([0, 3], [3, 6], [0, 2])


def test_large_counts_do_not_overflow():
    count, total = np.array([10**13, 7]), np.array([3 * 10**13, 3 * 10**13])
    assert D.shares(count, total, 10**6).tolist() == [1 + 10**9 * (int(c) + 5) // (int(n) + 5 * 10**6) for c, n in zip(count, total, strict=True)]


def test_empty_and_clashing(spark):
    assert D.audit(table(spark, [])).count() == 0
    assert rows_of_frame(D.audit(clashing(spark).selectExpr("*", "1 as term", "2 as slice", "3 as rank", "4 as item"), 1)) == brute(ROWS, 1)
