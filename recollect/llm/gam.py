"""Quality classifier: a generalised additive model with pairwise interactions.

Training is cyclic boosting: in every round each feature in turn gets a shallow tree (three
leaves over its bins) fitted to the current gradients, whose leaf values are added to that
feature's lookup table at a small step. Then the pairs of features that explain most of what is
left get tables over two coarse binnings, boosted the same way with four-leaf trees. A score is
the logistic of a sum of table entries, found for whole blocks by bin lookups.

Features are computed per block in numpy from the text alone; label, language, source and id are
never among them. The model is fitted on the driver from at most MAX_TRAIN labelled rows, the
only bounded sample here; scoring reads every text and shuffles nothing.

Defined results: null and empty texts have all-zero features and get that score; several labels
of an id are averaged (0.5 counts as 1), null labels are ignored; of several texts of an id the
one whose features come first in order is learnt from, whatever the layout of the table; without both classes in the
training rows every score is the training mean, or 0.5 without any.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recollect.llm.common import SMALL_BYTES, blocks, unclashed, utf8
from recollect.llm.repetition import covered_words
from recollect.llm.words import mixed, per_row, words_of

#: Labelled rows used for fitting, at most.
MAX_TRAIN = 20_000
HOLDOUT_FOLDS, THRESHOLD = 5, 0.3
#: Columns of the result; kept columns of these names get the suffix _in.
RESULT = ["score", "held_out", "predicted"]

#: Byte classes whose share of a text's bytes is a feature (fixed values).
CLASSES = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digit": b"0123456789", "symbol": b"#*$%&|<>", "mark": b"!?", "stop": b".,;:",
    "quote": b"'\"()[]{}", "other": b"@/\\^_`~+=-", "newline": b"\n", "high": bytes(range(192, 256)),
}
FEATURES = ["log_bytes", "log_words", "word_len", "word_len_sd", "distinct", "repeated", "line_words", "open_end", *CLASSES]


def _lut(members: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(members)] = True
    return out


_TABLES = {k: _lut(v) for k, v in CLASSES.items()}
_LETTER = _lut(bytes(range(48, 58)) + bytes(range(65, 91)) + bytes(range(97, 123)) + bytes(range(128, 256)))


def features(column: pa.Array) -> np.ndarray:
    """One row of FEATURES for each text."""
    data, offsets = utf8(column)
    w = words_of(data, offsets)
    n_bytes, n_words = np.diff(offsets), np.diff(w.first)
    words, some = np.maximum(n_words, 1), np.maximum(n_bytes, 1)
    mean = per_row(w.length, w.first) / words
    square = per_row(w.length.astype(np.int64) ** 2, w.first) / words
    key = w.hash ^ mixed(w.row.astype(np.uint64) + np.uint64(1))
    order = np.argsort(key)
    fresh = np.ones(len(order), bool)
    fresh[order[1:]] = key[order[1:]] != key[order[:-1]]
    repeated = per_row(covered_words(w, 5), w.first) / words
    shares = {k: per_row(t[data], offsets) for k, t in _TABLES.items()}
    ends = ~_LETTER[data[w.start + w.length - 1]]
    columns = [
        np.log1p(n_bytes), np.log1p(n_words), mean, np.sqrt(np.maximum(0, square - mean * mean)), per_row(fresh, w.first) / words, repeated,
        np.log1p(n_words / (shares["newline"] + 1)), per_row(ends, w.first) / words, *(v / some for v in shares.values()),
    ]
    return np.column_stack(columns).astype(np.float64)


@dataclass
class Model:
    """edges[f]: upper bin limits; tables[f]: value of each bin; the same for pairs, on coarse bins."""

    intercept: float
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    coarse: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int]] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.intercept)
        for f, (edges, table) in enumerate(zip(self.edges, self.tables, strict=True)):
            total += table[np.searchsorted(edges, x[:, f])]
        bins = {f: np.searchsorted(self.coarse[f], x[:, f]) for pair in self.pairs for f in pair}
        for (f, g), table in zip(self.pairs, self.pair_tables, strict=True):
            total += table[bins[f], bins[g]]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def _edges(x: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(x, np.arange(1, bins) / bins, method="lower"))


def _tree(g: np.ndarray, h: np.ndarray, leaves: int, ridge: float, least: float) -> np.ndarray:
    """Value of each bin under the best tree of so many leaves, grown a split at a time."""
    cuts = [0, len(g)]
    sums, weights = np.concatenate([[0], np.cumsum(g)]), np.concatenate([[0], np.cumsum(h)])
    gain = lambda a, b: (sums[b] - sums[a]) ** 2 / (weights[b] - weights[a] + ridge)
    for _ in range(leaves - 1):
        best = (1e-9, -1)
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            at = np.arange(a + 1, b)
            at = at[(weights[at] - weights[a] >= least) & (weights[b] - weights[at] >= least)]
            if len(at):
                gains = gain(a, at) + gain(at, b) - gain(a, b)
                k = int(np.argmax(gains))
                best = max(best, (float(gains[k]), int(at[k])))
        if best[1] < 0:
            break
        cuts = sorted([*cuts, best[1]])
    out = np.zeros(len(g))
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        out[a:b] = (sums[b] - sums[a]) / (weights[b] - weights[a] + ridge)
    return out


def _quadrants(g: np.ndarray, h: np.ndarray, ridge: float) -> tuple[float, np.ndarray]:
    """The best cut of a grid into four blocks: its gain, and the value of each cell."""
    G, H = (np.pad(a.cumsum(0).cumsum(1), ((1, 0), (1, 0))) for a in (g, h))
    blocks_of = lambda a: (a[1:-1, 1:-1], a[1:-1, -1:] - a[1:-1, 1:-1], a[-1:, 1:-1] - a[1:-1, 1:-1], a[-1, -1] - a[1:-1, -1:] - a[-1:, 1:-1] + a[1:-1, 1:-1])
    parts = list(zip(blocks_of(G), blocks_of(H), strict=True))
    gains = sum(a * a / (b + ridge) for a, b in parts)
    if not gains.size:
        return 0.0, np.zeros_like(g)
    i, j = np.unravel_index(int(np.argmax(gains)), gains.shape)
    out = np.zeros_like(g)
    for (a, b), rows, columns in zip(parts, (slice(0, i + 1), slice(0, i + 1), slice(i + 1, None), slice(i + 1, None)), (slice(0, j + 1), slice(j + 1, None)) * 2, strict=True):
        out[rows, columns] = a[i, j] / (b[i, j] + ridge)
    return float(gains[i, j]), out


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 150, pair_rounds: int = 60, n_pairs: int = 8, step: float = 0.1, bins: int = 48, coarse_bins: int = 10, leaves: int = 3, ridge: float = 2.0, least: float = 0.5) -> Model:
    """Fit the model to features x and labels y in {0, 1}."""
    mean = float(np.clip(y.mean(), 1e-6, 1 - 1e-6)) if len(y) else 0.5
    model = Model(float(np.log(mean / (1 - mean))))
    if not len(y) or y.min() == y.max():
        return model
    model.edges = [_edges(x[:, f], bins) for f in range(x.shape[1])]
    model.coarse = [_edges(x[:, f], coarse_bins) for f in range(x.shape[1])]
    binned = [np.searchsorted(e, x[:, f]) for f, e in enumerate(model.edges)]
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    total = np.full(len(y), model.intercept)
    for _ in range(rounds):
        for f, b in enumerate(binned):
            p = 1 / (1 + np.exp(-total))
            n = len(model.tables[f])
            add = step * _tree(np.bincount(b, y - p, n), np.bincount(b, p * (1 - p), n), leaves, ridge, least)
            model.tables[f] += add
            total += add[b]
    p = 1 / (1 + np.exp(-total))
    rough = [np.searchsorted(e, x[:, f]) for f, e in enumerate(model.coarse)]
    sizes = [len(e) + 1 for e in model.coarse]
    cell = lambda f, g: rough[f] * sizes[g] + rough[g]
    grid = lambda f, g, v: np.bincount(cell(f, g), v, sizes[f] * sizes[g]).reshape(sizes[f], sizes[g])
    ranked = sorted(((_quadrants(grid(f, g, y - p), grid(f, g, p * (1 - p)), ridge)[0], -f, -g) for f in range(len(sizes)) for g in range(f + 1, len(sizes))), reverse=True)
    model.pairs = [(-f, -g) for _, f, g in ranked[:n_pairs]]
    model.pair_tables = [np.zeros((sizes[f], sizes[g])) for f, g in model.pairs]
    cells = [cell(f, g) for f, g in model.pairs]
    for _ in range(pair_rounds):
        for k, (f, g) in enumerate(model.pairs):
            p = 1 / (1 + np.exp(-total))
            add = step * _quadrants(grid(f, g, y - p), grid(f, g, p * (1 - p)), ridge)[1]
            model.pair_tables[k] += add
            total += add.ravel()[cells[k]]
    return model


def held_out(ident: Column) -> Column:
    """Rows whose labels are never learnt from; a null id is not held out."""
    return F.coalesce(F.crc32(ident.cast("string").cast("binary")) % HOLDOUT_FOLDS == 0, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, ident: str = "doc_id", text: str = "text", label: str = "quality", most: int = MAX_TRAIN) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of at most `most` labelled ids, those first in a fixed random order."""
    known = labels.select(labels[ident].alias("k"), labels[label].alias("y")).filter(F.col("y").isNotNull() & F.col("k").isNotNull() & ~held_out(F.col("k")))
    known = known.groupBy("k").agg((F.avg("y") >= 0.5).cast("int").alias("y"))
    rank = F.xxhash64("k")
    n = known.count()
    if n > 2 * most:  # thin before sorting, with room to spare
        known = known.filter(F.pmod(rank, F.lit(1 << 20)) < int((1 << 20) * 1.5 * most / n))
    chosen = known.orderBy(rank, "k").limit(most)
    schema = "k " + docs.schema[ident].dataType.simpleString() + ", x array<double>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches, "t", SMALL_BYTES):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(list(features(b.column(1))), pa.list_(pa.float64()))], names=["k", "x"])

    texts = docs.select(docs[ident].alias("k"), docs[text].alias("t")).join(F.broadcast(chosen.select("k")), "k", "left_semi")  # at most `most` ids
    rows = texts.mapInArrow(run, schema).groupBy("k").agg(F.min("x").alias("x")).join(F.broadcast(chosen), "k").select("k", "y", "x").toPandas().sort_values("k")
    return np.array(rows["x"].tolist(), np.float64).reshape(-1, len(FEATURES)), rows["y"].to_numpy(np.float64)


def scored(docs: DataFrame, model: Model, ident: list[str], text: str = "text") -> DataFrame:
    """The columns `ident` and the score of each text."""
    columns = [docs[c].alias(f"k{i}") for i, c in enumerate(ident)]
    at = ident.index(text) if text in ident else len(ident)  # the text travels once
    source = docs.select(*columns, *([docs[text].alias(f"k{at}")] if at == len(ident) else []))
    schema = T.StructType([T.StructField(n, docs.schema[c].dataType) for n, c in zip(unclashed(ident, RESULT), ident, strict=True)] + [T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches, f"k{at}", SMALL_BYTES):
            yield pa.RecordBatch.from_arrays([*b.columns[: len(ident)], pa.array(model.score(features(b.column(at))))], names=schema.names)

    return source.mapInArrow(run, schema)


def quality_scores(docs: DataFrame, labels: DataFrame, ident: str = "doc_id", text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Fit on the labelled rows that are not held out, then score every document."""
    model = fit(*training_rows(docs, labels, ident, text))
    out = scored(docs, model, keep or [ident], text)
    return out.withColumns({"held_out": held_out(F.col(ident)), "predicted": (F.col("score") >= THRESHOLD).cast("int")})
