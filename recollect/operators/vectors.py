"""An index of vectors: an inverted file over k-means cells, with exact scores within the cells looked into.

Cells are fitted on a sample of at most SAMPLE vectors, chosen by hash; every vector is filed in its nearest
cell, in a table whose files know their cells. A query looks into its nearest cells; how many is
measured when the index is made: the fewest at which queries of the sample find `recall` of their true
neighbours. A filter on rows (of a text search, say) goes below the scan. search.nearest_each is the exact way.

Distances are Euclidean; for cosines file unit vectors. Vectors that are null, empty, of another length
than most of the sample or hold an entry that is null or not finite are not filed (see search.usable).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recollect.operators.search import top_per, usable
from recollect.sources.tables import Tables

#: Vectors of the sample, cells at most, rounds of k-means, queries by which probes are chosen; rows of a cell that one group scans (about).
SAMPLE, CELLS, ROUNDS, ASKED, PART = 1 << 16, 1 << 10, 12, 256, 1 << 14
FILED = "cell long, id long, v array<double>"


def _near(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances less |x|^2, which don't change the order of centres."""
    return (centres * centres).sum(axis=1) - 2 * x @ centres.T


def cells_of(x: np.ndarray, n: int, rounds: int = ROUNDS) -> np.ndarray:
    """n centres of x by k-means; begun from rows spread over x, empty cells stay where they are."""
    centres = x[np.random.default_rng(7).permutation(len(x))[:n]].copy()
    for _ in range(rounds):
        own = np.concatenate([_near(x[k : k + 8192], centres).argmin(axis=1) for k in range(0, len(x), 8192)])
        count = np.bincount(own, minlength=len(centres))
        order = np.argsort(own, kind="stable")
        full = np.flatnonzero(count)
        centres[full] = np.add.reduceat(x[order], (np.cumsum(count) - count)[full]) / count[full][:, None]
    return centres


def probes_for(x: np.ndarray, centres: np.ndarray, recall: float, k: int = 10) -> int:
    """Cells that queries from x have to look into, on average to find that share of their k nearest."""
    asked = np.linspace(0, len(x) - 1, min(ASKED, len(x))).astype(int)
    own = np.concatenate([_near(x[a : a + 8192], centres).argmin(axis=1) for a in range(0, len(x), 8192)])
    need = []
    for q in asked:
        true = np.argsort(((x - x[q]) ** 2).sum(axis=1), kind="stable")[:k]
        rank = np.empty(len(centres), np.int64)
        rank[np.argsort(_near(x[q : q + 1], centres)[0], kind="stable")] = np.arange(len(centres))
        need.append(rank[own[true]])
    reach = np.sort(np.concatenate(need))
    return int(reach[min(len(reach) - 1, int(np.ceil(recall * len(reach))))]) + 1


class VectorIndex:
    def __init__(self, spark: SparkSession, base: str):
        self.spark = spark
        self.tables = Tables(spark, base, {"vectors": FILED, "centres": "cell long, centre array<double>, probes long"}, {"vectors": "cell"})
        self.tables.set_up()

    def make(self, vectors: DataFrame, recall: float = 0.95, cells: int | None = None) -> None:
        """Fit cells on a sample of vectors (id, v) and file all of them; a new index takes the place of an old one."""
        good = usable(vectors.select(F.col("id").cast("long").alias("id"), F.col("v").cast("array<double>").alias("v")))
        n = good.count()
        some = good if n <= SAMPLE else good.filter(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < int((1 << 20) * SAMPLE / n))
        rows = some.select("v").toArrow().column("v").combine_chunks()
        lengths = pc.list_value_length(rows).to_numpy(zero_copy_only=False)
        sizes, counts = np.unique(lengths, return_counts=True)
        t = self.tables.begin()
        if not len(sizes):
            t.replace("vectors", self.spark.createDataFrame([], FILED))
            t.replace("centres", self.spark.createDataFrame([], self.tables.schemas["centres"]))
            t.commit()
            return
        width = int(sizes[counts.argmax()])
        x = pc.list_flatten(rows.filter(pa.array(lengths == width))).to_numpy().reshape(-1, width)
        centres = cells_of(x, cells or max(1, min(CELLS, int(np.sqrt(n)))))
        probes = probes_for(x, centres, recall)
        t.replace("centres", self.spark.createDataFrame([(k, c.tolist(), probes) for k, c in enumerate(centres)], self.tables.schemas["centres"]))
        filed = self._filed(good.filter(F.size("v") == width), centres)
        t.replace("vectors", filed.repartitionByRange(max(1, -(-n // (4 * PART))), "cell").sortWithinPartitions("cell", "id"))
        t.commit()

    def add(self, vectors: DataFrame) -> None:
        """File more vectors in the cells there are."""
        centres, _ = self._centres()
        if centres is None:
            self.make(vectors)
            return
        good = usable(vectors.select(F.col("id").cast("long").alias("id"), F.col("v").cast("array<double>").alias("v"))).filter(F.size("v") == centres.shape[1])
        self.tables.append("vectors", self._filed(good, centres))
        self.tables.tidy("vectors")

    def _centres(self) -> tuple[np.ndarray | None, int]:
        rows = self.tables.read("centres").orderBy("cell").collect()  # CELLS at most
        return (np.array([r.centre for r in rows]), rows[0].probes) if rows else (None, 0)

    def _filed(self, good: DataFrame, centres: np.ndarray) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    x = pc.list_flatten(b.column(1)).to_numpy().reshape(b.num_rows, -1)
                    own = np.concatenate([_near(x[k : k + 4096], centres).argmin(axis=1) for k in range(0, len(x), 4096)])
                    yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int64)), *b.columns], names=["cell", "id", "v"])

        return good.mapInArrow(run, FILED)

    def search(self, queries: DataFrame, k: int = 10, probes: int | None = None, among: DataFrame | None = None) -> DataFrame:
        """(query_id, id, score, rank): the k nearest that each of queries (id, v) finds in its nearest cells; `among` (id): only these rows.

        Cells of many rows are dealt out in parts; each part gives k rows a query.
        """
        centres, own = self._centres()
        empty = self.spark.createDataFrame([], "query_id long, id long, score double, rank int")
        if centres is None:
            return empty
        probes = min(len(centres), probes or own)

        def looking(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    x = pc.list_flatten(b.column(1)).to_numpy().reshape(b.num_rows, -1)
                    cells = np.argsort(_near(x, centres), axis=1, kind="stable")[:, :probes].astype(np.int64)
                    again = b.take(pa.array(np.repeat(np.arange(b.num_rows), probes)))
                    yield pa.RecordBatch.from_arrays([pa.array(cells.ravel()), *again.columns], names=["cell", "id", "v"])

        asked = usable(queries.select(F.col("id").cast("long").alias("id"), F.col("v").cast("array<double>").alias("v"))).filter(F.size("v") == centres.shape[1]).mapInArrow(looking, FILED)
        rows = self.tables.read("vectors")
        if among is not None:
            rows = rows.join(among.select("id").distinct(), "id", "left_semi")
        parts = rows.groupBy("cell").agg(F.ceil(F.count("*") / PART).cast("int").alias("parts"))
        left = rows.join(parts, "cell").select(F.col("cell").alias("cell"), F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("part"), F.col("id").alias("id"), F.col("v").alias("v"))
        right = asked.join(parts, "cell").select(F.col("cell").alias("cell"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("id").alias("id"), F.col("v").alias("v"))

        def scan(one: pa.Table, two: pa.Table) -> pa.Table:
            out = []
            if one.num_rows and two.num_rows:
                ids, names = (t.column("id").combine_chunks().to_numpy() for t in (one, two))
                v, q = (pc.list_flatten(t.column("v")).to_numpy().reshape(t.num_rows, -1) for t in (one, two))
                for i in range(len(q)):
                    score = np.sqrt(((v - q[i]) ** 2).sum(axis=1))
                    best = np.lexsort((ids, score))[:k]
                    out.append((np.full(len(best), names[i]), ids[best], score[best]))
            a, b, c = (np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
            return pa.table({"query_id": a, "id": b, "score": c})

        found = left.groupBy("cell", "part").cogroup(right.groupBy("cell", "part")).applyInArrow(scan, "query_id long, id long, score double")
        return top_per(found, "query_id", k, F.asc("score"), F.asc("id"))
