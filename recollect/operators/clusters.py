"""Greedy clusters by word sets, over all tasks.

The sequential pass in order of id (a memory joins the first earlier seed that is like it, or becomes one) only
depends on which sets are alike. Sets that may be are found by parity sketches: bit b of a sketch says whether an odd number of the
set's word hashes fall on b, so two sketches differ in no more bits than the sets differ in words, and sets that
are alike by more than a threshold are never missed. Sketches meet by group and class of size, in blocks, and what
leaves a block is a tree of links, never all pairs. Only sets of one component of these links can be alike: their words are
read again and the pass runs over each component in a task.

A component of more than LOCAL memories goes by rounds over the whole table, with the same result: a memory without an
earlier one like it that is still open must be a seed; a memory that is like an earlier seed is none. Each round settles
all of both kinds. What few are left open (a chain of near copies, say, each like the next) take the pass. In these
rounds memories meet through the words of a prefix of their sets, rare ones first: two sets that are alike by
more than a threshold share one. Each keeps the first it is like, never all; so copies of one text
cost rows, not pairs. Sets are compared by hashes of their words, 64 bits that depend on the group.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recollect.functions.text import long_words
from recollect.operators.components import components
from recollect.operators.tiles import grow
from recollect.sources.storage import kept

#: Rows of a bucket on one side of a comparison (about); rows compared with at a time; words of a block, and common words looked at in one go.
PART, WIDE, BLOCK, COMMON = 2048, 64, 1 << 21, 1 << 22
#: Memories of a component, and open ones of rounds, that are left to a pass in order in one task.
LOCAL = 20_000
#: The most frequent words come last in the order of prefixes; so many are known as such, from a sample of about so many sets.
FREQUENT, SAMPLED = 1 << 14, 1 << 16
#: Bits of a sketch at least and at most; sketches of a block (about); rows and columns compared at a time; pairs and rows of a task (about).
BITS, SKETCHES, TILE, PAIRS, ROWS = (128, 4096), 1 << 15, (64, 2048), 1 << 28, 1 << 17
#: Memories of components that are looked up in the texts by a broadcast; memories whose words are sorted in one go.
LOOKED_UP, LISTED = 1 << 20, 1 << 11


def first_alike(run: np.ndarray, part: np.ndarray, ptr: np.ndarray, words: np.ndarray, least: float, source: np.ndarray, wants: np.ndarray) -> np.ndarray:
    """For each row of `wants` the first earlier row of `source` in its run whose set is like it by more than `least`, else -1.

    Rows come in order of run and id; ptr[r]:ptr[r + 1] are the words of row r. Rows of one part meet
    only where the run has no other.
    """
    rows = len(run)
    begin = np.flatnonzero(np.concatenate([[True], run[1:] != run[:-1]]))
    number = np.cumsum(np.concatenate([[False], run[1:] != run[:-1]]))
    place = np.arange(rows) - begin[number]
    crossed = (np.maximum.reduceat(part, begin) != np.minimum.reduceat(part, begin))[number]
    size = np.diff(ptr)
    owner = np.repeat(np.arange(rows), size)
    mixed = words ^ (number[owner].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))  # words of other runs don't meet
    found = np.full(rows, -1)
    for low in range(0, int(place.max(initial=0)) + 1, WIDE):
        inside = source & (place >= low) & (place < low + WIDE)
        asking = np.flatnonzero(wants & (found < 0) & (place > low))
        if not inside.any() or not len(asking):
            continue
        own = inside[owner]
        order = np.argsort(mixed[own], kind="stable")
        have, of = mixed[own][order], owner[own][order]
        asks = np.zeros(rows, bool)
        asks[asking] = True
        mine = asks[owner]
        wanted, who = mixed[mine], owner[mine]
        left, n = np.searchsorted(have, wanted), np.searchsorted(have, wanted, "right")
        n -= left
        upto = np.cumsum(n)
        at = 0
        while at < len(who):  # so many common words at a time, of whole rows
            end = int(np.searchsorted(who, who[max(at, min(len(who), int(np.searchsorted(upto, (upto[at - 1] if at else 0) + COMMON))) - 1)], "right"))
            some, before = slice(at, end), upto[at - 1] if at else 0
            me = np.repeat(who[some], n[some])
            other = of[np.repeat(left[some] - (upto[some] - n[some] - before), n[some]) + np.arange(len(me))]
            ok = (other < me) & ((part[other] != part[me]) | ~crossed[me])
            rows_here = np.unique(who[some])
            spot = np.searchsorted(rows_here, me[ok])
            shared = np.bincount(spot * WIDE + place[other[ok]] - low, minlength=len(rows_here) * WIDE).reshape(-1, WIDE)
            beside = np.minimum(begin[number[rows_here]][:, None] + low + np.arange(WIDE), rows - 1)
            alike = shared > least * np.maximum(size[rows_here][:, None] + size[beside] - shared, 1)
            hit = alike.any(axis=1)
            found[rows_here[hit]] = beside[hit, alike[hit].argmax(axis=1)]
            at = end
    return found


def _frequent(sets: DataFrame) -> np.ndarray:
    """The most frequent words of a sample of sets, sorted; they only set an order of words."""
    n = sets.count()
    some = sets if n <= SAMPLED else sets.filter(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < int((1 << 20) * SAMPLED / n))
    counts = some.select(F.explode("words").alias("w")).groupBy("w").count().filter("count > 1")
    top = counts.orderBy(F.desc("count"), "w").limit(FREQUENT).collect()
    return np.sort(np.array([r.w for r in top], np.int64).view(np.uint64))


def _csr(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    ptr = column.offsets.to_numpy().astype(np.int64)
    return ptr - ptr[0], pc.list_flatten(column).to_numpy().view(np.uint64)


def _meetings(sets: DataFrame, least: float) -> DataFrame:
    """(id, run, part): sets (id, words) that share a word of their prefixes, by runs to compare in one go."""
    frequent = sets.sparkSession.sparkContext.broadcast(_frequent(sets))

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ptr, words = _csr(batch.column(1))
            row = np.repeat(np.arange(batch.num_rows), np.diff(ptr))
            known = frequent.value
            common = known[np.minimum(np.searchsorted(known, words), len(known) - 1)] == words if len(known) else np.zeros(len(words), bool)
            order = np.lexsort((words, common, row))
            size = np.diff(ptr)[row]
            chosen = order[np.arange(len(words)) - ptr[row] < size - np.floor(least * size).astype(np.int64) + 1]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row[chosen])), pa.array(words[chosen].view(np.int64))], names=["id", "key"])

    slim = kept(sets.select("id", "words").mapInArrow(prefixes, "id long, key long"), "prefixes")
    shared = slim.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select("key", F.ceil(F.col("n") / PART).cast("int").alias("parts"))
    placed = slim.join(shared, "key").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    dealt = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return kept(dealt.select("id", F.xxhash64("key", F.least("part", "other"), F.greatest("part", "other")).alias("run"), "part"), "meetings")


def _met(meetings: DataFrame, sets: DataFrame, roles: DataFrame, least: float, final: bool = False) -> DataFrame:
    """(id, seed, waits): for each that asks the first seed before it that is like it, else the first open memory; from roles (id, is_seed, asks). final: seeds only."""
    rows = meetings.join(roles, "id").join(sets.select("id", "words"), "id").repartition("run").sortWithinPartitions("run", "id")

    def alike(run: pa.Table) -> pa.RecordBatch:
        t = run.combine_chunks().to_batches()[0]
        ids, number, part, seed, asks = (t.column(k).to_numpy(zero_copy_only=False) for k in range(5))
        ptr, words = _csr(t.column(5))
        one = first_alike(number, part, ptr, words, least, seed, asks)
        two = np.full(len(one), -1) if final else first_alike(number, part, ptr, words, least, ~seed, asks & (one < 0))
        at = np.flatnonzero((one >= 0) | (two >= 0))
        pick = lambda x: pa.array(ids[np.maximum(x[at], 0)], mask=x[at] < 0)
        return pa.RecordBatch.from_arrays([pa.array(ids[at]), pick(one), pick(two)], names=["id", "seed", "waits"])

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Whole runs, as many as make a block."""
        held, words = [], 0
        for b in batches:
            if not b.num_rows:
                continue
            key = b.column(1).to_numpy()
            edge = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            if held and words > BLOCK:
                cut = 0 if held[-1].column(1)[-1].as_py() != key[0] else int(edge[1]) if len(edge) > 1 else None
                if cut is not None:
                    if cut:
                        held.append(b.slice(0, cut))
                        b = b.slice(cut)
                    yield alike(pa.Table.from_batches(held))
                    held, words = [], 0
            held.append(b)
            words += len(pc.list_flatten(b.column(5)))
        if held:
            yield alike(pa.Table.from_batches(held))

    found = rows.select("id", "run", "part", "is_seed", "asks", "words").mapInArrow(blocks, "id long, seed long, waits long")
    return found.groupBy("id").agg(F.min("seed").alias("seed"), F.min("waits").alias("waits"))


def _in_order(open_: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """Seeds among the few memories still open: the pass itself, a task a group."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("id")
        seeds: list[frozenset] = []
        index: dict[int, list[int]] = {}
        chosen = []
        for i, words in zip(table.column("id").to_pylist(), table.column("words").to_pylist(), strict=True):
            own, prefix = frozenset(words), sorted(words)[: len(words) - int(least * len(words)) + 1]
            near = (seeds[k] for k in {k for w in prefix for k in index.get(w, ())})
            if not any(len(own & s) > least * len(own | s) for s in near):
                for w in prefix:
                    index.setdefault(w, []).append(len(seeds))
                seeds.append(own)
                chosen.append(i)
        return pa.table({"id": pa.array(chosen, pa.int64())})

    return open_.select("id").join(sets, "id").groupBy("g").applyInArrow(run, "id long")


def _by_rounds(sets: DataFrame, least: float) -> DataFrame:
    """(head, seed) of sets (id, g, words) that are like an earlier seed, by rounds."""
    meetings = _meetings(sets, least)
    open_ = kept(sets.select("id").join(meetings.select("id").distinct(), "id", "left_semi"), "open")
    seeds, fresh = [kept(sets.select("id").join(open_, "id", "left_anti"), "seeds")], None
    left = open_.count()
    while left > LOCAL:
        roles = open_.select("id", F.lit(False).alias("is_seed"), F.lit(True).alias("asks"))
        if fresh is not None:
            roles = roles.unionByName(fresh.select("id", F.lit(True).alias("is_seed"), F.lit(False).alias("asks")))
        state = kept(open_.join(_met(meetings, sets, roles, least), "id", "left").filter("seed is null"), "round")
        fresh = kept(state.filter("waits is null").select("id"), "seeds")
        seeds.append(fresh)
        open_ = state.filter("waits is not null").select("id")
        left = open_.count()
    if left and fresh is not None:  # those that the last seeds settle are no longer open
        roles = open_.selectExpr("id", "false as is_seed", "true as asks").unionByName(fresh.selectExpr("id", "true as is_seed", "false as asks"))
        open_ = open_.join(_met(meetings, sets, roles, least, final=True), "id", "left_anti")
    if left:
        seeds.append(kept(_in_order(open_, sets, least), "seeds"))
    chosen = seeds[0]
    for s in seeds[1:]:
        chosen = chosen.unionByName(s)
    roles = sets.select("id").join(chosen.withColumn("is_seed", F.lit(True)), "id", "left").select("id", F.coalesce("is_seed", F.lit(False)).alias("is_seed"))
    roles = kept(roles.withColumn("asks", ~F.col("is_seed")), "roles")
    return kept(_met(meetings, sets, roles, least, final=True).select(F.col("id").alias("head"), "seed"), "homes")


def _distinct(ptr: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's words in order, equal ones once."""
    row = np.repeat(np.arange(len(ptr) - 1), np.diff(ptr))
    order = np.lexsort((words, row))
    words, row = words[order], row[order]
    new = np.concatenate([[True], (words[1:] != words[:-1]) | (row[1:] != row[:-1])])[: len(words)]
    return np.concatenate([[0], np.cumsum(np.bincount(row[new], minlength=len(ptr) - 1))]), words[new]


def _prints(listed: DataFrame, least: float) -> DataFrame:
    """(name, id, g, n, k, digest, sketch) of (name, id, g, words), words in any order and with repeats: size of a set, its class of size, a hash of its words, and its sketch. A narrow map.

    Sets alike by more than `least` are of one class or of neighbouring ones; a class has one width of sketches.
    """
    wide = -math.log(least) if least > 0.1 else math.inf

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (b.slice(k, LISTED) for b in batches for k in range(0, b.num_rows, LISTED)):
            ptr, words = _distinct(*_csr(b.column(3)))
            size = np.diff(ptr)
            kind = np.floor(np.log(np.maximum(size, 1)) / wide).astype(np.int32)
            bits = np.clip(np.exp2(np.ceil((kind + 1) * wide / math.log(2))), *BITS).astype(np.int64)
            data = np.ascontiguousarray(words).tobytes()
            ends = (ptr * 8).tolist()
            digests = [hashlib.blake2b(data[x:y], digest_size=16).digest() for x, y in zip(ends[:-1], ends[1:], strict=True)]
            sketches: list[bytes] = [b""] * b.num_rows
            for w in np.unique(bits).tolist():
                rows = np.flatnonzero(bits == w)
                step = max(1, (1 << 22) // w)
                for at in (rows[k : k + step] for k in range(0, len(rows), step)):
                    n = size[at]
                    own = np.repeat(ptr[at] - (np.cumsum(n) - n), n) + np.arange(n.sum())
                    place = np.repeat(np.arange(len(at)), n) * w + (words[own] & np.uint64(w - 1)).astype(np.int64)
                    odd = np.packbits((np.bincount(place, minlength=len(at) * w) & 1).astype(np.uint8).reshape(len(at), w), axis=1)
                    for i, x in zip(at.tolist(), odd, strict=True):
                        sketches[i] = x.tobytes()
            more = [pa.array(size), pa.array(kind), pa.array(digests, pa.binary()), pa.array(sketches, pa.binary())]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], *more], names=["name", "id", "g", "n", "k", "digest", "sketch"])

    fields = [("n", T.LongType()), ("k", T.IntegerType()), ("digest", T.BinaryType()), ("sketch", T.BinaryType())]
    schema = T.StructType([*(listed.schema[c] for c in ("name", "id", "g")), *(T.StructField(c, t) for c, t in fields)])
    return listed.select("name", "id", "g", "words").mapInArrow(run, schema)


def _halved(x: np.ndarray, words: int) -> np.ndarray:
    """Sketches (a row a word of 64 bits) of so many words."""
    while len(x) > words:
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    return x


def may_be_alike(one: tuple[np.ndarray, np.ndarray], two: tuple[np.ndarray, np.ndarray] | None, least: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of two sides, or of one with itself, whose sets can be alike by more than `least`: each side is sizes, ascending, and sketches (a row a word)."""
    (a, x), (b, y) = one, two or one
    x, y = (np.ascontiguousarray(_halved(z, min(len(x), len(y)))) for z in (x, y))
    rate = (1 - least) / (1 + least)
    whole = np.empty(TILE, np.uint64), np.empty(TILE, np.uint8), np.empty(TILE, np.uint16)
    for i in range(0, len(a), TILE[0]):
        upto = min(i + TILE[0], len(a))
        low, high = int(np.searchsorted(b, least * a[i] - 1e-6)), int(np.searchsorted(b, a[upto - 1] / max(least, 1e-9) + 1e-6))
        for j in range(low if two else i, high, TILE[1]):
            end = min(j + TILE[1], high)
            differ, bits, count = (z[: upto - i, : end - j] for z in whole)
            count[:] = 0
            for k in range(len(x)):
                np.bitwise_xor(x[k, i:upto, None], y[k, j:end], out=differ)
                np.bitwise_count(differ, out=bits)
                np.add(count, bits, out=count)
            most = np.floor((a[i:upto, None] + b[j:end]) * rate + 1e-6)
            r, c = np.nonzero(count <= most)
            r, c = r + i, c + j
            if two is None:
                r, c = r[r < c], c[r < c]
            if len(r):
                yield r, c


def _links(heads: DataFrame, least: float) -> DataFrame:
    """(a, b): a forest of heads (id, g, n, k, sketch) whose sets can be alike, for each block they meet in."""
    counts = kept(heads.groupBy("g", "k").agg(F.count("*").alias("rows")).withColumn("parts", F.ceil(F.col("rows") / SKETCHES).cast("int")), "classes")
    total = counts.agg(F.sum(F.col("rows") * F.col("rows")).alias("pairs"), F.sum(F.col("rows") * F.col("parts")).alias("rows")).first()
    tasks = max(1, -(-int(total.pairs or 0) // PAIRS), -(-int(total.rows or 0) // ROWS))
    beside = lambda by, name: counts.select("g", (F.col("k") + by).alias("k"), F.col("parts").alias(name))
    near = counts.join(beside(1, "lower"), ["g", "k"], "left").join(beside(-1, "upper"), ["g", "k"], "left").na.fill(0, ["lower", "upper"])
    dealt = heads.join(near, ["g", "k"]).withColumn("block", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    block, met = F.col("block"), F.struct
    over = lambda n, to: F.transform(F.filter(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), lambda o: o < n), to)
    own = over(F.when(F.col("rows") > 1, F.col("parts")).otherwise(0), lambda o: met(F.xxhash64("g", "k", F.lit(0), F.least(block, o), F.greatest(block, o)).alias("run"), F.when(o == block, 2).otherwise((block > o).cast("int")).alias("side")))
    below = over(F.col("lower"), lambda o: met(F.xxhash64("g", "k", F.lit(1), o, block).alias("run"), F.lit(1).alias("side")))
    above = over(F.col("upper"), lambda o: met(F.xxhash64("g", F.col("k") + 1, F.lit(1), block, o).alias("run"), F.lit(0).alias("side")))
    rows = dealt.select("id", "n", "sketch", F.explode(F.concat(own, below, above)).alias("m")).select("m.run", "m.side", "n", "id", "sketch")

    def forest(run: pa.Table) -> pa.RecordBatch:
        side, size, ids = (run.column(k).to_numpy() for k in (1, 2, 3))
        cut = int(np.searchsorted(side, 1)) if side[0] != 2 else len(side)
        sides = []
        for x, y in ((0, cut), (cut, len(side))):
            if x < y:
                data = np.frombuffer(b"".join(run.column(4).slice(x, y - x).to_pylist()), np.uint64)
                sides.append((size[x:y], data.reshape(y - x, -1).T))
        parent = np.arange(len(side))
        if len(sides) == 2 or side[0] == 2:
            for r, c in may_be_alike(sides[0], sides[1] if len(sides) == 2 else None, least):
                c = c + cut if len(sides) == 2 else c
                new = parent[r] != parent[c]
                if new.any():
                    grow(parent, r[new], c[new])
        at = np.flatnonzero(parent != np.arange(len(side)))
        return pa.RecordBatch.from_arrays([pa.array(ids[at]), pa.array(ids[parent[at]])], names=["a", "b"])

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in _whole(batches, 0, SKETCHES):
            key = run.column(0).to_numpy()
            edge = [*np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])).tolist(), len(key)]
            found = [forest(run.slice(x, y - x)) for x, y in zip(edge[:-1], edge[1:], strict=True) if y - x > 1]
            if found:
                yield pa.Table.from_batches(found).combine_chunks().to_batches()[0] if sum(f.num_rows for f in found) else found[0]

    return rows.repartition(tasks, "run").sortWithinPartitions("run", "side", "n").mapInArrow(runs, "a long, b long")


def _whole(batches: Iterator[pa.RecordBatch], column: int, rows: int) -> Iterator[pa.Table]:
    """Tables of rows that come in order of a column: whole groups of equal values, so many rows or more but for the last."""
    held, n = [], 0
    for b in batches:
        if not b.num_rows:
            continue
        key = b.column(column).to_numpy()
        if n >= rows:
            last = held[-1].column(column)[-1].as_py()
            cut = int(np.argmax(key != last)) if (key != last).any() else None
            if cut is not None:
                yield pa.Table.from_batches([*held, b.slice(0, cut)]).combine_chunks()
                held, n, b = [], 0, b.slice(cut)
        held.append(b)
        n += b.num_rows
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _by_components(sets: DataFrame, least: float) -> DataFrame:
    """(head, seed) of sets (component, id, words) that are like an earlier seed: the pass over each component."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, heads, homes = None, [], []
        for b in batches:
            ptr, words = _csr(b.column(2))
            for r, (component, i) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)):
                if component != now:
                    now, seeds, index = component, [], {}
                listed = words[ptr[r] : ptr[r + 1]].tolist()
                own, prefix = frozenset(listed), listed[: len(listed) - int(least * len(listed)) + 1]
                near = sorted({k for w in prefix for k in index.get(w, ())})
                home = next((seeds[k][0] for k in near if (shared := len(own & seeds[k][1])) > least * (len(own) + len(seeds[k][1]) - shared)), None)
                if home is None:
                    for w in prefix:
                        index.setdefault(w, []).append(len(seeds))
                    seeds.append((i, own))
                else:
                    heads.append(i)
                    homes.append(home)
        yield pa.RecordBatch.from_arrays([pa.array(heads, pa.int64()), pa.array(homes, pa.int64())], names=["head", "seed"])

    return sets.select("component", "id", "words").repartition("component").sortWithinPartitions("component", "id").mapInArrow(run, "head long, seed long")


def seed_clusters(memories: DataFrame, least: float = 0.8, group: str = "project_id", ident: str = "id", content: str = "content") -> DataFrame:
    """(group, seed, id): each memory with the first seed of its group whose word set is like its own by more than `least`.

    Greedy in order of id: a memory that is like no earlier seed is one itself. A memory without words
    (blank or null text) is like nothing and a seed of its own; a null group is a group; ids are unique. The
    memories are read twice: all for their sketches, and those of components for their words.
    """
    g = F.xxhash64(F.col(group), F.col(group).isNull())
    words = F.transform(long_words(F.coalesce(F.col(content), F.lit(""))), lambda w: F.xxhash64(g, w))
    every = memories.select(F.col(group).alias("name"), F.col(ident).cast("long").alias("id"), g.alias("g"), words.alias("words"))
    prints = kept(_prints(every, least), "sketches")
    # a set is named by its hash; the smallest id stands for all that have it
    whole = prints.filter("n > 0")
    heads = kept(whole.groupBy("digest").agg(F.min("id").alias("id"), *(F.any_value(c).alias(c) for c in ("g", "n", "k", "sketch"))), "heads")
    links = kept(_links(heads, least), "links")
    member = whole.select("digest", "id").join(heads.select("digest", F.col("id").alias("head")), "digest").select("id", "head")
    homes = None
    if not links.isEmpty():
        linked = kept(components(links), "components")
        n = linked.count()
        sets = every.join(F.broadcast(linked) if n <= LOOKED_UP else linked, "id").select("component", "id", "g", F.array_sort(F.array_distinct("words")).alias("words"))
        large = kept(linked.groupBy("component").count().filter(F.col("count") > LOCAL).select("component"), "large")
        if large.isEmpty():
            homes = kept(_by_components(sets, least), "homes")
        else:
            sets = kept(sets, "sets")
            small = kept(_by_components(sets.join(large, "component", "left_anti"), least), "homes")
            homes = small.unionByName(_by_rounds(sets.join(large, "component", "left_semi").select("id", "g", "words"), least))
    placed = member.withColumn("seed", F.col("head")) if homes is None else member.join(homes, "head", "left").select("id", "head", F.coalesce("seed", "head").alias("seed"))
    return prints.select("name", "id").join(placed.select("id", "seed"), "id", "left").select(F.col("name").alias(group), F.coalesce("seed", "id").alias("seed"), F.col("id").alias(ident))
