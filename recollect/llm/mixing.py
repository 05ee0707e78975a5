"""Mixing of sources to target weights by capped water-filling.

A budget of words is shared among sources by weight. A source gives its words `max_epochs` times at
most: where its share is above that it is clamped, and what it leaves is shared anew by the weights
of the others, until no share is above its cap. The rounds of clamping are the prefixes of the
sources in order of cap per weight, so one window over the table of sources (not of documents)
finds the last round.

A source's target is then a number of epochs: its whole part repeats every document, its fraction
a seeded sample. The sample are the documents that come first in the order of a seeded hash, as far
as the words allow, and one document more, the one that brings the source closest to its target.
The place of the cut is found by histograms of the hash, coarse and fine, and an exact running
sum in the one fine bin that holds it. So texts are never shuffled, a source of any size is
spread over all tasks, and what a document gets depends on its row and the table of sources alone.

Defined results: null and empty texts have size 0, are in the mix as often as others of their hash,
and take no words; rows that agree in id, text and source share one fate; a null source is a source; a
source without words, or with a weight that is null, not finite or not above 0, has target 0. If
all sources together cannot give the budget, each gives its cap. A cap that is no whole number binds
the source, and a document may come up to the next whole number of times.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recollect.llm.common import discard, stored, unclashed

WORD = r"[^\x20\x09-\x0D]+"
#: Bits of the seeded hash, and of each of the two histograms that find a cut.
KEY_BITS, STEP_BITS = 60, 12
_COARSE, _FINE = KEY_BITS - STEP_BITS, KEY_BITS - 2 * STEP_BITS


def word_count(text: str) -> Column:
    return F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(WORD)).cast("long")


def order_key(seed: int, doc_id: str, text: str, source: str) -> Column:
    """60 bits of MD5 over the seed and the row's id, source and text."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (doc_id, source, text)]
    return F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), *parts)), 1, KEY_BITS // 4), 16, 10).cast("long")


def beside(left: DataFrame, right: DataFrame, how: str = "inner") -> DataFrame:
    """left, and what the table `right` of sources says of the row's source; null meets null."""
    right = right.withColumnRenamed("source", "of_source")
    return left.join(right, F.col("source").eqNullSafe(F.col("of_source")), how).drop("of_source")


def filled(sources: DataFrame, share: float, max_epochs: float) -> DataFrame:
    """Water-filling: `target` for each row of (source, source_size, weight); the budget is `share` times all sizes.

    In order of cap per weight, the level of a row is what a unit of weight gets once all rows before
    it are clamped. Clamping a row whose share is above its cap raises the level for the rest, and
    clamping any other would lower it, so the highest level is that of the last round.
    """
    weight = F.when((F.col("weight") > 0) & (F.col("weight") < float("inf")), F.col("weight").cast("double"))
    shares = sources.withColumn("weight", weight).withColumn("cap", F.when(weight > 0, F.col("source_size") * F.lit(float(max_epochs))).otherwise(0.0))
    everyone = Window.partitionBy()
    by_cap = Window.orderBy(F.col("weight").isNull(), F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before, after = by_cap.rowsBetween(Window.unboundedPreceding, -1), by_cap.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    budget = F.sum("source_size").over(everyone) * F.lit(float(share))
    level = (budget - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    levels = shares.withColumn("level", F.when(F.col("weight") > 0, level))
    water = F.max("level").over(everyone)
    return levels.withColumn("target", F.coalesce(F.least("cap", water * F.col("weight")), F.lit(0.0))).select("source", "source_size", "target")


def _cut(bins: DataFrame, plan: DataFrame) -> DataFrame:
    """plan (source, left) with `bin`, the first of its source's bins (source, bin, words) that the words left don't hold, and `left` without the bins before it."""
    running = beside(bins.withColumn("upto", F.sum("words").over(Window.partitionBy("source").orderBy("bin"))), plan)
    over = running.filter("upto > left").groupBy("source").agg(F.min("bin").alias("bin"))
    passed = running.filter("upto <= left").groupBy("source").agg(F.max("upto").alias("passed"))
    joined = beside(beside(plan, over, "left"), passed, "left")
    return joined.select("source", (F.col("left") - F.coalesce("passed", F.lit(0))).alias("left"), "bin")


def mixture(rows: DataFrame, weights: DataFrame, share: float = 1.5, max_epochs: float = 2.0) -> DataFrame:
    """The plan of a mix: for each source its source_size, target, whole (epochs of every document), cut and extra.

    rows: (source, size, key) of every document. weights: (source, weight), a row a source. A
    document comes whole times, and once more if its key is at most `cut` or equals `extra`.
    """
    totals = beside(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, "left")
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    plan = stored(filled(totals, share, max_epochs).withColumn("whole", whole), "mix-plan")
    left = plan.select("source", (F.floor(F.col("target") + 0.5) - F.col("whole") * F.col("source_size")).alias("left")).filter("left > 0")

    def bins(within: DataFrame, shift: int) -> DataFrame:
        return within.groupBy("source", F.shiftright("key", shift).alias("bin")).agg(F.sum("size").alias("words"))

    def inside(found: DataFrame, shift: int) -> DataFrame:
        """Rows in the bin that was found for their source."""
        return beside(rows, found.select("source", "bin")).filter(F.shiftright("key", shift) == F.col("bin")).select("source", "size", "key")

    coarse = stored(_cut(bins(rows, _COARSE), left), "mix-coarse")
    fine = stored(_cut(bins(inside(coarse, _COARSE), _FINE), coarse.drop("bin")), "mix-fine")
    last = stored(_cut(bins(inside(fine, _FINE), 0), fine.drop("bin")), "mix-cut")
    # the first key that no longer fits is `bin`; without one, all fit
    cuts = last.select("source", F.coalesce(F.col("bin") - 1, F.lit((1 << KEY_BITS) - 1)).alias("cut"), "left")
    beyond = beside(rows.filter("size > 0"), cuts).filter((F.col("key") > F.col("cut")) & (F.col("size") < 2 * F.col("left")))
    best = F.min(F.struct(F.abs(F.col("size") - F.col("left")).alias("off"), F.col("key").alias("extra"), "left"))
    best = stored(beyond.groupBy("source").agg(best.alias("b")).select("source", "b.extra", "b.left"), "mix-extra")
    # rows that repeat share the key: it is taken only if all of them together bring the source closer
    together = beside(rows, best).filter("key = extra").groupBy("source", "extra", "left").agg(F.sum("size").alias("words"))
    extra = together.filter(F.abs(F.col("words") - F.col("left")) < F.col("left")).select("source", "extra")
    out = stored(beside(beside(plan, cuts.drop("left"), "left"), extra, "left"), "mix-sources")
    discard(plan, coarse, fine, last, best)
    return out


def repeats(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """rows (with source and key) and their source's source_size, target, and `repeats`: how often each is in the mix."""
    more = F.coalesce(F.col("key") <= F.col("cut"), F.lit(False)) | F.coalesce(F.col("key") == F.col("extra"), F.lit(False))
    return beside(rows, plan).withColumn("repeats", F.col("whole") + more.cast("long")).drop("whole", "cut", "extra")


def measured(docs: DataFrame, seed: int, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """(doc_id, source, size, key) of every document, written: texts are read once."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), word_count(text).alias("size"), order_key(seed, doc_id, text, source).alias("key"))
    return stored(rows, "mix-rows")


def cyclic_weights(rows: DataFrame, cycle: tuple[float, ...] = (5.0, 2.0, 1.0)) -> DataFrame:
    """(source, weight): the sources by code point, null last, weigh the numbers of the cycle in turn."""
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    return rows.select("source").distinct().select("source", F.element_at(F.array(*[F.lit(w) for w in cycle]), (place % len(cycle) + 1).cast("int")).alias("weight"))


def taken_words(docs: DataFrame, share: float = 1.5, max_epochs: float = 2.0, seed: int = 11) -> DataFrame:
    """doc_id, size, source_size, target and taken (words the mix takes, repeats counted) of every document, at cyclic weights."""
    rows = measured(docs, seed)
    plan = mixture(rows, cyclic_weights(rows), share, max_epochs)
    return repeats(rows, plan).select("doc_id", "size", "source_size", "target", (F.col("repeats") * F.col("size")).alias("taken"))


def mixed(docs: DataFrame, weights: DataFrame, share: float = 1.5, max_epochs: float = 2.0, seed: int = 11, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The mix itself: every column of docs, a row for each repetition, and `repetition` from 0 (with _in after a column of that name).

    weights: (source, weight), a row a source. Only the narrow table of the sources is joined, so texts stay in their partitions.
    """
    thin = measured(docs, seed, doc_id, text, source)
    plan = mixture(thin, weights, share, max_epochs)
    discard(thin)
    names = unclashed(docs.columns, ["repetition"])
    plain = docs.toDF(*[f"doc_{i}" for i in range(len(names))])
    at = {n: f"doc_{docs.columns.index(n)}" for n in (doc_id, text, source)}
    keyed = plain.withColumn("source", F.col(at[source])).withColumn("key", order_key(seed, at[doc_id], at[text], at[source]))
    each = F.explode(F.sequence(F.lit(0), F.col("repeats").cast("int") - 1)).alias("repetition")
    return repeats(keyed, plan).filter("repeats > 0").select(*[F.col(f"doc_{i}").alias(n) for i, n in enumerate(names)], each)
