"""Mixing sources to target weights with a low-discrepancy schedule; DataFrame expressions only.

Targets: sources in code-point order (null last) weigh 1, 2, 3, 1, 2, … and share all words; a target stops at
`epochs` times its source's size and the excess goes to the others by weight (water filling).

Schedule: slot i takes the golden-ratio point u_i = frac(i * phi) through the cumulative target shares, which names
its source; slots are ranked per source. A source's documents, in md5 order of doc_id, form a stream that is read up
to `epochs` times; its first floor(target) words are cut into as many equal blocks as the source has slots (one at
least), and the slot of rank k takes block k. So a source takes exactly floor(target) words, no document more than
`epochs` times its size, and any prefix of the slots holds the sources in proportion.

Scale: only (doc_id, source, size) leave the scan. Running sums go by (source, 1 of 4096 hash buckets), and ranks by
(source, chunk of slots), so a hot source is spread over many tasks; its bucket totals alone meet in one window. Sources
are numbered and summed by ranges of names, so they need not fit one task either: what meets in a window without a key is
one row for each range.

Defined cases: null text has size 0 and takes 0; a null source is a source; rows with one doc_id are separate
documents; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.sources.tables import staged

WORD = r"[^\x20\x09-\x0D]+"
CHUNK, LEAST_GRID = 4096, 10
#: floor(2**32 / golden ratio): a Weyl sequence of 2**32 distinct points, which then begins again.
STEP = 2654435769


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def div(a: Column, b: Column) -> Column:
    """Exact integer division of values whose products pass 64 bits."""
    return F.call_function("div", a.cast("decimal(38,0)"), b.cast("decimal(38,0)"))


def ranked(sizes: DataFrame) -> DataFrame:
    """source, source_size, part, sid: sources numbered by code point, null last, without bringing all to one task."""
    by_name = F.col("source").asc_nulls_last()
    s = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    s = staged(s.repartitionByRange(by_name).withColumn("part", F.spark_partition_id()), "mix-sources")
    # one row for each range
    counts = s.groupBy("part").count()
    ahead = F.coalesce(F.sum("count").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    s = s.join(counts.select("part", ahead.alias("ahead")), "part")
    return s.withColumn("sid", F.col("ahead") + F.row_number().over(W.partitionBy("part").orderBy(by_name))).drop("ahead")


def targets(sizes: DataFrame, weights=(1, 2, 3), epochs: int = 3) -> DataFrame:
    """source, sid, source_size, target, take, lo, hi (cumulative share). One row per source."""
    s = ranked(sizes)
    s = s.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), ((F.col("sid") - 1) % len(weights) + 1).cast("int")).cast("bigint"))
    s = staged(s.withColumn("cap", F.col("source_size") * epochs), "mix-ranked")
    # water filling: sources at their cap leave the rest to the others, until no more reach theirs; each step is two sums
    total, used, left, level = s.agg(F.sum("source_size")).first()[0] or 0, -1, 0, 0.0
    now = s.agg(F.lit(0).cast("bigint").alias("used"), F.sum("w").alias("left")).first()
    while now.left and (now.used, now.left) != (used, left):
        used, left = now.used, now.left
        level = float(total - used) / float(left)
        full = F.lit(level) * F.col("w") > F.col("cap")
        now = s.agg(F.coalesce(F.sum(F.when(full, F.col("cap"))), F.lit(0)).alias("used"), F.sum(F.when(~full, F.col("w"))).alias("left")).first()
    share = F.lit(level) * F.col("w")
    s = s.withColumn("target", F.when(share <= F.col("cap"), share).otherwise(F.col("cap").cast("double"))).withColumn("take", F.floor("target"))
    parts = s.groupBy("part").agg(F.sum("take").alias("words"))
    every = W.orderBy("part").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    ahead = F.coalesce(F.sum("words").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    s = s.join(parts.select("part", ahead.alias("ahead"), F.greatest(F.sum("words").over(every), F.lit(1)).alias("taken")), "part")
    hi = F.col("ahead") + F.sum("take").over(W.partitionBy("part").orderBy("sid").rowsBetween(W.unboundedPreceding, 0))
    return s.select("source", "sid", "source_size", "target", "take", ((hi - F.col("take")) / F.col("taken")).alias("lo"), (hi / F.col("taken")).alias("hi"))


def golden(i: Column) -> Column:
    """frac(i * phi) on 32 bits, for any i up to 2**47; halves are multiplied apart, so that nothing passes 63 bits."""
    low, high = F.pmod(i, F.lit(2**16)), F.pmod(F.shiftright(i, 16), F.lit(2**16))
    return F.pmod(low * F.lit(STEP) + F.pmod(high * F.lit(STEP), F.lit(2**16)) * F.lit(2**16), F.lit(2**32)).cast("double") / float(2**32)


def schedule(goals: DataFrame, n: int) -> DataFrame:
    """slot, sid, rank (0-based within the source) for n slots."""
    spark = goals.sparkSession
    # a grid over [0, 1) turns the interval join into an equi-join; a source spans the cells that it overlaps, and cells
    # are several times as many as sources, so that a cell holds few of either
    grid = 2 ** max(LEAST_GRID, (4 * goals.count()).bit_length())
    slots = spark.range(n).select(F.col("id").alias("slot"), golden(F.col("id")).alias("u")).withColumn("cell", F.floor(F.col("u") * grid))
    last = F.least(F.floor(F.col("hi") * grid), F.lit(grid - 1))
    spans = goals.where(F.col("take") > 0).select("sid", "lo", "hi", F.explode(F.sequence(F.least(F.floor(F.col("lo") * grid), last), last)).alias("cell"))
    slots = slots.join(spans, "cell").where((F.col("lo") <= F.col("u")) & (F.col("u") < F.col("hi"))).select("slot", "sid")
    slots = slots.withColumn("chunk", F.floor(F.col("slot") / CHUNK))
    counts = slots.groupBy("sid", "chunk").count()
    base = F.coalesce(F.sum("count").over(W.partitionBy("sid").orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    slots = slots.join(counts.select("sid", "chunk", base.alias("base")), ["sid", "chunk"])
    rank = F.col("base") + F.row_number().over(W.partitionBy("sid", "chunk").orderBy("slot")) - 1
    # a source too small to win a slot gets one behind the others
    missed = goals.where(F.col("take") > 0).join(counts.select("sid"), "sid", "left_anti")
    extra = missed.select((F.col("sid") + n).cast("bigint").alias("slot"), "sid", F.lit(0).cast("bigint").alias("rank"))
    return slots.select("slot", "sid", rank.cast("bigint").alias("rank")).unionByName(extra)


def mix(df: DataFrame, weights=(1, 2, 3), epochs: int = 3, least_slots: int = 65536, block: int = 4096) -> tuple[DataFrame, DataFrame]:
    """(documents, pieces): doc_id, source, size, source_size, target, take, sid, start; and slot, doc_id, start, words."""
    docs = staged(df.select("doc_id", "source", n_words(F.col("text")).alias("size")), "mix-sizes")
    total = docs.agg(F.sum("size")).first()[0] or 0
    goals = staged(targets(docs, weights, epochs), "mix-goals")
    slots = staged(schedule(goals, int(min(max(least_slots, total // block), max(total, 1)))), "mix-slots")
    goals = goals.join(slots.groupBy("sid").agg(F.count("*").alias("n")), "sid", "left")

    h = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    docs = docs.withColumn("h", h).withColumn("bucket", F.substring("h", 1, 3))
    docs = docs.withColumnRenamed("source", "src").join(goals, F.col("src").eqNullSafe(F.col("source"))).drop("src")
    sums = docs.groupBy("sid", "bucket").agg(F.sum("size").alias("words"))
    ahead = F.coalesce(F.sum("words").over(W.partitionBy("sid").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    within = F.sum("size").over(W.partitionBy("sid", "bucket").orderBy("h", "doc_id", "size").rowsBetween(W.unboundedPreceding, 0))
    docs = docs.join(sums.select("sid", "bucket", ahead.alias("ahead")), ["sid", "bucket"])
    docs = docs.withColumn("start", F.col("ahead") + within - F.col("size"))

    # the blocks that each reading of a document meets
    p = docs.where((F.col("size") > 0) & (F.col("take") > 0)).withColumn("epoch", F.explode(F.array(*[F.lit(e) for e in range(epochs)])))
    p = p.withColumn("lo", F.col("epoch") * F.col("source_size") + F.col("start"))
    p = p.withColumn("hi", F.least(F.col("lo") + F.col("size"), F.col("take"))).where(F.col("lo") < F.col("hi"))
    block_of = lambda pos: div((pos + 1).cast("decimal(38,0)") * F.col("n") - 1, F.col("take"))
    p = p.withColumn("rank", F.explode(F.sequence(block_of(F.col("lo")), block_of(F.col("hi") - 1))))
    edge = lambda k: div(k.cast("decimal(38,0)") * F.col("take"), F.col("n"))
    words = F.least(F.col("hi"), edge(F.col("rank") + 1)) - F.greatest(F.col("lo"), edge(F.col("rank")))
    pieces = p.withColumn("words", words).join(slots, ["sid", "rank"])
    return docs, pieces.select("slot", "sid", "doc_id", "size", "start", "epoch", "source_size", "target", "words")


def taken(df: DataFrame, **options) -> DataFrame:
    """Per document: doc_id, size, source_size, target, taken."""
    docs, pieces = mix(df, **options)
    key = ["doc_id", "size", "source_size", "target", "sid", "start"]
    some = docs.where(F.col("size") > 0).select(*key, F.lit(0).cast("bigint").alias("words")).unionByName(pieces.select(*key, "words"))
    some = some.groupBy(*key).agg(F.sum("words").alias("taken"))
    none = docs.where(F.col("size") == 0).select(*key, F.lit(0).cast("bigint").alias("taken"))
    return some.unionByName(none).select("doc_id", "size", "source_size", "target", "taken")
