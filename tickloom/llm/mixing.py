"""Operator 5: mix sources to target weights.

Sizes are counted once and kept as a narrow table (no text). Targets come from the per-source totals by raising the
water level over sources that aren't at their ceiling. Documents are range-sorted by (source, hash-random key), so a
source with a third of all rows spreads over many ranges; totals per (range, source) give each range its offset, and
a document's place in its source is offset + the running sum within the range.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.session import stage

_SPACES = r"[\x20\x09-\x0D]+"


def word_count(text):
    return F.size(F.array_remove(F.split(F.coalesce(text.cast("string"), F.lit("")), _SPACES), "")).cast("long")


def _numbered(sources: DataFrame) -> DataFrame:
    """Adds place, the source's rank by code point (from 0, null last). One row per source in, range-sorted."""
    ranged = stage(sources.repartitionByRange(F.col("source").asc_nulls_last()).withColumn("range", F.spark_partition_id()))
    within = Window.partitionBy("range").orderBy(F.col("source").asc_nulls_last())
    sizes = ranged.groupBy("range").agg(F.count("*").alias("c"))
    before = sizes.select("range", (F.sum("c").over(Window.orderBy("range")) - F.col("c")).alias("before"))  # a row per partition
    return ranged.join(before, "range").select("source", "source_size", (F.col("before") + F.row_number().over(within) - 1).alias("place"))


def source_targets(sources: DataFrame, weights: tuple[int, ...] = (5, 2, 1), ceiling: int = 3) -> DataFrame:
    """(source, source_size, target) from (source, source_size).

    Sources by code point, null last, weigh ``weights``, repeating, and share the sum of all sizes. No target exceeds
    ``ceiling`` times its source's size; what is over is shared anew by weight among the others until none is over.
    """
    cycle = F.array(*(F.lit(float(w)) for w in weights))
    left = stage(_numbered(sources).withColumn("weight", F.get(cycle, (F.col("place") % len(weights)).cast("int"))).withColumn("most", ceiling * F.col("source_size").cast("double")))
    total = left.agg(F.sum("source_size")).first()[0] or 0
    level, full = 0.0, -1
    while True:  # a round per set of sources that newly reach their ceiling
        at = F.col("most") <= level * F.col("weight")
        n, held, weight = left.agg(F.sum(at.cast("long")), F.sum(F.when(at, F.col("most"))), F.sum(F.when(~at, F.col("weight")))).first()
        if not weight or n == full:
            break
        full, level = n, (total - (held or 0.0)) / weight
    return left.select("source", "source_size", F.least("most", level * F.col("weight")).alias("target"))


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), ceiling: int = 3, seed: int = 11) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken) for every row of ``docs`` (doc_id, text, source).

    A source's budget is its target rounded to whole words. In the order of a hash-random key its documents are
    taken whole, epoch after epoch, and the document at the cut gives the words that are left, so each source's
    taken words equal its budget and no document gives more than ``ceiling`` times its size. The key is a hash of the id and
    the size, so reruns agree; rows with equal keys take turns in one order, and equal rows are interchangeable.
    A null text has size 0 and gives nothing; a null source is a source of its own, the last; an empty table gives no rows.
    """
    key = F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("size"))
    sized = docs.select("doc_id", F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size"))
    order = (F.col("source").asc_nulls_last(), F.col("key"), F.col("doc_id"), F.col("size"))
    ranged = stage(sized.withColumn("key", key).repartitionByRange(*order).withColumn("range", F.spark_partition_id()))
    parts = stage(ranged.groupBy("range", "source").agg(F.sum("size").alias("part")))  # ranges + sources rows at most
    before = parts.withColumn("before", F.sum("part").over(Window.partitionBy("source").orderBy("range")) - F.col("part"))
    targets = source_targets(parts.groupBy("source").agg(F.sum("part").alias("source_size")), weights, ceiling)
    offsets = before.join(targets.withColumnRenamed("source", "s"), F.expr("source <=> s")).select(F.col("range").alias("r"), "s", "before", "source_size", "target")
    running = F.sum("size").over(Window.partitionBy("range", "source").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1))
    placed = ranged.withColumn("inside", F.coalesce(running, F.lit(0))).join(offsets, F.expr("range = r and source <=> s"))
    budget = F.least(F.round("target"), F.lit(float(ceiling)) * F.col("source_size")).cast("long")
    epochs = F.when(F.col("source_size") > 0, F.expr("budget div source_size")).otherwise(0)
    rest = F.col("budget") - F.col("epochs") * F.col("source_size")
    last = F.least(F.col("size"), F.greatest(F.lit(0), rest - F.col("before") - F.col("inside")))
    return (
        placed.withColumn("budget", budget).withColumn("epochs", epochs.cast("long"))
        .select("doc_id", "source", "size", "source_size", "target", (F.col("epochs") * F.col("size") + last).cast("long").alias("taken"))
    )
