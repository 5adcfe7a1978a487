"""Compaction: dense new ids by (weight descending, old id ascending).

The rank is a two-level prefix sum: counts by (weight, block of old ids) give offsets, a window inside one
block and weight (65,536 rows at most) gives the place. No task sorts the whole corpus.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..errors import CorruptMeta
from ..functions.codes import block_of


def remap(docs: DataFrame) -> DataFrame:
    """(new_id, old_id) of live documents with doc_id and weight."""
    rows = docs.select(F.col("doc_id").alias("old_id"), "weight", block_of(F.col("doc_id")).alias("_b"))
    counts = rows.groupBy("weight", "_b").agg(F.count("*").alias("n"))
    per_weight = counts.groupBy("weight").agg(F.sum("n").alias("n"))  # at most 65,537 rows
    heavier = Window.orderBy(F.col("weight").desc()).rowsBetween(Window.unboundedPreceding, -1)
    base = per_weight.select("weight", F.coalesce(F.sum("n").over(heavier), F.lit(0)).alias("_w0"))
    lower = Window.partitionBy("weight").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("weight", "_b", F.coalesce(F.sum("n").over(lower), F.lit(0)).alias("_b0")).join(base, "weight")
    place = Window.partitionBy("weight", "_b").orderBy("old_id")
    met = rows.join(offsets, ["weight", "_b"])
    new = F.col("_w0") + F.col("_b0") + F.row_number().over(place) - 1
    return met.select(new.cast("long").alias("new_id"), "old_id")


def check_remap(table: DataFrame) -> None:
    """Refuses a map that doesn't cover 0..n-1 once each with distinct old ids."""
    r = table.agg(F.count("*").alias("n"), F.count_distinct("new_id").alias("a"), F.count_distinct("old_id").alias("b"), F.min("new_id").alias("lo"), F.max("new_id").alias("hi")).first()
    if r.n and not (r.n == r.a == r.b and r.lo == 0 and r.hi == r.n - 1):
        raise CorruptMeta("the pending id map has holes or repeats")


def retag(attrs: DataFrame, table: DataFrame) -> DataFrame:
    """Attributes under the new ids; those of ids that no longer live are discarded."""
    return attrs.join(table, attrs.doc_id == table.old_id).select(F.col("new_id").alias("doc_id"), "term")
