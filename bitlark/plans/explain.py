"""What a search would do: decisions and cheap facts, no cost."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import BinarySearchOnResidualIndex
from ..functions.codes import crossover
from ..operators.search import Search


def accumulator_levels(metric: str, m: int, dims: int) -> int:
    return max(1, 2 * m + dims if metric == "hamming" else m).bit_length()


def explain(search: Search, stats: DataFrame | None = None) -> DataFrame:
    """One row of facts; ``physical`` is Spark's own plan of the search.

    ``block_weight_spread`` is the mean spread of weights within a block, rounded down, ``weight_spread`` the spread over all blocks. Both are
    of the blocks with statistics (null: none has any).
    """
    c = search.corpus
    if c.residual:
        raise BinarySearchOnResidualIndex("this index holds residual codes")
    stats = stats if stats is not None else c.stats
    blocks = c.docs.agg(F.count_distinct(F.shiftright("doc_id", 16)).alias("blocks"))
    if stats is None:
        facts = blocks.withColumns({"blocks_with_stats": F.lit(0).cast("long"), "block_weight_spread": F.lit(None).cast("int"), "weight_spread": F.lit(None).cast("int")})
    else:
        spread = stats.agg(
            F.count("*").alias("blocks_with_stats"),
            F.floor(F.sum(F.col("w_max") - F.col("w_min")) / F.count("*")).cast("int").alias("block_weight_spread"),
            (F.max("w_max") - F.min("w_min")).alias("weight_spread"),
        )
        facts = blocks.crossJoin(spread)  # one row each
    path, reason = search.planned()
    ratio = search.metric in ("jaccard", "cosine")
    return facts.select(
        F.lit("columnar scan" if path == "dense" and search.path == "auto" else path).alias("path"),
        F.lit(reason).alias("path_reason"),
        F.lit(search.kernel).alias("kernel"),
        F.lit(search.metric).alias("metric"),
        F.lit(search.k).alias("k"),
        F.lit(search.m).alias("query_bits"),
        F.lit(c.dims).alias("dims"),
        F.lit(accumulator_levels(search.metric, search.m, c.dims)).alias("accumulator_levels"),
        F.lit(crossover(search.m, c.dims)).alias("crossover"),
        "blocks",
        "blocks_with_stats",
        "block_weight_spread",
        "weight_spread",
        F.lit("ratio key, exact as a double up to 65536 bits" if ratio else "integer key").alias("exactness"),
    )


def physical(search: Search) -> str:
    return search.frame()._jdf.queryExecution().toString()
