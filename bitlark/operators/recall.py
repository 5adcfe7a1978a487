"""Recall against exact float cosine, and similarities around the cut."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .search import QUERY_BLOCK


def float_truth(vectors: DataFrame, queries: DataFrame, k: int, block: int = QUERY_BLOCK) -> DataFrame:
    """(query_id, rank, doc_id, sim double): exact cosine top-k of each query by float64, ids ascending on ties.

    ``vectors`` (doc_id, embedding), ``queries`` (query_id, embedding). Queries are broadcast in blocks of a counted size;
    a task sends its k best of a query, whatever the number of its Arrow batches.
    """
    rows = vectors.select("doc_id", "embedding")
    parts = max(1, -(-queries.count() // block))
    found = None
    for part in range(parts):
        mine = queries if parts == 1 else queries.where(F.pmod(F.xxhash64("query_id"), F.lit(parts)) == part)
        some = _nearest(rows, [(r.query_id, r.embedding) for r in mine.select("query_id", "embedding").collect()], k)
        found = some if found is None else found.union(some)
    best = Window.partitionBy("query_id").orderBy(F.col("sim").desc(), "doc_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "doc_id", "sim")


def _nearest(rows: DataFrame, queries: list[tuple[int, list[float]]], k: int) -> DataFrame:
    """The k best documents of each query in each task."""
    sent = rows.sparkSession.sparkContext.broadcast(queries)

    def run(batches):
        q = np.array([e for _, e in sent.value], np.float64)
        if len(q):
            q /= np.linalg.norm(q, axis=1, keepdims=True)
        kept = [(np.zeros(0, np.int64), np.zeros(0)) for _ in sent.value]
        for batch in batches:
            if not len(batch):
                continue
            doc = batch.column(0).to_numpy()
            x = batch.column(1).flatten().to_numpy().astype(np.float64).reshape(len(doc), -1)
            size = np.sqrt((x * x).sum(1))
            for i, (ids, sims) in enumerate(kept):
                # one summation order for every row, whatever batch it is in
                ids, sims = np.append(ids, doc), np.append(sims, (x * q[i]).sum(1) / size)
                cut = np.lexsort((ids, -sims))[:k]
                kept[i] = ids[cut], sims[cut]
        for (qid, _), (ids, sims) in zip(sent.value, kept, strict=True):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), qid, np.int64)), pa.array(ids), pa.array(sims)], names=["query_id", "doc_id", "sim"])

    return rows.mapInArrow(run, "query_id long, doc_id long, sim double")


def recall_at_k(found: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    """(query_id, found long, recall double): share of the true top-k ids among the hits."""
    met = truth.where(F.col("rank") <= k).join(found.where(F.col("rank") <= k).select("query_id", "doc_id", F.lit(1).alias("hit")), ["query_id", "doc_id"], "left")
    return met.groupBy("query_id").agg(F.count("hit").alias("found"), (F.count("hit") / F.count("*")).alias("recall"))


def rank_boundary(truth: DataFrame, k: int) -> DataFrame:
    """(query_id, at_1, at_k, at_k1, at_10k): similarities at ranks 1, k, k + 1 and 10 k."""
    at = lambda r, name: F.max(F.when(F.col("rank") == r, F.col("sim"))).alias(name)
    return truth.groupBy("query_id").agg(at(1, "at_1"), at(k, "at_k"), at(k + 1, "at_k1"), at(10 * k, "at_10k"))
