"""Exact top-k search.

A ``Corpus`` is a pinned set of live documents (doc_id, block, w0.. or words, weight), their tags and the
width. ``Search`` filters, projects three integers, orders by (key desc, doc_id) and takes k, which
Catalyst plans as TakeOrderedAndProject: each task keeps k rows. All paths and kernels give the same hits.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..errors import BinarySearchOnResidualIndex, InvalidArgument
from ..functions import codes, metrics
from . import filters

PATHS = ("auto", "gather", "dense", "inverted")
KERNELS = ("columnar", "hof", "relational")
HIT = "rank int, doc_id long, inter int, weight int, num long, den long, square_root boolean, score double"
#: Queries of one block of a batch search; larger sets run block by block.
QUERY_BLOCK = 1024


@dataclass(frozen=True)
class Corpus:
    docs: DataFrame
    attrs: DataFrame | None
    dims: int
    stats: DataFrame | None = None
    residual: bool = False
    version: int = 0
    postings: DataFrame | None = None

    @property
    def spark(self) -> SparkSession:
        return self.docs.sparkSession

    def admitted(self, f: filters.Filter) -> DataFrame:
        return filters.admitted(self.docs, self.attrs, f)

    def count(self, f: filters.Filter | None = None) -> DataFrame:
        """One row, n: admitted documents. Allowed on every kind of index."""
        return self.admitted(f or filters.All()).agg(F.count("*").alias("n"))

    def search(self, code: Sequence[int] = (), **options) -> Search:
        return Search(self, tuple(code), **options)


@dataclass(frozen=True)
class Search:
    """``code``: dense words; ``sparse()`` takes positions. Without a code the query is empty (m = 0)."""

    corpus: Corpus
    code: tuple[int, ...] = ()
    metric: str = "hamming"
    k: int = 10
    filter: filters.Filter = filters.All()
    path: str = "auto"
    kernel: str = "columnar"
    prune: bool = False

    def __post_init__(self) -> None:
        metrics.check_metric(self.metric)
        filters.terms(self.filter)
        if self.path not in PATHS or self.kernel not in KERNELS:
            raise InvalidArgument(f"path {self.path!r}, kernel {self.kernel!r}")
        if self.k < 0:
            raise InvalidArgument("k is negative")

    def sparse(self, positions: Sequence[int]) -> Search:
        return replace(self, code=tuple(codes.to_words(codes.ascending(positions), self.corpus.dims)))

    @cached_property
    def query(self) -> list[int]:
        return codes.masked(self.code, self.corpus.dims)

    @cached_property
    def m(self) -> int:
        return codes.popcount(self.query)

    # -- scored rows -----------------------------------------------------------

    def _admitted(self) -> DataFrame:
        docs = self.corpus.docs
        if self.path == "gather" and not isinstance(self.filter, filters.All):
            ids = filters.admitted(docs.select("doc_id", "weight"), self.corpus.attrs, self.filter).select("doc_id")
            return docs.join(ids, "doc_id", "left_semi")
        return filters.admitted(docs, self.corpus.attrs, self.filter)

    def _intersected(self, docs: DataFrame) -> DataFrame:
        """doc_id, weight, inter."""
        if self.path == "inverted" and self.corpus.postings is not None:
            return self._posted(docs)
        if self.path == "inverted" or self.kernel == "relational":
            return _relational(docs, codes.to_positions(self.query, self.corpus.dims), self.corpus.dims)
        if self.kernel == "hof":
            words = F.col("words") if codes.is_wide(docs) else F.array(*codes.word_columns(docs))
            inter = codes.intersect_arrays(words, F.array(*[F.lit(codes.signed(w)) for w in self.query]))
        else:
            inter = codes.intersect_columns(docs, self.query)
        return docs.select("doc_id", "weight", inter.alias("inter"))

    def _score(self, rows: DataFrame) -> DataFrame:
        num, den = metrics.num_den(self.metric, F.col("inter"), F.col("weight"), self.m)
        return rows.withColumns({"num": num, "den": den}).withColumn("_key", metrics.key(F.col("num"), F.col("den")))

    def scored(self) -> DataFrame:
        """Every admitted document with its exact score, unordered."""
        if self.corpus.residual:
            raise BinarySearchOnResidualIndex("this index holds residual codes")
        return self._score(self._intersected(self._admitted()))

    def _top(self, rows: DataFrame) -> DataFrame:
        return rows.orderBy(F.col("_key").desc(), "doc_id").limit(self.k)

    def _posted(self, docs: DataFrame) -> DataFrame:
        """From stored postings: only the lists of the query's bits are read, no code is."""
        dims = codes.to_positions(self.query, self.corpus.dims)
        lists = self.corpus.postings.where(F.col("dim").isin(dims))
        if not isinstance(self.filter, filters.All):
            lists = lists.join(docs.select("doc_id"), "doc_id", "left_semi")
        counts = lists.groupBy("doc_id", "weight").agg(F.count("*").cast("int").alias("inter"))
        # a document without a common bit scores 0, but for Hamming; k others are enough then
        if self.metric != "hamming" and counts.limit(self.k).count() == self.k:
            return counts.select("doc_id", "weight", "inter")
        rest = docs.select("doc_id", "weight").join(counts.select("doc_id", "inter"), "doc_id", "left")
        return rest.withColumn("inter", F.coalesce("inter", F.lit(0)))

    def planned(self) -> tuple[str, str]:
        """(path, reason), without a job. ``auto`` gathers where the filter's own ids are few for a block of documents (they are pushed into the scan),
        else reads postings where they are stored and few of them are asked for, else scans."""
        if self.path != "auto":
            return self.path, "forced"
        most = filters.at_most(self.filter)
        if most is not None and most * codes.crossover(self.m, self.corpus.dims) <= 1 << codes.BLOCK_BITS:
            return "gather", f"the filter admits at most {most}"
        if self.corpus.postings is not None and self.metric != "hamming" and 4 * self.m <= self.corpus.dims:
            return "inverted", "few of the stored lists are asked for"
        return "dense", "columnar scan"

    def threshold(self) -> metrics.Score | None:
        """The k-th best score among some admitted documents: a lower bound of the k-th best of all.

        With block statistics the documents are those of the blocks whose weights promise most, else the k with the largest intersections.
        """
        rows = self._admitted()
        first = self._promising()
        if first:
            got = self._seeds(self._score(self._intersected(rows.where(F.col("block").isin(first)))).orderBy(F.col("_key").desc(), "doc_id"))
            if got:
                return got
        return self._seeds(self._score(self._intersected(rows)).orderBy(F.col("inter").desc(), "doc_id"))

    def _seeds(self, best: DataFrame) -> metrics.Score | None:
        got = [metrics.score(self.metric, r.inter, r.weight, self.m) for r in best.select("inter", "weight").limit(self.k).collect()]
        return min(got, key=lambda s: s.key) if self.k and len(got) == self.k else None

    def _block_best(self) -> DataFrame:
        """(block, n, num, den): no document of the block scores more, by its range of weights."""
        m, lo, hi = F.lit(self.m).cast("long"), F.col("w_min").cast("long"), F.col("w_max").cast("long")
        nearest = F.least(hi, F.greatest(lo, m))  # the weight of the range that is nearest to the query's
        num, den = metrics.num_den(self.metric, F.least(m, hi if self.metric == "dot" else nearest), nearest, self.m)
        return self.corpus.stats.select("block", "n", num.alias("num"), den.alias("den"))

    def _promising(self) -> list[int]:
        """Blocks that together have k documents, best first."""
        if self.corpus.stats is None or not self.k:
            return []
        found, left = [], self.k
        for r in self._block_best().orderBy(metrics.key(F.col("num"), F.col("den")).desc(), "block").limit(self.k).collect():
            found.append(r.block)
            left -= r.n
            if left <= 0:
                return found
        return []

    @cached_property
    def _floor(self) -> metrics.Score | None:
        return self.threshold() if self.prune else None

    def _candidates(self) -> DataFrame:
        """The admitted documents whose weight, and whose block, can be among the best k; without ``prune`` all."""
        rows, tau = self._admitted(), self._floor
        if tau is None:
            return rows
        span = metrics.weight_range(self.metric, tau, self.m)
        if span:  # literals, so Parquet skips row groups of weight-sorted files
            rows = rows.where(F.col("weight").between(*span))
        if self.corpus.stats is not None:
            rows = rows.join(self._block_best().where(_below(tau)).select("block"), "block", "left_anti")
        return rows

    def _reaching(self, rows: DataFrame) -> DataFrame:
        """Rows whose intersection reaches the floor by the bound of their block's least weight (0 where it is unknown)."""
        tau = self._floor
        if tau is None:
            return rows
        rows = rows.withColumn("block", codes.block_of(F.col("doc_id")))
        if self.corpus.stats is not None:
            rows = rows.join(self.corpus.stats.select("block", F.col("w_min").alias("_w_min")), "block", "left")
        else:
            rows = rows.withColumn("_w_min", F.lit(0))
        num, den = metrics.bound_columns(self.metric, F.col("inter"), self.m, F.coalesce("_w_min", F.lit(0)))
        return rows.withColumns({"num": num, "den": den}).where(~_below(tau)).select("doc_id", "weight", "inter")

    def frame(self) -> DataFrame:
        """The hits in rank order (``HIT``)."""
        if self.corpus.residual:
            raise BinarySearchOnResidualIndex("this index holds residual codes")
        if self.path == "auto" and self.planned()[0] == "inverted":
            return replace(self, path="inverted").frame()
        return hits(self._top(self._score(self._reaching(self._intersected(self._candidates())))), self.metric)

    # -- reports ---------------------------------------------------------------

    def scan_stats(self) -> DataFrame:
        """One row: documents that are scored and ranked, blocks that are read, other live blocks (nothing admitted, or pruned), resumes and versions of the pinned answer."""
        rows = self._candidates()
        scored = self._reaching(self._intersected(rows)).agg(F.count("*").alias("scored")) if self._floor else rows.agg(F.count("*").alias("scored"))
        rows = rows.agg(F.count_distinct(codes.block_of(F.col("doc_id"))).alias("blocks_visited")).crossJoin(scored)  # one row each
        live = self.corpus.docs.agg(F.count_distinct(codes.block_of(F.col("doc_id"))).alias("blocks"))
        return rows.crossJoin(live).select(  # one row each
            "scored",
            "blocks_visited",
            (F.col("blocks") - F.col("blocks_visited")).alias("blocks_skipped"),
            F.lit(0).cast("long").alias("resumes"),  # a pinned version isn't evicted under the scan
            F.lit(self.corpus.version).cast("long").alias("version_lo"),
            F.lit(self.corpus.version).cast("long").alias("version_hi"),
        )


def _below(tau: metrics.Score) -> Column:
    """num / den < tau, in exact integers."""
    return F.col("num").cast("decimal(38,0)") * F.lit(tau.den) < F.col("den").cast("decimal(38,0)") * F.lit(tau.num)


def _relational(docs: DataFrame, positions: list[int], dims: int) -> DataFrame:
    """Postings of the query's bits, counted by document; documents without one come back with 0."""
    wanted = F.array(*[F.lit(p) for p in positions]).cast("array<int>") if positions else F.array().cast("array<int>")
    lists = docs.select("doc_id", codes.positions_of(docs, dims).alias("p"))
    query = lists.sparkSession.createDataFrame([(p,) for p in positions], "dim int")  # at most `dims` rows
    postings = lists.select("doc_id", F.explode(F.array_intersect("p", wanted) if len(positions) <= 64 else F.col("p")).alias("dim"))
    counts = postings.join(F.broadcast(query), "dim").groupBy("doc_id").agg(F.count("*").alias("inter"))
    return docs.select("doc_id", "weight").join(counts, "doc_id", "left").withColumn("inter", F.coalesce("inter", F.lit(0)).cast("int"))


def hits(top: DataFrame, metric: str) -> DataFrame:
    rank = F.row_number().over(Window.orderBy(F.col("_key").desc(), "doc_id"))  # k rows
    return top.select(
        rank.alias("rank"),
        "doc_id",
        F.col("inter").cast("int").alias("inter"),
        F.col("weight").cast("int").alias("weight"),
        "num",
        "den",
        F.lit(metric == "cosine").alias("square_root"),
        metrics.shown(metric, F.col("num"), F.col("den")).alias("score"),
    )


# -- batches -------------------------------------------------------------------


def _packed(docs: DataFrame) -> tuple[DataFrame, int]:
    cols = ["words"] if codes.is_wide(docs) else codes.word_columns(docs)
    return docs.select("doc_id", "weight", *cols), len(cols)


def search_batch(corpus: Corpus, queries: DataFrame, metric: str = "hamming", k: int = 10, f: filters.Filter | None = None, block: int = QUERY_BLOCK) -> DataFrame:
    """query_id and the columns of a hit for each query (query_id, words ARRAY<BIGINT>).

    Queries are broadcast in blocks of a counted size. Each task scores its documents against the block
    with array popcounts and keeps k candidates a query, so the shuffle carries k rows a query and task,
    never query x document pairs. Ranks are formed within a query only.
    """
    metrics.check_metric(metric)
    rows, _ = _packed(corpus.admitted(f or filters.All()))
    n = queries.count()
    parts = max(1, -(-n // block))
    out = None
    for part in range(parts):
        mine = queries if parts == 1 else queries.where(F.pmod(F.xxhash64("query_id"), F.lit(parts)) == part)
        got = [(r.query_id, codes.masked(r.words, corpus.dims)) for r in mine.select("query_id", "words").collect()]
        found = _block(rows, got, metric, k, corpus.dims)
        out = found if out is None else out.union(found)
    best = Window.partitionBy("query_id").orderBy(F.col("_key").desc(), "doc_id")
    ranked = out.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "doc_id", "inter", "weight", "num", "den", F.lit(metric == "cosine").alias("square_root"), metrics.shown(metric, F.col("num"), F.col("den")).alias("score"))


def _block(rows: DataFrame, queries: list[tuple[int, list[int]]], metric: str, k: int, dims: int) -> DataFrame:
    sent = rows.sparkSession.sparkContext.broadcast(queries)
    wide = codes.is_wide(rows)

    def run(batches):
        got = sent.value
        qw = np.array([w for _, w in got], np.uint64).reshape(len(got), codes.words_for(dims))
        m = np.bitwise_count(qw).sum(1, dtype=np.int64)
        used = [np.flatnonzero(q) for q in qw]
        keep: list[tuple] = [()] * len(got)
        floor = [None] * len(got)  # the k-th best key so far
        for batch in batches:
            doc, w = batch.column(0).to_numpy(), batch.column(1).to_numpy().astype(np.int32)
            if wide:
                x = np.ascontiguousarray(batch.column(2).flatten().to_numpy().view(np.uint64).reshape(batch.num_rows, -1).T)
            else:
                x = [c.to_numpy().view(np.uint64) for c in batch.columns[2:]]
            for q in range(len(got)):
                a = np.zeros(len(doc), np.int32)
                for j in used[q]:
                    a += np.bitwise_count(x[j] & qw[q, j])
                key = _keys(metric, a, w, int(m[q]))
                if floor[q] is not None:
                    cut = np.flatnonzero(key >= floor[q])
                elif len(key) > k > 0:  # all ties of the k-th stay
                    cut = np.flatnonzero(key >= np.partition(key, len(key) - k)[len(key) - k])
                else:
                    cut = np.arange(len(key))
                if not len(cut):
                    continue
                now = [z[cut] for z in (key, doc, a, w)]
                if keep[q]:
                    now = [np.concatenate(z) for z in zip(keep[q], now, strict=True)]
                order = np.lexsort((now[1], -now[0]))[:k]
                keep[q] = tuple(z[order] for z in now)
                if len(order) == k > 0:
                    floor[q] = keep[q][0][-1]
        for q, z in enumerate(keep):
            if z and len(z[0]):
                a, w = z[2].astype(np.int64), z[3].astype(np.int64)
                num, den = _numbers(metric, a, w, m[q])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(a), got[q][0], np.int64)), pa.array(num / den), pa.array(z[1]), pa.array(z[2]), pa.array(z[3]), pa.array(num), pa.array(den)],
                    names=["query_id", "_key", "doc_id", "inter", "weight", "num", "den"],
                )

    return rows.mapInArrow(run, "query_id long, _key double, doc_id long, inter int, weight int, num long, den long")


def _keys(metric: str, a: np.ndarray, w: np.ndarray, m: int) -> np.ndarray:
    """What orders like num / den, for int32 intersections and weights: integers, or the quotient itself."""
    if metric == "dot":
        return a
    if metric == "hamming":
        return 2 * a - w
    num, den = (a, m + w - a) if metric == "jaccard" else (a.astype(np.int64) ** 2, m * w.astype(np.int64))
    return np.where(den == 0, 0.0, num / np.where(den == 0, 1, den))


def _numbers(metric: str, a: np.ndarray, w: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray]:
    one = np.ones_like(a)
    if metric == "dot":
        return a, one
    if metric == "hamming":
        return 2 * a - m - w, one
    num, den = (a, m + w - a) if metric == "jaccard" else (a * a, m * w)
    none = den == 0
    return np.where(none, 0, num), np.where(none, 1, den)


def row_search(rows: DataFrame, scorer: Column, k: int = 10) -> DataFrame:
    """(rank, doc_id, score long): top-k by any integer scorer over a row, larger first, ids ascending on ties."""
    top = rows.select("doc_id", scorer.cast("long").alias("score")).orderBy(F.col("score").desc(), "doc_id").limit(k)
    return top.select(F.row_number().over(Window.orderBy(F.col("score").desc(), "doc_id")).alias("rank"), "doc_id", "score")
