"""Mixing sources to target weights by weighted fair queueing.

Every document has a size in words. A source's share follows its weight: by code point of the
name, null last, weights run 3, 1, 2 and repeat. All shares together are ``budget`` times all
sizes; a source's target stops at ``most`` times its own size and what it can't take is shared
among the others by weight until none is above (the level at which that holds is found in one
pass over the sources sorted by size over weight).

A source sends its documents in a shuffled order (by a hash of the doc_id), as often as needed. What it sends are packets: a copy of a
document, or, for the copy during which the source reaches its target, the words up to the target and those after it. A packet's virtual
start and finish times are the source's words before and after it, divided by the source's target. ``queue_end`` sorts the packets of all
sources by finish time, sums their words in that order and truncates the queue at the total budget, the sum of the targets (rounded down);
``taken`` and ``emit`` are what stands before that end. The queue is fair: when the budget is spent every source has sent its target.

Scale: the cumulative words of a source come from two levels, sums by (source, hash bucket) and a
window inside each bucket, so a hot source is spread over all tasks; the table of buckets has at most
``buckets`` rows a source. The merged queue is summed by slots of equal virtual time (sources send at even rates in it, so slots are about equal), the slot
in which the budget ends by slots again, and only what is in the last one, 1 in ``SLOTS``**2 of the queue, is sorted. Sizes and schedule (no texts) are
tables in the shared folder; texts are read once for their sizes and once where they are sent. Sources (not documents) are sorted in
one task that may spill.

Edge cases: a null or blank text has size 0 and takes 0; a very long text is a packet like others; a null source is a source of its own, after
all others. Repeated rows are documents of their own (ties go by hash, doc_id, size and take equal
turns); packets of one finish time go by source, turn, hash and doc_id, so reruns agree. If all sizes are 0, targets are 0. Empty in, empty out. Extra columns pass
through ``schedule``; its own are prefixed ``_mx_``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import text_of, written

WORD = "[^\\x20\\x09-\\x0D]+"


def sources(sized: DataFrame, budget: float, most: float, weights: tuple[int, ...]) -> DataFrame:
    """(_mx_s, _mx_source_size, _mx_target) of each source."""
    by_name = Window.orderBy(F.col("_mx_s").asc_nulls_last())
    by_ratio = Window.orderBy(F.col("_mx_ratio"), F.col("_mx_s").asc_nulls_last())
    upto, rest = by_ratio.rowsBetween(Window.unboundedPreceding, -1), by_ratio.rowsBetween(0, Window.unboundedFollowing)
    whole = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.row_number().over(by_name) - 1) % len(weights) + 1)
    t = sized.groupBy("_mx_s").agg(F.sum("_mx_size").alias("_mx_source_size"))
    t = t.withColumn("_mx_w", w).withColumn("_mx_cap", F.col("_mx_source_size") * F.lit(float(most)))
    t = t.withColumn("_mx_ratio", F.col("_mx_cap") / F.col("_mx_w"))
    t = t.withColumn("_mx_all", F.sum("_mx_source_size").over(whole) * F.lit(float(budget)))
    level = (F.col("_mx_all") - F.coalesce(F.sum("_mx_cap").over(upto), F.lit(0.0))) / F.sum("_mx_w").over(rest)
    t = t.withColumn("_mx_level", F.when(level <= F.col("_mx_ratio"), level))
    t = t.withColumn("_mx_level", F.coalesce(F.first("_mx_level", ignorenulls=True).over(by_ratio.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)), F.max("_mx_ratio").over(whole)))
    return t.select("_mx_s", "_mx_source_size", F.least(F.col("_mx_cap"), F.col("_mx_level") * F.col("_mx_w")).alias("_mx_target"))


def _sized(docs: DataFrame, id_col: str, text_col: str, source_col: str, buckets: int, seed: str) -> DataFrame:
    order = F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.coalesce(F.col(source_col), F.lit(""))))
    size = F.regexp_count(text_of(text_col), F.lit(WORD)).cast("long")
    return docs.withColumns({"_mx_size": size, "_mx_s": F.col(source_col), "_mx_h": order}).withColumn("_mx_b", F.conv(F.substring("_mx_h", 1, 8), 16, 10).cast("long") % buckets)


def _offsets(sized: DataFrame, budget: float, most: float, weights: tuple[int, ...]) -> DataFrame:
    """Words of its source before each (source, bucket), and the source's size and target."""
    per_bucket = sized.groupBy("_mx_s", "_mx_b").agg(F.sum("_mx_size").alias("_mx_size"))
    before = Window.partitionBy("_mx_s").orderBy("_mx_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_bucket.select(F.col("_mx_s").alias("_mx_os"), F.col("_mx_b").alias("_mx_ob"), F.coalesce(F.sum("_mx_size").over(before), F.lit(0)).alias("_mx_off"))
    table = sources(per_bucket, budget, most, weights).withColumnRenamed("_mx_s", "_mx_ts")
    return offsets.join(table, F.col("_mx_os").eqNullSafe(F.col("_mx_ts"))).drop("_mx_ts")


def _placed(sized: DataFrame, offsets: DataFrame, id_col: str) -> DataFrame:
    # the bucket's sums travel with the rows of the bucket; both sides have the same keys
    met = sized.join(offsets, F.col("_mx_s").eqNullSafe(F.col("_mx_os")) & (F.col("_mx_b") == F.col("_mx_ob")))
    inside = Window.partitionBy("_mx_s", "_mx_b").orderBy("_mx_h", id_col, "_mx_size").rowsBetween(Window.unboundedPreceding, -1)
    return met.withColumn("_mx_start", F.col("_mx_off") + F.coalesce(F.sum("_mx_size").over(inside), F.lit(0))).drop("_mx_b", "_mx_os", "_mx_ob", "_mx_off")


def _schedules(docs: DataFrame, id_col: str, text_col: str, source_col: str, budget: float, most: float, weights: tuple[int, ...], buckets: int, seed: str) -> tuple[DataFrame, DataFrame]:
    """The schedule without texts, and the offsets that it was made with."""
    names = list(dict.fromkeys((id_col, source_col)))
    sizes = written(_sized(docs.select(*dict.fromkeys((*names, text_col))), id_col, text_col, source_col, buckets, seed).select(*names, "_mx_size", "_mx_s", "_mx_h", "_mx_b"), "sizes")
    offsets = written(_offsets(sizes, budget, most, weights), "offsets")
    return written(_placed(sizes, offsets, id_col), "schedule"), offsets


def schedule(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", budget: float = 1.5, most: float = 2.0, weights: tuple[int, ...] = (3, 1, 2), buckets: int = 4096, seed: str = "mix") -> DataFrame:
    """``docs`` with _mx_size, _mx_source_size, _mx_target, _mx_start (words of its source before it), _mx_s (source) and _mx_h (order)."""
    sized = _sized(docs, id_col, text_col, source_col, buckets, seed)
    return _placed(sized, _offsets(sized, budget, most, weights), id_col)


#: Slots of a unit of virtual time by which the merged queue is summed.
SLOTS = 4096


def _packets(most: float) -> Column:
    """array<struct<turn, words, finish>> of a scheduled document: its copies, the one on its way at the target in two parts."""
    goal, size, zero = F.floor("_mx_target"), F.col("_mx_size"), F.lit(0)
    parts = []
    for turn in range(int(-(-most // 1))):
        at = F.col("_mx_start") + F.lit(turn) * F.col("_mx_source_size")
        first = F.least(size, F.greatest(zero, goal - at))
        for words, upto in ((first, at + first), (size - first, at + size)):
            # a source that has sent its target, but for a fraction of a word, is at time 1
            finish = F.when(upto == goal, F.lit(1.0)).otherwise(upto / F.nullif(F.col("_mx_target"), F.lit(0.0)))
            parts.append(F.struct(F.lit(turn).alias("turn"), words.cast("long").alias("words"), finish.alias("finish")))
    return F.filter(F.array(*parts), lambda x: x["words"] > 0)


def queue_end(scheduled: DataFrame, most: float = 2.0) -> float:
    """The finish time of the first packet of the merged queue that goes over the total budget (infinite if none does)."""
    goals = scheduled.groupBy("_mx_s").agg(F.floor(F.max("_mx_target")).alias("goal"))
    budget = int(goals.agg(F.sum("goal").cast("long")).first()[0] or 0)
    queue = scheduled.select(F.inline(_packets(most)))
    time = F.col("finish") * SLOTS
    # all that finishes after time 2 is one slot: every source has sent twice its target there
    slots = [F.least(F.lit(2 * SLOTS), F.floor(time)).cast("long"), F.floor((time - F.floor(time)) * SLOTS).cast("long"), F.col("finish")]
    before = 0
    for slot in slots:
        sums = queue.groupBy(slot.alias("slot")).agg(F.sum("words").alias("words"))
        upto = F.sum("words").over(Window.orderBy("slot").rowsBetween(Window.unboundedPreceding, 0)) + F.lit(before)
        over = sums.select("slot", "words", upto.alias("upto")).where(F.col("upto") > budget).agg(F.min(F.struct("slot", (F.col("upto") - F.col("words")).alias("before"))).alias("r")).first().r
        if over is None:
            return float("inf")
        queue, before = queue.where(slot == over.slot), over.before
    return float(over.slot)


def taken(most: float, end: float) -> Column:
    """Words of a scheduled document that the mix takes, its copies together."""
    sent = F.filter(_packets(most), lambda x: x["finish"] < F.lit(end))
    return F.aggregate(sent, F.lit(0).cast("long"), lambda a, x: a + x["words"])


def emit(scheduled: DataFrame, most: float = 2.0, end: float | None = None) -> DataFrame:
    """A row for each copy that the mix sends: _mx_turn, _mx_words and _mx_finish, range-sorted by the finish time."""
    end = queue_end(scheduled, most) if end is None else end
    cols = [c for c in scheduled.columns if c not in ("_mx_s", "_mx_h")]
    sent = scheduled.select("*", F.explode(F.filter(_packets(most), lambda x: x["finish"] < F.lit(end))).alias("_mx_p"))
    keys = ["_mx_p.finish", "_mx_s", "_mx_p.turn", "_mx_h"]
    return sent.orderBy(*keys).select(*cols, F.col("_mx_p.turn").alias("_mx_turn"), F.col("_mx_p.words").alias("_mx_words"), F.col("_mx_p.finish").alias("_mx_finish"))


_DEFAULT = {"id_col": "doc_id", "text_col": "text", "source_col": "source", "budget": 1.5, "most": 2.0, "weights": (3, 1, 2), "buckets": 4096, "seed": "mix"}


def digest(docs: DataFrame) -> DataFrame:
    """One row a document: doc_id, size, source_size, target, taken."""
    scheduled, _ = _schedules(docs, **_DEFAULT)
    return scheduled.select(
        "doc_id",
        F.col("_mx_size").alias("size"),
        F.col("_mx_source_size").alias("source_size"),
        F.col("_mx_target").alias("target"),
        taken(2.0, queue_end(scheduled)).alias("taken"),
    )


def stage(docs: DataFrame) -> DataFrame:
    """Pipeline form, the last stage: the mix in its order. A row for each copy sent, the columns of
    ``docs`` and turn int, words long (fewer than the text's at the end of a source's turn), finish double."""
    narrow, offsets = _schedules(docs, **_DEFAULT)
    whole = _placed(_sized(docs, "doc_id", "text", "source", 4096, "mix"), offsets, "doc_id")
    return emit(whole, end=queue_end(narrow)).select(
        *docs.columns, F.col("_mx_turn").alias("turn"), F.col("_mx_words").alias("words"), F.col("_mx_finish").alias("finish")
    )


SQL = r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         md5('mix:' || coalesce(doc_id::VARCHAR, '') || ':' || coalesce(source, '')) AS h
  FROM documents
), src AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source
), w AS (
  SELECT *, list_extract([3.0, 1.0, 2.0]::DOUBLE[], (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1) AS w, source_size * 2.0::DOUBLE AS cap,
         sum(source_size) OVER () * 1.5::DOUBLE AS total FROM src
), r AS (
  SELECT *, (total - coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE))
         / sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w
), t AS (
  SELECT source, source_size, least(cap, w * coalesce((SELECT min_by(level, cap / w) FROM r WHERE level <= cap / w), (SELECT max(cap / w) FROM r))) AS target FROM r
), s AS (
  SELECT z.doc_id, z.size, t.source_size, t.target,
         coalesce(sum(z.size) OVER (PARTITION BY z.source ORDER BY (('0x' || substr(h, 1, 8))::BIGINT % 4096), h, z.doc_id, z.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM sized z JOIN t ON z.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
       (greatest(0, least(size, floor(target)::BIGINT - start)) + greatest(0, least(size, floor(target)::BIGINT - start - source_size)))::BIGINT AS taken
FROM s
"""
