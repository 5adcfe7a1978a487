"""MinHash near-dedup with BagMinHash signatures of word-shingle multisets.

Words are runs of ASCII letters and digits and code points from U+0080, A-Z lower-cased. A
document is the multiset of its five-word shingles; one of fewer words, but not none, is one
shingle. Two documents are linked if the weighted Jaccard overlap of their multisets (sum of lesser
counts over sum of greater) is at least ``threshold``; classes are the connected components.

Signature. Weights are counts, discretised at the integers. The weight axis of a shingle is cut at
0, 1, 2, 4, 8, ...; each interval carries a Poisson process seeded by (shingle, interval), whose rate is
the interval's length. An interval that the count cuts is split by halving: a point's coordinate inside it comes
bit by bit from the point's hash, and the point counts if it lies below the count. Each point is dealt to one of 125
components by its hash; a component's signature is its earliest point. Two multisets agree in a component
with probability equal to their weighted Jaccard. Processes run only up to a time by which all components
are filled (continued in the rare case that one isn't), so a document costs its shingles plus
about a thousand points whatever its weights.

Candidates. 25 bands of 5 components: a pair at 0.8 shares a bucket with probability 1 - 5e-5. Inside a
bucket nobody is compared with everybody. All members are verified against the bucket's hub, its member
with most bucket neighbours over all bands (the original of a group of near copies is the one that most of
them share most with), by exact multiset overlap of their whole texts, and components are formed. Only buckets
that still hold several components go on, and their members meet once more, by an exact prefix filter. All occurrences of
shingles (the i-th of a shingle is an element of its own) are ordered by the number of these documents that hold them, rarest first.
Two documents of n and m elements that overlap by 0.8 share one of their first n - ceil(0.8 n) + 1 and
m - ceil(0.8 m) + 1 elements, and after the first one they share enough must follow in both for the overlap (the
positional bound). Documents that share boilerplate only begin with their own, rare elements and meet nobody, so a
bucket of many different texts costs its shingles, not its pairs. Pairs of different components that meet are verified exactly. So
no link inside a bucket is lost, a bucket of thousands of near copies costs one comparison a member, and nothing is capped.

Scale: exact copies (equal word sequences) share one 64-bit node, so thousands of copies are one node
from the start; band rows carry 16 bytes; texts travel for candidates only. Sketches and the edges of each
round are Parquet tables in the shared folder, so a lost executor repeats tasks, not the job. Components
grow by alternating large-star and small-star steps, a logarithmic number of them.

Edge cases: documents without words (null, empty, punctuation) are linked to nothing, class_id is their own
doc_id. Repeated rows are copies; each row gives a row. A null doc_id may be in a class; class_id is the least
non-null doc_id of the class, null if it has none. An empty table gives an empty table. Extra columns are not
read (``stage`` keeps them). Node ids are 64-bit hashes: two different texts share one with probability 5e-20 a pair.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import BASE, MASK64, POWERS, discard, mix, text_slices, words_of, written

SHINGLE = 5
BANDS, ROWS = 25, 5
M = BANDS * ROWS
THRESHOLD = 0.8
_PLACE = np.array([pow(BASE, 3 * i + 1, 1 << 64) for i in range(SHINGLE)], np.uint64)
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def shingles(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, hash) of all shingles of a slice, words of each row, and a hash of each row's word sequence."""
    _, _, words, first = words_of(raw, offsets)
    n = np.diff(first)
    rows = np.repeat(np.arange(len(n)), n)
    up, down = POWERS.at_least(len(words) + 1)
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(words * up[: len(words)], dtype=np.uint64)))
    node = mix((total[first[1:]] - total[first[:-1]]) * down[first[:-1]] + n.astype(np.uint64) * _GOLD)
    if len(words) >= SHINGLE:
        last = len(words) - SHINGLE + 1
        h = np.zeros(last, np.uint64)
        for i in range(SHINGLE):
            h += words[i : i + last] * _PLACE[i]
        whole = rows[:last] == rows[SHINGLE - 1 :]
        out_rows, out = rows[:last][whole], mix(h[whole])
    else:
        out_rows, out = np.zeros(0, np.int64), np.zeros(0, np.uint64)
    short = np.flatnonzero((n > 0) & (n < SHINGLE))
    return np.concatenate((out_rows, short)), np.concatenate((out, mix(node[short] + _GOLD))), n, node


def counted(rows: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (row, hash) and their counts."""
    if not len(h):
        return rows, h, np.zeros(0, np.int64)
    key = h ^ mix(rows.astype(np.uint64) + _GOLD)
    order = np.argsort(key)
    key = key[order]
    new = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    pick = order[new]
    return rows[pick], h[pick], np.diff(np.concatenate((new, [len(key)])))


def _unit(h: np.ndarray) -> np.ndarray:
    return ((h >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def bag_minhash(rows: np.ndarray, h: np.ndarray, count: np.ndarray, n: int, m: int = M) -> np.ndarray:
    """int32 signatures [n, m] of weighted sets; rows without elements are all -1."""
    sig = np.full(n * m, np.inf)
    weight = np.bincount(rows, weights=count, minlength=n)
    # one process for each element and interval [0, 1), [1, 2), [2, 4), ... that its count reaches
    procs = [(rows, mix(h + _GOLD), np.zeros(len(h)), np.ones(len(h)), count)]
    low = 1
    while len(count) and low < count.max():
        reach = count > low
        k = int(reach.sum())
        procs.append((rows[reach], mix(h[reach] + np.uint64(int(_GOLD) * (2 * low + 1) & MASK64)), np.full(k, float(low)), np.full(k, float(low)), count[reach]))
        low *= 2
    prow, seed, lo, rate, top = (np.concatenate(x) for x in zip(*procs, strict=True))
    limit = np.zeros(n)
    some = weight > 0
    limit[some] = m * (math.log(m) + 3) / weight[some]
    time, step = np.zeros(len(prow)), np.zeros(len(prow), np.uint64)
    pending = np.arange(len(prow))
    while len(pending):
        live = pending
        while len(live):
            # `time` and `step` stand before the next point of each process
            step[live] += np.uint64(1)
            a = mix(seed[live] + step[live] * _GOLD)
            t = time[live] - np.log(_unit(a)) / rate[live]
            b = mix(a ^ _GOLD)
            inside = t <= limit[prow[live]]
            step[live[~inside]] -= np.uint64(1)  # comes again if the limit grows
            live, t, b = live[inside], t[inside], b[inside]
            time[live] = t
            coordinate = lo[live] + rate[live] * _unit(mix(b))
            below = coordinate < top[live]
            slot = prow[live[below]] * m + (b[below] >> np.uint64(33)).astype(np.int64) % m
            np.minimum.at(sig, slot, t[below])
        open_ = np.isinf(sig.reshape(n, m)).any(axis=1) & some
        limit[open_] *= 2
        pending = np.flatnonzero(open_[prow])
    out = sig.reshape(n, m).astype(np.float32).view(np.int32)
    out[~some] = -1
    return out


def _sketch(batches):
    for batch in batches:
        nodes, counts, sigs = [], [], []
        for _, _, raw, offsets in text_slices(batch.column(1)):
            rows, h, n, node = shingles(raw, offsets)
            sig = bag_minhash(*counted(rows, h), len(n))
            nodes.append(node.view(np.int64))
            counts.append(np.where(n >= SHINGLE, n - SHINGLE + 1, np.minimum(n, 1)))
            sigs.append(sig)
        if nodes:
            flat = pa.array(np.concatenate(sigs).ravel(), pa.int32())
            sig = pa.FixedSizeListArray.from_arrays(flat, M).cast(pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.concatenate(nodes)), pa.array(np.concatenate(counts).astype(np.int64)), sig], names=["doc_id", "node", "n", "sig"]
            )


def _with_node(batches):
    """(node, text), each node once a task, so a text of many copies is few rows before any shuffle."""
    seen = np.zeros(0, np.int64)
    for batch in batches:
        nodes = [shingle_node(raw, offsets) for _, _, raw, offsets in text_slices(batch.column(0))]
        if nodes:
            node, at = np.unique(np.concatenate(nodes).view(np.int64), return_index=True)
            new = ~np.isin(node, seen)
            seen = np.concatenate((seen, node[new]))
            yield pa.RecordBatch.from_arrays([pa.array(node[new]), batch.column(0).take(pa.array(at[new]))], names=["node", "text"])


def shingle_node(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The hash of each row's word sequence alone."""
    _, _, words, first = words_of(raw, offsets)
    up, down = POWERS.at_least(len(words) + 1)
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(words * up[: len(words)], dtype=np.uint64)))
    return mix((total[first[1:]] - total[first[:-1]]) * down[first[:-1]] + np.diff(first).astype(np.uint64) * _GOLD)


def overlaps(a: pa.Array, b: pa.Array) -> np.ndarray:
    """Exact weighted Jaccard of the shingle multisets of a[i] and b[i]."""
    out = np.zeros(len(a))
    step = 64
    for i in range(0, len(a), step):
        parts = []
        for column in (a.slice(i, step), b.slice(i, step)):
            rows_, hs = [], []
            for at, _, raw, offsets in text_slices(column, 1 << 22):
                rows, h, _, _ = shingles(raw, offsets)
                rows_.append(rows + at)
                hs.append(h)
            parts.append(counted(np.concatenate(rows_), np.concatenate(hs)))
        k = min(step, len(a) - i)
        (ra, ha, ca), (rb, hb, cb) = parts
        rows, h = np.concatenate((ra, rb)), np.concatenate((ha, hb))
        key = h ^ mix(rows.astype(np.uint64) + _GOLD)
        order = np.argsort(key, kind="stable")
        key, rows, c = key[order], rows[order], np.concatenate((ca, cb))[order]
        both = np.flatnonzero(key[1:] == key[:-1])
        common = np.bincount(rows[both], weights=np.minimum(c[both], c[both + 1]), minlength=k)
        whole = np.bincount(ra, weights=ca, minlength=k) + np.bincount(rb, weights=cb, minlength=k) - common
        out[i : i + k] = common / np.maximum(whole, 1)
    return out


def _elements(batches):
    """(node, label, n, els): the elements of a document, a hash of (shingle, occurrence) each."""
    for batch in batches:
        for at, end, raw, offsets in text_slices(batch.column(2)):
            rows, h, c = counted(*shingles(raw, offsets)[:2])
            order = np.argsort(rows, kind="stable")
            rows, h, c = rows[order], h[order], c[order]
            turn = np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c)
            els = mix(np.repeat(h, c) + turn.astype(np.uint64) * _GOLD).view(np.int64)
            n = np.bincount(np.repeat(rows, c), minlength=end - at)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(n))), pa.int32()), pa.array(els))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, end - at), batch.column(1).slice(at, end - at), pa.array(n), lists], names=["node", "label", "n", "els"])


def _verified(pairs: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b) of nodes whose texts really overlap, with the overlap. ``texts`` has a text of each node."""
    met = pairs.join(texts.withColumnsRenamed({"node": "a", "text": "ta"}), "a").join(texts.withColumnsRenamed({"node": "b", "text": "tb"}), "b")

    def run(batches):
        for batch in batches:
            sim = overlaps(batch.column(2), batch.column(3))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sim)], names=["a", "b", "sim"])

    checked = met.select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long, sim double")
    return written(checked.where(F.col("sim") >= threshold), "edges")


def components(edges: DataFrame) -> DataFrame:
    """(node, label): the component's least node, for each node of an edge (columns a, b) but that one."""
    e = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    state = old = None
    while True:
        # large star: each greater neighbour goes to the least of the neighbourhood
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = _plain(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "low")
        large = written(both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large")
        # small star: each lesser neighbour, and the node itself, goes to the least
        least = _plain(large.groupBy("u").agg(F.min("v").alias("m")), "low")
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        e = written(small.where("u <> v").distinct(), "stars")
        for done in (low, large, least, old):
            discard(done)
        old = e
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(now) == state:
            break
        state = tuple(now)
    return _plain(e.groupBy("u").agg(F.min("v").alias("label")).select(F.col("u").alias("node"), "label"), "labels")


def _plain(df: DataFrame, what: str) -> DataFrame:
    """An aggregate as a table: a join of two plain tables may be split where a key is hot, or broadcast if it is measured to be small."""
    return written(df, what)


def _residual(members: DataFrame, labels: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """Pairs of different components, among members of buckets of several, that pass the prefix filter and its positional bound."""
    known = written(members.join(labels, "node", "left").select("key", "node", F.coalesce("label", "node").alias("label")), "known")
    mixed = known.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("top")).where("low <> top").select("key")
    left = _plain(known.join(_plain(mixed, "mixed"), "key").select("node", "label").distinct(), "left")
    bags = written(texts.join(left, "node").select("node", "label", "text").mapInArrow(_elements, "node long, label long, n long, els array<long>"), "bags")
    each = bags.select("node", F.explode("els").alias("el"))
    held = _plain(each.groupBy("el").agg(F.count("*").alias("df")).where("df > 1"), "held")
    # elements that nobody else holds come first in the order and are only counted
    order = each.join(held, "el").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("df", "el"))).alias("order"))
    prefix = F.col("n") - F.ceil(F.lit(threshold) * F.col("n") - 1e-9) + 1
    own = F.col("n") - F.size("order")
    posts = (
        order.join(bags.select("node", "label", "n"), "node")
        .select("node", "label", "n", own.alias("own"), F.slice("order", F.lit(1), F.greatest(prefix - own, F.lit(0)).cast("int")).alias("first"))
        .select("node", "label", "n", "own", F.posexplode("first"))
        # what may still be shared from here on, this element included
        .select(F.col("col.el").alias("el"), "node", "label", "n", (F.col("n") - F.col("own") - F.col("pos")).alias("rest"))
    )
    posts = written(posts, "posts")
    several = posts.groupBy("el").agg(F.min("label").alias("low"), F.max("label").alias("top")).where("low <> top").select("el")
    posts = written(posts.join(_plain(several, "several"), "el"), "posts")
    other = posts.select("el", *(F.col(c).alias(c + "2") for c in ("node", "label", "n", "rest")))
    need = F.ceil(F.lit(threshold / (1 + threshold)) * (F.col("n") + F.col("n2")) - 1e-9)
    met = posts.join(other, "el").where("node > node2 AND label <> label2").where(F.least("rest", "rest2") >= need)
    return met.select(F.col("node").alias("a"), F.col("node2").alias("b")).distinct()


def classes(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, node, class_node, class_id): a row for each row of ``docs``."""
    if threshold != THRESHOLD:
        raise ValueError("the bands are laid out for 0.8")
    docs = docs.select("doc_id", "text")
    id_type = docs.schema["doc_id"].dataType.simpleString()
    sketches = written(docs.mapInArrow(_sketch, f"doc_id {id_type}, node long, n long, sig array<int>"), "sketch")
    some = sketches.where("n > 0")
    keys = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda b: F.xxhash64(b, F.slice("sig", b * ROWS + 1, ROWS)))
    banded = some.select("node", F.explode(keys).alias("key"))
    shared = banded.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("top")).where("low <> top").select("key")
    members = written(banded.join(shared, "key").distinct(), "members")
    sizes = _plain(members.groupBy("key").agg(F.count("*").alias("size")), "sizes")
    degrees = _plain(members.join(sizes, "key").groupBy("node").agg(F.sum("size").alias("degree")), "degrees")  # a row for a bucket, 25 a node at most
    hubs = members.join(degrees, "node").groupBy("key").agg(F.max(F.struct("degree", "node")).alias("h")).select("key", F.col("h.node").alias("hub"))
    pairs = members.join(written(hubs, "hubs"), "key").where("node <> hub").select(F.greatest("node", "hub").alias("a"), F.least("node", "hub").alias("b")).distinct()
    texts = docs.select("text").mapInArrow(_with_node, "node long, text string").join(members.select("node").distinct(), "node", "left_semi")
    texts = written(texts.dropDuplicates(["node"]), "texts")
    first = _verified(pairs, texts, threshold)
    labels = components(first)
    more = written(_residual(members, labels, texts, threshold), "rest")
    second = _verified(more, texts, threshold)
    if not second.isEmpty():
        labels = components(first.select("a", "b").union(second.select("a", "b")))
    rows = sketches.join(labels, "node", "left").select("doc_id", "node", "n", F.coalesce("label", "node").alias("class_node"))
    # written: a join of two plain tables may be split where a class is large
    rows = written(rows, "rows")
    least = written(rows.where("n > 0").groupBy("class_node").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("class_size")), "least")
    return rows.join(least, "class_node", "left").select(
        "doc_id",
        "node",
        "class_node",
        F.when(F.col("n") > 0, F.col("class_id")).otherwise(F.col("doc_id")).alias("class_id"),
        F.when(F.col("n") > 0, F.col("class_size")).otherwise(F.lit(1)).cast("long").alias("class_size"),
        "n",
    )


def digest(docs: DataFrame) -> DataFrame:
    """One row a document: doc_id, class_id, class_size."""
    return classes(docs).select("doc_id", "class_id", "class_size")


def stage(docs: DataFrame) -> DataFrame:
    """Pipeline form: one document of each class stays, the one with the least doc_id; a document without words stays.

    Of rows that repeat the doc_id that stays, one stays (the one with the least node).
    """
    cols, place, schema = docs.columns, docs.columns.index("text"), docs.schema
    best = (
        classes(docs)
        .where("n > 0")
        .groupBy("class_node")
        .agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "node")).alias("b"))
        .select(F.xxhash64("b.doc_id", "b.node").alias("_nd_row"), F.lit(True).alias("_nd_best"))
    )

    def run(batches):
        for batch in batches:
            parts = [(shingle_node(raw, offsets), np.diff(words_of(raw, offsets)[3]) == 0) for _, _, raw, offsets in text_slices(batch.column(place))]
            node = np.concatenate([x[0] for x in parts]).view(np.int64) if parts else np.zeros(0, np.int64)
            none = np.concatenate([x[1] for x in parts]) if parts else np.zeros(0, bool)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(node, mask=none)], names=[*schema.names, "_nd_node"])

    # texts are shuffled once: the join and the window share the key
    marked = docs.mapInArrow(run, T.StructType([*schema.fields, T.StructField("_nd_node", T.LongType())]))
    met = marked.withColumn("_nd_row", F.xxhash64("doc_id", "_nd_node")).join(best, "_nd_row", "left")
    turn = F.row_number().over(Window.partitionBy("_nd_row").orderBy("_nd_row"))
    return met.withColumn("_nd_turn", turn).where("_nd_node IS NULL OR (_nd_best AND _nd_turn = 1)").select(*cols)
