"""Quality classifier: attention-based multiple-instance learning over passages.

A document is a bag of passages of ``PASSAGE`` blank-separated tokens each, the last one shorter; all
passages of the whole text are encoded (shares of byte classes, token shape, signed hashed tokens). Only
documents have labels. A hidden layer embeds each passage; gated attention (a tanh branch times a
sigmoid branch) weighs the passages of a bag; the weighted sum is scored by a logistic output. All
weights, attention included, are learned here from document labels by Adam, with fixed seeds.

Learning rows: labelled documents of ``docs`` whose crc32(doc_id as text) mod 4 is not 2. The sample is bounded by ``max_docs`` documents and
``max_passages`` passages together: the documents with the least hash of the doc_id, each with all its passages; one that would go over the
passages that are left is passed over as a whole. That bounds what reaches the driver (376 bytes a passage) at every input size. Ids may be of
any type. Scoring is one pass over all rows and whole texts with no shuffle; the model (tens of kB) is broadcast.

Edge cases: a null or empty text is a bag of one empty passage and gets a score. Without labels every
score is 0.5; with one class only, the smoothed share of label 1. Labels repeated for a doc_id are
averaged; of rows of ``docs`` that repeat a doc_id the least text is learned from, and each gets a score. Null labels and ids are not learned
from; a null doc_id is not held out. An empty table gives an empty table. Very long texts are bags of many passages. Extra columns pass.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import span_hashes, text_of, text_slices, written

PASSAGE = 48
BUCKETS = 64
THRESHOLD = 0.7
_PUNCT = "!|#$%&*.,;:?'\"()-"


def _classes() -> np.ndarray:
    table = np.full(256, 6, np.uint8)  # other ASCII
    for b in range(256):
        c = chr(b)
        if b >= 0x80:
            table[b] = 0
        elif c.islower():
            table[b] = 1
        elif c.isupper():
            table[b] = 2
        elif c.isdigit():
            table[b] = 3
        elif c == "\n":
            table[b] = 4
        elif c in " \t\r\v\f":
            table[b] = 5
        elif c in _PUNCT:
            table[b] = 7 + _PUNCT.index(c)
    return table


CLASS = _classes()
N_CLASS = 7 + len(_PUNCT)
_LOW = np.arange(256, dtype=np.uint8)
_LOW[65:91] += 32
N_FEATURES = N_CLASS + 5 + BUCKETS


def encode(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Passage features (float32) of a slice of texts, and the first passage of each text (n + 1)."""
    n = len(offsets) - 1
    inside = ~np.isin(CLASS[raw], (4, 5))
    edge = np.zeros(len(raw) + 1, bool)
    edge[offsets] = True
    before = np.concatenate(([False], inside[:-1])) if len(raw) else inside
    after = np.concatenate((inside[1:], [False])) if len(raw) else inside
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    first = np.searchsorted(starts, offsets)
    tokens = np.diff(first)
    bags = np.concatenate(([0], np.cumsum(np.maximum(1, -(-tokens // PASSAGE)))))
    total = int(bags[-1])
    doc = np.repeat(np.arange(n), np.diff(bags))
    k = np.arange(total) - bags[doc]
    begin = offsets[doc].copy()
    later = k > 0
    begin[later] = starts[first[doc[later]] + PASSAGE * k[later]]
    sizes = np.diff(np.concatenate((begin, [len(raw)])))
    pid = np.repeat(np.arange(total), sizes)
    hist = np.bincount(pid * N_CLASS + CLASS[raw], minlength=total * N_CLASS).reshape(total, N_CLASS).astype(np.float32)
    tdoc = np.repeat(np.arange(n), tokens)
    tpid = bags[tdoc] + (np.arange(len(starts)) - first[tdoc]) // PASSAGE
    h = span_hashes(_LOW[raw], starts, ends)
    sign = np.where((h >> np.uint64(32)) & np.uint64(1), 1.0, -1.0)
    hashed = np.bincount(tpid * BUCKETS + (h >> np.uint64(58)).astype(np.int64), weights=sign, minlength=total * BUCKETS)
    hashed = hashed.reshape(total, BUCKETS)
    count = np.bincount(tpid, minlength=total).astype(np.float64)
    length = np.bincount(tpid, weights=ends - starts, minlength=total)
    square = np.bincount(tpid, weights=(ends - starts) ** 2.0, minlength=total)
    order = np.lexsort((h, tpid))
    new = np.ones(len(order), bool)
    if len(order) > 1:
        new[1:] = (h[order][1:] != h[order][:-1]) | (tpid[order][1:] != tpid[order][:-1])
    distinct = np.bincount(tpid[order][new], minlength=total)
    some = np.maximum(count, 1)
    mean = length / some
    shape = np.stack(
        [count / PASSAGE, count == 0, distinct / some, mean / 10, np.sqrt(np.maximum(0, square / some - mean**2)) / 10], axis=1
    )
    out = np.concatenate([np.sqrt(hist / np.maximum(1, sizes)[:, None]), shape, hashed / np.sqrt(some)[:, None] / 2], axis=1)
    return out.astype(np.float32), bags


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def forward(p: dict[str, np.ndarray], x: np.ndarray, bags: np.ndarray) -> dict[str, np.ndarray]:
    """Scores of all bags; every bag has a passage. Keeps what learning needs."""
    h = np.tanh(x @ p["w"] + p["wb"])
    v, u = np.tanh(h @ p["v"]), _sigmoid(h @ p["u"])
    e = (v * u) @ p["a"]
    at = bags[:-1]
    rep = np.repeat(np.arange(len(at)), np.diff(bags))
    e = np.exp(e - np.maximum.reduceat(e, at)[rep])
    att = e / np.add.reduceat(e, at)[rep]
    z = np.add.reduceat(h * att[:, None], at, axis=0)
    return {"h": h, "v": v, "u": u, "att": att, "z": z, "rep": rep, "y": _sigmoid(z @ p["c"] + p["cb"])}


def learn(x: np.ndarray, bags: np.ndarray, y: np.ndarray, hidden: int = 24, gate: int = 12, epochs: int = 40, rate: float = 0.01, decay: float = 1e-4, batch: int = 128, seed: int = 7) -> dict[str, np.ndarray]:
    """Adam over mini-batches of bags; gradients by hand."""
    rng = np.random.default_rng(seed)
    d = x.shape[1]
    p = {
        "w": rng.normal(0, 1 / np.sqrt(d), (d, hidden)), "wb": np.zeros(hidden), "v": rng.normal(0, 0.3, (hidden, gate)),
        "u": rng.normal(0, 0.3, (hidden, gate)), "a": rng.normal(0, 0.3, gate), "c": rng.normal(0, 0.3, hidden), "cb": np.zeros(()),
    }
    m = {k: np.zeros_like(v) for k, v in p.items()}
    s = {k: np.zeros_like(v) for k, v in p.items()}
    step = 0
    epochs = max(epochs, -(-800 * batch // max(1, len(y))))  # 800 steps at least, however few the documents
    for epoch in range(epochs):
        pick = rng.permutation(len(y))
        for i in range(0, len(pick), batch):
            rows = pick[i : i + batch]
            sizes = bags[rows + 1] - bags[rows]
            own = np.concatenate(([0], np.cumsum(sizes)))
            src = np.repeat(bags[rows] - own[:-1], sizes) + np.arange(own[-1])
            xs, ys = x[src].astype(np.float64), y[rows]
            f = forward(p, xs, own)
            dy = (f["y"] - ys) / len(rows)
            g = {"c": f["z"].T @ dy, "cb": dy.sum()}
            dz = dy[:, None] * p["c"]
            rz = dz[f["rep"]]
            datt = (f["h"] * rz).sum(1)
            de = f["att"] * (datt - np.add.reduceat(f["att"] * datt, own[:-1])[f["rep"]])
            dv = de[:, None] * p["a"] * f["u"] * (1 - f["v"] ** 2)
            du = de[:, None] * p["a"] * f["v"] * f["u"] * (1 - f["u"])
            g["a"] = (f["v"] * f["u"]).T @ de
            g["v"], g["u"] = f["h"].T @ dv, f["h"].T @ du
            dh = (rz * f["att"][:, None] + dv @ p["v"].T + du @ p["u"].T) * (1 - f["h"] ** 2)
            g["w"], g["wb"] = xs.T @ dh, dh.sum(0)
            step += 1
            now = rate * 0.5 * (1 + np.cos(np.pi * epoch / epochs))
            for k in p:
                grad = g[k] + decay * p[k]
                m[k] = 0.9 * m[k] + 0.1 * grad
                s[k] = 0.999 * s[k] + 0.001 * grad**2
                p[k] = p[k] - now * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.999**step)) + 1e-8)
    return {k: np.asarray(v, np.float64) for k, v in p.items()}


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, max_docs: int, max_passages: int) -> DataFrame:
    """(k, label, text) of the documents that are learned from."""
    labelled = (
        labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & ~held_out())
        .groupBy(F.col("doc_id").cast("string").alias("k"))
        .agg(F.avg(F.col("quality").cast("double")).alias("label"))
    )
    key = docs.select(F.col("doc_id").cast("string").alias("k"), F.col("text").alias("text"))
    # only ids meet the labels, before the bound is applied; then a bounded table meets the texts
    some = key.select("k").join(labelled, "k").distinct().orderBy(F.xxhash64("k"), "k").limit(max_docs)
    met = key.join(F.broadcast(some), "k").groupBy("k", "label").agg(F.min("text").alias("text"))
    met = written(met, "labelled")
    passages = F.greatest(F.lit(1), F.ceil(F.regexp_count(text_of(), F.lit("[^\\x20\\x09-\\x0D]+")) / PASSAGE))
    left, over = max_passages, []
    for r in met.select("k", passages.alias("n")).orderBy(F.xxhash64("k"), "k").collect():  # max_docs rows at most
        if r.n <= left:
            left -= r.n
        else:
            over.append(r.k)
    return met.where(~F.col("k").isin(over)) if over else met


def fit(docs: DataFrame, labels: DataFrame, max_docs: int = 4000, max_passages: int = 100_000) -> dict[str, np.ndarray]:
    """Weights learned from a bounded sample; ``docs`` needs doc_id and text, ``labels`` doc_id and quality."""
    rows = sample(docs, labels, max_docs, max_passages)

    def features(batches):
        for batch in batches:
            out = []
            for at, end, raw, offsets in text_slices(batch.column(2)):
                x, bags = encode(raw, offsets)
                out += [x[bags[i] : bags[i + 1]].tobytes() for i in range(end - at)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.binary())], names=["k", "label", "x"])

    got = rows.mapInArrow(features, "k string, label double, x binary").toArrow().sort_by("k").combine_chunks()
    y = got["label"].to_numpy()
    if not len(y):
        return {"prior": np.asarray(0.5)}
    if (y >= 0.5).all() or (y < 0.5).all():
        return {"prior": np.asarray((y.sum() + 1) / (len(y) + 2))}
    flat = got["x"].combine_chunks()
    _, at, data = flat.buffers()
    at = np.frombuffer(at, np.int32)[flat.offset : flat.offset + len(flat) + 1]
    x = np.frombuffer(data, np.float32)[at[0] // 4 : at[-1] // 4].reshape(-1, N_FEATURES)
    return learn(x, (at - at[0]).astype(np.int64) // (4 * N_FEATURES), y)


def scores(docs: DataFrame, model: dict[str, np.ndarray], text_col: str = "text", name: str = "score") -> DataFrame:
    """``docs`` with a double column of scores. Texts stay as they are."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    place = docs.columns.index(text_col)

    def run(batches):
        p = sent.value
        for batch in batches:
            out = np.zeros(batch.num_rows)
            if "prior" in p:
                out += float(p["prior"])
            else:
                for at, end, raw, offsets in text_slices(batch.column(place)):
                    out[at:end] = forward(p, *encode(raw, offsets))["y"]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out)], names=[*batch.schema.names, name])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())]))


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row a document: doc_id, held_out, score, predicted."""
    model = fit(docs, labels)
    ids = docs.select("doc_id", "text")
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):  # as scores(), but the text doesn't travel back
        p = sent.value
        for batch in batches:
            out = np.zeros(batch.num_rows)
            if "prior" in p:
                out += float(p["prior"])
            else:
                for at, end, raw, offsets in text_slices(batch.column(1)):
                    out[at:end] = forward(p, *encode(raw, offsets))["y"]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out)], names=["doc_id", "score"])

    scored = ids.mapInArrow(run, T.StructType([docs.schema["doc_id"], T.StructField("score", T.DoubleType())]))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def stage(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Pipeline form: documents with predicted 1, all their columns."""
    cols = docs.columns
    name = "_score"
    while name in cols:
        name = f"_{name}"
    return scores(docs, fit(docs, labels), name=name).where(F.col(name) >= THRESHOLD).select(*cols)
