import zlib

import numpy as np
import pyarrow as pa

from bitlark.llm import quality
from bitlark.llm.common import text_slices
from tests.llm.helpers import clashing, frame, lorem, odd_rows


def test_held_out_accuracy(spark, data):
    docs, labels = spark.read.parquet(f"{data}/documents.parquet"), spark.read.parquet(f"{data}/labels.parquet")
    got = {r.doc_id: r for r in quality.digest(docs, labels).collect()}
    assert all(r.held_out == (zlib.crc32(str(d).encode()) % 4 == 2) for d, r in got.items())
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got.values())
    held = [(got[r.doc_id].predicted, r.quality) for r in labels.collect() if got[r.doc_id].held_out]
    assert np.mean([a == b for a, b in held]) >= 0.9
    again = {r.doc_id: r.score for r in quality.digest(docs.repartition(5), labels).collect()}
    assert all(abs(again[d] - r.score) < 1e-9 for d, r in got.items())


def test_held_out_labels_are_never_learned(spark, data):
    from pyspark.sql import functions as F

    docs, labels = spark.read.parquet(f"{data}/documents.parquet"), spark.read.parquet(f"{data}/labels.parquet")
    flipped = labels.withColumn("quality", F.when(quality.held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = quality.fit(docs, labels), quality.fit(docs, flipped)
    assert all((a[k] == b[k]).all() for k in a)


def test_gradients():
    rng = np.random.default_rng(0)
    x, bags, y = rng.normal(size=(30, 5)), np.array([0, 1, 4, 11, 30]), np.array([0.0, 1, 0, 1])
    p = quality.learn(x, bags, y, hidden=4, gate=3, epochs=200, decay=0.0)
    assert (np.abs(quality.forward(p, x, bags)["y"] - y) < 0.1).all()
    f = quality.forward(p, x, bags)
    assert np.allclose(np.add.reduceat(f["att"], bags[:-1]), 1)


def test_encoding_covers_whole_texts():
    texts = ["", "a b", " ".join(f"w{i}" for i in range(500)), None, " \n "]
    for _, _, raw, offsets in text_slices(pa.array(texts)):
        x, bags = quality.encode(raw, offsets)
    assert np.diff(bags).tolist() == [1, 1, -(-500 // quality.PASSAGE), 1, 1]
    assert np.isfinite(x).all() and x.shape[1] == quality.N_FEATURES
    alone = [quality.encode(raw, off)[0] for _, _, raw, off in text_slices(pa.array([texts[2]]))][0]
    assert (x[bags[2] : bags[3]] == alone).all()


def test_odd_rows(spark):
    df = frame(spark, odd_rows())
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (5, 1, 0), (5, 0, 0), (6, None, 0), (None, 1, 0), (999, 1, 1)], "doc_id long, quality int, toxic int")
    got = quality.digest(df, labels).collect()
    assert len(got) == len(odd_rows()) and all(0 <= r.score <= 1 and r.held_out is not None for r in got)
    assert {r.score for r in quality.digest(df, labels.limit(0)).collect()} == {0.5}
    assert quality.digest(df.limit(0), labels).count() == 0
    wide = clashing(df)
    assert quality.stage(wide, labels).columns == wide.columns
    good = [(i, " ".join(lorem(i, 80))) for i in range(60)]
    bad = [(100 + i, " ".join(w + "$$$" for w in lorem(i, 80))) for i in range(60)]
    both = frame(spark, good + bad)
    lab = spark.createDataFrame([(i, int(i < 100), 0) for i, _ in good + bad], labels.schema)
    kept = {r.doc_id for r in quality.stage(both, lab).collect()}
    assert kept == {i for i, _ in good}


def test_string_ids_and_the_bound_of_the_sample(spark):
    """Ids of text; the sample takes whole documents within its bounds, and learns from those alone."""
    good = [(f"a/{i}", " ".join(lorem(i, 80 if i else 9000))) for i in range(40)]
    bad = [(f"b/{i}", " ".join(w + "$$$" for w in lorem(i, 80))) for i in range(40)]
    docs = spark.createDataFrame(good + bad, "doc_id string, text string")
    labels = spark.createDataFrame([(d, int(d[0] == "a"), 0) for d, _ in good + bad], "doc_id string, quality int, toxic int")
    whole = {r.k: r.text for r in quality.sample(docs, labels, 4000, 100_000).collect()}
    assert whole == {d: t for d, t in good + bad if zlib.crc32(d.encode()) % 4 != 2}
    some = {r.k: r.text for r in quality.sample(docs, labels, 30, 40).collect()}
    assert set(some) < set(whole) and sum(-(-len(t.split()) // quality.PASSAGE) for t in some.values()) <= 40
    assert all(whole[k] == t for k, t in some.items()) and "a/0" not in some and len(some) == 20
    got = quality.digest(docs, labels).collect()
    assert all(r.predicted == int(r.doc_id[0] == "a") for r in got)


def slow_features(text):
    """Features of the passages of a text, byte by byte."""
    from bitlark.llm.common import BASE, MASK64

    raw = text.encode()
    tokens, at = [], None
    for i, b in enumerate(raw + b" "):
        if b in b" \t\r\v\f\n":
            if at is not None:
                tokens.append((at, i))
                at = None
        elif at is None:
            at = i
    groups = [tokens[i : i + quality.PASSAGE] for i in range(0, len(tokens), quality.PASSAGE)] or [[]]
    begins = [0] + [g[0][0] for g in groups[1:]] + [len(raw)]
    out = []
    for n, g in enumerate(groups):
        part = raw[begins[n] : begins[n + 1]]
        hist = [0] * quality.N_CLASS
        for b in part:
            hist[quality.CLASS[b]] += 1
        bag, seen, sizes = [0.0] * quality.BUCKETS, set(), [e - s for s, e in g]
        for s, e in g:
            x = sum((b + 32 * (65 <= b <= 90) + 1) * pow(BASE, i, 1 << 64) for i, b in enumerate(raw[s:e])) + (e - s) * 0xD1B54A32D192ED03 & MASK64
            x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & MASK64
            x = (x ^ x >> 27) * 0x94D049BB133111EB & MASK64
            x ^= x >> 31
            seen.add(x)
            bag[x >> 58] += 1 if x >> 32 & 1 else -1
        k = max(1, len(g))
        mean = sum(sizes) / k
        shape = [len(g) / quality.PASSAGE, float(not g), len(seen) / k, mean / 10, max(0, sum(x * x for x in sizes) / k - mean**2) ** 0.5 / 10]
        out.append([(c / max(1, len(part))) ** 0.5 for c in hist] + shape + [v / k**0.5 / 2 for v in bag])
    return out


def slow_score(p, x):
    import math

    sig = lambda v: 1 / (1 + math.exp(-v))
    h = [[math.tanh(sum(a * w for a, w in zip(r, p["w"][:, j], strict=True)) + p["wb"][j]) for j in range(p["w"].shape[1])] for r in x]
    dot = lambda r, m, j: sum(a * b for a, b in zip(r, m[:, j], strict=True))
    e = [sum(math.tanh(dot(r, p["v"], j)) * sig(dot(r, p["u"], j)) * p["a"][j] for j in range(len(p["a"]))) for r in h]
    w = [math.exp(v) for v in e]
    z = [sum(wi * r[j] for wi, r in zip(w, h, strict=True)) / sum(w) for j in range(len(p["c"]))]
    return sig(sum(a * b for a, b in zip(z, p["c"], strict=True)) + float(p["cb"]))


def test_scores_against_a_slow_version(spark):
    texts = [(i, " ".join(lorem(i, 60 * i + 7)).replace("ba", "Éa-B!") + "\n" * i) for i in range(4)] + [(9, ""), (10, None), (11, "A\tb  C")]
    good = [(100 + i, " ".join(lorem(i, 80))) for i in range(40)]
    bad = [(200 + i, " ".join(w + "$$$" for w in lorem(i, 80))) for i in range(40)]
    docs = frame(spark, texts + good + bad)
    labels = spark.createDataFrame([(i, int(i < 200), 0) for i, _ in good + bad], "doc_id long, quality int, toxic int")
    p = quality.fit(docs, labels)
    got = {r.doc_id: r.score for r in quality.digest(docs, labels).collect()}
    for d, t in texts + good[:3] + bad[:3]:
        slow = slow_features(t or "")
        fast = [quality.encode(raw, off)[0] for _, _, raw, off in text_slices(pa.array([t or ""]))][0]
        assert np.allclose(fast, slow, atol=1e-6)
        assert abs(got[d] - slow_score(p, slow)) < 1e-5
