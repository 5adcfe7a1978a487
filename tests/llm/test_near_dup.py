import random

import numpy as np
import pyarrow as pa

from bitlark.llm import near_dup
from tests.llm.helpers import bag, clashing, frame, lorem, odd_rows, overlap


def edited(words, seed, share):
    rng = random.Random(seed)
    return [w if rng.random() > share else f"edit{rng.randrange(10**6)}" for w in words]


def brute(rows):
    bags = [bag(t) for _, t, *_ in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if bags[i] and bags[j] and overlap(bags[i], bags[j]) >= 0.8:
                parent[find(i)] = find(j)
    group = {}
    for i, r in enumerate(rows):
        if bags[i] and r[0] is not None:
            group[find(i)] = min(group.get(find(i), r[0]), r[0])
    return sorted(((r[0], group.get(find(i)) if bags[i] else r[0]) for i, r in enumerate(rows)), key=repr)


def planted():
    rows = []
    for g in range(6):
        base = lorem(g, 60 + 40 * g)
        rows.append((100 * g + 50, " ".join(base)))
        rows += [(100 * g + i, " ".join(edited(base, 7 * g + i, 0.004 * i)).upper() + "!" * i) for i in range(12)]
    # a chain: neighbours are similar, ends are not
    base = lorem(99, 300)
    for i in range(8):
        rows.append((1000 + i, " ".join(base[12 * i : 12 * i + 200])))
    # counts matter: the same shingle set, other multiplicities
    rows += [(2000, "a b c d e " * 30), (2001, "a b c d e " * 36), (2002, "a b c d e " * 90)]
    return rows


def test_against_brute_force(spark):
    rows = [r for r in odd_rows() if r[0] != 8] + planted()
    got = near_dup.digest(frame(spark, rows))
    assert sorted(((r.doc_id, r.class_id) for r in got.collect()), key=repr) == brute(rows)


def test_a_large_group_with_outliers(spark):
    """Copies of one text that are mostly not similar to each other meet through the original only."""
    base = lorem(5, 150)
    rows = [(5000, " ".join(base))] + [(i, " ".join(edited(base, i, 0.024))) for i in range(250)]
    got = near_dup.digest(frame(spark, rows))
    assert sorted(((r.doc_id, r.class_id) for r in got.collect()), key=repr) == brute(rows)


def test_signatures_are_unbiased():
    a, b = "p q r s t " * 3 + " ".join(f"w{i}" for i in range(200)), "p q r s t " * 9 + " ".join(f"w{i}" for i in range(150))
    texts = pa.array([a, b, "z " * 40, "z " * 25])
    for _, _, raw, offsets in near_dup.text_slices(texts):
        rows, h, n, _ = near_dup.shingles(raw, offsets)
        sig = near_dup.bag_minhash(*near_dup.counted(rows, h), len(n), 6000)
    for i, j in ((0, 1), (2, 3), (0, 2)):
        true = overlap(bag(texts[i].as_py()), bag(texts[j].as_py()))
        assert abs((sig[i] == sig[j]).mean() - true) < 0.025
        assert abs(near_dup.overlaps(texts.slice(i, 1), texts.slice(j, 1))[0] - true) < 1e-12


def test_components(spark):
    rng = np.random.default_rng(0)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 400, (300, 2))] + [(i, i + 1) for i in range(1000, 1060)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    got = {r.node: r.label for r in near_dup.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in parent if find(x) != x}


def test_stage_and_empty(spark):
    rows = odd_rows() + [(10_000 + d, t) for d, t in planted()[:13]] + [(5, "one")]
    df = clashing(frame(spark, rows))
    out = near_dup.stage(df)
    assert out.columns == df.columns
    kept = sorted(((r.doc_id, r.text) for r in out.collect()), key=repr)
    classes = brute([r for r in rows if r[0] != 8])
    best = {c for _, c in classes}
    assert [d for d, _ in kept].count(5) == 1 and {d for d, _ in kept if d is not None} == (best | {8}) - {None}
    assert sum(1 for _, t in kept if not (t or "").strip() and t is not None) == 3  # documents without words stay
    assert near_dup.digest(df.limit(0)).count() == 0 and near_dup.stage(df.limit(0)).count() == 0


def test_shared_boilerplate_makes_no_pairs(spark):
    """Different texts around the same half meet in buckets, but their rare elements keep them apart."""
    half = lorem(3, 120)
    rows = [(i, " ".join([f"own{i}x{j}" for j in range(50)] + half)) for i in range(300)]
    texts = frame(spark, rows).select("text").mapInArrow(near_dup._with_node, "node long, text string")
    nodes = [r.node for r in texts.select("node").collect()]
    members = spark.createDataFrame([(1, n) for n in nodes], "key long, node long")
    labels = spark.createDataFrame([], "node long, label long")
    assert len(nodes) == 300 and near_dup._residual(members, labels, texts, 0.8).count() == 0
    assert near_dup.digest(frame(spark, rows)).where("doc_id <> class_id").count() == 0
