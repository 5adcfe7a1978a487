import numpy as np
import pytest
from pyspark.sql import functions as F

from bitlark import errors
from bitlark.functions import codes, metrics
from bitlark.operators import filters as f
from bitlark.operators import recall
from bitlark.operators.search import KERNELS, Corpus, search_batch
from bitlark.plans import sqltable
from tests.shapes import SHAPES, brute, corpus

DIMS, N = 128, 60


def made(spark, shape, dims=DIMS, n=N, seed=11, tags=()):
    sets = corpus(shape, dims, n, seed)
    rows = [(i, [codes.signed(w) for w in codes.to_words(p, dims)]) for i, p in enumerate(sets)]
    docs = codes.stored(spark.createDataFrame(rows, "doc_id long, words array<long>"), dims).cache()
    attrs = spark.createDataFrame(list(tags), "doc_id long, term int")
    return dict(enumerate(sets)), Corpus(docs, attrs, dims)


def got(df):
    return [(r.doc_id, r.inter, r.weight, r.num, r.den) for r in df.orderBy("rank").collect()]


@pytest.mark.parametrize("shape", SHAPES)
def test_every_metric_against_brute_force(spark, shape):
    sets, c = made(spark, shape)
    q = sets[7] or [1, 5, 64]
    words = codes.to_words(q, DIMS)
    for metric in metrics.METRICS:
        assert got(c.search(words, metric=metric, k=7).frame()) == brute(sets, q, metric, 7)


def test_paths_and_kernels_agree(spark):
    sets, c = made(spark, "balanced", tags=[(i, 1) for i in range(0, N, 3)])
    q = sets[4]
    words = codes.to_words(q, DIMS)
    some = {i: p for i, p in sets.items() if i % 3 == 0}
    for metric in ("hamming", "jaccard"):
        for k in (1, 5):
            want = brute(some, q, metric, k)
            for path in ("auto", "gather", "dense", "inverted"):
                assert got(c.search(words, metric=metric, k=k, path=path, filter=f.Term(1)).frame()) == want
        for kernel in KERNELS:
            assert got(c.search(words, metric=metric, k=9, kernel=kernel).frame()) == brute(sets, q, metric, 9)


def test_pruned_search_is_exact(spark):
    for shape in ("clustered", "degenerate"):
        sets, c = made(spark, shape)
        q = next(p for p in sets.values() if len(p) > 3)
        for metric in metrics.METRICS:
            assert got(c.search(codes.to_words(q, DIMS), metric=metric, k=5, prune=True).frame()) == brute(sets, q, metric, 5)


def test_edges(spark):
    sets, c = made(spark, "sparse", n=9)
    assert got(c.search([1], k=0).frame()) == []
    assert len(got(c.search([1], k=50).frame())) == 9
    assert got(c.search(metric="dot", k=3).frame()) == brute(sets, [], "dot", 3)
    assert c.search([2**64 - 1] * 5).m == DIMS  # bits at or over the width don't count
    assert got(c.search().sparse([1, 64, DIMS + 3]).frame()) == brute(sets, [1, 64], "hamming", 10)
    with pytest.raises(errors.InvalidArgument):
        c.search().sparse([4, 4])
    with pytest.raises(errors.AttrTermTooLarge):
        c.search(filter=f.Not(f.Term(1 << 20)))
    with pytest.raises(errors.BinarySearchOnResidualIndex):
        Corpus(c.docs, None, DIMS, residual=True).search([1]).frame()


def test_wide_codes_use_arrays(spark):
    dims = 64 * 70
    sets, c = made(spark, "sparse", dims=dims, n=12)
    assert "words" in c.docs.columns
    for metric in ("cosine", "hamming"):
        assert got(c.search(codes.to_words(sets[3], dims), metric=metric, k=5).frame()) == brute(sets, sets[3], metric, 5)


def test_batch(spark):
    sets, c = made(spark, "balanced")
    ids = [0, 9, 33]
    rows = [(i, [codes.signed(w) for w in codes.to_words(sets[i], DIMS)]) for i in ids]
    queries = spark.createDataFrame(rows, "query_id long, words array<long>")
    for metric in metrics.METRICS:
        for block in (1024, 2):
            found = search_batch(c, queries, metric, 6, block=block)
            for i in ids:
                assert got(found.where(F.col("query_id") == i)) == brute(sets, sets[i], metric, 6)


def test_topk_plan_has_no_full_sort(spark):
    _, c = made(spark, "balanced")
    plan = c.search([3, 1]).frame()._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "Python" not in plan


@pytest.mark.parametrize("dims", [64, 100, 5000])
def test_sql_table_function(spark, dims):
    sets, c = made(spark, "sparse", dims=dims, n=30)
    assert codes.is_wide(c.docs) == (dims == 5000)
    name = sqltable.register(c, f"topk_{dims}")
    for q in (sets[4], [], list(range(dims))):
        words = [w | (~((1 << (dims - 64 * i)) - 1) & (2**64 - 1) if dims - 64 * i < 64 else 0) for i, w in enumerate(codes.to_words(q, dims))]
        for metric in metrics.METRICS:
            found = spark.sql(f"SELECT * FROM {name}({sqltable.literal(words)}, '{metric}', 6)")
            assert got(found) == brute(sets, q, metric, 6)
            assert [r.score for r in found.collect()] == [r.score for r in c.search(words, metric=metric, k=6).frame().collect()]
    call = lambda rest: spark.sql(f"SELECT * FROM {name}({rest})").collect()
    short = spark.sql(f"SELECT * FROM {name}(array(5L), 'dot', 3)")
    assert got(short) == brute(sets, [0, 2], "dot", 3)
    assert call("array(5L), 'dot', 0") == call("array(5L), 'dot', NULL") == call("NULL, 'dot', 3") == call("array(5L), NULL, 3") == []
    for bad in (f"array_repeat(1L, {codes.words_for(dims) + 1}), 'dot', 3", "array(5L), 'euclid', 3"):
        with pytest.raises(Exception, match="words|metric"):
            call(bad)
    plan = spark.sql(f"SELECT * FROM {name}(array(5L), 'jaccard', 3)")._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "Python" not in plan
    with pytest.raises(errors.InvalidArgument):
        sqltable.register(c, "no name")


def test_float_truth_in_blocks_of_queries(spark):
    x = np.random.default_rng(5).normal(size=(90, 8)).astype(np.float32)
    x[40:50] = x[3]
    v = spark.createDataFrame([(i, [float(y) for y in r]) for i, r in enumerate(x)], "doc_id long, embedding array<float>").repartition(5)
    queries = v.where("doc_id % 9 = 3").withColumnRenamed("doc_id", "query_id")
    wide = x.astype(np.float64)
    wide /= np.linalg.norm(wide, axis=1, keepdims=True)
    want = {(q, r + 1, int(d)) for q in range(3, 90, 9) for r, d in enumerate(np.lexsort((np.arange(90), -np.round(wide @ wide[q], 12)))[:7])}
    for block in (1024, 4, 1):
        assert {(r.query_id, r.rank, r.doc_id) for r in recall.float_truth(v, queries, 7, block).collect()} == want
    assert recall.float_truth(v, queries.where("false"), 7).count() == recall.float_truth(v.where("false"), queries, 7).count() == 0


def test_filter_algebra(spark):
    live = [0, 1, 2, 65534, 65535, 65536, 65537, 131072, 131073]
    tags = {1: {i for i in [*live, 3] if i % 3 == 0}, 2: {i for i in live if i % 2 == 0}}
    docs = spark.createDataFrame([(i, 0) for i in live], "doc_id long, weight int")
    c = Corpus(docs, spark.createDataFrame([(i, t) for t, x in tags.items() for i in x], "doc_id long, term int"), 64)
    t1, t2, r, ids = f.Term(1), f.Term(2), f.IdRange(2, 65536), f.Ids([3, 0, 0, 65537, 7])
    trees = [
        f.All(), f.Nothing(), t1, ids, r, f.IdRange(5, 5), f.IdRange(9, 2), f.IdRange(1, 2**64), f.And(), f.Or(), ~t1, t1 & t2, t1 | t2, ~(t1 & t2), ~t1 | ~t2, ~(t1 | t2), ~t1 & ~t2,
        f.And([t1, r]), f.And([f.Or(), t2]), f.Or([f.And(), t2]), ~f.And(), ~f.Or(), f.And([t1, ~ids, f.Or([t2, r])]), f.Term(9), f.Ids(range(3000)), ~f.Ids(range(3000)),
    ]
    for tree in trees:
        want = f.model(tree, set(live), tags)
        assert {x.doc_id for x in c.admitted(tree).collect()} == want, tree
    assert c.count(t1 & ~t2).first().n == len(f.model(t1 & ~t2, set(live), tags))
