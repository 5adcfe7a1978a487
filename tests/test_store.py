import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from bitlark import errors
from bitlark.errors import CompactionPending, WriterStopped
from bitlark.functions import codes, fit
from bitlark.operators import filters as f
from bitlark.sources.store import MUTATIONS, Index, with_consistency
from bitlark.streaming.ingest import ingest, source


def muts(spark, rows):
    """(op, doc_id, words, terms) in order."""
    full = [(i, op, d, w, None, None, t) for i, (op, d, w, t) in enumerate(rows)]
    return spark.createDataFrame(full, MUTATIONS)


def state(index):
    docs = {r.doc_id: r.w0 for r in index.docs().collect()}
    tags = {(r.doc_id, r.term) for r in index.all_attrs().collect()}
    return docs, tags


def test_mutations_apply_in_order(spark, tmp_path):
    index = Index.create(spark, str(tmp_path), 64)
    reply = index.apply(muts(spark, [("put", 0, [1], [5]), ("put", 70000, [2], None), ("put", 0, [3], [6]), ("delete", 9, None, None), ("attr", 8, None, [5]), ("unattr", 8, None, [7])]))
    assert (reply["written"], reply["deleted"]) == (3, 1)
    assert state(index) == ({0: 3, 70000: 2}, {(0, 5), (0, 6), (8, 5)})
    index.apply(muts(spark, [("delete", 0, None, None), ("put", 8, [9], None), ("delete", 70000, None, None), ("put", 70000, [4], None), ("unattr", 0, None, [6])]))
    assert state(index) == ({8: 9, 70000: 4}, {(0, 5), (8, 5)})
    assert index.count(f.Term(5)) == 1
    index.apply(muts(spark, [("put", 0, [7], None)]))  # attributes of a retired id come back with it
    assert index.count(f.Term(5)) == 2
    before = state(index)
    index.fold()
    assert state(index) == before and len(index.manifest.docs) == 1
    old = index.at(1)
    assert state(old)[0] == {0: 3, 70000: 2}  # a pinned version doesn't move
    index.vacuum()
    with pytest.raises(errors.SnapshotExpired):
        index.at(1)
    assert state(Index.open(spark, str(tmp_path))) == before


def test_churn_against_a_model(spark, tmp_path):
    rng = random.Random(5)
    index = Index.create(spark, str(tmp_path), 64)
    docs, tags = {}, set()
    for _ in range(3):
        rows = []
        for _ in range(60):
            op, d, t = rng.choice(["put", "put", "delete", "attr", "unattr"]), rng.randrange(20), rng.randrange(3)
            w = rng.getrandbits(60)
            rows.append((op, d, [w] if op == "put" else None, None if op == "delete" else [t]))
            if op == "put":
                docs[d] = w
            if op == "delete":
                docs.pop(d, None)
            if op in ("put", "attr"):
                tags.add((d, t))
            if op == "unattr":
                tags.discard((d, t))
        index.apply(muts(spark, rows))
        assert state(index) == (docs, tags)


def test_refusals(spark, tmp_path):
    root = str(tmp_path)
    index = Index.create(spark, root, 100)
    with pytest.raises(errors.AlreadyExists):
        Index.create(spark, root, 100)
    (tmp_path / "ns=7").mkdir()
    (tmp_path / "ns=7" / "other").write_text("x")
    with pytest.raises(errors.KeyspaceOccupied):
        Index.create(spark, root, 64, 7)
    for rows, kind in (
        ([("put", 1 << 36, [1], None)], errors.DocIdTooLarge),
        ([("put", 1, [1], [1 << 20])], errors.AttrTermTooLarge),
        ([("put", 1, [1, 2, 3], None)], errors.DimensionMismatch),
        ([("put", 1, None, None)], errors.InvalidArgument),
        ([("drop", 1, None, None)], errors.InvalidArgument),
        ([("put", 0, [1], None), ("put", -1, [1], None)], errors.DocIdTooLarge),
    ):
        with pytest.raises(kind):
            index.apply(muts(spark, rows))
    assert index.describe()["live"] == 0  # nothing of a refused batch stays
    sparse = spark.createDataFrame([(0, "put", 4, [9, 3])], "seq long, op string, doc_id long, positions array<int>")
    with pytest.raises(errors.InvalidArgument):
        index.apply(sparse)
    index.apply(spark.createDataFrame([(0, "put", 4, [3, 9, 120])], "seq long, op string, doc_id long, positions array<int>"))
    assert index.docs().first().weight == 2  # bits between the width and the row are dropped
    rival = Index.open(spark, root)
    rival.apply(muts(spark, [("put", (1 << 36) - 1, [1], [(1 << 20) - 1])]))
    with pytest.raises(errors.WriterStopped):
        index.apply(muts(spark, [("put", 6, [1], None)]))
    with pytest.raises(errors.WriterStopped):
        index.refresh_stats()
    (tmp_path / "ns=3").mkdir()
    (tmp_path / "ns=3" / f"manifest-{0:020d}.json").write_text("{")
    with pytest.raises(errors.CorruptMeta):
        Index.open(spark, root, 3)
    tries = []
    with pytest.raises(errors.SnapshotExpired):
        with_consistency(lambda i: tries.append(1) or (_ for _ in ()).throw(errors.SnapshotExpired()), rival)
    assert len(tries) == 4
    assert with_consistency(lambda i: i.count(), rival, "strict") == 2


def test_namespace_rule(spark, tmp_path):
    Index.create(spark, str(tmp_path), 64, 0)
    with pytest.raises(errors.InvalidArgument):
        Index.open(spark, str(tmp_path))
    Index.create(spark, str(tmp_path), 64, 1)
    assert Index.open(spark, str(tmp_path)).path.endswith("ns=1")


@pytest.mark.parametrize("dims", [1, 65, 192])
def test_compaction(spark, tmp_path, dims):
    rng = random.Random(dims)
    ids = [0, 1, 2, 3, *range(65_530, 65_545)]
    sets = {i: [p for p in range(dims) if rng.random() < 0.4] for i in ids}
    index = Index.create(spark, str(tmp_path), dims)
    index.apply(muts(spark, [("put", i, [codes.signed(w) for w in codes.to_words(sets[i], dims)], [7] if i % 2 == 0 else None) for i in ids]))
    index.refresh_stats()
    assert index.describe()["blocks_with_stats"] == 2
    gone = ids[::4]
    index.apply(muts(spark, [("delete", i, None, None) for i in gone]))
    assert index.describe()["blocks_with_stats"] == 0
    live = sorted((i for i in ids if i not in gone), key=lambda i: (-len(sets[i]), i))
    version, table = index.compact()
    want = dict(enumerate(live))
    assert {r.new_id: r.old_id for r in table.collect()} == want
    with pytest.raises(errors.CompactionPending):
        Index.open(spark, str(tmp_path))
    again = Index.open(spark, str(tmp_path), pending=True)
    assert again.compact()[0] == version and {r.new_id: r.old_id for r in again.compact()[1].collect()} == want
    with pytest.raises(errors.CompactionMismatch):
        again.acknowledge(version + 1)
    again.acknowledge(version)
    index = Index.open(spark, str(tmp_path))
    assert {r.doc_id: r.weight for r in index.docs().collect()} == {n: len(sets[o]) for n, o in want.items()}
    assert {r.doc_id for r in index.all_attrs().collect()} == {n for n, o in want.items() if o % 2 == 0}


def test_statistics(spark, tmp_path):
    index = Index.create(spark, str(tmp_path), 64)
    index.apply(muts(spark, [("put", i, [(1 << (i % 9)) - 1], None) for i in (*range(5), *range(70_000, 70_004))]))
    index.refresh_stats()
    full = {r.block: (r.w_min, r.w_max) for r in index.stats().collect()}
    assert full == {0: (0, 4), 1: (7, 8)} or set(full) == {0, 1}
    index.apply(muts(spark, [("attr", 1, None, [3]), ("delete", 999, None, None)]))
    assert index.stats().count() == 2  # tags and absent ids leave statistics alone
    index.apply(muts(spark, [("delete", 70_001, None, None)]))
    assert [r.block for r in index.stats().collect()] == [0]


def test_streaming(spark, tmp_path):
    rows = [("put", i % 10, [i + 1], [i % 3]) for i in range(40)] + [("delete", 4, None, None)]
    full = muts(spark, rows)
    for part, (lo, hi) in enumerate(((0, 15), (15, 30), (30, 99))):
        full.where(F.col("seq").between(lo, hi - 1)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    index = Index.create(spark, str(tmp_path / "index"), 64)
    query, replies = ingest(source(spark, str(tmp_path / "in")), index, str(tmp_path / "progress"))
    query.awaitTermination()
    assert len(replies) == 3 and sum(r["written"] for r in replies) == 40
    direct = Index.create(spark, str(tmp_path / "direct"), 64)
    direct.apply(full)
    assert state(index) == state(direct)
    version = index.manifest.version
    assert index.apply(full, batch=("ingest", 1))["skipped"] and index.manifest.version == version


def test_residual_index(spark, tmp_path):
    rng = random.Random(1)
    vectors = [[rng.gauss(0, 1) for _ in range(6)] for _ in range(80)]
    df = spark.createDataFrame(list(enumerate(vectors)), "doc_id long, embedding array<float>")
    model = fit.fit(df, 6, seed=3).model
    index = Index.create(spark, str(tmp_path), 512, model=model)
    puts = df.select(F.col("doc_id").alias("seq"), F.lit("put").alias("op"), "doc_id", "embedding", F.array((F.col("doc_id") % 3).cast("int")).alias("terms"))
    index.apply(puts, model)
    q = model.prepare(vectors[5])
    import numpy as np

    scores = q.score(model.encode(np.array(vectors, np.float32)))
    want = sorted(range(80), key=lambda i: (-scores[i], i))[:10]
    assert [r.doc_id for r in index.search_vector(q).orderBy("rank").collect()] == want
    want = sorted((i for i in range(80) if i % 3 == 0), key=lambda i: (-scores[i], i))[:10]
    assert [r.doc_id for r in index.search_vector(q, f=f.Term(0)).orderBy("rank").collect()] == want
    with pytest.raises(errors.BinarySearchOnResidualIndex):
        index.search([1]).frame()
    other = fit.fit(df, 6, seed=4).model
    with pytest.raises(errors.ModelMismatch):
        index.search_vector(other.prepare(vectors[0]))
    with pytest.raises(errors.ModelMismatch):
        index.apply(puts, other)
    assert index.count(f.Term(1)) == 27


def _word_rows(spark, ids, bits=lambda i: i):
    return spark.createDataFrame([(n, "put", i, [bits(i)]) for n, i in enumerate(ids)], "seq long, op string, doc_id long, words array<long>")


def test_nothing_is_written_while_a_compaction_is_pending(spark, tmp_path):
    index = Index.create(spark, str(tmp_path), 64)
    index.apply(_word_rows(spark, range(5)))
    source, _ = index.compact()
    with pytest.raises(CompactionPending):
        index.apply(_word_rows(spark, [9]))
    index.acknowledge(source)
    assert index.apply(_word_rows(spark, [9]))["written"] == 1


def test_many_commits_are_merged(spark, tmp_path):
    from bitlark.sources import store

    index = Index.create(spark, str(tmp_path), 64)
    live = {}
    for i in range(store.MERGE_AT + 4):
        index.apply(spark.createDataFrame([(0, "put", i, [i + 1]), (1, "put", 100, [i]), (2, "delete", i - 2, None)], "seq long, op string, doc_id long, words array<long>"))
        live |= {i: i + 1, 100: i}
        live.pop(i - 2, None)
    assert len(index.manifest.docs) <= store.MERGE_AT + 1
    assert {r.doc_id: r.w0 for r in index.docs().collect()} == live
    assert index.contains(100) and not index.contains(0) and index.max_doc_id().first()[0] == 100


def test_residual_index_compacts_by_set_bits(spark, tmp_path):
    from bitlark.plans.registry import fixed_model

    model = fixed_model()
    rng = np.random.default_rng(5)
    rows = [(i, "put", 7 * i, [float(x) for x in rng.normal(size=4)]) for i in range(30)]
    index = Index.create(spark, str(tmp_path), 512, model=model)
    index.apply(spark.createDataFrame(rows, "seq long, op string, doc_id long, embedding array<float>"), model)
    assert index.refresh_stats() == index.manifest.version == 1
    bits = {r.doc_id: sum(bin(b).count("1") for b in r.code) for r in index.docs().collect()}
    got = {r.new_id: r.old_id for r in index.compact()[1].collect()}
    assert [got[i] for i in range(30)] == sorted(bits, key=lambda d: (-bits[d], d))


def test_a_lost_writer_leaves_no_manifest(spark, tmp_path):
    """A file that was begun but not published isn't seen; publishing is exclusive."""
    index = Index.create(spark, str(tmp_path), 64)
    index.apply(_word_rows(spark, [1]))
    (tmp_path / "ns=1" / ".manifest-00000000000000000002.json-lost").write_bytes(b'{"layout"')
    again = Index.open(spark, str(tmp_path))
    assert again.manifest.version == 1 and again.apply(_word_rows(spark, [2]))["version"] == 2
    with pytest.raises(WriterStopped):
        index.apply(_word_rows(spark, [3]))


def test_statistics_and_postings_change_work_not_answers(spark, tmp_path):
    from bitlark.operators.filters import Ids

    rng = np.random.default_rng(2)
    words = {i * 9000: int(rng.integers(0, 2**62)) & int(rng.integers(0, 2**62)) for i in range(300)}
    index = Index.create(spark, str(tmp_path), 64)
    index.apply(_word_rows(spark, words, lambda i: words[i]))
    q = (words[9000 * 8],)
    plain = {m: index.search(q, metric=m).frame().collect() for m in ("dot", "hamming", "jaccard", "cosine")}
    index.refresh_stats()
    index.refresh_postings()
    few = (words[9000 * 8] & 0xFFF,)
    small = {m: index.search(few, metric=m, path="dense").frame().collect() for m in plain}
    for m, want in plain.items():
        assert index.search(q, metric=m, prune=True).frame().collect() == want
        assert index.search(q, metric=m, path="inverted").frame().collect() == want
        assert index.search(few, metric=m).frame().collect() == small[m]
    assert index.search(few, metric="dot").planned()[0] == "inverted" and index.search(few).planned()[0] == "dense"
    assert index.search(q, filter=Ids((1, 2))).planned()[0] == "gather" and index.search(q, path="dense").planned() == ("dense", "forced")
    stats = index.search(q, metric="jaccard", prune=True).scan_stats().first()
    assert stats.scored < 300 and stats.blocks_visited + stats.blocks_skipped == index.docs().select("block").distinct().count()
    index.acknowledge(index.compact()[0])
    assert index.postings() is None
    index.refresh_stats()
    again = index.search(q, metric="jaccard", prune=True)
    assert [(r.num, r.den) for r in again.frame().collect()] == [(r.num, r.den) for r in plain["jaccard"]]
    assert 10 <= again.scan_stats().first().scored <= stats.scored
