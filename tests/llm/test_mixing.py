import pytest

from bitlark.llm import mixing
from tests.llm.helpers import clashing, frame, lorem, odd_rows


def sizes(text):
    return len([x for x in __import__("re").split("[\x20\x09-\x0d]+", text or "") if x])


def targets(by_source):
    names = sorted((s for s in by_source if s is not None), key=lambda s: s.encode()) + ([None] if None in by_source else [])
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    left, open_, out = 1.5 * sum(by_source.values()), set(names), {}
    while True:
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if level * weight[s] > 2 * by_source[s]}
        if not over:
            return out | {s: level * weight[s] for s in open_}
        for s in over:
            out[s] = 2.0 * by_source[s]
            left -= out[s]
        open_ -= over


def check(rows, got):
    by = {}
    for _, t, _, s in rows:
        by[s] = by.get(s, 0) + sizes(t)
    want, taken = targets(by), {}
    source = {}
    for d, t, _, s in rows:
        source.setdefault((d, sizes(t)), []).append(s)
    for r in got:
        s = source[r.doc_id, r["size"]].pop()
        assert r.target == pytest.approx(want[s]) and r.source_size == by[s]
        assert 0 <= r.taken <= 2 * r["size"]
        taken[s] = taken.get(s, 0) + r.taken
    for s in by:
        assert want[s] - 1 <= taken[s] <= want[s]


def corpus():
    rows = []
    for i in range(240):
        s = ("hot" if i % 3 == 0 else f"s{i % 7}") if i % 11 else None
        rows.append((i, " ".join(lorem(i, 5 + 13 * (i % 9))), "en", s))
    return rows


def test_targets_and_taken(spark):
    rows = corpus()
    got = mixing.digest(frame(spark, rows)).collect()
    check(rows, got)
    again = mixing.digest(frame(spark, rows).repartition(7)).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))


def test_emit_is_sorted_and_whole(spark):
    df = frame(spark, corpus())
    out = mixing.stage(df)
    finish = [r.finish for r in out.collect()]
    assert finish == sorted(finish)
    taken = {r.doc_id: r.taken for r in mixing.digest(df).collect()}
    sent = {}
    for r in out.collect():
        sent[r.doc_id] = sent.get(r.doc_id, 0) + r.words
    assert sent == {d: t for d, t in taken.items() if t}


def test_odd_rows(spark):
    rows = [(r[0], r[1], "en", r[3] if len(r) > 3 else ("", "é", "z")[(r[0] or 0) % 3]) for r in odd_rows()]
    df = frame(spark, rows)
    assert mixing.digest(clashing(df)).count() == len(rows)
    check(rows, mixing.digest(df).collect())
    assert mixing.digest(df.limit(0)).count() == 0
    blank = frame(spark, [(1, " ", "en", "a"), (2, None, "en", "b")])
    assert [(r["size"], r.target, r.taken) for r in mixing.digest(blank).collect()] == [(0, 0.0, 0)] * 2
    assert mixing.digest(frame(spark, [(1, "a b c", "en", None)])).first().taken == 4


def test_driver_tables(spark, data, duck):
    from conftest import rows_of

    got = mixing.digest(spark.read.parquet(f"{data}/documents.parquet")).toPandas()
    assert rows_of(got) == rows_of(duck.execute(mixing.SQL).df())


def test_taken_is_what_the_merged_queue_sends(spark):
    df = frame(spark, corpus())
    scheduled = mixing.schedule(df)
    sent = {}
    for r in mixing.emit(scheduled).collect():
        sent[r.doc_id] = sent.get(r.doc_id, 0) + r._mx_words
    assert {r.doc_id: r.taken for r in mixing.digest(df).collect() if r.taken} == sent


def test_the_queue_ends_at_the_budget(spark):
    """The end of the merged queue against a sort of all its packets, and fairness on the way: no source is ahead by more than a document."""
    scheduled = mixing.schedule(frame(spark, corpus())).cache()
    rows = scheduled.select("_mx_s", "_mx_target", mixing._packets(2.0).alias("p")).collect()
    budget = sum(int(t) for t in {r._mx_s: r._mx_target for r in rows}.values())
    packets = sorted((p.finish, p.words, r._mx_s) for r in rows for p in r.p)
    sent, end = 0, None
    for finish, words, _ in packets:
        sent += words
        if sent > budget:
            end = finish
            break
    assert mixing.queue_end(scheduled) == end > 1
    assert sum(w for f, w, _ in packets if f < end) == budget
    order = mixing.emit(scheduled).select("source", "_mx_words", "_mx_finish").collect()
    assert [r._mx_finish for r in order] == sorted(f for f, _, _ in packets if f < end)
    targets_, done = {r._mx_s: r._mx_target for r in rows}, dict.fromkeys({r._mx_s for r in rows}, 0)
    for r in order[: len(order) // 2]:
        done[r.source] += r._mx_words
        for s, t in targets_.items():
            assert done[s] / t <= r._mx_finish + 1e-9 and done[s] / t >= r._mx_finish - 150 / t


def test_the_last_stage_repeats_in_order(spark):
    df = frame(spark, corpus() + [(7, "a b c", "en", None), (7, "a b c", "en", None)])
    one, two = (mixing.stage(x).select("doc_id", "turn", "words", "finish").collect() for x in (df, df.repartition(5)))
    assert one == two
