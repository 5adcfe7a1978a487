import os

import pytest
from pyspark.sql import functions as F

from bitlark.llm import tokens
from tests.llm.helpers import clashing, frame, lorem, odd_rows

pytestmark = pytest.mark.skipif(not os.path.exists(tokens.VOCABULARY), reason="no vocabulary")


def brute(rows):
    with open(tokens.VOCABULARY, "rb") as f:
        e, out = tokens.encoding(f.read(), "test"), {}
    for _, t, lang, source in rows:
        n, m, b = out.get((source, lang), (0, 0, 0))
        out[source, lang] = (n + 1, m + len(e.encode_ordinary(t or "")), b + len((t or "").encode()))
    return out


def four(rows):
    return [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "s") for r in rows]


def totals(df):
    return {(r.source, r.lang): (r.n_docs, r.n_tokens, r.n_bytes) for r in df.collect()}


def test_counts(spark):
    rows = four(odd_rows()) + [(100 + i, " ".join(lorem(i, 50)), "fr", "t") for i in range(9)]
    df = clashing(frame(spark, rows))
    assert totals(tokens.digest(df)) == brute(rows)
    assert tokens.digest(df.limit(0)).count() == 0


def test_deltas_and_idempotent_commits(spark, tmp_path):
    rows = [(i, " ".join(lorem(i, 30)), "en", f"s{i % 2}") for i in range(20)]
    counts = tokens.counted(frame(spark, rows))
    r = tokens.Rollup(spark, str(tmp_path))
    assert totals(r.totals()) == {}
    assert r.commit("load", tokens.inserts(counts)) and not r.commit("load", tokens.inserts(counts))
    assert totals(r.totals()) == brute(rows)
    assert r.commit("del", tokens.deletes(counts.where("doc_id % 2 = 1")))
    assert totals(r.totals()) == brute([x for x in rows if x[0] % 2 == 0])
    changed = [(i, t + " more words", la, s) for i, t, la, s in rows if i == 4]
    assert r.commit("rev", tokens.revisions(counts.where("doc_id = 4"), tokens.counted(frame(spark, changed))))
    want = brute([x for x in rows if x[0] % 2 == 0 and x[0] != 4] + changed)
    assert totals(r.totals()) == want
    (tmp_path / "deltas" / "unpublished").mkdir()  # what a lost attempt leaves isn't read
    again = tokens.Rollup(spark, str(tmp_path))
    assert again.roll() and totals(again.totals()) == want and not again.roll()
    for batch in ("load", "del", "rev"):
        assert not again.commit(batch, tokens.inserts(counts))
    assert totals(again.totals()) == want
    assert again.commit("other", tokens.inserts(counts.withColumn("tokenizer", F.lit("v2")))) and again.totals().count() == 1 + 2
    with pytest.raises(Exception, match="batch id"):
        again.commit("../x", tokens.inserts(counts))
    with pytest.raises(Exception, match="batch id"):
        again.commit("roll-1", tokens.inserts(counts))


def test_overlapping_rolls(spark, tmp_path):
    """Two rolls of one state: the second to publish loses; a batch published in between stays in the totals."""
    rows = [(i, " ".join(lorem(i, 9)), "en", "s") for i in range(6)]
    counts = tokens.counted(frame(spark, rows))
    r = tokens.Rollup(spark, str(tmp_path))
    for i in range(2):
        assert r.commit(f"b{i}", tokens.inserts(counts.where(f"doc_id = {i}")))
    first, second = r.planned(), r.planned()
    assert r.commit("between", tokens.inserts(counts.where("doc_id = 2")))
    late = r.planned()
    assert first() and not second() and not late()
    assert totals(r.totals()) == brute(rows[:3])
    assert r.roll() and not first() and totals(r.totals()) == brute(rows[:3])
    assert not r.commit("b0", tokens.inserts(counts)) and not r.commit("between", tokens.inserts(counts))
    assert r.commit("more", tokens.inserts(counts.where("doc_id = 3"))) and totals(r.totals()) == brute(rows[:4])


def test_version_is_of_the_contents(spark, tmp_path):
    other = tmp_path / os.path.basename(tokens.VOCABULARY)
    with open(tokens.VOCABULARY, "rb") as f:
        lines = f.read().splitlines()
    other.write_bytes(b"\n".join(lines[:-1]))
    assert tokens.vocabulary(spark, str(other))[1] != tokens.vocabulary(spark, tokens.VOCABULARY)[1]
