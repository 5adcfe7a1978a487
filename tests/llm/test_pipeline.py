import math

import pytest

import corpus_pipeline as cp
from tests.llm.helpers import bag, lorem, overlap, words


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    where = str(tmp_path_factory.mktemp("sf"))
    bench = [(i, " ".join(lorem(500 + i, 25))) for i in range(3)]
    rows, clean = [], set()
    line = "This is a common line of the corpus, longer than forty code points."
    for i in range(160):
        text = " ".join(lorem(i, 90))
        if i % 8 == 1:
            text = " ".join(w + "$$$" for w in text.split())
        elif i % 8 == 2:
            text = " ".join(lorem(i - 2, 90)[:89] + ["changed"])  # a near copy of a clean one
        elif i % 8 == 3:
            text += " " + bench[i % 3][1]
        elif i % 8 == 4:
            text += "\n" + line
            clean.add(i)
        else:
            clean.add(i)
        rows.append((i, text, "en", f"s{i % 5}" if i % 7 else None, len(text)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(4)
    docs.write.parquet(f"{where}/documents.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{where}/benchmark.parquet")
    spark.createDataFrame([(r[0], int(r[0] % 8 != 1), 0) for r in rows], "doc_id long, quality int, toxic int").write.parquet(f"{where}/labels.parquet")
    return where, {r[0]: r for r in rows}, clean, line


def test_stages(spark, tables):
    where, rows, clean, line = tables
    docs = spark.read.parquet(f"{where}/documents.parquet")
    seen = [docs.collect()]
    for name, stage in cp.STAGES:
        docs = cp.written(stage(spark, docs, where), f"test-{name}")
        seen.append(docs.collect())
    _, quality, lines, near, decon, mixed = [{r.doc_id: r for r in x} for x in seen]
    assert set(quality) == {i for i in rows if i % 8 != 1}
    holders = [i for i in quality if line in rows[i][1]]
    assert {i: r.text for i, r in lines.items()} == {i: rows[i][1].replace("\n" + line, "") if i in holders and i != max(holders) else rows[i][1] for i in quality}
    assert all(r.n_chars == len(r.text) for r in lines.values())
    assert set(near) == {i for i in lines if i % 8 != 2}
    kept = [bag(r.text) for r in near.values()]
    assert all(overlap(a, b) < 0.8 for i, a in enumerate(kept) for b in kept[:i])
    assert set(decon) == clean
    assert [r.finish for r in seen[5]] and set(mixed) <= clean
    total = sum(len(words(r.text)) for r in decon.values())
    sent = sum(r.words for r in seen[5])
    assert math.isclose(sent, 1.5 * total, abs_tol=6)
    for step in seen[:5]:
        assert set(step[0].asDict()) == {"doc_id", "text", "lang", "source", "n_chars"}


def test_run_is_the_stages(spark, tables):
    where, _, clean, _ = tables
    out = cp.run(spark, where)
    assert {r.doc_id for r in out.collect()} <= clean
    assert cp.ORACLE_SQL is None and [n for n, _ in cp.STAGES] == ["quality_classifier", "line_dedup", "near_dedup", "decontamination", "source_mixing"]


def test_empty(spark, tables):
    where = tables[0]
    docs = spark.read.parquet(f"{where}/documents.parquet").limit(0)
    for name, stage in cp.STAGES:
        docs = cp.written(stage(spark, docs, where), f"empty-{name}")
    assert docs.count() == 0
