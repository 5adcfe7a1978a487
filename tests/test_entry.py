import os
import shutil
import subprocess
import sys

import pytest

import __spark_entry__ as entry
from bitlark.plans import registry
from bitlark.plans.explain import explain
from conftest import ROOT, rows_of


def test_flagship(spark, data):
    rows = entry.entry(spark).collect()
    assert [r["rank"] for r in rows] == list(range(1, 11)) and rows[0].doc_id == 0 and rows[0].score == 0


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, data, duck, name):
    got = registry.queries()[name](spark, data).toPandas()
    sql = registry.oracle_sql().get(name)
    if sql is None:
        assert len(got)
        return
    want = duck.execute(sql).df()
    assert dict(got.dtypes) == {c: want[c].dtype for c in got.columns} and set(got.columns) == set(want.columns)
    assert rows_of(got) == rows_of(want)


def test_explain_plan_over_blocks_of_unequal_weights(spark, tmp_path):
    """Three blocks of weights 4 to 10, 20 and 40 to 41."""
    import duckdb

    weights = {0: 4, 3: 10, 1 << 16: 20, 2 << 16: 40, (2 << 16) + 7: 41}
    rows = [(i, [1.0] * w + [-1.0] * (64 - w), 0) for i, w in weights.items()]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = registry.queries()["explain_plan"](spark, str(tmp_path)).toPandas()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    want = con.execute(registry.oracle_sql()["explain_plan"]).df()
    assert dict(got.dtypes) == {c: want[c].dtype for c in got.columns} and rows_of(got) == rows_of(want)
    assert (got.blocks[0], got.block_weight_spread[0]) == (3, 37)
    # the operator keeps the mean of the blocks beside it, and has neither without statistics
    index = registry._sign_index(spark, str(tmp_path))
    facts = explain(index.search((1,))).first()
    assert (facts.blocks_with_stats, facts.block_weight_spread, facts.weight_spread) == (0, None, None)
    index.refresh_stats()
    facts = explain(index.search((1,))).first()
    assert (facts.blocks_with_stats, facts.block_weight_spread, facts.weight_spread) == (3, 2, 37)


def test_works_without_the_llm_folders(tmp_path):
    for x in ("bitlark", "__spark_entry__.py"):
        (shutil.copytree if os.path.isdir(f"{ROOT}/{x}") else shutil.copy)(f"{ROOT}/{x}", tmp_path / x)
    shutil.rmtree(tmp_path / "bitlark" / "llm", ignore_errors=True)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'search_hamming' in q and not [x for x in q if x[:2] == 'op' or x == 'pipeline']; assert set(e.oracle_sql()) <= set(q)"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, check=True, timeout=120)
