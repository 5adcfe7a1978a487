import hashlib
from collections import defaultdict

from bitlark.llm import line_dedup
from tests.llm.helpers import clashing, frame, odd_rows

BLANK = " \t\n\x0b\x0c\r"


def brute(rows):
    holders = defaultdict(set)
    key = lambda x: "".join(c.lower() if "A" <= c <= "Z" else c for c in x.strip(BLANK))
    for d, t, *_ in rows:
        for x in (t or "").split("\n"):
            if len(key(x)) >= 40 and d is not None:
                holders[key(x)].add(d)
    keep = {k: max(v) for k, v in holders.items() if len(v) >= 5}
    out = []
    for d, t, *_ in rows:
        lines = (t or "").split("\n")
        left = [x for x in lines if key(x) not in keep or keep[key(x)] == d]
        out.append((d, len(lines), len(lines) - len(left), hashlib.sha256("\n".join(left).encode()).hexdigest()))
    return sorted(out, key=repr)


def test_against_brute_force(spark):
    common, other = "A Common Line that is longer than forty code points é", "another line of forty code points or more, in four"
    rows = odd_rows()
    for i in range(20, 27):
        rows.append((i, f"own {i}\n  {common.upper() if i % 2 else common}\t\nend{i}\n{common.replace('A C', 'a c')}"))
    rows += [(i, other) for i in (30, 31, 32, 33)] + [(33, other), (34, other + "É"), (35, other + "é")] + [(26, f"second row of an id\n{common}"), (None, common)]
    got = line_dedup.digest(frame(spark, rows))
    assert sorted(map(tuple, got.collect()), key=repr) == brute(rows)


def test_empty_and_extra_columns(spark):
    none = frame(spark, odd_rows()).limit(0)
    assert line_dedup.digest(none).count() == 0
    df = clashing(frame(spark, odd_rows()))
    out = line_dedup.stage(df)
    assert out.columns == df.columns and out.count() == df.count()


def test_plan_is_native(spark):
    plan = line_dedup.digest(frame(spark, [(1, "a")]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan


def test_driver_tables(spark, data, duck):
    from conftest import rows_of

    got = line_dedup.digest(spark.read.parquet(f"{data}/documents.parquet")).toPandas()
    assert rows_of(got) == rows_of(duck.execute(line_dedup.SQL).df())
