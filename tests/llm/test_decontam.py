import hashlib

import pytest

from bitlark.llm import decontam
from tests.llm.helpers import WORD, clashing, frame, lorem, lower, odd_rows, words


def brute(rows, items):
    wins: dict = {}
    for item, text in items:
        x = words(text)
        n = min(10, len(x))
        for i in range(len(x) - n + 1 if n else 0):
            wins.setdefault(tuple(x[i : i + n]), set()).add(str(item))
    out = []
    for d, t, *_ in rows:
        w = words(t)
        hit, found = set(), set()
        for n in {len(x) for x in wins}:
            for i in range(len(w) - n + 1):
                owners = wins.get(tuple(w[i : i + n]))
                if owners:
                    hit |= set(range(i, i + n))
                    found |= owners
        out.append((d, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


def case(spark):
    items = [(i, " ".join(lorem(i, 14 + i))) for i in range(12)] + [(20, "only four words here"), (21, "only four words here"), (22, None), (23, "…!"), (24, "solo987"), (25, " ".join(lorem(3, 12)))]
    rows = odd_rows()
    for i in range(12):
        part = lorem(i, 14 + i)[i % 4 : i % 4 + 10 + i % 2]
        rows.append((100 + i, "Before: " + " -- ".join(part).upper() + "; after " + " ".join(lorem(i, 9)[:9])))
    rows += [(200, "we have Only four, words here and solo987."), (201, "xsolo987 solo987x"), (202, " ".join(lorem(4, 18) + lorem(4, 18)))]
    return rows, items, frame(spark, rows), spark.createDataFrame(items, "item_id long, text string")


def test_against_brute_force(spark):
    rows, items, docs, bench = case(spark)
    assert sorted(map(tuple, decontam.digest(docs, bench).collect()), key=repr) == brute(rows, items)


def test_blocks_give_the_same(spark):
    rows, items, docs, bench = case(spark)
    one = {(r.doc_id, tuple(r.runs), tuple(sorted(r["items"]))) for r in decontam.scanned(docs, bench).collect()}
    many = {(r.doc_id, tuple(r.runs), tuple(sorted(r["items"]))) for r in decontam.scanned(docs, bench, block_bytes=120_000).collect()}
    assert one == many and any(r for _, r, _ in one)


def test_offsets():
    text = "É! One, TWO three—four 😀"
    assert [text[a:b] for a, b in decontam.contaminated_spans(text, [1, 3])] == ["One, TWO"]
    assert [m[0] for m in WORD.finditer(lower(text))] == words(text)


def test_empty_and_stage(spark):
    rows, items, docs, bench = case(spark)
    df = clashing(docs)
    clean = {r[0] for r in brute(rows, items) if not r[5]}
    out = decontam.stage(df, bench)
    assert out.columns == df.columns and {r.doc_id for r in out.collect()} == clean
    assert decontam.digest(docs.limit(0), bench).count() == 0
    assert not any(r.contaminated for r in decontam.digest(docs, bench.limit(0)).collect())
    assert decontam.stage(df, bench.limit(0)).count() == len(rows)


def test_items_without_an_id(spark):
    duckdb = pytest.importorskip("duckdb")
    a, b, c = lorem(51, 12), lorem(52, 12), lorem(53, 12)
    items = [(None, " ".join(a)), (7, " ".join(b)), (None, " ".join(c)), (None, None)]
    rows = [(1, "so " + " ".join(a)), (2, " ".join(a + b)), (3, " ".join(b)), (4, " ".join(a + c)), (5, "clean")]
    docs, bench = frame(spark, rows), spark.createDataFrame(items, "item_id long, text string")
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = [(1, 13, 12, 1, sha(""), True), (2, 24, 24, 2, sha("7"), True), (3, 12, 12, 1, sha("7"), True), (4, 24, 24, 1, sha(""), True), (5, 1, 0, 0, sha(""), False)]
    got = decontam.digest(docs, bench)
    assert sorted(map(tuple, got.collect())) == want
    con = duckdb.connect()
    for name, df in (("documents", docs.toPandas()), ("benchmark", bench.toPandas().astype({"item_id": "Int64"}))):
        con.register(name, df)
    assert sorted(con.execute(decontam.SQL).fetchall()) == want
    many = decontam.scanned(docs, bench, block_bytes=3000).collect()
    assert {r.doc_id: set(r["items"]) for r in many} == {1: {None}, 2: {None, "7"}, 3: {"7"}, 4: {None}, 5: set()}
    assert [r.doc_id for r in decontam.stage(docs, bench).collect()] == [5]


def test_driver_tables(spark, data, duck):
    pytest.importorskip("duckdb")
    from conftest import rows_of

    got = decontam.digest(spark.read.parquet(f"{data}/documents.parquet"), spark.read.parquet(f"{data}/benchmark.parquet")).toPandas()
    assert rows_of(got) == rows_of(duck.execute(decontam.SQL).df())


def test_ids_of_any_type_and_a_long_item(spark):
    """Text ids; an item of 30,000 words in blocks; a document that holds its end."""
    long = [f"q{i}" for i in range(30_000)]
    bench = spark.createDataFrame([("a/1", " ".join(long)), ("b", "one two three")], "item_id string, text string")
    docs = spark.createDataFrame([("x/1", " ".join(long[-25:])), ("x/2", "say one two three"), (None, None)], "doc_id string, text string")
    assert list(decontam._blocks(bench, 10, 16 << 20))[-1][1] == 3
    got = {r.doc_id: (r.n_words, list(r.runs), list(r["items"])) for r in decontam.scanned(docs, bench, block_bytes=16 << 20).collect()}
    assert got == {"x/1": (25, [0, 25], ["a/1"]), "x/2": (4, [1, 4], ["b"]), None: (0, [], [])}
    assert decontam.digest(docs, bench).schema["doc_id"].dataType.simpleString() == "string"
