"""Command line: describe, search, search-vector, explain, count, create, refresh-stats, compact, fit."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from . import errors
from .functions import codes, fit, metrics
from .functions.residual import Model
from .operators import filters
from .plans.explain import explain
from .sources.store import Index
from .sources.vectors import read_f32


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="bitlark", description=__doc__)
    p.add_argument("--root", default=".")
    p.add_argument("--namespace", type=int)
    p.add_argument("--master", default="local[*]")
    sub = p.add_subparsers(dest="command", required=True)
    sub.add_parser("describe")
    for name in ("search", "explain"):
        s = sub.add_parser(name)
        s.add_argument("code", help="hex words, least significant first, comma-separated")
        s.add_argument("--metric", choices=metrics.METRICS, default="hamming")
        s.add_argument("--k", type=int, default=10)
        if name == "search":
            s.add_argument("--term", type=int, action="append", default=[])
    s = sub.add_parser("search-vector")
    s.add_argument("vector", help="comma-separated floats")
    s.add_argument("--model", required=True)
    s.add_argument("--k", type=int, default=10)
    s.add_argument("--term", type=int, action="append", default=[])
    sub.add_parser("count").add_argument("--term", type=int, action="append", default=[])
    s = sub.add_parser("create")
    s.add_argument("--dims", type=int, default=512)
    s.add_argument("--model")
    for name in ("refresh-stats", "compact"):
        sub.add_parser(name)
    sub.add_parser("acknowledge").add_argument("version", type=int)
    s = sub.add_parser("fit")
    s.add_argument("--input", required=True, help="row-major little-endian float32")
    s.add_argument("--dims", type=int, required=True)
    s.add_argument("--output", required=True)
    s.add_argument("--seed", type=int, default=42)
    return p


def _terms(found: list[int]) -> filters.Filter:
    return filters.And([filters.Term(t) for t in found])


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = _parser().parse_args(argv)
    spark = spark or SparkSession.builder.master(a.master).appName("bitlark").getOrCreate()
    try:
        _run(a, spark)
    except errors.IndexError_ as e:
        print(f"{errors.status(e)}: {e}", file=sys.stderr)
        return 1
    return 0


def _run(a: argparse.Namespace, spark: SparkSession) -> None:
    if a.command == "create":
        model = Model.load(a.model) if a.model else None
        print(Index.create(spark, a.root, a.dims, a.namespace, model).describe())
        return
    if a.command == "fit":
        done = fit.fit(read_f32(spark, a.input, a.dims).withColumnRenamed("row", "doc_id"), a.dims, a.seed)
        done.model.save(a.output)
        print(f"rows {done.rows} offset {done.model.norm_offset} step {done.model.norm_step} clipped {done.clipped} model {done.model.model_id.hex()}")
        return
    index = Index.open(spark, a.root, a.namespace, pending=a.command in ("compact", "acknowledge"))
    if a.command == "describe":
        for k, v in index.describe().items():
            print(k, v)
    elif a.command == "search":
        for r in index.search(codes.parse_hex(a.code), metric=a.metric, k=a.k, filter=_terms(a.term)).frame().orderBy("rank").collect():
            print(r["rank"], r.doc_id, r.score, r.inter, r.weight)
    elif a.command == "search-vector":
        query = Model.load(a.model).prepare([float(x) for x in a.vector.split(",")])
        for r in index.search_vector(query, a.k, _terms(a.term)).orderBy("rank").collect():
            print(r["rank"], r.doc_id, r.score)
    elif a.command == "explain":
        for k, v in explain(index.search(codes.parse_hex(a.code), metric=a.metric, k=a.k)).first().asDict().items():
            print(k, v)
    elif a.command == "count":
        print(index.count(_terms(a.term)))
    elif a.command == "refresh-stats":
        print(index.refresh_stats())
    elif a.command == "compact":
        version, table = index.compact()
        print(version, table.count())
    else:
        print(index.acknowledge(a.version))


if __name__ == "__main__":
    sys.exit(main())
