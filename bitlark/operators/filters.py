"""The boolean filter algebra and its compilation to one predicate or to semi joins.

A tree becomes one Column over flags of the terms it names. The flags come from one pass over the
attributes of those terms, grouped by document, joined once. Trees that are only positive terms
under And need no flags: they are semi joins. Everything is intersected with the live documents.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.codes import check_term

#: Longer id lists are joined, not inlined.
INLINE_IDS = 1000


class Filter:
    def __and__(self, other: Filter) -> Filter:
        return And((self, other))

    def __or__(self, other: Filter) -> Filter:
        return Or((self, other))

    def __invert__(self) -> Filter:
        return Not(self)


@dataclass(frozen=True)
class All(Filter):
    pass


@dataclass(frozen=True)
class Nothing(Filter):
    pass


@dataclass(frozen=True)
class Term(Filter):
    term: int


@dataclass(frozen=True)
class Ids(Filter):
    ids: tuple[int, ...]

    def __init__(self, ids: Sequence[int]) -> None:
        object.__setattr__(self, "ids", tuple(ids))


@dataclass(frozen=True)
class IdRange(Filter):
    """Half-open; empty if lo >= hi."""

    lo: int
    hi: int


@dataclass(frozen=True)
class And(Filter):
    """No parts: everything live."""

    parts: tuple[Filter, ...] = field(default=())

    def __init__(self, parts: Sequence[Filter] = ()) -> None:
        object.__setattr__(self, "parts", tuple(parts))


@dataclass(frozen=True)
class Or(Filter):
    """No parts: nothing."""

    parts: tuple[Filter, ...] = field(default=())

    def __init__(self, parts: Sequence[Filter] = ()) -> None:
        object.__setattr__(self, "parts", tuple(parts))


@dataclass(frozen=True)
class Not(Filter):
    part: Filter


def _walk(f: Filter):
    yield f
    for p in getattr(f, "parts", ()) or ((f.part,) if isinstance(f, Not) else ()):
        yield from _walk(p)


def terms(f: Filter) -> list[int]:
    """Distinct terms of a tree; each is checked before anything is read."""
    return sorted({check_term(x.term) for x in _walk(f) if isinstance(x, Term)})


def _flag(term: int) -> str:
    return f"_t{term}"


_MOST = (1 << 63) - 1


def predicate(f: Filter, listed: dict[tuple[int, ...], str] | None = None) -> Column:
    """One boolean Column over doc_id and the flags of the terms. ``listed``: flags of joined id lists."""
    listed = listed or {}
    doc = F.col("doc_id")
    if isinstance(f, All):
        return F.lit(True)
    if isinstance(f, Nothing):
        return F.lit(False)
    if isinstance(f, Term):
        return F.coalesce(F.col(_flag(f.term)), F.lit(False))
    if isinstance(f, Ids):
        if f.ids in listed:
            return F.coalesce(F.col(listed[f.ids]), F.lit(False))
        inside = [i for i in dict.fromkeys(f.ids) if 0 <= i <= _MOST]
        return doc.isin(inside) if inside else F.lit(False)
    if isinstance(f, IdRange):
        if f.lo >= f.hi or f.lo > _MOST:
            return F.lit(False)
        low = doc >= F.lit(f.lo)
        return low if f.hi > _MOST else low & (doc < F.lit(f.hi))
    if isinstance(f, And):
        return reduce(lambda a, b: a & b, [predicate(p, listed) for p in f.parts], F.lit(True))
    if isinstance(f, Or):
        return reduce(lambda a, b: a | b, [predicate(p, listed) for p in f.parts], F.lit(False))
    if isinstance(f, Not):
        return ~predicate(f.part, listed)
    raise TypeError(f"not a filter: {f!r}")


def memberships(attrs: DataFrame, wanted: list[int]) -> DataFrame:
    """doc_id and one boolean flag for each wanted term."""
    flags = [F.max(F.col("term") == t).alias(_flag(t)) for t in wanted]
    return attrs.where(F.col("term").isin(wanted)).groupBy("doc_id").agg(*flags)


def _positive(f: Filter) -> list[Filter] | None:
    """The parts of a top-level And in which terms occur only as parts, else None."""
    parts = list(f.parts) if isinstance(f, And) else [f]
    return parts if all(isinstance(p, Term) or not terms(p) for p in parts) else None


def admitted(docs: DataFrame, attrs: DataFrame | None, f: Filter) -> DataFrame:
    """The live documents that the filter admits, with the columns of ``docs``."""
    wanted = terms(f)
    columns = docs.columns
    listed: dict[tuple[int, ...], str] = {}
    for n, x in enumerate(x for x in _walk(f) if isinstance(x, Ids) and len(x.ids) > INLINE_IDS):
        if x.ids not in listed:
            listed[x.ids] = f"_i{n}"
            ids = docs.sparkSession.createDataFrame([(i,) for i in dict.fromkeys(x.ids) if 0 <= i <= _MOST], T.StructType([T.StructField("doc_id", T.LongType(), False)]))
            docs = docs.join(ids.withColumn(listed[x.ids], F.lit(True)), "doc_id", "left")
    if wanted and attrs is None:
        attrs = docs.sparkSession.createDataFrame([], "doc_id long, term int")
    parts = _positive(f)
    if wanted and parts is not None:
        rest = [predicate(p, listed) for p in parts if not isinstance(p, Term)]
        docs = docs.where(reduce(lambda a, b: a & b, rest, F.lit(True)))
        for t in wanted:
            docs = docs.join(attrs.where(F.col("term") == t).select("doc_id"), "doc_id", "left_semi")
        return docs.select(*columns)
    if wanted:
        docs = docs.join(memberships(attrs, wanted), "doc_id", "left")
    return docs.where(predicate(f, listed)).select(*columns)


def model(f: Filter, live: set[int], tags: dict[int, set[int]]) -> set[int]:
    """Set-algebra meaning of a filter, for tests and small uses."""
    if isinstance(f, All):
        return set(live)
    if isinstance(f, Nothing):
        return set()
    if isinstance(f, Term):
        return live & tags.get(f.term, set())
    if isinstance(f, Ids):
        return live & set(f.ids)
    if isinstance(f, IdRange):
        return {i for i in live if f.lo <= i < f.hi}
    if isinstance(f, And):
        return reduce(lambda a, b: a & b, [model(p, live, tags) for p in f.parts], set(live))
    if isinstance(f, Or):
        return reduce(lambda a, b: a | b, [model(p, live, tags) for p in f.parts], set())
    return live - model(f.part, live, tags)


def at_most(f: Filter) -> int | None:
    """An upper bound of the documents that a filter admits, from its own ids; None if it has none."""
    if isinstance(f, Nothing):
        return 0
    if isinstance(f, Ids):
        return len(set(f.ids))
    if isinstance(f, IdRange):
        return max(0, f.hi - f.lo)
    if isinstance(f, (And, Or)):
        parts = [at_most(p) for p in f.parts]
        if isinstance(f, Or):
            return None if None in parts else sum(parts)
        return min((p for p in parts if p is not None), default=None)
    return None
