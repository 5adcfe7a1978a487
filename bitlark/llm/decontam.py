"""Benchmark decontamination with one Aho-Corasick automaton.

Texts are normalised to words: A-Z lower-cased, a word is a run of ASCII letters, digits and code
points from U+0080. A window is ``width`` consecutive words of a benchmark item; an item with fewer
words, but not none, is one window. All windows of all items make one automaton over word numbers
(a word's number is its place in the benchmark's vocabulary, in digits); a document's words are read
through it once. An occurrence is known by its last word; ``contaminated_spans`` maps words back to code points of
the original text.

Scale: documents are scanned where they are read, without a shuffle. The windows are made by Spark from the items; what their
automaton will take is counted first (``NODE_BYTES`` a word of a window, as measured, and ``OWNER_BYTES`` an item of one): up to
``block_bytes`` they travel to every worker as one broadcast; the windows of a larger benchmark, or of one very long item, are cut into blocks
of that size by hash, which are run one after another with the state (word runs, item ids) written to the shared folder in
between, so any number of items gives the same answer with bounded memory.

Edge cases: null and empty texts have no words and are clean; very long texts are scanned whole; items without words match nothing;
items with the same window are all reported; items with a null item_id are searched like all others and
reported as one item, which n_items counts and items_sha256 (of the other ids) leaves out; repeated rows give a row each; an empty benchmark leaves
all documents clean, an empty table is an empty result. A doc_id may have any type. Extra columns are not read.
"""

from __future__ import annotations

import itertools
import math
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD_BYTES, ascii_lower, written

WIDTH = 10
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Memory of an automaton: bytes a word of a window (49 a digit were measured) and bytes an item of a window.
NODE_BYTES, OWNER_BYTES = 128, 64
BLOCK_BYTES = 256 << 20
_NORMAL = bytes(int(b) or 32 for b in WORD_BYTES)


def normal(text: str | None) -> list[bytes]:
    """The words of a text."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_NORMAL).split()


def windows(benchmark: DataFrame, width: int = WIDTH, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(w array<string>, item string): the distinct windows of each item."""
    words = F.regexp_extract_all(ascii_lower(F.col(text_col)), F.lit(WORD), F.lit(0))
    rows = benchmark.where(F.col(text_col).isNotNull()).select(F.col(id_col).cast("string").alias("item"), words.alias("words")).where(F.size("words") > 0)
    n = F.least(F.lit(width), F.size("words"))
    return rows.select("item", F.explode(F.transform(F.sequence(F.lit(1), F.size("words") - n + 1), lambda i: F.slice("words", i, n))).alias("w")).distinct()


class Machine:
    """The automaton of a block of windows and its vocabulary.

    A word's number is written with as many digits as the vocabulary needs, so a node has 255 children at most (the library looks
    through them one by one); the digit 0 is for words that the vocabulary lacks.
    """

    def __init__(self, vocabulary: pa.Array, ids: np.ndarray, ends: np.ndarray, items: pa.Array) -> None:
        import ahocorasick

        self.digits = 1
        while 255**self.digits < len(vocabulary):
            self.digits += 1
        written_ = ["".join(chr(1 + i // 255**d % 255) for d in range(self.digits)) for i in range(len(vocabulary))]
        self.code = {w.encode("utf-8", "surrogatepass"): c for w, c in zip(vocabulary.to_pylist(), written_, strict=True)}
        self.machine = ahocorasick.Automaton()
        at = 0
        for end, item in zip(ends.tolist(), items.to_pylist(), strict=True):
            key = "".join([written_[i] for i in ids[at:end].tolist()])
            known = self.machine.get(key, None)
            if known is None:
                self.machine.add_word(key, (end - at, [item]))
            else:
                known[1].append(item)
            at = end
        if len(self.machine):
            self.machine.make_automaton()

    def scan(self, text: str | None) -> tuple[int, list[tuple[int, int]], set[str | None]]:
        """Number of words, merged runs of hit words [first, end), items with an occurrence."""
        words = normal(text)
        runs: list[list[int]] = []
        items: set[str | None] = set()
        if not words or not len(self.machine):
            return len(words), [], items
        digits = self.digits
        for last, (width, owners) in self.machine.iter("".join(map(self.code.get, words, itertools.repeat("\0" * digits)))):
            end, inside = divmod(last + 1, digits)
            if inside:  # digits of two words
                continue
            items.update(owners)
            first = end - width
            while runs and runs[-1][0] >= first:  # a longer window that ends here
                first = min(first, runs.pop()[0])
            if runs and runs[-1][1] >= first:
                runs[-1][1] = max(runs[-1][1], end)
            else:
                runs.append([first, end])
        return len(words), [(a, b) for a, b in runs], items


def _sorted(items: set[str | None]) -> list[str | None]:
    return sorted(items, key=lambda x: (x is None, x or ""))


def union_runs(a: list[tuple[int, int]], b: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for s, e in sorted([*a, *b]):
        if out and out[-1][1] >= s:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [(s, e) for s, e in out]


_BUILT: dict[str, Machine] = {}


def _blocks(benchmark: DataFrame, width: int, block_bytes: int) -> Iterator[tuple[int, int, object]]:
    """(block, blocks, function that gives its Machine in a worker): windows in blocks of about block_bytes of automaton, counted before anything is fetched."""
    spark = benchmark.sparkSession
    rows = windows(benchmark, width)
    total = rows.agg(F.sum(F.size("w").cast("long") * NODE_BYTES + OWNER_BYTES)).first()[0] or 0
    n = max(1, math.ceil(total / block_bytes))
    if n > 1:
        rows = written(rows, "windows")
    for b in range(n):
        part = rows.where(F.pmod(F.xxhash64("w", "item"), F.lit(n)) == b) if n > 1 else rows
        got = part.toArrow().combine_chunks()
        w, items = (got[c].combine_chunks() for c in ("w", "item"))
        flat = w.flatten().dictionary_encode()
        ends = np.cumsum(np.diff(w.offsets.to_numpy())) if len(w) else np.zeros(0, np.int64)
        sent = spark.sparkContext.broadcast((flat.dictionary, flat.indices.to_numpy().astype(np.int32), ends, items))
        key = uuid.uuid4().hex

        def machine(sent=sent, key=key) -> Machine:
            if key not in _BUILT:
                _BUILT.clear()
                _BUILT[key] = Machine(*sent.value)
            return _BUILT[key]

        yield b, n, machine


def scanned(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, block_bytes: int = BLOCK_BYTES, keep_text: bool = False) -> DataFrame:
    """doc_id, text (null unless keep_text), n_words, runs (flat first, end of hit word runs), items."""
    state = docs.select("doc_id", "text").withColumns(
        {"n_words": F.lit(None).cast("long"), "runs": F.array().cast("array<long>"), "items": F.array().cast("array<string>")}
    )
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, text string, n_words long, runs array<long>, items array<string>"
    for b, n, machine in _blocks(benchmark, width, block_bytes):
        last = b == n - 1

        def run(batches, machine=machine, last=last):
            m = machine()
            for batch in batches:
                counts, runs, found = [], [], []
                for text, old, had in zip(batch.column("text"), batch.column("runs").to_pylist(), batch.column("items").to_pylist(), strict=True):
                    c, r, i = m.scan(text.as_py())
                    counts.append(c)
                    runs.append([x for se in union_runs(list(zip(old[::2], old[1::2], strict=True)), r) for x in se])
                    found.append(_sorted(i.union(had)))
                text = batch.column("text") if keep_text or not last else pa.nulls(batch.num_rows, pa.string())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), text, pa.array(counts, pa.int64()), pa.array(runs, pa.list_(pa.int64())), pa.array(found, pa.list_(pa.string()))],
                    names=["doc_id", "text", "n_words", "runs", "items"],
                )

        state = state.mapInArrow(run, schema)
        if not last:
            state = written(state, "decontam")
    return state


def digest(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row a document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    hit = F.aggregate(
        F.transform("runs", lambda x, i: F.when(i % 2 == 1, x).otherwise(-x)), F.lit(0).cast("long"), lambda a, x: a + x
    )
    return scanned(docs, benchmark).select(
        "doc_id",
        "n_words",
        hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ",").cast("binary"), 256).alias("items_sha256"),
        (F.size("runs") > 0).alias("contaminated"),
    )


_WORD = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def contaminated_spans(text: str | None, runs: list[int]) -> list[tuple[int, int]]:
    """Hit word runs as [start, end) code points of the original text."""
    places = [m.span() for m in _WORD.finditer(text or "")]
    return [(places[s][0], places[e - 1][1]) for s, e in zip(runs[::2], runs[1::2], strict=True)]


def stage(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Pipeline form: documents that hold no window of the benchmark, with all their columns."""
    schema, place = docs.schema, docs.columns.index("text")
    for b, n, machine in _blocks(benchmark, WIDTH, BLOCK_BYTES):

        def run(batches, machine=machine):
            m = machine()
            for batch in batches:
                yield batch.filter(pa.array([not m.scan(t.as_py())[1] for t in batch.column(place)], pa.bool_()))

        docs = docs.mapInArrow(run, schema)
        if b < n - 1:
            docs = written(docs, "decontam")
    return docs


SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id::VARCHAR AS item_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), bw AS (
  SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS win
  FROM (SELECT item_id, w, least(10, len(w)) AS n, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)
), hits AS (
  SELECT dw.rid, dw.i, dw.n, bw.item_id
  FROM (SELECT rid, n, i, array_to_string(w[i:i + n - 1], ' ') AS win
        FROM (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n)) dw
  JOIN bw ON dw.win = bw.win AND dw.n = bw.n
), words AS (
  SELECT rid, count(DISTINCT p)::BIGINT AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS p FROM hits) GROUP BY rid
), items AS (
  SELECT rid, count(*)::BIGINT AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS s FROM (SELECT DISTINCT rid, item_id FROM hits) GROUP BY rid
)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(words.n_hit, 0) AS n_hit, coalesce(items.n_items, 0) AS n_items,
       sha256(coalesce(items.s, '')) AS items_sha256, coalesce(words.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (rid) LEFT JOIN items USING (rid)
"""
