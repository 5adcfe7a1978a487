"""Substring dedup by content-defined chunks.

A gear hash rolls over the normalised UTF-8 bytes of each text (words, A-Z lower-cased, one blank after each; places map back to the text):
h = 2 h + G[byte] modulo 2**16, so it depends on the last 16 bytes; a word's hash leaves out what stands before the word. Of every ``WINDOW`` consecutive
words the one of the least hash, of equal ones the last, begins a chunk (winnowing), repeated words included; an insertion moves only the cuts next to it.
A chunk is the ``LENGTH`` words from its cut on, known by a 64-bit digest, so chunks overlap; where a text has fewer words left no chunk begins.

A chunk is repeated if texts of two doc_ids or more hold it. Windows inside a common passage choose the same words in every text. So of every ``MIN_WORDS`` = 51 = ``WINDOW`` - 1 + ``LENGTH``
common words one of the first ``WINDOW`` begins a chunk that lies within them: all repeats of over 50 words are found, whatever the words are,
and nothing is marked but words that another document holds in a stretch of ``LENGTH`` = 44 or more. A common passage of 44 to 50 words may be marked, depending on its cuts.
Repeated chunks that meet or overlap are one passage, which reaches to within ``WINDOW`` - 1 words of both its true ends; those words stay where they are. The least doc_id that
holds a chunk keeps it; other documents drop it. Each word dropped stands in a document of a lesser doc_id, and at last in one that keeps it.

Scale: digests, ids and places are shuffled, never texts (about 27 bytes of text make one row of 32). Counting combines on
the map side; the join back is a plain equi-join on the digest that adaptive execution may split where a passage is in a third of
all documents. Passages are found per document from its repeated chunks only. Texts that lose passages are cut by a second scan.

Edge cases: null and empty texts have no chunks; repeated rows of one doc_id are not a repeat across documents; a row without doc_id neither
counts nor drops; an empty table gives an empty table. Ties (the same passage twice in one document) follow the same rule. Whole texts are chunked. Extra columns pass ``drop``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WORD_BYTES, mix, span_hashes, text_slices, written

WINDOW = 8
MIN_WORDS = 51
LENGTH = MIN_WORDS - (WINDOW - 1)
#: Gear table, from a rule.
GEAR = (mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) & np.uint64(0xFFFF)).astype(np.uint16)


def gear(raw: np.ndarray) -> np.ndarray:
    """h[i] = sum over k < 16 of G[raw[i - k]] << k, modulo 2**16; by doubling."""
    h = GEAR[raw]
    for step in (1, 2, 4, 8):
        more = h.copy()
        more[step:] += h[:-step] << np.uint16(step) if len(h) > step else h[:0]
        h = more
    return h


def word_gear(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The gear hash at the end of each word, of the word's bytes only (its last 16 at most)."""
    h = gear(raw)
    size = ends - starts
    before = np.where((starts > 0) & (size < 16), h[starts - 1], 0).astype(np.uint16)
    return h[ends - 1] - (before << np.minimum(size, 15).astype(np.uint16))


def cuts(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Words that begin a chunk; first: the first word of each row (n + 1)."""
    n = len(hashes)
    if n < WINDOW:
        return np.zeros(0, np.int64)
    # of equal hashes the later word is the less
    low = (hashes.astype(np.int64) << 40) + (n - 1 - np.arange(n))
    reach, size = 1, 1
    while size < WINDOW:
        reach = min(size, WINDOW - size)
        low, size = np.minimum(low[:-reach], low[reach:]), size + reach
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    chosen = low[row[: n - WINDOW + 1] == row[WINDOW - 1 :]]  # windows inside one row
    return np.unique(n - 1 - (chosen & ((1 << 40) - 1)))


def normal(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words with one blank after each, as bytes; the offsets of the rows in them; the original place of each byte."""
    low = WORD_BYTES[raw]
    word = low > 0
    after = np.concatenate(([False], word[:-1])) if len(raw) else word
    after[offsets[:-1][np.diff(offsets) > 0]] = False
    keep = np.flatnonzero(word | after)
    return np.where(word, low, 32)[keep].astype(np.uint8), np.searchsorted(keep, offsets), keep


def chunks(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, digest, and first and end byte in the row's text of each chunk, in order."""
    text, own, place = normal(raw, offsets)
    inside = text != 32
    edge = np.zeros(len(text) + 1, bool)
    edge[own] = True
    begins = np.flatnonzero(inside & (~np.concatenate(([False], inside))[:-1] | edge[:-1]))
    stops = np.flatnonzero(inside & (~np.concatenate((inside, [False]))[1:] | edge[1:])) + 1
    of_row = np.searchsorted(begins, own)
    at = cuts(word_gear(text, begins, stops) if len(text) else np.zeros(0, np.uint16), of_row)
    row = np.searchsorted(of_row, at, side="right") - 1
    whole = at + LENGTH <= of_row[row + 1]
    at, row = at[whole], row[whole]
    starts, ends = begins[at], stops[at + LENGTH - 1]
    return row, span_hashes(text, starts, ends), place[starts] - offsets[row], place[ends - 1] + 1 - offsets[row]


def _rows(batches):
    """doc_id, hash of the text, digest, first byte, end."""
    for batch in batches:
        for at, end, raw, offsets in text_slices(batch.column(2)):
            row, digest, start, stop = chunks(raw, offsets)
            ids = batch.column(0).slice(at, end - at).take(pa.array(row))
            key = batch.column(1).slice(at, end - at).take(pa.array(row))
            yield pa.RecordBatch.from_arrays(
                [ids, key, pa.array(digest.view(np.int64)), pa.array(start.astype(np.int32)), pa.array(stop.astype(np.int32))],
                names=["id", "th", "digest", "start", "stop"],
            )


def _pairs(batches):
    """Digests of each text once."""
    for batch in batches:
        for at, end, raw, offsets in text_slices(batch.column(1)):
            row, digest, _, _ = chunks(raw, offsets)
            order = np.lexsort((digest, row))
            row, digest = row[order], digest[order]
            new = np.concatenate(([True], (row[1:] != row[:-1]) | (digest[1:] != digest[:-1]))) if len(row) else np.zeros(0, bool)
            ids = batch.column(0).slice(at, end - at).take(pa.array(row[new]))
            yield pa.RecordBatch.from_arrays([ids, pa.array(digest[new].view(np.int64))], names=["id", "digest"])


def repeats(docs: DataFrame) -> DataFrame:
    """(id, th, spans): byte ranges of repeated passages of each text that has one.

    spans: array<struct<first, stop, keeper, drop>>, a range for each stretch of one keeper; drop says that another document keeps it.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    known = docs.where("doc_id IS NOT NULL")
    seen = (
        known.select("doc_id", "text").mapInArrow(_pairs, f"id {kind}, digest long")
        .groupBy("digest").agg(F.min("id").alias("low"), F.max("id").alias("high"))
        .where("low <> high").select("digest", F.col("low").alias("keeper"))
    )
    seen = written(seen, "chunks")
    base = known.select("doc_id", F.xxhash64("text").alias("th"), "text")
    rows = base.mapInArrow(_rows, f"id {kind}, th long, digest long, start int, stop int")
    mine = rows.join(seen, "digest").groupBy("id", "th").agg(F.array_sort(F.collect_set(F.struct("start", "stop", "keeper"))).alias("c"))

    def run(batches):
        for batch in batches:
            ids, lists = batch.column(0), batch.column(2)
            ends = np.diff(lists.offsets.to_numpy())
            flat = lists.flatten()
            doc = np.repeat(np.arange(len(ids)), ends)
            start, stop = (flat.field(i).to_numpy().astype(np.int64) for i in range(2))
            # ids as numbers, so keepers of any type compare as arrays
            both = pa.chunked_array([ids, flat.field(2)]).combine_chunks().dictionary_encode().indices.to_numpy()
            own, keeper = both[: len(ids)][doc], both[len(ids) :]
            apart = np.ones(len(doc), bool)
            apart[1:] = (doc[1:] != doc[:-1]) | (start[1:] > stop[:-1])
            # a stretch: chunks of one passage and one keeper; it ends where the next one of the passage begins
            cut = apart.copy()
            cut[1:] |= keeper[1:] != keeper[:-1]
            first = np.flatnonzero(cut)
            last = np.append(first[1:], len(doc)) - 1 if len(doc) else first
            until = stop[last]
            until[:-1] = np.where(apart[first[1:]], until[:-1], start[first[1:]])
            spans = pa.StructArray.from_arrays(
                [pa.array(start[first], pa.int32()), pa.array(until, pa.int32()), flat.field(2).take(pa.array(first)), pa.array(keeper[first] != own[first])],
                names=["first", "stop", "keeper", "drop"],
            )
            offsets = np.concatenate(([0], np.cumsum(np.bincount(doc[first], minlength=len(ids)))))
            yield pa.RecordBatch.from_arrays([ids, batch.column(1), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), spans)], names=["id", "th", "spans"])

    spans = f"id {kind}, th long, spans array<struct<first:int,stop:int,keeper:{kind},drop:boolean>>"
    return mine.select("id", "th", "c").mapInArrow(run, spans)


def drop(docs: DataFrame) -> DataFrame:
    """``docs`` without the passages that another document keeps, and _sd_spans, the repeated passages (null if none)."""
    schema, cols = docs.schema, docs.columns
    found = written(repeats(docs), "passages").withColumnsRenamed({"id": "_sd_id", "th": "_sd_th", "spans": "_sd_spans"})
    met = docs.join(found, (F.col("doc_id") == F.col("_sd_id")) & (F.xxhash64("text") == F.col("_sd_th")), "left").select(*cols, "_sd_spans")
    place = cols.index("text")

    def run(batches):
        for batch in batches:
            texts = []
            for text, spans in zip(batch.column(place).to_pylist(), batch.column(len(cols)).to_pylist(), strict=True):
                if spans and any(s["drop"] for s in spans):
                    raw, at, kept = text.encode(), 0, []
                    for s in spans:
                        if s["drop"]:
                            kept.append(raw[at : _whole(raw, s["first"])])
                            at = _whole(raw, s["stop"])
                    text = b"".join([*kept, raw[at:]]).decode()
                texts.append(text)
            arrays = list(batch.columns)
            arrays[place] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(arrays, names=batch.schema.names)

    return met.mapInArrow(run, T.StructType([*schema.fields, met.schema["_sd_spans"]]))


def _whole(raw: bytes, at: int) -> int:
    """The next boundary of a code point."""
    while at < len(raw) and raw[at] & 0xC0 == 0x80:
        at += 1
    return at


def digest(docs: DataFrame) -> DataFrame:
    """One row a document: doc_id, repeated (any passage), n_passages, repeated_bytes, dropped_bytes, kept_by (list of doc_ids)."""
    found = repeats(docs.select("doc_id", "text"))
    size = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + x["stop"] - x["first"])
    facts = found.select(
        F.col("id").alias("_id"), F.col("th").alias("_th"),
        F.size("spans").cast("long").alias("n"), size("spans").alias("rep"), size(F.filter("spans", lambda x: x["drop"])).alias("gone"),
        F.array_sort(F.array_distinct(F.transform(F.filter("spans", lambda x: x["drop"]), lambda x: x["keeper"]))).alias("kept"),
    )
    ids = docs.select("doc_id", F.xxhash64("text").alias("th"))
    met = ids.join(facts, (F.col("doc_id") == F.col("_id")) & (F.col("th") == F.col("_th")), "left")
    zero = F.lit(0).cast("long")
    return met.select(
        "doc_id", F.col("n").isNotNull().alias("repeated"), F.coalesce("n", zero).alias("n_passages"), F.coalesce("rep", zero).alias("repeated_bytes"),
        F.coalesce("gone", zero).alias("dropped_bytes"), F.coalesce("kept", F.array().cast(met.schema["kept"].dataType)).alias("kept_by"),
    )
