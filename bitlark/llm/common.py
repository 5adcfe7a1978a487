"""Shared helpers: the shared work folder, checkpoints, Arrow text slices, word hashes."""

from __future__ import annotations

import contextlib
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import InvalidArgument
from ..sources.files import Files

MASK64 = (1 << 64) - 1
#: Base of the rolling word hash; odd, so it has an inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15 | 5
BASE_INV = pow(BASE, -1, 1 << 64)


def checkpoint_root(spark: SparkSession) -> str:
    """The cluster's shared folder (``spark.checkpoint.dir``).

    Where a session on one machine names none (tests, a laptop) a temporary folder is set once; a cluster must name one.
    """
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise InvalidArgument("spark.checkpoint.dir must name a folder that all executors share")
        root = tempfile.mkdtemp(prefix="bitlark-shared-")
        sc.setCheckpointDir(root)
    elif not sc.getCheckpointDir():
        sc.setCheckpointDir(root)
    return root


def work_path(spark: SparkSession, what: str) -> str:
    """A fresh folder below the shared root; ``scratch`` removes it."""
    path = f"{checkpoint_root(spark).rstrip('/')}/bitlark-{what}-{uuid.uuid4().hex}"
    if _OPEN:
        _OPEN[-1].append(path)
    return path


_OPEN: list[list[str]] = []


@contextlib.contextmanager
def scratch(spark: SparkSession, *more: str) -> Iterator[None]:
    """Removes at its end the work folders made inside, and ``more``; nothing may be read from them afterwards.

    Operators return lazy results that still read their work folders, so their caller closes the block, after an action.
    """
    _OPEN.append(list(more))
    try:
        yield
    finally:
        for path in _OPEN.pop():
            Files(spark).delete(path)


def written(df: DataFrame, what: str, path: str | None = None) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, read again: lineage ends here."""
    spark = df.sparkSession
    path = path or work_path(spark, what)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._work_path = path
    return out


def discard(df: DataFrame | None) -> None:
    """Removes the table of ``written`` that nothing reads any more."""
    if df is not None:
        Files(df.sparkSession).delete(df._work_path)


def text_of(col: str | Column = "text") -> Column:
    """A text with null read as empty."""
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def ascii_lower(c: Column) -> Column:
    """A-Z lower-cased, all other code points kept.

    ``lower`` is the fast path and says the same for pure ASCII.
    """
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, upper, lower))


# -- Arrow slices --------------------------------------------------------------


def text_slices(column: pa.Array, limit: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) for runs of rows of about ``limit`` bytes.

    A longer text is a slice of its own, whole. Null counts as empty.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    n = len(column)
    if not n:
        return
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        end = max(at + 1, int(np.searchsorted(off, off[at] + limit, side="right")) - 1)
        yield at, end, raw[off[at] : off[end]], off[at : end + 1] - off[at]
        at = end


# -- hashing -------------------------------------------------------------------


def mix(x: np.ndarray) -> np.ndarray:
    """The SplitMix64 finaliser, elementwise over uint64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Powers:
    """Tables of BASE**i and BASE**-i modulo 2**64, grown on demand."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def at_least(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(self.up):
            size = 1 << int(n - 1).bit_length()
            for name, b in (("up", BASE), ("down", BASE_INV)):
                steps = np.full(size, b & MASK64, np.uint64)
                steps[0] = 1
                setattr(self, name, np.cumprod(steps, dtype=np.uint64))
        return self.up, self.down


POWERS = Powers()


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of values[s:e] for each span, the same wherever the span stands."""
    up, down = POWERS.at_least(len(values) + 1)
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum((values.astype(np.uint64) + np.uint64(1)) * up[: len(values)], dtype=np.uint64, out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64) * np.uint64(0xD1B54A32D192ED03))


def _word_table() -> np.ndarray:
    table = np.zeros(256, np.uint8)
    for b in range(256):
        c = chr(b)
        if b >= 0x80 or "0" <= c <= "9" or "a" <= c <= "z":
            table[b] = b
        elif "A" <= c <= "Z":
            table[b] = b + 32
    return table


#: Byte to byte: lower-cased ASCII letters, digits and all bytes from 0x80; 0 between words.
WORD_BYTES = _word_table()


def words_of(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and 64-bit hashes of all words of a slice, and the first word of each row (n + 1)."""
    low = WORD_BYTES[raw]
    inside = low > 0
    edge = np.zeros(len(raw) + 1, bool)
    edge[offsets] = True
    before = np.concatenate(([False], inside[:-1])) if len(raw) else inside
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    after = np.concatenate((inside[1:], [False])) if len(raw) else inside
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return starts, ends, span_hashes(low, starts, ends), np.searchsorted(starts, offsets)
