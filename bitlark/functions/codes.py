"""Bit codes: words, positions, weights, intersections.

Codes are little-endian in 64-bit words. Up to ``MAX_COLUMNS`` words are columns w0, w1, ...; wider codes
are one ARRAY<BIGINT> column ``words``. Words are unsigned 64-bit values held in signed longs.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import AttrTermTooLarge, DimensionMismatch, DocIdTooLarge, InvalidArgument, ReservedDocId, TooManyDimensions

MAX_DIMS = 65_536
MAX_DOC_ID = (1 << 36) - 1
MAX_TERM = (1 << 20) - 1
BLOCK_BITS = 16
MAX_COLUMNS = 64
_U64 = (1 << 64) - 1


def check_dims(dims: int) -> int:
    if dims == 0:
        raise DimensionMismatch(1, 0)
    if dims > MAX_DIMS:
        raise TooManyDimensions(dims, MAX_DIMS)
    return dims


def check_doc_id(doc_id: int) -> int:
    if doc_id == _U64:
        raise ReservedDocId("the largest 64-bit id is reserved")
    if not 0 <= doc_id <= MAX_DOC_ID:
        raise DocIdTooLarge(doc_id, MAX_DOC_ID)
    return doc_id


def check_term(term: int) -> int:
    if not 0 <= term <= MAX_TERM:
        raise AttrTermTooLarge(term, MAX_TERM)
    return term


def words_for(dims: int) -> int:
    return -(-dims // 64)


def row_bits(dims: int) -> int:
    return 64 * words_for(dims)


def rows_per_block(dims: int) -> int:
    return (1 << BLOCK_BITS) // row_bits(dims)


def crossover(m: int, dims: int) -> int:
    """Live documents for each admitted one from which fetching rows beats a scan, by the share of set bits in the query."""
    share = m / max(dims, 1)
    return 11 if share >= 0.40 else 256 if share >= 0.10 else 512


def row_base(doc_id: int, dims: int) -> tuple[int, int]:
    """Block of rows and first bit in it of a document's forward row."""
    per = rows_per_block(dims)
    return doc_id // per, ((doc_id // per) << BLOCK_BITS) + doc_id % per * row_bits(dims)


def binary_weight(code: Column, size: int) -> Column:
    """Set bits of a binary column of ``size`` bytes, a multiple of 8."""
    words = F.transform(F.sequence(F.lit(0), F.lit(size // 8 - 1)), lambda i: F.bit_count(F.conv(F.hex(F.substring(code, i * 8 + 1, F.lit(8))), 16, -10).cast("long")))
    return F.aggregate(words, F.lit(0), lambda a, x: a + x)


def complement_planes(dims: int) -> int:
    """Planes that hold D - w: the bit length of the width."""
    return dims.bit_length()


def signed(word: int) -> int:
    word &= _U64
    return word - (1 << 64) if word >> 63 else word


def masked(words: Sequence[int], dims: int) -> list[int]:
    """Unsigned words of exactly the index's width; bits at or over ``dims`` are dropped."""
    out = []
    for i in range(words_for(dims)):
        word = (words[i] if i < len(words) else 0) & _U64
        left = dims - 64 * i
        out.append(word if left >= 64 else word & ((1 << left) - 1))
    return out


def ascending(positions: Sequence[int]) -> list[int]:
    """Sparse positions, refused unless strictly ascending and not negative."""
    p = list(positions)
    if any(x < 0 for x in p) or any(a >= b for a, b in zip(p, p[1:], strict=False)):
        raise InvalidArgument("positions of a sparse code have to grow from one to the next")
    return p


def to_words(positions: Iterable[int], dims: int) -> list[int]:
    out = [0] * words_for(dims)
    for p in positions:
        if 0 <= p < dims:
            out[p // 64] |= 1 << (p % 64)
    return out


def to_positions(words: Sequence[int], dims: int) -> list[int]:
    """Set bits below ``dims``, ascending."""
    return [64 * i + b for i, w in enumerate(masked(words, dims)) for b in range(64) if w >> b & 1]


def popcount(words: Sequence[int]) -> int:
    return sum((w & _U64).bit_count() for w in words)


def parse_hex(text: str) -> list[int]:
    """Comma-separated hex words, least significant first."""
    try:
        words = [int(x.strip(), 16) for x in text.split(",")]
    except ValueError as e:
        raise InvalidArgument(f"not hex words: {text!r}") from e
    if any(w > _U64 for w in words):
        raise InvalidArgument("a word has more than 64 bits")
    return words


# -- columns -------------------------------------------------------------------


def is_wide(df: DataFrame) -> bool:
    return "words" in df.columns


def word_columns(df: DataFrame) -> list[str]:
    return sorted((c for c in df.columns if c[:1] == "w" and c[1:].isdigit()), key=lambda c: int(c[1:]))


def _sum(terms: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, terms) if terms else F.lit(0)


def weight_of(df: DataFrame) -> Column:
    if is_wide(df):
        return F.aggregate("words", F.lit(0), lambda a, w: a + F.bit_count(w))
    return _sum([F.bit_count(c) for c in word_columns(df)]).cast("int")


def intersect_columns(df: DataFrame, query: Sequence[int]) -> Column:
    """popcount(code AND query) as one codegen expression; words where the query is 0 aren't read."""
    if is_wide(df):
        return intersect_arrays(F.col("words"), F.array(*[F.lit(signed(w)) for w in query]))
    cols = word_columns(df)
    return _sum([F.bit_count(F.col(c).bitwiseAND(F.lit(signed(w)))) for c, w in zip(cols, query, strict=False) if w]).cast("int")


def intersect_arrays(a: Column, b: Column) -> Column:
    """The higher-order form over ARRAY<BIGINT> of any lengths."""
    both = F.zip_with(a, b, lambda x, y: F.bit_count(F.coalesce(x, F.lit(0).cast("long")).bitwiseAND(F.coalesce(y, F.lit(0).cast("long")))))
    return F.aggregate(both, F.lit(0), lambda s, x: s + x)


def intersect_sparse_dense(positions: Column, words: Column) -> Column:
    """Positions probed in dense words; positions outside count 0."""

    def probe(s: Column, p: Column) -> Column:
        word = F.get(words, F.floor(p / 64).cast("int"))
        # constants of a shift must be literals, so the bit is found by a mask
        bit = F.expr("1L")
        return s + F.when(word.bitwiseAND(F.call_function("shiftleft", bit, (p % 64).cast("int"))) != 0, 1).otherwise(0)

    return F.aggregate(positions, F.lit(0), probe)


def intersect_sparse(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b))


def hamming_columns(df: DataFrame, query: Sequence[int]) -> Column:
    """popcount(code XOR query); independent of the m + w - 2a form."""
    if is_wide(df):
        q = F.array(*[F.lit(signed(w)) for w in query])
        return F.aggregate(F.zip_with("words", q, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    return _sum([F.bit_count(F.col(c).bitwiseXOR(F.lit(signed(w)))) for c, w in zip(word_columns(df), query, strict=True)]).cast("int")


def block_of(c: Column) -> Column:
    return F.shiftright(c, BLOCK_BITS).cast("int")


def sign_words(embedding: Column, dims: int) -> list[Column]:
    """One BIGINT column for each 64 components: bit set where the component is positive."""
    out = []
    for i in range(words_for(dims)):
        part = F.slice(embedding, 64 * i + 1, 64)
        bits = F.transform(part, lambda x, j: F.when(x > 0, F.call_function("shiftleft", F.expr("1L"), j)).otherwise(F.expr("0L")))
        out.append(F.aggregate(bits, F.expr("0L"), lambda a, b: a.bitwiseOR(b)))
    return out


def position_words(positions: Column, dims: int) -> list[Column]:
    """Word columns of ARRAY<INT> positions; positions outside [0, dims) are dropped."""
    out = []
    for i in range(words_for(dims)):
        top = min(64 * (i + 1), dims)
        mine = F.filter(positions, lambda p: (p >= 64 * i) & (p < top))
        out.append(F.aggregate(mine, F.expr("0L"), lambda a, p: a.bitwiseOR(F.call_function("shiftleft", F.expr("1L"), (p - 64 * i).cast("int")))))
    return out


def positions_of(df: DataFrame, dims: int) -> Column:
    """ARRAY<INT> of the set bits, ascending."""
    cols = [F.element_at("words", i + 1) for i in range(words_for(dims))] if is_wide(df) else [F.col(c) for c in word_columns(df)]

    def bits(w: Column, i: int) -> Column:
        all_ = F.sequence(F.lit(64 * i), F.lit(64 * i + 63))
        return F.filter(all_, lambda p: w.bitwiseAND(F.call_function("shiftleft", F.expr("1L"), (p - 64 * i).cast("int"))) != 0)

    return F.concat(*[bits(w, i) for i, w in enumerate(cols)])


def stored(df: DataFrame, dims: int) -> DataFrame:
    """doc_id, block, word columns (or ``words``) and weight of a frame with doc_id and ``words`` ARRAY<BIGINT>.

    Bits at or over ``dims`` are dropped; missing words are 0.
    """
    n, zero = words_for(dims), F.expr("0L")
    tail = dims - 64 * (n - 1)
    last = signed((1 << tail) - 1 if tail < 64 else _U64)
    words = [F.coalesce(F.get("words", F.lit(i)), zero) for i in range(n)]
    words[-1] = words[-1].bitwiseAND(F.lit(last))
    base = [F.col("doc_id").cast("long").alias("doc_id"), block_of(F.col("doc_id")).alias("block")]
    if n > MAX_COLUMNS:
        out = df.select(*base, F.array(*words).alias("words")) if n <= 256 else df.select(
            *base,
            F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.coalesce(F.get("words", i), zero).bitwiseAND(F.when(i == n - 1, F.lit(last)).otherwise(F.lit(-1).cast("long")))).alias("words"),
        )
    else:
        out = df.select(*base, *[w.alias(f"w{i}") for i, w in enumerate(words)])
    return out.withColumn("weight", weight_of(out))
