"""The residual codec: 64-byte codes of 500 signs and a 12-bit reciprocal-norm code.

Signs 0..495 fill bytes 0..61, least significant bit first. The last two bytes are one little-endian
number: signs 496..499 in bits 0..3, the norm code in bits 4..15. Scores are exact 64-bit integers.
"""

from __future__ import annotations

import hashlib
import struct
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import CorruptModel, DimensionMismatch, InvalidArgument, InvalidModel, InvalidVector, ModelMismatch, NoModelIdentity, ScoreOverflow

# Fixed values of the format.
SIGNS = 500
NORM_BITS = 12
CODE_BYTES = 64
MAX_NORM_CODE = 4095
MAX_COEFFICIENT = 2047
QUERY_SCALE = 32767.0
MODEL_VERSION = 1
MODEL_MAGIC = b"BLRKRES1"
HEADER = struct.Struct("<8sHHHHI32sqd")
#: Documents that are encoded together, so that their residues stay in a core's cache.
COLUMNS = 128
_I64 = (1 << 63) - 1


def pack(signs: np.ndarray, norm: np.ndarray) -> np.ndarray:
    """uint8 [n, 64] of bool signs [n, 500] and norm codes [n]."""
    signs = np.asarray(signs, bool)
    if signs.shape[1] != SIGNS:
        raise DimensionMismatch(SIGNS, signs.shape[1])
    norm = np.asarray(norm, np.int64)
    if ((norm < 0) | (norm > MAX_NORM_CODE)).any():
        raise InvalidArgument("norm code out of range")
    bits = np.concatenate([signs, (norm[:, None] >> np.arange(NORM_BITS)) & 1 > 0], axis=1)
    return np.packbits(bits, axis=1, bitorder="little")


def unpack(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    bits = np.unpackbits(np.asarray(codes, np.uint8).reshape(-1, CODE_BYTES), axis=1, bitorder="little")
    return bits[:, :SIGNS].astype(bool), bits[:, SIGNS:].astype(np.int64) @ (1 << np.arange(NORM_BITS))


def normalize(x: np.ndarray, dims: int) -> np.ndarray:
    """float32 rows of unit length by a float64 norm."""
    x = np.asarray(x, np.float32)
    if x.ndim != 2 or x.shape[1] != dims:
        raise DimensionMismatch(dims, x.shape[-1])
    if not np.isfinite(x).all():
        raise InvalidVector("a component is NaN or infinite")
    wide = x.astype(np.float64)
    square = np.cumsum(wide * wide, axis=1)[:, -1]  # summed in order
    if (square == 0).any() or not np.isfinite(square).all():
        raise InvalidVector("the vector has no length to divide by")
    return (wide / np.sqrt(square)[:, None]).astype(np.float32)


@dataclass(frozen=True)
class Model:
    dims: int
    norm_offset: int
    norm_step: float
    encoder: np.ndarray  # float32 [500, dims]
    decoder: np.ndarray  # int16 [500, dims]

    def __post_init__(self) -> None:
        if self.dims <= 0:
            raise InvalidModel("input width is zero")
        for name, x in (("encoder", self.encoder), ("decoder", self.decoder)):
            if x.shape != (SIGNS, self.dims):
                raise DimensionMismatch(SIGNS * self.dims, x.size)
            del name
        if not np.isfinite(self.norm_step) or self.norm_step <= 0:
            raise InvalidModel("the reciprocal-norm step is not finite and positive")
        if not 0 < self.norm_offset <= _I64 - MAX_NORM_CODE:
            raise InvalidModel("the reciprocal-norm offset gives no positive multipliers")
        if not np.isfinite(self.encoder).all():
            raise InvalidModel("the encoder has a coefficient that is not finite")
        if (self.encoder == 0).all(axis=1).any():
            raise InvalidModel("the encoder has an all-zero atom")
        if (np.abs(self.decoder.astype(np.int64)) > MAX_COEFFICIENT).any():
            raise InvalidModel("a decoder coefficient exceeds the signed 12-bit range")
        if self.max_abs_score > _I64:
            raise ScoreOverflow("scores don't fit 64 bits")
        per_dim = np.abs(self.decoder.astype(np.int64)).sum(axis=0)
        if sum(int(c) ** 2 for c in per_dim) > _I64:
            raise ScoreOverflow("decoded norms don't fit 64 bits")

    @cached_property
    def max_abs_score(self) -> int:
        return 32767 * int(np.abs(self.decoder.astype(np.int64)).sum()) * (self.norm_offset + MAX_NORM_CODE)

    def _content(self) -> tuple[bytes, bytes, bytes]:
        head = struct.pack("<8sHHHHI", MODEL_MAGIC, MODEL_VERSION, SIGNS, NORM_BITS, 0, self.dims)
        norm = struct.pack("<qd", self.norm_offset, self.norm_step)
        return head, norm, self.encoder.astype("<f4").tobytes() + self.decoder.astype("<i2").tobytes()

    @cached_property
    def model_id(self) -> bytes:
        return hashlib.sha256(b"".join(self._content())).digest()

    def to_bytes(self) -> bytes:
        head, norm, body = self._content()
        return head + self.model_id + norm + body

    @classmethod
    def from_bytes(cls, data: bytes) -> Model:
        if len(data) < HEADER.size:
            raise CorruptModel("shorter than its header")
        magic, version, signs, bits, zero, dims, stored, offset, step = HEADER.unpack_from(data)
        if magic != MODEL_MAGIC:
            raise CorruptModel("not a model file")
        if version != MODEL_VERSION:
            raise CorruptModel("a version that this reader does not know")
        if (signs, bits, zero) != (SIGNS, NORM_BITS, 0):
            raise CorruptModel("codec geometry doesn't match")
        n = SIGNS * dims
        if len(data) != HEADER.size + 6 * n:
            raise CorruptModel("byte length doesn't match")
        encoder = np.frombuffer(data, "<f4", n, HEADER.size).reshape(SIGNS, dims)
        decoder = np.frombuffer(data, "<i2", n, HEADER.size + 4 * n).reshape(SIGNS, dims)
        made = cls(dims, offset, step, encoder, decoder)
        if made.model_id != stored:
            raise CorruptModel("identity doesn't match the contents")
        return made

    def save(self, path: str) -> None:
        """Creates the file; an existing one is refused."""
        with open(path, "xb") as f:
            f.write(self.to_bytes())

    @classmethod
    def load(cls, path: str) -> Model:
        with open(path, "rb") as f:
            return cls.from_bytes(f.read())

    # -- documents -------------------------------------------------------------

    def signs_of(self, x: np.ndarray) -> np.ndarray:
        """bool [n, 500]. Dots are float32 sums in component order, so a sign never depends on the batch."""
        unit = normalize(x, self.dims)
        out = np.zeros((len(unit), SIGNS), bool)
        for at in range(0, len(unit), COLUMNS):
            part = unit[at : at + COLUMNS]
            # two columns at least: then rows are added one after another, never in pairs
            rest = np.zeros((self.dims, max(2, len(part))), np.float32)
            rest[:, : len(part)] = part.T
            made = np.empty_like(rest)
            for s in range(SIGNS):
                atom = self.encoder[s][:, None]
                dot = np.add.reduce(np.multiply(rest, atom, out=made), axis=0)
                plus = dot >= 0
                out[at : at + len(part), s] = plus[: len(part)]
                rest -= np.multiply(atom, np.where(plus, np.float32(1), np.float32(-1)), out=made)
        return out

    def encode(self, x: np.ndarray) -> np.ndarray:
        """uint8 [n, 64]."""
        if not len(x):
            return np.zeros((0, CODE_BYTES), np.uint8)
        signs = self.signs_of(x)
        square = self.decoded_squares(signs)
        if (square == 0).any():
            raise InvalidModel("the signs of a document decode to nothing")
        raw = np.rint(1.0 / np.sqrt(square.astype(np.float64)) / self.norm_step) - float(self.norm_offset)
        return pack(signs, np.clip(raw, 0, MAX_NORM_CODE).astype(np.int64))

    def decoded_squares(self, signs: np.ndarray) -> np.ndarray:
        # sums stay below 500 * 2047, exact in float64
        decoded = np.where(signs, 1.0, -1.0) @ self.decoder.astype(np.float64)
        decoded = decoded.astype(np.int64)
        return (decoded * decoded).sum(axis=1)

    # -- queries ---------------------------------------------------------------

    def prepare(self, vector: np.ndarray) -> PreparedQuery:
        v = normalize(np.asarray(vector, np.float32).reshape(1, -1), self.dims)[0]
        q = np.rint(v.astype(np.float64) * QUERY_SCALE).astype(np.int64)
        return PreparedQuery(self.model_id, self.norm_offset, self.decoder.astype(np.int64) @ q, self.max_abs_score)

    def require(self, index_dims: int, stored: bytes | None) -> None:
        """The binding of an index: 512-bit rows and this model's identity."""
        if index_dims != CODE_BYTES * 8:
            raise DimensionMismatch(CODE_BYTES * 8, index_dims)
        if stored is None:
            raise NoModelIdentity("the index names no model")
        if stored != self.model_id:
            raise ModelMismatch("the index is bound to another model")


class PreparedQuery:
    def __init__(self, model_id: bytes, norm_offset: int, weights: np.ndarray, max_abs_score: int) -> None:
        if int(np.abs(weights).astype(object).sum()) * (norm_offset + MAX_NORM_CODE) > max_abs_score:
            raise ScoreOverflow("the query exceeds the model's bound")
        self.model_id, self.norm_offset, self.weights = model_id, norm_offset, weights
        bits = (np.arange(256)[:, None] >> np.arange(8)) & 1
        self.full = (np.where(bits, 1, -1) @ weights[:496].reshape(62, 8).T).T.copy()  # [62, 256]
        self.tail = np.where(bits[:16, :4], 1, -1) @ weights[496:]

    def score(self, codes: np.ndarray) -> np.ndarray:
        """int64 scores of uint8 [n, 64]."""
        codes = np.asarray(codes, np.uint8).reshape(-1, CODE_BYTES)
        dot = np.zeros(len(codes), np.int64)
        for b in range(62):
            dot += self.full[b][codes[:, b]]
        tail = codes[:, 62].astype(np.int64) | codes[:, 63].astype(np.int64) << 8
        return (dot + self.tail[tail & 15]) * (self.norm_offset + (tail >> 4))


# -- columns -------------------------------------------------------------------


def _matrix(x: pa.Array, dims: int) -> np.ndarray:
    """float32 [n, dims] of a list array, from its buffer."""
    ends = x.offsets.to_numpy()
    if x.null_count or (np.diff(ends) != dims).any():
        bad = np.flatnonzero(np.diff(ends) != dims)
        raise DimensionMismatch(dims, int(np.diff(ends)[bad[0]]) if len(bad) else 0)
    return x.flatten().to_numpy(zero_copy_only=False).astype(np.float32, copy=False).reshape(len(x), dims)


def _fixed(rows: np.ndarray) -> pa.Array:
    """BINARY rows of a uint8 matrix."""
    n, size = rows.shape
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.arange(0, (n + 1) * size, size, dtype=np.int32)), pa.py_buffer(np.ascontiguousarray(rows))])


def encode_column(spark: SparkSession, model: Model, embedding: Column) -> Column:
    """BINARY(64) of ARRAY<FLOAT>; any invalid vector fails the job, so no partial batch is kept."""
    sent = spark.sparkContext.broadcast(model)

    @F.arrow_udf("binary")
    def run(x: pa.Array) -> pa.Array:
        return _fixed(sent.value.encode(_matrix(x, sent.value.dims)))

    return run(embedding)


def score_column(spark: SparkSession, query: PreparedQuery, code: Column) -> Column:
    """BIGINT score of a BINARY(64) code."""
    sent = spark.sparkContext.broadcast(query)

    @F.arrow_udf("long")
    def run(x: pa.Array) -> pa.Array:
        _, ends, data = x.buffers()
        ends = np.frombuffer(ends, np.int32)[x.offset : x.offset + len(x) + 1]
        if x.null_count or (np.diff(ends) != CODE_BYTES).any():
            raise InvalidArgument("a stored code is not 64 bytes")
        return pa.array(sent.value.score(np.frombuffer(data, np.uint8)[ends[0] : ends[-1]]) if len(x) else [], pa.int64())

    return run(code)


@F.arrow_udf(T.ArrayType(T.FloatType()))
def l2_normalize(x: pa.Array) -> pa.Array:
    """Unit-length float32 vectors by a float64 norm; a zero or non-finite vector is refused."""
    sizes = np.diff(x.offsets.to_numpy())
    if not len(sizes):
        return pa.array([], pa.list_(pa.float32()))
    flat = normalize(_matrix(x, int(sizes[0])), int(sizes[0])).ravel()
    return pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, sizes[0], dtype=np.int32)), pa.array(flat))
