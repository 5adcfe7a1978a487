"""Raw float corpora: headerless row-major little-endian float32 files."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..errors import InvalidArgument
from .files import opened


def read_f32(spark: SparkSession, path: str, dims: int, rows_per_part: int = 65_536) -> DataFrame:
    """(row BIGINT, embedding ARRAY<FLOAT>) of one file or of files in name order.

    Fixed-length records, so Spark splits a large file by byte ranges. The length must be a whole number of rows.
    """
    if dims <= 0:
        raise InvalidArgument("dims must be positive")
    width = 4 * dims
    files = [(s.getPath().toString(), s.getLen()) for s in _statuses(spark, path)]
    if any(size % width for _, size in files):
        raise InvalidArgument("the file isn't a whole number of rows")
    plan, row = [], 0
    for name, size in files:
        for at in range(0, size // width, rows_per_part):
            n = min(rows_per_part, size // width - at)
            plan.append((name, at * width, n * width, row))
            row += n
    if not plan:
        return spark.createDataFrame([], "row long, embedding array<float>")
    parts = spark.createDataFrame(plan, "path string, start long, length long, row long").repartition(len(plan), "path", "start")

    def run(batches):
        for batch in batches:
            for name, start, length, first in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                system, local = opened(name)
                with system.open_input_file(local) as f:
                    data = f.read_at(length, start)
                n = length // width
                flat = pa.Array.from_buffers(pa.float32(), n * dims, [None, pa.py_buffer(data)])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(range(first, first + n), pa.int64()), pa.FixedSizeListArray.from_arrays(flat, dims).cast(pa.list_(pa.float32()))], names=["row", "embedding"]
                )

    return parts.mapInArrow(run, "row long, embedding array<float>")


def _statuses(spark: SparkSession, path: str) -> list:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = list(fs.listStatus(p))
    return sorted((s for s in found if s.isFile()), key=lambda s: s.getPath().getName())
