"""Token counts as delta-maintained rollups.

A public byte-level BPE vocabulary counts the tokens of whole texts. Totals by (source, language, tokenizer version) are
additive and kept as signed deltas: an insert adds a document's counts, a delete takes them away, a revision is a delete of the old
and an insert of the new counts. A batch is aggregated, written as a table below the root and then published by creating its
commit file at once and exclusively; a batch id that has one is skipped, so replays and retries after lost executors or a lost driver change
nothing, and what an unpublished attempt left is never read. Commit files stay, so whether a batch is known is one look-up.

``roll`` folds published batches into one table. Rolls are numbered without gaps, and a roll names the batches that it replaces, those of
earlier rolls included; the newest roll and the batches that it doesn't name are the totals. Two rolls planned from one state want the same
number, so the second is refused; a batch published meanwhile isn't named and stays.

Scale: counting is one scan without a shuffle; what is shuffled and kept is a row for each key and task. No totals
are recomputed from documents when some change. The vocabulary (its size is checked) travels to the tasks, which need no file of their own.

Edge cases: null and empty texts have 0 tokens and count as documents; a null source or lang is a key of its own; repeated rows
count each; a key whose documents are all taken away again vanishes from the totals; very long texts are counted whole, one at a time;
an empty table has no totals; extra columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import json
import os
import re
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import AlreadyExists, InvalidArgument
from ..sources.files import Files
from .common import work_path, written

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: how the public vocabulary cuts text before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
KEYS = ["source", "lang", "tokenizer"]
SUMS = ["n_docs", "n_tokens", "n_bytes"]
DELTA = "source string, lang string, tokenizer string, n_docs long, n_tokens long, n_bytes long"

#: A vocabulary file is broadcast up to this size.
MAX_VOCABULARY = 64 << 20

_LOADED: dict = {}


def encoding(data: bytes, version: str, pattern: str = PATTERN):
    """The encoder of a vocabulary file, built once a worker."""
    if (version, pattern) not in _LOADED:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines())}
        _LOADED[version, pattern] = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _LOADED[version, pattern]


def vocabulary(spark: SparkSession, path: str) -> tuple[bytes, str]:
    """The file at ``path`` (any file system of Spark's; without a scheme, the driver's own) and its version: name and digest."""
    files = Files(spark)
    where = path if "://" in path else f"file://{os.path.abspath(path)}"
    if files.size(where) > MAX_VOCABULARY:
        raise InvalidArgument(f"{path} is larger than a vocabulary may be")
    data = files.read(where)
    return data, f"{os.path.splitext(os.path.basename(path))[0]}-{hashlib.sha256(data).hexdigest()[:12]}"


def counted(docs: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """(doc_id, source, lang, tokenizer, n_tokens, n_bytes), a row for each row of ``docs``."""
    spark = docs.sparkSession
    rows = docs.select("doc_id", F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    data, version = vocabulary(spark, path)
    sent = spark.sparkContext.broadcast(data)

    def run(batches):
        e = encoding(sent.value, version)
        for batch in batches:
            tokens, size = [], []
            for text in batch.column(3):
                t = text.as_py() or ""
                tokens.append(len(e.encode_ordinary(t)))
                size.append(len(t.encode("utf-8", "surrogatepass")))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array([version] * len(tokens), pa.string()), pa.array(tokens, pa.int64()), pa.array(size, pa.int64())],
                names=["doc_id", "source", "lang", "tokenizer", "n_tokens", "n_bytes"],
            )

    return rows.mapInArrow(run, f"doc_id {kind}, source string, lang string, tokenizer string, n_tokens long, n_bytes long")


def inserts(counts: DataFrame) -> DataFrame:
    return counts.select(*KEYS, F.lit(1).cast("long").alias("n_docs"), "n_tokens", "n_bytes")


def deletes(counts: DataFrame) -> DataFrame:
    return counts.select(*KEYS, F.lit(-1).cast("long").alias("n_docs"), (-F.col("n_tokens")).alias("n_tokens"), (-F.col("n_bytes")).alias("n_bytes"))


def revisions(old: DataFrame, new: DataFrame) -> DataFrame:
    return deletes(old).union(inserts(new))


class Rollup:
    """Totals below ``root``, a folder that all executors share."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root, self.files = spark, root.rstrip("/"), Files(spark)

    def _file(self, batch: str) -> str:
        return f"{self.root}/commits/{batch}.json"

    def commit(self, batch: str, deltas: DataFrame) -> bool:
        """Adds signed deltas (KEYS, SUMS) once; False if the batch was there."""
        if not re.fullmatch(r"(?!roll-)[\w.-]+", batch):
            raise InvalidArgument("a batch id has letters, digits, _ . - only and doesn't begin with roll-")
        return not self.files.exists(self._file(batch)) and self._publish(batch, deltas, [])

    def _publish(self, name: str, deltas: DataFrame, replaces: list[str]) -> bool:
        part = f"deltas/{uuid.uuid4().hex}"
        deltas.groupBy(*KEYS).agg(*[F.sum(c).alias(c) for c in SUMS]).write.parquet(f"{self.root}/{part}")
        try:
            self.files.create(self._file(name), json.dumps({"table": part, "replaces": replaces}).encode())
        except AlreadyExists:
            return False  # another attempt was first; its table counts
        return True

    def _state(self) -> tuple[int, list[str], list[str]]:
        """Number of the newest roll (0: none), the batches it replaces, tables of the totals."""
        names = {n[:-5] for n in self.files.names(f"{self.root}/commits") if n.endswith(".json") and not n.startswith(".")}
        rolls = [n for n in names if n.startswith("roll-")]
        newest = json.loads(self.files.read(self._file(max(rolls)))) if rolls else {"replaces": []}
        fresh = sorted(names - set(rolls) - set(newest["replaces"]))
        tables = [json.loads(self.files.read(self._file(b)))["table"] for b in fresh] + ([newest["table"]] if rolls else [])
        return len(rolls), sorted({*newest["replaces"], *fresh}), tables

    def _sums(self, tables: list[str]) -> DataFrame:
        paths = [f"{self.root}/{t}" for t in tables]
        rows = self.spark.read.schema(DELTA).parquet(*paths) if paths else self.spark.createDataFrame([], DELTA)
        return rows.groupBy(*KEYS).agg(*[F.sum(c).alias(c) for c in SUMS]).where("n_docs <> 0 OR n_tokens <> 0 OR n_bytes <> 0")

    def totals(self) -> DataFrame:
        return self._sums(self._state()[2])

    def planned(self) -> Callable[[], bool]:
        """A roll of what is published now; call it to publish. False if another roll came first or there is nothing to fold."""
        number, replaces, tables = self._state()
        return lambda: len(tables) > 1 and self._publish(f"roll-{number + 1:012d}", self._sums(tables), replaces)

    def roll(self) -> bool:
        """Folds what is published now into one table; batch ids stay known."""
        return self.planned()()


def digest(docs: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """Totals of all documents: source, lang, tokenizer, n_docs, n_tokens, n_bytes, maintained by signed deltas.

    Every document is first counted as a draft (its first line) and loaded; a revision takes the drafts' counts out and adds those of
    the whole texts; the whole feed comes a second time under another id and is deleted again. Every batch is offered twice, as a retry
    would, and the batches are rolled. What stays is the totals of the table.
    """
    spark = docs.sparkSession
    rollup = Rollup(spark, work_path(spark, "rollup"))
    draft = written(counted(docs.withColumn("text", F.substring_index("text", "\n", 1)), path), "drafts")
    whole = written(counted(docs, path), "counts")
    for batch, deltas in {"load": inserts(draft), "revise": revisions(draft, whole), "again": inserts(whole), "delete": deletes(whole)}.items():
        for _ in range(2):
            rollup.commit(batch, deltas)
        if batch == "revise":
            rollup.roll()
    return rollup.totals()
