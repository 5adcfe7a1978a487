"""The driver's tables as corpora: sign codes of embeddings, hashed token codes of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import codes
from ..operators.search import Corpus

SIGN_DIMS, TOKEN_DIMS = 64, 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding", "label")


def attrs(vectors: DataFrame) -> DataFrame:
    """Term 1 on multiples of 3, term 2 on even ids, term 10 + label."""
    tags = F.array_compact(F.array(F.when(F.col("doc_id") % 3 == 0, 1), F.when(F.col("doc_id") % 2 == 0, 2), F.col("label") + 10))
    return vectors.select("doc_id", F.explode(tags.cast("array<int>")).alias("term"))


def once(df: DataFrame, column: str) -> DataFrame:
    """Keeps the optimizer from inlining a costly column into lambdas, where it would run for each element."""
    rest = [c for c in df.columns if c != column]
    return df.select(*rest, F.explode(F.array(column)).alias(column))


def signs(spark: SparkSession, sf_dir: str) -> Corpus:
    vectors = embeddings(spark, sf_dir)
    rows = vectors.select("doc_id", F.array(*codes.sign_words(F.col("embedding"), SIGN_DIMS)).alias("words"))
    docs = codes.stored(once(rows, "words"), SIGN_DIMS)
    return Corpus(docs, attrs(vectors), SIGN_DIMS)


def tokens(spark: SparkSession, sf_dir: str) -> Corpus:
    """256-bit codes: one bit for each distinct token, by the first byte of its MD5."""
    docs = table(spark, sf_dir, "documents")
    words = F.filter(F.split(F.coalesce("text", F.lit("")), "[ \n]+"), lambda x: x != "")
    bits = F.array_distinct(F.transform(words, lambda t: F.conv(F.substring(F.md5(t.cast("binary")), 1, 2), 16, 10).cast("int")))
    bits = once(docs.select("doc_id", bits.alias("bits")), "bits")
    rows = bits.select("doc_id", F.array(*codes.position_words(F.col("bits"), TOKEN_DIMS)).alias("words"))
    return Corpus(codes.stored(once(rows, "words"), TOKEN_DIMS), None, TOKEN_DIMS)


def code_of(corpus: Corpus, doc_id: int) -> tuple[int, ...]:
    """The stored words of one document, as a query."""
    row = corpus.docs.where(F.col("doc_id") == doc_id).select(*codes.word_columns(corpus.docs)).limit(1).collect()
    return tuple(x & ((1 << 64) - 1) for x in row[0]) if row else ()
