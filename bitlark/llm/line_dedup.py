"""Line dedup: hash normalised lines, count documents per hash, drop the frequent, reassemble.

DataFrame functions only. Lines are cut at ``\\n``; a line's key is the line without
``[\\x20\\x09-\\x0D]`` at both ends and with A-Z lower-cased. A key of at least ``min_chars``
code points that at least ``min_docs`` documents hold loses its lines everywhere but in the
largest doc_id that holds it.

Scale: the line hashes (16 bytes each) are shuffled, never the lines. Each document sends a
hash once; counting combines on the map side, so a line that a third of all documents hold
costs one row a task. The join back is a plain equi-join that adaptive execution may split. Texts
are shuffled once, to meet the positions they lose.

Edge cases: a null or empty text is one empty line and stays empty. A row without doc_id is no
document for counting and never the largest holder; its frequent lines go. Rows that repeat a
doc_id are one document for counting; each row gives a row. An empty table gives an empty
table. Extra columns of any name pass through ``drop_lines`` (its own are prefixed ``_ld_``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, text_of, written

BLANK = " \t\n\x0b\x0c\r"


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(BLANK)))


def _hashes(docs: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    """A row for each line that can count: id, hash of the text, position, hash of the key."""
    text = text_of(text_col)
    keys = F.transform(F.split(text, "\n", -1), lambda x: F.btrim(x, F.lit(BLANK)))
    hashed = F.transform(keys, lambda k: F.when(F.char_length(k) >= min_chars, F.unhex(F.md5(ascii_lower(k).cast("binary")))))
    return (
        docs.select(F.col(id_col).alias("_ld_id"), F.xxhash64(text).alias("_ld_th"), F.posexplode(hashed).alias("_ld_pos", "_ld_h"))
        .where(F.col("_ld_h").isNotNull())
    )


def frequent_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """(_ld_h, _ld_docs, _ld_keep): keys at or over the threshold and the largest doc_id that holds them."""
    lines = _hashes(docs, id_col, text_col, min_chars).where(F.col("_ld_id").isNotNull())
    per_doc = lines.select("_ld_h", "_ld_id").distinct()
    return (
        per_doc.groupBy("_ld_h")
        .agg(F.count("*").alias("_ld_docs"), F.max("_ld_id").alias("_ld_keep"))
        .where(F.col("_ld_docs") >= min_docs)
    )


def drop_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """``docs`` with its text column rebuilt, and ``_ld_lines`` and ``_ld_dropped`` (long)."""
    # written: a join of two plain tables may be split where a line is very common
    over = written(frequent_lines(docs, id_col, text_col, min_chars, min_docs).select("_ld_h", "_ld_keep"), "lines")
    gone = (
        _hashes(docs, id_col, text_col, min_chars)
        .join(over, "_ld_h")
        .where(~F.col("_ld_id").eqNullSafe(F.col("_ld_keep")))
        .groupBy("_ld_id", "_ld_th")
        .agg(F.collect_set("_ld_pos").alias("_ld_gone"))
        .withColumnsRenamed({"_ld_id": "_ld_gid", "_ld_th": "_ld_gth"})
    )
    text = text_of(text_col)
    lines = docs.withColumns({"_ld_th": F.xxhash64(text), "_ld_text": F.split(text, "\n", -1)})
    met = lines.join(gone, F.col(id_col).eqNullSafe(F.col("_ld_gid")) & (F.col("_ld_th") == F.col("_ld_gth")), "left")
    n = F.size("_ld_text")
    kept = F.transform(
        F.array_except(F.sequence(F.lit(0), n - 1), F.col("_ld_gone")),
        lambda i: F.get(F.col("_ld_text"), i),
    )
    whole = F.when(F.col("_ld_gone").isNull(), F.array_join("_ld_text", "\n")).otherwise(F.array_join(kept, "\n"))
    return met.withColumns(
        {
            text_col: whole,
            "_ld_lines": n.cast("long"),
            "_ld_dropped": F.when(F.col("_ld_gone").isNull(), F.lit(0)).otherwise(F.size("_ld_gone")).cast("long"),
        }
    ).drop("_ld_th", "_ld_text", "_ld_gid", "_ld_gth", "_ld_gone")


def digest(docs: DataFrame) -> DataFrame:
    """One row a document: doc_id, n_lines, n_dropped, kept_sha256."""
    return drop_lines(docs.select("doc_id", "text")).select(
        "doc_id",
        F.col("_ld_lines").alias("n_lines"),
        F.col("_ld_dropped").alias("n_dropped"),
        F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"),
    )


def stage(docs: DataFrame) -> DataFrame:
    """Pipeline form: the columns of ``docs``, text without the dropped lines, n_chars of the new text."""
    out = drop_lines(docs)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


SQL = """
WITH lines AS (
  SELECT doc_id, rowid_, pos, line,
         translate(trim(line, chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, rowid_, unnest(l) AS line, generate_subscripts(l, 1) AS pos
        FROM (SELECT doc_id, row_number() OVER () AS rowid_, string_split(coalesce(text, ''), chr(10)) AS l FROM {docs}))
), over_ AS (
  SELECT k, max(doc_id) AS keep FROM lines WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5
), marked AS (
  SELECT l.*, (o.k IS NOT NULL AND l.doc_id IS DISTINCT FROM o.keep) AS gone FROM lines l LEFT JOIN over_ o ON l.k = o.k
)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE gone)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY rowid_, doc_id
""".format(docs="documents")
