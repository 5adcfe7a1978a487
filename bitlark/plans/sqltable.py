"""Top-k as a table function of Spark SQL.

    register(index.corpus(), "exact_topk")
    spark.sql("SELECT * FROM exact_topk(array(11L, 0L, 0L, 0L), 'jaccard', 10)")

The function is SQL itself, so a call is inlined into the plan: the scores stay in code generation, words in which a literal
query is 0 fold away, and the window over the ranking key is preceded by a limit inside each task, so k rows of a task meet.
"""

from __future__ import annotations

from collections.abc import Sequence

from ..errors import BinarySearchOnResidualIndex, InvalidArgument
from ..functions import codes
from ..operators.search import Corpus

COLUMNS = "rank INT, doc_id BIGINT, inter INT, weight INT, num BIGINT, den BIGINT, square_root BOOLEAN, score DOUBLE"


def register(corpus: Corpus, name: str = "exact_topk") -> str:
    """Makes the temporary function ``name(query ARRAY<BIGINT>, metric STRING, k INT)`` over a corpus, and the view ``name_docs`` that it reads.

    A query of fewer words is filled with zeros; bits past the width don't count. One with more words, and an unknown metric, are refused.
    ``k`` of 0 or less gives no rows; a null argument too.
    """
    if corpus.residual:
        raise BinarySearchOnResidualIndex("this index holds residual codes")
    if not name.isidentifier():
        raise InvalidArgument(f"{name!r} can't name a function")
    spark = corpus.spark
    corpus.docs.createOrReplaceTempView(f"{name}_docs")
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(query ARRAY<BIGINT>, metric STRING, k INT) RETURNS TABLE({COLUMNS}) RETURN {_body(corpus, name)}")
    return name


def literal(words: Sequence[int]) -> str:
    """A query's words as SQL."""
    return f"array({', '.join(_long(w) for w in words)})" if words else "CAST(array() AS ARRAY<BIGINT>)"


def _long(word: int) -> str:
    # the least long has no literal of its own
    return f"CAST('{codes.signed(word)}' AS BIGINT)"


def _body(corpus: Corpus, name: str) -> str:
    n = codes.words_for(corpus.dims)
    last = corpus.dims % 64
    word = lambda i: f"coalesce(get({name}.query, {i}), 0L)" + (f" & {(1 << last) - 1}L" if last and i == n - 1 else "")
    words = [f"({word(i)})" for i in range(n)]
    m = " + ".join(f"bit_count({w})" for w in words)
    if codes.is_wide(corpus.docs):
        inter = f"aggregate(zip_with(words, array({', '.join(words)}), (a, b) -> bit_count(a & b)), 0, (s, x) -> s + x)"
    else:
        inter = " + ".join(f"bit_count({c} & {w})" for c, w in zip(codes.word_columns(corpus.docs), words, strict=True))
    return f"""
SELECT rank, doc_id, inter, weight, num, den, square_root, CASE WHEN square_root THEN sqrt(key) ELSE key END AS score FROM (
  SELECT *, CAST(row_number() OVER (ORDER BY key DESC, doc_id) AS INT) AS rank FROM (
    SELECT *, CAST(num AS DOUBLE) / CAST(den AS DOUBLE) AS key FROM (
      SELECT doc_id, inter, weight, metric = 'cosine' AS square_root,
        CASE metric WHEN 'dot' THEN a WHEN 'hamming' THEN 2 * a - m - w WHEN 'jaccard' THEN a WHEN 'cosine' THEN a * a
          ELSE CAST(raise_error(concat('unknown metric ', metric)) AS BIGINT) END AS num,
        CASE WHEN metric = 'jaccard' THEN greatest(m + w - a, 1L) WHEN metric = 'cosine' THEN greatest(m * w, 1L) ELSE 1L END AS den
      FROM (
        SELECT doc_id, inter, weight, metric, CAST(inter AS BIGINT) AS a, CAST(weight AS BIGINT) AS w, m FROM (
          SELECT doc_id, CAST(weight AS INT) AS weight, {name}.metric AS metric, CAST({inter} AS INT) AS inter, CAST({m} AS BIGINT) AS m FROM {name}_docs
          WHERE {name}.metric IS NOT NULL
            AND CASE WHEN size({name}.query) > {n} THEN CAST(raise_error('the query has more than {n} words') AS BOOLEAN) ELSE {name}.query IS NOT NULL END))))
) WHERE rank <= {name}.k"""
