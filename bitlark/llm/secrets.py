r"""Secret scans: three base patterns and a randomness test battery. DataFrame functions only.

Base spans, leftmost and non-overlapping for each kind: ``assign`` (a named secret and a value of 12 characters or more),
``access`` (an access key id of 18 or more) and ``hex`` (16 or more lower-case hex digits).

The battery adds spans of kind ``random``. Candidates are runs of 20 or more of ``[A-Za-z0-9+/_-]`` (and up to two ``=``)
with a letter and a digit that overlap no base span. A candidate's encoding is inferred from its characters (upper-case hex, base32,
lower-case alphanumeric, base64), which gives the alphabet size and the rate of class changes of a random string. Three tests:

* chi-squared of the character counts against the uniform alphabet;
* runs: changes between upper case, lower case, digits and other signs;
* serial correlation of neighbouring character codes, lag 1.

A candidate must not be rejected as random by any of them (5.0 and 3.3 standard deviations), and must beat the null of written text
(collision rate 0.065, change rate 0.3, correlation 0.3): the three statistics against that null are combined
to one p-value (Stouffer). The false-discovery rate is controlled over the candidates of the whole table at 1 %: each p-value is weighted by
its length over the mean length, as longer strings carry more evidence, and a Benjamini-Hochberg step-up over the thresholds 1 % x 2**(-j/8),
j up to ``STEPS`` (counts of weighted p-values by j), gives one threshold for all.

Scale: one scan of the texts; what it finds (spans and p-values, no text) is a table in the shared folder, from which the mean, the
counts by j (at most ``STEPS`` + 2 rows) and the answer are taken. Nothing is shuffled but sums. The work of a document is linear in its
text, but for sorting a candidate's characters and 1/256 of the square of its number of spans; documents without a candidate skip the
heavy expressions. Offsets are code points: the text is split at the matches and lengths of the pieces are summed.

Edge cases: a null text is empty and has no spans; repeated rows give a row each (and count each as candidates); equal p-values are found or
not together; whole texts are read whatever their length; an empty table gives an empty table; extra columns pass ``spans``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import text_of, written

ASSIGN = "(?i:(password|passwd|secret|token|api_?key))[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = "AKIA[A-Z0-9]{14,}"
HEX = "[0-9a-f]{16,}"
RUN = "[A-Za-z0-9+/_-]"
RANDOM = f"(?<!{RUN})(?=[A-Za-z+/_-]*[0-9])(?=[0-9+/_-]*[A-Za-z]){RUN}{{20,}}={{0,2}}"
KINDS = ("assign", "access", "hex", "random")
RATE = 0.01
#: Thresholds that the step-up tries: RATE * 2**(-j / 8) for j = 0 .. STEPS.
STEPS = 800
# The null of written text.
COLLISION, CHANGE, CORRELATION = 0.065, 0.3, 0.3


def _cut(text: Column, pattern: str, group: int = 0) -> Column:
    """array<struct<p, m, g, s>>: piece length, match length, length of the group, match."""
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    groups = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else matches
    pieces = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(matches))
    return F.transform(
        F.arrays_zip(pieces.alias("a"), matches.alias("b"), groups.alias("c")),
        lambda z: F.struct(F.char_length(z["a"]).alias("p"), F.char_length(z["b"]).alias("m"), F.char_length(z["c"]).alias("g"), z["b"].alias("s")),
    )


_CUT = "array<struct<p:int,m:int,g:int,s:string>>"
_PLACED = "array<struct<start:int,kind:int,stop:int,g:int,s:string>>"
_TESTED = "array<struct<p:double,start:int,stop:int>>"


#: Matches are summed in blocks of this many, blocks then as a whole.
_BLOCK = 256


def _let(value: Column, f) -> Column:
    """f(value) with the value computed once."""
    return F.element_at(F.transform(F.array(value), f), 1)


def _blocks(items: Column) -> Column:
    return F.transform(F.sequence(F.lit(0), F.floor((F.size(items) - 1) / _BLOCK).cast("int")), lambda b: F.slice(items, b * _BLOCK + 1, F.lit(_BLOCK)))


def _placed(cut: Column, kind: int, least: int) -> Column:
    """array<struct<start, kind, stop, g, s>> of the matches whose group has at least ``least`` characters."""

    def local(block: Column) -> Column:
        """Characters of the block, and its matches placed from the block's begin."""

        def step(a: Column, x: Column) -> Column:
            start = a["at"] + x["p"]
            made = F.struct(start.alias("start"), F.lit(kind).alias("kind"), (start + x["m"]).alias("stop"), x["g"].alias("g"), x["s"].alias("s"))
            return F.struct((start + x["m"]).alias("at"), F.concat(a["found"], F.array(made)).alias("found"))

        return F.aggregate(block, F.struct(F.lit(0).alias("at"), F.array().cast(_PLACED).alias("found")), step)

    def shifted(blocks: Column) -> Column:
        def one(b: Column, i: Column) -> Column:
            before = F.aggregate(F.slice(blocks, F.lit(1), i), F.lit(0), lambda a, x: a + x["at"])
            return _let(before, lambda o: F.transform(b["found"], lambda x: F.struct((x["start"] + o).alias("start"), x["kind"].alias("kind"), (x["stop"] + o).alias("stop"), x["g"].alias("g"), x["s"].alias("s"))))

        return F.flatten(F.transform(blocks, one))

    placed = _let(F.transform(_blocks(cut), local), shifted)
    return F.when(F.size(cut) > 0, F.filter(placed, lambda x: x["g"] >= least)).otherwise(F.array().cast(_PLACED))


def _free(candidates: Column, base: Column) -> Column:
    """Candidates that overlap no base span; base spans, sorted, are looked up by blocks."""
    blocks = F.transform(_blocks(base), lambda b: F.struct(F.array_min(F.transform(b, lambda x: x["start"])).alias("lo"), F.array_max(F.transform(b, lambda x: x["stop"])).alias("hi"), b.alias("m")))
    meets = lambda c, lo, hi: (lo < c["stop"]) & (c["start"] < hi)
    hit = lambda c, bs: F.exists(bs, lambda b: meets(c, b["lo"], b["hi"]) & F.exists(b["m"], lambda x: meets(c, x["start"], x["stop"])))
    return F.when((F.size(base) > 0) & (F.size(candidates) > 0), _let(blocks, lambda bs: F.filter(candidates, lambda c: ~hit(c, bs)))).otherwise(candidates)


def _plain(x: Column) -> Column:
    return F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["stop"].alias("stop"))


def _phi_upper(z: Column) -> Column:
    """1 - Phi(z) by a logistic form (absolute error below 2e-4)."""
    return 1 / (1 + F.exp(F.least(F.lit(700.0), 0.07056 * z * z * z + 1.5976 * z)))


def _p_value(s: Column) -> Column:
    """p of written text; 1 where a test rejects randomness."""
    body = F.rtrim(s, F.lit("="))
    code = F.transform(F.filter(F.split(body, ""), lambda x: x != ""), lambda x: F.ascii(x))
    kind = lambda c: F.when(c.between(48, 57), 1).when(c.between(65, 90), 2).when(c.between(97, 122), 3).otherwise(4)
    zero = F.lit(0.0)

    def step(a: Column, c: Column) -> Column:
        first = a["c"] < 0
        k = kind(c)
        return F.struct(
            (a["s1"] + c).alias("s1"), (a["s2"] + c * c).alias("s2"), F.when(first, a["s11"]).otherwise(a["s11"] + a["c"] * c).alias("s11"),
            F.when(first | (a["k"] == k), a["ch"]).otherwise(a["ch"] + 1.0).alias("ch"), c.alias("c"), k.alias("k"),
        )

    def runs_of(a: Column, c: Column) -> Column:
        """Squares of the counts of equal characters, from the sorted characters."""
        same = a["c"] == c
        return F.struct(F.when(same, a["sq"]).otherwise(a["sq"] + a["n"] * a["n"]).alias("sq"), F.when(same, a["n"] + 1.0).otherwise(F.lit(1.0)).alias("n"), c.alias("c"))

    def facts(code: Column) -> Column:
        begin = F.struct(zero.alias("s1"), zero.alias("s2"), zero.alias("s11"), zero.alias("ch"), F.lit(-1).alias("c"), F.lit(0).alias("k"))
        squares = F.aggregate(F.array_sort(code), F.struct(zero.alias("sq"), zero.alias("n"), F.lit(-1).alias("c")), runs_of, lambda a: a["sq"] + a["n"] * a["n"])
        return F.struct(F.size(code).cast("double").alias("n"), F.aggregate(code, begin, step).alias("t"), squares.alias("sq"))

    size = F.when(body.rlike("^[0-9A-F]+$"), 16.0).when(body.rlike("^[A-Z2-7]+$"), 32.0).when(body.rlike("^[0-9a-z]+$"), 36.0).when(body.rlike("^[0-9A-Z]+$"), 36.0).otherwise(64.0)

    def moments(f: Column) -> Column:
        n, t = f["n"], f["t"]
        mean = t["s1"] / n
        var, cov = t["s2"] / n - mean * mean, t["s11"] / (n - 1) - mean * mean
        return F.struct(n.alias("n"), f["sq"].alias("sq"), t["ch"].alias("ch"), F.when(var > 0, cov / var).otherwise(1.0).alias("r"), size.alias("k"))

    def judge(t: Column) -> Column:
        n, k = t["n"], t["k"]
        rate = F.when(k == 16, 0.469).when(k == 32, 0.305).when(k == 36, 0.401).otherwise(0.645)
        chi = (k / n * t["sq"] - n - (k - 1)) / F.sqrt(2 * (k - 1) * (n - 1) / n)
        runs = (t["ch"] - (n - 1) * rate) / F.sqrt((n - 1) * rate * (1 - rate))
        serial = t["r"] * F.sqrt(n)
        count = n * (n - 1) / 2
        z1 = (count * COLLISION - (t["sq"] - n) / 2) / F.sqrt(count * COLLISION * (1 + 0.02 * n))
        z2 = (t["ch"] - (n - 1) * CHANGE) / F.sqrt((n - 1) * CHANGE * (1 - CHANGE))
        z3 = (CORRELATION - t["r"]) * F.sqrt(n) / (1 - CORRELATION**2)
        keeps = (chi <= 5.0) & (F.abs(runs) <= 3.3) & (F.abs(serial) <= 3.3)
        return F.when(keeps, _phi_upper((z1 + z2 + z3) / 3.0**0.5)).otherwise(1.0)

    return _let(_let(_let(code, facts), moments), judge)


def _once(df: DataFrame, *columns: str) -> DataFrame:
    """A barrier: costly columns are computed once, not inlined into the lambdas above."""
    rest = [c for c in df.columns if c not in columns]
    return df.select(*rest, F.inline(F.array(F.struct(*columns))))


def tested(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with _sc_base, array<struct<start, kind, stop>> sorted, and _sc_t, array<struct<p, start, stop>> of the candidates."""
    text = text_of(text_col)
    none = F.array().cast(_CUT)
    cut = docs.withColumns(
        {
            "_sc_a": F.when(text.rlike(ASSIGN), _cut(text, ASSIGN, 2)).otherwise(none).cast(_CUT),
            "_sc_k": F.when(F.contains(text, F.lit("AKIA")), _cut(text, ACCESS)).otherwise(none).cast(_CUT),
            "_sc_h": F.when(text.rlike(HEX), _cut(text, HEX)).otherwise(none).cast(_CUT),
            "_sc_r": F.when(text.rlike(RANDOM), _cut(text, RANDOM)).otherwise(none).cast(_CUT),
        }
    )
    cut = _once(cut, "_sc_a", "_sc_k", "_sc_h", "_sc_r")
    base = F.concat(_placed(F.col("_sc_a"), 0, 12), _placed(F.col("_sc_k"), 1, 18), _placed(F.col("_sc_h"), 2, 16))
    placed = cut.withColumns({"_sc_base": F.array_sort(F.transform(base, _plain)), "_sc_c": _placed(F.col("_sc_r"), 3, 20)}).drop("_sc_a", "_sc_k", "_sc_h", "_sc_r")
    placed = _once(placed, "_sc_base", "_sc_c")
    free = _free(F.col("_sc_c"), F.col("_sc_base"))
    p = F.transform(free, lambda c: F.struct(_p_value(c["s"]).alias("p"), c["start"].alias("start"), c["stop"].alias("stop")))
    return _once(placed.withColumn("_sc_t", F.when(F.size("_sc_c") > 0, p).otherwise(F.array().cast(_TESTED))).drop("_sc_c"), "_sc_t")


def threshold(found: DataFrame) -> tuple[float, int]:
    """(mean length of all candidates, least step that is discovered) over the _sc_t of ``found``."""
    each = found.select(F.inline("_sc_t"))
    mean = each.agg(F.avg((F.col("stop") - F.col("start")).cast("double"))).first()[0]
    if mean is None:
        return 1.0, STEPS + 1
    steps = each.select(_step(F.col("p"), F.col("stop") - F.col("start"), mean).alias("step")).groupBy("step").agg(F.count("*").alias("n"))
    down = Window.orderBy(F.col("step").desc())  # at most STEPS + 2 rows
    counted = steps.select("step", F.sum("n").over(down.rowsBetween(Window.unboundedPreceding, 0)).alias("k"), F.sum("n").over(down.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("m"))
    best = counted.where((F.col("step") >= 0) & (F.col("m") <= F.col("k") * F.pow(F.lit(2.0), F.col("step") / 8))).agg(F.min("step")).first()[0]
    return mean, STEPS + 1 if best is None else best


def _step(p: Column, length: Column, mean: float) -> Column:
    """j of the least threshold that a p-value, weighted by length, reaches; -1 over RATE."""
    q = p * F.lit(mean) / length
    return F.when(q > RATE, -1).otherwise(F.least(F.lit(STEPS), F.floor(-8 * F.log2(q / RATE)).cast("int")))


def _decided(found: DataFrame, mean: float, least: int) -> DataFrame:
    kept = F.filter("_sc_t", lambda x: _step(x["p"], x["stop"] - x["start"], mean) >= least)
    random = F.transform(kept, lambda x: F.struct(x["start"].alias("start"), F.lit(3).alias("kind"), x["stop"].alias("stop")))
    return found.withColumn("_sc_all", F.array_sort(F.concat("_sc_base", random))).drop("_sc_t")


def spans(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with _sc_base and _sc_all: arrays of struct<start, kind, stop>, sorted; kinds by index in ``KINDS``.

    A pass over the texts finds the threshold; the text goes with the result, so callers drop it if they don't need it.
    """
    return _decided(tested(docs, text_col), *threshold(tested(docs.select(text_col), text_col).select("_sc_t")))


def _joined(spans_: str) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans_, lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["start"], x["stop"])), ",")


def digest(docs: DataFrame) -> DataFrame:
    """One row a document: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_random."""
    found = written(tested(docs.select("doc_id", "text")).drop("text"), "spans")
    found = _decided(found, *threshold(found))
    count = lambda k, c: F.size(F.filter(c, lambda x: x["kind"] == k)).cast("long")
    return found.select(
        "doc_id",
        *[count(k, "_sc_base").alias(f"n_{KINDS[k]}") for k in range(3)],
        F.sha2(_joined("_sc_base").cast("binary"), 256).alias("base_sha256"),
        _joined("_sc_all").alias("spans"),
        count(3, "_sc_all").alias("n_random"),
    )


_ASSIGN = ASSIGN.replace("'", "''")

SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
cut AS (
  SELECT rid, 0 AS kind, 12 AS least, unnest(string_split_regex(t, '{_ASSIGN}')) AS p, unnest(regexp_extract_all(t, '{_ASSIGN}')) AS m,
         unnest(regexp_extract_all(t, '{_ASSIGN}', 2)) AS g, generate_subscripts(string_split_regex(t, '{_ASSIGN}'), 1) AS i FROM d
  UNION ALL SELECT rid, 1, 18, unnest(string_split_regex(t, '{ACCESS}')), unnest(regexp_extract_all(t, '{ACCESS}')), unnest(regexp_extract_all(t, '{ACCESS}')), generate_subscripts(string_split_regex(t, '{ACCESS}'), 1) FROM d
  UNION ALL SELECT rid, 2, 16, unnest(string_split_regex(t, '{HEX}')), unnest(regexp_extract_all(t, '{HEX}')), unnest(regexp_extract_all(t, '{HEX}')), generate_subscripts(string_split_regex(t, '{HEX}'), 1) FROM d
  UNION ALL SELECT rid, 3, 20, unnest(string_split_regex(t, '{RUN}+={{0,2}}')), unnest(regexp_extract_all(t, '{RUN}+={{0,2}}')), unnest(regexp_extract_all(t, '{RUN}+={{0,2}}')), generate_subscripts(string_split_regex(t, '{RUN}+={{0,2}}'), 1) FROM d
),
placed AS (
  SELECT *, start + length(m) AS stop FROM (SELECT rid, kind, least, m, g, sum(length(p) + coalesce(length(m), 0)) OVER (PARTITION BY rid, kind ORDER BY i) - length(m) AS start FROM cut) WHERE m IS NOT NULL
),
base AS (SELECT rid, kind, start, stop FROM placed WHERE kind < 3 AND length(g) >= least),
cand AS (
  SELECT rid, start, stop, rtrim(m, '=') AS body FROM placed c
  WHERE kind = 3 AND length(rtrim(m, '=')) >= 20 AND regexp_matches(m, '[0-9]') AND regexp_matches(m, '[A-Za-z]') AND NOT EXISTS (SELECT 1 FROM base b WHERE b.rid = c.rid AND b.start < c.stop AND c.start < b.stop)
),
chars AS (
  SELECT rid, start, i, ascii(c) AS c, CASE WHEN ascii(c) BETWEEN 48 AND 57 THEN 1 WHEN ascii(c) BETWEEN 65 AND 90 THEN 2 WHEN ascii(c) BETWEEN 97 AND 122 THEN 3 ELSE 4 END AS k
  FROM (SELECT rid, start, unnest(string_split(body, '')) AS c, generate_subscripts(string_split(body, ''), 1) AS i FROM cand)
),
nexts AS (SELECT *, lag(c) OVER w AS c0, lag(k) OVER w AS k0 FROM chars WINDOW w AS (PARTITION BY rid, start ORDER BY i)),
sums AS (SELECT rid, start, count(*)::DOUBLE AS n, count(*) FILTER (WHERE k <> k0)::DOUBLE AS ch, sum(c)::DOUBLE AS s1, sum(c * c)::DOUBLE AS s2, coalesce(sum(c * c0), 0)::DOUBLE AS s11 FROM nexts GROUP BY rid, start),
sq AS (SELECT rid, start, sum(x * x)::DOUBLE AS sq FROM (SELECT rid, start, c, count(*) AS x FROM chars GROUP BY rid, start, c) GROUP BY rid, start),
stats AS (
  SELECT cand.rid, cand.start, cand.stop, n, ch, sq,
    CASE WHEN s2 / n - (s1 / n) * (s1 / n) > 0 THEN (s11 / (n - 1) - (s1 / n) * (s1 / n)) / (s2 / n - (s1 / n) * (s1 / n)) ELSE 1.0::DOUBLE END AS r,
    CASE WHEN regexp_full_match(body, '[0-9A-F]+') THEN 16.0::DOUBLE WHEN regexp_full_match(body, '[A-Z2-7]+') THEN 32.0::DOUBLE WHEN regexp_full_match(body, '[0-9a-z]+') OR regexp_full_match(body, '[0-9A-Z]+') THEN 36.0::DOUBLE ELSE 64.0::DOUBLE END AS k
  FROM cand JOIN sums USING (rid, start) JOIN sq USING (rid, start)
),
z AS (
  SELECT rid, start, stop, n,
    (k / n * sq - n - (k - 1)) / sqrt(2 * (k - 1) * (n - 1) / n) AS chi, (ch - (n - 1) * rate) / sqrt((n - 1) * rate * (1 - rate)) AS runs, r * sqrt(n) AS serial,
    ((n * (n - 1) / 2 * {COLLISION} - (sq - n) / 2) / sqrt(n * (n - 1) / 2 * {COLLISION} * (1 + 0.02 * n)) + (ch - (n - 1) * {CHANGE}) / sqrt((n - 1) * {CHANGE} * (1 - {CHANGE})) + ({CORRELATION} - r) * sqrt(n) / (1 - {CORRELATION} * {CORRELATION})) / sqrt(3.0::DOUBLE) AS z
  FROM (SELECT *, CASE k WHEN 16 THEN 0.469::DOUBLE WHEN 32 THEN 0.305::DOUBLE WHEN 36 THEN 0.401::DOUBLE ELSE 0.645::DOUBLE END AS rate FROM stats)
),
p AS (SELECT rid, start, stop, CASE WHEN chi <= 5 AND abs(runs) <= 3.3 AND abs(serial) <= 3.3 THEN 1 / (1 + exp(least(700.0::DOUBLE, 0.07056 * z * z * z + 1.5976 * z))) ELSE 1.0::DOUBLE END AS p FROM z),
q AS (SELECT rid, start, stop, p * (SELECT avg((stop - start)::DOUBLE) FROM p) / (stop - start) AS q FROM p),
j AS (SELECT *, CASE WHEN q > {RATE} THEN -1 ELSE least({STEPS}, floor(-8 * log2(q / {RATE}::DOUBLE))::INTEGER) END AS step FROM q),
level AS (
  SELECT coalesce(min(step), {STEPS} + 1) AS least FROM (SELECT step, sum(n) OVER (ORDER BY step DESC) AS k, sum(n) OVER () AS m FROM (SELECT step, count(*) AS n FROM j GROUP BY step))
  WHERE step >= 0 AND m <= k * pow(2.0::DOUBLE, step / 8)
),
found AS (SELECT rid, 3 AS kind, start, stop FROM j, level WHERE step >= level.least),
named AS (SELECT *, ['assign', 'access', 'hex', 'random'][kind + 1] || ':' || start || ':' || stop AS s FROM (SELECT * FROM base UNION ALL SELECT * FROM found))
SELECT d.doc_id, count(*) FILTER (WHERE kind = 0)::BIGINT AS n_assign, count(*) FILTER (WHERE kind = 1)::BIGINT AS n_access, count(*) FILTER (WHERE kind = 2)::BIGINT AS n_hex,
  sha256(coalesce(string_agg(s, ',' ORDER BY start, kind, stop) FILTER (WHERE kind < 3), '')) AS base_sha256, coalesce(string_agg(s, ',' ORDER BY start, kind, stop), '') AS spans, count(*) FILTER (WHERE kind = 3)::BIGINT AS n_random
FROM d LEFT JOIN named USING (rid) GROUP BY d.rid, d.doc_id
"""
