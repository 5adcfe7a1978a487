"""Rows that every operator must stand, and plain Python versions of shared parts."""

import re
from collections import Counter

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def frame(spark, rows, schema=SCHEMA):
    """Rows of (doc_id, text[, lang[, source]]), over several partitions."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "s", len(r[1] or "")) for r in rows]
    return spark.createDataFrame(full, schema).repartition(3)


def odd_rows():
    """Nulls everywhere, empty and blank texts, repeats, non-ASCII, control characters and one very long text."""
    long = " ".join(f"w{i % 5000}x" for i in range(120_000)) + "\n" + "The same long line of more than forty code points here.\n" * 3
    return [
        (None, None, None, None), (None, "a text without an id", None, "s"), (1, None), (2, ""), (3, " \t\n\x0b "), (4, "\n\n"), (5, "one"), (5, "one"), (6, "Ünï©ode — ÉÈ 日本語 word"), (7, "!!! ??? ###"),
        (8, long), (9, "repeat " * 500), (10, "x" * 5000), (11, "a\x00b\x7fc"), (12, "emoji 😀 here 😀"),
    ]


def clashing(df):
    """Extra columns named like an operator's own."""
    from pyspark.sql import functions as F

    return df.withColumns({c: F.lit(1) for c in ("size", "score", "lines", "node", "th", "key", "target", "taken", "id", "place", "spans", "rank")})


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def words(text):
    return WORD.findall(lower(text))


def bag(text):
    w = words(text)
    if not w:
        return None
    return Counter([tuple(w)]) if len(w) < 5 else Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))


def overlap(a, b):
    common = sum((a & b).values())
    return common / (sum(a.values()) + sum(b.values()) - common)


def lorem(seed, n):
    import random

    rng = random.Random(seed)
    return [rng.choice("ba ce di fo gu ha je ki lo mu na pe ri so tu va we xi yo zu".split()) + rng.choice("bal cen dir fos gum".split()) + str(rng.randrange(40)) for _ in range(n)]
