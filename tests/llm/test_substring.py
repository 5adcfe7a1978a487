import random
import re

import pyarrow as pa

from bitlark.llm import substring
from bitlark.llm.common import text_slices
from tests.llm.helpers import clashing, frame, lorem, odd_rows


def pieces(text):
    """Chunks of one text: digest, words, place of the first among the text's words."""
    out = []
    for _, _, raw, offsets in text_slices(pa.array([text])):
        data = text.encode()
        for row, digest, start, stop in zip(*(x.tolist() for x in substring.chunks(raw, offsets)), strict=True):
            assert row == 0
            out.append((digest, tuple(plain_words(data[start:stop].decode())), len(plain_words(data[:start].decode()))))
    return out


def plain_words(text):
    return re.findall(r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", "".join(c.lower() if c.isascii() else c for c in text))


def plain_digest(rows):
    """The columns of digest() by plain Python over all texts."""

    def gear(word):
        return sum(int(substring.GEAR[b]) << k for k, b in enumerate(reversed(word.encode()[-16:]))) & 0xFFFF

    def starts(words):
        h = [gear(w) for w in words]
        n = substring.WINDOW
        at = {min(range(i, i + n), key=lambda j: (h[j], -j)) for i in range(len(words) - n + 1)}
        return [i for i in sorted(at) if i + substring.LENGTH <= len(words)]

    cut, holders = [], {}
    for doc, text in rows:
        lower = "".join(c.lower() if c.isascii() else c for c in text or "")
        found = [(m.group(), len(lower[: m.start()].encode()), len(lower[: m.end()].encode())) for m in re.finditer(r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lower)]
        words = [w for w, _, _ in found]
        mine = [(found[i][1], found[i + substring.LENGTH - 1][2], tuple(words[i : i + substring.LENGTH])) for i in starts(words)]
        cut.append(mine)
        for _, _, key in mine:
            holders.setdefault(key, set()).add(doc)
    out = []
    for (doc, _), mine in zip(rows, cut, strict=True):
        spans = []
        end = -1
        for start, stop, key in mine:
            if doc is None or len(holders[key] - {None}) < 2:
                continue
            keeper = min(holders[key] - {None})
            if spans and start <= end and spans[-1][2] == keeper:
                spans[-1][1] = stop
            else:
                if spans and start <= end:
                    spans[-1][1] = start
                spans.append([start, stop, keeper])
            end = stop
        gone = [x for x in spans if x[2] != doc]
        size = lambda s: sum(b - a for a, b, _ in s)
        out.append((doc, bool(spans), len(spans), size(spans), size(gone), sorted({k for _, _, k in gone})))
    return out


def test_gear_is_the_plain_sum():
    raw = pa.array(["some bytes for a rolling hash, é"]).buffers()[2]
    import numpy as np

    x = np.frombuffer(raw, np.uint8)
    slow = [sum(int(substring.GEAR[x[i - k]]) << k for k in range(16) if i >= k) & 0xFFFF for i in range(len(x))]
    assert substring.gear(x).tolist() == slow


def test_insertions_move_only_their_neighbours():
    words = lorem(1, 600)
    a = pieces(" ".join(words))
    words.insert(300, "inserted é word")
    b = pieces("A new beginning! " + ", ".join(words))
    there = {d for d, _, _ in b}
    assert all(len(w) == substring.LENGTH for _, w, _ in a + b)
    # all chunks but those that hold the place, or whose cut stands next to it
    near = range(300 - substring.LENGTH + 1 - substring.WINDOW, 300 + substring.WINDOW)
    assert all(d in there for d, _, at in a if at not in near and at >= substring.WINDOW)
    assert len(a) > 100  # many cuts in 600 words


def test_columns_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    base = lorem(5, 400)
    # overlapping passages of several keepers, repeats within a text, repeated rows, punctuation and other scripts
    more = [base[:120], base[60:200], base[10:53] + ["Ünder"] + base[150:330], base[40:90] * 3, base[200:250], base[200:251], base[250:293] * 2, base[:120], ["word"] * 90, ["word"] * 60]
    rows += [(9000 - i, (", é " if i == 5 else ", " if i % 2 else " ").join(w.upper() if i % 3 else w for w in x)) for i, x in enumerate(more)]
    rows += [rows[-1], (None, " ".join(base)), (9900, None), (9901, "")]
    got = [tuple(r) for r in substring.digest(frame(spark, rows)).collect()]
    want = plain_digest(rows)
    key = lambda r: (r[0] is None, r[0] or 0, repr(r))
    assert sorted(got, key=key) == sorted(want, key=key)
    assert sum(r[1] for r in want) > 20 and any(r[2] > 1 and r[3] > r[4] > 0 for r in want)


def test_repeats_over_fifty_words_are_found_and_clean_texts_left(spark):
    rng = random.Random(2)
    passages = [lorem(1000 + i, 51 + i % 20) for i in range(40)]
    sentence = lorem(77, 20)  # too short to be a passage
    rows, planted = [], {}
    for i in range(160):
        own = lorem(i, 120)
        at = rng.randrange(120)
        if i % 2:
            p = i // 2 % 40
            own[at:at] = [w.upper() if i % 3 == 0 else w for w in passages[p]]
            planted.setdefault(p, []).append(i)
        elif i % 4 == 0:
            own[at:at] = sentence
        rows.append((i, (" " if i % 5 else " | ").join(own)))
    df = frame(spark, rows)
    got = {r.doc_id: r for r in substring.digest(df).collect()}
    holders = {i for x in planted.values() for i in x}
    assert {i for i, r in got.items() if r.repeated} == holders
    for x in planted.values():
        assert got[min(x)].dropped_bytes == 0
        assert all(got[i].kept_by == [min(x)] for i in x if i != min(x))
    left = {r.doc_id: r.text for r in substring.drop(df).collect()}
    for p, x in planted.items():
        inner = passages[p][16:-16]
        for i in x:
            gone = inner and " ".join(inner[:3]) not in " ".join(left[i].lower().replace("|", " ").split())
            assert bool(gone) == (i != min(x))
    assert all(left[i] == t for i, t in rows if i not in holders)


def test_every_passage_of_51_words_is_found():
    def found_in(texts):
        out = []
        for _, _, raw, offsets in text_slices(pa.array(texts)):
            row, digest, _, _ = substring.chunks(raw, offsets)
            out += [set(digest[row == i].tolist()) for i in range(len(offsets) - 1)]
        return out

    rng = random.Random(5)
    word = lambda m: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(1, m)))
    texts, n = [], 1500
    for k in range(n):
        m = 2 + k % 9
        passage = [word(m) for _ in range(51)]
        if k % 10 == 0:  # a repeated word, rows of equal cells
            passage = ([word(m) for _ in range(1 + k // 10 % 4)] * 51)[:51]
        for _ in range(2):
            texts.append(" ".join([*(word(m) for _ in range(rng.randrange(60))), *passage, *(word(m) for _ in range(rng.randrange(60)))]))
    found = found_in(texts)
    assert all(a & b for a, b in zip(found[::2], found[1::2], strict=True))


def test_nothing_under_44_common_words_is_marked(spark):
    rng, rows = random.Random(8), []
    for k in range(60):
        passage = lorem(3000 + k, 20 + k % 24)
        for j in range(2):
            own = lorem(5000 + 2 * k + j, 90)
            at = rng.randrange(90)
            rows.append((2 * k + j, " ".join([*own[:at], *passage, *own[at:]])))
    longest = max(len(p) for p in (lorem(3000 + k, 20 + k % 24) for k in range(60)))
    assert longest == substring.LENGTH - 1
    assert not any(r[1] for r in plain_digest(rows)) and not substring.digest(frame(spark, rows)).where("repeated").count()


def test_odd_rows(spark):
    rows = odd_rows() + [(5, "é " + " ".join(lorem(9, 90))), (14, "ß " + " ".join(lorem(9, 90)) + " é" * 30), (None, " ".join(lorem(9, 90)))]
    df = clashing(frame(spark, rows))
    got = substring.digest(df).collect()
    assert len(got) == len(rows) and {r.doc_id for r in got if r.repeated} == {5, 14}
    out = substring.drop(df)
    assert out.columns == [*df.columns, "_sd_spans"] and out.count() == len(rows)
    assert substring.digest(df.limit(0)).count() == 0
