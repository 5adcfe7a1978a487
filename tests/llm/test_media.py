import hashlib
import json
import os
import zlib

import pytest

from bitlark.llm import media
from tests.llm.helpers import clashing, frame, odd_rows


def test_round_trip(spark):
    rows = odd_rows()
    got = media.digest(clashing(frame(spark, rows))).collect()
    want = []
    for d, t, *_ in rows:
        data = (t or "").encode()
        p = data + b"\xff" * (-len(data) % 576 or (0 if data else 576))
        want.append((d, len(data), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:])))
    assert sorted((tuple(r[:5]) for r in got), key=repr) == sorted(want, key=repr)
    same = {}
    for r in got:
        assert same.setdefault((r.payload_sha256, r.n_bytes), tuple(r[5:])) == tuple(r[5:])
    assert media.digest(frame(spark, rows).limit(0)).count() == 0


def test_png_is_lossless_and_guarded():
    for data in (b"", b"x" * 576, bytes(range(256)) * 9):
        p = media.padded(data)
        assert media.from_png(media.to_png(p)) == p
    png = media.to_png(media.padded(b"abc"))
    for bad in (png[1:], png[:-20], png[:50] + b"\x00" + png[51:]):
        with pytest.raises(Exception):  # noqa: B017
            media.from_png(bad)


def test_ranges_and_retries(spark, tmp_path):
    folder = str(tmp_path / "a")
    rows = [(i, f"text {i} " * (i + 1)) for i in range(40)]
    assert media.pack(frame(spark, rows).select("doc_id", "text"), folder) == 40
    stray = tmp_path / "a" / "part-lost.tar"
    stray.write_bytes(b"left by a lost attempt")
    for size in (512, 5000, 1 << 20):
        got = media.members(spark, folder, range_bytes=size)
        assert {int(r.doc_id) for r in got.collect()} == set(range(40)) and got.count() == 40
    name, _, _ = json.load(open(tmp_path / "a" / "manifest.json"))[0]
    path = tmp_path / "a" / f"{name}.tar"
    data = bytearray(path.read_bytes())
    data[540] ^= 0xFF  # inside the first member
    path.write_bytes(data)
    with pytest.raises(Exception, match="MediaError|at 0"):
        media.members(spark, folder, retries=1).collect()
    bad = media.members(spark, folder, retries=0, mode="permissive").where("error IS NOT NULL").collect()
    assert len(bad) == 1 and bad[0].offset == 0 and bad[0].media is None
    assert media.members(spark, folder, retries=0, mode="permissive").where("error IS NULL").count() == 39


def test_a_failing_read_is_repeated_for_its_member_only(spark, tmp_path, monkeypatch):
    folder = str(tmp_path / "a")
    media.pack(frame(spark, [(i, "t" * i) for i in range(5)]).coalesce(1).select("doc_id", "text"), folder)
    reader = media.ArchiveReader({"path": folder, "retries": "2"})
    seen, real = [], media.verified

    def flaky(data):
        seen.append(1)
        if len(seen) in (2, 3):
            raise OSError("store")
        return real(data)

    monkeypatch.setattr(media, "verified", flaky)
    monkeypatch.setattr(media.time, "sleep", lambda s: None)
    rows = [r for part in reader.partitions() for b in reader.read(part) for r in b.to_pylist()]
    assert len(rows) == 5 and len(seen) == 7
    assert os.path.exists(f"{folder}/manifest.json")


def test_ids_of_any_kind(spark):
    docs = [("a/b/../c", "x"), ("n" * 300, "y"), ("null", "z"), (None, None), ("é 日", "")]
    got = media.digest(spark.createDataFrame(docs, "doc_id string, text string")).collect()
    assert {(r.doc_id, r.n_bytes) for r in got} == {(d, len(t or "")) for d, t in docs}
