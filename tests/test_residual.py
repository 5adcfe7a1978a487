import numpy as np
import pytest

from bitlark import errors
from bitlark.functions import fit, residual
from bitlark.functions.rng import SplitMix64
from bitlark.sources.vectors import read_f32


def small_model(**change):
    enc = np.zeros((500, 4), np.float32)
    for s in range(500):
        enc[s, s % 4] = 0.001 + (s % 7) * 0.0001
    dec = np.zeros((500, 4), np.int16)
    dec[:, 0] = 2
    dec[0, 0] = 1
    return residual.Model(**({"dims": 4, "norm_offset": 5000, "norm_step": 1e-7, "encoder": enc, "decoder": dec} | change))


def test_layout():
    signs = np.array([[(17 * b + 13 * i) % 29 < 14 for b in range(500)] for i in range(37)])
    norm = 311 * np.arange(37) % 4096
    codes = residual.pack(signs, norm)
    for i in range(37):
        raw = codes[i].tobytes()
        for b in range(496):
            assert (raw[b // 8] >> (b % 8) & 1) == signs[i, b]
        tail = raw[62] | raw[63] << 8
        assert tail >> 4 == norm[i] and [(tail >> b & 1) == 1 for b in range(4)] == signs[i, 496:].tolist()
    back, n = residual.unpack(codes)
    assert (back == signs).all() and (n == norm).all()
    with pytest.raises(errors.InvalidArgument):
        residual.pack(signs[:1], [4096])
    with pytest.raises(errors.DimensionMismatch):
        residual.pack(signs[:, :499], norm)


def test_scores_against_slow_integers():
    m = small_model()
    q = m.prepare(np.array([1, -0.25, 0.5, 0.125], np.float32))
    signs = np.array([[(17 * b + 13 * i) % 29 < 14 for b in range(500)] for i in range(9)])
    norm = 311 * np.arange(9) % 4096
    slow = [sum(int(w) if s else -int(w) for w, s in zip(q.weights, row, strict=True)) * (5000 + int(n)) for row, n in zip(signs, norm, strict=True)]
    assert q.score(residual.pack(signs, norm)).tolist() == slow


def test_encode_doesnt_depend_on_the_batch():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(64, 16)).astype(np.float32)
    m = fit.fit_rows(x, 7).model
    whole = m.encode(x)
    assert all((m.encode(x[i : i + 1])[0] == whole[i]).all() for i in range(0, 64, 9))
    # strict serial float32 sums
    rest = residual.normalize(x[:1], 16)[0]
    signs = []
    for atom in m.encoder:
        dot = np.float32(0)
        for a, b in zip(rest, atom, strict=True):
            dot = np.float32(dot + np.float32(a * b))
        signs.append(dot >= 0)
        rest = np.array([np.float32(r - (a if dot >= 0 else -a)) for r, a in zip(rest, atom, strict=True)], np.float32)
    assert residual.unpack(whole[:1])[0][0].tolist() == signs


def test_model_files(tmp_path):
    m = small_model()
    path = str(tmp_path / "m")
    m.save(path)
    assert residual.Model.load(path).model_id == m.model_id
    with pytest.raises(FileExistsError):
        m.save(path)
    data = m.to_bytes()
    assert len(data) == 68 + 6 * 2000
    for bad in (data[:50], b"x" + data[1:], data[:-1], data[:100] + b"\x01" + data[101:], data[:8] + b"\x09\x00" + data[10:]):
        with pytest.raises(errors.CorruptModel):
            residual.Model.from_bytes(bad)


def test_model_refusals():
    enc, dec = small_model().encoder.copy(), small_model().decoder.copy()
    zero = enc.copy()
    zero[3] = 0
    big = dec.copy()
    big[0, 0] = 2048
    for change, kind in (({"norm_step": 0.0}, errors.InvalidModel), ({"norm_offset": 0}, errors.InvalidModel), ({"encoder": zero}, errors.InvalidModel), ({"decoder": big}, errors.InvalidModel), ({"norm_offset": 2**62}, errors.ScoreOverflow), ({"decoder": dec[:, :3]}, errors.DimensionMismatch)):
        with pytest.raises(kind):
            small_model(**change)
    m = small_model()
    for bad in ([0, 0, 0, 0], [1, float("nan"), 0, 0]):
        with pytest.raises(errors.InvalidVector):
            m.prepare(bad)
    with pytest.raises(errors.NoModelIdentity):
        m.require(512, None)
    with pytest.raises(errors.DimensionMismatch):
        m.require(256, m.model_id)


def test_fit_repeats_and_recalls():
    rng = np.random.default_rng(5)
    x = (rng.normal(size=(4000, 24)) @ rng.normal(size=(24, 24))).astype(np.float32)
    a, b = fit.fit_rows(x[:3000], 42), fit.fit_rows(x[:3000], 42)
    assert a.model.model_id == b.model.model_id and a.clipped == 0
    x = x[3000:]
    unit = residual.normalize(x, 24).astype(np.float64)
    codes, hit = a.model.encode(x), 0
    for q in range(200, 230):  # held-out queries
        true = set(np.argsort(-(unit @ unit[q]))[:10])
        hit += len(true & set(np.argsort(-a.model.prepare(x[q]).score(codes), kind="stable")[:10]))
    assert hit / 300 > 0.75


def test_rng_known_values():
    r = SplitMix64(0)
    assert [hex(r.u64()) for _ in range(2)] == ["0xe220a8397b1dcdaf", "0x6e789e6aa1b965f4"]
    a, b = SplitMix64(9), SplitMix64(9)
    assert a.many(5).tolist() == [b.u64() for _ in range(5)]


def test_raw_vectors(spark, tmp_path):
    x = np.arange(60, dtype="<f4").reshape(15, 4)
    (tmp_path / "v").mkdir()
    (tmp_path / "v" / "a.f32").write_bytes(x[:10].tobytes())
    (tmp_path / "v" / "b.f32").write_bytes(x[10:].tobytes())
    got = read_f32(spark, str(tmp_path / "v"), 4, rows_per_part=4).orderBy("row").collect()
    assert [r.embedding for r in got] == x.tolist()
    with pytest.raises(errors.InvalidArgument):
        read_f32(spark, str(tmp_path / "v"), 7)


def test_signs_are_sums_in_order():
    """Against one document at a time and one addition at a time, for every size of a block."""
    rng = np.random.default_rng(9)
    model = residual.Model(7, 10, 1e-4, rng.normal(size=(500, 7)).astype(np.float32), rng.integers(-5, 6, (500, 7)).astype(np.int16))
    x = rng.normal(size=(residual.COLUMNS + 3, 7)).astype(np.float32)
    signs = model.signs_of(x)
    for n in (1, 2, 5, residual.COLUMNS, residual.COLUMNS + 1):
        assert (model.signs_of(x[:n]) == signs[:n]).all()
    for i in (0, 1, residual.COLUMNS, residual.COLUMNS + 2):
        rest = residual.normalize(x[i : i + 1], 7)[0]
        for s in range(500):
            dot = np.float32(0)
            for a, b in zip(rest, model.encoder[s], strict=True):
                dot = np.float32(dot + np.float32(a * b))
            assert signs[i, s] == (dot >= 0)
            rest = rest - (np.float32(1) if dot >= 0 else np.float32(-1)) * model.encoder[s]
