import random
from fractions import Fraction

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from bitlark import errors
from bitlark.functions import codes, metrics

triples = st.integers(0, 300).flatmap(lambda m: st.tuples(st.integers(0, m), st.integers(0, 200), st.just(m))).map(lambda t: (t[0], t[0] + t[1], t[2]))


@given(triples, st.sampled_from(metrics.METRICS), st.integers(0, 50))
@settings(max_examples=300, deadline=None)
def test_bound_is_upper_and_inverse_never_excludes(t, metric, low):
    a, w, m = t
    s = metrics.score(metric, a, w, m)
    w_min = min(low, w)
    assert metrics.bound(metric, a, m).key >= s.key
    assert metrics.bound(metric, a, m, w_min).key >= s.key
    assert metrics.least_intersection(metric, s, m) <= a or metric in ("jaccard", "cosine") and not m
    assert metrics.least_intersection(metric, s, m, w_min) <= max(a, 0) or m == 0
    span = metrics.weight_range(metric, s, m)
    assert span is None or span[0] <= w <= span[1]


def test_double_key_orders_like_integers():
    rng = random.Random(3)
    for _ in range(20_000):
        m = rng.randint(1, 65_536)
        pair = []
        for _ in range(2):
            a = rng.randint(0, m)
            w = a + rng.randint(0, 65_536 - a)
            pair.append((a, w))
        for metric in ("jaccard", "cosine"):
            s = [metrics.score(metric, a, w, m) for a, w in pair]
            exact = (s[0].key > s[1].key) - (s[0].key < s[1].key)
            f = [x.num / x.den for x in s]
            assert exact == (f[0] > f[1]) - (f[0] < f[1])


def test_equal_by_value_and_zero_denominators():
    assert metrics.Score(1, 4).key == metrics.Score(2, 8).key == Fraction(1, 4)
    assert (metrics.score("jaccard", 0, 0, 0).num, metrics.score("jaccard", 0, 0, 0).den) == (0, 1)
    assert float(metrics.score("cosine", 0, 0, 5)) == 0.0
    assert metrics.hamming_distance(2, 5, 4) == 5 == -metrics.score("hamming", 2, 5, 4).num


def test_codes():
    assert codes.masked([-1, 5], 66) == [2**64 - 1, 1]
    assert codes.to_positions([1 << 63, 1], 65) == [63, 64]
    assert codes.to_words([63, 64, 99], 65) == [1 << 63, 1]
    assert codes.signed(1 << 63) == -(2**63)
    assert codes.parse_hex("ff, 1") == [255, 1]
    assert codes.rows_per_block(256) == 256 and codes.row_bits(65) == 128 and codes.complement_planes(256) == 9
    for bad in ([3, 3], [4, 1], [-1]):
        with pytest.raises(errors.InvalidArgument):
            codes.ascending(bad)
    for call, kind in (
        (lambda: codes.check_dims(0), errors.DimensionMismatch),
        (lambda: codes.check_dims(65_537), errors.TooManyDimensions),
        (lambda: codes.check_doc_id(1 << 36), errors.DocIdTooLarge),
        (lambda: codes.check_doc_id(2**64 - 1), errors.ReservedDocId),
        (lambda: codes.check_term(1 << 20), errors.AttrTermTooLarge),
        (lambda: metrics.check_metric("l2"), errors.InvalidArgument),
    ):
        with pytest.raises(kind):
            call()
    assert codes.check_dims(65_536) and codes.check_doc_id((1 << 36) - 1) and codes.check_term((1 << 20) - 1)
    assert errors.status(errors.DocIdTooLarge(1, 0)) == "internal" and errors.status(errors.AlreadyExists()) == "already_exists"
