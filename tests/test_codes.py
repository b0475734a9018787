"""Codes, plans and estimates on fixtures made here."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from vecloom.operators import quantize, transforms
from vecloom.operators.knn import distances, leading
from vecloom.operators.search import Estimator
from vecloom.plans.bits import cost, equal_plan, make_plan, planned
from vecloom.plans.config import IP, L2, CodeConfig, QuantizeConfig, SearchConfig, real_bits
from vecloom.plans.model import Model

RNG = np.random.default_rng(5)


def cosine(o, code, bits):
    a = quantize.levels(code, bits)
    return (o * a).sum(axis=1) / np.sqrt((o * o).sum(axis=1) * (a * a).sum(axis=1))


@pytest.mark.parametrize("bits", [1, 2, 4, 8, 13])
def test_adjustment_never_turns_away(bits):
    o = RNG.standard_normal((50, 24))
    before = quantize.grid(o, bits)
    after = quantize.adjust(o, before, bits, 6, 1e-8)
    assert (cosine(o, after, bits) >= cosine(o, before, bits) - 1e-12).all()
    assert after.min() >= 0 and after.max() < 2**bits
    if bits in (2, 4):
        assert cosine(o, after, bits).mean() > cosine(o, before, bits).mean()


def test_adjustment_matches_one_row_at_a_time():
    o = RNG.standard_normal((20, 12))
    together = quantize.adjust(o, quantize.grid(o, 3), 3, None, 1e-8)
    alone = [quantize.adjust(r[None], quantize.grid(r[None], 3), 3, None, 1e-8)[0] for r in o]
    assert (together == np.array(alone)).all()


def test_edge_vectors():
    o = np.array([[0.0] * 8, [0, 0, 5, 0, 0, 0, 0, 0], [1.0] * 8, [1e-30] * 8, [1e30, -1e30] * 4])
    code, factors = quantize.encode_part(o, 4, CodeConfig())
    assert np.isfinite(factors).all()
    assert (factors[0] == 0).all() and (code[0] == 0).all()
    assert factors[2, 3] == pytest.approx(1)
    assert quantize.encode_part(o, 0, CodeConfig())[1][2, 0] == pytest.approx(np.sqrt(8))
    with pytest.raises(ValueError):
        quantize.encode_part(o, 14, CodeConfig())


@given(st.integers(1, 13), st.integers(1, 70), st.integers(0, 2**32 - 1))
@settings(max_examples=60, deadline=None)
def test_bit_packing_round_trip(bits, length, seed):
    code = np.random.default_rng(seed).integers(0, 2**bits, length)
    top, rest = quantize.pack_codes(code, bits)
    assert len(top) == -(-length // 8) and len(rest) == -(-length * (bits - 1) // 8)
    assert (quantize.unpack_codes(top, rest, bits, length) == code).all()


def test_plans():
    var = np.repeat([8.0, 4.0, 1.0, 0.1], 64)
    assert [(s.length, s.bits) for s in equal_plan(256, 4, 3, 64)] == [(64, 3)] * 4
    assert [s.length for s in equal_plan(320, 2, 3, 64)] == [192, 128]
    for bits in (1, 2, 3.5, 4, 8):
        plan = planned(var, bits, 64)
        assert sum(s.length for s in plan) == 256
        assert sum(s.length * s.bits + 64 * (s.bits > 0) for s in plan) <= bits * 256 + 64
        assert cost(var, plan) <= cost(var, equal_plan(256, 1, int(bits), 64)) * 1.01
    uneven = planned(var, 4, 64)
    assert uneven[0].bits > uneven[-1].bits
    # One block of dimensions still gets its bits.
    assert [(s.length, s.bits) for s in planned([1.0] * 64, 4, 64)] == [(64, 4)]
    # What has no variance gets none.
    assert planned([1.0] * 64 + [0.0] * 64, 1.5, 64)[-1].bits == 0
    assert make_plan([1.0] * 100, QuantizeConfig(avg_bits=4, segmentation=False))[0].length == 128


def test_settings():
    assert real_bits(4, 64) == 5
    for bad in ({"distance": "cos"}, {"avg_bits": 14}, {"dim_block": 0}):
        with pytest.raises(ValueError):
            QuantizeConfig(**bad)
    with pytest.raises(ValueError):
        CodeConfig(source_bits=14)


def test_rotation_keeps_norms():
    turn = transforms.random_rotation(40, 3)
    assert np.allclose(turn @ turn.T, np.eye(40))
    assert np.allclose(turn, transforms.random_rotation(40, 3))


@pytest.mark.parametrize("kind", [L2, IP])
@pytest.mark.parametrize("dims", [64, 100, 256])
def test_estimates_close_in(kind, dims):
    scale = 0.5 ** (np.arange(dims) / 32)
    x, q = RNG.standard_normal((200, dims)) * scale, RNG.standard_normal((5, dims)) * scale
    centroid = x.mean(axis=0)
    real = distances(x, q, kind)
    errors = {}
    for bits in (1, 4, 8):
        model = Model.fit(x.var(axis=0), QuantizeConfig(avg_bits=bits, dim_block=16 if bits >= 2 else 64, distance=kind))
        code, factors = quantize.encode_matrix(x - centroid, model)
        bound, fast, accurate = Estimator(model, SearchConfig(kind)).all(q, centroid, code, factors)
        errors[bits] = np.abs(accurate - real).mean()
        assert np.abs(accurate - real).mean() <= np.abs(fast - real).mean() + 1e-12
        if kind == L2:
            assert (bound <= real + 1e-9).mean() > 0.95
    assert errors[1] > errors[4] > errors[8]


def test_segments_help_where_variance_is_uneven():
    scale = np.repeat([4.0, 1.0, 0.25, 0.05], 64)
    x, q = RNG.standard_normal((300, 256)) * scale, RNG.standard_normal((5, 256)) * scale
    real, out = distances(x, q, L2), {}
    for seg in (True, False):
        model = Model.fit(x.var(axis=0), QuantizeConfig(avg_bits=4, segmentation=seg))
        code, factors = quantize.encode_matrix(x, model)
        out[seg] = np.abs(Estimator(model, SearchConfig()).all(q, np.zeros(256), code, factors)[2] - real).mean()
    assert out[True] < out[False]


def test_leading_breaks_ties_by_id():
    v, ids = np.array([[1.0, 0.5, 0.5, 0.5, 2.0, 9, 9, 9, 9, 9, 9, 9]]), np.array([7, 9, 3, 5, 1, 20, 21, 22, 23, 24, 25, 26])
    assert ids[leading(v, ids, 2, L2)[0]].tolist() == [3, 5]
    assert ids[leading(v[:, :5], ids[:5], 2, IP)[0]].tolist() == [1, 7]
