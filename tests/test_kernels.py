"""Numpy kernels: identities and known answers."""

import numpy as np
import pytest

from quillspan.functions import dsp, morphology as mo, tcn

RATE = 8000.0
T = np.arange(4000) / RATE


def test_band_pass_keeps_and_rejects():
    keep, gone = np.sin(2 * np.pi * 500 * T), np.sin(2 * np.pi * 3000 * T)
    y = dsp.band_pass(keep + gone, 300, 800, RATE)
    middle = slice(800, 3200)
    assert np.corrcoef(y[middle], keep[middle])[0, 1] > 0.99
    assert abs(np.std(y[middle]) / np.std(keep[middle]) - 1) < 0.05


def test_resample_keeps_a_tone():
    y = dsp.resample(np.sin(2 * np.pi * 200 * T), 8000, 4000)
    want = np.sin(2 * np.pi * 200 * np.arange(len(y)) / 4000)
    assert len(y) == 2000 and np.abs(y - want)[100:-100].max() < 0.02


def test_pitch():
    assert np.median(dsp.yin(np.sin(2 * np.pi * 220 * T), RATE)) == pytest.approx(220, rel=0.02)


def test_delta_of_a_line_is_its_slope():
    assert np.allclose(dsp.delta(3.0 * np.arange(30)[:, None])[5:-5], 3)


def test_mel_bank_and_shapes():
    bank = dsp.mel_bank(RATE, 512, 20)
    assert bank.shape == (20, 257) and (bank >= 0).all() and (bank.sum(axis=1) > 0).all()
    assert dsp.mfcc(np.sin(T), RATE).shape[1] == 13 and len(dsp.mfcc_statistics(np.sin(T), RATE)) == 78


def test_dct_is_orthonormal():
    x = np.random.default_rng(0).normal(size=16)
    assert np.allclose((dsp.dct(x, 16) ** 2).sum(), (x**2).sum())


def test_morphology_laws():
    x = np.random.default_rng(1).normal(size=(12, 9))
    w = mo.flat(3)
    assert (mo.opening(x, w) <= x).all() and (mo.closing(x, w) >= x).all()
    assert np.allclose(mo.opening(mo.opening(x, w), w), mo.opening(x, w))
    assert np.allclose(mo.dilate(x, w), -mo.erode(-x, w)) and (mo.gradient(x, w) >= 0).all()
    assert np.allclose(mo.gradient(x, w), mo.inner_gradient(x, w) + mo.outer_gradient(x, w))
    assert (mo.h_maxima(x, 0.5) <= x).all() and (mo.h_minima(x, 0.5) >= x).all()
    assert mo.pool(x, 3, "gradient").shape == (4, 3)
    assert np.array_equal(mo.leveling(x, x), x)


def test_strides_padding_and_rates():
    x, w = np.random.default_rng(6).normal(size=(7, 6)), np.random.default_rng(7).normal(size=(3, 2))
    for strides, padding, rates in (((2, 3), "same", (1, 1)), ((1, 2), "valid", (2, 1)), ((1, 1), "same", (1, 2)), ((1, 1), "valid", (1, 1))):
        reach = [(k - 1) * r + 1 for k, r in zip(w.shape, rates)]
        size = [-(-n // s) if padding == "same" else (n - k) // s + 1 for n, s, k in zip(x.shape, strides, reach)]
        before = [max((m - 1) * s + k - n, 0) // 2 if padding == "same" else 0 for m, n, s, k in zip(size, x.shape, strides, reach)]
        for f, best, sign in ((mo.dilate, max, 1), (mo.erode, min, -1), (mo.convolve, sum, 0)):
            got = f(x, w, strides, padding, rates)
            assert got.shape == tuple(size)
            for i in range(size[0]):
                for j in range(size[1]):
                    cells = [(i * strides[0] - before[0] + a * rates[0], j * strides[1] - before[1] + b * rates[1], w[a, b]) for a in range(3) for b in range(2)]
                    assert got[i, j] == pytest.approx(best(x[p, q] * v if sign == 0 else x[p, q] + sign * v for p, q, v in cells if 0 <= p < 7 and 0 <= q < 6))
    assert mo.dilate(x, np.zeros((9, 9)), padding="valid").size == 0


def test_network_is_a_distribution_and_causal():
    net, x = tcn.make(2, 4, 3), np.random.default_rng(2).normal(size=(40, 2))
    p = tcn.forward(net, x, causal=True)
    assert np.allclose(p.sum(axis=1), 1)
    y = x.copy()
    y[30:] += 5
    assert np.allclose(tcn.forward(net, y, causal=True)[:30], p[:30])
    assert tcn.receptive_field(3, 1, 8) == 24 and tcn.adjusted([0, 1, 2]) == [1, 2, 4]


def test_weights_of_elements():
    w = np.array([[0.5, -0.5, 0.2], [1.0, 0.3, -2.0], [0.0, 0.0, 0.0]])
    assert mo.non_positive(w).max() == 0 and mo.non_positive(w, True)[1, 1] == 0 and mo.lattice(w).min() == -1 and mo.zero_to_one(w).max() == 1
    assert mo.start("minus_ones_zero_centre", (3, 3)).sum() == -8 and mo.lattice_penalty(mo.start("minus_ones", (3, 3)), 1, 1) == 0
    assert set(np.unique(mo.start("signed", (9, 9)))) == {-1.0, 1.0} and np.isneginf(mo.masked_element(w, mo.diamond(3))[0, 0])
    x = np.random.default_rng(5).normal(size=(2, 6, 6))
    assert mo.profile(x[0], (3, 5)).shape == (5, 6, 6) and mo.separable(x, [mo.flat(3)] * 2).shape == (6, 6)
    p = np.full((5, 2), 0.5)
    assert tcn.weighted_loss(p, np.eye(2)[[0, 1, 0, 1, 0]]) == pytest.approx(np.log(2))


def test_windows_unroll(spark):
    from quillspan.operators import signal

    df = spark.createDataFrame([(1, [float(i) for i in range(10)])], "k long, x array<double>")
    from pyspark.sql import functions as F

    w = df.select("k", F.posexplode(signal.windows_of("x", 4, 1, 2)).alias("window_id", "w"))
    assert w.count() == 6
    got = signal.flattened(w, ["k"], "w", 1, 1).select("frame", "value").distinct().orderBy("frame").collect()
    assert [(r["frame"], r["value"]) for r in got] == [(i, float(i)) for i in range(1, 8)]
    assert signal.sub_range(spark.range(100), "id", 100, 0.2, 1).count() == 20
