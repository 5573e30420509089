"""Every query by kernels or models against a plain version written from the definitions."""

import cmath
import math
from pathlib import Path

import numpy as np
import pytest

from quillspan.functions import dsp, tcn
from quillspan.operators import ml
from quillspan.plans import suite

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="no input tables")


@pytest.fixture(scope="module")
def signals(spark):
    return {r["vec_id"]: [float(v) for v in r["embedding"]] for r in spark.read.parquet(f"{DATA}/embeddings.parquet").select("vec_id", "embedding").collect()}


def values(spark, name):
    return {r["recording_id"]: r["values"] for r in suite.QUERIES[name](spark, DATA).collect()}


def some(signals, n=12):
    return sorted(signals)[:: max(1, len(signals) // n)]


def spectrum(x, size, hop):
    """Magnitudes of centred Hann frames by the sum of the transform."""
    wide = [0.0] * (size // 2) + list(x) + [0.0] * (size // 2)
    out = []
    for a in range(0, len(wide) - size + 1, hop):
        frame = [wide[a + i] * (0.5 - 0.5 * math.cos(2 * math.pi * i / size)) for i in range(size)]
        out.append([abs(sum(v * cmath.exp(-2j * math.pi * k * i / size) for i, v in enumerate(frame))) for k in range(size // 2 + 1)])
    return out


def slopes(c, width, order):
    """Derivatives of a polynomial fitted by numpy in each whole window, the outermost repeated."""
    half = width // 2
    k = np.arange(-half, half + 1)
    inner = [[math.factorial(order) * np.polyfit(k, [row[j] for row in c[t - half : t + half + 1]], order)[0] for j in range(len(c[0]))] for t in range(half, len(c) - half)]
    return [inner[0]] * half + inner + [inner[-1]] * half


def mel(f):
    return f * 3 / 200 if f < 1000 else 15 + math.log(f / 1000) / (math.log(6.4) / 27)


def hertz(m):
    return m * 200 / 3 if m < 15 else 1000 * math.exp((m - 15) * math.log(6.4) / 27)


def test_mfcc(spark, signals):
    got, rate, size, bands = values(spark, "mfcc"), 2000.0, 32, 12
    edges = [hertz(mel(rate / 2) * i / (bands + 1)) for i in range(bands + 2)]
    for i in some(signals, 6):
        rows = []
        for frame in spectrum(signals[i], size, 8):
            power = []
            for b in range(bands):
                lo, mid, hi = edges[b : b + 3]
                w = [max(0.0, min((k * rate / size - lo) / (mid - lo), (hi - k * rate / size) / (hi - mid))) * 2 / (hi - lo) for k in range(size // 2 + 1)]
                power.append(10 * math.log10(max(1e-10, sum(a * v * v for a, v in zip(w, frame)))))
            rows.append(power)
        top = max(map(max, rows))
        rows = [[max(v, top - 80) for v in r] for r in rows]
        cepstra = [[math.sqrt((1 if j == 0 else 2) / bands) * sum(v * math.cos(math.pi * (n + 0.5) * j / bands) for n, v in enumerate(r)) for j in range(13)] for r in rows]
        want = []
        for m in (cepstra, slopes(cepstra, 9, 1), slopes(cepstra, 9, 2)):
            want += [*np.mean(m, axis=0), *np.std(m, axis=0)]
        assert got[i] == pytest.approx(want, abs=2e-6)


def test_spectral_statistics(spark, signals):
    got = values(spark, "spectral_statistics")
    for i in some(signals):
        columns = [[], [], []]
        for s in spectrum(signals[i], 32, 8):
            total, f = sum(s), [k * 62.5 for k in range(17)]
            centre = sum(a * v for a, v in zip(f, s)) / total
            columns[0].append(centre)
            columns[1].append(math.sqrt(sum((a - centre) ** 2 * v for a, v in zip(f, s)) / total))
            columns[2].append(next(f[k] for k in range(17) if sum(s[: k + 1]) >= 0.85 * total - 1e-12))
        assert got[i] == pytest.approx([v for c in columns for v in (np.mean(c), np.std(c))], abs=1e-4)


def test_resampled(spark, signals):
    got = values(spark, "resampled")
    for i in some(signals, 5):
        x, cut, half = signals[i], 0.75, math.ceil(16 / 0.75)
        want = []
        for n in range(48):
            at = n / cut
            total = 0.0
            for k in range(math.floor(at) - half + 1, math.floor(at) + half + 1):
                if 0 <= k < 64:
                    t = at - k
                    total += x[k] * cut * np.sinc(cut * t) * (0.5 + 0.5 * math.cos(math.pi * max(-1, min(1, t / half))))
            want.append(total)
        assert got[i] == pytest.approx(want, abs=1e-5)


def test_long_signals_are_resampled_in_steps():
    x = np.random.default_rng(0).normal(size=200_000)
    y = dsp.resample(x, 8000, 6000)
    tail = dsp.resample(x[100_000:], 8000, 6000)
    assert len(y) == 150_000 and np.allclose(y[75_100:-100], tail[100:-100])


def test_band_passed(spark, signals):
    got, sections = values(spark, "band_passed"), dsp.butterworth(5, 100.0, 400.0, 2000.0)

    def plain(x):
        for b0, b1, b2, a1, a2 in sections:
            y = []
            for n, v in enumerate(x):
                old = lambda s, k: s[n - k] if n >= k else 0.0  # noqa: E731, B023
                y.append(b0 * v + b1 * old(x, 1) + b2 * old(x, 2) - a1 * old(y, 1) - a2 * old(y, 2))
            x = y
        return x

    for i in some(signals):
        x = signals[i]
        wide = [2 * x[0] - v for v in x[33:0:-1]] + x + [2 * x[-1] - v for v in x[-2:-35:-1]]
        want = plain(plain(wide)[::-1])[::-1][33:97]
        assert got[i] == pytest.approx(want, abs=1e-5)


def test_band_pass_sections_are_those_of_a_butterworth_filter():
    sections, rate = dsp.butterworth(5, 100.0, 400.0, 2000.0), 2000.0
    z = lambda f: np.exp(2j * np.pi * f / rate)
    gain = lambda f: abs(np.prod([(b0 + b1 / z(f) + b2 / z(f) ** 2) / (1 + a1 / z(f) + a2 / z(f) ** 2) for b0, b1, b2, a1, a2 in sections]))
    assert [gain(f) for f in (100.0, 400.0)] == pytest.approx([math.sqrt(0.5)] * 2, rel=1e-6)
    warp = lambda f: math.tan(math.pi * f / rate)
    for f in (20.0, 60.0, 150.0, 300.0, 700.0):
        w, low, high = warp(f), warp(100.0), warp(400.0)
        assert gain(f) == pytest.approx(1 / math.sqrt(1 + ((w * w - low * high) / (w * (high - low))) ** 10), rel=1e-6)


def test_pitch(spark, signals):
    got = values(spark, "pitch")
    near, far = int(2000 / 900), min(int(2000 / 80), 32)
    for i in some(signals):
        x, want = signals[i], []
        for a in range(0, 64 - 64 + 1, 32):
            frame = x[a : a + 64]
            d = [sum((frame[j] - frame[j + t]) ** 2 for j in range(64 - far)) for t in range(far + 1)]
            norm = [1.0] + [d[t] * t / max(sum(d[1 : t + 1]), 1e-12) for t in range(1, far + 1)]
            good = [t for t in range(near, far) if norm[t] < 0.1]
            t = good[0] if good else min(range(near, far), key=lambda t: norm[t])
            while t + 1 < far and norm[t + 1] < norm[t]:
                t += 1
            p = float(t)
            if 0 < t < far:
                bend = norm[t - 1] - 2 * norm[t] + norm[t + 1]
                p += 0.5 * (norm[t - 1] - norm[t + 1]) / bend if bend else 0.0
            want.append(2000 / p)
        assert got[i] == pytest.approx(want, rel=1e-5)


def test_peaks(spark, signals):
    got = {}
    for r in suite.QUERIES["peaks"](spark, DATA).collect():
        got.setdefault(r["recording_id"], []).append(r["n"])
    for i, x in signals.items():
        tops = sorted((-x[n], n) for n in range(1, 63) if x[n - 1] < x[n] >= x[n + 1] and x[n] >= 0.05)
        kept = []
        for _, n in tops:
            if all(abs(n - k) > 5 for k in kept):
                kept.append(n)
        assert sorted(got.get(i, [])) == sorted(kept)


def test_network(spark, signals):
    got, net = values(spark, "tcn_forward"), tcn.make(1, 8, 3)
    for i in some(signals, 5):
        x = [[net.first[0][0, 0, c] * v + net.first[1][c] for c in range(8)] for v in signals[i]]
        total = [[0.0] * 8 for _ in x]
        for ((kernel, bias), (side, more)), d in zip(net.blocks, net.dilations):
            made = []
            for t in range(64):
                z = [bias[c] + sum(kernel[k, a, c] * x[t + (k - 1) * d][a] for k in range(3) if 0 <= t + (k - 1) * d < 64 for a in range(8)) for c in range(8)]
                z = [max(v, 0.0) for v in z]
                z = [v / (max(z) + 1e-5) for v in z]
                made.append([more[c] + sum(side[0, a, c] * z[a] for a in range(8)) for c in range(8)])
            x = [[a + b for a, b in zip(p, q)] for p, q in zip(x, made)]
            total = [[a + b for a, b in zip(p, q)] for p, q in zip(total, made)]
        want = [0.0] * 3
        for row in total:
            z = [net.head[1][c] + sum(net.head[0][0, a, c] * max(row[a], 0.0) for a in range(8)) for c in range(3)]
            e = [math.exp(v - max(z)) for v in z]
            want = [w + v / sum(e) / 64 for w, v in zip(want, e)]
        assert got[i] == pytest.approx(want, abs=2e-6)


def test_network_options():
    x = np.random.default_rng(1).normal(size=(100, 1))
    for net in (tcn.MODELS["tcn"](1, 3), tcn.tcn_stft(1, 3, pre=3, n_dft=16), tcn.make(1, 4, 3, activation="wavenet", skips=False)):
        p = tcn.forward(net, x)
        assert p.shape == (100, 3) and np.allclose(p.sum(axis=1), 1)
    front = tcn.tcn_stft(1, 3, pre=3, n_dft=16)
    p = tcn.forward(front, x)
    assert np.array_equal(p[0], p[7]) and not np.array_equal(p[7], p[8]) and front.first[0].shape == (1, 9, 16)


def test_morphology(spark, signals):
    got = values(spark, "morphology_2d")

    def window(x, w, f, bad):
        h, v = len(w) // 2, len(w[0]) // 2
        return [[f([x[i + a - h][j + b - v] for a in range(len(w)) for b in range(len(w[0])) if w[a][b] and 0 <= i + a - h < 16 and 0 <= j + b - v < 4] or [bad]) for j in range(4)] for i in range(16)]

    disk, flat = [[(a - 1) ** 2 + (b - 1) ** 2 <= 1 for b in range(3)] for a in range(3)], [[True] * 3] * 3
    opened = lambda x, w: window(window(x, w, min, math.inf), w, max, -math.inf)
    for i in some(signals, 6):
        x = [signals[i][4 * k : 4 * k + 4] for k in range(16)]
        mean = lambda y: sum(map(sum, y)) / 64
        want = [mean(opened(x, disk)), mean([[a - b for a, b in zip(p, q)] for p, q in zip(x, opened(x, flat))])]
        assert got[i][:2] == pytest.approx(want, abs=1e-5)
        tiles = [[x[4 * k + a][b] for a in range(4) for b in range(4)] for k in range(4)]
        assert got[i][4:] == pytest.approx([0.5 * max(t) + 0.5 * sum(t) / 16 for t in tiles], abs=1e-5)


def test_kmeans(spark, signals):
    rows = ml.as_vectors(spark.read.parquet(f"{DATA}/embeddings.parquet"), "embedding")
    told = {r["vec_id"]: r["cluster"] for r in ml.clustered(rows, 24).select("vec_id", "cluster").collect()}
    centre = {c: np.mean([signals[i] for i in told if told[i] == c], axis=0) for c in set(told.values())}
    near = [told[i] == min(centre, key=lambda c: (np.linalg.norm(np.array(signals[i]) - centre[c]), c)) for i in told]
    assert np.mean(near) >= 0.9  # iterations end before the last few rows settle
    spread = sum(np.linalg.norm(np.array(signals[i]) - centre[told[i]]) ** 2 for i in told)
    x = np.array([signals[i] for i in sorted(signals)])
    assert spread < ((x - x.mean(axis=0)) ** 2).sum()
    assert sum(r["n"] for r in suite.QUERIES["kmeans"](spark, DATA).collect()) == len(signals)


def test_components(spark, signals):
    ids = sorted(signals)
    x = np.array([signals[i] for i in ids])
    _, _, axes = np.linalg.svd(x - x.mean(axis=0), full_matrices=False)
    got = {r["vec_id"]: r["components"] for r in suite.QUERIES["pca_embed"](spark, DATA).collect()}
    mine = np.array([got[i] for i in ids])
    for k in range(2):
        want = x @ axes[k]
        assert min(np.abs(mine[:, k] - s * want).max() for s in (1, -1)) < 1e-3


def test_cross_validation_from_its_predictions(spark):
    rows = spark.createDataFrame([(i, float(i % 2), [float(i % 2) * 3 + (i * 7 % 11) / 5, float(i * 5 % 13)]) for i in range(90)], "id long, label double, x array<double>")
    folded = ml.stratified_folds(ml.as_vectors(rows, "x"), "label", "id", 3).persist()
    scores = {r["model"]: r for r in ml.cross_validated(folded, 3).collect()}
    f1s, hits = [], []
    for k in range(3):
        told = ml.models(folded.where(f"fold <> {k}").count())["logistic_regression"].fit(folded.where(f"fold <> {k}")).transform(folded.where(f"fold = {k}")).select("label", "prediction").collect()
        hits.append(np.mean([r["label"] == r["prediction"] for r in told]))
        per = []
        for c in (0.0, 1.0):
            tp = sum(r["label"] == r["prediction"] == c for r in told)
            wrong = sum((r["label"] == c) != (r["prediction"] == c) for r in told)
            per.append(2 * tp / (2 * tp + wrong) if tp + wrong else 0.0)
        f1s.append(np.mean(per))
    row = scores["logistic_regression"]
    assert (row["mean_accuracy"], row["mean_f1"], row["std_f1"]) == pytest.approx((np.mean(hits), np.mean(f1s), np.std(f1s)), abs=1e-5)
    best = next(r for r in scores.values() if r["best"])
    assert best["mean_f1"] == max(r["mean_f1"] for r in scores.values())
    assert ml.refitted(folded, spark.createDataFrame([tuple(best)], "model string, a double, b double, c double, d double, best boolean")) is not None
    folded.unpersist()
