"""Spectral features against sums written out frame by frame and bin by bin."""

from __future__ import annotations

import cmath
import math

import numpy as np
import pytest
from eventloom.operators import spectra


def dft(x: list, n: int, hop: int, window: int | None = None) -> list:
    """Magnitudes of each frame, by the definition."""
    m = window or n
    at = (n - m) // 2
    w = [0.5 - 0.5 * math.cos(2 * math.pi * (i - at) / m) if at <= i < at + m else 0.0 for i in range(n)]
    y = [0.0] * (n // 2) + list(x) + [0.0] * (n // 2)
    out = []
    for a in range(0, len(y) - n + 1, hop):
        out.append([abs(sum(w[i] * y[a + i] * cmath.exp(-2j * math.pi * i * k / n) for i in range(n))) for k in range(n // 2 + 1)])
    return out


def plain(x: list, rate: float) -> dict:
    n_fft, hop, n_mels = 64, 16, 16
    s = dft(x, n_fft, hop)
    hz = [k * rate / n_fft for k in range(n_fft // 2 + 1)]
    out: dict = {k: [] for k in spectra.FRAMEWISE}
    mel_hz = lambda m: m * 200 / 3 if m < 15 else 1000 * math.exp(math.log(6.4) / 27 * (m - 15))
    top = rate / 2 * 3 / 200 if rate / 2 < 1000 else 15 + 27 * math.log(rate / 2000) / math.log(6.4)
    at = [mel_hz(top * k / (n_mels + 1)) for k in range(n_mels + 2)]
    mels = []
    for f in s:
        total = sum(f)
        c = sum(h * v for h, v in zip(hz, f, strict=True)) / total if total else 0.0
        out["centroid"].append(c)
        out["bandwidth"].append(math.sqrt(sum(v / total * (h - c) ** 2 for h, v in zip(hz, f, strict=True))) if total else 0.0)
        run = 0.0
        for h, v in zip(hz, f, strict=True):
            run += v
            if run >= 0.85 * total:
                out["rolloff"].append(h)
                break
        p = [max(1e-10, v * v) for v in f]
        out["flatness"].append(math.exp(sum(map(math.log, p)) / len(p)) / (sum(p) / len(p)))
        row = []
        for j in range(n_mels):
            a, b, d = at[j : j + 3]
            row.append(sum(max(0.0, min((h - a) / (b - a), (d - h) / (d - b))) * 2 / (d - a) * v * v for h, v in zip(hz, f, strict=True)))
        mels.append([10 * math.log10(max(1e-10, v)) for v in row])
    floor = max(map(max, mels)) - 80
    for row in mels:
        row = [max(floor, v) for v in row]
        for k in range(13):
            c = sum(v * math.cos(math.pi * k * (2 * i + 1) / (2 * n_mels)) for i, v in enumerate(row)) * math.sqrt((1 if k == 0 else 2) / n_mels)
            out[f"mfcc{k + 1:02d}"].append(c)
    y = [x[0]] * (n_fft // 2) + list(x) + [x[-1]] * (n_fft // 2)
    for a in range(0, len(y) - n_fft + 1, hop):
        out["zcr"].append(sum((y[a + i] < 0) != (y[a + i - 1] < 0) for i in range(1, n_fft)) / n_fft)
    power = [sum(f[k] ** 2 for f in dft(x, n_fft, hop, min(n_fft, max(16, len(x))))) / len(s) for k in range(n_fft // 2 + 1)]
    q = [v / sum(power) for v in power]
    return out | {"entropy": -sum(v * math.log2(v + 1e-10) for v in q) / math.log2(len(q)), "frames": len(s), "mels": np.maximum(np.array(mels), floor)}


def test_features_are_the_sums(spark):
    rng = np.random.default_rng(2)
    signals = [rng.standard_normal(64), np.sin(np.arange(100) * 0.7), rng.standard_normal(37) * 0.1, np.r_[np.zeros(90), rng.standard_normal(30)]]
    df = spark.createDataFrame([(k, [float(v) for v in x]) for k, x in enumerate(signals)], "id long, v array<double>")
    got = {r.id: r.asDict() for r in spectra.features(df, 8000.0).collect()}
    for k, x in enumerate(signals):
        want, row = plain(x.tolist(), 8000.0), got[k]
        assert row["error"] is None and (row["n_fft"], row["hop"], row["n_mels"]) == (64, 16, 16)
        assert abs(row["rms"] - math.sqrt(np.mean(x**2))) < 1e-12 and row["n_samples"] == len(x)
        for name in spectra.FRAMEWISE:
            v = np.array(want[name])
            for s, w in zip(("mean", "sd", "least", "most"), (v.mean(), v.std(), v.min(), v.max()), strict=True):
                assert abs(row[f"{name}_{s}"] - w) < 1e-7 * (1 + abs(w)), (k, name, s)
        assert abs(row["entropy"] - want["entropy"]) < 1e-9
    assert len(spectra.NAMES) == 83


@pytest.mark.parametrize(("mode", "frames"), [("resize", 9), ("pad", 12), ("pad", 4), ("ref", 12)])
def test_spectra_of_one_size(spark, mode, frames):
    x = np.random.default_rng(7).standard_normal(100)
    r = spectra.spectra(spark.createDataFrame([(1, x.tolist())], "id long, v array<double>"), 8000.0, 64, 16, 16, frames, mode, standard=mode == "pad").first()
    s = plain(x.tolist(), 8000.0)["mels"]
    if mode == "ref":
        s = s - s.max()
    if mode == "pad":
        s = (s - s.mean()) / s.std()
    if mode == "resize":
        t = np.array([[np.interp(j / (frames - 1), np.arange(len(s)) / (len(s) - 1), s[:, m]) for m in range(16)] for j in range(frames)])
    else:
        t = np.concatenate([s[:frames], np.full((max(0, frames - len(s)), 16), s.min() if mode == "ref" else 0.0)])
    assert np.abs(np.array(r.cells).reshape(16, frames).T - t).max() < 1e-8
    assert r.padded == (0.0 if mode == "resize" else max(0, frames - len(s)) / frames)


def test_odd_signals(spark):
    rows = [(1, None), (2, []), (3, [1.0, float("nan")]), (4, [1.0, None]), (5, [0.1, 0.2, 0.3]), (6, [0.0] * 50), (7, [0.5] * 4)]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    got = {r.id: r for r in spectra.features(df, 8000.0).collect()}
    assert [got[k].error for k in (1, 3, 4)] == ["no signal", "samples that are no numbers", "samples that are no numbers"]
    assert got[2].error is None and got[2].n_samples == 0 and got[2].rms is None
    assert got[5].rms is not None and got[5].centroid_mean is None and got[6].centroid_mean is None and got[7].centroid_mean is not None
    cells = {r.id: r for r in spectra.spectra(df, 8000.0, 64, 16, 16, 5).collect()}
    assert cells[2].error == "an empty signal" and len(cells[5].cells) == 80
    assert spectra.features(df.limit(0), 8000.0).count() == 0
