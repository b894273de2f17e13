"""Frame-wise spectral features of signals: each task works on its rows' arrays, and nothing is shuffled.

A signal is framed about its samples (half a window of zeros before and after), each
frame weighed by a Hann window and transformed. From the magnitudes come centroid,
bandwidth, roll-off and flatness of each frame; from the powers, summed by triangles on
a mel scale, come log-mel spectra and cepstral coefficients. A feature's frames are
reduced to mean, population sd, minimum and maximum.

A row that can't be worked on has its reason in ``error`` and no features: null, or with
null or non-finite samples. A signal of fewer than 4 samples, or a silent one, has levels
but no spectral features, as its formula asks. Filters and windows of a size are made
once a task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SILENT, ROLLOFF, CEPSTRA = 1e-10, 0.85, 13
#: Decibels below the loudest cell that a log-mel spectrum keeps.
RANGE_DB = 80.0
LEVELS = ("n_samples", "duration", "rms", "rms_dbfs", "peak", "crest", "clipped")
FRAMEWISE = ("zcr", "centroid", "bandwidth", "rolloff", "flatness", *(f"mfcc{k:02d}" for k in range(1, CEPSTRA + 1)))
NAMES = (*LEVELS, *(f"{x}_{s}" for x in FRAMEWISE[:5] for s in ("mean", "sd", "least", "most")), "entropy", "n_fft", "hop", "n_mels", *(f"{x}_{s}" for x in FRAMEWISE[5:] for s in ("mean", "sd", "least", "most")))


def to_mel(hz: np.ndarray) -> np.ndarray:
    """Linear below 1 kHz (200 / 3 Hz a mel), logarithmic above (a factor of 6.4 in 27 mels)."""
    hz = np.asarray(hz, float)
    return np.where(hz < 1000, hz * 3 / 200, 15 + 27 * np.log(np.maximum(hz, 1000) / 1000) / np.log(6.4))


def to_hz(mel: np.ndarray) -> np.ndarray:
    mel = np.asarray(mel, float)
    return np.where(mel < 15, mel * 200 / 3, 1000 * 6.4 ** ((np.maximum(mel, 15) - 15) / 27))


@lru_cache(64)
def filters(rate: float, n_fft: int, n_mels: int, low: float = 0.0, high: float | None = None) -> np.ndarray:
    """(n_mels, bins): triangles between neighbouring mel points, each of area 1 over frequency."""
    at = to_hz(np.linspace(to_mel(low), to_mel(rate / 2 if high is None else high), n_mels + 2))
    hz = np.arange(n_fft // 2 + 1) * rate / n_fft
    up = (hz[None, :] - at[:-2, None]) / (at[1:-1] - at[:-2])[:, None]
    down = (at[2:, None] - hz[None, :]) / (at[2:] - at[1:-1])[:, None]
    return np.maximum(0, np.minimum(up, down)) * (2 / (at[2:] - at[:-2]))[:, None]


@lru_cache(64)
def cosines(n: int, k: int) -> np.ndarray:
    """The first k rows of the orthonormal cosine transform of n values."""
    c = np.cos(np.pi * np.arange(k)[:, None] * (2 * np.arange(n)[None, :] + 1) / (2 * n)) * np.sqrt(2 / n)
    c[0] /= np.sqrt(2)
    return c


def framed(x: np.ndarray, size: int, hop: int, pad: str = "constant") -> np.ndarray:
    """(frames, size): frame j is centred on sample j * hop."""
    y = np.pad(x, size // 2, mode=pad)
    return np.lib.stride_tricks.sliding_window_view(y, size)[::hop]


def magnitudes(x: np.ndarray, n_fft: int, hop: int, window: int | None = None) -> np.ndarray:
    """(frames, bins)."""
    w = np.zeros(n_fft)
    m = n_fft if window is None else window
    at = (n_fft - m) // 2
    w[at : at + m] = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(m) / m)
    return np.abs(np.fft.rfft(framed(x, n_fft, hop) * w, axis=1))


def log_mel(power: np.ndarray, rate: float, n_fft: int, n_mels: int, high: float | None = None, ref_max: bool = False) -> np.ndarray:
    """(frames, n_mels) in decibels, of 1 or of the loudest cell."""
    mel = power @ filters(rate, n_fft, n_mels, 0.0, high).T
    db = 10 * np.log10(np.maximum(1e-10, mel))
    db = db - 10 * np.log10(max(1e-10, float(mel.max()))) if ref_max else db
    return np.maximum(db, db.max() - RANGE_DB)


def _stats(x: np.ndarray) -> list[float]:
    x = x[np.isfinite(x)]
    return [float(x.mean()), float(x.std()), float(x.min()), float(x.max())] if len(x) else [float("nan")] * 4


def shape(n: int) -> tuple[int, int, int]:
    """(n_fft, hop, n_mels) of a signal of n samples: a power of two from 64 to 512, a quarter of it, and 32 at most."""
    n_fft = int(min(512, max(64, 2 ** int(np.floor(np.log2(max(n, 64)))))))
    return n_fft, max(16, n_fft // 4), min(32, max(8, n_fft // 4))


def described(x: np.ndarray, rate: float) -> list[float]:
    """The features in the order of NAMES; those that a short or silent signal lacks are NaN."""
    n = len(x)
    rms = float(np.sqrt(np.mean(x * x))) if n else float("nan")
    peak = float(np.abs(x).max()) if n else float("nan")
    db = 20 * np.log10(max(rms, SILENT)) if n else float("nan")
    out = [float(n), n / rate, rms, db, peak, peak / max(rms, SILENT), float(np.mean(np.abs(x) >= 0.999)) if n else float("nan")]
    if n < 4 or rms <= SILENT:
        return out + [float("nan")] * (len(NAMES) - len(out))
    n_fft, hop, n_mels = shape(n)
    s = magnitudes(x, n_fft, hop)
    hz = np.arange(s.shape[1]) * rate / n_fft
    total = s.sum(axis=1)
    p = s / np.where(total > np.finfo(float).tiny, total, 1)[:, None]
    centroid = p @ hz
    bandwidth = np.sqrt((p * (hz[None, :] - centroid[:, None]) ** 2).sum(axis=1))
    rolloff = hz[(np.cumsum(s, axis=1) < ROLLOFF * total[:, None]).sum(axis=1).clip(max=len(hz) - 1)]
    power = np.maximum(1e-10, s * s)
    flatness = np.exp(np.log(power).mean(axis=1)) / power.mean(axis=1)
    signs = framed(np.where(np.abs(x) <= 1e-10, 0.0, x), n_fft, hop, "edge") < 0
    zcr = (signs[:, 1:] != signs[:, :-1]).sum(axis=1) / n_fft
    cepstra = log_mel(s * s, rate, n_fft, n_mels) @ cosines(n_mels, CEPSTRA).T
    mean = (magnitudes(x, n_fft, hop, min(n_fft, max(16, n))) ** 2).mean(axis=0)
    share = mean / mean.sum() if mean.sum() > SILENT else None
    entropy = float(-(share * np.log2(share + SILENT)).sum() / np.log2(max(len(mean), 2))) if share is not None else float("nan")
    for f in (zcr, centroid, bandwidth, rolloff, flatness):
        out += _stats(f)
    out += [entropy, float(n_fft), float(hop), float(n_mels)]
    for k in range(CEPSTRA):
        out += _stats(cepstra[:, k])
    return out


def resized(spec: np.ndarray, frames: int) -> np.ndarray:
    """(frames, mels), linear between the spectra's frames."""
    if len(spec) == 1:
        return np.repeat(spec, frames, axis=0)
    old, new = np.linspace(0, 1, len(spec)), np.linspace(0, 1, frames)
    return np.array([np.interp(new, old, c) for c in spec.T]).T


def spectrum(x: np.ndarray, rate: float, n_fft: int, hop: int, n_mels: int, frames: int, mode: str, standard: bool) -> tuple[list[float], float]:
    """(cells by mel and then frame, share of frames that are padding). ``resize`` stretches, ``pad`` adds zeros or cuts; ``ref`` pads with the least value, of decibels below the loudest cell."""
    s = log_mel(magnitudes(x, n_fft, hop) ** 2, rate, n_fft, n_mels, ref_max=mode == "ref")
    if standard:
        sd = s.std()
        s = (s - s.mean()) / sd if np.isfinite(sd) and sd > SILENT else np.zeros_like(s)
    if mode == "resize":
        return resized(s, frames).T.ravel().tolist(), 0.0
    pad = max(0, frames - len(s))
    s = np.concatenate([s[:frames], np.full((pad, n_mels), s.min() if mode == "ref" else 0.0)])
    return s.T.ravel().tolist(), pad / frames


def _mapped(df: DataFrame, keep: tuple[str, ...], v: str, columns: str, one: Callable[[np.ndarray], tuple], kinds: list[pa.DataType]) -> DataFrame:
    """(keep, what ``one`` gives for each signal, error)."""
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keep).schema), columns, "error string"])
    names = [*keep, *(c.strip().split(" ")[0] for c in columns.split(",")), "error"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, errors = [], []
            for x in b.column(b.num_columns - 1):
                x = x.as_py()
                if x is None:
                    rows, errors = [*rows, (None,) * len(kinds)], [*errors, "no signal"]
                    continue
                x = np.array([np.nan if y is None else y for y in x], np.float64)
                try:
                    if not np.isfinite(x).all():
                        raise ValueError("samples that are no numbers")
                    rows.append(one(x))
                    errors.append(None)
                except ValueError as e:
                    rows.append((None,) * len(kinds))
                    errors.append(str(e))
            cells = [pa.array([None if isinstance(y, float) and y != y else y for y in c], k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
            if rows:
                yield pa.RecordBatch.from_arrays([*(b.column(k) for k in range(len(keep))), *cells, pa.array(errors, pa.string())], names)

    return df.select(*keep, F.col(v).cast("array<double>").alias("signal__")).mapInArrow(run, schema)


def features(df: DataFrame, rate: float, keep: tuple[str, ...] = ("id",), v: str = "v") -> DataFrame:
    """(keep, NAMES, error): one row a signal; a feature without a value is null."""
    return _mapped(df, keep, v, ", ".join(f"{n} double" for n in NAMES), lambda x: tuple(described(x, rate)), [pa.float64()] * len(NAMES))


def spectra(df: DataFrame, rate: float, n_fft: int, hop: int, n_mels: int, frames: int, mode: str = "resize", standard: bool = False, keep: tuple[str, ...] = ("id",), v: str = "v") -> DataFrame:
    """(keep, cells, padded, error): log-mel spectra of one size."""
    if mode not in ("resize", "pad", "ref"):
        raise ValueError(mode)

    def one(x: np.ndarray) -> tuple:
        if not len(x):
            raise ValueError("an empty signal")
        return spectrum(x, rate, n_fft, hop, n_mels, frames, mode, standard)

    return _mapped(df, keep, v, "cells array<double>, padded double", one, [pa.list_(pa.float64()), pa.float64()])
