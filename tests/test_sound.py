"""Recordings against files written byte by byte, and resampling against the sum written out."""

from __future__ import annotations

import math
import struct

import numpy as np
import pytest
from eventloom.functions import signals
from eventloom.operators import spectra
from eventloom.plans import sound_queries as Q
from eventloom.sources import sound
from eventloom.sources import tables as T
from pyspark.sql import functions as F


def chunk(name: bytes, raw: bytes) -> bytes:
    return name + struct.pack("<I", len(raw)) + raw + b"\0" * (len(raw) % 2)


def wav(raw: bytes, code: int = 1, channels: int = 1, rate: int = 8000, bits: int = 16, extended: bool = False, before: bytes = b"") -> bytes:
    align = channels * bits // 8
    form = struct.pack("<HHIIHH", 0xFFFE if extended else code, channels, rate, rate * align, align, bits)
    if extended:
        form += struct.pack("<HHIH", 22, bits, 0, code) + b"\0" * 14
    body = b"WAVE" + before + chunk(b"fmt ", form) + chunk(b"data", raw)
    return b"RIFF" + struct.pack("<I", len(body)) + body


@pytest.fixture()
def put(tmp_path):
    def write(name: str, raw: bytes) -> str:
        (tmp_path / name).write_bytes(raw)
        return str(tmp_path / name)

    return write


def whole(spark, *paths):
    t = spark.createDataFrame([(k, p, None, None) for k, p in enumerate(paths)], "k int, path string, first long, last long")
    return {r.k: r for r in sound.windows(t).collect()}


def test_forms(spark, put):
    ints = [0, 1, -1, 100, -32768, 32767]
    stereo = struct.pack("<6h", 100, 300, -5, 5, 7, 9)
    three = b"".join(struct.pack("<i", v << 8)[1:] for v in (1, -1, -(2**23), 2**23 - 1))
    paths = [
        put("a.wav", wav(struct.pack("<6h", *ints))),
        put("b.wav", wav(bytes([0, 128, 255]), bits=8)),
        put("c.wav", wav(three, bits=24, extended=True)),
        put("d.wav", wav(struct.pack("<2i", -(2**31), 2**30), bits=32)),
        put("e.wav", wav(struct.pack("<2f", 0.5, -0.25), code=3, bits=32)),
        put("f.wav", wav(struct.pack("<2d", 0.1, -0.7), code=3, bits=64)),
        put("g.wav", wav(stereo, channels=2, before=chunk(b"LIST", b"odd"))),
        put("h.wav", wav(b"")),
        "file://" + put("with space.wav", wav(struct.pack("<1h", 8))).replace(" ", "%20"),
    ]
    got = whole(spark, *paths)
    want = [
        [v / 32768 for v in ints], [-1, 0, 127 / 128], [1 / 2**23, -1 / 2**23, -1, 1 - 1 / 2**23], [-1, 0.5], [0.5, -0.25], [0.1, -0.7],
        [200 / 32768, 0, 8 / 32768], [], [8 / 32768],
    ]
    for k, x in enumerate(want):
        assert got[k].error is None and got[k].samples == x, k


def test_files_that_are_none(spark, put, tmp_path):
    short = wav(struct.pack("<4h", 1, 2, 3, 4))[:-3]
    endless = bytearray(wav(struct.pack("<2h", 1, 2)))
    endless[40:44] = b"\xff" * 4
    paths = [None, str(tmp_path / "absent.wav"), str(tmp_path), put("t.wav", b"plain text, no sound"), put("n.wav", b""), put("m.wav", wav(b"", code=85)), put("s.wav", short), put("e.wav", bytes(endless))]
    got = whole(spark, *paths)
    assert [got[k].error for k in range(6)] == ["no path", "no such file", "no file", "no RIFF/WAVE file", "no RIFF/WAVE file", "format 85 of 16 bits"]
    assert all(got[k].samples is None for k in range(6))
    assert got[6].samples == [1 / 32768, 2 / 32768] and got[7].samples == [1 / 32768, 2 / 32768]
    h = {r.k: r for r in sound.headers(spark.createDataFrame(list(enumerate(paths)), "k int, path string")).collect()}
    assert (h[6].frames, h[6].truncated, h[7].frames, h[7].truncated) == (2, True, 2, True)
    assert h[3].frames is None and h[3].error


def test_no_later_byte_is_read(put):
    class Counting:
        def __init__(self, file):
            self.file, self.at, self.far = file, 0, 0

        def seek(self, at):
            self.at = at
            self.file.seek(at)

        def read(self, n):
            self.at += n
            self.far = max(self.far, self.at)
            return self.file.read(n)

    path = put("a.wav", wav(struct.pack("<1000h", *range(1000))))
    files = sound.Files()
    files.header(path)
    files.file = counting = Counting(files.file)
    x, n = files.frames(path, 100, 130)
    assert n == 60 and counting.far == 44 + 260 and x.tolist() == [v / 32768 for v in range(100, 130)]


def test_windows_and_blocks(spark, put):
    path = put("a.wav", wav(struct.pack("<10h", *range(10))))
    rows = [(1, path, 3, 5), (2, path, -4, 2), (3, path, 8, 40), (4, path, 50, 60), (5, path, 5, 5), (6, path, None, 2)]
    got = {r.k: [round(x * 32768) for x in r.samples] for r in sound.windows(spark.createDataFrame(rows, "k int, path string, first long, last long")).collect()}
    assert got == {1: [3, 4], 2: [0, 1], 3: [8, 9], 4: [], 5: [], 6: [0, 1]}
    t = sound.in_blocks(sound.headers(spark.createDataFrame([(path,), (put("z.wav", wav(b"")),)], "path string")).select("path", "frames"), size=4)
    blocks = sorted(sound.windows(t).collect(), key=lambda r: r.first)
    assert [r.first for r in blocks] == [0, 4, 8] and [round(x * 32768) for r in blocks for x in r.samples] == list(range(10))
    with pytest.raises(ValueError, match="exist"):
        sound.windows(spark.createDataFrame([(path, 1)], "path string, Samples int"))
    assert sound.windows(spark.createDataFrame([], "path string, first long, last long")).collect() == []


def test_plans(spark, put):
    path = put("a.wav", wav(struct.pack("<40h", *range(40))))
    p = signals.support_plan(F.col("a"), F.col("b"), F.lit(1.0), F.lit(50), 8000.0)
    t = spark.createDataFrame([(1, path, 3.0, 6.0), (2, path, 20.0, 24.0), (3, path, 38.0, 45.0), (4, path, 48.0, 60.0)], "k int, path string, a double, b double").withColumn("p", p)
    got = {r.k: r for r in sound.allowed(t, "p").collect()}
    ints = lambda k: [round(x * 32768) for x in got[k].samples]
    assert ints(1) == [0, 0, 0, 1, 2, 3, 4, 5] and ints(2) == list(range(16, 24)) and got[2].bytes_read == 16
    assert got[3].samples is None and got[3].error == "frames of the plan are missing"
    assert got[4].p is None and got[4].samples is None and got[4].error is None


def plainly(x: list, source: int, rate: int, a: int, b: int) -> list:
    cut, out = min(1.0, rate / source), []
    for i in range(a, b):
        t, s = i * source / rate, 0.0
        for k, v in enumerate(x):
            u = (t - k) * cut
            if abs(u) < 32:
                s += v * cut * (math.sin(math.pi * u) / (math.pi * u) if u else 1.0) * (0.5 + 0.5 * math.cos(math.pi * u / 32))
        out.append(s)
    return out


@pytest.mark.parametrize("rate", [5000, 8000, 11025])
def test_resampling(spark, put, rate):
    y = [round(8000 * math.sin(2 * math.pi * 440 * k / 8000)) for k in range(900)]
    path = put("a.wav", wav(struct.pack("<900h", *y)))
    spans = [(1, None, None), (2, 0.02, 0.05), (3, -1.0, 0.01), (4, 0.1, 9.0), (5, 0.5, 0.6), (6, float("nan"), 0.1)]
    t = spark.createDataFrame([(k, path, a, b) for k, a, b in spans], "k int, path string, start_s double, end_s double")
    got = {r.k: r.samples for r in sound.resampled(t, rate).collect()}
    n = -(-900 * rate // 8000)
    x = [v / 32768 for v in y]
    assert np.allclose(got[1], plainly(x, 8000, rate, 0, n), atol=1e-12) and len(got[1]) == n
    for k, a, b in spans[1:5]:
        assert np.allclose(got[k], got[1][max(0, round(a * rate)) : min(n, round(b * rate))], atol=1e-12)
    assert got[5] == [] and got[6] == got[1]
    inner = range(n // 3, n // 2)
    assert max(abs(got[1][i] - 8000 / 32768 * math.sin(2 * math.pi * 440 * i / rate)) for i in inner) < 1e-3


def test_manifest(spark):
    t = spark.createDataFrame([(" a.wav ", 1.0, None, 0.5), ("/x/b.wav", 2.0, 3.0, 9.0), ("hdfs://h/c.wav", None, None, 1.0), ("", 1.0, float("nan"), 1.0)], "Wav_Path string, onset_s double, t_end double, dur_s double")
    got = [(r.path, r.start_s, r.end_s) for r in sound.manifest(t, "/root/").collect()]
    assert got == [("/root/a.wav", 1.0, 1.5), ("/x/b.wav", 2.0, 3.0), ("hdfs://h/c.wav", None, None), (None, 1.0, 2.0)]
    with pytest.raises(Exception, match="path|column|audio"):
        sound.manifest(spark.createDataFrame([(1,)], "x int"), "/root")


def test_written_recordings(spark, tmp_path):
    rows = [("a.wav", [0.5, -2.0, 2.0, 0.25], 2), ("b.wav", [], 1), ("c.wav", None, 1)]
    t = spark.createDataFrame(rows, "name string, samples array<double>, channels int")
    for _ in range(2):  # a second attempt finds the files
        done = sound.pcm(t, f"file://{tmp_path}/out", "name", "samples", 8000)
        got = {r.name: r for r in sound.windows(done.withColumns({"first": F.lit(None).cast("long"), "last": F.lit(None).cast("long")})).collect()}
        assert got["a.wav"].samples == [-0.25, (32767 / 32768 + 0.25) / 2] and got["b.wav"].samples == got["c.wav"].samples == []
        assert sorted(p.name for p in (tmp_path / "out").iterdir() if p.suffix == ".wav") == ["a.wav", "b.wav", "c.wav"]
        assert sum(1 for p in (tmp_path / "out").iterdir() if not p.name.startswith(".")) == 3


def held(spark, d) -> dict:
    """What the queries' files hold, by recording, and each vector's place."""
    files, places = {}, {}
    for r in sorted(T.vectors(spark, d).collect(), key=lambda r: r.id):
        q = lambda f: np.clip(np.rint(np.array(r.v) * f * 32768), -32768, 32767) / 32768  # noqa: B023, E731
        rec = r.id // 64
        y = q(1.0) if rec % 2 == 0 else (q(1.0) + q(0.5)) / 2
        at = len(files.setdefault(rec, []))
        files[rec] += y.tolist()
        places[r.id] = rec, at, len(y)
    return {i: (files[rec], at, n) for i, (rec, at, n) in places.items()}


def test_resampled_query(spark, data):
    d, want = f"{data}/sf0.001", held(spark, f"{data}/sf0.001")
    got = {r.id: r.samples for r in Q.src14_resampled(spark, d).collect()}
    assert set(got) == set(want)
    for i in sorted(want)[::41]:
        x, at, n = want[i]
        a, b = round(at / 8000 * 5000), round((at + n) / 8000 * 5000)
        assert np.allclose(got[i], plainly(x, 8000, 5000, a, b), atol=1e-6)


def test_vectors_query(spark, data):
    d, want = f"{data}/sf0.001", held(spark, f"{data}/sf0.001")
    got = {r.id: r for r in Q.src26_vectors_of_calls(spark, d).collect()}
    assert set(got) == set(want) and all((r.error == "no such file") == (i % 50 == 9) for i, r in got.items())
    for i in [k for k in sorted(want)[::41] if k % 50 != 9]:
        x, at, n = want[i]
        cells, padded = spectra.spectrum(np.array(x[at : at + n]), 8000.0, 64, 16, 16, 12, "ref", False)
        assert np.allclose(got[i].cells, cells, atol=1e-5) and abs(got[i].padded - padded) < 1e-6
