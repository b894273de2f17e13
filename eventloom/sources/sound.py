"""Recordings as RIFF/WAVE files of PCM samples: headers, windows read by seeking, resampled windows, manifests, a writer.

Tables of windows are split by Spark as any other; a task opens the files that
its rows name, and reads the frames that a window allows and no other byte of
sound. Long recordings are read as blocks of frames (:func:`in_blocks`), so that
no task holds one whole. Rows keep their order within a task, and a task keeps
the headers of the last 256 files: sort windows by path where that saves opening.

A row whose file is missing, is no such recording or has a form that isn't
known gets its reason in an error column and null elsewhere; a null path is an
error, too. Failures of the storage itself fail the task, and Spark tries again.
Samples are doubles in [-1, 1), channels are averaged. Added columns must be new.
"""

from __future__ import annotations

import struct
import uuid
from collections import OrderedDict
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as TY

from ..functions import signals
from .shared import written
from .tables import resolve

# Format codes of PCM, floating point and the extended header, with the sample widths they come in.
PCM, FLOAT, EXTENDED = 1, 3, 0xFFFE
WIDTHS = {PCM: (8, 16, 24, 32), FLOAT: (32, 64)}
# Columns of a manifest, by role, in order of preference.
MANIFEST = {
    "path": ("audio_path", "wav_path", "file_path", "path", "recording_path", "source_path", "source_wav"),
    "start": ("start_s", "start_sec", "start_time_sec", "onset_s", "begin_s", "t_start", "start"),
    "end": ("end_s", "end_sec", "end_time_sec", "offset_s", "stop_s", "t_end", "end"),
    "duration": ("duration_s", "duration_sec", "duration", "dur_s"),
}
#: Headers that a task keeps, and bytes of samples after which it hands rows on.
KEPT_HEADERS, HANDED_ON = 256, 16 << 20
#: Zero crossings on each side of the resampling kernel.
CROSSINGS = 32


@dataclass(frozen=True)
class Header:
    code: int
    channels: int
    rate: int
    bits: int
    at: int
    frames: int
    truncated: bool

    @property
    def frame(self) -> int:
        return self.channels * self.bits // 8


def parsed(file: pa.NativeFile, size: int) -> Header:
    """The header of an open file: chunks are passed by seeking, whatever their order and names."""
    file.seek(0)
    head = file.read(12)
    if len(head) < 12 or head[:4] != b"RIFF" or head[8:] != b"WAVE":
        raise ValueError("no RIFF/WAVE file")
    at, form = 12, None
    while at + 8 <= size:
        file.seek(at)
        name, n = struct.unpack("<4sI", file.read(8))
        at += 8
        if name == b"fmt ":
            raw = file.read(min(n, 40))
            if len(raw) < 16:
                raise ValueError("short format chunk")
            code, channels, rate, _, align, bits = struct.unpack("<HHIIHH", raw[:16])
            if code == EXTENDED and len(raw) >= 26:
                code = struct.unpack("<H", raw[24:26])[0]
            if bits not in WIDTHS.get(code, ()):
                raise ValueError(f"format {code} of {bits} bits")
            if not channels or not rate or align != channels * bits // 8:
                raise ValueError("bad format chunk")
            form = code, channels, rate, bits, align
        elif name == b"data":
            if form is None:
                raise ValueError("samples before their format")
            code, channels, rate, bits, align = form
            held = min(n, size - at)
            return Header(code, channels, rate, bits, at, held // align, held < n)
        at += n + n % 2
    raise ValueError("no samples")


def mono(raw: bytes, h: Header) -> np.ndarray:
    """Whole frames as doubles, channels averaged."""
    if h.code == FLOAT:
        x = np.frombuffer(raw, f"<f{h.bits // 8}").astype("f8")
    elif h.bits == 8:
        x = (np.frombuffer(raw, "u1").astype("f8") - 128) / 128
    elif h.bits == 24:
        b = np.frombuffer(raw, "u1").reshape(-1, 3).astype("i4")
        x = (((b[:, 0] | b[:, 1] << 8 | b[:, 2] << 16) ^ 0x800000) - 0x800000) / 2.0**23
    else:
        x = np.frombuffer(raw, f"<i{h.bits // 8}") / 2.0 ** (h.bits - 1)
    return x.reshape(-1, h.channels).mean(axis=1)


class Files:
    """What a task has open: one file, and the headers of the last ones."""

    def __init__(self) -> None:
        self.path, self.file, self.headers = None, None, OrderedDict()

    def header(self, path: str | None) -> Header:
        if path is None:
            raise ValueError("no path")
        if path in self.headers:
            self.headers.move_to_end(path)
            return self.headers[path]
        self._open(path)
        self.headers[path] = parsed(self.file, self.file.size())
        if len(self.headers) > KEPT_HEADERS:
            self.headers.popitem(last=False)
        return self.headers[path]

    def _open(self, path: str) -> None:
        if path == self.path:
            return
        self.close()
        fs, local = pafs.FileSystem.from_uri(path)
        kind = fs.get_file_info(local).type
        if kind != pafs.FileType.File:
            raise ValueError("no such file" if kind == pafs.FileType.NotFound else "no file")
        self.path, self.file = path, fs.open_input_file(local)

    def frames(self, path: str, first: int, last: int) -> tuple[np.ndarray, int]:
        """Frames [first, last) that the recording has, and the bytes of sound that were read."""
        h = self.header(path)
        first, last = max(0, first), min(h.frames, last)
        if first >= last:
            return np.zeros(0), 0
        self._open(path)
        self.file.seek(h.at + first * h.frame)
        raw = self.file.read((last - first) * h.frame)
        if len(raw) < (last - first) * h.frame:
            raise OSError(f"{path}: fewer bytes than its header says")
        return mono(raw, h), len(raw)

    def close(self) -> None:
        if self.file is not None:
            self.file.close()
        self.path, self.file = None, None


def _with(df: DataFrame, given: dict[str, Column], fields: Sequence[tuple[str, TY.DataType, pa.DataType]], one: Callable[..., tuple]) -> DataFrame:
    """The table and new columns: ``one(files, **given)`` for each row, or null and a reason in the last column."""
    names = [n for n, _, _ in fields]
    if clash := {n.lower() for n in names} & {c.lower() for c in df.columns}:
        raise ValueError(f"columns exist already: {sorted(clash)}")
    own = [f"given{k}__" for k in range(len(given))]
    width, keys = len(df.columns), list(given)
    schema = TY.StructType([*df.schema.fields, *(TY.StructField(n, t) for n, t, _ in fields)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = Files()
        try:
            for batch in batches:
                args = [batch.column(width + k).to_pylist() for k in range(len(keys))]
                done, at, held = [], 0, 0
                for i in range(batch.num_rows):
                    try:
                        out = (*one(files, **{k: a[i] for k, a in zip(keys, args, strict=True)}), None)
                    except ValueError as e:
                        out = (*[None] * (len(names) - 1), str(e))
                    done.append(out)
                    held += sum(x.nbytes for x in out if isinstance(x, np.ndarray))
                    if held >= HANDED_ON or i + 1 == batch.num_rows:
                        kept = batch.slice(at, i + 1 - at)
                        new = [pa.array([r[k] for r in done], t) for k, (_, _, t) in enumerate(fields)]
                        yield pa.RecordBatch.from_arrays([*kept.columns[:width], *new], names=[f"c{k}" for k in range(width + len(names))])
                        done, at, held = [], i + 1, 0
        finally:
            files.close()

    base = df.select("*", *(c.alias(o) for c, o in zip(given.values(), own, strict=True)))
    plain = TY.StructType([TY.StructField(f"c{k}", f.dataType) for k, f in enumerate(schema.fields)])
    return base.mapInArrow(run, plain).toDF(*schema.names)


def headers(df: DataFrame, path: str = "path") -> DataFrame:
    """The table with (channels, rate, bits, frames, truncated, error) of each row's file; no sound is read."""

    def one(files: Files, path: str | None) -> tuple:
        h = files.header(path)
        return h.channels, h.rate, h.bits, h.frames, h.truncated

    whole = [(n, TY.LongType(), pa.int64()) for n in ("channels", "rate", "bits", "frames")]
    return _with(df, {"path": F.col(path)}, [*whole, ("truncated", TY.BooleanType(), pa.bool_()), ("error", TY.StringType(), pa.string())], one)


def in_blocks(df: DataFrame, frames: str = "frames", size: int = 1 << 20) -> DataFrame:
    """A row for each block of a recording, with its frames [first, last); recordings without frames give none."""
    n = F.col(frames)
    starts = F.when(n > 0, F.sequence(F.lit(0).cast("long"), n - 1, F.lit(size).cast("long")))
    return df.withColumn("first", F.explode(starts)).withColumn("last", F.least(n, F.col("first") + size))


_SAMPLES = [("samples", TY.ArrayType(TY.DoubleType()), pa.list_(pa.float64())), ("rate", TY.LongType(), pa.int64()), ("bytes_read", TY.LongType(), pa.int64()), ("error", TY.StringType(), pa.string())]


def windows(df: DataFrame, path: str = "path", first: str | Column = "first", last: str | Column = "last") -> DataFrame:
    """The table with (samples, rate, bytes_read, error) of frames [first, last).

    Null bounds are those of the recording, and frames beyond it are left out;
    a window that has none is an empty array.
    """

    def one(files: Files, path: str | None, first: int | None, last: int | None) -> tuple:
        h = files.header(path)
        x, n = files.frames(path, 0 if first is None else first, h.frames if last is None else last)
        return x, h.rate, n

    bound = lambda c: (F.col(c) if isinstance(c, str) else c).cast("long")
    return _with(df, {"path": F.col(path), "first": bound(first), "last": bound(last)}, _SAMPLES, one)


def allowed(df: DataFrame, plan: str, path: str = "path") -> DataFrame:
    """As :func:`windows` for a plan of :func:`signals.support_plan`: no later frame is read, zeros stand before the recording.

    A recording that lacks a frame of the plan is an error; a null plan gives null.
    """
    p = F.col(plan)
    none = F.when(p.isNull(), F.lit(0).cast("long"))
    t = windows(df, path, F.coalesce(none, p["source_start"]), F.coalesce(none, p["source_end"]))
    short = F.col("samples").isNotNull() & (F.size("samples") != p["source_end"] - p["source_start"])
    filled = F.concat(F.array_repeat(F.lit(0.0), p["left_pad"].cast("int")), "samples")
    return t.withColumns({"error": F.when(short, "frames of the plan are missing").otherwise(F.col("error")), "samples": F.when(p.isNotNull() & ~short, filled)})


def kernel(t: np.ndarray, cut: float) -> np.ndarray:
    """A sinc of cut-off ``cut`` (1: half the source's rate) under a Hann window of CROSSINGS zero crossings a side."""
    x = t * cut
    return np.where(np.abs(x) < CROSSINGS, cut * np.sinc(x) * (0.5 + 0.5 * np.cos(np.pi * x / CROSSINGS)), 0.0)


def resampled(df: DataFrame, rate: int, path: str = "path", start_s: str = "start_s", end_s: str = "end_s") -> DataFrame:
    """As :func:`windows`, at another rate: samples [start, end) of what the whole recording would be at that rate.

    Bounds are rounded to the new rate and clipped to the recording; where one is
    null, the whole recording is taken. A sample is a sum over the source
    under :func:`kernel`, so that only frames that a window's samples depend on are
    read. At the recording's own rate samples are its frames.
    """

    def one(files: Files, path: str | None, start: float | None, end: float | None) -> tuple:
        h = files.header(path)
        n = -(-h.frames * rate // h.rate)
        a, b = 0, n
        if start is not None and end is not None and np.isfinite(start) and np.isfinite(end):
            a, b = max(0, round(start * rate)), min(n, round(end * rate))
        if a >= b:
            return np.zeros(0), rate, 0
        if rate == h.rate:
            x, read = files.frames(path, a, b)
            return x, rate, read
        cut = min(1.0, rate / h.rate)
        reach = int(np.ceil(CROSSINGS / cut))
        first = max(0, a * h.rate // rate - reach)
        x, read = files.frames(path, first, (b - 1) * h.rate // rate + reach + 2)
        out = np.empty(b - a)
        step = max(1, (1 << 20) // (2 * reach + 1))
        for i in range(a, b, step):
            at = np.arange(i, min(b, i + step)) * (h.rate / rate)
            near = np.floor(at).astype("i8")[:, None] + np.arange(-reach, reach + 1)
            held = (near >= first) & (near < first + len(x))
            out[i - a : i - a + len(at)] = (np.where(held, x[np.clip(near - first, 0, len(x) - 1)], 0.0) * kernel(at[:, None] - near, cut)).sum(axis=1)
        return out, rate, read

    seconds = lambda c: F.col(c).cast("double")
    return _with(df, {"path": F.col(path), "start": seconds(start_s), "end": seconds(end_s)}, _SAMPLES, one)


def manifest(df: DataFrame, root: str, **override: str) -> DataFrame:
    """The table with (path, start_s, end_s), found by role: paths are put below ``root`` unless absolute, a missing end is start and duration.

    Only the path's column must exist; ``override`` names a role's column. Columns
    so called are replaced.
    """
    at = {role: resolve(df.columns, names, override.get(role), required=role == "path") for role, names in MANIFEST.items()}
    seconds = lambda role: F.col(at[role]).cast("double") if at[role] else F.lit(None).cast("double")
    p = F.trim(F.col(at["path"]).cast("string"))
    full = F.when(p.rlike(r"^(/|[A-Za-z][A-Za-z0-9+.-]*://)"), p).when(F.length(p) > 0, F.concat(F.lit(root.rstrip("/") + "/"), p))
    number = lambda c: F.when(~F.isnan(c), c)
    start, end, duration = (number(seconds(role)) for role in ("start", "end", "duration"))
    return df.withColumns({"path": full, "start_s": start, "end_s": F.coalesce(end, start + duration)})


def pcm(df: DataFrame, folder: str, name: str, samples: str, rate: int, channels: str | Column = "channels") -> DataFrame:
    """Writes each row as a recording of 16-bit samples, and returns (name, path, n_bytes).

    Samples are interleaved where there are several channels; those out of range are
    put at its ends, an incomplete last frame is an error. Names must be unique, in a folder of their own: a file appears
    under its name when it is complete, and a second attempt at a task writes the same bytes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, local = pafs.FileSystem.from_uri(folder)
        fs.create_dir(local, recursive=True)
        for batch in batches:
            done = []
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pydict()
                n, k = row["name"][0], row["channels"][0]
                if n is None:
                    raise ValueError("a recording without a name")
                x = np.array(row["samples"][0] or [], "f8")
                if len(x) % k:
                    raise ValueError(f"{n}: {len(x)} samples in {k} channels")
                raw = np.clip(np.rint(x * 32768), -32768, 32767).astype("<i2").tobytes()
                head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(raw), b"WAVE", b"fmt ", 16, PCM, k, rate, rate * k * 2, k * 2, 16, b"data", len(raw))
                final = f"{local.rstrip('/')}/{n}"
                part = f"{final}.{uuid.uuid4().hex}"
                with fs.open_output_stream(part, compression=None) as out:
                    out.write(head)
                    out.write(raw)
                if fs.get_file_info(final).type == pafs.FileType.NotFound:
                    fs.move(part, final)
                else:  # an earlier attempt's file has the same bytes
                    fs.delete_file(part)
                done.append((n, f"{folder.rstrip('/')}/{n}", len(head) + len(raw)))
            yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.string()), pa.array([d[1] for d in done], pa.string()), pa.array([d[2] for d in done], pa.int64())], names=["name", "path", "n_bytes"])

    given = df.select(F.col(name).cast("string").alias("name"), F.col(samples).cast("array<double>").alias("samples"), (F.col(channels) if isinstance(channels, str) else channels).cast("int").alias("channels"))
    return written(given.mapInArrow(run, "name string, path string, n_bytes long"), "recordings")


def level(df: DataFrame, by: Sequence[str], samples: str = "samples") -> DataFrame:
    """(by, frames, rms, peak) over all blocks of a recording."""
    x = F.col(samples)
    each = df.select(*by, F.size(x).cast("long").alias("n__"), signals.total(F.transform(x, lambda v: v * v)).alias("s__"), signals.peak(x).alias("p__"))
    return each.groupBy(*by).agg(F.sum("n__").alias("frames"), F.sqrt(F.sum("s__") / F.sum("n__")).alias("rms"), F.max("p__").alias("peak"))
