"""Media columns: signature sniffing, type correction, carving, and 8-bit samples.

An Aho-Corasick automaton finds all magic bytes of a blob in one pass. At each
find a validator of that format walks the structure (chunk lengths, checksums,
end marks) and says how long the object is; text that only looks like a magic
number fails there. The first confirmed object at offset 0 gives the type;
objects elsewhere are carved with offset and length. Objects inside a confirmed
one are listed too, as a container may hold them.

Values: a null blob counts as empty; a blob in which nothing is confirmed has
type ``application/octet-stream``. A null text stores as an empty payload of
padding alone. Equal blobs give equal values; repeated rows are kept. Other
columns go through unchanged; added columns replace columns of the same name.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

UNKNOWN = "application/octet-stream"
#: Payloads are padded with PAD to a positive multiple of UNIT bytes.
UNIT, PAD, RATE = 576, 255, 8000
#: Bytes of blobs that become Python objects at once; one larger blob is taken alone.
SLICE_BYTES = 8 << 20


def wav_write(samples: bytes, rate: int = RATE) -> bytes:
    """Unsigned 8-bit mono PCM in a RIFF file."""
    pad = len(samples) & 1
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(samples) + pad, b"WAVE", b"fmt ", 16, 1, 1, rate, rate, 1, 8, b"data", len(samples))
    return head + samples + b"\0" * pad


def riff_chunks(b: bytes, at: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    p = at + 12
    while p + 8 <= end:
        name, size = struct.unpack_from("<4sI", b, p)
        yield name, p + 8, size
        p += 8 + size + (size & 1)


def _riff(b: bytes, at: int) -> tuple[str, int] | None:
    if at + 20 > len(b):
        return None
    size, form = struct.unpack_from("<I4s", b, at + 4)
    kind = {b"WAVE": "audio/wav", b"WEBP": "image/webp", b"AVI ": "video/x-msvideo"}.get(form)
    end = at + 8 + size
    if not kind or end > len(b):
        return None
    names = []
    for name, start, n in riff_chunks(b, at, end):
        if start + n > end:
            return None
        names.append(name)
    return (kind, end - at) if names and (kind != "audio/wav" or {b"fmt ", b"data"} <= {*names}) else None


def _png(b: bytes, at: int) -> tuple[str, int] | None:
    p, first = at + 8, True
    while p + 12 <= len(b):
        n, name = struct.unpack_from(">I4s", b, p)
        if first and (name != b"IHDR" or n != 13) or p + 12 + n > len(b):
            return None
        if zlib.crc32(b[p + 4 : p + 8 + n]) != struct.unpack_from(">I", b, p + 8 + n)[0]:
            return None
        first, p = False, p + 12 + n
        if name == b"IEND":
            return "image/png", p - at
    return None


def _blocks(b: bytes, p: int) -> int:
    """The end of GIF sub-blocks, or -1."""
    while p < len(b):
        n = b[p]
        p += 1 + n
        if n == 0:
            return p
    return -1


def _gif(b: bytes, at: int) -> tuple[str, int] | None:
    if at + 13 > len(b):
        return None
    p = at + 13 + (3 << (b[at + 10] & 7) + 1 if b[at + 10] & 128 else 0)
    while 0 <= p < len(b):
        if b[p] == 0x3B:
            return "image/gif", p + 1 - at
        if b[p] == 0x21:
            p = _blocks(b, p + 2)
        elif b[p] == 0x2C and p + 10 < len(b):
            flags = b[p + 9]
            p = _blocks(b, p + 11 + (3 << (flags & 7) + 1 if flags & 128 else 0))
        else:
            return None
    return None


def _jpeg(b: bytes, at: int) -> tuple[str, int] | None:
    p, framed = at + 2, False
    while p + 4 <= len(b):
        if b[p] != 0xFF:
            return None
        mark = b[p + 1]
        n = struct.unpack_from(">H", b, p + 2)[0]
        if mark in (0xD8, 0x00, 0x01) or 0xD0 <= mark <= 0xD9 or n < 2:
            return None
        framed |= 0xC0 <= mark <= 0xCF and mark not in (0xC4, 0xC8, 0xCC)
        p += 2 + n
        if mark == 0xDA:  # entropy-coded data up to the next real mark
            while (p := b.find(b"\xff", p)) >= 0 and p + 1 < len(b):
                if b[p + 1] == 0xD9:
                    return ("image/jpeg", p + 2 - at) if framed else None
                if b[p + 1] and not 0xD0 <= b[p + 1] <= 0xD7:
                    break
                p += 2
            if p < 0:
                return None
    return None


def _bmp(b: bytes, at: int) -> tuple[str, int] | None:
    if at + 54 > len(b):
        return None
    size, zero, start, head = struct.unpack_from("<IIII", b, at + 2)
    planes, depth = struct.unpack_from("<HH", b, at + 26)
    good = zero == 0 and head in (40, 108, 124) and planes == 1 and depth in (1, 4, 8, 16, 24, 32) and 14 + head <= start < size
    return ("image/bmp", size) if good and at + size <= len(b) else None


#: Magic bytes and the validator that confirms them (fixed values of the formats).
FORMATS: dict[bytes, Callable[[bytes, int], tuple[str, int] | None]] = {
    b"RIFF": _riff,
    b"\x89PNG\r\n\x1a\n": _png,
    b"GIF87a": _gif,
    b"GIF89a": _gif,
    b"\xff\xd8\xff": _jpeg,
    b"BM": _bmp,
}
_AUTOMATON: list = []


def automaton():
    if not _AUTOMATON:
        import ahocorasick

        a = ahocorasick.Automaton()
        for magic in FORMATS:
            a.add_word(magic.decode("latin-1"), magic)
        a.make_automaton()
        _AUTOMATON.append(a)
    return _AUTOMATON[0]


def find(blob: bytes) -> list[tuple[str, int, int]]:
    """(type, offset, length) of every confirmed object, by offset."""
    out = []
    for last, magic in automaton().iter(blob.decode("latin-1")):
        at = last + 1 - len(magic)
        if got := FORMATS[magic](blob, at):
            out.append((got[0], at, got[1]))
    return sorted(out, key=lambda x: (x[1], -x[2]))


def samples(blob: bytes, kind: str, at: int, size: int) -> bytes | None:
    """The 8-bit samples of a WAV object of a blob."""
    if kind == "audio/wav":
        for name, start, n in riff_chunks(blob, at, at + size):
            if name == b"data":
                return blob[start : start + n]
    return None


def _extended(schema: T.StructType, add: list[tuple[str, T.DataType]], drop: set[str]) -> T.StructType:
    out = {n.lower() for n, _ in add} | {n.lower() for n in drop}
    return T.StructType([f for f in schema if f.name.lower() not in out] + [T.StructField(n, t) for n, t in add])


def _slices(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """Parts of a batch, of so many bytes of a column that no array made of one comes near Arrow's 2 GB."""
    upto = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 64)
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + SLICE_BYTES, "right")))
        yield batch.slice(at, to - at)
        at = to


def _mapped(df: DataFrame, column: str, add: list[tuple[str, T.DataType]], one: Callable, drop: set[str]) -> DataFrame:
    """Adds columns that ``one`` computes from a column's value."""
    schema = _extended(df.schema, add, drop)
    names = [f.name for f in schema][: -len(add)]
    kinds = {T.StringType(): pa.string(), T.BinaryType(): pa.binary(), T.LongType(): pa.int64()}

    def kind(t: T.DataType) -> pa.DataType:
        if isinstance(t, T.ArrayType):
            return pa.list_(pa.struct([(f.name, kinds[f.dataType]) for f in t.elementType]))
        return kinds[t]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _slices(batch, column):
                rows = [one(x.as_py()) for x in part.column(column)]
                new = [pa.array([r[i] for r in rows], kind(t)) for i, (_, t) in enumerate(add)]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), *new], [*names, *(n for n, _ in add)])

    return df.mapInArrow(run, schema)


def store_text(df: DataFrame, text: str = "text", media: str = "media", declared: str = "declared_type", n_bytes: str = "n_bytes", keep_text: bool = False) -> DataFrame:
    """Adds a text's bytes as an 8-bit sound, with a declared type that says nothing, and its unpadded size."""

    return _mapped(df, text, [(media, T.BinaryType()), (declared, T.StringType()), (n_bytes, T.LongType())], _stored, set() if keep_text else {text})


def _stored(t: str | None) -> tuple[bytes, str, int]:
    raw = (t or "").encode("utf-8", "surrogatepass")
    return wav_write(raw + bytes([PAD]) * (-len(raw) % UNIT if raw else UNIT)), UNKNOWN, len(raw)


FOUND = T.ArrayType(T.StructType([T.StructField("type", T.StringType()), T.StructField("offset", T.LongType()), T.StructField("length", T.LongType())]))


def sniff(df: DataFrame, media: str = "media", kind: str = "media_type", found: str = "found") -> DataFrame:
    """Adds the confirmed type, which corrects a declared one, and all confirmed objects."""

    return _mapped(df, media, [(kind, T.StringType()), (found, FOUND)], lambda b: _sniffed(find(b or b"")), set())


def _sniffed(objects: list[tuple[str, int, int]]) -> tuple[str, list[dict]]:
    return (objects[0][0] if objects and objects[0][1] == 0 else UNKNOWN), [{"type": t, "offset": a, "length": n} for t, a, n in objects]


def read_samples(df: DataFrame, media: str = "media", payload: str = "payload", feature: str = "feature") -> DataFrame:
    """Adds the samples of a blob's first sound, carved and read back, and features of them."""

    return _mapped(df, media, [(payload, T.BinaryType()), (feature, T.StringType())], lambda b: _read(b or b"", find(b or b"")), set())


def _read(b: bytes, objects: list[tuple[str, int, int]]) -> tuple[bytes | None, str]:
    for kind, at, size in objects:
        if (raw := samples(b, kind, at, size)) is not None:
            a = np.frombuffer(raw, np.uint8)
            n = np.bincount(a, minlength=256)
            p = n[n > 0] / max(len(a), 1)
            turns = np.count_nonzero((a[1:] >= 128) != (a[:-1] >= 128))
            mean = float(a.mean()) if len(a) else 0.0
            return raw, f"{kind};samples={len(a)};mean={mean:.4f};entropy={float(-(p * np.log2(p)).sum()) + 0.0:.4f};crossings={turns};embedded={len(objects) - 1}"
    return None, f"{objects[0][0] if objects else UNKNOWN};samples=0"


def round_trip(df: DataFrame, text: str = "text", keep_text: bool = False) -> DataFrame:
    """:func:`store_text`, :func:`sniff` and :func:`read_samples` of what it stores, in one pass: the stored bytes are scanned once."""

    def one(t: str | None) -> tuple:
        stored = _stored(t)
        objects = find(stored[0])
        return *stored, *_sniffed(objects), *_read(stored[0], objects)

    add = [("media", T.BinaryType()), ("declared_type", T.StringType()), ("n_bytes", T.LongType()), ("media_type", T.StringType()), ("found", FOUND), ("payload", T.BinaryType()), ("feature", T.StringType())]
    return _mapped(df, text, add, one, set() if keep_text else {text})


def carve(df: DataFrame, media: str = "media", found: str = "found", out: str = "carved") -> DataFrame:
    """One row for each confirmed object, with its bytes: embedded media cut from their containers."""
    from pyspark.sql import functions as F

    each = df.withColumn(out, F.explode(found))
    cut = F.expr(f"substring(`{media}`, cast(`{out}`.offset + 1 as int), cast(`{out}`.length as int))")
    return each.withColumn(out, F.struct(f"{out}.type", f"{out}.offset", f"{out}.length", cut.alias("bytes")))
