from __future__ import annotations

import hashlib
import struct
import zlib

from eventloom.llm import media as M
from eventloom.llm.queries import op10_media


def png() -> bytes:
    chunk = lambda n, d: struct.pack(">I", len(d)) + n + d + struct.pack(">I", zlib.crc32(n + d))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 1, 1, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"\0\0")) + chunk(b"IEND", b"")


def gif() -> bytes:
    return b"GIF89a" + struct.pack("<HHBBB", 1, 1, 0x80, 0, 0) + b"\0" * 6 + b"\x2c" + struct.pack("<HHHHB", 0, 0, 1, 1, 0) + b"\x02\x02\x44\x01\x00" + b"\x3b"


def jpeg() -> bytes:
    seg = lambda m, d: b"\xff" + bytes([m]) + struct.pack(">H", len(d) + 2) + d
    return b"\xff\xd8" + seg(0xE0, b"JFIF\0" + b"\0" * 9) + seg(0xC0, b"\x08\0\1\0\1\1\1\x11\0") + seg(0xDA, b"\1\1\0\0\x3f\0") + b"\x12\xff\x00\x34\xff\xd9"


def bmp() -> bytes:
    body = struct.pack("<IiiHHIIiiII", 40, 1, 1, 1, 24, 0, 4, 0, 0, 0, 0) + b"\0\0\0\0"
    return b"BM" + struct.pack("<IHHI", 14 + len(body), 0, 0, 54) + body


WHOLE = {"image/png": png(), "image/gif": gif(), "image/jpeg": jpeg(), "image/bmp": bmp(), "audio/wav": M.wav_write(b"abc")}


def test_each_format_is_confirmed_and_carved():
    for kind, raw in WHOLE.items():
        assert M.find(raw) == [(kind, 0, len(raw))]
        assert M.find(b"RIFF junk GIF89a BM " + raw + b"tail") == [(kind, 20, len(raw))]
        for cut in (1, 3, len(raw) // 2):
            assert M.find(raw[:-cut]) == [] or kind == "audio/wav" and cut == 1 and M.find(raw[:-cut]) == []
    broken = bytearray(png())
    broken[20] ^= 1
    assert M.find(bytes(broken)) == []


def test_columns(spark):
    rows = [(k, kind, raw) for k, (kind, raw) in enumerate(WHOLE.items())] + [(10, "image/png", gif()), (11, None, None), (12, "x", b""), (13, "x", b"GIF89a is a text"), (14, "x", M.wav_write(png() + b"xy")), (14, "x", M.wav_write(png() + b"xy"))]
    df = spark.createDataFrame(rows, "id int, declared_type string, media binary").selectExpr("*", "1 AS found", "2 AS payload", "'z' AS bytes")
    out = M.read_samples(M.sniff(df))
    by = {r.id: r for r in out.collect()}
    assert out.count() == len(rows)
    assert {k: by[k].media_type for k in (10, 11, 12, 13, 14)} == {10: "image/gif", 11: M.UNKNOWN, 12: M.UNKNOWN, 13: M.UNKNOWN, 14: "audio/wav"}
    assert bytes(by[14].payload) == png() + b"xy" and by[11].payload is None
    cut = [bytes(r.carved.bytes) for r in M.carve(M.sniff(df)).where("carved.type = 'image/png' and id = 14").collect()]
    assert cut == [png()] * 2
    assert M.sniff(df.limit(0)).count() == 0


def test_query(spark, data):
    docs = {d.doc_id: (d.text or "").encode() for d in spark.read.parquet(f"{data}/sf0.001/documents.parquet").collect()}
    rows = op10_media(spark, f"{data}/sf0.001").collect()
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    for r in rows:
        raw = docs[r.doc_id]
        pad = raw + b"\xff" * (-len(raw) % 576 if raw else 576)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(pad), hashlib.sha256(pad).hexdigest(), zlib.crc32(pad[-32:]))
        stored = M.wav_write(pad)
        assert (r.media_bytes, r.media_sha256) == (len(stored), hashlib.sha256(stored).hexdigest())
        assert r.media_type == "audio/wav" and r.feature
    same = {}
    for r in rows:
        assert same.setdefault(docs[r.doc_id], r.feature) == r.feature


def test_one_pass_gives_what_three_give(spark, monkeypatch):
    texts = [None, "", "RIFF GIF89a BM", "x" * 5000, "é" * 300, png().decode("latin-1")] * 3
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    one = M.round_trip(df)
    three = M.read_samples(M.sniff(M.store_text(df)))
    assert one.columns == three.columns
    assert sorted(map(repr, one.collect())) == sorted(map(repr, three.collect()))


def test_slices_go_by_bytes():
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array(["x" * (3 << 20), None, "y", "z" * (9 << 20), "a" * (7 << 20), "b" * (2 << 20)])], ["text"])
    assert [p.num_rows for p in M._slices(batch, "text")] == [3, 1, 1, 1]
    assert list(M._slices(batch.slice(0, 0), "text")) == []
    assert [p.num_rows for p in M._slices(batch.slice(2), "text")] == [1, 1, 1, 1]


def test_case_variants_of_added_columns(spark):
    docs = spark.createDataFrame([(1, "the cat", 7, "x")], "doc_id long, text string, Found int, PAYLOAD string")
    out = M.round_trip(docs)
    assert sorted(out.columns) == sorted(["doc_id", "media", "declared_type", "n_bytes", "media_type", "found", "payload", "feature"])
    assert bytes(out.select("payload").first()[0])[:7] == b"the cat"
