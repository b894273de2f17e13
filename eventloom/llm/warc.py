"""A deterministic sharded WARC writer, and a reader of what it committed.

Rows are dealt to shards by ranges of page_id that hold about equal bytes. Sizes
by page_id are range-sorted, and running sums of bytes (within a range, plus what
the ranges before it hold) say in which shard a page_id comes: cuts follow the
bytes, wherever ids lie, and depend on the rows alone. Shards are of ``shard_bytes``
or as many as MOST_SHARDS, and go to tasks one by one. A task sorts its shards and
writes one gzip member a record, beginning a new file when the compressed size
passes ``roll_bytes``. All headers, lengths and digests are made anew from the
payload. A file is written under a temporary name and renamed when complete; its
name and bytes depend on the rows alone, so that a task that runs twice makes the
same file, and the second attempt leaves a file that is there already. An attempt
that fails removes its temporary file. The manifest, written last by Spark's own
commit, lists the files that count: the reader takes no others.

Of records with equal payloads of at least ``revisit_bytes`` the one with the
largest page_id is a response; the others are revisits that refer to it.

Values: a null html counts as an empty payload; a null URL gives a record
without target; a null page_id is written as such, comes first, and never is
referred to while another has the payload; rows that repeat the largest page_id
are all responses. Records of one page_id have record ids of their own (the first
has the one that others refer to). An empty table gives an empty archive. Extra
columns are not written.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .scratch import dropped, new_path, written

REVISIT_BYTES = 1000
SHARD_BYTES, ROLL_BYTES, MOST_SHARDS = 16 << 20, 8 << 20, 1 << 16
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Bytes that a record has besides its payload, about.
RECORD_BYTES = 500
#: Bytes of a file that the reader holds at once, besides one record.
READ_BYTES = 1 << 20


def plan(pages: DataFrame, revisit_bytes: int = REVISIT_BYTES) -> DataFrame:
    """(page_id, url, html, digest, size, note, refers_to): the pages, and a note for each revisit with what it refers to.

    Notes find their pages in the writer, where both come by page_id: so a page's
    html is moved once, and what decides on revisits are ids and digests alone.
    """
    html = F.coalesce("html", F.lit(""))
    digest = F.when(F.octet_length(html) >= revisit_bytes, F.unhex(F.sha1(html.cast("binary"))))
    size = (F.octet_length(html) + RECORD_BYTES).cast("long")
    rows = pages.select("page_id", "url", html.alias("html"), digest.alias("digest"), size.alias("size"), F.lit(False).alias("note"), F.lit(None).cast("long").alias("refers_to"))
    known = pages.select("page_id", digest.alias("digest")).where("digest is not null")
    first = known.groupBy("digest").agg(F.max("page_id").alias("first_id"), F.count("*").alias("n")).where("n > 1").drop("n")
    notes = known.join(first, "digest").where("first_id is not null and not page_id <=> first_id").distinct()
    return rows.unionByName(notes.select("page_id", "digest", F.lit(True).alias("note"), F.col("first_id").alias("refers_to")), allowMissingColumns=True)


def _uri(page_id: int | None, copy: int | str = 0) -> str:
    return f"<urn:x-page:{'null' if page_id is None else page_id}{f':{copy}' if copy else ''}>"


def _id(uri: str) -> int | None:
    own = uri.removeprefix("<urn:x-page:").removesuffix(">").partition(":")[0]
    return None if own == "null" else int(own)


def _sha1(raw: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(raw).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, copy: int | str = 0) -> bytes:
    """One gzip member with one record; copy counts the records of a page_id from 0."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if refers_to is not None else 'response'}",
        f"WARC-Record-ID: {_uri(page_id, copy)}",
        f"WARC-Date: {DATE}",
        *([f"WARC-Target-URI: {quote(url, safe=''.join(map(chr, range(33, 127))))}"] if url is not None else []),
        *([f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_uri(refers_to)}"] if refers_to is not None else []),
        f"WARC-Payload-Digest: {_sha1(payload)}",
        f"WARC-Block-Digest: {_sha1(block)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + packer.flush()


class _Roller:
    """The files of one shard after another."""

    def __init__(self, folder: str, roll_bytes: int):
        self.fs, self.folder = pafs.FileSystem.from_uri(folder)
        self.roll_bytes, self.shard, self.roll, self.out, self.tmp = roll_bytes, None, 0, None, None
        self.done: list[tuple[str, int, int]] = []

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.out, final = None, f"{self.folder}/{self.name}"
            there = self.fs.get_file_info(final)
            if there.type != pafs.FileType.NotFound and there.size == self.size:  # an earlier attempt's file has the same bytes
                self.fs.delete_file(self.tmp)
            else:
                self.fs.move(self.tmp, final)
            self.tmp = None
            self.done.append((self.name, self.records, self.size))

    def given_up(self) -> None:
        """Removes what a failed attempt leaves."""
        if self.out is not None:
            self.out.close()
            self.out = None
        if self.tmp is not None:
            self.fs.delete_file(self.tmp)
            self.tmp = None

    def add(self, shard: int, raw: bytes) -> None:
        if shard != self.shard:
            self.close()
            self.shard, self.roll = shard, 0
        if self.out is not None and self.size + len(raw) > self.roll_bytes:
            self.close()
            self.roll += 1
        if self.out is None:
            self.name = f"shard-{shard:06d}-{self.roll:04d}.warc.gz"
            self.tmp = f"{self.folder}/.{self.name}.{uuid.uuid4().hex}.tmp"
            self.out, self.records, self.size = self.fs.open_output_stream(self.tmp, compression=None), 0, 0
        self.out.write(raw)
        self.records, self.size = self.records + 1, self.size + len(raw)


def shard_cuts(sizes: DataFrame, shard_bytes: int) -> np.ndarray:
    """The first page_id of each shard but the first, from (page_id, size): MOST_SHARDS of them at most.

    The running sum of bytes before a page_id doesn't depend on where Spark's own
    ranges end, so that neither do the cuts.
    """
    spark = sizes.sparkSession
    by_id = sizes.where("page_id is not null").groupBy(F.col("page_id").cast("long").alias("page_id")).agg(F.sum("size").alias("size"))
    ranged = written(by_id.repartitionByRange("page_id").withColumn("part", F.spark_partition_id()), "warc-sizes")
    parts = ranged.groupBy("part").agg(F.sum("size").alias("held")).orderBy("part").toPandas()  # a row a shuffle partition
    total = int(parts["held"].sum())
    each = max(shard_bytes, -(-total // MOST_SHARDS))
    before = (parts["held"].cumsum() - parts["held"]).tolist()
    offsets = spark.createDataFrame(list(zip(parts["part"].tolist(), before, strict=True)), "part int, before long")
    upto = F.sum("size").over(Window.partitionBy("part").orderBy("page_id")) - F.col("size")
    shard = F.floor((F.col("before") + F.col("upto")) / F.lit(each))
    first = ranged.withColumn("upto", upto).join(F.broadcast(offsets), "part").groupBy(shard.alias("shard")).agg(F.min("page_id").alias("first"))
    cuts = np.sort(first.toPandas()["first"].to_numpy(np.int64))[1:]
    dropped(ranged)
    return cuts


def write(planned: DataFrame, folder: str | None = None, shard_bytes: int = SHARD_BYTES, roll_bytes: int = ROLL_BYTES) -> str:
    """Writes the archive and returns its folder; the manifest is in ``<folder>/manifest``."""
    spark = planned.sparkSession
    folder = folder or new_path(spark, "warc")
    cuts = shard_cuts(planned.where("not note").select("page_id", "size"), shard_bytes)
    share = spark.sparkContext.broadcast(cuts)

    @F.arrow_udf("int")
    def shard_of(page_id: pa.Array) -> pa.Array:
        return pa.array(np.searchsorted(share.value, page_id.fill_null(0).to_numpy(zero_copy_only=False), side="right").astype(np.int32))

    # pages without an id are dealt by what they hold, so that there may be any number of them
    spread = F.pmod(F.when(F.col("digest").isNotNull(), F.xxhash64("digest")).otherwise(F.xxhash64("url", "html")), F.lit(len(cuts) + 1)).cast("int")
    shard = F.when(F.col("page_id").isNull(), spread).otherwise(shard_of(F.col("page_id").cast("long")))
    dealt = planned.withColumn("shard", shard).repartitionById(len(cuts) + 1, F.col("shard")).sortWithinPartitions("shard", "page_id", "digest", F.desc("note"), "url", "html")
    fs, local = pafs.FileSystem.from_uri(folder)
    fs.create_dir(local, recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roller = _Roller(folder, roll_bytes)
        noted, to = None, None  # the page and digest of the last note, and what it refers to
        last, copy = None, 0  # the last record's shard and page, and how many of them came before
        try:
            for batch in batches:
                for row in batch.to_pylist():
                    page = (row["page_id"], row["digest"])
                    if row["note"]:
                        noted, to = page, row["refers_to"]
                        continue
                    own = (row["shard"], row["page_id"])
                    last, copy = own, copy + 1 if own == last else 0
                    label = f"{own[0]}.{copy}" if own[1] is None else copy
                    roller.add(own[0], record(own[1], row["url"], row["html"].encode("utf-8", "surrogatepass"), to if page == noted else None, label))
            roller.close()
        except BaseException:
            roller.given_up()
            raise
        if roller.done:
            names, records, sizes = zip(*roller.done, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(records), pa.array(sizes)], ["file", "records", "bytes"])

    columns = dealt.select("shard", "page_id", "url", "html", "digest", "note", "refers_to")
    columns.mapInArrow(run, "file string, records long, bytes long").write.parquet(f"{folder}/manifest")
    return folder


def _fields(raw: bytes) -> dict[str, str]:
    lines = raw.decode("utf-8").split("\r\n")[1:]
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}


def parse(raw: bytes) -> dict:
    """A record's fields; raises if a length or digest does not hold."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    f = _fields(head)
    block, tail = rest[: int(f["content-length"])], rest[int(f["content-length"]) :]
    if not head.startswith(b"WARC/1.1") or tail != b"\r\n\r\n" or f["warc-block-digest"] != _sha1(block):
        raise ValueError(f"damaged record {f.get('warc-record-id')}")
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(_fields(http)["content-length"])
    if f["warc-type"] == "response" and (len(payload) != size or f["warc-payload-digest"] != _sha1(payload)):
        raise ValueError(f"damaged payload of {f['warc-record-id']}")
    digest = base64.b32decode(f["warc-payload-digest"].removeprefix("sha1:")).hex()
    to = f.get("warc-refers-to")
    return {"page_id": _id(f["warc-record-id"]), "url": f.get("warc-target-uri"), "record_type": f["warc-type"], "payload_bytes": size, "payload_digest": digest, "refers_to": _id(to) if to else None, "payload": payload if f["warc-type"] == "response" else None}


def members(stream) -> Iterator[bytes]:
    """The gzip members of a stream, one after another."""
    left, unpack, out = b"", zlib.decompressobj(31), []
    while data := left or stream.read(READ_BYTES):
        left = b""
        out.append(unpack.decompress(data))
        if unpack.eof:
            yield b"".join(out)
            left, unpack, out = unpack.unused_data, zlib.decompressobj(31), []
    if out:
        raise ValueError("the file ends within a record")


def read(spark: SparkSession, folder: str, payload: bool = False) -> DataFrame:
    """The records of all files in the manifest: page_id, url, record_type, payload_bytes, payload_digest, refers_to (and payload)."""
    schema = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long" + ", payload binary" * payload
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64()] + [pa.binary()] * payload
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, local = pafs.FileSystem.from_uri(folder)
        rows: list[dict] = []
        out = lambda: pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], k) for n, k in zip(names, kinds, strict=True)], names)
        for batch in batches:
            for file, records in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                seen = 0
                with fs.open_input_stream(f"{local}/{file}", compression=None) as stream:
                    for raw in members(stream):
                        rows.append(parse(raw) if payload else parse(raw) | {"payload": None})
                        seen += 1
                        if len(rows) >= 500:
                            yield out()
                            rows = []
                if seen != records:
                    raise ValueError(f"{file}: {seen} records, the manifest has {records}")
        if rows:
            yield out()

    manifest = spark.read.schema("file string, records long, bytes long").parquet(f"{folder}/manifest")
    return manifest.select("file", "records").repartition(max(1, spark.sparkContext.defaultParallelism), "file").mapInArrow(run, schema)
