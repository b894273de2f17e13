from __future__ import annotations

import hashlib
from pathlib import Path

import pytest
from eventloom.llm import queries, warc
from oracle import assert_same


def test_query(spark, data):
    assert_same(queries.op4_warc(spark, f"{data}/sf0.001"), queries.OP4_SQL, f"{data}/sf0.001")


ROWS = [(1, "http://a/", "x" * 1200), (2, "http://b/ é\r\nX: y", "x" * 1200), (9, None, "x" * 1200), (3, "u", "short"), (4, "u", "short"), (5, "u", None), (6, "u", ""), (7, "u", "é\r\n\r\n" * 3000), (-8, "u", "WARC/1.1\r\n\r\n" * 100), (None, "n", "z" * 1500), (10, "m", "z" * 1500)]


def table(spark, rows=ROWS):
    return spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS shard", "'k' AS digest")


def test_round_trip(spark):
    folder = warc.write(warc.plan(table(spark)), shard_bytes=4000, roll_bytes=600)
    got = {r.page_id: r for r in warc.read(spark, folder, payload=True).collect()}
    assert len(got) == len(ROWS)
    for page, _, html in ROWS:
        raw, r = (html or "").encode(), got[page]
        assert (r.payload_bytes, r.payload_digest) == (len(raw), hashlib.sha1(raw).hexdigest())
        assert r.payload is None if r.record_type == "revisit" else bytes(r.payload) == raw
    assert {k: r.refers_to for k, r in got.items() if r.record_type == "revisit"} == {1: 9, 2: 9, None: 10}
    files = sorted(p.name for p in Path(folder.removeprefix("file://")).glob("*.warc.gz"))
    assert len(files) > 3 and not list(Path(folder.removeprefix("file://")).glob("*.tmp"))
    again = warc.write(warc.plan(table(spark).repartition(5)), shard_bytes=4000, roll_bytes=600)
    both = [{p.name: p.read_bytes() for p in Path(f.removeprefix("file://")).glob("*.warc.gz")} for f in (folder, again)]
    assert both[0] == both[1]  # the rows alone decide names and bytes


def test_empty_and_repeated(spark):
    empty = table(spark).limit(0)
    assert warc.read(spark, warc.write(warc.plan(empty))).count() == 0
    twice = table(spark, [(1, "u", "q" * 2000)] * 2 + [(None, "u", "w" * 2000)] * 2)
    back = warc.read(spark, warc.write(warc.plan(twice))).collect()
    assert [r.record_type for r in back] == ["response"] * 4


def test_damage_is_found(spark):
    folder = warc.write(warc.plan(table(spark)))
    file = next(Path(folder.removeprefix("file://")).glob("*.warc.gz"))
    raw = file.read_bytes()
    file.write_bytes(raw[: len(raw) // 2])
    with pytest.raises(Exception, match="record|Error"):
        warc.read(spark, folder).collect()


def test_an_outlying_id_leaves_the_files_as_they_are(spark):
    rows = [(k, f"http://h/{k}", f"{k} " + "x" * 2000) for k in range(500)]
    names = []
    for more in ([], [(10**18, "u", "y" * 2000)], [(-(2**62), "u", "y" * 2000)]):
        folder = warc.write(warc.plan(table(spark, rows + more)), shard_bytes=50_000)
        names.append(sorted(p.name for p in Path(folder.removeprefix("file://")).glob("*.warc.gz")))
        per_file = [r.records for r in spark.read.parquet(f"{folder}/manifest").collect()]
        assert sum(per_file) == 500 + len(more) and max(per_file) <= 30
        assert not list(Path(folder.removeprefix("file://")).glob(".*.tmp"))
    assert all(abs(len(n) - len(names[0])) <= 1 for n in names) and len(names[0]) >= 20


def test_record_ids_are_unique_and_nulls_spread(spark):
    rows = [(5, "u", "same")] * 3 + [(None, f"u{k}", "z" * 100 + str(k)) for k in range(200)] + [(k, "v", "w" * 3000) for k in range(100, 110)]
    folder = warc.write(warc.plan(table(spark, rows)), shard_bytes=8000)
    ids, shards = [], set()
    for file in Path(folder.removeprefix("file://")).glob("*.warc.gz"):
        with file.open("rb") as stream:
            for raw in warc.members(stream):
                f = warc._fields(raw.partition(b"\r\n\r\n")[0])
                ids.append(f["warc-record-id"])
                if "null" in ids[-1]:
                    shards.add(file.name)
    assert len(ids) == len(set(ids)) == len(rows) and len(shards) > 1
    assert sorted((r.page_id or -1) for r in warc.read(spark, folder).collect()) == sorted((r[0] or -1) for r in rows)


def test_a_failed_attempt_leaves_no_file(tmp_path):
    roller = warc._Roller(f"file://{tmp_path}", 1000)
    roller.add(0, b"abc")
    roller.given_up()
    assert not list(tmp_path.iterdir())
    for _ in range(2):  # the second attempt finds the first one's file
        roller = warc._Roller(f"file://{tmp_path}", 1000)
        roller.add(0, b"abc")
        roller.close()
        assert [p.name for p in tmp_path.iterdir()] == [roller.name] and roller.done == [(roller.name, 1, 3)]
