"""The prefix trie against one built node by node, and its SQL."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from eventloom.llm import prefix_trie, queries
from oracle import assert_same

SCHEMA = "conv_id long, turn long, role string, text string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def brute(rows: list) -> list:
    turns = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            turns[c].append((turn is not None, turn or 0, hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).hexdigest(), role, text))
    turns = {c: [x[3:] for x in sorted(t)] for c, t in turns.items()}
    members = defaultdict(list)
    ends = defaultdict(list)
    for c in sorted(turns):
        h = zlib.crc32(str(c).encode()) % 6
        head = c - (c % 100 if c >= 0 else -(-c % 100))
        whole = tuple(turns.get(head, [])[:h] + turns[c][h:])
        for d in range(len(whole) + 1):
            members[whole[:d]].append(c)
        ends[whole].append(c)
    children = defaultdict(list)
    for p in members:
        if p:
            children[p[:-1]].append(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[x] for x in children[p]) or 1
        saved[p] = sum(saved[x] for x in children[p]) + ((len(members[p]) - 1) * len(p[-1][1]) if p else 0)
    digest = lambda ids: hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
    return sorted(
        ((members[p][0], len(p), members[p[:-1]][0] if p else None, len(members[p]), len(children[p]), leaves[p], saved[p], digest(ends[p])) for p in members),
        key=str,
    )


def got(spark, rows: list, schema: str = SCHEMA) -> list:
    return sorted((tuple(r) for r in prefix_trie.trie(spark.createDataFrame(rows, schema)).select(*COLUMNS).collect()), key=str)


@pytest.fixture
def some():
    """A hot first turn, copies of whole conversations, long common openings, heads that are absent or short."""
    rng = random.Random(2)
    rows = []
    for c in [*range(0, 60), *range(100, 140), *range(205, 330), -305, -300, -7]:
        n = rng.choice([0, 1, 2, 3, 4, 6, 9])
        for t in range(n):
            text = "hello" if t == 0 and c % 3 else f"t{rng.randint(0, 1 + t)}"
            rows.append((c, t, ("user", "assistant")[t % 2], text))
    rows += [(900 + c, t, "user", f"same {t}") for c in range(1, 70) for t in range(12)]
    rows += [(5000, t, "user", "é" * (t % 7)) for t in range(1500)] + [(5001, t, "user", "é" * (t % 7)) for t in range(1501)]
    rng.shuffle(rows)
    return rows


def test_same_as_node_by_node(spark, some):
    assert got(spark, some) == brute(some)


def test_heavy_levels_and_many_shards(spark, some, monkeypatch):
    monkeypatch.setattr(prefix_trie, "heavy_cap", lambda rows: 3)
    monkeypatch.setattr(prefix_trie, "SHARD", 7)
    monkeypatch.setattr(prefix_trie, "ENDS", 4)
    monkeypatch.setattr(prefix_trie, "HEAVY", 10**9)
    monkeypatch.setattr(prefix_trie, "PIECE", 5)
    assert got(spark, some) == brute(some)


def test_odd_rows(spark):
    rows = [(1, None, None, None), (1, None, "user", "b"), (1, 0, "user", ""), (1, 0, "user", ""), (2, 5, None, "x"), (None, 1, "user", "y"), (3, 1, "user", "z" * 200_000), (102, 1, "user", "w")]
    assert got(spark, rows) == brute(rows)
    assert got(spark, []) == [] and got(spark, [(None, 1, "user", "y")]) == []
    assert got(spark, [(103, 1, "user", "y")]) == brute([(103, 1, "user", "y")])  # h may leave no turn at all
    clash = [(*r, 1, "a") for r in rows]
    assert got(spark, clash, SCHEMA + ", node long, Depth string") == brute(rows)


def test_louds_bits():
    key = lambda i: i.to_bytes(16, "big")
    node = np.array([key(i) for i in (1, 2, 3, 4, 5, 9)], object)
    parent = np.array([b"", key(1), key(1), key(3), key(3), b""], object)
    louds = prefix_trie.Louds(node, parent, np.array([1, 2, 2, 3, 3, 2]))
    # tops 1 and 9, then 2 and 3, then 4 and 5
    assert louds.labels.tolist() == [key(i) for i in (1, 9, 2, 3, 4, 5)]
    assert "".join(map(str, louds.bits.astype(int))) == "110" "110" "0" "0" "110" "0" "0"
    assert louds.parents.tolist() == [-1, -1, 0, 0, 3, 3]
    assert louds.rolled(np.ones(6, np.int64)).tolist() == [5, 1, 1, 3, 1, 1]


def test_query_same_as_sql(spark, data):
    assert_same(queries.op11_prefix_trie(spark, f"{data}/sf0.01"), queries.OP11_SQL, f"{data}/sf0.01")
