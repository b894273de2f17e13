"""Ranked lexical search against a search of all documents, and its SQL."""

from __future__ import annotations

import math
import random
from collections import Counter

import numpy as np
import pytest
from eventloom.llm import lexical, queries
from oracle import assert_same

DOCS, ITEMS = "doc_id long, text string", "item_id long, text string"


def terms(text: str | None) -> list[str]:
    out, now = [], ""
    for c in (text or "") + " ":
        if c.isascii() and not c.isalnum():
            out += [now] * bool(now)
            now = ""
        else:
            now += c.lower() if c.isascii() else c
    return out


def brute(docs: list, items: list, k: int = 50) -> list:
    held = [(i, Counter(terms(t))) for i, t in docs]
    held = [(i, c) for i, c in held if c]
    n, total = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item in {i for i, _ in items}:
        asked = {t for i, text in items if i == item for t in terms(text)}
        scores = []
        for i, c in held:
            m = 50 + 50 * sum(c.values()) * n // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * m)) for t in asked if t in c)
            if s > 0:
                scores.append((-s, i is None, i or 0, i))
        out += [(item, r, i, -s) for r, (s, _, _, i) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=str)


def got(spark, docs, items, k=50) -> list:
    return sorted((tuple(r) for r in lexical.search(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS), k).collect()), key=str)


@pytest.fixture
def some():
    rng = random.Random(5)
    words = [f"w{int(rng.paretovariate(0.6)) % 400}" for _ in range(4000)]
    docs = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(1, 60)))) for i in range(600)]
    docs += [(1000 + i, docs[3][1]) for i in range(80)]  # more equal scores than places
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(1, 30)))) for i in range(25)] + [(99, docs[3][1])]
    return docs, items


def test_same_as_all_documents(spark, some, monkeypatch):
    docs, items = some
    assert got(spark, docs, items) == brute(docs, items)
    monkeypatch.setattr(lexical, "DOCS", 37)  # many shards
    monkeypatch.setattr(lexical, "GRAIN", 2)
    assert got(spark, docs, items, 7) == brute(docs, items, 7)


def test_blocks_of_items_and_all_terms(spark, some, monkeypatch):
    docs, items = some
    monkeypatch.setattr(lexical, "PAIRS", 50)
    monkeypatch.setattr(lexical, "VOCABULARY", 3)
    assert got(spark, docs, items, 5) == brute(docs, items, 5)


def test_odd_rows(spark):
    docs = [(1, None), (2, ""), (3, " ,;"), (4, "Äb ÄB äb aB Ab"), (4, "ab"), (None, "ab"), (None, "ab ab"), (7, "x" * 3_000_000), (8, "q " * 1_200_000 + "ab")]
    items = [(1, "AB"), (1, "äb"), (2, None), (3, "..."), (None, "Q"), (5, "ab ab ab"), (6, "x" * 3_000_000)]
    assert got(spark, docs, items) == brute(docs, items)
    assert got(spark, [], items) == [] and got(spark, docs, []) == [] and got(spark, [(1, None)], items) == []
    clash = spark.createDataFrame([(1, "ab", "x", 1)], "doc_id long, text string, Score string, terms int")
    assert lexical.search(clash, spark.createDataFrame([(1, "ab", "z")], ITEMS + ", rank string")).count() == 1


def test_block_bounds_are_the_best():
    rng = np.random.default_rng(3)
    scores = rng.integers(1, 1000, 23 * lexical.GRAIN + 5)
    starts = np.array([0, 10 * lexical.GRAIN + 3, 10 * lexical.GRAIN + 3, len(scores)])
    of, first, peak = lexical.block_bounds(scores, starts)
    for t in (0, 2):
        own = scores[starts[t] : starts[t + 1]]
        grains = [own[i : i + lexical.GRAIN] for i in range(0, len(own), lexical.GRAIN)]
        best = [0.0]
        for j in range(1, len(grains) + 1):
            last = [np.concatenate(grains[i:j]) for i in range(max(0, j - lexical.SPAN), j)]
            best.append(min(best[j - len(x) // lexical.GRAIN - bool(len(x) % lexical.GRAIN)] + len(x) * x.max() - x.sum() for x in last) + lexical.PRICE * own.max())
        mine = first[of == t] - starts[t]
        parts = np.split(own, mine[1:])
        assert mine[0] == 0 and [x.max() for x in parts] == peak[of == t].tolist()
        assert sum(len(x) * x.max() - x.sum() + lexical.PRICE * own.max() for x in parts) == best[-1]
    assert not (of == 1).any()


def test_query_same_as_sql(spark, data):
    assert_same(queries.op13_lexical_search(spark, f"{data}/sf0.01"), queries.OP13_SQL, f"{data}/sf0.01")
