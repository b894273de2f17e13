from __future__ import annotations

import random
import re
from collections import defaultdict

import pytest
from eventloom.llm import jaccard_join as J
from eventloom.llm.queries import op6_jaccard_join


def shingles(text: str | None, words: int) -> set:
    own = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return set() if not own else {tuple(own[i : i + words]) for i in range(max(1, len(own) - words + 1))}


def brute(docs, words, percent):
    sets = [(i, shingles(t, words)) for i, t in docs]
    parent = list(range(len(sets)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    lists = defaultdict(list)
    for k, (_, s) in enumerate(sets):
        for x in s:
            lists[x].append(k)
    shared = defaultdict(int)
    for own in lists.values():
        for n, a in enumerate(own):
            for b in own[n + 1 :]:
                shared[a, b] += 1
    for (a, b), n in shared.items():
        if 100 * n >= percent * (len(sets[a][1]) + len(sets[b][1]) - n):
            parent[max(root(a), root(b))] = min(root(a), root(b))
    least = {}
    for k, (i, _) in enumerate(sets):
        r = root(k)
        if i is not None:
            least[r] = min(least.get(r, i), i)
    return sorted((repr(i), len(s), repr(least.get(root(k), i))) for k, (i, s) in enumerate(sets))


def got(df, words, percent):
    return sorted((repr(r.doc_id), r.n_shingles, repr(r.component_id)) for r in J.component_ids(df, words, percent).collect())


def near(r, base, change):
    out = list(base)
    for _ in range(change):
        out[r.randrange(len(out))] = f"n{r.randrange(10**6)}"
    return out


def planted(n, seed):
    r = random.Random(seed)
    passage = [f"p{k}" for k in range(60)]
    docs = []
    for g in range(n):
        base = [f"w{r.randrange(3000)}" for _ in range(r.randint(3, 150))]
        if g % 3 == 0:
            base = base + passage
        for _ in range(r.choice([1, 1, 2, 5])):
            docs.append(" ".join(near(r, base, r.choice([0, 0, 1, 2, 3]))))
        if g % 5 == 0:
            docs.append(" ".join(base + base[: len(base) // 8]))
    r.shuffle(docs)
    return [(k, t) for k, t in enumerate(docs)]


@pytest.mark.parametrize(("words", "percent", "seed"), [(4, 85, 1), (5, 80, 2), (1, 60, 3)])
def test_against_brute_force(spark, words, percent, seed):
    docs = planted(60, seed)
    docs += [(1000, None), (1001, ""), (1002, " \t\n"), (1003, "one"), (1004, "ONE"), (1005, "one two"), (1006, "one\ttwo"), (5, docs[5][1]), (None, docs[7][1]), (None, None), (1007, "É é"), (1008, "é é"), (1009, "one two three"), (1010, "long " * 30_000)]
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS n", "2 AS id", "3 AS root")
    assert got(df, words, percent) == brute(docs, words, percent)


def test_small_limits_give_the_same(spark, monkeypatch):
    docs = planted(50, 9)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    want = brute(docs, 4, 85)
    for name, n in (("LIST_BLOCK", 3), ("LONG", 2), ("TASK_TOKENS", 300), ("TASK_BYTES", 200), ("FINE_FROM", 20), ("HEAVY", 20), ("LEAST", 2), ("PAIRS_AT_ONCE", 10)):
        monkeypatch.setattr(J, name, n)
    assert got(df, 4, 85) == want


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert J.component_ids(df).count() == 0
    assert J.deduplicated(df).count() == 0


def test_deduplicated(spark):
    docs = planted(30, 4)
    rows = [*docs, (500, None), (500, None), (501, ""), (docs[0][0], docs[0][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "'x' AS lead")
    kept = J.deduplicated(df, 5, 80)
    assert kept.columns == df.columns
    comp = {a: c for a, _, c in brute(docs, 5, 80)}
    want = sorted(comp[a] for a in comp if comp[a] == a) + ["500", "500", "501"]
    assert sorted(repr(r.doc_id) for r in kept.collect()) == sorted(want)


def test_deduplicated_by_row(spark):
    text = lambda c, n=60: " ".join(f"{c}{k}" for k in range(n))
    near = text("a", 59) + " other"
    rows = [(1, text("a")), (None, near), (None, text("b")), (None, text("b")), (None, text("c")), (2, text("d")), (2, text("e")), (3, text("f")), (3, near), (4, text("e") + " more"), (None, None), (None, "")]
    kept = J.deduplicated(spark.createDataFrame(rows, "doc_id long, text string"), 5, 80).collect()
    want = [(1, text("a")), (None, text("b")), (None, text("c")), (2, text("d")), (2, text("e")), (3, text("f")), (None, None), (None, "")]
    assert sorted(map(repr, map(tuple, kept))) == sorted(map(repr, want))


def test_query(spark, data):
    docs = [(d.doc_id, d.text) for d in spark.read.parquet(f"{data}/sf0.001/documents.parquet").collect()]
    rows = op6_jaccard_join(spark, f"{data}/sf0.001").collect()
    assert sorted((repr(r.doc_id), r.n_shingles, repr(r.component_id)) for r in rows) == brute(docs, 4, 85)


def test_candidates_of_a_large_group_of_near_copies(spark, monkeypatch):
    r = random.Random(8)
    base = [f"w{k}" for k in range(120)]
    docs = [(k, " ".join(near(r, base, r.choice([0, 1, 1, 2])))) for k in range(700)] + [(1000 + k, " ".join(near(r, base, 40))) for k in range(30)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    monkeypatch.setattr(J, "LIST_BLOCK", 150)
    monkeypatch.setattr(J, "TASK_TOKENS", 20_000)
    seen, sifted = [], J._sifted

    def counted(groups, pairs, label, percent):
        seen.append(pairs.selectExpr("sum(size(partners))").first()[0])
        return sifted(groups, pairs, label, percent)

    monkeypatch.setattr(J, "_sifted", counted)
    assert got(df, 4, 85) == brute(docs, 4, 85)
    assert seen[0] < 40 * len(docs)  # all pairs would be some 245,000


def test_more_wanted_texts_than_the_filter_has_bits_for(spark, monkeypatch):
    docs = planted(40, 11)
    monkeypatch.setattr(J, "FILTER_BITS", (64, 128))
    assert got(spark.createDataFrame(docs, "doc_id long, text string"), 4, 85) == brute(docs, 4, 85)
    monkeypatch.setattr(J, "FILTER_BITS", (64, 1 << 20))
    assert got(spark.createDataFrame(docs, "doc_id long, text string"), 4, 85) == brute(docs, 4, 85)


def test_tables_on_the_way_are_deleted(spark):
    import os

    from eventloom.llm.scratch import shared_dir

    folder = shared_dir(spark).removeprefix("file://")
    before = set(os.listdir(folder))
    J.component_ids(spark.createDataFrame(planted(10, 12), "doc_id long, text string")).count()
    assert [n.split("-")[2] for n in set(os.listdir(folder)) - before] in (["least", "roots"], ["roots", "least"])
