from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

import corpus_pipeline as P
import numpy as np
import pytest
import sentencepiece
from eventloom.llm import language_id, queries
from oracle import assert_same
from test_jaccard_join import brute
from test_mixing import shares


def test_whole_run_stage_by_stage(spark, data):
    d = f"{data}/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    rows, tables = docs, [docs.collect()]
    for _, stage in P.STAGES:
        rows = stage(spark, rows, d)
        tables.append(rows.collect())
        if stage is not P.tokenize:
            assert rows.columns == docs.columns
            rows = spark.createDataFrame(tables[-1], docs.schema)
    given, known, apart, mixed, tokens = tables
    # language ID: by the nearest profile of those learned here
    near = language_id.Nearest(language_id.profiles(docs.where(~language_id.held_out())), language_id.PROFILE)
    want = {}
    for r in given:
        lang, score = near.predict([r.text or ""])
        if lang[0] != "und" and score[0] >= P.LEAST_SCORE:
            want[r.doc_id] = r.lang or lang[0]
    assert {r.doc_id: r.lang for r in known} == want
    clean = [r for r in given if r.lang and any(c.isalpha() for c in r.text or "") and len(r.text) > 200]
    assert len({r.doc_id for r in clean} & set(want)) >= 0.98 * len(clean)
    # near copies: one of each component
    comp = {a: c for a, _, c in brute([(r.doc_id, r.text) for r in known], 5, 80)}
    assert sorted(repr(r.doc_id) for r in apart) == sorted(set(comp.values()))
    # the mix: words near the targets, nothing over twice
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sums, took = defaultdict(int), defaultdict(int)
    for r in apart:
        sums[r.source] += words(r.text)
    for r in mixed:
        took[r.source] += words(r.text)
    assert max(Counter(r.doc_id for r in mixed).values()) <= 2
    for s, goal in shares(dict(sums)).items():
        passes = int(goal // sums[s]) if sums[s] else 0
        reach, budget = 1, round(goal - passes * sums[s])
        for r in apart:
            if r.source == s:
                reach |= reach << words(r.text)
        assert took[s] == passes * sums[s] + (reach & (1 << budget + 1) - 1).bit_length() - 1  # no choice comes nearer from below
    # tokens
    sp = sentencepiece.SentencePieceProcessor(model_file=queries.tokenizer_path())
    ids = [(r.doc_id, np.array(sp.encode(r.text, add_bos=True, add_eos=True), "<u4").tobytes()) for r in mixed]
    assert sorted((r.doc_id, bytes(r.ids)) for r in tokens) == sorted(ids)
    assert all(r.ids_sha256 == hashlib.sha256(bytes(r.ids)).hexdigest() for r in tokens)


ODD = [(1, None, None, None, None), (2, "", "en", "s", 0), (3, "the cat sat on the mat and the dog ran", None, None, 38), (3, "the cat sat on the mat and the dog ran", None, None, 38), (None, "the cat sat on the mat and the dog", "en", "s", 30), (4, "der hund und die katze laufen durch das haus " * 3000, "de", "t", 9), (5, "123", "en", "s", 3)]


def test_odd_rows_pass_all_stages(spark):
    rows = spark.createDataFrame(ODD, "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in P.STAGES:
        rows = spark.createDataFrame(out, rows.schema) if (out := stage(spark, rows, "").collect()) and stage is not P.tokenize else stage(spark, rows, "")
    assert rows.count() > 0
    empty = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in P.STAGES:
        out = stage(spark, empty, "")
        assert out.count() == 0


def test_users_columns_stay(spark):
    """Columns called like those that stages compute come out as they went in."""
    names = ["size", "Target", "taken", "copies", "source_size", "lang_pred__", "lang_pred", "score__", "SCORE", "mix_copy__", "gid", "node", "n_shingles"]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{n} string" for n in names)
    rows = [(k, f"the {k} cat sat on the mat and the {k} dog ran all over the house " * 3, ("en", None)[k % 2], "s", 9, *(f"{n} {k}" for n in names)) for k in range(12)]
    docs = spark.createDataFrame(rows, schema)
    for _, stage in P.STAGES[:-1]:
        docs = stage(spark, docs, "")
        assert docs.columns == spark.createDataFrame([], schema).columns
    got = {r.doc_id: r for r in docs.collect()}
    assert got
    for k, r in got.items():
        assert tuple(r) == (*rows[k][:2], "en", *rows[k][3:])
    assert P.tokenize(spark, docs, "").count() > 0


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_sql_gives_the_same(spark, data, name):
    assert_same(queries.QUERIES[name](spark, f"{data}/sf0.01"), queries.ORACLES[name], f"{data}/sf0.01")
