from __future__ import annotations

import unicodedata
import zlib
from collections import Counter

import numpy as np
from eventloom.llm import language_id as L
from eventloom.llm.queries import op9_language_id


def brute_grams(text: str) -> Counter:
    out, word = Counter(), ""
    if not any(ch.isalpha() for ch in text.lower()):
        return out
    for ch in text.lower() + " ":
        if ch.isalpha() or unicodedata.category(ch) in ("Mn", "Mc"):
            word += ch
        elif word:
            out.update(word)
            padded = f" {word} "
            out.update(padded[i : i + 2] for i in range(len(padded) - 1))
            out.update(padded[i : i + 3] for i in range(len(padded) - 2))
            word = ""
    return out


def spelled(gram: int) -> str:
    return "".join(" " if c == 1 else chr(c - 2) for c in (gram >> 42 & 0x1FFFFF, gram >> 21 & 0x1FFFFF, gram & 0x1FFFFF) if c)


def code(g: str) -> int:
    n = 0
    for x in g:
        n = n << 21 | (1 if x == " " else ord(x) + 2)
    return n


HAN = "".join(chr(c) for c in range(0x4E00, 0x9FFF))


def test_grams_against_brute_force():
    texts = ["Hello, hello world!", "a", "", "x1y", "  été  ", "ab ab abc", "don't", "हिन्दी में", "ภาษาไทยที่", "한국어 글", "e\u0301te\u0301", "\u0301", "\U0001F600 \U00020000\U00020001", HAN, "İstanbul"]
    label, gram, n = L.gram_counts(texts, np.arange(len(texts)))
    for k, text in enumerate(texts):
        got = {spelled(int(g)): int(m) for g, m in zip(gram[label == k], n[label == k], strict=True)}
        assert got == brute_grams(text), text[:50]
    assert (np.diff(gram[label == 0]) > 0).all()
    label, gram, n = L.gram_counts(["ab", "c", "ab"], np.array([7, 3, 7]))
    assert {(int(k), spelled(int(g))): int(m) for k, g, m in zip(label, gram, n, strict=True)} == {(3, g): m for g, m in brute_grams("c").items()} | {(7, g): 2 * m for g, m in brute_grams("ab").items()}


def test_scripts_with_many_characters(spark):
    rows = [(1, "中文是一種語言 這是中文", "zh"), (2, "日本語の文章です これは日本語", "ja"), (3, "한국어 문장입니다 이것은 한국어", "ko"), (4, "हिन्दी एक भाषा है यह हिन्दी है", "hi"), (5, "ภาษาไทยเป็นภาษา นี่คือภาษาไทย", "th")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    asked = spark.createDataFrame([(1, "這是一種語言"), (2, "これは文章です"), (3, "이것은 문장입니다"), (4, "यह भाषा है"), (5, "นี่คือภาษา"), (6, "\u0301")], "doc_id long, text string")
    assert {r.doc_id: r.lang_pred for r in L.predict(asked, L.profiles(df)).collect()} == {1: "zh", 2: "ja", 3: "ko", 4: "hi", 5: "th", 6: "und"}


def test_query_held_out(spark, data):
    docs = {d.doc_id: d for d in spark.read.parquet(f"{data}/sf0.01/documents.parquet").collect()}
    rows = op9_language_id(spark, f"{data}/sf0.01").collect()
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    right = total = 0
    for r in rows:
        d = docs[r.doc_id]
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
        assert 0 <= r.score <= 1
        letters = any(c.isalpha() for c in d.text or "")
        assert (r.lang_pred == "und") == (not letters)
        if r.held_out and letters and d.lang:
            right, total = right + (r.lang_pred == d.lang), total + 1
    assert total > 200 and right / total > 0.95


def test_out_of_place_distance_by_hand():
    profile = [("aa", g, k) for k, g in enumerate(sorted(brute_grams("banana").items(), key=lambda x: (-x[1], code(x[0]))))]
    rows = [("aa", code(g), k) for _, (g, _), k in profile]
    near = L.Nearest(rows, 50)
    lang, score = near.predict(["banana", "123", ""])
    assert lang == ["aa", "und", "und"] and score[1] == score[2] == 0
    own = sorted(((-n, code(g)) for g, n in brute_grams("banana").items()))
    at = {g: k for _, g, k in rows}
    want = 1 - sum(abs(at[g] - k) for k, (_, g) in enumerate(own)) / (len(own) * 50)
    assert np.isclose(score[0], want)


def test_odd_tables(spark):
    rows = [(1, "the cat and the dog", "en"), (2, "der hund und die katze", "de"), (3, None, "en"), (4, "", None), (5, "123 !!", "de"), (None, "the the the", None), (7, "und die " * 60_000, None), (1, "the cat and the dog", "en")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "5 AS score", "'q' AS lang_pred")
    profile = L.profiles(df)
    assert {r[0] for r in profile} == {"en", "de"}
    out = L.predict(df, profile)
    assert out.columns == ["doc_id", "text", "lang", "lang_pred", "score"]
    got = {r.doc_id: r.lang_pred for r in out.collect()}
    assert got == {1: "en", 2: "de", 3: "und", 4: "und", 5: "und", None: "en", 7: "de"}
    assert out.count() == len(rows)
    assert [r.lang_pred for r in L.predict(df.limit(1), []).collect()] == ["und"]
    assert L.predict(df.limit(0), profile).count() == 0 and L.profiles(df.limit(0)) == []
    tie = [("xx", g, k) for _, g, k in profile if _ == "en"] + [("aa", g, k) for _, g, k in profile if _ == "en"]
    assert L.predict(df.limit(1), tie).first().lang_pred == "aa"


def test_case_variants_of_added_columns(spark):
    docs = spark.createDataFrame([(1, "the cat", "en", 7, "x")], "doc_id long, text string, lang string, Lang_Pred int, SCORE string")
    out = L.predict(docs, L.profiles(docs))
    assert out.columns == ["doc_id", "text", "lang", "lang_pred", "score"]
    assert out.select("lang_pred", "score").first().lang_pred == "en"
