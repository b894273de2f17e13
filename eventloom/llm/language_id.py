"""Language identification by rank-order profiles of character n-grams.

Words are runs of letters and of the marks that combine with them. The most
frequent n-grams (one to three characters of a word, padded with a space) of a
document, in order of frequency, are held against each language's profile:
every n-gram adds the distance between its two ranks, one that the profile
lacks adds the profile's size ("out of place"), and the nearest profile wins.

Profiles are counted over all training documents: each task sums the n-grams
of its texts by language, Spark adds up the sums, and the most frequent stay.
What reaches the driver is PROFILE rows a language.

Values: ``und`` with score 0 for a text that is null or has no letter; ties go
to the language whose code comes first; n-grams of equal count are ordered by
length, then by their code points. Whole texts are read. Training rows with a null language or
null text teach nothing; without any profile every text is ``und``. Other
columns go through unchanged; the added columns replace columns of the same name.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: n-grams in a language's profile, and taken of a document.
PROFILE = 600
UNDETERMINED = "und"
#: Characters and texts that are worked on at once (one longer text is worked on alone).
CHUNK_CHARS, CHUNK_TEXTS = 400_000, 511
#: Distinct (language, n-gram) pairs that a task sums before it hands them on.
TASK_SUMS = 600_000
#: An n-gram is three symbols of 21 bits: none (0), the space (1), or a code point and 2.
SYMBOL_BITS, SPACE_SYMBOL = 21, 1
_SYMBOLS: list[tuple[np.ndarray, np.ndarray]] = []


def symbols() -> tuple[np.ndarray, np.ndarray]:
    """The symbol of each code point (the space's for what belongs to no word), and which code points are letters."""
    if not _SYMBOLS:
        letter = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
        mark = np.fromiter((unicodedata.category(chr(c)) in ("Mn", "Mc") for c in range(0x110000)), bool, 0x110000)
        table = np.arange(2, 0x110002, dtype=np.int32)
        table[~(letter | mark)] = SPACE_SYMBOL
        _SYMBOLS.append((table, letter))
    return _SYMBOLS[0]


def gram_counts(texts: list[str], labels: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(label, n-gram, count), by label and n-gram; texts of one label count together.

    A text that has no letter has no n-gram. The symbols of a chunk are numbered
    without gaps, in their order, so that a label and three of them fit one number.
    """
    table, letter = symbols()
    lowered = [" " + t.lower() + " " for t in texts]
    sizes = np.fromiter(map(len, lowered), np.int64, len(lowered))
    points = np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), np.uint32)
    some = np.add.reduceat(letter[points], np.cumsum(sizes) - sizes, dtype=np.int64) > 0 if len(texts) else np.zeros(0, bool)
    c = table[points]
    present = np.zeros(len(table) + 2, bool)
    present[c] = True
    present[:2] = True
    known = np.flatnonzero(present)
    bits = int(len(known)).bit_length()
    names, label = np.unique(labels, return_inverse=True)
    if 3 * bits + int(len(names)).bit_length() > 63:
        raise ValueError("too many labels at once")
    number = np.cumsum(present) - 1
    c = number[c]
    owner = np.repeat(label.astype(np.int64) << 3 * bits, sizes)
    keep = np.ones(len(c), bool)
    keep[1:] = (c[1:] > 1) | (c[:-1] > 1)  # runs of other characters count as one space
    keep[np.cumsum(sizes) - sizes] = True
    keep &= np.repeat(some, sizes)
    c, owner, text = c[keep], owner[keep], np.repeat(np.arange(len(texts), dtype=np.int32), sizes)[keep]
    a, b = c[:-1], c[1:]
    one = (owner | c)[c > 1]
    two = (owner[:-1] | a << bits | b)[(text[:-1] == text[1:]) & ((a > 1) | (b > 1))]
    a, b, d = c[:-2], c[1:-1], c[2:]
    three = (owner[:-2] | a << 2 * bits | b << bits | d)[(text[:-2] == text[2:]) & (b > 1)]
    keys, n = _counted(np.concatenate([one, two, three]))
    mask = (1 << bits) - 1
    gram = known[keys >> 2 * bits & mask] << 2 * SYMBOL_BITS | known[keys >> bits & mask] << SYMBOL_BITS | known[keys & mask]
    return names[keys >> 3 * bits], gram, n


def _counted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keys = np.sort(keys)
    at = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    return keys[at], np.diff(np.r_[at, len(keys)])


def chunks(texts: list[str]) -> Iterator[slice]:
    at = size = 0
    for k, t in enumerate(texts):
        size += len(t)
        if size >= CHUNK_CHARS or k - at >= CHUNK_TEXTS - 1:
            yield slice(at, k + 1)
            at, size = k + 1, 0
    if at < len(texts):
        yield slice(at, len(texts))


def profiles(train: DataFrame, text: str = "text", lang: str = "lang", size: int = PROFILE) -> list[tuple[str, int, int]]:
    """(language, n-gram, rank) of each language's ``size`` most frequent n-grams."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}
        none = np.zeros(0, np.int64)
        held, fresh = (none, none, none), []

        def merged() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            label, gram, n = (np.concatenate(x) for x in zip(held, *fresh, strict=True))
            order = np.lexsort((gram, label))
            label, gram, n = label[order], gram[order], n[order]
            at = np.flatnonzero(np.r_[True, (gram[1:] != gram[:-1]) | (label[1:] != label[:-1])]) if len(gram) else none
            return label[at], gram[at], np.add.reduceat(n, at) if len(at) else n

        def out() -> pa.RecordBatch:
            names = np.array([*known, ""], object)
            return pa.RecordBatch.from_arrays([pa.array(names[held[0]], pa.string()), pa.array(held[1]), pa.array(held[2])], ["lang", "gram", "n"])

        for batch in batches:
            texts, langs = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for s in chunks(texts):
                labels = np.array([known.setdefault(x, len(known)) for x in langs[s]], np.int64)
                fresh.append(gram_counts(texts[s], labels))
                if sum(len(x[1]) for x in fresh) > TASK_SUMS // 4:
                    held, fresh = merged(), []
                    if len(held[1]) > TASK_SUMS:
                        yield out()
                        held = (none, none, none)
        if fresh:
            held = merged()
        if len(held[1]):
            yield out()

    rows = train.select(F.col(text).alias("text"), F.col(lang).alias("lang")).where("text is not null and lang is not null")
    summed = rows.mapInArrow(sums, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    top = summed.withColumn("rank", rank).where(F.col("rank") <= size)
    return [(r.lang, r.gram, r.rank - 1) for r in top.select("lang", "gram", "rank").collect()]


class Nearest:
    def __init__(self, rows: list[tuple[str, int, int]], size: int):
        self.size = size
        self.langs = sorted({r[0] for r in rows})
        at = {x: k for k, x in enumerate(self.langs)}
        self.grams = np.unique(np.array([r[1] for r in rows], np.int64))
        self.ranks = np.full((len(self.grams) + 1, len(self.langs)), -1, np.int32)
        for lang, gram, rank in rows:
            self.ranks[np.searchsorted(self.grams, gram), at[lang]] = rank

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        n = len(texts)
        lang, score = [UNDETERMINED] * n, np.zeros(n)
        if not self.langs:
            return lang, score
        doc, keys, counts = gram_counts(texts, np.arange(n))
        if not len(keys):
            return lang, score
        first = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
        local = np.arange(len(keys)) - np.repeat(first, np.diff(np.r_[first, len(keys)]))
        if local.max() < 1 << 21 and counts.max() < 1 << 22 and n < 1 << 20:  # the order (document, falling count, n-gram) in one number
            order = np.sort(doc << 43 | ((1 << 22) - counts) << 21 | local)
            order = (order & (1 << 21) - 1) + np.repeat(first, np.diff(np.r_[first, len(keys)]))
        else:
            order = np.lexsort((local, -counts, doc))
        rank = local  # of the n-th in that order, as each document's rows stay in their place
        top = rank < self.size
        own, rank, key = doc[top], rank[top], keys[order[top]]
        at = np.searchsorted(self.grams, key)
        at[(at == len(self.grams)) | (self.grams[np.minimum(at, len(self.grams) - 1)] != key)] = len(self.grams)
        theirs = self.ranks[at]
        away = np.where(theirs < 0, self.size, np.abs(theirs - rank[:, None]))
        begin = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
        total = np.add.reduceat(away, begin, axis=0)
        best = total.argmin(axis=1)
        most = np.diff(np.r_[begin, len(own)]) * self.size
        who = own[begin]
        score[who] = 1 - total[np.arange(len(who)), best] / most
        for k, b in zip(who.tolist(), best.tolist(), strict=True):
            lang[k] = self.langs[b]
        return lang, score


def predict(df: DataFrame, rows: list[tuple[str, int, int]], text: str = "text", size: int = PROFILE, lang_out: str = "lang_pred", score_out: str = "score") -> DataFrame:
    """Adds the predicted language and a score from 0 (nothing in place) to 1 (the profile's own order)."""
    schema = T.StructType([f for f in df.schema if f.name.lower() not in (lang_out.lower(), score_out.lower())] + [T.StructField(lang_out, T.StringType()), T.StructField(score_out, T.DoubleType())])
    names = [f.name for f in schema][:-2]
    shared = df.sparkSession.sparkContext.broadcast(Nearest(rows, size))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(text).to_pylist()]
            for s in chunks(texts):
                lang, score = shared.value.predict(texts[s])
                part = batch.slice(s.start, s.stop - s.start)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), pa.array(lang, pa.string()), pa.array(score, pa.float64())], [*names, lang_out, score_out])

    return df.mapInArrow(run, schema)


def held_out(doc_id: str = "doc_id"):
    """True for documents kept from training: crc32 of the id as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))
