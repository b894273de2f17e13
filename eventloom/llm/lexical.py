"""Ranked lexical search: variable-block-max search over the shards of an inverted index.

The index is made where the documents are read: each task cuts its documents into
shards of DOCS documents or POSTINGS postings at most, and writes for each shard the
documents' lengths and, term by term, a posting list (place of the document, count).
No row is shuffled for it. Where the items have at most VOCABULARY different terms,
only those are indexed; beyond that, all terms are.

N, L and df are sums over all shards. A search task then goes through its shards. In
each, a posting's score is known, and dynamic programming cuts every list into blocks
of varying length: it minimises what the blocks' maxima exceed their postings' scores
by, summed over postings, plus PRICE list maxima for each block. The starts of an
item's blocks divide the shard into stretches of documents, and the maxima of the
blocks over a stretch sum to what a document there can reach. Stretches are taken by
descending bound, and those that can't reach the item's k-th best score so far are
skipped; that score is carried from shard to shard. So the result is exact. Of each
task the k best of an item are merged at last. Items are searched in blocks of about
PAIRS pairs of item and term, each sent to all tasks.

Values: null texts and texts without a term aren't counted and never found. A null
doc_id is returned as null, after others of equal score; rows that repeat a doc_id are
documents each. Texts of items with one item_id (null too) are one item; an item
without terms returns nothing. Very long texts are cut into terms slice by slice.
Empty tables give an empty result. Other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import math
import re
from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import temporary, written

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
BREAK = re.compile(r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
#: Characters of a text that become terms at a time.
SLICE = 1_000_000
DOCS, POSTINGS = 32_768, 4_000_000
#: Different terms, and their characters, that are sent to the indexing tasks at most.
VOCABULARY, VOCABULARY_CHARS = 1 << 20, 1 << 25
#: Pairs of item and term in a block of items, about.
PAIRS = 1 << 18
#: Block bounds lie at multiples of GRAIN postings; a block has SPAN times as many at most, and costs PRICE times its list's maximum.
GRAIN, SPAN, PRICE = 16, 24, 8
INDEX = "ids binary, unnamed binary, lengths binary, terms array<string>, held array<int>, docs binary, counts binary"


def term_counts(text: str) -> Counter:
    """How often each term occurs in a text."""
    raw: Counter = Counter()
    at = 0
    while at < len(text):
        to = at + SLICE
        if to < len(text):
            m = BREAK.search(text, to)
            to = m.start() if m else len(text)
        raw.update(TERM.findall(text[at:to] if at or to < len(text) else text))
        at = to
    out: Counter = Counter()
    for t, n in raw.items():
        out[t.lower() if t.isascii() else t.translate(LOWER)] += n
    return out


class _Shard:
    """Documents that a task has read since its last shard."""

    def __init__(self) -> None:
        self.ids: list[int | None] = []
        self.lengths = array("q")
        self.slots: dict[str, int] = {}
        self.terms, self.docs, self.counts = array("i"), array("i"), array("q")

    def add(self, doc_id: int | None, counts: Counter, wanted: frozenset | None) -> None:
        at, slots = len(self.ids), self.slots
        self.ids.append(doc_id)
        self.lengths.append(sum(counts.values()))
        for t in counts if wanted is None else counts.keys() & wanted:
            self.terms.append(slots.setdefault(t, len(slots)))
            self.docs.append(at)
            self.counts.append(counts[t])

    def full(self) -> bool:
        return len(self.ids) >= DOCS or len(self.docs) >= POSTINGS

    def batch(self) -> pa.RecordBatch:
        terms = np.frombuffer(self.terms, np.int32) if self.terms else np.zeros(0, np.int32)
        order = np.argsort(terms, kind="stable")
        docs = np.array(self.docs, np.int32)[order]
        counts = np.array(self.counts, np.int64)[order]
        unnamed = np.array([x is None for x in self.ids], bool)
        ids = np.array([0 if x is None else x for x in self.ids], np.int64)
        held = np.bincount(terms, minlength=len(self.slots)).astype(np.int32)
        binary = lambda x: pa.array([x.tobytes()], pa.binary())
        columns = [
            binary(ids), binary(unnamed), pa.array([self.lengths.tobytes()], pa.binary()), pa.array([list(self.slots)], pa.list_(pa.string())),
            pa.array([held.tolist()], pa.list_(pa.int32())), binary(docs), binary(counts),
        ]
        return pa.RecordBatch.from_arrays(columns, ["ids", "unnamed", "lengths", "terms", "held", "docs", "counts"])


def index(docs: DataFrame, wanted: frozenset | None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row a shard; no rows move."""
    share = docs.sparkSession.sparkContext.broadcast(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = _Shard()
        for b in batches:
            for i, t in zip(b.column(0), b.column(1), strict=True):
                counts = term_counts(t.as_py() or "")
                if counts:
                    shard.add(i.as_py(), counts, share.value)
                if shard.full():
                    yield shard.batch()
                    shard = _Shard()
        if shard.ids:
            yield shard.batch()

    return docs.select(F.col(doc_id).cast("long").alias("i"), F.col(text).alias("t")).mapInArrow(run, INDEX)


def block_bounds(scores: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(list, first posting, maximum) of each block of all lists; list t is scores[starts[t]:starts[t + 1]].

    best[j], the least cost of a list's first j grains, is the minimum over the last
    block's length; all lists of like length take a step at once.
    """
    sizes = np.diff(starts)
    found = []
    order = np.argsort(-sizes, kind="stable")
    order = order[sizes[order] > 0]
    at = 0
    while at < len(order):
        longest = -(-int(sizes[order[at]]) // GRAIN)
        some = order[at : at + max(1, 2_000_000 // longest)]
        at += len(some)
        grains = -(-sizes[some] // GRAIN)
        top, mass, held = (np.zeros((len(some), longest), np.int64) for _ in range(3))
        for row, t in enumerate(some):
            s = scores[starts[t] : starts[t + 1]]
            cuts = np.arange(0, len(s), GRAIN)
            n = len(cuts)
            top[row, :n] = np.maximum.reduceat(s, cuts)
            mass[row, :n] = np.add.reduceat(s, cuts)
            held[row, :n] = np.diff(np.r_[cuts, len(s)])
        price = PRICE * top.max(axis=1)
        best = np.zeros((longest + 1, len(some)), np.float64)
        back = np.ones((longest + 1, len(some)), np.int64)
        live = np.searchsorted(-grains, -np.arange(longest + 1), side="right")  # lists with so many grains come first
        for j in range(1, longest + 1):
            r = live[j]
            peak, total, count = np.zeros(r, np.int64), np.zeros(r, np.int64), np.zeros(r, np.int64)
            least = np.full(r, np.inf)
            for s in range(1, min(SPAN, j) + 1):
                g = j - s
                np.maximum(peak, top[:r, g], out=peak)
                total += mass[:r, g]
                count += held[:r, g]
                cost = best[g, :r] + (count * peak - total)
                better = cost < least
                least[better] = cost[better]
                back[j, :r][better] = s
            best[j, :r] = least + price[:r]
        for row, t in enumerate(some):
            j, firsts = int(grains[row]), []
            while j:
                j -= int(back[j, row])
                firsts.append(j)
            firsts = np.array(firsts[::-1])
            found.append((np.full(len(firsts), t), starts[t] + firsts * GRAIN, np.maximum.reduceat(top[row, : grains[row]], firsts)))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def weight(n: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1)))


class Searched:
    """A shard with the scores of its postings and the blocks of its lists."""

    def __init__(self, row: dict, weights: dict[str, int], n: int, total: int):
        self.ids, self.unnamed = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["unnamed"], bool)
        lengths = np.frombuffer(row["lengths"], np.int64)
        docs, counts = np.frombuffer(row["docs"], np.int32), np.frombuffer(row["counts"], np.int64)
        starts = np.r_[0, np.cumsum(np.array(row["held"], np.int64))]
        asked = [(t, k) for k, t in enumerate(row["terms"]) if t in weights]
        self.slot = {t: j for j, (t, _) in enumerate(asked)}
        pick = np.concatenate([np.arange(starts[k], starts[k + 1]) for _, k in asked]) if asked else np.zeros(0, np.int64)
        self.docs, counts = docs[pick], counts[pick]
        sizes = np.array([starts[k + 1] - starts[k] for _, k in asked], np.int64)
        self.starts = np.r_[0, np.cumsum(sizes)].astype(np.int64)
        m = 50 + (50 * lengths * n) // total
        w = np.repeat(np.array([weights[t] for t, _ in asked], np.int64), sizes)
        self.scores = w * ((1_000_000_000 * counts) // (1000 * counts + 20 * m[self.docs]))
        of, first, peak = block_bounds(self.scores, self.starts)
        order = np.argsort(first, kind="stable")
        first, self.peak = first[order], peak[order]
        self.block_doc = self.docs[first]
        self.blocks = np.searchsorted(of[order], np.arange(len(asked) + 1))

    def best(self, terms: list[str], top: tuple[np.ndarray, np.ndarray, np.ndarray], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``top`` (scores, unnamed, ids) brought up to date with the shard's documents."""
        slots = [self.slot[t] for t in terms if t in self.slot]
        if not slots:
            return top
        spans = [slice(self.blocks[s], self.blocks[s + 1]) for s in slots]
        cuts = np.unique(np.concatenate([self.block_doc[x] for x in spans]))
        bound = np.zeros(len(cuts), np.int64)
        for x in spans:
            own = np.searchsorted(self.block_doc[x], cuts, side="right")
            bound += np.r_[0, self.peak[x]][own]
        ends = np.r_[cuts[1:], len(self.ids)].astype(cuts.dtype)
        order = np.argsort(-bound, kind="stable")
        acc = np.zeros(len(self.ids), np.int64)
        at, step = 0, 4 * k
        while at < len(order):
            least = top[0][-1] if len(top[0]) == k else 1
            sizes = np.cumsum(ends[order[at:]] - cuts[order[at:]])
            some = order[at : at + int(np.searchsorted(sizes, step)) + 1]
            at += len(some)
            some = np.sort(some[bound[some] >= least])  # an equal score may still win by its id
            if not len(some):
                break
            for s in slots:
                lo, hi = self.starts[s], self.starts[s + 1]
                a, b = (np.searchsorted(self.docs[lo:hi], x[some]) for x in (cuts, ends))
                p = lo + _ranges(a, b)
                acc[self.docs[p]] += self.scores[p]
            docs = _ranges(cuts[some].astype(np.int64), ends[some].astype(np.int64))
            docs = docs[acc[docs] >= least]
            top = best_of(tuple(np.concatenate(x) for x in zip(top, (acc[docs], self.unnamed[docs], self.ids[docs]), strict=True)), k)
            step *= 4
        return top


def _ranges(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All whole numbers from a[i] to b[i] - 1."""
    n = b - a
    return np.repeat(a - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(int(n.sum()))


def best_of(rows: tuple[np.ndarray, np.ndarray, np.ndarray], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.lexsort((rows[2], rows[1], -rows[0]))[:k]
    return rows[0][order], rows[1][order], rows[2][order]


def item_terms(items: DataFrame, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """(item_id, term), each once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, t in zip(b.column(0), b.column(1), strict=True):
                terms = list(term_counts(t.as_py() or ""))
                if terms:
                    yield pa.RecordBatch.from_arrays([pa.array([i.as_py()] * len(terms), pa.int64()), pa.array(terms, pa.string())], ["item_id", "term"])

    return items.select(F.col(item_id).cast("long"), text).mapInArrow(run, "item_id long, term string").distinct()


def search(docs: DataFrame, items: DataFrame, k: int = 50) -> DataFrame:
    """(item_id, rank, doc_id, score). The result is a written table; those on the way are deleted."""
    with temporary():
        return written(_searched(docs, items, k), "lexical-found", keep=True)


def _searched(docs: DataFrame, items: DataFrame, k: int) -> DataFrame:
    spark = docs.sparkSession
    asked = written(item_terms(items), "lexical-items")
    vocabulary = asked.select("term").distinct()
    terms, chars = vocabulary.agg(F.count("*"), F.coalesce(F.sum(F.length("term")), F.lit(0))).first()
    few = terms <= VOCABULARY and chars <= VOCABULARY_CHARS
    shards = written(index(docs, frozenset(r.term for r in vocabulary.collect()) if few else None), "lexical-index")
    sums = shards.select("lengths").mapInArrow(_sums, "n long, total long").agg(F.sum("n"), F.sum("total")).first()
    n, total = (x or 0 for x in sums)
    empty = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    if not n or not terms:
        return empty
    pairs = F.explode(F.arrays_zip("terms", "held")).alias("x")
    df = shards.select(pairs).groupBy(F.col("x.terms").alias("term")).agg(F.sum("x.held").alias("df"))
    df = written(df.join(vocabulary, "term", "left_semi"), "lexical-df")
    blocks = -(-asked.count() // PAIRS)
    part = F.pmod(F.xxhash64("item_id"), F.lit(blocks))
    found = empty.drop("rank")
    for j in range(blocks):
        rows = asked.where(part == j).join(df, "term").collect()  # PAIRS rows, about
        found = found.unionByName(_block(shards, rows, n, total, k))
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        got = [np.frombuffer(x.as_py(), np.int64) for x in b.column("lengths")]
        yield pa.RecordBatch.from_arrays([pa.array([len(x) for x in got], pa.int64()), pa.array([int(x.sum()) for x in got], pa.int64())], ["n", "total"])


def _block(shards: DataFrame, rows: list, n: int, total: int, k: int) -> DataFrame:
    """The k best of each task for a block of items."""
    weights = {r.term: weight(n, r.df) for r in rows}
    asked: dict[int | None, list[str]] = {}
    for r in sorted(rows, key=lambda r: r.term):
        asked.setdefault(r.item_id, []).append(r.term)
    share = shards.sparkSession.sparkContext.broadcast((weights, asked))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, asked = share.value
        none = (np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64))
        best = dict.fromkeys(asked, none)
        for b in batches:
            for at in range(b.num_rows):
                shard = Searched(b.slice(at, 1).to_pylist()[0], weights, n, total)
                for item, terms in asked.items():
                    best[item] = shard.best(terms, best[item], k)
        for item, (score, unnamed, ids) in best.items():
            if len(score):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([item] * len(score), pa.int64()), pa.array(ids, pa.int64(), mask=unnamed), pa.array(score, pa.int64())],
                    ["item_id", "doc_id", "score"],
                )

    return shards.mapInArrow(run, "item_id long, doc_id long, score long")
