"""Exact Jaccard self-join of documents on word shingles: a grouped prefix join.

1. Frequent shingles are counted (every shingle of all documents is looked at;
   counts come from those that repeat within a task or lie in a prefix), and
   the most frequent HEAVY of them go to the end of the order in which prefixes
   are taken, by rising count; all others come first, by hash. Any order gives
   the same result; this one keeps passages that many documents share out of
   prefixes.
2. Two sets at the threshold t share a token of their prefixes, the first
   size - ceil(t * size) + 1 tokens in that order. Equal sets count as one.
   Sets with the same prefix and the same size form a group; groups stand for
   their members in the index.
3. In lists above LONG entries groups are first joined by stars: a group goes to
   its first STAR_LISTS such lists, and in each block of one it is verified against
   one set of every class found there so far (the last REPS of them). That takes as
   many comparisons as entries times REPS at most, and makes one class of most large
   groups of near copies.
4. Pairs of groups come from the lists of prefix tokens and pass the length
   filter, the position filter, and a bound on the overlap by bucket counts; pairs
   that stars joined already are not even looked at, as entries lie by class.
   Long lists are cut into blocks, and a pair that shares several long lists
   is taken at the first one. Pairs that pass are packed by their first group.
5. Candidates form clusters (components of the pairs). A task gets whole
   clusters, or two blocks of a large one with the pairs between them. Long sets
   share tokens by chance, and few buckets bound them badly; their pairs first pass a
   bound on bucket counts that are as many as an eighth of the set (a filter, one
   byte a bucket).
6. What is left is dealt once more by cluster with the full sets: groups are
   expanded into members and pairs verified. A pair already joined by verified
   links is skipped, and a group's members are held against classes, not against
   each other; what a task gives back is a spanning forest.
7. Components of the forest and of the stars are the result.

Nothing that grows with the documents reaches the driver: HEAVY tokens with
counts at most, and the words of a bit filter that tells which texts later passes
tokenise: it has 8 bits or more for each such text, up to FILTER_BITS[1]; for more
texts than that a semi-join takes its place.

Values: a null text, or one without words, has no shingle and links with
nothing; a text of fewer words than a shingle has one shingle, all its words.
Rows that repeat count as copies. A null doc_id takes part, but never names a
component unless all its rows are null. Ids are whole numbers, or texts that spell
one; others raise. Of other columns component_ids keeps nothing, deduplicated all.
Shingles are 64-bit hashes, sets are told apart by 128 bits.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .components import components
from .scratch import dropped, free_name, temporary, written

#: Shingles that go to the end of the order, and the count from which a shingle may be one of them.
HEAVY, LEAST = 1 << 20, 8
#: Buckets of the overlap bound; entries of a list's block; list size from which a pair is taken at its first list only.
BUCKETS, LIST_BLOCK, LONG = 64, 1000, 24
#: Tokens that a verifying task gets of each of two blocks, about; bytes of bucket counts that a filtering task gets so.
TASK_TOKENS, TASK_BYTES = 4_000_000, 16_000_000
#: Sets of more tokens than this have fine buckets as well, about FINE tokens in each.
FINE_FROM, FINE = 1024, 8
#: Bits of the filter of texts, at least and at most.
FILTER_BITS = 1 << 23, 1 << 27
#: Long lists that a group joins stars in; classes of a block that an entry is held against.
STAR_LISTS, REPS = 2, 12
CHUNK_BYTES, PAIRS_AT_ONCE = 1_000_000, 1_000_000
#: Tokens that a counting task holds before it hands their counts on.
COUNTED_AT_ONCE = 1_000_000
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
U = np.uint64


class _Words(dict):
    """A word's 64-bit hash, kept for the words met last."""

    def __missing__(self, w: bytes) -> int:
        if len(self) > 100_000:
            self.clear()
        self[w] = h = xxhash.xxh3_64_intdigest(w)
        return h


_WORDS = _Words()


def _mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> U(31))
    h = h * U(0x9E3779B97F4A7C15)
    return h ^ (h >> U(29))


def shingle_sets(texts: list[str | None], words: int) -> list[np.ndarray]:
    """Each text's set of shingle hashes, sorted."""
    out, find, known = [], _WORD.findall, _WORDS
    with np.errstate(over="ignore"):
        for t in texts:
            own = find(t.encode("utf-8", "surrogatepass").translate(_LOWER)) if t else []
            if not own:
                out.append(np.zeros(0, U))
                continue
            h = np.fromiter(map(known.__getitem__, own), U, len(own))
            n = min(words, len(h))
            m = len(h) - n + 1
            s = np.full(m, n, U)
            for i in range(n):
                s = _mixed(s + h[i : i + m])
            s.sort()
            out.append(s[np.r_[True, s[1:] != s[:-1]]])
    return out


def prefix_size(n: int, percent: int) -> int:
    """n - ceil(t * n) + 1, in whole numbers."""
    return n - -(-percent * n // 100) + 1


def ordered_prefix(s: np.ndarray, percent: int, heavy: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The first tokens of a set in the order: light ones by hash, then heavy ones by count and hash."""
    p = prefix_size(len(s), percent)
    if not len(heavy):
        return s[:p]
    at = np.searchsorted(heavy, s)
    at[at == len(heavy)] = 0
    hit = heavy[at] == s
    light = s[~hit]
    if len(light) >= p:
        return light[:p]
    late, n = s[hit], counts[at[hit]]
    return np.r_[light, late[np.lexsort((late, n))][: p - len(light)]]


def _slices(batch: pa.RecordBatch, column: int) -> Iterator[tuple[pa.RecordBatch, list[str | None]]]:
    """Slices of a batch with their texts: only one slice at a time becomes Python strings."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    at = size = 0
    for k, n in enumerate(sizes):
        size += n
        if size >= CHUNK_BYTES or k == len(sizes) - 1:
            part = batch.slice(at, k + 1 - at)
            yield part, part.column(column).to_pylist()
            at, size = k + 1, 0


def _heavy(texts: DataFrame, words: int, percent: int) -> tuple[np.ndarray, np.ndarray]:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, np.ndarray] = {}  # equal sets are one
        held = 0

        def out() -> pa.RecordBatch:
            sets = [*known.values()]
            every = np.sort(np.concatenate(sets))
            at = np.flatnonzero(np.r_[True, every[1:] != every[:-1]])
            n = np.diff(np.r_[at, len(every)])
            first = np.zeros(len(every), bool)  # also tokens met once, where they are first by hash in some set
            lead = np.concatenate([s[: prefix_size(len(s), percent)] for s in sets])
            first[np.searchsorted(every, lead)] = True
            keep = (n > 1) | first[at]
            return pa.RecordBatch.from_arrays([pa.array(every[at][keep].view(np.int64)), pa.array(n[keep])], ["token", "n"])

        for batch in batches:
            for _, own in _slices(batch, 0):
                for x in shingle_sets(own, words):
                    if len(x) and (name := xxhash.xxh3_128_digest(x.tobytes())) not in known:
                        known[name] = x
                        held += len(x)
                if held > COUNTED_AT_ONCE:
                    yield out()
                    known.clear()
                    held = 0
        if held:
            yield out()
        _WORDS.clear()  # other stages use the same Python worker

    n = texts.mapInArrow(count, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST)
    n = written(n, "jaccard-counts")
    held, least = 0, None
    for r in n.groupBy("n").agg(F.count("*").alias("tokens")).orderBy(F.desc("n")).toLocalIterator():  # a row a count
        if (held := held + r.tokens) > HEAVY:
            break
        least = r.n
    top = n.where(F.col("n") >= least if least is not None else F.lit(False)).toPandas()  # HEAVY rows at most
    tokens = top["token"].to_numpy(np.int64).view(U)
    order = np.argsort(tokens)
    return tokens[order], top["n"].to_numpy(np.int64)[order]


def _counts(s: np.ndarray, buckets: int) -> bytes:
    """How many tokens of a set each bucket (a range of hashes) holds, a byte each; nothing if a byte is too small."""
    b = np.bincount((s >> U(65 - buckets.bit_length())).astype(np.int64), minlength=buckets)
    return b.astype(np.uint8).tobytes() if b.max() < 256 else b""


def _described(docs: DataFrame, words: int, percent: int, heavy: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """(id, h, n, uid, key, prefix, buckets, fine) of each document: n is the set's size, key stands for the prefix."""
    share = docs.sparkSession.sparkContext.broadcast(heavy)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, counts = share.value
        for batch in batches:
            for part, texts in _slices(batch, 2):
                sizes, uids, keys, prefixes, buckets, fine = [], [], [], [], [], []
                for s in shingle_sets(texts, words):
                    sizes.append(len(s))
                    if not len(s):
                        uids.append(None), keys.append(None), prefixes.append(None), buckets.append(None), fine.append(None)
                        continue
                    p = ordered_prefix(s, percent, tokens, counts)
                    uids.append(xxhash.xxh3_128_digest(s.tobytes()))
                    keys.append(xxhash.xxh3_128_digest(p.tobytes()))
                    prefixes.append(p.view(np.int64))
                    buckets.append(_counts(s, BUCKETS))
                    fine.append(_counts(s, 1 << (len(s) // FINE).bit_length() - 1) if len(s) > FINE_FROM else None)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(sizes, pa.int64()), pa.array(uids, pa.binary()), pa.array(keys, pa.binary()), pa.array(prefixes, pa.list_(pa.int64())), pa.array(buckets, pa.binary()), pa.array(fine, pa.binary())],
                    ["id", "h", "n", "uid", "key", "prefix", "buckets", "fine"],
                )
        _WORDS.clear()

    return docs.mapInArrow(run, "id long, h long, n long, uid binary, key binary, prefix array<long>, buckets binary, fine binary")


def _runs(x: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.r_[True, x[1:] != x[:-1]]) if len(x) else np.zeros(0, np.int64)


def _root(parent: dict, x: int) -> int:
    while (up := parent.get(x, x)) != x:
        parent[x] = parent.get(up, up)
        x = up
    return x


def _enumerated(lists: DataFrame, percent: int) -> DataFrame:
    """(a, partners, star): candidate pairs of groups, packed by the first; star is one edge of the task's own forest."""

    def pairs(t: pd.DataFrame) -> np.ndarray:
        """The pairs of whole blocks that pass the filters, as two columns."""
        token, bi, bj = t["token"].to_numpy(), t["bi"].to_numpy(), t["bj"].to_numpy()
        new = np.r_[True, (token[1:] != token[:-1]) | (bi[1:] != bi[:-1]) | (bj[1:] != bj[:-1])]
        first = np.flatnonzero(new)
        end = np.repeat(np.r_[first[1:], len(t)], np.diff(np.r_[first, len(t)]))
        star = t["star"].to_numpy()
        same = np.flatnonzero(new | np.r_[True, star[1:] != star[:-1]])  # entries of one class lie together
        over = np.repeat(np.r_[same[1:], len(t)], np.diff(np.r_[same, len(t)]))
        gid, n, pos, side, crossed = (t[c].to_numpy() for c in ("gid", "n", "pos", "side", "crossed"))
        b = t["buckets"].to_numpy()
        known = np.fromiter((x is not None and len(x) == BUCKETS for x in b), bool, len(b))
        table = np.zeros((len(t), BUCKETS), np.uint8)
        if known.any():
            table[known] = np.frombuffer(b"".join(b[known]), np.uint8).reshape(-1, BUCKETS)
        earlier = t["earlier"].to_numpy()
        long = np.fromiter(map(len, earlier), np.int64, len(t)) > 0
        out = []
        todo = end - over
        upto = np.cumsum(todo)
        at = 0
        while at < len(t):
            to = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + PAIRS_AT_ONCE, "right")))
            i = np.repeat(np.arange(at, to), todo[at:to])
            j = over[i] + np.arange(len(i)) - np.repeat(np.cumsum(todo[at:to]) - todo[at:to], todo[at:to])
            at = to
            x, y = n[i], n[j]
            need = -(-percent * (x + y) // (100 + percent))  # of the overlap
            most = np.minimum(pos[i], pos[j]) + 1 + np.minimum(x - pos[i], y - pos[j]) - 1
            good = (100 * np.minimum(x, y) >= percent * np.maximum(x, y)) & (most >= need) & (gid[i] != gid[j]) & ((crossed[i] == 0) | (side[i] != side[j]))
            i, j, need = i[good], j[good], need[good]
            if len(i):
                good = ~(known[i] & known[j]) | (np.minimum(table[i], table[j]).sum(axis=1, dtype=np.int64) >= need)
                i, j = i[good], j[good]
            if len(i):
                check = np.flatnonzero(long[i] & long[j])
                if len(check):  # taken at an earlier long list already?
                    sets = {k: frozenset(earlier[k].tolist()) for k in set(i[check].tolist()) | set(j[check].tolist())}
                    again = np.fromiter((not sets[p].isdisjoint(sets[q]) for p, q in zip(i[check].tolist(), j[check].tolist(), strict=True)), bool, len(check))
                    good = np.ones(len(i), bool)
                    good[check[again]] = False
                    i, j = i[good], j[good]
                out.append(np.c_[np.minimum(gid[i], gid[j]), np.maximum(gid[i], gid[j])])
        return np.concatenate(out) if out else np.zeros((0, 2), np.int64)

    def packed(found: list[np.ndarray]) -> pd.DataFrame:
        every = np.unique(np.concatenate(found), axis=0)
        first = _runs(every[:, 0])
        parent: dict[int, int] = {}
        for a, b in every.tolist():
            ra, rb = _root(parent, a), _root(parent, b)
            if ra != rb:
                parent[max(ra, rb)] = min(ra, rb)
        a, partners = every[first, 0].tolist(), np.split(every[:, 1], first[1:])
        rest = np.setdiff1d(every[:, 1], every[:, 0]).tolist()
        nodes = a + rest  # all that have a pair, with their root in this task's forest
        return pd.DataFrame({"a": nodes, "partners": partners + [np.zeros(0, np.int64)] * len(rest), "star": [_root(parent, x) for x in nodes]})

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, found, size = None, [], 0
        for frame in frames:
            t = frame if held is None else pd.concat([held, frame], ignore_index=True)
            last = (t["token"] == t["token"].iloc[-1]) & (t["bi"] == t["bi"].iloc[-1]) & (t["bj"] == t["bj"].iloc[-1])
            cut = len(t) - int(last.to_numpy()[::-1].argmin()) if not last.all() else 0
            held = t.iloc[cut:]
            if cut:
                found.append(pairs(t.iloc[:cut].reset_index(drop=True)))
                size += len(found[-1])
                if size > 2_000_000:
                    yield packed(found)
                    found, size = [], 0
        if held is not None and len(held):
            found.append(pairs(held.reset_index(drop=True)))
            size += len(found[-1])
        if size:
            yield packed(found)

    return lists.mapInPandas(run, "a long, partners array<long>, star long")


def _filtered_sets(docs: DataFrame, words: int, wanted: DataFrame) -> DataFrame:
    """(uid, tokens) of the documents whose ``h`` is wanted, and of a few more that the bit filter lets through."""
    n = 8 * wanted.count()
    width = max(FILTER_BITS[0], 1 << n.bit_length()).bit_length() - 1
    if n > FILTER_BITS[1]:
        docs, width = docs.join(wanted.select("h").distinct(), "h", "left_semi").select("id", "h", "text"), 6
    low = U(64 - width)
    bit = F.explode(F.array(F.shiftrightunsigned("h", 64 - width), F.shiftrightunsigned(F.shiftleft("h", width), 64 - width)))
    table = np.full((1 << width) // 64, -1, np.int64)
    if n <= FILTER_BITS[1]:
        bits = wanted.select(bit.alias("bit")).groupBy(F.shiftright("bit", 6).alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(bit % 64 as int)))").alias("bits"))
        table[:] = 0
        got = bits.toPandas()  # FILTER_BITS[1] / 64 rows at most
        table[got["word"].to_numpy(np.int64)] = got["bits"].to_numpy(np.int64)
    share = docs.sparkSession.sparkContext.broadcast(table.view(U))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = share.value
        for batch in batches:
            h = batch.column(1).to_numpy(zero_copy_only=False).view(U)
            ok = np.ones(len(h), bool)
            for k in (h >> low, (h << U(width)) >> low):
                ok &= (f[(k >> U(6)).astype(np.int64)] >> (k & U(63))) & U(1) == 1
            for _, texts in _slices(batch.filter(pa.array(ok)), 2):
                sets = [s for s in shingle_sets(texts, words) if len(s)]
                yield pa.RecordBatch.from_arrays([pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())], ["uid", "tokens"])
        _WORDS.clear()

    return docs.mapInArrow(run, "uid binary, tokens binary")


def _dealt(members: DataFrame, pairs: DataFrame, label: DataFrame, per_task: int, least: int) -> tuple[DataFrame, DataFrame]:
    """Members and pairs of each cluster, for the task, or the tasks of two blocks, that see the cluster's pairs.

    ``members`` has label, node (by which a large cluster is cut), weight and
    more. Clusters below ``per_task`` share tasks; a large one is cut into blocks. A
    pair goes to the task of its two blocks; one of groups of several members
    (``wide``) to all tasks of its cluster, as its members lie in many blocks.
    """
    parts = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    weight = members.groupBy("label").agg(F.sum("weight").alias("weight")).withColumn("cuts", F.greatest(F.lit(1), F.ceil(F.col("weight") / per_task)).cast("int"))
    weight = written(weight, "jaccard-weights")
    total = weight.agg(F.sum("weight")).first()[0] or 0
    tasks = max(1, -(-total // per_task), min(parts, -(-total // least)))
    task = F.when(F.col("cuts") <= 1, F.pmod(F.xxhash64("label"), F.lit(tasks))).otherwise(F.xxhash64("label"))
    weight = weight.select("label", task.alias("task"), "cuts")
    placed = members.drop("weight").join(weight, "label").withColumn("side", F.pmod("node", F.col("cuts")).cast("int")).drop("label")
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1))).drop("cuts")
    placed = placed.withColumn("bi", F.least("side", "other")).withColumn("bj", F.greatest("side", "other")).drop("other")
    work = pairs.where(F.size("partners") > 0).join(label, F.col("a") == F.col("gid")).join(weight, "label")
    every = F.sequence(F.lit(0), F.col("cuts") - 1)
    some = F.struct(F.lit(0).alias("bi"), F.lit(0).alias("bj"), F.col("partners").alias("partners"))
    block_pairs = F.flatten(F.transform(every, lambda i: F.transform(F.sequence(i, F.col("cuts") - 1), lambda j: F.struct(i.alias("bi"), j.alias("bj"), F.col("partners").alias("partners")))))
    own = F.pmod("a", F.col("cuts")).cast("int")
    by_side = F.transform(every, lambda s: F.struct(F.least(own, s).alias("bi"), F.greatest(own, s).alias("bj"), F.filter("partners", lambda q: F.pmod(q, F.col("cuts")) == s).alias("partners")))
    to = F.when(F.col("cuts") <= 1, F.array(some)).when(F.col("wide"), block_pairs).otherwise(F.filter(by_side, lambda x: F.size(x["partners"]) > 0))
    work = work.select("task", "a", "wide", F.explode(to).alias("x"))
    return placed, work.select(F.col("task").alias("p_task"), F.col("x.bi").alias("p_bi"), F.col("x.bj").alias("p_bj"), (F.col("x.bi") != F.col("x.bj")).alias("crossed"), "wide", "a", F.col("x.partners").alias("partners"))


def _near_by_buckets(x: bytes, nx: int, y: bytes, ny: int, percent: int) -> bool:
    """False if bucket counts show that two sets overlap too little; True also where they are unknown."""
    if not x or not y:
        return True
    if len(x) > len(y):
        x, y = y, x
    a = np.frombuffer(x, np.uint8).astype(np.int64)
    b = np.frombuffer(y, np.uint8).reshape(len(x), -1).sum(axis=1, dtype=np.int64)
    return (100 + percent) * int(np.minimum(a, b).sum()) >= percent * (nx + ny)


def _sifted(groups: DataFrame, pairs: DataFrame, label: DataFrame, percent: int) -> DataFrame:
    """(a, partners, wide): the pairs of groups that fine buckets don't rule out; each group with a pair is an ``a`` once at least.

    wide tells pairs in which a group has several members.
    """
    size = F.coalesce(F.octet_length("fine"), F.lit(0)) + 16
    members = label.join(groups.select("gid", "n", "fine", "members"), "gid").select("label", F.col("gid").alias("node"), size.alias("weight"), "n", "fine", "members")
    sets, work = _dealt(members, pairs.withColumn("wide", F.lit(False)), label, TASK_BYTES, 1_000_000)

    def one(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple[int, list[int], bool]] = []
        if len(a) and len(b):
            known = {g: (f or b"", n, s) for g, f, n, s in zip(a["node"].tolist(), a["fine"], a["n"].tolist(), a["side"].tolist(), strict=True)}
            several = set(a["node"][a["members"] > 1].tolist())
            crossed = bool(b["crossed"].iloc[0])
            for g, partners in zip(b["a"].tolist(), b["partners"], strict=True):
                if g not in known:
                    continue
                f, n, side = known[g]
                kept = []
                for q in np.unique(partners).tolist():
                    if q in known and not (crossed and known[q][2] == side) and (g == q or _near_by_buckets(f, n, *known[q][:2], percent)):
                        kept.append(q)
                many = kept if g in several else [q for q in kept if q in several]
                few = [] if g in several else [q for q in kept if q not in several]
                out += [(g, own, wide) for own, wide in ((few, False), (many, True)) if own]
            own = {g for g, _, _ in out}
            out += [(q, [], False) for q in {q for _, kept, _ in out for q in kept} - own]  # a row for every node that has a pair
        return pd.DataFrame(out, columns=["a", "partners", "wide"])

    on = ["task", "bi", "bj"]
    return sets.groupBy(on).cogroup(work.groupBy([f"p_{c}" for c in on])).applyInPandas(one, "a long, partners array<long>, wide boolean")


def _alike(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    if len(x) > len(y):
        x, y = y, x
    at = np.searchsorted(y, x)
    at[at == len(y)] = 0
    common = int(np.count_nonzero(y[at] == x))
    return 100 * common >= percent * (len(x) + len(y) - common)


def _verified(sets: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """(a, b): a spanning forest of the links between members, by task."""

    def one(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple[int, int]] = []
        if len(a) and len(b):
            tokens = [np.frombuffer(x, U) for x in a["tokens"]]
            node, side = a["node"].tolist(), a["side"].tolist()
            members: dict[int, list[int]] = {}
            for k, g in enumerate(a["gid"].tolist()):
                members.setdefault(g, []).append(k)
            crossed = bool(b["crossed"].iloc[0])
            parent: dict[int, int] = {}

            def join(i: int, theirs: dict[int, list[int]]) -> bool:
                """Links i with the classes in which it has a link; theirs is members by class."""
                new = False
                for own in theirs.values():
                    ri = _root(parent, i)
                    if ri == _root(parent, own[0]):
                        continue
                    for j in own:
                        if not (crossed and side[i] == side[j]) and _alike(tokens[i], tokens[j], percent):
                            parent[_root(parent, own[0])] = ri
                            out.append((node[i], node[j]))
                            new = True
                            break
                return new

            def classes(own: list[int]) -> dict[int, list[int]]:
                by: dict[int, list[int]] = {}
                for j in own:
                    by.setdefault(_root(parent, j), []).append(j)
                return by

            for g, partners in zip(b["a"].tolist(), b["partners"], strict=True):
                for q in np.unique(partners).tolist():
                    theirs = classes(members.get(q, []))
                    for i in members.get(g, ()):
                        if join(i, theirs):
                            theirs = classes(members[q])
        return pd.DataFrame(out, columns=["a", "b"], dtype=np.int64)

    on = ["task", "bi", "bj"]
    return sets.groupBy(on).cogroup(pairs.groupBy([f"p_{c}" for c in on])).applyInPandas(one, "a long, b long")


def _stars(src: DataFrame, sets: DataFrame, by_group: DataFrame, words: int, percent: int) -> DataFrame | None:
    """(a, b): links between groups' own sets, found in blocks of long lists; None if there are no long lists."""
    e = F.explode(F.slice(F.filter("own", lambda e: e["size"] > LONG), 1, STAR_LISTS)).alias("e")
    joined = written(by_group.select("gid", "n", e).select("gid", "n", "e.token"), "jaccard-stars")
    lists = joined.groupBy("token").agg(F.count("*").alias("size"), F.sum("n").alias("tokens")).where("size > 1")
    cuts = F.greatest(F.ceil(F.col("size") / LIST_BLOCK), F.ceil(F.col("tokens") / TASK_TOKENS)).cast("int")
    joined = joined.join(lists.select("token", cuts.alias("cuts")), "token")
    placed = written(joined.select("gid", "token", F.pmod(F.xxhash64("gid", "token"), F.col("cuts")).alias("block")), "jaccard-stars")
    wanted = sets.join(placed.select(F.col("gid").alias("node")).distinct(), "node", "left_semi").select("h")
    if not placed.head(1):
        return None
    tokens = _filtered_sets(src, words, wanted).dropDuplicates(["uid"]).select(F.xxhash64("uid").alias("gid"), "tokens")

    def one(t: pd.DataFrame) -> pd.DataFrame:
        t = t.sort_values("gid")
        out: list[tuple[int, int]] = []
        reps: list[tuple[int, np.ndarray]] = []
        for g, x in zip(t["gid"].tolist(), (np.frombuffer(x, U) for x in t["tokens"]), strict=True):
            hit = next((k for k in range(len(reps) - 1, max(-1, len(reps) - 1 - REPS), -1) if _alike(x, reps[k][1], percent)), None)
            if hit is None:
                reps.append((g, x))
            else:
                out.append((reps[hit][0], g))
                reps.append(reps.pop(hit))  # classes met last come first
        return pd.DataFrame(out, columns=["a", "b"], dtype=np.int64)

    return written(tokens.join(placed, "gid").groupBy("token", "block").applyInPandas(one, "a long, b long").distinct(), "jaccard-star-links")


def linked(docs: DataFrame, words: int = 5, percent: int = 80, text: str = "text", doc_id: str = "doc_id", key: Column | None = None) -> DataFrame:
    """(id, n, h, node, root): a row a document; documents with one root are joined by links, node tells different sets apart; h is the key, a hash."""
    spark = docs.sparkSession
    key = F.xxhash64(F.col(doc_id), F.octet_length(text)) if key is None else key
    src = docs.select(F.col(doc_id).cast("long").alias("id"), key.alias("h"), F.col(text).alias("text"))
    heavy = _heavy(src.select("text"), words, percent)
    full = written(_described(src, words, percent, heavy), "jaccard-sets")
    own = ("n", "key", "prefix", "buckets", "fine")
    first = full.where("n > 0").groupBy("uid").agg(F.min("h").alias("h"), *(F.first(c).alias(c) for c in own)).withColumn("node", F.xxhash64("uid"))
    groups = first.groupBy("key", "n").agg(F.min("node").alias("gid"), F.count("*").alias("members"), *(F.first(c).alias(c) for c in own[2:]))
    alone = lambda c: F.when(F.col("members") == 1, F.col(c))  # noqa: E731  the members of a group differ in their buckets
    groups = written(groups.withColumns({c: alone(c) for c in ("buckets", "fine")}), "jaccard-groups")
    rows = written(full.select("id", "n", "h", "uid", "key"), "jaccard-rows")
    dropped(full)
    sets = rows.where("n > 0").groupBy("uid").agg(F.min("h").alias("h"), F.first("n").alias("n"), F.first("key").alias("key")).withColumn("node", F.xxhash64("uid"))
    # the index: lists of prefix tokens, without those of one entry
    posted = groups.select("gid", "n", F.posexplode("prefix").alias("pos", "token"))
    sizes = posted.groupBy("token").agg(F.count("*").alias("size")).where("size > 1")
    entries = posted.join(sizes, "token")
    by_group = entries.groupBy("gid").agg(F.sort_array(F.collect_list(F.struct("pos", "token", "size"))).alias("own")).join(groups.select("gid", "n", "members", "buckets"), "gid")
    by_group = written(by_group, "jaccard-lists")
    stars = _stars(src, sets, by_group, words, percent)
    star = F.col("gid")
    if stars is not None:  # a group of several members is in no class: its other members may lack the links of its own set
        by_group = by_group.join(components(stars).withColumnsRenamed({"node": "gid", "root": "star_root"}), "gid", "left")
        star = F.when(F.col("members") == 1, F.coalesce("star_root", "gid")).otherwise(F.col("gid"))
    long = F.transform(F.filter("own", lambda e: e["size"] > LONG), lambda e: e["token"])
    spread = by_group.withColumn("long", long).select("gid", "n", star.alias("star"), "buckets", "long", F.explode("own").alias("e"))
    before = F.expr("slice(long, 1, greatest(array_position(long, e.token) - 1, 0))")
    cuts = F.ceil(F.col("e.size") / LIST_BLOCK).cast("int")
    block = F.pmod(F.col("gid"), cuts).cast("int")
    spread = spread.select("gid", "n", "star", "buckets", "e.token", "e.pos", F.when(F.col("e.size") > LONG, before).otherwise(F.array().cast("array<bigint>")).alias("earlier"), block.alias("side"), F.explode(F.sequence(F.lit(0), cuts - 1)).alias("other"))
    low, high = F.least("side", "other"), F.greatest("side", "other")
    lists = spread.select("token", low.alias("bi"), high.alias("bj"), (low != high).cast("int").alias("crossed"), "gid", "n", "star", "pos", "side", "buckets", "earlier")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    lists = lists.repartition(parts, "token", "bi", "bj").sortWithinPartitions("token", "bi", "bj", "star", "gid")
    pairs = _enumerated(lists, percent)
    several = groups.where("members > 1").select(F.col("gid").alias("a"), F.array("gid").alias("partners"), F.col("gid").alias("star"))
    pairs = written(pairs.unionByName(several), "jaccard-pairs")
    # clusters of candidates: the tasks' forests have an edge for each group and task at most
    label = components(pairs.select("a", F.col("star").alias("b")))
    label = written(label.union(several.select("a", "a").join(label, F.col("a") == F.col("node"), "left_anti")).toDF("gid", "label"), "jaccard-labels")
    pairs = written(_sifted(groups, pairs, label, percent), "jaccard-sifted")
    left = pairs.select(F.col("a").alias("gid")).distinct()
    members = sets.select("uid", "h", "n", "node", "key").join(groups.select("key", F.col("n").alias("gn"), "gid"), ["key"]).where("n = gn").drop("gn", "key")
    members = written(members.join(label.join(left, "gid", "left_semi"), "gid").withColumn("weight", F.col("n")).drop("n"), "jaccard-members")
    tokens = _filtered_sets(src, words, members.select("h")).dropDuplicates(["uid"])
    placed, work = _dealt(members.drop("h"), pairs, label, TASK_TOKENS, 100_000)
    links = _verified(tokens.join(placed, "uid"), work, percent)
    roots = components(links if stars is None else links.unionByName(stars)).withColumnsRenamed({"node": "linked", "root": "linked_root"})
    named = rows.select("id", "n", "h", F.when(F.col("n") > 0, F.xxhash64("uid")).alias("node"))
    return named.join(roots, F.col("node") == F.col("linked"), "left").select("id", "n", "h", "node", F.coalesce("linked_root", "node").alias("root"))


def component_ids(docs: DataFrame, words: int = 5, percent: int = 80, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, n_shingles, component_id): the smallest doc_id that links lead to; a row for each row of the documents."""
    with temporary():
        rows = written(linked(docs, words, percent, text, doc_id), "jaccard-roots", keep=True)
    # a table of its own, so that Spark can split the join at the root of a large component
    least = written(rows.where("root is not null").groupBy(F.col("root").alias("r")).agg(F.min("id").alias("least")), "jaccard-least")
    out = rows.join(least, F.col("root") == F.col("r"), "left")
    return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.coalesce("least", "id").alias("component_id"))


def deduplicated(docs: DataFrame, words: int = 5, percent: int = 80, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The documents without near copies: of each component one row stays; all columns are kept.

    Rows count, not ids: it is the row with the smallest id (a null id comes last),
    then with the smallest hash of id and text; rows of a null or repeated id with
    texts that aren't linked all stay. Rows with the same id and text are one,
    told apart from others by 64 bits. Documents without words link with nothing,
    so that all of them stay.
    """
    key = F.xxhash64(F.col(doc_id), F.col(text))
    with temporary():
        known = written(linked(docs, words, percent, text, doc_id, key).select("id", "h", "root").where("root is not null"), "jaccard-roots")
        least = known.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "h")).alias("x"))
        stays = written(least.select(F.col("x.h").alias("stays")), "jaccard-stays", keep=True)
    own, lead, taken = (free_name(docs, c) for c in ("key__", "lead__", "stays"))
    words = F.coalesce(F.regexp_like(F.col(text), F.lit(r"[^\x20\x09-\x0D]")), F.lit(False))
    kept = docs.where(words).withColumn(own, key).join(stays.withColumnRenamed("stays", taken), F.col(own) == F.col(taken), "left_semi")
    number = F.row_number().over(Window.partitionBy(own).orderBy(own))
    kept = kept.withColumn(lead, number).where(F.col(lead) == 1).select(*docs.columns)
    return kept.unionByName(docs.where(~words))
