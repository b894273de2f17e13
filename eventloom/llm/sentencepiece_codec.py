"""SentencePiece (BPE) encoding and decoding by vectorised merge rounds.

A text becomes words: SentencePiece's normalised form has a space mark before
each word, and no piece of a BPE model crosses from a letter into a mark, so
words can be merged apart from each other. A word is cut once more between any
two characters that stand side by side in no piece, as no merge crosses there.
The distinct words of a chunk lie in one flat array of symbol ids. A round finds
each part's best pair with one segmented minimum, merges it in all parts at
once, and drops parts that have no pair left; rounds end when none remains.

Exactness. The library takes the best-scored pair, the leftmost of equals, one
at a time. Several copies of a part's best pair may be merged in one round only
if that cannot make a pair that comes before the copies still to be merged. The
model's table tells for which pieces this is sure; for all others just the
leftmost copy is merged in a round. That takes many rounds in a long part (a run
of one letter, text without spaces), so that there every pair is merged for
which the text around shows that no merge can come before: none of the pieces
that could take a symbol of the pair, or the merged pair itself, has a better
score (:meth:`Codec._settled`). Rounds then grow with how far merges depend on
each other and not with a part's length.

Values: a null text counts as empty; an empty text gives the begin and end ids
alone. Whole texts are read, of any length; repeated rows give equal rows; an
empty table gives an empty table. Other columns go through unchanged; the added
columns replace columns of the same name.
"""

from __future__ import annotations

import codecs
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

SPACE = "▁"
#: Words kept between chunks, and symbols that they may hold, before the store starts anew.
STORE_WORDS, STORE_SYMBOLS = 250_000, 4_000_000
#: Bytes of text that are worked on at once; one longer text is worked on alone.
CHUNK_BYTES = 250_000
#: Symbols from which a part of a word counts as long.
LONG = 32
NONE = np.iinfo(np.int32).max
U = np.uint64
#: Base of the polynomial hash of pieces, and what undoes a step of it.
BASE = 0x9E3779B97F4A7C15
BACK = pow(BASE, -1, 1 << 64)


def _one_mark_per_byte(e: UnicodeError) -> tuple[str, int]:
    return "�", e.start + 1


codecs.register_error("eventloom-bytewise", _one_mark_per_byte)


class Codec:
    """Tables of one model, and the words met so far."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = len(sp)
        self.bos, self.eos, unk = sp.bos_id(), sp.eos_id(), sp.unk_id()
        pieces = [sp.id_to_piece(i) for i in range(n)]
        plain = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))]
        if any(sp.is_unused(i) for i in range(n)) or any(re.search(f"[^{SPACE}]{SPACE}", pieces[i]) for i in plain):
            raise ValueError("a model with unused pieces, or pieces over a word's end, isn't supported")
        if sp.normalize(" a  b ") != f"{SPACE}{SPACE}a{SPACE}{SPACE}b{SPACE}":
            raise ValueError("only models with a dummy prefix and without whitespace removal are supported")
        ids = {pieces[i]: i for i in plain}
        self.chars = {p: i for p, i in ids.items() if len(p) == 1}
        self.symbol_of = -1 - np.arange(0x110000, dtype=np.int32)  # a character without a piece stays as -1 - its code point
        for p, i in self.chars.items():
            self.symbol_of[ord(p)] = i
        self.byte_ids = np.zeros(256, np.int32)
        for i in range(n):
            if sp.is_byte(i):
                self.byte_ids[int(pieces[i][1:-1], 16)] = i
        scores = np.array([sp.get_score(i) for i in range(n)])
        order = {s: k for k, s in enumerate(sorted(set(scores[plain]), reverse=True))}  # equal scores, equal rank
        rank = {i: order[scores[i]] for i in plain}
        pairs, unsure = [], set()
        for whole, i in ids.items():
            for k in range(1, len(whole)):
                left, right = ids.get(whole[:k]), ids.get(whole[k:])
                if left is not None and right is not None:
                    pairs.append((left << 32 | right, rank[i], i))
                    unsure.update(x for x in (left, right) if rank[i] <= rank[x])
        pairs.sort()
        keys, ranks, made = (np.array(x) for x in zip(*pairs, strict=True))
        self.keys, self.ranks, self.made = keys.astype(np.int64), ranks.astype(np.int32), made.astype(np.int32)
        # a small open table in front of the binary search: most pairs of neighbours are not in the model
        self.bits = 22
        self.maybe = np.zeros(1 << self.bits, bool)
        self.maybe[self._slot(self.keys)] = True
        self.unsure = np.zeros(n, bool)
        self.unsure[list(unsure)] = True
        # which characters stand side by side in a piece
        self.compact = np.full(n + 1, -1, np.int32)  # the last stands for characters without a piece
        self.compact[list(self.chars.values())] = np.arange(len(self.chars))
        self.joined = np.zeros((len(self.chars), len(self.chars)), bool)
        for p in ids:
            if len(p) > 1:
                c = self.compact[[self.chars.get(x, n) for x in p]]
                self.joined[c[:-1][(c[:-1] >= 0) & (c[1:] >= 0)], c[1:][(c[:-1] >= 0) & (c[1:] >= 0)]] = True
        # ranks of pieces by a hash of their characters
        self.longest = max(map(len, ids))
        hashes = []
        for p in ids:
            h = 0
            for k, ch in enumerate(p):
                h += ord(ch) * pow(BASE, k, 1 << 64)
            hashes.append(h & (1 << 64) - 1)
        self.hashes, of = np.unique(np.array(hashes, U), return_index=True)
        self.hash_ranks = np.array([rank[i] for i in ids.values()], np.int32)[of]
        self.seen = np.zeros(1 << self.bits, bool)
        self.seen[self._slot(self.hashes)] = True
        raw = [b"" if sp.is_control(i) else " ⁇ ".encode() if i == unk else bytes([int(p[1:-1], 16)]) if sp.is_byte(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(pieces)]
        self.raw = np.frombuffer(b"".join(raw), np.uint8)
        self.raw_size = np.fromiter(map(len, raw), np.int64, n)
        self.raw_start = np.cumsum(self.raw_size) - self.raw_size
        self.space_led = np.array([p.startswith(SPACE) and i in rank for i, p in enumerate(pieces)])
        self.control = np.array([sp.is_control(i) for i in range(n)])
        self.n = n
        alone = "" if "\n" in self.chars else "\n"
        self.words = re.compile(f"{SPACE}+[^{SPACE}{alone}]*|[^{SPACE}{alone}]+" + (f"|{alone}+" if alone else ""))
        self._forget()
        # characters whose runs are pieces of one rank: such a run is merged from its left end, block by block
        self.tied: dict[int, tuple[int, int, int]] = {}
        of_rank = {ch: {rank[ids[ch * k]] for k in range(2, self.longest + 1) if ch * k in ids} for ch in self.chars if ch * 3 in ids}
        for ch, own in of_rank.items():
            most = max(k for k in range(2, self.longest + 1) if ch * k in ids)
            if len(own) == 1 and not self.joined[:, self.compact[self.chars[ch]]][np.arange(len(self.chars)) != self.compact[self.chars[ch]]].any():
                alone = [self.merge_rounds([ch * k])[0].tolist() for k in range(1, 2 * most + 1)]
                if all(alone[most + k - 1] == [ids[ch * most], *(alone[k - 1] if k else [])] for k in range(most + 1)):
                    self.tied[self.chars[ch]] = (own.pop(), most, ids[ch * most])
        self._forget()

    def _forget(self) -> None:
        self.store: dict[str, int] = {}
        self.flat = np.zeros(1 << 16, np.int32)
        self.used = 0
        self.start = np.zeros(1 << 14, np.int64)
        self.length = np.zeros(1 << 14, np.int64)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _rank(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and id of what each pair makes; NONE where it makes nothing."""
        out, made = np.full(len(left), NONE, np.int32), np.zeros(len(left), np.int32)
        keys = left.astype(np.int64) << 32 | right
        at = np.flatnonzero((left >= 0) & (right >= 0))
        at = at[self.maybe[self._slot(keys[at])]]
        k = np.searchsorted(self.keys, keys[at])
        k[k == len(self.keys)] = 0
        hit = self.keys[k] == keys[at]
        out[at[hit]], made[at[hit]] = self.ranks[k[hit]], self.made[k[hit]]
        return out, made

    def _hashed(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Running sums of the polynomial hash, and what brings a span's part of it to the text's begin."""
        n = len(points)
        power, back = np.full(n + 1, BASE, U), np.full(n + 1, BACK, U)
        power[0] = back[0] = 1
        power, back = np.cumprod(power), np.cumprod(back)
        return np.r_[np.zeros(1, U), np.cumsum(points.astype(U) * power[:n])], back

    def _piece_rank(self, sums: np.ndarray, back: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The rank of the piece that each span of the text spells; NONE where it is none. (A hash that misleads only makes a merge wait.)"""
        out = np.full(len(begin), NONE, np.int32)
        h = (sums[end] - sums[begin]) * back[begin]
        at = np.flatnonzero(self.seen[self._slot(h)])
        if len(at):
            k = np.searchsorted(self.hashes, h[at])
            k[k == len(self.hashes)] = 0
            hit = self.hashes[k] == h[at]
            out[at[hit]] = self.hash_ranks[k[hit]]
        return out

    def _settled(self, rank: np.ndarray, made: np.ndarray, owner: np.ndarray, begin: np.ndarray, end: np.ndarray, where: np.ndarray, sums: np.ndarray, back: np.ndarray) -> np.ndarray:
        """Pairs among ``where`` that are sure to be merged as they are, and may be at once.

        A pair of rank r stays until its turn if no piece of better rank could take one
        of its symbols with symbols beside it, and merging it early gives way to nothing
        else if no piece of rank up to r could take the merged pair. Such pieces begin and
        end where symbols do. Of equal pairs that overlap in a run, every other one is
        merged, beginning at the left, as far as all before it are.
        """
        r = rank[where]
        before = np.r_[np.int32(NONE), rank][where]
        after = np.r_[rank, np.int32(NONE)][where + 1]
        where = where[(r != NONE) & (before >= r) & (after >= r)]
        if not len(where):
            return where
        width = end[where] - begin[where]
        lead = np.r_[True, (where[1:] != where[:-1] + 1) | (made[where[1:]] != made[where[:-1]]) | (width[1:] != width[:-1])]
        at = np.arange(len(where))
        start = np.maximum.accumulate(np.where(lead, at, 0))
        run_open = lead[start] & (np.r_[np.int32(NONE), rank][where[start]] > rank[where[start]])
        even = run_open & ((at - start) % 2 == 0)
        live = at[even]  # places in `where`
        # within a run all symbols are alike: one pair stands for those that have nothing else around them
        deep = 4 * self.longest
        stop = np.minimum.accumulate(np.where(np.r_[lead[1:], True], at + 1, len(where))[::-1])[::-1]  # where the run ends
        inner = live[(live - start[live] > deep) & (stop[live] - live > deep)]
        checked = np.setdiff1d(live, inner, assume_unique=True) if len(inner) else live
        own, r, last = owner[where], rank[where], len(rank) - 1
        a, mid, b = begin[where], end[where], end[where + 1]
        todo_left, todo_right = checked, checked
        bad = np.zeros(len(where), bool)
        for k in range(1, self.longest):
            if len(todo_left):
                to = where[todo_left] - k
                ok = (to >= 0) & (owner[np.maximum(to, 0)] == own[todo_left])
                to, todo_left = to[ok], todo_left[ok]
                s = begin[to]
                ok = mid[todo_left] - s <= self.longest
                s, todo_left = s[ok], todo_left[ok]
                if len(s):
                    limit = r[todo_left]
                    got = self._piece_rank(sums, back, s, mid[todo_left])
                    stop = (got < limit) if k == 1 else (got <= limit)
                    stop |= self._piece_rank(sums, back, s, b[todo_left]) <= limit
                    bad[todo_left[stop]] = True
            if len(todo_right):
                to = where[todo_right] + 1 + k
                ok = (to <= last) & (owner[np.minimum(to, last)] == own[todo_right]) & ~bad[todo_right]
                to, todo_right = to[ok], todo_right[ok]
                e = end[to]
                ok = e - mid[todo_right] <= self.longest
                e, todo_right = e[ok], todo_right[ok]
                if len(e):
                    limit = r[todo_right]
                    stop = self._piece_rank(sums, back, mid[todo_right], e) < limit
                    stop |= self._piece_rank(sums, back, a[todo_right], e) <= limit
                    bad[todo_right[stop]] = True
            todo_left = todo_left[~bad[todo_left]]
            if not len(todo_left) and not len(todo_right):
                break
        bad[inner] = bad[start[inner] + deep]
        # in a run, as far as all before are merged
        wrong = np.cumsum(bad & even)
        return where[live[wrong[live] == (wrong - (bad & even))[start[live]]]]

    def _blocks(self, symbols: np.ndarray, owner: np.ndarray, best: np.ndarray, count: np.ndarray, wide: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Merges the blocks of long runs of tied pieces (but for the last two, which what follows may touch), and returns the symbols that are gone."""
        gone = [np.zeros(0, np.int64)]
        first = np.cumsum(count) - count
        for c, (r, most, whole) in self.tied.items():
            for k in np.flatnonzero((best == r) & wide[owner[first]] & (symbols[first] == c) & (count > 3 * most)).tolist():
                own = symbols[first[k] : first[k] + count[k]]
                other = own != c
                n = int(other.argmax()) if other.any() else len(own)
                if (q := n // most - 2) > 0:
                    at = first[k] + most * np.arange(q)
                    symbols[at] = whole
                    end[at] = end[at + most - 1]
                    inner = np.ones(q * most, bool)
                    inner[::most] = False
                    gone.append(first[k] + np.flatnonzero(inner))
        return np.concatenate(gone)

    def merge_rounds(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words in one array, and how many each word has."""
        points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
        symbols = self.symbol_of[points]
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        if not len(symbols):
            return np.zeros(0, np.int32), sizes
        c = self.compact[np.where(symbols >= 0, symbols, self.n)]
        cut = np.ones(len(symbols), bool)
        cut[1:] = (c[:-1] < 0) | (c[1:] < 0) | ~self.joined[c[:-1], c[1:]]
        starts = (np.cumsum(sizes) - sizes)[sizes > 0]
        cut[starts] = True
        owner = np.cumsum(cut) - 1  # the part of a word that a symbol is in
        part_of_word = owner[starts]
        wide = np.bincount(owner) > LONG
        spread = bool(wide.any())
        if spread:
            begin = np.arange(len(symbols))
            end = begin + 1
            sums, back = self._hashed(points)
        done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        blocks = spread and bool(self.tied)

        def pair_ranks(sym: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            r, m = np.full(len(sym), NONE, np.int32), np.zeros(len(sym), np.int32)
            if len(sym) > 1:
                r[:-1], m[:-1] = self._rank(sym[:-1], sym[1:])
                r[:-1][own[:-1] != own[1:]] = NONE
            return r, m

        rank, made = pair_ranks(symbols, owner)
        while len(symbols):
            first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            count = np.diff(np.r_[first, len(owner)])
            best = np.minimum.reduceat(rank, first)
            live = best != NONE
            if not live.all():  # compaction
                over = np.repeat(~live, count)
                done.append((owner[first[~live]], count[~live], symbols[over]))
                keep = ~over
                symbols, owner, rank, made = symbols[keep], owner[keep], rank[keep], made[keep]
                if spread:
                    begin, end = begin[keep], end[keep]
                best, count = best[live], count[live]
                if not len(symbols):
                    break
            if blocks and len(gone := self._blocks(symbols, owner, best, count, wide, end)):
                keep = np.ones(len(symbols), bool)
                keep[gone] = False
                symbols, owner, begin, end = symbols[keep], owner[keep], begin[keep], end[keep]
                rank, made = pair_ranks(symbols, owner)
                continue
            at = np.flatnonzero(rank == np.repeat(best, count))
            lead = np.r_[True, owner[at[1:]] != owner[at[:-1]]]  # the leftmost of its part
            run = np.r_[True, (at[1:] != at[:-1] + 1) | lead[1:]]
            start = np.maximum.accumulate(np.where(run, np.arange(len(at)), 0))
            sure = ~self.unsure[made[at]]
            # a part's copies may have been made of different halves, but they make one piece, so that `sure` is the same
            more = sure & ((np.arange(len(at)) - start) % 2 == 0)
            if spread:
                more &= ~wide[owner[at]]
                at = at[lead | more]
                long = np.flatnonzero(wide[owner] & (rank != NONE))
                if len(long):
                    at = np.union1d(at, self._settled(rank, made, owner, begin, end, long, sums, back))
            else:
                at = at[lead | more]
            symbols[at] = made[at]
            if spread:
                end[at] = end[at + 1]
            keep = np.ones(len(symbols), bool)
            keep[at + 1] = False
            moved = np.cumsum(keep) - 1
            new = moved[at]
            symbols, owner, rank, made = symbols[keep], owner[keep], rank[keep], made[keep]
            if spread:
                begin, end = begin[keep], end[keep]
            mark = np.zeros(len(symbols), bool)
            mark[new] = True
            mark[new[new > 0] - 1] = True
            touched = np.flatnonzero(mark)
            inner = touched[touched + 1 < len(symbols)]
            rank[touched] = NONE
            inner = inner[owner[inner] == owner[inner + 1]]
            rank[inner], made[inner] = self._rank(symbols[inner], symbols[inner + 1])
        name = np.concatenate([d[0] for d in done])
        count = np.concatenate([d[1] for d in done])
        body = np.concatenate([d[2] for d in done])
        order = np.argsort(name, kind="stable")
        body = body[_spans((np.cumsum(count) - count)[order], count[order])]
        sizes[sizes > 0] = np.add.reduceat(count[order], part_of_word)
        if (body < 0).any():
            body, sizes = self._bytes(body, sizes)
        return body, sizes

    def _bytes(self, body: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Characters without a piece become their bytes."""
        at = np.flatnonzero(body < 0)
        kinds, which = np.unique(body[at], return_inverse=True)
        raw = [chr(-1 - int(c)).encode("utf-8", "replace") for c in kinds]
        wide = np.fromiter(map(len, raw), np.int64, len(raw))
        width = np.ones(len(body), np.int64)
        width[at] = wide[which]
        ends = np.cumsum(sizes)
        total = np.r_[0, np.cumsum(width)]
        out = np.repeat(body, width)
        flat = np.frombuffer(b"".join(raw), np.uint8)
        out[_spans(total[at], width[at])] = self.byte_ids[flat[_spans((np.cumsum(wide) - wide)[which], width[at])]]
        return out, total[ends] - total[ends - sizes]

    def _learn(self, words: list[str]) -> None:
        body, sizes = self.merge_rounds(words)
        n, m = len(self.store), len(words)
        while self.used + len(body) > len(self.flat):
            self.flat = np.r_[self.flat, np.zeros_like(self.flat)]
        while n + m > len(self.start):
            self.start, self.length = np.r_[self.start, np.zeros_like(self.start)], np.r_[self.length, np.zeros_like(self.length)]
        self.flat[self.used : self.used + len(body)] = body
        self.start[n : n + m] = self.used + np.cumsum(sizes) - sizes
        self.length[n : n + m] = sizes
        self.used += len(body)
        self.store.update(zip(words, range(n, n + m), strict=True))

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text, with begin and end ids."""
        if len(self.store) > STORE_WORDS or self.used > STORE_SYMBOLS:
            self._forget()
        find, words, counts = self.words.findall, [], []
        for t in texts:
            own = find(SPACE + t.replace(" ", SPACE)) if t else []
            words += own
            counts.append(len(own))
        if fresh := [w for w in set(words) if w not in self.store]:
            self._learn(fresh)
        which = np.fromiter(map(self.store.__getitem__, words), np.int64, len(words))
        sizes = self.length[which]
        body = self.flat[_spans(self.start[which], sizes)]
        ends = np.r_[0, np.cumsum(sizes)][np.cumsum(counts)] if counts else []
        out, at = [], 0
        for end in ends:
            own = np.empty(end - at + 2, "<u4")
            own[0], own[-1] = self.bos, self.eos
            own[1:-1] = body[at:end]
            out.append(own)
            at = end
        return out

    def decode_all(self, texts: list[np.ndarray]) -> list[str]:
        """The text of each array of ids, as the library's decode(ids) gives it."""
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        ids = np.concatenate(texts).astype(np.int64) if len(texts) else np.zeros(0, np.int64)
        width = self.raw_size[ids]
        raw = self.raw[_spans(self.raw_start[ids], width)].tobytes()
        control = self.control[ids]
        upto, plain = np.r_[0, np.cumsum(width)], np.flatnonzero(~control)
        out, at = [], 0
        bounds = np.searchsorted(plain, np.r_[0, np.cumsum(sizes)]).tolist()
        for low, high in zip(bounds[:-1], bounds[1:], strict=True):
            if low == high:
                out.append("")
                continue
            first, last = plain[low], plain[high - 1]
            skip = int(self.space_led[ids[first]])  # the dummy prefix goes
            if last - first + 1 == high - low:
                out.append(raw[upto[first] + skip : upto[last + 1]].decode("utf-8", "eventloom-bytewise"))
            else:  # bytes on two sides of a control piece are no one character
                own = plain[low:high]
                ends = np.r_[np.flatnonzero(own[1:] != own[:-1] + 1), len(own) - 1]
                begins = np.r_[0, ends[:-1] + 1]
                out.append("".join(raw[upto[own[x]] + (skip if x == 0 else 0) : upto[own[y] + 1]].decode("utf-8", "eventloom-bytewise") for x, y in zip(begins, ends, strict=True)))
        return out

    def decode(self, ids: np.ndarray) -> str:
        return self.decode_all([ids])[0]


def _spans(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The indices start, start + 1, ... of each span, one after another."""
    total = int(sizes.sum())
    return np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(total)


_CODECS: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    if path not in _CODECS:
        _CODECS[path] = Codec(path)
    return _CODECS[path]


def _chunks(batch: pa.RecordBatch, text: str) -> Iterator[pa.RecordBatch]:
    """Slices of a batch: they share its memory, and only one at a time becomes Python strings."""
    sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_pylist()
    at = size = 0
    for k, n in enumerate(sizes):
        size += n
        if size >= CHUNK_BYTES or k == len(sizes) - 1:
            yield batch.slice(at, k + 1 - at)
            at, size = k + 1, 0


def _with(schema: T.StructType, name: str, kind: T.DataType, drop: str | None) -> T.StructType:
    return T.StructType([f for f in schema if f.name.lower() != name.lower() and f.name != drop] + [T.StructField(name, kind)])


def _put(batch: pa.RecordBatch, names: list[str], name: str, values: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), values], [*names, name])


def _encoder(schema: T.StructType, model: str, text: str, ids: str, keep_text: bool):
    schema = _with(schema, ids, T.BinaryType(), None if keep_text else text)
    names = [f.name for f in schema][:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model)
        for batch in batches:
            for part in _chunks(batch, text):
                out = c.encode([t or "" for t in part.column(text).to_pylist()])
                yield _put(part, names, ids, pa.array([x.tobytes() for x in out], pa.binary()))

    return schema, run


def _decoder(schema: T.StructType, model: str, ids: str, text: str, keep_ids: bool):
    schema = _with(schema, text, T.StringType(), None if keep_ids else ids)
    names = [f.name for f in schema][:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model)
        for batch in batches:
            for part in _chunks(batch, ids):
                out = c.decode_all([np.frombuffer(x.as_py() or b"", "<u4") for x in part.column(ids)])
                yield _put(part, names, text, pa.array(out, pa.string()))

    return schema, run


def encode(df: DataFrame, model: str, text: str = "text", ids: str = "ids", keep_text: bool = True) -> DataFrame:
    """Adds ``ids``, binary: the piece ids as little-endian unsigned 32-bit integers.

    That packed form is what token shards hold; :func:`decode` reads it back.
    """
    schema, run = _encoder(df.schema, model, text, ids, keep_text)
    return df.mapInArrow(run, schema)


def decode(df: DataFrame, model: str, ids: str = "ids", text: str = "decoded", keep_ids: bool = True) -> DataFrame:
    """Adds ``text``, a string: what the library's decode(ids) gives. Null ids count as none."""
    schema, run = _decoder(df.schema, model, ids, text, keep_ids)
    return df.mapInArrow(run, schema)


def round_trip(df: DataFrame, model: str, text: str = "text", ids: str = "ids", decoded: str = "decoded", keep_text: bool = False) -> DataFrame:
    """:func:`encode` and :func:`decode` of its ids, one after the other in the same Python worker, so that it holds the model once."""
    schema, first = _encoder(df.schema, model, text, ids, keep_text)
    schema, second = _decoder(schema, model, ids, decoded, True)
    return df.mapInArrow(lambda batches: second(first(batches)), schema)
