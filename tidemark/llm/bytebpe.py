"""Byte-level BPE over blocks of text: pre-tokenisation by scans, merging by tables.

Pre-tokenisation reads an array of codepoint classes.  A small automaton says where a
token starts; its transition functions form a finite monoid, so that the states before
all characters come from a scan with the monoid's multiplication table (associative:
columns of many segments advance together, then the segments' totals are scanned).  No
regular expression runs.  The distinct slices of a block, found by hash, are merged once
each (the cache), all of one length class together, and their ids are dealt out to
every place where the slice stands.
"""

from __future__ import annotations

import base64
import heapq
import json
import sys
import unicodedata
from functools import lru_cache

import numpy as np

from tidemark.llm.buffers import BLOCK_BYTES, blocks, distinct_spans, ragged, same_spans

# Characters with the Unicode property White_Space.
WHITE_SPACE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
#: What may follow an apostrophe as one token with it.
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")

# Codepoint classes.
OTHER, LETTER, NUMBER, SPACE, BLANK, QUOTE = range(6)
# Symbols that the automaton reads: a class with what follows it.
S_LETTER, S_NUMBER, S_OTHER, S_QUOTE1, S_QUOTE2, S_BLANK_LAST, S_SPACE_LAST, S_SPACE_MID = range(8)
N_SYMBOLS = 8
# States: what the last character belongs to.
START, IN_L, IN_N, IN_O, IN_W, HELD, NEED1, NEED2, NEED1B, DONE = range(10)
N_STATES = 10


@lru_cache(1)
def class_table() -> np.ndarray:
    """Class of every codepoint."""
    kind = {"L": LETTER, "N": NUMBER}
    table = np.fromiter((kind.get(unicodedata.category(chr(c))[0], OTHER) for c in range(sys.maxunicode + 1)), np.uint8, sys.maxunicode + 1)
    table[WHITE_SPACE] = SPACE
    table[0x20], table[0x27] = BLANK, QUOTE
    return table


def _step(state: int, symbol: int, spaced: bool) -> tuple[int, bool]:
    """Next state, and whether a token starts at this character.

    spaced: a blank before a token belongs to it, numbers run on and white space makes
    tokens; else blanks part, each number stands alone and white space is dropped.
    """
    held = spaced and state == HELD
    if symbol == S_LETTER:
        if state in (NEED1, NEED1B):
            return DONE, False
        if state == NEED2:
            return NEED1B, False
        return IN_L, not (state == IN_L or held)
    if symbol == S_NUMBER:
        return IN_N, not (spaced and (state == IN_N or held))
    if symbol in (S_OTHER, S_QUOTE1, S_QUOTE2):
        if state == IN_O or held:
            return IN_O, False
        return {S_OTHER: IN_O, S_QUOTE1: NEED1, S_QUOTE2: NEED2}[symbol], True
    if not spaced:
        return START, True
    if symbol == S_SPACE_MID:
        return IN_W, state != IN_W
    return HELD if symbol == S_BLANK_LAST else START, True


class Scanner:
    """The automaton's monoid, and token starts by an associative scan."""

    def __init__(self, spaced: bool):
        moves = [[_step(q, x, spaced) for q in range(N_STATES)] for x in range(N_SYMBOLS)]
        # A text's first character starts anew: its function is constant.
        gens = [tuple(q for q, _ in m) for m in moves] + [(m[START][0],) * N_STATES for m in moves]
        self.starts = np.array([[s for _, s in m] for m in moves] + [[True] * N_STATES for _ in moves])
        index = {f: i for i, f in reversed(list(enumerate(dict.fromkeys([tuple(range(N_STATES)), *gens]))))}
        elements = list(dict.fromkeys([tuple(range(N_STATES)), *gens]))
        done = 0
        while done < len(elements):
            f = elements[done]
            for g in gens:
                h = tuple(g[q] for q in f)
                if h not in index:
                    index[h] = len(elements)
                    elements.append(h)
            done += 1
        k = len(elements)
        self.functions = np.array(elements, np.uint8)
        kind = np.uint8 if k <= 256 else np.uint16
        self.product = np.array([[index[tuple(elements[j][q] for q in elements[i])] for j in range(k)] for i in range(k)], kind)
        self.generator = np.array([index[g] for g in gens], kind)

    def prefixes(self, f: np.ndarray) -> np.ndarray:
        """Products f[0] ... f[i] for every i."""
        n = len(f)
        if n < 64:
            out = f.copy()
            for i in range(1, n):
                out[i] = self.product[out[i - 1], f[i]]
            return out
        rows = max(8, int(n**0.5) // 2)
        cols = -(-n // rows)
        padded = np.zeros(rows * cols, f.dtype)  # element 0 is the identity
        padded[:n] = f
        grid = np.ascontiguousarray(padded.reshape(cols, rows).T)
        k, flat = len(self.functions), self.product.ravel()
        for i in range(1, rows):
            grid[i] = flat[grid[i - 1].astype(np.int32) * k + grid[i]]
        before = np.zeros(cols, f.dtype)
        before[1:] = self.prefixes(np.ascontiguousarray(grid[-1]))[:-1]
        grid = flat[before.astype(np.int32)[None, :] * k + grid]
        return np.ascontiguousarray(grid.T).ravel()[:n]

    def token_starts(self, symbols: np.ndarray) -> np.ndarray:
        """symbols: with N_SYMBOLS added at each text's first character."""
        state = np.zeros(len(symbols), np.uint8)
        state[1:] = self.functions[self.prefixes(self.generator[symbols]), START][:-1]
        return self.starts[symbols, state]


@lru_cache(2)
def scanner(spaced: bool) -> Scanner:
    return Scanner(spaced)


def slices(raw: np.ndarray, offsets: np.ndarray, spaced: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte start and end of every token slice, and n + 1 slice offsets by text."""
    if not len(raw):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    points = np.frombuffer(raw.tobytes().decode().encode("utf-32-le"), np.uint32)
    lead = np.flatnonzero((raw & 0xC0) != 0x80)
    first = np.searchsorted(lead, offsets[:-1][offsets[1:] > offsets[:-1]])
    kind = class_table()[points]
    white = (kind == SPACE) | (kind == BLANK)
    last = np.zeros(len(points), bool)  # of its text
    last[first[1:] - 1] = last[-1] = True
    after_white = np.ones(len(points), bool)
    after_white[:-1] = white[1:]
    after_white |= last
    symbols = np.array([S_OTHER, S_LETTER, S_NUMBER, S_SPACE_LAST, S_BLANK_LAST, S_OTHER], np.uint8)[kind]
    symbols[white & after_white] = S_SPACE_MID
    quote = np.flatnonzero(kind == QUOTE)
    if len(quote):
        text_of = np.searchsorted(first, quote, side="right")
        ends = np.append(first[1:], len(points))[text_of - 1]
        padded = np.append(points, [0, 0]).astype(np.uint32)
        one, two = np.where(quote + 1 < ends, padded[quote + 1], 0), np.where(quote + 2 < ends, padded[quote + 2], 0)
        for c in CONTRACTIONS:
            if len(c) == 1:
                symbols[quote[one == ord(c)]] = S_QUOTE1
            else:
                symbols[quote[(one == ord(c[0])) & (two == ord(c[1]))]] = S_QUOTE2
    symbols[first] += N_SYMBOLS
    at = np.flatnonzero(scanner(spaced).token_starts(symbols))
    start = lead[at]
    end = np.append(start[1:], len(raw))
    if not spaced:
        keep = ~white[at]
        start, end = start[keep], end[keep]
    return start, end, np.searchsorted(start, offsets)


class Merges:
    """A vocabulary's merges as a hash table from pairs of ids to (rank, id)."""

    #: Slices of more bytes are merged one by one with a heap.
    LONG = 64

    def __init__(self, first: np.ndarray, final: np.ndarray, pairs: list[tuple[int, int, int, int]], strings: dict[int, bytes], spaced: bool):
        """first, final: the id of each byte within a slice and at its end; pairs: (left, right, rank, id)."""
        self.first, self.final, self.spaced, self.strings = first, final, spaced, strings
        self.bits = max(10, int(len(pairs) * 4).bit_length())
        size = 1 << self.bits
        self.keys, self.ranks, self.made = np.full(size, -1, np.int64), np.full(size, 2**31 - 1, np.int32), np.zeros(size, np.int32)
        table = np.array(pairs, np.int64).reshape(-1, 4)
        left = (table[:, 0] << 32) | table[:, 1]
        todo, step = np.arange(len(left)), 0
        slot = self._slot(left)
        while len(todo):
            at = (slot[todo] + step) & (size - 1)
            free = self.keys[at] == -1
            cand, where = todo[free], at[free]
            _, one = np.unique(where, return_index=True)
            won = cand[one]
            spot = (slot[won] + step) & (size - 1)
            self.keys[spot], self.ranks[spot], self.made[spot] = left[won], table[won, 2], table[won, 3]
            todo = np.setdiff1d(todo, won, assume_unique=True)
            step += 1
        self.probes = step

    def _slot(self, key: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Slot of each pair, or -1."""
        key = (a.astype(np.int64) << 32) | b.astype(np.int64)
        at = self._slot(key)
        seen = self.keys[at]
        out = np.where(seen == key, at, -1)
        left = np.flatnonzero((out < 0) & (seen != -1))
        for step in range(1, self.probes):
            if not len(left):
                break
            spot = (at[left] + step) & (len(self.keys) - 1)
            seen = self.keys[spot]
            hit = seen == key[left]
            out[left[hit]] = spot[hit]
            left = left[~hit & (seen != -1)]
        return out

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        slot = self.find(a, b)
        return np.where(slot >= 0, self.ranks[slot], 2**31 - 1).astype(np.int32)

    def merged(self, raw: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of each slice: (flat ids, start, count)."""
        n = len(start)
        count = np.zeros(n, np.int64)
        parts: list[np.ndarray] = []
        places: list[np.ndarray] = []
        order = np.argsort(length, kind="stable")
        edges = [0, 1, 2, 3, 4, 6, 8, 10, 12, 16, 24, 40, self.LONG]
        for lo, hi in zip(edges, edges[1:]):
            rows = order[np.searchsorted(length[order], lo, "right") : np.searchsorted(length[order], hi, "right")]
            if len(rows):
                flat, c = self._together(raw, start[rows], length[rows], hi)
                parts.append(flat)
                places.append(rows)
                count[rows] = c
        for row in order[np.searchsorted(length[order], self.LONG, "right") :]:
            ids = self._alone(raw[start[row] : start[row] + length[row]])
            parts.append(ids)
            places.append(np.array([row]))
            count[row] = len(ids)
        begin = np.zeros(n, np.int64)
        if not parts:
            return np.zeros(0, np.int32), begin, count
        by = np.concatenate(places)
        begin[by] = np.cumsum(count[by]) - count[by]
        return np.concatenate(parts), begin, count

    def _together(self, raw, start, length, width) -> tuple[np.ndarray, np.ndarray]:
        """Many short slices at once, each round the best pair of every one: rows of linked lists."""
        n, none, w = len(start), np.int32(2**31 - 1), width + 2  # a column before and one behind
        cols = np.arange(width)
        real = cols < length[:, None]
        ids = np.full((n, w), -1, np.int32)
        ids[:, 1:-1] = np.where(real, self.first[raw[np.minimum(start[:, None] + cols, len(raw) - 1)]], -1)
        flat = ids.ravel()
        base = np.arange(n) * w
        flat[base + length] = self.final[raw[start + length - 1]]
        alive = np.zeros((n, w), bool)
        alive[:, 1:-1] = real
        ranks = np.full((n, w), none, np.int32)
        r, c = np.nonzero(real[:, 1:])
        c += 1
        ranks[r, c] = self.rank(ids[r, c], ids[r, c + 1])
        after = np.tile(np.arange(1, w + 1, dtype=np.int8), (n, 1)).ravel()
        before = np.tile(np.arange(-1, w - 1, dtype=np.int8), (n, 1)).ravel()
        flat_ranks, flat_alive = ranks.ravel(), alive.ravel()
        rows = np.flatnonzero(length > 1)
        while len(rows):
            p = (ranks if len(rows) == n else ranks[rows]).argmin(1)
            i = base[rows] + p
            on = flat_ranks[i] != none
            if not on.all():
                rows, i = rows[on], i[on]
                if not len(rows):
                    break
            top = base[rows]
            j = top + after[i]
            new = self.made[self.find(flat[i], flat[j])]
            behind = after[j]
            flat[i], flat_ranks[j], flat_alive[j] = new, none, False
            after[i] = behind
            k = top + behind
            before[k] = i - top
            h = top + before[i]
            flat_ranks[i] = self.rank(new, flat[k])
            flat_ranks[h] = self.rank(flat[h], new)
        return ids[alive], alive.sum(1)

    def _alone(self, piece: np.ndarray) -> np.ndarray:
        """One long slice: a heap of (rank, place) over a linked list."""
        ids = self.first[piece].astype(np.int64)
        ids[-1] = self.final[piece[-1]]
        n = len(ids)
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        ranks = self.rank(ids[:-1], ids[1:])
        heap = [(int(r), i, int(a), int(b)) for i, (r, a, b) in enumerate(zip(ranks, ids[:-1], ids[1:])) if r != 2**31 - 1]
        heapq.heapify(heap)
        table = self.lookup()
        gone = np.zeros(n, bool)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if gone[i] or j >= n or ids[i] != a or ids[j] != b:
                continue
            ids[i] = table[a, b][1]
            gone[j] = True
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if 0 <= x and y < n and (hit := table.get((int(ids[x]), int(ids[y])))):
                    heapq.heappush(heap, (hit[0], int(x), int(ids[x]), int(ids[y])))
        return ids[~gone].astype(np.int32)

    def lookup(self) -> dict[tuple[int, int], tuple[int, int]]:
        if not hasattr(self, "_lookup"):
            used = np.flatnonzero(self.keys >= 0)
            self._lookup = {(int(k >> 32), int(k & 0xFFFFFFFF)): (int(r), int(m)) for k, r, m in zip(self.keys[used], self.ranks[used], self.made[used])}
        return self._lookup

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k[0] != "_"}

    def encode(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts of one block, joined, and n + 1 offsets by text."""
        start, end, by_text = slices(raw, offsets, self.spaced)
        if not len(start):
            return np.zeros(0, np.int32), np.zeros(len(offsets), np.int64)
        key, one, which = distinct_spans(raw, start, end)
        flat, begin, count = self._cached(key, raw, start[one], (end - start)[one])
        ids, at = ragged(flat, begin[which], count[which])
        return ids, at[by_text]

    #: Merged slices kept from block to block; beyond so many all are forgotten, which costs time only.
    CACHED = 300_000

    def _cached(self, key, raw, start, length) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of different slices, merging only what no earlier block had; a slice's bytes must be the kept ones."""
        runs = self.__dict__.setdefault("_runs", [])
        begin, count = np.full(len(key), -1, np.int64), np.zeros(len(key), np.int64)
        flats, base = [], 0
        for r in runs:
            open_ = np.flatnonzero(begin < 0)
            at = np.minimum(np.searchsorted(r["key"], key[open_]), len(r["key"]) - 1)
            hit = (r["key"][at] == key[open_]) & (r["length"][at] == length[open_])
            long = np.flatnonzero(hit & (length[open_] > 7))
            hit[long] = same_spans(raw, start[open_[long]], r["bytes"], r["place"][at[long]], length[open_[long]])
            begin[open_[hit]], count[open_[hit]] = r["begin"][at[hit]] + base, r["count"][at[hit]]
            flats.append(r["flat"])
            base += len(r["flat"])
        miss = np.flatnonzero(begin < 0)
        if len(miss):
            flat, starts, counts = self.merged(raw, start[miss], length[miss])
            begin[miss], count[miss] = starts + base, counts
            flats.append(flat)
            kept, place = ragged(raw, start[miss], length[miss])
            runs.append(_sorted({"key": key[miss], "begin": starts, "count": counts, "length": length[miss], "place": place[:-1], "flat": flat, "bytes": kept}))
        if len(runs) > 6:
            few = sum(len(r["key"]) for r in runs) <= self.CACHED
            self._runs = [_joined(runs)] if few else []
        return np.concatenate(flats), begin, count


def _sorted(run: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """A run of kept slices in order of their keys; flat ids and bytes stay."""
    order = np.argsort(run["key"], kind="stable")
    return {k: v if k in ("flat", "bytes") else v[order] for k, v in run.items()}


def _joined(runs: list[dict[str, np.ndarray]]) -> dict[str, np.ndarray]:
    out = {k: np.concatenate([r[k] for r in runs]) for k in runs[0]}
    n = [len(r["key"]) for r in runs]
    out["begin"] += np.repeat(np.cumsum([0, *(len(r["flat"]) for r in runs[:-1])]), n)
    out["place"] += np.repeat(np.cumsum([0, *(len(r["bytes"]) for r in runs[:-1])]), n)
    return _sorted(out)


def _pieces(strings: dict[bytes, int]) -> list[tuple[int, int, int, int]]:
    """Every way to make a string of two: as the ranks say, joined at that rank."""
    return [(strings[s[:i]], strings[s[i:]], r, r) for s, r in strings.items() for i in range(1, len(s)) if s[:i] in strings and s[i:] in strings]


def from_ranks(path: str) -> Merges:
    """A rank file: a line for each string, in base 64, and its rank, which is its id."""
    with open(path, "rb") as f:
        strings = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f) if a}
    single = np.array([strings[bytes([b])] for b in range(256)], np.int32)
    return Merges(single, single, _pieces(strings), {v: k for k, v in strings.items()}, True)


def byte_letters() -> list[str]:
    """The visible character that stands for each byte in byte-level vocabularies: printable Latin-1 itself, others from U+0100 on in order."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = iter(range(0x100, 0x200))
    return [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]


def from_json(path: str) -> Merges:
    """A tokenizer file with a byte-level BPE model: numbered strings and a list of merges."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model = spec["model"]
    vocab, suffix = model["vocab"], model.get("end_of_word_suffix") or ""
    letters = byte_letters()
    back = {c: b for b, c in enumerate(letters)}
    first = np.array([vocab[c] for c in letters], np.int32)
    final = np.array([vocab[c + suffix] for c in letters], np.int32)
    pairs = []
    for rank, pair in enumerate(model["merges"]):
        a, b = pair.split(" ") if isinstance(pair, str) else pair
        pairs.append((vocab[a], vocab[b], rank, vocab[a + b]))
    strings = {i: bytes(back[c] for c in s.removesuffix(suffix) if c in back) for s, i in vocab.items()}
    return Merges(first, final, pairs, strings, spec["normalizer"] is None)


class ByteTable:
    """Byte strings by number, joined by arrays of numbers without a loop."""

    def __init__(self, strings: dict[int, bytes]):
        n = max(strings) + 1
        self.length = np.zeros(n, np.int64)
        for i, s in strings.items():
            self.length[i] = len(s)
        self.start = np.cumsum(self.length) - self.length
        self.flat = np.frombuffer(b"".join(strings.get(i, b"") for i in range(n)), np.uint8)

    def join(self, ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        out, at = ragged(self.flat, self.start[ids], self.length[ids])
        return out, at[offsets]


def encode_texts(merges: Merges, raw: np.ndarray, offsets: np.ndarray, most: int = BLOCK_BYTES):
    """(first, last + 1, ids, offsets) for each block of whole texts."""
    for first, last, part, at in blocks(raw, offsets, most):
        ids, by_text = merges.encode(part, at)
        yield first, last, ids, by_text
