"""A probabilistic suffix tree over words: training over all texts, scores for all texts.

Symbols are lower-cased words, an end symbol, and a begin symbol that is only context.  A
context of up to ``DEPTH`` symbols lists the next symbols that follow it ``LEAST`` times or
more in the training texts, a fixed number, so that the tree grows with the corpus.  It is
retained as a state if its next-symbol distribution diverges from that of its longest
retained suffix: count times divergence must exceed ``GAIN`` for each next symbol that it
lists.  Listed next symbols get (c - DISCOUNT) / n; what is left goes to all others in the
suffix's proportions, down to the root, the add-one distribution of single words.  A
token is scored by the longest retained suffix of what precedes it in its text.

The tree is never in one place.  Texts become chunks of local word numbers, written once.
Each chunk asks for its distinct words' counts and numbers (one shuffle, by ranges of the
words' keys).  Then it sends its distinct windows (a symbol and the DEPTH before it) with
their training counts to the tasks of their last context word: all contexts that end with
a word, their next symbols and the suffixes that they are compared with meet there, so a
task fits its branches of the tree by itself and answers each window with what its state
adds to the base score.  Words
are told apart by 64-bit keys; an answer is a multiple of ``STEP``, so a token's is within
2e-8 of its logarithm.

Defined results: a null or empty text is the end symbol alone; a null doc_id counts as
training text; repeated rows are counted and scored each; with no training text every
token has the base probability one; columns besides id and text are not read.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.buffers import ascii_lower, blocks, mixed, packed, run_sums, span_keys, text_buffer, unpacked, word_spans
from tidemark.llm.shared import dropped, map_arrow, written

LEAST, DEPTH, DISCOUNT, GAIN = 2, 3, 0.75, 2.0
HELD_MOD, HELD_REST = 7, 2
#: Key of the end symbol; no word has it but by chance.
END = np.uint64(0xE0D)
#: Numbers of no symbol (or one that stands less than LEAST times) and of the begin symbol; words have others.
NONE, BEGIN = 0, 1
#: Bytes of text of a chunk.
CHUNK_BYTES = 4_000_000
#: Distinct words of one range of keys, windows of one task's group, about.
RANGE_WORDS, RANGE_WINDOWS = 1_000_000, 1_000_000
#: Of the logarithms that come back, which stay within 13 above and 36 below zero.
STEP = 2.0**-25


def chunks(df: DataFrame) -> DataFrame:
    """(doc_id, text) as chunks: word numbers of whole texts, the sorted hashes that they number, and training counts."""

    def run(batches):
        task, n = TaskContext.get().partitionId(), 0
        for batch in batches:
            ids = batch.column(0)
            raw, offsets = text_buffer(batch.column(1))
            for a, b, part, at in blocks(raw, offsets, CHUNK_BYTES):
                docs = ids.slice(a, b - a)
                held = np.array([d is not None and zlib.crc32(b"%d" % d) % HELD_MOD == HELD_REST for d in docs.to_pylist()], bool)
                low = ascii_lower(part)
                start, end, by_text = word_spans(low, at)
                more = np.arange(len(by_text))
                sizes = np.diff(by_text) + 1
                keys = np.full(len(start) + b - a, END)
                keep = np.ones(len(keys), bool)
                keep[by_text[1:] + more[:-1]] = False
                keys[keep] = span_keys(low, start, end)
                vocab, codes = np.unique(keys, return_inverse=True)
                counts = np.bincount(codes[np.repeat(~held, sizes)], minlength=len(vocab))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([(task << 32) + n]), pa.array([docs.to_pylist()], pa.list_(pa.int64())), pa.array([held.tobytes()]), pa.array([sizes.astype("<i4").tobytes()]), pa.array([packed(codes.astype("<u4"))]), pa.array([packed(vocab)]), pa.array([packed(counts.astype("<i4"))]), pa.array([int(sizes[~held].sum())]), pa.array([len(keys)]), pa.array([len(vocab)])],
                    names=["chunk", "docs", "held", "sizes", "codes", "vocab", "counts", "train_tokens", "tokens", "words"],
                )
                n += 1

    return df.mapInArrow(run, "chunk long, docs array<long>, held binary, sizes binary, codes binary, vocab binary, counts binary, train_tokens long, tokens long, words long")


def word_counts(parts: DataFrame, least: int) -> DataFrame:
    """For each chunk and range of keys, its words' corpus counts and numbers, in order; with chunk -1 the number of the range's words.

    Numbers follow frequency, range by range, so that common words have small ones; words
    that are counted less than ``least`` times have none.
    """
    words = parts.agg(F.sum("words")).first()[0] or 0
    bits = max(4, int(words / RANGE_WORDS).bit_length())

    def ask(batch):
        for chunk, vocab, counts in zip(*(c.to_pylist() for c in batch.columns)):
            keys, counts = unpacked(vocab, "<u8"), unpacked(counts, "<i4")
            n = np.searchsorted(keys, np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits))
            n = np.append(n, len(keys))
            full = np.flatnonzero(np.diff(n))
            yield {"span": full, "chunk": np.full(len(full), chunk), "keys": [packed(keys[n[i] : n[i + 1]]) for i in full], "counts": [packed(counts[n[i] : n[i + 1]]) for i in full]}

    def answer(rows: pa.Table) -> pa.Table:
        asked = [unpacked(x, "<u8") for x in rows["keys"].to_pylist()]
        at = np.append(0, np.cumsum([len(x) for x in asked]))
        distinct, which = np.unique(np.concatenate(asked), return_inverse=True)
        total = np.bincount(which, np.concatenate([unpacked(x, "<i4") for x in rows["counts"].to_pylist()]), len(distinct)).astype("<i8")
        span = rows["span"][0].as_py()
        rank = np.empty(len(distinct), "<i8")
        rank[np.argsort(-total, kind="stable")] = np.arange(len(distinct))
        number = np.where(total >= least, 2 + (rank << bits) + span, NONE)[which]
        back = total[which]
        return pa.table({
            "chunk": [*rows["chunk"].to_pylist(), -1],
            "span": pa.array([span] * (len(rows) + 1), pa.int32()),
            "counts": pa.array([*(packed(back[p:q]) for p, q in zip(at, at[1:])), None], pa.binary()),
            "numbers": pa.array([*(packed(number[p:q]) for p, q in zip(at, at[1:])), None], pa.binary()),
            "types": [0] * len(rows) + [int((total > 0).sum())],
        })

    asked = map_arrow(parts.select("chunk", "vocab", "counts"), ask, "span int, chunk long, keys binary, counts binary")
    return written(asked.groupBy("span").applyInArrow(answer, "chunk long, span int, counts binary, numbers binary, types long"), "counts")


def by_chunk(answers: DataFrame, *columns: str) -> DataFrame:
    """A chunk's answers in the order of their ranges: arrays of the columns."""
    lists = F.array_sort(F.collect_list(F.struct("span", *columns)))
    return answers.groupBy("chunk").agg(lists.alias("found")).select("chunk", *(F.col("found")[c].alias(c) for c in columns))


def numbered(parts: DataFrame, counts: DataFrame, tokens: int, types: int) -> DataFrame:
    """Chunks with their words' numbers (one code for all that have none) and training counts, known tokens and base scores."""
    joined = parts.select("chunk", "docs", "held", "sizes", "codes").join(by_chunk(counts.where("chunk >= 0"), "counts", "numbers"), "chunk")

    def make(batch):
        for chunk, docs, held, sizes, codes, counts, numbers in zip(*(c.to_pylist() for c in batch.columns)):
            codes, at = unpacked(codes, "<u4"), np.append(0, np.cumsum(np.frombuffer(sizes, "<i4"), dtype=np.int64))
            c = np.concatenate([unpacked(x, "<i8") for x in counts])
            symbols, which = np.unique(np.concatenate([unpacked(x, "<i8") for x in numbers]), return_inverse=True)
            times = np.zeros(len(symbols), "<i8")
            times[which] = c
            times[symbols == NONE] = 0
            yield {
                "chunk": [chunk],
                "docs": [docs],
                "held": [held],
                "sizes": [sizes],
                "codes": [packed(which[codes].astype("<u4"))],
                "numbers": [packed(symbols)],
                "times": [packed(times)],
                "known": [run_sums((c > 0)[codes].astype(np.int64), at).tobytes()],
                "base": [_sums(np.log10((c + 1) / (tokens + types + 1))[codes], at).tobytes()],
            }

    return written(map_arrow(joined, make, "chunk long, docs array<long>, held binary, sizes binary, codes binary, numbers binary, times binary, known binary, base binary"), "numbered")


def paired(g: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each (g, x) the first place and which one of the sorted ones it is; both are at least zero.

    As numpy's unique, in half its memory: a group of a common word holds millions.
    """
    if len(g) and (int(g.max()) + 1) * (int(x.max()) + 1) >= 2**63:
        x = np.unique(x, return_inverse=True)[1]
        g = np.unique(g, return_inverse=True)[1]
    key = g * np.int64(int(x.max(initial=0)) + 1) + x
    order = np.argsort(key, kind="stable")
    key = key[order]
    new = np.append(True, key[1:] != key[:-1])[: len(key)]
    del key
    first = order[new]
    which = np.empty(len(order), np.int32)
    which[order] = np.cumsum(new, dtype=np.int32) - np.int32(1)
    return first, which


class Windows:
    """A chunk's distinct windows: ``columns`` are the numbers of the DEPTH symbols before, nearest first, and the symbol's."""

    def __init__(self, sizes: bytes, held: bytes, codes: bytes, numbers: bytes, times: bytes, depth: int):
        sizes, held, codes, numbers = np.frombuffer(sizes, "<i4"), np.frombuffer(held, bool), unpacked(codes, "<u4"), unpacked(numbers, "<i8")
        symbol = numbers[codes]
        place = np.arange(len(symbol)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        before, there = [], np.ones(len(symbol), bool)
        for k in range(1, depth + 1):
            x = np.append(np.zeros(min(k, len(symbol)), np.int64), symbol[:-k])
            x = np.where(place >= k, x, np.where(place == k - 1, BEGIN, NONE))
            there &= x != NONE
            before.append(np.where(there, x, NONE))
        #: Tokens that have a context, and each one's window.
        self.tokens = np.flatnonzero(before[0] != NONE)
        g = before[0][self.tokens]
        for x in [*before[1:], symbol]:
            first, g = paired(g, x[self.tokens])
        self.which = g
        first = self.tokens[first]
        self.columns = [x[first] for x in (*before, symbol)]
        self.counts = np.bincount(g, np.repeat(~held, sizes)[self.tokens], len(first)).astype("<i4")
        self.numbers, self.times = numbers, unpacked(times, "<i8")

    def of(self, number: np.ndarray) -> np.ndarray:
        """Training counts of words by their numbers in this chunk."""
        return self.times[np.minimum(np.searchsorted(self.numbers, number), len(self.numbers) - 1)]


    def blob(self, at: np.ndarray) -> tuple[bytes, int]:
        """Some windows in their order, compressed at once, and how many different symbols they have; ``_opened`` undoes it."""
        near, *far, symbol = (x[at] for x in self.columns)
        symbols, s = np.unique(symbol, return_inverse=True)
        if far:  # sorted for each nearest symbol
            far[0] = np.where(np.diff(near, prepend=-1) != 0, far[0], np.diff(far[0], prepend=0))
        columns = [np.diff(near, prepend=0), *far, np.diff(symbols, prepend=0), self.of(symbols), s.astype("<u4"), self.counts[at]]
        data = b"".join(np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes() for x in columns)
        return zstandard.ZstdCompressor(level=1, write_content_size=True).compress(data), len(symbols)


def _opened(blob: bytes, rows: int, symbols: int, depth: int) -> list[np.ndarray]:
    """Columns of a blob's windows: the symbols before, the symbol, its training count, the window's."""
    data, at, columns = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8), 0, []
    for n, kind in [(rows, "<i8")] * depth + [(symbols, "<i8")] * 2 + [(rows, "<u4"), (rows, "<i4")]:
        width = np.dtype(kind).itemsize
        columns.append(np.ascontiguousarray(data[at : at + n * width].reshape(width, n).T).view(kind).ravel())
        at += n * width
    *before, names, times, s, counts = columns
    before[0] = np.cumsum(before[0])
    if depth > 1:
        sums, opens = np.cumsum(before[1]), np.diff(before[0], prepend=-1) != 0
        before[1] = sums - (sums - before[1])[opens][np.cumsum(opens) - 1]
    return [*before, np.cumsum(names)[s], times[s], counts]


def _group(rows: pa.Table, at: np.ndarray, depth: int) -> list[np.ndarray]:
    """Columns of a group's windows: each blob is opened into its place, so that none is held twice."""
    columns = [np.empty(at[-1], kind) for kind in ["<i8"] * (depth + 2) + ["<i4"]]
    for a, b, blob, symbols in zip(at, at[1:], rows["windows"], rows["symbols"].to_pylist()):
        for column, part in zip(columns, _opened(blob.as_py(), int(b - a), symbols, depth)):
            column[a:b] = part
    return columns


def extended(p: np.ndarray, context: np.ndarray, symbol: np.ndarray, counts: np.ndarray, on: np.ndarray, least: int) -> np.ndarray:
    """Probabilities of windows by contexts of one more symbol, given those by their suffixes; ``on``: windows that have such a context."""
    if not len(on):
        return p
    g, s = context[on], symbol[on]
    first, entry = paired(g, s)
    times, total = np.bincount(g, counts[on]), np.bincount(entry, counts[on])
    of = g[first]
    listed = np.flatnonzero((total >= least) & (s[first] != NONE))
    c, own, low = total[listed], of[listed], p[on[first[listed]]]
    mine = np.zeros(len(first))
    mine[listed] = (c - DISCOUNT) / times[own]
    state, rest = states(*(np.bincount(own, x, len(times)) for x in (np.ones(len(c)), c * np.log(mine[listed] / low), mine[listed], low)))
    out = p.copy()
    at = state[g]
    out[on[at]] = np.where(mine[entry[at]] > 0, mine[entry[at]], p[on[at]] * rest[g[at]])
    return out


def states(listed: np.ndarray, gain: np.ndarray, given: np.ndarray, given_low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which contexts are retained, and the factor of what they leave to their suffixes."""
    left, left_low = 1 - given, 1 - given_low
    state = (listed > 0) & (gain > GAIN * listed) & (left > 1e-12) & (left_low > 1e-12)
    return state, np.where(state, left, 1) / np.where(state, left_low, 1)


def asked(chunks: DataFrame, bits: int, depth: int) -> DataFrame:
    """Blobs of windows, by chunk and group of last context words."""

    def make(batch):
        for chunk, *row in zip(*(c.to_pylist() for c in batch.columns)):
            w = Windows(*row, depth)
            for span, at in _groups(w, bits):
                blob, symbols = w.blob(at)
                yield {"span": [span], "chunk": [chunk], "windows": [blob], "rows": [len(at)], "symbols": [symbols]}

    return map_arrow(chunks.select("chunk", "sizes", "held", "codes", "numbers", "times"), make, "span int, chunk long, windows binary, rows int, symbols int")


def _groups(w: Windows, bits: int):
    """(group, places of its windows) of a chunk, in order."""
    group = (mixed(w.columns[0].astype(np.uint64)) >> np.uint64(64 - bits)).astype(np.int64)
    order = np.argsort(group, kind="stable")
    edge = np.flatnonzero(np.diff(group[order], prepend=-1))
    for p, q in zip(edge, np.append(edge[1:], len(order))):
        yield int(group[order[p]]), order[p:q]


def fitted(asks: DataFrame, size: int, depth: int, least: int) -> DataFrame:
    """What the states of each window's contexts add to its base score, by chunk and group; ``size``: the root's denominator."""

    def answer(rows: pa.Table) -> pa.Table:
        at = np.append(0, np.cumsum(rows["rows"].to_numpy(), dtype=np.int64))
        *before, symbol, times, counts = _group(rows, at, depth)
        # a symbol without a number gets a factor of whatever its base probability is
        root = np.where(symbol == NONE, 1.0, (times + 1) / size)
        del times
        p, context = root, np.zeros(len(symbol), np.int32)
        while before:  # a column goes when it was read
            x = before.pop(0)
            context, on = paired(context, x)[1], np.flatnonzero(x != NONE)
            del x
            p = extended(p, context, symbol, counts, on, least)
        adds = np.rint(np.log10(p / root) / STEP).astype("<i4")
        return pa.table({"chunk": rows["chunk"], "span": rows["span"], **_tallied([adds[a:b] for a, b in zip(at, at[1:])])})

    return asks.groupBy("span").applyInArrow(answer, "chunk long, span int, adds binary, which binary")


def _tallied(answers: list[np.ndarray]) -> dict[str, pa.Array]:
    """The different values of each, and which of them every place has: windows of a context share what it leaves to its suffix."""
    pairs = [np.unique(x, return_inverse=True) for x in answers]
    return {"adds": pa.array([packed(u) for u, _ in pairs], pa.binary()), "which": pa.array([packed(i.astype("<u4")) for _, i in pairs], pa.binary())}


def score(df: DataFrame, least: int = LEAST, depth: int = DEPTH) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score for every row of (doc_id, text)."""
    parts = written(chunks(df), "chunks")
    tokens, every = parts.agg(F.sum("train_tokens"), F.sum("tokens")).first()
    tokens, every = tokens or 0, every or 0
    counts = word_counts(parts, least)
    types = counts.where("chunk = -1").agg(F.sum("types")).first()[0] or 0
    known = numbered(parts, counts, tokens, types)
    dropped(parts, counts)
    bits = max(4, int(every / RANGE_WINDOWS).bit_length())
    answers = written(fitted(asked(known, bits, depth), tokens + types + 1, depth, least), "answers")
    joined = known.join(by_chunk(answers, "adds", "which"), "chunk", "left").select("docs", "known", "base", "sizes", "held", "codes", "numbers", "times", "adds", "which")

    def make(batch):
        for docs, n_known, base, *row, adds, which in zip(*(c.to_pylist() for c in batch.columns)):
            w = Windows(*row, depth)
            sizes, held, base = np.frombuffer(row[0], "<i4"), np.frombuffer(row[1], bool), np.frombuffer(base, "<f8")
            value = np.zeros(len(w.counts))
            for (_, at), x, i in zip(_groups(w, bits), adds or [], which or []):
                value[at] = unpacked(x, "<i4")[unpacked(i, "<u4")] * STEP
            by_token = np.zeros(int(sizes.sum()))
            by_token[w.tokens] = value[w.which]
            yield {
                "doc_id": docs,
                "held_out": held,
                "n_tokens": sizes.astype(np.int64),
                "n_known": np.frombuffer(n_known, np.int64),
                "train_tokens": np.full(len(sizes), tokens),
                "base_score": base,
                "score": base + _sums(by_token, np.append(0, np.cumsum(sizes, dtype=np.int64))),
            }

    return map_arrow(joined, make, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def _sums(x: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sums of the runs, each added up by itself."""
    return np.add.reduceat(x, at[:-1]) if len(x) else np.zeros(len(at) - 1)


def op1_suffix_tree(spark, sf_dir: str) -> DataFrame:
    """Every whole text of documents, scored by a tree learnt from those that aren't held out."""
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").cast("long"), "text"))
