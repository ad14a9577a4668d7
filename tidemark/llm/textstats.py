"""Counts over whole texts of a block: words, symbols, repeated lines and repeated runs of words."""

from __future__ import annotations

import numpy as np

from tidemark.llm.buffers import distinct_spans, mixed, run_sums, word_spans

#: Characters that count as symbols.
SYMBOLS = b"#*$%&|<>"
WINDOW = 5

_symbol = np.zeros(256, bool)
_symbol[list(SYMBOLS)] = True


def _windows(words: np.ndarray, text: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of each run of WINDOW words within its text, the runs beginning at ``at``, and how often each number occurs."""
    h = mixed(text[at].astype(np.uint64) + np.uint64(1))
    with np.errstate(over="ignore"):
        for k in range(WINDOW):
            h = mixed(h + mixed(words[at + k].astype(np.uint64) + np.uint64(k)))
    _, one, which, times = np.unique(h, return_index=True, return_inverse=True, return_counts=True)
    often = np.flatnonzero(times[which] >= 2)
    first = at[one[which[often]]]
    if all((words[at[often] + k] == words[first + k]).all() for k in range(WINDOW)) and (text[at[often]] == text[first]).all():
        return which, times
    # Different runs of one hash: told apart word by word.
    which = text[at]
    for k in range(WINDOW):
        _, which = np.unique(which * (len(words) + 1) + words[at + k], return_inverse=True)
    return which, np.bincount(which)


def counts(raw: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of every text."""
    n = len(offsets) - 1
    start, end, by_text = word_spans(raw, offsets)
    blank = (raw == 0x20) | ((raw >= 9) & (raw <= 13))
    n_words = np.diff(by_text)
    out = {
        "n_words": n_words,
        "word_chars": run_sums((~blank & ((raw & 0xC0) != 0x80)).astype(np.int64), offsets),
        "n_symbols": run_sums(_symbol[raw].astype(np.int64), offsets),
        "n_dup_lines": np.zeros(n, np.int64),
        "n_repeat_words": np.zeros(n, np.int64),
    }
    if not len(start):
        return out
    # Lines: a text's end also ends a line.
    cut = np.unique(np.append(np.flatnonzero(raw == 10) + 1, offsets))
    begin, stop = cut[:-1], cut[1:]
    stop = stop - (raw[stop - 1] == 10)
    worded = np.searchsorted(start, stop) > np.searchsorted(start, begin)
    begin, stop = begin[worded], stop[worded]
    text = np.searchsorted(offsets, begin, side="right") - 1
    _, one = np.unique(text * (len(begin) + 1) + distinct_spans(raw, begin, stop)[2], return_index=True)
    out["n_dup_lines"] = np.bincount(text, minlength=n) - np.bincount(text[one], minlength=n)
    if len(start) >= WINDOW:
        words = distinct_spans(raw, start, end)[2]
        text = np.repeat(np.arange(n), n_words)
        m = len(words) - WINDOW + 1
        inside = np.flatnonzero(text[:m] == text[WINDOW - 1 :])
        which, times = _windows(words, text, inside)
        again = inside[times[which] >= 2]
        cover = np.zeros(len(words) + 1, np.int64)
        np.add.at(cover, again, 1)
        np.add.at(cover, again + WINDOW, -1)
        out["n_repeat_words"] = np.bincount(text[np.cumsum(cover)[:-1] > 0], minlength=n)
    return out
