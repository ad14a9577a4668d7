"""Encoding with the two tokenizer files of JSON form, for packing and for files of ids.

The ids equal those of the ``tokenizers`` library as it loads the file, without special
tokens put round a text: where a text holds the string of one of the file's added tokens
it is cut there, the string becomes that token's id and the parts are encoded by
themselves.  Without ``added`` such strings are ordinary text, as with the library's
``encode_special_tokens``.  Tests hold both against it.  The library itself takes some six
times the CPU for running text, as it merges every word anew.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np

from tidemark.llm import bytebpe
from tidemark.llm.buffers import ascii_lower, blocks


def normalised(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each text in NFC and in lower case, letter by letter (a sigma at a word's end is no exception)."""
    if not (raw >= 128).any():
        return ascii_lower(raw), offsets
    whole, out = raw.tobytes(), []
    for p, q in zip(offsets, offsets[1:]):
        text = whole[p:q]
        if text.isascii():
            out.append(text.lower())
            continue
        s = text.decode()
        if not unicodedata.is_normalized("NFC", s):
            s = unicodedata.normalize("NFC", s)
        out.append(s.replace("Σ", "σ").lower().encode())
    at = np.zeros(len(offsets), np.int64)
    np.cumsum([len(x) for x in out], out=at[1:])
    return np.frombuffer(b"".join(out), np.uint8), at


def added_tokens(path: str) -> dict[bytes, int]:
    """The strings of a tokenizer file's added tokens and their ids."""
    with open(path, encoding="utf-8") as f:
        tokens = json.load(f)["added_tokens"]
    if any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in tokens):
        raise ValueError(f"added tokens other than plain strings: {path}")
    return {t["content"].encode(): t["id"] for t in tokens}


def _encoded(merges: bytebpe.Merges, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return merges.encode(*((raw, offsets) if merges.spaced else normalised(raw, offsets)))


def _cut(merges: bytebpe.Merges, raw: np.ndarray, offsets: np.ndarray, added: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    """Ids and n + 1 offsets by text; every second section of a text, if it has more than one, is an added token."""
    whole = raw.tobytes()
    if not any(x in whole for x in added):
        return _encoded(merges, raw, offsets)
    strings = re.compile(b"|".join(re.escape(x) for x in sorted(added, key=len, reverse=True)))
    cuts, tokens, first = [], [], []
    for p, q in zip(offsets.tolist(), offsets[1:].tolist()):
        first.append(len(cuts))
        cuts.append(p)
        tokens.append(-1)
        for m in strings.finditer(whole, p, q):
            cuts += m.span()
            tokens += added[m[0]], -1
    token = np.array(tokens)
    ids, at = _encoded(merges, raw, np.array([*cuts, len(raw)]))
    size = np.diff(at)
    sizes = np.where(token >= 0, 1, size)
    by_section = np.append(0, np.cumsum(sizes))
    out = np.repeat(token, sizes).astype(np.int32)
    out[out < 0] = ids[np.repeat(token < 0, size)]
    return out, by_section[np.array([*first, len(token)])]


def with_end(merges: bytebpe.Merges, raw: np.ndarray, offsets: np.ndarray, end: int, added: dict[bytes, int] | None = None) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first, last + 1, ids, offsets) of blocks of texts, an end id after each text's ids; added: as of added_tokens."""
    for a, b, part, at in blocks(raw, offsets):
        ids, by_text = _cut(merges, part, at, added or {})
        more = np.arange(len(by_text))
        out = np.full(len(ids) + b - a, end, np.int32)
        keep = np.ones(len(out), bool)
        keep[by_text[1:] + more[:-1]] = False
        out[keep] = ids
        yield a, b, out, by_text + more
