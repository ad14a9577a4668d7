"""Byte-level BPE encoding and decoding of a text column.

Texts are cut by the automaton of ``bytebpe`` (codepoint classes, an associative scan of
transition functions), slices are merged once each, and ids are dealt out.  Every id
keeps its byte offset, so that decoding any range of ids gives back the exact bytes.

Defined results: a null or empty text has no ids and decodes to an empty string; repeated
rows are encoded each; other columns pass only by name through ``keep``; an empty table
gives an empty table.  A text may have any length; a single text is held by one task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import bytebpe
from tidemark.llm.buffers import text_buffer
from tidemark.llm.shared import map_arrow

RANKS = "byte_bpe_multi_50k.tiktoken"


def load(path: str) -> bytebpe.Merges:
    """The merges of a rank file or a tokenizer file, read by the driver; executors get them broadcast (their size is the vocabulary's)."""
    return bytebpe.from_json(path) if path.endswith(".json") else bytebpe.from_ranks(path)


def encode(df: DataFrame, path: str, text: str = "text", keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """The kept columns, ids ``array<int>`` and, for each id, its first byte in the text, ``byte_offsets array<int>``."""
    shared = df.sparkSession.sparkContext.broadcast(load(path))
    keep = list(keep)

    def make(batch):
        merges = shared.value
        size = bytebpe.ByteTable(merges.strings).length if merges.spaced else None
        raw, offsets = text_buffer(batch.column(len(keep)))
        for a, b, ids, at in bytebpe.encode_texts(merges, raw, offsets):
            lengths = size[ids]
            place = np.cumsum(lengths) - lengths
            place -= np.repeat(np.append(place, 0)[at[:-1]] if len(place) else np.zeros(b - a, np.int64), np.diff(at))
            yield {c: batch.column(i).slice(a, b - a) for i, c in enumerate(keep)} | {"ids": pa.ListArray.from_arrays(at.astype(np.int32), ids), "byte_offsets": pa.ListArray.from_arrays(at.astype(np.int32), place.astype(np.int32))}

    kinds = dict(df.select(*keep).dtypes)
    schema = ", ".join([*(f"{c} {_name(kinds[c])}" for c in keep), "ids array<int>", "byte_offsets array<int>"])
    return map_arrow(df.select(*keep, text), make, schema)


def _name(kind: str) -> str:
    return {"bigint": "long"}.get(kind, kind)


def decode(df: DataFrame, path: str, ids: str = "ids", keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """The kept columns and ``decoded binary``: the bytes of the ids (null ids: empty)."""
    shared = df.sparkSession.sparkContext.broadcast(load(path))
    keep = list(keep)

    def make(batch):
        strings = bytebpe.ByteTable(shared.value.strings)
        column = batch.column(len(keep)).fill_null([])
        at = np.append(0, np.cumsum([len(x) for x in column]))
        out, by_row = strings.join(column.flatten().to_numpy(zero_copy_only=False).astype(np.int64), at)
        raw = out.tobytes()
        yield {c: batch.column(i) for i, c in enumerate(keep)} | {"decoded": [raw[p:q] for p, q in zip(by_row, by_row[1:])]}

    kinds = dict(df.select(*keep).dtypes)
    return map_arrow(df.select(*keep, ids), make, ", ".join([*(f"{c} {_name(kinds[c])}" for c in keep), "decoded binary"]))


def digests(df: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, and sha256 of the ids as text and of the bytes that they decode to.

    The same encoder and decoder as above, with each block's ids digested where they are,
    so that they cross no process border.
    """
    shared = df.sparkSession.sparkContext.broadcast(load(path))

    def make(batch):
        merges = shared.value
        strings, decimals = _tables(merges)
        raw, offsets = text_buffer(batch.column(1))
        for a, b, ids, at in bytebpe.encode_texts(merges, raw, offsets):
            digits, ends = decimals.join(ids, at)
            digits, back = memoryview(digits.tobytes()), strings.join(ids, at)
            decoded = memoryview(back[0].tobytes())
            yield {
                "doc_id": batch.column(0).slice(a, b - a),
                "n_tokens": np.diff(at),
                "ids_sha256": [hashlib.sha256(digits[p : max(p, q - 1)]).hexdigest() for p, q in zip(ends, ends[1:])],
                "decoded_sha256": [hashlib.sha256(decoded[p:q]).hexdigest() for p, q in zip(back[1], back[1][1:])],
            }

    return map_arrow(df.select("doc_id", "text"), make, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


_made: dict[int, tuple] = {}


def _tables(merges: bytebpe.Merges) -> tuple[bytebpe.ByteTable, bytebpe.ByteTable]:
    """Bytes and decimal digits of every id, made once in a worker."""
    if id(merges) not in _made:
        _made.clear()
        _made[id(merges)] = (bytebpe.ByteTable(merges.strings), bytebpe.ByteTable({i: b"%d," % i for i in merges.strings}), merges)
    return _made[id(merges)][:2]


def op7_byte_bpe(spark, sf_dir: str) -> DataFrame:
    """Every whole text of documents, encoded and decoded again."""
    df = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").cast("long"), "text")
    return digests(df, public_tokenizers.path(RANKS))
