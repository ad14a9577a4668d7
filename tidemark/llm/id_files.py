"""Token ids in Arrow files: record batches of fixed-size lists, for random access without copying.

Documents are dealt out by ranges of doc_id, in ascending order; each task writes one
file in the Arrow file format, with the columns

* ``ids``: fixed-size lists of ``length`` ids, in the smallest unsigned type that holds the vocabulary;
* ``mask``: fixed-size lists of booleans, false where the file's last list is filled up;
* ``doc_ids``, ``doc_sizes``: ids and sizes of the documents that begin in that list.

The ids of a file are one run: document after document, cut every ``length`` ids.  A
memory-mapped file gives any sequence and its mask as a view.  A task writes under a name
of its own and only the tasks that Spark counts enter the manifest, so that a task that
ran twice leaves no second copy in it.

Defined results: a null or empty text is the end id alone; repeated doc_ids keep all
their rows, in the order of their ids' bytes; null doc_ids come first; an empty table gives no
files and no rows; columns besides id and text are not read.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Sequence

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.bpe_codec import load
from tidemark.llm.buffers import text_buffer
from tidemark.llm.sequences import added_tokens, with_end
from tidemark.llm.shared import map_arrow, shared_folder, written

#: Ids of a sequence; sequences of a record batch; documents of a file, about.
LENGTH, BATCH, FILE_DOCS = 2048, 256, 8_192
VOCABULARY, END_ID = "word_bpe_49k.json", 2


def encoded(df: DataFrame, path: str, end: int = END_ID, cuts: Sequence[int] = ()) -> DataFrame:
    """doc_id, ids, as the bytes of unsigned integers of 2 (or 4) bytes, and file_no: how many of the sorted cuts are less than doc_id (0 for null)."""
    merges = load(path)
    kind = id_type(merges)
    shared, added, bounds = df.sparkSession.sparkContext.broadcast(merges), added_tokens(path), np.array(cuts, np.int64)

    def make(batch):
        raw, offsets = text_buffer(batch.column(1))
        file_no = np.searchsorted(bounds, batch.column(0).fill_null(np.iinfo(np.int64).min).to_numpy())
        for a, b, ids, at in with_end(shared.value, raw, offsets, end, added):
            data = ids.astype(kind).tobytes()
            p = at * np.dtype(kind).itemsize
            yield {"doc_id": batch.column(0).slice(a, b - a), "ids": [data[x:y] for x, y in zip(p, p[1:])], "file_no": file_no[a:b]}

    return map_arrow(df, make, "doc_id long, ids binary, file_no int")


def ranges(keys: DataFrame, file_docs: int = FILE_DOCS) -> list[int]:
    """Bounds that cut the column doc_id into files of about file_docs rows: a number for each file."""
    n = max(1, -(-keys.count() // file_docs))
    found = [] if n == 1 else keys.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)], max(10_000, 10 * n))).first()[0] or []
    return sorted(set(found))


def id_type(merges) -> str:
    return "<u2" if max(merges.strings) < 1 << 16 else "<u4"


def write(rows: DataFrame, files: int, kind: str, length: int = LENGTH) -> DataFrame:
    """Writes (doc_id, ids, file_no) as files in the shared folder.  Returns the manifest: file, first_doc, docs, tokens."""
    folder = f"{shared_folder(rows.sparkSession)}/ids-{uuid.uuid4().hex}"
    system, root = fs.FileSystem.from_uri(folder)
    system.create_dir(root)
    dealt = rows.repartitionById(files, F.col("file_no")).drop("file_no").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "ids")

    def run(batches):
        out = _File(folder, kind, length)
        for batch in batches:
            out.add(batch)
        if out.docs:
            yield out.close()

    return written(dealt.mapInArrow(run, "file string, first_doc long, docs long, tokens long"), "manifest")


class _File:
    def __init__(self, folder: str, kind: str, length: int):
        self.uri, self.kind, self.length = f"{folder}/{uuid.uuid4().hex}.arrow", np.dtype(kind), length
        self.docs = self.tokens = 0
        self.first = None
        self.pending: list[bytes] = []
        self.open: list[tuple[int, int | None, int]] = []
        self.waiting = 0
        self.writer = None
        item = pa.uint16() if self.kind.itemsize == 2 else pa.uint32()
        self.schema = pa.schema([("ids", pa.list_(item, length)), ("mask", pa.list_(pa.bool_(), length)), ("doc_ids", pa.list_(pa.int64())), ("doc_sizes", pa.list_(pa.int64()))])

    def add(self, batch: pa.RecordBatch) -> None:
        if self.writer is None:
            system, path = fs.FileSystem.from_uri(self.uri)
            self.sink = system.open_output_stream(path)
            self.writer = pa.ipc.new_file(self.sink, self.schema)
            self.first = batch.column(0)[0].as_py()
        for doc, ids in zip(batch.column(0).to_pylist(), batch.column(1)):
            data = ids.as_buffer().to_pybytes()
            size = len(data) // self.kind.itemsize
            self.open.append((self.tokens, doc, size))
            self.docs += 1
            self.tokens += size
            self.pending.append(data)
            self.waiting += size
            if self.waiting >= self.length * BATCH:
                self.flush(False)

    def flush(self, last: bool) -> None:
        data = np.frombuffer(b"".join(self.pending), self.kind)
        rows = -(-len(data) // self.length) if last else len(data) // self.length
        begin = self.tokens - self.waiting
        used = min(len(data), rows * self.length)
        ids = np.zeros(rows * self.length, self.kind)
        ids[:used] = data[:used]
        mask = np.zeros(rows * self.length, bool)
        mask[:used] = True
        here = [x for x in self.open if x[0] < begin + rows * self.length]
        self.open = self.open[len(here) :]
        row = np.array([(s - begin) // self.length for s, _, _ in here], np.int64)
        at = pa.array(np.searchsorted(row, np.arange(rows + 1)).astype(np.int32))
        self.writer.write_batch(pa.RecordBatch.from_arrays([
            pa.FixedSizeListArray.from_arrays(pa.array(ids), self.length), pa.FixedSizeListArray.from_arrays(pa.array(mask), self.length),
            pa.ListArray.from_arrays(at, pa.array([d for _, d, _ in here], pa.int64())), pa.ListArray.from_arrays(at, pa.array([z for _, _, z in here], pa.int64())),
        ], schema=self.schema))
        self.pending = [data[used:].tobytes()]
        self.waiting = len(data) - used

    def close(self) -> pa.RecordBatch:
        if self.waiting:
            self.flush(True)
        self.writer.close()
        self.sink.close()
        return pa.RecordBatch.from_pylist([{"file": self.uri, "first_doc": self.first, "docs": self.docs, "tokens": self.tokens}])


def opened(uri: str) -> pa.ipc.RecordBatchFileReader:
    """A file's reader: memory-mapped where it is local, else by ranges of the remote file."""
    system, path = fs.FileSystem.from_uri(uri)
    return pa.ipc.open_file(pa.memory_map(path) if isinstance(system, fs.LocalFileSystem) else system.open_input_file(path))


def read_documents(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, from the files alone.

    start counts the ids of all documents before it; a running sum over the manifest (a
    row for each file) gives the files' own starts.
    """
    window = Window.orderBy(F.col("first_doc").asc_nulls_first(), "file")
    files = manifest.withColumn("begin", F.sum("tokens").over(window) - F.col("tokens")).select("file", "begin")
    n = max(1, files.count())

    def make(batch):
        for uri, begin in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            reader = opened(uri)
            queue: list[tuple[int | None, int, int]] = []  # documents with ids still to come
            start, crc, left, rows = begin, 0, 0, []
            for i in range(reader.num_record_batches):
                part = reader.get_batch(i)
                ids = part.column(0).flatten().to_numpy(zero_copy_only=True)
                used = int(np.count_nonzero(part.column(1).flatten().to_numpy(zero_copy_only=False)))
                queue += [(d, z, z) for d, z in zip(part.column(2).flatten().to_pylist(), part.column(3).flatten().to_pylist())]
                data, at = memoryview(ids[:used].astype("<u4").view(np.uint8)), 0
                done = 0
                while at < used:
                    doc, size, left = queue[done]
                    take = min(left, used - at)
                    crc = zlib.crc32(data[at * 4 : (at + take) * 4], crc)
                    at += take
                    if take == left:
                        rows.append((doc, start, size, crc))
                        start, crc, done = start + size, 0, done + 1
                    else:
                        queue[done] = (doc, size, left - take)
                queue = queue[done:]
            d, s, z, c = zip(*rows)
            yield {"doc_id": d, "start": s, "n_tokens": z, "ids_crc32": c}

    return map_arrow(files.repartition(n, "file"), make, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op10_arrow_ids(spark, sf_dir: str) -> DataFrame:
    """All documents as files of ids, read back."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").cast("long"), "text")
    path = public_tokenizers.path(VOCABULARY)
    cuts = ranges(docs.select("doc_id"))
    return read_documents(write(encoded(docs, path, cuts=cuts), len(cuts) + 1, id_type(load(path))))
