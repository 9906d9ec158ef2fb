"""Token ids in Arrow files of fixed-size rows.

A file holds the ids of consecutive documents as one stream, cut into rows of ``row`` ids, with a mask that is false
on the padding of its last row.  Batches have ``BATCH`` rows each, so row i lies in batch i // BATCH, and a memory-mapped
file gives any row without a copy.  An index file beside it holds each document's place in the stream.  Ids take two
bytes where the vocabulary allows.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs, ipc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, keep
from .tokens import encoded, encoder

BATCH = 256
INDEX = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])


def _schema(row: int, vocabulary: int) -> pa.Schema:
    ids = pa.uint16() if vocabulary <= 1 << 16 else pa.uint32()
    return pa.schema([("ids", pa.list_(ids, row)), ("mask", pa.list_(pa.bool_(), row))])


class _Writer:
    """Writes one file and its index under a name of this attempt; ``close`` gives them their final names."""

    def __init__(self, folder: str, part: int, row: int, vocabulary: int):
        self.fs, top = fs.FileSystem.from_uri(folder)
        self.fs.create_dir(top, recursive=True)
        self.name, self.row, self.schema = f"part-{part:06d}", row, _schema(row, vocabulary)
        self.top, self.attempt = top, TaskContext.get().taskAttemptId() if TaskContext.get() else os.getpid()
        self.data = ipc.new_file(self._open("arrow"), self.schema)
        self.index = ipc.new_file(self._open("index.arrow"), INDEX)
        self.rest, self.places, self.n, self.waiting = [], [], 0, 0

    def _path(self, end: str, mine: bool) -> str:
        return f"{self.top}/{'.' if mine else ''}{self.name}{f'.{self.attempt}' if mine else ''}.{end}"

    def _open(self, end: str):
        return self.fs.open_output_stream(self._path(end, True))

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.places.append((doc_id, self.n, len(ids)))
        self.rest.append(ids.astype(self.schema.field("ids").type.value_type.to_pandas_dtype()))
        self.n += len(ids)
        self.waiting += len(ids)
        if self.waiting >= self.row * BATCH:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        stream = np.concatenate(self.rest) if self.rest else np.empty(0, np.uint16)
        step = self.row * BATCH
        while len(stream) >= step or last and len(stream):
            part, stream = stream[:step], stream[step:]
            pad = -len(part) % self.row
            kind = self.schema.field("ids").type.value_type
            ids = pa.array(np.pad(part, (0, pad)), kind)
            mask = pa.array(np.arange(len(part) + pad) < len(part))
            self.data.write_batch(pa.record_batch([pa.FixedSizeListArray.from_arrays(ids, self.row),
                                                   pa.FixedSizeListArray.from_arrays(mask, self.row)], schema=self.schema))
        self.rest, self.waiting = [stream] if len(stream) else [], len(stream)
        if len(self.places) >= 10_000 or last and self.places:
            self.index.write_batch(pa.record_batch([list(c) for c in zip(*self.places)], schema=INDEX))
            self.places = []

    def close(self) -> str:
        self._flush(True)
        for writer, end in ((self.data, "arrow"), (self.index, "index.arrow")):
            writer.close()
            self.fs.move(self._path(end, True), self._path(end, False))
        return f"{self.name}.arrow"


class TokenFile:
    """Random access to one file: ``sequence(i)`` gives views of the ids and the mask of row i."""

    def __init__(self, folder: str, name: str):
        files, top = fs.FileSystem.from_uri(folder)
        path = f"{top}/{name}"
        local = isinstance(files, fs.LocalFileSystem)
        self.file = ipc.open_file(pa.memory_map(path) if local else files.open_input_file(path))
        self.index = ipc.open_file(files.open_input_file(path.removesuffix("arrow") + "index.arrow"))

    def sequence(self, i: int) -> tuple[np.ndarray, pa.BooleanArray]:
        batch = self.file.get_batch(i // BATCH)
        ids, mask = batch.column(0)[i % BATCH].values, batch.column(1)[i % BATCH].values
        return ids.to_numpy(zero_copy_only=True), mask

    def documents(self) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """(doc_id, start in the file, ids) of all documents, one batch of ids in memory at a time."""
        parts, have, nr = [], 0, 0
        for b in range(self.index.num_record_batches):
            index = self.index.get_batch(b).to_pydict()
            for doc_id, start, n in zip(index["doc_id"], index["start"], index["n_tokens"]):
                while have < n:
                    batch = self.file.get_batch(nr)
                    ids, mask = batch.column(0).flatten(), batch.column(1).flatten()
                    parts.append(ids.filter(mask).to_numpy() if nr + 1 == self.file.num_record_batches else ids.to_numpy())
                    have, nr = have + len(parts[-1]), nr + 1
                stream = parts[0] if len(parts) == 1 else np.concatenate(parts)
                yield doc_id, start, stream[:n]
                parts, have = [stream[n:]], have - n


def write_tokens(docs: DataFrame, folder: str, vocabulary: str, end_id: int = 0, row: int = 2048,
                 files: int | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Writes all documents, ascending by id over all files; returns ``file, first, n_docs, n_tokens`` per file.

    Texts are dealt out by ranges of ids (null first), so each task writes one file of neighbouring documents and nothing is
    gathered elsewhere.  A null or empty text is the end id alone; equal ids go by text; other columns are ignored; an empty
    table writes no documents.  A repeated attempt writes the same bytes and replaces its file by a move.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    files = files or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = (docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
              .repartitionByRange(files, "doc_id").sortWithinPartitions("doc_id", "text"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, first, n = None, None, 0
        part = TaskContext.get().partitionId()
        for i, ids in encoded(batches, vocabulary, end_id):
            if out is None:
                out, first = _Writer(folder, part, row, encoder(vocabulary).size), i
            out.add(i, ids)
            n += 1
        if out:
            yield pa.record_batch({"file": [out.close()], "part": pa.array([part], pa.int32()), "first": pa.array([first], pa.int64()),
                                   "n_docs": pa.array([n], pa.int64()), "n_tokens": pa.array([out.n], pa.int64())})

    return keep(ranged.mapInArrow(write, "file string, part int, first long, n_docs long, n_tokens long"), "manifest")


def read_tokens(files: DataFrame, folder: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` per document, from the files a manifest names."""
    bounded_batches(files.sparkSession)
    # One short row per file; the sum before a file places its documents in the whole stream.
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    placed = files.select("file", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("base"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows = []
                for doc_id, start, ids in TokenFile(folder, name).documents():
                    rows.append((doc_id, base + start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                    if len(rows) == 10_000:
                        yield _rows(rows)
                        rows = []
                if rows:
                    yield _rows(rows)

    def _rows(rows):
        return pa.record_batch([pa.array(c, pa.int64()) for c in zip(*rows)], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return (placed.repartition(max(1, files.count())).mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long"))
