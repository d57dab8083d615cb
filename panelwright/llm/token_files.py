"""Token ids in Arrow stream files of fixed-size-list batches.

A shard is one Arrow IPC stream. Each row is one sequence: tokens, a fixed-size list of ids in the narrowest unsigned
type that holds the vocabulary, and mask, a fixed-size list of bits that are set where a token is real. All batches
but the last have the same number of rows and so of bytes, so that row i lies at an offset known from the first batch,
and a mapped file gives it without a copy and without a look at the batches before it. Documents follow each other
without padding; only a shard's last row is filled up. Beside each shard lies an index stream with the place of every
document. A file's name holds the attempt that wrote it and only the manifest says which files count, so that what a
lost executor left half written, or wrote twice, is never read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs, ipc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelwright.llm.common import cut, fresh_folder, only
from panelwright.llm.encode import encoder

#: The mark that ends a stream.
END_BYTES = 8
INDEX = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])


def _place(path: str) -> tuple[fs.FileSystem, str]:
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path)


class _Writer:
    """One shard and its index."""

    def __init__(self, path: str, length: int, rows: int, kind: np.dtype) -> None:
        self.fs, self.path = _place(path)
        self.length, self.rows, self.kind = length, rows, kind
        self.fs.create_dir(self.path.rpartition("/")[0], recursive=True)
        self.schema = pa.schema([("tokens", pa.list_(pa.from_numpy_dtype(kind), length)), ("mask", pa.list_(pa.bool_(), length))])
        self.out = self.fs.open_output_stream(self.path)
        self.stream = ipc.new_stream(self.out, self.schema)
        self.index_out = self.fs.open_output_stream(self.path + ".index")
        self.index = ipc.new_stream(self.index_out, INDEX)
        self.held: list[np.ndarray] = []
        self.waiting = self.total = self.documents = 0

    def _write(self, flat: np.ndarray, real: int) -> None:
        tokens = pa.FixedSizeListArray.from_arrays(pa.array(flat), self.length)
        mask = pa.FixedSizeListArray.from_arrays(pa.array(np.arange(len(flat)) < real), self.length)
        self.stream.write_batch(pa.RecordBatch.from_arrays([tokens, mask], schema=self.schema))

    def add(self, doc_ids: pa.Array, ids: np.ndarray, offsets: np.ndarray) -> None:
        self.index.write_batch(pa.RecordBatch.from_arrays([doc_ids, pa.array(self.total + offsets[:-1]), pa.array(np.diff(offsets))], schema=INDEX))
        self.held.append(ids.astype(self.kind))
        self.waiting += len(ids)
        self.total += len(ids)
        self.documents += len(doc_ids)
        full = self.length * self.rows
        if self.waiting >= full:
            flat = np.concatenate(self.held)
            whole = len(flat) - len(flat) % full
            for lo in range(0, whole, full):
                self._write(flat[lo : lo + full], full)
            self.held, self.waiting = [flat[whole:].copy()], len(flat) - whole

    def close(self) -> None:
        if self.waiting:
            flat = np.concatenate(self.held)
            self._write(np.concatenate([flat, np.zeros(-len(flat) % self.length, self.kind)]), len(flat))
        for stream, out in ((self.stream, self.out), (self.index, self.index_out)):
            stream.close()
            out.close()


class SequenceFile:
    """Random access to a shard's rows; on a local disk the arrays are views of the mapped file."""

    def __init__(self, path: str) -> None:
        system, path = _place(path)
        self.source = pa.memory_map(path) if isinstance(system, fs.LocalFileSystem) else system.open_input_file(path)
        self.schema = ipc.read_schema(ipc.read_message(self.source))
        self.first = self.source.tell()
        self.length = self.schema.field("tokens").type.list_size
        first = ipc.read_record_batch(ipc.read_message(self.source), self.schema)
        self.rows, self.bytes = first.num_rows, self.source.tell() - self.first
        self.full, rest = divmod(self.source.size() - END_BYTES - self.first, self.bytes)
        self.last = self.batch(self.full).num_rows if rest else 0

    def __len__(self) -> int:
        return self.full * self.rows + self.last

    def batch(self, i: int) -> pa.RecordBatch:
        self.source.seek(self.first + i * self.bytes)
        return ipc.read_record_batch(ipc.read_message(self.source), self.schema)

    def flat(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """Tokens and mask of all rows of a batch, one after the other."""
        batch = self.batch(i)
        return batch.column(0).flatten().to_numpy(zero_copy_only=True), batch.column(1).flatten().to_numpy(zero_copy_only=False)

    def __getitem__(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        if not 0 <= i < len(self):
            raise IndexError(i)
        tokens, mask = self.batch(i // self.rows).columns
        row = i % self.rows
        return tokens.flatten().to_numpy(zero_copy_only=True)[row * self.length : (row + 1) * self.length], mask[row].values.to_numpy(zero_copy_only=False)


def write_token_files(docs: DataFrame, vocabulary: str, folder: str | None = None, doc_id: str = "doc_id", text: str = "text", end_id: int = 2, length: int = 2048, rows: int = 256) -> DataFrame:
    """Writes all documents, in ascending doc_id order, and returns the manifest: shard, path, n_documents, n_tokens, start.

    start counts the ids of all shards before it. Null or empty text gives the end id alone; null doc_ids come first;
    rows with equal ids follow each other, in the order of their texts; other columns are ignored; an empty table gives
    an empty manifest. A shard that is written again, after an executor was lost, is another file.
    """
    spark = docs.sparkSession
    folder = folder or fresh_folder(spark, "tokens")
    ordered = only(docs, doc_id, text).repartitionByRange(F.col(doc_id)).sortWithinPartitions(doc_id, text)

    def write(batches):
        task = TaskContext.get()
        shard, path = task.partitionId(), f"{folder}/shard-{task.partitionId():06d}-{task.taskAttemptId()}.arrows"
        out, enc = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            enc = enc or encoder(vocabulary)
            kind = np.uint16 if max(enc.whole.get_vocab_size(), end_id + 1) <= 1 << 16 else np.uint32
            out = out or _Writer(path, length, rows, np.dtype(kind))
            doc_ids, at = batch.column(0).cast(pa.int64()), 0
            for ids, offsets in enc.rows(batch.column(1)):
                n = len(offsets) - 1
                out.add(doc_ids.slice(at, n), np.insert(ids, offsets[1:], end_id), offsets + np.arange(n + 1))
                at += n
        if out:
            out.close()
            yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "path": [path], "n_documents": [out.documents], "n_tokens": [out.total]})

    manifest = cut(ordered.mapInArrow(write, "shard int, path string, n_documents long, n_tokens long"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one row for each shard
    return manifest.withColumn("start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


def _documents_in(path: str) -> Iterator[tuple[list, list, list]]:
    """(doc_ids, starts in the shard, arrays of ids) of a shard's documents, by index batch.

    A document's rows are looked up by their offsets; the mask has to be set for all of its tokens.
    """
    system, own = _place(path)
    file = SequenceFile(path)
    each, held = file.rows * file.length, (-1, None, None)
    with system.open_input_stream(own + ".index") as index:
        for part in ipc.open_stream(index):
            starts, counts, arrays = part.column(1).to_pylist(), part.column(2).to_pylist(), []
            for start, n in zip(starts, counts):
                pieces = []
                for i in range(start // each, (start + n - 1) // each + 1):
                    if held[0] != i:
                        held = (i, *file.flat(i))
                    s = slice(max(start - i * each, 0), start + n - i * each)
                    pieces.append(held[1][s][held[2][s]])
                arrays.append(pieces[0] if len(pieces) == 1 else np.concatenate(pieces))
                if len(arrays[-1]) != n:
                    raise ValueError(f"{path}: {len(arrays[-1])} of {n} tokens of a document are marked as real")
            yield part.column(0).to_pylist(), starts, arrays


def read_token_files(manifest: DataFrame, with_ids: bool = False) -> DataFrame:
    """One row for each document, read back from the files: doc_id, start, n_tokens, ids_crc32, and ids if asked for."""

    def read(batches):
        for batch in batches:
            for path, first in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for doc_ids, starts, arrays in _documents_in(path):
                    out = {"doc_id": pa.array(doc_ids, pa.int64()), "start": pa.array([first + s for s in starts], pa.int64()), "n_tokens": pa.array([len(a) for a in arrays], pa.int64()), "ids_crc32": pa.array([zlib.crc32(a.astype("<u4")) for a in arrays], pa.int64())}
                    if with_ids:
                        out["ids"] = pa.array([a.astype(np.int32) for a in arrays], pa.list_(pa.int32()))
                    yield pa.RecordBatch.from_pydict(out)

    files = manifest.select("path", "start").repartition(max(1, manifest.count()), "path")  # given, or adaptive execution reads all shards in one task
    return files.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids)
