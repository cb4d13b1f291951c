"""Token-id files: flat unsigned integers beside 64-bit document offsets, memory-mapped on reading."""

from __future__ import annotations

import os
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, arrow_schema, or_empty, rows_of
from .tokens import encoder, ends_after, id_type

#: Documents that a reader returns at a time.
READ = 4096
#: Stands for a null id in the files of ids.
NO_ID = -(2**63)
_MANIFEST = "part int, path string, docs long, tokens long"
_DOCS = "doc_id long, start long, n_tokens long, ids_crc32 long"


def _filesystem(uri: str):
    """(file system or None for a local path, path)."""
    at = urlparse(uri)
    if at.scheme in ("", "file"):
        return None, at.path
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


class _Out:
    """A file that appears under its name only once it is whole, so that a repeated task does no harm."""

    def __init__(self, uri: str):
        self.fs, self.path = _filesystem(uri)
        self.draft = f"{self.path}.{uuid.uuid4().hex}.draft"
        folder = os.path.dirname(self.path)
        if self.fs is None:
            os.makedirs(folder, exist_ok=True)
            self.file = open(self.draft, "wb")
        else:
            self.fs.create_dir(folder, recursive=True)
            self.file = self.fs.open_output_stream(self.draft)

    def write(self, array: np.ndarray) -> None:
        self.file.write(array.tobytes())

    def done(self) -> None:
        self.file.close()
        if self.fs is None:
            os.replace(self.draft, self.path)
        else:
            if self.fs.get_file_info(self.path).is_file:
                self.fs.delete_file(self.path)
            self.fs.move(self.draft, self.path)


class _In:
    """A flat file of integers: mapped where it is local, else read a range at a time."""

    def __init__(self, uri: str, dtype: str):
        self.dtype, (fs, path) = np.dtype(dtype), _filesystem(uri)
        self.file = fs.open_input_file(path) if fs else None
        self.size = self.file.size() if fs else os.path.getsize(path)
        self.map = None if fs else np.memmap(path, dtype, "r") if self.size else np.empty(0, dtype)

    def __len__(self) -> int:
        return self.size // self.dtype.itemsize

    def cut(self, start: int, end: int) -> np.ndarray:
        if self.file is None:
            return self.map[start:end]
        width = self.dtype.itemsize
        return np.frombuffer(self.file.read_at((max(end, start) - start) * width, start * width), self.dtype)


def _mapped(uri: str, dtype: str) -> np.ndarray:
    """A whole file: mapped where it is local, else in memory."""
    file = _In(uri, dtype)
    return file.cut(0, len(file))


def _writer(root: str, tokenizer: str, end_id: int, dtype: str):
    schema = arrow_schema(_MANIFEST)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, part, out, docs, tokens = encoder(tokenizer), TaskContext.get().partitionId(), None, 0, 0
        for batch in batches:
            if out is None:
                path = f"{root}/part-{part:06d}"
                out = {x: _Out(f"{path}.{x}") for x in ("bin", "off", "doc")}
                out["off"].write(np.zeros(1, "<i8"))
            for ids, sizes in own.encode_all(batch.column("text")):
                ids, sizes = ends_after(ids, sizes, end_id, dtype)
                out["bin"].write(ids)
                out["off"].write((tokens + np.cumsum(sizes)).astype("<i8"))
                tokens += len(ids)
            docs += batch.num_rows
            out["doc"].write(batch.column("doc_id").fill_null(NO_ID).to_numpy().astype("<i8"))
        if out is not None:
            for f in out.values():
                f.done()
            yield pa.RecordBatch.from_pydict({"part": [part], "path": [path], "docs": [docs], "tokens": [tokens]}, schema=schema)

    return write


def write_tokens(docs: DataFrame, root: str, tokenizer: str, end_id: int, scratch: Scratch) -> DataFrame:
    """Writes the ids of all texts, in ascending order of doc_id, under a fully qualified root, and returns the manifest (part, path, docs, tokens, base).

    Documents are dealt into ranges of doc_id, so that the parts' order is the documents'. A part has three flat
    files: .bin with the ids (16-bit if all of the vocabulary's fit, else 32-bit), .off with where each document starts and
    the last one ends, counted in the part, .doc with their doc_ids. base, the ids before the part, comes from the
    prefix sum over parts, of which there are as many as shuffle partitions at most.
    """
    dtype = id_type(tokenizer, end_id)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), or_empty("text").alias("text"))
    rows = rows.repartitionByRange("doc_id", F.xxhash64("text")).sortWithinPartitions(F.col("doc_id"), F.xxhash64("text"), "text")
    parts = scratch.save(rows.mapInArrow(_writer(root, tokenizer, end_id, dtype), _MANIFEST), "manifest").orderBy("part").collect()
    base, whole = 0, []
    for p in parts:
        whole.append((p["part"], p["path"], dtype, p["docs"], p["tokens"], base))
        base += p["tokens"]
    return docs.sparkSession.createDataFrame(whole, "part int, path string, dtype string, docs long, tokens long, base long")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = arrow_schema(_DOCS)
    for paths, dtypes, bases in rows_of(batches, "path", "dtype", "base", rows=1):
        ids, ends, docs = _In(f"{paths[0]}.bin", dtypes[0]), _In(f"{paths[0]}.off", "<i8"), _In(f"{paths[0]}.doc", "<i8")
        for at in range(0, len(docs), READ):
            cut = ends.cut(at, min(at + READ, len(docs)) + 1).tolist()
            crc = [zlib.crc32(ids.cut(a, b).astype("<u4").tobytes()) for a, b in zip(cut, cut[1:])]
            yield pa.RecordBatch.from_pydict({
                "doc_id": [None if d == NO_ID else d for d in docs.cut(at, at + len(crc)).tolist()],
                "start": [bases[0] + a for a in cut[:-1]], "n_tokens": [b - a for a, b in zip(cut, cut[1:])], "ids_crc32": crc,
            }, schema=schema)


def read_tokens(manifest: DataFrame) -> DataFrame:
    """What the files hold of each document: doc_id, start over all parts, n_tokens, ids_crc32."""
    n = max(1, manifest.count())
    return manifest.repartition(n, "part").mapInArrow(_read, _DOCS)


def round_trip(docs: DataFrame, tokenizer: str, end_id: int = 2) -> DataFrame:
    """Writes the ids of all documents to files in the shared folder and reads them back from there.

    A null text is empty and has the end id alone; null ids come first and come back null; repeated rows count each
    and stand side by side; a very long text is encoded and written whole by one task; an empty table gives no files and
    no rows; other columns are ignored.
    """
    scratch = Scratch(docs.sparkSession, "tokens")
    return read_tokens(write_tokens(docs, f"{scratch.root}/ids", tokenizer, end_id, scratch))
