"""Corpora as flat files of unsigned token ids with 64-bit document offsets.

Folder layout, for each range of documents in ascending order:
  NNNNNNNN.bin  the ids, little-endian unsigned, 16 bits wide if the vocabulary allows, else 32
  NNNNNNNN.idx  unsigned 64-bit offsets into .bin in ids: each document's start, then the end
  NNNNNNNN.doc  the number of null ids, which come first (64 bits), then the signed 64-bit ids of the other documents
The range's base, the ids in all ranges before it, is a prefix sum over the ranges' totals. Files
appear under their names by one rename when they are complete, so a task that runs again or twice
leaves the same files. They lie in the cluster's shared folder.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow.fs import FileSystem, FileType, LocalFileSystem
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import documents, partitions, scratch, scratch_path
from tessera.llm.library import encoder

ROWS = 256
#: Documents described at once.
DESCRIBED = 4_096


def publish(fs: FileSystem, draft: str, name: str) -> None:
    """Gives a complete file its name. One that another run of the task has published is the same, and stays."""
    if fs.get_file_info(name).type == FileType.NotFound:
        fs.move(draft, name)
    else:
        fs.delete_file(draft)


def write_range(batches: Iterator[pa.RecordBatch], uri: str, tokenizer: str, end_id: int) -> Iterator[pa.RecordBatch]:
    task = TaskContext.get()
    fs, folder = FileSystem.from_uri(uri)
    fs.create_dir(folder, recursive=True)
    coder = encoder(tokenizer)
    end = np.array([end_id], coder.dtype).tobytes()
    name = f"{folder}/{task.partitionId():08d}"
    draft = f"{folder}/_draft-{task.taskAttemptId()}"
    offsets, ids, nulls = [0], [], 0
    with fs.open_output_stream(f"{draft}.bin") as out:
        for batch in batches:
            for at in range(0, len(batch), ROWS):
                part = batch.slice(at, ROWS)
                for text in part["text"].to_pylist():
                    own = coder.encode(text) + end
                    out.write(own)
                    offsets.append(offsets[-1] + len(own) // coder.dtype.itemsize)
                nulls += part["doc_id"].null_count
                ids.append(part["doc_id"].drop_null().to_numpy())
    if len(offsets) == 1:
        fs.delete_file(f"{draft}.bin")
        return
    for kind, values in (("idx", np.array(offsets, "<u8")), ("doc", np.concatenate([[nulls], *ids]).astype("<i8"))):
        with fs.open_output_stream(f"{draft}.{kind}") as out:
            out.write(values.tobytes())
    for kind in ("bin", "idx", "doc"):
        publish(fs, f"{draft}.{kind}", f"{name}.{kind}")
    yield pa.RecordBatch.from_pydict({"range": pa.array([task.partitionId()], pa.int32()), "n_docs": [len(offsets) - 1], "n_ids": [offsets[-1]], "width": pa.array([coder.dtype.itemsize], pa.int32())})


def write_token_files(docs: DataFrame, tokenizer: str, uri: str, end_id: int = 0) -> DataFrame:
    """Encodes docs (doc_id, text; null text is empty) into the folder; returns a row for each range: range, n_docs, n_ids, width, base.

    Documents lie in ascending doc_id order, null ids first; rows of one id in the order of a hash of
    their texts. An empty table makes no file and gives no row.
    """
    spark = docs.sparkSession
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("_tie", F.xxhash64("text"))
    rows = rows.repartitionByRange(partitions(spark), "doc_id", "_tie").sortWithinPartitions("doc_id", "_tie", "text").select("doc_id", "text")
    written = scratch(rows.mapInArrow(lambda b: write_range(b, uri, tokenizer, end_id), "range int, n_docs long, n_ids long, width int"), "manifest")
    found, base, manifest = sorted(written.collect()), 0, []  # one row for each range
    for r in found:
        manifest.append((*r, base))
        base += r.n_ids
    return spark.createDataFrame(manifest, "range int, n_docs long, n_ids long, width int, base long").repartition(max(1, len(manifest)))


class Numbers:
    """A file of numbers, of which only the slices that are asked for come into memory: mapped where the folder is mounted, else read by place."""

    def __init__(self, fs: FileSystem, path: str, dtype: str):
        self.dtype = np.dtype(dtype)
        local = isinstance(fs, LocalFileSystem)
        self.mapped = np.memmap(path, self.dtype, "r") if local else None
        self.file = None if local else fs.open_input_file(path)
        self.size = len(self.mapped) if local else self.file.size() // self.dtype.itemsize

    def __getitem__(self, part: slice) -> np.ndarray:
        start, stop, _ = part.indices(self.size)
        if self.mapped is not None:
            return np.asarray(self.mapped[start:stop])
        return np.frombuffer(self.file.read_at(max(0, stop - start) * self.dtype.itemsize, start * self.dtype.itemsize), self.dtype)


class TokenRange:
    """The files of one range; its i-th document's ids by index."""

    def __init__(self, uri: str, number: int, width: int):
        fs, folder = FileSystem.from_uri(uri)
        self.ids, self.offsets, self.docs = (Numbers(fs, f"{folder}/{number:08d}.{kind}", dtype) for kind, dtype in (("bin", f"<u{width}"), ("idx", "<u8"), ("doc", "<i8")))
        self.nulls = int(self.docs[:1][0])

    def __len__(self) -> int:
        return self.offsets.size - 1

    def __getitem__(self, i: int) -> np.ndarray:
        start, stop = self.offsets[i : i + 2].tolist()
        return self.ids[start:stop]

    def doc_ids(self, start: int, stop: int) -> pa.Array:
        known = self.docs[max(1, 1 + start - self.nulls) : max(1, 1 + stop - self.nulls)]
        return pa.concat_arrays([pa.nulls(max(0, min(stop, self.nulls) - start), pa.int64()), pa.array(known, pa.int64())])


def digests(batches: Iterator[pa.RecordBatch], uri: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for r in batch.to_pylist():
            files = TokenRange(uri, r["range"], r["width"])
            for at in range(0, len(files), DESCRIBED):
                to = min(at + DESCRIBED, len(files))
                offsets = files.offsets[at : to + 1].astype("i8")
                yield pa.RecordBatch.from_pydict({
                    "doc_id": files.doc_ids(at, to), "start": r["base"] + offsets[:-1], "n_tokens": np.diff(offsets),
                    "ids_crc32": pa.array([zlib.crc32(files.ids[a:b].astype("<u4")) for a, b in zip(offsets, offsets[1:], strict=False)], pa.int64()),
                })


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes all documents as token files and describes what the files hold."""
    import public_tokenizers

    uri = scratch_path(spark, "tokens")
    manifest = write_token_files(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), uri, end_id=0)
    return manifest.mapInArrow(lambda b: digests(b, uri), "doc_id long, start long, n_tokens long, ids_crc32 long")
