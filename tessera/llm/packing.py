"""Documents packed into sequences of a fixed length by first-fit decreasing.

Pieces are dealt at random into groups of bounded size and each group is packed by itself: the
largest piece first, into the leftmost open sequence with room, which a tournament tree over the
sequences' free room finds in a logarithm of their number.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from tessera.llm.common import by_place, documents, scratch
from tessera.llm.library import encoder
from tessera.llm.memory import giving_back

ROWS = 256
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


class RoomTree:
    """A tournament tree: each node holds the most free room of the bins below it."""

    def __init__(self, bins: int, capacity: int):
        self.leaves = 1 << max(0, bins - 1).bit_length()
        self.room = [capacity] * (2 * self.leaves)

    def place(self, size: int) -> tuple[int, int]:
        """Puts size into the leftmost bin with room; gives the bin and the room it had."""
        room, at = self.room, 1
        while at < self.leaves:
            at *= 2
            if room[at] < size:
                at += 1
        had, found = room[at], at - self.leaves
        room[at] = had - size
        while at > 1:
            at //= 2
            room[at] = max(room[2 * at], room[2 * at + 1])
        return found, had


def first_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """For each length (1 to capacity), its bin and its offset there. Of equal lengths the earlier one is placed first."""
    tree = RoomTree(len(lengths), capacity)
    bins, offsets = np.zeros(len(lengths), "i8"), np.zeros(len(lengths), "i8")
    for i in np.argsort(-lengths, kind="stable").tolist():
        bins[i], had = tree.place(int(lengths[i]))
        offsets[i] = capacity - had
    return bins, offsets


@giving_back
def cut(batches: Iterator[pa.RecordBatch], tokenizer: str, end_id: int, capacity: int) -> Iterator[pa.RecordBatch]:
    coder = encoder(tokenizer)
    end = np.array([end_id], coder.dtype).tobytes()
    for batch in batches:
        for at in range(0, len(batch), ROWS):
            part = batch.slice(at, ROWS)
            rows: list[tuple] = []
            for doc_id, text in zip(part["doc_id"].to_pylist(), part["text"].to_pylist(), strict=True):
                ids = np.frombuffer(coder.encode(text or "") + end, coder.dtype).astype("<u4")
                rows += [(doc_id, s, len(x := ids[s : s + capacity]), zlib.crc32(x), len(ids)) for s in range(0, len(ids), capacity)]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])


def pack(pieces: DataFrame, capacity: int, group_pieces: int = 16_384) -> DataFrame:
    """Adds sequence_id and offset to pieces (with a length from 1 to capacity; other columns stay, but for those of these two names).

    Groups are drawn over rows, not over keys, so repeated rows spread too; each holds about
    group_pieces pieces. Pieces of equal length are placed in the order of the table's rows. No rows give no sequences.
    """
    settled = scratch(pieces.drop("sequence_id", "offset"), "pieces")  # rows keep their numbers when a task runs again
    groups = max(1, -(-settled.count() // group_pieces))
    plain, length = by_place(settled), f"c{settled.columns.index('length')}"
    numbered = plain.withColumn("row", F.monotonically_increasing_id())
    dealt = numbered.withColumn("group", F.pmod(F.xxhash64("row", F.lit(groups)), F.lit(groups)))
    names = plain.columns

    def one(table: pa.Table) -> pa.Table:
        table = table.sort_by("row")
        bins, offsets = first_fit_decreasing(table[length].to_numpy(), capacity)
        number = pa.array((table["group"].to_numpy() << 32) + bins)
        return table.select(names).append_column("sequence_id", number).append_column("offset", pa.array(offsets))

    schema = StructType([*(StructField(f.name, f.dataType) for f in plain.schema), StructField("sequence_id", LongType()), StructField("offset", LongType())])
    return dealt.groupBy("group").applyInArrow(one, schema).toDF(*settled.columns, "sequence_id", "offset")


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int, capacity: int = 4096) -> DataFrame:
    """Encodes docs (doc_id, text), ends each with end_id, cuts at every capacity ids and packs the pieces.

    A null text is an empty one and gives one piece, the end; a null doc_id stays null; repeated rows are packed each
    for itself. Other columns are not read.
    """
    pieces = docs.select("doc_id", "text").mapInArrow(lambda b: cut(b, tokenizer, end_id, capacity), PIECES)
    return pack(pieces, capacity)


def pack_with_words(docs: DataFrame) -> DataFrame:
    """pack_documents with the word tokenizer and sequences of 4096; odd rows as there."""
    import public_tokenizers

    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=2)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 4096 ids."""
    return pack_with_words(documents(spark, sf_dir))
