"""Sum-of-squares packing of tokenised documents into sequences of bounded length.

A document is cut only where it is longer than a sequence, and then its first piece takes the remainder; pieces of full
length are sequences of their own. Every other document leaves one piece, so the number of documents bounds what has to be
packed. Documents are dealt by a hash of their row into shards of about SHARD; a shard is packed alone, so that no task
and no driver sees all of them, and the loss is a few open sequences for each shard. In a shard pieces come by falling
length, and each goes where the sum over gaps g of (open sequences with gap g)^2 becomes smallest; the tightest place wins ties. A
new sequence is opened only where no open one has room: this variant of the method never opens one to lower the sum, since it
packs for few sequences. Pieces are placed as they stream by, so a task holds a batch and the open sequences, not a shard.

Nulls: a null text is empty, and its only id is the end id; a null document id is kept. Repeated rows are packed one by one.
An empty table gives no pieces. Columns of the input other than the key and the text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, table
from .tokens import encoder, public_path

CAPACITY, SHARD = 2048, 32_768
END_ID = 0


def pieces(docs: DataFrame, path: str, *, capacity: int = CAPACITY, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, piece, start, length, ids): ids are little-endian unsigned 32-bit numbers, END_ID the last of a document."""
    small_batches(docs.sparkSession)
    narrow = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").cast("string").alias("text"))
    kind = narrow.schema["key"].dataType.simpleString()

    def run(batches):
        encode = encoder(path)
        for batch in batches:
            ids, at = encode.column(batch.column(1))
            ids = np.insert(ids, at[1:], END_ID)
            total = np.diff(at) + 1
            count = -(-total // capacity)
            doc = np.repeat(np.arange(len(total)), count)
            piece = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
            first = (total - (count - 1) * capacity)[doc]
            length = np.where(piece == 0, first, capacity)
            start = np.where(piece == 0, 0, first + (piece - 1) * capacity)
            ends = np.concatenate([[0], np.cumsum(length)]) * 4
            held = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(doc), [None, pa.py_buffer(ends), pa.py_buffer(ids.astype("<u4"))])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(doc)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), held.cast(pa.binary())], names=["key", "piece", "start", "length", "ids"])

    return narrow.mapInArrow(run, f"key {kind}, piece int, start long, length long, ids binary").withColumnRenamed("key", key)


class Placer:
    """Places pieces of one shard, as they come, by the sum of squares. It holds open sequences only, no pieces."""

    def __init__(self, capacity: int) -> None:
        self.capacity, self.opened = capacity, 0
        self.count = np.zeros(capacity + 1, np.int64)  # open sequences by gap
        self.bins: list[list[int]] = [[] for _ in range(capacity + 1)]

    def place(self, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(sequence, offset) of each of the next pieces."""
        count, bins, capacity = self.count, self.bins, self.capacity
        sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
        for i, size in enumerate(lengths.tolist()):
            tail = count[size:]
            gaps = tail.nonzero()[0]
            if len(gaps):
                after = count[gaps]
                # the sum grows by 2 * (count of the gap left - count of the gap taken) + 2, less 2 * 0 + 1 where no gap is left
                change = 2 * (after - tail[gaps]) + 2
                if gaps[0] == 0:
                    change[0] = 1 - 2 * tail[0]
                gap = int(gaps[change.argmin()]) + size
                where = bins[gap].pop()
                count[gap] -= 1
            else:
                gap, where = capacity, self.opened
                self.opened += 1
            sequence[i], offset[i] = where, capacity - gap
            if gap > size:
                bins[gap - size].append(where)
                count[gap - size] += 1
        return sequence, offset


def pack(rows: DataFrame, documents: int, *, capacity: int = CAPACITY, shard: int = SHARD, key: str = "doc_id") -> DataFrame:
    """rows (key, piece, start, length and any others) with sequence_id and offset. documents: how many the rows come from."""
    shards = max(1, -(-documents // shard))
    dealt = rows.withColumn("__shard", F.pmod(F.xxhash64(key, "piece", "start", "length"), F.lit(shards))).repartition(shards, "__shard")
    dealt = dealt.sortWithinPartitions("__shard", F.desc("length"), key, "piece")
    names = rows.columns

    def run(batches: Iterator[pa.RecordBatch]):
        current, placer = None, Placer(capacity)
        for batch in batches:
            shard_of = batch.column(batch.schema.get_field_index("__shard")).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(shard_of)) + 1).tolist(), len(shard_of)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if a == b:
                    continue
                if shard_of[a] != current:
                    current, placer = shard_of[a], Placer(capacity)
                part = batch.slice(a, b - a)
                sequence, offset = placer.place(part.column(part.schema.get_field_index("length")).to_numpy())
                yield pa.RecordBatch.from_arrays([*(part.column(part.schema.get_field_index(n)) for n in names), pa.array(int(current) * (1 << 32) + sequence), pa.array(offset)], names=[*names, "sequence_id", "offset"])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema]
    return dealt.mapInArrow(run, ", ".join([*fields, "sequence_id long", "offset long"]))


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, length, ids): the ids of each sequence, for packed rows that kept `ids`."""
    parts = packed.groupBy("sequence_id").agg(F.sum("length").alias("length"), F.array_sort(F.collect_list(F.struct("offset", F.hex("ids").alias("ids")))).alias("parts"))
    return parts.select("sequence_id", "length", F.unhex(F.array_join("parts.ids", "")).alias("ids"))


def op1(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rows = pieces(docs, public_path()).withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    out = pack(rows, docs.count())
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


QUERIES = {"op1_sum_of_squares_packing": op1}
ORACLE: dict[str, str] = {}
