"""Token-id files: an adaptive context-mixing range coder in independently reset, checksummed blocks.

Each id is predicted by three orders. Order 0 gives every id a share by how often the block has had it (ids not had yet share a
rest). Order 1 and order 2 name the id that last followed the previous id, and the previous two, with a confidence that rises when
they are right and falls when not. The predictions are mixed linearly: in each state (both confidences, and whether the two
agree) the weights are the shares of hits that the block has seen there. The mixture drives a carry-less 64-bit range coder;
an id that several orders predict is coded by the part of the highest of them. The model starts anew in every block, so each
block can be read alone; a checksum covers all of it, and another one its ids.

Python is too slow to do this id by id. A block is cut into up to STREAMS runs, each with a coder of its own, and the runs of up
to GROUP blocks are coded side by side: each step is a few array operations over all of them. Runs of a block share its
model: orders 1 and 2 learn after each step (of runs that meet in one place the last one counts), order 0 and the weights after
1, 4, 16, 64... steps. Memory is bounded by GROUP blocks and their tables. Arithmetic is on integers, and on doubles one operation
at a time, each of which IEEE 754 fixes: quotients are made that way, since dividing 64-bit integers is slow.

Files are rows of (file, block, n_ids, data) in a container that Spark writes to any store; `data` is a whole block, and files
and blocks are in ascending order of document (rows with the same id: by a hash of the text). A block names the documents whose
ids it holds; a long one spans blocks.

Nulls: a null text has the end id only; a null document id is written as such and comes first. Repeated rows are written each.
An empty table gives no blocks. Further columns are ignored.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import materialise, small_batches, table
from .packing import END_ID
from .tokens import encoder, public_path

BLOCK, GROUP = 1 << 18, 8
STREAMS, STREAM = 512, 512  # runs of a block at most, and ids that a run should have at least
MAGIC, VERSION = b"IDCM", 2
_HEAD = struct.Struct("<4sBIIIIII")  # magic, version, ids, segments, alphabet, entries of its dictionary, streams, crc32 of the ids
#: A part of a document in a block: id, whether it is null, number in the file, ids of the file before it, part, ids.
_SEGMENT = np.dtype([("doc_id", "<i8"), ("null", "u1"), ("ordinal", "<u8"), ("start", "<u8"), ("part", "<u4"), ("n", "<u4")])
DENSE = 1 << 17  # ids of a block that has larger ones are numbered by a dictionary in the block
BITS1, BITS2 = 13, 15  # rows of order 1 and order 2 for each block, as powers of two
EACH = 3  # how much more than a new id an id of the block counts for order 0, as a power of two
MASS = 9  # the weights sum to 2^MASS
REFRESH = frozenset(4**i for i in range(16))  # steps before which order 0 and the weights take in what was coded
WORD, LIMIT = np.uint64(32), np.uint64(1 << 32)  # bits of a word; ranges stay at LIMIT at least
SURE = 7  # the highest confidence; a right guess adds 1, a wrong one takes 2, and one with less than 2 starts anew


class Model:
    """What a group of blocks has seen, for runs (`lanes`) of known blocks, the longest first."""

    def __init__(self, block: np.ndarray, alphabet: np.ndarray) -> None:
        self.block, self.alphabet, n = block, alphabet, len(alphabet)
        self.width = int(alphabet.max(initial=1))
        self.count = np.zeros(n * self.width, np.int32)
        self.new = np.arange(n * self.width) % max(self.width, 1)
        self.part = self.new  # where the part of an id begins in order 0 (high half), and how long it is (low half)
        self.one, self.two = np.zeros(n << BITS1, np.uint32), np.zeros(n << BITS2, np.uint32)
        states = np.arange(128)
        sure2, sure1, agree = states >> 4, (states >> 1) & 7, states & 1
        prior = lambda c: np.where(c > 0, (c + 0.2) / (c + 3.0), 0.002)
        start = np.stack([np.ones(128), prior(sure2), np.where(agree, 0, 0.7 * (1 - prior(sure2)) * prior(sure1))]) * 4
        self.seen = np.repeat(start[:, None, :], n, axis=1).reshape(3, -1)  # times, hits of order 2, hits of order 1 alone
        self.base_of, self.base1, self.base2, self.base_state = (block * k for k in (self.width, 1 << BITS1, 1 << BITS2, 128))
        self.states: list[np.ndarray] = []
        self.narrow = n <= 128
        self.refresh(np.zeros(0, np.int64))

    def refresh(self, keys: np.ndarray) -> None:
        """Take in what was coded since the last time: block * width + id of each id."""
        if len(keys) < len(self.count) // 16:
            np.add.at(self.count, keys, 1)
        else:
            self.count += np.bincount(keys, minlength=len(self.count)).astype(np.int32)
        reached = np.cumsum(self.count, dtype=np.int64)
        self.order = np.repeat(np.arange(len(self.count), dtype=np.int32), self.count) if reached[-1:].any() else np.zeros(1, np.int32)
        ends = reached[self.width - 1 :: self.width]
        total = np.diff(ends, prepend=0)
        self.before, self.ids = (ends - total)[self.block], (total << EACH)[self.block]
        self.total = (self.ids + self.alphabet[self.block]) << MASS
        old = (reached - self.count - np.repeat(ends - total, self.width)) << (32 + EACH) | self.count.astype(np.int64) << EACH
        self.part = np.where(self.count > 0, old, (self.new + np.repeat(total << EACH, self.width)) << 32 | 1)
        if self.states:  # state * 4, and 2 for a hit of order 2, 1 for one of order 1 alone
            times = np.bincount(np.concatenate(self.states), minlength=4 * self.seen.shape[1]).reshape(-1, 4)
            self.seen += np.stack([times.sum(1), times[:, 2], times[:, 1]])
            self.states = []
        share = ((1 << MASS) - 16) * self.seen[1:] / (self.seen[0] + 0.5)
        weight2 = np.maximum(share[0].astype(np.int64), 1)
        weights = weight2 + np.maximum(share[1].astype(np.int64), 1)
        of_state = np.repeat((total << EACH) + self.alphabet, 128)
        self.of2, self.of_both, self.rest = weight2 * of_state, weights * of_state, (1 << MASS) - weights
        self.inverse = _below(self.total)

    def predict(self, one: np.ndarray, two: np.ndarray) -> None:
        """For the next id of the first lanes, of the previous id and the one before: candidates and weights."""
        n = self.lanes = len(one)
        mixed = one * np.uint32(0x9E3779B1)
        self.at1 = (mixed >> np.uint32(32 - BITS1)) + self.base1[:n]
        self.at2 = ((mixed ^ (two * np.uint32(0x85EBCA77) + np.uint32(0x27220A95))) * np.uint32(0xC2B2AE3D) >> np.uint32(32 - BITS2)) + self.base2[:n]
        self.held1, self.held2 = self.one.take(self.at1, mode="wrap"), self.two.take(self.at2, mode="wrap")
        self.guess1, self.guess2 = self.held1 >> np.uint32(3), self.held2 >> np.uint32(3)
        self.sure1, self.sure2 = self.held1 & np.uint32(7), self.held2 & np.uint32(7)
        state = (self.sure2 << np.uint32(4)) | (self.sure1 << np.uint32(1)) | (self.guess1 == self.guess2)
        self.state = self.base_state[:n] + state
        self.part2, self.parts, self.left = (x.take(self.state, mode="wrap") for x in (self.of2, self.of_both, self.rest))

    # Masks are numbers 0 and 1 below: a product is far faster than a choice.
    def hits(self, value: np.ndarray) -> None:
        self.right2, self.right1 = value == self.guess2, value == self.guess1
        self.hit2, self.hit1 = self.right2.astype(np.int64), (self.right1 & ~self.right2).astype(np.int64)

    def interval(self, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the part of an id begins, and how long it is, of `total`."""
        part = self.part.take(self.base_of[: self.lanes] + value, mode="wrap")
        none = (1 - self.hit1 - self.hit2) * self.left
        by1 = self.hit1 * self.parts
        low = (part >> 32) * none + (self.parts - self.hit2 * self.parts) - by1 + self.hit1 * self.part2
        long = (part & 0xFFFFFFFF) * none + by1 + (self.hit2 - self.hit1) * self.part2
        return low.view(np.uint64), long.view(np.uint64)

    def value_at(self, at: np.ndarray) -> np.ndarray:
        """The id in whose part a number is."""
        n = self.lanes
        rest = ((np.maximum(at - self.parts, 0) + 0.5) / self.left).astype(np.int64)  # exact: far fewer bits than a double has
        value = self.order.take((rest >> EACH) + self.before[:n], mode="clip") - self.base_of[:n]
        fresh = rest - self.ids[:n]
        value += (fresh - value) * (fresh >= 0)
        value += (self.guess1 - value) * (at < self.parts)
        value += (self.guess2 - value) * (at < self.part2)
        return value

    def learn(self, value: np.ndarray) -> None:
        self.states.append(((self.state << np.int64(2)) + (self.hit2 << np.int64(1)) + self.hit1).astype(np.uint16 if self.narrow else np.int64))
        fresh = (value << np.uint32(3)) + np.uint32(1)
        for rows, at, held, right, sure in ((self.one, self.at1, self.held1, self.right1, self.sure1), (self.two, self.at2, self.held2, self.right2, self.sure2)):
            unsure = sure < np.uint32(2)
            held = held + (right & (sure < np.uint32(SURE))).astype(np.uint32) - ((~right & ~unsure).astype(np.uint32) << np.uint32(1))
            held += (fresh - held) * (~right & unsure).astype(np.uint32)
            rows[at] = held


def _below(total: np.ndarray) -> np.ndarray:
    """Doubles whose product with a number is at most its quotient by `total`, and hardly less."""
    return (1 - 2.0**-45) / total


def _steps(rng: np.ndarray, inverse: np.ndarray) -> np.ndarray:
    return (rng.astype(np.float64) * inverse).astype(np.uint64)


def _quotient(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a // b of 64-bit numbers, where it has at most 32 bits."""
    q = (a.astype(np.float64) / b.astype(np.float64)).astype(np.uint64)
    left = (a - q * b).view(np.int64)
    q -= left < 0
    q += left >= b.view(np.int64)
    return q


class Lanes:
    """The runs of a group of blocks, the longest first; runs of one block stay in order."""

    def __init__(self, sizes: list[int]) -> None:
        n = np.array(sizes, np.int64)
        self.streams = np.clip(n // STREAM, np.minimum(n, 1), STREAMS)
        steps = -(-n // np.maximum(self.streams, 1))
        block = np.repeat(np.arange(len(n)), self.streams)
        stream = np.arange(len(block)) - np.repeat(np.cumsum(self.streams) - self.streams, self.streams)
        size = np.minimum(steps[block], n[block] - stream * steps[block])
        self.lane = np.argsort(-size, kind="stable")
        self.block, self.size, self.start = block[self.lane], size[self.lane], (stream * steps[block])[self.lane]
        self.steps = int(size.max(initial=0))

    def active(self, t: int) -> int:
        return int(np.searchsorted(-self.size, -t, "left"))


def _settle(lo: np.ndarray, rng: np.ndarray):
    """Lanes that can give up a word, with their low ends before; until none can."""
    need = np.flatnonzero(((lo ^ (lo + rng)) < LIMIT) | (rng < LIMIT))
    while len(need):
        a, r = lo[need], rng[need]
        r = np.where((a ^ (a + r)) < LIMIT, r, (np.uint64(0) - a) & (LIMIT - np.uint64(1)))
        yield need, a
        a, r = a << WORD, r << WORD
        lo[need], rng[need] = a, r
        need = need[((a ^ (a + r)) < LIMIT) | (r < LIMIT)]


def _run(lanes: Lanes, alphabet: list[int], ids: np.ndarray, code) -> None:
    """Go through all ids: code(model, lanes of the step, ids of the step) codes them, or fills them in."""
    model, since = Model(lanes.block, np.array(alphabet, np.int64)), 0
    for t in range(lanes.steps):
        if t in REFRESH:
            keys = [ids[s + 2, :k] + lanes.block[:k] * model.width for s in range(since, t) for k in [lanes.active(s)]]
            model.refresh(np.concatenate(keys))
            since = t
        n = lanes.active(t)
        model.predict(ids[t + 1, :n], ids[t, :n])
        value = code(model, n, ids[t + 2, :n])
        model.learn(value)


def compress(blocks: list[np.ndarray], alphabet: list[int]) -> list[list[np.ndarray]]:
    """The coded words (uint32) of each run of each block of ids (uint32) below its alphabet."""
    lanes = Lanes([len(b) for b in blocks])
    n = len(lanes.block)
    ids = np.zeros((lanes.steps + 2, n), np.uint32)  # two zeros come before the first id
    for i, (b, a, size) in enumerate(zip(lanes.block.tolist(), lanes.start.tolist(), lanes.size.tolist(), strict=True)):
        ids[2 : 2 + size, i] = blocks[b][a : a + size]
    out = np.zeros((lanes.steps * 2 + 4, n), np.uint32)  # a row for each word: neighbouring runs write near each other
    put = np.zeros(n, np.int64)
    low, wide = np.zeros(n, np.uint64), np.full(n, 2**64 - 1, np.uint64)

    def code(model: Model, k: int, value: np.ndarray) -> np.ndarray:
        lo, rng = low[:k], wide[:k]
        model.hits(value)
        begin, long = model.interval(value)
        step = _steps(rng, model.inverse[:k])
        lo += step * begin
        np.multiply(step, long, out=rng)
        for need, a in _settle(lo, rng):
            out[put[need], need] = a >> WORD
            put[need] += 1
        return value

    _run(lanes, alphabet, ids, code)
    # one number within what is left, with as few words as it needs
    end = (low + LIMIT - np.uint64(1)) >> WORD << WORD
    short = (end >= low) & (end - low < wide)
    end = np.where(short, end, low)
    each = np.arange(n)
    out[put, each] = end >> WORD
    out[put + 1, each] = end & (LIMIT - np.uint64(1))
    put += np.where(short, 1, 2)
    made: list[list[np.ndarray]] = [[np.zeros(0, np.uint32)] * int(k) for k in lanes.streams]
    first = np.cumsum(lanes.streams) - lanes.streams
    for i, (lane, b) in enumerate(zip(lanes.lane.tolist(), lanes.block.tolist(), strict=True)):
        made[b][lane - int(first[b])] = out[: put[i], i].copy()
    return made


def decompress(coded: list[list[np.ndarray]], sizes: list[int], alphabet: list[int]) -> list[np.ndarray]:
    """The ids of blocks of so many ids."""
    lanes = Lanes(sizes)
    n = len(lanes.block)
    runs = [run for block in coded for run in block]
    words = np.zeros((max(map(len, runs), default=0) + 4, n), np.uint32)
    for i, lane in enumerate(lanes.lane.tolist()):
        words[: len(runs[lane]), i] = runs[lane]
    now = np.zeros(n, np.uint64)
    for k in range(2):
        now = (now << WORD) | words[k]
    take = np.full(n, 2, np.int64)
    most = len(words) - 1
    low, wide = np.zeros(n, np.uint64), np.full(n, 2**64 - 1, np.uint64)
    ids = np.zeros((lanes.steps + 2, n), np.uint32)

    def code(model: Model, k: int, value: np.ndarray) -> np.ndarray:
        lo, rng, at = low[:k], wide[:k], now[:k]
        step = _steps(rng, model.inverse[:k])
        value[:] = model.value_at(np.minimum(_quotient(at - lo, step).view(np.int64), model.total[:k] - 1))
        model.hits(value)
        begin, long = model.interval(value)
        lo += step * begin
        np.multiply(step, long, out=rng)
        for need, _ in _settle(lo, rng):
            at[need] = (at[need] << WORD) | words[np.minimum(take[need], most), need]
            take[need] += 1
        return value

    _run(lanes, alphabet, ids, code)
    made = [np.zeros(k, np.uint32) for k in sizes]
    for i, (b, a, size) in enumerate(zip(lanes.block.tolist(), lanes.start.tolist(), lanes.size.tolist(), strict=True)):
        made[b][a : a + size] = ids[2 : 2 + size, i]
    return made


def write_blocks(blocks: list[tuple[np.ndarray, np.ndarray]]) -> list[bytes]:
    """Each block's bytes, for its segments (_SEGMENT) and ids."""
    names, coded, alphabet = [], [], []
    for _, ids in blocks:
        most = int(ids.max(initial=0)) + 1
        held = np.unique(ids) if most > DENSE else ids[:0]
        names.append(held)
        coded.append(np.searchsorted(held, ids).astype(np.uint32) if len(held) else ids)
        alphabet.append(len(held) or most)
    out = []
    for (segments, ids), held, size, runs in zip(blocks, names, alphabet, compress(coded, alphabet), strict=True):
        body = _HEAD.pack(MAGIC, VERSION, len(ids), len(segments), size, len(held), len(runs), zlib.crc32(ids.astype("<u4").tobytes()))
        body += segments.tobytes() + held.astype("<u4").tobytes() + np.array([len(r) for r in runs], "<u4").tobytes() + b"".join(r.astype("<u4").tobytes() for r in runs)
        out.append(body + struct.pack("<I", zlib.crc32(body)))
    return out


def read_blocks(blocks: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
    """(segments, ids) of each block; a damaged one is an error."""
    heads, coded = [], []
    for data in blocks:
        if len(data) < _HEAD.size + 4 or zlib.crc32(data[:-4]) != struct.unpack("<I", data[-4:])[0]:
            raise ValueError("a block's checksum is wrong")
        magic, version, n, segments, size, entries, streams, crc = _HEAD.unpack_from(data)
        if magic != MAGIC or version != VERSION:
            raise ValueError("not a block of this format")
        at = _HEAD.size + segments * _SEGMENT.itemsize
        held = np.frombuffer(data, "<u4", entries, at)
        at += 4 * entries
        long = np.frombuffer(data, "<u4", streams, at).astype(np.int64)
        words = np.frombuffer(data, "<u4", int(long.sum()), at + 4 * streams)
        heads.append((np.frombuffer(data, _SEGMENT, segments, _HEAD.size), n, size, held, crc))
        coded.append(np.split(words, np.cumsum(long)[:-1]) if streams else [])
    out = []
    for (segments, _, _, held, crc), ids in zip(heads, decompress(coded, [h[1] for h in heads], [h[2] for h in heads]), strict=True):
        ids = held[ids] if len(held) else ids
        if zlib.crc32(ids.astype("<u4").tobytes()) != crc:
            raise ValueError("a block's ids don't match their checksum")
        out.append((segments, ids))
    return out


def encoded(docs: DataFrame, path: str, *, key: str = "doc_id", text: str = "text", block: int = BLOCK, group: int = GROUP) -> DataFrame:
    """(file, block, n_ids, data) of all documents (the key a number), in files by ascending key."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(f"`{key}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text")).withColumn("__tie", F.xxhash64("text"))
    dealt = rows.repartitionByRange(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "doc_id", "__tie").sortWithinPartitions("doc_id", "__tie", "text")

    def run(batches):
        file, encode = TaskContext.get().partitionId(), encoder(path)
        held: list[tuple[np.ndarray, np.ndarray]] = []  # segments and ids, in order
        written = ordinal = total = 0

        def blocks(last: bool):
            """Full groups of blocks of what is held, or all of it."""
            nonlocal held, written
            segments, ids = (np.concatenate(x) for x in zip(*held, strict=True)) if held else (np.zeros(0, _SEGMENT), np.zeros(0, np.uint32))
            ends = np.cumsum(segments["n"].astype(np.int64))
            at = done = 0
            while len(ids) - at >= block * group or (last and at < len(ids)):
                some = []
                for a in range(at, min(at + block * group, len(ids)), block):
                    upto = int(np.searchsorted(ends, min(a + block, len(ids)))) + 1
                    some.append((segments[done:upto], ids[a : a + block]))
                    done = upto
                made = write_blocks(some)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([file] * len(made), pa.int64()), pa.array(range(written, written + len(made)), pa.int64()), pa.array([len(x) for _, x in some], pa.int64()), pa.array(made, pa.binary())],
                    names=["file", "block", "n_ids", "data"],
                )
                written += len(made)
                at = min(at + block * group, len(ids))
            held = [(segments[done:], ids[at:])]

        waiting = 0
        for batch in batches:
            ids, at = encode.column(batch.column(1))
            ids = np.insert(ids, at[1:], END_ID)
            size = np.diff(at) + 1
            start = total + np.cumsum(size) - size
            first, parts = start // block, (start + size - 1) // block - start // block + 1
            doc = np.repeat(np.arange(len(size)), parts)
            segments = np.zeros(len(doc), _SEGMENT)
            segments["doc_id"], segments["null"] = batch.column(0).fill_null(0).to_numpy()[doc], batch.column(0).is_null().to_numpy(zero_copy_only=False)[doc]
            segments["ordinal"], segments["start"] = ordinal + doc, start[doc]
            segments["part"] = part = np.arange(len(doc)) - np.repeat(np.cumsum(parts) - parts, parts)
            low = np.maximum(start[doc], (first[doc] + part) * block)
            segments["n"] = np.minimum((start + size)[doc], (first[doc] + part + 1) * block) - low
            held.append((segments, ids))
            ordinal, total, waiting = ordinal + len(size), total + len(ids), waiting + len(ids)
            if waiting >= block * group:
                yield from blocks(False)
                waiting = len(held[0][1])
        yield from blocks(True)

    return dealt.mapInArrow(run, "file long, block long, n_ids long, data binary")


def _read(batches, group: int, columns):
    """Batches of the segments of blocks (file, data): columns(ids, where each segment's begin and end) after file, doc_id, ordinal, start and part."""
    for batch in batches:
        for a in range(0, len(batch), group):
            some = batch.slice(a, group)
            read = read_blocks([x.as_py() for x in some.column(1)])
            if not read:
                continue
            segments = np.concatenate([s for s, _ in read])
            file = np.repeat(some.column(0).to_numpy(), [len(s) for s, _ in read])
            at = np.concatenate([[0], np.cumsum(segments["n"].astype(np.int64))])
            fixed = [pa.array(file), pa.array(segments["doc_id"], mask=segments["null"].astype(bool)), *(pa.array(segments[c].astype(np.int64)) for c in ("ordinal", "start", "part"))]
            yield fixed + columns(np.concatenate([ids for _, ids in read]).astype("<u4"), at)


_PLACE = "file long, doc_id long, ordinal long, start long, part long"


def decoded(blocks: DataFrame, group: int = GROUP) -> DataFrame:
    """(file, doc_id, ordinal, start, part, ids) of each document's part in each block; start counts the ids of its file before it."""

    def run(batches):
        held = lambda ids, at: [pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(at * 4), pa.py_buffer(ids)]).cast(pa.binary())]
        for cols in _read(batches, group, held):
            yield pa.RecordBatch.from_arrays(cols, names=["file", "doc_id", "ordinal", "start", "part", "ids"])

    return blocks.select("file", "data").mapInArrow(run, f"{_PLACE}, ids binary")


def digests(blocks: DataFrame, group: int = GROUP) -> DataFrame:
    """As `decoded`, with the number of ids and their crc32 in place of the ids, so that these don't leave the reader."""

    def run(batches):
        def sums(ids, at):
            raw = memoryview(ids.tobytes())
            return [pa.array(np.diff(at)), pa.array([zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)], pa.int64())]

        for cols in _read(batches, group, sums):
            yield pa.RecordBatch.from_arrays(cols, names=["file", "doc_id", "ordinal", "start", "part", "n", "crc"])

    return blocks.select("file", "data").mapInArrow(run, f"{_PLACE}, n long, crc long")


def crc32_combine(a: int, b: int, n: int) -> int:
    """The crc32 of two byte strings one after the other, of their crc32s and the second one's length."""
    if not n:
        return a

    def times(m: list[int], v: int) -> int:
        out = 0
        for row in m:
            if not v:
                break
            if v & 1:
                out ^= row
            v >>= 1
        return out

    square = lambda m: [times(m, x) for x in m]
    power = square(square([0xEDB88320, *(1 << i for i in range(31))]))  # four zero bits; squared once more, a byte
    while n:
        power = square(power)
        if n & 1:
            a = times(power, a)
        n >>= 1
    return a ^ b


def _joined_crc(parts: pd.Series) -> pd.Series:
    out = []
    for p in parts:
        total = 0
        for i, x in enumerate(p):
            total = x["crc"] if not i else crc32_combine(total, x["crc"], 4 * x["n"])
        out.append(total)
    return pd.Series(out, dtype="int64")


def catalogue(blocks: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each written document, from the decoded ids; start counts all ids before it."""
    whole = digests(blocks).select("file", "doc_id", "ordinal", "start", F.struct("part", "crc", "n").alias("p"))
    docs = whole.groupBy("file", "ordinal").agg(F.first("doc_id").alias("doc_id"), F.min("start").alias("inside"), F.sum("p.n").alias("n_tokens"), F.array_sort(F.collect_list("p")).alias("parts"))
    single: Column = F.col("parts")[0]["crc"]
    docs = docs.withColumn("ids_crc32", F.when(F.size("parts") == 1, single).otherwise(F.pandas_udf(_joined_crc, "long")("parts")))
    files = blocks.groupBy("file").agg(F.sum("n_ids").alias("n"))  # a row for each file
    before = F.coalesce(F.sum("n").over(W.orderBy("file").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return docs.join(files.select("file", before.alias("before")), "file").select("doc_id", (F.col("before") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")


def op7(spark, sf_dir: str) -> DataFrame:
    return catalogue(materialise(encoded(table(spark, sf_dir, "documents"), public_path())))


QUERIES = {"op7_id_files": op7}
ORACLE: dict[str, str] = {}
