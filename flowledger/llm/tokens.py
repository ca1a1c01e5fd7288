"""Token ids of texts by the tokenizers library, for whole Arrow columns.

A byte-level BPE of this kind cuts a text into pieces before it merges bytes, and the start of each run of white space is such a
cut. So texts are cut where a run begins with a blank (space, tab, line feed, carriage return), equal pieces are found by
Arrow's dictionary encoding of the text's own bytes, and only pieces not seen before go to the library. Pieces seen before are
known by 96 bits of hashes of their bytes. A blank that follows any other kind of white space is inside a run, so there no
cut is made.
"""

from __future__ import annotations

import os
from collections.abc import Iterable

import numpy as np
import pyarrow as pa

from .shingles import byte_hashes, texts

#: Pieces that a process remembers; when there are more, it starts anew.
REMEMBERED = 2_000_000
#: Pieces that go to the library as one text.
TOGETHER = 250
BLANKS = " \t\n\r"
_BLANK = np.zeros(256, bool)
_BLANK[[ord(c) for c in BLANKS]] = True
#: Signs before which a cut is made too where a letter a-z, A-Z is in front: a run of letters ends there. None may be in a special token.
STOPS = ".,;:!?)\""
_LETTER = np.array([b < 128 and chr(b).isalpha() for b in range(256)])
_encoders: dict[str, Encoder] = {}


def _ends_in_other_space(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether the character before each place is white space that isn't a blank (all of Unicode's)."""
    b, c, d = data[at - 1], data[np.maximum(at - 2, 0)], data[np.maximum(at - 3, 0)]
    found = (b == 0x0B) | (b == 0x0C) | ((b >= 0x1C) & (b <= 0x1F)) | ((c == 0xC2) & ((b == 0x85) | (b == 0xA0)))
    found |= (d == 0xE2) & (c == 0x80) & ((b <= 0x8A) | (b == 0xA8) | (b == 0xA9) | (b == 0xAF))
    return found | ((d == 0xE2) & (c == 0x81) & (b == 0x9F)) | ((d == 0xE1) & (c == 0x9A) & (b == 0x80)) | ((d == 0xE3) & (c == 0x80) & (b == 0x80))


def pieces_of(data: np.ndarray, ends: np.ndarray, stop: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(where pieces begin in `data`, and its length at last; first piece of each text, and their number at last), for texts that end at `ends`;
    also before bytes marked in `stop`."""
    blank = _BLANK[data]
    first = blank.copy()
    first[1:] &= ~blank[:-1]
    first[:1] = False
    at = np.flatnonzero(first)
    first[at[_ends_in_other_space(data, at)]] = False
    if stop is not None:
        first[1:] |= _LETTER[data[:-1]] & stop[data[1:]]
    starts = np.concatenate([[0], ends[:-1]])
    first[starts[starts < len(data)]] = True
    begin = np.flatnonzero(first)
    return np.append(begin, len(data)), np.append(np.searchsorted(begin, starts), len(begin))


def _joined(data: np.ndarray, begin: np.ndarray, size: np.ndarray) -> bytes:
    """The bytes of some pieces, one after the other."""
    return data[np.arange(size.sum()) + np.repeat(begin - (np.cumsum(size) - size), size)].tobytes()


class Known:
    """The ids of pieces, by their hashes: an open hash table whose slots are looked up for many pieces at a time."""

    def __init__(self) -> None:
        self.bits, self.n, self.used = 16, 0, 0
        self._slots()
        self.ids, self.begin, self.count = np.zeros(1 << 16, np.uint32), np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int32)
        self.hashes = (np.zeros(1 << 14, np.uint64), np.zeros(1 << 14, np.uint32))

    def _slots(self) -> None:
        self.key, self.tag, self.place = np.zeros(1 << self.bits, np.uint64), np.zeros(1 << self.bits, np.uint32), np.full(1 << self.bits, -1, np.int32)

    def find(self, key: np.ndarray, tag: np.ndarray) -> np.ndarray:
        """Where each piece is, or -1."""
        mask = (1 << self.bits) - 1
        at, out = (key >> np.uint64(64 - self.bits)).astype(np.int64), np.full(len(key), -1, np.int64)
        left = np.arange(len(key))
        while len(left):
            here = at[left]
            place = self.place[here]
            same = (self.key[here] == key[left]) & (self.tag[here] == tag[left]) & (place >= 0)
            out[left[same]] = place[same]
            left = left[~same & (place >= 0)]
            at[left] = (at[left] + 1) & mask
        return out

    def _insert(self, key: np.ndarray, tag: np.ndarray, place: np.ndarray) -> None:
        mask = (1 << self.bits) - 1
        at, left = (key >> np.uint64(64 - self.bits)).astype(np.int64), np.arange(len(key))
        while len(left):
            free = left[self.place[at[left]] < 0]
            self.place[at[free]] = place[free]  # of several for one slot the last has it
            won = free[self.place[at[free]] == place[free]]
            self.key[at[won]], self.tag[at[won]] = key[won], tag[won]
            left = left[self.place[at[left]] != place[left]]
            at[left] = (at[left] + 1) & mask

    def add(self, key: np.ndarray, tag: np.ndarray, ids: np.ndarray, counts: np.ndarray) -> None:
        """Remember pieces that aren't known yet, whose ids come one after the other."""
        n, m = self.n, len(key)
        while self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while n + m > len(self.begin):
            self.begin, self.count = (np.concatenate([x, np.zeros_like(x)]) for x in (self.begin, self.count))
            self.hashes = tuple(np.concatenate([x, np.zeros_like(x)]) for x in self.hashes)
        self.ids[self.used : self.used + len(ids)] = ids
        self.count[n : n + m], self.begin[n : n + m] = counts, self.used + np.cumsum(counts) - counts
        self.hashes[0][n : n + m], self.hashes[1][n : n + m] = key, tag
        self.used, self.n = self.used + len(ids), n + m
        if 2 * self.n > 1 << self.bits:
            self.bits = int(2 * self.n).bit_length()
            self._slots()
            self._insert(self.hashes[0][: self.n], self.hashes[1][: self.n], np.arange(self.n))
        else:
            self._insert(key, tag, np.arange(n, n + m))


class Encoder:
    def __init__(self, path: str, remembered: int = REMEMBERED) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.remembered, self.known = remembered, Known()
        vocabulary = self.tokenizer.get_vocab()
        self.size_of = np.zeros(max(vocabulary.values()) + 1, np.int64)  # bytes of each id's token: one for each letter
        self.size_of[list(vocabulary.values())] = [len(t) for t in vocabulary]
        special = "".join(t.content for t in self.tokenizer.get_added_tokens_decoder().values())
        self.stop = np.zeros(256, bool)
        self.stop[[ord(c) for c in STOPS if c not in special]] = True

    def _encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, data: np.ndarray, begin: np.ndarray, size: np.ndarray, key: np.ndarray, tag: np.ndarray) -> None:
        """Encode pieces. Those with a blank in front and no white space behind go many as one text, and are told apart by their bytes."""
        end = begin + size
        free = _BLANK[data[begin]] & ~_BLANK[data[end - 1]] & ~_ends_in_other_space(data, end)
        some = np.flatnonzero(free)
        if len(some):
            groups = [some[a : a + TOGETHER] for a in range(0, len(some), TOGETHER)]
            ids = np.concatenate(self._encode([_joined(data, begin[g], size[g]).decode() for g in groups]))
            ends, reached = np.cumsum(size[some]), np.cumsum(self.size_of[ids])
            at = np.searchsorted(reached, ends, "right")
            if at[-1] == len(ids) and np.array_equal(reached[at - 1], ends):
                self.known.add(key[some], tag[some], ids, np.diff(at, prepend=0))
            else:
                free[:] = False  # not a vocabulary of this kind
        rest = np.flatnonzero(~free)
        if len(rest):
            made = self._encode([data[a:b].tobytes().decode() for a, b in zip(begin[rest].tolist(), end[rest].tolist(), strict=True)])
            self.known.add(key[rest], tag[rest], np.concatenate(made), np.array([len(x) for x in made]))

    def _places(self, found: pa.StringArray) -> np.ndarray:
        """Where each of some distinct pieces is remembered."""
        at = np.frombuffer(found.buffers()[1], np.int32, len(found) + 1).astype(np.int64)
        data, begin, size = np.frombuffer(found.buffers()[2], np.uint8, at[-1]), at[:-1], np.diff(at)
        key, tag = byte_hashes(data, begin, size), (byte_hashes(data, begin, size, 1) >> np.uint64(32)).astype(np.uint32)
        places = self.known.find(key, tag)
        new = np.flatnonzero(places < 0)
        if len(new):
            if self.known.n + len(new) > self.remembered:
                self.known, new = Known(), np.arange(len(places))
            self._learn(data, begin[new], size[new], key[new], tag[new])
            places[new] = self.known.find(key[new], tag[new])
        return places

    def column(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after the other, first id of each text, and their number at last); a null text is empty."""
        ids, counts = [np.zeros(0, np.uint32)], [np.zeros(1, np.int64)]
        for _, data, ends in texts(column):
            begin, of = pieces_of(data, ends, self.stop)
            each = pa.StringArray.from_buffers(len(begin) - 1, pa.py_buffer(begin.astype(np.int32)), pa.py_buffer(data)).dictionary_encode()
            at = self._places(each.dictionary)[each.indices.to_numpy()]
            n = self.known.count[at]
            reached = np.concatenate([[0], np.cumsum(n)])
            ids.append(self.known.ids[np.arange(reached[-1]) + np.repeat(self.known.begin[at] - reached[:-1], n)])
            counts.append(np.diff(reached[of]))
        return np.concatenate(ids), np.cumsum(np.concatenate(counts))

    def __call__(self, held: Iterable[str | None]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit numbers; null is empty."""
        ids, at = self.column(pa.array(list(held), pa.large_string()))
        raw = ids.astype("<u4").tobytes()
        return [raw[4 * a : 4 * b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]


def encoder(path: str) -> Encoder:
    """The process's encoder for a vocabulary file, which must be at the same place on every machine."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def public_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
