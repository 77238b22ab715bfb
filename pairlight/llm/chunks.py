"""Cut texts where every pre-tokenizer of the byte-level kind cuts as well, and remember what a chunk encodes to.

The split pattern of byte-level BPE never lets a match run over a place where a
blank is followed by something that is not white space: the blank opens the
next match. A text is therefore the sequence of its chunks, cut before such
blanks, and its token ids are the ids of its chunks in a row. Prose repeats its
chunks, so a task encodes each distinct one about once.

All of it works on whole groups of texts as numpy arrays: chunk borders from the
bytes, two 64-bit polynomial hashes of every chunk from running sums, the known
chunks in an open-addressing table, the ids in one pool.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa

#: Bytes after a blank that may begin white space: the blank is then no border. More than needed, which is safe.
_SPACY = np.zeros(256, dtype=bool)
_SPACY[[*range(0x09, 0x0E), *range(0x1C, 0x21), 0xC2, 0xE1, 0xE2, 0xE3]] = True
_LONG = 256  # longer chunks are not remembered


def short_batches(batches, rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Short stretches of Arrow batches, so that what is made of a batch stays small beside it."""
    for batch in batches:
        for k in range(0, len(batch), rows):
            yield batch.slice(k, rows)


class _Powers:
    """Powers of a random odd number and of its inverse, modulo 2**64."""

    def __init__(self):
        self.base = int.from_bytes(os.urandom(8), "little") | 5
        self.powers = self.inverses = np.ones(1, dtype=np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.powers) < n:
            size = 1 << n.bit_length()
            self.powers = np.concatenate([[np.uint64(1)], np.full(size - 1, self.base, dtype=np.uint64)]).cumprod(dtype=np.uint64)
            inverse = pow(self.base, -1, 1 << 64)
            self.inverses = np.concatenate([[np.uint64(1)], np.full(size - 1, inverse, dtype=np.uint64)]).cumprod(dtype=np.uint64)
        return self.powers[:n], self.inverses[:n]


class _Known:
    """Hash pairs of chunks and their ids."""

    def __init__(self, limit: int):
        self.limit, self.bits = limit, 12
        self.empty()

    def empty(self) -> None:
        self.first = np.zeros(1 << self.bits, dtype=np.uint64)  # zero: free
        self.second = np.zeros(1 << self.bits, dtype=np.uint64)
        self.entry = np.zeros(1 << self.bits, dtype=np.int32)
        self.n = 0
        self.offset, self.count = np.zeros(1 << 12, dtype=np.int64), np.zeros(1 << 12, dtype=np.int32)
        self.pool, self.used = np.zeros(1 << 14, dtype=np.uint32), 0

    def find(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Entry numbers, -1 for unknown."""
        mask, shift = (1 << self.bits) - 1, np.uint64(64 - self.bits)
        at = (a >> shift).astype(np.int64)
        here = self.first[at]
        hit = (here == a) & (self.second[at] == b)
        out = np.where(hit, self.entry[at], -1)
        todo = np.flatnonzero(~hit & (here != 0))
        while len(todo):
            at[todo] = (at[todo] + 1) & mask
            here = self.first[at[todo]]
            hit = (here == a[todo]) & (self.second[at[todo]] == b[todo])
            out[todo[hit]] = self.entry[at[todo[hit]]]
            todo = todo[~hit & (here != 0)]
        return out

    def _place(self, a: np.ndarray, b: np.ndarray, entry: np.ndarray) -> None:
        mask, todo = (1 << self.bits) - 1, np.arange(len(a))
        at = (a >> np.uint64(64 - self.bits)).astype(np.int64)
        while len(todo):
            free = todo[self.first[at[todo]] == 0]
            _, one = np.unique(at[free], return_index=True)
            won = free[one]
            self.first[at[won]], self.second[at[won]], self.entry[at[won]] = a[won], b[won], entry[won]
            todo = np.setdiff1d(todo, won, assume_unique=True)
            at[todo] = (at[todo] + 1) & mask

    def add(self, a: np.ndarray, b: np.ndarray, ids: list[bytes]) -> np.ndarray:
        """Numbers of new entries; pairs must be distinct and unknown."""
        n = len(a)
        if 2 * (self.n + n) > len(self.first):
            old = np.flatnonzero(self.first)
            kept = self.first[old], self.second[old], self.entry[old]
            while 2 * (self.n + n) > 1 << self.bits:
                self.bits += 1
            self.first, self.second, self.entry = np.zeros(1 << self.bits, dtype=np.uint64), np.zeros(1 << self.bits, dtype=np.uint64), np.zeros(1 << self.bits, dtype=np.int32)
            self._place(*kept)
        number = np.arange(self.n, self.n + n, dtype=np.int32)
        self._place(a, b, number)
        flat = np.frombuffer(b"".join(ids), dtype="<u4")
        sizes = np.fromiter(map(len, ids), dtype=np.int64, count=n) // 4
        for name, need in (("offset", self.n + n), ("count", self.n + n), ("pool", self.used + len(flat))):
            if need > len(getattr(self, name)):
                setattr(self, name, np.resize(getattr(self, name), 2 * need))
        self.offset[number], self.count[number] = self.used + np.cumsum(sizes) - sizes, sizes
        self.pool[self.used : self.used + len(flat)] = flat
        self.n, self.used = self.n + n, self.used + len(flat)
        return number

    def ids(self, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of these entries in a row, and how many each has."""
        sizes = self.count[number].astype(np.int64)
        return self.pool[np.repeat(self.offset[number] - np.cumsum(sizes) + sizes, sizes) + np.arange(int(sizes.sum()))], sizes


class ChunkEncoder:
    """Encodes whole texts by their chunks.

    `encode` gives the ids of many strings as bytes of little-endian 32-bit
    integers. About `limit` chunks are remembered; then all are forgotten, which
    costs time and never changes a result. Hashes use random numbers of the
    process; two different chunks of up to 256 bytes would have to agree in both.
    """

    def __init__(self, encode: Callable[[list[str]], list[bytes]], limit: int = 400_000, group_chars: int = 1 << 18):
        self.encode, self.group_chars = encode, group_chars
        self.known = _Known(limit)
        self.one, self.two = _Powers(), _Powers()

    def texts(self, texts: Iterable[str]) -> Iterator[bytes]:
        group: list[bytes] = []
        size = 0
        for text in texts:
            group.append(text.encode())
            size += len(group[-1])
            if size >= self.group_chars:
                yield from self._group(group)
                group, size = [], 0
        if group:
            yield from self._group(group)

    def _group(self, texts: list[bytes]) -> Iterator[bytes]:
        raw = b"".join(texts)
        if not raw:
            yield from [b""] * len(texts)
            return
        data = np.frombuffer(raw, dtype=np.uint8)
        sizes = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
        begin = np.cumsum(sizes) - sizes
        border = np.zeros(len(data), dtype=bool)
        border[:-1] = (data[:-1] == 0x20) & ~_SPACY[data[1:]]
        tail = (begin + sizes - 1)[sizes > 0]
        border[tail[data[tail] == 0x20]] = False  # what follows a text's last blank is another text
        border[begin[sizes > 0]] = True
        start = np.flatnonzero(border)
        end = np.append(start[1:], len(data))
        a, b = (self._hashes(data, start, end, p) for p in (self.one, self.two))
        number = self._numbers(raw, start, end, a, b)
        ids, counts = self.known.ids(number)
        flat = ids.astype("<u4").tobytes()
        stops = np.concatenate([[0], np.cumsum(counts)])
        first = np.searchsorted(start, begin)  # an empty text has no chunk
        last = np.append(first[1:], len(start))
        for i, j in zip(stops[first].tolist(), stops[last].tolist()):
            yield flat[4 * i : 4 * j]

    @staticmethod
    def _hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, p: _Powers) -> np.ndarray:
        powers, inverses = p.upto(len(data))
        sums = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers, out=sums[1:])
        h = (sums[end] - sums[start]) * inverses[start]
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
        return np.where(h == 0, np.uint64(1), h)

    def _numbers(self, raw: bytes, start: np.ndarray, end: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        known = self.known
        if known.n > known.limit:
            known.empty()
        short = end - start <= _LONG
        number = np.where(short, known.find(a, b), -1)
        new = np.flatnonzero(number < 0)
        if not len(new):
            return number
        # long chunks are told apart by their place, so each is encoded for itself and found no more
        x, y = np.where(short[new], a[new], np.uint64(0)), np.where(short[new], b[new], start[new].astype(np.uint64))
        order = np.lexsort((y, x))
        head = np.ones(len(new), dtype=bool)
        head[1:] = (x[order[1:]] != x[order[:-1]]) | (y[order[1:]] != y[order[:-1]])
        one = new[order[head]]
        made = self.encode([raw[i:j].decode() for i, j in zip(start[one].tolist(), end[one].tolist())])
        keep = a[one], np.where(short[one], b[one], np.uint64(0))  # no chunk is looked for under a second hash of zero
        entries = known.add(*keep, made)
        number[new[order]] = entries[np.cumsum(head) - 1]
        return number
