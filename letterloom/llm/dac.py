"""Directly addressable codes: token ids in levels of bit chunks, readable at any position.

A file holds the ids of many documents, one behind another. Each id is cut into chunks, lowest bits first. Level
k stores the k-th chunk of every id that has one, bit-packed, with one continuation bit each (is there a chunk
in level k + 1?) and a directory of the ones before every block of 512 bits. The chunk of level k + 1 stands at
the rank of the continuation bit, so one id is found with a few look-ups and no block is decoded.

Layout (little-endian): magic ``DAC1``; uint32 number of levels; uint64 ids, documents; per level uint64 width and
length; int64 doc ids; uint8 doc id present; uint64 ends of documents; per level the chunks, then (all but the
last) the bitmap and the uint64 directory. Every section starts at a multiple of 8 bytes.
"""

from __future__ import annotations

import math
import struct

import numpy as np

WIDTHS = (12, 4)
BLOCK = 512


def widths_for(largest: int, widths: tuple[int, ...] = WIDTHS) -> tuple[int, ...]:
    """``widths``, with further levels of the last width until ``largest`` fits."""
    out = list(widths)
    while largest >> sum(out):
        out.append(out[-1])
    return tuple(out)


def _group(width: int) -> int:
    """How many chunks of ``width`` bits fill whole bytes."""
    return 8 // math.gcd(width, 8)


def _pack(values: np.ndarray, width: int) -> bytes:
    k = _group(width)
    if k * width > 64:
        bits = np.unpackbits(values.astype("<u4").view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")
        return np.packbits(bits[:, :width], bitorder="little").tobytes()
    whole = np.zeros(-(-len(values) // k) * k, np.uint64)
    whole[: len(values)] = values & np.uint32((1 << width) - 1)
    joined = whole[::k].copy()
    for n in range(1, k):
        joined |= whole[n::k] << np.uint64(n * width)
    data = joined.astype("<u8").view(np.uint8).reshape(-1, 8)[:, : k * width // 8].tobytes()
    return data[: -(-len(values) * width // 8)]


def _unpack(data: np.ndarray, width: int, begin: int, end: int) -> np.ndarray:
    """Chunks ``begin`` to ``end`` of packed bytes."""
    k = _group(width)
    if k * width > 64:
        first = begin * width
        bits = np.unpackbits(data[first >> 3 : -(-end * width // 8)], bitorder="little")[first & 7 :][: (end - begin) * width]
        wide = np.zeros((end - begin, 32), np.uint8)
        wide[:, :width] = bits.reshape(-1, width)
        return np.packbits(wide, axis=1, bitorder="little").view("<u4").ravel()
    a, b, size = begin // k, -(-end // k), k * width // 8
    wide = np.zeros((b - a, 8), np.uint8)
    part = data[a * size : b * size]
    rows = len(part) // size
    wide[:rows, :size] = part[: rows * size].reshape(-1, size)
    wide[rows:, : len(part) - rows * size] = part[rows * size :]
    joined, out = wide.view("<u8").ravel(), np.empty((b - a, k), np.uint32)
    for n in range(k):
        out[:, n] = (joined >> np.uint64(n * width)) & np.uint64((1 << width) - 1)
    return out.ravel()[begin - a * k : end - a * k]


def encode(ids: np.ndarray, doc_ids: list, ends: np.ndarray, widths: tuple[int, ...] = WIDTHS) -> bytes:
    """The file for ``ids`` (any unsigned integers below 2**32) of documents that end at ``ends``."""
    ids = np.asarray(ids, np.uint32)
    widths = widths_for(int(ids.max(initial=0)), widths)
    rest, sections, lengths = ids, [], []
    for k, width in enumerate(widths):
        lengths.append(len(rest))
        sections.append(b"".join(_pack(rest[i : i + (1 << 18)], width) for i in range(0, len(rest), 1 << 18)))
        if k + 1 < len(widths):
            more = (rest >> np.uint32(width)) != 0
            bitmap = np.zeros(-(-len(rest) // BLOCK) * BLOCK // 8, np.uint8)
            packed = np.packbits(more, bitorder="little")
            bitmap[: len(packed)] = packed
            ones = np.bitwise_count(bitmap.view("<u8")).reshape(-1, BLOCK // 64).sum(axis=1, dtype=np.uint64)
            sections += [bitmap.tobytes(), np.append(np.uint64(0), np.cumsum(ones, dtype=np.uint64)).astype("<u8").tobytes()]
            rest = rest[more] >> np.uint32(width)
    present = np.array([d is not None for d in doc_ids], np.uint8)
    names = np.array([0 if d is None else d for d in doc_ids], "<i8")
    head = b"DAC1" + struct.pack("<I2Q", len(widths), len(ids), len(doc_ids)) + b"".join(struct.pack("<2Q", w, n) for w, n in zip(widths, lengths, strict=True))
    return b"".join(x + b"\0" * (-len(x) % 8) for x in (head, names.tobytes(), present.tobytes(), np.asarray(ends, "<u8").tobytes(), *sections))


class Reader:
    """Random access to a file's ids: ``reader[positions]``, ``reader.span(i, j)``, ``reader.document(k)``."""

    def __init__(self, data: bytes):
        if data[:4] != b"DAC1":
            raise ValueError("not a file of directly addressable codes")
        levels, self.n_ids, self.n_docs = struct.unpack_from("<I2Q", data, 4)
        at = 24 + 16 * levels
        shape = [struct.unpack_from("<2Q", data, 24 + 16 * k) for k in range(levels)]

        def section(kind: str, count: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(data, kind, count, at)
            at += -(-out.nbytes // 8) * 8
            return out

        names, present = section("<i8", self.n_docs), section("u1", self.n_docs)
        self.doc_ids = [int(d) if p else None for d, p in zip(names, present, strict=True)]
        self.ends = section("<u8", self.n_docs).astype(np.int64)
        self.levels = []
        for k, (width, length) in enumerate(shape):
            chunks, bitmap, ones = None, None, None
            chunks = section("u1", self._packed_bytes(width, length))
            if k + 1 < levels:
                blocks = -(-length // BLOCK)
                bitmap, ones = section("<u8", blocks * BLOCK // 64), section("<u8", blocks + 1)
            self.levels.append((width, length, chunks, bitmap, ones))

    @staticmethod
    def _packed_bytes(width: int, length: int) -> int:
        whole, rest = divmod(length, 1 << 18)
        return whole * (-(-(width << 18) // 8)) + -(-rest * width // 8)

    @staticmethod
    def _chunks(level, at: np.ndarray) -> np.ndarray:
        width, _, chunks, _, _ = level
        first = at * width
        out = np.zeros(len(at), np.uint64)
        for k in range(-(-(width + 7) // 8)):
            byte = (first >> 3) + k
            out |= np.where(byte < len(chunks), chunks[np.minimum(byte, len(chunks) - 1)], 0).astype(np.uint64) << np.uint64(8 * k)
        return (out >> (first & 7).astype(np.uint64)) & np.uint64((1 << width) - 1)

    @staticmethod
    def _continued(level, at: np.ndarray) -> np.ndarray:
        words = level[3][at >> 6]
        return ((words >> (at & 63).astype(np.uint64)) & np.uint64(1)).astype(bool)

    @staticmethod
    def _rank(level, at: np.ndarray) -> np.ndarray:
        """Ones before each position: the directory's count and those in the words of its block."""
        _, _, _, bitmap, ones = level
        words = bitmap.reshape(-1, BLOCK // 64)[at // BLOCK]
        place = (at % BLOCK)[:, None] - 64 * np.arange(BLOCK // 64)
        full = np.clip(place, 0, 63).astype(np.uint64)
        mask = np.where(place >= 64, np.uint64(2**64 - 1), (np.uint64(1) << full) - np.uint64(1))
        return ones[at // BLOCK].astype(np.int64) + np.bitwise_count(words & mask).sum(axis=1, dtype=np.int64)

    def __getitem__(self, at) -> np.ndarray:
        at = np.atleast_1d(np.asarray(at, np.int64))
        if len(at) and (at.min() < 0 or at.max() >= self.n_ids):
            raise IndexError("no such position")
        out, here, shift = np.zeros(len(at), np.uint32), np.arange(len(at)), 0
        for k, level in enumerate(self.levels):
            if not len(at):
                break
            out[here] |= (self._chunks(level, at) << np.uint64(shift)).astype(np.uint32)
            if k + 1 < len(self.levels):
                more = self._continued(level, at)
                here, at = here[more], self._rank(level, at[more])
            shift += level[0]
        return out

    def span(self, begin: int, end: int) -> np.ndarray:
        """Ids from ``begin`` to ``end``: one rank per level, as neighbours' chunks are neighbours there."""
        out, shift = np.zeros(end - begin, np.uint32), 0
        here = slice(None)
        for k, level in enumerate(self.levels):
            if end <= begin:
                break
            width, _, chunks, bitmap, _ = level
            out[here] |= _unpack(chunks, width, begin, end) << np.uint32(shift)
            if k + 1 < len(self.levels):
                bits = np.unpackbits(bitmap[begin >> 6 : (end >> 6) + 1].view(np.uint8), bitorder="little")
                more = np.flatnonzero(bits[begin & 63 :][: end - begin])
                here = more if k == 0 else here[more]
                begin = int(self._rank(level, np.array([begin]))[0]) if len(more) else 0
                end = begin + len(more)
            shift += width
        return out

    def document(self, k: int) -> np.ndarray:
        return self.span(int(self.ends[k - 1]) if k else 0, int(self.ends[k]))

    def documents(self, at_once: int = 1 << 16):
        """The ids of all documents in order; neighbours of up to about ``at_once`` ids are read as one span."""
        begin = k = 0
        while k < self.n_docs:
            last = max(k + 1, int(np.searchsorted(self.ends, begin + at_once, side="right")))
            ids = self.span(begin, int(self.ends[last - 1]))
            yield from np.split(ids, self.ends[k : last - 1] - begin)
            begin, k = int(self.ends[last - 1]), last
