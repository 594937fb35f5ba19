"""Burrows-Wheeler transforms of string collections, and their merge by interleave refinement."""

from __future__ import annotations

import numpy as np


def transform(strings: list[bytes], depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(symbol pairs, string numbers, offsets) of a shard: rotations of each string closed by an end mark, sorted by ``depth`` symbols.

    Symbols are bytes plus one and 0 for the end mark; UTF-8 has no byte 255. A pair holds the symbol before a
    rotation in its low byte and the one before that in its high byte. Strings must have ``depth`` bytes at least.
    """
    sizes = np.array([len(s) for s in strings], np.int64)
    # each string, its end mark and its beginning again, so that every rotation's prefix is at hand
    data = np.frombuffer(b"".join(s + b"\xff" + s[: depth - 1] for s in strings), np.uint8) + np.uint8(1)
    begins = np.append(0, np.cumsum(sizes + depth)[:-1])
    number = np.repeat(np.arange(len(strings)), sizes + 1)
    offset = np.arange(len(number)) - np.repeat(np.append(0, np.cumsum(sizes + 1)[:-1]), sizes + 1)
    at = begins[number] + offset
    keys = np.lib.stride_tricks.sliding_window_view(data, depth)[at]
    order = np.argsort(np.ascontiguousarray(keys).view(f"S{depth}").ravel(), kind="stable")
    number, offset = number[order], offset[order]
    begin, size = begins[number], sizes[number]
    before = np.where(offset > 0, offset - 1, size)
    further = np.where(before > 0, before - 1, size)
    return data[begin + before] | data[begin + further].astype(np.uint16) << np.uint16(8), number, offset


def merge(left: np.ndarray, right: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Interleave two transforms so that rotations stand in the order of ``depth`` symbols; nothing is sorted anew.

    Starts with all of ``left`` before all of ``right``. One round reads the interleaved symbols and deals their
    sources out by symbol, in order: that sorts by what was read more, as each rotation moves to where the longer
    rotation stands. A round takes two symbols, a last one the odd symbol. Where neighbours part, in the symbols or
    in what they were dealt from, a block of common prefixes ends. Returns (source: False for left, block number)
    in the final order.
    """
    source = np.zeros(len(left) + len(right), bool)
    source[len(left) :] = True
    block = np.zeros(len(source), np.int32)
    symbols = np.empty(len(source), np.uint16)
    new = np.ones(len(source), bool)
    for mask in [0xFFFF] * (depth // 2) + [0xFF] * (depth % 2):
        symbols[source] = right & np.uint16(mask)
        symbols[~source] = left & np.uint16(mask)
        order = np.argsort(symbols, kind="stable")
        source, dealt, block = source[order], symbols[order], block[order]
        np.not_equal(dealt[1:], dealt[:-1], out=new[1:])
        new[1:] |= block[1:] != block[:-1]
        block = np.cumsum(new, dtype=np.int32) - 1
    return source, block


def repeated_minima(strings: list[bytes], values: np.ndarray, depth: int) -> list[np.ndarray]:
    """For each string and each of its ``depth``-byte substrings, the least value of any string that has it.

    The strings go to two shards, whose transforms are merged; substrings of one block are equal.
    """
    half = len(strings) // 2
    shards = [strings[:half], strings[half:]] if half else [strings, []]
    parts = [transform(s, depth) if s else (np.zeros(0, np.uint16), np.zeros(0, np.int64), np.zeros(0, np.int64)) for s in shards]
    source, block = merge(parts[0][0], parts[1][0], depth)
    number, offset = np.empty(len(source), np.int64), np.empty(len(source), np.int64)
    for here, (_, n, o), first in ((~source, parts[0], 0), (source, parts[1], half)):
        number[here], offset[here] = n + first, o
    sizes = np.array([len(s) for s in strings], np.int64)
    whole = offset + depth <= sizes[number]  # the others run over the end of their string
    value = np.where(whole, values[number], np.iinfo(np.int64).max)
    starts = np.flatnonzero(np.append(True, block[1:] != block[:-1]))
    least = np.minimum.reduceat(value, starts)[block]
    counts = sizes - depth + 1
    begins = np.append(0, np.cumsum(counts))
    out = np.empty(begins[-1], np.int64)
    out[begins[number[whole]] + offset[whole]] = least[whole]
    return [out[begins[k] : begins[k + 1]] for k in range(len(strings))]
