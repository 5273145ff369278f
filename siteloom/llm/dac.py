"""Directly addressable codes: integers split into chunk levels, so that any one of them is read without its neighbours.

Level 0 holds the lowest 8 bits of every integer, and a continuation bitmap that marks those with more bits; level 1
holds the next 8 bits of the marked ones only, and so on. A rank directory beside each bitmap counts the set bits before
every 512th bit, so the place of an integer in the next level is one directory entry and one short count away.

Layout, little-endian: b"DAC1", u32 levels, u64 count; then for each level u64 length, the chunks (u8), and, for all but
the last, the bitmap (ceil(length / 8) bytes, lowest bit first) and the directory (u32 for each 512 bits).
"""

from __future__ import annotations

import struct

import numpy as np

_STEP = 512


def pack(ids: np.ndarray) -> bytes:
    levels, rest = [], ids.astype(np.uint32)
    while True:
        higher = rest >> np.uint32(8)
        more = higher > 0
        levels.append((rest.astype(np.uint8), more))
        if not more.any():
            break
        rest = higher[more]
    out = [b"DAC1", struct.pack("<IQ", len(levels), len(ids))]
    for k, (chunks, more) in enumerate(levels):
        out += [struct.pack("<Q", len(chunks)), chunks.tobytes()]
        if k + 1 < len(levels):
            ones = np.add.reduceat(more, np.arange(0, len(more), _STEP), dtype=np.uint32)
            out += [
                np.packbits(more, bitorder="little").tobytes(),
                (np.cumsum(ones, dtype=np.uint32) - ones).astype("<u4").tobytes(),
            ]
    return b"".join(out)


class Packed:
    """A view of packed integers; nothing is decoded until it is asked for."""

    def __init__(self, data: bytes):
        if data[:4] != b"DAC1":
            raise ValueError("not a directly addressable code")
        n_levels, self.count = struct.unpack_from("<IQ", data, 4)
        at, self.levels = 16, []
        for k in range(n_levels):
            (n,) = struct.unpack_from("<Q", data, at)
            chunks = np.frombuffer(data, np.uint8, n, at + 8)
            at += 8 + n
            bits = ranks = None
            if k + 1 < n_levels:
                bits = np.frombuffer(data, np.uint8, -(-n // 8), at)
                at += len(bits)
                ranks = np.frombuffer(data, "<u4", -(-n // _STEP), at)
                at += 4 * len(ranks)
            self.levels.append((chunks, bits, ranks))

    def __len__(self) -> int:
        return self.count

    def __getitem__(self, i: int) -> int:
        if not 0 <= i < self.count:
            raise IndexError(i)
        value = shift = 0
        for chunks, bits, ranks in self.levels:
            value |= int(chunks[i]) << shift
            if bits is None or not bits[i >> 3] >> (i & 7) & 1:
                break
            first = i // _STEP * _STEP
            whole = int.from_bytes(bits[first >> 3 : (i >> 3) + 1].tobytes(), "little")
            i = int(ranks[i // _STEP]) + (whole & ((1 << (i - first)) - 1)).bit_count()
            shift += 8
        return value

    def all(self) -> np.ndarray:
        out = None
        for chunks, bits, _ in reversed(self.levels):
            here = chunks.astype(np.uint32)
            if out is not None:
                here[np.unpackbits(bits, count=len(chunks), bitorder="little").astype(bool)] |= out << np.uint32(8)
            out = here
        return out
