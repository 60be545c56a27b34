"""Static range asymmetric numeral system over token ids, vectorised over lanes.

All blocks share one frequency table that sums to 2^20. Ids of a block are dealt
to interleaved lanes (id i to lane i mod lanes); every lane has a 64-bit state
in [2^31, 2^63) that gives off 32-bit words. A block stands alone, so blocks
decode in parallel.

Payload of a segment, little-endian: b"TRS1", number of blocks (u32), then per
block its checkpoint: byte offset in the payload (u64), number of ids (u32),
lanes (u32), CRC-32 of the ids as u32 (u32). Then the blocks: lane states
(u64 each), then the words (u32) in decoding order.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

SCALE_BITS = 20
SCALE = 1 << SCALE_BITS
LOW = np.uint64(1 << 31)
BLOCK_IDS = 1 << 18
LANES = 2048
MAGIC = b"TRS1"
_HEAD, _POINT = struct.Struct("<4sI"), struct.Struct("<QIII")


class Table:
    """Frequencies of ids 0..n-1; an id that has none cannot be coded."""

    def __init__(self, freq: np.ndarray):
        self.freq = freq.astype(np.uint64)
        self.start = (np.cumsum(freq) - freq).astype(np.uint64)
        self._symbol = None

    @property
    def symbol(self) -> np.ndarray:
        if self._symbol is None:
            self._symbol = np.repeat(np.arange(len(self.freq), dtype=np.uint32), self.freq.astype(np.int64))
        return self._symbol


def scaled(counts: np.ndarray) -> np.ndarray:
    """Counts scaled to sum to SCALE, at least 1 for every id that occurs."""
    counts = np.asarray(counts, dtype=np.int64)
    seen = counts > 0
    if not seen.any():
        return np.zeros(len(counts), dtype=np.int64)
    if seen.sum() > SCALE:
        raise ValueError("more distinct ids than the table can hold")
    share = counts.astype(np.float64) / counts.sum()
    freq = np.where(seen, np.maximum(1, np.floor(share * SCALE)), 0).astype(np.int64)
    over = int(freq.sum()) - SCALE
    order = np.argsort(-freq, kind="stable")
    if over < 0:
        freq[order[0]] -= over
    at = 0
    while over > 0:  # take from the most frequent ids, keeping 1
        i = order[at % len(order)]
        cut = min(over, max(0, int(freq[i]) - 1), max(1, int(freq[i]) // 8))
        freq[i] -= cut
        over -= cut
        at += 1
    return freq


def _encode_block(ids: np.ndarray, table: Table, lanes: int) -> bytes:
    freq, start = table.freq[ids], table.start[ids]
    if not freq.all():
        raise ValueError("an id has no frequency")
    limit = freq << np.uint64(63 - SCALE_BITS)
    x = np.full(lanes, LOW, dtype=np.uint64)
    out = []
    s32, bits = np.uint64(32), np.uint64(SCALE_BITS)
    for at in range((len(ids) - 1) // lanes * lanes, -1, -lanes):
        f, s, most = freq[at : at + lanes], start[at : at + lanes], limit[at : at + lanes]
        own = x[: len(f)]
        full = own >= most
        if full.any():
            out.append(own[full].astype(np.uint32))
            own[full] >>= s32
        q = own // f
        own[:] = (q << bits) + (own - q * f) + s
    return x.astype("<u8").tobytes() + b"".join(w.astype("<u4").tobytes() for w in reversed(out))


def _decode_block(data: memoryview, n: int, lanes: int, table: Table) -> np.ndarray:
    x = np.frombuffer(data, dtype="<u8", count=lanes).astype(np.uint64)
    words = np.frombuffer(data, dtype="<u4", offset=8 * lanes)
    out = np.empty(n, dtype=np.uint32)
    freq, start, symbol = table.freq, table.start, table.symbol
    mask, bits, s32 = np.uint64(SCALE - 1), np.uint64(SCALE_BITS), np.uint64(32)
    at_word = 0
    for at in range(0, n, lanes):
        own = x[: min(lanes, n - at)]
        slot = own & mask
        ids = symbol[slot.astype(np.int64)]
        out[at : at + len(own)] = ids
        own[:] = freq[ids] * (own >> bits) + slot - start[ids]
        need = own < LOW
        k = int(np.count_nonzero(need))
        if k:
            own[need] = (own[need] << s32) | words[at_word : at_word + k]
            at_word += k
    return out


def encode(ids: np.ndarray, table: Table, block_ids: int = BLOCK_IDS, lanes: int = LANES) -> bytes:
    """One segment: ids in even blocks of about block_ids."""
    n = len(ids)
    blocks = max(1, round(n / block_ids)) if n else 0
    edges = [n * i // blocks for i in range(blocks + 1)] if blocks else [0]
    points, bodies, offset = [], [], _HEAD.size + blocks * _POINT.size
    for a, b in zip(edges, edges[1:]):
        part = np.ascontiguousarray(ids[a:b])
        own = max(1, min(lanes, (b - a) // 64))
        body = _encode_block(part, table, own)
        points.append(_POINT.pack(offset, b - a, own, zlib.crc32(part.astype("<u4").tobytes())))
        bodies.append(body)
        offset += len(body)
    return _HEAD.pack(MAGIC, blocks) + b"".join(points) + b"".join(bodies)


def decode(payload: bytes, table: Table, block: int | None = None) -> np.ndarray:
    """The ids of a segment, or of one of its blocks; checksums are verified."""
    magic, blocks = _HEAD.unpack_from(payload)
    if magic != MAGIC:
        raise ValueError("not a token segment")
    points = [_POINT.unpack_from(payload, _HEAD.size + i * _POINT.size) for i in range(blocks)]
    ends = [p[0] for p in points[1:]] + [len(payload)]
    view, parts = memoryview(payload), []
    for i, ((offset, n, lanes, crc), end) in enumerate(zip(points, ends)):
        if block is None or i == block:
            part = _decode_block(view[offset:end], n, lanes, table)
            if zlib.crc32(part.astype("<u4").tobytes()) != crc:
                raise ValueError(f"checksum of block {i} differs")
            parts.append(part)
    return np.concatenate(parts) if parts else np.empty(0, dtype=np.uint32)
