"""Masks of MinHash: a hash XOR a mask is a permutation of all hashes."""

from __future__ import annotations

import random


def masks(n: int) -> list[int]:
    """Signed 64-bit masks, spread by their highest bits."""
    return [random.Random(k).getrandbits(59) - (1 << 63) + (int(f"{k % 32:05b}"[::-1], 2) << 59) for k in range(n)]
