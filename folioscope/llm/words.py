"""Comparing words."""

from __future__ import annotations


def lcs(a: str, b: str) -> int:
    """Length of the longest common subsequence, with bit-parallel rows."""
    masks: dict[str, int] = {}
    for k, c in enumerate(a):
        masks[c] = masks.get(c, 0) | 1 << k
    row = (1 << len(a)) - 1
    for c in b:
        m = row & masks.get(c, 0)
        row = (row + m) | (row - m)
    return len(a) - bin(row & ((1 << len(a)) - 1)).count("1")
