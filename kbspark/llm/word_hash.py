"""Hashes of the words of a text, without a Python object per word."""

import re
from collections.abc import Iterator

import numpy as np

from kbspark.llm.common import BLOCK_BYTES, blocks

GAP = re.compile(rb"[\x20\x09-\x0D]")

_GAPS = np.zeros(256, dtype=bool)
_GAPS[[32, *range(9, 14)]] = True

_BASE = 0x9E3779B97F4A7C15


def _powers(base: int, size: int) -> np.ndarray:
    out = np.full(size, base, dtype=np.uint64)
    out[:1] = 1
    return out.cumprod(dtype=np.uint64)


_UP, _DOWN = _powers(_BASE, BLOCK_BYTES + 4096), _powers(pow(_BASE, -1, 1 << 64), BLOCK_BYTES + 4096)


def _words(text: bytes) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The bytes of a block, and where its words start and end."""
    for block in blocks(text, GAP):
        codes = np.frombuffer(block, dtype=np.uint8)
        edges = np.diff(np.concatenate([[True], _GAPS[codes], [True]]).astype(np.int8))
        yield codes, np.flatnonzero(edges == -1), np.flatnonzero(edges == 1)


def word_hashes(text: bytes) -> np.ndarray:
    """A 64-bit hash of each word, from running sums of the bytes times the powers of a base."""
    parts = []
    for codes, starts, ends in _words(text):
        up, down = (_UP, _DOWN) if len(codes) <= len(_UP) else (
            _powers(_BASE, len(codes)), _powers(pow(_BASE, -1, 1 << 64), len(codes)))
        sums = np.zeros(len(codes) + 1, dtype=np.uint64)
        np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * up[:len(codes)], out=sums[1:])
        hashes = (sums[ends] - sums[starts]) * down[starts]
        hashes ^= hashes >> np.uint64(32)
        hashes *= np.uint64(0xD6E8FEB86659FD93)
        parts.append(hashes ^ hashes >> np.uint64(29))
    return np.concatenate(parts)


def word_stems(text: bytes) -> np.ndarray:
    """The first four bytes of each word as a number; shorter words are filled up with zeros."""
    parts = []
    for codes, starts, ends in _words(text):
        padded, stems = np.append(codes, np.zeros(4, np.uint8)).astype(np.uint64), np.zeros(len(starts), np.uint64)
        for place in range(4):
            stems = stems << np.uint64(8) | np.where(starts + place < ends, padded[starts + place], np.uint64(0))
        parts.append(stems)
    return np.concatenate(parts)
