"""Hashed features of words, computed for many words at once."""

from __future__ import annotations

import re

import numpy as np

_letter_runs = re.compile(r"[^\W\d_]+").findall
#: Letters of a word at most; longer runs become several words, each of which shares half its letters with the next.
WIDTH = 24
_MULT = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F], np.uint64)


def find_words(text: str) -> list[str]:
    """Runs of letters (and rare letter-like numbers); a run above ``WIDTH`` letters as overlapping pieces that hold all of it."""
    runs = _letter_runs(text)
    if max(map(len, runs), default=0) <= WIDTH:
        return runs
    half = WIDTH // 2
    return [r[i:i + WIDTH] for r in runs for i in (range(0, len(r) - half, half) if len(r) > WIDTH else (0,))]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def word_features(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of each word, of its affixes of one to three characters (six columns) and of its two- and three-character n-grams.

    Words have ``WIDTH`` letters at most (``find_words``). Places that a short word lacks hold 0.
    """
    n = len(words)
    raw = np.array(words, dtype=f"U{WIDTH}").view(np.uint32).reshape(n, WIDTH).astype(np.uint64)
    size = np.fromiter(map(len, words), np.int64, n)
    code = np.zeros((n, WIDTH + 2), np.uint64)
    code[:, 1:-1] = raw
    code[:, 0] = 1
    code[np.arange(n), size + 1] = 2
    place = np.arange(WIDTH + 2)[None, :]
    two = _mix(code[:, :-1] * _MULT[0] + code[:, 1:] * _MULT[1] + np.uint64(2))
    two[place[:, :-1] > size[:, None]] = 0
    three = _mix(code[:, :-2] * _MULT[0] + code[:, 1:-1] * _MULT[1] + code[:, 2:] * _MULT[2] + np.uint64(3))
    three[place[:, :-2] > size[:, None] - 1] = 0
    affixes = np.zeros((n, 6), np.uint64)
    ends = np.take_along_axis(code, np.maximum(size[:, None] - np.arange(3)[None, :], 0), axis=1)
    for k in (1, 2, 3):
        front = sum((code[:, i + 1] * _MULT[i] for i in range(k)), np.uint64(10 + k))
        back = sum((ends[:, i] * _MULT[i] for i in range(k)), np.uint64(20 + k))
        affixes[:, k - 1] = np.where(size >= k, _mix(front), 0)
        affixes[:, k + 2] = np.where(size >= k, _mix(back), 0)
    whole = np.full(n, 0x1234567, np.uint64)
    for i in range(WIDTH):
        whole = (whole ^ raw[:, i]) * np.uint64(0x100000001B3)
    return _mix(whole), affixes, np.concatenate((two, three), axis=1)
