"""Spans of large code arrays in numpy: 64-bit keys for them, and a bounded memory of what was found for a key.

A span's key is a polynomial over random 64-bit values of its codes, mixed with its length; within the blocks
that are compared, distinct spans can't be expected to share one.
"""

from __future__ import annotations

import numpy as np

_M = np.uint64
_BASE = _M(0xD6E8FEB86659FD93)
_INVERSE = _M(pow(0xD6E8FEB86659FD93, -1, 1 << 64))
_VALUES = np.random.default_rng(20240229).integers(1, 1 << 63, 1 << 16, dtype=np.uint64) * _M(2) + _M(1)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _upto(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0 to n of the base and of its inverse, modulo 2**64."""
    if len(_powers[0]) <= n:
        for k, b in enumerate((_BASE, _INVERSE)):
            p = np.full(n + 1, b, np.uint64)
            p[0] = 1
            _powers[k] = np.cumprod(p)
    return _powers[0], _powers[1]


def forget() -> None:
    """Drop the powers, which are as many as the codes of the longest block."""
    _powers[:] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _M(30))) * _M(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _M(27))) * _M(0x94D049BB133111EB)
    return x ^ (x >> _M(31))


def keys(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A key of each span codes[start:end]."""
    up, down = _upto(len(codes))
    values = _VALUES[codes & 0xFFFF] if codes.dtype.itemsize > 2 else _VALUES[codes]
    if codes.dtype.itemsize > 2:
        values = values + (codes >> 16).astype(np.uint64) * _M(0x9E3779B97F4A7C15)
    total = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(values * up[: len(codes)], out=total[1:])
    return mixed((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def gather(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """The indexes of spans, one span after another."""
    ends = np.cumsum(lens)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(starts - (ends - lens), lens)


class Memo:
    """What each key's span became: a stretch of 32-bit ids. Beyond ``most`` keys it keeps those last asked for."""

    def __init__(self, most: int):
        self.most = most
        self.keys, self.starts, self.lens, self.flat = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def unknown(self, asked: np.ndarray) -> np.ndarray:
        """Which of the keys it doesn't hold."""
        if not len(self.keys):
            return np.ones(len(asked), bool)
        return self.keys[np.minimum(np.searchsorted(self.keys, asked), len(self.keys) - 1)] != asked

    def learn(self, new: np.ndarray, flat: np.ndarray, lens: np.ndarray) -> None:
        every = np.concatenate((self.keys, new))
        order = np.argsort(every, kind="stable")
        starts = np.concatenate((self.starts, len(self.flat) + np.cumsum(lens) - lens))
        self.keys, self.starts, self.lens = every[order], starts[order], np.concatenate((self.lens, lens))[order]
        self.flat = np.concatenate((self.flat, flat))

    def places(self, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and lengths, in ``flat``, of keys it holds."""
        at = np.searchsorted(self.keys, asked)
        return self.starts[at], self.lens[at]

    def trim(self, asked: np.ndarray) -> None:
        if len(self.keys) > self.most:
            starts, lens = self.places(asked)
            self.flat = self.flat[gather(starts, lens)]
            self.keys, self.starts, self.lens = asked, np.cumsum(lens) - lens, lens


def merged(memo: Memo, codes: np.ndarray, starts: np.ndarray, ends: np.ndarray, find) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the spans, one after another, and their numbers. find(keys, starts, ends) gives (ids, numbers) of the
    distinct spans that the memo doesn't hold."""
    if not len(starts):
        return np.zeros(0, np.int32), np.zeros(0, np.int64)
    own = keys(codes, starts, ends)
    distinct, first, inverse = np.unique(own, return_index=True, return_inverse=True)
    new = np.flatnonzero(memo.unknown(distinct))
    if len(new):
        flat, lens = find(distinct[new], starts[first[new]], ends[first[new]])
        memo.learn(distinct[new], flat, lens)
    at, n = memo.places(distinct)
    lens = n[inverse]
    out = memo.flat[gather(at[inverse], lens)]
    memo.trim(distinct)
    return out, lens


def portions(batches, chars: int):
    """Arrow batches of (columns..., text) as lists of rows with about ``chars`` characters of text at most, but for
    longer single texts."""
    rows, size = [], 0
    for batch in batches:
        for row in zip(*[batch.column(k).to_pylist() if k < batch.num_columns - 1 else (x.as_py() for x in batch.column(k)) for k in range(batch.num_columns)]):
            rows.append(row)
            size += len(row[-1] or "")
            if size >= chars:
                yield rows
                rows, size = [], 0
    if rows:
        yield rows
