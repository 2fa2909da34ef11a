"""Byte-pair merges of many words at once, in numpy.

Words of a batch that have the same number of symbols are the rows of an array; each round finds every row's
best-ranked pair of neighbours by a hash table of pairs and merges it, so a word takes as many rounds as it has
merges and Python runs once a round, not once a merge. With dropout, a round skips a row's best pair instead
where a keyed hash of the word, place and merged piece says so, or the rounds that are listed for the row; the pair
comes back only if a neighbour changes.
"""

from __future__ import annotations

import numpy as np

NONE = np.int32(2**31 - 1)
_M = np.uint64
#: Rows merged together.
CHUNK = 1 << 15


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _M(30))) * _M(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _M(27))) * _M(0x94D049BB133111EB)
    return x ^ (x >> _M(31))


class Pairs:
    """Ranks of pairs of symbols in an open-addressed table, and what each rank's pair becomes. Ranks from ``tied`` on are one and the
    same: of these, the leftmost pair comes first."""

    def __init__(self, pairs: list[tuple[int, int]], ranks: list[int], becomes: dict[int, int], tied: int = int(NONE)):
        self.tied = tied
        self.bits = max(4, int(len(pairs) * 8).bit_length())
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.ranks = np.full(1 << self.bits, NONE, np.int32)
        self.made = np.zeros(max(becomes, default=0) + 1, np.int32)
        for r, i in becomes.items():
            self.made[r] = i
        keys = np.array([a << 32 | b for a, b in pairs], np.int64)
        left, at = np.arange(len(keys)), self._at(keys)
        self.probes = 0
        while len(left):
            self.probes += 1
            free = self.keys[at[left]] == -1
            _, first = np.unique(at[left], return_index=True)
            mine = np.zeros(len(left), bool)
            mine[first] = True
            put = left[free & mine]
            self.keys[at[put]] = keys[put]
            self.ranks[at[put]] = np.array(ranks, np.int64)[put]
            left = left[~(free & mine)]
            at[left] = (at[left] + 1) & ((1 << self.bits) - 1)

    def _at(self, keys):
        return ((keys.astype(np.uint64) * _M(0x9E3779B97F4A7C15)) >> _M(64 - self.bits)).astype(np.int64)

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Ranks of the pairs; NONE for pairs that don't merge, and for symbols under 0."""
        keys = a.astype(np.int64) << 32 | b.astype(np.int64)
        at = self._at(keys)
        found = self.keys[at]
        out = np.where(found == keys, self.ranks[at], NONE)
        left = np.flatnonzero((found != keys) & (found != -1))
        k = 1
        while len(left) and k <= self.probes:
            at[left] = (at[left] + 1) & ((1 << self.bits) - 1)
            found = self.keys[at[left]]
            hit = found == keys[left]
            out[left[hit]] = self.ranks[at[left[hit]]]
            left = left[~hit & (found != -1)]
            k += 1
        return np.where((a < 0) | (b < 0), NONE, out)

    def merge(self, symbols: np.ndarray, own: np.ndarray | None = None, dropout: float = 0.0, skips: np.ndarray | None = None) -> np.ndarray:
        """Rows of symbols, merged; -1 fills rows up on the right; lower symbols merge with nothing. own: each row's 64-bit key, with dropout;
        skips: instead of both, the rounds that each row skips, as many for all."""
        n, width = symbols.shape
        out = np.full((n, width), -1, np.int32)
        rows, sym = np.arange(n), symbols.astype(np.int32)
        limit = _M(min(int(dropout * 2**64), 2**64 - 1))
        ranks = self.rank(sym[:, :-1].ravel(), sym[:, 1:].ravel()).reshape(n, width - 1) if width > 1 else np.zeros((n, 0), np.int32)
        place = np.broadcast_to(np.arange(width, dtype=np.int32), sym.shape).copy() if dropout else None
        listed, turn = skips is not None and skips.shape[1] > 0, -1
        while sym.shape[1] > 1 and len(rows):
            turn += 1
            at = ranks.argmin(1)
            each = np.arange(len(rows))
            best = ranks[each, at]
            over = best == NONE
            equal = np.flatnonzero((best >= self.tied) & ~over)
            if len(equal):
                at[equal] = (ranks[equal] != NONE).argmax(1)  # none is under those tied, so all that merge are
                best = ranks[each, at]
            if over.any():
                out[rows[over], : sym.shape[1]] = sym[over]
                go = ~over
                rows, sym, ranks, at, best = rows[go], sym[go], ranks[go], at[go], best[go]
                own = own[go] if dropout else own
                place = place[go] if dropout else place
                skips = skips[go] if listed else skips
                each = np.arange(len(rows))
                if not len(rows):
                    return out
            made = self.made[best]
            if dropout or listed:
                if listed:
                    skip = (skips == turn).any(1)
                else:
                    x = own + place[each, at].astype(np.uint64) * _M(0x9E3779B97F4A7C15) + made.astype(np.uint64) * _M(0xC2B2AE3D27D4EB4F)
                    skip = _mixed(x) < limit
                ranks[each[skip], at[skip]] = NONE
                m = ~skip
                each, at, made = each[m], at[m], made[m]
                if not len(each):
                    continue
            cols = np.arange(sym.shape[1])
            part = sym[each]
            part[np.arange(len(each)), at] = made
            src = np.minimum(cols + (cols > at[:, None]), len(cols) - 1)
            part = np.take_along_axis(part, src, 1)
            part[:, -1] = -1
            rcols = cols[:-1]
            rpart = np.take_along_axis(ranks[each], np.minimum(rcols + (rcols > at[:, None]), len(rcols) - 1), 1)
            rpart[:, -1] = NONE
            k = np.arange(len(each))
            inner = at < len(rcols)
            right = np.where(at + 1 < len(cols), part[k, np.minimum(at + 1, len(cols) - 1)], -1)
            rpart[k[inner], at[inner]] = self.rank(made[inner], right[inner])
            back = at > 0
            rpart[k[back], at[back] - 1] = self.rank(part[k[back], at[back] - 1], made[back])
            if dropout or listed:
                sym[each], ranks[each] = part, rpart
                if dropout:
                    place[each] = np.take_along_axis(place[each], src, 1)
            else:  # every row has merged once: one column less
                sym, ranks = part[:, :-1], rpart[:, :-1]
        if len(rows):
            out[rows, : sym.shape[1]] = sym
        return out


def merge_all(pairs: Pairs, symbols: np.ndarray, lens: np.ndarray, own: np.ndarray | None = None, dropout: float = 0.0, skips: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Words given one after another, with their numbers of symbols: (merged symbols one after another, numbers)."""
    starts = np.cumsum(lens) - lens
    n_out = np.zeros(len(lens), np.int64)
    kept: list[tuple[np.ndarray, np.ndarray]] = []
    for width in np.unique(lens):
        same = np.flatnonzero(lens == width)
        for k in range(0, len(same), CHUNK):
            rows = same[k : k + CHUNK]
            got = pairs.merge(symbols[starts[rows][:, None] + np.arange(width)], own[rows] if own is not None else None, dropout, skips[rows] if skips is not None else None)
            full = got != -1
            n_out[rows] = full.sum(1)
            kept.append((rows, got[full]))
    ends = np.cumsum(n_out)
    out = np.empty(int(ends[-1]) if len(ends) else 0, np.int32)
    for rows, flat in kept:
        n = n_out[rows]
        begin = np.repeat(ends[rows] - n - (np.cumsum(n) - n), n)
        out[begin + np.arange(len(flat))] = flat
    return out, n_out
