"""LM scoring: a hashed maximum-entropy model with a class-factored softmax, trained by distributed gradients.

A word is reached by three choices among 16: ``P(word | history) = P(class) * P(class below) * P(leaf) * P(word | leaf)``, each of the first
three given the history and the classes chosen before. Each is a softmax over the summed weights of the history's
hashed features: the last word, the last two words, the word before the last (a skip), and a bias. Each of the ``SINGLES`` most
frequent words of the training documents has a leaf to itself, so the history decides it wholly; so has the end of a
text. Their 256 classes, and the 16 above these, are learned: words are split in halves along the principal direction of the words
that stand beside them. All other words share ``TAILS`` leaves by a hash of their last two bytes, two leaves a class;
there, ``P(word | leaf)`` has no history: it is the word's count over the leaf's, and one word never seen takes as many counts
as words were seen once (Good and Turing's estimate). So the distribution sums to one over the words seen and one unseen word a tail leaf.

Blocks of documents keep their distinct words and the words' places; the words of all blocks meet in one
shuffle by word, which sums their counts over all training documents and hands them back to the blocks. A word has one row a
block there, of all the block's distinct words: as a block holds hundreds of thousands, no word has more than a sliver of the rows.
The weights are trained in ``ROUNDS`` rounds: each partition runs minibatch steps (AdaGrad by row) from the
current weights over its own training documents' tokens, every ``ROUNDS``-th position, others in each round,
and the partitions' changes are averaged by row, weighted with how often they met the row (a tree of sums).
Every position of every training document is met in exactly one round; all take part in the counts. The rows of the
weights grow with the fourth root of the training tokens: a task holds them whole, and each sends them up the tree.

Defined results: null texts are empty and consist of the end alone; with no training document the counts are
zero and all leaves in use equally likely. Repeated rows and ids give a row each; null ids stay and belong to no held-out fold;
an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import functools
import math
import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

BRANCH, LEVELS = 16, 3
LEAVES = BRANCH**LEVELS
#: Classes of leaves, and how many leaves of each are for words without a leaf of their own.
GROUPS, SHARED = BRANCH ** (LEVELS - 1), 2
SINGLES, TAILS = GROUPS * (BRANCH - SHARED), GROUPS * SHARED
#: Bytes of a word that can have a leaf to itself, at most.
LONGEST = 64
#: Buckets of the words before, and of those after, by which classes are learned.
BESIDE = 64
NODES = 1 + BRANCH + GROUPS
ROUNDS = 2
BATCH = 1 << 16
#: Rows of 16 floats worked on at once: few enough to stay in a core's cache.
CHUNK = 1 << 14
#: A row's 64 bytes.
WHOLE = "V64"
#: Slopes of a row that are added in turn with those of all other rows; what a row has beyond is summed apart.
MOST = 32
RATE = 0.2
MOD, REST = 7, 2
BLOCK_CHARS = 24_000_000

BLOCKS = "block long, ids array<long>, held array<boolean>, lens array<int>, words array<binary>, uses array<int>, hashes binary, ends binary, tokens binary"


def end_of(word: bytes) -> int:
    """16 bits of a word's end; modulo TAILS, the leaf it shares if it has none to itself."""
    return zlib.crc32(word[-2:]) & 0xFFFF


@functools.cache
def _two_bytes() -> np.ndarray:
    """end_of any two bytes, the first of them times 256 and the second."""
    return np.array([end_of(bytes((k >> 8, k & 255))) for k in range(1 << 16)], np.uint16)


def _ends(words: pa.BinaryArray) -> np.ndarray:
    """end_of each word."""
    _, places, data = words.buffers()
    stops = np.frombuffer(places, np.int32)[words.offset : words.offset + len(words) + 1] + 2
    data = np.concatenate((np.zeros(2, np.uint8), np.frombuffer(data or b"", np.uint8))).astype(np.uint16)
    sizes, last = np.diff(stops), data[stops[1:] - 1]
    out = _two_bytes()[data[stops[1:] - 2] << 8 | last]
    out[sizes == 1] = np.array([end_of(bytes((k,))) for k in range(256)], np.uint16)[last[sizes == 1]]
    out[sizes == 0] = end_of(b"")
    return out


def _words(texts: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
    """The texts' lower-cased words at ASCII white space, one text after another, and how many each has."""
    split = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    flat, offsets = split.values, split.offsets.to_numpy()
    there = pc.binary_length(flat).to_numpy() > 0  # white space at a text's ends leaves empty words
    before = np.concatenate(([0], np.cumsum(there)))
    coded = flat.slice(offsets[0], offsets[-1] - offsets[0]).filter(pa.array(there[offsets[0] : offsets[-1]])).dictionary_encode()
    return coded, np.diff(before[offsets])


def _tokens(parts: list[tuple[pa.DictionaryArray, np.ndarray]]) -> tuple[pa.BinaryArray, np.ndarray, np.ndarray]:
    """(distinct words, tokens, tokens of each text) of several ``_words``; the end, word 0, stands after each text."""
    chunks = pa.chunked_array([p[0] for p in parts]).unify_dictionaries().chunks
    own = np.concatenate([p[1] for p in parts])
    tokens = np.zeros(int(own.sum()) + len(own), np.int32)
    words = np.ones(len(tokens), bool)
    words[np.cumsum(own + 1) - 1] = False
    tokens[words] = np.concatenate([c.indices.to_numpy() for c in chunks]) + 1
    return pa.concat_arrays([pa.array([b""], pa.binary()), chunks[0].dictionary.cast(pa.binary())]), tokens, own + 1


def _blocks(batches):
    """Arrow batches of (doc_id, held, text) to rows of BLOCKS; the empty word is the end."""
    task = TaskContext.get()
    base, made = (task.partitionId() if task else 0) << 24, 0

    def row(parts):
        ids, held = (pa.concat_arrays([p[k] for p in parts]) for k in range(2))
        words, tokens, lens = _tokens([p[2] for p in parts])
        learned = tokens[np.repeat(~held.to_numpy(zero_copy_only=False), lens)]
        uses = np.bincount(learned, minlength=len(words))
        arrays = [
            pa.array([base + made], pa.int64()),
            pa.array([ids.to_pylist()], pa.list_(pa.int64())),
            pa.array([held.to_pylist()], pa.list_(pa.bool_())),
            pa.array([lens], pa.list_(pa.int32())),
            pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words),
            pa.array([uses.astype(np.int32)], pa.list_(pa.int32())),
            pa.array([np.fromiter(map(zlib.crc32, words.to_numpy(zero_copy_only=False)), np.uint32, len(words)).tobytes()], pa.binary()),
            pa.array([_ends(words).tobytes()], pa.binary()),
            pa.array([tokens.tobytes()], pa.binary()),
        ]
        return pa.RecordBatch.from_arrays(arrays, names=["block", "ids", "held", "lens", "words", "uses", "hashes", "ends", "tokens"])

    parts, size = [], 0
    for batch in batches:
        texts = pc.fill_null(batch.column(2), "")
        sizes = np.cumsum(pc.binary_length(texts).to_numpy() + 1)
        start = 0
        while start < len(sizes):  # a block ends with the text that fills it
            done = sizes[start - 1] if start else 0
            end = int(np.searchsorted(sizes, done + BLOCK_CHARS - size)) + 1
            end = min(end, len(sizes))
            parts.append((batch.column(0).slice(start, end - start), batch.column(1).slice(start, end - start), _words(texts.slice(start, end - start))))
            size += int(sizes[end - 1] - done)
            start = end
            if size >= BLOCK_CHARS:
                yield row(parts)
                made += 1
                parts, size = [], 0
                common.give_back()
    if parts:
        yield row(parts)
        parts = []
    common.give_back()


def _keys(hashes: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return hashes.astype(np.int64) << 16 | ends


@dataclass
class Singles:
    """The words with a leaf to themselves: sorted keys, their words' numbers and their leaves."""

    keys: np.ndarray
    numbers: np.ndarray
    leaves: np.ndarray

    def find(self, hashes: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each word, whether it is one, and its place among them."""
        keys = _keys(hashes, ends)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return self.keys[at] == keys, at


def tail_leaf(tail):
    return tail // SHARED * BRANCH + BRANCH - SHARED + tail % SHARED


def arrange(beside: np.ndarray) -> np.ndarray:
    """A leaf for each word, by the counts of the words beside it: halves along the principal direction, again and again."""
    total = np.maximum(beside.sum(1, keepdims=True), 1)
    x = np.sqrt(beside / total)
    groups = [np.arange(len(x))]
    while len(groups) < GROUPS:
        halves = []
        for own in groups:
            if len(own) > 1:
                centred = x[own] - x[own].mean(0)
                main = np.linalg.eigh(centred.T @ centred)[1][:, -1]
                own = own[np.argsort(np.round(centred @ main, 9), kind="stable")]
            halves += [own[: (len(own) + 1) // 2], own[(len(own) + 1) // 2 :]]
        groups = halves
    leaves = np.zeros(len(x), np.int64)
    for k, own in enumerate(groups):
        leaves[own] = k * BRANCH + np.arange(len(own))
    return leaves


class _Text:
    """A block's tokens with their leaves and features' rows."""

    def __init__(self, block, singles: Singles):
        self.tokens = np.frombuffer(block["tokens"], np.int32)
        self.lens = np.asarray(block["lens"], np.int64)
        self.hash = np.frombuffer(block["hashes"], np.uint32)
        ends = np.frombuffer(block["ends"], np.uint16)
        self.single, at = singles.find(self.hash, ends)
        self.number = np.where(self.single, singles.numbers[at], -1)
        self.leaf = np.where(self.single, singles.leaves[at], tail_leaf(ends.astype(np.int64) % TAILS)).astype(np.int16)
        stops = np.cumsum(self.lens)
        self.place = (np.arange(len(self.tokens)) - np.repeat(stops - self.lens, self.lens)).astype(np.int32)
        self.held = np.repeat(np.asarray(block["held"], bool), self.lens)

    def beside(self) -> np.ndarray:
        """How often each single's training tokens have a word of each bucket before, and after them."""
        own = self.number[self.tokens]
        at = np.flatnonzero((own >= 0) & ~self.held)
        after = np.minimum(at + 1, len(self.tokens) - 1)
        follows = np.where(self.place[after] > 0, self.hash[self.tokens[after]], np.uint32(0))
        size = SINGLES * 2 * BESIDE
        out = np.bincount(own[at] * (2 * BESIDE) + self.before(at, 1) % BESIDE, minlength=size)
        return (out + np.bincount(own[at] * (2 * BESIDE) + BESIDE + follows % BESIDE, minlength=size)).reshape(SINGLES, 2 * BESIDE)

    def before(self, at: np.ndarray, back: int) -> np.ndarray:
        return np.where(self.place[at] >= back, self.hash[self.tokens[np.maximum(at - back, 0)]], np.uint32(0))

    def features(self, at: np.ndarray) -> list[np.ndarray]:
        """Hashes of the histories of the positions ``at``: last word, last two, the one before the last."""
        one, two = self.before(at, 1) + np.uint32(1), self.before(at, 2)
        return [one * np.uint32(2654435761), (one ^ (two * np.uint32(3266489917))) * np.uint32(668265263) + np.uint32(77), two * np.uint32(374761393) + np.uint32(1234567)]


def _choices(leaves: np.ndarray):
    """(node, choice) of each level on the way to the leaves."""
    leaves = leaves.astype(np.int64)
    first = leaves // GROUPS
    second = leaves // BRANCH
    return [(np.zeros(len(leaves), np.int64), first), (1 + first, second - first * BRANCH), (1 + BRANCH + second, leaves - second * BRANCH)]


def _rows(features: list[np.ndarray], node: np.ndarray, bits: int) -> list[np.ndarray]:
    """Rows of the weights for a level's nodes, for each feature."""
    salt = (node.astype(np.uint32) + np.uint32(1)) * np.uint32(0x9E3779B1)
    out = []
    for f in features:
        h = (f ^ salt) * np.uint32(2246822519)
        h ^= h >> np.uint32(15)
        out.append((h * np.uint32(3266489917) >> np.uint32(32 - bits)).astype(np.int64))
    return out


def _space(rows: int) -> np.ndarray:
    """Room for rows of 16 floats, each in one line of the cache."""
    raw = np.empty(rows * BRANCH * 4 + 64, np.uint8)
    start = -raw.ctypes.data % 64
    return raw[start : start + rows * BRANCH * 4].view(np.float32).reshape(rows, BRANCH)


@dataclass
class Weights:
    rows: np.ndarray  # hashed features' weights, 16 a row; a power of two of them
    bias: np.ndarray  # 16 a node

    @property
    def bits(self) -> int:
        return len(self.rows).bit_length() - 1

    def copy(self) -> Weights:
        """A copy that is quick to gather from."""
        rows = _space(len(self.rows))
        rows[:] = self.rows
        return Weights(rows, self.bias.copy())

    def odds(self, rows: list[np.ndarray], node: np.ndarray, z: np.ndarray, part: np.ndarray) -> np.ndarray:
        """What the probabilities of the choices are proportional to, in z; part is room as large."""
        np.take(self.bias, node, axis=0, out=z, mode="clip")
        for r in rows:
            z += np.take(self.rows, r, axis=0, out=part, mode="clip")  # with mode and out, no copy is buffered
        return np.exp(np.clip(z, -80, 60, out=z), out=z)  # a choice that doesn't exist has a bias of -1000

    def probabilities(self, rows: list[np.ndarray], node: np.ndarray, out: np.ndarray | None = None) -> np.ndarray:
        out = _space(len(node)) if out is None else out
        part = _space(min(len(node), CHUNK))
        for k in range(0, len(node), CHUNK):
            z = out[k : k + CHUNK]
            self.odds([r[k : k + CHUNK] for r in rows], node[k : k + CHUNK], z, part[: len(z)])
            z /= (z @ np.ones(BRANCH, np.float32))[:, None]
        return out


def size_for(tokens: int) -> int:
    """Rows for so many training tokens: about 512 times the fourth root."""
    return 1 << max(12, math.ceil(math.log2(512 * (tokens + 1) ** 0.25)))


def start(leaf_counts: np.ndarray, used: np.ndarray) -> Weights:
    """The weights before the first round: biases alone, which give each leaf its share of the training tokens."""
    mass = np.where(used, leaf_counts + 1.0, 0.0)
    levels = [mass.reshape(BRANCH, -1).sum(1)[None], mass.reshape(GROUPS, BRANCH).sum(1).reshape(BRANCH, BRANCH), mass.reshape(GROUPS, BRANCH)]
    bias = [np.where(m > 0, np.log(np.maximum(m, 1e-9) / np.maximum(m.sum(1, keepdims=True), 1e-9)), -1000.0) for m in levels]
    return Weights(np.zeros((size_for(int(leaf_counts.sum())), BRANCH), np.float32), np.concatenate(bias).astype(np.float32))


def _met(held: np.ndarray, turn: int, rounds: int) -> np.ndarray:
    """The training positions of a block that a round meets; the rounds meet each once."""
    at = np.flatnonzero(~held)
    return at[at % rounds == turn]


def _steps(weights: Weights, blocks, singles: Singles, turn: int, rounds: int):
    """One partition's minibatch steps: changes, and times met, of the rows and the biases."""
    own = weights.copy()
    seen, speed = np.zeros(len(own.rows), np.float32), np.full(len(own.rows), 0.1, np.float32)
    met, pace = np.zeros(NODES, np.float32), np.full(NODES, 0.1, np.float32)
    room, ones = _space(LEVELS * BATCH), np.ones(BATCH, np.float32)
    for block in blocks:
        text = _Text(block, singles)
        at = _met(text.held, turn, rounds)
        size = min(BATCH, max(512, len(at) // 32))
        for k in range(0, len(at), size):
            part = at[k : k + size]
            leaves = text.leaf[text.tokens[part]]
            order = np.argsort(leaves.astype(np.uint16), kind="stable")  # a node's positions stand together
            part, leaves, taken = part[order], leaves[order], np.arange(len(part))
            features, slopes, rows = text.features(part), room[: LEVELS * len(part)], []
            nodes = _choices(leaves)
            for level, (node, choice) in enumerate(nodes):
                rows.append(_rows(features, node, own.bits))
                p = own.probabilities(rows[-1], node, slopes[level * len(part) : (level + 1) * len(part)])
                p[taken, choice] -= 1
            for level, (node, _) in enumerate(nodes):
                starts = np.flatnonzero(np.concatenate(([True], node[1:] != node[:-1])))
                times, p = np.diff(np.append(starts, len(node))), slopes[level * len(part) : (level + 1) * len(part)]
                sums = np.array([ones[:n] @ p[a : a + n] for a, n in zip(starts.tolist(), times.tolist())])
                _move(own.bias, pace, met, node[starts], times, sums)
            for distinct, times, sums in _sums(rows, slopes, len(own.rows)):
                _move(own.rows, speed, seen, distinct, times, sums)
    return (own.rows - weights.rows).astype(np.float16), seen, (own.bias - weights.bias).astype(np.float16), met


def _sums(rows: list[list[np.ndarray]], slopes: np.ndarray, size: int):
    """(distinct rows, times met, summed slopes), a chunk of the rows met at once. ``rows``: of each level, each feature's; the features
    of a level share its slopes. Rows met most often come first, so that the n-th slopes of all rows met so often are added at once."""
    n, shift = len(slopes) // len(rows), len(slopes).bit_length()
    times = np.bincount(np.concatenate([r for level in rows for r in level]), minlength=size)
    source = np.concatenate([(r << shift) + np.arange(k * n, (k + 1) * n) for k, level in enumerate(rows) for r in level])
    source.sort()
    source &= (1 << shift) - 1
    starts = np.cumsum(times) - times
    capped = np.minimum(times, MOST + 1)
    order = np.argsort((MOST + 1 - capped).astype(np.uint8), kind="stable")[: np.count_nonzero(times)]
    sums, part = (_space(min(len(order), CHUNK)) for _ in range(2))
    for k in range(0, len(order), CHUNK):
        own = order[k : k + CHUNK]
        at, met = starts[own], times[own]
        out = np.take(slopes, source[at], axis=0, out=sums[: len(own)], mode="clip")
        more = len(own) - np.cumsum(np.bincount(capped[own], minlength=MOST + 2))  # how many are met more than n times
        for turn in range(1, MOST):
            m = more[turn]
            if not m:
                break
            out[:m] += np.take(slopes, source[at[:m] + turn], axis=0, out=part[:m], mode="clip")
        if m := more[MOST]:
            rest = met[:m] - MOST
            first = np.cumsum(rest) - rest
            places = np.repeat(at[:m] + MOST - first, rest) + np.arange(rest.sum())
            out[:m] += np.add.reduceat(slopes[source[places]], first, axis=0)
        yield own, met, out


def _move(weights, speed, seen, rows, times, grad):
    """A step of the distinct rows, met so many times, by their summed slopes."""
    times = times.astype(np.float32)
    grad /= np.sqrt(times)[:, None]
    speed[rows] += np.einsum("ij,ij->i", grad, grad) / 4
    grad *= (RATE / np.sqrt(speed[rows]))[:, None]
    moved = np.take(weights, rows, axis=0, mode="clip") - grad
    weights.reshape(-1).view(WHOLE)[rows] = moved.reshape(-1).view(WHOLE)  # a row at once is quicker than its floats
    seen[rows] += times


def _mean(a, b):
    """Two partitions' changes averaged by row, weighted with the times met."""
    out = []
    for moved, seen, other, times in zip(a[::2], a[1::2], b[::2], b[1::2]):
        every = seen + times
        out += [((moved * seen[:, None] + other * times[:, None]) / np.maximum(every, 1)[:, None]).astype(np.float16), every]
    return tuple(out)


def moved(weights: Weights, changes) -> Weights:
    return Weights(weights.rows + changes[0], weights.bias + changes[2])


def _over(blocks: DataFrame, work, join):
    """What work(rows) gives for each partition, joined by a tree."""
    return blocks.rdd.mapPartitions(lambda rows: [work(rows)]).treeReduce(join, depth=3)


def learn_singles(blocks: DataFrame, words: list[bytes]) -> Singles:
    """Leaves of the words that have one to themselves, by the words beside them."""
    keys = np.array([zlib.crc32(w) << 16 | end_of(w) for w in words], np.int64)
    order = np.argsort(keys)
    singles = Singles(keys[order], order, np.zeros(len(words), np.int64))
    context = blocks.sparkSession.sparkContext
    sent = context.broadcast(singles)

    def work(rows):
        total = np.zeros((SINGLES, 2 * BESIDE), np.int64)
        for block in rows:
            total += _Text(block, sent.value).beside()
        return total

    leaves = arrange(_over(blocks.select("held", "lens", "hashes", "ends", "tokens"), work, np.add)[: len(words)])
    return Singles(singles.keys, singles.numbers, leaves[order])


def train(blocks: DataFrame, singles: Singles, leaf_counts: np.ndarray, rounds: int = ROUNDS) -> Weights:
    """The weights, from the leaves' shares as biases on; each task holds them whole."""
    context = blocks.sparkSession.sparkContext
    used = np.zeros(LEAVES, bool)
    used[singles.leaves] = used[tail_leaf(np.arange(TAILS))] = True
    weights = start(leaf_counts, used)
    own = blocks.select("held", "lens", "hashes", "ends", "tokens")
    for turn in range(rounds):
        sent = context.broadcast((weights, singles))

        def work(rows, sent=sent, turn=turn):
            return _steps(sent.value[0], rows, sent.value[1], turn, rounds)

        weights = moved(weights, _over(own, work, _mean))
        sent.unpersist()
    return weights


@dataclass
class Tails:
    """Of each leaf: its words' counts in all, how many of them were seen once (1 at least), and how many there are."""

    counts: np.ndarray
    once: np.ndarray
    words: np.ndarray


def word_scores(text: _Text, c: np.ndarray, tails: Tails) -> np.ndarray:
    """log10 P(word | leaf) of a block's distinct words, seen c times in training."""
    leaf = text.leaf.astype(np.int64)
    return np.where(text.single, 0.0, np.log10(np.where(c > 0, c, tails.once[leaf])) - np.log10(tails.counts[leaf] + tails.once[leaf]))


def leaf_scores(weights: Weights, text: _Text, at: np.ndarray) -> np.ndarray:
    """log10 P(leaf | history) at the positions."""
    out = np.zeros(len(at))
    room, more = (_space(min(len(at), CHUNK)) for _ in range(2))
    for k in range(0, len(at), CHUNK):
        part = at[k : k + CHUNK]
        features, z, other = text.features(part), room[: len(part)], more[: len(part)]
        for node, choice in _choices(text.leaf[text.tokens[part]]):
            weights.odds(_rows(features, node, weights.bits), node, z, other)
            out[k : k + CHUNK] += np.log10(np.maximum(z[np.arange(len(part)), choice] / (z @ np.ones(BRANCH, np.float32)), 1e-30))
    return out


def _scorer(sent, total: int, distinct: int):
    """Scores of one block's documents."""
    floor = math.log10(total + distinct + 1)

    def run(key, blocks: pd.DataFrame, counts: pd.DataFrame) -> pd.DataFrame:
        (weights, singles, tails), out = sent.value, []
        for _, block in blocks.iterrows():
            text = _Text(block, singles)
            c = np.zeros(len(text.hash), np.int64)
            c[counts["pos"].to_numpy()] = counts["c"].to_numpy()
            single, within = np.log10(c + 1.0), word_scores(text, c, tails)
            tokens, n = text.tokens, len(text.tokens)
            base, score = single[tokens] - floor, within[tokens]
            for k in range(0, n, BATCH):
                at = np.arange(k, min(n, k + BATCH))
                score[at] += leaf_scores(weights, text, at)
            starts = np.cumsum(text.lens) - text.lens
            known = (c > 0)[tokens].astype(np.int64)
            out.append(
                pd.DataFrame(
                    {
                        "doc_id": pd.Series(list(block["ids"])).astype("Int64"),
                        "held_out": list(block["held"]),
                        "n_tokens": text.lens,
                        "n_known": np.add.reduceat(known, starts),
                        "train_tokens": total,
                        "base_score": np.add.reduceat(base, starts),
                        "score": np.add.reduceat(score, starts),
                    }
                )
            )
        common.give_back()
        return pd.concat(out) if out else pd.DataFrame({n: [] for n in ("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")})

    return run


SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


@dataclass
class Fitted:
    """A model with the blocks it was fitted on, and their words' counts."""

    blocks: DataFrame
    counts: DataFrame
    weights: Weights
    singles: Singles
    tails: Tails


def fit(docs: DataFrame) -> Fitted | None:
    """None where there are no documents."""
    spark = docs.sparkSession
    common.tune(spark)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.in_fold("doc_id", MOD, REST).alias("held"), F.col("text").cast("string").alias("text"))
    blocks = common.materialise(own.mapInArrow(_blocks, BLOCKS), "lm-blocks")
    if blocks.limit(1).count() == 0:
        return None
    spread = blocks.select("block", F.posexplode(F.arrays_zip("words", "uses")).alias("pos", "w")).select("block", "pos", F.col("w.words").alias("word"), F.col("w.uses").alias("uses"))
    by = Window.partitionBy("word")
    first = F.row_number().over(by.orderBy("block")) == 1
    counts = spread.select("block", "pos", F.sum("uses").over(by).alias("c"), first.alias("first"), "word")
    counts = common.materialise(counts.select("block", "pos", "c", F.when(F.col("first") & (F.col("c") > 0), F.col("word")).alias("word")), "lm-counts")
    known = counts.where("word is not null").select("word", "c")
    often = known.where((F.length("word") > 0) & (F.length("word") <= LONGEST)).orderBy(F.desc("c"), "word").limit(SINGLES - 1)
    words = [b""] + [bytes(r["word"]) for r in often.select("word").collect()]
    singles = learn_singles(blocks, words)
    # SINGLES rows at most
    named = F.broadcast(spark.createDataFrame([(bytearray(w), k) for k, w in enumerate(words)], "word binary, single int"))
    place = F.coalesce("single", -1 - F.pmod(F.crc32(F.substring("word", -2, 2)), F.lit(TAILS))).cast("int")
    met = known.join(named, "word", "left").groupBy(place.alias("place")).agg(F.sum("c").alias("n"), F.sum((F.col("c") == 1).cast("long")).alias("once"), F.count(F.lit(1)).alias("words"))
    tails = Tails(np.zeros(LEAVES), np.ones(LEAVES), np.zeros(LEAVES, np.int64))
    leaves = np.zeros(len(words), np.int64)
    leaves[singles.numbers] = singles.leaves
    for r in met.collect():  # a row a leaf at most
        at = leaves[r["place"]] if r["place"] >= 0 else tail_leaf(-1 - r["place"])
        tails.counts[at], tails.once[at], tails.words[at] = r["n"], max(r["once"], 1), r["words"]
    weights = train(blocks, singles, tails.counts)
    return Fitted(blocks, counts, weights, singles, tails)


def lm_scores(docs: DataFrame, model: Fitted | None = None) -> DataFrame:
    """Every document's log10 probability under the unigram base and under the model."""
    spark = docs.sparkSession
    model = model or fit(docs)
    if model is None:
        return spark.createDataFrame([], SCORES)
    sent = spark.sparkContext.broadcast((model.weights, model.singles, model.tails))
    run = _scorer(sent, int(model.tails.counts.sum()), int(model.tails.words.sum()))
    blocks = model.blocks.select("block", "ids", "held", "lens", "hashes", "ends", "tokens")  # words aren't needed again
    return blocks.groupBy("block").cogroup(model.counts.where("c > 0").select("block", "pos", "c").groupBy("block")).applyInPandas(run, SCORES)


def op3_lm_scoring(spark, sf_dir):
    return lm_scores(common.table(spark, sf_dir, "documents"))
