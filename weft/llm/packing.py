"""Best-fit packing: exact-complement hashing on the histogram of piece lengths.

Documents are tokenized and only longer ones are cut, into pieces of the capacity. Packing works on the
number of pieces of each length, a table of ``capacity`` rows at most whatever the input's size: for each
partly filled sequence, the index of available lengths is asked for a single length, a pair or a triple
whose sum is exactly the gap; such combinations are consumed as often as the available counts allow. What
then remains is placed best-fit decreasing. The plan says for ranges of ranks within a length which sequence
and offset they get; pieces get their rank within their length from counts of (length, bucket) and a window
inside each bucket, so that a length that a third of all pieces has is still dealt over many tasks.

Defined results: null text is empty (the end id alone); repeated rows and ids are packed each for itself;
null ids stay null; an empty table gives no rows; extra columns are ignored; ties are broken by length,
bucket and the rows' order in it.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common, spans, vector_bpe

CAPACITY = 4096
END_ID = 1
#: A length's pieces are dealt to buckets before they are ranked: so many at least, and of so many pieces on the average at most.
BUCKETS, BUCKET_PIECES = 64, 100_000
#: Ranges of a plan that are broadcast at most.
RANGES = 1 << 18
#: Distinct pre-tokens whose ids a Python worker remembers.
REMEMBERED = 800_000
#: Characters of text that are encoded together.
PORTION = 3_000_000

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
#: Texts of other characters, or with a special token's string, are left to the library.
_OTHERS = re.compile(r"[^\x00-\xff]|<\|")


@lru_cache(2)
def _encoder(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return _Words(Tokenizer.from_file(path), path)


class _Words:
    """Ids of texts. Latin-1 texts are cut into pre-tokens in numpy and the distinct ones merged many at once;
    the library encodes all others."""

    def __init__(self, tok, path: str):
        self.tok, self.memo = tok, spans.Memo(REMEMBERED)
        vocab, merges, suffix = _merges(path)
        self.plain = suffix is not None
        if not self.plain:
            return
        pairs = [(vocab[a], vocab[b]) for a, b in merges]
        self.pairs = vector_bpe.Pairs(pairs, list(range(len(pairs))), {r: vocab[a + b] for r, (a, b) in enumerate(merges)})
        names = _byte_names()
        self.inner = np.array([vocab[names[b]] for b in range(256)], np.int32)
        self.last = np.array([vocab[names[b] + suffix] for b in range(256)], np.int32)

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """The ids of each text."""
        out: list = [np.zeros(0, np.int32)] * len(texts)
        own = []
        for i, t in enumerate(texts):
            if t and (not self.plain or _OTHERS.search(t)):
                out[i] = np.array(self.tok.encode(t, add_special_tokens=False).ids, np.int32)
            elif t:
                own.append(i)
        if own:
            # a space between texts keeps their pre-tokens apart
            data = [texts[i].lower().encode("latin-1") for i in own]
            ends = np.cumsum(np.fromiter(map(len, data), np.int64, len(data)) + 1)
            ids, before = self._latin(np.frombuffer(b" ".join(data) + b" ", np.uint8), ends)
            for i, a, b in zip(own, [0, *before[:-1].tolist()], before.tolist()):
                out[i] = ids[a:b]
        return out

    def _latin(self, codes: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of Latin-1 codes, the number of ids before each of the places ``ends``)."""
        kind = _KIND[codes]
        past = np.concatenate(([_SPACE], kind[:-1]))
        begins = (kind != _SPACE) & ((kind != past) | (kind == _DIGIT))
        quotes = np.flatnonzero((codes == 39) & begins)
        if len(quotes):  # 's 't 're 've 'm 'll 'd where a quote begins a pre-token
            pad = np.concatenate((codes, np.zeros(2, np.uint8)))
            one, two = pad[quotes + 1], pad[quotes + 2]
            short = np.isin(one, np.frombuffer(b"stmd", np.uint8))
            long = ((two == 101) & ((one == 114) | (one == 118))) | ((one == 108) & (two == 108))
            for some, size in ((quotes[short], 2), (quotes[long], 3)):
                begins[some + 1] = False
                after = some + size
                after = after[(after < len(codes))]
                begins[after[kind[after] == _LETTER]] = True
        stops = np.concatenate((begins[1:] | (kind[1:] == _SPACE), [True])) & (kind != _SPACE)
        starts, stops = np.flatnonzero(begins), np.flatnonzero(stops) + 1

        def find(_, a, b):
            """Merges of distinct pre-tokens, over their UTF-8 bytes."""
            at = spans.gather(a, b - a)
            taken, sizes = codes[at], b - a
            wide = taken >= 128
            if wide.any():
                grown = np.zeros(len(taken) + int(wide.sum()), np.uint8)
                place = np.arange(len(taken)) + np.cumsum(wide) - wide
                grown[place] = np.where(wide, 0xC0 | (taken >> 6), taken)
                grown[place[wide] + 1] = 0x80 | (taken[wide] & 0x3F)
                sizes = sizes + np.add.reduceat(wide.astype(np.int64), np.cumsum(b - a) - (b - a))
                taken = grown
            symbols, final = self.inner[taken], np.cumsum(sizes) - 1
            symbols[final] = self.last[taken[final]]
            return vector_bpe.merge_all(self.pairs, symbols, sizes)

        ids, n = spans.merged(self.memo, codes, starts, stops, find)
        total = np.concatenate(([0], np.cumsum(n)))
        return ids, total[np.searchsorted(starts, ends)]


_LETTER, _DIGIT, _SPACE, _OTHER = 0, 1, 2, 3
#: Kinds of the Latin-1 characters, as the tokenizer's pattern has them.
_KIND = np.array([_SPACE if c in (*range(9, 14), 32, 0x85, 0xA0) else _LETTER if unicodedata.category(chr(c))[0] == "L" else _DIGIT if unicodedata.category(chr(c))[0] == "N" else _OTHER for c in range(256)], np.uint8)


def _byte_names() -> list[str]:
    """The character that a byte-level vocabulary writes for each byte: itself if it prints, else from U+0100 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    hidden = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]


def _merges(path: str):
    """(vocabulary, merges, end-of-word suffix), the suffix None unless this is the model that the fast way is for."""
    held = json.loads(open(path, encoding="utf-8").read())
    model = held["model"]
    kinds = [n["type"] for n in (held.get("normalizer") or {}).get("normalizers", [])]
    known = model["type"] == "BPE" and model.get("end_of_word_suffix") and kinds == ["NFC", "Replace", "Lowercase"] and not model.get("ignore_merges")
    return model["vocab"], [tuple(m) for m in model["merges"]], model["end_of_word_suffix"] if known else None


def _le(ids) -> bytes:
    return np.asarray(ids, "<u4").tobytes()


def token_bytes(texts: list[str | None], path: str) -> list[bytes]:
    """The little-endian 32-bit ids of each text."""
    return [_le(ids) for ids in _encoder(path).encode(texts)]


def cut(data: bytes, capacity: int, end_id: int) -> list[tuple[int, int, int, int]]:
    """(piece, start, length, crc32) of the pieces of a document's ids and its end id."""
    data += _le([end_id])
    step = 4 * capacity
    return [(k, at // 4, len(data[at : at + step]) // 4, zlib.crc32(data[at : at + step])) for k, at in enumerate(range(0, len(data), step))]


def _cut_up(path: str, capacity: int, end_id: int):
    def run(batches):
        for rows in spans.portions(batches, PORTION):
            out: list[list] = [[], [], [], [], []]
            for (doc_id, _), data in zip(rows, token_bytes([t for _, t in rows], path)):
                for p in cut(data, capacity, end_id):
                    for column, value in zip(out, (doc_id, *p)):
                        column.append(value)
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names=["doc_id", "piece", "start", "length", "ids_crc32"])
            out = rows = None
            spans.forget()
            common.give_back()

    return run


def pieces_of(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """A row per piece: doc_id, piece, start, length, ids_crc32."""
    common.tune(docs.sparkSession)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return own.mapInArrow(_cut_up(tokenizer, capacity, end_id), PIECES)


class _Lengths:
    """Available pieces by length, with an index of the sums of one, two and three of them."""

    def __init__(self, counts: dict[int, int], capacity: int):
        self.left = {n: c for n, c in counts.items() if c > 0}
        self.capacity = capacity
        self.bits = sum(1 << n for n in self.left)  # bit n: a piece of length n is available
        self.mirror = sum(1 << (capacity - n) for n in self.left)
        self.rank = dict.fromkeys(counts, 0)

    def take(self, length: int, n: int) -> int:
        """Consumes n pieces of a length; their first rank."""
        first = self.rank[length]
        self.rank[length] += n
        self.left[length] -= n
        if not self.left[length]:
            del self.left[length]
            self.bits ^= 1 << length
            self.mirror ^= 1 << (self.capacity - length)
        return first

    def single(self, gap: int):
        return (gap,) if gap > 0 and self.bits >> gap & 1 else None

    def pair(self, gap: int):
        """Two available lengths that sum to the gap: bits of a length and of its complement to the gap meet."""
        if gap < 2:
            return None
        both = self.bits & (self.mirror >> (self.capacity - gap))
        both &= (1 << gap) - 1
        if gap % 2 == 0 and self.left.get(gap // 2, 0) == 1:
            both &= ~(1 << (gap // 2))
        if not both:
            return None
        a = both.bit_length() - 1
        return a, gap - a

    def triple(self, gap: int):
        for a in sorted((n for n in self.left if n < gap - 1), reverse=True):
            if 3 * a < gap:
                return None  # a is the largest of the three
            p = self.pair(gap - a)
            if p and all((a, *p).count(n) <= self.left[n] for n in p):
                return (a, *p)
        return None

    def fill(self, gap: int):
        return self.single(gap) or self.pair(gap) or self.triple(gap)


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, pieces, first sequence, copies in a sequence, offset) for every range of ranks."""
    free, rows, sequences = _Lengths(counts, capacity), [], 0

    def put(length, n, copies, sequence, offset):
        rows.append((length, free.take(length, n * copies), n * copies, sequence, copies, offset))

    # exact fills: sequences that begin with copies of one length, the gap filled by one to three pieces
    for anchor in sorted(free.left, reverse=True):
        copies, tried = 1, capacity // anchor
        while anchor in free.left and copies <= min(tried, free.left[anchor]):
            gap = capacity - copies * anchor
            rest = () if gap == 0 else free.fill(gap)
            if rest is None:
                copies += 1
                continue
            need = {n: (anchor,) * copies + rest for n in {anchor, *rest}}
            times = min(free.left[n] // used.count(n) for n, used in need.items())
            if not times:
                copies += 1
                continue
            put(anchor, times, copies, sequences, 0)
            at = copies * anchor
            for n in rest:
                put(n, times, 1, sequences, at)
                at += n
            sequences += times
    # best-fit decreasing: open sequences by gap, as groups of (first sequence, number)
    open_: dict[int, list[tuple[int, int]]] = {}
    for length in sorted(free.left, reverse=True):
        while length in free.left:
            gaps = [g for g in open_ if g >= length]
            n = free.left[length]
            if gaps:
                gap = min(gaps)
                first, many = open_[gap].pop()
                if not open_[gap]:
                    del open_[gap]
                copies = min(gap // length, n)
                many_now = min(many, n // copies)
            else:
                gap, copies = capacity, min(capacity // length, n)
                many = many_now = n // copies
                first = sequences
                sequences += many
            put(length, many_now, copies, first, capacity - gap)
            if gap > copies * length:
                open_.setdefault(gap - copies * length, []).append((first, many_now))
            if many > many_now:
                open_.setdefault(gap, []).append((first + many_now, many - many_now))
    return rows


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Every piece with its sequence and its place there."""
    spark: SparkSession = docs.sparkSession
    # the row's number takes part, so that copies of one row don't crowd a bucket
    dealt = F.xxhash64("doc_id", "piece", "ids_crc32", F.monotonically_increasing_id())
    pieces = common.materialise(pieces_of(docs, tokenizer, capacity, end_id).withColumn("h", dealt), "pieces")
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most capacity rows
    buckets = max(BUCKETS, -(-max(counts.values(), default=0) // BUCKET_PIECES))
    pieces = pieces.withColumn("bucket", F.pmod("h", F.lit(buckets)).cast("int"))
    sizes = pieces.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("length").orderBy("bucket")  # a row a bucket
    before = sizes.select("length", "bucket", (F.sum("n").over(w) - F.col("n")).alias("before"))
    planned = plan(counts, capacity)
    ranges = spark.createDataFrame(planned, "length long, first long, n long, sequence long, copies long, base long")
    w = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32")
    ranked = pieces.withColumn("r", F.row_number().over(w) - 1).join(before, ["length", "bucket"]).withColumn("r", F.col("r") + F.col("before"))
    # the plan's ranges number a few to a length, whatever the input's size
    p, q = ranked.alias("p"), (F.broadcast(ranges) if len(planned) <= RANGES else ranges).alias("q")
    i = F.col("p.r") - F.col("q.first")
    return p.join(q, (F.col("p.length") == F.col("q.length")) & (i >= 0) & (i < F.col("q.n"))).select(
        "p.doc_id", "p.piece", "p.start", "p.length", "p.ids_crc32",
        (F.col("q.sequence") + F.floor(i / F.col("q.copies"))).cast("long").alias("sequence_id"),
        (F.col("q.base") + F.pmod(i, F.col("q.copies")) * F.col("p.length")).cast("long").alias("offset"),
    )


def op5_best_fit_packing(spark, sf_dir):
    import public_tokenizers

    return pack(common.table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
