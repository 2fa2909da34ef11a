"""SentencePiece encoding (merge type) with seeded merge-dropout, and decoding.

Merges come from an agenda ordered by the pieces' scores, then from the left. A candidate taken from the agenda
is skipped with probability ``dropout`` by a hash keyed with the seed, the document's id, variant and text, the stretch's
place in the text and the merge's place in the stretch: the same document gets the same segmentation in any run and on any
executor, while a word's occurrences within and across documents are segmented independently, and other seeds
and variants give others. Without dropout the ids are the library's. Pieces that the vocabulary lacks fall back
to bytes, as does U+2581 in a text, which would else come back as a space; so decoding returns the text itself.

Between two characters that no piece holds side by side nothing can merge, so texts are cut there into stretches
that are segmented independently. What a stretch becomes depends on which of its candidates, counted as they are taken,
are skipped; workers remember it for the stretch and that list. Each occurrence draws its own list, skip by skip: how
many candidates are merged up to the next skip. So only lists that are new for a stretch are merged, many at once in numpy;
stretches over ``LONG`` have too many lists and are merged at each occurrence. ``Model.segment`` is the agenda of a single stretch.

Defined results: null texts are empty and have no pieces; repeated rows and ids give a row each; a null id has
variant 0 and is told apart by its text; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import heapq
import re
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, spans, vector_bpe

DROPOUT = 0.1
SEED = 17
#: Documents are dealt to so many variants, which the key holds besides the document.
VARIANTS = 1
#: Characters of a stretch over which its ids aren't remembered.
LONG = 24
#: Distinct stretches and lists of skips whose ids a Python worker remembers.
REMEMBERED = 600_000
#: Characters of text that are encoded together.
PORTION = 2_000_000
#: Two neighbouring characters under this code are cut apart if no piece holds them side by side.
TABLE = 0x250

SPACE = "▁"
_M64 = (1 << 64) - 1



def _mixed(x: int) -> int:
    """An evenly spread 64-bit hash of x."""
    x &= _M64
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & _M64
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & _M64
    return x ^ (x >> 31)


class Model:
    """The pieces of a merge-type model: ids and ranks by piece, and the bytes that each id stands for."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.ids: dict[str, int] = {}
        self.scores: list[float] = []
        self.bytes_of: list[bytes] = []
        self.byte_ids = [0] * 256
        for i in range(sp.get_piece_size()):
            piece = sp.id_to_piece(i)
            self.scores.append(sp.get_score(i))
            if sp.is_byte(i):
                self.byte_ids[int(piece[3:5], 16)] = i
                self.bytes_of.append(bytes([int(piece[3:5], 16)]))
            elif sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
                self.bytes_of.append(b"")
            else:
                self.ids[piece] = i
                self.bytes_of.append(piece.replace(SPACE, " ").encode())
        self.spelt = np.frombuffer(b"".join(self.bytes_of), np.uint8)
        self.spelt_size = np.fromiter(map(len, self.bytes_of), np.int64, len(self.bytes_of))
        self.spelt_from = np.cumsum(self.spelt_size) - self.spelt_size
        #: merged pieces by falling score
        self.by_rank = sorted(self.ids.values(), key=lambda i: (-self.scores[i], i))
        order = {i: r for r, i in enumerate(self.by_rank)}
        self.rank = {p: order[i] for p, i in self.ids.items()}
        #: the piece of each character, U+2581's for a space; -1 for what must be spelt in bytes
        self.char_ids = np.full(0x110000, -1, np.int32)
        for p, i in self.ids.items():
            if len(p) == 1:
                self.char_ids[ord(p)] = i
        self.char_ids[ord(" ")], self.char_ids[ord(SPACE)] = self.char_ids[ord(SPACE)], -1
        splits = [(self.ids[p[:k]], self.ids[p[k:]], order[i]) for p, i in self.ids.items() for k in range(1, len(p)) if p[:k] in self.ids and p[k:] in self.ids]
        # pieces of one and the same score, as runs of spaces may have, are merged from the left; only the last may be such
        scores = np.array([self.scores[i] for i in self.by_rank])
        tied = int(np.argmax(scores == scores[-1])) if len(scores) else 0
        if (np.diff(scores[: tied + 1]) == 0).any():
            raise ValueError("pieces of equal scores among those that aren't the last")
        self.pairs = vector_bpe.Pairs([(a, b) for a, b, _ in splits], [r for _, _, r in splits], dict(enumerate(self.by_rank)), tied)
        # stretches are cut where no piece goes across, so that each is merged as it would be within its text
        self.joined = np.zeros((TABLE, TABLE), bool)
        for p in self.ids:
            for x, y in zip(p.replace(SPACE, " "), p.replace(SPACE, " ")[1:]):
                if ord(x) < TABLE and ord(y) < TABLE:
                    self.joined[ord(x), ord(y)] = True

    def segment(self, stretch: str, dropout: float = 0.0, key: int = 0) -> list[int]:
        """Ids of a stretch of text (with spaces), by agenda. key: the stretch's, with dropout."""
        ids, scores = self.ids, self.scores
        # a symbol is its piece's text; a character that must fall back to bytes is kept apart by a NUL before it
        sym: list[str | None] = [SPACE if c == " " else "\0" + c if c == SPACE else c for c in stretch]
        n = len(sym)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        if dropout:
            own = key
        agenda = []
        for i in range(n - 1):
            piece = ids.get(sym[i] + sym[i + 1])
            if piece is not None:
                agenda.append((-scores[piece], i, piece, len(sym[i]) + len(sym[i + 1])))
        heapq.heapify(agenda)
        while agenda:
            _, i, piece, size = heapq.heappop(agenda)
            a = sym[i]
            if a is None:
                continue
            j = after[i]
            if j >= n or len(a) + len(sym[j]) != size or ids.get(a + sym[j]) != piece:
                continue  # one of the two has been merged meanwhile
            if dropout:
                if _mixed(own + i * 0x9E3779B97F4A7C15 + piece * 0xC2B2AE3D27D4EB4F) < int(dropout * 2**64):
                    continue
            sym[i], sym[j] = a + sym[j], None
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                p = ids.get(sym[i] + sym[k])
                if p is not None:
                    heapq.heappush(agenda, (-scores[p], i, p, len(sym[i]) + len(sym[k])))
            h = before[i]
            if h >= 0:
                p = ids.get(sym[h] + sym[i])
                if p is not None:
                    heapq.heappush(agenda, (-scores[p], h, p, len(sym[h]) + len(sym[i])))
        out, i = [], 0
        while i < n:
            s = sym[i]
            piece = ids.get(s)
            if piece is not None:
                out.append(piece)
            else:
                out += [self.byte_ids[b] for b in s.removeprefix("\0" if len(s) > 1 else "").encode("utf-8", "replace")]
            i = after[i]
        return out

    def stretches(self, codes: np.ndarray, after: np.ndarray) -> np.ndarray:
        """Where stretches begin in code points; ``after``: where texts begin."""
        low = codes < TABLE
        cut = np.ones(len(codes), bool)
        x, y = np.where(low, codes, 0)[:-1], np.where(low, codes, 0)[1:]
        cut[1:] = low[:-1] & low[1:] & ~self.joined[x, y]
        cut[after] = True
        return np.flatnonzero(cut)

    def encode(self, text: str | None, dropout: float = 0.0, seed: int = 0) -> list[int]:
        """Ids of one text, stretch by stretch."""
        if not text:
            return []
        text = " " + text
        codes = np.frombuffer(text.encode("utf-32-le", "replace"), "<u4").astype(np.int64)
        cuts = [*self.stretches(codes, np.zeros(1, np.int64)).tolist(), len(text)]
        return [i for a, b in zip(cuts, cuts[1:]) for i in self.segment(text[a:b], dropout, _mixed(seed + a * 0x9E3779B97F4A7C15))]

    def decoded_bytes(self, ids: bytes) -> bytes:
        """The text's bytes for ids (little-endian, 32 bits)."""
        at = np.frombuffer(ids, "<u4")
        data = self.spelt[spans.gather(self.spelt_from[at], self.spelt_size[at])].tobytes()
        return data[1:] if data[:1] == b" " else data

    def decode(self, ids) -> str:
        return self.decoded_bytes(np.asarray(ids, "<u4").tobytes()).decode("utf-8", "replace")

    def merge_all(self, codes: np.ndarray, lens: np.ndarray, own: np.ndarray | None, dropout: float, skips: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(ids, numbers) of stretches of code points, merged many at once; own: the stretches' keys; skips: instead, the
        candidates that each skips. With skips, each stretch's ids come after the number of candidates that it took."""
        symbols = self.char_ids[codes]
        odd = symbols < 0
        symbols[odd] = -2 - codes[odd].astype(np.int32)  # merges with nothing
        flat, n = vector_bpe.merge_all(self.pairs, symbols, lens, own, dropout, skips)
        taken = lens - n + skips.shape[1] if skips is not None else None  # what has merged and what was skipped
        odd = np.flatnonzero(flat < 0)
        if len(odd):  # characters without a piece, spelt in bytes
            spelt = [[self.byte_ids[b] for b in chr(-2 - c).encode("utf-8", "replace")] for c in flat[odd].tolist()]
            sizes = np.ones(len(flat), np.int64)
            sizes[odd] = [len(x) for x in spelt]
            grown = np.repeat(flat, sizes)
            ends = np.cumsum(sizes)
            for k, x in zip(odd, spelt):
                grown[ends[k] - len(x) : ends[k]] = x
            total = np.concatenate(([0], ends))
            stops = np.cumsum(n)
            flat, n = grown, total[stops] - total[stops - n]
        if taken is not None:
            flat, n = np.insert(flat, np.cumsum(n) - n, taken), n + 1
        return flat, n


@lru_cache(2)
def load(path: str) -> Model:
    return Model(path)


@lru_cache(2)
def _memo(path: str) -> spans.Memo:
    return spans.Memo(REMEMBERED)


@lru_cache(4)
def _limits(dropout: float) -> np.ndarray:
    """Ascending: a hash is under the k-th from the end with the probability that k candidates in a row are merged."""
    out, k = [], 1
    while (x := int((1 - dropout) ** k * 2**64)) and k < 1 << 16:
        out.append(min(x, 2**64 - 1))
        k += 1
    return np.array(out[::-1], np.uint64)


def _remembered(model: Model, memo: spans.Memo, codes: np.ndarray, starts: np.ndarray, lens: np.ndarray, own: np.ndarray, dropout: float) -> tuple[np.ndarray, np.ndarray]:
    """(ids, numbers) of short stretches of ``codes``; own: the occurrences' keys."""
    at, n = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64)
    left, state = np.arange(len(starts)), spans.keys(codes, starts, starts + lens)
    skips, asked = np.zeros((len(starts), 0), np.int16), []
    while len(left):
        distinct, first, inverse = np.unique(state, return_index=True, return_inverse=True)
        new = np.flatnonzero(memo.unknown(distinct))
        if len(new):
            rows = left[first[new]]
            memo.learn(distinct[new], *model.merge_all(codes[spans.gather(starts[rows], lens[rows])], lens[rows], None, 0.0, skips[first[new]]))
        asked.append(distinct)
        place, size = memo.places(distinct)
        place = place[inverse]
        at[left], n[left] = place + 1, size[inverse] - 1
        if not dropout:
            break
        # the next candidate that is skipped, if the stretch takes so many
        limits = _limits(dropout)
        drawn = len(limits) - np.searchsorted(limits, spans.mixed(own[left] + np.uint64(skips.shape[1] * 0xC2B2AE3D27D4EB4F & _M64)), side="right")
        skip = drawn + (skips[:, -1] + 1 if skips.shape[1] else 0)
        on = skip < memo.flat[place]
        left, skip = left[on], skip[on]
        skips = np.column_stack((skips[on], skip.astype(np.int16)))
        state = spans.mixed(state[on] + (skip + 1).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    out = memo.flat[spans.gather(at, n)]
    memo.trim(np.unique(np.concatenate(asked)) if asked else np.zeros(0, np.uint64))
    return out, n


def encode_all(path: str, texts: list[str | None], dropout: float, seed: int, marks: list | None = None) -> list[np.ndarray]:
    """The ids of each text; marks: what tells documents apart besides their texts."""
    model, memo = load(path), _memo(path)
    whole = [" " + t if t else "" for t in texts]
    lens = np.fromiter(map(len, whole), np.int64, len(whole))
    codes = np.frombuffer("".join(whole).encode("utf-32-le", "replace"), "<u4").astype(np.int32)
    ends = np.cumsum(lens)
    if not len(codes):
        return [np.zeros(0, np.int32)] * len(texts)
    starts = model.stretches(codes, (ends - lens)[lens > 0])
    sizes = np.diff(np.append(starts, len(codes)))
    text = np.searchsorted(ends, starts, side="right")
    marked = zip(whole, marks or [""] * len(whole))
    documents = np.array([xxhash.xxh64_intdigest(f"{seed}/{m}/{t}".encode("utf-8", "replace")) for t, m in marked], np.uint64)
    own = spans.mixed(documents[text] + (starts - (ends - lens)[text]).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    long = (sizes > LONG) & bool(dropout)
    n = np.zeros(len(starts), np.int64)
    found = []
    for rows in (np.flatnonzero(~long), np.flatnonzero(long)):
        if len(rows) and long[rows[0]]:
            part, n[rows] = model.merge_all(codes[spans.gather(starts[rows], sizes[rows])], sizes[rows], own[rows], dropout)
        else:
            part, n[rows] = _remembered(model, memo, codes, starts[rows], sizes[rows], own[rows], dropout)
        found.append((rows, part))
    total = np.concatenate(([0], np.cumsum(n)))
    ids = np.empty(int(total[-1]), np.int32)
    for rows, part in found:
        ids[spans.gather(total[rows], n[rows])] = part
    after = total[np.searchsorted(starts, ends)]
    return [ids[x:y] for x, y in zip([0, *after[:-1].tolist()], after.tolist())]


def _variant(variants: int):
    return F.coalesce(F.pmod(F.xxhash64(F.col("doc_id").cast("long")), F.lit(variants)), F.lit(0)).cast("int")


def _portions(path: str, batches, dropout: float, seed: int):
    """Arrow batches of (doc_id, variant, text) as lists of (doc_id, variant, text, ids)."""
    for rows in spans.portions(batches, PORTION):
        found = encode_all(path, [r[2] for r in rows], dropout, seed, [f"{r[1]}/{r[0]}" for r in rows])
        yield [(*r, x) for r, x in zip(rows, found)]


def _own(docs: DataFrame, variants: int) -> DataFrame:
    common.tune(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), _variant(variants).alias("variant"), F.col("text").cast("string").alias("text"))


def encoded(docs: DataFrame, path: str, dropout: float = DROPOUT, seed: int = SEED, variants: int = VARIANTS) -> DataFrame:
    """(doc_id, ids) of every document, encoded with dropout."""

    def run(batches):
        for rows in _portions(path, batches, dropout, seed):
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[3] for r in rows], pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return _own(docs, variants).mapInArrow(run, "doc_id long, ids array<int>")


def decoded(rows: DataFrame, path: str) -> DataFrame:
    """``rows`` with ``text``: what their ids stand for."""

    @F.arrow_udf("string")
    def text(ids: pa.Array) -> pa.Array:
        model = load(path)
        return pa.array([None if i is None else model.decode(i) for i in ids.to_pylist()], pa.string())

    return rows.withColumn("text", text("ids"))


DIGESTS = "doc_id long, variant int, n_pieces long, ids_crc32 long, text_crc32 long, lossless boolean"


def digests(docs: DataFrame, path: str, dropout: float = DROPOUT, seed: int = SEED, variants: int = VARIANTS) -> DataFrame:
    """Rows of DIGESTS; text_crc32 is of the text that the ids decode to, lossless says whether it is the document's."""

    def run(batches):
        model = load(path)
        for rows in _portions(path, batches, dropout, seed):
            out: list[list] = [[], [], [], [], [], []]
            for doc_id, variant, text, ids in rows:
                data = ids.astype("<u4").tobytes()
                back = model.decoded_bytes(data)
                for column, value in zip(out, (doc_id, variant, len(ids), zlib.crc32(data), zlib.crc32(back), back == (text or "").encode("utf-8", "replace"))):
                    column.append(value)
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names=["doc_id", "variant", "n_pieces", "ids_crc32", "text_crc32", "lossless"])

    return _own(docs, variants).mapInArrow(run, DIGESTS)


def op8_merge_dropout(spark, sf_dir):
    import public_tokenizers

    return digests(common.table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
