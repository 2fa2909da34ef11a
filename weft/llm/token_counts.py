"""Token counts: pieces are counted once per distinct pre-token and summed over per-document frequencies.

A text falls into pre-tokens that the byte-level splitter treats independently of each other: it is cut
before every single space that a non-space follows, and around every line feed that stands between two
non-spaces. Each block of documents keeps its distinct pre-tokens, in the order of their hashes, and the documents'
frequencies of them (CSR, as compressed differences). The blocks' stretches of one range of hashes, a bucket,
meet in one task, where each distinct pre-token is given to the tokenizer once, and its number of pieces joins the
frequencies again. Buckets grow in number with the pre-tokens; a task keeps those of one bucket at a time. No ids
are built per document.

Defined results: null text counts as empty (0 bytes, 0 tokens); repeated rows and ids give a row each; null
ids stay; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import os
import zlib
from collections import defaultdict
from functools import lru_cache
from itertools import count

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Characters of text to a block, at most, but for a longer single text.
BLOCK_CHARS = 24_000_000

#: Pre-tokens of all blocks to a bucket, at most (on average).
BUCKET = 1 << 20

BLOCKS = "block long, ids array<long>, n_bytes array<long>, lens array<int>, entry binary, freq binary, n_pretokens long, pretokens binary"


def squeeze(numbers: np.ndarray) -> bytes:
    """Unsigned 32-bit integers, compressed: their number, then their first bytes, second bytes, and so on."""
    numbers = np.ascontiguousarray(numbers, np.uint32)
    planes = numbers.view(np.uint8).reshape(-1, 4).T.tobytes()
    return len(numbers).to_bytes(8, "little") + pa.compress(planes, codec="zstd", asbytes=True)


def unsqueeze(data: bytes) -> np.ndarray:
    n = int.from_bytes(data[:8], "little")
    planes = np.frombuffer(pa.decompress(data[8:], 4 * n, codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(4, n).T).view(np.uint32).ravel()


def squeeze_names(names: list[bytes]) -> bytes:
    """Byte strings, compressed: their lengths, then all of them in a row."""
    lens, data = squeeze(np.fromiter(map(len, names), np.uint32, len(names))), b"".join(names)
    return len(lens).to_bytes(8, "little") + lens + len(data).to_bytes(8, "little") + pa.compress(data, codec="zstd", asbytes=True)


def unsqueeze_names(data: bytes) -> list[bytes]:
    at = 8 + int.from_bytes(data[:8], "little")
    lens = unsqueeze(data[8:at])
    whole = pa.decompress(data[at + 8 :], int.from_bytes(data[at : at + 8], "little"), codec="zstd", asbytes=True)
    ends = np.cumsum(lens, dtype=np.int64)
    return [whole[a:b] for a, b in zip((ends - lens).tolist(), ends.tolist())]


def _hashes(names: list[bytes]) -> np.ndarray:
    return np.fromiter(map(zlib.crc32, names), np.uint32, len(names))


@lru_cache(2)
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@lru_cache(1)
def _odd():
    import re

    # white space beyond single spaces within lines and single line feeds between words, and characters on
    # which definitions of white space differ
    return re.compile(r"\s[^\S ]|[^\S\n]\s|[^\S \n]|^\s|\s$|\n\s"), re.compile(r" (?=\S)")


def pretokens(text: str) -> tuple[list[str], list[str], int]:
    """(pre-tokens as they stand, pre-tokens lacking their leading space, number of lone line feeds)."""
    odd, cut = _odd()
    if not text:
        return [], [], 0
    if not odd.search(text):
        bare, spaced = [], []
        lines = text.split("\n")
        for line in lines:
            first, *rest = line.split(" ")
            bare.append(first)
            spaced += rest
        return bare, spaced, len(lines) - 1
    first, *rest = cut.split(text)
    return [first], rest, 0


def _blocks(batches):
    """Arrow batches of (doc_id, text) to rows of BLOCKS."""
    task = TaskContext.get()
    base, made = (task.partitionId() if task else 0) << 24, 0

    def fresh():
        number = count()
        return [defaultdict(number.__next__), defaultdict(number.__next__), [], [], [], [], [], 0]

    def row(state):
        bare, spaced, ids, sizes, lens, entries, freqs, _ = state
        names = [""] * (len(bare) + len(spaced))
        for w, i in bare.items():
            names[i] = w
        for w, i in spaced.items():
            names[i] = " " + w
        names = [n.encode("utf-8", "replace") for n in names]
        order = np.argsort(_hashes(names), kind="stable")
        place = np.empty(len(names), np.int64)
        place[order] = np.arange(len(names))
        # a document's entries in ascending order again
        own, freq = np.repeat(np.arange(len(lens)), lens) << 32 | place[np.concatenate(entries)], np.concatenate(freqs)
        by = np.argsort(own)
        steps = np.diff(own[by].astype(np.uint32), prepend=np.uint32(0))
        return pa.RecordBatch.from_arrays(
            [
                pa.array([base + made], pa.int64()),
                pa.array([ids], pa.list_(pa.int64())),
                pa.array([sizes], pa.list_(pa.int64())),
                pa.array([lens], pa.list_(pa.int32())),
                pa.array([squeeze(steps)], pa.binary()),
                pa.array([squeeze(freq[by])], pa.binary()),
                pa.array([len(names)], pa.int64()),
                pa.array([squeeze_names([names[i] for i in order])], pa.binary()),
            ],
            names=["block", "ids", "n_bytes", "lens", "entry", "freq", "n_pretokens", "pretokens"],
        )

    state = fresh()
    for batch in batches:
        ids, texts = batch.column(0).to_pylist(), batch.column(1)
        for k in range(len(ids)):
            text = texts[k].as_py() or ""
            first, rest, feeds = pretokens(text)
            bare, spaced = state[0], state[1]
            n = len(first) + len(rest)
            got = np.fromiter(map(bare.__getitem__, first), np.int32, len(first))
            if rest:
                got = np.concatenate((got, np.fromiter(map(spaced.__getitem__, rest), np.int32, len(rest))))
            if n:
                got.sort()
                starts = np.flatnonzero(np.concatenate(([True], got[1:] != got[:-1])))
                entry, freq = got[starts], np.diff(np.append(starts, n)).astype(np.int32)
            else:
                entry = freq = np.zeros(0, np.int32)
            if feeds:
                entry = np.append(entry, np.int32(bare["\n"]))
                freq = np.append(freq, np.int32(feeds))
            state[2].append(ids[k])
            state[3].append(len(text.encode("utf-8", "replace")))
            state[4].append(len(entry))
            state[5].append(entry)
            state[6].append(freq)
            state[7] += len(text)
            if state[7] >= BLOCK_CHARS:
                yield row(state)
                made += 1
                state = fresh()
    if state[2]:
        yield row(state)


def _deal(buckets: int):
    """Blocks' pre-tokens to a row for each bucket that they fall into: the place of the first of them, and they."""
    starts = np.array([-(-(k << 32) // buckets) for k in range(buckets)], np.int64)

    def run(batches):
        for batch in batches:
            for block, data in zip(batch.column("block").to_pylist(), batch.column("pretokens")):
                names = unsqueeze_names(data.as_py())
                cuts = np.append(np.searchsorted(_hashes(names).astype(np.int64), starts), len(names))
                some = np.flatnonzero(np.diff(cuts))
                for part in np.array_split(some, -(-len(some) // common.ARROW_ROWS) or 1):
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(part, pa.int32()),
                            pa.array(np.full(len(part), block), pa.int64()),
                            pa.array(cuts[part], pa.int64()),
                            pa.array([squeeze_names(names[cuts[k] : cuts[k + 1]]) for k in part], pa.binary()),
                        ],
                        names=["bucket", "block", "first", "pretokens"],
                    )

    return run


def _count_once(path: str):
    """Rows sorted by bucket to (block, first, pieces): each distinct pre-token meets the tokenizer once."""

    def run(batches):
        tok = _tokenizer(path)
        last, known = None, {}
        for batch in batches:
            got = []
            for bucket, data in zip(batch.column("bucket").to_pylist(), batch.column("pretokens")):
                if bucket != last:
                    last, known = bucket, {}
                names = unsqueeze_names(data.as_py())
                new = [n for n in names if n not in known]
                known.update(zip(new, map(len, tok.encode_batch_fast([n.decode() for n in new], add_special_tokens=False))))
                got.append(squeeze(np.fromiter(map(known.__getitem__, names), np.uint32, len(names))))
            yield pa.RecordBatch.from_arrays([batch.column("block"), batch.column("first"), pa.array(got, pa.binary())], names=["block", "first", "pieces"])

    return run


def _sums(key, blocks: pd.DataFrame, pieces: pd.DataFrame) -> pd.DataFrame:
    """One block's frequencies times its pre-tokens' pieces, summed by document."""
    out = []
    parts = [unsqueeze(p) for _, p in sorted(zip(pieces["first"], pieces["pieces"]))]
    n = np.concatenate(parts).astype(np.int64) if parts else np.zeros(0, np.int64)
    for _, b in blocks.iterrows():
        entry = np.cumsum(unsqueeze(b["entry"]), dtype=np.uint32)
        total = np.concatenate(([0], np.cumsum(n[entry] * unsqueeze(b["freq"]))))
        ends = np.cumsum(np.asarray(b["lens"], np.int64))
        ids = pd.Series(list(b["ids"])).astype("Int64")
        out.append(pd.DataFrame({"doc_id": ids, "n_bytes": np.asarray(b["n_bytes"], np.int64), "n_tokens": total[ends] - total[np.concatenate(([0], ends[:-1]))]}))
    return pd.concat(out) if out else pd.DataFrame({"doc_id": [], "n_bytes": [], "n_tokens": []})


def token_counts(docs: DataFrame, tokenizer: str, limit: int = 512) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every text, as the library for ``tokenizer`` counts."""
    spark = docs.sparkSession
    common.tune(spark)
    blocks = common.materialise(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_blocks, BLOCKS), "pretoken-blocks")
    total = blocks.agg(F.coalesce(F.sum("n_pretokens"), F.lit(0))).first()[0]
    buckets = max(2 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // BUCKET))
    spread = blocks.select("block", "pretokens").mapInArrow(_deal(buckets), "bucket int, block long, first long, pretokens binary")
    pieces = spread.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_count_once(tokenizer), "block long, first long, pieces binary")
    kept = blocks.select("block", "ids", "n_bytes", "lens", "entry", "freq")
    sums = kept.groupBy("block").cogroup(pieces.groupBy("block")).applyInPandas(_sums, "doc_id long, n_bytes long, n_tokens long")
    return sums.withColumn("over_limit", F.col("n_tokens") > limit)


def op6_token_counts(spark, sf_dir):
    import public_tokenizers

    return token_counts(common.table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
