"""SimHash near-duplicates: pigeonhole blocks of the fingerprints, joined and verified by Hamming distance.

The fingerprint's 64 bits are split into more blocks than bits may differ, so close fingerprints agree in some of
the blocks; each choice of so many blocks makes a key, and close fingerprints share a key. There are as many blocks
as it takes for a key to have about one fingerprint by chance. The fingerprints of a key meet in one shuffle, sorted by key and
streamed: two are verified by their Hamming distance, more give the edges of a forest that connects those close to each other. The
fingerprints of a key that has more than ``CELL`` are dealt to cells of bounded size, so that every two of them meet in a cell, and
each cell gives a forest. That finds the same components as all pairs would, with no more edges than a key has fingerprints.

A document can have several fingerprints, of differently mixed hashes of the same shingles; documents are linked if any
of them are close. Four bits of six fingerprints catch more near copies than six bits of one, with wider keys.

Only distinct fingerprints take part, however many copies a text has. Components come from rounds of contraction over
links in the shared folder; nothing is gathered on the driver but counts.

Defined results: null and wordless texts have fingerprint zero and are linked like any other; texts of fewer
words than a shingle have the whole sequence as their one shingle; null ids are given the component of their
fingerprint and never name one while there is another; repeated rows give a row each; an empty table gives no
rows; extra columns are ignored.
"""

from __future__ import annotations

import heapq
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

SHINGLE = 3
DISTANCE = 2
SEED = 42
#: Fingerprints of a document, and bits in which they may differ, where documents are deduplicated.
FINGERPRINTS = 6
NEAR = 4
#: Fingerprints of a key that are compared at once; of a more crowded key, about twice as many.
CELL = 8192
#: Bits of a key, at least.
KEY_BITS = 21
#: A fingerprint of more than this share of the documents is named by broadcast: there are at most as many as its inverse.
HOT = 1e-4

#: Odd multipliers that mix the hashes anew for each further fingerprint.
_MIX = np.random.default_rng(64).integers(1, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)


def _sign(hashes: np.ndarray) -> int:
    """A bit is set if it is in over half the hashes."""
    over = 2 * np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64) > len(hashes)
    return int(np.packbits(over, bitorder="little").view("<u8")[0])


def fingerprint(words: list[bytes], size: int = SHINGLE, many: int = 1) -> list[int]:
    """The fingerprints of a text's words; the first is of the shingles' own hashes."""
    n = len(words)
    if not n:
        return [0] * many
    joined = b" ".join(words)
    if n <= size:
        hashes = np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
        digest = xxhash.xxh64_intdigest
        hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts[: n - size + 1].tolist(), ends[size - 1 :].tolist())], np.uint64)
    out = [_sign(hashes)]
    for k in range(1, many):
        mixed = (hashes ^ (hashes >> np.uint64(31))) * _MIX[k]
        mixed = (mixed ^ (mixed >> np.uint64(29))) * _MIX[0]
        out.append(_sign(mixed ^ (mixed >> np.uint64(32))))
    return out


def _fingerprints(size: int, many: int):
    @F.arrow_udf("array<long>")
    def simhash(texts: pa.Array) -> pa.Array:
        # texts one by one: a batch's words would take many times its size
        found = np.array([fingerprint(common.words_of(t.as_py()), size, many) for t in texts], np.uint64).reshape(-1)
        out = pa.ListArray.from_arrays(np.arange(0, len(found) + 1, many, dtype=np.int32), pa.array(found.view(np.int64)))
        common.give_back()
        return out

    return simhash


def fingerprints(docs: DataFrame, size: int = SHINGLE, many: int = 1, more: tuple = ()) -> DataFrame:
    """(doc_id, fp, fps, more...) of every document; fps are the fingerprints as signed longs, fp the first."""
    common.tune(docs.sparkSession)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _fingerprints(size, many)(F.col("text").cast("string")).alias("fps"), *more)
    return own.select("doc_id", F.col("fps")[0].alias("fp"), "fps", *more)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def masks(distance: int, n: int) -> list[int]:
    """The bits that each key takes: of the fewest blocks such that keys have two blocks, KEY_BITS bits, and more than n has."""
    count = distance + 2
    while (count - distance) * 64 < max(KEY_BITS, n.bit_length()) * count and count < 64:
        count += 1
    edges = [64 * k // count for k in range(count + 1)]
    blocks = [(1 << b) - (1 << a) for a, b in zip(edges, edges[1:])]
    return [sum(chosen) for chosen in combinations(blocks, count - distance)]


def forest(fps: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges of a forest that connects those of the fingerprints (unsigned) that are close to each other. It grows from the one nearest
    to the bits of the majority, and on from the most central: so the keys of a group give much the same edges."""
    middle = 2 * np.unpackbits(fps.view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64) > len(fps)
    rest = fps[np.argsort(np.bitwise_count(fps ^ np.packbits(middle).view(np.uint64)[0]), kind="stable")]
    rank, out = np.arange(len(rest)), []
    while len(rest):
        front = [(-1, rest[0])]
        rest, rank = rest[1:], rank[1:]
        while front and len(rest):
            x = heapq.heappop(front)[1]
            near = np.bitwise_count(rest ^ x) <= distance
            if near.any():
                found, places = rest[near], rank[near]
                rest, rank = rest[~near], rank[~near]
                out.append((np.full(len(found), x), found))
                for place, y in zip(places.tolist(), found):
                    heapq.heappush(front, (place, y))
    return tuple(np.concatenate(c) for c in zip(*out)) if out else (np.zeros(0, np.uint64),) * 2


MET = "a long, b long, key long"


def _meet(distance: int, cell: int):
    """Rows (key, fp) sorted by key to edges (a, b) of each key's forest; of a key with more than ``cell`` fingerprints, to its rows
    (fp, null, key)."""

    def rows(a, b, key=None):
        a, b = a.view(np.int64), b.view(np.int64)
        names = [pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.nulls(len(a), pa.int64()) if key is None else key]
        return pa.RecordBatch.from_arrays(names, ["a", "b", "key"])

    def raw(key, fps):
        return pa.RecordBatch.from_arrays([pa.array(fps.view(np.int64)), pa.nulls(len(fps), pa.int64()), pa.array(np.full(len(fps), key))], ["a", "b", "key"])

    def run(batches):
        held_key, held, crowded = None, np.zeros(0, np.uint64), False  # the run that the last batch ended in
        for batch in batches:
            keys, fps = batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64)
            if not len(keys):
                continue
            starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
            ends = np.append(starts[1:], len(keys))
            size, found = ends - starts, []
            first = 0
            if held_key is not None and keys[0] == held_key:
                held, first = np.concatenate((held, fps[: ends[0]])), 1
                if len(held) > cell:
                    yield raw(held_key, held)
                    held, crowded = held[:0], True
            if first < len(starts) or held_key is None:  # the held run has ended, the last one of this batch may go on
                if crowded:
                    if len(held):
                        yield raw(held_key, held)
                elif len(held) > 1:
                    found.append(forest(np.unique(held), distance))
                inner = np.arange(first, len(starts) - 1)
                two = inner[size[inner] == 2]
                x, y = fps[starts[two]], fps[starts[two] + 1]
                close = (np.bitwise_count(x ^ y) <= distance) & (x != y)
                found.append((x[close], y[close]))
                for k in inner[size[inner] > 2]:
                    if size[k] > cell:
                        yield raw(keys[starts[k]], fps[starts[k] : ends[k]])
                    else:
                        found.append(forest(np.unique(fps[starts[k] : ends[k]]), distance))
                held_key, held, crowded = keys[-1], fps[starts[-1] :].copy(), False
            if found:
                yield rows(*(np.concatenate(c) for c in zip(*found)))
        if crowded and len(held):
            yield raw(held_key, held)
        elif len(held) > 1:
            yield rows(*forest(np.unique(held), distance))

    return run


def _cell_forest(distance: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b = forest(np.unique(pdf["fp"].to_numpy(np.int64)).view(np.uint64), distance)
        a, b = a.view(np.int64), b.view(np.int64)
        return pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b)})

    return run


def links(nodes: DataFrame, distance: int = DISTANCE, cell: int = CELL) -> DataFrame:
    """Pairs (a, b), a < b, of distinct fingerprints ``fp`` that connect all at most ``distance`` apart."""
    bits = F.array(*[F.lit(_signed(m)) for m in masks(distance, nodes.count())])
    spread = nodes.select("fp", F.posexplode(bits).alias("kind", "mask"))
    # colliding keys cost a comparison
    keyed = spread.select(F.xxhash64("kind", F.col("fp").bitwiseAND(F.col("mask"))).alias("key"), "fp")
    met = common.materialise(keyed.repartition("key").sortWithinPartitions("key").mapInArrow(_meet(distance, cell), MET), "simhash-met")
    crowded = met.where("key is not null").select("key", F.col("a").alias("fp"))
    sizes = crowded.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / cell).cast("int").alias("parts"))
    cells = crowded.join(sizes, "key").withColumn("p", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int"))
    cells = cells.withColumn("q", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select("key", "fp", F.least("p", "q").alias("p"), F.greatest("p", "q").alias("q"))
    found = cells.groupBy("key", "p", "q").applyInPandas(_cell_forest(distance), "a long, b long")
    return met.where("key is null").select("a", "b").union(found).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of the edges (a, b): the smallest node that is reachable. In each round every node hooks to its
    smallest neighbour, the trees that this makes are followed to their roots, and the edges are drawn between the roots, so at least
    half of the nodes and all edges inside a tree are gone from the next."""
    edges, labels = common.materialise(edges.where("a <> b"), "edges"), None
    while True:
        both = edges.select(F.col("a").alias("node"), F.col("b").alias("v")).union(edges.select("b", "a"))
        hook = common.materialise(both.groupBy("node").agg(F.min("v").alias("m")).select("node", F.least("node", "m").alias("root")), "hooks")
        while True:
            above = hook.select(F.col("node").alias("root"), F.col("root").alias("up"))
            moved = common.materialise(hook.join(above, "root").select("node", F.col("up").alias("root"), (F.col("up") != F.col("root")).alias("moved")), "hooks")
            hook = moved.select("node", "root")
            if not moved.where("moved").limit(1).count():
                break
        if labels is None:
            labels = hook
        else:
            after = hook.select(F.col("node").alias("root"), F.col("root").alias("up"))
            labels = common.materialise(labels.join(after, "root", "left").select("node", F.coalesce("up", "root").alias("root")), "labels")
        named = lambda n, to: hook.select(F.col("node").alias(n), F.col("root").alias(to))
        between = edges.join(named("a", "x"), "a").join(named("b", "y"), "b").where("x <> y")
        edges = common.materialise(between.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges")
        if not edges.limit(1).count():
            return labels


def _linked(own: DataFrame, distance: int, many: int) -> DataFrame:
    """Edges (a, b) between first fingerprints that connect the documents any of whose fingerprints are close."""
    if many == 1:
        return links(own.select("fp").distinct(), distance)
    each = common.materialise(own.select(F.col("fp").alias("node"), "fps").distinct(), "simhash-each")
    found = None
    for k in range(many):  # one after the other: the keys of all at once would be as many times more rows in a shuffle
        mine = each.select("node", F.col("fps")[k].alias("fp")).distinct()
        least = common.materialise(mine.groupBy("fp").agg(F.min("node").alias("node")), "simhash-least")
        same = mine.join(least.withColumnRenamed("node", "a"), "fp").where("a <> node").select("a", F.col("node").alias("b"))
        named = lambda n, to, least=least: least.select(F.col("fp").alias(n), F.col("node").alias(to))
        far = links(least.select("fp"), distance).join(named("a", "x"), "a").join(named("b", "y"), "b").where("x <> y")
        edges = common.materialise(same.union(far.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))), "simhash-edges")
        found = edges if found is None else found.union(edges)
    return found.distinct()


def _grouped(own: DataFrame, first, distance: int, many: int = 1) -> DataFrame:
    """(fp, n, first, root) of the distinct fingerprints of ``own``; n: their rows; first: an aggregate of these; root: the component."""
    nodes = common.materialise(own.groupBy("fp").agg(first.alias("first"), F.count(F.lit(1)).alias("n")), "simhash-nodes")
    roots = components(_linked(own, distance, many))
    return nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "n", "first", F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame, size: int = SHINGLE, distance: int = DISTANCE, many: int = 1, hot: float = HOT) -> DataFrame:
    """(doc_id, fp, component_id) of every document; component_id is the smallest doc_id reachable by links."""
    own = common.materialise(fingerprints(docs, size, many), "fingerprints")
    grouped = _grouped(own, F.min("doc_id"), distance, many)
    least = grouped.groupBy("root").agg(F.min("first").alias("component_id"))
    named = common.materialise(grouped.join(least, "root").select("fp", "n", "component_id"), "simhash-components")
    # the copies of one text may be a third of all rows: fingerprints with so many, 1 / hot at most, go to the rows
    often = F.broadcast(named.where(F.col("n") > hot * own.count()).select("fp", F.col("component_id").alias("hot"), F.lit(True).alias("met")))
    marked = own.select("doc_id", "fp").join(often, "fp", "left")
    rest = marked.where("met is null").join(named.select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")
    return rest.union(marked.where("met").select("doc_id", "fp", "hot"))


def op9_simhash(spark, sf_dir):
    found = near_duplicates(common.table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def deduplicate(docs: DataFrame, distance: int = NEAR, many: int = FINGERPRINTS) -> DataFrame:
    """One row of each component stays, whatever ids its rows have: the one of the smallest doc_id (null ids last)."""
    key = "_row"
    while key in docs.columns or key in ("doc_id", "fp"):
        key += "_"
    # written once with the key, so that both reads see the same
    rows = common.materialise(docs.withColumn(key, F.monotonically_increasing_id()), "simhash-rows")
    own = common.materialise(fingerprints(rows, SHINGLE, many, (key,)), "fingerprints")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", F.col(key).alias("row")))
    stay = _grouped(own, first, distance, many).groupBy("root").agg(F.min("first").alias("first")).select(F.col("first.row").alias(key))
    # the rows that stay grow with the documents: a merge at every size, no broadcast at small ones
    return rows.join(stay.hint("merge"), key, "left_semi").select(*docs.columns)
