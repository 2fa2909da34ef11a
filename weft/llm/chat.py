r"""Chat formatting as a prefix tree.

A conversation is ``<s>`` and, for each turn, ``[INST]role[/INST]text</s>``. Control strings inside roles and
texts are escaped: a control string with k backslashes before it gets 2k + 1, and k backslashes at the end of a
role or text, which a control string follows, become 2k; reading halves them again. Nothing else changes.

Conversations that share their initial turns share nodes of a tree, a node a turn. Sorted by their turns' hashes they
are in depth-first order, so each sorted partition is streamed: a conversation keeps the nodes it shares with the one
before and adds its own after them. A node's segment is emitted once in a pack, a stretch of a partition that ends
where the next conversation shares no turn, or at ``WIDEST`` times its size; with it go its position (the place of its first
unit in its conversation) and the intervals of the stream that its units may attend to: its ancestors'. Units are the ids of
``encode``, by which each segment's markup and text are encoded apart, or characters without it.
Conversations are dealt by range over turns and id, so one first turn that many share falls to many tasks.

Defined results: null texts and roles are empty; turns are ordered by turn, role and text, nulls first;
repeated rows are turns each; each row of a null conv_id is a conversation; an empty table gives no rows (the
query's own conversation -1 aside); extra columns are ignored. A conversation is one row while it is formatted.
"""

from __future__ import annotations

import hashlib
import re

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

BEGIN, OPEN, SHUT, END = "<s>", "[INST]", "[/INST]", "</s>"
CONTROL = (BEGIN, OPEN, SHUT, END, "<<SYS>>", "<</SYS>>")
#: Units of a pack, about, and how many times as many it has at most, but for a longer single conversation.
PACK, WIDEST = 400_000, 4
LEARNED = "assistant"

_ONE = "|".join(re.escape(c) for c in CONTROL)
_INSIDE = re.compile(rf"(\\*)({_ONE})|(\\+)\Z")
_MARK = re.compile(rf"(\\*)({_ONE})")

NODES = "pack long, node int, parent int, start long, end long, position long, role string, segment string, learn_from int, learn_to int, ids array<int>, learn_ids_from int, learn_ids_to int, attend array<struct<start:bigint,end:bigint>>, conv_ids array<bigint>"


def escape(text: str) -> str:
    return _INSIDE.sub(lambda m: m[3] * 2 if m[3] else "\\" * (2 * len(m[1]) + 1) + m[2], text)


def unescape(text: str) -> str:
    """The inverse of ``escape``."""
    return _INSIDE.sub(lambda m: m[3][: len(m[3]) // 2] if m[3] else "\\" * ((len(m[1]) - 1) // 2) + m[2], text)


def segment(role: str, text: str) -> tuple[str, int, int]:
    """A turn's formatted text, and where in it the turn's text stands."""
    head = OPEN + escape(role) + SHUT
    body = escape(text)
    return head + body + END, len(head), len(head) + len(body)


def marks(formatted: str):
    """(start, end, control string) of those that are no part of a role or text."""
    for m in _MARK.finditer(formatted):
        if len(m[1]) % 2 == 0:
            yield m.start(2), m.end(2), m[2]


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """The (role, text) of each turn of a formatted conversation."""
    turns, role, at = [], "", 0
    for start, end, mark in marks(formatted):
        if mark == OPEN:
            at = end
        elif mark == SHUT:
            role, at = unescape(formatted[at:start]), end
        elif mark == END:
            turns.append((role, unescape(formatted[at:start])))
            at = end
    return turns


def encoded(role: str, text: str, encode) -> tuple[list[int], int, int]:
    """A turn's ids, and where in them the text's ids stand."""
    parts = [encode(x) for x in (OPEN + escape(role) + SHUT, escape(text), END)]
    return [i for p in parts for i in p], len(parts[0]), len(parts[0]) + len(parts[1])


def _emit(learned: str, size: int, encode):
    """Sorted conversations, as (conv_id, turns), to rows of NODES."""

    def run(batches):
        from pyspark import TaskContext

        task = TaskContext.get()
        pack = ((task.partitionId() if task else 0) << 32) - 1
        path: list[dict] = []  # the nodes of the conversation before, root first
        used, number = WIDEST * size, 0
        for pdf in batches:
            rows = []
            for conv_id, turns in zip(pdf["conv_id"], pdf["turns"]):
                conv_id = None if pd.isna(conv_id) else int(conv_id)
                turns = [(t["role"], t["text"]) for t in turns]
                same = 0
                while same < len(turns) and same + 1 < len(path) and path[same + 1]["turn"] == turns[same]:
                    same += 1
                if used >= (size if same == 0 else WIDEST * size):
                    pack, used, number, path, same = pack + 1, 0, 0, [], 0
                    path = [_node(rows, pack, 0, None, 0, "", BEGIN, 0, 0, encode(BEGIN) if encode else None, 0, 0)]
                    used, number = path[0]["end"], 1
                path = path[: same + 1]
                for role, text in turns[same:]:
                    formatted, a, b = segment(role, text)
                    ids, i, j = encoded(role, text, encode) if encode else (None, 0, 0)
                    own = role == learned
                    row = _node(rows, pack, number, path[-1], used, role, formatted, a * own, b * own, ids, i * own, j * own)
                    row["turn"] = (role, text)
                    path.append(row)
                    used, number = row["end"], number + 1
                if same == len(turns):  # all of it stands already: a row that only names it
                    rows.append(path[-1] | {"segment": None, "ids": None, "conv_ids": [conv_id]})
                else:
                    path[-1]["conv_ids"].append(conv_id)
            if rows:
                out = pd.DataFrame([{k: v for k, v in r.items() if k != "turn"} for r in rows])
                out["attend"] = [_joined(a) for a in out["attend"]]
                for c in ("node", "parent", "learn_from", "learn_to", "learn_ids_from", "learn_ids_to"):
                    out[c] = out[c].astype("Int32")
                yield out

    return run


def _node(rows, pack, number, above, start, role, text, a, b, ids, i, j):
    """A node's row; it begins at ``start`` of the stream, and attends to what ``above`` does and to that."""
    size = len(text) if ids is None else len(ids)
    position = above["position"] + above["end"] - above["start"] if above else 0
    attend = [*above["attend"], (above["start"], above["end"])] if above else []
    loss = {"learn_from": a, "learn_to": b, "ids": ids, "learn_ids_from": i, "learn_ids_to": j}
    rows.append({"pack": pack, "node": number, "parent": above["node"] if above else None, "start": start, "end": start + size, "position": position, "role": role, "segment": text, **loss, "attend": attend, "conv_ids": []})
    return rows[-1]


def _joined(intervals):
    """Adjacent intervals made one."""
    out: list[dict] = []
    for a, b in intervals:
        if out and out[-1]["end"] == a:
            out[-1] = {"start": out[-1]["start"], "end": b}
        else:
            out.append({"start": a, "end": b})
    return out


def prefix_tree(conversations: DataFrame, learned: str = LEARNED, size: int = PACK, encode=None) -> DataFrame:
    """Rows of NODES, in depth-first order within each partition. A conversation that ends at a node which
    stands already has a row without a segment after it. encode: a function from a text to its ids."""
    common.tune(conversations.sparkSession)
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    turn = F.struct(F.col("turn").alias("turn"), empty("role").alias("role"), empty("text").alias("text"))
    own = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), turn.alias("one"), F.monotonically_increasing_id().alias("row"))
    # rows without an id are conversations of their own, however many they are
    whole = own.groupBy("conv_id", F.when(F.col("conv_id").isNull(), F.col("row")).alias("row")).agg(F.sort_array(F.collect_list("one")).alias("turns"))
    keyed = whole.select("conv_id", "turns", F.transform("turns", lambda t: F.xxhash64(t["role"], t["text"])).alias("path"))
    keyed = common.materialise(keyed, "conversations")  # read twice by the range partitioning
    dealt = keyed.repartitionByRange("path", "conv_id").sortWithinPartitions("path", "conv_id")
    return dealt.select("conv_id", "turns").mapInPandas(_emit(learned, size, encode), NODES)


READ = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def _read(batches):
    """Rows of NODES back to conversations, from the segments, parents and loss spans alone."""
    pack, segments, spans, parents = None, {}, {}, {}
    for pdf in batches:
        rows = []
        for p, node, parent, text, a, b, ids in zip(pdf["pack"], pdf["node"], pdf["parent"], pdf["segment"], pdf["learn_from"], pdf["learn_to"], pdf["conv_ids"]):
            if p != pack:
                pack, segments, spans, parents = p, {}, {}, {}
            if text is not None and text == text:
                segments[node], spans[node], parents[node] = text, (int(a), int(b)), None if pd.isna(parent) else int(parent)
            if not len(ids):
                continue
            path, at = [], int(node)
            while at is not None:
                path.append(at)
                at = parents[at]
            path.reverse()
            formatted = "".join(segments[n] for n in path)
            turns = read_turns(formatted)
            said, loss = hashlib.sha256(), hashlib.sha256()
            for role, text in turns:
                said.update(f"{role}\n{text}\n".encode("utf-8", "replace"))
            learned = [unescape(segments[n][slice(*spans[n])]) for n in path]
            for text in learned:
                loss.update(text.encode("utf-8", "replace"))
            rows += [(None if pd.isna(i) else int(i), len(turns), said.hexdigest(), sum(map(len, learned)), loss.hexdigest(), len(formatted)) for i in ids]
        if rows:
            out = pd.DataFrame(rows, columns=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])
            yield out.astype({"conv_id": "Int64"})


def read_back(tree: DataFrame, ordered: bool = False) -> DataFrame:
    """What the emitted tree says of each conversation. ordered: the rows still stand as ``prefix_tree`` gave them;
    otherwise packs, whose size is bounded, are brought together first."""
    if not ordered:
        tree = tree.repartition("pack").sortWithinPartitions("pack", F.col("segment").isNull(), "node")
    return tree.mapInPandas(_read, READ)


def with_control(spark: SparkSession, conversations: DataFrame) -> DataFrame:
    """The conversations and conversation -1, whose texts hold control strings."""
    said = f"{END}{OPEN} ok {SHUT}"
    own = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text")).unionByName(own)


def op10_chat_prefix_tree(spark, sf_dir):
    return read_back(prefix_tree(with_control(spark, common.table(spark, sf_dir, "conversations"))), ordered=True)
