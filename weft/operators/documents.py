"""Sets of documents as rows of (doc_id, path, value): difference, patch, overlay, references, canonical form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .cuts import cut

#: Marks that a path can have beside its value.
FLAGS = ("required", "confidential", "deprecated")


def _plain(c: Column, t: T.DataType, at: Column) -> Column:
    return F.array(F.struct(at.alias("path"), c.cast("string").alias("value")))


def leaves(c: Column, t: T.DataType, at: Column, leaf=_plain, made: str = "array<struct<path:string,value:string>>") -> Column:
    """An array, of type ``made``, of what leaf(value, type, path) gives for a value's leaves, at any depth."""
    under = lambda name: F.concat(at, F.when(at == "", "").otherwise("."), name)
    if isinstance(t, T.StructType):
        return F.concat(*[leaves(c[f.name], f.dataType, under(F.lit(f.name)), leaf, made) for f in t.fields])
    if isinstance(t, T.ArrayType):
        return F.coalesce(F.flatten(F.transform(c, lambda x, i: leaves(x, t.elementType, F.concat(at, F.lit("["), i.cast("string"), F.lit("]")), leaf, made))), F.array().cast(made))
    if isinstance(t, T.MapType):
        return F.coalesce(F.flatten(F.transform(F.map_entries(c), lambda e: leaves(e["value"], t.valueType, under(e["key"].cast("string")), leaf, made))), F.array().cast(made))
    return leaf(c, t, at)


def paths(df: DataFrame, key: str, columns=None) -> DataFrame:
    """A table's rows as documents: a row (doc_id, path, value) for each leaf that isn't null, in structs, maps and arrays too."""
    columns = columns or [c for c in df.columns if c != key]
    every = F.concat(*[leaves(F.col(c), df.schema[c].dataType, F.lit(c)) for c in columns])
    return df.select(F.col(key).alias("doc_id"), F.explode(every).alias("f")).select("doc_id", "f.path", "f.value").where("value is not null")


def with_value(docs: DataFrame, path: str, value: Column) -> DataFrame:
    """Each document with a value at the path, in place of what was there; value: by the columns of (doc_id)."""
    rest = docs.where(F.col("path") != path).select("doc_id", "path", "value")
    return rest.union(docs.select("doc_id").distinct().select("doc_id", F.lit(path), value.cast("string")))


def without(docs: DataFrame, path: str) -> DataFrame:
    """Each document without the path and all below it."""
    c = F.col("path")
    return docs.where((c != path) & ~F.startswith(c, F.lit(path + ".")) & ~F.startswith(c, F.lit(path + "[")))


def diff(a: DataFrame, b: DataFrame, moves: bool = True) -> DataFrame:
    """(doc_id, op, path, to_path, old, new): add, delete, modify and, for equal values, move. Where both sides have them, other
    FLAGS make a modification too."""
    flags = [f for f in FLAGS if f in a.columns and f in b.columns]
    left = a.select("doc_id", "path", F.col("value").alias("old"), F.lit(True).alias("l"), *[F.col(f).alias(f"l_{f}") for f in flags])
    right = b.select("doc_id", "path", F.col("value").alias("new"), F.lit(True).alias("r"), *[F.col(f).alias(f"r_{f}") for f in flags])
    both = left.join(right, ["doc_id", "path"], "full_outer")
    other = ~F.col("old").eqNullSafe(F.col("new"))
    for f in flags:
        other = other | ~F.coalesce(F.col(f"l_{f}"), F.lit(False)).eqNullSafe(F.coalesce(F.col(f"r_{f}"), F.lit(False)))
    op = F.when(F.col("l").isNull(), "add").when(F.col("r").isNull(), "delete").when(other, "modify")
    changed = both.withColumn("op", op).where("op is not null").select("doc_id", "op", "path", F.lit(None).cast("string").alias("to_path"), "old", "new")
    if not moves:
        return changed
    # the n-th deletion and the n-th addition of a value in a document make a move: one row a value holds both lists
    pick = lambda what, x: F.collect_list(F.when(F.col("op") == what, x))
    v, cols = F.coalesce("old", "new"), ["op", "path", "to_path", "old", "new"]
    lists = changed.groupBy("doc_id", v.alias("v")).agg(
        F.sort_array(pick("delete", F.col("path"))).alias("gone"), F.sort_array(pick("add", F.col("path"))).alias("come"), pick("modify", F.struct("path", "old", "new")).alias("other")
    )
    none = F.lit(None).cast("string")
    row = lambda op, path, to, old, new: F.struct(*[c.alias(n) for c, n in zip((F.lit(op), path, to, old, new), cols)])
    m = F.when(F.col("v").isNull(), 0).otherwise(F.least(F.size("gone"), F.size("come")))
    left = lambda c: F.slice(c, m + 1, F.size(c))
    found = F.concat(
        F.transform(F.slice("gone", 1, m), lambda p, i: row("move", p, F.get("come", i), F.col("v"), F.col("v"))),
        F.transform(left("gone"), lambda p: row("delete", p, none, F.col("v"), none)),
        F.transform(left("come"), lambda p: row("add", p, none, none, F.col("v"))),
        F.transform("other", lambda x: row("modify", x["path"], none, x["old"], x["new"])),
    )
    return lists.select("doc_id", F.explode(found).alias("f")).select("doc_id", *[F.col(f"f.{c}").alias(c) for c in cols])


def patch(a: DataFrame, changes: DataFrame) -> DataFrame:
    """Deletions, moves, modifications, then additions. ``patch_errors`` has the changes of paths that aren't there."""
    hit = changes.where("op <> 'add'").select("doc_id", "path", "op", "to_path", "new")
    left = a.select("doc_id", "path", "value").join(hit, ["doc_id", "path"], "left").where("op is null or op <> 'delete'")
    path, value = F.when(F.col("op") == "move", F.col("to_path")).otherwise(F.col("path")), F.when(F.col("op") == "modify", F.col("new")).otherwise(F.col("value"))
    return left.select("doc_id", path.alias("path"), value.alias("value")).union(changes.where("op = 'add'").select("doc_id", "path", F.col("new").alias("value")))


def patch_errors(a: DataFrame, changes: DataFrame) -> DataFrame:
    """(doc_id, op, path) of the deletions, moves and modifications whose path isn't there."""
    return changes.where("op <> 'add'").join(a.select("doc_id", "path"), ["doc_id", "path"], "left_anti").select("doc_id", "op", "path")


def collapse(chain: DataFrame) -> DataFrame:
    """(doc_id, version, path, value) to the last version's value of each path; a null deletes the path and all below it, and a null
    at ``p[]`` the items of the array p."""
    marks = chain.where("value is null").select("doc_id", F.col("version").alias("v"), F.regexp_replace("path", r"\[\]$", "").alias("p"), F.endswith("path", F.lit("[]")).alias("items"))
    held = chain.groupBy("doc_id", "path").agg(F.max_by("value", "version").alias("value"), F.max("version").alias("version")).where("value is not null")
    item = F.startswith(held["path"], F.concat(marks["p"], F.lit("[")))
    below = item | (~marks["items"] & ((held["path"] == marks["p"]) | F.startswith(held["path"], F.concat(marks["p"], F.lit(".")))))
    return held.join(marks, (held["doc_id"] == marks["doc_id"]) & (marks["v"] > held["version"]) & below, "left_anti").select("doc_id", "path", "value")


def canonical_hash(docs: DataFrame) -> DataFrame:
    """(doc_id, hash): sha256 of a document's sorted path=value lines."""
    lines = F.sort_array(F.collect_list(F.concat_ws("=", "path", F.coalesce("value", F.lit("")))))
    return docs.groupBy("doc_id").agg(F.sha2(F.array_join(lines, "\n"), 256).alias("hash"))


def resolve(docs: DataFrame) -> DataFrame:
    """Values that are references (``@path``) replaced by what they lead to, over any number of steps; null where that is missing or
    the steps go in a circle. Each round doubles the steps taken, so there are as many as the longest chain's length has bits."""
    ref = F.startswith("value", F.lit("@"))
    step = cut(docs.where(ref).select("doc_id", "path", F.expr("substring(value, 2)").alias("to")))
    last = -1
    for _ in range(max(1, step.count().bit_length())):
        ahead = step.select("doc_id", F.col("path").alias("to"), F.col("to").alias("next"))
        step = cut(step.join(ahead, ["doc_id", "to"], "left").select("doc_id", "path", F.coalesce("next", "to").alias("to"), F.col("next").isNotNull().alias("on")))
        moving = step.where("on").count()
        step = step.select("doc_id", "path", "to")
        if moving in (0, last):  # what still moves stands in or leads into a circle
            break
        last = moving
    ends = docs.where(F.col("value").isNull() | ~ref).select("doc_id", F.col("path").alias("to"), F.col("value").alias("end"))
    found = step.join(ends, ["doc_id", "to"], "left").select("doc_id", "path", F.col("end").alias("value"))
    return docs.where(F.col("value").isNull() | ~ref).select("doc_id", "path", "value").union(found)
