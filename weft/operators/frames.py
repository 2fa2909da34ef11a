"""Relational forms: the same functions over rows rather than array items.

Order never comes from the rows' place: whatever depends on it takes the columns that order by.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.coerce import number, text

#: Bytes up to which a lookup table is broadcast; beyond it the join is left to the planner.
BROADCAST_BYTES = 64 << 20


def _names(by):
    return [by] if isinstance(by, (str, Column)) else list(by)


def spec(by=(), order=()):
    return Window.partitionBy(*_names(by)).orderBy(*_names(order))


def plan_bytes(df: DataFrame) -> int:
    """The optimizer's estimate of a plan's size: of files, their bytes."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


# ---- joins -----------------------------------------------------------------------------------------------


def lookup(df: DataFrame, table: DataFrame, on: dict, returns: dict, order, default=None) -> DataFrame:
    """Left join to the first row of ``table``, by ``order``, whose key columns equal the row's as text.

    on: table column -> column of df; returns: table column -> name of the result. A miss is ``default``.
    The table is broadcast if the planner's estimate of its bytes is small.
    """
    keys = list(on)
    first = table.withColumn("_n", F.row_number().over(spec([text(F.col(k)) for k in keys], order))).where("_n = 1")
    right = first.select(*[text(F.col(k)).alias(f"_k{i}") for i, k in enumerate(keys)], *[F.col(c).alias(f"_r{i}") for i, c in enumerate(returns)], F.lit(True).alias("_hit"))
    right = F.broadcast(right) if plan_bytes(table) <= BROADCAST_BYTES else right
    joined = df.join(right, [text(F.col(on[k])) == F.col(f"_k{i}") for i, k in enumerate(keys)], "left")
    out = [F.when(F.col("_hit"), F.col(f"_r{i}")).otherwise(F.lit(default)).alias(n) for i, n in enumerate(returns.values())]
    return joined.select(*[df[c] for c in df.columns], *out)


# ---- groups ----------------------------------------------------------------------------------------------


def totals(df: DataFrame, by, **measures) -> DataFrame:
    """measures: name=(function, column); what is null counts as 0 in sum, min, max and avg, and in count."""
    fns = {"sum": F.sum, "min": F.min, "max": F.max, "avg": F.avg}
    out = []
    for name, (fn, c) in measures.items():
        if fn == "count":
            out.append(F.count(F.lit(1)).alias(name))
        elif fn in fns:
            out.append(fns[fn](number(F.col(c) if isinstance(c, str) else c, "double")).alias(name))
        else:
            out.append(STATISTICS[fn](number(F.col(c) if isinstance(c, str) else c, "double")).alias(name))
    return df.groupBy(*_names(by)).agg(*out)


STATISTICS = {
    "std": F.stddev_pop, "stdSample": F.stddev_samp, "variance": F.var_pop, "varianceSample": F.var_samp,
    "median": lambda c: F.percentile(c, 0.5),
}


def percentile(c, p: float) -> Column:
    return F.percentile(number(c, "double"), p / 100)


def correlation(a, b) -> Column:
    """Null where either doesn't vary."""
    spread = F.stddev_pop(a) * F.stddev_pop(b)
    return F.when(spread > 0, F.covar_pop(a, b) / F.when(spread > 0, spread).otherwise(1.0))


def weighted_avg(v, w) -> Column:
    return F.try_divide(F.sum(number(v, "double") * number(w, "double")), F.sum(number(w, "double")))


def mode(df: DataFrame, by, value: str, order, name: str = "mode") -> DataFrame:
    """Each group's most frequent value; of equals the one that reaches the count first, by ``order``."""
    by = _names(by)
    counted = df.withColumn("_reached", F.row_number().over(spec([*by, value], order))).withColumn("_place", F.struct(*_names(order)))
    best = counted.groupBy(*by, value).agg(F.count(F.lit(1)).alias("_n"), F.max("_place").alias("_at"))
    return best.withColumn("_k", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("_n"), F.asc("_at")))).where("_k = 1").select(*by, F.col(value).alias(name))


def sum_if(pred: Column, c) -> Column:
    return F.coalesce(F.sum(F.when(pred, number(c, "double"))), F.lit(0.0))


def avg_if(pred: Column, c) -> Column:
    return F.avg(F.when(pred, number(c, "double")))


def count_by(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(text(F.col(key)).alias("key")).agg(F.count(F.lit(1)).alias("count"))


def partition(df: DataFrame, pred: Column) -> tuple[DataFrame, DataFrame]:
    pred = F.coalesce(pred, F.lit(False))
    return df.where(pred), df.where(~pred)


# ---- rows ------------------------------------------------------------------------------------------------


def distinct_by(df: DataFrame, keys, order) -> DataFrame:
    return df.withColumn("_n", F.row_number().over(spec(keys, order))).where("_n = 1").drop("_n")


def dedupe(df: DataFrame, key: str, order) -> DataFrame:
    """First row of each key; rows without the key all stay."""
    if any(not isinstance(o, str) or o not in df.columns for o in _names(order)):
        return df.withColumn("_n", F.row_number().over(spec(key, order))).where((F.col("_n") == 1) | F.col(key).isNull()).drop("_n")
    # the least row of each key is an aggregate, which combines before the shuffle: a hot key is no hot task
    first = df.where(F.col(key).isNotNull()).groupBy(F.xxhash64(key).alias("_h"), key).agg(F.min_by(F.struct(*df.columns), F.struct(*_names(order))).alias("_row"))
    return first.select("_row.*").union(df.where(F.col(key).isNull()))


def take(df: DataFrame, n: int, order) -> DataFrame:
    return df.orderBy(*_names(order)).limit(n)


def drop(df: DataFrame, n: int, order) -> DataFrame:
    return df.orderBy(*_names(order)).offset(n)


def top_per_group(df: DataFrame, by, order, n: int) -> DataFrame:
    return df.withColumn("_n", F.row_number().over(spec(by, order))).where(F.col("_n") <= n).drop("_n")


def symmetric_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.subtract(b).union(b.subtract(a))


def explode(df: DataFrame, c: str) -> DataFrame:
    """A row an item; rows without items stay, with a null item."""
    return df.withColumn(c, F.explode_outer(c))


def unpivot(df: DataFrame, ids, columns, key: str = "key", value: str = "value") -> DataFrame:
    return df.unpivot(_names(ids), _names(columns), key, value)


def pivot(df: DataFrame, by, key: str, value: str, order, keys=None) -> DataFrame:
    """Each group's last value of each key."""
    return df.groupBy(*_names(by)).pivot(key, keys).agg(F.max_by(value, F.struct(*_names(order))))


def chunk(df: DataFrame, by, order, n: int, name: str = "chunk") -> DataFrame:
    return df.withColumn(name, F.floor((F.row_number().over(spec(by, order)) - 1) / n))


def sample(df: DataFrame, n: int, seed: int, keys) -> DataFrame:
    """n rows drawn by a seeded hash of their keys: the same rows on any partitioning."""
    return df.orderBy(F.xxhash64(F.lit(seed), *_names(keys)), *_names(keys)).limit(n)


# ---- series ----------------------------------------------------------------------------------------------


def cumsum(c, by, order) -> Column:
    return F.sum(number(c, "double")).over(spec(by, order).rowsBetween(Window.unboundedPreceding, 0))


def cumprod(c, by, order) -> Column:
    return F.product(number(c, "double")).over(spec(by, order).rowsBetween(Window.unboundedPreceding, 0))


def shift(c, n: int, by, order, fill=None) -> Column:
    return F.lag(c, n, fill).over(spec(by, order)) if n >= 0 else F.lead(c, -n, fill).over(spec(by, order))


def diff(c, by, order, n: int = 1) -> Column:
    v = number(c, "double")
    return v - F.lag(v, n).over(spec(by, order))


def pct_change(c, by, order, n: int = 1) -> Column:
    v = number(c, "double")
    return F.try_divide(v - F.lag(v, n).over(spec(by, order)), F.lag(v, n).over(spec(by, order)))


def moving_avg(c, n: int, by, order) -> Column:
    return F.avg(number(c, "double")).over(spec(by, order).rowsBetween(-(n - 1), 0))


def zscore(df: DataFrame, c: str, by, name: str = "z") -> DataFrame:
    """``df`` with each row's distance from its group's mean, in standard deviations: the groups' moments are aggregated, which
    combines before the shuffle, and joined back, so few large groups are no few large tasks."""
    v = number(F.col(c), "double")
    moments = df.groupBy(*_names(by)).agg(F.avg(v).alias("_mean"), F.stddev_pop(v).alias("_std"))
    joined = df.alias("l").join(moments.alias("r"), [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in _names(by)])
    return joined.select("l.*", F.try_divide(number(F.col(f"l.{c}"), "double") - F.col("_mean"), F.nullif(F.col("_std"), F.lit(0.0))).alias(name))


def row_number(by, order) -> Column:
    return F.row_number().over(spec(by, order)).cast("long")


def rank(by, order) -> Column:
    return F.rank().over(spec(by, order)).cast("long")


def sequence(by, order, start: int = 1, step: int = 1) -> Column:
    return (F.row_number().over(spec(by, order)) - 1) * step + start


def sequence_with_resets(by, order, reset: Column, to: int, start: int = 1) -> Column:
    """Numbers from ``start`` on; a row where ``reset`` holds has ``to``, and those after it go on from there."""
    part = F.sum(F.coalesce(reset, F.lit(False)).cast("int")).over(spec(by, order).rowsBetween(Window.unboundedPreceding, 0))
    since = F.row_number().over(spec(by, order)) - F.coalesce(F.last(F.when(reset, F.row_number().over(spec(by, order))), ignorenulls=True).over(spec(by, order).rowsBetween(Window.unboundedPreceding, 0)), F.lit(1))
    return (since + F.when(part > 0, to).otherwise(start)).cast("long")


def accumulate(c, by, order) -> Column:
    return cumsum(c, by, order)


def set_last(c, by, order) -> Column:
    """The value an accumulator holds that each row sets."""
    return F.last(c).over(spec(by, order).rowsBetween(Window.unboundedPreceding, 0))


def fill_missing(c, strategy: str, by, order, value=0) -> Column:
    w = spec(by, order)
    if strategy == "forward":
        return F.coalesce(c, F.last(c, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    if strategy == "backward":
        return F.coalesce(c, F.first(c, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing)))
    if strategy == "mean":
        return F.coalesce(c, F.avg(c).over(Window.partitionBy(*_names(by))), F.lit(0.0))
    return F.coalesce(c, F.lit(value))


def windows(c, n: int, by, order) -> Column:
    """Complete windows of n rows that end here; null before."""
    w = spec(by, order).rowsBetween(-(n - 1), 0)
    return F.when(F.count(F.lit(1)).over(w) == n, F.collect_list(c).over(w))


def spread(df: DataFrame) -> DataFrame:
    """The rows dealt over as many tasks as shuffles have, and as there are cores at least. For work that takes long for a row: a file is read
    by as many tasks as it has row groups, and these may have a million rows. Streams stay as they are."""
    if df.isStreaming:
        return df
    session = df.sparkSession
    try:
        cores = session.sparkContext.defaultParallelism
    except Exception:  # a remote session has no context
        cores = 1
    return df.repartition(max(int(session.conf.get("spark.sql.shuffle.partitions")), cores))
