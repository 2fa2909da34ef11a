"""The same aggregations over a stream as over a table; state is bounded by watermarks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _late(df: DataFrame, ts: str, late: str) -> DataFrame:
    return df.withWatermark(ts, late) if df.isStreaming else df


def tumbling(df: DataFrame, ts: str, width: str, by=(), late: str = "1 hour", **aggs) -> DataFrame:
    grouped = _late(df, ts, late).groupBy(F.window(ts, width), *by).agg(*[c.alias(n) for n, c in aggs.items()])
    return grouped.select(F.col("window.start").alias("start"), *by, *aggs)


def sliding(df: DataFrame, ts: str, width: str, step: str, by=(), late: str = "1 hour", **aggs) -> DataFrame:
    grouped = _late(df, ts, late).groupBy(F.window(ts, width, step), *by).agg(*[c.alias(n) for n, c in aggs.items()])
    return grouped.select(F.col("window.start").alias("start"), *by, *aggs)


def sessions(df: DataFrame, ts: str, gap: str, by=(), late: str = "1 hour", **aggs) -> DataFrame:
    grouped = _late(df, ts, late).groupBy(F.session_window(ts, gap), *by).agg(*[c.alias(n) for n, c in aggs.items()])
    return grouped.select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), *by, *aggs)


def replay(spark, path: str, schema, query, name: str, mode: str = "complete") -> DataFrame:
    """Runs ``query`` over the folder's files as a stream, to its end, and gives what it has put out."""
    out = query(spark.readStream.schema(schema).parquet(path))
    run = out.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.table(name)


def running(events: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """(key, order, total, number): the sum and count so far of each key, kept as state between batches; in a batch, rows go by
    ``order``. The state of a key is two numbers."""
    kinds = dict(events.dtypes)

    def step(name, batches, state):
        import pandas as pd

        total, number = state.get if state.exists else (0.0, 0)
        rows = pd.concat(list(batches)).sort_values(order, kind="stable")
        totals = rows[value].fillna(0).astype(float).cumsum() + total
        numbers = range(number + 1, number + 1 + len(rows))
        state.update((float(totals.iloc[-1]), number + len(rows)))
        yield pd.DataFrame({key: name[0], order: rows[order].to_numpy(), "total": totals.to_numpy(), "number": list(numbers)})

    out = f"`{key}` {kinds[key]}, `{order}` {kinds[order]}, total double, number long"
    return events.select(key, order, value).groupBy(key).applyInPandasWithState(step, out, "total double, number long", "append", "NoTimeout")
