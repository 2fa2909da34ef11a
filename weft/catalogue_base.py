"""What the query catalogues share: the registers, tables, and short forms for columns and functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .functions.registry import FUNCTIONS, Typed

C = F.col
QUERIES: dict = {}
ORACLE: dict = {}


def read(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def verb(name, *args):
    """A registered function applied to (column, kind) pairs and literals."""
    typed = [Typed(F.col(a[0]) if isinstance(a[0], str) else a[0]() if callable(a[0]) and not isinstance(a[0], Column) else a[0], a[1]) if isinstance(a, tuple) else Typed(F.lit(a), "string" if isinstance(a, str) else "long" if isinstance(a, int) else "double", a) for a in args]
    return FUNCTIONS[name].build(*typed).column


def query(name, sql):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLE[name] = sql
        return fn

    return add


def d(x):
    return F.round(x, 6)


_D = "CAST(o_orderdate AS DATE)"
_P, _CU, _O, _L, _E, _DOC, _PG = ("part", "p_partkey"), ("customer", "c_custkey"), ("orders", "o_orderkey"), ("lineitem", None), ("events", "event_id"), ("documents", "doc_id"), ("pages", "page_id")
_NAME, _KEY, _BAL, _DATE = ("p_name", "string"), ("c_custkey", "long"), ("c_acctbal", "double"), (lambda: F.col("o_orderdate").cast("date"), "date")
_SYL = "list_filter(string_split_regex(lower({}), '\\s+'), lambda x: x <> '')"


def add_scalars(rows: dict) -> None:
    """rows: name -> (table and key, Column, SQL expression or None)."""
    for name, ((table, key), fn, sql) in rows.items():
        QUERIES[name] = lambda s, p, t=table, k=key, f=fn: read(s, p, t).select(k, f().alias("value"))
        if sql:
            ORACLE[name] = f"SELECT {key}, {sql} AS value FROM {table}"


def add_arrays(rows: dict) -> None:
    """rows: name -> (Column over ``a``, SQL over ``a``); a: an embedding's values as doubles with 6 places."""
    for name, (fn, sql) in rows.items():
        QUERIES[name] = lambda s, p, f=fn: read(s, p, "embeddings").select("vec_id", _values().alias("a")).select("vec_id", f(C("a")).alias("value"))
        if sql:
            ORACLE[name] = f"SELECT vec_id, {sql} AS value FROM (SELECT vec_id, {_EMB} AS a FROM embeddings)"


_EMB = "list_transform(embedding, lambda x: round(CAST(x AS DOUBLE), 6))"


def _values():
    return F.transform(F.col("embedding"), lambda x: F.round(x.cast("double"), 6))
