"""The coercion kernel: every function's view of text, numbers and truth, as Column expressions.

Values that are no Column are literals. ``kind`` says what a column holds where Spark's Column can't:
"string" (default for text), "double", "long", "boolean", "date", "timestamp".
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NUMBER = r"^\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)"


def col(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def text(x, kind: str = "string") -> Column:
    """Text of a value: null is empty, whole numbers have no fraction, dates are ISO."""
    c = col(x)
    if kind in ("double", "float"):
        whole = (c == F.floor(c)) & (F.abs(c) < 1e18)
        c = F.when(whole, F.floor(c).cast("long").cast("string")).otherwise(c.cast("string"))
    elif kind == "date":
        c = F.date_format(c, "yyyy-MM-dd")
    elif kind == "timestamp":
        c = F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    return F.coalesce(c.cast("string"), F.lit(""))


def number(x, kind: str = "string") -> Column:
    """Number of a value: null and what doesn't begin with a number are 0."""
    c = col(x)
    if kind == "boolean":
        c = c.cast("int").cast("double")
    elif kind in ("date", "timestamp"):
        c = F.unix_millis(c.cast("timestamp")).cast("double")
    elif kind == "string":
        c = F.regexp_extract(c.cast("string"), NUMBER, 1).try_cast("double")
    else:
        c = c.cast("double")
    return F.coalesce(c, F.lit(0.0))


def truth(x, kind: str = "string") -> Column:
    """Truth as functions see it: of texts only true, yes, y and 1; of numbers all but 0."""
    c = col(x)
    if kind == "boolean":
        return F.coalesce(c, F.lit(False))
    if kind == "string":
        return F.coalesce(F.lower(c.cast("string")).isin("true", "yes", "y", "1"), F.lit(False))
    if kind in ("date", "timestamp"):
        return c.isNotNull()
    if kind == "array":
        return F.coalesce(F.size(c) > 0, F.lit(False))
    return F.coalesce(c.cast("double") != 0, F.lit(False))


def condition(x, kind: str = "string") -> Column:
    """Truth as conditions of segments and fields see it: any text that isn't empty."""
    return F.coalesce(F.length(col(x)) > 0, F.lit(False)) if kind == "string" else truth(x, kind)


def snapped(x) -> Column:
    """A numeric result: what is within 1e-10 of a whole number becomes it."""
    c = col(x).cast("double")
    whole = F.floor(c + 0.5)
    return F.when((F.abs(c - whole) < 1e-10) & (F.abs(c) < 1e15) & ((F.abs(c) >= 1e-9) | (c == 0)), whole.cast("double")).otherwise(c)


def finite(x) -> Column:
    """Null for what isn't a finite number."""
    c = col(x).cast("double")
    return F.when(~F.isnan(c) & (F.abs(c) < float("inf")), c)
