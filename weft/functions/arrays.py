"""Functions of array columns and of map columns (objects)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .coerce import col, number, text
from .generate import draw

OPERATORS = ("=", "==", "!=", "<", "<=", ">", ">=", "contains", "startsWith", "endsWith")


def test(x, op: str, value) -> Column:
    """A field against a literal, as filters and conditional aggregates compare; never null."""
    literal = isinstance(value, (int, float)) and not isinstance(value, bool)
    a, b = (number(x, "double"), F.lit(float(value))) if literal else (text(x), text(value))
    out = {
        "=": lambda: a == b, "==": lambda: a == b, "!=": lambda: a != b, "<": lambda: a < b, "<=": lambda: a <= b, ">": lambda: a > b, ">=": lambda: a >= b,
        "contains": lambda: F.contains(text(x), text(value)), "startsWith": lambda: F.startswith(text(x), text(value)), "endsWith": lambda: F.endswith(text(x), text(value)),
    }[op]()
    return F.coalesce(out, F.lit(False))


def item_text(x) -> Column:
    """Text of an array's item, whose kind only its type tells: of doubles as ``text`` gives it, so that it meets the text of a value."""
    return F.when(F.typeof(x).isin("double", "float"), text(x.cast("string").try_cast("double"), "double")).otherwise(text(x))


def let(value, fn) -> Column:
    """fn of a value that is evaluated once, also where fn uses it for each item of an array."""
    return F.get(F.transform(F.array(value), lambda x: fn(x)), 0)


# ---- aggregates of an array: what is no number counts as 0 ------------------------------------------------


def numbers(arr, kind="double") -> Column:
    return F.transform(arr, lambda x: number(x, kind))


def sum_(arr, kind="double") -> Column:
    return F.coalesce(F.aggregate(numbers(arr, kind), F.lit(0.0), lambda a, x: a + x), F.lit(0.0))


def count(arr) -> Column:
    return F.coalesce(F.size(arr), F.lit(0)).cast("long")


def min_(arr, kind="double") -> Column:
    return F.array_min(numbers(arr, kind))


def max_(arr, kind="double") -> Column:
    return F.array_max(numbers(arr, kind))


def avg(arr, kind="double") -> Column:
    return F.when(F.size(arr) > 0, sum_(arr, kind) / F.size(arr))


def first(arr) -> Column:
    return F.get(arr, 0)


def last(arr) -> Column:
    return F.get(arr, F.size(arr) - 1)


def count_if(arr, field, op, value) -> Column:
    return F.size(F.filter(arr, lambda x: test(field(x), op, value))).cast("long")


def sum_if(arr, field, op, value, summed=None) -> Column:
    return sum_(F.transform(F.filter(arr, lambda x: test(field(x), op, value)), summed or field))


def avg_if(arr, field, op, value, summed=None) -> Column:
    return avg(F.transform(F.filter(arr, lambda x: test(field(x), op, value)), summed or field))


def variance(arr, sample: bool = False) -> Column:
    v, n = numbers(arr), F.size(arr)
    mean = F.aggregate(v, F.lit(0.0), lambda a, x: a + x) / F.when(n > 0, n).otherwise(1)
    square = let(mean, lambda m: F.aggregate(v, F.lit(0.0), lambda a, x: a + (x - m) * (x - m)))
    return F.when(n >= 2, square / F.when(n >= 2, n - 1).otherwise(1)) if sample else F.when(n > 0, square / F.when(n > 0, n).otherwise(1))


def std(arr, sample: bool = False) -> Column:
    return F.sqrt(variance(arr, sample))


def quantile(arr, q: float) -> Column:
    v = F.sort_array(numbers(arr))
    at = (F.size(v) - 1) * q
    lo, hi = F.floor(at).cast("int"), F.ceil(at).cast("int")
    return F.when(F.size(v) > 0, F.get(v, lo) + (F.get(v, hi) - F.get(v, lo)) * (at - lo))


def median(arr) -> Column:
    return quantile(arr, 0.5)


def percentile(arr, p: float) -> Column:
    return quantile(arr, p / 100)


def mode(arr) -> Column:
    """The value of the greatest count; of several, the one that stands first. Equal values stand side by side once sorted, so one
    pass counts them."""
    sorted_ = F.sort_array(F.transform(arr, lambda x, i: F.struct(x.alias("v"), i.alias("i"))))
    nothing = F.struct(F.lit(0).alias("n"), F.lit(0).alias("first"), F.get(arr, 0).alias("v"))
    start = F.struct(nothing.alias("run"), nothing.alias("best"))

    def step(s, x):
        run = F.when((s["run"]["n"] > 0) & x["v"].eqNullSafe(s["run"]["v"]), F.struct((s["run"]["n"] + 1).alias("n"), s["run"]["first"].alias("first"), x["v"].alias("v"))).otherwise(F.struct(F.lit(1).alias("n"), x["i"].alias("first"), x["v"].alias("v")))
        return let(run, lambda r: F.struct(r.alias("run"), F.when((r["n"] > s["best"]["n"]) | ((r["n"] == s["best"]["n"]) & (r["first"] < s["best"]["first"])), r).otherwise(s["best"]).alias("best")))

    return F.when(F.size(arr) > 0, F.aggregate(sorted_, start, step)["best"]["v"])


def _paired(a, b):
    n = F.least(F.size(a), F.size(b))
    cut = lambda x: F.slice(numbers(x), 1, n)
    return cut(a), cut(b), n


def weighted_avg(values, weights) -> Column:
    v, w, _ = _paired(values, weights)
    total = F.aggregate(w, F.lit(0.0), lambda a, x: a + x)
    return F.when(total != 0, F.aggregate(F.zip_with(v, w, lambda x, y: x * y), F.lit(0.0), lambda a, x: a + x) / F.when(total != 0, total).otherwise(1.0))


def covariance(a, b) -> Column:
    x, y, n = _paired(a, b)
    mean = lambda v: F.aggregate(v, F.lit(0.0), lambda s, e: s + e) / n
    both = F.struct(mean(x).alias("x"), mean(y).alias("y"))
    return F.when(n > 0, let(both, lambda m: F.aggregate(F.zip_with(x, y, lambda p, q: (p - m["x"]) * (q - m["y"])), F.lit(0.0), lambda s, e: s + e)) / n)


def correlation(a, b) -> Column:
    x, y, n = _paired(a, b)
    spread = F.sqrt(variance(x) * variance(y))
    return F.when(spread > 0, covariance(x, y) / F.when(spread > 0, spread).otherwise(1.0))


# ---- selection and order ----------------------------------------------------------------------------------


def flatten(arr) -> Column:
    return F.flatten(arr)


def distinct(arr) -> Column:
    return F.array_distinct(arr)


def distinct_by(arr, field) -> Column:
    """The first item of each value of a field."""
    return F.filter(arr, lambda x, i: ~F.exists(F.slice(arr, 1, i), lambda y: text(field(y)) == text(field(x))))


def dedupe(arr, field) -> Column:
    """As distinct_by, but items without the field all stay."""
    return F.filter(arr, lambda x, i: field(x).isNull() | ~F.exists(F.slice(arr, 1, i), lambda y: field(y).eqNullSafe(field(x))))


def sort(arr, desc: bool = False) -> Column:
    return F.sort_array(arr, not desc)


def sort_by(arr, field, desc: bool = False) -> Column:
    keyed = F.transform(arr, lambda x, i: F.struct(field(x).alias("k"), (-i if desc else i).alias("i"), x.alias("v")))
    return F.transform(F.sort_array(keyed, not desc), lambda s: s["v"])


def index_of(arr, value) -> Column:
    return (F.array_position(F.transform(arr, item_text), text(value)) - 1).cast("long")


def at(arr, i) -> Column:
    k = col(i).cast("int")
    return F.get(arr, F.when(k < 0, F.size(arr) + k).otherwise(k))


def slice_(arr, start, end) -> Column:
    n = F.size(arr)
    place = lambda x: F.greatest(F.least(F.when(x < 0, n + x).otherwise(x), n), F.lit(0))
    a, b = place(col(start)), place(col(end))
    return F.slice(arr, a + 1, F.greatest(b - a, F.lit(0)))


def reverse(arr) -> Column:
    return F.reverse(arr)


def every(arr, field, op, value) -> Column:
    return F.forall(arr, lambda x: test(field(x), op, value))


def some(arr, field, op, value) -> Column:
    return F.exists(arr, lambda x: test(field(x), op, value))


def filter_(arr, field, op, value) -> Column:
    return F.filter(arr, lambda x: test(field(x), op, value))


def find(arr, field, op, value) -> Column:
    return F.get(filter_(arr, field, op, value), 0)


def find_index(arr, field, op, value) -> Column:
    return (F.array_position(F.transform(arr, lambda x: test(field(x), op, value)), True) - 1).cast("long")


def includes(arr, value) -> Column:
    return F.array_contains(F.transform(arr, item_text), text(value))


def concat_arrays(a, b) -> Column:
    return F.concat(a, b)


def zip_(a, b) -> Column:
    return F.slice(F.arrays_zip(a, b), 1, F.least(F.size(a), F.size(b)))


def partition(arr, field, op, value) -> Column:
    return F.array(filter_(arr, field, op, value), F.filter(arr, lambda x: ~test(field(x), op, value)))


def take(arr, n) -> Column:
    return F.when(col(n) >= 0, F.slice(arr, 1, F.greatest(col(n), F.lit(0)).cast("int")))


def drop(arr, n) -> Column:
    return F.slice(arr, F.greatest(col(n), F.lit(0)).cast("int") + 1, F.greatest(F.size(arr), F.lit(0)))


def chunk(arr, n: int) -> Column:
    if n <= 0:
        return F.lit(None)
    return F.when(F.size(arr) > 0, F.transform(F.sequence(F.lit(0), F.size(arr) - 1, F.lit(n)), lambda i: F.slice(arr, i + 1, n))).otherwise(F.array())


def range_(start: int, end: int, step: int = 1) -> Column:
    if step == 0:
        return F.lit(None)
    return F.array(*[F.lit(x) for x in range(start, end, step)][:10_000])


def compact(arr) -> Column:
    return F.filter(arr, lambda x: x.isNotNull() & (x.cast("string") != ""))


def intersection(a, b) -> Column:
    return F.array_intersect(a, b)


def union(a, b) -> Column:
    return F.array_union(a, b)


def difference(a, b) -> Column:
    return F.array_except(a, b)


def symmetric_difference(a, b) -> Column:
    return F.array_union(F.array_except(a, b), F.array_except(b, a))


# ---- series -----------------------------------------------------------------------------------------------


def cumulated(arr, by=lambda a, x: a + x) -> Column:
    v = numbers(arr)
    step = lambda s, x: F.array_append(s, F.when(F.size(s) == 0, x).otherwise(by(F.get(s, F.size(s) - 1), x)))
    return F.aggregate(v, F.array().cast("array<double>"), step)


def cumsum(arr) -> Column:
    return cumulated(arr)


def cumprod(arr) -> Column:
    return cumulated(arr, lambda a, x: a * x)


def shift(arr, n: int, fill=None) -> Column:
    return F.transform(arr, lambda x, i: F.when((i - n >= 0) & (i - n < F.size(arr)), F.get(arr, i - n)).otherwise(F.lit(fill)))


def lag(arr, n: int = 1, fill=None) -> Column:
    return shift(arr, n, fill)


def lead(arr, n: int = 1, fill=None) -> Column:
    return shift(arr, -n, fill)


def diff(arr, n: int = 1) -> Column:
    v = numbers(arr)
    return F.transform(v, lambda x, i: F.when(i >= n, x - F.get(v, i - n)))


def pct_change(arr, n: int = 1) -> Column:
    v = numbers(arr)
    return F.transform(v, lambda x, i: F.when((i >= n) & (F.get(v, i - n) != 0), (x - F.get(v, i - n)) / F.when((i >= n) & (F.get(v, i - n) != 0), F.get(v, i - n)).otherwise(1.0)))


def moving_avg(arr, n: int) -> Column:
    v = numbers(arr)
    return F.lit(None).cast("array<double>") if n < 1 else F.transform(v, lambda x, i: avg(F.slice(v, F.greatest(i - n + 2, F.lit(1)), F.least(i + 1, F.lit(n)))))


def zscore(arr) -> Column:
    v = numbers(arr)
    return let(F.struct(avg(v).alias("m"), std(v).alias("s")), lambda z: F.when(z["s"] > 0, F.transform(v, lambda x: (x - z["m"]) / F.when(z["s"] > 0, z["s"]).otherwise(1.0))))


def rank(arr, desc: bool = True) -> Column:
    """Competition ranks (1, 2, 2, 4), greatest first by default."""
    return F.transform(arr, lambda x: (F.size(F.filter(arr, lambda y: (y > x) if desc else (y < x))) + 1).cast("long"))


def window(arr, n: int) -> Column:
    return F.when(F.size(arr) >= n, F.transform(F.sequence(F.lit(1), F.size(arr) - n + 1), lambda i: F.slice(arr, i, n))).otherwise(F.array())


def fill_missing(arr, strategy: str = "value", value=0) -> Column:
    known = lambda part: F.filter(part, lambda y: y.isNotNull())
    if strategy == "forward":
        return F.transform(arr, lambda x, i: F.coalesce(x, F.get(known(F.slice(arr, 1, i + 1)), F.size(known(F.slice(arr, 1, i + 1))) - 1)))
    if strategy == "backward":
        return F.transform(arr, lambda x, i: F.coalesce(x, F.get(known(F.slice(arr, i + 1, F.size(arr))), 0)))
    if strategy == "mean":
        return let(avg(known(arr)), lambda m: F.transform(arr, lambda x: F.coalesce(x.cast("double"), m, F.lit(0.0))))
    return F.transform(arr, lambda x: F.coalesce(x, F.lit(value)))


def reduce(arr, fn, start) -> Column:
    return F.aggregate(arr, col(start), fn)


# ---- objects: maps of text to values ----------------------------------------------------------------------


def keys(m) -> Column:
    return F.map_keys(m)


def values(m) -> Column:
    return F.map_values(m)


def entries(m) -> Column:
    return F.map_entries(m)


def has(m, key) -> Column:
    return F.map_contains_key(m, key)


def get(m, key, default=None) -> Column:
    return F.when(F.map_contains_key(m, key), F.try_element_at(m, F.lit(key))).otherwise(F.lit(default))


def merge(a, b) -> Column:
    """The right side wins."""
    return F.map_concat(F.map_filter(a, lambda k, _: ~F.map_contains_key(b, k)), b)


def defaults(m, d) -> Column:
    return F.map_concat(m, F.map_filter(d, lambda k, _: ~F.map_contains_key(m, k)))


def pick(m, *names) -> Column:
    return F.map_filter(m, lambda k, _: k.isin(*names))


def omit(m, *names) -> Column:
    return F.map_filter(m, lambda k, _: ~k.isin(*names))


def from_entries(arr) -> Column:
    """Of equal keys the last wins."""
    last_ = F.filter(arr, lambda x, i: ~F.exists(F.slice(arr, i + 2, F.size(arr)), lambda y: y["key"] == x["key"]))
    return F.map_from_entries(last_)


def invert(m) -> Column:
    return from_entries(F.transform(F.map_entries(m), lambda e: F.struct(text(e["value"]).alias("key"), e["key"].alias("value"))))


def rename_keys(m, names: dict) -> Column:
    def renamed(k, _):
        out = k
        for a, b in names.items():
            out = F.when(k == a, b).otherwise(out)
        return out

    return F.transform_keys(m, renamed)


def compact_object(m) -> Column:
    return F.map_filter(m, lambda _, v: v.isNotNull() & (v.cast("string") != ""))


def key_by(arr, field) -> Column:
    return from_entries(F.transform(arr, lambda x: F.struct(text(field(x)).alias("key"), x.alias("value"))))


def pivot(arr, key, value) -> Column:
    kept = F.filter(arr, lambda x: key(x).isNotNull())
    return from_entries(F.transform(kept, lambda x: F.struct(text(key(x)).alias("key"), value(x).alias("value"))))


def unpivot(m) -> Column:
    return F.map_entries(m)


def count_by(arr, field=lambda x: x) -> Column:
    k = F.transform(arr, lambda x: text(field(x)))
    return F.map_from_entries(F.transform(F.array_sort(F.array_distinct(k)), lambda v: F.struct(v, F.size(F.filter(k, lambda y: y == v)))))


def group_by(arr, field) -> Column:
    """[{key, items}], keys in the order they are first seen."""
    k = F.array_distinct(F.transform(arr, lambda x: text(field(x))))
    return F.transform(k, lambda v: F.struct(v.alias("key"), F.filter(arr, lambda x: text(field(x)) == v).alias("items")))


def row_number(arr, objects: bool = True) -> Column:
    """Each item with its place from 1 on, as _rowNum; items that are no objects become one, as value."""
    if objects:
        return F.transform(arr, lambda x, i: x.withField("_rowNum", (i + 1).cast("long")))
    return F.transform(arr, lambda x, i: F.struct((i + 1).cast("long").alias("_rowNum"), x.alias("value")))


def explode(arr, field: str) -> Column:
    """An object for each item of each object's array field, which holds that item; null for an empty one."""
    one = lambda x: F.when(F.size(x[field]) > 0, F.transform(x[field], lambda e: x.withField(field, e))).otherwise(F.array(x.withField(field, F.get(x[field], 0))))
    return F.flatten(F.transform(arr, one))


def sample(arr, n: int, seed: int | None = None) -> Column:
    """n items without replacement, in the order drawn; all of them, as they stand, if there are no more."""
    def swap(k):
        def swapped(b):
            a, j = b["s"]["a"], b["j"]
            return F.struct(F.transform(a, lambda x, i: F.when(i == k, F.get(a, j)).when(i == j, F.get(a, k)).otherwise(x)).alias("a"))

        return swapped

    state = struct_of = F.struct(F.transform(arr, lambda x: x).alias("a"))
    for k in range(max(0, n)):
        u = draw(F.lit((seed or 0) & 0xFFFFFFFF), k + 1) if seed is not None else F.rand()
        j = (k + F.floor(u * (F.size(arr) - k))).cast("int")
        state = let(F.struct(state.alias("s"), j.alias("j")), swap(k))
    return F.when(F.size(arr) <= n, struct_of["a"]).otherwise(F.slice(state["a"], 1, max(0, n)) if n > 0 else F.slice(arr, 1, 0))
