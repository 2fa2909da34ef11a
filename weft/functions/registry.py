"""Functions by the names that programs use: a compiler from typed arguments to a typed Column, and the arity."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import arrays as A
from . import dates as D
from . import generate as G
from . import scalar as S
from .coerce import number, snapped, text, truth


@dataclass
class Typed:
    """A Column, what it holds, the literal it is, if it is one, and whether it is an array of objects, if that is known."""

    column: Column
    kind: str = "string"
    literal: object = None
    objects: bool = True


@dataclass
class Function:
    name: str
    arity: int  # -1: takes all that follows
    build: Callable
    least: int


FUNCTIONS: dict[str, Function] = {}


def register(name: str, build: Callable, arity: int, least: int | None = None) -> None:
    """build(*Typed) -> Typed."""
    FUNCTIONS[name] = Function(name, arity, build, arity if least is None else least)


def _t(x: Typed) -> Column:
    return text(x.column, x.kind)


def _n(x: Typed) -> Column:
    return number(x.column, x.kind)


def _b(x: Typed) -> Column:
    return truth(x.column, x.kind)


def _lit(x: Typed):
    if x.literal is None:
        raise ValueError("this argument must be a literal")
    return x.literal


def _text(fn, n, least=None):
    return (lambda *a: Typed(fn(*[_t(x) for x in a]), "string")), n, least


def _texts():
    one = {
        "upper": F.upper, "lower": F.lower, "trim": S.trim, "trimLeft": S.trim_left, "trimRight": S.trim_right, "capitalize": S.capitalize, "titleCase": S.title_case,
        "reverseString": F.reverse, "camelCase": S.camel_case, "snakeCase": S.snake_case, "kebabCase": S.kebab_case, "pascalCase": S.pascal_case, "slugify": S.slugify,
        "normalizeSpace": S.normalize_space, "stripAccents": S.strip_accents, "clean": S.clean, "soundex": S.soundex, "escapeHtml": S.escape_html, "unescapeHtml": S.unescape_html,
        "escapeXml": S.escape_xml, "stripTags": S.strip_tags, "base64Encode": S.base64, "base64Decode": S.base64_decode, "base64urlEncode": S.base64url, "base64urlDecode": S.base64_decode,
        "urlEncode": S.url_encode, "urlDecode": S.url_decode, "hexEncode": S.hex_encode, "md5": F.md5, "sha1": F.sha1, "crc32": S.crc32,
    }
    for name, fn in one.items():
        register(name, lambda a, fn=fn: Typed(fn(_t(a)), "string"), 1)
    register("sha256", lambda a: Typed(F.sha2(_t(a), 256)), 1)
    register("sha512", lambda a: Typed(F.sha2(_t(a), 512)), 1)
    register("hexDecode", lambda a: Typed(F.when(F.regexp_like(_t(a), F.lit("^([0-9a-fA-F]{2})*$")), F.decode(F.unhex(_t(a)), "ISO-8859-1"))), 1)
    register("hmac", lambda a, k, alg=None: Typed(S.hmac(_t(a), _lit(k), _lit(alg) if alg else "sha256")), 3, 2)
    register("concat", lambda *a: Typed(F.concat(*[_t(x) for x in a])), -1, 1)
    register("length", lambda a: Typed(F.length(_t(a)).cast("long"), "long"), 1)
    register("wordCount", lambda a: Typed(S.word_count(_t(a)).cast("long"), "long"), 1)
    register("levenshtein", lambda a, b: Typed(S.levenshtein(_t(a), _t(b)).cast("long"), "long"), 2)
    for name, fn in {"contains": F.contains, "startsWith": F.startswith, "endsWith": F.endswith}.items():
        register(name, lambda a, b, fn=fn: Typed(fn(_t(a), _t(b)), "boolean"), 2)
    register("substring", lambda a, i, n: Typed(S.substring(_t(a), _n(i).cast("int"), _n(n).cast("int"))), 3)
    register("replace", lambda a, b, c: Typed(S.replace(_t(a), _t(b), _t(c))), 3)
    register("replaceRegex", lambda a, p, r: Typed(S.replace_regex(_t(a), _lit(p), _lit(r))), 3)
    for name, fn in {"padLeft": S.pad_left, "padRight": S.pad_right, "pad": S.pad_right, "center": S.center}.items():
        register(name, lambda a, n, c=None, fn=fn: Typed(fn(_t(a), _n(n), _t(c) if c else " ")), 3, 2)
    register("truncate", lambda a, n, *_: Typed(S.truncate(_t(a), _n(n))), 3, 2)
    register("split", lambda a, d, i=None: Typed(S.split(_t(a), _lit(d), _n(i).cast("int") if i else 0)), 3, 2)
    register("join", lambda a, d: Typed(S.join(a.column, _lit(d))), 2)
    register("mask", lambda a, p: Typed(S.mask(_t(a), _lit(p))), 2)
    register("repeat", lambda a, n: Typed(S.repeat(_t(a), _n(n))), 2)
    for name in ("match", "matches"):
        register(name, lambda a, p: Typed(S.matches(_t(a), _lit(p)), "boolean"), 2)
    register("extract", lambda a, p, g=None: Typed(S.extract(_t(a), _lit(p), int(_lit(g)) if g else 0)), 3, 2)
    register("leftOf", lambda a, d: Typed(S.left_of(_t(a), _lit(d))), 2)
    register("rightOf", lambda a, d: Typed(S.right_of(_t(a), _lit(d))), 2)
    register("wrap", lambda a, n: Typed(S.wrap(_t(a), int(_lit(n)))), 2)
    register("tokenize", lambda a, d=None: Typed(S.tokenize(_t(a), _lit(d) if d else None), "array"), 2, 1)
    register("formatPhone", lambda a, c: Typed(S.format_phone(_t(a), _lit(c))), 2)
    register("jsonPath", lambda a, p: Typed(S.json_path(_t(a), _lit(p))), 2)
    register("parseUrl", lambda a: Typed(S.parse_url(_t(a)), "object"), 1)
    register("parseQuery", lambda a: Typed(S.parse_query(_t(a)), "object"), 1)
    register("jsonEncode", lambda a: Typed(S.json_text(a.column, a.kind)), 1)
    register("jsonDecode", lambda a: Typed(S.json_decode(_t(a)), "variant"), 1)
    register("stableStringify", lambda a: Typed(S.stable_json(a.column, a.kind)), 1)
    register("canonicalHash", lambda a: Typed(F.sha2(S.stable_json(a.column, a.kind), 256)), 1)
    register("tryCoerce", lambda a: Typed(S.try_coerce(_t(a)), "variant") if a.kind == "string" else a, 1)
    register("buildQuery", lambda a: Typed(S.build_query(a.column)), 1)
    register("buildUrl", lambda a: Typed(S.build_url(a.column)), 1)
    register("template", lambda p, *a: Typed(F.concat(*[x for k, part in enumerate(_lit(p).split("{}")) for x in ([F.lit(part)] if k == 0 else [_t(a[k - 1]) if k <= len(a) else F.lit(""), F.lit(part)])])), -1, 1)
    register("nanoid", lambda n=None, s=None: Typed(G.nanoid(21 if n is None or n.kind == "string" else _n(n), s.column if s else n.column if n and n.kind == "string" else None)), 2, 0)


def _numbers():
    one = {
        "abs": F.abs, "floor": F.floor, "ceil": F.ceil, "negate": lambda x: -x, "sign": F.signum, "trunc": S.trunc, "exp": F.exp, "ln": S.log, "log10": S.log10, "sqrt": S.sqrt,
        "toRadians": F.radians, "toDegrees": F.degrees, "coerceNumber": lambda x: x, "coerceInteger": F.floor, "factorial": S.factorial,
    }
    for name, fn in one.items():
        register(name, lambda a, fn=fn: Typed(snapped(fn(_n(a))), "double"), 1)
    two = {
        "add": lambda a, b: a + b, "subtract": lambda a, b: a - b, "multiply": lambda a, b: a * b, "divide": S.divide, "mod": S.mod, "pow": S.pow_, "gcd": S.gcd, "lcm": S.lcm,
    }
    for name, fn in two.items():
        register(name, lambda a, b, fn=fn: Typed(snapped(fn(_n(a), _n(b))), "double"), 2)
    many = {
        "compound": (S.compound, 3), "discount": (S.discount, 3), "pmt": (S.pmt, 3), "fv": (S.fv, 3), "pv": (S.pv, 3), "depreciation": (S.depreciation, 3), "clamp": (S.clamp, 3), "safeDivide": (S.safe_divide, 3),
        "interpolate": (S.interpolate, 5), "bearing": (S.bearing, 4),
    }
    for name, (fn, n) in many.items():
        register(name, lambda *a, fn=fn: Typed(fn(*[_n(x) for x in a]), "double"), n)
    register("log", lambda a, b=None: Typed(S.log(_n(a), _n(b) if b else None), "double"), 2, 1)
    register("round", lambda a, d: Typed(S.round_(_n(a), int(_lit(d))), "double"), 2)
    register("formatNumber", lambda a, d: Typed(S.fixed(_n(a), int(_lit(d)))), 2)
    register("formatCurrency", lambda a: Typed(S.fixed(_n(a), 2)), 1)
    register("formatInteger", lambda a: Typed(F.floor(_n(a)).cast("string")), 1)
    register("formatPercent", lambda a, d: Typed(S.format_percent(_n(a), int(_lit(d)))), 2)
    register("minOf", lambda *a: Typed(S.min_of(*[_n(x) for x in a]) if len(a) > 1 else _n(a[0]), "double"), -1, 1)
    register("maxOf", lambda *a: Typed(S.max_of(*[_n(x) for x in a]) if len(a) > 1 else _n(a[0]), "double"), -1, 1)
    register("isFinite", lambda a: Typed(S.is_finite(a.column) if a.kind != "string" else F.lit(False), "boolean"), 1)
    register("isNaN", lambda a: Typed(F.isnan(_n(a)), "boolean"), 1)
    register("parseInt", lambda a, r=None: Typed(S.parse_int(_t(a), int(_lit(r)) if r else 10), "long"), 2, 1)
    register("convertUnit", lambda a, u, v: Typed(S.convert_unit(a.column if a.kind == "decimal" else _n(a), _lit(u), _lit(v), a.kind), "double"), 3)
    register("distance", lambda a, b, c, d, u=None: Typed(S.distance(_n(a), _n(b), _n(c), _n(d), _lit(u) if u else "km"), "double"), 5, 4)
    register("inBoundingBox", lambda *a: Typed(S.in_box(*[_n(x) for x in a]), "boolean"), 6)
    register("midpoint", lambda *a: Typed(S.midpoint(*[_n(x) for x in a]), "object"), 4)
    register("nper", lambda r, p, v, *_: Typed(S.nper(_n(r), _n(p), _n(v)), "double"), 4, 3)

    def random(*a):
        if len(a) == 1 and a[0].kind == "string":
            return Typed(G.random(seed=_t(a[0])), "double")
        low, high = (_n(a[0]), _n(a[1])) if len(a) > 1 else (F.lit(0.0), _n(a[0])) if a else (None, None)
        return Typed(G.random(low, high, _t(a[2]) if len(a) > 2 else None), "double")

    register("random", random, 3, 0)
    register("uuid", lambda a=None: Typed(G.uuid(_t(a) if a else None)), 1, 0)
    register("formatLocaleNumber", lambda a, loc=None: Typed(D.locale_number(_n(a), _lit(loc) if loc else D.DEFAULT_LOCALE)), 2, 1)
    register("rate", lambda *a: Typed(S.rate(*[_n(x) for x in a]), "double"), 4)


def _same(*xs):
    """The kind that branches share: their own, or text."""
    kinds = {x.kind for x in xs if x.kind != "null"}
    kind = kinds.pop() if len(kinds) == 1 else "double" if kinds <= {"double", "long"} and kinds else "string"
    as_ = (lambda x: x.column.cast(kind) if kind in ("double", "long") else x.column) if len({x.kind for x in xs if x.kind != "null"}) <= 1 or kind == "double" else lambda x: F.when(x.column.isNotNull(), _t(x))
    return kind, as_


def _conditions():
    register("and", lambda a, b: Typed(_b(a) & _b(b), "boolean"), 2)
    register("or", lambda a, b: Typed(_b(a) | _b(b), "boolean"), 2)
    register("xor", lambda a, b: Typed(_b(a) != _b(b), "boolean"), 2)
    register("not", lambda a: Typed(~_b(a), "boolean"), 1)

    def equal(a, b):
        if a.kind == b.kind:
            return a.column.eqNullSafe(b.column)
        if {a.kind, b.kind} <= {"double", "long"}:
            return a.column.cast("double").eqNullSafe(b.column.cast("double"))
        return (a.column.isNull() == b.column.isNull()) & (_t(a) == _t(b))

    register("eq", lambda a, b: Typed(equal(a, b), "boolean"), 2)
    register("ne", lambda a, b: Typed(~equal(a, b), "boolean"), 2)
    for name, op in {"lt": "__lt__", "lte": "__le__", "gt": "__gt__", "gte": "__ge__"}.items():
        register(name, lambda a, b, op=op: Typed(getattr(_t(a), op)(_t(b)) if a.kind == b.kind == "string" else getattr(_n(a), op)(_n(b)), "boolean"), 2)
    register("between", lambda a, b, c: Typed((_n(a) >= _n(b)) & (_n(a) <= _n(c)), "boolean"), 3)
    register("isNull", lambda a: Typed(a.column.isNull(), "boolean"), 1)
    for name, kinds in {"isString": ("string",), "isNumber": ("double", "long"), "isBoolean": ("boolean",), "isArray": ("array",), "isObject": ("object",), "isDate": ("date", "timestamp")}.items():
        register(name, lambda a, kinds=kinds: Typed(a.column.isNotNull() & F.lit(a.kind in kinds), "boolean"), 1)
    register("typeOf", lambda a: Typed(F.when(a.column.isNull(), "null").otherwise({"double": "number", "long": "integer"}.get(a.kind, a.kind))), 1)
    register("coerceString", lambda a: Typed(_t(a)), 1)
    register("coerceBoolean", lambda a: Typed(_b(a), "boolean"), 1)
    register("coerceDate", lambda a: Typed(S.coerce_date(_t(a)), "date"), 1)
    register("assert", lambda a, m=None: Typed(F.when(_b(a), a.column), a.kind), 2, 1)

    def coalesce(*a):
        kind, as_ = _same(*a)
        return Typed(F.coalesce(*[as_(x) for x in a]), kind)

    register("coalesce", coalesce, -1, 1)
    register("ifNull", coalesce, 2)

    def if_empty(a, b):
        kind, as_ = _same(a, b)
        return Typed(F.when(_t(a) == "", F.when(a.column.isNotNull(), as_(b))).otherwise(as_(a)), kind)

    register("ifEmpty", if_empty, 2)

    def if_else(c, a, b):
        kind, as_ = _same(a, b)
        return Typed(F.when(_b(c), as_(a)).otherwise(as_(b)), kind)

    register("ifElse", if_else, 3)

    def cond(*a):
        values = [x for k, x in enumerate(a) if k % 2 or k == len(a) - 1]
        kind, as_ = _same(*values)
        out = F
        for k in range(0, len(a) - 1, 2):
            out = out.when(_b(a[k]), as_(a[k + 1]))
        return Typed(out.otherwise(as_(a[-1]) if len(a) % 2 else F.lit(None)), kind)

    register("cond", cond, -1, 1)

    def switch(x, *a):
        values = [v for k, v in enumerate(a) if k % 2 or k == len(a) - 1]
        kind, as_ = _same(*values)
        out = F
        for k in range(0, len(a) - 1, 2):
            out = out.when(_t(x) == _t(a[k]), as_(a[k + 1]))
        return Typed(out.otherwise(as_(a[-1]) if len(a) % 2 else F.lit(None)), kind)

    register("switch", switch, -1, 1)


def _dates():
    day = lambda a: a.column if a.kind in ("date", "timestamp") else S.coerce_date(_t(a))
    moment = lambda a: a.column.cast("timestamp") if a.kind in ("date", "timestamp") else D.moment(_t(a))
    register("formatDate", lambda a, p: Typed(D.formatted(day(a), _lit(p))), 2)
    for name in ("formatTime", "formatTimestamp"):
        register(name, lambda a, p: Typed(D.formatted(moment(a), _lit(p))), 2)
    register("parseDate", lambda a, p: Typed(D.parse_date(_t(a), _lit(p))), 2)
    register("parseTimestamp", lambda a, p: Typed(D.parse_timestamp(_t(a), _lit(p))), 2)
    register("isValidDate", lambda a, p: Typed(D.is_valid(_t(a), _lit(p)), "boolean"), 2)
    register("formatDuration", lambda a: Typed(D.duration(a.column, a.kind)), 1)
    register("formatLocaleDate", lambda a, loc=None: Typed(D.locale_date(day(a), _lit(loc) if loc else D.DEFAULT_LOCALE)), 2, 1)
    register("coerceTimestamp", lambda a: Typed(a.column.cast("timestamp") if a.kind in ("date", "timestamp") else F.coalesce(D.moment(_t(a)), S.coerce_date(_t(a)).cast("timestamp")), "timestamp"), 1)
    register("today", lambda: Typed(F.current_date(), "date"), 0)
    register("now", lambda: Typed(F.current_timestamp(), "timestamp"), 0)
    for name, fn in {"addDays": S.add_days, "addMonths": S.add_months, "addYears": S.add_years}.items():
        register(name, lambda a, n, fn=fn: Typed(fn(day(a), _n(n))), 2)
    for name, unit in {"addHours": 3600.0, "addMinutes": 60.0, "addSeconds": 1.0}.items():
        register(name, lambda a, n, unit=unit: Typed(S.add_seconds(day(a), _n(n), unit)), 2)
    register("dateDiff", lambda a, b, u: Typed(S.date_diff(day(a), day(b), _lit(u)), "long"), 3)
    register("daysBetweenDates", lambda a, b: Typed(S.date_diff(day(a), day(b)), "long"), 2)
    dates = {
        "startOfDay": lambda d: F.date_trunc("day", d), "endOfDay": S.end_of_day, "startOfMonth": lambda d: F.trunc(d, "MM"), "endOfMonth": F.last_day, "startOfYear": lambda d: F.trunc(d, "YYYY"),
        "endOfYear": lambda d: F.make_date(F.year(d), F.lit(12), F.lit(31)), "nextBusinessDay": S.next_business_day,
    }
    for name, fn in dates.items():
        register(name, lambda a, fn=fn, kind="timestamp" if "Day" in name and "Business" not in name else "date": Typed(fn(day(a)), kind), 1)
    for name, fn in {"dayOfWeek": lambda d: F.weekday(d) + 1, "weekOfYear": F.weekofyear, "quarter": F.quarter}.items():
        register(name, lambda a, fn=fn: Typed(fn(day(a)).cast("long"), "long"), 1)
    register("isLeapYear", lambda a: Typed(S.is_leap_year(day(a)), "boolean"), 1)
    register("isBefore", lambda a, b: Typed(day(a) < day(b), "boolean"), 2)
    register("isAfter", lambda a, b: Typed(day(a) > day(b), "boolean"), 2)
    register("isBetween", lambda a, b, c: Typed(day(a).between(day(b), day(c)), "boolean"), 3)
    register("toUnix", lambda a: Typed(F.unix_seconds(day(a).cast("timestamp")), "long"), 1)
    register("fromUnix", lambda a: Typed(S.from_unix(_n(a))), 1)
    register("businessDays", lambda a, n: Typed(S.business_days(day(a), _n(n)), "date"), 2)
    register("ageFromDate", lambda a, b=None: Typed(S.age(day(a), day(b) if b else F.current_date()), "long"), 2, 1)


def _arrays():
    one = {"sum": A.sum_, "min": A.min_, "max": A.max_, "avg": A.avg, "std": A.std, "variance": A.variance, "median": A.median, "stdSample": lambda a: A.std(a, True), "varianceSample": lambda a: A.variance(a, True), "irr": S.irr}
    for name, fn in one.items():
        register(name, lambda a, fn=fn: Typed(fn(a.column), "double"), 1)
    register("count", lambda a: Typed(A.count(a.column), "long"), 1)
    for name, fn in {"first": A.first, "last": A.last, "mode": A.mode}.items():
        register(name, lambda a, fn=fn: Typed(fn(a.column)), 1)
    for name, fn in {"flatten": A.flatten, "distinct": A.distinct, "unique": A.distinct, "sort": A.sort, "sortDesc": lambda a: A.sort(a, True), "reverse": A.reverse, "compact": A.compact, "cumsum": A.cumsum, "cumprod": A.cumprod, "zscore": A.zscore}.items():
        register(name, lambda a, fn=fn: Typed(fn(a.column), "array"), 1)
    for name, fn in {"union": A.union, "intersection": A.intersection, "difference": A.difference, "symmetricDifference": A.symmetric_difference, "concatArrays": A.concat_arrays, "zip": A.zip_}.items():
        register(name, lambda a, b, fn=fn: Typed(fn(a.column, b.column), "array"), 2)
    for name, fn in {"take": A.take, "limit": A.take, "drop": A.drop}.items():
        register(name, lambda a, n, fn=fn: Typed(fn(a.column, int(_lit(n))), "array"), 2)
    for name, fn in {"chunk": A.chunk, "window": A.window, "movingAvg": A.moving_avg}.items():
        register(name, lambda a, n, fn=fn: Typed(fn(a.column, int(_lit(n))), "array"), 2)
    for name, fn in {"lag": A.lag, "lead": A.lead, "shift": A.shift}.items():
        register(name, lambda a, n=None, d=None, fn=fn: Typed(fn(a.column, int(_lit(n)) if n else 1, _lit(d) if d else None), "array"), 3, 1)
    for name, fn in {"diff": A.diff, "pctChange": A.pct_change}.items():
        register(name, lambda a, n=None, fn=fn: Typed(fn(a.column, int(_lit(n)) if n else 1), "array"), 2, 1)
    for name, fn in {"map": 0, "pluck": 0}.items():
        register(name, lambda a, f: Typed(F.transform(a.column, lambda x: x[_lit(f)]), "array"), 2)
    for name, fn in {"filter": A.filter_, "every": A.every, "some": A.some, "find": A.find, "findIndex": A.find_index, "partition": A.partition, "countIf": A.count_if}.items():
        kind = {"every": "boolean", "some": "boolean", "findIndex": "long", "countIf": "long", "find": "object"}.get(name, "array")
        register(name, lambda a, f, op, v, fn=fn, kind=kind: Typed(fn(a.column, lambda x: x[_lit(f)], _lit(op), _lit(v)), kind), 4)
    for name, fn in {"sumIf": A.sum_if, "avgIf": A.avg_if}.items():
        register(name, lambda a, f, op, v, s=None, fn=fn: Typed(fn(a.column, lambda x: x[_lit(f)], _lit(op), _lit(v), (lambda x: x[_lit(s)]) if s else None), "double"), 5, 4)
    for name, fn in {"sortBy": A.sort_by, "dedupe": A.dedupe, "groupBy": A.group_by}.items():
        register(name, lambda a, f, fn=fn: Typed(fn(a.column, lambda x: x[_lit(f)]), "array"), 2)
    register("keyBy", lambda a, f: Typed(A.key_by(a.column, lambda x: x[_lit(f)]), "object"), 2)
    register("pivot", lambda a, k, v: Typed(A.pivot(a.column, lambda x: x[_lit(k)], lambda x: x[_lit(v)]), "object"), 3)
    register("countBy", lambda a, f=None: Typed(A.count_by(a.column, (lambda x: x[_lit(f)]) if f else (lambda x: x)), "object"), 2, 1)
    register("indexOf", lambda a, v: Typed(A.index_of(a.column, _t(v)), "long"), 2)
    register("includes", lambda a, v: Typed(A.includes(a.column, _t(v)), "boolean"), 2)
    register("at", lambda a, i: Typed(A.at(a.column, _n(i).cast("int"))), 2)
    register("slice", lambda a, i, j: Typed(A.slice_(a.column, _n(i).cast("int"), _n(j).cast("int")), "array"), 3)
    register("percentile", lambda a, p: Typed(A.percentile(a.column, float(_lit(p))), "double"), 2)
    register("quantile", lambda a, p: Typed(A.quantile(a.column, float(_lit(p))), "double"), 2)
    for name, fn in {"covariance": A.covariance, "correlation": A.correlation, "weightedAvg": A.weighted_avg}.items():
        register(name, lambda a, b, fn=fn: Typed(fn(a.column, b.column), "double"), 2)
    register("npv", lambda r, a: Typed(S.npv(_n(r), a.column), "double"), 2)
    days = lambda a: F.transform(a.column, lambda d: F.datediff(d.try_cast("date"), F.get(a.column, 0).try_cast("date")).cast("double"))
    register("xnpv", lambda r, a, d: Typed(S.xnpv(_n(r), a.column, days(d)), "double"), 3)
    register("xirr", lambda a, d, g=None: Typed(S.xirr(a.column, days(d), float(_lit(g)) if g else 0.1), "double"), 3, 2)
    register("rank", lambda a, *_: Typed(A.rank(a.column), "array"), 3, 1)
    register("range", lambda a, b, s=None: Typed(A.range_(int(_lit(a)), int(_lit(b)), int(_lit(s)) if s else 1), "array"), 3, 2)
    register("fillMissing", lambda a, v=None, s=None: Typed(A.fill_missing(a.column, _lit(s) if s else "value", _lit(v) if v else 0), "array"), 3, 1)
    register("toArray", lambda a: Typed(a.column if a.kind == "array" else F.when(a.column.isNull(), F.array()).otherwise(F.array(a.column)), "array"), 1)
    register("rowNumber", lambda a: Typed(A.row_number(a.column, a.objects), "array"), 1)
    register("explode", lambda a, f: Typed(A.explode(a.column, _lit(f)), "array"), 2)
    register("sample", lambda a, n, s=None: Typed(A.sample(a.column, int(_lit(n)), None if s is None else int(_lit(s))), "array"), 3, 2)
    register("reduce", lambda a, f, z: Typed(F.aggregate(A.numbers(a.column), _n(z), lambda s, x: _n(FUNCTIONS[_lit(f)].build(Typed(s, "double"), Typed(x, "double")))), "double"), 3)


def _objects():
    for name, fn in {"keys": A.keys, "values": A.values, "entries": A.entries}.items():
        register(name, lambda a, fn=fn: Typed(fn(a.column), "array"), 1)
    for name, fn in {"merge": A.merge, "defaults": A.defaults}.items():
        register(name, lambda a, b, fn=fn: Typed(fn(a.column, b.column), "object"), 2)
    for name, fn in {"invert": A.invert, "compactObject": A.compact_object, "fromEntries": A.from_entries, "toObject": A.from_entries}.items():
        register(name, lambda a, fn=fn: Typed(fn(a.column), "object"), 1)
    for name, fn in {"pick": A.pick, "omit": A.omit}.items():
        register(name, lambda a, *k, fn=fn: Typed(fn(a.column, *[_lit(x) for x in k]), "object"), -1, 1)
    register("renameKeys", lambda a, *k: Typed(A.rename_keys(a.column, {_lit(x): _lit(y) for x, y in zip(k[::2], k[1::2])}), "object"), -1, 1)
    register("unpivot", lambda a, k=None, v=None: Typed(F.transform(F.map_entries(a.column), lambda e: F.struct(e["key"].alias(_lit(k) if k else "key"), e["value"].alias(_lit(v) if v else "value"))), "array"), 3, 1)
    register("has", lambda a, k: Typed(A.has(a.column, _lit(k)), "boolean"), 2)
    register("get", lambda a, k, d=None: Typed(A.get(a.column, _lit(k), _lit(d) if d else None)), 3, 2)


for _family in (_texts, _numbers, _conditions, _dates, _arrays, _objects):
    _family()

#: Functions of a user, by "namespace.name"; unknown ones give their first argument.
CUSTOM: dict[str, Callable] = {}
