"""Conditional, logical, string, numeric, date, encoding, financial and geographic functions of single values."""

from __future__ import annotations

import re
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

from .coerce import col, finite, number, snapped, text, truth


# ---- conditions ------------------------------------------------------------------------------------------


def concat(*xs) -> Column:
    return F.concat(*[text(x) for x in xs])


def if_empty(a, b) -> Column:
    return F.when(col(a) == "", col(b)).otherwise(col(a))


def if_else(c, a, b) -> Column:
    return F.when(c if isinstance(c, Column) else truth(c), col(a)).otherwise(col(b))


def cond(*xs) -> Column:
    out = None
    for k in range(0, len(xs) - 1, 2):
        out = (out or F).when(xs[k], col(xs[k + 1]))
    return out.otherwise(col(xs[-1]) if len(xs) % 2 else F.lit(None))


def switch(x, *xs) -> Column:
    return cond(*[text(x) == text(v) if k % 2 == 0 and k + 1 < len(xs) else v for k, v in enumerate(xs)])


def xor(a, b) -> Column:
    return truth(a) != truth(b)


def assert_(c, x=None) -> Column:
    return F.when(truth(c), col(c))


def eq(a, b) -> Column:
    return col(a).eqNullSafe(col(b))


def between(x, lo, hi, kind="double") -> Column:
    return (number(x, kind) >= number(lo, kind)) & (number(x, kind) <= number(hi, kind))


# ---- text ------------------------------------------------------------------------------------------------


def trim(x) -> Column:
    return F.regexp_replace(text(x), r"(?U)^\s+|\s+$", "")


def trim_left(x) -> Column:
    return F.regexp_replace(text(x), r"(?U)^\s+", "")


def trim_right(x) -> Column:
    return F.regexp_replace(text(x), r"(?U)\s+$", "")


def capitalize(x) -> Column:
    s = text(x)
    return F.concat(F.upper(F.substring(s, 1, 1)), F.lower(s.substr(F.lit(2), F.length(s))))


def title_case(x) -> Column:
    return F.array_join(F.transform(F.split(F.lower(text(x)), r"\s+"), capitalize), " ")


def substring(x, start, n) -> Column:
    s, at = text(x), F.greatest(col(start), F.lit(0))
    return s.substr((at + 1).cast("int"), F.greatest(col(n), F.lit(0)).cast("int"))


def replace(x, find, by) -> Column:
    return F.when(text(find) == "", text(x)).otherwise(F.replace(text(x), text(find), text(by)))


def _fill(x, n, ch, left: bool) -> Column:
    s, c = text(x), F.substring(text(ch), 1, 1)
    c = F.when(c == "", " ").otherwise(c)
    more = F.repeat(c, F.greatest(col(n).cast("int") - F.length(s), F.lit(0)))
    return F.concat(more, s) if left else F.concat(s, more)


def pad_left(x, n, ch=" ") -> Column:
    return _fill(x, n, ch, True)


def pad_right(x, n, ch=" ") -> Column:
    return _fill(x, n, ch, False)


def center(x, n, ch=" ") -> Column:
    s = text(x)
    gap = F.greatest(col(n).cast("int") - F.length(s), F.lit(0))
    left = F.floor(gap / 2).cast("int")
    return F.concat(F.repeat(text(ch), left), s, F.repeat(text(ch), gap - left))


def truncate(x, n) -> Column:
    s, k = text(x), col(n).cast("int")
    return F.when(k >= 0, s.substr(F.lit(1), k)).otherwise(s.substr(F.lit(1), F.greatest(F.length(s) + k, F.lit(0))))


def split(x, by: str, i) -> Column:
    parts = F.split(text(x), re.escape(by)) if by else F.split(text(x), "")
    k = col(i).cast("int")
    return F.get(parts, F.when(k < 0, F.size(parts) + k).otherwise(k))


def join(arr, by) -> Column:
    return F.array_join(arr, by, "")


def mask(x, pattern: str) -> Column:
    """The pattern's # A * each take a character of x; others stand for themselves, until x is used up."""
    s, parts, taken = text(x), [], 0
    for ch in pattern:
        if ch in "#A*":
            taken += 1
            parts.append(F.substring(s, taken, 1))
        else:
            parts.append(F.when(F.length(s) > taken, ch).otherwise(""))
    return F.concat(*parts) if parts else F.lit("")


def repeat(x, n) -> Column:
    return F.when(col(n) >= 0, F.repeat(text(x), F.least(col(n), F.lit(10_000)).cast("int")))


def _words(x) -> Column:
    s = F.regexp_replace(text(x), r"([a-z0-9])([A-Z])", "$1 $2")
    s = F.regexp_replace(s, r"([A-Z]+)([A-Z][a-z])", "$1 $2")
    return F.filter(F.split(F.regexp_replace(s, r"[-_\s]+", " "), " "), lambda w: w != "")


def snake_case(x) -> Column:
    return F.lower(F.array_join(_words(x), "_"))


def kebab_case(x) -> Column:
    return F.lower(F.array_join(_words(x), "-"))


def pascal_case(x) -> Column:
    return F.array_join(F.transform(_words(x), capitalize), "")


def camel_case(x) -> Column:
    return F.array_join(F.transform(_words(x), lambda w, i: F.when(i == 0, F.lower(w)).otherwise(capitalize(w))), "")


def slugify(x) -> Column:
    s = F.regexp_replace(F.lower(text(x)), r"[^\w\s-]", "")
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(s, r"[\s_]+", "-"), "-+", "-"), "^-+|-+$", "")


def safe_pattern(pattern: str) -> bool:
    """Patterns with nested or huge quantifiers are refused."""
    return not re.search(r"\([^()]*[+*][^()]*\)[+*{]|\([^()]*\|[^()]*\)[+*]|\{\d*,?(1\d\d|[2-9]\d\d|\d{4,})\}", pattern)


def matches(x, pattern: str) -> Column:
    return F.regexp_like(text(x), F.lit(pattern)) if safe_pattern(pattern) else F.lit(None).cast("boolean")


def extract(x, pattern: str, group: int = 0) -> Column:
    return F.when(matches(x, pattern), F.regexp_extract(text(x), pattern, group))


def replace_regex(x, pattern: str, by: str) -> Column:
    return F.regexp_replace(text(x), pattern, by) if safe_pattern(pattern) else F.lit(None).cast("string")


def normalize_space(x) -> Column:
    return F.trim(F.regexp_replace(text(x), r"\s+", " "))


def left_of(x, by) -> Column:
    s = text(x)
    return F.when(F.contains(s, text(by)), F.substring_index(s, by, 1)).otherwise(s)


def right_of(x, by: str) -> Column:
    s = text(x)
    at = F.instr(s, by)
    return F.when(at > 0, s.substr(at + len(by), F.length(s))).otherwise("")


def wrap(x, width) -> Column:
    """Greedy lines of at most ``width``, words kept whole."""
    s = text(x)
    state = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("line"))

    def step(a, w):
        fits = (a["line"] == "") | (F.length(a["line"]) + 1 + F.length(w) <= width)
        line = F.when(a["line"] == "", w).when(fits, F.concat(a["line"], F.lit(" "), w)).otherwise(w)
        return F.struct(F.when(fits, a["done"]).otherwise(F.array_append(a["done"], a["line"])).alias("done"), line.alias("line"))

    lines = F.aggregate(F.filter(F.split(s, r"\s+"), lambda w: w != ""), state, step, lambda a: F.array_append(a["done"], a["line"]))
    return F.when(F.length(s) <= width, s).otherwise(F.array_join(lines, "\n"))


def clean(x) -> Column:
    s = F.regexp_replace(text(x), r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", "")
    return trim(F.regexp_replace(F.regexp_replace(s, r"[\u00A0\u2000-\u200B\u202F\u205F\u3000]", " "), r"\s+", " "))


def tokenize(x, by: str | None = None) -> Column:
    parts = F.split(text(x), re.escape(by) if by else r"\s+")
    return F.filter(F.transform(parts, lambda w: F.trim(w)), lambda w: w != "")


def word_count(x) -> Column:
    return F.size(tokenize(x))


def levenshtein(a, b) -> Column:
    return F.when((F.length(text(a)) <= 1000) & (F.length(text(b)) <= 1000), F.levenshtein(text(a), text(b)))


_SOUNDS = {"BFPV": "1", "CGJKQSXZ": "2", "DT": "3", "L": "4", "MN": "5", "R": "6"}


def soundex(x) -> Column:
    """Letters without a sound of their own part equal sounds."""
    s = F.regexp_replace(F.upper(text(x)), "[^A-Z]", "")

    def code(c):
        out = F.lit("0")
        for letters, digit in _SOUNDS.items():
            out = F.when(c.isin(*letters), digit).otherwise(out)
        return out

    start = F.struct(F.substring(s, 1, 1).alias("r"), code(F.substring(s, 1, 1)).alias("p"))
    letters = F.filter(F.split(s.substr(F.lit(2), F.length(s)), ""), lambda c: c != "")
    step = lambda a, c: F.struct(F.when((F.length(a["r"]) < 4) & (code(c) != "0") & (code(c) != a["p"]), F.concat(a["r"], code(c))).otherwise(a["r"]).alias("r"), code(c).alias("p"))
    return F.when(s == "", "").otherwise(F.rpad(F.aggregate(letters, start, step, lambda a: a["r"]), 4, "0"))


def escape_html(x, quote: str = "&#39;") -> Column:
    s = text(x)
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", quote)):
        s = F.replace(s, F.lit(a), F.lit(b))
    return s


def escape_xml(x) -> Column:
    return escape_html(x, "&apos;")


def unescape_html(x) -> Column:
    """Named entities in turn, then numbered ones."""
    s = text(x)
    for a, b in (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&nbsp;", "\u00a0")):
        s = F.replace(s, F.lit(a), F.lit(b))
    # each numbered entity ends a piece: what stands before it, and its character
    entity = r"&#(\d{1,7}|[xX][0-9a-fA-F]{1,6});"
    pieces = F.split(F.regexp_replace(s, entity, "\u0001$0\u0001"), "\u0001")
    digits = lambda p: F.regexp_extract(p, "^" + entity + "$", 1)

    def one(p):
        d = digits(p)
        code = F.when(F.lower(F.substring(d, 1, 1)) == "x", F.conv(F.substring(d, 2, 6), 16, 10)).otherwise(d).try_cast("long")
        low = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
        return F.when((d != "") & (code < 0x110000), low).otherwise(p)

    return F.when(F.contains(s, F.lit("&#")), F.array_join(F.transform(pieces, one), "")).otherwise(s)


def strip_tags(x) -> Column:
    return F.regexp_replace(text(x), "<[^>]*>", "")


def _accents() -> tuple[str, str]:
    """Letters that are one letter and marks above or below it, and that letter; those of the plane of two-byte code units."""
    import unicodedata

    pairs = []
    for code in range(0xC0, 0x1FFF):
        parts = unicodedata.normalize("NFD", chr(code))
        bare = "".join(c for c in parts if not 0x300 <= ord(c) <= 0x36F)
        if len(parts) > 1 and len(bare) == 1:
            pairs.append((chr(code), bare))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def strip_accents(x) -> Column:
    letters, bare = _accents()
    return F.regexp_replace(F.translate(text(x), letters, bare), "[\\x{300}-\\x{36F}]", "")


def template(pattern: str, fields: dict) -> Column:
    parts = re.split(r"(\{\w+\})", pattern)
    return F.concat(*[text(fields[p[1:-1]]) if p[:1] == "{" and p[1:-1] in fields else F.lit("" if p[:1] == "{" and p[-1:] == "}" else p) for p in parts])


_PHONES = {"US": (10, "({0:3}) {3:3}-{6:4}"), "CA": (10, "({0:3}) {3:3}-{6:4}"), "FR": (10, "{0:2} {2:2} {4:2} {6:2} {8:2}"), "AU": (10, "{0:2} {2:4} {6:4}")}


def format_phone(x, country: str = "US") -> Column:
    digits = F.regexp_replace(text(x), r"\D", "")
    if country.upper() not in _PHONES:
        return text(x)
    size, shape = _PHONES[country.upper()]
    parts = [F.substring(digits, int(m[0]) + 1, int(m[1])) if isinstance(m, tuple) else F.lit(m) for m in (tuple(p[1:-1].split(":")) if p[:1] == "{" else p for p in re.split(r"(\{\d:\d\})", shape) if p)]
    return F.when(F.length(digits) == size, F.concat(*parts)).otherwise(text(x))


# ---- numbers ---------------------------------------------------------------------------------------------


def round_(x, digits: int = 0) -> Column:
    """Half goes up, also below zero."""
    return snapped(F.floor(number(x, "double") * 10.0**digits + 0.5) / 10.0**digits)


def fixed(x, digits: int = 2) -> Column:
    return F.format_string(f"%.{digits}f", number(x, "double"))


def format_percent(x, digits: int = 2) -> Column:
    return F.concat(fixed(number(x, "double") * 100, digits), F.lit("%"))


def divide(a, b) -> Column:
    return F.when(number(b, "double") != 0, number(a, "double") / number(b, "double"))


def safe_divide(a, b, default) -> Column:
    return F.coalesce(finite(divide(a, b)), col(default).cast("double"))


def mod(a, b) -> Column:
    return F.when(number(b, "double") != 0, number(a, "double") % number(b, "double"))


def trunc(x) -> Column:
    n = number(x, "double")
    return F.when(n < 0, F.ceil(n)).otherwise(F.floor(n)).cast("double")


def min_of(*xs) -> Column:
    return F.least(*[number(x, "double") for x in xs])


def max_of(*xs) -> Column:
    return F.greatest(*[number(x, "double") for x in xs])


def is_finite(x) -> Column:
    return finite(x).isNotNull()


def parse_int(x, radix: int = 10) -> Column:
    digits = "0123456789abcdefghijklmnopqrstuvwxyz"[:radix]
    found = F.regexp_extract(F.lower(text(x)), rf"^\s*([+-]?[{digits}]+)", 1)
    value = F.conv(F.regexp_replace(found, "^[+-]", ""), radix, 10).try_cast("long")
    return F.when(found != "", F.when(F.startswith(found, F.lit("-")), -value).otherwise(value))


def gcd(a, b) -> Column:
    start = F.struct(F.abs(trunc(a)).cast("long").alias("a"), F.abs(trunc(b)).cast("long").alias("b"))
    step = lambda s, _: F.struct(F.when(s["b"] == 0, s["a"]).otherwise(s["b"]).alias("a"), F.when(s["b"] == 0, F.lit(0).cast("long")).otherwise(s["a"] % F.when(s["b"] == 0, F.lit(1).cast("long")).otherwise(s["b"])).alias("b"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(90)), start, step, lambda s: s["a"])


def lcm(a, b) -> Column:
    g = gcd(a, b)
    return F.when(g == 0, F.lit(0).cast("long")).otherwise((F.abs(trunc(a)) / g * F.abs(trunc(b))).cast("long"))


def factorial(x) -> Column:
    n = F.floor(number(x, "double")).cast("int")
    return F.when(n.between(0, 18), F.factorial(F.when(n.between(0, 18), n).otherwise(0)))


def log(x, base=None) -> Column:
    v = number(x, "double")
    if base is None:
        return F.when(v > 0, F.ln(v))
    b = number(base, "double")
    return F.when((v > 0) & (b > 0) & (b != 1), F.ln(v) / F.ln(b))


def log10(x) -> Column:
    v = number(x, "double")
    return F.when(v > 0, F.log10(v))


def pow_(a, b) -> Column:
    return finite(F.pow(number(a, "double"), number(b, "double")))


def sqrt(x) -> Column:
    v = number(x, "double")
    return F.when(v >= 0, F.sqrt(v))


def clamp(x, lo, hi) -> Column:
    return F.greatest(number(lo, "double"), F.least(number(hi, "double"), number(x, "double")))


def interpolate(x, x1, y1, x2, y2) -> Column:
    x, x1, y1, x2, y2 = (number(v, "double") for v in (x, x1, y1, x2, y2))
    return F.when(x1 == x2, y1).otherwise(y1 + (x - x1) * (y2 - y1) / F.when(x1 == x2, F.lit(1.0)).otherwise(x2 - x1))


#: Each unit's size in its family's base unit.
UNITS = {
    "mass": {"kg": 1.0, "g": 0.001, "mg": 0.000001, "lb": 0.45359237, "oz": 0.0283495, "ton": 907.185, "tonne": 1000.0},
    "length": {"m": 1.0, "km": 1000.0, "cm": 0.01, "mm": 0.001, "mi": 1609.344, "ft": 0.3048, "in": 0.0254, "yd": 0.9144},
    "volume": {"L": 1.0, "mL": 0.001, "gal": 3.78541, "qt": 0.946353, "pt": 0.473176, "cup": 0.236588, "floz": 0.0295735},
    "speed": {"mps": 1.0, "kph": 0.277778, "mph": 0.44704},
    "area": {"sqm": 1.0, "sqft": 0.092903, "sqkm": 1000000.0, "sqmi": 2589988.11, "acre": 4046.8564, "hectare": 10000.0},
    "data": {"B": 1.0, "KB": 1024.0, "MB": 1048576.0, "GB": 1073741824.0, "TB": 1099511627776.0},
    "time": {"ms": 0.001, "s": 1.0, "min": 60.0, "hr": 3600.0, "day": 86400.0},
}
TEMPERATURES = ("C", "F", "K")


def convert_unit(x, a: str, b: str, kind: str = "double") -> Column:
    """Six decimals; null for unknown units and units of different families. Of kind "decimal", the amount is multiplied without error, and
    only the product is a double: numbers halfway between two of six decimals may go to another side than a product of doubles."""
    v = number(x, "double")
    families = [f for f in UNITS.values() if a in f and b in f]
    if not families and not (a in TEMPERATURES and b in TEMPERATURES):
        return F.lit(None).cast("double")
    if a == b:
        return v
    if families:
        size = families[0][a]
        product = (F.coalesce(col(x), F.lit(0)) * F.lit(Decimal(f"{Decimal(str(size)):f}"))).cast("double") if kind == "decimal" else v * size
        out = product / families[0][b]
    else:
        celsius = {"C": v, "F": (v - 32) * 5 / 9, "K": v - 273.15}[a]
        out = {"C": celsius, "F": celsius * 9 / 5 + 32, "K": celsius + 273.15}[b]
    return F.floor(out * 1e6 + 0.5) / 1e6


# ---- dates (UTC) -----------------------------------------------------------------------------------------

_ISO = "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"


def pattern(p: str) -> str:
    """YYYY YY DD A in Spark's letters."""
    return p.replace("YYYY", "yyyy").replace("YY", "yy").replace("DD", "dd").replace("A", "a")


def day(x) -> Column:
    return F.date_format(col(x), "yyyy-MM-dd")


def add_days(x, n) -> Column:
    return day(F.date_add(col(x).cast("date"), F.floor(col(n)).cast("int")))


def add_months(x, n) -> Column:
    return day(F.add_months(col(x).cast("date"), F.floor(col(n)).cast("int")))


def add_years(x, n) -> Column:
    return add_months(x, F.floor(col(n)) * 12)


def add_seconds(x, n, unit: float = 1.0) -> Column:
    micros = (col(n).cast("double") * unit * 1e6).cast("long")
    return F.date_format(F.timestamp_micros(F.unix_micros(col(x).cast("timestamp")) + micros), _ISO)


def date_diff(a, b, unit: str = "days") -> Column:
    a, b = col(a), col(b)
    if unit == "days":
        return F.floor((F.unix_millis(b.cast("timestamp")) - F.unix_millis(a.cast("timestamp"))) / 86_400_000)
    if unit == "months":
        return ((F.year(b) - F.year(a)) * 12 + F.month(b) - F.month(a)).cast("long")
    return (F.year(b) - F.year(a)).cast("long") if unit == "years" else F.lit(None).cast("long")


def end_of_day(x) -> Column:
    return F.timestamp_millis(F.unix_millis(F.date_trunc("day", col(x))) + 86_399_999)


def is_leap_year(x) -> Column:
    y = F.year(col(x))
    return ((y % 4 == 0) & (y % 100 != 0)) | (y % 400 == 0)


def from_unix(x) -> Column:
    n = number(x, "double")
    return F.date_format(F.timestamp_millis(F.when(F.abs(n) < 1e11, n * 1000).otherwise(n).cast("long")), _ISO)


def age(x, at) -> Column:
    a, b = col(x).cast("date"), col(at).cast("date")
    years = F.year(b) - F.year(a) - F.when((F.month(b) < F.month(a)) | ((F.month(b) == F.month(a)) & (F.dayofmonth(b) < F.dayofmonth(a))), 1).otherwise(0)
    return F.when(a <= b, years)


def business_days(x, n) -> Column:
    """n weekdays on (or back, below zero); from a weekend day the first step reaches a weekday."""
    d, n = col(x).cast("date"), col(n).cast("int")
    k, m = F.floor(F.abs(n) / 5).cast("int"), F.abs(n) % 5
    w = F.weekday(d)
    ahead = F.when(w == 5, 1).when(w == 6, 0).when(w + m > 4, 2).otherwise(0)
    back = F.when(w == 5, 0).when(w == 6, 1).when(w - m < 0, 2).otherwise(0)
    forward = F.when(m == 0, F.date_add(d, k * 7)).otherwise(F.date_add(d, k * 7 + m + ahead))
    return F.when(n >= 0, forward).otherwise(F.when(m == 0, F.date_add(d, -k * 7)).otherwise(F.date_add(d, -(k * 7 + m + back))))


def next_business_day(x) -> Column:
    d = col(x).cast("date")
    return F.date_add(d, F.when(F.weekday(d) == 4, 3).when(F.weekday(d) == 5, 2).otherwise(1))


def coerce_date(x) -> Column:
    """ISO, eight digits, month/day/year (day first where it must be), day.month.year, seconds or milliseconds."""
    s = F.trim(text(x))
    us = F.when(F.regexp_extract(s, r"^(\d{1,2})/", 1).try_cast("int") > 12, F.try_to_date(s, "d/M/yyyy")).otherwise(F.try_to_date(s, "M/d/yyyy"))
    seconds = F.when(F.regexp_like(s, F.lit(r"^\d{9,13}$")), s.try_cast("long"))
    epoch = F.timestamp_millis(F.when(seconds < 100_000_000_000, seconds * 1000).otherwise(seconds)).cast("date")
    return (
        F.when(F.regexp_like(s, F.lit(r"^\d{4}-\d{2}-\d{2}")), F.try_to_date(F.substring(s, 1, 10), "yyyy-MM-dd"))
        .when(F.regexp_like(s, F.lit(r"^\d{8}$")), F.try_to_date(s, "yyyyMMdd"))
        .when(F.regexp_like(s, F.lit(r"^\d{1,2}/\d{1,2}/\d{4}$")), us)
        .when(F.regexp_like(s, F.lit(r"^\d{1,2}\.\d{1,2}\.\d{4}$")), F.try_to_date(s, "d.M.yyyy"))
        .otherwise(epoch)
    )


# ---- encodings, hashes, URLs, JSON ------------------------------------------------------------------------


def hex_encode(x) -> Column:
    return F.lower(F.hex(F.encode(text(x), "UTF-8")))


def base64(x) -> Column:
    return F.base64(F.encode(text(x), "UTF-8"))


def base64_decode(x) -> Column:
    return F.decode(F.try_to_binary(F.translate(text(x), "-_", "+/"), F.lit("base64")), "UTF-8")


def base64url(x) -> Column:
    return F.regexp_replace(F.translate(base64(x), "+/", "-_"), "=+$", "")


def url_encode(x) -> Column:
    s = F.url_encode(text(x))
    for a, b in (("+", "%20"), ("%21", "!"), ("%7E", "~"), ("%27", "'"), ("%28", "("), ("%29", ")")):
        s = F.replace(s, F.lit(a), F.lit(b))
    return s


def url_decode(x) -> Column:
    return F.try_url_decode(F.replace(text(x), F.lit("+"), F.lit("%2B")))


def crc32(x) -> Column:
    return F.lpad(F.lower(F.hex(F.crc32(text(x)))), 8, "0")


#: Bytes of each hash's block, and the hash as a Column of hex digits.
_HASHES = {
    "md5": (64, F.md5), "sha1": (64, F.sha1), "sha224": (64, lambda b: F.sha2(b, 224)), "sha256": (64, lambda b: F.sha2(b, 256)), "sha384": (128, lambda b: F.sha2(b, 384)), "sha512": (128, lambda b: F.sha2(b, 512)),
}


def hmac(x, key: str, algorithm: str = "sha256") -> Column:
    """RFC 2104, of two hashes over the padded key."""
    import hashlib

    size, digest = _HASHES[algorithm]
    k = key.encode()
    k = (hashlib.new(algorithm, k).digest() if len(k) > size else k).ljust(size, b"\0")
    pad = lambda by: F.lit(bytearray(c ^ by for c in k))
    inner = F.unhex(digest(F.concat(pad(0x36), F.encode(text(x), "UTF-8"))))
    return digest(F.concat(pad(0x5C), inner))


def parse_url(x) -> Column:
    u = text(x)
    part = lambda n: F.try_parse_url(u, F.lit(n))
    port = F.regexp_extract(u, r"^[a-z]+://[^/:]+:(\d+)", 1).try_cast("int")
    return F.struct(part("PROTOCOL").alias("scheme"), part("HOST").alias("host"), port.alias("port"), part("PATH").alias("path"), part("QUERY").alias("query"), part("REF").alias("fragment"))


def parse_query(x) -> Column:
    """Keys sorted, the first value of each."""
    pairs = F.filter(F.split(F.regexp_replace(text(x), r"^\?", ""), "&"), lambda p: p != "")
    kv = F.transform(pairs, lambda p, i: F.struct(F.try_url_decode(F.substring_index(p, "=", 1)).alias("k"), i.alias("i"), F.try_url_decode(right_of(p, "=")).alias("v")))
    kept = F.filter(kv, lambda a: ~F.exists(kv, lambda b: (b["k"] == a["k"]) & (b["i"] < a["i"])))
    return F.map_from_entries(F.transform(F.sort_array(kept), lambda a: F.struct(a["k"], a["v"])))


def build_query(m) -> Column:
    """Form-encoded pairs of a map, by key; nulls are left out."""
    pairs = F.array_sort(F.map_entries(F.map_filter(m, lambda _, v: v.isNotNull())))
    return F.array_join(F.transform(pairs, lambda e: F.concat_ws("=", F.url_encode(e["key"].cast("string")), F.url_encode(e["value"].cast("string")))), "&")


def build_url(parts) -> Column:
    """The inverse of ``parse_url``, with the query's keys sorted; null without a scheme or host."""
    get = lambda n: F.coalesce(parts[n].cast("string"), F.lit(""))
    after = lambda mark, s: F.when(s == "", "").otherwise(F.concat(F.lit(mark), s))
    path = get("path")
    path = F.when((path == "") | F.startswith(path, F.lit("/")), path).otherwise(F.concat(F.lit("/"), path))
    url = F.concat(get("scheme"), F.lit("://"), get("host"), after(":", get("port")), path, after("?", build_query(parse_query(get("query")))), after("#", get("fragment")))
    return F.when((get("scheme") != "") & (get("host") != ""), url)


def json_text(x, kind: str = "string") -> Column:
    """Objects and arrays as JSON; other values as text, escaped for a JSON string."""
    if kind in ("array", "object", "variant"):
        return F.to_json(x)
    said = F.to_json(F.struct(text(x, kind).alias("v")))
    return F.substring(said, F.lit(7), F.length(said) - 8)


def json_decode(x) -> Column:
    """A variant: of the object or array that a text holds, else of the text unescaped; null where that can't be."""
    s = text(x)
    quoted = F.try_parse_json(F.concat(F.lit('"'), s, F.lit('"')))
    return F.when(F.regexp_like(s, F.lit(r"^[{\[]")), F.coalesce(F.try_parse_json(s), quoted)).otherwise(quoted)


def stable_json(x, kind: str = "object") -> Column:
    """JSON whose objects have their keys sorted, at every depth: a variant keeps them so."""
    if kind == "variant":
        return F.to_json(x)
    if kind in ("array", "object"):
        return F.to_json(F.parse_json(F.to_json(x, {"ignoreNullFields": "false"})))
    return F.concat(F.lit('"'), json_text(x, kind), F.lit('"')) if kind == "string" else text(x, kind)


def try_coerce(x) -> Column:
    """A variant of what a text looks like: null, boolean, whole number, number, date, timestamp, or the text itself."""
    raw = text(x)
    s = F.trim(raw)
    like = lambda p: F.regexp_like(s, F.lit(p))
    as_ = lambda kind: s.try_cast(kind).cast("variant")
    whole = like(r"^-?\d+$") & (F.abs(s.try_cast("double")) <= 2.0**53 - 1)
    return (
        F.when(s == "", F.lit(None).cast("variant")).when(F.lower(s).isin("true", "false"), as_("boolean")).when(whole, as_("bigint")).when(like(r"^-?(\d*\.\d+|\d+\.\d*)$"), as_("double"))
        .when(like(r"^\d{4}-\d{2}-\d{2}$") & s.try_cast("date").isNotNull(), as_("date")).when(like(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}") & s.try_cast("timestamp").isNotNull(), as_("timestamp")).otherwise(raw.cast("variant"))
    )


def json_path(x, path: str) -> Column:
    return F.get_json_object(text(x), path)


# ---- money -----------------------------------------------------------------------------------------------


def compound(p, r, n) -> Column:
    return number(p, "double") * F.pow(1 + number(r, "double"), number(n, "double"))


def discount(fv, r, n) -> Column:
    return number(fv, "double") / F.pow(1 + number(r, "double"), number(n, "double"))


def pmt(p, r, n) -> Column:
    p, r, n = number(p, "double"), number(r, "double"), number(n, "double")
    f = F.pow(1 + r, n)
    return F.when(n <= 0, F.lit(None).cast("double")).when(r == 0, p / F.when(n == 0, F.lit(1.0)).otherwise(n)).otherwise(p * r * f / F.when(f == 1, F.lit(1.0)).otherwise(f - 1))


def fv(p, r, n) -> Column:
    p, r, n = number(p, "double"), number(r, "double"), number(n, "double")
    return F.when(r == 0, p * n).otherwise(p * (F.pow(1 + r, n) - 1) / F.when(r == 0, F.lit(1.0)).otherwise(r))


def pv(p, r, n) -> Column:
    p, r, n = number(p, "double"), number(r, "double"), number(n, "double")
    return F.when(r == 0, p * n).otherwise(p * (1 - F.pow(1 + r, -n)) / F.when(r == 0, F.lit(1.0)).otherwise(r))


def nper(r, p, v) -> Column:
    r, p, v = number(r, "double"), number(p, "double"), number(v, "double")
    inner = 1 + v * r / F.when(p == 0, F.lit(1.0)).otherwise(p)
    return F.when(p == 0, F.lit(None).cast("double")).when(r == 0, -v / F.when(p == 0, F.lit(1.0)).otherwise(p)).when((inner > 0) & (r > -1), -F.ln(F.when(inner > 0, inner).otherwise(1.0)) / F.ln(1 + r))


def depreciation(cost, salvage, life) -> Column:
    c, s, n = number(cost, "double"), number(salvage, "double"), number(life, "double")
    return F.when((s <= c) & (n > 0), (c - s) / F.when(n > 0, n).otherwise(1.0))


def npv(rate, flows) -> Column:
    r = number(rate, "double")
    return F.aggregate(F.transform(flows, lambda x, t: number(x, "double") / F.pow(1 + r, t)), F.lit(0.0), lambda a, x: a + x)


def xnpv(rate, flows, days) -> Column:
    """days: of each flow since the first."""
    r = number(rate, "double")
    return F.when(F.size(flows) == F.size(days), F.aggregate(F.zip_with(flows, days, lambda x, d: number(x, "double") / F.pow(1 + r, d / 365)), F.lit(0.0), lambda a, x: a + x))


def _root(value, slope, guess: float, low: float, high: float, tolerance: float, steps: int):
    """Newton's method as a fold; null where it doesn't converge."""
    start = F.struct(F.lit(guess).alias("x"), F.lit(False).alias("done"), F.lit(False).alias("lost"))

    def step(s, _):
        d = slope(s["x"])
        new = s["x"] - value(s["x"]) / F.when(F.abs(d) < 1e-12, F.lit(1.0)).otherwise(d)
        over = s["done"] | s["lost"]
        lost = s["lost"] | (~s["done"] & ((F.abs(d) < 1e-12) | (new <= low) | (new >= high)))
        return F.struct(F.when(over | lost, s["x"]).otherwise(new).alias("x"), (s["done"] | (~lost & (F.abs(new - s["x"]) < tolerance))).alias("done"), lost.alias("lost"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, step, lambda s: F.when(s["done"] & ~s["lost"], s["x"]))


def irr(flows) -> Column:
    def value(x):
        return F.aggregate(F.transform(flows, lambda c, t: number(c, "double") / F.pow(1 + x, t)), F.lit(0.0), lambda a, y: a + y)

    def slope(x):
        return F.aggregate(F.transform(flows, lambda c, t: -t * number(c, "double") / F.pow(1 + x, t + 1)), F.lit(0.0), lambda a, y: a + y)

    return _root(value, slope, 0.1, -0.99, 10.0, 1e-6, 100)


def _newton(value, slope, guess, precision: float, flat: float, low: float, high: float, steps: int = 100) -> Column:
    """The first of the steps' points at which the value is within the precision of 0; null where the slope is flat or a step leaves
    (low, high). Steps after that cost a look at the state."""
    start = F.struct(F.lit(guess).cast("double").alias("x"), F.lit(False).alias("done"), F.lit(False).alias("lost"))

    def step(s, _):
        at = F.struct(value(s["x"]).alias("f"), slope(s["x"]).alias("d"))

        def moved(p):
            hit, over = F.abs(p["f"]) < precision, s["done"] | s["lost"]
            new = s["x"] - p["f"] / F.when(F.abs(p["d"]) < flat, F.lit(1.0)).otherwise(p["d"])
            lost = ~hit & ((F.abs(p["d"]) < flat) | ~new.between(low, high) | F.isnan(new))
            return F.struct(F.when(over | hit | lost, s["x"]).otherwise(new).alias("x"), (s["done"] | (~s["lost"] & hit)).alias("done"), (s["lost"] | (~s["done"] & lost)).alias("lost"))

        return F.when(s["done"] | s["lost"], s).otherwise(F.get(F.transform(F.array(at), moved), 0))

    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, step, lambda s: F.when(s["done"], s["x"]))


def xirr(flows, days, guess: float = 0.1) -> Column:
    """days: of each flow since the first."""
    total = lambda v: F.aggregate(v, F.lit(0.0), lambda a, y: a + y)
    year = lambda d: d.cast("double") / 365
    value = lambda r: total(F.zip_with(flows, days, lambda c, d: number(c, "double") / F.pow(1 + r, year(d))))
    slope = lambda r: total(F.zip_with(flows, days, lambda c, d: -year(d) * number(c, "double") / F.pow(1 + r, year(d) + 1)))
    return F.when((F.size(flows) == F.size(days)) & (F.size(flows) >= 2), _newton(value, slope, guess, 1e-7, 1e-12, -0.999999999, 1e12))


def rate(periods, payment, present, future) -> Column:
    """The interest a period at which present, payments and future value balance."""
    given = F.struct(*[number(x, "double").alias(k) for k, x in zip("npvw", (periods, payment, present, future))])
    return F.get(F.transform(F.array(given), lambda g: _rate(*[g[k] for k in "npvw"])), 0)  # each is evaluated once


def _rate(n, p, v, w) -> Column:
    def value(r):
        f = F.pow(1 + r, n)
        return F.when(r == 0, v + p * n + w).otherwise(v + p * (1 - 1 / f) / F.when(r == 0, F.lit(1.0)).otherwise(r) + w / f)

    def slope(r):
        safe = F.when(r == 0, F.lit(1e-9)).otherwise(r)
        f = F.pow(1 + r, n)
        return p * (1 / f - 1) / (safe * safe) + p * n / (safe * f * (1 + r)) - w * n / (f * (1 + r))

    ratio = -w / F.when(v == 0, F.lit(1.0)).otherwise(v)
    closed = F.when((v != 0) & (ratio > 0), F.pow(F.when(ratio > 0, ratio).otherwise(1.0), 1 / F.when(n > 0, n).otherwise(1.0)) - 1)
    return F.when(n > 0, F.when(p == 0, closed).otherwise(_newton(value, slope, 0.1, 1e-6, 1e-10, -0.99, 10.0)))


# ---- places ----------------------------------------------------------------------------------------------

#: The Earth's radius.
RADIUS = {"km": 6371.0, "mi": 3959.0, "miles": 3959.0}


def _on_earth(*pairs) -> Column:
    ok = F.lit(True)
    for lat, lon in pairs:
        ok = ok & lat.between(-90, 90) & lon.between(-180, 180)
    return ok


def distance(lat1, lon1, lat2, lon2, unit: str = "km") -> Column:
    if unit not in RADIUS:
        return F.lit(None).cast("double")
    a1, o1, a2, o2 = (number(v, "double") for v in (lat1, lon1, lat2, lon2))
    h = F.pow(F.sin(F.radians(a2 - a1) / 2), 2) + F.cos(F.radians(a1)) * F.cos(F.radians(a2)) * F.pow(F.sin(F.radians(o2 - o1) / 2), 2)
    return F.when(_on_earth((a1, o1), (a2, o2)), RADIUS[unit] * 2 * F.atan2(F.sqrt(h), F.sqrt(F.greatest(1 - h, F.lit(0.0)))))


def bearing(lat1, lon1, lat2, lon2) -> Column:
    a1, o1, a2, o2 = (F.radians(number(v, "double")) for v in (lat1, lon1, lat2, lon2))
    y = F.sin(o2 - o1) * F.cos(a2)
    x = F.cos(a1) * F.sin(a2) - F.sin(a1) * F.cos(a2) * F.cos(o2 - o1)
    return F.pmod(F.degrees(F.atan2(y, x)), F.lit(360.0))


def midpoint(lat1, lon1, lat2, lon2) -> Column:
    a1, o1, a2, o2 = (F.radians(number(v, "double")) for v in (lat1, lon1, lat2, lon2))
    bx, by = F.cos(a2) * F.cos(o2 - o1), F.cos(a2) * F.sin(o2 - o1)
    lat = F.atan2(F.sin(a1) + F.sin(a2), F.sqrt(F.pow(F.cos(a1) + bx, 2) + F.pow(by, 2)))
    return F.struct(F.degrees(lat).alias("lat"), F.degrees(o1 + F.atan2(by, F.cos(a1) + bx)).alias("lon"))


def in_box(lat, lon, south, west, north, east) -> Column:
    lat, lon = number(lat, "double"), number(lon, "double")
    return lat.between(south, north) & lon.between(west, east)
