"""Schema validation: rules compiled to one array column of errors, evaluated in a single pass."""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import safe_pattern
from .cuts import cut

#: Patterns of the named formats; (?i) where case doesn't matter.
FORMATS = {
    "email": r"^[^@\s]+@[^@\s]+\.[^@\s]+$",
    "url": r"(?i)^https?://[^\s/$.?#].[^\s]*$",
    "uri": r"^[a-zA-Z][a-zA-Z0-9+.-]*:[^\s]*$",
    "uuid": r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-4[0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}$",
    "date": r"^\d{4}-\d{2}-\d{2}$",
    "date-iso": r"^\d{4}-\d{2}-\d{2}$",
    "time": r"^\d{2}:\d{2}:\d{2}$",
    "datetime": r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}",
    "date-time": r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}",
    "hostname": r"^[a-zA-Z0-9]([a-zA-Z0-9-]{0,61}[a-zA-Z0-9])?(\.[a-zA-Z0-9]([a-zA-Z0-9-]{0,61}[a-zA-Z0-9])?)*$",
    "ipv4": r"^(?:(?:25[0-5]|2[0-4]\d|[01]?\d\d?)\.){3}(?:25[0-5]|2[0-4]\d|[01]?\d\d?)$",
    "phone": r"^[+]?[0-9]{1,4}?[-.\s]?[(]?[0-9]{1,4}[)]?[-.\s]?[0-9]{1,4}[-.\s]?[0-9]{1,9}$",
    "ssn": r"^(?!000|666|9)\d{3}-?(?!00)\d{2}-?(?!0000)\d{4}$",
    "ein": r"^\d{2}-\d{7}$",
    "fein": r"^\d{2}-\d{7}$",
    "zip": r"^\d{5}(-\d{4})?$",
    "postal-ca": r"^[A-Za-z]\d[A-Za-z][ -]?\d[A-Za-z]\d$",
    "vin": r"(?i)^[A-HJ-NPR-Z0-9]{17}$",
    "iban": r"(?i)^[A-Z]{2}\d{2}[A-Z0-9]{4,30}$",
    "bic": r"(?i)^[A-Z]{4}[A-Z]{2}[A-Z0-9]{2}([A-Z0-9]{3})?$",
    "swift": r"(?i)^[A-Z]{4}[A-Z]{2}[A-Z0-9]{2}([A-Z0-9]{3})?$",
    "routing": r"^\d{9}$",
    "cusip": r"(?i)^[A-Z0-9]{9}$",
    "isin": r"(?i)^[A-Z]{2}[A-Z0-9]{9}\d$",
    "lei": r"(?i)^[A-Z0-9]{20}$",
    "naic": r"^\d{5}$",
    "country-alpha2": r"^[A-Z]{2}$",
    "country-alpha3": r"^[A-Z]{3}$",
    "npi": r"^\d{10}$",
    "dea": r"(?i)^[A-Z]{2}\d{7}$",
    "imei": r"^\d{15}$",
    "iccid": r"^\d{19,20}$",
    "sin": r"^\d{3}[ -]?\d{3}[ -]?\d{3}$",
    "hex": r"^[0-9a-fA-F]+$",
}
#: The currencies' codes, and the states' and territories' of the US.
CURRENCIES = (
    "AED AFN ALL AMD ANG AOA ARS AUD AWG AZN BAM BBD BDT BGN BHD BIF BMD BND BOB BRL BSD BTN BWP BYN BZD CAD CDF CHF CLP CNY COP CRC CUP CVE CZK DJF DKK DOP DZD EGP "
    "ERN ETB EUR FJD FKP GBP GEL GHS GIP GMD GNF GTQ GYD HKD HNL HRK HTG HUF IDR ILS INR IQD IRR ISK JMD JOD JPY KES KGS KHR KMF KPW KRW KWD KYD KZT LAK LBP LKR LRD "
    "LSL LYD MAD MDL MGA MKD MMK MNT MOP MRU MUR MVR MWK MXN MYR MZN NAD NGN NIO NOK NPR NZD OMR PAB PEN PGK PHP PKR PLN PYG QAR RON RSD RUB RWF SAR SBD SCR SDG SEK "
    "SGD SHP SLE SOS SRD SSP STN SVC SYP SZL THB TJS TMT TND TOP TRY TTD TWD TZS UAH UGX USD UYU UZS VES VND VUV WST XAF XCD XOF XPF YER ZAR ZMW ZWL"
).split()
STATES = "AL AK AZ AR CA CO CT DE FL GA HI ID IL IN IA KS KY LA ME MD MA MI MN MS MO MT NE NV NH NJ NM NY NC ND OH OK OR PA RI SC SD TN TX UT VT VA WA WV WI WY DC PR VI GU AS MP".split()


def ipv6(x: Column) -> Column:
    """Eight groups of hexadecimal digits, or fewer with one :: for those that are zero."""
    group = "[0-9a-fA-F]{1,4}"
    halves = F.split(x, "::")
    groups = F.size(F.filter(F.split(x, ":"), lambda g: g != ""))
    side = F.forall(halves, lambda h: F.regexp_like(h, F.lit(f"^({group}(:{group})*)?$")))
    return F.regexp_like(x, F.lit(f"^({group}:){{7}}{group}$")) | ((F.size(halves) == 2) & side & (groups <= 7))


#: Formats that take more than a pattern.
CHECKS = {
    "credit-card": lambda x: luhn(x),
    "creditcard": lambda x: luhn(x),
    "ipv6": ipv6,
    "currency-code": lambda x: F.upper(x).isin(*CURRENCIES),
    "state-us": lambda x: F.upper(x).isin(*STATES),
}


def is_format(x: Column, name: str) -> Column:
    """Whether a text has a named format; an unknown name is an error."""
    if name in CHECKS:
        return CHECKS[name](x)
    if name not in FORMATS:
        raise ValueError(f"W002: no format {name!r}")
    return F.regexp_like(x, F.lit(FORMATS[name]))


@dataclass
class Field:
    """A field's rules. ``when`` and ``unless``: (field, operator, literal) under which ``required`` holds or doesn't.
    nullable: whether a column of a required field may hold null, which is then its value. members: the kinds of a union."""

    name: str
    type: str = "string"
    required: bool = False
    nullable: bool = False
    bounds: tuple | None = None
    pattern: str | None = None
    format: str | None = None
    enum: tuple | None = None
    items: tuple | None = None
    unique: bool = False
    when: tuple | None = None
    unless: tuple | None = None
    deprecated: bool = False
    default: object = None
    members: tuple = ()


@dataclass
class Schema:
    fields: list[Field]
    invariants: list[str] = field(default_factory=list)
    one_of: list[tuple] = field(default_factory=list)  # (fields, least, most)

    def extended(self, other: Schema) -> Schema:
        """This schema with another's fields and rules, which narrow those of the same name; a field that would be widened is an error."""
        own = {f.name: f for f in self.fields}
        for f in other.fields:
            if f.name in own:
                base = own[f.name]
                if base.type != f.type or (base.required and not f.required) or (not base.nullable and f.nullable):
                    raise ValueError(f"V017: {f.name} is wider than in the base")
                f = replace(f, **{k: getattr(base, k) for k in ("bounds", "pattern", "format", "enum", "items", "when", "unless") if getattr(f, k) is None})
            own[f.name] = f
        return Schema(list(own.values()), [*self.invariants, *other.invariants], [*self.one_of, *other.one_of])


def luhn(x: Column) -> Column:
    """13 to 19 digits whose check digit is right."""
    digits = F.reverse(F.filter(F.split(x, ""), lambda c: c != ""))
    doubled = F.transform(digits, lambda c, i: F.when(i % 2 == 1, c.try_cast("int") * 2).otherwise(c.try_cast("int")))
    total = F.aggregate(doubled, F.lit(0), lambda a, d: a + F.when(d > 9, d - 9).otherwise(d))
    return F.coalesce(F.regexp_like(x, F.lit(r"^\d{13,19}$")) & (total % 10 == 0), F.lit(False))


def compare(c: Column, op: str, literal) -> Column:
    """As numbers where both are, else as text (and for = always as text)."""
    a, b = c.cast("string"), str(literal)
    if op in ("=", "==", "!="):
        return F.coalesce(a == b, F.lit(False)) if op != "!=" else ~F.coalesce(a == b, F.lit(False))
    sign = {"<": Column.__lt__, "<=": Column.__le__, ">": Column.__gt__, ">=": Column.__ge__}[op]
    number = sign(a.try_cast("double"), F.lit(b).try_cast("double"))
    return F.coalesce(number, sign(a, F.lit(b)), F.lit(False))


_TOKEN = re.compile(r"\s*(\|\||&&|[<>!=]=|[-+*/%^(),<>=!]|\d+(?:\.\d+)?|'[^']*'|\"[^\"]*\"|[A-Za-z_][\w.]*)")
_LEVELS = (("||",), ("&&",), ("==", "!=", "="), ("<", "<=", ">", ">="), ("+", "-"), ("*", "/", "%"))


def formula(source: str, bind) -> Column:
    """A formula or invariant as a Column. bind(name) gives a name's Column; equality of numbers is within 1e-9."""
    tokens, end = [], 0
    while end < len(source.rstrip()):
        m = _TOKEN.match(source, end)
        if not m:
            raise ValueError(f"can't read {source[end:]!r}")
        tokens.append(m[1])
        end = m.end()
    at = 0

    def peek():
        return tokens[at] if at < len(tokens) else None

    def take():
        nonlocal at
        at += 1
        return tokens[at - 1]

    def level(k):
        if k == len(_LEVELS):
            return unary()
        left = level(k + 1)
        while peek() in _LEVELS[k]:
            op, right = take(), level(k + 1)
            left = _apply(op, left, right)
        return left

    def unary():
        t = take()
        if t == "-":
            return -unary()
        if t == "!":
            return ~unary()
        out = primary(t)
        if peek() == "^":  # binds before the sign, and from the right
            take()
            return F.pow(out, unary())
        return out

    def primary(t):
        if t == "(":
            inner = level(0)
            if take() != ")":
                raise ValueError("a bracket isn't closed")
            return inner
        if t[0].isdigit():
            return F.lit(float(t))
        if t[0] in "'\"":
            return F.lit(t[1:-1])
        if peek() == "(":
            take()
            args = [level(0)]
            while peek() == ",":
                take()
                args.append(level(0))
            take()
            return {"pow": F.pow, "min": F.least, "max": F.greatest, "abs": F.abs, "floor": F.floor, "ceil": F.ceil, "sqrt": F.sqrt, "round": lambda x, d=None: F.floor(x + 0.5) if d is None else F.floor(x * F.pow(F.lit(10.0), d) + 0.5) / F.pow(F.lit(10.0), d), "trunc": lambda x: F.when(x < 0, F.ceil(x)).otherwise(F.floor(x))}[t](*args)
        return F.lit(t == "true") if t in ("true", "false") else bind(t)

    out = level(0)
    if at != len(tokens):
        raise ValueError(f"{tokens[at]!r} is left over")
    return out


def _apply(op, a, b):
    if op in ("=", "=="):
        return F.coalesce(F.abs(a.try_cast("double") - b.try_cast("double")) < 1e-9, a.cast("string") == b.cast("string"))
    if op == "!=":
        return ~_apply("=", a, b)
    return {"||": lambda: a | b, "&&": lambda: a & b, "<": lambda: a < b, "<=": lambda: a <= b, ">": lambda: a > b, ">=": lambda: a >= b, "+": lambda: a + b, "-": lambda: a - b, "*": lambda: a * b, "/": lambda: F.try_divide(a, b), "%": lambda: F.when(b != 0, a % b)}[op]()


#: Characters that a pattern is tried on, at most.
LONGEST = 10_000
#: How a text of each kind of value reads.
_KINDS = {
    "integer": lambda s: F.regexp_like(s, F.lit(r"^[+-]?\d+$")),
    "number": lambda s: s.try_cast("double").isNotNull(),
    "currency": lambda s: F.regexp_like(s, F.lit(r"^[+-]?\d+(\.\d+)?$")),
    "percent": lambda s: F.regexp_like(s, F.lit(r"^[+-]?\d+(\.\d+)?%?$")),
    "boolean": lambda s: s.isin("true", "false"),
    "date": lambda s: s.try_cast("date").isNotNull(),
    "timestamp": lambda s: s.try_cast("timestamp").isNotNull(),
    "time": lambda s: F.regexp_like(s, F.lit(r"^T?([01]\d|2[0-3]):[0-5]\d(:[0-5]\d(\.\d+)?)?$")),
    "duration": lambda s: F.regexp_like(s, F.lit(r"^P(?=.)(\d+[YMWD])*(T(\d+(\.\d+)?[HMS])+)?$")),
    "reference": lambda s: F.startswith(s, F.lit("@")),
    "binary": lambda s: F.regexp_like(s, F.lit(r"^[A-Za-z0-9+/]*={0,2}$")) & (F.length(s) % 4 == 0),
    "null": lambda s: F.lit(False),
}


def _is_kind(c: Column, f: Field) -> Column:
    """Whether a value is of the field's kind, or of one of a union's; a column of any type, read as text."""
    kinds = f.members or (f.type,)
    out = F.lit(False)
    for kind in kinds:
        if kind not in _KINDS:  # texts, enums, arrays and objects take what their column holds
            return F.lit(True)
        out = out | F.coalesce(_KINDS[kind](c.cast("string")), F.lit(False))
    return out


def _compiles(pattern: str) -> bool:
    try:
        re.compile(pattern)
    except re.error:
        return False
    return True


def check_definition(schema: Schema) -> list[str]:
    """V017: what is wrong with a schema itself: bounds that exclude everything, defaults that break the field's own rules,
    rules over fields that there aren't."""
    out, names = [], {f.name for f in schema.fields}
    for f in schema.fields:
        if f.bounds and None not in f.bounds and f.bounds[0] > f.bounds[1]:
            out.append(f"V017: {f.name}: bounds {f.bounds[0]}..{f.bounds[1]}")
        if f.default is not None:
            size = len(f.default) if isinstance(f.default, str) else f.default
            if f.enum and f.default not in f.enum or f.bounds and not ((f.bounds[0] is None or size >= f.bounds[0]) and (f.bounds[1] is None or size <= f.bounds[1])):
                out.append(f"V017: {f.name}: the default breaks a rule")
        if f.format and f.format not in FORMATS and f.format not in CHECKS:
            out.append(f"V017: {f.name}: no format {f.format!r}")
        for other in (f.when, f.unless):
            if other and other[0] not in names:
                out.append(f"V017: {f.name}: no field {other[0]!r}")
    for fields, _, _ in schema.one_of:
        out += [f"V017: no field {n!r}" for n in fields if n not in names]
    return out


def warnings(schema: Schema) -> Column:
    """W001: the deprecated fields that a row has, as array<struct<code, path, message>>."""
    found = [F.when(F.col(f.name).isNotNull(), F.struct(F.lit("W001").alias("code"), F.lit(f.name).alias("path"), F.lit("deprecated").alias("message"))) for f in schema.fields if f.deprecated]
    return F.array_compact(F.array(*found)) if found else F.array().cast("array<struct<code:string,path:string,message:string>>")


def errors(schema: Schema) -> Column:
    """array<struct<code, path, message>> of a row."""
    out = []

    def rule(bad, code, path, message):
        out.append(F.when(F.coalesce(bad, F.lit(False)), F.struct(F.lit(code).alias("code"), F.lit(path).alias("path"), F.lit(message).alias("message"))))

    for f in schema.fields:
        c = F.col(f.name)
        there = c.isNotNull()
        if f.required:
            due = F.lit(True)
            if f.when:
                due = compare(F.col(f.when[0]), *f.when[1:])
            if f.unless:
                due = ~compare(F.col(f.unless[0]), *f.unless[1:])
            if not f.nullable:
                rule(~there & due, "V010" if f.when or f.unless else "V001", f.name, "required")
        rule(there & ~F.coalesce(_is_kind(c, f), F.lit(True)), "V002", f.name, f"no {f.type}")
        if f.bounds:
            lo, hi = f.bounds
            v = F.length(c) if f.type == "string" else F.length(F.unbase64(c)) if f.type == "binary" else c.cast("string").try_cast("double") if f.type in ("integer", "number") else c
            lo, hi = (F.lit(x).cast("timestamp") if x is not None and f.type in ("date", "timestamp") else F.lit(x) for x in (lo, hi))
            rule(there & ((v < lo) if f.bounds[0] is not None else F.lit(False)) | there & ((v > hi) if f.bounds[1] is not None else F.lit(False)), "V003", f.name, f"not within {f.bounds[0]}..{f.bounds[1]}")
        if f.pattern is not None:
            if not _compiles(f.pattern):
                rule(there, "V015", f.name, "no pattern")
            elif safe_pattern(f.pattern):
                rule(there & (F.length(c.cast("string")) > LONGEST), "V016", f.name, "too long for a pattern")
                rule(there & (F.length(c.cast("string")) <= LONGEST) & ~F.regexp_like(c.cast("string"), F.lit(f.pattern)), "V004", f.name, "doesn't match")
            else:
                rule(there, "V014", f.name, "refused pattern")
        if f.format:
            rule(there & ~is_format(c.cast("string"), f.format), "V004", f.name, f"no {f.format}")
        if f.enum:
            rule(there & ~c.cast("string").isin(*[str(x) for x in f.enum]), "V005", f.name, "not among the values")
        if f.items:
            rule(there & ~F.size(c).between(*f.items), "V006", f.name, "number of items")
        if f.unique:
            rule(there & (F.size(F.array_distinct(c)) < F.size(c)), "V007", f.name, "repeated items")
    for text in schema.invariants:
        names = [t for t in _TOKEN.findall(text) if re.match(r"[A-Za-z_]", t) and t not in ("true", "false", "abs", "floor", "ceil", "sqrt", "round", "trunc", "pow", "min", "max")]
        known = F.lit(True)
        for n in names:
            known = known & F.col(n).isNotNull()
        rule(~F.when(known, F.coalesce(formula(text, F.col), F.lit(False))).otherwise(False), "V008", "", text)
    for names, least, most in schema.one_of:
        n = sum((F.col(x).isNotNull().cast("int") for x in names), F.lit(0))
        rule(~n.between(least, most), "V009", ",".join(names), f"{least}..{most} of these")
    return F.array_compact(F.array(*out)) if out else F.array().cast("array<struct<code:string,path:string,message:string>>")


def validate(df: DataFrame, schema: Schema, name: str = "errors") -> DataFrame:
    return df.withColumn(name, errors(schema))


def failures(df: DataFrame, schema: Schema, key: str) -> DataFrame:
    """(key, code, path): a row an error."""
    return df.select(F.col(key), F.explode(errors(schema)).alias("e")).select(key, "e.code", "e.path")


def unknown_fields(paths: DataFrame, schema: Schema) -> DataFrame:
    """V011: paths that the schema lacks."""
    return paths.where(~F.col("path").isin(*[f.name for f in schema.fields]))


def circular(paths: DataFrame) -> DataFrame:
    """V012: references that lead back to themselves. Pointers are doubled: after as many rounds as the number of references has
    bits, what still is a reference stands in or leads into a circle, and its image stands in one."""
    refs = paths.where(F.startswith("value", F.lit("@"))).select("doc_id", "path", F.expr("substring(value, 2)").alias("to"))
    refs = step = cut(refs)
    for _ in range(max(1, refs.count().bit_length())):
        following = step.select("doc_id", F.col("path").alias("to"), F.col("to").alias("next"))
        step = cut(step.join(following, ["doc_id", "to"]).select("doc_id", "path", F.col("next").alias("to")))
    return step.select("doc_id", F.col("to").alias("path")).distinct()


def unresolved(paths: DataFrame) -> DataFrame:
    """V013: references that lead nowhere."""
    refs = paths.where(F.startswith("value", F.lit("@"))).select("doc_id", "path", F.expr("substring(value, 2)").alias("to"))
    return refs.join(paths.select("doc_id", F.col("path").alias("to")), ["doc_id", "to"], "left_anti")
