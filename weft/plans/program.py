"""A small declarative transform language compiled to DataFrame plans.

A program is text::

    @import "shared"
    {$target}
    onValidation = warn
    {$const}
    rate = 0.2
    {$accumulator}
    total = 0
    {$table.STATUS[code, name]}
    "O", "Open"
    "F", "Filled"
    {order}
    id = @o_orderkey
    label = "order ${@o_orderkey} (${%upper @o_orderstatus})"
    status = %lookupDefault STATUS.name @o_orderstatus "?"
    price = %round %multiply @o_totalprice @$const.rate 2 :default 0
    big = ?true :if o_totalprice > 100000
    who = :object {key = @o_custkey, kind = "customer"}
    {lines[]}
    :loop items :as item
    :loop .parts :as part
    sku = @part.sku :upper
    running = %accumulate total @part.price
    {trailer}
    :literal
    \"\"\"
    total ${@$accumulator.total}
    \"\"\"

``@path`` copies, ``@.path`` is relative to a loop's item, quoted texts and numbers are literals, and ``%name`` applies a
function to the arguments after it, as many as it takes. ``%expr "formula"`` is an arithmetic formula over paths. A quoted text
that begins with ``%`` or ``@`` is read again as an expression. Segments run pass by pass (``:pass n``, then those
without), and a chain of ``:if``, ``:elif`` and ``:else`` segments gives the first that holds. A segment whose name begins with ``_`` gives no
output; it can still accumulate. Accumulators belong to a row of the source; between passes, those not marked
``name._persist = ?true`` start anew. Nested loops give a row for each item of each item, depth first.

Each mapping becomes one Column and each segment a struct (or, with :loop, an array of structs): a program is one
projection over its source, in which lookup tables are literal maps, and Catalyst does the rest.

Modifiers that have no place in a column (XML shape, layout) become metadata of the field, which the writers read.
Unknown modifiers are an error. ``onMissing`` and ``onValidation`` of ``{$target}`` say whether a failed check is an error
(fail), a warning (warn) or makes the value null (skip).
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import scalar as S
from ..functions.coerce import condition, number, text
from ..functions.registry import CUSTOM, FUNCTIONS, Typed
from ..operators.validate import compare, formula
from ..sources.imports import DEEPEST


@dataclass
class Mapping:
    target: str
    tokens: list[str]
    modifiers: list[tuple[str, str]]
    fields: list[Mapping] = field(default_factory=list)  # of an inline object


@dataclass
class Segment:
    path: str
    is_array: bool = False
    loops: list[tuple[str, str]] = field(default_factory=list)  # (path, alias)
    start: str | None = None  # what the outermost loop runs over instead
    counter: str | None = None
    guard: tuple[str, str] | None = None  # (if | elif | else, condition)
    number: int = 0  # pass
    body: str | None = None  # of a literal block
    mappings: list[Mapping] = field(default_factory=list)

    @property
    def silent(self) -> bool:
        return self.path.split(".")[-1].startswith("_")


@dataclass
class Program:
    constants: dict[str, object] = field(default_factory=dict)
    tables: dict[str, tuple[list[str], list[list]]] = field(default_factory=dict)
    segments: list[Segment] = field(default_factory=list)
    accumulators: dict[str, object] = field(default_factory=dict)
    persistent: set[str] = field(default_factory=set)
    target: dict[str, object] = field(default_factory=dict)


_TOKEN = re.compile(r'"(?:[^"\\]|\\.)*"|[^\s"]+')
_SECTIONS = {"{$const}": "constants", "{$accumulator}": "accumulators", "{$target}": "target", "{$}": "target", "{$source}": "source"}
_DIRECTIVES = ("loop", "from", "pass", "counter", "if", "elif", "else", "literal")


def parse(source: str, load=None, seen: tuple = ()) -> Program:
    """load(name): the text of an imported program."""
    program, section, table, block = Program(), None, None, None
    for raw in source.splitlines():
        if block is not None:  # inside a literal block
            if raw.strip() == '"""':
                section.body, block = "\n".join(block), None
            else:
                block.append(raw)
            continue
        line = re.sub(r'^((?:[^";]|"(?:[^"\\]|\\.)*")*);.*$', r"\1", raw).strip()
        if not line:
            continue
        name, _, value = (x.strip() for x in line.partition("="))
        if line == '"""' and isinstance(section, Segment):
            block = []
        elif m := re.fullmatch(r'@import\s+"([^"]+)"(?:\s+as\s+\w+)?', line):
            if m[1] in seen or len(seen) >= DEEPEST:
                raise ValueError(f"import of {m[1]!r} leads back to itself, or too deep")
            _merge(program, parse(load(m[1]), load, (*seen, m[1])))
        elif m := re.fullmatch(r"\{\$table\.(\w+)\[([^\]]*)\]\}", line):
            section, table = "table", m[1]
            program.tables[table] = ([c.strip() for c in m[2].split(",")], [])
        elif line in _SECTIONS:
            section = _SECTIONS[line]
        elif m := re.fullmatch(r"\{([\w.]*)(\[\])?\}", line):
            section = Segment(m[1], bool(m[2]))
            program.segments.append(section)
        elif section == "table":
            program.tables[table][1].append([literal(t) for t in re.findall(r'"(?:[^"\\]|\\.)*"|~|[^,\s]+', line)])
        elif section == "accumulators" and name.endswith("._persist"):
            if literal(value) is True:
                program.persistent.add(name[: -len("._persist")])
        elif section == "source":
            continue
        elif isinstance(section, str):
            getattr(program, section)[name] = literal(value)
        elif isinstance(section, Segment) and line[0] in ":_" and (m := re.match(r"[:_](\w+?)\d*(?:\s*=\s*|\s+|$)", line)) and m[1] in _DIRECTIVES:
            _direct(section, m[1], line[m.end() :].strip())
        elif isinstance(section, Segment):
            section.mappings.append(_mapping(name, value))
        else:
            raise ValueError(f"a line outside any section: {raw!r}")
    if block is not None:
        raise ValueError("a literal block isn't closed")
    return program


def _merge(program: Program, other: Program) -> None:
    """What is there already wins."""
    for part in ("constants", "tables", "accumulators", "target"):
        mine = getattr(program, part)
        mine.update({k: v for k, v in getattr(other, part).items() if k not in mine})
    program.persistent |= other.persistent
    own = {x.path for x in program.segments}
    program.segments += [x for x in other.segments if x.path not in own or not x.path]


def _direct(section: Segment, name: str, rest: str) -> None:
    rest = literal(rest) if rest[:1] == '"' else rest
    if name == "loop":
        path, _, alias = str(rest).partition(":as")
        section.loops.append((path.strip().lstrip("@"), alias.strip()))
    elif name == "from":
        section.start = str(rest).lstrip("@")
    elif name == "counter":
        section.counter = str(rest)
    elif name == "pass":
        section.number = int(literal(str(rest)))
    elif name in ("if", "elif", "else"):
        section.guard = (name, str(rest))
    else:
        section.body = section.body or ""


def _mapping(name: str, value: str) -> Mapping:
    if m := re.match(r":object\s*\{", value):
        depth, end = 1, m.end()
        while depth and end < len(value):
            depth += {"{": 1, "}": -1}.get(value[end], 0)
            end += 1
        inner = re.findall(r'(?:"(?:[^"\\]|\\.)*"|\{[^}]*\}|[^,"{])+', value[m.end() : end - 1])
        fields = [_mapping(k.strip(), v.strip()) for k, _, v in (x.partition("=") for x in inner if x.strip())]
        return Mapping(name, [], _split(_TOKEN.findall(value[end:]))[1], fields)
    tokens, modifiers = _split(_TOKEN.findall(value))
    if len(tokens) == 1 and re.match(r'"[%@]', tokens[0]):
        tokens, more = _split(_TOKEN.findall(literal(tokens[0])))
        modifiers = more + modifiers
    return Mapping(name, tokens, modifiers)


_MODIFIERS = {
    "upper": 0, "lower": 0, "trim": 0, "required": 0, "omitNull": 0, "omitEmpty": 0, "confidential": 0, "deprecated": 0, "date": 0, "timestamp": 0, "time": 0, "duration": 0, "array": 0, "raw": 0, "attr": 0, "cdata": 0, "truncate": 0,
    "maxLen": 1, "default": 1, "type": 1, "decimals": 1, "currencyCode": 1, "validate": 1, "enum": 1, "range": 1, "if": 3, "unless": 3, "pos": 1, "len": 1, "field": 1, "leftPad": 1, "rightPad": 1, "ns": 1, "element": 1,
}
#: Modifiers of a user, by name: (number of arguments, function(Typed, argument) -> Typed).
MODIFIERS: dict[str, tuple] = {}
#: Modifiers that shape what a writer makes of a field.
_SHAPE = ("attr", "ns", "cdata", "element", "pos", "len", "leftPad", "rightPad", "truncate", "currencyCode", "deprecated")


def _split(tokens):
    own, modifiers, k = [], [], 0
    while k < len(tokens):
        t = tokens[k]
        if t[0] == ":" and len(t) > 1:
            if t[1:] not in _MODIFIERS and t[1:] not in MODIFIERS:
                raise ValueError(f"no modifier {t}")
            n = _MODIFIERS[t[1:]] if t[1:] in _MODIFIERS else MODIFIERS[t[1:]][0]
            if t[1:] in ("if", "unless") and (k + 2 >= len(tokens) or tokens[k + 2][0] == ":"):
                n = 1
            modifiers.append((t[1:], " ".join(tokens[k + 1 : k + 1 + n])))
            k += 1 + n
        else:
            own.append(t)
            k += 1
    return own, modifiers


def literal(t: str):
    if t[:1] == '"':
        return re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t"}.get(m[1], m[1]), t[1:-1])
    if t == "~":
        return None
    if t.lstrip("?") in ("true", "false"):
        return t.lstrip("?") == "true"
    number = t.lstrip("#$%") if t[:1] == "#" else t
    if re.fullmatch(r"[+-]?\d+", number):
        return int(number)
    if re.fullmatch(r"[+-]?(\d+\.\d*|\.\d+|\d+)([eE][+-]?\d+)?", number):
        return float(number)
    return t


def kind_of(t: T.DataType) -> str:
    if isinstance(t, (T.IntegerType, T.LongType, T.ShortType, T.ByteType)):
        return "long"
    if isinstance(t, (T.DoubleType, T.FloatType, T.DecimalType)):
        return "double"
    return {T.BooleanType: "boolean", T.DateType: "date", T.TimestampType: "timestamp", T.ArrayType: "array", T.StructType: "object", T.MapType: "object"}.get(type(t), "string")


class Scope:
    """Names to typed Columns: the source's fields, loops' items and counters, constants, accumulators and tables."""

    def __init__(self, program: Program, schema: T.StructType, state: dict[str, Typed] | None = None):
        self.program, self.schema, self.state = program, schema, state or {}
        self.item: tuple[Column, T.DataType] | None = None
        self.aliases: dict[str, tuple[Column, T.DataType]] = {}
        self.counters: dict[str, Column] = {}
        self.depth = 0
        self.sequences: set[str] = set()

    def within(self, alias: str, counter: str | None, item: Column, element: T.DataType, index: Column) -> Scope:
        """The scope inside a loop."""
        out = Scope(self.program, self.schema, self.state)
        out.sequences = self.sequences
        out.item = (item, element)
        out.aliases = self.aliases | ({alias: out.item} if alias else {})
        out.counters = self.counters | {"_index": index.cast("long")} | ({counter: index.cast("long")} if counter else {})
        return out

    def resolve(self, p: str) -> tuple[Column, T.DataType] | None:
        """A path's Column and type; None for one that the source hasn't."""
        first = p.split(".")[0]
        if p.startswith(".") or p == "":
            if self.item is None:
                raise ValueError(f"@{p} outside a loop")
            (c, t), parts = self.item, [x for x in p.split(".") if x]
        elif first in self.aliases:
            (c, t), parts = self.aliases[first], [x for x in p.partition(".")[2].split(".") if x]
        else:
            parts = p.split(".")
            name = re.match(r"\w+", parts[0])[0]
            if name not in self.schema.fieldNames():
                return None
            c, t, parts = F.col(f"`{name}`"), self.schema[name].dataType, [parts[0][len(name) :], *parts[1:]]
        for part in parts:
            name, index = re.match(r"(\w*)((?:\[\d*\])*)", part).groups()
            if name:
                if isinstance(t, T.ArrayType) and isinstance(t.elementType, T.StructType):  # a field of every item
                    c, t = c[name], T.ArrayType(t.elementType[name].dataType)
                elif isinstance(t, T.MapType):
                    c, t = F.try_element_at(c, F.lit(name)), t.valueType
                elif isinstance(t, T.StructType) and name in t.fieldNames():
                    c, t = c[name], t[name].dataType
                else:
                    return None
            for i in re.findall(r"\[(\d+)\]", index):
                c, t = F.get(c, int(i)), t.elementType
        return c, t

    def path(self, p: str) -> Typed:
        if p.startswith("$const."):
            return _literal(self.program.constants[p[7:]])
        if p.startswith("$accumulator."):
            return self.state.get(p[13:], _literal(None))
        if p in self.counters:
            return Typed(self.counters[p], "long")
        found = self.resolve(p)
        return Typed(found[0], kind_of(found[1]), None, not isinstance(found[1], T.ArrayType) or isinstance(found[1].elementType, T.StructType)) if found else Typed(F.lit(None).cast("string"), "null")

    def interpolated(self, template: str, block: bool = False) -> Typed:
        """A text with ${@path} and ${%function ...} in it."""
        parts, at = [], 0
        for m in re.finditer(r"\\\$\{|\\\$|\\\\|\$\{([^}]*)\}" if block else r"\\\$\{[^}]+\}|\$\{([^}]+)\}", template):
            inner = m[1].strip() if m[1] is not None else ""
            if "${" in inner:
                raise ValueError(f"T014: {inner!r} nests an interpolation")
            parts.append(F.lit(template[at : m.start()]))
            if inner[:1] in "@%" and inner:
                t = self.evaluate(_TOKEN.findall(inner))
                parts.append(text(t.column, t.kind))
            else:
                parts.append(F.lit(m[0][1:] if m[0][0] == "\\" else m[0]))
            at = m.end()
        return Typed(F.concat(*parts, F.lit(template[at:])), "string")

    def evaluate(self, tokens: list[str]) -> Typed:
        out, rest = self._one(tokens)
        if rest:
            raise ValueError(f"left over: {rest}")
        return out

    def _one(self, tokens):
        if not tokens:
            raise ValueError("T002: an argument is missing")
        self.depth += 1
        if self.depth > DEEPEST:
            raise ValueError(f"T018: expressions nest deeper than {DEEPEST}")
        try:
            return self._expression(tokens)
        finally:
            self.depth -= 1

    def _expression(self, tokens):
        t, rest = tokens[0], tokens[1:]
        if t[0] == "@":
            return self.path(t[1:]), rest
        if t[0] != "%":
            value = literal(t)
            return (self.interpolated(value) if t[0] == '"' and "${" in value else _literal(value)), rest
        name = t[1:]
        if name in ("lookup", "lookupDefault"):
            return self._lookup(name, rest)
        if name == "expr":
            return Typed(formula(literal(rest[0]), lambda n: self.path(n).column.cast("double")), "double"), rest[1:]
        if name[0] == "&":
            args = []
            while rest:
                a, rest = self._one(rest)
                args.append(a)
            return (CUSTOM[name[1:]](*args) if name[1:] in CUSTOM else args[0] if args else _literal(None)), rest
        if name in ("accumulate", "set"):
            key, (value, rest) = literal(rest[0]), self._one(rest[1:])
            if key not in self.state:
                return _literal(None), rest
            old = self.state[key]
            self.state[key] = Typed(number(old.column, old.kind) + number(value.column, value.kind), "double") if name == "accumulate" else value
            return self.state[key], rest
        if name in ("sequence", "resetSequence"):
            return self._sequence(name, rest)
        if name not in FUNCTIONS:
            raise ValueError(f"T001: no function {name}")
        fn, args = FUNCTIONS[name], []
        while rest and (fn.arity < 0 or len(args) < fn.arity):
            a, rest = self._one(rest)
            args.append(a)
        if len(args) < fn.least:
            raise ValueError(f"T002: {name} takes {fn.least} arguments")
        return fn.build(*args), rest

    def _sequence(self, name, rest):
        """A named counter of the row: in a loop, it goes up by one an item."""
        key, rest = "#" + str(literal(rest[0])), rest[1:]
        given = None
        if rest:
            given, rest = self._one(rest)
        if name == "resetSequence":
            self.state[key] = Typed(F.floor(number(given.column, given.kind)).cast("long") if given else F.lit(0).cast("long"), "long")
            return self.state[key], rest
        first = F.floor(number(given.column, given.kind)).cast("long") if given else F.lit(1).cast("long")
        next_ = self.state[key].column + 1 if key in self.state else first
        if "_index" in self.counters:
            self.sequences.add(key)
            return Typed(next_ + self.counters["_index"], "long"), rest
        self.state[key] = Typed(next_, "long")
        return self.state[key], rest

    def _lookup(self, name, rest):
        table, _, column = rest[0].partition(".")
        columns, rows = self.program.tables[table]
        args, rest = [], rest[1:]
        while rest:
            a, rest = self._one(rest)
            args.append(a)
        default = args.pop() if name == "lookupDefault" else _literal(None)
        keys = [c for c in columns if c != column][: len(args)]
        # program tables are literals: a map over the joined key, first row first
        seen: dict[str, object] = {}
        for row in rows:
            cells = dict(zip(columns, row))
            seen.setdefault("\x1f".join("" if cells.get(k) is None else _said(cells.get(k)) for k in keys), cells.get(column))
        key = F.concat_ws("\x1f", *[text(a.column, a.kind) for a in args[: len(keys)]])
        kinds = {type(v) for v in seen.values() if v is not None}
        kind = "long" if kinds == {int} else "double" if kinds and kinds <= {int, float} else "boolean" if kinds == {bool} else "string"
        cast = {"string": "string", "long": "bigint"}.get(kind, kind)
        pairs = [x for k, v in seen.items() for x in (F.lit(k), F.lit(v if kind != "string" or v is None else _said(v)).cast(cast))]
        found = F.try_element_at(F.create_map(*pairs), key) if pairs else F.lit(None).cast(cast)
        if name == "lookupDefault":
            found = F.coalesce(found, default.column.cast(cast))
        return Typed(found, kind), rest


def _said(v) -> str:
    return str(v).lower() if isinstance(v, bool) else str(int(v)) if isinstance(v, float) and v == int(v) else str(v)


def _literal(value) -> Typed:
    kind = "null" if value is None else "boolean" if isinstance(value, bool) else "long" if isinstance(value, int) else "double" if isinstance(value, float) else "string"
    return Typed(F.lit(value), kind, value)


def _guard(scope: Scope, what: str) -> Column:
    """``path`` or ``path op literal``, or a function call."""
    what = what.strip()
    if what.startswith("%"):
        t = scope.evaluate(_TOKEN.findall(what))
        return condition(t.column, t.kind)
    m = re.fullmatch(r"@?([\w.\[\]$]+)\s*(==|!=|<=|>=|=|<|>)\s*(.+)", what)
    if m:
        return compare(scope.path(m[1]).column, m[2], literal(m[3].strip()))
    t = scope.path(what.lstrip("@"))
    return condition(t.column, t.kind)


def _modified(scope: Scope, m: Mapping, t: Typed) -> tuple[Typed, list[tuple[str, Column]], dict]:
    """A mapping's value after its modifiers, in their order; its checks, as (policy, code if it fails); its shape."""
    checks, shape, policy = [], {}, scope.program.target
    fixed = policy.get("format") == "fixed-width"
    for name, arg in m.modifiers:
        c, k = t.column, t.kind
        if name in MODIFIERS:
            t = MODIFIERS[name][1](t, literal(arg) if arg else None)
        elif name in _SHAPE and (fixed or name not in ("pos", "len")):
            shape[name] = literal(arg) if arg else True
        elif name == "pos":
            n = next((int(x) for y, x in m.modifiers if y == "len"), 1 << 30)
            t = Typed(F.substring(text(c, k), int(arg) + 1, n), "string")
        elif name == "field":
            t = Typed(F.get(F.split(text(c, k), re.escape(str(policy.get("delimiter", ",")))), int(arg)), "string")
        elif name in ("upper", "lower", "trim") and k == "string":
            t = Typed({"upper": F.upper, "lower": F.lower, "trim": S.trim}[name](c), k)
        elif name == "maxLen" and k == "string":
            t = Typed(F.substring(c, 1, int(arg)), k)
        elif name == "default":
            d = scope.evaluate([arg])
            t = Typed(F.coalesce(c, d.column.cast("string") if k == "string" else d.column), k if k != "null" else d.kind)
            checks = []
        elif name == "type":
            kind = {"integer": "long", "number": "double", "currency": "double", "percent": "double", "reference": "string", "binary": "string"}.get(arg, arg)
            t = Typed(c.cast("string").try_cast({"long": "bigint"}.get(kind, kind)) if kind != "string" else text(c, k), kind)
        elif name == "decimals":
            t = Typed(F.round(c.cast("double"), int(arg)), "double")
        elif name in ("date", "timestamp"):
            t = Typed(S.coerce_date(text(c, k)) if name == "date" and k == "string" else c.cast(name), name)
        elif name == "time":
            t = Typed(F.date_format(c.cast("timestamp"), "HH:mm:ss") if k in ("date", "timestamp") else F.regexp_extract(text(c, k), r"\d{2}:\d{2}(:\d{2})?", 0), "string")
        elif name == "duration":
            t = Typed(F.when(F.regexp_like(text(c, k), F.lit(r"^P(?=.)(\d+[YMWD])*(T(\d+(\.\d+)?[HMS])+)?$")), text(c, k)), "string")
        elif name == "raw":
            t = Typed(F.try_parse_json(text(c, k)), "variant")
        elif name == "if":
            t = Typed(F.when(_guard(scope, arg), c), k)
        elif name == "unless":
            t = Typed(F.when(~_guard(scope, arg), c), k)
        elif name == "array":
            t = Typed(F.array(c), "array")
        elif name == "omitEmpty":
            t = Typed(F.when(text(c, k) != "", c), k)
        elif name in ("validate", "enum", "range"):
            if name == "validate":
                ok = F.regexp_like(text(c, k), F.lit(literal(arg)))
            elif name == "enum":
                ok = text(c, k).isin(*[x.strip() for x in str(literal(arg)).split(",")])
            else:
                lo, hi = str(literal(arg)).split("..")
                ok = c.cast("double").between(float(lo), float(hi))
            bad = c.isNotNull() & ~F.coalesce(ok, F.lit(False))
            if policy.get("onValidation") == "skip":
                t = Typed(F.when(~bad, c), k)
            else:
                checks.append((policy.get("onValidation", "fail"), F.when(bad, F.lit("T013"))))
        elif name == "required":
            if policy.get("onMissing") not in ("skip", "default"):
                checks.append((policy.get("onMissing", "fail"), F.when(c.isNull(), F.lit("T005"))))
        elif name == "confidential":
            mode = policy.get("enforceConfidential", "mask")
            if mode != "none":
                t = Typed(F.repeat(F.lit("*"), F.length(c)) if k == "string" and mode == "mask" else F.lit(None).cast("string"), k)
    return t, checks, shape


def _value(scope: Scope, m: Mapping) -> tuple[Typed, list, dict]:
    if m.fields:
        own = [(f.target, *_value(scope, f)) for f in m.fields]
        t, checks, shape = _modified(scope, m, Typed(F.struct(*[t.column.alias(n) for n, t, _, _ in own]), "object"))
        return t, [c for _, _, more, _ in own for c in more] + checks, shape
    return _modified(scope, m, scope.evaluate(m.tokens))


def _named(c: Column, name: str, shape: dict) -> Column:
    return c.alias(name, metadata=shape) if shape else c.alias(name)


class _Loops:
    """A segment's loops over a scope."""

    def __init__(self, segment: Segment, scope: Scope):
        self.segment, self.scope = segment, scope

    def over(self, make, level: int = 0, scope: Scope | None = None) -> Column:
        """An array of make(scope of the innermost item), depth first."""
        scope, loops = scope or self.scope, self.segment.loops
        path, alias = loops[level]
        path = self.segment.start if level == 0 and self.segment.start else path
        found = scope.resolve(path)
        if found is None:
            return F.array()
        c, t = found
        if not isinstance(t, T.ArrayType):
            raise ValueError(f"T009: {path!r} is no array")
        last = level + 1 == len(loops)

        def each(x, i):
            inside = scope.within(alias, self.segment.counter if last else None, x, t.elementType, i)
            return make(inside) if last else self.over(make, level + 1, inside)

        out = F.transform(F.coalesce(c, F.array().cast(t)), each)
        return out if last else F.flatten(out)

    def total(self, make) -> Column:
        return F.aggregate(self.over(make), F.lit(0.0), lambda a, x: a + x)


def _looped(segment: Segment, scope: Scope) -> Column | None:
    """The rows of a segment with loops; its accumulators go on in the scope's state."""
    loops, running = _Loops(segment, scope), {}
    for m in segment.mappings:
        if m.tokens[:1] == ["%accumulate"] and literal(m.tokens[1]) in scope.state:
            key = literal(m.tokens[1])
            make = lambda inside, m=m: (lambda v: number(v.column, v.kind))(inside.evaluate(m.tokens[2:]))
            old = number(scope.state[key].column, scope.state[key].kind)
            running[m.target, key] = (old, loops.over(make))
            scope.state[key] = Typed(old + loops.total(make), "double")
    if segment.silent:
        return None
    if segment.body is not None:
        return F.flatten(loops.over(lambda inside: F.split(inside.interpolated(segment.body, True).column, "\n")))
    if running and len(segment.loops) > 1:
        raise ValueError("running totals are emitted in single loops only")

    def value(inside, m):
        key = next((k for t, k in running if t == m.target and m.tokens[:1] == ["%accumulate"]), None)
        if key is None:
            return _value(inside, m)
        old, values = running[m.target, key]
        return _modified(inside, m, Typed(old + F.aggregate(F.slice(values, 1, (inside.counters["_index"] + 1).cast("int")), F.lit(0.0), lambda a, x: a + x), "double"))

    shown = [m for m in segment.mappings if not m.target.startswith("_") or m.target == "_"]

    def row(inside):
        own = [(m.target, *value(inside, m)) for m in shown]
        return own[0][1].column if len(own) == 1 and own[0][0] == "_" else F.struct(*[_named(t.column, n, shape) for n, t, _, shape in own])

    out = loops.over(row) if shown else None
    for key in scope.sequences:  # used in the loop: it has gone up by as many as there were items
        if len(segment.loops) > 1:
            raise ValueError("sequences go up in single loops only")
        m = next(m for m in segment.mappings if "%sequence" in m.tokens and "#" + str(literal(m.tokens[m.tokens.index("%sequence") + 1])) == key)
        at = m.tokens.index("%sequence")
        scope.counters.pop("_index", None)
        first = scope._sequence("sequence", m.tokens[at + 1 :])[0].column
        scope.state[key] = Typed(first + F.size(out) - 1, "long")
    return out


def apply(program: Program | str, df: DataFrame, load=None) -> DataFrame:
    """The program's output: a column for each segment (the root segment's mappings stand by themselves) and, if any
    mapping can fail, ``errors``, and ``warnings`` where the target's policies say so: the codes and targets of what did."""
    program = parse(program, load) if isinstance(program, str) else program
    outputs: dict[str, Column] = {}
    failed: dict[str, list[Column]] = {"fail": [], "warn": []}
    taken: Column | None = None  # whether a branch of the running if/elif/else chain was taken
    initial = {k: _literal(v) for k, v in program.accumulators.items()}
    state, number_, named = dict(initial), None, set()
    for segment in sorted(program.segments, key=lambda s: (s.number == 0, s.number)):
        if number_ is not None and segment.number != number_:
            state = {k: v if k in program.persistent else initial[k] for k, v in state.items()}
        number_ = segment.number
        scope = Scope(program, df.schema, dict(state))
        when = None
        if segment.guard:
            word, what = segment.guard
            own = F.lit(True) if word == "else" else _guard(scope, what)
            if word != "if" and taken is None:
                raise ValueError(f"T012: {word} without an if before it")
            when = own if word == "if" else ~taken & own
            taken = own if word == "if" else taken | own
        else:
            taken = None

        if segment.loops:
            value = _looped(segment, scope)
        elif segment.body is not None:
            value = F.split(scope.interpolated(segment.body, True).column, "\n")
        else:
            value, shown = None, []
            for m in segment.mappings:
                t, checks, shape = _value(scope, m)
                for policy, code in checks:
                    at = F.struct(code.alias("code"), F.lit(f"{segment.path}.{m.target}".lstrip(".")).alias("field"))
                    failed["warn" if policy == "warn" else "fail"].append(F.when(code.isNotNull() & (when if when is not None else F.lit(True)), at))
                if not m.target.startswith("_"):
                    shown.append((m.target, t.column, shape))
            if not segment.path:
                for n, c, shape in shown:
                    outputs[n] = _named(F.when(when, c) if when is not None else c, n, shape)
                    named.add(n)
            elif shown and not segment.silent:
                value = F.struct(*[_named(c, n, shape) for n, c, shape in shown])
        for k, t in scope.state.items():
            if t is not state.get(k):
                state[k] = Typed(F.when(when, t.column).otherwise(state[k].column.cast("double") if t.kind == "double" else state[k].column), t.kind) if when is not None else t
        if value is not None and segment.path and not segment.silent:
            value = F.when(when, value) if when is not None else value
            outputs[segment.path] = F.coalesce(outputs[segment.path], value) if when is not None and segment.path in outputs else value
    out = [c if n in named else c.alias(n) for n, c in outputs.items()]
    for name, found in (("errors", failed["fail"]), ("warnings", failed["warn"])):
        if found:
            out.append(F.array_compact(F.array(*found)).alias(name))
    return df.select(*out)


def layout(program: Program | str, path: str = "") -> list[dict]:
    """Fields of a fixed-width line, as the writer takes them, by the :pos and :len of a segment's mappings."""
    program = parse(program) if isinstance(program, str) else program
    out = []
    for m in next(s for s in program.segments if s.path == path).mappings:
        own = dict(m.modifiers)
        if "len" in own:
            pad = literal(own.get("leftPad") or own.get("rightPad") or '" "')
            side = {"left": True} if "leftPad" in own else {"left": False} if "rightPad" in own else {}
            out.append({"name": m.target, "len": int(own["len"]), "pos": int(own.get("pos", 0)), "pad": str(pad), "truncate": "truncate" in own, **side})
    return sorted(out, key=lambda f: f["pos"])
