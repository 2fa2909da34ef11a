"""Schemas as text: ``name = [! ~ * -] type [constraints] [default]`` lines under headers, to the rules that validation compiles.

Types: nothing or ``""`` for text, ``?`` boolean, ``##`` integer, ``#`` or ``#.4`` number, ``#$`` currency, ``#%`` percent, ``date``, ``timestamp``, ``time``,
``duration``, ``@`` reference, ``^`` binary, ``(a, b)`` an enum, and unions of these by ``|``. Constraints: ``:(1..10)`` bounds, ``:/pattern/``,
``:format name``, ``:unique``, ``:if field op value``, ``:unless ...``. ``{@name}`` defines a type, ``name = @type`` or a header ``{x : @a & @b}`` takes its fields. ``{tags[]}`` with
``:(1..10):unique`` below it bounds an array. ``:invariant formula``, ``:of (1..2) a, b``, ``:one_of a, b``, ``:exactly_one a, b`` and ``:at_most_one a, b`` hold over an object.
"""

from __future__ import annotations

import re
from dataclasses import replace

from ..operators.validate import Field, Schema
from .notation import read_value

_TYPES = {"": "string", "?": "boolean", "##": "integer", "#": "number", "#$": "currency", "#%": "percent", "@": "reference", "^": "binary", "~": "null"}
_NAMED = ("string", "boolean", "integer", "number", "currency", "percent", "date", "timestamp", "time", "duration", "reference", "binary")
_CONSTRAINT = re.compile(r":(?:\(([^)]*)\)|/((?:[^/\\]|\\.)*)/|format\s+([\w-]+)|(unique|computed|immutable|deprecated)|(if|unless)\s+([\w.]+)\s*(!=|>=|<=|=|>|<)\s*(\"[^\"]*\"|\S+))")


def _end(raw: str):
    """A bound as a number or text."""
    raw = raw.strip()
    if raw == "":
        return None
    number = raw.lstrip("#$%")
    return int(number) if re.fullmatch(r"-?\d+", number) else float(number) if re.fullmatch(r"-?\d*\.\d+", number) else raw


def bounds(raw: str) -> tuple:
    low, dots, high = raw.partition("..")
    return (_end(low), _end(high)) if dots else (_end(low), _end(low))


def field_of(name: str, raw: str) -> Field:
    """A field's rules from what stands after its name."""
    flags = ""
    while raw[:1] in "!~*-" and raw[:1]:
        flags, raw = flags + raw[0], raw[1:].lstrip()
    f = Field(name, required="!" in flags, nullable="~" in flags, deprecated="-" in flags)
    found = list(_CONSTRAINT.finditer(raw))
    kind = raw[: found[0].start()].strip() if found else raw.strip()
    for m in found:
        if m[1] is not None:
            f.bounds = bounds(m[1])
        elif m[2] is not None:
            f.pattern = m[2].replace("\\/", "/")
        elif m[3]:
            f.format = m[3]
        elif m[4]:
            f.unique, f.deprecated = f.unique or m[4] == "unique", f.deprecated or m[4] == "deprecated"
        else:
            setattr(f, {"if": "when", "unless": "unless"}[m[5]], (m[6], m[7], m[8].strip('"')))
    if f.when or f.unless:
        f.required = "!" in flags
    if m := re.match(r"\(([^)]*)\)", kind):
        f.enum, kind = tuple(x.strip().strip('"') for x in m[1].split(",")), kind[m.end() :].strip()
    kinds, default = [], None
    for part in kind.split("|"):
        part = part.strip()
        word = re.match(r'(##|#\$|#%|#(?:\$?\.\d+)?|\?|\^|"")(?![\w$%])|(' + "|".join(_NAMED) + r")\b|$", part)
        if word:
            own = re.sub(r"\.\d+$", "", word[1] or "").replace('""', "") if word[1] else None
            kinds.append(_TYPES[own] if own is not None else word[2] or "string")
            default = part[word.end() :].strip() or default
        elif part == "~":
            f.nullable = True
        elif part.startswith("@") and len(part) > 1:
            kinds.append(part)
        else:
            kinds.append(read_value(part)[0])
            default = part
    f.type = kinds[0] if kinds else "string"
    f.members = tuple(kinds) if len(kinds) > 1 else ()
    if default:
        is_, said = read_value(default)
        f.default = int(said) if is_ == "integer" else float(said) if is_ == "number" else said
    return f


def parse_schema(source: str, load=None) -> Schema:
    """The schema of a text. load(name): the text of an imported one."""
    types: dict[str, list[Field]] = {}
    out, prefix, own, array = Schema([]), "", None, None
    for raw in source.splitlines():
        line = re.sub(r'^((?:[^";]|"(?:[^"\\]|\\.)*")*);.*$', r"\1", raw).strip()
        if not line:
            continue
        if m := re.fullmatch(r'@import\s+"([^"]+)".*', line):
            out = parse_schema(load(m[1]), load).extended(out)
        elif m := re.fullmatch(r"\{@?(\$[\w.]*|[\w.]*)(\[\])?(?:\s*:\s*(.*))?\}", line):
            array = None
            if line.startswith("{@"):
                own = types.setdefault(m[1], [])
            else:
                own, prefix = None, m[1]
            for base in re.findall(r"@([\w.]+)", m[3] or ""):
                for f in types[base]:
                    (own if own is not None else out.fields).append(f if own is not None else replace(f, name=_under(prefix, f.name)))
            if m[2]:
                array = Field(prefix, "array")
                out.fields.append(array)
        elif prefix.startswith("$"):
            continue
        elif array is not None and (m := re.fullmatch(r"(?::\(([^)]*)\))?(:unique)?", line)) and line:
            low, high = bounds(m[1]) if m[1] else (None, None)
            array.items = (low or 0, high if high is not None else 1 << 30) if m[1] else None
            array.unique = bool(m[2])
        elif m := re.fullmatch(r":invariant\s+(.+)", line):
            out.invariants.append(re.sub(r"\b([A-Za-z_]\w*)\b(?!\s*\()", lambda x: x[1] if x[1] in ("true", "false") else _under(prefix, x[1]), m[1]))
        elif m := re.fullmatch(r":(of\s*\(([^)]*)\)|one_of|exactly_one|at_most_one)\s+(.+)", line):
            names = tuple(_under(prefix, x.strip()) for x in m[3].split(","))
            low, high = bounds(m[2]) if m[2] is not None else {"one_of": (1, None), "exactly_one": (1, 1), "at_most_one": (0, 1)}[m[1]]
            out.one_of.append((names, low or 0, len(names) if high is None else high))
        elif (m := re.fullmatch(r"([!~*-]*)([\w.-]+)\s*[=:]\s*(.*)", line)) and array is None:
            f = field_of(m[2], m[1] + m[3])
            target = own if own is not None else out.fields
            if f.type.startswith("@") and own is None:
                target += [replace(x, name=_under(prefix, f"{f.name}.{x.name}")) for x in types[f.type[1:]]]
            else:
                target.append(f if own is not None else replace(f, name=_under(prefix, f.name), when=_there(prefix, f.when), unless=_there(prefix, f.unless)))
        elif array is None:
            raise ValueError(f"V017: can't read {line!r}")
    return out


def _under(prefix: str, name: str) -> str:
    return f"{prefix}.{name}" if prefix else name


def _there(prefix: str, rule: tuple | None) -> tuple | None:
    return (_under(prefix, rule[0]), *rule[1:]) if rule else None


def write_schema(schema: Schema) -> str:
    """The text of a schema's fields and rules, which reads back as the same."""
    names = {v: k for k, v in _TYPES.items()}
    out = ["{}"]
    for f in (x for x in schema.fields if x.type != "array"):
        flags = "!" * f.required + "~" * f.nullable + "-" * f.deprecated
        kind = "(" + ", ".join(map(str, f.enum)) + ")" if f.enum else "|".join(names.get(k, k) for k in f.members) if f.members else names.get(f.type, f.type)
        more = [f":({'' if f.bounds[0] is None else f.bounds[0]}..{'' if f.bounds[1] is None else f.bounds[1]})"] if f.bounds else []
        more += [":/" + f.pattern.replace("/", "\\/") + "/"] if f.pattern else []
        more += [f":format {f.format}"] if f.format else []
        more += [f":{word} {rule[0]} {rule[1]} {rule[2]}" for word, rule in (("if", f.when), ("unless", f.unless)) if rule]
        out.append(f"{f.name} = {flags}{kind}{''.join(more)}")
    out += [f":invariant {x}" for x in schema.invariants]
    out += [f":of ({a}..{b}) {', '.join(n)}" for n, a, b in schema.one_of]
    return "\n".join(out) + "\n"
