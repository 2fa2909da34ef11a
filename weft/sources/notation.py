"""The native notation: documents of typed paths, read into rows and written back, plainly or in canonical form.

A document is lines ``path = value``. A header ``{a.b}`` goes before the paths that follow; ``{.c}`` is relative to the last header that
isn't; ``{}`` is the root, ``{$}`` and ``{$name}`` hold metadata. ``{items[] : sku, qty}`` begins a table, a row a line;
``{tags[] : ~}`` a list of plain values, a value a line. Values: ``"text"`` (or three quotes around lines), ``##1`` whole numbers, ``#1.5``
numbers, ``#$9.50:EUR`` currency, ``#%5`` percent, ``?true`` or ``true``, ``~`` null, ``@path`` references, ``^data`` binary, dates, timestamps,
times, durations and ``%verb`` expressions; ``!`` (required), ``*`` (confidential) and ``-`` (deprecated) stand before a value. ``;`` begins a comment, ``---``
the next document.

As rows: (document, path, kind, value as text, required, confidential, deprecated). Errors have the codes P001 and up.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.frames import spread

#: Segments of a path, and the index of an array, at most.
DEEPEST, GREATEST_INDEX = 64, 1_000_000
FLAGS = ("required", "confidential", "deprecated")
_MARKS = dict(zip("!*-", FLAGS))
_ESCAPES = {"n": "\n", "r": "\r", "t": "\t", '"': '"', "\\": "\\", "/": "/", "0": "\0"}
_PATH = re.compile(r"^(\$|&?[\w-]+|@[\w-]+)?(\[\d+\])*(\.(&?[\w-]+|\$?\w+)(\[\d+\])*)*$")
#: Values told by their form, in the order they are tried.
_FORMS = (
    ("timestamp", re.compile(r"\d{4}-\d{2}-\d{2}T\d{2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:?\d{2})?$")),
    ("date", re.compile(r"\d{4}-\d{2}-\d{2}$")),
    ("time", re.compile(r"T\d{2}:\d{2}(:\d{2}(\.\d+)?)?$")),
    ("duration", re.compile(r"P(?=.)(\d+[YMWD])*(T(\d+(\.\d+)?[HMS])+)?$")),
)
_NUMBER = re.compile(r"[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$")


class NotationError(ValueError):
    def __init__(self, code: str, what: str, line: int):
        super().__init__(f"{code}: {what} (line {line})")
        self.code, self.line = code, line


@dataclass
class Entry:
    path: str
    kind: str
    value: str | None
    flags: frozenset = frozenset()


def _uncommented(line: str) -> str:
    if ";" not in line:
        return line.strip()
    return re.sub(r'^((?:[^";]|"(?:[^"\\]|\\.)*")*);.*$', r"\1", line).strip()


def _text(body: str, line: int) -> str:
    def one(m):
        if m[1]:
            return chr(int(m[1], 16))
        if m[2] not in _ESCAPES:
            raise NotationError("P005", f"no escape \\{m[2]}", line)
        return _ESCAPES[m[2]]

    return re.sub(r"\\(?:u([0-9a-fA-F]{4})|(.))", one, body, flags=re.S)


def read_value(raw: str, line: int = 0) -> tuple[str, str | None]:
    """(kind, text) of a value."""
    if raw[:1] == '"':
        m = re.fullmatch(r'"((?:[^"\\]|\\.)*)"', raw, re.S)
        if not m:
            raise NotationError("P004", "a text isn't closed", line)
        return "string", _text(m[1], line)
    if raw == "~":
        return "null", None
    if raw.lstrip("?") in ("true", "false") and raw.count("?") <= 1:
        return "boolean", raw.lstrip("?")
    for prefix, kind in (("##", "integer"), ("#$", "currency"), ("#%", "percent"), ("#", "number")):
        if raw.startswith(prefix):
            number, _, code = raw[len(prefix) :].partition(":")
            if not _NUMBER.match(number) or (kind == "integer" and not re.fullmatch(r"[+-]?\d+", number)) or (code and (kind != "currency" or not re.fullmatch(r"[A-Za-z]{3}", code))):
                raise NotationError("P006", f"no {kind}: {raw}", line)
            return kind, number + (f":{code.upper()}" if code else "")
    for prefix, kind in (("@", "reference"), ("^", "binary"), ("%", "verb")):
        if raw.startswith(prefix):
            return kind, raw[1:]
    for kind, form in _FORMS:
        if form.match(raw):
            return kind, raw
    raise NotationError("P001", f"no value: {raw[:40]!r}", line)


def _flagged(raw: str) -> tuple[str, frozenset]:
    flags = set()
    while raw[:1] in _MARKS and raw[:1] and not re.match(r"-\d", raw):
        flags.add(_MARKS[raw[0]])
        raw = raw[1:].lstrip()
    return raw, frozenset(flags)


def _cells(line: str) -> list[str]:
    """The cells of a table's row: commas inside quotes part nothing."""
    return [m.strip() for m in re.findall(r'(?:^|,)((?:[^",]|"(?:[^"\\]|\\.)*")*)', line)]


#: Characters of a line or of lines that belong together, and bytes of a stream, at most.
PENDING, WHOLE = 10_000_000, 100_000_000


def _logical(lines):
    """(number, line) with texts between three quotes made one line, from any source of lines."""
    body, head, began = None, "", 0
    for number, raw in enumerate(lines, 1):
        if body is not None:
            end = raw.rstrip()
            if end.endswith('"""'):
                body += [end[:-3]] if end[:-3].strip() else []
                yield began, head + json.dumps("\n".join(body), ensure_ascii=False)
                body = None
            else:
                body.append(raw)
                if sum(map(len, body)) > PENDING:
                    raise NotationError("P011", "a text is too long", began)
        elif (m := re.match(r'^([^";]*=\s*[!*-]*\s*)"""(.*)$', raw)) and '"""' not in m[2]:
            body, head, began = [m[2]] if m[2] else [], m[1], number
        else:
            yield number, raw
    if body is not None:
        raise NotationError("P004", "a text isn't closed", began)


def events(lines):
    """What a source of lines holds, as it comes: ("entry", Entry) for each, ("end", None) after each document. Only the paths taken are
    kept, to know repeated ones and the indices of arrays."""
    document = _Document()
    for number, raw in _logical(lines):
        if raw.strip() == "---":
            document.close()
            yield "end", None
            document = _Document()
            continue
        line = _uncommented(raw)
        if line:
            document.take(line, number)
            yield from (("entry", e) for e in document.entries)
            document.entries.clear()
    document.close()
    yield "end", None


def lines_of(chunks):
    """Lines of a stream of bytes, whose chunks may end anywhere, inside a character too."""
    import codecs

    decoder, pending, size = codecs.getincrementaldecoder("utf-8")(), "", 0
    for chunk in (*chunks, None):
        size += len(chunk or b"")
        try:
            pending += decoder.decode(chunk or b"", chunk is None)
        except UnicodeDecodeError as e:
            raise NotationError("P012", "no UTF-8", 0) from e
        *whole, pending = pending.split("\n")
        yield from whole
        if len(pending) > PENDING or size > WHOLE:
            raise NotationError("P011", "too long", 0)
    if pending:
        yield pending


def parse(source: str) -> list[list[Entry]]:
    """The documents of a text, each as its entries in the order they stand."""
    documents: list[list[Entry]] = [[]]
    for what, entry in events(source.splitlines()):
        if what == "entry":
            documents[-1].append(entry)
        else:
            documents.append([])
    return documents[:-1]


class _Document:
    def __init__(self):
        self.entries: list[Entry] = []
        self.taken: dict[str, int] = {}
        self.prefix = self.base = ""
        self.columns: list[str] | None = None  # of a table; empty for a list of plain values
        self.table, self.rows = "", 0

    def take(self, line: str, number: int) -> None:
        if line[0] == "{":
            self._header(line, number)
        elif line[0] == "@" and re.match(r"@(import|schema|if)\b", line):
            return  # directives are the resolver's
        elif self.columns is not None and not re.match(r"[\w.$&\[\]-]+\s*=", line):
            self._row(line, number)
        else:
            self.columns = None
            path, eq, raw = line.partition("=")
            if not eq:
                raise NotationError("P001", f"no assignment: {line[:40]!r}", number)
            path = path.strip()
            raw, flags = _flagged(raw.strip())
            kind, value = read_value(raw, number)
            self.add(f"{self.prefix}.{path}" if self.prefix and path[0] != "[" else self.prefix + path, kind, value, flags, number)

    def _header(self, line: str, number: int) -> None:
        m = re.fullmatch(r"\{([^:{}]*?)(?:\s*:\s*(.*?))?\}", line)
        if not m:
            raise NotationError("P008", f"no header: {line[:40]!r}", number)
        name, columns = m[1].strip(), m[2]
        self.columns = None
        if name.startswith("."):
            name = self.base + name if self.base else name[1:]
        elif name == "$":
            self.base = name
        elif name.startswith("$"):
            name = self.base = "$." + name[1:]
        else:
            self.base = name.removesuffix("[]")
        if columns is not None:
            if not name.endswith("[]"):
                raise NotationError("P008", "a table's header names an array", number)
            self.table, self.rows = name[:-2], 0
            self.columns = [] if columns.strip() == "~" else [c.strip() for c in columns.split(",")]
            own = ""
            for k, c in enumerate(self.columns):  # .x is relative to the column before
                own = c.rpartition(".")[0] if not c.startswith(".") else own
                self.columns[k] = (own + c).lstrip(".")
        self.prefix = name.removesuffix("[]")

    def _row(self, line: str, number: int) -> None:
        at = f"{self.table}[{self.rows}]"
        cells = _cells(line)
        if not self.columns:
            raw, flags = _flagged(cells[0])
            self.add(at, *read_value(raw, number), flags, number)
        elif len(cells) > len(self.columns):
            raise NotationError("P001", "more cells than columns", number)
        else:
            for c, cell in zip(self.columns, cells):
                if cell:  # an empty cell is absent
                    raw, flags = _flagged(cell)
                    self.add(f"{at}.{c}", *read_value(raw, number), flags, number)
        self.rows += 1

    def add(self, path: str, kind: str, value: str | None, flags: frozenset, number: int) -> None:
        if not _PATH.match(path):
            raise NotationError("P002", f"no path: {path!r}", number)
        if path.count(".") + path.count("[") >= DEEPEST:
            raise NotationError("P010", "too deep", number)
        if any(int(i) > GREATEST_INDEX for i in re.findall(r"\[(\d+)\]", path)):
            raise NotationError("P015", f"too great an index in {path!r}", number)
        if path in self.taken:
            raise NotationError("P007", f"{path!r} has a value already", number)
        self.taken[path] = number
        self.entries.append(Entry(path, kind, value, flags))

    def close(self) -> None:
        """Arrays' indices go up from 0."""
        seen: dict[str, set[int]] = {}
        for path in self.taken:
            for m in re.finditer(r"\[(\d+)\]", path):
                seen.setdefault(path[: m.start()], set()).add(int(m[1]))
        for path, indices in seen.items():
            if max(indices) + 1 != len(indices):
                raise NotationError("P013", f"{path!r} leaves out an index", max(self.taken.values()))


def _written(e: Entry) -> str:
    marks = "".join(m for m, f in _MARKS.items() if f in e.flags)
    prefix = {"integer": "##", "number": "#", "currency": "#$", "percent": "#%", "reference": "@", "binary": "^", "verb": "%"}
    if e.kind == "string":
        value = '"' + re.sub(r'[\\"\n\r\t]', lambda m: "\\" + {"\n": "n", "\r": "r", "\t": "t"}.get(m[0], m[0]), e.value) + '"'
    else:
        value = {"null": "~", "boolean": f"?{e.value}"}.get(e.kind, prefix.get(e.kind, "") + (e.value or ""))
    return marks + value


def serialize(entries: list[Entry]) -> str:
    """A document's text: a header for each object, its plain fields below it."""
    out, at = [], ""
    for e in entries:
        head, dot, leaf = e.path.rpartition(".")
        if e.path.endswith("]") and not re.search(r"\]\.\w+$", e.path):
            head, leaf = "", e.path
        if head != at:
            out.append("{" + ("$" if head == "$" else head) + "}")
            at = head
        out.append(f"{leaf} = {_written(e)}")
    return "\n".join(out) + ("\n" if out else "")


#: Rows handed on at once, or more by one text's.
BATCH = 20_000
ROWS = "document int, path string, kind string, value string, required boolean, confidential boolean, deprecated boolean, error string"


def read(texts: DataFrame, key: str, text: str) -> DataFrame:
    """(key, ROWS): a row an entry; a text that can't be read has one row, with the error."""
    kind = dict(texts.dtypes)[key]

    def run(batches):
        import pyarrow as pa

        types = [pa.int32(), *[pa.string()] * 3, *[pa.bool_()] * len(FLAGS), pa.string()]
        names = [key, *[c.split()[0] for c in ROWS.split(", ")]]

        def made(keys, at, rows):
            return pa.RecordBatch.from_arrays([keys.take(pa.array(at, pa.int64())), *[pa.array(c, t) for c, t in zip(zip(*rows), types)]], names)

        for batch in batches:
            keys, at, rows = batch.column(0), [], []
            for k, t in enumerate(batch.column(1)):
                try:
                    new = [(n, e.path, e.kind, e.value, *[f in e.flags for f in FLAGS], None) for n, d in enumerate(parse(t.as_py() or "")) for e in d]
                except NotationError as e:
                    new = [(0, None, None, None, False, False, False, str(e))]
                rows += new
                at += [k] * len(new)
                if len(rows) >= BATCH:
                    yield made(keys, at, rows)
                    at, rows = [], []
            if rows:
                yield made(keys, at, rows)

    return spread(texts.select(key, text)).mapInArrow(run, f"`{key}` {kind}, {ROWS}")


def from_json(texts: DataFrame, key: str, text: str) -> DataFrame:
    """(key, path, kind, value) of a JSON text's leaves, typed as the notation types them."""
    kind = dict(texts.dtypes)[key]

    def leaves(v, path):
        if isinstance(v, dict):
            for k, x in v.items():
                yield from leaves(x, f"{path}.{k}" if path else k)
        elif isinstance(v, list):
            for k, x in enumerate(v):
                yield from leaves(x, f"{path}[{k}]")
        else:
            is_ = "null" if v is None else "boolean" if isinstance(v, bool) else "integer" if isinstance(v, int) else "number" if isinstance(v, float) else "string"
            yield path, is_, None if v is None else str(v).lower() if isinstance(v, bool) else str(v)

    def run(batches):
        import pandas as pd

        for pdf in batches:
            rows = [(k, *leaf) for k, t in zip(pdf[key], pdf[text]) for leaf in leaves(json.loads(t), "")]
            yield pd.DataFrame(rows, columns=[key, "path", "kind", "value"])

    return spread(texts.select(key, text)).mapInPandas(run, f"`{key}` {kind}, path string, kind string, value string")


def from_rows(df: DataFrame, key: str) -> DataFrame:
    """(key, path, kind, value) of a table's rows, typed by its columns; structs, maps and arrays give a row a leaf."""
    from ..operators.documents import leaves

    kinds = {"string": "string", "boolean": "boolean", "date": "date", "timestamp": "timestamp"} | dict.fromkeys(("tinyint", "smallint", "int", "bigint"), "integer") | dict.fromkeys(("float", "double"), "number")

    def leaf(c, t, at):
        kind = "currency" if t.simpleString().startswith("decimal") else "binary" if t.simpleString() == "binary" else kinds.get(t.simpleString(), "string")
        said = F.base64(c) if kind == "binary" else F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'") if kind == "timestamp" else c.cast("string")
        return F.array(F.struct(at.alias("path"), F.when(c.isNull(), "null").otherwise(kind).alias("kind"), said.alias("value")))

    every = F.concat(*[leaves(F.col(f.name), f.dataType, F.lit(f.name), leaf, "array<struct<path:string,kind:string,value:string>>") for f in df.schema.fields if f.name != key])
    return df.select(key, F.explode(every).alias("e")).select(key, "e.*")


# ---- canonical form, by Column expressions ------------------------------------------------------------------


def path_key(path: Column) -> Column:
    """What canonical order sorts by: metadata first, names by their characters, indices by number, extensions last."""
    parts = F.split(F.regexp_replace(path, r"\[(\d+)\]", ".[$1"), r"\.")

    def one(p):
        index = F.when(F.startswith(p, F.lit("[")), F.substring(p, 2, 20)).try_cast("long")
        rank = F.when(F.startswith(p, F.lit("$")), 0).when(F.startswith(p, F.lit("&")), 3).when(index.isNotNull(), 1).otherwise(2)
        return F.struct(rank.alias("r"), F.coalesce(index, F.lit(0).cast("long")).alias("i"), p.alias("p"))

    return F.transform(parts, one)


def canonical_value(kind: Column, value: Column) -> Column:
    plain = F.when(F.contains(value, F.lit(".")) & ~F.regexp_like(value, F.lit("[eE]")), F.regexp_replace(value, r"\.?0+$", "")).otherwise(value)
    amount, code = F.substring_index(value, ":", 1), F.upper(F.regexp_extract(value, ":(.*)$", 1))
    cents = F.rpad(F.regexp_extract(amount, r"\.(\d*)$", 1), 2, "0")
    fraction = F.regexp_extract(amount, r"\.(\d*)$", 1)
    money = F.concat(F.lit("#$"), F.substring_index(amount, ".", 1), F.lit("."), F.when(F.length(fraction) < 2, cents).otherwise(fraction), F.when(code == "", "").otherwise(F.concat(F.lit(":"), code)))
    quoted = value
    for a, b in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        quoted = F.replace(quoted, F.lit(a), F.lit(b))
    out = F.when(kind == "null", F.lit("~")).when(kind == "string", F.concat(F.lit('"'), quoted, F.lit('"'))).when(kind == "number", F.concat(F.lit("#"), plain)).when(kind == "currency", money)
    for k, prefix in {"integer": "##", "percent": "#%", "reference": "@", "binary": "^", "verb": "%"}.items():
        out = out.when(kind == k, F.concat(F.lit(prefix), value))
    return out.otherwise(value)


def canonical(rows: DataFrame, key: str) -> DataFrame:
    """(key, text, hash) of each document: its lines in canonical order, and their SHA-256."""
    marks = F.concat(F.lit(""), *[F.when(F.coalesce(F.col(f), F.lit(False)), m).otherwise("") for m, f in _MARKS.items() if f in rows.columns])
    line = F.concat(F.col("path"), F.lit(" = "), marks, canonical_value(F.col("kind"), F.col("value")), F.lit("\n"))
    sorted_ = F.sort_array(F.collect_list(F.struct(path_key(F.col("path")).alias("k"), line.alias("line"))))
    text = F.array_join(F.transform(sorted_, lambda x: x["line"]), "")
    return rows.where("path is not null").groupBy(key).agg(text.alias("text")).withColumn("hash", F.sha2("text", 256))
