"""Text formats to DataFrames. Files are read and split by Spark; fields are found by Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.frames import spread


def inferred(c: Column) -> Column:
    """A cell's typed reading: struct of the kind and the value as a boolean, number or text."""
    s = F.trim(c)
    return F.struct(
        F.when(s.isNull() | (s == ""), "null").when(s.isin("true", "false"), "boolean").when(F.regexp_like(s, F.lit(r"^-?\d+$")), "integer").when(F.regexp_like(s, F.lit(r"^-?\d*\.\d+$")), "number").otherwise("string").alias("kind"),
        F.when(s.isin("true", "false"), s == "true").alias("boolean"),
        F.when(F.regexp_like(s, F.lit(r"^-?(\d+|\d*\.\d+)$")), s.try_cast("double")).alias("number"),
        F.nullif(s, F.lit("")).alias("text"),
    )


def read_json(spark: SparkSession, path: str, schema=None) -> DataFrame:
    return spark.read.json(path, schema=schema, multiLine=False)


def read_csv(spark: SparkSession, path: str, header: bool = True, sep: str = ",") -> DataFrame:
    """All cells as trimmed text; ``inferred`` types them cell by cell."""
    df = spark.read.csv(path, header=header, sep=sep, quote='"', escape='"', ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
    return df if header else df.toDF(*[f"col{i}" for i in range(len(df.columns))])


def read_xml(spark: SparkSession, path: str, row_tag: str) -> DataFrame:
    return spark.read.format("xml").options(rowTag=row_tag, attributePrefix="@", valueTag="_text", ignoreNamespace=True).load(path)


def fixed_width(lines: DataFrame, fields: list[dict], line: str = "value") -> DataFrame:
    """fields: name, pos (from 0), len, and optionally type (integer, number, date) and impliedDecimals."""
    out = []
    for f in fields:
        c = F.trim(F.substring(F.col(line), f["pos"] + 1, f["len"]))
        kind = f.get("type", "string")
        if kind == "integer":
            c = c.try_cast("bigint")
        elif kind == "number":
            c = c.try_cast("double") / F.lit(10.0 ** f.get("impliedDecimals", 0))
        elif kind == "date":
            c = F.date_format(F.try_to_date(c, "yyyyMMdd"), "yyyy-MM-dd")
        out.append(c.alias(f["name"]))
    return lines.select(*out)


def flat(lines: DataFrame, line: str = "value", key: str | None = None) -> DataFrame:
    """``a.b[0] = v`` lines to (key, path, value); comments and empty lines go, quotes are taken off, ~ and null are null."""
    s = F.trim(F.col(line))
    path, value = F.trim(F.substring_index(s, "=", 1)), F.trim(F.regexp_extract(s, "^[^=]*=(.*)$", 1))
    plain = F.when(F.regexp_like(value, F.lit(r'^".*"$|^\'.*\'$')), F.expr("substring(value0, 2, length(value0) - 2)")).when(value.isin("~", "null", ""), F.lit(None)).otherwise(value)
    return lines.where(~F.regexp_like(s, F.lit(r"^([#;].*)?$")) & F.contains(s, F.lit("="))).withColumn("value0", value).select(*([key] if key else []), path.alias("path"), plain.alias("value"))


def xml_paths(source: str):
    """(path, value) of each text and attribute of an element tree: attributes as @name, text beside children as _text, repeated tags and
    those named item as items of an array, prefixes of namespaces taken off, nil elements and closed empty ones null."""
    from xml.etree.ElementTree import XMLPullParser

    if "<!DOCTYPE" in source or "<!ENTITY" in source:
        raise ValueError("document types aren't read")
    parser, depth, root = XMLPullParser(("start", "end")), 0, None
    parser.feed(source)
    parser.close()
    for what, node in parser.read_events():
        root = node if root is None else root
        depth += 1 if what == "start" else -1
        if depth > XML_DEEPEST:
            raise ValueError("too deep")
    plain = lambda name: name.rpartition("}")[2]

    def walk(node, at):
        under = lambda name: f"{at}.{name}" if at else name
        own = {k: v for k, v in node.attrib.items() if plain(k) != "nil"}
        for k, v in own.items():
            yield under("@" + plain(k)), v
        names = [plain(c.tag) for c in node]
        seen: dict[str, int] = {}
        for child, name in zip(node, names):
            n = seen[name] = seen.get(name, -1) + 1
            yield from walk(child, under(f"{name}[{n}]" if names.count(name) > 1 or name == "item" else name))
        text = (node.text or "").strip() if len(node) else node.text
        if any(plain(k) == "nil" and v in ("true", "1") for k, v in node.attrib.items()):
            yield at, None
        elif own or len(node):
            if text:
                yield under("_text"), text
        else:
            yield at, text

    yield from walk(root, "")


#: Elements that may stand in each other, at most.
XML_DEEPEST = 100


def xml(texts: DataFrame, key: str, text: str) -> DataFrame:
    """(key, path, value) of the elements and attributes of XML texts, a document a row."""
    kind = dict(texts.dtypes)[key]

    def run(batches):
        import pandas as pd

        for pdf in batches:
            rows = [(k, p, v) for k, t in zip(pdf[key], pdf[text]) if t for p, v in xml_paths(t)]
            yield pd.DataFrame(rows, columns=[key, "path", "value"])

    return spread(texts.select(key, text)).mapInPandas(run, f"`{key}` {kind}, path string, value string")


def yaml(spark: SparkSession, texts: DataFrame, key: str, text: str) -> DataFrame:
    """The indentation subset (maps, ``- `` lists, scalars) to (key, path, value), a document a row."""

    def run(batches):
        import pandas as pd

        for pdf in batches:
            rows = [(k, p, v) for k, t in zip(pdf[key], pdf[text]) for p, v in yaml_paths(t or "")]
            yield pd.DataFrame(rows, columns=["doc_id", "path", "value"])

    return spread(texts.select(key, text)).mapInPandas(run, f"doc_id {dict(texts.dtypes)[key]}, path string, value string")


def yaml_paths(source: str):
    """(path, text) of each scalar."""
    stack: list[tuple[int, str]] = []
    counts: dict[str, int] = {}
    for raw in source.splitlines():
        line = raw.split(" #")[0].rstrip()
        if not line.strip() or line.strip().startswith("#") or line.strip() == "---":
            continue
        indent, body = len(line) - len(line.lstrip()), line.strip()
        while stack and (stack[-1][0] >= indent and not (body.startswith("- ") and stack[-1][0] == indent and not stack[-1][1].endswith("]"))):
            stack.pop()
        if body == "-" or body.startswith("- "):
            base = stack[-1][1] if stack else ""
            i = counts.get(base, 0)
            counts[base] = i + 1
            stack.append((indent, f"{base}[{i}]"))
            body, indent = body[1:].strip(), indent + 2
            if body and ":" not in body:
                yield stack[-1][1], _scalar(body)
                continue
        if ":" in body:
            name, _, value = body.partition(":")
            path = f"{stack[-1][1]}.{name.strip()}" if stack and stack[-1][1] else name.strip()
            if value.strip():
                yield path, _scalar(value.strip())
            else:
                counts[path] = 0
                stack.append((indent, path))


def _scalar(v: str):
    if v in ("~", "null"):
        return None
    return v[1:-1] if len(v) > 1 and v[0] == v[-1] and v[0] in "'\"" else v


def route(lines: DataFrame, discriminator: Column, segments: dict[str, tuple[str, ...]]) -> dict[str, DataFrame]:
    """Multi-record input: the lines of each segment by its discriminator values, from one scan's column;
    ``_unknown`` holds the rest."""
    typed = lines.withColumn("_type", discriminator)
    out = {name: typed.where(F.col("_type").isin(*values)) for name, values in segments.items()}
    every = [v for values in segments.values() for v in values]
    return out | {"_unknown": typed.where(~F.coalesce(F.col("_type").isin(*every), F.lit(False)))}


#: Sources by name: function(spark, path, ...) -> DataFrame; more can be added.
FORMATS: dict = {"json": read_json, "csv": read_csv, "delimited": read_csv, "xml": read_xml}


def read(spark: SparkSession, source: str, path: str, **options) -> DataFrame:
    """A named source's rows; an unknown one gives the lines as they are."""
    return FORMATS[source](spark, path, **options) if source in FORMATS else spark.read.text(path)
