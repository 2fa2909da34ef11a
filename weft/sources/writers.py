"""DataFrames to text formats: one text column, which any of Spark's writers takes."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import scalar as S
from ..functions.coerce import text
from ..plans.program import kind_of


def json_of(df: DataFrame, nulls: bool = False, empty_arrays: bool = True, indent: bool = False) -> Column:
    """A row as JSON. nulls, empty_arrays: whether fields of these stand; a variant column is embedded as it is."""
    arrays = [f.name for f in df.schema.fields if isinstance(f.dataType, T.ArrayType)]
    options = {"ignoreNullFields": str(not nulls).lower(), "pretty": str(indent).lower()}
    if empty_arrays or not arrays:
        return F.to_json(F.struct(*df.columns), options)
    # a row's text without the arrays that are empty: one form for each choice of them would be many, so they are cut out
    whole = F.to_json(F.struct(*df.columns), options)
    for name in arrays:
        gap = re.escape(f'"{name}"') + r"\s*:\s*\[\s*\]"
        cut = F.regexp_replace(F.regexp_replace(whole, gap + r"\s*,\s*", ""), r",?\s*" + gap, "")
        whole = F.when(F.size(F.col(name)) == 0, cut).otherwise(whole)
    return whole


def as_json(df: DataFrame, nulls: bool = False, empty_arrays: bool = True, indent: bool = False) -> DataFrame:
    return df.select(json_of(df, nulls, empty_arrays, indent).alias("value"))


def as_xml(df: DataFrame, row_tag: str = "row", hints: bool = False) -> DataFrame:
    """An element a row. A field's metadata shapes it: ``attr`` makes it an attribute, ``element`` and ``ns`` name it, ``cdata`` keeps
    its text as it is. hints: a ``type`` attribute on elements that hold no text."""
    kinds = {f.name: kind_of(f.dataType) for f in df.schema.fields}
    attributes, elements = [], []
    for f in df.schema.fields:
        c, m = F.col(f"`{f.name}`"), f.metadata or {}
        name = f"{m['ns']}:{m.get('element', f.name)}" if "ns" in m else m.get("element", f.name)
        if m.get("attr"):
            attributes.append(F.when(c.isNotNull(), F.concat(F.lit(f' {name}="'), S.escape_xml(text(c, kinds[f.name])), F.lit('"'))).otherwise(""))
        elif isinstance(f.dataType, (T.StructType, T.MapType)):
            elements.append(F.when(c.isNotNull(), F.regexp_replace(F.to_xml(F.struct(c.alias(name)), {"rowTag": "w", "indent": ""}), r"(?s)^\s*<w>\s*|\s*</w>\s*$", "")).otherwise(""))
        else:
            def one(x, name=name, kind=kinds[f.name], m=m):
                said = F.concat(F.lit("<![CDATA["), F.replace(text(x, kind), F.lit("]]>"), F.lit("]]]]><![CDATA[>")), F.lit("]]>")) if m.get("cdata") else S.escape_xml(text(x, kind))
                hint = f' type="{kind}"' if hints and kind != "string" else ""
                return F.when(x.isNotNull(), F.concat(F.lit(f"<{name}{hint}>"), said, F.lit(f"</{name}>"))).otherwise("")

            if isinstance(f.dataType, T.ArrayType):
                inner = kind_of(f.dataType.elementType)
                elements.append(F.array_join(F.transform(F.coalesce(c, F.array().cast(f.dataType)), lambda x, one=one, inner=inner: one(x, kind=inner)), ""))
            else:
                elements.append(one(c))
    spaces = sorted({f.metadata["ns"] for f in df.schema.fields if f.metadata and "ns" in f.metadata})
    head = f"<{row_tag}" + "".join(f' xmlns:{n}="urn:{n}"' for n in spaces)
    return df.select(F.concat(F.lit(head), *attributes, F.lit(">"), *elements, F.lit(f"</{row_tag}>")).alias("value"))


def csv_header(df: DataFrame, sep: str = ",") -> str:
    """The header line of ``as_csv``'s rows."""
    return sep.join(f'"{c}"' if sep in c or '"' in c else c for c in df.columns)


def as_csv(df: DataFrame, sep: str = ",") -> DataFrame:
    def cell(f) -> Column:
        c = text(F.col(f.name), kind_of(f.dataType))
        return F.when(F.regexp_like(c, F.lit(f'[{sep}"\\r\\n]')), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c)

    return df.select(F.concat_ws(sep, *[cell(f) for f in df.schema.fields]).alias("value"))


def as_fixed_width(df: DataFrame, fields: list[dict]) -> DataFrame:
    """fields: name, len, and optionally left (pad on the left) and pad."""
    kinds = {f.name: kind_of(f.dataType) for f in df.schema.fields}
    cells = []
    for f in fields:
        c, pad = text(F.col(f["name"]), kinds[f["name"]]), f.get("pad", " ")
        left = f.get("left", kinds[f["name"]] in ("long", "double"))
        cells.append(F.lpad(c, f["len"], pad) if left else F.rpad(c, f["len"], pad))
    return df.select(F.concat(*cells).alias("value"))


def overflow(df: DataFrame, fields: list[dict]) -> Column:
    """array<struct<code, field>>: T010 for each value that is longer than its field and may not be cut."""
    kinds = {f.name: kind_of(f.dataType) for f in df.schema.fields}
    found = [F.when(F.length(text(F.col(f["name"]), kinds[f["name"]])) > f["len"], F.struct(F.lit("T010").alias("code"), F.lit(f["name"]).alias("field"))) for f in fields if not f.get("truncate")]
    return F.array_compact(F.array(*found)) if found else F.array().cast("array<struct<code:string,field:string>>")


#: Targets by name; more can be added.
FORMATS: dict = {}


def write(df: DataFrame, target: str, **options) -> DataFrame:
    """Rows as a target's lines; an unknown target is an error."""
    if target not in FORMATS:
        raise ValueError(f"T006: no target {target!r}")
    return FORMATS[target](df, **options)


def as_flat(paths: DataFrame) -> DataFrame:
    """(doc_id, path, value) to a document's sorted path=value lines; nulls are left out."""
    lines = F.sort_array(F.collect_list(F.concat_ws("=", "path", "value")))
    return paths.where("value is not null").groupBy("doc_id").agg(F.array_join(lines, "\n").alias("value"))


def as_notation(df: DataFrame) -> DataFrame:
    """Rows in the native notation: texts quoted, ## whole numbers, # numbers, ? booleans, ~ null."""

    def line(f):
        c, k = F.col(f.name), kind_of(f.dataType)
        quoted = F.concat(F.lit('"'), F.replace(F.replace(text(c, k), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))
        value = {"long": F.concat(F.lit("##"), text(c, k)), "double": F.concat(F.lit("#"), text(c, k)), "boolean": F.concat(F.lit("?"), text(c, k)), "date": text(c, k), "timestamp": text(c, k)}.get(k, quoted)
        return F.concat(F.lit(f"{f.name} = "), F.when(c.isNull(), "~").otherwise(value))

    return df.select(F.concat_ws("\n", *[line(f) for f in df.schema.fields]).alias("value"))


FORMATS |= {"json": as_json, "xml": as_xml, "csv": as_csv, "fixed-width": as_fixed_width, "flat": as_flat, "properties": as_flat, "notation": as_notation}
