"""Queries of the notation, its canonical form, schemas as text, and writers."""

from __future__ import annotations

from pyspark.sql import functions as F

from .catalogue_base import C, query, read
from .operators import documents as D
from .operators import validate as V
from .sources import notation as N
from .sources import readers, writers
from .sources.schema_text import parse_schema
from .streaming import events as E

_TEXT = """{{$}}
version = "1.0.0"
{{customer}}
number = !##{key} ; a comment
name = *"{name}"
balance = #$12.5:usd
rate = #1.50
active = ?true
none = ~
{{.address}}
nation = @nations[0].name
{{lines[] : sku, qty, .note}}
"A, {key}", ##2, "x"
"B", ##10,
{{nations[] : name}}
"N"
"""


def _texts(s, p):
    parts = [x for k, piece in enumerate(_TEXT.replace("{{", "\x01").replace("}}", "\x02").split("{")) for x in ([piece] if k == 0 else [("key" if piece.startswith("key") else "name"), piece.partition("}")[2]])]
    columns = [C("c_custkey").cast("string") if x == "key" else C("c_name") if x == "name" else F.lit(x.replace("\x01", "{").replace("\x02", "}")) for x in parts]
    return read(s, p, "customer").select("c_custkey", F.concat(*columns).alias("text"))


_PATHS = [
    ("$.version", "string", "'1.0.0'"), ("customer.number", "integer", "CAST(c_custkey AS VARCHAR)"), ("customer.name", "string", "c_name"), ("customer.balance", "currency", "'12.5:USD'"), ("customer.rate", "number", "'1.50'"),
    ("customer.active", "boolean", "'true'"), ("customer.none", "null", "NULL"), ("customer.address.nation", "reference", "'nations[0].name'"), ("lines[0].sku", "string", "'A, ' || c_custkey"), ("lines[0].qty", "integer", "'2'"),
    ("lines[0].note", "string", "'x'"), ("lines[1].sku", "string", "'B'"), ("lines[1].qty", "integer", "'10'"), ("nations[0].name", "string", "'N'"),
]


@query("read_notation", " UNION ALL ".join(f"SELECT c_custkey, '{path}' AS path, '{kind}' AS kind, {sql} AS value FROM customer" for path, kind, sql in _PATHS))
def _(s, p):
    return N.read(_texts(s, p), "c_custkey", "text").select("c_custkey", "path", "kind", "value")


_CANONICAL = "'$.version = \"1.0.0\"\ncustomer.active = true\ncustomer.address.nation = @nations[0].name\ncustomer.balance = #$12.50:USD\ncustomer.name = *\"' || c_name || '\"\ncustomer.none = ~\ncustomer.number = !##' || c_custkey || '\ncustomer.rate = #1.5\nlines[0].note = \"x\"\nlines[0].qty = ##2\nlines[0].sku = \"A, ' || c_custkey || '\"\nlines[1].qty = ##10\nlines[1].sku = \"B\"\nnations[0].name = \"N\"\n'"


@query("canonical_text", f"SELECT c_custkey, {_CANONICAL} AS text, sha256({_CANONICAL}) AS hash FROM customer")
def _(s, p):
    return N.canonical(N.read(_texts(s, p), "c_custkey", "text"), "c_custkey")


@query("json_import", "SELECT event_id, 'a.k' AS path, 'integer' AS kind, json_extract_string(props, '$.k') AS value FROM events UNION ALL SELECT event_id, 'b[0]', 'string', event_type FROM events UNION ALL SELECT event_id, 'b[1]', 'null', NULL FROM events")
def _(s, p):
    text = F.concat(F.lit('{"a": '), "props", F.lit(', "b": ["'), "event_type", F.lit('", null]}'))
    return N.from_json(read(s, p, "events").select("event_id", text.alias("text")), "event_id", "text")


SCHEMA = parse_schema("""
{@named}
c_name = !:(1..12):/^Customer/
{ : @named}
c_acctbal = #:(0..9000)
c_mktsegment = !(BUILDING, MACHINERY, AUTOMOBILE)
c_nationkey = !##:(..20):if c_mktsegment = BUILDING
phone = :format phone
:invariant c_acctbal + 10 > c_nationkey
:at_most_one c_name, c_mktsegment
""")


@query("schema_text", """SELECT c_custkey, code, path FROM (
    SELECT c_custkey, 'V003' AS code, 'c_name' AS path FROM customer WHERE length(c_name) > 12 UNION ALL
    SELECT c_custkey, 'V003', 'c_acctbal' FROM customer WHERE c_acctbal < 0 OR c_acctbal > 9000 UNION ALL
    SELECT c_custkey, 'V005', 'c_mktsegment' FROM customer WHERE c_mktsegment NOT IN ('BUILDING', 'MACHINERY', 'AUTOMOBILE') UNION ALL
    SELECT c_custkey, 'V010', 'c_nationkey' FROM customer WHERE c_nationkey = 3 AND c_mktsegment = 'BUILDING' UNION ALL
    SELECT c_custkey, 'V003', 'c_nationkey' FROM customer WHERE c_nationkey > 20 UNION ALL
    SELECT c_custkey, 'V004', 'phone' FROM customer WHERE c_custkey % 2 = 1 UNION ALL
    SELECT c_custkey, 'V008', '' FROM customer WHERE NOT (c_acctbal + 10 > c_nationkey) OR c_nationkey = 3 UNION ALL
    SELECT c_custkey, 'V009', 'c_name,c_mktsegment' FROM customer)""")
def _(s, p):
    df = read(s, p, "customer").withColumn("c_nationkey", F.when(C("c_nationkey") != 3, C("c_nationkey"))).withColumn("phone", F.when(C("c_custkey") % 2 == 0, "555-123-4567").otherwise("none"))
    return V.failures(df, SCHEMA, "c_custkey")


@query("write_xml", "SELECT '<row key=\"' || c_custkey || '\"><name>' || c_name || '</name></row>' AS value FROM customer")
def _(s, p):
    df = read(s, p, "customer").select(C("c_custkey").alias("key", metadata={"attr": True}), C("c_name").alias("n", metadata={"element": "name"}))
    return writers.as_xml(df)


@query("write_fixed_width_overflow", "SELECT c_custkey, CASE WHEN length(c_mktsegment) > 8 THEN 'T010' END AS code FROM customer")
def _(s, p):
    df = read(s, p, "customer")
    return df.select("c_custkey", F.get(writers.overflow(df, [{"name": "c_mktsegment", "len": 8}, {"name": "c_name", "len": 3, "truncate": True}]), 0)["code"].alias("code"))


@query("write_json_shapes", "SELECT c_custkey, '{\"k\":' || c_custkey || ',\"n\":null,\"raw\":{\"a\":' || c_custkey || '}}' AS value FROM customer")
def _(s, p):
    df = read(s, p, "customer").select(C("c_custkey").alias("k"), F.lit(None).cast("string").alias("n"), F.array().cast("array<int>").alias("e"), F.parse_json(F.concat(F.lit('{"a":'), "c_custkey", F.lit("}"))).alias("raw"))
    return df.select(C("k").alias("c_custkey"), writers.json_of(df, nulls=True, empty_arrays=False).alias("value"))


@query("read_flat", "SELECT c_custkey, 'a.name' AS path, c_name AS value FROM customer UNION ALL SELECT c_custkey, 'a.list[0]', c_mktsegment FROM customer UNION ALL SELECT c_custkey, 'none', NULL FROM customer")
def _(s, p):
    lines = F.array(F.lit("# a comment"), F.concat(F.lit('a.name = "'), C("c_name"), F.lit('"')), F.concat(F.lit("a.list[0]="), C("c_mktsegment")), F.lit("none = ~"), F.lit(""))
    return readers.flat(read(s, p, "customer").select("c_custkey", F.explode(lines).alias("value")), key="c_custkey")


@query("read_yaml", "SELECT c_custkey AS doc_id, 'name' AS path, c_name AS value FROM customer UNION ALL SELECT c_custkey, 'tags[0]', c_mktsegment FROM customer UNION ALL SELECT c_custkey, 'tags[1]', 'x' FROM customer UNION ALL SELECT c_custkey, 'at.nation', CAST(c_nationkey AS VARCHAR) FROM customer")
def _(s, p):
    text = F.concat(F.lit("name: "), C("c_name"), F.lit("\ntags:\n  - "), C("c_mktsegment"), F.lit("\n  - 'x'\nat:\n  nation: "), C("c_nationkey"), F.lit("\n"))
    return readers.yaml(s, read(s, p, "customer").select("c_custkey", text.alias("text")), "c_custkey", "text")


@query("infer_cells", "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'integer' WHEN c_custkey % 3 = 1 THEN 'number' ELSE 'string' END AS kind FROM customer")
def _(s, p):
    cell = F.when(C("c_custkey") % 3 == 0, C("c_custkey").cast("string")).when(C("c_custkey") % 3 == 1, F.concat("c_custkey", F.lit(".25"))).otherwise(C("c_name"))
    return read(s, p, "customer").select("c_custkey", readers.inferred(F.concat(F.lit(" "), cell))["kind"].alias("kind"))


@query("resolve_references", "SELECT c_custkey AS doc_id, unnest(['a', 'b', 'c', 'x', 'y']) AS path, unnest([c_name, c_name, c_name, NULL, NULL]) AS value FROM customer")
def _(s, p):
    """a leads to b to c, which is a name; x and y lead to each other."""
    pairs = F.array(*[F.struct(F.lit(k).alias("path"), v.alias("value")) for k, v in (("a", F.lit("@b")), ("b", F.lit("@c")), ("c", C("c_name")), ("x", F.lit("@y")), ("y", F.lit("@x")))])
    return D.resolve(read(s, p, "customer").select(C("c_custkey").alias("doc_id"), F.explode(pairs).alias("e")).select("doc_id", "e.path", "e.value"))


@query("flatten_nested", "SELECT o_custkey AS doc_id, 'orders[' || (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1) || '].key' AS path, CAST(o_orderkey AS VARCHAR) AS value FROM orders")
def _(s, p):
    df = read(s, p, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct(C("o_orderkey").alias("key")))).alias("orders"))
    return D.paths(df, "o_custkey")


@query("validate_arrays", "SELECT o_custkey, code, 'keys' AS path FROM (SELECT o_custkey, count(*) AS n, count(DISTINCT o_orderstatus) AS u FROM orders GROUP BY 1), (VALUES ('V006'), ('V007')) AS c(code) WHERE (code = 'V006' AND n > 8) OR (code = 'V007' AND u < n)")
def _(s, p):
    df = read(s, p, "orders").groupBy("o_custkey").agg(F.collect_list("o_orderstatus").alias("keys"))
    return V.failures(df, V.Schema([V.Field("keys", "array", items=(1, 8), unique=True)]), "o_custkey")


@query("validate_paths", "SELECT c_custkey AS doc_id, 'V011' AS code, 'c_mktsegment' AS path FROM customer UNION ALL SELECT c_custkey, 'V013', 'to' FROM customer")
def _(s, p):
    """Fields that the schema lacks, and references that lead nowhere."""
    rows = D.paths(read(s, p, "customer").select("c_custkey", "c_name", "c_mktsegment", F.lit("@nowhere").alias("to"), F.lit("@c_name").alias("back")), "c_custkey")
    unknown = V.unknown_fields(rows, V.Schema([V.Field(n) for n in ("c_name", "to", "back")])).select("doc_id", F.lit("V011").alias("code"), "path")
    return unknown.union(V.unresolved(rows).select("doc_id", F.lit("V013"), "path"))


@query("overlay_clears_arrays", "SELECT user_id AS doc_id, 'list[0]' AS path, CAST(max(event_id) AS VARCHAR) AS value FROM events GROUP BY 1")
def _(s, p):
    """Each event clears its user's list and sets its first item."""
    set_ = F.array(F.struct((C("event_id") * 2).alias("version"), F.lit("list[]").alias("path"), F.lit(None).cast("string").alias("value")), F.struct((C("event_id") * 2 + 1).alias("version"), F.concat(F.lit("list["), F.lit(0), F.lit("]")).alias("path"), C("event_id").cast("string").alias("value")))
    return D.collapse(read(s, p, "events").select(C("user_id").alias("doc_id"), F.explode(set_).alias("e")).select("doc_id", "e.*"))


@query("with_and_without", "SELECT c_custkey AS doc_id, 'c_name' AS path, 'new ' || c_custkey AS value FROM customer UNION ALL SELECT c_custkey, 'more.a', c_mktsegment FROM customer")
def _(s, p):
    df = read(s, p, "customer").select("c_custkey", "c_name", F.struct(C("c_mktsegment").alias("a")).alias("more"), F.struct(C("c_nationkey").alias("x")).alias("gone"))
    return D.with_value(D.without(D.paths(df, "c_custkey"), "gone"), "c_name", F.concat(F.lit("new "), "doc_id"))


@query("read_xml", "SELECT c_custkey, unnest(['@key', 'name', 'tag[0]', 'tag[1]', 'none']) AS path, unnest([CAST(c_custkey AS VARCHAR), c_name, c_mktsegment, 'a & b', NULL]) AS value FROM customer")
def _(s, p):
    text = F.concat(F.lit('<c key="'), C("c_custkey"), F.lit('"><n:name xmlns:n="urn:n">'), C("c_name"), F.lit("</n:name><tag>"), C("c_mktsegment"), F.lit("</tag><tag>a &amp; b</tag><none/></c>"))
    return readers.xml(read(s, p, "customer").select("c_custkey", text.alias("text")), "c_custkey", "text")


_LINES = "string_agg('orders[' || n || '].day = ' || strftime(o_orderdate, '%Y-%m-%d') || chr(10) || 'orders[' || n || '].key = ##' || o_orderkey || chr(10), '' ORDER BY n)"


@query("write_notation_nested", f"SELECT o_custkey, 'name = \"c' || o_custkey || '\"' || chr(10) || {_LINES} AS text FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS n FROM orders) GROUP BY o_custkey")
def _(s, p):
    orders = F.array_sort(F.collect_list(F.struct(C("o_orderkey").alias("key"), C("o_orderdate").cast("date").alias("day"))))
    df = read(s, p, "orders").groupBy("o_custkey").agg(orders.alias("orders")).withColumn("name", F.concat(F.lit("c"), "o_custkey"))
    return N.canonical(N.from_rows(df, "o_custkey"), "o_custkey").select("o_custkey", "text")


@query("sliding_windows", "SELECT start, event_type, count(*) AS n FROM (SELECT event_type, unnest([time_bucket(INTERVAL 3 HOUR, ts, TIMESTAMP '1970-01-01'), time_bucket(INTERVAL 3 HOUR, ts, TIMESTAMP '1970-01-01') - INTERVAL 3 HOUR]) AS start FROM events) GROUP BY ALL")
def _(s, p):
    return E.sliding(read(s, p, "events"), "ts", "6 hours", "3 hours", ["event_type"], n=F.count(F.lit(1)))


@query("session_windows", "SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 8 HOUR AS \"end\", count(*) AS n FROM (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS part FROM (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 8 HOUR THEN 0 ELSE 1 END AS fresh FROM events)) GROUP BY user_id, part")
def _(s, p):
    return E.sessions(read(s, p, "events"), "ts", "8 hours", ["user_id"], n=F.count(F.lit(1))).select("user_id", "start", "end", "n")
