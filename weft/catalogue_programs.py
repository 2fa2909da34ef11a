"""Queries of programs: interpolation, objects, loops, accumulators, passes, literal blocks, policies, imports, layouts."""

from __future__ import annotations

from pyspark.sql import functions as F

from .catalogue_base import C, query, read
from .plans.program import apply, layout
from .sources import writers


def _histories(s, p):
    """A row a customer, with its orders as an array by key."""
    items = F.array_sort(F.collect_list(F.struct(C("o_orderkey"), C("o_totalprice"), C("o_orderstatus"))))
    return read(s, p, "orders").groupBy("o_custkey").agg(items.alias("orders"))


INTERPOLATION = """
{}
o_orderkey = @o_orderkey
value = "order ${@o_orderkey}: ${%lower @o_orderstatus} \\${kept}"
"""


@query("program_interpolation", "SELECT o_orderkey, 'order ' || o_orderkey || ': ' || lower(o_orderstatus) || ' ${kept}' AS value FROM orders")
def _(s, p):
    return apply(INTERPOLATION, read(s, p, "orders"))


OBJECT = """
{}
o_orderkey = @o_orderkey
who = :object {key = @o_custkey, kind = "customer, new", rank = %upper @o_orderpriority}
quoted = "%concat @o_orderstatus \\"!\\""
"""


@query("program_inline_object", "SELECT o_orderkey, o_custkey AS key, 'customer, new' AS kind, upper(o_orderpriority) AS rank, o_orderstatus || '!' AS quoted FROM orders")
def _(s, p):
    return apply(OBJECT, read(s, p, "orders")).select("o_orderkey", "who.*", "quoted")


NESTED = """
{}
r = @r_name
{rows[]}
:loop nations :as nation
:loop .customers :as customer
:counter n
nation = @nation.n_name
customer = @customer.c_name
n = @n
"""


@query("program_nested_loops", "SELECT r_name AS r, n_name AS nation, c_name AS customer, row_number() OVER (PARTITION BY n_nationkey ORDER BY c_name) - 1 AS n FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def _(s, p):
    customers = read(s, p, "customer").groupBy(C("c_nationkey").alias("n_nationkey")).agg(F.array_sort(F.collect_list(F.struct("c_name"))).alias("customers"))
    nations = read(s, p, "nation").join(customers, "n_nationkey").groupBy(C("n_regionkey").alias("r_regionkey")).agg(F.collect_list(F.struct("n_name", "customers")).alias("nations"))
    rows = apply(NESTED, read(s, p, "region").join(nations, "r_regionkey"))
    return rows.select("r", F.explode("rows").alias("x")).select("r", "x.*")


ACCUMULATORS = """
{$accumulator}
total = 0
count = 0
count._persist = ?true
mean = 0
mean._persist = ?true
{_sums[]}
:pass 1
:loop orders
_ = %accumulate count 1
_t = %accumulate total @.o_totalprice
{_mean}
:pass 1
_ = %set mean %divide @$accumulator.total @$accumulator.count
{}
o_custkey = @o_custkey
n = @$accumulator.count
mean = @$accumulator.mean
lost = @$accumulator.total
"""


@query("program_passes", "SELECT o_custkey, CAST(count(*) AS DOUBLE) AS n, round(avg(o_totalprice), 6) AS mean, 0 AS lost FROM orders GROUP BY 1")
def _(s, p):
    return apply(ACCUMULATORS, _histories(s, p)).withColumn("mean", F.round("mean", 6))


RUNNING = """
{$accumulator}
total = 100
{rows[]}
:loop orders
key = @.o_orderkey
total = %accumulate total @.o_totalprice
place = @_index
"""


@query("program_accumulators", "SELECT o_orderkey AS key, round(100 + sum(o_totalprice) OVER w, 2) AS total, row_number() OVER w - 1 AS place FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)")
def _(s, p):
    return apply(RUNNING, _histories(s, p)).select(F.explode("rows").alias("x")).select("x.key", F.round("x.total", 2).alias("total"), "x.place")


LITERAL = '''
{$accumulator}
n = 0
n._persist = ?true
{_count[]}
:pass 1
:loop orders
_ = %accumulate n 1
{}
o_custkey = @o_custkey
{head}
:literal
"""
HDR|${@o_custkey}|\\${x}
"""
{lines[]}
:loop orders
:literal
"""
DET|${@.o_orderkey}|${%lower @.o_orderstatus}
"""
{tail}
:literal
"""
TRL|${@$accumulator.n}
"""
'''


@query("program_literal_blocks", "SELECT o_custkey, 'HDR|' || o_custkey || '|${x}' || chr(10) || string_agg('DET|' || o_orderkey || '|' || lower(o_orderstatus), chr(10) ORDER BY o_orderkey) || chr(10) || 'TRL|' || count(*) AS value FROM orders GROUP BY 1")
def _(s, p):
    return apply(LITERAL, _histories(s, p)).select("o_custkey", F.array_join(F.concat("head", "lines", "tail"), "\n").alias("value"))


POLICIES = """
{$target}
onValidation = warn
onMissing = fail
{}
c_custkey = @c_custkey
segment = @c_mktsegment :enum "BUILDING,MACHINERY"
absent = @no_such :required
"""


@query("program_policies", "SELECT c_custkey, c_mktsegment AS segment, CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN 0 ELSE 1 END AS warned, 'T005' AS code FROM customer")
def _(s, p):
    return apply(POLICIES, read(s, p, "customer")).select("c_custkey", "segment", F.size("warnings").alias("warned"), F.get("errors", 0)["code"].alias("code"))


SKIPPED = POLICIES.replace("= warn", "= skip").replace("= fail", "= skip")


@query("program_policy_skip", "SELECT c_custkey, CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN c_mktsegment END AS segment FROM customer")
def _(s, p):
    return apply(SKIPPED, read(s, p, "customer")).select("c_custkey", "segment")


SHARED = """
{$const}
rate = 0.5
floor = 10
{$table.STATUS[code, name]}
"O", "Open"
{extra}
half = %multiply @o_totalprice @$const.rate
"""
IMPORTING = """
@import "shared"
{$const}
floor = 20
{}
o_orderkey = @o_orderkey
status = %lookupDefault STATUS.name @o_orderstatus "?"
floor = @$const.floor
"""


@query("program_import", "SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN 'Open' ELSE '?' END AS status, 20 AS floor, round(o_totalprice / 2, 4) AS half FROM orders")
def _(s, p):
    return apply(IMPORTING, read(s, p, "orders"), {"shared": SHARED}.__getitem__).select("o_orderkey", "status", "floor", F.round("extra.half", 4).alias("half"))


MODIFIERS = """
{}
o_orderkey = @o_orderkey
day = @o_orderdate :date
at = @o_orderdate :time
price = @o_totalprice :decimals 1
letter = @o_orderpriority :pos 2 :len 3
second = @o_orderpriority :field 0 :maxLen 4 :lower
parsed = "{\\"a\\": 1}" :raw
list = @o_orderstatus :array
"""


@query("program_modifiers", "SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day, '00:00:00' AS at, substr(o_orderpriority, 3, 3) AS letter, lower(substr(o_orderpriority, 1, 4)) AS second, 1 AS parsed, [o_orderstatus] AS list FROM orders")
def _(s, p):
    return apply(MODIFIERS, read(s, p, "orders")).withColumn("parsed", F.try_variant_get("parsed", "$.a", "int")).drop("price")


FIXED = """
{$target}
format = "fixed-width"
{}
key = @c_custkey :pos 0 :len 6 :leftPad "0"
name = @c_name :pos 6 :len 20 :rightPad "."
segment = @c_mktsegment :pos 26 :len 4 :truncate
"""


@query("program_fixed_width", "SELECT lpad(CAST(c_custkey AS VARCHAR), 6, '0') || rpad(c_name, 20, '.') || c_mktsegment[1:4] AS value FROM customer")
def _(s, p):
    return writers.as_fixed_width(apply(FIXED, read(s, p, "customer")), layout(FIXED))


VALUES = """
{}
o_custkey = @o_custkey
{keys[]}
:loop orders
_ = %add @.o_orderkey 1
"""


@query("program_value_loop", "SELECT o_custkey, CAST(o_orderkey + 1 AS DOUBLE) AS key FROM orders")
def _(s, p):
    return apply(VALUES, _histories(s, p)).select("o_custkey", F.explode("keys").alias("key"))


GUARDS = """
{$target}
enforceConfidential = "redact"
{}
c_custkey = @c_custkey
name = @c_name :maxLen 8 :lower
rich = "yes" :if c_acctbal > 5000
poor = "no" :unless c_acctbal > 5000
hidden = @c_name :confidential
empty = "" :omitEmpty
number = "12" :type integer
custom = %&shop.twice @c_nationkey
echo = %&shop.unknown @c_name
"""


@query("program_guards", "SELECT c_custkey, lower(c_name[1:8]) AS name, CASE WHEN c_acctbal > 5000 THEN 'yes' END AS rich, CASE WHEN c_acctbal > 5000 THEN NULL ELSE 'no' END AS poor, CAST(NULL AS VARCHAR) AS hidden, CAST(NULL AS VARCHAR) AS empty, CAST(12 AS BIGINT) AS number, CAST(2 * c_nationkey AS DOUBLE) AS custom, c_name AS echo FROM customer")
def _(s, p):
    from .functions.registry import CUSTOM, Typed

    CUSTOM["shop.twice"] = lambda x: Typed(x.column.cast("double") * 2, "double")
    return apply(GUARDS, read(s, p, "customer"))


SEQUENCES = """
{head}
one = %sequence "n"
other = %sequence "m" 10
{rows[]}
:loop orders
key = @.o_orderkey
n = %sequence "n"
m = %sequence "m"
{tail}
n = %sequence "n"
reset = %resetSequence "n" 5
again = %sequence "n"
"""


@query("program_sequences", "SELECT o_custkey, o_orderkey AS key, 1 + row_number() OVER w AS n, 10 + row_number() OVER w AS m, 2 + count(*) OVER (PARTITION BY o_custkey) AS tail, 6 AS again FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)")
def _(s, p):
    out = apply("{}\no_custkey = @o_custkey\n" + SEQUENCES, _histories(s, p)).select("o_custkey", F.explode("rows").alias("x"), C("tail.n").alias("tail"), "tail.again")
    return out.select("o_custkey", "x.key", "x.n", "x.m", "tail", "again")


SHAPES = """
{}
o_custkey = @o_custkey
numbered = %rowNumber @orders
exploded = %explode @groups "keys"
drawn = %sample @keys 3 42
"""


@query("program_array_shapes", "SELECT o_custkey, CAST(sum(o_orderkey * n) AS BIGINT) AS numbered, CAST(sum(o_orderkey) AS BIGINT) AS exploded, CAST(least(count(*), 3) AS BIGINT) AS drawn FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders) GROUP BY 1")
def _(s, p):
    df = _histories(s, p).withColumn("keys", F.transform("orders", lambda x: x["o_orderkey"])).withColumn("groups", F.array(F.struct(F.lit("a").alias("g"), C("keys").alias("keys"))))
    total = lambda a, f: F.aggregate(a, F.lit(0).cast("long"), lambda s, x: s + f(x))
    out = apply(SHAPES, df)
    return out.select("o_custkey", total("numbered", lambda x: x["o_orderkey"] * x["_rowNum"]).alias("numbered"), total("exploded", lambda x: x["keys"]).alias("exploded"), F.size(F.array_intersect(F.array_distinct("drawn"), F.transform("numbered", lambda x: x["o_orderkey"]))).cast("long").alias("drawn"))
