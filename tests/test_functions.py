"""Literal cases of functions, frames, programs, formats and documents."""

import math
import time
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from weft import catalogue
from weft.functions import arrays as A
from weft.functions import scalar as S
from weft.functions.coerce import number, text, truth
from weft.functions.registry import FUNCTIONS, Typed
from weft.operators import documents as D
from weft.operators import frames as R
from weft.operators import validate as V
from weft.plans.program import apply
from weft.sources import readers, writers


def col(*xs):
    return F.array(*[F.lit(x) for x in xs])


CASES = [
    (lambda: text(F.lit(3.0), "double"), "3"),
    (lambda: text(F.lit(None)), ""),
    (lambda: number(F.lit("12abc")), 12.0),
    (lambda: number(F.lit("abc")), 0.0),
    (lambda: truth(F.lit("YES")), True),
    (lambda: truth(F.lit("abc")), False),
    (lambda: S.round_(F.lit(-2.5)), -2.0),
    (lambda: S.pad_left(F.lit("abcd"), 2, "x"), "abcd"),
    (lambda: S.soundex(F.lit("Robert")), "R163"),
    (lambda: S.soundex(F.lit("Ashcraft")), "A226"),
    (lambda: S.soundex(F.lit("Tymczak")), "T522"),
    (lambda: S.soundex(F.lit("Pfister")), "P236"),
    (lambda: S.snake_case(F.lit("HTTPServer_fooBar-baz")), "http_server_foo_bar_baz"),
    (lambda: S.mask(F.lit("12345"), "##-##-##"), "12-34-5"),
    (lambda: S.wrap(F.lit("a bb ccc dddd"), 6), "a bb\nccc\ndddd"),
    (lambda: S.unescape_html(F.lit("&lt;&#65;&#x42;&amp;")), "<AB&"),
    (lambda: S.unescape_html(F.lit("&amp;#65;")), "A"),
    (lambda: S.strip_accents(F.lit("Éàü")), "Eau"),
    (lambda: S.url_encode(F.lit("a b!'(é)")), "a%20b!'(%C3%A9)"),
    (lambda: S.matches(F.lit("x"), "(a+)+"), None),
    (lambda: S.parse_int(F.lit("-ff"), 16), -255),
    (lambda: S.gcd(F.lit(48), F.lit(18)), 6),
    (lambda: S.convert_unit(F.lit(100), "C", "F"), 212.0),
    (lambda: S.convert_unit(F.lit(1), "kg", "m"), None),
    (lambda: F.format_string("%.6f", S.convert_unit(F.lit(4550), "lb", "kg")), "2063.845284"),
    (lambda: F.format_string("%.6f", S.convert_unit(F.lit(Decimal(4550)), "lb", "kg", "decimal")), "2063.845283"),
    (lambda: S.convert_unit(F.lit(None).cast("decimal(9,0)"), "mg", "kg", "decimal"), 0.0),
    (lambda: S.npv(0.1, col(-100.0, 30.0, 40.0, 50.0, 60.0)), 38.877),
    (lambda: S.irr(col(-100.0, 30.0, 40.0, 50.0, 60.0)), 0.249),
    (lambda: S.business_days(F.lit("2024-06-14").cast("date"), 1).cast("string"), "2024-06-17"),
    (lambda: S.business_days(F.lit("2024-06-17").cast("date"), -1).cast("string"), "2024-06-14"),
    (lambda: S.coerce_date(F.lit("25/12/2024")).cast("string"), "2024-12-25"),
    (lambda: S.coerce_date(F.lit("1718409600")).cast("string"), "2024-06-15"),
    (lambda: S.add_months(F.lit("2024-01-31").cast("date"), 1), "2024-02-29"),
    (lambda: S.distance(0, 0, 0, 91, "feet"), None),
    (lambda: A.rank(col(10, 20, 20, 30)), [4, 2, 2, 1]),
    (lambda: A.cumsum(col(1, 2, 3, 4)), [1, 3, 6, 10]),
    (lambda: A.diff(col(10, 15, 12, 18)), [None, 5, -3, 6]),
    (lambda: A.pct_change(col(100, 110, 99)), [None, 0.1, -0.1]),
    (lambda: A.moving_avg(col(10, 20, 30, 40, 50), 3), [10, 15, 20, 30, 40]),
    (lambda: A.mode(col(2, 2, 1, 1)), 2),
    (lambda: A.shift(col(1, 2, 3), 1, 0), [0, 1, 2]),
    (lambda: A.fill_missing(col(None, 1, None, 2), "forward"), [None, 1, 1, 2]),
    (lambda: A.fill_missing(col(None, 1, None, 2), "backward"), [1, 1, 2, 2]),
    (lambda: A.zip_(col(1, 2, 3), col("a", "b"))[1]["1"], "b"),
    (lambda: A.window(col(1, 2, 3), 2), [[1, 2], [2, 3]]),
    (lambda: A.chunk(col(1, 2, 3), 2), [[1, 2], [3]]),
    (lambda: A.slice_(col(1, 2, 3, 4), -3, -1), [2, 3]),
    (lambda: A.sort_by(F.array(F.struct(F.lit(2).alias("k")), F.struct(F.lit(1).alias("k"))), lambda x: x["k"])[0]["k"], 1),
    (lambda: A.from_entries(F.array(F.struct(F.lit("a").alias("key"), F.lit(1).alias("value")), F.struct(F.lit("a").alias("key"), F.lit(2).alias("value"))))["a"], 2),
    (lambda: A.index_of(col(0.5, -0.0, 3.0), text(F.lit(0.0), "double")), 1),
    (lambda: A.index_of(col(0.5, -0.0, 3.0), "3"), 2),
    (lambda: A.index_of(col("3.0", "3"), "3"), 1),
    (lambda: A.includes(col(0.25, 2.0), text(F.lit(2.0), "double")), True),
    (lambda: A.count_by(col("b", "a", "b")), {"a": 1, "b": 2}),
    (lambda: A.compact(col("a", None, "")), ["a"]),
    (lambda: A.avg(col(1, None, 2)), 1.0),
    (lambda: V.luhn(F.lit("4111111111111111")), True),
    (lambda: V.luhn(F.lit("4111 1111 1111 1111")), False),
    (lambda: V.luhn(F.lit("4111 1111 1111 1112")), False),
    (lambda: S.parse_query(F.lit("?b=2&a=1&a=3")), {"a": "1", "b": "2"}),
]


def same(a, b):
    if isinstance(b, list):
        return len(a) == len(b) and all(same(x, y) for x, y in zip(a, b))
    return math.isclose(a, b, abs_tol=1e-3) if isinstance(b, float) else a == b


def test_cases(spark):
    got = spark.range(1).select(*[fn().alias(f"c{k}") for k, (fn, _) in enumerate(CASES)]).first()
    wrong = [(k, got[k], want) for k, (_, want) in enumerate(CASES) if not same(got[k], want)]
    assert not wrong


def test_registry_builds():
    assert len(FUNCTIONS) > 250
    with pytest.raises(ValueError):
        apply("{}\nx = %nonsense 1", type("D", (), {"schema": None})())


def test_frames(spark):
    df = spark.createDataFrame([(1, 5, "a"), (2, None, "a"), (3, 7, "b"), (4, 7, None)], "id long, v long, k string")
    assert {r.id for r in R.dedupe(df, "k", ["id"]).collect()} == {1, 3, 4}
    assert {r.id for r in R.dedupe(df, "k", [F.desc("id")]).collect()} == {2, 3, 4}
    z = {r.id: r.z for r in R.zscore(spark.createDataFrame([(1, 1.0, "a"), (2, 3.0, "a"), (3, 5.0, "b"), (4, 1.0, None), (5, 2.0, None)], "id long, v double, k string"), "v", "k").collect()}
    assert z == {1: -1.0, 2: 1.0, 3: None, 4: -1.0, 5: 1.0}
    assert R.drop(df, 3, ["id"]).first().id == 4
    assert R.totals(df, "k", s=("sum", "v"), m=("avg", "v")).where("k = 'a'").first()[1:] == (5.0, 2.5)
    assert sorted(r.id for r in R.sample(df, 2, 9, ["id"]).collect()) == sorted(r.id for r in R.sample(df.repartition(3), 2, 9, ["id"]).collect())
    table = spark.createDataFrame([("7", "seven"), ("7", "again")], "key string, name string")
    got = R.lookup(df, table, {"key": "v"}, {"name": "name"}, ["name"], default="?").orderBy("id").collect()
    assert [r.name for r in got] == ["?", "?", "again", "again"]


def test_program(spark):
    df = spark.createDataFrame([("x1", 3.0, None, [{"a": "p", "n": 2}, {"a": "q", "n": 3}])], "name string, price double, code string, items array<struct<a:string,n:long>>")
    source = """
    {$const}
    tax = 0.5
    {$table.T[key, value]}
    "x1", ##10
    {out}
    name = @name :upper
    total = %multiply @price @$const.tax
    found = %lookup T.value @name
    code = @code :default "none"
    bad = @name :validate "^y"
    missing = @nothing :required
    sum = %sum @items.n
    {rows[]}
    :loop items
    label = %concat @.a "-" @name
    n = @.n
    """
    r = apply(source, df).first()
    assert (r.out.name, r.out.total, r.out.found, r.out.code, r.out.sum) == ("X1", 1.5, 10, "none", 5.0)
    assert [(x.label, x.n) for x in r.rows] == [("p-x1", 2), ("q-x1", 3)]
    assert {(e.code, e.field) for e in r.errors} == {("T013", "out.bad"), ("T005", "out.missing")}


def test_documents(spark):
    a = spark.createDataFrame([(1, "x", "1"), (1, "y", "2"), (1, "z", "3")], "doc_id long, path string, value string")
    b = spark.createDataFrame([(1, "x", "9"), (1, "w", "2"), (1, "z", "3"), (1, "n", "5")], "doc_id long, path string, value string")
    changes = D.diff(a, b)
    assert {(r.op, r.path, r.to_path) for r in changes.collect()} == {("modify", "x", None), ("move", "y", "w"), ("add", "n", None)}
    assert {(r.path, r.value) for r in D.patch(a, changes).collect()} == {("x", "9"), ("w", "2"), ("z", "3"), ("n", "5")}
    chain = spark.createDataFrame([(1, 1, "a.b", "1"), (1, 2, "a", None), (1, 3, "a.c", "2"), (1, 1, "k", "3")], "doc_id long, version long, path string, value string")
    assert {(r.path, r.value) for r in D.collapse(chain).collect()} == {("a.c", "2"), ("k", "3")}
    refs = spark.createDataFrame([(1, "a", "@b"), (1, "b", "@c"), (1, "c", "v"), (1, "l", "@m"), (1, "m", "@l")], "doc_id long, path string, value string")
    assert {(r.path, r.value) for r in D.resolve(refs).collect()} == {("a", "v"), ("b", "v"), ("c", "v"), ("l", None), ("m", None)}
    long = spark.createDataFrame([(1, f"p{k}", f"@p{k + 1}") for k in range(40)] + [(1, "p40", "end")], "doc_id long, path string, value string")
    assert {r.value for r in D.resolve(long).collect()} == {"end"}
    cleared = spark.createDataFrame([(1, 1, "a[0].x", "1"), (1, 1, "a.n", "2"), (1, 2, "a[]", None), (1, 3, "a[0].x", "9"), (1, 1, "a[1].x", "3")], "doc_id long, version long, path string, value string")
    assert {(r.path, r.value) for r in D.collapse(cleared).collect()} == {("a[0].x", "9"), ("a.n", "2")}
    missing = spark.createDataFrame([(1, "modify", "q", None, None, "1"), (1, "delete", "x", None, "1", None)], "doc_id long, op string, path string, to_path string, old string, new string")
    assert [(r.op, r.path) for r in D.patch_errors(a, missing).collect()] == [("modify", "q")]
    flagged = lambda on: spark.createDataFrame([(1, "x", "1", on)], "doc_id long, path string, value string, required boolean")
    assert [r.op for r in D.diff(flagged(True), flagged(False)).collect()] == ["modify"]
    nested = spark.createDataFrame([(1, {"a": {"b": 2}, "l": [3, 4]})], "k long, s struct<a:struct<b:int>,l:array<int>>")
    assert {(r.path, r.value) for r in D.paths(nested, "k").collect()} == {("s.a.b", "2"), ("s.l[0]", "3"), ("s.l[1]", "4")}


def test_formats(spark, tmp_path):
    assert list(readers.yaml_paths("a: 1\nb:\n  - x\n  - y\nc:\n  d: 'q'\n  e: ~\n")) == [("a", "1"), ("b[0]", "x"), ("b[1]", "y"), ("c.d", "q"), ("c.e", None)]
    lines = spark.createDataFrame([("a.b = \"q\"",), ("# no",), ("k=~",), ("",)], "value string")
    assert {(r.path, r.value) for r in readers.flat(lines).collect()} == {("a.b", "q"), ("k", None)}
    cells = spark.createDataFrame([("12",), ("1.5",), ("true",), ("x",), ("",)], "c string").select(readers.inferred(F.col("c")).alias("t")).collect()
    assert [r.t.kind for r in cells] == ["integer", "number", "boolean", "string", "null"]
    df = spark.createDataFrame([(1, 'a"b', None)], "k long, s string, n string")
    assert writers.as_csv(df).first().value == '1,"a""b",'
    assert writers.as_notation(df).first().value == 'k = ##1\ns = "a\\"b"\nn = ~'
    path = str(tmp_path / "x.csv")
    writers.as_csv(df).coalesce(1).write.text(path)
    assert readers.read_csv(spark, path, header=False).first()[1] == 'a"b'


def test_validation(spark):
    df = spark.createDataFrame([(1, "a@b.c", None, [1, 1]), (2, "no", "x", [])], "id long, mail string, card string, items array<long>")
    schema = V.Schema([V.Field("mail", format="email"), V.Field("card", required=True, when=("id", "=", 1)), V.Field("items", items=(1, 3), unique=True)], one_of=[(("mail", "card"), 1, 1)])
    got = {(r.id, r.code, r.path) for r in V.failures(df, schema, "id").collect()}
    assert got == {(1, "V010", "card"), (1, "V007", "items"), (2, "V004", "mail"), (2, "V006", "items"), (2, "V009", "mail,card")}


def test_stream_equals_batch(spark, tmp_path):
    from weft.streaming import events as E

    rows = spark.range(200).select(F.col("id"), F.timestamp_seconds(F.col("id") * 60).alias("ts"), (F.col("id") % 3).cast("string").alias("k"))
    rows.write.parquet(str(tmp_path / "e"))
    query = lambda df: E.tumbling(df, "ts", "30 minutes", ["k"], n=F.count(F.lit(1)))
    batch = {tuple(r) for r in query(spark.read.parquet(str(tmp_path / "e"))).collect()}
    stream = {tuple(r) for r in E.replay(spark, str(tmp_path / "e"), rows.schema, query, "replayed").collect()}
    assert batch == stream


def test_running_totals_over_a_stream(spark, tmp_path):
    from weft.streaming import events as E

    rows = spark.range(60).select(F.col("id"), (F.col("id") % 4).alias("k"), (F.col("id") * 0.5).alias("v"))
    for part in range(3):
        rows.where(f"id div 20 = {part}").coalesce(1).write.mode("append").parquet(str(tmp_path / "e"))
    got = {tuple(r) for r in E.replay(spark, str(tmp_path / "e"), rows.schema, lambda df: E.running(df, "k", "id", "v"), "running", "append").collect()}
    assert len(got) == 60 and {n for _, _, _, n in got} == set(range(1, 16))
    assert {k: max(t for kk, _, t, n in got if kk == k and n == 15) for k in range(4)} == {k: sum(i * 0.5 for i in range(60) if i % 4 == k) for k in range(4)}


def test_notation_round_trip_and_errors():
    from weft.sources import notation as N
    from weft.sources.schema_text import parse_schema, write_schema

    text = '{$}\nversion = "1"\n{p}\nn = !##1\ns = *-"a;\\"b\\n"\n{.q}\nc = #$1.5:usd ; x\n{l[] : a, .b}\n"x, y", ~\n##2,\n{t[] : ~}\n"one"\n2024-01-02\n'
    (entries,) = N.parse(text)
    assert [(e.path, e.kind, e.value) for e in entries][-4:] == [("l[0].b", "null", None), ("l[1].a", "integer", "2"), ("t[0]", "string", "one"), ("t[1]", "date", "2024-01-02")]
    assert N.parse(N.serialize(entries)) == [entries]
    assert len(N.parse("a = ##1\n---\nb = ##2")) == 2
    for bad, code in (("a = ##1\na = ##2", "P007"), ('a = "x', "P004"), ("a = ##1.5", "P006"), ("l[1] = ##1", "P013"), ("{a", "P008"), ("a = nope", "P001"), ("a[9999999] = ##1", "P015"), ('a = "\\q"', "P005"), ("a..b = ##1", "P002")):
        with pytest.raises(N.NotationError) as e:
            N.parse(bad)
        assert e.value.code == code, bad
    schema = parse_schema("{}\nname = !:(1..5):/^a/\nkind = (x, y)\nn = ~##|?\nmail = :format email\n:exactly_one name, mail")
    assert parse_schema(write_schema(schema)) == schema
    assert [f.type for f in parse_schema('{a}\nx = date\ny = ##:(1..)\nz = #$ #$5\n{b[]}\n:(1..3):unique').fields] == ["date", "integer", "currency", "array"]


def test_notation_as_a_stream():
    from weft.sources import notation as N

    text = '{p}\nn = "é, ünï"\nt = """\na\nb\n"""\n---\nm = ##2'
    data = text.encode()
    whole = [(w, e) for w, e in N.events(text.splitlines())]
    for size in (1, 2, 3, 1000):
        assert list(N.events(N.lines_of(data[i : i + size] for i in range(0, len(data), size)))) == whole
    assert [w for w, _ in whole] == ["entry", "entry", "end", "entry", "end"] and whole[1][1].value == "a\nb"
    with pytest.raises(N.NotationError, match="P012"):
        list(N.lines_of([b"a\xff"]))


def test_xml_paths():
    source = '<r xmlns:x="urn:x" xmlns:i="http://www.w3.org/2001/XMLSchema-instance" k="1">t<x:a>one</x:a><b i:nil="true"/><c/><d><![CDATA[<q>]]></d><e>1</e><e>2</e><f><item>z</item></f></r>'
    assert list(readers.xml_paths(source)) == [("@k", "1"), ("a", "one"), ("b", None), ("c", None), ("d", "<q>"), ("e[0]", "1"), ("e[1]", "2"), ("f.item[0]", "z"), ("_text", "t")]
    for bad in ("<!DOCTYPE r><r/>", "<a>" * 200 + "</a>" * 200):
        with pytest.raises(ValueError):
            list(readers.xml_paths(bad))


def test_programs_refuse_what_they_do_not_know(spark):
    from weft.plans.program import parse

    for bad in ("{a}\nx = @y :nosuch", "{a}\n:literal\n\"\"\"\nx"):
        with pytest.raises(ValueError):
            parse(bad)
    df = spark.range(1)
    for bad, code in (("{}\nx = %nosuch @id", "T001"), ("{a[]}\n:loop id\nx = @.y", "T009"), ("{a}\n:else\nx = @id", "T012"), ('{}\nx = "${@${id}}"', None)):
        if code:
            with pytest.raises(ValueError, match=code):
                apply(bad, df)
    loop = {"a": '@import "b"', "b": '@import "a"'}
    with pytest.raises(ValueError):
        parse('@import "a"', loop.__getitem__)


#: A text that each format takes, and one that it doesn't.
FORMATS = {
    "email": ("a@b.c", "a b@c.d"), "url": ("HTTPS://x.y/z", "ftp://x"), "uri": ("mailto:a", "1:a"), "uuid": ("123e4567-e89b-42d3-a456-426614174000", "123e4567-e89b-12d3-a456-426614174000"), "date": ("2024-01-02", "2024-1-2"),
    "date-iso": ("2024-01-02", "20240102"), "time": ("10:20:30", "10:20"), "datetime": ("2024-01-02T10:20:30Z", "2024-01-02"), "date-time": ("2024-01-02T10:20:30", "2024-01-02 10:20:30"), "hostname": ("a-b.c", "-a.b"),
    "ipv4": ("1.2.3.255", "1.2.3.4."), "ipv6": ("fe80::1", "1:2:3"), "phone": ("+44 20 7946 0958", "none"), "credit-card": ("4111111111111111", "4111111111111112"), "creditcard": ("4111111111111111", "411"), "ssn": ("123-45-6789", "666-45-6789"),
    "ein": ("12-3456789", "123456789"), "fein": ("12-3456789", "1-23456789"), "zip": ("12345-6789", "1234"), "postal-ca": ("k1a 0b1", "11a 0b1"), "vin": ("1hgcm82633a004352", "1HGCM82633I004352"), "iban": ("gb29nwbk", "GB2"), "bic": ("deutdeff", "DEUT1EFF"),
    "swift": ("DEUTDEFF500", "DEUTDEFF50"), "routing": ("123456789", "12345678"), "cusip": ("03783310a", "03783310"), "isin": ("US0378331005", "US037833100A"), "lei": ("5493001kjtiigc8y1r12", "5493"), "naic": ("12345", "1234"), "currency-code": ("eur", "XXQ"),
    "country-alpha2": ("DE", "de"), "country-alpha3": ("DEU", "DE"), "state-us": ("wa", "ZZ"), "npi": ("1234567890", "123"), "dea": ("ab1234567", "a1234567"), "imei": ("123456789012345", "12345678901234"), "iccid": ("8912345678901234567", "891"),
    "sin": ("123 456 789", "12 345 678"), "hex": ("0aF", "0g"),
}


def test_every_format(spark):
    assert set(FORMATS) == set(V.FORMATS) | set(V.CHECKS)
    row = spark.range(1).select(*[F.array(*[V.is_format(F.lit(t), n) for t in pair]).alias(n) for n, pair in FORMATS.items()]).first()
    assert {n: row[n] for n in FORMATS} == {n: [True, False] for n in FORMATS}
    with pytest.raises(ValueError):
        V.is_format(F.lit("x"), "nosuch")


def test_definitions_are_checked():
    good = V.Schema([V.Field("a", bounds=(1, 3), default="xy"), V.Field("b", "integer", enum=(1, 2))])
    assert V.check_definition(good) == []
    bad = V.Schema([V.Field("a", bounds=(3, 1)), V.Field("b", enum=("x",), default="y"), V.Field("c", format="nosuch"), V.Field("d", required=True, when=("gone", "=", 1))], one_of=[(("a", "z"), 1, 1)])
    assert len(V.check_definition(bad)) == 5
    assert [f.pattern for f in V.Schema([V.Field("a", pattern="x")]).extended(V.Schema([V.Field("a", required=True)])).fields] == ["x"]
    with pytest.raises(ValueError, match="V017"):
        V.Schema([V.Field("a", required=True)]).extended(V.Schema([V.Field("a")]))


def test_imports_stay_in_their_folder(spark, tmp_path):
    from weft.functions.registry import Typed
    from weft.plans import program
    from weft.sources.imports import ImportRefused, loader

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "shared.txt").write_text("{$const}\nrate = 2\n")
    (tmp_path / "out.txt").write_text("secret")
    load = loader(str(tmp_path / "in"))
    assert load("shared") == load("shared.txt")
    for bad in ("../out", str(tmp_path / "out.txt"), "http://x/y", "shared.py"):
        with pytest.raises(ImportRefused):
            load(bad)
    program.MODIFIERS["plus"] = (1, lambda t, n: Typed(t.column + n, "long"))
    row = apply('@import "shared"\n{}\nx = %multiply @id @$const.rate\ny = @id :plus 5', spark.range(3, 4), load).first()
    assert (row.x, row.y) == (6.0, 8)
    with pytest.raises(ValueError, match="T018"):
        apply("{}\nx = " + "%not " * 40 + "@id", spark.range(1))


def test_seeded_values_are_the_generators(spark):
    from weft.functions import generate as G

    def mulberry(seed, turns):
        out = []
        for _ in range(turns):
            seed = (seed + 0x6D2B79F5) & 0xFFFFFFFF
            t = seed
            t = (t ^ t >> 15) * (t | 1) & 0xFFFFFFFF
            t ^= (t + ((t ^ t >> 7) * (t | 61) & 0xFFFFFFFF)) & 0xFFFFFFFF
            out.append((t ^ t >> 14) / 2**32)
        return out

    for s in ("seed123", "", "héllo", "x" * 50):
        h = 0
        for c in s:
            h = (h * 31 + ord(c)) & 0xFFFFFFFF
        r = spark.createDataFrame([(s,)], "s string").select(G.random(seed=F.col("s")).alias("r"), G.nanoid(6, F.col("s")).alias("n")).first()
        assert r.r == mulberry(h, 1)[0]
        assert not s or r.n == "".join(G.ALPHABET[int(u * 64)] for u in mulberry(h, 6))


def test_catalogue_has_sql():
    assert set(catalogue.ORACLE) <= set(catalogue.QUERIES) and len(catalogue.ORACLE) > 200


def test_queries_equal_their_sql_on_any_keys(spark, tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    def value(name, table, columns):
        pq.write_table(pa.table(columns), str(tmp_path / f"{table}.parquet"))
        return {r[0]: r[1] for r in catalogue.QUERIES[name](spark, str(tmp_path)).collect()}

    vectors = {"vec_id": [1, 2], "embedding": pa.array([[0.5, 0.5, 0.25] + [0.125] * 61, [0.5, 0.25, 0.5] + [0.125] * 61], pa.list_(pa.float32())), "label": [0, 0]}
    assert value("array_unique", "embeddings", vectors) == {1: 0.25, 2: 0.5}
    keys = {"c_custkey": [2, 3, 9998, 9999, 10000, 65535, 65536, 5_400_000, 2**40 + 2, 2**40 + 1]}
    assert value("format_ipv6", "customer", keys) == {k: k % 2 == 0 for k in keys["c_custkey"]}
    taken = value("format_vin", "customer", {"c_custkey": list(range(9900, 10100))})
    assert all(taken[k] for k in range(9900, 10000)) and not any(taken[k] for k in range(10000, 10100))
    orders = {"o_orderkey": [1, 2, 3, 4], "o_orderstatus": ["O"] * 4, "o_totalprice": [2500.0, 2000.0, 3500.0, 2600.0]}
    assert value("series_rank", "orders", orders) == {3: 1, 4: 2, 1: 3, 2: 3}


def seconds(df):
    began = time.time()
    df.write.format("noop").mode("overwrite").save()
    return time.time() - began


def test_a_root_found_ends_the_work(spark):
    one = lambda x: F.aggregate(F.sequence(F.lit(1), F.lit(200)), F.lit(0.0), lambda a, k: a + x / 200)

    def found(steps):
        df = spark.range(0, 500, 1, 1).select(S._newton(lambda r: one(r) - 1, lambda r: one(r) / r, (F.col("id") * 0 + 1).cast("double"), 1e-6, 1e-10, -9.0, 9.0, steps).alias("x"))
        assert {r.x for r in df.collect()} == {1.0}
        return min(seconds(df) for _ in range(2))

    assert found(500) < 10 * found(2)


def test_a_seed_is_hashed_once(spark):
    from weft.functions import generate as G

    def drawn(n):
        return min(seconds(spark.range(0, 20, 1, 1).select(G.nanoid(n, F.repeat(F.col("id").cast("string"), 20_000)))) for _ in range(2))

    assert drawn(200) < 10 * drawn(1)


def test_durations_are_matched_once(spark):
    from weft.functions import dates

    df = spark.createDataFrame([("P1Y2DT3H30M1.5S",), ("P1M",), ("PT1S",), ("PT0S",), ("93784.5",), ("60",), ("P",), ("x",), ("",), (None,)], "s string").select(dates.duration(F.col("s")).alias("d"))
    assert [r.d for r in df.collect()] == ["1 year, 2 days, 3 hours, 30 minutes, 1.5 seconds", "1 month", "1 second", "0 seconds", "1 day, 2 hours, 3 minutes, 4.5 seconds", "1 minute", "0 seconds", None, None, None]
    plan = df._jdf.queryExecution().analyzed().toString()
    assert plan.count("regexp") + plan.count("RLIKE") <= 12


def tasks(df):
    return df.select(F.spark_partition_id().alias("p")).distinct().count()


def one_task(spark, path, text):
    """200 keyed texts in a file that one task reads."""
    spark.range(0, 200, 1, 1).select(F.col("id").alias("k"), text.alias("t")).write.parquet(str(path))
    df = spark.read.parquet(str(path))
    assert tasks(df) == 1
    return df


def test_notation_is_read_by_many_tasks(spark, tmp_path):
    from weft.sources import notation as N

    text = F.when(F.col("id") == 7, None).when(F.col("id") == 8, F.lit("a = nope")).otherwise(F.concat(F.lit('{b}\nx = !##2\n{a[] : y}\n"q;"\n---\nc = *##'), F.col("id")))
    rows = N.read(one_task(spark, tmp_path / "t", text), "k", "t")
    assert tasks(rows) == 4
    got = rows.orderBy("k", "document", "path").collect()
    assert len(got) == 198 * 3 + 1 and [tuple(r) for r in got if r.k == 9] == [(9, 0, "a[0].y", "string", "q;", False, False, False, None), (9, 0, "b.x", "integer", "2", True, False, False, None), (9, 1, "c", "integer", "9", False, True, False, None)]
    assert [(r.path, r.error[:4]) for r in got if r.k == 8] == [(None, "P001")]
    texts = {r.k: r.text for r in N.canonical(rows, "k").collect()}
    assert len(texts) == 198 and texts[9] == 'a[0].y = "q;"\nb.x = !##2\nc = *##9\n'


def test_documents_are_read_by_many_tasks(spark, tmp_path):
    from weft.sources import notation as N

    for name, text, read in (
        ("json", '{"a": [1]}', lambda df: N.from_json(df, "k", "t")), ("xml", "<r><a>1</a></r>", lambda df: readers.xml(df, "k", "t")), ("yaml", "a: 1", lambda df: readers.yaml(spark, df, "k", "t")),
    ):
        rows = read(one_task(spark, tmp_path / name, F.lit(text)))
        assert tasks(rows) == 4 and rows.count() == 200, name
