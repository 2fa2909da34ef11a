"""The registered queries of the engine and their SQL twins.

Most are a row of ``SCALARS`` or ``ARRAYS``: a table, its key, a function's Column and the SQL that gives the same.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from .catalogue_base import _BAL, _CU, _D, _DATE, _DOC, _E, _KEY, _NAME, _O, _P, _PG, _SYL, ORACLE, QUERIES, C, add_arrays, add_scalars, d, query, read, verb
from .functions import arrays as A
from .functions import scalar as S
from .operators import documents as D
from .operators import frames as R
from .operators import validate as V
from .plans.program import apply
from .sources import readers, writers
from .streaming import events as E

#: CRC-32 bit by bit: each byte is mixed in, then eight shifts follow.
_CRC32 = (
    "lpad(lower(hex(xor(list_reduce(list_prepend(4294967295, flatten(list_transform(string_split(p_name, ''), lambda c: [unicode(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))), "
    "lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) ELSE xor(a >> 1, 3988292384 * (a & 1)) END), 4294967295))), 8, '0')"
)
_LETTERS = "regexp_replace(upper(p_name), '[^A-Z]', '', 'g')"
#: Letters' digits with runs made one, the first one's taken off, then the zeros; a first letter stands for its digit.
_SOUNDEX = f"rpad(({_LETTERS}[1] || replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(translate({_LETTERS}, 'BFPVCGJKQSXZDTLMNRAEIOUYHW', '11112222222233455600000000'), '1+', '1', 'g'), '2+', '2', 'g'), '3+', '3', 'g'), '4+', '4', 'g'), '5+', '5', 'g'), '6+', '6', 'g'), '^[0-9]', ''), '0', ''))[1:4], 4, '0')"


def _pad(by: int) -> str:
    """The key "key", padded to a block and mixed, as an SQL literal."""
    return "'" + "".join(f"\\x{c ^ by:02X}" for c in b"key".ljust(64, b"\0")) + "'::BLOB"


#: name: (table and key, Column, SQL expression)
SCALARS = {
    "concat": (_CU, lambda: verb("concat", ("c_name", "string"), "-", (F.nullif(C("c_mktsegment"), F.lit("BUILDING")), "string"), _KEY), "c_name || '-' || coalesce(nullif(c_mktsegment, 'BUILDING'), '') || c_custkey"),
    "upper": (_P, lambda: verb("upper", _NAME), "upper(p_name)"),
    "lower": (_P, lambda: verb("lower", ("p_brand", "string")), "lower(p_brand)"),
    "trim": (_P, lambda: verb("trim", (F.concat(F.lit("\t "), C("p_name"), F.lit(" \n")), "string")), "p_name"),
    "trim_left": (_P, lambda: verb("trimLeft", (F.concat(F.lit("\t "), C("p_name")), "string")), "p_name"),
    "trim_right": (_P, lambda: verb("trimRight", (F.concat(C("p_name"), F.lit(" \n")), "string")), "p_name"),
    "coalesce": (_CU, lambda: verb("coalesce", (F.nullif(C("c_mktsegment"), F.lit("BUILDING")), "string"), ("c_name", "string")), "coalesce(nullif(c_mktsegment, 'BUILDING'), c_name)"),
    "if_null": (_CU, lambda: verb("ifNull", (F.nullif(C("c_mktsegment"), F.lit("BUILDING")), "string"), "none"), "coalesce(nullif(c_mktsegment, 'BUILDING'), 'none')"),
    "if_empty": (_CU, lambda: verb("ifEmpty", (F.when(C("c_custkey") % 3 == 0, "").when(C("c_custkey") % 3 == 1, C("c_name")), "string"), "empty"), "CASE c_custkey % 3 WHEN 0 THEN 'empty' WHEN 1 THEN c_name END"),
    "if_else": (_CU, lambda: verb("ifElse", (C("c_acctbal") > 0, "boolean"), "credit", "debit"), "CASE WHEN c_acctbal > 0 THEN 'credit' ELSE 'debit' END"),
    "cond": (_CU, lambda: verb("cond", (C("c_acctbal") < 0, "boolean"), "low", (C("c_acctbal") < 5000, "boolean"), "mid", "high"), "CASE WHEN c_acctbal < 0 THEN 'low' WHEN c_acctbal < 5000 THEN 'mid' ELSE 'high' END"),
    "switch": (_O, lambda: verb("switch", ("o_orderstatus", "string"), "O", "open", "F", "filled", "other"), "CASE o_orderstatus WHEN 'O' THEN 'open' WHEN 'F' THEN 'filled' ELSE 'other' END"),
    "coerce_string": (_CU, lambda: verb("coerceString", (F.round("c_acctbal"), "double")), "CAST(CAST(CASE WHEN c_acctbal < 0 THEN -round(-c_acctbal) ELSE round(c_acctbal) END AS BIGINT) AS VARCHAR)"),
    "coerce_number": (_PG, lambda: verb("coerceNumber", (F.concat(C("page_id"), F.lit("px")), "string")), "CAST(page_id AS DOUBLE)"),
    "coerce_integer": (_CU, lambda: verb("coerceInteger", _BAL), "CAST(floor(c_acctbal) AS DOUBLE)"),
    "coerce_boolean": (_O, lambda: verb("coerceBoolean", (F.when(C("o_orderstatus") == "O", "Yes").when(C("o_orderstatus") == "F", "1").otherwise("abc"), "string")), "o_orderstatus IN ('O', 'F')"),
    "coerce_date": (_O, lambda: verb("coerceDate", (F.when(C("o_orderkey") % 3 == 0, F.date_format("o_orderdate", "yyyyMMdd")).when(C("o_orderkey") % 3 == 1, F.date_format("o_orderdate", "M/d/yyyy")).otherwise(F.date_format("o_orderdate", "d.M.yyyy")), "string")), _D),
    "try_coerce_number": (_E, lambda: readers.inferred(F.get_json_object("props", "$.k"))["number"], "CAST(json_extract_string(props, '$.k') AS DOUBLE)"),
    "logic_and": (_O, lambda: verb("and", (C("o_totalprice") > 1000, "boolean"), (C("o_orderstatus") == "O", "boolean")), "o_totalprice > 1000 AND o_orderstatus = 'O'"),
    "logic_or": (_O, lambda: verb("or", (C("o_totalprice") > 100000, "boolean"), (C("o_orderstatus") == "O", "boolean")), "o_totalprice > 100000 OR o_orderstatus = 'O'"),
    "logic_xor": (_O, lambda: verb("xor", (C("o_totalprice") > 100000, "boolean"), (C("o_orderstatus") == "O", "boolean")), "(o_totalprice > 100000) <> (o_orderstatus = 'O')"),
    "logic_not": (_O, lambda: verb("not", ("o_orderstatus", "string")), "true"),
    "eq": (_O, lambda: verb("eq", (F.nullif(C("o_orderstatus"), F.lit("P")), "string"), "O"), "coalesce(nullif(o_orderstatus, 'P') = 'O', false)"),
    "ne": (_O, lambda: verb("ne", ("o_orderstatus", "string"), "O"), "o_orderstatus <> 'O'"),
    "lt_text": (_CU, lambda: verb("lt", (C("c_custkey").cast("string"), "string"), "5"), "CAST(c_custkey AS VARCHAR) < '5'"),
    "lte": (_CU, lambda: verb("lte", _BAL, 100), "c_acctbal <= 100"),
    "gt_null_is_zero": (_CU, lambda: verb("gt", (F.when(C("c_acctbal") > 0, C("c_acctbal")), "double"), -1), "true"),
    "gte": (_CU, lambda: verb("gte", _BAL, 100), "c_acctbal >= 100"),
    "between": (_CU, lambda: verb("between", _BAL, 0, 1000), "c_acctbal BETWEEN 0 AND 1000"),
    "is_null": (_CU, lambda: verb("isNull", (F.nullif(C("c_mktsegment"), F.lit("BUILDING")), "string")), "c_mktsegment = 'BUILDING'"),
    "type_of": (_CU, lambda: verb("typeOf", (F.when(C("c_acctbal") > 0, C("c_acctbal")), "double")), "CASE WHEN c_acctbal > 0 THEN 'number' ELSE 'null' END"),
    "assert": (_CU, lambda: verb("assert", (F.when(C("c_custkey") % 2 == 0, "yes").otherwise("no"), "string")), "CASE WHEN c_custkey % 2 = 0 THEN 'yes' END"),
    "capitalize": (_P, lambda: verb("capitalize", _NAME), "upper(p_name[1]) || lower(p_name[2:])"),
    "title_case": (_P, lambda: verb("titleCase", _NAME), "array_to_string(list_transform(string_split(lower(p_name), ' '), lambda w: upper(w[1]) || w[2:]), ' ')"),
    "length": (_DOC, lambda: verb("length", ("text", "string")), "length(text)"),
    "contains": (_P, lambda: verb("contains", _NAME, "an"), "contains(p_name, 'an')"),
    "starts_with": (_P, lambda: verb("startsWith", _NAME, "b"), "starts_with(p_name, 'b')"),
    "ends_with": (_P, lambda: verb("endsWith", _NAME, "l"), "ends_with(p_name, 'l')"),
    "substring": (_P, lambda: verb("substring", _NAME, 2, 4), "substr(p_name, 3, 4)"),
    "replace": (_P, lambda: verb("replace", _NAME, "e", "E"), "replace(p_name, 'e', 'E')"),
    "pad_left": (_CU, lambda: verb("padLeft", _KEY, 3, "0"), "CASE WHEN length(CAST(c_custkey AS VARCHAR)) < 3 THEN lpad(CAST(c_custkey AS VARCHAR), 3, '0') ELSE CAST(c_custkey AS VARCHAR) END"),
    "pad_right": (_CU, lambda: verb("padRight", _KEY, 3, "x"), "CASE WHEN length(CAST(c_custkey AS VARCHAR)) < 3 THEN rpad(CAST(c_custkey AS VARCHAR), 3, 'x') ELSE CAST(c_custkey AS VARCHAR) END"),
    "center": (_CU, lambda: verb("center", _KEY, 9, "*"), "repeat('*', (9 - length(CAST(c_custkey AS VARCHAR))) // 2) || c_custkey || repeat('*', 9 - length(CAST(c_custkey AS VARCHAR)) - (9 - length(CAST(c_custkey AS VARCHAR))) // 2)"),
    "truncate": (_P, lambda: verb("truncate", _NAME, 5), "p_name[1:5]"),
    "split": (_P, lambda: verb("split", _NAME, " ", -1), "string_split(p_name, ' ')[-1]"),
    "mask": (_CU, lambda: verb("mask", (F.lpad(C("c_custkey").cast("string"), 9, "7"), "string"), "###-##-####"), "lpad(CAST(c_custkey AS VARCHAR), 9, '7')[1:3] || '-' || lpad(CAST(c_custkey AS VARCHAR), 9, '7')[4:5] || '-' || lpad(CAST(c_custkey AS VARCHAR), 9, '7')[6:9]"),
    "replace_regex": (_P, lambda: verb("replaceRegex", _NAME, "[aeiou]", "_"), "regexp_replace(p_name, '[aeiou]', '_', 'g')"),
    "reverse_string": (_P, lambda: verb("reverseString", _NAME), "reverse(p_name)"),
    "repeat": (_P, lambda: verb("repeat", ("p_brand", "string"), 3), "repeat(p_brand, 3)"),
    "camel_case": (_P, lambda: verb("camelCase", _NAME), "string_split(lower(p_name), ' ')[1] || array_to_string(list_transform(string_split(lower(p_name), ' ')[2:], lambda w: upper(w[1]) || w[2:]), '')"),
    "pascal_case": (_P, lambda: verb("pascalCase", _NAME), "array_to_string(list_transform(string_split(lower(p_name), ' '), lambda w: upper(w[1]) || w[2:]), '')"),
    "snake_case": (_P, lambda: verb("snakeCase", _NAME), "replace(lower(p_name), ' ', '_')"),
    "kebab_case": (_P, lambda: verb("kebabCase", _NAME), "replace(lower(p_name), ' ', '-')"),
    "slugify": (_P, lambda: verb("slugify", (F.concat(C("p_name"), F.lit(" & co!")), "string")), "replace(lower(p_name), ' ', '-') || '-co'"),
    "match": (_PG, lambda: verb("match", ("url", "string"), "/[0-9]+"), "regexp_matches(url, '/[0-9]+')"),
    "extract": (_PG, lambda: verb("extract", ("url", "string"), "^https?://([^/]+)", 1), "nullif(regexp_extract(url, '^https?://([^/]+)', 1), '')"),
    "normalize_space": (_DOC, lambda: F.md5(verb("normalizeSpace", ("text", "string"))), "md5(trim(regexp_replace(text, '\\s+', ' ', 'g')))"),
    "left_of": (_P, lambda: verb("leftOf", _NAME, " "), "split_part(p_name, ' ', 1)"),
    "right_of": (_P, lambda: verb("rightOf", _NAME, " "), "p_name[instr(p_name, ' ') + 1:]"),
    "wrap": (_P, lambda: verb("wrap", _NAME, 6), "CASE WHEN length(p_name) <= 6 THEN p_name ELSE replace(p_name, ' ', chr(10)) END"),
    "word_count": (_DOC, lambda: verb("wordCount", ("text", "string")), "CAST(len(" + _SYL.format("text") + ") AS BIGINT)"),
    "tokenize": (_P, lambda: F.size(verb("tokenize", _NAME)).cast("long"), "CAST(len(string_split(p_name, ' ')) AS BIGINT)"),
    "levenshtein": (_P, lambda: verb("levenshtein", _NAME, "blue anvil"), "levenshtein(p_name, 'blue anvil')"),
    "escape_html": (_PG, lambda: F.md5(verb("escapeHtml", ("html", "string"))), "md5(replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), chr(39), '&#39;'))"),
    "escape_xml": (_PG, lambda: F.md5(verb("escapeXml", ("html", "string"))), "md5(replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), chr(39), '&apos;'))"),
    "strip_tags": (_PG, lambda: F.md5(verb("stripTags", ("html", "string"))), "md5(regexp_replace(html, '<[^>]*>', '', 'g'))"),
    "strip_accents": (_DOC, lambda: F.md5(verb("stripAccents", ("text", "string"))), "md5(strip_accents(text))"),
    "soundex": (_P, lambda: verb("soundex", _NAME), _SOUNDEX),
    "template": (_CU, lambda: S.template("{n} in {s}", {"n": C("c_name"), "s": C("c_mktsegment")}), "c_name || ' in ' || c_mktsegment"),
    "format_phone": (_CU, lambda: verb("formatPhone", (F.lpad(C("c_custkey").cast("string"), 10, "5"), "string"), "US"), "'(' || lpad(CAST(c_custkey AS VARCHAR), 10, '5')[1:3] || ') ' || lpad(CAST(c_custkey AS VARCHAR), 10, '5')[4:6] || '-' || lpad(CAST(c_custkey AS VARCHAR), 10, '5')[7:10]"),
    "abs": (_CU, lambda: verb("abs", _BAL), "abs(c_acctbal)"),
    "round_half_up": (_CU, lambda: verb("round", (F.round("c_acctbal") / 2, "double"), 0), "floor((CASE WHEN c_acctbal < 0 THEN -round(-c_acctbal) ELSE round(c_acctbal) END) / 2 + 0.5)"),
    "floor": (_CU, lambda: verb("floor", _BAL), "CAST(floor(c_acctbal) AS DOUBLE)"),
    "ceil": (_CU, lambda: verb("ceil", _BAL), "CAST(ceil(c_acctbal) AS DOUBLE)"),
    "add": (_CU, lambda: d(verb("add", _BAL, (F.when(C("c_custkey") % 2 == 0, C("c_custkey")), "long"))), "round(c_acctbal + CASE WHEN c_custkey % 2 = 0 THEN c_custkey ELSE 0 END, 6)"),
    "subtract": (_CU, lambda: d(verb("subtract", _BAL, _KEY)), "round(c_acctbal - c_custkey, 6)"),
    "multiply": (_CU, lambda: d(verb("multiply", _BAL, _KEY)), "round(c_acctbal * c_custkey, 6)"),
    "divide": (_CU, lambda: d(verb("divide", _BAL, _KEY)), "round(CASE WHEN c_custkey <> 0 THEN c_acctbal / c_custkey END, 6)"),
    "mod": (_CU, lambda: verb("mod", _KEY, 7), "CAST(c_custkey % 7 AS DOUBLE)"),
    "negate": (_CU, lambda: verb("negate", _KEY), "CAST(-c_custkey AS DOUBLE)"),
    "sign": (_CU, lambda: verb("sign", _BAL), "CAST(sign(c_acctbal) AS DOUBLE)"),
    "trunc": (_CU, lambda: verb("trunc", _BAL), "CAST(trunc(c_acctbal) AS DOUBLE)"),
    "min_of": (_CU, lambda: verb("minOf", _BAL, 100, (F.lit(None), "double")), "least(c_acctbal, 100.0, 0.0)"),
    "max_of": (_CU, lambda: verb("maxOf", _BAL, 100), "greatest(c_acctbal, 100.0)"),
    "format_integer": (_CU, lambda: verb("formatInteger", _BAL), "CAST(CAST(floor(c_acctbal) AS BIGINT) AS VARCHAR)"),
    "parse_int": (_CU, lambda: verb("parseInt", (F.concat(F.hex("c_custkey"), F.lit("z")), "string"), 16), "c_custkey"),
    "safe_divide": (_CU, lambda: d(verb("safeDivide", _BAL, _KEY, -1)), "round(CASE WHEN c_custkey = 0 THEN -1 ELSE c_acctbal / c_custkey END, 6)"),
    "convert_unit": (_CU, lambda: verb("convertUnit", _KEY, "km", "m"), "c_custkey * 1000.0"),
    "gcd": (_CU, lambda: verb("gcd", _KEY, 36), "CAST(gcd(c_custkey, 36) AS DOUBLE)"),
    "lcm": (_CU, lambda: verb("lcm", _KEY, 36), "CAST(lcm(c_custkey, 36) AS DOUBLE)"),
    "factorial": (_CU, lambda: verb("factorial", (C("c_custkey") % 10, "long")), "CAST(factorial(CAST(c_custkey % 10 AS INTEGER)) AS DOUBLE)"),
    "log_base": (_CU, lambda: d(verb("log", _KEY, 2)), "round(CASE WHEN c_custkey > 0 THEN ln(c_custkey) / ln(2) END, 6)"),
    "ln": (_CU, lambda: d(verb("ln", _KEY)), "round(CASE WHEN c_custkey > 0 THEN ln(c_custkey) END, 6)"),
    "log10": (_CU, lambda: d(verb("log10", _KEY)), "round(CASE WHEN c_custkey > 0 THEN log10(c_custkey) END, 6)"),
    "exp": (_CU, lambda: d(verb("exp", (C("c_custkey") % 10, "long"))), "round(exp(c_custkey % 10), 6)"),
    "pow": (_CU, lambda: d(verb("pow", (C("c_custkey") % 10, "long"), 3)), "round(pow(c_custkey % 10, 3), 6)"),
    "sqrt": (_CU, lambda: d(verb("sqrt", _BAL)), "round(CASE WHEN c_acctbal >= 0 THEN sqrt(c_acctbal) END, 6)"),
    "clamp": (_CU, lambda: verb("clamp", _BAL, 0, 500), "greatest(0.0, least(500.0, c_acctbal))"),
    "interpolate": (_CU, lambda: d(verb("interpolate", _KEY, 0, 0, 100, 50)), "round(c_custkey * 0.5, 6)"),
    "format_date": (_O, lambda: verb("formatDate", _DATE, "DD/MM/YYYY"), "strftime(o_orderdate, '%d/%m/%Y')"),
    "add_days": (_O, lambda: verb("addDays", _DATE, 45), f"strftime({_D} + 45, '%Y-%m-%d')"),
    "add_months": (_O, lambda: verb("addMonths", _DATE, 13), f"strftime({_D} + INTERVAL 13 MONTH, '%Y-%m-%d')"),
    "add_years": (_O, lambda: verb("addYears", _DATE, 1), f"strftime({_D} + INTERVAL 1 YEAR, '%Y-%m-%d')"),
    "add_hours": (_E, lambda: verb("addHours", ("ts", "timestamp"), 5), "strftime(ts + INTERVAL 5 HOUR, '%Y-%m-%dT%H:%M:%S.') || lpad(CAST((epoch_us(ts) // 1000) % 1000 AS VARCHAR), 3, '0') || 'Z'"),
    "date_diff_days": (_O, lambda: verb("dateDiff", _DATE, (F.lit("2000-01-01").cast("date"), "date"), "days"), f"date_diff('day', {_D}, DATE '2000-01-01')"),
    "date_diff_months": (_O, lambda: verb("dateDiff", _DATE, (F.lit("2000-01-01").cast("date"), "date"), "months"), f"(2000 - year({_D})) * 12 + 1 - month({_D})"),
    "start_of_month": (_O, lambda: verb("startOfMonth", _DATE), f"CAST(date_trunc('month', {_D}) AS DATE)"),
    "end_of_month": (_O, lambda: verb("endOfMonth", _DATE), f"last_day({_D})"),
    "start_of_year": (_O, lambda: verb("startOfYear", _DATE), f"CAST(date_trunc('year', {_D}) AS DATE)"),
    "end_of_year": (_O, lambda: verb("endOfYear", _DATE), f"make_date(year({_D}), 12, 31)"),
    "day_of_week": (_O, lambda: verb("dayOfWeek", _DATE), f"isodow({_D})"),
    "week_of_year": (_O, lambda: verb("weekOfYear", _DATE), f"week({_D})"),
    "quarter": (_O, lambda: verb("quarter", _DATE), f"quarter({_D})"),
    "is_leap_year": (_O, lambda: verb("isLeapYear", _DATE), f"(year({_D}) % 4 = 0 AND year({_D}) % 100 <> 0) OR year({_D}) % 400 = 0"),
    "is_before": (_O, lambda: verb("isBefore", _DATE, (F.lit("1998-01-01").cast("date"), "date")), f"{_D} < DATE '1998-01-01'"),
    "is_between_dates": (_O, lambda: verb("isBetween", _DATE, (F.lit("1996-01-01").cast("date"), "date"), (F.lit("1998-01-01").cast("date"), "date")), f"{_D} BETWEEN DATE '1996-01-01' AND DATE '1998-01-01'"),
    "to_unix": (_E, lambda: verb("toUnix", ("ts", "timestamp")), "CAST(floor(epoch_us(ts) / 1000000.0) AS BIGINT)"),
    "from_unix": (_CU, lambda: verb("fromUnix", (C("c_custkey") * 86400, "long")), "strftime(make_timestamp(c_custkey * 86400000000), '%Y-%m-%dT%H:%M:%S.000Z')"),
    "age": (_O, lambda: verb("ageFromDate", _DATE, (F.lit("2010-06-15").cast("date"), "date")), f"date_sub('year', {_D}, DATE '2010-06-15')"),
    "next_business_day": (_O, lambda: verb("nextBusinessDay", _DATE), f"{_D} + CAST(CASE isodow({_D}) WHEN 5 THEN 3 WHEN 6 THEN 2 ELSE 1 END AS INTEGER)"),
    "business_days": (_O, lambda: verb("businessDays", _DATE, 10), f"{_D} + 14"),
    "base64_encode": (_P, lambda: verb("base64Encode", _NAME), "base64(encode(p_name))"),
    "base64_round_trip": (_DOC, lambda: F.md5(verb("base64Decode", (verb("base64Encode", ("text", "string")), "string"))), "md5(text)"),
    "hex_encode": (_P, lambda: verb("hexEncode", _NAME), "lower(hex(p_name))"),
    "url_encode": (_P, lambda: verb("urlEncode", _NAME), "replace(p_name, ' ', '%20')"),
    "url_decode": (_P, lambda: verb("urlDecode", (verb("urlEncode", _NAME), "string")), "p_name"),
    "md5": (_DOC, lambda: verb("md5", ("text", "string")), "md5(text)"),
    "sha1": (_DOC, lambda: verb("sha1", ("text", "string")), "sha1(text)"),
    "sha256": (_DOC, lambda: verb("sha256", ("text", "string")), "sha256(text)"),
    "sha512": (_P, lambda: verb("sha512", _NAME), None),
    "crc32": (_P, lambda: verb("crc32", _NAME), _CRC32),
    "hmac": (_P, lambda: verb("hmac", _NAME, "key"), f"sha256({_pad(0x5C)} || unhex(sha256({_pad(0x36)} || encode(p_name))))"),
    "unescape_html": (_PG, lambda: F.md5(verb("unescapeHtml", (verb("escapeHtml", (F.replace(C("html"), F.lit("&"), F.lit("+")), "string")), "string"))), "md5(replace(html, '&', '+'))"),
    "json_path": (_E, lambda: verb("jsonPath", ("props", "string"), "$.k"), "json_extract_string(props, '$.k')"),
    "url_host": (_PG, lambda: S.parse_url(C("url"))["host"], "nullif(regexp_extract(url, '^https?://([^/:?#]+)', 1), '')"),
    "url_query_value": (_PG, lambda: F.try_element_at(S.parse_query(S.parse_url(C("url"))["query"]), F.lit("page")), "nullif(regexp_extract(url, '[?&]page=([^&#]*)', 1), '')"),
    "compound": (_CU, lambda: d(verb("compound", _BAL, 0.05, 10)), "round(c_acctbal * pow(1.05, 10), 6)"),
    "discount": (_CU, lambda: d(verb("discount", _BAL, 0.05, 10)), "round(c_acctbal / pow(1.05, 10), 6)"),
    "pmt": (_CU, lambda: d(verb("pmt", _BAL, 0.01, 12)), "round(c_acctbal * 0.01 * pow(1.01, 12) / (pow(1.01, 12) - 1), 6)"),
    "fv": (_CU, lambda: d(verb("fv", _BAL, 0.01, 12)), "round(c_acctbal * (pow(1.01, 12) - 1) / 0.01, 6)"),
    "pv": (_CU, lambda: d(verb("pv", _BAL, 0.01, 12)), "round(c_acctbal * (1 - pow(1.01, -12)) / 0.01, 6)"),
    "depreciation": (_CU, lambda: d(verb("depreciation", _KEY, 10, 5)), "round(CASE WHEN 10 <= c_custkey THEN (c_custkey - 10) / 5.0 END, 6)"),
    "distance": (_CU, lambda: d(verb("distance", (C("c_custkey") % 80, "long"), (C("c_custkey") % 170, "long"), 10, 20)), "round(6371 * 2 * atan2(sqrt(pow(sin(radians(10 - c_custkey % 80) / 2), 2) + cos(radians(c_custkey % 80)) * cos(radians(10)) * pow(sin(radians(20 - c_custkey % 170) / 2), 2)), sqrt(1 - (pow(sin(radians(10 - c_custkey % 80) / 2), 2) + cos(radians(c_custkey % 80)) * cos(radians(10)) * pow(sin(radians(20 - c_custkey % 170) / 2), 2)))), 6)"),
    "in_bounding_box": (_CU, lambda: S.in_box(C("c_custkey") % 80, C("c_custkey") % 170, 10, 20, 40, 60), "c_custkey % 80 BETWEEN 10 AND 40 AND c_custkey % 170 BETWEEN 20 AND 60"),
    "to_radians": (_CU, lambda: d(verb("toRadians", _KEY)), "round(radians(c_custkey), 6)"),
    "bearing": (_CU, lambda: d(verb("bearing", (C("c_custkey") % 80, "long"), (C("c_custkey") % 170, "long"), 10.0, 20.0)), "round((degrees(atan2(sin(radians(20 - c_custkey % 170)) * cos(radians(10)), cos(radians(c_custkey % 80)) * sin(radians(10)) - sin(radians(c_custkey % 80)) * cos(radians(10)) * cos(radians(20 - c_custkey % 170)))) + 360) % 360, 6)"),
    "midpoint_lat": (_CU, lambda: d(S.midpoint(C("c_custkey") % 80, C("c_custkey") % 170, 10.0, 20.0)["lat"]), "round(degrees(atan2(sin(radians(c_custkey % 80)) + sin(radians(10)), sqrt(pow(cos(radians(c_custkey % 80)) + cos(radians(10)) * cos(radians(20 - c_custkey % 170)), 2) + pow(cos(radians(10)) * sin(radians(20 - c_custkey % 170)), 2)))), 6)"),
}

#: name: (Column over ``a``, SQL over ``a``); a: an embedding's values as doubles with 6 places
ARRAYS = {
    "array_sum": (lambda a: d(A.sum_(a)), "round(list_sum(a), 6)"),
    "array_count": (lambda a: A.count(a), "CAST(len(a) AS BIGINT)"),
    "array_min": (lambda a: A.min_(a), "list_min(a)"),
    "array_max": (lambda a: A.max_(a), "list_max(a)"),
    "array_avg": (lambda a: d(A.avg(a)), "round(list_avg(a), 6)"),
    "array_first": (lambda a: A.first(a), "a[1]"),
    "array_last": (lambda a: A.last(a), "a[-1]"),
    "array_std": (lambda a: d(A.std(a)), "round(list_stddev_pop(a), 6)"),
    "array_std_sample": (lambda a: d(A.std(a, True)), "round(list_stddev_samp(a), 6)"),
    "array_variance": (lambda a: d(A.variance(a)), "round(list_var_pop(a), 6)"),
    "array_median": (lambda a: F.round(A.median(a) * 2, 6), "round(list_median(a) * 2, 6)"),
    "array_percentile": (lambda a: F.round(A.percentile(a, 90), 9), "round(list_aggregate(a, 'quantile_cont', 0.9), 9)"),
    "array_sort": (lambda a: A.at(A.sort(a), 3), "list_sort(a)[4]"),
    "array_sort_desc": (lambda a: A.at(A.sort(a, True), 3), "list_reverse_sort(a)[4]"),
    "array_reverse": (lambda a: A.at(A.reverse(a), 1), "a[-2]"),
    "array_at": (lambda a: A.at(a, -3), "a[-3]"),
    "array_slice": (lambda a: d(A.sum_(A.slice_(a, 2, -2))), "round(list_sum(a[3:-3]), 6)"),
    "array_filter": (lambda a: A.count(A.filter_(a, lambda x: x, ">", 0.1)), "CAST(len(list_filter(a, lambda x: x > 0.1)) AS BIGINT)"),
    "array_every": (lambda a: A.every(a, lambda x: x, "<", 0.4), "len(list_filter(a, lambda x: x < 0.4)) = len(a)"),
    "array_some": (lambda a: A.some(a, lambda x: x, ">", 0.3), "len(list_filter(a, lambda x: x > 0.3)) > 0"),
    "array_find": (lambda a: A.find(a, lambda x: x, ">", 0.1), "list_filter(a, lambda x: x > 0.1)[1]"),
    "array_index_of": (lambda a: A.find_index(a, lambda x: x, ">", 0.1), "coalesce(list_position(list_transform(a, lambda x: x > 0.1), true), 0) - 1"),
    "array_take": (lambda a: d(A.sum_(A.take(a, 5))), "round(list_sum(a[1:5]), 6)"),
    "array_drop": (lambda a: d(A.sum_(A.drop(a, 5))), "round(list_sum(a[6:]), 6)"),
    "array_chunk": (lambda a: F.size(A.chunk(a, 5)).cast("long"), "CAST(ceil(len(a) / 5) AS BIGINT)"),
    "array_cumsum": (lambda a: d(A.at(A.cumsum(a), 9)), "round(list_sum(a[1:10]), 6)"),
    "array_cumprod": (lambda a: F.round(A.at(A.cumprod(a), 2) * 1e6, 3), "round(a[1] * a[2] * a[3] * 1e6, 3)"),
    "array_lag": (lambda a: A.at(A.lag(a, 2), 5), "a[4]"),
    "array_lead": (lambda a: A.at(A.lead(a, 2), 5), "a[8]"),
    "array_diff": (lambda a: d(A.at(A.diff(a), 5)), "round(a[6] - a[5], 6)"),
    "array_pct_change": (lambda a: F.round(A.at(A.pct_change(a), 5), 3), "round(CASE WHEN a[5] <> 0 THEN (a[6] - a[5]) / a[5] END, 3)"),
    "array_moving_avg": (lambda a: F.round(A.at(A.moving_avg(a, 4), 6), 9), "round(list_avg(a[4:7]), 9)"),
    "array_zscore": (lambda a: d(A.at(A.zscore(a), 3)), "round((a[4] - list_avg(a)) / list_stddev_pop(a), 6)"),
    "array_rank": (lambda a: A.at(A.rank(a), 3), "CAST(len(list_filter(a, lambda x: x > a[4])) + 1 AS BIGINT)"),
    "array_window": (lambda a: F.size(A.window(a, 4)).cast("long"), "CAST(len(a) - 3 AS BIGINT)"),
    "array_fill_missing": (lambda a: d(A.sum_(A.fill_missing(F.transform(a, lambda x: F.when(x > 0, x)), "value", 1.0))), "round(list_sum(list_transform(a, lambda x: CASE WHEN x > 0 THEN x ELSE 1.0 END)), 6)"),
    "array_covariance": (lambda a: F.round(A.covariance(F.slice(a, 1, 32), F.slice(a, 33, 32)), 6), "round((SELECT covar_pop(x, y) FROM (SELECT unnest(a[1:32]) AS x, unnest(a[33:64]) AS y)), 6)"),
    "array_weighted_avg": (lambda a: F.round(A.weighted_avg(a, F.transform(a, lambda x: x * x)), 5), "round(list_sum(list_transform(a, lambda x: x * x * x)) / list_sum(list_transform(a, lambda x: x * x)), 5)"),
    "array_npv": (lambda a: d(S.npv(0.1, F.slice(a, 1, 4))), "round(a[1] + a[2] / 1.1 + a[3] / 1.21 + a[4] / 1.331, 6)"),
    "array_union": (lambda a: F.size(A.union(F.slice(a, 1, 10), F.slice(a, 5, 10))).cast("long"), "CAST(len(list_distinct(list_concat(a[1:10], a[5:14]))) AS BIGINT)"),
    "array_intersection": (lambda a: F.size(A.intersection(F.slice(a, 1, 10), F.slice(a, 5, 10))).cast("long"), "CAST(len(list_distinct(list_intersect(a[1:10], a[5:14]))) AS BIGINT)"),
    "array_difference": (lambda a: F.size(A.difference(F.slice(a, 1, 10), F.slice(a, 5, 10))).cast("long"), "CAST(len(list_distinct(list_filter(a[1:10], lambda x: NOT list_contains(a[5:14], x)))) AS BIGINT)"),
    "array_zip": (lambda a: F.size(A.zip_(F.slice(a, 1, 10), F.slice(a, 1, 7))).cast("long"), "CAST(7 AS BIGINT)"),
    # the present value at the rate found is nothing
    "array_irr": (lambda a: (lambda flows: F.abs(S.npv(S.irr(flows), flows)) < 1e-4)(F.concat(F.array(F.lit(-1.0)), F.transform(F.slice(a, 1, 5), lambda x: F.abs(x) + 0.2))), "true"),
    "array_reduce": (lambda a: d(A.reduce(a, lambda s, x: s + x, F.lit(0.0))), "round(list_sum(a), 6)"),
}

add_scalars(SCALARS)
add_arrays(ARRAYS)

# ---- groups, joins, windows, sets ------------------------------------------------------------------------


@query("revenue_by_flag", "SELECT l_returnflag, l_linestatus, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n FROM lineitem GROUP BY ALL")
def _(s, p):
    revenue = verb("multiply", ("l_extendedprice", "double"), (verb("subtract", 1, ("l_discount", "double")), "double"))
    return read(s, p, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum(revenue), 2).alias("revenue"), F.count(F.lit(1)).alias("n"))


@query("group_totals", "SELECT l_returnflag, round(sum(coalesce(q, 0)), 2) AS total, min(coalesce(q, 0)) AS least, max(coalesce(q, 0)) AS most, round(avg(coalesce(q, 0)), 6) AS mean, count(*) AS n FROM (SELECT l_returnflag, nullif(l_quantity, 10) AS q FROM lineitem) GROUP BY 1")
def _(s, p):
    df = read(s, p, "lineitem").withColumn("q", F.nullif(C("l_quantity"), F.lit(10.0)))
    out = R.totals(df, "l_returnflag", total=("sum", "q"), least=("min", "q"), most=("max", "q"), mean=("avg", "q"), n=("count", "q"))
    return out.withColumn("total", F.round("total", 2)).withColumn("mean", F.round("mean", 6))


@query("group_statistics", "SELECT l_returnflag, round(stddev_pop(l_quantity), 6) AS std, round(stddev_samp(l_quantity), 6) AS stds, round(var_pop(l_quantity), 6) AS var, round(var_samp(l_quantity), 6) AS vars, median(l_quantity) AS med FROM lineitem GROUP BY 1")
def _(s, p):
    out = R.totals(read(s, p, "lineitem"), "l_returnflag", std=("std", "l_quantity"), stds=("stdSample", "l_quantity"), var=("variance", "l_quantity"), vars=("varianceSample", "l_quantity"), med=("median", "l_quantity"))
    return out.select("l_returnflag", *[F.round(c, 6).alias(c) for c in ("std", "stds", "var", "vars")], "med")


@query("group_percentile", "SELECT event_type, round(quantile_cont(value, 0.9), 6) AS p90, round(covar_pop(value, user_id), 4) AS cov, round(corr(value, user_id), 6) AS corr, round(sum(value * user_id) / sum(user_id), 6) AS w FROM events GROUP BY 1")
def _(s, p):
    df = read(s, p, "events")
    return df.groupBy("event_type").agg(F.round(R.percentile(C("value"), 90), 6).alias("p90"), F.round(F.covar_pop("value", "user_id"), 4).alias("cov"), F.round(R.correlation(C("value"), C("user_id")), 6).alias("corr"), F.round(R.weighted_avg(C("value"), C("user_id")), 6).alias("w"))


@query("group_conditional", "SELECT l_returnflag, count(*) FILTER (l_quantity > 25) AS n, round(coalesce(sum(l_extendedprice) FILTER (l_quantity > 25), 0), 2) AS total, round(avg(l_discount) FILTER (l_quantity > 25), 6) AS mean FROM lineitem GROUP BY 1")
def _(s, p):
    pred = A.test(C("l_quantity"), ">", 25)
    return read(s, p, "lineitem").groupBy("l_returnflag").agg(F.count_if(pred).alias("n"), F.round(R.sum_if(pred, C("l_extendedprice")), 2).alias("total"), F.round(R.avg_if(pred, C("l_discount")), 6).alias("mean"))


@query("group_mode", "SELECT user_id, mode FROM (SELECT user_id, event_type AS mode, row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, max(event_id)) AS k FROM events GROUP BY 1, 2) WHERE k = 1")
def _(s, p):
    return R.mode(read(s, p, "events"), "user_id", "event_type", ["event_id"])


@query("count_by", "SELECT event_type AS key, count(*) AS count FROM events GROUP BY 1")
def _(s, p):
    return R.count_by(read(s, p, "events"), "event_type")


@query("first_last_by_group", "SELECT user_id, arg_min(event_type, event_id) AS first, arg_max(event_type, event_id) AS last FROM events GROUP BY 1")
def _(s, p):
    return read(s, p, "events").groupBy("user_id").agg(F.min_by("event_type", "event_id").alias("first"), F.max_by("event_type", "event_id").alias("last"))


@query("lookup_join", "SELECT c_custkey, n_name AS nation, coalesce(r_name, 'none') AS region FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN (SELECT * FROM region WHERE r_name <> 'ASIA') ON n_regionkey = r_regionkey")
def _(s, p):
    nation, region = read(s, p, "nation"), read(s, p, "region").where("r_name <> 'ASIA'")
    df = R.lookup(read(s, p, "customer"), nation, {"n_nationkey": "c_nationkey"}, {"n_name": "nation", "n_regionkey": "rk"}, ["n_nationkey"])
    return R.lookup(df, region, {"r_regionkey": "rk"}, {"r_name": "region"}, ["r_regionkey"], default="none").select("c_custkey", "nation", "region")


_W = "OVER (PARTITION BY user_id ORDER BY event_id"


@query("series_windows", f"SELECT event_id, round(sum(value) {_W}), 4) AS total, lag(value, 1) {_W}) AS before, lead(value, 2, -1.0) {_W}) AS after, round(value - lag(value) {_W}), 6) AS diff, round(avg(value) {_W} ROWS 2 PRECEDING), 6) AS moving, row_number() {_W}) AS n FROM events")
def _(s, p):
    v, by, o = C("value"), "user_id", "event_id"
    return read(s, p, "events").select("event_id", F.round(R.cumsum(v, by, o), 4).alias("total"), R.shift(v, 1, by, o).alias("before"), R.shift(v, -2, by, o, -1.0).alias("after"), F.round(R.diff(v, by, o), 6).alias("diff"), F.round(R.moving_avg(v, 3, by, o), 6).alias("moving"), R.row_number(by, o).alias("n"))


@query("series_pct_change", f"SELECT event_id, round(CASE WHEN lag(value) {_W}) <> 0 THEN (value - lag(value) {_W})) / lag(value) {_W}) END, 4) AS change FROM events")
def _(s, p):
    return read(s, p, "events").select("event_id", F.round(R.pct_change(C("value"), "user_id", "event_id"), 4).alias("change"))


@query("series_zscore", "SELECT event_id, round((value - avg(value) OVER w) / stddev_pop(value) OVER w, 6) AS z FROM events WINDOW w AS (PARTITION BY event_type)")
def _(s, p):
    return R.zscore(read(s, p, "events"), "value", "event_type").select("event_id", F.round("z", 6).alias("z"))


@query("series_rank", "SELECT o_orderkey, rank() OVER (PARTITION BY o_orderstatus ORDER BY CAST(o_totalprice / 1000 AS BIGINT) DESC) AS rank FROM orders")
def _(s, p):
    return read(s, p, "orders").select("o_orderkey", R.rank("o_orderstatus", F.desc(F.rint(C("o_totalprice") / 1000).cast("long"))).alias("rank"))


@query("series_fill_missing", f"SELECT event_id, coalesce(v, last_value(v IGNORE NULLS) {_W})) AS forward, coalesce(v, first_value(v IGNORE NULLS) {_W} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS backward FROM (SELECT event_id, user_id, CASE WHEN event_id % 3 > 0 THEN value END AS v FROM events)")
def _(s, p):
    v = F.when(C("event_id") % 3 > 0, C("value"))
    return read(s, p, "events").select("event_id", R.fill_missing(v, "forward", "user_id", "event_id").alias("forward"), R.fill_missing(v, "backward", "user_id", "event_id").alias("backward"))


@query("accumulate_and_sequence", "SELECT o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey), 2) AS running, 100 + row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS seq, max(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS last FROM orders")
def _(s, p):
    return read(s, p, "orders").select("o_orderkey", F.round(R.accumulate(C("o_totalprice"), "o_custkey", "o_orderkey"), 2).alias("running"), R.sequence("o_custkey", "o_orderkey", 100).cast("long").alias("seq"), R.set_last(C("o_orderkey"), "o_custkey", "o_orderkey").alias("last"))


@query("dedupe_documents", "SELECT min(doc_id) AS doc_id FROM documents GROUP BY text")
def _(s, p):
    return R.dedupe(read(s, p, "documents"), "text", ["doc_id"]).select("doc_id")


@query("top_per_group", "SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS n FROM orders) WHERE n <= 2")
def _(s, p):
    return R.top_per_group(read(s, p, "orders"), "o_custkey", [F.desc("o_totalprice"), F.asc("o_orderkey")], 2).select("o_orderkey")


@query("take_rows", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def _(s, p):
    return R.take(read(s, p, "orders"), 10, [F.desc("o_totalprice"), F.asc("o_orderkey")]).select("o_orderkey", "o_totalprice")


@query("set_operations", "SELECT 'union' AS op, k FROM (SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier) UNION ALL SELECT 'both', k FROM (SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier) UNION ALL SELECT 'left', k FROM (SELECT c_nationkey AS k FROM customer EXCEPT SELECT s_nationkey FROM supplier)")
def _(s, p):
    a, b = read(s, p, "customer").select(C("c_nationkey").alias("k")), read(s, p, "supplier").select(C("s_nationkey").alias("k"))
    parts = {"union": a.union(b).distinct(), "both": a.intersect(b), "left": a.subtract(b)}
    out = None
    for name, df in parts.items():
        df = df.select(F.lit(name).alias("op"), "k")
        out = df if out is None else out.union(df)
    return out


@query("symmetric_difference", "SELECT k FROM ((SELECT n_nationkey AS k FROM nation WHERE n_nationkey < 15 EXCEPT SELECT n_nationkey FROM nation WHERE n_nationkey > 9) UNION ALL (SELECT n_nationkey FROM nation WHERE n_nationkey > 9 EXCEPT SELECT n_nationkey FROM nation WHERE n_nationkey < 15))")
def _(s, p):
    n = read(s, p, "nation").select(C("n_nationkey").alias("k"))
    return R.symmetric_difference(n.where("k < 15"), n.where("k > 9"))


@query("pivot_events", "SELECT user_id, max_by(value, event_id) FILTER (event_type = 'view') AS \"view\", max_by(value, event_id) FILTER (event_type = 'click') AS click FROM events GROUP BY 1")
def _(s, p):
    return R.pivot(read(s, p, "events"), "user_id", "event_type", "value", ["event_id"], ["view", "click"])


@query("unpivot_customer", "SELECT c_custkey, 'c_nationkey' AS key, CAST(c_nationkey AS DOUBLE) AS value FROM customer UNION ALL SELECT c_custkey, 'c_acctbal', c_acctbal FROM customer")
def _(s, p):
    return R.unpivot(read(s, p, "customer").withColumn("c_nationkey", C("c_nationkey").cast("double")), "c_custkey", ["c_nationkey", "c_acctbal"])


@query("explode_words", "SELECT doc_id, w, count(*) AS n FROM (SELECT doc_id, unnest(string_split(text, ' ')) AS w FROM documents) GROUP BY ALL")
def _(s, p):
    # a document's words lie in one row: counted there, they needn't be shuffled
    words = F.sort_array(F.split("text", " "))
    runs = F.filter(F.transform(C("words"), lambda w, i: F.struct(w.alias("w"), i.alias("i"))), lambda x: (x["i"] == 0) | (F.get(C("words"), x["i"] - 1) != x["w"]))
    counted = F.transform(C("runs"), lambda x, k: F.struct(x["w"].alias("w"), (F.coalesce(F.get(C("runs"), k + 1)["i"], F.size("words")) - x["i"]).cast("long").alias("n")))
    df = read(s, p, "documents").select("doc_id", words.alias("words")).select("doc_id", "words", runs.alias("runs")).select("doc_id", counted.alias("c"))
    return R.explode(df, "c").select("doc_id", "c.w", "c.n")


@query("partition_rows", "SELECT o_orderstatus = 'O' AS open, count(*) AS n FROM orders GROUP BY 1")
def _(s, p):
    a, b = R.partition(read(s, p, "orders"), C("o_orderstatus") == "O")
    return a.select(F.lit(True).alias("open")).union(b.select(F.lit(False).alias("open"))).groupBy("open").agg(F.count(F.lit(1)).alias("n"))


@query("group_by_items", "SELECT user_id, event_type AS key, count(*) AS n, min(event_id) AS first FROM events GROUP BY ALL")
def _(s, p):
    items = read(s, p, "events").groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("event_id", "event_type"))).alias("a"))
    return items.select("user_id", F.explode(A.group_by(C("a"), lambda x: x["event_type"])).alias("g")).select("user_id", "g.key", F.size("g.items").cast("long").alias("n"), F.get("g.items", 0)["event_id"].alias("first"))


@query("object_functions", "SELECT c_custkey, 3 AS n, c_name AS name, c_mktsegment AS seg, coalesce(c_name, '') AS again FROM customer")
def _(s, p):
    m = F.create_map(F.lit("name"), C("c_name"), F.lit("segment"), C("c_mktsegment"))
    m = A.merge(m, F.create_map(F.lit("x"), F.lit("")))
    return read(s, p, "customer").select("c_custkey", F.size(A.keys(m)).alias("n"), A.get(A.pick(m, "name"), "name").alias("name"), A.get(A.rename_keys(A.omit(m, "x"), {"segment": "s"}), "s").alias("seg"), A.get(A.compact_object(m), "name", "").alias("again"))


# ---- programs, routing, validation, documents, formats, streams -----------------------------------------

PROGRAM = """
{$const}
rate = 0.2
{$table.STATUS[code, name]}
"O", "Open"
"F", "Filled"
{}
id = @o_orderkey
status = %lookupDefault STATUS.name @o_orderstatus "?"
gross = %round %multiply @o_totalprice %add ##1 @$const.rate ##2
net = %expr "o_totalprice - o_totalprice * 0.1"
size = %cond %lt @o_totalprice ##50000 "S" %lt @o_totalprice ##150000 "M" "L"
urgent = ?true :if o_orderpriority = 1-URGENT
year = %formatDate @o_orderdate "YYYY" :type integer
"""


@query("program_orders", "SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'O' THEN 'Open' WHEN 'F' THEN 'Filled' ELSE '?' END AS status, floor(o_totalprice * 1.2 * 100 + 0.5) / 100 AS gross, round(o_totalprice - o_totalprice * 0.1, 4) AS net, CASE WHEN o_totalprice < 50000 THEN 'S' WHEN o_totalprice < 150000 THEN 'M' ELSE 'L' END AS size, CASE WHEN o_orderpriority = '1-URGENT' THEN true END AS urgent, year(o_orderdate) AS year FROM orders")
def _(s, p):
    return apply(PROGRAM, read(s, p, "orders")).withColumn("net", F.round("net", 4))


LOOP = """
{}
user = @user_id
{hits[]}
:loop items
id = @.event_id
kind = @.event_type :upper
double = %multiply @.value ##2
"""


@query("program_loop", "SELECT user_id AS \"user\", event_id AS id, upper(event_type) AS kind, round(value * 2, 6) AS \"double\" FROM events")
def _(s, p):
    nested = read(s, p, "events").groupBy("user_id").agg(F.collect_list(F.struct("event_id", "event_type", "value")).alias("items"))
    out = apply(LOOP, nested)
    return out.select("user", F.explode("hits").alias("h")).select("user", "h.id", "h.kind", F.round("h.double", 6).alias("double"))


BRANCH = """
{deal}
:if %gt @o_totalprice ##100000
label = "big"
{deal}
:elif o_orderstatus = O
label = "open"
{deal}
:else
label = "rest"
"""


@query("program_branches", "SELECT o_orderkey, CASE WHEN o_totalprice > 100000 THEN 'big' WHEN o_orderstatus = 'O' THEN 'open' ELSE 'rest' END AS label FROM orders")
def _(s, p):
    df = read(s, p, "orders")
    return apply("{}\nkey = @o_orderkey\n" + BRANCH, df).select(C("key").alias("o_orderkey"), "deal.label")


@query("route_records", "SELECT o_orderkey, 'H' || lpad(CAST(o_orderkey AS VARCHAR), 8, '0') AS line FROM orders WHERE o_orderkey % 2 = 0")
def _(s, p):
    lines = read(s, p, "orders").select(F.concat(F.when(C("o_orderkey") % 2 == 0, "H").otherwise("D"), F.lpad(C("o_orderkey").cast("string"), 8, "0")).alias("value"))
    head = readers.route(lines, F.substring("value", 1, 1), {"head": ("H",), "detail": ("D",)})["head"]
    return readers.fixed_width(head, [{"name": "o_orderkey", "pos": 1, "len": 8, "type": "integer"}, {"name": "line", "pos": 0, "len": 9}])


SCHEMA = V.Schema(
    [
        V.Field("c_name", required=True, pattern="^Customer", bounds=(1, 12)),
        V.Field("c_acctbal", "number", bounds=(0, 9000)),
        V.Field("c_mktsegment", required=True, enum=("BUILDING", "MACHINERY", "AUTOMOBILE")),
        V.Field("c_nationkey", "integer", bounds=(None, 20)),
    ],
    invariants=["c_acctbal + 10 > c_nationkey"],
)


@query("validate_customer", """SELECT c_custkey, code, path FROM (
    SELECT c_custkey, 'V003' AS code, 'c_name' AS path FROM customer WHERE length(c_name) > 12 UNION ALL
    SELECT c_custkey, 'V004', 'c_name' FROM customer WHERE NOT regexp_matches(c_name, '^Customer') UNION ALL
    SELECT c_custkey, 'V003', 'c_acctbal' FROM customer WHERE c_acctbal < 0 OR c_acctbal > 9000 UNION ALL
    SELECT c_custkey, 'V005', 'c_mktsegment' FROM customer WHERE c_mktsegment NOT IN ('BUILDING', 'MACHINERY', 'AUTOMOBILE') UNION ALL
    SELECT c_custkey, 'V003', 'c_nationkey' FROM customer WHERE c_nationkey > 20 UNION ALL
    SELECT c_custkey, 'V008', '' FROM customer WHERE NOT (c_acctbal + 10 > c_nationkey))""")
def _(s, p):
    return V.failures(read(s, p, "customer"), SCHEMA, "c_custkey")


def _snapshots(s, p):
    df = read(s, p, "customer").select("c_custkey", "c_name", "c_mktsegment")
    new = df.where("c_custkey % 7 <> 0").withColumn("c_mktsegment", F.when(C("c_custkey") % 5 == 0, "NEW").otherwise(C("c_mktsegment")))
    return D.paths(df, "c_custkey"), D.paths(new, "c_custkey")


@query("diff_documents", """SELECT c_custkey AS doc_id, 'delete' AS op, unnest(['c_name', 'c_mktsegment']) AS path FROM customer WHERE c_custkey % 7 = 0
    UNION ALL SELECT c_custkey, 'modify', 'c_mktsegment' FROM customer WHERE c_custkey % 7 <> 0 AND c_custkey % 5 = 0""")
def _(s, p):
    return D.diff(*_snapshots(s, p)).select("doc_id", "op", "path")


@query("patch_documents", "SELECT c_custkey AS doc_id, 'c_name' AS path, c_name AS value FROM customer WHERE c_custkey % 7 <> 0 UNION ALL SELECT c_custkey, 'c_mktsegment', CASE WHEN c_custkey % 5 = 0 THEN 'NEW' ELSE c_mktsegment END FROM customer WHERE c_custkey % 7 <> 0")
def _(s, p):
    a, b = _snapshots(s, p)
    return D.patch(a, D.diff(a, b))


@query("collapse_chain", "SELECT user_id AS doc_id, event_type AS path, arg_max(value, event_id) AS value FROM events GROUP BY ALL")
def _(s, p):
    chain = read(s, p, "events").select(C("user_id").alias("doc_id"), C("event_id").alias("version"), C("event_type").alias("path"), "value")
    return D.collapse(chain)


@query("canonical_hash", "SELECT c_custkey AS doc_id, sha256('c_mktsegment=' || c_mktsegment || chr(10) || 'c_name=' || c_name) AS hash FROM customer")
def _(s, p):
    return D.canonical_hash(_snapshots(s, p)[0])


@query("write_csv", "SELECT c_custkey || ',' || c_name || ',\"' || c_mktsegment || ', x\"' AS value FROM customer")
def _(s, p):
    return writers.as_csv(read(s, p, "customer").select("c_custkey", "c_name", F.concat("c_mktsegment", F.lit(", x")).alias("m")))


@query("write_fixed_width", "SELECT lpad(CAST(c_custkey AS VARCHAR), 8, '0') || rpad(c_mktsegment, 12, ' ') AS value FROM customer")
def _(s, p):
    return writers.as_fixed_width(read(s, p, "customer"), [{"name": "c_custkey", "len": 8, "pad": "0"}, {"name": "c_mktsegment", "len": 12}])


@query("write_json", "SELECT '{\"k\":' || c_custkey || ',\"n\":\"' || c_name || '\"}' AS value FROM customer")
def _(s, p):
    return writers.as_json(read(s, p, "customer").select(C("c_custkey").alias("k"), C("c_name").alias("n")))


@query("write_flat", "SELECT c_custkey AS doc_id, 'c_mktsegment=' || c_mktsegment || chr(10) || 'c_name=' || c_name AS value FROM customer")
def _(s, p):
    return writers.as_flat(_snapshots(s, p)[0])


@query("write_notation", "SELECT 'k = ##' || c_custkey || chr(10) || 'n = \"' || c_name || '\"' AS value FROM customer")
def _(s, p):
    return writers.as_notation(read(s, p, "customer").select(C("c_custkey").alias("k"), C("c_name").alias("n")))


@query("tumbling_windows", "SELECT time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def _(s, p):
    return E.tumbling(read(s, p, "events"), "ts", "6 hours", ["event_type"], n=F.count(F.lit(1)))


from . import catalogue_formats, catalogue_programs, catalogue_verbs  # noqa: E402, F401  (they register their queries)
