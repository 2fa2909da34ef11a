"""Line-first cleaning with DataFrame functions only.

Each line of a text is judged on its own:

* boilerplate: it equals an earlier line of its text, or holds one of a few phrases of licences, consents
  and site furniture and is short;
* navigation: its words stand between bars or bullets;
* punctuation: it holds no end mark anywhere though it is long enough to be prose, or its words mostly end in
  runs of symbols or marks, or it repeats a few words again and again.

Lines that fail are removed; a document is rejected when too little of its text remains, or when the base
rules (too few words, too many words in repeated five-word windows) reject it.

Five-word windows are compared by their 64-bit XXH64, which within one text can't be expected to collide.

Defined results: null and empty texts have no words and are rejected (n_words < 10); repeated rows and ids
give a row each; null ids stay; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

WINDOW = 5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
#: A document that keeps less than this share of its non-space characters is rejected.
MIN_KEPT = 0.4
#: A line of fewer words is taken for a heading, which needs no end mark.
HEADING_WORDS = 8
#: A line with a phrase of site furniture fails only if it is at most so long: prose may mention such things.
FURNITURE_CHARS = 200
SYMBOLS = r"[#*$%&|<>]"
#: Phrases of boilerplate lines.
FURNITURE = (
    r"(?i)\b(all rights reserved|cookie policy|privacy policy|terms (of|and) (use|service|conditions)|click here|subscribe to|sign (in|up)|log ?in"
    r"|share (this|on)|read more|skip to (main )?content|back to top|licensed under|creative commons|copyright (\(c\)|©)|powered by|javascript)\b"
)
END_MARK = r"[.!?…。！？]"

#: Marks whose runs at the ends of words make a line a symbol line.
RUNS = ("!!", "??", "**", "##", "%%", "&&", "$$", "~~", "==", "__", "^^", "<<", ">>", "++")


def _spaced(text: Column, by: str) -> Column:
    """ASCII white space replaced."""
    for mark in "\t\n\x0b\x0c\r":
        text = F.replace(text, F.lit(mark), F.lit(by))
    return text if by == " " else F.replace(text, F.lit(" "), F.lit(by))


def _any(text: Column, marks) -> Column:
    found = F.contains(text, F.lit(marks[0]))
    for mark in marks[1:]:
        found = found | F.contains(text, F.lit(mark))
    return found


def line_fails(line: Column) -> Column:
    """Whether a line (with its words' and distinct words' number) is to be removed. Cheap tests come first."""
    text, n = line["line"], line["n"]
    bars = F.regexp_count(text, F.lit(r"[|•·»›]"))
    navigation = _any(text, "|•·»›") & (bars >= 2) & (bars * 5 >= n)
    furniture = (F.length(text) <= FURNITURE_CHARS) & F.regexp_like(text, F.lit(FURNITURE))
    odd_ends = F.regexp_count(text, F.lit(r"([#*$%&<>~^_=+]{2,}|[!?]{2,})(?=\s|$)"))
    symbols = _any(text, RUNS) & (odd_ends >= 2) & (odd_ends * 3 >= n)
    stutter = (n >= 12) & (line["own"] * 5 <= n)
    no_end = (n >= HEADING_WORDS) & ~F.regexp_like(text, F.lit(END_MARK))
    return stutter | no_end | navigation | symbols | furniture


def _steps(plain: Column, c):
    """(name, what gives its Column) in order; c(name) is the Column of an earlier one."""
    pair = lambda a, b: F.xxhash64(a, b)
    rest = lambda n, k: F.slice(c(n), k + 1, F.greatest(F.size(c(n)) - k, F.lit(0)))
    same = lambda a, b: F.coalesce(a["h"] == b["h"], F.lit(False))
    yield "plain", lambda: plain
    yield "spaced", lambda: _spaced(c("plain"), " ")
    yield "word_chars", lambda: F.length(F.replace(c("spaced"), F.lit(" "), F.lit(""))).cast("long")
    yield "words", lambda: F.array_remove(F.split(c("spaced"), " "), "")
    yield "n_words", lambda: F.size(c("words")).cast("long")
    # a window's hash, from its words' by doubling: 1, 2, 4 and then 5 words
    yield "h1", lambda: F.when(c("n_words") >= WINDOW, F.transform(c("words"), lambda x: F.xxhash64(x))).otherwise(F.array().cast("array<bigint>"))
    yield "h2", lambda: F.zip_with(c("h1"), rest("h1", 1), pair)
    yield "h4", lambda: F.zip_with(c("h2"), rest("h2", 2), pair)
    yield "h5", lambda: F.zip_with(c("h4"), rest("h1", 4), pair)
    yield "hashes", lambda: F.slice(c("h5"), 1, F.greatest(F.size(c("h5")) - WINDOW + 1, F.lit(0)))
    # which windows recur: only texts with any pay for the sort
    yield "at", lambda: F.when(
        F.size(F.array_distinct(c("hashes"))) < F.size(c("hashes")), F.sort_array(F.transform(c("hashes"), lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    ).otherwise(F.array().cast("array<struct<h:bigint,i:int>>"))
    yield "marked", lambda: F.sort_array(F.transform(F.filter(c("at"), lambda x, k: same(F.get(c("at"), k + 1), x) | same(F.get(c("at"), k - 1), x)), lambda x: x["i"]))
    yield "n_repeat_words", lambda: F.aggregate(
        F.transform(c("marked"), lambda i, k: F.least(F.lit(WINDOW), F.coalesce(F.get(c("marked"), k + 1) - i, F.lit(WINDOW)))), F.lit(0).cast("long"), lambda a, x: a + x
    )
    yield "n_symbols", lambda: F.when(_any(c("plain"), "#*$%&|<>"), F.regexp_count(c("plain"), F.lit(SYMBOLS))).otherwise(0).cast("long")
    yield "lines", lambda: F.filter(F.split(c("plain"), "\n"), lambda x: F.regexp_like(x, F.lit(r"[^\x20\x09-\x0D]")))
    yield "own", lambda: F.array_distinct(c("lines"))  # a line equal to an earlier one is gone
    yield "n_dup_lines", lambda: (F.size(c("lines")) - F.size(c("own"))).cast("long")
    yield "parts", lambda: F.transform(c("own"), lambda x: F.struct(x.alias("line"), F.split(x, " ").alias("parts")))
    yield "measured", lambda: F.transform(c("parts"), lambda x: F.struct(x["line"].alias("line"), F.size(x["parts"]).alias("n"), F.size(F.array_distinct(x["parts"])).alias("own")))
    yield "kept_lines", lambda: F.transform(F.filter(c("measured"), lambda x: ~line_fails(x)), lambda x: x["line"])
    yield "kept_chars", lambda: F.when(F.size(c("kept_lines")) == F.size(c("lines")), c("word_chars")).otherwise(F.length(_spaced(F.array_join(c("kept_lines"), ""), "")).cast("long"))
    yield "base_failed", lambda: (c("n_words") < MIN_WORDS) | (100 * c("n_repeat_words") > MAX_REPEAT_PERCENT * c("n_words"))
    yield "kept", lambda: ~c("base_failed") & (c("kept_chars") >= MIN_KEPT * c("word_chars"))


def _plain(text: str) -> Column:
    return F.coalesce(F.col(text).cast("string"), F.lit(""))


def assessed(docs: DataFrame, text: str = "text", prefix: str = "_q_") -> DataFrame:
    """``docs`` with a column for each step of the verdict, named with ``prefix``; no shuffle, no Python."""
    out = docs
    for name, step in _steps(_plain(text), lambda n: F.col(f"{prefix}{n}")):
        out = out.withColumn(f"{prefix}{name}", step())
    return out


COLUMNS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def _barred(c: Column) -> Column:
    """The same values, of which the optimizer won't write the expressions into a filter above, over and over: it pushes no
    filter through columns that it takes to change from run to run, as numbers of rows do."""
    return F.when(F.monotonically_increasing_id() >= 0, c)


def quality_rules(docs: DataFrame) -> DataFrame:
    """(doc_id, measures, base_failed, kept, kept_chars) of every document."""
    own = assessed(docs.select("doc_id", F.col("text").alias("_q_text")), "_q_text")
    return own.select("doc_id", *[_barred(F.col(f"_q_{n}")).alias(n) for n in (*COLUMNS, "kept_chars")])


def _kept(docs: DataFrame, *more: str) -> DataFrame:
    """The rows that are kept, with some steps' columns."""
    prefix = "_q" + "_" * max(map(len, docs.columns)) + "_"
    own = assessed(docs, prefix=prefix)
    own = own.select(*docs.columns, _barred(F.col(f"{prefix}kept")).alias(f"{prefix}kept"), *[F.col(f"{prefix}{n}").alias(f"{prefix}{n}") for n in more])
    return own.where(f"{prefix}kept").withColumnsRenamed({f"{prefix}{n}": n for n in more}).drop(f"{prefix}kept")


def cleaned(docs: DataFrame) -> DataFrame:
    """The documents that are kept, with their columns, and ``clean_text``: the lines that stand."""
    return _kept(docs, "kept_lines").withColumn("clean_text", F.array_join("kept_lines", "\n")).select(*docs.columns, "clean_text")


def reject(docs: DataFrame) -> DataFrame:
    """The documents that are kept, unchanged."""
    return _kept(docs)


def op4_quality_rules(spark, sf_dir):
    return quality_rules(common.table(spark, sf_dir, "documents"))
