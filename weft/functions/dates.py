"""Dates read and written by patterns of YYYY YY MM DD HH hh mm ss SSS A, by locales, and as durations."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .coerce import NUMBER, col, text

_TOKEN = re.compile(r"YYYY|YY|MM|DD|HH|hh|mm|SSS|ss|A")
_LETTERS = {"YYYY": "yyyy", "YY": "yy", "DD": "dd", "A": "a"}


def formatted(moment: Column, pattern: str) -> Column:
    """All that is no part of the pattern stands for itself."""
    parts, at = [], 0
    for m in _TOKEN.finditer(pattern):
        parts += [F.lit(pattern[at : m.start()]), F.date_format(moment, _LETTERS.get(m[0], m[0]))]
        at = m.end()
    return F.concat(*parts, F.lit(pattern[at:]))


def moment(x) -> Column:
    """A timestamp of a text: ISO, without a zone UTC, or a time of day on 1970-01-01; null for others."""
    s = text(x)
    time = F.regexp_like(s, F.lit(r"^\d{2}:\d{2}(:\d{2})?$"))
    iso = F.regexp_like(s, F.lit(r"^\d{4}-\d{2}-\d{2}(T\d{2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:?\d{2})?)?$"))
    return F.when(time, F.concat(F.lit("1970-01-01T"), s)).when(iso, s).try_cast("timestamp")


def _part(s: Column, pattern: str, token: str, default: int | None) -> Column:
    at = pattern.find(token)
    if at < 0:
        return F.lit(default).cast("int")
    return F.regexp_extract(F.substring(s, at + 1, len(token)), r"^\s*([+-]?\d+)", 1).try_cast("int")


def parsed(x, pattern: str) -> Column:
    """A timestamp from the digits at the pattern's places; parts out of range roll over; null without a year."""
    s = text(x)
    year = _part(s, pattern, "YYYY", None) if "YYYY" in pattern else 2000 + _part(s, pattern, "YY", None)
    month, day, hour, minute, second = (_part(s, pattern, t, d) for t, d in (("MM", 1), ("DD", 1), ("HH", 0), ("mm", 0), ("ss", 0)))
    first = F.add_months(F.make_date(F.when(year.between(1, 9998), year), F.lit(1), F.lit(1)), month - 1)
    seconds = F.unix_date(first).cast("long") * 86_400 + (day - 1).cast("long") * 86_400 + hour * 3600 + minute * 60 + second
    return F.timestamp_seconds(seconds)


def parse_date(x, pattern: str) -> Column:
    return F.date_format(parsed(x, pattern), "yyyy-MM-dd")


def parse_timestamp(x, pattern: str) -> Column:
    return F.date_format(parsed(x, pattern), "yyyy-MM-dd'T'HH:mm:ss")


#: Patterns that ``is_valid`` knows, in Spark's letters.
STRICT = {"YYYY-MM-DD": "yyyy-MM-dd", "MM/DD/YYYY": "MM/dd/yyyy", "DD/MM/YYYY": "dd/MM/yyyy", "YYYY/MM/DD": "yyyy/MM/dd"}


def is_valid(x, pattern: str) -> Column:
    """Whether a text has exactly the pattern's form and names a day that there is; null for other patterns."""
    if pattern not in STRICT:
        return F.lit(None).cast("boolean")
    s = text(x)
    shape = "^" + re.sub(r"[YMD]", r"\\d", pattern) + "$"
    fits = F.regexp_like(s, F.lit(shape))
    return fits & F.try_to_timestamp(F.when(fits, s), F.lit(STRICT[pattern])).isNotNull()


#: Fixed value: the form of ISO 8601 durations, from years to seconds.
ISO_DURATION = r"^P(?:(\d+)Y)?(?:(\d+)M)?(?:(\d+)D)?(?:T(?:(\d+)H)?(?:(\d+)M)?(?:(\d+(?:\.\d+)?)S)?)?$"


def duration(x, kind: str = "string") -> Column:
    """Seconds, or an ISO 8601 duration, in words."""
    s = text(x, kind)
    units = ("year", "month", "day", "hour", "minute", "second")
    iso = ISO_DURATION
    plain = F.regexp_like(s, F.lit(r"^\d+(?:\.\d+)?$"))
    total = F.when(plain, s).try_cast("double")
    split = F.array(F.lit(0.0), F.lit(0.0), *[c.cast("double") for c in (F.floor(total / 86_400), F.floor(total % 86_400 / 3600), F.floor(total % 3600 / 60))], total - F.floor(total / 60) * 60)
    given = F.split(F.regexp_replace(s, iso, ",".join(f"${k + 1}" for k in range(len(units)))), ",")
    counts = F.when(plain, split).otherwise(F.transform(given, lambda n: F.coalesce(n.try_cast("double"), F.lit(0.0))))

    def part(n, k):
        said = F.when(n == F.floor(n), n.cast("long").cast("string")).otherwise(F.format_string("%.1f", n))
        return F.when(n > 0, F.concat(said, F.lit(" "), F.get(F.array(*map(F.lit, units)), k), F.when(n == 1, "").otherwise("s")))

    out = F.array_join(F.transform(counts, part), ", ")  # what is null is left out
    return F.when(plain | F.regexp_like(s, F.lit(iso)), F.get(F.transform(F.array(out), lambda o: F.when(o == "", "0 seconds").otherwise(o)), 0))


#: How locales write short dates, and their thousands and decimal marks.
LOCALE_DATES = {
    "en-US": "M/d/yyyy", "en-GB": "dd/MM/yyyy", "en-AU": "dd/MM/yyyy", "en-IN": "d/M/yyyy", "de-DE": "d.M.yyyy", "de-AT": "d.M.yyyy", "fr-FR": "dd/MM/yyyy", "es-ES": "d/M/yyyy", "it-IT": "d/M/yyyy",
    "nl-NL": "d-M-yyyy", "pt-BR": "dd/MM/yyyy", "pl-PL": "d.MM.yyyy", "ru-RU": "dd.MM.yyyy", "sv-SE": "yyyy-MM-dd", "ja-JP": "yyyy/M/d", "zh-CN": "yyyy/M/d", "ko-KR": "yyyy. M. d.",
}
LOCALE_MARKS = {
    "en-US": (",", "."), "en-GB": (",", "."), "en-AU": (",", "."), "ja-JP": (",", "."), "zh-CN": (",", "."), "ko-KR": (",", "."), "de-DE": (".", ","), "it-IT": (".", ","), "nl-NL": (".", ","),
    "pt-BR": (".", ","), "es-ES": (".", ","), "fr-FR": (" ", ","), "pl-PL": (" ", ","), "ru-RU": (" ", ","), "sv-SE": (" ", ","), "de-AT": (" ", ","),
}
#: Locales that group only numbers of five digits and more.
LOCALE_WIDE = ("es-ES", "pl-PL")
DEFAULT_LOCALE = "en-US"


def locale_date(day, locale: str = DEFAULT_LOCALE) -> Column:
    return F.date_format(col(day), LOCALE_DATES.get(locale, LOCALE_DATES[DEFAULT_LOCALE]))


def locale_number(n, locale: str = DEFAULT_LOCALE) -> Column:
    """Three decimals at most, half away from zero; null for what isn't finite."""
    n = col(n).cast("double")
    thousands, decimal = LOCALE_MARKS.get(locale, LOCALE_MARKS[DEFAULT_LOCALE])
    value = F.round(n, 3)
    said = F.translate(F.call_function("format_number", value, F.lit("#,##0.###")), ",.", f"{thousands}{decimal}")
    if locale in LOCALE_WIDE:
        said = F.when(F.abs(value) < 10_000, F.translate(F.call_function("format_number", value, F.lit("0.###")), ".", decimal)).otherwise(said)
    return F.when(~F.isnan(n) & (F.abs(n) < float("inf")), said)


def number_prefix(s: Column) -> Column:
    return F.regexp_extract(s, NUMBER, 1).try_cast("double")
