"""Text functions as Column expressions; two Arrow functions where Spark has no Unicode normalisation."""

from __future__ import annotations

import re
import unicodedata
from collections import Counter

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

#: White space as Python's ``str`` methods see it, for Java character classes; without and with line breaks.
BLANK = r"\t\x0b\x0c\x1c-\x20\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
ANY_BLANK = BLANK + r"\n\r"

# Words that the index leaves out.
STOPWORDS = (
    "a an and are as at be been but by can for from had has have he her his how in into is it its of on or our "
    "she so than that the their them then there these they this to was were what when which who will with you your"
).split()

# What marks a statement as negated.
NEGATION = r"(?iU)\b(not|no|never|cannot|can't|without|fails to|does not|do not|is not|are not|lacks|absent|excludes|unavailable|non-)\b"

#: The same with words of ASCII characters alone, as SQL engines see them, in lower-case texts: ``noñ`` holds the word ``no``.
_WORD = "0-9A-Za-z_"
NEGATION_ASCII = rf"(?<![{_WORD}])(?:(?:not|no|never|cannot|can't|without|fails to|does not|do not|is not|are not|lacks|absent|excludes|unavailable)(?![{_WORD}])|non-(?=[{_WORD}]))"

# Multipliers after a number.
MULTIPLIERS = {"k": 1e3, "thousand": 1e3, "m": 1e6, "million": 1e6, "bn": 1e9, "b": 1e9, "billion": 1e9}
_NUMBER = r"(?iU)(-?\d[\d,]*(?:\.\d+)?)\s*(%|k\b|m\b|bn\b|b\b|million|billion|thousand)?"
_NUMBER_ASCII = rf"(?i)(-?[0-9][0-9,]*(?:\.[0-9]+)?)[\t\n\f\r ]*(%|(?:k|m|bn|b)(?![{_WORD}])|million|billion|thousand)?"
_DATE, _DATE_ASCII = r"(?U)\b(\d{4}-\d{2}-\d{2})\b", rf"(?<![{_WORD}])([0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}})(?![{_WORD}])"


@pandas_udf(T.StringType())
def nfc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: x if x is None or x.isascii() else unicodedata.normalize("NFC", x))


def _folded(x: str) -> str:
    return x.lower() if x.isascii() else unicodedata.normalize("NFKD", x).casefold()


@pandas_udf(T.StringType())
def fold(s: pd.Series) -> pd.Series:
    """Compatibility decomposition and case folding."""
    return s.map(lambda x: None if x is None else _folded(x))


def strip(x: Column) -> Column:
    return F.regexp_replace(x, f"^[{ANY_BLANK}]+|[{ANY_BLANK}]+$", "")


def norm_ws(x: Column) -> Column:
    """Runs of white space become one space; none at the ends."""
    return F.trim(F.regexp_replace(x, f"[{ANY_BLANK}]+", " "))


def normalize(x: Column) -> Column:
    """The canonical text: NFC, LF, no trailing blanks, at most one empty line, one final LF."""
    lines = F.regexp_replace(F.regexp_replace(nfc(x), "\r\n?", "\n"), rf"[{BLANK}]+(?=\n|\z)", "")
    return F.concat(F.regexp_replace(F.regexp_replace(lines, "\n{3,}", "\n\n"), r"\n+\z", ""), F.lit("\n"))


def tokenize(x: Column) -> Column:
    """Index terms in order: runs of a-z and 0-9 of at least two characters that aren't stopwords."""
    words = F.regexp_extract_all(fold(x), F.lit("([a-z0-9]+)"), 1)
    return F.filter(words, lambda w: (F.length(w) > 1) & ~w.isin(STOPWORDS))


_STOPPED, _TERM = frozenset(STOPWORDS), re.compile("[a-z0-9]{2,}")


@pandas_udf(T.ArrayType(T.StructType([T.StructField("term", T.StringType()), T.StructField("tf", T.LongType())])))
def term_counts(s: pd.Series) -> pd.Series:
    """The terms that ``tokenize`` gives, each once, with how often."""
    counted = lambda x: [{"term": w, "tf": n} for w, n in Counter(_TERM.findall(_folded(x))).items() if w not in _STOPPED]
    return pd.Series([None if x is None else counted(x) for x in s], dtype=object)


def leading_number(x: Column, ascii: bool = False) -> Column:
    """The first number of a text times its multiplier; a percent sign does not scale."""
    pattern = _NUMBER_ASCII if ascii else _NUMBER
    value = F.regexp_replace(F.regexp_extract(x, pattern, 1), ",", "").try_cast("double")
    suffix = F.lower(F.regexp_extract(x, pattern, 2))
    scale = F.lit(1.0)
    for word, times in MULTIPLIERS.items():
        scale = F.when(suffix == word, F.lit(times)).otherwise(scale)
    return value * scale


def iso_dates(x: Column, ascii: bool = False) -> Column:
    """The distinct dates written YYYY-MM-DD, sorted."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(x, F.lit(_DATE_ASCII if ascii else _DATE), 1)))


def negated(x: Column, ascii: bool = False) -> Column:
    """Whether a text denies something; words end where a letter of any script does not follow, with ``ascii`` where none of A-Z does."""
    return F.lower(F.translate(x, "İ", "i")).rlike(NEGATION_ASCII) if ascii else x.rlike(NEGATION)


def span(text: Column, start: Column, end: Column) -> Column:
    """Characters start to end, counted from 0, the end left out."""
    return F.substring(text, start + 1, end - start)


def find_first(text: Column, needle: Column) -> Column:
    """Offset of the first match; null if there is none."""
    at = F.position(needle, text)
    return F.when(at > 0, at - 1)


def literal(x: Column) -> Column:
    """A pattern that matches a text as it is."""
    return F.concat(F.lit(r"\Q"), F.replace(x, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))


def find_all(text: Column, needle: Column) -> Column:
    """Offsets of all matches, overlapping ones too: the text is cut before each match, and the lengths add up."""
    cut = F.transform(F.split(text, F.concat(F.lit("(?="), literal(needle), F.lit(")"))), lambda x, i: F.struct(F.length(x).alias("n"), (i > 0).alias("later")))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("found"))
    step = lambda s, x: F.struct((s["at"] + x["n"]).alias("at"), F.when(x["later"] | text.startswith(needle), F.array_append(s["found"], s["at"])).otherwise(s["found"]).alias("found"))
    return F.when(F.length(needle) > 0, F.aggregate(cut, start, step)["found"]).otherwise(F.array().cast("array<int>"))


def blank_tolerant(needle: Column) -> Column:
    """A pattern for the needle's words with any white space between them."""
    words = F.filter(F.split(norm_ws(needle), " "), lambda w: w != "")
    return F.array_join(F.transform(words, literal), f"[{ANY_BLANK}]+")


def find_tolerant(text: Column, needle: Column) -> Column:
    """(start, end) of the first match when white space may differ; null if there is none."""
    pattern = blank_tolerant(needle)
    at, hit = F.regexp_instr(text, pattern), F.regexp_substr(text, pattern)
    return F.when((F.length(norm_ws(needle)) > 0) & (at > 0), F.struct((at - 1).alias("start"), (at - 1 + F.length(hit)).alias("end")))


def word_count(x: Column, ascii: bool = False) -> Column:
    if ascii:
        return F.size(F.filter(F.split(x, r"[\t\n\x0b\f\r ]+"), lambda w: w != ""))
    return F.size(F.filter(F.split(norm_ws(x), " "), lambda w: w != ""))


def preview(x: Column, most: int = 160) -> Column:
    return F.substring(norm_ws(x), 1, most)


def is_http_url(x: Column) -> Column:
    return F.coalesce(F.lower(x).rlike("^https?://"), F.lit(False))


def escape_html(x: Column, quote: bool = True) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), *((('"', "&quot;"), ("'", "&#x27;")) if quote else ())):
        x = F.replace(x, F.lit(a), F.lit(b))
    return x
