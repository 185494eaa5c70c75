"""Text, number and timestamp clean-up as native column expressions."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .fixed_values import FEATURE_TEXT_LIMIT
from .paths import _col

# Code points Python takes for white space, besides the blank.
SPACE_POINTS = (
    0x9, 0xA, 0xB, 0xC, 0xD, 0x1C, 0x1D, 0x1E, 0x1F, 0x85, 0xA0, 0x1680,
    0x2000, 0x2001, 0x2002, 0x2003, 0x2004, 0x2005, 0x2006, 0x2007, 0x2008, 0x2009, 0x200A,
    0x2028, 0x2029, 0x202F, 0x205F, 0x3000,
)
SPACE_CHARS = "".join(map(chr, SPACE_POINTS))
# The same with the blank, as a character class for Java and RE2.
SPACE = " " + "".join(f"\\x{{{point:x}}}" for point in SPACE_POINTS)
WORD = r"[\p{L}\p{N}_]{2,}"


def normalise(text: Column | str) -> Column:
    """Collapse white space to single blanks and trim.

    A character map is much cheaper than a large regex class, so only runs of
    blanks are left to the regex.
    """
    blanks = F.translate(_col(text), SPACE_CHARS, " " * len(SPACE_CHARS))
    return F.trim(F.regexp_replace(blanks, " {2,}", " "))


def strip_html(text: Column | str) -> Column:
    """Remove script and style blocks, then tags, then normalise."""
    text = _col(text)
    for block in ("script", "style"):
        text = F.regexp_replace(text, f"(?is)<{block}.*?>.*?</{block}>", " ")
    return normalise(F.regexp_replace(text, "<[^>]+>", " "))


def printable(text: Column | str) -> Column:
    """Drop control, format, private and separator characters, keeping the blank."""
    return F.regexp_replace(_col(text), r"[\p{C}\p{Z}&&[^ ]]", "")


def printable_frame(df: DataFrame) -> DataFrame:
    """Apply :func:`printable` to every string column."""
    names = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    return df.withColumns({name: printable(name) for name in names}) if names else df


def truncate(text: Column | str, limit: int = FEATURE_TEXT_LIMIT) -> Column:
    return F.substring(_col(text), 1, limit)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of an expression that is evaluated once per row.

    Inside a lambda Spark would evaluate the expression again for each element;
    a lambda variable holds its value.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def word_count(text: Column | str) -> Column:
    """White-space separated words; 0 for blank and NULL text."""

    def gaps(clean: Column) -> Column:
        return F.length(clean) - F.length(F.replace(clean, F.lit(" "), F.lit("")))

    counted = let(normalise(text), lambda clean: F.when(clean != "", gaps(clean) + 1).otherwise(0))
    return F.coalesce(counted, F.lit(0))


def content_measures(text: Column | str) -> dict[str, Column]:
    """Length, word count and presence flag of a content column."""
    length = F.coalesce(F.length(_col(text)), F.lit(0))
    return {
        "content_char_len": length,
        "content_word_count": word_count(text),
        "has_content": (length > 0).cast("int"),
    }


def epoch_timestamp(epoch: Column | str) -> Column:
    """Epoch seconds as a zone-free timestamp, NULL for NULL and NaN."""
    seconds = F.nanvl(_col(epoch).cast("double"), F.lit(None).cast("double"))
    zero = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return zero + F.make_dt_interval(secs=seconds.cast("decimal(18,6)"))


def iso_timestamp(stamp: Column | str) -> Column:
    """``2024-01-31T12:30:00``, '' when missing; fractions are cut."""
    return F.coalesce(F.date_format(_col(stamp), "yyyy-MM-dd'T'HH:mm:ss"), F.lit(""))


def to_number(value: Column | str, default: float | None = 0.0) -> Column:
    """Numeric value; text that is no number, NULL and NaN give ``default``."""
    missing = F.lit(None).cast("double")
    number = F.nanvl(_col(value).try_cast("double"), missing)
    return number if default is None else F.coalesce(number, F.lit(float(default)))


def fill_blank(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """NULL becomes '' in the named columns, which are turned into strings."""
    filled = {c: F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns if c in df.columns}
    return df.withColumns(filled) if filled else df


def safe_path(value: Column | str) -> Column:
    """Trimmed text, '' for NULL."""
    ends = F.lit(" " + SPACE_CHARS)
    return F.coalesce(F.btrim(_col(value).cast("string"), ends), F.lit(""))


def is_blank(value: Column | str) -> Column:
    """True for NULL and for text of white space only."""
    return safe_path(value) == ""


def join_text(df: DataFrame, columns: Iterable[str]) -> Column:
    """The named columns that exist, NULL as '', joined by one blank."""
    present = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns if c in df.columns]
    if not present:
        raise ValueError("none of the text columns is present")
    return F.concat_ws(" ", *present)


def words(text: Column | str) -> Column:
    """Lower-case words of two or more letters, digits or underscores."""
    lowered = F.lower(F.coalesce(_col(text), F.lit("")))
    return F.regexp_extract_all(lowered, F.lit(f"({WORD})"), F.lit(0))


def ngrams(tokens: Column | str, low: int = 1, high: int = 1) -> Column:
    """All runs of ``low`` to ``high`` tokens, joined by a blank."""
    empty = F.array().cast("array<string>")

    def runs(tokens: Column, n: int) -> Column:
        if n == 1:
            return tokens
        starts = F.sequence(F.lit(0), F.size(tokens) - n)
        joined = F.transform(
            starts, lambda i: F.concat_ws(" ", *[F.get(tokens, i + k) for k in range(n)])
        )
        return F.when(F.size(tokens) >= n, joined).otherwise(empty)

    if (low, high) == (1, 1):
        return _col(tokens)
    return let(
        _col(tokens), lambda held: F.concat(*[runs(held, n) for n in range(low, high + 1)])
    )


def _accent_table() -> tuple[str, str]:
    """Characters that lose their marks one to one, then the marks to delete."""
    source, target, marks = [], [], []
    for code in range(0x80, 0x10000):
        char = chr(code)
        if 0xD800 <= code <= 0xDFFF:
            continue
        if unicodedata.combining(char):
            marks.append(char)
            continue
        plain = "".join(c for c in unicodedata.normalize("NFKD", char) if not unicodedata.combining(c))
        if len(plain) == 1 and plain != char:
            source.append(char)
            target.append(plain)
    return "".join(source + marks), "".join(target)


ACCENTED, PLAIN = _accent_table()


def strip_accents(text: Column | str) -> Column:
    """Replace accented characters by their base and delete combining marks.

    Covers every character whose compatibility form is one base character. The
    few that expand to several (ligatures, fractions, Hangul) need
    :func:`strip_accents_expanding`.
    """
    return F.translate(_col(text), ACCENTED, PLAIN)


@F.pandas_udf(T.StringType())
def strip_accents_expanding(text: pd.Series) -> pd.Series:
    """Full compatibility decomposition without marks, Arrow batch by batch."""

    def plain(value: str | None) -> str | None:
        if value is None or value.isascii():
            return value
        return "".join(
            c for c in unicodedata.normalize("NFKD", value) if not unicodedata.combining(c)
        )

    return text.map(plain)


def valid_utf8(content: Column | str) -> Column:
    """Bytes as UTF-8 text without the undecodable ones.

    A replacement character that was really in the file is carried across the
    repair under a non-character code point.
    """
    raw = _col(content).cast("string")
    real, carrier = F.lit("�"), F.lit(chr(0x10FFFE))
    repaired = F.make_valid_utf8(F.replace(raw, real, carrier))
    cleaned = F.replace(F.replace(repaired, real, F.lit("")), carrier, real)
    return F.when(F.is_valid_utf8(raw), raw).otherwise(cleaned)


def unix_newlines(text: Column | str) -> Column:
    """Carriage returns become line feeds, as text mode reads them."""
    return F.regexp_replace(_col(text), "\r\n?", "\n")

