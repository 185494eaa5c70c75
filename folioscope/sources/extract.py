"""Text of files by extension.

Plain text and binary strings are native expressions. Only CSV and workbook XML
need a parser; those run in one Arrow-batched function that receives NULL for
every other file, so the scan is read once and other content stays in the JVM.
"""

from __future__ import annotations

import csv
import io
import zipfile
from collections.abc import Callable, Iterable, Mapping
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.fixed_values import (
    CODEC_EXTENSIONS,
    FEATURE_TEXT_EXTENSIONS,
    HTML_EXTENSIONS,
    READER_TEXT_EXTENSIONS,
)
from ..functions.text import normalise, strip_html, unix_newlines, valid_utf8

Extractor = Callable[[bytes], str]
# Attributes that name things in a workbook.
WORKBOOK_ATTRIBUTES = ("name", "caption", "label", "value")


def _joined(pieces: Iterable[str], limit: int | None) -> str:
    """Lines, up to ``limit`` characters where there is one; reading stops once they are reached."""
    kept, length = [], -1
    for piece in pieces:
        kept.append(piece)
        length += len(piece) + 1
        if limit is not None and length > limit:
            break
    return "\n".join(kept)[:limit]


def csv_text(content: bytes, limit: int | None = None) -> str:
    """Cells joined by ', ' and rows by line feeds; empty cells are left out."""
    source = io.StringIO(content.decode("utf-8", "ignore"), newline="")
    return _joined((", ".join(c.strip() for c in row if c) for row in csv.reader(source)), limit)


def workbook_text(content: bytes, limit: int | None = None) -> str:
    """Element texts and naming attributes of a workbook in document order."""

    def pieces() -> Iterable[str]:
        for element in ElementTree.fromstring(content).iter():
            body = (element.text or "").strip()
            named = (element.get(a) for a in WORKBOOK_ATTRIBUTES)
            yield from filter(None, (body, *named))

    return _joined(pieces(), limit)


def packed_workbook_text(content: bytes, limit: int | None = None) -> str:
    """Text of the first workbook inside a zip archive, '' without one."""
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        inner = next((n for n in archive.namelist() if n.endswith(".twb")), None)
        return "" if inner is None else workbook_text(archive.read(inner), limit)


PARSERS: dict[str, Extractor] = {
    "csv": csv_text,
    "twb": workbook_text,
    "twbx": packed_workbook_text,
}


def _parsed(content: Column, extension: Column, parsers: Mapping[str, Extractor]) -> Column:
    """``text`` and ``error`` of the parser of each extension; a failure gives '' and what went wrong."""
    table = dict(parsers)

    @F.pandas_udf(T.StructType().add("text", "string").add("error", "string"))
    def parse(contents: pd.Series, extensions: pd.Series) -> pd.DataFrame:
        texts: list[str | None] = []
        errors: list[str | None] = []
        for raw, kind in zip(contents, extensions, strict=True):
            text, error = None, None
            if raw is not None:
                try:
                    text = table[kind](bytes(raw)) or ""
                except Exception as exc:  # a damaged file must not fail the job
                    text, error = "", f"{type(exc).__name__}: {exc}"
            texts.append(text)
            errors.append(error)
        return pd.DataFrame({"text": texts, "error": errors}, dtype=object)

    wanted = extension.isin(*table)
    return parse(F.when(wanted, content), extension)


def plain_text(content: Column | str) -> Column:
    return unix_newlines(valid_utf8(content))


def binary_strings(content: Column | str, limit: int | None = None) -> Column:
    """Printable ASCII runs of four or more, in the first ``limit`` bytes where there is a limit."""
    column = F.col(content) if isinstance(content, str) else content
    head = F.decode(column if limit is None else F.substring(column, 1, limit), "ISO-8859-1")
    return F.array_join(F.regexp_extract_all(head, F.lit(r"([\x20-\x7E]{4,})"), F.lit(0)), "\n")


def _cut(text: Column, limit: int | None) -> Column:
    filled = F.coalesce(text, F.lit(""))
    return filled if limit is None else F.substring(filled, 1, limit)


def reader_text(
    files: DataFrame, content: str = "content", extension: str = "extension",
    out: str = "content_text", extractors: Mapping[str, Extractor] | None = None,
    limit: int | None = None, error: str | None = None,
) -> DataFrame:
    """Add the text of each file, '' where the format is not supported or the file is damaged.

    ``extractors`` adds or replaces parsers by extension. Texts are whole unless
    there is a ``limit``. ``error`` names a column for what a parser failed with.
    """
    parsers = {**PARSERS, **(extractors or {})}
    raw, kind = F.col(content), F.lower(F.coalesce(F.col(extension), F.lit("")))
    native = [e for e in READER_TEXT_EXTENSIONS if e not in parsers]
    parsed = files.withColumn("_parsed", _parsed(raw, kind, parsers))
    chosen = F.when(kind.isin(*parsers), F.col("_parsed.text")).when(kind.isin(*native), plain_text(raw))
    if "dll" not in parsers:
        chosen = chosen.when(kind == "dll", binary_strings(raw))
    made = parsed.withColumn(out, _cut(chosen, limit))
    if error:
        made = made.withColumn(error, F.col("_parsed.error"))
    return made.drop("_parsed")


def feature_text(
    files: DataFrame, content: str = "content", extension: str = "extension",
    out: str = "content_text", extractors: Mapping[str, Extractor] | None = None,
    limit: int | None = None,
) -> DataFrame:
    """Add normalised text for features, whole unless there is a ``limit``.

    HTML is stripped before and after white space is collapsed. Formats that
    need a codec give '' without an extractor; all others are read as text.
    """
    parsers = dict(extractors or {})
    raw, kind = F.col(content), F.lower(F.coalesce(F.col(extension), F.lit("")))
    plain = plain_text(raw)
    codecs = [e for e in CODEC_EXTENSIONS if e not in parsers and e not in FEATURE_TEXT_EXTENSIONS]
    found = F.when(kind.isin(*HTML_EXTENSIONS), strip_html(strip_html(plain))).when(
        kind.isin(*codecs), ""
    )
    if parsers:
        found = F.when(
            kind.isin(*parsers), normalise(_parsed(raw, kind, parsers)["text"])
        ).otherwise(found.otherwise(normalise(plain)))
    else:
        found = found.otherwise(normalise(plain))
    return files.withColumn(out, _cut(found, limit))
