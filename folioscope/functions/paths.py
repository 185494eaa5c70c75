"""Path and file-name features as native column expressions."""

from __future__ import annotations

import sys
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from .fixed_values import mime_compound_suffixes, mime_encodings


# A scheme and its authority in front of an absolute path.
SCHEME = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/]*"


def _col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def _parts(path: Column) -> Column:
    """Path segments without blanks and single dots."""
    return F.filter(F.split(path, "/"), lambda part: ~part.isin("", "."))


def canonical(path: Column | str) -> Column:
    """Drop doubled slashes, ``.`` segments and a trailing slash; '' becomes '.'.

    A scheme and its authority, as in ``hdfs://host/a``, stay as they are.
    """
    path = _col(path)
    scheme = F.regexp_extract(path, SCHEME, 0)
    rest = F.substring(path, F.length(scheme) + 1, F.length(path))
    body = F.array_join(_parts(rest), "/")
    absolute = F.concat(scheme, F.lit("/"), body)
    relative = F.when(body == "", ".").otherwise(body)
    return F.when(rest.startswith("/") | (scheme != ""), absolute).otherwise(relative)


def file_name(path: Column | str) -> Column:
    """Last segment of a canonical path."""
    return F.element_at(F.split(_col(path), "/"), -1)


def folder(path: Column | str) -> Column:
    """Everything before the last slash, '/' at the top, '.' for a bare name."""
    path = _col(path)
    cut = F.regexp_replace(path, "(?s)/[^/]*$", "")
    return F.when(~path.contains("/"), ".").when(cut == "", "/").otherwise(cut)


def suffix(name: Column | str) -> Column:
    """Last dot and what follows it, unless the dot starts or ends the name."""
    return F.regexp_extract(_col(name), r"(?s).+(\.[^.]+)$", 1)


def stem(name: Column | str) -> Column:
    name = _col(name)
    return F.substring(name, F.lit(1), F.length(name) - F.length(suffix(name)))


def extension_key(name: Column | str) -> Column:
    """Lower-case extension without the dot."""
    return F.ltrim(F.lower(suffix(name)), F.lit("."))


def mime_key(name: Column | str) -> Column:
    """Suffix that decides the MIME type, looking through compression suffixes."""
    name = _col(name)
    pattern = r"(?s)[^.].*(\.[^.]*)$"
    last = F.regexp_extract(name, pattern, 1)
    before = F.regexp_extract(
        F.substring(name, F.lit(1), F.length(name) - F.length(last)), pattern, 1
    )
    key = F.when(last.isin(*mime_encodings()), F.lower(before))
    for short, carrier in sorted(mime_compound_suffixes().items()):
        key = key.when(F.lower(last) == short, F.lit(carrier))
    return key.otherwise(F.lower(last))


def resolve(path: Column | str, base: Column | str) -> Column:
    """Absolute form of ``path`` under ``base`` with ``.`` and ``..`` folded.

    The fold is lexical: symbolic links need a file system and are not followed.
    ``base`` is a column or column name.
    """
    path, base = _col(path), _col(base)
    full = F.when(path.startswith("/") | path.rlike(SCHEME), path).otherwise(F.concat(base, F.lit("/"), path))
    scheme = F.regexp_extract(full, SCHEME, 0)
    folded = F.aggregate(
        _parts(F.substring(full, F.length(scheme) + 1, F.length(full))),
        F.array().cast("array<string>"),
        lambda kept, part: F.when(
            part == "..", F.slice(kept, F.lit(1), F.greatest(F.size(kept) - 1, F.lit(0)))
        ).otherwise(F.array_append(kept, part)),
    )
    return F.concat(scheme, F.lit("/"), F.array_join(folded, "/"))


def depth(path: Column | str) -> Column:
    """Number of parts as given; the root counts one in an absolute path, a scheme is a part like any other."""
    path = _col(path)
    return F.size(_parts(path)) + F.when(path.startswith("/"), 1).otherwise(0)


def keywords(value: Column | str) -> Column:
    """Alphanumeric runs in lower case, joined by one space.

    A path needs no split first, because '/' is itself a separator.
    """
    return F.trim(F.lower(F.regexp_replace(_col(value), "[^A-Za-z0-9]+", " ")))


def keyword_count(value: Column | str) -> Column:
    """Number of keywords in the result of :func:`keywords`."""
    return F.regexp_count(_col(value), F.lit("[^ ]+"))


def _digit_class() -> str:
    """Decimal digits plus the other characters Python's ``isdigit`` accepts."""
    others = (
        code
        for code in range(sys.maxunicode + 1)
        if chr(code).isdigit() and unicodedata.category(chr(code)) != "Nd"
    )
    return r"\p{Nd}" + "".join(f"\\x{{{code:x}}}" for code in others)


DIGIT_CLASS = _digit_class()


def digit_count(name: Column | str) -> Column:
    return F.length(F.regexp_replace(_col(name), f"[^{DIGIT_CLASS}]", ""))


def path_tokens(path: Column | str) -> Column:
    """Lower-case alphanumeric tokens and an ``ext_`` token for the last dot.

    The extension is whatever follows the last dot of the whole path, so it can
    hold a slash when only a folder has a dot.
    """
    path = F.lower(F.replace(_col(path), F.lit("\\\\"), F.lit("/")))
    words = F.regexp_extract_all(path, F.lit("([a-z0-9]+)"), F.lit(0))
    last = F.element_at(F.split(path, r"\."), -1)
    has_extension = path.contains(".") & (last != "")
    tail = F.when(has_extension, F.array(F.concat(F.lit("ext_"), last))).otherwise(
        F.array().cast("array<string>")
    )
    return F.array_join(F.concat(words, tail), " ")


def subfolder(root: Column | str, path: Column | str) -> Column:
    """Parent relative to ``root``: '/' at the top, the whole parent outside it."""
    root, parent = _col(root), folder(path)
    prefix = F.when(root == "/", root).otherwise(F.concat(root, F.lit("/")))
    relative = F.substring(parent, F.length(prefix) + 1, F.length(parent))
    chosen = (
        F.when(parent == root, "/")
        .when(parent.startswith(prefix), relative)
        .otherwise(parent)
    )
    return F.replace(chosen, F.lit("\\"), F.lit("/"))


def relative_depth(root: Column | str, directory: Column | str) -> Column:
    """Depth of a directory below ``root``; the root itself is 0."""
    return depth(directory) - depth(root)


def parent_directory(root: Column | str, directory: Column | str) -> Column:
    """Parent path, NULL for the root."""
    directory = _col(directory)
    return F.when(directory != _col(root), folder(directory))


def owner_columns(owner: Column | str) -> dict[str, Column]:
    """Owner as ``modified_by``; the creator is not recorded, so it is the same."""
    owner = _col(owner)
    return {"created_by": owner, "modified_by": owner}
