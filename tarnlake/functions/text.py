"""Text columns: trimming, names, paths, templates and digests."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body uses it."""
    return F.get(F.transform(F.array(value), lambda v: body(v)), F.lit(0))


# The characters Python's strip() removes.
WHITE_SPACE = (
    " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)


def strip(c: Column) -> Column:
    """Remove leading and trailing white space of any kind (``trim`` removes spaces only)."""
    return F.btrim(c, F.lit(WHITE_SPACE))


def collapse_spaces(c: Column) -> Column:
    """Trim and turn every run of white space into one space."""
    # single spaces are what most texts have between words; only other runs are replaced
    return F.trim(F.regexp_replace(c, r"(?U)\s{2,}|[\s&&[^ ]]", " "))


def is_blank(c: Column) -> Column:
    """True for text of white space only; a null is not blank."""
    return F.coalesce(strip(c) == "", F.lit(False))


def snake(c: Column) -> Column:
    """Lower snake case of a text column."""
    return F.btrim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "_"), F.lit("_"))


def snake_name(name: str) -> str:
    """Lower snake case of one name (driver side, for column and table names)."""
    return re.sub("[^a-z0-9]+", "_", name.lower()).strip("_")


def extension(c: Column) -> Column:
    """Extension with its dot, or '' (a leading dot alone does not start an extension)."""
    return F.regexp_extract(c, r"(?:^|/)[^/]*[^./][^/]*(\.[^./]*)$", 1)


def base_name(c: Column) -> Column:
    """Last path segment."""
    return F.element_at(F.split(c, "/"), -1)


def sanitize_file_name(c: Column) -> Column:
    """Snake-case stem plus lower-case extension."""
    ext = extension(c)
    stem = F.substr(c, F.lit(1), F.length(c) - F.length(ext))
    return F.concat(snake(F.regexp_replace(stem, "[^a-zA-Z0-9]+", "_")), F.lower(ext))


def uri_part(c: Column, part: str) -> Column:
    """``scheme``, ``bucket`` or ``key`` of a ``scheme://bucket/key`` location."""
    group = {"scheme": 1, "bucket": 2, "key": 3}[part]
    return F.regexp_extract(c, r"^([a-z0-9]+)://([^/]+)/?(.*)$", group)


def fill_template(template: str, **values: Column) -> Column:
    """Replace ``{name}`` in a template by columns; filled text is never scanned again."""
    pieces = re.split(r"\{(\w+)\}", template)
    parts = [
        F.coalesce(values[piece].cast("string"), F.lit("")) if i % 2 else F.lit(piece)
        for i, piece in enumerate(pieces)
        if i % 2 or piece
    ]
    return F.concat(*parts) if parts else F.lit("")


def md5_of_fields(*columns: Column) -> Column:
    """MD5 of the JSON text of the given (named) columns, in the given order, nulls included."""
    exact = {"ignoreNullFields": "false", "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}
    return F.md5(F.to_json(F.struct(*columns), exact))


def null_if_in(c: Column, words: list[str]) -> Column:
    """Null where the value is one of ``words``."""
    return F.when(~F.coalesce(c.isin(words), F.lit(False)), c)
