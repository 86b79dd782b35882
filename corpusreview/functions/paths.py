"""Column functions on file paths."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

from corpusreview import constants as K


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def suffix(path: Column) -> Column:
    """Last dotted part of the file name with its dot; empty for ``.name``, ``name.`` and ``name``."""
    return F.regexp_extract(basename(path), r"(?s)^.+(\.[^.]+)$", 1)


def extension(path: Column) -> Column:
    """Text behind the last dot of the whole path (all of it when there is no dot)."""
    return F.substring_index(path, ".", -1)


def language_of(path: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in K.LANGUAGE_BY_EXTENSION.items() for x in pair])
    return F.coalesce(known[F.lower(suffix(path))], F.lit("unknown"))


def has_extension(path: Column, extensions=tuple(K.LANGUAGE_BY_EXTENSION)) -> Column:
    """The file's lower-cased suffix is in ``extensions``, which are taken as given."""
    return F.lower(suffix(path)).isin(list(extensions))


def is_vendored(path: Column) -> Column:
    """Any part of the path, file name included, is hidden or a dependency / build folder (case-sensitive)."""
    names = "|".join(re.escape(p) for p in K.VENDORED_PARTS)
    return path.rlike(rf"(?s)(?:^|/)(?:\.[^/]*|{names})(?:/|$)")


def doc_file_name(path: Column) -> Column:
    """Name of the documentation file for a source file: base name up to its first dot."""
    return F.concat(F.substring_index(basename(path), ".", 1), F.lit("_docs.md"))
