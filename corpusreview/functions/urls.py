"""Column functions on repository addresses."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

_PATH = r"^(?:[a-zA-Z][a-zA-Z0-9+.\-]*:)?(?://[^/?#]*)?([^?#]*)"
_HOST = r"^[a-zA-Z][a-zA-Z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]+)(?::[0-9]*)?(?:[/?#]|$)"
_REPO_HOST = "github.com"  # fixed value: the only host accepted


def _path(url: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(url, _PATH, 1), r";[^/]*$", "")


def repo_slug(url: Column) -> Column:
    """``owner/name`` of a repository address; NULL where the path has fewer than two parts."""
    path = F.regexp_replace(F.btrim(_path(url), F.lit("/")), r"\.git$", "")
    parts = F.split(path, "/", -1)
    return F.when(F.size(parts) >= 2, F.concat_ws("/", parts[0], parts[1]))


def is_repo_url(url: Column) -> Column:
    """Blank, or an absolute address on the repository host with at least two non-empty path parts."""
    u = F.trim(url)
    host = F.lower(F.regexp_extract(u, _HOST, 1))
    parts = F.filter(F.split(F.regexp_extract(u, _PATH, 1), "/", -1), lambda p: p != "")
    return (u == "") | ((host == _REPO_HOST) & (F.size(parts) >= 2))
