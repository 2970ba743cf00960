"""Path predicates as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def visible(path: Column) -> Column:
    """False when the own name starts with a dot, or when an ancestor's name is longer
    than one character and starts with a dot."""
    parts = F.split(path, "/")
    leaf = F.element_at(parts, -1)
    ancestors = F.slice(parts, F.lit(1), F.size(parts) - 1)
    hidden_dir = F.exists(ancestors, lambda p: (F.length(p) > 1) & p.startswith("."))
    return ~leaf.startswith(".") & ~hidden_dir


def named(volume: Column) -> Column:
    """False for a missing or empty volume name."""
    return F.coalesce(volume != "", F.lit(False))


def as_directory(dir_prefix: Column) -> Column:
    """A directory with its last slash, so that ``/a/b`` does not hold ``/a/bc``."""
    return F.when(dir_prefix.endswith("/"), dir_prefix).otherwise(F.concat(dir_prefix, F.lit("/")))


def inside(path: Column, dir_prefix: Column | str) -> Column:
    """True when ``path`` lies in the directory at any depth."""
    prefix = F.lit(dir_prefix) if isinstance(dir_prefix, str) else dir_prefix
    return F.startswith(path, as_directory(prefix))


def ancestors(path: Column) -> Column:
    """Every directory a path lies in, as prefixes that end in a slash."""
    parts = F.split(path, "/")
    prefixes = F.transform(
        F.sequence(F.lit(1), F.size(parts)),
        lambda n: F.concat(F.array_join(F.slice(parts, F.lit(1), n), "/"), F.lit("/")))
    return F.filter(prefixes, lambda prefix: path.startswith(prefix))
