"""Paths and prefixes, as Catalyst expressions and as Python functions."""

from __future__ import annotations

import posixpath
import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def sanitize_path(path: Column) -> Column:
    """A path below the root: ``.``, ``..`` and empty parts are resolved, nothing climbs out."""
    parts = F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/")
    start = F.array().cast("array<string>")

    def step(done, part):
        up = F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))
        return F.when(part.isin("", "."), done).when(part == "..", up).otherwise(F.concat(done, F.array(part)))

    return F.array_join(F.aggregate(parts, start, step), "/")


def py_sanitize_path(path: str) -> str:
    return posixpath.normpath("/" + path.replace("\\", "/")).lstrip("/")


def prefix_match(keys: list[str], prefix: Column) -> Column:
    """Whether some key starts with the prefix; the empty prefix matches."""
    return F.exists(F.array(*[F.lit(k) for k in keys]), lambda k: F.startswith(k, prefix))


def part_number(name: Column, stem: str) -> Column:
    """The number in ``sheet12.xml`` and the like, 0 if there is none."""
    return F.coalesce(F.regexp_extract(name, rf"{stem}(\d+)\.xml", 1).try_cast("int"), F.lit(0))


def py_part_number(name: str, stem: str) -> int:
    m = re.search(rf"{stem}(\d+)\.xml", name.rsplit("/", 1)[-1])
    return int(m[1]) if m else 0
