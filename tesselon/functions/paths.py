"""Paths of files by rule."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def array_path(codes: Column, root: str, token: str) -> Column:
    """Path below root of the array file behind a file of codes: what follows the token, without the codes' suffix, as .npy.

    A path without the token is an error that names it."""
    base = F.replace(codes, F.lit("_codebook"), F.lit(""))
    parts = F.split(base, rf"\Q{token}\E", -1)
    rest = F.replace(F.ltrim(F.get(parts, F.lit(1)), F.lit("/")), F.lit(".npz"), F.lit(".npy"))
    lost = F.raise_error(F.concat(F.lit(f"no {token!r} in the path "), base)).cast("string")
    return F.when(F.size(parts) > 1, F.concat(F.lit(root.rstrip("/") + "/"), rest)).otherwise(lost)


def parent_key(path: Column) -> Column:
    """The folder that a file is in: the last but one part of its path, or the first if there is no other."""
    parts = F.split(path, "/")
    return F.when(F.size(parts) > 1, F.element_at(parts, -2)).otherwise(F.get(parts, F.lit(0)))
