"""String expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def strip(c: Column) -> Column:
    """Strips any white space at both ends; `trim` takes spaces only."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def slug(c: Column) -> Column:
    """Lower case, with spaces and hyphens as underscores."""
    return F.translate(F.lower(c), " -", "__")


def short_number(x: float) -> str:
    """A number as `%g` prints it."""
    return f"{x:g}"


def trajectory_uid() -> Column:
    return F.concat_ws("__", "city", "recording_id", F.col("track_id").cast("string"))
