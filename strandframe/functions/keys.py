"""Key forms: how a dirty reference or label is read before it is compared."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def key_form(value: Column) -> Column:
    """Outer spaces trimmed, the part after the last ``/``, a final ``.mp4`` of
    any case dropped.  Null or empty gives null.  Letters keep their case."""
    last = F.substring_index(F.trim(value), "/", -1)
    return F.nullif(F.regexp_replace(last, r"(?i)\.mp4$", ""), F.lit(""))


def label_form(value: Column, no_label: tuple[str, ...] = ("unknown",)) -> Column:
    """Lower case with only a-z and 0-9 kept; empty and placeholders give null."""
    kept = F.regexp_replace(F.lower(value), "[^a-z0-9]", "")
    return F.when(kept.isin("", *no_label), None).otherwise(kept)


def source_form(value: Column) -> Column:
    """Trimmed, lower case, ``-`` read as ``_``."""
    return F.translate(F.lower(F.trim(value)), "-", "_")


def safe_stem(value: Column) -> Column:
    """File-name stem: base name without ``.mp4``, characters outside
    ``A-Za-z0-9_.-`` replaced by ``_``."""
    return F.regexp_replace(key_form(value), r"[^A-Za-z0-9_.\-]", "_")


def whole_ms(seconds: Column) -> Column:
    """Seconds as whole milliseconds (bigint); null, NaN and infinite give null."""
    usable = F.when(F.isnan(seconds) | (F.abs(seconds) > F.lit(9.0e12)), None).otherwise(seconds)
    return F.round(usable * 1000).cast("bigint")
