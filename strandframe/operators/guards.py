"""Checks that stop a run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def require(condition: bool, message: str) -> None:
    """Stop with ``message`` unless the condition holds."""
    if not condition:
        raise ValueError(message)


def require_rows(df: DataFrame, condition: Column, message: str) -> DataFrame:
    """``df``; reading a row whose condition is not true stops the job with ``message``."""
    held = F.assert_true(F.coalesce(condition, F.lit(False)), message).isNull()
    return df.where(held)


def guard_splits(names: str, held_out: tuple[str, ...] = ("test",)) -> list[str]:
    """Split names of a comma list; those held out may not be among them."""
    wanted = [n.strip() for n in names.split(",") if n.strip()]
    require(bool(wanted), "no split is named")
    for name in held_out:
        require(name not in wanted, f"the split {name} may not be read here")
    return wanted
