"""Processors per insurer, and the registry table that lists them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coverlane.functions import text

Processor = Callable[[DataFrame], DataFrame]


def apply(df: DataFrame, code: str, processors: dict[str, Processor]) -> DataFrame:
    """Run each processor on the rows of its code and put the results together.

    Filters on the code reach the scan, so each branch reads only its own rows. Rows of a
    code without processor, or without code, come back as they are, in the columns that
    the processors return, with nulls in those that they add.
    """
    out = None
    for name, processor in processors.items():
        part = processor(df.filter(F.col(code) == name))
        out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError("no processors given")
    known = F.coalesce(F.col(code).isin(*processors), F.lit(False))
    rest = df.filter(~known)
    return out.unionByName(rest.select(*[c for c in out.columns if c in df.columns]), allowMissingColumns=True)


def listing(registry: DataFrame) -> DataFrame:
    """Registry rows with defaults for missing information."""
    return registry.select(
        "code", text.shown("name", "N/A").alias("name"), text.shown("country", "N/A").alias("country"),
        F.coalesce("active", F.lit(False)).alias("active"))


def lookup(rows: DataFrame, registry: DataFrame) -> DataFrame:
    """Rows with their registry entry; an unknown code gets none."""
    entry = registry.select("code", F.struct(*[c for c in registry.columns if c != "code"]).alias("entry"))
    return rows.join(entry, "code", "left")
