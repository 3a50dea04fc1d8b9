"""Find each client on the result page of their document number."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coverlane.functions import text

# Headers of a portal result table.
PATIENT = "Nombre del Paciente"
STATUS = "Status"
POLICY = "Póliza"
DEPENDENT = "No. Dependiente"


def is_active(status: Column, strict: bool = False) -> Column:
    """Status text says active. The default also accepts "Inactivo", as the portal check
    does; ``strict`` wants the whole word."""
    if strict:
        hit = F.rlike(status, F.lit(r"(?iU)\bactivo\b"))
    else:
        hit = F.contains(F.lower(text.strip(status)), F.lit("activo"))
    return F.coalesce(hit, F.lit(False))


def named_rows(table_rows: DataFrame) -> DataFrame:
    """Result-table rows (``page_key, row_idx, cells`` map) with the columns used here."""
    return table_rows.select(
        "page_key", "row_idx",
        F.col("cells")[PATIENT].alias("patient"), F.col("cells")[STATUS].alias("status"),
        text.field("cells", POLICY).alias("policy_no"), text.field("cells", DEPENDENT).alias("dependent_no"))


def _join_name(name: str) -> Column:
    """Folded name, never null: the join then needs no null test, which would fold again.
    Empty names are taken out on the side of the rows, so they match nothing."""
    return F.coalesce(text.fold_name(name), F.lit(""))


def first_active(rows: DataFrame, strict: bool = False) -> DataFrame:
    """Per page and folded name, the first active row.

    The choice does not depend on who asks, so it is made before the join: partial
    aggregation shrinks the rows on the map side and every client meets one row.
    """
    usable = rows.filter(is_active(F.col("status"), strict)).withColumn("norm_name", _join_name("patient"))
    usable = usable.filter(F.col("norm_name") != "")
    pick = F.struct("row_idx", "policy_no", "dependent_no", "status")
    return usable.groupBy("page_key", "norm_name").agg(F.min_by(pick, "row_idx").alias("hit"))


def match(clients: DataFrame, rows: DataFrame, strict: bool = False, how: str = "inner") -> DataFrame:
    """Join clients (``page_key, full_name``) to their first active row, as ``hit``."""
    asked = clients.withColumn("norm_name", _join_name("full_name"))
    return asked.join(first_active(rows, strict), ["page_key", "norm_name"], how)
