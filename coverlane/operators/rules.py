"""Checks that return lists of error texts, and limits of the invoice table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coverlane.functions import text
from coverlane.schemas import INVOICE_TEXT_LIMITS

# Settings a worker needs. The routing key is not among them.
REQUIRED_TEXT = ["SQL_SERVER_HOST", "SQL_SERVER_DATABASE", "RABBITMQ_HOST", "RABBITMQ_PORT", "RABBITMQ_USERNAME",
                 "RABBITMQ_PASSWORD", "RABBITMQ_QUEUE", "RABBITMQ_EXCHANGE", "LOG_LEVEL"]
REQUIRED_NUMBERS = ["SCRAPING_DELAY", "MAX_RETRIES"]


def errors(checks: list[tuple[Column, str]]) -> Column:
    """Texts of the checks that hold, in order."""
    return F.array_compact(F.array(*[F.when(F.coalesce(bad, F.lit(False)), message) for bad, message in checks]))


def missing_settings(texts: list[str], numbers: list[str] = ()) -> Column:
    """A text setting must be filled; a number must be present, zero is fine."""
    checks = [(~text.has_value(name), f"{name} is not set") for name in texts]
    checks += [(F.col(name).isNull(), f"{name} is not set") for name in numbers]
    return errors(checks)


def insurer_errors(login_fields: Column, timeouts: list[str]) -> Column:
    """Missing name or addresses, incomplete login fields, missing waits, in that order.

    ``login_fields`` is a list of structs ``selector, value, required``; a value is only
    wanted where it is required.
    """
    plain = errors([(~text.has_value(c), f"{c} is not set") for c in ("name", "login_url", "target_url")])
    none = errors([(F.coalesce(F.size(login_fields), F.lit(0)) == 0, "no login fields")])
    nothing = F.array().cast("array<string>")
    per_field = F.flatten(F.transform(login_fields, lambda f: errors([
        (~text.has_value(f["selector"]), "login field without selector"),
        (~text.has_value(f["value"]) & f["required"], "login field without value")])))
    waits = errors([(F.coalesce(F.col(c), F.lit(0)) == 0, f"{c} is not set") for c in timeouts])
    return F.concat(plain, none, F.coalesce(per_field, nothing), waits)


def is_valid(found: Column) -> Column:
    return F.size(found) == 0


def limit_errors(df: DataFrame, limits: dict[str, int] = INVOICE_TEXT_LIMITS) -> Column:
    checks = [(F.length(name) > size, f"{name} is longer than {size}") for name, size in limits.items() if name in df.columns]
    return errors(checks)


def id_errors(names: list[str]) -> Column:
    """Ids that carry text which is not a whole number."""
    return errors([(text.has_value(n) & F.col(n).try_cast("int").isNull(), f"{n} is not a number") for n in names])


def split_rejects(df: DataFrame, found: Column) -> tuple[DataFrame, DataFrame]:
    """Rows without errors, and the others with their error list."""
    checked = df.withColumn("errors", found)
    return checked.filter(is_valid(F.col("errors"))).drop("errors"), checked.filter(~is_valid(F.col("errors")))
