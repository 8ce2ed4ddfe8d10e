"""Row predicates of input forms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EMAIL = r"^[A-Za-z0-9.!#$%&'*+/=?^_`{|}~-]+@[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?(?:\.[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?)*$"


def required(value: Column) -> Column:
    return F.coalesce(value.cast("string") != "", F.lit(False))


def is_email(value: Column) -> Column:
    """An empty field is valid unless it is required too."""
    return ~required(value) | value.rlike(EMAIL)


def is_number(value: Column) -> Column:
    return ~required(value) | value.try_cast("double").isNotNull()


def is_date(value: Column) -> Column:
    return ~required(value) | (value.rlike(r"^\d{4,}-\d{2}-\d{2}$") & value.try_cast("date").isNotNull())


def same(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)


def accepted(value: Column) -> Column:
    return F.coalesce(value, F.lit(False))


def check(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Adds valid, and errors: the names of the rules that a row breaks, in the order given."""
    broken = F.array_compact(F.array(*(F.when(~rule, F.lit(name)) for name, rule in rules.items())))
    return df.withColumn("errors", F.array_join(broken, ",")).withColumn("valid", F.col("errors") == "")
