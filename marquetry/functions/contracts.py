"""Data contracts: each checked in one aggregate pass, failing with the counts of broken rules."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Canonical non-negative 64-bit ids, as text.
ID_PATTERN = r"\A(?:0|[1-9][0-9]*)\z"
ID_LIMIT = "9223372036854775807"


class ContractError(ValueError):
    """Rows break a rule."""


def is_missing_id(text: Column) -> Column:
    return text.isNull() | (text == "")


def is_valid_id(text: Column) -> Column:
    """Canonical decimal text in range, false for missing ids; `$` would let a newline pass."""
    fits = (F.length(text) < 19) | ((F.length(text) == 19) & (text <= ID_LIMIT))
    return F.coalesce(text.rlike(ID_PATTERN) & fits, F.lit(False))


def exclusion_reason(user: Column, item: Column) -> Column:
    """The first of missing_user, invalid_user, missing_item, invalid_item that holds; null for an eligible row."""
    return (
        F.when(is_missing_id(user), "missing_user")
        .when(~is_valid_id(user), "invalid_user")
        .when(is_missing_id(item), "missing_item")
        .when(~is_valid_id(item), "invalid_item")
    )


def is_finite(value: Column) -> Column:
    return F.coalesce(~F.isnan(value) & (F.abs(value) < float("inf")), F.lit(False))


def playtime_rule(value: Column) -> Column:
    """Finite and not negative."""
    return is_finite(value) & (value >= 0)


def positive_zero(value: Column) -> Column:
    """The value with -0.0 as 0.0."""
    return F.when(value == 0, F.lit(0.0)).otherwise(value)


def assert_contract(df: DataFrame, rules: Mapping[str, Column], unique: tuple[str, ...] = ()) -> DataFrame:
    """df itself if all its rows meet all rules (null counts as broken) and the key columns are unique; else ContractError."""
    broken = [F.count_if(~F.coalesce(rule, F.lit(False))).alias(name) for name, rule in rules.items()]
    counts = df.agg(F.count("*").alias("rows"), *broken).first().asDict()
    found = {k: v for k, v in counts.items() if k != "rows" and v}
    if unique:
        repeated = df.groupBy(*unique).count().where("count > 1").agg(F.count("*")).first()[0]
        if repeated:
            found[f"unique({', '.join(unique)})"] = repeated
    if found:
        raise ContractError(f"of {counts['rows']} rows: {found}")
    return df


def assert_same_keys(expected: DataFrame, actual: DataFrame, *keys: str) -> None:
    """Both frames hold the same keys, each once."""
    for side, other, name in ((expected, actual, "missing"), (actual, expected, "extra")):
        n = side.select(*keys).join(other.select(*keys), list(keys), "left_anti").count()
        if n:
            raise ContractError(f"{n} {name} keys")
    assert_contract(actual, {}, unique=keys)
