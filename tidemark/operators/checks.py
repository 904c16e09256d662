"""Data-quality checks: each gives rows of (table, rule, row_key)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def row_key(keys: list[str]) -> Column:
    return F.concat_ws("/", *[F.coalesce(F.col(k).cast("string"), F.lit("null")) for k in keys])


def violations(df: DataFrame, table: str, rules: dict[str, Column], keys: list[str]) -> DataFrame:
    """A row per rule that a row breaks (a rule that is null counts as broken)."""
    broken = F.filter(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]), lambda x: x.isNotNull())
    return df.select(F.lit(table).alias("table"), F.explode(broken).alias("rule"), row_key(keys).alias("row_key"))


def duplicates(df: DataFrame, table: str, keys: list[str]) -> DataFrame:
    d = df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")
    return d.select(F.lit(table).alias("table"), F.lit("unique").alias("rule"), row_key(keys).alias("row_key"))


def orphans(df: DataFrame, table: str, key: str, target: DataFrame, target_key: str, keys: list[str]) -> DataFrame:
    """Rows whose reference does not exist (null references are not checked)."""
    o = df.where(F.col(key).isNotNull()).join(target.select(F.col(target_key).alias(key)), key, "left_anti")
    return o.select(F.lit(table).alias("table"), F.lit(f"{key} exists").alias("rule"), row_key(keys).alias("row_key"))


def not_unlisted(listed: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """Keys that only one of two listings has."""
    a = found.select(key).distinct().join(listed.select(key), key, "left_anti").select(key, F.lit("unlisted").alias("rule"))
    return a.unionByName(listed.select(key).distinct().join(found.select(key), key, "left_anti").select(key, F.lit("missing").alias("rule")))


def probability_problems(p: Column, choice: Column, options: list[str], slack: float = 0.02) -> Column:
    """Names of the rules that a map of probabilities breaks."""
    values = F.map_values(p)
    total = F.aggregate(values, F.lit(0.0), lambda s, v: s + v)
    rules = {
        "keys": F.size(F.array_except(F.map_keys(p), F.array(*[F.lit(o) for o in options]))) + F.size(F.array_except(F.array(*[F.lit(o) for o in options]), F.map_keys(p))) == 0,
        "range": F.forall(values, lambda v: (v >= 0) & (v <= 1)),
        "sum": F.abs(total - 1) <= slack,
        "choice": F.element_at(p, choice) == F.array_max(values),
    }
    return F.filter(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(n)) for n, ok in rules.items()]), lambda x: x.isNotNull())
