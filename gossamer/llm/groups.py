"""Joins against per-key group facts that stay even when one key holds a third of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gossamer.session import materialize

#: A key is heavy when it holds at least 1/HEAVY_PARTS of all rows, so at most HEAVY_PARTS keys are heavy.
HEAVY_PARTS = 200


def quoted(name: str) -> Column:
    """The column of exactly this name, dots and backticks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def numbered(df: DataFrame) -> DataFrame:
    """The same columns as c0, c1, ...: a batch function cannot take names with dots in them."""
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))])


def attach_groups(df: DataFrame, key: str, aggs: dict[str, Column], label: str) -> DataFrame:
    """Left-join facts of every repeated key to its rows; keys that occur once get nulls.

    The facts are partial aggregates (one row per key and map task is shuffled). Keys that
    hold at least 1/200 of the rows are at most 200 by arithmetic: those are broadcast, and
    their rows never meet in one task. Lighter keys go through an ordinary shuffled join.
    """
    facts = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("_n"), *[c.alias(k) for k, c in aggs.items()])
    facts = materialize(facts.where("_n > 1"), label)
    total = facts.agg(F.sum("_n")).first()[0] or 0
    least = max(2, -(-total // HEAVY_PARTS))
    heavy = facts.where(F.col("_n") >= least).withColumn("_heavy", F.lit(True))
    light = facts.where(F.col("_n") < least).drop("_n")
    names = list(aggs)
    out = df.join(F.broadcast(heavy.drop("_n").select(key, "_heavy", *[F.col(c).alias(f"_h_{c}") for c in names])), key, "left")
    # a heavy row and a row without a key look for nothing in the second join, so they are spread
    out = out.withColumn("_probe", F.when(F.col("_heavy") | F.col(key).isNull(), F.concat(F.lit("spread-"), F.xxhash64(*[c for c in df.columns]).cast("string"))).otherwise(F.col(key)))
    out = out.join(light.withColumnRenamed(key, "_probe"), "_probe", "left")
    merged = [F.coalesce(F.col(f"_h_{c}"), F.col(c)).alias(c) for c in names]
    return out.select(*[F.col(c) for c in df.columns], *merged)
