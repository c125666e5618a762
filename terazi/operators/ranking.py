"""Relational building blocks: keep-best, top-k, ranks, first matches, running flags, wide tables, counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from terazi.session import broadcast_small


def keep_first(rows: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    """The first row of each key by an explicit order; null keys form a group."""
    return rows.withColumn("_rn", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter("_rn = 1").drop("_rn")


def top_k(rows: DataFrame, keys: list[str], order: list[Column | str], k: int, rank: str = "rank") -> DataFrame:
    """The first k rows of each key with their rank from 1; partitions keep k rows each before the shuffle."""
    return rows.withColumn(rank, F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter(F.col(rank) <= k)


def first_match(ranked: DataFrame, keys: list[str], condition: Column, rank: str = "rank") -> DataFrame:
    """The least rank at which a condition holds, null where it never does; every key stays."""
    return ranked.groupBy(*keys).agg(F.min(F.when(condition, F.col(rank))).alias("sira"))


def running_flag(rows: DataFrame, starts: Column, order: str, out: str = "after") -> DataFrame:
    """Whether a starting row came at or before each row, by order; null starts don't count.

    The first starting row is found by an aggregate, so no window runs over the whole table.
    """
    first = rows.agg(F.min(F.when(starts, F.col(order))).alias("_first"))
    return rows.crossJoin(F.broadcast(first)).withColumn(out, F.coalesce(F.col(order) >= F.col("_first"), F.lit(False))).drop("_first")  # one row


def widened(ranked: DataFrame, keys: list[str], value: str, k: int = 5, rank: str = "rank", prefix: str = "sonuc_") -> DataFrame:
    """Columns prefix1..prefixk with the values at ranks 1..k, empty where there is none."""
    cells = [F.coalesce(F.max(F.when(F.col(rank) == i, F.col(value))), F.lit("")).alias(f"{prefix}{i}") for i in range(1, k + 1)]
    return ranked.groupBy(*keys).agg(*cells)


def value_counts(rows: DataFrame, column: str, empty: str | None = None) -> DataFrame:
    """column, n for each value, null included; empty strings may be relabelled."""
    value = F.when(F.col(column) == "", empty).otherwise(F.col(column)) if empty is not None else F.col(column)
    return rows.groupBy(value.alias(column)).agg(F.count("*").alias("n"))


def groups_beyond_one(rows: DataFrame, key: str) -> DataFrame:
    """One row: how many keys have more than one row."""
    return rows.groupBy(key).agg(F.count("*").alias("n")).agg(F.coalesce(F.sum((F.col("n") > 1).cast("long")), F.lit(0)).alias("n"))


def between_or_all(rows: DataFrame, column: str, low: int, high: int, group: str) -> DataFrame:
    """Rows whose column lies between two numbers; a group without such a row comes whole."""
    fits = F.col(column).between(low, high)
    any_fits = rows.groupBy(group).agg(F.max(fits).alias("_any"))
    return rows.join(broadcast_small(any_fits), group).filter(fits | ~F.coalesce("_any", F.lit(False))).drop("_any")


def unite(*tables: DataFrame) -> DataFrame:
    """Union by name; columns that a table lacks are null there."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out


def stacked(rows: DataFrame, keys: list[str], columns: dict[str, str], name: str, value: str) -> DataFrame:
    """Wide to long: a row for each of the columns, named by its label; null values go."""
    pairs = F.array(*[F.struct(F.lit(label).alias(name), F.col(c).alias(value)) for c, label in columns.items()])
    return rows.select(*keys, F.inline(pairs)).filter(F.col(value).isNotNull())


def combined(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Full outer join on a key that both have."""
    return left.join(right, key, "full_outer")
