"""Running aggregates along an order, without a one-task window.

``agg() OVER (ORDER BY …)`` sends every row to a single task, and ``PARTITION BY`` does the same to a
hot key. Here rows are range partitioned by (group, order), each range computes its own running value, and
the small table of per-range totals is scanned once to find what precedes each range.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import freeze

_AGGREGATES = {"sum": F.sum, "min": F.min, "max": F.max}


def _combine(kind: str, before: Column, local: Column) -> Column:
    if kind == "sum":
        return F.coalesce(before, F.lit(0)) + F.coalesce(local, F.lit(0))
    pick = F.least if kind == "min" else F.greatest
    return F.when(before.isNull(), local).when(local.isNull(), before).otherwise(pick(before, local))


def join_groups(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on ``keys`` with NULL as a group of its own; the keys come from ``left``."""
    named = right.withColumnsRenamed({k: f"_k_{k}" for k in keys})
    on = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys]
    return left.join(named, on, how).drop(*[f"_k_{k}" for k in keys])


def spread(df: DataFrame, order: Sequence[Column], partition: Sequence[str] = ()) -> DataFrame:
    """``df`` cut into ranges of (partition, order), each row with its ``_range`` number, and frozen.

    Freezing matters: the same rows must lie in the same ranges for every later aggregate.
    """
    keys = [F.col(name) for name in partition]
    return freeze(df.repartitionByRange(*keys, *order).withColumn("_range", F.spark_partition_id()))


def accumulate(
    ranges: DataFrame,
    order: Sequence[Column],
    values: Mapping[str, tuple[str, Column]],
    partition: Sequence[str] = (),
    inclusive: bool = True,
    backwards: bool = False,
) -> DataFrame:
    """Add running columns to the output of ``spread``; ``_range`` stays, so another pass can follow.

    ``backwards`` is for an ``order`` that runs against the one the ranges were cut by.
    """
    edge = Window.currentRow if inclusive else -1
    within = Window.partitionBy(*partition, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, edge)
    local = ranges.select(
        "*", *[_AGGREGATES[kind](expr).over(within).alias(f"_l_{name}") for name, (kind, expr) in values.items()]
    )
    # Only a range's first group can have rows in the ranges before, so only such groups carry anything over:
    # at most two rows per range partition, however many groups there are.
    carried = ranges
    if partition:
        firsts = ranges.groupBy("_range").agg(F.min(F.struct(*partition)).alias("_first")).select("_first.*").distinct()
        carried = join_groups(ranges, F.broadcast(firsts), partition, "left_semi")
    totals = carried.groupBy(*partition, "_range").agg(
        *[_AGGREGATES[kind](expr).alias(f"_t_{name}") for name, (kind, expr) in values.items()]
    )
    number = F.desc("_range") if backwards else F.asc("_range")
    earlier = Window.partitionBy(*partition).orderBy(number).rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select(
        *partition,
        "_range",
        *[_AGGREGATES[kind](f"_t_{name}").over(earlier).alias(f"_b_{name}") for name, (kind, _) in values.items()],
    )
    joined = join_groups(local, F.broadcast(before), [*partition, "_range"], "left")
    return joined.select(
        *ranges.columns,
        *[
            _combine(kind, F.col(f"_b_{name}"), F.col(f"_l_{name}")).alias(name)
            for name, (kind, _) in values.items()
        ],
    )


def running(
    df: DataFrame,
    order: Sequence[Column],
    values: Mapping[str, tuple[str, Column]],
    partition: Sequence[str] = (),
    inclusive: bool = True,
) -> DataFrame:
    """Add running ``sum``/``min``/``max`` columns along ``order`` within ``partition``.

    ``order`` must end in a unique key. ``values`` maps the new column name to ``(kind, expression)``.
    With ``inclusive=False`` the current row is left out, so ``max(struct(order…, v))`` is the previous row.
    """
    return accumulate(spread(df, order, partition), order, values, partition, inclusive).drop("_range")


def rank_rows(
    df: DataFrame, order: Sequence[Column], name: str = "rank", partition: Sequence[str] = ()
) -> DataFrame:
    """Row numbers 1..n along ``order`` (which ends in a unique key) within ``partition``."""
    return running(df, order, {name: ("sum", F.lit(1).cast("long"))}, partition)


def tie_groups(df: DataFrame, value: str, partition: Sequence[str] = (), **sums: Column) -> DataFrame:
    """One row per distinct ``value`` with the given sums: a map-side combined histogram."""
    return df.groupBy(*partition, value).agg(*[F.sum(expr).alias(name) for name, expr in sums.items()])


def average_ranks(df: DataFrame, value: str, name: str, partition: Sequence[str] = ()) -> DataFrame:
    """Distinct values of ``value`` with their average rank (ties share the mean of their positions)."""
    counts = tie_groups(df, value, partition, _n=F.lit(1).cast("long"))
    ranked = running(counts, [F.col(value)], {"_upto": ("sum", F.col("_n"))}, partition)
    return ranked.select(*partition, value, (F.col("_upto") - (F.col("_n") - 1) / 2).alias(name))


def medians(df: DataFrame, value: str, group: str, name: str = "median") -> DataFrame:
    """Exact median per group from running counts, so no group is held in one place."""
    counts = tie_groups(df.where(F.col(value).isNotNull()), value, [group], _n=F.lit(1).cast("long"))
    upto = running(counts, [F.col(value)], {"_upto": ("sum", F.col("_n"))}, [group])
    totals = upto.groupBy(group).agg(F.sum("_n").alias("_total"))
    placed, total = join_groups(upto, totals, [group]), F.col("_total")
    low = F.min(F.when(F.col("_upto") >= F.floor((total + 1) / 2), F.col(value)))
    high = F.min(F.when(F.col("_upto") >= F.ceil((total + 1) / 2), F.col(value)))
    return placed.groupBy(group).agg(((low + high) / 2).alias(name))
