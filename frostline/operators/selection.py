"""Exact quantiles of groups of any size, by histograms of leading bits.

Spark's percentile holds all distinct values of a group in one task. Here a double's bits, ordered as the numbers are, are gone through sixteen at a time: a pass counts a
group's values by their next sixteen bits, before the shuffle where they lie, and the counts tell which of them holds the wanted rank. What is left to look at
shrinks with each pass, and once it is little it is sorted. A group is never gathered: tasks get counts, at most 65,536 for a group and prefix.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window

from frostline.sources.stage import Store

#: Values of a group that percentile may hold; values of a prefix that are sorted; rows of a table that is broadcast.
HELD, SORTED, SMALL = 1 << 20, 1 << 16, 1 << 16


@F.pandas_udf(T.LongType())
def ordered_bits(v: pd.Series) -> pd.Series:
    """Whole numbers that are ordered as doubles are; -0.0 is 0.0, NaN is above all."""
    x = v.to_numpy(np.float64, copy=True) + 0.0
    x[np.isnan(x)] = np.nan  # one bit pattern
    b = x.view(np.int64)
    return pd.Series(b ^ ((b >> 63) & np.int64(0x7FFFFFFFFFFFFFFF)))


@F.pandas_udf(T.DoubleType())
def from_bits(b: pd.Series) -> pd.Series:
    x = b.to_numpy(np.int64)
    return pd.Series((x ^ ((x >> 63) & np.int64(0x7FFFFFFFFFFFFFFF))).view(np.float64))


def _same(left: DataFrame, right: DataFrame, keys: list[str], *more: str) -> Column:
    return reduce(lambda a, b: a & b, [left[k].eqNullSafe(right[f"_{k}"]) for k in keys] + [left[m] == right[f"_{m}"] for m in more])


def _marked(df: DataFrame, *columns: str) -> DataFrame:
    return df.select(*[F.col(f"`{c}`").alias(f"_{c}") if c in columns else F.col(f"`{c}`") for c in df.columns])


def small(df: DataFrame) -> DataFrame:
    """A written table, broadcast if it is counted to be small; else joins deal it out, and Spark splits what is skewed."""
    return F.broadcast(df) if df.count() <= SMALL else df


def has_large(rows: DataFrame, keys: list[str], held: int = HELD) -> bool:
    """Whether a group has more than ``held`` rows. Tables of no more rows are not grouped, and no more than these are read of them."""
    return rows.select(*keys).limit(held + 1).count() > held and not rows.groupBy(*keys).count().where(F.col("count") > held).isEmpty()


def select_ranks(values: DataFrame, keys: list[str], wanted: DataFrame, keep: Callable[[str, DataFrame], DataFrame], sort: int = SORTED) -> DataFrame:
    """wanted (keys, rank) with value: the one of that rank, from 0, among a key's values (keys, v double without nulls)."""
    rows = values.select(*keys, ordered_bits("v").alias("b"))
    state = keep("ranks", wanted.select(*keys, "rank", F.lit(0).cast("long").alias("prefix"), F.lit(0).cast("long").alias("below"), F.lit(None).cast("long").alias("size")))
    for level in range(4):
        shift = 48 - 16 * level
        live = small(keep(f"live{level}", _marked(state.select(*keys, "prefix").distinct(), *keys, "prefix")))
        here = rows.withColumn("prefix", F.shiftright("b", shift + 16) if level else F.lit(0).cast("long"))
        counted = here.join(live, _same(here, live, keys, "prefix"), "left_semi").groupBy(*keys, "prefix", F.shiftright("b", shift).alias("next")).count()
        over = Window.partitionBy(*keys, "prefix").orderBy("next")
        counted = counted.withColumn("before", F.sum("count").over(over) - F.col("count"))
        counted = _marked(counted, *keys, "prefix")
        joined = state.join(counted, _same(state, counted, keys, "prefix")).where((F.col("rank") - F.col("below") >= F.col("before")) & (F.col("rank") - F.col("below") < F.col("before") + F.col("count")))
        state = keep(f"ranks{level}", joined.select(*keys, "rank", F.col("next").alias("prefix"), (F.col("below") + F.col("before")).alias("below"), F.col("count").alias("size")))
        if level < 3 and state.where(F.col("size") > sort).isEmpty():
            live = small(keep("last", _marked(state.select(*keys, "prefix").distinct(), *keys, "prefix")))
            here = rows.withColumn("prefix", F.shiftright("b", shift))
            found = here.join(live, _same(here, live, keys, "prefix"), "left_semi").groupBy(*keys, "prefix").agg(F.sort_array(F.collect_list("b")).alias("all"))
            found = _marked(found, *keys, "prefix")
            out = state.join(found, _same(state, found, keys, "prefix"))
            return out.select(*keys, "rank", from_bits(F.element_at("all", (F.col("rank") - F.col("below") + 1).cast("int"))).alias("value"))
    return state.select(*keys, "rank", from_bits("prefix").alias("value"))


def quantiles(rows: DataFrame, keys: list[str], wanted: dict[str, tuple[Column, float]], keep: Callable[[str, DataFrame], DataFrame] | None = None, held: int = HELD, sort: int = SORTED, bound: DataFrame | None = None) -> DataFrame:
    """(keys, ...names): for each name of wanted the quantile p of a column in each group of rows, as ``percentile`` gives it; null for a group without values.

    Null values are left out; NaN counts as the largest, null keys are a group. If no group has more than ``held`` rows, which one count tells, they are all left to
    percentile; else the values are selected by rank, with keep(name, df) writing the small tables between passes (in spark.checkpoint.dir if not given).
    bound: a table that has at least as many rows of each group and is cheaper to count.
    """
    if not has_large(rows if bound is None else bound, keys, held):
        return rows.groupBy(*keys).agg(*[F.percentile(c.cast("double"), p).alias(name) for name, (c, p) in wanted.items()])
    keep = keep or Store(rows.sparkSession).keep
    names = list(wanted)
    each = F.array(*[F.struct(F.lit(n).alias("name"), wanted[n][0].cast("double").alias("v")) for n in dict.fromkeys(names)])
    values = rows.select(*keys, F.explode(each).alias("e")).select(*keys, "e.name", "e.v").where("v IS NOT NULL")
    within = [*keys, "name"]
    p = F.create_map(*[F.lit(x) for n in names for x in (n, float(wanted[n][1]))])[F.col("name")]
    sizes = keep("sizes", values.groupBy(*within).count().withColumn("at", p * (F.col("count") - 1)))
    ranks = sizes.select(*within, F.explode(F.array_distinct(F.array(F.floor("at"), F.ceil("at")))).alias("rank"))
    found = keep("found", select_ranks(values, within, ranks, keep, sort))
    ends = found.groupBy(*within).agg(F.min_by("value", "rank").alias("low"), F.max_by("value", "rank").alias("high"))
    ends = _marked(ends, *within)
    both = sizes.join(ends, _same(sizes, ends, within))
    share = F.col("at") - F.floor("at")
    value = F.when(share > 0, (1.0 - share) * F.col("low") + share * F.col("high")).otherwise(F.col("low"))
    both = both.select(*keys, "name", value.alias("value"))
    groups = rows.select(*keys).distinct() if keys else rows.sparkSession.range(1).select()
    out = both.groupBy(*keys).pivot("name", names).agg(F.first("value"))
    out = _marked(out, *keys)
    return groups.join(out, _same(groups, out, keys) if keys else F.lit(True), "left").select(*keys, *names)


def medians(rows: DataFrame, keys: list[str], keep: Callable[[str, DataFrame], DataFrame] | None = None, held: int = HELD, bound: DataFrame | None = None, **columns: Column) -> DataFrame:
    """(keys, ...names): the median of each column in each group."""
    return quantiles(rows, keys, {name: (c, 0.5) for name, c in columns.items()}, keep, held, bound=bound)
