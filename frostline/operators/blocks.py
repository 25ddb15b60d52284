"""Windows over sessions of any length: rows are numbered, dealt out in blocks of numbers, and each block gets the few rows around it that its windows reach.

A window over a whole session puts it in one task, whatever its length. Where no session is long (a count tells) that is what happens here too; else
sessions are cut at row numbers, so that no block is larger than another, however unevenly times or sessions are spread.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window, WindowSpec

from frostline.operators.selection import HELD, has_large
from frostline.operators.stream import run_starts
from frostline.sources.stage import Store

Keep = Callable[[str, DataFrame], DataFrame]
#: Rows of a block.
BLOCK = 1 << 16


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names that no column of df has, as near as may be to those given."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def numbered(rows: DataFrame, order: list[str], keep: Keep, name: str) -> DataFrame:
    """rows with ``name``: their number from 0 in order within the session, without a task that has a whole session.

    Rows are dealt into ranges of (session_id, order) and counted as they stream by; the counts, a row for each session of a range, give where each begins. The ranges are written
    first, as they may be cut elsewhere when made again. Rows that are equal in order are numbered in any order.
    """
    part, place = fresh(rows, "part", "place")
    out = T.StructType([*rows.schema.fields, T.StructField(part, T.IntegerType()), T.StructField(place, T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple = ()
        n = 0
        for batch in batches:
            begins = run_starts(batch, "session_id")
            at = np.arange(batch.num_rows)
            if len(begins):
                start = np.repeat(begins, np.diff(begins, append=batch.num_rows))
                same = last == (batch["session_id"][0].as_py(),)
                at = at - start + np.where(start == 0, n if same else 0, 0)
                last, n = (batch["session_id"][batch.num_rows - 1].as_py(),), int(at[-1]) + 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at)], [*batch.schema.names, place])

    keys = ["session_id", *order]
    sorted_rows = rows.repartitionByRange(*[F.col(f"`{k}`") for k in keys]).sortWithinPartitions(*[F.col(f"`{k}`") for k in keys])
    ranged = keep("ranged", sorted_rows.withColumn(part, F.spark_partition_id()).mapInArrow(run, out))
    counts = ranged.groupBy("session_id", part).count()
    before = (F.sum("count").over(Window.partitionBy("session_id").orderBy(part)) - F.col("count")).alias("before")
    counts = keep("counts", counts.select(F.col("session_id").alias("sid"), F.col(part).alias("range"), before))
    joined = ranged.join(counts.hint("merge"), ranged["session_id"].eqNullSafe(counts["sid"]) & (ranged[part] == counts["range"]))
    return joined.select(*[ranged[f"`{c}`"] for c in rows.columns], (counts["before"] + ranged[place]).alias(name))


def spread(rows: DataFrame, number: str, before: int, after: int, block: int, name: str) -> DataFrame:
    """rows once for each block of numbers whose windows reach them: those within it, ``before`` ones ahead of it and ``after`` ones past it."""
    k = F.col(f"`{number}`")
    first, last = F.greatest(F.lit(0), F.floor((k - after) / F.lit(block))), F.floor((k + before) / F.lit(block))
    return rows.withColumn(name, F.explode(F.sequence(first, last)))


def windowed(rows: DataFrame, order: list[str], before: int, after: int, make: Callable[[WindowSpec], dict[str, Column]], keep: Keep | None = None, held: int = HELD, block: int = BLOCK, bound: DataFrame | None = None) -> DataFrame:
    """rows with the columns of make(window), which may look at most ``before`` rows back and ``after`` ahead in their session.

    make gets a window in order, which may be framed by rowsBetween. bound: a table with at least as many rows of each session that is cheaper to count.
    """
    if not has_large(rows if bound is None else bound, ["session_id"], held):
        return rows.withColumns(make(Window.partitionBy("session_id").orderBy(*order)))
    keep = keep or Store(rows.sparkSession).keep
    number, at = fresh(rows, "number", "block")
    dealt = spread(numbered(rows, order, keep, number), number, before, after, block, at)
    new = make(Window.partitionBy("session_id", at).orderBy(number))
    out = dealt.withColumns(new).where(F.floor(F.col(number) / F.lit(block)) == F.col(at))
    return out.select(*[F.col(f"`{c}`") for c in dict.fromkeys([*rows.columns, *new])])


def running_sum(rows: DataFrame, value: str, order: list[str], name: str, keep: Keep | None = None, held: int = HELD, block: int = BLOCK) -> DataFrame:
    """rows with ``name``: the sum of value up to each row in its session, nulls left out; null before the first value."""
    if not has_large(rows, ["session_id"], held):
        w = Window.partitionBy("session_id").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        return rows.withColumn(name, F.sum(value).over(w))
    keep = keep or Store(rows.sparkSession).keep
    number, at = fresh(rows, "number", "block")
    dealt = keep("numbered", numbered(rows, order, keep, number).withColumn(at, F.floor(F.col(number) / F.lit(block))))
    sums = dealt.groupBy("session_id", at).agg(F.sum(value).alias("total"))
    over = Window.partitionBy("session_id").orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(F.col("session_id").alias("sid"), F.col(at).alias("piece"), F.sum("total").over(over).alias("before"))
    w = Window.partitionBy("session_id", at).orderBy(number).rowsBetween(Window.unboundedPreceding, 0)
    inside = dealt.withColumn("inside_" + number, F.sum(value).over(w))
    joined = inside.join(sums.hint("merge"), inside["session_id"].eqNullSafe(sums["sid"]) & (inside[at] == sums["piece"]))
    mine = inside["inside_" + number]
    total = F.when(mine.isNull(), sums["before"]).otherwise(mine + F.coalesce(sums["before"], F.lit(0)))
    return joined.select(*[inside[f"`{c}`"] for c in rows.columns if c != name], total.alias(name))
