"""Running sums and positions within groups of any size, without one task per group."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfwise.llm.session import drop_scratch, free_name, materialize


def cumulate(at: int):
    """Batches with the sum of column ``at`` over all earlier rows of the partition as one more column."""

    def run(batches):
        total = 0
        for batch in batches:
            values = np.asarray(batch.column(at).fill_null(0)).astype(np.int64)
            sums = np.cumsum(values)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(total + sums - values)], names=[*batch.schema.names, "upto"])
            total += int(sums[-1]) if len(sums) else 0

    return run


def running(df: DataFrame, groups: list[str], order: list[Column], amount: str | None = None, name: str = "before", total: str = "total", beside: DataFrame | None = None) -> DataFrame:
    """``df`` (written, as it is read twice) with two or more columns: ``name``, the sum of ``amount`` (rows where None)
    over the rows of the same group that come before by ``order``, and ``total``, the sum over the group; then the columns
    of ``beside``, which has a row per group.

    Rows are dealt out by range of group, order and row, so a group, and a run of rows that tie, go over as many tasks as
    they need; each task sums its own rows, and sums of earlier tasks are added by group and task. Groups are columns
    without nulls."""
    tie, at, upto, part = (free_name(df, c) for c in ("_tie", "_at", "_upto", "_part"))
    keys = [*(F.col(g) for g in groups), *order, F.col(tie)]
    dealt = df.withColumn(tie, F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys).drop(tie).withColumn(at, F.monotonically_increasing_id())
    if amount is None:
        dealt = dealt.withColumn(upto, F.col(at).bitwiseAND((1 << 33) - 1))
    else:
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in dealt.schema.fields)
        dealt = dealt.mapInArrow(cumulate(dealt.columns.index(amount)), f"{schema}, `upto` long").withColumnRenamed("upto", upto)
    rows = materialize(dealt.withColumn(part, F.shiftright(at, 33)), "ranked")
    shares = rows.groupBy(*groups, part).agg(F.min(upto).alias("_first"), F.sum(F.lit(1) if amount is None else F.col(amount)).cast("long").alias("_sum"))
    each, earlier = Window.partitionBy(*groups), Window.partitionBy(*groups).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    shifts = shares.select(*groups, part, (F.coalesce(F.sum("_sum").over(earlier), F.lit(0)) - F.col("_first")).alias("_shift"), F.sum("_sum").over(each).alias(total))
    if beside is not None:
        shifts = shifts.join(beside, groups)
    more = [c for c in (beside.columns if beside is not None else []) if c not in groups]
    out = rows.join(shifts, [*groups, part]).select(*df.columns, (F.col(upto) + F.col("_shift")).alias(name), total, *more)
    out = materialize(out, "running")
    drop_scratch(rows)
    return out
