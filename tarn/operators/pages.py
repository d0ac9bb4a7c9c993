"""Pages of a result of any size: the rows from an offset on, all of them or so many.

Spark takes an offset in one task, which sees every row: without a limit it sorts them all again, with one it holds
offset + limit rows. A small page is left to it. Otherwise the rows are written once, sorted over all tasks, with the
place that each has in its task; from the tasks' counts follows the place of the first row of the page and of the
first after it. Rows that the ordering ties get their places in that one write too, so none is lost or shown twice.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import named_root, scratch_root

#: Rows that Spark may hold in one task for a page.
SMALL = 10_000
#: The bits of a place within a task, in Spark's increasing ids.
BITS = 33


def page(df: DataFrame, offset: int | None, limit: int | None, ordered: bool = True) -> DataFrame:
    """A page of ``df``, which is sorted if ``ordered``; rows without an order may be any."""
    offset = offset or 0
    whole = limit is None and not offset
    small = limit is not None and (offset + limit <= SMALL or not (ordered or offset))
    # Spark refuses negative numbers by itself.
    if not (whole or small or offset < 0 or (limit or 0) < 0) and named_root(df.sparkSession) is not None:
        try:
            return _placed(df, offset, limit, ordered)
        except AnalysisException as e:
            # Types that Parquet doesn't hold: calendar intervals and structs without a field.
            if not str(e.getCondition()).endswith("_FOR_DATASOURCE"):
                raise
    df = df.offset(offset) if offset else df
    return df if limit is None else df.limit(limit)


def _placed(df: DataFrame, offset: int, limit: int | None, ordered: bool) -> DataFrame:
    root = scratch_root(df.sparkSession, "page")
    rows = df.toDF(*[f"_{i}" for i in range(len(df.columns))]).withColumn("_at", F.monotonically_increasing_id())
    rows.write.parquet(root)
    held = df.sparkSession.read.schema(rows.schema).parquet(root)
    parts = sorted(tuple(r) for r in held.groupBy(F.shiftright("_at", BITS)).agg(F.count(F.lit(1))).collect())

    def place(n: int) -> int | None:
        """The id of row n; none after the last."""
        for part, size in parts:
            if n < size:
                return (part << BITS) + n
            n -= size
        return None

    first, end = place(offset), None if limit is None else place(offset + limit)
    held = held.where(F.lit(False) if first is None else F.col("_at") >= first)
    if end is not None:
        held = held.where(F.col("_at") < end)
    return (held.orderBy("_at") if ordered else held).drop("_at").toDF(*df.columns)
