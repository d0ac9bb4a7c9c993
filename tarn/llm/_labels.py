"""Labelled rows for training: which rows may be learnt from, and bounded samples of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a key table that are joined by broadcast (about 40 MB); beyond it the join is a shuffled one.
BROADCAST_ROWS = 1_000_000


def fold(key: Column, parts: int) -> Column:
    return F.pmod(F.crc32(key.cast("string")), F.lit(parts))


def sample(rows: DataFrame, label: str, most: int) -> DataFrame:
    """At most ``most`` rows, the same number of each label value where there are as many: those of the smallest hashes.

    rows: (key, label), narrow. A label's count says which hashes can be among the smallest, so that only about half as
    many rows again as are wanted are ranked, however frequent a label is.
    """
    counts = rows.groupBy(label).agg(F.count(F.lit(1)).alias("n")).collect()
    each = max(1, most // max(1, len(counts)))
    place = F.pmod(F.xxhash64("key"), F.lit(1 << 40)) / F.lit(float(1 << 40))
    few = F.lit(False)
    for row in counts:
        few |= (F.col(label) == row[label]) & (place <= min(1.0, (1.5 * each + 100) / row["n"]))
    rank = Window.partitionBy(label).orderBy("_place", "key")
    ranked = rows.withColumn("_place", place).where(few).withColumn("_rank", F.row_number().over(rank))
    return ranked.where(F.col("_rank") <= each).drop("_rank", "_place")


def with_text(docs: DataFrame, keys: DataFrame, bounded: bool = False) -> DataFrame:
    """Rows of docs (key, text) that ``keys`` names, with its columns; a small key table is broadcast, a large one isn't."""
    if bounded or keys.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        keys = F.broadcast(keys)
    return docs.join(keys, "key")
