"""Membership bitmaps of fixed size: which rows of a large table may belong to a set of ids, before the exact join.

A bitmap takes 1 MB, whatever the set; a set too large for it lets more rows through to the join, never fewer.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import _vec
from .decontaminate import bitmap, has


def of(ids: DataFrame) -> np.ndarray:
    """The bitmap of a one-column table of bigint ids."""

    def names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch([pa.array(_vec.signed(_vec.mix(batch.column(0).to_numpy().view(np.uint64))))], names=["h"])

    return bitmap(ids.mapInArrow(names, "h bigint"))


def may_hold(bits: np.ndarray, ids: np.ndarray) -> np.ndarray:
    return has(bits, _vec.mix(ids.view(np.uint64)))


def rows_of(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of ``rows`` (first column a bigint id) whose id is in ``ids``, a written one-column table ``id``."""
    bits = rows.sparkSession.sparkContext.broadcast(of(ids))

    def thin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids_ = batch.column(0)
            known = ids_.is_valid().to_numpy(zero_copy_only=False)
            keep = known & may_hold(bits.value, ids_.fill_null(0).to_numpy())
            yield batch.filter(pa.array(keep))

    return rows.mapInArrow(thin, rows.schema).join(ids, rows.columns[0], "left_semi")
