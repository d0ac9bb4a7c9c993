"""Partial updates of documents, as column expressions. Steps see what the steps before them made."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import QueryNotSupported


@dataclass(frozen=True)
class Patch:
    """Members are columns, or ``struct.field`` of a struct column."""

    steps: tuple[Callable[[DataFrame], DataFrame], ...] = ()

    def _then(self, step: Callable[[DataFrame], DataFrame]) -> Patch:
        return Patch((*self.steps, step))

    def _change(self, member: str, value: Callable[[Column], Any]) -> Patch:
        def step(df: DataFrame) -> DataFrame:
            return _put(df, member, value(F.col(member)))

        return self._then(step)

    def set(self, member: str, value: Any) -> Patch:
        return self._then(lambda df: _put(df, member, value))

    def duplicate(self, member: str, value: Any, *others: str) -> Patch:
        out = self.set(member, value)
        for other in others:
            out = out.set(other, value)
        return out

    def increment(self, member: str, by: float = 1) -> Patch:
        return self._change(member, lambda c: F.coalesce(c, F.lit(0)) + F.lit(by))

    def append(self, member: str, value: Any) -> Patch:
        return self._change(member, lambda c: F.array_append(F.coalesce(c, F.array()), F.lit(value)))

    def append_if_not_exists(self, member: str, value: Any) -> Patch:
        return self._change(member, lambda c: F.when(F.coalesce(F.exists(c, lambda x: x.eqNullSafe(F.lit(value))), F.lit(False)), c).otherwise(F.array_append(F.coalesce(c, F.array()), F.lit(value))))

    def insert(self, member: str, value: Any, index: int = 0) -> Patch:
        """Before the element at ``index``; past the end it appends."""
        if index < 0:
            raise QueryNotSupported("an insert before the start of a list")

        def put(c: Column) -> Column:
            old = F.coalesce(c, F.array())
            return F.concat(F.slice(old, 1, index) if index else F.slice(old, 1, 0), F.array(F.lit(value)), F.slice(old, index + 1, F.greatest(F.size(old) - index, F.lit(0))))

        return self._change(member, put)

    def remove(self, member: str, value: Any) -> Patch:
        """All equal elements; a null list becomes an empty one."""
        return self._change(member, lambda c: F.coalesce(F.filter(c, lambda x: ~x.eqNullSafe(F.lit(value))), F.array()))

    def rename(self, member: str, new: str) -> Patch:
        return self._then(lambda df: _put(df, new, F.col(member)).transform(lambda d: _drop(d, member)))

    def delete(self, member: str) -> Patch:
        return self._then(lambda df: _drop(df, member))

    def apply(self, df: DataFrame) -> DataFrame:
        for step in self.steps:
            df = step(df)
        return df

    def apply_where(self, df: DataFrame, predicate: Column, deleted: str | None = None) -> DataFrame:
        """Patches the live rows that meet the predicate, others stay. The schema must stay the same."""
        hit = F.coalesce(predicate, F.lit(False))
        if deleted:
            hit = hit & ~F.col(deleted)
        before = df.withColumn("_hit", hit)
        after = self.apply(before)
        if set(after.columns) != set(before.columns):
            raise QueryNotSupported("a patch of some rows that changes the members of a type")
        return before.where(~F.col("_hit")).select(*df.columns).unionByName(after.where(F.col("_hit")).select(*df.columns))


def _put(df: DataFrame, member: str, value: Any) -> DataFrame:
    value = value if isinstance(value, Column) else F.lit(value)
    top, _, rest = member.partition(".")
    if not rest:
        return df.withColumn(top, value.cast(df.schema[top].dataType) if top in df.columns else value)
    return df.withColumn(top, F.col(top).withField(rest, value))


def _drop(df: DataFrame, member: str) -> DataFrame:
    top, _, rest = member.partition(".")
    return df.withColumn(top, F.col(top).dropFields(rest)) if rest else df.drop(top)
