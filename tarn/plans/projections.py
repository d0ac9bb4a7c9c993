"""Projections: event rows to keyed tables, the same in batch and in micro-batches."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.fold import Fold


@dataclass(frozen=True)
class MultiStream:
    """Events of many streams to documents of another key, folded by sequence.

    identity: the key of an event by type; identities: an array of keys; fan_out: an array of children, each of which
    becomes an event of the given child type with the columns of the child.
    """

    fold: Fold
    identity: dict[str, Column] = field(default_factory=dict)
    identities: dict[str, Column] = field(default_factory=dict)
    fan_out: dict[str, tuple[str, Column, Callable[[Column], Column]]] = field(default_factory=dict)

    def slices(self, events: DataFrame) -> DataFrame:
        """Events with their key as ``doc_key``, in an order ``doc_order``."""
        parts = []
        for name, key in self.identity.items():
            parts.append(events.where(F.col("type") == name).withColumn("doc_key", key).withColumn("_part", F.lit(0)))
        for name, keys in self.identities.items():
            parts.append(events.where(F.col("type") == name).withColumn("doc_key", F.explode(F.array_distinct(keys))).withColumn("_part", F.lit(0)))
        for name, (child, items, key) in self.fan_out.items():
            spread = events.where(F.col("type") == name).select("*", F.posexplode(items).alias("_part", "_child"))
            parts.append(spread.withColumn("doc_key", key(F.col("_child"))).withColumn("type", F.lit(child)).drop("_child"))
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out.where("doc_key is not null").withColumn("doc_order", F.struct("seq_id", "_part")).drop("_part", "stream_id", "version", "seq_id")

    def project(self, events: DataFrame) -> DataFrame:
        return self.fold.project(self.slices(events), "doc_key", "doc_order")


@dataclass(frozen=True)
class Write:
    """What an event does to a column of a flat table. kind: set, add (from ``amount``), with its value on insert."""

    kind: str
    value: Column
    insert: Column


def set_to(value: Column | Any) -> Write:
    value = value if isinstance(value, Column) else F.lit(value)
    return Write("set", value, value)


def increment(member: Column | None = None) -> Write:
    """By a member: inserts it, later adds it. Without: inserts 1, later adds 1."""
    by = F.lit(1) if member is None else member
    return Write("add", by, by)


def decrement(member: Column | None = None) -> Write:
    """By a member: inserts it as it is, later subtracts it. Without: inserts 0, later subtracts 1."""
    return Write("add", F.lit(-1), F.lit(0)) if member is None else Write("add", -member, member)


@dataclass(frozen=True)
class FlatTable:
    """A table with a row for each key, upserted event by event.

    columns: name to type; writes: event type to {column: Write}; deletes: event types that remove the row. The first
    event of a row inserts it: columns that it doesn't write are null, and adding to null stays null until a set.

    Instead of replaying a key's events in order, its rows are aggregated: events after the key's last delete count; a
    column begins with its last set (or its insert), and sums what was added after that. So a hot key is summed in parts
    before the shuffle.
    """

    key: Column
    columns: dict[str, str]
    writes: dict[str, dict[str, Write]]
    deletes: tuple[str, ...] = ()

    def project(self, events: DataFrame) -> DataFrame:
        rows = events.where(F.col("type").isin(*self.writes, *self.deletes)).withColumn("_key", self.key).where("_key is not null")
        gone = F.col("type").isin(*self.deletes) if self.deletes else F.lit(False)
        edge = rows.groupBy("_key").agg(F.max(F.when(gone, F.col("seq_id"))).alias("_gone"))
        live = rows.join(edge, "_key").where(~gone & (F.col("_gone").isNull() | (F.col("seq_id") > F.col("_gone"))))
        first = live.groupBy("_key").agg(F.min("seq_id").alias("_first"), *[F.max(F.when(self._any(c, "set"), F.col("seq_id"))).alias(f"_set_{c}") for c in self.columns])
        live = live.join(first, "_key")
        return live.groupBy(F.col("_key").alias("key")).agg(*[self._column(c).cast(t).alias(c) for c, t in self.columns.items()])

    def _types(self, column: str, kind: str) -> list[str]:
        return [name for name, w in self.writes.items() if column in w and w[column].kind == kind]

    def _any(self, column: str, kind: str) -> Column:
        names = self._types(column, kind)
        return F.col("type").isin(*names) if names else F.lit(False)

    def _pick(self, column: str, kind: str, what: str) -> Column:
        kinds = self.columns[column]
        out = F.lit(None).cast(kinds)
        for name in self._types(column, kind):
            out = F.when(F.col("type") == name, getattr(self.writes[name][column], what).cast(kinds)).otherwise(out)
        return out

    def _column(self, column: str) -> Column:
        at_first = F.col("seq_id") == F.col("_first")
        last_set = F.col(f"_set_{column}")
        base_set = F.max(F.when(F.col("seq_id") == last_set, F.struct(self._pick(column, "set", "value").alias("v"))))["v"]
        inserted = F.max(F.when(at_first, self._pick(column, "add", "insert")))
        has_set = F.max(last_set).isNotNull()
        later = F.when(last_set.isNull(), ~at_first).otherwise(F.col("seq_id") > last_set)
        added = F.coalesce(F.sum(F.when(later & self._any(column, "add"), self._pick(column, "add", "value"))), F.lit(0))
        if self.columns[column] == "string":
            return base_set
        return F.when(has_set, base_set).otherwise(inserted) + added


@dataclass(frozen=True)
class EventProjection:
    """Event types to the rows that they store: name of an output to {event type: {column: expression}}."""

    outputs: dict[str, dict[str, dict[str, Column]]]

    def project(self, events: DataFrame) -> dict[str, DataFrame]:
        out = {}
        for name, kinds in self.outputs.items():
            parts = [events.where(F.col("type") == t).select(*[c.alias(k) for k, c in shape.items()]) for t, shape in kinds.items()]
            made = parts[0]
            for p in parts[1:]:
                made = made.unionByName(p, allowMissingColumns=True)
            out[name] = made
        return out


@dataclass(frozen=True)
class Composite:
    """Ordered stages over one batch of events: a stage sees the events and the rows of the stages before it."""

    stages: tuple[tuple[str, Callable[[DataFrame, dict[str, DataFrame]], DataFrame]], ...]

    def project(self, events: DataFrame) -> dict[str, DataFrame]:
        made: dict[str, DataFrame] = {}
        for name, stage in self.stages:
            made[name] = stage(events, dict(made))
        return made
