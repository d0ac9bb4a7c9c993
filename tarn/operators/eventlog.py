"""Reads of an event log: one row for each event, with a global sequence and a version within its stream.

Columns: seq_id, stream_id, version, type, timestamp, tenant_id, is_archived and the body (``data`` as JSON text, or
typed columns). Stream reads, metadata and body queries see archived events; the asynchronous side and natural keys
don't.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import QueryNotSupported
from .pages import page as page_of


def assign_versions(events: DataFrame, stream: str = "stream_id", order: str = "seq_id", base: int = 0) -> DataFrame:
    """Versions 1, 2, ... of each stream in the order of arrival."""
    w = Window.partitionBy(stream).orderBy(order)
    return events.withColumn("version", (F.row_number().over(w) + F.lit(base)).cast("long"))


@dataclass(frozen=True)
class TagCondition:
    """Events that carry a tag value, of one type if given."""

    tag: str
    value: Any
    type: str | None = None


@dataclass(frozen=True)
class EventLog:
    events: DataFrame
    #: Types whose bodies are bytes.
    binary: frozenset[str] = frozenset()
    #: The highest sequence that was ever given, if it is known; its event may be gone.
    issued: int = 0

    # Streams.
    def fetch_stream(self, stream: Any, version: int | None = None, timestamp: Any = None, from_version: int | None = None, known: list[str] | None = None) -> DataFrame:
        """A stream's events by version: up to a version or time, or from a version; types not in ``known`` are skipped."""
        df = self.events.where(F.col("stream_id") == F.lit(stream))
        if version is not None:
            df = df.where(F.col("version") <= version)
        if from_version is not None:
            df = df.where(F.col("version") >= from_version)
        if timestamp is not None:
            df = df.where(F.col("timestamp") <= timestamp)
        if known is not None:
            df = df.where(F.col("type").isin(*known))
        return df.orderBy("version")

    def streams(self) -> DataFrame:
        """One row for each stream: its version, first and last time, and whether it is archived."""
        extra = [F.bool_or("is_archived").alias("is_archived")] if "is_archived" in self.events.columns else []
        return self.events.groupBy("stream_id").agg(
            F.max("version").alias("version"), F.min("timestamp").alias("created"), F.max("timestamp").alias("timestamp"), *extra
        )

    def stream_state(self, stream: Any) -> DataFrame:
        return EventLog(self.events.where(F.col("stream_id") == F.lit(stream))).streams()

    def recent_streams(self, n: int) -> DataFrame:
        return self.streams().orderBy(F.col("timestamp").desc(), "stream_id").limit(n)

    # Events.
    def load(self, seq_id: int) -> DataFrame:
        return self.events.where(F.col("seq_id") == seq_id)

    def where(self, predicate: Column) -> DataFrame:
        return self.events.where(predicate).orderBy("seq_id")

    def page(self, number: int = 1, size: int = 50, **equal: Any) -> DataFrame:
        """Events with the given values of type, stream_id, correlation_id, causation_id or user_name; a page by sequence."""
        return page_of(self._equal(equal).orderBy("seq_id"), (number - 1) * size, size)

    def page_total(self, **equal: Any) -> DataFrame:
        return self._equal(equal).agg(F.count(F.lit(1)).alias("total"))

    def _equal(self, equal: dict[str, Any]) -> DataFrame:
        df = self.events
        for name, value in equal.items():
            if name not in ("type", "stream_id", "correlation_id", "causation_id", "user_name"):
                raise QueryNotSupported(f"an event page by {name}")
            df = df.where(F.col(name) == F.lit(value))
        return df

    def bodies(self, type_name: str, schema: str, predicate: Column | None = None) -> DataFrame:
        """Bodies of one type, parsed by a schema, as ``body``; a binary body can't be read."""
        df = self.events.where(F.col("type") == type_name)
        if type_name in self.binary:
            raise QueryNotSupported("a query of binary bodies")
        df = df.withColumn("body", F.from_json("data", schema))
        return (df if predicate is None else df.where(predicate)).orderBy("seq_id")

    # The asynchronous side.
    def daemon_page(self, floor: int, ceiling: int, n: int, types: list[str] | None = None) -> DataFrame:
        """Events after ``floor`` up to ``ceiling`` of every tenant, without archived ones. The bound is the page's size."""
        df = self.events.where((F.col("seq_id") > floor) & (F.col("seq_id") <= ceiling))
        if "is_archived" in df.columns:
            df = df.where(~F.col("is_archived"))
        if types is not None:
            df = df.where(F.col("type").isin(*types))
        return df.orderBy("seq_id").limit(n)

    def statistics(self) -> DataFrame:
        return self.events.agg(
            F.count(F.lit(1)).alias("event_count"), F.countDistinct("stream_id").alias("stream_count"), F.greatest(F.coalesce(F.max("seq_id"), F.lit(0)), F.lit(self.issued)).alias("highest_sequence")
        )

    def floor_at(self, when: Any) -> DataFrame:
        return self.events.where(F.col("timestamp") <= when).agg(F.coalesce(F.max("seq_id"), F.lit(0)).alias("floor"))

    # Tags: tables of (value, seq_id).
    def by_tags(self, conditions: list[TagCondition], tags: dict[str, DataFrame]) -> DataFrame:
        """Events that any condition meets, each once, by sequence; no condition finds none."""
        hits = None
        for c in conditions:
            one = tags[c.tag].where(F.col("value") == F.lit(c.value)).select(F.col("seq_id").alias("_seq"), F.lit(c.type).cast("string").alias("_type"))
            hits = one if hits is None else hits.unionByName(one)
        if hits is None:
            return self.events.where(F.lit(False))
        on = (F.col("seq_id") == F.col("_seq")) & (F.col("_type").isNull() | (F.col("_type") == F.col("type")))
        return self.events.join(hits, on, "left_semi").orderBy("seq_id")

    def exist_by_tags(self, conditions: list[TagCondition], tags: dict[str, DataFrame]) -> bool:
        return not self.by_tags(conditions, tags).isEmpty()

    def resolve_key(self, keys: DataFrame, value: Any) -> DataFrame:
        """The live stream of a natural key; keys: (value, stream_id)."""
        live = self.streams()
        if "is_archived" in live.columns:
            live = live.where(~F.col("is_archived"))
        return keys.where(F.col("value") == F.lit(value)).join(live, "stream_id").select("value", "stream_id", "version")


def natural_keys(events: DataFrame, value: Column) -> DataFrame:
    """(value, stream_id) of the events that set a key; keys of several streams are conflicts."""
    return events.select(value.alias("value"), "stream_id").where("value is not null").distinct()


def key_conflicts(keys: DataFrame) -> DataFrame:
    return keys.groupBy("value").agg(F.countDistinct("stream_id").alias("streams")).where("streams > 1")


def archive(events: DataFrame, archived: DataFrame) -> DataFrame:
    """The log with the events of the given streams flagged; archived: (stream_id)."""
    flag = archived.select("stream_id").distinct().withColumn("_gone", F.lit(True))
    base = F.col("is_archived") if "is_archived" in events.columns else F.lit(False)
    return events.join(flag, "stream_id", "left").withColumn("is_archived", F.coalesce("_gone", base)).drop("_gone")


def tombstone(events: DataFrame, streams: DataFrame) -> DataFrame:
    """The log without the events of the given streams."""
    return events.join(streams.select("stream_id").distinct(), "stream_id", "left_anti")


def mask(events: DataFrame, rules: dict[str, dict[str, Column]], within: Column | None = None) -> DataFrame:
    """Personal data replaced: rules give new column values by event type; ``within`` narrows the events."""
    if not rules:
        raise QueryNotSupported("masking without a rule")
    out = events
    for column in {c for r in rules.values() for c in r}:
        value = F.col(column)
        for kind, changes in rules.items():
            if column in changes:
                hit = F.col("type") == kind
                value = F.when(hit if within is None else hit & within, changes[column]).otherwise(value)
        out = out.withColumn(column, value)
    return out


def overwrite(events: DataFrame, changes: DataFrame) -> DataFrame:
    """New bodies for some events; changes: (seq_id, and the columns to replace). The rest of a row stays."""
    names = [c for c in changes.columns if c != "seq_id"]
    new = changes.select(F.col("seq_id").alias("_seq"), F.lit(True).alias("_hit"), *[F.col(c).alias(f"_{c}") for c in names])
    out = events.join(new, F.col("seq_id") == F.col("_seq"), "left")
    for c in names:
        out = out.withColumn(c, F.when(F.col("_hit"), F.col(f"_{c}")).otherwise(F.col(c)))
    return out.select(*events.columns)


def replace_events(events: DataFrame, tags: dict[str, DataFrame], changes: DataFrame) -> tuple[DataFrame, dict[str, DataFrame]]:
    """New bodies, types and ids at the same sequence, version and time; the events' tags go."""
    return overwrite(events, changes), {k: t.join(changes.select("seq_id"), "seq_id", "left_anti") for k, t in tags.items()}


def delete_events(events: DataFrame, seq_ids: DataFrame) -> DataFrame:
    return events.join(seq_ids.select("seq_id"), "seq_id", "left_anti")


def assign_tags(tags: DataFrame, events: DataFrame, value: Any) -> DataFrame:
    """Tag rows with those of ``events`` added, each once."""
    new = events.select(F.lit(value).cast(tags.schema["value"].dataType).alias("value"), "seq_id")
    return tags.unionByName(new.join(tags, ["value", "seq_id"], "left_anti").distinct())
