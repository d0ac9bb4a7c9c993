"""Folds of ordered events into aggregates.

A fold has state fields and, for each event type, what the event does: ``create`` sets the state of an aggregate that
isn't there, ``apply`` changes fields, ``delete`` ends it (a later event may create it anew). Handlers are column
expressions of the state and the event, so a fold runs inside the engine as one ordered ``aggregate`` over a stream's
events. Flat tables, whose columns are sets and sums, need no ordered list at all: see ``flat_table``.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Change = dict[str, Callable[[Column, Column], Any]]


@dataclass(frozen=True)
class Fold:
    """fields: name to (type, value of a new aggregate)."""

    fields: dict[str, tuple[str, Any]]
    creates: dict[str, Change] = field(default_factory=dict)
    applies: dict[str, Change] = field(default_factory=dict)
    deletes: dict[str, Callable[[Column, Column], Any] | None] = field(default_factory=dict)
    #: Whether an apply makes an aggregate that isn't there (with the fields' first values).
    lenient: bool = True

    def create(self, type_name: str, **change: Callable[[Column, Column], Any]) -> Fold:
        return self._with(creates={**self.creates, type_name: change})

    def apply(self, type_name: str, **change: Callable[[Column, Column], Any]) -> Fold:
        return self._with(applies={**self.applies, type_name: change})

    def delete(self, type_name: str, when: Callable[[Column, Column], Any] | None = None) -> Fold:
        return self._with(deletes={**self.deletes, type_name: when})

    def _with(self, **change: Any) -> Fold:
        return Fold(**{**{k: getattr(self, k) for k in ("fields", "creates", "applies", "deletes", "lenient")}, **change})

    @property
    def types(self) -> list[str]:
        return sorted({*self.creates, *self.applies, *self.deletes})

    def fresh(self) -> dict[str, Column]:
        return {k: F.lit(v).cast(t) if not isinstance(v, Column) else v.cast(t) for k, (t, v) in self.fields.items()}

    def step(self, state: Column, event: Column) -> Column:
        alive = F.coalesce(state["alive"], F.lit(False))
        fresh = self.fresh()
        start = {k: F.when(alive, state[k]).otherwise(fresh[k]) for k in self.fields}
        begun = F.struct(*[v.alias(k) for k, v in start.items()])
        out = {k: F.when(alive, state[k]) for k in self.fields}
        now = alive
        for name in self.types:
            hit = event["type"] == name
            made = dict(start)
            if name in self.creates and name not in self.applies:
                made = {k: F.when(alive, state[k]).otherwise(F.lit(self.creates[name][k](begun, event)).cast(t) if k in self.creates[name] else fresh[k]) for k, (t, _) in self.fields.items()}
                lives = F.lit(True)
            elif name in self.applies:
                change = self.applies[name]
                made = {k: F.lit(change[k](begun, event)).cast(t) if k in change else start[k] for k, (t, _) in self.fields.items()}
                lives = F.lit(True) if self.lenient else alive
            else:
                lives = alive
            if name in self.deletes:
                when = self.deletes[name]
                lives = lives & ~(F.lit(True) if when is None else when(F.struct(*[v.alias(k) for k, v in made.items()]), event))
            for k in self.fields:
                out[k] = F.when(hit, F.when(lives, made[k])).otherwise(out[k])
            now = F.when(hit, lives).otherwise(now)
        return F.struct(now.alias("alive"), *[out[k].cast(t).alias(k) for k, (t, _) in self.fields.items()])

    def run(self, events: DataFrame, key: str = "stream_id", order: str = "version", start: DataFrame | None = None) -> DataFrame:
        """(key, alive, fields) of every key; events: key, order, type and what the handlers read.

        start: (key, fields) states to go on from, as a snapshot or a compacted stream gives them.
        """
        read = [c for c in events.columns if c not in (key, order)]
        known = events.where(F.col("type").isin(*self.types))
        lists = known.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(order, *read))).alias("_events"))
        zero = self._zero()
        if start is not None:
            given = start.select(F.col(key), F.struct(F.lit(True).alias("alive"), *[F.col(k).cast(t).alias(k) for k, (t, _) in self.fields.items()]).alias("_start"))
            lists = lists.join(given, key, "full").withColumn("_events", F.coalesce("_events", F.array()))
            zero = F.coalesce(F.col("_start"), zero)
        folded = lists.select(key, F.aggregate("_events", zero, self.step).alias("_state"))
        return folded.select(key, F.coalesce(F.col("_state.alive"), F.lit(False)).alias("alive"), *[F.col(f"_state.{k}").alias(k) for k in self.fields])

    def _zero(self) -> Column:
        return F.struct(F.lit(False).alias("alive"), *[F.lit(None).cast(t).alias(k) for k, (t, _) in self.fields.items()])

    def project(self, events: DataFrame, key: str = "stream_id", order: str = "version", start: DataFrame | None = None) -> DataFrame:
        """The aggregates that are there at the end."""
        return self.run(events, key, order, start).where("alive").drop("alive")

    def last_known(self, events: DataFrame, key: str = "stream_id", order: str = "version") -> DataFrame:
        """Each key's state after the last event that left it alive."""
        names = list(self.fields)
        read = [c for c in events.columns if c not in (key, order)]
        lists = events.where(F.col("type").isin(*self.types)).groupBy(key).agg(F.array_sort(F.collect_list(F.struct(order, *read))).alias("_events"))
        zero = F.struct(self._zero().alias("now"), self._zero().alias("last"))

        def step(acc: Column, event: Column) -> Column:
            now = self.step(acc["now"], event)
            return F.struct(now.alias("now"), F.when(now["alive"], now).otherwise(acc["last"]).alias("last"))

        folded = lists.select(key, F.aggregate("_events", zero, step)["last"].alias("_state")).where("_state.alive")
        return folded.select(key, *[F.col(f"_state.{k}").alias(k) for k in names])

    def timeline(self, events: DataFrame, key: str = "stream_id", order: str = "version") -> DataFrame:
        """The state after each event: each stream is folded once, and leaves a state for each event."""
        read = [c for c in events.columns if c not in (key, order)]
        lists = events.where(F.col("type").isin(*self.types)).groupBy(key).agg(F.array_sort(F.collect_list(F.struct(order, *read))).alias("_events"))
        mark = lambda event, state: F.struct(event[order].alias(order), event["type"].alias("type"), state.alias("state"))
        shape = f"array<struct<{order}:{events.schema[order].dataType.simpleString()},type:string,state:struct<alive:boolean,{','.join(f'{k}:{t}' for k, (t, _) in self.fields.items())}>>>"
        zero = F.struct(self._zero().alias("now"), F.array().cast(shape).alias("all"))

        def step(acc: Column, event: Column) -> Column:
            now = self.step(acc["now"], event)
            return F.struct(now.alias("now"), F.concat(acc["all"], F.array(mark(event, now)).cast(shape)).alias("all"))

        out = lists.select(key, F.explode(F.aggregate("_events", zero, step)["all"]).alias("_at"))
        return out.select(key, f"_at.{order}", "_at.type", F.coalesce(F.col("_at.state.alive"), F.lit(False)).alias("alive"), *[F.col(f"_at.state.{k}").alias(k) for k in self.fields])


def to_version(events: DataFrame, version: int, order: str = "version") -> DataFrame:
    return events.where(F.col(order) <= version)


def as_of(events: DataFrame, when: Any) -> DataFrame:
    return events.where(F.col("timestamp") <= when)


def compact(events: DataFrame, fold: Fold, key: str = "stream_id", order: str = "version") -> DataFrame:
    """Each stream as its last event, which carries the folded state; streams that fold to nothing stay as they are.

    The state goes into column ``compacted``; ``resume`` splits a log into such states and the events after them.
    """
    done = fold.project(events, key, order).select(key, F.struct(*fold.fields).alias("_state"))
    last = events.groupBy(key).agg(F.max(order).alias("_last"), F.count(F.lit(1)).alias("_n"))
    out = events.join(last.join(done, key, "left"), key)
    folds = F.col("_state").isNotNull() & (F.col("_n") > 1)
    out = out.where(~folds | (F.col(order) == F.col("_last")))
    return out.select(*events.columns, F.when(folds, F.col("_state")).alias("compacted"))


def resume(events: DataFrame, fold: Fold, key: str = "stream_id", order: str = "version") -> DataFrame:
    """The fold of a compacted log: every stream goes on from its last compacted state."""
    base = events.where("compacted is not null").groupBy(key).agg(F.max_by("compacted", order).alias("_c"), F.max(order).alias("_at"))
    start = base.select(key, *[F.col(f"_c.{k}").alias(k) for k in fold.fields])
    later = events.join(base.select(key, "_at"), key, "left").where(F.col("_at").isNull() | (F.col(order) > F.col("_at")))
    return fold.project(later.drop("_at", "compacted"), key, order, start)
