"""Asynchronous projections: micro-batches of an event log to projected tables, with their progress.

Over a store, the stream is that of the commits: a micro-batch takes the events of the manifests since the last batch
that was recorded, so events of a writer without a manifest, and tombstoned or archived ones, never come. Over a plain
folder of event files, it is that of the files.

A batch refolds the keys that it touches and writes only those rows; the batch's manifest, created exclusively, makes its
rows and its progress visible at once, and a repeated batch changes nothing. A result is the latest row of each key; it
equals what a batch run over all events gives, as far as a key's rows follow from that key's events.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from typing import Any, Protocol

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import QueryNotSupported
from ..sources.store import EVENTS, Files, Store

Project = Callable[[DataFrame], DataFrame]


class Storage(Protocol):
    """Another place for a projection's rows: a table of a catalogue, a database."""

    def write(self, rows: DataFrame, batch: int) -> None:
        """Takes a batch's rows: the key, the projected columns and ``_gone``; the same batch may come again."""

    def read(self) -> DataFrame:
        """The latest row of each key that isn't gone."""


@dataclass
class Projection:
    """name, event types that it reads, the key of an event, and the function of all events of some keys.

    ``project`` gives rows with the column ``key``. Where a row follows from more than the events of its key (flat
    tables that a joined event deletes, say), leave ``key`` None: the whole table is projected anew.
    """

    name: str
    project: Project
    key: str | None = "stream_id"
    types: list[str] | None = None
    #: Called with the new events of a batch before it is committed (a subscription, an outbox).
    subscriber: Callable[[DataFrame, int], None] | None = None
    #: Events that can't be taken in: each becomes a dead letter of its own, the others go on.
    reject: Column | None = None
    #: Whether an error of the subscriber or of ``project`` becomes dead letters; else it stops the run.
    skip_errors: bool = False
    #: Events up to this sequence are not taken in.
    start: int = 0
    #: Events that a projection raises from what a batch made, as (stream, (type, body)) pairs, appended to the store.
    raises: Callable[[DataFrame], list[tuple[str, tuple[str, dict]]]] | None = None
    #: Where the rows of a batch go and are read from, if not to Parquet below the daemon's folder.
    storage: Storage | None = None


LETTERS = "projection string, sequence long, kind string, message string"


@dataclass
class Daemon:
    """Runs projections over a store, or the folder ``events`` (of a schema), into ``root``."""

    spark: SparkSession
    events: str | Store
    schema: str
    root: str
    #: Rebuilds that run at once.
    rebuilds: int = 1
    #: Only "solo": streams have one driver, so there is no standby to take over.
    mode: str = "solo"
    files: Files = field(init=False)

    def __post_init__(self) -> None:
        if self.mode != "solo":
            raise QueryNotSupported(f"a daemon in mode {self.mode}")
        self.files = Files(self.spark, self.root)
        self._rebuilding = 0

    @classmethod
    def over(cls, store: Store, root: str) -> Daemon:
        return cls(store.spark, store, EVENTS, root)

    def run(self, projection: Projection) -> None:
        """Takes what is there, in micro-batches, and stops."""
        if isinstance(self.events, Store):
            stream = self.spark.readStream.schema("commit long").json(f"{self.events.files.root}/_commits")
        else:
            stream = self.spark.readStream.schema(self.schema).option("recursiveFileLookup", "true").parquet(self.events)
        query = (
            stream.writeStream.foreachBatch(lambda df, n: self._batch(projection, df, n))
            .option("checkpointLocation", f"{self.root}/{projection.name}/_checkpoint")
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination()

    def _batch(self, p: Projection, df: DataFrame, batch: int) -> None:
        if not isinstance(self.events, Store):
            self.take(p, df, batch)
            return
        # The rows only say that there are commits: what is taken follows from the manifests, in order, each once.
        commit = max((e["commit"] for e in self._entries(p.name)), default=0)
        head = self.events.head()
        if head > commit:
            self.take(p, self._log(head), batch, head)

    def _log(self, commit: int | None = None) -> DataFrame:
        """All events that projections may see."""
        if isinstance(self.events, Store):
            log = self.events.snapshot(commit).log().events
            return log.where(~F.col("is_archived")).drop("is_archived")
        df = self.spark.read.schema(self.schema).option("recursiveFileLookup", "true").parquet(self.events)
        return df.where(~F.col("is_archived")) if "is_archived" in df.columns else df

    def take(self, p: Projection, df: DataFrame, batch: int, commit: int = 0) -> None:
        """One batch of events, to be called again with the same number after a failure."""
        if f"{batch:012d}.json" in self.files.names(f"{p.name}/_batches"):
            return
        df = df.where(F.col("seq_id") > (max(p.start, self.progress(p.name)) if commit else p.start))
        if "is_archived" in df.columns:
            df = df.where(~F.col("is_archived"))
        seen = self.events.snapshot(commit).last_sequence() if commit else df.agg(F.max("seq_id")).first()[0] or 0
        if p.types is not None:
            df = df.where(F.col("type").isin(*p.types))
        path = f"{p.name}/inputs/{batch:012d}"
        df.write.mode("overwrite").parquet(f"{self.root}/{path}")
        new = self.spark.read.schema(df.schema).parquet(f"{self.root}/{path}")
        low, last = new.agg(F.min("seq_id"), F.max("seq_id")).first()
        letters = f"{p.name}/letters/{batch:012d}-{uuid.uuid4().hex[:8]}"
        if p.reject is not None:
            bad = new.where(F.coalesce(p.reject, F.lit(False)))
            bad.select(F.lit(p.name).alias("projection"), F.col("seq_id").alias("sequence"), F.lit("rejected").alias("kind"), F.lit("").alias("message")).write.mode("overwrite").parquet(f"{self.root}/{letters}/rejected")
        good, failed = self._sound(p, new), []
        if last is not None:
            failed = self._attempt(p, good, batch, low, last)
        if failed:
            rows = [(p.name, f["sequence"], f["kind"], f["message"]) for f in failed]
            self.spark.createDataFrame(rows, LETTERS).coalesce(1).write.mode("overwrite").parquet(f"{self.root}/{letters}/failed")
        entry = {"batch": batch, "commit": commit, "input": path, "letters": letters if failed or p.reject is not None else None, "last_sequence": max(seen, self.progress(p.name)), "rows": None}
        if p.key is not None:
            held = self._inputs(p, [*[e["input"] for e in self._entries(p.name)], path])
            dead = self._dead([*self._letters(p.name), *([letters] if entry["letters"] else [])])
            touched = self._sound(p, new).select(F.col(p.key).alias("_key")).distinct()
            mine = self._alive(self._sound(p, held), dead).join(touched, F.col(p.key) == F.col("_key"), "left_semi")
            made = p.project(mine)
            entry["rows"] = f"{p.name}/rows/{batch:012d}-{uuid.uuid4().hex[:8]}"
            # Keys that have no row any more are there with a mark.
            gone = touched.join(made.select(F.col(p.key).alias("_key")), "_key", "left_anti").withColumnRenamed("_key", p.key).withColumn("_gone", F.lit(True))
            rows = made.withColumn("_gone", F.lit(False)).unionByName(gone, allowMissingColumns=True)
            if p.storage is not None:
                p.storage.write(rows, batch)
            else:
                rows.withColumn("_batch", F.lit(batch)).write.mode("overwrite").parquet(f"{self.root}/{entry['rows']}")
        self.files.create(f"{p.name}/_batches/{batch:012d}.json", json.dumps(entry))
        if p.raises is not None and isinstance(self.events, Store) and last is not None:
            session = self.events.session()
            for stream, event in p.raises(good):
                session.append(stream, event)
            session.save()

    @staticmethod
    def _sound(p: Projection, df: DataFrame) -> DataFrame:
        return df if p.reject is None else df.where(~F.coalesce(p.reject, F.lit(False)))

    def _attempt(self, p: Projection, df: DataFrame, batch: int, low: int, high: int) -> list[dict]:
        """Runs the subscriber, and the projection of the new events alone, and halves what fails down to single events."""
        part = df.where((F.col("seq_id") >= low) & (F.col("seq_id") <= high))
        try:
            if p.skip_errors:
                p.project(part).write.format("noop").mode("overwrite").save()
            if p.subscriber is not None:
                p.subscriber(part, batch)
            return []
        except Exception as why:
            if not p.skip_errors:
                raise
            if low == high:
                return [{"sequence": low, "kind": type(why).__name__, "message": str(why)[:500]}]
        middle = (low + high) // 2
        out = []
        for a, b in ((low, middle), (middle + 1, high)):
            if not df.where((F.col("seq_id") >= a) & (F.col("seq_id") <= b)).isEmpty():
                out += self._attempt(p, df, batch, a, b)
        return out

    def _entries(self, name: str) -> list[dict]:
        return [json.loads(self.files.read(f"{name}/_batches/{n}")) for n in self.files.names(f"{name}/_batches")]

    def _letters(self, name: str) -> list[str]:
        return [e["letters"] for e in self._entries(name) if e["letters"]]

    def _dead(self, letters: list[str]) -> DataFrame:
        if not letters:
            return self.spark.createDataFrame([], LETTERS)
        return self.spark.read.schema(LETTERS).option("recursiveFileLookup", "true").parquet(*[f"{self.root}/{x}" for x in letters])

    @staticmethod
    def _alive(rows: DataFrame, dead: DataFrame) -> DataFrame:
        return rows.join(dead.select(F.col("sequence").alias("_dead")), F.col("seq_id") == F.col("_dead"), "left_anti")

    def _inputs(self, p: Projection, paths: list[str]) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(*[f"{self.root}/{x}" for x in paths]) if paths else self.spark.createDataFrame([], self.schema)

    def progress(self, name: str) -> int:
        """The highest sequence that a projection has taken in."""
        return max((e["last_sequence"] for e in self._entries(name)), default=0)

    def progress_of_all(self) -> dict[str, int]:
        """Every projection's progress, and the log's high-water mark as ``HighWaterMark``."""
        names = [n for n in self.files.names("") if self.files.names(f"{n}/_batches")]
        return {n: self.progress(n) for n in names} | {"HighWaterMark": self.high_water()}

    def high_water(self) -> int:
        """The highest sequence up to which every event is there to be read: a store's commits are whole, so it is the last one's."""
        if isinstance(self.events, Store):
            return self.events.snapshot().last_sequence()
        return self._log().agg(F.max("seq_id")).first()[0] or 0

    def dead_letters(self, name: str) -> DataFrame:
        """(projection, sequence, kind, message): one row for each event that couldn't be taken in."""
        return self._dead(self._letters(name))

    def result(self, p: Projection) -> DataFrame:
        """The projected table as of the committed batches."""
        if p.storage is not None:
            return p.storage.read()
        entries = self._entries(p.name)
        if p.key is None or not entries:
            return p.project(self._alive(self._sound(p, self._inputs(p, [e["input"] for e in entries])), self.dead_letters(p.name)))
        rows = self.spark.read.option("mergeSchema", "true").parquet(*[f"{self.root}/{e['rows']}" for e in entries])
        newest = rows.groupBy(F.col(p.key).alias("_key")).agg(F.max("_batch").alias("_newest"))
        latest = rows.join(newest, (F.col(p.key) == F.col("_key")) & (F.col("_batch") == F.col("_newest")))
        return latest.where("not _gone").drop("_gone", "_batch", "_key", "_newest")

    def rebuild(self, p: Projection) -> None:
        """Forgets all progress and output, and replays; more than ``rebuilds`` at once are refused."""
        if self._rebuilding >= self.rebuilds:
            raise QueryNotSupported(f"more than {self.rebuilds} rebuilds at once")
        self._rebuilding += 1
        try:
            self.files.delete(p.name)
            self.run(p)
        finally:
            self._rebuilding -= 1

    def rewind(self, p: Projection, sequence: int) -> Projection:
        """The projection as one that begins after ``sequence``, replayed from there."""
        begun = replace(p, start=sequence)
        self.rebuild(begun)
        return begun

    def lag(self, name: str) -> int:
        """How far a projection is behind the log."""
        return self.high_water() - self.progress(name)

    def wait(self, names: list[str], seconds: float = 0.0, every: float = 0.05) -> None:
        """Until the projections have taken in all that is committed now; an error that names those that haven't in time."""
        top, until = self.high_water(), time.monotonic() + seconds
        while stale := [n for n in names if self.progress(n) < top]:
            if time.monotonic() >= until:
                raise TimeoutError(f"behind the log: {', '.join(stale)}")
            time.sleep(every)


def counts(spark: SparkSession, events: str, schema: str, out: str, checkpoint: str, key: str = "type", window: str = "1 hour", late: str = "1 day") -> Any:
    """Windowed counts with a watermark: the plain streaming aggregation, as a started query over what is there."""
    if key not in ("type", "stream_id"):
        raise QueryNotSupported(f"windowed counts by {key}")
    stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(events)
    rows = stream.withWatermark("timestamp", late).groupBy(F.window("timestamp", window), key).agg(F.count(F.lit(1)).alias("n"))
    flat = rows.select(F.col("window.start").alias("start"), key, "n")
    return flat.writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
