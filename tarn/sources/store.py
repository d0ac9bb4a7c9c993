"""A store of documents and events over plain Parquet, without a table format.

A table is a folder of immutable segments; ``_commits/<n>.json`` lists the segments that commit n added or took away
and what it claimed. A commit reads the latest number, checks its guards against that state, writes its segments and creates the
next manifest exclusively: of two writers that saw the same state one loses, and starts again from the check. Readers
pin a commit number, so they see a snapshot. The current document of a key is the one of the highest (commit, place);
a tombstone ends it. Event sequences are given by the committer: contiguous, never used twice. What a writer left
behind without a manifest is in no snapshot, and nothing but snapshots reads events.

Rewriting (masking, overwriting, deleting, erasing a stream, merging segments) replaces the segments that it touches in
one commit and deletes the old ones, so that what was masked or erased isn't on disk any more; snapshots of commits
before a rewrite can't be read from then on.

All files are written and listed through Hadoop's file systems, so a path may lie in any store that Spark reads. The
exclusive create needs one that refuses to create a file that is there (HDFS and local disks do).
"""

from __future__ import annotations

import json
import random
import re
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import datetime, timezone
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import BoundaryConflict, ConcurrencyConflict, QueryNotSupported, StreamExists
from ..mapping import Mapping
from ..operators.eventlog import EventLog, TagCondition, mask, overwrite
from ..operators.fold import Fold
from ..operators.pages import page as page_of
from ..operators.query import Query
from ..scratch import scratch_root

EVENTS = "seq_id long, stream_id string, version long, type string, timestamp timestamp_ntz, tenant_id string, data string, headers string, data_binary binary"
TAGS = "tag string, value string, seq_id long"
NATURAL = "name string, value string, stream_id string"
SYSTEM = "_commit long, _place int, _gone boolean, is_deleted boolean, deleted_at timestamp_ntz, last_modified timestamp_ntz, revision long, tenant_id string"
RETRIES, FIRST_WAIT = 5, 0.05
#: Tables besides the document types.
OWN = {"events": EVENTS, "tags": TAGS, "natural_keys": NATURAL}


def event_alias(name: str | type) -> str:
    """The stored name of an event type: QuestStarted as quest_started; a name in small letters stays."""
    name = name if isinstance(name, str) else name.__name__
    return re.sub(r"(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])", "_", name).lower()


def sequential_uuid() -> str:
    """A key that sorts by the time it was made in: 48 bits of milliseconds, then chance (UUID version 7)."""
    chance = uuid.uuid4().int
    value = int(time.time() * 1000) << 80 | 7 << 76 | (chance >> 64 & 0xFFF) << 64 | 2 << 62 | chance & ((1 << 62) - 1)
    return str(uuid.UUID(int=value))


class Files:
    """The little that commits need from a file system."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self.fs = self._path(root).getFileSystem(spark._jsc.hadoopConfiguration())

    def names(self, folder: str) -> list[str]:
        path = self._path(f"{self.root}/{folder}")
        return sorted(s.getPath().getName() for s in self.fs.listStatus(path)) if self.fs.exists(path) else []

    def create(self, name: str, text: str) -> bool:
        """Whether this call created the file; False if it is there already."""
        path = self._path(f"{self.root}/{name}")
        self.fs.mkdirs(path.getParent())
        try:
            out = self.fs.create(path, False)
        except Exception as why:
            if self.fs.exists(path):
                return False
            raise why
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()
        return True

    def read(self, name: str) -> str:
        stream = self.fs.open(self._path(f"{self.root}/{name}"))
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def move(self, name: str, to: str) -> None:
        target = self._path(f"{self.root}/{to}")
        self.fs.mkdirs(target.getParent())
        self.fs.rename(self._path(f"{self.root}/{name}"), target)

    def delete(self, name: str) -> None:
        self.fs.delete(self._path(f"{self.root}/{name}"), True)


@dataclass
class Pending:
    """What a session has to commit."""

    documents: list[tuple[str, str, Any, dict | None, dict]] = field(default_factory=list)  # (type, action, key, row, options with the tenant)
    streams: list[tuple[str, list[tuple[str, dict]], dict]] = field(default_factory=list)
    #: Changes of all rows that a predicate meets: (type, tenant, rows that change, what becomes of them).
    wide: list[tuple[str, str, Callable[[DataFrame], DataFrame], Callable[[DataFrame], DataFrame]]] = field(default_factory=list)
    guards: list[Callable[[Snapshot], None]] = field(default_factory=list)


class Store:
    """A root folder, the document types in it, and listeners of commits."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.files = spark, Files(spark, root)
        self.types: dict[str, tuple[Mapping, T.StructType]] = {}
        self.inline: list[Callable[[Session, list[dict]], None]] = []
        self.before: list[Callable[[Session], None]] = []
        self.after: list[Callable[[dict], None]] = []
        #: Takes the messages of a session, once, when its commit is durable; by default they are dropped.
        self.outbox: Callable[[list], None] = lambda messages: None
        #: Event types whose bodies are bytes: their encoders.
        self.binary: dict[str, Callable[[dict], bytes]] = {}
        #: Aggregates as they were last read for writing, by (fold, stream): a version and its state, from which later events are folded.
        self.aggregates: dict[tuple[int, str], tuple[int, dict]] | None = None
        self._manifests: dict[int, dict] = {}

    def manifest(self, number: int) -> dict:
        """What a commit did. Manifests never change, so each is read once."""
        if number not in self._manifests:
            self._manifests[number] = json.loads(self.files.read(f"_commits/{number:012d}.json"))
        return self._manifests[number]

    def register(self, name: str, key: str, schema: str, soft_delete: bool = False, tenanted: bool = False) -> Store:
        fields = T._parse_datatype_string(schema)
        mapping = Mapping(key, tenant="tenant_id" if tenanted else None, deleted="is_deleted" if soft_delete else None, deleted_at="deleted_at" if soft_delete else None, modified="last_modified")
        self.types[name] = (mapping, fields)
        return self

    def head(self) -> int:
        names = self.files.names("_commits")
        return int(names[-1].split(".")[0]) if names else 0

    def snapshot(self, commit: int | None = None) -> Snapshot:
        return Snapshot(self, self.head() if commit is None else commit)

    def session(self, tenant: str | None = None, tracking: str = "none") -> Session:
        return Session(self, tenant, tracking)

    def seed(self, *steps: Callable[[Session], None]) -> bool:
        """Initial data: runs the steps in one session if nothing was ever committed."""
        if self.head():
            return False
        session = self.session()
        for step in steps:
            step(session)
        session.save()
        return True

    def clean(self, *tables: str) -> int:
        """Empties types (all of them by default) or ``events``; sequences go on where they were."""
        tables = tables or tuple(self.types)
        if "events" in tables:
            tables = (*tables, "tags")
        for _ in range(RETRIES + 1):
            base = self.snapshot()
            manifest = {"commit": base.commit + 1, "segments": [], "last_sequence": base.last_sequence(), "cleaned": [*tables, *(["natural_keys"] if "events" in tables else [])]}
            if self.files.create(f"_commits/{base.commit + 1:012d}.json", json.dumps(manifest)):
                return base.commit + 1
        raise ConcurrencyConflict("other writers won every attempt")

    def ddl(self) -> str:
        """The tables as statements."""
        every = {name: fields for name, (_, fields) in self.types.items()} | {"events": T._parse_datatype_string(EVENTS), "tags": T._parse_datatype_string(TAGS)}
        lines = lambda fields: ",\n".join(f"  {f.name} {f.dataType.simpleString()}" for f in fields)
        return "\n".join(f"CREATE TABLE {name} (\n{lines(fields)}\n) USING parquet;" for name, fields in every.items())

    # Rewriting.
    def rewrite(self, name: str, touched: Callable[[DataFrame], DataFrame] | None, change: Callable[[DataFrame], DataFrame], **claims: Any) -> int:
        """Replaces the segments of table ``name`` that hold rows of ``touched`` (all of them without it) by ``change`` of their rows, in one commit."""
        for attempt in range(RETRIES + 1):
            base = self.snapshot()
            rows = base.table(name)
            held = base.segments(name)
            old = held
            if touched is not None:
                named = rows.withColumn("_segment", F.regexp_extract(F.input_file_name(), r"([^/]+/[^/]+)/[^/]+$", 1))
                hit = {r[0] for r in touched(named).select("_segment").distinct().collect()}
                old = [s for s in held if s in hit]
            if not old and not claims:
                return base.commit
            number, new = base.commit + 1, []
            if old:
                path = f"{name}/{uuid.uuid4().hex}"
                change(base.table(name, old)).write.parquet(f"{self.files.root}/{path}")
                new = [(name, path)]
            manifest = {"commit": number, "segments": new, "removed": old, "last_sequence": base.last_sequence(), **claims}
            if self.files.create(f"_commits/{number:012d}.json", json.dumps(manifest)):
                for path in old:
                    self.files.delete(path)
                return number
            for _, path in new:
                self.files.delete(path)
            time.sleep(FIRST_WAIT * 2**attempt * (0.5 + random.random()))
        raise ConcurrencyConflict("other writers won every attempt")

    def mask_events(self, rules: dict[str, dict[str, Column]], within: Column | None = None) -> int:
        """Personal data replaced for good in the events of the rules' types (that ``within`` meets)."""
        hit = F.col("type").isin(*rules) if within is None else F.col("type").isin(*rules) & within
        return self.rewrite("events", lambda df: df.where(hit), lambda df: mask(df, rules, within))

    def overwrite_events(self, changes: DataFrame) -> int:
        """New bodies for the events that ``changes`` (seq_id, columns) names."""
        return self.rewrite("events", lambda df: df.join(changes.select("seq_id"), "seq_id", "left_semi"), lambda df: overwrite(df, changes))

    def delete_events(self, seq_ids: DataFrame) -> int:
        return self.rewrite("events", lambda df: df.join(seq_ids.select("seq_id"), "seq_id", "left_semi"), lambda df: df.join(seq_ids.select("seq_id"), "seq_id", "left_anti"))

    def erase(self, *streams: str) -> int:
        """Streams tombstoned for good: their events are no longer on disk, their versions begin anew."""
        mine = F.col("stream_id").isin(*streams)
        return self.rewrite("events", lambda df: df.where(mine), lambda df: df.where(~mine), tombstoned=list(streams))

    def compact_stream(self, fold: Fold, stream: str, to: int | None = None) -> int:
        """One event of type ``_compacted``, whose body is the state, in place of a stream's events up to ``to`` (all)."""
        mine = (F.col("stream_id") == stream) & (F.col("version") <= (1 << 62 if to is None else to))

        def change(df: DataFrame) -> DataFrame:
            old = df.where(mine)
            state = fold.project(old)
            body = F.to_json(F.struct(*[c for c in state.columns if c not in ("stream_id", "version")]))
            last = old.groupBy("stream_id").agg(F.max_by(F.struct(*old.columns), "version").alias("e"))
            row = last.join(state.select("stream_id", body.alias("_body")), "stream_id").select(*[(F.col("_body") if c == "data" else F.lit("_compacted") if c == "type" else F.col(f"e.{c}")).alias(c) for c in old.columns])
            return df.where(~mine).unionByName(row)

        return self.rewrite("events", lambda df: df.where(mine), change)

    def merge(self, name: str) -> int:
        """One segment in place of all, so that many small commits don't stay many small files."""
        return self.rewrite(name, None, lambda df: df)


class Snapshot:
    """The store as of a commit."""

    def __init__(self, store: Store, commit: int):
        self.store, self.commit = store, commit
        self._manifests: list[dict] | None = None

    @property
    def manifests(self) -> list[dict]:
        if self._manifests is None:
            numbers = [int(n.split(".")[0]) for n in self.store.files.names("_commits")]
            self._manifests = [self.store.manifest(n) for n in numbers if n <= self.commit]
        return self._manifests

    def segments(self, name: str) -> list[str]:
        cleaned = max((m["commit"] for m in self.manifests if name in m.get("cleaned", [])), default=0)
        removed = {s for m in self.manifests for s in m.get("removed", [])}
        return [s for m in self.manifests if m["commit"] > cleaned for t, s in m["segments"] if t == name and s not in removed]

    def schema(self, name: str) -> T.StructType:
        if name in OWN:
            return T._parse_datatype_string(OWN[name])
        _, fields = self.store.types[name]
        return T.StructType([*fields.fields, *[f for f in T._parse_datatype_string(SYSTEM).fields if f.name not in fields.names]])

    def table(self, name: str, segments: list[str] | None = None) -> DataFrame:
        """All rows of a type, or of ``events``, ``tags`` or ``natural_keys``, in the given segments (all of them)."""
        paths = [f"{self.store.files.root}/{s}" for s in (self.segments(name) if segments is None else segments)]
        return self.store.spark.read.schema(self.schema(name)).parquet(*paths) if paths else self.store.spark.createDataFrame([], self.schema(name))

    def versions(self, name: str) -> DataFrame:
        """Every row that was ever written for a type."""
        return self.table(name)

    def documents(self, name: str, rows: DataFrame | None = None) -> DataFrame:
        """Current rows of a type (of the given versions), soft-deleted ones too. The latest of a key is an aggregate, so hot keys combine early."""
        mapping, _ = self.store.types[name]
        rows = self.versions(name) if rows is None else rows
        keys = [mapping.key] + (["tenant_id"] if mapping.tenant else [])
        latest = rows.groupBy(*keys).agg(F.max_by(F.struct(*rows.columns), F.struct("_commit", "_place")).alias("_row"))
        return latest.select("_row.*").where("not _gone")

    def query(self, name: str, tenant: str | None = None) -> Query:
        return Query(self.documents(name), self.store.types[name][0], tenant)

    def census(self) -> DataFrame:
        """(type, documents, deleted) of every registered type."""
        rows = [self.documents(name).agg(F.lit(name).alias("type"), F.count(F.lit(1)).alias("documents"), F.count_if("is_deleted").alias("deleted")) for name in sorted(self.store.types)]
        out = self.store.spark.createDataFrame([], "type string, documents long, deleted long")
        for one in rows:
            out = out.unionByName(one)
        return out

    def browse(self, of: str, page: int = 1, size: int = 50, tenant: str | None = None, **columns: Any) -> DataFrame:
        """A page of a type's documents by key, of all tenants or one, whose columns have the given values, as (key, tenant_id, revision, json)."""
        mapping, fields = self.store.types[of]
        df = self.documents(of)
        if tenant is not None:
            df = df.where(F.col("tenant_id") == tenant)
        for column, value in columns.items():
            df = df.where(F.col(column) == F.lit(value))
        body = F.to_json(F.struct(*fields.names), {"ignoreNullFields": "false"})
        df = df.select(F.col(mapping.key).alias("key"), "tenant_id", "revision", body.alias("json")).orderBy("key", "tenant_id")
        return page_of(df, (page - 1) * size, size)

    def events(self) -> DataFrame:
        return self.table("events")

    def log(self) -> EventLog:
        """The events that no tombstone hides, with their archived flag. Streams of either kind are joined, however many."""
        flags: dict[str, bool] = {}
        for m in self.manifests:
            flags |= {s: True for s in m.get("archived", [])} | {s: False for s in m.get("restored", [])}
        before = {s: max(m["last_sequence"] for m in self.manifests if s in m.get("tombstoned", [])) for s in {s for m in self.manifests for s in m.get("tombstoned", [])}}
        frame = lambda rows, schema: self.store.spark.createDataFrame(rows, schema)
        df = self.events()
        if before:
            dead = frame(list(before.items()), "_dead string, _until long")
            df = df.join(dead, (F.col("stream_id") == F.col("_dead")) & (F.col("seq_id") <= F.col("_until")), "left_anti")
        hidden = [(s,) for s, on in flags.items() if on]
        flag = F.lit(False)
        if hidden:
            df = df.join(frame(hidden, "_hidden string"), F.col("stream_id") == F.col("_hidden"), "left")
            flag = F.col("_hidden").isNotNull()
        return EventLog(df.withColumn("is_archived", flag).drop("_hidden"), frozenset(self.store.binary), self.last_sequence())

    def tags(self) -> dict[str, DataFrame]:
        rows = self.table("tags")
        names = {n for m in self.manifests for n in m.get("tag_names", [])}
        return {n: rows.where(F.col("tag") == n).select("value", "seq_id") for n in names}

    def last_sequence(self) -> int:
        return max((m["last_sequence"] for m in self.manifests), default=0)

    def stream_versions(self, streams: list[str]) -> dict[str, int]:
        """Versions of the given streams; manifests keep those of the streams they wrote."""
        wanted, out = set(streams), {}
        for m in self.manifests:
            out |= {s: v for s, v in m.get("streams", {}).items() if s in wanted}
            for s in m.get("tombstoned", []):
                out.pop(s, None)  # a session that appends to a stream and tombstones it ends it
            if "events" in m.get("cleaned", []):
                out = {}
        if wanted and any(m.get("bulk") for m in self.manifests):
            # A bulk commit's manifest doesn't list its streams.
            found = self.log().events.where(F.col("stream_id").isin(*wanted)).groupBy("stream_id").agg(F.max("version").alias("v")).collect()
            out |= {r["stream_id"]: max(r["v"], out.get(r["stream_id"], 0)) for r in found}
        return out

    def aggregate(self, fold: Fold, stream: str, version: int | None = None, timestamp: Any = None) -> DataFrame:
        return fold.project(self.log().fetch_stream(stream, version, timestamp))


class Session:
    """A unit of work: changes wait until ``save``, which commits all of them or none."""

    def __init__(self, store: Store, tenant: str | None = None, tracking: str = "none"):
        if tracking not in ("none", "identity", "dirty"):
            raise QueryNotSupported(f"tracking by {tracking}")
        self.store, self.tenant, self.pending, self.tracking = store, tenant, Pending(), tracking
        self.messages: list = []
        self.loaded: dict[tuple[str, Any], tuple[dict | None, str]] = {}
        self.archived: list[str] = []
        self.restored: list[str] = []
        self.tombstoned: list[str] = []
        self.correlation: dict[str, str] = {}

    def query(self, name: str) -> Query:
        return self.store.snapshot().query(name, self.tenant)

    def for_tenant(self, tenant: str) -> Session:
        """A scope of another tenant that shares this session's commit."""
        scope = Session(self.store, tenant)
        scope.pending, scope.correlation = self.pending, self.correlation
        return scope

    def load(self, name: str, key: Any) -> dict | None:
        """A document as a dict. With tracking the same object each time; with dirty tracking its changes are saved."""
        if self.tracking != "none" and (name, key) in self.loaded:
            return self.loaded[name, key][0]
        rows = self.query(name).load(key).collect()
        fields = self.store.types[name][1].names
        found = {k: v for k, v in rows[0].asDict(recursive=True).items() if k in fields} if rows else None
        if self.tracking != "none":
            self.loaded[name, key] = (found, json.dumps(found, default=str, sort_keys=True))
        return found

    def run(self, plan: Callable[[Session], Any]) -> Any:
        """What a reusable query, a function of the session, finds: rows of a frame, else its value."""
        got = plan(self)
        got = got.to_df() if isinstance(got, Query) else got
        return got.collect() if isinstance(got, DataFrame) else got

    def batch(self) -> Batch:
        return Batch(self.store.snapshot(), self.tenant)

    def publish(self, message: Any) -> Session:
        self.messages.append(message)
        return self

    # Documents.
    def store_(self, name: str, row: dict, revision: int = 0) -> Session:
        """Insert or replace; a revision must be greater than the stored one, 0 takes the next."""
        return self._put(name, "store", row, revision=revision)

    def insert(self, name: str, row: dict) -> Session:
        return self._put(name, "insert", row)

    def update(self, name: str, row: dict, expected: int | None = None) -> Session:
        return self._put(name, "update", row, expected=expected)

    def _put(self, name: str, action: str, row: dict, **options: Any) -> Session:
        mapping, _ = self.store.types[name]
        row = dict(row)
        row.setdefault(mapping.key, sequential_uuid())
        self.pending.documents.append((name, action, row[mapping.key], row, {**options, "tenant": self.tenant or ""}))
        return self

    def delete(self, name: str, key: Any, hard: bool = False) -> Session:
        self.pending.documents.append((name, "hard" if hard else "delete", key, None, {"tenant": self.tenant or ""}))
        return self

    def undelete(self, name: str, key: Any) -> Session:
        self.pending.documents.append((name, "undelete", key, None, {"tenant": self.tenant or ""}))
        return self

    def eject(self, name: str, *keys: Any) -> Session:
        """Takes back what is pending for some documents of this session's tenant, of a whole type without a key."""
        mine = lambda d: d[0] == name and (not keys or d[2] in keys) and d[4]["tenant"] == (self.tenant or "")
        self.pending.documents[:] = [d for d in self.pending.documents if not mine(d)]
        return self

    # Documents by predicate: one plan over the type in the session's commit.
    def delete_where(self, name: str, predicate: Callable, hard: bool = False) -> Session:
        """Deletes what a query with this predicate finds; types without soft deletion lose their rows."""
        mapping, _ = self.store.types[name]
        if hard or not mapping.deleted:
            return self._wide(name, predicate, lambda df: df.withColumn("_gone", F.lit(True)))
        return self._wide(name, predicate, lambda df: df.withColumns({"is_deleted": F.lit(True), "deleted_at": F.localtimestamp()}))

    def undo_delete_where(self, name: str, predicate: Callable) -> Session:
        if not self.store.types[name][0].deleted:
            raise QueryNotSupported(f"{name} is not soft-deleted")
        return self._wide(name, predicate, lambda df: df.withColumns({"is_deleted": F.lit(False), "deleted_at": F.lit(None).cast("timestamp_ntz")}), lambda q: q.is_deleted())

    def patch_where(self, name: str, predicate: Callable, change: Callable[[DataFrame], DataFrame]) -> Session:
        """``change`` (a patch's ``apply``, say) of all documents that a query with this predicate finds."""
        return self._wide(name, predicate, change)

    def _wide(self, name: str, predicate: Callable, change: Callable[[DataFrame], DataFrame], scope: Callable[[Query], Query] = lambda q: q) -> Session:
        mapping, _ = self.store.types[name]
        pick = lambda df: scope(Query(df, mapping, self.tenant)).where(predicate).to_df()
        self.pending.wide.append((name, self.tenant or "", pick, change))
        return self

    # Events.
    def start_stream(self, stream: str, *events: tuple[str, dict]) -> Session:
        self.pending.streams.append((stream, list(events), {"new": True, "tenant": self.tenant or ""}))
        return self

    def append(self, stream: str, *events: tuple[str, dict], expected: int | None = None) -> Session:
        """expected: the version that the stream must have after these events."""
        self.pending.streams.append((stream, list(events), {"expected": expected, "tenant": self.tenant or ""}))
        return self

    def append_optimistic(self, stream: str, *events: tuple[str, dict]) -> Session:
        """Fails if anyone appends to the stream between now and the commit."""
        now = self.store.snapshot().stream_versions([stream]).get(stream, 0)
        return self.append(stream, *events, expected=now + len(events))

    def fetch_for_writing(self, fold: Fold, stream: str) -> Handle:
        """The aggregate of a stream and its version; what is appended through the handle needs that version still."""
        snap = self.store.snapshot()
        version = snap.stream_versions([stream]).get(stream, 0)
        known = self.store.aggregates
        at, state = (known or {}).get((id(fold), stream), (0, None))
        if state is None or at > version:
            rows = snap.aggregate(fold, stream).collect() if version else []
        elif at == version:
            return Handle(self, stream, version, dict(state))
        else:
            later = snap.log().fetch_stream(stream, from_version=at + 1)
            start = self.store.spark.createDataFrame([tuple(state[k] for k in ("stream_id", *fold.fields))], f"stream_id string, {', '.join(f'{k} {t}' for k, (t, _) in fold.fields.items())}")
            rows = fold.project(later, start=start).collect()
        got = rows[0].asDict(recursive=True) if rows else None
        if known is not None and got is not None:
            known[id(fold), stream] = (version, dict(got))
        return Handle(self, stream, version, got)

    def write_to(self, fold: Fold, stream: str, decide: Callable[[dict | None], list[tuple[str, dict]]]) -> int:
        """Decides on events by the aggregate, appends and saves; a conflict is the caller's."""
        handle = self.fetch_for_writing(fold, stream)
        handle.append(*decide(handle.aggregate))
        return self.save()

    def fetch_latest(self, fold: Fold, stream: str, document: str | None = None) -> dict | None:
        """The projected document of a stream where it is kept as one, else the fold."""
        if document is not None:
            return self.load(document, stream)
        return self.fetch_for_writing(fold, stream).aggregate

    def project_latest(self, fold: Fold, stream: str) -> dict | None:
        """The fold of what is committed and what this session has pending."""
        snap = self.store.snapshot()
        have = snap.stream_versions([stream]).get(stream, 0)
        rows = []
        for name, events, _ in self.pending.streams:
            for kind, body in events if name == stream else ():
                have += 1
                rows.append((None, stream, have, kind, None, self.tenant or "", json.dumps({k: v for k, v in body.items() if k[0] != "_"}), None, None))
        both = snap.log().fetch_stream(stream).drop("is_archived")
        if rows:
            both = both.unionByName(self.store.spark.createDataFrame(rows, EVENTS))
        got = fold.project(both).collect()
        return got[0].asDict(recursive=True) if got else None

    def archive(self, stream: str) -> Session:
        self.archived.append(stream)
        return self

    def unarchive(self, stream: str) -> Session:
        self.restored.append(stream)
        return self

    def tombstone(self, stream: str) -> Session:
        self.tombstoned.append(stream)
        return self

    def fetch_by_tags(self, conditions: list[TagCondition]) -> DataFrame:
        """Events of a tag query; the commit fails if more of them came meanwhile, also where there was none."""
        seen = self.store.snapshot()
        last = seen.last_sequence()

        def guard(now: Snapshot) -> None:
            if now.last_sequence() > last and not now.log().by_tags(conditions, now.tags() | self._no_tags(conditions, now)).where(F.col("seq_id") > last).isEmpty():
                raise BoundaryConflict("events of this boundary were appended meanwhile")

        self.pending.guards.append(guard)
        return seen.log().by_tags(conditions, seen.tags() | self._no_tags(conditions, seen))

    def _no_tags(self, conditions: list[TagCondition], at: Snapshot) -> dict[str, DataFrame]:
        known = at.tags()
        empty = self.store.spark.createDataFrame([], "value string, seq_id long")
        return {c.tag: empty for c in conditions if c.tag not in known}

    # The commit.
    def save(self) -> int:
        """The commit's number. A lost race starts again from the guards, some times, with growing waits."""
        for (name, key), (now, before) in self.loaded.items() if self.tracking == "dirty" else ():
            if now is not None and json.dumps(now, default=str, sort_keys=True) != before:
                self.update(name, now)
        p = self.pending
        if not (p.documents or p.streams or p.wide or self.archived or self.restored or self.tombstoned):
            return self.store.head()
        for hook in self.store.before:
            hook(self)
        documents = list(p.documents)
        for attempt in range(RETRIES + 1):
            try:
                number = self._try()
            finally:
                # What inline projections added belongs to this attempt alone.
                p.documents[:] = documents
            if number is not None:
                sent, self.messages, self.loaded = self.messages, [], {}
                for waiting in (p.documents, p.streams, p.wide, p.guards):
                    waiting.clear()
                self.archived, self.restored, self.tombstoned = [], [], []
                self.store.outbox(sent)
                return number
            time.sleep(FIRST_WAIT * 2**attempt * (0.5 + random.random()))
        raise ConcurrencyConflict("other writers won every attempt")

    def _try(self) -> int | None:
        store, now = self.store, datetime.now(timezone.utc).replace(tzinfo=None)
        base = store.snapshot()
        for guard in self.pending.guards:
            guard(base)
        number = base.commit + 1
        versions = base.stream_versions([s for s, *_ in self.pending.streams])
        rows, tags, keys, sequence = [], [], [], base.last_sequence()
        for stream, events, options in self.pending.streams:
            have = versions.get(stream, 0)
            if options.get("new") and have:
                raise StreamExists(f"stream {stream} exists")
            if options.get("expected") is not None and have + len(events) != options["expected"]:
                raise ConcurrencyConflict(f"stream {stream} is at version {have}, not {options['expected'] - len(events)}")
            for kind, body in events:
                kind = event_alias(kind)
                sequence, have = sequence + 1, have + 1
                body = dict(body)
                own, named = body.pop("_tags", {}), body.pop("_keys", {})
                headers = {**self.correlation, **body.pop("_headers", {})}
                rows.append({"seq_id": sequence, "stream_id": stream, "version": have, "type": kind, "timestamp": now, "tenant_id": options["tenant"], "data": "{}" if kind in store.binary else json.dumps(body), "headers": json.dumps(headers), "data_binary": store.binary[kind](body) if kind in store.binary else None})
                tags += [{"tag": t, "value": str(v), "seq_id": sequence} for t, v in own.items()]
                keys += [{"name": k, "value": str(v), "stream_id": stream} for k, v in named.items()]
            versions[stream] = have
        if keys:
            keys = self._claim(base, keys)
        if rows:
            for projection in store.inline:
                projection(self, rows)
        by_type: dict[str, list[dict]] = {}
        there = self._there(base)
        for place, (name, action, key, row, options) in enumerate(self.pending.documents):
            made = self._document(there, name, action, key, row, options, by_type.get(name, []), number, place, now)
            if made is not None:
                by_type.setdefault(name, []).append(made)
        segments = []
        for name, made in [*by_type.items(), ("events", rows), ("tags", tags), ("natural_keys", keys)]:
            if made:
                segments.append((name, self._segment(name, made, base.schema(name))))
        for place, (name, _, pick, change) in enumerate(self.pending.wide):
            # Later changes of a session see the earlier ones by their place, not by their rows: each is of the base.
            path = f"{name}/{uuid.uuid4().hex}"
            new = change(pick(base.documents(name))).withColumns({"_commit": F.lit(number).cast("long"), "_place": F.lit(len(self.pending.documents) + place), "last_modified": F.lit(now).cast("timestamp_ntz"), "revision": F.col("revision") + 1})
            new.select(*base.schema(name).names).write.parquet(f"{store.files.root}/{path}")
            segments.append((name, path))
        manifest = {"commit": number, "segments": segments, "last_sequence": sequence, "streams": {s: versions[s] for s, *_ in self.pending.streams}, "tag_names": sorted({t["tag"] for t in tags}), "archived": self.archived, "restored": self.restored, "tombstoned": self.tombstoned, "at": now.isoformat()}
        if not store.files.create(f"_commits/{number:012d}.json", json.dumps(manifest)):
            for _, path in segments:
                store.files.delete(path)
            return None
        for done in store.after:
            done(manifest)
        return number

    def _claim(self, base: Snapshot, keys: list[dict]) -> list[dict]:
        """The natural keys that are new; one that belongs to another live stream is a conflict."""
        wanted = {(k["name"], k["value"]): k["stream_id"] for k in keys}
        if any(wanted[k["name"], k["value"]] != k["stream_id"] for k in keys):
            raise ConcurrencyConflict("two streams claim a natural key")
        asked = self.store.spark.createDataFrame([(n, v) for n, v in wanted], "name string, value string")
        held = {(r.name, r.value): r.stream_id for r in base.table("natural_keys").join(asked, ["name", "value"]).collect()}
        live = base.stream_versions(list(held.values()))
        for key, stream in wanted.items():
            if held.get(key, stream) != stream and held[key] in live:
                raise ConcurrencyConflict(f"{key[0]} {key[1]} belongs to stream {held[key]}")
        return [{"name": n, "value": v, "stream_id": stream} for (n, v), stream in wanted.items() if held.get((n, v)) != stream]

    def _there(self, base: Snapshot) -> dict[tuple[str, str, Any], dict]:
        """Current rows of all pending documents, by (type, tenant, key): one join for each type."""
        out: dict[tuple[str, str, Any], dict] = {}
        for name in {d[0] for d in self.pending.documents}:
            mapping, fields = self.store.types[name]
            keys = [(d[2],) for d in {(d[2]): d for d in self.pending.documents if d[0] == name}.values()]
            asked = self.store.spark.createDataFrame(keys, T.StructType([T.StructField("_asked", fields[mapping.key].dataType)]))
            versions = base.versions(name).join(F.broadcast(asked) if len(keys) < 100_000 else asked, F.col(mapping.key) == F.col("_asked"), "left_semi")
            for r in base.documents(name, versions).collect():
                out[name, r["tenant_id"] if mapping.tenant else "", r[mapping.key]] = r.asDict(recursive=True)
        return out

    def _segment(self, name: str, rows: list[dict], schema: T.StructType) -> str:
        path = f"{name}/{uuid.uuid4().hex}"
        values = [tuple(r.get(f.name) for f in schema.fields) for r in rows]
        self.store.spark.createDataFrame(values, schema).coalesce(1).write.parquet(f"{self.store.files.root}/{path}")
        return path

    def _document(self, there: dict, name: str, action: str, key: Any, row: dict | None, options: dict, earlier: list[dict], number: int, place: int, now: datetime) -> dict | None:
        mapping, _ = self.store.types[name]
        mine = [r for r in earlier if r[mapping.key] == key and (not mapping.tenant or r["tenant_id"] == options["tenant"])]
        if mine:
            have = mine[-1] if not mine[-1]["_gone"] else None
        else:
            have = there.get((name, options["tenant"] if mapping.tenant else "", key))
        system = {"_commit": number, "_place": place, "_gone": False, "is_deleted": False, "deleted_at": None, "last_modified": now, "revision": (have["revision"] if have else 0) + 1, "tenant_id": options["tenant"]}
        if action in ("store", "insert", "update"):
            if action == "insert" and have is not None:
                raise ConcurrencyConflict(f"{name} {key} exists")
            if action == "update" and have is None:
                raise ConcurrencyConflict(f"there is no {name} {key}")
            if options.get("expected") is not None and have["revision"] != options["expected"]:
                raise ConcurrencyConflict(f"{name} {key} is at revision {have['revision']}, not {options['expected']}")
            if options.get("revision"):
                if have is not None and options["revision"] <= have["revision"]:
                    raise ConcurrencyConflict(f"{name} {key} is at revision {have['revision']} already")
                system["revision"] = options["revision"]
            return {**row, **system}
        if have is None:
            return None
        if action == "delete" and mapping.deleted:
            return {**have, **system, "is_deleted": True, "deleted_at": now} if not have["is_deleted"] else None
        if action == "undelete":
            return {**have, **system} if have["is_deleted"] else None
        return {**have, **system, "_gone": True}


@dataclass
class Handle:
    """A stream as it was read for writing."""

    session: Session
    stream: str
    version: int
    aggregate: dict | None

    def append(self, *events: tuple[str, dict]) -> None:
        self.session.append(self.stream, *events, expected=self.version + len(events))
        self.version += len(events)


class Batch:
    """Several reads of one snapshot."""

    def __init__(self, snapshot: Snapshot, tenant: str | None = None):
        self.snapshot, self.tenant, self.reads = snapshot, tenant, []

    def add(self, read: Callable[[Snapshot], Any]) -> Batch:
        """Any function of the snapshot: a query plan, a point read, a tag query."""
        self.reads.append(read)
        return self

    def load(self, name: str, key: Any) -> Batch:
        return self.add(lambda s: s.query(name, self.tenant).load(key).collect())

    def execute(self) -> list:
        return [got.collect() if isinstance(got, DataFrame) else got for got in (read(self.snapshot) for read in self.reads)]


def bulk_insert(store: Store, name: str, rows: DataFrame, mode: str = "inserts_only", tenant: str = "") -> int:
    """Rows of a DataFrame as documents in one commit, by executors. mode: inserts_only, overwrite or ignore_duplicates.

    A key that the rows hold twice is a conflict, as there is no order between them; with ignore_duplicates the least
    row of a key counts. A document that is overwritten takes the next revision.
    """
    mapping, fields = store.types[name]
    if mode not in ("inserts_only", "overwrite", "ignore_duplicates"):
        raise QueryNotSupported(f"a bulk insert by {mode}")
    new = rows.select(*fields.names)
    if mode == "ignore_duplicates":
        new = new.groupBy(mapping.key).agg(F.min(F.struct(*fields.names)).alias("_row")).select("_row.*")
    elif not new.groupBy(mapping.key).count().where("count > 1").isEmpty():
        raise ConcurrencyConflict(f"some {name} come twice")
    for attempt in range(RETRIES + 1):
        base = store.snapshot()
        number = base.commit + 1
        there = base.documents(name)
        if mapping.tenant:
            there = there.where(F.col("tenant_id") == tenant)
        there = there.select(F.col(mapping.key).alias("_key"), F.col("revision").alias("_have"))
        both = new.join(there, F.col(mapping.key) == F.col("_key"), "left")
        if mode == "ignore_duplicates":
            both = both.where("_key is null")
        elif mode == "inserts_only" and not both.where("_key is not null").isEmpty():
            raise ConcurrencyConflict(f"some {name} exist")
        system = {"_commit": F.lit(number).cast("long"), "_place": F.lit(0), "_gone": F.lit(False), "is_deleted": F.lit(False), "deleted_at": F.lit(None).cast("timestamp_ntz"), "last_modified": F.localtimestamp(), "revision": F.coalesce("_have", F.lit(0)).cast("long") + 1, "tenant_id": F.lit(tenant)}
        path = f"{name}/{uuid.uuid4().hex}"
        both.withColumns({k: v for k, v in system.items() if k not in fields.names}).drop("_key", "_have").write.parquet(f"{store.files.root}/{path}")
        manifest = {"commit": number, "segments": [(name, path)], "last_sequence": base.last_sequence()}
        if store.files.create(f"_commits/{number:012d}.json", json.dumps(manifest)):
            return number
        store.files.delete(path)
        time.sleep(FIRST_WAIT * 2**attempt * (0.5 + random.random()))
    raise ConcurrencyConflict("other writers won every attempt")


def bulk_append(store: Store, events: DataFrame) -> int:
    """Events of a DataFrame (stream_id, type, data, timestamp and an order column ``place``) in one commit, by executors.

    Sequences follow ``place``; versions go on from each stream's. The running number is taken over sorted partitions,
    of which there are few, so no task sees all events.
    """
    for attempt in range(RETRIES + 1):
        base = store.snapshot()
        number, last = base.commit + 1, base.last_sequence()
        path = f"events/{uuid.uuid4().hex}"
        parts = f"_staged/{uuid.uuid4().hex}"
        ranged = events.repartitionByRange("place", "stream_id").sortWithinPartitions("place", "stream_id").withColumn("_part", F.spark_partition_id())
        ranged.write.parquet(f"{store.files.root}/{parts}")
        ranged = store.spark.read.parquet(f"{store.files.root}/{parts}")
        sizes = sorted((r["_part"], r["n"]) for r in ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).collect())
        bases, total = [], 0
        for part, n in sizes:
            bases.append((part, last + total))
            total += n
        within = Window.partitionBy("_part").orderBy("place", "stream_id")
        numbered = ranged.join(F.broadcast(store.spark.createDataFrame(bases, "_part int, _base long")), "_part").withColumn("seq_id", F.col("_base") + F.row_number().over(within))
        have = base.events().groupBy("stream_id").agg(F.max("version").alias("_have"))
        order = Window.partitionBy("stream_id").orderBy("seq_id")
        made = numbered.join(have, "stream_id", "left").withColumn("version", F.coalesce("_have", F.lit(0)) + F.row_number().over(order))
        made = made.withColumns({"tenant_id": F.lit(""), "headers": F.lit("{}"), "data_binary": F.lit(None).cast("binary")})
        made.select(*[F.col(f.name).cast(f.dataType) for f in base.schema("events").fields]).write.parquet(f"{store.files.root}/{path}")
        store.files.delete(parts)
        manifest = {"commit": number, "segments": [("events", path)], "last_sequence": last + total, "bulk": True}
        if store.files.create(f"_commits/{number:012d}.json", json.dumps(manifest)):
            return number
        store.files.delete(path)
        time.sleep(FIRST_WAIT * 2**attempt * (0.5 + random.random()))
    raise ConcurrencyConflict("other writers won every attempt")


class HiLo:
    """Integers for keys in blocks: a block is claimed by creating its file, so no two claimers share one."""

    def __init__(self, store: Store, name: str, size: int = 1000):
        self.store, self.name, self.size = store, name, size
        self.next, self.last = 1, 0

    def __call__(self) -> int:
        if self.next > self.last:
            hi = len(self.store.files.names(f"_hilo/{self.name}"))
            while not self.store.files.create(f"_hilo/{self.name}/{hi:012d}", ""):
                hi += 1
            self.next, self.last = hi * self.size + 1, (hi + 1) * self.size
        value, self.next = self.next, self.next + 1
        return value


@dataclass
class TenantStores:
    """A store for each tenant under one root, which may be suspended."""

    spark: SparkSession
    root: str
    suspended: set[str] = field(default_factory=set)

    def of(self, tenant: str) -> Store:
        if tenant in self.suspended:
            raise QueryNotSupported(f"tenant {tenant} is suspended")
        return Store(self.spark, f"{self.root}/{tenant}")
