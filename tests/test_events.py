import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tarn.errors import QueryNotSupported
from tarn.operators import eventlog as ev
from tarn.operators.fold import Fold, compact, resume
from tarn.operators.patch import Patch
from tarn.plans.projections import FlatTable, MultiStream, decrement, increment, set_to

PARTY = (
    Fold({"name": ("string", None), "members": ("array<string>", None), "slain": ("int", 0)})
    .create("started", name=lambda s, e: e["data"], members=lambda s, e: F.array().cast("array<string>"))
    .apply("joined", members=lambda s, e: F.array_append(F.coalesce(s["members"], F.array().cast("array<string>")), e["data"]))
    .apply("slain", slain=lambda s, e: s["slain"] + 1)
    .delete("ended")
)


def log(spark, rows):
    start = datetime(2024, 1, 1)
    made = [(k, s, t, d, start + timedelta(hours=k)) for k, (s, t, d) in enumerate(rows, 1)]
    return ev.assign_versions(spark.createDataFrame(made, "seq_id long, stream_id string, type string, data string, timestamp timestamp"))


def replay(rows):
    state, last = {}, {}
    for s, t, d in rows:
        now = state.get(s)
        if t == "started" and now is None:
            now = (d, [], 0)
        elif t == "joined":
            now = now or (None, None, 0)
            now = (now[0], [*(now[1] or []), d], now[2])
        elif t == "slain":
            now = now or (None, None, 0)
            now = (now[0], now[1], now[2] + 1)
        elif t == "ended":
            now = None
        state[s] = now
        if now is not None:
            last[s] = now
    return {k: v for k, v in state.items() if v is not None}, last


@pytest.mark.parametrize("seed", range(4))
def test_folds_equal_a_replay(spark, seed):
    r = random.Random(seed)
    rows = [(r.choice("abc"), r.choice(["started", "joined", "joined", "slain", "ended", "unknown"]), f"d{k}") for k in range(60)]
    state, last = replay(rows)
    events = log(spark, rows)
    as_dict = lambda df: {x.stream_id: (x.name, x.members, x.slain) for x in df.collect()}
    assert as_dict(PARTY.project(events)) == state
    assert as_dict(PARTY.last_known(events)) == last
    assert as_dict(resume(compact(events, PARTY), PARTY)) == state
    half = as_dict(PARTY.project(events.where("version > 5"), start=PARTY.project(events.where("version <= 5"))))
    assert half == state
    steps = PARTY.timeline(events).where("stream_id = 'a'").orderBy("version").collect()
    assert ((steps[-1].name, steps[-1].members, steps[-1].slain) if steps[-1].alive else None) == state.get("a")


def flat_replay(rows):
    table = {}
    for s, t, d in rows:
        n = int(d)
        row = table.get(s)
        if t == "start":
            table[s] = (n, None if row is None else row[1], None if row is None else row[2])
        elif t == "plus":
            table[s] = (row[0], None if row[1] is None else row[1] + n, None if row[2] is None else row[2] - n) if row else (None, n, n)
        elif t == "reset":
            table[s] = ((row or (None,) * 3)[0], 100, (row or (None,) * 3)[2])
        elif t == "gone":
            table.pop(s, None)
    return table


@pytest.mark.parametrize("seed", range(4))
def test_flat_tables_equal_a_replay(spark, seed):
    r = random.Random(seed)
    rows = [(r.choice("abcd"), r.choice(["start", "plus", "plus", "reset", "gone", "other"]), str(r.randint(1, 9))) for k in range(80)]
    n = F.col("data").cast("int")
    flat = FlatTable(
        F.col("stream_id"), {"a": "int", "b": "int", "c": "int"}, {"start": {"a": set_to(n)}, "plus": {"b": increment(n), "c": decrement(n)}, "reset": {"b": set_to(100)}}, ("gone",)
    )
    assert {x.key: (x.a, x.b, x.c) for x in flat.project(log(spark, rows)).collect()} == flat_replay(rows)


def test_increments_without_a_member(spark):
    rows = [("a", "up", ""), ("a", "up", ""), ("b", "down", ""), ("b", "down", ""), ("c", "other", ""), ("c", "up", "")]
    flat = FlatTable(F.col("stream_id"), {"n": "int", "m": "int"}, {"up": {"n": increment()}, "down": {"m": decrement()}, "other": {}})
    assert {x.key: (x.n, x.m) for x in flat.project(log(spark, rows)).collect()} == {"a": (2, None), "b": (None, -1), "c": (None, None)}


def test_multi_stream(spark):
    fold = Fold({"n": ("int", 0)}).apply("audited", n=lambda s, e: s["n"] + 1)
    rows = [("a", "squads", "x,y"), ("b", "squads", "y"), ("c", "squads", "")]
    m = MultiStream(fold, fan_out={"squads": ("audited", F.filter(F.split("data", ","), lambda x: x != ""), lambda c: c)})
    assert {r.doc_key: r.n for r in m.project(log(spark, rows)).collect()} == {"x": 1, "y": 2}


def test_rewrites(spark):
    events = log(spark, [("a", "reg", "Ann"), ("a", "buy", "1"), ("b", "reg", "Bob")])
    masked = ev.mask(events, {"reg": {"data": F.lit("***")}}, F.col("stream_id") == "a")
    assert [r.data for r in masked.orderBy("seq_id").collect()] == ["***", "1", "Bob"]
    with pytest.raises(QueryNotSupported):
        ev.mask(events, {})
    gone = ev.archive(events, events.where("stream_id = 'a'"))
    assert ev.EventLog(gone).daemon_page(0, 10, 10).count() == 1 and ev.EventLog(gone).fetch_stream("a").count() == 2
    assert ev.tombstone(events, events.where("stream_id = 'a'")).count() == 1
    assert ev.EventLog(events).by_tags([], {}).count() == 0


def test_patches(spark):
    df = spark.createDataFrame([(1, [1, 2, 1], ("x", 1)), (2, None, ("y", None))], "id int, l array<int>, s struct<a:string,b:int>")
    out = {r.id: r for r in Patch().append("l", 5).insert("l", 9, 1).remove("l", 1).increment("s.b", 2).rename("s.a", "s.c").apply(df).collect()}
    assert out[1].l == [9, 2, 5] and out[2].l == [5, 9] and out[1].s.asDict() == {"b": 3, "c": "x"} and out[2].s.b == 2
    assert [r.l for r in Patch().append_if_not_exists("l", 2).append_if_not_exists("l", 7).apply(df).orderBy("id").collect()] == [[1, 2, 1, 7], [2, 7]]
    with pytest.raises(QueryNotSupported):
        Patch().insert("l", 1, -1)
