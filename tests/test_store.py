import threading

import pytest
from pyspark.sql import functions as F

from tarn.errors import BoundaryConflict, ConcurrencyConflict, StreamExists
from tarn.operators.eventlog import TagCondition
from tarn.operators.fold import Fold
from tarn.sources.store import HiLo, Store, bulk_append, bulk_insert
from tarn.streaming.daemon import Daemon, Projection

PURSE = Fold({"balance": ("int", 0)}).apply("earned", balance=lambda s, e: s["balance"] + F.get_json_object(e["data"], "$.n").cast("int"))


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, f"file://{tmp_path}/s").register("user", "id", "id string, name string, age int", soft_delete=True).register("plain", "id", "id int, v int")


def names(store, **scope):
    return sorted(r.id for r in store.snapshot().query("user").to_df().collect())


def test_documents(store):
    store.session().store_("user", {"id": "a", "name": "A", "age": 1}).insert("user", {"id": "b", "name": "B", "age": 2}).save()
    assert names(store) == ["a", "b"]
    first = store.head()
    store.session().store_("user", {"id": "a", "name": "AA", "age": 3}).delete("user", "b").save()
    assert names(store) == ["a"] and store.snapshot().query("user").load("a").first().name == "AA"
    assert store.snapshot(first).query("user").load("a").first().name == "A"
    assert store.snapshot().query("user").is_deleted().count() == 1
    store.session().undelete("user", "b").save()
    assert names(store) == ["a", "b"]
    store.session().delete("user", "b", hard=True).save()
    assert store.snapshot().query("user").maybe_deleted().count() == 1
    with pytest.raises(ConcurrencyConflict):
        store.session().insert("user", {"id": "a", "name": "", "age": 0}).save()
    with pytest.raises(ConcurrencyConflict):
        store.session().update("user", {"id": "zz", "name": "", "age": 0}).save()


def test_revisions(store):
    store.session().store_("user", {"id": "a", "name": "A", "age": 1}).save()
    store.session().update("user", {"id": "a", "name": "B", "age": 1}, expected=1).save()
    with pytest.raises(ConcurrencyConflict):
        store.session().update("user", {"id": "a", "name": "C", "age": 1}, expected=1).save()
    store.session().store_("user", {"id": "a", "name": "D", "age": 1}, revision=10).save()
    with pytest.raises(ConcurrencyConflict):
        store.session().store_("user", {"id": "a", "name": "E", "age": 1}, revision=10).save()


def test_events(store):
    store.session().start_stream("s", ("earned", {"n": 1, "_tags": {"region": "north"}}), ("earned", {"n": 2})).save()
    with pytest.raises(StreamExists):
        store.session().start_stream("s", ("earned", {"n": 1})).save()
    store.session().append("s", ("earned", {"n": 4}), expected=3).save()
    with pytest.raises(ConcurrencyConflict):
        store.session().append("s", ("earned", {"n": 4}), expected=3).save()
    late = store.session().append_optimistic("s", ("earned", {"n": 8}))
    store.session().append("s", ("earned", {"n": 16})).save()
    with pytest.raises(ConcurrencyConflict):
        late.save()
    snap = store.snapshot()
    assert [r.seq_id for r in snap.events().orderBy("seq_id").collect()] == [1, 2, 3, 4] and snap.last_sequence() == 4
    assert snap.aggregate(PURSE, "s").first().balance == 23 and snap.aggregate(PURSE, "s", version=2).first().balance == 3
    store.session().archive("s").save()
    assert store.snapshot().log().daemon_page(0, 100, 100).count() == 0
    store.session().unarchive("s").save()
    assert store.snapshot().log().daemon_page(0, 100, 100).count() == 4
    store.session().tombstone("s").save()
    assert store.snapshot().log().fetch_stream("s").count() == 0 and store.snapshot().stream_versions(["s"]) == {}


def test_boundary_guards_even_an_empty_result(store):
    s = store.session()
    assert s.fetch_by_tags([TagCondition("region", "south")]).count() == 0
    store.session().append("x", ("earned", {"n": 1, "_tags": {"region": "south"}})).save()
    with pytest.raises(BoundaryConflict):
        s.append("y", ("earned", {"n": 1})).save()
    t = store.session()
    t.fetch_by_tags([TagCondition("region", "south")])
    store.session().append("x", ("earned", {"n": 1, "_tags": {"region": "west"}})).save()
    t.append("y", ("earned", {"n": 1})).save()


def test_racing_writers_keep_sequences_whole(store):
    errors = []

    def write(k):
        try:
            store.session().append(f"s{k % 2}", ("earned", {"n": 1})).save()
        except Exception as why:  # noqa: BLE001
            errors.append(why)

    threads = [threading.Thread(target=write, args=(k,)) for k in range(4)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert not errors
    rows = store.snapshot().events().orderBy("seq_id").collect()
    assert [r.seq_id for r in rows] == [1, 2, 3, 4]
    assert sorted((r.stream_id, r.version) for r in rows) == [("s0", 1), ("s0", 2), ("s1", 1), ("s1", 2)]


def test_bulk_insert_and_keys(spark, store):
    rows = spark.createDataFrame([(1, 1), (2, 2)], "id int, v int")
    bulk_insert(store, "plain", rows)
    with pytest.raises(ConcurrencyConflict):
        bulk_insert(store, "plain", rows)
    more = spark.createDataFrame([(2, 20), (3, 30)], "id int, v int")
    bulk_insert(store, "plain", more, "ignore_duplicates")
    read = lambda: {r.id: r.v for r in store.snapshot().query("plain").to_df().collect()}
    assert read() == {1: 1, 2: 2, 3: 30}
    bulk_insert(store, "plain", more, "overwrite")
    assert read() == {1: 1, 2: 20, 3: 30}
    one, two = HiLo(store, "plain", 2), HiLo(store, "plain", 2)
    assert [one(), two(), one(), one(), two()] == [1, 3, 2, 5, 4]


def test_stream_equals_batch(spark, store, tmp_path):
    schema = "seq_id long, stream_id string, version long, type string, timestamp timestamp_ntz, tenant_id string, data string, headers string, data_binary binary"
    seen = []
    p = Projection("purse", lambda df: PURSE.project(df), types=["earned"], subscriber=lambda df, n: seen.append(df.count()))
    store.session().append("a", ("earned", {"n": 1}), ("spent", {"n": 9})).save()
    daemon = Daemon(spark, f"file://{tmp_path}/s/events", schema, f"file://{tmp_path}/out")
    daemon.run(p)
    store.session().append("b", ("earned", {"n": 5})).append("a", ("earned", {"n": 2})).save()
    assert daemon.lag("purse") > 0
    with pytest.raises(TimeoutError):
        daemon.wait(["purse"])
    daemon.run(p)
    want = {(r.stream_id, r.balance) for r in PURSE.project(store.snapshot().events()).collect()}
    assert {(r.stream_id, r.balance) for r in daemon.result(p).collect()} == want == {("a", 3), ("b", 5)}
    assert daemon.progress("purse") == 4 and sum(seen) == 3
    daemon.rebuild(p)
    assert {(r.stream_id, r.balance) for r in daemon.result(p).collect()} == want

    def fail(df, n):
        raise ValueError("no")

    bad = Projection("bad", lambda df: PURSE.project(df), subscriber=fail, skip_errors=True)
    daemon.run(bad)
    assert [(r.sequence, r.kind) for r in daemon.dead_letters("bad").orderBy("sequence").collect()] == [(k, "ValueError") for k in (1, 2, 3, 4)]
    later = daemon.rewind(p, 3)
    assert {(r.stream_id, r.balance) for r in daemon.result(later).collect()} == {("a", 2)}


def balances(df):
    return {(r.stream_id, r.balance) for r in df.collect()}


def test_the_daemon_follows_commits(spark, store, tmp_path):
    p = Projection("purse", PURSE.project)
    daemon = Daemon.over(store, f"file://{tmp_path}/out")
    store.session().append("a", ("earned", {"n": 1})).append("b", ("earned", {"n": 5})).append("c", ("earned", {"n": 7})).save()
    # A writer that died before its manifest.
    lost = [(9, "a", 9, "earned", None, "", '{"n": 100}', "{}", None)]
    spark.createDataFrame(lost, store.snapshot().schema("events")).write.parquet(f"file://{tmp_path}/s/events/lost")
    store.session().archive("c").save()
    daemon.run(p)
    assert balances(daemon.result(p)) == {("a", 1), ("b", 5)}
    store.session().append("a", ("earned", {"n": 2})).save()
    store.session().append("a", ("earned", {"n": 3})).save()
    daemon.run(p)
    daemon.run(p)
    assert balances(daemon.result(p)) == {("a", 6), ("b", 5)} and daemon.lag("purse") == 0
    daemon.wait(["purse"])
    assert daemon.progress_of_all() == {"purse": 5, "HighWaterMark": 5}
    # Only the touched key is written again.
    assert spark.read.parquet(f"file://{tmp_path}/out/purse/rows/*").count() == 3
    # A batch that is taken again changes nothing.
    daemon.take(p, store.snapshot().events(), 0)
    assert balances(daemon.result(p)) == {("a", 6), ("b", 5)}


def test_one_bad_event_is_one_letter(store, tmp_path):
    store.session().append("a", *[("earned", {"n": k}) for k in range(6)]).save()

    def picky(df, n):
        if df.where("data like '%4%'").count():
            raise ValueError("four")

    daemon = Daemon.over(store, f"file://{tmp_path}/out")
    p = Projection("picky", PURSE.project, subscriber=picky, skip_errors=True, reject=F.col("data").contains("3"))
    daemon.run(p)
    assert sorted((r.sequence, r.kind) for r in daemon.dead_letters("picky").collect()) == [(4, "rejected"), (5, "ValueError")]
    assert balances(daemon.result(p)) == {("a", 0 + 1 + 2 + 5)}


def test_raised_events_are_appended(store, tmp_path):
    store.session().append("a", ("earned", {"n": 3})).save()
    p = Projection("echo", PURSE.project, types=["earned"], raises=lambda df: [(f"echo-{r.stream_id}", ("heard", {"of": r.seq_id})) for r in df.collect()])
    daemon = Daemon.over(store, f"file://{tmp_path}/out")
    daemon.run(p)
    daemon.run(p)
    assert [(r.stream_id, r.type) for r in store.snapshot().events().orderBy("seq_id").collect()] == [("a", "earned"), ("echo-a", "heard")]


def test_scopes_of_tenants_keep_their_tenant(store):
    store.register("note", "id", "id string, text string", tenanted=True)
    a = store.session("A").store_("note", {"id": "1", "text": "of a"})
    a.for_tenant("B").store_("note", {"id": "1", "text": "of b"}).append("s", ("earned", {"n": 1}))
    a.save()
    read = lambda t: {r.id: r.text for r in store.snapshot().query("note", t).to_df().collect()}
    assert read("A") == {"1": "of a"} and read("B") == {"1": "of b"}
    assert store.snapshot().events().first().tenant_id == "B"
    store.session("B").delete("note", "1").save()
    assert read("A") == {"1": "of a"} and read("B") == {}


def test_inline_projections_run_anew_on_each_attempt(store):
    store.inline.append(lambda s, rows: [s.insert("plain", {"id": r["seq_id"], "v": 0}) for r in rows])
    one = store.session().append("x", ("earned", {"n": 1}))
    real, calls = store.files.create, []

    def lose_once(name, text):
        calls.append(name)
        if len(calls) == 1:
            store.files.create = real
            store.session().append("y", ("earned", {"n": 2})).save()
            store.files.create = lose_once
        return real(name, text)

    store.files.create = lose_once
    one.save()
    assert sorted(r.id for r in store.snapshot().query("plain").to_df().collect()) == [1, 2]


def test_documents_by_predicate(store):
    s = store.session()
    for k in range(6):
        s.store_("user", {"id": str(k), "name": f"n{k}", "age": k}).store_("plain", {"id": k, "v": k})
    s.save()
    store.session().delete_where("user", lambda x: x.age >= 3).delete_where("plain", lambda x: x.v < 2).save()
    assert names(store) == ["0", "1", "2"] and store.snapshot().query("plain").count() == 4
    store.session().undo_delete_where("user", lambda x: x.age == 4).patch_where("plain", lambda x: x.v == 5, lambda df: df.withColumn("v", F.col("v") * 10)).save()
    assert names(store) == ["0", "1", "2", "4"]
    rows = {r.id: (r.v, r.revision) for r in store.snapshot().query("plain").to_df().collect()}
    assert rows == {2: (2, 1), 3: (3, 1), 4: (4, 1), 5: (50, 2)}


def test_rewriting_leaves_nothing_on_disk(spark, store, tmp_path):
    store.session().append("a", ("named", {"who": "Ann"}), ("earned", {"n": 1})).save()
    store.session().append("b", ("named", {"who": "Bob"})).append("a", ("earned", {"n": 2})).save()
    on_disk = lambda: " ".join(r.data for r in spark.read.parquet(f"file://{tmp_path}/s/events/*").collect())
    store.mask_events({"named": {"data": F.lit('{"who": "*"}')}}, F.col("stream_id") == "a")
    assert "Ann" not in on_disk() and "Bob" in on_disk() and store.snapshot().events().count() == 4
    store.overwrite_events(spark.createDataFrame([(2, '{"n": 40}')], "seq_id long, data string"))
    assert store.snapshot().aggregate(PURSE, "a").first().balance == 42
    store.compact_stream(PURSE, "a", 2)
    events = store.snapshot().log().fetch_stream("a").collect()
    assert [(r.version, r.type) for r in events] == [(2, "_compacted"), (3, "earned")] and '"balance":40' in events[0].data
    store.erase("b")
    assert "Bob" not in on_disk() and store.snapshot().stream_versions(["b"]) == {}
    store.session().start_stream("b", ("named", {"who": "Ben"})).save()
    assert [(r.seq_id, r.version) for r in store.snapshot().log().fetch_stream("b").collect()] == [(5, 1)]
    store.delete_events(spark.createDataFrame([(5,)], "seq_id long"))
    assert store.snapshot().log().statistics().first().highest_sequence == 5
    before = store.snapshot().events().count()
    store.merge("events")
    assert store.snapshot().events().count() == before and len(store.snapshot().segments("events")) == 1


def test_natural_keys_have_one_stream(store):
    store.session().start_stream("a", ("named", {"who": "Ann", "_keys": {"email": "x@y"}})).save()
    with pytest.raises(ConcurrencyConflict):
        store.session().start_stream("b", ("named", {"_keys": {"email": "x@y"}})).save()
    store.session().append("a", ("named", {"_keys": {"email": "x@y"}})).save()
    store.erase("a")
    store.session().start_stream("b", ("named", {"_keys": {"email": "x@y"}})).save()


def test_bulk_modes(spark, store):
    store.session().store_("plain", {"id": 1, "v": 1}, revision=7).save()
    twice = spark.createDataFrame([(2, 1), (2, 2)], "id int, v int")
    for mode in ("inserts_only", "overwrite"):
        with pytest.raises(ConcurrencyConflict):
            bulk_insert(store, "plain", twice, mode)
    bulk_insert(store, "plain", twice, "ignore_duplicates")
    bulk_insert(store, "plain", spark.createDataFrame([(1, 5)], "id int, v int"), "overwrite")
    assert {r.id: (r.v, r.revision) for r in store.snapshot().query("plain").to_df().collect()} == {1: (5, 8), 2: (1, 1)}
    store.register("note", "id", "id string, text string", tenanted=True)
    for tenant in ("A", "B"):
        bulk_insert(store, "note", spark.createDataFrame([("1", tenant)], "id string, text string"), tenant=tenant)
    assert store.snapshot().query("note", "B").to_df().first().text == "B"


def test_bulk_appends_go_on_where_streams_are(spark, store):
    store.session().append("a", ("earned", {"n": 1})).save()
    rows = [("a", "earned", '{"n": 2}', None, k) for k in range(5)] + [("b", "earned", '{"n": 3}', None, 9)]
    bulk_append(store, spark.createDataFrame(rows, "stream_id string, type string, data string, timestamp timestamp_ntz, place int"))
    got = store.snapshot().events().orderBy("seq_id").collect()
    assert [(r.seq_id, r.stream_id, r.version) for r in got] == [*((k, "a", k) for k in range(1, 7)), (7, "b", 1)]
    store.session().append("b", ("earned", {"n": 1}), expected=2).save()
    assert store.snapshot().stream_versions(["a", "b"]) == {"a": 6, "b": 2}


def test_writing_by_an_aggregate(store):
    s = store.session()
    handle = s.fetch_for_writing(PURSE, "p")
    assert handle.aggregate is None and handle.version == 0
    handle.append(("earned", {"n": 3}))
    assert s.project_latest(PURSE, "p")["balance"] == 3
    s.save()
    stale = store.session().fetch_for_writing(PURSE, "p")
    store.session().write_to(PURSE, "p", lambda a: [("earned", {"n": a["balance"]})])
    assert store.session().fetch_latest(PURSE, "p")["balance"] == 6
    stale.append(("earned", {"n": 1}))
    with pytest.raises(ConcurrencyConflict):
        stale.session.save()


def test_sessions(store):
    sent = []
    store.outbox = sent.extend
    assert store.seed(lambda s: s.store_("user", {"id": "a", "name": "A", "age": 1})) and not store.seed()
    s = store.session(tracking="dirty").publish("hello")
    doc = s.load("user", "a")
    assert s.load("user", "a") is doc
    doc["age"] = 2
    s.save()
    assert store.snapshot().query("user").load("a").first().age == 2 and sent == ["hello"]
    head = store.head()
    assert store.session().save() == head
    got = store.session().batch().load("user", "a").add(lambda x: x.query("user").count()).execute()
    assert got[0][0].name == "A" and got[1] == 1
    store.session().store_("user", {"id": "b", "name": "B", "age": 1}).eject("user", "b").save()
    assert store.session().load("user", "b") is None
    assert "CREATE TABLE user" in store.ddl()


def test_binary_bodies_and_cleaning(store):
    from tarn.errors import QueryNotSupported

    store.binary["blob"] = lambda body: body["x"].encode()
    store.session().append("s", ("blob", {"x": "bytes"}), ("earned", {"n": 1})).store_("user", {"id": "a", "name": "A", "age": 1}).save()
    row = store.snapshot().events().where("type = 'blob'").first()
    assert bytes(row.data_binary) == b"bytes" and row.data == "{}"
    with pytest.raises(QueryNotSupported):
        store.snapshot().log().bodies("blob", "x string")
    store.clean("user")
    assert names(store) == [] and store.snapshot().events().count() == 2
    store.clean("events")
    assert store.snapshot().events().count() == 0
    store.session().start_stream("s", ("earned", {"n": 1})).save()
    assert [(r.seq_id, r.version) for r in store.snapshot().events().collect()] == [(3, 1)]


def test_reading_aids(store):
    from tarn.sources.store import event_alias, sequential_uuid

    assert [event_alias(x) for x in ("QuestStarted", "HTTPCall", "earned", "a_b")] == ["quest_started", "http_call", "earned", "a_b"]
    keys = [sequential_uuid() for _ in range(3)]
    assert len(set(keys)) == 3 and keys[0][:8] == keys[2][:8]
    s = store.session()
    for k in range(5):
        s.store_("user", {"id": str(k), "name": f"n{k % 2}", "age": k})
    s.delete("user", "4").append("q", ("QuestStarted", {}), ("earned", {"n": 2})).save()
    assert [tuple(r) for r in store.snapshot().census().collect()] == [("plain", 0, 0), ("user", 5, 1)]
    assert [r.key for r in store.snapshot().browse("user", page=2, size=2).collect()] == ["2", "3"]
    assert [r.key for r in store.snapshot().browse("user", name="n1").collect()] == ["1", "3"]
    adults = lambda at: lambda session: session.query("user").where(lambda x: x.age >= at)
    assert [r.id for r in store.session().run(adults(3))] == ["3"]
    got = store.snapshot().query("user").load_json("2")
    assert got[1] == 1 and '"name":"n0"' in got[0] and "age" in store.snapshot().query("user").fields()
    page, cursor = store.snapshot().query("user").order_by("age").then_by("id").to_json_page(3)
    assert page.count('"id"') == 3 and cursor
    assert store.snapshot().events().first().type == "quest_started"


def test_cached_aggregates_fold_later_events_only(store, monkeypatch):
    store.aggregates = {}
    store.session().append("s", *[("earned", {"n": 1})] * 3).save()
    assert store.session().fetch_for_writing(PURSE, "s").aggregate["balance"] == 3
    store.session().append("s", ("earned", {"n": 10})).save()
    assert store.session().fetch_for_writing(PURSE, "s").aggregate["balance"] == 13
    monkeypatch.setattr(type(PURSE), "project", lambda *a, **k: 1 / 0)
    handle = store.session().fetch_for_writing(PURSE, "s")
    assert handle.aggregate["balance"] == 13 and handle.version == 4


def test_scenarios_and_storages(spark, store, tmp_path):
    from tarn.errors import QueryNotSupported
    from tarn.streaming.scenario import Scenario

    Scenario(spark, PURSE.project).given("a", ("earned", {"n": 1}), ("earned", {"n": 2})).given("b", ("spent", {})).then(a={"balance": 3}, b=None)
    with pytest.raises(AssertionError):
        Scenario(spark, PURSE.project).given("a", ("earned", {"n": 1})).then(a={"balance": 2})

    class Memory:
        def __init__(self):
            self.rows = {}

        def write(self, rows, batch):
            self.rows |= {r.stream_id: None if r["_gone"] else r.balance for r in rows.collect()}

        def read(self):
            return spark.createDataFrame([(k, v) for k, v in self.rows.items() if v is not None], "stream_id string, balance int")

    store.session().append("a", ("earned", {"n": 4})).save()
    daemon, p = Daemon.over(store, f"file://{tmp_path}/out"), Projection("m", PURSE.project, storage=Memory())
    daemon.run(p)
    assert balances(daemon.result(p)) == {("a", 4)}
    with pytest.raises(QueryNotSupported):
        Daemon(spark, store, "", f"file://{tmp_path}/out", mode="hot_cold")
