"""Queries that write to a store and read it back, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .catalog import ACCOUNT, LOG, Source, _folds, log, query
from .errors import ConcurrencyConflict
from .operators.patch import Patch
from .sources.store import Store, bulk_append, bulk_insert, scratch_root
from .streaming.daemon import Daemon, Projection


def _store(t: Source) -> Store:
    spark: SparkSession = t("nation").sparkSession
    return Store(spark, f"{scratch_root(spark)}/store")


def _filled(t: Source) -> Store:
    """A store of all events, with the event's number as the place; bodies hold the value too."""
    store = _store(t)
    rows = log(t, False).select(F.col("stream_id").cast("string").alias("stream_id"), "type", "data", "timestamp", F.col("seq_id").alias("place"))
    bulk_append(store, rows)
    return store


def _two(t: Source, mode: str) -> Store:
    """Documents of all suppliers, then of all customers by the same numbers."""
    store = _store(t).register("account", "id", "id bigint, balance double")
    bulk_insert(store, "account", t("supplier").select(F.col("s_suppkey").cast("bigint").alias("id"), F.col("s_acctbal").alias("balance")))
    bulk_insert(store, "account", t("customer").select(F.col("c_custkey").cast("bigint").alias("id"), F.col("c_acctbal").alias("balance")), mode)
    return store


_ONE, _OTHER = "SELECT s_suppkey::BIGINT AS id, s_acctbal AS balance", "SELECT c_custkey::BIGINT AS id, c_acctbal AS balance"
query("bulk_insert_ignore_duplicates", f"{_ONE}, 1::BIGINT AS revision FROM supplier UNION ALL {_OTHER}, 1::BIGINT FROM customer WHERE c_custkey NOT IN (SELECT s_suppkey FROM supplier)")(
    lambda t: _two(t, "ignore_duplicates").snapshot().query("account").to_df().select("id", "balance", "revision")
)
query("upsert_last_writer_wins", f"{_ONE}, 1::BIGINT AS revision FROM supplier WHERE s_suppkey NOT IN (SELECT c_custkey FROM customer) UNION ALL {_OTHER}, CASE WHEN c_custkey IN (SELECT s_suppkey FROM supplier) THEN 2 ELSE 1 END::BIGINT FROM customer")(
    lambda t: _two(t, "overwrite").snapshot().query("account").to_df().select("id", "balance", "revision")
)


def _guarded(t: Source) -> DataFrame:
    """All nations at revision 5; then a commit for each region, whose revision has to be greater."""
    store = _store(t).register("nation", "id", "id bigint, name string")
    rows = t("nation").orderBy("n_nationkey").collect()
    session = store.session()
    for r in rows:
        session.store_("nation", {"id": r.n_nationkey, "name": r.n_name}, revision=5)
    session.save()
    for region in sorted({r.n_regionkey for r in rows}):
        session = store.session()
        for r in rows:
            if r.n_regionkey == region:
                session.store_("nation", {"id": r.n_nationkey, "name": r.n_name.lower()}, revision=4 + region)
        try:
            session.save()
        except ConcurrencyConflict:
            pass  # regions 0 and 1 come too late
    return store.snapshot().query("nation").to_df().select("id", "name", "revision")


query("revision_guard", "SELECT n_nationkey::BIGINT AS id, CASE WHEN n_regionkey > 1 THEN lower(n_name) ELSE n_name END AS name, greatest(5, 4 + n_regionkey)::BIGINT AS revision FROM nation")(_guarded)


def _by_predicate(t: Source, change) -> DataFrame:
    store = _store(t).register("part", "id", "id bigint, name string, price double", soft_delete=True)
    bulk_insert(store, "part", t("part").select(F.col("p_partkey").cast("bigint").alias("id"), F.col("p_name").alias("name"), F.col("p_retailprice").alias("price")))
    change(store.session()).save()
    return store.snapshot().query("part").maybe_deleted().to_df()


query("session_delete_where", "SELECT p_partkey::BIGINT AS id, p_retailprice > 1200 AS is_deleted FROM part")(lambda t: _by_predicate(t, lambda s: s.delete_where("part", lambda x: x.price > 1200.0)).select("id", "is_deleted"))
query("session_hard_delete_where", "SELECT p_partkey::BIGINT AS id FROM part WHERE NOT (p_retailprice > 1200)")(lambda t: _by_predicate(t, lambda s: s.delete_where("part", lambda x: x.price > 1200.0, hard=True)).select("id"))
query("session_patch_where", "SELECT p_partkey::BIGINT AS id, CASE WHEN p_retailprice > 1200 THEN 0.0 ELSE p_retailprice END AS price, CASE WHEN p_retailprice > 1200 THEN 2 ELSE 1 END::BIGINT AS revision FROM part")(
    lambda t: _by_predicate(t, lambda s: s.patch_where("part", lambda x: x.price > 1200.0, Patch().set("price", 0.0).apply)).select("id", "price", "revision")
)

# Events.
_OF = "SELECT stream_id, views, clicks FROM ("
query("store_append", "SELECT event_id AS seq_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS version, event_type AS type FROM (SELECT row_number() OVER (ORDER BY event_id) AS event_id, user_id, event_type FROM events)")(
    lambda t: _filled(t).snapshot().events().select("seq_id", "version", "type")
)


def _latest(t: Source) -> DataFrame:
    state = _filled(t).session().append("8", ("view", {})).project_latest(ACCOUNT, "8")
    return t("nation").sparkSession.createDataFrame([(int(state["stream_id"]), state["views"], state["clicks"])] if state else [], "stream_id bigint, views bigint, clicks bigint")


query("project_latest", f"{_OF}{_folds(f'(SELECT * FROM {LOG} UNION ALL SELECT 100000000, 8, $$view$$, TIMESTAMP $$2025-01-01$$, 1.0, $${{}}$$, 1000000)')}) WHERE stream_id = 8".replace("$$", "'"))(_latest)


def _projected(t: Source) -> DataFrame:
    """A projection kept by the daemon over the store's commits."""
    store = _filled(t)
    daemon, p = Daemon.over(store, f"{store.files.root}/daemon"), Projection("account", ACCOUNT.project)
    daemon.run(p)
    return daemon.result(p).select(F.col("stream_id").cast("bigint").alias("stream_id"), "views", "clicks")


query("daemon_projection", f"{_OF}{_folds(LOG)})")(_projected)


def _letters(t: Source) -> DataFrame:
    """Events that a projection can't take in, one dead letter each."""
    daemon = Daemon(t("events").sparkSession, "", log(t, False)._jdf.schema().toDDL(), f"{scratch_root(t('events').sparkSession)}/daemon")
    p = Projection("values", ACCOUNT.project, key=None, reject=F.col("value") > 50, start=-1)
    daemon.take(p, log(t, False), 0)
    letters = daemon.dead_letters("values").join(log(t, False), F.col("sequence") == F.col("seq_id"))
    return letters.groupBy("projection", "type").agg(F.count(F.lit(1)).alias("n"))


query("dead_letter_counts", "SELECT 'values' AS projection, event_type AS type, count(*) AS n FROM events WHERE value > 50 GROUP BY 2")(_letters)


def _masked(t: Source) -> DataFrame:
    store = _filled(t)
    store.mask_events({"signup": {"data": F.lit("***")}}, F.col("stream_id").cast("bigint") < 50)
    return store.snapshot().events().select(F.col("stream_id").cast("bigint").alias("stream_id"), "version", "data")


query("store_mask_events", "SELECT user_id AS stream_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS version, CASE WHEN event_type = 'signup' AND user_id < 50 THEN '***' ELSE props END AS data FROM events")(_masked)


def _erased(t: Source) -> DataFrame:
    store = _filled(t)
    store.erase("8", "9")
    return store.snapshot().log().statistics()


query("store_erase", "SELECT count(*) FILTER (user_id NOT IN (8, 9)) AS event_count, count(DISTINCT CASE WHEN user_id NOT IN (8, 9) THEN user_id END) AS stream_count, count(*) AS highest_sequence FROM events")(_erased)
