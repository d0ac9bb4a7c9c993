"""Queries over the driver's tables, one for each operator, with the SQL that each must agree with."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .mapping import Mapping
from .operators import eventlog as ev
from .operators.fold import Fold, as_of, compact, resume, to_version
from .operators.joins import Join
from .operators.patch import Patch
from .operators.query import Query
from .plans.projections import Composite, EventProjection, FlatTable, MultiStream, decrement, increment, set_to

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
Source = Callable[[str], DataFrame]


def query(name: str, sql: str | None) -> Callable[[Callable[[Source], DataFrame]], None]:
    """Registers a function of a table reader."""

    def add(f: Callable[[Source], DataFrame]) -> None:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet"))

        QUERIES[name] = run
        if sql is not None:
            SQL[name] = sql

    return add


ORDER = Mapping("o_orderkey")
CUSTOMER = Mapping("c_custkey")
TENANT = Mapping("c_custkey", tenant="c_mktsegment")
PART = Mapping("p_partkey")
NATION, REGION, SUPPLIER = Mapping("n_nationkey"), Mapping("r_regionkey"), Mapping("s_suppkey")
DOC = Mapping("doc_id")
EVENT = Mapping("event_id")
ITEM = Mapping("l_id", deleted="is_deleted", deleted_at="deleted_at", kind="l_linestatus", modified="l_shipdate", subclasses={"open": ("O",), "filled": ("F",), "any": ("O", "F")})


def orders(t: Source) -> Query:
    return Query(t("orders"), ORDER)


def parts(t: Source) -> Query:
    return Query(t("part"), PART)


def customers(t: Source) -> Query:
    return Query(t("customer"), CUSTOMER)


def events(t: Source) -> Query:
    return Query(t("events"), EVENT)


def items(t: Source) -> Query:
    """Line items as documents that are soft-deleted when returned, at the time of shipping."""
    df = t("lineitem").withColumn("l_id", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    gone = F.col("l_returnflag") == "R"
    return Query(df.withColumn("is_deleted", gone).withColumn("deleted_at", F.when(gone, F.col("l_shipdate"))), ITEM)


def log(t: Source, versions: bool = True) -> DataFrame:
    e = t("events").select(F.col("event_id").alias("seq_id"), F.col("user_id").alias("stream_id"), F.col("event_type").alias("type"), F.col("ts").alias("timestamp"), "value", F.col("props").alias("data"))
    return ev.assign_versions(e) if versions else e


LOG = "(SELECT event_id AS seq_id, user_id AS stream_id, event_type AS type, ts AS timestamp, value, props AS data, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS version FROM events)"
LINES = "(SELECT *, l_orderkey * 10 + l_linenumber AS l_id, l_returnflag = 'R' AS is_deleted, CASE WHEN l_returnflag = 'R' THEN l_shipdate END AS deleted_at FROM lineitem)"
O2 = "o_orderkey, o_totalprice"
MIDDLE = datetime(2024, 1, 15)


# Filters.
def _where(name: str, predicate: Callable, sql: str) -> None:
    query(name, f"SELECT o_orderkey, o_totalprice FROM orders WHERE {sql}")(lambda t: orders(t).where(predicate).select(o_orderkey="o_orderkey", o_totalprice="o_totalprice").to_df())


_where("where_eq", lambda x: x.o_orderstatus == "F", "o_orderstatus = 'F'")
_where("where_ne", lambda x: x.o_orderstatus != "F", "o_orderstatus <> 'F'")
_where("where_range", lambda x: (x.o_totalprice >= 100000.0) & (x.o_totalprice < 200000.0), "o_totalprice >= 100000 AND o_totalprice < 200000")
_where("where_reversed", lambda x: 250000.0 < x.o_totalprice, "250000 < o_totalprice")
_where("where_and_or", lambda x: (x.o_orderstatus == "F") & ((x.o_totalprice > 400000.0) | (x.o_orderpriority == "1-URGENT")), "o_orderstatus = 'F' AND (o_totalprice > 400000 OR o_orderpriority = '1-URGENT')")
_where("where_not", lambda x: ~((x.o_orderstatus == "F") | (x.o_totalprice > 100000.0)), "NOT (o_orderstatus = 'F' OR o_totalprice > 100000)")
_where("where_not_null", lambda x: x.o_orderstatus != None, "o_orderstatus IS NOT NULL")  # noqa: E711
_where("where_has_value", lambda x: x.o_custkey.has_value(), "o_custkey IS NOT NULL")
_where("where_modulo", lambda x: (x.o_custkey % 7) == 3, "o_custkey % 7 = 3")
_where("where_modulo_zero", lambda x: (x.o_custkey % 0) == 0, "false")
_where("where_in", lambda x: x.o_custkey.is_in([1, 5, 9, 100, 200]), "o_custkey IN (1, 5, 9, 100, 200)")
_where("where_in_empty", lambda x: x.o_custkey.is_in([]), "false")
_where("where_is_one_of", lambda x: x.o_orderpriority.is_one_of("1-URGENT", "2-HIGH"), "o_orderpriority IN ('1-URGENT', '2-HIGH')")
_where("where_const_false", lambda x: False, "false")
_where("where_const_true", lambda x: True, "true")
_where("where_object_equals", lambda x: x.o_orderstatus.equals("O"), "o_orderstatus = 'O'")
_where("where_timestamp_range", lambda x: (x.o_orderdate >= datetime(1997, 1, 1)) & (x.o_orderdate < datetime(1998, 1, 1)), "o_orderdate >= TIMESTAMP '1997-01-01' AND o_orderdate < TIMESTAMP '1998-01-01'")
query("where_bool_member", f"SELECT l_id FROM {LINES} WHERE is_deleted")(lambda t: items(t).maybe_deleted().where(lambda x: x.is_deleted).select(l_id="l_id").to_df())
query("where_bool_member_not", f"SELECT l_id FROM {LINES} WHERE NOT is_deleted")(lambda t: items(t).maybe_deleted().where(lambda x: ~x.is_deleted).select(l_id="l_id").to_df())
query("where_timestamp_eq_ms", "SELECT event_id FROM events WHERE date_trunc('milliseconds', ts) = TIMESTAMP '2024-01-01 00:03:52.824'")(
    lambda t: events(t).where(lambda x: x.ts == "2024-01-01 00:03:52.824").select(event_id="event_id").to_df()
)


# Strings.
def _string(name: str, predicate: Callable, sql: str) -> None:
    query(name, f"SELECT p_partkey, p_name FROM part WHERE {sql}")(lambda t: parts(t).where(predicate).select(p_partkey="p_partkey", p_name="p_name").to_df())


_string("str_contains", lambda x: x.p_name.contains("ring"), "contains(p_name, 'ring')")
_string("str_starts_with", lambda x: x.p_name.starts_with("red"), "starts_with(p_name, 'red')")
_string("str_starts_with_empty", lambda x: x.p_name.starts_with(""), "p_name IS NOT NULL")
_string("str_ends_with", lambda x: x.p_name.ends_with("get"), "ends_with(p_name, 'get')")
_string("str_ends_with_empty", lambda x: x.p_name.ends_with(""), "true")
_string("str_equals", lambda x: x.p_name.equals("red widget"), "p_name = 'red widget'")
_string("str_equals_ignore_case", lambda x: x.p_name.equals("RED Widget", ignore_case=True), "lower(p_name) = 'red widget'")
_string("str_contains_ignore_case", lambda x: x.p_brand.contains("BRAND#1", ignore_case=True), "contains(lower(p_brand), 'brand#1')")
_string("str_starts_with_ignore_case", lambda x: x.p_type.starts_with("eco", ignore_case=True), "starts_with(lower(p_type), 'eco')")
_string("str_ends_with_ignore_case", lambda x: x.p_type.ends_with("omy", ignore_case=True), "ends_with(lower(p_type), 'omy')")
_string("str_lower", lambda x: x.p_type.lower() == "economy", "lower(p_type) = 'economy'")
_string("str_upper", lambda x: x.p_name.upper() == "RED WIDGET", "upper(p_name) = 'RED WIDGET'")
_string("str_trim", lambda x: x.p_name.trim() == "red widget", "trim(p_name) = 'red widget'")
_string("str_trim_start", lambda x: x.p_name.trim_start() != "red widget", "ltrim(p_name) <> 'red widget'")
_string("str_trim_end", lambda x: x.p_name.trim_end() == "small ring", "rtrim(p_name) = 'small ring'")
_string("str_length", lambda x: x.p_name.length() > 10, "length(p_name) > 10")

# The given tables have no nulls and no empty values: some are made so.
HOLES = "(SELECT p_partkey, p_brand, CASE p_partkey % 4 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN '  ' ELSE p_name END AS p_name FROM part)"


def _holes(t: Source) -> Query:
    kind = F.col("p_partkey") % 4
    return Query(t("part").withColumn("p_name", F.when(kind == 0, None).when(kind == 1, "").when(kind == 2, "  ").otherwise(F.col("p_name"))), PART)


def _hole(name: str, predicate: Callable, sql: str) -> None:
    query(name, f"SELECT p_partkey, p_name FROM {HOLES} WHERE {sql}")(lambda t: _holes(t).where(predicate).select(p_partkey="p_partkey", p_name="p_name").to_df())


_hole("where_null", lambda x: x.p_name == None, "p_name IS NULL")  # noqa: E711
_hole("str_null_or_empty", lambda x: x.p_name.is_null_or_empty(), "p_name IS NULL OR p_name = ''")
_hole("str_null_or_whitespace", lambda x: x.p_name.is_null_or_whitespace(), "p_name IS NULL OR trim(p_name) = ''")
_hole("str_transform_null", lambda x: x.p_name.lower() == None, "lower(p_name) IS NULL")  # noqa: E711
query("select_null_default", f"SELECT p_partkey, coalesce(p_name, '') AS p_name FROM {HOLES}")(lambda t: _holes(t).select(p_partkey="p_partkey", p_name=lambda x: x.p_name.or_default()).to_df())
query("is_empty_array", "SELECT vec_id FROM embeddings WHERE vec_id % 3 < 2")(
    lambda t: Query(t("embeddings").withColumn("embedding", F.when(F.col("vec_id") % 3 == 0, None).when(F.col("vec_id") % 3 == 1, F.slice("embedding", 1, 0)).otherwise(F.col("embedding"))), Mapping("vec_id"))
    .where(lambda x: x.embedding.is_empty()).select(vec_id="vec_id").to_df()
)

# JSON bodies and lists.
query("json_member_filter", "SELECT event_id FROM events WHERE CAST(json_extract_string(props, '$.k') AS BIGINT) >= 50")(
    lambda t: events(t).where(lambda x: x.props.json("k", "bigint") >= 50).select(event_id="event_id").to_df()
)
query("json_member_project", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")(lambda t: events(t).select(event_id="event_id", k=lambda x: x.props.json("k", "bigint")).to_df())
query("json_group_by_member", "SELECT CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, count(*) AS n FROM events GROUP BY 1")(
    lambda t: events(t).group_by(lambda x: x.props.json("k", "bigint")).select(k="key", n="count").to_df()
)
query("json_null_member", "SELECT event_id FROM events WHERE json_extract_string(props, '$.absent') IS NULL")(lambda t: events(t).where(lambda x: x.props.json("absent") == None).select(event_id="event_id").to_df())  # noqa: E711
query("json_document_row", """SELECT '{"r_regionkey":' || r_regionkey || ',"r_name":"' || r_name || '"}' AS json FROM region""")(lambda t: Query(t("region").select("r_regionkey", "r_name"), REGION).to_json())
query("is_not_empty_array", "SELECT vec_id FROM embeddings WHERE NOT (embedding IS NULL OR len(embedding) = 0)")(lambda t: Query(t("embeddings"), Mapping("vec_id")).where(lambda x: ~x.embedding.is_empty()).select(vec_id="vec_id").to_df())

# Projection.
query("select_scalar", "SELECT c_name AS name FROM customer")(lambda t: customers(t).select(name="c_name").to_df())
query("select_shape", "SELECT c_name AS name, c_acctbal AS balance, c_nationkey AS nation FROM customer")(lambda t: customers(t).select(name="c_name", balance="c_acctbal", nation="c_nationkey").to_df())
query("select_computed", "SELECT c_custkey, c_acctbal * 2 + 1 AS twice, upper(c_name) || '!' AS shout FROM customer")(
    lambda t: customers(t).select(c_custkey="c_custkey", twice=F.col("c_acctbal") * 2 + 1, shout=F.concat(F.upper("c_name"), F.lit("!"))).to_df()
)
query("select_distinct", "SELECT DISTINCT o_orderstatus AS status, o_orderpriority AS priority FROM orders")(lambda t: orders(t).select(status="o_orderstatus", priority="o_orderpriority").distinct().to_df())
query("distinct_by", "SELECT o_orderkey, o_custkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rn FROM orders) WHERE rn = 1")(
    lambda t: orders(t).distinct_by("o_custkey").select(o_orderkey="o_orderkey", o_custkey="o_custkey").to_df()
)
query("distinct_by_paged", "SELECT o_orderkey, o_custkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rn FROM orders) WHERE rn = 1 ORDER BY o_orderkey LIMIT 10 OFFSET 5")(
    lambda t: orders(t).distinct_by("o_custkey").order_by("o_orderkey").skip(5).take(10).select(o_orderkey="o_orderkey", o_custkey="o_custkey").to_df()
)

# Aggregates and grouping.
query("agg_count", "SELECT count(*) AS n FROM orders")(lambda t: orders(t).count_df())
query("agg_count_where", "SELECT count(*) AS n FROM orders WHERE o_orderstatus = 'O'")(lambda t: orders(t).where(lambda x: x.o_orderstatus == "O").count_df())
query("agg_any", "SELECT count(*) > 0 AS found FROM orders WHERE o_totalprice > 499000")(lambda t: orders(t).where(lambda x: x.o_totalprice > 499000.0).any_df())
query("agg_any_none", "SELECT false AS found")(lambda t: orders(t).where(lambda x: x.o_totalprice < 0.0).any_df())
query("agg_sum", "SELECT sum(l_linenumber)::BIGINT AS value FROM lineitem")(lambda t: items(t).maybe_deleted().sum_df("l_linenumber"))
query("agg_sum_double", "SELECT round(sum(o_totalprice), 2) AS value FROM orders")(lambda t: orders(t).sum_df("o_totalprice").select(F.round("value", 2).alias("value")))
query("agg_sum_empty", "SELECT 0::BIGINT AS value")(lambda t: orders(t).where(lambda x: x.o_custkey < 0).sum_df("o_custkey"))
query("agg_min_max", "SELECT min(o_totalprice) AS low, max(o_totalprice) AS high FROM orders")(lambda t: orders(t).min_df("o_totalprice", "low").crossJoin(orders(t).max_df("o_totalprice", "high")))
query("agg_min_max_string", "SELECT min(c_name) AS low, max(c_name) AS high FROM customer")(lambda t: customers(t).min_df("c_name", "low").crossJoin(customers(t).max_df("c_name", "high")))
query("agg_avg", "SELECT round(avg(c_acctbal), 4) AS value FROM customer")(lambda t: customers(t).avg_df("c_acctbal").select(F.round("value", 4).alias("value")))
query("agg_avg_empty", "SELECT 0.0::DOUBLE AS value")(lambda t: customers(t).where(lambda x: x.c_custkey < 0).avg_df("c_acctbal"))
query("agg_sum_over_page", "SELECT sum(o_custkey)::BIGINT AS value FROM (SELECT o_custkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 100 OFFSET 10)")(
    lambda t: orders(t).order_by_descending("o_totalprice").then_by("o_orderkey").skip(10).take(100).sum_df("o_custkey")
)
query("count_over_page", "SELECT count(*) AS n FROM (SELECT 1 FROM orders LIMIT 37)")(lambda t: orders(t).take(37).count_df())
query("count_distinct_projection", "SELECT count(*) AS n FROM (SELECT DISTINCT o_custkey FROM orders)")(lambda t: orders(t).select(c="o_custkey").distinct().count_df())
query("group_count", "SELECT o_orderstatus AS status, count(*) AS n FROM orders GROUP BY 1")(lambda t: orders(t).group_by("o_orderstatus").select(status="key", n="count").to_df())
query("group_all_aggregates", "SELECT o_orderpriority AS priority, count(*) AS n, sum(o_custkey)::BIGINT AS total, min(o_totalprice) AS low, max(o_totalprice) AS high, round(avg(o_custkey), 4) AS mean FROM orders GROUP BY 1")(
    lambda t: orders(t).group_by("o_orderpriority").select(priority="key", n="count", total=("sum", "o_custkey"), low=("min", "o_totalprice"), high=("max", "o_totalprice"), mean=("avg", "o_custkey")).to_df().withColumn("mean", F.round("mean", 4))
)
query("group_where_before", "SELECT o_custkey AS customer, count(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY 1")(lambda t: orders(t).where(lambda x: x.o_orderstatus == "F").group_by("o_custkey").select(customer="key", n="count").to_df())
query("group_having", "SELECT o_custkey AS customer, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) > 15")(lambda t: orders(t).group_by("o_custkey").where(lambda g: g.n > 15).select(customer="key", n="count").to_df())
query("group_having_compound", "SELECT o_custkey AS customer, count(*) AS n, max(o_totalprice) AS high FROM orders GROUP BY 1 HAVING (count(*) > 15 AND max(o_totalprice) < 490000) OR NOT (o_custkey > 20)")(
    lambda t: orders(t).group_by("o_custkey").where(lambda g: ((g.n > 15) & (g.high < 490000)) | ~(g.key > 20)).select(customer="key", n="count", high=("max", "o_totalprice")).to_df()
)
query("group_order_by_agg", "SELECT o_custkey AS customer, count(*) AS n FROM orders GROUP BY 1 ORDER BY n DESC, customer LIMIT 20")(
    lambda t: orders(t).group_by("o_custkey").select(customer="key", n="count").order_by_descending("n").then_by("customer").take(20).to_df()
)
query("group_paged", "SELECT o_custkey AS customer, count(*) AS n FROM orders GROUP BY 1 ORDER BY customer LIMIT 10 OFFSET 20")(
    lambda t: orders(t).group_by("o_custkey").select(customer="key", n="count").order_by("customer").skip(20).take(10).to_df()
)
query("count_groups", "SELECT count(*) AS n FROM (SELECT o_custkey FROM orders GROUP BY 1)")(lambda t: orders(t).group_by("o_custkey").select(customer="key").count_df())
query("group_by_timestamp_ms", "SELECT date_trunc('milliseconds', ts) AS at, count(*) AS n FROM events GROUP BY 1")(lambda t: events(t).group_by("ts").select(at="key", n="count").to_df())
FLAGSHIP = "SELECT o_orderpriority AS priority, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders WHERE o_orderstatus = 'F' GROUP BY 1 HAVING count(*) > 10 ORDER BY total DESC LIMIT 4"


def flagship(t: Source) -> DataFrame:
    q = orders(t).where(lambda x: x.o_orderstatus == "F").group_by("o_orderpriority").where(lambda g: g.n > 10)
    return q.select(priority="key", n="count", total=("sum", "o_totalprice")).order_by_descending("total").take(4).to_df().withColumn("total", F.round("total", 2))


query("flagship", FLAGSHIP)(flagship)

# Order and paging.
PICK = dict(o_orderkey="o_orderkey", o_totalprice="o_totalprice")
query("order_by", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 25")(lambda t: orders(t).order_by("o_totalprice").then_by("o_orderkey").take(25).select(**PICK).to_df())
query("order_by_desc_then_by", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderpriority DESC, o_totalprice, o_orderkey LIMIT 25")(
    lambda t: orders(t).order_by_descending("o_orderpriority").then_by("o_totalprice").then_by("o_orderkey").take(25).select(**PICK).to_df()
)
query("take", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'P' ORDER BY o_orderkey LIMIT 12")(lambda t: orders(t).take(12).order_by("o_orderkey").where(lambda x: x.o_orderstatus == "P").select(**PICK).to_df())
query("skip", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey OFFSET 50")(lambda t: orders(t).order_by("o_orderkey").skip(50).select(**PICK).to_df())
query("skip_take", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10 OFFSET 30")(lambda t: orders(t).order_by_descending("o_totalprice").then_by("o_orderkey").skip(30).take(10).select(**PICK).to_df())
query("first", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 1")(lambda t: orders(t).order_by("o_totalprice").then_by("o_orderkey").select(**PICK).first_df())
query("last", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey DESC LIMIT 1")(lambda t: orders(t).order_by("o_totalprice").then_by("o_orderkey").select(**PICK).last_df())
query("last_over_page", "SELECT o_orderkey, o_totalprice FROM (SELECT * FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 10) ORDER BY o_totalprice DESC, o_orderkey DESC LIMIT 1")(
    lambda t: orders(t).order_by("o_totalprice").then_by("o_orderkey").take(10).last_df().select("o_orderkey", "o_totalprice")
)
query("paged_list", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'O' ORDER BY o_orderkey LIMIT 20 OFFSET 40")(lambda t: orders(t).where(lambda x: x.o_orderstatus == "O").order_by("o_orderkey").select(**PICK).page_df(3, 20))
query("paged_list_total", "SELECT count(*) AS total FROM orders WHERE o_orderstatus = 'O'")(lambda t: orders(t).where(lambda x: x.o_orderstatus == "O").order_by("o_orderkey").take(5).total_df())
query("paged_past_end", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 20 OFFSET 20000000")(lambda t: orders(t).order_by("o_orderkey").select(**PICK).page_df(1000001, 20))


def _cursor(t: Source) -> Query:
    return orders(t).order_by_descending("o_orderpriority").then_by("o_totalprice").then_by("o_orderkey")


SEEK = "(o_orderpriority < '3-MEDIUM' OR (o_orderpriority = '3-MEDIUM' AND o_totalprice > 250000) OR (o_orderpriority = '3-MEDIUM' AND o_totalprice = 250000 AND o_orderkey > 7))"
CURSOR = "SELECT o_orderkey, o_orderpriority, o_totalprice FROM orders"
query("cursor_first_page", f"{CURSOR} ORDER BY o_orderpriority DESC, o_totalprice, o_orderkey LIMIT 15")(lambda t: _cursor(t).cursor_df(15).select("o_orderkey", "o_orderpriority", "o_totalprice"))
query("cursor_next_page", f"{CURSOR} WHERE {SEEK} ORDER BY o_orderpriority DESC, o_totalprice, o_orderkey LIMIT 15")(lambda t: _cursor(t).cursor_df(15, ["3-MEDIUM", 250000.0, 7]).select("o_orderkey", "o_orderpriority", "o_totalprice"))
query("cursor_mixed_direction", f"{CURSOR} WHERE {SEEK} ORDER BY o_orderpriority DESC, o_totalprice, o_orderkey LIMIT 100")(lambda t: _cursor(t).cursor_df(100, ["3-MEDIUM", 250000.0, 7]).select("o_orderkey", "o_orderpriority", "o_totalprice"))

# Joins.
DAYS = dict(k=lambda c, o: o.o_orderkey, name=lambda c, o: c.c_name)


def _co(t: Source, outer: bool = False, inner: Callable | None = None) -> Join:
    right = orders(t) if inner is None else orders(t).where(inner)
    j = Join.of("c", customers(t))
    return j.left("o", right, ("c.c_custkey", "o_custkey")) if outer else j.inner("o", right, ("c.c_custkey", "o_custkey"))


query("join_inner", "SELECT o.o_orderkey AS k, c.c_name AS name FROM customer c JOIN orders o ON c.c_custkey = o.o_custkey")(lambda t: _co(t).select(**DAYS))
query("join_left", "SELECT o.o_orderkey AS k, c.c_name AS name FROM customer c LEFT JOIN orders o ON c.c_custkey = o.o_custkey")(lambda t: _co(t, True).select(**DAYS))
query("join_left_on_filter", "SELECT o.o_orderkey AS k, c.c_name AS name FROM customer c LEFT JOIN orders o ON c.c_custkey = o.o_custkey AND o.o_totalprice > 480000")(lambda t: _co(t, True, lambda x: x.o_totalprice > 480000.0).select(**DAYS))
query("join_left_where_filter", "SELECT o.o_orderkey AS k, c.c_name AS name FROM customer c LEFT JOIN orders o ON c.c_custkey = o.o_custkey WHERE o.o_totalprice > 480000")(lambda t: _co(t, True).where(lambda c, o: o.o_totalprice > 480000.0).select(**DAYS))


def _chain(t: Source) -> Join:
    return _co(t).inner("n", Query(t("nation"), NATION), ("c.c_nationkey", "n_nationkey"))


CHAIN = "orders o JOIN customer c ON c.c_custkey = o.o_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey"
query("join_chain_3", f"SELECT o.o_orderkey AS k, n.n_name AS nation FROM {CHAIN}")(lambda t: _chain(t).select(k=lambda c, o, n: o.o_orderkey, nation=lambda c, o, n: n.n_name))
query("join_chain_5", f"SELECT o.o_orderkey AS k, r.r_name AS region, l.l_linenumber AS line FROM {CHAIN} JOIN region r ON n.n_regionkey = r.r_regionkey JOIN lineitem l ON l.l_orderkey = o.o_orderkey")(
    lambda t: _chain(t).inner("r", Query(t("region"), REGION), ("n.n_regionkey", "r_regionkey")).inner("l", items(t).maybe_deleted(), ("o.o_orderkey", "l_orderkey")).select(k=lambda c, o, n, r, l: o.o_orderkey, region=lambda c, o, n, r, l: r.r_name, line=lambda c, o, n, r, l: l.l_linenumber)
)
query("join_left_after_inner", f"SELECT n.n_name AS nation, s.s_name AS supplier FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey LEFT JOIN supplier s ON s.s_nationkey = n.n_nationkey AND s.s_acctbal > 9000")(
    lambda t: Join.of("n", Query(t("nation"), NATION)).inner("r", Query(t("region"), REGION), ("n.n_regionkey", "r_regionkey")).left("s", Query(t("supplier"), SUPPLIER).where(lambda x: x.s_acctbal > 9000.0), ("n.n_nationkey", "s_nationkey")).select(nation=lambda n, r, s: n.n_name, supplier=lambda n, r, s: s.s_name)
)
query("join_self", "SELECT a.n_name AS one, b.n_name AS other FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey WHERE a.n_nationkey < b.n_nationkey")(
    lambda t: Join.of("a", Query(t("nation"), NATION)).inner("b", Query(t("nation"), NATION), ("a.n_regionkey", "n_regionkey")).where(lambda a, b: a.n_nationkey < b.n_nationkey).select(one=lambda a, b: a.n_name, other=lambda a, b: b.n_name)
)
query("join_order_inner_side", "SELECT o.o_orderkey AS k, c.c_name AS name FROM customer c JOIN orders o ON c.c_custkey = o.o_custkey ORDER BY o.o_totalprice DESC, o.o_orderkey LIMIT 20")(
    lambda t: _co(t).order_by(lambda c, o: o.o_totalprice, True).order_by(lambda c, o: o.o_orderkey).take(20).select(**DAYS)
)
query("join_count", "SELECT count(*) AS n FROM customer c JOIN orders o ON c.c_custkey = o.o_custkey")(lambda t: _co(t).count_df())
query("join_any", "SELECT count(*) > 0 AS found FROM customer c JOIN orders o ON c.c_custkey = o.o_custkey WHERE o.o_totalprice > 499900")(lambda t: _co(t).where(lambda c, o: o.o_totalprice > 499900.0).any_df())
query("join_sum_inner_side", "SELECT sum(o.o_orderkey)::BIGINT AS value FROM customer c JOIN orders o ON c.c_custkey = o.o_custkey WHERE c.c_acctbal > 5000")(lambda t: _co(t).where(lambda c, o: c.c_acctbal > 5000.0).aggregate_df("sum", lambda c, o: o.o_orderkey))
query("join_sum_left_skips_null", "SELECT coalesce(sum(o.o_orderkey), 0)::BIGINT AS value FROM customer c LEFT JOIN orders o ON c.c_custkey = o.o_custkey AND o.o_totalprice > 480000")(lambda t: _co(t, True, lambda x: x.o_totalprice > 480000.0).aggregate_df("sum", lambda c, o: o.o_orderkey))
query("join_agg_over_page", "SELECT sum(k)::BIGINT AS value FROM (SELECT o.o_orderkey AS k FROM customer c JOIN orders o ON c.c_custkey = o.o_custkey ORDER BY o.o_orderkey LIMIT 50)")(
    lambda t: _co(t).order_by(lambda c, o: o.o_orderkey).take(50).aggregate_df("sum", lambda c, o: o.o_orderkey)
)
query("join_last", "SELECT o.o_orderkey AS k, c.c_name AS name FROM customer c JOIN orders o ON c.c_custkey = o.o_custkey ORDER BY o.o_orderkey DESC LIMIT 1")(lambda t: _co(t).order_by(lambda c, o: o.o_orderkey).last(**DAYS))
query("join_paged", "SELECT o.o_orderkey AS k, c.c_name AS name FROM customer c JOIN orders o ON c.c_custkey = o.o_custkey ORDER BY o.o_orderkey LIMIT 10 OFFSET 10")(lambda t: _co(t).order_by(lambda c, o: o.o_orderkey).to_page(2, 10, **DAYS).rows)
query("join_whole_document", "SELECT o.o_orderkey, o.o_totalprice FROM customer c LEFT JOIN orders o ON c.c_custkey = o.o_custkey AND o.o_totalprice > 480000")(lambda t: _co(t, True, lambda x: x.o_totalprice > 480000.0).documents("o").select("o.o_orderkey", "o.o_totalprice"))


def _tenant(t: Source, tenant: str | None = "BUILDING") -> Query:
    return Query(t("customer"), TENANT, tenant)


query("join_both_tenant_scoped", "SELECT a.c_custkey AS one, b.c_custkey AS other FROM customer a JOIN customer b ON a.c_custkey = b.c_custkey WHERE a.c_mktsegment = 'BUILDING' AND b.c_mktsegment = 'BUILDING'")(
    lambda t: Join.of("a", _tenant(t)).inner("b", _tenant(t), ("a.c_custkey", "c_custkey")).select(one=lambda a, b: a.c_custkey, other=lambda a, b: b.c_custkey)
)

# Implicit filters and point reads.
query("tenant_current", "SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING'")(lambda t: _tenant(t).select(c_custkey="c_custkey").to_df())
query("tenant_any", "SELECT c_custkey FROM customer")(lambda t: _tenant(t).any_tenant().select(c_custkey="c_custkey").to_df())
query("tenant_is_one_of", "SELECT c_custkey FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')")(lambda t: _tenant(t).tenant_is_one_of("BUILDING", "MACHINERY").select(c_custkey="c_custkey").to_df())
ID = dict(l_id="l_id")
WHEN = "TIMESTAMP '1998-06-01'"
JUNE = datetime(1998, 6, 1)
query("soft_delete_live", f"SELECT l_id FROM {LINES} WHERE NOT is_deleted")(lambda t: items(t).select(**ID).to_df())
query("soft_delete_only_deleted", f"SELECT l_id FROM {LINES} WHERE is_deleted")(lambda t: items(t).is_deleted().select(**ID).to_df())
query("soft_delete_maybe", f"SELECT l_id FROM {LINES}")(lambda t: items(t).maybe_deleted().select(**ID).to_df())
query("deleted_since", f"SELECT l_id FROM {LINES} WHERE is_deleted AND deleted_at >= {WHEN}")(lambda t: items(t).deleted_since(JUNE).select(**ID).to_df())
query("deleted_before", f"SELECT l_id FROM {LINES} WHERE is_deleted AND deleted_at < {WHEN}")(lambda t: items(t).deleted_before(JUNE).select(**ID).to_df())
query("hierarchy_subclass", f"SELECT l_id FROM {LINES} WHERE NOT is_deleted AND l_linestatus = 'O'")(lambda t: items(t).of_type("open").select(**ID).to_df())
query("hierarchy_base", f"SELECT l_id FROM {LINES} WHERE NOT is_deleted AND l_linestatus IN ('O', 'F')")(lambda t: items(t).of_type("any").select(**ID).to_df())
query("modified_since", f"SELECT l_id FROM {LINES} WHERE NOT is_deleted AND l_shipdate >= {WHEN}")(lambda t: items(t).modified_since(JUNE).select(**ID).to_df())
query("modified_before", f"SELECT l_id FROM {LINES} WHERE NOT is_deleted AND l_shipdate < {WHEN}")(lambda t: items(t).modified_before(JUNE).select(**ID).to_df())
query("load_by_id", "SELECT c_custkey, c_name FROM customer WHERE c_custkey = 42")(lambda t: customers(t).load(42).select("c_custkey", "c_name"))
query("load_many", "SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (1, 2, 3, 99999999)")(lambda t: customers(t).load_many([1, 2, 3, 99999999]).select("c_custkey", "c_name"))
query("load_many_joined", "SELECT c_custkey, c_name FROM customer WHERE c_custkey < 1200")(lambda t: customers(t).load_many(list(range(1200))).select("c_custkey", "c_name"))
query("load_json", """SELECT '{"r_regionkey":' || r_regionkey || ',"r_name":"' || r_name || '"}' AS json FROM region WHERE r_regionkey = 2""")(lambda t: Query(t("region").select("r_regionkey", "r_name"), REGION).where(lambda x: x.r_regionkey == 2).to_json())
query("document_metadata", f"SELECT l_orderkey, l_linestatus, l_shipdate, is_deleted, deleted_at FROM {LINES} WHERE l_orderkey = 15")(lambda t: items(t).df.transform(lambda d: Query(d, Mapping("l_orderkey", deleted="is_deleted", deleted_at="deleted_at", kind="l_linestatus", modified="l_shipdate")).metadata(15)))

# Event log.
E4 = ["seq_id", "stream_id", "version", "type"]
query("fetch_stream", f"SELECT seq_id, stream_id, version, type FROM {LOG} WHERE stream_id = 8")(lambda t: ev.EventLog(log(t)).fetch_stream(8).select(*E4))
query("fetch_stream_to_version", f"SELECT seq_id, stream_id, version, type FROM {LOG} WHERE stream_id = 8 AND version <= 5")(lambda t: ev.EventLog(log(t)).fetch_stream(8, version=5).select(*E4))
query("fetch_stream_from_version", f"SELECT seq_id, stream_id, version, type FROM {LOG} WHERE stream_id = 8 AND version >= 5")(lambda t: ev.EventLog(log(t)).fetch_stream(8, from_version=5).select(*E4))
query("fetch_stream_as_of", f"SELECT seq_id, stream_id, version, type FROM {LOG} WHERE stream_id = 8 AND timestamp <= TIMESTAMP '2024-01-15'")(lambda t: ev.EventLog(log(t)).fetch_stream(8, timestamp=MIDDLE).select(*E4))
query("fetch_stream_known_types", f"SELECT seq_id, stream_id, version, type FROM {LOG} WHERE stream_id = 8 AND type IN ('view', 'click')")(lambda t: ev.EventLog(log(t)).fetch_stream(8, known=["view", "click"]).select(*E4))
query("stream_state", "SELECT user_id AS stream_id, count(*) AS version, min(ts) AS created, max(ts) AS timestamp FROM events WHERE user_id = 8 GROUP BY 1")(lambda t: ev.EventLog(log(t)).stream_state(8))
query("load_event", "SELECT event_id AS seq_id, event_type AS type FROM events WHERE event_id = 77")(lambda t: ev.EventLog(log(t, False)).load(77).select("seq_id", "type"))
query("events_where", "SELECT event_id AS seq_id, event_type AS type FROM events WHERE event_type = 'error' AND event_id > 100")(lambda t: ev.EventLog(log(t, False)).where((F.col("type") == "error") & (F.col("seq_id") > 100)).select("seq_id", "type"))
query("events_paged", "SELECT event_id AS seq_id, user_id AS stream_id FROM events WHERE event_type = 'click' ORDER BY event_id LIMIT 50 OFFSET 50")(lambda t: ev.EventLog(log(t, False)).page(2, 50, type="click").select("seq_id", "stream_id"))
query("events_paged_total", "SELECT count(*) AS total FROM events WHERE event_type = 'click' AND user_id = 8")(lambda t: ev.EventLog(log(t, False)).page_total(type="click", stream_id=8))
query("event_body_query", "SELECT event_id AS seq_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events WHERE event_type = 'purchase' AND CAST(json_extract_string(props, '$.k') AS INTEGER) > 90")(
    lambda t: ev.EventLog(log(t, False)).bodies("purchase", "k int", F.col("body.k") > 90).select("seq_id", "body.k")
)
query("recent_streams", "SELECT user_id AS stream_id, count(*) AS version FROM events GROUP BY 1 ORDER BY max(ts) DESC, 1 LIMIT 10")(lambda t: ev.EventLog(log(t)).recent_streams(10).select("stream_id", "version"))
query("event_statistics", "SELECT count(*) AS event_count, count(DISTINCT user_id) AS stream_count, max(event_id) AS highest_sequence FROM events")(lambda t: ev.EventLog(log(t, False)).statistics())
query("store_floor_at_time", "SELECT coalesce(max(event_id), 0) AS floor FROM events WHERE ts <= TIMESTAMP '2024-01-15'")(lambda t: ev.EventLog(log(t, False)).floor_at(MIDDLE))
query("daemon_page", "SELECT event_id AS seq_id FROM events WHERE event_id > 100 AND event_id <= 400 ORDER BY event_id LIMIT 200")(lambda t: ev.EventLog(log(t, False)).daemon_page(100, 400, 200).select("seq_id"))
query("daemon_page_type_filter", "SELECT event_id AS seq_id FROM events WHERE event_id > 100 AND event_id <= 900 AND event_type IN ('view', 'error') ORDER BY event_id LIMIT 100")(lambda t: ev.EventLog(log(t, False)).daemon_page(100, 900, 100, ["view", "error"]).select("seq_id"))
ARCHIVED = "user_id % 10 = 3"


def _archived(t: Source, versions: bool = False) -> DataFrame:
    e = log(t, versions)
    return ev.archive(e, e.where(F.col("stream_id") % 10 == 3).select("stream_id"))


query("daemon_skips_archived", f"SELECT event_id AS seq_id FROM events WHERE event_id <= 500 AND NOT ({ARCHIVED}) ORDER BY event_id LIMIT 1000")(lambda t: ev.EventLog(_archived(t)).daemon_page(-1, 500, 1000).select("seq_id"))
query("archive_filter", f"SELECT event_id AS seq_id, {ARCHIVED} AS is_archived FROM events")(lambda t: _archived(t).select("seq_id", "is_archived"))
query("unarchived_stream_reads", f"SELECT seq_id, version FROM {LOG} WHERE stream_id = 13")(lambda t: ev.EventLog(_archived(t, True)).fetch_stream(13).select("seq_id", "version"))


def _tags(t: Source) -> dict[str, DataFrame]:
    e = log(t, False)
    k = F.get_json_object("data", "$.k").cast("int")
    return {"k": e.select(k.alias("value"), "seq_id"), "day": e.select(F.date_format("timestamp", "yyyy-MM-dd").alias("value"), "seq_id")}


K = "CAST(json_extract_string(props, '$.k') AS INTEGER)"
query("tag_query_or", f"SELECT event_id AS seq_id FROM events WHERE {K} = 7 OR strftime(ts, '%Y-%m-%d') = '2024-01-03'")(lambda t: ev.EventLog(log(t, False)).by_tags([ev.TagCondition("k", 7), ev.TagCondition("day", "2024-01-03")], _tags(t)).select("seq_id"))
query("tag_query_typed", f"SELECT event_id AS seq_id FROM events WHERE ({K} = 7 AND event_type = 'view') OR {K} = 9")(lambda t: ev.EventLog(log(t, False)).by_tags([ev.TagCondition("k", 7, "view"), ev.TagCondition("k", 9)], _tags(t)).select("seq_id"))
query("tag_query_empty", "SELECT event_id AS seq_id FROM events WHERE false")(lambda t: ev.EventLog(log(t, False)).by_tags([], _tags(t)).select("seq_id"))
query("tag_exists", f"SELECT count(*) > 0 AS found FROM events WHERE {K} = 7")(lambda t: ev.EventLog(log(t, False)).by_tags([ev.TagCondition("k", 7)], _tags(t)).limit(1).agg((F.count(F.lit(1)) > 0).alias("found")))
query("assign_tags", f"SELECT count(*) AS n FROM (SELECT {K} AS v, event_id FROM events UNION SELECT 7, event_id FROM events WHERE event_type = 'error')")(lambda t: ev.assign_tags(_tags(t)["k"], log(t, False).where("type = 'error'"), 7).agg(F.count(F.lit(1)).alias("n")))


def _keys(t: Source) -> DataFrame:
    e = log(t)
    return ev.natural_keys(e.where("version = 1"), F.concat(F.lit("user-"), F.col("stream_id").cast("string")))


query("natural_key_lookup", "SELECT 'user-8' AS value, 8::BIGINT AS stream_id, count(*) AS version FROM events WHERE user_id = 8")(lambda t: ev.EventLog(log(t)).resolve_key(_keys(t), "user-8"))
query("natural_key_conflicts", f"SELECT {K} AS value, count(DISTINCT user_id) AS streams FROM events GROUP BY 1 HAVING count(DISTINCT user_id) > 1")(lambda t: ev.key_conflicts(ev.natural_keys(log(t, False), F.get_json_object("data", "$.k").cast("int"))))
query("assign_versions", "SELECT event_id AS seq_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS version FROM events")(lambda t: log(t).select("seq_id", "version"))
query("conversation_stream", "SELECT conv_id, turn, role FROM conversations WHERE conv_id = 1")(
    lambda t: ev.EventLog(t("conversations").withColumnsRenamed({"conv_id": "stream_id", "turn": "version"})).fetch_stream(1).select(F.col("stream_id").alias("conv_id"), F.col("version").alias("turn"), "role")
)

# Folds: an account that a signup opens, views, clicks and purchases count in, and an error closes.
ACCOUNT = (
    Fold({"views": ("bigint", 0), "clicks": ("bigint", 0), "last_k": ("int", None), "opened": ("bigint", None)})
    .create("signup", opened=lambda s, e: e["seq_id"])
    .apply("view", views=lambda s, e: s["views"] + 1)
    .apply("click", clicks=lambda s, e: s["clicks"] + 1, last_k=lambda s, e: F.get_json_object(e["data"], "$.k").cast("int"))
)
CLOSING = ACCOUNT.delete("error")


def _folds(rows: str, closing: bool = False) -> str:
    """The fold in SQL: what follows the last closing event of a stream counts, if anything does."""
    live = f"(SELECT e.* FROM (SELECT * FROM {rows} WHERE type IN ('signup', 'view', 'click', 'error')) e LEFT JOIN (SELECT stream_id, max(version) AS gone FROM {rows} WHERE type = 'error' GROUP BY 1) g ON e.stream_id = g.stream_id WHERE g.gone IS NULL OR e.version > g.gone)" if closing else f"(SELECT * FROM {rows} WHERE type IN ('signup', 'view', 'click'))"
    opened = "CASE WHEN min(version) = min(version) FILTER (type = 'signup') THEN arg_min(seq_id, version) FILTER (type = 'signup') END"
    return f"SELECT stream_id, count(*) FILTER (type = 'view') AS views, count(*) FILTER (type = 'click') AS clicks, arg_max(CAST(json_extract_string(data, '$.k') AS INTEGER), version) FILTER (type = 'click') AS last_k, {opened} AS opened FROM {live} GROUP BY 1"


query("single_stream_projection", _folds(LOG))(lambda t: ACCOUNT.project(log(t)))
query("aggregate_should_delete", _folds(LOG, True))(lambda t: CLOSING.project(log(t)))
query("aggregate_stream", _folds(f"(SELECT * FROM {LOG} WHERE stream_id = 8)"))(lambda t: ACCOUNT.project(ev.EventLog(log(t)).fetch_stream(8)))
query("aggregate_to_version", _folds(f"(SELECT * FROM {LOG} WHERE version <= 10)"))(lambda t: ACCOUNT.project(to_version(log(t), 10)))
query("aggregate_as_of", _folds(f"(SELECT * FROM {LOG} WHERE timestamp <= TIMESTAMP '2024-01-15')"))(lambda t: ACCOUNT.project(as_of(log(t), MIDDLE)))
query("aggregate_from_state", "SELECT stream_id, views, clicks FROM (" + _folds(LOG) + ")")(
    lambda t: ACCOUNT.project(log(t).where("version > 10"), start=ACCOUNT.project(to_version(log(t), 10))).select("stream_id", "views", "clicks")
)
KNOWN = f"""(SELECT e.* FROM {LOG} e JOIN (SELECT a.stream_id, a.last, max(b.version) AS gone FROM (SELECT stream_id, max(version) AS last FROM {LOG} WHERE type IN ('signup', 'view', 'click') GROUP BY 1) a
  LEFT JOIN (SELECT * FROM {LOG} WHERE type = 'error') b ON a.stream_id = b.stream_id AND b.version < a.last GROUP BY 1, 2) k ON e.stream_id = k.stream_id WHERE e.version <= k.last AND (k.gone IS NULL OR e.version > k.gone))"""
query("aggregate_last_known", _folds(KNOWN))(lambda t: CLOSING.last_known(log(t)))
query("aggregate_by_tags", f"SELECT {K} AS k, count(*) FILTER (event_type = 'view') AS views FROM events WHERE {K} IN (7, 9) AND event_type IN ('signup', 'view', 'click') GROUP BY 1")(
    lambda t: ACCOUNT.project(ev.EventLog(log(t, False)).by_tags([ev.TagCondition("k", 7), ev.TagCondition("k", 9)], _tags(t)).withColumn("k", F.get_json_object("data", "$.k").cast("int")), "k", "seq_id").select("k", "views")
)
query("projection_timeline", f"SELECT stream_id, version, type, true AS alive, count(*) FILTER (type = 'view') OVER w AS views FROM {LOG} WHERE stream_id = 8 AND type IN ('signup', 'view', 'click') WINDOW w AS (PARTITION BY stream_id ORDER BY version)")(
    lambda t: ACCOUNT.timeline(ev.EventLog(log(t)).fetch_stream(8)).select("stream_id", "version", "type", "alive", "views")
)
query("compact_stream", "SELECT user_id AS stream_id, max(event_id) AS seq_id FROM events GROUP BY 1 HAVING count(*) FILTER (event_type IN ('signup', 'view', 'click')) > 0")(
    lambda t: compact(log(t), ACCOUNT).where("compacted is not null or version = 1").select("stream_id", "seq_id")
)
query("fold_after_compaction", "SELECT stream_id, views, clicks FROM (" + _folds(LOG) + ")")(lambda t: resume(compact(log(t), ACCOUNT), ACCOUNT).select("stream_id", "views", "clicks"))

# Projections of many streams.
COUNTER = Fold({"n": ("bigint", 0), "last": ("bigint", None)}).apply("view", n=lambda s, e: s["n"] + 1, last=lambda s, e: e["value"].cast("bigint")).apply("click", n=lambda s, e: s["n"] + 10)
query("multi_stream_identity", f"SELECT {K} AS doc_key, (count(*) FILTER (event_type = 'view') + 10 * count(*) FILTER (event_type = 'click'))::BIGINT AS n FROM events WHERE event_type IN ('view', 'click') GROUP BY 1")(
    lambda t: MultiStream(COUNTER, identity={k: F.get_json_object("data", "$.k").cast("int") for k in ("view", "click")}).project(log(t)).select("doc_key", "n")
)
query("multi_stream_identities", f"SELECT doc_key, count(*) AS n FROM (SELECT unnest(CASE WHEN {K} % 5 = user_id % 5 THEN [({K} % 5)::BIGINT] ELSE [({K} % 5)::BIGINT, user_id % 5] END) AS doc_key FROM events WHERE event_type = 'view') GROUP BY 1")(
    lambda t: MultiStream(COUNTER, identities={"view": F.array((F.get_json_object("data", "$.k").cast("int") % 5).cast("long"), F.col("stream_id") % 5)}).project(log(t)).select("doc_key", "n")
)
query("multi_stream_fan_out", f"SELECT doc_key, count(*) AS n FROM (SELECT unnest([({K} % 3)::INTEGER, ({K} % 4)::INTEGER]) AS doc_key FROM events WHERE event_type = 'purchase') GROUP BY 1")(
    lambda t: MultiStream(COUNTER, fan_out={"purchase": ("view", F.transform(F.array(F.lit(3), F.lit(4)), lambda m: F.get_json_object("data", "$.k").cast("int") % m), lambda c: c)}).project(log(t)).select("doc_key", "n")
)
query("event_projection_create", "SELECT event_id AS id, user_id AS customer, round(value, 2) AS amount FROM events WHERE event_type = 'purchase'")(
    lambda t: EventProjection({"sales": {"purchase": {"id": F.col("seq_id"), "customer": F.col("stream_id"), "amount": F.round("value", 2)}}}).project(log(t, False))["sales"]
)
query("flat_table_map_set", "SELECT user_id AS key, arg_max(event_type, event_id) AS status, arg_max(value, event_id) FILTER (event_type = 'purchase') AS last_value FROM events WHERE event_type IN ('purchase', 'click') GROUP BY 1")(
    lambda t: FlatTable(F.col("stream_id"), {"status": "string", "last_value": "double"}, {"purchase": {"status": set_to("purchase"), "last_value": set_to(F.col("value"))}, "click": {"status": set_to("click")}}).project(log(t, False))
)
FIRST = "(SELECT *, min(event_id) OVER (PARTITION BY user_id) AS first FROM events WHERE event_type IN ('signup', 'view'))"
query("flat_table_increment", f"SELECT user_id AS key, CASE WHEN bool_or(event_id = first AND event_type = 'view') THEN count(*) FILTER (event_type = 'view') WHEN bool_or(event_type = 'signup') AND max(event_id) FILTER (event_type = 'signup') IS NOT NULL THEN NULL END AS views FROM {FIRST} GROUP BY 1")(
    lambda t: FlatTable(F.col("stream_id"), {"views": "bigint"}, {"signup": {}, "view": {"views": increment()}}).project(log(t, False))
)
query("flat_table_decrement_quirk", f"SELECT user_id AS key, sum(CASE WHEN event_id = first THEN {K} ELSE -{K} END)::BIGINT AS by_member, sum(CASE WHEN event_id = first THEN 0 ELSE -1 END)::BIGINT AS by_one FROM (SELECT *, min(event_id) OVER (PARTITION BY user_id) AS first FROM events WHERE event_type = 'view') GROUP BY 1")(
    lambda t: FlatTable(F.col("stream_id"), {"by_member": "bigint", "by_one": "bigint"}, {"view": {"by_member": decrement(F.get_json_object("data", "$.k").cast("int")), "by_one": decrement()}}).project(log(t, False))
)
query("flat_table_delete", "SELECT e.user_id AS key, count(*) AS views FROM events e LEFT JOIN (SELECT user_id, max(event_id) AS gone FROM events WHERE event_type = 'error' GROUP BY 1) g ON e.user_id = g.user_id WHERE e.event_type = 'view' AND (g.gone IS NULL OR e.event_id > g.gone) GROUP BY 1")(
    lambda t: FlatTable(F.col("stream_id"), {"views": "bigint"}, {"view": {"views": increment()}}, ("error",)).project(log(t, False))
)
query("flat_table_hot_key", "SELECT event_type AS key, count(*) AS n FROM events GROUP BY 1")(lambda t: FlatTable(F.col("type"), {"n": "bigint"}, {k: {"n": increment()} for k in ("view", "click", "purchase", "signup", "error")}).project(log(t, False)))
query("composite_two_stage", "SELECT user_id AS stream_id, count(*) AS n FROM events WHERE event_type = 'purchase' AND user_id IN (SELECT user_id FROM events WHERE event_type = 'signup') GROUP BY 1")(
    lambda t: Composite((("signed", lambda e, made: e.where("type = 'signup'").select("stream_id").distinct()), ("sales", lambda e, made: e.where("type = 'purchase'").join(made["signed"], "stream_id", "left_semi").groupBy("stream_id").agg(F.count(F.lit(1)).alias("n"))))).project(log(t, False))["sales"]
)
query("tombstone", f"SELECT event_id AS seq_id FROM events WHERE NOT ({ARCHIVED})")(lambda t: ev.tombstone(log(t, False), log(t, False).where("stream_id % 10 = 3")).select("seq_id"))
query("mask_events", "SELECT event_id AS seq_id, CASE WHEN event_type = 'signup' AND user_id < 50 THEN '***' ELSE props END AS data FROM events")(lambda t: ev.mask(log(t, False), {"signup": {"data": F.lit("***")}}, F.col("stream_id") < 50).select("seq_id", "data"))
query("overwrite_event", "SELECT event_id AS seq_id, CASE WHEN event_id % 100 = 0 THEN 0.0 ELSE value END AS value FROM events")(lambda t: ev.overwrite(log(t, False), log(t, False).where("seq_id % 100 = 0").select("seq_id", F.lit(0.0).alias("value"))).select("seq_id", "value"))
query("replace_event", "SELECT event_id AS seq_id, CASE WHEN event_id % 100 = 0 THEN 'gone' ELSE event_type END AS type FROM events")(lambda t: ev.replace_events(log(t, False), {}, log(t, False).where("seq_id % 100 = 0").select("seq_id", F.lit("gone").alias("type"), F.lit("{}").alias("data")))[0].select("seq_id", "type"))
query("delete_events", "SELECT event_id AS seq_id FROM events WHERE event_id % 3 <> 0")(lambda t: ev.delete_events(log(t, False), log(t, False).where("seq_id % 3 = 0")).select("seq_id"))

# Terminals that give a value, not a frame.
query("single_or_default", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey = 17")(
    lambda t: t("orders").sparkSession.createDataFrame([r for r in [orders(t).where(lambda x: x.o_orderkey == 17).select(**PICK).single_or_default()] if r], t("orders").select(*PICK).schema)
)
query("check_exists", "SELECT count(*) > 0 AS found FROM customer WHERE c_custkey = 7")(lambda t: t("customer").sparkSession.createDataFrame([(customers(t).exists(7),)], "found boolean"))

# Writes and patches.


def _patched(name: str, patch: Patch, sql: str, columns: str = "o_orderkey, o_orderstatus, o_totalprice") -> None:
    names = [c.strip() for c in columns.split(",")]
    query(name, f"SELECT {sql} FROM orders")(lambda t: patch.apply_where(t("orders").select("o_orderkey", "o_orderstatus", "o_totalprice"), F.col("o_orderkey") % 2 == 0).select(*names))


_patched("patch_set", Patch().set("o_orderstatus", "X"), "o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus, o_totalprice")
_patched("patch_increment", Patch().increment("o_totalprice", 2.0), "o_orderkey, o_orderstatus, CASE WHEN o_orderkey % 2 = 0 THEN o_totalprice + 2 ELSE o_totalprice END AS o_totalprice")
_patched("patch_chained", Patch().set("o_totalprice", 1.0).increment("o_totalprice", 2.0), "o_orderkey, o_orderstatus, CASE WHEN o_orderkey % 2 = 0 THEN 3.0 ELSE o_totalprice END AS o_totalprice")


def _lists(name: str, patch: Patch, sql: str) -> None:
    """On a list [label, label + 1, label]; results as text."""
    query(name, f"SELECT vec_id, list_aggregate({sql}, 'string_agg', ',') AS l FROM (SELECT vec_id, label AS a, label + 1 AS b FROM embeddings)")(
        lambda t: patch.apply(t("embeddings").select("vec_id", F.array("label", F.col("label") + 1, "label").alias("l"))).select("vec_id", F.array_join(F.col("l").cast("array<string>"), ",").alias("l"))
    )


_lists("patch_append", Patch().append("l", 7), "[a, b, a, 7]")
_lists("patch_append_if_not_exists", Patch().append_if_not_exists("l", 3), "CASE WHEN a = 3 OR b = 3 THEN [a, b, a] ELSE [a, b, a, 3] END")
_lists("patch_insert_at", Patch().insert("l", 9, 1), "[a, 9, b, a]")
_lists("patch_insert_past_end", Patch().insert("l", 9, 10), "[a, b, a, 9]")
_lists("patch_remove", Patch().append("l", 100).remove("l", 5), "list_filter([a, b, a, 100], lambda x: x <> 5)")
query("patch_rename", "SELECT n_nationkey, n_name AS title FROM nation")(lambda t: Patch().rename("n_name", "title").apply(t("nation")).select("n_nationkey", "title"))
query("patch_delete", "SELECT n_nationkey, n_name FROM nation")(lambda t: Patch().delete("n_regionkey").apply(t("nation")))
query("patch_duplicate", "SELECT n_nationkey, n_name, n_name AS other FROM nation")(lambda t: Patch().duplicate("n_name", F.col("n_name"), "other").apply(t("nation")).select("n_nationkey", "n_name", "other"))
query("delete_where", f"SELECT l_id, is_deleted OR l_quantity > 40 AS is_deleted FROM {LINES}")(lambda t: Patch().set("is_deleted", True).apply_where(items(t).df, F.col("l_quantity") > 40, "is_deleted").select("l_id", "is_deleted"))
query("undo_delete_where", f"SELECT l_id, is_deleted AND l_quantity <= 40 AS is_deleted FROM {LINES}")(lambda t: Patch().set("is_deleted", False).apply_where(items(t).df, F.col("is_deleted") & (F.col("l_quantity") > 40)).select("l_id", "is_deleted"))


# Raw SQL.
def _sql(name: str, text: str, args: list | None = None, oracle: str | None = None) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("orders", "customer", "nation", "lineitem")}
        return raw_sql(spark, text, tables, args)

    QUERIES[name] = run
    SQL[name] = oracle or text


def raw_sql(spark: SparkSession, text: str, tables: dict[str, DataFrame], args: list | None = None) -> DataFrame:
    """Any SQL with ``?`` for values and ``{name}`` for tables; tables aren't registered."""
    return spark.sql(text, args=args, **tables) if args else spark.sql(text, **tables)


def _both(name: str, text: str, args: list | None = None, given: str | None = None) -> None:
    plain = text.format(**{t: t for t in ("orders", "customer", "nation", "lineitem")})
    _sql(name, text, args, given or plain)


_both("raw_sql_params", "SELECT o_orderkey FROM {orders} WHERE o_orderstatus = ? AND o_totalprice > ?", ["F", 400000.0], "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 400000")
_both("raw_sql_union", "SELECT c_nationkey AS k FROM {customer} UNION SELECT n_nationkey AS k FROM {nation}")
_both("raw_sql_window", "SELECT o_orderkey, CAST(rank() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS BIGINT) AS place FROM {orders}")
_both("raw_sql_rollup", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM {orders} GROUP BY ROLLUP (o_orderstatus, o_orderpriority)")
_both("raw_sql_anti_join", "SELECT c_custkey FROM {customer} c WHERE NOT EXISTS (SELECT 1 FROM {orders} o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 490000)")
_both("raw_sql_except", "SELECT c_custkey AS k FROM {customer} EXCEPT SELECT o_custkey AS k FROM {orders} WHERE o_totalprice > 480000")

# Whatever goes through a store.
from . import catalog_store  # noqa: E402, F401
