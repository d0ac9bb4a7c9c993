"""Pages that no task holds, against those that Spark takes in one task."""

import pytest
from pyspark.sql import functions as F

from tarn.errors import QueryNotSupported
from tarn.mapping import Mapping
from tarn.operators import pages
from tarn.operators.eventlog import EventLog
from tarn.operators.joins import Join
from tarn.operators.query import Query


@pytest.fixture
def spread(spark, monkeypatch):
    """Every page counts as large, and small shuffles stay in four partitions."""
    monkeypatch.setattr(pages, "SMALL", 0)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield spark
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def numbers(spark, n=1000):
    key = (F.col("id") * 7919) % n
    return spark.range(0, n, 1, 5).select(key.alias("id"), F.when(key % 10 > 0, key % 10).alias("tens"), F.lit(None).alias("none"))


def test_no_task_has_all_rows_after_an_offset(spread):
    rows = Query(numbers(spread), Mapping("id")).order_by("id").skip(50).to_df()
    assert [r.id for r in rows.select("id").collect()] == list(range(50, 1000))
    sizes = [r["count"] for r in rows.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 950 and max(sizes) < 600
    assert rows.schema == numbers(spread).schema


@pytest.mark.parametrize("offset, limit", [(1, None), (250, None), (999, None), (1000, None), (5000, None), (0, 300), (123, 456), (990, 20), (1000, 5), (3, 0), (0, 5000)])
def test_pages_are_exact(spread, offset, limit):
    q = Query(numbers(spread), Mapping("id"))
    want = sorted(range(1000), key=lambda i: (-(i % 10), i))[offset : None if limit is None else offset + limit]
    page = q.order_by_descending("tens").then_by("id").skip(offset)
    page = page if limit is None else page.take(limit)
    assert [r.id for r in page.select(id="id").to_df().collect()] == want
    assert page.count() == len(want) and page.any() == bool(want) == page.any_df().first()[0]
    assert page.sum_df("id").first()[0] == sum(want)


def test_ties_and_rows_without_an_order_are_neither_lost_nor_doubled(spread):
    n = numbers(spread)
    q = Query(n, Mapping("id"))
    page = q.order_by("tens").skip(150).to_df()
    ids = [r.id for r in page.collect()]
    assert len(ids) == len(set(ids)) == 850 and sum(i % 10 == 1 for i in ids) == 50 and not any(i % 10 == 0 for i in ids)
    assert sorted(r.id for r in page.collect()) == sorted(ids)
    twice = Query(n.unionAll(n), Mapping("id")).skip(700).to_df().groupBy("id").count().select("count").collect()
    assert sum(r[0] for r in twice) == 1300 and max(r[0] for r in twice) <= 2


def test_joins_events_and_types_without_a_parquet_form(spread):
    q = Query(numbers(spread), Mapping("id"))
    j = Join.of("a", q).left("b", q, ("a.id", "id")).order_by(lambda a, b: a.id)
    assert [(r.x, r.y) for r in j.skip(990).select(x=lambda a, b: a.id, y=lambda a, b: b.id).collect()] == [(i, i) for i in range(990, 1000)]
    assert [r.b.id for r in j.skip(10).take(5).documents("b").collect()] == list(range(10, 15))
    assert j.skip(990).count_df().first()[0] == 10 and j.skip(990).aggregate_df("sum", lambda a, b: b.id).first()[0] == 9945
    assert j.skip(990).any_df().first()[0] and not j.skip(1000).any_df().first()[0]
    assert [r.seq_id for r in EventLog(numbers(spread).withColumnRenamed("id", "seq_id")).page(3, 20).collect()] == list(range(40, 60))
    odd = Query(numbers(spread).withColumn("span", F.make_interval(F.lit(1))), Mapping("id")).order_by("id").skip(995).to_df()
    assert [r.id for r in odd.select("id").collect()] == list(range(995, 1000))


def test_a_terminal_writes_what_it_needs_only(spread, monkeypatch):
    written, placed = [], pages._placed
    monkeypatch.setattr(pages, "_placed", lambda df, *rest: written.append(df.columns) or placed(df, *rest))
    page = Query(numbers(spread), Mapping("id")).order_by("id").skip(990)
    assert page.count() == 10 and page.any() and page.sum_df("id").first()[0] == 9945
    assert (page.min_df("id").first()[0], page.max_df("tens").first()[0], page.avg_df("id").first()[0]) == (990, 9, 994.5)
    assert len(written) == 6 and all(len(columns) == 1 for columns in written)


def test_a_cluster_without_a_shared_folder_gets_the_same_rows(spread, monkeypatch):
    monkeypatch.setattr(pages, "named_root", lambda spark: None)
    rows = Query(numbers(spread), Mapping("id")).order_by("id").skip(50).to_df()
    assert [r.id for r in rows.select("id").collect()] == list(range(50, 1000))


def test_refusals_stay(spread):
    q = Query(numbers(spread), Mapping("id"))
    for bad in (q.skip(-1), q.take(-1), q.skip(5).take(-1)):
        with pytest.raises(Exception, match="negative|equal to or greater"):
            bad.to_df().collect()
    with pytest.raises(QueryNotSupported):
        q.skip(5).select(x="id").sum_df("id")
