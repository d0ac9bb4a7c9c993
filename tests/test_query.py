from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tarn.errors import QueryNotSupported
from tarn.mapping import Mapping
from tarn.operators.joins import Join
from tarn.operators.query import Query, decode_cursor, encode_cursor

PEOPLE = Mapping("id", names=frozenset({"grade"}))
CATCH = Mapping("id")


@pytest.fixture(scope="module")
def people(spark):
    rows = [("a", "Frodo", 33, True, "High", "Bag End"), ("b", "Samwise", 38, True, "Pass", "Bag End"), ("c", "Merry", 36, False, "Pass", "Buckland"), ("d", None, None, False, "Pass", None), ("e", "50%_o'É", 28, None, None, "x")]
    df = spark.createDataFrame(rows, "id string, name string, age int, active boolean, grade string, city string")
    return Query(df.withColumn("home", F.struct("city")), PEOPLE)


def ids(q):
    return sorted(r["id"] for r in q.to_df().collect())


def test_filters(people):
    assert ids(people.where(lambda x: x.age > 33)) == ["b", "c"]
    assert ids(people.where(lambda x: 33 < x.age)) == ["b", "c"]
    assert ids(people.where(lambda x: x.active)) == ["a", "b"]
    assert ids(people.where(lambda x: ~x.active)) == ["c", "d"]
    assert ids(people.where(lambda x: ~(x.age > 33))) == ["a", "e"]
    assert ids(people.where(lambda x: x.name == None)) == ["d"]  # noqa: E711
    assert ids(people.where(lambda x: x.age.is_in([]))) == []
    assert ids(people.where(lambda x: x["home.city"] == "Bag End")) == ["a", "b"]
    assert ids(people.where(lambda x: (x.age % 0) == 0)) == []
    assert ids(people.where(True)) == list("abcde") and ids(people.where(False)) == []


def test_strings(people):
    assert ids(people.where(lambda x: x.name.contains("%_"))) == ["e"]
    assert ids(people.where(lambda x: x.name.contains("'é", ignore_case=True))) == ["e"]
    assert ids(people.where(lambda x: x.name.starts_with(""))) == ["a", "b", "c", "e"]
    assert ids(people.where(lambda x: x.name.ends_with(""))) == list("abcde")
    assert ids(people.where(lambda x: x.name.is_null_or_empty())) == ["d"]
    assert ids(people.where(lambda x: x.name.length() == 5)) == ["a", "c"]
    assert ids(people.where(lambda x: x.name.upper() == "FRODO")) == ["a"]


def test_timestamps_compare_at_milliseconds(spark):
    rows = [(1, "2024-01-01T00:00:00.123456"), (2, "2024-01-01T00:00:00.123999"), (3, "2024-01-01T00:00:00.124"), (4, None)]
    df = spark.createDataFrame(rows, "id int, t string").withColumn("t", F.col("t").cast("timestamp"))
    q = Query(df, Mapping("id"))
    assert [r.id for r in q.where(lambda x: x.t == datetime(2024, 1, 1, 0, 0, 0, 123000)).to_df().orderBy("id").collect()] == [1, 2]
    assert q.where(lambda x: x.t == "junk").count() == 0


def test_refusals(people):
    for bad in (
        lambda: people.where(lambda x: x.grade > "A").to_df(),
        lambda: people.order_by("grade").to_df(),
        lambda: people.sum_df("name"),
        lambda: people.group_by("grade"),
        lambda: people.group_by(["a", "b"]),
        lambda: people.distinct(),
        lambda: people.select(x=1),
        lambda: people.select(a="id").select(b="id"),
        lambda: people.last_df(),
        lambda: people.any_tenant(),
        lambda: people.is_deleted(),
        lambda: people.of_type("x"),
        lambda: people.group_by("age").to_df(),
        lambda: people.order_by("age").cursor_df(3),
        lambda: people.where(lambda x: x.nope == 1).to_df(),
        lambda: people.select(a="age").sum_df("age"),
    ):
        with pytest.raises(QueryNotSupported):
            bad()


def test_order_of_clauses(people):
    assert [r.id for r in people.take(1).where(lambda x: x.age > 30).order_by_descending("age").to_df().collect()] == ["b"]
    assert people.take(2).count() == 2 and people.order_by("id").take(2).skip(4).count() == 1


def test_terminals(people):
    assert people.order_by("id").first().id == "a"
    assert people.order_by("id").last().id == "e"
    assert people.order_by("id").take(2).last().id == "b"
    assert people.where(False).first_or_default() is None
    with pytest.raises(LookupError):
        people.single()
    with pytest.raises(LookupError):
        people.where(False).single()
    page = people.order_by("id").to_page(2, 2)
    assert [r.id for r in page.rows.collect()] == ["c", "d"] and (page.total, page.pages) == (5, 3)
    assert people.exists("a") and not people.exists("z")
    assert people.where(False).sum_df("age").first()[0] == 0
    with pytest.raises(ValueError):
        people.to_page(0, 2)


def test_cursor_walks_over_ties_and_nulls(people):
    assert decode_cursor(encode_cursor([None, 1, "x"])) == [None, 1, "x"]
    for descending in (False, True):
        q = people.order_by("age", descending).order_by("id")
        seen, cursor = [], None
        while True:
            page = q.to_cursor_page(2, cursor)
            seen += [r.id for r in page.rows]
            cursor = page.next
            if cursor is None:
                break
        assert seen == [r.id for r in q.to_df().collect()] and len(seen) == 5


@pytest.fixture(scope="module")
def sea(spark):
    anglers = spark.createDataFrame([("1", "Frodo", "Shire"), ("2", "Sam", "Shire"), ("3", "Merry", "Buckland"), ("4", "Pippin", "Buckland")], "id string, name string, region string")
    catches = spark.createDataFrame([("c1", "1", "Trout", 3, False), ("c2", "1", "Pike", 11, False), ("c3", "2", "Chub", 2, False), ("c4", "4", "Perch", 5, True)], "id string, anglerId string, name string, weight int, is_deleted boolean")
    return Query(anglers, CATCH), Query(catches, Mapping("id", deleted="is_deleted"))


def test_joins(sea):
    anglers, catches = sea
    left = Join.of("a", anglers).left("c", catches, ("a.id", "anglerId"))
    rows = {(r.a, r.c) for r in left.select(a=lambda a, c: a.name, c=lambda a, c: c.name).collect()}
    assert rows == {("Frodo", "Trout"), ("Frodo", "Pike"), ("Sam", "Chub"), ("Merry", None), ("Pippin", None)}
    on = Join.of("a", anglers).left("c", catches.where(lambda x: x.weight > 5), ("a.id", "anglerId"))
    assert on.count_df().first()[0] == 4
    assert left.where(lambda a, c: c.weight > 5).count_df().first()[0] == 1
    assert left.aggregate_df("sum", lambda a, c: c.weight).first()[0] == 16
    assert [r.c for r in left.documents("c").collect()].count(None) == 2
    for bad in (lambda: Join.of("a", anglers.take(1)), lambda: left.inner("a", catches, ("a.id", "anglerId")), lambda: left.inner("x", catches, ("q.id", "anglerId")), lambda: left.last(a=lambda a, c: a.name)):
        with pytest.raises(QueryNotSupported):
            bad()


def test_tenants_do_not_leak(spark):
    m = Mapping("id", tenant="tenant_id")
    df = spark.createDataFrame([("x", 1), ("y", 1)], "tenant_id string, id int")
    with pytest.raises(QueryNotSupported):
        Query(df, m).count()
    a, b = Query(df, m, "x"), Query(df, m, "x")
    assert Join.of("a", a).inner("b", b, ("a.id", "id")).count_df().first()[0] == 1
    assert Query(df, m, "x").any_tenant().count() == 2 and Query(df, m, "x").tenant_is_one_of().count() == 0
