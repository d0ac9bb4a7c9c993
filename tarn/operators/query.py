"""Queries over a document type.

A query collects its clauses and emits them in one order, whatever the order of the calls: implicit filters, where,
joins, grouping and having, distinct, order, offset and limit. So a where after a take still filters first, orderings
append, and the last take or skip counts. What has no defined meaning is refused by name before a plan exists.
"""

from __future__ import annotations

import base64
import json
from collections.abc import Callable
from dataclasses import dataclass, replace
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import QueryNotSupported
from ..functions.members import Member
from ..mapping import Mapping, Members, as_column
from .pages import page as page_of

Lambda = Callable[..., Any]


@dataclass(frozen=True)
class Page:
    """A page of rows, and what the whole query has (before any take or skip)."""

    rows: DataFrame
    total: int
    number: int
    size: int

    @property
    def pages(self) -> int:
        return -(-self.total // self.size)


@dataclass(frozen=True)
class CursorPage:
    rows: list
    next: str | None


@dataclass(frozen=True)
class Query:
    df: DataFrame
    mapping: Mapping
    tenant: str | None = None
    _any_tenant: bool = False
    _tenants: tuple[str, ...] | None = None
    _deleted: str = "live"
    _filters: tuple[Column, ...] = ()
    _wheres: tuple[Any, ...] = ()
    _orders: tuple[tuple[Any, bool], ...] = ()
    _limit: int | None = None
    _offset: int | None = None
    _select: dict[str, Any] | None = None
    _distinct: bool = False
    _distinct_by: str | None = None
    _group: Any = None
    _shape: dict[str, Any] | None = None
    _having: tuple[Any, ...] = ()
    _subclass: str | None = None

    # Scope.
    def _needs(self, column: str | None, what: str) -> str:
        if column is None:
            raise QueryNotSupported(f"{what} on a type that has no such column")
        return column

    def any_tenant(self) -> Query:
        self._needs(self.mapping.tenant, "any_tenant")
        return replace(self, _any_tenant=True)

    def tenant_is_one_of(self, *tenants: str) -> Query:
        self._needs(self.mapping.tenant, "tenant_is_one_of")
        return replace(self, _tenants=tenants)

    def maybe_deleted(self) -> Query:
        self._needs(self.mapping.deleted, "maybe_deleted")
        return replace(self, _deleted="maybe")

    def is_deleted(self) -> Query:
        self._needs(self.mapping.deleted, "is_deleted")
        return replace(self, _deleted="only")

    def _deleted_at(self, what: str) -> Column:
        self._needs(self.mapping.deleted, what)
        return F.col(self._needs(self.mapping.deleted_at, what))

    def deleted_since(self, when: Any) -> Query:
        return replace(self.is_deleted(), _filters=(*self._filters, self._deleted_at("deleted_since") >= as_column(when)))

    def deleted_before(self, when: Any) -> Query:
        return replace(self.is_deleted(), _filters=(*self._filters, self._deleted_at("deleted_before") < as_column(when)))

    def modified_since(self, when: Any) -> Query:
        return replace(self, _filters=(*self._filters, F.col(self._needs(self.mapping.modified, "modified_since")) >= as_column(when)))

    def modified_before(self, when: Any) -> Query:
        return replace(self, _filters=(*self._filters, F.col(self._needs(self.mapping.modified, "modified_before")) < as_column(when)))

    def of_type(self, name: str) -> Query:
        self._needs(self.mapping.kind, "of_type")
        if name not in self.mapping.subclasses:
            raise QueryNotSupported(f"{name} is no subclass")
        return replace(self, _subclass=name)

    # Clauses.
    def where(self, predicate: Any) -> Query:
        """Before a grouping it filters documents; after it, groups (HAVING)."""
        if self._group is not None:
            return replace(self, _having=(*self._having, predicate))
        if self._select is not None:
            raise QueryNotSupported("where after select")
        return replace(self, _wheres=(*self._wheres, predicate))

    def order_by(self, key: Any, descending: bool = False) -> Query:
        return replace(self, _orders=(*self._orders, (key, descending)))

    def order_by_descending(self, key: Any) -> Query:
        return self.order_by(key, True)

    then_by, then_by_descending = order_by, order_by_descending

    def take(self, n: int) -> Query:
        return replace(self, _limit=n)

    def skip(self, n: int) -> Query:
        return replace(self, _offset=n)

    def select(self, **shape: Any) -> Query:
        """Named outputs: member paths, functions of the members, or columns."""
        if self._select is not None or self._shape is not None:
            raise QueryNotSupported("a second select")
        if self._group is not None:
            return replace(self, _shape=shape)
        if not any(callable(v) or isinstance(v, (str, Column, Member)) for v in shape.values()):
            raise QueryNotSupported("a select of constants only")
        return replace(self, _select=shape)

    def distinct(self) -> Query:
        if self._select is None:
            raise QueryNotSupported("distinct without a select")
        return replace(self, _distinct=True)

    def distinct_by(self, key: str) -> Query:
        """One document of each key: the one with the smallest identity."""
        self._member(key).ordered("distinct_by")
        return replace(self, _distinct_by=key)

    def group_by(self, key: Any) -> Query:
        if self._group is not None or self._select is not None:
            raise QueryNotSupported("a grouping of a grouping or of a select")
        if isinstance(key, (tuple, list)):
            raise QueryNotSupported("a grouping by several keys")
        self._value(key).ordered("group_by")
        return replace(self, _group=key)

    # Resolution.
    def _member(self, path: str) -> Member:
        return self.mapping.member(self.df, path)

    def _members(self) -> Members:
        return Members(self.mapping, self.df)

    def _value(self, key: Any) -> Member:
        got = key(self._members()) if callable(key) and not isinstance(key, (Member, Column)) else key
        if isinstance(got, str):
            got = self._member(got)
        if isinstance(got, Column):
            kind = self.df.select(got.alias("x")).schema["x"].dataType
            got = Member(got, kind, "expression")
        return got

    def _predicate(self, p: Any) -> Column:
        got = p(self._members()) if callable(p) and not isinstance(p, (Member, Column)) else p
        return got.is_true() if isinstance(got, Member) else F.lit(got) if isinstance(got, bool) else got

    # Emission.
    def implicit(self) -> list[Column]:
        """The filters that the type itself asks for."""
        m, out = self.mapping, []
        if m.tenant and self._tenants is not None:
            out.append(F.col(m.tenant).isin(*self._tenants) if self._tenants else F.lit(False))
        elif m.tenant and not self._any_tenant:
            if self.tenant is None:
                raise QueryNotSupported("a tenanted type without a tenant")
            out.append(F.col(m.tenant) == self.tenant)
        if self._subclass:
            out.append(F.col(m.kind).isin(*m.subclasses[self._subclass]))
        if m.deleted and self._deleted != "maybe":
            out.append(F.col(m.deleted) == F.lit(self._deleted == "only"))
        return [*out, *self._filters]

    def filtered(self) -> DataFrame:
        df = self.df
        for p in (*self.implicit(), *map(self._predicate, self._wheres)):
            df = df.where(p)
        return df

    def _sorted(self, df: DataFrame, orders: Any, resolve: Lambda) -> DataFrame:
        keys = [(resolve(k), d) for k, d in orders]
        return df.orderBy(*[c.desc() if d else c.asc() for c, d in keys]) if keys else df

    def _page(self, *outputs: Column) -> DataFrame:
        """A page's rows, or of them what a terminal needs: a large page is written with all its columns."""
        df = self.unpaged()
        return page_of(df.select(*outputs) if outputs else df, self._offset, self._limit, ordered=bool(self._orders))

    def _any(self) -> DataFrame:
        """A row of the page, if it has one."""
        return page_of(self.unpaged(ordered=False).select(F.lit(1)), self._offset, 1 if self._limit is None else min(self._limit, 1), ordered=False)

    def unpaged(self, ordered: bool = True) -> DataFrame:
        df = self.filtered()
        orders = self._orders if ordered else ()
        document = lambda k: self._value(k).ordered("an ordering").comparable
        if self._group is not None:
            if self._shape is None:
                raise QueryNotSupported("a grouping without a select")
            return self._sorted(self._grouped(df), orders, self._group_value)
        if self._distinct_by:
            # An aggregate combines before the shuffle, so a frequent key is no large group anywhere.
            key = self._member(self._distinct_by).comparable
            df = df.groupBy(key.alias("_key")).agg(F.min_by(F.struct(*df.columns), F.col(self.mapping.key)).alias("_row")).select("_row.*")
        if self._select is None:
            return self._sorted(df, orders, document)
        shaped = {k: as_column(self._value(v)).alias(k) for k, v in self._select.items()}
        if self._distinct:
            out = df.select(*shaped.values()).distinct()
            # A distinct result can be ordered by what it shows only.
            shown = {str(self._value(v).column): k for k, v in self._select.items()}
            return self._sorted(out, orders, lambda k: F.col(k if isinstance(k, str) and k in self._select else shown[str(self._value(k).column)]))
        return self._sorted(df, orders, document).select(*shaped.values())

    def _grouped(self, df: DataFrame) -> DataFrame:
        key = self._value(self._group)
        made = [self._aggregate(v).alias(k) for k, v in self._shape.items() if v != "key"]
        df = df.withColumn("_key", key.comparable)
        df = df.groupBy("_key").agg(*made) if made else df.select("_key").distinct()
        for k, v in self._shape.items():
            if v == "key":
                df = df.withColumn(k, F.col("_key"))
        for p in self._having:
            df = df.where(p(_Group(self)) if callable(p) else p)
        return df.select(*self._shape)

    def _aggregate(self, spec: Any) -> Column:
        if spec == "count":
            return F.count(F.lit(1))
        kind, of = spec
        return self.aggregate_of(kind, of)

    def aggregate_of(self, kind: str, of: Any) -> Column:
        return self._reduced(kind, self._operand(kind, of))

    def _operand(self, kind: str, of: Any) -> Column:
        m = self._value(of)
        if kind in ("sum", "avg"):
            m.number(kind)
            return m.column
        if kind not in ("min", "max"):
            raise QueryNotSupported(f"the aggregate {kind}")
        return m.ordered(kind).comparable

    def _reduced(self, kind: str, column: Column) -> Column:
        out = getattr(F, kind)(column)
        return F.coalesce(out, F.lit(0)) if kind in ("sum", "avg") else out

    def _group_value(self, key: Any) -> Column:
        if key in self._shape:
            return F.col(key)
        raise QueryNotSupported("an ordering of groups by what the select doesn't have")

    def to_df(self) -> DataFrame:
        return self._page()

    # Terminals. Those that end in _df give a row of one column.
    def count_df(self, name: str = "n") -> DataFrame:
        """Rows of the result; a page counts the page."""
        paged = self._limit is not None or self._offset
        df = self._page(F.lit(1)) if paged else self.unpaged(ordered=False)
        return df.agg(F.count(F.lit(1)).alias(name))

    def count(self) -> int:
        return self.count_df().first()[0]

    def any_df(self, name: str = "found") -> DataFrame:
        return self._any().agg((F.count(F.lit(1)) > 0).alias(name))

    def any(self) -> bool:
        return not self._any().isEmpty()

    def _scalar(self, kind: str, of: Any, name: str) -> DataFrame:
        if self._select is not None or self._group is not None:
            raise QueryNotSupported(f"{kind} after a select")
        paged = self._limit is not None or self._offset
        operand = self._operand(kind, of)
        df = self._page(operand.alias("_of")) if paged else self.filtered()
        column = self._reduced(kind, F.col("_of") if paged else operand)
        if kind in ("min", "max") and self._value(of).is_number:
            column = F.coalesce(column, F.lit(0))
        return df.agg(column.alias(name))

    def sum_df(self, of: Any, name: str = "value") -> DataFrame:
        return self._scalar("sum", of, name)

    def avg_df(self, of: Any, name: str = "value") -> DataFrame:
        return self._scalar("avg", of, name)

    def min_df(self, of: Any, name: str = "value") -> DataFrame:
        return self._scalar("min", of, name)

    def max_df(self, of: Any, name: str = "value") -> DataFrame:
        return self._scalar("max", of, name)

    def first_df(self) -> DataFrame:
        return self.take(1).to_df()

    def first_or_default(self) -> Any:
        rows = self.first_df().collect()
        return rows[0] if rows else None

    def first(self) -> Any:
        rows = self.first_df().collect()
        if not rows:
            raise LookupError("the result has no row")
        return rows[0]

    def single_or_default(self) -> Any:
        rows = self.take(2).to_df().collect()
        if len(rows) > 1:
            raise LookupError("the result has more than one row")
        return rows[0] if rows else None

    def single(self) -> Any:
        row = self.single_or_default()
        if row is None:
            raise LookupError("the result has no row")
        return row

    def last_df(self) -> DataFrame:
        """The last row by the ordering; of a page, the last of the page."""
        if not self._orders:
            raise QueryNotSupported("last without an ordering")
        turned = tuple((k, not d) for k, d in self._orders)
        if self._limit is None and not self._offset:
            return replace(self, _orders=turned, _limit=1).to_df()
        resolve = lambda k: self._value(k).ordered("an ordering").comparable
        return self._sorted(self.to_df(), turned, resolve).limit(1)

    def last(self) -> Any:
        rows = self.last_df().collect()
        if not rows:
            raise LookupError("the result has no row")
        return rows[0]

    def page_df(self, number: int, size: int) -> DataFrame:
        if number < 1 or size < 1:
            raise ValueError("pages and sizes begin at 1")
        return replace(self, _limit=size, _offset=(number - 1) * size).to_df()

    def total_df(self, name: str = "total") -> DataFrame:
        return replace(self, _limit=None, _offset=None).count_df(name)

    def to_page(self, number: int, size: int) -> Page:
        return Page(self.page_df(number, size), self.total_df().first()[0], number, size)

    # Keyset paging.
    def _cursor_keys(self) -> list[tuple[str, bool]]:
        keys = []
        for k, d in self._orders:
            if not isinstance(k, str):
                raise QueryNotSupported("a cursor over a computed ordering")
            self._member(k).ordered("a cursor")
            keys.append((k, d))
        if not keys or keys[-1][0] != self.mapping.key:
            raise QueryNotSupported("a cursor whose last ordering isn't the identity")
        return keys

    def seek(self, values: list) -> Column:
        """Rows after the one with ``values``: an OR over the keys, each with those before it equal. Null sorts first."""
        out = F.lit(False)
        before = F.lit(True)
        for (name, descending), value in zip(self._cursor_keys(), values, strict=True):
            m = self._member(name)
            if value is None:
                after = F.lit(False) if descending else m.column.isNotNull()
                same = m.column.isNull()
            else:
                v = m._value(value)
                after = (m.comparable < v) | m.column.isNull() if descending else m.comparable > v
                same = m.comparable == v
            out, before = out | (before & after), before & same
        return out

    def cursor_df(self, size: int, after: list | None = None) -> DataFrame:
        self._cursor_keys()
        q = replace(self, _limit=size, _offset=None)
        return (q if after is None else replace(q, _filters=(*q._filters, self.seek(after)))).to_df()

    def to_cursor_page(self, size: int, cursor: str | None = None) -> CursorPage:
        keys = self._cursor_keys()
        after = None if cursor is None else decode_cursor(cursor)
        rows = self.cursor_df(size, after).collect()
        if len(rows) < size:
            return CursorPage(rows, None)
        return CursorPage(rows, encode_cursor([rows[-1][k] for k, _ in keys]))

    # Other results.
    def to_json(self, name: str = "json") -> DataFrame:
        df = self.to_df()
        return df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias(name))

    def to_json_page(self, size: int, cursor: str | None = None) -> tuple[str, str | None]:
        """A cursor page as one JSON array, and the next cursor."""
        page = self.to_cursor_page(size, cursor)
        return json.dumps([r.asDict(recursive=True) for r in page.rows], default=str), page.next

    def load_json(self, key: Any, version: str = "revision") -> tuple[str, Any] | None:
        """A document as JSON with its version."""
        rows = self.load(key).select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}), version).collect()
        return tuple(rows[0]) if rows else None

    def fields(self) -> list[str]:
        """The columns of a document."""
        return list(self.df.columns)

    def to_plan(self) -> str:
        return self.to_df()._jdf.queryExecution().toString()

    def stream(self) -> Any:
        return self.to_df().toLocalIterator()

    def load(self, key: Any) -> DataFrame:
        """The live document of a key: at most one row."""
        return replace(self, _wheres=(F.col(self.mapping.key) == F.lit(key),), _limit=1).to_df()

    def load_many(self, keys: list) -> DataFrame:
        """Documents of keys; a long list becomes a join, an empty one finds nothing."""
        if len(keys) <= 1000:
            return replace(self, _wheres=(self._member(self.mapping.key).is_in(keys),)).to_df()
        kind = self.df.schema[self.mapping.key].dataType
        wanted = self.df.sparkSession.createDataFrame([(k,) for k in set(keys)], T.StructType([T.StructField("_wanted", kind)]))
        return self.filtered().join(wanted, F.col(self.mapping.key) == F.col("_wanted"), "left_semi")

    def exists(self, key: Any) -> bool:
        return not self.load(key).isEmpty()

    def metadata(self, key: Any) -> DataFrame:
        """System columns of a document, deleted or not."""
        m = self.mapping
        columns = [c for c in (m.key, m.tenant, m.kind, m.modified, m.deleted, m.deleted_at) if c]
        return self.df.where(F.col(m.key) == F.lit(key)).select(*columns)


class _Group:
    """A group in HAVING: its outputs by name, and aggregates that the select has."""

    def __init__(self, query: Query):
        self._query = query

    def __getattr__(self, name: str) -> Column:
        if name == "key":
            return F.col("_key")
        if name not in self._query._shape:
            raise QueryNotSupported(f"a group condition on {name}, which the select doesn't have")
        return F.col(name)


def encode_cursor(values: list) -> str:
    plain = [v.isoformat() if hasattr(v, "isoformat") else v for v in values]
    return "v1:" + base64.urlsafe_b64encode(json.dumps(plain).encode()).decode()


def decode_cursor(cursor: str) -> list:
    if not cursor.startswith("v1:"):
        raise ValueError("a cursor of an unknown version")
    return json.loads(base64.urlsafe_b64decode(cursor[3:]))
