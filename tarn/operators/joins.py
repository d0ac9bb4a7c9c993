"""Joins of document types: inner, left outer, chained and self joins.

Each side keeps its own implicit filters and predicates: those of a joined side belong to its ON clause, so they are
applied before the join, and an unmatched left row survives them. Predicates and orderings after the join see all sides
by alias. Equality joins on one member of each side are the only kind; the physical strategy is the planner's.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import QueryNotSupported
from ..functions.members import Member
from ..mapping import Members, as_column
from .pages import page as page_of
from .query import Page, Query


@dataclass(frozen=True)
class Side:
    alias: str
    query: Query
    left_key: tuple[str, str] | None = None  # (alias, member) of an earlier side
    key: str | None = None
    outer: bool = False


@dataclass(frozen=True)
class Join:
    sides: tuple[Side, ...]
    wheres: tuple[Any, ...] = ()
    orders: tuple[tuple[Any, bool], ...] = ()
    limit: int | None = None
    offset: int | None = None

    @staticmethod
    def of(alias: str, query: Query) -> Join:
        return Join((Side(alias, _plain(query)),))

    def _add(self, alias: str, query: Query, on: tuple[str, str], outer: bool) -> Join:
        if alias in {s.alias for s in self.sides}:
            raise QueryNotSupported(f"two sides named {alias}")
        if not all(isinstance(k, str) for k in on):
            raise QueryNotSupported("a join on a composite key")
        first, key = on
        owner, _, member = first.partition(".")
        known = {s.alias: s.query for s in self.sides}
        if owner not in known:
            raise QueryNotSupported(f"a join key of {owner}, which isn't joined yet")
        known[owner]._member(member)
        query._member(key)
        return replace(self, sides=(*self.sides, Side(alias, _plain(query), (owner, member), key, outer)))

    def inner(self, alias: str, query: Query, on: tuple[str, str]) -> Join:
        """on: (``alias.member`` of an earlier side, member of this one)."""
        return self._add(alias, query, on, False)

    def left(self, alias: str, query: Query, on: tuple[str, str]) -> Join:
        return self._add(alias, query, on, True)

    def where(self, predicate: Callable[..., Any]) -> Join:
        return replace(self, wheres=(*self.wheres, predicate))

    def order_by(self, key: Callable[..., Any], descending: bool = False) -> Join:
        return replace(self, orders=(*self.orders, (key, descending)))

    def take(self, n: int) -> Join:
        return replace(self, limit=n)

    def skip(self, n: int) -> Join:
        return replace(self, offset=n)

    def _members(self) -> list[Members]:
        return [Members(s.query.mapping, s.query.df, s.alias) for s in self.sides]

    def joined(self, ordered: bool = True) -> DataFrame:
        df: DataFrame | None = None
        for s in self.sides:
            right = s.query.filtered().alias(s.alias)
            if df is None:
                df = right
            else:
                df = df.join(right, F.col(".".join(s.left_key)) == F.col(f"{s.alias}.{s.key}"), "left" if s.outer else "inner")
        for p in self.wheres:
            got = p(*self._members())
            df = df.where(got.is_true() if isinstance(got, Member) else got)
        if ordered and self.orders:
            keys = [(as_column(k(*self._members())), d) for k, d in self.orders]
            df = df.orderBy(*[c.desc() if d else c.asc() for c, d in keys])
        return df

    def _page(self, *outputs: Column) -> DataFrame:
        """The outputs of a page's rows: a page is of named columns, which the sides' aliases don't reach."""
        return page_of(self.joined().select(*outputs), self.offset, self.limit, ordered=bool(self.orders))

    def select(self, **shape: Callable[..., Any]) -> DataFrame:
        """Named outputs of functions of the sides' members."""
        return self._page(*self._outputs(shape))

    def _outputs(self, shape: dict[str, Callable[..., Any]]) -> list[Column]:
        return [as_column(f(*self._members())).alias(k) for k, f in shape.items()]

    def documents(self, alias: str) -> DataFrame:
        """Whole documents of a side, as one struct; null where a left join found none."""
        side = next(s for s in self.sides if s.alias == alias)
        row = F.struct(*[F.col(f"{alias}.{c}").alias(c) for c in side.query.df.columns])
        return self._page(F.when(F.col(f"{alias}.{side.query.mapping.key}").isNotNull(), row).alias(alias))

    def _paged(self) -> bool:
        return self.limit is not None or bool(self.offset)

    def count_df(self, name: str = "n") -> DataFrame:
        return (self._page(F.lit(1).alias("_row")) if self._paged() else self.joined(False)).agg(F.count(F.lit(1)).alias(name))

    def any_df(self, name: str = "found") -> DataFrame:
        found = page_of(self.joined(False).select(F.lit(1)), self.offset, 1 if self.limit is None else min(self.limit, 1), ordered=False)
        return found.agg((F.count(F.lit(1)) > 0).alias(name))

    def aggregate_df(self, kind: str, of: Callable[..., Any], name: str = "value") -> DataFrame:
        m = of(*self._members())
        if kind in ("sum", "avg"):
            m.number(kind)
        else:
            m.ordered(kind)
        rows = self._page(m.column.alias("_of")) if self._paged() else self.joined(False).select(m.column.alias("_of"))
        column = getattr(F, kind)("_of")
        if m.is_number:
            column = F.coalesce(column, F.lit(0))
        return rows.agg(column.alias(name))

    def first(self, **shape: Callable[..., Any]) -> DataFrame:
        return self.take(1).select(**shape)

    def last(self, **shape: Callable[..., Any]) -> DataFrame:
        if not self.orders:
            raise QueryNotSupported("last without an ordering")
        if self._paged():
            raise QueryNotSupported("last over a page of a join")
        return replace(self, orders=tuple((k, not d) for k, d in self.orders), limit=1).select(**shape)

    def to_page(self, number: int, size: int, **shape: Callable[..., Any]) -> Page:
        if number < 1 or size < 1:
            raise ValueError("pages and sizes begin at 1")
        total = replace(self, limit=None, offset=None).count_df().first()[0]
        return Page(replace(self, limit=size, offset=(number - 1) * size).select(**shape), total, number, size)


def _plain(query: Query) -> Query:
    if query._orders or query._limit is not None or query._offset:
        raise QueryNotSupported("an ordering or a page on a side of a join")
    if query._select is not None or query._group is not None or query._distinct_by:
        raise QueryNotSupported("a select, grouping or distinct on a side of a join")
    return query
