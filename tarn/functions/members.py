"""Members of documents as typed expressions: comparisons, string functions and their guards.

Nulls follow SQL's three-valued logic; equality with None is a null test. Timestamps compare at millisecond precision.
Case-insensitive comparisons fold with ``lower`` over all of Unicode.
"""

from __future__ import annotations

from collections.abc import Iterable
from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import QueryNotSupported


class Member:
    __hash__ = None  # type: ignore[assignment]

    def __init__(self, column: Column, kind: T.DataType, name: str, unordered: bool = False):
        self.column, self.kind, self.name, self.unordered = column, kind, name, unordered

    # What a member may be used for.
    @property
    def is_time(self) -> bool:
        return isinstance(self.kind, (T.TimestampType, T.TimestampNTZType))

    @property
    def is_text(self) -> bool:
        return isinstance(self.kind, T.StringType)

    @property
    def is_number(self) -> bool:
        return isinstance(self.kind, T.NumericType)

    @property
    def is_ordered(self) -> bool:
        return not self.unordered and not isinstance(self.kind, (T.ArrayType, T.MapType, T.StructType, T.BooleanType))

    def ordered(self, use: str) -> Member:
        if not self.is_ordered:
            raise QueryNotSupported(f"{self.name} has no order, so it can't be used for {use}")
        return self

    def number(self, use: str) -> Member:
        if not self.is_number or self.unordered:
            raise QueryNotSupported(f"{self.name} is not a number, so it can't be used for {use}")
        return self

    def text(self, use: str) -> Member:
        if not self.is_text:
            raise QueryNotSupported(f"{self.name} is not a string, so it can't be used for {use}")
        return self

    @property
    def comparable(self) -> Column:
        return F.date_trunc("MILLISECOND", self.column).cast(self.kind) if self.is_time else self.column

    def _value(self, other: object) -> Column:
        if isinstance(other, Member):
            return other.comparable
        if isinstance(other, Column):
            return other
        if self.is_time and isinstance(other, (str, datetime)):
            value = F.lit(other).cast(self.kind) if not isinstance(other, str) else F.try_to_timestamp(F.lit(other)).cast(self.kind)
            return F.date_trunc("MILLISECOND", value).cast(self.kind)
        return F.lit(other)

    # Comparisons; Python turns ``5 < x`` into ``x > 5``.
    def __eq__(self, other: object) -> Column:  # type: ignore[override]
        return self.column.isNull() if other is None else self.comparable == self._value(other)

    def __ne__(self, other: object) -> Column:  # type: ignore[override]
        return self.column.isNotNull() if other is None else self.comparable != self._value(other)

    def __lt__(self, other: object) -> Column:
        return self.ordered("a range").comparable < self._value(other)

    def __le__(self, other: object) -> Column:
        return self.ordered("a range").comparable <= self._value(other)

    def __gt__(self, other: object) -> Column:
        return self.ordered("a range").comparable > self._value(other)

    def __ge__(self, other: object) -> Column:
        return self.ordered("a range").comparable >= self._value(other)

    def __invert__(self) -> Column:
        return self.column == F.lit(False)

    def __mod__(self, n: int) -> Member:
        """Null where ``n`` is 0."""
        return Member(F.try_mod(self.number("a remainder").column, F.lit(n)), self.kind, f"{self.name} % {n}")

    def is_true(self) -> Column:
        return self.column == F.lit(True)

    def has_value(self) -> Column:
        return self.column.isNotNull()

    def is_in(self, values: Iterable) -> Column:
        values = list(values)
        if not values:
            return F.lit(False)
        return self.comparable.isin(*[self._value(v) for v in values]) if self.is_time else self.column.isin(*values)

    def or_default(self) -> Member:
        """Null as the default of the member's type: zero, false, or the empty string."""
        zero = 0 if self.is_number else False if isinstance(self.kind, T.BooleanType) else "" if self.is_text else None
        if zero is None:
            raise QueryNotSupported(f"{self.name} has no default")
        return Member(F.coalesce(self.column, F.lit(zero).cast(self.kind)), self.kind, f"default({self.name})", self.unordered)

    def is_one_of(self, *values: object) -> Column:
        return self.is_in(values)

    def is_empty(self) -> Column:
        """A list that is null or has no element."""
        if not isinstance(self.kind, T.ArrayType):
            raise QueryNotSupported(f"{self.name} is not a list")
        return self.column.isNull() | (F.size(self.column) == 0)

    def has_element(self, value: object) -> Column:
        return F.array_contains(self.column, value)

    def equals(self, value: object, ignore_case: bool = False) -> Column:
        if value is None or not ignore_case:
            return self == value
        return F.lower(self.text("equals").column) == F.lit(str(value).lower())

    # Strings.
    def _both(self, value: str, ignore_case: bool, use: str) -> tuple[Column, Column]:
        column = self.text(use).column
        return (F.lower(column), F.lit(value.lower())) if ignore_case else (column, F.lit(value))

    def contains(self, value: str, ignore_case: bool = False) -> Column:
        return F.contains(*self._both(value, ignore_case, "contains"))

    def starts_with(self, value: str, ignore_case: bool = False) -> Column:
        return F.startswith(*self._both(value, ignore_case, "starts_with"))

    def ends_with(self, value: str, ignore_case: bool = False) -> Column:
        """The empty ending is every string's, and null's too."""
        return F.endswith(*self._both(value, ignore_case, "ends_with")) if value else F.lit(True)

    def is_null_or_empty(self) -> Column:
        return self.column.isNull() | (self.text("is_null_or_empty").column == "")

    def is_null_or_whitespace(self) -> Column:
        return self.column.isNull() | (F.trim(self.text("is_null_or_whitespace").column) == "")

    def _made(self, column: Column, what: str, kind: T.DataType | None = None) -> Member:
        self.text(what)
        return Member(column, kind or self.kind, f"{what}({self.name})", self.unordered)

    def lower(self) -> Member:
        return self._made(F.lower(self.column), "lower")

    def upper(self) -> Member:
        return self._made(F.upper(self.column), "upper")

    def trim(self) -> Member:
        return self._made(F.trim(self.column), "trim")

    def trim_start(self) -> Member:
        return self._made(F.ltrim(self.column), "trim_start")

    def trim_end(self) -> Member:
        return self._made(F.rtrim(self.column), "trim_end")

    def length(self) -> Member:
        return self._made(F.length(self.column), "length", T.IntegerType())

    # Members of JSON text, for bodies that are kept raw.
    def json(self, path: str, kind: str = "string") -> Member:
        """The member of a JSON text at a path like ``a.b``, null where it is absent or no such type."""
        got = F.get_json_object(self.text("json").column, f"$.{path}")
        made = {"string": T.StringType(), "bigint": T.LongType(), "double": T.DoubleType(), "boolean": T.BooleanType()}[kind]
        return Member(got if kind == "string" else got.try_cast(made), made, f"{self.name}.{path}")

    def json_length(self, path: str | None = None) -> Member:
        body = self.text("json_length").column if path is None else F.get_json_object(self.column, f"$.{path}")
        return Member(F.json_array_length(body), T.IntegerType(), f"json_length({self.name})")
