"""Document types: which columns identify, scope and flag a document, and how members may be used."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .errors import QueryNotSupported
from .functions.members import Member


@dataclass(frozen=True)
class Mapping:
    """key: identity column. tenant, deleted, deleted_at, modified, kind: system columns, where the type has them.

    names: enum columns that are stored by name, so that they have no order. subclasses: alias lists by subclass name.
    """

    key: str
    tenant: str | None = None
    deleted: str | None = None
    deleted_at: str | None = None
    modified: str | None = None
    kind: str | None = None
    subclasses: dict[str, tuple[str, ...]] = field(default_factory=dict)
    names: frozenset[str] = frozenset()

    def member(self, df: DataFrame, path: str, alias: str | None = None) -> Member:
        """A member by its dotted path, resolved against the schema."""
        kind: T.DataType = df.schema
        for part in path.split("."):
            if not isinstance(kind, T.StructType) or part not in kind.names:
                raise QueryNotSupported(f"there is no member {path}")
            kind = kind[part].dataType
        return Member(F.col(f"{alias}.{path}" if alias else path), kind, path, path in self.names)


class Members:
    """Attribute access to the members of a document: ``x.home.city`` or ``x["home.city"]``."""

    def __init__(self, mapping: Mapping, df: DataFrame, alias: str | None = None, path: str = ""):
        self._at = (mapping, df, alias, path)

    def __getitem__(self, path: str) -> Member:
        mapping, df, alias, _ = self._at
        return mapping.member(df, path, alias)

    def __getattr__(self, name: str) -> Member:
        if name.startswith("__"):
            raise AttributeError(name)
        return self[name]


def as_column(value: object) -> Column:
    return value.column if isinstance(value, Member) else value if isinstance(value, Column) else F.lit(value)
