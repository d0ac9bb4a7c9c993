"""A helper for tests of projections: events in, rows out, without a store."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from datetime import datetime
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from ..sources.store import EVENTS, event_alias
from .daemon import Project


@dataclass
class Scenario:
    """Scenario(spark, fold.project).given("s", ("opened", {})).then(s={"views": 0})"""

    spark: SparkSession
    project: Project
    rows: list[tuple] = field(default_factory=list)

    def given(self, stream: str, *events: tuple[str, dict], at: datetime | None = None) -> Scenario:
        have = sum(r[1] == stream for r in self.rows)
        for k, (kind, body) in enumerate(events, 1):
            self.rows.append((len(self.rows) + 1, stream, have + k, event_alias(kind), at, "", json.dumps(body), "{}", None))
        return self

    def result(self) -> DataFrame:
        return self.project(self.spark.createDataFrame(self.rows, EVENTS))

    def then(self, key: str = "stream_id", **expected: dict[str, Any] | None) -> Scenario:
        """Every named key has a row with these values, or none if None is expected."""
        got = {r[key]: r.asDict(recursive=True) for r in self.result().collect()}
        for name, values in expected.items():
            if values is None:
                assert name not in got, f"{name} is there: {got[name]}"
            else:
                assert name in got, f"{name} isn't there"
                wrong = {k: got[name].get(k) for k, v in values.items() if got[name].get(k) != v}
                assert not wrong, f"{name} has {wrong}"
        return self
