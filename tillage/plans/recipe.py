"""A recipe: the ordered list of cleaning steps applied to a source table.

Steps are named and parameterised, so a recipe can be listed, undone, reverted, saved as JSON and resumed. The
current table is rebuilt from the source by the lazy plan; nothing is copied.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from datetime import datetime, timezone

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from .lineage import local_rows

Step = tuple[str, dict, str]

_actions: dict[str, Callable[..., DataFrame]] = {}


def action(name: str, run: Callable[..., DataFrame]) -> None:
    """Make a function available to recipes under a name. It takes a DataFrame and JSON parameters."""
    _actions[name] = run


@dataclass(frozen=True)
class Recipe:
    source: DataFrame
    steps: tuple[Step, ...] = field(default_factory=tuple)

    def then(self, name: str, /, **params) -> "Recipe":
        if name not in _actions:
            raise ValueError(f"unknown action {name}")
        now = datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
        return replace(self, steps=(*self.steps, (name, params, now)))

    def result(self) -> DataFrame:
        df = self.source
        for name, params, _ in self.steps:
            df = _actions[name](df, **params)
        return df

    def undo(self) -> "Recipe":
        return replace(self, steps=self.steps[:-1])

    def revert(self) -> "Recipe":
        return replace(self, steps=())

    def log(self) -> DataFrame:
        """One row per step: number, action, parameters, time, rows before and after, columns after."""
        spark = self.source.sparkSession
        if not self.steps:
            counts: list[int] = []
            columns: list[list[str]] = []
        else:
            counts, columns = self._counts()
        rows = [
            (i, name, json.dumps(params, sort_keys=True), at, counts[i - 1], counts[i], columns[i])
            for i, (name, params, at) in enumerate(self.steps, 1)
        ]
        return local_rows(
            spark, rows, "step int, action string, parameters string, at string, rows_before bigint, rows_after bigint, columns array<string>"
        )

    def _counts(self) -> tuple[list[int], list[list[str]]]:
        """Rows and columns of the source and after every step, from one run of the plan: each step is observed as its rows pass."""
        seen = [Observation() for _ in range(len(self.steps) + 1)]
        df, columns = self.source, []
        for i, watch in enumerate(seen):
            if i:
                name, params, _ = self.steps[i - 1]
                df = _actions[name](df, **params)
            columns.append(df.columns)
            df = df.observe(watch, F.count(F.lit(1)).alias("rows"))
        df.write.format("noop").mode("overwrite").save()
        return [w.get["rows"] for w in seen], columns

    def save(self, folder: str) -> None:
        """Write the steps as JSON text and the current rows as Parquet below ``folder``."""
        spark = self.source.sparkSession
        text = json.dumps([{"action": n, "params": p, "at": t} for n, p, t in self.steps])
        self.source.write.mode("errorifexists").parquet(f"{folder}/source")
        self.result().write.mode("errorifexists").parquet(f"{folder}/result")
        spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("errorifexists").text(f"{folder}/steps")

    @staticmethod
    def resume(spark: SparkSession, folder: str) -> "Recipe":
        text = spark.read.text(f"{folder}/steps").first()[0]
        steps = tuple((s["action"], s["params"], s["at"]) for s in json.loads(text))
        return Recipe(spark.read.parquet(f"{folder}/source"), steps)

    def write_log(self, folder: str, tool: str = "tillage", file: str = "") -> None:
        """The change log as one JSON record: totals and the numbered steps."""
        log = self.log().orderBy("step").collect()
        steps = [(r["step"], r["action"], r["parameters"], r["at"]) for r in log]
        before, after, columns = (log[0]["rows_before"], log[-1]["rows_after"], log[-1]["columns"]) if log else (self.source.count(),) * 2 + (self.source.columns,)
        self.source.sparkSession.createDataFrame(
            [(tool, file, before, after, columns, steps)],
            "tool string, file string, rows_before long, rows_now long, columns_now array<string>, "
            "steps array<struct<step int, action string, parameters string, at string>>",
        ).coalesce(1).write.mode("errorifexists").json(folder)
