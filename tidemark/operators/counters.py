"""Counts of what the phases of a search saw, taken while it runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F


class Counters:
    """Rows that pass marked places of a plan, counted by the job that runs the plan anyway.

    ``values`` waits for that job. A place that the plan is run through again keeps its first count.
    """

    def __init__(self):
        self._watched: dict[str, Observation] = {}

    def on(self, df: DataFrame, name: str) -> DataFrame:
        if name in self._watched:
            raise ValueError(f"{name} is counted already")
        self._watched[name] = Observation(name)
        return df.observe(self._watched[name], F.count(F.lit(1)).alias("n"))

    def values(self) -> dict[str, int]:
        return {name: int(o.get.get("n") or 0) for name, o in self._watched.items()}
