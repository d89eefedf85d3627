"""A step registry and runner: named DataFrame steps, run in order, fail-fast unless told to go on."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

Step = Callable[[SparkSession, dict[str, DataFrame]], DataFrame]


@dataclass
class Runner:
    steps: dict[str, Step] = field(default_factory=dict)

    def step(self, name: str) -> Callable[[Step], Step]:
        def add(f: Step) -> Step:
            self.steps[name] = f
            return f

        return add

    def list(self) -> list[str]:
        return list(self.steps)

    def run(self, spark: SparkSession, names: list[str] | None = None, continue_on_error: bool = False) -> tuple[dict[str, DataFrame], list[dict]]:
        """Results by step, and a summary (step, ok, seconds, error). Unknown names raise KeyError before anything runs."""
        names = names or self.list()
        todo = [(n, self.steps[n]) for n in names]
        results: dict[str, DataFrame] = {}
        summary = []
        for name, f in todo:
            began = time.time()
            try:
                results[name] = f(spark, results)
                summary.append({"step": name, "ok": True, "seconds": time.time() - began, "error": None})
            except Exception as e:
                summary.append({"step": name, "ok": False, "seconds": time.time() - began, "error": str(e)})
                if not continue_on_error:
                    raise
        return results, summary
