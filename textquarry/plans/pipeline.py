"""Pipelines of DataFrame steps: in order or as a graph, with retries and written checkpoints."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession

Step = Callable[[dict[str, DataFrame]], DataFrame]


class CycleError(ValueError):
    """Steps that wait for each other."""


@dataclass
class Pipeline:
    """Named steps; each gets the frames of the steps before it and gives one of its own.

    With ``folder`` every result is written as parquet there and read back, so that a failed run goes on
    where it stopped and lineage is cut. Frames stay lazy otherwise.
    """

    folder: str | None = None
    steps: dict[str, tuple[Step, tuple[str, ...], int]] = field(default_factory=dict)
    timings: dict[str, float] = field(default_factory=dict)

    def add(self, name: str, step: Step, after: str | tuple[str, ...] = (), attempts: int = 1) -> Pipeline:
        self.steps[name] = (step, (after,) if isinstance(after, str) else tuple(after), attempts)
        return self

    def keep(self, name: str, after: str, condition: Column | str) -> Pipeline:
        """A step with the rows of ``after`` that fulfil ``condition``."""
        return self.add(name, lambda frames: frames[after].where(condition), after)

    def map(self, name: str, after: str, columns: dict[str, Column]) -> Pipeline:
        """A step with columns of ``after`` put in or replaced."""
        return self.add(name, lambda frames: frames[after].withColumns(columns), after)

    def when(self, name: str, after: str, test: Callable[[DataFrame], bool], step: Callable[[DataFrame], DataFrame], otherwise: Callable[[DataFrame], DataFrame] | None = None) -> Pipeline:
        """A step that depends on a test of the whole frame, such as whether it has rows; without ``otherwise`` the frame stays."""
        return self.add(name, lambda frames: step(f) if test(f := frames[after]) else otherwise(f) if otherwise else f, after)

    def store(self, name: str, after: str, path: str, form: str = "parquet", mode: str = "overwrite") -> Pipeline:
        """A step that writes ``after`` and gives what was written."""

        def write(frames: dict[str, DataFrame]) -> DataFrame:
            frames[after].write.format(form).mode(mode).save(path)
            return frames[after].sparkSession.read.format(form).schema(frames[after].schema).load(path)

        return self.add(name, write, after)

    def trace(self, frames: dict[str, DataFrame]) -> list[tuple[str, float, int]]:
        """(step, seconds, rows) of each step that ran; counts the rows."""
        return [(name, self.timings[name], frames[name].count()) for name in self.order() if name in self.timings]

    def order(self) -> list[str]:
        """Names so that each stands after those it waits for."""
        missing = {d for _, after, _ in self.steps.values() for d in after} - self.steps.keys()
        if missing:
            raise KeyError(f"unknown steps: {sorted(missing)}")
        done: list[str] = []
        left = dict(self.steps)
        while left:
            ready = [n for n, (_, after, _) in left.items() if all(d in done for d in after)]
            if not ready:
                raise CycleError(f"steps wait for each other: {sorted(left)}")
            done += ready
            for n in ready:
                del left[n]
        return done

    def run(self, spark: SparkSession, frames: dict[str, DataFrame] | None = None) -> dict[str, DataFrame]:
        frames = dict(frames or {})
        for name in self.order():
            step, _, attempts = self.steps[name]
            began = time.time()
            path = f"{self.folder}/{name}" if self.folder else None
            if path and self._written(spark, path):
                frames[name] = spark.read.parquet(path)
                continue
            for attempt in range(attempts):
                try:
                    frame = step(frames)
                    if path:
                        frame.write.mode("overwrite").parquet(path)
                        frame = spark.read.parquet(path)
                    frames[name] = frame
                    break
                except Exception:
                    if attempt + 1 == attempts:
                        raise
            self.timings[name] = time.time() - began
        return frames

    @staticmethod
    def _written(spark: SparkSession, path: str) -> bool:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
        return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)
