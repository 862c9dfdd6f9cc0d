"""What a run took: seconds and rows of each of its steps, measured while the step's tables are written, and of a stream's triggers."""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from .pipeline import REGISTRY, Step, Tables, validate
from .staging import written

REPORT = "step long, type string, table string, rows long, seconds double"


def run_timed(steps: list[Step], tables: Tables) -> tuple[Tables, DataFrame]:
    """`pipeline.run` with each step's tables written as it ends, and a REPORT row for each of them.

    Rows are observed by the job that writes them; nothing is read or computed a second time. A step's seconds hold its
    planning, what it reads and its writing; steps that make several tables share what they have in common in the first.
    """
    validate(steps, set(tables))
    spark = next(iter(tables.values())).sparkSession
    report = []
    for i, s in enumerate(steps):
        f, requires, provides = REGISTRY[s.type]
        began = time.monotonic()
        made = f({k: tables[k] for k in requires}, **s.config)
        for name in sorted(provides):
            seen = Observation(f"step_{i}_{name}")
            made[name] = written(made[name].observe(seen, F.count("*").alias("rows")), name)
            now = time.monotonic()
            report.append((i, s.type, name, seen.get["rows"], now - began))
            began = now
        tables = tables | made
    return tables, spark.createDataFrame(report, REPORT)


def run_totals(report: DataFrame, frames: int) -> DataFrame:
    """seconds in all, seconds a frame, frames a second; a run without frames has neither of the two."""
    total = report.agg(F.round(F.sum("seconds"), 3).alias("seconds"))
    n = F.lit(frames).cast("double")
    return total.select("seconds", F.when(n > 0, F.round(F.col("seconds") / n, 6)).alias("seconds_a_frame"), F.when(F.col("seconds") > 0, F.round(n / F.col("seconds"), 3)).alias("frames_a_second"))


@dataclass
class Trigger:
    query: str
    batch: int
    rows: int
    seconds: float
    phases: dict[str, float]
    observed: dict[str, dict]


class StreamTimes(StreamingQueryListener):
    """Listens to the session's streams: a Trigger for each batch with rows, with what `observe` saw in it.

    with StreamTimes(spark) as times: run the stream; then times.triggers, times.totals().
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.triggers, self.ended = spark, [], set()

    def __enter__(self) -> StreamTimes:
        self.spark.streams.addListener(self)
        return self

    def __exit__(self, *_) -> None:
        self.spark.streams.removeListener(self)

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        if p.numInputRows:
            phases = {k: v / 1000 for k, v in p.durationMs.items()}
            observed = {k: v.asDict() for k, v in p.observedMetrics.items()}
            self.triggers.append(Trigger(p.name or str(p.id), p.batchId, p.numInputRows, phases.get("triggerExecution", 0.0), phases, observed))

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.ended.add(str(event.id))

    def wait_for(self, query, most: float = 30.0) -> None:
        """Until the events of an ended query have arrived; they come behind its end."""
        until = time.monotonic() + most
        while str(query.id) not in self.ended and time.monotonic() < until:
            time.sleep(0.05)

    def totals(self) -> dict[str, dict[str, float]]:
        """By query: batches, rows, seconds, rows a second."""
        out: dict[str, dict[str, float]] = {}
        for t in self.triggers:
            q = out.setdefault(t.query, {"batches": 0, "rows": 0, "seconds": 0.0})
            q["batches"], q["rows"], q["seconds"] = q["batches"] + 1, q["rows"] + t.rows, q["seconds"] + t.seconds
        return {k: v | {"rows_a_second": v["rows"] / v["seconds"] if v["seconds"] else 0.0} for k, v in out.items()}
