"""Streams: running estimates and stage registries as state, and sinks that can be repeated safely."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from gridloom.operators.series import LEAST_SECONDS

STATE = "estimate double, last double, runs long, failures long"
PROGRESS = "title string, estimate double, last double, runs long, failures long"


def stage_progress(events: DataFrame) -> DataFrame:
    """Keyed state of stages from a stream of (title, seconds, ok): the estimate is replaced by successes of LEAST_SECONDS
    or more, or set by the first; failures are counted and change nothing else. Emits a stage's state on every change."""

    def advance(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        estimate, last, runs, failures = state.get if state.exists else (None, None, 0, 0)
        for batch in batches:
            for seconds, ok in zip(batch["seconds"], batch["ok"], strict=True):
                if not ok:
                    failures += 1
                    continue
                runs, last = runs + 1, float(seconds)
                estimate = last if estimate is None or last >= LEAST_SECONDS else estimate
        state.update((estimate, last, runs, failures))
        yield pd.DataFrame([(key[0], estimate, last, runs, failures)], columns=["title", "estimate", "last", "runs", "failures"])

    return events.groupBy("title").applyInPandasWithState(advance, PROGRESS, STATE, "update", GroupStateTimeout.NoTimeout)


def tumbling_counts(events: DataFrame, lateness: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Counts and sums by event type in windows closed by a watermark (an addition of this engine)."""
    late = events.withWatermark("ts", lateness)
    return late.groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value")).select(F.col("window.start").alias("start"), "event_type", "n", "value")


def once(path: str, write: Callable[[DataFrame], None] | None = None) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink that may repeat a batch: each batch owns a folder, which a repeat overwrites."""

    def sink(batch: DataFrame, number: int) -> None:
        if write is not None:
            write(batch)
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return sink


def up_to_date(stored: str | None, wanted: str, outputs_exist: bool) -> bool:
    """Whether a step may be skipped: its outputs are there and were made from the same inputs and settings."""
    return outputs_exist and stored == wanted
