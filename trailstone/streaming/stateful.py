"""Streaming forms of the history-dependent operators, keyed by session."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def detector_gate(frames: DataFrame, every: int) -> DataFrame:
    """session_id, step_nr, run: whether a detector that never fails runs on a frame, at least `every` steps after its last run.

    Works on a stream (append mode) whose frames arrive in order of their steps within each trigger.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        rows = pd.concat(list(batches)).sort_values("step_nr")
        run = []
        for s in rows["step_nr"]:
            go = last is None or s - last >= every
            last = int(s) if go else last
            run.append(go)
        state.update((last,))
        yield pd.DataFrame({"session_id": key[0], "step_nr": rows["step_nr"], "run": run})

    return frames.select("session_id", "step_nr").groupBy("session_id").applyInPandasWithState(step, "session_id string, step_nr long, run boolean", "last long", "append", GroupStateTimeout.NoTimeout)


def label_memory(labels: DataFrame) -> DataFrame:
    """session_id, segment_id, step_nr, class_label: the newest label of each segment after every trigger (update mode)."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        best = tuple(state.get) if state.exists else None
        for rows in batches:
            top = rows.sort_values(["step_nr", "class_label"]).iloc[-1]
            top = (int(top["step_nr"]), str(top["class_label"]))
            best = top if best is None else max(best, top)  # of equal steps the greater label, however the input is cut
        state.update(best)
        yield pd.DataFrame({"session_id": [key[0]], "segment_id": [key[1]], "step_nr": [best[0]], "class_label": [best[1]]})

    return labels.select("session_id", "segment_id", "step_nr", "class_label").groupBy("session_id", "segment_id").applyInPandasWithState(step, "session_id string, segment_id int, step_nr long, class_label string", "step_nr long, class_label string", "update", GroupStateTimeout.NoTimeout)


def floor_schedule(frames: DataFrame, min_frames: int, interval: int) -> DataFrame:
    """session_id, step_nr, action (detect, refine or none) of a floor detector whose attempts succeed.

    It detects at the min_frames-th frame and refines whenever `interval` frames have passed since the last refinement,
    counted from the run's start.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        count, found, last = state.get if state.exists else (0, False, 0)
        rows, actions = pd.concat(list(batches)).sort_values("step_nr"), []
        for _ in range(len(rows)):
            count += 1
            action = "none"
            if not found and count >= min_frames:
                found, action = True, "detect"
            elif found and count - last >= interval:
                last, action = count, "refine"
            actions.append(action)
        state.update((count, found, last))
        yield pd.DataFrame({"session_id": key[0], "step_nr": rows["step_nr"], "action": actions})

    return frames.select("session_id", "step_nr").groupBy("session_id").applyInPandasWithState(step, "session_id string, step_nr long, action string", "count long, found boolean, last long", "append", GroupStateTimeout.NoTimeout)


def floor_detector(frames: DataFrame, min_frames: int, interval: int) -> DataFrame:
    """session_id, step_nr, action (detect, refine or none), and the plane in force: nx, ny, nz, offset (null before the first).

    `frames` has what an attempt at each frame would find (nx, ny, nz, offset), null where it would fail. From the
    min_frames-th frame on every frame is tried until one succeeds; then every `interval` frames (0: never) the plane is
    refined, and an attempt that fails counts as one and keeps the plane there is.
    """
    names = ["nx", "ny", "nz", "offset"]

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        count, found, last, *plane = state.get if state.exists else (0, False, 0, 0.0, 0.0, 0.0, 0.0)
        rows, out = pd.concat(list(batches)).sort_values("step_nr"), []
        for r in rows[["step_nr", *names]].itertuples(index=False):
            count += 1
            action = "none"
            if not found and count >= min_frames:
                action = "detect"
            elif found and interval > 0 and count - last >= interval:
                action, last = "refine", count
            if action != "none" and not any(pd.isna(v) for v in r[1:]):
                found, plane = True, [float(v) for v in r[1:]]
            out.append((key[0], int(r[0]), action, *(plane if found else [None] * 4)))
        state.update((count, found, last, *plane))
        yield pd.DataFrame(out, columns=["session_id", "step_nr", "action", *names])

    kinds = "nx double, ny double, nz double, offset double"
    return frames.select("session_id", "step_nr", *names).groupBy("session_id").applyInPandasWithState(step, f"session_id string, step_nr long, action string, {kinds}", f"count long, found boolean, last long, {kinds}", "append", GroupStateTimeout.NoTimeout)


def object_numbers(detections: DataFrame) -> DataFrame:
    """session_id, step_nr, object_key, object_nr: a dense number from 1 for each object in order of appearance, never reused.

    Objects that appear in one trigger are numbered by step, then key. A session's objects are few.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        number = {k: i + 1 for i, k in enumerate(state.get[0])} if state.exists else {}
        rows = pd.concat(list(batches)).dropna(subset=["object_key"]).sort_values(["step_nr", "object_key"])
        numbers = [number.setdefault(k, len(number) + 1) for k in rows["object_key"]]
        state.update((list(number),))
        yield pd.DataFrame({"session_id": key[0], "step_nr": rows["step_nr"], "object_key": rows["object_key"], "object_nr": numbers})

    return detections.select("session_id", "step_nr", "object_key").groupBy("session_id").applyInPandasWithState(step, "session_id string, step_nr long, object_key string, object_nr long", "keys array<string>", "append", GroupStateTimeout.NoTimeout)


def warning_changes(warnings: DataFrame) -> DataFrame:
    """session_id, step_nr, level, distance, previous_level, previous_distance of the records whose level isn't the one before."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        level, distance = state.get if state.exists else (None, None)
        out = []
        for r in pd.concat(list(batches)).sort_values("step_nr")[["step_nr", "level", "distance"]].itertuples(index=False):
            if r[1] != level:
                out.append((key[0], int(r[0]), r[1], float(r[2]), level, distance))
            level, distance = r[1], float(r[2])
        state.update((level, distance))
        yield pd.DataFrame(out, columns=["session_id", "step_nr", "level", "distance", "previous_level", "previous_distance"])

    kinds = "level string, distance double"
    return warnings.select("session_id", "step_nr", "level", "distance").groupBy("session_id").applyInPandasWithState(step, f"session_id string, step_nr long, {kinds}, previous_level string, previous_distance double", kinds, "append", GroupStateTimeout.NoTimeout)


def windowed_counts(events: DataFrame, size: str = "1 hour", late: str = "10 minutes", slide: str | None = None, by: Sequence[str] = ("event_type",), total: str | None = None) -> DataFrame:
    """start, `by`, n (and the sum of the column `total`) of each window, late rows admitted up to the watermark."""
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    sums = [F.sum(total).alias("total")] if total else []
    counted = events.withWatermark("ts", late).groupBy(w.alias("w"), *by).agg(F.count("*").alias("n"), *sums)
    return counted.select(F.col("w.start").alias("start"), *by, "n", *(["total"] if total else []))


def sessions(events: DataFrame, gap: str = "2 hours", late: str = "10 minutes") -> DataFrame:
    return events.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), "n")


def without_repeats(events: DataFrame, key: str = "event_id", late: str = "10 minutes") -> DataFrame:
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])
