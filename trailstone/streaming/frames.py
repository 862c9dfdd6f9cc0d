"""The frame loop as one stream: detector gate, floor detector, gravity and label memory of a session in one keyed state.

A frame waits in state until the watermark has passed its time, and is then taken in the order (time, step) whatever
the order of arrival; so the result doesn't depend on how the input is cut into triggers, as long as no frame is later than
the watermark allows (such frames are left out). The same fold over the sorted table is the batch form.

Of a session's frames with the same time and step the greatest counts, nulls below all values.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PLANE = ("nx", "ny", "nz", "offset")
#: What the loop reads: a floor attempt's plane (null where it fails), the camera's orientation, the frame's labels.
FRAME = "session_id string, ts timestamp, step_nr long, nx double, ny double, nz double, offset double, qx double, qy double, qz double, qw double, labels array<struct<segment_id: int, class_label: string>>"
OUT = "session_id string, step_nr long, run boolean, action string, nx double, ny double, nz double, offset double, gx double, gy double, gz double, labels array<struct<segment_id: int, class_label: string>>"
_LOOP = "count long, found boolean, refined long, last_run long, nx double, ny double, nz double, offset double"


@dataclass(frozen=True)
class Settings:
    """every: steps between detector runs; min_frames, interval: floor schedule; window, first: poses that gravity is taken from."""

    every: int = 5
    min_frames: int = 3
    interval: int = 10
    window: int = 30
    first: int = 10


def down_of(q: tuple[float, float, float, float]) -> tuple[float, float, float]:
    """Camera-down of a quaternion xyzw: minus the second column of its rotation."""
    n = math.sqrt(sum(v * v for v in q))
    x, y, z, w = (v / n for v in q) if n else (0.0, 0.0, 0.0, 1.0)
    return -2 * (x * y - w * z), -(1 - 2 * (x * x + z * z)), -2 * (y * z + w * x)


class Loop:
    """What a session has come to; `advance` takes one frame."""

    def __init__(self, settings: Settings, count=0, found=False, refined=0, last_run=None, plane=(None,) * 4, downs=(), labels=None):
        self.settings, self.count, self.found, self.refined, self.last_run = settings, count, found, refined, last_run
        self.plane, self.downs, self.labels = tuple(plane), list(downs), dict(labels or {})

    def advance(self, step: int, plane: tuple, q: tuple, labels: list) -> tuple:
        s = self.settings
        run = self.last_run is None or step - self.last_run >= s.every
        self.last_run = step if run else self.last_run
        self.count += 1
        action = "none"
        if not self.found and self.count >= s.min_frames:
            action = "detect"
        elif self.found and s.interval > 0 and self.count - self.refined >= s.interval:
            action, self.refined = "refine", self.count
        if action != "none" and all(v is not None for v in plane):
            self.found, self.plane = True, plane
        if all(v is not None for v in q):
            self.downs = [*self.downs, down_of(q)][-s.window :]
        for segment, label in labels:
            self.labels[segment] = max(self.labels.get(segment, (step, "")), (step, label))
        return (step, run, action, *self.plane, *self.gravity(), sorted((k, v[1]) for k, v in self.labels.items()))

    def gravity(self) -> tuple:
        """Mean down of the oldest `first` poses of the window; (0, 0, -1) if it vanishes, null before the first pose."""
        some = self.downs[: self.settings.first]
        if not some:
            return None, None, None
        mean = [sum(d[i] for d in some) / len(some) for i in range(3)]
        n = math.sqrt(sum(v * v for v in mean))
        return tuple(round(v / n, 6) + 0.0 for v in mean) if n > 1e-6 else (0.0, 0.0, -1.0)


def _frame(r) -> tuple:
    """(plane, q, labels) of a row of FRAME or of its packed form."""
    none = lambda v: None if v is None or v != v else float(v)
    labels = [(int(x["segment_id"]), str(x["class_label"])) for x in (r["labels"] if r["labels"] is not None else []) if x["segment_id"] is not None and x["class_label"] is not None]
    return tuple(none(r[c]) for c in PLANE), tuple(none(r[c]) for c in ("qx", "qy", "qz", "qw")), sorted(labels)


def _rank(frame: tuple) -> tuple:
    """By which frames of one time and step are compared."""
    plane, q, labels = frame
    return tuple((v is not None, v or 0.0) for v in (*plane, *q)), tuple(labels)


def _table(session: str, rows: list[tuple]) -> pd.DataFrame:
    names = ["step_nr", "run", "action", *PLANE, "gx", "gy", "gz", "labels"]
    out = pd.DataFrame(rows, columns=names)
    out["labels"] = [[{"segment_id": k, "class_label": v} for k, v in x] for x in out["labels"]]
    out.insert(0, "session_id", session)
    return out


class FrameProcessor(StatefulProcessor):
    """Typed state of a session: a value for the loop, a list of camera-downs, maps of labels and of waiting frames."""

    def __init__(self, settings: Settings):
        self.settings = settings

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.loop = handle.getValueState("loop", _LOOP)
        self.downs = handle.getListState("downs", "x double, y double, z double")
        self.labels = handle.getMapState("labels", "segment_id int", "step_nr long, class_label string")
        self.waiting = handle.getMapState("waiting", "us long, step_nr long", "frame string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()
        for batch in rows:
            for r in batch.to_dict("records"):
                us, step = int(r["us"]), int(r["step_nr"])
                expires = -(-us // 1000)
                if expires <= passed:
                    continue
                frame, at = _frame(r), (us, step)
                if self.waiting.containsKey(at):
                    held = json.loads(self.waiting.getValue(at)[0])
                    frame = max(frame, _unpacked(held), key=_rank)
                self.waiting.updateValue(at, (json.dumps(frame),))
                self.handle.registerTimer(expires)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        until = expiredTimerInfo.getExpiryTimeInMs() * 1000
        due = sorted(tuple(k) for k in self.waiting.keys() if k[0] <= until)
        if not due:
            return
        count, found, refined, last_run, *plane = self.loop.get() if self.loop.exists() else (0, False, 0, None, *(None,) * 4)
        labels = {k[0]: tuple(v) for k, v in self.labels.iterator()}
        loop = Loop(self.settings, count, found, refined, last_run, plane, [tuple(d) for d in self.downs.get()], labels)
        out = []
        for us, step in due:
            out.append(loop.advance(step, *_unpacked(json.loads(self.waiting.getValue((us, step))[0]))))
            self.waiting.removeKey((us, step))
        self.loop.update((loop.count, loop.found, loop.refined, loop.last_run, *loop.plane))
        if loop.downs:
            self.downs.put(loop.downs)
        for segment, known in loop.labels.items():
            if labels.get(segment) != known:
                self.labels.updateValue((segment,), known)
        yield _table(key[0], out)

    def close(self) -> None:
        pass


def _unpacked(held: list) -> tuple:
    return tuple(held[0]), tuple(held[1]), [tuple(x) for x in held[2]]


def frame_loop(frames: DataFrame, settings: Settings = Settings(), late: str = "10 seconds") -> DataFrame:
    """OUT for each frame of a stream (append mode), once the watermark has passed it. Needs the RocksDB state store."""
    rows = frames.withWatermark("ts", late).withColumn("us", F.unix_micros("ts"))
    return rows.groupBy("session_id").transformWithStateInPandas(FrameProcessor(settings), OUT, "append", "eventTime")


def frame_loop_batch(frames: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """The same of a table: sessions are dealt to tasks and read in order, one batch at a time."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        loop, session, held, at = None, None, None, None
        out: list[tuple] = []

        def flush() -> None:
            nonlocal held
            if held is not None:
                out.append(loop.advance(at[1], *held))
                held = None

        for batch in batches:
            for r in batch.to_dict("records"):
                if loop is None or r["session_id"] != session:
                    flush()
                    if out:
                        yield _table(session, out)
                        out = []
                    loop, session, at = Loop(settings), r["session_id"], None
                now, frame = (int(r["us"]), int(r["step_nr"])), _frame(r)
                if now == at:
                    held = max(held, frame, key=_rank)
                    continue
                flush()
                held, at = frame, now
            if out:
                yield _table(session, out)
                out = []
        flush()
        if out:
            yield _table(session, out)

    rows = frames.withColumn("us", F.unix_micros("ts"))
    return rows.repartition("session_id").sortWithinPartitions("session_id", "us", "step_nr").mapInPandas(run, OUT)
