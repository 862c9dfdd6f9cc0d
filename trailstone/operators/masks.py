"""Masks in long form: (mask_id, row, col)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def by_area(masks: DataFrame, min_area: int = 200) -> DataFrame:
    """mask_id, area of the masks of more than min_area pixels."""
    return masks.groupBy("mask_id").agg(F.count("*").alias("area")).where(F.col("area") > min_area)


def iou(new: DataFrame, old: DataFrame) -> DataFrame:
    """new_id, old_id, iou of masks that share a pixel, by an equi-join on the pixel."""
    both = new.select("row", "col", F.col("mask_id").alias("new_id")).join(old.select("row", "col", F.col("mask_id").alias("old_id")), ["row", "col"])
    shared = both.groupBy("new_id", "old_id").agg(F.count("*").alias("s"))
    sizes = lambda t, c: t.groupBy(F.col("mask_id").alias(c)).agg(F.count("*").alias(f"n_{c}"))
    out = shared.join(sizes(new, "new_id"), "new_id").join(sizes(old, "old_id"), "old_id")
    return out.select("new_id", "old_id", F.round(F.col("s") / (F.col("n_new_id") + F.col("n_old_id") - F.col("s") + 1e-6), 6).alias("iou"))


def overwrite(masks: DataFrame) -> DataFrame:
    """row, col, mask_id: of overlapping masks the later one."""
    return masks.groupBy("row", "col").agg(F.max("mask_id").alias("mask_id"))


def resize_and_crop(mask: DataFrame, size: tuple[int, int], to: tuple[int, int], crop: tuple[int, int]) -> DataFrame:
    """Nearest-neighbour resize from `size` to `to` (rows, columns), then a centred crop; pixels by index arithmetic."""
    (h, w), (nh, nw), (ch, cw) = size, to, crop
    top, left = (nh - ch) // 2, (nw - cw) // 2

    def targets(c: str, n: int, m: int):  # new pixels i with floor((i + 0.5) * n / m) = c
        first = F.ceil(F.col(c) * F.lit(m / n) - 0.5)
        past = F.ceil((F.col(c) + 1) * F.lit(m / n) - 0.5)
        return F.when(past > first, F.sequence(first, past - 1)).otherwise(F.array().cast("array<bigint>"))

    out = mask.withColumn("_r", F.explode(targets("row", h, nh))).withColumn("_c", F.explode(targets("col", w, nw)))
    out = out.select((F.col("_r") - top).alias("row"), (F.col("_c") - left).alias("col"), "segment_id")
    return out.where(F.col("row").between(0, ch - 1) & F.col("col").between(0, cw - 1))


def pixel_ids(mask: DataFrame, width: int) -> DataFrame:
    """Row-major pixel numbers, as pointmaps are flattened."""
    return mask.select((F.col("row") * width + F.col("col")).alias("pixel_id"), "segment_id")


def _assign(cost: np.ndarray) -> list[tuple[int, int]]:
    """Least-cost assignment of rows to columns by shortest augmenting paths with potentials."""
    turned = cost.shape[0] > cost.shape[1]
    c = cost.T if turned else cost
    n, m = c.shape
    row_of, u, v = np.full(m, -1), np.zeros(n), np.zeros(m)
    for start in range(n):
        least, came, done = np.full(m, np.inf), np.full(m, -1), np.zeros(m, bool)
        row, col = start, -1
        while True:
            slack = c[row] - u[row] - v + (u[start] * 0)
            base = least[col] if col >= 0 else 0.0
            better = ~done & (slack + base < least)
            least[better], came[better] = slack[better] + base, col
            col = int(np.where(done, np.inf, least).argmin())
            done[col] = True
            if row_of[col] < 0:
                break
            row = row_of[col]
        total = least[col]
        for j in np.flatnonzero(done):
            if row_of[j] >= 0:
                u[row_of[j]] += total - least[j]
            v[j] -= total - least[j]
        u[start] += total
        while col >= 0:
            before = came[col]
            row_of[col] = start if before < 0 else row_of[before]
            col = before
    pairs = [(int(r), j) for j, r in enumerate(row_of) if r >= 0]
    return [(b, a) for a, b in pairs] if turned else pairs


def match_masks(scores: DataFrame, accept: float = 0.7, frame: str = "step_nr") -> DataFrame:
    """frame, new_id, old_id: within each frame the assignment of greatest total IoU; below `accept` old_id is null.

    A frame's masks are few (tens), so a frame is one group.
    """

    def run(f: pd.DataFrame) -> pd.DataFrame:
        new, old = sorted(f["new_id"].unique()), sorted(f["old_id"].unique())
        grid = np.zeros((len(new), len(old)))
        grid[np.searchsorted(new, f["new_id"]), np.searchsorted(old, f["old_id"])] = f["iou"]
        found = {new[i]: old[j] for i, j in _assign(-grid) if grid[i, j] >= accept}
        return pd.DataFrame({frame: f[frame].iloc[0], "new_id": new, "old_id": pd.array([found.get(i) for i in new], "Int64")})

    return scores.groupBy(frame).applyInPandas(run, f"{frame} long, new_id long, old_id long")


def suppress(detections: DataFrame, limit: float = 0.5) -> DataFrame:
    """Greedy non-maximum suppression within (step_nr, class_name): strongest first, ties by detection_id.

    A frame and class is one row, a list, as its detections are few; a batch of lists is gone through together. In each
    round the strongest that is left of each list stays, and takes out what it covers.
    """
    columns = ["step_nr", "class_name", "detection_id", "confidence", "x1", "y1", "x2", "y2"]
    kinds = dict(detections.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("rows")
            rows = pa.RecordBatch.from_struct_array(lists.flatten())
            number = lambda c: rows.column(c).to_numpy(zero_copy_only=False)  # noqa: E731, B023
            group = np.repeat(np.arange(batch.num_rows), lists.value_lengths().to_numpy(zero_copy_only=False))
            at = np.lexsort((number("detection_id"), -number("confidence").astype(float), group))
            group, box, kept = group[at], np.stack([number(c).astype(float) for c in columns[4:]], 1)[at], []
            area = (box[:, 2] - box[:, 0]) * (box[:, 3] - box[:, 1])
            while len(at):
                first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
                best = np.repeat(first, np.diff(np.r_[first, len(at)]))
                kept.append(at[first])
                w = np.minimum(box[:, 2], box[best, 2]) - np.maximum(box[:, 0], box[best, 0])
                h = np.minimum(box[:, 3], box[best, 3]) - np.maximum(box[:, 1], box[best, 1])
                shared = np.clip(w, 0, None) * np.clip(h, 0, None)
                left = ~(shared > limit * (area + area[best] - shared))
                left[first] = False
                at, group, box, area = at[left], group[left], box[left], area[left]
            if kept:
                yield rows.take(pa.array(np.concatenate(kept)))

    lists = detections.select(columns).groupBy("step_nr", "class_name").agg(F.collect_list(F.struct(*columns)).alias("rows"))
    return lists.select("rows").mapInArrow(run, ", ".join(f"{c} {kinds[c]}" for c in columns))


def strongest(detections: DataFrame, per_frame: int = 20) -> DataFrame:
    """At most `per_frame` detections of each frame, by confidence."""
    w = Window.partitionBy("step_nr").orderBy(F.desc("confidence"), "class_name", "detection_id")
    return detections.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= per_frame)


def score_frames(frames: DataFrame, scorer, schema: str) -> DataFrame:
    """Hook for a model: `scorer(pandas frame) -> pandas frame`, applied to Arrow batches."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield scorer(b)

    return frames.mapInPandas(run, schema)


def from_logits(logits: DataFrame, threshold: float = 0.0) -> DataFrame:
    """mask_id, row, col of the pixels whose logit lies above the threshold."""
    return logits.where(F.col("logit") > threshold).select("mask_id", "row", "col")


def best_by_predicted_iou(candidates: DataFrame, key: str = "object_id") -> DataFrame:
    """Of each object's candidate masks the one with the highest predicted IoU, the first of equals."""
    rest = [c for c in candidates.columns if c != key]
    best = F.max_by(F.struct(*rest), F.struct("predicted_iou", -F.col("mask_id")))
    return candidates.groupBy(key).agg(best.alias("b")).select(key, "b.*")


def without_overlap(logits: DataFrame) -> DataFrame:
    """row, col, mask_id, logit: each pixel goes to the object with the highest logit, the smaller id of equals."""
    return logits.groupBy("row", "col").agg(F.max_by(F.struct("mask_id", "logit"), F.struct("logit", -F.col("mask_id"))).alias("b")).select("row", "col", "b.*")
