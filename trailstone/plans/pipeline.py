"""A run as a list of named transforms over tables, checked before anything runs."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .staging import written

Tables = dict[str, DataFrame]
REGISTRY: dict[str, tuple[Callable[..., Tables], frozenset[str], frozenset[str]]] = {}


def register(name: str, requires: set[str], provides: set[str]):
    """Names a transform (tables, **config) -> tables, with the tables it needs and makes."""

    def add(f: Callable[..., Tables]) -> Callable[..., Tables]:
        REGISTRY[name] = (f, frozenset(requires), frozenset(provides))
        return f

    return add


@dataclass
class Step:
    type: str
    config: Mapping = field(default_factory=dict)


def steps_of(config: Mapping) -> list[Step]:
    """From {"pipeline": {"components": [{"type": ..., "config": {...}}]}}."""
    out = []
    for c in config["pipeline"]["components"]:
        if not c.get("type"):
            raise ValueError("a component has no type")
        if c["type"] not in REGISTRY:
            raise ValueError(f"unknown component type {c['type']!r}; known: {', '.join(sorted(REGISTRY))}")
        out.append(Step(c["type"], c.get("config") or {}))
    return out


def validate(steps: list[Step], given: set[str]) -> None:
    """Each step's tables are given or made by an earlier one."""
    have = set(given)
    for s in steps:
        _, requires, provides = REGISTRY[s.type]
        if missing := requires - have:
            raise ValueError(f"{s.type} needs {', '.join(sorted(missing))}")
        have |= provides


def run(steps: list[Step], tables: Tables) -> Tables:
    validate(steps, set(tables))
    for s in steps:
        f, requires, provides = REGISTRY[s.type]
        made = f({k: tables[k] for k in requires}, **s.config)
        if not isinstance(made, dict) or not provides <= set(made):
            raise TypeError(f"{s.type} must return a dict with {', '.join(sorted(provides))}")
        tables = tables | made
    return tables


def _register_own() -> None:
    from ..operators import asof, checks, floor, knn, masks, scene, stats
    from ..sources import files, ply

    @register("floor_detection", {"points", "poses"}, {"floor"})
    def _floor(t: Tables, n_iter: int = 1000, sample: int = 15_000, min_inliers: int = 1000, threshold: float = 0.05, sample_ratio: float = 0.15) -> Tables:
        planes, sampled = floor.hypotheses(t["points"], n_iter, sample, ratio=sample_ratio)
        return {"floor": floor.best_plane(floor.score_planes(planes, sampled, t["poses"], threshold), min_inliers)}

    @register("closest_points", {"points", "poses", "floor"}, {"closest"})
    def _closest(t: Tables, k: int = 20, half_angle: float | None = 45.0, only_segmented: bool = True, floor_threshold: float = 0.05) -> Tables:
        best = t["floor"].select("nx", "ny", "nz", "d").first()  # one plane
        return {"closest": knn.nearest_points(t["points"], t["poses"], k, tuple(best) if best else None, half_angle, only_segmented, floor_threshold)}

    @register("label_memory", {"closest", "segment_labels"}, {"objects"})
    def _labels(t: Tables) -> Tables:
        return {"objects": asof.label_points(t["closest"], t["segment_labels"])}

    @register("detections", {"raw_detections"}, {"detections", "rejected_detections"})
    def _detections(t: Tables, confidence: float = 0.3, iou: float = 0.5, per_frame: int = 20) -> Tables:
        """Boxes that are none go to a table of their own; of the others the sure ones, without those that cover each other."""
        boxed = t["raw_detections"].withColumn("_bbox", F.array("x1", "y1", "x2", "y2"))
        good, bad, _ = checks.split(boxed, checks.box_rules("_bbox"))
        kept = masks.suppress(good.drop("_bbox").where(F.col("confidence") >= confidence), iou)
        return {"detections": masks.strongest(kept, per_frame), "rejected_detections": bad.drop("_bbox")}

    @register("segmentation", {"mask_logits"}, {"mask_pixels"})
    def _segmentation(t: Tables, min_area: int = 200, threshold: float = 0.0) -> Tables:
        """Pixels of each object's mask: the highest logit above the threshold, masks of more than min_area pixels."""
        owned = masks.without_overlap(t["mask_logits"])
        pixels = masks.from_logits(owned, threshold)
        large = masks.by_area(pixels, min_area).select("mask_id")
        return {"mask_pixels": pixels.join(large, "mask_id", "left_semi")}

    @register("scene", {"poses", "detections", "segment_labels"}, {"scene_log"})
    def _scene(t: Tables) -> Tables:
        return {"scene_log": scene.scene_log({"pose": t["poses"], "detection": t["detections"], "label": t["segment_labels"]})}

    @register("output_writer", {"points", "poses"}, {"written_files"})
    def _writer(t: Tables, folder: str = "", name: str = "run", only_save_last: bool = False) -> Tables:
        """A run's cloud and trajectory; the table has what was written where, counted while it was."""
        if not folder:
            raise ValueError("output_writer needs a folder")
        spark, base = t["poses"].sparkSession, f"{folder.rstrip('/')}/{name}"
        seen = {k: Observation(f"written_{k}") for k in ("pointcloud", "trajectory")}
        count = F.count("*").alias("rows")
        points = t["points"]
        if only_save_last:
            points = points.where(F.col("step_nr") == F.lit(points.agg(F.max("step_nr")).first()[0]))
        ply.write_ply(points.observe(seen["pointcloud"], count), f"{base}_pointcloud", by_step="step_nr" in points.columns)
        stamped = t["poses"] if "ts_sec" in t["poses"].columns else t["poses"].withColumn("ts_sec", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6)
        files.write_trajectory(written(stamped.observe(seen["trajectory"], count), "trajectory"), f"{base}_trajectory.txt")  # a sort reads twice
        rows = [("pointcloud", f"{base}_pointcloud", seen["pointcloud"].get["rows"]), ("trajectory", f"{base}_trajectory.txt", seen["trajectory"].get["rows"])]
        return {"written_files": spark.createDataFrame(rows, "kind string, path string, rows long")}

    @register("distance_statistics", {"closest"}, {"distance_stats"})
    def _stats(t: Tables) -> Tables:
        return {"distance_stats": stats.distance_stats(t["closest"])}


_register_own()
