"""Where a run's files are: new folders, and which of several candidates is read. Names only; tables come from `files`."""

from __future__ import annotations

import posixpath
import re
from collections.abc import Mapping, Sequence
from datetime import datetime

from pyspark.sql import SparkSession

from .files import first_existing

#: The files of a run, the newer name first.
CLOUDS = ("slam_analysis_pointcloud.ply", "incremental_analysis_detailed_pointcloud.ply")
TRAJECTORIES = ("slam_analysis_trajectory.txt", "incremental_analysis_detailed_trajectory.txt")
CLOSEST_OBJECTS = ("slam_analysis_closest_objects.csv", "incremental_analysis_detailed_closest_objects.csv")
CLOSEST_POINTS = ("slam_analysis_closest_points.csv", "incremental_analysis_detailed_closest_points.csv")
#: What a converted video's name ends with, and how a run's folder is stamped.
CONVERTED, STAMP = "_rerun_compatible.mp4", "%Y%m%d_%H%M%S"


def _folder(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def next_run_name(names: Sequence[str]) -> str:
    """run_<largest + 1> among the names of a folder, run_0 where there is none."""
    return f"run_{max([-1, *(int(m[1]) for n in names if (m := re.fullmatch(r'run_(\d+)', n)))]) + 1}"


def new_run(spark: SparkSession, base: str) -> str:
    """Makes the next run's folder under `base`; two that ask at once get two folders."""
    files, root = _folder(spark, base)
    if not files.exists(root):
        raise FileNotFoundError(base)
    while True:
        names = [f.getPath().getName() for f in files.listStatus(root) if f.isDirectory()]
        path = f"{base.rstrip('/')}/{next_run_name(names)}"
        claim = _folder(spark, f"{path}/.claimed")[1]
        try:
            files.create(claim, False).close()  # fails where another has been quicker
        except Exception as e:  # noqa: BLE001  (any file system's own exception)
            if not files.exists(claim):
                raise e
            continue
        return path


def output_folder(base: str, name: str, at: datetime | None = None) -> str:
    """base/name, with a stamp where a time is given."""
    return f"{base.rstrip('/')}/{name}" + (f"_{at.strftime(STAMP)}" if at else "")


def resolved(spark: SparkSession, folder: str, file_paths: Mapping[str, str] | None, key: str, names: Sequence[str]) -> str:
    """A run's file: what its metadata says (a relative path by its name in the run's folder), else the first name there is.

    Without any the first name, which the reader will miss by that name.
    """
    folder = folder.rstrip("/")
    if file_paths is not None:
        path = file_paths.get(key, "")
        return path if path.startswith("/") or "://" in path else f"{folder}/{posixpath.basename(path)}"
    return first_existing(spark, *(f"{folder}/{n}" for n in names)) or f"{folder}/{names[0]}"


def closest_source(spark: SparkSession, folder: str, prefer_points: bool = False) -> tuple[str, str] | None:
    """("objects" or "points", path): objects where there are any and points aren't preferred; None where there is neither."""
    folder = folder.rstrip("/")
    for kind, names in (("objects", CLOSEST_OBJECTS), ("points", CLOSEST_POINTS)):
        if kind == "objects" and prefer_points:
            continue
        if found := first_existing(spark, *(f"{folder}/{n}" for n in names)):
            return kind, found
    return None


def video_path(spark: SparkSession, path: str | None, output_dir: str, working_dir: str = ".", home: str = ".") -> str | None:
    """A run's video: its configured path, a relative one below the working folder, beside the output or at home, in this order;
    the converted file beside it comes first. None where there is no file.
    """
    if not path:
        return None
    absolute = path.startswith("/") or "://" in path
    places = [path] if absolute else [f"{d.rstrip('/')}/{path}" for d in (working_dir, posixpath.dirname(output_dir.rstrip("/")) or ".", home)]
    place = first_existing(spark, *places[:-1]) or places[-1]
    stem = posixpath.splitext(posixpath.basename(place))[0]
    return first_existing(spark, f"{posixpath.dirname(place)}/{stem}{CONVERTED}", place)
