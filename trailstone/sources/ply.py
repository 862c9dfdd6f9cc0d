"""PLY point clouds as a Spark data source: ranges of one file go to many tasks, files appear when the whole write commits.

Reading plans on headers alone: a binary file is cut into ranges of VERTICES vertices, each of which a task finds by its
offset and reads in blocks; filters on step_nr, point_id and path leave files and ranges out before anything is read. ASCII
files, whose vertices have no fixed place, are one range each, read line by line.

Writing takes Arrow batches, cuts them into files of at most MOST vertices (a header needs the number ahead of the
vertices, so that many are held) under a folder of the job, and moves them to their places when all tasks have ended well.
A task that runs twice leaves files that no message names, and they go with the job's folder.

Files are reached through Arrow's file systems (local and mounted folders, HDFS, S3, GCS by the scheme of the path); for
other stores the option `filesystem` names a function, `module:function`, that takes the path and gives (file system, path in
it). A scheme that none of these knows is an error, never a local folder.
"""

from __future__ import annotations

import fnmatch
import importlib
import posixpath
import re
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual, WriterCommitMessage

#: The format's type names.
TYPES = {"char": "i1", "uchar": "u1", "short": "i2", "ushort": "u2", "int": "i4", "uint": "u4", "float": "f4", "double": "f8", "int8": "i1", "uint8": "u1", "int16": "i2", "uint16": "u2", "int32": "i4", "uint32": "u4", "float32": "f4", "float64": "f8"}
#: Our column for each vertex property.
COLUMNS = {"x": ("x", "double"), "y": ("y", "double"), "z": ("z", "double"), "red": ("r", "short"), "green": ("g", "short"), "blue": ("b", "short"), "confidence": ("confidence", "double"), "segmentation": ("segment_id", "int")}
SCHEMA = "path string, step_nr long, point_id long, " + ", ".join(f"{c} {k}" for c, k in COLUMNS.values())
#: Vertices of one batch, of one task's range, of one written file at most.
ROWS, VERTICES, MOST = 1 << 18, 1 << 22, 1 << 22
_STEP = re.compile(r"step_(\d+)")


def filesystem_of(path: str, by: str | None = None) -> tuple[pafs.FileSystem, str]:
    """The file system of a path, and the path in it; `by` is a `module:function` that knows further schemes."""
    if by:
        module, _, name = by.partition(":")
        return getattr(importlib.import_module(module), name)(path)
    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    if "://" in path:
        return pafs.FileSystem.from_uri(path)
    return pafs.LocalFileSystem(), path


def _listed(fs: pafs.FileSystem, pattern: str) -> list[str]:
    """Files that match, in the order of their names; a folder stands for the clouds in it and below."""
    if not re.search(r"[*?\[]", pattern):
        info = fs.get_file_info(pattern)
        if info.type == pafs.FileType.File:
            return [pattern]
        if info.type == pafs.FileType.NotFound:
            raise FileNotFoundError(pattern)
        inside = fs.get_file_info(pafs.FileSelector(pattern, recursive=True))
        shown = [i.path for i in inside if i.type == pafs.FileType.File and i.path.endswith(".ply")]
        return sorted(p for p in shown if not any(x[:1] in "_." for x in p[len(pattern) :].split("/") if x))
    parts = pattern.split("/")
    fixed = next(i for i, p in enumerate(parts) if re.search(r"[*?\[]", p))
    found = ["/".join(parts[:fixed]) or "/"]
    for i in range(fixed, len(parts)):
        last, below = i == len(parts) - 1, []
        for folder in found:
            for info in fs.get_file_info(pafs.FileSelector(folder, allow_not_found=True)):
                if fnmatch.fnmatchcase(info.base_name, parts[i]) and (info.type == pafs.FileType.File if last else info.type == pafs.FileType.Directory):
                    below.append(info.path)
        found = below
    return sorted(found)


def read_header(f) -> tuple[str, int, list[tuple[str, str]]]:
    """(format, vertices, [(property, numpy type)]); exactly one element, named vertex."""
    if f.readline().strip() != b"ply":
        raise ValueError("not a PLY file")
    kind, n, fields, elements = "", 0, [], 0
    while True:
        line = f.readline()
        if not line:
            raise ValueError("PLY header does not end")
        word = line.decode("ascii", "replace").split()
        if not word or word[0] in ("comment", "obj_info"):
            continue
        if word[0] == "end_header":
            break
        if word[0] == "format":
            kind = word[1]
        elif word[0] == "element":
            elements += 1
            if word[1] != "vertex" or elements > 1:
                raise ValueError("a PLY cloud has exactly one element, vertex")
            n = int(word[2])
        elif word[0] == "property":
            if word[1] == "list":
                raise ValueError("list properties are not part of a cloud")
            fields.append((word[2], TYPES[word[1]]))
    if kind not in ("binary_little_endian", "binary_big_endian", "ascii"):
        raise ValueError(f"unknown PLY format {kind!r}")
    return kind, n, fields


def _step_of(path: str) -> int | None:
    found = _STEP.findall(path)
    return int(found[0]) if found else None


def _batch(path: str, first: int, rows: dict[str, np.ndarray], n: int) -> pa.RecordBatch:
    kinds = {"double": pa.float64(), "short": pa.int16(), "int": pa.int32()}
    columns = {"path": pa.array([path] * n, pa.string()), "step_nr": pa.array([_step_of(path)] * n, pa.int64()), "point_id": pa.array(np.arange(first, first + n))}
    for name, (column, kind) in COLUMNS.items():
        columns[column] = pa.array(rows[name].astype(kinds[kind].to_pandas_dtype())) if name in rows else pa.nulls(n, kinds[kind])
    return pa.RecordBatch.from_pydict(columns)


class _Lines:
    """readline() over a stream of bytes, read in blocks."""

    def __init__(self, stream, block: int = 1 << 16):
        self.stream, self.block, self.held, self.read = stream, block, b"", 0

    def readline(self) -> bytes:
        while (at := self.held.find(b"\n")) < 0:
            more = self.stream.read(self.block)
            if not more:
                line, self.held = self.held, b""
                break
            self.held += more
        else:
            line, self.held = self.held[: at + 1], self.held[at + 1 :]
        self.read += len(line)
        return line


@dataclass
class PlyRange(InputPartition):
    """Vertices first to after of a file; where they begin and how they are laid out."""

    path: str
    shown: str
    kind: str
    fields: list[tuple[str, str]]
    start: int
    first: int
    after: int


def _plan(fs: pafs.FileSystem, path: str, shown: str, vertices: int) -> list[PlyRange]:
    with fs.open_input_stream(path) as stream:
        lines = _Lines(stream)
        kind, n, fields = read_header(lines)
    if kind == "ascii":
        return [PlyRange(path, shown, kind, fields, lines.read, 0, n)]
    size = np.dtype([(name, t) for name, t in fields]).itemsize
    there = (fs.get_file_info(path).size - lines.read) // max(size, 1)
    if there < n:
        raise ValueError(f"{shown} ends after {there} of {n} vertices")
    return [PlyRange(path, shown, kind, fields, lines.read, a, min(a + vertices, n)) for a in range(0, n, vertices)]


def _read(fs: pafs.FileSystem, part: PlyRange) -> Iterator[pa.RecordBatch]:
    names = [name for name, _ in part.fields]
    if part.kind == "ascii":
        with fs.open_input_stream(part.path) as stream:
            lines = _Lines(stream)
            read_header(lines)
            for first in range(0, part.after, ROWS):
                rows = [line.split()[: len(names)] for _ in range(min(ROWS, part.after - first)) if (line := lines.readline()).strip()]
                if len(rows) < min(ROWS, part.after - first):
                    raise ValueError(f"{part.shown} ends after {first + len(rows)} of {part.after} vertices")
                grid = np.array(rows, np.float64)
                yield _batch(part.shown, first, {name: grid[:, i] for i, name in enumerate(names)}, len(rows))
        return
    dtype = np.dtype([(name, ("<" if part.kind == "binary_little_endian" else ">") + t) for name, t in part.fields])
    with fs.open_input_file(part.path) as f:
        for first in range(part.first, part.after, ROWS):
            n = min(ROWS, part.after - first)
            table = np.frombuffer(f.read_at(n * dtype.itemsize, part.start + first * dtype.itemsize), dtype)
            yield _batch(part.shown, first, {name: table[name] for name in names}, len(table))


class PlyReader(DataSourceReader):
    #: Filters that are decided from a file's path and a range's place, as (low, high) or a set of values.
    _BOUNDS = {GreaterThan: lambda v: (v + 1, None), GreaterThanOrEqual: lambda v: (v, None), LessThan: lambda v: (None, v - 1), LessThanOrEqual: lambda v: (None, v), EqualTo: lambda v: (v, v)}

    def __init__(self, options):
        self.paths, self.by = options["path"].split("\n"), options.get("filesystem")
        self.skip_bad, self.vertices = options.get("skipBad", "false").lower() == "true", int(options.get("vertices", VERTICES))
        self.steps: set[int] | None = None
        self.bounds: dict[str, list[int | None]] = {"step_nr": [None, None], "point_id": [None, None]}

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Steps are decided here; a range of ids is cut out, so Spark looks at its points once more."""
        for f in filters:
            name = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if name == "step_nr" and isinstance(f, In):
                own = {v for v in f.value if v is not None}
                self.steps = own if self.steps is None else self.steps & own
            elif name in self.bounds and type(f) in self._BOUNDS and f.value is not None:
                for i, v in enumerate(self._BOUNDS[type(f)](f.value)):
                    if v is not None:
                        held = self.bounds[name][i]
                        self.bounds[name][i] = v if held is None else (min if i else max)(held, v)
            elif not (name in ("path", "point_id") and isinstance(f, IsNotNull)):
                yield f
                continue
            if name == "point_id" and not isinstance(f, IsNotNull):
                yield f

    def _wanted(self, path: str) -> bool:
        step, (low, high) = _step_of(path), self.bounds["step_nr"]
        if step is None:
            return self.steps is None and low is None and high is None
        return (self.steps is None or step in self.steps) and (low is None or step >= low) and (high is None or step <= high)

    def partitions(self) -> list[PlyRange]:
        out = []
        low, high = self.bounds["point_id"]
        for pattern in self.paths:
            fs, inside = filesystem_of(pattern, self.by)
            root = pattern[: len(pattern) - len(inside)] if pattern.endswith(inside) else ""
            for path in _listed(fs, inside):
                if not self._wanted(root + path):
                    continue
                try:
                    found = _plan(fs, path, root + path, self.vertices)
                except (ValueError, KeyError):
                    if not self.skip_bad:
                        raise
                    continue
                out += [p for p in found if p.after > p.first and (p.kind == "ascii" or (low is None or p.after > low) and (high is None or p.first <= high))]
        return out or [PlyRange("", "", "", [], 0, 0, 0)]

    def read(self, part: PlyRange) -> Iterator[pa.RecordBatch]:
        if part.after > part.first:
            fs = filesystem_of(part.shown, self.by)[0]
            try:
                yield from list(_read(fs, part)) if self.skip_bad and part.kind == "ascii" else _read(fs, part)
            except (ValueError, KeyError):
                if not self.skip_bad:
                    raise


@dataclass
class PlyDone(WriterCommitMessage):
    """Files that a task has written, as (name in the job's folder, place under the path)."""

    files: list[tuple[str, str]]


class PlyWriter(DataSourceArrowWriter):
    """Binary files in the folder of the job; which optional columns they have follows from the data frame's columns."""

    def __init__(self, options, schema, overwrite: bool):
        self.path, self.by, self.overwrite, self.names = options["path"].rstrip("/"), options.get("filesystem"), overwrite, schema.names
        self.most = int(options.get("most", MOST))
        self.job = f"_temporary/{uuid.uuid4().hex}"
        filesystem_of(self.path, self.by)  # a scheme that nobody knows fails before any task starts

    def _fields(self) -> list[tuple[str, str, str]]:
        kinds = {"x": "<f4", "y": "<f4", "z": "<f4", "confidence": "<f4"}
        return [(prop, kinds.get(c, "u1"), c) for prop, (c, _) in COLUMNS.items() if c in self.names]

    def _vertices(self, batch: pa.RecordBatch) -> np.ndarray:
        fields = self._fields()
        out = np.empty(batch.num_rows, [(prop, t) for prop, t, _ in fields])
        for prop, t, c in fields:
            column = batch.column(batch.schema.get_field_index(c))
            out[prop] = column.cast(pa.float64()).to_numpy(zero_copy_only=False) if t == "<f4" else column.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) % 256
        return out

    def write(self, batches: Iterator[pa.RecordBatch]) -> PlyDone:
        from pyspark import TaskContext

        fs, root = filesystem_of(self.path, self.by)
        folder = f"{root}/{self.job}/{uuid.uuid4().hex}"  # of this attempt
        task, done = TaskContext.get().partitionId(), []
        held: list[np.ndarray] = []
        step: int | None = None

        def close() -> None:
            nonlocal held
            n = sum(map(len, held))
            if n:
                shown = {"<f4": "float", "u1": "uchar"}
                head = "\n".join(["ply", "format binary_little_endian 1.0", f"element vertex {n}", *(f"property {shown[t]} {prop}" for prop, t, _ in self._fields()), "end_header", ""])
                name = f"{folder}/{len(done)}.ply"
                fs.create_dir(folder, recursive=True)
                with fs.open_output_stream(name) as f:
                    f.write(head.encode())
                    for block in held:
                        f.write(block.tobytes())
                place = f"part-{task:05d}-{len(done):03d}.ply"
                done.append((name, place if step is None else f"step_{step:06d}/{place}"))
            held = []

        for batch in batches:
            steps = batch.column(batch.schema.get_field_index("step_nr")).to_numpy(zero_copy_only=False) if "step_nr" in self.names else np.zeros(batch.num_rows)
            cuts = [0, *(np.flatnonzero(np.diff(steps)) + 1).tolist(), batch.num_rows] if batch.num_rows else []
            vertices = self._vertices(batch)
            for a, b in zip(cuts, cuts[1:], strict=False):
                own = int(steps[a]) if "step_nr" in self.names else None
                if own != step:
                    close()
                    step = own
                while a < b:
                    room = self.most - sum(map(len, held))
                    held.append(vertices[a : min(a + room, b)])
                    a = min(a + room, b)
                    if sum(map(len, held)) >= self.most:
                        close()
        close()
        return PlyDone(done)

    def commit(self, messages) -> None:
        fs, root = filesystem_of(self.path, self.by)
        fs.create_dir(root, recursive=True)
        old = set(_listed(fs, root)) if self.overwrite else set()
        tag = "" if self.overwrite else f"{uuid.uuid4().hex[:8]}-"  # files that are added don't meet those there are
        for name, place in [f for m in messages if m for f in m.files]:
            to = f"{root}/{posixpath.dirname(place)}{'/' if '/' in place else ''}{tag}{posixpath.basename(place)}"
            fs.create_dir(posixpath.dirname(to), recursive=True)
            fs.move(name, to)
            old.discard(to)
        for path in old:
            fs.delete_file(path)
        self._clear(fs, root)

    def abort(self, messages) -> None:
        self._clear(*filesystem_of(self.path, self.by))

    def _clear(self, fs: pafs.FileSystem, root: str) -> None:
        for folder in (f"{root}/{self.job}", f"{root}/_temporary"):
            if fs.get_file_info(folder).type == pafs.FileType.Directory and (folder.endswith(self.job) or not fs.get_file_info(pafs.FileSelector(folder))):
                fs.delete_dir(folder)


class PlyDataSource(DataSource):
    """format("ply"); options: path (several by line), filesystem, skipBad, vertices (of a task's range), most (of a file)."""

    @classmethod
    def name(cls) -> str:
        return "ply"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> PlyReader:
        return PlyReader(self.options)

    def writer(self, schema, overwrite: bool) -> PlyWriter:
        return PlyWriter(self.options, schema, overwrite)


def read_ply(spark: SparkSession, path: str | list[str], skip_bad: bool = False, **options: str) -> DataFrame:
    """Points of all files that match; absent colours, confidence and segments are null. step_nr comes from step_N in a path.

    With skip_bad, files that are no clouds are left out. Turns on the session's push-down of filters to Python sources.
    """
    spark.dataSource.register(PlyDataSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    paths = [path] if isinstance(path, str) else path
    # a plan without any filter would take the ranges that the last filtered plan of the same data frame left over
    return spark.read.format("ply").options(skipBad=str(skip_bad).lower(), **options).load("\n".join(paths)).where("path IS NOT NULL")


def write_ply(points: DataFrame, path: str, mode: str = "overwrite", by_step: bool = False, only_last: bool = False, **options: str) -> None:
    """Part files under a folder, with the columns that `points` has among those of COLUMNS.

    by_step makes a folder step_N for each step_nr, only_last writes the points of the greatest one alone.
    """
    points.sparkSession.dataSource.register(PlyDataSource)
    if only_last:
        points = points.where(F.col("step_nr") == F.lit(points.agg(F.max("step_nr")).first()[0]))
    have = [c for c, _ in COLUMNS.values() if c in points.columns]
    if by_step:
        out = points.where("step_nr IS NOT NULL").select("step_nr", *have).repartition("step_nr").sortWithinPartitions("step_nr")
    else:
        out = points.select(*have)
    out.write.format("ply").options(**options).mode(mode).save(path)

