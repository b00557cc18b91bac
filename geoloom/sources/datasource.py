"""Drawing, mesh and drill files as Spark data sources: ``spark.read.format("dxf")``, ``"stl"``, ``"drill"``.

A file is read in byte ranges by as many tasks as it takes; each task finds the first record that starts in its range
and reads on to the end of the last one. Records say where they start, so no task needs what came before:
a drawing entity starts at a line ``0`` followed by a name (after a value line ``0`` comes a number), a mesh
facet at its own line or record, a drill command at its line. ``at`` is the byte where a record starts and grows
along the file.

Writing ``"dxf"`` takes drawing lines (column text, as ``write_dxf_lines`` gives them), ``"stl"`` facets. A task writes into
a staging folder and tells its file's name; the commit moves exactly the told files, so those of tasks that failed
or ran twice go with the folder, and an aborted job leaves nothing. Names that begin with ``_`` or ``.`` are not read.

Options: ``path``; ``rangeBytes`` (the shortest range; of much data ranges are longer, so that there is not a task for every few records); ``columns`` (comma-separated, only these are parsed and returned); for drawings
``layers`` (comma-separated), and ``pushFilters`` (true: conditions on ``layer`` are taken from the query; needs
``spark.sql.python.filterPushdown.enabled``).
"""

from __future__ import annotations

import math
import posixpath
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, WriterCommitMessage,
)
from pyspark.sql.types import StructType

from geoloom.sources.dxf import SINGLE_KINDS
from geoloom.sources.stl import CORNERS, FLAT, HEADER_BYTES, RECORD

RANGE_BYTES = 16 << 20
#: ranges become longer, up to RANGE_BYTES, before there are more of them
RANGES = 256
#: bytes that a task reads on at once for the rest of its last record
MORE = 1 << 16

_ENTITY = re.compile(rb"(?:\A|(?<=\n))[ \t]*0[ \t]*\r?\n[ \t]*([A-Z][A-Z0-9_]*)[ \t]*\r?\n")
_FACET = re.compile(rb"(?:\A|(?<=\n))[ \t]*facet\b")
_VERTEX = re.compile(rb"\n[ \t]*vertex[ \t]+(\S+)[ \t]+(\S+)[ \t]+(\S+)")
_RECORD = np.dtype([(n, t, *([(s[0],)] if s else [])) for n, t, *s in RECORD])


def open_store(path: str) -> tuple[fs.FileSystem, str]:
    """File system and path within it."""
    if not re.match(r"[a-zA-Z][a-zA-Z0-9+.-]*:/", path):
        return fs.LocalFileSystem(), path
    return fs.FileSystem.from_uri(re.sub("^file:/+", "file:///", path))


@dataclass
class ByteRange(InputPartition):
    file: str
    start: int
    end: int
    size: int


def byte_ranges(path: str, step: int) -> list[ByteRange]:
    """Ranges of all files at or below ``path``; only names and sizes are looked at."""
    store, root = open_store(path)
    info = store.get_file_info(root)
    found = [info] if info.type == fs.FileType.File else store.get_file_info(fs.FileSelector(root, recursive=True))
    hidden = re.compile(r"(^|/)[_.]")
    files = [f for f in found if f.type == fs.FileType.File and not hidden.search(f.path[len(root) :])]
    prefix = path[: len(path) - len(root)] if path.endswith(root) else ""
    files = [f for f in files if f.size]
    step = max(step, min(RANGE_BYTES, sum(f.size for f in files) // RANGES))
    return [
        ByteRange(prefix + f.path, a, min(a + step, f.size), f.size) for f in sorted(files, key=lambda f: f.path) for a in range(0, f.size, step)
    ]


class Text:
    """A byte range of a file with as many of the following bytes as are asked for."""

    def __init__(self, part: ByteRange):
        store, name = open_store(part.file)
        self.file, self.part = store.open_input_file(name), part
        self.before = 1 if part.start else 0  # the byte before shows whether a line begins here
        self.file.seek(part.start - self.before)
        self.data = self.file.read(part.end - part.start + self.before)

    def grow(self) -> bool:
        more = self.file.read(MORE)
        self.data += more
        return bool(more)

    def records(self, begins: re.Pattern) -> Iterator[tuple[int, bytes]]:
        """(offset, bytes) of the records that start in the range, each up to the next start or the file's end."""
        end = self.before + self.part.end - self.part.start
        found = begins.search(self.data, self.before)
        while found is None and len(self.data) - end < 512 and self.grow():  # a start may be cut by the end of the range
            found = begins.search(self.data, self.before)
        while found is not None and found.start() < end:
            after = begins.search(self.data, found.end())
            while after is None and self.grow():
                after = begins.search(self.data, found.end())
            stop = after.start() if after is not None else len(self.data)
            yield self.part.start - self.before + found.start(), self.data[found.start() : stop]
            found = after


def _table(rows: list[tuple], names: list[str], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    if rows:
        columns = dict(zip(names, zip(*rows)))
        yield pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in schema], schema=schema)


class RangeReader(DataSourceReader):
    """Reads the records of one format; subclasses give ``rows``."""

    names: list[str] = []
    at_once = 1 << 14

    def __init__(self, schema: StructType, options: dict):
        from pyspark.sql.pandas.types import to_arrow_schema

        self.schema, self.options = to_arrow_schema(schema), options

    def partitions(self) -> list[ByteRange]:
        ranges = byte_ranges(self.options["path"], int(self.options.get("rangebytes", RANGE_BYTES)))
        return ranges or [ByteRange("", 0, 0, 0)]

    def read(self, part: ByteRange) -> Iterator[pa.RecordBatch]:
        if not part.file:
            return
        rows: list[tuple] = []
        for row in self.rows(part, set(self.schema.names)):
            rows.append(row)
            if len(rows) >= self.at_once:
                yield from _table(rows, self.names, self.schema)
                rows = []
        yield from _table(rows, self.names, self.schema)


class DrawingReader(RangeReader):
    names = ["file", "at", "kind", "layer", "x1", "y1", "z1", "x2", "y2", "z2", "r", "a0", "a1"]
    # fixed values: group codes of the coordinates, radius and angles
    codes = {b"10": "x1", b"20": "y1", b"30": "z1", b"11": "x2", b"21": "y2", b"31": "z2", b"40": "r", b"50": "a0", b"51": "a1"}

    def __init__(self, schema: StructType, options: dict):
        super().__init__(schema, options)
        told = options.get("layers")
        self.layers = None if told is None else set(told.split(","))

    def rows(self, part: ByteRange, wanted: set[str]) -> Iterator[tuple]:
        for at, data in Text(part).records(_ENTITY):
            lines = [x.strip() for x in data.split(b"\n")]
            kind = lines[1].decode()
            if kind not in SINGLE_KINDS:
                continue
            values = dict(zip(reversed(lines[0 : len(lines) // 2 * 2 : 2]), reversed(lines[1::2])))  # the first of each code
            layer = values.get(b"8", b"0").decode(errors="replace")
            if self.layers is not None and layer not in self.layers:
                continue
            told = {n: float(values[c]) for c, n in self.codes.items() if c in values and n in wanted}
            for n in ("a0", "a1"):
                if n in told:
                    told[n] = math.radians(told[n])
            yield (part.file, at, kind, layer, *(told.get(n) for n in self.codes.values()))


class PushingDrawingReader(DrawingReader):
    """Takes conditions on ``layer`` from the query; for sessions that allow it."""

    def pushFilters(self, filters: list[Filter]):
        for one in filters:
            if isinstance(one, (EqualTo, In)) and one.attribute == ("layer",):
                wanted = {one.value} if isinstance(one, EqualTo) else set(one.value)
                self.layers = wanted if self.layers is None else self.layers & wanted
            else:
                yield one


class MeshReader(RangeReader):
    names = ["file", "at", *CORNERS]

    def read(self, part: ByteRange) -> Iterator[pa.RecordBatch]:
        if not part.file:
            return
        store, name = open_store(part.file)
        with store.open_input_file(name) as file:
            head = file.read(HEADER_BYTES + 4)
            held = int(np.frombuffer(head[HEADER_BYTES:], "<u4")[0]) if len(head) == HEADER_BYTES + 4 else 0
            # a text file may begin like a binary one, but its size does not follow from a count
            if HEADER_BYTES + 4 + held * _RECORD.itemsize != part.size:
                yield from super().read(part)
                return
            first, last = (min(held, max(0, -(-(x - HEADER_BYTES - 4) // _RECORD.itemsize))) for x in (part.start, part.end))
            for a in range(first, last, self.at_once):
                n = min(self.at_once, last - a)
                file.seek(HEADER_BYTES + 4 + a * _RECORD.itemsize)
                corners = np.frombuffer(file.read(n * _RECORD.itemsize), _RECORD, n)["corners"].astype("f8")
                keep = np.ptp(corners[:, 2::3], axis=1) > FLAT
                found = {c: corners[keep, k] for k, c in enumerate(CORNERS)}
                found |= {"file": [part.file] * int(keep.sum()), "at": HEADER_BYTES + 4 + (a + np.flatnonzero(keep)) * _RECORD.itemsize}
                yield pa.RecordBatch.from_arrays([pa.array(found[f.name], f.type) for f in self.schema], schema=self.schema)

    def rows(self, part: ByteRange, wanted: set[str]) -> Iterator[tuple]:
        for at, data in Text(part).records(_FACET):
            corners = [float(x) for v in _VERTEX.findall(data)[:3] for x in v]
            if len(corners) == 9 and max(corners[2::3]) - min(corners[2::3]) > FLAT:
                yield (part.file, at, *corners)


class DrillReader(RangeReader):
    names = ["file", "at", "text"]
    line = re.compile(rb"(?:\A|(?<=\n))[^\r\n]")

    def rows(self, part: ByteRange, wanted: set[str]) -> Iterator[tuple]:
        for at, data in Text(part).records(self.line):
            yield part.file, at, data.rstrip(b"\r\n").decode(errors="replace")


@dataclass
class Written(WriterCommitMessage):
    name: str | None
    rows: int


class StagedWriter(DataSourceArrowWriter):
    """One file a task, moved to its place by the commit."""

    suffix = ""

    def __init__(self, options: dict, overwrite: bool):
        self.path, self.overwrite, self.staging = options["path"].rstrip("/"), overwrite, f"_staging-{uuid.uuid4().hex}"

    def _places(self) -> tuple[fs.FileSystem, str, str]:
        store, root = open_store(self.path)
        return store, root, posixpath.join(root, self.staging)

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        store, _, staging = self._places()
        name, rows, out = f"{uuid.uuid4().hex}{self.suffix}", 0, None
        for batch in batches:
            if batch.num_rows and out is None:
                store.create_dir(staging, recursive=True)
                out = store.open_output_stream(posixpath.join(staging, name), compression=None)
                out.write(self.head(0))
            if batch.num_rows:
                out.write(self.body(batch))
                rows += batch.num_rows
        if out is None:
            return Written(None, 0)
        out.close()
        self.finish(store, posixpath.join(staging, name), rows)
        return Written(name, rows)

    def head(self, rows: int) -> bytes:
        return b""

    def finish(self, store: fs.FileSystem, path: str, rows: int) -> None:
        pass

    def commit(self, messages: list[Written | None]) -> None:
        store, root, staging = self._places()
        store.create_dir(root, recursive=True)
        old = [f.path for f in store.get_file_info(fs.FileSelector(root)) if f.type == fs.FileType.File] if self.overwrite else []
        told = [m for m in messages if m is not None and m.name]
        for k, message in enumerate(told):
            store.move(posixpath.join(staging, message.name), posixpath.join(root, f"part-{k:05d}-{message.name}"))
        for path in old:
            store.delete_file(path)
        if told:
            store.delete_dir(staging)

    def abort(self, messages: list[Written | None]) -> None:
        store, _, staging = self._places()
        if store.get_file_info(staging).type == fs.FileType.Directory:
            store.delete_dir(staging)


class LineWriter(StagedWriter):
    suffix = ".dxf"

    def body(self, batch: pa.RecordBatch) -> bytes:
        texts = batch.column("text").drop_null()
        if not len(texts):
            return b""
        joined = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(texts)], pa.int32()), texts), "\n")
        return joined[0].as_buffer().to_pybytes() + b"\n"


class MeshWriter(StagedWriter):
    suffix = ".stl"

    def head(self, rows: int) -> bytes:
        return b"\0" * HEADER_BYTES + np.uint32(rows).tobytes()

    def body(self, batch: pa.RecordBatch) -> bytes:
        records = np.zeros(batch.num_rows, _RECORD)
        for k, c in enumerate(CORNERS):
            records["corners"][:, k] = batch.column(c).to_numpy(zero_copy_only=False)
        return records.tobytes()

    def finish(self, store: fs.FileSystem, path: str, rows: int) -> None:
        """The count stands before the records: it is known when they are written, so the file is copied behind it."""
        with store.open_input_stream(path, compression=None) as done, store.open_output_stream(path + ".told", compression=None) as out:
            done.read(HEADER_BYTES + 4)
            out.write(self.head(rows))
            while data := done.read(1 << 20):
                out.write(data)
        store.move(path + ".told", path)


class _Files(DataSource):
    columns = ""
    reader_of: type[RangeReader] = RangeReader
    writer_of: type[StagedWriter] | None = None

    def schema(self) -> str:
        told = self.options.get("columns")
        every = dict(c.split(" ", 1) for c in self.columns.split(", "))
        names = [c.strip() for c in told.split(",")] if told else list(every)
        return ", ".join(f"{n} {every[n]}" for n in names)

    def reader(self, schema: StructType) -> RangeReader:
        return self.reader_of(schema, dict(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> StagedWriter:
        if self.writer_of is None:
            raise NotImplementedError(f"{self.name()} files are read only")
        return self.writer_of(dict(self.options), overwrite)


class DrawingFiles(_Files):
    columns = "file string, at bigint, kind string, layer string, " + ", ".join(f"{n} double" for n in DrawingReader.names[4:])
    reader_of, writer_of = DrawingReader, LineWriter

    @classmethod
    def name(cls) -> str:
        return "dxf"

    def reader(self, schema: StructType) -> DrawingReader:
        pushing = str(self.options.get("pushfilters", "")).lower() == "true"
        return (PushingDrawingReader if pushing else DrawingReader)(schema, dict(self.options))


class MeshFiles(_Files):
    columns = "file string, at bigint, " + ", ".join(f"{c} double" for c in CORNERS)
    reader_of, writer_of = MeshReader, MeshWriter

    @classmethod
    def name(cls) -> str:
        return "stl"


class DrillFiles(_Files):
    columns = "file string, at bigint, text string"
    reader_of = DrillReader

    @classmethod
    def name(cls) -> str:
        return "drill"


def register(spark: SparkSession) -> SparkSession:
    """Makes the formats known to a session."""
    for source in (DrawingFiles, MeshFiles, DrillFiles):
        spark.dataSource.register(source)
    return spark
