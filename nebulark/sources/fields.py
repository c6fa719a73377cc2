"""Meshes and moment fields in binary files, one file or a file a run of slabs, as a Python data source.

A mesh file is a header (mesh size as an int, count of values as a long, box as a double) and the
values in order of ix, iy, iz.  A moment field has the header of domain files, then the mesh in all, here,
and from and to where along each axis, then one float a cell for each component in turn.  Written as
one file these are the plain layouts; of several, each holds a run of ix.
"""

from __future__ import annotations

import math
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThanOrEqual, InputPartition, LessThanOrEqual
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from nebulark.operators.mesh import CELL, all_cells
from nebulark.sources import domains
from nebulark.sources.staged import StagedWriter, save

# The header of a mesh file, and what a moment field has after the header of domain files.
MESH_HEADER = struct.Struct("<iqd")
MOMENT_BASE = struct.Struct(domains.HEADER.format.removesuffix("2Q"))
MOMENT_MESH = struct.Struct("<12iq")
#: Values read at a time.
SLICE = 1 << 18


def slab_runs(n: int, files: int) -> list[tuple[int, int]]:
    """The range of ix of each file."""
    return [(n * k // files, n * (k + 1) // files) for k in range(files)]


def file_name(path: str, number: int, files: int) -> str:
    return path if files == 1 else f"{path}.{number}"


def moment_header(n: int, lo: int, hi: int, box: float) -> bytes:
    base = domains.pack_header((1, 1, 1), (0, 0, 0), 0, 0, length=box)[: MOMENT_BASE.size]
    return base + MOMENT_MESH.pack(n, n, n, hi - lo, n, n, lo, hi, 0, n, 0, n, (hi - lo) * n * n)


class _Writer(StagedWriter):
    def __init__(self, options: dict, overwrite: bool):
        self.n, self.box, self.values = int(options["n"]), float(options["box"]), options["values"].split(",")
        self.moment, self.kind = options["layout"] == "moment", "<" + options.get("kind", "f4")
        super().__init__(options, overwrite)

    def name(self, part: int) -> str:
        return file_name(self.path, part, self.parts)

    def replaced(self) -> list[str]:
        fs, name = pafs.FileSystem.from_uri(self.path)
        folder, _, stem = name.rpartition("/")
        there = [i.base_name for i in fs.get_file_info(pafs.FileSelector(folder, allow_not_found=True)) if i.type == pafs.FileType.File]
        own = [x for x in there if x == stem or x.rpartition(".")[0] == stem and x.rpartition(".")[2].isdigit()]
        return [self.path + x[len(stem) :] for x in own]

    def body(self, part: int, batches: Iterator[pa.RecordBatch]) -> Iterator[bytes]:
        lo, hi = slab_runs(self.n, self.parts)[part]
        cells, at, later = (hi - lo) * self.n**2, 0, [[] for _ in self.values[1:]]
        yield moment_header(self.n, lo, hi, self.box) if self.moment else MESH_HEADER.pack(self.n, cells, self.box)
        for b in batches:  # the first component goes out as it comes, the others follow it
            x, y, z = (b.column(c).to_numpy().astype(np.int64) for c in CELL)
            if not np.array_equal(z + self.n * (y + self.n * (x - lo)), np.arange(at, at + b.num_rows)):
                raise ValueError("cells must be whole and in order")
            at += b.num_rows
            first, *rest = (b.column(v).to_numpy().astype(self.kind).tobytes() for v in self.values)
            for held, chunk in zip(later, rest, strict=True):
                held.append(chunk)
            yield first
        if at != cells:
            raise ValueError(f"{at} cells of {cells}")
        for held in later:
            yield from held


class _Split(InputPartition):
    def __init__(self, path: str, at: int, lo: int, cells: int, n: int, run: int):
        super().__init__(path)
        self.path, self.at, self.lo, self.cells, self.n, self.run = path, at, lo, cells, n, run


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.values = options["path"], options["values"].split(",")
        self.moment, self.kind = options["layout"] == "moment", np.dtype("<" + options.get("kind", "f4"))
        self.low, self.high = 0, 1 << 30

    def pushFilters(self, filters: list[Filter]):
        for f in filters:
            if isinstance(f, (EqualTo, GreaterThanOrEqual, LessThanOrEqual)) and f.attribute == ("ix",):
                self.low = max(self.low, f.value) if not isinstance(f, LessThanOrEqual) else self.low
                self.high = min(self.high, f.value) if not isinstance(f, GreaterThanOrEqual) else self.high
            yield f  # Spark checks them again

    def _head(self, path: str, lo: int) -> tuple[int, int, int, int]:
        """Mesh size, first slab, slabs and length of the header of a file."""
        fs, name = pafs.FileSystem.from_uri(path)
        with fs.open_input_stream(name) as f:
            if self.moment:
                v = MOMENT_MESH.unpack(f.read(MOMENT_BASE.size + MOMENT_MESH.size)[MOMENT_BASE.size :])
                return v[0], v[6], v[3], MOMENT_BASE.size + MOMENT_MESH.size
            n, cells, _ = MESH_HEADER.unpack(f.read(MESH_HEADER.size))
            return n, lo, cells // n**2, MESH_HEADER.size

    def partitions(self):
        out, number, lo, n = [], 0, 0, 1
        one = pafs.FileSystem.from_uri(self.path)
        single = one[0].get_file_info(one[1]).type == pafs.FileType.File
        while lo < n:
            path = self.path if single else f"{self.path}.{number}"
            n, lo, slabs, at = self._head(path, lo)
            if lo <= self.high and lo + slabs > self.low:
                out.append(_Split(path, at, lo, slabs * n * n, n, slabs))
            lo, number = lo + slabs, number + 1
        return out

    def read(self, split: _Split) -> Iterator[pa.RecordBatch]:
        fs, name = pafs.FileSystem.from_uri(split.path)
        size = self.kind.itemsize
        with fs.open_input_file(name) as f:
            for first in range(0, split.cells, SLICE):
                m = min(SLICE, split.cells - first)
                cell = np.arange(first, first + m) + split.lo * split.n**2
                cols = [pa.array(c.astype(np.int32)) for c in np.unravel_index(cell, (split.lo + split.run, split.n, split.n))]
                for k in range(len(self.values)):
                    raw = f.read_at(m * size, split.at + (k * split.cells + first) * size)
                    cols.append(pa.array(np.frombuffer(raw, self.kind).astype(np.float64)))
                yield pa.RecordBatch.from_arrays(cols, names=[*CELL, *self.values])


class FieldSource(DataSource):
    """``spark.read.format("field").options(layout="mesh" or "moment", values="val").load(path)``."""

    @classmethod
    def name(cls) -> str:
        return "field"

    def schema(self) -> StructType:
        return StructType([*[StructField(c, IntegerType()) for c in CELL], *[StructField(v, DoubleType()) for v in self.options["values"].split(",")]])

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options)

    def writer(self, schema: StructType, overwrite: bool) -> StagedWriter:
        return _Writer(self.options, overwrite)


def register(spark) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(FieldSource)


def write(field: DataFrame, path: str, n: int, box: float, *values: str, layout: str = "mesh", files: int = 1, kind: str = "f4") -> None:
    """Write a sparse or whole mesh as binary files, 0 where it has no cell; all files or none.

    ``layout`` is mesh (one value) or moment; ``kind`` is f4 or f8.  A task streams a file: of one value nothing
    is held, of several all but the first.  Any result that was at ``path`` is replaced.
    """
    if layout not in ("mesh", "moment") or kind not in ("f4", "f8") or layout == "mesh" and len(values) != 1 or not 1 <= files <= n:
        raise ValueError("layout mesh with one value or moment, kind f4 or f8, 1 to n files")
    register(field.sparkSession)
    cells = all_cells(field.sparkSession, n).join(field.select(*CELL, *values), CELL, "left").select(*CELL, *[F.coalesce(F.col(v).cast("double"), F.lit(0.0)).alias(v) for v in values])
    part = F.floor(((F.col("ix") + 1) * F.lit(files) - 1) / F.lit(n))  # the inverse of slab_runs
    save(cells, "field", path, part, files, n**3, CELL, n=n, box=box, values=",".join(values), layout=layout, kind=kind)


def read(spark, path: str, *values: str, layout: str = "mesh", kind: str = "f4") -> DataFrame:
    """ix, iy, iz and the values; a range of ix leaves files out."""
    register(spark)
    return spark.read.format("field").options(layout=layout, values=",".join(values), kind=kind).load(path)
