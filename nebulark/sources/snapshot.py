"""Particle snapshots in record-marked binary files, as a Python data source.

A file is a sequence of blocks, each framed by its length as a 4-byte integer: a 256-byte header,
then positions (f32 x 3), velocities (f32 x 3), ids (u64) and potentials (f32 x 2).  One file is one
input partition, read in slices; blocks that the options leave out are skipped; a position range given as
a filter is applied while reading.  Files are named prefix.N, or prefix.D/N with D = N / 1000.

Files are opened through pyarrow, so a path may be a URI of any file system it knows.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from nebulark.sources.staged import StagedWriter, save

# The header's layout (6 species), padded to 256 bytes.
HEADER = struct.Struct("<6I6d2d2i6I2i4d2i6I")
HEADER_BYTES = 256
#: Particles read at a time.
SLICE = 1 << 16
#: Particles of a file, if the number of files is left open.
FILE_ROWS = 1 << 22
_ARROW = pa.schema([("id", pa.int64()), *[(c, pa.float64()) for c in ("x", "y", "z", "vx", "vy", "vz", "pot")]])
SCHEMA = StructType([StructField("id", LongType()), *[StructField(c, DoubleType()) for c in ("x", "y", "z", "vx", "vy", "vz", "pot")]])


def header_of(raw: bytes) -> dict:
    """Counts, scale factor, box and cosmology; total = low word + 2^32 high word; particle mass in 1e10 units."""
    v = HEADER.unpack_from(raw)
    n, mass, (a, z), total, high = v[:6], v[6:12], v[12:14], v[16:22], v[30:36]
    nfiles, (box, om, ol, h) = v[23], v[24:28]
    return {"count": n[1], "total": total[1] + (high[1] << 32), "mass": mass[1] * 1e10, "a": a, "z": z, "files": nfiles, "box": box, "omega_m": om, "omega_l": ol, "h": h}


def pack_header(count: int, total: int, mass: float, a: float, files: int, box: float, om: float, ol: float, h: float) -> bytes:
    one = lambda x: (0, x, 0, 0, 0, 0)
    raw = HEADER.pack(*one(count), *(float(x) for x in one(mass / 1e10)), a, 1 / a - 1, 0, 0, *one(total & 0xFFFFFFFF), 0, files, box, om, ol, h, 0, 0, *one(total >> 32))
    return raw.ljust(HEADER_BYTES, b"\0")


def blocks(header: bytes, pos: np.ndarray, vel: np.ndarray, ids: np.ndarray, pot: np.ndarray) -> Iterator[bytes]:
    """The framed blocks of one file."""
    for block in (header, pos.astype("<f4").tobytes(), vel.astype("<f4").tobytes(), ids.astype("<u8").tobytes(), pot.astype("<f4").tobytes()):
        mark = struct.pack("<I", len(block))
        yield mark + block + mark


def write(particles: DataFrame, prefix: str, files: int | None = None, box: float = 1.0, a: float = 1.0, om: float = 0.3, ol: float = 0.7, h: float = 0.7) -> int:
    """Write (id, x, y, z, vx, vy, vz, pot) as ``files`` files by a hash of the id, all or none; returns the row count.

    A task holds a file's rows: left open, ``files`` follows the number of rows, about FILE_ROWS each.
    """
    register(particles.sparkSession)
    total = particles.count()
    files = files or max(1, -(-total // FILE_ROWS))
    save(particles.select(*SCHEMA.names), "snapshot", prefix, F.pmod(F.xxhash64("id"), F.lit(files)), files, total, box=box, a=a, om=om, ol=ol, h=h)
    return total


class _Writer(StagedWriter):
    def __init__(self, options: dict, overwrite: bool):
        self.facts = {k: float(options.get(k, d)) for k, d in (("box", 1.0), ("a", 1.0), ("om", 0.3), ("ol", 0.7), ("h", 0.7))}
        super().__init__(options, overwrite)

    def name(self, part: int) -> str:
        return file_name(self.path, part, self.parts)

    def replaced(self) -> list[str]:
        for first in (file_name(self.path, 0, 1), file_name(self.path, 0, 1001)):
            if self._exists(first):
                fs, name = pafs.FileSystem.from_uri(first)
                with fs.open_input_stream(name) as f:
                    files = header_of(f.read(4 + HEADER_BYTES)[4:])["files"]
                return [file_name(self.path, i, files) for i in range(files)]
        return []

    def body(self, part: int, batches: Iterator[pa.RecordBatch]) -> Iterator[bytes]:
        rows = pa.Table.from_batches(list(batches) or [pa.RecordBatch.from_pylist([], schema=_ARROW)])
        stack = lambda *c: np.stack([rows.column(x).to_numpy() for x in c], 1)
        f, n = self.facts, rows.num_rows
        pot = np.stack([rows.column("pot").to_numpy(), np.zeros(n)], 1)
        head = pack_header(n, self.total, 1.0, f["a"], self.parts, f["box"], f["om"], f["ol"], f["h"])
        yield from blocks(head, stack("x", "y", "z"), stack("vx", "vy", "vz") / f["a"] ** 0.5, rows.column("id").to_numpy(), pot)


def file_name(prefix: str, number: int, files: int) -> str:
    return f"{prefix}.{number // 1000}/{number}" if files > 1000 else f"{prefix}.{number}"


class _Split(InputPartition):
    def __init__(self, path: str):
        super().__init__(path)
        self.path = path


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.prefix, self.ranges = options["path"], []
        self.need_vel = options.get("velocities", "true").lower() == "true"
        self.need_pot = options.get("potentials", "true").lower() == "true"

    def pushFilters(self, filters: list[Filter]):
        for f in filters:
            if isinstance(f, (GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual, EqualTo)) and f.attribute[0] in ("x", "y", "z"):
                self.ranges.append(f)
            yield f  # Spark checks them again

    def partitions(self):
        fs, name = pafs.FileSystem.from_uri(file_name(self.prefix, 0, 1))
        if fs.get_file_info(name).type != pafs.FileType.File:  # many files: the first lies in a folder
            fs, name = pafs.FileSystem.from_uri(file_name(self.prefix, 0, 1001))
        with fs.open_input_stream(name) as f:
            files = max(1, header_of(f.read(4 + HEADER_BYTES)[4:])["files"])
        return [_Split(file_name(self.prefix, i, files)) for i in range(files)]

    def read(self, split: _Split) -> Iterator[pa.RecordBatch]:
        fs, name = pafs.FileSystem.from_uri(split.path)
        with fs.open_input_file(name) as f:
            at, starts = 0, []
            while len(starts) < 5:  # header, positions, velocities, ids, potentials
                starts.append(at + 4)
                at += struct.unpack("<I", f.read_at(4, at))[0] + 8
            head = header_of(f.read_at(HEADER_BYTES, starts[0]))
            tests = {GreaterThan: np.greater, GreaterThanOrEqual: np.greater_equal, LessThan: np.less, LessThanOrEqual: np.less_equal, EqualTo: np.equal}
            for first in range(0, head["count"], SLICE):
                n = min(SLICE, head["count"] - first)
                part = lambda k, kind, width: np.frombuffer(f.read_at(n * width * np.dtype(kind).itemsize, starts[k] + first * width * np.dtype(kind).itemsize), kind).reshape(n, width)  # noqa: B023, E731
                pos = part(1, "<f4", 3).astype(np.float64)
                pos = np.where(pos < 0, pos + head["box"], np.where(pos >= head["box"], pos - head["box"], pos))
                keep = np.ones(n, bool)
                for r in self.ranges:
                    keep &= tests[type(r)](pos[:, "xyz".index(r.attribute[0])], r.value)
                none = pa.nulls(int(keep.sum()), pa.float64())
                cols = [pa.array(part(3, "<u8", 1)[keep, 0].astype(np.int64)), *[pa.array(pos[keep, i]) for i in range(3)]]
                vel = part(2, "<f4", 3).astype(np.float64) * head["a"] ** 0.5 if self.need_vel else None
                cols += [none if vel is None else pa.array(vel[keep, i]) for i in range(3)]
                cols.append(pa.array(part(4, "<f4", 2).astype(np.float64).sum(1)[keep]) if self.need_pot else none)
                yield pa.RecordBatch.from_arrays(cols, names=SCHEMA.names)


class _StreamReader(_Reader, DataSourceStreamReader):
    """Files in the order of their numbers, as they arrive: the offset is the number of the next file.

    A file counts once all before it are there, so the offset stays one number and none is read twice
    or passed over, whenever the query stops and starts again.
    """

    def initialOffset(self) -> dict:
        return {"next": 0}

    def latestOffset(self) -> dict:
        fs, name = pafs.FileSystem.from_uri(self.prefix)
        folder, _, stem = name.rpartition("/")
        there = set()
        for info in fs.get_file_info(pafs.FileSelector(folder, allow_not_found=True)):
            before, _, number = info.base_name.rpartition(".")
            if before == stem and number.isdigit() and info.type == pafs.FileType.File:
                there.add(int(number))
        return {"next": next(k for k in range(len(there) + 1) if k not in there)}

    def partitions(self, start: dict, end: dict):
        return [_Split(file_name(self.prefix, i, 1)) for i in range(start["next"], end["next"])]

    def commit(self, end: dict) -> None:
        """Nothing is held for offsets that are done."""


class SnapshotSource(DataSource):
    """``spark.read.format("snapshot").load(prefix)``; options velocities and potentials (false skips the block).

    ``readStream`` takes the files prefix.0, prefix.1, ... as they arrive.  :func:`write` writes.
    """

    @classmethod
    def name(cls) -> str:
        return "snapshot"

    def schema(self) -> StructType:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options)

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return _StreamReader(self.options)

    def writer(self, schema: StructType, overwrite: bool) -> StagedWriter:
        return _Writer(self.options, overwrite)


def register(spark) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(SnapshotSource)
