"""Particles of a domain decomposition in binary files, as a Python data source.

A file holds one domain: prefix/xIII/yJJJ/zKKK (three digits each, and a suffix if there is one), a header and
then packed records (u64 id, f32 mass, position and velocity).  One file is one input partition, read
in slices; a condition on ix, iy or iz leaves files out before anything of them is read.  A file whose header
names another domain than its path is an error.  Velocities come out in km/s, by the first file's units.
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
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, InputPartition
from pyspark.sql.types import IntegerType, StructField, StructType

from nebulark.functions import cosmology as C
from nebulark.sources.staged import StagedWriter, save
from nebulark.sources.tables import PARTICLES

# The header's layout. Flags, domains by axis, processes, the file's own domain; global and local
# bounds; units of length, mass, time; time, step width, step; cosmology and neutrinos; counts here and in all.
HEADER = struct.Struct("<2i3i2i3i6f6f3d2fi7f4i7f2Q")
RECORD = np.dtype([("id", "<u8"), *[(c, "<f4") for c in ("mass", "x", "y", "z", "vx", "vy", "vz")]])
SCHEMA = StructType([*PARTICLES.fields, *[StructField(c, IntegerType()) for c in ("ix", "iy", "iz")]])
#: Particles read at a time.
SLICE = 1 << 16


def file_name(prefix: str, domain: tuple[int, int, int], suffix: str = "") -> str:
    return prefix + "".join(f"/{c}{i:03d}" for c, i in zip("xyz", domain, strict=True)) + suffix


def header_of(raw: bytes) -> dict:
    v = HEADER.unpack_from(raw)
    return {"cosmology": v[0], "domains": v[2:5], "domain": v[7:10], "length": v[22], "time": v[24], "now": v[25], "omega_m": v[28], "omega_l": v[29], "count": v[46], "total": v[47]}


def pack_header(domains: tuple[int, int, int], domain: tuple[int, int, int], count: int, total: int, cosmology: int = 0, length: float = 1.0, time: float = 1.0, now: float = 0.0, om: float = 0.3, ol: float = 0.7) -> bytes:
    bounds = (0.0, 1.0) * 3 + tuple(x for n, i in zip(domains, domain, strict=True) for x in (i / n, (i + 1) / n))
    return HEADER.pack(cosmology, 0, *domains, math.prod(domains), 0, *domain, *bounds, length, 1.0, time, now, 0.0, 0, om, ol, 0.0, 0.0, 0.0, 0.7, 0.0, *(0,) * 4, *(0.0,) * 7, count, total)


def velocity_unit(head: dict) -> float:
    """km/s of one unit of velocity: L / T, in cm/s times the scale factor where the header says cosmological."""
    if not head["cosmology"]:
        return head["length"] / head["time"]
    a = float(C.scale_factors(np.array([head["now"]]), head["omega_m"], head["omega_l"])[0])
    return 1e-5 * head["length"] / head["time"] * a


def write(particles: DataFrame, prefix: str, domains: tuple[int, int, int], suffix: str = "") -> int:
    """Write (id, mass, x, y, z, vx, vy, vz, ix, iy, iz) as a file a domain, all or none; returns the row count.

    A task holds a domain's rows; domains without rows get a file with a header alone.
    """
    register(particles.sparkSession)
    total = particles.count()
    _, ny, nz = domains
    part = F.col("iz") + F.lit(nz) * (F.col("iy") + F.lit(ny) * F.col("ix"))
    save(particles.select(*SCHEMA.names), "domains", prefix, part, math.prod(domains), total, domains=",".join(map(str, domains)), suffix=suffix)
    return total


class _Writer(StagedWriter):
    def __init__(self, options: dict, overwrite: bool):
        self.domains, self.suffix = tuple(map(int, options["domains"].split(","))), options.get("suffix", "")
        super().__init__(options, overwrite)

    def _domain(self, part: int) -> tuple[int, int, int]:
        return tuple(int(i) for i in np.unravel_index(part, self.domains))

    def name(self, part: int) -> str:
        return file_name(self.path, self._domain(part), self.suffix)

    def body(self, part: int, batches: Iterator[pa.RecordBatch]) -> Iterator[bytes]:
        rows = list(batches)
        out = np.zeros(sum(b.num_rows for b in rows), RECORD)
        for c in RECORD.names:
            out[c] = np.concatenate([b.column(c).to_numpy() for b in rows] or [[]])
        yield pack_header(self.domains, self._domain(part), len(out), self.total)
        yield out.tobytes()


class _Split(InputPartition):
    def __init__(self, domain: tuple[int, int, int], unit: float):
        super().__init__(domain)
        self.domain, self.unit = domain, unit


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.prefix, self.suffix, self.only = options["path"], options.get("suffix", ""), {}

    def pushFilters(self, filters: list[Filter]):
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute[0] in ("ix", "iy", "iz"):
                self.only[f.attribute[0]] = f.value
            yield f  # Spark checks them again

    def partitions(self):
        fs, name = pafs.FileSystem.from_uri(file_name(self.prefix, (0, 0, 0), self.suffix))
        with fs.open_input_stream(name) as f:
            head = header_of(f.read(HEADER.size))
        unit = velocity_unit(head)
        wanted = [self.only.get(c) for c in ("ix", "iy", "iz")]
        return [_Split(d, unit) for d in np.ndindex(*head["domains"]) if all(w is None or w == i for w, i in zip(wanted, d, strict=True))]

    def read(self, split: _Split) -> Iterator[pa.RecordBatch]:
        path = file_name(self.prefix, split.domain, self.suffix)
        fs, name = pafs.FileSystem.from_uri(path)
        with fs.open_input_stream(name) as f:
            head = header_of(f.read(HEADER.size))
            if head["domain"] != split.domain:
                raise ValueError(f"{path} holds domain {head['domain']}")
            left = head["count"]
            while left:
                n = min(left, SLICE)
                rows = np.frombuffer(f.read(n * RECORD.itemsize), RECORD)
                left -= n
                cols = [pa.array(rows["id"].astype(np.int64)), *[pa.array(rows[c].astype(np.float64)) for c in ("mass", "x", "y", "z")]]
                cols += [pa.array(rows[c].astype(np.float64) * split.unit) for c in ("vx", "vy", "vz")]
                cols += [pa.array(np.full(n, i, np.int32)) for i in split.domain]
                yield pa.RecordBatch.from_arrays(cols, names=SCHEMA.names)


class DomainSource(DataSource):
    """``spark.read.format("domains").option("suffix", "").load(prefix)``."""

    @classmethod
    def name(cls) -> str:
        return "domains"

    def schema(self) -> StructType:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options)

    def writer(self, schema: StructType, overwrite: bool) -> StagedWriter:
        return _Writer(self.options, overwrite)


def register(spark) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(DomainSource)
