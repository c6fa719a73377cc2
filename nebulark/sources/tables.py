"""Columnar and text sources and sinks: catalogues, particle tables, point lists, meshes, spectra."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

HALOS = T.StructType([T.StructField("id", T.LongType()), *[T.StructField(c, T.DoubleType()) for c in ("x", "y", "z", "vx", "vy", "vz", "pot", "mvir")], T.StructField("child_level", T.IntegerType())])
PARTICLES = T.StructType([T.StructField("id", T.LongType()), *[T.StructField(c, T.DoubleType()) for c in ("mass", "x", "y", "z", "vx", "vy", "vz")]])


def read_halos(spark: SparkSession, *paths: str, fields: tuple[str, ...] | None = None) -> DataFrame:
    """A catalogue of one or many Parquet parts; only the named fields are read.

    ValueError if one is missing, or if its type is not a number where one is wanted (a widening is no error).
    """
    df = spark.read.parquet(*paths)
    wanted = fields or tuple(HALOS.names)
    if missing := [c for c in wanted if c not in df.columns]:
        raise ValueError(f"the catalogue lacks {', '.join(missing)}")
    kinds = {f.name: f.dataType for f in HALOS.fields}
    found = {f.name: f.dataType for f in df.schema.fields}
    for c in wanted:
        if c in kinds and (not isinstance(found[c], T.NumericType) or isinstance(kinds[c], T.IntegralType) and not isinstance(found[c], T.IntegralType)):
            raise ValueError(f"{c} is {found[c].simpleString()}, not {kinds[c].simpleString()}")
    return df.select(*[F.col(c).cast(kinds[c]).alias(c) if c in kinds else F.col(c) for c in wanted])


def read_header(spark: SparkSession, path: str) -> dict:
    """The single row of a catalogue's JSON header: counts, box, cosmology."""
    return spark.read.json(path).first().asDict()


def read_species(spark: SparkSession, path: str, species: str, a: float, size: float) -> DataFrame:
    """Particles of one species of a table partitioned by it; positions in box units, velocities times 1/sqrt(a)."""
    df = spark.read.parquet(path).where(F.col("species") == species)
    return df.withColumns({c: F.col(c) / F.lit(size) for c in "xyz"} | {c: F.col(c) / F.lit(a**0.5) for c in ("vx", "vy", "vz")})


def read_domains(spark: SparkSession, path: str) -> DataFrame:
    """Particles of a domain decomposition, folders ix=/iy=/iz=; a domain filter prunes folders."""
    return spark.read.schema(T.StructType([*PARTICLES.fields, *[T.StructField(c, T.IntegerType()) for c in ("ix", "iy", "iz")]])).parquet(path)


def read_points(spark: SparkSession, path: str, size: float = 20.0) -> DataFrame:
    """Text lines ``x y z`` over the box size; lines that are not three numbers are left out."""
    parts = F.split(F.trim("value"), r"\s+")
    cols = [F.expr(f"try_cast(get(p, {i}) as double)").alias(c) for i, c in enumerate("xyz")]
    rows = spark.read.text(path).select(parts.alias("p")).select(F.size("p").alias("n"), *cols)
    return rows.where("n = 3 and x is not null and y is not null and z is not null").select(*[(F.col(c) / F.lit(size)).alias(c) for c in "xyz"])


def read_text_masses(spark: SparkSession, path: str, column: int = 2) -> DataFrame:
    """The mass column of a text catalogue whose header lines start with #."""
    parts = F.split(F.trim("value"), r"\s+")
    return spark.read.text(path).where(~F.col("value").startswith("#")).select(F.expr("1").alias("one"), F.try_element_at(parts, F.lit(column + 1)).alias("m")).select(F.expr("try_cast(m as double)").alias("mass")).where("mass is not null")


def read_text_header(spark: SparkSession, path: str) -> DataFrame:
    """(key, value) of ``# key = value`` (or ``key: value``) header lines."""
    line = spark.read.text(path).where(F.col("value").startswith("#"))
    pattern = r"^#\s*([A-Za-z_]\w*)\s*[=:]\s*([-+0-9.eE]+)"
    return line.select(F.regexp_extract("value", pattern, 1).alias("key"), F.expr("try_cast(nullif(regexp_extract(value, '^#\\\\s*([A-Za-z_]\\\\w*)\\\\s*[=:]\\\\s*([-+0-9.eE]+)', 2), '') as double)").alias("number")).where("key <> ''")


def with_positions(spark: SparkSession, path: str, name: str = "position") -> DataFrame:
    """A Parquet table with the place of each row, 0-based, over its files in order of their names."""
    df = spark.read.parquet(path).select("*", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__row"))
    sizes = df.groupBy("__file").agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("__file").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("__file", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__off"))  # a row a file
    return df.join(F.broadcast(offsets), "__file").withColumn(name, F.col("__off") + F.col("__row")).drop("__file", "__row", "__off")


def zip_columns(spark: SparkSession, *paths: str) -> DataFrame:
    """Tables that hold columns of the same rows in the same order, side by side, with the rows' position.

    A row's place comes from its file and its place there, so nothing is sorted to find it; tables may be cut
    into files differently.  ValueError if their lengths or column names clash.
    """
    tables = [with_positions(spark, p) for p in paths]
    names = [c for t in tables for c in t.columns if c != "position"]
    if len(set(names)) < len(names):
        raise ValueError("the tables share column names")
    lengths = [spark.read.parquet(p).count() for p in paths]  # from the files' footers
    if len(set(lengths)) > 1:
        raise ValueError(f"the tables have {', '.join(map(str, lengths))} rows")
    out = tables[0]
    for t in tables[1:]:
        # Files that pack well look small enough to broadcast, however many rows they hold.
        out = out.join(t.hint("merge"), "position")
    return out


def write_mesh(mesh: DataFrame, path: str, n: int, size: float) -> None:
    """A cell table with the mesh size and the box in each file's rows, partitioned by slabs of ix."""
    mesh.withColumns({"n": F.lit(n), "size": F.lit(size)}).repartition("ix").write.mode("overwrite").parquet(path)


def read_mesh(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


#: Names of the cell axes.
CELL = ("ix", "iy", "iz")


def write_field(field: DataFrame, path: str, n: int, size: float, *values: str) -> None:
    """A moment field on storage: cells with their values as 32-bit floats, the mesh size and the box; one component or many."""
    rows = field.select(*CELL, *[F.col(v).cast("float").alias(v) for v in values])
    rows.withColumns({"n": F.lit(n), "size": F.lit(size)}).repartition("ix").write.mode("overwrite").parquet(path)


def read_field(spark: SparkSession, path: str, *values: str) -> DataFrame:
    """Cells and the named components (all, if none is named) of a field; only their columns are read."""
    df = spark.read.parquet(path)
    names = values or tuple(c for c in df.columns if c not in (*CELL, "n", "size"))
    return df.select(*CELL, *names)


def write_modes(modes: DataFrame, path: str, n: int, size: float) -> None:
    """The stored half (iz up to n/2) of a Fourier mesh: ix, iy, iz, re, im, with n, the count of floats and the box."""
    half = modes.where(F.col("iz") <= n // 2).select(*CELL, "re", "im")
    half.withColumns({"n": F.lit(n), "floats": F.lit(2 * n * n * (n // 2 + 1)).cast("long"), "size": F.lit(size)}).repartition("ix").write.mode("overwrite").parquet(path)


#: Columns behind r and xi of the four layouts of xi(r).
XI_LAYOUTS = {"auto": ("dd", "rr"), "LS": ("dd", "dr", "rr"), "cross LS": ("dd", "d1r2", "d2r1", "rr"), "transform": ("weight",)}


def write_xi(table: DataFrame, path: str, lead: tuple[str, ...] = ("r",), value: str = "xi", layout: str | None = "auto") -> None:
    """xi, or a 2-D or projected one, as text: a # line of names, then a line a bin in scientific notation, in order.

    ``lead`` are the bin's coordinates, ``layout`` names what follows the value (None: nothing).  A row a bin: one file.
    """
    names = [*lead, value, *(XI_LAYOUTS[layout] if layout else ())]
    line = F.concat_ws(" ", *[F.format_string("%.10e", F.col(c).cast("double")) for c in names])
    order = [f"o{i}" for i in range(len(lead))]
    rows = table.select(*[F.col(c).cast("double").alias(o) for c, o in zip(lead, order, strict=True)], line.alias("value"))
    head = table.sparkSession.range(1).select(*[F.lit(None).cast("double").alias(o) for o in order], F.lit("# " + " ".join(names)).alias("value"))
    whole = head.unionByName(rows).coalesce(1).sortWithinPartitions(*[F.col(o).asc_nulls_first() for o in order])
    whole.select("value").write.mode("overwrite").text(path)


def read_columns(spark: SparkSession, path: str, *names: str) -> DataFrame:
    """Numbers of a text table whose # lines are comments, under the given names."""
    parts = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).where(~F.col("value").startswith("#")).select(parts.alias("p"))
    return rows.select(*[F.col("p")[i].cast("double").alias(c) for i, c in enumerate(names)])


def write_columns(table: DataFrame, path: str, *order: str) -> None:
    """Space-separated text sorted by ``order``: spectra and correlation functions."""
    table.orderBy(*order).write.mode("overwrite").option("sep", " ").csv(path)


def labelled(path: str, label: str) -> str:
    """file.dat -> file_label.dat."""
    stem, dot, end = path.rpartition(".")
    return f"{stem}_{label}.{end}" if dot and "/" not in end else f"{path}_{label}"
