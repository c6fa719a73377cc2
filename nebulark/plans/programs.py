"""The analysis programs: a catalogue and an AnalysisConfig in, a table out."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nebulark.config import AnalysisConfig, RadialBins, SmuBins, SpspBins
from nebulark.operators import catalog, jackknife, mesh, moments, pairs, spectrum
from nebulark.sources import domains, fields, tables

#: The columns that each moment field is written with.
MOMENT_VALUES = {"dens": ("rho",), "velc": ("ux", "uy", "uz"), "sigma": tuple(f"s{t}" for t in moments.TENSOR)}


def prepared(halos: DataFrame, config: AnalysisConfig, redshift_space: bool = False, gravitational: bool = False) -> DataFrame:
    """Mass and level cuts, then the shifts asked for; only the columns that are needed are read."""
    out = catalog.select_mass_level(halos, config.mrange, config.clevel)
    if redshift_space:
        out = catalog.shift_redshift_space(out, config.box, config.axis)
    if gravitational:
        out = catalog.shift_gravitational(out, config.box, config.axis)
    return out.select("id", "x", "y", "z")


def _randoms(cat: DataFrame, config: AnalysisConfig, seed: int) -> DataFrame:
    return catalog.random_catalog(cat.sparkSession, int(cat.count() * config.random_factor), seed)


def halo_xi(halos: DataFrame, config: AnalysisConfig, halos2: DataFrame | None = None) -> DataFrame:
    """(ir, r, xi) of one prepared catalogue or two, r in the box's unit."""
    bins = config.radial_bins()
    if halos2 is None:
        random = None if config.estimator == "ideal" else _randoms(halos, config, 10)
        out = pairs.xi_auto(halos, bins, config.estimator, random)
    else:
        random = (None, None) if config.estimator == "ideal" else (_randoms(halos, config, 1), _randoms(halos2, config, 2))
        out = pairs.xi_cross(halos, halos2, bins, config.estimator, *random)
    mid = pairs.spine(halos.sparkSession, bins).select("ir", (F.col("r_mid") * F.lit(config.box.size)).alias("r"))
    return out.join(F.broadcast(mid), "ir").select("ir", "r", "xi")  # a row a bin


def bins_2d(config: AnalysisConfig, mode: str, n2: int) -> SmuBins | SpspBins:
    """The 2-D bins of a program, linear in r."""
    r = config.radial_bins()
    r = RadialBins(r.low, r.high, r.n)
    return SmuBins(r, n2, config.half_angle) if mode == "smu" else SpspBins(r, r.high, n2, config.half_angle)


def halo_xi_2d(halos: DataFrame, config: AnalysisConfig, mode: str = "smu", n2: int = 10, halos2: DataFrame | None = None) -> DataFrame:
    """2-D xi: (ir, imu, n, rr, xi) or (iperp, ipar, n, rr, xi), with the configured estimator."""
    random = random2 = None
    if config.estimator != "ideal":
        random = _randoms(halos, config, 10 if halos2 is None else 1)
        random2 = None if halos2 is None else _randoms(halos2, config, 2)
    return pairs.xi_2d(halos, bins_2d(config, mode, n2), config.estimator, random, halos2, random2, config.axis)


def projected(xi: DataFrame, config: AnalysisConfig, mode: str = "smu", n2: int = 10) -> DataFrame:
    """The 1-D companion of a 2-D result: xi(s) by ir, or w_p by iperp."""
    return pairs.project_smu(xi) if mode == "smu" else pairs.project_spsp(xi, bins_2d(config, mode, n2))


def matter(spark: SparkSession, prefix: str, config: AnalysisConfig, redshift_space: bool = False, gravitational: bool = False) -> DataFrame:
    """Particles of a snapshot in box units (id, x, y, z), shifted while they are read; blocks that no shift needs are skipped."""
    out = spark.read.format("snapshot").option("velocities", str(redshift_space).lower()).option("potentials", str(gravitational).lower()).load(prefix)
    if redshift_space:
        out = catalog.shift_while_loading(out, config.box, config.axis)
    if gravitational:
        out = catalog.shift_while_loading(out, config.box, config.axis, "pot")
    return out.select("id", *[(F.col(c) / F.lit(config.box.size)).alias(c) for c in ("x", "y", "z")])


def halo_xi_jackknife(halos: DataFrame, config: AnalysisConfig) -> DataFrame:
    """(ir, mean, se) over leave-one-out blocks: cubes, or slices of a shuffled order."""
    bins, random = config.radial_bins(), _randoms(halos, config, 10)
    blocks = config.jk_level**3
    cut = (lambda c: jackknife.spatial_blocks(c, config.jk_level)) if config.jk_type == "spatial" else (lambda c: jackknife.shuffle_blocks(c, blocks))
    d, r = cut(halos), cut(random)
    counts = [jackknife.leave_one_out(*ab, bins, blocks) for ab in ((d, None), (r, None), *([(d, r)] if config.estimator == "LS" else []))]
    dr = counts[2] if len(counts) > 2 else None
    xi = jackknife.xi_blocks(counts[0], counts[1], dr, jackknife.block_sizes(d), jackknife.block_sizes(r), halos.count(), random.count())
    return jackknife.mean_and_error(xi, ["ir"])


def power(particles: DataFrame, config: AnalysisConfig, value: str | None = None, particles2: DataFrame | None = None, ells: tuple[int, ...] = (0,)) -> DataFrame:
    """(ik, k, modes, p0, ...) in the box's units, from particles or halos scattered with the configured scheme."""
    n, unit = config.mesh, config.box.size / (2 * math.pi)
    low, high = (k * unit for k in config.krange)
    bins = RadialBins(max(low, 1e-10), min(high, float(n)), config.nk, config.log_bins)
    fields = [None if p is None else mesh.assign(p, n, config.scheme, value) for p in (particles, particles2)]
    noise = particles.count() if config.shot_noise and particles2 is None else None
    out = spectrum.power_spectrum(fields[0], n, config.scheme, bins, noise, fields[1], ells)
    return spectrum.in_length_units(out, n, bins, config.box.size)


def xi_by_transform(particles: DataFrame, config: AnalysisConfig, particles2: DataFrame | None = None) -> DataFrame:
    """(ir, cells, xi) from the inverse transform of the power."""
    n = config.mesh
    fields = [None if p is None else mesh.assign(p, n, config.scheme) for p in (particles, particles2)]
    noise = particles.count() if config.shot_noise and particles2 is None else None
    return spectrum.correlation(fields[0], n, config.scheme, config.radial_bins(), noise, fields[1])


def moment(particles: DataFrame, config: AnalysisConfig, kind: str, background: float | None = None) -> DataFrame:
    """dens, velc or sigma on the configured mesh."""
    if kind == "dens":
        return moments.density(particles, config.mesh, config.scheme, background)
    return {"velc": moments.mean_velocity, "sigma": moments.dispersion}[kind](particles, config.mesh, config.scheme)


def species_moment(spark: SparkSession, path: str, header: dict, species: str, config: AnalysisConfig, kind: str, out: str, files: int = 1) -> None:
    """A moment field of one species of a particle table to binary files, from the table's header.

    The header has the box, the scale factor, omega_nu and the critical density today in the table's units; the
    mean neutrino mass of the box, their product with its volume, is the background of a density contrast.
    """
    rows = tables.read_species(spark, path, species, header["a"], header["box"])
    background = header["omega_nu"] * header["rho_crit"] * header["box"] ** 3
    field = moment(rows, config, kind, background if kind == "dens" else None)
    fields.write(field, out, config.mesh, header["box"], *MOMENT_VALUES[kind], layout="moment", files=files)


def domain_moment(spark: SparkSession, prefix: str, suffix: str, config: AnalysisConfig, kind: str, out: str, files: int = 1) -> None:
    """A moment field of domain-decomposed particles (positions in box units, masses as they are) to binary files."""
    domains.register(spark)
    rows = spark.read.format("domains").option("suffix", suffix).load(prefix)
    fields.write(moment(rows, config, kind), out, config.mesh, 1.0, *MOMENT_VALUES[kind], layout="moment", files=files)
