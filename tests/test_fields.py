import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from nebulark.config import RadialBins
from nebulark.functions import bits, metrics
from nebulark.functions import cosmology as C
from nebulark.functions import geometry as G
from nebulark.functions import kernels as K
from nebulark.functions import spectral as S
from nebulark.operators import fft, massfunction, mesh, moments, pairwise, spectrum

N = 8


@pytest.fixture(scope="module")
def particles(spark):
    r = random.Random(7)
    rows = [(i, r.random(), r.random(), r.random(), r.gauss(0, 1), r.gauss(0, 1), r.gauss(0, 1), r.uniform(0.5, 1.5)) for i in range(300)]
    rows += [(300, 0.0, 1.0, 0.5, 0.0, 0.0, 0.0, 1.0), (301, 1.0, 0.125, 0.25, 0.0, 0.0, 0.0, 0.0)]
    return spark.createDataFrame(rows, "id long, x double, y double, z double, vx double, vy double, vz double, mass double").cache()


@pytest.mark.parametrize("scheme", ["ngp", "cic", "tsc", "pcs"])
@pytest.mark.parametrize("centering", ["node", "cell"])
def test_mass_is_conserved(particles, scheme, centering):
    got = mesh.assign(particles, N, scheme, "mass", centering)
    total = particles.agg(F.sum("mass")).first()[0]
    assert got.agg(F.sum("val")).first()[0] == pytest.approx(total)
    assert got.agg(F.min("ix"), F.max("ix"), F.min("val")).first()[:2] >= (0, 0) and got.where("ix >= 8 or val < -1e-12").count() == 0
    open_ = mesh.assign(particles, N, scheme, "mass", centering, periodic=False).agg(F.sum("val")).first()[0]
    assert open_ <= total + 1e-9


def dense_array(df, col="val"):
    out = np.zeros((N, N, N))
    for r in df.collect():
        out[r.ix, r.iy, r.iz] = r[col]
    return out


@pytest.mark.parametrize("layout", list(fft.LAYOUTS))
def test_transform_equals_numpy(particles, layout):
    field = mesh.contrast(mesh.assign(particles, N, "tsc"), N)
    want = np.fft.fftn(dense_array(field))
    modes = fft.forward(field, N, layout).collect()
    assert len(modes) == N**3
    for m in modes:
        assert abs(want[m.ix, m.iy, m.iz] - complex(m.re, m.im)) < 1e-8
    power = sum(m.re**2 + m.im**2 for m in modes)
    assert power / N**3 == pytest.approx((dense_array(field) ** 2).sum())


def test_spectrum_of_a_gaussian(spark):
    n, s = 16, 0.05
    modes = fft.forward(mesh.contrast(mesh.analytic_field(spark, n, "gauss", s), n), n)
    for r in spectrum.mode_power(modes, n, "none").where("k > 0 and k < 3").collect():
        assert r.p / n**6 == pytest.approx(math.exp(-((2 * math.pi * r.k * s) ** 2)), rel=1e-3)


def test_correlation_by_transform_equals_numpy(particles):
    field = mesh.assign(particles, N, "cic")
    d = dense_array(mesh.contrast(field, N))
    p = np.abs(np.fft.fftn(d)) ** 2
    k = np.minimum(np.arange(N), N - np.arange(N))
    w = np.sinc(k / N) ** 4
    p /= w[:, None, None] * w[None, :, None] * w[None, None, :]
    p[0, 0, 0] = 0
    xi = np.fft.ifftn(p).real / N**3
    lag = np.sqrt(k[:, None, None] ** 2 + k[None, :, None] ** 2 + k[None, None, :] ** 2) / N
    bins = RadialBins(0.0, 0.5, 4)
    for r in spectrum.correlation(field, N, "cic", bins).collect():
        inside = (lag >= bins.edge(r.ir)) & (lag < bins.edge(r.ir + 1))
        assert r.cells == inside.sum() and r.xi == pytest.approx(xi[inside].mean())


def test_legendre_and_window():
    x = np.linspace(-1, 1, 9)
    for ell in range(12):
        got = np.polynomial.polynomial.polyval(x, S.legendre_coefficients(ell))
        assert np.allclose(got, np.polynomial.legendre.legval(x, [0] * ell + [1]))


def test_moments_are_positive(particles):
    got = moments.dispersion(particles, 4, "cic").collect()
    for r in got:
        t = np.array([[r.sxx, r.sxy, r.sxz], [r.sxy, r.syy, r.syz], [r.sxz, r.syz, r.szz]])
        assert np.linalg.eigvalsh(t).min() > -1e-9
    with pytest.raises(ValueError):
        moments.density(particles, 4, "cic", 0.5)


def test_kernels_and_splits(spark):
    r = spark.range(0, 201).select((F.col("id") / 100.0).alias("r"))
    got = r.select("r", K.wendland(F.col("r"), 1.0).alias("w"), K.wendland_slope(F.col("r"), 1.0).alias("dw"), K.force_split(F.col("r"), 2.0).alias("g"), K.potential_split(F.col("r"), 2.0).alias("p"), K.gradient_factor(F.col("r"), 1.0).alias("f")).toPandas()
    assert (got.w >= 0).all() and got.w.iloc[200] == 0 and got.f.iloc[0] == 0
    assert np.trapezoid(4 * np.pi * got.r**2 * got.w, got.r) == pytest.approx(1, abs=1e-3)
    assert np.allclose(np.gradient(got.w, got.r)[2:-2], got.dw[2:-2], atol=5e-3)
    assert got.g.iloc[0] == 1 and abs(got.g.iloc[200]) < 1e-12
    slope = np.gradient(got.p, got.r)
    assert np.allclose((got.p - got.r * slope)[3:190], got.g[3:190], atol=2e-3)


def test_pair_sums_equal_brute_force(spark, particles):
    pts = [(r.id, np.array([r.x, r.y, r.z]), r.mass) for r in particles.where("id < 60").collect()]
    df = particles.where("id < 60")
    got = {r.id: (r.ax, r.ay, r.az) for r in pairwise.gravity(df, df, 0.3, 1e-4).collect()}
    g = {}
    for r in spark.range(0, 30001).select((F.col("id") / 100000.0).alias("r")).select("r", K.force_split(F.col("r"), 0.3).alias("g")).collect():
        g[round(r.r, 5)] = r.g
    for i, p, _ in pts[:10]:
        want = np.zeros(3)
        for _, q, m in pts:
            d = q - p
            d -= np.floor(d + 0.5)
            r2 = d @ d
            if r2 < 0.09:
                want += m * g[round(math.sqrt(r2), 5)] * d / (r2 + 1e-4) ** 1.5
        assert np.allclose(got[i], want, rtol=1e-2, atol=1e-1)


def test_cosmology(spark):
    a = np.array([1e-4, 0.1, 0.5, 1.0, 3.0])
    steps = np.linspace(0, np.sqrt(a), 200_001)  # the midpoint rule in s = sqrt(a)
    mid = (steps[1:] + steps[:-1]) / 2
    want = (2 * mid**2 / np.sqrt(0.3 + 0.7 * mid**6) * np.diff(steps, axis=0)).sum(0)
    assert np.allclose(C.ages(a, 0.3, 0.7), want, rtol=1e-9) and np.allclose(C.scale_factors(C.ages(a, 0.3, 0.7), 0.3, 0.7), a, rtol=1e-12)
    one = spark.range(1).select(C.hubble_a(F.lit(1.0), 0.3, 0.7).alias("h"), C.redshift(C.scale_factor(F.lit(3.0))).alias("z")).first()
    assert one.h == pytest.approx(100) and one.z == pytest.approx(3)
    assert C.particle_mass(100.0, 10, 0.3) == pytest.approx(0.3 * C.RHO_CRIT * 1000)


def test_metrics_and_bits(spark):
    df = spark.createDataFrame([([1.0, 2.0], [3.0, 5.0], [1, 200], [4, 0], 6.0, 0.5)], "a array<float>, b array<float>, p array<short>, q array<short>, s double, t double")
    r = df.select(metrics.l2(F.col("a"), F.col("b")).alias("l2"), metrics.l1(F.col("a"), F.col("b")).alias("l1"), metrics.ip_distance(F.col("a"), F.col("b")).alias("ip"), metrics.l2_bytes(F.col("p"), F.col("q")).alias("by"), metrics.so2(F.col("s"), F.col("t")).alias("so")).first()
    assert (r.l2, r.l1, r.ip, r.by) == (13.0, 5.0, -12.0, 40009) and r.so == pytest.approx(2 * math.pi - 5.5)
    values = [-math.inf, -2.5, -1e-300, 0.0, 1e-300, 3.0, math.inf]
    rows = spark.createDataFrame([(v,) for v in values], "v double").select("v", bits.ordered_long("v").alias("k"))
    assert [x.v for x in rows.orderBy("k").collect()] == values
    assert rows.where(bits.from_ordered_long("k") != F.col("v")).count() == 0
    bits.register(spark)
    assert spark.sql("SELECT add(2, 3) AS s").first().s == 5
    assert spark.range(1).select(G.wrap_once(F.lit(-0.25)).alias("w")).first().w == 0.75


def test_mass_function_keeps_the_last_edge(spark):
    df = spark.createDataFrame([(m,) for m in (1.0, 10.0, 99.0, 100.0, 101.0)], "mvir double")
    assert [r.n for r in massfunction.mass_histogram(df, 1.0, 100.0, 2).orderBy("im").collect()] == [1, 3]


@pytest.mark.parametrize("n", [4, 5, 8])
def test_half_transforms(spark, n):
    """Half the modes are those of the whole transform and give the mesh back, batch by batch."""
    values = np.random.default_rng(n).normal(size=(2, n, n, n))
    rows = [(b, i, j, k, float(values[b, i, j, k])) for b in range(2) for i in range(n) for j in range(n) for k in range(n)]
    field = spark.createDataFrame(rows, "b int, ix int, iy int, iz int, val double")
    half = fft.forward_half(field, n, "b")
    want = np.fft.rfftn(values, axes=(1, 2, 3))
    got = half.collect()
    assert len(got) == want.size and all(abs(want[x.b, x.ix, x.iy, x.iz] - complex(x.re, x.im)) < 1e-9 for x in got)
    back = fft.inverse_half(half, n, "b").collect()
    assert len(back) == values.size and all(abs(values[x.b, x.ix, x.iy, x.iz] - x.val / n**3) < 1e-9 for x in back)
