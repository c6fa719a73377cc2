"""The registered queries and, where SQL can say it, the same in SQL.

A query is a function of (spark, sf_dir); its SQL runs on the same tables in another engine.
Positions are in units of a box of 1000; sums and means are rounded on both sides.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nebulark.config import AnalysisConfig, Box, RadialBins, SmuBins, SpspBins
from nebulark.functions import bits
from nebulark.functions import cosmology as C
from nebulark.functions import geometry as G
from nebulark.functions import kernels as K
from nebulark.functions import spectral as S
from nebulark.operators import catalog, fft, indexsearch, jackknife, massfunction, mesh, moments, neighbors, ordering, pairs, pairwise, spectrum
from nebulark.plans import programs
from nebulark.plans.fixtures import VIEWS, view, view_sql
from nebulark.plans.work import work_path
from nebulark.sources import snapshot, tables

from nebulark.streaming import mesh as streams

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

BOX = Box()
R_BINS = RadialBins(0.0, 0.05, 10)
LOG_BINS = RadialBins(0.002, 0.05, 8, log=True)
SMU = SmuBins(RadialBins(0.0, 0.05, 5), 4)
SPSP = SpspBins(RadialBins(0.0, 0.03, 3), 0.03, 3)
K_BINS = RadialBins(0.5, 4.5, 4)
LAG_BINS = RadialBins(0.0, 0.5, 5)
N = 8  # mesh of the Fourier queries: their SQL is a sum over cells x modes
JK_LEVEL, JK_SLICES = 2, 5

def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def put(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLE[name] = sql
        return f

    return put

def r(c: Column | str, digits: int = 6) -> Column:
    """Rounded, with one zero."""
    return F.round(F.col(c) if isinstance(c, str) else c, digits) + F.lit(0.0)

def rs(e: str, digits: int = 6) -> str:
    return f"round({e}, {digits}) + CAST(0 AS DOUBLE)"

def d(x: float) -> str:
    return f"CAST('{x!r}' AS DOUBLE)"

def _rounded(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: r(c, digits) for c in names})

# ---- projections and scalars

_wrap = lambda e: f"(({e}) - floor({e}))"

@query("wrap_positions", f"WITH {view_sql('halos')} SELECT id, {rs(_wrap(f'(x*{d(1700.0)} - {d(300.0)})/{d(1000.0)}'), 9)} AS x, {rs(_wrap(f'(y*{d(1700.0)} - {d(300.0)})/{d(1000.0)}'), 9)} AS y, {rs(_wrap(f'(z*{d(1700.0)} - {d(300.0)})/{d(1000.0)}'), 9)} AS z FROM halos")
def wrap_positions(spark, sf_dir):
    raw = view(spark, sf_dir, "halos").select("id", *[(F.col(c) * 1700.0 - 300.0).alias(c) for c in G.AXES])
    return _rounded(catalog.in_box_units(raw, BOX.size), *G.AXES, digits=9)

def _shift_sql(axis: str, moved: str) -> str:
    return f"WITH {view_sql('halos')} SELECT id, {rs(_wrap(moved), 9)} AS {axis} FROM halos"

for _axis in G.AXES:

    @query(f"rsd_shift_{_axis}", _shift_sql(_axis, f"{_axis} + v{_axis} / {d(100.0 * BOX.size)}"))
    def rsd_shift(spark, sf_dir, axis=_axis):
        return _rounded(catalog.shift_redshift_space(view(spark, sf_dir, "halos"), BOX, axis).select("id", axis), axis, digits=9)

    @query(f"gred_shift_{_axis}", _shift_sql(_axis, f"{_axis} - pot * {d(C.LIGHT_KMS)} / {d(100.0 * BOX.size)}"))
    def gred_shift(spark, sf_dir, axis=_axis):
        return _rounded(catalog.shift_gravitational(view(spark, sf_dir, "halos"), BOX, axis).select("id", axis), axis, digits=9)

_A = f"({d(1.0)} / ({d(1.0)} + CAST(child_level AS DOUBLE)))"
_H = f"({d(100.0)} * sqrt({d(0.3)} / ({_A}*{_A}*{_A}) + {d(0.7)}))"

@query("rsd_shift_row_a", _shift_sql("z", f"z + vz / ({_A} * {_H} * {d(1000.0)})"))
def rsd_shift_row_a(spark, sf_dir):
    a = C.scale_factor(F.col("child_level").cast("double"))
    return _rounded(catalog.shift_redshift_space(view(spark, sf_dir, "halos"), BOX, "z", a).select("id", "z"), "z", digits=9)

_zl = f"(z*{d(1000.0)} + vz / {d(100.0)})"

@query("loader_shift_z", f"WITH {view_sql('halos')} SELECT id, {rs(f'CASE WHEN {_zl} >= 1000 THEN {_zl} - 1000 WHEN {_zl} < 0 THEN {_zl} + 1000 ELSE {_zl} END')} AS z FROM halos")
def loader_shift_z(spark, sf_dir):
    raw = view(spark, sf_dir, "halos").withColumn("z", F.col("z") * 1000.0)
    return _rounded(catalog.shift_while_loading(raw, BOX, "z").select("id", "z"), "z")

_zp = f"(z*{d(1000.0)} - pot*{d(C.LIGHT_KMS)} / {d(100.0)})"

@query("loader_shift_pot", f"WITH {view_sql('halos')} SELECT id, {rs(f'CASE WHEN {_zp} >= 1000 THEN {_zp} - 1000 WHEN {_zp} < 0 THEN {_zp} + 1000 ELSE {_zp} END')} AS z FROM halos")
def loader_shift_pot(spark, sf_dir):
    raw = view(spark, sf_dir, "halos").withColumn("z", F.col("z") * 1000.0)
    return _rounded(catalog.shift_while_loading(raw, BOX, "z", "pot").select("id", "z"), "z")

@query(
    "cosmo_scalars",
    f"""WITH {view_sql('halos')}, l AS (SELECT DISTINCT CAST(child_level AS DOUBLE) AS z, {_A} AS a, child_level FROM halos)
    SELECT child_level, {rs('a', 9)} AS a, {rs('1/a - 1', 9)} AS z, {rs(f'100*sqrt({d(0.3)}/(a*a*a) + {d(0.7)})')} AS ha, {rs(f'100*sqrt({d(0.3)}*(1+z)*(1+z)*(1+z) + {d(0.7)})')} AS hz,
    {rs(f'sqrt(a/({d(0.3)} + {d(0.7)}*a*a*a))')} AS dtda, {rs(f'70*sqrt({d(1e-4)}/(a*a*a*a) + {d(0.3)}/(a*a*a) + {d(1 - 0.3 - 0.6 - 1e-4)}/(a*a) + {d(0.6)})')} AS h_full,
    {rs(d(C.poisson_noise(1000.0, 128)))} AS noise, {rs(d(C.nyquist(1000.0, 128)))} AS nyquist FROM l""",
)
def cosmo_scalars(spark, sf_dir):
    z = F.col("child_level").cast("double")
    levels = view(spark, sf_dir, "halos").select("child_level").distinct().withColumn("a", C.scale_factor(z))
    a = F.col("a")
    return levels.select("child_level", r(a, 9).alias("a"), r(C.redshift(a), 9).alias("z"), r(C.hubble_a(a, 0.3, 0.7)).alias("ha"), r(C.hubble_z(z, 0.3, 0.7)).alias("hz"), r(C.dtda(a, 0.3, 0.7)).alias("dtda"), r(C.hubble_full(a, 70.0, 0.3, 0.6, 1e-4)).alias("h_full"), r(F.lit(C.poisson_noise(1000.0, 128))).alias("noise"), r(F.lit(C.nyquist(1000.0, 128))).alias("nyquist"))

@query(
    "cosmo_time",
    f"""WITH {view_sql('halos')}, l AS (SELECT DISTINCT child_level, {_A} AS a FROM halos)
    SELECT child_level, {rs(f'2/(3*sqrt({d(0.7)})) * asinh(sqrt({d(0.7 / 0.3)}*a*a*a))')} AS age, {rs('a')} AS a_back, {rs('1/a - 1', 5)} AS z_back FROM l""",
)
def cosmo_time(spark, sf_dir):
    levels = view(spark, sf_dir, "halos").select("child_level").distinct().withColumn("a", C.scale_factor(F.col("child_level").cast("double")))
    timed = levels.withColumn("age", C.age_of(0.3, 0.7)(F.col("a"))).withColumn("back", C.scale_factor_of_age(0.3, 0.7)(F.col("age")))
    return timed.select("child_level", r("age").alias("age"), r("back").alias("a_back"), r(C.redshift(F.col("back")), 5).alias("z_back"))

@query("octant_codes", f"WITH {view_sql('halos')} SELECT CAST((CASE WHEN x > 0.5 THEN 1 ELSE 0 END) + (CASE WHEN y > 0.5 THEN 2 ELSE 0 END) + (CASE WHEN z > 0.5 THEN 4 ELSE 0 END) AS INT) AS octant, count(*) AS n FROM halos GROUP BY 1")
def octant_codes(spark, sf_dir):
    return view(spark, sf_dir, "halos").groupBy(G.octant().alias("octant")).agg(F.count(F.lit(1)).alias("n"))

@query("bbox", f"WITH {view_sql('halos')} SELECT {', '.join(f'{f}({c}) AS {f}_{c}' for c in G.AXES for f in ('min', 'max'))} FROM halos")
def bbox(spark, sf_dir):
    return catalog.bounding_box(view(spark, sf_dir, "halos"))

_gap = lambda c: f"greatest({d(0.4)} - {c}, {c} - {d(0.6)}, {d(0.0)})"

@query("box_distance", f"WITH {view_sql('halos')}, t AS (SELECT id, {_gap('x')}*{_gap('x')} + {_gap('y')}*{_gap('y')} + {_gap('z')}*{_gap('z')} AS d2 FROM halos) SELECT id, {rs('d2', 9)} AS d2, d2 <= {d(0.1 * 0.1)} AS meets FROM t")
def box_distance(spark, sf_dir):
    low, high, q = [F.lit(0.4)] * 3, [F.lit(0.6)] * 3, [F.col(c) for c in G.AXES]
    return view(spark, sf_dir, "halos").select("id", r(G.box_distance2(low, high, q), 9).alias("d2"), G.box_meets_sphere(low, high, q, F.lit(0.1)).alias("meets"))

_X = "CAST(i AS DOUBLE)*0.05"

def _w_sql(q: str, h: float) -> str:
    return f"(CASE WHEN {q} <= 2 THEN {d(495 / (256 * math.pi) / h**3)}*pow(1-{q}/2, 6)*(1 + 3*{q} + {d(35 / 12)}*{q}*{q}) ELSE 0 END)"

def _dw_sql(q: str, h: float) -> str:
    return f"(CASE WHEN {q} <= 2 THEN {d(495 / (256 * math.pi) / h**3 * -14 / 3)}*{q}*pow(1-{q}/2, 5)*(1 + 2.5*{q}) ELSE 0 END)"

def _g_sql(dist: str, eps: float) -> str:
    x = f"least(2*{dist}/{d(eps)}, 2)"
    s = f"greatest({x} - 1, 0)"
    return f"(1 + pow({x},3)*(-8/5.0 + pow({x},2)*(8/5.0 + {x}*(-0.5 + {x}*(3*{x}/20.0 - 12/35.0)))) - pow({s},6)*(3/35.0 + {x}*(18/35.0 + {x}/5.0)))"

def _gpot_sql(dist: str, eps: float) -> str:
    x = f"(2*least({dist}, {d(eps)})/{d(eps)})"
    near = f"(208 + 14*pow({x},2)*(-8 + pow({x},2)*(4 + {x}*(-1 + {x}*(3*{x} - 8)/14.0))))"
    far = f"(12/{x} + 128 + 14*{x}*(16 + {x}*(-32 + {x}*(20 + {x}*(-4 + {x}*(-1 + {x}*(8 - {x})/14.0))))))"
    return f"(CASE WHEN {x} > 1.999 THEN 0 WHEN {x} <= 1 THEN 1 - {x}/140.0*{near} ELSE 1 - {x}/140.0*{far} END)"

_FROM_CENTRE = "sqrt((x - 0.5)*(x - 0.5) + (y - 0.5)*(y - 0.5) + (z - 0.5)*(z - 0.5))"
_PROFILE = f"WITH {view_sql('halos')}, p AS (SELECT id, {_FROM_CENTRE}*4 AS q FROM halos)"

def _profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "halos").select("id", F.expr(f"{_FROM_CENTRE}*4").alias("q"))

@query("wendland_profile", f"{_PROFILE} SELECT id, {rs(_w_sql('q', 1.0), 9)} AS w, {rs(_dw_sql('q', 1.0), 9)} AS dw FROM p")
def wendland_profile(spark, sf_dir):
    """Kernel and slope at each halo's distance from the centre."""
    q = F.col("q")
    return _profile(spark, sf_dir).select("id", r(K.wendland(q, 1.0), 9).alias("w"), r(K.wendland_slope(q, 1.0), 9).alias("dw"))

@query("gfactor_profile", f"{_PROFILE} SELECT id, {rs(_g_sql('q', 1.5), 9)} AS g, {rs(_gpot_sql('q', 1.5), 9)} AS g_pot FROM p")
def gfactor_profile(spark, sf_dir):
    q = F.col("q")
    return _profile(spark, sf_dir).select("id", r(K.force_split(q, 1.5), 9).alias("g"), r(K.potential_split(q, 1.5), 9).alias("g_pot"))

# ---- selections and samples

_CUT = (4.5, 5.2)

@query("select_mass_level", f"WITH {view_sql('halos')} SELECT id, mvir, child_level FROM halos WHERE mvir >= {d(10.0 ** _CUT[0])} AND mvir <= {d(10.0 ** _CUT[1])} AND child_level BETWEEN 0 AND 2")
def select_mass_level(spark, sf_dir):
    return catalog.select_mass_level(view(spark, sf_dir, "halos"), _CUT, (0, 2)).select("id", "mvir", "child_level")

@query("select_empty", f"WITH {view_sql('halos')} SELECT count(*) AS n FROM halos WHERE mvir < 0 AND child_level >= 0")
def select_empty(spark, sf_dir):
    none = catalog.select_range(view(spark, sf_dir, "halos"), "mvir", -2.0, -1.0)
    return catalog.select_range(none, "child_level", 0, 100).agg(F.count(F.lit(1)).alias("n"))

@query("select_half_open", f"WITH {view_sql('halos')} SELECT id FROM halos WHERE mvir >= 50000 AND mvir < 100000")
def select_half_open(spark, sf_dir):
    return catalog.select_range(view(spark, sf_dir, "halos"), "mvir", 50000.0, 100000.0, "left").select("id")

@query("select_position", f"WITH {view_sql('halos')} SELECT id FROM halos WHERE {' AND '.join(f'{c} >= {d(0.2 - 0.05)} AND {c} <= {d(0.6 + 0.05)}' for c in G.AXES)}")
def select_position(spark, sf_dir):
    return catalog.select_position(view(spark, sf_dir, "halos"), 0.2, 0.6, 0.05).select("id")

def hash_sql(key: str, seed: int) -> str:
    p = catalog.HASH_MOD
    a = f"(({key} % {p} * 48271 + {key} // {p} % {p} * 40692 + {seed * 69621 + 11}) % {p})"
    b = f"(({a} * {a} % {p} * 16807 + {a} * 40692 + 12345 + {key} // {p} % {p} * {catalog.second_factor(seed)}) % {p})"
    return f"(({b} * {b} % {p} * 48271 + {b} * 69621 + {a}) % {p})"


@query("sample_bernoulli", f"WITH {view_sql('halos')} SELECT id FROM halos WHERE {hash_sql('id', 100)} < {int(0.3 * catalog.HASH_MOD)}")
def sample_bernoulli(spark, sf_dir):
    return catalog.sample_bernoulli(view(spark, sf_dir, "halos"), 0.3).select("id")

@query("sample_exact", f"WITH {view_sql('halos')} SELECT id FROM (SELECT id, row_number() OVER (ORDER BY {hash_sql('id', 100)}, id) AS n, count(*) OVER () AS c FROM halos) WHERE n <= floor(c * {d(0.25)})")
def sample_exact(spark, sf_dir):
    return catalog.sample_exact(view(spark, sf_dir, "halos"), 0.25).select("id")

_DRAWS = ", ".join(rs(f"CAST({hash_sql(f'(g * 3 + {k})', 310 + k)} AS DOUBLE) / {d(float(catalog.HASH_MOD))}", 9) + f" AS {c}" for k, c in enumerate(G.AXES))

@query("random_uniform", f"WITH {view_sql('halos')}, g AS (SELECT unnest(range(2*(SELECT count(*) FROM halos))) AS g) SELECT g AS id, {_DRAWS} FROM g")
def random_uniform(spark, sf_dir):
    """Two random points for each halo."""
    return _rounded(catalog.random_catalog(spark, 2 * view(spark, sf_dir, "halos").count(), 10), *G.AXES, digits=9)

@query("delete_and_replace", f"WITH {view_sql('halos')} SELECT id, CASE WHEN id % 11 = 0 THEN mvir * 2 ELSE mvir END AS mvir FROM halos WHERE id % 7 <> 0 OR id % 11 = 0")
def delete_and_replace(spark, sf_dir):
    halos = view(spark, sf_dir, "halos").select("id", "mvir")
    left = catalog.without_ids(halos, halos.where("id % 7 = 0").select("id"))
    return catalog.upsert(left, halos.where("id % 11 = 0").withColumn("mvir", F.col("mvir") * 2))

# ---- pairs

_img = lambda e: f"({e} - floor({e} + 0.5))"

def pairs_sql(a: str, b: str, reach: float, extra: str = "", name: str = "p") -> str:
    """CTE of pairs within reach: each unordered pair once if a is b."""
    once = "a.id < b.id" if a == b else "true"
    return f"""{name}_d AS (SELECT {_img('a.x - b.x')} AS dx, {_img('a.y - b.y')} AS dy, {_img('a.z - b.z')} AS dz, a.id AS id1, b.id AS id2{extra} FROM {a} a JOIN {b} b ON {once}
      WHERE abs({_img('a.x - b.x')}) < {d(reach * 1.001)} AND abs({_img('a.y - b.y')}) < {d(reach * 1.001)}),
    {name} AS (SELECT *, sqrt(dx*dx + dy*dy + dz*dz) AS r FROM {name}_d)"""

def bin_sql(e: str, b: RadialBins) -> str:
    place = f"ln({e}/{d(b.low)})/{d(b.step)}" if b.log else f"({e} - {d(b.low)})/{d(b.step)}"
    return f"CAST(floor({place}) AS INT)"

def counts_sql(a: str, b: str, bins: RadialBins, name: str) -> str:
    """CTEs ending in ``name`` (ir, n) for every bin."""
    return f"""{pairs_sql(a, b, bins.high, name=f'{name}_p')}, {name} AS (SELECT ir, coalesce(n, 0) AS n FROM (SELECT CAST(range AS INT) AS ir FROM range({bins.n}))
      LEFT JOIN (SELECT {bin_sql('r', bins)} AS ir, count(*) AS n FROM {name}_p WHERE r >= {d(bins.low)} AND r < {d(bins.high)} GROUP BY 1) USING (ir))"""

def _edges(b: RadialBins, ir: str = "ir") -> tuple[str, str]:
    if b.log:
        return tuple(f"({d(b.low)}*exp(({ir}+{k})*{d(b.step)}))" for k in (0, 1))
    return tuple(f"({d(b.low)} + ({ir}+{k})*{d(b.step)})" for k in (0, 1))

def _shell(b: RadialBins) -> str:
    lo, hi = _edges(b)
    return f"{d(4 * math.pi / 3)}*(pow({hi},3) - pow({lo},3))"

_NH = "(SELECT count(*) FROM halos)"
_NT = "(SELECT count(*) FROM tracers)"
_NR = "(SELECT count(*) FROM random_catalog)"
_NP = f"CAST({_NH} AS DOUBLE)*({_NH}-1)/2"

@query("dd_auto", f"WITH {view_sql('halos')}, {counts_sql('halos', 'halos', R_BINS, 'c')} SELECT ir, n FROM c")
def dd_auto(spark, sf_dir):
    return pairs.count_r(view(spark, sf_dir, "halos"), None, R_BINS)

@query("dd_cross", f"WITH {view_sql('halos', 'tracers')}, {counts_sql('halos', 'tracers', R_BINS, 'c')} SELECT ir, n FROM c")
def dd_cross(spark, sf_dir):
    return pairs.count_r(view(spark, sf_dir, "halos"), view(spark, sf_dir, "tracers"), R_BINS)

@query("dd_log_bins", f"WITH {view_sql('halos')}, {counts_sql('halos', 'halos', LOG_BINS, 'c')} SELECT ir, n FROM c")
def dd_log_bins(spark, sf_dir):
    return pairs.count_r(view(spark, sf_dir, "halos"), None, LOG_BINS)

def _smu_sql(mu: str, b: SmuBins) -> str:
    im = f"CAST(floor(({mu} - {d(b.mu_low)})/{d(b.mu_step)}) AS INT)"
    return f"SELECT {bin_sql('r', b.r)} AS ir, {im} AS imu, count(*) AS n FROM p WHERE r > 0 AND r >= {d(b.r.low)} AND r < {d(b.r.high)} AND {im} < {b.n_mu} AND {im} >= 0 GROUP BY 1, 2"

@query("dd_smu_half", f"WITH {view_sql('halos')}, {pairs_sql('halos', 'halos', 0.05)} {_smu_sql('abs(dz)/r', SMU)}")
def dd_smu_half(spark, sf_dir):
    return pairs.count_smu(view(spark, sf_dir, "halos"), None, SMU)

SMU_FULL = SmuBins(SMU.r, 4, half=False)

@query("dd_smu_full", f"WITH {view_sql('halos')}, {pairs_sql('halos', 'halos', 0.05)} {_smu_sql('dz/r', SMU_FULL)}")
def dd_smu_full(spark, sf_dir):
    return pairs.count_smu(view(spark, sf_dir, "halos"), None, SMU_FULL)

@query("dd_smu_cross", f"WITH {view_sql('halos', 'tracers')}, {pairs_sql('halos', 'tracers', 0.05)} {_smu_sql('abs(dx)/r', SMU)}")
def dd_smu_cross(spark, sf_dir):
    return pairs.count_smu(view(spark, sf_dir, "halos"), view(spark, sf_dir, "tracers"), SMU, "x")

def _spsp_sql(b: SpspBins) -> str:
    perp, par = "sqrt(dx*dx + dy*dy)", f"CAST(floor((abs(dz) - {d(b.par_low)})/{d(b.par_step)}) AS INT)"
    return f"SELECT {bin_sql(perp, b.perp)} AS iperp, {par} AS ipar, count(*) AS n FROM p WHERE {perp} >= {d(b.perp.low)} AND {perp} < {d(b.perp.high)} AND {par} < {b.n_par} GROUP BY 1, 2"

@query("dd_spsp_half", f"WITH {view_sql('halos')}, {pairs_sql('halos', 'halos', SPSP.reach)} {_spsp_sql(SPSP)}")
def dd_spsp_half(spark, sf_dir):
    return pairs.count_spsp(view(spark, sf_dir, "halos"), None, SPSP)

@query("dd_spsp_cross", f"WITH {view_sql('halos', 'tracers')}, {pairs_sql('halos', 'tracers', SPSP.reach)} {_spsp_sql(SPSP)}")
def dd_spsp_cross(spark, sf_dir):
    return pairs.count_spsp(view(spark, sf_dir, "halos"), view(spark, sf_dir, "tracers"), SPSP)

@query("ideal_pairs_r", f"WITH {view_sql('halos')} SELECT ir, {rs(f'{_NP}*{_shell(R_BINS)}')} AS rr FROM (SELECT CAST(range AS INT) AS ir FROM range({R_BINS.n}))")
def ideal_pairs_r(spark, sf_dir):
    return _rounded(pairs.ideal_r(spark, R_BINS, pairs.pair_total(view(spark, sf_dir, "halos").count())), "rr")

_SPINE2 = "(SELECT CAST(a.range AS INT) AS ir, CAST(b.range AS INT) AS im FROM range({}) a, range({}) b)"

@query("ideal_pairs_smu", f"WITH {view_sql('halos')} SELECT ir, im AS imu, {rs(f'{_NP}*{_shell(SMU.r)}*{d(SMU.mu_step)}')} AS rr FROM {_SPINE2.format(SMU.r.n, SMU.n_mu)}")
def ideal_pairs_smu(spark, sf_dir):
    return _rounded(pairs.ideal_smu(spark, SMU, pairs.pair_total(view(spark, sf_dir, "halos").count())), "rr")

def _ring(b: SpspBins) -> str:
    lo, hi = _edges(b.perp)
    return f"{d(math.pi * b.par_step * (2.0 if b.half else 1.0))}*({hi}*{hi} - {lo}*{lo})"

@query("ideal_pairs_spsp", f"WITH {view_sql('halos')} SELECT ir AS iperp, im AS ipar, {rs(f'{_NP}*{_ring(SPSP)}')} AS rr FROM {_SPINE2.format(SPSP.perp.n, SPSP.n_par)}")
def ideal_pairs_spsp(spark, sf_dir):
    return _rounded(pairs.ideal_spsp(spark, SPSP, pairs.pair_total(view(spark, sf_dir, "halos").count())), "rr")

def _xi(top: str) -> str:
    return rs(f"CASE WHEN rr > 0 THEN ({top})/rr ELSE 0 END")

@query("xi_auto_ideal", f"WITH {view_sql('halos')}, {counts_sql('halos', 'halos', R_BINS, 'c')}, e AS (SELECT ir, n, {_NP}*{_shell(R_BINS)} AS rr FROM c) SELECT ir, n, {rs('rr', 4)} AS rr, {_xi('n - rr')} AS xi FROM e")
def xi_auto_ideal(spark, sf_dir):
    return _rounded(_rounded(pairs.xi_auto(view(spark, sf_dir, "halos"), R_BINS), "xi"), "rr", digits=4)

@query("xi_auto_natural", f"WITH {view_sql('halos')}, {counts_sql('halos', 'halos', R_BINS, 'c')}, e AS (SELECT ir, n, CAST({_NH} AS DOUBLE)*{_NH}/2*{_shell(R_BINS)} AS rr FROM c) SELECT ir, {_xi('n - rr')} AS xi FROM e")
def xi_auto_natural(spark, sf_dir):
    return _rounded(pairs.xi_auto(view(spark, sf_dir, "halos"), R_BINS, natural=True).select("ir", "xi"), "xi")

_F = f"(CAST({_NR} AS DOUBLE)/{_NH})"
_AUTO = f"WITH {view_sql('halos', 'random_catalog')}, {counts_sql('halos', 'halos', R_BINS, 'dd')}, {counts_sql('random_catalog', 'random_catalog', R_BINS, 'rr_')}"

@query("xi_auto_rr", f"{_AUTO} SELECT ir, dd.n AS dd, rr_.n AS rr, {rs(f'CASE WHEN rr_.n > 0 THEN ({_F}*{_F}*dd.n - rr_.n)/rr_.n ELSE 0 END')} AS xi FROM dd JOIN rr_ USING (ir)")
def xi_auto_rr(spark, sf_dir):
    return _rounded(pairs.xi_auto(view(spark, sf_dir, "halos"), R_BINS, "RR", view(spark, sf_dir, "random_catalog")), "xi")

@query("xi_auto_ls", f"{_AUTO}, {counts_sql('halos', 'random_catalog', R_BINS, 'dr_')} SELECT ir, dd.n AS dd, rr_.n AS rr, CAST(dr_.n AS DOUBLE)/2 AS dr, {rs(f'CASE WHEN rr_.n > 0 THEN ({_F}*{_F}*dd.n - {_F}*dr_.n + rr_.n)/rr_.n ELSE 0 END')} AS xi FROM dd JOIN rr_ USING (ir) JOIN dr_ USING (ir)")
def xi_auto_ls(spark, sf_dir):
    return _rounded(pairs.xi_auto(view(spark, sf_dir, "halos"), R_BINS, "LS", view(spark, sf_dir, "random_catalog")), "xi")

@query("xi_cross_ideal", f"WITH {view_sql('halos', 'tracers')}, {counts_sql('halos', 'tracers', R_BINS, 'c')}, e AS (SELECT ir, n, CAST({_NH} AS DOUBLE)*{_NT}*{_shell(R_BINS)} AS rr FROM c) SELECT ir, n, {rs('rr', 4)} AS rr, {_xi('n - rr')} AS xi FROM e")
def xi_cross_ideal(spark, sf_dir):
    return _rounded(_rounded(pairs.xi_cross(view(spark, sf_dir, "halos"), view(spark, sf_dir, "tracers"), R_BINS), "xi"), "rr", digits=4)

def _randoms(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    one = view(spark, sf_dir, "random_catalog")
    return one, one.select("id", F.col("y").alias("x"), F.col("z").alias("y"), F.col("x").alias("z"))

@query(
    "xi_cross_ls",
    f"""WITH {view_sql('halos', 'tracers', 'random_catalog')}, random2 AS (SELECT id, y AS x, z AS y, x AS z FROM random_catalog),
    {counts_sql('halos', 'tracers', R_BINS, 'dd')}, {counts_sql('random_catalog', 'random2', R_BINS, 'rr_')}, {counts_sql('halos', 'random2', R_BINS, 'd1')}, {counts_sql('tracers', 'random_catalog', R_BINS, 'd2')},
    f AS (SELECT CAST({_NR} AS DOUBLE)/{_NH} AS f1, CAST({_NR} AS DOUBLE)/{_NT} AS f2)
    SELECT ir, dd.n AS dd, rr_.n AS rr, d1.n AS d1r2, d2.n AS d2r1, {rs('CASE WHEN rr_.n > 0 THEN (f1*f2*dd.n - f1*d1.n - f2*d2.n + rr_.n)/rr_.n ELSE 0 END')} AS xi
    FROM dd JOIN rr_ USING (ir) JOIN d1 USING (ir) JOIN d2 USING (ir), f""",
)
def xi_cross_ls(spark, sf_dir):
    one, two = _randoms(spark, sf_dir)
    return _rounded(pairs.xi_cross(view(spark, sf_dir, "halos"), view(spark, sf_dir, "tracers"), R_BINS, "LS", one, two), "xi")

_SMU_XI = f"""c AS ({_smu_sql('abs(dz)/r', SMU)}), x AS (SELECT s.ir, s.im AS imu, coalesce(c.n, 0) AS n, {_NP}*{_shell(SMU.r).replace('ir', 's.ir')}*{d(SMU.mu_step)} AS rr
  FROM {_SPINE2.format(SMU.r.n, SMU.n_mu)} s LEFT JOIN c ON c.ir = s.ir AND c.imu = s.im), xi AS (SELECT *, CASE WHEN rr > 0 THEN n/rr - 1 ELSE 0 END AS xi FROM x)"""

@query("xi_smu_to_1d", f"WITH {view_sql('halos')}, {pairs_sql('halos', 'halos', 0.05)}, {_SMU_XI} SELECT ir, {rs('CASE WHEN sum(rr) > 0 THEN sum(rr*xi)/sum(rr) ELSE 0 END')} AS xi FROM xi GROUP BY ir")
def xi_smu_to_1d(spark, sf_dir):
    halos = view(spark, sf_dir, "halos")
    xi = pairs.xi_ideal(pairs.count_smu(halos, None, SMU), pairs.ideal_smu(spark, SMU, pairs.pair_total(halos.count())), ["ir", "imu"])
    return _rounded(pairs.project_smu(xi), "xi")

_SPAN = (SPSP.par_high - SPSP.par_low) * 2

@query(
    "wp_projected",
    f"""WITH {view_sql('halos')}, {pairs_sql('halos', 'halos', SPSP.reach)}, c AS ({_spsp_sql(SPSP)}), x AS (SELECT s.ir AS iperp, coalesce(c.n, 0) AS n, {_NP}*{_ring(SPSP).replace('ir', 's.ir')} AS rr
    FROM {_SPINE2.format(SPSP.perp.n, SPSP.n_par)} s LEFT JOIN c ON c.iperp = s.ir AND c.ipar = s.im)
    SELECT iperp, {rs(f'CASE WHEN sum(rr) > 0 THEN sum(rr*(n/rr - 1))/sum(rr)*{d(_SPAN)} ELSE 0 END', 9)} AS wp FROM x GROUP BY 1""",
)
def wp_projected(spark, sf_dir):
    halos = view(spark, sf_dir, "halos")
    xi = pairs.xi_ideal(pairs.count_spsp(halos, None, SPSP), pairs.ideal_spsp(spark, SPSP, pairs.pair_total(halos.count())), ["iperp", "ipar"])
    return _rounded(pairs.project_spsp(xi, SPSP), "wp", digits=9)

@query("xi_quadrants", f"""WITH {view_sql('halos')}, {pairs_sql('halos', 'halos', 0.05)}, {_SMU_XI}, q AS (SELECT ir, imu, {d(SMU.r.low)} + (ir + 0.5)*{d(SMU.r.step)} AS s, {d(SMU.mu_low)} + (imu + 0.5)*{d(SMU.mu_step)} AS mu, xi FROM xi), sg AS (SELECT * FROM (VALUES (1.0), (-1.0)) t(g))
  SELECT ir, imu, {rs('s*sqrt(1 - mu*mu)*a.g')} AS s_perp, {rs('s*mu*b.g')} AS s_par, {rs('s*s*xi', 9)} AS s2xi FROM q, sg a, sg b""")
def xi_quadrants(spark, sf_dir):
    halos = view(spark, sf_dir, "halos")
    xi = pairs.xi_ideal(pairs.count_smu(halos, None, SMU), pairs.ideal_smu(spark, SMU, pairs.pair_total(halos.count())), ["ir", "imu"])
    return _rounded(_rounded(pairs.plot_quadrants(xi, SMU), "s_perp", "s_par"), "s2xi", digits=9)

# ---- jackknife

_BLOCK = f"CAST(floor(z*{JK_LEVEL}) % {JK_LEVEL} + {JK_LEVEL}*(floor(y*{JK_LEVEL}) % {JK_LEVEL} + {JK_LEVEL}*(floor(x*{JK_LEVEL}) % {JK_LEVEL})) AS INT)"

def _leave_sql(a: str, b: str, bins: RadialBins, blocks: int, name: str) -> str:
    return f"""{pairs_sql(a, b, bins.high, ', a.block_id AS b1, b.block_id AS b2', f'{name}_p')},
    {name}_t AS (SELECT {bin_sql('r', bins)} AS ir, b1, b2, count(*) AS n FROM {name}_p WHERE r >= {d(bins.low)} AND r < {d(bins.high)} GROUP BY 1, 2, 3),
    {name} AS (SELECT CAST(k.range AS INT) AS block_id, CAST(s.range AS INT) AS ir, CAST(coalesce(sum(CASE WHEN b1 <> k.range AND b2 <> k.range THEN n END), 0) AS BIGINT) AS n
      FROM range({blocks}) k CROSS JOIN range({bins.n}) s LEFT JOIN {name}_t t ON t.ir = s.range GROUP BY 1, 2)"""

_JK = f"h AS (SELECT *, {_BLOCK} AS block_id FROM halos), rc AS (SELECT *, {_BLOCK} AS block_id FROM random_catalog)"

@query("jk_spatial_dd", f"WITH {view_sql('halos', 'random_catalog')}, {_JK}, {_leave_sql('h', 'h', R_BINS, JK_LEVEL**3, 'dd')} SELECT block_id, ir, n FROM dd")
def jk_spatial_dd(spark, sf_dir):
    return jackknife.leave_one_out(jackknife.spatial_blocks(view(spark, sf_dir, "halos"), JK_LEVEL), None, R_BINS, JK_LEVEL**3)

@query(
    "jk_shuffle_dd",
    f"""WITH {view_sql('halos')}, o AS (SELECT *, row_number() OVER (ORDER BY {hash_sql('id', 10)}, id) - 1 AS pos FROM halos), c AS (SELECT count(*) AS nn, CAST(ceil(count(*)/{d(float(JK_SLICES))}) AS BIGINT) AS m FROM halos),
    h AS (SELECT o.*, CAST(k.range AS INT) AS block_id FROM o, c, range({JK_SLICES}) k WHERE pos >= k.range*((nn - m)//{JK_SLICES - 1}) AND pos < k.range*((nn - m)//{JK_SLICES - 1}) + m),
    {_leave_sql('h', 'h', R_BINS, JK_SLICES, 'dd')} SELECT block_id, ir, n FROM dd""",
)
def jk_shuffle_dd(spark, sf_dir):
    return jackknife.leave_one_out(jackknife.shuffle_blocks(view(spark, sf_dir, "halos"), JK_SLICES), None, R_BINS, JK_SLICES)

_JK_XI = f"""WITH {view_sql('halos', 'random_catalog')}, {_JK}, {_leave_sql('h', 'h', R_BINS, JK_LEVEL**3, 'dd')}, {_leave_sql('rc', 'rc', R_BINS, JK_LEVEL**3, 'rr')}, {_leave_sql('h', 'rc', R_BINS, JK_LEVEL**3, 'dr')},
  sz AS (SELECT CAST(range AS INT) AS block_id, CAST({_NR} - (SELECT count(*) FROM rc WHERE block_id = range) AS DOUBLE)/({_NH} - (SELECT count(*) FROM h WHERE block_id = range)) AS f FROM range({JK_LEVEL**3})),
  x AS (SELECT block_id, ir, CASE WHEN rr.n > 0 THEN (f*f*dd.n - f*dr.n + rr.n)/rr.n ELSE 0 END AS xi FROM dd JOIN rr USING (block_id, ir) JOIN dr USING (block_id, ir) JOIN sz USING (block_id))"""

def _jk_xi(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = jackknife.spatial_blocks(view(spark, sf_dir, "halos"), JK_LEVEL)
    rc = jackknife.spatial_blocks(view(spark, sf_dir, "random_catalog"), JK_LEVEL)
    b = JK_LEVEL**3
    counts = [jackknife.leave_one_out(*ab, R_BINS, b) for ab in ((h, None), (rc, None), (h, rc))]
    return jackknife.xi_blocks(*counts, jackknife.block_sizes(h), jackknife.block_sizes(rc), h.count(), rc.count())

@query("jk_xi_blocks", f"{_JK_XI} SELECT block_id, ir, {rs('xi')} AS xi FROM x")
def jk_xi_blocks(spark, sf_dir):
    return _rounded(_jk_xi(spark, sf_dir), "xi")

@query("jk_xi_mean_se", f"{_JK_XI} SELECT ir, {rs('avg(xi)')} AS mean, {rs('sqrt((count(*) - 1)*var_pop(xi))')} AS se FROM x GROUP BY ir")
def jk_xi_mean_se(spark, sf_dir):
    return _rounded(jackknife.mean_and_error(_jk_xi(spark, sf_dir), ["ir"]), "mean", "se")

# ---- meshes

def stencil_sql(c: str, n: int, scheme: str, centering: str = "node") -> str:
    s = f"({c}*{d(float(n))})"
    wrap = lambda e: f"CAST((({e}) % {n} + {n}) % {n} AS INT)"
    fl = f"CAST(floor({s}) AS BIGINT)"
    if scheme == "ngp":
        parts = [(f"CAST(floor({s} + {0.5 if centering == 'node' else 0.0}) AS BIGINT)", d(1.0))]
    elif scheme == "cic" and centering == "node":
        parts = [(fl, f"(1 - ({s} - floor({s})))"), (f"{fl} + 1", f"({s} - floor({s}))")]
    elif scheme == "cic":
        off = f"({s} - 0.5 - floor({s}))"
        parts = [(fl, f"(1 - abs({off}))"), (f"{fl} + CASE WHEN {off} > 0 THEN 1 ELSE -1 END", f"abs({off})")]
    elif scheme == "tsc":
        off = f"({s} - 0.5 - floor({s}))"
        parts = [(f"{fl} - 1", f"(0.5*(0.5 - {off})*(0.5 - {off}))"), (fl, f"(0.75 - {off}*{off})"), (f"{fl} + 1", f"(0.5*(0.5 + {off})*(0.5 + {off}))")]
    else:
        u = f"({s} - floor({s}))"
        parts = [(f"{fl} - 1", f"(pow(1 - {u}, 3)/6.0)"), (fl, f"((4 - 6*{u}*{u} + 3*pow({u}, 3))/6.0)"), (f"{fl} + 1", f"((1 + 3*{u} + 3*{u}*{u} - 3*pow({u}, 3))/6.0)"), (f"{fl} + 2", f"(pow({u}, 3)/6.0)")]
    return "unnest([" + ", ".join(f"{{'i': {wrap(i)}, 'w': CAST({w} AS DOUBLE)}}" for i, w in parts) + "])"

def exploded_sql(source: str, n: int, scheme: str, keep: str = "", centering: str = "node", name: str = "e") -> str:
    keep = f", {keep}" if keep else ""
    return f"""{name}_x AS (SELECT {stencil_sql('x', n, scheme, centering)} AS sx, y, z{keep} FROM {source}), {name}_y AS (SELECT sx, {stencil_sql('y', n, scheme, centering)} AS sy, z{keep} FROM {name}_x),
    {name}_z AS (SELECT sx, sy, {stencil_sql('z', n, scheme, centering)} AS sz{keep} FROM {name}_y), {name} AS (SELECT sx.i AS ix, sy.i AS iy, sz.i AS iz, sx.w*sy.w*sz.w AS w{keep} FROM {name}_z)"""

def delta_sql(source: str, n: int, scheme: str, name: str = "delta") -> str:
    """CTEs ending in ``name`` (ix, iy, iz, val): the contrast on every cell."""
    return f"""{exploded_sql(source, n, scheme, name=f'{name}_e')}, {name}_m AS (SELECT ix, iy, iz, sum(w) AS val FROM {name}_e GROUP BY 1, 2, 3),
    {name} AS (SELECT c.ix, c.iy, c.iz, coalesce(val, 0)/(SELECT sum(val)/{n**3} FROM {name}_m) - 1 AS val FROM (SELECT CAST(a.range AS INT) AS ix, CAST(b.range AS INT) AS iy, CAST(c.range AS INT) AS iz FROM range({n}) a, range({n}) b, range({n}) c) c LEFT JOIN {name}_m m ON m.ix = c.ix AND m.iy = c.iy AND m.iz = c.iz)"""

MESH = 16

for _scheme, _centering in [("ngp", "node"), ("cic", "node"), ("tsc", "node"), ("pcs", "node"), ("ngp", "cell"), ("cic", "cell"), ("tsc", "cell")]:
    _name = f"mesh_{'pm_' if _centering == 'cell' else ''}{_scheme}"

    @query(_name, f"WITH {view_sql('particles')}, {exploded_sql('particles', MESH, _scheme, centering=_centering)} SELECT ix, iy, iz, {rs('sum(w)')} AS val FROM e GROUP BY 1, 2, 3")
    def mesh_scheme(spark, sf_dir, scheme=_scheme, centering=_centering):
        return _rounded(mesh.assign(view(spark, sf_dir, "particles"), MESH, scheme, centering=centering), "val")

@query("mesh_value_weighted", f"WITH {view_sql('particles')}, {exploded_sql('particles', MESH, 'cic', 'mass')} SELECT ix, iy, iz, {rs('sum(w*mass)')} AS val FROM e GROUP BY 1, 2, 3")
def mesh_value_weighted(spark, sf_dir):
    return _rounded(mesh.assign(view(spark, sf_dir, "particles"), MESH, "cic", "mass"), "val")

@query("mesh_open_edges", f"WITH {view_sql('particles')}, {exploded_sql('particles', MESH, 'tsc').replace(f' % {MESH} + {MESH}) % {MESH} AS INT', ') AS INT')} SELECT ix, iy, iz, {rs('sum(w)')} AS val FROM e WHERE least(ix, iy, iz) >= 0 AND greatest(ix, iy, iz) < {MESH} GROUP BY 1, 2, 3")
def mesh_open_edges(spark, sf_dir):
    return _rounded(mesh.assign(view(spark, sf_dir, "particles"), MESH, "tsc", periodic=False), "val")

@query("mesh_delta", f"WITH {view_sql('particles')}, {delta_sql('particles', MESH, 'tsc')} SELECT ix, iy, iz, {rs('val')} AS val FROM delta")
def mesh_delta(spark, sf_dir):
    return _rounded(mesh.contrast(mesh.assign(view(spark, sf_dir, "particles"), MESH, "tsc"), MESH), "val")

@query("mesh_minmax", f"WITH {view_sql('particles')}, {exploded_sql('particles', MESH, 'tsc')}, m AS (SELECT sum(w) AS val FROM e GROUP BY ix, iy, iz) SELECT {rs(f'CASE WHEN count(*) < {MESH**3} THEN 0 ELSE min(val) END')} AS low, {rs('max(val)')} AS high FROM m")
def mesh_minmax(spark, sf_dir):
    return _rounded(mesh.minmax(mesh.assign(view(spark, sf_dir, "particles"), MESH, "tsc"), MESH), "low", "high")

@query("mesh_rolled", f"WITH {view_sql('particles')}, {exploded_sql('particles', MESH, 'ngp')} SELECT CAST((ix + 3) % {MESH} AS INT) AS ix, CAST((iy + {MESH} - 5) % {MESH} AS INT) AS iy, iz, {rs('sum(w)')} AS val FROM e GROUP BY 1, 2, 3")
def mesh_rolled(spark, sf_dir):
    return _rounded(mesh.rolled(mesh.assign(view(spark, sf_dir, "particles"), MESH, "ngp"), MESH, (3, -5, 0)), "val")

def _cells_sql(n: int) -> str:
    return f"(SELECT CAST(a.range AS INT) AS ix, CAST(b.range AS INT) AS iy, CAST(c.range AS INT) AS iz FROM range({n}) a, range({n}) b, range({n}) c)"

_R2 = lambda n: "+".join(f"pow(({c} + 0.5)/{n}.0 - 0.5, 2)" for c in ("ix", "iy", "iz"))

_GAUSS = f"exp(-({_R2(N)})/{d(2 * 0.2**2)})/{d((2 * math.pi * 0.2**2) ** 1.5)}"
_TOPHAT = f"CASE WHEN {_R2(N)} <= {d(0.3 * 0.3)} THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END"
_SEEN = f"WITH {view_sql('particles')}, {exploded_sql('particles', N, 'cic')}, m AS (SELECT ix, iy, iz, sum(w) AS val FROM e GROUP BY 1, 2, 3)"

def _field_sql(weight: str) -> str:
    return f"{_SEEN}, f AS (SELECT c.ix, c.iy, c.iz, {weight} AS wt FROM {_cells_sql(N)} c), s AS (SELECT ix, iy, iz, wt, wt*coalesce(val, 0) AS val FROM f LEFT JOIN m USING (ix, iy, iz))"

def _under(spark: SparkSession, sf_dir: str, kind: str, size: float) -> DataFrame:
    """Particles' mesh times an analytic field, on every cell: ix, iy, iz, wt, val."""
    field = mesh.analytic_field(spark, N, kind, size).withColumnRenamed("val", "wt")
    seen = mesh.assign(view(spark, sf_dir, "particles"), N, "cic")
    return field.join(seen, list(mesh.CELL), "left").select(*mesh.CELL, "wt", (F.col("wt") * F.coalesce("val", F.lit(0.0))).alias("val"))

@query("gaussian_field", f"{_field_sql(_GAUSS)} SELECT ix, iy, iz, {rs('wt')} AS wt, {rs('val', 4)} AS val FROM s")
def gaussian_field(spark, sf_dir):
    """The particles' mesh under a Gaussian window."""
    return _rounded(_rounded(_under(spark, sf_dir, "gauss", 0.2), "wt"), "val", digits=4)

@query("tophat_field", f"{_field_sql(_TOPHAT)} SELECT ix, iy, iz, wt, {rs('val', 4)} AS val FROM s")
def tophat_field(spark, sf_dir):
    """The particles' mesh inside a ball."""
    return _rounded(_under(spark, sf_dir, "tophat", 0.3), "val", digits=4)

# ---- moments

_P = f"WITH {view_sql('particles')}, {exploded_sql('particles', N, 'cic', 'mass, vx, vy, vz')}"
_U = "u AS (SELECT ix, iy, iz, sum(mass*w) AS rho, " + ", ".join(f"CASE WHEN sum(mass*w) > 0 THEN sum(mass*w*v{c})/sum(mass*w) ELSE 0 END AS u{c}" for c in "xyz") + " FROM e GROUP BY 1, 2, 3)"

@query("moment_dens", f"{_P} SELECT ix, iy, iz, {rs('sum(mass*w)', 4)} AS rho FROM e GROUP BY 1, 2, 3")
def moment_dens(spark, sf_dir):
    return _rounded(moments.density(view(spark, sf_dir, "particles"), N, "cic"), "rho", digits=4)

@query("density_deltaf", f"{_P}, m AS (SELECT ix, iy, iz, sum(mass*w) AS rho FROM e GROUP BY 1, 2, 3) SELECT c.ix, c.iy, c.iz, {rs(f'1 + coalesce(rho, 0)*{d(N**3 / 1e6)}', 5)} AS rho FROM {_cells_sql(N)} c LEFT JOIN m ON m.ix = c.ix AND m.iy = c.iy AND m.iz = c.iz")
def density_deltaf(spark, sf_dir):
    return _rounded(moments.density(view(spark, sf_dir, "particles"), N, "cic", 1e6), "rho", digits=5)

@query("moment_velc", f"{_P}, {_U} SELECT ix, iy, iz, {rs('rho', 4)} AS rho, {', '.join(f'{rs(f"u{c}")} AS u{c}' for c in 'xyz')} FROM u")
def moment_velc(spark, sf_dir):
    return _rounded(_rounded(moments.mean_velocity(view(spark, sf_dir, "particles"), N, "cic"), "ux", "uy", "uz"), "rho", digits=4)

_SIG = "s AS (SELECT ix, iy, iz, rho, " + ", ".join(f"CASE WHEN rho > 0 THEN sum(mass*w*(v{t[0]} - u{t[0]})*(v{t[1]} - u{t[1]}))/rho ELSE 0 END AS s{t}" for t in moments.TENSOR) + " FROM e JOIN u USING (ix, iy, iz) GROUP BY ix, iy, iz, rho)"

@query("moment_sigma", f"{_P}, {_U}, {_SIG} SELECT ix, iy, iz, {rs('rho', 4)} AS rho, {', '.join(f'{rs(f"s{t}")} AS s{t}' for t in moments.TENSOR)} FROM s")
def moment_sigma(spark, sf_dir):
    out = moments.dispersion(view(spark, sf_dir, "particles"), N, "cic")
    return _rounded(_rounded(out, *[f"s{t}" for t in moments.TENSOR]), "rho", digits=4)

@query("sigma_trace", f"{_P}, {_U}, {_SIG}, t AS (SELECT ix, iy, iz, sqrt(sxx + syy + szz) AS sigma FROM s) SELECT ix, iy, iz, {rs('sigma')} AS sigma, {rs('sigma/(SELECT avg(sigma) FROM t)')} AS relative FROM t")
def sigma_trace(spark, sf_dir):
    out = moments.dispersion_trace(moments.dispersion(view(spark, sf_dir, "particles"), N, "cic"))
    return _rounded(out, "sigma", "relative")

@query("sigma_eigenvalues", f"{_P}, {_U}, {_SIG} SELECT ix, iy, iz, {rs('sxx + syy + szz')} AS trace, true AS ordered FROM s")
def sigma_eigenvalues(spark, sf_dir):
    out = moments.dispersion(view(spark, sf_dir, "particles"), N, "cic")
    out = out.withColumn("e", C.eigenvalues_3x3()(*[F.col(f"s{t}") for t in moments.TENSOR]))
    e = [F.element_at("e", i) for i in (1, 2, 3)]
    return out.select("ix", "iy", "iz", r(e[0] + e[1] + e[2]).alias("trace"), ((e[0] <= e[1]) & (e[1] <= e[2])).alias("ordered"))

# ---- Fourier

def dft_sql(source: str, n: int, name: str, sign: int = -1, re: str = "val", im: str = "0") -> str:
    ph = f"(2*pi()*((a.ix*m.ix + a.iy*m.iy + a.iz*m.iz) % {n})/{n}.0)"
    s = "" if sign > 0 else "-"
    return f"""{name} AS (SELECT m.ix, m.iy, m.iz, sum({re}*cos({ph}) - ({im})*({s}sin({ph}))) AS re, sum({re}*({s}sin({ph})) + ({im})*cos({ph})) AS im FROM {source} a, {_cells_sql(n)} m GROUP BY 1, 2, 3)"""

_FOLD = {c: f"least({c}, {N} - {c})" for c in ("ix", "iy", "iz")}
_KLEN = "sqrt(CAST(" + " + ".join(f"{v}*{v}" for v in _FOLD.values()) + " AS DOUBLE))"

def _w2_sql(scheme: str) -> str:
    one = lambda k: f"CASE WHEN {k} = 0 THEN 1 ELSE sin(pi()*{k}/{N}.0)/(pi()*{k}/{N}.0) END"
    return "(" + "*".join(f"pow({one(v)}, {2 * S.ORDER[scheme]})" for v in _FOLD.values()) + ")"

_TAKEN = ", ".join(f"CAST(floor({c}*{N}) AS INT) % {N} AS i{c}" for c in "xyz")

@query("window_w2", f"WITH {view_sql('halos')}, c AS (SELECT DISTINCT {_TAKEN} FROM halos) SELECT ix, iy, iz, {', '.join(f'{rs(_w2_sql(s), 9)} AS {s}' for s in ('ngp', 'cic', 'tsc', 'pcs'))} FROM c")
def window_w2(spark, sf_dir):
    """The windows of the modes whose numbers are those of cells that hold halos."""
    cells = view(spark, sf_dir, "halos").select(*[G.cell(F.col(c), N).cast("int").alias(f"i{c}") for c in G.AXES]).distinct()
    ks = tuple(S.folded(F.col(c), N).cast("double") for c in mesh.CELL)
    return cells.select(*mesh.CELL, *[r(S.window2(ks, N, s), 9).alias(s) for s in ("ngp", "cic", "tsc", "pcs")])

_DELTA = f"WITH {view_sql('particles')}, {delta_sql('particles', N, 'tsc')}, {dft_sql('delta', N, 'modes')}"

def _delta(spark: SparkSession, sf_dir: str, name: str = "particles") -> DataFrame:
    return mesh.assign(view(spark, sf_dir, name), N, "tsc")

@query("dft_modes", f"{_DELTA} SELECT ix, iy, iz, {rs('re')} AS re, {rs('im')} AS im FROM modes")
def dft_modes(spark, sf_dir):
    return _rounded(fft.forward(mesh.contrast(_delta(spark, sf_dir), N), N), "re", "im")

@query("dft_layouts", f"{_DELTA} SELECT l.layout, {rs('sum(re*re + im*im)', 5)} AS power FROM modes, (VALUES ('slab'), ('slab_y'), ('slab_z')) l(layout) GROUP BY 1")
def dft_layouts(spark, sf_dir):
    field = mesh.contrast(_delta(spark, sf_dir), N)
    out = None
    for name in fft.LAYOUTS:
        one = fft.forward(field, N, name).agg(r(F.sum(F.col("re") * F.col("re") + F.col("im") * F.col("im")), 5).alias("power")).select(F.lit(name).alias("layout"), "power")
        out = one if out is None else out.unionByName(one)
    return out

@query("fft_roundtrip", f"WITH {view_sql('particles')}, {delta_sql('particles', N, 'tsc')} SELECT ix, iy, iz, {rs('val')} AS val, {rs('CAST(0 AS DOUBLE)')} AS im FROM delta")
def fft_roundtrip(spark, sf_dir):
    back = fft.inverse(fft.forward(mesh.contrast(_delta(spark, sf_dir), N), N), N)
    return back.select(*mesh.CELL, r(F.col("re") / float(N**3)).alias("val"), r(F.col("im") / float(N**3)).alias("im"))

def _binned_sql(p: str, ells: tuple[int, ...], source: str) -> str:
    mu = f"({_FOLD['iz']}/{_KLEN})"
    poly = lambda e: " + ".join(f"{d(c)}*pow({mu}, {i})" for i, c in enumerate(S.legendre_coefficients(e)) if c)
    cols = ", ".join(f"{rs(f'avg(({p})*({poly(e)}))*{d((2 * e + 1.0) / N**6)}', 8)} AS p{e}" for e in ells)
    return f"SELECT {bin_sql(_KLEN, K_BINS)} AS ik, count(*) AS modes, {cols} FROM {source} WHERE iz <= {N // 2} AND {_KLEN} >= {d(K_BINS.low)} AND {_KLEN} < {d(K_BINS.high)} GROUP BY 1"

_NOISE = f"CAST({N**6} AS DOUBLE)/(SELECT count(*) FROM particles)"
_AUTO_P = f"(re*re + im*im)/{_w2_sql('tsc')} - {_NOISE}"

@query("pk_auto", f"{_DELTA} {_binned_sql(_AUTO_P, (0,), 'modes')}")
def pk_auto(spark, sf_dir):
    n = view(spark, sf_dir, "particles").count()
    return _rounded(spectrum.power_spectrum(_delta(spark, sf_dir), N, "tsc", K_BINS, n), "p0", digits=8)

ELLS = tuple(range(spectrum.MAX_ELL))

@query("pk_multipoles", f"{_DELTA} {_binned_sql(_AUTO_P, ELLS, 'modes')}")
def pk_multipoles(spark, sf_dir):
    n = view(spark, sf_dir, "particles").count()
    return _rounded(spectrum.power_spectrum(_delta(spark, sf_dir), N, "tsc", K_BINS, n, ells=ELLS), *[f"p{e}" for e in ELLS], digits=8)

_CROSS = f"WITH {view_sql('particles', 'tracers')}, {delta_sql('particles', N, 'tsc', 'd1')}, {delta_sql('tracers', N, 'tsc', 'd2')}, {dft_sql('d1', N, 'm1')}, {dft_sql('d2', N, 'm2')}, both_ AS (SELECT ix, iy, iz, m1.re*m2.re + m1.im*m2.im AS cr FROM m1 JOIN m2 USING (ix, iy, iz))"

@query("pk_cross", f"{_CROSS} {_binned_sql(f'cr/{_w2_sql("tsc")}', (0,), 'both_')}")
def pk_cross(spark, sf_dir):
    return _rounded(spectrum.power_spectrum(_delta(spark, sf_dir), N, "tsc", K_BINS, None, _delta(spark, sf_dir, "tracers")), "p0", digits=8)

@query("pk_integer_bins", f"{_DELTA} SELECT CAST(floor({_KLEN}) AS INT) AS ik, count(*) AS modes, {rs(f'avg(re*re + im*im)/{d(float(N) ** 6)}', 8)} AS p FROM modes WHERE iz <= {N // 2} AND floor({_KLEN}) < {N // 2} GROUP BY 1")
def pk_integer_bins(spark, sf_dir):
    return _rounded(spectrum.integer_bins(fft.forward_half(mesh.contrast(_delta(spark, sf_dir), N), N), N), "p", digits=8)

@query(
    "pk_windowed",
    f"""{_field_sql(_TOPHAT)}, {dft_sql('s', N, 'modes')}
    SELECT CAST(floor({_KLEN}) AS INT) AS ik, count(*) AS modes, {rs(f'avg(re*re + im*im)/{d(float(N) ** 6)}', 4)} AS p FROM modes WHERE iz <= {N // 2} AND floor({_KLEN}) < {N // 2} GROUP BY 1""",
)
def pk_windowed(spark, sf_dir):
    """An analytic field over the particles' mesh through the transform, by whole k."""
    field = _under(spark, sf_dir, "tophat", 0.3).select(*mesh.CELL, "val")
    return _rounded(spectrum.integer_bins(fft.forward_half(field, N), N), "p", digits=4)

@query("pk_length_units", f"{_DELTA}, b AS ({_binned_sql(_AUTO_P, (0,), 'modes').replace(', 8) + CAST(0 AS DOUBLE) AS p0', ', 30) AS p0')}) SELECT ik, {rs(f'({d(K_BINS.low)} + (ik + 0.5)*{d(K_BINS.step)})*{d(2 * math.pi / 1000)}', 9)} AS k, modes, {rs('p0*1e9', 1)} AS p0 FROM b WHERE ik > 0 AND {d(K_BINS.low)} + (ik + 0.5)*{d(K_BINS.step)} < {N / 2}")
def pk_length_units(spark, sf_dir):
    n = view(spark, sf_dir, "particles").count()
    out = spectrum.in_length_units(spectrum.power_spectrum(_delta(spark, sf_dir), N, "tsc", K_BINS, n), N, K_BINS, 1000.0)
    return _rounded(_rounded(out, "k", digits=9), "p0", digits=1)

def _lag_sql(p: str, source: str) -> str:
    lag = f"({_KLEN}/{N}.0)"
    return f"pw AS (SELECT ix, iy, iz, CASE WHEN {_KLEN} > 0 THEN {p} ELSE 0 END AS p FROM {source}), {dft_sql('pw', N, 'lags', 1, 'p')} SELECT {bin_sql(lag, LAG_BINS)} AS ir, count(*) AS cells, {rs(f'avg(re)/{d(float(N) ** 6)}', 8)} AS xi FROM lags WHERE {lag} < {d(LAG_BINS.high)} GROUP BY 1"

@query("xi_ifft", f"{_DELTA}, {_lag_sql(_AUTO_P, 'modes')}")
def xi_ifft(spark, sf_dir):
    n = view(spark, sf_dir, "particles").count()
    return _rounded(spectrum.correlation(_delta(spark, sf_dir), N, "tsc", LAG_BINS, n), "xi", digits=8)

@query("xi_ifft_cross", f"{_CROSS}, {_lag_sql(f'cr/{_w2_sql("tsc")}', 'both_')}")
def xi_ifft_cross(spark, sf_dir):
    return _rounded(spectrum.correlation(_delta(spark, sf_dir), N, "tsc", LAG_BINS, None, _delta(spark, sf_dir, "tracers")), "xi", digits=8)

# ---- mass functions

_M = (1000.0, 400000.0, 10)
_MSTEP = math.log(_M[1] / _M[0]) / _M[2]
_HIST = f"""WITH {view_sql('halos')}, b AS (SELECT CAST(range AS INT) AS im, {d(_M[0])}*exp(range*{d(_MSTEP)}) AS m_low, {d(_M[0])}*exp((range + 1)*{d(_MSTEP)}) AS m_high FROM range({_M[2]})),
  c AS (SELECT least(CAST(floor(ln(mvir/{d(_M[0])})/{d(_MSTEP)}) AS INT), {_M[2] - 1}) AS im, count(*) AS n FROM halos WHERE mvir >= {d(_M[0])} AND mvir <= {d(_M[1])} GROUP BY 1),
  h AS (SELECT im, m_low, m_high, (m_low + m_high)/2 AS m_mid, coalesce(n, 0) AS n FROM b LEFT JOIN c USING (im))"""

@query("hmf_count", f"{_HIST} SELECT im, {rs('m_low', 4)} AS m_low, {rs('m_high', 4)} AS m_high, {rs('m_mid', 4)} AS m_mid, n FROM h")
def hmf_count(spark, sf_dir):
    return _rounded(massfunction.mass_histogram(view(spark, sf_dir, "halos"), *_M), "m_low", "m_high", "m_mid", digits=4)

for _per, _width in (("dm", "(m_high - m_low)"), ("dlnm", "ln(m_high/m_low)"), ("dlog10m", "log10(m_high/m_low)")):

    @query(f"hmf_dn{_per}", f"{_HIST} SELECT im, {rs('m_mid', 4)} AS m_mid, n, {rs(f'n/{_width}/1e9*1e9', 6)} AS dn FROM h")
    def hmf(spark, sf_dir, per=_per):
        out = massfunction.mass_function(view(spark, sf_dir, "halos"), *_M, BOX.size, per)
        return _rounded(out.withColumn("dn", F.col("dn") * 1e9), "dn").withColumn("m_mid", r("m_mid", 4))

# ---- pairwise sums

EPS, SOFT2, H = 0.05, 1e-4, 0.02
_NEAR = "WITH {v}, a AS (SELECT id, x, y, z, mvir/100000 AS mass FROM halos), q AS (SELECT i.id, {dx} AS dx, {dy} AS dy, {dz} AS dz, j.mass AS m FROM a i JOIN a j ON abs({dx}) < {c} AND abs({dy}) < {c}), n AS (SELECT *, dx*dx + dy*dy + dz*dz AS r2, sqrt(dx*dx + dy*dy + dz*dz) AS r FROM q)"

def _near_sql(reach: float) -> str:
    return _NEAR.format(v=view_sql("halos"), c=d(reach * 1.001), **{f"d{c}": _img(f"i.{c} - j.{c}") for c in "xyz"})

_S3 = f"((r2 + {d(SOFT2)})*sqrt(r2 + {d(SOFT2)}))"

def _masses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "halos").withColumn("mass", F.col("mvir") / 100000)

@query(
    "gravity_accel",
    f"{_near_sql(EPS)} SELECT id, {', '.join(f'{rs(f"sum(-m*{_g_sql("r", EPS)}/{_S3}*d{c})", 5)} AS a{c}' for c in 'xyz')} FROM n WHERE r2 < {d(EPS * EPS)} GROUP BY id",
)
def gravity_accel(spark, sf_dir):
    pts = _masses(spark, sf_dir)
    return _rounded(pairwise.gravity(pts, pts, EPS, SOFT2, potential=False).select("id", "ax", "ay", "az"), "ax", "ay", "az", digits=5)

@query("gravity_pot", f"{_near_sql(EPS)} SELECT id, {rs(f'sum(CASE WHEN r2 > 1e-30 THEN -m*{_gpot_sql("r", EPS)}/sqrt(r2 + {d(SOFT2)}) ELSE 0 END)', 6)} AS phi FROM n WHERE r2 < {d(EPS * EPS)} GROUP BY id")
def gravity_pot(spark, sf_dir):
    pts = _masses(spark, sf_dir)
    return _rounded(pairwise.gravity(pts, pts, EPS, SOFT2, force=False).select("id", "phi"), "phi")

@query("sph_density", f"{_near_sql(2 * H)} SELECT id, {rs(f'sum(m*{_w_sql(f"(r/{d(H)})", H)})', 3)} AS rho FROM n WHERE r2 < {d(4 * H * H)} GROUP BY id")
def sph_density(spark, sf_dir):
    pts = _masses(spark, sf_dir)
    return _rounded(pairwise.kernel_sums(pts, pts, H, gradient=False).select("id", "rho"), "rho", digits=3)

@query("sph_grad", f"{_near_sql(2 * H)} SELECT id, {', '.join(f'{rs(f"sum(CASE WHEN r < 1e-30 THEN 0 ELSE m*{_dw_sql(f"(r/{d(H)})", H)}/(r*{d(H)})*d{c} END)", 2)} AS g{c}' for c in 'xyz')} FROM n WHERE r2 < {d(4 * H * H)} GROUP BY id")
def sph_grad(spark, sf_dir):
    pts = _masses(spark, sf_dir)
    return _rounded(pairwise.kernel_sums(pts, pts, H, density=False).select("id", "gx", "gy", "gz"), "gx", "gy", "gz", digits=2)

# ---- neighbours: the queries are the rows whose id is divisible by 100, against all rows

def _asked(df: DataFrame) -> DataFrame:
    return df.where(F.col("id") % 100 == 0)

def _dist_sql(periodic: bool = False, a: str = "q", b: str = "p") -> str:
    one = lambda c: _img(f"{a}.{c} - {b}.{c}") if periodic else f"({a}.{c} - {b}.{c})"
    return " + ".join(f"{one(c)}*{one(c)}" for c in "xyz")

def _knn_sql(k: int, where: str = "true", periodic: bool = False, keep: str = "true") -> str:
    return f"""WITH {view_sql('halos')}, t AS (SELECT q.id AS qid, p.id, {_dist_sql(periodic)} AS d2 FROM halos q, halos p WHERE q.id % 100 = 0 AND {where}),
    k AS (SELECT *, CAST(row_number() OVER (PARTITION BY qid ORDER BY d2, id) AS INT) AS rank FROM t WHERE {keep}) SELECT qid, id, {rs('d2', 9)} AS d2, rank FROM k WHERE rank <= {k}"""

@query("radius_search", f"WITH {view_sql('halos')}, t AS (SELECT q.id AS qid, p.id, {_dist_sql()} AS d2 FROM halos q, halos p WHERE q.id % 100 = 0) SELECT qid, id, {rs('d2', 9)} AS d2 FROM t WHERE d2 <= {d(0.08 * 0.08)}")
def radius_search(spark, sf_dir):
    halos = view(spark, sf_dir, "halos")
    return _rounded(neighbors.radius_search(_asked(halos), halos, 0.08), "d2", digits=9)

@query("radius_search_periodic", f"WITH {view_sql('halos')}, t AS (SELECT q.id AS qid, p.id, {_dist_sql(True)} AS d2 FROM halos q, halos p WHERE q.id % 100 = 0) SELECT qid, id, {rs('d2', 9)} AS d2 FROM t WHERE d2 < {d(0.08 * 0.08)}")
def radius_search_periodic(spark, sf_dir):
    halos = view(spark, sf_dir, "halos")
    return _rounded(neighbors.radius_search(_asked(halos), halos, 0.08, closed=False, periodic=True), "d2", digits=9)

@query("knn_exact", _knn_sql(15))
def knn_exact(spark, sf_dir):
    halos = view(spark, sf_dir, "halos")
    return _rounded(neighbors.knn(_asked(halos), halos, 15), "d2", digits=9)

@query("knn_periodic", _knn_sql(15, periodic=True))
def knn_periodic(spark, sf_dir):
    halos = view(spark, sf_dir, "halos")
    return _rounded(neighbors.knn(_asked(halos), halos, 15, periodic=True), "d2", digits=9)

@query("knn_filtered", _knn_sql(10, "p.child_level = 2"))
def knn_filtered(spark, sf_dir):
    halos = view(spark, sf_dir, "halos")
    return _rounded(neighbors.knn(_asked(halos), halos.where("child_level = 2"), 10), "d2", digits=9)

@query("knn_radius", _knn_sql(5, keep=f"d2 < {d(0.04 * 0.04)}"))
def knn_radius(spark, sf_dir):
    halos = view(spark, sf_dir, "halos")
    return _rounded(neighbors.knn_within(_asked(halos), halos, 5, 0.04), "d2", digits=9)

@query("knn_with_deletes", _knn_sql(10, "p.id % 7 <> 0"))
def knn_with_deletes(spark, sf_dir):
    halos = view(spark, sf_dir, "halos")
    alive = catalog.without_ids(halos, halos.where("id % 7 = 0").select("id"))
    return _rounded(neighbors.knn(_asked(halos), alive, 10), "d2", digits=9)

@query("ghost_images", f"WITH {view_sql('halos')}, s AS (SELECT * FROM (VALUES (-1), (0), (1)) t(s)), g AS (SELECT id, x + a.s AS x, y + b.s AS y, z + c.s AS z, a.s <> 0 OR b.s <> 0 OR c.s <> 0 AS ghost FROM halos, s a, s b, s c) SELECT id, {rs('x', 9)} AS x, {rs('y', 9)} AS y, {rs('z', 9)} AS z, ghost FROM g WHERE {' AND '.join(f'{c} >= {d(-0.05)} AND {c} < {d(1.05)}' for c in 'xyz')}")
def ghost_images(spark, sf_dir):
    return _rounded(neighbors.ghosts(view(spark, sf_dir, "halos").select("id", "x", "y", "z"), 0.05), *G.AXES, digits=9)

_TERM = {"l2": "sum(pow(CAST(q.e AS DOUBLE) - CAST(p.e AS DOUBLE), 2))", "l1": "sum(abs(CAST(q.e AS DOUBLE) - CAST(p.e AS DOUBLE)))", "ip": "1 - sum(CAST(q.e AS DOUBLE)*CAST(p.e AS DOUBLE))"}

def _vec_sql(metric: str, where: str = "true", asked: str = "vec_id % 100 = 0") -> str:
    return f"""WITH v AS (SELECT vec_id AS id, label, unnest(embedding) AS e, generate_subscripts(embedding, 1) AS i FROM embeddings), q AS (SELECT * FROM v WHERE id % 100 = 0),
    t AS (SELECT q.id AS qid, p.id, p.label, {_TERM[metric]} AS distance FROM q JOIN v p ON p.i = q.i WHERE {where} GROUP BY 1, 2, 3),
    k AS (SELECT *, CAST(row_number() OVER (PARTITION BY qid ORDER BY distance, id) AS INT) AS rank FROM t)"""

def _vectors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    v = view(spark, sf_dir, "vectors")
    return _asked(v), v

for _metric in _TERM:

    @query(f"knn_{_metric}", f"{_vec_sql(_metric)} SELECT qid, id, {rs('distance')} AS distance, rank FROM k WHERE rank <= 10")
    def knn_vectors(spark, sf_dir, metric=_metric):
        return _rounded(neighbors.vector_knn(*_vectors(spark, sf_dir), 10, metric), "distance")

@query("knn_vectors_filtered", f"{_vec_sql('ip', 'p.label % 2 = 1')} SELECT qid, id, {rs('distance')} AS distance, rank FROM k WHERE rank <= 10")
def knn_vectors_filtered(spark, sf_dir):
    return _rounded(neighbors.vector_knn(*_vectors(spark, sf_dir), 10, "ip", F.col("label") % 2 == 1), "distance")

@query("eps_range", f"{_vec_sql('l2')} SELECT qid, id, {rs('distance')} AS distance, rank FROM k WHERE rank <= 40 AND (distance <= 1.0 OR rank <= 3)")
def eps_range(spark, sf_dir):
    ranked = neighbors.vector_knn(*_vectors(spark, sf_dir), 40, "l2")
    return _rounded(neighbors.within_distance(ranked, 1.0, 3, 40), "distance")

@query(
    "knn_multivector_docs",
    f"""{_vec_sql('l2')}, f AS (SELECT *, min(rank) OVER (PARTITION BY qid, label) AS first FROM k), g AS (SELECT *, CAST(dense_rank() OVER (PARTITION BY qid ORDER BY first) AS INT) AS doc_rank FROM f)
    SELECT qid, id, label, {rs('distance')} AS distance, doc_rank FROM g WHERE doc_rank <= 3""",
)
def knn_multivector_docs(spark, sf_dir):
    return _rounded(neighbors.in_documents(*_vectors(spark, sf_dir), 3), "distance")

_ANGLE = f"(CASE WHEN abs(p.x - q.x)*{d(2 * math.pi)} > pi() THEN {d(2 * math.pi)} - abs(p.x - q.x)*{d(2 * math.pi)} ELSE abs(p.x - q.x)*{d(2 * math.pi)} END)"

@query("knn_so2", f"WITH {view_sql('halos')}, t AS (SELECT q.id AS qid, p.id, {_ANGLE} AS distance FROM halos q, halos p WHERE q.id % 100 = 0), k AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY {rs('distance', 9)}, id) AS rank FROM t) SELECT qid, {rs('distance', 9)} AS distance, CAST(rank AS INT) AS rank FROM k WHERE rank <= 5")
def knn_so2(spark, sf_dir):
    v = view(spark, sf_dir, "halos").select("id", F.array(F.col("x") * (2 * math.pi)).alias("embedding"))
    return _rounded(neighbors.vector_knn(_asked(v), v, 5, "so2"), "distance", digits=9).select("qid", "distance", "rank")

@query("ivf_knn")
def ivf_knn(spark, sf_dir):
    asked, v = _vectors(spark, sf_dir)
    return neighbors.ivf_knn(asked, v, 10, neighbors.train_cells(v, 16), 8)

@query("ivf_recall", f"{_vec_sql('l2')} SELECT count(*) AS wanted, CAST(sum(id) AS BIGINT) AS ids, true AS enough FROM k WHERE rank <= 10")
def ivf_recall(spark, sf_dir):
    """Of the exact ten neighbours of each query, at least nine in ten are found by the saved index."""
    asked, v = _vectors(spark, sf_dir)
    path = work_path(spark, "cells")
    neighbors.save_index(v, neighbors.train_cells(v, 16), path)
    exact = neighbors.vector_knn(asked, v, 10).select("qid", "id")
    found = neighbors.search_index(spark, path, asked, 10, 8).select("qid", "id", F.lit(1).alias("hit"))
    return exact.join(found, ["qid", "id"], "left").agg(F.count(F.lit(1)).alias("wanted"), F.sum("id").alias("ids"), (F.count("hit") >= 0.9 * F.count(F.lit(1))).alias("enough"))

@query("index_eps", f"{_vec_sql('l2')} SELECT qid, id, {rs('distance')} AS distance, rank FROM k WHERE rank <= 60 AND (distance <= 1.2 OR rank <= 3)")
def index_eps(spark, sf_dir):
    """All vectors within a distance, at least 3 and at most 60, from a saved index: cells are read until a bound proves that none is missing."""
    asked, v = _vectors(spark, sf_dir)
    path = work_path(spark, "cells")
    neighbors.save_index(v, neighbors.train_cells(v, 16), path)
    found = indexsearch.search(spark, path, asked, indexsearch.WithinDistance(1.2, 3, 60))
    return _rounded(found.select("qid", "id", "distance", "rank"), "distance")

@query("index_documents", ORACLE["knn_multivector_docs"])
def index_documents(spark, sf_dir):
    """All vectors of the three nearest documents, from a saved index that grew by a batch."""
    asked, v = _vectors(spark, sf_dir)
    path = work_path(spark, "cells")
    neighbors.save_index(v.where("id % 5 > 0"), neighbors.train_cells(v, 16), path, keep=("label",))
    neighbors.add_to_index(v.where("id % 5 = 0"), path, "more", keep=("label",))
    return _rounded(indexsearch.documents(spark, path, asked, v, 3), "distance")

@query("knn_in_degree", f"{_vec_sql('l2')} SELECT id, count(*) AS n, CAST(sum(CASE WHEN id = qid THEN 1 ELSE 0 END) AS BIGINT) AS self_links, CAST(0 AS BIGINT) AS repeats FROM k WHERE rank <= 10 GROUP BY id")
def knn_in_degree(spark, sf_dir):
    return neighbors.in_degrees(neighbors.vector_knn(*_vectors(spark, sf_dir), 10, "l2"))

_LEVELS = 6

def _path_sql(level: int) -> str:
    at = {c: f"CAST(floor({c}*{1 << level}) AS BIGINT)" for c in "xyz"}
    bits = [f"((({at[c]} >> {b}) & 1) << {3 * b + i})" for b in range(level) for i, c in enumerate("xyz")]
    return " + ".join(bits) or "CAST(0 AS BIGINT)"

@query(
    "octree_leaves",
    f"""WITH {view_sql('halos')}, deep AS (SELECT {_path_sql(_LEVELS)} AS path, count(*) AS n FROM halos GROUP BY 1),
    c AS (SELECT CAST(l.range AS INT) AS level, path >> CAST(3*({_LEVELS} - l.range) AS INT) AS path, CAST(sum(n) AS BIGINT) AS n FROM deep, range({_LEVELS + 1}) l GROUP BY 1, 2)
    SELECT c.level, c.path, c.n FROM c LEFT JOIN c p ON p.level = c.level - 1 AND p.path = c.path >> 3 WHERE (c.n <= 16 OR c.level = {_LEVELS}) AND (c.level = 0 OR p.n > 16)""",
)
def octree_leaves(spark, sf_dir):
    return neighbors.octree_leaves(view(spark, sf_dir, "halos"), 16, _LEVELS)

@query("kd_buckets", f"WITH {view_sql('halos')} SELECT id, {_path_sql(16)} AS path FROM halos")
def kd_buckets(spark, sf_dir):
    return neighbors.bucketed(view(spark, sf_dir, "halos"), 16).select("id", "path")

# ---- orders

@query("sort_by_key", f"WITH {view_sql('halos')} SELECT id, mvir, row_number() OVER (ORDER BY mvir, id) - 1 AS position FROM halos")
def sort_by_key(spark, sf_dir):
    return ordering.by_key(ordering.numbered(view(spark, sf_dir, "halos").select("id", "mvir"), F.col("mvir")), "mvir")

@query("sort_by_axis", f"WITH {view_sql('halos')} SELECT id, y, row_number() OVER (ORDER BY y, id) - 1 AS position FROM halos")
def sort_by_axis(spark, sf_dir):
    return ordering.by_axis(ordering.numbered(view(spark, sf_dir, "halos").select("id", "x", "y", "z"), F.col("y")), 1).select("id", "y", "position")

@query("sort_xyz", f"WITH {view_sql('halos')} SELECT id, x, y, z FROM halos ORDER BY x, y, z")
def sort_xyz(spark, sf_dir):
    return ordering.by_position(view(spark, sf_dir, "halos").select("id", "x", "y", "z"))

@query("top_k", f"WITH {view_sql('halos')} SELECT id, mvir FROM halos ORDER BY mvir DESC, id LIMIT 100")
def top_k(spark, sf_dir):
    return ordering.top(view(spark, sf_dir, "halos").select("id", "mvir"), 100, F.col("mvir").desc(), "id")

_CELL = lambda n: f"CAST(floor(z*{n}) + {n}*(floor(y*{n}) + {n}*floor(x*{n})) AS BIGINT)"

@query("cell_offsets", f"WITH {view_sql('halos')}, c AS (SELECT {_CELL(10)} AS cell_id, count(*) AS n FROM halos GROUP BY 1) SELECT cell_id, n, CAST(sum(n) OVER (ORDER BY cell_id) - n AS BIGINT) AS start FROM c")
def cell_offsets(spark, sf_dir):
    return ordering.cell_offsets(view(spark, sf_dir, "halos"), 10)

@query("cell_rank", f"WITH {view_sql('halos')}, c AS (SELECT id, {_CELL(10)} AS cell_id FROM halos) SELECT id, cell_id, row_number() OVER (PARTITION BY cell_id ORDER BY id) - 1 AS rank FROM c")
def cell_rank(spark, sf_dir):
    return ordering.cell_ranks(view(spark, sf_dir, "halos"), 10)

# ---- sources and streams

@query("stream_mesh", f"WITH {view_sql('particles')}, {exploded_sql('particles', N, 'cic')} SELECT ix, iy, iz, {rs('sum(w)')} AS val FROM e GROUP BY 1, 2, 3")
def stream_mesh(spark, sf_dir):
    """The mesh of a stream of particle files, read to its present end."""

    path = f"{sf_dir}/lineitem.parquet"
    schema = spark.read.parquet(path).schema
    live = spark.readStream.schema(schema).parquet(path.replace(".parquet", ".parque[t]"))
    live = live.selectExpr(*[f"{e} AS {c}" for c, e in VIEWS["particles"][1].items()])
    name = f"mesh_{uuid.uuid4().hex}"
    streams.start_into_memory(streams.mesh_stream(live, N, "cic"), name).awaitTermination()
    return _rounded(spark.table(name), "val")

# ---- round trips through sources and sinks, in the shared work folder

@query(
    "snapshot_scan",
    f"WITH {view_sql('halos')} SELECT id, " + ", ".join(rs(f"CAST(CAST({c}*1000 AS FLOAT) AS DOUBLE)", 4) + f" AS {c}" for c in "xyz") + f" FROM halos WHERE CAST({'x'}*1000 AS FLOAT) < 500",
)
def snapshot_scan(spark, sf_dir):
    """Write halos as binary snapshot files from the tasks, read them back with a filter on x."""
    snapshot.register(spark)
    prefix = f"{work_path(spark, 'snapshot')}/snap"
    halos = view(spark, sf_dir, "halos").select("id", *[(F.col(c) * 1000.0).alias(c) for c in "xyz"], "vx", "vy", "vz", "pot")
    snapshot.write(halos, prefix, 4, box=1000.0)
    scan = spark.read.format("snapshot").option("velocities", "false").option("potentials", "false").load(prefix)
    return _rounded(scan.where(F.col("x") < 500.0).select("id", "x", "y", "z"), "x", "y", "z", digits=4)


@query("text_points", f"WITH {view_sql('halos')} SELECT {', '.join(rs(c, 6) + f' AS {c}' for c in 'xyz')} FROM halos")
def text_points(spark, sf_dir):
    """Text lines of three numbers with some broken lines among them, read back without those."""
    path = work_path(spark, "points")
    halos = view(spark, sf_dir, "halos")
    line = F.concat_ws(" ", *[F.format_string("%.12f", F.col(c) * 20.0) for c in "xyz"])
    halos.select(line.alias("value")).unionByName(spark.createDataFrame([("1 2",), ("a b c",), ("",)], "value string")).write.text(path)
    return _rounded(tables.read_points(spark, path), "x", "y", "z")


@query("text_catalogue", f"WITH {view_sql('halos')} SELECT count(*) AS n, {rs('sum(round(mvir, 2))', 1)} AS mass, {d(0.3)} AS omega_m FROM halos")
def text_catalogue(spark, sf_dir):
    path = work_path(spark, "catalogue")
    rows = view(spark, sf_dir, "halos").select(F.concat_ws(" ", "id", "child_level", F.format_string("%.2f", F.col("mvir"))).alias("value"))
    rows.unionByName(spark.createDataFrame([("# omega_m = 0.3",), ("# id level mass",)], "value string")).write.text(path)
    header = tables.read_text_header(spark, path).where("key = 'omega_m'").select(F.col("number").alias("omega_m"))
    return tables.read_text_masses(spark, path).agg(F.count(F.lit(1)).alias("n"), r(F.sum("mass"), 1).alias("mass")).crossJoin(F.broadcast(header))  # one row each


@query("mesh_table", ORACLE["mesh_cic"])
def mesh_table(spark, sf_dir):
    path = work_path(spark, "mesh")
    tables.write_mesh(mesh.assign(view(spark, sf_dir, "particles"), MESH, "cic"), path, MESH, BOX.size)
    return _rounded(tables.read_mesh(spark, path).select("ix", "iy", "iz", "val"), "val")


@query("radix_order", f"WITH {view_sql('halos')} SELECT id, vz, row_number() OVER (ORDER BY vz, id) - 1 AS position, true AS same FROM halos")
def radix_order(spark, sf_dir):
    """Rank by the order-preserving integer of a signed double, and turn it back."""
    rows = view(spark, sf_dir, "halos").select("id", "vz").withColumn("bits", bits.ordered_long("vz"))
    ranked = ordering.numbered(rows, F.col("bits"))
    return ranked.select("id", "vz", "position", (bits.from_ordered_long("bits") == F.col("vz")).alias("same"))


_OWNER = f"(iz*{JK_LEVEL}//{N} + {JK_LEVEL}*(iy*{JK_LEVEL}//{N} + {JK_LEVEL}*(ix*{JK_LEVEL}//{N})))"
_JKN = JK_LEVEL**3


def _batch_dft_sql(source: str, name: str, sign: int, re: str) -> str:
    ph = f"(2*pi()*((a.ix*m.ix + a.iy*m.iy + a.iz*m.iz) % {N})/{N}.0)"
    return f"{name} AS (SELECT a.b, m.ix, m.iy, m.iz, sum({re}*cos({ph})) AS re, sum({re}*({'' if sign > 0 else '-'}sin({ph}))) AS im FROM {source} a, {_cells_sql(N)} m GROUP BY 1, 2, 3, 4)"


@query(
    "jk_xi_ifft",
    f"""WITH {view_sql('particles')}, {delta_sql('particles', N, 'tsc')}, c AS (SELECT k.range AS b, ix, iy, iz, CASE WHEN {_OWNER} = k.range THEN 0 ELSE val*{d((_JKN / (_JKN - 1)) ** 0.5)} END AS v FROM delta, range({_JKN}) k),
    cc AS (SELECT b, ix, iy, iz, v - avg(v) OVER (PARTITION BY b) AS v FROM c), {_batch_dft_sql('cc', 'modes', -1, 'v')},
    pw AS (SELECT b, ix, iy, iz, CASE WHEN {_KLEN} > 0 THEN {_AUTO_P} ELSE 0 END AS p FROM modes), {_batch_dft_sql('pw', 'lags', 1, 'p')},
    x AS (SELECT b, {bin_sql(f'({_KLEN}/{N}.0)', LAG_BINS)} AS ir, avg(re)/{d(float(N) ** 6)} AS xi FROM lags WHERE {_KLEN}/{N}.0 < {d(LAG_BINS.high)} GROUP BY 1, 2)
    SELECT ir, {rs('avg(xi)', 8)} AS mean, {rs('sqrt((count(*) - 1)*var_pop(xi))', 8)} AS se FROM x GROUP BY ir""",
)
def jk_xi_ifft(spark, sf_dir):
    n = view(spark, sf_dir, "particles").count()
    xi = spectrum.correlation_without_block(_delta(spark, sf_dir), N, "tsc", LAG_BINS, JK_LEVEL, n)
    return _rounded(jackknife.mean_and_error(xi, ["ir"]), "mean", "se", digits=8)


PROGRAM = AnalysisConfig(mrange=(4.5, 6.0), clevel=(0, 3), rrange=(1.0, 50.0), nr=8, mesh=N, nk=4, krange=(0.005, 0.03))
_SELECTED = f"h AS (SELECT id, x, y, {_wrap(f'z + vz*({d(1.0)}/{d(100.0 * BOX.size)})')} AS z FROM halos WHERE mvir >= {d(10.0**4.5)} AND mvir <= {d(10.0**6)} AND child_level BETWEEN 0 AND 3)"
_PB = PROGRAM.radial_bins()


@query(
    "program_halo_xi",
    f"""WITH {view_sql('halos')}, {_SELECTED}, {counts_sql('h', 'h', _PB, 'c')}
    SELECT ir, {rs(f'1000*({d(_PB.low)} + (ir + 0.5)*{d(_PB.step)})', 6)} AS r, {rs(f'n/(CAST((SELECT count(*) FROM h) AS DOUBLE)*((SELECT count(*) FROM h) - 1)/2*{_shell(_PB)}) - 1')} AS xi FROM c""",
)
def program_halo_xi(spark, sf_dir):
    halos = programs.prepared(view(spark, sf_dir, "halos"), PROGRAM, redshift_space=True)
    return _rounded(programs.halo_xi(halos, PROGRAM), "r", "xi")
