"""More registered queries: whole programs, estimators of two catalogues, jackknife forms and round trips of results."""

from __future__ import annotations

import math
import uuid
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nebulark.config import AnalysisConfig, RadialBins, SpspBins
from nebulark.functions import bits
from nebulark.operators import catalog, fft, jackknife, mesh, moments, ordering, pairs, spectrum
from nebulark.plans import indexes, programs  # noqa: F401  (indexes registers its queries)
from nebulark.plans.fixtures import VIEWS, view, view_sql
from nebulark.plans.queries import (
    BOX, JK_LEVEL, JK_SLICES, K_BINS, LAG_BINS, MESH, ORACLE, PROGRAM, QUERIES, R_BINS, SMU, SPSP, N,
    _asked, _AUTO, _batch_dft_sql, _binned_sql, _cells_sql, _CROSS, _delta, _FOLD, _JK, _JKN, _KLEN, _leave_sql, _NH, _NP, _NR, _NT, _OWNER, _P, _PB, _randoms, _rounded, _SELECTED, _shell, _SIG, _SPINE2, _U, _w2_sql,
    bin_sql, counts_sql, d, delta_sql, dft_sql, exploded_sql, hash_sql, pairs_sql, query, r, rs,
)
from nebulark.plans.work import work_path
from nebulark.sources import domains, fields, snapshot, tables
from nebulark.streaming import mesh as streams

__all__ = ["ORACLE", "QUERIES"]

# ---- pairs

@query("dd_weighted", f"WITH {view_sql('halos')}, {pairs_sql('halos', 'halos', R_BINS.high, ', (a.mvir/100000)*(b.mvir/100000) AS ww')} SELECT {bin_sql('r', R_BINS)} AS ir, count(*) AS n, {rs('sum(ww)', 3)} AS w FROM p WHERE r >= {d(R_BINS.low)} AND r < {d(R_BINS.high)} GROUP BY 1")
def dd_weighted(spark, sf_dir):
    halos = view(spark, sf_dir, "halos").withColumn("weight", F.col("mvir") / 100000)
    return _rounded(pairs.weighted_r(halos, None, R_BINS), "w", digits=3)

SPSP_FULL = SpspBins(SPSP.perp, SPSP.par_high, 4, half=False)
_PAR = f"CAST(floor((dz - {d(SPSP_FULL.par_low)})/{d(SPSP_FULL.par_step)}) AS INT)"
_PERP = "sqrt(dx*dx + dy*dy)"

@query("dd_spsp_full", f"WITH {view_sql('halos')}, {pairs_sql('halos', 'halos', SPSP_FULL.reach)} SELECT {bin_sql(_PERP, SPSP.perp)} AS iperp, {_PAR} AS ipar, count(*) AS n FROM p WHERE {_PERP} >= {d(SPSP.perp.low)} AND {_PERP} < {d(SPSP.perp.high)} AND {_PAR} >= 0 AND {_PAR} < 4 GROUP BY 1, 2")
def dd_spsp_full(spark, sf_dir):
    return pairs.count_spsp(view(spark, sf_dir, "halos"), None, SPSP_FULL)

@query("xi_auto_ls_normalised", f"{_AUTO}, {counts_sql('halos', 'random_catalog', R_BINS, 'dr_')}, t AS (SELECT ir, 2.0*dd.n/({_NH}*CAST({_NH} AS DOUBLE)) AS a, CAST(dr_.n AS DOUBLE)/({_NH}*CAST({_NR} AS DOUBLE)) AS b, 2.0*rr_.n/({_NR}*CAST({_NR} AS DOUBLE)) AS c FROM dd JOIN rr_ USING (ir) JOIN dr_ USING (ir)) SELECT ir, {rs('CASE WHEN c > 0 THEN (a - b - b + c)/c ELSE 0 END')} AS xi FROM t")
def xi_auto_ls_normalised(spark, sf_dir):
    halos, random = view(spark, sf_dir, "halos"), view(spark, sf_dir, "random_catalog")
    parts = {"dd": (halos, None), "rr": (random, None), "dr": (halos, random)}
    return _normalised(parts, (halos, halos, random, random), True)

def _normalised(parts: dict, cats: tuple, auto: bool) -> DataFrame:
    table = None
    for name, (a, b) in parts.items():
        one = pairs.count_r(a, b, R_BINS).withColumnRenamed("n", name)
        table = one if table is None else table.join(one, "ir")
    return _rounded(pairs.xi_normalised(table, *[c.count() for c in cats], auto).select("ir", "xi"), "xi")

_TWO = f"WITH {view_sql('halos', 'tracers', 'random_catalog')}, random2 AS (SELECT id, y AS x, z AS y, x AS z FROM random_catalog), {counts_sql('halos', 'tracers', R_BINS, 'dd')}, {counts_sql('random_catalog', 'random2', R_BINS, 'rr_')}"
_TWO_LS = f"{_TWO}, {counts_sql('halos', 'random2', R_BINS, 'd1')}, {counts_sql('tracers', 'random_catalog', R_BINS, 'd2')}"

@query("xi_cross_ls_normalised", f"{_TWO_LS}, t AS (SELECT ir, dd.n/(CAST({_NH} AS DOUBLE)*{_NT}) AS a, d1.n/(CAST({_NH} AS DOUBLE)*{_NR}) AS b, d2.n/(CAST({_NT} AS DOUBLE)*{_NR}) AS e, rr_.n/(CAST({_NR} AS DOUBLE)*{_NR}) AS c FROM dd JOIN rr_ USING (ir) JOIN d1 USING (ir) JOIN d2 USING (ir)) SELECT ir, {rs('CASE WHEN c > 0 THEN (a - b - e + c)/c ELSE 0 END')} AS xi FROM t")
def xi_cross_ls_normalised(spark, sf_dir):
    halos, tracers, (one, two) = view(spark, sf_dir, "halos"), view(spark, sf_dir, "tracers"), _randoms(spark, sf_dir)
    return _normalised({"dd": (halos, tracers), "rr": (one, two), "d1r2": (halos, two), "d2r1": (tracers, one)}, (halos, tracers, one, two), False)

@query("xi_cross_rr", f"{_TWO} SELECT ir, dd.n AS dd, rr_.n AS rr, {rs(f'CASE WHEN rr_.n > 0 THEN (CAST({_NR} AS DOUBLE)/{_NH}*(CAST({_NR} AS DOUBLE)/{_NT})*dd.n - rr_.n)/rr_.n ELSE 0 END')} AS xi FROM dd JOIN rr_ USING (ir)")
def xi_cross_rr(spark, sf_dir):
    return _rounded(pairs.xi_cross(view(spark, sf_dir, "halos"), view(spark, sf_dir, "tracers"), R_BINS, "RR", *_randoms(spark, sf_dir)), "xi")

def _smu_of(name: str, bins) -> str:
    im = f"CAST(floor((abs(dz)/r)/{d(bins.mu_step)}) AS INT)"
    return f"SELECT {bin_sql('r', bins.r)} AS ir, {im} AS imu, count(*) AS n FROM {name} WHERE r > 0 AND r >= {d(bins.r.low)} AND r < {d(bins.r.high)} AND {im} < {bins.n_mu} GROUP BY 1, 2"

_SMU_RR = f"WITH {view_sql('halos', 'random_catalog')}, {pairs_sql('halos', 'halos', 0.05)}, {pairs_sql('random_catalog', 'random_catalog', 0.05, name='q')}, dd AS ({_smu_of('p', SMU)}), rr_ AS ({_smu_of('q', SMU)})"
_F2 = f"(CAST({_NR} AS DOUBLE)/{_NH})*(CAST({_NR} AS DOUBLE)/{_NH})"

@query("xi_smu_rr", f"{_SMU_RR} SELECT ir, imu, coalesce(dd.n, 0) AS n, rr_.n AS rr, {rs(f'{_F2}*coalesce(dd.n, 0)/rr_.n - 1')} AS xi FROM rr_ LEFT JOIN dd USING (ir, imu)")
def xi_smu_rr(spark, sf_dir):
    return _rounded(pairs.xi_smu_rr(view(spark, sf_dir, "halos"), view(spark, sf_dir, "random_catalog"), SMU), "xi")

_FRAME = f"(SELECT CAST(a.range AS INT) AS ir, CAST(b.range AS INT) AS imu FROM range({SMU.r.n}) a, range({SMU.n_mu}) b)"

@query("xi_2d_ls", f"{_SMU_RR}, {pairs_sql('halos', 'random_catalog', 0.05, name='x')}, dr_ AS ({_smu_of('x', SMU)}), t AS (SELECT ir, imu, coalesce(dd.n, 0) AS n, coalesce(rr_.n, 0) AS rr, coalesce(dr_.n, 0) AS dr FROM {_FRAME} LEFT JOIN dd USING (ir, imu) LEFT JOIN rr_ USING (ir, imu) LEFT JOIN dr_ USING (ir, imu)) SELECT ir, imu, n, rr, {rs(f'CASE WHEN rr > 0 THEN ({_F2}*n - CAST({_NR} AS DOUBLE)/{_NH}*dr + rr)/rr ELSE 0 END')} AS xi FROM t")
def xi_2d_ls(spark, sf_dir):
    return _rounded(pairs.xi_2d(view(spark, sf_dir, "halos"), SMU, "LS", view(spark, sf_dir, "random_catalog")), "xi")

# ---- jackknife

_HT = f"WITH {view_sql('halos', 'tracers', 'random_catalog')}, {_JK}, tr AS (SELECT *, {_JK.split(' AS block_id')[0].split('SELECT *, ')[1]} AS block_id FROM tracers), r2 AS (SELECT id, x, y, z, {_JK.split(' AS block_id')[0].split('SELECT *, ')[1]} AS block_id FROM (SELECT id, y AS x, z AS y, x AS z FROM random_catalog))"
_LEFT = lambda a, b, name: _leave_sql(a, b, R_BINS, JK_LEVEL**3, name)
_SIZE = lambda t: f"((SELECT count(*) FROM {t}) - (SELECT count(*) FROM {t} WHERE block_id = k.range))"

@query(
    "jk_xi_cross",
    f"""{_HT}, {_LEFT('h', 'tr', 'dd')}, {_LEFT('rc', 'r2', 'rr')}, {_LEFT('h', 'r2', 'd1')}, {_LEFT('tr', 'rc', 'd2')},
    sz AS (SELECT CAST(k.range AS INT) AS block_id, CAST({_SIZE('rc')} AS DOUBLE)/{_SIZE('h')} AS f1, CAST({_SIZE('r2')} AS DOUBLE)/{_SIZE('tr')} AS f2 FROM range({JK_LEVEL**3}) k)
    SELECT block_id, ir, {rs('CASE WHEN rr.n > 0 THEN (f1*f2*dd.n - f1*d1.n - f2*d2.n + rr.n)/rr.n ELSE 0 END')} AS xi FROM dd JOIN rr USING (block_id, ir) JOIN d1 USING (block_id, ir) JOIN d2 USING (block_id, ir) JOIN sz USING (block_id)""",
)
def jk_xi_cross(spark, sf_dir):
    cats = [view(spark, sf_dir, "halos").select("id", "x", "y", "z"), view(spark, sf_dir, "tracers").select("id", "x", "y", "z"), *_randoms(spark, sf_dir)]
    h, t, one, two = (jackknife.spatial_blocks(c, JK_LEVEL) for c in cats)
    counts = [jackknife.leave_one_out(a, b, R_BINS, JK_LEVEL**3) for a, b in ((h, t), (one, two), (h, two), (t, one))]
    xi = jackknife.xi_blocks_cross(*counts, [jackknife.block_sizes(c) for c in (h, t, one, two)], [c.count() for c in cats])
    return _rounded(xi, "xi")

def _left_smu(a: str, name: str) -> str:
    im = f"CAST(floor((abs(dz)/r)/{d(SMU.mu_step)}) AS INT)"
    return f"""{pairs_sql(a, a, SMU.r.high, ', a.block_id AS b1, b.block_id AS b2', f'{name}_p')},
    {name}_t AS (SELECT {bin_sql('r', SMU.r)} AS ir, {im} AS imu, b1, b2, count(*) AS n FROM {name}_p WHERE r > 0 AND r < {d(SMU.r.high)} AND {im} < {SMU.n_mu} GROUP BY 1, 2, 3, 4),
    {name} AS (SELECT CAST(k.range AS INT) AS block_id, s.ir, s.imu, coalesce(sum(CASE WHEN b1 <> k.range AND b2 <> k.range THEN n END), 0) AS n FROM range({JK_LEVEL**3}) k CROSS JOIN {_FRAME} s LEFT JOIN {name}_t t ON t.ir = s.ir AND t.imu = s.imu GROUP BY 1, 2, 3)"""

@query(
    "jk_projected",
    f"""WITH {view_sql('halos', 'random_catalog')}, {_JK}, {_left_smu('h', 'dd')}, {_left_smu('rc', 'rr')},
    sz AS (SELECT CAST(k.range AS INT) AS block_id, CAST({_SIZE('rc')} AS DOUBLE)/{_SIZE('h')} AS f FROM range({JK_LEVEL**3}) k),
    x AS (SELECT block_id, ir, CAST(rr.n AS DOUBLE) AS rr, CASE WHEN rr.n > 0 THEN f*f*dd.n/rr.n - 1 ELSE 0 END AS xi FROM dd JOIN rr USING (block_id, ir, imu) JOIN sz USING (block_id)),
    o AS (SELECT block_id, ir, CASE WHEN sum(rr) > 0 THEN sum(rr*xi)/sum(rr) ELSE 0 END AS xi FROM x GROUP BY 1, 2)
    SELECT ir, {rs('avg(xi)')} AS mean, {rs('sqrt((count(*) - 1)*var_pop(xi))')} AS se FROM o GROUP BY ir""",
)
def jk_projected(spark, sf_dir):
    """Jackknife mean and error of xi(s) from the (s, mu) counts of each block."""
    cats = [view(spark, sf_dir, n).select("id", "x", "y", "z") for n in ("halos", "random_catalog")]
    h, rc = (jackknife.spatial_blocks(c, JK_LEVEL) for c in cats)
    dd, rr = (jackknife.leave_one_out_smu(c, SMU, JK_LEVEL**3) for c in (h, rc))
    xi = jackknife.xi_smu_blocks(dd, rr, jackknife.block_sizes(h), jackknife.block_sizes(rc), *[c.count() for c in cats])
    return _rounded(jackknife.mean_and_error(xi, ["ir"]), "mean", "se")

_LONG = f"CAST(floor((abs(dz) - {d(SPSP.par_low)})/{d(SPSP.par_step)}) AS INT)"

def _left_spsp(a: str, name: str) -> str:
    return f"""{pairs_sql(a, a, SPSP.reach, ', a.block_id AS b1, b.block_id AS b2', f'{name}_p')},
    {name}_t AS (SELECT {bin_sql(_PERP, SPSP.perp)} AS iperp, {_LONG} AS ipar, b1, b2, count(*) AS n FROM {name}_p WHERE {_PERP} >= {d(SPSP.perp.low)} AND {_PERP} < {d(SPSP.perp.high)} AND {_LONG} < {SPSP.n_par} GROUP BY 1, 2, 3, 4),
    {name} AS (SELECT CAST(k.range AS INT) AS block_id, s.ir AS iperp, s.im AS ipar, coalesce(sum(CASE WHEN b1 <> k.range AND b2 <> k.range THEN n END), 0) AS n FROM range({JK_LEVEL**3}) k CROSS JOIN {_SPINE2.format(SPSP.perp.n, SPSP.n_par)} s LEFT JOIN {name}_t t ON t.iperp = s.ir AND t.ipar = s.im GROUP BY 1, 2, 3)"""

@query(
    "jk_wp",
    f"""WITH {view_sql('halos', 'random_catalog')}, {_JK}, {_left_spsp('h', 'dd')}, {_left_spsp('rc', 'rr')},
    sz AS (SELECT CAST(k.range AS INT) AS block_id, CAST({_SIZE('rc')} AS DOUBLE)/{_SIZE('h')} AS f FROM range({JK_LEVEL**3}) k),
    x AS (SELECT block_id, iperp, CAST(rr.n AS DOUBLE) AS rr, CASE WHEN rr.n > 0 THEN f*f*dd.n/rr.n - 1 ELSE 0 END AS xi FROM dd JOIN rr USING (block_id, iperp, ipar) JOIN sz USING (block_id)),
    o AS (SELECT block_id, iperp, CASE WHEN sum(rr) > 0 THEN sum(rr*xi)/sum(rr)*{d((SPSP.par_high - SPSP.par_low) * 2)} ELSE 0 END AS wp FROM x GROUP BY 1, 2)
    SELECT iperp, {rs('avg(wp)', 9)} AS mean, {rs('sqrt((count(*) - 1)*var_pop(wp))', 9)} AS se FROM o GROUP BY iperp""",
)
def jk_wp(spark, sf_dir):
    """Jackknife mean and error of w_p from the (s_perp, s_par) counts of each block."""
    cats = [view(spark, sf_dir, n).select("id", "x", "y", "z") for n in ("halos", "random_catalog")]
    h, rc = (jackknife.spatial_blocks(c, JK_LEVEL) for c in cats)
    dd, rr = (jackknife.leave_one_out_spsp(c, SPSP, JK_LEVEL**3) for c in (h, rc))
    wp = jackknife.wp_blocks(dd, rr, jackknife.block_sizes(h), jackknife.block_sizes(rc), *[c.count() for c in cats], SPSP)
    return _rounded(jackknife.mean_and_error(wp, ["iperp"], "wp"), "mean", "se", digits=9)

def _cut_sql(source: str, name: str) -> str:
    cells = f"SELECT k.range AS b, ix, iy, iz, CASE WHEN {_OWNER} = k.range THEN 0 ELSE val*{d((_JKN / (_JKN - 1)) ** 0.5)} END AS v FROM {source}, range({_JKN}) k"
    return f"{name}_c AS ({cells}), {name} AS (SELECT b, ix, iy, iz, v - avg(v) OVER (PARTITION BY b) AS v FROM {name}_c)"

@query(
    "jk_xi_ifft_cross",
    f"""WITH {view_sql('particles', 'tracers')}, {delta_sql('particles', N, 'tsc', 'd1')}, {delta_sql('tracers', N, 'tsc', 'd2')}, {_cut_sql('d1', 'c1')}, {_cut_sql('d2', 'c2')}, {_batch_dft_sql('c1', 'm1', -1, 'v')}, {_batch_dft_sql('c2', 'm2', -1, 'v')},
    pw AS (SELECT b, ix, iy, iz, CASE WHEN {_KLEN} > 0 THEN (m1.re*m2.re + m1.im*m2.im)/{_w2_sql('tsc')} ELSE 0 END AS p FROM m1 JOIN m2 USING (b, ix, iy, iz)), {_batch_dft_sql('pw', 'lags', 1, 'p')},
    x AS (SELECT b, {bin_sql(f'({_KLEN}/{N}.0)', LAG_BINS)} AS ir, avg(re)/{d(float(N) ** 6)} AS xi FROM lags WHERE {_KLEN}/{N}.0 < {d(LAG_BINS.high)} GROUP BY 1, 2)
    SELECT ir, {rs('avg(xi)', 8)} AS mean, {rs('sqrt((count(*) - 1)*var_pop(xi))', 8)} AS se FROM x GROUP BY ir""",
)
def jk_xi_ifft_cross(spark, sf_dir):
    xi = spectrum.correlation_without_block(_delta(spark, sf_dir), N, "tsc", LAG_BINS, JK_LEVEL, mesh2=_delta(spark, sf_dir, "tracers"))
    return _rounded(jackknife.mean_and_error(xi, ["ir"]), "mean", "se", digits=8)

@query("pk_multipoles_cross", f"{_CROSS} {_binned_sql(f'cr/{_w2_sql("tsc")}', tuple(range(spectrum.MAX_ELL)), 'both_')}")
def pk_multipoles_cross(spark, sf_dir):
    ells = tuple(range(spectrum.MAX_ELL))
    out = spectrum.power_spectrum(_delta(spark, sf_dir), N, "tsc", K_BINS, None, _delta(spark, sf_dir, "tracers"), ells)
    return _rounded(out, *[f"p{e}" for e in ells], digits=8)

# ---- programs

FAR = replace(PROGRAM, rrange=(100.0, 500.0), nr=4)
_UNIT = PROGRAM.box.size / (2 * math.pi)
_KB = RadialBins(PROGRAM.krange[0] * _UNIT, PROGRAM.krange[1] * _UNIT, PROGRAM.nk)
_FB = FAR.radial_bins()

def _halos(spark: SparkSession, sf_dir: str) -> DataFrame:
    return programs.prepared(view(spark, sf_dir, "halos"), PROGRAM, redshift_space=True)

def _power_sql(p: str, source: str) -> str:
    k = f"({d(_KB.low)} + (ik + 0.5)*{d(_KB.step)})"
    return f"""b AS (SELECT {bin_sql(_KLEN, _KB)} AS ik, count(*) AS modes, avg({p})/{d(float(N) ** 6)} AS p0 FROM {source} WHERE iz <= {N // 2} AND {_KLEN} >= {d(_KB.low)} AND {_KLEN} < {d(_KB.high)} GROUP BY 1)
    SELECT ik, {rs(f'{k}*{d(1 / _UNIT)}', 9)} AS k, modes, {rs('p0*1e9', 1)} AS p0 FROM b WHERE ik > 0 AND {k} < {N / 2}"""

def _lags_sql(p: str, source: str) -> str:
    lag = f"({_KLEN}/{N}.0)"
    return f"pw AS (SELECT ix, iy, iz, CASE WHEN {_KLEN} > 0 THEN {p} ELSE 0 END AS p FROM {source}), {dft_sql('pw', N, 'lags', 1, 'p')} SELECT {bin_sql(lag, _FB)} AS ir, count(*) AS cells, {rs(f'avg(re)/{d(float(N) ** 6)}', 8)} AS xi FROM lags WHERE {lag} >= {d(_FB.low)} AND {lag} < {d(_FB.high)} GROUP BY 1"

_H = f"WITH {view_sql('halos', 'tracers')}, {_SELECTED}"
_PAUTO = lambda source: f"((re*re + im*im)/{_w2_sql('tsc')} - CAST({N**6} AS DOUBLE)/(SELECT count(*) FROM {source}))"
_HK = f"{_H}, {delta_sql('h', N, 'tsc')}, {dft_sql('delta', N, 'modes')}"
_HT_K = f"{_H}, {delta_sql('h', N, 'tsc', 'd1')}, {delta_sql('tracers', N, 'tsc', 'd2')}, {dft_sql('d1', N, 'm1')}, {dft_sql('d2', N, 'm2')}, both_ AS (SELECT ix, iy, iz, m1.re*m2.re + m1.im*m2.im AS cr FROM m1 JOIN m2 USING (ix, iy, iz))"

@query("program_halo_pk", f"{_HK}, {_power_sql(_PAUTO('h'), 'modes')}")
def program_halo_pk(spark, sf_dir):
    return _rounded(_rounded(programs.power(_halos(spark, sf_dir), PROGRAM), "k", digits=9), "p0", digits=1)

@query("program_halo_pk_cross", f"{_HT_K}, {_power_sql(f'cr/{_w2_sql("tsc")}', 'both_')}")
def program_halo_pk_cross(spark, sf_dir):
    out = programs.power(_halos(spark, sf_dir), PROGRAM, particles2=view(spark, sf_dir, "tracers"))
    return _rounded(_rounded(out, "k", digits=9), "p0", digits=1)

@query("program_halo_xi_ifft", f"{_HK}, {_lags_sql(_PAUTO('h'), 'modes')}")
def program_halo_xi_ifft(spark, sf_dir):
    return _rounded(programs.xi_by_transform(_halos(spark, sf_dir), FAR), "xi", digits=8)

@query("program_halo_xi_cross", f"{_H}, {counts_sql('h', 'tracers', _PB, 'c')} SELECT ir, {rs(f'1000*({d(_PB.low)} + (ir + 0.5)*{d(_PB.step)})')} AS r, {rs(f'n/(CAST((SELECT count(*) FROM h) AS DOUBLE)*{_NT}*{_shell(_PB)}) - 1')} AS xi FROM c")
def program_halo_xi_cross(spark, sf_dir):
    return _rounded(programs.halo_xi(_halos(spark, sf_dir), PROGRAM, view(spark, sf_dir, "tracers").select("id", "x", "y", "z")), "r", "xi")

_SMU2 = programs.bins_2d(PROGRAM, "smu", 4)
_SPSP2 = programs.bins_2d(PROGRAM, "spsp", 3)
_NPH = "CAST((SELECT count(*) FROM h) AS DOUBLE)*((SELECT count(*) FROM h) - 1)/2"
_X2D = f"""{_H}, {pairs_sql('h', 'h', _SMU2.r.high)}, c AS ({_smu_of('p', _SMU2)}), x AS (SELECT s.ir, s.im AS imu, coalesce(c.n, 0) AS n, {_NPH}*{_shell(_SMU2.r).replace('ir', 's.ir')}*{d(_SMU2.mu_step)} AS rr
  FROM {_SPINE2.format(_SMU2.r.n, _SMU2.n_mu)} s LEFT JOIN c ON c.ir = s.ir AND c.imu = s.im)"""

@query("program_halo_xi2d_smu", f"{_X2D} SELECT ir, imu, n, {rs('rr', 4)} AS rr, {rs('CASE WHEN rr > 0 THEN n/rr - 1 ELSE 0 END')} AS xi FROM x")
def program_halo_xi2d_smu(spark, sf_dir):
    return _rounded(_rounded(programs.halo_xi_2d(_halos(spark, sf_dir), PROGRAM, "smu", 4), "xi"), "rr", digits=4)

@query("program_halo_xi2d_smu_1d", f"{_X2D} SELECT ir, {rs('CASE WHEN sum(rr) > 0 THEN sum(rr*(n/rr - 1))/sum(rr) ELSE 0 END')} AS xi FROM x GROUP BY ir")
def program_halo_xi2d_smu_1d(spark, sf_dir):
    return _rounded(programs.projected(programs.halo_xi_2d(_halos(spark, sf_dir), PROGRAM, "smu", 4), PROGRAM, "smu", 4), "xi")

def _ring(b: SpspBins) -> str:
    lo, hi = (f"({d(b.perp.low)} + (s.ir + {k})*{d(b.perp.step)})" for k in (0, 1))
    return f"{d(math.pi * b.par_step * 2.0)}*({hi}*{hi} - {lo}*{lo})"

_ALONG = f"CAST(floor(abs(dz)/{d(_SPSP2.par_step)}) AS INT)"
_XSP = f"""{_H}, {pairs_sql('h', 'h', _SPSP2.reach)}, c AS (SELECT {bin_sql(_PERP, _SPSP2.perp)} AS iperp, {_ALONG} AS ipar, count(*) AS n FROM p WHERE {_PERP} >= {d(_SPSP2.perp.low)} AND {_PERP} < {d(_SPSP2.perp.high)} AND {_ALONG} < {_SPSP2.n_par} GROUP BY 1, 2),
  x AS (SELECT s.ir AS iperp, s.im AS ipar, coalesce(c.n, 0) AS n, {_NPH}*{_ring(_SPSP2)} AS rr FROM {_SPINE2.format(_SPSP2.perp.n, _SPSP2.n_par)} s LEFT JOIN c ON c.iperp = s.ir AND c.ipar = s.im)"""

@query("program_halo_xi2d_wp", f"{_XSP} SELECT iperp, {rs(f'CASE WHEN sum(rr) > 0 THEN sum(rr*(n/rr - 1))/sum(rr)*{d(_SPSP2.par_high * 2)} ELSE 0 END', 9)} AS wp FROM x GROUP BY 1")
def program_halo_xi2d_wp(spark, sf_dir):
    xi = programs.halo_xi_2d(_halos(spark, sf_dir), PROGRAM, "spsp", 3)
    return _rounded(programs.projected(xi, PROGRAM, "spsp", 3), "wp", digits=9)

_XCROSS = f"""{_H}, {pairs_sql('h', 'tracers', _SMU2.r.high)}, c AS ({_smu_of('p', _SMU2)}), x AS (SELECT s.ir, s.im AS imu, coalesce(c.n, 0) AS n, CAST((SELECT count(*) FROM h) AS DOUBLE)*{_NT}*{_shell(_SMU2.r).replace('ir', 's.ir')}*{d(_SMU2.mu_step)} AS rr
  FROM {_SPINE2.format(_SMU2.r.n, _SMU2.n_mu)} s LEFT JOIN c ON c.ir = s.ir AND c.imu = s.im)"""

@query("program_halo_xi2d_cross", f"{_XCROSS} SELECT ir, imu, n, {rs('rr', 4)} AS rr, {rs('CASE WHEN rr > 0 THEN n/rr - 1 ELSE 0 END')} AS xi FROM x")
def program_halo_xi2d_cross(spark, sf_dir):
    """Two catalogues in bins of separation and angle."""
    other = view(spark, sf_dir, "tracers").select("id", "x", "y", "z")
    return _rounded(_rounded(programs.halo_xi_2d(_halos(spark, sf_dir), PROGRAM, "smu", 4, other), "xi"), "rr", digits=4)

def _snapshot(spark: SparkSession, sf_dir: str) -> str:
    """Halos as a snapshot of 32-bit floats in length units."""
    snapshot.register(spark)
    prefix = f"{work_path(spark, 'matter')}/snap"
    halos = view(spark, sf_dir, "halos").select("id", *[(F.col(c) * 1000.0).alias(c) for c in "xyz"], "vx", "vy", "vz", "pot")
    snapshot.write(halos, prefix, box=BOX.size)
    return prefix

_F32 = lambda e: f"CAST(CAST({e} AS FLOAT) AS DOUBLE)"
_FOLDED = lambda e: f"(CASE WHEN {e} >= 1000 THEN {e} - 1000 WHEN {e} < 0 THEN {e} + 1000 ELSE {e} END)"
_MATTER = f"WITH {view_sql('halos')}, s AS (SELECT id, {', '.join(f'{_FOLDED(_F32(f'{c}*1000'))} AS {c}' for c in 'xyz')}, {_F32('vz')} AS vz FROM halos), m AS (SELECT id, x/{d(1000.0)} AS x, y/{d(1000.0)} AS y, {_FOLDED(f'(z + vz*{d(0.01)})')}/{d(1000.0)} AS z FROM s)"
_MK = f"{_MATTER}, {delta_sql('m', N, 'tsc')}, {dft_sql('delta', N, 'modes')}"

@query("program_matter_pk", f"{_MK}, {_power_sql(_PAUTO('m'), 'modes')}")
def program_matter_pk(spark, sf_dir):
    """Snapshot scan, redshift-space shift and scatter in one plan, then the spectrum."""
    out = programs.power(programs.matter(spark, _snapshot(spark, sf_dir), PROGRAM, redshift_space=True), PROGRAM)
    return _rounded(_rounded(out, "k", digits=9), "p0", digits=1)

@query("program_matter_xi_ifft", f"{_MK}, {_lags_sql(_PAUTO('m'), 'modes')}")
def program_matter_xi_ifft(spark, sf_dir):
    return _rounded(programs.xi_by_transform(programs.matter(spark, _snapshot(spark, sf_dir), FAR, redshift_space=True), FAR), "xi", digits=8)

@query("program_matter_xi", f"{_MATTER}, {counts_sql('m', 'm', _PB, 'c')} SELECT ir, {rs(f'1000*({d(_PB.low)} + (ir + 0.5)*{d(_PB.step)})')} AS r, {rs(f'n/(CAST((SELECT count(*) FROM m) AS DOUBLE)*((SELECT count(*) FROM m) - 1)/2*{_shell(_PB)}) - 1')} AS xi FROM c")
def program_matter_xi(spark, sf_dir):
    return _rounded(programs.halo_xi(programs.matter(spark, _snapshot(spark, sf_dir), PROGRAM, redshift_space=True), PROGRAM), "r", "xi")

JK = replace(PROGRAM, estimator="RR", jk_level=2)

_CUBE = _JK.split(" AS block_id")[0].split("SELECT *, ")[1]
_EVEN = ", ".join(f"CAST({hash_sql(f'(g * 3 + {k})', 310 + k)} AS DOUBLE)/{d(float(catalog.HASH_MOD))} AS {c}" for k, c in enumerate("xyz"))

@query(
    "program_halo_xi_jackknife",
    f"""{_H}, g AS (SELECT unnest(range((SELECT count(*) FROM h))) AS g), even AS (SELECT g AS id, {_EVEN} FROM g), hb AS (SELECT *, {_CUBE} AS block_id FROM h), rb AS (SELECT *, {_CUBE} AS block_id FROM even),
    {_leave_sql('hb', 'hb', _PB, 8, 'dd')}, {_leave_sql('rb', 'rb', _PB, 8, 'rr')},
    sz AS (SELECT CAST(k.range AS INT) AS block_id, CAST({_SIZE('rb')} AS DOUBLE)/{_SIZE('hb')} AS f FROM range(8) k),
    x AS (SELECT block_id, ir, CASE WHEN rr.n > 0 THEN (f*f*dd.n - rr.n)/rr.n ELSE 0 END AS xi FROM dd JOIN rr USING (block_id, ir) JOIN sz USING (block_id))
    SELECT ir, {rs('avg(xi)')} AS mean, {rs('sqrt((count(*) - 1)*var_pop(xi))')} AS se FROM x GROUP BY ir""",
)
def program_halo_xi_jackknife(spark, sf_dir):
    return _rounded(programs.halo_xi_jackknife(_halos(spark, sf_dir), JK), "mean", "se")

_HE = f"{_H}, g AS (SELECT unnest(range((SELECT count(*) FROM h))) AS g), even AS (SELECT g AS id, {_EVEN} FROM g)"
_CUBES = f"hb AS (SELECT *, {_CUBE} AS block_id FROM h), rb AS (SELECT *, {_CUBE} AS block_id FROM even)"

def _slices_sql(source: str, name: str) -> str:
    return f"""{name}_o AS (SELECT *, row_number() OVER (ORDER BY {hash_sql('id', 10)}, id) - 1 AS pos FROM {source}), {name}_c AS (SELECT count(*) AS nn, CAST(ceil(count(*)/{d(8.0)}) AS BIGINT) AS m FROM {source}),
    {name} AS (SELECT o.*, CAST(k.range AS INT) AS block_id FROM {name}_o o, {name}_c, range(8) k WHERE pos >= k.range*((nn - m)//7) AND pos < k.range*((nn - m)//7) + m)"""

def _jk_ls_sql(blocks: str) -> str:
    left = lambda source, b: f"((SELECT count(*) FROM {source}) - (SELECT count(*) FROM {b} WHERE block_id = k.range))"
    return f"""{_HE}, {blocks}, {_leave_sql('hb', 'hb', _PB, 8, 'dd')}, {_leave_sql('rb', 'rb', _PB, 8, 'rr')}, {_leave_sql('hb', 'rb', _PB, 8, 'dr')},
    sz AS (SELECT CAST(k.range AS INT) AS block_id, CAST({left('even', 'rb')} AS DOUBLE)/{left('h', 'hb')} AS f FROM range(8) k),
    x AS (SELECT block_id, ir, CASE WHEN rr.n > 0 THEN (f*f*dd.n - f*dr.n + rr.n)/rr.n ELSE 0 END AS xi FROM dd JOIN rr USING (block_id, ir) JOIN dr USING (block_id, ir) JOIN sz USING (block_id))
    SELECT ir, {rs('avg(xi)')} AS mean, {rs('sqrt((count(*) - 1)*var_pop(xi))')} AS se FROM x GROUP BY ir"""

@query("program_halo_xi_jackknife_ls", _jk_ls_sql(_CUBES))
def program_halo_xi_jackknife_ls(spark, sf_dir):
    """The Landy-Szalay estimator over cubes."""
    return _rounded(programs.halo_xi_jackknife(_halos(spark, sf_dir), replace(JK, estimator="LS")), "mean", "se")

@query("program_halo_xi_jackknife_shuffle", _jk_ls_sql(f"{_slices_sql('h', 'hb')}, {_slices_sql('even', 'rb')}"))
def program_halo_xi_jackknife_shuffle(spark, sf_dir):
    """The Landy-Szalay estimator over slices of a shuffled order."""
    return _rounded(programs.halo_xi_jackknife(_halos(spark, sf_dir), replace(JK, estimator="LS", jk_type="shuffle")), "mean", "se")

_MOMENTS = {"dens": ("rho",), "velc": ("ux", "uy", "uz"), "sigma": tuple(f"s{t}" for t in moments.TENSOR)}

for _kind, _values in _MOMENTS.items():
    _from = {"dens": f"{_P}, {_U} SELECT ix, iy, iz, {rs(_F32('rho'), 0)} AS rho FROM u", "velc": f"{_P}, {_U} SELECT ix, iy, iz, {', '.join(f'{rs(_F32(v), 4)} AS {v}' for v in _values)} FROM u", "sigma": f"{_P}, {_U}, {_SIG} SELECT ix, iy, iz, {', '.join(f'{rs(_F32(v), 4)} AS {v}' for v in _values)} FROM s"}

    @query(f"program_moment_{_kind}", _from[_kind])
    def program_moment(spark, sf_dir, kind=_kind, values=_values):
        """A moment field through its sink of 32-bit floats and back."""
        path, config = work_path(spark, f"moment-{kind}"), replace(PROGRAM, scheme="cic")
        tables.write_field(programs.moment(view(spark, sf_dir, "particles"), config, kind), path, N, BOX.size, *values)
        back = tables.read_field(spark, path, *values)
        return _rounded(back.select("ix", "iy", "iz", *[F.col(v).cast("double").alias(v) for v in values]), *values, digits=0 if kind == "dens" else 4)

# ---- results on storage

@query("fourier_table", ORACLE["dft_modes"] + f" WHERE iz <= {N // 2}")
def fourier_table(spark, sf_dir):
    path = work_path(spark, "modes")
    tables.write_modes(fft.forward_half(mesh.contrast(_delta(spark, sf_dir), N), N), path, N, BOX.size)
    return _rounded(tables.read_field(spark, path, "re", "im"), "re", "im")

@query("xi_text", f"{_TWO_LS}, f AS (SELECT CAST({_NR} AS DOUBLE)/{_NH} AS f1, CAST({_NR} AS DOUBLE)/{_NT} AS f2) SELECT {rs(f'{d(R_BINS.low)} + (ir + 0.5)*{d(R_BINS.step)}', 9)} AS r, {rs('CASE WHEN rr_.n > 0 THEN (f1*f2*dd.n - f1*d1.n - f2*d2.n + rr_.n)/rr_.n ELSE 0 END')} AS xi, CAST(dd.n AS DOUBLE) AS dd, CAST(d1.n AS DOUBLE) AS d1r2, CAST(d2.n AS DOUBLE) AS d2r1, CAST(rr_.n AS DOUBLE) AS rr FROM dd JOIN rr_ USING (ir) JOIN d1 USING (ir) JOIN d2 USING (ir), f")
def xi_text(spark, sf_dir):
    """xi of two catalogues in its text layout, read back."""
    path = work_path(spark, "xi")
    xi = pairs.xi_cross(view(spark, sf_dir, "halos"), view(spark, sf_dir, "tracers"), R_BINS, "LS", *_randoms(spark, sf_dir))
    mid = pairs.spine(spark, R_BINS).select("ir", F.col("r_mid").alias("r"))
    tables.write_xi(xi.join(F.broadcast(mid), "ir"), path, layout="cross LS")  # a row a bin
    return _rounded(_rounded(tables.read_columns(spark, path, "r", "xi", *tables.XI_LAYOUTS["cross LS"]), "r", digits=9), "xi")

@query("xi_text_2d", f"{_X2D} SELECT {rs(f'{d(_SMU2.r.low)} + (ir + 0.5)*{d(_SMU2.r.step)}', 9)} AS s, {rs(f'{d(_SMU2.mu_low)} + (imu + 0.5)*{d(_SMU2.mu_step)}', 9)} AS mu, {rs('CASE WHEN rr > 0 THEN n/rr - 1 ELSE 0 END')} AS xi FROM x")
def xi_text_2d(spark, sf_dir):
    """The 2-D program's xi in its text layout, read back."""
    path, b = work_path(spark, "xi2d"), _SMU2
    xi = programs.halo_xi_2d(_halos(spark, sf_dir), PROGRAM, "smu", 4)
    mid = {"s": F.lit(b.r.low) + (F.col("ir") + 0.5) * F.lit(b.r.step), "mu": F.lit(b.mu_low) + (F.col("imu") + 0.5) * F.lit(b.mu_step)}
    tables.write_xi(xi.withColumns(mid), path, ("s", "mu"), layout=None)
    return _rounded(_rounded(tables.read_columns(spark, path, "s", "mu", "xi"), "s", "mu", digits=9), "xi")

@query("xi_text_wp", f"{_XSP} SELECT {rs(f'{d(_SPSP2.perp.low)} + (iperp + 0.5)*{d(_SPSP2.perp.step)}', 9)} AS s_perp, {rs(f'CASE WHEN sum(rr) > 0 THEN sum(rr*(n/rr - 1))/sum(rr)*{d(_SPSP2.par_high * 2)} ELSE 0 END', 9)} AS wp FROM x GROUP BY iperp")
def xi_text_wp(spark, sf_dir):
    """The projected companion in its text layout, read back."""
    path, b = work_path(spark, "wp"), _SPSP2.perp
    wp = programs.projected(programs.halo_xi_2d(_halos(spark, sf_dir), PROGRAM, "spsp", 3), PROGRAM, "spsp", 3)
    tables.write_xi(wp.withColumn("s_perp", F.lit(b.low) + (F.col("iperp") + 0.5) * F.lit(b.step)), path, ("s_perp",), "wp", None)
    return _rounded(tables.read_columns(spark, path, "s_perp", "wp"), "s_perp", "wp", digits=9)

# ---- catalogues

@query("catalogue_header", f"WITH {view_sql('halos')} SELECT count(*) AS halos, {rs('max(mvir)', 4)} AS heaviest, CAST(max(child_level) AS BIGINT) AS deepest, {d(1000.0)} AS box FROM halos")
def catalogue_header(spark, sf_dir):
    """A catalogue's header of one row, written beside it and read back with its types."""
    path = work_path(spark, "header")
    facts = view(spark, sf_dir, "halos").agg(F.count(F.lit(1)).alias("halos"), F.max("mvir").alias("heaviest"), F.max("child_level").alias("deepest"), F.lit(BOX.size).alias("box"))
    facts.write.json(path)
    head = tables.read_header(spark, path)
    return _rounded(spark.createDataFrame([tuple(head[c] for c in facts.columns)], "halos long, heaviest double, deepest long, box double"), "heaviest", digits=4)

@query("sort_by_block", f"WITH {view_sql('halos')}, {_JK.split(', rc AS')[0]} SELECT id, block_id, row_number() OVER (ORDER BY block_id, id) - 1 AS position FROM h")
def sort_by_block(spark, sf_dir):
    """Ranks in the order of jackknife cubes."""
    blocked = jackknife.spatial_blocks(view(spark, sf_dir, "halos"), JK_LEVEL).select("id", "block_id")
    return ordering.numbered(blocked, F.col("block_id"))

@query("add_registered", f"WITH {view_sql('halos')} SELECT id, CAST(child_level + 2 AS INT) AS total FROM halos")
def add_registered(spark, sf_dir):
    """A function that is registered for SQL."""
    bits.register(spark)
    return view(spark, sf_dir, "halos").selectExpr("id", "add(int(child_level), 2) AS total")

_RANGES = {"x": (200.0, 700.0), "y": (100.0, 900.0), "z": (0.0, 650.0)}

@query("snapshot_box", f"WITH {view_sql('halos')}, s AS (SELECT id, {', '.join(f'{_F32(f'{c}*1000')} AS {c}' for c in 'xyz')}, {_F32('vz')} AS vz FROM halos) SELECT id, {', '.join(f'{rs(c, 4)} AS {c}' for c in 'xyz')}, {rs('vz', 4)} AS vz FROM s WHERE {' AND '.join(f'{c} BETWEEN {d(a)} AND {d(b)}' for c, (a, b) in _RANGES.items())}")
def snapshot_box(spark, sf_dir):
    """A snapshot's particles in an inclusive range of each axis, with their velocities; the potentials' block is skipped."""
    scan = spark.read.format("snapshot").option("potentials", "false").load(_snapshot(spark, sf_dir))
    for c, (low, high) in _RANGES.items():
        scan = catalog.select_range(scan, c, low, high)
    return _rounded(scan.select("id", "x", "y", "z", "vz"), "x", "y", "z", "vz", digits=4)

@query("stream_upkeep", "SELECT vec_id AS id, label FROM embeddings WHERE vec_id % 7 <> 0")
def stream_upkeep(spark, sf_dir):
    """A stream of vectors into a table of batches, and a deletion."""
    path, where = f"{sf_dir}/embeddings.parquet", work_path(spark, "upkeep")
    live = spark.readStream.schema(spark.read.parquet(path).schema).parquet(path.replace(".parquet", ".parque[t]"))
    streams.append_batches(live.selectExpr("vec_id AS id", "label"), f"{where}/rows", f"{where}/log").awaitTermination()
    table = spark.read.parquet(f"{where}/rows")
    return catalog.without_ids(table, table.where("id % 7 = 0")).select("id", "label")


@query("rows_by_id", f"WITH {view_sql('halos')} SELECT id, mvir FROM halos WHERE id % 1000 = 1")
def rows_by_id(spark, sf_dir):
    """Point look-up: the rows of a table of ids."""
    halos = view(spark, sf_dir, "halos").select("id", "mvir")
    return catalog.only_ids(halos, halos.where("id % 1000 = 1").select("id"))

@query("species_table", f"WITH {view_sql('tracers')} SELECT id, {rs('x/2', 9)} AS x, {rs('y/2', 9)} AS y, {rs('z/2', 9)} AS z FROM tracers WHERE species = 'click'")
def species_table(spark, sf_dir):
    """One species of a table that is a folder a species."""
    path = work_path(spark, "species")
    t = view(spark, sf_dir, "tracers").withColumns({f"v{c}": F.lit(1.0) for c in "xyz"})
    t.write.partitionBy("species").parquet(path)
    return _rounded(tables.read_species(spark, path, "click", 0.25, 2.0).select("id", "x", "y", "z"), "x", "y", "z", digits=9)

@query("catalogue_parts", f"WITH {view_sql('halos')} SELECT count(*) AS n, {rs('sum(mvir)', 1)} AS mvir FROM halos")
def catalogue_parts(spark, sf_dir):
    """A catalogue of two parts with typed columns, read as one."""
    path = work_path(spark, "parts")
    halos = view(spark, sf_dir, "halos")
    for k in (0, 1):
        halos.where(F.col("id") % 2 == k).write.parquet(f"{path}/part={k}")
    back = tables.read_halos(spark, f"{path}/part=0", f"{path}/part=1", fields=("id", "mvir"))
    return back.agg(F.count(F.lit(1)).alias("n"), r(F.sum("mvir"), 1).alias("mvir"))

@query("domain_particles", f"WITH {view_sql('halos')} SELECT id, {', '.join(rs(_F32(c)) + f' AS {c}' for c in 'xyz')}, CAST(floor(x*2) AS INT) AS ix FROM halos WHERE floor(x*2) = 1")
def domain_particles(spark, sf_dir):
    """Halos through the binary domain files, of the domains with ix = 1 alone."""
    domains.register(spark)
    prefix = work_path(spark, "domains")
    cells = {f"i{c}": F.floor(F.col(c) * F.lit(float(n))).cast("int") for c, n in (("x", 2), ("y", 1), ("z", 2))}
    halos = view(spark, sf_dir, "halos").withColumn("mass", F.lit(1.0)).withColumns(cells)
    domains.write(halos.select("id", "mass", "x", "y", "z", "vx", "vy", "vz", "ix", "iy", "iz"), prefix, (2, 1, 2))
    return _rounded(spark.read.format("domains").load(prefix).where("ix = 1").select("id", "x", "y", "z", "ix"), "x", "y", "z")


# ---- binary sinks and the stream of arriving files

_MESH_FILE = exploded_sql("particles", MESH, "cic")

@query("mesh_file", f"WITH {view_sql('particles')}, {_MESH_FILE}, m AS (SELECT ix, iy, iz, sum(w) AS val FROM e GROUP BY 1, 2, 3) SELECT c.ix, c.iy, c.iz, {rs('coalesce(val, 0)')} AS val FROM {_cells_sql(MESH)} c LEFT JOIN m ON m.ix = c.ix AND m.iy = c.iy AND m.iz = c.iz WHERE c.ix BETWEEN 2 AND 4")
def mesh_file(spark, sf_dir):
    """A mesh as three binary files that come into place together, and the slabs of a range of ix read back."""
    path = work_path(spark, "mesh") + "/field"
    fields.write(mesh.assign(view(spark, sf_dir, "particles"), MESH, "cic"), path, MESH, BOX.size, "val", files=3, kind="f8")
    return _rounded(fields.read(spark, path, "val", kind="f8").where("ix >= 2 and ix <= 4"), "val")

_D32 = f"WITH {view_sql('halos')}, dp AS (SELECT {', '.join(f'{_F32(c)} AS {c}' for c in ('x', 'y', 'z', 'vx', 'vy', 'vz'))}, CAST(child_level + 1 AS DOUBLE) AS mass FROM halos), {exploded_sql('dp', N, 'tsc', 'mass, vx, vy, vz')}, {_U}"

@query("program_domain_velc", f"{_D32} SELECT ix, iy, iz, {', '.join(f'{rs(v, 2)} AS {v}' for v in ('ux', 'uy', 'uz'))} FROM u")
def program_domain_velc(spark, sf_dir):
    """Domain files to mean velocities to a binary moment field of two files, and back."""
    where = work_path(spark, "domain-moment")
    cells = {f"i{c}": F.floor(F.col(c) * F.lit(2.0)).cast("int") for c in "xyz"}
    rows = view(spark, sf_dir, "halos").withColumn("mass", (F.col("child_level") + 1).cast("double")).withColumns(cells)
    domains.write(rows, f"{where}/in", (2, 2, 2), "_nbody")
    programs.domain_moment(spark, f"{where}/in", "_nbody", replace(PROGRAM, scheme="tsc"), "velc", f"{where}/out/velc", files=2)
    return _rounded(fields.read(spark, f"{where}/out/velc", "ux", "uy", "uz", layout="moment"), "ux", "uy", "uz", digits=2)

_NU = {"a": 0.25, "box": 2.0, "omega_nu": 0.01, "rho_crit": 27.5e5}

@query(
    "program_species_dens",
    f"""WITH {view_sql('tracers')}, sp AS (SELECT x/2 AS x, y/2 AS y, z/2 AS z, mass FROM tracers WHERE species = 'click'), {exploded_sql('sp', N, 'tsc', 'mass')}, m AS (SELECT ix, iy, iz, sum(mass*w) AS rho FROM e GROUP BY 1, 2, 3)
    SELECT c.ix, c.iy, c.iz, {rs(f"1 + coalesce(rho, 0)*{d(N**3 / (_NU['omega_nu'] * _NU['rho_crit'] * 8))}", 3)} AS rho FROM {_cells_sql(N)} c LEFT JOIN m ON m.ix = c.ix AND m.iy = c.iy AND m.iz = c.iz""",
)
def program_species_dens(spark, sf_dir):
    """One species of a particle table over the mean neutrino mass of the box, to a binary moment field and back."""
    where = work_path(spark, "species-moment")
    view(spark, sf_dir, "tracers").withColumns({f"v{c}": F.lit(1.0) for c in "xyz"}).write.partitionBy("species").parquet(f"{where}/in")
    programs.species_moment(spark, f"{where}/in", _NU, "click", replace(PROGRAM, scheme="tsc"), "dens", f"{where}/out/dens", files=3)
    return _rounded(fields.read(spark, f"{where}/out/dens", "rho", layout="moment"), "rho", digits=3)

@query("stream_snapshot", f"WITH {view_sql('halos')}, s AS (SELECT {', '.join(f'{_FOLDED(_F32(f'{c}*1000'))}/{d(1000.0)} AS {c}' for c in 'xyz')} FROM halos), {exploded_sql('s', N, 'cic')} SELECT ix, iy, iz, {rs('sum(w)')} AS val FROM e GROUP BY 1, 2, 3")
def stream_snapshot(spark, sf_dir):
    """The running mesh of binary snapshot files as a stream, read to its present end."""
    snapshot.register(spark)
    prefix, name = f"{work_path(spark, 'live')}/snap", f"live_{uuid.uuid4().hex}"
    halos = view(spark, sf_dir, "halos").select("id", *[(F.col(c) * 1000.0).alias(c) for c in "xyz"], "vx", "vy", "vz", "pot")
    snapshot.write(halos, prefix, 4, box=1000.0)
    live = spark.readStream.format("snapshot").option("velocities", "false").option("potentials", "false").load(prefix)
    live = live.withColumns({c: F.col(c) / F.lit(1000.0) for c in "xyz"})
    streams.start_into_memory(streams.mesh_stream(live, N, "cic"), name).awaitTermination()
    return _rounded(spark.table(name), "val")


# ---- event time, and points made to the size of a catalogue

_DAYS = f"WITH {view_sql('tracers')}, timed AS (SELECT t.*, e.ts FROM tracers t JOIN events e ON e.event_id = t.id), {exploded_sql('timed', 4, 'ngp', 'mass, ts')}"

@query("windowed_mesh", f"{_DAYS} SELECT CAST(date_trunc('day', ts) AS DATE) AS day, ix, iy, iz, {rs('sum(w*mass)', 4)} AS val FROM e GROUP BY 1, 2, 3, 4")
def windowed_mesh(spark, sf_dir):
    """Mass by cell and day of a stream of events, read to its present end."""
    path = f"{sf_dir}/events.parquet"
    live = spark.readStream.schema(spark.read.parquet(path).schema).parquet(path.replace(".parquet", ".parque[t]"))
    at = "CAST(convert_timezone('UTC', current_timezone(), ts) AS TIMESTAMP) AS ts"  # days are UTC's, whatever the session's zone
    live = live.selectExpr(at, *[f"{e} AS {c}" for c, e in VIEWS["tracers"][1].items()])
    name = f"days_{uuid.uuid4().hex}"
    streams.start_into_memory(streams.windowed_density(live, 4), name).awaitTermination()
    return _rounded(spark.table(name).select(F.expr("date_from_unix_date(int(unix_seconds(window.start) div 86400))").alias("day"), "ix", "iy", "iz", "val"), "val", digits=4)

_CORNERS = ", ".join(f"CASE WHEN g < n THEN {e}*{d(0.1)} ELSE {d(0.9)} + {e}*{d(0.1)} END AS {c}" for k, c in enumerate("xyz") for e in [f"(CAST({hash_sql(f'(g * 3 + {k})', 31 + k)} AS DOUBLE)/{d(float(catalog.HASH_MOD))})"])

@query("corner_clusters", f"WITH {view_sql('halos')}, g AS (SELECT unnest(range(2*(SELECT count(*) FROM halos))) AS g, (SELECT count(*) FROM halos) AS n), c AS (SELECT g AS id, {_CORNERS} FROM g) SELECT id, {', '.join(f'{rs(c, 9)} AS {c}' for c in 'xyz')} FROM c")
def corner_clusters(spark, sf_dir):
    """Two clusters of as many points as the catalogue has halos."""
    return _rounded(catalog.corner_clusters(spark, view(spark, sf_dir, "halos").count()), *"xyz", digits=9)
