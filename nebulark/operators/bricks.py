"""Sums over near pairs inside bricks: what a range join would list is summed where it meets, so pairs never leave a task.

The box is cut into bricks.  A left row lies in one of them, a right row goes to every brick that it reaches, and a
task holds one brick.  Inside, points are sorted into pencils along z, and a few consecutive left points meet the
stretches of thinner pencils that they reach, all at once.  Crowded bricks are cut into ways (left rows) and shares (right rows)
that meet in tasks of their own, so a task's rows stay bounded however points cluster.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nebulark.functions.geometry import AXES

#: Left rows of a brick, about, and the most rows of either side in a task.
BRICK_ROWS, LEFT_ROWS, RIGHT_ROWS = 40_000, 200_000, 800_000
#: Left points that meet others together, and elements of a meeting.
CHUNK, MEETING = 64, 1 << 15
#: Elements of a part of a visit that is placed in single precision, and the most numbers of codes that are counted together.
PLACING, CODES = 1 << 16, 1 << 15
#: Visits of fewer elements are not worth it.
FEW = 1 << 14
#: Parts of a bin in which single precision places, powers of two: with a cosine, without.
PARTS = 512, 2048
#: Thin pencils of the right points in a reach, about.
THIN = 8
_KEYS = ["brick", "way", "share"]


@dataclass
class Visit:
    """Left rows ``a`` of a task and the right rows ``b`` that they may reach, least gap first, with the shifts of their images.

    A right point's image lies at its place plus ``shift``, so the separation is left - right - shift (None: no image on the axis).
    """

    left: dict[str, np.ndarray]
    right: dict[str, np.ndarray]
    a: np.ndarray
    b: np.ndarray
    shift: tuple[np.ndarray | None, ...]
    gap2: np.ndarray  # no pair with that row is nearer
    own: bool  # pairs are met from both ends: the one from the smaller id counts
    far: bool  # pairs may be met at several images: the nearest counts


@dataclass
class Meeting:
    """Left rows ``a`` and right rows ``b`` of a task, their separations and squared distances (inf: no pair of this visit)."""

    left: dict[str, np.ndarray]
    right: dict[str, np.ndarray]
    a: np.ndarray
    b: np.ndarray
    d: tuple[np.ndarray, np.ndarray, np.ndarray]
    r2: np.ndarray
    gap2: float  # no pair is nearer


def _halved(reach: float) -> bool:
    """Whether a pair is in reach at one image only, so that it may be met from either end."""
    return reach < 0.499


def _sorted(rows: pd.DataFrame, pencils: int) -> tuple[dict[str, np.ndarray], np.ndarray]:
    at = [np.clip(np.floor(rows[c].to_numpy() * pencils), 0, pencils - 1).astype(np.int64) for c in "xy"]
    pencil = at[0] * pencils + at[1]
    order = np.lexsort((rows["z"].to_numpy(), pencil))
    return {c: rows[c].to_numpy()[order] for c in rows.columns}, pencil[order]


def _gaps(at: np.ndarray, n: int, low: float, high: float, periodic: bool) -> np.ndarray:
    """How far the pencils ``at`` of n an axis lie from a stretch of it; the outer ones hold all that lies beyond."""
    below, above = at / n, (at + 1) / n
    if not periodic:
        below, above = np.where(at == 0, -np.inf, below), np.where(at == n - 1, np.inf, above)
    return np.maximum(np.maximum(below - high, low - above) - 1e-12, 0.0)


def visits(lefts: pd.DataFrame, rights: pd.DataFrame, reach: float, pencils: int, auto: bool, periodic: bool) -> Iterator[Visit]:
    """All that may be in reach; each pair of a catalogue with itself once."""
    thin = max(1, min(4, round(THIN / reach / pencils)))
    left, pencil = _sorted(lefts, pencils)
    fine = pencils * thin
    right, theirs = _sorted(rights, fine)
    wide, far = reach * (1 + 1e-9) + 1e-12, periodic and not _halved(reach)
    half = auto and _halved(reach)
    # One key by pencil and z: pencils lie apart by more than the stretch of z.
    base, stretch = right["z"].min(), np.ptp(right["z"])
    apart, slack = stretch * (1 + 1e-9) + 1e-6, 4e-16 * fine * fine * (stretch + 1) + 1e-12
    key = theirs * apart + (right["z"] - base)
    opens = np.flatnonzero(np.diff(pencil, prepend=-1))
    first = np.concatenate([np.arange(s, e, CHUNK) for s, e in zip(opens, np.append(opens[1:], len(pencil)), strict=True)])
    last = np.append(first[1:], len(pencil))
    sides = [(np.minimum.reduceat(left[c], first).tolist(), np.maximum.reduceat(left[c], first).tolist()) for c in AXES]
    for i, (a0, a1) in enumerate(zip(first.tolist(), last.tolist(), strict=True)):
        px, py = divmod(int(pencil[a0]), pencils)
        at, gaps = [], []
        for (low, high), own in zip(sides[:2], (px * thin, None), strict=True):
            start, end = math.floor((low[i] - wide) * fine), math.floor((high[i] + wide) * fine)
            if half and own is not None:
                start = max(start, own)
            if not periodic:
                start, end = min(max(start, 0), fine - 1), min(max(end, 0), fine - 1)
            at.append(np.arange(start, end + 1))
            gaps.append(_gaps(at[-1], fine, low[i], high[i], periodic))
        gap2 = (gaps[0] * gaps[0])[:, None] + (gaps[1] * gaps[1])[None]
        near = gap2 <= wide * wide
        home = (at[0] // thin == px)[:, None] & (at[1] // thin == py)[None]
        if half:
            near &= (at[0] // thin > px)[:, None] | (at[1] // thin >= py)[None]
        x, y = np.nonzero(near)
        gap2, home = gap2[x, y], home[x, y]
        (sx, qx), (sy, qy) = (np.divmod(c[k], fine) for c, k in zip(at, (x, y), strict=True))
        up = np.sqrt(wide * wide - gap2) + slack
        low, high = (s[i] for s in sides[2])
        runs = []
        for sz in (-1, 0, 1) if periodic else (0,):
            if sz == 0 or (low - wide - slack <= base + stretch + sz and high + wide + slack >= base + sz):
                ends = [np.clip(v - sz - base, -5e-7, stretch + 5e-7) + (qx * fine + qy) * apart for v in (low - up, high + up)]
                b0, b1 = np.searchsorted(key, ends[0]), np.searchsorted(key, ends[1], "right")
                some = np.flatnonzero(b1 > b0)
                runs.append((b0[some], (b1 - b0)[some], gap2[some], home[some], sx[some], sy[some], np.full(len(some), sz)))
        b0, many, gap2, home, *shift = (np.concatenate(r) for r in zip(*runs, strict=True))
        order = np.argsort(gap2, kind="stable")
        for own in (True, False):
            these = order[home[order] == own] if half else order
            if not len(these) or (not half and own):
                continue
            n = many[these]
            spread = lambda v, n=n, these=these: np.repeat(v[these], n)
            b = spread(b0) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            moved = tuple(spread(s).astype(np.float64) if s[these].any() else None for s in shift)
            yield Visit(left, right, np.arange(a0, a1), b, moved, spread(gap2), auto and (own or not half), far)


def parted(visits: Iterator[Visit], column: str) -> Iterator[tuple[int, int, Visit]]:
    """Visits by the values of a column at both ends."""
    for v in visits:
        ones, twos = v.left[column][v.a], v.right[column][v.b]
        for one in np.unique(ones):
            for two in np.unique(twos):
                b = twos == two
                shift = tuple(None if s is None else s[b] for s in v.shift)
                yield int(one), int(two), replace(v, a=v.a[ones == one], b=v.b[b], shift=shift, gap2=v.gap2[b])


def meetings(visits: Iterator[Visit]) -> Iterator[Meeting]:
    """Visits in parts of ``MEETING`` elements, measured."""
    space = [np.empty(MEETING) for _ in range(5)]
    for v in visits:
        step = max(1, MEETING // len(v.a))
        for first in range(0, len(v.b), step):
            part = slice(first, first + step)
            b = v.b[part]
            shape = (len(v.a), len(b))
            *d, r2, t = (s[: shape[0] * shape[1]].reshape(shape) for s in space)
            other = None  # pairs whose nearest image is another one
            for out, c, shift in zip(d, AXES, v.shift, strict=True):
                np.subtract(v.left[c][v.a][:, None], v.right[c][b][None], out=out)
                if v.far:
                    np.floor(np.add(out, 0.5, out=t), out=t)
                    wrong = t != (0.0 if shift is None else shift[part][None])
                    other = wrong if other is None else other | wrong
                if shift is not None:
                    np.subtract(out, shift[part][None], out=out)
            np.multiply(d[0], d[0], out=r2)
            for x in d[1:]:
                np.multiply(x, x, out=t)
                np.add(r2, t, out=r2)
            if other is not None:
                r2[other] = np.inf
            if v.own:
                r2[v.left["id"][v.a][:, None] >= v.right["id"][b][None]] = np.inf
            yield Meeting(v.left, v.right, v.a, b, tuple(d), r2, float(v.gap2[first]))


def count_below(v: Visit, edges: list[float], rows: np.ndarray | None = None) -> np.ndarray:
    """Numbers of pairs whose squared distance lies below each edge; with ``rows``, where stretches of left rows start, a row a stretch.

    Distances are taken in single precision about the left rows' middle, as one product of matrices; those so near to an
    edge that its error could matter are taken again in full, so the numbers are exact.
    """
    starts = np.zeros(1, np.int64) if rows is None else rows
    below = np.zeros((len(starts), len(edges)), np.int64)
    stretches = list(enumerate(zip(starts.tolist(), [*starts[1:].tolist(), len(v.a)], strict=True)))

    def add(i: int, flags: np.ndarray) -> int:
        total = 0
        for k, (start, end) in stretches:
            n = np.count_nonzero(flags[start:end])
            below[k, i] += n
            total += n
        return total

    if v.own or v.far:
        for m in meetings(iter((v,))):
            for i, e in enumerate(edges):
                if e > m.gap2:
                    add(i, m.r2 < e)
        return below[0] if rows is None else below
    ends = []
    for side, at, shift in ((v.left, v.a, (None,) * 3), (v.right, v.b, v.shift)):
        ends.append([side[c][at] if s is None else side[c][at] + s for c, s in zip(AXES, shift, strict=True)])
    middle = [(x.min() + x.max()) / 2 for x in ends[0]]
    p, q = (np.stack([x - m for x, m in zip(end, middle, strict=True)]) for end in ends)
    p2, q2 = (np.einsum("ij,ij->j", x, x) for x in (p, q))
    error = 1e-6 * (math.sqrt(p2.max()) + math.sqrt(q2.max())) ** 2  # eight roundings of 6e-8 at most, and twice that
    one = np.concatenate([-2.0 * p, p2[None], np.ones((1, len(p2)))]).T.astype(np.float32)
    two = np.concatenate([q, np.ones((1, len(q2))), q2[None]]).astype(np.float32)
    step = max(1, MEETING // len(p2))
    space, flags = np.empty(step * len(p2), np.float32), [np.empty(step * len(p2), bool) for _ in range(2)]
    for first in range(0, len(q2), step):
        m = min(step, len(q2) - first)
        r2 = np.matmul(one, two[:, first : first + m], out=space[: len(p2) * m].reshape(len(p2), m))
        sure, may = (f[: len(p2) * m].reshape(len(p2), m) for f in flags)
        for i, e in enumerate(edges):
            if e <= v.gap2[first]:
                continue
            n, n_may = add(i, np.less(r2, e - error, out=sure)), np.count_nonzero(np.less(r2, e + error, out=may))
            if n_may > n:
                open_ = np.logical_xor(sure, may, out=may)
                j = np.flatnonzero(open_.any(1))
                k, b = np.nonzero(open_[j])
                row = j[k]
                k, b = v.a[row], first + b
                exact = 0.0
                for c, shift in zip(AXES, v.shift, strict=True):
                    x = v.left[c][k] - v.right[c][v.b[b]]
                    x = x if shift is None else x - shift[b]
                    exact = exact + x * x
                below[:, i] += np.bincount(np.searchsorted(starts, row[exact < e], "right") - 1, minlength=len(starts))
    return below[0] if rows is None else below


def count_between(v: Visit, edges: list[float], column: str) -> Iterator[tuple[int, int, np.ndarray]]:
    """(left value, right value, numbers of pairs below each edge) by the values of a column at both ends.

    All left rows, sorted by their value, meet the right rows of one value together, so values that lie mixed cost little more.
    """
    ones, twos = v.left[column][v.a], v.right[column][v.b]
    order = np.argsort(ones, kind="stable")
    values, rows = np.unique(ones[order], return_index=True)
    for two in np.unique(twos):
        b = np.flatnonzero(twos == two)
        shift = tuple(None if s is None else s[b] for s in v.shift)
        found = count_below(replace(v, a=v.a[order], b=v.b[b], shift=shift, gap2=v.gap2[b]), edges, rows)
        for one, below in zip(values.tolist(), found, strict=True):
            yield one, int(two), below


_rooms: dict[str, np.ndarray] = {}


def room(name: str, shape: tuple[int, ...], dtype: type) -> np.ndarray:
    """Space that is used again: fresh arrays of this size cost more than much that is worked out in them."""
    size = math.prod(shape)
    if name not in _rooms or len(_rooms[name]) < size:
        _rooms[name] = np.empty(size, dtype)
    return _rooms[name][:size].reshape(shape)


@dataclass(frozen=True)
class Plane:
    """Even bins, folded, of a pair's separation and of its cosine to an axis; ``across``: of the separations across and along the axis."""

    along: int
    across: bool
    low: float  # where the first measure's bins start; the second's start at 0
    steps: tuple[float, float]
    bins: tuple[int, int]


def count_plane(v: Visit, plane: Plane, exact: Callable[[np.ndarray, list[np.ndarray]], np.ndarray]) -> np.ndarray | None:
    """Numbers of pairs by first and second bin, None if single precision does not do or does not pay.

    Measures are placed in single precision, in parts of a bin. Pairs within half a part of an edge, or too near for that, are
    measured again in full: ``exact`` gives the codes (first bin times the number of second bins, plus the second) of those that
    have bins, from squared separations and separations.
    """
    if v.far or len(v.a) * len(v.b) < FEW:
        return None
    ends = [np.stack([rows[c][at] if s is None else rows[c][at] + s for c, s in zip(AXES, shift, strict=True)]) for rows, at, shift in ((v.left, v.a, (None,) * 3), (v.right, v.b, v.shift))]
    middle = ((ends[0].min(1) + ends[0].max(1)) / 2)[:, None]
    p, q = ((x - middle).astype(np.float32) for x in ends)
    used, c = [i for i in range(3) if not (plane.across and i == plane.along)], plane.along
    p2, q2 = (np.einsum("ij,ij->j", x[used], x[used], dtype=np.float64) for x in (p, q))
    far, height = math.sqrt(p2.max()) + math.sqrt(q2.max()), float(np.abs(p[c]).max() + np.abs(q[c]).max())
    # Squares are off by twelve roundings of 6e-8 at most and kept above 0, separations by three.
    error, off = 8e-7 * far * far, 2e-7 * height
    offset = int(plane.low > 0)
    most = (int(max(far / plane.steps[0], plane.bins[0])) + 3, int(max(height / plane.steps[1], 0) if plane.across else plane.bins[1]) + 3)
    codes = most[0] * most[1] + 1
    parts = min(PARTS[plane.across], 1 << int(math.log2(65_000 / max(most))))
    least = 4 * error * parts / plane.steps[0]
    if not plane.across:
        least = max(least, math.sqrt(4 * error * parts / plane.steps[1]))
    if parts < 64 or codes > CODES or least > 0.5 * plane.steps[0] * plane.bins[0] or off * parts / plane.steps[1] > 0.1 * (1 if plane.across else least):
        return None
    rows, paired = -(-len(p2) // 2) * 2, codes**2 <= CODES
    beyond = np.float32((plane.low + (plane.bins[0] + 0.5) * plane.steps[0]) ** 2)
    one = np.zeros((rows, len(used) + 2))
    one[:, -2] = beyond  # rows that fill up
    one[: len(p2)] = np.stack([*(-2.0 * p[used].astype(np.float64)), p2 + error, np.ones(len(p2))], 1)
    one, two = one.astype(np.float32), np.stack([*q[used], np.ones(len(q2)), q2]).astype(np.float32)
    tall = np.zeros((rows, 1), np.float32)
    tall[: len(p2), 0] = p[c]
    step = max(8, PLACING // rows)
    marks, pairs = room("marks", (rows * len(q2),), bool), room("pairs", (rows // (1 + paired) * len(q2),), np.intp)
    floats, words, flags = (room(name, (k, rows * step), t) for name, k, t in (("floats", 2, np.float32), ("words", 3, np.uint16), ("flags", 1, bool)))
    for first in range(0, len(q2), step):
        m = min(step, len(q2) - first)
        r, d, at, other, rest, more = (x[: rows * m].reshape(rows, m) for x in (*floats, *words, *flags))
        mark = marks[rows * first : rows * (first + m)].reshape(rows, m)
        np.matmul(one, two[:, first : first + m], out=r)
        if v.own:
            np.copyto(r[: len(p2)], beyond, where=v.left["id"][v.a][:, None] >= v.right["id"][v.b[first : first + m]][None])
        np.sqrt(r, out=r)
        np.less(r, np.float32(least), out=mark)
        np.abs(np.subtract(tall, q[c, first : first + m][None], out=d), out=d)
        if not plane.across:
            np.divide(d, r, out=d)
        # With half a part added, what is that near to an edge on either side lies in the part that starts there.
        for x, step_, start, code in ((r, plane.steps[0], offset * plane.steps[0] - plane.low, at), (d, plane.steps[1], 0.0, other)):
            np.multiply(x, np.float32(parts / step_), out=x)
            np.add(x, np.float32(start * parts / step_ + 0.5), out=x)
            np.copyto(code, x, casting="unsafe")
            np.equal(np.bitwise_and(code, np.uint16(parts - 1), out=rest), np.uint16(0), out=more)
            np.bitwise_or(mark, more, out=mark)
            np.right_shift(code, np.uint16(parts.bit_length() - 1), out=code)
        np.add(np.multiply(at, np.uint16(most[1]), out=at), other, out=at)
        np.copyto(at, np.uint16(codes - 1), where=mark)
        if paired:  # two rows' codes are counted as one number
            np.add(np.multiply(at[: rows // 2], np.uint16(codes), out=other[: rows // 2]), at[rows // 2 :], out=rest[: rows // 2])
            at = rest[: rows // 2]
        pairs[len(at) * first : len(at) * (first + m)] = at.reshape(-1)
    n = np.bincount(pairs, minlength=codes ** (1 + paired)).reshape([codes] * (1 + paired))
    n = n.sum(0) + n.sum(1) if paired else n
    n = n[:-1].reshape(most)[offset : offset + plane.bins[0], : plane.bins[1]].copy()
    part, at = np.divmod(np.flatnonzero(marks), rows * step)
    k, b = np.divmod(at, np.minimum(step, len(q2) - part * step))
    b += part * step
    here = k < len(p2)
    k, b = v.a[k[here]], b[here]
    if v.own:
        here = v.left["id"][k] < v.right["id"][v.b[b]]
        k, b = k[here], b[here]
    d = [v.left[c][k] - v.right[c][v.b[b]] - (0.0 if s is None else s[b]) for c, s in zip(AXES, v.shift, strict=True)]
    return n + np.bincount(exact(d[0] * d[0] + d[1] * d[1] + d[2] * d[2], d), minlength=n.size).reshape(n.shape)


def _bricked(df: DataFrame, keep: tuple[str, ...], n: int, below: dict[str, float], above: dict[str, float], periodic: bool) -> DataFrame:
    """Rows (id, x, y, z, keep) once for each brick between ``below`` and ``above`` them on each axis, as column brick.

    Rows without a place are left out; in a periodic box the others are moved into it.
    """
    rows = df.select("id", *[F.col(c).cast("double").alias(c) for c in AXES], *keep)
    for c in AXES:
        rows = rows.where(F.abs(c) < math.inf)  # false for NaN
    if periodic:
        rows = rows.withColumns({c: F.when((F.col(c) < 0) | (F.col(c) >= 1), F.col(c) - F.floor(c)).otherwise(F.col(c)) for c in AXES})
    brick = F.lit(0)
    for c in AXES:
        at = F.floor((F.col(c) - below[c]) * n)
        if below[c] or above[c]:
            at = F.explode(F.sequence(at, F.least(F.floor((F.col(c) + above[c]) * n), at + (n - 1))))
        rows = rows.withColumn(f"__{c}", at)
        brick = brick * n + F.pmod(f"__{c}", F.lit(n))
    # Columns of its own for each side, as both may come from one table.
    return rows.select(*[F.col(c).alias(c) for c in ("id", *AXES, *keep)], brick.cast("int").alias("brick"))


def _spread(rows: DataFrame, counts: dict[int, tuple[int, int]], mine: str, other: str) -> DataFrame:
    """Columns way and share: a row gets one of its own side's parts of its brick and meets all of the other's."""
    n = {"way": F.lit(1), "share": F.lit(1)}
    if counts:
        plan = rows.sparkSession.createDataFrame([(b, w, s) for b, (w, s) in counts.items()], "brick int, ways int, shares int")
        rows = rows.join(F.broadcast(plan), "brick", "left")  # a row a crowded brick
        n = {"way": F.coalesce("ways", F.lit(1)), "share": F.coalesce("shares", F.lit(1))}
    rows = rows.withColumn(mine, F.pmod(F.xxhash64("id", *AXES), n[mine]).cast("int"))
    return rows.withColumn(other, F.explode(F.sequence(F.lit(0), n[other] - 1))).drop("ways", "shares")


def over_pairs(left: DataFrame, right: DataFrame | None, reach: float, per_task: Callable[[Iterator[Visit]], pd.DataFrame], schema: str, keep: tuple[str, ...] = (), keep_right: tuple[str, ...] | None = None, periodic: bool = True) -> DataFrame:
    """The rows that ``per_task`` makes of each task's visits; positions in the unit box.

    ``right`` None pairs the catalogue with itself, each unordered pair once (unique ids); otherwise all ordered pairs.
    A visit also holds pairs beyond the reach.
    """
    auto = right is None
    rows = left.count()
    others = rows if auto else right.count()
    # Pencils so thick that the points of a chunk fill a cube.
    pencils = max(1, min(512, round(min(8.0, max(0.25, reach * (max(rows, 1) / CHUNK) ** (1 / 3))) / reach)))
    n = max(1, min(int(1 / reach), max(4 if rows > 40_000 else 2, round((rows / BRICK_ROWS) ** (1 / 3)))))
    wide, nothing = reach * (1 + 1e-9) + 1e-12, dict.fromkeys(AXES, 0.0)
    ahead = dict.fromkeys(AXES, wide)
    if auto and periodic and _halved(reach):
        ahead["x"] = min(wide, 1.0 / pencils + 1e-12)  # pairs are counted at the end whose pencil comes first
    lefts = _bricked(left, keep, n, nothing, nothing, periodic)
    rights = _bricked(left if auto else right, keep if keep_right is None else keep_right, n, dict.fromkeys(AXES, wide), ahead, periodic)
    crowded: dict[int, tuple[int, int]] = {}
    if max(rows, others) > min(LEFT_ROWS, RIGHT_ROWS):
        sizes = {k: dict(df.groupBy("brick").count().collect()) for k, df in (("l", lefts), ("r", rights))}  # a row a brick
        for brick, m in sizes["l"].items():
            parts = -(-m // LEFT_ROWS), -(-sizes["r"].get(brick, 0) // RIGHT_ROWS) or 1
            if parts != (1, 1):
                crowded[brick] = parts
    tasks = max(1, min(2000, n**3 + sum(w * s for w, s in crowded.values())))
    lefts = _spread(lefts, crowded, "way", "share").repartition(tasks, *_KEYS)
    rights = _spread(rights, crowded, "share", "way").repartition(tasks, *_KEYS)

    def meet(lefts: pd.DataFrame, rights: pd.DataFrame) -> pd.DataFrame:
        lefts, rights = lefts.drop(columns=_KEYS), rights.drop(columns=_KEYS)
        return per_task(visits(lefts, rights, reach, pencils, auto, periodic) if len(lefts) and len(rights) else iter(()))

    return lefts.groupBy(*_KEYS).cogroup(rights.groupBy(*_KEYS)).applyInPandas(meet, schema)
