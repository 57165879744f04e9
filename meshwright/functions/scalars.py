"""Column expressions of the field data; all stay inside whole-stage code generation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def finite(x: Column) -> Column:
    """Neither NULL, NaN nor infinite."""
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))


def nan_to_null(x: Column) -> Column:
    return F.when(~F.isnan(x), x)


def clip(x: Column, low: float | None = None, high: float | None = None) -> Column:
    x = x if low is None else F.greatest(x, F.lit(low))
    return x if high is None else F.least(x, F.lit(high))


def close(a: Column, b: Column, rel: float = 0.0, tol: float = 1e-12) -> Column:
    return F.abs(a - b) <= F.greatest(F.lit(rel) * F.greatest(F.abs(a), F.abs(b)), F.lit(tol))


def percent_change(before: Column, after: Column, floor: float = 1e-12) -> Column:
    return 100 * F.abs(after - before) / F.greatest(F.abs(before), F.lit(floor))


def any_null(*xs: Column) -> Column:
    return reduce(lambda a, b: a | b, [x.isNull() for x in xs])


def one_hot(x: Column, vocabulary: tuple[str, ...], prefix: str) -> list[Column]:
    return [F.coalesce((x == v).cast("double"), F.lit(0.0)).alias(f"{prefix}_{v}") for v in vocabulary]


def turns(at: Column, cell: Column, phase: Column) -> Column:
    """A place along an axis as an angle of a periodic surface of this cell size."""
    return 2 * F.pi() * at / cell + phase


def tpms_of(architecture: Column, a: tuple[Column, Column], b: tuple[Column, Column], c: tuple[Column, Column]) -> Column:
    """The implicit field of a triply periodic surface, from the sine and cosine of each axis's angle."""
    (sa, ca), (sb, cb), (sc, cc) = a, b, c
    gyroid = sa * cb + sb * cc + sc * ca
    diamond = sa * sb * sc + sa * cb * cc + ca * sb * cc + ca * cb * sc
    return F.when(architecture == "gyroid", gyroid).when(architecture == "diamond", diamond).when(architecture == "primitive", ca + cb + cc)


def tpms(architecture: Column, x: Column, y: Column, z: Column, cell: Column, px: Column, py: Column, pz: Column) -> Column:
    """The implicit field of a triply periodic surface at a point."""
    return tpms_of(architecture, *[(F.sin(t), F.cos(t)) for t in (turns(v, cell, p) for v, p in ((x, px), (y, py), (z, pz)))])


def grading(mode: Column, z01: Column) -> Column:
    """The grading profile at relative height z01."""
    return F.when(mode == "linear", 2 * z01 - 1).when(mode == "sinusoidal", F.sin(2 * F.pi() * z01)).otherwise(F.lit(0.0))


def norm(*xs: Column) -> Column:
    return F.sqrt(reduce(lambda a, b: a + b, [x * x for x in xs]))


def cross(a: tuple, b: tuple) -> tuple[Column, Column, Column]:
    return a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]


def minus(a: tuple, b: tuple) -> tuple:
    return tuple(p - q for p, q in zip(a, b, strict=True))


def tet_volume(p0: tuple, p1: tuple, p2: tuple, p3: tuple) -> Column:
    a, n = minus(p1, p0), cross(minus(p2, p0), minus(p3, p0))
    return F.abs(a[0] * n[0] + a[1] * n[1] + a[2] * n[2]) / 6


def tet_edges(p: list[tuple]) -> list[Column]:
    return [norm(*minus(p[i], p[j])) for i in range(4) for j in range(i + 1, 4)]


def tet_quality(p: list[tuple]) -> Column:
    """1 for a regular tetrahedron, towards 0 for a flat one."""
    squares = reduce(lambda a, b: a + b, [e * e for e in tet_edges(p)])
    return 12 * F.pow(3 * tet_volume(*p), F.lit(2 / 3)) / F.greatest(squares, F.lit(1e-30))


def tet_edge_ratio(p: list[tuple]) -> Column:
    e = tet_edges(p)
    return F.greatest(*e) / F.greatest(F.least(*e), F.lit(1e-30))


def von_mises(xx: Column, yy: Column, zz: Column, xy: Column, yz: Column, zx: Column) -> Column:
    d = (xx - yy) * (xx - yy) + (yy - zz) * (yy - zz) + (zz - xx) * (zz - xx)
    return F.sqrt(0.5 * d + 3 * (xy * xy + yz * yz + zx * zx))


def equivalent_strain(xx: Column, yy: Column, zz: Column, gxy: Column, gyz: Column, gzx: Column) -> Column:
    """From engineering shears, which count half."""
    m = (xx + yy + zz) / 3
    normal = (xx - m) * (xx - m) + (yy - m) * (yy - m) + (zz - m) * (zz - m)
    return F.sqrt(2 / 3 * (normal + 0.5 * (gxy * gxy + gyz * gyz + gzx * gzx)))


def azimuth_polar(dx: Column, dy: Column, dz: Column) -> tuple[Column, Column]:
    return F.atan2(dy, dx), F.acos(clip(F.try_divide(dz, norm(dx, dy, dz)), -1.0, 1.0))


def affine(point: tuple, matrix: list[list[float]]) -> tuple[Column, ...]:
    """A point's image under the first three rows of a 4 x 4 matrix."""
    return tuple(sum((F.lit(float(m)) * p for m, p in zip(row[:3], point, strict=True)), F.lit(float(row[3]))) for row in matrix[:3])


def iso_timestamp(x: Column) -> Column:
    """A timestamp as text: yyyy-MM-ddTHH:mm:ss."""
    return F.date_format(x, "yyyy-MM-dd'T'HH:mm:ss")
