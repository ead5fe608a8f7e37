"""Geometry as column expressions: everything stays in generated code."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

XYZ = ("x", "y", "z")


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def finite(c: str | Column) -> Column:
    """Neither null, NaN nor infinite; ``isnan`` alone lets infinities pass."""
    c = col(c)
    return F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False))


def all_finite(cols=XYZ) -> Column:
    out = F.lit(True)
    for c in cols:
        out = out & finite(c)
    return out


def square_sum(cols=XYZ) -> Column:
    a, *rest = [col(c) * col(c) for c in cols]
    for r in rest:
        a = a + r
    return a


def norm(cols=XYZ) -> Column:
    return F.sqrt(square_sum(cols))


def dot(a, b) -> Column:
    parts = [col(x) * (y if isinstance(y, (int, float)) else col(y)) for x, y in zip(a, b, strict=True)]
    out = parts[0]
    for p in parts[1:]:
        out = out + p
    return out


def unit(v: tuple[float, float, float]) -> tuple[float, ...]:
    length = math.sqrt(sum(x * x for x in v))
    if length < 1e-12:
        raise ValueError("a vector of no length has no direction")
    return tuple(x / length for x in v)


def plane_distance(plane: tuple[float, float, float, float]) -> Column:
    """Signed distance of a point to the plane n p + d = 0."""
    return dot(XYZ, plane[:3]) + F.lit(plane[3])


def clipped(c: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(c, F.lit(low)), F.lit(high))


def angle_degrees(cosine: Column) -> Column:
    return F.degrees(F.acos(clipped(cosine, -1.0, 1.0)))


def quaternion_matrix(qx, qy, qz, qw) -> list[list[Column]]:
    x, y, z, w = (col(q) for q in (qx, qy, qz, qw))
    return [
        [1 - 2 * (y * y + z * z), 2 * (x * y - z * w), 2 * (x * z + y * w)],
        [2 * (x * y + z * w), 1 - 2 * (x * x + z * z), 2 * (y * z - x * w)],
        [2 * (x * z - y * w), 2 * (y * z + x * w), 1 - 2 * (x * x + y * y)],
    ]


def matrix_quaternion(m: list[list[Column]]) -> list[Column]:
    """x, y, z, w of a rotation matrix; the branch follows the largest of trace and diagonal."""
    trace = m[0][0] + m[1][1] + m[2][2]
    s0 = F.sqrt(F.greatest(trace + 1, F.lit(0.0))) * 2
    s = [F.sqrt(F.greatest(1 + m[i][i] - m[(i + 1) % 3][(i + 1) % 3] - m[(i + 2) % 3][(i + 2) % 3], F.lit(0.0))) * 2 for i in range(3)]
    over = lambda a, b: F.try_divide(a, b)
    cases = [
        (trace > 0, [over(m[2][1] - m[1][2], s0), over(m[0][2] - m[2][0], s0), over(m[1][0] - m[0][1], s0), s0 / 4]),
        ((m[0][0] > m[1][1]) & (m[0][0] > m[2][2]), [s[0] / 4, over(m[0][1] + m[1][0], s[0]), over(m[0][2] + m[2][0], s[0]), over(m[2][1] - m[1][2], s[0])]),
        (m[1][1] > m[2][2], [over(m[0][1] + m[1][0], s[1]), s[1] / 4, over(m[1][2] + m[2][1], s[1]), over(m[0][2] - m[2][0], s[1])]),
        (F.lit(True), [over(m[0][2] + m[2][0], s[2]), over(m[1][2] + m[2][1], s[2]), s[2] / 4, over(m[1][0] - m[0][1], s[2])]),
    ]
    out = []
    for k in range(4):
        when = F
        for test, values in cases:
            when = when.when(test, values[k])
        out.append(when)
    return out


def quaternion_product(a, b) -> list[Column]:
    ax, ay, az, aw = (col(c) for c in a)
    bx, by, bz, bw = (col(c) for c in b)
    return [aw * bx + ax * bw + ay * bz - az * by, aw * by - ax * bz + ay * bw + az * bx, aw * bz + ax * by - ay * bx + az * bw, aw * bw - ax * bx - ay * by - az * bz]


def rotate(m, p) -> list[Column]:
    return [sum((m[i][j] * col(p[j]) for j in range(1, 3)), m[i][0] * col(p[0])) for i in range(3)]


def rpy_matrix(roll: float, pitch: float, yaw: float) -> list[list[float]]:
    """Rz(yaw) Ry(pitch) Rx(roll)."""
    cr, sr, cp, sp, cy, sy = math.cos(roll), math.sin(roll), math.cos(pitch), math.sin(pitch), math.cos(yaw), math.sin(yaw)
    return [[cy * cp, cy * sp * sr - sy * cr, cy * sp * cr + sy * sr], [sy * cp, sy * sp * sr + cy * cr, sy * sp * cr - cy * sr], [-sp, cp * sr, cp * cr]]


def rotation_degrees(m) -> Column:
    return angle_degrees((m[0][0] + m[1][1] + m[2][2] - 1) / 2)


def eigenvalues(c: dict[str, Column]) -> list[Column]:
    """Ascending eigenvalues of a symmetric 3 x 3 matrix given as xx, xy, xz, yy, yz, zz, in closed form."""
    q = (c["xx"] + c["yy"] + c["zz"]) / 3
    off = c["xy"] * c["xy"] + c["xz"] * c["xz"] + c["yz"] * c["yz"]
    a, b, d = c["xx"] - q, c["yy"] - q, c["zz"] - q
    p = F.sqrt(F.greatest((a * a + b * b + d * d + 2 * off) / 6, F.lit(0.0)))
    det = a * (b * d - c["yz"] * c["yz"]) - c["xy"] * (c["xy"] * d - c["yz"] * c["xz"]) + c["xz"] * (c["xy"] * c["yz"] - b * c["xz"])
    phi = F.acos(clipped(F.coalesce(F.try_divide(det, 2 * p * p * p), F.lit(1.0)), -1.0, 1.0)) / 3
    top = q + 2 * p * F.cos(phi)
    low = q + 2 * p * F.cos(phi + 2 * math.pi / 3)
    return [low, 3 * q - top - low, top]


#: Eigenvalues nearer to each other than this part of the largest are one.
EIGEN_GAP = 1e-9


def _annihilated(c: dict[str, Column], p: Column, q: Column) -> list[list[Column]]:
    """The rows of (A - p)(A - q): what is left of A lies along the eigenvectors of neither p nor q."""
    a = [[c["xx"], c["xy"], c["xz"]], [c["xy"], c["yy"], c["yz"]], [c["xz"], c["yz"], c["zz"]]]
    return [[a[i][0] * a[0][j] + a[i][1] * a[1][j] + a[i][2] * a[2][j] - (p + q) * a[i][j] + (p * q if i == j else F.lit(0.0)) for j in range(3)] for i in range(3)]


def _column_of_largest(m: list[list[Column]]) -> Column:
    """Of a symmetric matrix of rank one the column with the largest diagonal, scaled to length one; null if it vanishes."""
    best = F.greatest(*[F.struct(F.abs(m[i][i]).alias("s"), F.array(*m[i]).alias("v")) for i in range(3)])["v"]
    length = F.sqrt(F.aggregate(best, F.lit(0.0), lambda s, x: s + x * x))
    return F.when(length > 0, F.transform(best, lambda x: x / length))


def with_eigen(df: DataFrame, c: dict[str, Column]) -> DataFrame:
    """``df`` with eigenvalues l0, l1, l2, ascending, and ``normal``, a unit eigenvector of the least.

    Where the least stands apart, what the other two annihilate leaves its eigenvector. Where
    the two least are one (points on a line) any direction across the line is right: the one across the axis that the line
    leans to least. Where all are one it is the z axis; null where nothing spreads.
    """
    df = df.withColumns({f"l{i}": v for i, v in enumerate(eigenvalues(c))})
    l0, l1, l2 = (F.col(f"l{i}") for i in range(3))
    df = df.withColumns({"__own": _column_of_largest(_annihilated(c, l1, l2)), "__line": _column_of_largest(_annihilated(c, l0, l1))})
    x, y, z = (F.col("__line")[i] for i in range(3))
    across = F.when((F.abs(x) <= F.abs(y)) & (F.abs(x) <= F.abs(z)), F.array(F.lit(0.0), z, -y)).when(F.abs(y) <= F.abs(z), F.array(-z, F.lit(0.0), x)).otherwise(F.array(y, -x, F.lit(0.0)))
    df = df.withColumn("__across", across)
    length = F.sqrt(F.aggregate("__across", F.lit(0.0), lambda s, v: s + v * v))
    level = F.array(F.lit(0.0), F.lit(0.0), F.lit(1.0))
    normal = (
        F.when(~(l2 > 0), None).when((l1 - l0 > EIGEN_GAP * l2) & F.col("__own").isNotNull(), F.col("__own"))
        .when((l2 - l1 > EIGEN_GAP * l2) & F.col("__line").isNotNull(), F.transform("__across", lambda v: v / length)).otherwise(level)
    )
    return df.withColumn("normal", normal).drop("__own", "__line", "__across")


def shape_features(values: list[Column]) -> dict[str, Column]:
    """curvature, linearity, planarity, scattering from ascending eigenvalues, clamped at 0; null where nothing spreads."""
    l0, l1, l2 = (F.greatest(v, F.lit(0.0)) for v in values)
    total = l0 + l1 + l2
    return {
        "curvature": F.when(total > 0, l0 / total).otherwise(0.0),
        "linearity": F.try_divide(l2 - l1, l2), "planarity": F.try_divide(l1 - l0, l2), "scattering": F.try_divide(l0, l2),
    }


def dominant_shape(linearity: Column, planarity: Column, scattering: Column) -> Column:
    best = F.greatest(linearity, planarity, scattering)
    known = linearity.isNotNull() & planarity.isNotNull() & scattering.isNotNull()
    return F.when(~known, "unknown").when(linearity == best, "linear").when(planarity == best, "planar").otherwise("scattered")


def voxel_keys(size: float, cols=XYZ, float32: bool = False) -> list[Column]:
    """floor(p / size) by axis; in single precision if asked for, where Spark would widen the quotient."""
    if size <= 0:
        raise ValueError("a voxel has a size above 0")
    if float32:
        return [F.floor((F.col(c).cast("float") / F.lit(size).cast("float")).cast("float")).cast("long").alias(f"i{c}") for c in cols]
    return [F.floor(F.col(c) / F.lit(float(size))).cast("long").alias(f"i{c}") for c in cols]


def pinhole(camera: dict, cols=XYZ) -> tuple[Column, Column, Column]:
    """u, v and whether they mean something; a point at or behind the camera has none."""
    x, y, z = (F.col(c) for c in cols)
    good = F.coalesce(all_finite(cols) & (z > 0), F.lit(False))
    at = lambda f, p, c: F.when(good, F.lit(f) * F.try_divide(p, z) + F.lit(c))
    return at(camera["fx"], x, camera["cx"]), at(camera["fy"], y, camera["cy"]), good


def distorted(camera: dict, min_depth: float, cols=XYZ) -> tuple[Column, Column, Column]:
    """As pinhole, with radial and tangential distortion; the depth must lie beyond ``min_depth``."""
    k1, k2, p1, p2, k3 = [*camera.get("distortion", ()), 0, 0, 0, 0, 0][:5] if camera.get("model", "plumb_bob") in ("plumb_bob", "rational_polynomial") else [0] * 5
    x, y, z = (F.col(c) for c in cols)
    good = F.coalesce(all_finite(cols) & (z > min_depth), F.lit(False))
    a, b = F.try_divide(x, z), F.try_divide(y, z)
    r2 = a * a + b * b
    radial = 1 + k1 * r2 + k2 * r2 * r2 + k3 * r2 * r2 * r2
    u = a * radial + 2 * p1 * a * b + p2 * (r2 + 2 * a * a)
    v = b * radial + p1 * (r2 + 2 * b * b) + 2 * p2 * a * b
    return F.when(good, camera["fx"] * u + camera["cx"]), F.when(good, camera["fy"] * v + camera["cy"]), good


def iou(a: str, b: str) -> Column:
    """Overlap of two boxes (x, y, w, h) of the columns of aliases ``a`` and ``b``, over their union; 0 if apart."""
    ca, cb = (lambda n: F.col(f"{a}.{n}")), (lambda n: F.col(f"{b}.{n}"))
    w = F.greatest(F.lit(0), F.least(ca("x") + ca("w"), cb("x") + cb("w")) - F.greatest(ca("x"), cb("x")))
    h = F.greatest(F.lit(0), F.least(ca("y") + ca("h"), cb("y") + cb("h")) - F.greatest(ca("y"), cb("y")))
    inter = (w * h).cast("double")
    return F.coalesce(F.try_divide(inter, ca("w") * ca("h") + cb("w") * cb("h") - inter), F.lit(0.0))


def slerp(a, b, part: Column) -> list[Column]:
    """The unit quaternion between ``a`` and ``b`` on the shorter arc; straight and scaled to length one where they nearly agree."""
    d = dot(a, b)
    sign = F.when(d < 0, -1.0).otherwise(1.0)
    angle = F.acos(clipped(F.abs(d), 0.0, 1.0))
    near = angle < 1e-4
    wa = F.when(near, 1 - part).otherwise(F.try_divide(F.sin((1 - part) * angle), F.sin(angle)))
    wb = F.when(near, part).otherwise(F.try_divide(F.sin(part * angle), F.sin(angle))) * sign
    raw = [wa * col(x) + wb * col(y) for x, y in zip(a, b, strict=True)]
    length = F.sqrt(square_sum(raw))
    return [r / length for r in raw]


def plane_basis(normal: tuple[float, float, float]) -> tuple[tuple, tuple]:
    """Two unit vectors that span the plane across a normal. The x axis helps, unless the normal lies along it."""
    n = unit(normal)
    h = (1.0, 0.0, 0.0) if abs(n[0]) < 0.9 else (0.0, 1.0, 0.0)
    cross = lambda a, b: (a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0])
    u = unit(cross(n, h))
    return u, cross(n, u)


# Factor and start of each channel of a class colour, modulo 256.
CLASS_COLOR = {"r": (193, 37), "g": (97, 113), "b": (53, 71)}


def class_color(class_id: Column) -> dict[str, Column]:
    return {c: (class_id.cast("long") * k + s) % 256 for c, (k, s) in CLASS_COLOR.items()}


def corner(center: list[Column], extent: list[Column], number: Column) -> list[Column]:
    """Corner 0 to 7 of an axis-aligned box: bit i of the number says on which side of axis i."""
    return [c + e / 2 * (2 * F.shiftright(number, i).bitwiseAND(F.lit(1)) - 1) for i, (c, e) in enumerate(zip(center, extent, strict=True))]


def ramp(value: Column, low: Column, high: Column) -> Column:
    """Where a value lies between two others, from 0 to 1."""
    return clipped(F.coalesce(F.try_divide(value - low, high - low), F.lit(0.0)), 0.0, 1.0)


#: The part of a turn by which one number's hue lies from the next one's.
GOLDEN = 0.618033988749895


def golden_hue(number: Column) -> Column:
    """A hue from 0 to 1 for each number; near numbers have hues far apart."""
    return (number * GOLDEN) % 1.0
