"""Geometry as Column expressions: chunk grid, quaternions, rigid poses, cameras.  No UDFs.

Vectors have fields x, y, z; quaternions w, x, y, z; poses w, x, y, z, tx, ty, tz.  Every function takes
them as struct Columns or as ``Fields`` (a plain mapping of Columns) and returns ``Fields``: reading a
field of a struct that is still an expression would copy the whole struct, and the plan would grow with
every step.  3x3 matrices are lists of nine Columns, row by row; 4x4 matrices lists of sixteen.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Chunk ids hold 21 bits an axis, offset by 2^20.
AXIS_BITS, AXIS_OFFSET = 21, 1 << 20


class Fields(dict):
    """Named Columns that become a struct when they are given a name."""

    def alias(self, name: str) -> Column:
        return self.struct().alias(name)

    def struct(self) -> Column:
        return F.struct(*[c.alias(k) for k, c in self.items()])


def vec(x, y, z) -> Fields:
    return Fields(x=_c(x), y=_c(y), z=_c(z))


def quat(w, x, y, z) -> Fields:
    return Fields(w=_c(w), x=_c(x), y=_c(y), z=_c(z))


def pose(q, t) -> Fields:
    return Fields(w=q["w"], x=q["x"], y=q["y"], z=q["z"], tx=t["x"], ty=t["y"], tz=t["z"])


def pose_of(prefix: str = "") -> Fields:
    """Pose in columns qw, qx, qy, qz, tx, ty, tz after a prefix."""
    return Fields({a: F.col(f"{prefix}q{a}") for a in "wxyz"} | {f"t{a}": F.col(f"{prefix}t{a}") for a in "xyz"})


def rotation_of(p: Column) -> Column:
    return quat(p["w"], p["x"], p["y"], p["z"])


def translation_of(p: Column) -> Column:
    return vec(p["tx"], p["ty"], p["tz"])


def _c(v) -> Column:
    return v if isinstance(v, Column) else F.col(v) if isinstance(v, str) else F.lit(v)


# --- chunk grid: cells are centred on multiples of their size ---


def _check_size(size: float) -> None:
    if size <= 0:
        raise ValueError("the chunk size must be positive")


def chunk_coord(x, y, z, size: float) -> Column:
    """Cell of a point: floor((p + size / 2) / size) on each axis."""
    _check_size(size)
    cell = lambda p: F.floor((_c(p) + size / 2) / size).cast("long")
    return F.struct(cell(x).alias("cx"), cell(y).alias("cy"), cell(z).alias("cz"))


def chunk_encode(c: Column) -> Column:
    """One long for a cell; coordinates outside -2^20 .. 2^20 - 1 raise."""
    inside = lambda v: F.when(v.between(-AXIS_OFFSET, AXIS_OFFSET - 1), v + AXIS_OFFSET).otherwise(F.raise_error(F.lit("chunk coordinate out of range")).cast("long"))
    return inside(c["cx"]) * (1 << 2 * AXIS_BITS) + inside(c["cy"]) * (1 << AXIS_BITS) + inside(c["cz"])


def chunk_decode(chunk_id) -> Column:
    i, side = _c(chunk_id), 1 << AXIS_BITS
    return F.struct(
        (F.shiftright(i, 2 * AXIS_BITS) - AXIS_OFFSET).alias("cx"), (F.shiftright(i, AXIS_BITS) % side - AXIS_OFFSET).alias("cy"), (i % side - AXIS_OFFSET).alias("cz")
    )


def chunk_id(x, y, z, size: float) -> Column:
    return chunk_encode(chunk_coord(x, y, z, size))


def with_chunk_id(df: DataFrame, size: float) -> DataFrame:
    """df(x, y, z, ...) with chunk_id."""
    return df.withColumn("chunk_id", chunk_id("x", "y", "z", size))


def chunk_center(c: Column, size: float) -> Column:
    return vec(c["cx"] * float(size), c["cy"] * float(size), c["cz"] * float(size))


def chunk_aabb(c: Column, size: float) -> Column:
    return region_aabb(c, c, size)


def region_aabb(low: Column, high: Column, size: float) -> Column:
    """Box of the cells from ``low`` to ``high``."""
    ends = [(low[f"c{a}"] * float(size) - size / 2).alias(f"min_{a}") for a in "xyz"]
    return F.struct(*ends, *[(high[f"c{a}"] * float(size) + size / 2).alias(f"max_{a}") for a in "xyz"])


# --- vectors, quaternions, matrices ---


def norm3(x, y, z) -> Column:
    return F.sqrt(_c(x) * _c(x) + _c(y) * _c(y) + _c(z) * _c(z))


def quat_normalize(q: Column) -> Column:
    n = F.sqrt(q["w"] * q["w"] + q["x"] * q["x"] + q["y"] * q["y"] + q["z"] * q["z"])
    return quat(q["w"] / n, q["x"] / n, q["y"] / n, q["z"] / n)


def quat_mul(a: Column, b: Column) -> Column:
    return quat(
        a["w"] * b["w"] - a["x"] * b["x"] - a["y"] * b["y"] - a["z"] * b["z"],
        a["w"] * b["x"] + a["x"] * b["w"] + a["y"] * b["z"] - a["z"] * b["y"],
        a["w"] * b["y"] - a["x"] * b["z"] + a["y"] * b["w"] + a["z"] * b["x"],
        a["w"] * b["z"] + a["x"] * b["y"] - a["y"] * b["x"] + a["z"] * b["w"],
    )


def quat_conj(q: Column) -> Column:
    return quat(q["w"], -q["x"], -q["y"], -q["z"])


def quat_to_matrix(q: Column) -> list[Column]:
    """Of a unit quaternion."""
    w, x, y, z = (q[k] for k in "wxyz")
    return [
        1 - 2 * (y * y + z * z), 2 * (x * y - w * z), 2 * (x * z + w * y),
        2 * (x * y + w * z), 1 - 2 * (x * x + z * z), 2 * (y * z - w * x),
        2 * (x * z - w * y), 2 * (y * z + w * x), 1 - 2 * (x * x + y * y),
    ]


def matrix_to_quat(m: list[Column]) -> Column:
    """Unit quaternion of a rotation; the largest of trace and diagonal decides the branch."""
    m00, m01, m02, m10, m11, m12, m20, m21, m22 = m
    trace = m00 + m11 + m22
    s0, s1, s2, s3 = (F.sqrt(F.greatest(F.lit(1e-30), 1 + a)) * 2 for a in (trace, m00 - m11 - m22, m11 - m00 - m22, m22 - m00 - m11))
    by_trace, by_x, by_y = trace > 0, (m00 > m11) & (m00 > m22), m11 > m22
    pick = lambda a, b, c, d: F.when(by_trace, a).when(by_x, b).when(by_y, c).otherwise(d)
    return quat(
        pick(s0 / 4, (m21 - m12) / s1, (m02 - m20) / s2, (m10 - m01) / s3),
        pick((m21 - m12) / s0, s1 / 4, (m01 + m10) / s2, (m02 + m20) / s3),
        pick((m02 - m20) / s0, (m01 + m10) / s1, s2 / 4, (m12 + m21) / s3),
        pick((m10 - m01) / s0, (m02 + m20) / s1, (m12 + m21) / s2, s3 / 4),
    )


def matmul(a: list, b: list, n: int = 3) -> list[Column]:
    return [sum((_c(a[n * i + k]) * _c(b[n * k + j]) for k in range(1, n)), _c(a[n * i]) * _c(b[j])) for i in range(n) for j in range(n)]


def rotate(q: Column, v: Column) -> Column:
    m = quat_to_matrix(q)
    return vec(*[m[3 * i] * v["x"] + m[3 * i + 1] * v["y"] + m[3 * i + 2] * v["z"] for i in range(3)])


def rotate_quat(matrix: list, q: Column) -> Column:
    """Rotation by a 3x3 matrix of what a quaternion rotates."""
    return matrix_to_quat(matmul(matrix, quat_to_matrix(q)))


def transform_point(matrix: list, v: Column, scale: float | Column = 1.0) -> Column:
    """4x4 (or 3x4) rigid transform of a point, scaled first."""
    x, y, z = (_c(scale) * v[a] for a in "xyz")
    return vec(*[_c(matrix[4 * i]) * x + _c(matrix[4 * i + 1]) * y + _c(matrix[4 * i + 2]) * z + _c(matrix[4 * i + 3]) for i in range(3)])


def transform_points(df: DataFrame, matrix: list) -> DataFrame:
    """df(x, y, z, ...) moved by a 4x4 transform of literals or Columns."""
    return scale_transform_points(df, matrix, 1.0)


def scale_transform_points(df: DataFrame, matrix: list, scale: float) -> DataFrame:
    p = transform_point(matrix, vec("x", "y", "z"), scale)
    return df.withColumns(dict(p))


# --- rigid poses ---


def se3_inv(p: Column) -> Column:
    q = quat_conj(rotation_of(p))
    t = rotate(q, translation_of(p))
    return pose(q, vec(-t["x"], -t["y"], -t["z"]))


def se3_mul(a: Column, b: Column) -> Column:
    t = rotate(rotation_of(a), translation_of(b))
    return pose(quat_mul(rotation_of(a), rotation_of(b)), vec(t["x"] + a["tx"], t["y"] + a["ty"], t["z"] + a["tz"]))


def relative_pose(old: Column, new: Column) -> Column:
    return se3_mul(se3_inv(new), old)


def camera_center(tcw: Column) -> Column:
    """-R't of a world-to-camera pose."""
    return translation_of(se3_inv(tcw))


def rotation_angle(q: Column) -> Column:
    return 2 * F.acos(F.least(F.lit(1.0), F.abs(q["w"])))


def rotation_distance(q: Column) -> Column:
    """Frobenius norm of R - I: 2 sqrt(2) |sin(angle / 2)|."""
    return 2 * math.sqrt(2) * F.sqrt(q["x"] * q["x"] + q["y"] * q["y"] + q["z"] * q["z"])


def pose_divergent(old: Column, new: Column, rot_th: float = 0.05, trans_th: float = 0.1) -> Column:
    d = relative_pose(old, new)
    return (rotation_distance(rotation_of(d)) > rot_th * math.sqrt(3)) | (norm3(d["tx"], d["ty"], d["tz"]) > trans_th)


def pose_near_equal(a: Column, b: Column, chunk_size: float) -> Column:
    """Translations within 5 % of a chunk and rotations within 0.05 rad."""
    moved = norm3(a["tx"] - b["tx"], a["ty"] - b["ty"], a["tz"] - b["tz"])
    return (moved < 0.05 * chunk_size) & (rotation_angle(quat_mul(quat_conj(rotation_of(a)), rotation_of(b))) < 0.05)


def rot6d_to_matrix(a: Column, b: Column) -> list[Column]:
    """Gram-Schmidt of two 3-vectors; they and their cross product are the columns."""
    na = norm3(a["x"], a["y"], a["z"])
    u = [a[k] / na for k in "xyz"]
    dot = u[0] * b["x"] + u[1] * b["y"] + u[2] * b["z"]
    r = [b[k] - dot * u[i] for i, k in enumerate("xyz")]
    nr = norm3(*r)
    v = [x / nr for x in r]
    w = [u[1] * v[2] - u[2] * v[1], u[2] * v[0] - u[0] * v[2], u[0] * v[1] - u[1] * v[0]]
    return [u[0], v[0], w[0], u[1], v[1], w[1], u[2], v[2], w[2]]


# --- cameras ---


def focal2fov(focal, pixels) -> Column:
    return 2 * F.atan(_c(pixels) / (2 * _c(focal)))


def fov2focal(fov, pixels) -> Column:
    return _c(pixels) / (2 * F.tan(_c(fov) / 2))


def world_to_view(tcw: Column, shift: Column | None = None, scale: float = 1.0) -> list[Column]:
    """4x4 world-to-view of a pose whose camera centre is moved by ``shift`` and then scaled."""
    c = camera_center(tcw)
    shift = vec(0.0, 0.0, 0.0) if shift is None else shift
    r = quat_to_matrix(rotation_of(tcw))
    moved = [(c[k] + shift[k]) * scale for k in "xyz"]
    t = [-(r[3 * i] * moved[0] + r[3 * i + 1] * moved[1] + r[3 * i + 2] * moved[2]) for i in range(3)]
    zero, one = F.lit(0.0), F.lit(1.0)
    return [r[0], r[1], r[2], t[0], r[3], r[4], r[5], t[1], r[6], r[7], r[8], t[2], zero, zero, zero, one]


def projection_matrix(znear, zfar, fov_x, fov_y) -> list[Column]:
    """Perspective with depth in 0 .. 1."""
    n, f, zero = _c(znear), _c(zfar), F.lit(0.0)
    return [1 / F.tan(_c(fov_x) / 2), zero, zero, zero, zero, 1 / F.tan(_c(fov_y) / 2), zero, zero, zero, zero, f / (f - n), -(f * n) / (f - n), zero, zero, F.lit(1.0), zero]


def full_projection(view: list, projection: list) -> list[Column]:
    return matmul(projection, view, 4)


def frustum_footprint(center: Column, heading_x: Column, heading_z: Column, fov_x, zfar) -> Column:
    """Ground triangle of a view: apex and the two far corners; null when the heading is nearly vertical."""
    h = F.sqrt(heading_x * heading_x + heading_z * heading_z)
    ux, uz, half = heading_x / h, heading_z / h, F.tan(_c(fov_x) / 2) * _c(zfar)
    tip = F.struct(
        center["x"].alias("ax"), center["z"].alias("az"),
        (center["x"] + ux * _c(zfar) - uz * half).alias("bx"), (center["z"] + uz * _c(zfar) + ux * half).alias("bz"),
        (center["x"] + ux * _c(zfar) + uz * half).alias("cx"), (center["z"] + uz * _c(zfar) - ux * half).alias("cz"),
    )
    return F.when(h > 0.001, tip)
