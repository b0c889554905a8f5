"""Column expressions over nodes, voxels and parameters. Each takes and gives Columns; nothing here leaves the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Result components by position.
COMPONENTS = ["id", "x", "y", "z", "ux", "uy", "uz", "sx", "sy", "sz", "sxy", "syz", "sxz", "eps_x", "eps_y", "eps_z", "eps_xy", "eps_yz", "eps_xz", "usum", "seqv", "epseqv"]
STORED, DERIVED = COMPONENTS[:19], COMPONENTS[19:]
#: The nine anchor colours of the ramp, lowest first.
RAMP = [(0, 0, 255), (0, 178, 255), (0, 255, 255), (0, 255, 178), (0, 255, 0), (178, 255, 0), (255, 255, 0), (255, 178, 0), (255, 0, 0)]


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def von_mises(x, y, z, xy, yz, xz) -> Column:
    """Equivalent value of six tensor components; the same form serves stress and strain."""
    x, y, z, xy, yz, xz = map(col, (x, y, z, xy, yz, xz))
    sq = lambda c: c * c
    return F.sqrt(0.5 * (sq(x - y) + sq(y - z) + sq(z - x)) + 3 * (sq(xy) + sq(yz) + sq(xz)))


def seqv() -> Column:
    return von_mises("sx", "sy", "sz", "sxy", "syz", "sxz")


def epseqv() -> Column:
    return von_mises("eps_x", "eps_y", "eps_z", "eps_xy", "eps_yz", "eps_xz")


def usum(ux="ux", uy="uy", uz="uz") -> Column:
    return F.sqrt(col(ux) * col(ux) + col(uy) * col(uy) + col(uz) * col(uz))


def minmax_scale(v, low, high) -> Column:
    """Position between low and high; 1 where they are equal."""
    return F.when(col(high) == col(low), 1.0).otherwise((col(v) - col(low)) / F.nullif(col(high) - col(low), F.lit(0.0)))


def color_level(scaled, levels: int = 9) -> Column:
    return F.floor(col(scaled) * (levels - 1)).cast("int")


def ramp_color(level, levels: int) -> Column:
    """Struct (red, green, blue, alpha) of a level 0..levels of the ramp, between its anchors in proportion; channels are cut
    to whole numbers."""
    place = col(level) / float(levels) * (len(RAMP) - 1)
    low = F.least(F.floor(place), F.lit(len(RAMP) - 2)).cast("int")
    channels = []
    for k, name in enumerate(("red", "green", "blue")):
        anchors = F.array(*(F.lit(c[k]) for c in RAMP))
        channels.append(F.floor(anchors[low] + (place - low) * (anchors[low + 1] - anchors[low])).cast("int").alias(name))
    return F.struct(*channels, F.lit(255).alias("alpha"))


def _by_sector(sector: Column, *values: Column) -> Column:
    """The value for each of six sectors of the colour circle."""
    out = F.when(sector < 1, values[0])
    for k, v in enumerate(values[1:-1], 2):
        out = out.when(sector < k, v)
    return F.floor(255 * out.otherwise(values[-1])).cast("int")


def grain_color(grain, grains: int) -> Column:
    """Struct (red, green, blue, alpha) of a grain 1..grains: hues all round, full saturation and value, alpha 0.85."""
    sector = (col(grain) - 1) * 360.0 / grains / 60
    mid, one, zero = 1 - F.abs(sector % 2 - 1), F.lit(1.0), F.lit(0.0)
    red = _by_sector(sector, one, mid, zero, zero, mid, one)
    green = _by_sector(sector, mid, one, one, mid, zero, zero)
    blue = _by_sector(sector, zero, zero, mid, one, one, mid)
    return F.struct(red.alias("red"), green.alias("green"), blue.alias("blue"), F.lit(216).alias("alpha"))


def legend_values(low, high, levels: int = 9) -> Column:
    """Array of (position, value): levels + 1 equal steps from high down to low; a range of one value is widened by 0.01 both
    ways."""
    flat, low, high = col(low) == col(high), col(low), col(high)
    bottom, top = F.when(flat, low - 0.01).otherwise(low), F.when(flat, high + 0.01).otherwise(high)
    return F.transform(F.sequence(F.lit(0), F.lit(levels)), lambda k: F.struct(k.alias("position"), (top - k * (top - bottom) / levels).alias("value")))


def seed_count(concentration, size) -> Column:
    """Seeds of a cube for a concentration in percent."""
    n = col(size)
    return F.floor(col(concentration) / 100 * n * n * n).cast("long")


def fibre_radius(concentration, size) -> Column:
    """Radius of a fibre that takes a concentration in percent of the cube's face."""
    return F.round(F.sqrt(col(concentration) * col(size) * col(size) / F.pi() / 100)).cast("long")


def parameter_fault(size, points) -> Column:
    """Why a row of parameters is not valid; null where it is."""
    n, points = col(size), col(points)
    return F.when(n <= 0, "size").when(points <= 0, "points").when(points > n * n * n, "too many points")


def strain_error_pct(load, avg) -> Column:
    """Deviation of the average from the load in percent with two places; 0 for no load."""
    return F.when(col(load) == 0, 0.0).otherwise(F.round((col(load) - col(avg)) / F.nullif(col(load), F.lit(0.0)) * 10000) / 100)


def euler_from_quaternion(w, x, y, z) -> Column:
    """Struct (phi1, phi, phi2): Bunge angles in degrees of the normalised quaternion; zeros where its norm is next to nothing."""
    w, x, y, z = map(col, (w, x, y, z))
    norm = F.sqrt(w * w + x * x + y * y + z * z)
    a, b, c, d = (v / F.when(norm < 1e-12, 1.0).otherwise(norm) for v in (w, x, y, z))
    r33 = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), 1 - 2 * (b * b + c * c)))
    tilt = F.acos(r33)
    flat = (tilt < 1e-6) | (F.abs(tilt - F.pi()) < 1e-6)
    r11, r12 = 1 - 2 * (c * c + d * d), 2 * (b * c - a * d)
    r13, r23 = 2 * (b * d + a * c), 2 * (c * d - a * b)
    r31, r32 = 2 * (b * d - a * c), 2 * (c * d + a * b)
    phi1 = F.when(flat, F.atan2(r12, r11)).otherwise(F.atan2(r31, -r32))
    phi2 = F.when(flat, 0.0).otherwise(F.atan2(r13, r23))
    pick = lambda v: F.when(norm < 1e-12, 0.0).otherwise(F.degrees(v))
    return F.struct(pick(phi1).alias("phi1"), pick(tilt).alias("phi"), pick(phi2).alias("phi2"))


def rotate_xyz(x, y, z, ax: float, ay: float, az: float) -> tuple[Column, Column, Column]:
    """A point turned about x, then y, then z, by degrees."""
    x, y, z = map(col, (x, y, z))
    cos, sin = (lambda d: F.cos(F.radians(F.lit(float(d))))), (lambda d: F.sin(F.radians(F.lit(float(d)))))
    y, z = y * cos(ax) - z * sin(ax), y * sin(ax) + z * cos(ax)
    x, z = x * cos(ay) + z * sin(ay), z * cos(ay) - x * sin(ay)
    x, y = x * cos(az) - y * sin(az), x * sin(az) + y * cos(az)
    return x, y, z


def in_ellipsoid(x, y, z, axes: tuple[float, float, float], angles: tuple[float, float, float], centre: float = 1.5, about_center: bool = False) -> Column:
    """Inside the ellipsoid after turning the point about the origin, or about the centre."""
    shift = centre if about_center else 0.0
    turned = rotate_xyz(col(x) - shift, col(y) - shift, col(z) - shift, *angles)
    return sum((((t + shift - centre) / a) * ((t + shift - centre) / a) for t, a in zip(turned, axes, strict=True)), F.lit(0.0)) <= 1


def distance_xy(x, y, cx, cy) -> Column:
    dx, dy = col(x) - col(cx) if isinstance(cx, str) else col(x) - F.lit(cx), col(y) - col(cy) if isinstance(cy, str) else col(y) - F.lit(cy)
    return F.sqrt((dx * dx + dy * dy).cast("double"))


def in_fibre(x, y, n: int, r: int) -> Column:
    """Region tag: 5 in the core, whose distance to the middle is rounded, else 1."""
    return F.when(F.round(distance_xy(x, y, n // 2, n // 2)) <= r, 5).otherwise(1)


def in_fibre_corners(x, y, n: int, r: int) -> Column:
    """As in_fibre, and with a quarter core at each corner, whose distance is not rounded."""
    corners = F.least(*(distance_xy(x, y, a, b) for a in (0, n) for b in (0, n)))
    return F.when((F.round(distance_xy(x, y, n // 2, n // 2)) <= r) | (corners <= r), 5).otherwise(1)


def displacement(x, y, z, exx, eyy, ezz, exy, eyz, exz) -> tuple[Column, Column, Column]:
    """Displacements of a point under a uniform symmetric strain, relative to the origin."""
    x, y, z, exx, eyy, ezz, exy, eyz, exz = map(col, (x, y, z, exx, eyy, ezz, exy, eyz, exz))
    return exx * x + exy * y + exz * z, exy * x + eyy * y + eyz * z, exz * x + eyz * y + ezz * z


def is_face_node(x, y, z, n: float, tolerance: float = 0.25) -> Column:
    """Within the tolerance of a face of the box [0, n] and inside the box."""
    near = F.lit(False)
    inside = F.lit(True)
    for c in map(col, (x, y, z)):
        near = near | (F.abs(c) <= tolerance) | (F.abs(c - n) <= tolerance)
        inside = inside & (c >= 0) & (c <= n)
    return near & inside


def safe_mean(v) -> Column:
    """Mean of a group, 0 where it has no value."""
    return F.coalesce(F.avg(col(v)), F.lit(0.0))


def finite_nonzero(v) -> Column:
    v = col(v)
    return v.isNotNull() & ~F.isnan(v) & (v != 0) & (F.abs(v) < float("inf"))


def mix32(v: Column) -> Column:
    """Integer hash of 32 bits, the same in any SQL."""
    for _ in range(2):
        v = v.bitwiseXOR(F.shiftright(v, 16))
        v = (v * 73244475) % 4294967296
    return v.bitwiseXOR(F.shiftright(v, 16))


def uniform(seed: int, i, c: int) -> Column:
    """Keyed uniform number in (0, 1), independent of partitioning."""
    return (mix32((col(i) * 6 + (c + 1 + seed * 1000003)) % 4294967296) + 0.5) / 4294967296.0


def morton(x, y, z) -> Column:
    """Place on a curve that keeps neighbours together: the bits of x, y and z in turn, to half a cell; 20 bits of each."""

    def spread(v: Column) -> Column:
        v = F.greatest(F.lit(0), F.least(F.lit((1 << 20) - 1), F.floor(v.cast("double") * 2).cast("long")))
        for by, mask in ((32, 0x1F00000000FFFF), (16, 0x1F0000FF0000FF), (8, 0x100F00F00F00F00F), (4, 0x10C30C30C30C30C3), (2, 0x1249249249249249)):
            v = v.bitwiseOR(F.shiftleft(v, by)).bitwiseAND(F.lit(mask))
        return v

    a, b, c = (spread(col(v)) for v in (x, y, z))
    return a.bitwiseOR(F.shiftleft(b, 1)).bitwiseOR(F.shiftleft(c, 2))
