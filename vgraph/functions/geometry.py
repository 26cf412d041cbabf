"""Column expressions over polylines and coordinates."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def distance(a: Column, b: Column) -> Column:
    return F.sqrt(F.pow(a["x"] - b["x"], F.lit(2.0)) + F.pow(a["y"] - b["y"], F.lit(2.0)) + F.pow(a["z"] - b["z"], F.lit(2.0)))


def total(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0.0), lambda acc, x: acc + x)


def segments(points: Column) -> Column:
    """The lengths of a polyline's segments."""
    n = F.size(points)
    return F.when(n < 2, F.array().cast("array<double>")).otherwise(F.zip_with(F.slice(points, F.lit(1), F.greatest(n - 1, F.lit(0))), F.slice(points, F.lit(2), F.greatest(n - 1, F.lit(0))), distance))


def per_point(lengths2: Column) -> Column:
    """A length for each point: its segment's, the last one repeated."""
    return F.when(F.size(lengths2) == 0, lengths2).otherwise(F.concat(lengths2, F.array(F.element_at(lengths2, -1))))


def arc_length(points: Column) -> Column:
    return total(segments(points))


def tortuosity(points: Column) -> Column:
    """Length over straight distance; 1 where the ends meet."""
    straight = distance(points[0], F.element_at(points, -1))
    return F.when(straight > 0, arc_length(points) / straight).otherwise(1.0)


def oriented(points: Column, source: Column, rtol: float = 1e-5, atol: float = 1e-8) -> Column:
    """Whether a polyline must be turned to begin at its source vertex."""
    near = lambda p: (F.abs(p["x"] - source["x"]) <= atol + rtol * F.abs(source["x"])) & (F.abs(p["y"] - source["y"]) <= atol + rtol * F.abs(source["y"])) & (F.abs(p["z"] - source["z"]) <= atol + rtol * F.abs(source["z"]))
    return ~near(points[0]) & near(F.element_at(points, -1))


def moved(p: Column, scale: tuple = (1.0, 1.0, 1.0), offset: tuple = (0.0, 0.0, 0.0)) -> Column:
    return F.struct(*((p[a] * s + o).alias(a) for a, s, o in zip("xyz", scale, offset, strict=True)))


def finite_max(xs: Column) -> Column:
    """The largest finite value, or NULL."""
    return F.array_max(F.filter(xs, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < math.inf)))


def measured(edges: DataFrame) -> DataFrame:
    """Segment lengths, lengths by point and length taken anew from the points, tortuosity if it was there."""
    out = edges.withColumn("lengths2", segments(F.col("points"))).withColumn("length", total(F.col("lengths2"))).withColumn("lengths", per_point(F.col("lengths2")))
    return out.withColumn("tortuosity", tortuosity(F.col("points"))) if "tortuosity" in edges.columns else out


def to_um(vertices: DataFrame, edges: DataFrame, spacing: tuple) -> tuple[DataFrame, DataFrame]:
    """A network in voxels in micrometres: lengths come from the scaled points, diameters use the mean of the first two spacings."""
    wide = (spacing[0] + spacing[1]) / 2
    v = vertices.withColumns({a: F.col(a) * s for a, s in zip("xyz", spacing, strict=True)})
    if "diameter" in v.columns:
        v = v.withColumn("diameter", F.col("diameter") * wide)
    e = measured(edges.withColumn("points", F.transform("points", lambda p: moved(p, spacing))))
    e = e.withColumn("diameters", F.transform("diameters", lambda d: d * wide))
    return v, e.withColumn("diameter", finite_max(F.col("diameters")))


def rescaled(vertices: DataFrame, edges: DataFrame, scale: float) -> tuple[DataFrame, DataFrame]:
    """Coordinates, points and lengths times a factor; diameters stay."""
    v = vertices.withColumns({a: F.col(a) * scale for a in "xyz"})
    e = edges.withColumn("points", F.transform("points", lambda p: moved(p, (scale,) * 3))).withColumn("length", F.col("length") * scale)
    for c in ("lengths2", "lengths"):
        if c in e.columns:
            e = e.withColumn(c, F.transform(c, lambda x: x * scale))
    return v, e


def shifted(vertices: DataFrame, edges: DataFrame, offset: tuple) -> tuple[DataFrame, DataFrame]:
    """Coordinates and points moved by an offset; lengths stay."""
    v = vertices.withColumns({a: F.col(a) + o for a, o in zip("xyz", offset, strict=True)})
    return v, edges.withColumn("points", F.transform("points", lambda p: moved(p, offset=offset)))


def box_offset(bbox: list[float], order: str = "yxz") -> tuple:
    """The first corner of a bounding box, whose numbers come in ``order``, as x, y, z."""
    by = dict(zip(order, bbox[:3], strict=True))
    return by["x"], by["y"], by["z"]


def voxel_length(points: Column, voxel: float = 1.0) -> Column:
    """Chain length plus one voxel; 0 without points and a voxel for one point."""
    return F.when(F.size(points) == 0, 0.0).when(F.size(points) == 1, voxel).otherwise(arc_length(points) + voxel)


def unraveled(index: Column, rows: int, columns: int) -> Column:
    """(y, x, z), from 0, of a 1-based index into an array in column-major order."""
    i = index - 1
    return F.struct((i % rows).alias("y"), (F.floor(i / rows) % columns).alias("x"), F.floor(i / (rows * columns)).alias("z"))


def resistance(length: Column, radius: Column, factor: float = 1.63) -> Column:
    """Poiseuille resistance, with radii scaled by a factor and viscosity 1."""
    return F.lit(128.0 * factor) * length / (F.lit(math.pi) * F.pow(2 * factor * radius, F.lit(4.0)))


def effective_radius(lengths2: Column, radii: Column, factor: float = 1.63) -> Column:
    """The radius of the uniform tube with a polyline's resistance; segments take the mean of their two radii."""
    mean = F.zip_with(F.slice(radii, F.lit(1), F.size(lengths2)), F.slice(radii, F.lit(2), F.size(lengths2)), lambda a, b: (a + b) / 2)
    r = total(F.zip_with(lengths2, mean, lambda n, m: resistance(n, m, factor)))
    return F.when(r > 0, 0.5 * F.pow(F.lit(128.0) * total(lengths2) / (F.lit(math.pi) * r), F.lit(0.25)) / factor)


def penalised(nkind: Column, length: Column, artery: float = 1e5, vein: float = 1e5) -> Column:
    """Lengths with a charge for arteries and veins."""
    return F.when(nkind == 2, length + artery).when(nkind == 3, length + vein).otherwise(length)
