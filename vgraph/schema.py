"""Table contracts, units and names.

A network is two tables and a row of metadata, all keyed by ``graph``. Missing is
NULL throughout; sources turn NaN into NULL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

POINT = "struct<x: double, y: double, z: double>"
VERTICES = "graph string, vid bigint, x double, y double, z double, diameter double, annotation bigint, is_border int, border_face string, distance_to_surface double"
EDGES = f"graph string, eid bigint, src bigint, dst bigint, nkind int, length double, diameter double, points array<{POINT}>, diameters array<double>, lengths2 array<double>, lengths array<double>"

# Fixed values of the data model.
ARTERY, VEIN, CAPILLARY = 2, 3, 4
LABELS = {ARTERY: "artery", VEIN: "vein", CAPILLARY: "capillary"}
COLORS = {"artery": "red", "vein": "blue", "capillary": "gray"}
IMAGE_UM = (1.625, 1.625, 2.5)
ATLAS_UM = 25.0
FACES = (("x_min", "x", "xmin"), ("x_max", "x", "xmax"), ("y_min", "y", "ymin"), ("y_max", "y", "ymax"), ("z_min", "z", "zmin"), ("z_max", "z", "zmax"))
DEPTH_BINS = (("0-20", 0.0, 20.0), ("20-50", 20.0, 50.0), ("50-200", 50.0, 200.0), (">200", 200.0, float("inf")))
SYNONYMS = {"a": "artery", "arteries": "artery", "arterial": "artery", "v": "vein", "veins": "vein", "venous": "vein", "cap": "capillary", "caps": "capillary", "capillaries": "capillary"}


def require_columns(df: DataFrame, names: list[str]) -> DataFrame:
    """The table itself, or a ValueError that lists the columns it lacks."""
    lacks = [n for n in names if n not in df.columns]
    if lacks:
        raise ValueError(f"missing columns: {', '.join(lacks)}")
    return df


def label(nkind: Column, unknown: str = "unknown") -> Column:
    """The name of a vessel class."""
    out = F.lit(unknown)
    for code, name in LABELS.items():
        out = F.when(nkind == code, name).otherwise(out)
    return out


def color(nkind: Column) -> Column:
    out = F.lit("black")
    for code, name in LABELS.items():
        out = F.when(nkind == code, COLORS[name]).otherwise(out)
    return out


def normal_type(name: Column) -> Column:
    """A vessel type in lower case, without blanks around it, with synonyms resolved."""
    plain = F.lower(F.trim(name))
    known = F.create_map(*(F.lit(x) for pair in SYNONYMS.items() for x in pair))
    return F.coalesce(F.try_element_at(known, plain), plain)


def finite(x: Column) -> Column:
    """The value, or NULL if it is NaN or infinite."""
    x = x.cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def box_um(center_voxel: tuple, size_um: float, spacing: tuple = IMAGE_UM) -> dict[str, float]:
    """The box of a size in micrometres around a centre in voxels."""
    out = {}
    for axis, c, s in zip("xyz", center_voxel, spacing, strict=True):
        out[f"{axis}min"], out[f"{axis}max"] = c * s - size_um / 2, c * s + size_um / 2
    return out


def box_voxels(center_voxel: tuple, size_um: float | tuple, spacing: tuple = IMAGE_UM) -> dict[str, float]:
    """The same in voxels; the size may differ by axis."""
    sizes = size_um if isinstance(size_um, tuple) else (size_um,) * 3
    out = {}
    for axis, c, n, s in zip("xyz", center_voxel, sizes, spacing, strict=True):
        out[f"{axis}min"], out[f"{axis}max"] = c - n / s / 2, c + n / s / 2
    return out


def check_box(box: dict) -> dict:
    lacks = [f"{a}{b}" for a in "xyz" for b in ("min", "max") if f"{a}{b}" not in box]
    if lacks:
        raise ValueError(f"the box lacks {', '.join(lacks)}")
    return box


def tolerance(voxels: float = 2.0, axis: int = 0, spacing: tuple | None = IMAGE_UM) -> float:
    """A tolerance given in voxels, in micrometres unless the space is voxels (spacing None)."""
    return voxels if spacing is None else voxels * spacing[axis]
