"""Money, geometry and quantity functions (MTH)."""

from __future__ import annotations

from typing import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.common import literal_table

# Shares of the bonus pool.
GROUP_SHARE, TEAM_SHARE, PROPOSER_SHARE = "0.20", "0.50", "0.30"


def split_bonus(df: DataFrame, saving: str, rate: str = "0.15") -> DataFrame:
    """Pool = saving · rate, half up to cents; 20/50/30; the rounding rest goes to the group."""
    cents = lambda c: F.round(c, 2).cast("decimal(18,2)")
    share = lambda s: cents(F.col("bonus_pool") * F.lit(s).cast("decimal(4,2)"))
    pool = df.where(F.col(saving) > 0).withColumn(
        "bonus_pool", cents(F.col(saving).cast("decimal(18,2)") * F.lit(rate).cast("decimal(4,2)")))
    parts = pool.withColumn("team_pool", share(TEAM_SHARE)).withColumn("proposer_amount", share(PROPOSER_SHARE))
    return parts.withColumn("group_amount", (F.col("bonus_pool") - F.col("team_pool") - F.col("proposer_amount")).cast("decimal(18,2)"))


# Design strengths of steel and concrete, bond shape factors, seismic and lap factors.
FY = {"HPB300": 270.0, "HRB335": 335.0, "HRB400": 400.0, "HRB500": 500.0, "HRBF400": 400.0, "HRBF500": 500.0}
FT = {"C20": 1.10, "C25": 1.27, "C30": 1.43, "C35": 1.57, "C40": 1.71, "C45": 1.80, "C50": 1.89, "C55": 1.96, "C60": 2.04}
ALPHA = {"HPB300": 0.16, "HRB335": 0.14, "HRB400": 0.14, "HRB500": 0.14, "HRBF400": 0.14, "HRBF500": 0.14}
SEISMIC = {1: 1.15, 2: 1.15, 3: 1.05, 4: 1.00}
LAP = {"25": 1.20, "50": 1.40, "100": 1.60}


def ceil5(col: Column) -> Column:
    return (F.ceil(col / 5.0) * 5).cast("long")


def anchor_lengths(df: DataFrame, diameter: str, steel: str, concrete: str, seismic: str, lap: Mapping[str, float] = LAP) -> DataFrame:
    """Anchor length α·fy/ft·d up to 5 mm (floors 200, seismic 250) and lap lengths; unknown grades drop out."""
    spark = df.sparkSession
    steels = literal_table(spark, [(k, FY[k], ALPHA[k]) for k in FY], f"{steel} string, _fy double, _alpha double")
    concretes = literal_table(spark, list(FT.items()), f"{concrete} string, _ft double")
    factors = literal_table(spark, list(SEISMIC.items()), f"{seismic} int, _z double")
    rows = (df.join(F.broadcast(steels), steel).join(F.broadcast(concretes), concrete)
            .join(F.broadcast(factors), seismic, "left"))
    raw = F.col("_alpha") * (F.col("_fy") / F.col("_ft")) * F.col(diameter)
    la = F.greatest(ceil5(raw), F.lit(200))
    lae = F.greatest(ceil5(F.coalesce("_z", F.lit(1.0)) * raw), F.lit(250))
    base = F.when(F.col(seismic) <= 3, lae).otherwise(la)
    return rows.select(*df.columns, la.cast("long").alias("la"), lae.cast("long").alias("lae"),
                       *[ceil5(F.lit(f) * base).alias(f"ll_{n}") for n, f in lap.items()])


def polygon(points: Column) -> Column:
    """struct(area, perimeter, x0, y0, x1, y1) of a vertex array of struct(x, y)."""
    nxt = F.concat(F.slice(points, 2, F.size(points)), F.slice(points, 1, 1))
    fold = lambda a: F.aggregate(a, F.lit(0.0), lambda s, v: s + v)
    cross = F.zip_with(points, nxt, lambda p, q: p["x"] * q["y"] - q["x"] * p["y"])
    side = F.zip_with(points, nxt, lambda p, q: F.sqrt(F.pow(q["x"] - p["x"], 2) + F.pow(q["y"] - p["y"], 2)))
    xs, ys = F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"])
    return F.struct((F.abs(fold(cross)) / 2).alias("area"), fold(side).alias("perimeter"), F.array_min(xs).alias("x0"),
                    F.array_min(ys).alias("y0"), F.array_max(xs).alias("x1"), F.array_max(ys).alias("y1"))


# Sizes assumed where a drawing states none.
DEFAULT_WALL_WIDTH, DEFAULT_BEAM_WIDTH, DEFAULT_BEAM_DEPTH, DEFAULT_SLAB_THICKNESS = 0.2, 0.3, 0.6, 0.12


def volumes(kind: Column, area: Column, perimeter: Column, length: Column, width: Column, depth: Column, height: Column) -> Column:
    """struct(gross, contact, free): concrete volume and formwork of a column, wall, beam or slab."""
    wall_w, beam_w = F.coalesce(width, F.lit(DEFAULT_WALL_WIDTH)), F.coalesce(width, F.lit(DEFAULT_BEAM_WIDTH))
    beam_d, slab_t = F.coalesce(depth, F.lit(DEFAULT_BEAM_DEPTH)), F.coalesce(depth, F.lit(DEFAULT_SLAB_THICKNESS))
    make = lambda g, c, f: F.struct(g.alias("gross"), c.alias("contact"), f.alias("free"))
    return (F.when(kind == "column", make(area * height, perimeter * height, 2 * area))
            .when(kind == "wall", make(length * wall_w * height, 2 * length * height, 2 * wall_w * height + 2 * length * wall_w))
            .when(kind == "beam", make(length * beam_w * beam_d, (2 * beam_d + beam_w) * length, beam_w * length + 2 * beam_w * beam_d))
            .when(kind == "slab", make(area * slab_t, area + perimeter * slab_t, area)))


def to_meters(x: Column, y: Column, scale: Column, origin_x: Column, origin_y: Column, page_h: Column) -> list[Column]:
    """Page point to metres: y flips, origin shifts, scale."""
    return [F.round((x - origin_x) * scale, 3).alias("x_m"), F.round((page_h - y - origin_y) * scale, 3).alias("y_m")]


def to_page(x: Column, y: Column, scale: Column, origin_x: Column, origin_y: Column, page_h: Column) -> list[Column]:
    """Inverse of ``to_meters`` up to rounding; (0, 0) without a scale."""
    ok = scale > 0
    return [F.when(ok, x / scale + origin_x).otherwise(0.0).alias("x_pt"),
            F.when(ok, page_h - (y / scale + origin_y)).otherwise(0.0).alias("y_pt")]


def apply_similarity(x: Column, y: Column, scale: Column, rotation_deg: Column, tx: Column, ty: Column, mirror: Column) -> list[Column]:
    flip = F.when(mirror, -y).otherwise(y)
    cos, sin = F.cos(F.radians(rotation_deg)), F.sin(F.radians(rotation_deg))
    return [(scale * (cos * x - sin * flip) + tx).alias("x_out"), (scale * (sin * x + cos * flip) + ty).alias("y_out")]


# Standard sections in metres, module step, largest change.
STANDARD_SECTIONS_M = (0.20, 0.25, 0.30, 0.35, 0.40, 0.45, 0.50, 0.55, 0.60, 0.65, 0.70, 0.75, 0.80, 0.90,
                       1.00, 1.10, 1.20, 1.30, 1.40, 1.50, 1.60, 1.80, 2.00)
MODULE_STEP_M, SNAP_TOLERANCE_M = 0.05, 0.03


def snap(col: Column, standards: Sequence[float] = STANDARD_SECTIONS_M, step: float = MODULE_STEP_M, tol: float = SNAP_TOLERANCE_M) -> Column:
    """struct(value, snapped): nearest standard inside the tolerance, else the module, else unchanged."""
    near = F.array_min(F.transform(F.array(*[F.lit(float(s)) for s in standards]), lambda s: F.struct(F.abs(s - col).alias("gap"), s.alias("s"))))
    stepped = F.rint(col / step) * step
    make = lambda v, f: F.struct(v.alias("value"), F.lit(f).alias("snapped"))
    return (F.when(col.isNull() | (col <= 0), make(col, False)).when(near["gap"] <= tol, make(F.round(near["s"], 3), True))
            .when((stepped > 0) & (F.abs(stepped - col) <= tol), make(F.round(stepped, 3), True)).otherwise(make(col, False)))


def call_cost(prompt: Column, completion: Column, input_price: Column, output_price: Column) -> Column:
    """Price per million tokens, in and out."""
    return prompt / 1_000_000 * input_price + completion / 1_000_000 * output_price
