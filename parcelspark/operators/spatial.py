"""Spatial joins as relational Spark plans: point-in-polygon (covers) and area-weighted cells.

Geometry model: a feature row carries ``geometry STRUCT<type STRING, coordinates STRING>`` with the
raw GeoJSON coordinates text; polygons become arrays of edges ``(x1, y1, x2, y2)`` over all rings
and parts, so the even-odd rule handles holes and multipolygons.

Point-in-polygon plan (no cartesian product):
1. distinct point coordinates (the answer depends only on the coordinates, so duplicates and
   hot coordinates are resolved once; a left join brings the answer back to every row);
2. each polygon's bounding box is tiled with square cells on the grid of its level (side ``cell``,
   doubled per level), at most nine tiles each; a point looks up its cell on every level that
   occurs (equi join on ``(level, gx, gy)``), then takes the inclusive bbox test;
3. exact boundary-inclusive test: point on an edge, or an odd number of ray crossings; a polygon with few edges
   is walked whole, one with many keeps its edges in bands of y (``edge_bands``), and a point meets only
   the edges of its bands, whose crossings are summed;
4. first match wins by feature order (``min`` of a unique numeric order), a partial hash
   aggregate per coordinate; attributes join back by that order.
No side is forced to be broadcast: adaptive execution chooses from the measured sizes, and shuffle
joins can be split on skew.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize

MAX_LEVEL = 62          # tiles of this level are 2**62 times the base side: any layer fits

POLYGON_JSON = "array<array<array<double>>>"
MULTIPOLYGON_JSON = "array<array<array<array<double>>>>"


def polygon_rings(geometry: str | Column = "geometry") -> Column:
    """GeoJSON Polygon / MultiPolygon -> ARRAY of rings (each ARRAY of [x, y])."""
    g = F.col(geometry) if isinstance(geometry, str) else geometry
    parts = (F.when(g["type"] == "Polygon", F.array(F.from_json(g["coordinates"], POLYGON_JSON)))
              .when(g["type"] == "MultiPolygon", F.from_json(g["coordinates"], MULTIPOLYGON_JSON)))
    return F.flatten(parts)


def ring_edges(rings: Column, project=None) -> Column:
    """Rings -> ARRAY<STRUCT<x1, y1, x2, y2>>; rings are closed if needed, zero-length edges
    dropped. ``project`` maps (x, y) Columns to projected (x, y) Columns."""
    def point(p):
        x, y = p[0], p[1]
        if project is not None:
            x, y = project(x, y)
        return F.struct(x.alias("x"), y.alias("y"))

    def edges_of(ring):
        # each point beside the next one, the last beside the first: linear in the ring's points
        pts = F.transform(ring, point)
        following = F.concat(F.slice(pts, F.lit(2), F.size(ring)), F.slice(pts, F.lit(1), F.lit(1)))
        return F.zip_with(pts, following, lambda a, b: F.struct(
            a["x"].alias("x1"), a["y"].alias("y1"), b["x"].alias("x2"), b["y"].alias("y2")))

    all_edges = F.flatten(F.transform(F.filter(rings, lambda r: F.size(r) > 1), edges_of))
    return F.filter(all_edges, lambda e: (e["x1"] != e["x2"]) | (e["y1"] != e["y2"]))


def touches_expr(px: str, py: str, edges: str = "edges") -> Column:
    """Whether the point lies on one of the edges."""
    on_edge = (f"(e.x2 - e.x1) * ({py} - e.y1) - (e.y2 - e.y1) * ({px} - e.x1) = 0 "
               f"AND {px} BETWEEN least(e.x1, e.x2) AND greatest(e.x1, e.x2) "
               f"AND {py} BETWEEN least(e.y1, e.y2) AND greatest(e.y1, e.y2)")
    return F.expr(f"exists({edges}, e -> {on_edge})")


def odd_crossings_expr(px: str, py: str, edges: str = "edges") -> Column:
    """Whether the ray to the right crosses an odd number of the edges.

    The division sits inside the CASE that guarantees y1 != y2, so ANSI mode never divides by 0.
    """
    crossing = (f"CASE WHEN (e.y1 > {py}) <> (e.y2 > {py}) "
                f"THEN {px} < e.x1 + ({py} - e.y1) * (e.x2 - e.x1) / (e.y2 - e.y1) ELSE false END")
    return F.expr(f"aggregate({edges}, false, (acc, e) -> acc <> ({crossing}))")


def covers_expr(px: str, py: str, edges: str = "edges") -> Column:
    """Boundary-inclusive point-in-polygon over an edge array (even-odd rule)."""
    return touches_expr(px, py, edges) | odd_crossings_expr(px, py, edges)


BAND_EDGES = 64         # polygons with more edges are kept in bands of about half as many


def band_count(n_edges: Column) -> Column:
    """Bands of the finest level: a power of two, so that a band holds about ``BAND_EDGES / 2`` short edges."""
    return F.pow(F.lit(2.0), F.ceil(F.log2(F.greatest(n_edges, F.lit(1)) * 2.0 / BAND_EDGES)))


def edge_bands(polys: DataFrame) -> DataFrame:
    """``_fid, level, band, edges`` of polygons: bands double their height per level, and an edge lies on the
    level where its own height fits, so in two bands at most. A point's ray and a touching edge share the
    point's y, hence a band of every level that the edge can be on."""
    bottom, height = F.col("miny"), (F.col("maxy") - F.col("miny")) / band_count(F.size("edges"))
    one = polys.select("_fid", bottom.alias("bottom"), height.alias("height"), F.explode("edges").alias("e"))
    lo, hi = F.least("e.y1", "e.y2"), F.greatest("e.y1", "e.y2")
    leveled = one.withColumn("level", band_level(hi - lo, F.col("height")))
    placed = leveled.withColumn("band", F.explode(F.sequence(band_of(lo, "bottom", "height", "level"), band_of(hi, "bottom", "height", "level"))))
    return placed.groupBy("_fid", "level", "band").agg(F.collect_list("e").alias("edges"))


def band_level(extent: Column, height: Column) -> Column:
    return F.when(extent > height, F.ceil(F.log2(extent / height))).otherwise(F.lit(0)).cast("int")


def band_of(y: Column, bottom: str, height: str, level: str) -> Column:
    """Number of the band that holds ``y``; monotone in ``y``. A polygon without height has one band."""
    tall = F.col(height) * F.pow(F.lit(2.0), F.col(level))
    return F.when(tall > 0, F.floor((y - F.col(bottom)) / F.when(tall > 0, tall))).otherwise(F.lit(0)).cast("long")


def banded_hits(cand: DataFrame, polys: DataFrame) -> DataFrame:
    """``_x, _y, _ord`` of the candidate pairs (_x, _y, _fid) whose point a polygon with many edges covers."""
    bands = edge_bands(polys)
    levels = bands.groupBy("_fid").agg(F.sort_array(F.collect_set("level")).alias("levels"))     # a few per polygon
    heads = polys.select("_fid", "_ord", F.col("miny").alias("bottom"),
                         ((F.col("maxy") - F.col("miny")) / band_count(F.size("edges"))).alias("height")).join(levels, "_fid")
    asked = (cand.join(heads, "_fid").withColumn("level", F.explode("levels"))
             .withColumn("band", band_of(F.col("_y"), "bottom", "height", "level")))
    met = asked.join(bands, ["_fid", "level", "band"]).select(
        "_x", "_y", "_ord", touches_expr("_x", "_y").alias("on"), odd_crossings_expr("_x", "_y").cast("int").alias("odd"))
    return (met.groupBy("_x", "_y", "_ord").agg(F.max("on").alias("on"), F.sum("odd").alias("odd"))
            .where(F.col("on") | (F.col("odd") % 2 == 1)).select("_x", "_y", "_ord"))


def polygon_table(features: DataFrame, feature_id: str, order: str, attrs: list[str],
                  geometry: str = "geometry", project=None) -> DataFrame:
    """Features -> (feature_id, order, attrs, edges, minx, miny, maxx, maxy)."""
    t = features.select(F.col(feature_id).alias("_fid"), F.col(order).alias("_ord"), *attrs,
                        ring_edges(polygon_rings(geometry), project).alias("edges"))
    return t.select("*",
                    F.array_min(F.transform("edges", lambda e: F.least(e["x1"], e["x2"]))).alias("minx"),
                    F.array_min(F.transform("edges", lambda e: F.least(e["y1"], e["y2"]))).alias("miny"),
                    F.array_max(F.transform("edges", lambda e: F.greatest(e["x1"], e["x2"]))).alias("maxx"),
                    F.array_max(F.transform("edges", lambda e: F.greatest(e["y1"], e["y2"]))).alias("maxy")) \
            .where(F.size("edges") > 0)


def suggest_cell(polys: DataFrame) -> float:
    """Tile side from the layer itself: half the median bbox side of its polygons (one scalar
    action over the polygon table). Typical polygons then span a handful of tiles, so neither the
    tile table nor the candidate pairs per point grow large; results do not depend on it."""
    side = F.greatest(F.col("maxx") - F.col("minx"), F.col("maxy") - F.col("miny"))
    med = polys.agg(F.percentile_approx(side, 0.5).alias("m")).first()["m"]
    return float(med) / 2.0 if med else 1.0


def level_of(side: Column, cell: float) -> Column:
    """Grid level of a shape: tiles double per level, and a shape of level n spans at most three tiles
    of its level in either direction."""
    level = F.greatest(F.ceil(F.log2(F.greatest(side, F.lit(cell)) / (2.0 * cell))), F.lit(0))
    return F.least(level, F.lit(MAX_LEVEL)).cast("int")


def tile_side(level: Column, cell: float) -> Column:
    return F.lit(float(cell)) * F.pow(F.lit(2.0), level)


def polygon_tiles(polys: DataFrame, cell: float) -> DataFrame:
    """(_fid, bbox, level, gx, gy): the tiles of each polygon's bounding box on the grid of its level.
    At most nine tiles per polygon, however unequal the polygons' sizes are."""
    side = F.greatest(F.col("maxx") - F.col("minx"), F.col("maxy") - F.col("miny"))
    leveled = polys.select("_fid", "minx", "miny", "maxx", "maxy", level_of(side, cell).alias("level"))
    c = tile_side(F.col("level"), cell)
    return (leveled.withColumn("gx", F.explode(F.sequence(F.floor(F.col("minx") / c), F.floor(F.col("maxx") / c))))
            .withColumn("gy", F.explode(F.sequence(F.floor(F.col("miny") / c), F.floor(F.col("maxy") / c)))))


def layer_shape(polys: DataFrame, cell: float) -> tuple[Column, int]:
    """The grid levels that occur (an array; a few entries) and the most edges of a polygon: one scalar action
    over the polygon table."""
    side = F.greatest(F.col("maxx") - F.col("minx"), F.col("maxy") - F.col("miny"))
    row = polys.select(level_of(side, cell).alias("level"), F.size("edges").alias("n")).agg(
        F.bit_or(F.expr("shiftleft(1L, level)")), F.max("n")).first()
    mask = row[0] or 0
    return F.array(*[F.lit(n) for n in range(MAX_LEVEL + 1) if mask >> n & 1]).cast("array<int>"), row[1] or 0


def locate_points(points: DataFrame, polys: DataFrame, *, x: str, y: str, attrs: list[str],
                  cell: float | None = None) -> DataFrame:
    """For each distinct non-null (x, y): the attrs of the first covering polygon by order.

    Returns (x, y, attrs...) for located coordinates only. ``cell=None`` picks the tile side from
    the polygons (``suggest_cell``).
    """
    c = float(cell) if cell else suggest_cell(polys)
    levels, most_edges = layer_shape(polys, c)
    coords = (points.select(F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y"))
                    .where(F.col("_x").isNotNull() & F.col("_y").isNotNull()
                           & ~F.isnan("_x") & ~F.isnan("_y"))
                    .distinct()
                    .withColumn("level", F.explode(levels))
                    .withColumn("gx", F.floor(F.col("_x") / tile_side(F.col("level"), c)))
                    .withColumn("gy", F.floor(F.col("_y") / tile_side(F.col("level"), c))))
    cand = (coords.join(polygon_tiles(polys, c), ["level", "gx", "gy"])
                  .where(F.col("_x").between(F.col("minx"), F.col("maxx"))
                         & F.col("_y").between(F.col("miny"), F.col("maxy")))
                  .select("_x", "_y", "_fid"))
    few = polys.where(F.size("edges") <= BAND_EDGES) if most_edges > BAND_EDGES else polys
    hits = (cand.join(few.select("_fid", "_ord", "edges"), "_fid")
                .where(covers_expr("_x", "_y")).select("_x", "_y", "_ord"))
    if most_edges > BAND_EDGES:
        hits = hits.unionAll(banded_hits(cand, polys.where(F.size("edges") > BAND_EDGES)))
    # first match = smallest feature order (unique per feature, numeric): min() keeps the
    # aggregation buffer fixed width, so this stays a hash aggregate with partial aggregation
    # (a struct or string buffer would force a sort of all candidate pairs); attributes join back
    best = hits.groupBy("_x", "_y").agg(F.min("_ord").alias("_ord"))
    attrs_side = polys.select("_ord", *attrs)
    return best.join(attrs_side, "_ord").select("_x", "_y", *attrs)


def attach_points(points: DataFrame, features: DataFrame, *, x: str, y: str, feature_id: str,
                  order: str, mapping: dict[str, str], cell: float | None = None, project=None,
                  geometry: str = "geometry") -> DataFrame:
    """Left-attach polygon attributes (``mapping``: feature column -> output column) to every
    point row; rows with missing coordinates or outside all polygons get NULLs."""
    polys = polygon_table(features, feature_id, order, list(mapping), geometry, project)
    polys = polys.select("_fid", "_ord", "edges", "minx", "miny", "maxx", "maxy",
                         *[F.col(src).alias(dst) for src, dst in mapping.items()])
    found = locate_points(points, polys, x=x, y=y, attrs=list(mapping.values()), cell=cell)
    base = points.drop(*[d for d in mapping.values() if d in points.columns])
    # rows without coordinates take no part in the join, where they would share one NULL key
    placed = base.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    joined = placed.join(found, (placed[x] == found["_x"]) & (placed[y] == found["_y"]), "left").drop("_x", "_y")
    nowhere = base.where(F.col(x).isNull() | F.col(y).isNull())
    kinds = dict(found.dtypes)
    return joined.unionByName(nowhere.select("*", *[F.lit(None).cast(kinds[d]).alias(d) for d in mapping.values()]))


def cell_exposure(cells: DataFrame, districts: DataFrame, *, feature_id: str, cell: float | None = None,
                  category: str = "category", project=None) -> DataFrame:
    """Area-weighted noise/air exposure per district from classified rectangular cells.

    Each cell with positive area is assigned to the first district (by id) covering its bbox
    centre; per district: noise = sum(class % 10 * area) / sum(area) (round 3), air likewise with
    class div 10, share of area with noise class 3 (round 2) and cell count. Districts without
    cells get 0 everywhere (the reference divides by 1 in that case).
    """
    from ..functions.geo import bbox_centre_area
    from ..functions.numeric import round_half_even

    cx, cy, area = bbox_centre_area()
    prepared = (cells.select(F.col(category).cast("int").alias("_cat"), cx.alias("_cx"), cy.alias("_cy"),
                             area.alias("_area"))
                     .where(F.col("_area") > 0))
    # pre-aggregate per cell centre before the spatial join: only distinct centres are located
    # and joined back, and the per-district sums add up the per-centre partial sums
    per_centre = materialize(prepared.groupBy("_cx", "_cy").agg(
        F.count(F.lit(1)).alias("_n"),
        F.sum("_area").alias("_total"),
        F.sum((F.col("_cat") % 10) * F.col("_area")).alias("_noise"),
        F.sum(F.expr("_cat div 10") * F.col("_area")).alias("_air"),
        F.sum(F.when(F.col("_cat") % 10 == 3, F.col("_area")).otherwise(0.0)).alias("_high")))
    located = attach_points(per_centre, districts, x="_cx", y="_cy", feature_id=feature_id,
                            order=feature_id, mapping={feature_id: "_district"}, cell=cell,
                            project=project)
    per = located.where(F.col("_district").isNotNull()).groupBy("_district").agg(
        F.sum("_n").alias("noise_cell_count"),
        *[F.sum(c).alias(c) for c in ["_total", "_noise", "_air", "_high"]])
    ids = districts.select(F.col(feature_id).alias("_district")).distinct()
    out = ids.join(per, "_district", "left")
    total = F.coalesce(F.col("_total"), F.lit(1.0))
    z = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    return out.select(
        F.col("_district").alias("arrondissement"),
        round_half_even(z("_noise") / total, 3).alias("noise_score"),
        round_half_even(z("_air") / total, 3).alias("air_score"),
        round_half_even(z("_high") / total * 100.0, 2).alias("high_noise_share_pct"),
        F.coalesce(F.col("noise_cell_count"), F.lit(0)).alias("noise_cell_count"))
