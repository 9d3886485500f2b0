"""Points, cells, pixels, polygons and terrain."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo


def assign_cell(df: DataFrame, size: float = 5000.0, lon: str = "lon", lat: str = "lat") -> DataFrame:
    """Integer Web-Mercator cell of every point; a computed key, so no spatial join is needed."""
    x, y = geo.to_mercator(F.col(lon), F.col(lat))
    return df.withColumns({"cell_x": geo.snap(x, size), "cell_y": geo.snap(y, size)})


def sample_pixels(
    points: DataFrame,
    raster: DataFrame,
    size: float,
    values: Sequence[str],
    image: Sequence[str] = (),
    how: str = "inner",
) -> DataFrame:
    """The pixel under every point, at most one per image.

    ``raster`` has ``(px, py)`` pixel numbers of the same size plus the ``image`` columns (date).
    Of repeated pixels of an image the largest is kept whole, by its values in the order given, so
    a point meets each image once and never a mixture. Points crowd on few pixels; AQE splits those
    join partitions.
    """
    pixel = raster.groupBy("px", "py", *image).agg(F.max(F.struct(*values)).alias("_pixel"))
    unique = pixel.select("px", "py", *image, *[F.col("_pixel")[v].alias(v) for v in values])
    x, y = geo.to_mercator(F.col("lon"), F.col("lat"))
    placed = points.withColumns({"px": geo.snap(x, size), "py": geo.snap(y, size)})
    return placed.join(unique, ["px", "py"], how)


def _edges(ring: Column) -> Column:
    """Edges of a ring of (x, y) structs; the closing edge back to the start is included."""
    n = F.size(ring)
    shifted = F.concat(F.slice(ring, 2, n), F.slice(ring, 1, 1))
    return F.zip_with(
        ring,
        shifted,
        lambda a, b: F.struct(
            a["x"].alias("ax"), a["y"].alias("ay"), b["x"].alias("bx"), b["y"].alias("by")
        ),
    )


def _crosses(x: Column, y: Column, e: Column) -> Column:
    """1 when the edge crosses the ray from (x, y) to the right, else 0.

    An odd number of crossings means inside; left and bottom boundaries count as inside.
    """
    spans = (e["ay"] > y) != (e["by"] > y)
    at = (e["bx"] - e["ax"]) * (y - e["ay"]) / (e["by"] - e["ay"]) + e["ax"]
    return F.when(spans & (x < at), 1).otherwise(0)


def _rings(shapes: DataFrame) -> Column:
    """All rings of a shape: those of its ``parts``, else its one ``ring``.

    Crossings are counted over all rings together, so holes and further parts need no care.
    """
    return F.flatten("parts") if "parts" in shapes.columns else F.array("ring")


def _reach(e: Column, row: Column, tile: float, height: float) -> tuple[Column, Column]:
    """First and last tile column that the edge can be in while it is in a row of tiles.

    A little wider than computed, so that rounding of a crossing never leaves the range.
    """
    ax, ay, bx, by = (e[k] for k in ("ax", "ay", "bx", "by"))
    left, right = F.least(ax, bx), F.greatest(ax, bx)
    slack = (F.abs(ax) + F.abs(bx) + 1) * F.lit(1e-9)
    at = lambda y: (bx - ax) * F.try_divide(y - ay, by - ay) + ax
    one, two = at(row * F.lit(height)), at((row + 1) * F.lit(height))
    low = F.greatest(left, F.coalesce(F.least(one, two) - slack, left))
    high = F.least(right, F.coalesce(F.greatest(one, two) + slack, right))
    return geo.snap(F.least(low, high), tile), geo.snap(F.greatest(low, high), tile)


def _runs(events: DataFrame, line: Sequence[str], at: str) -> DataFrame:
    """(line, _from, _to): where an odd number of ``events`` lies to the right, per line.

    The scan along a line sees one row per place with an event; only odd runs come out.
    """
    counts = events.groupBy(*line, at).agg(F.count(F.lit(1)).alias("_k"))
    along = Window.partitionBy(*line).orderBy(F.desc(at))
    runs = counts.withColumn("_right", F.sum("_k").over(along)).withColumn("_next", F.lead(at).over(along))
    odd = runs.where((F.col("_right") % 2 == 1) & F.col("_next").isNotNull())
    return odd.select(*line, F.col("_next").alias("_from"), (F.col(at) - 1).alias("_to"))


def tile_edge_index(zones: DataFrame, tile: float, height: float) -> DataFrame:
    """(zone_id, tx, ty, edges, levels, odd): what decides whether a point of a tile is in a zone.

    ``edges`` are those that may lie in the tile. All edges to the right of it are one bit, ``odd``,
    which says whether their number is odd, and the ``levels`` of the few corners in the tile's row at which
    the outline comes from or goes to the right: each one above the point turns the bit. Tiles
    without any of the three are wholly outside and not listed.
    """
    # edges and corners of a small file or a long outline fill many tiles, so they are dealt to all tasks
    tasks = int(zones.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rings = zones.select("zone_id", F.explode(_rings(zones)).alias("ring"))
    row = lambda y: geo.snap(y, height)
    edges = rings.select("zone_id", F.explode(_edges(F.col("ring"))).alias("e")).repartition(tasks)
    e = F.col("e")
    low, high = row(F.least(e["ay"], e["by"])), row(F.greatest(e["ay"], e["by"]))
    listed = edges.select("zone_id", "e", F.explode(F.sequence(low, high)).alias("ty"))
    first, last = _reach(e, F.col("ty"), tile, height)
    listed = listed.select("zone_id", "e", "ty", first.alias("first"), last.alias("last"))
    near = listed.select("zone_id", "ty", "e", F.explode(F.sequence("first", "last")).alias("tx"))

    above = (row(e["ay"]) > F.col("ty")) != (row(e["by"]) > F.col("ty"))
    runs = _runs(listed.where(above).select("zone_id", "ty", "first"), ["zone_id", "ty"], "first")
    inside = runs.select("zone_id", "ty", F.explode(F.sequence("_from", "_to")).alias("tx"))

    # a corner concerns the tiles for which one of its two edges is to the right and the other is not
    n = F.size("ring")
    corner = F.transform(
        F.col("ring"),
        lambda p, i: F.struct(
            F.get(F.col("ring"), (i + n - 1) % n).alias("a"), p.alias("p"), F.get(F.col("ring"), (i + 1) % n).alias("b")
        ),
    )
    corners = rings.select("zone_id", F.explode(corner).alias("c")).repartition(tasks).withColumn("ty", row(F.col("c.p.y")))

    def edge(a: str, b: str) -> Column:
        c = F.col("c")
        return F.struct(c[a]["x"].alias("ax"), c[a]["y"].alias("ay"), c[b]["x"].alias("bx"), c[b]["y"].alias("by"))

    corners = corners.select("zone_id", "ty", F.col("c.p.y").alias("y"), edge("a", "p").alias("in"), edge("p", "b").alias("out"))
    one, two = (_reach(F.col(c), F.col("ty"), tile, height)[0] for c in ("in", "out"))
    corners = corners.withColumns({"one": one, "two": two}).where("one <> two")
    tiles = F.sequence(F.least("one", "two"), F.greatest("one", "two") - 1)
    levels = corners.select("zone_id", "ty", "y", F.explode(tiles).alias("tx"))

    none = lambda c, kind: F.lit(None).cast(kind).alias(c)
    kind = near.schema["e"].dataType
    key = ["zone_id", "tx", "ty"]
    entries = (
        near.select(*key, "e", none("y", "double"), none("one", "int"))
        .union(levels.select(*key, none("e", kind), "y", none("one", "int")))
        .union(inside.select(*key, none("e", kind), none("y", "double"), F.lit(1)))
    )
    return entries.groupBy(*key).agg(
        F.collect_list("e").alias("edges"), F.collect_list("y").alias("levels"), F.coalesce(F.max("one"), F.lit(0)).alias("odd")
    )


def _up_to_whole(index: DataFrame) -> DataFrame:
    """The entries of a ``tile_edge_index`` that can hold the lowest zone of a point.

    A zone with an odd bit and nothing else holds its whole tile, so no higher zone matters there.
    """
    whole = (F.size("edges") == 0) & (F.size("levels") == 0) & (F.col("odd") == 1)
    lowest = index.where(whole).groupBy("tx", "ty").agg(F.min("zone_id").alias("_whole"))
    kept = index.join(lowest.hint("merge"), ["tx", "ty"], "left")
    return kept.where(F.col("_whole").isNull() | (F.col("zone_id") <= F.col("_whole"))).drop("_whole")


def zone_of_point(
    points: DataFrame, zones: DataFrame, key: str, tile: float = 5.0, missing: int = -1, rows: int = 16
) -> DataFrame:
    """Lowest ``zone_id`` whose polygon holds the point, ``missing`` where there is none.

    Zones ``(zone_id, ring)`` or ``(zone_id, parts)``, with holes and several parts, become a
    ``tile_edge_index`` of tiles a ``rows``-th as high as they are wide. A point meets the entries of its tile
    in an equi join and casts its ray over their few edges; one exchange by point follows. Outlines
    of any length are cut up, and crowded tiles are split by AQE. Points need a unique key.

    Zones may overlap as they like: a tile keeps only the entries up to the lowest zone that holds all of it.
    Both joins are sort-merge joins, since the size of the index cannot be told from that of the zones, and a
    broadcast would take it through the driver.
    """
    height = tile / rows
    index = _up_to_whole(tile_edge_index(zones, tile, height))
    placed = points.select(
        key, "lon", "lat", geo.snap(F.col("lon"), tile).alias("tx"), geo.snap(F.col("lat"), height).alias("ty")
    )
    x, y = F.col("lon"), F.col("lat")
    crossed = F.size(F.filter("edges", lambda e: _crosses(x, y, e) == 1)) + F.size(F.filter("levels", lambda v: v > y))
    inside = (crossed + F.col("odd")) % 2 == 1
    met = placed.join(index.hint("merge"), ["tx", "ty"], "left").select(key, F.when(inside, F.col("zone_id")).alias("zone_id"))
    return met.groupBy(key).agg(F.coalesce(F.min("zone_id"), F.lit(missing)).cast("bigint").alias("zone_id"))


def _edge_meets_box(e: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """Does the segment share a point with the box? Slab clipping of its parameter range."""

    def slab(a: Column, b: Column, low: Column, high: Column) -> tuple[Column, Column]:
        d = b - a
        far = F.lit(float("inf"))
        t0, t1 = F.try_divide(low - a, d), F.try_divide(high - a, d)
        within = (a >= low) & (a <= high)
        enter = F.when(d != 0, F.least(t0, t1)).otherwise(F.when(within, -far).otherwise(far))
        leave = F.when(d != 0, F.greatest(t0, t1)).otherwise(F.when(within, far).otherwise(-far))
        return enter, leave

    in_x, out_x = slab(e["ax"], e["bx"], x0, x1)
    in_y, out_y = slab(e["ay"], e["by"], y0, y1)
    return F.greatest(in_x, in_y, F.lit(0.0)) <= F.least(out_x, out_y, F.lit(1.0))


def cover_grid(regions: DataFrame, size: float = 5000.0) -> DataFrame:
    """All cells that share a point with a region, with the region's attributes.

    ``ring`` or ``parts`` is in Web-Mercator metres; the other columns have to tell regions apart.
    A scan-line fill: every edge gives the cells that it touches, and on the lower side of each row of cells
    the places where it crosses; the cells between an odd and an even crossing are inside. Work grows
    with the cells along the outline plus the cells found, and every line is a group of its own.
    """
    rest = [c for c in regions.columns if c not in ("ring", "parts")]
    rings = regions.select(*rest, F.explode(_rings(regions)).alias("ring"))
    edges = rings.select(*rest, F.explode(_edges(F.col("ring"))).alias("e"))
    e = F.col("e")
    snap = lambda v: geo.snap(v, size)
    extent = regions.select(*rest, F.flatten(_rings(regions)).alias("_v"))
    lowest = lambda axis: snap(F.array_min(F.transform("_v", lambda p: p[axis])))
    extent = extent.select(*rest, lowest("x").alias("_x0"), lowest("y").alias("_y0"))
    same = [F.col(c).eqNullSafe(F.col(f"_r_{c}")) for c in rest]
    named = extent.withColumnsRenamed({c: f"_r_{c}" for c in rest})
    edges = edges.join(named, same).drop(*[f"_r_{c}" for c in rest]) if rest else edges.crossJoin(named.limit(1))

    # Touched cells: by columns, then the rows that the edge reaches there. A cell has its sides, so one
    # that only ends at an edge counts; none is left of or below all the region's corners.
    wide = edges.withColumn(
        "cell_x",
        F.explode(
            F.sequence(
                F.greatest(snap(F.least(e["ax"], e["bx"])) - 1, F.col("_x0")), snap(F.greatest(e["ax"], e["bx"]))
            )
        ),
    )
    at = lambda x: (e["by"] - e["ay"]) * F.try_divide(x - e["ax"], e["bx"] - e["ax"]) + e["ay"]
    low, high = F.least(e["ay"], e["by"]), F.greatest(e["ay"], e["by"])
    left = F.col("cell_x") * F.lit(size)
    one, two = at(left), at(left + F.lit(size))
    lower = snap(F.greatest(low, F.least(high, F.coalesce(F.least(one, two), low)))) - 1
    upper = F.least(snap(high), snap(F.greatest(low, F.least(high, F.coalesce(F.greatest(one, two), high)))) + 1)
    touched = wide.withColumn("cell_y", F.explode(F.sequence(F.greatest(lower, F.col("_y0")), F.greatest(upper, F.col("_y0")))))
    bottom = F.col("cell_y") * F.lit(size)
    touched = touched.where(_edge_meets_box(e, left, bottom, left + F.lit(size), bottom + F.lit(size)))

    # Inside: the last cell whose lower left corner has the crossing to its right, one more to be exclusive
    lines = edges.withColumn("cell_y", F.explode(F.sequence(F.greatest(snap(low), F.col("_y0")), snap(high) + 1)))
    spans = (e["ay"] > bottom) != (e["by"] > bottom)
    x = (e["bx"] - e["ax"]) * (bottom - e["ay"]) / (e["by"] - e["ay"]) + e["ax"]
    lines = lines.where(spans).withColumn("_at", x)
    m = snap(F.col("_at"))
    last = F.when((m + 1) * F.lit(size) < F.col("_at"), m + 1).when(m * F.lit(size) < F.col("_at"), m).otherwise(m - 1)
    events = lines.select(*rest, "cell_y", (last + 1).alias("_end"))
    runs = _runs(events, [*rest, "cell_y"], "_end")
    inside = runs.select(*rest, F.explode(F.sequence("_from", "_to")).alias("cell_x"), "cell_y")
    return touched.select(*rest, "cell_x", "cell_y").union(inside).distinct()


def cell_crop_area(
    pixels: DataFrame,
    cell: Sequence[str],
    is_crop: Column,
    area: str,
    threshold: float = 5_000_000.0,
) -> DataFrame:
    """Crop area per cell; cells above the threshold stay."""
    sums = pixels.groupBy(*cell).agg(
        F.sum(F.when(is_crop, F.col(area)).otherwise(F.lit(0.0))).alias("crop_area"),
        F.sum(area).alias("total_area"),
    )
    flagged = sums.withColumn("has_crop", (F.col("crop_area") > threshold).cast("int"))
    return flagged.where(F.col("has_crop") == 1)


def mosaic(tiles: DataFrame, pixel: Sequence[str], value: str, priority: str) -> DataFrame:
    """One value per pixel: the unmasked tile with the highest priority, ties by greatest value."""
    best = F.max(F.when(F.col(value).isNotNull(), F.struct(priority, value)))
    return tiles.groupBy(*pixel).agg(best.getField(value).alias(value))


def slope(dem: DataFrame, cell_m: float, x: str = "gx", y: str = "gy", z: str = "z") -> DataFrame:
    """Slope in degrees from the four neighbours; cells at a border or gap get NULL.

    Every cell sends its value to its neighbours and one aggregation collects them: rows and
    columns of any length, with or without gaps, never form a single group. What is sent is exchanged as it
    is: hardly two values for a cell come from one task, so combining them earlier only fills its memory.
    """
    sends = F.array(
        *[
            F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy"), F.lit(role).alias("role"))
            for dx, dy, role in (
                (0, 0, "own"),
                (-1, 0, "east"),
                (1, 0, "west"),
                (0, -1, "north"),
                (0, 1, "south"),
            )
        ]
    )
    sent = dem.select(x, y, z, F.explode(sends).alias("s")).select(
        (F.col(x) + F.col("s.dx")).alias(x),
        (F.col(y) + F.col("s.dy")).alias(y),
        F.col("s.role").alias("role"),
        z,
    ).repartition(x, y)
    value = lambda role: F.max(F.when(F.col("role") == role, F.col(z)))
    joined = sent.groupBy(x, y).agg(
        value("own").alias(z),
        value("east").alias("_e"),
        value("west").alias("_w"),
        value("north").alias("_n"),
        value("south").alias("_s"),
    )
    gx = (F.col("_e") - F.col("_w")) / F.lit(2.0 * cell_m)
    gy = (F.col("_n") - F.col("_s")) / F.lit(2.0 * cell_m)
    return joined.where(F.col(z).isNotNull()).select(
        x, y, z, F.degrees(F.atan(F.sqrt(gx * gx + gy * gy))).alias("slope")
    )
