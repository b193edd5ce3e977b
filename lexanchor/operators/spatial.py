"""Radius self-join and region containment on the sphere: Voronoi cells around pivots and local vantage-point trees.

Plan: a bounded set of pivots is drawn by hash order and broadcast (its size is a parameter).
Every point goes to the cell of its nearest pivot, which a tree over the pivots finds, and is
replicated to each cell whose pivot is at most ``2 r`` farther away, which by the triangle
inequality puts both ends of every pair within ``r`` into the home cell of either end. A pair is
emitted only in the home cell of its smaller id. A cell with more points than ``max_cell`` gets
pivots of its own, and its points are placed among them by the same rule, again and again; cells
too narrow for that, in which a good part of all pairs is within the radius, are joined in chunks,
so that no task ever holds an unbounded group however the points are spread.

Regions are polygons. A region goes to every cell that may be home to a point in it, by the same
inequality with the radius of its hull, and is tested exactly there.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexanchor.session import cut_lineage

EARTH_KM = 6371.0
LEAF = 24
#: Slack in radians (about 6 micrometres) for rounding in the pruning tests; the final test is exact.
SLACK = 1e-12


def unit_vectors(lat: np.ndarray, lon: np.ndarray) -> np.ndarray:
    la, lo = np.radians(lat), np.radians(lon)
    return np.stack([np.cos(la) * np.cos(lo), np.cos(la) * np.sin(lo), np.sin(la)], axis=1)


def angles(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Great-circle angle between rows of unit vectors, by the chord, exact for small angles too."""
    chord = np.sqrt(((a - b) ** 2).sum(axis=-1))
    return 2.0 * np.arcsin(np.minimum(1.0, chord / 2.0))


def haversine_km(lat1, lon1, lat2, lon2) -> np.ndarray:
    p1, p2 = np.radians(lat1), np.radians(lat2)
    a = np.sin((p2 - p1) / 2) ** 2 + np.cos(p1) * np.cos(p2) * np.sin(np.radians(lon2 - lon1) / 2) ** 2
    a = np.clip(a, 0.0, 1.0)
    return EARTH_KM * 2.0 * np.arctan2(np.sqrt(a), np.sqrt(1.0 - a))


class VantagePointTree:
    """Metric tree over unit vectors; queries descend in batches, so each node is one numpy call."""

    def __init__(self, xyz: np.ndarray):
        self.xyz = xyz
        self.nodes: list[tuple] = []
        self.root = self._build(np.arange(len(xyz)))

    def _build(self, members: np.ndarray) -> int:
        root, work = -1, [(members, None, 0)]
        while work:
            members, parent, side = work.pop()
            at = len(self.nodes)
            if parent is None:
                root = at
            else:
                self.nodes[parent][side] = at
            if len(members) <= LEAF:
                self.nodes.append([None, members, 0.0, -1, -1])
                continue
            vantage, rest = members[0], members[1:]
            far = angles(self.xyz[rest], self.xyz[vantage])
            middle = float(np.median(far))
            near = far <= middle
            if near.all():  # many copies of one place: cut by count, the bound stays valid on both sides
                near = np.zeros(len(rest), bool)
                near[: len(rest) // 2] = True
                low = 0.0
            else:
                low = middle
            self.nodes.append([vantage, (middle, low), 0.0, -1, -1])
            work.append((rest[near], at, 3))
            work.append((rest[~near], at, 4))
        return root

    def nearest(self, queries: np.ndarray) -> np.ndarray:
        """The angle from each query to the nearest member."""
        best = np.full(len(queries), np.inf)

        def visit(at: int, asked: np.ndarray) -> None:
            if at < 0 or not len(asked):
                return
            vantage, content, _, near, far = self.nodes[at]
            if vantage is None:
                if len(content):
                    d = angles(queries[asked][:, None, :], self.xyz[content][None, :, :]).min(axis=1)
                    best[asked] = np.minimum(best[asked], d)
                return
            d = angles(queries[asked], self.xyz[vantage])
            best[asked] = np.minimum(best[asked], d)
            middle, low = content
            inner = d <= middle
            visit(near, asked[inner])
            visit(far, asked[~inner])
            visit(far, asked[inner & (d + best[asked] >= low)])
            visit(near, asked[~inner & (d - best[asked] <= middle)])

        visit(self.root, np.arange(len(queries)))
        return best

    def within(self, queries: np.ndarray, radius: float | np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All (query, member) index pairs at an angle of at most ``radius``, which each query may have of its own."""
        radius = np.broadcast_to(radius, len(queries))
        left, right = [], []
        work = [(self.root, np.arange(len(queries)))] if self.root >= 0 else []
        while work:
            at, asked = work.pop()
            if at < 0 or not len(asked):
                continue
            vantage, content, _, near, far = self.nodes[at]
            if vantage is None:
                if len(content):
                    d = angles(queries[asked][:, None, :], self.xyz[content][None, :, :])
                    q, m = np.nonzero(d <= radius[asked][:, None])
                    left.append(asked[q])
                    right.append(content[m])
                continue
            d = angles(queries[asked], self.xyz[vantage])
            own = radius[asked]
            hit = asked[d <= own]
            left.append(hit)
            right.append(np.full(len(hit), vantage))
            middle, low = content
            work.append((near, asked[d <= middle + own]))
            work.append((far, asked[d >= low - own]))
        if not left:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        return np.concatenate(left), np.concatenate(right)


def cells_of(tree: VantagePointTree, xyz: np.ndarray, reach: float | np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, cell, whether it's the row's home) of the nearest pivot of each point and of every one at most ``reach`` farther."""
    row, cell = tree.within(xyz, tree.nearest(xyz) + reach + SLACK)
    order = np.lexsort((cell, angles(xyz[row], tree.xyz[cell]), row))
    row, cell = row[order], cell[order]
    home = np.ones(len(row), bool)
    home[1:] = row[1:] != row[:-1]
    return row, cell, home


def _assign(pivots, reach: float):
    """Home cell and replica cells of each point."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tree = None
        for pdf in batches:
            tree = tree or VantagePointTree(pivots.value)
            row, cell, home = cells_of(tree, unit_vectors(pdf["lat"].to_numpy(), pdf["lon"].to_numpy()), reach)
            out = pdf.iloc[row].reset_index(drop=True)
            out["cell"], out["home"] = cell.astype(str), home
            yield out

    return run


def _assign_again(pivots, reach: float):
    """Points of crowded cells placed among their cell's own pivots; a cell no wider than the reach stays whole."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name, part in pdf.groupby("cell"):
                own = pivots.value.get(name)
                if own is None or len(own) < 2 or angles(own[:1], own).max() <= reach:
                    yield part.assign(cell=f"{name}!")  # not cut again
                    continue
                row, cell, home = cells_of(VantagePointTree(own), unit_vectors(part["lat"].to_numpy(), part["lon"].to_numpy()), reach)
                out = part.iloc[row].reset_index(drop=True)
                out["cell"], out["home"] = f"{name}/" + pd.Series(cell).astype(str), out["home"].to_numpy() & home
                yield out

    return run


def _local_join(radius_km: float):
    angle = radius_km / EARTH_KM + SLACK

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        first = pdf[pdf["chunk"] == pdf["i"]]
        second = pdf[pdf["chunk"] == pdf["j"]]
        same = int(pdf["i"].iat[0]) == int(pdf["j"].iat[0])
        empty = pd.DataFrame({"a": pd.Series(dtype=object), "b": pd.Series(dtype=object)})
        if not len(first) or not len(second):
            return empty
        tree = VantagePointTree(unit_vectors(second["lat"].to_numpy(), second["lon"].to_numpy()))
        q, m = tree.within(unit_vectors(first["lat"].to_numpy(), first["lon"].to_numpy()), angle)
        x, y = first["id"].to_numpy()[q], second["id"].to_numpy()[m]
        hx, hy = first["home"].to_numpy()[q], second["home"].to_numpy()[m]
        if same:
            keep = (x < y) & hx
        else:
            keep = np.where(x < y, hx, hy) & (x != y)
        q, m, x, y = q[keep], m[keep], x[keep], y[keep]
        d = haversine_km(
            first["lat"].to_numpy()[q], first["lon"].to_numpy()[q], second["lat"].to_numpy()[m], second["lon"].to_numpy()[m]
        )
        near = d < radius_km
        x, y = x[near], y[near]
        low = x < y
        return pd.DataFrame({"a": np.where(low, x, y), "b": np.where(low, y, x)})

    return run


def valid_points(df: DataFrame, id_col: str, lat_col: str, lon_col: str) -> DataFrame:
    """Distinct (id, lat, lon) with a usable coordinate: finite, in range, not 0/0, id not null."""
    lat, lon = F.col(lat_col).cast("double"), F.col(lon_col).cast("double")
    return (
        df.select(F.col(id_col).alias("id"), lat.alias("lat"), lon.alias("lon"))
        .where(F.col("id").isNotNull() & F.col("lat").between(-90.0, 90.0) & F.col("lon").between(-180.0, 180.0))
        .where(~F.isnan("lat") & ~F.isnan("lon") & ~((F.col("lat") == 0) & (F.col("lon") == 0)))
        .distinct()
    )


#: Pivots of a crowded cell, on average, and how often cells are cut.
BRANCH, LEVELS = 256, 6


def _draw_pivots(points: DataFrame, n: int, points_per_pivot: int, max_pivots: int):
    wanted = max(1, min(max_pivots, n // points_per_pivot))
    drawn = points.select("lat", "lon").orderBy(F.xxhash64("lat", "lon"), "lat", "lon").limit(wanted).collect()
    return points.sparkSession.sparkContext.broadcast(unit_vectors(np.array([r[0] for r in drawn]), np.array([r[1] for r in drawn])))


def place_points(points: DataFrame, n: int, reach: float, points_per_pivot: int, max_pivots: int, max_cell: int) -> DataFrame:
    """``(id, lat, lon, cell, home, parts)`` of points in their cells; cells of more than ``max_cell`` points are to be joined in parts.

    Of each level, the ``max_pivots`` most crowded cells are cut at most, which bounds the
    pivots that are broadcast to ``max_pivots * BRANCH``; what stays crowded has several parts.
    """
    context = points.sparkSession.sparkContext
    schema = f"id {points.schema['id'].dataType.simpleString()}, lat double, lon double, cell string, home boolean"
    placed = cut_lineage(points.mapInPandas(_assign(_draw_pivots(points, n, points_per_pivot, max_pivots), reach), schema))
    for level in range(LEVELS):
        loads = placed.groupBy("cell").count()
        crowded = loads.where((F.col("count") > max_cell) & ~F.col("cell").endswith("!")).orderBy(F.col("count").desc(), "cell").limit(max_pivots)
        crowded = crowded.select("cell", F.least(F.lit(BRANCH), F.ceil(F.col("count") / points_per_pivot)).alias("wanted"), "count")
        if not crowded.head(1):
            break
        hot = placed.join(F.broadcast(crowded), "cell")  # a bounded number of rows
        chance = F.pmod(F.xxhash64("lat", "lon", F.lit(level)), F.lit(1 << 40)) < F.lit(float(1 << 40)) * F.col("wanted") / F.col("count")
        drawn = hot.where(chance).select("cell", "lat", "lon").distinct().toPandas()
        own = {name: unit_vectors(part["lat"].to_numpy(), part["lon"].to_numpy()) for name, part in drawn.sort_values(["lat", "lon"]).groupby("cell")}
        cut = hot.select("id", "lat", "lon", "cell", "home").mapInPandas(_assign_again(context.broadcast(own), reach), schema)
        rest = placed.join(F.broadcast(crowded.select("cell")), "cell", "left_anti").select(*cut.columns)
        placed = cut_lineage(rest.unionByName(cut))
    loads = placed.groupBy("cell").agg(F.ceil(F.count("*") / F.lit(max_cell)).cast("int").alias("parts"))
    return placed.join(loads, "cell")


def radius_pairs(
    df: DataFrame,
    id_col: str,
    lat_col: str,
    lon_col: str,
    radius_km: float,
    points_per_pivot: int = 1500,
    max_pivots: int = 8192,
    max_cell: int = 20_000,
) -> DataFrame:
    """Pairs ``(a, b)``, a < b, of different ids less than ``radius_km`` apart.

    Nulls, NaN, infinities, out-of-range values and 0/0 are in no pair; repeated rows count
    once; an id with several coordinates pairs through any of them, wherefore pairs are made
    distinct; an empty table gives no rows; other columns, whatever their names, are ignored.
    ``max_pivots`` bounds what is broadcast (24 bytes a pivot), ``max_cell`` what one task
    holds of a cell.
    """
    spark = df.sparkSession
    points = valid_points(df, id_col, lat_col, lon_col)
    id_type = points.schema["id"].dataType.simpleString()
    schema = f"a {id_type}, b {id_type}"
    n = points.count()
    if n == 0:
        return spark.createDataFrame([], schema)
    placed = place_points(points, n, 2 * (radius_km / EARTH_KM + SLACK), points_per_pivot, max_pivots, max_cell)
    chunked = placed.withColumn("chunk", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    others = F.sequence(F.lit(0), F.col("parts") - 1)
    grouped = (
        chunked.withColumn("other", F.explode(others))
        .withColumn("i", F.least("chunk", "other"))
        .withColumn("j", F.greatest("chunk", "other"))
        .select("cell", "i", "j", "chunk", "id", "lat", "lon", "home")
    )
    pairs = grouped.groupBy("cell", "i", "j").applyInPandas(_local_join(radius_km), schema)
    return pairs.distinct()


def inside(lat: np.ndarray, lon: np.ndarray, lats: np.ndarray, lons: np.ndarray) -> np.ndarray:
    """Whether points lie in the polygon or on its border, its edges straight in latitude and longitude."""
    odd, border = np.zeros(len(lat), bool), np.zeros(len(lat), bool)
    for x1, y1, x2, y2 in zip(lons, lats, np.roll(lons, -1), np.roll(lats, -1), strict=True):
        side = (x2 - x1) * (lat - y1) - (y2 - y1) * (lon - x1)
        border |= (side == 0) & (lat >= min(y1, y2)) & (lat <= max(y1, y2)) & (lon >= min(x1, x2)) & (lon <= max(x1, x2))
        crosses = (y1 > lat) != (y2 > lat)
        odd ^= crosses & ((side < 0) if y2 > y1 else (side > 0))
    return odd | border


def hull(lats: np.ndarray, lons: np.ndarray) -> tuple[np.ndarray, float]:
    """A centre and an angle from it that no point of the polygon exceeds."""
    corners = unit_vectors(lats, lons)
    centre = corners.sum(axis=0)
    size = float(np.sqrt((centre**2).sum()))
    if size < 1e-9:
        return corners[0], np.pi
    centre = centre / size
    # a point of an edge is no farther from one of its ends than half the edge is long
    edges = np.radians(np.hypot(np.roll(lats, -1) - lats, np.roll(lons, -1) - lons)) / 2
    radius = float(angles(corners, centre[None, :]).max() + edges.max())
    return centre, radius if radius < np.pi / 2 else np.pi


def _place_regions(pivots):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tree = None
        for pdf in batches:
            tree = tree or VantagePointTree(pivots.value)
            hulls = [hull(np.asarray(a, float), np.asarray(b, float)) for a, b in zip(pdf["lats"], pdf["lons"], strict=True)]
            if hulls:
                row, cell, _ = cells_of(tree, np.stack([c for c, _ in hulls]), 2 * np.array([r for _, r in hulls]))
                out = pdf.iloc[row].reset_index(drop=True)
                out["cell"] = cell.astype(str)
                yield out

    return run


def _contained(points: pd.DataFrame, regions: pd.DataFrame) -> pd.DataFrame:
    points = points.sort_values("lat", kind="stable")
    lat, lon, ids = points["lat"].to_numpy(), points["lon"].to_numpy(), points["id"].to_numpy()
    found, of = [ids[:0]], [regions["region"].to_numpy()[:0]]
    for region, lats, lons in zip(regions["region"], regions["lats"], regions["lons"], strict=True):
        lats, lons = np.asarray(lats, float), np.asarray(lons, float)
        low, high = np.searchsorted(lat, lats.min(), "left"), np.searchsorted(lat, lats.max(), "right")
        at = low + np.flatnonzero((lon[low:high] >= lons.min()) & (lon[low:high] <= lons.max()))
        at = at[inside(lat[at], lon[at], lats, lons)]
        if len(at):
            found.append(ids[at])
            of.append(np.array([region] * len(at), object))
    return pd.DataFrame({"id": np.concatenate(found), "region": np.concatenate(of)})


def containing_regions(
    df: DataFrame,
    id_col: str,
    lat_col: str,
    lon_col: str,
    regions: DataFrame,
    region_col: str = "region",
    lats_col: str = "lats",
    lons_col: str = "lons",
    points_per_pivot: int = 1500,
    max_pivots: int = 8192,
    max_cell: int = 20_000,
) -> DataFrame:
    """Distinct ``(id, region)``: the point lies in the polygon or on its border.

    Polygons are lists of corner latitudes and longitudes in order, not closed, with edges
    straight in latitude and longitude, which don't cross the date line. Unusable points are as
    in ``radius_pairs``; a region with fewer than three corners, null corners or lists of
    different length contains nothing; an id with several coordinates is in any region of them;
    an empty table gives no rows; other columns are ignored.
    """
    points = valid_points(df, id_col, lat_col, lon_col)
    shapes = regions.select(F.col(region_col).alias("region"), F.col(lats_col).cast("array<double>").alias("lats"), F.col(lons_col).cast("array<double>").alias("lons"))
    wrong = F.exists("lats", lambda x: x.isNull() | F.isnan(x)) | F.exists("lons", lambda x: x.isNull() | F.isnan(x))
    shapes = shapes.where((F.size("lats") >= 3) & (F.size("lats") == F.size("lons")) & F.col("region").isNotNull()).where(~wrong).distinct()
    id_type, region_type = points.schema["id"].dataType.simpleString(), shapes.schema["region"].dataType.simpleString()
    schema = f"id {id_type}, region {region_type}"
    n = points.count()
    if n == 0:
        return df.sparkSession.createDataFrame([], schema)
    pivots = _draw_pivots(points, n, points_per_pivot, max_pivots)
    homes = cut_lineage(points.mapInPandas(_assign(pivots, 0.0), f"id {id_type}, lat double, lon double, cell string, home boolean").where("home"))
    loads = homes.groupBy("cell").agg(F.ceil(F.count("*") / F.lit(max_cell)).cast("int").alias("parts"))
    mine = homes.join(F.broadcast(loads), "cell").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    placed = shapes.mapInPandas(_place_regions(pivots), f"region {region_type}, lats array<double>, lons array<double>, cell string")
    theirs = placed.join(F.broadcast(loads), "cell").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    both = mine.select("cell", "part", "id", "lat", "lon").groupBy("cell", "part").cogroup(theirs.select("cell", "part", "region", "lats", "lons").groupBy("cell", "part"))
    return both.applyInPandas(_contained, schema).distinct()
