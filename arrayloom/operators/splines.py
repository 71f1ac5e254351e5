"""Scattered data interpolated by multilevel cubic B-splines.

Each level spreads the residuals over the lattice cells around the points (a
generator and a partial aggregate), subtracts the level's surface from them
and halves the spacing. Points outside the box take no part in a level's fit.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arrayloom.sources.scratch import stored


def _weights(s: Column) -> list[Column]:
    """Cubic B-spline basis at the fraction s."""
    t = 1 - s
    return [t * t * t / 6, (3 * s * s * s - 6 * s * s + 4) / 6, (-3 * s * s * s + 3 * s * s + 3 * s + 1) / 6, s * s * s / 6]


@dataclass
class Surface:
    low: list[float]
    high: list[float]
    coords: list[str]
    lattices: list[tuple[list[int], DataFrame]]  # cells of each axis, (cell, phi)

    def _cells(self, df: DataFrame, grid: list[int]) -> DataFrame:
        """4 ** d rows a point: a lattice cell around it, its weight w, and the sum of squared weights."""
        squares = F.lit(1.0)
        for k, (c, lo, hi, g) in enumerate(zip(self.coords, self.low, self.high, grid, strict=True)):
            u = (F.col(c) - lo) * ((g - 1) / (hi - lo))
            df = df.withColumn(f"__i{k}", F.floor(u)).withColumn(f"__b{k}", F.array(*_weights(u - F.floor(u))))
            squares = squares * F.aggregate(f"__b{k}", F.lit(0.0), lambda s, x: s + x * x)
        df = df.withColumn("squares", squares).withColumn("__o", F.explode(F.sequence(F.lit(0), F.lit(4 ** len(grid) - 1))))
        cell, w, inside = F.lit(0).cast("long"), F.lit(1.0), F.lit(True)
        for k, g in enumerate(grid):
            o = F.floor(F.col("__o") / 4**k).cast("int") % 4
            i = F.col(f"__i{k}") + o  # 0 .. g + 1: moved by one, so that no cell is negative
            cell = cell * (g + 3) + i
            w = w * F.get(f"__b{k}", o)
            inside = inside & (i >= 0) & (i < g + 3)
        return df.select("*", cell.alias("cell"), w.alias("w"), inside.alias("inside"))

    def _inside(self) -> Column:
        ok = F.lit(True)
        for c, lo, hi in zip(self.coords, self.low, self.high, strict=True):
            ok = ok & (F.col(c) >= lo) & (F.col(c) < hi)
        return ok

    def _level(self, df: DataFrame, grid: list[int], value: str) -> DataFrame:
        w = F.col("w")
        phi = w * F.col(value) / F.col("squares")
        sums = self._cells(df.where(self._inside()), grid).groupBy("cell").agg(F.sum(w * w * phi).alias("d"), F.sum(w * w).alias("o"))
        return stored(sums.select("cell", F.when(F.col("o") == 0, 0.0).otherwise(F.col("d") / F.col("o")).alias("phi")), "lattice")

    def _value(self, df: DataFrame, grid: list[int], lattice: DataFrame, key: list[str], out: str) -> DataFrame:
        cells = self._cells(df.select(*key, *[c for c in self.coords if c not in key]), grid).where("inside").select(*key, "cell", "w")
        return cells.join(lattice, "cell", "left").groupBy(*key).agg(F.sum(F.col("w") * F.coalesce("phi", F.lit(0.0))).alias(out))

    def evaluate(self, df: DataFrame, key: str = "idx", out: str = "v") -> DataFrame:
        """(key, v): the surface at the points of ``df``; all levels in one join and one sum."""
        points = df.select(key, *[c for c in self.coords if c != key])
        cells = phi = None
        for level, (grid, lattice) in enumerate(self.lattices):
            own = self._cells(points, grid).where("inside").select(key, F.lit(level).alias("level"), "cell", "w")
            cells = own if cells is None else cells.union(own)
            own = lattice.select(F.lit(level).alias("level"), "cell", "phi")
            phi = own if phi is None else phi.union(own)
        if cells is None:
            return df.select(key, F.lit(0.0).alias(out))
        terms = cells.join(phi, ["level", "cell"]).select(key, (F.col("w") * F.col("phi")).alias("__t"))
        # points without a cell have the value zero
        return terms.union(points.select(key, F.lit(0.0))).groupBy(key).agg(F.sum("__t").alias(out))


def fit(points: DataFrame, coords: list[str], value: str, low: list[float], high: list[float], grid: list[int], levels: int = 8, tolerance: float = 1e-8) -> Surface:
    """Fit to ``points``; one small job a level, at most ``levels``."""
    s = Surface(list(low), list(high), list(coords), [])
    rest = stored(points.select(F.monotonically_increasing_id().alias("__id"), *coords, F.col(value).cast("double").alias("__r")), "residuals")
    norm = F.coalesce(F.sum(F.col("__r") * F.col("__r")), F.lit(0.0))
    start = rest.agg(norm).first()[0]
    g = list(grid)
    for _ in range(levels):
        lattice = s._level(rest, g, "__r")
        s.lattices.append((list(g), lattice))
        at = s._value(rest, g, lattice, ["__id"], "__l")
        left = F.col("__r") - F.coalesce("__l", F.lit(0.0))
        rest = stored(rest.join(at, "__id", "left").select("__id", *coords, left.alias("__r")), "residuals")
        if rest.agg(norm).first()[0] <= tolerance * start:
            break
        g = [2 * k - 1 for k in g]
    return s
