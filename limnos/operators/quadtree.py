"""Partitioning of the plane that follows the data: quadtree leaves from counted cells.

Points are counted in cells of the deepest level; a cell with more points than a leaf may hold is
split, so the leaves cover the square and hold about alike. There are at most about
``4 * DEPTH * LEAVES`` of them, whatever the table, which bounds all that is broadcast here. A leaf
of the deepest level that still holds too many points, a pile at one place, is cut by salt.

Boxes start at the level whose cells are about their size and reach the leaves below or above it by
equality, so a country covers the leaves of its points and not a fixed grid of them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from limnos.session import store

#: Deepest level: cells of a 65,536th of the square's side.
DEPTH = 16
#: A leaf holds the points divided by this, or LEAST points.
LEAVES = 2048
LEAST = 64


@dataclass(frozen=True)
class Quadtree:
    x0: float
    y0: float
    side: float
    #: leaf, level, i, j, salts
    leaves: DataFrame
    levels: tuple[int, ...]

    def index(self, v: Column, low: float, level: Column) -> Column:
        return _index(v, low, self.side, level)

    def of_points(self, rows: DataFrame, x: Column, y: Column) -> DataFrame:
        """``rows`` with the columns leaf and salt: each row once."""
        nodes = F.array(*(_node(F.lit(k), self.index(x, self.x0, F.lit(k)), self.index(y, self.y0, F.lit(k))) for k in self.levels))
        found = rows.withColumn("leaf", F.explode(nodes)).join(F.broadcast(self.leaves.select("leaf", "salts")), "leaf")
        return found.withColumn("salt", F.pmod(F.xxhash64(x, y, F.monotonically_increasing_id()), F.col("salts"))).drop("salts")

    def of_boxes(self, rows: DataFrame, box: Column, salted: bool = False) -> DataFrame:
        """``rows`` with the columns leaf, level, i, j and salt, once per leaf that the box touches; in leaves of several salts, once in any of them (``salted``) or in each."""
        extent = F.greatest(box["x1"] - box["x0"], box["y1"] - box["y0"], F.lit(self.side / (1 << DEPTH)))
        own = F.least(F.greatest(F.floor(F.log2(F.lit(self.side) / extent)), F.lit(0)), F.lit(DEPTH)).cast("int")
        at = lambda v, low, level: self.index(v, low, level)
        span = lambda level: F.flatten(F.transform(F.sequence(at(box["x0"], self.x0, level), at(box["x1"], self.x0, level)), lambda i: F.transform(F.sequence(at(box["y0"], self.y0, level), at(box["y1"], self.y0, level)), lambda j: _node(level, i, j))))
        # cells at the box's own level, and all cells above them: a leaf may lie on either side
        own_cells = F.transform(span(own), lambda n: F.struct(n.alias("node"), F.lit(False).alias("above")))
        above = F.when(own > 0, F.flatten(F.transform(F.sequence(F.lit(0), F.greatest(own - 1, F.lit(0))), lambda k: F.transform(span(k), lambda n: F.struct(n.alias("node"), F.lit(True).alias("above")))))).otherwise(F.array().cast("array<struct<node:bigint,above:boolean>>"))
        under = self.leaves.select("*", F.explode(F.transform(F.sequence(F.lit(0), F.col("level")), lambda k: _node(k, _shift(F.col("i"), F.col("level") - k), _shift(F.col("j"), F.col("level") - k)))).alias("node"))
        found = rows.withColumn("_box", box).withColumn("_cell", F.explode(F.concat(own_cells, above))).withColumn("node", F.col("_cell.node")).join(F.broadcast(under), "node")
        b = F.col("_box")
        touches = (at(b["x0"], self.x0, F.col("level")) <= F.col("i")) & (F.col("i") <= at(b["x1"], self.x0, F.col("level"))) & (at(b["y0"], self.y0, F.col("level")) <= F.col("j")) & (F.col("j") <= at(b["y1"], self.y0, F.col("level")))
        found = found.where(touches & (~F.col("_cell.above") | (F.col("leaf") == F.col("node"))))
        salt = F.pmod(F.xxhash64("_box", F.monotonically_increasing_id()), F.col("salts")) if salted else F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1))
        return found.withColumn("salt", salt).drop("_box", "_cell", "node", "salts")

    def holds(self, x: Column, y: Column) -> Column:
        """Whether the leaf of the columns level, i and j is the one of a point."""
        return (self.index(x, self.x0, F.col("level")) == F.col("i")) & (self.index(y, self.y0, F.col("level")) == F.col("j"))


def _shift(v: Column, by: Column) -> Column:
    return F.call_function("shiftright", v, by.cast("int"))


def _index(v: Column, low: float, side: float, level: Column) -> Column:
    """Cell number on an axis; beyond the square, the outermost cell."""
    cells = F.call_function("shiftleft", F.lit(1).cast("long"), level.cast("int"))
    return F.least(F.greatest(F.floor((v - low) / side * cells), F.lit(0).cast("long")), cells - 1)


def _node(level: Column, i: Column, j: Column) -> Column:
    n = lambda c: c.cast("long")
    return n(level) * (1 << 40) + n(i) * (1 << 20) + n(j)


def build(points: DataFrame, leaves: int = LEAVES, least: int = LEAST) -> Quadtree:
    """The tree of ``points(x, y)``; without points, one leaf."""
    seen = points.agg(F.min("x").alias("x0"), F.min("y").alias("y0"), F.max("x").alias("x1"), F.max("y").alias("y1"), F.count("x").alias("n")).first()
    x0, y0 = seen.x0 or 0.0, seen.y0 or 0.0
    side = max((seen.x1 or 0.0) - x0, (seen.y1 or 0.0) - y0, 1e-9) * (1 + 1e-9)
    most = max(least, seen.n // leaves)
    deep = F.lit(DEPTH)
    at = lambda v, low: _index(F.col(v), low, side, deep)
    cells = store(points.where("x is not null and y is not null").groupBy(at("x", x0).alias("i"), at("y", y0).alias("j")).agg(F.count("*").alias("n")))
    level = F.explode(F.sequence(F.lit(0), deep)).alias("level")
    counts = cells.select("i", "j", "n", level).groupBy("level", _shift(F.col("i"), deep - F.col("level")).alias("i"), _shift(F.col("j"), deep - F.col("level")).alias("j")).agg(F.sum("n").alias("n"))
    full = store(counts.where(F.col("n") > most))
    split = full.where(F.col("level") < deep)
    child = lambda c, k: (2 * F.col(c) + k).alias(c)
    children = split.select((F.col("level") + 1).alias("level"), F.explode(F.array(*(F.struct(child("i", a), child("j", b)) for a in (0, 1) for b in (0, 1)))).alias("c")).select("level", "c.i", "c.j")
    root = points.sparkSession.range(1).select(F.lit(0).alias("level"), F.lit(0).cast("long").alias("i"), F.lit(0).cast("long").alias("j"))
    ends = children.unionByName(root).join(split.select("level", "i", "j"), ["level", "i", "j"], "left_anti").join(full, ["level", "i", "j"], "left")
    found = store(ends.select(_node(F.col("level"), F.col("i"), F.col("j")).alias("leaf"), "level", "i", "j", F.coalesce(F.ceil(F.col("n") / most), F.lit(1)).cast("long").alias("salts")))
    used = tuple(sorted(r.level for r in found.select("level").distinct().collect()))
    return Quadtree(x0, y0, side, found, used)
