"""Places joined to polygons with holes and parts.

A polygon is a set of rings; a place is covered where a ray crosses an odd number of edges, or on an edge. Rings come as vertices
(polygon, ring, nth, x, y) in order; the last one joins the first. Every polygon is laid on a grid as fine as its size asks for: cells that an
edge touches are border cells, cells that lie wholly inside are inside cells. Places meet cells by an equi-join; those in
inside cells are settled, and only those in border cells meet edges, of which only those that reach the place's row of cells.
"""

from __future__ import annotations


from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fathomline.runtime import materialise

#: A polygon's longer side spans so many cells, or up to twice as many.
ACROSS = 32
#: Cells are marked as if edges were so much longer and wider, in parts of a cell.
SLACK = 1e-6


def edges(vertices: DataFrame) -> DataFrame:
    """(polygon, ring, x1, y1, x2, y2) of rings; an edge from a vertex to itself is left out."""
    ring = Window.partitionBy("polygon", "ring")
    at = ring.orderBy("nth")
    after = lambda c: F.coalesce(F.lead(c).over(at), F.first(c).over(at.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    laid = vertices.select("polygon", "ring", F.col("x").alias("x1"), F.col("y").alias("y1"), after("x").alias("x2"), after("y").alias("y2"))
    return laid.filter("x1 <> x2 or y1 <> y2")


def _cell(value: Column, level: Column) -> Column:
    return F.floor(value * F.pow(F.lit(2.0), level)).cast("bigint")


class Index:
    """Edges by rows of cells, and cells marked inside or border, of a polygon table."""

    def __init__(self, vertices: DataFrame):
        own = edges(vertices)
        size = F.greatest(F.max(F.greatest("x1", "x2")) - F.min(F.least("x1", "x2")), F.max(F.greatest("y1", "y2")) - F.min(F.least("y1", "y2")))
        level = own.groupBy("polygon").agg(F.ceil(F.log2(F.lit(float(ACROSS)) / size)).cast("int").alias("level"))
        own = own.join(level, "polygon")
        unit = F.pow(F.lit(2.0), F.col("level"))
        slack = F.lit(SLACK) / unit
        rows = F.sequence(_cell(F.least("y1", "y2") - slack, F.col("level")), _cell(F.greatest("y1", "y2") + slack, F.col("level")))
        self.edges = materialise(own.withColumn("row", F.explode(rows)), "polygon-edges")
        e = self.edges
        # the part of an edge inside a row of cells, and the columns that part touches
        low, high = F.col("row") / unit - slack, (F.col("row") + 1) / unit + slack
        slope = F.try_divide(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))
        x_at = lambda y: F.col("x1") + (F.least(F.greatest(y, F.least("y1", "y2")), F.greatest("y1", "y2")) - F.col("y1")) * slope
        ends = [F.when(F.col("y1") == F.col("y2"), c).otherwise(x_at(y)) for c, y in ((F.col("x1"), low), (F.col("x2"), high))]
        columns = F.sequence(_cell(F.least(*ends) - slack, F.col("level")), _cell(F.greatest(*ends) + slack, F.col("level")))
        border = e.select("polygon", "level", "row", F.explode(columns).alias("column")).distinct().withColumn("inside", F.lit(False))
        # along the middle of a row of cells, every second stretch between crossings lies inside
        middle = (F.col("row") + 0.5) / unit
        crossed = e.filter((F.col("y1") > middle) != (F.col("y2") > middle)).select("polygon", "level", "row", (F.col("x1") + (middle - F.col("y1")) * slope).alias("x"))
        order = Window.partitionBy("polygon", "row").orderBy("x")
        spans = crossed.withColumns({"to": F.lead("x").over(order), "k": F.row_number().over(order)}).filter("k % 2 = 1 and to is not null")
        first, last = _cell(F.col("x"), F.col("level")) + 1, _cell(F.col("to"), F.col("level")) - 1
        filled = spans.filter(first <= last).select("polygon", "level", "row", F.explode(F.sequence(first, last)).alias("column"))
        filled = filled.join(border, ["polygon", "level", "row", "column"], "left_anti").distinct().withColumn("inside", F.lit(True))
        self.cells = materialise(border.unionByName(filled), "polygon-cells")

    def covering(self, places: DataFrame, key: str, x: str, y: str) -> DataFrame:
        """(key, polygon): every polygon that covers each place; places without coordinates are covered by none."""
        levels = [r["level"] for r in self.cells.select("level").distinct().collect()]  # sizes of polygons, on a scale of powers of two
        own = places.select(F.col(key).alias("key"), F.col(x).alias("px"), F.col(y).alias("py"))
        own = own.filter("px is not null and py is not null and not isnan(px) and not isnan(py)")
        laid = own.withColumn("level", F.explode(F.array(*(F.lit(v) for v in levels)) if levels else F.expr("cast(array() as array<int>)")))
        laid = laid.withColumns({"row": _cell(F.col("py"), F.col("level")), "column": _cell(F.col("px"), F.col("level"))})
        met = laid.join(self.cells, ["level", "row", "column"])
        sure = met.filter("inside").select("key", "polygon")
        near = met.filter("not inside").select("key", "px", "py", "polygon", "row").join(self.edges.select("polygon", "row", "x1", "y1", "x2", "y2"), ["polygon", "row"])
        px, py, x1, y1, x2, y2 = (F.col(c) for c in ("px", "py", "x1", "y1", "x2", "y2"))
        crosses = ((y1 > py) != (y2 > py)) & (px < F.try_divide((x2 - x1) * (py - y1), y2 - y1) + x1)
        on_edge = ((x2 - x1) * (py - y1) - (y2 - y1) * (px - x1) == 0) & px.between(F.least(x1, x2), F.greatest(x1, x2)) & py.between(F.least(y1, y2), F.greatest(y1, y2))
        # places that share a key are told apart by where they are
        told = near.groupBy("key", "px", "py", "polygon").agg(F.sum(F.coalesce(crosses, F.lit(False)).cast("int")).alias("n"), F.max(on_edge).alias("on_edge"))
        return sure.unionAll(told.filter("n % 2 = 1 or on_edge").select("key", "polygon")).distinct().withColumnRenamed("key", key)

    def outside(self, places: DataFrame, key: list[str], x: str, y: str) -> DataFrame:
        """Places that no polygon covers, as an anti-join; those without coordinates stay."""
        one = F.to_json(F.struct(*key, F.col(x), F.col(y)))
        named = places.withColumn("_place", one)
        return named.join(self.covering(named, "_place", x, y), "_place", "left_anti").drop("_place")
