"""DBSCAN on a graph of cells: points of one cell are never paired with each other.

Cells are cubes of diagonal eps, so all points of a cell are neighbours. A cell of min_samples points or more is all core without a
look at its points. Only points of smaller cells count neighbours, and cells are boxes by then: a box that lies within eps of a point as a whole
counts by its size, one that lies farther counts nothing, and only the points of boxes on the border are looked at. A cell has
fewer than min_samples such points and a bounded number of neighbours, so that work grows with the points, not with their square.

Core cells are linked if two of their core points are within eps. Boxes decide most pairs of cells (all of both within eps, or none),
points at the edges of the boxes most of the rest. Pairs that stay open and are not yet connected through other cells are halved
along every dimension, box against box, until each is decided; boxes are tight, so equal points make a box without extent and rounds end.
All tests use the same floating-point sums as the distance of two points and are monotonic in it: results are exact.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from kinetra.functions.quantiles import checkpointed, cut

#: Dimensions by which neighbouring cells find each other.
GRID_DIMS = 3
#: Pairs of parts with at most so many pairs of points are compared point by point.
SMALL_PRODUCT = 1_024
#: Links that the driver unites at once.
FEW_LINKS = 50_000


def numbered(df: DataFrame, column: str, name: str, kind: str = "int") -> DataFrame:
    """df with `name`: 0, 1, ... in the order of a column of distinct values, by range partitions and their offsets."""
    parts = cut(df.repartitionByRange(column).withColumn("_p", F.spark_partition_id()))
    sizes = {r["_p"]: r["count"] for r in parts.groupBy("_p").count().collect()}  # one row for each partition
    offsets, total = [], 0
    for p in sorted(sizes):
        offsets.append((p, total))
        total += sizes[p]
    offset = F.broadcast(df.sparkSession.createDataFrame(offsets, "_p int, _at long"))
    place = F.row_number().over(W.partitionBy("_p").orderBy(column)) - 1
    return parts.withColumn("_r", place).join(offset, "_p").withColumn(name, (F.col("_at") + F.col("_r")).cast(kind)).drop("_p", "_at", "_r")


def _norm(parts: list[Column]) -> Column:
    return F.sqrt(reduce(lambda a, b: a + b, [p * p for p in parts]))


class _Space:
    """Column expressions over points x0.. and boxes l0.., h0.. of tables with aliases."""

    def __init__(self, dims: int):
        self.dims = range(dims)

    def points(self, a: str, b: str) -> Column:
        return _norm([F.col(f"{a}.x{k}") - F.col(f"{b}.x{k}") for k in self.dims])

    def near(self, a: str, b: str) -> Column:
        """The least distance that points of two boxes can have."""
        return _norm([F.greatest(F.col(f"{a}.l{k}") - F.col(f"{b}.h{k}"), F.col(f"{b}.l{k}") - F.col(f"{a}.h{k}"), F.lit(0.0)) for k in self.dims])

    def far(self, a: str, b: str) -> Column:
        """The greatest distance that points of two boxes can have."""
        return _norm([F.greatest(F.col(f"{a}.h{k}") - F.col(f"{b}.l{k}"), F.col(f"{b}.h{k}") - F.col(f"{a}.l{k}")) for k in self.dims])

    def point_near(self, p: str, b: str) -> Column:
        return _norm([F.greatest(F.col(f"{b}.l{k}") - F.col(f"{p}.x{k}"), F.col(f"{p}.x{k}") - F.col(f"{b}.h{k}"), F.lit(0.0)) for k in self.dims])

    def point_far(self, p: str, b: str) -> Column:
        return _norm([F.greatest(F.col(f"{b}.h{k}") - F.col(f"{p}.x{k}"), F.col(f"{p}.x{k}") - F.col(f"{b}.l{k}")) for k in self.dims])

    def boxes(self, points: DataFrame, *keys: str) -> DataFrame:
        """Size, tight box and, for each dimension, the points at its two edges, of the points of each key."""
        vector = F.array(*[F.col(f"x{k}") for k in self.dims])
        edges = F.array(*[f(vector, F.col(f"x{k}")) for k in self.dims for f in (F.min_by, F.max_by)])
        return points.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *[F.min(f"x{k}").alias(f"l{k}") for k in self.dims], *[F.max(f"x{k}").alias(f"h{k}") for k in self.dims], F.array_distinct(edges).alias("edges"))

    def edges_meet(self, a: str, b: str, eps: float) -> Column:
        """Whether two of the edge points of two boxes are within eps: at most 4 * dims**2 distances."""
        return F.exists(F.col(f"{a}.edges"), lambda p: F.exists(F.col(f"{b}.edges"), lambda q: _norm([p[k] - q[k] for k in self.dims]) <= eps))


def _spread(table: DataFrame, grid: list[str]) -> DataFrame:
    """Each row once for each neighbouring coarse cell."""
    for g in grid:
        table = table.withColumn(g, F.explode(F.array(*[F.col(g) + s for s in (-1, 0, 1)])))
    return table


def _few_components(cells: DataFrame, links: DataFrame) -> DataFrame:
    """`components` for at most FEW_LINKS links, which the driver unites."""
    rows = links.join(cells.select(F.col("cell").alias("a"), "root"), "a").select("a", "b", "root").collect()
    up = {r.a: r.a for r in rows}

    def top(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for r in rows:
        if top(r.a) != top(r.b):
            up[top(r.a)] = top(r.b)
    least: dict = {}
    for r in rows:
        t = top(r.a)
        least[t] = min(least.get(t, r.root), r.root)
    kinds = StructType([StructField("cell", cells.schema["cell"].dataType), StructField("_least", cells.schema["root"].dataType)])
    table = cells.sparkSession.createDataFrame([(c, least[top(c)]) for c in up], kinds)
    return cells.join(F.broadcast(table), "cell", "left").select("cell", F.coalesce("_least", "root").alias("root"))


def components(cells: DataFrame, links: DataFrame, max_rounds: int | None = None) -> DataFrame:
    """(cell, root): the least `root` of the cells that are linked. cells: (cell, root); links: (a, b), both ways.

    Rounds of least labels with hops; at most FEW_LINKS links, where no number of rounds is asked for, need none.
    """
    links = cut(links)
    if max_rounds is None and links.limit(FEW_LINKS + 1).count() <= FEW_LINKS:
        return _few_components(cells, links)
    labels, rounds = cut(cells.select("cell", "root")), 0
    while True:
        if rounds == max_rounds:
            raise RuntimeError(f"labels did not settle in {max_rounds} rounds")
        rounds += 1
        least = links.join(labels.select(F.col("cell").alias("b"), "root"), "b").groupBy(F.col("a").alias("cell")).agg(F.min("root").alias("m"))
        met = labels.join(least, "cell", "left").select("cell", F.col("root").alias("before"), F.least("root", "m").alias("m"))
        hop = cells.select(F.col("root").alias("m"), F.col("cell").alias("at")).join(labels.select(F.col("cell").alias("at"), F.col("root").alias("up")), "at").select("m", "up")
        labels = cut(met.join(hop, "m", "left").select("cell", F.least("m", "up").alias("root"), "before"))
        if not labels.where("root <> before").limit(1).count():
            return labels.select("cell", "root")
        labels = labels.select("cell", "root")


def _split_links(space: _Space, points: DataFrame, pairs: DataFrame, eps: float) -> DataFrame:
    """The pairs (a, b) of cells of which two points are within eps. points: (cell, x..). Open parts are halved along every dimension in rounds."""
    parts = points.select("cell", F.col("cell").alias("part"), *[f"x{k}" for k in space.dims])
    open_, found = pairs.select("a", "b", F.col("a").alias("pa"), F.col("b").alias("pb")), []
    while True:
        parts = checkpointed(parts)
        boxes = checkpointed(space.boxes(parts, "part"))
        sides = open_.join(boxes.select(F.col("part").alias("pa"), F.struct(*[c for c in boxes.columns if c != "part"]).alias("u")), "pa").join(boxes.select(F.col("part").alias("pb"), F.struct(*[c for c in boxes.columns if c != "part"]).alias("v")), "pb")
        meets = (space.far("u", "v") <= eps) | space.edges_meet("u", "v", eps)
        judged = checkpointed(sides.where(space.near("u", "v") <= eps).select("a", "b", "pa", "pb", meets.alias("meets"), (F.col("u.n") * F.col("v.n") <= SMALL_PRODUCT).alias("small")))
        sure = judged.where("meets").select("a", "b").distinct()
        rest = judged.where("NOT meets").join(sure, ["a", "b"], "left_anti")
        left = rest.where("small").join(parts.select(F.col("part").alias("pa"), F.struct(*[f"x{k}" for k in space.dims]).alias("u")), "pa").join(parts.select(F.col("part").alias("pb"), F.struct(*[f"x{k}" for k in space.dims]).alias("v")), "pb")
        sure = checkpointed(sure.unionByName(left.where(space.points("u", "v") <= eps).select("a", "b")).distinct())
        found.append(sure)
        open_ = checkpointed(judged.where("NOT meets AND NOT small").join(sure, ["a", "b"], "left_anti").select("a", "b", "pa", "pb"))
        if not open_.limit(1).count():
            return reduce(DataFrame.unionByName, found)
        used = open_.select(F.col("pa").alias("part")).unionByName(open_.select(F.col("pb").alias("part"))).distinct()
        side = F.concat_ws("", *[F.when(F.col(f"x{k}") > F.col(f"l{k}") + (F.col(f"h{k}") - F.col(f"l{k}")) / 2, "1").otherwise("0") for k in space.dims])
        halves = parts.join(used, "part").join(boxes.drop("n", "edges"), "part").select("cell", "part", F.concat_ws("/", "part", side).alias("half"), *[f"x{k}" for k in space.dims])
        names = checkpointed(halves.select("part", "half").distinct())
        open_ = open_.join(names.select(F.col("part").alias("pa"), F.col("half").alias("ha")), "pa").join(names.select(F.col("part").alias("pb"), F.col("half").alias("hb")), "pb").select("a", "b", F.col("ha").alias("pa"), F.col("hb").alias("pb"))
        parts = halves.select("cell", F.col("half").alias("part"), *[f"x{k}" for k in space.dims])


def dbscan(points: DataFrame, id_col: str, columns: Sequence[str], eps: float, min_samples: int, max_rounds: int | None = None) -> DataFrame:
    """(id, label): components of core points numbered from 0 by their least id; a border point takes the least core neighbour's; -1 is noise, as are rows with a null coordinate.

    Rounds go on until no label changes; more than max_rounds, where given, raise.
    """
    if not eps > 0:
        raise ValueError("eps must be above 0")
    space, dims = _Space(len(columns)), len(columns)
    side = eps / math.sqrt(dims) * (1 - 1e-9)  # a little less than the bound, so that rounding cannot part two points of a cell
    reach, grid = math.ceil(eps / side), [f"g{k}" for k in range(min(GRID_DIMS, dims))]
    x = [F.col(c).cast("double") for c in columns]
    present = reduce(lambda a, b: a & b, [c.isNotNull() for c in x])
    at = [F.floor(c / side) for c in x]
    all_ids = points.select(F.col(id_col).cast("long").alias("i"))
    table = checkpointed(points.where(present).select(F.col(id_col).cast("long").alias("i"), *[c.alias(f"x{k}") for k, c in enumerate(x)], F.concat_ws(",", *at).alias("cell"), *[F.floor(at[k] / reach).alias(g) for k, g in enumerate(grid)]))
    boxes = checkpointed(space.boxes(table, "cell", *grid))

    def neighbours(left: DataFrame, right: DataFrame, *carry: str) -> DataFrame:
        """(l, r): boxes or points of left with the boxes of right that may hold points within eps, their own cell's left out."""
        pairs = left.alias("l").join(_spread(right, grid).alias("r"), [F.col(f"l.{g}") == F.col(f"r.{g}") for g in grid])
        return pairs.where(F.col("l.cell") != F.col("r.cell"))

    def within(who: DataFrame, cells: DataFrame, of: DataFrame, value: Column) -> DataFrame:
        """(i, v): value of the cells near each point of who, by the whole cell where all of it is within eps, by its points elsewhere."""
        close = checkpointed(neighbours(who, cells).where(space.point_near("l", "r") <= eps).select("l.i", *[f"l.x{k}" for k in space.dims], F.col("r.cell").alias("cell"), (space.point_far("l", "r") <= eps).alias("whole"), value.alias("v")))
        whole = close.where("whole").select("i", "cell", "v")
        looked = close.where("NOT whole").alias("p").join(of.select("cell", *[f"x{k}" for k in space.dims]).alias("q"), "cell").where(space.points("p", "q") <= eps)
        return whole.unionByName(looked.groupBy("i", "cell").agg((F.count(F.lit(1)) if value is one else F.min("v")).alias("v")))

    one = F.col("r.n")
    slim = boxes.drop("edges")
    few = table.join(boxes.where(F.col("n") < min_samples).select("cell", F.col("n").alias("own")), "cell")
    counted = within(few, slim, table, one).groupBy("i").agg(F.sum("v").alias("v"))
    sparse = checkpointed(few.join(counted, "i", "left").withColumn("core", F.col("own") + F.coalesce("v", F.lit(0)) >= min_samples))
    crowded = table.join(boxes.where(F.col("n") >= min_samples).select("cell"), "cell")
    names = ["i", "cell", *grid, *[f"x{k}" for k in space.dims]]
    cores = checkpointed(crowded.select(*names).unionByName(sparse.where("core").select(*names)))
    core_boxes = checkpointed(space.boxes(cores, "cell", *grid).join(cores.groupBy("cell").agg(F.min("i").alias("root")), "cell"))
    meets = (space.far("l", "r") <= eps) | space.edges_meet("l", "r", eps)
    met = checkpointed(neighbours(core_boxes, core_boxes).where((F.col("l.cell") < F.col("r.cell")) & (space.near("l", "r") <= eps)).select(F.col("l.cell").alias("a"), F.col("r.cell").alias("b"), meets.alias("meets")))
    both = lambda links: links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    labels = components(core_boxes, both(met.where("meets")), max_rounds)
    undecided = met.where("NOT meets").join(labels.select(F.col("cell").alias("a"), F.col("root").alias("ra")), "a").join(labels.select(F.col("cell").alias("b"), F.col("root").alias("rb")), "b").where("ra <> rb")
    undecided = checkpointed(undecided.select("a", "b"))
    if undecided.limit(1).count():
        involved = undecided.select(F.col("a").alias("cell")).unionByName(undecided.select(F.col("b").alias("cell"))).distinct()
        links = _split_links(space, cores.join(involved, "cell"), undecided, eps)
        labels = components(core_boxes, both(met.where("meets").select("a", "b").unionByName(links)), max_rounds)
    table_of = numbered(labels.select("root").distinct(), "root", "label")
    rooted = cores.select("i", "cell").join(labels, "cell").select("i", "root")
    edge = sparse.where("NOT core")
    labelled = checkpointed(slim.drop("n", *[f"{s}{k}" for s in "lh" for k in space.dims]).join(core_boxes.drop("edges", "root", *grid), "cell").join(labels, "cell"))
    own = edge.select("i", "cell").join(labels, "cell").select("i", F.col("root").alias("v"))
    border = within(edge, labelled, cores, F.col("r.root")).select("i", "v").unionByName(own).groupBy("i").agg(F.min("v").alias("root"))
    out = all_ids.join(rooted.unionByName(border).join(table_of, "root").select("i", "label"), "i", "left")
    return out.select(F.col("i").alias(id_col), F.coalesce("label", F.lit(-1)).alias("label"))
